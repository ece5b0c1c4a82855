import numpy as np
import public_tokenizers as P
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tests.llm.test_decontaminate import words
from tests.llm.test_decontaminate import brute as benchmark_brute
from tests.llm.test_line_dedup import brute as lines_brute
from tests.llm.test_ngram_join import brute as near_brute

D = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()]
    state = {r.doc_id: r for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.columns == columns, name
        out = pipeline.common.written(out)
        got = {r.doc_id: r for r in out.collect()}
        rows = [(i, r.text) for i, r in state.items()]
        assert got and set(got) <= set(state)
        if name == "language":
            assert len(got) > 0.97 * len(state) and all(got[i] == state[i] for i in got)
        if name == "lines":
            want = {i: n for i, _, n, _ in lines_brute([(i, r.text, r.source) for i, r in state.items()])}
            assert {i for i in state if i not in got} <= {i for i, n in want.items() if n}
            assert all(got[i].n_chars == len(got[i].text) for i in got if want[i])
            assert all(got[i] == state[i] for i in got if not want[i])
        if name == "near_copies":
            assert set(got) == {c for _, _, c in near_brute(rows)}
        if name == "benchmark":
            assert set(got) == {r[0] for r in benchmark_brute(rows, items) if not r[5]} and len(got) < len(state)
        docs, state = out, got
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    final = pipeline.encoded(spark, docs, D).collect()
    assert {r.doc_id for r in final} == set(state) and all(r.exact for r in final)
    for r in final:
        assert np.frombuffer(r.ids, "<u4").tolist() == tokenizer.encode(state[r.doc_id].text, add_special_tokens=False).ids
    assert {r.doc_id for r in pipeline.run(spark, D).select("doc_id").collect()} == set(state)


def test_edges(spark):
    schema = spark.read.parquet(f"{D}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "12 34", "en", None, 5), (4, "the cat of the house and the dog", "en", "b", 32), (5, None, "de", "c", 0)]
    df = spark.createDataFrame(rows, schema)
    for table in (df, df.limit(0)):
        docs = table
        for _, stage in pipeline.STAGES:
            docs = pipeline.common.written(stage(spark, docs, D))
        assert {r.doc_id for r in docs.collect()} <= {4}
    assert words(None) == []


def test_clean_text_in_several_languages_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pick = {}
    for r in docs.where("n_chars BETWEEN 1500 AND 6000").orderBy("doc_id").collect():
        pick.setdefault(r.lang, []).append(r.text.split()[:120])
    langs = sorted(pick)[:3]
    rows = []
    for i in range(5):
        two, three = [" ".join(" ".join(pick[y][i]) for y in langs[:n]) for n in (2, 3)]
        rows += [(10**6 + 2 * i, two, None, "mixed", len(two)), (10**6 + 2 * i + 1, three, None, "mixed", len(three))]
    table = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    got = {r.doc_id for r in pipeline.language_id(spark, table, D).where("source = 'mixed'").collect()}
    assert got == {r[0] for r in rows}


def test_odd_rows_and_clashing_names(spark):
    """Null and repeated ids, repeated rows, null, empty and long texts, ties, and columns named as the operators' own."""
    base = spark.read.parquet(f"{D}/documents.parquet")
    some = [tuple(r) for r in base.where("n_chars BETWEEN 800 AND 3000").orderBy("doc_id").limit(25).collect()]
    own = some[0]
    rows = some + [own, (None, *own[1:]), (None, None, None, None, None), (9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, " ".join([own[1]] * 200) + " \n" * 50_000, own[2], "s", None), (9004, "12 34", None, None, 5)]
    names = {"row": "r", "doc": 1, "text2": "t", "id": 2, "n": 3, "token": "k", "hi": 4, "kept": "k", "stays": True, "ids": "i", "lang_pred": "xx", "certainty": 0.0, "component_id": 5, "n_removed": 6, "h1": 7, "value": "v", "label": "l"}
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, base.schema).select("*", *(F.lit(v).alias(c) for c, v in names.items())).repartition(3)
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.common.written(stage(spark, docs, D))
        assert docs.columns == columns
        assert all(r[c] == v for r in docs.collect() for c, v in names.items())
        seen[name] = [(r.doc_id, r.text) for r in docs.collect()]
    assert {None} <= {i for i, _ in seen["language"]} and not {9001, 9002, 9004} & {i for i, _ in seen["language"]}
    assert seen["language"].count((own[0], own[1])) == 2 and seen["language"].count((None, own[1])) == 1
    assert (None, own[1]) in seen["lines"] and (None, own[1]) in seen["near_copies"]
    final = pipeline.encoded(spark, docs, D).collect()
    assert len(final) == len(seen["benchmark"]) and all(r.exact for r in final)


def test_resume_from_written_stages(spark, monkeypatch):
    folder, calls = pipeline.common.scratch_dir(spark), []
    def cheap(name, keep):
        def stage(spark, docs, sf_dir):
            calls.append(name)
            return docs.where(keep)

        return name, stage

    monkeypatch.setattr(pipeline, "STAGES", [cheap("a", "doc_id % 2 = 0"), cheap("b", "doc_id % 3 = 0"), cheap("c", "doc_id > 5")])
    want = {r.doc_id for r in pipeline.run(spark, D).collect()}
    assert calls == ["a", "b", "c"] and want and all(i % 6 == 0 and i > 5 for i in want)
    assert {r.doc_id for r in pipeline.run(spark, D, folder).collect()} == want
    assert {r.doc_id for r in pipeline.run(spark, D, folder).collect()} == want
    assert calls == ["a", "b", "c"] * 2 + ["c"]
    # a stage that broke off while it was written has no mark and is run again
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/1_b/_SUCCESS")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, False)
    assert {r.doc_id for r in pipeline.run(spark, D, folder).collect()} == want
    assert calls[-2:] == ["b", "c"]
