"""A corpus pipeline of five stages, each one of the operators of ``lumarium.llm``.

Every stage takes (spark, docs, sf_dir), where docs has the columns of ``documents``, and works on all that the stage before
it kept. Stages are written as Parquet to the shared folder and read again, so none depends on the executors of another.

All but the last return the columns of docs, of whatever names, in their order. An empty table stays empty. Texts of any
length are worked on whole. Each stage says what it does with null ids, null and empty texts, and rows that repeat an id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumarium.llm import bpe, common, decontaminate, language_crf, line_dedup, ngram_join

#: A text is rejected when its language is undetermined or the labels of its words, whichever they are, are on the mean less
#: certain than this. Text in several languages stays.
MIN_LANGUAGE_CERTAINTY = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose words have a clear language, be it one or several. The model learns from the rows of docs with a language; none is left out.

    Null and empty texts, and those without a letter, are undetermined and go. Ids play no part: rows with a null or a
    repeated id stay or go by their own text. Equally likely labels of a text are one choice or the other; only their
    certainty counts here."""
    common.tuned(spark)
    model = language_crf.fit(docs)
    out = language_crf.predict(docs, model)
    return out.where((F.col("lang_pred") != language_crf.UNDETERMINED) & (F.col("certainty") >= MIN_LANGUAGE_CERTAINTY)).select("row.*")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated cross-site lines out of the texts; documents that lose all their text go, others stay, with n_chars of
    what is left. Null and empty texts, of which nothing is taken, stay. A null id takes part in nothing and its row stays as
    it is; rows that repeat an id are one document."""
    common.tuned(spark)
    names = [c for c in docs.columns if c != "text"]
    out = line_dedup.line_dedup(docs, keep=names)
    changed = F.col("n_removed") > 0
    out = out.where(~changed | (F.length(F.btrim("kept", F.lit(" \t\r\n"))) > 0))
    columns = {c: F.col(f"row.`{c}`") for c in names if c != "n_chars"} | {"text": F.col("kept"), "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("row.n_chars"))}
    return out.select(*(columns[c].alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies. Texts without words, null ones among them, are
    near to nothing and stay, and so do rows with a null id; rows that repeat an id are equal and stay or go together."""
    common.tuned(spark)
    keep = ngram_join.ngram_jaccard_join(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return common.with_ids(docs, common.written(keep), "doc_id", "left_anti").select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a passage of the benchmark occurs, each row by its own text; null and empty texts have none."""
    common.tuned(spark)
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (binary, little-endian unsigned 32-bit) of each row, whose decoding must equal its text (null: empty)."""
    common.tuned(spark)
    out = bpe.bpe_encode_decode(docs)
    same = F.col("decoded") == F.coalesce(F.col("row.text"), F.lit(""))
    return out.select("row.doc_id", "row.lang", "row.source", "n_tokens", "ids", same.alias("exact"))


STAGES = [
    ("language", language_id),
    ("lines", drop_boilerplate),
    ("near_copies", drop_near_copies),
    ("benchmark", decontaminated),
    ("tokens", encoded),
]

#: The first stage is a trained model, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """The last stage of ``documents``. With a ``folder`` that all machines see, each stage is a table in it, and a run that
    finds a whole table of a stage there goes on from it; without one, tables are scratch, and each goes when the next one is
    written."""
    docs, before = common.documents(spark, sf_dir), None
    for k, (name, stage) in enumerate(STAGES[:-1]):
        if folder is None:
            docs = common.written(stage(spark, docs, sf_dir))
            if before is not None:
                common.dropped(before)
            before = docs
            continue
        path = f"{folder.rstrip('/')}/{k}_{name}"
        if not common.is_written(spark, path):
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
