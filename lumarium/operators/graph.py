"""Walks over link tables and path trees."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import exprs as X
from .predicates import glob_any
from .scratch import delete, dropped, scratch, written

__all__ = ["MAX_DEPTH", "ancestors", "crawl", "run_order", "scratch", "subtree", "written"]

MAX_DEPTH = 12


def crawl(seeds: DataFrame, links: DataFrame, mask: str = "", max_depth: int = MAX_DEPTH) -> DataFrame:
    """(dir, name, depth): files reachable from the seeds (dir) over links (dir, name, target, is_dir), breadth first.

    Folders are followed to ``max_depth`` and visited once, at their smallest depth; the mask applies to files only. At most
    max_depth + 1 joins; a step with nothing new ends the walk. What was visited is one table, to which each step appends the
    folders that are new; the frontier of a step goes when the next one is there, and the table when the files are found.
    """
    spark = seeds.sparkSession
    folders = written(links.where("is_dir").select("dir", "target").distinct())
    level = written(seeds.select("dir").distinct().withColumn("depth", F.lit(0)))
    path = scratch(spark)
    level.write.parquet(path)

    def visited() -> DataFrame:
        return spark.read.schema(level.schema).parquet(path)

    for depth in range(1, max_depth + 1):
        step = level.select("dir").join(folders, "dir").select(F.col("target").alias("dir")).distinct()
        new = written(step.join(visited().select("dir"), "dir", "left_anti").withColumn("depth", F.lit(depth)))
        dropped(level)
        level = new
        if not level.limit(1).count():
            break
        level.write.mode("append").parquet(path)
    files = links.where(~F.col("is_dir") & glob_any("name", mask)).select("dir", "name")
    out = written(visited().join(files, "dir").select("dir", "name", "depth"))
    dropped(level)
    dropped(folders)
    delete(spark, path)
    return out


def subtree(cat: DataFrame, root: str, path: str = "path") -> DataFrame:
    return cat.where((F.col(path) == root) | F.startswith(path, F.lit(root.rstrip("/") + "/")))


def ancestors(cat: DataFrame, path: str = "path") -> DataFrame:
    """(path, folder, depth) for every folder above each path."""
    return cat.select(path, F.posexplode(X.ancestors(path)).alias("depth", "folder")).select(path, "folder", "depth")


@F.arrow_udf(T.ArrayType(T.StringType()))
def _walked(tasks: pa.Array, label: pa.Array) -> pa.Array:
    out = []
    for row, start in zip(tasks, label.to_pylist(), strict=True):
        listed = row.as_py()
        if listed is None:
            out.append(None)
            continue
        needs: dict[str, list] = {}
        for t in listed:
            if t and t["label"] is not None:
                needs.setdefault(t["label"], t["depends_on"] or [])
        seen, order, stack = set(), [], [(start, False)]
        while stack:
            top, leave = stack.pop()
            if leave:
                order.append(top)
            elif top in needs and top not in seen:
                seen.add(top)
                stack.append((top, True))
                stack.extend((d, False) for d in reversed(needs[top]))
        out.append(order)
    return pa.array(out, pa.list_(pa.string()))


def run_order(tasks: str, label: Column) -> Column:
    """The labels to run, in order, for a label of a row's tasks (label, depends_on): what a task depends on comes before it,
    in the order that it is named, each label once, and a cycle is cut where it comes back. Labels without a task are left
    out; of tasks with one label the first counts.

    A walk in its row: a stack of labels to enter and to leave, and a table of tasks by label, so that a step takes the same
    time in a long list."""
    return _walked(F.col(tasks), label)
