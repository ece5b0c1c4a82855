"""Set operations over tables of media records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import dedup_first


def media(sources: dict[str, DataFrame]) -> DataFrame:
    """One table of all sources with a source tag; columns that a source lacks are null."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def distinct_names(df: DataFrame, name: str = "name") -> DataFrame:
    return df.select(name).distinct()


def all_installed(libraries: list[DataFrame], key: str = "appid") -> DataFrame:
    """One row per id over all libraries: the one that comes first by name."""
    return dedup_first(reduce(lambda a, b: a.unionByName(b), libraries), [key], [F.lower("name"), "name"])


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    return wanted.join(have, key, "left_anti")
