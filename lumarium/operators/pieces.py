"""Numbers, neighbours and running values of ordered rows, without a window over a whole key.

Rows are dealt to range partitions by key and order, so that a key with a third of all rows lies in many of them, and written
with the number of their partition and their place in it. What a piece (the rows of one key in one partition) owes to those
before it is small: a count, an edge row, a bound. One row for each piece, as many as there are keys and partitions, carries
it along the pieces of a key; the rows then work within their piece. Rows that are equal in key and order lie together, so
the order should be a total one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

PART, SEQ = "_part", "_seq"


def cut(df: DataFrame, keys: list[str], order: list, parts: int | None = None) -> DataFrame:
    """A written table of df with ``_part`` and ``_seq``; ``parts`` is the number of partitions, Spark's own by default."""
    by = [*keys, *order]
    dealt = df.repartitionByRange(*([parts] if parts else []), *by).sortWithinPartitions(*by)
    # the upper bits are the partition's, the lower ones count its rows
    place = dealt.withColumn("_row", F.monotonically_increasing_id())
    return written(place.select(*df.columns, F.shiftright("_row", 33).cast("int").alias(PART), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)).alias(SEQ)))


def joined(pieces: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what is carried to their piece; null keys are keys."""
    names = {c: f"_k_{c}" for c in [*keys, PART]}
    right = carried.withColumnsRenamed(names)
    on = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(names[c])), keys, F.col(PART) == F.col(names[PART]))
    return pieces.join(right, on).drop(*names.values())


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "_n", parts: int | None = None) -> DataFrame:
    """df with the number, from 1, of each row of a key. Rows are not shuffled but for the range partitions: their place in a
    partition and the counts before it make the number."""
    rows = cut(df, keys, order, parts)
    counts = rows.groupBy(*keys, PART).agg(F.count("*").alias("_count"), F.min(SEQ).alias("_first"))
    before = F.sum("_count").over(Window.partitionBy(*keys).orderBy(PART)) - F.col("_count")
    out = joined(rows, counts.select(*keys, PART, "_first", before.alias("_before")), keys)
    return out.select(*df.columns, (F.col("_before") + F.col(SEQ) - F.col("_first") + 1).alias(name))


def beside(df: DataFrame, keys: list[str], order: list, value: Column, before: str | None = "_before", after: str | None = None, parts: int | None = None) -> DataFrame:
    """df with ``value`` of the row before and after each row of its key, as structs of one field ``v``: null where there is
    no such row. The edges of a piece come from the pieces beside it."""
    rows = cut(df.withColumn("_v", F.struct(value.alias("v"))), keys, order, parts)
    edges = rows.groupBy(*keys, PART).agg(F.min_by("_v", SEQ).alias("_first"), F.max_by("_v", SEQ).alias("_last"))
    along, within = Window.partitionBy(*keys).orderBy(PART), Window.partitionBy(*keys, PART).orderBy(SEQ)
    edges = edges.select(*keys, PART, F.lag("_last").over(along).alias("_from"), F.lead("_first").over(along).alias("_to"))
    out = joined(rows, edges, keys)
    found = [F.coalesce(side("_v").over(within), F.col(edge)).alias(name) for name, side, edge in ((before, F.lag, "_from"), (after, F.lead, "_to")) if name]
    return out.select(*df.columns, *found)


def carried(df: DataFrame, keys: list[str], order: list, value: Column, name: str, parts: int | None = None) -> DataFrame:
    """df with ``name``: the last ``value`` that isn't null up to and with each row of its key."""
    rows = cut(df.withColumn("_v", value), keys, order, parts)
    along, within = Window.partitionBy(*keys).orderBy(PART), Window.partitionBy(*keys, PART).orderBy(SEQ)
    last = rows.groupBy(*keys, PART).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(SEQ))).alias("_last"))
    before = last.select(*keys, PART, F.last("_last", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_from"))
    out = joined(rows, before, keys)
    own = F.last("_v", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0))
    return out.select(*df.columns, F.coalesce(own, "_from").alias(name))


def chained(df: DataFrame, keys: list[str], order: list, least: Column, gap: Column, name: str, parts: int | None = None) -> DataFrame:
    """df with ``name``: the running value max(least, value of the row before + gap) of each key.

    A row is a map x -> max(x + shift, bound), and so is a piece, whose shift is the sum of its gaps and whose bound is its
    last value when nothing comes before it. Along the pieces of a key these maps make what each piece starts from.
    """
    rows = cut(df.withColumn("_least", least).withColumn("_gap", gap), keys, order, parts)
    within = Window.partitionBy(*keys, PART).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_sum", F.sum("_gap").over(within))
    rows = rows.withColumn("_own", F.max(F.col("_least") - F.col("_sum")).over(within) + F.col("_sum"))
    maps = rows.groupBy(*keys, PART).agg(F.sum("_gap").alias("_shift"), F.max_by("_own", SEQ).alias("_bound"))
    along = Window.partitionBy(*keys).orderBy(PART)
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    maps = maps.withColumn("_total", F.sum("_shift").over(so_far))
    maps = maps.withColumn("_end", F.max(F.col("_bound") - F.col("_total")).over(so_far) + F.col("_total"))
    maps = maps.select(*keys, PART, F.lag("_end").over(along).alias("_start"))
    out = joined(rows, maps, keys)
    return out.select(*df.columns, F.greatest("_own", F.col("_start") + F.col("_sum")).alias(name))
