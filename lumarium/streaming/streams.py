"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import maintain, ordered
from ..operators.predicates import criteria


def view_stream(events: DataFrame) -> DataFrame:
    """(path, count, first, last) as views (path, ts) arrive: for update mode, in which a micro-batch gives the paths that it
    changes and no others. Spark's state store has the counts of all paths; ``first`` is the earliest time other than 0."""
    return events.groupBy("path").agg(F.count("*").alias("count"), F.coalesce(F.min(F.nullif("ts", F.lit(0))), F.lit(0)).alias("first"), F.max("ts").alias("last"))


def cache_stream(accesses: DataFrame) -> DataFrame:
    """(url, file, fetched, used, bytes) as accesses (url, file, ts, bytes) arrive, for update mode: the latest access of
    each url counts, in whatever order they come."""
    last = accesses.groupBy("url").agg(F.max(F.struct("ts", "bytes", "file")).alias("l"))
    return last.select("url", F.col("l.file").alias("file"), F.col("l.ts").alias("fetched"), F.col("l.ts").alias("used"), F.col("l.bytes").alias("bytes"))


def _compacted(spark: SparkSession, table: str, schema: str, key: str, batch_id: int) -> None:
    if batch_id and batch_id % maintain.COMPACT_EVERY == 0:
        maintain.compact(spark, table, schema, key, batch_id)


def view_sink(table: str):
    """For foreachBatch on a view stream: the changed paths of each batch go to the kept history."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        _compacted(batch.sparkSession, table, maintain.VIEWS, "path", batch_id)
        maintain.write_changes(batch, table, batch_id)

    return apply


def cache_sink(table: str, cap: int | None = None):
    """For foreachBatch on a cache stream: the changed urls of each batch go to the kept index. With a cap, the least recently
    used ones beyond it are marked as gone in the same write, which grows with the batch and the bounded number of them."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        _compacted(spark, table, maintain.CACHE, "url", batch_id)
        rows = batch.withColumn("gone", F.lit(False))
        if cap is not None:
            old = maintain.read_changes(spark, table, maintain.CACHE, "url", batch_id)
            index = maintain.upsert(old, batch, "url")
            out = ordered.victims(index, cap).withColumn("gone", F.lit(True)).select(*rows.columns)
            rows = maintain.upsert(rows, out, "url")
        maintain.write_changes(rows, table, batch_id)

    return apply


def search_stream(records: DataFrame, **wanted) -> DataFrame:
    """A standing search: records that meet the criteria as they arrive."""
    return records.where(criteria(**wanted))


def follow(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of new files in a folder."""
    return spark.readStream.text(folder)


def once_per_key(stream: DataFrame, key: str, ts: str, watermark: str) -> DataFrame:
    """Each key once; keys are remembered for the length of the watermark."""
    return stream.withWatermark(ts, watermark).dropDuplicatesWithinWatermark([key])


#: Seconds: the gap without a rule, the longest wait, and the bounds and default of a cool-down.
MIN_GAP, MAX_WAIT, COOL_DEFAULT, COOL_MIN, COOL_MAX = 0.5, 5.0, 5, 1, 300
PACED = "host string, id long, arrival double, start double, refused boolean"


def pace_rows(rows: pd.DataFrame, last: float | None, cool: float | None) -> tuple[list, float | None, float | None]:
    """One host's requests in order of arrival, from a state (last start, end of cool-down) to the next.

    A row is (id, arrival, gap, throttled, retry_after): throttled ones open a cool-down at their arrival; others wait for it
    when it ends soon, are refused when it doesn't, and else keep the gap.
    """
    out = []
    for r in rows.sort_values(["arrival", "id"]).itertuples():
        if r.throttled:
            asked = COOL_DEFAULT if pd.isna(r.retry_after) else r.retry_after
            cool = r.arrival + min(max(asked, COOL_MIN), COOL_MAX)
            continue
        if cool is not None and cool > r.arrival:
            if cool - r.arrival > MAX_WAIT:
                out.append((r.id, r.arrival, None, True))
                continue
            last = cool
        elif cool is not None:
            # the cool-down is over: this one goes at once, and the clock of starts stays
            cool = None
            out.append((r.id, r.arrival, r.arrival, False))
            continue
        else:
            gap = min(MIN_GAP if pd.isna(r.gap) else r.gap, MAX_WAIT)
            last = r.arrival if last is None else max(r.arrival, last + gap)
        out.append((r.id, r.arrival, last, False))
    return out, last, cool


class Pacer(StatefulProcessor):
    """Requests of a host wait until the watermark has passed them, then take their turn in order of arrival. The state of a
    host is the last start, the end of its cool-down, and the requests that wait: as many as the watermark's delay lets in."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "last double, cool double, timer long")
        self.waiting = handle.getListState("waiting", "id long, arrival double, gap double, throttled boolean, retry_after double, due long")

    def _state(self) -> tuple:
        return tuple(self.clock.get()) if self.clock.exists() else (None, None, None)

    def _wait(self, last: float | None, cool: float | None, timer: int | None, due: int) -> None:
        """One timer for a host, at its first waiting request."""
        if timer is None or due < timer:
            self.handle.registerTimer(due)
            timer = due
        self.clock.update((last, cool, timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            # a request is due at the first millisecond that isn't before it
            due = -(-part["ts"].astype("datetime64[us]").astype("int64") // 1000)
            columns = zip(part["id"], part["arrival"], part["gap"], part["throttled"], part["retry_after"], due, strict=True)
            self.waiting.appendList([tuple(None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r) for r in columns])
            first = int(due.min()) if first is None else min(first, int(due.min()))
        if first is not None:
            self._wait(*self._state(), first)
        yield PACED_NOTHING

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        rows = pd.DataFrame([r[:5] for r in waiting if r[5] <= now], columns=["id", "arrival", "gap", "throttled", "retry_after"])
        last, cool, _ = self._state()
        out, last, cool = pace_rows(rows, last, cool)
        later = [r for r in waiting if r[5] > now]
        self.waiting.clear()
        self.clock.update((last, cool, None))
        if later:
            self.waiting.put(later)
            self._wait(last, cool, None, min(r[5] for r in later))
        yield pd.DataFrame([(key[0], *r) for r in out], columns=PACED_NOTHING.columns).astype({"start": "float64"}) if out else PACED_NOTHING

    def close(self) -> None:
        pass


PACED_NOTHING = pd.DataFrame({"host": pd.Series([], dtype="str"), "id": pd.Series([], dtype="int64"), "arrival": pd.Series([], dtype="float64"), "start": pd.Series([], dtype="float64"), "refused": pd.Series([], dtype="bool")})
#: State with timers is kept in this store (a fixed name of Spark).
TIMED_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def pace_stream(requests: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Requests (host, id, arrival, gap, throttled, retry_after, ts) with their start, or refused. ``ts`` is the time of
    arrival; requests of a host may come out of order by up to ``delay``, and later ones are dropped. Append mode, with
    TIMED_STATE; a request comes out once the watermark has passed it."""
    timed = requests.withWatermark("ts", delay)
    return timed.groupBy("host").transformWithStateInPandas(Pacer(), PACED, "append", "eventTime")


def pace_batch(requests: DataFrame) -> DataFrame:
    """The same over a stored table. A host's requests come to a task in their order and pass through it some at a time, with
    the state of the host they are of, so that no host is held as a whole."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, last, cool = None, None, None
        for part in parts:
            new = part["host"].ne(part["host"].shift()) & ~(part["host"].isna() & part["host"].shift().isna())
            for _, rows in part.groupby(new.cumsum(), sort=False):
                own = rows["host"].iloc[0]
                if not (own == host or (pd.isna(own) and host is pd.NA)):
                    host, last, cool = (pd.NA if pd.isna(own) else own), None, None
                out, last, cool = pace_rows(rows, last, cool)
                if out:
                    yield pd.DataFrame([(own, *r) for r in out], columns=PACED_NOTHING.columns).astype({"start": "float64"})

    columns = requests.select("host", "id", "arrival", "gap", "throttled", "retry_after")
    return columns.repartition("host").sortWithinPartitions("host", "arrival", "id").mapInPandas(run, PACED)
