"""Structured Streaming forms of incremental work."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.asof import asof_join
from tidemark.sources.lake import aware
from tidemark.sources.versions import KeyedTable, RowLog


def timed(stream: DataFrame, event_time: str, late: str) -> DataFrame:
    """Naive timestamps as instants, with a watermark as wide as the refresh horizon."""
    return aware(stream).withWatermark(event_time, late)


def unsettled(desired: DataFrame, manifest: DataFrame, key: str = "_chunk") -> DataFrame:
    """I1, batch: chunks still to be fetched."""
    return desired.join(manifest.filter("settled").select(key), key, "left_anti")


def deduplicated(stream: DataFrame, keys: list[str], event_time: str, late: str) -> DataFrame:
    """First delivery of each key within the watermark."""
    return timed(stream, event_time, late).dropDuplicatesWithinWatermark(keys)


def latest_delivery(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], delivered: str, buckets: int = 64) -> KeyedTable:
    """Table that keeps the latest delivery of each key; of deliveries at the same time the last by its other columns."""
    return KeyedTable(spark, path, schema, keys, [delivered, *[c for c in schema.names if c not in (*keys, delivered)]], buckets)


def last_written(spark: SparkSession, path: str, schema: T.StructType, keys: list[str], order: list[str], buckets: int = 64) -> KeyedTable:
    """Table that keeps the row of the latest batch for each key, and of equal keys in a batch the last in `order`."""
    return KeyedTable(spark, path, schema, keys, order, buckets, by_batch=True)


def keyed_sink(table: KeyedTable, compact_every: int = 16, stream: str = "", prepare=None):
    """foreachBatch function that appends each batch to a table, once, and merges what has gathered now and then.

    What a batch writes grows with the batch. `prepare` makes the rows of the
    table from those of the stream. A batch that is run again after a failure is
    found in the ledger.
    """

    def write(batch: DataFrame, number: int) -> None:
        table.append(prepare(batch) if prepare else batch, number, stream)
        if (number + 1) % compact_every == 0:
            table.compact()

    return write


def newest_vintages(spine: DataFrame, path: str, on: list[str], payload: list[str], issued: str, tie: list[str], cutoff: str = "cutoff_utc", schema: T.StructType | None = None):
    """(table, function that makes its rows of a batch): the newest vintage known by the cutoff for each spine row.

    schema is that of the stream's rows. Of vintages issued at the same time the
    last by `tie` (columns of the stream) stays, within a batch and between batches.
    """
    columns = list(dict.fromkeys([*payload, *tie]))
    kinds = {f.name: f.dataType for f in [*spine.schema.fields, *schema.fields]}
    rows = T.StructType([T.StructField(c, kinds[c]) for c in (*on, cutoff, *columns, issued)])
    table = KeyedTable(spine.sparkSession, path, rows, [*on, cutoff], [issued, *tie, *[c for c in payload if c not in tie]])
    fresh = lambda batch: asof_join(spine, batch, on, columns, issued, cutoff, tie=tie, how="inner").select(*rows.names)
    return table, fresh


def chunked_sink(path: str, schema: T.StructType, event_time: str, horizon: str, chunk_of=None):
    """foreachBatch function: rows of chunks (days) that are still open go to `main`, those of settled ones to `late`, and `state` says which are which.

    A chunk is settled once the newest event is past its end by the horizon; the
    state after a batch decides on the next one. Chunks that are not settled are
    those to be fetched again (`unsettled`). Each of the three tables knows its
    batches, so a batch that is run again after a failure adds what is missing.
    """
    chunk_of = chunk_of or (lambda c: F.to_date(c))

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        main, late, state = chunked_tables(spark, path, schema)
        known = state.read()
        rows = batch.withColumn("_chunk", chunk_of(F.col(event_time)))
        # what was settled before this batch: a batch that is run again must not see its own verdict
        known = known.filter(F.col("batch") < number)
        closed = known.filter("settled").select("_chunk")
        parted = rows.join(closed.withColumn("_closed", F.lit(True)), "_chunk", "left")
        main.append(parted.filter(F.col("_closed").isNull()), number)
        late.append(parted.filter("_closed"), number)
        seen = rows.groupBy("_chunk").agg(F.max(event_time).alias("newest"))
        both = known.select("_chunk", "newest", "settled", "batch").unionByName(seen.select("_chunk", "newest", F.lit(False).alias("settled"), F.lit(number).cast("long").alias("batch")))
        per = both.groupBy("_chunk").agg(F.max("newest").alias("newest"), F.min(F.when(F.col("settled"), F.col("batch"))).alias("_since"))
        top = F.broadcast(per.agg(F.max("newest").alias("_top")))
        done = F.date_add("_chunk", 1).cast("timestamp_ntz") + F.expr(f"INTERVAL {horizon}") <= F.col("_top")
        now = per.filter("_since is null").crossJoin(top).select("_chunk", "newest", done.alias("settled"), F.lit(number).cast("long").alias("batch"))
        state.append(now, number)
        if number % 16 == 15:
            state.compact()

    return write


def chunked_tables(spark: SparkSession, path: str, schema: T.StructType) -> tuple[RowLog, RowLog, KeyedTable]:
    """The tables main, late and state of a chunked_sink; the first two keep all rows in the order of their batches."""
    kept = T.StructType([*schema.fields, T.StructField("_chunk", T.DateType())])
    state = T.StructType.fromDDL("_chunk date, newest timestamp_ntz, settled boolean, batch long")
    return RowLog(spark, f"{path}/main", kept), RowLog(spark, f"{path}/late", kept), KeyedTable(spark, f"{path}/state", state, ["_chunk"], ["newest"], by_batch=True)


def settled(forecasts: DataFrame, actuals: DataFrame, key: list[str], made: str, at: str, within: str) -> DataFrame:
    """I4: forecasts joined to the actual that arrives within an interval after them; both sides carry watermarks."""
    f, a = forecasts.alias("f"), actuals.alias("a")
    cond = (F.col(f"a.{at}") >= F.col(f"f.{made}")) & (F.col(f"a.{at}") <= F.col(f"f.{made}") + F.expr(f"INTERVAL {within}"))
    for k in key:
        cond = cond & (F.col(f"f.{k}") == F.col(f"a.{k}"))
    return f.join(a, cond).select("f.*", *[F.col(f"a.{c}").alias(c) for c in actuals.columns if c not in forecasts.columns])


def complete_days(stream: DataFrame, event_time: str, value: str, expected: int, share: float = 0.9) -> DataFrame:
    """Days whose known values reach a share of the expected, once the watermark has passed them."""
    out = stream.groupBy(F.window(event_time, "1 day").alias("w")).agg(F.count(value).alias("n"), F.sum(value).alias("total"))
    return out.filter(F.col("n") >= share * expected).select(F.col("w.start").alias("day"), "n", "total")


def grid(stream: DataFrame, event_time: str, value: str, width: str = "30 minutes", by: list[str] | None = None) -> DataFrame:
    """Tumbling windows."""
    return stream.groupBy(F.window(event_time, width).alias("w"), *(by or [])).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *(by or []), "n", "total")


def trailing_at_cutoff(stream: DataFrame, event_time: str, value: str, width: str = "7 days", every: str = "1 day", offset: str = "9 hours", late: str = "1 day") -> DataFrame:
    """I8: stats over (cutoff - width, cutoff]; rows are moved back a microsecond, as windows are closed on the left.

    A stream comes without a watermark and gets one here, on the moved time.
    """
    moved = aware(stream).withColumn("_t", F.col(event_time) - F.expr("INTERVAL 0.000001 SECOND"))
    moved = moved.withWatermark("_t", late) if stream.isStreaming else moved
    out = moved.groupBy(F.window("_t", width, every, offset).alias("w")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("w.end").alias("cutoff"), "n", "mean", "low", "high")


def pane_stats(stream: DataFrame, event_time: str, value: str, every: str = "1 day", offset: str = "9 hours", late: str = "1 day") -> DataFrame:
    """I8: count, sum, least and largest value of each pane of time, closed on the right; a row is in one pane, however wide the bands are."""
    moved = aware(stream).withColumn("_t", F.col(event_time) - F.expr("INTERVAL 0.000001 SECOND"))
    moved = moved.withWatermark("_t", late) if stream.isStreaming else moved
    out = moved.groupBy(F.window("_t", every, every, offset).alias("w")).agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))
    return out.select(F.col("w.end").alias("pane_end"), "n", "total", "low", "high")


def trailing_from_panes(panes: DataFrame, every: str = "1 day", width: int = 7) -> DataFrame:
    """I8: the stats of trailing_at_cutoff from `width` panes each, for every cutoff that has a pane with rows in its band."""
    at = F.col("pane_end") + F.col("_k") * F.expr(f"INTERVAL {every}")
    rows = panes.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))).withColumn("cutoff", at)
    n = F.sum("n")
    return rows.groupBy("cutoff").agg(n.alias("n"), (F.sum("total") / F.nullif(n, F.lit(0).cast("long"))).alias("mean"), F.min("low").alias("low"), F.max("high").alias("high"))


def last_seen(stream: DataFrame, event_time: str, source: str) -> DataFrame:
    """Newest event time per source, for output mode `update` or `complete`."""
    return stream.groupBy(source).agg(F.max(event_time).alias("last_seen"))


def run_available(stream: DataFrame, checkpoint: str, sink=None, name: str | None = None, mode: str = "append"):
    """Runs a stream over all that is there and stops."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", os.path.join(checkpoint)).trigger(availableNow=True)
    q = (w.foreachBatch(sink) if sink else w.format("memory").queryName(name)).start()
    q.awaitTermination()
    return q
