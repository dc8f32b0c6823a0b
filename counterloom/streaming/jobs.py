"""Incremental jobs as Structured Streaming queries.

Jobs with state per series or host keep it in Spark's state store (:mod:`counterloom.streaming.state`); the samples of one series in one
micro-batch are handled by one task, and ``files_per_trigger`` bounds these. Results equal the batch result on the same samples.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.series import PREV, deltas
from ..plans.locks import persistent_waits, prune_locks
from ..plans.summaries import hourly_peaks, store_hourly_peaks
from ..schema import METRICS, Metric, Reset
from ..sources.fleet import Fleet
from ..sources.versions import VersionedTable, read_if_there
from .state import LastSample, Predecessor, use_rocksdb, write_batch


def read_samples(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of sample files, oldest first; ``files_per_trigger`` bounds one batch."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _start(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    writer = df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).outputMode(mode)
    return writer.trigger(availableNow=True).start()


# --- series state ----------------------------------------------------------------------------


def _milliseconds(spark: SparkSession, interval: str) -> int:
    seconds = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"interval {interval}")) / 1000
    return int(spark.range(1).select(seconds.cast("long")).first()[0])


def with_last_sample(source: DataFrame, m: Metric, cols: Sequence[str], ttl: str | None = None) -> DataFrame:
    """A stream of samples with ``prev_<ts>`` and ``prev_<col>`` of the series' last one, across micro-batches.

    ``ttl`` is how long a series may be silent; the state of longer silent ones is dropped as the watermark moves on.
    """
    spark = source.sparkSession
    use_rocksdb(spark)
    schema = source.schema
    kept = T.StructType([T.StructField(c, schema[c].dataType) for c in (m.ts, *cols)])
    out = T.StructType([*schema.fields, *(T.StructField(PREV + c, schema[c].dataType) for c in (m.ts, *cols))])
    ms = None if ttl is None else _milliseconds(spark, ttl)
    marked = source if ttl is None else source.withWatermark(m.ts, ttl)
    return marked.groupBy(*m.series).transformWithStateInPandas(LastSample(m.ts, cols, kept, ms), out, "Append", "None" if ttl is None else "EventTime")


def stream_delta(
    source: DataFrame, metric: str, cols: Sequence[str], policy: Reset, out: str, work: str, *, ttl: str | None = None
) -> StreamingQuery:
    """Counter deltas across micro-batches, written to ``out``."""
    m = METRICS[metric]
    return append_to(deltas(with_last_sample(source, m, cols, ttl), m.ts, list(cols), policy), out, f"{work}/checkpoint")


def stream_changed_only(source: DataFrame, metric: str, cols: Sequence[str], out: str, work: str) -> StreamingQuery:
    """Store a sample only if it differs from the last one of its series."""
    m = METRICS[metric]
    differs = F.col(PREV + m.ts).isNull()
    for c in cols:
        differs = differs | ~F.col(c).eqNullSafe(F.col(PREV + c))
    return append_to(with_last_sample(source, m, cols).where(differs).select(*source.columns), out, f"{work}/checkpoint")


# --- windows and watermarks -----------------------------------------------------------------


def tumbling(source: DataFrame, ts: str, width: str, delay: str, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """Aggregates per tumbling window; rows later than ``delay`` are dropped with closed windows."""
    per = source.withWatermark(ts, delay).groupBy(F.window(ts, width), *keys).agg(*aggs)
    return per.select(F.col("window.start").alias("bucket"), *(c for c in per.columns if c != "window"))


def append_to(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    return (
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def stream_sproc_load(deltas: DataFrame, out: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Self time per host and 15 minutes from a stream of deltas; a bucket is written once it is
    ``delay`` old, so the last hour is never touched."""
    per = tumbling(deltas, "sp_timestamp", "15 minutes", delay, [F.col("sp_host_id").alias("host_id")],
                   [F.sum("d_sp_self_time").alias("self_ms")])
    return append_to(per, out, checkpoint)


def stream_db_size(source: DataFrame, out: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Size and row-change totals per snapshot, written once the snapshot is ``delay`` old."""
    per = source.withWatermark("tsd_timestamp", delay).groupBy(
        F.col("tsd_timestamp").alias("ts"), F.col("tsd_host_id").alias("host_id")
    ).agg(
        (F.sum("tsd_table_size") + F.sum("tsd_index_size")).alias("size"), F.sum("tsd_tup_ins").alias("s_ins"),
        F.sum("tsd_tup_upd").alias("s_upd"), F.sum("tsd_tup_del").alias("s_del"),
    )
    return append_to(per, out, checkpoint)


def stream_summary(source: DataFrame, fleet: Fleet, table: VersionedTable, work: str, as_of=None) -> StreamingQuery:
    """Keep the stored hourly procedure summary up to date from a stream of samples.

    Each batch raises the counter peaks of the hours it has samples of and replaces all provisional hours of the summary; hours that are over
    at ``as_of``, by default at the newest sample of the batch, become final. Samples of final hours are ignored. A repeated batch
    raises nothing further.
    """
    peaks = VersionedTable(source.sparkSession, f"{work}/peaks")
    names = ["sp_sproc_id", "hour", "c", "t"]

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        closed = table.head()[1]
        new = hourly_peaks(batch).select(*names)
        keyed = {"day": F.to_date("hour"), "of_day": F.hour("hour")}
        stored = peaks.periods(T.StructType([*new.schema.fields, T.StructField("day", T.DateType()), T.StructField("of_day", T.IntegerType())]))
        if closed is not None:
            new, stored = new.where(F.col("hour") >= F.lit(closed)), stored.where((F.col("day") >= F.to_date(F.lit(closed))) & (F.col("hour") >= F.lit(closed)))
        new = new.withColumns(keyed)
        same = stored.join(new.select("day", "of_day").distinct(), ["day", "of_day"], "left_semi").select(new.columns)
        raised = new.unionByName(same).groupBy("sp_sproc_id", "hour", "day", "of_day").agg(F.max("c").alias("c"), F.max("t").alias("t"))
        peaks.replace(raised, "day", "of_day")
        at = batch.agg(F.max("sp_timestamp")).first()[0] if as_of is None else as_of
        open_ = peaks.periods()
        if closed is not None:
            open_ = open_.where(F.col("day") >= F.to_date(F.lit(closed)))
        store_hourly_peaks(fleet, table, open_.select(*names), at)

    return _start(source, run, f"{work}/checkpoint")


def stream_export(
    source: DataFrame, to_points: Callable[[DataFrame], DataFrame], ts: str, out: str, work: str, *, up_to=None, fmt: str = "json",
) -> StreamingQuery:
    """Points of each batch, written idempotently; samples after ``up_to`` (now minus a safety margin) are held back.

    A later run first writes the held samples that its own ``up_to`` covers, whether or not new files have come.
    """
    spark, held, log = source.sparkSession, f"{work}/held", f"{work}/releases"
    bound = F.lit(up_to).cast("timestamp") if up_to is not None else None
    _release(spark, source.schema, to_points, ts, out, held, log, bound, fmt)

    def run(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*source.columns)
        write_batch(to_points(rows if bound is None else rows.where(F.col(ts) <= bound)), out, batch_id, fmt)
        if bound is not None:
            write_batch(rows.where(F.col(ts) > bound), held, batch_id)

    return _start(source, run, f"{work}/checkpoint")


def _release(spark: SparkSession, schema: T.StructType, to_points, ts: str, out: str, held: str, log: str, bound: Column | None, fmt: str) -> None:
    """Write the held samples up to ``bound`` that no release has written. The log tells for each held batch up to when it was
    released; batches held later have no entry. The output folder is named by the number of the release, so that a run
    that broke off before it was logged is repeated in place."""
    log_schema = "release long, _batch long, up_to timestamp"
    done = read_if_there(spark, log, log_schema)
    number = (done.agg(F.max("release")).first()[0] or 0) + 1
    rows = read_if_there(spark, held, schema).withColumn("_batch", F.regexp_extract(F.input_file_name(), r".*/batch=(\d+)/", 1).cast("long"))
    batches = [r["_batch"] for r in rows.select("_batch").distinct().collect()]
    if not batches:
        return
    left = rows.join(done.groupBy("_batch").agg(F.max("up_to").alias("_up_to")), "_batch", "left").where(F.col("_up_to").isNull() | (F.col(ts) > F.col("_up_to")))
    left = left if bound is None else left.where(F.col(ts) <= bound)
    to_points(left.select(*schema.names)).write.mode("overwrite").format(fmt).save(f"{out}/after={number}")
    end = F.lit("9999-12-31 00:00:00").cast("timestamp") if bound is None else bound
    write_batch(spark.createDataFrame([(number, b) for b in batches], "release long, _batch long").withColumn("up_to", end), log, number)


# --- snapshots ---------------------------------------------------------------------------------


def _snapshot_job(source: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, work: str, keep_last: bool, delay: str) -> StreamingQuery:
    """Run ``transform`` on complete snapshots.

    A host's snapshot is complete ``delay`` after its time, by the newest rows of any host; rows that come until then belong to it, later
    ones are dropped. With ``keep_last`` the host's snapshot before it is there too.
    """
    use_rocksdb(source.sparkSession)
    names, at = source.columns, ["bl_host_id", "bl_timestamp"]
    closed = source.withWatermark("bl_timestamp", delay).groupBy(*at).agg(F.collect_list(F.struct(*names)).alias("rows"))
    if keep_last:
        schema = T.StructType([*closed.schema.fields, T.StructField("_done", T.BooleanType())])
        closed = closed.groupBy("bl_host_id").transformWithStateInPandas(Predecessor("bl_timestamp"), schema, "Append", "None")

    def run(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.select(F.inline("rows"), *(["_done"] if keep_last else [])), f"{work}/closed", batch_id)  # state is read once, whatever the transformation reads
        batch = batch.sparkSession.read.parquet(f"{work}/closed/batch={batch_id}")
        result = transform(batch.select(*names))
        if keep_last:
            todo = batch.where("not _done").select(*at).distinct()
            result = result.join(todo, at, "left_semi").select(*result.columns)
        write_batch(result, out, batch_id)

    return _start(closed, run, f"{work}/checkpoint")


def stream_prune_locks(source: DataFrame, out: str, work: str, delay: str = "5 minutes") -> StreamingQuery:
    return _snapshot_job(source, prune_locks, out, work, False, delay)


def stream_persistent_waits(source: DataFrame, out: str, work: str, delay: str = "5 minutes") -> StreamingQuery:
    return _snapshot_job(source, persistent_waits, out, work, True, delay)
