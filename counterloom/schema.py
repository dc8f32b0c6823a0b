"""Descriptors of the sample tables: which column is time, key, counter or gauge."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import types as T


class Reset(Enum):
    """What a delta becomes when a counter is lower than its previous sample."""

    DROP_NOT_POSITIVE = "P1"  # keep rows with delta > 0
    DROP_NEGATIVE = "P2"  # keep rows with delta >= 0
    RAW = "P3"  # keep negatives; first delta is 0
    CLAMP_ZERO = "P4"  # max(delta, 0)
    RESTART = "P5"  # the current value when the delta is negative
    WINDOW_RANGE = "P6"  # max - min over the window (an aggregate)
    ZERO_IF_LOWER = "P7"  # 0 when lower than the previous sample


@dataclass(frozen=True)
class Metric:
    name: str
    ts: str
    host: str
    keys: tuple[str, ...]
    counters: tuple[str, ...] = ()
    gauges: tuple[str, ...] = ()
    labels: tuple[tuple[str, T.DataType], ...] = ()

    @property
    def series(self) -> tuple[str, ...]:
        """Columns that identify one counter series."""
        return (self.host, *self.keys)

    def struct(self) -> T.StructType:
        fields = [T.StructField(self.ts, T.TimestampType()), T.StructField(self.host, T.IntegerType())]
        fields += [T.StructField(k, T.LongType()) for k in self.keys if k not in dict(self.labels)]
        fields += [T.StructField(n, t) for n, t in self.labels]
        fields += [T.StructField(c, T.LongType()) for c in (*self.counters, *self.gauges)]
        return T.StructType(fields)


METRICS = {
    m.name: m
    for m in (
        Metric("sproc_performance_data", "sp_timestamp", "sp_host_id", ("sp_sproc_id",),
               ("sp_calls", "sp_total_time", "sp_self_time")),
        Metric("table_size_data", "tsd_timestamp", "tsd_host_id", ("tsd_table_id",),
               ("tsd_seq_scans", "tsd_index_scans", "tsd_tup_ins", "tsd_tup_upd", "tsd_tup_del", "tsd_tup_hot_upd"),
               ("tsd_table_size", "tsd_index_size")),
        Metric("table_io_data", "tio_timestamp", "tio_host_id", ("tio_table_id",),
               ("tio_heap_read", "tio_heap_hit", "tio_idx_read", "tio_idx_hit")),
        Metric("index_usage_data", "iud_timestamp", "iud_host_id", ("iud_index_id",),
               ("iud_scan", "iud_tup_read", "iud_tup_fetch"), ("iud_size",)),
        Metric("schema_usage_data", "sud_timestamp", "sud_host_id", ("sud_schema_name",),
               ("sud_sproc_calls", "sud_seq_scans", "sud_idx_scans", "sud_tup_ins", "sud_tup_upd", "sud_tup_del"),
               labels=(("sud_schema_name", T.StringType()),)),
        Metric("stat_statements_data", "ssd_timestamp", "ssd_host_id", ("ssd_query_id",),
               ("ssd_calls", "ssd_total_time", "ssd_blks_read", "ssd_blks_written", "ssd_temp_blks_read",
                "ssd_temp_blks_written"), labels=(("ssd_query", T.StringType()),)),
        Metric("stat_database_data", "sdd_timestamp", "sdd_host_id", (),
               ("sdd_xact_commit", "sdd_xact_rollback", "sdd_blks_read", "sdd_blks_hit", "sdd_temp_files",
                "sdd_temp_bytes", "sdd_deadlocks", "sdd_blk_read_time", "sdd_blk_write_time"), ("sdd_numbackends",)),
        Metric("stat_bgwriter_data", "sbd_timestamp", "sbd_host_id", (),
               ("sbd_checkpoints_timed", "sbd_checkpoints_req", "sbd_buffers_checkpoint", "sbd_buffers_clean",
                "sbd_buffers_backend", "sbd_buffers_alloc")),
        Metric("host_load", "load_timestamp", "load_host_id", (), ("xlog_location_mb",),
               ("load_1min_value", "load_5min_value", "load_15min_value")),
        Metric("blocking_locks", "bl_timestamp", "bl_host_id", ("pid",)),
        Metric("blocking_processes", "bp_timestamp", "bp_host_id", ("pid",)),
    )
}
