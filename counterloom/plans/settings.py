"""Host settings: features and mass changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import active_features as _active
from ..functions.text import feature_on, set_setting, update_setting


def hosts_with_feature(settings: DataFrame, feature: str) -> DataFrame:
    """Hosts whose setting of the feature is above 0; ``settings`` has ``host_id, settings``."""
    return settings.where(feature_on(F.col("settings"), feature)).select("host_id")


def active_features(settings: DataFrame, host: int | None = None) -> DataFrame:
    df = settings if host is None else settings.where(F.col("host_id") == host)
    return df.select("host_id", F.explode(_active(F.col("settings"))).alias("feature"))


def change_setting(settings: DataFrame, key: str, value: int, *, create: bool = True) -> DataFrame:
    """Set a key for all hosts; without ``create`` only where it exists."""
    change = set_setting if create else update_setting
    return settings.withColumn("settings", change(F.col("settings"), key, value))
