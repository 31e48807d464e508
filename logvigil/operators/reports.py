"""Report tables over alerts and entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logvigil.operators.correlate import alert_order
from logvigil.schema import LEVEL_VALUES


def _known_ip() -> Column:
    return F.col("source_ip").isNotNull() & (F.col("source_ip") != "")


def min_severity(alerts: DataFrame, level: str = "LOW") -> DataFrame:
    return alerts.where(F.col("level_value") >= LEVEL_VALUES[level.upper()])


def severity_summary(alerts: DataFrame) -> DataFrame:
    """Alerts per level, with a zero row for levels without alerts."""
    counted = alerts.groupBy(F.col("level_value").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    levels = _levels(alerts.sparkSession)
    return levels.join(counted, levels["level_value"] == counted["_v"], "left").select(
        "level", "level_value", F.coalesce("_n", F.lit(0)).cast("bigint").alias("alerts")
    )


def _levels(spark: SparkSession) -> DataFrame:
    """The five levels (a constant of the data model)."""
    return spark.createDataFrame(list(LEVEL_VALUES.items()), "level string, level_value int")


def severity_distribution(alerts: DataFrame) -> DataFrame:
    """Share per level in percent and the length of its bar (two percent per mark)."""
    # The window without a partition runs over the five level rows.
    percent = F.col("alerts") / F.greatest(F.col("total"), F.lit(1)) * 100
    return (
        severity_summary(alerts)
        .withColumn("total", F.sum("alerts").over(Window.partitionBy()))
        .withColumn("percent", percent)
        .withColumn("bar", F.floor(F.col("percent") / 2).cast("int"))
        .drop("total")
    )


def type_summary(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("threat_type").agg(F.count(F.lit(1)).alias("alerts"))


def level_summary(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("level").agg(F.count(F.lit(1)).alias("alerts"))


def top_threats(alerts: DataFrame, limit: int = 10) -> DataFrame:
    return type_summary(alerts).orderBy(F.desc("alerts"), "threat_type").limit(limit)


def attacker_counts(alerts: DataFrame) -> DataFrame:
    return alerts.where(_known_ip()).groupBy("source_ip").agg(F.count(F.lit(1)).alias("alerts"))


def top_attackers(alerts: DataFrame, limit: int = 10) -> DataFrame:
    return attacker_counts(alerts).orderBy(F.desc("alerts"), "source_ip").limit(limit)


def top_alerts(alerts: DataFrame, limit: int = 50) -> DataFrame:
    """The gravest alerts."""
    return alerts.orderBy(F.desc("level_value"), F.asc_nulls_first("ts"), *alert_order()).limit(limit)


def top_alerts_per_level(alerts: DataFrame, limit: int = 15) -> DataFrame:
    """The first alerts of the three upper levels, with the number not shown."""
    upper = alerts.where(F.col("level_value") >= LEVEL_VALUES["MEDIUM"])
    first = Window.partitionBy("level_value").orderBy(F.asc_nulls_first("ts"), *alert_order())
    shown = upper.withColumn("place", F.row_number().over(first)).where(F.col("place") <= limit)
    totals = upper.groupBy("level_value").agg(F.count(F.lit(1)).alias("_all"))
    return (
        shown.join(F.broadcast(totals), "level_value")  # at most three rows
        .withColumn("not_shown", F.greatest(F.col("_all") - limit, F.lit(0)))
        .drop("_all")
    )


def recommendations(alerts: DataFrame, limit: int = 15) -> DataFrame:
    """The first distinct recommendations in sorted order."""
    return (
        alerts.select(F.explode("recommendations").alias("recommendation")).distinct()
        .orderBy("recommendation").limit(limit)
    )


def detector_stats(alerts: DataFrame, detectors: list[str] | None = None) -> DataFrame:
    """Alerts per detector and level (meant for the alerts after correlation, before de-duplication).

    With a list of detectors there is a row for each of them, also for those without alerts.
    """
    counted = alerts.groupBy("detector").agg(
        F.count(F.lit(1)).alias("total_alerts"),
        *[F.count_if(F.col("level") == name).alias(name.lower()) for name in LEVEL_VALUES],
    )
    if detectors is None:
        return counted
    every = alerts.sparkSession.createDataFrame([(name,) for name in detectors], "detector string")
    return every.join(counted, "detector", "left").na.fill(0)


def summary(alerts: DataFrame) -> DataFrame:
    """One row: totals per level, distinct attackers, threat types, and whether any is critical."""
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        *[F.count_if(F.col("level") == name).alias(name.lower()) for name in LEVEL_VALUES],
        F.count_distinct(F.when(_known_ip(), F.col("source_ip"))).alias("unique_attackers"),
        F.array_join(F.sort_array(F.collect_set("threat_type")), ",").alias("attack_types"),
        F.coalesce(F.max("level_value") == LEVEL_VALUES["CRITICAL"], F.lit(False)).alias("has_critical"),
    )


def totals(entries: DataFrame, alerts: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: entries, distinct ips, time range, alerts and distinct attackers."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    rows = entries.select(F.lit(True).alias("_entry"), "source_ip", "ts").unionByName(
        alerts.select(F.lit(False).alias("_entry"), "source_ip", "ts")
    )
    is_entry, ip = F.col("_entry"), F.when(_known_ip(), F.col("source_ip"))
    return rows.agg(
        F.count_if(is_entry).alias("total_entries"),
        distinct(F.when(is_entry, ip)).alias("unique_source_ips"),
        F.min(F.when(is_entry, F.col("ts"))).alias("first_ts"),
        F.max(F.when(is_entry, F.col("ts"))).alias("last_ts"),
        F.count_if(~is_entry).alias("total_alerts"),
        distinct(F.when(~is_entry, ip)).alias("unique_attackers"),
    )
