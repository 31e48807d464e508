"""Correlating, de-duplicating and ranking alerts of all detectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logvigil.operators.skew import attach
from logvigil.schema import replace_columns

# What tells two alerts of a run apart.
ALERT_ROW = ["detector_ord", "threat_type", "ts", "file_path", "line_seq", "target", "alert_id"]


def alert_order() -> list[Column]:
    """The order alerts are found in: detector, then time, then place in the input."""
    return [F.col(c).asc_nulls_first() for c in ("detector_ord", "ts", "file_path", "line_seq", "source_ip", "target")]


def correlate(alerts: DataFrame) -> DataFrame:
    """Mark alerts of ips with two or more threat types and raise them to HIGH at least."""
    vectors = (
        alerts.where("source_ip NOT IN ('', 'unknown')")
        .groupBy("source_ip")
        .agg(F.expr("count(*) AS _alerts"), F.expr("sort_array(collect_set(threat_type)) AS _vectors"))
    )
    looked_up = attach(alerts, vectors, ["source_ip"], "_alerts", ALERT_ROW)
    multi = "coalesce(size(_vectors) >= 2, false)"
    raised = f"{multi} AND level_value < 4"
    changed = {
        "level_value": f"if({raised}, 4, level_value)",
        "level": f"if({raised}, 'HIGH', level)",
        "description": f"if({raised}, concat(description, ' (Part of multi-vector attack)'), description)",
        "coordinated_attack": multi,
        "attack_vectors": f"if({multi}, _vectors, NULL)",
    }
    return replace_columns(looked_up, alerts.columns, changed)


def deduplicate(alerts: DataFrame) -> DataFrame:
    """Keep the first alert per type, ip, target and wall-clock minute.

    ``row_number() = 1`` is applied on the map side too, so a flood of equal alerts ships one
    row per task.
    """
    minute = F.date_format("ts_local", "yyyy-MM-dd HH:mm")
    key = Window.partitionBy("threat_type", "source_ip", "target", minute)
    return (
        alerts.withColumn("_n", F.row_number().over(key.orderBy(*alert_order())))
        .where(F.col("_n") == 1)
        .drop("_n")
    )


def ranked(alerts: DataFrame) -> DataFrame:
    """Gravest first, then by time, then in the order found."""
    return alerts.orderBy(F.desc("level_value"), F.asc_nulls_first("ts"), *alert_order())
