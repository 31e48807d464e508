"""Access at unusual times, judged by fixed hours and by each user's own habits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.operators.runs import scan, with_carries
from logvigil.operators.skew import attach
from logvigil.schema import EVIDENCE_STRUCT, ROW_ORDER, shape_alerts

DETECTOR, DETECTOR_ORD = "temporal_anomaly", 4

# Hours with most automated attacks.
HIGH_RISK_HOURS = [0, 1, 2, 3, 4, 5, 23]


@dataclass(frozen=True)
class TemporalConfig:
    day_start: int = 6
    day_end: int = 22
    weekend_share: float = 0.1
    hour_share: float = 0.02
    min_events: int = 20


# SQL texts over an entry row.
HOUR = "hour(ts_local)"
WEEKEND = "weekday(ts_local) >= 5"
HIGH_RISK = f"{HOUR} IN ({', '.join(map(str, HIGH_RISK_HOURS))})"
HAS_USER = "coalesce(`user` <> '', false)"


def off_hours(config: TemporalConfig = TemporalConfig()) -> str:
    return f"({HOUR} < {config.day_start} OR {HOUR} > {config.day_end})"


def _per_hour() -> list:
    # CASE rather than count_if: the latter hides from Spark that two uses are the same aggregation.
    return [F.expr(f"count(CASE WHEN {HOUR} = {h} THEN 1 END) AS h{h}") for h in range(24)]


def user_baselines(entries: DataFrame, config: TemporalConfig = TemporalConfig()) -> DataFrame:
    """Per user: events, weekend events, and which hours of the day are unusual (as bits)."""
    counts = (
        entries.where(HAS_USER)
        .groupBy("user")
        .agg(F.expr("count(*) AS events"), F.expr(f"count(CASE WHEN {WEEKEND} THEN 1 END) AS weekend_events"), *_per_hour())
    )
    enough = f"events >= {config.min_events}"
    rare = " + ".join(f"if(h{h} / events < {config.hour_share}D, {1 << h}, 0)" for h in range(24))
    return counts.selectExpr(
        "`user`",
        "events",
        "weekend_events",
        f"if({enough}, {rare}, 0) AS rare_hours",
        f"{enough} AND weekend_events / events < {config.weekend_share}D AS rare_weekend",
    )


def anomaly_alerts(rows: DataFrame, config: TemporalConfig, rare_hour: str, rare_weekend: str) -> DataFrame:
    """Turn rows with their two habit flags (SQL texts) into alerts; rows without a finding drop out."""
    # The texts of findings and advice.
    findings = f"""array_compact(array(
      CASE WHEN {off_hours(config)} THEN concat('Access outside business hours (', {HOUR}, ':00)') END,
      CASE WHEN {HIGH_RISK} THEN concat('Access during high-risk hour (', {HOUR}, ':00 UTC)') END,
      CASE WHEN {rare_hour} THEN concat('Unusual hour for user ', `user`) END,
      CASE WHEN {rare_weekend} THEN concat('Weekend access unusual for user ', `user`) END))"""
    alerts = (
        rows.where(f"{off_hours(config)} OR {HIGH_RISK} OR {rare_hour} OR {rare_weekend}")
        .selectExpr("*", f"{findings} AS _findings")
        .selectExpr(
            "ts", "ts_local", "tz_offset", "source_ip", "file_path", "line_seq",
            "'temporal_anomaly' AS threat_type",
            f"if({rare_hour} OR {rare_weekend}, 3, 2) AS level_value",
            "coalesce(nullif(`user`, ''), resource) AS target",
            "concat('Temporal anomaly detected: ', array_join(_findings, '; ')) AS description",
            f"array({EVIDENCE_STRUCT}) AS evidence",
            "array('T1078') AS mitre_attack",
            "array('Verify the access was authorized', 'Check for signs of account compromise', "
            "'Review recent activity for this user', 'Consider implementing time-based access controls') "
            "AS recommendations",
            f"to_json(named_struct('anomalies', _findings, 'access_hour', {HOUR}, 'is_weekend', {WEEKEND}, "
            "'user', `user`)) AS metadata",
        )
    )
    return shape_alerts(alerts, detector=DETECTOR, detector_ord=DETECTOR_ORD)


def _anonymous_alerts(entries: DataFrame, config: TemporalConfig) -> DataFrame:
    return anomaly_alerts(entries.where(f"NOT {HAS_USER}"), config, "false", "false")


def temporal_alerts(entries: DataFrame, config: TemporalConfig = TemporalConfig()) -> DataFrame:
    """One alert per row at an unusual time.

    Rows without a user depend on the clock only and never leave their partition; rows with
    one look up the user's habits.
    """
    timed = entries.where("ts_local IS NOT NULL")
    known = attach(timed.where(HAS_USER), user_baselines(timed, config), ["user"], "events", ROW_ORDER)
    of_users = anomaly_alerts(
        known, config, f"getbit(rare_hours, {HOUR}) = 1", f"({WEEKEND} AND rare_weekend)"
    )
    return _anonymous_alerts(timed, config).unionByName(of_users)


def running_baselines(entries: DataFrame, config: TemporalConfig = TemporalConfig()) -> DataFrame:
    """Per row with a user: the user's counts up to and including this row (the online view).

    A busy user's history is cut into runs, also inside a day; a run begins with the counts of the runs before it.
    """
    rows = entries.where(f"{HAS_USER} AND ts IS NOT NULL")
    order = f"ORDER BY {', '.join(ROW_ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

    def counted(part: DataFrame, partition: str) -> DataFrame:
        along = f"OVER (PARTITION BY {partition} {order})"
        return part.selectExpr(
            "*",
            f"count(*) {along} AS events",
            f"count_if({WEEKEND}) {along} AS weekend_events",
            f"count(*) OVER (PARTITION BY {partition}, {HOUR} {order}) AS hour_events",
        )

    def of_runs(runs: DataFrame, partition: str) -> DataFrame:
        sums = runs.groupBy("user", "_run").agg(F.expr("count(*) AS n"), F.expr(f"count_if({WEEKEND}) AS weekend"), *_per_hour())
        before = "OVER (PARTITION BY `user` ORDER BY _run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        carries = sums.selectExpr(
            "`user`", "_run",
            f"coalesce(sum(n) {before}, 0) AS _n",
            f"coalesce(sum(weekend) {before}, 0) AS _weekend",
            "array(" + ", ".join(f"coalesce(sum(h{h}) {before}, 0)" for h in range(24)) + ") AS _hours",
        )
        return with_carries(counted(runs, partition), ["user"], carries).selectExpr(
            *[f"`{c}`" for c in entries.columns],
            "_n + events AS events",
            "_weekend + weekend_events AS weekend_events",
            f"_hours[{HOUR}] + hour_events AS hour_events",
        )

    return scan(rows, ["user"], ROW_ORDER, "running", counted, of_runs)


def online_flags(config: TemporalConfig) -> tuple[str, str]:
    """Rare hour and rare weekend from running counts, as SQL texts."""
    enough = f"events >= {config.min_events}"
    return (
        f"({enough} AND hour_events / events < {config.hour_share}D)",
        f"({enough} AND {WEEKEND} AND weekend_events / events < {config.weekend_share}D)",
    )


def online_temporal_alerts(entries: DataFrame, config: TemporalConfig = TemporalConfig()) -> DataFrame:
    """What the one-record-at-a-time form reports when rows arrive in time order."""
    timed = entries.where("ts_local IS NOT NULL")
    known = anomaly_alerts(running_baselines(timed, config), config, *online_flags(config))
    return _anonymous_alerts(timed, config).unionByName(known)
