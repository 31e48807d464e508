"""The whole analysis: detectors, correlation, de-duplication, ranking and report tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvigil.operators import reports
from logvigil.operators.auth import AuthConfig, auth_alerts
from logvigil.operators.correlate import correlate, deduplicate, ranked
from logvigil.operators.geo import GeoConfig, geo_alerts
from logvigil.operators.temporal import TemporalConfig, temporal_alerts
from logvigil.operators.web import sql_injection_alerts, traversal_alerts, web_matches, xss_alerts
from logvigil.schema import ALERT_TYPES, ddl
from logvigil.session import stage
from logvigil.sources.ingest import Parsed, parse_logs

BUILT_IN = ("brute_force", "sql_injection", "xss", "directory_traversal", "temporal_anomaly", "geo_anomaly")

# Matcher of each web detector.
WEB_KINDS = {"sqli": "sql_injection", "xss": "xss", "path": "directory_traversal"}

Detector = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Settings:
    """Which detectors run and with which thresholds."""

    detectors: tuple[str, ...] | None = None  # None: all
    auth: AuthConfig = field(default_factory=AuthConfig)
    temporal: TemporalConfig = field(default_factory=TemporalConfig)
    geo: GeoConfig = field(default_factory=GeoConfig)
    sqli_campaign: int = 3
    traversal_repeats: int = 5
    custom: dict[str, Detector] = field(default_factory=dict)

    def register_detector(self, name: str, detector: Detector) -> Settings:
        """A copy with one more detector: a function from entries to (some) alert columns."""
        return replace(self, custom={**self.custom, name: detector})

    def enable(self, *names: str) -> Settings:
        return replace(self, detectors=names)


def conform_alerts(df: DataFrame, name: str, order: int) -> DataFrame:
    """Bring a custom detector's result to the alert layout."""
    from logvigil.schema import LEVEL_VALUES, shape_alerts

    have = set(df.columns)
    if "level_value" not in have and "level" in have:
        value = F.create_map(*[F.lit(x) for kv in LEVEL_VALUES.items() for x in kv])
        df = df.withColumn("level_value", F.element_at(value, F.upper("level")))
    if "evidence" not in have:
        df = df.withColumn("evidence", F.lit(None).cast(ALERT_TYPES["evidence"]))
    if "ts_local" not in have:
        df = df.withColumn("ts_local", F.col("ts").cast("timestamp_ntz"))
    for column in ("tz_offset", "target", "source_ip"):
        if column not in have:
            df = df.withColumn(column, F.lit(None).cast("string"))
    return shape_alerts(df, detector=name, detector_ord=order)


def detect(entries: DataFrame, settings: Settings = Settings(), geo: DataFrame | None = None) -> DataFrame:
    """Alerts of all enabled detectors, before correlation."""
    names = (*BUILT_IN, *settings.custom)
    wanted = settings.detectors if settings.detectors is not None else names
    unknown = set(wanted) - set(names)
    if unknown:
        raise ValueError(f"unknown detectors: {sorted(unknown)}")
    kinds = tuple(kind for kind, name in WEB_KINDS.items() if name in wanted)
    matches = stage(web_matches(entries, kinds), "web-matches") if kinds else None
    jobs: dict[str, Callable[[], DataFrame]] = {
        "brute_force": lambda: auth_alerts(entries, settings.auth),
        "sql_injection": lambda: sql_injection_alerts(entries, settings.sqli_campaign, matches=matches),
        "xss": lambda: xss_alerts(entries, matches=matches),
        "directory_traversal": lambda: traversal_alerts(entries, settings.traversal_repeats, matches=matches),
        "temporal_anomaly": lambda: temporal_alerts(entries, settings.temporal),
    }
    if geo is not None:
        jobs["geo_anomaly"] = lambda: geo_alerts(entries, geo, settings.geo)
    for place, (name, detector) in enumerate(settings.custom.items()):
        jobs[name] = lambda name=name, detector=detector, place=place: conform_alerts(
            detector(entries), name, len(BUILT_IN) + place
        )
    parts = [job() for name, job in jobs.items() if name in wanted]
    if not parts:
        return entries.sparkSession.createDataFrame([], ddl(ALERT_TYPES))
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class Analysis:
    """The tables of one run. ``correlated`` and ``alerts`` read a staged copy, not the logs."""

    entries: DataFrame
    found: DataFrame
    correlated: DataFrame
    alerts: DataFrame
    detectors: tuple[str, ...] = ()

    def ranked(self) -> DataFrame:
        return ranked(self.alerts)

    def at_least(self, level: str = "LOW") -> DataFrame:
        return reports.min_severity(self.alerts, level)

    def totals(self, approximate: bool = False) -> DataFrame:
        return reports.totals(self.entries, self.alerts, approximate)

    def summary(self) -> DataFrame:
        return reports.summary(self.alerts)

    def detector_stats(self) -> DataFrame:
        """Alerts per enabled detector before de-duplication, with the entries every detector saw."""
        counted = reports.detector_stats(self.correlated, list(self.detectors) or None)
        seen = self.entries.agg(F.count(F.lit(1)).alias("n"))
        return counted.withColumn("entries_analyzed", seen.scalar())


def analyze(
    entries: DataFrame,
    settings: Settings = Settings(),
    geo: DataFrame | None = None,
    staged: bool = True,
) -> Analysis:
    """Run the detectors, then correlate and de-duplicate their alerts.

    The alerts are a small part of the logs. They are staged once, so correlation and every
    report read them instead of running the detectors again.
    """
    found = detect(entries, settings, geo)
    if staged:
        found = stage(found, "alerts")
    correlated = correlate(found)
    names = settings.detectors if settings.detectors is not None else (*BUILT_IN, *settings.custom)
    return Analysis(entries, found, correlated, deduplicate(correlated), tuple(names))


def analyze_logs(
    spark: SparkSession,
    paths: str | list[str],
    settings: Settings = Settings(),
    geo: DataFrame | None = None,
    **parsing,
) -> tuple[Analysis, Parsed]:
    """From files to alerts. The files are scanned and parsed once, and staged by ``parse_logs``, to which ``parsing`` goes."""
    parsed = parse_logs(spark, paths, **parsing)
    return analyze(parsed.entries, settings, geo), parsed
