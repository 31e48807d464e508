"""Streaming queries: the tables arrive as streams of files, the output is compared with the batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logvigil.streaming import online
from workload import oracle as O
from workload.adapters import auth_entries, geo_table, table_stream, web_entries
from workload.queries import AUTH, ONLINE_BRUTE_FORCE, ONLINE_TEMPORAL, SPAN, alert_table, register


@register("stream_brute_force", ONLINE_BRUTE_FORCE)
def stream_brute_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = online.stream_brute_force(auth_entries(spark, sf_dir, table_stream), AUTH)
    return alert_table(online.drain(stream, "stream-brute-force"), "line_seq", SPAN)


@register("stream_temporal", ONLINE_TEMPORAL)
def stream_temporal(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = online.stream_temporal(auth_entries(spark, sf_dir, table_stream))
    return alert_table(online.drain(stream, "stream-temporal"))


@register("stream_geo", O.over(O.AUTH_E, O.GEO_ALERTS, f"SELECT {O.ALERT_TABLE} FROM place_alerts"))
def stream_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = online.stream_geo(auth_entries(spark, sf_dir, table_stream), geo_table(spark, sf_dir))
    return alert_table(online.drain(stream, "stream-geo"))


@register(
    "stream_web",
    O.over(
        O.WEB_E, f"{O.SQLI_ALERTS},{O.XSS_ALERTS},{O.TRAVERSAL_ALERTS}",
        " UNION ALL ".join(f"SELECT {O.ALERT_TABLE}, line_seq FROM {t}" for t in ("sqli_hits", "xss", "path_hits")),
    ),
)
def stream_web(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = online.stream_web_alerts(web_entries(spark, sf_dir, table_stream))
    return alert_table(online.drain(stream, "stream-web"), "line_seq")
