"""The registered queries, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvigil.operators import auth, geo, reports, reputation, temporal, web
from logvigil.operators.auth import AuthConfig
from logvigil.plans.analysis import Settings, analyze
from workload import oracle as O
from workload.adapters import WINDOW_MINUTES, all_entries, auth_entries, geo_table, table, web_entries

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

AUTH = AuthConfig(window_minutes=WINDOW_MINUTES)


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


STAMP = "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS ts"


def alert_table(alerts: DataFrame, *more: str) -> DataFrame:
    return alerts.selectExpr(
        "alert_id", STAMP, "threat_type", "level", "source_ip", "target", "description", "evidence_count",
        "array_join(mitre_attack, ',') AS mitre", "array_join(recommendations, '|') AS recommendations", *more,
    )


# -- login attacks ------------------------------------------------------------------------


@register(
    "brute_force",
    O.over(
        O.AUTH_E, f"{O.PAIRS},{O.GUESSING}",
        f"SELECT {O.ALERT_TABLE}, n AS attempts, round(greatest(1.0, (epoch_us(last_ts) - epoch_us(first_ts)) / 6e7), 4) AS span_minutes "
        "FROM guessing JOIN (SELECT source_ip, account AS target, n, first_ts, last_ts FROM pairs) USING (source_ip, target)",
    ),
)
def brute_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = auth.auth_alerts(auth_entries(spark, sf_dir), AUTH, ("brute_force",))
    return alert_table(
        alerts,
        "CAST(get_json_object(metadata, '$.attempt_count') AS BIGINT) AS attempts",
        "round(CAST(get_json_object(metadata, '$.time_span_minutes') AS DOUBLE), 4) AS span_minutes",
    )


@register(
    "credential_stuffing",
    O.over(
        O.AUTH_E, f"{O.PAIRS},{O.STUFFING}",
        f"SELECT {O.ALERT_TABLE}, users FROM stuffing JOIN (SELECT source_ip, array_to_string(list_sort(list(account))[:20], ',') AS users "
        "FROM pairs WHERE named_account GROUP BY source_ip) USING (source_ip)",
    ),
)
def credential_stuffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = auth.auth_alerts(auth_entries(spark, sf_dir), AUTH, ("credential_stuffing",))
    return alert_table(
        alerts, "array_join(from_json(get_json_object(metadata, '$.targeted_users'), 'array<string>'), ',') AS users"
    )


@register(
    "distributed_brute_force",
    O.over(O.AUTH_E, f"{O.PAIRS},{O.DISTRIBUTED}", f"SELECT {O.ALERT_TABLE} FROM distributed"),
)
def distributed_brute_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_table(auth.auth_alerts(auth_entries(spark, sf_dir), AUTH, ("distributed_brute_force",)))


@register(
    "compromised_after_bruteforce",
    O.over(
        O.AUTH_E, O.PAIRS,
        f"SELECT source_ip, account, n AS attempts, strftime(last_ts, {O.STAMP}) AS last_failure, "
        f"strftime(last_success, {O.STAMP}) AS last_success, last_success > last_ts AS success_after "
        "FROM pairs WHERE n >= 5 AND last_success IS NOT NULL",
    ),
)
def compromised_after_bruteforce(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = auth.grouped_attempts(auth.login_outcomes(auth_entries(spark, sf_dir)), AUTH, ("brute_force",))
    return pairs.where("last_success IS NOT NULL").selectExpr(
        "source_ip", "account", "attempts", "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS last_failure",
        "date_format(last_success, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS last_success", "last_success > ts AS success_after",
    )


@register(
    "login_pair_windows",
    O.over(
        O.AUTH_E, O.PAIRS,
        f"SELECT source_ip, account, n AS attempt_count, strftime(first_ts, {O.STAMP}) AS first_ts, "
        f"strftime(last_ts, {O.STAMP}) AS last_ts FROM pairs",
    ),
)
def login_pair_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = auth.pair_windows(auth.login_outcomes(auth_entries(spark, sf_dir)), AUTH)
    return pairs.selectExpr(
        "source_ip", "account", "attempt_count", "date_format(first_ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS first_ts",
        "date_format(last.ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS last_ts",
    )


@register(
    "trailing_failure_count",
    O.over(O.AUTH_E, f"{O.PAIRS},{O.TRAILING}", "SELECT line_seq, source_ip, account, trailing_count FROM trailed"),
)
def trailing_failure_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = auth.trailing_failures(auth_entries(spark, sf_dir), AUTH)
    return counted.select("line_seq", "source_ip", "account", F.col("trailing_count").cast("bigint"))


@register(
    "brute_force_any_window",
    O.over(
        O.AUTH_E, f"{O.PAIRS},{O.TRAILING}",
        "SELECT source_ip, account, max(trailing_count) AS most_attempts FROM trailed GROUP BY ALL HAVING max(trailing_count) >= 5",
    ),
)
def brute_force_any_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auth.any_window(auth_entries(spark, sf_dir), AUTH).withColumn("most_attempts", F.col("most_attempts").cast("bigint"))


ONLINE_BRUTE_FORCE = O.over(
    O.AUTH_E, f"{O.PAIRS},{O.TRAILING}", f"SELECT {O.ALERT_TABLE}, line_seq, span_minutes FROM online"
)
SPAN = "round(CAST(get_json_object(metadata, '$.time_span_minutes') AS DOUBLE), 4) AS span_minutes"


@register("brute_force_online", ONLINE_BRUTE_FORCE)
def brute_force_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_table(auth.online_brute_force(auth_entries(spark, sf_dir), AUTH), "line_seq", SPAN)


# -- web attacks --------------------------------------------------------------------------

_HIT = ("get_json_object(metadata, '$.pattern_matched') AS pattern", "get_json_object(metadata, '$.injection_point') AS place")


@register("sql_injection", O.over(O.WEB_E, O.SQLI_ALERTS, f"SELECT {O.ALERT_TABLE}, pattern, place FROM sqli"))
def sql_injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_table(web.sql_injection_alerts(web_entries(spark, sf_dir)), *_HIT)


@register(
    "sqli_campaign",
    O.over(
        O.WEB_E, O.SQLI_ALERTS,
        "SELECT source_ip, count(*) AS alerts, count(*) FILTER (description LIKE '%sustained attack campaign)') AS raised, "
        "CAST(min(level_value) AS INTEGER) AS lowest FROM sqli GROUP BY source_ip HAVING count(*) >= 3",
    ),
)
def sqli_campaign(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = web.sql_injection_alerts(web_entries(spark, sf_dir))
    return alerts.groupBy("source_ip").agg(
        F.expr("count(*) AS alerts"),
        F.expr("count_if(description LIKE '%sustained attack campaign)') AS raised"),
        F.expr("min(level_value) AS lowest"),
    ).where("alerts >= 3")


@register("xss", O.over(O.WEB_E, O.XSS_ALERTS, f"SELECT {O.ALERT_TABLE}, pattern, place FROM xss"))
def xss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_table(web.xss_alerts(web_entries(spark, sf_dir)), *_HIT)


@register(
    "directory_traversal",
    O.over(O.WEB_E, O.TRAVERSAL_ALERTS, f"SELECT {O.ALERT_TABLE}, place AS decoded_path FROM path"),
)
def directory_traversal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_table(
        web.traversal_alerts(web_entries(spark, sf_dir)), "get_json_object(metadata, '$.decoded_path') AS decoded_path"
    )


# Pages spread over 23 ips, so two requests make a repeat offender here.
@register(
    "traversal_repeat_offender",
    O.over(
        O.WEB_E, O.TRAVERSAL_TWICE,
        "SELECT source_ip, count(*) AS alerts, count(*) FILTER (level_value >= 4) AS grave, "
        "count(*) FILTER (description LIKE '%Multiple traversal attempts from same IP)') AS raised FROM path "
        "GROUP BY source_ip HAVING count(*) >= 2",
    ),
)
def traversal_repeat_offender(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.traversal_alerts(web_entries(spark, sf_dir), repeats=2).groupBy("source_ip").agg(
        F.expr("count(*) AS alerts"),
        F.expr("count_if(level_value >= 4) AS grave"),
        F.expr("count_if(description LIKE '%Multiple traversal attempts from same IP)') AS raised"),
    ).where("alerts >= 2")


@register(
    "url_decode",
    f"SELECT line_seq, {O.sqli_text('resource')} AS sqli_text, {O.xss_text('resource')} AS xss_text, "
    f"{O.path_text('resource')} AS path_text FROM ({O.WEB_E})",
)
def url_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from logvigil.functions import payload

    return web_entries(spark, sf_dir).selectExpr(
        "line_seq", f"{payload.sqli_text('resource')} AS sqli_text", f"{payload.xss_text('resource')} AS xss_text",
        f"{payload.path_text('resource')} AS path_text",
    )


# -- unusual times ------------------------------------------------------------------------


@register("temporal_anomaly", O.over(O.AUTH_E, O.TEMPORAL, f"SELECT {O.ALERT_TABLE} FROM temporal"))
def temporal_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_table(temporal.temporal_alerts(auth_entries(spark, sf_dir)))


@register(
    "temporal_offhours",
    f"SELECT user_name, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS events FROM ({O.AUTH_E}) "
    "WHERE hour(ts) < 6 OR hour(ts) > 22 GROUP BY ALL",
)
def temporal_offhours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auth_entries(spark, sf_dir).where(temporal.off_hours()).groupBy(
        F.expr("`user` AS user_name"), F.expr("hour(ts_local) AS hour")
    ).agg(F.expr("count(*) AS events"))


@register(
    "temporal_baseline",
    f"""WITH h AS (SELECT user_name, hour(ts) AS hour, count(*) AS n FROM ({O.AUTH_E}) WHERE user_name <> '' GROUP BY ALL),
t AS (SELECT user_name, count(*) AS events, count(*) FILTER (isodow(ts) >= 6) AS weekend_events FROM ({O.AUTH_E})
  WHERE user_name <> '' GROUP BY ALL)
SELECT t.user_name, events, weekend_events, events >= 20 AND weekend_events / events < 0.1 AS rare_weekend,
  CAST(CASE WHEN events >= 20 THEN (SELECT sum(CASE WHEN coalesce(n, 0) / events < 0.02 THEN 1 << x ELSE 0 END)
    FROM (SELECT CAST(range AS INTEGER) AS x FROM range(24)) LEFT JOIN h ON h.hour = x AND h.user_name = t.user_name)
    ELSE 0 END AS INTEGER) AS rare_hours FROM t""",
)
def temporal_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.user_baselines(auth_entries(spark, sf_dir)).withColumnRenamed("user", "user_name")


@register(
    "temporal_weekend",
    f"SELECT user_name, round(100.0 * count(*) FILTER (isodow(ts) >= 6) / count(*), 6) AS weekend_percent FROM ({O.AUTH_E}) "
    "WHERE user_name <> '' GROUP BY user_name HAVING count(*) >= 20",
)
def temporal_weekend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.user_baselines(auth_entries(spark, sf_dir)).where("events >= 20").selectExpr(
        "`user` AS user_name", "round(100D * weekend_events / events, 6) AS weekend_percent"
    )


@register(
    "temporal_running",
    O.over(O.AUTH_E, O.RUNNING, "SELECT line_seq, user_name, events, weekend_events, hour_events FROM running"),
)
def temporal_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.running_baselines(auth_entries(spark, sf_dir)).selectExpr(
        "line_seq", "`user` AS user_name", "events", "weekend_events", "hour_events"
    )


ONLINE_TEMPORAL = O.over(
    O.AUTH_E,
    O.RUNNING + "," + O._temporal("online", "running", "hour_events / events < 0.02", "weekend_events / events < 0.1"),
    f"SELECT {O.ALERT_TABLE} FROM online",
)


@register("temporal_online", ONLINE_TEMPORAL)
def temporal_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_table(temporal.online_temporal_alerts(auth_entries(spark, sf_dir)))


# -- unusual places -----------------------------------------------------------------------


def _located(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return auth_entries(spark, sf_dir), geo_table(spark, sf_dir)


@register(
    "geo_enrich",
    O.over(
        O.AUTH_E, O.PLACES,
        "SELECT line_seq, source_ip, country, country_code, city, latitude, longitude, is_vpn, is_tor, is_proxy FROM located",
    ),
)
def geo_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.geo_enrich(*_located(spark, sf_dir)).select(
        "line_seq", "source_ip", "country", "country_code", "city", "latitude", "longitude", "is_vpn", "is_tor", "is_proxy"
    )


@register(
    "geo_travel",
    O.over(
        O.AUTH_E, O.PLACES,
        "SELECT line_seq, user_name, pcity AS from_city, city AS to_city, round(distance_km, 3) AS distance_km, "
        "round(travel_hours, 6) AS travel_hours, impossible_travel FROM places WHERE travel_hours IS NOT NULL",
    ),
)
def geo_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, places = _located(spark, sf_dir)
    return geo.with_travel(geo.geo_enrich(entries, places)).where("travel_hours IS NOT NULL").selectExpr(
        "line_seq", "`user` AS user_name", "previous.city AS from_city", "city AS to_city",
        "round(distance_km, 3) AS distance_km", "round(travel_hours, 6) AS travel_hours",
        "speed_kmh > 1000 AS impossible_travel",
    )


@register(
    "geo_new_country",
    O.over(
        O.AUTH_E, O.PLACES,
        "SELECT user_name, line_seq, CAST(known_countries AS INTEGER) AS known_countries FROM places WHERE new_country",
    ),
)
def geo_new_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.new_country_rows(geo.geo_enrich(*_located(spark, sf_dir))).selectExpr(
        "`user` AS user_name", "line_seq", "known_countries"
    )


@register(
    "geo_highrisk",
    O.over(
        O.AUTH_E, O.PLACES,
        "SELECT country_code, is_tor, is_vpn, count(*) AS events FROM located "
        "WHERE country_code IN ('KP', 'IR', 'RU', 'CN', 'BY') OR is_tor OR is_vpn OR is_proxy GROUP BY ALL",
    ),
)
def geo_highrisk(spark: SparkSession, sf_dir: str) -> DataFrame:
    risky = ", ".join(f"'{c}'" for c in geo.GeoConfig().high_risk_countries)
    return (
        geo.geo_enrich(*_located(spark, sf_dir))
        .where(f"country_code IN ({risky}) OR is_tor OR is_vpn OR is_proxy")
        .groupBy("country_code", "is_tor", "is_vpn")
        .agg(F.expr("count(*) AS events"))
    )


@register("geo_anomaly", O.over(O.AUTH_E, O.GEO_ALERTS, f"SELECT {O.ALERT_TABLE} FROM place_alerts"))
def geo_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_table(geo.geo_alerts(*_located(spark, sf_dir)))


# A range per supplier: sizes /24 to /32 around the ips of both logs.
_RANGES = """SELECT concat('10.', CAST(s_suppkey % 2 AS {string}), '.0.', CAST(s_suppkey % 32 AS {string}), '/',
  CAST(8 + s_suppkey % 25 AS {string})) AS cidr, concat('list', CAST(s_suppkey % 3 AS {string})) AS label FROM {supplier}"""
_NUMBER = (
    "(split_part({0}, '.', 1)::BIGINT * 16777216 + split_part({0}, '.', 2)::BIGINT * 65536 "
    "+ split_part({0}, '.', 3)::BIGINT * 256 + split_part({0}, '.', 4)::BIGINT)"
)


@register(
    "ip_reputation",
    f"""WITH ips AS (SELECT DISTINCT source_ip, {_NUMBER.format('source_ip')} AS n FROM ({O.ALL_E})),
nets AS (SELECT cidr, label, CAST(pow(2, 32 - split_part(cidr, '/', 2)::INT) AS BIGINT) AS size,
  {_NUMBER.format("split_part(cidr, '/', 1)")} AS base
  FROM (SELECT DISTINCT * FROM ({_RANGES.format(string='VARCHAR', supplier='supplier')})))
SELECT source_ip, cidr, label FROM ips JOIN nets ON n >= base - base % size AND n < base - base % size + size""",
)
def ip_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.sql(_RANGES.format(string="STRING", supplier="{t}"), t=table(spark, sf_dir, "supplier")).distinct()
    return reputation.ip_reputation(all_entries(spark, sf_dir), ranges)


# IPv6: addresses and ranges whose groups come from the tables' keys; a prefix covers whole groups.
_V6 = """SELECT concat('2001:db8:', {hex_a}, ':', {hex_b}, CASE WHEN {key} % 2 = 0 THEN '::' ELSE ':0:0:0:' END, {hex_key}) AS ip,
  {key} % 48 AS a, {key} % 4 AS b, {key} AS k{more} FROM {source}"""


def _v6(hexed: str, key: str, source: str, more: str = "") -> str:
    return _V6.format(
        hex_a=hexed.format(f"{key} % 48"), hex_b=hexed.format(f"{key} % 4"), hex_key=hexed.format(f"{key} % 60000"), key=key, source=source,
        more=more,
    )


_BITS = ", 16 * (1 + {0} % 8) AS prefix, concat('list', CAST({0} % 3 AS {1})) AS label"


@register(
    "ip_reputation_v6",
    f"""WITH ips AS ({_v6("format('{{{{:x}}}}', {})", "c_custkey", "customer")}),
nets AS ({_v6("format('{{{{:x}}}}', {})", "s_suppkey", "supplier", _BITS.format("s_suppkey", "VARCHAR"))}),
found AS (SELECT DISTINCT ips.ip AS source_ip, nets.ip || '/' || prefix AS cidr, label, prefix FROM ips JOIN nets
  ON (prefix < 48 OR ips.a = nets.a) AND (prefix < 64 OR ips.b = nets.b) AND (prefix < 128 OR ips.k % 60000 = nets.k % 60000))
SELECT source_ip, cidr, label FROM found QUALIFY prefix = max(prefix) OVER (PARTITION BY source_ip)""".replace("{{:x}}", "{:x}"),
)
def ip_reputation_v6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranges with the longest prefix for every address."""
    ips = spark.sql(_v6("lower(hex({}))", "c_custkey", "{t}"), t=table(spark, sf_dir, "customer"))
    nets = spark.sql(
        _v6("lower(hex({}))", "s_suppkey", "{t}", _BITS.format("s_suppkey", "STRING")), t=table(spark, sf_dir, "supplier")
    )
    ranges = nets.selectExpr("concat(ip, '/', CAST(prefix AS STRING)) AS cidr", "label")
    return reputation.ip_reputation(ips.selectExpr("ip AS source_ip"), ranges, longest=True)


# -- the whole analysis -------------------------------------------------------------------

EVERY = list(O.PARTS)


def _analysis(spark: SparkSession, sf_dir: str):
    return analyze(all_entries(spark, sf_dir), Settings(detectors=tuple(EVERY), auth=AUTH), geo_table(spark, sf_dir))


_MORE = ", coordinated_attack, attack_vectors"
_MORE_SPARK = ("coordinated_attack", "array_join(attack_vectors, ',') AS attack_vectors")


@register("analysis", O.with_alerts(O.ALL_E, EVERY, f"SELECT {O.ALERT_TABLE}{_MORE} FROM alerts"))
def analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_table(_analysis(spark, sf_dir).ranked(), *_MORE_SPARK)


@register("correlated_alerts", O.with_alerts(O.ALL_E, EVERY, f"SELECT {O.ALERT_TABLE}{_MORE} FROM correlated"))
def correlated_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_table(_analysis(spark, sf_dir).correlated, *_MORE_SPARK)


@register("dedup_alerts", O.with_alerts(O.ALL_E, EVERY, f"SELECT {O.ALERT_TABLE}{_MORE} FROM alerts"))
def dedup_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_table(_analysis(spark, sf_dir).alerts, *_MORE_SPARK)


@register(
    "min_severity",
    O.with_alerts(O.ALL_E, EVERY, "SELECT threat_type, source_ip, count(*) AS alerts FROM alerts WHERE level_value >= 5 GROUP BY ALL"),
)
def min_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).at_least("CRITICAL").groupBy("threat_type", "source_ip").agg(F.expr("count(*) AS alerts"))


# -- report tables ------------------------------------------------------------------------

_LEVELS = "(VALUES ('CRITICAL', 5), ('HIGH', 4), ('MEDIUM', 3), ('LOW', 2), ('INFO', 1)) AS l(level, level_value)"
_SUMMARY = f"""SELECT l.level, CAST(l.level_value AS INTEGER) AS level_value,
  (SELECT count(*) FROM alerts WHERE alerts.level_value = l.level_value) AS alerts FROM {_LEVELS}"""


@register("severity_summary", O.with_alerts(O.ALL_E, EVERY, _SUMMARY))
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.severity_summary(_analysis(spark, sf_dir).alerts)


@register(
    "severity_distribution",
    O.with_alerts(
        O.ALL_E, EVERY,
        f"SELECT level, level_value, alerts, round(alerts / greatest(sum(alerts) OVER (), 1) * 100, 6) AS percent, "
        f"CAST(floor(alerts / greatest(sum(alerts) OVER (), 1) * 100 / 2) AS INTEGER) AS bar FROM ({_SUMMARY})",
    ),
)
def severity_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.severity_distribution(_analysis(spark, sf_dir).alerts).withColumn("percent", F.round("percent", 6))


@register("type_summary", O.with_alerts(O.ALL_E, EVERY, "SELECT threat_type, count(*) AS alerts FROM alerts GROUP BY ALL"))
def type_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.type_summary(_analysis(spark, sf_dir).alerts)


@register("level_summary", O.with_alerts(O.ALL_E, EVERY, f"SELECT {O.LEVEL} AS level, count(*) AS alerts FROM alerts GROUP BY ALL"))
def level_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.level_summary(_analysis(spark, sf_dir).alerts)


@register(
    "top_threats",
    O.with_alerts(
        O.ALL_E, EVERY,
        "SELECT threat_type, count(*) AS alerts FROM alerts GROUP BY ALL ORDER BY alerts DESC, threat_type LIMIT 10",
    ),
)
def top_threats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_threats(_analysis(spark, sf_dir).alerts)


@register(
    "top_attackers",
    O.with_alerts(
        O.ALL_E, EVERY,
        "SELECT source_ip, count(*) AS alerts FROM alerts WHERE source_ip <> '' GROUP BY ALL ORDER BY alerts DESC, source_ip LIMIT 10",
    ),
)
def top_attackers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_attackers(_analysis(spark, sf_dir).alerts)


@register(
    "top_alerts",
    O.with_alerts(O.ALL_E, EVERY, f"SELECT {O.ALERT_TABLE} FROM (SELECT * FROM alerts ORDER BY level_value DESC, ts, {O.ORDER} LIMIT 50)"),
)
def top_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_table(reports.top_alerts(_analysis(spark, sf_dir).alerts))


@register(
    "top_alerts_per_level",
    O.with_alerts(
        O.ALL_E, EVERY,
        f"""SELECT {O.ALERT_TABLE}, CAST(place AS INTEGER) AS place, not_shown FROM (SELECT *,
  row_number() OVER (PARTITION BY level_value ORDER BY ts, {O.ORDER}) AS place,
  greatest(count(*) OVER (PARTITION BY level_value) - 15, 0) AS not_shown FROM alerts WHERE level_value >= 3)
WHERE place <= 15""",
    ),
)
def top_alerts_per_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alert_table(reports.top_alerts_per_level(_analysis(spark, sf_dir).alerts), "place", "not_shown")


@register(
    "recommendations",
    O.with_alerts(
        O.ALL_E, EVERY, "SELECT DISTINCT unnest(advice) AS recommendation FROM alerts ORDER BY recommendation LIMIT 15"
    ),
)
def recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.recommendations(_analysis(spark, sf_dir).alerts)


_BY_LEVEL = ", ".join(
    f"count(*) FILTER (level_value = {v}) AS {n.lower()}"
    for n, v in {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}.items()
)


@register(
    "engine_totals",
    O.with_alerts(
        O.ALL_E, EVERY,
        f"""SELECT (SELECT count(*) FROM e) AS total_entries,
  (SELECT count(DISTINCT source_ip) FROM e WHERE source_ip <> '') AS unique_source_ips,
  (SELECT strftime(min(ts), {O.STAMP}) FROM e) AS first_ts, (SELECT strftime(max(ts), {O.STAMP}) FROM e) AS last_ts,
  (SELECT count(*) FROM alerts) AS total_alerts,
  (SELECT count(DISTINCT source_ip) FROM alerts WHERE source_ip <> '') AS unique_attackers""",
    ),
)
def engine_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "date_format({0}, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS {0}"
    return _analysis(spark, sf_dir).totals().selectExpr(
        "total_entries", "unique_source_ips", text.format("first_ts"), text.format("last_ts"), "total_alerts", "unique_attackers"
    )


@register(
    "engine_summary",
    O.with_alerts(
        O.ALL_E, EVERY,
        f"""SELECT count(*) AS total_alerts, {_BY_LEVEL},
  count(DISTINCT CASE WHEN source_ip <> '' THEN source_ip END) AS unique_attackers,
  array_to_string(list_sort(list(DISTINCT threat_type)), ',') AS attack_types,
  coalesce(max(level_value) = 5, false) AS has_critical FROM alerts""",
    ),
)
def engine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).summary()


@register(
    "detector_stats",
    O.with_alerts(
        O.ALL_E, EVERY,
        f"SELECT d.detector, count(c.detector) AS total_alerts, {_BY_LEVEL}, (SELECT count(*) FROM e) AS entries_analyzed "
        f"FROM (SELECT unnest({EVERY!r}) AS detector) d LEFT JOIN correlated c ON c.detector = d.detector GROUP BY d.detector",
    ),
)
def detector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysis(spark, sf_dir).detector_stats()
