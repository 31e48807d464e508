"""Access from unusual places: anonymizers, risky countries, impossible travel, new countries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.functions.geo import fixed, haversine_km
from logvigil.operators.runs import scan, with_carries
from logvigil.operators.skew import attach
from logvigil.schema import EVIDENCE_STRUCT, ROW_ORDER, project, shape_alerts

DETECTOR, DETECTOR_ORD = "geo_anomaly", 5
SMALL_GEO = 200_000  # rows of a geo table that may be sent to every task

GEO_TYPES = {
    "ip": "string", "country": "string", "country_code": "string", "region": "string", "city": "string",
    "latitude": "double", "longitude": "double", "is_vpn": "boolean", "is_tor": "boolean", "is_proxy": "boolean",
}


@dataclass(frozen=True)
class GeoConfig:
    max_speed_kmh: float = 1000
    # Country codes that always count as risky.
    high_risk_countries: tuple[str, ...] = ("KP", "IR", "RU", "CN", "BY")
    min_countries: int = 5


HAS_USER = "coalesce(`user` <> '', false)"
ROW_STRUCT = f"struct({', '.join(ROW_ORDER)})"
PLACE = "named_struct('ts', ts, 'latitude', latitude, 'longitude', longitude, 'city', city, 'country', country)"


def conform_geo(geo: DataFrame) -> DataFrame:
    """Bring a geo table to the full layout, one row per ip.

    Of several rows for an ip the last in the column ``seq`` counts; without that column the greatest, so that every run picks the same.
    """
    have = set(geo.columns)
    flags = {c: f"coalesce({c}, false)" if c in have else "false" for c in ("is_vpn", "is_tor", "is_proxy")}
    full = project(geo, GEO_TYPES | ({"seq": dict(geo.dtypes)["seq"]} if "seq" in have else {}), flags)
    place = f"struct({', '.join(GEO_TYPES)})"
    last = f"max_by({place}, struct(seq, {place}))" if "seq" in have else f"max({place})"
    return full.groupBy("ip").agg(F.expr(f"{last} AS _place")).selectExpr("_place.*")


def geo_enrich(entries: DataFrame, geo: DataFrame) -> DataFrame:
    """Entries whose ip the geo table knows, with the geo columns.

    A geo table of up to ``SMALL_GEO`` rows is sent to the tasks. With a larger one, busy ips are answered from a broadcast of the
    busiest ones, the others by an ordinary join, for which Spark broadcasts the located ips if they are few enough.
    """
    places = conform_geo(geo)
    if geo.limit(SMALL_GEO + 1).count() <= SMALL_GEO:
        return entries.join(F.broadcast(places.withColumnRenamed("ip", "source_ip")), "source_ip").select(
            *entries.columns, *[c for c in places.columns if c != "ip"]
        )
    usage = entries.where("source_ip <> ''").groupBy(F.col("source_ip").alias("ip")).agg(F.expr("count(*) AS _uses"))
    located = places.join(usage, "ip").withColumnRenamed("ip", "source_ip")
    return attach(entries, located, ["source_ip"], "_uses", ROW_ORDER).where("_uses IS NOT NULL").drop("_uses")


CODE = "coalesce(country_code, '')"
# What the scan of a user's history adds: the place before, and for the first row of a country how many others were known.
_SCANNED = ("previous", "known_countries")


def with_history(located: DataFrame) -> DataFrame:
    """Add ``previous``, time and place of the user's preceding row (null for the first), and ``known_countries``.

    The latter is set on the user's first row from a country: how many countries were known before. Both come from one pass over
    the user's rows in time order. Rows without a user have no history and stay where they are.
    """
    order = f"ORDER BY {', '.join(ROW_ORDER)}"
    so_far = f"{order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"

    def passed(part: DataFrame, partition: str) -> DataFrame:
        return part.selectExpr(
            "*",
            f"lag({PLACE}) OVER (PARTITION BY {partition} {order}) AS previous",
            f"row_number() OVER (PARTITION BY {partition}, {CODE} {order}) = 1 AS _first",
        )

    def whole(rows: DataFrame, partition: str) -> DataFrame:
        known = f"coalesce(count_if(_first) OVER (PARTITION BY {partition} {so_far}), 0)"
        return passed(rows, partition).selectExpr(
            *[f"`{c}`" for c in located.columns], "previous", f"if(_first, {known}, NULL) AS known_countries"
        )

    def of_runs(runs: DataFrame, partition: str) -> DataFrame:
        # of a country the first run counts; there are no more rows than long keys times countries
        first_run = runs.groupBy("user", F.expr(f"{CODE} AS _code")).agg(F.min("_run").alias("_first_run"))
        sums = runs.groupBy("user", "_run").agg(
            F.expr(f"max(struct({', '.join(ROW_ORDER)}, {PLACE} AS place)).place AS _last")
        ).join(first_run.groupBy("user", F.col("_first_run").alias("_run")).agg(F.count("*").alias("_new")), ["user", "_run"], "left")
        along = "OVER (PARTITION BY `user` ORDER BY _run"
        carries = sums.selectExpr(
            "`user`", "_run", f"lag(_last) {along}) AS _carried",
            f"coalesce(sum(_new) {along} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _known",
        )
        firsts = F.broadcast(first_run.withColumnRenamed("user", "_user"))
        marked = with_carries(passed(runs, partition), ["user"], carries).join(
            firsts, (F.col("user") == F.col("_user")) & (F.expr(CODE) == F.col("_code"))
        )
        new = "_first AND _first_run = _run"
        known = f"_known + coalesce(count_if({new}) OVER (PARTITION BY {partition} {so_far}), 0)"
        return marked.selectExpr(
            *[f"`{c}`" for c in located.columns], "coalesce(previous, _carried) AS previous", f"if({new}, {known}, NULL) AS known_countries"
        )

    named = scan(located.where(HAS_USER), ["user"], ROW_ORDER, "places", whole, of_runs)
    types = dict(named.dtypes)
    nobody = located.where(f"NOT {HAS_USER}").selectExpr("*", *[f"CAST(NULL AS {types[c]}) AS {c}" for c in _SCANNED])
    return named.unionByName(nobody)


def new_country_rows(located: DataFrame, config: GeoConfig = GeoConfig()) -> DataFrame:
    """First access of a user from a country when enough countries were known before."""
    return (
        with_history(located).where(f"known_countries >= {config.min_countries}")
        .selectExpr("`user`", "CAST(known_countries AS INT) AS known_countries", *ROW_ORDER)
    )


def with_previous_place(located: DataFrame) -> DataFrame:
    """Add ``previous``: time and place of the user's preceding row, null for the first."""
    return with_history(located).drop("known_countries")


def travelled(rows: DataFrame) -> DataFrame:
    """Add distance, hours and speed since ``previous``; null unless that is strictly earlier."""
    distance = haversine_km("previous.latitude", "previous.longitude", "latitude", "longitude")
    return rows.selectExpr(
        "*",
        f"CASE WHEN previous.ts < ts THEN {distance} END AS distance_km",
        "CASE WHEN previous.ts < ts THEN (unix_micros(ts) - unix_micros(previous.ts)) / 1e6D / 3600D END "
        "AS travel_hours",
    ).selectExpr("*", "distance_km / travel_hours AS speed_kmh")


def with_travel(located: DataFrame) -> DataFrame:
    """Located rows with the way from the user's previous row."""
    return travelled(with_previous_place(located))


def flagged(rows: DataFrame, config: GeoConfig = GeoConfig()) -> DataFrame:
    """Add the checks as flags to rows with travel columns and ``known_countries`` (null unless the first of a country)."""
    risky = ", ".join(f"'{c}'" for c in config.high_risk_countries) or "NULL"
    return rows.selectExpr(
        "*",
        f"coalesce(country_code IN ({risky}), false) AS high_risk",
        f"coalesce(speed_kmh > {float(config.max_speed_kmh)}D, false) AS impossible_travel",
        f"coalesce(known_countries >= {config.min_countries}, false) AS new_country",
    )


def geo_findings(entries: DataFrame, geo: DataFrame, config: GeoConfig = GeoConfig()) -> DataFrame:
    """Located rows with the four checks as flags."""
    located = geo_enrich(entries.where("ts IS NOT NULL"), geo)
    return flagged(travelled(with_history(located)), config)


def geo_alerts_from(findings: DataFrame) -> DataFrame:
    """Turn checked rows into alerts; the level is that of the gravest finding."""
    # The texts of findings and advice.
    texts = f"""array_compact(array(
      CASE WHEN is_tor THEN 'Tor exit node detected' WHEN is_vpn THEN 'VPN detected' WHEN is_proxy THEN 'Proxy detected' END,
      CASE WHEN high_risk THEN concat('Access from high-risk country: ', country) END,
      CASE WHEN impossible_travel THEN concat('Impossible travel detected: ', {fixed('distance_km', 0)}, 'km in ',
        {fixed('travel_hours', 1)}, 'h (', coalesce(previous.city, 'None'), ', ', coalesce(previous.country, 'None'),
        ' -> ', coalesce(city, 'None'), ', ', coalesce(country, 'None'), ')') END,
      CASE WHEN new_country THEN concat('First access from new country: ', country) END))"""
    level = (
        "greatest(CASE WHEN is_tor THEN 4 WHEN is_vpn OR is_proxy THEN 2 END, if(high_risk, 3, NULL), "
        "if(impossible_travel, 4, NULL), if(new_country, 3, NULL))"
    )
    alerts = (
        findings.selectExpr("*", f"{level} AS level_value")
        .where("level_value IS NOT NULL")
        .selectExpr("*", f"{texts} AS _texts")
        .selectExpr(
            "ts", "ts_local", "tz_offset", "source_ip", "file_path", "line_seq", "level_value",
            "'geo_anomaly' AS threat_type",
            "coalesce(nullif(`user`, ''), resource) AS target",
            "concat('Geographic anomaly: ', array_join(_texts, '; ')) AS description",
            f"array({EVIDENCE_STRUCT}) AS evidence",
            "array('T1078', 'T1133') AS mitre_attack",
            "array('Verify the access was from an authorized location', 'Check for account compromise', "
            "'Consider implementing geo-blocking', 'Review VPN/anonymizer usage policies') AS recommendations",
            "to_json(named_struct('anomalies', _texts, 'country', country, 'city', city, 'is_vpn', is_vpn, "
            "'is_tor', is_tor)) AS metadata",
        )
    )
    return shape_alerts(alerts, detector=DETECTOR, detector_ord=DETECTOR_ORD)


def geo_alerts(entries: DataFrame, geo: DataFrame, config: GeoConfig = GeoConfig()) -> DataFrame:
    """One alert per row from an unusual place."""
    return geo_alerts_from(geo_findings(entries, geo, config))
