"""The one-record-at-a-time detectors as Structured Streaming queries.

Web detectors look at single rows and run on a stream as they are. Login, time and place
detectors keep state per key. Rows of a micro-batch are handled in time order; rows later
than the watermark are dropped, which is what lets Spark forget idle keys of the login
detector. A fresh checkpoint location starts with empty state.

The time and place detectors send sums of a micro-batch to the state, and take the rows past
it: a union with one row per user that holds the state before, dealt out by user and ordered
on local disk. So a user's rows need not fit in memory.
"""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from logvigil.operators import auth, geo, temporal, web
from logvigil.operators.auth import AuthConfig
from logvigil.operators.geo import GeoConfig
from logvigil.operators.temporal import TemporalConfig
from logvigil.session import shared_dir
from logvigil.streaming.state import (
    count_failures, count_hours, follow_user, sum_hours, sum_places, with_counts, with_places,
)

# How rows travel through the state handlers: times as numbers and texts, so nothing is
# converted between time zones or widened because of nulls.
CARRIED = {
    "us": "bigint", "local": "string", "tz_offset": "string", "source_ip": "string", "action": "string",
    "resource": "string", "status": "string", "message": "string", "log_type": "string", "raw_line": "string",
    "file_path": "string", "line_seq": "bigint",
}
_OUT = [
    "unix_micros(ts) AS us", "CAST(ts_local AS STRING) AS local", "tz_offset", "source_ip", "action", "resource",
    "CAST(status_code AS STRING) AS status", "message", "log_type", "raw_line", "file_path", "line_seq",
]
_BACK = [
    "timestamp_micros(us) AS ts", "CAST(local AS TIMESTAMP_NTZ) AS ts_local", "tz_offset", "source_ip", "action",
    "resource", "CAST(status AS INT) AS status_code", "message", "log_type", "raw_line", "file_path", "line_seq",
]

_CARRIED_STATE = "user string, us bigint, carried string"


def _ddl(*more: str) -> str:
    return ", ".join([*[f"{name} {ddl}" for name, ddl in CARRIED.items()], *more])


# -- stateless ----------------------------------------------------------------------------


def stream_web_alerts(entries: DataFrame) -> DataFrame:
    """SQL injection, cross-site scripting and traversal alerts, one row at a time (no escalation)."""
    matches = web.web_matches(entries)
    return (
        web.sql_injection_hits(matches).unionByName(web.xss_hits(matches)).unionByName(web.traversal_hits(matches))
    )


# -- login attacks ------------------------------------------------------------------------


def stream_brute_force(entries: DataFrame, config: AuthConfig = AuthConfig(), delay: str = "10 minutes") -> DataFrame:
    """An alert for every failed login from the threshold on, counted in the window ending with it."""
    failures = auth.failures_of(entries).withWatermark("ts", delay)
    counted = (
        failures.selectExpr(*_OUT, "named", "account", "ts AS event_time")
        .groupBy("source_ip", "account")
        .applyInPandasWithState(
            count_failures(config.window_micros),
            _ddl("named boolean", "account string", "trailing_count bigint", "first_us bigint"),
            "times array<bigint>, counts array<bigint>",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
    return auth.online_alerts(
        counted.selectExpr(
            *_BACK, "named", "account", "if(named, account, NULL) AS `user`", "trailing_count",
            "timestamp_micros(first_us) AS first_ts",
        ),
        config,
    )


def _micros(keep: timedelta | None) -> int | None:
    return None if keep is None else keep // timedelta(microseconds=1)


def _kept(entries: DataFrame, keep: timedelta | None, delay: str) -> tuple[DataFrame, list[str], str]:
    """For state that expires: rows with a watermark, the column that carries it, and the kind of timeout."""
    if keep is None:
        return entries, [], GroupStateTimeout.NoTimeout
    return entries.withWatermark("ts", delay), ["ts AS event_time"], GroupStateTimeout.EventTimeTimeout


def _span(keep: timedelta | None) -> str:
    """The stretch of time a row belongs to, as SQL text: within one no user is forgotten."""
    return "0L" if keep is None else f"unix_micros(ts) - pmod(unix_micros(ts), {max(1, _micros(keep))}L)"


def _sums(rows: DataFrame, add_up, keep: timedelta | None) -> DataFrame:
    """Rows for the state, added up in the tasks that read them; not where rows may be late, which only Spark knows of every single one."""
    return rows.mapInArrow(add_up, rows.schema) if keep is None else rows


def _behind(before: DataFrame, rows: DataFrame, walk, ddl: str) -> DataFrame:
    """Rows in order behind the row with their user's state before the micro-batch."""
    return rows.unionByName(before, allowMissingColumns=True).repartition("user").mapInArrow(walk, ddl)


# -- unusual times ------------------------------------------------------------------------


def stream_temporal(
    entries: DataFrame, config: TemporalConfig = TemporalConfig(), keep: timedelta | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Alerts on unusual times, judged by the user's habits up to the row.

    With ``keep`` a user without rows for so long is forgotten, and the state goes once the watermark has passed; without, nobody is.
    """
    timed = entries.where("ts_local IS NOT NULL")
    timed, clock, timeout = _kept(timed, keep, delay)
    named = timed.where(temporal.HAS_USER)
    sums = _sums(
        named.selectExpr(
            "`user`", f"{_span(keep)} AS span", f"{temporal.HOUR} AS hour", "unix_micros(ts) AS lo", "unix_micros(ts) AS hi",
            "1L AS n", f"CAST({temporal.WEEKEND} AS BIGINT) AS weekend", *clock,
        ),
        sum_hours(), keep,
    )
    before = sums.groupBy("user").applyInPandasWithState(
        count_hours(_micros(keep)),
        _CARRIED_STATE,
        "last bigint, hours array<bigint>, weekend bigint, events bigint",
        "append",
        timeout,
    )
    counted = _behind(
        before,
        named.selectExpr(*_OUT, "`user`", f"{temporal.HOUR} AS hour", f"{temporal.WEEKEND} AS is_weekend"),
        with_counts(_micros(keep)),
        _ddl("user string", "events bigint", "weekend_events bigint", "hour_events bigint"),
    )
    known = temporal.anomaly_alerts(counted.selectExpr(*_BACK, "`user`", "events", "weekend_events", "hour_events"),
                                    config, *temporal.online_flags(config))
    anonymous = temporal.anomaly_alerts(timed.where(f"NOT {temporal.HAS_USER}"), config, "false", "false")
    return known.unionByName(anonymous)


# -- unusual places -----------------------------------------------------------------------

_GEO = {
    "country": "string", "country_code": "string", "city": "string", "latitude": "double", "longitude": "double",
    "is_vpn": "boolean", "is_tor": "boolean", "is_proxy": "boolean",
}


def stream_geo(
    entries: DataFrame, places: DataFrame, config: GeoConfig = GeoConfig(), keep: timedelta | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Alerts on unusual places; the geo table is a static side, joined per micro-batch.

    With ``keep`` a user without rows for so long is forgotten, and the state goes once the watermark has passed; without, nobody is.
    """
    table = geo.conform_geo(places).withColumnRenamed("ip", "source_ip").drop("region")
    timed, clock, timeout = _kept(entries.where("ts IS NOT NULL"), keep, delay)
    located = timed.join(table, "source_ip")
    geo_columns = list(_GEO)
    # a coordinate that is no number is unknown
    named = located.where(geo.HAS_USER).withColumns({c: F.expr(f"nanvl({c}, NULL)") for c in ("latitude", "longitude")})
    sums = _sums(
        named.selectExpr(
            "`user`", f"{_span(keep)} AS span", f"{geo.CODE} AS code", "unix_micros(ts) AS lo", "unix_micros(ts) AS us",
            "file_path", "line_seq", "latitude", "longitude", "city", "country", *clock,
        ),
        sum_places(), keep,
    )
    before = sums.groupBy("user").applyInPandasWithState(
        follow_user(_micros(keep)),
        _CARRIED_STATE,
        "us bigint, lat double, lon double, city string, country string, seen array<string>",
        "append",
        timeout,
    )
    followed = _behind(
        before,
        named.selectExpr(*_OUT, "`user`", *geo_columns),
        with_places(config.min_countries, _micros(keep)),
        _ddl(
            "user string", *[f"{c} {t}" for c, t in _GEO.items()], "p_us bigint", "p_lat double", "p_lon double",
            "p_city string", "p_country string", "known_countries bigint",
        ),
    ).selectExpr(
        *_BACK, "`user`", *geo_columns, "known_countries",
        "if(p_us IS NULL, NULL, named_struct('ts', timestamp_micros(p_us), 'latitude', p_lat, 'longitude', p_lon, "
        "'city', p_city, 'country', p_country)) AS previous",
    )
    anonymous = located.where(f"NOT {geo.HAS_USER}").selectExpr(
        *[c.split(" AS ")[-1] for c in _BACK], "`user`", *geo_columns, "CAST(NULL AS BIGINT) AS known_countries",
        "CAST(NULL AS STRUCT<ts: TIMESTAMP, latitude: DOUBLE, longitude: DOUBLE, city: STRING, country: STRING>) AS previous",
    )
    return geo.geo_alerts_from(geo.flagged(geo.travelled(followed.unionByName(anonymous)), config))


# -- running ------------------------------------------------------------------------------


def drain(stream: DataFrame, name: str, base: str | None = None) -> DataFrame:
    """Run a streaming query over everything its source holds now and give its output so far as a table.

    A run with the folder ``base`` of an earlier one goes on where that ended, with its state; a run in a new folder, as without
    ``base``, begins anew and so resets all detectors.
    """
    spark = stream.sparkSession
    base = base or f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{base}/data")
        .option("checkpointLocation", f"{base}/checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")
