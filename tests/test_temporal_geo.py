import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest

from logvigil.operators import geo, reputation, skew, temporal
from tests.conftest import T0

GEO_DDL = (
    "ip string, country string, country_code string, region string, city string, latitude double, longitude double, "
    "is_vpn boolean, is_tor boolean, is_proxy boolean"
)


def visits(user, times, **more):
    return [{"user": user, "ts_local": t, "source_ip": "1.1.1.1", "action": "x", **more} for t in times]


def daily(hour, days, start=datetime(2024, 1, 1)):
    return [start + timedelta(days=d, hours=hour) for d in range(days)]


def test_off_hours_give_both_texts(entries_of):
    rows = visits("a", [T0.replace(hour=h) for h in (5, 6, 22, 23)]) + visits(None, [T0.replace(hour=2)], resource="/x")
    found = {(a.target, a.ts_local.hour): a for a in temporal.temporal_alerts(entries_of(rows)).collect()}
    assert set(found) == {("a", 5), ("a", 23), ("/x", 2)}
    alert = found[("a", 23)]
    assert alert.level == "LOW"
    assert alert.description == (
        "Temporal anomaly detected: Access outside business hours (23:00); Access during high-risk hour (23:00 UTC)"
    )


@pytest.mark.parametrize("hot_keys", [0, 256])
def test_unusual_hour_needs_more_than_fifty_events(entries_of, monkeypatch, hot_keys):
    monkeypatch.setattr(skew, "HOT_KEYS", hot_keys)
    weekdays = [t for t in daily(10, 100) if t.weekday() < 5]
    rows = visits("a", weekdays[:60] + [T0.replace(hour=14)]) + visits("b", weekdays[:40] + [T0.replace(hour=14)])
    (alert,) = temporal.temporal_alerts(entries_of(rows)).collect()
    assert (alert.target, alert.level) == ("a", "MEDIUM")
    assert alert.description.endswith("Unusual hour for user a")


def test_rare_weekend(entries_of):
    weekdays = [t for t in daily(10, 60) if t.weekday() < 5]
    saturday = datetime(2024, 1, 6, 10)
    rows = visits("a", weekdays[:30] + [saturday]) + visits("b", weekdays[:18] + [saturday])
    (alert,) = temporal.temporal_alerts(entries_of(rows)).collect()
    assert (alert.target, alert.level) == ("a", "MEDIUM")
    assert '"is_weekend":true' in alert.metadata


def test_running_counts_equal_a_plain_loop(entries_of):
    rng = random.Random(5)
    start = datetime(2024, 1, 1)
    rows = [
        {"user": rng.choice(["a", "a", "b", None]), "ts_local": start + timedelta(minutes=rng.randrange(0, 9 * 1440, 30)), "line_seq": n}
        for n in range(300)
    ]
    events, weekend, hours = defaultdict(int), defaultdict(int), defaultdict(int)
    expected = {}
    for row in sorted(rows, key=lambda r: (r["ts_local"], r["line_seq"])):
        user, t = row["user"], row["ts_local"]
        if user:
            events[user] += 1
            weekend[user] += t.weekday() >= 5
            hours[user, t.hour] += 1
            expected[row["line_seq"]] = (events[user], weekend[user], hours[user, t.hour])
    got = temporal.running_baselines(entries_of(rows)).select("line_seq", "events", "weekend_events", "hour_events").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == expected


@pytest.fixture(scope="module")
def places(spark):
    rows = [
        ("tor", "T-land", "T1", "r", "tc", 0.0, 0.0, True, True, True),
        ("vpn", "V-land", "V1", "r", "vc", 0.0, 0.0, True, False, True),
        ("proxy", "P-land", "P1", "r", "pc", 0.0, 0.0, False, False, True),
        ("risky", "Russia", "RU", "r", "Moscow", 55.75, 37.62, False, False, False),
        ("ny", "United States", "US", "NY", "New York", 40.71, -74.0, False, False, False),
        ("ldn", "United Kingdom", "GB", "LDN", "London", 51.51, -0.13, False, False, False),
    ] + [(f"c{i}", f"C{i}", f"C{i}", "r", f"city{i}", 1.0, 1.0, False, False, False) for i in range(7)]
    return spark.createDataFrame(rows, GEO_DDL)


def go(user, *steps):
    return [{"user": user, "source_ip": ip, "ts_local": T0 + timedelta(hours=h), "resource": "/r"} for ip, h in steps]


def test_anonymizers_and_risky_countries(entries_of, places):
    rows = [{"source_ip": ip, "resource": "/r", "log_type": "apache"} for ip in ("tor", "vpn", "proxy", "risky", "ny", "else")]
    found = {a.source_ip: (a.level, a.description, a.target) for a in geo.geo_alerts(entries_of(rows), places).collect()}
    assert found == {
        "tor": ("HIGH", "Geographic anomaly: Tor exit node detected", "/r"),
        "vpn": ("LOW", "Geographic anomaly: VPN detected", "/r"),
        "proxy": ("LOW", "Geographic anomaly: Proxy detected", "/r"),
        "risky": ("MEDIUM", "Geographic anomaly: Access from high-risk country: Russia", "/r"),
    }


def test_impossible_travel(entries_of, places):
    rows = go("fast", ("ny", 0), ("ldn", 1.25)) + go("slow", ("ny", 0), ("ldn", 10)) + go("same", ("ny", 0), ("ldn", 0))
    (alert,) = geo.geo_alerts(entries_of(rows), places).collect()
    assert (alert.target, alert.level) == ("fast", "HIGH")
    assert alert.description == (
        "Geographic anomaly: Impossible travel detected: 5570km in 1.2h (New York, United States -> London, United Kingdom)"
    )


def test_new_country_after_five(entries_of, places):
    rows = go("u", *[(f"c{i}", i) for i in range(7)], ("c6", 8))
    found = [(a.ts_local.hour, a.description) for a in geo.geo_alerts(entries_of(rows), places).orderBy("ts").collect()]
    assert found == [
        (15, "Geographic anomaly: First access from new country: C5"),
        (16, "Geographic anomaly: First access from new country: C6"),
    ]


def km(a, b):
    (lat1, lon1), (lat2, lon2) = a, b
    h = math.sin(math.radians(lat2 - lat1) / 2) ** 2
    h += math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 6371 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("hot_keys", [0, 256])
def test_travel_equals_a_plain_loop(spark, entries_of, monkeypatch, hot_keys):
    """One user has a third of the rows; some rows have no user and some no place."""
    monkeypatch.setattr(skew, "HOT_KEYS", hot_keys)
    rng = random.Random(7)
    where = {f"p{i}": (rng.uniform(-60, 60), rng.uniform(-170, 170)) for i in range(8)}
    table = spark.createDataFrame(
        [(ip, ip.upper(), ip, "r", ip, lat, lon, False, False, False) for ip, (lat, lon) in where.items()], GEO_DDL
    )
    rows = [
        {
            "user": "hot" if rng.random() < 1 / 3 else rng.choice(["a", "b", "", None]),
            "source_ip": rng.choice([*where, "nowhere"]), "ts_local": T0 + timedelta(minutes=rng.randrange(0, 900, 5)), "line_seq": n,
        }
        for n in range(400)
    ]
    last, expected = {}, {}
    for row in sorted(rows, key=lambda r: (r["ts_local"], r["line_seq"])):
        user, ip, t = row["user"], row["source_ip"], row["ts_local"]
        if ip in where and user:
            if user in last and last[user][0] < t:
                expected[row["line_seq"]] = round(km(where[last[user][1]], where[ip]), 6)
            last[user] = (t, ip)
    got = geo.with_travel(geo.geo_enrich(entries_of(rows), table)).where("distance_km IS NOT NULL")
    assert {r.line_seq: round(r.distance_km, 6) for r in got.select("line_seq", "distance_km").collect()} == expected


def test_reputation(spark, entries_of):
    rows = [{"source_ip": ip} for ip in ("10.0.0.5", "10.0.0.9", "192.168.1.1", "not an ip", "999.1.1.1", None)]
    ranges = spark.createDataFrame(
        [("10.0.0.0/29", "a"), ("192.168.1.1", "b"), ("0.0.0.0/0", "all")], "cidr string, label string"
    )
    got = reputation.ip_reputation(entries_of(rows), ranges).collect()
    assert {(r.source_ip, r.label) for r in got} == {
        ("10.0.0.5", "a"), ("192.168.1.1", "b"), ("10.0.0.5", "all"), ("10.0.0.9", "all"), ("192.168.1.1", "all"),
    }
    assert reputation.ip_reputation(entries_of(rows), None).count() == 0
