"""Histories that no calendar cut splits: a third of the rows on one key, within one hour."""

import random
from collections import defaultdict
from datetime import timedelta

import pytest

from logvigil.operators import auth, geo, runs, temporal
from tests.conftest import T0
from tests.test_auth import failure
from tests.test_temporal_geo import GEO_DDL, km


@pytest.fixture(params=[1_000_000, 40], ids=["whole", "runs"])
def run_rows(request, monkeypatch, spark):
    monkeypatch.setattr(runs, "RUN_ROWS", request.param)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)


def hot_rows(n, seed, **more):
    draw = random.Random(seed)
    for seq in range(n):
        hot = draw.random() < 1 / 3
        yield {
            "user": "hot" if hot else draw.choice(["a", "b", "c", "", None]), "line_seq": seq,
            "ts_local": T0 + timedelta(seconds=draw.randrange(0, 3600, 4) if hot else draw.randrange(0, 40 * 86400, 60)),
            **{k: draw.choice(v) for k, v in more.items()},
        }


def in_order(rows):
    return sorted(rows, key=lambda r: (r["ts_local"], r["line_seq"]))


def test_running_counts(entries_of, run_rows):
    rows = list(hot_rows(900, 1))
    events, weekend, hours, want = defaultdict(int), defaultdict(int), defaultdict(int), {}
    for row in in_order(rows):
        user, t = row["user"], row["ts_local"]
        if user:
            events[user] += 1
            weekend[user] += t.weekday() >= 5
            hours[user, t.hour] += 1
            want[row["line_seq"]] = (events[user], weekend[user], hours[user, t.hour])
    got = temporal.running_baselines(entries_of(rows)).select("line_seq", "events", "weekend_events", "hour_events").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("minutes", [1, 10, 100])
def test_trailing_counts(entries_of, run_rows, minutes):
    draw = random.Random(minutes)
    rows = [
        failure("1.1.1.1", "hot" if draw.random() < 1 / 3 else draw.choice("ab"), draw.randrange(0, 3600, 5), line_seq=n) for n in range(600)
    ]
    kept, want = defaultdict(list), {}
    for row in sorted(rows, key=lambda r: (r["at"], r["line_seq"])):
        window = kept[row["user"]]
        window.append(row["at"])
        window[:] = [t for t in window if t >= row["at"] - 60 * minutes]
        want[row["line_seq"]] = (len(window), T0 + timedelta(seconds=window[0]))
    config = auth.AuthConfig(window_minutes=minutes)
    got = auth.trailing_failures(entries_of(rows), config).select("line_seq", "trailing_count", "first_ts").collect()
    assert {r[0]: tuple(r[1:]) for r in got} == want and len(got) == 600


def test_places(spark, entries_of, run_rows):
    draw = random.Random(3)
    where = {f"p{i}": (draw.uniform(-60, 60), draw.uniform(-170, 170)) for i in range(30)}
    table = spark.createDataFrame([(ip, ip.upper(), ip, "r", ip, *where[ip], False, False, False) for ip in where], GEO_DDL)
    rows = list(hot_rows(900, 4, source_ip=[*where, "nowhere"]))
    last, seen, ways, fresh = {}, defaultdict(set), {}, {}
    for row in in_order(rows):
        user, ip, t = row["user"], row["source_ip"], row["ts_local"]
        if ip in where and user:
            if user in last and last[user][0] < t:
                ways[row["line_seq"]] = round(km(where[last[user][1]], where[ip]), 6)
            if ip not in seen[user] and len(seen[user]) >= 5:
                fresh[row["line_seq"]] = len(seen[user])
            last[user] = (t, ip)
            seen[user].add(ip)
    found = geo.geo_findings(entries_of(rows), table).select("line_seq", "distance_km", "new_country", "known_countries").collect()
    assert {r[0]: round(r[1], 6) for r in found if r[1] is not None} == ways
    assert {r[0]: r[3] for r in found if r[2]} == fresh
    assert len(found) == sum(r["source_ip"] in where for r in rows)
    news = geo.new_country_rows(geo.geo_enrich(entries_of(rows), table)).collect()
    assert {r.line_seq: r.known_countries for r in news} == fresh


def test_runs_are_even_and_in_order(spark, entries_of, monkeypatch):
    """One key with equal times: only the order inside the file parts them."""
    monkeypatch.setattr(runs, "RUN_ROWS", 100)
    rows = [{"user": "hot", "ts_local": T0, "line_seq": n} for n in range(4000)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        cut = runs.in_runs(entries_of(rows), ["user"], ["ts", "file_path", "line_seq"], "test")
        sizes = [r["count"] for r in cut.groupBy("_run").count().collect()]
        assert len(sizes) >= 12 and max(sizes) < 4 * sorted(sizes)[len(sizes) // 2]
        borders = cut.groupBy("_run").agg({"line_seq": "min"}).orderBy("_run").collect()
        assert [r[1] for r in borders] == sorted(r[1] for r in borders)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_large_geo_tables_and_repeated_ips(spark, entries_of, monkeypatch):
    rows = [{"user": "u", "source_ip": ip, "ts_local": T0 + timedelta(hours=n), "line_seq": n} for n, ip in enumerate(["a", "b", "c"])]
    places = [("a", "First", 1), ("a", "Last", 3), ("a", "Middle", 2), ("b", "B", 1)]
    table = spark.createDataFrame(places, "ip string, country string, seq int").repartition(3)
    results = []
    for limit in (200_000, 0):
        monkeypatch.setattr(geo, "SMALL_GEO", limit)
        results.append({(r.source_ip, r.country) for r in geo.geo_enrich(entries_of(rows), table).collect()})
    assert results == [{("a", "Last"), ("b", "B")}] * 2


def test_place_detector_reads_the_log_once(spark, entries_of):
    path = runs.shared_dir(spark) + "/log-once"
    entries_of([{"user": "u", "source_ip": "a"}]).write.mode("overwrite").parquet(path)
    log = spark.read.parquet(path)
    table = spark.createDataFrame([("a", "A")], "ip string, country string")
    plan = geo.geo_findings(log.where("`user` IS NOT NULL"), table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("log-once") <= 2 and "SortMergeJoin" not in plan
