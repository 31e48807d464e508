"""One key holds a third or more of the rows: no partition may get most of them."""

from datetime import timedelta

import pytest

from logvigil.operators import auth, geo, runs, skew
from tests.conftest import T0
from tests.test_auth import failure
from tests.test_temporal_geo import GEO_DDL


@pytest.fixture
def no_broadcast(spark):
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def largest_share(df):
    sizes = [r["count"] for r in df.selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()]
    return max(sizes) / sum(sizes)


def test_hot_and_null_keys_are_spread(spark, no_broadcast):
    rows = spark.range(6000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE concat('k', id) END AS k"
    )
    per_key = rows.where("k IS NOT NULL").groupBy("k").agg({"id": "count"}).withColumnRenamed("count(id)", "n")
    found = skew.attach(rows, per_key, ["k"], "n", ["id"])
    assert largest_share(found) < 0.3
    got = {(r.k, r.n) for r in found.where("k = 'hot' OR k IS NULL").select("k", "n").distinct().collect()}
    assert got == {("hot", 2000), (None, None)}
    assert found.count() == 6000 and found.where("k LIKE 'k%' AND n = 1").count() == 2000


def test_salt_is_part_of_the_partitioning(entries_of, no_broadcast):
    rows = [failure("1.1.1.1", "a", i) for i in range(20)]
    plan = auth.pair_windows(auth.login_outcomes(entries_of(rows)))._jdf.queryExecution().executedPlan().toString()
    exchanges = [part.split(")", 1)[0] for part in plan.split("hashpartitioning(")[1:]]
    assert any("source_ip#" in e and "account#" in e and "_salt#" in e for e in exchanges)


def test_places_of_one_busy_user_and_of_nobody_are_spread(spark, entries_of, no_broadcast, monkeypatch):
    monkeypatch.setattr(runs, "RUN_ROWS", 500)
    rows = [
        {"user": None if n % 2 else "hot", "source_ip": "p1", "ts_local": T0 + timedelta(minutes=n), "line_seq": n} for n in range(4000)
    ]
    table = spark.createDataFrame([("p1", "P", "P1", "r", "c", 1.0, 1.0, False, False, False)], GEO_DDL)
    assert largest_share(geo.with_previous_place(geo.geo_enrich(entries_of(rows), table))) < 0.35


def test_trailing_counts_spread_a_pair_over_time(entries_of, no_broadcast, monkeypatch):
    monkeypatch.setattr(runs, "RUN_ROWS", 500)
    rows = [failure("1.1.1.1", "a", n * 60, line_seq=n) for n in range(3000)]
    assert largest_share(auth.trailing_failures(entries_of(rows))) < 0.35
