import os
import random
import uuid
from datetime import timedelta

import pytest

from logvigil.operators import auth, geo, temporal
from logvigil.schema import conform_entries
from logvigil.streaming import online, ordered
from tests.conftest import T0
from tests.test_temporal_geo import GEO_DDL


@pytest.fixture(scope="module")
def history(spark, entries_of, tmp_path_factory):
    """Entries in five files in time order, and a stream that reads one file per micro-batch."""
    rng = random.Random(11)
    rows = []
    for n in range(500):
        hot = rng.random() < 1 / 3
        rows.append(
            {
                "source_ip": "p0" if hot else f"p{rng.randrange(6)}", "user": "hot" if hot else rng.choice(["a", "b", None]),
                "action": rng.choice(["ssh_failure", "ssh_failure", "ssh_success"]), "message": "m",
                "ts_local": T0 + timedelta(seconds=n * 60 + rng.randrange(30)), "line_seq": n, "resource": "/r",
                "status_code": rng.choice([0, 1, None]),
            }
        )
    path = tmp_path_factory.mktemp("stream")
    for part in range(5):
        entries_of(rows[part * 100 : part * 100 + 100]).coalesce(1).write.parquet(str(path / f"part{part}"))
    files = [str(next((path / f"part{part}").glob("*.parquet"))) for part in range(5)]
    source = tmp_path_factory.mktemp("source")
    for part, name in enumerate(files):
        (source / f"{part}.parquet").write_bytes(open(name, "rb").read())
        # The source takes files by age.
        os.utime(source / f"{part}.parquet", (1_700_000_000 + 60 * part,) * 2)
    batch = entries_of(rows)

    def stream():
        raw = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        return conform_entries(raw)

    return batch, stream


COLUMNS = ["alert_id", "level", "source_ip", "target", "description", "metadata", "line_seq"]


def rows(alerts):
    return sorted(tuple(map(str, r)) for r in alerts.select(*COLUMNS).collect())


def test_login_stream_equals_batch(history):
    batch, stream = history
    config = auth.AuthConfig(window_minutes=20, failed_attempts=3)
    expected = rows(auth.online_brute_force(batch, config))
    assert len(expected) > 50
    assert rows(online.drain(online.stream_brute_force(stream(), config, "1 hour"), "t")) == expected


def test_time_stream_equals_batch(history):
    batch, stream = history
    config = temporal.TemporalConfig(min_events=5, hour_share=0.2)
    expected = rows(temporal.online_temporal_alerts(batch, config))
    assert len(expected) > 20
    assert rows(online.drain(online.stream_temporal(stream(), config), "t")) == expected


def test_place_stream_equals_batch(spark, history):
    batch, stream = history
    table = spark.createDataFrame(
        [(f"p{i}", f"P{i}", f"C{i}", "r", f"c{i}", 10.0 * i, 20.0 * i, i == 1, False, False) for i in range(5)], GEO_DDL
    )
    config = geo.GeoConfig(min_countries=2)
    expected = rows(geo.geo_alerts(batch, table, config))
    assert len(expected) > 50
    assert rows(online.drain(online.stream_geo(stream(), table, config), "t")) == expected


def visits(times, ip="p1"):
    return [
        {"user": "u", "source_ip": ip if isinstance(ip, str) else ip[n], "ts_local": t, "line_seq": n, "resource": "/r"} for n, t in enumerate(times)
    ]


def file_stream(spark, entries_of, folder, batches):
    """A stream that takes one file of rows at a time; more files may follow."""
    for rows in batches:
        n = len(list(folder.glob("b*")))
        entries_of(rows).coalesce(1).write.parquet(str(folder / f"b{n}"))
        for k, part in enumerate(sorted((folder / f"b{n}").glob("*.parquet"))):
            part.rename(folder / f"{n:03d}-{k}.parquet")
            os.utime(folder / f"{n:03d}-{k}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    schema = entries_of([]).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(str(folder))


def test_places_are_forgotten_after_a_while(spark, entries_of, tmp_path):
    table = spark.createDataFrame([(f"p{i}", f"P{i}", f"C{i}", "r", f"c{i}", 10.0 * i, 20.0 * i, False, False, False) for i in range(9)], GEO_DDL)
    days = [0, 1, 2, 3, 40, 80, 81]
    batches = [visits([T0 + timedelta(days=d)], [f"p{n}"]) for n, d in enumerate(days)]
    config = geo.GeoConfig(min_countries=2, max_speed_kmh=1e9)

    def found(keep, name):
        folder = tmp_path / name
        folder.mkdir()
        alerts = online.drain(online.stream_geo(file_stream(spark, entries_of, folder, batches), table, config, keep), "t")
        return [(r.ts_local - T0).days for r in alerts.orderBy("ts").collect()]

    assert found(None, "all") == [2, 3, 40, 80, 81]
    # on the 40th day the user of the first four is forgotten, on the 80th that of the 40th
    assert found(timedelta(days=30), "some") == [2, 3]


def test_habits_are_forgotten_and_streams_go_on(spark, entries_of, tmp_path):
    config = temporal.TemporalConfig(min_events=5, hour_share=0.2)
    days = [0, 1, 2, 3, 4, 7]  # Mondays to Fridays
    usual = [visits([T0 + timedelta(days=d, minutes=m) for m in range(3)]) for d in days]
    odd = visits([T0 + timedelta(days=8, hours=2)])
    folder = tmp_path / "in"
    folder.mkdir()
    base = str(tmp_path / "run")

    def run(rows, base=None):
        return online.drain(online.stream_temporal(file_stream(spark, entries_of, folder, rows), config, timedelta(days=30)), "t", base)

    assert run(usual, base).count() == 0
    assert run([odd], base).count() == 1  # goes on with the state of the first run
    assert run([], base).count() == 1  # nothing is read twice
    assert run([visits([T0 + timedelta(days=100, hours=h)]) for h in (0, 1)], base).count() == 1  # forgotten: no habit to break
    assert run([]).count() == 1  # a new folder: from the start


@pytest.fixture
def tiny_runs(monkeypatch):
    """Tasks order their rows in runs of a few rows, so that all is written and merged on several levels."""
    for name, value in {"RUN_BYTES": 60_000, "BLOCK_BYTES": 6_000, "FAN_IN": 4}.items():
        monkeypatch.setattr(ordered, name, value)


def watched(monkeypatch, name, folder):
    """Note the rows that each call of a state handler is given."""
    make = getattr(online, name)
    folder.mkdir()

    def watching(*args):
        handle = make(*args)

        def counting(key, batches, state):
            seen = []

            def through():
                for batch in batches:
                    seen.append(len(batch))
                    yield batch

            yield from handle(key, through(), state)
            (folder / f"{key[0]}-{sum(seen)}-{uuid.uuid4().hex}").touch()

        return counting

    monkeypatch.setattr(online, name, watching)
    return lambda: [int(p.name.split("-")[1]) for p in folder.iterdir()]


def busy_user(seed):
    """Many rows of one user and a few of others, out of order and often at the same time."""
    rng = random.Random(seed)
    return [
        {
            "source_ip": f"p{rng.randrange(6)}", "user": rng.choice(["a", "b", "c"]) if rng.random() < 0.1 else "busy", "resource": "/r",
            "ts_local": T0 + timedelta(minutes=rng.randrange(3000)), "line_seq": n, "file_path": f"f{rng.randrange(2)}",
        }
        for n in rng.sample(range(4000), 4000)
    ]


def test_places_of_a_busy_user_stay_out_of_the_state(spark, entries_of, tmp_path, monkeypatch, tiny_runs):
    table = spark.createDataFrame(
        [(f"p{i}", f"P{i}", f"C{i}" if i else None, "r", f"c{i}", 10.0 * i, 20.0 * i if i != 2 else None, i == 1, False, False) for i in range(5)], GEO_DDL
    )
    config = geo.GeoConfig(min_countries=2)
    rows_in = busy_user(5)
    given = watched(monkeypatch, "follow_user", tmp_path / "given")
    (tmp_path / "in").mkdir()
    expected = rows(geo.geo_alerts(entries_of(rows_in), table, config))
    assert len(expected) > 1000
    assert rows(online.drain(online.stream_geo(file_stream(spark, entries_of, tmp_path / "in", [rows_in]), table, config), "t")) == expected
    assert max(given()) <= 100


def test_habits_of_a_busy_user_stay_out_of_the_state(spark, entries_of, tmp_path, monkeypatch, tiny_runs):
    config = temporal.TemporalConfig(min_events=5, hour_share=0.05)
    rows_in = busy_user(6)
    given = watched(monkeypatch, "count_hours", tmp_path / "given")
    (tmp_path / "in").mkdir()
    expected = rows(temporal.online_temporal_alerts(entries_of(rows_in), config))
    assert len(expected) > 1000
    assert rows(online.drain(online.stream_temporal(file_stream(spark, entries_of, tmp_path / "in", [rows_in]), config), "t")) == expected
    assert max(given()) <= 24 * 4
