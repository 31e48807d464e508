import gzip
from datetime import datetime

import pytest

from logvigil.plans.analysis import analyze_logs
from logvigil.schema import conform_entries
from logvigil.sources import ingest

NOW = datetime(2024, 6, 1)
APACHE = '10.0.0.1 - - [15/Jan/2024:10:00:00 +0000] "GET /{} HTTP/1.1" 200 5'
SYSLOG = "Jan 15 10:23:45 server app[1]: event {}"
EVENT = (
    '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID>4625</EventID>'
    '<TimeCreated SystemTime="2024-01-15T10:00:0{0}Z"/><Computer>h</Computer></System><EventData><Data Name="IpAddress">9.9.9.9</Data>\n'
    '<Data Name="TargetUserName">first</Data><Data Name="TargetUserName">u{0}</Data></EventData></Event>\n'
)


def names(rows, column="file_path"):
    return [getattr(r, column).rsplit("/", 1)[-1] for r in rows]


@pytest.fixture
def folder(tmp_path):
    place = tmp_path / "with blank [1]"
    place.mkdir()
    (place / "web {a}.log").write_text("\n".join(APACHE.format(n) for n in range(20)) + "\njunk\n")
    (place / "odd*name?.txt").write_text("\n".join(SYSLOG.format(n) for n in range(5)))
    (place / "100%.log").write_text("# c\n" + SYSLOG.format(1))
    (place / "empty.log").write_text("")
    (place / "prose.txt").write_text("nothing\nto see\n" * 8)
    (place / "events.log").write_text("<Events>\n" + "".join(EVENT.format(n) for n in range(3)) + "</Events>")
    return place


def test_bad_files_do_not_stop_the_rest(spark, folder):
    hints = {str(folder / "100%.log"): "nothing", str(folder / "absent.log"): "auth", "odd://x/y": "auth"}
    paths = [str(folder), str(folder / "gone.log"), "odd://host/logs"]
    got = ingest.parse_logs(spark, paths, hints=hints, now=NOW, year=2024)
    reasons = {(r.path.rsplit("/", 1)[-1], r.reason) for r in got.problems.collect()}
    assert {
        ("gone.log", "no such file or folder"), ("prose.txt", "no known format"),
        ("100%25.log", "unknown format: nothing"), ("absent.log", "hint fits no file"),
    } <= reasons
    assert sum("odd" in path or "scheme" in reason for path, reason in reasons) == 2 and len(reasons) == 6
    assert {r.log_type: r["count"] for r in got.entries.groupBy("log_type").count().collect()} == {"apache": 20, "syslog": 5, "windows": 3}
    assert sorted(names(got.files.where("reason IS NULL").collect())) == ["events.log", "odd*name%3F.txt", "web%20%7Ba%7D.log"]
    assert sorted(got.unparsed_files) == got.unparsed_files and len(got.unparsed_files) == 2


def test_files_by_name_pattern_and_twice(spark, folder):
    by_name = [str(folder / "web {a}.log"), str(folder / "odd*name?.txt")]
    assert ingest.parse_logs(spark, by_name, now=NOW, year=2024).entries.count() == 25
    assert ingest.parse_logs(spark, [str(folder), *by_name, str(folder)], now=NOW, year=2024).entries.count() == 29
    pattern = str(folder).replace("[", "\\[").replace("]", "\\]") + "/web*"
    assert ingest.parse_logs(spark, pattern, now=NOW, year=2024).entries.count() == 20
    assert ingest.parse_logs(spark, str(folder.parent), recursive=True, now=NOW, year=2024).entries.count() == 29
    assert ingest.parse_logs(spark, str(folder.parent), now=NOW, year=2024).entries.count() == 0


def test_xml_files(spark, folder):
    got = ingest.parse_logs(spark, str(folder / "events.log"), now=NOW)
    rows = got.entries.orderBy("ts").collect()
    assert [(r.user, r.source_ip, r.action, r.log_type) for r in rows] == [(f"u{n}", "9.9.9.9", "logon_failure", "windows") for n in range(3)]
    assert got.files.first().format == "windows_xml" and got.problems.count() == 0


def test_unreadable_files(spark, tmp_path):
    (tmp_path / "a.log").write_text(SYSLOG.format(1))
    (tmp_path / "broken.gz").write_bytes(b"not a gzip file")
    with gzip.open(tmp_path / "good.gz", "wt") as out:
        out.write("\n".join(SYSLOG.format(n) for n in range(7)))
    paths = [str(tmp_path / n) for n in ("a.log", "broken.gz", "good.gz")]
    got = ingest.parse_logs(spark, paths, now=NOW, year=2024)
    assert got.entries.count() == 8
    (row,) = got.problems.collect()
    assert row.path.endswith("broken.gz") and row.reason


def test_line_numbers_over_many_splits(spark, tmp_path):
    lines = [SYSLOG.format(n) if n % 3 else ("" if n % 2 else f"bad line {n} " + "x" * 300) for n in range(4000)]
    (tmp_path / "a.log").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.log").write_text("\n".join(reversed(lines)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = ingest.parse_logs(spark, str(tmp_path), fmt="syslog", now=NOW, year=2024)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    errors = sorted((r.file_path[-5], r.line_number, r.line, r.error) for r in got.errors.collect())
    want = [("a", n + 1, line[:200], "no pattern matched") for n, line in enumerate(lines) if line.startswith("bad")]
    want += [("b", n + 1, line[:200], "no pattern matched") for n, line in enumerate(reversed(lines)) if line.startswith("bad")]
    assert errors == sorted(want)
    stats = {r.file_path[-5]: (r.lines_processed, r.lines_parsed, r.parse_errors) for r in got.stats.collect()}
    bad = sum(line.startswith("bad") for line in lines)
    assert stats == {name: (4000, 4000 - bad - lines.count(""), bad) for name in "ab"}


def test_text_is_scanned_once(spark, folder, monkeypatch):
    scans = []
    read = ingest._read
    monkeypatch.setattr(ingest, "_read", lambda *a: scans.append(a[3]) or read(*a))
    result, parsed = analyze_logs(spark, str(folder), now=NOW, year=2024)
    assert scans == ["binaryFile", "text"]
    for table in (result.entries, parsed.entries, parsed.stats, parsed.errors):
        plan = table._jdf.queryExecution().toString()
        assert "FileScan text" not in plan and "LeftAnti" not in plan


def test_heads_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "HEADS_PER_TASK", 10)
    for n in range(100):
        (tmp_path / f"{n}.log").write_text(SYSLOG.format(n))
    files = ingest.log_files(spark, str(tmp_path))
    assert ingest.sample_lines(files, 100).rdd.getNumPartitions() == 11
    assert ingest.detect_formats(ingest.sample_lines(files)).where("format = 'syslog'").count() == 100


def test_own_formats_next_to_others(spark, folder):
    def parse_own(lines, now=None, year=None):
        return conform_entries(
            lines.where("startswith(line, 'OWN|')").selectExpr("file_path", "line_seq", f"TIMESTAMP '{now}' AS ts", "'own' AS log_type", "line AS raw_line")
        )

    (folder / "own.log").write_text("OWN|a\nOWN|b\n# no\nx\n")
    formats = ingest.Formats().register_parser("own", parse_own, "startswith(line, 'OWN|')")
    got = ingest.parse_logs(spark, str(folder), formats=formats, now=NOW, year=2024)
    assert got.entries.where("log_type = 'own'").count() == 2
    (row,) = got.stats.where("log_type = 'own'").collect()
    assert (row.lines_processed, row.lines_parsed, row.parse_errors) == (4, 2, 1)
    assert [(r.line_number, r.line) for r in got.errors.where("file_path LIKE '%own.log'").collect()] == [(4, "x")]


def test_no_files(spark, tmp_path):
    got = ingest.parse_logs(spark, [str(tmp_path), str(tmp_path / "gone")], now=NOW)
    assert got.entries.count() == got.stats.count() == got.errors.count() == got.files.count() == 0
    assert [r.reason for r in got.problems.collect()] == ["no such file or folder"]
