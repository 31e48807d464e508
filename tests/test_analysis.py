import csv
import json
from datetime import datetime

import pytest

from logvigil.operators import reports, skew
from logvigil.plans.analysis import Settings, analyze
from logvigil.sources import sinks
from tests.conftest import T0
from tests.test_auth import failure
from tests.test_web import request


@pytest.fixture(scope="module")
def attacked(entries_of):
    rows = [failure("6.6.6.6", u, i, line_seq=i) for i, u in enumerate(["a", "b", "c"])]
    rows += [request("/p?x=limit+1,2", source_ip="6.6.6.6", at=10, line_seq=10)]
    rows += [request("/robots.txt", source_ip="7.7.7.7", at=20 + i, status_code=404, line_seq=20 + i) for i in range(3)]
    rows += [request("/robots.txt", source_ip="7.7.7.7", at=90, status_code=404, line_seq=30)]
    rows += [request("/ok", source_ip="8.8.8.8", at=99, line_seq=40)]
    return entries_of(rows)


@pytest.fixture(scope="module")
def result(attacked):
    return analyze(attacked)


@pytest.mark.parametrize("hot_keys", [0, 256])
def test_correlation_raises_multi_vector_ips(attacked, monkeypatch, hot_keys):
    monkeypatch.setattr(skew, "HOT_KEYS", hot_keys)
    found = analyze(attacked).correlated.collect()
    sqli = next(a for a in found if a.threat_type == "sql_injection")
    assert (sqli.level, sqli.coordinated_attack, sqli.attack_vectors) == ("HIGH", True, ["credential_stuffing", "sql_injection"])
    assert sqli.description.endswith(" (Part of multi-vector attack)")
    lone = [a for a in found if a.source_ip == "7.7.7.7"]
    assert len(lone) == 4 and all(a.level == "MEDIUM" and not a.coordinated_attack and a.attack_vectors is None for a in lone)


def test_duplicates_within_a_minute_keep_the_first(result):
    kept = [a for a in result.alerts.collect() if a.source_ip == "7.7.7.7"]
    assert sorted(a.line_seq for a in kept) == [20, 30]


def test_ids_and_order(result):
    ranked = result.ranked().collect()
    assert [a.level_value for a in ranked] == sorted((a.level_value for a in ranked), reverse=True)
    assert all(len(a.alert_id) == 12 for a in ranked)
    assert len({a.alert_id for a in ranked}) == len(ranked)


def test_reports(result):
    assert {r.level: r.alerts for r in reports.severity_summary(result.alerts).collect()} == {
        "CRITICAL": 0, "HIGH": 2, "MEDIUM": 2, "LOW": 0, "INFO": 0,
    }
    bars = {r.level: (r.percent, r.bar) for r in reports.severity_distribution(result.alerts).collect()}
    assert bars["HIGH"] == (50.0, 25) and bars["INFO"] == (0.0, 0)
    assert [(r.source_ip, r.alerts) for r in reports.top_attackers(result.alerts).collect()] == [("6.6.6.6", 2), ("7.7.7.7", 2)]
    (row,) = result.summary().collect()
    assert (row.total_alerts, row.high, row.medium, row.unique_attackers, row.has_critical) == (4, 2, 2, 2, False)
    (row,) = result.totals().collect()
    assert (row.total_entries, row.unique_source_ips, row.total_alerts, row.unique_attackers) == (9, 3, 4, 2)
    assert row.first_ts == T0
    stats = {r.detector: (r.total_alerts, r.entries_analyzed) for r in result.detector_stats().collect()}
    without = {name: (0, 9) for name in ("xss", "temporal_anomaly", "geo_anomaly")}
    assert stats == {"brute_force": (1, 9), "sql_injection": (1, 9), "directory_traversal": (4, 9), **without}
    shown = reports.top_alerts_per_level(result.alerts, 1).collect()
    assert sorted((r.level, r.place, r.not_shown) for r in shown) == [("HIGH", 1, 1), ("MEDIUM", 1, 1)]
    assert reports.recommendations(result.alerts, 3).count() == 3
    assert result.at_least("HIGH").count() == 2


def test_selected_and_own_detectors(attacked):
    def odd(entries):
        return entries.where("resource = '/ok'").selectExpr(
            "ts", "source_ip", "'odd' AS threat_type", "'info' AS level", "'odd request' AS description"
        )

    settings = Settings().register_detector("odd", odd).enable("odd", "xss")
    (alert,) = analyze(attacked, settings).alerts.collect()
    assert (alert.detector, alert.level, alert.evidence_count) == ("odd", "INFO", 0)
    with pytest.raises(ValueError):
        analyze(attacked, Settings().enable("nothing"))
    assert analyze(attacked, Settings(detectors=())).alerts.count() == 0


def test_no_entries(entries_of):
    result = analyze(entries_of([]))
    assert result.alerts.count() == 0
    (row,) = result.summary().collect()
    assert (row.total_alerts, row.has_critical) == (0, False)


def test_exports(result, tmp_path):
    sinks.write_json(result.alerts, str(tmp_path / "json"))
    records = [json.loads(line) for f in (tmp_path / "json").glob("*.json") for line in f.read_text().splitlines()]
    assert len(records) == 4
    stuffing = next(r for r in records if r["threat_type"] == "credential_stuffing")
    assert stuffing["timestamp"] == "2024-01-15T10:00:02" and stuffing["evidence_count"] == 3
    assert "target" in stuffing and stuffing["attack_vectors"] == ["credential_stuffing", "sql_injection"]
    sinks.write_csv(result.alerts, str(tmp_path / "csv"))
    rows = [row for f in (tmp_path / "csv").glob("*.csv") for row in csv.DictReader(f.open(newline=""))]
    assert len(rows) == 4 and list(rows[0]) == [
        "alert_id", "timestamp", "level", "threat_type", "source_ip", "target", "description",
    ]
    sinks.write_report({"types": reports.type_summary(result.alerts)}, str(tmp_path / "report"))
    assert (tmp_path / "report" / "types").is_dir()
    assert datetime.fromisoformat(rows[0]["timestamp"]).year == 2024
