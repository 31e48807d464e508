import random
from collections import defaultdict
from datetime import timedelta

import pytest

from logvigil.operators import auth, skew
from logvigil.operators.auth import AuthConfig
from tests.conftest import T0


def failure(ip, user, at, **more):
    return {
        "source_ip": ip, "user": user, "at": at, "action": "ssh_failure", "status_code": 0,
        "message": f"Failed password for {user} from {ip}", **more,
    }


def success(ip, user, at):
    return {"source_ip": ip, "user": user, "at": at, "action": "ssh_success", "status_code": 1, "message": "Accepted password"}


def by_type(alerts):
    out = defaultdict(list)
    for row in alerts.collect():
        out[row.threat_type].append(row)
    return out


def test_guessing_from_one_ip(entries_of):
    rows = [failure("45.33.32.156", "admin", i) for i in range(10)]
    found = by_type(auth.auth_alerts(entries_of(rows)))
    (alert,) = found["brute_force"]
    assert (alert.source_ip, alert.target, alert.level) == ("45.33.32.156", "admin", "LOW")
    assert alert.mitre_attack == ["T1110.001"]
    assert alert.evidence_count == 10
    assert '"attempt_count":10' in alert.metadata
    assert not found["credential_stuffing"]


def test_stuffing(entries_of):
    rows = [failure("77.88.55.66", user, i) for i, user in enumerate(["john", "jane", "admin", "root", "test"])]
    (alert,) = by_type(auth.auth_alerts(entries_of(rows)))["credential_stuffing"]
    assert (alert.target, alert.level) == ("5 accounts", "HIGH")
    assert '"targeted_users":["admin","jane","john","root","test"]' in alert.metadata


def test_distributed(entries_of):
    rows = [failure(f"10.0.0.{i}", "developer", i) for i in range(11)]
    (alert,) = by_type(auth.auth_alerts(entries_of(rows)))["distributed_brute_force"]
    assert (alert.source_ip, alert.target) == ("11 IPs", "developer")
    assert alert.ts_local == T0 + timedelta(seconds=10)


def test_levels_and_compromise(entries_of):
    rows = [failure("1.1.1.1", "a", i) for i in range(20)] + [failure("1.1.1.2", "b", i) for i in range(50)]
    rows += [failure("1.1.1.3", "c", i) for i in range(5)] + [success("1.1.1.3", "c", 100)]
    levels = {a.target: a for a in by_type(auth.auth_alerts(entries_of(rows)))["brute_force"]}
    assert {t: a.level for t, a in levels.items()} == {"a": "MEDIUM", "b": "HIGH", "c": "CRITICAL"}
    assert levels["c"].description.endswith("SUCCESSFUL LOGIN DETECTED AFTER ATTACK")
    assert levels["c"].recommendations[0] == "URGENT: Force password reset for user 'c'"
    assert '"success_after":true' in levels["c"].metadata


def test_unnamed_accounts_guess_but_do_not_stuff(entries_of):
    rows = [failure("1.1.1.1", None, i) for i in range(6)] + [failure("1.1.1.1", u, 7) for u in ("x", "y")]
    found = by_type(auth.auth_alerts(entries_of(rows)))
    assert [a.target for a in found["brute_force"]] == ["unknown"]
    assert not found["credential_stuffing"]


def test_user_names_may_hold_colons(entries_of):
    rows = [failure("1.1.1.1", "a:b", i) for i in range(5)]
    (alert,) = by_type(auth.auth_alerts(entries_of(rows)))["brute_force"]
    assert (alert.source_ip, alert.target) == ("1.1.1.1", "a:b")


def test_window_ends_with_last_failure(entries_of):
    burst = [failure("1.1.1.1", "a", i) for i in range(30)]
    late = [failure("1.1.1.1", "a", 3600 + i) for i in range(4)]
    assert not by_type(auth.auth_alerts(entries_of(burst + late)))["brute_force"]
    edge = [failure("1.1.1.2", "a", 0)] + [failure("1.1.1.2", "a", 600 - i) for i in range(4)]
    (alert,) = by_type(auth.auth_alerts(entries_of(edge)))["brute_force"]
    assert '"attempt_count":5' in alert.metadata


def sequential(rows, minutes):
    """A plain model: per pair the failures kept in the window, after every failure."""
    kept = defaultdict(list)
    trailing = {}
    for row in sorted(rows, key=lambda r: (r["at"], r["line_seq"])):
        key = (row["source_ip"], row["user"] or "unknown")
        kept[key] = [t for t in kept[key] if t >= row["at"] - minutes * 60] + [row["at"]]
        trailing[row["line_seq"]] = len(kept[key])
    return trailing, {key: len(times) for key, times in kept.items()}


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot_keys", [0, 2, 256])
def test_counts_equal_the_sequential_model(entries_of, monkeypatch, seed, hot_keys):
    """With a pair that holds a third of the rows, and with any share of keys answered by broadcast."""
    monkeypatch.setattr(skew, "HOT_KEYS", hot_keys)
    rng = random.Random(seed)
    rows = []
    for seq in range(600):
        hot = rng.random() < 1 / 3
        ip = "9.9.9.9" if hot else f"1.1.1.{rng.randrange(5)}"
        user = "root" if hot else rng.choice(["a", "b", None, ""])
        rows.append(failure(ip, user, rng.randrange(0, 3 * 3600, 7), line_seq=seq))
    trailing, final = sequential(rows, 10)
    entries = entries_of(rows)
    got = {r.line_seq: r.trailing_count for r in auth.trailing_failures(entries).select("line_seq", "trailing_count").collect()}
    assert got == trailing
    pairs = auth.pair_windows(auth.login_outcomes(entries)).collect()
    assert {(r.source_ip, r.account): r.attempt_count for r in pairs} == final


def test_evidence_is_the_newest_in_the_window(entries_of):
    rows = [failure("1.1.1.1", "a", i, line_seq=i) for i in range(25)]
    (alert,) = by_type(auth.auth_alerts(entries_of(rows)))["brute_force"]
    assert [e.line_seq for e in alert.evidence] == list(range(15, 25))
    assert all(len(e.entry_hash) == 16 for e in alert.evidence)


def test_failed_words_count_in_any_log(entries_of):
    rows = [
        {"source_ip": "1.1.1.1", "user": "a", "at": i, "log_type": "apache", "message": "GET /login-FAILED"} for i in range(5)
    ]
    assert len(by_type(auth.auth_alerts(entries_of(rows)))["brute_force"]) == 1
    rows = [{"source_ip": "1.1.1.1", "user": "a", "at": i, "log_type": "apache", "status_code": 401} for i in range(9)]
    assert auth.auth_alerts(entries_of(rows)).count() == 0


def test_only_requested_kinds(entries_of):
    rows = [failure("1.1.1.1", u, i) for u in "abc" for i in range(6)]
    found = by_type(auth.auth_alerts(entries_of(rows), AuthConfig(), ("credential_stuffing",)))
    assert set(found) == {"credential_stuffing"}
