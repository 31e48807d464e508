import random
import re
from urllib.parse import unquote, unquote_plus

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from logvigil.functions import payload
from logvigil.functions.signatures import SENSITIVE_FILES, SQLI, XSS
from logvigil.operators import skew, web


def request(resource, **more):
    return {"source_ip": "45.33.32.156", "action": "GET", "resource": resource, "log_type": "apache", **more}


@pytest.mark.parametrize(
    "resource, pattern, level",
    [
        ("/search?q=1'+UNION+SELECT+username,password+FROM+users--", "critical_0", "CRITICAL"),
        ("/users?id=1'+OR+'1'='1", "high_0", "HIGH"),
        ("/p?id=1%2520AND%2520SLEEP(5)", "high_3", "HIGH"),
        ("/p?q=sum+(x)", "sql_function_sum", "MEDIUM"),
        ("/p?q=0x73656c65637420", "medium_0", "MEDIUM"),
        ("/p?q=0x123", "medium_4", "MEDIUM"),
        ("/page#top", "high_7", "HIGH"),
        ("/p?x=limit+1,2", "low_1", "LOW"),
    ],
)
def test_sql_injection(entries_of, resource, pattern, level):
    (alert,) = web.sql_injection_alerts(entries_of([request(resource)])).collect()
    assert (alert.threat_type, alert.level, alert.target) == ("sql_injection", level, resource)
    assert f'"pattern_matched":"{pattern}"' in alert.metadata


def test_plain_requests_are_quiet(entries_of):
    entries = entries_of([request("/api/users?page=1&limit=10"), request("/x' or 1=1", log_type="syslog"), request(None)])
    assert web.sql_injection_alerts(entries).count() == 0
    assert web.xss_alerts(entries).count() == 0
    assert web.traversal_alerts(entries).count() == 0


def test_referer_and_agent_are_looked_at_in_order(entries_of):
    rows = [
        request("/a", referer="x' or 1=1", user_agent="<script>"),
        request("/b", referer="-", user_agent="sleep (1)"),
        request("/c", referer="<script>"),
    ]
    sqli = {a.target: a.description for a in web.sql_injection_alerts(entries_of(rows)).collect()}
    assert " in referer: " in sqli["/a"] and " in user_agent: " in sqli["/b"]
    xss = {a.target: a.description for a in web.xss_alerts(entries_of(rows)).collect()}
    assert " in user_agent: " in xss["/a"] and " in referer: " in xss["/c"]


@pytest.mark.parametrize(
    "resource, level",
    [
        ("/search?q=<script>alert('XSS')</script>", "CRITICAL"),
        ("/profile?name=<img+src=x+onerror=alert(1)>", "CRITICAL"),
        ("/p?q=%26lt%3Biframe", "MEDIUM"),
        ("/p?q=setTimeout(1)", "HIGH"),
        ("/p?online=1", "CRITICAL"),
    ],
)
def test_xss(entries_of, resource, level):
    (alert,) = web.xss_alerts(entries_of([request(resource)])).collect()
    assert (alert.threat_type, alert.level) == ("xss", level)


@pytest.mark.parametrize(
    "resource, status, level, text",
    [
        ("/files/../../../etc/passwd", 200, "CRITICAL", "SUCCESSFUL Directory traversal attempt: /etc/passwd"),
        ("/files?path=%2e%2e%2f%2e%2e%2fetc%2fpasswd", 403, "CRITICAL", "Directory traversal attempt: /etc/passwd"),
        ("/.env", 200, "CRITICAL", "SUCCESSFUL Sensitive file access attempt: .env"),
        ("/..%255c..%255cx", 404, "MEDIUM", "Directory traversal attempt: /../../x"),
        ("/robots.txt", 200, "HIGH", "SUCCESSFUL Sensitive file access attempt: robots.txt"),
        ("/var/log/x", 304, "CRITICAL", "SUCCESSFUL Sensitive file access attempt: /var/log/"),
        ("/var/log/x", None, "HIGH", "Sensitive file access attempt: /var/log/"),
        ("/x%2500y/web.config", 404, "MEDIUM", "Sensitive file access attempt: web.config"),
    ],
)
def test_traversal(entries_of, resource, status, level, text):
    (alert,) = web.traversal_alerts(entries_of([request(resource, status_code=status)])).collect()
    assert (alert.level, alert.description) == (level, text)


@pytest.mark.parametrize("hot_keys", [0, 256])
def test_repeat_offenders_are_raised(entries_of, monkeypatch, hot_keys):
    monkeypatch.setattr(skew, "HOT_KEYS", hot_keys)
    rows = [request("/p?x=limit+1,2", source_ip="1.1.1.1") for _ in range(3)]
    rows += [request("/p?x=limit+1,2", source_ip="1.1.1.2") for _ in range(2)]
    rows += [request("/p?x=limit+1,2", source_ip=None) for _ in range(4)]
    levels = sorted((a.source_ip or "", a.level, a.description[-10:]) for a in web.sql_injection_alerts(entries_of(rows)).collect())
    assert [x[:2] for x in levels] == [("", "LOW")] * 4 + [("1.1.1.1", "HIGH")] * 3 + [("1.1.1.2", "LOW")] * 2
    assert levels[4][2] == " campaign)"


def one_column(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, x string")
    return [r.y for r in df.selectExpr("n", f"{expression} AS y").orderBy("n").collect()]


ALPHABET = st.sampled_from(list("%+2f5eE0a'<;&#xab \\/.é\n") + ["%2e", "%c0%ae", "%25", "%C3%A9", "0x41", "&lt;", "%00"])


@given(st.lists(st.lists(ALPHABET, max_size=12).map("".join), min_size=30, max_size=60))
@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
def test_decoding_equals_the_standard_library(spark, texts):
    def repeat(decode, text, times):
        for _ in range(times):
            text = decode(text)
        return text

    assert one_column(spark, texts, payload.url_decode("x", 3)) == [repeat(unquote_plus, t, 3) for t in texts]
    assert one_column(spark, texts, payload.url_decode("x", 5, keep_plus=True)) == [repeat(unquote, t, 5) for t in texts]


def test_hex_runs(spark):
    texts = ["a0x4142b", "0x414", "0xff41", "x", "0x41 and 0x42"]
    assert one_column(spark, texts, payload.sqli_text("x")) == ["a0x4142b", "0x414", "a", "x", "a and b"]


def test_first_match_equals_a_plain_search(spark):
    rng = random.Random(3)
    words = ["union", "select", " ", "'", "or", "1=1", "--", "<script", ">", "onload", "=", "eval(", "/etc/passwd", "../", "limit 1,2",
             "order by 3", "drop ", ";", "config.php", "sleep", "(", ")", "and", "'1'", "data:text/html", "&#x3c;", "having 1=1", "char(7)"]
    texts = ["".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) for _ in range(300)]

    def first(patterns, text):
        for severity, listed in patterns.items():
            for i, pattern in enumerate(listed):
                match = re.search(pattern, text, re.IGNORECASE)
                if match:
                    return (severity, f"{severity}_{i}", match.group())

    for patterns in (SQLI, XSS, SENSITIVE_FILES):
        chain = payload.bind("d", "x", payload._first_match("d", patterns))
        got = [tuple(r) if r else None for r in one_column(spark, texts, chain)]
        assert got == [first(patterns, t) for t in texts]
