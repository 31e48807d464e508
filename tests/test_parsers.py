import hashlib
from datetime import datetime

import pytest

from logvigil.operators import web
from logvigil.plans.analysis import analyze_logs
from logvigil.sources import apache, auth, ingest, nginx, syslog, windows

NOW = datetime(2024, 6, 1)
APACHE = '192.168.1.100 - admin [10/Oct/2023:13:55:36 -0700] "GET /admin HTTP/1.1" 200 2326 "-" "Mozilla/5.0"'


def one(parse, lines, line):
    rows = parse(lines([line]), now=NOW, year=2024).collect()
    assert len(rows) <= 1
    return rows[0] if rows else None


def test_apache_combined(lines_of):
    e = one(apache.parse_apache, lines_of, APACHE)
    assert (e.source_ip, e.user, e.action, e.resource, e.status_code, e.log_type) == (
        "192.168.1.100", "admin", "GET", "/admin", 200, "apache",
    )
    assert (e.ts, e.ts_local, e.tz_offset) == (datetime(2023, 10, 10, 20, 55, 36), datetime(2023, 10, 10, 13, 55, 36), "-07:00")
    assert (e.referer, e.user_agent, e.message) == ("-", "Mozilla/5.0", "GET /admin")
    text = "2023-10-10 13:55:36-07:00" + "192.168.1.100" + "GET /admin" + APACHE
    assert e.entry_hash == hashlib.sha256(text.encode()).hexdigest()[:16]


def test_apache_common(lines_of):
    e = one(apache.parse_apache, lines_of, '10.0.0.1 - - [10/Oct/2023:13:55:36 +0000] "POST /login HTTP/1.1" 401 128')
    assert (e.source_ip, e.user, e.action, e.status_code, e.referer) == ("10.0.0.1", None, "POST", 401, None)


def test_apache_times(lines_of):
    line = '10.0.0.1 - - [{}] "GET / HTTP/1.1" 200 -'
    e = one(apache.parse_apache, lines_of, line.format("1/Feb/2024:01:02:03"))
    assert (e.ts, e.tz_offset, e.ts_fallback) == (datetime(2024, 2, 1, 1, 2, 3), None, False)
    e = one(apache.parse_apache, lines_of, line.format("soon"))
    assert (e.ts, e.ts_fallback, e.metadata["response_size"]) == (NOW, True, "0")
    assert one(apache.parse_apache, lines_of, "no log line") is None


def test_a_line_with_the_mark_character_is_parsed_alike(lines_of):
    e = one(apache.parse_apache, lines_of, APACHE.replace("/admin", "/ad\uffffmin"))
    assert (e.resource, e.user_agent) == ("/ad\uffffmin", "Mozilla/5.0")


def test_nginx(lines_of):
    line = '10.0.0.1 - - [01/Jan/2024:12:00:00 +0000] "GET /api/users HTTP/1.1" 200 1234 "-" "curl/7.68.0"'
    e = one(nginx.parse_nginx, lines_of, line)
    assert (e.source_ip, e.action, e.resource, e.status_code, e.log_type) == ("10.0.0.1", "GET", "/api/users", 200, "nginx")
    e = one(nginx.parse_nginx, lines_of, line + ' "203.0.113.7, 10.0.0.1"')
    assert (e.source_ip, e.metadata["original_ip"]) == ("203.0.113.7", "10.0.0.1")
    e = one(nginx.parse_nginx, lines_of, "2024/01/15 10:00:00 [error] 12#3: *45 open() failed, client: 10.1.2.3, server: x")
    assert (e.source_ip, e.action, e.log_type, e.resource) == ("10.1.2.3", "ERROR", "nginx_error", None)
    assert (e.metadata["level"], e.metadata["connection_id"]) == ("error", "45")


def test_syslog(lines_of):
    e = one(syslog.parse_syslog, lines_of, "Jan 15 10:23:45 webserver sshd[12345]: Connection from 192.168.1.50 port 22")
    assert (e.hostname, e.process, e.source_ip, e.ts) == ("webserver", "sshd", "192.168.1.50", datetime(2024, 1, 15, 10, 23, 45))
    assert (e.metadata["facility"], e.metadata["severity"]) == ("user", "notice")
    e = one(syslog.parse_syslog, lines_of, "<34>1 2024-01-15T10:23:45.003Z web sshd 12345 - - Accepted publickey for bob")
    assert (e.metadata["facility"], e.metadata["severity"], e.message) == ("auth", "critical", "- Accepted publickey for bob")
    assert (e.ts, e.user, e.action) == (datetime(2024, 1, 15, 10, 23, 45, 3000), "bob", "sshd")
    e = one(syslog.parse_syslog, lines_of, "Feb 30 10:23:45 web something odd")
    assert (e.action, e.ts_fallback, e.ts) == ("syslog", True, NOW)


@pytest.mark.parametrize(
    "message, user, action, status, ip",
    [
        ("sshd[1]: Failed password for invalid user admin from 192.168.1.100 port 22 ssh2", "admin", "ssh_failure", 0, "192.168.1.100"),
        ("sshd[1]: Accepted publickey for ubuntu from 10.0.0.5 port 52341 ssh2", "ubuntu", "ssh_success", 1, "10.0.0.5"),
        ("sudo: developer : TTY=pts/0 ; PWD=/home ; USER=root ; COMMAND=/bin/ls", "developer", "sudo_success", 1, None),
        ("sshd[1]: Connection closed by 10.0.0.5 port 22", None, "other", None, "10.0.0.5"),
        ("sudo: pam_unix(sudo:auth): authentication failure; logname=a ruser=a rhost= user=alice", "alice", "pam_auth", 0, None),
        ("sshd[1]: Accepted password for x from 1.1.1.1 port 1 pam_unix(sshd:session): session closed for user y", "y", "session_close", 1, "1.1.1.1"),
    ],
)
def test_auth(lines_of, message, user, action, status, ip):
    e = one(auth.parse_auth, lines_of, f"Jan 15 10:23:45 server {message}")
    assert (e.user, e.action, e.status_code, e.source_ip) == (user, action, status, ip)


def test_windows_lines(lines_of):
    e = one(windows.parse_windows, lines_of, "1/15/2024 8:00:00 PM Information Microsoft-Windows-Security-Auditing 4625 Logon")
    assert (e.action, e.status_code, e.event_id, e.ts) == ("logon_failure", 4625, 4625, datetime(2024, 1, 15, 20))
    assert e.metadata["task_category"] == "Logon"
    assert one(windows.parse_windows, lines_of, "1/15/2024 8:00:00 PM Audit Failure Microsoft 4625 Logon") is None
    e = one(windows.parse_windows, lines_of, "Information,1/15/2024 8:00:00 AM,Security,4720,x")
    assert (e.action, e.ts) == ("account_management", datetime(2024, 1, 15, 8))


XML = (
    '<Event{ns}><System><EventID Qualifiers="0">4625</EventID><TimeCreated SystemTime="2024-01-15T08:00:00.1234567Z"/>'
    "<Computer>pc</Computer></System><EventData>"
    '<Data Name="TargetUserName">bob</Data><Data Name="IpAddress">10.0.0.9</Data><Data Name="LogonType">{logon}</Data>'
    '<Data Name="Status">0x0</Data><Data Name="SubStatus">0xC0000064</Data><Data Name="X">1</Data><Data Name="X">2</Data>'
    "</EventData></Event>"
)


def test_windows_xml(lines_of, spark, tmp_path):
    spaced = XML.format(ns=' xmlns="http://schemas.microsoft.com/win/2004/08/events/event"', logon=3)
    prefixed = XML.format(ns="", logon=10).replace("<", "<e:").replace("<e:/", "</e:")
    text = "<Events>" + spaced + XML.format(ns="", logon="x") + prefixed + "</Events>"
    rows = sorted(windows.parse_windows_xml(lines_of([text]), now=NOW).collect(), key=lambda r: r.metadata["logon_type"])
    assert [r.metadata["logon_type"] for r in rows] == ["Network (SMB, shared folders)", "RemoteInteractive (RDP)"]
    for e in rows:
        assert (e.source_ip, e.user, e.action, e.hostname) == ("10.0.0.9", "bob", "logon_failure", "pc")
        assert e.message == "Event 4625: logon_failure - User: bob from 10.0.0.9"
        assert e.metadata["failure_reason"] == "User does not exist" and e.metadata["X"] == "2"
        assert e.ts == datetime(2024, 1, 15, 8, 0, 0, 123456)
    (tmp_path / "events.xml").write_text("<Events>" + spaced + spaced + "</Events>")
    read = windows.read_windows_xml(spark, str(tmp_path / "events.xml"), now=NOW).collect()
    assert [(e.user, e.event_id) for e in read] == [("bob", 4625)] * 2


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "web.log").write_text("# comment\n\n" + (APACHE + "\n") * 30 + "junk\n")
    (tmp_path / "err.txt").write_text("2024/01/15 10:00:00 [error] 12#3: *45 failed, client: 10.1.2.3\r\n" * 3)
    (tmp_path / "secure").write_text("Jan 15 10:23:45 server sshd[1]: Failed password for admin from 1.2.3.4 port 22 ssh2\n")
    (tmp_path / "blank.log").write_text("\n\n")
    (tmp_path / "notes.md").write_text(APACHE)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "win.log").write_text("1/15/2024 8:00:00 PM Information Src 4625 Logon\n    An account\n")
    return tmp_path


def test_files_are_found_told_apart_and_parsed(spark, folder):
    got = ingest.parse_logs(spark, str(folder), now=NOW, year=2024)
    stats = {r.file_path.rsplit("/", 1)[1]: (r.log_type, r.lines_processed, r.lines_parsed, r.parse_errors) for r in got.stats.collect()}
    assert stats == {"web.log": ("apache", 33, 30, 1), "err.txt": ("nginx", 3, 3, 0), "secure": ("syslog", 1, 1, 0)}
    assert [p.rsplit("/", 1)[1] for p in got.unparsed_files] == ["blank.log"]
    assert [(r.line, r.error) for r in got.errors.collect()] == [("junk", "no pattern matched")]
    assert got.entries.count() == 34
    web = got.entries.where("log_type = 'apache'").orderBy("line_seq").collect()
    assert [e.line_seq for e in web] == list(range(2, 32))


def test_hints_and_recursion(spark, folder):
    hints = {str(folder / "secure"): "auth", str(folder / "blank.log"): "auth"}
    got = ingest.parse_logs(spark, str(folder), hints=hints, recursive=True, now=NOW, year=2024)
    types = {r.file_path.rsplit("/", 1)[1]: r.log_type for r in got.stats.collect()}
    assert types["secure"] == "auth" and types["win.log"] == "windows"
    assert got.entries.where("log_type = 'auth'").first().action == "ssh_failure"
    one_file = ingest.parse_logs(spark, str(folder / "notes.md"), fmt="apache", now=NOW)
    assert one_file.entries.count() == 1
    with pytest.raises(ValueError):
        ingest.parse_logs(spark, str(folder), fmt="nothing")


def test_files_to_alerts(spark, folder):
    lines = "".join(f"Jan 15 10:23:{n:02d} server sshd[1]: Failed password for admin from 1.2.3.4 port 22 ssh2\n" for n in range(20))
    (folder / "secure").write_text(lines)
    hints = {str(folder / "secure"): "auth"}
    result, parsed = analyze_logs(spark, str(folder), hints=hints, now=NOW, year=2024)
    (alert,) = result.alerts.collect()
    assert (alert.threat_type, alert.source_ip, alert.target, alert.level) == ("brute_force", "1.2.3.4", "admin", "MEDIUM")
    assert parsed.entries.count() == 53
    assert "PartitionFilters: [log_type" in web.web_matches(parsed.entries)._jdf.queryExecution().executedPlan().toString()


def test_scan_numbers_lines_along_the_file(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {n}\n" for n in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines = ingest.scan_lines(spark, str(tmp_path))
        assert [r.line for r in lines.orderBy("line_seq").collect()] == [f"line {n}" for n in range(5000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_format_detection(spark, lines_of):
    def told(*lines):
        return ingest.detect_formats(ingest.first_lines(lines_of(list(lines)))).first()["format"]

    assert told(APACHE, APACHE) == "apache"
    assert told("Jan 15 10:23:45 server sshd[1]: x") == "syslog"
    assert told("#c", "#c", APACHE) is None
    assert told("") is None
    assert told("<Event>", "x", "x") == "windows"
