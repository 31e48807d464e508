"""Parser queries.

Each builds raw log lines from fields of the given tables, and parses them. The SQL
counterpart knows the fields and needs no parsing, so it is independent of the patterns.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logvigil.operators import auth
from logvigil.plans.analysis import Settings, analyze
from logvigil.schema import ENTRY_HASH
from logvigil.session import shared_dir, stage
from logvigil.sources import apache, auth as auth_logs, ingest, nginx, sinks, syslog, windows
from workload import oracle as O
from workload.adapters import _DUCK, _SPARK, auth_entries, table, web_entries
from workload.queries import AUTH, EVERY, ORACLES, _analysis, register

NOW = datetime(2024, 6, 1)
NOW_DUCK = "TIMESTAMP '2024-06-01 00:00:00'"
YEAR = 2024
STAMP = "date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS') AS ts"


def _spark(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql.format(source="{source}", **_SPARK), source=table(spark, sf_dir, name))


def _duck(sql: str, name: str) -> str:
    return sql.format(source=name, **_DUCK)


def p2(value: str) -> str:
    return f"lpad(CAST({value} AS {{string}}), 2, '0')"


# -- web servers --------------------------------------------------------------------------

HTTP_FIELDS = """SELECT page_id AS line_seq, concat('10.1.0.', CAST(page_id % 23 AS {string})) AS ip,
  CASE WHEN page_id % 3 <> 0 THEN concat('user', CAST(page_id % 5 AS {string})) END AS who,
  1 + page_id % 28 AS d, page_id % 24 AS h, page_id % 60 AS mi, (page_id * 7) % 60 AS s,
  CASE page_id % 3 WHEN 0 THEN '-0500' WHEN 1 THEN '+0000' ELSE '+0530' END AS zone,
  CASE page_id % 3 WHEN 0 THEN '-05:00' WHEN 1 THEN '+00:00' ELSE '+05:30' END AS zone_text,
  CASE page_id % 3 WHEN 0 THEN -300 WHEN 1 THEN 0 ELSE 330 END AS zone_min,
  CASE page_id % 2 WHEN 0 THEN 'GET' ELSE 'POST' END AS method,
  regexp_replace(url, '^https?://[^/]+', '') AS path, url,
  CASE page_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 401 WHEN 2 THEN 404 ELSE 500 END AS status,
  page_id * 13 AS size, page_id % 10 AS kind FROM {source}"""
_CLOCK = f"concat({p2('d')}, '/Jan/2024:', {p2('h')}, ':', {p2('mi')}, ':', {p2('s')})"
# kind 0: common format, 1: no zone, 2: unreadable time, 3: junk, 4: no size.
APACHE_LINES = f"""SELECT 'access.log' AS file_path, line_seq, CASE WHEN kind = 3 THEN concat('### ', url) ELSE
  concat(ip, ' - ', coalesce(who, '-'), ' [', CASE kind WHEN 2 THEN 'yesterday' WHEN 1 THEN {_CLOCK} ELSE concat({_CLOCK}, ' ', zone) END,
  '] "', method, ' ', path, ' HTTP/1.1" ', CAST(status AS {{string}}), ' ', CASE kind WHEN 4 THEN '-' ELSE CAST(size AS {{string}}) END,
  CASE kind WHEN 0 THEN '' ELSE concat(' "', url, '" "Mozilla/5.0 (X11)"') END) END AS line FROM ({HTTP_FIELDS})"""
_HTTP_TS = f"CASE WHEN kind = 2 THEN {NOW_DUCK} ELSE make_timestamp(2024, 1, d, h, mi, s) END"


@register(
    "parse_apache",
    f"""SELECT line_seq, strftime({_HTTP_TS} - to_minutes(CASE WHEN kind IN (1, 2) THEN 0 ELSE zone_min END), {O.STAMP}) AS ts,
  CASE WHEN kind NOT IN (1, 2) THEN zone_text END AS tz_offset, kind = 2 AS ts_fallback, ip AS source_ip, who AS user_name,
  method AS action, path AS resource, CAST(status AS INTEGER) AS status_code, method || ' ' || path AS message,
  CASE WHEN kind <> 0 THEN url END AS referer, CASE WHEN kind <> 0 THEN 'Mozilla/5.0 (X11)' END AS user_agent,
  'HTTP/1.1' AS protocol, CASE kind WHEN 4 THEN '0' ELSE CAST(size AS VARCHAR) END AS response_size
  FROM ({_duck(HTTP_FIELDS, 'pages')}) WHERE kind <> 3""",
)
def parse_apache(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = apache.parse_apache(_spark(spark, sf_dir, APACHE_LINES, "pages"), now=NOW)
    return entries.selectExpr(
        "line_seq", STAMP, "tz_offset", "ts_fallback", "source_ip", "`user` AS user_name", "action", "resource",
        "status_code", "message", "referer", "user_agent", "metadata['protocol'] AS protocol",
        "metadata['response_size'] AS response_size",
    )


# kind 1, 2: no readable time (Nginx needs the zone), 3: junk, 4: no bytes, 5: behind a proxy, 6: no request.
NGINX_LINES = f"""SELECT 'nginx.log' AS file_path, line_seq, CASE WHEN kind = 3 THEN concat('### ', url) ELSE
  concat(ip, ' - ', coalesce(who, '-'), ' [', CASE WHEN kind IN (1, 2) THEN {_CLOCK} ELSE concat({_CLOCK}, ' ', zone) END,
  '] "', CASE kind WHEN 6 THEN '' ELSE concat(method, ' ', path, ' HTTP/2.0') END, '" ', CAST(status AS {{string}}), ' ',
  CASE kind WHEN 4 THEN '-' ELSE CAST(size AS {{string}}) END, ' "', url, '" "curl/8"',
  CASE kind WHEN 5 THEN concat(' "192.0.2.', CAST(line_seq % 250 AS {{string}}), ', 10.9.9.9"') ELSE '' END) END AS line
  FROM ({HTTP_FIELDS})"""
_NGINX_TS = f"CASE WHEN kind IN (1, 2) THEN {NOW_DUCK} ELSE make_timestamp(2024, 1, d, h, mi, s) - to_minutes(zone_min) END"


@register(
    "parse_nginx",
    f"""SELECT line_seq, strftime({_NGINX_TS}, {O.STAMP}) AS ts, CASE WHEN kind NOT IN (1, 2) THEN zone_text END AS tz_offset,
  CASE kind WHEN 5 THEN '192.0.2.' || line_seq % 250 ELSE ip END AS source_ip, who AS user_name,
  CASE kind WHEN 6 THEN 'GET' ELSE method END AS action, CASE kind WHEN 6 THEN '/' ELSE path END AS resource,
  CAST(status AS INTEGER) AS status_code, CASE kind WHEN 6 THEN '' ELSE method || ' ' || path || ' HTTP/2.0' END AS message,
  url AS referer, 'curl/8' AS user_agent, CASE kind WHEN 6 THEN 'HTTP/1.1' ELSE 'HTTP/2.0' END AS protocol,
  CASE kind WHEN 4 THEN '0' ELSE CAST(size AS VARCHAR) END AS response_size, ip AS original_ip
  FROM ({_duck(HTTP_FIELDS, 'pages')}) WHERE kind <> 3""",
)
def parse_nginx(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = nginx.parse_nginx(_spark(spark, sf_dir, NGINX_LINES, "pages"), now=NOW)
    return entries.selectExpr(
        "line_seq", STAMP, "tz_offset", "source_ip", "`user` AS user_name", "action", "resource", "status_code", "message",
        "referer", "user_agent", "metadata['protocol'] AS protocol", "metadata['response_size'] AS response_size",
        "metadata['original_ip'] AS original_ip",
    )


EVENT_FIELDS = """SELECT event_id AS line_seq, concat('10.0.0.', CAST(event_id % 200 AS {string})) AS ip,
  concat('user', CAST(user_id % 40 AS {string})) AS who, concat('host', CAST(event_id % 5 AS {string})) AS host,
  CAST(1000 + event_id % 9000 AS {string}) AS num, event_type, event_id % 192 AS pri,
  1 + event_id % 28 AS d, event_id % 24 AS h, event_id % 60 AS mi, (event_id * 7) % 60 AS s, event_id AS i FROM {source}"""
ERROR_LINES = f"""SELECT 'error.log' AS file_path, line_seq, concat('2024/01/', {p2('d')}, ' ', {p2('h')}, ':', {p2('mi')}, ':', {p2('s')},
  ' [', event_type, '] ', num, '#7: ', CASE i % 3 WHEN 0 THEN '' ELSE concat('*', num, ' ') END, 'upstream timed out',
  CASE i % 4 WHEN 0 THEN '' ELSE concat(', client: ', ip, ', server: x') END) AS line FROM ({EVENT_FIELDS})"""
_EVENT_TS = f"strftime(make_timestamp(2024, 1, d, h, mi, s), {O.STAMP}) AS ts"


@register(
    "parse_nginx_error",
    f"""SELECT line_seq, {_EVENT_TS}, CASE WHEN i % 4 <> 0 THEN ip END AS source_ip, 'ERROR' AS action, 'nginx_error' AS log_type,
  'upstream timed out' || CASE i % 4 WHEN 0 THEN '' ELSE ', client: ' || ip || ', server: x' END AS message,
  event_type AS level, num AS pid, CASE WHEN i % 3 <> 0 THEN num END AS connection_id FROM ({_duck(EVENT_FIELDS, 'events')})""",
)
def parse_nginx_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nginx.parse_nginx(_spark(spark, sf_dir, ERROR_LINES, "events"), now=NOW).selectExpr(
        "line_seq", STAMP, "source_ip", "action", "log_type", "message", "metadata['level'] AS level",
        "metadata['pid'] AS pid", "metadata['connection_id'] AS connection_id",
    )


# -- syslog -------------------------------------------------------------------------------

_BSD = f"concat('Jan ', lpad(CAST(d AS {{string}}), 2, ' '), ' ', {p2('h')}, ':', {p2('mi')}, ':', {p2('s')})"
_MESSAGE = """CASE i % 7 WHEN 0 THEN concat('Connection from ', ip, ' port 22') WHEN 1 THEN concat('session opened for user ', who, ' by (uid=0)')
  WHEN 2 THEN concat('DROP SRC=', ip, ' DST=172.16.0.1') WHEN 3 THEN concat('Failed password for invalid user ', who, ' from ', ip)
  WHEN 4 THEN concat('auth failure; ruser= rhost=', ip) WHEN 5 THEN 'ticket issued for unknown' ELSE concat('probe of ', ip, ' done') END"""
_MESSAGE_IP = "CASE WHEN i % 7 NOT IN (1, 5) THEN ip END"
_MESSAGE_USER = "CASE i % 7 WHEN 1 THEN who WHEN 3 THEN who WHEN 4 THEN 'rhost=' || ip END"
# Every eleventh line has no process and matches the minimal form only.
SYSLOG_LINES = f"""SELECT 'messages' AS file_path, line_seq, concat(CASE WHEN i % 5 = 0 AND i % 11 <> 0 THEN concat('<', CAST(pri AS {{string}}), '>') ELSE '' END,
  {_BSD}, ' ', host, ' ', CASE WHEN i % 11 = 0 THEN 'restarted after outage' ELSE
  concat('daemon', CASE i % 3 WHEN 0 THEN '' ELSE concat('[', num, ']') END, ': ', {_MESSAGE}) END) AS line FROM ({EVENT_FIELDS})"""
_NAMES = "[" + ", ".join(f"'{n}'" for n in syslog.FACILITIES.values()) + "]"
_SEVERITY_NAMES = "[" + ", ".join(f"'{n}'" for n in syslog.SEVERITIES.values()) + "]"
_PRI = "CASE WHEN i % 5 = 0 THEN pri ELSE 13 END"


@register(
    "parse_syslog3164",
    f"""SELECT line_seq, {_EVENT_TS}, CASE WHEN i % 11 <> 0 THEN {_MESSAGE_IP} END AS source_ip,
  CASE WHEN i % 11 <> 0 THEN {_MESSAGE_USER} END AS user_name, CASE WHEN i % 11 = 0 THEN 'syslog' ELSE 'daemon' END AS action,
  CASE WHEN i % 11 = 0 THEN 'restarted after outage' ELSE {_MESSAGE} END AS message, host AS hostname,
  CASE WHEN i % 11 <> 0 AND i % 3 <> 0 THEN num END AS pid,
  CASE WHEN i % 11 <> 0 THEN {_NAMES}[({_PRI}) // 8 + 1] END AS facility,
  CASE WHEN i % 11 <> 0 THEN {_SEVERITY_NAMES}[({_PRI}) % 8 + 1] END AS severity FROM ({_duck(EVENT_FIELDS, 'events')})""",
)
def parse_syslog3164(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syslog.parse_syslog(_spark(spark, sf_dir, SYSLOG_LINES, "events"), now=NOW, year=YEAR).selectExpr(
        "line_seq", STAMP, "source_ip", "`user` AS user_name", "action", "message", "hostname", "metadata['pid'] AS pid",
        "metadata['facility'] AS facility", "metadata['severity'] AS severity",
    )


NEW_SYSLOG_LINES = f"""SELECT 'syslog' AS file_path, line_seq, concat('<', CAST(pri AS {{string}}), '>1 2024-01-', {p2('d')}, 'T', {p2('h')}, ':', {p2('mi')}, ':', {p2('s')},
  CASE i % 4 WHEN 0 THEN 'Z' WHEN 1 THEN '.003Z' WHEN 2 THEN '.25+02:00' ELSE '-0500' END, ' ', host, ' app ', num, ' ID47 ',
  CASE i % 3 WHEN 0 THEN '-' ELSE '[a@1 x="y"]' END, ' ', {_MESSAGE}) AS line FROM ({EVENT_FIELDS})"""


@register(
    "parse_syslog5424",
    f"""SELECT line_seq, strftime(make_timestamp(2024, 1, d, h, mi, s) + to_milliseconds(CASE i % 4 WHEN 1 THEN 3 WHEN 2 THEN 250 ELSE 0 END)
    - to_minutes(CASE i % 4 WHEN 2 THEN 120 WHEN 3 THEN -300 ELSE 0 END), {O.STAMP}) AS ts,
  CASE i % 4 WHEN 2 THEN '+02:00' WHEN 3 THEN '-05:00' END AS tz_offset, {_MESSAGE_IP} AS source_ip, {_MESSAGE_USER} AS user_name,
  'app' AS action, CASE i % 3 WHEN 0 THEN '- ' ELSE '' END || {_MESSAGE} AS message, num AS pid, 'ID47' AS msgid,
  CASE i % 3 WHEN 0 THEN '' ELSE '[a@1 x="y"]' END AS structured_data, {_NAMES}[pri // 8 + 1] AS facility
  FROM ({_duck(EVENT_FIELDS, 'events')})""",
)
def parse_syslog5424(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syslog.parse_syslog(_spark(spark, sf_dir, NEW_SYSLOG_LINES, "events"), now=NOW, year=YEAR).selectExpr(
        "line_seq", STAMP, "tz_offset", "source_ip", "`user` AS user_name", "action", "message", "metadata['pid'] AS pid",
        "metadata['msgid'] AS msgid", "metadata['structured_data'] AS structured_data", "metadata['facility'] AS facility",
    )


@register(
    "priority_decode",
    f"""SELECT event_id, event_id % 200 AS priority, coalesce({_NAMES}[(event_id % 200) // 8 + 1], 'unknown') AS facility,
  {_SEVERITY_NAMES}[(event_id % 200) % 8 + 1] AS severity FROM events""",
)
def priority_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 200 AS priority").selectExpr(
        "*", f"{syslog.facility('priority')} AS facility", f"{syslog.severity('priority')} AS severity"
    )


# -- authentication -----------------------------------------------------------------------

# (process, message with {who} and {ip}, action, has user, has ip, port, success), one per kind of line.
AUTH_KINDS = [
    ("sshd", "Accepted password for {who} from {ip} port 22 ssh2", "ssh_success", 1, 1, "22", 1),
    ("sshd", "Accepted publickey for {who} from {ip} port 23 ssh2", "ssh_success", 1, 1, "23", 1),
    ("sshd", "Failed password for {who} from {ip} port 24 ssh2", "ssh_failure", 1, 1, "24", 0),
    ("sshd", "Failed password for invalid user {who} from {ip} port 25 ssh2", "ssh_failure", 1, 1, "25", 0),
    ("sshd", "Invalid user {who} from {ip} port 26", "ssh_invalid_user", 1, 1, None, 0),
    ("sshd", "Connection closed by authenticating user {who} {ip} port 27 [preauth]", "other", 1, 1, "27", None),
    ("sshd", "Disconnected from {ip} port 28", "other", 0, 1, "28", None),
    ("sshd", "Disconnecting {ip}: Too many authentication failures", "ssh_failure", 0, 0, None, 0),
    ("sshd", "reverse mapping checking for x - POSSIBLE BREAK-IN ATTEMPT!", "ssh_failure", 0, 0, None, 0),
    ("sudo", "  {who} : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/ls -l", "sudo_success", 1, 0, None, 1),
    ("sudo", "{who} : pam says authentication failure", "sudo_failure", 1, 0, None, 0),
    ("sudo", "{who} : 3 incorrect password attempts ; TTY=pts/2", "sudo_failure", 1, 0, None, 0),
    ("CRON", "pam_unix(cron:session): session opened for user {who} by (uid=0)", "session_open", 1, 0, None, 1),
    ("sshd", "pam_unix(sshd:session): session closed for user {who}", "session_close", 1, 0, None, None),
    ("su", "pam_unix(su:auth): authentication failure; rhost= user={who}", "pam_auth", 1, 0, None, 0),
    ("systemd", "Started Session 12", "other", 0, 0, None, None),
]


def _sql_message(message: str) -> str:
    parts = message.replace("{who}", "\0who\0").replace("{ip}", "\0ip\0").split("\0")
    return "concat(" + ", ".join(p if p in ("who", "ip") else f"'{p}'" for p in parts if p) + ")"


def _by_kind(values: list) -> str:
    def sql(v):
        return "NULL" if v is None else str(v)

    return f"CASE i % {len(AUTH_KINDS)} " + " ".join(f"WHEN {n} THEN {sql(v)}" for n, v in enumerate(values)) + " END"


_AUTH_MESSAGE = _by_kind([_sql_message(k[1]) for k in AUTH_KINDS])
_AUTH_PROCESS = _by_kind([f"'{k[0]}'" for k in AUTH_KINDS])
AUTH_LINES = f"""SELECT 'auth' AS file_path, line_seq, concat({_BSD}, ' ', host, ' ', {_AUTH_PROCESS}, '[', num, ']: ', {_AUTH_MESSAGE}) AS line
  FROM ({EVENT_FIELDS})"""


@register(
    "parse_auth",
    f"""SELECT line_seq, {_EVENT_TS}, CASE WHEN {_by_kind([k[4] for k in AUTH_KINDS])} = 1 THEN ip END AS source_ip,
  CASE WHEN {_by_kind([k[3] for k in AUTH_KINDS])} = 1 THEN who END AS user_name,
  {_by_kind([f"'{k[2]}'" for k in AUTH_KINDS])} AS action, CAST({_by_kind([k[6] for k in AUTH_KINDS])} AS INTEGER) AS status_code,
  ltrim({_AUTH_MESSAGE}) AS message, {_AUTH_PROCESS} AS process, host AS hostname,
  {_by_kind([None if k[5] is None else f"'{k[5]}'" for k in AUTH_KINDS])} AS port,
  {_by_kind(["'password'", "'publickey'"] + [None] * 14)} AS auth_method,
  {_by_kind([None] * 9 + ["'/bin/ls -l'"] + [None] * 6)} AS command FROM ({_duck(EVENT_FIELDS, 'events')})""".replace("{string}", "VARCHAR"),
)
def parse_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auth_logs.parse_auth(_spark(spark, sf_dir, AUTH_LINES, "events"), now=NOW, year=YEAR).selectExpr(
        "line_seq", STAMP, "source_ip", "`user` AS user_name", "action", "status_code", "message", "process", "hostname",
        "metadata['port'] AS port", "metadata['auth_method'] AS auth_method", "metadata['command'] AS command",
    )


@register(
    "auth_log_attacks",
    O.over(
        f"""SELECT 'auth' AS file_path, line_seq, 'auth' AS log_type, ltrim({_AUTH_MESSAGE}) AS message,
  make_timestamp(2024, 1, d, h, mi, s) AS ts, CASE WHEN {_by_kind([k[4] for k in AUTH_KINDS])} = 1 THEN ip END AS source_ip,
  CASE WHEN {_by_kind([k[3] for k in AUTH_KINDS])} = 1 THEN who END AS user_name,
  {_by_kind([f"'{k[2]}'" for k in AUTH_KINDS])} AS action, CAST({_by_kind([k[6] for k in AUTH_KINDS])} AS INTEGER) AS status_code
  FROM ({_duck(EVENT_FIELDS, 'events')})""",
        f"{O.PAIRS},{O.GUESSING},{O.STUFFING},{O.DISTRIBUTED}",
        " UNION ALL ".join(f"SELECT {O.ALERT_TABLE} FROM {t}" for t in ("guessing", "stuffing", "distributed")),
    ),
)
def auth_log_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw authentication lines to alerts."""
    from workload.queries import alert_table

    lines = _spark(spark, sf_dir, AUTH_LINES, "events")
    return alert_table(auth.auth_alerts(auth_logs.parse_auth(lines, now=NOW, year=YEAR), AUTH))


# -- Windows ------------------------------------------------------------------------------

_IDS = "CASE i % 6 WHEN 0 THEN 4624 WHEN 1 THEN 4625 WHEN 2 THEN 4672 WHEN 3 THEN 4720 WHEN 4 THEN 4688 ELSE 1102 END"
_CATEGORY = (
    "CASE i % 6 WHEN 0 THEN 'logon_success' WHEN 1 THEN 'logon_failure' WHEN 2 THEN 'privilege_use' "
    "WHEN 3 THEN 'account_management' WHEN 4 THEN 'process' ELSE 'other' END"
)
_H12 = "CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END"
_NOON = "CASE WHEN h < 12 THEN 'AM' ELSE 'PM' END"
_US_DATE = "concat('1/', CAST(d AS {string}), '/2024')"
_US_12 = f"concat(CAST({_H12} AS {{string}}), ':', {p2('mi')}, ':', {p2('s')}, ' ', {_NOON})"
# Every fifth line has a 24 hour clock; every seventh has a two-word level and does not match.
WINDOWS_LINES = f"""SELECT 'security.log' AS file_path, line_seq, concat({_US_DATE}, ' ', CASE WHEN i % 5 = 0 THEN
  concat({p2('h')}, ':', {p2('mi')}, ':', {p2('s')}) ELSE {_US_12} END, CASE WHEN i % 7 = 0 THEN ' Audit Failure ' ELSE ' Information ' END,
  'Microsoft-Windows-Security-Auditing ', CAST({_IDS} AS {{string}}), ' ', event_type, ' task') AS line FROM ({EVENT_FIELDS})"""


@register(
    "parse_windows_text",
    f"""SELECT line_seq, {_EVENT_TS}, {_CATEGORY} AS action, CAST({_IDS} AS INTEGER) AS status_code,
  'Information' AS level, event_type || ' task' AS task_category FROM ({_duck(EVENT_FIELDS, 'events')}) WHERE i % 7 <> 0""",
)
def parse_windows_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.parse_windows(_spark(spark, sf_dir, WINDOWS_LINES, "events"), now=NOW).selectExpr(
        "line_seq", STAMP, "action", "status_code", "metadata['level'] AS level", "metadata['task_category'] AS task_category"
    )


WINDOWS_CSV = f"""SELECT 'security.csv' AS file_path, line_seq, concat('"Information","', {_US_DATE}, ' ', {_US_12},
  '","Security",', CAST({_IDS} AS {{string}}), ',', event_type) AS line FROM ({EVENT_FIELDS})"""


@register(
    "parse_windows_csv",
    f"""SELECT line_seq, {_EVENT_TS}, {_CATEGORY} AS action, CAST({_IDS} AS INTEGER) AS status_code,
  'Security' AS source FROM ({_duck(EVENT_FIELDS, 'events')})""",
)
def parse_windows_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.parse_windows(_spark(spark, sf_dir, WINDOWS_CSV, "events"), now=NOW).selectExpr(
        "line_seq", STAMP, "action", "status_code", "metadata['source'] AS source"
    )


_LOGON = "CASE i % 3 WHEN 0 THEN 2 WHEN 1 THEN 10 ELSE 13 END"
# Two events per document; every second document carries the namespace.
XML_DOCUMENTS = f"""SELECT 'security.xml' AS file_path, line_seq, concat('<Events>', x, regexp_replace(x, 'TargetUserName', 'SubjectUserName'), '</Events>') AS line
FROM (SELECT line_seq, concat('<Event', CASE i % 2 WHEN 0 THEN '' ELSE ' xmlns="http://schemas.microsoft.com/win/2004/08/events/event"' END,
  '><System><EventID>', CAST({_IDS} AS {{string}}), '</EventID><TimeCreated SystemTime="2024-01-', {p2('d')}, 'T', {p2('h')}, ':', {p2('mi')}, ':', {p2('s')},
  CASE i % 4 WHEN 0 THEN '' WHEN 1 THEN 'Z' WHEN 2 THEN '.125Z' ELSE '.5' END, '"/><Computer>', host,
  '</Computer></System><EventData><Data Name="TargetUserName">', who, '</Data><Data Name="IpAddress">', CASE i % 5 WHEN 0 THEN '-' ELSE ip END,
  '</Data><Data Name="LogonType">', CAST({_LOGON} AS {{string}}), '</Data><Data Name="Status">0xC000006D</Data></EventData></Event>') AS x
  FROM ({EVENT_FIELDS}))"""


@register(
    "parse_windows_xml",
    f"""SELECT line_seq, strftime(make_timestamp(2024, 1, d, h, mi, s) + to_milliseconds(CASE i % 4 WHEN 2 THEN 125 WHEN 3 THEN 500 ELSE 0 END),
    {O.STAMP}) AS ts, CASE WHEN i % 5 <> 0 THEN ip END AS source_ip, who AS user_name, {_CATEGORY} AS action,
  CAST({_IDS} AS INTEGER) AS status_code, 'Event ' || ({_IDS}) || ': ' || ({_CATEGORY}) || ' - User: ' || who ||
    CASE WHEN i % 5 <> 0 THEN ' from ' || ip ELSE '' END AS message, host AS hostname,
  CASE i % 3 WHEN 0 THEN 'Interactive (local keyboard)' WHEN 1 THEN 'RemoteInteractive (RDP)' ELSE '13' END AS logon_type,
  'Bad username or password' AS failure_reason
  FROM ({_duck(EVENT_FIELDS, 'events')}), (VALUES (1), (2)) AS twice(n)""",
)
def parse_windows_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.parse_windows_xml(_spark(spark, sf_dir, XML_DOCUMENTS, "events"), now=NOW).selectExpr(
        "line_seq", STAMP, "source_ip", "`user` AS user_name", "action", "status_code", "message", "hostname",
        "metadata['logon_type'] AS logon_type", "metadata['failure_reason'] AS failure_reason",
    )


# -- files as a whole ---------------------------------------------------------------------


APACHE_LIKE = f"""SELECT 'x' AS file_path, line_seq, concat(ip, ' - ', who, ' [', {_CLOCK}, ' +0000] "GET /', num, ' HTTP/1.1" 200 ', num) AS line
  FROM ({EVENT_FIELDS})"""
JUNK_LINES = f"SELECT 'x' AS file_path, line_seq, concat('nothing here ', num) AS line FROM ({EVENT_FIELDS})"
KINDS = [APACHE_LIKE, ERROR_LINES, SYSLOG_LINES, AUTH_LINES, WINDOWS_CSV, NEW_SYSLOG_LINES, JUNK_LINES]


def _line_of(sql: str) -> str:
    """The expression that builds the line in one of the texts above."""
    return sql.split("line_seq, ", 1)[1].split(" AS line", 1)[0]


def _file_line(size: int, div: str) -> str:
    """The line of an event in files of ``size`` lines, each file of one of seven kinds, with a comment and a blank line in front."""
    arms = " ".join(f"WHEN line_seq {div} {size} % 7 = {n} THEN {_line_of(sql)}" for n, sql in enumerate(KINDS))
    return f"CASE WHEN line_seq % {size} = 0 THEN '# comment' WHEN line_seq % {size} = 1 THEN '' {arms} END"


FILE_LINES = (
    f"SELECT concat('file', CAST(line_seq div 25 AS STRING)) AS file_path, line_seq, {_file_line(25, 'div')} AS line FROM ({EVENT_FIELDS})"
)


def _file_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The lines are written out first, as log files are.
    return stage(_spark(spark, sf_dir, FILE_LINES, "events"), "lines")


_FORMAT = (
    "CASE event_id // 25 % 7 WHEN 0 THEN 'apache' WHEN 1 THEN 'nginx' WHEN 2 THEN 'syslog' WHEN 3 THEN 'syslog' "
    "WHEN 4 THEN 'windows' WHEN 5 THEN 'syslog' END"
)


@register(
    "detect_format",
    f"SELECT DISTINCT 'file' || (event_id // 25) AS file_path, {_FORMAT} AS format FROM events",
)
def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.detect_formats(ingest.first_lines(_file_lines(spark, sf_dir)))


# Parsed as syslog: the files of kinds 2, 3 and 5 give entries for all lines but comment and blank.
@register(
    "parse_stats",
    """SELECT 'file' || (event_id // 25) AS file_path, 'syslog' AS log_type, count(*) AS lines_processed,
  count(*) FILTER (event_id % 25 > 1 AND event_id // 25 % 7 IN (2, 3, 5)) AS lines_parsed,
  count(*) FILTER (event_id % 25 > 1 AND event_id // 25 % 7 NOT IN (2, 3, 5)) AS parse_errors,
  round(100.0 * count(*) FILTER (event_id % 25 > 1 AND event_id // 25 % 7 IN (2, 3, 5)) / count(*), 6) AS success_rate
  FROM events GROUP BY event_id // 25""",
)
def parse_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.parse_stats(_as_syslog(spark, sf_dir)).withColumn("success_rate", F.round("success_rate", 6))


def _as_syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _file_lines(spark, sf_dir).withColumn("format", F.lit("syslog"))
    return ingest.judge_lines(lines, now=NOW, year=YEAR, names=["syslog"])


@register(
    "parse_errors",
    f"""SELECT 'file' || (line_seq // 25) AS file_path, line_seq, substr({_duck(_file_line(25, '//'), 'events')}, 1, 200) AS line,
  'no pattern matched' AS error FROM ({_duck(EVENT_FIELDS, 'events')})
  WHERE line_seq % 25 > 1 AND line_seq // 25 % 7 NOT IN (2, 3, 5)""",
)
def parse_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.parse_errors(_as_syslog(spark, sf_dir))


# -- folders of log files -----------------------------------------------------------------

FILE_SIZE = 250
# Every fiftieth line of a file is one that no format knows.
FOLDER_LINE = "CASE WHEN line_seq % 50 = 7 THEN concat('nothing here ', num) ELSE {} END"
_KIND = f"event_id // {FILE_SIZE} % 7"
_KIND_FORMAT = f"CASE {_KIND} WHEN 0 THEN 'apache' WHEN 1 THEN 'nginx' WHEN 4 THEN 'windows' WHEN 6 THEN NULL ELSE 'syslog' END"
_DATA = f"event_id % {FILE_SIZE} > 1"
_ENTRY = f"{_DATA} AND event_id % 50 <> 7 AND {_KIND} <> 6"
_FILE_LINE_DUCK = _duck(FOLDER_LINE.format(_file_line(FILE_SIZE, "//")), "events")
_NAME = "regexp_extract({}, 'name=([^/]+)/', 1) AS name"


def _folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of log files in the shared folder: one file a name, its lines in order."""
    sql = (
        f"SELECT concat('f', CAST(line_seq div {FILE_SIZE} AS STRING)) AS name, line_seq, "
        f"{FOLDER_LINE.format(_file_line(FILE_SIZE, 'div'))} AS value FROM ({EVENT_FIELDS})"
    )
    path = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    lines = _spark(spark, sf_dir, sql, "events").repartition("name").sortWithinPartitions("name", "line_seq")
    lines.select("name", "value").write.partitionBy("name").text(path)
    return path


def _parsed(spark: SparkSession, sf_dir: str) -> ingest.Parsed:
    path = _folder(spark, sf_dir)
    return ingest.parse_logs(spark, [path, f"{path}/gone.log"], recursive=True, now=NOW, year=YEAR)


@register(
    "ingest_entries",
    f"""SELECT 'f' || (event_id // {FILE_SIZE}) AS name, line AS raw_line,
  CASE {_KIND} WHEN 1 THEN 'nginx_error' ELSE {_KIND_FORMAT} END AS log_type, false AS ts_fallback
  FROM (SELECT line_seq AS event_id, {_FILE_LINE_DUCK} AS line FROM ({_duck(EVENT_FIELDS, 'events')})) WHERE {_ENTRY}""",
)
def ingest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log files of several formats, found, told apart and parsed."""
    return _parsed(spark, sf_dir).entries.selectExpr(_NAME.format("file_path"), "raw_line", "log_type", "ts_fallback")


@register(
    "ingest_errors",
    f"""SELECT 'f' || (event_id // {FILE_SIZE}) AS name, 1 + event_id % {FILE_SIZE} AS line_number, substr(line, 1, 200) AS line,
  'no pattern matched' AS error
  FROM (SELECT line_seq AS event_id, {_FILE_LINE_DUCK} AS line FROM ({_duck(EVENT_FIELDS, 'events')}))
  WHERE {_DATA} AND event_id % 50 = 7 AND {_KIND} <> 6""",
)
def ingest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that were not understood, with their numbers in the files."""
    return _parsed(spark, sf_dir).errors.selectExpr(_NAME.format("file_path"), "line_number", "line", "error")


@register(
    "ingest_stats",
    f"""SELECT 'f' || (event_id // {FILE_SIZE}) AS name, {_KIND_FORMAT} AS log_type, count(*) AS lines_processed,
  count(*) FILTER ({_ENTRY}) AS lines_parsed, count(*) FILTER ({_DATA} AND event_id % 50 = 7) AS parse_errors,
  round(100.0 * count(*) FILTER ({_ENTRY}) / count(*), 6) AS success_rate
  FROM events WHERE {_KIND} <> 6 GROUP BY event_id // {FILE_SIZE}, {_KIND_FORMAT}""",
)
def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _parsed(spark, sf_dir).stats
    return stats.selectExpr(
        _NAME.format("file_path"), "log_type", "lines_processed", "lines_parsed", "parse_errors", "round(success_rate, 6) AS success_rate"
    )


@register(
    "ingest_files",
    f"""SELECT DISTINCT 'f' || (event_id // {FILE_SIZE}) AS name, {_KIND_FORMAT} AS format,
  CASE WHEN {_KIND} = 6 THEN 'no known format' END AS reason FROM events
  UNION ALL SELECT 'gone.log', NULL, 'no such file or folder'""",
)
def ingest_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was found and what was not, with reasons."""
    parsed = _parsed(spark, sf_dir)
    files = parsed.files.selectExpr(_NAME.format("file_path"), "format", "reason")
    lost = parsed.problems.where("path LIKE '%gone.log'")
    return files.unionByName(lost.selectExpr("'gone.log' AS name", "CAST(NULL AS STRING) AS format", "reason"))


@register("ingest_xml", ORACLES["parse_windows_xml"].replace("SELECT line_seq, ", "SELECT ", 1))
def ingest_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of XML events, told apart by their first line."""
    documents = _spark(spark, sf_dir, XML_DOCUMENTS, "events").selectExpr(
        f"concat('x', CAST(line_seq div {FILE_SIZE} AS STRING)) AS name", "line_seq", "regexp_replace(line, '</?Events>', '') AS value"
    )
    frame = documents.select("name").distinct().selectExpr(
        "name", f"inline(array(struct(-1L AS line_seq, '<Events>' AS value), struct({2**62}L AS line_seq, '</Events>' AS value)))"
    )
    path = f"{shared_dir(spark)}/xml-{uuid.uuid4().hex}"
    files = documents.unionByName(frame).repartition("name").sortWithinPartitions("name", "line_seq")
    files.select("name", "value").write.partitionBy("name").text(path)
    return ingest.parse_logs(spark, path, recursive=True, now=NOW).entries.selectExpr(
        STAMP, "source_ip", "`user` AS user_name", "action", "status_code", "message", "hostname",
        "metadata['logon_type'] AS logon_type", "metadata['failure_reason'] AS failure_reason",
    )


@register(
    "entry_fingerprint",
    f"""SELECT line_seq, substr(sha256(strftime(ts_local, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(ts_local) % 1000000 = 0 THEN ''
  ELSE strftime(ts_local, '.%f') END || source_ip || message || raw_line), 1, 16) AS entry_hash FROM ({O.AUTH_DUCK})""",
)
def entry_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auth_entries(spark, sf_dir).selectExpr("line_seq", f"{ENTRY_HASH} AS entry_hash")


# -- sinks and extensions -----------------------------------------------------------------

_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END"


_TEXTS = "CAST(get_json_object(json, '$.{0}') AS STRING) AS {0}"


def _alert_files(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """The alerts of all detectors, written as a user would export them."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    (sinks.write_csv if kind == "csv" else sinks.write_json)(_analysis(spark, sf_dir).alerts, path)
    return path


@register(
    "export_csv",
    O.with_alerts(
        O.ALL_E, EVERY,
        f"SELECT {O.ALERT_ID} AS alert_id, {_ISO} AS timestamp, {O.LEVEL} AS level, threat_type, coalesce(source_ip, '') AS source_ip, "
        "coalesce(target, '') AS target, description FROM alerts",
    ),
)
def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files written and read back."""
    names = "alert_id STRING, timestamp STRING, level STRING, threat_type STRING, source_ip STRING, target STRING, description STRING"
    reader = spark.read.schema(names).option("header", True).option("escape", '"').option("multiLine", True)
    return reader.csv(_alert_files(spark, sf_dir, "csv")).na.fill("")


@register(
    "export_json",
    O.with_alerts(
        O.ALL_E, EVERY,
        f"SELECT {O.ALERT_ID} AS alert_id, {_ISO} AS timestamp, threat_type, {O.LEVEL} AS level, CAST(level_value AS VARCHAR) AS level_value, "
        "source_ip, target, description, CAST(evidence_count AS VARCHAR) AS evidence_count, mitre AS mitre_attack, "
        "array_to_string(advice, '|') AS recommendations, CAST(coordinated_attack AS VARCHAR) AS coordinated_attack, attack_vectors FROM alerts",
    ),
)
def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files written and read back, all fields but the metadata, which differ per detector."""
    lists = [
        f"array_join(from_json(get_json_object(json, '$.{name}'), 'array<string>'), '{sep}') AS {name}"
        for name, sep in (("mitre_attack", ","), ("recommendations", "|"), ("attack_vectors", ","))
    ]
    single = ["alert_id", "timestamp", "threat_type", "level", "level_value", "source_ip", "target", "description", "evidence_count",
              "coordinated_attack"]
    texts = spark.read.text(_alert_files(spark, sf_dir, "json")).withColumnRenamed("value", "json")
    return texts.selectExpr(*[_TEXTS.format(name) for name in single], *lists)


@register(
    "export_entries",
    f"""SELECT {_ISO.replace('ts', 'ts_local')} AS timestamp, source_ip, user_name, action, CAST(status_code AS VARCHAR) AS status_code, message, log_type,
  substr(sha256(strftime(ts_local, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(ts_local) % 1000000 = 0 THEN ''
  ELSE strftime(ts_local, '.%f') END || source_ip || message || raw_line), 1, 16) AS entry_hash FROM ({O.AUTH_DUCK})""",
)
def export_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = sinks.as_json(sinks.entry_records(auth_entries(spark, sf_dir)))
    names = ["timestamp", "source_ip", "action", "status_code", "message", "log_type", "entry_hash"]
    return texts.selectExpr(*[f"get_json_object(json, '$.{c}') AS {c}" for c in names], "get_json_object(json, '$.user') AS user_name")


def server_errors(entries: DataFrame) -> DataFrame:
    """An example of a user's own detector: ips with server errors."""
    return (
        entries.where("status_code = 500")
        .groupBy("source_ip")
        .agg(F.expr("max(ts) AS ts"), F.expr("count(*) AS n"))
        .selectExpr(
            "ts", "source_ip", "'server_errors' AS threat_type", "'MEDIUM' AS level",
            "concat(n, ' server errors') AS description", "array('T1499') AS mitre_attack",
            "array('Check the server') AS recommendations",
        )
    )


@register(
    "custom_detector",
    f"""WITH w AS ({O.WEB_E}), m AS (SELECT max(ts) AS ts, source_ip, count(*) || ' server errors' AS description FROM w WHERE status_code = 500 GROUP BY source_ip)
SELECT strftime(ts, {O.STAMP}) AS ts, source_ip, 'server_errors' AS threat_type, 'MEDIUM' AS level, description,
  substr(sha256(strftime(ts, '%Y-%m-%d %H:%M:%S') || 'server_errors' || source_ip || 'None'), 1, 12) AS alert_id FROM m""",
)
def custom_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = Settings().register_detector("server_errors", server_errors).enable("server_errors")
    found = analyze(web_entries(spark, sf_dir), settings).alerts
    return found.selectExpr(STAMP, "source_ip", "threat_type", "level", "description", "alert_id")


def parse_marked(lines: DataFrame, now: datetime | None = None, year: int | None = None) -> DataFrame:
    """An example of a user's own parser: ``MARK|ip|user|text``."""
    from logvigil.schema import conform_entries

    parts = lines.where("startswith(line, 'MARK|')").selectExpr("*", "split(line, '\\\\|') AS p")
    return conform_entries(
        parts.selectExpr(
            "file_path", "line_seq", f"TIMESTAMP '{now}' AS ts", "p[1] AS source_ip", "p[2] AS `user`", "p[3] AS message",
            "'marked' AS log_type", "line AS raw_line",
        )
    )


@register(
    "custom_parser",
    f"""SELECT 'marked' AS format, line_seq, ip AS source_ip, who AS user_name, num AS message
  FROM ({_duck(EVENT_FIELDS, 'events')})""",
)
def custom_parser(spark: SparkSession, sf_dir: str) -> DataFrame:
    formats = ingest.Formats().register_parser("marked", parse_marked, "startswith(line, 'MARK|')")
    lines = _spark(
        spark, sf_dir, f"SELECT 'own.log' AS file_path, line_seq, concat('MARK|', ip, '|', who, '|', num) AS line FROM ({EVENT_FIELDS})",
        "events",
    )
    detected = ingest.detect_formats(ingest.first_lines(lines), formats)
    entries = ingest.parse_lines(lines, "marked", formats, now=NOW)
    # One row per file on the right side.
    return entries.join(detected, "file_path").selectExpr("format", "line_seq", "source_ip", "`user` AS user_name", "message")
