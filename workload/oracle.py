"""SQL counterparts of the registered queries, for DuckDB over the given tables."""

from __future__ import annotations

from logvigil.functions.signatures import (
    HTML_ENTITIES, SENSITIVE_FILES, SQL_FUNCTIONS, SQLI, SUCCESS_CODES, TRAVERSAL, XSS,
)
from logvigil.operators.temporal import HIGH_RISK_HOURS
from workload.adapters import AUTH_DUCK, GEO_DUCK, WEB_DUCK, WINDOW_MINUTES

STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# -- entries ------------------------------------------------------------------------------

COLUMNS = (
    "file_path, line_seq, log_type, message, ts, source_ip, user_name, action, resource, status_code, referer, user_agent"
)
AUTH_E = f"""SELECT 'auth' AS file_path, line_seq, log_type, message, ts_local AS ts, source_ip, user_name, action,
  CAST(NULL AS VARCHAR) AS resource, status_code, CAST(NULL AS VARCHAR) AS referer, CAST(NULL AS VARCHAR) AS user_agent
  FROM ({AUTH_DUCK})"""
WEB_E = f"""SELECT 'web' AS file_path, line_seq, log_type, message, ts_local AS ts, source_ip,
  CAST(NULL AS VARCHAR) AS user_name, action, resource, status_code, referer, user_agent FROM ({WEB_DUCK})"""
ALL_E = f"{AUTH_E} UNION ALL {WEB_E}"

# The texts of alerts in this file are those of the detectors.

# -- login attacks ------------------------------------------------------------------------

_FAILED = """(lower(message) LIKE '%failed%' OR lower(message) LIKE '%failure%' OR lower(message) LIKE '%invalid%'
  OR lower(message) LIKE '%denied%'
  OR coalesce(action IN ('ssh_failure', 'ssh_invalid_user', 'sudo_failure', 'logon_failure'), false)
  OR coalesce(status_code = 0 AND log_type = 'auth', false))"""
_SUCCESS = f"""(NOT {_FAILED} AND (lower(message) LIKE '%accepted%' OR lower(message) LIKE '%succeeded%'
  OR coalesce(action IN ('ssh_success', 'sudo_success', 'logon_success'), false)
  OR coalesce(status_code = 1 AND log_type = 'auth', false)))"""

PAIRS = f"""
fails AS (SELECT *, coalesce(nullif(user_name, ''), 'unknown') AS account, coalesce(user_name, '') <> '' AS named
  FROM e WHERE source_ip <> '' AND {_FAILED}),
wins AS (SELECT source_ip, user_name AS account, max(ts) AS last_success FROM e
  WHERE source_ip <> '' AND user_name <> '' AND {_SUCCESS} GROUP BY ALL),
ends AS (SELECT source_ip, account, max(ts) AS m, bool_or(named) AS named_account FROM fails GROUP BY ALL),
pairs AS (SELECT f.source_ip, f.account, count(*) AS n, min(f.ts) AS first_ts, max(f.ts) AS last_ts,
    any_value(named_account) AS named_account, any_value(last_success) AS last_success
  FROM fails f JOIN ends USING (source_ip, account) LEFT JOIN wins USING (source_ip, account)
  WHERE f.ts >= m - INTERVAL {WINDOW_MINUTES} MINUTE GROUP BY f.source_ip, f.account)"""

_NONE = "CAST(NULL AS VARCHAR) AS file_path, CAST(NULL AS BIGINT) AS line_seq"

GUESSING = f"""
guessing AS (SELECT last_ts AS ts, 'brute_force' AS threat_type,
  CASE WHEN last_success IS NOT NULL THEN 5 WHEN n >= 50 THEN 4 WHEN n >= 20 THEN 3 ELSE 2 END AS level_value,
  source_ip, account AS target,
  'Brute force attack detected: ' || n || ' failed login attempts from ' || source_ip || ' targeting user ''' || account
    || '''' || CASE WHEN last_success IS NOT NULL THEN ' - SUCCESSFUL LOGIN DETECTED AFTER ATTACK' ELSE '' END AS description,
  least(n, 10) AS evidence_count, 'T1110.001' AS mitre,
  CASE WHEN last_success IS NOT NULL THEN ['URGENT: Force password reset for user ''' || account || '''',
    'Check for unauthorized activities from this account'] ELSE [] END ||
  ['Block IP address ' || source_ip || ' at the firewall', 'Review account ''' || account || ''' for unauthorized access',
   'Implement rate limiting on authentication endpoints', 'Consider implementing multi-factor authentication'] AS advice,
  'brute_force' AS detector, 0 AS detector_ord, {_NONE} FROM pairs WHERE n >= 5)"""
STUFFING = f"""
stuffing AS (SELECT max(last_ts) AS ts, 'credential_stuffing' AS threat_type, 4 AS level_value, source_ip,
  count(*) || ' accounts' AS target,
  'Credential stuffing attack detected: ' || source_ip || ' attempted to authenticate to ' || count(*) || ' different accounts' AS description,
  least(sum(n), 10) AS evidence_count, 'T1110.004' AS mitre,
  ['Block IP address ' || source_ip || ' immediately', 'Review all targeted accounts for compromise',
   'Implement CAPTCHA on login pages', 'Check if credentials appear in known breach databases'] AS advice,
  'brute_force' AS detector, 0 AS detector_ord, {_NONE} FROM pairs WHERE named_account GROUP BY source_ip HAVING count(*) >= 3)"""
DISTRIBUTED = f"""
distributed AS (SELECT max(last_ts) AS ts, 'distributed_brute_force' AS threat_type, 4 AS level_value,
  count(*) || ' IPs' AS source_ip, account AS target,
  'Distributed brute force attack detected: ' || count(*) || ' different IPs targeting user ''' || account || '''' AS description,
  least(sum(n), 10) AS evidence_count, 'T1110.003' AS mitre,
  ['Force password reset for user ''' || account || '''', 'Enable multi-factor authentication for this account',
   'Review source IPs for botnet indicators', 'Consider geo-blocking if IPs are from unusual locations'] AS advice,
  'brute_force' AS detector, 0 AS detector_ord, {_NONE} FROM pairs WHERE named_account GROUP BY account HAVING count(*) >= 10)"""

TRAILING = f"""
trailed AS (SELECT *, count(*) OVER (PARTITION BY source_ip, account ORDER BY ts, file_path, line_seq)
  - count(*) OVER (PARTITION BY source_ip, account ORDER BY ts
      RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '{WINDOW_MINUTES * 60}.000001 seconds' PRECEDING) AS trailing_count,
  min(ts) OVER (PARTITION BY source_ip, account ORDER BY ts
      RANGE BETWEEN INTERVAL '{WINDOW_MINUTES} minutes' PRECEDING AND CURRENT ROW) AS first_ts
  FROM fails),
online AS (SELECT ts, 'brute_force' AS threat_type, CASE WHEN trailing_count >= 50 THEN 4 WHEN trailing_count >= 20 THEN 3 ELSE 2 END AS level_value,
  source_ip, user_name AS target,
  'Brute force attack detected: ' || trailing_count || ' failed login attempts from ' || source_ip || ' targeting user ''' || account || '''' AS description,
  1 AS evidence_count, 'T1110.001' AS mitre, ['Block IP address ' || source_ip || ' at the firewall',
   'Review account ''' || coalesce(user_name, 'None') || ''' for unauthorized access',
   'Implement rate limiting on authentication endpoints', 'Consider implementing multi-factor authentication'] AS advice,
  line_seq, round(greatest(1.0, (epoch_us(ts) - epoch_us(first_ts)) / 6e7), 4) AS span_minutes
  FROM trailed WHERE trailing_count >= 5)"""

# -- web attacks --------------------------------------------------------------------------


def _decode(text: str, passes: int) -> str:
    for _ in range(passes):
        text = f"url_decode(replace({text}, '+', ' '))"
    return text


def sqli_text(text: str) -> str:
    return f"lower(regexp_replace({_decode(text, 3)}, '\\s+', ' ', 'g'))"


def xss_text(text: str) -> str:
    out = _decode(text, 3)
    for entity, char in HTML_ENTITIES:
        out = f"replace({out}, {quote(entity)}, {quote(char)})"
    return f"lower({out})"


def path_text(text: str) -> str:
    for _ in range(5):
        text = f"url_decode(replace({text}, '+', '%2B'))"
    return f"replace(replace({text}, '\\', '/'), chr(0), '')"


def _chain(text: str, patterns: dict[str, list[str]], more: str = "") -> str:
    arms = " ".join(
        f"WHEN regexp_matches({text}, {quote('(?i)' + p)}) THEN "
        f"{{'severity': '{sev}', 'pattern': '{sev}_{i}', 'matched': regexp_extract({text}, {quote('(?i)' + p)}, 0)}}"
        for sev, listed in patterns.items()
        for i, p in enumerate(listed)
    )
    return f"CASE WHEN {text} IN ('', '-') THEN NULL {arms} {more} END"


_CALLS = " ".join(
    "WHEN regexp_matches({t}, '\\b" + n + "\\s*\\(') THEN {{'severity': 'medium', 'pattern': 'sql_function_" + n
    + "', 'matched': '" + n + "'}}"
    for n in SQL_FUNCTIONS
)


def _web_chain(decoded: str, patterns: dict[str, list[str]], url: str, calls: str = "") -> str:
    parts = {"url": url, "referer": decoded.format("referer"), "user_agent": decoded.format("user_agent")}
    texts = ", ".join(f"{value} AS t_{name}" for name, value in parts.items())
    hits = ", ".join(f"{_chain(f't_{name}', patterns, calls.format(t=f't_{name}'))} AS h_{name}" for name in parts)
    return f"""(SELECT *, coalesce(h_url, h_referer, h_user_agent) AS hit,
  CASE WHEN h_url IS NOT NULL THEN 'url' WHEN h_referer IS NOT NULL THEN 'referer' ELSE 'user_agent' END AS place
  FROM (SELECT *, {hits} FROM (SELECT *, {texts} FROM e WHERE log_type IN ('apache', 'nginx', 'nginx_error'))))"""


_LEVEL = "CASE {0} WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 END"

SQLI_HITS = f"""
sqli_found AS {_web_chain(sqli_text('{0}'), SQLI, sqli_text(sqli_text('resource')), _CALLS)},
sqli_hits AS (SELECT ts, 'sql_injection' AS threat_type, {_LEVEL.format('hit.severity')} AS level_value, source_ip,
  resource AS target,
  'SQL injection attempt detected in ' || place || ': ''' || CASE WHEN length(hit.matched) > 50
    THEN hit.matched[:50] || '...' ELSE hit.matched END || '''' AS description,
  1 AS evidence_count, 'T1190' AS mitre,
  ['Block the source IP address', 'Review and patch vulnerable application code', 'Implement parameterized queries',
   'Deploy a Web Application Firewall (WAF)', 'Conduct application security assessment'] AS advice,
  'sql_injection' AS detector, 1 AS detector_ord, file_path, line_seq, hit.pattern AS pattern, place
  FROM sqli_found WHERE hit IS NOT NULL)"""
_RAISE = """
{name} AS (SELECT * EXCLUDE (per_ip, level_value, description),
  CASE WHEN per_ip >= {least} AND level_value < 4 THEN 4 ELSE level_value END AS level_value,
  CASE WHEN per_ip >= {least} AND level_value < 4 THEN description || '{note}' ELSE description END AS description
  FROM (SELECT *, count(*) OVER (PARTITION BY source_ip) AS per_ip FROM {hits}))"""
SQLI_ALERTS = SQLI_HITS + "," + _RAISE.format(
    name="sqli", hits="sqli_hits", least=3, note=" (Part of sustained attack campaign)"
)
XSS_ALERTS = f"""
xss_found AS {_web_chain(xss_text('{0}'), XSS, xss_text('resource'))},
xss AS (SELECT ts, 'xss' AS threat_type, {_LEVEL.format('hit.severity')} AS level_value, source_ip, resource AS target,
  'XSS attempt detected in ' || place || ': ''' || hit.matched[:50] || '''' AS description,
  1 AS evidence_count, 'T1059.007' AS mitre,
  ['Implement Content Security Policy (CSP)', 'Sanitize and encode all user input',
   'Use HTTPOnly and Secure cookie flags', 'Deploy XSS protection headers'] AS advice,
  'xss' AS detector, 2 AS detector_ord, file_path, line_seq, hit.pattern AS pattern, place
  FROM xss_found WHERE hit IS NOT NULL)"""
_TRAVERSAL = " OR ".join(f"regexp_matches(d, {quote('(?i)' + p)})" for p in TRAVERSAL)
_USUAL = (
    "['Validate and sanitize all file path inputs', 'Implement proper access controls', "
    "'Use chroot or containerization', 'Configure web server to deny access to sensitive files']"
)
TRAVERSAL_ALERTS = f"""
path_found AS (SELECT *, contains(d, '../') OR {_TRAVERSAL} AS traversal, {_chain('d', SENSITIVE_FILES)} AS hit,
  coalesce(status_code IN ({', '.join(map(str, SUCCESS_CODES))}), false) AS won
  FROM (SELECT *, {path_text('resource')} AS d FROM e
    WHERE log_type IN ('apache', 'nginx', 'nginx_error') AND resource <> '')),
path_hits AS (SELECT ts, 'directory_traversal' AS threat_type,
  CASE WHEN won THEN (CASE coalesce(hit.severity, 'medium') WHEN 'medium' THEN 4 ELSE 5 END)
    ELSE {_LEVEL.format("coalesce(hit.severity, 'medium')")} END AS level_value, source_ip, resource AS target,
  CASE WHEN won THEN 'SUCCESSFUL ' ELSE '' END
    || CASE WHEN traversal THEN 'Directory traversal' ELSE 'Sensitive file access' END
    || ' attempt: ' || coalesce(hit.matched, d)[:100] AS description,
  1 AS evidence_count, 'T1083,T1005' AS mitre,
  CASE WHEN won THEN ['URGENT: Review accessed file for data exposure', 'Check for lateral movement from this access']
    ELSE [] END || {_USUAL} AS advice,
  'directory_traversal' AS detector, 3 AS detector_ord, file_path, line_seq, coalesce(hit.pattern, '') AS pattern, d AS place
  FROM path_found WHERE traversal OR hit IS NOT NULL),{_RAISE.format(
    name="path", hits="path_hits", least=5, note=" (Multiple traversal attempts from same IP)")}"""

TRAVERSAL_TWICE = TRAVERSAL_ALERTS.replace("per_ip >= 5", "per_ip >= 2")

# -- unusual times ------------------------------------------------------------------------

_HOURS = ", ".join(map(str, HIGH_RISK_HOURS))


def _temporal(name: str, source: str, rare_hour: str, rare_weekend: str) -> str:
    return f"""
{name} AS (SELECT ts, 'temporal_anomaly' AS threat_type, CASE WHEN rare_hour OR rare_weekend THEN 3 ELSE 2 END AS level_value,
  source_ip, coalesce(nullif(user_name, ''), resource) AS target,
  'Temporal anomaly detected: ' || array_to_string([
    CASE WHEN hour(ts) < 6 OR hour(ts) > 22 THEN 'Access outside business hours (' || hour(ts) || ':00)' END,
    CASE WHEN hour(ts) IN ({_HOURS}) THEN 'Access during high-risk hour (' || hour(ts) || ':00 UTC)' END,
    CASE WHEN rare_hour THEN 'Unusual hour for user ' || user_name END,
    CASE WHEN rare_weekend THEN 'Weekend access unusual for user ' || user_name END], '; ') AS description,
  1 AS evidence_count, 'T1078' AS mitre,
  ['Verify the access was authorized', 'Check for signs of account compromise',
   'Review recent activity for this user', 'Consider implementing time-based access controls'] AS advice,
  'temporal_anomaly' AS detector, 4 AS detector_ord, file_path, line_seq
  FROM (SELECT *, coalesce(user_name <> '' AND events >= 20 AND {rare_hour}, false) AS rare_hour,
      coalesce(user_name <> '' AND events >= 20 AND isodow(ts) >= 6 AND {rare_weekend}, false) AS rare_weekend FROM {source})
  WHERE hour(ts) < 6 OR hour(ts) > 22 OR hour(ts) IN ({_HOURS}) OR rare_hour OR rare_weekend)"""


TEMPORAL = """
habits AS (SELECT *, count(*) OVER (PARTITION BY user_name) AS events,
  count(*) OVER (PARTITION BY user_name, hour(ts)) AS hour_events,
  count(*) FILTER (isodow(ts) >= 6) OVER (PARTITION BY user_name) AS weekend_events FROM e),""" + _temporal(
    "temporal", "habits", "hour_events / events < 0.02", "weekend_events / events < 0.1"
)
RUNNING = """
running AS (SELECT *, count(*) OVER w AS events, count(*) FILTER (isodow(ts) >= 6) OVER w AS weekend_events,
  count(*) OVER (PARTITION BY user_name, hour(ts) ORDER BY ts, file_path, line_seq) AS hour_events
  FROM e WHERE user_name <> '' WINDOW w AS (PARTITION BY user_name ORDER BY ts, file_path, line_seq))"""

# -- unusual places -----------------------------------------------------------------------

_DISTANCE = (
    "6371 * 2 * asin(sqrt(least(1.0, pow(sin(radians(latitude - plat) / 2), 2) + cos(radians(plat)) * "
    "cos(radians(latitude)) * pow(sin(radians(longitude - plon) / 2), 2))))"
)
PLACES = f"""
geo AS ({GEO_DUCK}),
located AS (SELECT e.*, geo.* EXCLUDE (ip) FROM e JOIN geo ON e.source_ip = geo.ip),
moved AS (SELECT *, lag(ts) OVER w AS pts, lag(latitude) OVER w AS plat, lag(longitude) OVER w AS plon,
  lag(city) OVER w AS pcity, lag(country) OVER w AS pcountry
  FROM located WHERE user_name <> '' WINDOW w AS (PARTITION BY user_name ORDER BY ts, file_path, line_seq)
  UNION ALL SELECT *, NULL, NULL, NULL, NULL, NULL FROM located WHERE coalesce(user_name, '') = ''),
travel AS (SELECT *, CASE WHEN pts < ts THEN {_DISTANCE} END AS distance_km,
  CASE WHEN pts < ts THEN (epoch_us(ts) - epoch_us(pts)) / 1e6 / 3600.0 END AS travel_hours FROM moved),
firsts AS (SELECT user_name, country_code, min(struct_pack(ts := ts, file_path := file_path, line_seq := line_seq)) AS f
  FROM located WHERE user_name <> '' GROUP BY ALL),
fresh AS (SELECT user_name, f, row_number() OVER (PARTITION BY user_name ORDER BY f) - 1 AS known_countries FROM firsts),
places AS (SELECT t.*, distance_km / travel_hours AS speed_kmh,
  country_code IN ('KP', 'IR', 'RU', 'CN', 'BY') AS high_risk,
  coalesce(distance_km / travel_hours > 1000, false) AS impossible_travel,
  fresh.user_name IS NOT NULL AS new_country, known_countries
  FROM travel t LEFT JOIN fresh ON known_countries >= 5 AND t.user_name = fresh.user_name AND t.ts = f.ts
    AND t.file_path = f.file_path AND t.line_seq = f.line_seq)"""
GEO_ALERTS = PLACES + """,
place_alerts AS (SELECT ts, 'geo_anomaly' AS threat_type,
  greatest(CASE WHEN is_tor THEN 4 WHEN is_vpn OR is_proxy THEN 2 END, CASE WHEN high_risk THEN 3 END,
    CASE WHEN impossible_travel THEN 4 END, CASE WHEN new_country THEN 3 END) AS level_value,
  source_ip, coalesce(nullif(user_name, ''), resource) AS target,
  'Geographic anomaly: ' || array_to_string([
    CASE WHEN is_tor THEN 'Tor exit node detected' WHEN is_vpn THEN 'VPN detected' WHEN is_proxy THEN 'Proxy detected' END,
    CASE WHEN high_risk THEN 'Access from high-risk country: ' || country END,
    CASE WHEN impossible_travel THEN 'Impossible travel detected: ' || printf('%.0f', distance_km) || 'km in '
      || printf('%.1f', travel_hours) || 'h (' || pcity || ', ' || pcountry || ' -> ' || city || ', ' || country || ')' END,
    CASE WHEN new_country THEN 'First access from new country: ' || country END], '; ') AS description,
  1 AS evidence_count, 'T1078,T1133' AS mitre,
  ['Verify the access was from an authorized location', 'Check for account compromise',
   'Consider implementing geo-blocking', 'Review VPN/anonymizer usage policies'] AS advice,
  'geo_anomaly' AS detector, 5 AS detector_ord, file_path, line_seq
  FROM places WHERE is_tor OR is_vpn OR is_proxy OR high_risk OR impossible_travel OR new_country)"""

# -- alerts as tables ---------------------------------------------------------------------

UNIFIED = (
    "ts, threat_type, CAST(level_value AS INTEGER) AS level_value, source_ip, target, description, "
    "CAST(evidence_count AS INTEGER) AS evidence_count, mitre, advice, detector, detector_ord, file_path, line_seq"
)
LEVEL = (
    "CASE level_value WHEN 5 THEN 'CRITICAL' WHEN 4 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' WHEN 2 THEN 'LOW' "
    "WHEN 1 THEN 'INFO' END"
)
ALERT_ID = (
    "substr(sha256(strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' "
    "ELSE strftime(ts, '.%f') END || threat_type || coalesce(source_ip, 'None') || coalesce(target, 'None')), 1, 12)"
)
ALERT_TABLE = (
    f"{ALERT_ID} AS alert_id, strftime(ts, {STAMP}) AS ts, threat_type, {LEVEL} AS level, source_ip, target, "
    "description, CAST(evidence_count AS INTEGER) AS evidence_count, mitre, array_to_string(advice, '|') AS recommendations"
)
ORDER = (
    "detector_ord, ts, file_path NULLS FIRST, line_seq NULLS FIRST, source_ip NULLS FIRST, target NULLS FIRST"
)

PARTS = {
    "brute_force": (f"{PAIRS},{GUESSING},{STUFFING},{DISTRIBUTED}", ["guessing", "stuffing", "distributed"]),
    "sql_injection": (SQLI_ALERTS, ["sqli"]),
    "xss": (XSS_ALERTS, ["xss"]),
    "directory_traversal": (TRAVERSAL_ALERTS, ["path"]),
    "temporal_anomaly": (TEMPORAL, ["temporal"]),
    "geo_anomaly": (GEO_ALERTS, ["place_alerts"]),
}


def with_alerts(entries: str, detectors: list[str], rest: str) -> str:
    """A query over ``found`` (alerts of the detectors), ``correlated`` and ``alerts`` (de-duplicated)."""
    bodies = ",".join(PARTS[d][0] for d in detectors)
    union = " UNION ALL ".join(f"SELECT {UNIFIED} FROM {t}" for d in detectors for t in PARTS[d][1])
    return f"""WITH e AS ({entries}),{bodies},
found AS ({union}),
vectors AS (SELECT source_ip, list_sort(list(DISTINCT threat_type)) AS v FROM found
  WHERE source_ip NOT IN ('', 'unknown') GROUP BY source_ip),
correlated AS (SELECT found.* EXCLUDE (level_value, description),
  CASE WHEN len(v) >= 2 AND level_value < 4 THEN 4 ELSE level_value END AS level_value,
  CASE WHEN len(v) >= 2 AND level_value < 4 THEN description || ' (Part of multi-vector attack)' ELSE description END AS description,
  coalesce(len(v) >= 2, false) AS coordinated_attack,
  CASE WHEN len(v) >= 2 THEN array_to_string(v, ',') END AS attack_vectors
  FROM found LEFT JOIN vectors USING (source_ip)),
alerts AS (SELECT * FROM correlated QUALIFY row_number() OVER (
  PARTITION BY threat_type, source_ip, target, strftime(ts, '%Y-%m-%d %H:%M') ORDER BY {ORDER}) = 1)
{rest}"""


def over(entries: str, body: str, rest: str) -> str:
    return f"WITH e AS ({entries}),{body} {rest}"
