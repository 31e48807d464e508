"""SQL injection, cross-site scripting and path traversal in web requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.functions.payload import detect_path, detect_sqli, detect_xss, first_source, literal, sqli_text
from logvigil.functions.signatures import SUCCESS_CODES
from logvigil.operators.skew import attach
from logvigil.schema import EVIDENCE_COLUMNS, EVIDENCE_STRUCT, ROW_ORDER, replace_columns, shape_alerts
from logvigil.session import stage

WEB_LOGS = ["apache", "nginx", "nginx_error"]

# Severity word to level.
SEVERITY_LEVEL = {"critical": 5, "high": 4, "medium": 3, "low": 2}


def _level(severity: str) -> str:
    return f"CASE {severity} " + " ".join(f"WHEN '{w}' THEN {v}" for w, v in SEVERITY_LEVEL.items()) + " ELSE 3 END"


def _web(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("log_type").isin(*WEB_LOGS))


def _advice(*texts: str) -> str:
    return "array(" + ", ".join(literal(t) for t in texts) + ")"


def _row_alerts(found: DataFrame, threat_type: str, detector_ord: int, **columns: str) -> DataFrame:
    """One alert per found row: the row's own columns plus the given SQL texts."""
    alerts = found.selectExpr(
        "ts", "ts_local", "tz_offset", "source_ip", "file_path", "line_seq",
        f"array({EVIDENCE_STRUCT}) AS evidence",
        "resource AS target",
        f"'{threat_type}' AS threat_type",
        *[f"{value} AS {name}" for name, value in columns.items()],
    )
    return shape_alerts(alerts, detector=threat_type, detector_ord=detector_ord)


# SQL texts: what each kind of attack looks for in a request. The url counts for SQL injection
# on its twice decoded form, referer and user agent on the form decoded once.
MATCHERS = {
    "sqli": first_source(
        detect_sqli, [("url", sqli_text("resource")), ("referer", "referer"), ("user_agent", "user_agent")]
    ),
    "xss": first_source(detect_xss, [("url", "resource"), ("referer", "referer"), ("user_agent", "user_agent")]),
    "path": f"CASE WHEN resource <> '' THEN {detect_path('resource')} END",
}

MATCH_COLUMNS = [*[c for c in EVIDENCE_COLUMNS if c != "entry_hash"], "tz_offset"]


def web_matches(entries: DataFrame, kinds: tuple[str, ...] = tuple(MATCHERS)) -> DataFrame:
    """Web requests with a match of any of the kinds, one struct column per kind.

    One pass over the logs serves all kinds. Only requests with a match leave it.
    """
    return (
        _web(entries)
        .selectExpr(*[f"`{c}`" for c in MATCH_COLUMNS], "referer", "user_agent")
        .selectExpr("*", *[f"{MATCHERS[kind]} AS {kind}" for kind in kinds])
        .where(" OR ".join(f"{kind} IS NOT NULL" for kind in kinds))
        .drop("referer", "user_agent")
    )


def sql_injection_hits(matches: DataFrame) -> DataFrame:
    """One alert per request with a SQL injection signature, without looking at other rows."""
    found = matches.where("sqli IS NOT NULL").withColumnRenamed("sqli", "_hit")
    text = "_hit.hit.matched"
    return _row_alerts(
        found,
        "sql_injection",
        1,
        level_value=_level("_hit.hit.severity"),
        # Description and advice.
        description=f"concat('SQL injection attempt detected in ', _hit.source, ': \\'', "
        f"CASE WHEN length({text}) > 50 THEN concat(substring({text}, 1, 50), '...') ELSE {text} END, '\\'')",
        mitre_attack="array('T1190')",
        recommendations=_advice(
            "Block the source IP address",
            "Review and patch vulnerable application code",
            "Implement parameterized queries",
            "Deploy a Web Application Firewall (WAF)",
            "Conduct application security assessment",
        ),
        metadata=f"to_json(named_struct('pattern_matched', _hit.hit.pattern, "
        f"'payload_excerpt', substring({text}, 1, 200), 'injection_point', _hit.source, "
        "'full_request', substring(resource, 1, 500)))",
    )


def xss_hits(matches: DataFrame) -> DataFrame:
    """One alert per request with a cross-site scripting signature."""
    found = matches.where("xss IS NOT NULL").withColumnRenamed("xss", "_hit")
    text = "_hit.hit.matched"
    return _row_alerts(
        found,
        "xss",
        2,
        level_value=_level("_hit.hit.severity"),
        # Description and advice.
        description=f"concat('XSS attempt detected in ', _hit.source, ': \\'', substring({text}, 1, 50), '\\'')",
        mitre_attack="array('T1059.007')",
        recommendations=_advice(
            "Implement Content Security Policy (CSP)",
            "Sanitize and encode all user input",
            "Use HTTPOnly and Secure cookie flags",
            "Deploy XSS protection headers",
        ),
        metadata=f"to_json(named_struct('pattern_matched', _hit.hit.pattern, "
        f"'payload_excerpt', substring({text}, 1, 200), 'injection_point', _hit.source))",
    )


def traversal_hits(matches: DataFrame) -> DataFrame:
    """One alert per request that leaves the web root or asks for a sensitive file.

    A successful response raises a finding by one step (medium to high, high to critical).
    """
    codes = ", ".join(str(c) for c in SUCCESS_CODES)
    found = (
        matches.where("path IS NOT NULL")
        .withColumnRenamed("path", "_hit")
        .selectExpr(
            "*",
            f"coalesce(status_code IN ({codes}), false) AS _won",
            "coalesce(_hit.file.severity, 'medium') AS _severity",
            "coalesce(_hit.file.matched, _hit.decoded) AS _file",
        )
    )
    usual = _advice(
        "Validate and sanitize all file path inputs",
        "Implement proper access controls",
        "Use chroot or containerization",
        "Configure web server to deny access to sensitive files",
    )
    urgent = _advice("URGENT: Review accessed file for data exposure", "Check for lateral movement from this access")
    return _row_alerts(
        found,
        "directory_traversal",
        3,
        level_value=_level("CASE WHEN _won THEN if(_severity = 'medium', 'high', 'critical') ELSE _severity END"),
        # Description and advice.
        description="concat(if(_won, 'SUCCESSFUL ', ''), "
        "if(_hit.traversal, 'Directory traversal', 'Sensitive file access'), ' attempt: ', substring(_file, 1, 100))",
        mitre_attack="array('T1083', 'T1005')",
        recommendations=f"if(_won, concat({urgent}, {usual}), {usual})",
        metadata="to_json(named_struct('target_file', _file, 'traversal_detected', _hit.traversal, "
        "'successful', _won, 'status_code', status_code, 'decoded_path', _hit.decoded))",
    )


def raise_repeat_offenders(alerts: DataFrame, min_alerts: int, note: str) -> DataFrame:
    """Raise every alert of an ip with at least ``min_alerts`` alerts to HIGH.

    The counts are looked up per ip instead of a window over the ip, so an ip with a third
    of all alerts does not end in one task.
    """
    per_ip = (
        alerts.where("source_ip <> ''")
        .groupBy("source_ip")
        .agg(F.count(F.lit(1)).alias("_alerts"))
    )
    counted = attach(alerts, per_ip, ["source_ip"], "_alerts", ROW_ORDER)
    raised = f"coalesce(_alerts >= {min_alerts}, false) AND level_value < 4"
    changed = {
        "level_value": f"if({raised}, 4, level_value)",
        "level": f"if({raised}, 'HIGH', level)",
        "description": f"if({raised}, concat(description, {literal(note)}), description)",
    }
    return replace_columns(counted, alerts.columns, changed)


def _matches(entries: DataFrame, kind: str, staged: bool) -> DataFrame:
    matches = web_matches(entries, (kind,))
    return stage(matches, f"{kind}-matches") if staged else matches


def sql_injection_alerts(
    entries: DataFrame, campaign: int = 3, staged: bool = True, matches: DataFrame | None = None
) -> DataFrame:
    """SQL injection alerts; an ip with a campaign has all of them at HIGH or above."""
    hits = sql_injection_hits(_matches(entries, "sqli", staged) if matches is None else matches)
    return raise_repeat_offenders(hits, campaign, " (Part of sustained attack campaign)")


def xss_alerts(entries: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Cross-site scripting alerts (no escalation over rows)."""
    return xss_hits(web_matches(entries, ("xss",)) if matches is None else matches)


def traversal_alerts(
    entries: DataFrame, repeats: int = 5, staged: bool = True, matches: DataFrame | None = None
) -> DataFrame:
    """Traversal alerts; repeat offenders have all of them at HIGH or above."""
    hits = traversal_hits(_matches(entries, "path", staged) if matches is None else matches)
    return raise_repeat_offenders(hits, repeats, " (Multiple traversal attempts from same IP)")
