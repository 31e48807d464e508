"""Syslog lines after RFC 5424, RFC 3164 and a minimal form."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from logvigil.functions.lines import (
    LineParser, bsd_clock, extract, groups, iso_clock, iso_zone, lookup, optional, parse, zone_minutes,
)
from logvigil.functions.payload import bind

# Facility and severity names by code.
FACILITIES = dict(
    enumerate(
        ["kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news", "uucp", "cron", "authpriv", "ftp", "ntp", "security",
         "console", "solaris-cron", "local0", "local1", "local2", "local3", "local4", "local5", "local6", "local7"]
    )
)
SEVERITIES = dict(enumerate(["emergency", "alert", "critical", "error", "warning", "notice", "info", "debug"]))

# Fixed values. RFC 3164: priority, time, host, process, pid, message.
RFC3164 = (
    r"^(?:<(\d{1,3})>)?(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s*(.*)$"
)
# RFC 5424: priority, version, time, host, app, procid, msgid, structured data, message. The possessive group over elements
# without a closing bracket matches what a lazy one would and does not recurse, however many elements a line has.
RFC5424 = (
    r"^<(\d{1,3})>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+((?:\[[^\]]*\])*+|-)\s*(.*)$"
)
# Minimal: time, host, message.
SIMPLE = r"^(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+(.*)$"

# Where a message names an ip or a user, in order.
IP_PATTERNS = [
    r"from\s+([\d.]+)",
    r"src=([\d.]+)",
    r"SRC=([\d.]+)",
    r"client\s+([\d.]+)",
    r"rhost=([\d.]+)",
    r"\b(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})\b",
]
USER_PATTERNS = [
    r"user[=:\s]+(\S+)",
    r"for\s+(?:user\s+)?(\w+)",
    r"USER=(\S+)",
    r"by\s+(\w+)",
    r"session\s+(?:opened|closed)\s+for\s+(?:user\s+)?(\w+)",
]

DEFAULT_PRIORITY = 13


def facility(priority: str) -> str:
    return lookup(f"{priority} div 8", FACILITIES, "'unknown'")


def severity(priority: str) -> str:
    return lookup(f"{priority} % 8", SEVERITIES, "'unknown'")


def message_ip(message: str) -> str:
    """The first ip the patterns find."""
    return f"coalesce({', '.join(extract(message, p) for p in IP_PATTERNS)})"


def message_user(message: str) -> str:
    """The first user the patterns find; placeholders make way for the next pattern."""
    names = [
        bind("u", extract(message, "(?i)" + p), "CASE WHEN lower(u) NOT IN ('unknown', 'invalid', '(unknown)') THEN u END")
        for p in USER_PATTERNS
    ]
    return f"coalesce({', '.join(names)})"


def matched_5424(line: str) -> str:
    return groups(line, RFC5424, 9)


def matched_3164(line: str) -> str:
    return groups(line, RFC3164, 6)


def matched_simple(line: str) -> str:
    return groups(line, SIMPLE, 3)


def parser(line: str = "line", year: int | None = None) -> LineParser:
    """Syslog lines; the three forms are tried in order."""
    year = year if year is not None else datetime.now().year
    steps = (
        {"sn": matched_5424(line)},
        {"so": f"CASE WHEN sn IS NULL THEN {matched_3164(line)} END"},
        {"ss": f"CASE WHEN sn IS NULL AND so IS NULL THEN {matched_simple(line)} END"},
        {
            "sy_message": "coalesce(sn[9], so[6], ss[3])",
            "sy_host": "coalesce(sn[4], so[3], ss[2])",
            "sy_process": "coalesce(sn[5], so[4])",
            "sy_priority": "CASE WHEN sn IS NOT NULL THEN CAST(sn[1] AS INT) WHEN so IS NOT NULL "
            f"THEN coalesce(try_cast(so[1] AS INT), {DEFAULT_PRIORITY}) END",
            "sy_clock": f"CASE WHEN sn IS NOT NULL THEN {iso_clock('sn[3]', '(?:Z|[+-]' + chr(92) + 'd{2}:?' + chr(92) + 'd{2})')} "
            f"ELSE {bsd_clock('coalesce(so[2], ss[1])', year)} END",
            "sy_zone": f"CASE WHEN sn IS NOT NULL THEN {zone_minutes(iso_zone('sn[3]'))} END",
        },
    )
    return LineParser(
        "syslog",
        steps,
        "sy_message IS NOT NULL",
        {
            "source_ip": message_ip("sy_message"),
            "user": message_user("sy_message"),
            "action": "coalesce(sy_process, 'syslog')",
            "message": "sy_message",
            "log_type": "'syslog'",
            "hostname": "sy_host",
            "process": "sy_process",
            "metadata": "CASE WHEN sy_priority IS NULL THEN map('hostname', sy_host) ELSE map_concat("
            f"map('pid', CASE WHEN sn IS NOT NULL THEN sn[6] ELSE {optional('so[5]')} END, "
            f"'facility_code', CAST(sy_priority div 8 AS STRING), 'facility', {facility('sy_priority')}, "
            f"'severity_code', CAST(sy_priority % 8 AS STRING), 'severity', {severity('sy_priority')}), "
            "CASE WHEN sn IS NOT NULL THEN map('msgid', sn[7], 'structured_data', sn[8]) "
            "ELSE CAST(map() AS MAP<STRING, STRING>) END) END",
        },
        "sy_clock",
        "sy_zone",
    )


def parse_syslog(lines: DataFrame, now: datetime | None = None, year: int | None = None) -> DataFrame:
    """Entries of syslog lines."""
    return parse(lines, parser(year=year), now)
