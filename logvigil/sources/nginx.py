"""Nginx access and error logs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from logvigil.functions.lines import LineParser, extract, groups, http_clock, http_zone, no_dash, optional, parse, zone_minutes

# Fixed value: ip, user, time, request, status, bytes, referer, agent, forwarded for.
ACCESS = (
    r"^([\d.]+|[\da-fA-F:]+)\s+-\s+(\S+)\s+\[([^\]]+)\]\s+"
    r'"([^"]*)"\s+(\d{3})\s+(\d+|-)\s*(?:"([^"]*)"\s*)?(?:"([^"]*)")?(?:\s+"([^"]*)")?'
)
# Fixed value: time, level, pid, tid, connection, message.
ERROR = (
    r"^(\d{4}/\d{2}/\d{2}\s+\d{2}:\d{2}:\d{2})\s+\[(\w+)\]\s+(\d+)#(\d+):\s*(?:\*(\d+)\s+)?(.+)$"
)


def matched_access(line: str) -> str:
    return groups(line, ACCESS, 9)


def matched_error(line: str) -> str:
    return groups(line, ERROR, 6)


def parser(line: str = "line", year: int | None = None) -> LineParser:
    """Nginx lines: access format first, else error format.

    The first hop of X-Forwarded-For stands for the client when there is one.
    """
    steps = (
        {"nx": matched_access(line)},
        {"ne": f"CASE WHEN nx IS NULL THEN {matched_error(line)} END"},
        {
            "nx_access": "nx IS NOT NULL",
            "nx_parts": "filter(split(trim(nx[4]), '\\\\s+'), p -> p <> '')",
            "nx_zone": http_zone("nx[3]"),
        },
    )
    return LineParser(
        "nginx",
        steps,
        "nx_access OR ne IS NOT NULL",
        {
            "source_ip": "CASE WHEN nx_access THEN if(nx[9] NOT IN ('', '-'), trim(split(nx[9], ',')[0]), nx[1]) "
            f"ELSE {extract('ne[6]', r'client:\s*([\d.]+)')} END",
            "user": f"if(nx_access, {no_dash('nx[2]')}, NULL)",
            "action": "if(nx_access, coalesce(get(nx_parts, 0), 'GET'), 'ERROR')",
            "resource": "if(nx_access, coalesce(get(nx_parts, 1), '/'), NULL)",
            "status_code": "if(nx_access, CAST(nx[5] AS INT), NULL)",
            "message": "if(nx_access, nx[4], ne[6])",
            "log_type": "if(nx_access, 'nginx', 'nginx_error')",
            "referer": f"if(nx_access, {optional('nx[7]')}, NULL)",
            "user_agent": f"if(nx_access, {optional('nx[8]')}, NULL)",
            "metadata": "if(nx_access, map('protocol', coalesce(get(nx_parts, 2), 'HTTP/1.1'), "
            "'response_size', if(nx[6] = '-', '0', CAST(CAST(nx[6] AS DECIMAL(38, 0)) AS STRING)), 'original_ip', nx[1], "
            f"'x_forwarded_for', {optional('nx[9]')}), "
            f"map('level', ne[2], 'pid', ne[3], 'tid', ne[4], 'connection_id', {optional('ne[5]')}))",
        },
        f"CASE WHEN NOT nx_access THEN try_to_timestamp(regexp_replace(ne[1], '\\\\s+', ' '), 'yyyy/MM/dd HH:mm:ss') "
            f"WHEN nx_zone <> '' THEN {http_clock('nx[3]')} END",
        f"if(nx_access, {zone_minutes('nx_zone')}, NULL)",
    )


def parse_nginx(lines: DataFrame, now: datetime | None = None, year: int | None = None) -> DataFrame:
    """Entries of Nginx lines."""
    return parse(lines, parser(), now)
