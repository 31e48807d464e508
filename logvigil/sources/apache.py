"""Apache access logs, Common and Combined format."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame

from logvigil.functions.lines import LineParser, groups, http_clock, http_zone, no_dash, optional, parse, zone_minutes

# Fixed value: ip, ident, user, time, method, path, protocol, status, size, referer, agent.
LINE = (
    r"^([\d.]+|[\da-fA-F:]+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"
    r'"(\w+)\s+(\S+)\s*([^"]*)?"\s+(\d{3})\s+(\S+)(?:\s+"([^"]*)"\s+"([^"]*)")?'
)


def matched(line: str) -> str:
    return groups(line, LINE, 11)


def parser(line: str = "line", year: int | None = None) -> LineParser:
    """Apache access lines."""
    return LineParser(
        "apache",
        ({"ap": matched(line)},),
        "ap IS NOT NULL",
        {
            "source_ip": "ap[1]",
            "user": no_dash("ap[3]"),
            "action": "ap[5]",
            "resource": "ap[6]",
            "status_code": "CAST(ap[8] AS INT)",
            "message": "concat(ap[5], ' ', ap[6])",
            "log_type": "'apache'",
            "referer": optional("ap[10]"),
            "user_agent": optional("ap[11]"),
            "metadata": "map('protocol', ap[7], 'response_size', if(rlike(ap[9], '^[0-9]+$'), CAST(CAST(ap[9] AS DECIMAL(38, 0)) AS STRING), '0'), "
            "'ident', ap[2])",
        },
        http_clock("ap[4]"),
        zone_minutes(http_zone("ap[4]")),
    )


def parse_apache(lines: DataFrame, now: datetime | None = None, year: int | None = None) -> DataFrame:
    """Entries of Apache access lines."""
    return parse(lines, parser(), now)
