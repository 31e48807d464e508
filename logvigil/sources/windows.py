"""Windows security events: text, CSV and XML exports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from logvigil.functions.lines import LineParser, emit, groups, iso_clock, lookup, optional, parse
from logvigil.functions.payload import literal

# Event id to category.
EVENT_CATEGORIES = {
    4624: "logon_success", 4625: "logon_failure", 4634: "logoff", 4647: "logoff", 4648: "logon_success",
    4672: "privilege_use",
    4720: "account_management", 4722: "account_management", 4723: "account_management",
    4724: "account_management", 4725: "account_management", 4726: "account_management",
    4728: "account_management", 4732: "account_management", 4756: "account_management",
    4688: "process", 4689: "process",
}

# Logon type names.
LOGON_TYPES = {
    2: "Interactive (local keyboard)",
    3: "Network (SMB, shared folders)",
    4: "Batch (scheduled task)",
    5: "Service",
    7: "Unlock",
    8: "NetworkCleartext",
    9: "NewCredentials",
    10: "RemoteInteractive (RDP)",
    11: "CachedInteractive",
}

# Why a logon failed.
FAILURE_REASONS = {
    "0xc0000064": "User does not exist",
    "0xc000006a": "Incorrect password",
    "0xc000006d": "Bad username or password",
    "0xc000006e": "Account restriction",
    "0xc000006f": "Logon outside allowed hours",
    "0xc0000070": "Logon from unauthorized workstation",
    "0xc0000071": "Expired password",
    "0xc0000072": "Account disabled",
    "0xc00000dc": "Server in wrong state",
    "0xc0000133": "Clocks out of sync",
    "0xc000015b": "Logon type not granted",
    "0xc000018c": "Trust relationship failed",
    "0xc0000192": "NetLogon service not started",
    "0xc0000193": "Account expired",
    "0xc0000224": "Password must change",
    "0xc0000225": "Windows bug",
    "0xc0000234": "Account locked out",
}

# Fixed values. Text: date, time, level, source, event id, task category.
TEXT = (
    r"^(\d{1,2}/\d{1,2}/\d{4})\s+(\d{1,2}:\d{2}:\d{2}\s*(?:AM|PM)?)\s+(\w+)\s+(\S+)\s+(\d+)\s+([^,\t]+)?"
)
# CSV: level, time, source, event id.
CSV = r'^"?(\w+)"?\s*,\s*"?([^",]+)"?\s*,\s*"?([^",]+)"?\s*,\s*"?(\d+)"?'


def category(event_id: str) -> str:
    return lookup(event_id, EVENT_CATEGORIES, "'other'")


def logon_type_name(logon_type: str) -> str:
    return lookup(f"try_cast({logon_type} AS INT)", LOGON_TYPES, logon_type)


def failure_reason(status: str, sub_status: str) -> str:
    """From the status, else from the sub status."""
    return (
        f"coalesce({lookup(f'lower({status})', FAILURE_REASONS, 'NULL')}, "
        f"{lookup(f'lower({sub_status})', FAILURE_REASONS, 'NULL')})"
    )


REASON = failure_reason("data['Status']", "data['SubStatus']")


def matched_text(line: str) -> str:
    return groups(line, TEXT, 6)


def matched_csv(line: str) -> str:
    return groups(line, CSV, 4)


def parser(line: str = "line", year: int | None = None) -> LineParser:
    """One-line event headers: text format first, else CSV."""
    return LineParser(
        "windows",
        (
            {"wt": matched_text(line)},
            {"wc": f"CASE WHEN wt IS NULL THEN {matched_csv(line)} END"},
            {
                "w_id": "CAST(coalesce(wt[5], wc[4]) AS INT)",
                "w_at": "regexp_replace(CASE WHEN wt IS NOT NULL THEN concat(wt[1], ' ', trim(wt[2])) ELSE wc[2] END, '\\\\s+', ' ')",
            },
            {"w_type": category("w_id")},
        ),
        "w_id IS NOT NULL",
        {
            "action": "w_type",
            "status_code": "w_id",
            "message": "line",
            "log_type": "'windows'",
            "event_id": "w_id",
            "metadata": "map_concat(map('level', coalesce(wt[3], wc[1]), 'source', coalesce(wt[4], wc[3]), 'event_type', w_type), "
            f"CASE WHEN wt IS NOT NULL THEN map('task_category', {optional('wt[6]')}) "
            "ELSE CAST(map() AS MAP<STRING, STRING>) END)",
        },
        "coalesce(try_to_timestamp(w_at, 'M/d/yyyy h:m:s a'), CASE WHEN wt IS NOT NULL THEN try_to_timestamp(w_at, 'M/d/yyyy H:m:s') END)",
    )


def parse_windows(lines: DataFrame, now: datetime | None = None, year: int | None = None) -> DataFrame:
    """Entries of one-line event headers."""
    return parse(lines, parser(), now)


XML_SCHEMA = (
    "System STRUCT<EventID: STRING, TimeCreated: STRUCT<_SystemTime: STRING>, Computer: STRING>, "
    "EventData STRUCT<Data: ARRAY<STRUCT<_Name: STRING, _VALUE: STRING>>>"
)


def split_xml_events(documents: DataFrame) -> DataFrame:
    """One row per event from rows whose ``line`` holds one or many XML events."""
    event = literal(r"(?s)(<(?:\w+:)?Event[\s>].*?</(?:\w+:)?Event>)")
    return documents.selectExpr(
        "file_path", "line_seq", f"posexplode(regexp_extract_all(line, {event}, 1)) AS (place, line)"
    ).selectExpr("file_path", "line_seq", "place", "line")


def parse_windows_xml(documents: DataFrame, now: datetime | None = None, year: int | None = None) -> DataFrame:
    """Entries of XML events held in ``line`` (one event or many, with or without namespace)."""
    events = split_xml_events(documents)
    # The generator keeps later filters from parsing the XML once more.
    return _xml_entries(
        events.selectExpr(
            "file_path", "line_seq", "substring(line, 1, 500) AS raw_line",
            "inline(array(from_xml(regexp_replace(line, '(</?)\\\\w+:', '$1'), "
            f"'{XML_SCHEMA}', map('rowTag', 'Event'))))",
        ),
        now,
    )


def read_windows_xml(spark: SparkSession, paths: list[str] | str, now: datetime | None = None) -> DataFrame:
    """Entries of XML event files; Spark splits the files at the Event elements."""
    events = (
        spark.read.format("xml").option("rowTag", "Event").option("ignoreNamespace", "true")
        .schema(XML_SCHEMA).load(paths)
    )
    return _xml_entries(
        events.selectExpr(
            "_metadata.file_path AS file_path", "monotonically_increasing_id() AS line_seq",
            "substring(to_xml(struct(System, EventData), map('rowTag', 'Event')), 1, 500) AS raw_line",
            "System", "EventData",
        ),
        now,
    )


def _xml_entries(events: DataFrame, now: datetime | None) -> DataFrame:
    # Of data with the same name the last one counts: it is the first from behind.
    last = "element_at(texts, -CAST(array_position(backwards, n) AS INT))"
    rows = (
        events.selectExpr(
            "*",
            "raw_line AS line",
            "if(coalesce(trim(System.EventID), '') = '', 0, try_cast(System.EventID AS INT)) AS event_id",
            "coalesce(EventData.Data._Name, array()) AS names",
            "transform(EventData.Data._VALUE, v -> coalesce(v, '')) AS texts",
        )
        .selectExpr("*", "reverse(names) AS backwards", "array_distinct(filter(names, n -> n <> '')) AS told")
        .selectExpr("*", f"map_from_arrays(told, transform(told, n -> {last})) AS data")
        .selectExpr(
            "*",
            f"{category('event_id')} AS event_type",
            "coalesce(System.Computer, 'unknown') AS hostname",
            "nullif(coalesce(data['IpAddress'], data['SourceNetworkAddress']), '-') AS ip",
            "coalesce(data['TargetUserName'], data['SubjectUserName']) AS who",
            "nullif(data['LogonType'], '') AS logon_type",
        )
    )
    return emit(
        rows,
        "System IS NOT NULL AND event_id IS NOT NULL "
            "AND (logon_type IS NULL OR try_cast(logon_type AS INT) IS NOT NULL)",
        {
            "source_ip": "nullif(ip, '')",
            "user": "who",
            "action": "event_type",
            "status_code": "event_id",
            "message": "concat('Event ', event_id, ': ', event_type, if(who <> '', concat(' - User: ', who), ''), "
            "if(ip <> '', concat(' from ', ip), ''))",
            "log_type": "'windows'",
            "event_id": "event_id",
            "hostname": "hostname",
            "metadata": "map_concat(map('event_type', event_type, "
            f"'logon_type', {logon_type_name('logon_type')}, "
            f"'failure_reason', {REASON}), "
            "map_filter(data, (k, v) -> k NOT IN ('IpAddress', 'TargetUserName', 'event_type', 'logon_type', "
            "'failure_reason')))",
        },
        iso_clock('System.TimeCreated._SystemTime', 'Z?'),
        "NULL",
        now,
    )
