"""Column layout shared by parsers, detectors and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

# Severity names and their order.
LEVEL_VALUES = {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}

ENTRY_TYPES: dict[str, str] = {
    "ts": "timestamp",
    "ts_local": "timestamp_ntz",
    "tz_offset": "string",
    "ts_fallback": "boolean",
    "source_ip": "string",
    "destination_ip": "string",
    "user": "string",
    "action": "string",
    "resource": "string",
    "status_code": "int",
    "message": "string",
    "log_type": "string",
    "raw_line": "string",
    "referer": "string",
    "user_agent": "string",
    "event_id": "int",
    "hostname": "string",
    "process": "string",
    "metadata": "map<string,string>",
    "entry_hash": "string",
    "file_path": "string",
    "line_seq": "bigint",
}

# What an alert keeps of each supporting entry.
EVIDENCE_COLUMNS = [
    "ts", "ts_local", "source_ip", "user", "action", "resource", "status_code",
    "message", "log_type", "raw_line", "entry_hash", "file_path", "line_seq",
]

ALERT_TYPES: dict[str, str] = {
    "alert_id": "string",
    "ts": "timestamp",
    "ts_local": "timestamp_ntz",
    "tz_offset": "string",
    "threat_type": "string",
    "level": "string",
    "level_value": "int",
    "source_ip": "string",
    "target": "string",
    "description": "string",
    "evidence": "array<struct<" + ",".join(f"{c}:{ENTRY_TYPES[c]}" for c in EVIDENCE_COLUMNS) + ">>",
    "evidence_count": "int",
    "mitre_attack": "array<string>",
    "recommendations": "array<string>",
    "metadata": "string",
    "coordinated_attack": "boolean",
    "attack_vectors": "array<string>",
    "detector": "string",
    "detector_ord": "int",
    "file_path": "string",
    "line_seq": "bigint",
}

# A total order over rows: the event time, then the place in the input.
ROW_ORDER = ["ts", "file_path", "line_seq"]


def ddl(types: dict[str, str]) -> str:
    """A layout as Spark schema text."""
    return ", ".join(f"`{name}` {kind}" for name, kind in types.items())


# SQL text: a timestamp as Python's str(datetime) writes it (micros and zone only when present).
TIME_TEXT = (
    "concat(date_format(ts_local, 'yyyy-MM-dd HH:mm:ss'), "
    "CASE WHEN date_format(ts_local, 'SSSSSS') = '000000' THEN '' "
    "ELSE concat('.', date_format(ts_local, 'SSSSSS')) END, coalesce(tz_offset, ''))"
)
# SQL text: the same in ISO form, as datetime.isoformat() writes it.
ISO_TIME_TEXT = f"replace({TIME_TEXT}, ' ', 'T')"

# SQL text: sixteen hex digits of sha256 over time, ip, message and raw line.
ENTRY_HASH = (
    f"substring(sha2(concat(coalesce({TIME_TEXT}, 'None'), coalesce(source_ip, 'None'), "
    "coalesce(message, ''), coalesce(raw_line, '')), 256), 1, 16)"
)
# SQL text: twelve hex digits of sha256 over time, threat type, ip and target.
ALERT_ID = (
    f"substring(sha2(concat(coalesce({TIME_TEXT}, 'None'), threat_type, coalesce(source_ip, 'None'), "
    "coalesce(target, 'None')), 256), 1, 12)"
)
LEVEL_NAME = (
    "CASE level_value " + " ".join(f"WHEN {v} THEN '{name}'" for name, v in LEVEL_VALUES.items()) + " END"
)
# SQL text: an entry as evidence. The hash is computed here, for alerts only.
EVIDENCE_STRUCT = (
    "struct("
    + ", ".join(f"{ENTRY_HASH} AS entry_hash" if c == "entry_hash" else f"`{c}`" for c in EVIDENCE_COLUMNS)
    + ")"
)


def project(df: DataFrame, types: dict[str, str], computed: dict[str, str]) -> DataFrame:
    """Select all columns of a layout: computed ones, present ones, nulls for the rest."""
    have = dict(df.dtypes)

    def column(name: str, ddl: str) -> str:
        if name in computed:
            return f"CAST({computed[name]} AS {ddl}) AS `{name}`"
        if have.get(name) == ddl:
            return f"`{name}`"
        return f"CAST({f'`{name}`' if name in have else 'NULL'} AS {ddl}) AS `{name}`"

    return df.selectExpr(*[column(name, ddl) for name, ddl in types.items()])


def replace_columns(df: DataFrame, columns: list[str], changed: dict[str, str]) -> DataFrame:
    """Select columns, some of them rewritten by an SQL text over the old ones."""
    return df.selectExpr(*[f"{changed[c]} AS `{c}`" if c in changed else f"`{c}`" for c in columns])


def conform_entries(df: DataFrame) -> DataFrame:
    """Bring any frame with some of the entry columns to the full entry layout.

    Only ``ts`` or ``ts_local`` is required. A naive time counts as UTC, which is also
    the session time zone this package expects.
    """
    have = set(df.columns)
    if "ts" not in have and "ts_local" not in have:
        raise ValueError("entries need a ts or ts_local column")
    defaults = {"ts_fallback": "false", "message": "''", "raw_line": "''", "log_type": "'unknown'", "file_path": "''"}
    computed = {c: f"coalesce(`{c}`, {v})" if c in have else v for c, v in defaults.items()}
    if "ts" not in have:
        computed["ts"] = "ts_local"
    if "ts_local" not in have:
        computed["ts_local"] = "ts"
    if "line_seq" not in have:
        computed["line_seq"] = "monotonically_increasing_id()"
    if "entry_hash" in have:
        return project(df, ENTRY_TYPES, computed)
    shaped = project(df, {c: t for c, t in ENTRY_TYPES.items() if c != "entry_hash"}, computed)
    return project(shaped, ENTRY_TYPES, {"entry_hash": ENTRY_HASH})


def shape_alerts(df: DataFrame, *, detector: str, detector_ord: int) -> DataFrame:
    """Project a detector's typed result to the alert layout and give every alert its id."""
    computed = {
        "alert_id": ALERT_ID,
        "level": LEVEL_NAME,
        "evidence_count": "coalesce(size(evidence), 0)",
        "coordinated_attack": "false",
        "detector": f"'{detector}'",
        "detector_ord": str(detector_ord),
    }
    return project(df, ALERT_TYPES, computed)
