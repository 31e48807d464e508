"""Writing alerts and entries out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from logvigil.schema import ISO_TIME_TEXT


def alert_records(alerts: DataFrame) -> DataFrame:
    """Alerts in their export form: iso time, level name and value, evidence only as a count."""
    return alerts.selectExpr(
        "alert_id", f"{ISO_TIME_TEXT} AS timestamp", "threat_type", "level", "level_value", "source_ip", "target",
        "description", "evidence_count", "mitre_attack", "recommendations", "metadata", "coordinated_attack",
        "attack_vectors",
    )


def entry_records(entries: DataFrame) -> DataFrame:
    """Entries in their export form."""
    return entries.selectExpr(
        f"{ISO_TIME_TEXT} AS timestamp", "source_ip", "destination_ip", "`user`", "action", "resource",
        "status_code", "message", "log_type", "metadata", "entry_hash",
    )


def as_json(records: DataFrame) -> DataFrame:
    """One JSON text per row, nulls written out."""
    return records.selectExpr("to_json(struct(*), map('ignoreNullFields', 'false')) AS json")


def csv_rows(alerts: DataFrame) -> DataFrame:
    """The seven columns of the CSV export."""
    return alerts.selectExpr(
        "alert_id", f"coalesce({ISO_TIME_TEXT}, '') AS timestamp", "level", "threat_type",
        "coalesce(source_ip, '') AS source_ip", "coalesce(target, '') AS target", "description",
    )


def write_json(alerts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines, in as many files as there are partitions."""
    alert_records(alerts).write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(alerts: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; quotes and commas inside texts are quoted."""
    csv_rows(alerts).write.mode(mode).option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def write_report(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """Every report table under its name."""
    for name, table in tables.items():
        table.write.mode(mode).format(fmt).save(f"{path.rstrip('/')}/{name}")
