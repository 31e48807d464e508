import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402

from logvigil.schema import conform_entries  # noqa: E402

T0 = datetime(2024, 1, 15, 10, 0, 0)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def entries_of(spark):
    """Entries from dicts; time is given as seconds after T0 (``at``) or as ``ts_local``."""

    def build(rows):
        full = []
        for seq, row in enumerate(rows):
            row = dict(row)
            at = row.pop("at", 0)
            full.append(
                (
                    row.get("ts_local", T0 + timedelta(seconds=at)), row.get("source_ip"), row.get("user"),
                    row.get("action"), row.get("resource"), row.get("status_code"), row.get("message", ""),
                    row.get("log_type", "auth"), row.get("raw_line", f"line {seq}"), row.get("referer"),
                    row.get("user_agent"), row.get("event_id"), row.get("file_path", "f"), row.get("line_seq", seq),
                )
            )
        ddl = (
            "ts_local timestamp_ntz, source_ip string, user string, action string, resource string, status_code int, "
            "message string, log_type string, raw_line string, referer string, user_agent string, event_id int, "
            "file_path string, line_seq bigint"
        )
        return conform_entries(spark.createDataFrame(full, ddl))

    return build


@pytest.fixture(scope="session")
def lines_of(spark):
    def build(lines, path="x.log"):
        rows = [(path, n, line) for n, line in enumerate(lines)]
        return spark.createDataFrame(rows, "file_path string, line_seq bigint, line string")

    return build
