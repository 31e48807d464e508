"""WARC archives: distributed writing with revisit records, and reading by boundary-chain verification."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logvigil.session import shared_dir, stage

MAGIC = "WARC/1.1\r\n"
BLANK_LINE = "\r\n\r\n"  # ends the header, and ends the record
MIN_REVISIT_BYTES = 100
RECORDS_PER_FILE = 50_000


def _revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``page_id, payload_digest, refers_to`` of pages whose payload an earlier page has."""
    long_ones = pages.where(F.octet_length("payload") >= min_bytes).select("page_id", F.sha2("payload", 256).alias("payload_digest"))
    groups = long_ones.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    found = long_ones.join(groups.where("n > 1").drop("n"), "payload_digest")
    return found.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct()


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
) -> None:
    """Write one record per row: ``response`` with the payload, or ``revisit`` of the smallest id with an equal payload.

    Equal means equal SHA-256. Payloads under ``min_revisit_bytes`` are always responses. The revisit rows
    are written once as a small table; Spark joins it by its true size, so payloads are not shuffled unless revisits are many. Spark's text
    writer puts the blank line after every record. Null payloads are empty; a null url is an empty one, blanks
    in urls are escaped; rows with the same id and payload are responses alike; a null id never is what others refer to.
    """
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\x00-\x20\x7F]+", "%20").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    )
    refs = stage(_revisits(rows, min_revisit_bytes), "revisits").withColumnsRenamed({"page_id": "_id", "payload_digest": "_digest"})
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    rows = rows.join(refs, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    again = F.col("refers_to").isNotNull()
    body = F.when(again, F.lit(b"")).otherwise(F.col("payload"))

    def line(name: str, value) -> F.Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    header = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.octet_length("payload").cast("string")),
        F.when(again, F.concat(
            line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        )).otherwise(""),
        F.lit("Content-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(BLANK_LINE),
    )
    record = F.concat(header.cast("binary"), body).cast("string").alias("value")
    rows.select(record).write.option("lineSep", BLANK_LINE).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """What stands between two magics, with its place: file, split, and order in the split."""
    return spark.read.option("lineSep", MAGIC).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )


def _field(name: str) -> F.Column:
    return F.regexp_extract("header", rf"(?im)^{name}: *(.*?)\r?$", 1)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One row per magic: its offset, header, successor, and the digest of the body that follows.

    Splits of any file are read by many tasks; a split's rows get their order in it, and offsets are a running sum in the split plus the
    bytes of the splits before it. The chunk before the first magic of a file has offset -10 and no header.
    """
    magic = len(MAGIC)
    raw = _chunks(spark, path).withColumn("header", F.substring_index("value", BLANK_LINE, 1))
    long = F.octet_length("value")
    head = F.octet_length("header")
    parsed = raw.select(
        "file", "block", "seq", long.cast("bigint").alias("size"), F.when(head < long, F.col("header")).alias("header"),
        head.cast("bigint").alias("head"), F.expr("try_cast(nullif(regexp_extract(header, '(?im)^Content-Length: *([0-9]+) *\\r?$', 1), '') AS BIGINT)").alias("length"),
        F.col("value").cast("binary").alias("bytes"),
    )
    whole = (F.col("head") + 8 + F.col("length")) == F.col("size")
    rows = parsed.select(
        "file", "block", "seq", "size", "header", F.when(F.col("header").isNotNull(), F.col("length")).alias("length"), "head",
        F.when(whole, F.sha2(F.substring(F.col("bytes"), F.col("head").cast("int") + 5, F.col("length").cast("int")), 256)).alias("sha256"),
    )
    split = Window.partitionBy("file", "block").orderBy("seq")
    inside = rows.withColumn("_end", F.sum(F.col("size") + magic).over(split)).withColumn("idx", F.row_number().over(split))
    totals = inside.groupBy("file", "block").agg(F.max("_end").alias("_bytes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", "block", F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_base"))
    off = F.col("_base") + F.col("_end") - F.col("size") - 2 * magic
    return inside.join(bases, ["file", "block"]).select(
        "file", "block", "idx", "size", "header", "length", "head", "sha256", off.alias("off"),
        (off + magic + F.col("head") + 4 + F.col("length") + 4).alias("succ"),
    )


def _leads_to(off: np.ndarray, succ: np.ndarray) -> np.ndarray:
    """For ascending offsets: the row each row's successor is, or the row itself where the successor lies elsewhere."""
    at = np.searchsorted(off, succ)
    found = off[np.minimum(at, len(off) - 1)] == succ
    return np.where(found, at, np.arange(len(off)))


def _leave(split: pd.DataFrame) -> pd.DataFrame:
    """Adds ``leave``: where the chain from a candidate first leaves the split, by pointer jumping inside it."""
    split = split.sort_values("off")
    jump = _leads_to(split["off"].to_numpy(), split["succ"].to_numpy())
    while (jump != (jump := jump[jump])).any():
        pass
    return split.assign(leave=split["succ"].to_numpy()[jump])


def _passed(split: pd.DataFrame) -> pd.DataFrame:
    """The candidates on the chain that enters the split at ``gate``."""
    split = split.sort_values("off")
    off = split["off"].to_numpy()
    jump = _leads_to(off, split["succ"].to_numpy())
    on = off == split["gate"].to_numpy()
    reached = 0
    while reached < (reached := on.sum()):
        on[jump[on]] = True
        jump = jump[jump]
    return split.loc[on, ["file", "off"]]


def _jump_on(gates: DataFrame) -> DataFrame:
    """``file, off`` of what is reached from offset 0 over ``file, off, leave``; every round doubles the jump."""
    jump = gates.select("file", "off", "leave")
    reach = jump.where("off = 0").select("file", "off")
    while not jump.isEmpty():
        step = reach.join(jump, ["file", "off"]).select("file", F.col("leave").alias("off"))
        reach = stage(reach.unionAll(step), "reach")
        on = jump.select("file", F.col("off").alias("leave"), F.col("leave").alias("_next"))
        jump = stage(jump.join(on, ["file", "leave"]).select("file", "off", F.col("_next").alias("leave")), "jump")
    return reach


def reachable(nodes: DataFrame) -> DataFrame:
    """``file, off`` of the nodes ``file, block, off, succ`` on the chain from offset 0, by pointer jumping on two levels.

    Inside a split, which one task holds as two numbers a candidate, the jumps are doubled in memory; that tells where each candidate's
    chain leaves the split. A gate is a candidate that a chain from another split arrives at, or a file's start; gates are a few a split. Joins double
    the jumps between gates, in as many rounds as a file's splits have binary digits. At last each split that is entered marks what its gate leads
    to; a chain enters a split once at most, as offsets only grow.
    """
    valid = nodes.where("off >= 0 AND succ > off").select("file", "block", "off", "succ")
    chains = stage(valid.groupBy("file", "block").applyInPandas(_leave, "file string, block bigint, off bigint, succ bigint, leave bigint"), "chains")
    arrivals = chains.select("file", F.col("leave").alias("off")).distinct()
    arrived = chains.join(arrivals, ["file", "off"], "left_semi").where("off > 0")
    gates = stage(chains.where("off = 0").unionByName(arrived).select("file", "block", "off", "leave"), "gates")
    entered = gates.join(_jump_on(gates), ["file", "off"]).select("file", "block", F.col("off").alias("gate"))
    held = chains.select("file", "block", "off", "succ").join(entered, ["file", "block"])
    return held.groupBy("file", "block").applyInPandas(_passed, "file string, off bigint")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all files: ``file, off, header, length, sha256`` (of the body).

    A magic inside a payload starts a candidate that no record leads to, so the chain from the file's start leaves it out, and
    the record's body is put together again from the chunks it was cut into. An empty folder has no records. A damaged
    header ends its file's chain there.
    """
    found = stage(candidates(spark, path), "candidates")
    chain = stage(reachable(found), "chain")
    known = found.join(chain.withColumn("_on", F.lit(True)), ["file", "off"], "left").withColumn("_on", F.col("_on") & F.col("succ").isNotNull())
    records = known.where("_on").select("file", "off", "header", "length", "head", "sha256")
    whole = records.where("sha256 IS NOT NULL")
    cut = records.where("sha256 IS NULL").select("file", "off", "header", "length", "head")
    if cut.isEmpty():
        return whole.drop("head")
    order = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    owned = known.withColumn("_of", F.last(F.when(F.col("_on"), F.struct("off", "sha256")), ignorenulls=True).over(order))
    parts = owned.where("_of.off IS NOT NULL AND _of.sha256 IS NULL").select("file", "block", "idx", F.col("_of.off").alias("_rec"), "off")
    split = Window.partitionBy("file", "block").orderBy("seq")
    needed = stage(parts, "parts")
    held = _chunks(spark, path).join(needed.select("file", "block").distinct(), ["file", "block"], "left_semi")
    texts = held.withColumn("idx", F.row_number().over(split)).join(needed, ["file", "block", "idx"])
    joined = texts.groupBy("file", F.col("_rec").alias("off")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("off").alias("at"), "value"))).alias("_parts")
    )
    body = F.concat_ws(MAGIC, F.transform("_parts", lambda p: p["value"])).cast("binary")
    again = cut.join(joined, ["file", "off"]).select(
        "file", "off", "header", "length", F.sha2(F.substring(body, F.col("head").cast("int") + 5, F.col("length").cast("int")), 256).alias("sha256")
    )
    return whole.drop("head").unionByName(again)


def page_records(records: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` from records as written here.

    A response's digest and length are those of the body read; a revisit has them in its header.
    """
    number = r"<urn:page:(-?[0-9]+)>"
    id_of = lambda field: F.regexp_extract(_field(field), number, 1)
    revisit = _field("WARC-Type") == "revisit"
    return records.select(
        F.nullif(id_of("WARC-Record-ID"), F.lit("")).cast("bigint").alias("page_id"),
        F.when(revisit, _field("X-Payload-Length").cast("bigint")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.substring_index(_field("WARC-Payload-Digest"), ":", -1)).otherwise(F.col("sha256")).alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.nullif(id_of("WARC-Refers-To"), F.lit("")).cast("bigint")).alias("refers_to"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write archives to the shared folder, read them back and list the pages."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return page_records(read_archives(spark, path))
