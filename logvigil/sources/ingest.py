"""From files to entries: discovery, format detection, parsing, statistics, quarantine.

Files and their formats are a table. The lines of all files are scanned once and parsed once; what became of every line is
written to the shared folder, and entries, errors, statistics and line numbers are read from there. What cannot be read is listed with
its reason and does not stop the rest.
"""

from __future__ import annotations

import fnmatch
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logvigil.functions.lines import NO_MATCH, NO_TIME, LineParser, entries_of, judge, stripped
from logvigil.schema import ENTRY_TYPES
from logvigil.session import shared_dir, stage
from logvigil.sources import apache, auth, nginx, syslog, windows
from logvigil.sources.heads import SAMPLE_LINES, read_heads

# Names of log files in a folder.
FILE_NAMES = ["*.log", "*.txt", "auth", "secure", "messages", "syslog"]
FILE_GLOB = "{" + ",".join(FILE_NAMES) + "}"
TESTED_LINES = 10
HEADS_PER_TASK = 64  # files whose first lines one task reads
BROADCAST_FILES = 1_000_000  # a table of up to so many files is sent to the tasks; the driver's file index holds them all anyway
XML = "windows_xml"  # the format of Windows events in XML, which is told apart from "windows" by its first line

Parser = Callable[..., DataFrame]


@dataclass(frozen=True)
class Format:
    """A log format: how to parse lines, and which sample lines speak for it (a SQL condition on ``line``).

    ``line_parser`` gives the parser as SQL texts; formats that have one are parsed in the same pass over the lines.
    """

    name: str
    parse: Parser
    matches: str
    share: float = 0.5
    line_parser: Callable[..., LineParser] | None = None


def _any(*groups: str) -> str:
    return " OR ".join(f"({g}) IS NOT NULL" for g in groups)


NOT_COMMENT = "NOT startswith(line, '#')"

# Words that speak for a format.
_AUTH_WORDS = ["sshd", "sudo", "su", "pam_", "session", "auth"]
_WINDOWS_WORDS = [
    "security", "microsoft-windows", "eventid", "event id", "audit success", "audit failure",
    "information", "warning", "error", "critical", "<event", "</event>",
]


def _auth_line() -> str:
    words = " OR ".join(f"contains(lower(concat(g[5], '\\n', g[3])), '{w}')" for w in _AUTH_WORDS)
    return f"coalesce(transform(array({auth.matched('line')}), g -> {words})[0], false)"


BUILT_IN = (
    Format("apache", apache.parse_apache, f"{NOT_COMMENT} AND ({_any(apache.matched('line'))})", line_parser=apache.parser),
    Format(
        "nginx", nginx.parse_nginx,
        f"{NOT_COMMENT} AND ({_any(nginx.matched_access('line'), nginx.matched_error('line'))})", line_parser=nginx.parser,
    ),
    Format(
        "syslog", syslog.parse_syslog,
        _any(syslog.matched_5424("line"), syslog.matched_3164("line"), syslog.matched_simple("line")), line_parser=syslog.parser,
    ),
    Format("auth", auth.parse_auth, _auth_line(), 0.3, auth.parser),
    Format(
        "windows", windows.parse_windows,
        " OR ".join(f"contains(lower(line), '{w}')" for w in _WINDOWS_WORDS)
        + f" OR {_any(windows.matched_text('line'), windows.matched_csv('line'))}",
        0.3, windows.parser,
    ),
)


@dataclass(frozen=True)
class Formats:
    """The formats in the order detection tries them."""

    known: tuple[Format, ...] = BUILT_IN

    def register_parser(self, name: str, parse: Parser, matches: str, share: float = 0.5) -> Formats:
        """A copy with one more format, tried last."""
        kept = tuple(f for f in self.known if f.name != name)
        return replace(self, known=(*kept, Format(name, parse, matches, share)))

    def __getitem__(self, name: str) -> Format:
        for fmt in self.known:
            if fmt.name == name:
                return fmt
        raise ValueError(f"unknown log format: {name}")

    def __contains__(self, name: str) -> bool:
        return any(fmt.name == name for fmt in self.known)


@dataclass(frozen=True)
class Places:
    """The given paths: literal files, literal folders, and those that cannot be read with their reasons."""

    files: tuple[str, ...]
    folders: tuple[str, ...]
    problems: tuple[tuple[str, str], ...]


def _qualified(spark: SparkSession, path: str) -> str:
    """The name Spark gives a file, with its scheme and special characters encoded. An unknown scheme raises."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    name = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().toString()
    return re.sub("^file:/+", "file:/", name)  # one slash, as in ``_metadata``


def _literal(path: str) -> str:
    """A path whose special characters stand for themselves, for readers that take patterns."""
    return "".join(f"\\{c}" if c in "\\*?[]{}" else c for c in path)


def places(spark: SparkSession, paths: str | list[str], recursive: bool = False) -> Places:
    """Look the given paths up: each is a file, a folder, or a pattern of files and folders.

    The number of paths is what the caller wrote down; files in folders are not listed here. A file that is given twice, or in a
    folder that is given too, counts once.
    """
    path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    files, folders, problems = {}, {}, []
    for given in dict.fromkeys([paths] if isinstance(paths, str) else paths):
        try:
            place = path_of(given)
            fs = place.getFileSystem(conf)
            found = [fs.getFileStatus(place)] if fs.exists(place) else list(fs.globStatus(place) or [])
        except Py4JJavaError as error:
            problems.append((given, str(error.java_exception.getMessage())))
            continue
        if not found:
            problems.append((given, "no such file or folder"))
        for status in found:
            (folders if status.isDirectory() else files)[status.getPath().toString()] = True

    def inside(path: str) -> bool:
        above, _, name = path.rpartition("/")
        if not recursive:
            return above in folders and any(fnmatch.fnmatchcase(name, n) for n in FILE_NAMES)
        nested = any(path.startswith(f"{folder}/") for folder in folders)
        return nested and (path in folders or any(fnmatch.fnmatchcase(name, n) for n in FILE_NAMES))

    return Places(
        tuple(f for f in files if not inside(f)), tuple(f for f in folders if not (recursive and inside(f))), tuple(problems)
    )


def _read(spark: SparkSession, found: Places, recursive: bool, fmt: str, *columns: str) -> DataFrame:
    """All files of some places; files that vanish or break while they are read end with what was read."""
    parts = []
    for names, options in (
        (found.files, {}),
        (found.folders, {"pathGlobFilter": FILE_GLOB, "recursiveFileLookup": str(recursive).lower()}),
    ):
        if names:
            reader = spark.read.format(fmt).options(ignoreMissingFiles="true", ignoreCorruptFiles="true", **options)
            parts.append(reader.load([_literal(n) for n in names]).selectExpr(*columns))
    if not parts:
        return spark.range(0).selectExpr("CAST(NULL AS BINARY) AS content", "CAST(NULL AS STRING) AS value",
            "CAST(NULL AS STRUCT<file_path: STRING, file_size: BIGINT, file_block_start: BIGINT>) AS _metadata").selectExpr(*columns)
    return reduce(DataFrame.unionByName, parts)


def log_files(spark: SparkSession, paths: str | list[str] | Places, recursive: bool = False) -> DataFrame:
    """The log files under the paths: a file itself, or the log-like names in a folder. No content is read.

    Empty files hold no lines; Spark does not list them.
    """
    found = paths if isinstance(paths, Places) else places(spark, paths, recursive)
    return _read(spark, found, recursive, "binaryFile", "_metadata.file_path AS file_path", "_metadata.file_size AS bytes")


def scan_lines(spark: SparkSession, paths: str | list[str] | Places, recursive: bool = False) -> DataFrame:
    """All lines with their file, their split, their size in bytes and a number that grows along the file.

    The number joins the place at which the split starts with the place inside the task, so it
    follows the file's order although splits are read apart.
    """
    found = paths if isinstance(paths, Places) else places(spark, paths, recursive)
    place = f"shiftright(_metadata.file_block_start, {_split_bits(spark)})"
    return _read(
        spark, found, recursive, "text",
        "_metadata.file_path AS file_path",
        f"shiftleft({place}, 40) + (monotonically_increasing_id() & 8589934591L) AS line_seq",
        f"{stripped('value')} AS line",
        "_metadata.file_block_start AS split",
        "octet_length(value) AS bytes",
    )


def _split_bits(spark: SparkSession) -> int:
    """Bits of the smallest split Spark makes of a file under the session's settings, 20 (a megabyte) at most."""
    bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    settings = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    return min(20, int(min(bytes_of(spark.conf.get(name)) for name in settings)).bit_length() - 1)


def data_lines(lines: DataFrame) -> DataFrame:
    """Lines that hold something: no blank ones, no comments."""
    return lines.where(f"line <> '' AND {NOT_COMMENT}")


def sample_lines(files: DataFrame, count: int | None = None) -> DataFrame:
    """The first lines of every file, read in tasks of ``HEADS_PER_TASK`` files that stop after them.

    A file that cannot be opened gives one row with place 0 and the reason as ``error``.
    """
    count = files.count() if count is None else count
    dealt = files.select("file_path").repartition(1 + count // HEADS_PER_TASK, "file_path")
    return dealt.mapInPandas(read_heads, "file_path string, place int, line string, error string")


def detect_formats(sample: DataFrame, formats: Formats = Formats()) -> DataFrame:
    """Per file the first format enough of its first ten lines speak for, null without one.

    ``sample`` has ``file_path``, ``place`` (from 1) and ``line``, at most 20 lines per file.
    """
    tested = sample.where(f"place <= {TESTED_LINES}")
    counts = tested.groupBy("file_path").agg(
        F.expr("count_if(line <> '') AS valid"),
        *[F.expr(f"count_if({fmt.matches}) AS `n_{fmt.name}`") for fmt in formats.known],
    )
    arms = " ".join(f"WHEN `n_{f.name}` >= valid * {f.share}D THEN '{f.name}'" for f in formats.known)
    return counts.selectExpr("file_path", f"CASE WHEN valid = 0 THEN NULL {arms} END AS format")


def first_lines(lines: DataFrame) -> DataFrame:
    """The sample for detection from lines already at hand; each task keeps 20 lines per file at most."""
    return lines.selectExpr(
        "file_path", "row_number() OVER (PARTITION BY file_path ORDER BY line_seq) AS place", "line"
    ).where(f"place <= {SAMPLE_LINES}")


@dataclass(frozen=True)
class Parsed:
    """What came out of a set of files. All tables but ``problems`` read one staged copy of the parsed lines.

    ``files``: every file with size, format and, where it was not read, the reason. ``problems``: what was asked for and not
    done (missing paths, files without a known format, hints that fit no file, files read in part), with reasons.
    """

    entries: DataFrame
    stats: DataFrame
    errors: DataFrame
    files: DataFrame
    problems: DataFrame

    @property
    def unparsed_files(self) -> list[str]:
        """Names of the files that were not read, for a look at the driver."""
        return [row.file_path for row in self.files.where("reason IS NOT NULL").orderBy("file_path").collect()]


def parse_stats(judged: DataFrame) -> DataFrame:
    """Per file: lines read, entries parsed, data lines without an entry, success rate in percent."""
    counts = judged.groupBy("file_path", F.col("format").alias("log_type")).agg(
        F.count("*").alias("lines_processed"),
        F.count("ts").alias("lines_parsed"),
        F.expr(f"count_if(verdict = '{NO_MATCH}')").alias("parse_errors"),
    )
    return counts.withColumn("success_rate", F.expr("lines_parsed / lines_processed * 100"))


def parse_errors(judged: DataFrame) -> DataFrame:
    """Data lines without an entry and entries without a readable time, each as an excerpt with the reason."""
    wrong = judged.where(f"verdict IN ('{NO_MATCH}', '{NO_TIME}')")
    kept = [c for c in ("split",) if c in judged.columns]
    return wrong.selectExpr("file_path", "line_seq", *kept, "substring(raw_line, 1, 200) AS line", "verdict AS error")


def split_starts(judged: DataFrame) -> DataFrame:
    """``file_path, split, first_seq, before``: per split its first line's number in the task and the file's lines in front of it.

    Two levels: the lines of a split are counted where they lie, then the splits of a file are added up in order.
    """
    counts = judged.groupBy("file_path", "split").agg(F.min("line_seq").alias("first_seq"), F.count("*").alias("lines"))
    along = Window.partitionBy("file_path").orderBy("split")
    return counts.withColumn("before", F.sum("lines").over(along) - F.col("lines")).drop("lines")


def number_lines(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Rows of ``judged`` with ``line_number``, which counts all lines of the file from 1."""
    joined = rows.join(starts, ["file_path", "split"], "left")
    return joined.withColumn("line_number", F.expr("before + line_seq - first_seq + 1")).drop("before", "first_seq", "split")


def judge_lines(
    lines: DataFrame, formats: Formats = Formats(), now: datetime | None = None, year: int | None = None,
    names: list[str] | None = None,
) -> DataFrame:
    """What becomes of every line, by the format in its column ``format``; see ``functions.lines.judge``.

    Formats with SQL texts share one pass. Each other one of ``names`` (all by default) is a pass of its own over its files' lines.
    """
    carried = tuple(c for c in lines.columns if c not in ("file_path", "line_seq", "line"))
    lines = lines.withColumn("line", F.expr(f"CASE WHEN line <> '' AND {NOT_COMMENT} THEN line END"))
    wanted = [f for f in formats.known if names is None or f.name in names]
    own = [f for f in wanted if f.line_parser is None]
    parsers = [f.line_parser(f"CASE WHEN format = '{f.name}' THEN line END", year=year) for f in wanted if f.line_parser]
    parts = []
    if parsers:
        shared = lines.where(~F.col("format").isin([f.name for f in own])) if own else lines
        if len(parsers) == 1:
            parsers = [wanted[[bool(f.line_parser) for f in wanted].index(True)].line_parser(year=year)]
        parts.append(judge(shared, parsers, now, carried))
    for fmt in own:
        parts.append(_judge_apart(lines.where(F.col("format") == fmt.name), fmt, now, year, carried))
    return reduce(DataFrame.unionByName, parts)


def _judge_apart(lines: DataFrame, fmt: Format, now: datetime | None, year: int | None, carried: tuple[str, ...]) -> DataFrame:
    entries = fmt.parse(lines.where("line IS NOT NULL").select("file_path", "line_seq", "line"), now=now, year=year)
    found = lines.join(entries.select(*ENTRY_TYPES), ["file_path", "line_seq"], "left")
    verdict = (
        f"CASE WHEN line IS NULL THEN 'skipped' WHEN log_type IS NULL THEN '{NO_MATCH}' WHEN ts_fallback THEN '{NO_TIME}' END AS verdict"
    )
    raw = "if(log_type IS NULL, substring(line, 1, 200), raw_line) AS raw_line"
    return found.selectExpr(*[raw if c == "raw_line" else f"`{c}`" for c in ENTRY_TYPES], *carried, verdict)


def parse_lines(
    lines: DataFrame, fmt: str, formats: Formats = Formats(), now: datetime | None = None, year: int | None = None
) -> DataFrame:
    """Entries of lines of one format."""
    return formats[fmt].parse(data_lines(lines), now=now, year=year)


def find_formats(
    spark: SparkSession, paths: str | list[str] | Places, fmt: str = "auto", hints: dict[str, str] | None = None,
    formats: Formats = Formats(), recursive: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``file_path, bytes, format, reason`` of all files, staged, and ``path, reason`` of hints that fit none of them.

    A hint decides, else the format for all, else the first lines. A hint for an unknown format leaves its file unread.
    """
    found = paths if isinstance(paths, Places) else places(spark, paths, recursive)
    files = stage(log_files(spark, found, recursive), "files")
    hinted, unfit = [], []
    for path, name in (hints or {}).items():
        try:
            hinted.append((_qualified(spark, path), path, name))
        except Py4JJavaError as error:
            unfit.append((path, f"hint: {error.java_exception.getMessage()}"))
    hint = spark.createDataFrame(hinted, "file_path string, path string, hint string")
    if all("://" not in p or _readable(p) for p in (*found.files, *found.folders)):
        heads = sample_lines(files)
    else:  # a store that only Spark reads
        heads = first_lines(scan_lines(spark, found, recursive)).withColumn("error", F.lit(None).cast("string"))
    heads = stage(heads, "heads")
    failed = heads.where("error IS NOT NULL").select("file_path", "error")
    first = heads.where("line <> ''").groupBy("file_path").agg(F.min_by("line", "place").alias("first_line"))
    told = detect_formats(heads.where("error IS NULL"), formats)
    known = ", ".join(f"'{f.name}'" for f in formats.known)
    chosen = "coalesce(hint, format)" if fmt == "auto" else f"coalesce(hint, '{formats[fmt].name}')"
    table = (
        files.join(told, "file_path", "left").join(failed, "file_path", "left").join(first, "file_path", "left")
        .join(hint.drop("path"), "file_path", "left")
        .selectExpr("file_path", "bytes", f"{chosen} AS format", "error", "first_line")
        .selectExpr(
            "file_path", "bytes",
            f"CASE WHEN error IS NULL AND format = 'windows' AND startswith(first_line, '<') THEN '{XML}' "
            f"WHEN error IS NULL AND format IN ({known}) THEN format END AS format",
            f"CASE WHEN error IS NOT NULL THEN error WHEN format IS NULL THEN 'no known format' WHEN format NOT IN ({known}) THEN concat('unknown format: ', format) END AS reason",
        )
    )
    table = stage(table, "formats")
    strays = hint.join(files, "file_path", "left_anti").selectExpr("path", "'hint fits no file' AS reason")
    return table, strays.unionByName(spark.createDataFrame(unfit, "path string, reason string"))


def _readable(path: str) -> bool:
    """Whether tasks can open files of this scheme themselves."""
    try:
        arrow_fs.FileSystem.from_uri(path)
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def parse_logs(
    spark: SparkSession,
    paths: str | list[str],
    fmt: str = "auto",
    hints: dict[str, str] | None = None,
    formats: Formats = Formats(),
    recursive: bool = False,
    now: datetime | None = None,
    year: int | None = None,
) -> Parsed:
    """Entries of all files, each read by its own format; one pass over the text.

    A format may be given for all files or per file; the others are detected from their first lines. Paths may be files,
    folders or patterns, in any store Spark reads. Formats are joined to the lines by file. The parsed lines are written to the shared
    folder, a folder per log type, and read from there by all that follows. Missing paths, files that cannot be opened, unknown formats and hints
    without a file are listed in ``problems``. The driver learns the formats that occur; only names of XML files come to it, since
    Spark's XML reader takes a list of names.
    """
    now = now or datetime.now()
    year = year or now.year
    found = places(spark, paths, recursive)
    files, strays = find_formats(spark, found, fmt, hints, formats, recursive)
    (row,) = files.agg(F.collect_set("format").alias("names"), F.count("*").alias("n")).collect()
    path = f"{shared_dir(spark)}/judged-{uuid.uuid4().hex}"
    names = [n for n in row.names if n != XML]
    formatted = files.where(f"format <> '{XML}'").select("file_path", "format")
    scanned = scan_lines(spark, found, recursive)
    lines = scanned.join(F.broadcast(formatted) if row.n <= BROADCAST_FILES else formatted, "file_path")
    judged = judge_lines(lines, formats, now, year, names or [formats.known[0].name])
    judged.write.partitionBy("log_type").parquet(path)
    schema = judged.schema
    if XML in row.names:
        xml_files = [_literal(r.file_path) for r in _plain(files.where(f"format = '{XML}'")).collect()]
        events = windows.read_windows_xml(spark, xml_files, now).selectExpr(
            *[f"`{c}`" for c in ENTRY_TYPES], "'windows' AS format", "0L AS split", "octet_length(raw_line) AS bytes",
            f"if(ts_fallback, '{NO_TIME}', NULL) AS verdict",
        )
        events.select(*schema.names).write.mode("append").partitionBy("log_type").parquet(path)
    judged = spark.read.schema(schema).parquet(path).select(*schema.names)
    stats = parse_stats(judged)
    errors = number_lines(parse_errors(judged), split_starts(judged)).drop("line_seq")
    # of a plain text file all bytes are lines and their ends, two bytes at most each
    read = judged.where(f"format <> '{XML}'").groupBy("file_path").agg(F.expr("sum(bytes) + 2 * count(*) + 3").alias("read"))
    part = formatted.join(files.select("file_path", "bytes"), "file_path").join(read, "file_path", "left")
    part = part.where("bytes > coalesce(read, 0) AND NOT rlike(file_path, '[.](gz|bz2|zst|lz4|snappy|deflate)$')")
    problems = reduce(
        DataFrame.unionByName,
        [
            spark.createDataFrame(list(found.problems), "path string, reason string"),
            files.where("reason IS NOT NULL").selectExpr("file_path AS path", "reason"),
            strays,
            part.selectExpr("file_path AS path", "'read in part' AS reason"),
        ],
    )
    return Parsed(entries_of(judged), stats, errors, files, problems)


def _plain(files: DataFrame) -> DataFrame:
    """File names as readers take them: without encoded characters."""
    return files.selectExpr("url_decode(replace(file_path, '+', '%2B')) AS file_path")
