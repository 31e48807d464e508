"""Taking log lines apart, as SQL expressions."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from logvigil.functions.payload import bind, literal
from logvigil.schema import ENTRY_HASH, ENTRY_TYPES, project

# A character Unicode never assigns; lines that hold it all the same take the slow path.
MARK = "\uffff"

# Fixed value: the characters Python's strip() removes.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def stripped(text: str) -> str:
    return f"trim(BOTH {literal(BLANKS)} FROM {text})"


def groups(line: str, pattern: str, count: int) -> str:
    """All groups of a pattern anchored at the start, as an array whose places are the group numbers.

    Null without a match. One replacement writes out every group, so a line is matched once
    and not once per group. A group that took no part is empty.
    """
    whole = "(?d)" + pattern if pattern.endswith("$") else "(?d)" + pattern + "(?s:.*)$"
    template = "".join(f"{MARK}${i}" for i in range(1, count + 1))
    split = (
        f"CASE WHEN startswith(r, '{MARK}') THEN split(r, '{MARK}') END"
    )
    fast = bind("r", f"regexp_replace({line}, {literal(whole)}, '{template}')", split)
    each = f"transform(sequence(0, {count}), i -> if(i = 0, '', regexp_extract({line}, {literal(whole)}, i)))"
    slow = f"CASE WHEN rlike({line}, {literal(whole)}) THEN {each} END"
    return f"CASE WHEN contains({line}, '{MARK}') THEN {slow} ELSE {fast} END"


def extract(text: str, pattern: str, group: int = 1) -> str:
    """A group of the first place where the pattern matches, null without one."""
    return f"nullif(regexp_extract({text}, {literal('(?d)' + pattern)}, {group}), '')"


def found(text: str, pattern: str) -> str:
    return f"rlike({text}, {literal('(?d)' + pattern)})"


def optional(text: str) -> str:
    """An empty group as null."""
    return f"nullif({text}, '')"


def no_dash(text: str) -> str:
    return f"nullif({text}, '-')"


def lookup(key: str, table: dict, otherwise: str) -> str:
    """A small fixed table as CASE."""
    arms = " ".join(
        f"WHEN {literal(k) if isinstance(k, str) else k} THEN {literal(v)}" for k, v in table.items()
    )
    return f"CASE {key} {arms} ELSE {otherwise} END"


ZONE = r"([+-]\d{2}:?\d{2}|Z)"


def zone_minutes(zone: str) -> str:
    """Minutes east of UTC of +HHMM, +HH:MM or Z; null for an empty text."""
    return (
        f"CASE WHEN {zone} = 'Z' THEN 0 WHEN {zone} <> '' THEN if(startswith({zone}, '-'), -1, 1) * "
        f"(CAST(substring({zone}, 2, 2) AS INT) * 60 + CAST(right({zone}, 2) AS INT)) END"
    )


def http_clock(text: str) -> str:
    """Wall clock of ``15/Jan/2024:08:23:45 -0500``, zone or not."""
    return f"try_to_timestamp(trim(regexp_replace({text}, ' [^ ]*$', '')), 'd/MMM/yyyy:H:m:s')"


def http_zone(text: str) -> str:
    return f"regexp_extract({text}, {literal(chr(92) + 's' + ZONE + '$')}, 1)"


def bsd_clock(text: str, year: int) -> str:
    """Wall clock of ``Jan 15 10:23:45``, which has no year."""
    return f"try_to_timestamp(concat('{year} ', regexp_replace({text}, '\\\\s+', ' ')), 'yyyy MMM d H:m:s')"


ISO = r"^(\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2})(?:\.(\d{1,9}))?"


def iso_clock(text: str, zone: str) -> str:
    """Wall clock of ``2024-01-15T10:23:45.003Z``; finer digits than micros are cut. ``zone`` is a pattern."""
    day = f"replace(regexp_extract({text}, {literal(ISO + zone + '$')}, 1), 'T', ' ')"
    micros = f"rpad(substring(regexp_extract({text}, {literal(ISO + zone + '$')}, 2), 1, 6), 6, '0')"
    return f"try_to_timestamp(concat({day}, '.', {micros}), 'yyyy-M-d H:m:s.SSSSSS')"


def iso_zone(text: str) -> str:
    """Numeric zone; Z marks UTC but leaves the time naive."""
    return f"regexp_extract({text}, {literal(ISO + '([+-]' + chr(92) + 'd{2}:?' + chr(92) + 'd{2})$')}, 3)"


def now_text(now: datetime | None) -> str:
    return "current_timestamp()" if now is None else f"TIMESTAMP '{now:%Y-%m-%d %H:%M:%S.%f}'"


@dataclass(frozen=True)
class LineParser:
    """How the lines of a format become entries, as SQL texts.

    ``steps`` are projections, one behind the other, that add columns under names no other parser uses; ``ok`` tells whether a
    line is an entry, ``fields`` give its columns, ``clock`` its wall clock (or null), ``zone`` minutes east of UTC (or null).
    """

    name: str
    steps: tuple[dict[str, str], ...]
    ok: str
    fields: dict[str, str]
    clock: str
    zone: str = "NULL"


# What a parser may say of an entry; the rest follows from the line.
_FIELDS = [
    "source_ip", "user", "action", "resource", "status_code", "message", "log_type", "raw_line", "referer", "user_agent", "event_id",
    "hostname", "process", "metadata",
]
NO_MATCH, NO_TIME = "no pattern matched", "unreadable time"
EXCERPT = 200  # characters kept of a line without an entry


def judge(lines: DataFrame, parsers: list[LineParser], now: datetime | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """Every line once, as an entry or with what is wrong with it in ``verdict``.

    With several parsers the column ``format`` names that of a line. Blank lines and comments have a null in ``line``'s place and the
    verdict ``skipped``. A line without entry has null in all entry columns but its place and an excerpt as ``raw_line``. A line
    without readable time gets ``now`` and is marked. Every line is parsed exactly once: what comes of it leaves through a generator, below
    which no later filter can be pushed to repeat the parsing.
    """
    rows = lines
    for parser in parsers:
        for step in parser.steps:
            rows = rows.selectExpr("*", *[f"{text} AS `{name}`" for name, text in step.items()])

    def entry(parser: LineParser) -> str:
        fields = {"raw_line": "line", **parser.fields}
        struct = ", ".join(f"'{name}', CAST({fields.get(name, 'NULL')} AS {ENTRY_TYPES[name]})" for name in _FIELDS)
        # The lambda keeps dozens of patterns out of the generated code: a method that long
        # is never compiled to machine code and runs slower than the plain expressions.
        return (
            f"CASE WHEN {parser.ok} THEN transform(array(0), once -> "
            f"named_struct({struct}, '_clock', {parser.clock}, '_zone', CAST({parser.zone} AS INT)))[0] END"
        )

    if len(parsers) == 1:
        found = entry(parsers[0])
    else:
        found = f"CASE format {' '.join(f"WHEN '{p.name}' THEN {entry(p)}" for p in parsers)} END"
    kept = ["file_path", "line_seq", *carried]
    taken = rows.selectExpr(*[f"`{c}`" for c in kept], "line", f"explode(array({found})) AS e")
    timed = taken.selectExpr(
        *[f"`{c}`" for c in kept],
        *[f"e.`{name}`" for name in _FIELDS if name != "raw_line"],
        f"if(e IS NULL, substring(line, 1, {EXCERPT}), e.raw_line) AS raw_line",
        f"CASE WHEN line IS NULL THEN 'skipped' WHEN e IS NULL THEN '{NO_MATCH}' WHEN e._clock IS NULL THEN '{NO_TIME}' END AS verdict",
        "if(e IS NULL, NULL, e._clock IS NULL) AS ts_fallback",
        f"if(e IS NULL, NULL, coalesce(e._clock, {now_text(now)})) AS _wall",
        "if(e._clock IS NULL, NULL, e._zone) AS _zone",
    )
    computed = {
        "ts": "timestampadd(MINUTE, -coalesce(_zone, 0), _wall)",
        "ts_local": "_wall",
        "tz_offset": "CASE WHEN _zone IS NOT NULL THEN concat(if(_zone < 0, '-', '+'), "
        "lpad(CAST(abs(_zone) div 60 AS STRING), 2, '0'), ':', lpad(CAST(abs(_zone) % 60 AS STRING), 2, '0')) END",
    }
    more = {c: dict(timed.dtypes)[c] for c in (*carried, "verdict")}
    shaped = project(timed, {c: t for c, t in ENTRY_TYPES.items() if c != "entry_hash"} | more, computed)
    return project(shaped, ENTRY_TYPES | more, {"entry_hash": f"CASE WHEN log_type IS NOT NULL THEN {ENTRY_HASH} END"})


def emit(df: DataFrame, ok: str, fields: dict[str, str], clock: str, zone_min: str = "NULL", now: datetime | None = None) -> DataFrame:
    """Entries only, from rows whose columns a parser has already added."""
    return entries_of(judge(df, [LineParser("", (), ok, fields, clock, zone_min)], now))


def parse(lines: DataFrame, parser: LineParser, now: datetime | None = None) -> DataFrame:
    """Entries of lines of one format."""
    return entries_of(judge(lines, [parser], now))


def entries_of(judged: DataFrame) -> DataFrame:
    """The judged lines that are entries."""
    return judged.where("ts IS NOT NULL").select(*ENTRY_TYPES)
