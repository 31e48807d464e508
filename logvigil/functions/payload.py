"""Decoding of request payloads and matching of ordered signatures, as SQL expressions.

The decoded text feeds dozens of patterns. ``bind`` evaluates it once per row and hands
it on as a lambda variable, so neither a pushed-down filter nor a collapsed projection can
repeat the decoding for every pattern.
"""

from __future__ import annotations

from collections.abc import Callable

from logvigil.functions.signatures import HTML_ENTITIES, SENSITIVE_FILES, SQL_FUNCTIONS, SQLI, TRAVERSAL, XSS

# (?i) ignore case; (?d) only \n ends a line for . and $, as in Python.
FLAGS = "(?id)"

# Fixed value: what Python takes for white space in text.
WHITE_SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def literal(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(name: str, value: str, body: str) -> str:
    """``let name = value in body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _unescape(text: str, passes: int, keep_plus: bool) -> str:
    """Percent-decode ``passes`` times; a lone % stays and bad UTF-8 becomes U+FFFD."""
    out = text
    for _ in range(passes):
        if keep_plus:
            out = f"replace({out}, '+', '%2B')"
        out = f"try_url_decode(regexp_replace({out}, '%(?![0-9A-Fa-f]{{2}})', '%25'))"
    return out


def url_decode(text: str, passes: int, keep_plus: bool = False) -> str:
    """Repeated percent-decoding; texts without escapes skip the work."""
    marks = f"contains({text}, '%')" if keep_plus else f"contains({text}, '%') OR contains({text}, '+')"
    return f"CASE WHEN {marks} THEN {_unescape(text, passes, keep_plus)} ELSE {text} END"


def _hex_runs(text: str) -> str:
    """Replace every even run of hex digits after 0x by the text it spells; bad bytes vanish."""
    digits = "h -> CASE WHEN length(h) % 2 = 0 " \
        "THEN replace(make_valid_utf8(CAST(unhex(h) AS STRING)), '\\uFFFD', '') ELSE concat('0x', h) END"
    words = f"transform(regexp_extract_all({text}, '0x([0-9a-fA-F]+)', 1), {digits})"
    between = f"split({text}, '0x[0-9a-fA-F]+')"
    return (
        f"CASE WHEN contains({text}, '0x') THEN "
        f"array_join(zip_with({between}, {words}, (a, b) -> concat(a, coalesce(b, ''))), '') ELSE {text} END"
    )


def sqli_text(text: str) -> str:
    """Three URL decodings, 0x runs, white space to single blanks, lower case."""
    decoded = bind("u", url_decode(text, 3), _hex_runs("u"))
    return f"lower(regexp_replace({decoded}, {literal(WHITE_SPACE + '+')}, ' '))"


def xss_text(text: str) -> str:
    """Three URL decodings, the fixed HTML entities in order, lower case."""
    out = url_decode(text, 3)
    for entity, char in HTML_ENTITIES:
        out = f"replace({out}, {literal(entity)}, {literal(char)})"
    return f"lower({out})"


def path_text(text: str) -> str:
    """Five URL decodings that keep +, backslashes to slashes, NUL dropped; case kept."""
    return f"replace(replace({url_decode(text, 5, keep_plus=True)}, '\\\\', '/'), '\\0', '')"


# The same matches in linear time; the match is group 1. Where the first begin of a part (a line, or a stretch without the sign that ends
# the pattern's own stretch) leads to no match, no later begin in that part does, since it sees less. So every part is tried once, from its
# begin, and the first place where each piece of the pattern ends is kept.
def _per_part(begin_of_part: str, before: str, begin: str, rest: str) -> str:
    return f"{begin_of_part}(?>{before}*?(?={begin}))({rest})"


_LINE, _ALL = "(?m:^)", r"\A"
_TAGS = r"(?:\A|>)"
_STEADY = {
    published: _per_part(part, before, begin, rest)
    for published, part, before, begin, rest in (
        (
            r"\bwhere\b.*?\b(?:and|or)\b.*?(?:--|#|/\*)", _LINE, ".", r"\bwhere\b",
            r"where\b(?>.*?\b(?:and|or)\b)(?>.*?(?:--|#|/\*))",
        ),
        (
            r"(?:and|or).*?(?:sleep|benchmark)\s*\(", _LINE, ".", "and|or",
            r"(?:and|or)(?>.*?(?:sleep|benchmark)\s*\()",
        ),
        (
            r"(?:%00|\\0).*?(?:select|union|drop)", _LINE, ".", r"%00|\\0",
            r"(?:%00|\\0)(?>.*?(?:select|union|drop))",
        ),
        (
            r"(?:conv|convert)\s*\([^)]+,\s*\d+\s*,\s*\d+\s*\)", r"(?:\A|\))", "[^)]", r"(?:conv|convert)\s*\(",
            r"(?:conv|convert)\s*\([^)]+,\s*\d+\s*,\s*\d+\s*\)",
        ),
        (r"<script[^>]*>", _ALL, r"[\s\S]", "<script", "<script[^>]*>"),
        (r"<[a-z]+[^>]*>", _ALL, r"[\s\S]", "<[a-z]", "<[a-z]+[^>]*>"),
        (r"<img[^>]+onerror\s*=", _TAGS, "[^>]", "<img", r"<img[^>]+onerror\s*="),
        (r"<svg[^>]+onload\s*=", _TAGS, "[^>]", "<svg", r"<svg[^>]+onload\s*="),
        (r"<body[^>]+onload\s*=", _TAGS, "[^>]", "<body", r"<body[^>]+onload\s*="),
        (r"<(?:a|link)[^>]+href\s*=", _TAGS, "[^>]", "<(?:a|link)", r"<(?:a|link)[^>]+href\s*="),
        (r"<meta[^>]+http-equiv", _TAGS, "[^>]", "<meta", "<meta[^>]+http-equiv"),
    )
}


def _pattern(pattern: str) -> str:
    return literal(FLAGS + _STEADY.get(pattern, pattern))


def _matched(var: str, pattern: str) -> str:
    return f"regexp_extract({var}, {_pattern(pattern)}, {1 if pattern in _STEADY else 0})"


def _any(patterns: list[str]) -> str:
    return literal(FLAGS + "|".join(f"(?:{_STEADY.get(p, p)})" for p in patterns))


def _flat(by_severity: dict[str, list[str]]) -> list[tuple[str, str, str]]:
    return [(sev, f"{sev}_{i}", p) for sev, patterns in by_severity.items() for i, p in enumerate(patterns)]


def _hit(severity: str, name: str, matched: str) -> str:
    return f"named_struct('severity', '{severity}', 'pattern', '{name}', 'matched', {matched})"


def _first_match(var: str, by_severity: dict[str, list[str]], more: str = "") -> str:
    arms = " ".join(
        f"WHEN rlike({var}, {_pattern(p)}) THEN {_hit(sev, name, _matched(var, p))}"
        for sev, name, p in _flat(by_severity)
    )
    return f"CASE {arms} {more} END"


def _screened(var: str, patterns: list[str], chain: str) -> str:
    """One alternation decides whether anything matches; only hits walk the chain."""
    return f"CASE WHEN rlike({var}, {_any(patterns)}) THEN {chain} END"


def detect_sqli(text: str) -> str:
    """The first SQL injection signature in ``text`` as a struct, null without one."""
    calls = " ".join(
        f"WHEN rlike(d, {_pattern(rf'\b{name}\s*\(')}) THEN {_hit('medium', f'sql_function_{name}', literal(name))}"
        for name in SQL_FUNCTIONS
    )
    everything = [p for _, _, p in _flat(SQLI)] + [rf"\b(?:{'|'.join(SQL_FUNCTIONS)})\s*\("]
    return bind("d", sqli_text(text), _screened("d", everything, _first_match("d", SQLI, calls)))


def detect_xss(text: str) -> str:
    """The first XSS signature in ``text`` as a struct, null without one."""
    return bind("d", xss_text(text), _screened("d", [p for _, _, p in _flat(XSS)], _first_match("d", XSS)))


def detect_path(text: str) -> str:
    """Traversal flag, first sensitive file and decoded path as a struct, null without either."""
    files = [p for _, _, p in _flat(SENSITIVE_FILES)]
    traversal = f"(contains(d, '../') OR rlike(d, {_any(TRAVERSAL)}))"
    found = (
        f"CASE WHEN contains(d, '../') OR rlike(d, {_any(TRAVERSAL + files)}) THEN "
        f"named_struct('traversal', {traversal}, 'file', {_first_match('d', SENSITIVE_FILES)}, 'decoded', d) END"
    )
    return bind("d", path_text(text), found)


def first_source(detect: Callable[[str], str], sources: list[tuple[str, str]]) -> str:
    """Try (name, text expression) sources in order; empty texts and '-' are skipped.

    Gives a struct of the source name and the hit, null when no source has one.
    """
    arms = []
    for name, text in sources:
        hit = bind("t", text, f"CASE WHEN t IS NOT NULL AND t NOT IN ('', '-') THEN {detect('t')} END")
        arms.append(bind("h", hit, f"CASE WHEN h IS NOT NULL THEN named_struct('source', '{name}', 'hit', h) END"))
    return f"coalesce({', '.join(arms)})"
