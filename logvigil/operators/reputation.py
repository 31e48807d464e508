"""Membership of source ips in listed network ranges, IPv4 and IPv6."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.functions.payload import bind

# Networks of at most this prefix length are few (below 2 ** 13 in each family) and may hold most ips.
COARSE = 12


def ip_number(ip: str) -> str:
    """SQL text: a dotted IPv4 address as a number; null for anything else."""
    octets = [f"try_cast(get(split({ip}, '[.]'), {i}) AS INT)" for i in range(4)]
    valid = " AND ".join(f"{o} <= 255" for o in octets)
    number = " + ".join(f"CAST({o} AS BIGINT) * {1 << (24 - 8 * i)}L" for i, o in enumerate(octets))
    return f"CASE WHEN rlike({ip}, '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$') AND {valid} THEN {number} END"


def _groups6(ip: str) -> str:
    """SQL text: the eight groups of an IPv6 address as four hex digits each; null for anything else."""
    tail = ip_number("regexp_extract(a, '([0-9.]*)$', 1)")
    hexed = f"concat(lower(hex(n div 65536)), ':', lower(hex(n % 65536)))"
    # a dotted end stands for the last two groups
    plain = bind("n", tail, f"CASE WHEN NOT contains(a, '.') THEN a WHEN n IS NOT NULL THEN concat(regexp_replace(a, '[0-9.]*$', ''), {hexed}) END")
    side = "filter(split(split_part(p, '::', {0}), ':'), g -> split_part(p, '::', {0}) <> '')"
    left, right = side.format(1), side.format(2)
    filled = f"concat({left}, array_repeat('0', greatest(0, 8 - size({left}) - size({right}))), {right})"
    marks = "length(p) - length(replace(p, '::', ':'))"
    valid = (
        f"NOT contains(p, ':::') AND {marks} <= 1 AND if({marks} = 1, size({left}) + size({right}) < 8, size({left}) = 8) "
        "AND forall(f, g -> rlike(g, '^[0-9a-f]{1,4}$'))"
    )
    padded = bind("f", filled, f"CASE WHEN {valid} THEN transform(f, g -> lpad(g, 4, '0')) END")
    return bind("a", f"lower({ip})", f"CASE WHEN contains(a, ':') THEN {bind('p', plain, f'CASE WHEN p IS NOT NULL THEN {padded} END')} END")


def address(ip: str) -> str:
    """SQL text: family (4 or 6) and the address as two 64-bit numbers, IPv4 in the upper half of the first; null for anything else."""

    def half(first: int) -> str:
        digits = [f"CAST(conv(concat(g[{first + k}], g[{first + k + 1}]), 16, 10) AS BIGINT)" for k in (0, 2)]
        return f"shiftleft({digits[0]}, 32) | {digits[1]}"

    four = "named_struct('family', 4, 'high', shiftleft(n, 32), 'low', 0L)"
    six = bind("g", _groups6(ip), f"CASE WHEN g IS NOT NULL THEN named_struct('family', 6, 'high', {half(0)}, 'low', {half(4)}) END")
    return bind("n", ip_number(ip), f"CASE WHEN n IS NOT NULL THEN {four} ELSE {six} END")


def _masked(high: str, low: str, prefix: str) -> tuple[str, str]:
    """SQL texts: the two halves of an address with all bits behind the prefix cleared."""
    return (
        f"{high} & CASE WHEN {prefix} <= 0 THEN 0L WHEN {prefix} >= 64 THEN -1L ELSE shiftleft(-1L, 64 - {prefix}) END",
        f"{low} & CASE WHEN {prefix} <= 64 THEN 0L WHEN {prefix} >= 128 THEN -1L ELSE shiftleft(-1L, 128 - {prefix}) END",
    )


def _parsed(ranges: DataFrame) -> DataFrame:
    """``cidr, label, _prefix`` and the base address of every range, null where it cannot be read."""
    return ranges.selectExpr("cidr", "label", f"{address('split_part(cidr, chr(47), 1)')} AS _a").selectExpr(
        "cidr", "label", "_a",
        "CASE WHEN contains(cidr, '/') THEN try_cast(get(split(cidr, '/'), 1) AS INT) WHEN _a.family = 4 THEN 32 ELSE 128 END AS _prefix",
    )


_GOOD = "coalesce(_a IS NOT NULL AND _prefix BETWEEN 0 AND if(_a.family = 4, 32, 128) AND size(split(cidr, '/')) <= 2, false)"


def ip_reputation(entries: DataFrame, ranges: DataFrame | None, longest: bool = False) -> DataFrame:
    """Distinct source ips inside a listed range; ``ranges`` has ``cidr`` and ``label``.

    An ip is in a range exactly when its first ``prefix`` bits equal the range's, so the range join is an equality join on
    (family, prefix length, network), with every ip offered once per prefix length that the ranges have, 33 and 129 at most. Short
    prefixes have few networks, which are broadcast; a network of a longer prefix has less than 2 ** 20 ips of IPv4, and IPv6 ranges are
    split by the ips themselves. ``longest`` keeps the ranges with the longest prefix of an ip only. Without a table nothing is
    listed. Ranges that are no network list nothing; see :func:`bad_ranges`. An IPv4 address written as IPv6 is IPv6.
    """
    addresses = entries.select("source_ip").distinct().selectExpr("source_ip", f"{address('source_ip')} AS _a").where("_a IS NOT NULL")
    if ranges is None:
        return addresses.where("false").selectExpr(
            "source_ip", "CAST(NULL AS STRING) AS cidr", "CAST(NULL AS STRING) AS label"
        )
    high, low = _masked("_a.high", "_a.low", "_prefix")
    networks = (
        _parsed(ranges).where(_GOOD)
        .selectExpr("cidr", "label", "_a.family AS _family", "_prefix", f"{high} AS _high", f"{low} AS _low")
        .groupBy("_family", "_prefix", "_high", "_low")
        .agg(F.collect_set(F.struct("cidr", "label")).alias("_listed"))
    )
    lengths = networks.groupBy("_family").agg(F.collect_set("_prefix").alias("_lengths"))  # two rows
    offered = (
        addresses.join(F.broadcast(lengths), F.expr("_a.family = _family"))
        .selectExpr("source_ip", "_a", "_family", "explode(_lengths) AS _prefix")
        .selectExpr("source_ip", "_family", "_prefix", f"{high} AS _high", f"{low} AS _low")
    )
    key = ["_family", "_prefix", "_high", "_low"]
    coarse = F.broadcast(networks.where(f"_prefix <= {COARSE}"))
    found = offered.where(f"_prefix <= {COARSE}").join(coarse, key).unionByName(
        offered.where(f"_prefix > {COARSE}").join(networks.where(f"_prefix > {COARSE}"), key)
    )
    if longest:
        best = found.groupBy("source_ip").agg(F.expr("max_by(_listed, _prefix) AS _listed"))
        return best.selectExpr("source_ip", "inline(_listed)")
    return found.selectExpr("source_ip", "inline(_listed)")


def bad_ranges(ranges: DataFrame) -> DataFrame:
    """The rows of ``ranges`` that :func:`ip_reputation` cannot use."""
    return _parsed(ranges).where(f"NOT {_GOOD}").select("cidr", "label")
