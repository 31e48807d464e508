"""Secret scans: base patterns, and weak candidates that count only next to complementary parts; DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logvigil.session import stage

SCOPE = 200  # characters between the starts of parts that belong together


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    words: tuple[str, ...] = ()  # lower-case strings of which a text must hold one, to skip the pattern
    group: int = 0  # the group whose length counts
    least: int = 0
    base: bool = False
    role: str = ""  # identifier, secret or endpoint


KINDS = [
    # fixed values: the three base patterns
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         ("passw", "secret", "token", "apikey", "api_key"), 2, 8, True, "secret"),
    Kind("access", r"AKIA[A-Z0-9]{12,}", ("akia",), 0, 16, True, "identifier"),
    Kind("hex", r"[0-9a-f]{32,}", (), 0, 32, True, "secret"),
    # weak candidates
    Kind("key", r"(?<![A-Za-z0-9/+=])(?=[A-Za-z0-9/+]{0,39}[A-Z])(?=[A-Za-z0-9/+]{0,39}[a-z])(?=[A-Za-z0-9/+]{0,39}[0-9])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])",
         (), 0, 40, False, "secret"),
    Kind("account", r"""(?i)\b(user|username|login|account|client_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]+)""",
         ("user", "login", "account", "client"), 2, 3, False, "identifier"),
    Kind("endpoint", r"[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._~%:@/-]+", ("://",), 0, 8, False, "endpoint"),
]


def _matches(kind: int, text: Column, lower: Column) -> Column:
    """Number, gap before, length and validity of every match; a pattern is tried only where it can match."""
    k = KINDS[kind]
    found = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(k.group)) if k.group else found
    # between two matches lies one piece of the split
    zipped = F.arrays_zip(found.alias("m"), F.split(text, k.pattern, -1).alias("p"), counted.alias("g"))
    rows = F.transform(
        F.filter(zipped, lambda z: z["m"].isNotNull()),
        lambda z, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(z["p"]).alias("gap"), F.length(z["m"]).alias("size"), (F.length(z["g"]) >= k.least).alias("ok")
        ),
    )
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,ok:boolean>>")
    possible = text.rlike(k.pattern)
    if k.words:
        hint = lower.contains(k.words[0])
        for word in k.words[1:]:
            hint = hint | lower.contains(word)
        possible = F.when(hint, possible).otherwise(F.lit(False))
    return F.when(possible, rows).otherwise(none)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text`` and two hashes that stand for the row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(1), "doc_id", "text")})


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``k1, k2, kind, start, end`` of all findings; ``kind`` is the place in ``KINDS``, places count code points, ``k1, k2`` stand for id and text.

    Base kinds always count. Of the weak kinds, a key counts within ``scope`` characters of an identifier (access key or account), an account
    near a secret (assignment, hex run or key), and an endpoint near both. Parts meet by an equi-join on row and
    stretch of the text, so the pairs looked at are those of neighbouring stretches.
    """
    rows = _keyed(docs, id_col, text_col).withColumn("lower", F.lower("text"))
    every = F.concat(*[_matches(n, F.col("text"), F.col("lower")) for n in range(len(KINDS))])
    single = rows.select("k1", "k2", F.explode(every).alias("_m")).select("k1", "k2", "_m.*").distinct()
    before = Window.partitionBy("k1", "k2", "kind").orderBy("i")
    ended = single.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(before).cast("bigint"))
    parts = stage(ended.where("ok").select("k1", "k2", "kind", (F.col("end") - F.col("size")).alias("start"), "end"), "parts")
    of = lambda role: [n for n, k in enumerate(KINDS) if k.role == role]
    base = [n for n, k in enumerate(KINDS) if k.base]
    weak = parts.where(~F.col("kind").isin(base)).withColumn("stretch", F.floor(F.col("start") / scope))
    near = parts.where(F.col("kind").isin(of("identifier") + of("secret"))).select(
        "k1", "k2", F.col("start").alias("at"), F.col("kind").isin(of("secret")).alias("secret"),
        F.explode(F.sequence(F.floor(F.col("start") / scope) - 1, F.floor(F.col("start") / scope) + 1)).alias("stretch"),
    )
    met = weak.join(near, ["k1", "k2", "stretch"]).where(F.abs(F.col("at") - F.col("start")) <= scope)
    seen = met.groupBy("k1", "k2", "kind", "start", "end").agg(F.max("secret").alias("secret"), F.max(~F.col("secret")).alias("identifier"))
    counts = (
        (F.col("kind").isin(of("secret")) & F.col("identifier"))
        | (F.col("kind").isin(of("identifier")) & F.col("secret"))
        | (F.col("kind").isin(of("endpoint")) & F.col("identifier") & F.col("secret"))
    )
    return parts.where(F.col("kind").isin(base)).unionByName(seen.where(counts).select("k1", "k2", "kind", "start", "end"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row; ``spans`` is ``kind:start:end`` by start, then kind, comma-joined.

    Null and empty texts have no spans. Repeated rows have the same result each; only keys and spans are shuffled, never texts.
    """
    names = F.array(*[F.lit(k.name) for k in KINDS])
    listed = secret_spans(docs, id_col, text_col).groupBy("k1", "k2").agg(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found")
    )
    shown = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    is_base = lambda s: s["kind"] < 3
    count = lambda n: F.size(F.filter("found", lambda s: s["kind"] == n)).cast("bigint")
    told = stage(
        listed.select("k1", "k2", *[count(n).alias(f"n_{KINDS[n].name}") for n in range(3)],
                      F.sha2(shown(F.filter("found", is_base)).cast("binary"), 256).alias("base_sha256"), shown(F.col("found")).alias("spans")),
        "findings",
    )
    rows = _keyed(docs, id_col, text_col).select("doc_id", "k1", "k2").join(told, ["k1", "k2"], "left")
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "doc_id", *[F.coalesce(f"n_{KINDS[n].name}", zero).alias(f"n_{KINDS[n].name}") for n in range(3)],
        F.coalesce("base_sha256", F.sha2(F.lit(b""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every finding replaced by ``mask``; overlapping and touching findings become one. Other texts stay as they are."""
    spans = secret_spans(docs, id_col, text_col)
    order = Window.partitionBy("k1", "k2").orderBy("start", "end")
    apart = F.col("start") > F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = spans.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = merged.groupBy("k1", "k2", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = stage(joined.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts")), "cuts")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"_k1": F.xxhash64(F.col(id_col), text), "_k2": F.xxhash64(F.lit(1), F.col(id_col), text)})
    both = keyed.join(cuts.withColumnsRenamed({"k1": "_k1", "k2": "_k2"}), ["_k1", "_k2"], "left")
    kept = F.expr(
        f"transform(sequence(0, size(_cuts)), i -> substring(`{text_col}`, "
        "CAST(CASE WHEN i = 0 THEN 1 ELSE _cuts[greatest(i - 1, 0)].end + 1 END AS INT), "
        f"CAST(CASE WHEN i = size(_cuts) THEN length(`{text_col}`) ELSE _cuts[least(i, size(_cuts) - 1)].start END "
        "- CASE WHEN i = 0 THEN 0 ELSE _cuts[greatest(i - 1, 0)].end END AS INT)))"
    )
    clean = F.when(F.col("_cuts").isNull(), F.col(text_col)).otherwise(F.array_join(kept, mask))
    return both.withColumn(text_col, clean).select(*docs.columns)
