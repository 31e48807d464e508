"""Benchmark decontamination by spaced seeds; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logvigil.llm.words import word_hashes
from logvigil.session import stage

WINDOW = 13
SUBSTITUTIONS = 2
SHORTEST = 5
TOLERANT = 8  # from this length on a short item may have one substitution
PART = 4  # a substitution leaves the first or the last so many words of an item of 8 words or more untouched
# A window falls into four blocks. Two substitutions leave two blocks untouched, so one of the six masks, each
# reading two blocks and ignoring the other positions, hits every window with at most two substitutions.
BLOCKS = [(0, 1, 2), (3, 4, 5), (6, 7, 8), (9, 10, 11, 12)]
MASKS = [(a, b) for a in range(4) for b in range(a + 1, 4)]
SEEDS_AT_ONCE = 1_000_000  # seeds that are broadcast together; more are taken in turns


def _seeded(rows: DataFrame, hashes: str, at: str, short: bool, parts: Column | None = None) -> DataFrame:
    """A row for each position of an item or text and each mask: the position in ``at``, the hash in ``seed``.

    With ``short`` also one for the ``PART`` words from the position on, where ``parts`` says so.

    Columns in between keep the generated code small; the words are never copied, as all of it is one compiled stage.
    """
    least = PART if short else WINDOW
    last = F.size(hashes) - least
    placed = rows.withColumn(at, F.explode(F.when(last >= 0, F.sequence(F.lit(0), last))))
    word = lambda k: F.get(F.col(hashes), F.col(at) + k)
    blocks = {f"_b{n}": F.xxhash64(*[word(k) for k in places]) for n, places in enumerate(BLOCKS)}
    if short:
        part = F.xxhash64(F.lit(len(MASKS)), *[word(k) for k in range(PART)])
        blocks["_part"] = part if parts is None else F.when(parts, part)
        blocks["_full"] = F.col(at) + WINDOW <= F.size(hashes)
    masks = [F.xxhash64(F.lit(n), F.col(f"_b{a}"), F.col(f"_b{b}")) for n, (a, b) in enumerate(MASKS)]
    if short:
        masks = [*[F.when(F.col("_full"), m) for m in masks], F.col("_part")]
    return placed.withColumns(blocks).withColumn("seed", F.explode(F.array(*masks))).drop(*blocks).where("seed IS NOT NULL")


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``doc_id, item_id, position, matched, item_words``: which benchmark items a document repeats, one row per pair.

    Words are lower case, split at ASCII white space. A document repeats an item if 13 of its consecutive words agree with 13
    consecutive words of the item in all but two places at most; items of 8 to 12 words must appear whole with one word changed at
    most, items of 5 to 7 words unchanged. Shorter ones stand in unrelated texts too; they are not sought but listed by
    :func:`unsought`. ``matched`` is the largest number of the item's words found in one alignment, ``position`` the word where that
    alignment begins (the first such; it may be before the text's start by the part of the item that is missing).

    Every position's masks are looked up among the items' masks, which are broadcast in turns of at most ``SEEDS_AT_ONCE``, so
    neither texts nor positions are shuffled for it; then the texts with hits are compared word by word over the whole alignment. Null and
    short texts repeat nothing; null ids are left out; rows with equal ids count as one document.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), word_hashes(F.lower(item_text)).alias("item"))
    items = stage(items.where(F.size("item") >= SHORTEST).distinct(), "items")
    short = not items.where(F.size("item") < WINDOW).isEmpty()
    # a short item is sought by its first and last words only, a long one by its masks only
    n = F.size("item")
    parts = (n < WINDOW) & ((F.col("at") == 0) | ((n >= TOLERANT) & (F.col("at") == n - PART)))
    masked = _seeded(items, "item", "at", short, parts)
    seeds = stage(masked.select("seed", "item_id", "at").distinct(), "seeds")
    turns = max(1, -(-seeds.count() // SEEDS_AT_ONCE))

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    placed = _seeded(rows.select("doc_id", word_hashes(F.lower("text")).alias("hashes")), "hashes", "pos", short)
    found = None
    for turn in range(turns):
        part = seeds.where(F.pmod(F.xxhash64("seed"), F.lit(turns)) == turn) if turns > 1 else seeds
        hits = placed.join(F.broadcast(part), "seed").select("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("position"))
        found = hits if found is None else found.unionByName(hits)
    hits = stage(found.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "position")).alias("hits")), "hits")
    texts = rows.join(hits, "doc_id").select("doc_id", word_hashes(F.lower("text")).alias("hashes"), "hits")
    aligned = texts.withColumn("hit", F.explode("hits")).select("doc_id", "hashes", "hit.*").join(items, "item_id")
    same = aligned.withColumn(
        # a window must lie in the text: places outside spoil every sum
        "same", F.expr("transform(item, (w, j) -> CASE WHEN position + j BETWEEN 0 AND size(hashes) - 1 "
        "THEN CAST(w <=> get(hashes, greatest(position + j, 0)) AS INT) ELSE -100 END)")
    ).select("doc_id", "item_id", "position", "same")
    window = f"transform(sequence(0, size(same) - {WINDOW}), k -> aggregate(slice(same, k + 1, {WINDOW}), 0, (a, x) -> a + x))"
    best = F.when(F.size("same") >= WINDOW, F.expr(f"CASE WHEN size(same) >= {WINDOW} THEN array_max({window}) END") >= WINDOW - SUBSTITUTIONS)
    agreed = F.aggregate("same", F.lit(0), lambda a, x: a + x)
    right = best.otherwise(agreed >= F.size("same") - F.when(F.size("same") >= TOLERANT, 1).otherwise(0))
    matched = F.size(F.filter("same", lambda x: x == 1))
    verified = same.where(right).select("doc_id", "item_id", "position", matched.alias("matched"), F.size("same").alias("item_words"))
    pick = F.min(F.struct((-F.col("matched")).alias("m"), "position"))
    return verified.groupBy("doc_id", "item_id", "item_words").agg(pick.alias("_best")).select(
        "doc_id", "item_id", F.col("_best.position").alias("position"), (-F.col("_best.m")).alias("matched"), "item_words"
    )


def unsought(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, item_words`` of the items that :func:`contamination` does not seek, as they have fewer than ``SHORTEST`` words."""
    sized = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.size(word_hashes(F.lower(item_text))).alias("item_words"))
    return sized.where(F.col("item_words") < SHORTEST).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """The rows of ``docs`` that repeat no benchmark item; rows without an id are kept."""
    leaks = stage(contamination(docs, benchmark, id_col=id_col, **columns).select(F.col("doc_id").alias("_leak")).distinct(), "leaks")
    return docs.join(leaks, docs[id_col] == leaks["_leak"], "left_anti")
