"""Phrase collocations from a weighted de Bruijn graph of words.

Only the longest grams are counted: an edge of three words leads from the node of its first two words to that of its last
two. A piece's last words, behind which no edge can begin, are counted as piece ends. Every occurrence of a shorter phrase is
then the begin of exactly one edge or piece end: a node's count is its outward flow plus the pieces that end in it, a word's
count is the flow of the nodes it begins plus the pieces whose last word it is.

Most grams are made of words that are frequent in a bounded sample. Those move through the shuffles as one number, put together from the
numbers of language and words; the rest moves as text: ``a b c``, or ``a b `` for a piece's end in a node, behind a digit that says how many
words in front have numbers, and before a tab and the language. A node or word that has numbers keeps its whole flow among the numbers, where one number
stands for all words without. So the sample bears on the size of rows, not on any count. Edges are dealt out whole and nodes are
summed before they are dealt out, so a frequent word or node fills no partition.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvigil.llm.encoding import byte_batches
from logvigil.llm.scratch import Scratch

BATCH_BYTES = 2 << 20  # a graph is made of about so many bytes of text; longer texts are cut behind pieces
_SEPARATORS = "[.,;:!?\n\x0b\x0c\r]"
_BREAK = "."  # no word holds one
UNKNOWN = "und"
SAMPLE_TEXTS, LANGS, WORD_BITS = 20_000, 500, 18  # texts sampled for words with numbers, languages and bits of words (2 ** 18 words)
WORD_BYTES = 64  # longer words have no number
END, OTHER = 0, 1  # numbers of a piece's end and of words without a number


def _cut(text: str, limit: int) -> Iterator[str]:
    """Parts of at least ``limit`` characters (the last may be shorter), cut at ends of pieces only."""
    at, separator = 0, re.compile(_SEPARATORS)
    while len(text) - at > limit and (end := separator.search(text, at + limit)) is not None:
        yield text[at : end.start()]
        at = end.end()
    yield text[at:]


def text_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of words of every text, separators counted as words; all words as places in a table; the table.

    A separator stands at the end of every piece, and its place is the one behind the table's words, where an empty text is.
    """
    texts = pc.fill_null(texts, "").take(pa.array(np.arange(len(texts))))  # some functions misread slices of large strings
    texts = pc.replace_substring_regex(pc.ascii_lower(texts.cast(pa.large_string())), _SEPARATORS, f" {_BREAK} ")
    # a text's end is a piece's end
    texts = pc.binary_join_element_wise(texts, pa.scalar(_BREAK, pa.large_string()), pa.scalar(" ", pa.large_string()))
    lists = pc.ascii_split_whitespace(pc.ascii_ltrim_whitespace(texts))  # blanks in front would make an empty word
    coded = lists.flatten().dictionary_encode()
    table = coded.dictionary.cast(pa.string())
    code = coded.indices.to_numpy().astype(np.int64)
    code = np.where(code == pc.index(table, _BREAK).as_py(), len(table), code)
    return np.diff(lists.offsets.to_numpy()), code, pa.concat_arrays([table, pa.array([""], pa.string())])


def text_grams(texts: pa.Array, langs: pa.Array, numbered: pa.Array, numbered_langs: pa.Array) -> pa.RecordBatch:
    """``key, gram, n``: edges and piece ends of some texts, as a number or as text."""
    sizes, code, words = text_words(texts)
    end = len(words) - 1
    lang = langs.dictionary_encode()
    of = np.repeat(lang.indices.to_numpy().astype(np.int64), sizes)
    at = np.flatnonzero(code != end)
    padded = np.append(code, end)
    second = padded[at + 1]
    third = np.where(second == end, end, padded[np.minimum(at + 2, len(padded) - 1)])
    width = end + 1
    pair, which = np.unique(code[at] * width + second, return_inverse=True)
    pairs = max(len(pair), 1)
    gram, n = np.unique((of[at] * pairs + which) * width + third, return_counts=True)
    node, lang_of = pair[gram // width % pairs], gram // (width * pairs)
    parts = [node // width, node % width, gram % width]

    def numbers(table: pa.Array, known: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.add(pc.index_in(table, value_set=known), 2), OTHER).to_numpy(zero_copy_only=False).astype(np.int64)

    number, lang_number = numbers(words, numbered), numbers(lang.dictionary, numbered_langs)[lang_of]
    number[end] = END
    a, b, c = (number[part] for part in parts)
    a = np.where(lang_number == OTHER, OTHER, a)
    # what has a number in front counts in full among the numbers
    key = ((lang_number << WORD_BITS | a) << WORD_BITS | b) << WORD_BITS | np.where(b == OTHER, OTHER, c)
    key, which = np.unique(key[a != OTHER], return_inverse=True)
    key_n = np.bincount(which, weights=n[a != OTHER], minlength=len(key)).astype(np.int64)
    text = np.flatnonzero((a == OTHER) | (b == OTHER) | (c == OTHER))
    front = pa.array(["0", "1", "2"]).take(pa.array(np.where(a == OTHER, 0, np.where(b == OTHER, 1, 2))[text]))
    spelt = pc.binary_join_element_wise(*[words.take(pa.array(part[text])) for part in parts], " ")
    spelt = pc.binary_join_element_wise(pc.binary_join_element_wise(front, spelt, ""), lang.dictionary.take(pa.array(lang_of[text])), "\t")
    return pa.RecordBatch.from_arrays(
        [
            pa.concat_arrays([pa.array(key), pa.nulls(len(text), pa.int64())]),
            pa.concat_arrays([pa.nulls(len(key), pa.string()), spelt]),
            pa.array(np.concatenate((key_n, n[text])), pa.int64()),
        ],
        ["key", "gram", "n"],
    )


def frequent_words(docs: DataFrame) -> tuple[list[str], list[str]]:
    """The words and languages that get numbers: the most frequent of a sample of about ``SAMPLE_TEXTS`` texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_batches(batch, "text", BATCH_BYTES):
                _, code, words = text_words(part.column("text"))
                found = pa.array(np.bincount(code, minlength=len(words))[:-1], pa.int64())
                yield pa.RecordBatch.from_arrays([words[:-1], found], ["word", "n"])

    sample = docs.sample(min(1.0, SAMPLE_TEXTS / max(docs.count(), 1)), seed=1)
    counts = sample.select("text").mapInArrow(count, "word string, n bigint").where(f"n > 0 AND octet_length(word) <= {WORD_BYTES}")
    top = counts.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit((1 << WORD_BITS) - 2)
    langs = sample.groupBy("lang").agg(F.count("*").alias("n")).where(f"octet_length(lang) <= {WORD_BYTES}").orderBy(F.desc("n"), "lang").limit(LANGS)
    return [r.word for r in top.select("word").collect()], [r.lang for r in langs.select("lang").collect()]


def gram_counts(docs: DataFrame, words: list[str], langs: list[str]) -> DataFrame:
    """``key, gram, n``: edges and piece ends of ``text, lang`` with their numbers."""
    # lists of bounded length and bounded words
    shared = docs.sparkSession.sparkContext.broadcast((words, langs))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [pa.array(names, pa.string()) for names in shared.value]
        for batch in batches:
            for part in byte_batches(batch, "text", BATCH_BYTES):
                text, lang = part.column("text"), part.column("lang")
                if part.num_rows == 1 and text[0].is_valid and text[0].as_buffer().size > BATCH_BYTES:
                    for piece in _cut(text[0].as_py(), BATCH_BYTES):
                        yield text_grams(pa.array([piece], pa.string()), lang, *known)
                else:
                    yield text_grams(text, lang, *known)

    return docs.mapInArrow(count, "key bigint, gram string, n bigint").groupBy("key", "gram").agg(F.sum("n").alias("n"))


def phrase_graph(docs: DataFrame, scratch: Scratch, min_count: int = 10, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, words, phrase, n``: edges (3 words), nodes (2) and words (1) of the graph of all texts.

    Edges and nodes below ``min_count`` are left out. Whatever holds a rare phrase is rare too, so no frequent phrase misses a part. Words
    that have no number and are rare are put together under a null phrase, for their sum.
    """

    def begin(key: str, words: int) -> str:
        """The first words of a gram in text form, with its language."""
        return f"concat(substring_index({key}, ' ', {words}), substring({key}, instr({key}, '\t')))"

    def ends(key: str) -> str:
        return f"substring({key}, instr({key}, '\t') - 1, 1) = ' '"

    spark, low = docs.sparkSession, (1 << WORD_BITS) - 1
    rows = docs.select(F.col(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    words, langs = frequent_words(rows)
    grams = gram_counts(rows, words, langs)
    nodes = grams.groupBy(
        F.expr(f"shiftright(key, {WORD_BITS}) AS key"), F.expr(f"CASE WHEN gram < '2' THEN {begin('gram', 2)} END AS gram")
    ).agg(F.sum("n").alias("n"))
    singles = nodes.groupBy(
        F.expr(f"shiftright(key, {WORD_BITS}) AS key"), F.expr(f"CASE WHEN gram < '1' THEN {begin('gram', 1)} END AS gram")
    ).agg(F.sum("n").alias("n"))
    # Conditions that join count and text stay above the aggregation: all uses of it are then the same, and shuffle once.
    odd = f"(key IS NULL AND (gram IS NULL OR {ends('gram')})) OR coalesce(key & {low} <= {OTHER}, false)"
    often = f"if({odd}, 0, n) >= {min_count}"
    rare = f"gram IS NOT NULL AND n < {min_count}"
    kept = grams.where(often).selectExpr("3 AS words", "key", "gram", "n").unionByName(
        nodes.where(often).selectExpr("2 AS words", "key", "gram", "n")
    ).unionByName(
        singles.where("if(key IS NULL AND gram IS NULL, 0, n) > 0")
        .groupBy("key", F.expr(f"if({rare}, concat('0', substring(gram, instr(gram, '\t'))), gram) AS gram")).agg(F.sum("n").alias("n"))
        .selectExpr("1 AS words", "key", "gram", "n")
    )
    counted = scratch.stage(kept, "grams")
    word_of = F.broadcast(spark.createDataFrame(list(enumerate(words, 2)), "number bigint, word string"))
    lang_of = F.broadcast(spark.createDataFrame(list(enumerate(langs, 2)), "number bigint, lang string"))
    numbers = counted.where("key IS NOT NULL").selectExpr(
        "words", "n", f"shiftright(key, {WORD_BITS} * words) AS _lang",
        *[f"CASE WHEN words > {k} THEN shiftright(key, {WORD_BITS} * (words - {k + 1})) & {low} END AS _w{k}" for k in range(3)],
    )
    for k in range(3):
        numbers = numbers.join(word_of.withColumnsRenamed({"number": f"_w{k}", "word": f"word{k}"}), f"_w{k}", "left")
    numbers = numbers.join(lang_of.withColumnRenamed("number", "_lang"), "_lang")
    spelt = numbers.selectExpr("lang", "words", "concat_ws(' ', word0, word1, word2) AS phrase", "n")
    texts = counted.where("key IS NULL").selectExpr(
        "substring(gram, instr(gram, '\t') + 1) AS lang", "words", "nullif(substring(substring_index(gram, '\t', 1), 2), '') AS phrase", "n"
    )
    return scratch.stage(spelt.unionByName(texts), "phrase-graph")


def _nodes(graph: DataFrame) -> DataFrame:
    """Nodes with the heaviest edge into them and out of them, and whether they are unary.

    A node's whole flow enters by one edge and leaves by one: neither piece begins or ends in it, and no other edge meets it.
    """
    edges = graph.where("words = 3")
    ends = edges.selectExpr(
        "lang",
        "inline(array(struct(substring_index(phrase, ' ', 2) AS node, 0L AS n_in, n AS n_out), "
        "struct(substring_index(phrase, ' ', -2) AS node, n AS n_in, 0L AS n_out)))",
    )
    heaviest = ends.groupBy("lang", "node").agg(F.max("n_in").alias("n_in"), F.max("n_out").alias("n_out"))
    nodes = graph.where("words = 2").select("lang", F.col("phrase").alias("node"), "n")
    joined = nodes.join(heaviest, ["lang", "node"], "left").na.fill(0, ["n_in", "n_out"])
    return joined.withColumn("unary", F.expr("n_in = n AND n_out = n"))


def unary_paths(graph: DataFrame, scratch: Scratch) -> DataFrame:
    """``lang, phrase, words, n``: the graph's edges, joined to one phrase along paths of unary nodes.

    Every round doubles the part of its path that a phrase covers, so a path of k edges takes log2(k) rounds.
    """
    unary = scratch.stage(_nodes(graph).where("unary").select("lang", "node"), "unary")
    edges = graph.where("words = 3").selectExpr(
        "lang", "phrase", "n", "substring_index(phrase, ' ', 2) AS head", "substring_index(phrase, ' ', -2) AS tail"
    )
    into = unary.select("lang", F.col("node").alias("tail"), F.lit(True).alias("goes_on"))
    begins = unary.select("lang", F.col("node").alias("head"), F.lit(True).alias("follows"))
    paths = edges.join(into, ["lang", "tail"], "left").join(begins, ["lang", "head"], "left")
    paths = scratch.stage(paths.selectExpr("lang", "head", "tail", "phrase", "n", "goes_on IS NOT NULL AS goes_on", "follows IS NOT NULL AS follows"), "paths")
    while not paths.where("goes_on").isEmpty():
        # an open path takes in the one behind it; that one is still needed by others unless it is a path's second part
        behind = paths.where("follows").selectExpr("lang", "head AS tail", "phrase AS more", "tail AS next_tail", "goes_on AS next_goes_on")
        longer = paths.join(behind, ["lang", "tail"], "left").selectExpr(
            "lang", "head", "if(more IS NULL, tail, next_tail) AS tail",
            "if(more IS NULL, phrase, concat(phrase, substring(more, 1 + length(substring_index(more, ' ', 2))))) AS phrase",
            "n", "coalesce(next_goes_on, false) AS goes_on", "follows",
        )
        paths = scratch.stage(longer, "paths")
    return paths.where("NOT follows").selectExpr("lang", "phrase", "size(split(phrase, ' ')) AS words", "n")


def collocations(
    docs: DataFrame, top: int = 2000, min_count: int = 10, covered_percent: int = 50, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: per language the first ``top`` phrases of two and three words.

    Words are runs without blanks and tabs, of lower-cased A-Z, inside pieces that end at punctuation and line ends. ``a`` is the
    phrase's count, ``l`` and ``r`` those of its parts at the cut with the lowest score, the smaller part first at ties, ``n`` the number
    of words of the language. A phrase is left out if it lies in a longer one with ``covered_percent`` of its count; the inner
    nodes of unary paths always do, since they carry their path's count, so they are dropped with their path compacted. Order: score, count, phrase in
    bytes. Null texts have no words, a null language is ``und``, rows count as often as they occur, other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    graph = phrase_graph(docs, scratch, min_count, text_col, lang_col)
    words = graph.where("words = 1")
    total = words.groupBy("lang").agg(F.sum("n").alias("total"))
    single = words.where(f"phrase IS NOT NULL AND n >= {min_count}").select("lang", "phrase", "n")
    pairs = graph.where("words = 2").select("lang", "phrase", "n")

    def part(table: DataFrame, key: str, value: str) -> DataFrame:
        return table.select("lang", F.col("phrase").alias(key), F.col("n").alias(value))

    def scored(left: str, right: str) -> str:
        exact = "CAST({} AS DECIMAL(19, 0))"
        return f"(1000000 * ({exact.format('a')} * {exact.format('a')})) div ({exact.format(left)} * {exact.format(right)})"

    nodes = _nodes(graph).where(f"NOT unary AND 100 * greatest(n_in, n_out) < {covered_percent} * n")
    twos = (
        nodes.selectExpr("lang", "node AS phrase", "n AS a", "substring_index(node, ' ', 1) AS w1", "substring_index(node, ' ', -1) AS w2")
        .join(part(single, "w1", "l"), ["lang", "w1"])
        .join(part(single, "w2", "r"), ["lang", "w2"])
        .selectExpr("lang", "phrase", "a", "l", "r", f"{scored('l', 'r')} AS score")
    )
    threes = (
        graph.where("words = 3")
        .selectExpr(
            "lang", "phrase", "n AS a", "substring_index(phrase, ' ', 1) AS w1", "substring_index(phrase, ' ', -2) AS w23",
            "substring_index(phrase, ' ', 2) AS w12", "substring_index(phrase, ' ', -1) AS w3",
        )
        .join(part(pairs, "w12", "l2"), ["lang", "w12"])
        .join(part(pairs, "w23", "r1"), ["lang", "w23"])
        .join(part(single, "w1", "l1"), ["lang", "w1"])
        .join(part(single, "w3", "r2"), ["lang", "w3"])
        .selectExpr("*", f"{scored('l1', 'r1')} AS s1", f"{scored('l2', 'r2')} AS s2")
        .selectExpr("lang", "phrase", "a", "if(s1 <= s2, l1, l2) AS l", "if(s1 <= s2, r1, r2) AS r", "least(s1, s2) AS score")
    )
    order = "row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)"
    first = twos.unionByName(threes).selectExpr("*", f"{order} AS rank").where(f"rank <= {top}")
    return first.join(total, "lang").selectExpr(
        "lang", "CAST(rank AS BIGINT) AS rank", "phrase", "a", "l", "r", "total AS n", "CAST(score AS BIGINT) AS score"
    )
