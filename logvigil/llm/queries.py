"""The registered queries of these operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from logvigil.llm.alignment import align_tokenizers
from logvigil.llm.collocations import collocations
from logvigil.llm.decontaminate import contamination
from logvigil.llm.html_text import extract_text
from logvigil.llm.near_dedup import near_duplicates
from logvigil.llm.neighbours import nearest
from logvigil.llm.packing import pack_documents
from logvigil.llm.quality import score_documents, train
from logvigil.llm.secrets import scan_secrets
from logvigil.llm.substrings import remove_repeats
from logvigil.llm.token_counts import token_counts
from logvigil.llm.token_files import token_digests, write_token_files
from logvigil.llm.warc import round_trip
from logvigil.session import shared_dir

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER, PIECE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PACK_END, FILE_END = 1, 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_projected_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), k=20, every=20)


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), TOKENIZER, PACK_END)


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op6_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = train(docs, _table(spark, sf_dir, "labels"), "quality")
    return score_documents(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(_table(spark, sf_dir, "documents"), path, TOKENIZER, FILE_END)
    return token_digests(spark, path)


def op8_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op9_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), TOKENIZER)


def op11_diagonal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(_table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_TOKENIZER)


def op12_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op13_de_bruijn_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_probminhash, op2_projected_neighbours, op3_vector_packing, op4_spaced_seeds, op5_linked_secrets, op6_nbsvm_quality,
        op7_token_files, op8_recompression, op9_warc_chain, op10_token_counts, op11_diagonal_runs,
        op12_tree_scoring, op13_de_bruijn_phrases,
    )
}

_REPEATS = """
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, words, unnest(range(len(words) - 12)) AS i FROM w WHERE len(words) >= 13
), g AS (
  SELECT doc_id, i, array_to_string(words[i + 1:i + 13], ' ') AS gram FROM s
), first AS (
  SELECT gram, min(doc_id) AS low FROM g GROUP BY gram
), hit AS (
  SELECT DISTINCT g.doc_id, g.i + o.o AS pos FROM g JOIN first USING (gram), range(13) o(o) WHERE first.low < g.doc_id
), p AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM w
), kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.pos) AS text, count(*) AS n
  FROM p LEFT JOIN hit ON p.doc_id = hit.doc_id AND p.pos = hit.pos WHERE hit.pos IS NULL GROUP BY p.doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS low FROM pages
)
SELECT page_id, n AS payload_bytes, sha256(body) AS payload_digest,
  CASE WHEN n >= 100 AND low < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND low < page_id THEN low END AS refers_to
FROM p
"""

_PHRASES = """
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), p AS (
  SELECT lang, unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS words FROM p
), s AS (
  SELECT lang, words, unnest(range(len(words))) AS i FROM w
), f AS (
  SELECT lang, k, array_to_string(words[i + 1:i + k], ' ') AS phrase, count(*) AS n
  FROM s, range(1, 4) r(k) WHERE i + k <= len(words) GROUP BY ALL
), total AS (
  SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), often AS MATERIALIZED (
  SELECT lang, k, phrase, n, string_split(phrase, ' ') AS words FROM f WHERE n >= 10
), inner_ AS (
  SELECT c.lang, c.phrase FROM often c JOIN (
    SELECT lang, words[1] || ' ' || words[2] AS part, n FROM often WHERE k = 3
    UNION ALL SELECT lang, words[2] || ' ' || words[3], n FROM often WHERE k = 3
  ) longer ON c.lang = longer.lang AND c.phrase = longer.part WHERE 100 * longer.n >= 50 * c.n
), parts AS MATERIALIZED (
  SELECT lang, phrase, n AS a, j AS cut, array_to_string(words[1:j], ' ') AS head, array_to_string(words[j + 1:], ' ') AS rest
  FROM often, range(1, 3) q(j) WHERE j < k
), cut AS (
  SELECT parts.lang, parts.phrase, a, cut, x.n AS l, y.n AS r, (1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n) AS score
  FROM parts JOIN often x ON x.lang = parts.lang AND x.phrase = head JOIN often y ON y.lang = parts.lang AND y.phrase = rest
), best AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), ranked AS (
  SELECT best.*, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank
  FROM best ANTI JOIN inner_ ON best.lang = inner_.lang AND best.phrase = inner_.phrase
)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

ORACLES = {"op13_de_bruijn_phrases": _PHRASES, "op8_recompression": _REPEATS, "op9_warc_chain": _WARC}
