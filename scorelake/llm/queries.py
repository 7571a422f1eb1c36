"""Queries over the test tables, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import align, byte_bpe, embed_dedup, gif, html_tree, langid, line_dedup, merkle, minhash, packing, quality, token_orc, toxicity
from scorelake.llm.common import remove_folder

#: Places of public vocabulary files; operators take them as parameters.
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.harmonic_pack(_table(spark, sf_dir, "documents"), WORD_VOCABULARY, capacity=4096, end_id=2)


def op2_html_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.main_text(_table(spark, sf_dir, "pages"))


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_orc.new_folder(spark)
    token_orc.write_token_files(_table(spark, sf_dir, "documents"), folder, WORD_VOCABULARY, end_id=1)
    index = token_orc.token_index(token_orc.read_token_files(spark, folder))
    remove_folder(spark, folder)  # the index is in the checkpoint folder by now
    return index


def op4_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return quality.quality_scores(docs, model, threshold=0.3)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.byte_bpe(_table(spark, sf_dir, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)


def op8_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.text_media(_table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.languages(docs, langid.train(docs))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, percent=80)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")), threshold=0.7)


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fields = _table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.verified(docs, fields, group="source", order="doc_id", now=merkle.without_line_feeds(docs, fields, tampered))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignments(_table(spark, sf_dir, "documents"), BYTE_VOCABULARY, PIECES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_packing, op2_html_tree, op3_token_orc, op4_embed_dedup, op5_quality, op6_line_dedup, op7_byte_bpe, op8_gif, op9_language, op10_minhash,
        op11_toxicity, op12_merkle, op13_alignment,
    )
}

_COMPONENTS = """
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
"""

ORACLE_SQL: dict[str, str] = {
    "op4_embed_dedup": f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (
  SELECT * FROM v WHERE x IS NOT NULL AND len(x) > 0
  AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_dot_product(x, x) > 0
),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.vec_id <> q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.9),
{_COMPONENTS}
SELECT v.vec_id, CAST((SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS BIGINT) AS n_links,
  least(v.vec_id, coalesce(low.b, v.vec_id)) AS component_id, v.vec_id = least(v.vec_id, coalesce(low.b, v.vec_id)) AS kept
FROM v LEFT JOIN low ON low.a = v.vec_id
""",
    "op10_minhash": f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i : i + 3], ' '))) AS s
  FROM words WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
meets AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM shingles p JOIN shingles q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM meets JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
),
{_COMPONENTS}
SELECT d.doc_id, CAST(coalesce(sizes.n, 0) AS BIGINT) AS n_shingles,
  least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(low.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN low ON low.a = d.doc_id
""",
    "op12_merkle": """
WITH RECURSIVE
crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
),
docs AS (
  SELECT *, doc_id IS NOT NULL AND list_reduce(
    list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[CAST(xor(c, b) & 255 AS BIGINT) + 1])) & 1 = 1 AS tampered
  FROM documents, crc_table
),
parts AS (
  SELECT doc_id, source, tampered, text,
    CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(CAST(doc_id AS VARCHAR)), ':', doc_id) END ||
    CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END ||
    CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END ||
    CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(CAST(n_chars AS VARCHAR)), ':', n_chars) END AS front
  FROM docs
),
made AS (
  SELECT doc_id, source,
    sha256(front || CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END) AS leaf,
    sha256(front || CASE WHEN text IS NULL THEN '-' WHEN tampered THEN concat(strlen(replace(text, chr(10), '')), ':', replace(text, chr(10), '')) ELSE concat(strlen(text), ':', text) END) AS seen
  FROM parts
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree
  FROM made
),
below(level, tree, place, n, hash) AS (
  SELECT 0, tree, place, n, leaf FROM leaves
  UNION ALL
  SELECT level + 1, tree, place // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY place)) FROM below WHERE n > 1 GROUP BY level, tree, place // 3, n
),
subroots AS (SELECT tree, hash AS subroot, tree - 1 AS place, count(*) OVER () AS n FROM below WHERE n = 1),
above(level, place, n, hash) AS (
  SELECT 0, place, n, subroot FROM subroots
  UNION ALL
  SELECT level + 1, place // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY place)) FROM above WHERE n > 1 GROUP BY level, place // 3, n
),
nodes AS (
  SELECT level, tree, place, n, hash FROM below WHERE n > 1
  UNION ALL SELECT level, 0, place, n, hash FROM above WHERE n > 1
),
steps AS (
  SELECT level, tree, place,
    coalesce(string_agg(hash, '' ORDER BY place) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lefts,
    coalesce(string_agg(hash, '' ORDER BY place) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rights
  FROM nodes WINDOW w AS (PARTITION BY level, tree, place // 3 ORDER BY place)
),
climb(doc_id, leaf, tree, first, k, h, proof, phase, place, n) AS (
  SELECT doc_id, leaf, tree, place, 0, seen, '', CASE WHEN n > 1 THEN 0 ELSE 1 END, CASE WHEN n > 1 THEN place ELSE tree - 1 END, CASE WHEN n > 1 THEN n ELSE (SELECT count(*) FROM subroots) END FROM leaves
  UNION ALL
  SELECT c.doc_id, c.leaf, c.tree, c.first,
    CASE WHEN c.phase = 0 AND (c.n + 2) // 3 = 1 THEN 0 ELSE c.k + 1 END, sha256(s.lefts || c.h || s.rights), c.proof || s.lefts || s.rights,
    CASE WHEN c.phase = 0 AND (c.n + 2) // 3 > 1 THEN 0 ELSE 1 END,
    CASE WHEN c.phase = 0 AND (c.n + 2) // 3 = 1 THEN c.tree - 1 ELSE c.place // 3 END,
    CASE WHEN c.phase = 0 AND (c.n + 2) // 3 = 1 THEN (SELECT count(*) FROM subroots) ELSE (c.n + 2) // 3 END
  FROM climb c JOIN steps s ON s.level = c.k AND s.tree = CASE WHEN c.phase = 0 THEN c.tree ELSE 0 END AND s.place = c.place
  WHERE c.n > 1
)
SELECT c.doc_id, c.leaf, r.subroot, a.hash AS root, sha256(c.proof) AS proof_sha256, c.h AS folded_root, c.h = a.hash AS verified
FROM climb c JOIN subroots r ON r.tree = c.tree JOIN above a ON a.n = 1 WHERE c.phase = 1 AND c.n = 1
""",
}
