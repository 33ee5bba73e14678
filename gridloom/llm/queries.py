"""The queries of the text operators, each over its whole table, and DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers
from pyspark.sql import functions as F

from . import canonical, exact_dedup, histogram_sort, language, packing, periodic_runs, prefix_trie, quality, simhash, suffix_tree, token_counts, unigram, url_reputation
from .common import crc_remainder, documents


def op1_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages").select("page_id", "url")
    return url_reputation.judge(pages, url_reputation.labelled(pages, documents(spark, sf_dir, "labels")))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(documents(spark, sf_dir))


def op3_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


def op4_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.encoded(documents(spark, sf_dir), public_tokenizers.path(unigram.MODEL))


def op5_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram_sort.shard_documents(documents(spark, sf_dir), shards=16)


def op6_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.fingerprints(documents(spark, sf_dir))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    """Learned from labels of the rows whose crc32(doc_id) mod 5 is not 0."""
    labels = documents(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    return quality.fit(docs, labels.filter(crc_remainder("doc_id", 5) != 0))


def op7_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = quality.scored(docs, quality_model(spark, docs, sf_dir))
    held_out = F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def language_model(docs: DataFrame) -> language.Model:
    """Learned from the rows whose crc32(doc_id) mod 3 is not 1."""
    return language.fit(docs.filter(crc_remainder("doc_id", 3) != 1))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = language.predicted(docs, language_model(docs))
    held_out = F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def tokenizer_path() -> str:
    return public_tokenizers.path(packing.TOKENIZER)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op10_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_documents(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(documents(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.collapsed(documents(spark, sf_dir), order=periodic_runs.planted)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(documents(spark, sf_dir), public_tokenizers.path(token_counts.MODEL))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_reputation": op1_url_reputation,
    "op2_suffix_tree": op2_suffix_tree,
    "op3_grace_dedup": op3_grace_dedup,
    "op4_unigram_pieces": op4_unigram_pieces,
    "op5_histogram_sort": op5_histogram_sort,
    "op6_canonical_digest": op6_canonical_digest,
    "op7_subword_quality": op7_subword_quality,
    "op8_language_id": op8_language_id,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_simhash_pivots": op10_simhash_pivots,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_counts": op13_token_counts,
}

ORACLES: dict[str, str] = {"op1_url_reputation": url_reputation.oracle(), "op3_grace_dedup": exact_dedup.ORACLE}


# Columns of these queries that SQL can state, checked on their own

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


def _crc_sql(text: str) -> str:
    """CRC-32 of a short ASCII string."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii(substr({text}, i, 1))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"


def _held_sql(modulus: int, remainder: int) -> str:
    return f"coalesce({_crc_sql('doc_id::VARCHAR')} % {modulus} = {remainder}, false)"


ORACLES["op11_prefix_trie"] = f"""WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS i, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
cv AS (SELECT DISTINCT c, c - c % 5 AS b, {_crc_sql("c::VARCHAR")} % 9 AS h FROM t), led AS (SELECT cv.c, i + 1 AS d, r, x FROM cv JOIN t ON t.c = cv.b WHERE i < h),
own AS (SELECT cv.c, coalesce(l, 0) + i - h + 1 AS d, r, x FROM cv JOIN t USING (c) LEFT JOIN (SELECT c, count(*) AS l FROM led GROUP BY 1) USING (c) WHERE i >= h),
p AS (SELECT c, d, x, list({{'r': r, 'x': x}}) OVER (PARTITION BY c ORDER BY d) AS k FROM (FROM led UNION ALL FROM own) UNION ALL SELECT c, 0, '', [] FROM cv),
n AS (SELECT d, k, min(c) AS m, count(*) AS n_convs, (count(*) - 1) * strlen(any_value(x)) AS saved FROM p GROUP BY 1, 2), spot AS (SELECT c, d, m FROM p JOIN n USING (d, k)),
kids AS (SELECT spot.m, spot.d, count(*) AS n_children FROM n JOIN spot ON spot.c = n.m AND spot.d = n.d - 1 GROUP BY 1, 2), known AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (m, d)),
below AS (SELECT spot.m, spot.d, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM known JOIN spot ON spot.c = known.m AND spot.d <= known.d GROUP BY 1, 2),
ends AS (SELECT m, d, string_agg(c::VARCHAR, ',' ORDER BY c) AS e FROM spot JOIN (SELECT c, max(d) AS d FROM p GROUP BY 1) USING (c, d) GROUP BY 1, 2)
SELECT m AS conv_id, known.d::BIGINT AS depth, up.m AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e, '')) AS ends_sha256
FROM known JOIN below USING (m, d) LEFT JOIN ends USING (m, d) LEFT JOIN spot up ON up.c = m AND up.d = known.d - 1"""


def suffix_tree_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_suffix_tree(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def quality_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_subword_quality(spark, sf_dir).select("doc_id", "held_out")


def language_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_language_id(spark, sf_dir).select("doc_id", "held_out")


def canonical_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_canonical_digest(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_histogram_sort(spark, sf_dir).select("doc_id", "size", "law")


QUERIES |= {f.__name__: f for f in (suffix_tree_base, quality_folds, language_folds, canonical_edits, shard_sizes)}
ORACLES |= {
    "suffix_tree_base": f"""WITH d AS (SELECT doc_id, {_held_sql(7, 2)} AS held_out, list_append({_WORDS}, chr(10)) AS w, row_number() OVER () AS r FROM documents),
t AS (SELECT r, held_out, unnest(w) AS word FROM d), c AS (SELECT word, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1), n AS (SELECT coalesce(sum(c), 0) AS n, count(*) AS v FROM c),
s AS (SELECT r, count(*) AS n_tokens, count(c) AS n_known, sum(log10((coalesce(c, 0) + 1)::DOUBLE / (n.n + n.v + 1))) AS base FROM t LEFT JOIN c USING (word), n GROUP BY 1)
SELECT doc_id, held_out, n_tokens, n_known, n.n::BIGINT AS train_tokens, round(base, 6) AS base_score FROM d JOIN s USING (r), n""",
    "quality_folds": f"SELECT doc_id, {_held_sql(5, 0)} AS held_out FROM documents",
    "language_folds": f"SELECT doc_id, {_held_sql(3, 1)} AS held_out FROM documents",
    "canonical_edits": """WITH o AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS f FROM documents)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 4) || substr(f, 1, length(t) // 4)) AS edited_sha256 FROM o""",
    "shard_sizes": "SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size, 'bytes' AS law FROM documents",
}
