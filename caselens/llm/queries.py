"""The registered queries of the corpus operators, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (
    decontaminate, exact_dedup, filter_audit, forest_search, hmm_score, jaccard_join, language_id, mixing, secret_scan, suffix_dedup, token_counts, token_output,
    vector_codes,
)


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents"), length=400)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_scan(_table(spark, sf_dir, "documents"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_score.hmm_scores(_table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), n=10)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents")).drop("in_history")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), limit=512)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op13_forest_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest_search.forest_search(_table(spark, sf_dir, "embeddings"), k=20)


QUERIES = {
    f.__name__: f for f in (
        op1_suffix_array_dedup, op2_source_mixing, op3_secret_scan, op4_token_output, op5_language_id, op6_lm_scoring, op7_benchmark_decontamination,
        op8_exact_dedup, op9_token_counts, op10_ngram_jaccard_join, op11_filter_audit, op12_vector_codes, op13_forest_search,
    )
}

_OP2 = r"""
WITH d AS (SELECT doc_id, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, md5(coalesce(CAST(doc_id AS VARCHAR), 'text ' || md5(coalesce(text, '')))) AS h, md5(coalesce(text, '')) AS tie FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS s, CAST((row_number() OVER (ORDER BY skey) - 1) % 3 + 1 AS BIGINT) AS w, row_number() OVER (ORDER BY skey) - 1 AS kind FROM d GROUP BY skey),
r AS (SELECT *, CAST(3 * s AS DOUBLE) / w AS ratio FROM s),
l AS (SELECT *, CAST(sum(s) OVER () - coalesce(sum(3 * s) OVER upto, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER upto, 0) AS DOUBLE) AS level FROM r WINDOW upto AS (ORDER BY ratio, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT skey, s, kind, CASE WHEN level > ratio THEN CAST(3 * s AS DOUBLE) ELSE max(CASE WHEN level <= ratio THEN level END) OVER () * w END AS target FROM l),
q AS (SELECT *, least(CAST(floor(target + 0.5) AS BIGINT), 3 * s) AS quota FROM t),
p AS (SELECT doc_id, size, s, kind, target, quota, CASE WHEN s > 0 THEN quota // s ELSE 0 END AS rounds, CAST(coalesce(sum(size) OVER (PARTITION BY d.skey ORDER BY h, doc_id, size, tie ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d JOIN q USING (skey)),
k AS (SELECT *, CAST(rounds * size + least(greatest(quota - rounds * s - before, 0), size) AS BIGINT) AS taken FROM p),
y AS (SELECT *, (before + least(taken, size) / 2.0) / nullif(quota, 0) AS share FROM k)
SELECT doc_id, size, s AS source_size, round(target, 6) AS target, taken,
  CASE WHEN taken > 0 THEN round(least(greatest(CASE kind % 3 WHEN 0 THEN share WHEN 1 THEN sqrt(0.25 + 2 * share) - 0.5
    ELSE CASE WHEN share >= 0.625 THEN 0.5 + (sqrt(greatest(1.0 - 2 * (share - 0.625), 0.0)) - 1.0) / -1.0 ELSE (sqrt(greatest(2.25 - 2 * share, 0.0)) - 1.5) / -1.0 END END, 0.0), 1.0), 9) END AS position
FROM y
"""

_OP7 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM items),
grams AS (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, lengths WHERE len(w) >= n)),
hits AS (SELECT g.doc_id, g.n, g.i, t.item_id FROM grams g JOIN items t ON g.n = t.n AND g.gram = t.gram),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, n, i FROM hits)) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN pos USING (doc_id) LEFT JOIN own USING (doc_id)
"""

_OP8 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

_OP11 = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents),
m AS (SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT
  + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first_id, FALSE)::INT AS mask FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, own, sum(n) FILTER (mask & (own | before) = 0) AS kept, sum(n) FILTER (mask & own <> 0 AND mask & before = 0) AS removed,
  sum(n) FILTER (mask & own <> 0 AND mask & before <> 0) AS redundant, sum(n) FILTER (mask = own) AS unique_fails,
  sum(n_good) FILTER (mask & own <> 0 AND mask & before = 0) AS good_lost, sum(n_toxic) FILTER (mask & own <> 0 AND mask & before = 0) AS toxic_lost FROM c, s GROUP BY ALL),
z AS (SELECT part, filter_order, step, own, kept, coalesce(removed, 0) AS removed, redundant, unique_fails, good_lost, toxic_lost FROM r)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, removed::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM z
"""


def _op12() -> str:
    """Six rounds, each a table of nearest entries and one of new entries."""
    rounds = "".join(
        f"""
a{i} AS MATERIALIZED (SELECT r, part, min(d * 16 + e) % 16 AS e, min(d * 16 + e) // 16 AS d FROM (SELECT r, x.part, e, sum((x.x - c.x) * (x.x - c.x))::BIGINT AS d FROM x JOIN c{i} c USING (part, k) GROUP BY ALL) GROUP BY ALL),
s{i} AS (SELECT x.part, e, k, sum(x)::BIGINT AS s, count(*) AS n FROM x JOIN a{i} USING (r, part) GROUP BY ALL),
c{i + 1} AS MATERIALIZED (SELECT part, e, k, coalesce((s - (s % n + n) % n) // n, x) AS x FROM c{i} LEFT JOIN s{i} USING (part, e, k)),""" for i in range(7)
    )
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, embedding FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
x AS MATERIALIZED (SELECT r, (i - 1) // (n // 8) AS part, (i - 1) % (n // 8) AS k, floor(4096 * embedding[i]::DOUBLE)::BIGINT AS x FROM (SELECT r, embedding, len(embedding) AS n, unnest(range(1, len(embedding) + 1)) AS i FROM v)),
c0 AS (SELECT part, r AS e, k, x FROM x WHERE r < 16),{rounds}
b AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, e, k)) AS h FROM c6),
o AS (SELECT vec_id, label, string_agg(format('{{:02x}}', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a6 JOIN v USING (r) GROUP BY r, vec_id, label)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM o, b
"""


ORACLES = {"op2_source_mixing": _OP2, "op7_benchmark_decontamination": _OP7, "op8_exact_dedup": _OP8, "op11_filter_audit": _OP11, "op12_vector_codes": _op12()}
