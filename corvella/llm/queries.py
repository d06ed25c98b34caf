"""The registered query of each operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvella.llm import line_dedup, manifest, metric_search, mixing, negatives, packing, pii, piece_tokens, quality_classifier, quality_rules, secret_scan, sharding, simhash


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rule_verdicts(_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_digests(_table(spark, sf_dir, "documents"))


def op5_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_tokens.token_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_digests(_table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digests(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digests(_table(spark, sf_dir, "documents"))


def op9_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op10_metric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_search.top_k(_table(spark, sf_dir, "embeddings"))


def op11_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest_proofs(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (
        op1_quality_rules,
        op2_quality_classifier,
        op3_best_fit_packing,
        op4_personal_data,
        op5_piece_tokens,
        op6_simhash,
        op7_line_dedup,
        op8_secret_scan,
        op9_hilbert_sharding,
        op10_metric_search,
        op11_curriculum_mix,
        op12_merkle_manifest,
        op13_hard_negatives,
    )
    return {f.__name__: f for f in each}


def oracle_sql() -> dict[str, str]:
    return {
        "op7_line_dedup": LINE_DEDUP_SQL,
        "op10_metric_search": TOP_K_SQL,
        "op11_curriculum_mix": MIX_SQL,
        "op12_merkle_manifest": MANIFEST_SQL,
        "op13_hard_negatives": NEGATIVES_SQL,
    }


LINE_DEDUP_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, list_extract(parts, i) AS line,
         translate(trim(list_extract(parts, i), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), shared AS (
  SELECT key, max(doc_id) AS holder FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE holder IS NOT NULL AND doc_id <> holder) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE holder IS NULL OR doc_id = holder), '')) AS kept_sha256
FROM lines LEFT JOIN shared USING (key)
GROUP BY doc_id
"""

TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
) WHERE rank <= 10
"""

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS kind FROM sized GROUP BY source
), weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][kind + 1] AS w FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / w, source IS NULL, source)
), targets AS (
  SELECT source, source_size, kind, least((3 * source_size)::DOUBLE, max(level) OVER () * w) AS target FROM levels
), streams AS (
  SELECT doc_id, size, source_size, target, kind,
         (sum(size) OVER (PARTITION BY s.source ORDER BY md5(coalesce(doc_id::VARCHAR, '-') || ':' || size), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, list_transform([0, 1, 2], lambda e: greatest(0, least(size, floor(target + 0.5)::BIGINT - (e * source_size + before)))) AS words FROM streams
), placed AS (
  SELECT *, CASE WHEN words[1] > 0 THEN before / target * [5.0, 2.0, 1.0][kind + 1]::DOUBLE END AS demand FROM taken
)
SELECT doc_id, size, source_size, target, list_sum(words)::BIGINT AS taken, len(list_filter(words, lambda x: x > 0))::INTEGER AS copies,
       CASE WHEN demand IS NULL THEN NULL WHEN demand <= 0 THEN 0.0::DOUBLE
            ELSE least(1.0::DOUBLE, 2 * demand / (([6.0, 2.0, 0.0][kind + 1])::DOUBLE + sqrt(greatest(0.0, pow([6.0, 2.0, 0.0][kind + 1]::DOUBLE, 2) + 2 * [-2.0, 0.0, 2.0][kind + 1]::DOUBLE * demand)))) END AS position
FROM placed
"""

#: Trees by the number of a level; the fold is one hash a level, from the leaf up.
MANIFEST_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT DISTINCT doc_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT + 256, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: xor(xor(a, greatest(x - 256, 0)) >> 1, 3988292384 * (xor(a, greatest(x - 256, 0)) & 1)))) AS crc
  FROM documents WHERE doc_id IS NOT NULL
), coded AS (
  SELECT doc_id, lang, coalesce(crc % 7 = 0, false) AS tampered,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents LEFT JOIN crc USING (doc_id)
), leaves AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         CASE WHEN tampered THEN sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) END AS altered
  FROM coded
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS spot, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), low AS (
  SELECT 0 AS level, tree, spot, n, leaf AS hash FROM placed
  UNION ALL
  SELECT level + 1, tree, spot // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY spot)) FROM low WHERE n > 1 GROUP BY level, tree, spot // 2, n
), subroots AS (
  SELECT tree, level AS height, hash AS subroot, row_number() OVER (ORDER BY tree) - 1 AS spot, count(*) OVER () AS n FROM low WHERE n = 1
), high AS (
  SELECT 0 AS level, spot, n, subroot AS hash FROM subroots
  UNION ALL
  SELECT level + 1, spot // 2, (n + 1) // 2, sha256(string_agg(hash, '' ORDER BY spot)) FROM high WHERE n > 1 GROUP BY level, spot // 2, n
), steps AS (
  SELECT p.doc_id, p.tree, p.spot AS leaf_spot, l.level AS step, (p.spot >> l.level) & 1 AS slot, coalesce(b.hash, '') AS sibling
  FROM placed p JOIN (SELECT DISTINCT tree, level FROM low WHERE n > 1) l USING (tree)
  LEFT JOIN low b ON b.tree = p.tree AND b.level = l.level AND b.spot = xor(p.spot >> l.level, 1)
  UNION ALL
  SELECT p.doc_id, p.tree, p.spot, s.height + h.level, (s.spot >> h.level) & 1, coalesce(b.hash, '')
  FROM placed p JOIN subroots s USING (tree) JOIN (SELECT DISTINCT level FROM high WHERE n > 1) h ON true
  LEFT JOIN high b ON b.level = h.level AND b.spot = xor(s.spot >> h.level, 1)
), paths AS (
  SELECT p.doc_id, p.tree, p.spot, any_value(p.leaf) AS leaf, any_value(coalesce(p.altered, p.leaf)) AS start,
         coalesce(list({'slot': slot, 'sibling': sibling} ORDER BY step) FILTER (WHERE step IS NOT NULL), []) AS path
  FROM placed p LEFT JOIN steps s ON s.tree = p.tree AND s.leaf_spot = p.spot GROUP BY p.doc_id, p.tree, p.spot
), folded AS (
  SELECT tree, spot, 1 AS step, start AS hash FROM paths
  UNION ALL
  SELECT f.tree, f.spot, step + 1, CASE WHEN path[step].slot = 0 THEN sha256(hash || path[step].sibling) ELSE sha256(path[step].sibling || hash) END
  FROM folded f JOIN paths p ON f.tree = p.tree AND f.spot = p.spot WHERE step <= len(path)
)
SELECT p.doc_id, p.leaf, s.subroot, r.hash AS root, sha256(list_aggregate(list_append(list_transform(path, lambda x: x.sibling), ''), 'string_agg', '')) AS proof_sha256,
       f.hash AS folded_root, f.hash = r.hash AS verified
FROM paths p JOIN subroots s USING (tree) JOIN (SELECT hash FROM high WHERE n = 1) r ON true
JOIN folded f ON f.tree = p.tree AND f.spot = p.spot AND f.step = len(p.path) + 1
"""

NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(list_zip(a.vec, c.vec), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INTEGER AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
