"""Registered queries of this subpackage: every operator over its whole table with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custlens.llm import (
    centroids, decontamination, embeddings, language, licenses, merkle, pii, sharding, simhash, substrings, token_files, tokens, word_bpe,
)
from custlens.llm.common import shared_dir, table

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
TOKEN_LIMIT = 1024
END_ID = 2
SPAN_WORDS = 20
MIN_COSINE = 0.98
SHINGLE_WORDS, MAX_BITS = 4, 4
OLD_SHARDS, SHARDS = 12, 16
CENTROIDS, ROUNDS, DIMENSIONS = 40, 5, 64
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), TOKEN_LIMIT)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(table(spark, sf_dir, "documents"), SPAN_WORDS)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), MIN_COSINE)


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), SHINGLE_WORDS, MAX_BITS)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("text_hash")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(table(spark, sf_dir, "documents"), out, public_tokenizers.path(BYTE_BPE), END_ID)
    return token_files.read_index(spark, out)


def op11_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve shards by source, of very unequal size, resharded to sixteen of equal bytes; read from the files of the new layout."""
    docs = table(spark, sf_dir, "documents")
    by_source = F.pmod(F.xxhash64("source"), F.lit(OLD_SHARDS))
    layout, _ = sharding.reshard(sharding.write_layout(docs, by_source, OLD_SHARDS, "doc_id"), shards=SHARDS)
    rows = sharding.read_layout(layout)
    return rows.select(
        F.col("row.doc_id").alias("doc_id"), "size", F.crc32(F.coalesce("row.text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.clusters(table(spark, sf_dir, "embeddings"), CENTROIDS, ROUNDS, DIMENSIONS)
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",").cast("binary"), 256)
    return found.withColumn("centroid_sha256", digest).drop("centroid")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    rows = merkle.manifest(docs, LEAF_COLUMNS, "doc_id", "lang", {"n_chars": F.col("n_chars") + 1}, tampered)
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"),
                       "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


SUBSTRINGS_SQL = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
runs AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS run
         FROM w, unnest(range(1, len(words) - 18)) AS u(i)),
later AS (SELECT doc_id, i FROM (
            SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS place FROM runs) WHERE place > 1),
gone AS (SELECT doc_id, list(DISTINCT j) AS js FROM later, unnest(range(i, i + 20)) AS u(j) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN js IS NULL THEN words ELSE
         [words[k] FOR k IN range(1, len(words) + 1) IF NOT list_contains(js, k)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)"""

EMBEDDINGS_SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {MIN_COSINE}),
reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
low AS (SELECT x, MIN(y) AS y FROM reach GROUP BY x)
SELECT vec_id, (SELECT COUNT(*) FROM link WHERE x = vec_id) AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(y, vec_id)) AS kept
FROM embeddings LEFT JOIN low ON x = vec_id"""


def _licenses_sql() -> str:
    """Exact containment in every window; what the bands retrieve, without them."""
    rows = ", ".join("('{}', {}, {})".format(name, licenses.size_class(t), licenses._shingles(licenses._words(t)))
                     for name, t in licenses.TEMPLATES.items())
    return f"""
WITH t AS (SELECT * FROM (VALUES {rows}) AS x(license, size, parts)),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM documents),
s AS (SELECT doc_id, len(words) AS n, [array_to_string(words[i:i + 4], ' ') FOR i IN range(1, len(words) - 3)] AS has
      FROM w WHERE len(words) >= 5),
p AS (SELECT doc_id, license, first,
             len(list_intersect(list_distinct(has[first + 1:first + 2 * size]), parts)) / len(parts) AS share
      FROM s, t, unnest(range(0, n - 4, size)) AS u(first))
SELECT doc_id, license, MAX(share) AS containment, COUNT(*) AS n_windows, MIN(first) AS first_word
FROM p WHERE share >= {licenses.CONTAINMENT} GROUP BY doc_id, license"""


def _clusters_sql() -> str:
    """Each round written out; sums and floors in whole numbers."""
    gap = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(x.v, c.v)])"
    steps = [f"""
kept AS MATERIALIZED (
  SELECT vec_id, [CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len([e FOR e IN embedding IF e IS NOT NULL AND isfinite(e)]) = {DIMENSIONS}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, v FROM kept
  QUALIFY c < {CENTROIDS})"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, x.v AS v, c, CAST({gap} AS BIGINT) AS d FROM kept x, c{r} c
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)""")
        if r < ROUNDS:
            steps.append(f"""
s{r} AS MATERIALIZED (
  SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, unnest(range(1, {DIMENSIONS + 1})) AS u(i) GROUP BY c, i),
m{r} AS MATERIALIZED (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN m{r} m USING (c))""")
    return "WITH " + ",".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(o.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} o USING (c)"""


def _manifest_sql() -> str:
    """Both trees level by level; a path as texts of a side and a digest, folded by list_reduce."""
    def text(c: str) -> str:
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(changed: str = "n_chars") -> str:
        return "sha256(" + " || ".join(text(changed if c == "n_chars" else c) for c in LEAF_COLUMNS) + ")"

    def tree(name: str, base: str) -> str:
        return f"""
{name} AS (
  SELECT t, 0 AS up, pos, n, h FROM {base}
  UNION ALL
  SELECT l.t, l.up + 1, l.pos // 2, (l.n + 1) // 2, sha256(l.h || coalesce(r.h, ''))
  FROM {name} l LEFT JOIN {name} r ON r.t = l.t AND r.pos = l.pos + 1 WHERE l.pos % 2 = 0 AND l.n > 1),
{name}_paths AS (
  SELECT b.t, b.pos, list(CASE WHEN s.h IS NULL THEN '0' WHEN s.pos % 2 = 0 THEN '<' || s.h ELSE '>' || s.h END ORDER BY o.up) AS steps
  FROM {base} b JOIN {name} o ON o.t = b.t AND o.pos = b.pos >> o.up AND o.n > 1
  LEFT JOIN {name} s ON s.t = o.t AND s.up = o.up AND s.pos = xor(o.pos, 1) GROUP BY b.t, b.pos)"""

    crc = ("xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), "
           "lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), "
           "lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)")
    return f"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, coalesce('=' || lang, '') AS t, {leaf()} AS h, CASE WHEN {crc} % 7 = 0 THEN {leaf('(n_chars + 1)')} END AS other FROM documents),
leaves AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY t) AS n FROM docs),
{tree('lower_tree', 'leaves')},
tops AS MATERIALIZED (
  SELECT '' AS t, t AS name, h, row_number() OVER (ORDER BY encode(t)) - 1 AS pos, count(*) OVER () AS n FROM lower_tree WHERE n = 1),
{tree('upper_tree', 'tops')},
whole AS MATERIALIZED (
  SELECT l.doc_id, l.h, l.other, p.h AS subroot, (SELECT h FROM upper_tree WHERE n = 1) AS root,
         list_concat(coalesce(a.steps, []), coalesce(b.steps, [])) AS steps
  FROM leaves l JOIN tops p ON p.name = l.t LEFT JOIN lower_tree_paths a ON a.t = l.t AND a.pos = l.pos
  LEFT JOIN upper_tree_paths b ON b.pos = p.pos),
folded AS (
  SELECT *, list_reduce(list_prepend(coalesce(other, h), steps), lambda x, s:
    CASE s[1] WHEN '<' THEN sha256(s[2:] || x) WHEN '>' THEN sha256(x || s[2:]) ELSE sha256(x) END) AS folded_root FROM whole)
SELECT doc_id, h AS leaf, subroot, root, sha256(array_to_string([s[2:] FOR s IN steps], '')) AS proof_sha256, folded_root,
       folded_root = root AS verified FROM folded"""


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL can express; hashes, tokenizers and models leave out the others."""
    return {"op3_substring_dedup": SUBSTRINGS_SQL, "op4_embedding_dedup": EMBEDDINGS_SQL, "op9_license_scan": _licenses_sql(),
            "op12_centroid_clusters": _clusters_sql(), "op13_merkle_manifest": _manifest_sql()}
