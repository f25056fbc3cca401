"""Substring, SimHash and embedding duplicates against brute force."""

import hashlib
import re

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from custlens.llm import common, embeddings, queries, simhash, substrings

from .conftest import SF, SF_CHECK

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


# ---------------------------------------------------------------- substrings

def brute_repeats(rows, span):
    """rows: (key, text). A run counts if it starts at a smaller (key, word) anywhere; rows of one key are one document."""
    first, words = {}, [WORD.findall(t or "") for _, t in rows]
    low = [-1 if k is None else k for k, _ in rows]
    for k, w in zip(low, words):
        for i in range(len(w) - span + 1):
            r = tuple(w[i:i + span])
            first[r] = min(first.get(r, (k, i)), (k, i))
    hit = {}
    for k, w in zip(low, words):
        hit.setdefault(k, set()).update(i for i in range(len(w) - span + 1) if first[tuple(w[i:i + span])] < (k, i))
    out = []
    for (key, _), k, w in zip(rows, low, words):
        cover = {j for i in hit[k] if i + span <= len(w) for j in range(i, i + span)}
        kept = " ".join(x for j, x in enumerate(w) if j not in cover)
        out.append((key, len(w), len(cover), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("span", [20, 4, 7])
def test_substrings_of_odd_rows(odd_docs, no_docs, span):
    want = brute_repeats([(r.doc_id, r.text) for r in odd_docs.collect()], span)
    assert sorted(repr(tuple(r)) for r in substrings.digest(odd_docs, span).collect()) == want
    assert substrings.digest(no_docs, span).collect() == []


@pytest.mark.parametrize("block,least", [(300, 64), (1 << 20, 0)])
def test_substrings_over_many_blocks_and_frequent_phrases(spark, monkeypatch, block, least):
    rng = np.random.default_rng(3)
    line = "one very common line of nine words in all"
    texts = []
    for i in range(300):
        w = [f"w{x}" for x in rng.integers(0, 400, rng.integers(0, 120))]
        at = int(rng.integers(0, len(w) + 1))
        texts.append((int(rng.integers(0, 10_000)), " ".join(w[:at] + line.split() + w[at:])))
        if i % 5 == 0 and len(w) > 30:
            texts.append((int(rng.integers(0, 10_000)), " ".join(w[3:40] + texts[-2][1].split()[:25] if len(texts) > 2 else w)))
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    monkeypatch.setattr(substrings, "PROBE", 1)
    if not least:
        monkeypatch.setattr(substrings, "shuffle_partitions", lambda s: 400)  # makes the line's phrases frequent
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert sorted(repr(tuple(r)) for r in substrings.digest(docs, 20).collect()) == brute_repeats(texts, 20)


def test_substring_query(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF_CHECK}/documents.parquet'").fetchall()
    assert sorted(repr(tuple(r)) for r in queries.op3_substring_dedup(spark, SF_CHECK).collect()) == brute_repeats(rows, 20)


# ---------------------------------------------------------------- SimHash

def brute_fingerprint(text, k=4):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(text)
    sh = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_simhash(rows, bits=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    f = np.array(fps, np.uint64)
    part = groups(len(fps), ((i, int(j)) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= bits)))
    low = {}
    for p, (k, _) in zip(part, rows):
        low[p] = min([x for x in (k, low.get(p)) if x is not None], default=None)
    return sorted(repr((k, f"{x:016x}", low[p])) for p, (k, _), x in zip(part, rows, fps))


def test_simhash_of_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text if r.text is None or len(r.text) < 40_000 else r.text) for r in odd_docs.collect()]
    assert sorted(repr(tuple(r)) for r in simhash.near_duplicates(odd_docs).collect()) == brute_simhash(rows)
    assert simhash.near_duplicates(no_docs).collect() == []
    kept = simhash.one_of_each_group(odd_docs)
    assert kept.columns == odd_docs.columns
    component = {k: c for k, _, c in map(eval, brute_simhash(rows))}
    assert {r.doc_id for r in kept.collect()} == {k for k, c in component.items() if k == c}


def test_one_row_of_each_group(spark, odd_docs):
    """Repeated rows, several texts under one key, and rows without a key: of each component exactly one row stays."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(5, a, "x"), (5, b, "x"), (3, b, "x"), (None, b, "x"), (None, c, "x"), (None, c, "y"), (None, a, "x"), (2, None, "x"),
            *[(9, d, f"s{i % 3}") for i in range(50)], (None, d, "x"), (None, d + " more", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").repartition(3)
    kept = simhash.one_of_each_group(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, a), (3, b), (None, c), (2, None), (9, d)], key=str)
    rows = odd_docs.collect()
    f = np.array([brute_fingerprint(r.text) for r in rows], np.uint64)
    part = groups(len(f), ((i, int(j)) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 4)))
    assert simhash.one_of_each_group(odd_docs).count() == len(set(part))


@pytest.mark.parametrize("bits", [0, 1, 4, 6])
def test_links_of_fingerprints(spark, bits):
    """Every pair within the distance ends in one part, also in a crowd around one fingerprint, and no other."""
    rng = np.random.default_rng(bits)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 300)] + [0, (1 << 64) - 1]
    for x in list(fps[:60]) + [fps[0]] * 200:
        for b in rng.choice(64, rng.integers(1, bits + 3), replace=False):
            x ^= 1 << int(b)
        fps.append(x)
    f = np.unique(np.array(fps, np.uint64))
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fp long")
    v = simhash.variants(df, bits).select(F.xxhash64("bit", "part").alias("variant"), "fp")
    links = v.repartition(3, "variant").sortWithinPartitions("variant").mapInArrow(simhash._links(bits), "a long, b long")
    got = {r.node: r.component for r in common.connected_components(links).collect()}
    part = groups(len(f), ((i, int(j)) for i in range(len(f)) for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= bits)))
    ids = f.view(np.int64).tolist()
    mine = groups(len(f), ((ids.index(a), ids.index(c)) for a, c in got.items()))
    assert mine == part


def test_simhash_query(spark):
    rows = duckdb.sql(f"select doc_id, text from '{SF_CHECK}/documents.parquet'").fetchall()
    assert sorted(repr(tuple(r)) for r in queries.op8_simhash_dedup(spark, SF_CHECK).collect()) == brute_simhash(rows)


def test_components_of_a_long_chain(spark):
    n = 500
    edges = spark.createDataFrame([((i * 7919) % n, ((i + 1) * 7919) % n) for i in range(n - 1)] + [(1000, 1001), (5, 5)],
                                  "a long, b long").repartition(6)
    got = {r.node: r.component for r in common.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}
    assert common.connected_components(edges.limit(0)).collect() == []


# ---------------------------------------------------------------- embeddings

def brute_embeddings(rows, cosine=0.98):
    ok = [v is not None and len(v) > 0 and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
          for _, v, l in rows]
    u = [np.array(v, float) / np.abs(v).max() if k else None for (_, v, _), k in zip(rows, ok)]
    u = [x / np.sqrt(x @ x) if x is not None else None for x in u]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and rows[i][2] == rows[j][2]
             and len(u[i]) == len(u[j]) and u[i] @ u[j] >= cosine]
    n = [0] * len(rows)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    part, low = groups(len(rows), links), {}
    for p, r in zip(part, rows):
        low[p] = min([x for x in (r[0], low.get(p)) if x is not None], default=None)
    return sorted(repr((r[0], k, low[p], r[0] == low[p])) for r, k, p in zip(rows, n, part))


def vectors_with_clusters(seed=0, n=600, d=16):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        v = rng.normal(size=d)
        if out and i % 3:
            v = np.array(out[rng.integers(len(out))][1]) + rng.normal(size=d) * rng.choice([0, 0.02, 0.05, 0.1])
        out.append((i, [float(np.float32(x)) for x in v * rng.choice([1, 3])], int(rng.integers(0, 2))))
    return out


ODD = [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 16, 0), (1003, [1.0, None] * 8, 0), (1004, [float("nan")] * 16, 0),
       (1005, [float("inf")] * 16, 0), (1006, [1.0] * 16, None), (1007, [1.0] * 16, 0), (1007, [1.0] * 16, 0),
       (None, [1.0] * 16, 0), (1009, [2.0] * 16, 0), (1010, [1.0, 1.0], 0), (None, None, None), (1012, [1.0] * 16, 1),
       (1013, [1e30] * 16, 1), (1014, [1e-30] * 16, 1), (None, [-1.0] * 16, 7)]


def test_embeddings_of_odd_rows(spark, monkeypatch):
    rows = vectors_with_clusters() + ODD
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for c in ("id", "v", "cid", "low", "links", "block", "c0", "x"):
        df = df.withColumn(c, F.lit(1))
    rows = [(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], l) for k, v, l in rows]
    want = brute_embeddings(rows)
    assert sorted(repr(tuple(r)) for r in embeddings.near_duplicates(df).collect()) == want
    assert embeddings.near_duplicates(df.limit(0)).collect() == []
    monkeypatch.setattr(embeddings, "BLOCK", 40)  # many blocks, deep recursion
    monkeypatch.setattr(embeddings, "LEAF", 4)
    assert sorted(repr(tuple(r)) for r in embeddings.near_duplicates(df).collect()) == want


def test_embedding_query(spark):
    rows = duckdb.sql(f"select vec_id, embedding, label from '{SF}/embeddings.parquet'").fetchall()
    assert sorted(repr(tuple(r)) for r in queries.op4_embedding_dedup(spark, SF).collect()) == brute_embeddings(rows)
