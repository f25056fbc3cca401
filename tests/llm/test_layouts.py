"""Resharding, centroid clusters and the Merkle manifest against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from custlens.llm import centroids, merkle, queries, sharding

from .conftest import SF


# ------------------------------------------------------------------ resharding

def least_cost(supply, capacity, cost):
    """Cheapest of all ways to deal whole units, one source unit after the other."""
    units = [i for i, n in enumerate(supply) for _ in range(n)]
    ways = {tuple(capacity): 0}
    for i in units:
        new = {}
        for room, spent in ways.items():
            for j, r in enumerate(room):
                if r:
                    left = room[:j] + (r - 1,) + room[j + 1:]
                    new[left] = min(new.get(left, 1 << 60), spent + cost[i][j])
        ways = new
    return min(ways.values())


def test_flow_is_a_cheapest_one():
    rng = np.random.default_rng(1)
    for _ in range(60):
        s, t = rng.integers(1, 4, 2)
        supply = rng.integers(0, 5, s).tolist()
        capacity = rng.integers(0, 5, t).tolist()
        capacity[0] += max(0, sum(supply) - sum(capacity))
        cost = rng.integers(0, 6, (s, t)).tolist()
        flow = sharding.min_cost_flow(supply, capacity, cost)
        assert all(v > 0 for v in flow.values())
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(s)] == supply
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= capacity[k] for k in range(t))
        assert sum(v * cost[i][j] for (i, j), v in flow.items()) == least_cost(supply, capacity, cost)


def test_flow_with_unit_costs_moves_the_surplus_only():
    rng = np.random.default_rng(2)
    supply = rng.integers(0, 10**12, 40).tolist()
    capacity = sharding.even_capacities(sum(supply), 55)
    flow = sharding.min_cost_flow(supply, capacity, [[int(i != j) for j in range(55)] for i in range(40)])
    assert sum(v for (i, j), v in flow.items() if i != j) == sum(max(0, a - b) for a, b in zip(supply, capacity))
    with pytest.raises(ValueError):
        sharding.min_cost_flow([5], [4], [[0]])


def shards_of(layout):
    out = defaultdict(list)
    for r in sharding.read_layout(layout).select("shard", "slot", "size", "row.doc_id", "row.text").collect():
        out[r.shard].append((r.slot, r.size, r.doc_id, r.text))
    return {k: sorted(v, key=lambda x: x[0]) for k, v in out.items()}


def test_layout_survives_reshards(spark):
    """Rows are the same after growing and shrinking; slots have no gaps; sizes follow the capacities; what stays is not rewritten."""
    rng = np.random.default_rng(5)
    texts = [(i, "x" * int(n)) for i, n in enumerate(rng.integers(0, 60, 3000))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    layout = sharding.write_layout(docs, F.when(F.col("doc_id") % 2 == 0, 0).otherwise(F.col("doc_id") % 3), 3, "doc_id")
    first = shards_of(layout)
    assert all([d for _, _, d, _ in rows] == sorted(d for _, _, d, _ in rows) for rows in first.values())
    for shards in (5, 8, 2):
        old = {k: [r[2] for r in v] for k, v in shards_of(layout).items()}
        layout2, transfers = sharding.reshard(layout, shards=shards)
        new = shards_of(layout2)
        assert Counter((d, t) for v in new.values() for _, _, d, t in v) == Counter(texts)
        total = sum(len(t) + 1 for _, t in texts)
        for k in range(shards):
            assert [s for s, *_ in new[k]] == list(range(len(new[k])))
            assert abs(sum(z for _, z, _, _ in new[k]) - total / shards) <= 60 * (len(old) + 1)
        moved = sum(r.bytes for r in transfers.collect() if r.old != r.new)
        sizes = [sum(len(texts[d][1]) + 1 for d in old.get(i, [])) for i in range(layout.shards)]
        least = sum(max(0, z - (total // shards if i < shards else 0)) for i, z in enumerate(sizes))
        assert abs(moved - least) <= 61 * layout.shards * shards
        for k in range(min(shards, layout.shards)):  # a shard that only grows keeps its rows in place
            if sizes[k] <= total // shards:
                assert [d for _, _, d, _ in new[k]][:len(old[k])] == old[k]
        kept = {tuple(r) for r in layout.files.select("folder", "shard", "file").collect()}
        now = {tuple(r) for r in layout2.files.select("folder", "shard", "file").collect()}
        assert kept & now or shards == 2
        layout = layout2


def test_reshard_of_odd_rows(spark, odd_docs, no_docs):
    layout, transfers = sharding.reshard(sharding.write_layout(odd_docs, F.pmod(F.hash("doc_id"), F.lit(4)), 4, "doc_id"), shards=3)
    rows = sharding.read_layout(layout).select("row.*").collect()
    assert Counter(map(str, rows)) == Counter(map(str, odd_docs.collect()))
    assert sum(r.rows for r in transfers.collect()) == len(rows)
    by = defaultdict(list)
    for r in sharding.read_layout(layout).collect():
        by[r.shard].append(r.slot)
        assert r.size == len((r.row.text or "").encode()) + 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    empty, none = sharding.reshard(sharding.write_layout(no_docs, F.lit(0), 2, "doc_id"), shards=3)
    assert sharding.read_layout(empty).collect() == [] and none.collect() == []


def test_one_key_on_all_rows(spark):
    docs = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    layout, _ = sharding.reshard(sharding.write_layout(docs, F.lit(1), 2, "doc_id"), [0, 0, 10_000, 10_000])
    assert {k: len(v) for k, v in shards_of(layout).items()} == {2: 1000, 3: 1000}


def test_reshard_query(spark):
    docs = dict(duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall())
    rows = queries.op11_reshard(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    by = defaultdict(list)
    for r in rows:
        text = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "bytes", None)
        by[r.shard].append(r)
    assert sorted(by) == list(range(16)) and all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    sizes = [sum(r.size for r in v) for v in by.values()]
    assert max(sizes) - min(sizes) <= max(r.size for r in rows)


# -------------------------------------------------------------- centroid clusters

def brute_clusters(vectors, k, rounds, dims, scale=256):
    kept = []
    for i, v in vectors:
        if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(scale * x)) for x in v]))
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    points = [v for _, v in seeds[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points))

    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        points = [[sum(x) // len(own[c]) for x in zip(*own[c])] if own[c] else p for c, p in enumerate(points)]
    last = [(i, *nearest(v)) for i, v in kept]
    each = Counter()
    for _, d, c in last:
        each[c] += d
    total = sum(each.values())
    return sorted(map(repr, ((i, c, d, each[c], total, points[c]) for i, d, c in last)))


def found_clusters(df, *args):
    return sorted(repr(tuple(r)) for r in centroids.clusters(df, *args).collect())


def test_tree_search_is_exact():
    rng = np.random.default_rng(3)
    for k, dims, spread in ((1, 3, 5), (5, 2, 3), (40, 4, 6), (200, 3, 4), (300, 16, 1000), (33, 8, centroids.LIMIT)):
        points = rng.integers(-spread, spread + 1, (k, dims))  # small spreads give many ties and equal centroids
        x = np.concatenate([rng.integers(-spread, spread + 1, (400, dims)), points])
        who, d = centroids.VantageTree.build(points).nearest(x)
        gaps = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
        assert (who == gaps.argmin(axis=1)).all() and (d == gaps.min(axis=1)).all()


def test_tree_search_skips_far_centroids(monkeypatch):
    rng = np.random.default_rng(4)
    points = rng.integers(0, 10**6, (512, 2))
    tree = centroids.VantageTree.build(points)
    seen, plain = [], centroids.squared
    monkeypatch.setattr(centroids, "squared", lambda a, b: (seen.append(len(a)), plain(a, b))[1])
    tree.nearest(rng.integers(0, 10**6, (1000, 2)))
    assert sum(seen) < 1000 * 512 / 5


@pytest.mark.parametrize("k,rounds", [(4, 3), (50, 2), (1, 1), (7, 0)])
def test_clusters_of_odd_rows(spark, k, rounds):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-8, 9, 3).astype(float).tolist(), "x") for i in range(30)]
    rows += [(0, rows[0][1], "x"), (40, rows[3][1], None), (None, [0.1, -0.1, 0.0], "x"), (41, None, "x"), (42, [], "x"),
             (43, [1.0, None, 2.0], "x"), (44, [1.0, float("nan"), 2.0], "x"), (45, [1.0, float("inf"), 2.0], "x"), (46, [1.0, 2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string").withColumn("v", F.lit(1)).withColumn("cluster", F.lit("z"))
    assert found_clusters(df, k, rounds, 3) == brute_clusters([r[:2] for r in rows], k, rounds, 3)
    assert found_clusters(df.limit(0), k, rounds, 3) == []


def test_too_large_components_are_an_error(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        centroids.clusters(df, 1, 1, 2).collect()


def test_cluster_query_against_brute_force(spark):
    vectors = duckdb.sql(f"select vec_id, embedding from '{SF}/embeddings.parquet'").fetchall()
    want = sorted(repr((i, c, d, e, t, centroids.centroid_digest(p)))
                  for i, c, d, e, t, p in map(eval, brute_clusters(vectors, 40, 5, 64)))
    assert sorted(repr(tuple(r)) for r in queries.op12_centroid_clusters(spark, SF).collect()) == want


# ---------------------------------------------------------------------- manifest

def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(nodes, arity):
    """(root, path of each node as [(place, others)])."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = nodes[p - p % arity:p - p % arity + arity]
            paths[i].append((p % arity, run[:p % arity] + run[p % arity + 1:]))
        nodes, at = [h(*nodes[i:i + arity]) for i in range(0, len(nodes), arity)], [p // arity for p in at]
    return nodes[0], paths


def brute_manifest(rows, arity):
    trees = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
        trees[lang].append((doc_id, brute_leaf(doc_id, source, lang, n_chars, text),
                            brute_leaf(doc_id, source, lang, n_chars + 1, text) if hit else None))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    lower = {}
    for x in langs:
        trees[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        lower[x] = brute_tree([r[1] for r in trees[x]], arity)
    root, upper = brute_tree([lower[x][0] for x in langs], arity)
    out = []
    for x, up in zip(langs, upper):
        for (doc_id, leaf, other), path in zip(trees[x], lower[x][1]):
            node = other or leaf
            for place, others in path + up:
                node = h(*others[:place], node, *others[place:])
            out.append((doc_id, leaf, lower[x][0], root, h(*(o for _, others in path + up for o in others)), node, node == root))
    return sorted(map(repr, out))


def found_manifest(docs, arity=2, levels=10):
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    rows = merkle.manifest(docs, queries.LEAF_COLUMNS, "doc_id", "lang", {"n_chars": F.col("n_chars") + 1}, tampered, arity, levels)
    return sorted(repr((*r[:4], h(r.proof), r.folded_root, r.verified)) for r in rows.collect())


@pytest.mark.parametrize("arity,levels", [(2, 10), (2, 1), (3, 2)])
def test_manifest_of_odd_rows(odd_docs, no_docs, arity, levels):
    rows = [tuple(r[:5]) for r in odd_docs.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert found_manifest(odd_docs, arity, levels) == brute_manifest(rows, arity)
    assert found_manifest(no_docs, arity, levels) == []


@pytest.mark.parametrize("arity,levels,n,langs", [(2, 2, 70, 9), (2, 3, 65, 1), (4, 1, 130, 3), (2, 1, 1, 1), (2, 10, 40, 40)])
def test_manifest_over_many_cuts(spark, arity, levels, n, langs):
    """Trees of several superblocks and cuts, also one row beyond a whole number of them."""
    rows = [(i * 7919 % 1009, f"text {i}", f"l{i % langs}" if i % langs else None, "s", i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert found_manifest(docs, arity, levels) == brute_manifest(rows, arity)


def test_one_row_repeated(spark):
    rows = [(14, "t", "en", "s", 3)] * 300 + [(2**60 + 1, "u", "en", None, None), (2**60 + 3, "u", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert found_manifest(docs, 2, 4) == brute_manifest(rows, 2)


def test_changed_siblings_do_not_fold_to_the_root():
    nodes = [h(str(i)) for i in range(13)]
    heights = merkle.reduced(nodes, 2, merkle.levels_of(13, 2, 99))
    for i, p in enumerate(merkle.paths(heights, 2)):
        assert merkle.fold(nodes[i], p) == heights[-1][0]
        assert merkle.fold(nodes[i - 1], p) != heights[-1][0]
        at = 0
        while at < len(p):  # an entry is two characters and, where the run has another node, its digest
            if p[at + 1] == "2":
                other = p[:at + 2] + ("1" if p[at + 2] == "0" else "0") + p[at + 3:]
                assert merkle.fold(nodes[i], other) != heights[-1][0]
            at += 66 if p[at + 1] == "2" else 2
