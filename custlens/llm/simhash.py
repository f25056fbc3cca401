"""Operator 8: SimHash near-duplicates by deletion-variant signatures.

Fingerprints of 64 bits link at ``max_bits`` or fewer differing bits. A fingerprint
is cut into ``max_bits // 2 + 1`` segments (2 at least): of two linked ones, some segment
differs by at most one bit. Each segment is indexed once per bit position with
that bit wild; equal variants meet in an equality join, and their whole
fingerprints are compared. Only connectivity is wanted, so a group never emits its pairs, only
the links that join parts not joined yet.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import (
    Forest, connected_components, in_arrow, map_batches, shuffle_partitions, whole_groups, written,
)

_CHUNK = 1 << 16


def fingerprint(text: str | None, words: int = 4) -> int:
    """Signed 64-bit SimHash of the shingles of ``words`` words; 0 without any word."""
    w = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII blanks only
    if not w:
        return 0
    line, n = memoryview(b" ".join(w)), max(1, len(w) - words + 1)
    ends = list(accumulate(len(x) + 1 for x in w))
    starts = [0, *ends[:n - 1]]
    stops = [e - 1 for e in ends[words - 1:]] or [len(line)]
    count, h64 = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, _CHUNK):
        h = np.array([h64(line[a:b], 42) for a, b in zip(starts[k:k + _CHUNK], stops[k:k + _CHUNK])], np.uint64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 4, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, text_hash, fp long) of every row; ``text_hash`` is the xxhash64 of the text."""

    def run(b: pa.RecordBatch):
        fps = [fingerprint(t, words) for t in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], [key, "text_hash", "fp"])

    rows = docs.select(F.col(key).cast("long").alias(key), F.xxhash64(text).alias("text_hash"), F.col(text).alias("__text"))
    return in_arrow(rows, run, f"`{key}` long, text_hash long, fp long")


def variants(fps: DataFrame, max_bits: int) -> DataFrame:
    """(variant, fp): each fingerprint's segments, once per bit with that bit wild."""
    n = max(2, max_bits // 2 + 1)
    cuts = [64 * i // n for i in range(n + 1)]
    rows = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    first: Column = F.lit(cuts[n - 1])
    width: Column = F.lit(64 - cuts[n - 1])
    for i in range(n - 2, -1, -1):
        first = F.when(F.col("bit") < cuts[i + 1], cuts[i]).otherwise(first)
        width = F.when(F.col("bit") < cuts[i + 1], cuts[i + 1] - cuts[i]).otherwise(width)
    rows = rows.select("fp", "bit", first.cast("int").alias("first"), width.cast("int").alias("width"))
    return rows.select(F.expr(
        "(shiftrightunsigned(fp & ~shiftleft(1L, bit), first) & (shiftleft(1L, width) - 1))").alias("part"), "bit", "fp")


def _links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, least=200_000):
            key = t.column(0).to_numpy()
            one = np.concatenate([[False], key[1:] == key[:-1]])
            one |= np.append(one[1:], False)  # in a group of two or more
            key, fp = key[one], t.column(1).to_numpy()[one].view(np.uint64)
            nodes, at = np.unique(fp, return_inverse=True)
            label, forest = np.arange(len(nodes)), Forest()
            made: list[tuple[int, int]] = []
            _, group, size = np.unique(key, return_inverse=True, return_counts=True)
            i, d = np.arange(len(key)), 0
            while len(i):
                d += 1
                i = i[(i + d < len(key))]
                i = i[group[i] == group[i + d]]
                if d & (d - 1) == 0 and len(i):  # now and then leave out groups that are one part already
                    low, high = np.full(len(size), len(nodes)), np.full(len(size), -1)
                    np.minimum.at(low, group, label[at])
                    np.maximum.at(high, group, label[at])
                    i = i[(low != high)[group[i]]]
                a, b = at[i], at[i + d]
                apart = label[a] != label[b]
                a, b = a[apart], b[apart]
                near = np.bitwise_count(nodes[a] ^ nodes[b]) <= max_bits
                new = [(x, y) for x, y in zip(a[near].tolist(), b[near].tolist()) if forest.join(x, y)]
                if new:
                    made += new
                    seen = np.array(list(forest.parent))
                    label[seen] = [forest.root(x) for x in seen.tolist()]
                    label = label[label]
            ids = nodes.view(np.int64)
            pairs = np.array(made, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], ["a", "b"])

    return run


def _grouped(docs: DataFrame, words: int, max_bits: int, text: str, key: str) -> DataFrame:
    """(fp, key, text_hash, component, component_id) of every row; component is a fingerprint of its group, the same for all."""
    fps = written(fingerprints(docs, words, text, key), "fingerprints")
    each = written(fps.groupBy("fp").agg(F.min(key).alias("low")), "distinct-fingerprints")
    keyed = variants(each.select("fp"), max_bits).select(F.xxhash64("bit", "part").alias("variant"), "fp")
    keyed = keyed.repartition(shuffle_partitions(docs.sparkSession), "variant").sortWithinPartitions("variant")
    links = map_batches(keyed, _links(max_bits), "a long, b long")
    parts = connected_components(links)
    linked = each.join(parts, each["fp"] == parts["node"]).select("fp", "component", "low")
    lowest = linked.groupBy("component").agg(F.min("low").alias("component_id"))
    linked = linked.join(lowest, "component").select("fp", "component", "component_id")
    named = each.join(linked, "fp", "left").select(
        "fp", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "low").alias("component_id"))
    return fps.join(written(named, "components"), "fp")


def near_duplicates(docs: DataFrame, words: int = 4, max_bits: int = 4, text: str = "text",
                    key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component_id) of every row of ``docs``; component_id is the smallest key reachable.

    Equal fingerprints are collapsed before anything is paired, so copies cost
    one row; texts without words have fingerprint 0 and link like any other. Rows
    with a null key link too but never name a component that has a key;
    repeated rows stay. Other columns are ignored.
    """
    return _grouped(docs, words, max_bits, text, key).select(
        key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, words: int = 4, max_bits: int = 4, text: str = "text",
                      key: str = "doc_id") -> DataFrame:
    """One row of each component, columns unchanged: of the rows whose key names it, one of the smallest text hash.

    A row without a key stays only if its component has no key at all. Which of several rows of equal key and text
    stays is open.
    """
    rows = _grouped(docs, words, max_bits, text, key).where(F.col(key).eqNullSafe(F.col("component_id")))
    rows = rows.groupBy("component", "text_hash").agg(F.min(key).alias("__kept"), F.count("*").alias("n"))
    kept = rows.groupBy("component").agg(F.min(F.struct("text_hash", "__kept", "n")).alias("m")).select("m.*")
    kept = written(kept, "kept")

    def among(some: DataFrame) -> DataFrame:
        same = docs[key].cast("long").eqNullSafe(some["__kept"]) & (F.xxhash64(docs[text]) == some["text_hash"])
        return docs.join(some, same, "left_semi")

    repeated = kept.where("n > 1")
    if repeated.isEmpty():
        return among(kept)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    once = among(repeated).select(F.col(key).cast("long").alias("k"), F.xxhash64(text).alias("h"), row)
    once = once.groupBy("k", "h").agg(F.first("row").alias("row")).select("row.*")
    return among(kept.where("n = 1")).union(once)
