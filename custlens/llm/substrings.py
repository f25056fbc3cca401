"""Operator 3: substring dedup by relative Lempel-Ziv parsing.

A factor is a run of words that also starts earlier in the corpus; only factors of at
least ``span`` words count. Texts are read in blocks. Each block is a reference: its
index holds the fingerprint of every run of ``span`` words with its earliest start, and
the block's documents are factored against it first. What the block knows to be
earlier is settled there; of each other run only its first start goes on, to the
indices of all other blocks. Those are dealt out by content: a run belongs to the
smallest hashed phrase (of ``PHRASE`` words) inside it, so equal runs meet, runs
that share the phrase travel as one row, and a text is compared with exactly the reference
blocks that can match it. Phrases so frequent that they would fill a task
are replaced by the runs' own fingerprints as the place to meet.
Runs that straddle two factors are looked up like all others, so
what is removed does not depend on where the greedy parse breaks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import NULL_ID, WORD, in_arrow, map_batches, shuffle_partitions, whole_groups, written
from custlens.llm.words import M, mix, runs, word_hashes

#: Words of a phrase, bytes of text in a reference block.
PHRASE, BLOCK_BYTES = 4, 4 << 20
#: One of so many documents is counted to find phrases too frequent for one task. Steers where rows meet, not what is found.
PROBE = 16

_WORDS = re.compile(WORD)


def _anchors(phrase: np.ndarray, per_run: int) -> np.ndarray:
    """Position of the smallest phrase (the first of equals) of each run of ``per_run`` phrases."""
    # minima over windows, by doubling; positions travel along
    value, at, size = mix(phrase ^ M[1]), np.arange(len(phrase)), 1
    while size < per_run:
        step = min(size, per_run - size)
        a, b = slice(0, len(value) - step), slice(step, None)
        right = value[b] < value[a]
        value, at = np.where(right, value[b], value[a]), np.where(right, at[b], at[a])
        size += step
    return at


class _Block:
    """A reference block: its documents' words, runs and phrases."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], span: int) -> None:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum([len(t) for t in texts])
        h, text, _, _ = word_hashes(raw, ends)
        self.phrase = runs(h, PHRASE)
        n = max(0, len(h) - span + 1)
        self.ok = text[:n] == text[len(text) - n:]
        self.run = runs(h, span)[:n] if n else h[:0]
        self.anchor = _anchors(self.phrase, span - PHRASE + 1)[:n] if n else np.zeros(0, np.int64)
        self.text = text[:n]
        self.pos = np.arange(n) - np.searchsorted(text, self.text)
        self.id = ids

    def known(self) -> np.ndarray:
        """Which runs start earlier in this block itself."""
        at = np.flatnonzero(self.ok)
        out = np.zeros(len(self.ok), bool)
        if len(at):
            order = np.argsort(self.run[at], kind="stable")
            at = at[order]
            run = self.run[at]
            head = np.flatnonzero(np.append(True, run[1:] != run[:-1]))
            place = np.unique(self.id, return_inverse=True)[1][self.text[at]] << 32 | self.pos[at]
            least = np.repeat(np.minimum.reduceat(place, head), np.diff(np.append(head, len(at))))
            out[at] = place > least
        return out

    def rows(self, frequent: np.ndarray) -> pa.RecordBatch:
        """One row for the runs that share a phrase: its key, their first start, which are known to be earlier and which
        are asked for (bits by start), and 48 bits of each of the latter."""
        known = self.known()
        at = np.flatnonzero(self.ok)
        key = self.phrase[self.anchor[at]]
        alone = np.isin(key, frequent)
        key = np.where(alone, mix(self.run[at] ^ M[3]), key)
        new = np.ones(len(at), bool)
        new[1:] = (self.anchor[at[1:]] != self.anchor[at[:-1]]) | (self.text[at[1:]] != self.text[at[:-1]]) | alone[1:]
        head = np.flatnonzero(new)
        bit = np.int64(1) << (at - np.repeat(at[head], np.diff(np.append(head, len(at)))))
        ask = ~known[at]
        total = lambda x: np.add.reduceat(x, head) if len(head) else x[:0]
        asked = np.ascontiguousarray(self.run[at[ask]]).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()
        offsets = np.append(0, np.cumsum(6 * total(ask.astype(np.int64)))).astype(np.int32)
        first = at[head]
        want = total(np.where(ask, bit, 0))
        # rows that ask for nothing only pass through, so they are spread
        key = np.where(want == 0, mix(first.astype(np.uint64) ^ self.run[first]), key[head])
        return pa.RecordBatch.from_arrays(
            [pa.array(key.view(np.int64)), pa.array(self.id[self.text[first]]), pa.array(self.pos[first].astype(np.int32)),
             pa.array(want.astype(np.int32)), pa.array(total(np.where(ask, 0, bit)).astype(np.int32)),
             pa.BinaryArray.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(offsets), pa.py_buffer(asked)])],
            ["key", "id", "pos", "want", "known", "runs"])


def _blocks(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[_Block]:
    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            ids.append(i)
            texts.append(t or b"")
            size += len(texts[-1])
            if size >= BLOCK_BYTES:
                yield _Block(np.array(ids, np.int64), texts, span)
                ids, texts, size = [], [], 0
    if ids:
        yield _Block(np.array(ids, np.int64), texts, span)


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, pos, starts): the runs that start earlier anywhere, as bits from ``pos`` on, of rows that met by key."""
    for t in whole_groups(batches, least=100_000):
        key, ids, pos, want, known = (t.column(i).to_numpy() for i in range(5))
        row, bit = np.nonzero(np.unpackbits(want.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little"))
        part = np.zeros((len(row), 8), np.uint8)
        part[:, :6] = np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint8).reshape(-1, 6)
        run = mix(part.view("<u8")[:, 0].astype(np.uint64) * M[2] + key.view(np.uint64)[row])
        order = np.argsort(run)
        same = run[order][1:] == run[order][:-1]
        shared = np.append(same, False)
        shared[1:] |= same
        at = order[shared]
        place = pos[row[at]] + bit[at]
        by = np.lexsort((place, ids[row[at]], run[at]))
        at, place = at[by], place[by]
        r, i = run[at], ids[row[at]]
        head = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(at) else np.zeros(0, np.int64)
        n = np.diff(np.append(head, len(at)))
        later = (i != np.repeat(i[head], n)) | (place != np.repeat(place[head], n))
        at = at[later]
        starts = known.astype(np.int64)
        np.bitwise_or.at(starts, row[at], np.int64(1) << bit[at])
        hit = starts != 0
        yield pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(pos[hit]), pa.array(starts[hit].astype(np.int32))],
                                         ["id", "pos", "starts"])


def repeated_runs(docs: DataFrame, span: int = 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, pos, starts): of document ``id``, the runs of ``span`` words from word ``pos + bit`` on, for each bit of
    ``starts``, also start earlier."""
    if not PHRASE <= span < PHRASE + 31:
        raise ValueError(f"span must be from {PHRASE} to {PHRASE + 30}")
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"), F.encode(F.col(text), "UTF-8").alias("t"))

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, span):
            at = b.anchor[b.ok]
            k, n = np.unique(b.phrase[np.unique(at)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["key", "n"])

    probe = map_batches(rows.where(F.pmod(F.xxhash64("id"), F.lit(PROBE)) == 0), phrases, "key long, n long")
    probe = written(probe.groupBy("key").agg(F.sum("n").alias("n")), "phrases")
    total = probe.agg(F.sum("n")).first()[0] or 0
    # at most 2 * parts phrases have so large a share
    often = [r[0] for r in probe.where(F.col("n") > max(total // (2 * parts), 64)).select("key").collect()]
    frequent = spark.sparkContext.broadcast(np.array(often, np.int64).view(np.uint64))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, span):
            yield b.rows(frequent.value)

    met = map_batches(rows, asked, "key long, id long, pos int, want int, known int, runs binary")
    met = met.repartition(parts, "key").sortWithinPartitions("key")
    return map_batches(met, _settle, "id long, pos int, starts int")


def remove_repeats(docs: DataFrame, span: int = 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_removed, kept string) of every row of ``docs``: its words that no repeated run covers.

    A run of ``span`` words is repeated when the same words also start earlier:
    in a row of smaller key, or of the same key at an earlier word. Runs are judged on
    the input, not on what is left. Null texts have no words; texts shorter than
    a run lose none. A null key comes before all others. Rows that share a key
    are one document: where a run is repeated in one of them, its words go from all
    of them; none of them is earlier than its like at the same word. Other columns are ignored.
    """

    def cut(b: pa.RecordBatch):
        words_of, removed, kept = [], [], []
        for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            words = _WORDS.findall(t) if t else []
            words_of.append(len(words))
            if spans:
                edge = np.zeros(len(words) + span + 64, np.int64)
                for s in spans:
                    for k in range(s["starts"].bit_length()):
                        if s["starts"] >> k & 1 and s["pos"] + k + span <= len(words):
                            edge[s["pos"] + k] += 1
                            edge[s["pos"] + k + span] -= 1
                stay = np.cumsum(edge)[:len(words)] == 0
                words = [w for w, k in zip(words, stay.tolist()) if k]
            removed.append(words_of[-1] - len(words))
            kept.append(" ".join(words))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(words_of, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.large_string()).cast(pa.string())],
            [key, "n_words", "n_removed", "kept"])

    spans = repeated_runs(docs, span, text, key).groupBy("id").agg(F.collect_list(F.struct("pos", "starts")).alias("spans"))
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    rows = rows.join(spans, F.coalesce("k", F.lit(NULL_ID)) == spans["id"], "left").select("k", "t", "spans")
    return in_arrow(rows, cut, f"`{key}` long, n_words long, n_removed long, kept string")


def digest(docs: DataFrame, span: int = 20, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) of every row."""
    out = remove_repeats(docs, span, text, key)
    return out.select(key, "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
