"""Operator 2: benchmark decontamination. N-gram seeds find passages, Smith-Waterman alignment scores them.

Words are lower-cased letters and digits. Test items are cut into pieces of at most
``PIECE`` words. Every run of ``SEED`` words of a piece is a seed, however many documents
hold it: a copy of six words or more of which a fifth is replaced still holds one unchanged. One
pass over the corpus takes the passages around seeds; seeds join passages to pieces. Of a
pair, the places that share enough words with the piece for a match are aligned.

Only a bitmap of seed hashes is broadcast; it has at most 2**MAP_BITS bits whatever
the size of the benchmark, and all that passes it is decided by joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import in_arrow, written
from custlens.llm.words import MARKS, runs, word_hashes

SEED, PIECE, STEP = 3, 64, 32
MAP_BITS = 27
#: Share of a piece's words that the alignment must match, and its scores.
MIN_SIMILARITY = 0.6
MATCH, MISMATCH, GAP = 1, -1, -1

#: Common marks outside ASCII; they part words too.
_PARTING = [c.encode() for c in "“”„‘’‚«»‹›–—…¿¡·•　 "]

#: Bytes that part words, as blanks.
_BLANK = bytes(32 if m else c for c, m in enumerate(MARKS))


def _plain(text: str) -> Column:
    return F.encode(F.lower(F.coalesce(F.col(text), F.lit(""))), "UTF-8")


class _Texts:
    """Words and seeds of a batch of texts."""

    def __init__(self, texts: list[bytes]) -> None:
        self.raw = b"".join(texts)
        for mark in _PARTING:
            self.raw = self.raw.replace(mark, b" " * len(mark))
        raw = np.frombuffer(self.raw, np.uint8)
        self.h, self.text, self.start, self.stop = word_hashes(raw, np.cumsum([len(t) for t in texts]), MARKS)
        n = max(0, len(self.h) - SEED + 1)
        self.seed = runs(self.h, SEED)[:n] if n else self.h[:0]
        self.ok = self.text[:n] == self.text[len(self.text) - n:]

    def words(self, a: int, b: int) -> list[str]:
        return [self.raw[x:y].decode(errors="replace") for x, y in zip(self.start[a:b].tolist(), self.stop[a:b].tolist())]

    def line(self, a: int, b: int) -> bytes:
        """Words with blanks between them."""
        return self.raw[self.start[a]:self.stop[b - 1]].translate(_BLANK)

    def held(self, bitmap: np.ndarray) -> np.ndarray:
        """Positions of seeds whose bit is set."""
        at = self.seed >> np.uint64(64 - (len(bitmap).bit_length() - 1) - 3)
        hit = bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1
        return np.flatnonzero(hit.astype(bool) & self.ok)


def _batches(b: pa.RecordBatch, column: int, budget: int = 4 << 20):
    """Parts of a batch with about ``budget`` bytes of text."""
    first = size = 0
    texts = b.column(column).to_pylist()
    for i, t in enumerate(texts):
        size += len(t)
        if size >= budget or i == len(texts) - 1:
            yield slice(first, i + 1), texts[first:i + 1]
            first, size = i + 1, 0


def pieces(items: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """(item, piece, words array<string>, seeds array<long>) of every test item of ``SEED`` words or more."""

    def run(b: pa.RecordBatch):
        out = []
        for part, texts in _batches(b, 1):
            t = _Texts(texts)
            ends = np.searchsorted(t.text, np.arange(len(texts) + 1))
            for item, a, z in zip(b.column(0).to_pylist()[part], ends[:-1].tolist(), ends[1:].tolist()):
                for n, k in enumerate(range(a, max(a + 1, z - PIECE + STEP), STEP)):
                    stop = min(k + PIECE, z)
                    if stop - k >= SEED:
                        out.append({"item": item, "piece": n, "words": t.words(k, stop),
                                    "seeds": t.seed[k:stop - SEED + 1].view(np.int64).tolist()})
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
            [("item", pa.int64()), ("piece", pa.int32()), ("words", pa.list_(pa.string())), ("seeds", pa.list_(pa.int64()))]))

    rows = items.select(F.col(key).cast("long").alias("item"), _plain(text).alias("t"))
    return in_arrow(rows, run, "item long, piece int, words array<string>, seeds array<long>").withColumn(
        "pid", F.monotonically_increasing_id())


def _bitmap(seeds: DataFrame) -> np.ndarray:
    """Bits of the leading bits of each seed; a thousand bits a seed, up to the limit."""
    n = seeds.count()
    bits = min(MAP_BITS, max(16, n.bit_length() + 10))
    rows = seeds.select(F.shiftrightunsigned("seed", 64 - bits).alias("at")).selectExpr(
        "shiftright(at, 3) AS byte", "shiftleft(1, CAST(at & 7 AS INT)) AS bit")
    rows = rows.groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 3), np.uint8)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def align(item: list, passage: list) -> tuple[int, int, int, int]:
    """Best local alignment: score, matched words, start and end in the passage."""
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(item + passage))}
    p = np.array([vocabulary[w] for w in passage])
    ramp = np.arange(1, len(p) + 1) * GAP
    table = np.zeros((len(item) + 1, len(p) + 1), np.int32)
    for i, w in enumerate(item, 1):
        best = np.maximum(table[i - 1, :-1] + np.where(p == vocabulary[w], MATCH, MISMATCH), table[i - 1, 1:] + GAP)
        best = np.maximum(best, 0)
        table[i, 1:] = np.maximum.accumulate(best - ramp) + ramp  # gaps in the item, all at once
    i, j = np.unravel_index(int(table.argmax()), table.shape)
    score, end, matched = int(table[i, j]), int(j), 0
    while table[i, j] > 0:
        same = item[i - 1] == passage[j - 1]
        if table[i, j] == table[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matched += same
            i, j = i - 1, j - 1
        elif table[i, j] == table[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return score, matched, int(j), end


def places(item: list[bytes], passage: list[bytes], least: float) -> list[tuple[int, int]]:
    """Stretches of the passage around seeds of the item, wide enough for any alignment through them.

    An alignment matches no more words than a stretch has in common with the item,
    each as often as both have it; stretches with fewer than ``least`` times the item's words are left out.
    """
    number = {w: i for i, w in enumerate(dict.fromkeys(item))}
    q, p = np.array([number[w] for w in item]), np.array([number.get(w, -1) for w in passage])
    grams = [np.lib.stride_tricks.sliding_window_view(x, SEED) @ (len(number) ** np.arange(SEED)) for x in (q, p)]
    known = np.lib.stride_tricks.sliding_window_view(p, SEED).min(axis=1) >= 0
    at = np.flatnonzero(known & np.isin(grams[1], grams[0]))
    of, out = np.bincount(q), []
    # no part of an alignment has more gaps than matches, so it reaches at most twice the item's words from a seed
    for mine in np.split(at, np.flatnonzero(np.diff(at) > 4 * len(item)) + 1) if len(at) else ():
        a, z = max(0, int(mine[0]) - 2 * len(item)), min(len(p), int(mine[-1]) + SEED + 2 * len(item))
        if np.minimum(of, np.bincount(p[a:z][p[a:z] >= 0], minlength=len(of))).sum() / len(item) >= least:
            out.append((a, z))
    return out


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text",
          item_key: str = "item_id", min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """(key, item_id, piece, similarity, score, start, end, text_hash): each piece of a test item found in a document.

    ``similarity`` is the share of the piece's words that the best local alignment
    matches, ``score`` that alignment's score over the piece's words, ``start`` and
    ``end`` its place in words of the document, and ``text_hash`` the xxhash64 of the whole
    text. Null and empty texts, on either side, and items of fewer than ``SEED``
    words give no row; rows with null keys take part; of repeated rows of a
    document one is reported. A piece that leaks into several places of a document is reported at the best.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    item_pieces = written(pieces(items, item_text, item_key), "pieces")
    seeds = item_pieces.select("pid", F.explode(F.array_distinct("seeds")).alias("seed"))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), _plain(text).alias("t"))
    bitmap = spark.sparkContext.broadcast(_bitmap(seeds.select("seed").distinct()))

    def passages(b: pa.RecordBatch):
        for part, texts in _batches(b, 2):
            t, out = _Texts(texts), []
            at = t.held(bitmap.value)
            if len(at):
                ends = np.searchsorted(t.text, np.arange(len(texts) + 1))
                new = np.flatnonzero(np.append(True, (np.diff(at) > 2 * PIECE) | (np.diff(t.text[at]) > 0)))
                ids, hashes = b.column(0).to_pylist()[part], b.column(1).to_pylist()[part]
                for mine in np.split(at, new[1:]):
                    n = int(t.text[mine[0]])
                    a, z = max(ends[n], mine[0] - PIECE), min(ends[n + 1], mine[-1] + SEED + PIECE)
                    out.append({"id": ids[n], "text_hash": hashes[n], "first": int(a - ends[n]), "words": t.line(a, z),
                                "seeds": np.unique(t.seed[mine]).view(np.int64).tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=passage)

    passage = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int64()),
                         ("words", pa.binary()), ("seeds", pa.list_(pa.int64()))])
    place = in_arrow(rows, passages, "id long, text_hash long, first long, words binary, seeds array<long>")
    place = written(place.withColumn("place", F.monotonically_increasing_id()), "passages")
    pairs = place.select("place", F.explode("seeds").alias("seed")).join(seeds, "seed").select("place", "pid").distinct()
    pairs = pairs.join(item_pieces.select("pid", "item", "piece", F.col("words").alias("of")), "pid")
    pairs = pairs.join(place.drop("seeds"), "place").select("id", "text_hash", "item", "piece", "first", "of", "words")

    def score(b: pa.RecordBatch):
        out = []
        for r in b.to_pylist():
            of, words = [w.encode() for w in r["of"]], r["words"].split()
            for a, z in places(of, words, min_similarity):
                points, matched, start, end = align(of, words[a:z])
                out.append({"id": r["id"], "text_hash": r["text_hash"], "item": r["item"], "piece": r["piece"],
                            "similarity": matched / len(of), "score": points / len(of),
                            "start": r["first"] + a + start, "end": r["first"] + a + end})
        yield pa.RecordBatch.from_pylist(out, schema=scored)

    scored = pa.schema([("id", pa.int64()), ("text_hash", pa.int64()), ("item", pa.int64()), ("piece", pa.int32()),
                        ("similarity", pa.float64()), ("score", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])
    best = in_arrow(pairs, score, "id long, text_hash long, item long, piece int, similarity double, score double, "
                                  "start long, end long").where(F.col("similarity") >= min_similarity)
    value = F.struct("similarity", "score", F.negate("start").alias("back"), "end")
    best = best.groupBy("id", "text_hash", "item", "piece").agg(F.max(value).alias("m"))
    return best.select(F.col("id").alias(key), F.col("item").alias("item_id"), "piece", "m.similarity", "m.score",
                       F.negate("m.back").alias("start"), "m.end", "text_hash")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without any leak, columns unchanged; equal texts under one key go together."""
    bad = leaks(docs, items, text, key).select(F.col(key).alias("k"), "text_hash").distinct()
    return docs.join(bad, docs[key].cast("long").eqNullSafe(bad["k"]) & (F.xxhash64(docs[text]) == bad["text_hash"]), "left_anti")
