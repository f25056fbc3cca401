"""Operator 5: language ID by multilingual mixture inference.

A document is a mixture of languages. Each has a distribution over hashed
character trigrams, learned from labelled documents; expectation-maximisation estimates the
document's proportions, and the set of languages is the one of highest
penalised likelihood among the nested sets of its most probable languages.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import in_arrow, packed, with_row

#: Documents of each language that the classifier is fitted on, about; all of them if there are fewer.
SAMPLE = 4000
#: Buckets of trigrams, smoothing of their counts.
BUCKETS, SMOOTH = 1 << 14, 0.5
#: Steps of expectation-maximisation at most, and the change of proportions that ends it.
STEPS, STILL = 30, 1e-3
#: Penalty of each further language, times the logarithm of the number of trigrams. Overlapping trigrams
#: count each character three times, so it is three times that of the Bayesian information criterion.
PENALTY = 1.5
UNDETERMINED = "und"

_OTHER = re.compile(r"[\W\d_]+")
_LETTER = regex.compile(r"\p{L}")


def grams(text: str) -> np.ndarray:
    """Bucket of each character trigram of the lower-cased words of ``text``."""
    c = np.frombuffer(f" {_OTHER.sub(' ', text.lower())} ".encode("utf-32-le"), "<u4")
    if len(c) < 3:
        return np.zeros(0, np.int64)
    h = (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1]) * np.uint32(0x85EBCA77) + c[2:]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
    return (h >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)


class Model:
    """Languages and, for each, the probability of every bucket."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        self.languages = languages
        smooth = counts + SMOOTH
        self.p = np.ascontiguousarray((smooth / smooth.sum(axis=1, keepdims=True)).T)

    def mixture(self, n: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions that fit trigrams with counts ``n`` and probabilities ``p``, and their log-likelihood."""
        share, total = np.full(p.shape[1], 1 / p.shape[1]), n.sum()
        if len(share) == 1:
            return share, float(n @ np.log(p[:, 0]))
        for _ in range(STEPS):
            mixed = p @ share
            new = share * ((n / mixed) @ p) / total
            still = np.abs(new - share).max() < STILL
            share = new
            if still:
                break
        return share, float(n @ np.log(p @ share))

    def infer(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        """The main language, its proportion, and the proportions of all languages of the chosen set."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0, {}
        bucket, n = np.unique(grams(text), return_counts=True)
        p, n = self.p[bucket], n.astype(np.float64)
        share, _ = self.mixture(n, p)
        order = np.argsort(-share, kind="stable")
        best, value = None, -math.inf
        for k in range(1, len(order) + 1):
            s, likelihood = self.mixture(n, p[:, order[:k]])
            penalised = likelihood - PENALTY * (k - 1) * math.log(n.sum())
            if penalised <= value:
                break
            best, value = s, penalised
        top = int(np.argmax(best))
        return (self.languages[order[top]], float(min(1.0, best[top])),
                {self.languages[order[i]]: float(x) for i, x in enumerate(best)})


def held_out(key: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its key as text leaves 2 when divided by 4. False for null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Learn from rows with a language, a text and a key that are not held out, about ``sample`` rows a language.

    Rows are sampled by a hash of their key against the language's count, so
    every row has the same chance and the driver gets bucket counts only:
    ``BUCKETS`` a language at most.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key)))
    rows = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("t"), F.col(key).alias("k"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model([], np.zeros((0, BUCKETS)))
    chance = F.create_map(*(F.lit(x) for l, n in sizes.items() for x in (l, min(1.0, sample / n))))
    draw = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30)
    rows = rows.where(draw < chance[F.col("lang")]).select("lang", "t")

    def count(b: pa.RecordBatch):
        mine: dict[str, np.ndarray] = {}
        for l, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            mine[l] = mine.get(l, 0) + np.bincount(grams(t), minlength=BUCKETS)
        for l, n in mine.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([l] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "bucket", "n"])

    found = in_arrow(rows, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = found.toArrow()
    languages = sorted(sizes)
    counts = np.zeros((len(languages), BUCKETS))
    at = {l: i for i, l in enumerate(languages)}
    counts[[at[l] for l in found.column(0).to_pylist()], found.column(1).to_numpy()] = found.column(2).to_numpy()
    return Model(languages, counts)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(row struct of all columns of ``docs``, lang_pred, score, shares map) of every row, from its whole text.

    ``score`` is the main language's proportion. Null texts, texts without a letter
    and all texts of an empty model give ``und``, 0 and no shares. Of equal
    proportions the language first in order wins. Repeated rows stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language
    rows = packed(docs, text)

    def run(b: pa.RecordBatch):
        found = [shared.value.infer(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
             pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.float64()))],
            ["row", "lang_pred", "score", "shares"])

    return in_arrow(rows, run, with_row(rows, "lang_pred string, score double, shares map<string,double>"))


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """(key, held_out, lang_pred, score) of every row, by a model learned from the rows that are not held out."""
    out = predict(docs.select(key, text), fit(docs, text, lang, key), text)
    return out.select(F.col("row")[key].alias(key), held_out(F.col("row")[key]).alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, min_score: float = 0.5, text: str = "text", lang: str = "lang",
               key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose language is determined with a proportion of ``min_score`` or more, columns unchanged."""
    out = predict(docs, fit(docs, text, lang, key), text)
    return out.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_score)).select("row.*")
