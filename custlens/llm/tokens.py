"""Operator 1: token counts. Batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import by_bytes, in_arrow

#: Characters of text that are encoded together, and of new pieces handed to the library in one call.
GROUP_CHARS, CALL_CHARS = 4 << 20, 256 << 10
#: Characters of pieces a worker remembers before it starts anew, and the longest piece it remembers.
KEPT_CHARS, KEPT_PIECE = 6 << 20, 64

_PIECE = re.compile(r"\s*\S+|\s+")
_ODD = re.compile(r"[\x1c-\x1f]")  # white space to Python, not to the library


def splits_at_spaces(path: str) -> bool:
    """Whether text before a run of white space never changes the tokens after it.

    Holds for byte-level files without a normalizer: no alternative of their
    pattern has white space behind anything else, nor looks back.
    """
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    pre = j["pre_tokenizer"] or {}
    return (j["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and j["model"].get("dropout") is None
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
                        for t in j["added_tokens"]))


class PieceEncoder:
    """Encodes texts with a ``tokenizers`` file piece by piece; a piece is white space and what follows it.

    Pieces end at safe boundaries, so a text's ids are its pieces' ids in
    order. Recent pieces are remembered (bounded); new ones go to the library
    in calls of about equal bytes.
    """

    def __init__(self, path: str, lengths: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.safe = splits_at_spaces(path)
        self.value = len if lengths else (lambda e: array("I", e.ids).tobytes())
        self.lengths = lengths
        self.known: dict[str, int | bytes] = {}
        self.chars = 0

    def _pieces(self, text: str) -> list[str]:
        return _PIECE.findall(text) if self.safe and not _ODD.search(text) else [text] if text else []

    def encode(self, texts: list[str]) -> Iterator[int | bytes]:
        """Per text the number of tokens, or the ids as little-endian unsigned 32-bit integers."""
        for part in by_bytes(texts, GROUP_CHARS):
            pieces = [self._pieces(t) for t in texts[part]]
            if self.chars > KEPT_CHARS:
                self.known, self.chars = {}, 0
            known = self.known
            new = list({p for ps in pieces for p in ps if p not in known})
            for call in by_bytes(new, CALL_CHARS):
                for p, e in zip(new[call], self.tok.encode_batch_fast(new[call], add_special_tokens=False)):
                    known[p] = self.value(e)
            self.chars += sum(map(len, new))
            get = known.__getitem__
            if self.lengths:
                yield from [sum(map(get, ps)) for ps in pieces]
            else:
                yield from [b"".join(map(get, ps)) for ps in pieces]
            for p in new:
                if len(p) > KEPT_PIECE:
                    self.chars -= len(p)
                    del known[p]


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, lengths: bool) -> PieceEncoder:
    """One encoder per Python worker and file."""
    if (path, lengths) not in _ENCODERS:
        _ENCODERS[path, lengths] = PieceEncoder(path, lengths)
    return _ENCODERS[path, lengths]


def token_counts(docs: DataFrame, path: str, limit: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    ``path`` is a ``tokenizers`` JSON file that every executor can open. Null
    and empty texts have 0 bytes and 0 tokens; null keys and repeated rows stay
    as they are; other columns are ignored. Texts are split before white space
    (however long, memory is bounded by the longest run without any); files
    with a normalizer or other pre-tokenizers get whole texts instead.
    """

    def count(b: pa.RecordBatch):
        n = list(encoder(path, True).encode([t or "" for t in b.column(1).to_pylist()]))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], names)

    names = [key, "n_bytes", "n_tokens"]
    n_bytes: Column = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    rows = docs.select(F.col(key), F.col(text).alias("__text"), n_bytes.alias("n_bytes"))
    out = in_arrow(rows, count, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
