"""Operator 6: BPE encoding and decoding with a word-end vocabulary."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array
from hashlib import sha256
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custlens.llm.common import by_bytes, in_arrow

#: Words that a worker remembers, with their ids, before it starts anew; the longest piece it remembers.
KEPT_WORDS, KEPT_PIECE = 800_000, 64
GROUP_CHARS = 4 << 20

_ODD = re.compile(r"[\x1c-\x1f]")  # white space to Python, not to the library
_SOLID = re.compile(r"(?:\S|[\x1c-\x1f])+")
#: Beyond these characters the library's own normalizer and splitter are asked; its Unicode tables may differ.
_PLAIN = re.compile(r"[\x00-ɏ]*")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return [chr(b) if b in own else chr(256 + sum(x not in own for x in range(b))) for b in range(256)]


class WordBPE:
    """Encoder and decoder of a ``tokenizers`` JSON file of kind BPE with an end-of-word suffix.

    Merges of one word: a heap of (rank, position) over a doubly linked list of
    symbols. A popped entry is stale when either symbol has been merged since,
    and is skipped; of equal ranks the leftmost goes first.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model = j["model"]
        if not model.get("end_of_word_suffix") or j["decoder"] is not None:
            raise ValueError("this file is not a BPE with word ends and plain decoding")
        self.library = Tokenizer.from_file(path)
        self.suffix = model["end_of_word_suffix"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        split = next(p for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"])
        names = byte_symbols()
        self.start = [vocab.get(c) for c in names]
        self.end = [vocab.get(c + self.suffix) for c in names]
        self.byte = {c: b for b, c in enumerate(names)}
        self.merges: dict[int, int] = {}  # left id << 32 | right id -> rank << 32 | merged id
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            self.merges.setdefault(vocab[a] << 32 | vocab[b], rank << 32 | vocab[a + b])
        self.token = {i: t.encode() for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.known: dict[str, bytes] = {}
        self.by_word: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word, given as bytes."""
        ids = [self.start[b] for b in word]
        ids[-1] = self.end[word[-1]]
        n, get = len(ids), self.merges.get
        if n == 1:
            return ids
        heap = [m >> 32 << 32 | i for i in range(n - 1) if (m := get(ids[i] << 32 | ids[i + 1]))]
        if not heap:
            return ids
        heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = heappop(heap)
            i = entry & 0xFFFFFFFF
            a, j = ids[i], after[i]
            if a < 0 or j == n or (m := get(a << 32 | ids[j])) is None or m >> 32 != entry >> 32:
                continue  # stale
            ids[i] = new = m & 0xFFFFFFFF
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if m := get(new << 32 | ids[k]):
                    heappush(heap, m >> 32 << 32 | i)
            k = before[i]
            if k >= 0 and (m := get(ids[k] << 32 | new)):
                heappush(heap, m >> 32 << 32 | k)
        return [x for x in ids if x >= 0]

    def _split(self, text: str) -> list[str]:
        if text.isascii():
            return self.words.findall(text.lower())
        if not _PLAIN.fullmatch(text):
            norm = self.library.normalizer.normalize_str(text)
            words = self.library.pre_tokenizer.pre_tokenize_str(norm)
            return [bytes(self.byte[c] for c in w).decode() for w, _ in words]
        return self.words.findall(unicodedata.normalize("NFC", text).lower())

    def piece(self, piece: str) -> bytes:
        """Ids, as little-endian unsigned 32-bit integers, of a text without white space."""
        out = []
        for part in self.cut.split(piece) if self.cut else [piece]:
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
                continue
            for w in self._split(part):
                if (ids := self.by_word.get(w)) is None:
                    ids = array("I", self.merge(w.encode())).tobytes()
                    if len(w) <= KEPT_PIECE:
                        self.by_word[w] = ids
                out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text. White space only parts words, so texts are cut at it and pieces remembered."""
        out: list[bytes] = []
        for part in by_bytes(texts, GROUP_CHARS):
            if len(self.known) + len(self.by_word) > KEPT_WORDS:
                self.known, self.by_word = {}, {}
            known, long = self.known, []
            for t in texts[part]:
                pieces = _SOLID.findall(t) if _ODD.search(t) else t.split()
                for p in set(pieces).difference(known):
                    known[p] = self.piece(p)
                    if len(p) > KEPT_PIECE:
                        long.append(p)
                out.append(b"".join(map(known.__getitem__, pieces)))
            for p in set(long):
                del known[p]
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of the ids: vocabulary strings, specials included, one blank between them."""
        return b" ".join(map(self.token.__getitem__, array("I", ids)))


_CODECS: dict[str, WordBPE] = {}


def codec(path: str) -> WordBPE:
    """One codec per Python worker and file."""
    if path not in _CODECS:
        _CODECS[path] = WordBPE(path)
    return _CODECS[path]


def _rows(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key), F.col(text).alias("__text"))


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ids array<int>) of every row. Null and empty texts have no ids; repeated rows and null keys stay."""

    def run(b: pa.RecordBatch):
        ids = [memoryview(x).cast("I").tolist() for x in codec(path).encode([t or "" for t in b.column(1).to_pylist()])]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], [key, "ids"])

    return in_arrow(_rows(docs, text, key), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, text) of rows of ids. Null ids give an empty text; an id outside the vocabulary is an error."""

    def run(b: pa.RecordBatch):
        texts = [codec(path).decode(array("I", x or []).tobytes()).decode() for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], [key, "text"])

    rows = encoded.select(F.col(key), F.col("ids"))
    return in_arrow(rows, run, f"`{key}` {encoded.schema[key].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): each text encoded, its ids decoded, both digested.

    Texts are encoded and decoded inside the task that reads them; no text is
    shuffled. Null and empty texts have 0 tokens and digests of nothing; null
    keys and repeated rows stay; other columns are ignored.
    """

    def run(b: pa.RecordBatch):
        c = codec(path)
        n, ids_hex, text_hex = [], [], []
        for ids in c.encode([t or "" for t in b.column(1).to_pylist()]):
            n.append(len(ids) // 4)
            ids_hex.append(sha256(ids).hexdigest())
            text_hex.append(sha256(c.decode(ids)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())],
            [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return in_arrow(_rows(docs, text, key), run,
                    f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
