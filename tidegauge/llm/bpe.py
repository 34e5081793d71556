"""Byte-pair encoding and decoding with a published vocabulary.

A pre-token's symbols form a doubly linked list. A priority queue holds the merges that neighbours allow, by rank and
place; an entry whose symbols have changed meanwhile is stale and skipped. Decoding concatenates the vocabulary's strings.

Defined cases: a null text is the empty text, which has no ids; equal rows give equal rows; texts of any length are
encoded whole (the queue keeps a pre-token of n bytes at n log n); other columns are ignored; an empty table gives an
empty table. The special token's string in a text is that token, as the published tokenizer reads it.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterable
from heapq import heapify, heappop, heappush

import numpy as np
import regex
from pyspark.sql import DataFrame

from .common import map_rows, texts, type_of

#: Fixed value: the pre-token pattern of byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_WORDS = 300_000


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def merged(symbols: list[int], ranks: dict[tuple[int, int], int], rules: list[tuple[int, int, int]]) -> list[int]:
    """Applies merges to a list of symbols, lowest rank first, then leftmost. ``rules[rank]`` is (left, right, joined)."""
    n, rank_of = len(symbols), ranks.get
    queue = [r << 32 | i for i, pair in enumerate(zip(symbols, symbols[1:])) if (r := rank_of(pair)) is not None]
    if not queue:
        return symbols
    heapify(queue)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    while queue:
        entry = heappop(queue)
        i, (a, b, joined) = entry & 0xFFFFFFFF, rules[entry >> 32]
        j = right[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue  # stale
        symbols[i], symbols[j] = joined, -1
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            if (r := rank_of((joined, symbols[k]))) is not None:
                heappush(queue, r << 32 | i)
        h = left[i]
        if h >= 0 and (r := rank_of((symbols[h], joined))) is not None:
            heappush(queue, r << 32 | h)
    return [s for s in symbols if s >= 0]


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def unpack(packed: bytes) -> list[int]:
    return np.frombuffer(packed, dtype="<u4").tolist()


class Known(dict):
    """Encoded words in two generations: when the young one is full it becomes the old one. Long words are never kept."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word) or self.make(word)
        if len(word) < 64:
            if len(self) >= CACHED_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


class Codec:
    def __init__(self, published: str):
        t = json.loads(published)
        vocab, letters = t["model"]["vocab"], byte_letters()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in t["model"]["merges"]]
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.ranks = {(a, b): rank for rank, (a, b, _) in enumerate(self.rules)}
        self.single = [vocab[letters[b]] for b in range(256)]
        self.special = {x["content"]: x["id"] for x in t.get("added_tokens", [])}
        back = {c: b for b, c in letters.items()}
        self.strings = {i: bytes(back[c] for c in s) if all(c in back for c in s) else s.encode() for s, i in vocab.items()}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.pre = regex.compile(PRE_TOKEN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = Known(lambda w: pack(merged([self.single[b] for b in w.encode()], self.ranks, self.rules)))

    def packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out, known = [], self.known.__getitem__
        for piece in self.cut.split(text) if self.cut else [text]:
            if piece in self.special:
                out.append(pack([self.special[piece]]))
                continue
            out.extend(map(known, self.pre.findall(piece) if len(piece) < 1_000_000 else (m[0] for m in self.pre.finditer(piece))))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return unpack(self.packed(text))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_CODECS: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec for each worker process and vocabulary."""
    key = hash(shared.value)
    if key not in _CODECS:
        _CODECS[key] = Codec(shared.value)
    return _CODECS[key]


def _published(docs: DataFrame, path: str):
    """The vocabulary file (of fixed size) goes to the executors once; they need no copy of the file."""
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row."""
    d, shared = texts(docs, id_col, text_col), _published(docs, path)

    def make():
        codec = _codec(shared)
        return lambda i, t: [i, [codec.encode(x) for x in t]]
    return map_rows(d, make, [("doc_id", type_of(d, "doc_id")), ("ids", "array<bigint>")])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows of (doc_id, ids); null ids are no ids."""
    shared = _published(encoded, path)
    d = encoded.select("doc_id", "ids")

    def make():
        codec = _codec(shared)
        return lambda i, ids: [i, [codec.decode(x or ()) for x in ids]]
    return map_rows(d.withColumn("ids", d["ids"].cast("array<bigint>")), make, [("doc_id", type_of(d, "doc_id")), ("text", "string")])


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every row in one pass; ids and decoded text leave as SHA-256 digests."""
    d, shared = texts(docs, id_col, text_col), _published(docs, path)

    def make():
        codec = _codec(shared)

        def run(ids, rows):
            out: list[list] = [ids, [], [], []]
            for text in rows:
                got = codec.packed(text)
                out[1].append(len(got) // 4)
                out[2].append(hashlib.sha256(got).hexdigest())
                out[3].append(hashlib.sha256(codec.decode(unpack(got)).encode()).hexdigest())
            return out
        return run
    return map_rows(d, make, [("doc_id", type_of(d, "doc_id")), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")])

