"""Token ids in files, compressed by Re-Pair grammars that can be read from any place.

Documents are sorted by id over range partitions. A task encodes its documents one after the other, appends the end id to
each, and closes a shard when it holds SEGMENT ids or more. A shard's ids are cut into segments of SEGMENT ids. In each
segment frequent pairs of ids are replaced by nonterminals, round by round, until a round saves less than one symbol in
``GAIN``; a round takes all pairs that occur ``LEAST`` times and a ``NEAR``-th as often as the most frequent one, and of
overlapping places the more frequent pair's. Kept are the rules, the number of ids that each expands to, and the symbols that
are left.

The expansion lengths give the place of every symbol without expanding it, so any range of ids is decoded from the symbols
that cover it (:meth:`Segment.ids`), and a document from its start and length.

The files are a Parquet table with one shard a row: ``part`` and ``nth`` (their order), ``docs`` (ids of the documents),
``starts`` (of each document in the shard), ``n_tokens`` and ``data``, the segments. Spark's writer commits them, so a lost
executor leaves no half shard. Layout of a segment, in little-endian unsigned integers: first nonterminal, number of rules, number
of symbols, bytes of a symbol (2 or 4), each of 4 bytes; left and right symbol and expansion length of each rule (4 bytes
each); the symbols.

Ids are those of the tokenizers library. Texts are encoded with tiktoken, which reads the same vocabulary and pattern some six
times faster, where ids are ranks of merges, as in byte-level vocabularies; tests hold the two against each other on all code points. What it refuses (a
million blanks in a row) and other vocabularies go to the tokenizers library itself.

Defined cases: a null text is empty and has the end id only; rows with equal ids are ordered by a hash of the text, then by
place, and each has an entry of its own; null ids come first; a text is encoded whole and is in one shard, whatever its
length; the end id may occur inside a text as well; other columns are ignored; an empty table gives a table without rows.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import _published, byte_letters
from .common import _ARROW, texts, type_of

END = 2
#: Fixed value: the pre-tokens of byte-level vocabularies, in the published form that needs no backtracking.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Ids of a segment; pairs and places of a segment are sorted as one 64-bit number each, which leaves 22 bits for a symbol.
SEGMENT = 1 << 20
#: A rule pays from about so many uses on: it costs 12 bytes.
LEAST = 8
NEAR, GAIN = 16, 64
_HEAD = struct.Struct("<4I")


class Encoder:
    """Ids of texts as the tokenizers library gives them."""

    def __init__(self, published: str):
        import tiktoken
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_str(published)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        t = json.loads(published)
        special = {x["content"]: x["id"] for x in t.get("added_tokens") or []}
        model, back = t["model"], {c: b for b, c in byte_letters().items()}
        vocab = {s: i for s, i in model["vocab"].items() if s not in special}
        joined = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model.get("merges", [])]
        pre = t.get("pre_tokenizer") or {}
        plain = (pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and t.get("normalizer") is None
                 and None not in joined and joined == sorted(joined) and len(vocab) == 256 + len(set(joined)) and not model.get("ignore_merges")
                 and all(not x[k] for x in t.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip")))
        self.fast = tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks={bytes(back[c] for c in s): i for s, i in vocab.items()}, special_tokens=special) if plain else None

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # its pattern engine gave up
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


def _chosen(symbols: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pairs to replace this round, the most frequent first; places; pair of each place), no two places overlapping."""
    n = len(symbols)
    none = np.zeros(0, np.int64)
    if n < 2:
        return none, none, none
    packed = np.sort((symbols[:-1] << np.uint64(22) | symbols[1:]) << np.uint64(20) | np.arange(n - 1, dtype=np.uint64))
    pair = packed >> np.uint64(20)
    at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    count = np.diff(np.append(at, n - 1))
    often = np.flatnonzero(count >= max(LEAST, int(count.max()) // NEAR))
    often = often[np.argsort(-count[often], kind="stable")][:most]
    if not len(often):
        return none, none, none
    sizes = count[often]
    rows = np.repeat(at[often] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    unsorted = (packed[rows] & np.uint64(SEGMENT - 1)).astype(np.int64)
    place = np.sort(unsorted)
    rank = np.full(n + 1, len(often), np.int32)  # of the pair at each place, with an end on either side
    rank[unsorted + 1] = np.repeat(np.arange(len(often), dtype=np.int32), sizes)
    here, before, after = rank[place + 1], rank[place], rank[place + 2]
    good = (before >= here) & (after >= here)
    # x x x x: of a run of one pair every second place counts, from the first place of the run on
    twin = np.flatnonzero(before == here)
    if len(twin):
        run = np.flatnonzero(np.concatenate([[True], place[twin][1:] != place[twin][:-1] + 1]))
        nth = np.arange(len(twin)) - np.repeat(run, np.diff(np.append(run, len(twin))))
        good[twin[nth % 2 == 0]] = False
    return pair[at[often]], place[good], here[good]


def compress(ids: np.ndarray, base: int) -> bytes:
    """A segment: rules, expansion lengths and symbols. ``ids`` are below ``base``, which is the first nonterminal."""
    symbols = ids.astype(np.uint64)
    lefts, rights = [], []
    made = 0
    while True:
        pairs, places, which = _chosen(symbols, (1 << 22) - base - made)
        good = np.bincount(which, minlength=len(pairs)) > 1
        if good[which].sum() * GAIN <= len(symbols):
            break
        name = np.cumsum(good) - 1 + base + made
        keep = good[which]
        places, which = places[keep], which[keep]
        symbols[places] = name[which].astype(np.uint64)
        rest = np.ones(len(symbols), bool)
        rest[places + 1] = False
        symbols = symbols[rest]
        lefts.append(pairs[good] >> np.uint64(22))
        rights.append(pairs[good] & np.uint64((1 << 22) - 1))
        made += int(good.sum())
    left, right = (np.concatenate([np.zeros(0, np.uint64), *x]).astype("<u4") for x in (lefts, rights))
    width = 2 if base + made <= 1 << 16 else 4
    return _HEAD.pack(base, made, len(symbols), width) + left.tobytes() + right.tobytes() + _lengths(left, right, base).astype("<u4").tobytes() + symbols.astype(f"<u{width}").tobytes()


def _lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    out = [1] * len(left)
    for k, (a, b) in enumerate(zip((left.astype(np.int64) - base).tolist(), (right.astype(np.int64) - base).tolist(), strict=True)):
        out[k] = (out[a] if a >= 0 else 1) + (out[b] if b >= 0 else 1)
    return np.array(out, np.int64)


class Segment:
    """A segment as stored, and the ids of any range of it."""

    def __init__(self, data: memoryview, at: int = 0):
        self.base, rules, n, width = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        self.left, self.right, self.length = (np.frombuffer(data, "<u4", rules, at + 4 * rules * k).astype(np.int64) for k in range(3))
        at += 12 * rules
        self.symbols = np.frombuffer(data, f"<u{width}", n, at).astype(np.int64)
        self.end = at + width * n
        sizes = np.ones(n, np.int64)
        rule = self.symbols >= self.base
        sizes[rule] = self.length[self.symbols[rule] - self.base]
        self.stops = np.cumsum(sizes)

    def __len__(self) -> int:
        return int(self.stops[-1]) if len(self.stops) else 0

    def _expanded(self, symbol: int) -> list[int]:
        out, open_ = [], [symbol]
        while open_:
            s = open_.pop()
            if s < self.base:
                out.append(s)
            else:
                open_ += [int(self.right[s - self.base]), int(self.left[s - self.base])]
        return out

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Only the symbols that cover the range are expanded."""
        lo, hi = np.searchsorted(self.stops, [start, stop - 1], side="right")
        if stop <= start:
            return np.zeros(0, np.uint32)
        out = [i for s in self.symbols[lo:hi + 1].tolist() for i in self._expanded(s)]
        skip = start - (int(self.stops[lo - 1]) if lo else 0)
        return np.array(out[skip:skip + stop - start], np.uint32)

    def all(self) -> np.ndarray:
        """Every id: rules are expanded once each, then copied."""
        size = np.concatenate([np.ones(self.base, np.int64), self.length])
        at = np.concatenate([[0], np.cumsum(size)])
        flat = np.empty(at[-1], np.uint32)
        flat[:self.base] = np.arange(self.base)
        place = at.tolist()
        for k, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True), self.base):
            lo, mid = place[k], place[k] + place[a + 1] - place[a]
            flat[lo:mid] = flat[place[a]:place[a + 1]]
            flat[mid:place[k + 1]] = flat[place[b]:place[b + 1]]
        sizes = size[self.symbols]
        return flat[np.repeat(at[self.symbols] - self.stops + sizes, sizes) + np.arange(len(self))]


def segments(data: bytes) -> list[Segment]:
    out, at = [], 0
    while at < len(data):
        out.append(Segment(memoryview(data), at))
        at = out[-1].end
    return out


def shard_ids(parts: list[Segment], start: int, stop: int) -> np.ndarray:
    """The ids of a range of a shard; segments that it doesn't touch are left alone."""
    out = [parts[k].ids(max(start - k * SEGMENT, 0), min(stop - k * SEGMENT, SEGMENT)) for k in range(start // SEGMENT, -(-stop // SEGMENT))]
    return np.concatenate([np.zeros(0, np.uint32), *out])


_ENCODERS: dict[int, Encoder] = {}


def _encoder(published: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    key = hash(published)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(published)
    return _ENCODERS[key]


def write(docs: DataFrame, path: str, folder: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every row with the vocabulary file ``path`` and writes the shards to ``folder``."""
    shared = _published(docs, path)
    d = texts(docs, id_col, text_col).withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = ["doc_id", "h", "row"]  # no ties, so that rows of one id can be dealt to several tasks
    d = d.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    kind = type_of(d, "doc_id")
    schema = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("docs", pa.list_(_ARROW[kind])), ("starts", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, nth = _encoder(shared.value), TaskContext.get().partitionId(), 0
        held, ids, total = [], [], 0

        def shard() -> pa.RecordBatch:
            every = np.concatenate(ids)
            starts = np.cumsum([0, *map(len, ids[:-1])])
            base = max(encoder.size, end + 1)
            data = b"".join(compress(every[k:k + SEGMENT], base) for k in range(0, len(every), SEGMENT))
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((part, nth, held, starts.tolist(), len(every), data), schema)], schema=schema)
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                held.append(i.as_py())
                ids.append(np.append(encoder.ids(text.as_py()), np.uint32(end)))
                total += len(ids[-1])
                if total >= SEGMENT:
                    yield shard()
                    held, ids, total, nth = [], [], 0, nth + 1
        if held:
            yield shard()
    d.mapInArrow(run, f"part int, nth int, docs array<{kind}>, starts array<bigint>, n_tokens bigint, data binary").write.parquet(folder)


def read(files: DataFrame, want: list | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in the files, or of those wanted, each decoded by its place alone."""
    return _decoded(files, want, "ids", "binary")


def checksums(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of all documents: the files are decoded whole."""
    return _decoded(files, None, "ids_crc32", "bigint")


def _decoded(files: DataFrame, want: list | None, name: str, kind: str) -> DataFrame:
    inner = files.schema["docs"].dataType.elementType.simpleString()
    # where each shard starts: sums over the shards of a part, then over the parts, of which there are as many as tasks wrote
    sizes = files.select("part", "nth", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before("n", Window.orderBy("part")).alias("first"))
    places = sizes.select("part", "nth", before("n_tokens", Window.partitionBy("part").orderBy("nth")).alias("at")).join(parts, "part")
    schema = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("doc_id", _ARROW[inner]), ("start", pa.int64()), ("n_tokens", pa.int64()), (name, _ARROW[kind])])
    wanted = None if want is None else set(want)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, nth, docs, starts, n, data in zip(*[batch.column(c) for c in ("part", "nth", "docs", "starts", "n_tokens", "data")], strict=True):
                docs, starts, found = docs.as_py(), starts.as_py(), segments(data.as_py())
                edges = [*starts, n.as_py()]
                rows = [k for k, i in enumerate(docs) if wanted is None or i in wanted]
                if name == "ids":
                    out = [shard_ids(found, edges[k], edges[k + 1]).astype("<u4").tobytes() for k in rows]
                else:
                    raw = memoryview(np.concatenate([s.all() for s in found]).astype("<u4").tobytes())
                    out = [zlib.crc32(raw[4 * edges[k]:4 * edges[k + 1]]) for k in rows]
                if rows:
                    cols = [[part.as_py()] * len(rows), [nth.as_py()] * len(rows), [docs[k] for k in rows], [edges[k] for k in rows], [edges[k + 1] - edges[k] for k in rows], out]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)
    found = files.select("part", "nth", "docs", "starts", "n_tokens", "data").mapInArrow(run, f"part int, nth int, doc_id {inner}, start bigint, n_tokens bigint, {name} {kind}")
    return found.join(places, ["part", "nth"]).select("doc_id", (F.col("first") + F.col("at") + F.col("start")).alias("start"), "n_tokens", name)
