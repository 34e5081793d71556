"""How much the sources of a language differ in their words.

Counting is a sort of pointers. Each task takes its Arrow buffers slice by slice, sets a pointer at every word start, and
sorts the pointers by the word they point to: a multikey quicksort whose characters are eight bytes wide. Runs of equal words
give, for each (language, source), the occurrences and the documents that hold the word; only these sums are shuffled.

A term is a run of letters: any character but ASCII ones that aren't letters, with A-Z lower-cased. A language keeps the terms
of at least ``least_docs`` of its documents. All arithmetic is on integers; products that pass 64 bits are decimals.

The pair part compares all sources of a language over all kept terms. Terms are cut into slices of bounded size by a hash;
each slice meets the language's list of sources and gives one sum for each pair, so a task holds a slice and a matrix of
sources by sources, which is the size of the language's result.

Defined cases: null text, language and source are empty strings; a text without terms still makes its (language, source) a
group; every row is a document, so repeated rows count again; empty language and source are values like others; a language
without kept terms gives pairs of value 0; a language with one source gives no pair; texts are read whole, and a task's
memory follows its longest text; ties of value are ordered by item; other columns are ignored, whatever they are called; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

SCALE = 1_000_000_000
LEAST_DOCS, TOP = 3, 200
SLICE_BYTES = 8_000_000
#: Segments of at most so many pointers are sorted at once instead of being partitioned further.
SMALL = 1 << 15
SLICE_ROWS = 50_000
CELLS = 2_000_000

_LETTERS = np.zeros(256, np.uint8)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[ord("a"):ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_LETTERS[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
#: Keeps the first 0 to 8 bytes of a big-endian character of eight bytes.
_MASKS = np.array([(1 << 64) - (1 << (64 - 8 * k)) for k in range(9)], np.uint64)
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def pointers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased letters with eight zeros behind, word starts, word lengths); no word spans two texts."""
    letters = np.zeros(len(data) + 8, np.uint8)
    letters[:len(data)] = _LETTERS[data]
    inside = letters[:len(data)] != 0
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(first)
    return letters, starts, np.flatnonzero(last) + 1 - starts


class Pointers:
    """Word pointers in the order of their words: ``order``, and ``fresh`` where a run of equal words begins."""

    def __init__(self, letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.starts, self.lengths = starts, lengths
        # an eight-byte character at every byte of the buffer
        self.chars = np.ndarray((len(letters) - 7,), "<u8", letters.data, strides=(1,))
        self.order = np.arange(len(starts))
        self.fresh = np.zeros(len(starts), bool)
        self.fresh[:1] = True
        self._sort()

    def _load(self, pointers: np.ndarray, depth: int) -> np.ndarray:
        at = np.minimum(self.starts[pointers] + 8 * depth, len(self.chars) - 1)
        return self.chars[at].byteswap() & _MASKS[np.clip(self.lengths[pointers] - 8 * depth, 0, 8)]

    def _sort(self) -> None:
        keys, open_ = self._load(self.order, 0), [(0, len(self.order), 0)]
        while open_:
            lo, hi, depth = open_.pop()
            k = keys[lo:hi]
            if hi - lo <= SMALL:
                self._finish(lo, k, depth)
                continue
            pivot = np.sort(k[np.linspace(0, hi - lo - 1, 9).astype(int)])[4]
            parts = [np.flatnonzero(k < pivot), np.flatnonzero(k == pivot), np.flatnonzero(k > pivot)]
            by = np.concatenate(parts)
            self.order[lo:hi], keys[lo:hi] = self.order[lo:hi][by], k[by]
            less, more = lo + len(parts[0]), hi - len(parts[2])
            self.fresh[less] = True
            if more < hi:
                self.fresh[more] = True
                open_.append((more, hi, depth))
            if lo < less:
                open_.append((lo, less, depth))
            if int(pivot) & 0xFF and more - less > 1:  # words that go on behind this character
                keys[less:more] = self._load(self.order[less:more], depth + 1)
                open_.append((less, more, depth + 1))

    def _finish(self, lo: int, keys: np.ndarray, depth: int) -> None:
        """Sorts a small segment; runs that are still open go on with the next character, all of them at once."""
        rows, run = lo + np.arange(len(keys)), np.zeros(len(keys), np.int64)
        while len(rows):
            by = np.lexsort((keys, run)) if depth else np.argsort(keys)
            keys, here = keys[by], self.order[rows][by]
            self.order[rows] = here
            new = np.ones(len(rows), bool)
            new[1:] = (keys[1:] != keys[:-1]) | (run[1:] != run[:-1])
            self.fresh[rows[1:]] |= new[1:]
            run = np.cumsum(new)
            more = ((keys & np.uint64(0xFF)) != 0) & (np.bincount(run)[run] > 1)
            rows, run, depth = rows[more], run[more], depth + 1
            keys = self._load(here[more], depth)


def slice_counts(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, term of each row, group, occurrences, documents) of a slice of texts, whose groups are numbers from 0."""
    letters, starts, lengths = pointers(data, offsets)
    p = Pointers(letters, starts, lengths)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return [], none, none, none, none
    heads = p.order[p.fresh]
    raw = letters.tobytes()
    terms = [raw[s:s + n] for s, n in zip(starts[heads].tolist(), lengths[heads].tolist(), strict=True)]
    by_group = np.argsort(group, kind="stable")
    place = np.empty(len(group), np.int64)
    place[by_group] = np.arange(len(group))  # documents numbered in the order of their groups
    doc = place[np.searchsorted(offsets, starts, side="right") - 1]
    pair = np.sort((np.cumsum(p.fresh) - 1) * len(group) + doc[p.order])
    at = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    times = np.diff(np.append(at, len(pair)))
    run, own = pair[at] // len(group), group[by_group][pair[at] % len(group)]
    at = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (own[1:] != own[:-1])]))
    return terms, run[at], own[at], np.add.reduceat(times, at), np.diff(np.append(at, len(run)))


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most SLICE_BYTES, or of one row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, side="right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        langs, sources = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
        pair = langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy()
        distinct, group = np.unique(pair, return_inverse=True)
        text = batch.column(2).cast(pa.large_string())
        _, places, data = text.buffers()
        offsets = np.frombuffer(places, np.int64)[text.offset:text.offset + len(text) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        lang, source = langs.dictionary.take(pa.array(distinct // len(sources.dictionary))), sources.dictionary.take(pa.array(distinct % len(sources.dictionary)))
        zero = pa.array(np.zeros(len(distinct), np.int64))
        yield pa.RecordBatch.from_arrays([lang, source, pa.array([""] * len(distinct)), zero, zero], schema=_COUNTS)  # the groups that occur
        for lo, hi in _slices(offsets):
            terms, term, own, n, docs = slice_counts(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], group[lo:hi])
            words = pa.array(terms, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(own)), source.take(pa.array(own)), words.take(pa.array(term)), pa.array(n), pa.array(docs)], schema=_COUNTS)


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; the empty term with zeros stands for the group itself."""
    rows = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counted = rows.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, of: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + 1) / (of + terms)), exact; null if there is no term."""
    wide = f"(cast({count} as decimal(19,0)) + 1) * cast({SCALE} as decimal(10,0)) div (cast({of} as decimal(19,0)) + {terms})"
    return F.when(F.col(terms) > 0, F.expr(wide) + 1)


def _pairs(_, rows: pa.Table, groups: pa.Table) -> pa.Table:
    """The sums of one slice of terms, for each pair of sources."""
    groups = groups.sort_by("source")
    names, own = groups["source"].combine_chunks(), groups["p"].to_numpy()
    total = np.zeros((len(names), len(names)), np.int64)
    if len(rows):
        code = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        at, source, p = np.argsort(code, kind="stable"), rows["source"].combine_chunks(), rows["p"].to_numpy()
        code, p = code[at], p[at]
        source = pa.compute.index_in(source, names).to_numpy()[at]
        step = max(1, CELLS // len(names))
        for first in range(0, int(code[-1]) + 1, step):
            here = slice(*np.searchsorted(code, [first, first + step]))
            shares = np.tile(own, (min(step, int(code[-1]) + 1 - first), 1))
            shares[code[here] - first, source[here]] = p[here]
            for s in range(len(names)):
                gap = shares[:, s:s + 1] - shares
                total[s] += (gap * gap // shares).sum(axis=0)
    a, b = np.nonzero(~np.eye(len(names), dtype=bool))
    lang = pa.array([groups["lang"][0].as_py()] * len(a), pa.string())
    return pa.Table.from_arrays([lang, names.take(pa.array(a)), names.take(pa.array(b)), pa.array(total[a, b])], schema=_SUMS)


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has the distance to every other source of the language, part
    ``term`` the ``top`` terms that the source uses more often than its language does."""
    counts = stored(term_counts(docs, text_col, lang_col, source_col))
    # a term has one row for each source: few rows a key, whatever the number of documents
    by_term = Window.partitionBy("lang", "term")
    kept = counts.where("term <> ''").withColumns({"total": F.sum("n").over(by_term), "held": F.sum("docs").over(by_term), "nth": F.row_number().over(by_term.orderBy("source"))})
    kept = stored(kept.where(F.col("held") >= least_docs).select("lang", "source", "term", "n", "total", "nth"))
    langs = kept.groupBy("lang").agg(F.count_if(F.col("nth") == 1).alias("v"), F.sum("n").alias("lang_n"), F.count("*").alias("held_rows"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("source_n"))
    groups = counts.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    rows = kept.join(groups, ["lang", "source"]).withColumns({"p": share("n", "source_n", "v"), "q": share("total", "lang_n", "v")})
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = rows.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    slices = F.floor(F.col("held_rows") / SLICE_ROWS) + 1
    left = rows.select("lang", F.pmod(F.xxhash64("term"), slices).alias("slice"), "source", "term", "p")
    right = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("bigint"), slices - 1)).alias("slice"), "source", F.expr("0 as n"), "source_n", "v")
    right = right.select("lang", "slice", "source", F.coalesce(share("n", "source_n", "v"), F.lit(1)).alias("p"))
    found = left.groupBy("lang", "slice").cogroup(right.groupBy("lang", "slice")).applyInArrow(_pairs, "lang string, source string, item string, value bigint")
    pairs = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(terms)
