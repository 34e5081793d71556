"""Passages that repeat across documents, by sparse suffix arrays.

1. Of every text, only the suffixes at minimiser positions are kept: where the fingerprint of eight words is the smallest of
   24 neighbouring ones. Any 50 words hold such a position within their first 24, at the same place in every copy.
2. The suffixes are sorted by the fingerprint of their first 27 words, then by document, over range partitions, so that a
   suffix with very many occurrences spans several tasks. Neighbours are compared: a run of equal prefixes with one document
   is of no use. A run that a partition's edge cuts is settled with its other part.
3. The suffixes left are extended. To the left up to 23 words and to the right to 50, every window that has its minimiser
   there is sorted and compared in the same way; what follows on without a gap extends the match further on either side.

The result is exact, but for 64-bit fingerprints: a word is in a repeated passage if and only if some 50 consecutive words
around it also occur in another document. Words are runs without ASCII white space; A-Z are lower-cased.

Defined cases: null, empty and short texts have no passages; rows with a null id take no part; rows with one id are one
document, so a repeated row is no repetition; texts are read whole; other columns are ignored; an empty table gives an empty
table. A passage repeated only within its own document is not reported.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder
from .common import texts
from .neardup import _UPPER, Words, _stir

LENGTH, GRAM, SPREAD = 50, 8, 24
PREFIX = LENGTH - SPREAD + 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SCHEMA = pa.schema([("print", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("open", pa.bool_())])
_DDL = "print bigint, doc_id bigint, pos int, open boolean"


class Prints:
    """Fingerprints of all windows of a text, from prefix sums."""

    def __init__(self, text: str, words: Words):
        w = text.encode().translate(_UPPER).split()
        self.n = len(w)
        h = np.fromiter(map(words.__getitem__, w), np.uint64, self.n)
        power = np.full(self.n, _BASE, np.uint64)
        power[:1] = 1
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.cumprod(power, dtype=np.uint64), dtype=np.uint64)])
        back = np.full(self.n, _INVERSE, np.uint64)
        back[:1] = 1
        self.back = np.cumprod(back, dtype=np.uint64)

    def at(self, starts: np.ndarray, length: int) -> np.ndarray:
        return _stir((self.sums[starts + length] - self.sums[starts]) * self.back[starts] + np.uint64(length))

    def minimisers(self) -> np.ndarray:
        """For each start of LENGTH words, the position of its minimiser."""
        starts = self.n - LENGTH + 1
        grams = self.at(np.arange(starts + SPREAD - 1), GRAM)
        low, width = grams, 1
        where = np.arange(len(grams))
        while width < SPREAD:  # doubling: the smallest of `width` neighbours, the leftmost on ties
            step = min(width, SPREAD - width)
            left, right = low[:-step], low[step:]
            take = right < left
            low, where = np.where(take, right, left), np.where(take, where[step:], where[:-step])
            width += step
        return where


def _batch(prints: np.ndarray, docs, pos: np.ndarray, open_=None) -> pa.RecordBatch:
    n = len(prints)
    return pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(docs, pa.int64()), pa.array(pos.astype(np.int32)), pa.array(np.zeros(n, bool) if open_ is None else open_)], schema=_SCHEMA)


def suffixes(d: DataFrame) -> DataFrame:
    """(print, doc_id, pos) of the suffixes at minimiser positions of rows of (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for i, text in zip(*[c.to_pylist() for c in batch.slice(at, 64).columns], strict=True):
                    p = Prints(text, words)
                    if p.n >= LENGTH:
                        pos = np.unique(p.minimisers())
                        out.append((p.at(pos, PREFIX), np.full(len(pos), i), pos))
                if out:
                    yield _batch(*map(np.concatenate, zip(*out, strict=True)))
    return d.mapInArrow(run, _DDL)


def windows(d: DataFrame) -> DataFrame:
    """(print, doc_id, pos) of the windows whose minimiser is one of ``places``, of rows of (doc_id, text, places)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for i, text, places in zip(*[c.to_pylist() for c in batch.slice(at, 64).columns], strict=True):
                    p = Prints(text, words)
                    pos = np.flatnonzero(np.isin(p.minimisers(), np.array(places)))
                    yield _batch(p.at(pos, LENGTH), np.full(len(pos), i), pos)
    return d.mapInArrow(run, _DDL)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (print, doc_id, pos): those in runs with several documents, and (open) the runs of one document at either edge.

    At most one document's part of a run is held, and of a run already known to be shared only its last row.
    """
    held = [np.zeros(0, np.int64)] * 3
    shared, edge = False, True  # of the run that is held: already known to be shared; first of the partition
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.concatenate([a, c.to_numpy(zero_copy_only=False)]) for a, c in zip(held, batch.columns[:3], strict=True)]
        h, doc, pos = cols
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        ends = np.concatenate([starts[1:], [len(h)]])
        multi = doc[starts] != doc[ends - 1]
        skip = int(shared)  # the last row of a shared run went out before
        multi[0] |= shared
        keep = np.repeat(multi, ends - starts)
        open_ = np.zeros(len(h), bool)
        if edge and not multi[0] and len(starts) > 1:
            keep[:ends[0]] = open_[:ends[0]] = True
        last = int(starts[-1])
        edge = edge and len(starts) == 1
        shared = bool(multi[-1])
        keep[:skip] = False
        if not shared:
            keep[last:] = False
        yield _batch(h[keep], doc[keep], pos[keep], open_[keep])
        held = [c[-1:] if shared else c[last:] for c in cols]
    if len(held[0]) and not shared:
        yield _batch(*held, np.ones(len(held[0]), bool))


def stored(df: DataFrame) -> DataFrame:
    """Written as a table in the shared folder, which survives lost executors, and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/repeats-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_runs(rows: DataFrame) -> DataFrame:
    """The rows (print, doc_id, pos) whose print occurs in several documents."""
    s = rows.repartitionByRange("print", "doc_id", "pos").sortWithinPartitions("print", "doc_id", "pos").mapInArrow(_neighbours, _DDL)
    s = stored(s)
    cut = [r[0] for r in s.where("open").select("print").distinct().collect()]  # two for each partition at most
    both = s.where(F.col("print").isin(cut)).groupBy("print").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b") if cut else None
    good = [r[0] for r in both.collect()] if cut else []
    return s.where(~F.col("open") | F.col("print").isin(good)).select("print", "doc_id", "pos") if good else s.where(~F.col("open")).select("print", "doc_id", "pos")


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, n_words) of every longest run of words in repeated passages, ends exclusive."""
    d = texts(docs.withColumn(id_col, docs[id_col].cast("bigint")), id_col, text_col).where("doc_id is not null")
    found = shared_runs(stored(suffixes(d)))
    places = found.groupBy("doc_id").agg(F.collect_set("pos").alias("places"))  # positions of one text
    around = d.join(places, "doc_id").select("doc_id", "text", "places")
    w = shared_runs(stored(windows(around))).select("doc_id", "pos").distinct()
    by = Window.partitionBy("doc_id").orderBy("pos")
    w = w.withColumn("fresh", F.coalesce(F.col("pos") > F.lag("pos").over(by) + LENGTH, F.lit(True)).cast("int"))
    w = w.withColumn("nth", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    start, end = F.min("pos").cast("bigint"), (F.max("pos") + LENGTH).cast("bigint")
    return w.groupBy("doc_id", "nth").agg(start.alias("start_word"), end.alias("end_word")).select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))
