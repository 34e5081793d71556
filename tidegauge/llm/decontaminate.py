"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are its runs of ten words (an item of fewer words is one window). A window occurs in a text only if all of
its one-word shingles do, so one of them, the rarest by document frequency over the corpus, is a sufficient prefix. Texts
are joined to windows on that shingle alone; the window must fit into the text at the relative position (length and
positional bounds) and is then verified word by word. DataFrame functions only.

Defined cases: null texts have no words; an item without words has no window; repeated rows of either table get equal
results and count an item once; null item ids are ignored; texts of any length are read whole; other columns are ignored;
an empty table on either side gives every document without hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import alnum_words, ascii_lower, folded, keyed, texts

WINDOW = 10
#: So many different shingles, or windows, go to every task as constants or a broadcast; beyond it they are joined by shuffle.
SMALL = 20_000


def windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", width: int = WINDOW) -> DataFrame:
    """(doc_id: the item, wid, words) of every window of every item."""
    d = texts(items, id_col, text_col).where(F.col("doc_id").isNotNull())
    w = d.select("doc_id", F.transform(alnum_words(F.col("text")), ascii_lower).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    long = F.least("n", F.lit(width))
    w = w.withColumn("words", F.explode(F.transform(F.sequence(F.lit(1), F.col("n") - long + 1), lambda i: F.slice("w", i, long))))
    return w.select("doc_id", F.unhex(F.md5(F.array_join("words", " "))).alias("wid"), "words").distinct()


def occurrences(d: DataFrame, wanted: DataFrame, n: int, width: int) -> DataFrame:
    """(key, n_words, i, shingle, near) of the wanted shingles in rows of (key, words, low); ``near``: the words around place i."""
    w, low, total = F.col("words"), F.col("low"), F.size("low")
    few = [r[0] for r in wanted.collect()] if n <= SMALL else None
    places = F.when(total > 0, F.sequence(F.lit(0), total - 1))
    if few is not None:
        places = F.filter(places, lambda i: F.get(low, i).isin(few))
    found = F.transform(places, lambda i: F.struct(i.alias("i"), F.get(low, i).alias("shingle"), F.slice(w, F.greatest(i - width, F.lit(0)) + 1, 2 * width + 1).alias("near")))
    out = d.select("key", total.alias("n_words"), F.explode(found).alias("o")).select("key", "n_words", "o.*")
    return out if few is not None else out.join(wanted, "shingle")


def document_frequency(d: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(shingle, df): in how many rows of (key, low) each wanted shingle occurs."""
    held = F.col("low")
    if n <= SMALL:
        few = [r[0] for r in wanted.collect()]
        held = F.filter(held, lambda w: w.isin(few))
    out = d.select(F.explode(F.array_distinct(held)).alias("shingle"))
    return (out if n <= SMALL else out.join(wanted, "shingle")).groupBy("shingle").agg(F.count("*").alias("df"))


def hits(d: DataFrame, w: DataFrame, width: int = WINDOW) -> DataFrame:
    """(key, start, length, wid) of every occurrence of a window in rows of (key, words)."""
    d = d.select("key", "words", folded(F.col("words")).alias("low"))
    w = cut_lineage(w.select("wid", "words").distinct())
    places = F.transform("words", lambda x, i: F.struct(F.lower(x).alias("shingle"), i.alias("place")))
    every = w.select("wid", F.explode(places).alias("s")).select("wid", "s.*")
    wanted = every.select("shingle").distinct()
    n = wanted.count()
    df = document_frequency(d, wanted, n)
    if n <= SMALL:
        df = F.broadcast(df)  # at most one row for each wanted shingle
    ranked = every.join(df, "shingle", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    prefix = ranked.groupBy("wid").agg(F.min_by(F.struct("shingle", "place"), F.struct("df", "shingle", "place")).alias("p")).select("wid", "p.*")
    prefix = cut_lineage(prefix.join(w, "wid"))
    rare = prefix.select("shingle").distinct()
    o = occurrences(d, rare, rare.count(), width)
    on = o.join(F.broadcast(prefix) if prefix.count() <= SMALL else prefix, "shingle")
    start, length = F.col("i") - F.col("place"), F.size("words")
    on = on.where((start >= 0) & (start + length <= F.col("n_words")))
    here = F.least("i", F.lit(width)) - F.col("place")
    same = F.transform(F.slice("near", here + 1, length), ascii_lower) == F.col("words")
    return on.where(same).select("key", start.cast("bigint").alias("start"), length.cast("bigint").alias("length"), "wid").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
                  width: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of ``docs``."""
    d = keyed(docs, id_col, text_col).select("doc_id", "key", alnum_words(F.col("text")).alias("words"))
    w = windows(items, item_id, item_text, width)
    h = hits(d, w, width)
    earlier = Window.partitionBy("key").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    fresh = F.greatest(end - F.greatest("start", F.coalesce(F.max(end).over(earlier), F.lit(0))), F.lit(0))
    hit = h.select("key", "start", "length").distinct().withColumn("fresh", fresh).groupBy("key").agg(F.sum("fresh").alias("n_hit"))
    of = w.select("wid", F.col("doc_id").cast("string").alias("item")).distinct()
    named = h.select("key", "wid").distinct().join(of, "wid").groupBy("key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    by = hit.join(named, "key")
    out = d.select("doc_id", "key", F.size("words").cast("bigint").alias("n_words")).join(by, "key", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
                      F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without an occurrence of a window, with all their columns."""
    d = docs.select(F.struct("*").alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    found = hits(d.select("key", alnum_words(F.col("text")).alias("words")), windows(items, item_id, item_text, width), width).select("key").distinct()
    return d.join(found, "key", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
