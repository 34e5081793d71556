"""Licence scans over a positional index of rare words.

Templates (short phrases and longer notices) are posted by their rare words with the word's place in the template. A text's
licence words with the highest IDF over the corpus are looked up; where a posting and a text's word agree, the template is
laid over the text at that relative position, its mandatory key phrase is verified word by word, and the share of its words
that stand where they should is its score. DataFrame functions only; the only thing gathered is the document frequency of
the templates' words, a table of fixed size.

Defined cases: null and empty texts have no words and no labels; repeated rows get equal results; null ids are kept; texts
of any length are read whole; columns other than id and text are ignored; an empty table gives an empty table. A word that
occurs in no document has the highest IDF; equal IDF is broken by the word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, ascii_lower, fixed_table, folded, keyed


@dataclass(frozen=True)
class Template:
    """``key`` is the mandatory phrase; it stands in ``words`` once."""

    label: str
    words: str
    key: str
    base: bool = False

    @property
    def at(self) -> int:
        w, k = self.words.split(), self.key.split()
        return next(i for i in range(len(w)) if w[i:i + len(k)] == k)


#: The base phrases and their labels.
BASE = (Template("mit", "mit license", "mit license", True), Template("apache", "apache license", "apache license", True),
        Template("gpl", "general public license", "general public license", True))
#: Openings of further public licences and notices.
MORE = (
    Template("agpl", "gnu affero general public license", "affero general public license"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy", "hereby granted free of charge"),
    Template("apache", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu", "free software you can redistribute it"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose", "copy modify and or distribute this software"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc", "licensed under a creative commons attribution", "creative commons attribution"),
    Template("proprietary", "all rights reserved", "all rights reserved"),
)
TEMPLATES = BASE + MORE
LEAST_SHARE = 0.6
REACH = max(len(t.words.split()) for t in TEMPLATES)


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for t in templates for w in t.words.split()})


def document_frequency(d: DataFrame, words: list[str]) -> dict[str, int]:
    """In how many rows of (words) each of the given words occurs: one pass, as many counts as words."""
    held = F.array_distinct(F.filter(folded(F.col("words")), lambda w: w.isin(words)))
    return {r["w"]: r["count"] for r in d.select(F.explode(held).alias("w")).groupBy("w").count().collect()}


def postings(df: dict[str, int], templates=TEMPLATES) -> list[tuple[str, int, int]]:
    """(word, template, place): each template under the rarest word of its key phrase, at each place the phrase has it."""
    out = []
    for n, t in enumerate(templates):
        key = t.key.split()
        rare = min(key, key=lambda w: (df.get(w, 0), w))
        out.append((rare, n, t.at + key.index(rare)))
    return out


def places(d: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(key, label, base, start, score) of every verified place of a template in rows of (key, words)."""
    spark = d.sparkSession
    df = document_frequency(d, vocabulary(templates))
    posted = postings(df, templates)
    table = fixed_table(spark, [(w, n, at, t.label, t.base, t.words.split(), t.at, t.key.split()) for w, n, at in posted for t in [templates[n]]],
                                  "word string, template int, place int, label string, base boolean, wanted array<string>, key_at int, key_words array<string>")
    rare = sorted({w for w, _, _ in posted})
    # a rare word takes along the words around it, so that nothing else of the text is needed to verify
    w, low = F.col("words"), F.col("low")
    at_rare = F.filter(F.sequence(F.lit(0), F.size(low) - 1), lambda i: F.get(low, i).isin(rare))
    around = F.transform(F.when(F.size(low) > 0, at_rare), lambda i: F.struct(i.alias("i"), F.transform(F.slice(w, F.greatest(i - REACH, F.lit(0)) + 1, 2 * REACH + 1), ascii_lower).alias("near")))
    d = d.select("key", "words", folded(w).alias("low"))
    hits = d.select("key", F.explode(around).alias("h")).select("key", "h.*")
    here = F.least(F.col("i"), F.lit(REACH))
    hits = hits.withColumn("word", F.element_at("near", here + 1))
    on = hits.join(F.broadcast(table), "word")  # one row for each template
    at = lambda j: F.get("near", F.col("here") - F.col("place") + j)
    on = on.withColumn("here", here)
    verified = F.forall(F.transform("key_words", lambda x, j: at(F.col("key_at") + j).eqNullSafe(x)), lambda ok: ok)
    agree = F.size(F.filter(F.transform("wanted", lambda x, j: at(j).eqNullSafe(x)), lambda ok: ok))
    share = agree / F.size("wanted")
    return on.where(verified).select("key", "label", "base", (F.col("i") - F.col("place")).cast("bigint").alias("start"), share.alias("score")).where(F.col("score") >= LEAST_SHARE)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    d = keyed(docs, id_col, text_col)
    words = d.select("doc_id", "key", alnum_words(F.col("text")).alias("words"))
    found = places(words, templates).distinct()  # repeated rows have equal keys
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    base = F.col("base")
    by = found.groupBy("key").agg(
        F.sum(base.cast("bigint")).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("score").alias("score"))
    return words.select("doc_id", "key", F.size("words").cast("bigint").alias("n_words")).join(by, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("bigint").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
