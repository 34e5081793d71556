"""Plain versions that the Spark operators are held against, and small awkward tables."""

from __future__ import annotations

import re

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SF = "/root/testdata/sf0.001"


def docs_of(spark, rows):
    """(doc_id, text) pairs as a documents table."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def read(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))


def awkward(spark):
    """Null ids and texts, empty and repeated rows, a long text, characters of several bytes."""
    long = "password=abcdefgh1 " + "word " * 30_000
    return docs_of(spark, [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (5, long), (5, long), (None, "one two three four five six"),
                           (None, None), (6, "Ünïcödé 😀 İK K ſ tokens — ½ \u0085  x"), (7, "one two three four five six")])
