"""What the corpus operators share: column clean-up, row keys, exact chunking of Arrow batches."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Fixed values of the word definitions, as Java and RE2 both read them.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lower-cased: upper-case letters are inside words too.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_GAP_CHARS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(),
          "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
          "array<struct<start:bigint,end:bigint,score:double>>": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))}


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text); a null text is the empty one, other columns go, whatever they are called."""
    return docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, key): equal keys mean equal id and equal text, so a null or repeated id does no harm in a join."""
    d = texts(docs, id_col, text_col)
    return d.withColumn("key", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("text")))))


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def alnum_words(c: Column) -> Column:
    """The words of a text, not yet lower-cased, as an array. Trimmed first, so that no empty piece is left to filter."""
    bare = F.btrim(c, F.lit(_GAP_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, ALNUM_GAP, -1))


def folded(words: Column) -> Column:
    """Words in the engine's lower case, which folds more than A-Z: equal words stay equal, so it is fit to find candidates."""
    return F.transform(words, F.lower)


def map_rows(df: DataFrame, make: Callable[[], Callable[..., list]], ddl: list[tuple[str, str]], rows: int = 256) -> DataFrame:
    """``make()`` runs once a task; the function it gives turns lists of the input columns into lists of the output columns.

    Batches are cut to ``rows`` rows, so what Python holds of long texts is bounded.
    """
    schema = pa.schema([(n, _ARROW[t]) for n, t in ddl])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(*[c.to_pylist() for c in batch.slice(at, rows).columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return df.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in ddl))


def fixed_table(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A table written in code, as a constant of the plan."""
    names = [x.split()[0] for x in ddl.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in ddl.split(', '))}>>")))


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Written as a table in the shared folder, which survives lost executors, and read again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
