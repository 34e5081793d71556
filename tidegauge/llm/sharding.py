"""Shards by vector bin packing.

Every group (equal texts) has a vector of bytes, tokens and rows. Groups over half a shard in any dimension are cut into
pieces of an eighth of a shard by a hash of the id; all others stay whole and are gathered by a hash of the text into a fixed
number of bundles. Pieces and bundles, the largest first, go to the shard with room for them whose residual capacity has the
highest dot product with their vector. Only the bundles' sums reach the driver: their number is a parameter, and so few
groups can be over half a shard.

Bundles are many and small, so the last of them even out what large groups leave; the law that holds is ``bytes``.

Defined cases: a null text has no bytes and counts 8 for its row; null texts and empty texts are one group; repeated rows
are rows of their own and get slots of their own; null ids are hashed as such; other columns are ignored; an empty table
gives an empty table. Equal sizes are broken by the bundle's number, rows of a bundle are ordered by text and id.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage
from .common import SPACE_WORD, fixed_table

SHARDS = 24
ROW_BYTES = 8
#: Bundles for each shard: the largest sizes differ by about one bundle, 1/512 of a shard.
BUNDLES = 512
DIMENSIONS = ("size", "tokens", "rows")


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (bytes, tokens, rows), all packed by dot product with the residual capacity."""
    total = vectors.sum(axis=0).clip(min=1)
    unit = vectors / total * shards  # in shards
    order = np.lexsort((np.arange(len(unit)), -unit[:, 0], -unit.max(axis=1)))
    room = np.ones((shards, unit.shape[1]))
    out = np.zeros(len(unit), dtype=int)
    for i in order:
        v = unit[i]
        fits = (room >= v).all(axis=1)
        # bytes decide among shards that are full in some dimension, so their sizes stay equal to the last
        s = int(np.argmax(np.where(fits, room @ v, -np.inf))) if fits.any() else int(np.argmax(room[:, 0]))
        out[i] = s
        room[s] -= v
    return out


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, bundles: int = BUNDLES) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    text = F.coalesce(docs[text_col], F.lit(""))
    n = bundles * shards
    rows = docs.select(
        docs[id_col].alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.regexp_count(text, F.lit(SPACE_WORD)).cast("bigint").alias("tokens"), F.unhex(F.md5(text)).alias("grp"))
    rows = cut_lineage(rows.withColumn("part", F.pmod(F.xxhash64("grp"), F.lit(n)).cast("int")))  # the texts are read once
    sums = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*sums).first()
    if not total["rows"]:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    share = F.greatest(*[F.col(d) * shards / max(1, total[d]) for d in DIMENSIONS])
    groups = rows.groupBy("grp").agg(*sums).where(share > 0.5).select("grp", (F.ceil(share * 8)).cast("int").alias("pieces"))
    large = sorted((bytes(r["grp"]), r["pieces"]) for r in groups.collect())  # 6 x shards at most
    first, at = {}, n
    for g, pieces in large:
        first[g], at = at, at + pieces
    if large:
        table = fixed_table(docs.sparkSession, [(g.hex(), first[g], pieces) for g, pieces in large], "hex string, first int, pieces int").select(F.unhex("hex").alias("grp"), "first", "pieces")
        piece = F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("int")
        rows = rows.join(F.broadcast(table), "grp", "left").withColumn("part", F.coalesce(piece, "part"))
    found = sorted(map(tuple, rows.groupBy("part").agg(*sums).collect()))  # bundles x shards, and the pieces
    target = place(np.array([f[1:] for f in found], dtype=float), shards)
    used, start = [0] * shards, []
    for (part, _, _, count), s in zip(found, target.tolist(), strict=True):
        start.append((part, s, used[s]))
        used[s] += count
    table = fixed_table(docs.sparkSession, start, "part int, shard int, start bigint")
    nth = F.row_number().over(Window.partitionBy("part").orderBy("grp", "doc_id"))
    return rows.withColumn("nth", nth).join(F.broadcast(table), "part").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
