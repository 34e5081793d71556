"""Near copies by one-permutation MinHash.

1. Shingle sets (distinct five-word shingles as 64-bit fingerprints). Documents with equal sets form a class at once; its
   smallest id stands for it, so a group of copies of any size is one node.
2. One permutation: the fingerprint range is cut into 448 bins, each holding its smallest fingerprint. An empty bin takes
   the value of the first filled bin on a probe sequence of its own (optimal densification).
3. Bands of eight bins give 56 bucket keys. A pair at the threshold shares no bucket with a probability of 2e-8.
4. In each bucket every node is paired with the smallest one only (a star), and pairs are confirmed on full sets.
5. A star misses links between nodes that are not like its centre. So in buckets whose nodes are still in several
   components, the nodes outside the largest component meet the nodes of other components, where sizes allow a link and
   two bits of each bin agree as a link's do; each pair only in the first bucket it shares. What a link's bins must
   agree in depends on the smaller set: a set with fewer shingles than bins fills several with each, so its estimate
   varies more. Three deviations are allowed, and sets of under twenty shingles always pass; a link of larger sets that no star has
   found fails with a probability of about 1e-3 at most. These pairs are confirmed on full sets too.

Defined cases: null and empty texts have no shingles and stay alone; a text under five words is one shingle; repeated rows
get equal results; a row with a null id is linked with nothing and kept, its component is null; columns other than id and
text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_rows, texts
from .graph import components

ROWS, BANDS, SHINGLE = 8, 56, 5
BINS = ROWS * BANDS
LEAST_PERCENT = 85
#: The two-bit test: the estimate below which a pair of large sets is no candidate, and how far, in standard deviations, that of
#: smaller sets may fall short of the threshold.
LEAST_LIKE, DEVIATIONS = 0.77, 3
_UPPER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _stir(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that any bits of the result are usable."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit fingerprints of words; emptied when full."""

    def __missing__(self, w: bytes) -> int:
        v = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
        if len(self) >= 400_000:
            self.clear()
        self[w] = v
        return v


def shingles(text: str, words: Words) -> np.ndarray:
    """The sorted distinct shingle fingerprints of a text."""
    w = text.encode().translate(_UPPER).split()
    n = len(w)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, w), np.uint64, n)
    k = min(SHINGLE, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = _stir(out * _MIX + h[i:n - k + 1 + i])
    return np.unique(out)


def _probes() -> np.ndarray:
    """Column i: the bins that an empty bin i asks, in order."""
    at, i = np.meshgrid(np.arange(1, 257, dtype=np.uint64), np.arange(BINS, dtype=np.uint64), indexing="ij")
    return (_stir(at * _MIX + i) % np.uint64(BINS)).astype(np.int64)


PROBES = _probes()


def signature(fingerprints: np.ndarray) -> np.ndarray:
    """Smallest fingerprint of each bin, empty bins densified. The set is sorted and not empty; bins are equal slices of its range."""
    bins = (((fingerprints >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out, filled = np.zeros(BINS, np.uint64), np.zeros(BINS, bool)
    out[bins[first]], filled[bins[first]] = fingerprints[first], True
    empty, original = np.flatnonzero(~filled), filled
    for asks in PROBES:
        if not len(empty):
            return out
        asked = asks[empty]
        found = original[asked]
        out[empty[found]] = out[asked[found]]
        empty = empty[~found]
    out[empty] = fingerprints[0]  # the same rule for every set: what no probe finds takes the smallest of all
    return out


def bucket_keys(sig: np.ndarray) -> np.ndarray:
    b = sig.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for i in range(ROWS):
        out = _stir(out * _MIX + b[:, i])
    return out.view(np.int64)


def two_bits(sig: np.ndarray) -> np.ndarray:
    """Two bits of every bin, 32 bins to a 64-bit number."""
    shifts = np.arange(0, 64, 2, dtype=np.uint64)
    return np.bitwise_or.reduce((sig & np.uint64(3)).reshape(-1, 32) << shifts, axis=1).view(np.int64)


def sketches(d: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, set_key, keys, bits) of every row of (doc_id, text); keys and bits are null where the set is empty."""
    def make():
        words = Words()

        def run(ids, rows):
            out: list[list] = [ids, [], [], [], []]
            for text in rows:
                s = shingles(text, words)
                sig = signature(s) if len(s) else None
                for column, value in zip(out[1:], (len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(),
                                                   None if sig is None else bucket_keys(sig), None if sig is None else two_bits(sig)), strict=True):
                    column.append(value)
            return out
        return run
    return map_rows(d, make, [("doc_id", "bigint"), ("n_shingles", "bigint"), ("set_key", "binary"), ("keys", "array<bigint>"), ("bits", "array<bigint>")])


def full_sets(d: DataFrame) -> DataFrame:
    """(node, shingles) of rows of (doc_id, text)."""
    def make():
        words = Words()
        return lambda ids, rows: [ids, [shingles(t, words).view(np.int64) for t in rows]]
    return map_rows(d, make, [("node", "bigint"), ("shingles", "array<bigint>")])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are alike enough."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("i"))
    return both.where(100 * F.col("i") >= LEAST_PERCENT * (F.col("n") - F.col("i"))).select("a", "b")


def sizes_fit(n, m):
    """A link needs sets whose sizes are as near as this."""
    return 100 * F.least(n, m) >= LEAST_PERCENT * F.greatest(n, m)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    d = texts(docs.withColumn(id_col, docs[id_col].cast("bigint")), id_col, text_col)
    base = cut_lineage(sketches(d))
    full = base.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # written, so that the joins below stand alone in their stages and a set with very many copies is split
    classes = cut_lineage(full.groupBy("set_key").agg(F.min("doc_id").alias("node")))
    # a repeated row makes a repeated member of a bucket, which changes no minimum, pair or component
    reps = cut_lineage(full.join(classes, "set_key").where("doc_id = node").select("node", "n_shingles", "keys", "bits"))
    entries = reps.select("node", F.explode("keys").alias("bucket"))
    centres = entries.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last").drop("last")
    members = cut_lineage(entries.join(centres, "bucket"))
    star = members.where("centre < node").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    size = reps.select("node", "n_shingles").distinct()
    star = star.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").where(sizes_fit(F.col("na"), F.col("nb"))).select("a", "b")
    nodes = members.select(F.col("node").alias("doc_id")).distinct()
    sets = cut_lineage(full_sets(d.join(nodes, "doc_id", "left_semi").dropDuplicates(["doc_id"])))
    links = cut_lineage(confirmed(star, sets))
    first = components(links)
    links = links.unionByName(confirmed(untried(members, first, reps), sets))
    found = components(links)
    node = full.join(classes, "set_key").join(found, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    alone = base.where((F.col("n_shingles") == 0) | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return node.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def least_bins(n):
    """Two-bit bins in which a linked pair agrees, but for DEVIATIONS, if its smaller set has ``n`` shingles: an estimate from as many
    independent values as there are filled bins, and a quarter of the other bins by chance."""
    like = LEAST_PERCENT / 100
    low = F.least(F.lit(LEAST_LIKE), like - DEVIATIONS * F.sqrt(like * (1 - like) / F.least(n, F.lit(BINS))))
    return F.when(n < 20, 0).otherwise(F.floor(BINS * (0.25 + 0.75 * low)))


def untried(members: DataFrame, found: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of nodes that share a bucket, are in different components, and not both in the bucket's largest one."""
    now = members.select("bucket", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    by = now.groupBy("bucket", "component").agg(F.count("*").alias("n"))
    largest = by.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("parts")).where("parts > 1")
    open_ = now.join(largest.drop("parts"), "bucket").join(reps.dropDuplicates(["node"]), "node").withColumn("band", F.array_position("keys", F.col("bucket")))
    open_ = cut_lineage(open_)
    few = open_.where("component <> largest").select(*[F.col(c).alias(f"{c}_a") for c in open_.columns])
    agree = F.aggregate(F.zip_with("bits_a", "bits", _agreeing), F.lit(0), lambda s, x: s + x)
    shared = F.array_position(F.zip_with("keys_a", "keys", lambda p, q: p == q), True)
    # of two nodes outside the largest component each would meet the other: the smaller one asks
    once = (F.col("component") == F.col("largest")) | (F.col("node_a") < F.col("node"))
    on = (F.col("bucket_a") == F.col("bucket")) & (F.col("component_a") != F.col("component")) & once & sizes_fit(F.col("n_shingles_a"), F.col("n_shingles"))
    pairs = few.join(open_, on & (agree >= least_bins(F.least("n_shingles_a", "n_shingles"))) & (shared == F.col("band")))
    return pairs.select(F.col("node_a").alias("a"), F.col("node").alias("b")).distinct()


def _agreeing(p, q):
    """How many of the 32 two-bit bins of two numbers agree."""
    x = p.bitwiseXOR(q)
    return 32 - F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
