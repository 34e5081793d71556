"""A Merkle manifest of a table: leaf, subroot, root and proof of every row, by butterfly exchange.

The leaves of a source, in the order of their ids, are cut into aligned partitions of ``fanout ** levels`` leaves. Each
partition hashes its own subtree. Then, round by round, the ``fanout`` partitions of an aligned group that have the same
place in their subtrees swap subtree roots, and every one of them hashes the common parent itself. After the last round each
partition holds the upper part of its documents' proofs, so nothing is sent down again. A subtree that is cut short by the
end of the source lacks places; its last partition stands in for them. Sources are members of one more exchange, whose
leaves are the subroots in the order of the sources; its rounds are swapped by one member for each source.

H is SHA-256 in lowercase hex, of the inputs put one after the other. A node is H of its run of up to ``fanout`` consecutive
children, even of a lone one, while a level has several nodes; a lone leaf is its own subroot. A step of a proof is what
stands left and right of a node in its run; :func:`folded` gives the root that a leaf and a proof lead to.

Defined cases: each null value is ``-``, an empty one ``0:``; null sources are one source, the first; null ids come first in
their source and are never tampered with; rows with one id are ordered by leaf, and repeated rows have equal leaves and one
place each; texts are read whole; other columns are ignored, whatever they are called; an empty table gives an empty table.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, type_of

FANOUT = 3
#: Levels that one partition hashes by itself.
LEVELS = 7
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(values: list[Column]) -> Column:
    """H of the values, each as its length in bytes, a colon and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof (array of (left, right)) lead to."""
    return F.aggregate(proof, leaf, lambda h, step: F.sha2(F.concat(step["left"], h, step["right"]), 256))


def _h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def depth(n: int, fanout: int) -> int:
    """Levels above n nodes."""
    k = 0
    while n > 1:
        n, k = -(-n // fanout), k + 1
    return k


def placed(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Adds ``pos``, the place of each row in its tree from 0, and ``total``, their number.

    Rows are sorted over range partitions; each partition counts its part of a tree and the counts are summed up, so a tree
    of any size is many tasks. ``order`` must end in a column without ties.
    """
    s = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    s = stored(s.withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    parts = s.groupBy(tree, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    by = Window.partitionBy(tree)  # one row for each partition that holds a part of the tree
    before = F.coalesce(F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(tree, "part", (before - F.col("first")).alias("shift"), F.sum("n").over(by).alias("total"))
    return s.join(parts, [tree, "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def butterfly(state: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """``state`` has one row for each member: tree, name, b (place), m (members of the tree), node, lefts, rights (steps so far).

    Returns it with the tree's root as node and the steps to it. In round r members whose places differ in digit r alone,
    in base ``fanout``, meet; a group has ``fanout`` rows at most.
    """
    largest = state.agg(F.max("m")).first()[0] or 0
    for r in range(depth(largest, fanout)):
        width = fanout ** r
        busy = F.col("m") > width
        state = state.withColumns({"busy": busy, "i": F.floor(F.col("b") / width), "low": F.col("b") % width})
        lacks = (F.col("b") == F.col("m") - 1) & (F.col("i") % fanout > 0) & (F.col("low") < width - 1) & F.col("busy")
        places = F.when(lacks, F.sequence("low", F.lit(width - 1).cast("bigint"))).otherwise(F.array("low"))
        # a tree that is done stays as it is: its one node is group and run by itself
        sent = state.withColumn("place", F.explode(places)).withColumn("own", F.col("place") == F.col("low"))
        run = F.array_sort(F.collect_list(F.struct("i", "node", "b", "m", "name", "own", "busy", "lefts", "rights")))
        met = sent.groupBy("tree", F.when(F.col("busy"), F.floor(F.col("i") / fanout)).otherwise(-1 - F.col("b")).alias("grp"), "place").agg(run.alias("run"))
        met = met.withColumn("x", F.explode(F.filter("run", lambda y: y["own"])))
        beside = [F.concat_ws("", F.transform(F.filter("run", which), lambda y: y["node"])) for which in
                  (lambda y: y["i"] < F.col("x.i"), lambda y: y["i"] > F.col("x.i"), lambda y: F.lit(True))]
        added = [F.when(F.col("x.busy"), F.concat(F.col(f"x.{c}"), F.array(b))).otherwise(F.col(f"x.{c}")).alias(c) for c, b in zip(("lefts", "rights"), beside)]
        state = met.select("tree", "x.name", "x.b", "x.m", F.when(F.col("x.busy"), F.sha2(beside[2], 256)).otherwise(F.col("x.node")).alias("node"), *added)
    return state


def _levels(leaves: list[str], levels: int, fanout: int) -> list[list[str]]:
    out = [leaves]
    for _ in range(levels):
        below = out[-1]
        out.append([_h("".join(below[at:at + fanout])) for at in range(0, len(below), fanout)])
    return out


def _own_levels(rows: pa.Table, levels: int, fanout: int) -> int:
    """Levels hashed inside a partition: all of them, unless the whole source is in it."""
    total = rows["total"][0].as_py()
    return levels if total > fanout ** levels else depth(total, fanout)


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", other: Column | None = None,
             fanout: int = FANOUT, levels: int = LEVELS, with_proof: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), and with ``with_proof`` the proof itself.

    ``other`` is the leaf that is to be verified against the proof, such as that of a changed row; null means the row's own.
    """
    own = leaf([docs[c] for c in columns])
    tree = F.coalesce(F.concat(F.lit("s"), docs[group_col].cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), docs[id_col].alias("doc_id"), own.alias("leaf"), (F.lit(None).cast("string") if other is None else other).alias("other"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))  # the texts are read once
    size = fanout ** levels
    rows = stored(placed(rows, "tree", ["doc_id", "leaf", "row"]).withColumn("b", F.floor(F.col("pos") / size)).drop("row"))

    def roots(key, part):
        part = part.sort_by("pos")
        node = _levels(part["leaf"].to_pylist(), _own_levels(part, levels, fanout), fanout)[-1][0]
        return pa.table({"tree": [key[0].as_py()], "b": [key[1].as_py()], "m": [-(-part["total"][0].as_py() // size)], "node": [node]})

    none = F.array().cast("array<string>")
    state = rows.select("tree", "b", "pos", "total", "leaf").groupBy("tree", "b").applyInArrow(roots, "tree string, b bigint, m bigint, node string")
    state = stored(state.select("tree", F.col("tree").alias("name"), "b", "m", "node", none.alias("lefts"), none.alias("rights")))
    state = stored(butterfly(state, fanout))
    sources = placed(state.where("b = 0").select(F.lit("").alias("tree"), "name", "node"), "tree", ["name"])
    sources = sources.select("tree", "name", F.col("pos").alias("b"), F.col("total").alias("m"), "node", none.alias("lefts"), none.alias("rights"))
    tops = butterfly(stored(sources), fanout).select(F.col("name").alias("tree"), F.col("node").alias("root"), F.col("lefts").alias("l"), F.col("rights").alias("r"))
    upper = state.join(tops, "tree").select("tree", "b", F.col("node").alias("subroot"), "root", F.concat("lefts", "l").alias("lefts"), F.concat("rights", "r").alias("rights"))
    ddl = [("doc_id", type_of(rows, "doc_id")), ("leaf", "string"), ("subroot", "string"), ("root", "string"), ("proof_sha256", "string"), ("folded_root", "string"), ("verified", "boolean")]
    if with_proof:
        ddl.append(("proof", "array<struct<left:string,right:string>>"))

    def proofs(_, part, above):
        part = part.sort_by("pos")
        (subroot,), (root,), (lefts,), (rights,) = (above[c].to_pylist() for c in ("subroot", "root", "lefts", "rights"))
        hashed = _levels(part["leaf"].to_pylist(), _own_levels(part, levels, fanout), fanout)
        shared = list(zip(lefts, rights, strict=True))
        said, steps = ["".join(a + b for a, b in shared)], []
        for nodes in hashed[-2::-1]:  # from the top, so that what leaves share is put together once
            beside = []
            for i in range(len(nodes)):
                at = i - i % fanout
                beside.append(("".join(nodes[at:i]), "".join(nodes[i + 1:at + fanout])))
            said = [a + b + said[i // fanout] for i, (a, b) in enumerate(beside)]
            steps.insert(0, beside)
        out: dict[str, list] = {"said": [_h(s) for s in said], "fold": [], "proof": []}
        for i, (mine, changed) in enumerate(zip(hashed[0], part["other"].to_pylist(), strict=True)):
            h, path = changed or mine, []
            for beside in steps:
                path.append(beside[i])
                i //= fanout
            path += shared
            for a, b in path:
                h = _h(a + h + b)
            out["fold"].append(h)
            if with_proof:
                out["proof"].append([{"left": a, "right": b} for a, b in path])
        n = len(part)
        cols = [part["doc_id"], part["leaf"], [subroot] * n, [root] * n, out["said"], out["fold"], [f == root for f in out["fold"]], *([out["proof"]] if with_proof else [])]
        kinds = [None] * 7 + [pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, k) for c, k in zip(cols, kinds)], names=[n for n, _ in ddl])

    left = rows.select("tree", "b", "pos", "total", "doc_id", "leaf", "other")
    return left.groupBy("tree", "b").cogroup(upper.groupBy("tree", "b")).applyInArrow(proofs, ", ".join(f"{n} {t}" for n, t in ddl))


def tampered_leaf(docs: DataFrame) -> Column:
    """The leaf of a row whose text lost its line ends, where the checksum of the id is even; else null."""
    even = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0
    changed = leaf([F.replace(docs["text"], F.lit("\n"), F.lit("")) if c == "text" else docs[c] for c in COLUMNS])
    return F.when(even & F.contains(docs["text"], F.lit("\n")), changed)
