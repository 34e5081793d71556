import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, awkward, docs_of, read
from tidegauge.llm import merkle

H = lambda s: sha256(s.encode()).hexdigest()


def leaf(r, text=None):
    values = [r.doc_id, r.source, r.lang, r.n_chars, r.text if text is None else text]
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fanout):
    """(top, steps of every node)."""
    steps = [[] for _ in nodes]
    place = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            at = p - p % fanout
            steps[i].append(("".join(nodes[at:p]), "".join(nodes[p + 1:at + fanout])))
            place[i] = p // fanout
        nodes = [H("".join(nodes[k:k + fanout])) for k in range(0, len(nodes), fanout)]
    return nodes[0], steps


def plain(rows, fanout=3):
    by = defaultdict(list)
    for r in rows:
        by[(r.source is not None, (r.source or "").encode())].append(r)
    subs, paths = {}, {}
    for s, rs in by.items():
        rs.sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r)))
        subs[s], paths[s] = climb([leaf(r) for r in rs], fanout)
    order = sorted(by)
    root, upper = climb([subs[s] for s in order], fanout) if order else (None, [])
    out = Counter()
    for s, above in zip(order, upper):
        for r, own in zip(by[s], paths[s]):
            path = own + above
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.text is not None
            h = leaf(r, r.text.replace("\n", "")) if changed else leaf(r)
            for a, b in path:
                h = H(a + h + b)
            out[r.doc_id, leaf(r), subs[s], root, H("".join(a + b for a, b in path)), h, h == root] += 1
    return out


def got(d, **more):
    return Counter(tuple(r)[:7] for r in merkle.manifest(d, other=merkle.tampered_leaf(d), **more).collect())


def made(spark, sizes):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a\nb", "x", "", None, "é\n"]), rng.choice(["en", None]), s, rng.choice([None, 5])) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("levels", [0, 1, 2, 7])
def test_against_plain(spark, levels):
    d = made(spark, {None: 4, "": 1, "a": 2, "b": 3, "hot": 100, "ü": 10, "z": 28})
    assert got(d, levels=levels) == plain(d.collect())


def test_other_fanouts(spark):
    d = made(spark, {"a": 37, "b": 1, "c": 16, "d": 5})
    for fanout in (2, 5):
        out = merkle.manifest(d, other=merkle.tampered_leaf(d), fanout=fanout, levels=1).collect()
        assert Counter(map(tuple, out)) == plain(d.collect(), fanout)


def test_the_exchange_reaches_every_member(spark):
    for m in (1, 2, 3, 4, 8, 9, 10, 25, 28):
        none = F.array().cast("array<string>")
        state = spark.range(m).select(F.lit("t").alias("tree"), F.lit("t").alias("name"), F.col("id").alias("b"), F.lit(m).cast("bigint").alias("m"), F.format_string("n%d", "id").alias("node"), none.alias("lefts"), none.alias("rights"))
        top, steps = climb([f"n{i}" for i in range(m)], 3)
        out = {r.b: r for r in merkle.butterfly(state).collect()}
        assert len(out) == m and {r.node for r in out.values()} == {top}
        assert all(list(zip(r.lefts, r.rights)) == steps[b] for b, r in out.items())


def test_documents_and_proofs(spark):
    d = read(spark, "documents")
    assert got(d) == plain(d.collect())
    out = merkle.manifest(d, levels=2, with_proof=True)
    row = out.select(F.count_if(merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("good"), F.count_if("verified").alias("said"), F.count("*").alias("n"),
                     F.count_if(merkle.folded(F.lit("0"), F.col("proof")) == F.col("root")).alias("bad")).first()
    assert row.good == row.said == row.n == d.count() and row.bad == 0


def test_awkward_rows(spark):
    d = awkward(spark)
    more = d.withColumn("tree", F.lit(1)).withColumn("leaf", F.lit("x")).withColumn("pos", F.lit(0))
    assert got(more) == plain(d.collect())
    assert merkle.manifest(docs_of(spark, [])).collect() == []
    assert got(docs_of(spark, [(7, "only\n")])) == plain(docs_of(spark, [(7, "only\n")]).collect())
