import random

from pyspark.sql import functions as F

from tests.llm.helpers import ascii_lower, awkward, docs_of, read, space_words
from tidegauge.llm import neardup
from tidegauge.llm.graph import components


def plain(rows):
    """Exact components by comparing every pair of sets."""
    sets = {}
    for i, t in rows:
        w = space_words(ascii_lower(t or ""))
        k = min(5, len(w))
        sets[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if w else set()
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), find(i), find(i) == i) for i in ids}


def test_equals_all_pairs_on_the_documents(spark):
    docs = read(spark, "documents")
    got = {tuple(r) for r in neardup.near_duplicates(docs).collect()}
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_a_cloud_of_near_copies_loses_no_link(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    rows = []
    for i in range(150):  # copies of one text with a few changed words: similarities lie around the threshold
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 2, 3])):
            w[rng.randrange(150)] = f"x{rng.randrange(10 ** 6)}"
        rows.append((1000 - i, " ".join(w)))
    got = {tuple(r) for r in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == plain(rows)


def test_chain_of_copies_is_one_component(spark):
    w = [f"a{i}" for i in range(200)]
    rows = [(i, " ".join(w[i * 6:] + [f"b{j}" for j in range(i * 6)])) for i in range(12)]
    assert {r.component_id for r in neardup.near_duplicates(docs_of(spark, rows)).collect()} == {x[2] for x in plain(rows)}


def test_awkward_rows(spark):
    out = neardup.near_duplicates(awkward(spark).withColumn("component_id", F.lit(7)).withColumn("key", F.lit("x"))).collect()
    assert len(out) == 11
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[1].n_shingles == 0 and by[1].component_id == 1 and by[2].component_id == 2 and by[4].n_shingles == 1 and by[4].kept
    assert all(r.component_id is None and r.kept for r in out if r.doc_id is None)
    assert sorted(r.component_id for r in out if r.doc_id == 5) == [5, 5]
    assert neardup.near_duplicates(docs_of(spark, [])).collect() == []


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(5, 5), (None, 3), (7, 6)]
    got = {tuple(r) for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(k, 100) for k in range(100, 160)}


def test_linked_pairs_pass_the_two_bit_test_whatever_their_size(spark):
    import numpy as np
    rng, rows = np.random.default_rng(5), []
    for n in (6, 7, 13, 20, 40, 100, 300, 1000):
        for i in range(60):
            common = rng.integers(0, 1 << 63, n, dtype=np.int64).astype(np.uint64)
            extra = rng.integers(0, 1 << 63, int(n * 15 / 85), dtype=np.int64).astype(np.uint64)  # at the threshold, or just above it
            a, b = np.unique(common), np.unique(np.concatenate([common, extra]))
            x, y = (neardup.two_bits(neardup.signature(s)) for s in (a, b))
            rows.append((n, [int(v) for v in x], [int(v) for v in y]))
    d = spark.createDataFrame(rows, "n bigint, x array<bigint>, y array<bigint>")
    agree = F.aggregate(F.zip_with("x", "y", neardup._agreeing), F.lit(0), lambda s, v: s + v)
    refused = d.where(agree < neardup.least_bins(F.col("n")))
    assert refused.where("n < 20").count() == 0 and refused.count() <= 2  # some 1e-3 of 300
    other = d.join(d.select(F.col("n").alias("m"), F.col("y").alias("z")).where("m = 1000").limit(40))
    far = F.aggregate(F.zip_with("x", "z", neardup._agreeing), F.lit(0), lambda s, v: s + v)
    assert other.where("n between 100 and 300").where(far >= neardup.least_bins(F.col("n"))).count() == 0
