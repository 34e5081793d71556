import random

from tests.llm.helpers import ascii_lower, awkward, docs_of, read, space_words
from tidegauge.llm import repeats


def plain(rows):
    """Runs of words in 50-word windows that another document has too."""
    words = {}
    for i, t in rows:
        words[i] = space_words(ascii_lower(t or ""))
    where = {}
    for i, w in words.items():
        for s in range(len(w) - 49):
            where.setdefault(tuple(w[s:s + 50]), set()).add(i)
    out = set()
    for i, w in words.items():
        end = None
        for s in range(len(w) - 49):
            if len(where[tuple(w[s:s + 50])]) > 1:
                if end is None or s > end:
                    if end is not None:
                        out.add((i, start, end, end - start))
                    start = s
                end = s + 50
        if end is not None:
            out.add((i, start, end, end - start))
    return out


def test_equals_all_windows_on_the_documents(spark):
    docs = read(spark, "documents")
    got = [tuple(r) for r in repeats.passages(docs).collect()]
    assert set(got) == plain([(r.doc_id, r.text) for r in docs.collect()]) and len(got) == len(set(got)) > 0


def test_planted_passages_at_and_below_the_length(spark):
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"q{rng.randrange(10 ** 9)}" for _ in range(n))
    fifty, short, own = fresh(50), fresh(49), fresh(80)
    rows = [(1, f"{fresh(70)} {fifty} {fresh(9)}"), (2, f"{fifty} {fresh(300)}"), (3, f"{fresh(40)} {short} {fresh(40)}"), (4, f"{fresh(4)} {short}"),
            (5, f"{own} {fresh(5)} {own}"), (6, fresh(500)), (7, fifty.upper())] + [(100 + i, f"{fresh(30)} {fifty} {fresh(30)}") for i in range(60)]
    got = {tuple(r) for r in repeats.passages(docs_of(spark, rows).repartition(7)).collect()}
    assert got == plain(rows) and {1, 2, 7, 100, 159} <= {r[0] for r in got} and not {3, 4, 5, 6} & {r[0] for r in got}


def test_a_run_over_many_partitions_and_edges(spark):
    rng = random.Random(4)
    one = " ".join(f"z{rng.randrange(10 ** 9)}" for _ in range(60))
    rows = [(i, one) for i in range(200)] + [(1000 + i, " ".join(f"y{rng.randrange(10 ** 9)}" for _ in range(90))) for i in range(40)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = {tuple(r) for r in repeats.passages(docs_of(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert got == {(i, 0, 60, 60) for i in range(200)}


def test_awkward_rows(spark):
    d = awkward(spark)
    assert repeats.passages(d).collect() == []  # the repeated row is one document
    assert repeats.passages(docs_of(spark, [])).collect() == []
