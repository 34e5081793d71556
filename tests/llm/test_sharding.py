import zlib
from collections import Counter, defaultdict

from tests.llm.helpers import awkward, docs_of, read
from tidegauge.llm import sharding


def check(rows, out, shards=24):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    by = defaultdict(list)
    for r in out:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    size = Counter()
    for r in out:
        size[r.shard] += r.size
    return [size[s] for s in range(shards)]


def test_documents(spark):
    docs = read(spark, "documents", "/root/testdata/sf0.01")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sizes = check(rows, sharding.shard(docs).collect())
    assert max(sizes) - min(sizes) <= 0.05 * sum(sizes) / 24


def test_a_group_with_a_third_of_the_rows_is_cut_and_the_rest_stays_whole(spark):
    rows = [(i, "the same text in very many rows") for i in range(3000)] + [(10_000 + i, f"text {i // 3} of a small group " * (1 + i % 1)) for i in range(6000)]
    out = sharding.shard(docs_of(spark, rows)).collect()
    sizes = check(rows, out)
    assert max(sizes) - min(sizes) <= 0.02 * sum(sizes) / 24
    where = defaultdict(set)
    text = dict(rows)
    for r in out:
        where[text[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for t, s in where.items() if "small" in t)


def test_tokens_and_rows_are_balanced_too(spark):
    rows = [(i, ("a " * 400) if i % 2 else "b" * 800) for i in range(2400)]
    rows = [(i, f"{i} {t}") for i, t in rows]
    out = sharding.shard(docs_of(spark, rows)).collect()
    words = Counter()
    for r in out:
        words[r.shard] += len(rows[r.doc_id][1].split())
    assert max(words.values()) <= 1.05 * min(words.values()) and max(Counter(r.shard for r in out).values()) <= 105


def test_awkward_rows(spark):
    d = awkward(spark)
    check([(r.doc_id, r.text) for r in d.collect()], sharding.shard(d).collect())
    assert sharding.shard(docs_of(spark, [])).collect() == []
