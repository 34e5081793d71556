import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import awkward, docs_of, read
from tidegauge.llm import tokenfiles
from tidegauge.llm.queries import VOCABULARY

PATH = public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return tokenfiles.Encoder(f.read())


def plain(rows, library):
    """Sorted by id (nulls first), then in the order of the files' rows of one id, which only their texts can tell."""
    return [(i, [*library(t or ""), tokenfiles.END]) for i, t in rows]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_ids_are_those_of_the_library_on_all_code_points(encoder):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    cut = [points[k:k + 40] for k in range(0, len(points), 40)]
    texts = ["".join(f"a{x}1{x} {x}{x}'s{x}! \n{x}" for x in xs) for xs in cut]
    assert encoder.fast is not None
    for k in range(0, len(texts), 5000):
        for text, want in zip(texts[k:k + 5000], encoder.library.encode_batch(texts[k:k + 5000], add_special_tokens=False)):
            assert encoder.ids(text).tolist() == want.ids


def test_texts_that_the_fast_way_refuses_and_the_special_token(encoder, library):
    for text in (" " * 1_100_000 + "x", "a<|endoftext|> b<|endoftext|>", "# 2 #", ""):
        assert encoder.ids(text).tolist() == library(text)


def test_round_trip_of_segments():
    rng = random.Random(1)
    cases = [[], [5], [7] * 1000, [7, 7, 7], [1, 2] * 501, [1, 1, 2] * 300, rng.choices(range(50), k=5000), rng.choices(range(3), k=4097)]
    motif = [rng.choices(range(100), k=20) for _ in range(10)]
    cases.append([x for _ in range(400) for x in rng.choice(motif)])
    for ids in cases:
        ids = np.array(ids, np.uint32)
        data = tokenfiles.compress(ids, 60_000)
        (s,) = tokenfiles.segments(data)
        assert s.all().tolist() == ids.tolist() and len(s) == len(ids)
        for _ in range(50):
            a, b = sorted(rng.choices(range(len(ids) + 1), k=2))
            assert s.ids(a, b).tolist() == ids[a:b].tolist()
    assert len(s.symbols) < len(ids) / 10 and max(s.length) >= 20


def test_no_two_places_overlap_and_the_frequent_pair_wins():
    pairs, at, which = tokenfiles._chosen(np.array([1, 1, 1, 1, 1, 3] * 20 + [3, 9] * 30, np.uint64), 100)
    assert (np.diff(at) >= 2).all()
    assert pairs[0] == (1 << 22 | 1) and (which == 0).sum() == 40  # 1 1 1 1 1 has room for two


def held(rows, out, library):
    want = plain(rows, library)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in out) == sorted((i is not None, i or 0, len(x), crc(x)) for i, x in want)
    out, at = sorted(out, key=lambda r: r.start), 0
    for r in out:
        assert r.start == at
        at += r.n_tokens
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in out]
    assert ids == sorted(ids)


def test_documents(spark, folder, library, monkeypatch):
    docs = read(spark, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    tokenfiles.write(docs, PATH, f"{folder}/t")
    files = spark.read.parquet(f"{folder}/t")
    held(rows, tokenfiles.checksums(files).collect(), library)
    some = {3: None, 77: None, 150: None}
    for r in tokenfiles.read(files, list(some)).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == [*library(dict(rows)[r.doc_id] or ""), 2]
        some.pop(r.doc_id)
    assert not some
    raw = 4 * files.agg(F.sum("n_tokens")).first()[0]
    assert files.agg(F.sum(F.length("data"))).first()[0] < raw / 2


def test_a_document_longer_than_a_segment(encoder):
    ids = np.append(encoder.ids("one two three four, five! " * 200_000), np.uint32(2))
    data = b"".join(tokenfiles.compress(ids[k:k + tokenfiles.SEGMENT], encoder.size) for k in range(0, len(ids), tokenfiles.SEGMENT))
    parts = tokenfiles.segments(data)
    assert len(parts) > 1 and (np.concatenate([p.all() for p in parts]) == ids).all()
    for a, b in ((0, 10), (tokenfiles.SEGMENT - 5, tokenfiles.SEGMENT + 5), (len(ids) - 3, len(ids)), (7, 7)):
        assert (tokenfiles.shard_ids(parts, a, b) == ids[a:b]).all()


def test_awkward_rows(spark, folder, library):
    d = awkward(spark).withColumn("part", F.lit("x")).withColumn("start", F.lit(1))
    tokenfiles.write(d, PATH, f"{folder}/a")
    held([(r.doc_id, r.text) for r in d.collect()], tokenfiles.checksums(spark.read.parquet(f"{folder}/a")).collect(), library)
    tokenfiles.write(docs_of(spark, []), PATH, f"{folder}/e")
    empty = spark.read.parquet(f"{folder}/e")
    assert tokenfiles.checksums(empty).collect() == [] and tokenfiles.read(empty).collect() == []
    named = d.select(F.concat(F.lit("n"), "doc_id").alias("doc_id"), "text")
    tokenfiles.write(named, PATH, f"{folder}/s")
    assert tokenfiles.checksums(spark.read.parquet(f"{folder}/s")).count() == d.count()
