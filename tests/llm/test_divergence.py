import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import DOCS, ascii_lower, awkward, docs_of, read
from tidegauge.llm import divergence


def plain(rows, least=3, top=200):
    """(text, lang, source) rows; everything counted and compared in plain loops."""
    rows = [(t or "", la or "", s or "") for t, la, s in rows]
    held, count, groups = Counter(), Counter(), {(la, s) for _, la, s in rows}
    for t, la, s in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(t))
        held.update({(la, w) for w in words})
        count.update((la, s, w) for w in words)
    kept = defaultdict(list)
    for (la, w), n in held.items():
        if n >= least:
            kept[la].append(w)
    total = {la: Counter({w: sum(count[la, s, w] for a, s in groups if a == la) for w in ws}) for la, ws in kept.items()}
    def share(c, n, v):
        return 1 + 1_000_000_000 * (c + 1) // (n + v)
    out = []
    for la, s in groups:
        ws, v = kept[la], len(kept[la])
        own = {a: sum(count[la, a, w] for w in ws) for b, a in groups if b == la}
        pairs = []
        for t in own:
            if t != s:
                both = [(share(count[la, s, w], own[s], v), share(count[la, t, w], own[t], v)) for w in ws]
                pairs.append((t, sum((p - q) * (p - q) // q for p, q in both)))
        terms = []
        for w in ws:
            p, q = share(count[la, s, w], own[s], v), share(total[la][w], sum(total[la].values()), v)
            if count[la, s, w] and p > q:
                terms.append((w, (p - q) * (p - q) // q))
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            found.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(la, s, part, item, value, i) for i, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, t, la, s, 0) for i, (t, la, s) in enumerate(rows)], DOCS)


def got(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


def test_pointers_sort_words_of_any_length():
    rng = random.Random(3)
    words = ["ab" * 40 + str(i % 7).replace("0", "z") for i in range(50)] + ["".join(rng.choice("abé") for _ in range(rng.randint(1, 30))) for _ in range(3000)] + ["x" * 8, "x" * 16, "x" * 9] * 20
    text = [" ".join(re.sub(r"\d", "q", w) for w in rng.choices(words, k=400)) for _ in range(200)]
    data = "".join(text).encode()
    offsets = np.cumsum([0, *[len(t.encode()) for t in text]])
    letters, starts, lengths = divergence.pointers(np.frombuffer(data, np.uint8), offsets)
    found = [data[s:s + n] for s, n in zip(starts, lengths)]
    assert sorted(found) == sorted(w.encode() for t in text for w in re.findall("[a-zé]+", t))
    for small in (16, 1 << 15):
        divergence.SMALL = small
        try:
            p = divergence.Pointers(letters, starts, lengths)
        finally:
            divergence.SMALL = 1 << 15
        order = [found[i] for i in p.order]
        assert order == sorted(found)
        assert p.fresh.tolist() == [i == 0 or order[i] != order[i - 1] for i in range(len(order))]


def test_against_plain(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta", "γάμμα", "delta-4", "naïve", "thereisaverylongwordhere", "thereisaverylongwordtoo", "x", "don't"]
    rows = [(" ".join(rng.choices(words[:rng.randint(1, 9)], k=rng.randint(0, 12))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "ü", None, "hot", "hot", "hot"])) for _ in range(300)]
    rows += [(None, "fr", "a"), ("", "fr", "b"), ("one two", "it", "only"), ("one two", "it", "only"), ("one ONE", "it", "only")]
    assert got(divergence.audit(table(spark, rows))) == plain(rows)
    assert got(divergence.audit(table(spark, rows), least_docs=1, top=2)) == plain(rows, 1, 2)


@pytest.mark.parametrize("name,value", [("SLICE_BYTES", 40), ("SLICE_ROWS", 7), ("CELLS", 9)])
def test_slices_do_not_matter(spark, monkeypatch, name, value):
    rows = [(r.text, r.lang, r.source) for r in read(spark, "documents").limit(40).collect()]
    monkeypatch.setattr(divergence, name, value)
    if name == "SLICE_BYTES":  # the slices are cut in tasks, so their counts are held here
        offsets = np.cumsum([0, *[len((t or "").encode()) for t, *_ in rows]])
        data = np.frombuffer("".join(t or "" for t, *_ in rows).encode(), np.uint8)
        total = Counter()
        for lo, hi in divergence._slices(offsets):
            terms, term, own, n, docs = divergence.slice_counts(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], np.arange(lo, hi) % 2)
            for t, g, k in zip(term, own, n):
                total[terms[t], int(g)] += int(k)
        want = Counter((w.encode(), i % 2) for i, (t, *_) in enumerate(rows) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", ascii_lower(t or "")))
        assert total == want
    else:
        assert got(divergence.audit(table(spark, rows))) == plain(rows)


def test_large_counts_stay_exact(spark):
    n, of = 90_000_000_000_000, 3 * 10**15 + 7
    row = spark.range(1).select(F.lit(n).alias("n"), F.lit(of).alias("of"), F.lit(12345).alias("v")).select(divergence.share("n", "of", "v").alias("p")).first()
    assert row.p == 1 + 1_000_000_000 * (n + 1) // (of + 12345)


def test_awkward_rows(spark):
    d = awkward(spark)
    rows = [(r.text, r.lang, r.source) for r in d.collect()]
    assert got(divergence.audit(d.withColumn("term", F.lit(1)).withColumn("n", F.lit("x")), least_docs=1)) == plain(rows, 1)
    assert divergence.audit(docs_of(spark, [])).collect() == []
