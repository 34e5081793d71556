"""Encoding, quality rules, toxic spans and page wrappers."""

import hashlib
import html
import random
import re

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.helpers import awkward, docs_of, read, space_words
from tidegauge.llm import bpe, quality, toxicity, wrappers

PATH = public_tokenizers.path("byte_bpe_50k.json")
CODEC = bpe.Codec(open(PATH, encoding="utf-8").read())
LIBRARY = Tokenizer.from_file(PATH)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_codec_equals_the_library(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODEC.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False) == text


def test_bpe_rows(spark):
    rows = [(i, t) for i, t in enumerate(["<|endoftext|>a <|endoftext|>", "  \n\n  x", "a" * 5000, "don't we'll", "", None, "日本語 ½ ٣"])]
    rows += [(100 + r.doc_id, r.text) for r in read(spark, "documents").collect()]
    for r in bpe.digests(docs_of(spark, rows), PATH).collect():
        t = dict(rows)[r.doc_id] or ""
        ids = LIBRARY.encode(t, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs_of(spark, rows), PATH), PATH).collect()}
    assert back == {i: t or "" for i, t in rows}


def plain_quality(t):
    w = space_words(t)
    lines = [x for x in t.split("\n") if space_words(x)]
    three = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, x in enumerate(three) if three.count(x) > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_and_verdicts(spark):
    rows = [(i, t) for i, t in enumerate(["a b c a b c", "a a a a", "x\n\n x\nx \nx\nx", "#*$ %&|<>", "    b\x0bc\x1cd", "", None])]
    rows += [(100 + r.doc_id, r.text) for r in read(spark, "documents").where("n_chars < 4000").collect()]
    for r in quality.judge(docs_of(spark, rows)).collect():
        n, *rest = plain_quality(dict(rows)[r.doc_id] or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 50 or 100 * rest[-1] > 50 * n) and not (r.base_failed and r.kept)


def test_quality_agrees_with_the_labels_it_never_saw(spark):
    sf = "/root/testdata/sf0.01"
    docs = read(spark, "documents", sf)
    got = quality.judge(docs).where("not base_failed").join(read(spark, "labels", sf), "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in got]) > 0.97
    assert np.mean([r.kept for r in got if r.quality == 1]) > 0.99
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert {r.doc_id for r in quality.filtered(docs.withColumn("pattern", F.lit(1))).collect()} == kept


def test_expectation_maximisation_finds_the_better_rules():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.7
    votes = np.zeros((4000, len(quality.RULES)), int)
    for k in range(len(quality.RULES)):
        right = rng.random(4000) < (0.95 if k < 4 else 0.6)
        votes[:, k] = np.where(rng.random(4000) < 0.4, 0, np.where(right == y, 1, -1))
    p, accuracy = quality.fit(votes, np.ones(4000))
    a = list(accuracy.values())
    assert ((p >= 0.5) == y).mean() > 0.9 and min(a[:4]) > max(a[4:])


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    e, trans, start = rng.normal(size=(3, 5)), rng.normal(size=(2, 2)), rng.normal(size=2)
    where = np.array([[1] * 5, [1] * 3 + [0] * 2, [1] + [0] * 4], bool)
    p, pairs, log_z = toxicity.forward_backward(e * where, where, trans, start)
    total, want_pairs = 0.0, np.zeros((2, 2))
    for row in range(3):
        n = where[row].sum()
        paths = [[int(b) for b in f"{k:0{n}b}"] for k in range(2 ** n)]
        w = np.array([np.exp(start[s[0]] + sum(e[row, i] * s[i] for i in range(n)) + sum(trans[a, b] for a, b in zip(s, s[1:]))) for s in paths])
        total += np.log(w.sum())
        for i in range(n):
            assert abs(p[row, i] - sum(x for x, s in zip(w, paths) if s[i]) / w.sum()) < 1e-9
        for x, s in zip(w, paths):
            for a, b in zip(s, s[1:]):
                want_pairs[a, b] += x / w.sum()
    assert abs(total - log_z) < 1e-9 and np.allclose(pairs, want_pairs)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(6)
    good, bad = [f"w{i}" for i in range(300)], ["idiot", "scumbag", "moronic"]
    rows, labels = [], []
    for i in range(700):
        w = [rng.choice(good) for _ in range(rng.choice([5, 60, 400]))]
        y = i % 3 == 0
        if y:
            w[rng.randrange(len(w))] = rng.choice(bad).title()
        rows.append((i, " ".join(w)))
        labels.append((i, int(y)))
    labels = spark.createDataFrame(labels + labels[:20], "doc_id bigint, toxic int")
    docs = docs_of(spark, rows + [(1000, None)]).withColumn("score", F.lit(1.0))
    out = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    held = [i for i, _ in rows if out[i].held_out]
    assert 100 < len(held) < 180 and np.mean([out[i].predicted == (i % 3 == 0) for i in held]) > 0.97
    assert out[1000].predicted == 0 and out[1000].spans == []
    r = out[next(i for i in held if i % 3 == 0 and out[i].predicted)]
    assert any(rows[r.doc_id][1][s.start:s.end].lower() in bad for s in r.spans)
    assert {x.score for x in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head><body class="x"><header><h1>Site</h1></header>
<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>gone</p> --><div class="cookie-notice"><p>We use cookies</p></div><article><h1>A &amp; B</h1><p>One <b>two<br>three &eacute;&#233;&nbsp;x
<p>Four<div class="ad"><p>Buy</p></div><ul><li>i<li>ii</ul><form><p>Mail</p><input></form><aside>See also</aside></article>
<section id="comments"><article class="comment"><p>First!</p></article></section><footer>&copy; me</footer>"""


def test_page_blocks_and_furniture(spark):
    other = "<html><body><div class='menu'>m</div><div class=tagline>same line</div><div class=story><p>{}</p><p>end {}</p></div></body>"
    rows = [(1, "http://a.org/x", PAGE), (2, "https://B.org:80/1", other.format("one", 1)), (3, "https://b.org:80/2", other.format("two", 2)), (4, None, "plain &lt;text"), (5, "http://c", None), (5, "http://c", None), (6, "http://c", "<p>cut of")]
    out = {r.page_id: r for r in wrappers.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit(1))).collect()}
    assert out[1].text == "A & B\n\nOne two three éé x\n\nFour\n\ni\n\nii" and out[1].n_chars == len(out[1].text)
    assert out[2].text == "one\n\nend 1" and out[3].text == "two\n\nend 2"  # the tagline is the same on all pages of the host
    assert out[4].text == "plain <text" and out[5].text == "" and out[6].text == "cut of"


def test_names_with_main_in_them_are_not_the_main_part(spark):
    story = '<div class="story"><p>one {0}</p><p>two {0}</p></div>'
    pages = {"title": '<h1 class="main-title">T {0}</h1>' + story, "header": '<header id="main-header">Site</header>' + story, "article": '<header id="main-header">Site</header><article><p>A {0}</p></article>',
             "bare": '<div class="main"><h1>T {0}</h1></div>' + story, "block": '<p class="main">T {0}</p>' + story, "nav": '<nav role="main"><p>N</p></nav>' + story,
             "real": '<div id="main-content"><h1>T {0}</h1><p>M {0}</p></div><div>more {0}</div>', "role": '<div role="main"><p>M {0}</p></div><div>more {0}</div>',
             "mixed": '<div class="main"><h1>T {0}</h1></div>' + story}
    rows = [(k, f"http://{k}.org/{i}", page.format(i)) for k, page in pages.items() for i in (1, 2)] + [("other", "http://mixed.org/3", '<div class="main"><p>M</p></div><div>more</div>')]
    out = {(r.page_id, r.url[-1]): r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id string, url string, html string")).collect()}
    want = {"title": "T {0}|one {0}|two {0}", "header": "one {0}|two {0}", "article": "A {0}", "bare": "T {0}|one {0}|two {0}", "block": "T {0}|one {0}|two {0}", "nav": "one {0}|two {0}", "real": "T {0}|M {0}", "role": "M {0}",
            "mixed": "T {0}|one {0}|two {0}"}
    assert out == {(k, str(i)): t.format(i).replace("|", "\n\n") for k, t in want.items() for i in (1, 2)} | {("other", "3"): "M"}


def test_copies_of_a_page_do_not_make_its_texts_constant(spark):
    page = "<div class=tagline>same line</div><div class=story><p>a long text about {0} and more of {0}</p><p>another text about {0}</p>{1}<p>seen {2}</p></div>"
    quote = "<blockquote>quoted</blockquote>"
    p1, near, p2, p3 = page.format("one", quote, "x"), page.format("one", quote, "y"), page.format("two", "", "x"), page.format("three", "", "z")
    hosts = {"single": [p1, p2], "copied": [p1, p1, p2], "many": [p1] * 50 + [p2], "near": [p1, near, near, p2, p3]}
    rows = [(f"{k} {i}", f"http://{k}.org/{i}", x) for k, pages in hosts.items() for i, x in enumerate(pages)]
    out = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id string, url string, html string").repartition(7)).collect()}
    for k, _, x in rows:
        assert ("quoted" in out[k]) == (quote in x) and "same line" not in out[k] and "a long text about" in out[k], k


def test_pages_are_counted_beyond_the_digests_kept():
    e = None
    for i in range(1500):
        x = wrappers.expression(wrappers.tree(f"<div class=tagline>same</div><p>page {i}</p>" + ("<pre>rare</pre>" if i % 10 == 0 else "")))
        e = wrappers.merged(e, x) if e else x
    kinds = {path[-1]: kind for path, kind in wrappers.decisions(wrappers.settled(e)).items()}
    assert abs(wrappers.count(e[2]) / 1500 - 1) < 0.5 and kinds == {"div": "all", "p": "body", "pre": "body"}


def test_pages_equal_a_plain_reading(spark):
    pages = read(spark, "pages")
    want = {}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:h1|p)>", body)]
        want[r.page_id] = "\n\n".join(b for b in blocks if b)
    assert {r.page_id: r.text for r in wrappers.extract(pages).collect()} == want


def test_wrappers_align_to_optional_and_repeated_groups():
    e = lambda p: wrappers.expression(wrappers.tree(p))
    a, b = e("<h1>x</h1><p>1</p><p>2</p><div>z</div>"), e("<h1>x</h1><p>1</p><table><tr><td>c</table>")
    show = lambda n: n[0] + n[1] + ("=" if n[0] == "#" and n[2] else "") + ("(" + " ".join(map(show, n[3])) + ")" if n[3] else "")
    assert show(wrappers.merged(a, b)) in ("html(h1(#=) p+(#) div?(#=) table?(tr(td(#=))))", "html(h1(#=) p+(#) table?(tr(td(#=))) div?(#=))")
    assert wrappers.once(wrappers.merged(a, a)) == a


@pytest.mark.parametrize("run", [lambda d: bpe.digests(d, PATH), quality.judge, lambda d: toxicity.score(d, d.select("doc_id", F.lit(1).alias("toxic")).limit(0))])
def test_awkward_rows(spark, run):
    out = run(awkward(spark).withColumn("pattern", F.lit(1)).withColumn("ids", F.lit("x"))).collect()
    assert len(out) == 11 and sum(r.doc_id is None for r in out) == 2
    assert run(docs_of(spark, [])).collect() == []
