"""Toxic spans by a linear-chain conditional random field.

Tokens are labelled from the document labels: in a toxic training document those words (or word beginnings) count as toxic
that the training documents' class counts single out; all words of other documents are clean. The field has two states, a
weight for each feature of a word (the word and its first four, five and six letters) and for each transition; it is fitted by
maximum conditional likelihood. Forward-backward marginals of a document's words give its score (through a logistic of two
aggregates, fitted on the training documents) and the offsets of its toxic words.

Training reads a bounded sample of the labelled rows (``sample`` of either class, chosen by a hash of the id); scoring reads
every text as one chain, whatever its length: it is laid out in blocks of 128 words, and what the words before and behind a block
say enters it as two numbers on either side, so memory stays bounded and no marginal depends on where blocks end. (In the
fit, whose transitions are counted within blocks, a block starts anew.)

Defined cases: null and empty texts have no words and get the score of a document without toxic words; repeated rows get
equal results; null ids are scored and are not held out; without labels of both classes every score is 0; other columns
(language, source, labels) are never looked at; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, texts, type_of

WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
CHAIN = 128
SAMPLE = 1000
FOLDS = 5
#: A feature counts if it is in at least three and in this share of the toxic training documents; it marks a word as toxic if it
#: is so much likelier there (log odds).
LEAST_PART, LEAST_ODDS = 0.01, 2.5
#: The weight of a squared feature weight in the likelihood, and the steps of the fit.
RIDGE, STEPS, RATE = 0.02, 80, 0.3


def features(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word, *(f"{word[:k]}-" for k in (4, 5, 6) if len(word) > k)]


def words_of(text: str) -> list[str]:
    """The words of the text in lower case; they stand where the words of the text itself stand."""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def class_odds(docs: Iterable[tuple[list[str], int]]) -> dict[str, float]:
    """Smoothed log odds of every feature that enough toxic documents have."""
    count = {0: Counter(), 1: Counter()}
    size = Counter()
    for words, toxic in docs:
        size[toxic] += 1
        count[toxic].update({f for w in set(words) for f in features(w)})
    return {f: float(np.log((n + 0.5) / (size[1] + 1)) - np.log((count[0][f] + 0.5) / (size[0] + 1))) for f, n in count[1].items() if n >= max(3, LEAST_PART * size[1])}


class Field:
    """The fitted field: feature weights (state 1 against 0), a bias, transitions, start weights, and the document logistic."""

    def __init__(self, weights: dict[str, float], bias: float, transitions: np.ndarray, start: np.ndarray):
        self.weights, self.bias, self.transitions, self.start = weights, bias, transitions, start
        self.logistic = np.array([0.0, 0.0, -20.0])
        self.cache: dict[str, float] = {}

    def emission(self, word: str) -> float:
        e = self.cache.get(word)
        if e is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            e = self.cache[word] = self.bias + sum(self.weights.get(f, 0.0) for f in features(word))
        return e

    def marginals(self, words: list[list[str]]) -> list[np.ndarray]:
        """P(toxic) of every word of every document."""
        flat = np.fromiter((self.emission(w) for doc in words for w in doc), float)
        out, at = [], 0
        rows, where = chains([len(d) for d in words])
        e = flat[rows] * where
        p = forward_backward(e, where, self.transitions, self.start, *carried(e, where, self.transitions, self.start, [len(d) for d in words]))[0]
        flat_p = np.zeros(len(flat))
        flat_p[rows[where]] = p[where]
        for doc in words:
            out.append(flat_p[at:at + len(doc)])
            at += len(doc)
        return out

    def score(self, p: np.ndarray) -> float:
        z = self.logistic @ aggregates(p)
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def aggregates(p: np.ndarray) -> np.ndarray:
    """The largest marginal and the expected number of words above one half, both on a bounded scale, and a constant."""
    if not len(p):
        return np.array([0.0, 0.0, 1.0])
    return np.array([p.max(), np.log1p(p[p >= 0.5].sum()), 1.0])


def chains(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers laid out as rows of CHAIN, no row with words of two documents; and which places hold a word."""
    starts, ends, at = [], [], 0
    for n in lengths:
        for k in range(0, n, CHAIN):
            starts.append(at + k)
            ends.append(at + min(k + CHAIN, n))
        at += n
    if not starts:
        return np.zeros((0, 1), int), np.zeros((0, 1), bool)
    grid = np.array(starts)[:, None] + np.arange(CHAIN)
    where = grid < np.array(ends)[:, None]
    return np.where(where, grid, 0), where


def carried(e: np.ndarray, where: np.ndarray, trans: np.ndarray, start: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each row of :func:`chains`: the forward weights with which its first word is entered, and the backward weights behind its last.

    A row is one 2 x 2 matrix, the product of its words; the weights run over the matrices of a document's rows."""
    n, t = len(e), np.exp(trans)
    enter, leave = np.tile(np.exp(start), (n, 1)), np.ones((n, 2))
    sizes = np.array([-(-x // CHAIN) for x in lengths if x], int)
    nth = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if not n or nth.max() == 0:
        return enter, leave
    rows = np.flatnonzero(np.repeat(sizes, sizes) > 1)
    q = np.zeros((len(rows), 2, 2))
    for k in range(e.shape[1]):
        x, live = e[rows, k], where[rows, k]
        emit = np.stack([np.exp(np.minimum(0, -x)), np.exp(np.minimum(0, x))], axis=1)  # the larger one is 1
        step = (q[:, :, :1] * t[0] + q[:, :, 1:] * t[1] if k else np.tile(np.eye(2), (len(rows), 1, 1))) * emit[:, None]
        step /= step.max(axis=(1, 2), keepdims=True)
        q = np.where(live[:, None, None], step, q)
    product = np.zeros((n, 2, 2))
    product[rows] = q
    for j in range(1, int(nth.max()) + 1):
        at = np.flatnonzero(nth == j)
        v = np.einsum("ni,nij->nj", enter[at - 1], product[at - 1]) @ t
        enter[at] = v / v.sum(axis=1, keepdims=True)
    for j in range(int(nth.max()), 0, -1):
        at = np.flatnonzero(nth == j)
        v = np.einsum("nij,nj->ni", product[at], leave[at]) @ t.T
        leave[at - 1] = v / v.sum(axis=1, keepdims=True)
    return enter, leave


def forward_backward(e: np.ndarray, where: np.ndarray, trans: np.ndarray, start: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None):
    """Of rows of emission scores (state 1 against 0): marginals of state 1, pair marginals summed by transition, log partition.

    With ``enter`` and ``leave`` the rows are parts of longer chains, and only the marginals are of use."""
    n, m = e.shape
    emit = np.stack([np.zeros_like(e), e], axis=2)
    shift = np.maximum(emit.max(axis=2), 0)
    emit = np.exp(emit - shift[:, :, None])
    t = np.exp(trans)
    alpha, scale = np.zeros((m, n, 2)), np.ones((m, n))
    for k in range(m):
        a = ((np.exp(start) if enter is None else enter) if k == 0 else alpha[k - 1] @ t) * emit[:, k]
        live = where[:, k]
        s = np.where(live, a.sum(axis=1), 1.0)
        alpha[k] = np.where(live[:, None], a / s[:, None], alpha[k - 1] if k else 0.5)
        scale[k] = s
    beta = np.ones((n, 2)) if leave is None else leave
    p, pairs = np.zeros((n, m)), np.zeros((2, 2))
    for k in range(m - 1, -1, -1):
        both = alpha[k] * beta
        p[:, k] = np.where(where[:, k], both[:, 1] / both.sum(axis=1), 0)
        if k:
            live = where[:, k]
            back = emit[:, k] * beta / scale[k][:, None]
            pairs += np.einsum("ni,ij,nj->ij", alpha[k - 1][live], t, back[live])
            beta = np.where(live[:, None], back @ t.T, beta)
    return p, pairs, float(np.log(scale).sum() + (shift * where).sum())


def fit(docs: list[tuple[str, int]]) -> Field | None:
    """The field of labelled texts; None where a class is missing."""
    split = [(words_of(t), y) for t, y in docs]
    split = [(w, y) for w, y in split if w]
    if len({y for _, y in split}) < 2:
        return None
    odds = class_odds(split)
    toxic = {f for f, o in odds.items() if o >= LEAST_ODDS}
    # the features with some evidence; all others weigh nothing
    names = sorted(f for f, o in odds.items() if abs(o) >= 1)
    index = {f: i for i, f in enumerate(names)}
    words = sorted({w for d, _ in split for w in d})
    number = {w: i for i, w in enumerate(words)}
    wide = [[index[f] for f in features(w) if f in index] for w in words]
    rows = np.repeat(np.arange(len(words)), [len(x) for x in wide])
    cols = np.array([c for x in wide for c in x], dtype=int)
    marked = np.array([any(f in toxic for f in features(w)) for w in words])
    ids = np.array([number[w] for d, _ in split for w in d])
    gold = marked[ids] & np.repeat([y == 1 for _, y in split], [len(d) for d, _ in split])
    grid, where = chains([len(d) for d, _ in split])
    tagged = gold[grid] & where
    y = tagged.astype(int)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][where[:, 1:]], y[:, 1:][where[:, 1:]]), 1)
    first = np.bincount(y[:, 0], minlength=2)
    hits = np.bincount(ids, weights=gold, minlength=len(words))
    # Adam on the mean negative log likelihood of a labelled toxic word
    size = max(1.0, float(gold.sum()))
    theta = np.concatenate([np.zeros(len(names)), [-3.0], np.zeros(4), np.zeros(2)])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        w, bias, trans, start = theta[:len(names)], theta[len(names)], theta[len(names) + 1:len(names) + 5].reshape(2, 2), theta[-2:]
        of_word = np.bincount(rows, weights=w[cols], minlength=len(words)) + bias
        p, pairs, _ = forward_backward(of_word[ids][grid] * where, where, trans, start)
        want = np.bincount(ids[grid[where]], weights=p[where], minlength=len(words))
        miss = want - hits
        q = p[:, 0].sum()
        grad = np.concatenate([np.bincount(cols, weights=miss[rows], minlength=len(names)) + RIDGE * size * w / max(1, len(names)) ** 0.5,
                               [miss.sum()], (pairs - seen).ravel(), [len(p) - q - first[0], q - first[1]]]) / size
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad ** 2
        theta = theta - RATE * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.999 ** step)) + 1e-8)
    w = theta[:len(names)]
    field = Field({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-3}, float(theta[len(names)]), theta[len(names) + 1:len(names) + 5].reshape(2, 2), theta[-2:])
    field.logistic = logistic(np.stack([aggregates(p) for p in field.marginals([d for d, _ in split])]), np.array([y for _, y in split], float))
    return field


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.05) -> np.ndarray:
    """Both classes weigh the same; Newton steps with a small penalty."""
    w = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)) * len(y) / 100
        b = b + np.linalg.solve(h, x.T @ (w * (y - p)) - ridge * b * len(y) / 100)
    return b


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, id_col: str, text_col: str, label_col: str) -> list[tuple[str, int]]:
    """At most ``sample`` labelled texts of either class, never of a held-out id."""
    ids = labels.select(labels[id_col].alias("doc_id"), labels[label_col].alias("y")).where("y in (0, 1) and doc_id is not null and not " + HELD).distinct()
    some = None
    for y in (0, 1):
        part = ids.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        some = part if some is None else some.unionByName(part)
    d = texts(docs, id_col, text_col)
    rows = d.join(F.broadcast(some), "doc_id").distinct().collect()  # the sample is bounded
    return [(r["text"], r["y"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]


HELD = f"coalesce(crc32(cast(cast(doc_id as string) as binary)) % {FOLDS} = 0, false)"


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every row; spans are (start, end, score) of words more toxic than not."""
    field = fit(training_rows(docs, labels, sample, id_col, text_col, label_col))
    d = texts(docs, id_col, text_col)
    shared = d.sparkSession.sparkContext.broadcast(field)  # at most the features of the sample

    def make():
        f = shared.value

        def run(ids, rows):
            if f is None:
                return [ids, [0.0] * len(ids), [[] for _ in ids]]
            marginals = f.marginals([words_of(t) for t in rows])
            return [ids, [f.score(p) for p in marginals], [offsets(t, p) for t, p in zip(rows, marginals, strict=True)]]
        return run
    out = map_rows(d, make, [("doc_id", type_of(d, "doc_id")), ("score", "double"), ("spans", "array<struct<start:bigint,end:bigint,score:double>>")], rows=128)
    return out.select("doc_id", F.expr(HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def offsets(text: str, p: np.ndarray) -> list[tuple[int, int, float]]:
    """Places of the toxic words. Lower-casing may change a text's length, so places are counted in the text as it is."""
    hot = np.flatnonzero(p >= 0.5)
    if not len(hot):
        return []
    low = text.lower()
    found = [m.span() for m in WORD.finditer(low if len(low) == len(text) else text)]
    return [(*found[i], float(p[i])) for i in hot]
