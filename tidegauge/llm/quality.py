"""Quality rules as weak supervision.

Each rule votes good (1), bad (-1) or abstains (0). Votes are packed to one number, so all documents fall into at most
3^12 patterns; expectation-maximisation runs on the pattern counts of the whole corpus, estimates each rule's accuracy on
either class (abstentions say nothing), and gives the posterior of each pattern. Only these counts reach the driver.

Defined cases: a null text has no words, so it fails; a text that only holds white space likewise; an empty table gives
an empty table; equal rows get equal verdicts; other columns are ignored. A rule that never votes keeps its first accuracy.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_rows, texts, type_of

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\r\x0b\x0c"
#: A ratio of two counts, and two bounds: on one side a rule votes one way, on the other the other way, between them it abstains.
RULES: dict[str, tuple[str, str, float, float]] = {
    "words": ("n_words", "", 50, 80), "symbols": ("n_symbols", "n_words", 0.05, 0.15), "upper": ("n_upper", "n_letters", 0.15, 0.35),
    "repeats": ("n_repeat_words", "n_words", 0.15, 0.4), "lines": ("n_dup_lines", "n_lines", 0.1, 0.4), "top_word": ("n_top_word", "n_words", 0.15, 0.3),
    "shouts": ("n_shouts", "n_words", 0.08, 0.25), "word_length": ("word_chars", "n_words", 2.5, 3.0), "distinct": ("n_distinct", "n_words", 0.05, 0.15),
    "bare": ("n_bare_words", "n_words", 0.1, 0.25), "symbol_words": ("n_symbol_words", "n_words", 0.1, 0.3), "symbol_chars": ("n_symbols", "word_chars", 0.03, 0.08)}
#: Rules for which a low value is the bad sign.
LOW_IS_BAD = ("words", "word_length", "distinct")
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_top_word", "n_shouts", "n_distinct", "n_bare_words", "n_symbol_words"]
SYMBOL_WORD = re.compile(rb"\S*[#*$%&|<>]\S*")
BARE_WORD = re.compile(rb"(?<!\S)[^\sA-Za-z\x80-\xff]+(?!\S)")


def _measure(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()  # bytes split at the six ASCII white-space characters
    n = len(words)
    bare = raw.translate(None, WHITE)
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if line.encode().split():
            lines += 1
            dup += line in seen
            seen.add(line)
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    repeated = 0
    if n >= 3:
        pair = at[:-1] * len(ids) + at[1:]  # below 2^62 for any text that fits in memory
        _, pair = np.unique(pair, return_inverse=True)
        _, which, count = np.unique(pair[:-1] * len(ids) + at[2:], return_inverse=True, return_counts=True)
        twice = count[which] > 1
        hit = np.zeros(n, dtype=bool)
        for k in range(3):
            hit[k:n - 2 + k] |= twice
        repeated = int(hit.sum())
    top = int(np.bincount(at).max()) if n else 0
    upper, symbols = sum(map(str.isupper, text)), len(raw) - len(raw.translate(None, SYMBOLS))
    return (n, len(text) - (len(raw) - len(bare)), symbols, dup, repeated, lines,
            upper, sum(map(str.isalpha, text)), top, raw.count(b"!!"), len(ids),
            len(BARE_WORD.findall(raw)), len(SYMBOL_WORD.findall(raw)) if symbols else 0)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the counts in STATS, base_failed, pattern) of every row."""
    d = texts(docs, id_col, text_col)

    def make():
        def run(ids, rows):
            got = [_measure(x) for x in rows]
            return [ids, *map(list, zip(*got, strict=True)), [failed(x) for x in got], [pattern(x) for x in got]]
        return run
    return map_rows(d, make, [("doc_id", type_of(d, "doc_id")), *((c, "bigint") for c in STATS), ("base_failed", "boolean"), ("pattern", "int")])


def pattern(counts: tuple[int, ...]) -> int:
    """The packed votes of one row's counts; a ratio over nothing abstains."""
    x, code = dict(zip(STATS, counts, strict=True)), 0
    for i, (rule, (up, down, low, high)) in enumerate(RULES.items()):
        of = x[down] if down else 1
        v = 0 if not of else 1 if x[up] <= low * of else -1 if x[up] >= high * of else 0
        code += ((-v if rule in LOW_IS_BAD else v) + 1) * 3 ** i
    return code


def failed(counts: tuple[int, ...]) -> bool:
    n, repeated = counts[0], counts[4]
    return n < 50 or 100 * repeated > 50 * n


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, dict[str, float]]:
    """Posterior of the good class for each vote pattern, and the estimated accuracy of each rule's votes.

    Each class has its own rates of good, bad and no votes by rule, for junk of one kind leaves most rules silent or
    content. The first guess takes a row with any bad vote for bad. A rule never votes bad more often on good rows.
    """
    if not len(votes):
        return np.zeros(0), {}
    hot = np.stack([votes == v for v in (1, 0, -1)], axis=2).astype(float)  # pattern, rule, outcome
    w = counts.astype(float)
    p, was = np.where((votes == -1).any(axis=1), 0.1, 0.9), None
    for _ in range(rounds):
        share = np.stack([w * p, w * (1 - p)])
        rate = (np.einsum("cn,nro->cro", share, hot) + 1) / (share.sum(axis=1)[:, None, None] + 3)
        rate[0, :, 2] = np.minimum(rate[0, :, 2], rate[1, :, 2])
        prior = (share.sum(axis=1) + 1) / (w.sum() + 2)
        up, down = (np.log(prior[c]) + np.einsum("nro,ro->n", hot, np.log(rate[c])) for c in (0, 1))
        p = 1 / (1 + np.exp(np.clip(down - up, -500, 500)))
        if was is not None and np.abs(p - was).max() < 1e-9:
            break
        was = p
    right = prior[0] * rate[0, :, 0] + prior[1] * rate[1, :, 2]
    cast = right + prior[0] * rate[0, :, 2] + prior[1] * rate[1, :, 0]
    return p, dict(zip(RULES, (right / cast).tolist(), strict=True))


def posteriors(measured: DataFrame) -> dict[int, float]:
    """The posterior of the good class by vote pattern, from the pattern counts of all rows (3^12 numbers at most)."""
    found = sorted((x["pattern"], x["count"]) for x in measured.groupBy("pattern").count().collect())
    codes = np.array([c for c, _ in found], dtype=np.int64)
    p, _ = fit(unpack(codes), np.array([n for _, n in found]))
    return dict(zip(codes.tolist(), p.tolist(), strict=True))


def unpack(codes: np.ndarray) -> np.ndarray:
    return codes[:, None] // 3 ** np.arange(len(RULES)) % 3 - 1


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(doc_id, STATS, base_failed, posterior, kept). ``kept``: the base rules hold and the posterior is at least ``least``."""
    m = cut_lineage(measures(docs, id_col, text_col))  # a few numbers a row, so the texts are read once
    table = docs.sparkSession.createDataFrame(list(posteriors(m).items()), "pattern int, posterior double")
    return m.join(F.broadcast(table), "pattern").select(
        "doc_id", *STATS, "base_failed", "posterior", (~F.col("base_failed") & (F.col("posterior") >= least)).alias("kept"))


def filtered(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns. The texts are read twice and never shuffled."""
    good = {c for c, p in posteriors(measures(docs.withColumn("doc_id", F.lit(0)), "doc_id", text_col)).items() if p >= least}
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                got = [_measure(x or "") for x in part.column(at).to_pylist()]
                yield part.filter(pa.array([not failed(x) and pattern(x) in good for x in got], pa.bool_()))
    return docs.mapInArrow(run, docs.schema)
