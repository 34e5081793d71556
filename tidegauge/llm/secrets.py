"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean trigram query (alternatives of trigram sets, one of which any match
must hold). The texts' postings on those trigrams are intersected for each alternative; only the candidates are scanned for
the rule. A rule that demands no trigram (long hexadecimal runs) is scanned over all texts. DataFrame functions only.

The index is over lower-cased texts, so it finds candidates of case-blind rules too; scanning decides. A match is reported
as code point offsets, end exclusive; matches of a rule do not overlap, spans of different rules may.

Defined cases: null and empty texts have no spans; repeated rows (same id, same text) get equal results; null ids are
kept; texts are scanned whole at any length; columns other than id and text are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fixed_table, keyed


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose group ``measured`` (0: the whole match) has at least ``least`` characters."""

    kind: str
    pattern: str
    measured: int = 0
    least: int = 1


#: The base rules, in the order in which spans at one place are listed.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]+", 0, 32),
)
#: Public formats of further credentials.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("google", "AIza[0-9A-Za-z_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("stripe", "[rs]k_live_[0-9A-Za-z]+", 0, 24),
)
RULES = BASE + MORE
Query = frozenset[frozenset[str]]
#: The query that any text satisfies: one alternative without a trigram.
ANY: Query = frozenset([frozenset()])
FEW = 64


def _texts_of(item) -> list[str] | None:
    """The strings an element of a parsed expression can match, where they are few."""
    op, arg = item
    if op is C.LITERAL:
        return [chr(arg)]
    if op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= 6:
        return [chr(a) for _, a in arg]
    if op is C.SUBPATTERN:
        return _all_of(arg[3])
    if op is C.BRANCH:
        found = [_all_of(x) for x in arg[1]]
        return None if None in found else [t for x in found for t in x]
    if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] <= 4:
        one = _all_of(arg[2])
        return one if one is None else [t for n in range(arg[0], arg[1] + 1) for t in map("".join, product(one, repeat=n))]
    return None


def _all_of(items) -> list[str] | None:
    out = [""]
    for item in items:
        more = _texts_of(item)
        if more is None or len(out) * len(more) > FEW:
            return None
        out = [a + b for a in out for b in more]
    return out


def _both(a: Query, b: Query) -> Query:
    return frozenset(x | y for x in a for y in b)


def _of_texts(found: list[str]) -> Query:
    """Any of the strings: each stands for all of its trigrams."""
    return least_of(frozenset(frozenset(t.lower()[i:i + 3] for i in range(len(t) - 2)) for t in found))


def least_of(q: Query) -> Query:
    """Without alternatives that demand more than another one does."""
    return frozenset(x for x in q if not any(y < x for y in q))


def _of_items(items) -> Query:
    out, run = ANY, [""]
    for item in items:
        more = _texts_of(item)
        if more is not None and len(run) * len(more) <= FEW:
            run = [a + b for a in run for b in more]
            continue
        out, run = _both(out, _of_texts(run)), [""]
        op, arg = item
        if more is not None:
            run = more
        elif op is C.SUBPATTERN:
            out = _both(out, _of_items(arg[3]))
        elif op is C.BRANCH:
            out = _both(out, least_of(frozenset(x for branch in arg[1] for x in _of_items(branch))))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            out = _both(out, _of_items(arg[2]))
    return least_of(_both(out, _of_texts(run)))


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a regular expression: a match satisfies at least one alternative, all of its trigrams."""
    return _of_items(_parser.parse(pattern))


def postings(d: DataFrame, grams: list[str]) -> DataFrame:
    """(gram, key): which texts hold which of the wanted trigrams. Every text is read whole."""
    low = d.select("key", F.lower("text").alias("low"), F.explode(F.array(*map(F.lit, grams))).alias("gram"))
    return low.where(F.contains("low", "gram")).select("key", "gram")


def candidates(d: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds): the rules whose trigram query the text satisfies."""
    terms = [(f"{r.kind}:{n}", r.kind, g, len(alternative)) for r in rules for n, alternative in enumerate(sorted(map(sorted, trigram_query(r.pattern)))) for g in alternative]
    table = fixed_table(d.sparkSession, terms, "alternative string, kind string, gram string, wanted int")
    hits = postings(d, sorted({t[2] for t in terms})).join(F.broadcast(table), "gram")  # the rules' own table, of fixed size
    full = hits.groupBy("key", "alternative").agg(F.countDistinct("gram").alias("n"), F.first("wanted").alias("wanted"), F.first("kind").alias("kind"))
    return full.where("n = wanted").groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _found(rule: Rule, wanted: Column) -> Column:
    """The matches of a rule, in order: the text before each, its length and the measured length."""
    p = F.lit(rule.pattern)
    lengths = lambda a: F.transform(a, F.length)
    match = lengths(F.regexp_extract_all("text", p, F.lit(0)))
    measured = lengths(F.regexp_extract_all("text", p, F.lit(rule.measured))) if rule.measured else match
    zipped = F.arrays_zip(lengths(F.split("text", rule.pattern, -1)).alias("before"), match.alias("length"), measured.alias("measured"))
    every = F.filter(zipped, lambda z: z["length"].isNotNull())  # the text after the last match has none
    return F.transform(F.when(wanted, every), lambda z, i: F.struct(F.lit(rule.kind).alias("kind"), i.alias("nth"), z["before"].alias("before"), z["length"].alias("length"),
                                                                    (z["measured"] >= rule.least).alias("good")))


def _long_run(rule: Rule) -> Column:
    """A cheap test before a full scan: without so long a run there is no match that counts."""
    return F.col("text").rlike(f"{rule.pattern.removesuffix('+')}{{{rule.least},}}") if rule.pattern.startswith("[") and rule.pattern.endswith("]+") else F.lit(True)


def matches(d: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, kind, start, end) of every span in rows of (key, text)."""
    free = tuple(r for r in rules if trigram_query(r.pattern) == ANY)
    bound = tuple(r for r in rules if r not in free)
    parts = [d.select("key", F.explode(_found(r, _long_run(r))).alias("m")) for r in free]
    if bound:
        c = candidates(d, bound)
        scanned = d.select("key", "text").join(c, "key")
        every = F.flatten(F.filter(F.array(*[_found(r, F.array_contains("kinds", r.kind)) for r in bound]), lambda x: x.isNotNull()))
        parts.append(scanned.select("key", F.explode(every).alias("m")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.select("key", "m.*").distinct()  # repeated rows have equal keys
    upto = Window.partitionBy("key", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.col("before").cast("bigint") + F.col("length")).over(upto))
    return rows.where("good").select("key", "kind", (F.col("end") - F.col("length")).alias("start"), "end")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) of every row: an array of (start, rank, kind, end), by start, then as the rules are listed."""
    d = keyed(docs, id_col, text_col)
    rank = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    # one text's spans meet in one row; they are no longer than the text
    spans = matches(d, rules).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", rank[F.col("kind")].alias("rank"), "kind", "end"))).alias("spans"))
    return d.drop("text").join(spans, "key", "left").select("doc_id", F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")).alias("spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    d = scan(docs, id_col, text_col)
    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return d.select("doc_id", *[n(r.kind) for r in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def masked(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span (overlapping ones as one) replaced by ``mark``; all columns stay."""
    d = docs.select(F.struct("*").alias("row"), docs[text_col].alias("text")).withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    spans = matches(d.select("key", F.coalesce("text", F.lit("")).alias("text")), rules)
    before = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("fresh", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    spans = spans.withColumn("part", F.sum("fresh").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    parts = spans.groupBy("key", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    parts = parts.withColumn("from", F.coalesce(F.lag("end").over(Window.partitionBy("key").orderBy("start")), F.lit(0)))
    cuts = parts.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "from", "end"))).alias("cuts"))
    text = F.col("text")
    kept = F.transform("cuts", lambda c: F.concat(F.substring(text, (c["from"] + 1).cast("int"), (c["start"] - c["from"]).cast("int")), F.lit(mark)))
    rest = F.substring(text, (F.element_at("cuts", -1)["end"] + 1).cast("int"), F.length(text))
    new = F.when(F.col("cuts").isNull(), text).otherwise(F.concat(F.array_join(kept, ""), rest))
    # the copies of one text share a key; the join splits where they are many
    return d.join(cuts, "key", "left").withColumn("text", new).select(*[(F.col("text") if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
