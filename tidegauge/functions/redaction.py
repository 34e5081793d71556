"""Replacing identifiers in texts by stable numbered markers.

All of it is DataFrame work. Known values are found through their rarest word: the words of a text meet the known values that
hold such a word, and only these values are searched in the text, whatever characters they consist of, between the first and
the last place where their letters stand. Shapes of identifiers are searched in the runs of characters that hold a sign of
one; one pass over the text finds these. Of places that overlap, the one that starts first counts, a known value before a
shape, a longer one before a shorter one; a place that touches an existing marker never counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ordered import with_position
from ..session import cut_lineage

# ---- fixed values: marker kinds and the shapes that are recognised, first match at a place wins
MARKER = r"\[(?:ACTIVO|ANFITRION|ID|IP)_\d+\]"
SHAPES = [
    ("ID", r"(?:aws|azure|digitalocean|proxmox|onprem|gcp):[A-Za-z][\w-]*/[\w./-]*[\w]"),
    ("ID", r"/subscriptions/[0-9a-fA-F-]{36}(?:/[\w.()-]+)*"),
    ("ID", r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    ("ID", r"i-[0-9a-f]{8}(?:[0-9a-f]{9})?"),
    ("ANFITRION", r"ip-\d{1,3}-\d{1,3}-\d{1,3}-\d{1,3}(?:\.[A-Za-z0-9-]+)*"),
    ("IP6", r"[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?:%[\w]+)?"),
    ("IP4", r"(?:\d{1,3}\.){3}\d{1,3}"),
]
BEFORE, AFTER = r"(?<![\w.-])", r"(?![\w-]|\.\w)"
# ---- end of fixed values

KINDS = ("ACTIVO", "ANFITRION", "ID", "IP")
#: Case and letters of any script; a known value stands as it is.
FLAGS = "(?iuU)"
WORD = r"[\p{L}\p{N}]+"
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PLACE = "array<struct<before:int,hit:string>>"
#: What shapes and markers consist of, and more; a character outside is a border to all of them.
INSIDE = r"0-9A-Za-z_%()\]\x{80}-\x{10FFFF}./:\[-"
#: Every identifier of a shape and every marker holds one of these.
SIGN = r"(?::[0-9A-Za-z:\x{80}-\x{10FFFF}]|/(?iu:subs)|-(?:\p{Nd}|[0-9A-Fa-f]{4}-|[0-9A-Fa-f]{8})|\.[0-9]|\[(?:A|I))"
#: From the end of one run with a sign to the end of the next, and in that what comes before the run.
UP_TO_RUN = rf"\G(?:[^./:\[-]++|(?!{SIGN})[./:\[-])*+{SIGN}[{INSIDE}]*+"
AHEAD = rf"(?s)\A.*[^{INSIDE}]"
#: The letters outside ASCII that are one of its letters in the other case.
LIKE_ASCII = {"\u0131": "i", "\u0130": "i", "\u017f": "s", "\u212a": "k"}


def _places(text: Column, pattern: Column) -> Column:
    """Every match, in order, with the length of the text since the match before it."""
    before = F.transform(F.split(text, pattern, -1), F.length)
    both = F.arrays_zip(before.alias("before"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"))
    return F.filter(both, lambda z: z["hit"].isNotNull()).cast(PLACE)


def _once(c: Column) -> Column:
    """The column made once: a generator keeps Spark from moving filters on it, with what it is made of, ahead of it."""
    return F.explode(F.array(c))


def _offsets(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``places`` exploded to (s, e, hit): code points from 0, end exclusive; ``keys`` name one search of one text."""
    x = rows.select(*keys, F.posexplode("places").alias("_n", "_p")).select(*keys, "_n", "_p.*")
    upto = Window.partitionBy(*keys).orderBy("_n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumn("e", F.sum(F.col("before") + F.length("hit")).over(upto).cast("int"))
    return x.select(*keys, (F.col("e") - F.length("hit")).alias("s"), "e", "hit")


def is_ipv4(c: Column) -> Column:
    return c.rlike(f"^{OCTET}([.]{OCTET}){{3}}$")


def is_ipv6(c: Column) -> Column:
    """Eight groups, or fewer around one gap; a zone may follow."""
    a = F.lower(F.substring_index(c, "%", 1))
    full = a.rlike("^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$")
    gaps = F.length(a) - F.length(F.replace(a, F.lit("::"), F.lit("")))
    short = (gaps == 2) & ~a.contains(":::") & ~a.rlike("^:[^:]|[^:]:$") & a.rlike("^([0-9a-f]{0,4}:){2,7}[0-9a-f]{0,4}$")
    return full | short


def folded(text: Column) -> Column:
    """The text as long as it was, in which a value of ASCII in lower case stands wherever it stands in any case."""
    for c, plain in LIKE_ASCII.items():
        text = F.replace(text, F.lit(c), F.lit(plain))
    return F.lower(text)


def runs(text: Column) -> Column:
    """The runs that hold a sign of a shape, each after a line with the length of the text since the run before it."""
    found = F.transform(F.regexp_extract_all(text, F.lit(UP_TO_RUN), F.lit(0)), lambda h: F.struct(h.alias("h"), F.length(F.regexp_extract(h, AHEAD, 0)).alias("n")))
    return F.array_join(F.transform(found, lambda z: F.concat(F.lit("\n"), z["n"].cast("string"), F.lit("\n"), F.substring(z["h"], z["n"] + 1, F.length(z["h"])))), "")


def _unfolded_length(piece: Column) -> Column:
    """How long a piece of :func:`runs` is in the text."""
    skipped = F.regexp_extract_all(piece, F.lit("\n([0-9]+)\n"), F.lit(1))
    return F.length(F.regexp_replace(piece, "\n[0-9]+\n", "")) + F.aggregate(skipped, F.lit(0), lambda n, x: n + x.cast("int"))


def shaped(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s, e, hit, kind) of identifiers by shape, and of existing markers (kind null), in the column ``_t``."""
    every = [*[(k, f"{FLAGS}{BEFORE}{p}{AFTER}") for k, p in SHAPES], ("", MARKER)]
    found = F.array(*[F.struct(F.lit(k).alias("shape"), F.lit(i).alias("nth"), F.lit(p).alias("pattern"), F.regexp_extract_all("_r", F.lit(p), F.lit(0)).alias("hits"))
                      for i, (k, p) in enumerate(every)])
    x = texts.select(*keys, runs(F.col("_t")).alias("_r")).select(*keys, "_r", F.explode(found).alias("f")).select(*keys, "_r", "f.*").where(F.size("hits") > 0)
    both = F.arrays_zip(F.transform(F.split("_r", F.col("pattern"), -1), _unfolded_length).alias("before"), F.col("hits").alias("hit"))
    x = x.select(*keys, "shape", "nth", _once(F.filter(both, lambda z: z["hit"].isNotNull()).cast(PLACE)).alias("places"))
    x = _offsets(x, [*keys, "shape", "nth"])
    ok = F.when(F.col("shape") == "IP4", is_ipv4(F.col("hit"))).when(F.col("shape") == "IP6", is_ipv6(F.col("hit"))).otherwise(True)
    kind = F.when(F.col("shape").startswith("IP"), "IP").when(F.col("shape") != "", F.col("shape"))
    return x.where(ok).select(*keys, "s", "e", "hit", kind.alias("kind"), F.lit(1).alias("rank"))


def known_values(known: DataFrame) -> DataFrame:
    """(word, value, kind): each value in lower case under the word of it that the fewest values have."""
    low = known.select(F.lower(F.trim("value")).alias("value"), F.upper("kind").alias("kind")).where("not value rlike '^[0-9]*$'")
    low = low.groupBy("value").agg(F.min("kind").alias("kind")).withColumn("kind", F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("ID"))
    words = low.select("value", "kind", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit(f"({WORD})"), F.lit(1)))).alias("word"))
    held = words.groupBy("word").agg(F.count("*").alias("n"))
    return words.join(held, "word").groupBy("value", "kind").agg(F.min_by("word", F.struct("n", "word")).alias("word"))


def named(texts: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """(keys, s, e, hit, kind) of the known values in the column ``_t``."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("_t"), F.lit(f"({WORD})"), F.lit(1)))
    asked = texts.select(*keys, F.explode(words).alias("word")).join(known_values(known), "word").drop("word")
    quoted = F.concat(F.lit("\\Q"), F.replace("value", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    pattern = F.concat(F.lit(FLAGS + BEFORE), quoted, F.lit(AFTER))
    # a value of ASCII stands between the first and the last place of its letters; with it go the characters that bound it
    plain = F.col("value").rlike(r"\A[\x00-\x7F]*\z")
    # what follows its last letter has no case, so a text without that is left before it is folded
    end = F.when(plain, F.regexp_extract("value", r"[^a-z]*\z", 0)).otherwise("")
    x = asked.withColumn("plain", plain).withColumn("end", end).join(texts, keys).where(F.contains("_t", "end"))
    x = x.select(*keys, "value", "kind", "plain", "_t", _once(folded(F.col("_t"))).alias("_f"))
    x = x.where(~F.col("plain") | F.contains("_f", "value"))
    first = F.when(F.col("plain"), F.greatest(F.instr("_f", F.col("value")) - 2, F.lit(0))).otherwise(0)
    past = F.when(F.col("plain"), F.length("_f") - F.length(F.expr("substring_index(_f, value, -1)")) + 2).otherwise(F.length("_t"))
    x = x.select(*keys, "value", "kind", "_t", first.alias("first"), past.alias("past"))
    piece = F.substring("_t", F.col("first") + 1, F.col("past") - F.col("first"))
    x = x.select(*keys, "value", "kind", "first", _once(_places(piece, pattern)).alias("places")).where(F.size("places") > 0)
    shifted = F.transform("places", lambda z, i: z.withField("before", z["before"] + F.when(i == 0, F.col("first")).otherwise(0)))
    return _offsets(x.withColumn("places", shifted), [*keys, "value", "kind"]).select(*keys, "s", "e", "hit", "kind", F.lit(0).alias("rank"))


def identifiers(texts: DataFrame, keys: list[str], text: str, known: DataFrame) -> DataFrame:
    """(keys, s, e, kind, norm, value): the places that count. One text's places meet in one row; they are no longer than it."""
    t = texts.select(*keys, F.coalesce(text, F.lit("")).alias("_t"))
    every = shaped(t, keys).unionByName(named(t, keys, known))
    one = F.struct("s", "rank", (-F.col("e")).alias("far"), "e", "kind", "hit")
    g = every.groupBy(*keys).agg(F.sort_array(F.collect_list(one)).alias("all"))
    free = F.filter("all", lambda x: x["kind"].isNotNull() & ~F.exists("marks", lambda m: (m["s"] < x["e"]) & (x["s"] < m["e"])))
    g = g.withColumn("marks", F.filter("all", lambda x: x["kind"].isNull())).withColumn("free", free)
    none = F.filter("free", lambda x: F.lit(False))
    last = lambda kept: F.coalesce(F.try_element_at(kept, F.lit(-1))["e"], F.lit(0))
    kept = F.aggregate("free", none, lambda kept, x: F.when(x["s"] >= last(kept), F.array_append(kept, x)).otherwise(kept))
    return g.select(*keys, F.explode(kept).alias("x")).select(*keys, "x.s", "x.e", "x.kind", F.lower("x.hit").alias("norm"), F.col("x.hit").alias("value"))


def redact(texts: DataFrame, incident: str, seq: str, text: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts with markers, and ``incident, marker, norm, value`` to restore them.

    The number of a marker follows the first place of its value inside the
    incident, and ``value`` is spelled as it is there. ``(incident, seq)``
    names one text. A long incident is numbered by position over slices of its
    texts, so it is never in one task.
    """
    keys = [incident, seq]
    found = cut_lineage(identifiers(texts, keys, text, known))
    first = found.groupBy(incident, "kind", "norm").agg(F.min(F.struct(F.col(seq).alias("q"), "s", "value")).alias("f")).select(
        incident, "kind", "norm", F.col("f.q").alias("_q"), F.col("f.s").alias("_s"), "f.value")
    numbered = with_position(first, [incident, "kind"], "_q", 0, ["_s", "norm"], bucket=F.floor(F.col("_q") / 256))
    marks = numbered.select(incident, "kind", "norm", "value", F.concat(F.lit("["), "kind", F.lit("_"), F.col("pos").cast("string"), F.lit("]")).alias("marker"))
    placed = found.drop("value").join(marks, [incident, "kind", "norm"]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("s", "e", "marker"))).alias("_m"))
    j = texts.join(placed, keys, "left")
    m = F.col("_m")
    start_of = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.try_element_at(m, i)["e"])
    pieces = F.transform(m, lambda x, i: F.concat(F.substring(F.col(text), start_of(i) + 1, x["s"] - start_of(i)), x["marker"]))
    tail = F.substring(F.col(text), F.try_element_at(m, F.lit(-1))["e"] + 1, F.length(text))
    out = F.when(m.isNull(), F.col(text)).otherwise(F.concat(F.array_join(pieces, ""), tail))
    return j.select(*[c for c in texts.columns if c != text], out.alias(text)), marks.select(incident, "marker", "norm", "value")


def restore(texts: DataFrame, incident: str, seq: str, text: str, mapping: DataFrame) -> DataFrame:
    """Markers back to values; a marker that is not in the map stays."""
    marks = texts.select(incident, seq, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"({MARKER})"), F.lit(1)))).alias("marker"))
    hits = marks.join(mapping, [incident, "marker"]).groupBy(incident, seq).agg(
        F.collect_set(F.struct("marker", "value")).alias("_m"))
    j = texts.join(hits, [incident, seq], "left")
    back = F.aggregate(F.coalesce("_m", F.array().cast("array<struct<marker:string,value:string>>")), F.col(text),
                       lambda s, x: F.replace(s, x["marker"], x["value"]))
    return j.select(*[c for c in texts.columns if c != text], back.alias(text))


