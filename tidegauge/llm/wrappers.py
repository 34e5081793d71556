"""Main text of web pages by wrappers inferred for each host.

A wrapper is a union-free regular expression over a host's token streams: elements in order, each plain, optional, repeated
or both, and text slots. A page becomes such an expression at once: neighbouring groups of like elements are one repeated
group. Two expressions are aligned element by element (longest common subsequence); what only one of them has becomes
optional, what is repeated in one is repeated, and texts that differ become slots. Alignment is associative enough to be
done piecewise: each task folds the pages it reads, then each (host, slice) folds what came from the tasks, then each host.

The host's wrapper decides which slots hold the main text: those inside article or main elements, else those that are
neither furniture (menus, headers, footers, sidebars, notices, adverts, forms, comments) nor the same text on most of the host's pages
nor, on all pages, mostly links. Words in class and id are a weak vote: they must name the element as a whole ("site-footer", not "with-sidebar"),
inline elements are part of their sentence whatever they are called, and where nothing else is left on a page without article
or main element, what only words have marked is its text.
Pages count once however often they were copied: a page is known by the two longest of its other texts, so copies that differ
elsewhere are one page too, and a slot's pages are counted by the SEEN smallest digests (exact up to SEEN, estimated above).

Defined cases: a null page is empty, its text is empty; a null URL is the host without a name; cut-off pages, unclosed and
stray tags are read as browsers do, and as in browsers elements nested deeper than DEPTH are put beside each other; repeated rows get equal results; pages of any length are read whole; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title object canvas math select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
FURNITURE = frozenset("nav footer aside form button dialog menu fieldset label option legend head datalist".split())
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Containers that can be the main part by their attributes, the names that make them so, and the blocks of text it must hold.
CONTAINERS = frozenset("div section td".split())
MAIN_NAMES = frozenset("main main-content".split())
BLOCKS = frozenset("p pre blockquote li dd td th".split())
CLOSES = {"p": frozenset("p".split()), "li": frozenset("li".split()), "dt": frozenset("dt dd".split()), "dd": frozenset("dt dd".split()), "tr": frozenset("tr td th".split()), "td": frozenset("td th".split()),
          "th": frozenset("td th".split())}
#: Block elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements over which an implied end does not reach.
SCOPE = frozenset("article aside body div footer form header html main nav section table ul ol dl td th blockquote".split())
#: Words in class, id or role that mark furniture.
WORDS = frozenset(("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr login menu modal nav navbar "
                   "navigation newsletter notice notices popup promo promotion related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget "
                   "contentinfo complementary masthead alert").split())
#: Of these, the ones that mark even an article element, as reader comments and teasers are marked up.
OF_ARTICLES = frozenset("ad advert comment comments promo related reply replies sponsored".split())
#: Parts that leave the meaning of a word as it is ("footer-links"), and parts that turn it round ("no-ads", "with-sidebar").
PLACES = frozenset(("area bar block body bottom box button buttons column container content form group header holder inner item items left link links list outer panel posts right row section slot "
                    "text title top unit wrap wrapper").split())
TURNS = frozenset("no non not without with has hide hides is".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
READ = frozenset("class id role hidden aria-hidden style".split())
WHITE = re.compile(r"\s+")
#: Levels of elements that are kept; browsers have such a limit too.
DEPTH = 200
#: Share of a text's characters that stand in links, from which on it is one of a list of links.
LINKS = 0.7


class Node:
    """An element (name, label, children) or, with name "#", a run of text, of which ``links`` characters stand in links."""

    __slots__ = ("name", "label", "children", "text", "links")

    def __init__(self, name: str, label: str, text: str = "", links: int = 0):
        self.name, self.label, self.children, self.text, self.links = name, label, [], text, links


def names_furniture(word: str, words: frozenset[str]) -> bool:
    """Whether a class or id as a whole names a piece of furniture: its last part does, or some part does and all others only say where."""
    parts = [p for p in re.split(r"[^a-z]+", word) if p]
    if not parts or words.isdisjoint(parts) or not TURNS.isdisjoint(parts):
        return False
    return parts[-1] in words or all(p in words or p in PLACES for p in parts)


def _label(name: str, attrs: str) -> str:
    """The element's name, with - where its attributes hide it, ! where their words mark furniture, and * where they mark the main part."""
    marked = main = False
    for key, *values in ATTR.findall(attrs) if attrs else ():
        key = key.lower()
        if key not in READ:
            continue
        value = "".join(values).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return name + "-"
        if key in ("class", "id", "role"):
            marked |= any(names_furniture(w, OF_ARTICLES if name in MAIN else WORDS) for w in value.split())
            main |= name in CONTAINERS and not MAIN_NAMES.isdisjoint(value.split())
    return name + ("!" if marked else "*" if main else "")


def tree(page: str) -> Node:
    """The page's block elements and the texts between them; inline elements are part of the text, but for hidden ones."""
    root = Node("html", "html")
    stack, at = [root], 0
    opened: dict[str, int] = {}
    text: list[tuple[str, bool]] = []  # with whether it stands in a link
    marked: list[list] = []  # inline elements that are hidden or marked: label, depth of their name
    plain, label_of_text = False, ""  # whether the text has more than marked inline elements

    def flush() -> None:
        nonlocal plain, label_of_text
        if text:
            t = WHITE.sub(" ", entities.unescape("".join(x for x, _ in text))).strip()
            if t:
                links = sum(len(x) for x, in_link in text if in_link)
                node = Node("#", "#", t, min(links, len(t)))
                if not plain and label_of_text:  # a marked inline element that stands for itself is a block
                    box = Node(label_of_text[:-1], label_of_text)
                    box.children.append(node)
                    node = box
                stack[-1].children.append(node)
            text.clear()
        plain, label_of_text = False, ""

    def cut(k: int) -> None:
        for n in stack[k:]:
            opened[n.name] -= 1
        del stack[k:]

    def close(names: frozenset[str], scope: frozenset[str]) -> None:
        if not any(opened.get(n) for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                flush()
                cut(k)
                return
            if stack[k].name in scope:
                return

    def push(name: str, label: str) -> None:
        node = Node(name, label)
        stack[min(len(stack), DEPTH) - 1].children.append(node)
        stack.append(node)
        opened[name] = opened.get(name, 0) + 1

    def add(piece: str) -> None:
        nonlocal plain, label_of_text
        if piece and not (marked and marked[-1][0][-1] == "-"):
            text.append((piece, links > 0))
            if marked:
                label_of_text = label_of_text or marked[0][0]
            elif not piece.isspace():
                plain = True

    links = 0
    while m := TOKEN.search(page, at):
        add(page[at:m.start()])
        at = m.end()
        name = (m["tag"] or "").lower()
        if not name or name in ("html", "body"):
            continue
        if name in INLINE and name not in VOID:
            if m["end"]:
                if marked and marked[-1][0][:-1] == name:
                    marked[-1][1] -= 1
                    if not marked[-1][1]:
                        marked.pop()
                elif opened.get(name):
                    close(frozenset([name]), SCOPE)
                links -= name == "a" and links > 0
                continue
            links = 1 if name == "a" else links  # links do not nest
            label = _label(name, m["attrs"])
            if marked and marked[-1][0][:-1] == name:
                marked[-1][1] += 1
            elif label != name:
                marked.append([label, 1])
            continue
        if m["end"]:
            if opened.get(name):
                marked.clear()
                links = 0
                close(frozenset([name]), frozenset())
            continue
        if name in RAW:
            if not m["attrs"].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in VOID:
            if name == "br":
                add(" ")
            elif name not in INLINE:
                flush()
            continue
        label = _label(name, m["attrs"])
        if name in ENDS_P:
            close(CLOSES["p"], SCOPE)
        elif name in CLOSES:
            close(CLOSES[name], SCOPE)
        flush()
        for x, _ in marked:  # blocks inside a marked inline element are inside its box
            push(x[:-1], x)
        marked.clear()
        push(name, label)
    add(page[at:])
    flush()
    return root


def texts_of(node: Node) -> set[str]:
    return {node.text} if node.name == "#" else set().union(*map(texts_of, node.children))


def text_digest(text: str) -> str:
    return hashlib.blake2b(text.encode(), digest_size=6).hexdigest()


def page_digest(longest: list[str], text: str = "") -> int:
    """The page as it is known beside ``text``."""
    return int.from_bytes(hashlib.blake2b("\0".join([t for t in longest if t != text][:2]).encode(), digest_size=6).digest(), "big")


def expression(node: Node, longest: list[str] | None = None) -> list:
    """[label, mark, text, children, for texts: digests of pages, whether all are links] with neighbouring groups of equal shape (up to three elements long) as
    one repeated group. In the place of its text, the root has the digests of all pages."""
    root = longest is None
    if longest is None:
        longest = sorted(texts_of(node), key=lambda t: (-len(t), t))[:3]
    if node.name == "#":
        return ["#", "", text_digest(node.text), [], [page_digest(longest, node.text)], node.links >= LINKS * len(node.text)]
    out: list[list] = []
    shapes: list[str] = []
    for child in node.children:
        e = expression(child, longest)
        out.append(e)
        shapes.append(shape(e))
        for k in (1, 2, 3):
            if len(out) >= 2 * k and shapes[-k:] == shapes[-2 * k:-k]:
                for a, b in zip(out[-2 * k:-k], out[-k:], strict=True):
                    a[:] = once(merged(a, b))
                    a[1] = "+"
                del out[-k:], shapes[-k:]
                break
    return [node.label, "", [page_digest(longest)] if root and longest else None, out]


def seen(a: list[int] | None, b: list[int] | None) -> list[int]:
    """The smallest digests of both."""
    return a or [] if a == b else sorted({*(a or []), *(b or [])})[:SEEN]


def count(digests: list[int] | None) -> float:
    n = len(digests or [])
    return n if n < SEEN else (SEEN - 1) * 2.0 ** 48 / max(digests[-1], 1)


def once(e: list) -> list:
    """What is repeated within a page is still seen on one page."""
    return ["#", e[1], e[2], [], e[4][:1], e[5]] if e[0] == "#" else [*e[:3], list(map(once, e[3]))]


def shape(e: list) -> str:
    """Structure without marks and texts."""
    return e[0] + ("(" + ",".join(map(shape, e[3])) + ")" if e[3] else "")


MARKS = {frozenset(): "", frozenset("?"): "?", frozenset("+"): "+", frozenset("?+"): "*"}


def _mark(*marks: str) -> str:
    return MARKS[frozenset("".join(m.replace("*", "?+") for m in marks))]


def merged(a: list, b: list) -> list:
    """The alignment of two expressions with the same label."""
    if a[0] != "#":
        pages = None if a[2] is None and b[2] is None else seen(a[2], b[2])
        return [a[0], _mark(a[1], b[1]), pages, aligned(a[3], b[3])]
    same = a[2] == b[2] and a[2] is not None
    return ["#", _mark(a[1], b[1]), a[2] if same else None, [], seen(a[4], b[4]) if same else [], a[5] and b[5]]


def settled(e: list, pages: float | None = None) -> list:
    """The finished wrapper of a host: constant texts are those on most of its pages, and on two at least, and slots that are lists of
    links; digests are left out."""
    if pages is None:
        pages = count(e[2])
    if e[0] == "#":
        n = count(e[4])
        return [*e[:2], e[2] if n > 1 and 2 * n > pages else "links" if e[5] else None, []]
    return [*e[:2], None, [settled(c, pages) for c in e[3]]]


#: Up to so many pairs of elements the alignment is a longest common subsequence; beyond, the next like element within REACH.
PAIRS, REACH = 100_000, 64


def _matches(x: list[str], y: list[str]) -> list[tuple[int, int]]:
    """Places of like elements, rising on both sides."""
    n, m = len(x), len(y)
    if n * m > PAIRS:
        where: dict[str, list[int]] = {}
        for j, label in enumerate(y):
            where.setdefault(label, []).append(j)
        out, j = [], 0
        for i, label in enumerate(x):
            at = where.get(label, [])
            k = bisect_left(at, j)
            if k < len(at) and at[k] - j <= REACH:
                out.append((i, at[k]))
                j = at[k] + 1
        return out
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def aligned(a: list[list], b: list[list]) -> list[list]:
    x, y = [e[0] for e in a], [e[0] for e in b]
    if x == y:
        return [merged(p, q) for p, q in zip(a, b, strict=True)]
    out, i, j = [], 0, 0
    for p, q in [*_matches(x, y), (len(x), len(y))]:
        out += [[e[0], _mark(e[1], "?"), *e[2:]] for e in a[i:p] + b[j:q]]
        if p < len(x):
            out.append(merged(a[p], b[q]))
        i, j = p + 1, q + 1
    return squashed(out)


def squashed(nodes: list[list]) -> list[list]:
    """Neighbours with one label, of which one is optional, are one repeated group: expressions stay as long as the template."""
    out: list[list] = []
    for e in nodes:
        if out and out[-1][0] == e[0] and (out[-1][1] in "?*" and out[-1][1] or e[1] in "?*" and e[1]):
            optional = "?" if out[-1][1] in ("?", "*") and e[1] in ("?", "*") else ""
            out[-1] = merged(out[-1], e)
            out[-1][1] = _mark("+", optional)
        else:
            out.append(e)
    return out


def furniture(label: str, inside_main: bool) -> bool:
    name = label.rstrip("!*-")
    return name in FURNITURE or label[-1] in "!-" or name == "header" and not inside_main


def holds_main(e: list) -> bool:
    """Whether a main element lies below: a frame around it is no furniture, whatever its class says."""
    return any(is_main(c) or holds_main(c) for c in e[3])


def is_main(e: list) -> bool:
    """An article or main element, or a container named so that holds blocks of text."""
    return e[0] in MAIN or e[0].endswith("*") and holds_blocks(e)


def holds_blocks(e: list) -> bool:
    return any(c[0].rstrip("!*-") in BLOCKS and any(x[0] == "#" for x in c[3]) or holds_blocks(c) for c in e[3] if not furniture(c[0], True))


def decisions(wrapper: list) -> dict[tuple[str, ...], str]:
    """What each text slot (the labels down to it) is: main (in an article or main element), named (in a container named main), body
    (elsewhere), all (elsewhere, and the same text on most pages of the host or a list of links), Words (dropped for words in class or id
    alone), or not in the result."""
    out: dict[tuple[str, ...], str] = {}

    def walk(e: list, path: tuple[str, ...], main: bool, dropped: str) -> None:
        if e[0] == "#":
            own = "main" if main and not MAIN.isdisjoint(path) else "named" if main else "all" if e[2] is not None else "body"
            kind = own if not dropped else "Words" if dropped == "words" and own == "body" else ""
            out[path] = max(out.get(path, ""), kind)
            if kind == "all":  # slots with the same path can differ: what made this one furniture holds for its texts alone
                out["=", e[2], *path] = kind
            return
        if furniture(e[0], main) and (main or not holds_main(e)) and dropped != "sure":
            dropped = "words" if e[0][-1] == "!" and not furniture(e[0][:-1], main) else "sure"
        main = main or is_main(e)
        for c in e[3]:
            walk(c, (*path, e[0]), main, dropped)
    walk(wrapper, (), False, "")
    return out


def main_text(root: Node, slots: dict[tuple[str, ...], str]) -> str:
    """The blocks of the page that lie in main slots; on a page without any, those in body slots; without those too, in the rest.
    Without a main element, what only words have marked comes before what is the same on most pages.
    What is only named main counts as main where the page has blocks of text in it, else as body."""
    found: list[tuple[str, str]] = []
    blocks = has_main = False

    def walk(node: Node, path: tuple[str, ...], named: bool, block: bool) -> None:
        nonlocal blocks, has_main
        has_main |= node.name in MAIN and node.label == node.name
        if node.name == "#":
            kind = slots.get(path, "")
            if kind == "body" and (("=", text_digest(node.text), *path) in slots or node.links >= LINKS * len(node.text) and ("=", "links", *path) in slots):
                kind = "all"
            blocks |= named and block and kind in ("main", "named")
            found.append((kind, node.text))
            return
        block = named and (block or node.name in BLOCKS)
        for c in node.children:
            walk(c, (*path, node.label), named or node.label.endswith("*"), block)
    walk(root, (), False, False)
    ranks = (("main", "named"), ("body",), ("all",)) if blocks else (("main",), ("body", "named"), ("all",))
    ranks = ranks if has_main else (*ranks[:2], ("Words",), ranks[2])
    return "\n\n".join(next(filter(None, ([t for kind, t in found if kind in rank] for rank in ranks)), []))


_OUT = pa.schema([("host", pa.string()), ("slice", pa.int32()), ("pages", pa.int64()), ("wrapper", pa.string())])
_DDL = "host string, slice int, pages bigint, wrapper string"
SLICES = 16
OPEN = 2_000
SEEN = 64


def _rows(wrappers: dict) -> pa.RecordBatch:
    rows = [(*k[:2], n, json.dumps(w)) for k, (n, w) in wrappers.items()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 4, _OUT, strict=True)], schema=_OUT)


def _of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds the pages a task reads; what it holds is a wrapper for each of at most OPEN (host, slice)."""
    held: dict[tuple[str, int], tuple[int, list]] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                e = expression(tree(page))
                key = (host, int.from_bytes(hashlib.blake2b(shape(e).encode(), digest_size=2).digest(), "little") % SLICES)
                held[key] = (held[key][0] + 1, merged(held[key][1], e)) if key in held else (1, e)
            if len(held) > OPEN:
                yield _rows(held)
                held = {}
    yield _rows(held)


def _of_wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds sorted wrappers; only the current (host, slice) is held."""
    key, n, wrapper = None, 0, None
    for batch in batches:
        for host, part, pages, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            e = json.loads(text)
            if (host, part) == key:
                n, wrapper = n + pages, merged(wrapper, e)
            else:
                if key is not None:
                    yield _rows({key: (n, wrapper)})
                key, n, wrapper = (host, part), pages, e
    if key is not None:
        yield _rows({key: (n, wrapper)})


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _of_wrappers(batches):
        yield _rows({(host, part): (n, settled(json.loads(w))) for host, part, n, w in zip(*[c.to_pylist() for c in batch.columns], strict=True)})


def infer(pages: DataFrame) -> DataFrame:
    """(host, pages, wrapper) from rows of (host, html)."""
    w = pages.select("host", "html").mapInArrow(_of_pages, _DDL)
    w = w.repartition("host", "slice").sortWithinPartitions("host", "slice").mapInArrow(_of_wrappers, _DDL)
    w = w.withColumn("slice", F.lit(0)).repartition("host").sortWithinPartitions("host").mapInArrow(_finished, _DDL)
    return w.select("host", "pages", "wrapper")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    host = F.lower(F.regexp_extract(F.coalesce(pages[url_col], F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    d = pages.select(pages[id_col].alias("page_id"), pages[url_col].alias("url"), host.alias("host"), F.coalesce(pages[html_col], F.lit("")).alias("html"))
    w = infer(d).select("host", "wrapper")
    # one wrapper a host: a host with very many pages is split on the side of the pages
    joined = d.join(w.hint("shuffle_hash"), "host").select("page_id", "url", "html", "wrapper")
    ids = d.schema["page_id"].dataType.simpleString()
    schema = pa.schema([("page_id", pa.int64() if ids == "bigint" else pa.int32() if ids == "int" else pa.string()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                i, url, page, wrapper = (c.to_pylist() for c in batch.slice(at, 256).columns)
                texts = []
                for p, x in zip(page, wrapper, strict=True):
                    if x not in known:
                        if len(known) > 500:
                            known.clear()
                        known[x] = decisions(json.loads(x))
                    texts.append(main_text(tree(p), known[x]))
                yield pa.RecordBatch.from_arrays([pa.array(i, schema.field(0).type), pa.array(url, pa.string()), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)
    return joined.mapInArrow(run, f"page_id {ids}, url string, text string, n_chars bigint")
