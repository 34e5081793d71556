"""SQL for the checker, written from the contracts alone: no index, every window and place of every text is looked at."""

from __future__ import annotations

from .licenses import LEAST_SHARE, TEMPLATES
from .secrets import BASE, RULES

GAP = r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
WORDS = f"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {GAP}), lambda x: x <> '')"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def secrets() -> str:
    parts = []
    for rank, r in enumerate(RULES):
        p = quoted(r.pattern)
        parts.append(f"""SELECT rid, {rank} AS rank, '{r.kind}' AS kind, e - l AS s, e FROM (
          SELECT rid, l, g, sum(b + l) OVER (PARTITION BY rid ORDER BY i) AS e FROM (
            SELECT rid, i, length(pieces[i]) AS b, length(found[i]) AS l, length(measured[i]) AS g FROM (
              SELECT rid, pieces, found, measured, unnest(range(1, len(found) + 1)) AS i FROM (
                SELECT rid, string_split_regex(t, {p}) AS pieces, regexp_extract_all(t, {p}, 0) AS found, regexp_extract_all(t, {p}, {r.measured}) AS measured FROM d)))) WHERE g >= {r.least}""")
    base = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE)
    counts = ", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)
    one = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, rank"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), m AS ({' UNION ALL '.join(parts)}),
      g AS (SELECT rid, {base}, string_agg({one}) AS spans, string_agg({one}) FILTER (rank < {len(BASE)}) AS base FROM m GROUP BY rid)
      SELECT doc_id, {counts}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""


def licenses() -> str:
    rows = ", ".join(f"({quoted(t.label)}, {t.base}, {t.words.split()!r}, {t.at}, {t.key.split()!r})" for t in TEMPLATES)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
      t AS (SELECT * FROM (VALUES {rows}) AS v(label, base, words, key_at, key_words)),
      laid AS (SELECT rid, w, label, base, words, p - key_at AS start FROM (SELECT rid, w, label, base, words, key_at, key_words, unnest(range(0, len(w))) AS p FROM d, t
        WHERE list_has_all(w, key_words)) WHERE w[p + 1:p + len(key_words)] = key_words),
      m AS (SELECT rid, label, base, start, len(list_filter(range(0, len(words)), lambda j: start + j >= 0 AND w[CASE WHEN start + j >= 0 THEN start + j + 1 ELSE 1 END] = words[j + 1])) / len(words) AS score FROM laid),
      g AS (SELECT rid, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
        FROM m WHERE score >= {LEAST_SHARE} GROUP BY rid)
      SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
        coalesce(score, 0.0) AS score FROM d LEFT JOIN g USING (rid)"""


def decontamination(width: int = 10) -> str:
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
      i AS (SELECT item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
      win AS (SELECT DISTINCT item_id, least(len(w), {width}) AS n, array_to_string(w[p:p + least(len(w), {width}) - 1], ' ') AS x
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {width}) + 2)) AS p FROM i WHERE len(w) > 0)),
      laid AS (SELECT rid, n, p, array_to_string(w[p:p + n - 1], ' ') AS x FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
      h AS (SELECT DISTINCT rid, p, n, item_id FROM laid JOIN win USING (n, x)),
      hit AS (SELECT rid, count(*) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(p, p + n)) AS q FROM h) GROUP BY rid),
      named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY rid)
      SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)"""


def divergence(least_docs: int = 3, top: int = 200) -> str:
    gap = r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+'"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    p = "CAST(1 + (1000000000::HUGEINT * ({} + 1)) // ({} + {}) AS HUGEINT)"
    f = "CAST((p - q) * (p - q) // q AS HUGEINT)"
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({low}, {gap}) AS w FROM documents),
      t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
      l AS (SELECT lang, term, count(*) AS n FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= {least_docs}),
      ln AS (SELECT lang, count(*) AS v, sum(n) AS total FROM l GROUP BY ALL),
      c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN l USING (lang, term) GROUP BY ALL),
      g AS (SELECT lang, source, coalesce(v, 0) AS v, coalesce(total, 0) AS total, coalesce(own, 0) AS own FROM (SELECT DISTINCT lang, source FROM d)
        LEFT JOIN ln USING (lang) LEFT JOIN (SELECT lang, source, sum(n) AS own FROM c GROUP BY ALL) USING (lang, source)),
      a AS (SELECT g.lang, g.source, l.term, {p.format("coalesce(c.n, 0)", "g.own", "g.v")} AS p, coalesce(c.n, 0) AS n, {p.format("l.n", "g.total", "g.v")} AS q
        FROM g JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = l.term),
      e AS (SELECT lang, source, item, sum({f}) AS value FROM (SELECT a.lang, a.source, b.source AS item, a.p, b.p AS q FROM a JOIN a b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source) GROUP BY ALL),
      x AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
          LEFT JOIN e ON e.lang = g.lang AND e.source = g.source AND e.item = h.source
        UNION ALL SELECT lang, source, 'term', term, {f} FROM a WHERE n > 0 AND p > q),
      r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
      SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= {top}"""


def merkle() -> str:
    def leaf(text: str) -> str:
        values = ("doc_id", "source", "lang", "n_chars", text)
        return "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + ")"
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""
    up = """SELECT tree, 0 AS lvl, idx, h, cnt FROM {0} UNION ALL SELECT tree, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (any_value(cnt) + 2) // 3 FROM {1} WHERE cnt > 1 GROUP BY tree, lvl, idx // 3"""
    fold = """UNION ALL SELECT rid, f.tree, lvl + 1, idx // 3, sha256(l || h || r), proof || l || r FROM {} f JOIN sib USING (tree, lvl, idx)"""
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('s' || source, '') AS tree, {leaf("text")} AS h,
        CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS other FROM documents),
      n AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h, rid) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS cnt FROM d),
      up AS ({up.format("n", "up")}),
      sub AS (SELECT '*' AS tree, tree AS src, row_number() OVER (ORDER BY tree) - 1 AS idx, h, count(*) OVER () AS cnt FROM up WHERE cnt = 1),
      top AS ({up.format("sub", "top")}),
      every AS (SELECT * FROM up UNION ALL SELECT * FROM top),
      sib AS (SELECT a.tree, a.lvl, a.idx, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS r
        FROM every a JOIN every b ON a.tree = b.tree AND a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.cnt > 1 GROUP BY a.tree, a.lvl, a.idx),
      f AS (SELECT rid, tree, 0 AS lvl, idx, other AS h, '' AS proof FROM n {fold.format("f")}),
      f1 AS (SELECT rid, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM f GROUP BY rid),
      g AS (SELECT rid, '*' AS tree, 0 AS lvl, sub.idx, f1.h, proof FROM f1 JOIN n USING (rid) JOIN sub ON sub.src = n.tree {fold.format("g")}),
      g1 AS (SELECT rid, arg_max(h, lvl) AS h, arg_max(proof, lvl) AS proof FROM g GROUP BY rid)
      SELECT doc_id, n.h AS leaf, sub.h AS subroot, top.h AS root, sha256(proof) AS proof_sha256, g1.h AS folded_root, g1.h = top.h AS verified
      FROM n JOIN g1 USING (rid) JOIN sub ON sub.src = n.tree JOIN top ON top.cnt = 1"""
