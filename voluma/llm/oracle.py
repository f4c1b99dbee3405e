"""DuckDB twins of the llm queries that SQL can express on whole tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

#: A word is a run of ASCII letters and digits and of characters past ASCII; A-Z is lowered first.
_WORDS = r"""regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES["op3_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS.format(text="text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(text="text")} AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS gram
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM g),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT p.doc_id, p.i, p.n, g.item_id FROM p JOIN g ON p.gram = g.gram AND p.n = g.n),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)
"""

ORACLES["op7_warc_zip"] = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr(
      '0000000100100011010001010110011110001001101010111100110111101111', instr('0123456789abcdef', h[i]) * 4 - 3, 4)), '') AS bits FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + 16 * CAST(bits[5*j+1] AS INTEGER) + 8 * CAST(bits[5*j+2] AS INTEGER) + 4 * CAST(bits[5*j+3] AS INTEGER)
        + 2 * CAST(bits[5*j+4] AS INTEGER) + CAST(bits[5*j+5] AS INTEGER), 1)), '') AS payload_digest FROM b),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

_STEPS = []
for _i in range(1, 7):  # smallest label that a node touches, followed 8 times, 6 rounds
    _STEPS.append(f"h{_i}_0 AS MATERIALIZED (SELECT a.c, min(least(a.c, b.c)) AS m FROM c{_i - 1} a LEFT JOIN e ON e.u = a.id LEFT JOIN c{_i - 1} b ON b.id = e.v GROUP BY a.c)")
    _STEPS += [f"h{_i}_{_j} AS MATERIALIZED (SELECT a.c, b.m FROM h{_i}_{_j - 1} a JOIN h{_i}_{_j - 1} b ON b.c = a.m)" for _j in range(1, 4)]
    _STEPS.append(f"c{_i} AS MATERIALIZED (SELECT a.id, h.m AS c FROM c{_i - 1} a JOIN h{_i}_3 h ON h.c = a.c)")
ORACLES["op5_minhash_near_dedup"] = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, w[i] || ' ' || w[i + 1] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w WHERE len(w) >= 2)
  UNION ALL SELECT doc_id, w[1] FROM w WHERE len(w) = 1)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
e AS MATERIALIZED (SELECT x AS u, y AS v FROM l UNION ALL SELECT y, x FROM l),
c0 AS MATERIALIZED (SELECT doc_id AS id, doc_id AS c FROM documents),
{", ".join(_STEPS)}
SELECT id AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, id = c AS kept FROM c6 LEFT JOIN n ON n.doc_id = id
"""

_LEVELS = []
for _i in range(1, 8):  # as many levels as 16^7 rows of a source, or sources, need; a tree that is one node already stays as it is
    for _t, _o in (("n", "leaves"), ("u", "tops")):
        _from = f"{_t}{_i - 1}" if _i > 1 else f"{_o}"
        _LEVELS.append(f"{_t}{_i} AS MATERIALIZED (SELECT g, pos // 16 AS pos, max(n + 15) // 16 AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE max(h) END AS h FROM {_from} GROUP BY g, pos // 16)")
_N_LEVELS = [x for x in _LEVELS if x.startswith("n")]
_U_LEVELS = [x for x in _LEVELS if x.startswith("u")]


def _siblings(prefix: str, base: str) -> str:
    """g, pos, level, before, after of every node of the base level: the siblings on its way up."""
    parts = []
    for level in range(7):
        nodes, step = (f"{prefix}{level}" if level else base), 16**level
        parts.append(f"""SELECT b.g, b.pos, {level} AS level, coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < b.pos // {step}), '') AS before,
          coalesce(string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > b.pos // {step}), '') AS after
          FROM {base} b JOIN {nodes} s ON s.g = b.g AND s.pos // 16 = b.pos // {step * 16} WHERE s.n > 1 GROUP BY b.g, b.pos""")
    return " UNION ALL ".join(parts)


_FIELD = "coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
_CRC_TABLE = "SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([CAST(i AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))"
_FOLDS = [f"f{_i} AS (SELECT f.doc_id, f.g, f.pos, f.ga, f.leaf, CASE WHEN w.level IS NULL THEN f.h ELSE sha256(w.before || f.h || w.after) END AS h FROM f{_i - 1} f LEFT JOIN {_w} w ON w.g = f.g AND w.pos = f.pos AND w.level = {_i - 1})" for _i, _w in ((i, "wn") for i in range(1, 8))]
_FOLDS += [f"f{_i} AS (SELECT f.doc_id, f.g, f.pos, f.ga, f.leaf, CASE WHEN w.level IS NULL THEN f.h ELSE sha256(w.before || f.h || w.after) END AS h FROM f{_i - 1} f LEFT JOIN wu w ON w.pos = f.ga AND w.level = {_i - 8})" for _i in range(8, 15)]
ORACLES["op13_merkle_manifest"] = f"""
WITH crc AS ({_CRC_TABLE}),
d AS (SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
      lambda s, b: xor(s // 256, t[1 + xor(s % 256, b)]))) AS crc FROM documents, crc),
x AS (SELECT doc_id, coalesce('=' || source, '') AS g, crc,
      sha256({" || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", "text"))}) AS leaf,
      sha256({" || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars"))} || {_FIELD.format(c="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS lowered FROM d),
leaves AS MATERIALIZED (SELECT *, leaf AS h, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM x),
{", ".join(_N_LEVELS)},
tops AS MATERIALIZED (SELECT '' AS g, g AS source, h, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM n7),
{", ".join(_U_LEVELS)},
wn AS MATERIALIZED ({_siblings("n", "leaves")}),
wu AS MATERIALIZED ({_siblings("u", "tops")}),
f0 AS (SELECT l.doc_id, l.g, l.pos, t.pos AS ga, l.leaf, CASE WHEN l.crc % 5 = 0 THEN l.lowered ELSE l.leaf END AS h FROM leaves l JOIN tops t ON t.source = l.g),
{", ".join(_FOLDS)},
pn AS (SELECT g, pos, string_agg(before || after, '' ORDER BY level) AS p FROM wn GROUP BY g, pos),
pu AS (SELECT pos, string_agg(before || after, '' ORDER BY level) AS p FROM wu GROUP BY pos)
SELECT f.doc_id, f.leaf, t.h AS subroot, r.h AS root, sha256(coalesce(pn.p, '') || coalesce(pu.p, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM f14 f JOIN tops t ON t.source = f.g CROSS JOIN u7 r LEFT JOIN pn ON pn.g = f.g AND pn.pos = f.pos LEFT JOIN pu ON pu.pos = f.ga
"""
