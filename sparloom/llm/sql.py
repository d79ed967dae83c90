"""DuckDB SQL for the numbered queries that SQL can express."""

from __future__ import annotations

from . import secrets

ASCII_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({ASCII_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = rf"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, list_slice(w, i, i + least(13, len(w)) - 1) AS win
  FROM item, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS r(i) WHERE len(w) > 0),
doc AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
hits AS (
  SELECT d.doc_id, d.i, d.n, x.item_id FROM (
    SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS win FROM doc, sizes, unnest(range(1, len(w) - n + 2)) AS r(i)) d
  JOIN windows x ON d.win = x.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: A turn's marks take 12 + 1 + 11 characters; each control string in a text takes a backslash more.
OP3 = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def _matches(kind: str, pattern: str) -> str:
    """Spans of a kind: what stands before a match is all the pieces and matches before it."""
    return rf"""
SELECT doc_id, '{kind}' AS kind, {secrets.KINDS.index(kind)} AS rank, found[i] AS run,
  CAST(list_sum(list_transform(piece[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(found[1:i-1], lambda p: length(p))), 0) AS BIGINT) AS s
FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found, regexp_split_to_array(text, '{pattern}') AS piece
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)), unnest(range(1, len(found) + 1)) AS r(i)"""


def _op9() -> str:
    quote = lambda p: p.replace("'", "''").replace("(?<![0-9a-f])", "").replace("(?<![A-Za-z0-9+/_-])", "").replace("(?<![0-9A-Fa-f])", "")
    table = "[" + ", ".join(str(secrets.weight(n)) for n in range(1, secrets.WINDOW + 1)) + "]"
    w = secrets.WINDOW
    runs = []
    for kind, c in secrets.CLASSES.items():
        needs = "".join(f" AND regexp_matches(run, '{n}')" for n in c["needs"])
        runs.append(rf"""
SELECT doc_id, kind, rank, run, s FROM ({_matches(kind, quote(c["run"]))}) x
WHERE NOT regexp_matches(run, '(?i){"|".join(secrets.ALLOW)}'){needs}
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = x.doc_id AND b.s < x.s + length(run) AND x.s < b.s + length(b.run))
  AND list_min(list_transform(range(1, length(run) - {w} + 2), lambda i: list_sum(list_transform(list_distinct(string_split(substring(run, i, {w}), '')),
    lambda c: {table}[len(list_filter(string_split(substring(run, i, {w}), ''), lambda y: y = c))])))) <= {secrets.weight_bound(c["bits"])}""")
    return rf"""
WITH base AS (
SELECT * FROM ({_matches("assign", quote(secrets.ASSIGN))}) WHERE length(regexp_replace(run, '{quote(secrets.ASSIGN_HEAD)}', '')) >= {secrets.ASSIGN_LEAST}
UNION ALL {_matches("access", quote(secrets.ACCESS))}
UNION ALL {_matches("hex", quote(secrets.HEX))}),
every AS (SELECT * FROM base UNION ALL {" UNION ALL ".join(runs)}),
joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    coalesce(string_agg(kind || ':' || s || ':' || (s + length(run)), ',' ORDER BY s, rank, length(run)) FILTER (rank < 3), '') AS base,
    string_agg(kind || ':' || s || ':' || (s + length(run)), ',' ORDER BY s, rank, length(run)) AS spans
  FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN joined USING (doc_id)
"""


def _crc32(digits: str) -> str:
    """CRC-32 of ASCII text, a bit at a time."""
    step = "lambda d, z: xor(d >> 1, CAST(3988292384 AS BIGINT) * (d & 1))"
    byte = f"lambda c, b: list_reduce(list_prepend(xor(c, b), [CAST(0 AS BIGINT) FOR z IN range(8)]), {step})"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({digits}, ''), lambda x: CAST(ascii(x) AS BIGINT))), {byte}), 4294967295)"


#: Words six in a row that come again in the text at a distance of q, and stretches of such places: 12 words of a run, or two
#: periods, have six that do. Of equal stretches the least q counts.
OP11 = rf"""
WITH cut AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w0, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
placed AS (SELECT *, len(w0) AS n, h // 10 AS g, h % 10 = 0 AND len(w0) > 0 AS changes FROM cut),
periods AS (SELECT *, CASE WHEN changes THEN g % n END AS a FROM placed),
doc AS (SELECT doc_id, n, CASE WHEN changes THEN list_transform(range(0, n), lambda i: w0[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w0 END AS w FROM periods),
six AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 6], ' ') AS s FROM doc, unnest(range(0, n - 5)) AS r(i)),
again AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM six x JOIN six y ON x.doc_id = y.doc_id AND x.s = y.s AND x.i < y.i),
island AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM again),
stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + 5 + q AS length FROM island GROUP BY doc_id, q, k),
run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(12, 2 * q) GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (
  SELECT doc_id, string_agg(w[i + 1], ' ' ORDER BY i) AS t
  FROM (SELECT doc_id, w, unnest(range(0, n)) AS i FROM doc WHERE n > 0) d ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
best AS (
  SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(start, length, period), (-length, start, period)) AS top,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs
  FROM run GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.start AS start, top.length AS length, top.period AS period, 1000 * top.length // top.period AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM doc LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


OP12 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, least(len(q.e), len(c.e)) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


_FIELDS = "||".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)"))
_LEAF = f"sha256({_FIELDS} || coalesce(strlen({{0}}) || ':' || {{0}}, '-'))"

#: Sources' trees level by level, then the tree of their roots; a leaf's way up is the way of its place.
OP13 = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_LEAF.format("text")} AS leaf,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 2 = 0 THEN {_LEAF.format("replace(text, chr(10), '')")} ELSE {_LEAF.format("text")} END AS tampered FROM documents),
leaf AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM doc),
low AS (
  SELECT 0 AS level, tree, place, n, leaf AS node FROM leaf
  UNION ALL SELECT level + 1, tree, place // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM low WHERE n > 1 GROUP BY level, tree, place // 3, n),
subroot AS (SELECT tree, node, level AS height, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, place, n, node FROM subroot
  UNION ALL SELECT level + 1, place // 3, (n + 2) // 3, sha256(string_agg(node, '' ORDER BY place)) FROM high WHERE n > 1 GROUP BY level, place // 3, n),
beside AS (
  SELECT w.doc_id, w.leaf, w.level AS step, string_agg(x.node, '' ORDER BY x.place) FILTER (x.place < w.at) AS lft, string_agg(x.node, '' ORDER BY x.place) FILTER (x.place > w.at) AS rgt
  FROM (SELECT l.doc_id, l.leaf, l.tree, h.level, l.place // CAST(pow(3, h.level) AS BIGINT) AS at FROM leaf l JOIN subroot s USING (tree), unnest(range(0, s.height)) AS h(level)) w
  JOIN low x ON x.tree = w.tree AND x.level = w.level AND x.place // 3 = w.at // 3 GROUP BY w.doc_id, w.leaf, w.level
  UNION ALL
  SELECT w.doc_id, w.leaf, w.height + w.level, string_agg(x.node, '' ORDER BY x.place) FILTER (x.place < w.at), string_agg(x.node, '' ORDER BY x.place) FILTER (x.place > w.at)
  FROM (SELECT l.doc_id, l.leaf, s.height, h.level, s.place // CAST(pow(3, h.level) AS BIGINT) AS at FROM leaf l JOIN subroot s USING (tree), unnest(range(0, (SELECT max(level) FROM high))) AS h(level)) w
  JOIN high x ON x.level = w.level AND x.place // 3 = w.at // 3 GROUP BY w.doc_id, w.leaf, w.height, w.level),
proof AS (SELECT doc_id, leaf, list(coalesce(lft, '') ORDER BY step) AS ls, list(coalesce(rgt, '') ORDER BY step) AS rs FROM beside GROUP BY doc_id, leaf),
root AS (SELECT node AS root FROM high WHERE n = 1),
joined AS (
  SELECT l.doc_id, l.leaf, s.node AS subroot, root, coalesce(ls, []) AS ls, coalesce(rs, []) AS rs, l.tampered
  FROM leaf l JOIN subroot s USING (tree) CROSS JOIN root LEFT JOIN proof p ON p.doc_id = l.doc_id AND p.leaf = l.leaf),
folded AS (SELECT *, list_reduce(list_prepend(tampered, range(1, len(ls) + 1)::VARCHAR[]), lambda acc, i: sha256(ls[CAST(i AS BIGINT)] || acc || rs[CAST(i AS BIGINT)])) AS folded_root FROM joined)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(range(1, len(ls) + 1), lambda i: ls[i] || rs[i]), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded
"""


ORACLE = {"op13_merkle_manifest": OP13, "op12_exact_top_k": OP12, "op11_periodic_runs": OP11, "op3_chat_format": OP3, "op2_decontaminate": OP2, "op9_secret_scan": _op9()}
