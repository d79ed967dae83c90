"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from sparloom.jobs.queries import CAPACITY, CUT_HACK, PARTS
from sparloom.sources.generate import BY_COLUMN, BY_ROW, BY_SEED, PRIME, STIR

_LINE = 'SELECT CAST({row} AS BIGINT) AS "row", CAST({col} AS BIGINT) AS col, CAST({val} AS BIGINT) AS val FROM {table}'
A = {
    "a1": _LINE.format(row="l_orderkey", col="l_partkey", val="l_quantity", table="lineitem"),
    "a2": _LINE.format(row="l_orderkey", col="l_partkey", val="round(l_tax * 100)", table="lineitem"),
    "a7": _LINE.format(row="l_orderkey", col="l_partkey", val="round(l_discount * 100)", table="lineitem"),
    "a3": _LINE.format(row="l_suppkey", col="l_partkey", val="l_quantity", table="lineitem"),
    "a4": _LINE.format(row="greatest(l_suppkey, l_partkey % 100)", col="least(l_suppkey, l_partkey % 100)", val="l_quantity", table="lineitem"),
    "a5": _LINE.format(row="user_id", col="event_id % 500", val="1", table="events"),
    "a8": _LINE.format(row="l_orderkey", col="CASE WHEN l_linenumber <= 2 THEN 0 ELSE l_partkey END", val="l_quantity", table="lineitem"),
    "a6": _LINE.format(row="l_partkey", col="l_suppkey", val="l_quantity", table="lineitem"),
}
M = "(SELECT count(*) FROM orders)"
N = "(SELECT count(*) FROM part)"
X = "SELECT CAST(p_partkey AS BIGINT) AS col, z, CAST(p_size + z * (p_partkey % 7) AS BIGINT) AS x FROM part, range({k}) AS r(z)"
E = "SELECT CAST(vec_id AS BIGINT) AS col, CAST(z AS BIGINT) AS z, CAST(floor(CAST(embedding[z + 1] AS DOUBLE) * 1048576) AS BIGINT) AS x FROM embeddings, range(64) AS r(z)"


def _with(**views: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{k} AS ({v})" for k, v in views.items()) + " "


def _product(a: str, x: str, m: str, k: int) -> str:
    return f"""SELECT i AS "row", z, CAST(coalesce(y, 0) AS BIGINT) AS val FROM (SELECT i, z FROM range({m}) AS r(i), range({k}) AS q(z))
LEFT JOIN (SELECT a."row" AS i, x.z, sum(a.val * x.x) AS y FROM ({a}) a JOIN ({x}) x USING (col) GROUP BY 1, 2) USING (i, z)"""


SPMM = _product(A["a1"], X.format(k=4), M, 4)
_EXACT = f"""WITH p AS (SELECT l_orderkey AS i, z, (l_extendedprice * (1.0::DOUBLE - l_discount)) * (p_retailprice / (z + 3)) AS p FROM lineitem JOIN part ON l_partkey = p_partkey, range(4) AS r(z)),
top AS (SELECT (SELECT max(abs(l_extendedprice * (1.0::DOUBLE - l_discount))) FROM lineitem) * (SELECT max(abs(p_retailprice / 3)) FROM part) AS t),
unit AS (SELECT pow(2, floor(log2(t)) - 29) AS a, pow(2, floor(log2(t)) - 59) AS b, pow(2, floor(log2(t)) - 89) AS c FROM top),
one AS (SELECT i, z, floor(p / a) AS k1, p - floor(p / a) * a AS r1, a, b, c FROM p, unit),
two AS (SELECT i, z, k1, floor(r1 / b) AS k2, r1 - floor(r1 / b) * b AS r2, a, b, c FROM one),
sums AS (SELECT i, z, CAST(sum(CAST(k1 AS BIGINT)) AS DOUBLE) * any_value(a) AS high, CAST(sum(CAST(k2 AS BIGINT)) AS DOUBLE) * any_value(b) AS middle, CAST(sum(CAST(floor(r2 / c) AS BIGINT)) AS DOUBLE) * any_value(c) AS low FROM two GROUP BY i, z)
SELECT g.i AS "row", g.z, coalesce((low + middle) + high, 0) AS val FROM (SELECT i, z FROM range({M}) AS r(i), range(4) AS q(z)) g LEFT JOIN sums USING (i, z)"""
_SLOTTED = 'SELECT "row", row_number() OVER (PARTITION BY "row" ORDER BY col, val) - 1 AS slot, col, val FROM a1'
_CNT = 'SELECT i AS "row", count(a."row") AS nnz FROM range({m}) AS r(i) LEFT JOIN ({a}) a ON a."row" = i GROUP BY i'
_MAX = 'SELECT coalesce(max(n), 0) AS maxnz FROM (SELECT count(*) AS n FROM a1 GROUP BY "row")'
_LANES = "SELECT maxnz, CAST(CASE WHEN maxnz <= 1 THEN 1 ELSE pow(2, ceil(log2(least(maxnz, 32)))) END AS BIGINT) AS lanes FROM mx"
_HACK = f"SELECT least((({M} + 32 // lanes - 1) // (32 // lanes)) * (32 // lanes), 1024 // lanes) AS rows_per FROM ln"
_DIR = f"""SELECT hack, hack * rows_per AS first_row, least({M} - hack * rows_per, rows_per) AS n_rows, maxnz,
  CAST(coalesce(sum(least({M} - hack * rows_per, rows_per) * maxnz) OVER (ORDER BY hack ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS hack_offset
FROM (SELECT "row" // rows_per AS hack, any_value(rows_per) AS rows_per, max(nnz) AS maxnz FROM cnt, hk GROUP BY 1)"""
_LAYOUT = {"a1": A["a1"], "slotted": _SLOTTED, "cnt": _CNT.format(m=M, a="SELECT * FROM a1"), "mx": _MAX, "ln": _LANES, "hk": _HACK, "dir": _DIR}
_CUM = 'SELECT "row", nnz, CAST(coalesce(sum(nnz) OVER (ORDER BY "row" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cum FROM cnt'
_PADDED = 'SELECT c."row", s AS slot, coalesce(t.col, 0) AS col, coalesce(t.val, 0) AS val FROM {rows} c, {width} LEFT JOIN slotted t ON t."row" = c."row" AND t.slot = s'
ELL = _with(**_LAYOUT) + _PADDED.format(rows="cnt", width="(SELECT unnest(range(maxnz)) AS s FROM mx)")

_RANGES = f"""SELECT 0 AS i, CAST(0 AS BIGINT) AS s
UNION ALL SELECT i + 1, coalesce((
  SELECT arg_min(CASE WHEN c.cum + c.nnz - o.cum - q < q - (c.cum - o.cum) THEN c."row" + 1 ELSE c."row" END, c."row")
  FROM cum c, (SELECT cum FROM cum WHERE "row" = s) o, (SELECT ((i + 2) * nz) // {PARTS} - ((i + 1) * nz) // {PARTS} AS q FROM tot)
  WHERE c."row" >= s AND c.cum + c.nnz - o.cum >= q), m)
FROM bounds, tot WHERE i + 1 < {PARTS}"""
_PART = {"cnt": _CNT.format(m=N, a=A["a6"]), "cum": _CUM, "tot": f"SELECT CAST(sum(nnz) AS BIGINT) AS nz, {N} AS m FROM cnt", "bounds": _RANGES}
_PART["found"] = 'SELECT CAST(i AS BIGINT) AS part, s AS start_row, coalesce(lead(s) OVER (ORDER BY i), (SELECT m FROM tot)) AS end_row FROM bounds'
_PART["loaded"] = 'SELECT part, start_row, end_row, CAST(coalesce((SELECT sum(nnz) FROM cnt WHERE "row" >= start_row AND "row" < end_row), 0) AS BIGINT) AS nnz FROM found'


def _blocks(counts: str, m: str, capacity: str) -> str:
    step = """SELECT CAST(0 AS BIGINT) AS s UNION ALL SELECT coalesce((
  SELECT CASE WHEN arg_min(c.cum, c."row") - min(o.cum) > cap AND min(c."row") - s > 1 THEN min(c."row") - 1 ELSE min(c."row") END
  FROM cum c, (SELECT cum FROM cum WHERE "row" = s) o WHERE c."row" > s AND c.cum - o.cum >= cap HAVING count(*) > 0), m)
FROM starts, lim WHERE s < m"""
    views = {"cnt": counts, "cum": _CUM, "lim": f"SELECT {capacity} AS cap, {m} AS m", "starts": step}
    return _with(**views) + "SELECT row_number() OVER (ORDER BY s) - 1 AS block, s AS start_row, lead(s) OVER (ORDER BY s) AS end_row FROM starts QUALIFY lead(s) OVER (ORDER BY s) IS NOT NULL"


_S = "(SELECT count(*) FROM supplier)"
_LONG = {"a3": A["a3"], "slotted": 'SELECT "row", row_number() OVER (PARTITION BY "row" ORDER BY col, val) - 1 AS slot, col, val FROM a3', "cnt": _CNT.format(m=_S, a="SELECT * FROM a3"), "cum": _CUM}
_WIDE = f'SELECT "row", unnest(range((SELECT max(nnz) FROM cnt d WHERE d."row" // {CUT_HACK} = c."row" // {CUT_HACK}))) AS s FROM cnt c'
_MIRROR = 'SELECT "row", col, val FROM a4 UNION ALL SELECT col, "row", val FROM a4 WHERE "row" <> col'
_ENTRY = _with(a1=A["a1"]) + 'SELECT "row", col, val FROM a1'
_DROPPED = _with(a2=A["a2"]) + 'SELECT "row", col, val FROM a2 WHERE val <> 0'
_CSR = _with(**_LAYOUT) + 'SELECT "row", slot, col, val FROM slotted'
_Y = f"({SPMM})"
_MIX = lambda x: f"(({x}) * {STIR} + ({x}) // 65536 + 1) % {PRIME}"

ORACLE = {
    "spmv_order_part": _product(A["a1"], "SELECT CAST(p_partkey AS BIGINT) AS col, 0 AS z, CAST(p_size AS BIGINT) AS x FROM part", M, 1).replace('i AS "row", z, ', 'i AS "row", ', 1),
    **dict.fromkeys(("spmm_columns_k4", "spmm_shuffled_k4", "spmm_broadcast_k4", "spmm_csr_k4", "spmm_ell_k4", "spmm_hll_k4", "dense_roundtrip"), SPMM),
    "spmm_exact_k4": _EXACT,
    "spmm_split_k4": _product(A["a8"], X.format(k=4), M, 4),
    "heavy_columns": f"SELECT col, count(*) AS entries FROM ({A['a8']}) GROUP BY col HAVING count(*) * {PARTS} > (SELECT count(*) FROM lineitem)",
    "spmm_blocks_k64": _product(A["a5"], E, "(SELECT max(user_id) + 1 FROM events)", 64),
    "drop_zeros": _DROPPED,
    "mm_roundtrip": _DROPPED,
    "row_major_order": _with(a1=A["a1"]) + 'SELECT row_number() OVER (ORDER BY "row", col, val) - 1 AS ordinal, "row", col, val FROM a1',
    "csr_dump_lines": _with(a1=A["a1"]) + 'SELECT row_number() OVER (ORDER BY "row", col, val) AS ordinal, "row", col, val FROM a1',
    "saved_lines": f"""SELECT "row" AS ordinal, string_agg(val || ' ', '' ORDER BY z) AS line FROM ({SPMM}) GROUP BY 1""",
    "rebase": _ENTRY,
    "row_major": _ENTRY,
    "strip_padding": _ENTRY,
    **dict.fromkeys(("layout_roundtrip", "layout_roundtrip_csr", "layout_roundtrip_ell"), _ENTRY),
    "spmm_float_k4": f'SELECT "row", z, CAST(CAST(val / 4.0 AS FLOAT) AS DOUBLE) AS val FROM ({SPMM})',
    "pattern_values": _with(a1=A["a1"]) + 'SELECT "row", col, CAST(1 AS BIGINT) AS val FROM a1',
    **dict.fromkeys(("mirror_symmetric", "mirror_union", "mm_symmetric_read"), _with(a4=A["a4"]) + _MIRROR),
    "adjusted_nz": _with(a4=A["a4"]) + 'SELECT CAST(sum(CASE WHEN val % 5 = 0 THEN 0 WHEN "row" = col THEN 1 ELSE 2 END) AS BIGINT) AS nz FROM a4',
    "row_nnz": _with(a1=A["a1"]) + 'SELECT "row", count(*) AS nnz FROM a1 GROUP BY 1',
    "complete_rows": _with(**_LAYOUT) + 'SELECT "row", nnz FROM cnt',
    "empty_rows": _with(**_LAYOUT) + 'SELECT "row" FROM cnt WHERE nnz = 0',
    "max_nnz": _with(**_LAYOUT) + "SELECT maxnz FROM mx",
    "matrix_profile": _with(**_LAYOUT) + f"SELECT {M} AS m, {N} AS n, CAST(sum(nnz) AS BIGINT) AS nz, max(nnz) AS maxnz, CAST((sum(nnz) + {M} - 1) // {M} AS BIGINT) AS avg_nnz, count(*) FILTER (nnz = 0) AS empty_rows FROM cnt",
    "row_pointers": _with(**_LAYOUT, cum=_CUM) + f'SELECT "row", cum AS irp FROM cum UNION ALL SELECT {M}, (SELECT count(*) FROM a1)',
    "entry_slots": _CSR,
    "csr_dump_roundtrip": _CSR,
    "csr_slots": _with(**_LAYOUT, cum=_CUM) + 'SELECT "row", cum AS irp, slot, col, val FROM slotted JOIN cum USING ("row")',
    "ell_slots": ELL,
    "ell_array_slots": ELL,
    "ell_dump_roundtrip": ELL,
    "hll_slots": _with(**_LAYOUT) + _PADDED.format(rows="(SELECT cnt.*, unnest(range(dir.maxnz)) AS s FROM cnt, hk, dir WHERE dir.hack = cnt.\"row\" // rows_per)", width="(SELECT 1) one"),
    "csr_segments": _with(**_LONG) + 'SELECT "row", cum AS irp, nnz, slot, col, val FROM cum LEFT JOIN slotted USING ("row")',
    "hll_segments": _with(**_LONG) + _PADDED.format(rows=f"({_WIDE})", width="(SELECT 1) one"),
    "spmm_segments_k4": _product(A["a3"], X.format(k=4), _S, 4),
    "hack_offsets": _with(**_LAYOUT) + "SELECT hack, hack_offset FROM dir UNION ALL SELECT count(*), CAST(sum(n_rows * maxnz) AS BIGINT) FROM dir",
    "hack_directory": _with(**_LAYOUT) + "SELECT * FROM dir",
    "balanced_ranges": _with(**_PART) + "SELECT * FROM loaded",
    "part_loads": _with(**_PART) + "SELECT part, nnz AS load FROM loaded",
    "part_imbalance": _with(**_PART) + "SELECT part, max(nnz) OVER () / (sum(nnz) OVER () / CAST(count(*) OVER () AS DOUBLE)) AS imbalance FROM loaded",
    "assign_parts": _with(**_PART) + 'SELECT "row", nnz, part FROM cnt JOIN found ON "row" >= start_row AND "row" < end_row',
    "capacity_blocks": _blocks(_CNT.format(m=N, a=A["a6"]), N, str(CAPACITY)),
    "capacity_blocks_long_rows": _blocks(_CNT.format(m=_S, a=A["a3"]), _S, f"(SELECT CAST(least(ceil(ceil(count(*) / {_S}) / 32) * 32, 1024) AS BIGINT) FROM lineitem)"),
    "error_norms": f"""SELECT CAST(max(gap) AS DOUBLE) AS abs_error, max(gap / CASE WHEN val = 0 THEN 1 ELSE val + gap END) AS rel_error
FROM (SELECT val, CASE WHEN "row" % 10 = 3 AND val > 0 THEN CAST("row" % 4 AS DOUBLE) ELSE 0 END AS gap FROM {_Y})""",
    "align_results": f"""SELECT coalesce(p."row", q."row") AS "row", coalesce(p.z, q.z) AS z, CAST(coalesce(p.y, 0) AS BIGINT) AS a, CAST(coalesce(q.y, 0) AS BIGINT) AS b
FROM (SELECT a."row", x.z, sum(a.val * x.x) AS y FROM ({A["a2"]}) a JOIN ({X.format(k=4)}) x USING (col) WHERE a.val <> 0 GROUP BY 1, 2) p
FULL JOIN (SELECT a."row", x.z, sum(a.val * x.x) AS y FROM ({A["a7"]}) a JOIN ({X.format(k=4)}) x USING (col) WHERE a.val <> 0 GROUP BY 1, 2) q ON p."row" = q."row" AND p.z = q.z""",
    "footprint": _with(**_LAYOUT) + f"""SELECT CAST(4 * ({M} + 1) + 12 * (SELECT count(*) FROM a1) AS BIGINT) AS csr_bytes, CAST(12 * {M} * (SELECT maxnz FROM mx) AS BIGINT) AS ell_bytes,
  CAST(8 * count(*) + 12 * sum(n_rows * maxnz) AS BIGINT) AS hll_bytes, CAST(8 * 4 * ({M} + {N}) AS BIGINT) AS xy_bytes FROM dir""",
    "padding_ratio": _with(**_LAYOUT) + f"""SELECT CAST({M} * (SELECT maxnz FROM mx) AS BIGINT) AS ell_slots, CAST(sum(n_rows * maxnz) AS BIGINT) AS hll_slots,
  {M} * (SELECT maxnz FROM mx) / CAST((SELECT count(*) FROM a1) AS DOUBLE) AS ell_ratio, sum(n_rows * maxnz) / CAST((SELECT count(*) FROM a1) AS DOUBLE) AS hll_ratio FROM dir""",
    "flops": _with(a2=A["a2"]) + "SELECT CAST(2 * 4 * count(*) AS BIGINT) AS flops FROM a2 WHERE val <> 0",
    "preview_dense": f'SELECT * FROM ({SPMM}) ORDER BY "row", z LIMIT 10',
    "preview_top10": _CSR + ' ORDER BY "row", slot LIMIT 10',
    "reshape_long": f'SELECT col AS "row", z, x AS val FROM ({E})',
    "reshape_wide": f'SELECT col AS "row", z, CASE WHEN x > 0 THEN x ELSE 0 END AS val FROM ({E})',
    "random_multivector": f"""SELECT i AS "row", z, {_MIX("v")} / CAST({PRIME - 1} AS DOUBLE) AS val
FROM (SELECT i, z, {_MIX("u")} AS v FROM (SELECT i, z, (i % {PRIME} * {BY_ROW} + z * {BY_COLUMN} + 11 * {BY_SEED} + 1) % {PRIME} AS u FROM range({N}) AS r(i), range(4) AS q(z)))""",
    "mm_header": f"SELECT 'matrix' AS object, 'coordinate' AS format, 'real' AS field, 'general' AS symmetry, {M} AS m, {N} AS n, (SELECT count(*) FROM lineitem) AS nz",
    "mm_array_header": f"SELECT 'matrix' AS object, 'array' AS format, 'real' AS field, 'general' AS symmetry, (SELECT CAST(max(l_orderkey) + 1 AS BIGINT) FROM lineitem) AS m, CAST(4 AS BIGINT) AS n",
    "mm_pattern_read": A["a5"],
    "mm_complex_raw": "SELECT CAST(l_orderkey + 1 AS BIGINT) AS \"row\", CAST(l_partkey + 1 AS BIGINT) AS col, CAST(l_quantity AS BIGINT) AS re, CAST(round(l_tax * 100) AS BIGINT) AS im FROM lineitem",
    "mm_raw": f'SELECT "row" + 1 AS "row", col + 1 AS col, val FROM ({A["a2"]})',
    "mm_unsymmetric": A["a4"],
    "typecode_rules": """SELECT object, format, field, symmetry, count(*) AS orders,
  NOT (format = 'array' AND field = 'pattern') AND NOT (field = 'real' AND symmetry = 'hermitian') AND NOT (field = 'pattern' AND symmetry IN ('hermitian', 'skew-symmetric')) AS valid,
  format = 'coordinate' AND field <> 'complex' AS supported
FROM (SELECT 'matrix' AS object, ['coordinate', 'array'][o_orderkey % 2 + 1] AS format, ['real', 'complex', 'pattern', 'integer'][o_orderkey // 2 % 4 + 1] AS field,
  ['general', 'symmetric', 'skew-symmetric', 'hermitian'][o_orderkey // 8 % 4 + 1] AS symmetry FROM orders) GROUP BY ALL""",
}
