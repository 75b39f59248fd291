"""DuckDB SQL for the queries over the base tables: results straight from the tables, without any document."""

from __future__ import annotations

from . import dims
from .cases import values
from .queries import _AMOUNTS, CODES, _deck_oracle, _filing_oracle, _v

_TERMS = [*dims.BALANCE_TERMS, *dims.HELPER_TERMS]
_TERM_LIST = ", ".join(f"({i}, '{t}')" for i, t in enumerate(_TERMS))
_FORMULAS = ", ".join(f"('{b}', '{o}', '{i}', {c})" for b, o, i, c in dims.LOAN_FORMULAS)
_LOANS = f"""{_AMOUNTS.rstrip()}, l AS (
  SELECT folder, ['北富銀', '中信', '玉山', '國泰'][k % 4 + 1] AS bank, t.term, CASE WHEN (k + t.i) % 11 <> 0 THEN CAST(cnt * (t.i + 1) + k AS DOUBLE) END AS value
  FROM a CROSS JOIN (VALUES {_TERM_LIST}) t(i, term)
)"""
_MERGED = list(enumerate(dims.MERGED_ORDER))


def _merged_rows() -> list:
    rows = []
    for i, t in _MERGED:
        if i % 4:
            rows.append((i, t, float(i), 0))
        elif i % 3:
            rows.append((i, t, float(-i), 1))
    n = len(_MERGED)
    return [*rows, (n, "甲", 90.0, 0), (n + 1, "乙", 91.0, 1)]


# the lines of one document with all order lines: d.n is a line's place among them
_LONG = """WITH o AS (
  SELECT l_orderkey AS k, l_linenumber AS ln, trunc(l_quantity) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r,
    row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS n FROM lineitem
), d AS (
  SELECT *, r = 1 AND k % 1777 = 0 AS heads, r = 1 AND k % 997 = 0 AS starts FROM o
), s AS (
  SELECT *, coalesce(last_value(CASE WHEN starts THEN k % 2 END IGNORE NULLS) OVER (ORDER BY n), 0) = 0 AS percent, max(CASE WHEN starts THEN k END) OVER (ORDER BY n) AS t,
    max(CASE WHEN heads THEN k END) OVER (ORDER BY n) AS h, n + sum(heads::INT + 2 * starts::INT) OVER (ORDER BY n) AS place FROM d
)
"""

ORACLES = {
    "long_document_facts": _LONG + """, f AS (
  SELECT k, r, q AS v, 0 AS part FROM s UNION ALL SELECT k, r, ln, 1 FROM s WHERE (k // 997) % 2 = 0
), nums AS (
  SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY r, part) AS i FROM f
), e AS (SELECT k, percent FROM s WHERE r = 1)
SELECT printf('N%07d', e.k) AS code, 'item' AS label, CAST(nums.v AS DOUBLE) AS value FROM e LEFT JOIN nums ON nums.k = e.k AND nums.i = CASE WHEN percent THEN 3 ELSE 2 END""",
    "long_document_tables": _LONG + """, g AS (SELECT t, h, place, q, n, heads, starts, max(CASE WHEN heads AND NOT starts THEN n END) OVER (PARTITION BY t ORDER BY n) AS broken FROM s WHERE t IS NOT NULL)
SELECT CAST(min(CASE WHEN starts THEN place END) - 2 AS BIGINT) AS header_line, 'part－' || any_value(th) AS heading, count(*) FILTER (broken IS NULL) AS n_rows, count(*) FILTER (broken IS NULL) AS n, CAST(sum(q) FILTER (broken IS NULL) AS DOUBLE) AS amount
FROM (SELECT *, max(CASE WHEN starts THEN h END) OVER (PARTITION BY t) AS th FROM g) GROUP BY t""",
    "filing_summary": _filing_oracle(),
    "derived_total": _AMOUNTS + f"SELECT folder, CASE WHEN k % 3 <> 0 THEN {_v(60)} ELSE {_v(30)} + {_v(12)} + {_v(18)} END AS value, k % 3 = 0 AS derived FROM a",
    "coverage_warning": _AMOUNTS + "SELECT folder, CAST(k % 10 AS BIGINT) AS missing, CAST(10 AS BIGINT) AS n, array_to_string(['t' || i FOR i IN range(0, k % 10)], ', ') AS terms FROM a WHERE k % 10 > 5",
    "table_roundtrip": "SELECT r_name AS folder, 'key,name' AS header, n_nationkey AS key, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey",
    "adjacent_tables_split": "SELECT r_name AS folder, 'key,name' AS header, n_nationkey AS key, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'region,label', r_regionkey, r_name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)",
    "dual_column_unfold": """SELECT CAST(s_nationkey AS VARCHAR) AS folder, printf('S%05d', s_suppkey) AS code, CAST(s_nationkey AS DOUBLE) AS value, 3 AS width FROM supplier
UNION ALL SELECT CAST(s_nationkey AS VARCHAR), printf('P%05d', p_partkey), CAST(p_size AS DOUBLE), 2 FROM supplier JOIN part ON p_partkey = s_suppkey + 1 WHERE s_suppkey % 3 <> 0""",
    "code_extract_first_value": "SELECT printf('P%06d', p_partkey) AS code, p_name AS label, CAST(round(p_retailprice) AS DOUBLE) AS value FROM part",
    "stride_period2": "SELECT percent, printf('P%06d', p_partkey) AS code, CAST(-p_size AS DOUBLE) AS value FROM part CROSS JOIN (VALUES (true), (false)) t(percent)",
    "code_index_with_label_fallback": "SELECT printf('C%06d', c_custkey) AS code, c_name AS label, round(c_acctbal, 2) AS value FROM customer",
    "statement_rows": """SELECT CAST(l_orderkey // 100 AS VARCHAR) AS folder, printf('%06d', l_partkey) AS code, p_name AS name,
  arg_min(CASE WHEN l_linenumber % 5 <> 0 THEN trunc(l_quantity) ELSE -1 END, [l_orderkey, l_linenumber, l_quantity]) AS v, nullif(v, -1) AS value, CASE WHEN v = -1 THEN 'low' ELSE 'high' END AS confidence
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_partkey % 2 = 0 GROUP BY 1, 2, 3""",
    "annualize_orders": "SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) * 4 / quarter(o_orderdate) AS annualized FROM orders GROUP BY year(o_orderdate), quarter(o_orderdate)",
    "term_match_strength": """SELECT p_type, count(*) AS parts, 'brushed' AS term, CASE WHEN contains(p_type, 'TIN') THEN 0 WHEN p_type = 'BRUSHED' THEN 3 WHEN contains(p_type, 'BRUSHED') THEN 2 ELSE 0 END AS strength FROM part GROUP BY p_type
UNION ALL SELECT p_type, count(*), 'small copper', CASE WHEN p_type = 'SMALL PLATED COPPER' THEN 3 WHEN contains(p_type, 'SMALL PLATED COPPER') THEN 2
  WHEN (contains(p_type, 'SMALL') OR contains(p_type, 'MEDIUM')) AND contains(p_type, 'COPPER') THEN 1 ELSE 0 END FROM part GROUP BY p_type""",
    "deck_summary": _deck_oracle(),
    "orientation_detect": """SELECT o_orderpriority AS folder, CASE WHEN CAST(substr(o_orderpriority, 1, 1) AS INT) % 2 = 1 THEN 0 ELSE -1 END AS period_col, CAST(n AS DOUBLE) AS value, 'FY' || y AS period_label, 3 AS strength
FROM (SELECT o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2) QUALIFY y = max(y) OVER (PARTITION BY o_orderpriority)""",
    "heading_asof": """SELECT r_name AS folder, n.n_nationkey AS key, h.n_name || '－topic' AS heading, CASE WHEN h.n_name IS NOT NULL THEN 'topic' END AS topic
FROM nation n JOIN region ON n_regionkey = r_regionkey
ASOF LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) h ON n.n_regionkey = h.n_regionkey AND n.n_nationkey >= h.n_nationkey""",
    "row_sections_ffill": """SELECT printf('P%06d', p_partkey) AS part, last_value(CASE WHEN p_partkey % 5 = 0 THEN p_brand END IGNORE NULLS) OVER (PARTITION BY p_partkey // 200 ORDER BY p_partkey) AS section FROM part""",
    "section_restrict": """WITH s AS (SELECT c_nationkey, c_custkey, c_mktsegment, min(CASE WHEN c_mktsegment = 'BUILDING' THEN c_custkey END) OVER (PARTITION BY c_nationkey) AS s FROM customer),
e AS (SELECT *, min(CASE WHEN c_mktsegment = 'MACHINERY' AND c_custkey > s THEN c_custkey END) OVER (PARTITION BY c_nationkey) AS e FROM s)
SELECT CAST(c_nationkey AS VARCHAR) AS folder, c_custkey FROM e WHERE c_custkey >= s AND (e IS NULL OR c_custkey < e)""",
    "loan_recomposition": f"""{_LOANS} SELECT l.folder, l.bank, f.o AS term, CASE WHEN count(l.value) = count(*) THEN sum(f.c * l.value) END AS value
FROM l JOIN (VALUES {_FORMULAS}) f(b, o, i, c) ON f.b = l.bank AND f.i = l.term GROUP BY ALL""",
    "loan_reconciliation": f"""{_LOANS}, p AS (
  SELECT folder, sum(value) FILTER (term IN ('企業放款', '房貸', '個人放款', '信用卡循環')) AS parts, count(value) FILTER (term IN ('企業放款', '房貸', '個人放款', '信用卡循環')) AS n, max(value) FILTER (term = '法說會放款餘額合計') AS total
  FROM l GROUP BY folder)
SELECT folder, parts, total, parts - total AS gap FROM p WHERE n = 4 AND total IS NOT NULL AND abs(parts - total) > 2.5""",
    "resolve_period_asof": """WITH m AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m FROM orders),
asked AS (SELECT y * 100 + m AS id FROM m UNION ALL SELECT (min(y) - 1) * 100 + 1 FROM m UNION ALL SELECT (max(y) + 1) * 100 + 1 FROM m),
links AS (SELECT y * 100 + m AS k FROM m WHERE m % 2 = 0),
picked AS (SELECT id, coalesce((SELECT max(k) FROM links WHERE k <= id), (SELECT min(k) FROM links)) AS k FROM asked)
SELECT id, CAST(k // 100 AS INT) AS y, CAST(k % 100 AS INT) AS m, id = k AS exact FROM picked""",
    "export_scaling": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN floor(o_totalprice) ELSE floor(o_totalprice) / 1000 END AS value,
  CASE WHEN o_orderkey % 3 = 0 THEN '0.00%' WHEN o_orderkey % 2 = 0 THEN '#,##0.000' WHEN value = floor(value) THEN '#,##0' ELSE '#,##0.00' END AS number_format FROM orders""",
    "page_num": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN coalesce(nullif(regexp_extract(p_brand, '^(\\d+)', 1), ''), p_brand) ELSE substr(lpad(CAST(p_partkey AS VARCHAR), 3, '0'), 1, 3) END AS page FROM part",
    "classify_folders": _AMOUNTS + "SELECT folder, 'fin_report' AS kind, CAST(CASE WHEN k % 3 <> 0 THEN 20 ELSE 19 END AS BIGINT) AS code_hits, CAST(0 AS BIGINT) AS con_hits FROM a UNION ALL SELECT printf('deck%03d', k), 'con_call', 0, 1 FROM a",
    "bank_detection": _AMOUNTS + "SELECT folder, '金融業' AS industry, CASE WHEN bank = 0 THEN '玉山' ELSE '國泰' END AS bank FROM a",
    "merged_order": values(_merged_rows(), "place, term, value, side", ["INTEGER", "VARCHAR", "DOUBLE", "INTEGER"]),
    "profitability_layouts": _AMOUNTS + """SELECT folder, 1 AS layout, '合併' AS entity, '114年1月1日至9月30日' AS period_label, 3 AS quarter_num, CAST(k || '.2' AS DOUBLE) AS roa_posttax, CAST(k || '.4' AS DOUBLE) AS roe_posttax, 5.5::DOUBLE AS profit_margin FROM a
UNION ALL SELECT folder, 1, '本公司', '114年1月1日至9月30日', 3, 1.2, -(k + 1), 1.5 FROM a
UNION ALL SELECT folder, 2, '玉山商業銀行', '114年12月31日', 4, CAST(k || '.7' AS DOUBLE), NULL, 33.3 FROM a
UNION ALL SELECT folder, 2, '玉山商業銀行', '113年12月31日', 4, 0.5, NULL, CAST(k || '.9' AS DOUBLE) FROM a
UNION ALL SELECT folder, 3, NULL, '114年12月31日', 4, NULL, CAST(k || '.25' AS DOUBLE), NULL FROM a
UNION ALL SELECT folder, 3, NULL, '113年12月31日', 4, NULL, 7, NULL FROM a""",
    "coding_grid_blocks": values(CODES, "sheet, code, name", ["VARCHAR", "VARCHAR", "VARCHAR"]),
    "regulator_header_lookup": values([("甲銀行", "逾放比率", 0.15), ("甲銀行", "餘額", 1234.0), ("乙銀行", "逾放比率", None), ("乙銀行", "餘額", None), ("丙銀行", "逾放比率", None), ("丙銀行", "餘額", None)], "bank, header, value", ["VARCHAR", "VARCHAR", "DOUBLE"]),
}
ORACLES["statement_rows"] = f"SELECT folder, code, name, value, confidence FROM ({ORACLES['statement_rows']})"
ORACLES["combined_sections_union"] = f"""SELECT 'balance_sheet' AS section, folder, code, value, NULL::DOUBLE AS roa_posttax FROM ({ORACLES['statement_rows']})
UNION ALL SELECT 'ratios', folder, NULL, NULL, cnt / 4 FROM ({_AMOUNTS} SELECT folder, CAST(cnt AS DOUBLE) AS cnt FROM a)"""
