"""The derived views as DuckDB SQL, and a few shared pieces of the reference queries."""

from __future__ import annotations


def long_date(column: str) -> str:
    return f"strftime({column}, '%-d %B %Y')"


NUMBERED_ORDERS = (
    "SELECT *, o_custkey AS matter_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq "
    "FROM orders"
)

VIEWS = {
    "v_statement": f"""
SELECT matter_id, seq, CAST(seq AS INT) AS number, CASE k
 WHEN 0 THEN concat('I refer to the invoice dated ', d, ' [AH', m, '/', a, '-', b, '].')
 WHEN 1 THEN concat('I refer to the email [AH-xx; AH-xx] and to the report dated ', d, '.')
 WHEN 2 THEN concat('I attach the contract. It was signed on ', d, '.')
 WHEN 3 THEN 'The meeting (March 3) was short. See (para 12).'
 WHEN 4 THEN concat('A copy of the letter dated ', d, ' is exhibited (BB-12).')
 WHEN 5 THEN 'I refer to the report of Dr. Smith [RC 1 / xx]; I also refer to the notice [RC1/3].'
 WHEN 6 THEN 'The invoice was attached to that email.'
 ELSE concat('I enclose the purchase orders dated ', d, ' (CC-xx, CCxx, CC-x).') END AS text
FROM (SELECT matter_id, seq, o_orderkey % 8 AS k, o_custkey % 3 + 1 AS m, o_orderkey % 90 + 1 AS a,
  o_orderkey % 90 + 3 AS b, {long_date('o_orderdate')} AS d FROM ({NUMBERED_ORDERS}) o) x""",
    "v_sources": f"""
SELECT *, concat('e', source_seq) AS source_id, sha256(text) AS sha256,
 CASE WHEN source_seq % 7 = 3 THEN concat('AH', source_seq) WHEN source_seq % 11 = 5 THEN 'N/A' END AS marker
FROM (SELECT o.o_custkey AS matter_id,
 row_number() OVER (PARTITION BY o.o_custkey ORDER BY l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_extendedprice) AS source_seq,
 concat(replace(p.p_name, ' ', '_'), '_', p.p_type, '.', CASE l.l_linenumber % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'eml' WHEN 3 THEN 'xlsx' ELSE 'txt' END) AS name,
 CASE l.l_linenumber % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'eml' WHEN 3 THEN 'xlsx' ELSE 'txt' END AS extension,
 concat('invoice report for ', p.p_name, ' ', lower(p.p_type), ' dated ', {long_date('o.o_orderdate')}) AS text,
 CAST(l.l_quantity AS INT) AS pages
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey) y""",
    "v_candidates": f"""
SELECT matter_id, concat('c', o_orderkey) AS candidate_id, seq, CAST(seq AS INT) AS paragraph,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat('e', o_orderkey % 9) END AS evidence_id,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE concat('h', o_orderkey % 7) END AS source_sha256,
 o_orderkey % 11 <> 0 AS included, o_orderkey % 5 <> 0 AS confirmed, o_orderkey % 17 = 0 AS manual_addition,
 CASE o_orderkey % 4 WHEN 0 THEN 'same' WHEN 1 THEN 'separate' WHEN 2 THEN 'pending' ELSE NULL END AS repeat_decision,
 'AH1' AS bundle_mark, concat(o_orderpriority, ' document') AS description, {long_date('o_orderdate')} AS date_text,
 CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS page_start, CAST(o_orderkey % 20 + 1 AS INT) AS content_pages,
 CAST(o_orderkey % 2 AS INT) AS optional_pages,
 CASE o_orderkey % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' ELSE 'eml' END AS extension,
 CASE WHEN o_orderkey % 23 = 0 AND o_orderkey % 13 <> 0 THEN concat('h', o_orderkey % 5) END AS parent_sha256
FROM ({NUMBERED_ORDERS}) x""",
    "v_arrangement": f"""
SELECT matter_id, CAST(floor((seq - 1) / 3) AS INT) AS block, CAST(seq AS INT) AS seq,
 CASE WHEN CAST(floor((seq - 1) / 3) AS INT) % 2 = 1 THEN concat('s', CAST(floor((seq - 1) / 3) AS INT)) END AS section_id,
 CASE WHEN CAST(floor((seq - 1) / 3) AS INT) % 2 = 1 THEN concat('Heading ', CAST(floor((seq - 1) / 3) AS INT)) END AS heading,
 concat('c', o_orderkey) AS exhibit_id
FROM ({NUMBERED_ORDERS}) x""",
    "v_nodes": """
SELECT matter_id, CAST(dense_rank() OVER (PARTITION BY matter_id ORDER BY lead_seq) AS BIGINT) AS pos, section_id, heading,
 CASE WHEN section_id IS NOT NULL THEN CAST(seq - block * 3 AS BIGINT) END AS inner_pos, exhibit_id
FROM (SELECT *, CASE WHEN section_id IS NULL THEN seq ELSE block * 3 + 1 END AS lead_seq FROM v_arrangement) x""",
    "v_snapshot_prev": f"""
SELECT o_custkey AS matter_id, concat('c', o_orderkey) AS exhibit_id, concat('h', o_orderkey % 7) AS source_sha256,
 o_orderpriority AS description, {long_date('o_orderdate')} AS date_text, o_orderstatus = 'F' AS confirmed,
 CAST(o_orderkey % 4 AS INT) AS page_start FROM orders WHERE o_orderkey % 19 <> 0""",
    "v_snapshot_cur": f"""
SELECT o_custkey AS matter_id, concat('c', o_orderkey) AS exhibit_id,
 concat('h', CASE WHEN o_orderkey % 29 = 0 THEN o_orderkey % 5 ELSE o_orderkey % 7 END) AS source_sha256,
 CASE WHEN o_orderkey % 23 = 0 THEN concat('Amended ', o_orderpriority) ELSE o_orderpriority END AS description,
 {long_date('o_orderdate')} AS date_text, CASE WHEN o_orderkey % 31 = 0 THEN true ELSE o_orderstatus = 'F' END AS confirmed,
 CAST(o_orderkey % 4 AS INT) AS page_start FROM orders WHERE o_orderkey % 37 <> 0""",
    "v_journal": """
SELECT user_id AS journal_id, event_id AS arrival, CAST(floor(value * 10) AS BIGINT) AS revision, event_type AS action FROM events""",
    "v_attachments": """
SELECT conv_id AS parent_id, CAST(turn AS INT) AS turn,
 CASE WHEN turn % 2 = 0 THEN concat('', CAST(floor(turn / 2) AS INT) + 1) ELSE concat('', CAST(floor(turn / 2) AS INT) + 1, '.1') END AS ordinal,
 concat(role, '/', turn, CASE (conv_id + turn) % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.eml' WHEN 3 THEN '.xlsx' WHEN 4 THEN '.txt' ELSE '.png' END) AS raw_name,
 CAST(length(text) AS BIGINT) * 20000 AS bytes, sha256(text) AS child_sha256
FROM conversations""",
    "v_pages": """
SELECT l_orderkey AS source_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS INT) AS page,
 CASE CAST(l_quantity AS INT) % 4 WHEN 0 THEN CAST(595.28 AS DOUBLE) WHEN 1 THEN CAST(841.89 AS DOUBLE) WHEN 2 THEN CAST(612.0 AS DOUBLE) ELSE CAST(595.0 AS DOUBLE) END AS width,
 CASE CAST(l_quantity AS INT) % 4 WHEN 0 THEN CAST(841.89 AS DOUBLE) WHEN 1 THEN CAST(595.28 AS DOUBLE) WHEN 2 THEN CAST(792.0 AS DOUBLE) ELSE CAST(842.0 AS DOUBLE) END AS height,
 CASE WHEN l_returnflag = 'R' THEN 90 ELSE 0 END AS rotation, l_linestatus = 'F' AS has_annotations
FROM lineitem""",
    "v_matter_lines": """
SELECT matter_id, role, line_no, text FROM (
 SELECT c_custkey AS matter_id, 'cover' AS role, 1 AS line_no, 'IN THE HIGH COURT OF JUSTICE' AS text FROM customer
 UNION ALL SELECT c_custkey, 'cover', 2, concat('Claim No. C-', c_custkey) FROM customer
 UNION ALL SELECT c_custkey, 'cover', 3, 'BETWEEN:' FROM customer
 UNION ALL SELECT c_custkey, 'cover', 4, concat(c_name, ' (Claimant)') FROM customer
 UNION ALL SELECT c_custkey, 'cover', 5, 'AND' FROM customer
 UNION ALL SELECT c_custkey, 'cover', 6, concat(n_name, ' Limited') FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT c_custkey, 'cover', 7, 'Hearing: [HEARING DATE]' FROM customer
 UNION ALL SELECT c_custkey, 'index', 1, concat('Case number: C-', CASE WHEN c_custkey % 7 = 0 THEN c_custkey + 1 ELSE c_custkey END) FROM customer
 UNION ALL SELECT c_custkey, 'index', 2, concat(c_name, ' v ', n_name, ' Limited') FROM customer JOIN nation ON c_nationkey = n_nationkey) x""",
    "v_cells": """
SELECT l_suppkey AS sheet_id, CAST(l_linenumber + (l_orderkey % 40) AS INT) AS row_no, CAST(l_partkey % 12 + 1 AS INT) AS col_no,
 max(l_returnflag) AS value FROM lineitem GROUP BY 1, 2, 3""",
    "v_ranges": """
SELECT s_suppkey AS sheet_id, 'print' AS kind, 1 AS left_col, 1 AS top_row, CAST(5 + s_suppkey % 6 AS INT) AS right_col, 20 AS bottom_row FROM supplier
UNION ALL SELECT s_suppkey, 'merge', CAST(3 + s_suppkey % 4 AS INT), CAST(18 + s_suppkey % 5 AS INT), CAST(6 + s_suppkey % 4 AS INT), CAST(22 + s_suppkey % 5 AS INT) FROM supplier""",
    "v_actions": """
SELECT l_orderkey AS source_id, CAST(l_linenumber AS INT) AS page, CASE WHEN l_partkey % 2 = 0 THEN 'page' ELSE 'annotation' END AS location,
 CASE l_partkey % 4 WHEN 0 THEN 'JavaScript' WHEN 1 THEN 'URI' WHEN 2 THEN 'Launch' ELSE 'GoTo' END AS action FROM lineitem WHERE l_returnflag = 'R'""",
}


def with_views(views: list[str], *steps: tuple[str, str], select: str, recursive: bool = False) -> str:
    """``WITH`` the named derived views and the given (name, query) steps, then ``select``."""
    parts = [f"{name} AS ({VIEWS[name]})" for name in views]
    parts += [f"{name} AS ({query})" for name, query in steps]
    if not parts:
        return select
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + "\n" + select
