"""The engine's inputs as views over the tables, in SQL that Spark and DuckDB both read.

Coordinates are 0-based and half-open; ``s`` and ``e`` are start and end."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents benchmark labels".split()

VIEWS = {
    "sequences": "SELECT doc_id AS nid, source AS pid, text AS sequence, n_chars AS length FROM documents",
    "lengths": "SELECT o_orderkey AS nid, CAST(400 AS BIGINT) AS length FROM orders",
    "links": """SELECT l_partkey AS query_nid, l_suppkey AS sbjct_nid, -100 * l_discount AS evalue,
        10 * l_linenumber AS qs, 10 * l_linenumber + CAST(l_quantity AS INT) AS qe,
        7 * l_linenumber AS ss, 7 * l_linenumber + CAST(l_quantity AS INT) AS se FROM lineitem""",
    "domains": """SELECT l_orderkey AS nid, 20 * l_linenumber AS s, 20 * l_linenumber + CAST(l_quantity AS INT) AS e,
        concat(l_returnflag, l_linestatus) AS family FROM lineitem""",
    "units": """SELECT l_partkey AS nid, 20 * l_linenumber AS s, 20 * l_linenumber + CAST(l_quantity AS INT) AS e,
        concat('F', CAST(l_suppkey AS VARCHAR(20))) AS family FROM lineitem""",
    "refs": """SELECT l_orderkey AS nid, 20 * l_linenumber + CAST(l_quantity AS INT) % 13 AS s,
        20 * l_linenumber + CAST(l_quantity AS INT) % 13 + p_size AS e, p_brand AS family
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "tested": """SELECT l_partkey AS q, l_suppkey AS t, l_extendedprice AS weight, CAST(l_quantity AS INT) AS naligned,
        CASE WHEN l_tax <= 0.04 THEN '+' ELSE '-' END AS passed FROM lineitem""",
    "edges": """SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b
        ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_discount >= 0.09""",
    "taxa": """SELECT n_nationkey AS tax_id, n_name AS name, 100 * n_regionkey + 1 + n_nationkey AS node_id FROM nation""",
    "kingdoms": "SELECT r_name AS kingdom, 100 * r_regionkey + 1 AS min_node_id, 100 * r_regionkey + 99 AS node_id FROM region",
    "assigned": "SELECT o_orderkey AS nid, c_nationkey AS tax_id FROM orders JOIN customer ON o_custkey = c_custkey",
    "masks": """SELECT l_orderkey AS nid, 15 * l_linenumber AS s, 15 * l_linenumber + 12 AS e, l_linenumber % 3 AS method FROM lineitem""",
    "mali": """SELECT l_orderkey AS ali, l_linenumber AS rid, 10 * l_linenumber AS s, 10 * l_linenumber + length(replace(aligned, '-', '')) AS e, aligned FROM (SELECT l_orderkey, l_linenumber,
        translate(substr(md5(concat(CAST(l_orderkey AS VARCHAR(20)), '.', CAST(l_linenumber AS VARCHAR(20)))), 1, 24), '0123456789abcdef', 'ACGT-ACGT-acgx-P') AS aligned FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) y) x""",
    "blocked": """SELECT q, t, a, g, b, q_from, s_from, concat(CAST(a AS VARCHAR(9)), ',', CAST(b AS VARCHAR(9)), ',') AS sizes, concat(CAST(q_from AS VARCHAR(9)), ',', CAST(q_from + a AS VARCHAR(9)), ',') AS q_starts,
        concat(CAST(s_from AS VARCHAR(9)), ',', CAST(s_from + a + g AS VARCHAR(9)), ',') AS s_starts, concat('+', CAST(a AS VARCHAR(9)), '-', CAST(g AS VARCHAR(9)), '+', CAST(b AS VARCHAR(9))) AS q_ali, concat('+', CAST(a + g + b AS VARCHAR(9))) AS s_ali
        FROM (SELECT DISTINCT l_orderkey AS q, l_linenumber AS t, 5 + l_linenumber AS a, CAST(1 + l_orderkey % 4 AS INT) AS g, CAST(4 + l_orderkey % 3 AS INT) AS b, 10 * l_linenumber AS q_from, 7 * l_linenumber AS s_from FROM lineitem) y""",
    "trees": """SELECT DISTINCT l_orderkey AS nid, l_linenumber - 1 AS node, CASE WHEN l_linenumber = 1 THEN -1 ELSE CAST(floor(l_linenumber / 2) AS INT) - 1 END AS parent,
        CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber < 4 THEN 1 ELSE 2 END AS level, CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber < 4 THEN 60 * (l_linenumber - 2) ELSE 30 * (l_linenumber - 4) END AS s,
        CASE WHEN l_linenumber = 1 THEN 120 WHEN l_linenumber < 4 THEN 60 * (l_linenumber - 1) ELSE 30 * (l_linenumber - 3) END AS e FROM lineitem""",
    "texts": """SELECT l_orderkey AS nid, CASE l_linenumber % 5 WHEN 0 THEN CAST(l_linenumber AS VARCHAR(9)) WHEN 1 THEN concat(CAST(l_linenumber AS VARCHAR(9)), '.5') WHEN 2 THEN 'True' WHEN 3 THEN 'x,y' ELSE '# note' END AS v FROM lineitem""",
    "parts": "SELECT l_partkey AS nid, 20 * l_linenumber AS s, 20 * l_linenumber + CAST(l_quantity AS INT) AS e, concat('F', CAST(l_suppkey AS VARCHAR(20)), '.', CAST(l_partkey % 40 AS VARCHAR(9))) AS family FROM lineitem",
    "known": "SELECT l_orderkey AS nid FROM lineitem WHERE l_quantity > 30",
    "pvalues": "SELECT l_orderkey * 10 + l_linenumber AS id, (l_orderkey * 7919 + l_linenumber * 104729) % 10000 / 1e4 AS p FROM lineitem",
    "scored": "SELECT l_orderkey * 10 + l_linenumber AS id, CAST(floor(l_extendedprice) AS BIGINT) AS value, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS hit FROM lineitem",
}


def _needed(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{v}\b", sql, re.I)]


def with_views(sql: str) -> str:
    """``sql`` with the views it reads in front, as common table expressions."""
    parts = [f"{v} AS ({VIEWS[v]})" for v in _needed(sql)]
    body = sql.strip()
    if not parts:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run shared SQL over the tables of ``sf_dir``."""
    full = with_views(sql)
    for t in TABLES:
        if re.search(rf"\b{t}\b", full):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(full)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return run_sql(spark, sf_dir, f"SELECT * FROM {name}")
