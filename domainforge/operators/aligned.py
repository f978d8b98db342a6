"""Queries over multiple alignments. Spark works on the rows' texts; DuckDB's counterparts work on single cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from domainforge.functions import alignments as al
from domainforge.operators.views import view, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_CELLS = "cells AS (SELECT ali, rid, s, e, w, pos, substr(aligned, pos + 1, 1) AS ch FROM (SELECT *, unnest(range(0, w)) AS pos FROM (SELECT *, length(aligned) AS w FROM mali) a) b)"
_BACK = "SELECT ali, rid, s, e, string_agg({0}, '' ORDER BY pos) AS aligned FROM {1} GROUP BY ali, rid, s, e"


def query(name: str, sql: str, cells: bool = False):
    def put(f):
        QUERIES[name] = lambda spark, d: f(view(spark, d, "mali"))
        # the view is read inside of the cells too
        ORACLES[name] = with_views(f"WITH {_CELLS}{', ' if sql.startswith('x AS') else ' '}{sql}" if cells else sql)
        return f

    return put


query("MAL-01", "SELECT ali, pos, string_agg(ch, '' ORDER BY rid) AS column FROM cells GROUP BY ali, pos", True)(al.columns)
query("MAL-02", """x AS (SELECT ali, pos, ch, count(*) AS n FROM cells GROUP BY ali, pos, ch),
    y AS (SELECT ali, pos, ch, row_number() OVER (PARTITION BY ali, pos ORDER BY ch = '-', n DESC, ch) AS k FROM x)
    SELECT ali, string_agg(ch, '' ORDER BY pos) AS consensus FROM y WHERE k = 1 GROUP BY ali""", True)(al.consensus)
query("MAL-03", "SELECT ali, rid, CAST(sum(CASE WHEN ch <> '-' THEN 1 ELSE 0 END) AS INT) AS residues FROM cells GROUP BY ali, rid", True)(lambda m: m.select("ali", "rid", al.residues("aligned").alias("residues")))
query("MAL-04", """WITH a AS (SELECT *, length(regexp_extract(aligned, '^[- .a-z]*')) AS f FROM mali),
    b AS (SELECT ali, rid, s + length(regexp_replace(left(aligned, f), '[^a-z]', '', 'g')) AS s, e, concat(repeat('-', f), substr(aligned, f + 1)) AS t FROM a),
    c AS (SELECT *, length(regexp_extract(t, '[- .a-z]*$')) AS l FROM b)
    SELECT ali, rid, s, e - length(regexp_replace(right(t, l), '[^a-z]', '', 'g')) AS e, CASE WHEN l = 0 THEN t ELSE concat(left(t, length(t) - l), repeat('-', length(t) - l)) END AS aligned FROM c""")(al.remove_unaligned_ends)
query("MAL-05", """x AS (SELECT ali, rid, w, coalesce(min(CASE WHEN ch NOT IN ('-', ' ') THEN pos END), w) AS first, coalesce(max(CASE WHEN ch NOT IN ('-', ' ') THEN pos END), -1) + 1 AS last FROM cells GROUP BY ali, rid, w),
    y AS (SELECT ali, coalesce(min(CASE WHEN first > 0 THEN first END), max(w)) AS a, coalesce(max(CASE WHEN last < w THEN last END), 0) AS b FROM x GROUP BY ali)
    SELECT m.ali, m.rid, m.s, m.e, CASE WHEN b > a THEN substr(aligned, a + 1, b - a) ELSE '' END AS aligned FROM mali m JOIN y ON y.ali = m.ali""", True)(al.remove_end_gaps)
query("MAL-06", "SELECT ali, rid, s, e, CASE WHEN rid = 2 THEN concat(aligned[1:9], '---', aligned[10:]) ELSE concat(aligned[1:6], '---', aligned[7:]) END AS aligned FROM mali")(lambda m: al.insert_columns(m, 6, 3, [2]))
query("MAL-07", "x AS (SELECT *, sum(CASE WHEN ch = '-' THEN 1 ELSE 0 END) OVER (PARTITION BY ali, pos) AS n FROM cells) SELECT ali, rid, s, e, coalesce(string_agg(CASE WHEN n < 2 THEN ch END, '' ORDER BY pos), '') AS aligned FROM x GROUP BY ali, rid, s, e", True)(lambda m: al.remove_gaps(m, 0, 2))
query("MAL-08", """x AS (SELECT ali, CAST(floor(pos / 3) AS INT) AS codon, max(CASE WHEN upper(substr(aligned, pos + 1, 3)) IN ('TAG', 'TAA', 'TGA', '---', 'ACG') THEN 1 ELSE 0 END) AS hit
    FROM (SELECT m.ali, m.rid, aligned, pos FROM mali m JOIN cells c ON c.ali = m.ali AND c.rid = m.rid WHERE pos % 3 = 0) q GROUP BY ali, CAST(floor(pos / 3) AS INT))
    SELECT c.ali, c.rid, s, e, coalesce(string_agg(CASE WHEN hit = 0 THEN ch END, '' ORDER BY pos), '') AS aligned FROM cells c JOIN x ON x.ali = c.ali AND x.codon = CAST(floor(pos / 3) AS INT) GROUP BY c.ali, c.rid, s, e""", True)(lambda m: al.remove_pattern(m, "(?i)TAG|TAA|TGA|---|ACG", 0, 1, 3, 3))
query("MAL-09", "SELECT ali, rid, s, e, aligned FROM (SELECT ali, rid, s, e, left(aligned, 2) AS aligned FROM mali) x WHERE aligned <> '--'")(lambda m: al.remove_empty(al.truncate(m, 0, 2)))
query("MAL-10", "SELECT ali, rid, CASE WHEN rid < 4 THEN s + 100 * rid ELSE s END AS s, CASE WHEN rid < 4 THEN e + 100 * rid ELSE e END AS e, aligned FROM mali")(lambda m: al.shift(m, m.where("rid < 4").select("rid", (100 * F.col("rid")).alias("o")).distinct()))
query("MAL-11", _BACK.format("CASE WHEN floor(pos / 3) % 2 = 0 THEN upper(ch) ELSE lower(ch) END", "cells"), True)(al.mark_codons)
query("MAL-12", """x AS (SELECT *, CASE WHEN regexp_matches(ch, '[a-z]') THEN 'x' ELSE ch END AS c, s + sum(CASE WHEN ch <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY ali, rid ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS r FROM cells)
    SELECT ali, rid, s, e, string_agg(CASE WHEN ch = '-' THEN ch WHEN (CASE WHEN r >= s + 3 THEN 1 ELSE 0 END + CASE WHEN r >= s + 9 THEN 1 ELSE 0 END) % 2 = 1 THEN lower(c) ELSE upper(c) END, '' ORDER BY pos) AS aligned FROM x GROUP BY ali, rid, s, e""", True)(
    lambda m: al.mark_transitions(m, F.array(F.col("s") + 3, F.col("s") + 9), by_residue=True)
)
_MAP = """n AS (SELECT *, sum(CASE WHEN ch <> '-' THEN 1 ELSE 0 END) OVER (PARTITION BY ali, rid ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM cells),
    bare AS (SELECT ali, rid, row_number() OVER (PARTITION BY ali, rid ORDER BY pos) AS k, row_number() OVER (PARTITION BY ali, rid ORDER BY pos) - 1 AS o FROM cells WHERE ch <> '-')"""
query("MAL-13", "x AS (SELECT 1), " + _MAP + " SELECT n.ali, n.rid, n.pos, CAST(o AS INT) AS other FROM n LEFT JOIN bare b ON n.ch <> '-' AND b.ali = n.ali AND b.rid = n.rid AND b.k = n.k", True)(
    lambda m: m.select("ali", "rid", F.posexplode(al.column_map(F.col("aligned"), F.translate("aligned", "-", ""))).alias("pos", "other"))
)
query("MAL-14", "x AS (SELECT *, sum(CASE WHEN lower(ch) = 'x' THEN 1 ELSE 0 END) OVER (PARTITION BY ali, pos) AS n FROM cells) " + _BACK.format("CASE WHEN n >= 2 AND ch <> '-' THEN 'x' ELSE ch END", "x"), True)(lambda m: al.propagate_masks(m, 2))
query("MAL-15", "x AS (SELECT *, max(CASE WHEN regexp_matches(ch, '[a-z]') THEN 1 ELSE 0 END) OVER (PARTITION BY ali, pos) AS n FROM cells) " + _BACK.format("CASE WHEN n = 1 THEN lower(ch) ELSE ch END", "x"), True)(al.propagate_transitions)
query("MAL-16", "SELECT ali, rid, s, e, concat(aligned[5:5], aligned[1:1], aligned[24:24], aligned[5:5]) AS aligned FROM mali")(lambda m: al.take_columns(m, [4, 0, 23, 4]))
query("MAL-17", _BACK.format("CASE WHEN pos IN (0, 7, 8) AND ch <> '-' THEN 'x' ELSE ch END", "cells"), True)(lambda m: al.mask_columns(m, [0, 7, 8]))
query("MAL-18", _BACK.format("CASE WHEN pos BETWEEN 3 AND 12 THEN upper(ch) ELSE ch END", "cells"), True)(lambda m: al.map_columns(m, list(range(3, 13)), F.upper))
query("MAL-19", "SELECT ali, rid, 0 AS s, CAST(sum(CASE WHEN ch <> '-' THEN 1 ELSE 0 END) AS INT) AS e FROM cells GROUP BY ali, rid", True)(lambda m: al.recount(m, True).select("ali", "rid", "s", "e"))
query("MAL-20", "x AS (SELECT 1), " + _MAP + " SELECT n.ali, n.rid, string_agg(CASE WHEN o IS NULL THEN '-' ELSE substr('HHHHEEEECCCCHHHHEEEECCCC', CAST(o AS INT) + 1, 1) END, '' ORDER BY n.pos) AS annotation FROM n LEFT JOIN bare b ON n.ch <> '-' AND b.ali = n.ali AND b.rid = n.rid AND b.k = n.k GROUP BY n.ali, n.rid", True)(
    lambda m: m.select("ali", "rid", al.copy_annotation(F.lit("HHHHEEEECCCC" * 2), al.column_map(F.col("aligned"), F.translate("aligned", "-", ""))).alias("annotation"))
)
query("MAL-21", "SELECT ali, rid, s, e, concat(aligned[5:8], aligned[17:20]) AS aligned FROM mali")(lambda m: al.clip_by_annotation(m, F.lit("HHHHEEEECCCCHHHHEEEECCCC"), "E"))
query("MAL-22", "SELECT ali, rid, s, e, aligned[4:15] AS aligned FROM mali")(lambda m: al.truncate(m, 3, 15))
query("MAL-23", "SELECT ali, rid, s, e, aligned, printf('ID%06d', count(*) OVER (PARTITION BY ali ORDER BY rid ROWS UNBOUNDED PRECEDING)) AS name FROM mali")(al.map_identifiers)
query("MAL-24", "SELECT ali, CASE WHEN sum(CASE WHEN lower(ch) NOT IN ('a', 'c', 'g', 't', 'x', 'n', '-') THEN 1 ELSE 0 END) < 0.1 * sum(CASE WHEN ch <> '-' THEN 1 ELSE 0 END) THEN 'na' ELSE 'aa' END AS alphabet FROM cells GROUP BY ali", True)(al.alphabet)
query("MAL-25", "SELECT ali, count(DISTINCT length(aligned)) = 1 AS consistent FROM (SELECT ali, CASE WHEN rid = 5 THEN left(aligned, 9) ELSE aligned END AS aligned FROM mali) x GROUP BY ali")(lambda m: al.same_length(m.withColumn("aligned", F.when(F.col("rid") == 5, F.substring("aligned", 1, 9)).otherwise(F.col("aligned")))))
query("MAL-26", _BACK.format("CASE ch WHEN '-' THEN '.' ELSE upper(ch) END", "cells"), True)(lambda m: al.apply(m, lambda x: F.translate(F.upper(x), "-", ".")))
query("MAL-27", "SELECT ali, rid, CASE WHEN k = 1 THEN name ELSE concat(name, '_', CAST(k - 1 AS VARCHAR)) END AS name FROM (SELECT ali, rid, concat('r', CAST(ali AS VARCHAR)) AS name, row_number() OVER (PARTITION BY ali ORDER BY rid) AS k FROM mali) x")(
    lambda m: al.unique_names(m.select("ali", "rid", F.concat(F.lit("r"), F.col("ali").cast("string")).alias("name")), "name", "rid")
)
query("MAL-29", """SELECT DISTINCT n, concat(CASE WHEN n > 50 THEN concat('>', repeat(' ', 49), list_aggregate(list_transform(range(50, n, 50), lambda i: rpad(CAST(i + 7 AS VARCHAR), 50, ' ')), 'string_agg', ''), chr(10)) ELSE '>' END,
    '>', left(repeat('----.----|', 40), n), chr(10)) AS ruler FROM (SELECT CAST(rid * 37 AS INT) AS n FROM mali) x""")(lambda m: m.select((F.col("rid") * 37).cast("int").alias("n")).distinct().select("n", al.ruler(F.col("n"), ">", 7).alias("ruler")))
query("SCL-26", _BACK.format("CASE WHEN pos IN (1, 2) AND ch <> '-' THEN 'N' ELSE ch END", "cells"), True)(lambda m: al.mask_columns(m, [1, 2], "N"))
query("SCL-27", "SELECT ali, rid, CAST(s + sum(CASE WHEN ch <> '-' AND pos < 11 THEN 1 ELSE 0 END) AS INT) AS residue FROM cells GROUP BY ali, rid, s", True)(lambda m: m.select("ali", "rid", al.residue_number(F.col("s"), F.col("aligned"), 11).cast("int").alias("residue")))
