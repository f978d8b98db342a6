"""Checks, selections and formats by their exact rules; on inputs that each of them lets through in part."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from domainforge.operators.views import view, with_views
from domainforge.plans.ranges import with_previous

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, source: str, sql: str):
    def put(f):
        QUERIES[name] = lambda spark, d: f(*(view(spark, d, v) for v in source.split()))
        ORACLES[name] = with_views(sql)
        return f

    return put


@query("SRC-24", "trees", "SELECT pos, nid, previous FROM (SELECT pos, nid, lag(nid) OVER (ORDER BY pos) AS previous FROM (SELECT nid * 10 + node AS pos, nid * 7919 % 10007 AS nid FROM trees) a) b WHERE previous > nid")
def descending(trees):
    """Places of a stored graph where a nid is smaller than the one before it."""
    stored = trees.select((F.col("nid") * 10 + F.col("node")).alias("pos"), (F.col("nid") * 7919 % 10007).alias("nid"))
    return with_previous(stored, "pos", "nid", "previous").where("previous > nid").select("pos", "nid", "previous")


def neighbour_cap(links, most: int, evalue: float):
    """Of each query's first ``most`` links in stored order those to others that are good enough."""
    first = F.row_number().over(W.partitionBy("query_nid").orderBy("ord"))
    return links.withColumn("k", first).where((F.col("k") <= most) & (F.col("query_nid") != F.col("sbjct_nid")) & (F.col("evalue") <= evalue)).drop("k")


query("SRT-02", "blocked", "SELECT q AS query_nid, t AS sbjct_nid, t AS ord, -1.5e0 * g AS evalue FROM blocked b WHERE (SELECT count(*) FROM blocked c WHERE c.q = b.q AND c.t <= b.t) <= 3 AND q <> t AND g >= 2")(
    lambda b: neighbour_cap(b.select(F.col("q").alias("query_nid"), F.col("t").alias("sbjct_nid"), F.col("t").alias("ord"), (-1.5 * F.col("g")).alias("evalue")), 3, -3.0)
)


def validate(parts, known, keys: list[str]):
    """(nid, problem): nids that are repeated, unknown or missing."""
    repeated = parts.groupBy(*keys).count().where("count > 1").select("nid", F.lit("repeated").alias("problem"))
    found, all_ = parts.select("nid").distinct(), known.select("nid").distinct()
    return repeated.unionByName(found.join(all_, "nid", "left_anti").withColumn("problem", F.lit("unknown"))).unionByName(all_.join(found, "nid", "left_anti").withColumn("problem", F.lit("missing")))


query("SET-08", "trees lengths", """SELECT nid, 'repeated' AS problem FROM (SELECT nid, CAST(floor(node / 2) AS INT) AS node FROM trees) x GROUP BY nid, node HAVING count(*) > 1
    UNION ALL (SELECT nid + 7, 'unknown' FROM trees EXCEPT SELECT nid, 'unknown' FROM lengths) UNION ALL (SELECT nid, 'missing' FROM lengths EXCEPT SELECT nid + 7, 'missing' FROM trees)""")(
    lambda t, n: validate(t.select(F.col("nid"), F.floor(F.col("node") / 2).alias("node")), t.select("nid"), ["nid", "node"]).where("problem = 'repeated'").unionByName(validate(t.select((F.col("nid") + 7).alias("nid"), "node"), n, ["nid", "node"]).where("problem <> 'repeated'"))
)
query("PRJ-15", "taxa kingdoms", "SELECT t.name, CASE k.kingdom WHEN 'ASIA' THEN 'red' WHEN 'EUROPE' THEN 'green' WHEN 'AFRICA' THEN 'blue' ELSE 'grey' END AS colour FROM taxa t LEFT JOIN kingdoms k ON t.node_id BETWEEN k.min_node_id AND k.node_id")(
    lambda t, k: t.withColumn("slot", F.floor(F.col("node_id") / 100)).join(k.withColumn("slot", F.floor(F.col("min_node_id") / 100)), "slot", "left").select("name", F.coalesce(F.create_map(*(F.lit(x) for x in ("ASIA", "red", "EUROPE", "green", "AFRICA", "blue")))[F.col("kingdom")], F.lit("grey")).alias("colour"))
)
_PAIRS = "(SELECT nid, CASE WHEN v = 'True' THEN 'na' WHEN v = 'x,y' THEN '' WHEN nid % 9 = 0 THEN NULL ELSE v END AS x, CASE WHEN nid % 4 = 0 THEN 'Nan' ELSE CAST(nid AS VARCHAR) END AS y FROM texts)"
query("PRJ-21", "texts", f"SELECT nid, x, y FROM {_PAIRS} p WHERE x IS NOT NULL AND x <> 'na' AND x <> 'Nan' AND x <> '' AND y <> 'na' AND y <> 'Nan' AND y <> ''")(
    lambda t: t.select("nid", F.when(F.col("v") == "True", "na").when(F.col("v") == "x,y", "").when(F.col("nid") % 9 == 0, None).otherwise(F.col("v")).alias("x"), F.when(F.col("nid") % 4 == 0, "Nan").otherwise(F.col("nid").cast("string")).alias("y")).dropna(subset=["x", "y"]).where(~F.col("x").isin("na", "Nan", "") & ~F.col("y").isin("na", "Nan", ""))
)
query("SCL-10", "tested", "SELECT q, t, naligned, CASE WHEN naligned % 5 = 0 THEN 'na' ELSE printf('%5.2f', 100e0 * q / (naligned % 5)) END AS shown FROM tested")(
    lambda x: x.select("q", "t", "naligned", F.when(F.try_divide(100.0 * F.col("q"), F.col("naligned") % 5).isNull(), "na").otherwise(F.format_string("%5.2f", F.try_divide(100.0 * F.col("q"), F.col("naligned") % 5))).alias("shown"))
)
query("JOI-20", "parts", "SELECT nid, s, e, family FROM parts p WHERE EXISTS (SELECT 1 FROM parts f WHERE f.family = p.family AND f.s = 40)")(lambda p: p.join(p.where("s = 40").select("family").distinct(), "family", "left_semi").select("nid", "s", "e", "family"))
query("MKF-16", "parts", "SELECT p.family FROM (SELECT concat(family, '.', s) AS family FROM parts) p GROUP BY p.family HAVING count(*) = 1")(lambda p: p.groupBy(F.concat("family", F.lit("."), F.col("s").cast("string")).alias("family")).count().where("count = 1").select("family"))
query("WIN-05", "domains", "SELECT nid, s AS nearest FROM (SELECT nid, s, row_number() OVER (PARTITION BY nid ORDER BY abs(s - 77), s) AS k FROM domains) x WHERE k = 1")(lambda d: d.groupBy("nid").agg(F.min_by("s", F.struct(F.abs(F.col("s") - 77), "s")).alias("nearest")))
_HIST = "(SELECT e - s AS bin, count(*) AS n FROM domains GROUP BY e - s)"
_hist = lambda d: d.groupBy(F.expr("e - s").alias("bin")).agg(F.count("*").alias("n"))
query("SRT-09", "domains", f"SELECT bin FROM {_HIST} h ORDER BY n DESC, bin LIMIT 1")(lambda d: _hist(d).agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin")))
query("SRT-10", "domains", f"SELECT bin FROM {_HIST} h ORDER BY n, bin LIMIT 1")(lambda d: _hist(d).agg(F.min_by("bin", F.struct("n", "bin")).alias("bin")))
_SIZES = "(SELECT family, count(*) AS u, count(DISTINCT nid) AS q FROM parts GROUP BY family)"
_sizes = lambda p: p.groupBy("family").agg(F.count("*").alias("u"), F.countDistinct("nid").alias("q"))
query("TBL-41", "parts", f"SELECT family FROM {_SIZES} x WHERE u BETWEEN 12 AND 16 AND q >= 5")(lambda p: _sizes(p).where("u BETWEEN 12 AND 16 AND q >= 5").select("family"))
query("TBL-51", "parts", f"SELECT p.nid, p.s, p.e, p.family FROM parts p JOIN {_SIZES} x ON x.family = p.family WHERE u >= 3 * q")(lambda p: p.join(_sizes(p).where("u < 3 * q"), "family", "left_anti").select("nid", "s", "e", "family"))
query("TBL-52", "parts", f"SELECT p.nid, p.s, p.e, p.family FROM (SELECT nid, s, e, concat(family, '.', s) AS family FROM parts) p WHERE (SELECT count(*) FROM parts x WHERE concat(x.family, '.', x.s) = p.family) > (SELECT count(DISTINCT nid) FROM parts x WHERE concat(x.family, '.', x.s) = p.family)")(
    lambda p: (r := p.withColumn("family", F.concat("family", F.lit("."), F.col("s").cast("string")))).join(_sizes(r).where("u <= q"), "family", "left_anti").select("nid", "s", "e", "family")
)
query("TBL-53", "parts", "SELECT family, count(*) AS n FROM (SELECT concat(family, '.', s) AS family FROM parts) x GROUP BY family HAVING count(*) > 1")(lambda p: p.groupBy(F.concat("family", F.lit("."), F.col("s").cast("string")).alias("family")).agg(F.count("*").alias("n")).where("n > 1"))
query("TBL-55", "parts", "SELECT family FROM (SELECT concat(family, '.', s) AS family, nid FROM parts) x GROUP BY family HAVING count(*) = count(DISTINCT nid)")(lambda p: _sizes(p.withColumn("family", F.concat("family", F.lit("."), F.col("s").cast("string")))).where("u = q").select("family"))
query("AGG-28", "parts", "SELECT family FROM (SELECT concat(family, '.', s) AS family, nid FROM parts) x GROUP BY family HAVING count(*) > count(DISTINCT nid)")(lambda p: p.withColumn("family", F.concat("family", F.lit("."), F.col("s").cast("string"))).groupBy("family", "nid").count().where("count > 1").select("family").distinct())
