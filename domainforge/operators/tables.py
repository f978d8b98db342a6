"""Queries that change tables of a store, and selections from domain and family tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from domainforge.operators import intervals as iv
from domainforge.operators.views import view, with_views
from domainforge.plans.scratch import scratch_dir
from domainforge.sources.store import Store, next_names

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
_DOMAIN = "nid long, s int, e int, family string"


def query(name: str, source: str, sql: str):
    """Register ``f(store, *views)`` on a new store."""

    def put(f):
        QUERIES[name] = lambda spark, d: f(Store(spark, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}"), *(view(spark, d, v) for v in source.split()))
        ORACLES[name] = with_views(sql)
        return f

    return put


def _put(store, d, name="domains"):
    return store.put(name, d.select("nid", "s", "e", "family"))


_ALL = "SELECT nid, s, e, family FROM domains"
query("TBL-01", "domains", _ALL)(lambda st, d: (st.create("domains", _DOMAIN), st.insert("domains", d))[1])
query("TBL-02", "domains", "SELECT family, count(*) AS n FROM domains GROUP BY family")(lambda st, d: d.groupBy("family").agg(F.count("*").alias("n")).cache())
query("TBL-03", "domains", "SELECT true AS before, false AS other")(lambda st, d: (_put(st, d), st.spark.range(1).select(F.lit(st.exists("domains")).alias("before"), F.lit(st.exists("nothing")).alias("other")))[1])
query("TBL-04", "domains", "SELECT false AS there")(lambda st, d: (_put(st, d), st.drop("domains"), st.drop("domains"), st.spark.range(1).select(F.lit(st.exists("domains")).alias("there")))[-1])
query("TBL-05", "domains", _ALL + " UNION ALL SELECT -1, 0, 9, 'new'")(lambda st, d: (_put(st, d), st.insert("domains", st.spark.createDataFrame([(-1, 0, 9, "new")], _DOMAIN)))[1])
query("TBL-06", "domains", "SELECT nid, s, CASE WHEN family = 'AF' THEN e + 5 ELSE e END AS e, CASE WHEN family = 'AF' THEN 'AX' ELSE family END AS family FROM domains")(lambda st, d: (_put(st, d), st.update("domains", {"e": F.col("e") + 5, "family": F.lit("AX")}, F.col("family") == "AF"))[1])
query("TBL-07", "domains", "SELECT count(*) AS wrong FROM domains WHERE e <= s OR nid IS NULL OR e - s > 45")(lambda st, d: (_put(st, d), st.execute("SELECT count(*) AS wrong FROM domains WHERE e <= s OR nid IS NULL OR e - s > 45"))[1])
query("TBL-08", "domains", _ALL)(lambda st, d: (_put(st, d), st.backup("domains"), st.clear("domains"), st.read("domains_backup"))[-1])
query("TBL-09", "domains", _ALL)(lambda st, d: (_put(st, d), st.backup("domains"), st.delete("domains", F.col("family") == "NO"), st.restore("domains"))[-1])
query("TBL-10", "domains units", _ALL + " UNION ALL SELECT nid, s, e, family FROM units")(lambda st, d, u: (_put(st, d), _put(st, u, "units"), st.insert("domains", st.read("units")))[-1])
query("TBL-11", "domains", _ALL)(lambda st, d: (_put(st, d), st.clone("domains", "other"))[-1])
query("TBL-12", "domains", "SELECT 'nid long,s integer,e integer,family string' AS columns, 0 AS n")(lambda st, d: (_put(st, d), (c := st.clone("domains", "other", False)), st.spark.range(1).select(F.lit(",".join(f"{f.name} {f.dataType.typeName()}" for f in c.schema)).alias("columns"), F.lit(c.count()).alias("n")))[-1])
query("TBL-13", "domains", "SELECT 0 AS n, 1 AS tables")(lambda st, d: (_put(st, d), st.spark.range(1).select(F.lit(st.clear("domains").count()).alias("n"), F.lit(len(st.tables())).alias("tables")))[-1])
query("TBL-14", "domains", "SELECT 0 AS n")(lambda st, d: (_put(st, d), st.spark.range(1).select(F.lit(st.delete("domains", F.lit(True)).count()).alias("n")))[-1])
_FIRST = "SELECT nid, family, min(e) AS e FROM domains WHERE nid % 2 = 0 GROUP BY nid, family"
query("TBL-15", "domains", f"""SELECT coalesce(n.nid, o.nid) AS nid, coalesce(n.family, o.family) AS family, coalesce(n.e, o.e) AS e FROM (SELECT nid, family, min(s) AS e FROM domains WHERE nid % 3 = 0 GROUP BY nid, family) n FULL JOIN ({_FIRST}) o ON o.nid = n.nid AND o.family = n.family""")(
    lambda st, d: (st.put("firsts", d.where("nid % 2 = 0").groupBy("nid", "family").agg(F.min("e").alias("e"))), st.load("firsts", d.where("nid % 3 = 0").select("nid", "family", F.col("s").alias("e")), ["nid", "family"], "replace"))[-1]
)
query("TBL-16", "domains", "SELECT count(*) AS n, sum(s) AS s FROM domains")(lambda st, d: (_put(st, d), st.dump("domains", st.folder + "-dump"), st.spark.read.option("sep", "\t").option("header", True).csv(st.folder + "-dump").agg(F.count("*").alias("n"), F.sum(F.col("s").cast("long")).alias("s")))[-1])
query("TBL-17", "domains", _ALL)(lambda st, d: (_put(st, d), st.dump("domains", st.folder + "-dump"), st.load_dump("again", st.folder + "-dump", _DOMAIN))[-1])
query("TBL-21", "domains", _ALL)(lambda st, d: (_put(st, d), st.optimize("domains", 3, ["nid"]))[-1])
query("TBL-22", "domains units", "SELECT d.family, count(*) AS n FROM domains d JOIN units u ON u.nid = d.nid GROUP BY d.family")(lambda st, d, u: (_put(st, d), _put(st, u, "units"), st.execute("SELECT d.family, count(*) AS n FROM domains d JOIN units u ON u.nid = d.nid GROUP BY d.family"))[-1])
query("TBL-23", "domains units", "SELECT * FROM (VALUES ('domains'), ('units')) x(name)")(lambda st, d, u: (_put(st, d), _put(st, u, "units"), st.spark.createDataFrame([(t,) for t in st.tables()], "name string"))[-1])


def select(name: str, source: str, sql: str):
    """Register ``f(*views)`` without a store."""
    return lambda f: query(name, source, sql)(lambda st, *views: f(*views))


select("TBL-25", "domains", "SELECT nid, s, e, row_number() OVER (ORDER BY s, nid, e) AS k FROM domains WHERE nid = (SELECT min(nid) FROM domains)")(lambda d: d.join(d.agg(F.min("nid").alias("nid")), "nid").select("nid", "s", "e", F.row_number().over(W.partitionBy("nid").orderBy("s", "nid", "e")).alias("k")))
select("TBL-28", "domains", "SELECT nid, s, e, family FROM domains ORDER BY nid, s")(lambda d: d.select("nid", "s", "e", "family").orderBy("nid", "s"))
select("TBL-33", "units", "SELECT min(nid) AS nid FROM units WHERE family LIKE 'F1%'")(lambda u: u.where(F.col("family").startswith("F1")).agg(F.min("nid").alias("nid")))
query("TBL-36", "domains units", _ALL + " UNION ALL SELECT nid, s, e, 'NEW' FROM units WHERE family = 'F1'")(lambda st, d, u: (_put(st, d), st.insert("domains", u.where("family = 'F1'").withColumn("family", F.lit("NEW"))))[-1])
select("TBL-38", "domains", "SELECT DISTINCT family FROM domains WHERE family <> 'NO'")(lambda d: d.where("family <> 'NO'").select("family").distinct())
select("TBL-39", "domains", "SELECT bool_or(family = 'AF') AS there, bool_or(family = 'ZZ') AS other FROM domains")(lambda d: d.agg(F.bool_or(F.col("family") == "AF").alias("there"), F.bool_or(F.col("family") == "ZZ").alias("other")))
select("TBL-40", "units domains", "SELECT family AS id, printf('%06d', (SELECT max(CAST(substr(family, 2) AS INT)) FROM units) + row_number() OVER (ORDER BY family)) AS name FROM (SELECT DISTINCT family FROM domains) x")(lambda u, d: next_names(u.select(F.col("family").alias("name")), d.select(F.col("family").alias("id")).distinct()))
query("TBL-42", "domains", "SELECT DISTINCT family FROM domains UNION ALL SELECT 'NEW'")(lambda st, d: (st.put("families", d.select("family").distinct()), st.insert("families", st.spark.createDataFrame([("NEW",)], "family string")))[-1])
_SIZES = "SELECT family, count(*) AS nunits, count(DISTINCT nid) AS nsequences FROM domains GROUP BY family"
_sizes = lambda d: d.groupBy("family").agg(F.count("*").alias("nunits"), F.countDistinct("nid").alias("nsequences"))
query("TBL-43", "domains", f"{_SIZES} UNION ALL SELECT 'COPY', nunits, nsequences FROM ({_SIZES}) x WHERE family = 'AF'")(lambda st, d: (st.put("families", _sizes(d)), st.insert("families", st.read("families").where("family = 'AF'").withColumn("family", F.lit("COPY"))))[-1])
query("TBL-44", "domains units", "SELECT nid, s, e, family FROM domains UNION ALL SELECT nid, s, e, CAST(CAST(substr(family, 2) AS INT) + 1000 AS VARCHAR) FROM units WHERE nid % 3 = 0")(lambda st, d, u: (_put(st, d), st.insert("domains", u.where("nid % 3 = 0").withColumn("family", (F.substring("family", 2, 9).cast("int") + 1000).cast("string"))))[-1])
select("TBL-48", "units", "SELECT DISTINCT nid FROM units WHERE family = 'F2' ORDER BY nid")(lambda u: u.where("family = 'F2'").select("nid").distinct().orderBy("nid"))
query("TBL-49", "tested", "SELECT q, t, naligned FROM tested WHERE naligned >= 20")(lambda st, x: (st.put("links", x.select("q", "t", "naligned")), st.delete("links", F.col("naligned") < 20))[-1])
query("TBL-50", "links", "SELECT query_nid, sbjct_nid, qs, qe, ss, se FROM links WHERE qe - qs >= 10 AND se - ss - 5 >= 10")(lambda st, x: (st.put("links", x.select("query_nid", "sbjct_nid", "qs", "qe", "ss", "se")), st.delete("links", F.expr("qe - qs < 10 OR se - ss - 5 < 10")))[-1])
select("TBL-54", "units", "SELECT family FROM units GROUP BY family HAVING count(*) = (SELECT min(n) FROM (SELECT count(*) AS n FROM units GROUP BY family) x)")(lambda u: (g := u.groupBy("family").agg(F.count("*").alias("n"))).join(g.agg(F.min("n").alias("n")), "n").select("family"))
select("TBL-56", "domains", "SELECT family, count(DISTINCT nid) AS nsequences, count(*) AS nunits, arg_max(e - s, {'w': e - s, 'n': -nid}) AS length FROM domains GROUP BY family")(lambda d: d.groupBy("family").agg(F.countDistinct("nid").alias("nsequences"), F.count("*").alias("nunits"), F.max_by(F.expr("e - s"), F.struct(F.expr("e - s"), -F.col("nid"))).alias("length")))
query("TBL-57", "domains refs", _ALL + " UNION ALL SELECT nid, s, e, 'RESULT' FROM refs WHERE e - s > 40")(lambda st, d, r: (_put(st, d), st.insert("domains", r.where("e - s > 40").withColumn("family", F.lit("RESULT"))))[-1])
query("TBL-61", "scored", "SELECT id, value, CASE WHEN hit <> 0 THEN 100 ELSE hit END AS hit FROM scored")(lambda st, x: (st.put("nrdb", x.select("id", "value", "hit")), st.update("nrdb", {"hit": F.lit(100)}, F.col("hit") != 0))[-1])
select("TBL-63", "sequences", "SELECT nid FROM sequences WHERE sequence LIKE '%tion%'")(lambda s: s.where(F.col("sequence").contains("tion")).select("nid"))
select("TBL-64", "sequences", "SELECT nid FROM sequences WHERE lower(pid) LIKE '%rc1%'")(lambda s: s.where(F.lower("pid").contains("rc1")).select("nid"))
select("TBL-66", "domains", "SELECT DISTINCT nid FROM domains WHERE family <> 'AF' AND nid NOT IN (SELECT nid FROM domains WHERE family = 'RF')")(lambda d: d.where("family <> 'AF'").select("nid").distinct().join(d.where("family = 'RF'").select("nid"), "nid", "left_anti"))
query("TBL-67", "domains", "SELECT family, count(*) AS n FROM domains WHERE nid % 2 = 0 GROUP BY family")(
    lambda st, d: (_put(st, d.join(d.where("nid % 2 = 0").select("nid").distinct(), "nid")), st.put("families", st.read("domains").groupBy("family").agg(F.count("*").alias("n"))))[-1]
)
query("TBL-68", "domains", """SELECT family, count(*) AS nunits, sum(e - s) AS nresidues FROM (SELECT nid, family, min(s) AS s, max(e) AS e FROM (SELECT *, sum(f) OVER (PARTITION BY nid, family ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k
    FROM (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY nid, family ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM domains) a) b GROUP BY nid, family, k) c GROUP BY family""")(
    lambda st, d: (st.put("domains_nr", iv.islands(d, ["nid", "family"], alone=True).select("nid", "family", "s", "e")), st.put("families_nr", st.read("domains_nr").groupBy("family").agg(F.count("*").alias("nunits"), F.sum(F.expr("e - s")).alias("nresidues"))))[-1]
)
query("TBL-70", "domains masks", """WITH p AS (SELECT nid, s, e, unnest(range(CAST(s AS BIGINT), CAST(e AS BIGINT))) AS x FROM (SELECT DISTINCT nid, s, e FROM domains) a), f AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM masks m WHERE m.nid = p.nid AND p.x >= m.s AND p.x < m.e)),
    g AS (SELECT *, x - row_number() OVER (PARTITION BY nid, s, e ORDER BY x) AS k FROM f) SELECT nid, CAST(min(x) AS INT) AS s, CAST(max(x) + 1 AS INT) AS e FROM g GROUP BY nid, s, e, k HAVING count(*) >= 10""")(lambda st, d, m: iv.subtract(d, m).where("e - s >= 10").select("nid", F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e")))
query("TBL-71", "domains masks", _ALL + " UNION ALL SELECT nid, s, e, concat('R', 100 + method) FROM masks")(lambda st, d, m: (_put(st, d), st.insert("domains", m.withColumn("family", F.concat(F.lit("R"), (100 + F.col("method")).cast("string")))))[-1])
query("TBL-74", "domains", "SELECT d.nid, d.s, d.e, d.family, x.descr FROM domains d LEFT JOIN (VALUES ('AF', 'first'), ('RF', 'second')) x(family, descr) ON x.family = d.family")(lambda st, d: (_put(st, d).join(F.broadcast(st.spark.createDataFrame([("AF", "first"), ("RF", "second")], "family string, descr string")), "family", "left").select("nid", "s", "e", "family", "descr")))

# ---- summaries, windows, projections ----

for _key, _view, _columns in (("AGG-07", "sequences", {"n": "count(*)"}), ("AGG-08", "units", {"n": "count(*)", "families": "count(DISTINCT family)", "nids": "count(DISTINCT nid)"}), ("AGG-09", "domains", {"n": "count(*)", "nids": "count(DISTINCT nid)"}), ("AGG-11", "links", {"n": "count(*)", "queries": "count(DISTINCT query_nid)", "sbjcts": "count(DISTINCT sbjct_nid)"}), ("AGG-12", "tested", {"n": "count(*)", "queries": "count(DISTINCT q)", "sbjcts": "count(DISTINCT t)"}), ("AGG-27", "refs", {"n": "count(*)"}), ("AGG-42", "masks", {"n": "count(*)"})):
    select(_key, _view, f"SELECT {', '.join(f'{v} AS {k}' for k, v in _columns.items())} FROM {_view}")(lambda x, c=_columns: x.agg(*(F.expr(v).alias(k) for k, v in c.items())))
select("AGG-21", "domains", "SELECT family, count(DISTINCT nid) AS nids, count(*) AS n FROM domains GROUP BY family ORDER BY 3 DESC")(lambda d: d.groupBy("family").agg(F.countDistinct("nid").alias("nids"), F.count("*").alias("n")).orderBy(F.desc("n")))
select("AGG-30", "units", "SELECT count(DISTINCT nid) AS nsequences, count(*) AS nunits FROM units WHERE family = 'F3'")(lambda u: u.where("family = 'F3'").agg(F.countDistinct("nid").alias("nsequences"), F.count("*").alias("nunits")))
_UPDATED = "SELECT family, count(*) AS nunits, count(DISTINCT nid) AS nsequences, sum(e - s) AS nresidues, round(avg(e - s), 6) AS length FROM domains GROUP BY family"


def _refreshed(st, d):
    """A stale table of families, brought up to date from the domains; families without any get zeros."""
    st.put("families", d.select("family").distinct().unionByName(st.spark.createDataFrame([("GONE",)], "family string")).select("family", F.lit(-1).cast("long").alias("nunits")))
    new = d.groupBy("family").agg(F.count("*").alias("nunits"), F.countDistinct("nid").alias("nsequences"), F.sum(F.expr("e - s")).alias("nresidues"), F.round(F.avg(F.expr("e - s")), 6).alias("length"))
    return st.put("families", st.read("families").drop("nunits").join(new, "family", "left").fillna(0))


query("AGG-35", "domains", _UPDATED + " UNION ALL SELECT 'GONE', 0, 0, 0, 0")(_refreshed)
query("AGG-36", "domains known", """SELECT family, count(*) AS nunits, count(DISTINCT d.nid) AS nsequences, count(DISTINCT k.nid) AS curated FROM domains d LEFT JOIN (SELECT DISTINCT nid FROM known) k ON k.nid = d.nid GROUP BY family""")(lambda st, d, k: d.join(k.distinct().withColumn("c", F.col("nid")), "nid", "left").groupBy("family").agg(F.count("*").alias("nunits"), F.countDistinct("nid").alias("nsequences"), F.countDistinct("c").alias("curated")))
select("AGG-40", "scored", "SELECT count(*) AS n FROM scored WHERE hit <> 0")(lambda x: x.where("hit <> 0").agg(F.count("*").alias("n")))
select("AGG-44", "tested", "SELECT q, coalesce(CAST(min(CASE WHEN passed = '+' THEN naligned END) AS VARCHAR), 'na') AS least FROM tested GROUP BY q")(lambda x: x.groupBy("q").agg(F.coalesce(F.min(F.when(F.col("passed") == "+", F.col("naligned"))).cast("string"), F.lit("na")).alias("least")))
select("AGG-47", "links", "SELECT query_nid, sbjct_nid, share, round(avg(share) OVER (), 6) AS mean FROM (SELECT query_nid, sbjct_nid, round(least(1e0, sum(qe - qs) / (40e0 * count(*))), 6) AS share FROM links GROUP BY 1, 2) x")(
    lambda x: (r := x.groupBy("query_nid", "sbjct_nid").agg(F.round(F.least(F.lit(1.0), F.sum(F.expr("qe - qs")) / (40.0 * F.count("*"))), 6).alias("share"))).crossJoin(F.broadcast(r.agg(F.round(F.avg("share"), 6).alias("mean"))))
)
select("WIN-04", "domains", "SELECT nid, family, s, e, row_number() OVER (PARTITION BY nid, family ORDER BY s, e) AS k FROM domains")(lambda d: d.select("nid", "family", "s", "e", F.row_number().over(W.partitionBy("nid", "family").orderBy("s", "e")).alias("k")))
_BY_FAMILY = "SELECT family, s, CASE WHEN count(*) > 30 THEN count(*) ELSE 0 END AS v FROM domains GROUP BY family, s"
_by_family = lambda d: d.groupBy("family", "s").agg(F.count("*").alias("c")).select("family", "s", F.when(F.col("c") > 30, F.col("c")).otherwise(0).alias("v"))
select("WIN-11", "domains", f"SELECT family, s, coalesce((SELECT b.v FROM ({_BY_FAMILY}) b WHERE b.family = a.family AND b.s <= a.s AND b.v <> 0 ORDER BY b.s DESC LIMIT 1), 0) AS v FROM ({_BY_FAMILY}) a")(lambda d: _by_family(d).select("family", "s", F.coalesce(F.last(F.nullif(F.col("v"), F.lit(0)), True).over(W.partitionBy("family").orderBy("s")), F.lit(0)).alias("v")))
select("WIN-13", "domains", f"SELECT a.family, a.s, sum(b.v) AS v FROM ({_BY_FAMILY}) a JOIN ({_BY_FAMILY}) b ON b.family = a.family AND b.s <= a.s GROUP BY a.family, a.s")(lambda d: _by_family(d).select("family", "s", F.sum("v").over(W.partitionBy("family").orderBy("s")).alias("v")))


@select("WIN-15", "domains", f"SELECT a.family, a.k, sum(b.v) AS v FROM (SELECT *, s / 20 AS k FROM ({_BY_FAMILY}) x) a JOIN (SELECT *, s / 20 AS k FROM ({_BY_FAMILY}) x) b ON b.family = a.family JOIN (SELECT family, count(*) AS n FROM ({_BY_FAMILY}) x GROUP BY family) c ON c.family = a.family WHERE least((a.k - b.k + c.n) % c.n, (b.k - a.k + c.n) % c.n) <= 1 GROUP BY a.family, a.k")
def circular(d):
    """Sums over a window of three places on a ring: the ends are put on the other side once more."""
    v = _by_family(d).withColumn("k", F.col("s") / 20)
    n = v.groupBy("family").agg(F.count("*").alias("n"))
    ring = v.join(n, "family").select("family", "v", F.explode(F.array(F.struct(F.col("k").alias("k"), F.lit(True).alias("own")), F.struct((F.col("k") + F.col("n")).alias("k"), F.lit(False).alias("own")), F.struct((F.col("k") - F.col("n")).alias("k"), F.lit(False).alias("own")))).alias("x"))
    summed = F.sum("v").over(W.partitionBy("family").orderBy("x.k").rowsBetween(-1, 1))
    return ring.select("family", "x.k", "x.own", summed.alias("v")).where("own").select("family", "k", "v")


select("WIN-18", "tested", "SELECT b AS bin, coalesce(n, 0) AS n FROM range(0, 60) r(b) LEFT JOIN (SELECT naligned AS k, count(*) AS n FROM tested WHERE naligned BETWEEN 7 AND 33 AND naligned % 4 <> 1 GROUP BY 1) h ON h.k = r.b WHERE b BETWEEN 7 AND 32")(
    lambda x: (h := x.where("naligned BETWEEN 7 AND 33 AND naligned % 4 <> 1").groupBy(F.col("naligned").cast("long").alias("bin")).agg(F.count("*").alias("n"))).agg(F.explode(F.sequence(F.min("bin"), F.max("bin"))).alias("bin")).join(h, "bin", "left").fillna(0, ["n"])
)
_CUM = "SELECT value, sum(hit) AS tp, count(*) AS n FROM scored GROUP BY value"
select("WIN-22", "scored", f"SELECT b.bin, sum(c.tp) AS tp, sum(c.n - c.tp) AS fp FROM (SELECT DISTINCT CAST(floor(value / 1000) AS BIGINT) AS bin FROM scored) b JOIN (SELECT CAST(floor(value / 1000) AS BIGINT) AS bin, sum(tp) AS tp, sum(n) AS n FROM ({_CUM}) q GROUP BY 1) c ON c.bin >= b.bin GROUP BY b.bin")(
    lambda x: x.groupBy(F.floor(F.col("value") / 1000).alias("bin")).agg(F.sum("hit").alias("t"), F.count("*").alias("n")).select("bin", F.sum("t").over(W.orderBy(F.desc("bin"))).alias("tp"), F.sum(F.expr("n - t")).over(W.orderBy(F.desc("bin"))).alias("fp"))
)
_TEXT = "(SELECT nid, unnest(string_split(sequence, chr(10))) AS line, generate_subscripts(string_split(sequence, chr(10)), 1) AS k FROM sequences)"
_lines = lambda s: s.select("nid", F.posexplode(F.split("sequence", "\n")).alias("k", "line")).withColumn("k", F.col("k") + 1)
_first = lambda rx: F.min(F.when(F.col("line").rlike(rx), F.col("k"))).over(W.partitionBy("nid"))
_CUT = f"SELECT nid, CAST(k AS BIGINT) AS k, line FROM (SELECT *, min(CASE WHEN regexp_matches(line, '{{0}}') THEN k END) OVER (PARTITION BY nid) AS a, min(CASE WHEN regexp_matches(line, '{{1}}') THEN k END) OVER (PARTITION BY nid) AS b FROM {_TEXT} t) x WHERE {{2}}"
select("PRJ-09", "sequences", _CUT.format("the", "and", "k >= a AND k <= b"))(lambda s: _lines(s).withColumn("a", _first("the")).withColumn("b", _first("and")).where("k >= a AND k <= b").select("nid", F.col("k").cast("long").alias("k"), "line"))
select("PRJ-10", "sequences", _CUT.format("the", "the", "a IS NULL OR k <= a"))(lambda s: _lines(s).withColumn("a", _first("the")).where("a IS NULL OR k <= a").select("nid", F.col("k").cast("long").alias("k"), "line"))
select("PRJ-11", "sequences", _CUT.format("the", "the", "k > a"))(lambda s: _lines(s).withColumn("a", _first("the")).where("k > a").select("nid", F.col("k").cast("long").alias("k"), "line"))
select("PRJ-16", "texts", "SELECT nid, v, CASE WHEN regexp_full_match(v, '[+-]?[0-9]+') THEN 'int' WHEN regexp_full_match(v, '[+-]?[0-9]*\\.[0-9]+') THEN 'float' ELSE 'string' END AS kind FROM texts")(lambda t: t.select("nid", "v", F.when(F.col("v").try_cast("bigint").isNotNull(), "int").when(F.col("v").try_cast("double").isNotNull(), "float").otherwise("string").alias("kind")))
select("PRJ-17", "texts", "SELECT nid, TRY_CAST(v AS DOUBLE) AS number FROM texts WHERE TRY_CAST(v AS DOUBLE) IS NOT NULL")(lambda t: t.select("nid", F.col("v").try_cast("double").alias("number")).where("number IS NOT NULL"))
select("PRJ-18", "texts", "SELECT nid, v, TRY_CAST(v AS BIGINT) AS whole, TRY_CAST(v AS DOUBLE) AS number, CASE lower(v) WHEN 'true' THEN true WHEN 'false' THEN false END AS flag, CAST(len(string_split(v, ',')) AS INT) AS parts FROM texts WHERE v <> '# note' AND v NOT LIKE '%.5'")(
    lambda t: t.where("v <> '# note' AND v NOT LIKE '%.5'").select("nid", "v", F.col("v").try_cast("bigint").alias("whole"), F.col("v").try_cast("double").alias("number"), F.when(F.lower("v") == "true", True).when(F.lower("v") == "false", False).alias("flag"), F.size(F.split("v", ",")).alias("parts"))
)
select("PRJ-19", "texts", "SELECT nid, v FROM texts WHERE v NOT LIKE '#%'")(lambda t: t.where(~F.col("v").startswith("#")))
select("PRJ-20", "texts", "SELECT nid, count(*) AS n FROM texts WHERE left(v, 1) <> '#' GROUP BY nid")(lambda t: t.where(F.substring("v", 1, 1) != "#").groupBy("nid").agg(F.count("*").alias("n")))
select("PRJ-03", "domains units", "SELECT d.nid, d.s, coalesce(m.name, d.family) AS family FROM domains d LEFT JOIN (SELECT * FROM (VALUES ('AF', 'one'), ('AF', 'two'), ('NO', 'three')) x(family, name)) m ON m.family = d.family")(
    lambda d, u: d.join(F.broadcast(d.sparkSession.createDataFrame([("AF", "one"), ("AF", "two"), ("NO", "three")], "family string, name string")), "family", "left").select("nid", "s", F.coalesce("name", "family").alias("family"))
)
select("MKF-02", "units domains", "SELECT u.nid, u.s, u.e FROM units u WHERE EXISTS (SELECT 1 FROM domains d WHERE d.nid = u.nid AND d.family = 'AF')")(lambda u, d: u.join(d.where("family = 'AF'"), "nid", "left_semi").select("nid", "s", "e"))
select("MKF-07", "domains assigned", "SELECT tax_id, count(DISTINCT d.nid) AS sequences, count(*) AS domains, count(DISTINCT family) AS families FROM domains d JOIN assigned a ON a.nid = d.nid GROUP BY tax_id")(lambda d, a: d.join(a, "nid").groupBy("tax_id").agg(F.countDistinct("nid").alias("sequences"), F.count("*").alias("domains"), F.countDistinct("family").alias("families")))
select("MKF-09", "units", "SELECT DISTINCT family, false AS is_module, false AS is_known, 'unknown' AS category FROM units")(lambda u: u.select("family").distinct().select("family", F.lit(False).alias("is_module"), F.lit(False).alias("is_known"), F.lit("unknown").alias("category")))
select("MKF-12", "units known", "SELECT family, count(k.nid) > 20 AS is_module FROM units u LEFT JOIN (SELECT DISTINCT nid FROM known) k ON k.nid = u.nid GROUP BY family")(lambda u, k: u.join(k.distinct().withColumn("k", F.lit(1)), "nid", "left").groupBy("family").agg((F.count("k") > 20).alias("is_module")))
select("MKF-14", "domains units", "SELECT 'domains' AS level, count(*) AS counts, count(DISTINCT nid) AS units FROM domains UNION ALL SELECT 'units', count(*), count(DISTINCT nid) FROM units")(lambda d, u: (f := lambda x, n: x.agg(F.lit(n).alias("level"), F.count("*").alias("counts"), F.countDistinct("nid").alias("units")))(d, "domains").unionByName(f(u, "units")))
select("MKF-15", "lengths domains", "SELECT l.nid, l.length FROM lengths l WHERE NOT EXISTS (SELECT 1 FROM domains d WHERE d.nid = l.nid AND d.family <> 'NO')")(lambda n, d: n.join(d.where("family <> 'NO'"), "nid", "left_anti").select("nid", "length"))
select("MKF-24", "links domains", "SELECT d.family, round(avg(100e0 * greatest(0, d.e - l.qe) / (d.e - d.s)), 6) AS overhang FROM links l JOIN domains d ON d.nid = l.query_nid AND least(d.e, l.qe) > greatest(d.s, l.qs) GROUP BY d.family")(
    lambda k, d: k.join(d, F.expr("nid = query_nid AND least(e, qe) > greatest(s, qs)")).groupBy("family").agg(F.round(F.avg(100.0 * F.greatest(F.lit(0), F.expr("e - qe")) / F.expr("e - s")), 6).alias("overhang"))
)
select("JOI-15", "links", "SELECT a.query_nid AS nid, b.sbjct_nid AS neighbour, count(*) AS paths FROM links a JOIN links b ON b.query_nid = a.sbjct_nid GROUP BY 1, 2")(lambda k: k.alias("a").join(k.alias("b"), F.col("b.query_nid") == F.col("a.sbjct_nid")).groupBy(F.col("a.query_nid").alias("nid"), F.col("b.sbjct_nid").alias("neighbour")).agg(F.count("*").alias("paths")))
select("JOI-36", "links domains", "SELECT distance, count(*) AS n FROM (SELECT l.query_nid, l.sbjct_nid, l.qs, l.qe, min(abs(d.s - l.qe)) AS distance FROM links l JOIN domains d ON d.nid = l.sbjct_nid GROUP BY ALL) x GROUP BY distance")(
    lambda k, d: k.join(d, F.col("nid") == F.col("sbjct_nid")).groupBy("query_nid", "sbjct_nid", "qs", "qe").agg(F.min(F.abs(F.expr("s - qe"))).alias("distance")).groupBy("distance").agg(F.count("*").alias("n"))
)
select("JOI-35", "links domains", "SELECT l.query_nid, l.sbjct_nid, d.family, greatest(d.s, l.qs) AS qs, least(d.e, l.qe) AS qe, greatest(d.s, l.qs) - l.qs + l.ss AS ss, least(d.e, l.qe) - l.qs + l.ss AS se FROM links l JOIN domains d ON d.nid = l.query_nid WHERE greatest(d.s, l.qs) < least(d.e, l.qe)")(
    lambda k, d: k.join(d, F.expr("nid = query_nid AND greatest(s, qs) < least(e, qe)")).select("query_nid", "sbjct_nid", "family", F.greatest("s", "qs").alias("qs"), F.least("e", "qe").alias("qe"), F.expr("greatest(s, qs) - qs + ss").alias("ss"), F.expr("least(e, qe) - qs + ss").alias("se"))
)
select("JOI-34", "links domains", "SELECT l.query_nid, l.sbjct_nid, l.qs, d.s, d.family, least(d.e, l.qe) - greatest(d.s + 1, l.qs + 1) + 1 AS common FROM links l JOIN domains d ON d.nid = l.query_nid WHERE least(d.e, l.qe) - greatest(d.s + 1, l.qs + 1) + 1 >= 20")(
    lambda k, d: k.join(d, F.expr("nid = query_nid AND least(e, qe) - greatest(s + 1, qs + 1) + 1 >= 20")).select("query_nid", "sbjct_nid", "qs", "s", "family", F.expr("least(e, qe) - greatest(s + 1, qs + 1) + 1").alias("common"))
)
select("ALG-13", "trees", "SELECT p.nid, p.node, min(c.node) AS left_, max(c.node) AS right_ FROM trees p JOIN trees c ON c.nid = p.nid AND c.parent = p.node GROUP BY p.nid, p.node")(lambda t: t.where("parent >= 0").join(t.select("nid", F.col("node").alias("parent")), ["nid", "parent"]).groupBy("nid", F.col("parent").alias("node")).agg(F.min("node").alias("left_"), F.max("node").alias("right_")))
select("ALG-14", "trees", "SELECT nid, parent AS node, string_agg(CAST(node AS VARCHAR), ',' ORDER BY node) AS children FROM trees WHERE parent >= 0 GROUP BY nid, parent")(lambda t: t.where("parent >= 0").groupBy("nid", F.col("parent").alias("node")).agg(F.array_join(F.array_sort(F.collect_list("node")), ",").alias("children")))
select("ALG-19", "links", "SELECT query_nid, qs, qe, 0.05e0 * greatest(0, least(10, qe - qs - 20)) AS transfer FROM links")(lambda k: k.select("query_nid", "qs", "qe", F.element_at(F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: i * 0.05), F.greatest(F.lit(0), F.least(F.lit(10), F.expr("qe - qs - 20"))) + 1).alias("transfer")))
select("ALG-20", "links", "SELECT query_nid, qs, qe, round(0.98e0 * exp(-0.04e0 * (qe - qs)), 9) AS overhang FROM links")(lambda k: k.select("query_nid", "qs", "qe", F.round(0.98 * F.exp(-0.04 * F.expr("qe - qs")), 9).alias("overhang")))
select("ALG-24", "trees", "SELECT c.nid, c.node, c.s, c.e FROM trees c JOIN trees p ON p.nid = c.nid AND p.node = 0 WHERE c.parent = 0")(lambda t: t.where("node = 0").select("nid", F.col("node").alias("parent")).join(t, ["nid", "parent"]).select("nid", "node", "s", "e"))
query("ALG-25", "trees", "SELECT count(*) AS n FROM trees WHERE level = 2")(lambda st, t: st.put("partitions", t.where("level = 2").select("nid", "s", "e")).agg(F.count("*").alias("n")))
select("ALG-31", "tested", "SELECT q, t, weight, weight > 83 AND naligned > 10 AS accepted FROM tested")(lambda x: x.select("q", "t", "weight", F.expr("weight > 83 AND naligned > 10").alias("accepted")))
select("RUN-11", "trees", "SELECT DISTINCT node FROM trees WHERE node = 1 OR node IN (3, 4)")(lambda t: t.select("node").distinct().where(F.array_contains(F.flatten(F.transform(F.split(F.lit("1,3-5"), ","), lambda x: F.when(x.contains("-"), F.sequence(F.split(x, "-")[0].cast("int"), F.split(x, "-")[1].cast("int") - 1)).otherwise(F.array(F.split(x, "-")[0].cast("int"))))), F.col("node"))))
select("RUN-21", "sequences", "SELECT DISTINCT pid, concat(replace(pid, 'src', 'table_'), '_x') AS name FROM sequences")(lambda s: s.select("pid").distinct().select("pid", F.regexp_replace(F.regexp_replace(F.concat(F.col("pid"), F.lit("-x.load")), r"\.load$", ""), "[-.]", "_").alias("n")).select("pid", F.regexp_replace("n", "^src", "table_").alias("name")))
select("RUN-37", "sequences", "SELECT pid AS id, nid, CAST(length(sequence) AS INT) AS length FROM sequences")(lambda s: s.select(F.col("pid").alias("id"), "nid", F.length("sequence").alias("length")))
select("RUN-38", "domains units refs", "SELECT count(*) AS nids, sum(CASE WHEN a AND b THEN 1 ELSE 0 END) AS ab, sum(CASE WHEN a AND c THEN 1 ELSE 0 END) AS ac, sum(CASE WHEN a AND b AND c THEN 1 ELSE 0 END) AS abc FROM (SELECT nid, bool_or(k = 1) AS a, bool_or(k = 2) AS b, bool_or(k = 3) AS c FROM (SELECT nid, 1 AS k FROM domains UNION ALL SELECT nid, 2 FROM units UNION ALL SELECT nid, 3 FROM refs) x GROUP BY nid) y")(
    lambda a, b, c: a.select("nid", F.lit(1).alias("k")).unionByName(b.select("nid", F.lit(2).alias("k"))).unionByName(c.select("nid", F.lit(3).alias("k"))).groupBy("nid").agg(F.collect_set("k").alias("in")).agg(F.count("*").alias("nids"), *(F.sum(F.forall(F.array(*map(F.lit, w)), lambda x: F.array_contains("in", x)).cast("int")).alias(n) for n, w in (("ab", (1, 2)), ("ac", (1, 3)), ("abc", (1, 2, 3)))))
)
select("RUN-34", "sequences", "SELECT hid, count(*) AS n, bool_or(nid % 2 = 0) AND bool_or(nid % 2 = 1) AS in_both FROM (SELECT nid, md5(sequence) AS hid FROM sequences) x GROUP BY hid")(lambda s: (h := s.select("nid", F.md5("sequence").alias("hid"))).groupBy("hid").agg(F.count("*").alias("n"), (F.bool_or(F.col("nid") % 2 == 0) & F.bool_or(F.col("nid") % 2 == 1)).alias("in_both")))
select("RUN-35", "domains known", "SELECT concat('n', d.nid) AS nid, s, e, family FROM domains d JOIN (SELECT DISTINCT nid FROM known) k ON k.nid = d.nid")(lambda d, k: d.join(k.distinct(), "nid").select(F.concat(F.lit("n"), F.col("nid").cast("string")).alias("nid"), "s", "e", "family"))
