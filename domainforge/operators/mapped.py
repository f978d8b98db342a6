"""Queries over block alignments, formats, histograms, tests and interval sweeps."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from domainforge.functions import maps, statistics
from domainforge.operators import intervals as iv
from domainforge.operators.views import view, with_views

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, source: str, sql: str | None):
    def put(f):
        QUERIES[name] = lambda spark, d: f(*(view(spark, d, v) for v in source.split()))
        if sql:
            ORACLES[name] = with_views(sql)
        return f

    return put


_blocks = lambda: maps.from_lists(F.col("sizes"), F.col("q_starts"), F.col("s_starts"))
#: The blocks of the view, written out.
_B = "(SELECT q, t, 1 AS k, q_from AS lo, q_from + a AS hi, s_from - q_from AS shift, a, b, g FROM blocked UNION ALL SELECT q, t, 2, q_from + a, q_from + a + b, s_from + g - q_from, a, b, g FROM blocked)"


@query("SCL-18", "blocked", f"SELECT q, t, CAST(x AS INT) AS row, CAST(x + shift AS INT) AS col FROM (SELECT *, unnest(range(lo, hi)) AS x FROM {_B} b) c")
def emissions(links):
    ali = maps.from_emissions(F.col("q_from"), F.col("q_ali"), F.col("s_from"), F.col("s_ali"))
    return links.select("q", "t", F.explode(maps.aligned_pairs(ali)).alias("p")).select("q", "t", "p.row", "p.col")


@query("SCL-19", "blocked", f"SELECT q, t, lo, hi, shift FROM {_B} b")
def diagonals(links):
    return links.select("q", "t", F.explode(_blocks()).alias("b")).select("q", "t", "b.lo", "b.hi", "b.shift")


_AT = "q_from + a + 1 - t"


@query("SCL-20", "blocked", f"SELECT q, t, CAST(coalesce((SELECT min(x + shift) FROM (SELECT greatest(lo, {_AT}) AS x, shift FROM (SELECT q_from AS lo, q_from + a AS hi, s_from - q_from AS shift UNION ALL SELECT q_from + a, q_from + a + b, s_from + g - q_from) z WHERE hi > {_AT}) y), 0) AS INT) AS mapped FROM blocked")
def right(links):
    return links.select("q", "t", maps.map_right(_blocks(), F.expr(_AT)).alias("mapped"))


@query("SCL-21", "blocked", f"SELECT q, t, CAST(coalesce((SELECT max(x + shift) FROM (SELECT least(hi - 1, {_AT} + 9) AS x, shift FROM (SELECT q_from AS lo, q_from + a AS hi, s_from - q_from AS shift UNION ALL SELECT q_from + a, q_from + a + b, s_from + g - q_from) z WHERE lo <= {_AT} + 9) y), 0) AS INT) AS mapped FROM blocked")
def left(links):
    return links.select("q", "t", maps.map_left(_blocks(), F.expr(f"{_AT} + 9")).alias("mapped"))


@query("SCL-22", "blocked", f"""SELECT q, t, min(x) AS lo, max(x) + 1 AS hi, min(z) AS col_lo, max(z) + 1 AS col_hi FROM (SELECT p.q, p.t, CAST(p.x AS INT) AS x, CAST(r.x + r.shift AS INT) AS z FROM (SELECT *, unnest(range(lo, hi)) AS x FROM {_B} b) p
    JOIN (SELECT *, unnest(range(lo, hi)) AS x FROM {_B} b) r ON r.q = p.q AND r.t = p.t AND r.x = p.x + p.shift + 4 * p.t) y GROUP BY q, t""")
def composed(links):
    """A map and the same map moved along; mappings without a residue are dropped."""
    moved = F.transform(_blocks(), lambda b: F.struct((b["lo"] - 4 * F.col("t")).cast("int").alias("lo"), (b["hi"] - 4 * F.col("t")).cast("int").alias("hi"), (b["shift"] + 4 * F.col("t")).cast("int").alias("shift")))
    both = links.select("q", "t", maps.compose(_blocks(), moved).alias("c")).where(F.size("c") > 0)
    return both.select("q", "t", *(x.alias(n) for x, n in zip(maps.bounds(F.col("c")), ("lo", "hi", "col_lo", "col_hi"), strict=True)))


@query("SCL-23", "blocked", f"SELECT q, t, CASE WHEN k = 2 AND g > 2 THEN 1 ELSE 0 END AS part, min(lo) AS lo, max(hi) AS hi, min(lo + shift) AS col_lo, max(hi + shift) AS col_hi FROM {_B} b GROUP BY q, t, CASE WHEN k = 2 AND g > 2 THEN 1 ELSE 0 END")
def parted(links):
    return maps.split(links.withColumn("blocks", _blocks()), ["q", "t"], "blocks", 2)


@query("SCL-24", "blocked", "SELECT concat(q, chr(9), q_from, chr(9), q_from + a + b, chr(9), q_ali, chr(9), t, chr(9), s_from, chr(9), s_from + a + g + b, chr(9), s_ali) AS line FROM blocked")
def lines(links):
    lo, hi, col_lo, col_hi = maps.bounds(_blocks())
    return links.select(F.concat_ws("\t", *(c.cast("string") for c in (F.col("q"), lo, hi, F.col("q_ali"), F.col("t"), col_lo, col_hi, F.col("s_ali")))).alias("line"))


@query("SCL-25", "edges", "SELECT a AS r, b AS c, 1 AS present FROM edges UNION SELECT b, a, 1 FROM edges")
def presence(edges):
    """The cells of a symmetric matrix that are not 0."""
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("r"), F.col("b").alias("c")), F.struct(F.col("b").alias("r"), F.col("a").alias("c")))).alias("x"))
    return both.select("x.r", "x.c", F.lit(1).alias("present")).distinct()


def hid(sequence):
    """22 characters that tell sequences apart."""
    return F.substring(F.translate(F.base64(F.unhex(F.md5(sequence))), "/+=", "_[]"), 1, 22)


_HID = "substring(replace(replace(replace(to_base64(unhex(md5({0}))), '/', '_'), '+', '['), '=', ']'), 1, 22)"
query("SCL-02", "sequences", f"SELECT pid, nid, {_HID.format('sequence')} AS hid, length(sequence) AS length FROM sequences WHERE sequence <> ''")(lambda s: s.where("sequence <> ''").select("pid", "nid", hid("sequence").alias("hid"), F.length("sequence").alias("length")))
query("SCL-03", "sequences", f"SELECT hid, count(*) AS n, min(nid) AS nid FROM (SELECT nid, {_HID.format("replace(sequence, ' ', '')")} AS hid FROM sequences) x GROUP BY hid")(lambda s: s.select("nid", hid(F.translate("sequence", " ", "")).alias("hid")).groupBy("hid").agg(F.count("*").alias("n"), F.min("nid").alias("nid")))
query("SCL-07", "lengths", "SELECT nid, printf('links.tsv.%010d.%010d.tsv', nid, nid + 10) AS name FROM lengths")(lambda x: x.select("nid", F.concat(F.lit("links.tsv"), F.format_string(".%010d.%010d", "nid", F.col("nid") + 10), F.regexp_extract(F.lit("links.tsv"), r"(\.[^./]*)?$", 0)).alias("name")))
query("SCL-09", "tested", "SELECT q, t, weight, coalesce(printf('%5.2f', CASE WHEN naligned >= 10 THEN weight END), 'na') AS shown FROM tested")(lambda x: x.select("q", "t", "weight", F.coalesce(F.format_string("%5.2f", F.when(F.col("naligned") >= 10, F.col("weight"))).substr(F.lit(1), F.when(F.col("naligned") >= 10, F.lit(99))), F.lit("na")).alias("shown")))
_LISTS = "SELECT nid, list(s ORDER BY s) AS starts, list(e ORDER BY e) AS ends FROM (SELECT DISTINCT nid, s, e FROM domains) a GROUP BY nid"
query("SCL-12", "domains", f"SELECT nid, list_sum(l) AS total, CAST(len(l) AS INT) AS n FROM (SELECT nid, list_concat(starts, ends) AS l FROM ({_LISTS}) x) y")(lambda d: d.select("nid", "s", "e").distinct().groupBy("nid").agg(F.flatten(F.array(F.array_sort(F.collect_list("s")), F.array_sort(F.collect_list("e")))).alias("l")).select("nid", F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("l").alias("n")))
query("SCL-13", "domains", "SELECT nid, CAST(2 * count(*) AS INT) AS n, min(s) AS lo, max(e) AS hi FROM (SELECT DISTINCT nid, s, e FROM domains) x GROUP BY nid")(
    lambda d: d.select("nid", "s", "e").distinct().groupBy("nid").agg(F.flatten(F.flatten(F.array(F.collect_list(F.array("s", "e"))))).alias("l")).select("nid", F.size("l").alias("n"), F.array_min("l").alias("lo"), F.array_max("l").alias("hi"))
)
query("SCL-14", "domains", "SELECT family, CAST(count(DISTINCT nid) AS INT) AS n, min(nid) AS lo, max(nid) AS hi FROM domains GROUP BY family")(lambda d: d.select("nid", "family").distinct().groupBy("family").agg(F.collect_set("nid").alias("ids")).select("family", F.size("ids").alias("n"), F.array_min("ids").alias("lo"), F.array_max("ids").alias("hi")))
query("SCL-15", "domains", "SELECT nid, family, s, max(e) AS e FROM domains GROUP BY nid, family, s")(
    lambda d: d.groupBy("nid", "family", "s").agg(F.max("e").alias("e")).groupBy("nid", "family").agg(F.map_from_entries(F.collect_list(F.struct("s", "e"))).alias("m")).groupBy("nid").agg(F.map_from_entries(F.collect_list(F.struct("family", "m"))).alias("m")).select("nid", F.explode("m").alias("family", "m")).select("nid", "family", F.explode("m").alias("s", "e"))
)
query("SCL-16", "domains", "SELECT DISTINCT concat('t_', nid % 5, '_x__', family, '___b_') AS name FROM domains")(lambda d: d.select(F.regexp_replace(F.concat(F.lit("t-"), (F.col("nid") % 5).cast("string"), F.lit(".x()"), F.col("family"), F.lit("[,]b.")), r"[-(),\[\].]", "_").alias("name")).distinct())
query("SCL-17", "tested", "SELECT q, t, CASE WHEN passed = '-' THEN 'NULL' ELSE concat('''', passed, '''') END AS passed, CASE WHEN naligned = 7 THEN 'NULL' ELSE CAST(naligned AS VARCHAR) END AS naligned FROM tested")(
    lambda x: x.select("q", "t", F.coalesce(F.concat(F.lit("'"), F.nullif(F.col("passed"), F.lit("-")), F.lit("'")), F.lit("NULL")).alias("passed"), F.coalesce(F.nullif(F.col("naligned"), F.lit(7)).cast("string"), F.lit("NULL")).alias("naligned"))
)

# ---- histograms and tests ----

_H = "(SELECT e - s AS bin, count(*) AS n FROM refs GROUP BY e - s)"
_hist = lambda d: d.groupBy((F.col("e") - F.col("s")).alias("bin")).agg(F.count("*").alias("n"))
query("HST-04", "refs", f"SELECT CAST(r.bin AS INT) AS bin, h.n FROM range(0, 60) r(bin) JOIN {_H} h ON h.bin = r.bin WHERE h.n > 0")(lambda d: d.sparkSession.range(60).select(F.col("id").cast("int").alias("bin")).join(_hist(d), "bin", "left").fillna(0, ["n"]).where("n > 0"))
query("HST-05", "refs", f"SELECT bin * 2.5e0 AS bin, n FROM {_H} h")(lambda d: _hist(d).select((F.col("bin") * 2.5).alias("bin"), "n"))
_EDGES = [5, 10, 20, 40]
query("HST-09", "refs", "SELECT CASE WHEN v < 10 THEN 5 WHEN v < 20 THEN 10 WHEN v < 40 THEN 20 ELSE 40 END AS bin, count(*) AS n FROM (SELECT e - s AS v FROM refs WHERE e - s >= 5) x GROUP BY 1")(
    lambda d: d.select(F.array_max(F.filter(F.array(*map(F.lit, _EDGES)), lambda b: b <= F.col("e") - F.col("s"))).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count("*").alias("n"))
)
query("HST-11", "refs", f"SELECT concat(lpad(CAST(bin AS VARCHAR), 6, ' '), ' ', repeat('*', CAST(round(40.0 * n / (SELECT max(n) FROM {_H} m)) AS INT))) AS line FROM {_H} h")(lambda d: _hist(d).withColumn("m", F.max("n").over(W.partitionBy())).select(F.concat(F.lpad(F.col("bin").cast("string"), 6, " "), F.lit(" "), F.repeat(F.lit("*"), F.round(40.0 * F.col("n") / F.col("m")).cast("int"))).alias("line")))
query("HST-12", "refs", f"SELECT concat(r.bin, chr(9), coalesce(CAST(n AS VARCHAR), 'na')) AS line FROM range(0, 60) r(bin) LEFT JOIN {_H} h ON h.bin = r.bin")(lambda d: d.sparkSession.range(60).select(F.col("id").cast("int").alias("bin")).join(_hist(d), "bin", "left").select(F.concat_ws("\t", F.col("bin").cast("string"), F.coalesce(F.col("n").cast("string"), F.lit("na"))).alias("line")))
query("HST-14", "tested", "SELECT 5 * CAST(floor(naligned / 5) AS INT) AS bin, count(*) AS n FROM tested GROUP BY 1")(lambda x: x.groupBy((5 * F.floor(F.col("naligned") / 5).cast("int")).alias("bin")).agg(F.count("*").alias("n")))
query("HST-15", "refs", f"SELECT bin, n, round(100e0 * n / sum(n) OVER (), 6) AS percent, sum(n) OVER (ORDER BY bin) AS upto, sum(n) OVER (ORDER BY bin DESC) AS from_ FROM {_H} h")(
    lambda d: _hist(d).select("bin", "n", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 6).alias("percent"), F.sum("n").over(W.orderBy("bin")).alias("upto"), F.sum("n").over(W.orderBy(F.desc("bin"))).alias("from_"))
)
query("HST-13", "refs", f"SELECT bin, round(1e0 * (SELECT sum(n) FROM {_H} g WHERE g.bin >= h.bin) / (SELECT sum(n) FROM {_H} g), 8) AS share FROM (SELECT DISTINCT 3 * CAST(floor(bin / 3) AS INT) AS bin FROM {_H} k) h")(
    lambda d: d.groupBy((3 * F.floor((F.col("e") - F.col("s")) / 3).cast("int")).alias("bin")).agg(F.count("*").alias("n")).select("bin", F.round(F.sum("n").over(W.orderBy(F.desc("bin"))) / F.sum("n").over(W.partitionBy()), 8).alias("share"))
)
query("HST-16", "sequences", "SELECT length(sequence) AS length, count(*) AS n FROM sequences GROUP BY 1")(lambda s: s.groupBy(F.length("sequence").alias("length")).agg(F.count("*").alias("n")))
query("HST-18", "refs", "SELECT family, count(*) AS n, round(avg(e - s), 6) AS mean, round(stddev_pop(e - s), 6) AS sd, round((max(e - s) - avg(e - s)) / nullif(stddev_pop(e - s), 0), 6) AS z_max FROM refs GROUP BY family")(
    lambda d: d.groupBy("family").agg(F.count("*").alias("n"), F.round(F.avg(F.expr("e - s")), 6).alias("mean"), F.round(F.stddev_pop(F.expr("e - s")), 6).alias("sd"), F.round((F.max(F.expr("e - s")) - F.avg(F.expr("e - s"))) / F.nullif(F.stddev_pop(F.expr("e - s")), F.lit(0.0)), 6).alias("z_max"))
)
query("HST-20", "tested", "SELECT q, t, weight, chi, CAST(4 AS INT) AS df, round(exp(-chi / 2) * (1 + chi / 2), 9) AS p, exp(-chi / 2) * (1 + chi / 2) < 0.05 AS passed FROM (SELECT *, 2e0 * naligned / 5 AS chi FROM tested) x")(
    lambda x: x.select("q", "t", "weight", statistics.log_likelihood(F.col("naligned") / 5.0 - 100, F.lit(7), F.lit(-100.0), F.lit(3)).alias("r")).select("q", "t", "weight", F.round("r.chi", 9).alias("chi"), "r.df", F.round("r.p", 9).alias("p"), "r.passed")
)
_CELLS = "(SELECT CASE WHEN s % 3 = 0 THEN 'expected' ELSE 'observed' END AS w, substr(family, 1, 1) AS k, 1e0 * count(*) AS v FROM domains GROUP BY 1, 2)"
query("HST-22", "domains", f"""SELECT round(chi, 6) AS chi, df, round(exp(-chi / 2), 9) AS p, exp(-chi / 2) < 0.05 AS passed, round(sqrt(chi / t), 8) AS phi FROM (SELECT sum(pow(v - x, 2) / x) AS chi, count(DISTINCT k) - 1 AS df, sum(v) AS t
    FROM (SELECT *, sum(v) OVER (PARTITION BY w) * sum(v) OVER (PARTITION BY k) / sum(v) OVER () AS x FROM {_CELLS} c) y) z""")(
    lambda d: statistics.chi_squared_test(d.groupBy(F.when(F.col("s") % 3 == 0, "observed").otherwise("expected").alias("w0"), F.substring("family", 1, 1).alias("k")).agg(F.count("*").alias("v")).withColumn("w", F.when(F.col("w0") == "observed", "a").otherwise("b")), "w", "k", "v").select(F.round("chi", 6).alias("chi"), "df", F.round("p", 9).alias("p"), "passed", F.round("phi", 8).alias("phi"))
)
query("HST-23", "domains", "SELECT family, round(pow(k - 0.3e0 * n, 2) / (0.3e0 * n), 8) AS chi, round(sqrt(pow(k - 0.3e0 * n, 2) / (0.3e0 * n) / n), 8) AS phi, pow(k - 0.3e0 * n, 2) / (0.3e0 * n) > 3.841458820694124 AS passed FROM (SELECT family, count(*) AS n, sum(CASE WHEN s % 40 = 0 THEN 1 ELSE 0 END) AS k FROM domains GROUP BY family) x")(
    lambda d: d.groupBy("family").agg(F.count("*").alias("n"), F.sum((F.col("s") % 40 == 0).cast("int")).alias("k")).select("family", statistics.binomial_chi(F.lit(0.3), F.col("n"), F.col("k")).alias("r")).select("family", F.round("r.chi", 8).alias("chi"), F.round("r.phi", 8).alias("phi"), "r.passed")
)
query("HST-27", "tested", """SELECT round(abs(m1 - m2) / sqrt(a + b), 8) AS z, round(pow(a + b, 2) / (a * a / (n1 - 1) + b * b / (n2 - 1)), 4) AS df FROM (SELECT avg(weight) FILTER (passed = '+') AS m1, avg(weight) FILTER (passed = '-') AS m2, count(*) FILTER (passed = '+') AS n1, count(*) FILTER (passed = '-') AS n2,
    var_samp(weight) FILTER (passed = '+') / n1 AS a, var_samp(weight) FILTER (passed = '-') / n2 AS b FROM tested) x""")(
    lambda x: x.groupBy().agg(*(f(F.when(F.col("passed") == p, F.col("weight"))).alias(f"{n}{i}") for i, p in ((1, "+"), (2, "-")) for n, f in (("n", F.count), ("m", F.avg), ("sd", F.stddev_pop)))).select(statistics.welch(*(F.col(c) for c in "n1 m1 sd1 n2 m2 sd2".split())).alias("r")).select(F.round("r.z", 8).alias("z"), F.round("r.df", 4).alias("df"))
)
query("HST-28", "tested", "SELECT n1, n2, r - n1 * (n1 + 1) / 2.0 AS u FROM (SELECT sum(CASE WHEN passed = '+' THEN 1 ELSE 0 END) AS n1, sum(CASE WHEN passed = '-' THEN 1 ELSE 0 END) AS n2, sum(CASE WHEN passed = '+' THEN mean_rank ELSE 0 END) AS r FROM (SELECT passed, rank() OVER (ORDER BY naligned) + (count(*) OVER (PARTITION BY naligned) - 1) / 2.0 AS mean_rank FROM tested) x) y")(
    lambda x: statistics.rank_sum(x, "passed", "naligned").select("n1", "n2", "u")
)
query("HST-31", "pvalues", "SELECT round(least(1e0, avg(CASE WHEN p >= 0.4 THEN 1e0 ELSE 0e0 END) / 0.6), 9) AS pi0 FROM pvalues")(lambda p: statistics.null_share(p, 0.4).select(F.round("pi0", 9).alias("pi0")))
_Q = """SELECT id, p, round(min(least(1e0, p * {pi0} * m / k)) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS q FROM (SELECT id, p, count(*) OVER () AS m, count(*) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM pvalues) x"""
_PI0 = "(SELECT least(1e0, avg(CASE WHEN p >= 0.5 THEN 1e0 ELSE 0e0 END) / 0.5) FROM pvalues)"
query("HST-32", "pvalues", f"SELECT id, p, q, q <= 0.9 AS passed FROM ({_Q.format(pi0=_PI0)}) z")(lambda p: statistics.q_values(p, level=0.9).select("id", "p", F.round("q", 9).alias("q"), (F.round("q", 9) <= 0.9).alias("passed")))
query("HST-33", "pvalues", _Q.format(pi0=_PI0))(lambda p: statistics.q_values(p).select("id", "p", F.round("q", 9).alias("q")))

# ---- intervals ----


@query("INT-07", "domains", """SELECT nid, x AS s, nx AS e FROM (SELECT nid, x, lead(x) OVER (PARTITION BY nid ORDER BY x) AS nx FROM (SELECT nid, s AS x FROM domains UNION SELECT nid, e FROM domains) p) c
    WHERE EXISTS (SELECT 1 FROM domains d WHERE d.nid = c.nid AND d.s <= c.x AND d.e >= c.nx)""")
def intersections_of_all(d):
    """Overlapping intervals cut at all of their borders."""
    island = iv.islands(d, ["nid"]).select("nid", F.col("s").alias("lo"), F.col("e").alias("hi"))
    points = d.select("nid", F.explode(F.array("s", "e")).alias("x")).distinct()
    inside = points.join(island, "nid").where("x >= lo and x <= hi")
    led = inside.withColumn("e", F.lead("x").over(W.partitionBy("nid", "lo").orderBy("x")))
    return led.where("e IS NOT NULL").select("nid", F.col("x").alias("s"), "e")


_SETS = "(SELECT DISTINCT nid, s, e FROM domains) a", "(SELECT DISTINCT nid, s, e FROM masks) b"
query("INT-10", "domains masks", f"""WITH p AS (SELECT nid, s, e, unnest(range(CAST(s AS BIGINT), CAST(e AS BIGINT))) AS x FROM {_SETS[0]}), f AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM masks m WHERE m.nid = p.nid AND p.x >= m.s AND p.x < m.e)),
    g AS (SELECT *, x - row_number() OVER (PARTITION BY nid, s, e ORDER BY x) AS k FROM f) SELECT nid, CAST(min(x) AS INT) AS s, CAST(max(x) + 1 AS INT) AS e FROM g GROUP BY nid, s, e, k""")(lambda d, m: iv.subtract(d, m).select("nid", F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e")))
query("INT-11", "masks known", "SELECT DISTINCT nid, greatest(s, 20) AS s, least(e, 60) AS e FROM (SELECT nid, s, e FROM masks) x WHERE greatest(s, 20) < least(e, 60)")(
    lambda m, k: iv.intersections(m.select("nid", "s", "e").distinct(), m.select("nid", F.lit(20).alias("s"), F.lit(60).alias("e"), F.lit("x").alias("f")).distinct()).select("nid", "s", "e").distinct()
)
query("INT-15", "mali", """SELECT ali, rid, min(pos) AS s, max(pos) + 1 AS e FROM (SELECT *, pos - row_number() OVER (PARTITION BY ali, rid ORDER BY pos) AS k FROM (SELECT ali, rid, pos FROM (SELECT ali, rid, aligned, CAST(unnest(range(0, length(aligned))) AS INT) AS pos FROM mali) c WHERE substr(aligned, pos + 1, 1) <> '-') b) a GROUP BY ali, rid, k""")(
    lambda m: m.select("ali", "rid", "aligned", F.explode(F.transform(F.regexp_extract_all("aligned", F.lit("[^-]+"), F.lit(0)), lambda x, i: F.struct(x.alias("t"), i.alias("i")))).alias("r"), F.regexp_extract_all("aligned", F.lit("^-+|-+"), F.lit(0)).alias("gaps"), F.regexp_extract_all("aligned", F.lit("[^-]+"), F.lit(0)).alias("runs"))
    .withColumn("lead", F.when(F.col("aligned").startswith("-"), 1).otherwise(0))
    .withColumn("s", F.aggregate(F.slice("runs", 1, F.col("r.i")), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(F.slice("gaps", 1, F.col("r.i") + F.col("lead")), F.lit(0), lambda a, x: a + F.length(x)))
    .select("ali", "rid", "s", (F.col("s") + F.length("r.t")).alias("e"))
)


@query("INT-19", "links", """SELECT nid, 10 * min(x) AS s, 10 * max(x) AS e FROM (SELECT nid, x, x - row_number() OVER (PARTITION BY nid ORDER BY x) AS k FROM (SELECT DISTINCT query_nid AS nid, qs + qe % 7 AS x FROM links) a) b GROUP BY nid, k""")
def residue_ranges(links):
    """Runs of residues up to the last residue of each, at a resolution of 10."""
    r = links.select(F.col("query_nid").alias("nid"), (F.col("qs") + F.col("qe") % 7).alias("x")).distinct()
    fresh = F.when(F.col("x") - F.lag("x").over(W.partitionBy("nid").orderBy("x")) > 1, 1).otherwise(0)
    runs = r.withColumn("f", fresh).withColumn("k", F.sum("f").over(W.partitionBy("nid").orderBy("x")))
    return runs.groupBy("nid", "k").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).select("nid", (F.col("lo") * 10).alias("s"), (F.col("hi") * 10).alias("e"))


query("INT-20", "domains lengths", "SELECT d.nid, greatest(CAST(trunc(d.s * 2.5e0) AS INT), 0) AS s, CAST(least(CAST(trunc(d.e * 2.5e0) AS BIGINT), l.length) AS BIGINT) AS e FROM domains d JOIN lengths l ON l.nid = d.nid")(
    lambda d, n: d.join(n, "nid").select("nid", F.greatest((F.col("s") * 2.5).cast("int"), F.lit(0)).alias("s"), F.least((F.col("e") * 2.5).cast("long"), F.col("length")).alias("e"))
)
query("SET-02", "domains units", "SELECT nid, s, e, family, count(*) AS n FROM (SELECT * FROM domains UNION ALL SELECT * FROM units) x GROUP BY ALL")(lambda a, b: a.unionByName(b).groupBy("nid", "s", "e", "family").agg(F.count("*").alias("n")))
query("SET-05", "domains refs", f"SELECT coalesce(a.bin, b.bin) AS bin, coalesce(a.n, 0) + coalesce(b.n, 0) AS n FROM (SELECT e - s AS bin, count(*) AS n FROM domains GROUP BY 1) a FULL JOIN {_H} b ON a.bin = b.bin")(lambda a, b: _hist(a).unionByName(_hist(b)).groupBy("bin").agg(F.sum("n").alias("n")))
query("SET-09", "links lengths", "SELECT l.nid, count(k.query_nid) AS neighbours FROM lengths l LEFT JOIN links k ON k.query_nid = l.nid GROUP BY l.nid UNION ALL SELECT query_nid, count(*) FROM links WHERE query_nid NOT IN (SELECT nid FROM lengths) GROUP BY query_nid")(
    lambda k, n: (p := k.groupBy(F.col("query_nid").alias("nid")).agg(F.count("*").alias("neighbours"))).unionByName(n.join(p, "nid", "left_anti").select("nid", F.lit(0).cast("long").alias("neighbours")))
)
