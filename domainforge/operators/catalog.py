"""All queries of the engine by name, with their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domainforge.operators import aligned, files, mapped, rules, spanning, tables
from domainforge.operators import intervals as iv
from domainforge.operators.graph import components
from domainforge.operators.relational import SQL
from domainforge.operators.views import run_sql, view, with_views

FLAGSHIP = "AGG-02"


def _shared(sql: str):
    return lambda spark, sf_dir: run_sql(spark, sf_dir, sql)


QUERIES: dict = {name: _shared(sql) for name, sql in SQL.items()}
ORACLES: dict[str, str] = {name: with_views(sql) for name, sql in SQL.items()}


def query(name: str, oracle: str | None = None):
    """Register a DataFrame operator; ``oracle`` is SQL over the views for DuckDB."""

    def put(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = with_views(oracle)
        return f

    return put


def family_summary(domains: DataFrame) -> DataFrame:
    """Units, sequences, residues and lengths of each family; one shuffle by family."""
    size = F.col("e") - F.col("s")
    return domains.groupBy("family").agg(
        F.count("*").alias("nunits"),
        F.countDistinct("nid").alias("nsequences"),
        F.sum(size).alias("nresidues"),
        F.round(F.avg(size), 6).alias("length"),
        F.round(F.median(size), 6).alias("length_median"),
        F.round(F.stddev_pop(size), 6).alias("length_stddev"),
    )


QUERIES["AGG-02"] = lambda spark, d: family_summary(view(spark, d, "domains"))

_ISLANDS = """SELECT nid, family, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY nid, family ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT nid, family, s, e, CASE WHEN s > {limit} max(e) OVER (PARTITION BY nid, family ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1
    WHEN max(e) OVER (PARTITION BY nid, family ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NULL THEN 1 ELSE 0 END AS fresh FROM {table}) a) b GROUP BY nid, family, island"""


@query("INT-01", _ISLANDS.format(limit="", table="domains"))
def combine(spark: SparkSession, d: str) -> DataFrame:
    return iv.islands(view(spark, d, "domains"), ["nid", "family"]).select("nid", "family", "s", "e")


@query("INT-05", _ISLANDS.format(limit="14 +", table="domains"))
def combine_at_distance(spark: SparkSession, d: str) -> DataFrame:
    return iv.islands(view(spark, d, "domains"), ["nid", "family"], distance=15, touching=False).select("nid", "family", "s", "e")


@query("WIN-03", _ISLANDS.format(limit="", table="(SELECT * FROM domains WHERE e - s >= 10) q"))
def non_redundant(spark: SparkSession, d: str) -> DataFrame:
    """Short rows dropped, overlapping rows of a family merged."""
    return iv.islands(view(spark, d, "domains").where("e - s >= 10"), ["nid", "family"]).select("nid", "family", "s", "e")


_GAPS = """SELECT nid, s, e FROM (SELECT nid, coalesce(max(e) OVER (PARTITION BY nid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, s AS e FROM domains
    UNION ALL SELECT l.nid, coalesce(m, 0), l.length FROM lengths l LEFT JOIN (SELECT nid, max(e) AS m FROM domains GROUP BY nid) x ON x.nid = l.nid) y WHERE e - s > {0}"""


@query("INT-03", _GAPS.format(0))
def complement(spark: SparkSession, d: str) -> DataFrame:
    return iv.gaps(view(spark, d, "domains"), view(spark, d, "lengths"))


@query("WIN-08", _GAPS.format(30))
def singleton_gaps(spark: SparkSession, d: str) -> DataFrame:
    return iv.gaps(view(spark, d, "domains"), view(spark, d, "lengths"), least=30)


@query("INT-04", "SELECT nid, s, e, 'domain' AS kind FROM domains UNION ALL SELECT nid, s, e, 'gap' FROM (" + _GAPS.format(0) + ") g")
def with_complement(spark: SparkSession, d: str) -> DataFrame:
    own = view(spark, d, "domains")
    return own.select("nid", "s", "e", F.lit("domain").alias("kind")).unionByName(iv.gaps(own, view(spark, d, "lengths")).withColumn("kind", F.lit("gap")))


@query("INT-02", "SELECT nid, greatest(s, 50) AS s, least(e, 110) AS e, family FROM domains WHERE e > 50 AND s < 110")
def prune(spark: SparkSession, d: str) -> DataFrame:
    return iv.clip(view(spark, d, "domains"), 50, 110)


@query("INT-06", "SELECT nid, s, e, family FROM domains WHERE e - s + 1 >= 20")
def drop_small(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "domains").where("e - s + 1 >= 20")


@query("INT-08", "SELECT nid, s, e FROM (SELECT DISTINCT nid, s, e FROM domains) a WHERE NOT EXISTS (SELECT 1 FROM domains b WHERE b.nid = a.nid AND b.s <= a.s AND b.e >= a.e AND (b.s < a.s OR b.e > a.e))")
def not_contained(spark: SparkSession, d: str) -> DataFrame:
    return iv.outermost(view(spark, d, "domains"), ["nid"])


@query("INT-09", "SELECT nid, s, e FROM (SELECT DISTINCT nid, s, e FROM domains) a WHERE NOT EXISTS (SELECT 1 FROM domains b WHERE b.nid = a.nid AND b.s >= a.s AND b.e <= a.e AND (b.s > a.s OR b.e < a.e))")
def not_spanning(spark: SparkSession, d: str) -> DataFrame:
    own = view(spark, d, "domains").select("nid", "s", "e").distinct()
    inner = own.toDF("n", "s2", "e2")
    return own.join(inner, (F.col("nid") == F.col("n")) & F.expr("s2 >= s and e2 <= e and (s2 > s or e2 < e)"), "left_anti")


@query("INT-12", "SELECT a.nid, greatest(a.s, b.s) AS s, least(a.e, b.e) AS e FROM domains a JOIN refs b ON a.nid = b.nid WHERE least(a.e, b.e) > greatest(a.s, b.s)")
def intersect(spark: SparkSession, d: str) -> DataFrame:
    return iv.intersections(view(spark, d, "domains"), view(spark, d, "refs"))


@query("INT-14", "SELECT a.nid, sum(greatest(0, least(a.e, b.e) - greatest(a.s, b.s))) AS common FROM domains a JOIN refs b ON a.nid = b.nid GROUP BY a.nid")
def total_overlap(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "refs").toDF("nid", "s2", "e2", "f2")
    return view(spark, d, "domains").join(b, "nid").groupBy("nid").agg(F.sum(F.greatest(F.lit(0), iv.overlap("s", "e", "s2", "e2"))).alias("common"))


_POINTS = """WITH p AS (SELECT a.nid, a.s AS bs, a.e AS be, unnest(range(CAST(a.s AS BIGINT), CAST(a.e AS BIGINT))) AS x FROM (SELECT DISTINCT nid, s, e FROM domains) a),
    f AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM masks m WHERE m.nid = p.nid AND p.x >= m.s AND p.x < m.e)),
    g AS (SELECT *, x - row_number() OVER (PARTITION BY nid, bs, be ORDER BY x) AS k FROM f)
    SELECT nid, min(x) AS s, max(x) + 1 AS e FROM g GROUP BY nid, bs, be, k"""


@query("INT-13", _POINTS)
def truncate(spark: SparkSession, d: str) -> DataFrame:
    return iv.subtract(view(spark, d, "domains"), view(spark, d, "masks")).select("nid", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))


@query("WIN-01")
def chain_links(spark: SparkSession, d: str) -> DataFrame:
    """A fold over the links merged so far; tested against a plain loop."""
    return iv.chain(view(spark, d, "links"))


@query(
    "JOI-33",
    """SELECT nid, s, e, family, ts, te, common, share FROM (SELECT r.nid, r.s, r.e, r.family, d.s AS ts, d.e AS te, least(d.e, r.e) - greatest(d.s, r.s) AS common,
    round(1e0 * (least(d.e, r.e) - greatest(d.s, r.s)) / (greatest(d.e, r.e) - least(d.s, r.s)), 6) AS share,
    row_number() OVER (PARTITION BY r.nid, r.s, r.e, r.family ORDER BY 1e0 * (least(d.e, r.e) - greatest(d.s, r.s)) / (greatest(d.e, r.e) - least(d.s, r.s)) DESC, d.s, d.e) AS k
    FROM refs r JOIN (SELECT DISTINCT nid, s, e FROM domains) d ON d.nid = r.nid WHERE least(d.e, r.e) - greatest(d.s, r.s) > 0) x WHERE k = 1""",
)
def boundaries(spark: SparkSession, d: str) -> DataFrame:
    return iv.best_overlap(view(spark, d, "refs"), view(spark, d, "domains"))


_CC = """WITH RECURSIVE sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach(node, other) AS (SELECT a, a FROM sym UNION SELECT r.node, s.b FROM reach r JOIN sym s ON s.a = r.other)
    SELECT node, min(other) AS component FROM reach GROUP BY node"""


def _recursive(sql: str) -> str:
    return with_views(sql.replace("WITH RECURSIVE", "WITH", 1)).replace("WITH ", "WITH RECURSIVE ", 1)


@query("GRF-01")
def connected(spark: SparkSession, d: str) -> DataFrame:
    return components(view(spark, d, "edges"))


ORACLES["GRF-01"] = _recursive(_CC)


@query("GRF-06")
def named_components(spark: SparkSession, d: str) -> DataFrame:
    """Components as numbered families; one row per component meets the numbering."""
    label = components(view(spark, d, "edges"))
    names = label.groupBy("component").agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    return label.join(names.withColumn("family", F.format_string("DF%06d", F.row_number().over(W.orderBy("component")))), "component").select("node", "family", "n")


ORACLES["GRF-06"] = _recursive(_CC.replace("SELECT node, min(other) AS component FROM reach GROUP BY node", """, c AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
    f AS (SELECT component, count(*) AS n, row_number() OVER (ORDER BY component) AS k FROM c GROUP BY component)
    SELECT c.node, printf('DF%06d', f.k) AS family, f.n FROM c JOIN f ON f.component = c.component"""))


@query("GRF-07")
def clusters(spark: SparkSession, d: str) -> DataFrame:
    """Components of the accepted links of enough aligned residues; tested against union-find."""
    accepted = view(spark, d, "tested").where("passed = '+' and naligned >= 49 and weight < 20000").select(F.col("q").alias("a"), (F.col("t") + 1_000_000).alias("b"))
    return components(accepted)


@query("GRF-04")
def forest(spark: SparkSession, d: str) -> DataFrame:
    """Minimum spanning forest; tested against Kruskal."""
    edges = view(spark, d, "tested").where("passed = '+' and naligned >= 49").select(F.col("q").alias("a"), (F.col("t") + 1_000_000).alias("b"), "weight")
    return spanning.spanning_forest(edges)


@query("GRF-13")
def shortest(spark: SparkSession, d: str) -> DataFrame:
    """Depths of all reachable nodes; tested on a chain, as a recursive statement does not end on cycles."""
    edges = view(spark, d, "edges")
    first = edges.agg(F.min("a")).first()[0]
    return spanning.distances(edges, first)


@query("SCL-01", "SELECT nid, substring(replace(replace(replace(to_base64(unhex(md5(sequence))), '/', '_'), '+', '['), '=', ']'), 1, 22) AS hid FROM sequences")
def hash_id(spark: SparkSession, d: str) -> DataFrame:
    """22 characters that tell sequences apart."""
    return view(spark, d, "sequences").select("nid", F.substring(F.translate(F.base64(F.unhex(F.md5("sequence"))), "/+=", "_[]"), 1, 22).alias("hid"))


@query("ALG-21")
def objective(spark: SparkSession, d: str) -> DataFrame:
    """Score of a link between two partitions: transferred and left-over residues, as negative logarithms."""
    pairs = view(spark, d, "links").join(view(spark, d, "domains"), F.col("nid") == F.col("query_nid"))
    transfer = iv.overlap("s", "e", "qs", "qe")
    tail = lambda x: F.exp(-0.05 * F.greatest(F.lit(0), x))
    keep = F.greatest(F.lit(1e-20), 1 - F.least(F.lit(0.999), transfer / 60.0))
    score = F.when(transfer <= 12, 0.0).otherwise(-F.log(keep) - F.log(tail(F.col("e") - F.col("s") - transfer)) - F.log(tail(F.col("qe") - F.col("qs") - transfer)))
    return pairs.select("query_nid", "sbjct_nid", "qs", "s", "family", F.round(score, 6).alias("score"))


ORACLES["ALG-21"] = with_views("""SELECT query_nid, sbjct_nid, qs, s, family, round(CASE WHEN t <= 12 THEN 0.0 ELSE -ln(greatest(1e-20, 1 - least(0.999, t / 60.0))) + 0.05 * greatest(0, e - s - t) + 0.05 * greatest(0, qe - qs - t) END, 6) AS score
    FROM (SELECT l.*, d.s, d.e, d.family, least(d.e, l.qe) - greatest(d.s, l.qs) AS t FROM links l JOIN domains d ON d.nid = l.query_nid) x""")

for _part in (aligned, mapped, files, tables, rules):
    QUERIES.update(_part.QUERIES)
    ORACLES.update(_part.ORACLES)
