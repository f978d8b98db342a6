"""Relational operators as SQL that Spark and DuckDB both run over the views; keys are the inventory's ids.

Every statement aliases its columns, has an equal key in every join of large inputs, and leaves interval
conditions as residuals of that key. Order is part of the result only where a rank column says so."""

from __future__ import annotations

OV = "least({0}e, {1}e) - greatest({0}s, {1}s)"
D_R = OV.format("d.", "r.")

SQL: dict[str, str] = {
    # ---- sources as the pipeline reads them ----
    "SRC-07": "SELECT nid, CAST(length(sequence) AS BIGINT) AS length FROM sequences",
    "SRC-11": "SELECT query_nid, sbjct_nid, qs - 1 AS qs, qe, ss - 1 AS ss, se FROM links",
    "SRC-15": "SELECT l.query_nid, l.sbjct_nid, l.evalue, l.qs, l.qe, l.ss, l.se FROM links l JOIN part p ON l.query_nid = p.p_partkey JOIN supplier t ON l.sbjct_nid = t.s_suppkey WHERE l.qs < l.qe AND l.ss < l.se",
    "SRC-16": "SELECT query_nid, count(*) AS neighbours, count(DISTINCT sbjct_nid) AS partners, min(evalue) AS best FROM links GROUP BY query_nid",
    "SRC-19": "SELECT sbjct_nid, qs, qe, ss, se, evalue FROM links WHERE query_nid = 7",
    "SRC-21": "SELECT query_nid, sbjct_nid, qs, qe FROM links WHERE query_nid <> sbjct_nid",
    "SRC-27": "SELECT pid, min(nid) AS nid FROM sequences GROUP BY pid",
    "SRC-29": "SELECT d.nid, d.family, count(*) AS n, min(d.s) AS first_start, max(d.e) AS last_end FROM domains d JOIN lengths l ON d.nid = l.nid WHERE d.family LIKE '%F' GROUP BY d.nid, d.family",
    "SRC-30": "SELECT q, t, weight, passed, naligned FROM tested",
    "SRC-52": "SELECT tax_id, name FROM taxa",
    "SRC-53": "SELECT family, count(DISTINCT nid) AS members, min(nid) AS first_nid, max(nid) AS last_nid FROM units GROUP BY family",
    "SRC-58": "SELECT a AS i, b AS j FROM edges UNION SELECT b AS i, a AS j FROM edges",
    # ---- projections, filters, id translation ----
    "PRJ-01": """SELECT row_number() OVER (ORDER BY nid) AS new_nid, nid, pid, length FROM (SELECT nid, pid, length, row_number() OVER (PARTITION BY md5(sequence) ORDER BY nid) AS k
        FROM sequences WHERE length <= 10000) x WHERE k = 1""",
    "PRJ-02": "SELECT concat(p.p_name, '_', CAST(d.s AS VARCHAR(20)), '_', CAST(d.e AS VARCHAR(20))) AS token, d.family FROM domains d JOIN part p ON d.nid = p.p_partkey",
    "PRJ-04": "SELECT e.a, e.b FROM edges e WHERE e.a IN (SELECT nid FROM known) AND e.b IN (SELECT nid FROM known)",
    "PRJ-05": "SELECT e.a, e.b FROM edges e LEFT JOIN (SELECT DISTINCT nid FROM known) x ON e.a = x.nid LEFT JOIN (SELECT DISTINCT nid FROM known) y ON e.b = y.nid WHERE x.nid IS NOT NULL OR y.nid IS NOT NULL",
    "PRJ-06": "SELECT s.nid, length(s.sequence) AS length, substring(s.sequence, 11, 40) AS slice FROM sequences s WHERE length(s.sequence) BETWEEN 60 AND 4000 AND s.nid IN (SELECT nid FROM known)",
    "PRJ-12": "SELECT t.tax_id, t.name, k.kingdom FROM taxa t LEFT JOIN kingdoms k ON t.node_id BETWEEN k.min_node_id AND k.node_id",
    "PRJ-14": "SELECT family, dense_rank() OVER (ORDER BY family) % 7 AS colour FROM (SELECT DISTINCT family FROM domains) x",
    "PRJ-23": "SELECT DISTINCT sbjct_nid AS neighbour FROM links WHERE query_nid = 11",
    # ---- joins ----
    "JOI-08": f"SELECT DISTINCT d.family AS family, r.family AS other FROM domains d JOIN domains r ON d.nid = r.nid WHERE {D_R} > 0 AND d.family <> r.family",
    "JOI-09": f"SELECT DISTINCT d.family AS family, r.family AS other FROM domains d JOIN domains r ON d.nid = r.nid WHERE {D_R} <= 0 AND d.family <> r.family",
    "JOI-10": f"SELECT d.nid, d.s AS s1, d.e AS e1, r.s AS s2, r.e AS e2 FROM domains d JOIN domains r ON d.nid = r.nid WHERE d.family = 'AF' AND r.family = 'RF' AND {D_R} < 0",
    "JOI-11": "SELECT nid, s, e FROM domains WHERE family = 'AF' AND least(e, 60) - greatest(s, 40) < 0",
    "JOI-12": "SELECT DISTINCT u.family, l.sbjct_nid FROM units u JOIN links l ON u.nid = l.query_nid WHERE least(u.e, l.qe) - greatest(u.s, l.qs) > 0 AND l.sbjct_nid NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)",
    "JOI-16": """SELECT least(d.family, r.family) AS family1, greatest(d.family, r.family) AS family2, count(*) AS nlinks, min(l.evalue) AS best FROM links l
        JOIN domains d ON d.nid = l.query_nid JOIN domains r ON r.nid = l.sbjct_nid WHERE d.family <> r.family GROUP BY least(d.family, r.family), greatest(d.family, r.family)""",
    "JOI-18": "SELECT d.nid, d.s, d.e, d.family FROM domains d LEFT JOIN lengths l ON d.nid = l.nid WHERE l.length IS NULL OR d.e <= l.length - 240",
    "JOI-19": "SELECT d.nid, d.s, d.e FROM domains d JOIN lengths l ON d.nid = l.nid WHERE d.s <= l.length - 300",
    "JOI-21": """SELECT nid, count(*) AS n, sum(e - s) AS residues, sum(CASE WHEN s > previous THEN s - previous ELSE 0 END) AS gap_residues FROM (
        SELECT nid, s, e, lag(e) OVER (PARTITION BY nid ORDER BY s, e) AS previous FROM domains) x GROUP BY nid""",
    "JOI-22": "SELECT DISTINCT family FROM units WHERE family NOT IN (SELECT concat('F', CAST(s_suppkey AS VARCHAR(20))) FROM supplier WHERE s_acctbal > 0)",
    "JOI-23": "SELECT s_suppkey, s_name FROM supplier WHERE concat('F', CAST(s_suppkey AS VARCHAR(20))) IN (SELECT family FROM units)",
    "JOI-24": "SELECT d.nid, d.s, d.e, d.family FROM domains d WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = d.nid AND o.o_orderstatus = 'F')",
    "JOI-25": "SELECT l.nid FROM lengths l WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.nid = l.nid)",
    "JOI-26": "SELECT k.nid, s.length FROM (SELECT DISTINCT nid FROM known) k JOIN sequences s ON k.nid = s.nid WHERE s.length > 1500",
    "JOI-27": "SELECT k.nid, s.pid, s.sequence FROM (SELECT DISTINCT nid FROM known) k JOIN sequences s ON k.nid = s.nid",
    "JOI-28": "SELECT l.nid, CASE WHEN k.nid IS NULL THEN 0 ELSE 100 END AS filter_level FROM lengths l LEFT JOIN (SELECT DISTINCT nid FROM known) k ON l.nid = k.nid",
    "JOI-29": "SELECT l.nid FROM lengths l WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.nid = l.nid) AND NOT EXISTS (SELECT 1 FROM masks m WHERE m.nid = l.nid AND m.method = 2)",
    "JOI-30": f"SELECT d.nid, d.family, r.family AS reference, d.s, d.e, r.s AS rs, r.e AS re, {D_R} AS common FROM domains d JOIN refs r ON d.nid = r.nid WHERE {D_R} > 5",
    "JOI-31": """WITH c AS (SELECT nid, family, count(*) AS n FROM units GROUP BY nid, family)
        SELECT a.nid AS nid1, b.nid AS nid2, a.family, a.n * b.n AS n FROM c a JOIN c b ON a.family = b.family AND a.nid < b.nid""",
    "JOI-37": "SELECT nid, first_nid, CASE WHEN nid = first_nid THEN 'new' ELSE 'duplicate' END AS kind FROM (SELECT nid, min(nid) OVER (PARTITION BY md5(sequence)) AS first_nid FROM sequences) x",
    "JOI-38": "SELECT l.nid FROM lengths l LEFT JOIN (SELECT DISTINCT query_nid FROM links) q ON l.nid = q.query_nid WHERE q.query_nid IS NULL",
    "JOI-41": "SELECT count(*) AS nlinks, sum(CASE WHEN query_nid = sbjct_nid THEN 1 ELSE 0 END) AS self_links, count(DISTINCT query_nid) AS queries, count(DISTINCT sbjct_nid) AS sbjcts FROM links",
    # ---- aggregations ----
    "AGG-01": """SELECT family, query_nid, sbjct_nid, CAST(round(avg(transfer)) AS BIGINT) AS transfer, CAST(floor(avg(overhang)) AS BIGINT) AS overhang FROM (
        SELECT d.family, l.query_nid, l.sbjct_nid, least(d.e, l.qe) - greatest(d.s, l.qs) AS transfer, abs(d.s - l.qs) + abs(d.e - l.qe) AS overhang
        FROM links l JOIN domains d ON d.nid = l.query_nid WHERE least(d.e, l.qe) - greatest(d.s, l.qs) >= 10) x GROUP BY family, query_nid, sbjct_nid""",
    "AGG-02": """SELECT family, count(*) AS nunits, count(DISTINCT nid) AS nsequences, sum(e - s) AS nresidues, round(avg(e - s), 6) AS length,
        round(median(e - s), 6) AS length_median, round(stddev_pop(e - s), 6) AS length_stddev FROM domains GROUP BY family""",
    "AGG-03": "SELECT l.nid, CAST(coalesce(n, 0) AS BIGINT) AS neighbours, l.length FROM lengths l LEFT JOIN (SELECT query_nid, count(*) AS n FROM links GROUP BY query_nid) q ON l.nid = q.query_nid",
    "AGG-04": "SELECT count(DISTINCT nid) AS nids FROM sequences",
    "AGG-05": "SELECT count(*) AS segments, count(DISTINCT d.nid) AS nids, round(100e0 * count(DISTINCT d.nid) / max(t.n), 6) AS percent FROM domains d CROSS JOIN (SELECT count(*) AS n FROM lengths) t",
    "AGG-06": "SELECT count(*) AS rows_, count(DISTINCT family) AS families, count(DISTINCT nid) AS nids FROM units",
    "AGG-10": "SELECT count(*) AS nlinks, (SELECT count(DISTINCT n) FROM (SELECT a AS n FROM edges UNION ALL SELECT b FROM edges) x) AS nodes FROM edges",
    "AGG-13": "SELECT count(*) AS total, sum(CASE WHEN passed = '+' THEN 1 ELSE 0 END) AS accepted, sum(CASE WHEN passed <> '+' THEN 1 ELSE 0 END) AS rejected FROM tested",
    "AGG-14": "SELECT 'domains' AS step, count(*) AS n FROM domains UNION ALL SELECT 'links', count(*) FROM links UNION ALL SELECT 'tested', count(*) FROM tested",
    "AGG-15": """SELECT l.nid, l.length, CAST(coalesce(ndomains, 0) AS BIGINT) AS ndomains, CAST(coalesce(nfamilies, 0) AS BIGINT) AS nfamilies, CAST(coalesce(residues, 0) AS BIGINT) AS residues,
        round(100e0 * coalesce(residues, 0) / l.length, 6) AS coverage FROM lengths l
        LEFT JOIN (SELECT nid, count(*) AS ndomains, count(DISTINCT family) AS nfamilies, sum(e - s) AS residues FROM domains GROUP BY nid) d ON l.nid = d.nid""",
    "AGG-16": "SELECT family, count(*) AS n FROM units GROUP BY family",
    "AGG-17": """SELECT 'mapped' AS kind, count(*) AS rows_, count(DISTINCT nid) AS nids, count(DISTINCT family) AS families FROM domains
        UNION ALL SELECT 'direct', count(*), count(DISTINCT nid), count(DISTINCT family) FROM units UNION ALL SELECT 'reference', count(*), count(DISTINCT nid), count(DISTINCT family) FROM refs""",
    "AGG-18": "SELECT bin, sum(n) AS n FROM (SELECT e - s AS bin, count(*) AS n FROM domains GROUP BY e - s UNION ALL SELECT e - s, count(*) FROM refs GROUP BY e - s) x GROUP BY bin",
    "AGG-19": "SELECT substring(family, 1, 1) AS prefix, count(DISTINCT nid) AS nsequences, count(*) AS nunits, sum(e - s) AS nresidues FROM domains GROUP BY substring(family, 1, 1)",
    "AGG-20": "SELECT family, count(DISTINCT nid) AS nsequences, count(*) AS nunits, sum(e - s + 1) AS nresidues FROM domains GROUP BY family",
    "AGG-22": "SELECT nid, count(*) AS n, count(DISTINCT family) AS classes FROM domains GROUP BY nid",
    "AGG-23": "SELECT coalesce(max(family), '0') AS family FROM units",
    "AGG-24": "SELECT family, sum(e - s) * count(*) AS weight, row_number() OVER (ORDER BY sum(e - s) * count(*) DESC, family) AS position FROM units GROUP BY family",
    "AGG-25": "SELECT sum(e - s) AS residues FROM domains WHERE family = 'NO'",
    "AGG-26": "SELECT family, count(DISTINCT nid) AS nsequences FROM units GROUP BY family",
    "AGG-29": "SELECT d.family, count(*) AS n, round(avg(d.e - d.s), 6) AS length, count(DISTINCT d.nid) AS nids FROM domains d JOIN orders o ON o.o_orderkey = d.nid WHERE o.o_orderpriority = '1-URGENT' GROUP BY d.family",
    "AGG-31": "SELECT family, min(s) AS first_start, max(e) AS last_end FROM units GROUP BY family",
    "AGG-32": "SELECT family, max(s) AS last_start, min(e) AS first_end FROM units GROUP BY family",
    "AGG-33": "SELECT nid, s, e, lead(s) OVER (PARTITION BY nid ORDER BY s, e, family) - e AS to_next, s - lag(e) OVER (PARTITION BY nid ORDER BY s, e, family) AS to_previous FROM domains",
    "AGG-34": "SELECT nid, s, e, min(family) AS family FROM domains GROUP BY nid, s, e",
    "AGG-37": "SELECT sum(length) AS total FROM sequences WHERE length BETWEEN 100 AND 5000",
    "AGG-38": "SELECT count(DISTINCT nid) AS n, sum(length) AS total FROM sequences",
    "AGG-39": "SELECT max(nid) AS nid FROM sequences",
    "AGG-41": "SELECT sum(l.length) AS total FROM lengths l JOIN (SELECT DISTINCT nid FROM known) k ON l.nid = k.nid",
    "AGG-43": "SELECT min(weight) AS lo, max(weight) AS hi, round(avg(weight), 4) AS mean, round(stddev_pop(weight), 3) AS sd FROM tested",
    "AGG-45": "SELECT family, count(*) AS n FROM domains GROUP BY family",
    "AGG-46": """SELECT least(x.name, y.name) AS class1, greatest(x.name, y.name) AS class2, count(*) AS n FROM edges e JOIN assigned p ON p.nid = e.a JOIN assigned q ON q.nid = e.b
        JOIN taxa x ON x.tax_id = p.tax_id JOIN taxa y ON y.tax_id = q.tax_id GROUP BY least(x.name, y.name), greatest(x.name, y.name)""",
    "AGG-48": f"""SELECT reference, max(share) AS best FROM (SELECT r.family AS reference, d.family, round(1e0 * count(*) / max(t.n), 6) AS share FROM domains d JOIN refs r ON d.nid = r.nid
        JOIN (SELECT family, count(*) AS n FROM refs GROUP BY family) t ON t.family = r.family WHERE {D_R} > 0 GROUP BY r.family, d.family) x GROUP BY reference""",
    # ---- windows ----
    "WIN-06": "SELECT nid, s, e, family, lead(s) OVER (PARTITION BY nid, family ORDER BY s, e) AS next_start, lag(s) OVER (PARTITION BY nid, family ORDER BY s, e) AS previous_start FROM domains",
    "WIN-07": "SELECT nid, s, e, count(*) OVER (PARTITION BY nid ORDER BY s RANGE BETWEEN 1 FOLLOWING AND 40 FOLLOWING) AS contacts FROM domains",
    "WIN-10": "SELECT family, row_number() OVER (ORDER BY family) AS number FROM (SELECT DISTINCT family FROM units) x",
    "WIN-12": "SELECT bin, n, sum(n) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) AS up, sum(n) OVER (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING) AS down FROM (SELECT e - s AS bin, count(*) AS n FROM domains GROUP BY e - s) x",
    "WIN-14": "SELECT CAST(floor((k - 1) / 5) AS BIGINT) AS label, sum(n) AS n, avg(bin) AS bin FROM (SELECT bin, n, row_number() OVER (ORDER BY bin) AS k FROM (SELECT e - s AS bin, count(*) AS n FROM domains GROUP BY e - s) x) y GROUP BY CAST(floor((k - 1) / 5) AS BIGINT)",
    "WIN-16": """SELECT bin, n, round(1e0 * n / sum(n) OVER (), 8) AS frequency, sum(n) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) AS up,
        round(100e0 * sum(n) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS up_percent, sum(n) OVER (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING) AS down
        FROM (SELECT e - s AS bin, count(*) AS n FROM refs GROUP BY e - s) x""",
    "WIN-17": """SELECT bin, round(1e0 * down / max(down) OVER (), 8) AS share FROM (SELECT bin, sum(n) OVER (ORDER BY bin DESC ROWS UNBOUNDED PRECEDING) AS down
        FROM (SELECT e - s AS bin, count(*) AS n FROM domains GROUP BY e - s) x) y""",
    "WIN-20": """SELECT value, max(tp) AS tp, max(fp) AS fp FROM (SELECT value, sum(hit) OVER (ORDER BY value DESC, id ROWS UNBOUNDED PRECEDING) AS tp,
        sum(1 - hit) OVER (ORDER BY value DESC, id ROWS UNBOUNDED PRECEDING) AS fp FROM scored) x GROUP BY value""",
    "WIN-21": """SELECT id, round(1e0 * tp / n, 8) AS precision_, round(1e0 * tp / total, 8) AS recall FROM (SELECT id, sum(hit) OVER w AS tp, count(*) OVER w AS n, sum(hit) OVER () AS total
        FROM scored WINDOW w AS (ORDER BY value DESC, id ROWS UNBOUNDED PRECEDING)) x""",
    "WIN-23": "SELECT round(sum((x - lag_x) * (y + lag_y) / 2e0), 4) AS area FROM (SELECT x, y, lag(x) OVER (ORDER BY x) AS lag_x, lag(y) OVER (ORDER BY x) AS lag_y FROM (SELECT e - s AS x, count(*) AS y FROM domains GROUP BY e - s) p) q",
    "WIN-24": """SELECT family, nunits, round(1e0 * sum(known_) OVER w / count(*) OVER w, 8) AS fraction FROM (SELECT u.family, count(*) AS nunits, max(CASE WHEN k.nid IS NULL THEN 0 ELSE 1 END) AS known_
        FROM units u LEFT JOIN (SELECT DISTINCT nid FROM known) k ON u.nid = k.nid GROUP BY u.family) x WINDOW w AS (ORDER BY nunits DESC, family ROWS UNBOUNDED PRECEDING)""",
    # ---- sorts ----
    "SRT-01": "SELECT q, t, weight, row_number() OVER (ORDER BY weight, q, t, naligned, passed) AS position FROM tested",
    "SRT-04": "SELECT nid, e - s AS length, row_number() OVER (ORDER BY e - s DESC, nid, s) AS position FROM domains WHERE family = 'AF'",
    "SRT-05": "SELECT family, length, rank() OVER (ORDER BY length DESC) AS position FROM (SELECT family, sum(e - s) AS length FROM units GROUP BY family) x",
    "SRT-06": "SELECT nid, length, row_number() OVER (ORDER BY length DESC, nid) AS position FROM sequences WHERE length > 200",
    "SRT-07": "SELECT nid, length FROM sequences WHERE length > 500 ORDER BY nid LIMIT 100",
    # ---- sets ----
    "SET-01": """SELECT count(x.nid) AS n1, count(y.nid) AS n2, count(*) AS both_, sum(CASE WHEN x.nid IS NOT NULL AND y.nid IS NOT NULL THEN 1 ELSE 0 END) AS inter,
        sum(CASE WHEN y.nid IS NULL THEN 1 ELSE 0 END) AS unique1, sum(CASE WHEN x.nid IS NULL THEN 1 ELSE 0 END) AS unique2
        FROM (SELECT DISTINCT nid FROM units) x FULL OUTER JOIN (SELECT DISTINCT nid FROM known) y ON x.nid = y.nid""",
    "SET-03": "SELECT nid, s, e, family FROM domains UNION ALL SELECT nid, s, e, family FROM units UNION ALL SELECT nid, s, e, family FROM refs",
    "SET-04": """SELECT coalesce(x.bin, y.bin) AS bin, coalesce(x.n, 0) AS n1, coalesce(y.n, 0) AS n2 FROM (SELECT e - s AS bin, count(*) AS n FROM domains GROUP BY e - s) x
        FULL OUTER JOIN (SELECT e - s + 7 AS bin, count(*) AS n FROM refs GROUP BY e - s + 7) y ON x.bin = y.bin""",
    "SET-06": "SELECT DISTINCT nid, family FROM domains",
    "SET-07": "SELECT query_nid AS nid, 'unknown' AS problem FROM (SELECT query_nid FROM links EXCEPT SELECT nid FROM lengths) x UNION ALL SELECT nid, 'missing' FROM (SELECT nid FROM lengths EXCEPT SELECT query_nid FROM links) y",
    "SET-10": "SELECT query_nid % 50 AS chunk, count(DISTINCT query_nid) AS found, min(query_nid) AS first_nid, max(query_nid) AS last_nid FROM links GROUP BY query_nid % 50",
    # ---- graph expressions ----
    "GRF-09": "SELECT query_nid, sbjct_nid, qs, CASE WHEN evalue > -5 THEN 200 ELSE 100 END - 100 * round(1e0 * (least(qe, se) - greatest(qs, ss)) / (greatest(qe, se) - least(qs, ss)), 6) AS weight FROM links WHERE least(qe, se) > greatest(qs, ss)",
    "GRF-14": "SELECT e.a, e.b, coalesce(x.family, 'na') AS family_a, coalesce(y.family, 'na') AS family_b FROM edges e LEFT JOIN (SELECT nid, min(family) AS family FROM domains GROUP BY nid) x ON e.a = x.nid LEFT JOIN (SELECT nid, min(family) AS family FROM domains GROUP BY nid) y ON e.b = y.nid",
    "GRF-16": "SELECT a.family AS family1, b.family AS family2, count(DISTINCT a.nid) AS weight FROM domains a JOIN domains b ON a.nid = b.nid AND a.family < b.family GROUP BY a.family, b.family",
    # ---- histograms and statistics ----
    "HST-01": "SELECT CAST(floor((e - s) / 10) * 10 AS BIGINT) AS bin, count(*) AS n FROM domains GROUP BY CAST(floor((e - s) / 10) * 10 AS BIGINT)",
    "HST-02": "SELECT CAST(ceil((e - s) / 8e0) * 8 AS BIGINT) AS bin, count(*) AS n FROM domains WHERE e - s BETWEEN 1 AND 40 GROUP BY CAST(ceil((e - s) / 8e0) * 8 AS BIGINT)",
    "HST-03": "SELECT least(19, CAST(floor((weight - lo) / ((hi - lo) / 20)) AS INT)) AS bin, count(*) AS n FROM tested CROSS JOIN (SELECT min(weight) AS lo, max(weight) AS hi FROM tested) m GROUP BY least(19, CAST(floor((weight - lo) / ((hi - lo) / 20)) AS INT))",
    "HST-06": "SELECT bin, round(1e0 * n / sum(n) OVER (), 8) AS share FROM (SELECT e - s AS bin, count(*) AS n FROM refs GROUP BY e - s) x",
    "HST-07": "SELECT bin, round(1e0 * n / max(n) OVER (), 8) AS share FROM (SELECT e - s AS bin, count(*) AS n FROM refs GROUP BY e - s) x",
    "HST-08": "SELECT qs AS value, count(*) AS n FROM links GROUP BY qs",
    "HST-10": "SELECT bin, sum(CASE WHEN k = 'd' THEN 1 ELSE 0 END) AS domains_, sum(CASE WHEN k = 'r' THEN 1 ELSE 0 END) AS refs_ FROM (SELECT 'd' AS k, s % 50 AS bin FROM domains UNION ALL SELECT 'r', s % 50 FROM refs) x GROUP BY bin",
    "HST-17": "SELECT family, count(*) AS n, min(e - s) AS lo, max(e - s) AS hi, round(avg(e - s), 6) AS mean, median(e - s) AS median_, round(stddev_pop(e - s), 6) AS sd, sum(e - s) AS total FROM domains GROUP BY family",
    "HST-19": "SELECT id, CASE WHEN p <= 0.001 THEN '***' WHEN p <= 0.01 THEN '**' WHEN p <= 0.05 THEN '*' ELSE '' END AS stars FROM pvalues",
    "HST-24": "SELECT round(corr(qs, ss), 6) AS r, count(*) AS n FROM links",
    "HST-25": "SELECT round(sum((n - 1) * v) / (sum(n) - count(*)), 6) AS pooled FROM (SELECT family, count(*) AS n, var_samp(e - s) AS v FROM domains GROUP BY family) x",
    "HST-26": "SELECT round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t, count(*) - 1 AS df FROM (SELECT qs - ss AS d FROM links) x",
    "HST-29": "SELECT id, round(min(least(1e0, p * m / k)) OVER (ORDER BY k DESC ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM (SELECT id, p, count(*) OVER () AS m, row_number() OVER (ORDER BY p, id) AS k FROM pvalues) x",
    "HST-30": "SELECT lam, round(avg(CASE WHEN p >= lam THEN 1e0 ELSE 0e0 END) / (1 - lam), 8) AS pi0 FROM pvalues CROSS JOIN (SELECT CAST(0.1 AS DOUBLE) * n_regionkey AS lam FROM (SELECT DISTINCT n_regionkey FROM nation) y) x GROUP BY lam",
    # ---- scalars ----
    "SCL-04": "SELECT CAST(split_part(t, '_', 1) AS BIGINT) AS nid, CAST(split_part(t, '_', 2) AS INT) AS s, CAST(split_part(t, '_', 3) AS INT) AS e FROM (SELECT concat(CAST(nid AS VARCHAR(20)), '_', CAST(s AS VARCHAR(20)), '_', CAST(e AS VARCHAR(20))) AS t FROM domains) x",
    "SCL-05": "SELECT concat_ws('_', CAST(nid AS VARCHAR(20)), CAST(s AS VARCHAR(20)), CAST(e AS VARCHAR(20))) AS token, family FROM domains",
    "SCL-06": "SELECT concat('.', lpad(CAST(nid AS VARCHAR(20)), 10, '0'), '.', lpad(CAST(length AS VARCHAR(20)), 10, '0')) AS slice FROM lengths",
    "SCL-08": "SELECT nid, s AS zero_s, e AS zero_e, s + 1 AS one_s, e AS one_e, 400 - e AS reverse_s, 400 - s AS reverse_e FROM domains",
    "SCL-11": "SELECT l.nid, coalesce(x.family, 'na') AS family FROM lengths l LEFT JOIN (SELECT nid, max(family) AS family FROM refs WHERE e - s > 30 GROUP BY nid) x ON l.nid = x.nid",
    # ---- tables and accessors ----
    "TBL-24": "SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS found FROM units WHERE nid = 5 AND family = 'F3'",
    "TBL-26": "SELECT s, e, family FROM domains WHERE nid = 32 AND least(e, 200) - greatest(s, 30) > 0",
    "TBL-27": "SELECT s, e FROM domains WHERE nid = 32 AND family = 'NO'",
    "TBL-29": "SELECT DISTINCT family FROM refs",
    "TBL-30": "SELECT DISTINCT nid FROM refs",
    "TBL-31": "SELECT DISTINCT nid FROM domains WHERE family = 'RF'",
    "TBL-32": "SELECT DISTINCT family FROM domains WHERE nid = 7 AND least(e, 100) - greatest(s, 10) > 0",
    "TBL-34": "SELECT nid, s, e, family FROM domains WHERE e - s >= 12",
    "TBL-35": "SELECT nid, s, e, family FROM domains WHERE nid <> 7",
    "TBL-37": "SELECT nid, s, e, concat('G', CAST(CAST(substring(family, 2, 9) AS INT) + 1000 AS VARCHAR(20))) AS family FROM units WHERE nid IN (SELECT nid FROM known)",
    "TBL-45": "SELECT nid, s, e, CASE WHEN family = 'AF' THEN 'ZZ' ELSE family END AS family FROM domains",
    "TBL-46": "SELECT nid, s, e, family FROM domains WHERE family <> 'AF'",
    "TBL-47": "SELECT nid, s, e, family FROM domains WHERE family IN ('AF', 'RF')",
    "TBL-58": "SELECT u.family, s.s_name AS description FROM (SELECT DISTINCT family FROM units) u LEFT JOIN supplier s ON u.family = concat('F', CAST(s.s_suppkey AS VARCHAR(20)))",
    "TBL-59": "SELECT nid, md5(sequence) AS hash FROM sequences WHERE md5(sequence) IN (SELECT md5(text) FROM documents WHERE doc_id = 10)",
    "TBL-60": "SELECT l.nid, CASE WHEN k.nid IS NOT NULL THEN 90 ELSE 100 END AS level FROM lengths l LEFT JOIN (SELECT DISTINCT nid FROM known) k ON k.nid = l.nid",
    "TBL-62": "SELECT nid FROM sequences WHERE sequence LIKE '%the%'",
    "TBL-65": "SELECT nid FROM sequences WHERE sequence LIKE '%the%' AND sequence NOT LIKE '%token%'",
    # ---- reports ----
    "RPT-02": "SELECT size, count(*) AS families FROM (SELECT family, count(*) AS size FROM refs GROUP BY family) x GROUP BY size",
    "RPT-03": "SELECT e - s AS length, count(*) AS n FROM refs GROUP BY e - s",
    "RPT-04": """SELECT count(DISTINCT nid) AS nnids, count(*) AS ndom, count(DISTINCT family) AS nfam, (SELECT count(*) FROM (SELECT family FROM units GROUP BY family HAVING count(*) <= 1) x) AS singletons,
        (SELECT max(n) FROM (SELECT count(*) AS n FROM units GROUP BY family) y) AS max_units FROM units""",
    "RPT-05": "SELECT n, count(*) AS nids FROM (SELECT nid, count(*) AS n FROM domains GROUP BY nid) x GROUP BY n",
    "RPT-06": f"SELECT d.family, count(*) AS n, count(DISTINCT concat(CAST(d.nid AS VARCHAR(20)), '_', CAST(d.s AS VARCHAR(20)))) AS units, round(avg({D_R}), 6) AS common, round(avg(1e0 * ({D_R}) / (d.e - d.s)), 6) AS coverage FROM domains d JOIN refs r ON d.nid = r.nid WHERE {D_R} > 0 GROUP BY d.family",
    "RPT-07": f"SELECT d.family, r.family AS reference, count(DISTINCT d.nid) AS evidence FROM domains d JOIN refs r ON d.nid = r.nid WHERE {D_R} > 0 GROUP BY d.family, r.family HAVING count(DISTINCT d.nid) >= 5",
    "RPT-08": f"""SELECT x.family, x.reference, aunits, runits, tunits, round(1e0 * aunits / nunits, 6) AS selectivity, round(1e0 * runits / tunits, 6) AS sensitivity FROM (
        SELECT d.family, r.family AS reference, count(DISTINCT concat(CAST(d.nid AS VARCHAR(20)), '_', CAST(d.s AS VARCHAR(20)))) AS aunits, count(DISTINCT concat(CAST(r.nid AS VARCHAR(20)), '_', CAST(r.s AS VARCHAR(20)))) AS runits
        FROM domains d JOIN refs r ON d.nid = r.nid WHERE {D_R} > 0 GROUP BY d.family, r.family) x
        JOIN (SELECT family, count(*) AS nunits FROM domains GROUP BY family) u ON u.family = x.family JOIN (SELECT family, count(*) AS tunits FROM refs GROUP BY family) t ON t.family = x.reference""",
    "RPT-09": f"SELECT d.family, r.family AS reference, count(*) AS n FROM domains d JOIN refs r ON d.nid = r.nid WHERE {D_R} < 0 GROUP BY d.family, r.family",
    "RPT-10": f"""SELECT d.family, sum(CASE WHEN r.method = 0 THEN {D_R} ELSE 0 END) AS m0, sum(CASE WHEN r.method = 1 THEN {D_R} ELSE 0 END) AS m1,
        sum(CASE WHEN r.method = 2 THEN {D_R} ELSE 0 END) AS m2, count(DISTINCT d.nid) AS nids FROM domains d JOIN masks r ON d.nid = r.nid WHERE {D_R} > 0 GROUP BY d.family""",
    "RPT-12": "SELECT CAST(ceil((e - s) / 10e0) * 10 AS BIGINT) AS bin, count(*) AS n, sum(CASE WHEN family LIKE 'A%' THEN 1 ELSE 0 END) AS a_units FROM domains GROUP BY CAST(ceil((e - s) / 10e0) * 10 AS BIGINT)",
    "RPT-14": "SELECT family, count(DISTINCT nid) AS nseqs, count(*) AS nunits, sum(e - s) AS total, round(avg(e - s), 6) AS mean FROM units GROUP BY family",
    "RPT-16": """SELECT d.family, k.kingdom, count(DISTINCT a.tax_id) AS species, count(DISTINCT d.nid) AS nsequences FROM domains d JOIN assigned a ON a.nid = d.nid
        JOIN taxa t ON t.tax_id = a.tax_id JOIN kingdoms k ON t.node_id BETWEEN k.min_node_id AND k.node_id GROUP BY d.family, k.kingdom""",
    "RPT-17": """SELECT x.family AS family1, y.family AS family2, k.kingdom, count(DISTINCT x.nid) AS n FROM domains x JOIN domains y ON x.nid = y.nid AND x.family < y.family JOIN assigned a ON a.nid = x.nid
        JOIN taxa t ON t.tax_id = a.tax_id JOIN kingdoms k ON t.node_id BETWEEN k.min_node_id AND k.node_id GROUP BY x.family, y.family, k.kingdom""",
    "RPT-18": "SELECT n, count(*) AS nids, sum(CASE WHEN families > 1 THEN 1 ELSE 0 END) AS mixed FROM (SELECT nid, count(*) AS n, count(DISTINCT family) AS families FROM domains GROUP BY nid) x GROUP BY n",
    "RPT-20": "SELECT a.tax_id, count(DISTINCT d.nid) AS nsequences, count(*) AS nunits, count(DISTINCT d.family) AS nfamilies FROM domains d JOIN assigned a ON a.nid = d.nid GROUP BY a.tax_id",
    "RPT-23": "SELECT family, CASE WHEN share = 0 THEN 'unknown' WHEN share < 0.5 THEN 'extended' ELSE 'annotated' END AS state FROM (SELECT u.family, avg(CASE WHEN k.nid IS NULL THEN 0e0 ELSE 1e0 END) AS share FROM units u LEFT JOIN (SELECT DISTINCT nid FROM known) k ON k.nid = u.nid GROUP BY u.family) x",
    # ---- relational steps of the makefiles ----
    "MKF-01": """SELECT f1 FROM (SELECT x.family AS f1, x.nid, y.family AS partner FROM domains x JOIN domains y ON x.nid = y.nid AND x.family <> y.family) p
        GROUP BY f1 HAVING count(DISTINCT nid) >= 2 AND count(DISTINCT partner) >= 2""",
    "MKF-03": "SELECT a, b FROM edges UNION ALL SELECT b, a FROM edges",
    "MKF-05": "SELECT family, CASE WHEN n < 5 THEN 'unknown' WHEN n < 50 THEN 'extended' ELSE 'known' END AS state FROM (SELECT family, count(*) AS n FROM refs GROUP BY family) x",
    "MKF-06": """SELECT family, concat(CASE WHEN a > 2 THEN '1' ELSE '0' END, CASE WHEN b > 2 THEN '1' ELSE '0' END, CASE WHEN c > 2 THEN '1' ELSE '0' END) AS label FROM (SELECT u.family,
        sum(CASE WHEN n.n_regionkey = 0 THEN 1 ELSE 0 END) AS a, sum(CASE WHEN n.n_regionkey = 1 THEN 1 ELSE 0 END) AS b, sum(CASE WHEN n.n_regionkey = 2 THEN 1 ELSE 0 END) AS c
        FROM units u JOIN assigned g ON g.nid = u.nid JOIN nation n ON n.n_nationkey = g.tax_id GROUP BY u.family) x""",
    "MKF-08": "SELECT concat('>', CAST(s.nid AS VARCHAR(20)), '_', CAST(d.s AS VARCHAR(20)), ' ', d.family) AS title, substring(s.sequence, d.s + 1, d.e - d.s) AS slice FROM sequences s JOIN units d ON d.nid = s.nid",
    "MKF-10": "SELECT u.family, CAST(coalesce(x.nlinks, 0) AS BIGINT) AS nlinks FROM (SELECT DISTINCT family FROM domains) u LEFT JOIN (SELECT a.family, count(DISTINCT b.family) AS nlinks FROM domains a JOIN domains b ON a.nid = b.nid AND a.family <> b.family GROUP BY a.family) x ON x.family = u.family",
    "MKF-11": "SELECT nid FROM (SELECT DISTINCT nid, 1 AS k FROM domains UNION ALL SELECT DISTINCT nid, 2 FROM refs UNION ALL SELECT DISTINCT nid, 3 FROM known) x GROUP BY nid HAVING count(*) = 3",
    "MKF-17": f"""SELECT d.nid, d.s, d.e, d.family, coalesce(sum(CASE WHEN r.method = 0 THEN {D_R} END), 0) AS m0, coalesce(sum(CASE WHEN r.method = 1 THEN {D_R} END), 0) AS m1
        FROM (SELECT nid, s, e, min(family) AS family FROM domains GROUP BY nid, s, e) d LEFT JOIN masks r ON d.nid = r.nid AND {D_R} > 0 GROUP BY d.nid, d.s, d.e, d.family""",
    "MKF-18": "SELECT d.nid, d.s, d.e, count(DISTINCT l.sbjct_nid) AS neighbours FROM (SELECT DISTINCT nid, s, e FROM domains) d LEFT JOIN links l ON l.query_nid = d.nid AND l.sbjct_nid <> d.nid AND least(d.e, l.qe) - greatest(d.s, l.qs) > 0 GROUP BY d.nid, d.s, d.e",
    "MKF-19": f"SELECT DISTINCT d.nid, d.s, d.e, d.family FROM domains d JOIN refs r ON d.nid = r.nid WHERE r.family = 'Brand#13' AND {D_R} > 10",
    "MKF-21": "SELECT count(*) AS rows_, count(DISTINCT nid) AS nids, round(1e0 * count(*) / count(DISTINCT nid), 6) AS ratio, max(s) AS highest FROM domains",
    "MKF-23": "SELECT CAST(floor(transfer) AS BIGINT) AS bin, count(*) AS n FROM (SELECT least(d.e, l.qe) - greatest(d.s, l.qs) AS transfer FROM links l JOIN domains d ON d.nid = l.query_nid) x WHERE transfer >= 0 GROUP BY CAST(floor(transfer) AS BIGINT)",
    "MKF-25": "SELECT q, t, CAST(floor(weight) AS BIGINT) AS weight, row_number() OVER (ORDER BY weight, q, t, naligned, passed) AS position FROM tested WHERE passed = '+'",
    "MKF-26": "SELECT nid, s, e, family FROM domains WHERE e - s > 30",
}

#: Interval joins over links and domains at both ends.
SQL["JOI-01"] = """SELECT d.family, l.query_nid, l.sbjct_nid, least(least(d.e, l.qe) - greatest(d.s, l.qs), least(r.e, l.se) - greatest(r.s, l.ss)) AS transfer,
    abs(d.s - l.qs) + abs(d.e - l.qe) AS query_overhang, abs(r.s - l.ss) + abs(r.e - l.se) AS sbjct_overhang FROM links l JOIN domains d ON d.nid = l.query_nid
    JOIN domains r ON r.nid = l.sbjct_nid AND r.family = d.family WHERE l.query_nid <> l.sbjct_nid AND least(d.e, l.qe) - greatest(d.s, l.qs) >= 0 AND least(r.e, l.se) - greatest(r.s, l.ss) >= 0"""
SQL["JOI-02"] = """SELECT l.query_nid, l.sbjct_nid, d.s AS ds, d.e AS de, r.s AS rs, r.e AS re, least(d.e - l.qs + l.ss, r.e) - greatest(d.s - l.qs + l.ss, r.s) AS common,
    round(1e0 * (least(d.e - l.qs + l.ss, r.e) - greatest(d.s - l.qs + l.ss, r.s)) / (greatest(d.e - l.qs + l.ss, r.e) - least(d.s - l.qs + l.ss, r.s)), 6) AS relative
    FROM links l JOIN domains d ON d.nid = l.query_nid JOIN domains r ON r.nid = l.sbjct_nid
    WHERE least(d.e, l.qe) - greatest(d.s, l.qs) >= 10 AND least(d.e - l.qs + l.ss, r.e) - greatest(d.s - l.qs + l.ss, r.s) >= 10"""
SQL["JOI-13"] = """SELECT DISTINCT d.family AS family1, r.family AS family2 FROM links l JOIN domains d ON d.nid = l.query_nid JOIN units r ON r.nid = l.sbjct_nid
    WHERE least(d.e, l.qe) - greatest(d.s, l.qs) > 0 AND least(r.e, l.se) - greatest(r.s, l.ss) > 0
    UNION SELECT DISTINCT r.family, d.family FROM links l JOIN domains d ON d.nid = l.sbjct_nid JOIN units r ON r.nid = l.query_nid
    WHERE least(d.e, l.se) - greatest(d.s, l.ss) > 0 AND least(r.e, l.qe) - greatest(r.s, l.qs) > 0"""
SQL["JOI-14"] = "SELECT DISTINCT d.family AS family1, r.family AS family2 FROM links l JOIN domains d ON d.nid = l.query_nid JOIN units r ON r.nid = l.sbjct_nid"
SQL["JOI-05"] = """SELECT q, t, CASE WHEN x.family IS NULL OR y.family IS NULL THEN 'unknown' WHEN x.family = y.family THEN 'true' ELSE 'false' END AS kind, passed FROM tested
    LEFT JOIN (SELECT nid, min(family) AS family FROM refs GROUP BY nid) x ON x.nid = q LEFT JOIN (SELECT nid, min(family) AS family FROM refs GROUP BY nid) y ON y.nid = t"""
