"""Queries of the audit engine over summaries of the example tables, each with its SQL.

Detectors' queries return the statistics of every series or point with a flag, so that quiet data are compared too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers
from ..operators import across, detectors, reported
from . import tables as t

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


def r(c: str, n: int = 4):
    return F.round(c, n).alias(c)


@query(f"""
WITH p AS ({t.MONTHLY}),
s AS (SELECT *, lead(x) OVER w AS x_to, lead(v) OVER w AS v_to FROM p WINDOW w AS (PARTITION BY k ORDER BY x)),
q AS (SELECT *, abs(v_to - v) AS step, v_to - v AS sg FROM s WHERE x_to IS NOT NULL),
a AS (SELECT *, median(step) OVER (PARTITION BY k) AS ms, median(sg) OVER (PARTITION BY k) AS mg FROM q),
b AS (SELECT *, median(abs(step - ms)) OVER (PARTITION BY k) AS ds, median(abs(sg - mg)) OVER (PARTITION BY k) AS dg FROM a),
c AS (SELECT *, coalesce(nullif(ds, 0), ms) AS typ FROM b),
d AS (SELECT *, coalesce(nullif(dg, 0), typ) AS sp, greatest(v, v_to) / least(v, v_to) AS ratio FROM c),
e AS (SELECT *, abs(sg - mg) / sp AS dev FROM d)
SELECT k AS fixed_key, x AS x_from, x_to, round(ratio, 2) AS ratio, round(step, 3) AS step, round(typ, 3) AS typical_step, round(dev, 3) AS trend_dev, dev > 4 AND ratio >= 3 AS flagged FROM e""")
def jump_monthly_revenue(spark, sf_dir):
    d = detectors.numeric_jumps(t.monthly_revenue(spark, sf_dir))
    return d.select("fixed_key", "x_from", "x_to", r("ratio", 2), r("step", 3), r("typical_step", 3), r("trend_dev", 3), "flagged")


@query("""SELECT * FROM (VALUES ('blowup', 7.0::DOUBLE, 8.0::DOUBLE, true, true), ('turn', 7.0, 8.0, true, false), ('plateau', 1.0, 2.0, true, false), ('faster', 5.0, 6.0, true, false)) v(fixed_key, x_from, x_to, flagged, endpoint_of_climb)""")
def jump_endpoint_of_climb(spark, sf_dir):
    rows = [("blowup", [1, 2, 3, 4, 5, 6, 7, 10000]), ("turn", [1, 2, 3, 4, 5, 6, 7, -10000]), ("plateau", [2, 196, 209, 214, 215, 216]), ("faster", [2, 5, 11, 24, 50, 10000])]
    df = spark.createDataFrame(rows, "k string, vs array<int>").select("k", F.posexplode("vs").alias("i", "v"))
    d = detectors.numeric_jumps(t.series(df, "climbs", "x", F.col("k"), F.col("i") + 1, F.col("v")))
    return d.where("flagged").select("fixed_key", "x_from", "x_to", "flagged", "endpoint_of_climb")


@query(f"""
WITH p AS ({t.QUANTITY}),
s AS (SELECT *, lead(v) OVER (PARTITION BY k ORDER BY x) - v AS d, max(v) OVER (PARTITION BY k) - min(v) OVER (PARTITION BY k) AS rng, count(*) OVER (PARTITION BY k) AS n FROM p)
SELECT k AS fixed_key, min(n) AS n, CAST(sum(CASE WHEN d < 0 AND abs(d) / rng > 0.05 THEN 1 ELSE 0 END) AS BIGINT) AS reversals,
 round(coalesce(max(CASE WHEN d < 0 AND abs(d) / rng > 0.05 THEN abs(d) END), 0) / min(rng), 4) AS strength,
 max(CASE WHEN d < 0 AND abs(d) / rng > 0.05 THEN 1 ELSE 0 END) = 1 AS flagged FROM s GROUP BY k""")
def mono_quantity_price(spark, sf_dir):
    return detectors.monotonicity(t.quantity_price(spark, sf_dir), "increasing").select("fixed_key", "n", "reversals", r("strength"), "flagged")


@query("""
WITH c AS (SELECT year(o_orderdate) AS y, c_mktsegment AS e, round(avg(o_totalprice), 3) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
w AS (SELECT y, e AS winner FROM c QUALIFY row_number() OVER (PARTITION BY y ORDER BY v DESC, e) = 1),
s AS (SELECT y, winner, row_number() OVER (ORDER BY y) AS i, lag(winner) OVER (ORDER BY y) AS before FROM w),
f AS (SELECT count(DISTINCT winner) AS d, string_agg(winner, ',' ORDER BY y) AS winners FROM s),
b AS (SELECT count(*) AS c FROM s a WHERE a.winner <> a.before AND EXISTS (SELECT 1 FROM s b WHERE b.i <= a.i - 2 AND b.winner = a.winner) AND a.i >= 3)
SELECT winners, CAST(d AS BIGINT) AS distinct_winners, d >= 3 OR c > 0 AS flagged FROM f, b""")
def winrev_segment_by_year(spark, sf_dir):
    o, c = t.read(spark, sf_dir, "orders"), t.read(spark, sf_dir, "customer")
    g = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.year("o_orderdate").alias("y"), F.col("c_mktsegment").alias("entity")).agg(F.round(F.avg("o_totalprice"), 3).alias("v"))
    cells = t.series(g.withColumn("z", F.lit("")), "segments", "year", F.col("z"), F.col("y"), F.col("v"), F.col("entity")).withColumn("entity", F.col("x_lab")).withColumn("entity_pos", F.col("x_lab"))
    return detectors.win_reversals(cells, lower_is_better=False).select("winners", "distinct_winners", "flagged")


@query("""
WITH c AS (SELECT o_orderpriority AS p, year(o_orderdate) AS y, round(avg(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2),
l AS (SELECT p, lead(p) OVER (ORDER BY p) AS lo FROM (SELECT DISTINCT p FROM c)),
j AS (SELECT l.p AS hi, l.lo, a.v AS a, b.v AS b FROM l JOIN c a ON a.p = l.p JOIN c b ON b.p = l.lo AND a.y = b.y),
g AS (SELECT hi, lo, CAST(sum(CASE WHEN a < b THEN 1 ELSE 0 END) AS BIGINT) AS holds, CAST(sum(CASE WHEN a > b THEN 1 ELSE 0 END) AS BIGINT) AS fails FROM j GROUP BY 1, 2)
SELECT hi, lo, holds, fails, round(holds / (holds + fails), 4) AS strength, holds + fails >= 4 AND fails > 0 AND fails <= greatest(1, (holds + fails) // 4) AS flagged FROM g""")
def catexc_priority(spark, sf_dir):
    g = t.read(spark, sf_dir, "orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.round(F.avg("o_totalprice"), 2).alias("v"))
    cells = t.series(g, "priorities", "priority", F.col("y"), F.substring("o_orderpriority", 1, 1), F.col("v"), F.col("o_orderpriority"))
    return detectors.category_exceptions(cells).select("hi", "lo", "holds", "fails", r("strength"), "flagged")


@query("""
WITH c AS (SELECT p_brand AS e, p_size // 10 AS x, round(median(p_retailprice), 0) AS v FROM part GROUP BY 1, 2)
SELECT e AS entity, count(DISTINCT v) AS most_values, count(DISTINCT v) = 1 AS flagged FROM c GROUP BY e HAVING count(*) >= 2""")
def flatness_median_price(spark, sf_dir):
    g = t.read(spark, sf_dir, "part").groupBy("p_brand", F.floor(F.col("p_size") / 10).alias("b")).agg(F.round(F.median("p_retailprice"), 0).alias("v"))
    cells = t.series(g.withColumn("z", F.lit("")), "sizes", "size", F.col("z"), F.col("b"), F.col("v"), F.col("p_brand")).withColumn("entity", F.col("x_lab"))
    return detectors.flat_entities(cells).select("entity", "most_values", "flagged")


@query("""
WITH c AS (SELECT l_suppkey AS e, year(l_shipdate) AS x, round(avg(l_discount), 3) AS v FROM lineitem GROUP BY 1, 2),
f AS (SELECT e FROM c GROUP BY e HAVING count(*) >= 2 AND count(DISTINCT v) = 1),
d AS (SELECT * FROM c WHERE e NOT IN (SELECT e FROM f) AND length(regexp_extract(CAST(v AS VARCHAR), '\\.(\\d+)$', 1)) >= 2)
SELECT CAST(e AS VARCHAR) AS entity, v AS value, count(*) AS levels FROM d GROUP BY 1, 2 HAVING count(*) >= 2""")
def duplicate_rounded_means(spark, sf_dir):
    g = t.means_in_order(t.read(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate")), ["l_suppkey", "y"], "l_discount", 3)
    cells = t.series(g.withColumn("z", F.lit("")), "discounts", "year", F.col("z"), F.col("y"), F.col("v"), F.col("l_suppkey").cast("string")).withColumn("entity", F.col("x_lab"))
    return detectors.duplicates(cells).select("entity", "value", "levels")


def _shift_sql(source: str) -> str:
    return f"""
WITH p AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY x) AS i FROM ({source})),
b AS (SELECT *, greatest(5, CAST(floor(n * 0.3) AS BIGINT)) AS nb FROM p WHERE n >= 8),
m AS (SELECT k, median(v) AS mu, regr_slope(v, x) AS sl, regr_intercept(v, x) AS ic, var_pop(v) AS vv, max(x) AS bx, max(x) - min(x) AS wd FROM b WHERE i <= nb GROUP BY k),
m2 AS (SELECT b.k, median(abs(v - mu)) * 1.4826::DOUBLE AS mad, sqrt(avg((v - ic - sl * x) * (v - ic - sl * x))) AS rs FROM b JOIN m USING (k) WHERE i <= nb GROUP BY b.k),
c AS (SELECT b.*, mu, sl, ic, bx, coalesce(nullif(rs, 0), nullif(mad, 0), nullif(abs(mu) * 0.05, 0), 1.0) AS sd,
  (CASE WHEN vv > 0 THEN greatest(0, 1 - rs * rs / vv) ELSE 0 END) >= 0.6 AND abs(sl) * wd > 2 * coalesce(nullif(rs, 0), 1e-9) AS tr FROM b JOIN m USING (k) JOIN m2 USING (k)),
d AS (SELECT *, CASE WHEN tr THEN ic + sl * x ELSE mu END AS ex FROM c),
h AS (SELECT *, i > nb AND abs(v - ex) > 3 * sd AS hit FROM d),
g AS (SELECT *, i - row_number() OVER (PARTITION BY k, hit ORDER BY x) AS isl FROM h),
u AS (SELECT k, isl, count(*) AS np, min(i) AS fi, avg(v) AS sm, min(x) AS sf, max(x) AS st FROM g WHERE hit GROUP BY 1, 2),
t AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY np DESC, fi) = 1),
z AS (SELECT DISTINCT k, n, mu, sd, tr, bx FROM h)
SELECT z.k AS fixed_key, z.n, round(mu, 2) AS baseline, round(sd, 3) AS ref_sd, tr AS trending, bx AS baseline_to, CAST(coalesce(np, 0) AS BIGINT) AS n_persist, round(sm, 3) AS shifted_mean, sf AS shift_from, st AS shift_to, coalesce(np, 0) >= 3 AS flagged FROM z LEFT JOIN t USING (k)"""


def _shifts(df):
    return detectors.level_shifts(df).select("fixed_key", "n", r("baseline", 2), r("ref_sd", 3), "trending", "baseline_to", "n_persist", r("shifted_mean", 3), "shift_from", "shift_to", "flagged")


@query(_shift_sql(t.DAILY))
def levelshift_daily_events(spark, sf_dir):
    return _shifts(t.daily_events(spark, sf_dir))


@query(_shift_sql(t.CUMULATIVE))
def levelshift_trend_guard(spark, sf_dir):
    return _shifts(t.cumulative_events(spark, sf_dir))


@query(f"""
WITH p AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM ({t.MONTHLY})),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC) AS dn, row_number() OVER (PARTITION BY k ORDER BY x) AS i FROM p WHERE n >= 5),
m AS (SELECT k, min(CASE WHEN dn > 2 THEN v END) AS lo, max(CASE WHEN dn > 2 THEN v END) AS hi, median(CASE WHEN dn > 2 THEN v END) AS mid, max(v) - min(v) AS rng, regr_slope(v, x) AS sl, regr_intercept(v, x) AS ic, regr_r2(v, x) AS r2 FROM o GROUP BY k),
q AS (SELECT o.*, r2, abs(v - mid) > greatest(6 * (hi - lo), 0.4 * rng) AND (v < lo OR v > hi) AS outside, v - (ic + sl * x) AS rs FROM o JOIN m USING (k)),
q1 AS (SELECT *, sum(CASE WHEN outside THEN 1 ELSE 0 END) OVER (PARTITION BY k) AS no, median(rs) OVER (PARTITION BY k) AS rm FROM q),
q2 AS (SELECT *, median(abs(rs - rm)) OVER (PARTITION BY k) AS md FROM q1),
q3 AS (SELECT *, abs(rs - rm) / (1.4826::DOUBLE * md) AS z FROM q2),
q4 AS (SELECT *, z > 3.5 AND NOT (r2 >= 0.9 AND (i = 1 OR i = n)) AS far FROM q3),
q5 AS (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY k) AS nf FROM q4)
SELECT k AS fixed_key, x, v AS value, round(z, 3) AS z, CASE WHEN no BETWEEN 1 AND 2 THEN 'vs_cluster' ELSE 'residual' END AS mode, CASE WHEN no BETWEEN 1 AND 2 THEN outside ELSE far AND nf BETWEEN 1 AND 2 END AS flagged FROM q5""")
def outlier_residual_month(spark, sf_dir):
    return detectors.numeric_outliers(t.monthly_revenue(spark, sf_dir)).select("fixed_key", "x", "value", r("z", 3), "mode", "flagged")


@query("""SELECT * FROM (VALUES ('cluster', 'vs_cluster', 5.0::DOUBLE), ('leverage', 'leverage', 19.0), ('monotone', 'monotone', NULL)) v(fixed_key, mode, x)""")
def outlier_modes(spark, sf_dir):
    rows = [("cluster", i, 15.0 if i == 5 else 1.0 + 0.01 * (i % 3)) for i in range(12)] + [("leverage", 19 if i == 7 else 8, v) for i, v in enumerate((6.58, 5.76, 7.71, 8.84, 8.47, 7.04, 5.25, 12.5, 5.56, 7.91, 6.89))] + [("monotone", i, float(i * i)) for i in range(12)]
    df = spark.createDataFrame([(*row, n) for n, row in enumerate(rows)], "k string, i int, v double, n int")
    d = detectors.numeric_outliers(t.series(df, "modes", "x", F.col("k"), F.col("i"), F.col("v")).withColumn("row_id", F.lit(0).cast("long")))
    return d.groupBy("fixed_key", "mode").agg(F.max(F.when(F.col("flagged"), F.col("x"))).alias("x"))


@query(f"""
WITH p AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY v, x) AS up FROM ({t.BRANDS})),
a AS (SELECT *, CASE WHEN n >= 7 THEN 2 ELSE 1 END AS st, max(v) OVER (PARTITION BY k) AS mx, min(v) OVER (PARTITION BY k) AS mn FROM p WHERE n >= 5),
b AS (SELECT *, max(CASE WHEN up > st AND up <= n - st THEN v END) OVER (PARTITION BY k) AS ch, min(CASE WHEN up > st AND up <= n - st THEN v END) OVER (PARTITION BY k) AS cl FROM a),
c AS (SELECT *, mn > 0 AND log10(mx / mn) >= 2 AND log10(ch / cl) >= 1.5 AS lg FROM b),
d AS (SELECT *, CASE WHEN lg THEN log10(v) ELSE v END AS w FROM c),
e AS (SELECT *, min(CASE WHEN up > 1 AND up < n THEN w END) OVER (PARTITION BY k) AS lo, max(CASE WHEN up > 1 AND up < n THEN w END) OVER (PARTITION BY k) AS hi, median(CASE WHEN up > 1 AND up < n THEN w END) OVER (PARTITION BY k) AS mid, max(w) OVER (PARTITION BY k) - min(w) OVER (PARTITION BY k) AS sp FROM d),
f AS (SELECT *, sp > 0 AND abs(w - mid) > greatest(6 * (hi - lo), 0.4 * sp) AND (w < lo OR w > hi) AS o FROM e)
SELECT k AS fixed_key, lab AS x_lab, round(v, 2) AS value, lg AS log, o AND sum(CASE WHEN o THEN 1 ELSE 0 END) OVER (PARTITION BY k) BETWEEN 1 AND 2 AS flagged FROM f""")
def outlier_categorical_brand(spark, sf_dir):
    return detectors.categorical_outliers(t.brand_prices(spark, sf_dir)).select("fixed_key", "x_lab", r("value", 2), "log", "flagged")


WHOLE = """
a AS (SELECT *, count(*) OVER (PARTITION BY t) AS n, row_number() OVER (PARTITION BY t ORDER BY v, row_id) AS up, max(v) OVER (PARTITION BY t) AS mx, min(v) OVER (PARTITION BY t) AS mn,
  lead(v) OVER (PARTITION BY t ORDER BY x, row_id) - v AS d, rank() OVER (PARTITION BY t ORDER BY x) + (count(*) OVER (PARTITION BY t, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY t ORDER BY v) + (count(*) OVER (PARTITION BY t, v) - 1) / 2.0 AS ry FROM c),
m AS (SELECT t, abs(corr(rx, ry)) >= 0.9 AND (count(*) FILTER (d > 0) = 0) <> (count(*) FILTER (d < 0) = 0) AS climbs, min(v) FILTER (up > CASE WHEN n >= 7 THEN 2 ELSE 1 END AND up <= n - CASE WHEN n >= 7 THEN 2 ELSE 1 END) AS lo, max(v) FILTER (up > CASE WHEN n >= 7 THEN 2 ELSE 1 END AND up <= n - CASE WHEN n >= 7 THEN 2 ELSE 1 END) AS hi FROM a GROUP BY t),
l AS (SELECT a.*, climbs, mn > 0 AND log10(mx / mn) >= 2 AND lo > 0 AND log10(hi / lo) >= 1.5 AS lg FROM a JOIN m USING (t) WHERE n >= 5),
w AS (SELECT *, CASE WHEN lg THEN log10(v) ELSE v END AS e FROM l),
b AS (SELECT *, median(CASE WHEN up > 1 AND up < n THEN e END) OVER (PARTITION BY t) AS mid, max(e) OVER (PARTITION BY t) - min(e) OVER (PARTITION BY t) AS sp, max(CASE WHEN up = n // 4 + 1 THEN e END) OVER (PARTITION BY t) AS q1, max(CASE WHEN up = 3 * n // 4 + 1 THEN e END) OVER (PARTITION BY t) AS q3 FROM w),
g AS (SELECT *, median(CASE WHEN up > 1 AND up < n THEN abs(e - mid) END) OVER (PARTITION BY t) AS md FROM b),
h AS (SELECT *, abs(e - mid) / nullif(1.4826::DOUBLE * md, 0) AS z FROM g),
f AS (SELECT *, NOT climbs AND coalesce(z > 8 AND abs(e - mid) > 0.5 * sp, false) AS o FROM h)"""


@query(f"""
WITH c AS (SELECT n_regionkey AS t, CAST(s_nationkey AS BIGINT) AS row_id, CAST(s_nationkey AS DOUBLE) AS x, round(sum(s_acctbal), 2) * CASE WHEN s_nationkey % 9 = 0 THEN 1000 ELSE 1 END AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey, s_nationkey),{WHOLE}
SELECT CAST(t AS VARCHAR) AS table_id, row_id, lg AS log, round(z, 3) AS z, o AND sum(CASE WHEN o THEN 1 ELSE 0 END) OVER (PARTITION BY t) = 1 AS flagged FROM f""")
def outlier_whole_table(spark, sf_dir):
    s, n = t.read(spark, sf_dir, "supplier"), t.read(spark, sf_dir, "nation")
    g = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).groupBy("n_regionkey", "s_nationkey").agg(F.round(F.sum("s_acctbal"), 2).alias("v"))
    cells = g.select(F.col("n_regionkey").cast("string").alias("table_id"), F.col("s_nationkey").cast("long").alias("row_id"), (F.col("v") * F.when(F.col("s_nationkey") % 9 == 0, 1000).otherwise(1)).alias("value"), F.col("s_nationkey").cast("double").alias("x"))
    return detectors.whole_table_outliers(cells).select("table_id", "row_id", "log", r("z", 3), "flagged")


@query(f"""
WITH c AS (SELECT year(o_orderdate) AS t, CAST(month(o_orderdate) * 10 + CAST(substr(o_orderpriority, 1, 1) AS INT) AS BIGINT) AS row_id, NULL::DOUBLE AS x, o_orderpriority AS col, round(avg(o_totalprice), 2) * CASE WHEN o_orderpriority LIKE '3%' THEN 0.1 ELSE 1 END AS v FROM orders GROUP BY 1, 2, col),{WHOLE.replace("abs(corr(rx, ry)) >= 0.9 AND", "false AND")}
SELECT CAST(t AS VARCHAR) AS table_id, row_id, (e < q1 AND max(e) OVER (PARTITION BY t, col) < q1 OR e > q3 AND min(e) OVER (PARTITION BY t, col) > q3) AND count(*) OVER (PARTITION BY t, col) >= 3 AS column_scale FROM f""")
def column_scale(spark, sf_dir):
    o = t.read(spark, sf_dir, "orders")
    month, place = F.month("o_orderdate"), F.substring("o_orderpriority", 1, 1)
    g = o.groupBy(F.year("o_orderdate").cast("string").alias("table_id"), month.cast("string").alias("row_key"), F.col("o_orderpriority").alias("col_key")).agg(F.round(F.avg("o_totalprice"), 2).alias("v"), (F.first(month) * 10 + F.first(place).cast("int")).cast("long").alias("row_id"))
    cells = g.withColumn("value", F.col("v") * F.when(F.col("col_key").startswith("3"), 0.1).otherwise(1.0))
    return detectors.whole_table_outliers(cells).select("table_id", "row_id", "column_scale")


def _trend_sql(source: str) -> str:
    return f"""
WITH p AS (SELECT *, count(*) OVER (PARTITION BY k) AS n, lead(v) OVER (PARTITION BY k ORDER BY x, v) - v AS d, rank() OVER (PARTITION BY k ORDER BY v) + (count(*) OVER (PARTITION BY k, v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY k ORDER BY x) AS rx FROM ({source})),
g AS (SELECT k, min(n) AS n, regr_slope(v, x) AS slope, regr_r2(v, x) AS r2, corr(v, x) AS pe, corr(rv, rx) AS sp, count(*) FILTER (d > 0) AS up, count(*) FILTER (d < 0) AS dn, count(*) FILTER (d = 0) AS eq, max(v) - min(v) AS rng, max(x) - min(x) AS w, arg_min(v, x) AS a, arg_max(v, x) AS b FROM p WHERE n >= 6 GROUP BY k),
h AS (SELECT *, CASE WHEN dn = 0 AND up > 0 THEN CASE WHEN eq = 0 THEN 'increasing' ELSE 'non_decreasing' END WHEN up = 0 AND dn > 0 THEN CASE WHEN eq = 0 THEN 'decreasing' ELSE 'non_increasing' END ELSE 'none' END AS dir FROM g)
SELECT k AS fixed_key, n, round(slope, 4) AS slope, round(r2, 4) AS r2, round(pe, 4) AS pearson, round(sp, 4) AS spearman, dir AS direction, round(a, 2) AS start_value, round(b, 2) AS end_value,
 (r2 >= 0.5 AND abs(slope * w) > 0.5 * rng) OR (dir <> 'none' AND abs(sp) >= 0.9 AND abs(b - a) > 0.5 * rng) AS flagged FROM h"""


def _trends(df):
    return detectors.trends(df).select("fixed_key", "n", r("slope"), r("r2"), r("pearson"), r("spearman"), "direction", r("start_value", 2), r("end_value", 2), "flagged")


@query(_trend_sql(t.CUMULATIVE))
def trend_cumulative_events(spark, sf_dir):
    return _trends(t.cumulative_events(spark, sf_dir))


@query(_trend_sql(t.QUANTITY))
def trend_quantity_price(spark, sf_dir):
    return _trends(t.quantity_price(spark, sf_dir))


@query("""
WITH c AS (SELECT 'part' AS table_id, 'key' AS axis, CAST(p_partkey AS DOUBLE) AS x FROM part UNION ALL SELECT 'part', 'size', p_size FROM part UNION ALL SELECT 'nation', 'key', n_nationkey FROM nation),
g AS (SELECT table_id, axis, count(*) AS n, count(DISTINCT x) AS d, min(x) AS lo, max(x) AS hi FROM c GROUP BY 1, 2)
SELECT table_id, axis, n, n >= 5 AND d = n AND lo IN (0, 1) AND hi - lo = n - 1 AS flagged FROM g""")
def index_like_axes(spark, sf_dir):
    part, nation = t.read(spark, sf_dir, "part"), t.read(spark, sf_dir, "nation")
    row = lambda df, table, axis, c: df.select(F.lit(table).alias("table_id"), F.lit(axis).alias("axis"), F.col(c).cast("double").alias("x"))
    return detectors.index_like_axes(row(part, "part", "key", "p_partkey").unionByName(row(part, "part", "size", "p_size")).unionByName(row(nation, "nation", "key", "n_nationkey")))


NUMBERS = [("0.91 [0.88, 0.94]", 0.91), ("0.91 (0.03)", 0.91), ("8×10^{-3}", 0.008), (r"8 \times 10^3", 8000.0), ("8 10^-3", 0.008), ("inf", None), ("-inf", None), ("1e999", None), ("NaN", None), ("1k", 1000.0), ("300K", 300000.0), ("1.5M", 1.5e6), ("175B", 175e9), ("5m", None), ("10b", None), ("3G", None), ("1kg", None), ("k", None), ("1,234.5", 1234.5), ("45%", 45.0), ("−3.2", -3.2), ("n/a", None), ("--", None), ("1d", None), ("5f", None), ("1e-4", 1e-4), (" 7 ", 7.0), ("1_000", 1000.0), (".5", 0.5), ("5.", 5.0)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', {'NULL' if v is None else f'{v!r}::DOUBLE'})" for c, v in NUMBERS) + ") v(cell, number)")
def parse_number_cells(spark, sf_dir):
    df = spark.createDataFrame([(c,) for c, _ in NUMBERS], "cell string")
    return df.select("cell", F.round(numbers.parse_number(F.col("cell")), 9).alias("number"))


PRINTED = {
    "plain": ("%.2f", "printf('%.2f', v)"), "percent": ("%.2f%%", "printf('%.2f%%', v)"), "grouped": ("%,.2f", "format('{:,.2f}', v)"), "bracket": ("%.2f [1, 2]", "printf('%.2f [1, 2]', v)"),
    "spread": ("%.2f (0.5)", "printf('%.2f (0.5)', v)"), "power": ("%.2f×10^{3}", "printf('%.2f×10^{3}', v)"), "thousands": ("%.2fk", "printf('%.2fk', v)"), "word": ("about %.2f", "printf('about %.2f', v)"), "other unit": ("%.2fG", "printf('%.2fG', v)"),
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS style, count(*) AS n, round(sum({'NULL::DOUBLE' if k in ('word', 'other unit') else 'CAST(printf(\'%.2f\', v) AS DOUBLE) * 1000' if k in ('power', 'thousands') else 'CAST(printf(\'%.2f\', v) AS DOUBLE)'}), 0) AS total, min({form}) AS first FROM (SELECT o_totalprice AS v FROM orders)" for k, (_, form) in PRINTED.items()))
def parse_printed_prices(spark, sf_dir):
    o = t.read(spark, sf_dir, "orders").select(F.explode(F.create_map(*(x for k, (form, _) in PRINTED.items() for x in (F.lit(k), F.format_string(form, "o_totalprice"))))).alias("style", "cell"))
    return o.groupBy("style").agg(F.count("*").alias("n"), F.round(F.sum(numbers.parse_number(F.col("cell"))), 0).alias("total"), F.min("cell").alias("first"))


@query("""
WITH w AS (SELECT DISTINCT lower(regexp_extract(p_name, '^(\\w+)', 1)) AS w FROM part UNION SELECT unnest(['rmse', 'top-1 accuracy', 'test loss', 'BLEU ↓', 'mean error ↑'])), d AS (SELECT DISTINCT p_brand AS b FROM part)
SELECT b || ' ' || w AS metric, CASE WHEN w LIKE '%↑%' THEN 'higher' WHEN w LIKE '%↓%' THEN 'lower' WHEN regexp_matches(w, '(^|[^a-z])(rmse|mae|mse|error|err|loss|runtime|time|latency|errors|ppl|perplexity|wer|cer|fid)($|[^a-z])') THEN 'lower'
 WHEN regexp_matches(w, 'accuracy|acc|auc|f1|precision|recall|score') OR regexp_matches(w, '(^|[^a-z])(bleu|rouge|pass|top|map|miou|iou|em)($|[^a-z])') THEN 'higher' END AS direction FROM w, d""")
def metric_direction_names(spark, sf_dir):
    p = t.read(spark, sf_dir, "part")
    words = p.select(F.lower(F.regexp_extract("p_name", r"^(\w+)", 1)).alias("w")).union(spark.createDataFrame([(w,) for w in ("rmse", "top-1 accuracy", "test loss", "BLEU ↓", "mean error ↑")], "w string")).distinct()
    both = p.select("p_brand").distinct().withColumn("w", F.explode(F.lit([r["w"] for r in words.collect()])))  # the words of a column's labels
    name = F.concat_ws(" ", "p_brand", "w")
    return both.select(name.alias("metric"), numbers.metric_direction(name).alias("direction"))


DIRECTIONS = [("pass@1", "higher"), ("anything ↑", "higher"), ("loss ↑", "higher"), ("score ↓", "lower"), ("BLEU", "higher"), ("ROUGE-L", "higher"), ("Top-1 err.", "lower"), ("PPL", "lower"), ("RMSE", "lower"), ("CoLA", None), ("account", "higher"), ("", None)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', {'NULL' if v is None else repr(v)})" for c, v in DIRECTIONS) + ") v(metric, direction)")
def metric_direction(spark, sf_dir):
    df = spark.createDataFrame([(c,) for c, _ in DIRECTIONS], "metric string")
    return df.select("metric", numbers.metric_direction(F.col("metric")).alias("direction"))


@query("""
WITH g AS (SELECT l_orderkey AS k, count(*) AS n, avg(l_quantity) AS m FROM lineitem GROUP BY 1),
p AS (SELECT k, n, printf('%.2f', m + 0.000001 + CASE WHEN k % 50 = 0 THEN 0.03 ELSE 0 END) AS m FROM g)
SELECT k AS l_orderkey, n, m AS mean, CASE WHEN abs(round_even(CAST(m AS DOUBLE) * n, 0) / n - CAST(m AS DOUBLE)) > 0.005 + 1e-9 THEN 'finding' ELSE 'ok' END AS grim FROM p""")
def grim_order_means(spark, sf_dir):
    g = t.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.avg("l_quantity").alias("m"))
    g = g.withColumn("mean", F.format_string("%.2f", F.col("m") + 0.000001 + F.when(F.col("l_orderkey") % 50 == 0, 0.03).otherwise(0.0))).drop("m")
    return reported.grim(g, F.col("mean"), F.col("n")).select("l_orderkey", "n", "mean", "grim")


@query("""
WITH g AS (SELECT l_orderkey AS k, count(*) AS n, avg(l_linenumber) AS m, stddev_samp(l_linenumber) AS s FROM lineitem GROUP BY 1 HAVING count(*) >= 2),
p AS (SELECT k, n, printf('%.2f', m + 1e-6) AS mean, printf('%.2f', s + 1e-6 + CASE WHEN k % 20 = 0 THEN 0.13 ELSE 0 END) AS sd FROM g),
c AS (SELECT *, CAST(mean AS DOUBLE) AS m, CAST(sd AS DOUBLE) AS s FROM p),
q AS (SELECT *, round_even(m * n, 0) AS t, abs(round_even(m * n, 0) / n - m) > 0.005 + 1e-9 AS bad FROM c),
z AS (SELECT *, sqrt(greatest(0, (round_even(s * s * (n - 1) + t * t / n, 0) - t * t / n) / (n - 1))) AS near FROM q)
SELECT k AS l_orderkey, CASE WHEN bad THEN 'not_applicable' WHEN abs(near - s) > 0.005 + 1e-9 THEN 'finding' ELSE 'ok' END AS grimmer FROM z""")
def grimmer_order_lines(spark, sf_dir):
    g = t.read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.avg("l_linenumber").alias("m"), F.stddev_samp("l_linenumber").alias("s")).where("n >= 2")
    g = g.withColumn("mean", F.format_string("%.2f", F.col("m") + 1e-6)).withColumn("sd", F.format_string("%.2f", F.col("s") + 1e-6 + F.when(F.col("l_orderkey") % 20 == 0, 0.13).otherwise(0.0)))
    return reported.grimmer(g, F.col("mean"), F.col("sd"), F.col("n")).select("l_orderkey", "grimmer")


GRIMMER = [("3.00", "1.58", 5, "ok"), ("3.00", "1.60", 5, "finding"), ("3.45", "1.20", 7, "not_applicable"), ("3", "1.58", 5, "ok"), ("2.50", "0.71", 2, "ok"), ("2.50", "1", 2, "not_applicable"), ("2.50", "0.71", 1, "not_applicable")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{s}', {n}::BIGINT, '{g}')" for m, s, n, g in GRIMMER) + ") v(mean, sd, n, grimmer)")
def grimmer_cases(spark, sf_dir):
    df = spark.createDataFrame([(m, s, n) for m, s, n, _ in GRIMMER], "mean string, sd string, n long")
    return reported.grimmer(df, F.col("mean"), F.col("sd"), F.col("n")).select("mean", "sd", "n", "grimmer")


@query("""
WITH x AS (SELECT l_returnflag AS k, abs(l_extendedprice) AS v FROM lineitem WHERE l_extendedprice <> 0),
d AS (SELECT k, CAST(substr(printf('%.10e', v), 1, 1) AS INT) AS d, count(*) AS c FROM x GROUP BY 1, 2),
n AS (SELECT k, count(*) AS n, max(v) / min(v) AS span FROM x GROUP BY 1),
g AS (SELECT n.k, n.n, n.span, sum((coalesce(c, 0) - n.n * log10(1 + 1.0::DOUBLE / i)) * (coalesce(c, 0) - n.n * log10(1 + 1.0::DOUBLE / i)) / (n.n * log10(1 + 1.0::DOUBLE / i))) AS chi2 FROM n CROSS JOIN (SELECT CAST(unnest(range(1, 10)) AS INT) AS i) LEFT JOIN d ON d.k = n.k AND d.d = i GROUP BY 1, 2, 3)
SELECT k AS l_returnflag, n, round(span, 3) AS span, round(chi2, 3) AS chi2, CASE WHEN n < 30 OR span < 100 OR n * log10(10.0::DOUBLE / 9) < 5 THEN 'not_applicable' WHEN chi2 > 20.090235 THEN 'finding' ELSE 'ok' END AS status FROM g""")
def benford_extendedprice(spark, sf_dir):
    return reported.benford(t.read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice").select("l_returnflag", "n", r("span", 3), r("chi2", 3), "status")


@query("""
WITH d AS (SELECT l_returnflag AS k, right(printf('%.2f', l_extendedprice), 1) AS d, count(*) AS c FROM lineitem GROUP BY 1, 2)
SELECT k AS l_returnflag, CAST(sum(c) AS BIGINT) AS n, round(sum(c * c) * 10.0::DOUBLE / sum(c) - sum(c), 3) AS chi2, CASE WHEN sum(c) < 50 THEN 'not_applicable' WHEN sum(c * c) * 10.0::DOUBLE / sum(c) - sum(c) > 21.665994 THEN 'finding' ELSE 'ok' END AS status FROM d GROUP BY k""")
def terminal_digit_price(spark, sf_dir):
    df = t.read(spark, sf_dir, "lineitem").select("l_returnflag", F.format_string("%.2f", "l_extendedprice").alias("raw"))
    return reported.terminal_digits(df, ["l_returnflag"], "raw").select("l_returnflag", "n", r("chi2", 3), "status")


@query("""
WITH d AS (SELECT l_orderkey AS k, max(l_linenumber) AS n, 0.5 + (l_orderkey % 30) / 10.0 AS z FROM lineitem GROUP BY 1),
s AS (SELECT k, 'z = ' || printf('%.2f', z) || ', p < .05' AS string, z FROM d)
SELECT k AS l_orderkey, string, CASE WHEN z < 1.88 THEN 'finding' ELSE 'ok' END AS status, CASE WHEN z < 1.88 THEN 'high' END AS severity FROM s WHERE abs(z - 1.88) > 0.03""")
def statcheck_order_texts(spark, sf_dir):
    """p < .05 is claimed for every z; it is wrong beyond the tolerance where p exceeds .06, below z = 1.881."""
    g = t.read(spark, sf_dir, "lineitem").select("l_orderkey").distinct().withColumn("z", 0.5 + (F.col("l_orderkey") % 30) / 10.0)
    docs = g.select("l_orderkey", F.concat(F.lit("In order "), F.col("l_orderkey").cast("string"), F.lit(" we saw "), F.format_string("z = %.2f, p < .05", "z"), F.lit(" again.")).alias("text"))
    return reported.statcheck(reported.extract_tests(docs)).where("abs(statistic - 1.88) > 0.03").select("l_orderkey", "string", "status", "severity")


STATS = [("t(38) = 2.10, p = .03", "t", "ok"), ("t(20) = .5, p < .001", "t", "finding"), ("χ²(2, N = 120) = 5.99, p = .05", "chi2", "ok"), ("z = 1.96, p = .05", "z", "ok"), ("r(20) = 1, p < .001", "r", "ok"), ("F(2, 27) = 3.35, p = .05", "F", "ok"), ("r(20) = 1.2, p < .001", "r", "not_applicable"), ("z = 1.2, p = .01", "z", "finding")]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{k}', '{x}')" for s, k, x in STATS) + ") v(string, test, status)")
def statcheck_cases(spark, sf_dir):
    text = "We found " + "; and ".join(s for s, *_ in STATS) + ". No test here: t(3)."
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return reported.statcheck(reported.extract_tests(df)).select("string", "test", "status")


@query("""
WITH c AS (SELECT c_mktsegment AS coord, round(avg(c_acctbal), 2) AS a, round(avg(c_acctbal), 1) + CASE WHEN c_mktsegment = 'MACHINERY' THEN 40 ELSE 0 END AS b FROM customer GROUP BY 1),
g AS (SELECT *, abs(a - b) AS gap, 0.055::DOUBLE AS slack FROM c), e AS (SELECT *, gap <= greatest(slack * (1 + 1e-9), 1e-9 * greatest(abs(a), abs(b))) AS eq FROM g)
SELECT 'balance' AS metric, count(*) AS shared, CAST(sum(CASE WHEN eq THEN 1 ELSE 0 END) AS BIGINT) AS consistent, arg_max(coord, gap) FILTER (NOT eq) AS coord, round(max(gap / slack) FILTER (NOT eq), 3) AS strength, max(CASE WHEN eq THEN 0 ELSE 1 END) = 1 AS flagged FROM e""")
def crosstable_inconsistency(spark, sf_dir):
    g = t.read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.avg("c_acctbal").alias("v"))
    extra = F.when(F.col("c_mktsegment") == "MACHINERY", 40).otherwise(0)
    row = lambda pos, v, form: g.select(F.lit(f"t{pos}").alias("table_id"), F.lit(pos).alias("table_pos"), F.lit(" Balance").alias("metric"), F.lit("segment").alias("axes"), F.col("c_mktsegment").alias("coord"), F.lit(0).alias("row_id"), v.alias("value"), F.format_string(form, v).alias("raw"))
    cells = row(1, F.round("v", 2), "%.2f").unionByName(row(2, F.round("v", 1) + extra, "%.1f"))
    return across.cross_table(cells).select("metric", "shared", "consistent", "coord", r("strength", 3), "flagged")


@query("""
WITH c AS (SELECT p_type AS col, p_size AS s, CAST(p_size AS VARCHAR) || CASE WHEN p_partkey = k THEN 'G' ELSE 'M' END AS raw FROM part JOIN (SELECT p_type AS pt, min(p_partkey) AS k FROM part WHERE p_size BETWEEN 10 AND 40 GROUP BY 1) ON p_type = pt)
SELECT col, CAST(2 AS BIGINT) AS units, count(*) AS cells, 'M' AS main_unit, min(raw) FILTER (raw LIKE '%G') AS odd, true AS flagged FROM c GROUP BY col""")
def unit_mismatch_size(spark, sf_dir):
    p = t.read(spark, sf_dir, "part")
    k = p.where("p_size between 10 and 40").groupBy("p_type").agg(F.min("p_partkey").alias("k"))
    cells = p.join(k, "p_type").select(F.lit("part").alias("table_id"), F.col("p_type").alias("col"), F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") == F.col("k"), "G").otherwise("M")).alias("raw"))
    return across.unit_mismatches(cells).select("col", "units", "cells", "main_unit", "odd", "flagged")


@query("""
WITH w AS (SELECT n_regionkey, round(avg(c_acctbal), 2) AS customers, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
SELECT n_regionkey AS region, 'customers' AS method, customers AS value FROM w UNION ALL SELECT n_regionkey, 'n', CAST(n AS DOUBLE) FROM w""")
def melt_wide(spark, sf_dir):
    c, n = t.read(spark, sf_dir, "customer"), t.read(spark, sf_dir, "nation")
    w = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).groupBy("n_regionkey").agg(F.round(F.avg("c_acctbal"), 2).alias("customers"), F.count("*").cast("double").alias("n"))
    return w.withColumnRenamed("n_regionkey", "region").unpivot(["region"], ["customers", "n"], "method", "value")


@query(f"""
WITH f AS (SELECT 'trend' AS type, fixed_key, r2 AS s, spearman FROM ({_trend_sql(t.CUMULATIVE)}) WHERE flagged UNION ALL SELECT 'trend', fixed_key, r2, spearman FROM ({_trend_sql(t.QUANTITY)}) WHERE flagged)
SELECT type, fixed_key, w.w AS support, CASE WHEN w >= 0.9 AND greatest(s, abs(spearman)) >= 0.8 THEN 'HIGH' WHEN w >= 0.9 AND greatest(s, abs(spearman)) >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM f, (VALUES (0.3::DOUBLE), (1.0::DOUBLE)) w(w)""")
def trend_priorities(spark, sf_dir):
    both = [d.where("flagged") for s in (t.cumulative_events(spark, sf_dir), t.quantity_price(spark, sf_dir)) for d in (detectors.trends(s), detectors.trends(s, expect_flat=("day", "quantity")))]
    df = both[0].unionByName(both[1]).unionByName(both[2]).unionByName(both[3])
    rows = df.select(F.lit("trend").alias("type"), "fixed_key", "strength", "support", "spearman", F.lit(False).alias("endpoint"), F.lit(False).alias("column_scale"))
    return across.priority(rows).select("type", "fixed_key", "support", "priority")


def _exact(sql: str) -> str:
    """With r2 as it is, since what is strongest is decided by it."""
    return sql.replace("round(r2, 4) AS r2", "r2")


def _captioned(spark, sf_dir):
    """Trends of two summaries as flags with their captions' clauses, in columns."""
    from . import analyze as plan

    s = t.cumulative_events(spark, sf_dir).unionByName(t.quantity_price(spark, sf_dir))
    found = detectors.trends(s).withColumn("fixed_key", F.to_json(F.array(F.struct(F.lit("group").alias("key"), F.col("fixed_key").alias("value")))))
    flags = plan.flags_of(found, "trend", 11, [*plan.rounded(3, "slope", "r2", "pearson", "spearman"), "direction", *plan.rounded(2, "start_value", "end_value")], F.col("support"), spearman=F.col("spearman"))
    axes = [("cumulative_events", "events", "day"), ("quantity_price", "price", "quantity")]
    rows = [(k, k, m, "group", "group", True, [(0, a, "numeric", []), (1, "group", "unordered_cat", [])]) for k, m, a in axes]
    meta = spark.createDataFrame(rows, "table_id string, name string, metric string, entity string, who string, lower_is_better boolean, axes array<struct<pos:int,axis:string,kind:string,ord:array<string>>>")
    full = meta.select("*", F.lit(None).cast("string").alias("note"), F.col("table_id").alias("grid_id"), F.lit(0).alias("table_pos"))
    return full, across.ranked(across.priority(flags))


@query(f"""
WITH f AS (SELECT 'cumulative_events' AS t, 'events' AS m, 'day' AS a, * FROM ({_exact(_trend_sql(t.CUMULATIVE))}) UNION ALL SELECT 'quantity_price', 'price', 'quantity', * FROM ({_exact(_trend_sql(t.QUANTITY))})),
o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY r2 DESC, fixed_key) AS i, m || ' ' || CASE direction WHEN 'non_decreasing' THEN 'is non-decreasing' WHEN 'non_increasing' THEN 'is non-increasing' ELSE CASE WHEN direction = 'decreasing' OR slope < 0 THEN 'decreases' ELSE 'increases' END END || ' as ' || a || ' increases' || CASE WHEN direction LIKE 'non_%creasing' THEN ' (ties present)' ELSE '' END AS p FROM f WHERE flagged)
SELECT v.t AS table_id, v.m || ' for each group across ' || v.a || '.' AS opening, coalesce(p, '') AS clause, coalesce('group=' || fixed_key, '') AS scope FROM (VALUES ('cumulative_events', 'events', 'day'), ('quantity_price', 'price', 'quantity')) v(t, m, a) LEFT JOIN o ON o.t = v.t AND i = 1""")
def generated_captions(spark, sf_dir):
    from . import text

    c = F.col("caption")
    told = text.captions(*_captioned(spark, sf_dir))
    clause = F.regexp_extract(c, r"\. (.*?increases(?: \(ties present\))?) \(", 1)
    return told.select("table_id", F.regexp_extract(c, r"^([^.]*\.)", 1).alias("opening"), clause.alias("clause"), F.regexp_extract(c, r"\((group=[^()]*)\)\.$", 1).alias("scope"))


@query(f"""
WITH f AS (SELECT 'cumulative_events' AS t, 'events' AS m, 'day' AS a, * FROM ({_exact(_trend_sql(t.CUMULATIVE))}) UNION ALL SELECT 'quantity_price', 'price', 'quantity', * FROM ({_exact(_trend_sql(t.QUANTITY))})),
o AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY r2 DESC, fixed_key) AS i FROM f WHERE flagged)
SELECT t AS grid_id, m || CASE WHEN slope < 0 THEN ' falls as ' ELSE ' rises as ' END || a || ' goes up' AS takeaway FROM o WHERE i = 1""")
def takeaway_sentences(spark, sf_dir):
    from ..functions import sentences
    from . import text

    tables, flags = _captioned(spark, sf_dir)

    @F.udf("string")
    def first(metric: str, entity: str, packed: str) -> str:
        return sentences.what_matters({"metric": metric, "entity": entity}, text.unpacked(packed)).split(", from")[0]

    return tables.join(text._facts(flags, None), "table_id").select("grid_id", first("metric", "entity", "flags").alias("takeaway"))


@query(None)
def trend_ci(spark, sf_dir):
    return detectors.trend_intervals(t.cumulative_events(spark, sf_dir).unionByName(t.quantity_price(spark, sf_dir)))


@query(f"""
WITH p AS ({t.QUANTITY}), s AS (SELECT k, x, CASE WHEN k = 'R' THEN v * 1e300 ELSE v END AS v FROM p)
SELECT k AS fixed_key, 'fit quality not determinable: the values'' spread is not finite' AS note FROM s GROUP BY k HAVING k = 'R' AND count(*) >= 5""")
def honesty_notes(spark, sf_dir):
    s = t.quantity_price(spark, sf_dir)
    return detectors.fit_notes(s.withColumn("value", F.when(F.col("fixed_key") == "R", F.col("value") * 1e300).otherwise(F.col("value")))).select("fixed_key", "note")


@query("""
WITH c AS (SELECT n_name || ' ' || CASE WHEN n_nationkey % 2 = 0 THEN 'dev loss' ELSE 'test loss' END AS lab, n_regionkey AS t, n_nationkey AS k FROM nation),
d AS (SELECT t, 'all' AS axis, lab FROM c UNION ALL SELECT t, 'mixed', CASE WHEN k < 8 THEN 'plain' ELSE lab END FROM c)
SELECT CAST(t AS VARCHAR) AS table_id, axis FROM d GROUP BY t, axis HAVING count(DISTINCT lab) >= 2 AND bool_and(lab LIKE '% loss')""")
def sideways_axes(spark, sf_dir):
    n = t.read(spark, sf_dir, "nation").withColumn("lab", F.concat_ws(" ", "n_name", F.when(F.col("n_nationkey") % 2 == 0, "dev loss").otherwise("test loss")))
    row = lambda axis, lab: n.select(F.col("n_regionkey").cast("string").alias("table_id"), F.lit(axis).alias("axis"), lab.alias("x_lab"))
    return detectors.sideways_axes(row("all", F.col("lab")).unionByName(row("mixed", F.when(F.col("n_nationkey") < 8, "plain").otherwise(F.col("lab")))))


@query("""
WITH c AS (SELECT 's' || n_regionkey AS source, 't' || n_nationkey AS table_id, CAST(n_nationkey AS INT) AS pos, 'balance' AS metric, CASE WHEN n_nationkey % 3 = 0 THEN 'a' ELSE 'b' END AS axes FROM nation)
SELECT a.table_id, 'not compared with ' || b.table_id || ': the same metric ''balance'' over other axes' AS reason FROM c a JOIN c b USING (source, metric) WHERE a.pos < b.pos AND a.axes <> b.axes""")
def shape_mismatch_notes(spark, sf_dir):
    from .analyze import shape_notes

    n = t.read(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    return shape_notes(n.select(F.concat(F.lit("s"), F.col("n_regionkey").cast("string")).alias("source"), F.concat(F.lit("t"), key.cast("string")).alias("table_id"), key.cast("int").alias("table_pos"), F.lit(" Balance ").alias("metric"), F.when(key % 3 == 0, "a").otherwise("b").alias("axes")))


@query(f"""
WITH f AS (SELECT fixed_key, flagged, ratio, trend_dev FROM (
WITH p AS ({t.MONTHLY}),
s AS (SELECT *, lead(x) OVER w AS x_to, lead(v) OVER w AS v_to FROM p WINDOW w AS (PARTITION BY k ORDER BY x)),
q AS (SELECT *, abs(v_to - v) AS step, v_to - v AS sg FROM s WHERE x_to IS NOT NULL),
a AS (SELECT *, median(step) OVER (PARTITION BY k) AS ms, median(sg) OVER (PARTITION BY k) AS mg FROM q),
b AS (SELECT *, median(abs(step - ms)) OVER (PARTITION BY k) AS ds, median(abs(sg - mg)) OVER (PARTITION BY k) AS dg FROM a),
c AS (SELECT *, coalesce(nullif(ds, 0), ms) AS typ FROM b),
d AS (SELECT *, coalesce(nullif(dg, 0), typ) AS sp, greatest(v, v_to) / least(v, v_to) AS ratio FROM c)
SELECT k AS fixed_key, ratio, abs(sg - mg) / sp AS trend_dev, abs(sg - mg) / sp > 4 AND ratio >= 3 AS flagged FROM d))
SELECT 'monthly_revenue' AS table_id, count(*) FILTER (ratio >= 10) AS high, count(*) FILTER (ratio < 10) AS medium, CAST(0 AS BIGINT) AS low FROM f WHERE flagged HAVING count(*) > 0""")
def priority_counts(spark, sf_dir):
    from . import analyze as plan
    from . import report

    jumps = detectors.numeric_jumps(t.monthly_revenue(spark, sf_dir)).where("not endpoint_of_climb")
    return report.priority_counts(across.ranked(across.priority(plan.flags_of(jumps, "numeric_jump", 1, ["ratio"]))))


@query(None)
def planted_recall(spark, sf_dir):
    from . import evaluate

    return evaluate.recall(t.monthly_revenue(spark, sf_dir).unionByName(t.quantity_price(spark, sf_dir)))


def _texts(spark, sf_dir):
    """Regions' and nations' balances as small CSV files, which are then read, inferred and checked like any others."""
    c, n = t.read(spark, sf_dir, "customer"), t.read(spark, sf_dir, "nation")
    return c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).groupBy("n_regionkey", "n_name").agg(F.floor(F.avg("c_acctbal")).cast("double").alias("v"))


@query("""
SELECT 'region' || n_regionkey || '.csv' AS name, n_name AS level, CAST(floor(avg(c_acctbal)) AS DOUBLE) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_name""")
def files_read_back(spark, sf_dir):
    from ..sources import readers

    rows = _texts(spark, sf_dir).groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.format_string("%s,%.2f", "n_name", "v"))).alias("lines"))
    files = {f"region{r['n_regionkey']}.csv": "nation,mean balance value\n" + "\n".join(r["lines"]) for r in rows.collect()}  # a file a region
    return readers.cells(readers.from_text(spark, files)).select("name", F.col("coords")["nation"].alias("level"), "value")


@query("""
WITH c AS (SELECT 'region' || n_regionkey || '.csv' AS f, n_name AS who, floor(avg(c_acctbal)) AS v FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey, n_name),
o AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY v DESC, who) AS i FROM c)
SELECT f || '#grid0' AS grid_id, max(who) FILTER (i = 1) || ' has the highest mean balance value (' AS takeaway, max(who) FILTER (i = 2) AS second FROM o GROUP BY f""")
def takeaways(spark, sf_dir):
    from ..sources import readers
    from . import text

    rows = _texts(spark, sf_dir).groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.format_string("%s,%.2f", "n_name", "v"))).alias("lines"))
    files = {f"region{r['n_regionkey']}.csv": "nation,mean balance value\n" + "\n".join(r["lines"]) for r in rows.collect()}  # a file a region
    tables = readers.from_text(spark, files)
    flags = spark.createDataFrame([], "table_id string, rank int, type string, axis string, fixed_key string, detail string, strength double, priority string")
    said = text.takeaways(tables, flags).select("grid_id", F.get("takeaway", F.lit(0)).alias("s"))
    return said.select("grid_id", F.regexp_extract("s", r"^([^(]*\()", 1).alias("takeaway"), F.regexp_extract("s", r"ahead of ([^(]*) \(", 1).alias("second"))


SCORES = [("numeric_jump", 12.0, 1.0, False, "HIGH"), ("numeric_jump", 12.0, 1.0, True, "LOW"), ("numeric_jump", 3.0, 1.0, False, "MEDIUM"), ("cat_exception", 0.9, 0.9, False, "HIGH"), ("trend", 0.95, 0.3, False, "LOW"), ("trend", 0.85, 1.0, False, "HIGH"), ("level_shift", 4.0, 1.0, False, "MEDIUM"), ("flatness", 1.0, 1.0, False, "MEDIUM"), ("point_outlier", 8.0, 1.0, False, "HIGH"), ("point_outlier", 9.0, 1.0, True, "LOW"), ("cross_table_inconsistency", 6.0, 0.4, False, "MEDIUM"), ("duplicate", 2.0, 1.0, False, "MEDIUM"), ("win_reversal", 3.0, 1.0, False, "HIGH")]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{k}', '{p}')" for i, (k, *_, p) in enumerate(SCORES)) + ") v(seq, type, priority)")
def flag_priorities(spark, sf_dir):
    df = spark.createDataFrame([(i, k, s, p, low) for i, (k, s, p, low, _) in enumerate(SCORES)], "seq long, type string, strength double, support double, low boolean")
    df = df.withColumn("endpoint", F.col("low")).withColumn("column_scale", F.col("low")).withColumn("spearman", F.lit(None).cast("double"))
    return across.priority(df).select("seq", "type", "priority")


@query("""
WITH a AS (SELECT p_size AS v, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY 1), b AS (SELECT p_size AS v, count(*) AS n FROM part WHERE p_partkey % 2 = 1 GROUP BY 1)
SELECT CAST(sum(least(a.n, b.n)) AS BIGINT) AS shared FROM a JOIN b USING (v)""")
def multiset_overlap(spark, sf_dir):
    p = t.read(spark, sf_dir, "part")
    return across.multiset_overlap(p.where("p_partkey % 2 = 0"), p.where("p_partkey % 2 = 1"), "p_size")


@query("""
WITH n AS (SELECT count(DISTINCT p_brand) AS a, count(DISTINCT p_type) AS b, count(DISTINCT p_size) AS c FROM part)
SELECT 'part' AS table_id, CAST(3 AS BIGINT) AS axes, CAST(a * b * c AS DOUBLE) AS combinations, a * b * c > 50000 AS flagged FROM n""")
def pathological_gate(spark, sf_dir):
    p = t.read(spark, sf_dir, "part")
    levels = p.select(F.lit("part").alias("table_id"), F.explode(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"), F.lit("size"), F.col("p_size").cast("string"))).alias("axis", "level"))
    return across.pathological(levels)


@query("""SELECT * FROM (VALUES ('a', 'trend', 1::BIGINT), ('a', 'point_outlier', 2), ('b', 'point_outlier', 4)) v(axis, type, seq)""")
def suppressed_flags(spark, sf_dir):
    flags = spark.createDataFrame([("t", "a", "trend", None, None, None, 1), ("t", "a", "point_outlier", 5.0, None, None, 2), ("t", "a", "numeric_jump", None, 4.0, 5.0, 3), ("t", "b", "point_outlier", 1.0, None, None, 4), ("t", "b", "level_shift", None, None, None, 5), ("t", "b", "numeric_jump", None, 7.0, 8.0, 6)], "table_id string, axis string, type string, at double, x_from double, x_to double, seq long")
    index = spark.createDataFrame([("t", "b", True), ("t", "a", False)], "table_id string, axis string, flagged boolean")
    return across.suppress(flags, index).select("axis", "type", "seq")


CAPTIONS = [("Later months are lower than earlier ones (12.5)", "A decrease to 12.50 in Table 2, 1970"), ("Scores increase; 3.14 stands out", "The best score rises to 2.72"), (None, "no claim here"), ("", "")]


@query("""SELECT * FROM (VALUES (0::BIGINT, 'decrease,value 12.50', '', '', 1.0::DOUBLE, 1.0::DOUBLE), (1, 'increase', 'outlier,value 3.14', 'best,value 2.72', round(1 / 3.0::DOUBLE, 4), round(1 / 3.0::DOUBLE, 4)), (2, '', '', '', NULL, NULL), (3, '', '', '', NULL, NULL)) v(id, shared, generated_only, real_only, recall, precision)""")
def caption_compare(spark, sf_dir):
    from ..functions.claims import compare

    df = spark.createDataFrame([(i, g, c) for i, (g, c) in enumerate(CAPTIONS)], "id long, generated string, real string")
    return compare(df, "generated", "real").select("id", *(F.array_join(c, ",").alias(c) for c in ("shared", "generated_only", "real_only")), r("recall"), r("precision"))


@query("""
WITH c AS (SELECT year(o_orderdate) AS y, o_orderpriority AS who, round(avg(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2),
w AS (SELECT y, who, row_number() OVER (PARTITION BY y ORDER BY v DESC, who) AS p FROM c), b AS (SELECT y, max(who) FILTER (p = 1) AS best FROM w GROUP BY y),
n AS (SELECT best, count(*) AS k FROM b GROUP BY 1), t AS (SELECT sum(k) AS s, max(k) AS m FROM n),
o AS (SELECT best, k, row_number() OVER (ORDER BY k DESC, best) AS i FROM n)
SELECT CAST(s AS BIGINT) AS settings, CASE WHEN m * 2 > s THEN (SELECT best || ' is best in ' || k || ' of ' FROM o WHERE i = 1) || CAST(s AS BIGINT) || ' settings.' ELSE 'Nobody leads: ' || (SELECT string_agg(best || ' in ' || k, ', ' ORDER BY i) FROM o WHERE i <= 3) || ' of ' || CAST(s AS BIGINT) || ' settings.' END AS sentence FROM t""")
def winners_takeaway(spark, sf_dir):
    g = t.read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").cast("string").alias("setting"), F.col("o_orderpriority").alias("who")).agg(F.round(F.avg("o_totalprice"), 2).alias("value"))
    won = across.winners(g.withColumn("table_id", F.lit("orders")), lower_is_better=False)
    return across.leaders(won).select("settings", "sentence")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_summary(spark, sf_dir):
    from ..streaming.summary import run_once

    return run_once(spark, sf_dir, "events.parquet")
