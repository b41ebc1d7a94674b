"""Queries of safety scores, gates, failure classes and further statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import statistics as X
from lodestone.plans.metric_queries import _RUN, judged
from lodestone.plans.registry import query, table

@query(
    "failure_taxonomy",
    _RUN + ", c AS (SELECT query_id, CASE WHEN count_if(rel) = 0 THEN 'candidate_miss' WHEN min(CASE WHEN rel THEN rank END) > 5 THEN 'rank_loss' WHEN count_if(rel) < 5 THEN 'partial' ELSE 'ok' END AS class FROM j GROUP BY ALL) SELECT class, count(*) AS queries, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM c GROUP BY ALL",
)
def failure_taxonomy(spark, d):
    hits, first = F.count_if("rel"), F.min(F.when(F.col("rel"), F.col("rank")))
    classes = judged(spark, d).groupBy("query_id").agg(F.when(hits == 0, "candidate_miss").when(first > 5, "rank_loss").when(hits < 5, "partial").otherwise("ok").alias("class"))
    counted = classes.groupBy("class").agg(F.count(F.lit(1)).alias("queries"))
    return counted.crossJoin(F.broadcast(counted.agg(F.sum("queries").alias("all")))).select("class", "queries", F.round(F.col("queries") / F.col("all"), 6).alias("share"))  # one row


@query(
    "release_gate",
    "WITH m AS (SELECT lang, avg(quality) AS q, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL), b AS (SELECT avg(quality) AS base FROM labels) SELECT lang, round(q, 6) AS value, n, CASE WHEN n < 30 THEN 'NODATA' WHEN q < base * 0.95 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM m, b",
)
def release_gate(spark, d):
    own = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id")
    m = own.groupBy("lang").agg(F.avg("quality").alias("q"), F.count(F.lit(1)).alias("n"))
    base = table(spark, d, "labels").agg(F.avg("quality").alias("base"))
    verdict = F.when(F.col("n") < 30, "NODATA").when(F.col("q") < F.col("base") * 0.95, "FAIL").otherwise("PASS")
    return m.crossJoin(F.broadcast(base)).select("lang", F.round("q", 6).alias("value"), "n", verdict.alias("verdict"))  # one row


@query(
    "wilcoxon",
    "WITH p AS (SELECT l_suppkey, l_quantity - 25 AS x FROM lineitem WHERE l_quantity <> 25), r AS (SELECT l_suppkey, x, rank() OVER (PARTITION BY l_suppkey ORDER BY abs(x)) + (count(*) OVER (PARTITION BY l_suppkey, abs(x)) - 1) / 2 AS r FROM p) SELECT l_suppkey, count(*) AS n, coalesce(sum(CASE WHEN x > 0 THEN r END), 0.0) AS w_plus, coalesce(sum(CASE WHEN x < 0 THEN r END), 0.0) AS w_minus FROM r GROUP BY ALL",
)
def wilcoxon(spark, d):
    x = F.col("l_quantity") - 25
    p = table(spark, d, "lineitem").select("l_suppkey", x.alias("x"), F.abs(x).alias("a")).where("x <> 0")
    r = F.rank().over(Window.partitionBy("l_suppkey").orderBy("a")) + (F.count(F.lit(1)).over(Window.partitionBy("l_suppkey", "a")) - 1) / 2
    ranked = p.withColumn("r", r)

    def total(side):
        return F.coalesce(F.sum(F.when(side, F.col("r"))), F.lit(0.0))

    return ranked.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), total(F.col("x") > 0).alias("w_plus"), total(F.col("x") < 0).alias("w_minus"))


@query(
    "nan_aware_stats",
    "SELECT p_brand, count(v) AS valid_n, count(*) - count(v) AS nan_n, round(avg(v), 6) AS mean, round(median(v), 6) AS median, round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.75), 6) AS p75 FROM (SELECT p_brand, CASE WHEN p_size % 7 <> 0 THEN p_retailprice END AS v FROM part) GROUP BY ALL",
)
def nan_aware_stats(spark, d):
    seen = F.when(F.col("p_size") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice"))
    v = F.when(~F.isnan("v"), F.col("v"))  # not observed: null, which averages skip
    rows = table(spark, d, "part").select("p_brand", seen.alias("v")).select("p_brand", v.alias("v"))
    q = X.percentiles(rows, ["p_brand"], "v", {"median": 0.5, "p25": 0.25, "p75": 0.75})
    m = rows.groupBy("p_brand").agg(F.count("v").alias("valid_n"), (F.count(F.lit(1)) - F.count("v")).alias("nan_n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_pop("v"), 6).alias("std"))
    return m.join(q, "p_brand", "left").select("p_brand", "valid_n", "nan_n", "mean", "std", *(F.round(c, 6).alias(c) for c in ("median", "p25", "p75")))


@query("gold_windows", "SELECT doc_id, unnest(range(doc_id - 1, doc_id + 2)) AS near_id FROM labels WHERE quality = 1")
def gold_windows(spark, d):
    return table(spark, d, "labels").where("quality = 1").select("doc_id", F.explode(F.sequence(F.col("doc_id") - 1, F.col("doc_id") + 1)).alias("near_id"))


@query("conversation_order", "SELECT conv_id, bool_and(turn > coalesce(p, -1)) AS ordered, count(DISTINCT role) AS roles FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY ALL")
def conversation_order(spark, d):
    p = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").withColumn("p", p).groupBy("conv_id").agg(F.bool_and(F.col("turn") > F.coalesce("p", F.lit(-1))).alias("ordered"), F.count_distinct("role").alias("roles"))
