"""Queries of ranking metrics, agreement, statistics and operations analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import statistics as X
from lodestone.plans import registry as S
from lodestone.plans.registry import query, table
from lodestone.plans.retrieval_queries import _KNN, vector_run


def judged(spark, d, k=10):
    """The dense run with rel: the neighbour has the query's label."""
    own = table(spark, d, "embeddings").select("vec_id", "label")
    run = vector_run(spark, d, k).join(own.withColumnsRenamed({"vec_id": "query_id", "label": "ql"}), "query_id")
    return run.join(own.withColumnsRenamed({"vec_id": "doc_id", "label": "dl"}), "doc_id").withColumn("rel", F.col("ql") == F.col("dl"))


_RUN = f"WITH {_KNN}, t AS ({S.top('kn', 10)}), j AS (SELECT query_id, doc_id, rank, ql, ql = dl AS rel FROM t)"


@query(
    "ranking_metrics",
    _RUN + """, g AS (SELECT label, count(*) - 1 AS gold FROM embeddings GROUP BY ALL), a AS (SELECT query_id, any_value(ql) AS label, count_if(rel) AS hits, min(CASE WHEN rel THEN rank END) AS first, sum(CASE WHEN rel THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM j GROUP BY ALL)
SELECT query_id, round(hits / 10, 6) AS precision_at_k, round(CASE WHEN gold > 0 THEN hits / gold ELSE 0 END, 6) AS recall_at_k, round(coalesce(1.0 / first, 0), 6) AS mrr, round(CASE WHEN hits > 0 THEN dcg / list_sum(list_transform(range(1, CAST(hits AS BIGINT) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg FROM a JOIN g USING (label)""",
)
def ranking_metrics(spark, d):
    gold = table(spark, d, "embeddings").groupBy(F.col("label").alias("ql")).agg((F.count(F.lit(1)) - 1).alias("gold"))
    gain = F.sum(F.when(F.col("rel"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0))
    a = judged(spark, d).groupBy("query_id", "ql").agg(F.count_if("rel").alias("hits"), F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"), gain.alias("dcg")).join(gold, "ql")
    # The ideal counts only what was found.
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest("hits", F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return a.select(
        "query_id", F.round(F.col("hits") / 10, 6).alias("precision_at_k"), F.round(F.when(F.col("gold") > 0, F.col("hits") / F.col("gold")).otherwise(0.0), 6).alias("recall_at_k"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.when(F.col("hits") > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"),
    )


@query("leakage", _RUN + " SELECT ql AS label, count_if(NOT rel) AS leaked, round(count_if(NOT rel) / count(*), 6) AS ratio FROM j GROUP BY ALL")
def leakage(spark, d):
    off = F.count_if(~F.col("rel"))
    return judged(spark, d).groupBy(F.col("ql").alias("label")).agg(off.alias("leaked"), F.round(off / F.count(F.lit(1)), 6).alias("ratio"))


_PAIR = "SELECT doc_id, quality AS a, 1 - toxic AS b FROM labels"


@query("confusion_matrix", f"SELECT a, b, count(*) AS n FROM ({_PAIR}) GROUP BY ALL")
def confusion_matrix(spark, d):
    return table(spark, d, "labels").groupBy(F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "cohen_kappa",
    f"WITH p AS ({_PAIR}), s AS (SELECT count(*) AS n, count_if(a = b) AS same, count_if(a = 1) AS a1, count_if(b = 1) AS b1 FROM p) SELECT round((same / n - (a1 * b1 + (n - a1) * (n - b1)) / n / n) / (1 - (a1 * b1 + (n - a1) * (n - b1)) / n / n), 6) AS kappa, round(same / n, 6) AS agreement FROM s",
)
def cohen_kappa(spark, d):
    a, b, one = F.col("quality"), 1 - F.col("toxic"), F.count(F.lit(1))
    s = table(spark, d, "labels").agg(one.alias("n"), F.count_if(a == b).alias("same"), F.count_if(a == 1).alias("a1"), F.count_if(b == 1).alias("b1"))
    n, a1, b1 = F.col("n"), F.col("a1"), F.col("b1")
    chance = (a1 * b1 + (n - a1) * (n - b1)) / n / n
    return s.select(F.round((F.col("same") / n - chance) / (1 - chance), 6).alias("kappa"), F.round(F.col("same") / n, 6).alias("agreement"))


@query("mcnemar", f"WITH s AS (SELECT count_if(a = 1 AND b = 0) AS x, count_if(a = 0 AND b = 1) AS y FROM ({_PAIR})) SELECT x AS only_a, y AS only_b, round(CASE WHEN x + y = 0 THEN 0 ELSE greatest(abs(x - y) - 1, 0) * greatest(abs(x - y) - 1, 0) / (x + y) END, 6) AS chi2 FROM s")
def mcnemar(spark, d):
    a, b = F.col("quality") == 1, F.col("toxic") == 0
    s = table(spark, d, "labels").agg(F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))
    x, y = F.col("only_a"), F.col("only_b")
    gap = F.greatest(F.abs(x - y) - 1, F.lit(0))
    return s.select("only_a", "only_b", F.round(F.when(x + y == 0, 0.0).otherwise(gap * gap / (x + y)), 6).alias("chi2"))


@query(
    "spearman",
    "WITH r AS (SELECT source, rank() OVER (PARTITION BY source ORDER BY n_chars) + (count(*) OVER (PARTITION BY source, n_chars) - 1) / 2 AS x, rank() OVER (PARTITION BY source ORDER BY length(text) - doc_id % 50) + (count(*) OVER (PARTITION BY source, length(text) - doc_id % 50) - 1) / 2 AS y FROM documents) SELECT source, round(corr(x, y), 6) AS rho FROM r GROUP BY ALL",
)
def spearman(spark, d):
    """Mean ranks from the counts of distinct values, so the ordered windows hold values and not rows."""
    own = table(spark, d, "documents").select("source", F.col("n_chars").alias("a"), (F.length("text") - F.col("doc_id") % 50).alias("b"))

    def mean_rank(c, name):
        n = own.groupBy("source", c).agg(F.count(F.lit(1)).alias("n"))
        # Nulls come first and share a rank, as all equal values do.
        upto = F.sum("n").over(Window.partitionBy("source").orderBy(c))
        return n.select(F.col("source").alias(f"s_{name}"), F.col(c).alias(f"v_{name}"), (upto - F.col("n") + 1 + (F.col("n") - 1) / 2).alias(name))

    x, y = mean_rank("a", "x"), mean_rank("b", "y")
    same = lambda r, c, name: F.col("source").eqNullSafe(r[f"s_{name}"]) & F.col(c).eqNullSafe(r[f"v_{name}"])
    both = own.join(x, same(x, "a", "x")).join(y, same(y, "b", "y"))
    return both.groupBy("source").agg(F.round(F.corr("x", "y"), 6).alias("rho"))


_DRAW = "CAST('0x' || substr(sha1(CAST(doc_id AS VARCHAR) || ':' || CAST(b AS VARCHAR)), 1, 8) AS BIGINT)"


@query(
    "bootstrap_ci",
    f"WITH w AS (SELECT b, quality, CASE WHEN {_DRAW} % 1000 < 368 THEN 0 WHEN {_DRAW} % 1000 < 736 THEN 1 WHEN {_DRAW} % 1000 < 920 THEN 2 ELSE 3 END AS w FROM labels, (SELECT unnest(range(0, 100)) AS b)), m AS (SELECT b, CAST(sum(w * quality) AS DOUBLE) / sum(w) AS m FROM w GROUP BY ALL) SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m",
)
def bootstrap_ci(spark, d):
    # Each row is drawn anew for each of a fixed number of rounds, by a hash; only sums leave the scan.
    rounds = table(spark, d, "labels").select("doc_id", "quality", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("b"))
    x = F.conv(F.substring(F.sha1(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("b").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 1000
    w = F.when(x < 368, 0).when(x < 736, 1).when(x < 920, 2).otherwise(3)
    m = rounds.withColumn("w", w).groupBy("b").agg((F.sum(F.col("w") * F.col("quality")).cast("double") / F.sum("w")).alias("m"))
    return m.agg(F.round(F.percentile("m", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("m", F.lit(0.975)), 6).alias("high"))


@query("latency_percentiles", "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events GROUP BY ALL")
def latency_percentiles(spark, d):
    e = table(spark, d, "events")
    p = X.percentiles(e, ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    m = e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("std"))
    return m.join(p, "event_type").select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")), "mean", "std")


@query("usage_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS calls, round(sum(l_quantity), 2) AS tokens, round(sum(l_extendedprice * (1 - l_discount)), 2) AS cost FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def usage_rollup(spark, d):
    cost = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("l_quantity"), 2).alias("tokens"), F.round(cost, 2).alias("cost"))


@query("budget_levels", "SELECT o_custkey, round(sum(o_totalprice), 2) AS spent, CASE WHEN sum(o_totalprice) >= 2000000 THEN 'RED' WHEN sum(o_totalprice) >= 1600000 THEN 'YELLOW' ELSE 'GREEN' END AS level FROM orders GROUP BY ALL")
def budget_levels(spark, d):
    spent = F.sum("o_totalprice")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(spent, 2).alias("spent"), F.when(spent >= 2_000_000, "RED").when(spent >= 1_600_000, "YELLOW").otherwise("GREEN").alias("level"))


@query("feedback_grouping_sets", "SELECT event_type, user_id % 5 AS reason, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (reason), ())")
def feedback_grouping_sets(spark, d):
    own = table(spark, d, "events").select("event_type", (F.col("user_id") % 5).alias("reason"))
    return own.groupingSets([["event_type"], ["reason"], []], "event_type", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("slo_evaluation", "SELECT CAST(ts AS DATE) AS day, round(1 - count_if(event_type = 'error') / count(*), 6) AS availability, CASE WHEN count(*) < 5 THEN 'NODATA' WHEN 1 - count_if(event_type = 'error') / count(*) >= 0.8 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM events GROUP BY ALL")
def slo_evaluation(spark, d):
    n = F.count(F.lit(1))
    up = 1 - F.count_if(F.col("event_type") == "error") / n
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(up, 6).alias("availability"), F.when(n < 5, "NODATA").when(up >= 0.8, "PASS").otherwise("FAIL").alias("verdict"))


@query("histogram_buckets", "SELECT event_type, le, count_if(value <= le) AS n FROM events, (VALUES (10.0), (50.0), (100.0), (500.0)) b(le) GROUP BY ALL")
def histogram_buckets(spark, d):
    bounds = [10.0, 50.0, 100.0, 500.0]
    wide = table(spark, d, "events").groupBy("event_type").agg(F.array(*(F.struct(F.lit(b).alias("le"), F.count_if(F.col("value") <= b).alias("n")) for b in bounds)).alias("b"))
    return wide.select("event_type", F.inline("b"))


@query("dataset_split", "SELECT doc_id, lang, CASE WHEN n <= 5 THEN 'smoke' WHEN n <= 25 THEN 'regression' ELSE 'release' END AS split FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha1('42:' || doc_id), doc_id) AS n FROM documents)")
def dataset_split(spark, d):
    """The quotas of a language are its first 25 by hash, which each task cuts to 25 before the shuffle; all others are the rest."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    w = Window.partitionBy("lang").orderBy(F.sha1(F.concat(F.lit("42:"), F.col("doc_id").cast("string")).cast("binary")), "doc_id")
    head = docs.withColumn("n", F.row_number().over(w)).where("n <= 25").select("doc_id", F.when(F.col("n") <= 5, "smoke").otherwise("regression").alias("split"))
    return docs.join(F.broadcast(head), "doc_id", "left").select("doc_id", "lang", F.coalesce("split", F.lit("release")).alias("split"))  # 25 rows a language


@query("pareto_frontier", "WITH m AS (SELECT p_brand, avg(p_retailprice) AS cost, avg(p_size) AS quality FROM part GROUP BY ALL) SELECT p_brand FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.cost <= m.cost AND o.quality >= m.quality AND (o.cost < m.cost OR o.quality > m.quality))")
def pareto_frontier(spark, d):
    """A frontier is a running maximum in order of cost, worked out within ranges of cost and over the ranges' maxima: no pairs, no single task."""
    m = table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("cost"), F.avg("p_size").alias("quality"))
    best = m.groupBy("cost").agg(F.max("quality").alias("quality"))
    cuts = sorted(set(best.approxQuantile("cost", [k / 32 for k in range(1, 32)], 0.01)))
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("cost"))) if cuts else F.lit(0)
    best = best.withColumn("part", part)
    tops = best.groupBy("part").agg(F.max("quality").alias("top"))
    earlier = tops.withColumn("earlier", F.max("top").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).select("part", "earlier")  # 32 rows at most
    within = F.max("quality").over(Window.partitionBy("part").orderBy("cost").rowsBetween(Window.unboundedPreceding, -1))
    before = best.withColumn("within", within).join(F.broadcast(earlier), "part").withColumn("before", F.greatest("within", "earlier"))
    front = before.where(F.col("before").isNull() | (F.col("quality") > F.col("before"))).select("cost", "quality")
    return m.join(front, ["cost", "quality"], "left_semi").select("p_brand")


@query("repeatability", "SELECT l_suppkey, round(avg(l_discount), 6) AS mean, round(coalesce(stddev_samp(l_discount), 0), 6) AS std, min(l_discount) AS low, max(l_discount) AS high FROM lineitem GROUP BY ALL")
def repeatability(spark, d):
    x = F.col("l_discount")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(x), F.lit(0.0)), 6).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"))
