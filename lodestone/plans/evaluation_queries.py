"""Queries of end-to-end scores, agreement, significance, gates and diagnoses.

`orders` stands for run records: one case each, whose outcome a rule on its key gives, so all counts grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import statistics as X
from lodestone.plans import registry as S
from lodestone.plans.metric_queries import _RUN, judged
from lodestone.plans.registry import query, table

_RUNS = """(SELECT *, least(points, h // 10 % 6) AS point_hits, least(cited, h // 100 % 7) AS cited_ok, least(g, h % 4) AS sat, least(g, least(g, h % 4) + h % 2) AS cand, greatest(least(g, h % 4) - h % 2, 0) AS first_sat FROM (
SELECT o_orderkey AS case_id, o_orderpriority AS category, o_orderstatus AS domain, o_orderkey * 7919 % 1000 AS h, 1 + o_orderkey % 3 AS g, 1 + o_orderkey * 7919 % 1000 % 5 AS points, o_orderkey * 7919 % 1000 % 6 AS cited, o_totalprice / 1000 AS latency FROM orders))"""


def runs(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    base = table(spark, d, "orders").select(k.alias("case_id"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("domain"), (k * 7919 % 1000).alias("h"), (1 + k % 3).alias("g"), (F.col("o_totalprice") / 1000).alias("latency"))
    h = F.col("h")
    base = base.withColumns({"points": 1 + h % 5, "cited": h % 6, "sat": F.least("g", h % 4)})
    return base.withColumns({"point_hits": F.least("points", F.floor(h / 10) % 6), "cited_ok": F.least("cited", F.floor(h / 100) % 7), "cand": F.least("g", F.col("sat") + h % 2), "first_sat": F.greatest(F.col("sat") - h % 2, F.lit(0))})


def flag(c: Column) -> Column:
    return c.cast("double")


def mean(c: Column, digits: int = 4) -> Column:
    return F.round(F.avg(c), digits)


def one(df: DataFrame) -> DataFrame:
    """A side that is one row by its aggregate."""
    return F.broadcast(df)


_E2E = {
    "retrieval_success": ("CASE WHEN case_id % 10 <> 0 THEN CAST(sat = g AS DOUBLE) END", lambda: F.when(F.col("case_id") % 10 != 0, flag(F.col("sat") == F.col("g")))),
    "answer_point_coverage": ("point_hits / points", lambda: F.col("point_hits") / F.col("points")),
    "citation_accuracy": (
        "CASE WHEN case_id % 10 = 0 THEN CAST(cited = 0 AS DOUBLE) WHEN cited > 0 THEN cited_ok / cited ELSE 0 END",
        lambda: F.when(F.col("case_id") % 10 == 0, flag(F.col("cited") == 0)).when(F.col("cited") > 0, F.col("cited_ok") / F.col("cited")).otherwise(0.0),
    ),
    "groundedness": ("CAST(h % 97 <> 0 AND h % 13 <> 0 AS DOUBLE)", lambda: flag((F.col("h") % 97 != 0) & (F.col("h") % 13 != 0))),
    "abstention_accuracy": ("CAST((h % 9 = 0) = (case_id % 10 = 0) AS DOUBLE)", lambda: flag((F.col("h") % 9 == 0) == (F.col("case_id") % 10 == 0))),
    "conflict_detection_accuracy": ("CAST((h % 7 = 0) = (case_id % 8 = 0) AS DOUBLE)", lambda: flag((F.col("h") % 7 == 0) == (F.col("case_id") % 8 == 0))),
    "fault_recovery_rate": ("CASE WHEN case_id % 11 = 0 THEN CAST(h % 2 = 0 AND point_hits > 0 AS DOUBLE) END", lambda: F.when(F.col("case_id") % 11 == 0, flag((F.col("h") % 2 == 0) & (F.col("point_hits") > 0)))),
    "forbidden_hit_rate": ("CAST(h % 97 = 0 AS DOUBLE)", lambda: flag(F.col("h") % 97 == 0)),
}


@query(
    "e2e_summary",
    "SELECT coalesce(category, 'overall') AS category, count(*) AS cases, count(*) - count(" + _E2E["retrieval_success"][0] + ") AS retrieval_success_na, "
    + ", ".join(f"round(avg({s}), 4) AS {n}" for n, (s, _) in _E2E.items())
    + f", round(quantile_cont(latency, 0.5), 2) AS p50_ms, round(quantile_cont(latency, 0.95), 2) AS p95_ms, round(quantile_cont(latency, 0.99), 2) AS p99_ms FROM {_RUNS} GROUP BY ROLLUP (category)",
)
def e2e_summary(spark, d):
    """AGG10: scores of answers over all cases and by category; a case that should abstain has no retrieval score."""
    scored = runs(spark, d).withColumns({n: c() for n, (_, c) in _E2E.items()})
    points = {f"p{q}_ms": q / 100 for q in (50, 95, 99)}
    late = X.percentiles(scored, ["category"], "latency", points).unionByName(X.percentiles(scored, [], "latency", points).withColumn("category", F.lit("overall")))
    out = scored.rollup("category").agg(F.count(F.lit(1)).alias("cases"), (F.count(F.lit(1)) - F.count("retrieval_success")).alias("retrieval_success_na"), *(mean(F.col(n)).alias(n) for n in _E2E))
    out = out.withColumn("category", F.coalesce("category", F.lit("overall")))
    return out.join(late, "category", "left").withColumns({n: F.round(n, 2) for n in points})


# The least (for the last: the largest) score of a release.
_GATES = {"answer_point_coverage": 0.5, "citation_accuracy": 0.4, "groundedness": 0.9, "forbidden_hit_rate": 0.05}


@query(
    "e2e_gate",
    "WITH o AS (SELECT " + ", ".join(f"round(avg({_E2E[n][0]}), 4) AS {n}" for n in _GATES) + f" FROM {_RUNS}) "
    + " UNION ALL ".join(f"SELECT '{n}' AS metric, {n} AS value, CAST({t} AS DOUBLE) AS threshold, {n} {'<=' if n.startswith('forbidden') else '>='} {t} AS ok FROM o" for n, t in _GATES.items()),
)
def e2e_gate(spark, d):
    """AGG10 and AGG50: each score with its threshold."""
    o = runs(spark, d).agg(*(mean(_E2E[n][1]()).alias(n) for n in _GATES))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"), F.lit(float(t)).alias("threshold"), (F.col(n) <= t if n.startswith("forbidden") else F.col(n) >= t).alias("ok")) for n, t in _GATES.items())))
    return o.select(rows.alias("x")).select("x.*")


@query(
    "agentic_lift",
    f"""SELECT domain, count(*) AS total_cases, count_if(first_sat < g) AS first_failed, round(count_if(first_sat < g AND sat = g) / nullif(count_if(first_sat < g), 0), 6) AS recovery_rate, round(avg((sat - first_sat) / g), 6) AS coverage_lift,
round(count_if(h % 3 > 0 AND first_sat >= g) / count(*), 6) AS unnecessary_rate, round(count_if(h % 5 < 2 AND first_sat < g) / nullif(count_if(h % 5 < 2), 0), 6) AS critic_precision, round(count_if(h % 5 < 2 AND first_sat < g) / nullif(count_if(first_sat < g), 0), 6) AS critic_recall FROM {_RUNS} GROUP BY ALL""",
)
def agentic_lift(spark, d):
    """AGG11: what a second retrieval gained, and how well the critic asked for it."""
    failed, again, good = F.col("first_sat") < F.col("g"), F.col("h") % 5 < 2, F.col("sat") == F.col("g")
    n = F.count(F.lit(1))

    def share(of, out):
        return F.round(F.count_if(of) / F.nullif(F.count_if(out), F.lit(0)), 6)

    return runs(spark, d).groupBy("domain").agg(
        n.alias("total_cases"), F.count_if(failed).alias("first_failed"), share(failed & good, failed).alias("recovery_rate"), F.round(F.avg((F.col("sat") - F.col("first_sat")) / F.col("g")), 6).alias("coverage_lift"),
        F.round(F.count_if((F.col("h") % 3 > 0) & ~failed) / n, 6).alias("unnecessary_rate"), share(again & failed, again).alias("critic_precision"), share(again & failed, failed).alias("critic_recall"),
    )


@query(
    "strategy_compare",
    f"""SELECT domain, round(avg(first_sat / g), 6) AS one_shot, round(avg(sat / g), 6) AS agentic, round(avg(sat / g) - avg(first_sat / g), 6) AS lift, round(avg(1 + h % 3), 6) AS attempts FROM {_RUNS} GROUP BY ALL""",
)
def strategy_compare(spark, d):
    """AGG13: both strategies beside each other, from one row each a case."""
    both = runs(spark, d).select("domain", "case_id", F.explode(F.array(F.struct(F.lit("one_shot").alias("s"), (F.col("first_sat") / F.col("g")).alias("v")), F.struct(F.lit("agentic").alias("s"), (F.col("sat") / F.col("g")).alias("v")))).alias("x"), (1 + F.col("h") % 3).alias("n"))
    p = both.select("domain", "x.s", "x.v", "n").groupBy("domain").pivot("s", ["one_shot", "agentic"]).agg(F.avg("v").alias("v"), F.avg("n").alias("n"))
    return p.select("domain", F.round("one_shot_v", 6).alias("one_shot"), F.round("agentic_v", 6).alias("agentic"), F.round(F.col("agentic_v") - F.col("one_shot_v"), 6).alias("lift"), F.round("agentic_n", 6).alias("attempts"))


@query(
    "trajectory_metrics",
    f"SELECT category, round(avg(1 + h % 3), 6) AS mean_attempts, round(count_if(sat = g) / count(*), 6) AS loop_success, round(sum(greatest(h % 3 - (g - first_sat), 0)) / sum(1 + h % 3), 6) AS unnecessary_share, round(sum(latency) / nullif(count_if(sat = g), 0), 4) AS latency_per_success FROM {_RUNS} GROUP BY ALL",
)
def trajectory_metrics(spark, d):
    """AGG12."""
    tries, good = 1 + F.col("h") % 3, F.col("sat") == F.col("g")
    return runs(spark, d).groupBy("category").agg(
        F.round(F.avg(tries), 6).alias("mean_attempts"), F.round(F.count_if(good) / F.count(F.lit(1)), 6).alias("loop_success"),
        F.round(F.sum(F.greatest(F.col("h") % 3 - (F.col("g") - F.col("first_sat")), F.lit(0))) / F.sum(tries), 6).alias("unnecessary_share"), F.round(F.sum("latency") / F.nullif(F.count_if(good), F.lit(0)), 4).alias("latency_per_success"),
    )


_AT = "(SELECT unnest([1, 3, 5, 10]) AS k)"


@query(
    "report_by_k",
    _RUN + f"""SELECT ql AS label, k, round(avg(hits / k), 6) AS precision, round(avg(CAST(hits > 0 AS INT)), 6) AS hit_rate, round(avg(CASE WHEN first <= k THEN 1.0 / first ELSE 0 END), 6) AS mrr, count_if(hits = 0) AS empty
FROM (SELECT query_id, any_value(ql) AS ql, k, count_if(rel AND rank <= k) AS hits, min(CASE WHEN rel THEN rank END) AS first FROM j, {_AT} GROUP BY query_id, k) GROUP BY ALL""",
)
def report_by_k(spark, d):
    """AGG1, AGG5 and AGG6: scores of a case at several cuts, and their means by domain."""
    each = judged(spark, d).withColumn("k", F.explode(F.array(*map(F.lit, (1, 3, 5, 10)))))
    c = each.groupBy("query_id", "ql", "k").agg(F.count_if(F.col("rel") & (F.col("rank") <= F.col("k"))).alias("hits"), F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"))
    return c.groupBy(F.col("ql").alias("label"), "k").agg(
        F.round(F.avg(F.col("hits") / F.col("k")), 6).alias("precision"), F.round(F.avg((F.col("hits") > 0).cast("int")), 6).alias("hit_rate"),
        F.round(F.avg(F.when(F.col("first") <= F.col("k"), 1.0 / F.col("first")).otherwise(0.0)), 6).alias("mrr"), F.count_if(F.col("hits") == 0).alias("empty"),
    )


@query("worst_cases", f"SELECT category, case_id, round(point_hits / points, 4) AS score FROM {_RUNS} QUALIFY row_number() OVER (PARTITION BY category ORDER BY round(point_hits / points, 4), case_id) <= 5")
def worst_cases(spark, d):
    """AGG6: the five worst of each category; the filter on the rank keeps each task's own five before they are shuffled."""
    r = runs(spark, d).select("category", "case_id", F.round(F.col("point_hits") / F.col("points"), 4).alias("score"))
    return r.withColumn("n", F.row_number().over(Window.partitionBy("category").orderBy("score", "case_id"))).where("n <= 5").drop("n")


_GROUPS = """, gg AS (SELECT label AS ql, count(DISTINCT vec_id % 3) AS n_groups, count(*) - 1 AS n_rel FROM embeddings GROUP BY ALL), c AS (SELECT query_id, any_value(ql) AS ql, count(DISTINCT CASE WHEN rel AND rank <= 5 THEN doc_id % 3 END) AS g5,
count(DISTINCT CASE WHEN rel THEN doc_id % 3 END) AS g10, count_if(rel AND rank <= 5) AS hits, min(CASE WHEN rel THEN rank END) AS first, count_if(doc_id % 17 = 0 AND rank <= 5) AS forbidden FROM j GROUP BY query_id)"""


@query(
    "group_metrics",
    _RUN + _GROUPS + """SELECT query_id, round(g10 / n_groups, 6) AS candidate_coverage, round(g5 / n_groups, 6) AS group_recall, g5 = n_groups AS all_groups, round(hits / 5, 6) AS precision,
round(CASE WHEN n_rel > 0 THEN (hits / 5) / (least(5, n_rel) / 5) ELSE 0 END, 6) AS normalised_precision, round(coalesce(1.0 / first, 0), 6) AS mrr, forbidden > 0 AS forbidden_hit FROM c JOIN gg USING (ql)""",
)
def group_metrics(spark, d):
    """AGG7 and JN11: a query's gold is three groups (its label's keys by remainder); one key satisfies a group."""
    own = table(spark, d, "embeddings")
    gold = own.groupBy(F.col("label").alias("ql")).agg(F.count_distinct(F.col("vec_id") % 3).alias("n_groups"), (F.count(F.lit(1)) - 1).alias("n_rel"))
    group, top = F.col("doc_id") % 3, F.col("rank") <= 5
    c = judged(spark, d).groupBy("query_id", "ql").agg(
        F.count_distinct(F.when(F.col("rel") & top, group)).alias("g5"), F.count_distinct(F.when(F.col("rel"), group)).alias("g10"), F.count_if(F.col("rel") & top).alias("hits"),
        F.min(F.when(F.col("rel"), F.col("rank"))).alias("first"), F.count_if((F.col("doc_id") % 17 == 0) & top).alias("forbidden"),
    )
    norm = F.when(F.col("n_rel") > 0, (F.col("hits") / 5) / (F.least(F.lit(5), F.col("n_rel")) / 5)).otherwise(0.0)
    return c.join(gold, "ql").select(
        "query_id", F.round(F.col("g10") / F.col("n_groups"), 6).alias("candidate_coverage"), F.round(F.col("g5") / F.col("n_groups"), 6).alias("group_recall"), (F.col("g5") == F.col("n_groups")).alias("all_groups"),
        F.round(F.col("hits") / 5, 6).alias("precision"), F.round(norm, 6).alias("normalised_precision"), F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), (F.col("forbidden") > 0).alias("forbidden_hit"),
    )


@query(
    "scoring_policy",
    _RUN + _GROUPS + """SELECT ql AS label, count(*) AS cases, count_if(eligible) AS eligible, round(avg(CASE WHEN eligible THEN g5 / need END), 6) AS recall_eligible, round(avg(CASE WHEN eligible THEN g5 / need ELSE 0 END), 6) AS recall_all, round(avg(CAST(forbidden > 0 AS INT)), 6) AS forbidden_rate
FROM (SELECT c.*, n_groups - CAST(query_id % 4 = 0 AS INT) AS need, n_groups - CAST(query_id % 4 = 0 AS INT) > 0 AND query_id % 5 <> 0 AS eligible FROM c JOIN gg USING (ql)) GROUP BY ALL""",
)
def scoring_policy(spark, d):
    """AGG8: groups of injected evidence do not count as required; means over the eligible cases, and over all with 0 for the others."""
    own = table(spark, d, "embeddings").groupBy(F.col("label").alias("ql")).agg(F.count_distinct(F.col("vec_id") % 3).alias("n_groups"))
    top = F.col("rank") <= 5
    c = judged(spark, d).groupBy("query_id", "ql").agg(F.count_distinct(F.when(F.col("rel") & top, F.col("doc_id") % 3)).alias("g5"), F.count_if((F.col("doc_id") % 17 == 0) & top).alias("forbidden"))
    x = c.join(own, "ql").withColumn("need", F.col("n_groups") - (F.col("query_id") % 4 == 0).cast("int")).withColumn("eligible", (F.col("need") > 0) & (F.col("query_id") % 5 != 0))
    v = F.col("g5") / F.col("need")
    return x.groupBy(F.col("ql").alias("label")).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("eligible").alias("eligible"), F.round(F.avg(F.when(F.col("eligible"), v)), 6).alias("recall_eligible"), F.round(F.avg(F.when(F.col("eligible"), v).otherwise(0.0)), 6).alias("recall_all"),
        F.round(F.avg((F.col("forbidden") > 0).cast("int")), 6).alias("forbidden_rate"),
    )


@query("data_plane_summary", f"SELECT domain AS mode, count(*) AS cases, round(avg(sat / g), 6) AS group_recall, round(quantile_cont(latency, 0.5), 4) AS p50, round(quantile_cont(latency, 0.95), 4) AS p95, round(quantile_cont(latency, 0.99), 4) AS p99 FROM {_RUNS} GROUP BY ALL")
def data_plane_summary(spark, d):
    """AGG9: linear percentiles."""
    r = runs(spark, d).withColumnRenamed("domain", "mode")
    p = X.percentiles(r, ["mode"], "latency", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return r.groupBy("mode").agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg(F.col("sat") / F.col("g")), 6).alias("group_recall")).join(p, "mode", "left").withColumns({n: F.round(n, 4) for n in ("p50", "p95", "p99")})


_PAIR = "(SELECT o_orderkey AS case_id, o_orderstatus AS domain, o_orderkey * 7919 % 5 AS a, (o_orderkey * 7919 % 5 + CAST(o_orderkey % 7 = 0 AS INT)) % 5 AS b, o_orderkey % 13 <> 0 AS has_a, o_orderkey % 17 <> 0 AS has_b FROM orders)"


def paired(spark, d) -> DataFrame:
    """Two annotators' ratings 0 … 4 of the cases, some rated by one alone."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(k.alias("case_id"), F.col("o_orderstatus").alias("domain"), (k * 7919 % 5).alias("a"), ((k * 7919 % 5 + (k % 7 == 0).cast("int")) % 5).alias("b"), (k % 13 != 0).alias("has_a"), (k % 17 != 0).alias("has_b"))


@query(
    "router_report",
    f"""WITH c AS (SELECT a, b, count(*) AS n FROM {_PAIR} GROUP BY ALL), r AS (SELECT a AS class, sum(n) AS gold, sum(CASE WHEN a = b THEN n ELSE 0 END) AS tp FROM c GROUP BY ALL), p AS (SELECT b AS class, sum(n) AS said FROM c GROUP BY ALL), f AS (SELECT class, tp / said AS precision, tp / gold AS recall FROM r JOIN p USING (class))
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(2 * precision * recall / nullif(precision + recall, 0), 6) AS f1, round(avg(2 * precision * recall / nullif(precision + recall, 0)) OVER (), 6) AS macro_f1, (SELECT round(sum(CASE WHEN a = b THEN n ELSE 0 END) / sum(n), 6) FROM c) AS accuracy FROM f""",
)
def router_report(spark, d):
    """AGG14: precision, recall and F1 by class from the counts of pairs, macro-F1 and accuracy."""
    c = paired(spark, d).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    same = F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)
    r = c.groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("gold"), F.sum(same).alias("tp"))
    f = r.join(c.groupBy(F.col("b").alias("class")).agg(F.sum("n").alias("said")), "class").select("class", (F.col("tp") / F.col("said")).alias("p"), (F.col("tp") / F.col("gold")).alias("r"))
    f = f.withColumn("f", 2 * F.col("p") * F.col("r") / F.nullif(F.col("p") + F.col("r"), F.lit(0.0)))
    whole = f.agg(F.round(F.avg("f"), 6).alias("macro_f1")).crossJoin(one(c.agg(F.round(F.sum(same) / F.sum("n"), 6).alias("accuracy"))))
    return f.crossJoin(one(whole)).select("class", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round("f", 6).alias("f1"), "macro_f1", "accuracy")


@query(
    "agreement_alpha",
    f"""WITH p AS (SELECT CASE WHEN has_a THEN a END AS a, CASE WHEN has_b THEN b END AS b FROM {_PAIR}), o AS (SELECT sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS nominal, CAST(sum(abs(a - b)) AS DOUBLE) AS ordinal FROM p WHERE a IS NOT NULL AND b IS NOT NULL),
v AS (SELECT v, count(*) AS n FROM (SELECT a AS v FROM p UNION ALL SELECT b FROM p) WHERE v IS NOT NULL GROUP BY ALL), s AS (SELECT v, n / sum(n) OVER () AS share FROM v), e AS (SELECT sum(CASE WHEN x.v <> y.v THEN x.share * y.share ELSE 0 END) AS nominal, sum(x.share * y.share * abs(x.v - y.v)) AS ordinal FROM s x, s y)
SELECT 'nominal' AS level, round(CASE WHEN o.nominal = 0 OR e.nominal = 0 THEN 1 ELSE 1 - o.nominal / e.nominal END, 4) AS alpha FROM o, e UNION ALL SELECT 'ordinal', round(CASE WHEN o.ordinal = 0 OR e.ordinal = 0 THEN 1 ELSE 1 - o.ordinal / e.ordinal END, 4) FROM o, e""",
)
def agreement_alpha(spark, d):
    """AGG16 as the reference has it: observed disagreement is a sum over units, not a mean."""
    p = paired(spark, d).select(F.when(F.col("has_a"), F.col("a")).alias("a"), F.when(F.col("has_b"), F.col("b")).alias("b"))
    o = p.where("a is not null and b is not null").agg(F.sum((F.col("a") != F.col("b")).cast("double")).alias("on"), F.sum(F.abs(F.col("a") - F.col("b"))).cast("double").alias("oo"))
    v = p.select(F.explode(F.array("a", "b")).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    s = v.crossJoin(one(v.agg(F.sum("n").alias("all")))).select("v", (F.col("n") / F.col("all")).alias("share"))
    both = s.crossJoin(F.broadcast(s.withColumnsRenamed({"v": "w", "share": "other"})))  # categories: a handful
    w = F.col("share") * F.col("other")
    e = both.agg(F.sum(F.when(F.col("v") != F.col("w"), w).otherwise(0.0)).alias("en"), F.sum(w * F.abs(F.col("v") - F.col("w"))).alias("eo"))

    def alpha(a, b):
        return F.round(F.when((a == 0) | (b == 0), 1.0).otherwise(1 - a / b), 4)

    rows = F.explode(F.array(F.struct(F.lit("nominal").alias("level"), alpha(F.col("on"), F.col("en")).alias("alpha")), F.struct(F.lit("ordinal").alias("level"), alpha(F.col("oo"), F.col("eo")).alias("alpha"))))
    return o.crossJoin(one(e)).select(rows.alias("x")).select("x.*")


@query(
    "weighted_kappa",
    f"""WITH c AS (SELECT a, b, count(*) AS n FROM {_PAIR} WHERE has_a AND has_b GROUP BY ALL), t AS (SELECT sum(n) AS n FROM c), ma AS (SELECT a, sum(n) AS n FROM c GROUP BY ALL), mb AS (SELECT b, sum(n) AS n FROM c GROUP BY ALL),
o AS (SELECT sum(abs(a - b) / 4 * c.n) / any_value(t.n) AS v FROM c, t), e AS (SELECT sum(abs(a - b) / 4 * ma.n * mb.n) / any_value(t.n) / any_value(t.n) AS v FROM ma, mb, t) SELECT round(1 - o.v / e.v, 6) AS kappa FROM o, e""",
)
def weighted_kappa(spark, d):
    """AGG15 with linear weights, from the marginals."""
    c = paired(spark, d).where("has_a and has_b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    t = c.agg(F.sum("n").alias("t"), F.sum(F.abs(F.col("a") - F.col("b")) / 4 * F.col("n")).alias("o"))
    ma, mb = c.groupBy("a").agg(F.sum("n").alias("na")), c.groupBy("b").agg(F.sum("n").alias("nb"))
    e = ma.crossJoin(F.broadcast(mb)).agg(F.sum(F.abs(F.col("a") - F.col("b")) / 4 * F.col("na") * F.col("nb")).alias("e"))  # five classes each
    return t.crossJoin(one(e)).select(F.round(1 - (F.col("o") / F.col("t")) / (F.col("e") / F.col("t") / F.col("t")), 6).alias("kappa"))


@query(
    "adjudication",
    f"""SELECT domain, count_if(has_a AND has_b) AS gold, count_if(has_a AND has_b AND (a >= 3) <> (b >= 3)) AS disputes, count_if(has_a <> has_b) AS missing, count_if(has_a AND has_b AND a >= 3 AND b >= 3) AS passed, round(avg(CASE WHEN has_a AND has_b THEN (a + b) / 2 END), 6) AS mean_score FROM {_PAIR} GROUP BY ALL""",
)
def adjudication(spark, d):
    """AGG18 and JN22: both annotators' rows meet by case; unequal verdicts fail and are listed as disputes, one-sided cases are missing."""
    p = paired(spark, d)
    a = p.where("has_a").select("case_id", "domain", F.col("a").alias("sa"))
    b = p.where("has_b").select("case_id", F.col("domain").alias("db"), F.col("b").alias("sb"))
    j = a.join(b, "case_id", "full").withColumn("domain", F.coalesce("domain", "db"))
    both = F.col("sa").isNotNull() & F.col("sb").isNotNull()
    va, vb = F.col("sa") >= 3, F.col("sb") >= 3
    return j.groupBy("domain").agg(F.count_if(both).alias("gold"), F.count_if(both & (va != vb)).alias("disputes"), F.count_if(~both).alias("missing"), F.count_if(both & va & vb).alias("passed"), F.round(F.avg((F.col("sa") + F.col("sb")) / 2), 6).alias("mean_score"))


@query(
    "judge_disagreement",
    f"""SELECT domain, count(*) AS judged, count_if((a >= 3) <> (b >= 3)) AS disagreements, count_if(a < 3 AND b >= 3) AS false_negatives, round(avg(abs(a - b)), 6) AS mae, round(count_if(a < 3 AND b < 3) / nullif(count_if(a < 3), 0), 6) AS fail_recall FROM {_PAIR} WHERE has_a AND has_b GROUP BY ALL""",
)
def judge_disagreement(spark, d):
    """AGG17 and AGG18: a judge against gold; a failed case that the judge passes is a false negative."""
    a, b = F.col("a") >= 3, F.col("b") >= 3
    return paired(spark, d).where("has_a and has_b").groupBy("domain").agg(
        F.count(F.lit(1)).alias("judged"), F.count_if(a != b).alias("disagreements"), F.count_if(~a & b).alias("false_negatives"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 6).alias("mae"),
        F.round(F.count_if(~a & ~b) / F.nullif(F.count_if(~a), F.lit(0)), 6).alias("fail_recall"),
    )


@query(
    "mcnemar_test",
    f"""WITH p AS (SELECT domain, count_if(a >= 2 AND b < 2) AS b, count_if(a < 2 AND b >= 2) AS c FROM {_PAIR} GROUP BY ALL), x AS (SELECT *, CASE WHEN b + c = 0 THEN 0.0 ELSE power(abs(b - c) - 1, 2) / (b + c) END AS chi2 FROM p)
SELECT domain, b, c, round(chi2, 6) AS chi2, round(CASE WHEN b + c = 0 OR chi2 <= 0 THEN 1.0 ELSE {X.sf_sql('sqrt(chi2)')} END, 6) AS p_value FROM x""",
)
def mcnemar_test(spark, d):
    """AGG20 with its p-value: one tail of the normal distribution at the root of chi-squared."""
    p = paired(spark, d).groupBy("domain").agg(F.count_if((F.col("a") >= 2) & (F.col("b") < 2)).alias("b"), F.count_if((F.col("a") < 2) & (F.col("b") >= 2)).alias("c"))
    n = F.col("b") + F.col("c")
    x = p.withColumn("chi2", F.when(n == 0, 0.0).otherwise(F.pow(F.abs(F.col("b") - F.col("c")) - 1, F.lit(2.0)) / n))
    return x.select("domain", "b", "c", F.round("chi2", 6).alias("chi2"), F.round(F.when((n == 0) | (F.col("chi2") <= 0), 1.0).otherwise(X.normal_sf(F.sqrt("chi2"))), 6).alias("p_value"))


@query(
    "wilcoxon_test",
    f"""WITH x AS (SELECT domain, b - a AS delta FROM {_PAIR} WHERE a <> b), r AS (SELECT domain, delta, rank() OVER (PARTITION BY domain ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY domain, abs(delta)) - 1) / 2 AS r FROM x),
s AS (SELECT domain, count(*) AS n, sum(CASE WHEN delta > 0 THEN r ELSE 0 END) AS up, sum(CASE WHEN delta < 0 THEN r ELSE 0 END) AS down FROM r GROUP BY ALL), z AS (SELECT *, (least(up, down) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2.0 * n + 1) / 24) AS z FROM s)
SELECT domain, n, round(least(up, down), 1) AS w, round(z, 6) AS z, round(least(1.0, 2 * {X.sf_sql('abs(z)')}), 6) AS p_value FROM z""",
)
def wilcoxon_test(spark, d):
    """AGG21 with z and p. Ranks come from counts by size of the difference, so no partition holds more rows than there are sizes."""
    sizes = paired(spark, d).where("a <> b").select("domain", (F.col("b") - F.col("a")).alias("delta")).groupBy("domain", F.abs("delta").alias("m")).agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("delta") > 0).alias("ups"))
    before = F.sum("all").over(Window.partitionBy("domain").orderBy("m")) - F.col("all")
    ranked = sizes.withColumn("r", before + (F.col("all") + 1) / 2)
    s = ranked.groupBy("domain").agg(F.sum("all").alias("n"), F.sum(F.col("r") * F.col("ups")).alias("up"), F.sum(F.col("r") * (F.col("all") - F.col("ups"))).alias("down"))
    n, w = F.col("n"), F.least("up", "down")
    z = (w - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2.0 * n + 1) / 24)
    return s.select("domain", "n", F.round(w, 1).alias("w"), F.round(z, 6).alias("z"), F.round(F.least(F.lit(1.0), 2 * X.normal_sf(F.abs(z))), 6).alias("p_value"))


@query(
    "ablation_lift",
    f"""WITH m AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'baseline' WHEN 1 THEN 'rerank' WHEN 2 THEN 'expand' ELSE 'fusion' END AS variant, o_orderstatus AS domain, avg(o_totalprice) AS score, count(*) AS n FROM orders GROUP BY ALL)
SELECT m.variant, m.domain, m.n, round(m.score, 4) AS score, round(m.score - b.score, 4) AS lift, round((m.score - b.score) / b.score, 6) AS relative FROM m JOIN m b ON b.variant = 'baseline' AND b.domain = m.domain""",
)
def ablation_lift(spark, d):
    """AGG23 and JN19: each variant beside the baseline of its domain."""
    k = F.col("o_orderkey") % 4
    m = table(spark, d, "orders").groupBy(F.when(k == 0, "baseline").when(k == 1, "rerank").when(k == 2, "expand").otherwise("fusion").alias("variant"), F.col("o_orderstatus").alias("domain")).agg(F.avg("o_totalprice").alias("score"), F.count(F.lit(1)).alias("n"))
    b = m.where("variant = 'baseline'").select("domain", F.col("score").alias("base"))
    return m.join(b, "domain").select("variant", "domain", "n", F.round("score", 4).alias("score"), F.round(F.col("score") - F.col("base"), 4).alias("lift"), F.round((F.col("score") - F.col("base")) / F.col("base"), 6).alias("relative"))


#: Replicates of the bootstrap, and how a case is drawn: so many times as a Poisson draw of mean 1 by a hash of (case, replicate).
_DRAWS = 200
_POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]


def _weight_sql(u: str) -> str:
    return " + ".join(f"CASE WHEN {u} >= {p!r} THEN 1 ELSE 0 END" for p in _POISSON)


def poisson_weight(key: Column, replicate: Column) -> Column:
    u = F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), replicate.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
    out = F.lit(0)
    for p in _POISSON:
        out = out + F.when(u >= p, 1).otherwise(0)
    return out


_U = "CAST(('0x' || substr(md5(case_id || ':' || i), 1, 8)) AS BIGINT) / 4294967296.0"


@query(
    "paired_bootstrap",
    f"""WITH r AS (SELECT domain, i, sum(w * (sat - first_sat) / g) / nullif(sum(w), 0) AS lift FROM (SELECT domain, i, sat, first_sat, g, {_weight_sql(_U)} AS w FROM {_RUNS}, range({_DRAWS}) t(i)) GROUP BY ALL)
SELECT domain, round(quantile_cont(lift, 0.025), 6) AS low, round(quantile_cont(lift, 0.975), 6) AS high, round(avg(lift), 6) AS mean FROM r GROUP BY ALL""",
)
def paired_bootstrap(spark, d):
    """AGG19 and AGG22: resamples as Poisson weights by a hash, so replicates need no shuffle of cases and any run gives the same."""
    i = F.explode(F.sequence(F.lit(0), F.lit(_DRAWS - 1))).alias("i")
    r = runs(spark, d).select("domain", "case_id", ((F.col("sat") - F.col("first_sat")) / F.col("g")).alias("v"), i).withColumn("w", poisson_weight(F.col("case_id"), F.col("i")))
    r = r.groupBy("domain", "i").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0))).alias("lift"))
    return r.groupBy("domain").agg(F.round(F.percentile("lift", 0.025), 6).alias("low"), F.round(F.percentile("lift", 0.975), 6).alias("high"), F.round(F.avg("lift"), 6).alias("mean"))


@query(
    "regression_gate",
    f"""WITH b AS (SELECT avg(sat / g) AS base FROM {_RUNS}), r AS (SELECT category, i, sum(w * sat / g) / nullif(sum(w), 0) AS m FROM (SELECT category, i, sat, g, {_weight_sql(_U)} AS w FROM {_RUNS}, range({_DRAWS}) t(i)) GROUP BY ALL),
c AS (SELECT category, list_sort(list(m))[CAST(floor({_DRAWS} * 0.05) AS INT) + 1] AS low FROM r GROUP BY ALL), m AS (SELECT category, avg(sat / g) AS mean, count(*) AS n, count_if(h % 97 = 0) AS critical FROM {_RUNS} GROUP BY ALL)
SELECT category, n, round(mean, 6) AS mean, round(low, 6) AS ci_lower, CASE WHEN critical > 0 AND category = '1-URGENT' THEN 'hard_fail' WHEN (CASE WHEN n >= 30 THEN low ELSE mean END) < base * 0.95 THEN 'soft_fail' ELSE 'pass' END AS verdict FROM m JOIN c USING (category), b""",
)
def regression_gate(spark, d):
    """AGG24: a domain regresses if the lower end of its interval is under 95 % of the baseline; a critical case fails the gate at once."""
    i = F.explode(F.sequence(F.lit(0), F.lit(_DRAWS - 1))).alias("i")
    v = F.col("sat") / F.col("g")
    each = runs(spark, d)
    r = each.select("category", "case_id", v.alias("v"), i).withColumn("w", poisson_weight(F.col("case_id"), F.col("i"))).groupBy("category", "i").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    c = r.groupBy("category").agg(F.element_at(F.sort_array(F.collect_list("m")), int(_DRAWS * 0.05) + 1).alias("low"))  # one value a replicate
    m = each.groupBy("category").agg(F.avg(v).alias("mean"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("h") % 97 == 0).alias("critical"))
    j = m.join(c, "category").crossJoin(one(each.agg(F.avg(v).alias("base"))))
    verdict = F.when((F.col("critical") > 0) & (F.col("category") == "1-URGENT"), "hard_fail").when(F.when(F.col("n") >= 30, F.col("low")).otherwise(F.col("mean")) < F.col("base") * 0.95, "soft_fail").otherwise("pass")
    return j.select("category", "n", F.round("mean", 6).alias("mean"), F.round("low", 6).alias("ci_lower"), verdict.alias("verdict"))


@query(
    "bottleneck",
    f"SELECT category, round(avg(cand / g), 6) AS candidate_recall, round(avg(sat / g), 6) AS passage_recall, CASE WHEN avg(cand / g) >= 0.9 AND avg(sat / g) < avg(cand / g) - 0.1 THEN 'ranking-bound' WHEN avg(cand / g) < 0.85 THEN 'recall-bound' ELSE 'balanced' END AS verdict FROM {_RUNS} GROUP BY ALL",
)
def bottleneck(spark, d):
    """AGG26."""
    m = runs(spark, d).groupBy("category").agg(F.avg(F.col("cand") / F.col("g")).alias("c"), F.avg(F.col("sat") / F.col("g")).alias("p"))
    verdict = F.when((F.col("c") >= 0.9) & (F.col("p") < F.col("c") - 0.1), "ranking-bound").when(F.col("c") < 0.85, "recall-bound").otherwise("balanced")
    return m.select("category", F.round("c", 6).alias("candidate_recall"), F.round("p", 6).alias("passage_recall"), verdict.alias("verdict"))


_CLASS = """CASE WHEN h % 97 = 0 THEN 'SECURITY_FORBIDDEN' WHEN cand = 0 THEN (CASE WHEN h % 3 = 0 THEN 'RECALL_DENSE_MISS_ONLY' WHEN h % 3 = 1 THEN 'RECALL_BM25_MISS_ONLY' ELSE 'RECALL_BOTH_MISS' END) WHEN g > 1 AND sat < g THEN (CASE WHEN sat > 0 THEN 'MULTI_HOP_INCOMPLETE' ELSE 'RANK_HIT_FINAL_MISS' END)
WHEN sat = 0 THEN 'RANK_HIT_FINAL_MISS' ELSE 'SUCCESS' END"""


@query("failure_classes", f"WITH c AS (SELECT {_CLASS} AS class FROM {_RUNS}) SELECT class, cases, round(cases / sum(cases) OVER (), 6) AS share, row_number() OVER (ORDER BY cases DESC, class) <= 3 AS among_top_three FROM (SELECT class, count(*) AS cases FROM c GROUP BY ALL)")
def failure_classes(spark, d):
    """AGG25: forbidden evidence first, then what the first stage missed and for which retriever, then what ranking lost."""
    h = F.col("h")
    missed = F.when(h % 3 == 0, "RECALL_DENSE_MISS_ONLY").when(h % 3 == 1, "RECALL_BM25_MISS_ONLY").otherwise("RECALL_BOTH_MISS")
    c = (
        F.when(h % 97 == 0, "SECURITY_FORBIDDEN").when(F.col("cand") == 0, missed).when((F.col("g") > 1) & (F.col("sat") < F.col("g")), F.when(F.col("sat") > 0, "MULTI_HOP_INCOMPLETE").otherwise("RANK_HIT_FINAL_MISS"))
        .when(F.col("sat") == 0, "RANK_HIT_FINAL_MISS").otherwise("SUCCESS")
    )
    n = runs(spark, d).groupBy(c.alias("class")).agg(F.count(F.lit(1)).alias("cases"))
    top = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("cases"), "class")) <= 3  # one row a class
    return n.crossJoin(one(n.agg(F.sum("cases").alias("all")))).select("class", "cases", F.round(F.col("cases") / F.col("all"), 6).alias("share"), top.alias("among_top_three"))


# The default alert rules.
_ALERTS = S.Fixture(
    "name string, severity string, metric_name string, threshold double, comparison string",
    [
        ("cross_scope_leakage", "P0", "cross_scope_leakage_count", 0.0, ">"), ("dlp_block_anomaly", "P0", "dlp_block_count_5min", 10.0, ">"), ("error_rate_high", "P1", "error_rate_pct", 5.0, ">"), ("p99_latency_high", "P1", "request_latency_p99_ms", 1500.0, ">"),
        ("circuit_open", "P1", "circuit_open_count", 0.0, ">"), ("cost_spike", "P2", "daily_cost_utilization_pct", 80.0, ">"), ("cache_hit_drop", "P2", "cache_hit_rate_pct", 20.0, "<"), ("index_lag_high", "P1", "index_lag_minutes", 5.0, ">"), ("quality_decline", "P2", "quality_score_decline_count", 3.0, ">="),
    ],
)


@query(
    "default_alerts",
    f"""WITH m AS (SELECT 'error_rate_pct' AS metric_name, round(100.0 * count_if(event_type = 'error') / count(*), 6) AS value FROM events UNION ALL SELECT 'request_latency_p99_ms', round(quantile_cont(value, 0.99) * 10, 6) FROM events UNION ALL SELECT 'dlp_block_count_5min', CAST(max(n) AS DOUBLE) FROM (SELECT count(*) AS n FROM events WHERE event_type = 'error' GROUP BY time_bucket(INTERVAL 5 minutes, ts))
UNION ALL SELECT 'cache_hit_rate_pct', round(100.0 * count_if(event_type = 'view') / count(*), 6) FROM events UNION ALL SELECT 'cross_scope_leakage_count', 0.0 UNION ALL SELECT 'quality_score_decline_count', 3.0)
SELECT name, severity, value, CASE WHEN value IS NULL THEN 'nodata' WHEN CASE comparison WHEN '>' THEN value > threshold WHEN '<' THEN value < threshold WHEN '==' THEN value = threshold ELSE false END THEN 'firing' ELSE 'ok' END AS state FROM {_ALERTS.sql} LEFT JOIN m USING (metric_name)""",
)
def default_alerts(spark, d):
    """FLT17 and STR9: the nine default rules on metrics gathered from events. As in the reference an unknown comparison (>=) never fires."""
    e = table(spark, d, "events")

    def share(kind):
        return F.round(100.0 * F.count_if(F.col("event_type") == kind) / F.count(F.lit(1)), 6)

    p99 = X.percentiles(e, [], "value", {"p": 0.99}).select(F.round(F.col("p") * 10, 6).alias("request_latency_p99_ms"))
    m = e.agg(share("error").alias("error_rate_pct"), share("view").alias("cache_hit_rate_pct")).crossJoin(one(p99))
    blocks = e.where("event_type = 'error'").groupBy(F.window("ts", "5 minutes")).count().agg(F.max("count").cast("double").alias("dlp_block_count_5min"))
    wide = m.crossJoin(one(blocks)).withColumns({"cross_scope_leakage_count": F.lit(0.0), "quality_score_decline_count": F.lit(3.0)})
    long = wide.unpivot([], wide.columns, "metric_name", "value")
    fires = F.when(F.col("comparison") == ">", F.col("value") > F.col("threshold")).when(F.col("comparison") == "<", F.col("value") < F.col("threshold")).when(F.col("comparison") == "==", F.col("value") == F.col("threshold")).otherwise(False)
    return _ALERTS.df(spark).join(F.broadcast(long), "metric_name", "left").select("name", "severity", "value", F.when(F.col("value").isNull(), "nodata").when(fires, "firing").otherwise("ok").alias("state"))  # one row a metric


@query(
    "trajectory_checks",
    """WITH t AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS events FROM events GROUP BY ALL) SELECT user_id, list_contains(events, 'signup') AS task_created, list_contains(events, 'view') AS claimed, NOT list_contains(events, 'error') AS no_error,
list_contains(events, 'purchase') AND (NOT list_contains(events, 'click') OR list_position(events, 'click') > list_position(events, 'purchase')) AS act_before_claim, events[-1] = 'purchase' AS final_accept FROM t""",
)
def trajectory_checks(spark, d):
    """AGG51: ordered rules on a run's events, from the first place of each kind: no task holds a run's whole list."""
    at = F.struct("ts", "event_id")

    def first(kind):
        return F.min(F.when(F.col("event_type") == kind, at))

    g = table(spark, d, "events").groupBy("user_id").agg(first("signup").alias("s"), first("view").alias("v"), first("error").alias("e"), first("purchase").alias("p"), first("click").alias("c"), F.max_by("event_type", at).alias("last"))
    return g.select(
        "user_id", F.col("s").isNotNull().alias("task_created"), F.col("v").isNotNull().alias("claimed"), F.col("e").isNull().alias("no_error"),
        (F.col("p").isNotNull() & (F.col("c").isNull() | (F.col("c") > F.col("p")))).alias("act_before_claim"), (F.col("last") == "purchase").alias("final_accept"),
    )


@query(
    "run_medians",
    "SELECT o_orderpriority AS case_id, metric, round(median(v), 4) AS median, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, count(v) AS samples FROM (SELECT o_orderpriority, unnest([{'metric': 'price', 'v': o_totalprice}, {'metric': 'half', 'v': CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 2 END}], recursive := true) FROM orders) GROUP BY ALL HAVING count(v) > 0",
)
def run_medians(spark, d):
    """XTR1: medians of a case's metrics over several runs; samples that are no numbers are skipped."""
    wide = table(spark, d, "orders").select(F.col("o_orderpriority").alias("case_id"), F.col("o_totalprice").alias("price"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") / 2).alias("half"))
    long = wide.unpivot(["case_id"], ["price", "half"], "metric", "v")
    middle = X.percentiles(long, ["case_id", "metric"], "v", {"median": 0.5}).withColumn("median", F.round("median", 4))
    return long.groupBy("case_id", "metric").agg(F.round(F.avg("v"), 4).alias("mean"), F.round(F.stddev_pop("v"), 4).alias("std"), F.count("v").alias("samples")).where("samples > 0").join(middle, ["case_id", "metric"])


@query(
    "cross_diagnosis",
    f"SELECT CASE WHEN sat = g AND point_hits / points >= 0.5 THEN 'A' WHEN sat = g THEN 'B' WHEN point_hits / points >= 0.5 THEN 'C' ELSE 'D' END AS quadrant, count(*) AS cases, round(avg(latency), 4) AS mean_latency FROM {_RUNS} GROUP BY ALL",
)
def cross_diagnosis(spark, d):
    """XTR3: good and bad retrieval against good and bad answers."""
    r, a = F.col("sat") == F.col("g"), F.col("point_hits") / F.col("points") >= 0.5
    return runs(spark, d).groupBy(F.when(r & a, "A").when(r, "B").when(a, "C").otherwise("D").alias("quadrant")).agg(F.count(F.lit(1)).alias("cases"), F.round(F.avg("latency"), 4).alias("mean_latency"))


@query(
    "rank_retention",
    f"""SELECT domain, round(count_if(sat > 0) / count(*), 6) AS retained_at_5, round(count_if(cand > 0) / count(*), 6) AS gold_in_candidates, round(count_if(cand > 0 AND sat = 0) / count(*), 6) AS rank_loss, list_sort(list(latency))[CAST(round_even(0.95 * (count(*) - 1), 0) AS INT) + 1] AS p95_rounded FROM {_RUNS} GROUP BY ALL""",
)
def rank_retention(spark, d):
    """XTR4 with its percentile by rounded index, found from counts of distinct values rather than a sorted list."""
    r = runs(spark, d)
    n = F.count(F.lit(1))
    m = r.groupBy("domain").agg(n.alias("n"), F.round(F.count_if(F.col("sat") > 0) / n, 6).alias("retained_at_5"), F.round(F.count_if(F.col("cand") > 0) / n, 6).alias("gold_in_candidates"), F.round(F.count_if((F.col("cand") > 0) & (F.col("sat") == 0)) / n, 6).alias("rank_loss"))
    values = r.groupBy("domain", "latency").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(Window.partitionBy("domain").orderBy("latency")))
    at = values.join(m.select("domain", F.bround(0.95 * (F.col("n") - 1), 0).alias("place")), "domain").where(F.col("upto") > F.col("place")).groupBy("domain").agg(F.min("latency").alias("p95_rounded"))
    return m.join(at, "domain").drop("n")


@query(
    "hard_cases",
    f"""SELECT kind, domain, count(*) AS cases, min(case_id) AS first_case FROM (SELECT *, CASE WHEN cand = 0 THEN 'H1' WHEN sat = 0 THEN 'H2' WHEN sat < g THEN 'H3' WHEN h % 97 = 0 THEN 'H4' WHEN case_id % 10 = 0 THEN 'H5' END AS kind FROM {_RUNS}) WHERE kind IS NOT NULL GROUP BY ALL""",
)
def hard_cases(spark, d):
    """XTR5: why a case is hard, the first reason that holds."""
    kind = F.when(F.col("cand") == 0, "H1").when(F.col("sat") == 0, "H2").when(F.col("sat") < F.col("g"), "H3").when(F.col("h") % 97 == 0, "H4").when(F.col("case_id") % 10 == 0, "H5")
    return runs(spark, d).withColumn("kind", kind).where("kind is not null").groupBy("kind", "domain").agg(F.count(F.lit(1)).alias("cases"), F.min("case_id").alias("first_case"))


@query(
    "gold_positions",
    _RUN + """SELECT bucket, count(*) AS queries, count_if(dropped) AS reranker_dropped FROM (SELECT query_id, CASE WHEN min(CASE WHEN rel THEN rank END) IS NULL THEN 'absent' WHEN min(CASE WHEN rel THEN rank END) <= 2 THEN 'head' WHEN min(CASE WHEN rel THEN rank END) <= 5 THEN 'middle' ELSE 'tail' END AS bucket,
count_if(rel) > 0 AND count_if(rel AND rank <= 5) = 0 AS dropped FROM j GROUP BY ALL) GROUP BY ALL""",
)
def gold_positions(spark, d):
    """XTR6 and XTR8: where the first gold key lies, and where it is found but lost to the cut."""
    first = F.min(F.when(F.col("rel"), F.col("rank")))
    c = judged(spark, d).groupBy("query_id").agg(first.alias("first"))
    bucket = F.when(F.col("first").isNull(), "absent").when(F.col("first") <= 2, "head").when(F.col("first") <= 5, "middle").otherwise("tail")
    return c.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("first") > 5).alias("reranker_dropped"))


@query(
    "gold_ambiguity",
    _RUN + """, f AS (SELECT vec_id, label * 10 + vec_id % 4 AS fact FROM embeddings) SELECT ql AS label, round(avg(CAST(strict AS INT)), 6) AS strict_recall, round(avg(CAST(anycopy AS INT)), 6) AS any_copy_recall FROM (SELECT query_id, any_value(ql) AS ql, bool_or(rank <= 5 AND rel AND doc_id % 2 = query_id % 2 AND b.fact = a.fact) AS strict, bool_or(rank <= 5 AND b.fact = a.fact) AS anycopy
FROM j JOIN f a ON a.vec_id = query_id JOIN f b ON b.vec_id = doc_id GROUP BY query_id) GROUP BY ALL""",
)
def gold_ambiguity(spark, d):
    """XTR7: recall of the very key against recall of any copy of the same fact."""
    fact = table(spark, d, "embeddings").select("vec_id", (F.col("label") * 10 + F.col("vec_id") % 4).alias("fact"))
    j = judged(spark, d).join(fact.withColumnsRenamed({"vec_id": "query_id", "fact": "fa"}), "query_id").join(fact.withColumnsRenamed({"vec_id": "doc_id", "fact": "fb"}), "doc_id")
    same, top = F.col("fa") == F.col("fb"), F.col("rank") <= 5
    c = j.groupBy("query_id", "ql").agg(F.bool_or(top & F.col("rel") & (F.col("doc_id") % 2 == F.col("query_id") % 2) & same).alias("strict"), F.bool_or(top & same).alias("copy"))
    return c.groupBy(F.col("ql").alias("label")).agg(F.round(F.avg(F.col("strict").cast("int")), 6).alias("strict_recall"), F.round(F.avg(F.col("copy").cast("int")), 6).alias("any_copy_recall"))


@query(
    "missed_groups",
    _RUN + """, want AS (SELECT vec_id % 20 AS m, e.vec_id AS query_id, label AS ql, unnest([0, 1, 2]) AS grp FROM embeddings e WHERE vec_id % 20 = 0), got AS (SELECT query_id, doc_id % 3 AS grp, min(rank) AS best, min(CASE WHEN rank <= 5 THEN rank END) AS top FROM j WHERE rel GROUP BY ALL)
SELECT ql AS label, count(*) AS missed, count(best) AS found_below, min(best) AS best_rank FROM want LEFT JOIN got USING (query_id, grp) WHERE top IS NULL GROUP BY ALL""",
)
def missed_groups(spark, d):
    """XTR9: groups that the first five places miss, with the best rank where they are found further down."""
    want = table(spark, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("label"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("grp"))
    got = judged(spark, d).where("rel").groupBy("query_id", (F.col("doc_id") % 3).cast("int").alias("grp")).agg(F.min("rank").alias("best"))
    missed = want.join(got, ["query_id", "grp"], "left").where("best is null or best > 5")
    return missed.groupBy("label").agg(F.count(F.lit(1)).alias("missed"), F.count("best").alias("found_below"), F.min("best").alias("best_rank"))


@query("citation_presence", f"SELECT category, round(avg(CAST(cited > 0 AS INT)), 6) AS cited_share, round(avg(CAST(cited_ok > 0 AS INT)), 6) AS right_share, max(cited) AS most, round(avg(cited), 6) AS mean_citations FROM {_RUNS} GROUP BY ALL")
def citation_presence(spark, d):
    """XTR12."""
    return runs(spark, d).groupBy("category").agg(F.round(F.avg((F.col("cited") > 0).cast("int")), 6).alias("cited_share"), F.round(F.avg((F.col("cited_ok") > 0).cast("int")), 6).alias("right_share"), F.max("cited").alias("most"), F.round(F.avg("cited"), 6).alias("mean_citations"))


@query(
    "title_ceiling",
    _RUN + """SELECT ql AS label, round(avg(CAST(hit AS INT)), 6) AS actual, round(avg(CAST(family AS INT)), 6) AS ceiling, round(avg(CAST(family AS INT)) - avg(CAST(hit AS INT)), 6) AS delta FROM (SELECT query_id, any_value(ql) AS ql, bool_or(rel AND rank <= 3) AS hit, bool_or(rank <= 3 AND dl2 = ql2) AS family
FROM (SELECT j.*, ql % 5 AS ql2, e.label % 5 AS dl2 FROM j JOIN embeddings e ON e.vec_id = doc_id) GROUP BY query_id) GROUP BY ALL""",
)
def title_ceiling(spark, d):
    """XTR10: what the score would be if any chunk of the same family counted."""
    j = judged(spark, d)
    top = F.col("rank") <= 3
    c = j.groupBy("query_id", "ql").agg(F.bool_or(F.col("rel") & top).alias("hit"), F.bool_or(top & (F.col("dl") % 5 == F.col("ql") % 5)).alias("family"))
    a, b = F.avg(F.col("hit").cast("int")), F.avg(F.col("family").cast("int"))
    return c.groupBy(F.col("ql").alias("label")).agg(F.round(a, 6).alias("actual"), F.round(b, 6).alias("ceiling"), F.round(b - a, 6).alias("delta"))


@query("critical_leakage_gate", "SELECT count_if(n > 0) AS leaking_cases, coalesce(bool_and(n = 0), true) AS ok FROM (SELECT user_id, count_if(event_type = 'error' AND value > 150) AS n FROM events GROUP BY ALL)")
def critical_leakage_gate(spark, d):
    """XTR19: one leak in one case fails the gate."""
    n = table(spark, d, "events").groupBy("user_id").agg(F.count_if((F.col("event_type") == "error") & (F.col("value") > 150)).alias("n"))
    return n.agg(F.count_if(F.col("n") > 0).alias("leaking_cases"), F.coalesce(F.bool_and(F.col("n") == 0), F.lit(True)).alias("ok"))


@query(
    "load_levels",
    """SELECT o_orderpriority AS level, count(*) AS requests, round(count(*) / (date_diff('day', min(o_orderdate), max(o_orderdate)) + 1), 6) AS per_day, round(avg(CAST(o_orderstatus = 'F' AS INT)), 6) AS error_rate, round(avg(CAST(o_totalprice > 400000 AS INT)), 6) AS timeout_rate, list_sort(list(o_totalprice))[CAST(floor(0.95 * count(*)) AS INT) + 1] AS p95_floor FROM orders GROUP BY ALL""",
)
def load_levels(spark, d):
    """AGG28, AGG29, AGG55 and XTR21: rates by level, and the percentile by floor index from counts of distinct values."""
    o = table(spark, d, "orders")
    n = F.count(F.lit(1))
    m = o.groupBy(F.col("o_orderpriority").alias("level")).agg(
        n.alias("requests"), F.round(n / (F.datediff(F.max("o_orderdate"), F.min("o_orderdate")) + 1), 6).alias("per_day"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("error_rate"),
        F.round(F.avg((F.col("o_totalprice") > 400000).cast("int")), 6).alias("timeout_rate"),
    )
    v = o.groupBy(F.col("o_orderpriority").alias("level"), "o_totalprice").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(Window.partitionBy("level").orderBy("o_totalprice")))
    at = v.join(m.select("level", F.floor(0.95 * F.col("requests")).alias("place")), "level").where(F.col("upto") > F.col("place")).groupBy("level").agg(F.min("o_totalprice").alias("p95_floor"))
    return m.join(at, "level")


@query("dashboard", "SELECT source AS domain, metric, round(avg(v), 6) AS mean, count(*) AS n FROM (SELECT source, unnest([{'metric': 'quality', 'v': quality}, {'metric': 'toxic', 'v': toxic}], recursive := true) FROM documents JOIN labels USING (doc_id)) GROUP BY ALL")
def dashboard(spark, d):
    """AGG31."""
    j = table(spark, d, "documents").select("doc_id", F.col("source").alias("domain")).join(table(spark, d, "labels"), "doc_id")
    return j.unpivot(["domain"], ["quality", "toxic"], "metric", "v").groupBy("domain", "metric").agg(F.round(F.avg("v"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


@query("route_choice", "SELECT event_type AS operation, arg_max(model, {'s': score, 'm': -model}) AS model, round(max(score), 4) AS score FROM (SELECT event_type, user_id % 4 AS model, avg(CAST(value < 100 AS INT)) * 100 - (count(*) % 7) * 5 - quantile_cont(value, 0.95) / 100 AS score FROM events GROUP BY ALL) GROUP BY ALL")
def route_choice(spark, d):
    """AGG35: success less load and slowness; the best model of each operation, the lower number on a tie."""
    e = table(spark, d, "events")
    e = e.select(F.col("event_type").alias("operation"), (F.col("user_id") % 4).alias("model"), "value")
    score = F.avg((F.col("value") < 100).cast("int")) * 100 - (F.count(F.lit(1)) % 7) * 5
    m = e.groupBy("operation", "model").agg(score.alias("score")).join(X.percentiles(e, ["operation", "model"], "value", {"p": 0.95}), ["operation", "model"]).withColumn("score", F.col("score") - F.col("p") / 100)
    return m.groupBy("operation").agg(F.max_by("model", F.struct("score", -F.col("model"))).alias("model"), F.round(F.max("score"), 4).alias("score"))


@query("metric_snapshot", "SELECT event_type AS name, count(*) AS counter, round(arg_max(value, {'t': ts, 'i': event_id}), 4) AS gauge, round(sum(value), 2) AS total, round(min(value), 4) AS low, round(max(value), 4) AS high FROM events GROUP BY ALL")
def metric_snapshot(spark, d):
    """AGG38: counter, last value and sums of each metric."""
    return table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(
        F.count(F.lit(1)).alias("counter"), F.round(F.max_by("value", F.struct("ts", "event_id")), 4).alias("gauge"), F.round(F.sum("value"), 2).alias("total"), F.round(F.min("value"), 4).alias("low"), F.round(F.max("value"), 4).alias("high"),
    )


@query("next_version", "SELECT source, lang, coalesce(max(doc_id % 5), 0) + 1 AS next_version FROM documents GROUP BY ALL")
def next_version(spark, d):
    """AGG42."""
    return table(spark, d, "documents").groupBy("source", "lang").agg((F.coalesce(F.max(F.col("doc_id") % 5), F.lit(0)) + 1).alias("next_version"))


@query("dataset_distribution", "SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n, round(count(*) / any_value(t.n), 6) AS share FROM documents, (SELECT count(*) AS n FROM documents) t GROUP BY GROUPING SETS ((lang), (source), ()) ")
def dataset_distribution(spark, d):
    """AGG43: counts by each dimension apart and in all."""
    docs = table(spark, d, "documents").select("lang", "source")
    c = docs.groupingSets([[F.col("lang")], [F.col("source")], []], "lang", "source").agg(F.count(F.lit(1)).alias("n"))
    return c.crossJoin(one(docs.agg(F.count(F.lit(1)).alias("all")))).select(F.coalesce("lang", F.lit("*")).alias("lang"), F.coalesce("source", F.lit("*")).alias("source"), "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))


@query(
    "ragas_breakdown",
    f"SELECT coalesce(category, '*') AS category, coalesce(domain, '*') AS domain, count(*) AS cases, round(avg(CASE WHEN h % 19 <> 0 THEN point_hits / points END), 6) AS mean, count_if(h % 19 = 0) AS nan_n, CASE WHEN count_if(h % 19 <> 0) / count(*) < 0.9 THEN 'LOW_COVERAGE' WHEN avg(CASE WHEN h % 19 <> 0 THEN point_hits / points END) >= 0.5 THEN 'PASS' ELSE 'FAIL' END AS status FROM {_RUNS} GROUP BY GROUPING SETS ((category), (domain), (category, domain), ())",
)
def ragas_breakdown(spark, d):
    """AGG44: scores that are not numbers are left out of means and lower the coverage."""
    r = runs(spark, d).withColumn("v", F.when(F.col("h") % 19 != 0, F.col("point_hits") / F.col("points")))
    c, dom = F.col("category"), F.col("domain")
    g = r.groupingSets([[c], [dom], [c, dom], []], "category", "domain").agg(F.count(F.lit(1)).alias("cases"), F.avg("v").alias("m"), F.count_if(F.col("v").isNull()).alias("nan_n"), F.count("v").alias("valid"))
    status = F.when(F.col("valid") / F.col("cases") < 0.9, "LOW_COVERAGE").when(F.col("m") >= 0.5, "PASS").otherwise("FAIL")
    return g.select(F.coalesce("category", F.lit("*")).alias("category"), F.coalesce("domain", F.lit("*")).alias("domain"), "cases", F.round("m", 6).alias("mean"), "nan_n", status.alias("status"))


@query(
    "run_comparison",
    f"WITH a AS (SELECT domain, avg(sat / g) AS v, count(*) AS n FROM {_RUNS} WHERE h % 2 = 0 GROUP BY ALL), b AS (SELECT domain, avg(sat / g) AS v, count(*) AS n FROM {_RUNS} WHERE h % 2 = 1 GROUP BY ALL) SELECT domain, a.n AS n_a, b.n AS n_b, round(a.v, 6) AS run_a, round(b.v, 6) AS run_b, round(b.v - a.v, 6) AS delta FROM a JOIN b USING (domain)",
)
def run_comparison(spark, d):
    """AGG45: two runs by domain, in one pass over the records."""
    v, first = F.col("sat") / F.col("g"), F.col("h") % 2 == 0
    m = runs(spark, d).groupBy("domain").agg(F.count_if(first).alias("n_a"), F.count_if(~first).alias("n_b"), F.avg(F.when(first, v)).alias("a"), F.avg(F.when(~first, v)).alias("b"))
    return m.where("n_a > 0 and n_b > 0").select("domain", "n_a", "n_b", F.round("a", 6).alias("run_a"), F.round("b", 6).alias("run_b"), F.round(F.col("b") - F.col("a"), 6).alias("delta"))


@query("dataset_checksum", "SELECT source, CAST(sum(n) AS BIGINT) AS items, sha256(string_agg(part, '' ORDER BY bucket)) AS checksum FROM (SELECT source, substr(h, 1, 3) AS bucket, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS part FROM (SELECT source, sha256(coalesce(text, '')) AS h FROM documents) GROUP BY ALL) GROUP BY ALL")
def dataset_checksum(spark, d):
    """AGG46: the same for any order of the items. Hashes meet by their first three digits, 1 of 4,096 in a task, and then the parts' hashes."""
    in_order = lambda c: F.sha2(F.array_join(c, ""), 256)
    h = table(spark, d, "documents").select("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    parts = h.groupBy("source", F.substring("h", 1, 3).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), in_order(F.array_sort(F.collect_list("h"))).alias("part"))
    return parts.groupBy("source").agg(F.sum("n").alias("items"), in_order(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "part"))), lambda x: x["part"])).alias("checksum"))


@query("denied_audit", "SELECT user_id % 7 AS workspace_id, count(*) AS denied, count(DISTINCT user_id) AS users FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-03' GROUP BY ALL")
def denied_audit(spark, d):
    """AGG47."""
    e = table(spark, d, "events").where((F.col("event_type") == "error") & (F.col("ts") >= F.lit("2024-01-03").cast("timestamp")))
    return e.groupBy((F.col("user_id") % 7).alias("workspace_id")).agg(F.count(F.lit(1)).alias("denied"), F.count_distinct("user_id").alias("users"))


@query(
    "memory_summary",
    """WITH m AS (SELECT conv_id, role, turn, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS n FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL), k AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM m WHERE n <= CASE role WHEN 'user' THEN 4 ELSE 3 END)
SELECT conv_id, md5(coalesce(string_agg(CASE WHEN role = 'user' THEN c END, '; ' ORDER BY turn), '') || ' | ' || coalesce(string_agg(CASE WHEN role = 'assistant' THEN c END, '; ' ORDER BY turn), '')) AS summary_md5, count(*) AS points FROM (SELECT *, CASE WHEN length(t) <= 80 THEN t ELSE substr(t, 1, 77) || '...' END AS c FROM k) GROUP BY ALL""",
)
def memory_summary(spark, d):
    """AGG52: the last four of the user's and three of the assistant's points, clipped, in order."""
    from lodestone.functions import text as T

    m = table(spark, d, "conversations").where("role in ('user', 'assistant') and text is not null")
    n = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.desc("turn")))
    k = m.withColumn("n", n).where(F.col("n") <= F.when(F.col("role") == "user", 4).otherwise(3)).withColumn("c", T.clip(F.col("text"), 80))

    def points(role):
        some = F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "c"))))
        return F.array_join(F.transform(some, lambda x: x["c"]), "; ")

    return k.groupBy("conv_id").agg(F.md5(F.concat(points("user"), F.lit(" | "), points("assistant"))).alias("summary_md5"), F.count(F.lit(1)).alias("points"))


@query(
    "incremental_reuse",
    "SELECT ratio, count(*) AS chunks, count_if(doc_id % 100 >= ratio) AS reused, round(count_if(doc_id % 100 >= ratio) / count(*), 6) AS reuse_rate, count(DISTINCT CASE WHEN doc_id % 100 < ratio THEN text || '*' END) AS to_embed FROM documents, (SELECT unnest([1, 5, 10]) AS ratio) GROUP BY ALL",
)
def incremental_reuse(spark, d):
    """AGG53 and XTR20: what an update of 1, 5 or 10 % of the chunks leaves to embed; by hash, so equal texts are embedded once."""
    each = table(spark, d, "documents").select("doc_id", F.sha2(F.concat("text", F.lit("*")), 256).alias("h")).withColumn("ratio", F.explode(F.array(*map(F.lit, (1, 5, 10)))))
    changed = F.col("doc_id") % 100 < F.col("ratio")
    n = F.count(F.lit(1))
    return each.groupBy("ratio").agg(n.alias("chunks"), F.count_if(~changed).alias("reused"), F.round(F.count_if(~changed) / n, 6).alias("reuse_rate"), F.count_distinct(F.when(changed, F.col("h"))).alias("to_embed"))


@query("chunk_pressure", "SELECT lang AS profile, count(*) AS chunks, round(avg(t), 4) AS mean, quantile_cont(t, 0.5) AS p50, round(quantile_cont(t, 0.95), 4) AS p95, max(t) AS most FROM (SELECT lang, CAST(floor(length(text) / 4 + 0.999) AS BIGINT) AS t FROM documents WHERE text IS NOT NULL) GROUP BY ALL")
def chunk_pressure(spark, d):
    """AGG54: tokens of chunks by profile; of texts without Chinese characters a quarter of the characters."""
    t = table(spark, d, "documents").where("text is not null").select(F.col("lang").alias("profile"), F.floor(F.length("text") / 4 + 0.999).alias("t"))
    p = X.percentiles(t, ["profile"], "t", {"p50": 0.5, "p95": 0.95}).withColumn("p95", F.round("p95", 4))
    return t.groupBy("profile").agg(F.count(F.lit(1)).alias("chunks"), F.round(F.avg("t"), 4).alias("mean"), F.max("t").alias("most")).join(p, "profile")


@query(
    "replay_diff",
    "SELECT a.l_orderkey AS run_id, a.n AS steps_a, b.n AS steps_b, round(b.v - a.v, 2) AS latency_delta, a.flags = b.flags AS same_decision FROM (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice) AS v, string_agg(l_returnflag, '' ORDER BY l_returnflag) AS flags FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY ALL) a JOIN (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice) AS v, string_agg(l_returnflag, '' ORDER BY l_returnflag) AS flags FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL) b USING (l_orderkey)",
)
def replay_diff(spark, d):
    """AGG56: two replays of one run (odd and even steps), both sides in one aggregation by run."""
    odd = F.col("l_linenumber") % 2 == 1

    def side(of, name):
        flags = F.array_join(F.array_sort(F.collect_list(F.when(of, F.col("l_returnflag")))), "")
        return [F.count_if(of).alias(f"n_{name}"), F.sum(F.when(of, F.col("l_extendedprice"))).alias(f"v_{name}"), flags.alias(f"f_{name}")]

    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(*side(odd, "a"), *side(~odd, "b")).where("n_a > 0 and n_b > 0")
    return g.select("run_id", F.col("n_a").alias("steps_a"), F.col("n_b").alias("steps_b"), F.round(F.col("v_b") - F.col("v_a"), 2).alias("latency_delta"), (F.col("f_a") == F.col("f_b")).alias("same_decision"))


@query(
    "trace_order",
    """WITH p AS (SELECT user_id, CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END AS place, lag(CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 END) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS before, CAST(ts AS DATE) AS day FROM events WHERE event_type <> 'error')
SELECT user_id, day, count(*) AS spans, count(CASE WHEN place < before THEN 1 END) AS violations, count(CASE WHEN place < before THEN 1 END) = 0 AS valid FROM p GROUP BY ALL""",
)
def trace_order(spark, d):
    """XTR23: the steps of a trace (a user's day) may not go back in the pipeline."""
    k = F.col("event_type")
    place = F.when(k == "signup", 0).when(k == "view", 1).when(k == "click", 2).when(k == "purchase", 3)
    e = table(spark, d, "events").where("event_type <> 'error'").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", place.alias("place"))
    back = F.col("place") < F.lag("place").over(Window.partitionBy("user_id", "day").orderBy("ts", "event_id"))
    v = F.count_if("back")
    return e.withColumn("back", back).groupBy("user_id", "day").agg(F.count(F.lit(1)).alias("spans"), v.alias("violations"), (v == 0).alias("valid"))
