"""Queries of limits, breakers, sessions, sampling, routing, parse quality, file checks and text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import safety as Y
from lodestone.functions import text as T
from lodestone.operators import retrieval as R
from lodestone.operators import scope as A
from lodestone.plans import registry as S
from lodestone.plans.registry import query, table


def n_() -> Column:
    return F.count(F.lit(1))


def micros(c: Column | str) -> Column:
    """Microseconds of a time without zone, as times are stored here."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def by(*keys: str, order=("ts", "event_id")):
    return Window.partitionBy(*keys).orderBy(*order)


@query(
    "token_bucket",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000000 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT user_id, event_id, n, s, CAST(2 AS DOUBLE) AS tokens, true AS allowed FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, e.s, CASE WHEN least(3.0, b.tokens + (e.s - b.s) * 3.0 / 86400) >= 1 THEN least(3.0, b.tokens + (e.s - b.s) * 3.0 / 86400) - 1 ELSE least(3.0, b.tokens + (e.s - b.s) * 3.0 / 86400) END,
least(3.0, b.tokens + (e.s - b.s) * 3.0 / 86400) >= 1 FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1) SELECT user_id, event_id, allowed FROM b""",
)
def token_bucket(spark, d):
    """WIN9 and STR5: three requests a day, refilled evenly. A pause of a day fills any bucket, so each run of requests without one is folded by itself."""
    s = micros("ts") / 1_000_000
    e = table(spark, d, "events").select("user_id", "event_id", "ts", s.alias("s"))
    e = e.withColumn("run", F.sum((F.coalesce(F.col("s") - F.lag("s").over(by("user_id")), F.lit(1e9)) >= 86400).cast("int")).over(by("user_id")))
    runs = e.groupBy("user_id", "run").agg(F.array_sort(F.collect_list(F.struct("s", "event_id"))).alias("x"))

    def step(acc: Column, x: Column) -> Column:
        have = F.least(F.lit(3.0), acc["tokens"] + (x["s"] - acc["s"]) * 3.0 / 86400)
        ok = have >= 1
        return F.struct(F.when(ok, have - 1).otherwise(have).alias("tokens"), x["s"].alias("s"), F.concat(acc["out"], F.array(F.struct(x["event_id"].alias("event_id"), ok.alias("allowed")))).alias("out"))

    start = F.struct(F.lit(3.0).alias("tokens"), F.get("x", F.lit(0))["s"].alias("s"), F.from_json(F.lit("[]"), "array<struct<event_id:bigint,allowed:boolean>>").alias("out"))
    return runs.select("user_id", F.explode(F.aggregate("x", start, step, lambda a: a["out"])).alias("o")).select("user_id", "o.event_id", "o.allowed")


@query(
    "breaker_states",
    """WITH RECURSIVE e AS (SELECT user_id, CAST(ts AS DATE) AS day, event_id, event_type = 'error' OR value > 60 AS failed, epoch_us(ts) / 1000000 AS s, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS n FROM events),
b AS (SELECT user_id, day, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, 'CLOSED' AS state, 0 AS failures, -1e18 AS opened, 'CLOSED' AS seen FROM e WHERE n = 1 UNION ALL
SELECT user_id, day, n, event_id, CASE WHEN seen = 'OPEN' THEN 'OPEN' WHEN NOT failed THEN 'CLOSED' WHEN seen = 'HALF_OPEN' OR failures + 1 >= 2 THEN 'OPEN' ELSE seen END, CASE WHEN seen = 'OPEN' THEN failures WHEN NOT failed OR seen = 'HALF_OPEN' OR failures + 1 >= 2 THEN 0 ELSE failures + 1 END, CASE WHEN seen <> 'OPEN' AND failed AND (seen = 'HALF_OPEN' OR failures + 1 >= 2) THEN s ELSE opened END, seen
FROM (SELECT e.*, b.failures, b.opened, CASE WHEN b.state = 'OPEN' AND e.s - b.opened >= 7200 THEN 'HALF_OPEN' ELSE b.state END AS seen FROM b JOIN e ON e.user_id = b.user_id AND e.day = b.day AND e.n = b.n + 1)) SELECT user_id, event_id, seen AS state_before, state AS state_after FROM b WHERE n > 0""",
)
def breaker_states(spark, d):
    """WIN12 and STR7: failures in a row open a breaker, after a cooldown one probe closes or opens it again. One breaker a user and day (two failures, two hours)."""
    e = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), F.struct((micros("ts") / 1_000_000).alias("s"), "event_id", ((F.col("event_type") == "error") | (F.col("value") > 60)).alias("failed")).alias("x"))
    g = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_list("x")).alias("x"))

    def step(acc: Column, x: Column) -> Column:
        seen = F.when((acc["state"] == "OPEN") & (x["s"] - acc["opened"] >= 7200), "HALF_OPEN").otherwise(acc["state"])
        opens = (seen != "OPEN") & x["failed"] & ((seen == "HALF_OPEN") | (acc["failures"] + 1 >= 2))
        state = F.when(seen == "OPEN", "OPEN").when(~x["failed"], "CLOSED").when(opens, "OPEN").otherwise(seen)
        failures = F.when(seen == "OPEN", acc["failures"]).when(~x["failed"] | opens, 0).otherwise(acc["failures"] + 1)
        here = F.struct(x["event_id"].alias("event_id"), seen.alias("state_before"), state.alias("state_after"))
        return F.struct(state.alias("state"), failures.alias("failures"), F.when(opens, x["s"]).otherwise(acc["opened"]).alias("opened"), F.concat(acc["out"], F.array(here)).alias("out"))

    none = F.from_json(F.lit("[]"), "array<struct<event_id:bigint,state_before:string,state_after:string>>")
    start = F.struct(F.lit("CLOSED").alias("state"), F.lit(0).alias("failures"), F.lit(-1e18).alias("opened"), none.alias("out"))
    return g.select("user_id", F.explode(F.aggregate("x", start, step, lambda a: a["out"])).alias("o")).select("user_id", "o.*")


@query("run_sequence", "SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS seq, count(*) OVER (PARTITION BY user_id) + 1 AS next_version FROM events")
def run_sequence(spark, d):
    """WIN5."""
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(by("user_id")).alias("seq"), (n_().over(Window.partitionBy("user_id")) + 1).alias("next_version"))


#: Each user's events in order as the stages of a rollout: an error breaks a gate, a large value blocks.
_STAGES = S.Derived("SELECT user_id, ts, event_id, event_type AS stage, event_type <> 'error' AS gates_ok, value > 150 AS blocking FROM events")


@query(
    "rollout_promotion",
    f"SELECT event_id, CASE WHEN blocking THEN 'rollback' WHEN NOT gates_ok THEN 'hold' WHEN lead(stage) OVER w IS NULL THEN 'full' ELSE 'promote:' || lead(stage) OVER w END AS decision, count(CASE WHEN NOT gates_ok OR blocking THEN 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) >= 2 AS autostop FROM {_STAGES.sql} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def rollout_promotion(spark, d):
    """WIN13: a stage is promoted if its gates hold and nothing blocks it; two bad checks in a row stop the rollout."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    then = F.lead("stage").over(w)
    bad = F.count(F.when(~F.col("gates_ok") | F.col("blocking"), 1)).over(w.rowsBetween(-1, 0)) >= 2
    return _STAGES.df(spark, d).select("event_id", F.when(F.col("blocking"), "rollback").when(~F.col("gates_ok"), "hold").when(then.isNull(), "full").otherwise(F.concat(F.lit("promote:"), then)).alias("decision"), bad.alias("autostop"))


@query("latest_scan_bm25", f"WITH {S.bm25(docs='SELECT doc_id, text FROM documents ORDER BY doc_id DESC LIMIT 150', name='ls')} SELECT query_id, doc_id, score, rank FROM ({S.top('ls', 5)})")
def latest_scan_bm25(spark, d):
    """FLT8: BM25 over the newest 150 documents alone; the bounded scan is the feature."""
    docs = table(spark, d, "documents").select("doc_id", "text").orderBy(F.desc("doc_id")).limit(150)
    return R.top_k(R.bm25(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))), 5)


# Which domains a role manages.
_ROLES = S.Fixture("role string, domain string", [("PLATFORM_ADMIN", "MENTAL"), ("PLATFORM_ADMIN", "SERVICE"), ("PLATFORM_ADMIN", "COMPLIANCE"), ("ROLE_ADMIN", "MENTAL"), ("ROLE_ADMIN", "SERVICE"), ("ROLE_ADMIN", "COMPLIANCE"), ("MENTAL_ADMIN", "MENTAL"), ("SERVICE_ADMIN", "SERVICE"), ("COMPLIANCE_ADMIN", "COMPLIANCE")])
_USER_ROLE = "CASE c_custkey % 5 WHEN 0 THEN 'PLATFORM_ADMIN' WHEN 1 THEN 'MENTAL_ADMIN' WHEN 2 THEN 'SERVICE_ADMIN' WHEN 3 THEN 'COMPLIANCE_ADMIN' ELSE 'GUEST' END"


@query("user_domains", f"SELECT c_custkey AS user_id, domain FROM (SELECT c_custkey, unnest([{_USER_ROLE}, CASE WHEN c_custkey % 7 = 0 THEN 'SERVICE_ADMIN' END]) AS role FROM customer) JOIN {_ROLES.sql} USING (role) GROUP BY ALL")
def user_domains(spark, d):
    """FLT15: the domains of all of a user's roles."""
    k = F.col("c_custkey")
    role = F.when(k % 5 == 0, "PLATFORM_ADMIN").when(k % 5 == 1, "MENTAL_ADMIN").when(k % 5 == 2, "SERVICE_ADMIN").when(k % 5 == 3, "COMPLIANCE_ADMIN").otherwise("GUEST")
    users = table(spark, d, "customer").select(k.alias("user_id"), F.explode(F.array(role, F.when(k % 7 == 0, "SERVICE_ADMIN"))).alias("role"))
    return users.join(F.broadcast(_ROLES.df(spark)), "role").select("user_id", "domain").distinct()  # nine rows


_ROUTES = S.Derived(
    "SELECT c_custkey AS query_id, CASE c_custkey % 7 WHEN 0 THEN ARRAY('mental') WHEN 1 THEN ARRAY('SERVICE', 'COMPLIANCE') WHEN 2 THEN ARRAY('unknown', c_mktsegment) WHEN 3 THEN ARRAY('service') WHEN 4 THEN NULL ELSE ARRAY(c_mktsegment) END AS domains, "
    "CASE c_custkey % 5 WHEN 0 THEN ARRAY('ExternalDocs', 'PolicyKB') WHEN 1 THEN ARRAY('nonsense') WHEN 2 THEN ARRAY('ExternalDocs') WHEN 3 THEN ARRAY('IncidentCases', 'PolicyKB', 'IncidentCases') ELSE NULL END AS preferred FROM customer"
)
# The sources of each domain, and all sources.
_DOMAIN_SOURCES = {"MENTAL": ["InternalKB", "PolicyKB"], "SERVICE": ["ProductDocs", "IncidentCases", "InternalKB"], "COMPLIANCE": ["PolicyKB", "StructuredSQL", "ExternalDocs"]}
_SOURCES = ["InternalKB", "ProductDocs", "PolicyKB", "IncidentCases", "StructuredSQL", "ExternalDocs"]


@query(
    "source_routing",
    "WITH r AS (SELECT query_id, list_filter(list_concat(list_filter(coalesce(preferred, []), lambda p: list_contains(" + str(_SOURCES) + ", p)), flatten(list_transform(coalesce(domains, []), lambda x: CASE upper(x) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _DOMAIN_SOURCES.items()) + f" ELSE [] END))), lambda s: s <> 'ExternalDocs') AS k FROM {_ROUTES.sql}) SELECT query_id, CASE WHEN len(k) = 0 THEN 'InternalKB' ELSE array_to_string(list_transform(list_filter(list_zip(k, range(1, len(k) + 1)), lambda p: list_position(k, p[1]) = p[2]), lambda p: p[1]), ',') END AS kinds FROM r",
)
def source_routing(spark, d):
    """FLT16: preferred sources, then those of the domains, each once in order; external ones only if allowed, the internal base where none is left."""
    of = F.create_map(*(x for k, v in _DOMAIN_SOURCES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    none = F.array().cast("array<string>")
    known = F.filter(F.coalesce("preferred", none), lambda p: p.isin(*_SOURCES))
    theirs = F.flatten(F.transform(F.coalesce("domains", none), lambda x: F.coalesce(of[F.upper(x)], none)))
    kinds = F.array_distinct(F.filter(F.concat(known, theirs), lambda s: s != "ExternalDocs"))
    return _ROUTES.df(spark, d).select("query_id", F.when(F.size(kinds) == 0, "InternalKB").otherwise(F.array_join(kinds, ",")).alias("kinds"))


@query("release_eligible", "SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL AND doc_id % 4 <> 0 AND doc_id % 10 > 2")
def release_eligible(spark, d):
    """FLT19: reviewed cases (three of four) of enough confidence."""
    return table(spark, d, "labels").where("quality is not null and doc_id % 4 <> 0 and doc_id % 10 > 2").select("doc_id", "quality")


@query(
    "safe_metadata",
    "SELECT event_id, CAST(props ->> 'k' AS INT) AS k, substr(trim(regexp_replace('user ' || user_id || ' mail u' || user_id || '@x.org', '[\\w.+-]+@[\\w-]+(?:\\.[\\w-]+)+', '[已脱敏]', 'g')), 1, 12) AS preview FROM events",
)
def safe_metadata(spark, d):
    """FLT20: of the properties only keys on the white list, texts without personal data and cut."""
    props = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: k.isin("k", "stage") & ~F.lower(k).contains("secret"))
    text = F.concat(F.lit("user "), F.col("user_id"), F.lit(" mail u"), F.col("user_id"), F.lit("@x.org"))
    return table(spark, d, "events").select("event_id", props["k"].cast("int").alias("k"), F.substring(F.trim(Y.sanitise(text)), 1, 12).alias("preview"))


@query("stratified_sample", "SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('s:' || doc_id), doc_id) <= 10")
def stratified_sample(spark, d):
    """SET5: ten of each stratum in the order of a hash; each task cuts to ten before the shuffle."""
    h = F.md5(F.concat(F.lit("s:"), F.col("doc_id")).cast("binary"))
    return table(spark, d, "documents").select("lang", "doc_id").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id"))).where("n <= 10").select("lang", "doc_id")


@query(
    "stream_dlp",
    "WITH c AS (SELECT conv_id, CASE conv_id % 3 WHEN 0 THEN 'MENTAL' WHEN 1 THEN 'SERVICE' ELSE 'COMPLIANCE' END AS domain, string_agg(text, '' ORDER BY turn) || CASE WHEN conv_id % 4 = 0 THEN ' sk-abcdefghijklmnopqrstuv' WHEN conv_id % 4 = 1 THEN ' 13800138000' ELSE '' END AS t FROM conversations WHERE text IS NOT NULL GROUP BY conv_id) SELECT conv_id, CASE WHEN regexp_matches(t, 'sk-[a-zA-Z0-9]{20,}') AND domain <> 'SERVICE' THEN 'block' WHEN regexp_matches(t, 'sk-[a-zA-Z0-9]{20,}') THEN 'redact' WHEN domain <> 'SERVICE' AND regexp_matches(t, '1[3-9]\\d{9}') THEN 'redact' ELSE 'allow' END AS action FROM c",
)
def stream_dlp(spark, d):
    """STR1 in its batch form: a stream's chunks in order, scanned as one text, so that nothing slips through between two chunks."""
    k = F.col("conv_id")
    g = table(spark, d, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "").alias("t"))
    tail = F.when(k % 4 == 0, " sk-abcdefghijklmnopqrstuv").when(k % 4 == 1, " 13800138000").otherwise("")
    domain = F.when(k % 3 == 0, "MENTAL").when(k % 3 == 1, "SERVICE").otherwise("COMPLIANCE")
    return g.select("conv_id", Y.output_dlp(F.concat("t", tail), domain)["action"].alias("action"))


_ELIGIBLE = "event_type <> 'error' AND value >= 5 AND ts >= TIMESTAMP '2024-01-02'"


@query(
    "online_worker",
    f"""WITH e AS (SELECT *, CAST(ts AS DATE) AS day, {_ELIGIBLE} AS eligible, CAST('0x' || substr(sha1(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 30 AS drawn, event_id % 6 = 0 AS processed FROM events), p AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS n FROM e WHERE eligible AND drawn AND NOT processed)
SELECT day, count_if(eligible) AS eligible, count_if(eligible AND drawn) AS sampled, (SELECT count(*) FROM p WHERE p.day = e.day AND n <= 5) AS scored, (SELECT count(*) FROM p WHERE p.day = e.day AND n <= 5 AND value > 100) AS dead_letters FROM e GROUP BY ALL""",
)
def online_worker(spark, d):
    """STR4: after the cursor, eligible, sampled by hash, not processed before, within the day's budget; counts include what was processed."""
    from pyspark.sql.functions import count_if

    e = table(spark, d, "events").withColumns({"day": F.to_date("ts"), "eligible": F.expr("event_type <> 'error' and value >= 5 and ts >= timestamp '2024-01-02'"), "drawn": T.hash_bucket(F.col("event_id")) < 30})
    new = F.col("eligible") & F.col("drawn") & (F.col("event_id") % 6 != 0)
    n = F.row_number().over(Window.partitionBy("day").orderBy("ts", "event_id"))
    scored = e.where(new).withColumn("n", n).where("n <= 5").groupBy("day").agg(n_().alias("scored"), count_if(F.col("value") > 100).alias("dead_letters"))
    counts = e.groupBy("day").agg(count_if("eligible").alias("eligible"), count_if(F.col("eligible") & F.col("drawn")).alias("sampled"))
    return counts.join(scored, "day", "left").select("day", "eligible", "sampled", F.coalesce("scored", F.lit(0)).alias("scored"), F.coalesce("dead_letters", F.lit(0)).alias("dead_letters"))


@query("run_log", "WITH s AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS version FROM events) SELECT user_id AS run_id, event_type AS task, max(version) AS version, arg_max(event_id, version) AS snapshot, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_type) AS INT) AS seq FROM s GROUP BY user_id, event_type")
def run_log(spark, d):
    """STR8: each snapshot replaces a run's rows and is a new version; restored is the latest, its rows numbered from 1."""
    s = table(spark, d, "events").groupBy(F.col("user_id").alias("run_id"), F.col("event_type").alias("task")).agg(n_().alias("version"), F.max_by("event_id", F.struct("ts", "event_id")).alias("snapshot"))
    return s.withColumn("seq", F.row_number().over(Window.partitionBy("run_id").orderBy("task")))


@query("memory_ttl", "SELECT user_id, event_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS now FROM events) WHERE ts > now - INTERVAL 48 hours QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 4")
def memory_ttl(spark, d):
    """STR10: the last four entries of a session that are not older than 48 hours before its latest."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts")
    last = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("n <= 4")
    now = F.max("ts").over(Window.partitionBy("user_id"))
    return last.withColumn("now", now).where("ts > now - interval 48 hours").select("user_id", "event_id")


@query("cache_hits", "SELECT event_id, CASE WHEN before IS NULL THEN 'miss' WHEN ts - before <= CASE WHEN empty THEN INTERVAL 2 hours ELSE INTERVAL 12 hours END THEN CASE WHEN empty THEN 'negative_hit' ELSE 'hit' END ELSE 'expired' END AS state FROM (SELECT event_id, ts, lag(ts) OVER w AS before, coalesce(lag(value < 20) OVER w, false) AS empty FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))")
def cache_hits(spark, d):
    """STR11: an entry lives twelve hours, one for an empty result two."""
    w = by("user_id", "event_type")
    e = table(spark, d, "events").withColumns({"before": F.lag("ts").over(w), "empty": F.coalesce(F.lag(F.col("value") < 20).over(w), F.lit(False))})
    age = micros("ts") - micros("before")
    alive = age <= F.when(F.col("empty"), 2).otherwise(12) * F.lit(3_600_000_000).cast("long")
    return e.select("event_id", F.when(F.col("before").isNull(), "miss").when(alive & F.col("empty"), "negative_hit").when(alive, "hit").otherwise("expired").alias("state"))


# Thresholds of parse quality and the weights of its score.
_QUALITY = dict(zip(("page", "chars", "replaced", "margin", "tables"), (0.3, 0.2, 0.2, 0.2, 0.1), strict=True))


@query(
    "parse_metrics",
    """WITH b AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id, len(list_filter(l, lambda x: trim(x) <> '')) / len(l) AS page, length(text) AS n, (length(text) - length(replace(text, '%', ''))) / greatest(1, length(text)) AS bad, CASE WHEN len(l) > 1 AND l[1] = l[-1] THEN length(l[1]) * 2 / greatest(1, length(text)) ELSE 0 END AS margin,
CASE WHEN len(list_filter(l, lambda x: contains(x, '|'))) = 0 THEN 1.0 ELSE len(list_filter(l, lambda x: len(string_split(x, '|')) > 2)) / len(list_filter(l, lambda x: contains(x, '|'))) END AS tables FROM b)
SELECT doc_id, round(0.3 * page + 0.2 * least(1.0, n / 5000.0) + 0.2 * (1 - least(1.0, bad * 10)) + 0.2 * (1 - least(1.0, margin * 2)) + 0.1 * tables, 4) AS score, CASE WHEN page < 0.1 OR bad > 0.1 OR margin > 0.7 OR n < 20 THEN 'QUARANTINE' WHEN page < 0.4 OR bad > 0.02 OR margin > 0.4 THEN 'DEGRADED' ELSE 'PASS' END AS verdict FROM m""",
)
def parse_metrics(spark, d):
    """DOC17: share of lines with text for pages, length, unreadable characters (here %, which the tables have), repeated first and last lines, tables whose rows have cells."""
    lines = F.split("text", "\n")

    def metrics(x: Column) -> Column:
        ruled = F.size(F.filter(x, lambda s: s.contains("|")))
        return F.struct((F.size(F.filter(x, lambda s: F.trim(s) != "")) / F.size(x)).alias("page"), F.when((F.size(x) > 1) & (F.get(x, F.lit(0)) == F.element_at(x, -1)), F.length(F.get(x, F.lit(0))) * 2).otherwise(0).alias("edge"), F.when(ruled == 0, 1.0).otherwise(F.size(F.filter(x, lambda s: F.size(F.split(s, r"\|")) > 2)) / ruled).alias("tables"))

    size = F.greatest(F.lit(1), F.length("text"))
    m = table(spark, d, "documents").where("text is not null").select("doc_id", F.length("text").alias("n"), ((F.length("text") - F.length(F.replace("text", F.lit("%"), F.lit("")))) / size).alias("bad"), size.alias("size"), T.once(lines, metrics).alias("x"))
    m = m.select("doc_id", "n", "bad", F.col("x.page").alias("page"), (F.col("x.edge") / F.col("size")).alias("margin"), F.col("x.tables").alias("tables"))
    w = _QUALITY
    score = w["page"] * F.col("page") + w["chars"] * F.least(F.lit(1.0), F.col("n") / 5000.0) + w["replaced"] * (1 - F.least(F.lit(1.0), F.col("bad") * 10)) + w["margin"] * (1 - F.least(F.lit(1.0), F.col("margin") * 2)) + w["tables"] * F.col("tables")
    verdict = F.when((F.col("page") < 0.1) | (F.col("bad") > 0.1) | (F.col("margin") > 0.7) | (F.col("n") < 20), "QUARANTINE").when((F.col("page") < 0.4) | (F.col("bad") > 0.02) | (F.col("margin") > 0.4), "DEGRADED").otherwise("PASS")
    return m.select("doc_id", F.round(score, 4).alias("score"), verdict.alias("verdict"))


@query("corpus_gate", r"SELECT source, count(*) AS documents, count_if(regexp_matches(text, '[#*$%&]{3}')) AS mojibake, round(sum(len(regexp_extract_all(text, '[#*$%&]{3}'))) / sum(length(text)), 6) AS ratio, sum(length(text)) AS chars, CASE WHEN count_if(regexp_matches(text, '[#*$%&]{3}')) / count(*) > 0.2 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def corpus_gate(spark, d):
    """DOC19 and XTR22: runs of three junk characters stand for broken encodings."""
    bad = r"[#*$%&]{3}"
    hit = F.col("text").rlike(bad)
    return table(spark, d, "documents").where("text is not null").groupBy("source").agg(
        n_().alias("documents"), F.count_if(hit).alias("mojibake"), F.round(F.sum(F.regexp_count("text", F.lit(bad))) / F.sum(F.length("text")), 6).alias("ratio"), F.sum(F.length("text")).alias("chars"),
        F.when(F.count_if(hit) / n_() > 0.2, "FAIL").otherwise("PASS").alias("verdict"),
    )


@query("repeated_sentences", r"SELECT md5(k) AS sentence_md5, count(*) AS n, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, substr(trim(regexp_replace(s, '\s+', ' ', 'g')), 1, 24) AS k FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[。\n！？!?.]')) AS s FROM documents WHERE text IS NOT NULL) WHERE length(trim(regexp_replace(s, '\s+', ' ', 'g'))) >= 12) GROUP BY k HAVING count(*) > 1")
def repeated_sentences(spark, d):
    """XTR22: beginnings of sentences that occur more than once, by counting and not by pairs."""
    s = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", r"[。\n！？!?.]")).alias("s")).select("doc_id", T.collapse(F.col("s")).alias("s")).where(F.length("s") >= 12)
    return s.groupBy(F.substring("s", 1, 24).alias("k")).agg(n_().alias("n"), F.count_distinct("doc_id").alias("documents")).where("n > 1").select(F.md5("k").alias("sentence_md5"), "n", "documents")


@query("question_helpers", r"SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '[\s#*$%&|<>]+', ' ', 'g')) AS title, len(list_filter(string_split(text, chr(10)), lambda l: length(trim(l)) >= 20)) AS units, CASE WHEN length(x) <= 60 THEN x ELSE substr(x, 1, 57) || '...' END AS excerpt FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents WHERE text IS NOT NULL)")
def question_helpers(spark, d):
    """DOC21 and DOC22: a compact title, units of content, an excerpt."""
    return table(spark, d, "documents").where("text is not null").select(
        "doc_id", F.trim(F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), r"[\s#*$%&|<>]+", " ")).alias("title"), F.size(F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) >= 20)).cast("long").alias("units"), T.clip(F.col("text"), 60).alias("excerpt"),
    )


@query("chunk_families", "WITH c AS (SELECT lang AS gold, CASE WHEN doc_id % 9 = 0 THEN 'en' ELSE lang END AS said FROM documents), k AS (SELECT gold AS family, count(*) AS n, count_if(gold = said) AS tp FROM c GROUP BY ALL), p AS (SELECT said AS family, count(*) AS m FROM c GROUP BY ALL) SELECT family, n, round(2.0 * tp / (n + m), 6) AS f1, round(avg(2.0 * tp / (n + m)) OVER (), 6) AS macro_f1 FROM k JOIN p USING (family)")
def chunk_families(spark, d):
    """DOC20: how often a document's family is mistaken for another, with F1 by family and their mean."""
    c = table(spark, d, "documents").select(F.col("lang").alias("gold"), F.when(F.col("doc_id") % 9 == 0, "en").otherwise(F.col("lang")).alias("said")).groupBy("gold", "said").agg(n_().alias("c"))
    k = c.groupBy(F.col("gold").alias("family")).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("gold") == F.col("said"), F.col("c")).otherwise(0)).alias("tp"))
    f = k.join(c.groupBy(F.col("said").alias("family")).agg(F.sum("c").alias("m")), "family").withColumn("f", 2.0 * F.col("tp") / (F.col("n") + F.col("m")))
    return f.crossJoin(F.broadcast(f.agg(F.round(F.avg("f"), 6).alias("macro_f1")))).select("family", "n", F.round("f", 6).alias("f1"), "macro_f1")  # one row


#: Pages and documents as uploaded files: names with all kinds of endings and paths, contents with all kinds of beginnings.
_FILES = S.Derived(
    "SELECT page_id AS file_id, CASE page_id % 9 WHEN 0 THEN '../' || page_id || '.txt' WHEN 1 THEN page_id || '.EXE' WHEN 2 THEN 'a/' || page_id || '.md' WHEN 3 THEN page_id || '.sh' WHEN 4 THEN page_id || '.docx' ELSE page_id || '.html' END AS name, "
    "CASE page_id % 8 WHEN 0 THEN 'MZ' || html WHEN 1 THEN '#!/bin/sh' || chr(10) || html WHEN 2 THEN chr(127) || 'ELF' || html WHEN 3 THEN 'PK' || chr(3) || chr(4) || html WHEN 4 THEN '%PDF-1.7 ' || html ELSE html END AS content FROM pages "
    "UNION ALL SELECT 1000000000 + doc_id, doc_id || '.txt', coalesce(text, '') FROM documents"
)
# Endings that are never taken.
_ENDINGS = (".exe", ".bat", ".cmd", ".sh", ".ps1", ".js", ".vbs", ".jar", ".msi", ".dll")


@query(
    "file_safety",
    "SELECT file_id, CASE WHEN length(content) > 20000 THEN 'too_large' WHEN contains(name, '..') OR contains(name, '/') OR contains(name, chr(92)) THEN 'path' WHEN regexp_matches(lower(name), '(" + "|".join(e.replace(".", r"\.") for e in _ENDINGS) + f")$') THEN 'ending' WHEN starts_with(content, 'MZ') OR starts_with(content, chr(127) || 'ELF') THEN 'executable' WHEN starts_with(content, '#!') THEN 'script' ELSE 'safe' END AS verdict FROM {_FILES.sql}",
)
def file_safety(spark, d):
    """SCL18, SRC7 and SRC8: size, path, ending, first bytes of every page and document as a file."""
    c, n = F.col("content"), F.lower("name")
    bad = F.lit(False)
    for e in _ENDINGS:
        bad = bad | n.endswith(e)
    return _FILES.df(spark, d).select("file_id", F.when(F.length(c) > 20000, "too_large").when(F.col("name").contains("..") | F.col("name").contains("/") | F.col("name").contains("\\"), "path").when(bad, "ending").when(c.startswith("MZ") | c.startswith("\x7fELF"), "executable").when(c.startswith("#!"), "script").otherwise("safe").alias("verdict"))


@query("file_kinds", f"SELECT file_id, CASE WHEN starts_with(content, 'MZ') THEN 'exe' WHEN starts_with(content, chr(127) || 'ELF') THEN 'elf' WHEN starts_with(content, 'PK' || chr(3) || chr(4)) THEN 'zip' WHEN starts_with(content, '%PDF') THEN 'pdf' WHEN regexp_matches(content, '(?i)^\\s*<(!doctype html|html)') THEN 'html' WHEN contains(name, '.html') THEN 'html_by_name' WHEN contains(name, '.docx') THEN 'docx_by_name' ELSE 'text' END AS parser FROM {_FILES.sql}")
def file_kinds(spark, d):
    """SRC5: the parser that a file goes to, by its first bytes as binary, then by its name."""
    b = F.encode("content", "UTF-8")
    head = F.hex(F.substring(b, 1, 4))
    kind = F.when(head.startswith("4D5A"), "exe").when(head == "7F454C46", "elf").when(head == "504B0304", "zip").when(head == "25504446", "pdf")
    html = F.col("content").rlike(r"(?i)^\s*<(!doctype html|html)")
    return _FILES.df(spark, d).select("file_id", F.coalesce(kind, F.when(html, "html").when(F.col("name").contains(".html"), "html_by_name").when(F.col("name").contains(".docx"), "docx_by_name"), F.lit("text")).alias("parser"))


@query("ssrf_check", r"SELECT page_id, CASE WHEN h = '' THEN 'invalid' WHEN regexp_matches(h, '^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)') THEN 'private' WHEN NOT regexp_matches(h, '(^|\.)example\.(com|org|net)$') THEN 'not_listed' ELSE 'ok' END AS verdict FROM (SELECT page_id, CASE page_id % 5 WHEN 1 THEN '172.20.0.' || page_id % 200 WHEN 2 THEN '10.0.0.1' WHEN 3 THEN '8.8.8.8' ELSE lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) END AS h FROM pages)")
def ssrf_check(spark, d):
    """SCL17: hosts on the list, never a private address; addresses are put in for three of five pages."""
    k = F.col("page_id")
    h = F.when(k % 5 == 1, F.concat(F.lit("172.20.0."), k % 200)).when(k % 5 == 2, "10.0.0.1").when(k % 5 == 3, "8.8.8.8").otherwise(F.lower(F.regexp_extract("url", "^https?://([^/:?#]+)", 1)))
    x = table(spark, d, "pages").select("page_id", h.alias("h"))
    private = F.col("h").rlike(r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)")
    return x.select("page_id", F.when(F.col("h") == "", "invalid").when(private, "private").when(~F.col("h").rlike(r"(^|\.)example\.(com|org|net)$"), "not_listed").otherwise("ok").alias("verdict"))


#: Assistants' turns as answers: some with citations, some that abstain, some that end in a JSON verdict.
_SAID = S.Derived(
    "SELECT conv_id * 1000 + turn AS case_id, CASE (conv_id + turn) % 6 WHEN 0 THEN '见 [SERVICE:a' || conv_id || '.md:1:0] 与 [2]，' || text WHEN 1 THEN '知识库未覆盖，无法回答。' WHEN 2 THEN '无法确认' WHEN 3 THEN '[HR:b.md:2:1][HR:b.md:2:1] ok ' || chr(123) || '\"score\": ' || (turn % 5) || ', \"why\": \"good\"' || chr(125) || ' end' WHEN 4 THEN '' ELSE text END AS answer, "
    "CASE WHEN conv_id % 4 = 0 THEN NULL WHEN conv_id % 4 = 1 THEN 'retrieve,rerank' WHEN conv_id % 4 = 2 THEN 'abstain' ELSE '' END AS behaviour, CASE WHEN turn % 3 = 0 THEN 'RERANK' WHEN turn % 3 = 1 THEN '' ELSE 'retrieve' END AS expected FROM conversations WHERE role = 'assistant' AND text IS NOT NULL"
)


@query(
    "answer_scalars",
    f"""SELECT case_id, array_to_string(list_sort(list_distinct(regexp_extract_all(answer, '\\[([A-Z]+:[^\\]]+)\\]', 1))), ',') AS cited, regexp_replace(answer, '\\[[^\\]]+\\]', '', 'g') AS stripped, trim(answer) = '' OR starts_with(regexp_replace(answer, '\\s+', '', 'g'), '知识库未覆盖，无法回答') OR (length(trim(answer)) <= 24 AND (contains(answer, '无法回答') OR contains(answer, '无法确认'))) AS abstained,
expected = '' OR coalesce(contains(lower(behaviour), lower(expected)), false) AS behaviour_ok, CAST(json_extract(nullif(regexp_extract(answer, '(?s)\\{{.*\\}}'), ''), '$.score') AS INT) AS score FROM {_SAID.sql}""",
)
def answer_scalars(spark, d):
    """SCL8, SCL9 and SCL15: behaviour, citations and their removal, abstention, the outermost JSON object of an answer."""
    a = F.col("answer")
    compact = F.regexp_replace(a, r"\s+", "")
    abstained = (F.trim(a) == "") | compact.startswith("知识库未覆盖，无法回答") | (F.length(F.trim(a)) <= 24) & (a.contains("无法回答") | a.contains("无法确认"))
    cited = F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(a, F.lit(r"\[([A-Z]+:[^\]]+)\]"), F.lit(1)))), ",")
    ok = (F.col("expected") == "") | F.coalesce(F.lower("behaviour").contains(F.lower("expected")), F.lit(False))
    return _SAID.df(spark, d).select("case_id", cited.alias("cited"), F.regexp_replace(a, r"\[[^\]]+\]", "").alias("stripped"), abstained.alias("abstained"), ok.alias("behaviour_ok"), F.get_json_object(F.regexp_extract(a, r"(?s)\{.*\}", 0), "$.score").cast("int").alias("score"))


# Words of errors that pass and that stay.
_TRANSIENT, _PERMANENT = ("timeout", "connection", "429", "503", "temporarily"), ("invalid", "unsupported", "not found", "permission")


@query("error_classes", "SELECT event_id, CASE WHEN regexp_matches(m, '(timeout|connection|429|503|temporarily)') THEN 'transient' WHEN regexp_matches(m, '(invalid|unsupported|not found|permission)') THEN 'permanent' ELSE 'transient' END AS class FROM (SELECT event_id, lower(CASE event_id % 4 WHEN 0 THEN 'Read Timeout' WHEN 1 THEN 'Invalid key' WHEN 2 THEN 'file NOT FOUND after 503' ELSE 'odd' END) AS m FROM events WHERE event_type = 'error')")
def error_classes(spark, d):
    """SCL13: words that pass win; unknown errors may be tried again."""
    k = F.col("event_id") % 4
    m = F.lower(F.when(k == 0, "Read Timeout").when(k == 1, "Invalid key").when(k == 2, "file NOT FOUND after 503").otherwise("odd"))
    return table(spark, d, "events").where("event_type = 'error'").select("event_id", F.when(m.rlike("|".join(_TRANSIENT)), "transient").when(m.rlike("|".join(_PERMANENT)), "permanent").otherwise("transient").alias("class"))


@query("severity_rules", "SELECT conv_id, turn, CASE WHEN s >= 4 THEN 'HIGH' WHEN s >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk, s AS score FROM (SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'thth') THEN 4.0 WHEN regexp_matches(lower(text), 'onon') THEN 3.0 WHEN regexp_matches(lower(text), 'ingin') THEN 2.0 ELSE 0.0 END AS s FROM conversations WHERE role = 'user' AND text IS NOT NULL)")
def severity_rules(spark, d):
    """SCL14: the first kind of signal that a message has gives its score, and the score its risk; syllables of the test tables stand for the words."""
    low = F.lower("text")
    s = F.when(low.rlike("thth"), 4.0).when(low.rlike("onon"), 3.0).when(low.rlike("ingin"), 2.0).otherwise(0.0)
    x = table(spark, d, "conversations").where("role = 'user' and text is not null").select("conv_id", "turn", s.alias("score"))
    return x.select("conv_id", "turn", F.when(F.col("score") >= 4, "HIGH").when(F.col("score") >= 3, "MEDIUM").otherwise("LOW").alias("risk"), "score")


@query("lexical_flags", "SELECT item_id, round(o, 6) AS overlap, CASE WHEN o >= 0.5 THEN 'high' ELSE 'low' END AS flag, round(kept, 6) AS kept FROM (SELECT item_id, len(list_intersect(a, b)) / greatest(1, len(a)) AS o, len(list_filter(a, lambda w: length(w) >= 6 AND list_contains(b, w))) / greatest(1, len(list_filter(a, lambda w: length(w) >= 6))) AS kept FROM (SELECT item_id, list_distinct(regexp_extract_all(lower(b.text), '[a-z]+')) AS a, list_distinct(regexp_extract_all(lower(d.text), '[a-z]+')) AS b FROM benchmark b JOIN documents d ON d.doc_id = b.item_id WHERE d.text IS NOT NULL))")
def lexical_flags(spark, d):
    """SCL11 and XTR11: how many of a question's words, and of its long ones, a passage has."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    j = table(spark, d, "benchmark").select("item_id", words("text").alias("a")).join(table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("item_id"), words("text").alias("b")), "item_id")
    long = F.filter("a", lambda w: F.length(w) >= 6)
    o = F.size(F.array_intersect("a", "b")) / F.greatest(F.lit(1), F.size("a"))
    return j.select("item_id", F.round(o, 6).alias("overlap"), F.when(o >= 0.5, "high").otherwise("low").alias("flag"), F.round(F.size(F.array_intersect(long, F.col("b"))) / F.greatest(F.lit(1), F.size(long)), 6).alias("kept"))


@query("cost_estimate", "SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 4) AS BIGINT) AS tokens, round(ceil(length(coalesce(text, '')) / 4) / 1000 * CASE WHEN lang = 'en' THEN 0.5 ELSE 0.8 END, 6) AS cost FROM documents")
def cost_estimate(spark, d):
    """SCL19."""
    tokens = F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4)
    return table(spark, d, "documents").select("doc_id", tokens.alias("tokens"), F.round(tokens / 1000 * F.when(F.col("lang") == "en", 0.5).otherwise(0.8), 6).alias("cost"))


@query("stable_draw", "SELECT event_id, CAST('0x' || substr(sha256('replay:' || event_id), 1, 8) AS BIGINT) % 1000 AS draw FROM events")
def stable_draw(spark, d):
    """SCL20: the same value in each replay."""
    h = F.sha2(F.concat(F.lit("replay:"), F.col("event_id")), 256)
    return table(spark, d, "events").select("event_id", (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % 1000).alias("draw"))


@query("age_windows", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS budget_day, CAST(floor((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(ts)) / 3600000000) AS BIGINT) AS age_hours, ts < TIMESTAMP '2024-02-01' - INTERVAL 20 days AS stale FROM events")
def age_windows(spark, d):
    """SCL21: the day of a budget, ages and cutoffs against a stated now."""
    now = F.lit("2024-02-01").cast("timestamp")
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("budget_day"), F.floor((micros(now) - micros("ts")) / 3_600_000_000).alias("age_hours"), (F.col("ts") < now - F.expr("interval 20 days")).alias("stale"))


@query("nested_round_trip", "SELECT event_id, CAST(props ->> 'k' AS INT) AS k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\",\"props\":{\"k\":' || CAST(props ->> 'k' AS INT) || '}}' AS json FROM events")
def nested_round_trip(spark, d):
    """SCL22 and XTR25: nested values read from JSON, written again, and read back the same."""
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k int"))
    j = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"), F.col("p").alias("props")))
    back = F.from_json("json", "id long, type string, props struct<k:int>")
    return e.select("event_id", F.col("p.k").alias("k"), j.alias("json")).where(back["props"]["k"].eqNullSafe(F.col("k"))).select("event_id", "k", "json")


@query("tool_audit", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'denied' WHEN event_type = 'signup' AND user_id % 3 = 0 THEN 'needs_approval' ELSE 'allowed' END AS decision, CASE WHEN event_type <> 'error' THEN coalesce(date_diff('second', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)), -1) ELSE -1 END AS seconds FROM events")
def tool_audit(spark, d):
    """XTR24: each call with what the policy says and how long it took to the next row of the user."""
    k = F.col("event_type")
    follow = F.lead("ts").over(by("user_id"))
    secs = F.coalesce(F.unix_timestamp(F.date_trunc("second", follow)) - F.unix_timestamp(F.date_trunc("second", F.col("ts"))), F.lit(-1))
    return table(spark, d, "events").select("event_id", F.when(k == "error", "denied").when((k == "signup") & (F.col("user_id") % 3 == 0), "needs_approval").otherwise("allowed").alias("decision"), F.when(k != "error", secs).otherwise(F.lit(-1)).alias("seconds"))


@query("session_resolve", "SELECT o_orderkey AS request_id, coalesce(c.c_custkey, -o_orderkey) AS session_id, c.c_custkey IS NULL AS created FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey AND c.c_nationkey % 3 = o_orderkey % 3")
def session_resolve(spark, d):
    """XTR26: a session within the request's own scope, else a new one."""
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_nationkey") % 3).alias("scope"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), "o_custkey", (F.col("o_orderkey") % 3).alias("own"))
    j = o.join(c, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("scope") == F.col("own")), "left")
    return j.select("request_id", F.coalesce("c_custkey", -F.col("request_id")).alias("session_id"), F.col("c_custkey").isNull().alias("created"))


@query("gold_lint", "SELECT item_id, array_to_string(list_filter([CASE WHEN length(b.text) > 140 THEN 'too_long' END, CASE WHEN d.doc_id IS NULL THEN 'missing_evidence' END, CASE WHEN item_id % 7 = 0 THEN 'required_forbidden' END, CASE WHEN contains(d.text, substr(b.text, 1, 20)) THEN 'answer_leak' END], lambda e: e IS NOT NULL), ',') AS errors FROM benchmark b LEFT JOIN documents d ON d.doc_id = item_id * 3 AND d.text IS NOT NULL")
def gold_lint(spark, d):
    """XTR17: what is wrong with a case, all of it."""
    j = table(spark, d, "benchmark").join(table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").alias("passage")), F.col("doc_id") == F.col("item_id") * 3, "left")
    rules = [(F.length("text") > 140, "too_long"), (F.col("doc_id").isNull(), "missing_evidence"), (F.col("item_id") % 7 == 0, "required_forbidden"), (F.col("passage").contains(F.substring("text", 1, 20)), "answer_leak")]
    return j.select("item_id", F.array_join(F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in rules)), lambda e: e.isNotNull()), ",").alias("errors"))


@query("release_audit", "SELECT source, count(DISTINCT doc_id % 4) = 1 AS one_version, count_if(quality = 1) AS approved, count(*) - count_if(quality = 1) AS pending, CASE WHEN count(DISTINCT doc_id % 4) <> 1 THEN 'mixed_versions' WHEN count_if(quality = 1) < count(*) THEN 'unapproved' ELSE 'ok' END AS verdict FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def release_audit(spark, d):
    """XTR18."""
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    one, good = F.count_distinct(F.col("doc_id") % 4) == 1, F.count_if(F.col("quality") == 1)
    return j.groupBy("source").agg(one.alias("one_version"), good.alias("approved"), (n_() - good).alias("pending"), F.when(~one, "mixed_versions").when(good < n_(), "unapproved").otherwise("ok").alias("verdict"))


@query("gold_cases", "SELECT doc_id, 'Q' || doc_id AS case_id, lang AS domain, source || ':' || doc_id % 5 AS required_key, lag(doc_id) OVER (PARTITION BY source, lang ORDER BY doc_id) AS older_version FROM documents")
def gold_cases(spark, d):
    """XTR15: one case a chunk, with the version before it as forbidden evidence."""
    older = F.lag("doc_id").over(Window.partitionBy("source", "lang").orderBy("doc_id"))
    return table(spark, d, "documents").select("doc_id", F.concat(F.lit("Q"), F.col("doc_id")).alias("case_id"), F.col("lang").alias("domain"), F.concat("source", F.lit(":"), F.col("doc_id") % 5).alias("required_key"), older.alias("older_version"))


@query("gold_quota", "SELECT kind, lang, count(*) AS cases FROM (SELECT CASE WHEN n <= 5 THEN 'retrieval' WHEN n <= 8 THEN 'agentic' WHEN n <= 10 THEN 'security' ELSE 'performance' END AS kind, lang FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY md5('g:' || doc_id), doc_id) AS n FROM documents)) GROUP BY ALL")
def gold_quota(spark, d):
    """XTR16: quotas of a domain's cases by kind in the order of a hash. Only the ten that have one are numbered; the rest is the total less those."""
    docs = table(spark, d, "documents").select("lang", "doc_id")
    n = F.row_number().over(Window.partitionBy("lang").orderBy(F.md5(F.concat(F.lit("g:"), F.col("doc_id")).cast("binary")), "doc_id"))
    head = docs.withColumn("n", n).where("n <= 10").groupBy(F.when(F.col("n") <= 5, "retrieval").when(F.col("n") <= 8, "agentic").otherwise("security").alias("kind"), "lang").agg(n_().alias("cases"))
    rest = docs.groupBy("lang").agg(n_().alias("all")).where("all > 10").select(F.lit("performance").alias("kind"), "lang", (F.col("all") - 10).alias("cases"))
    return head.unionByName(rest)


@query("evidence_view", "SELECT lang AS query_id, doc_id, round(score, 4) AS score, attempts FROM (SELECT lang, doc_id // 2 AS doc_id, max(length(text)) AS score, count(DISTINCT doc_id % 3) AS attempts FROM documents WHERE doc_id % 4 < 3 AND text IS NOT NULL GROUP BY lang, doc_id // 2) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, doc_id) <= 5")
def evidence_view(spark, d):
    """XTR14: evidence of one generation over several attempts, each key by its best score with the attempts that found it."""
    x = table(spark, d, "documents").where("doc_id % 4 < 3 and text is not null").groupBy(F.col("lang").alias("query_id"), F.floor(F.col("doc_id") / 2).alias("doc_id")).agg(F.max(F.length("text")).alias("score"), F.count_distinct(F.col("doc_id") % 3).alias("attempts"))
    return R.top_k(x, 5).select("query_id", "doc_id", F.round("score", 4).alias("score"), "attempts")


_LEGACY = S.Derived("SELECT doc_id AS id, CASE doc_id % 3 WHEN 0 THEN 'MENTAL' ELSE upper(lang) END AS domain, split_part(text, '.', 1) AS question, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE ARRAY(source, lang) END AS expectedSources, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE ARRAY(split_part(text, ' ', 1), split_part(text, ' ', 2)) END AS expectedTerms FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL")


@query("case_migration", f"SELECT id, domain, 'fact' AS scenario, CASE WHEN domain = 'MENTAL' THEN 'high' ELSE 'low' END AS risk, question, array_to_string(coalesce(expectedTerms, []), '；') AS reference_answer, array_to_string(list_transform(coalesce(expectedSources, []), lambda s: domain || ':' || s || ':1:0'), ',') AS reference_context_ids FROM {_LEGACY.sql}")
def case_migration(spark, d):
    """XTR28: cases of the first schema in the second."""
    none = F.array().cast("array<string>")
    keys = F.transform(F.coalesce("expectedSources", none), lambda s: F.concat_ws(":", "domain", s, F.lit("1"), F.lit("0")))
    return _LEGACY.df(spark, d).select("id", "domain", F.lit("fact").alias("scenario"), F.when(F.col("domain") == "MENTAL", "high").otherwise("low").alias("risk"), "question", F.array_join(F.coalesce("expectedTerms", none), "；").alias("reference_answer"), F.array_join(keys, ",").alias("reference_context_ids"))


@query("review_windows", "SELECT b.item_id, d.doc_id, d.doc_id - b.item_id AS distance, coalesce(l.quality, -1) AS mark FROM benchmark b JOIN documents d ON d.doc_id BETWEEN b.item_id - 2 AND b.item_id + 2 LEFT JOIN labels l ON l.doc_id = d.doc_id")
def review_windows(spark, d):
    """XTR29: a passage's neighbours up to two away with the reviewers' marks, by an equi-join on the places and not a range."""
    near = table(spark, d, "benchmark").select("item_id", F.explode(F.sequence(F.col("item_id") - 2, F.col("item_id") + 2)).alias("doc_id"))
    j = near.join(table(spark, d, "documents").select("doc_id"), "doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return j.select("item_id", "doc_id", (F.col("doc_id") - F.col("item_id")).alias("distance"), F.coalesce("quality", F.lit(-1)).alias("mark"))


@query(
    "config_hash",
    """SELECT user_id, sha256('{' || CASE WHEN user_id % 3 = 0 THEN '' ELSE '"alpha":0.5,' END || '"k":' || max(event_id) || CASE WHEN user_id % 2 = 0 THEN '' ELSE ',"mode":"' || min(event_type) || '"' END || '}') AS frozen FROM events GROUP BY user_id""",
)
def config_hash(spark, d):
    """XTR30: a configuration's hash over its keys in order; keys that are not set don't count. Each user's last run, limits and mode stand for one."""
    k = F.col("user_id")
    of = table(spark, d, "events").groupBy("user_id").agg(F.max("event_id").alias("k"), F.min("event_type").alias("m"))
    named = of.select("user_id", F.when(k % 3 != 0, F.lit(0.5)).alias("alpha"), "k", F.when(k % 2 != 0, F.col("m")).alias("mode"))
    return named.select("user_id", F.sha2(F.to_json(F.struct("alpha", "k", "mode")), 256).alias("frozen"))


@query("final_report", "SELECT o_orderpriority AS category, count(*) AS cases, count_if(o_totalprice > 450000) AS failures, round(count_if(o_totalprice > 450000) / count(*), 4) AS rate, count_if(o_totalprice > 450000) / count(*) <= 0.2 AS gate FROM orders GROUP BY ALL")
def final_report(spark, d):
    """XTR31."""
    bad = F.count_if(F.col("o_totalprice") > 450000)
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("category")).agg(n_().alias("cases"), bad.alias("failures"), F.round(bad / n_(), 4).alias("rate"), (bad / n_() <= 0.2).alias("gate"))


@query("source_metrics", f"WITH {S.bm25()}, t AS ({S.top('bm25', 5)}), s AS (SELECT query_id, source, min(rank) AS rank FROM t JOIN documents USING (doc_id) GROUP BY ALL) SELECT query_id, count(*) AS sources, coalesce(max(1.0 / CASE WHEN source = 'src' || query_id % 9 THEN rank END), 0) AS mrr, bool_or(source = 'src' || query_id % 9) AS hit FROM s GROUP BY ALL")
def source_metrics(spark, d):
    """XTR32: the metrics at the grain of sources."""
    run = R.top_k(R.bm25(table(spark, d, "documents"), table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))), 5)
    s = run.join(table(spark, d, "documents").select("doc_id", "source"), "doc_id").groupBy("query_id", "source").agg(F.min("rank").alias("rank"))
    own = F.col("source") == F.concat(F.lit("src"), F.col("query_id") % 9)
    return s.groupBy("query_id").agg(n_().alias("sources"), F.coalesce(F.max(F.when(own, 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr"), F.bool_or(own).alias("hit"))


@query("security_corpus", "SELECT scenario, count(*) AS chunks, count_if(o = 1) AS own_tenant, count_if(l > 10) AS above_clearance FROM (SELECT unnest(['tenant', 'workspace', 'classification']) AS scenario, doc_id % 3 AS o, doc_id % 4 * 10 AS l FROM documents) GROUP BY ALL")
def security_corpus(spark, d):
    """XTR27: each scenario over the scoped corpus."""
    c = A.with_scope(table(spark, d, "documents").select("doc_id")).withColumn("scenario", F.explode(F.array(*map(F.lit, ("tenant", "workspace", "classification")))))
    return c.groupBy("scenario").agg(n_().alias("chunks"), F.count_if(F.col("organization_id") == 1).alias("own_tenant"), F.count_if(F.col("doc_id") % 4 * 10 > 10).alias("above_clearance"))


@query("enterprise_gate", "WITH m AS (SELECT 'quality' AS name, avg(CAST(quality = 1 AS INT)) AS v, 0.5 AS t, '>=' AS op FROM labels UNION ALL SELECT 'toxic', avg(CAST(toxic = 1 AS INT)), 0.2, '<=' FROM labels UNION ALL SELECT 'baseline_drop', (SELECT avg(CAST(quality = 1 AS INT)) FROM labels WHERE doc_id % 2 = 0) - avg(CAST(quality = 1 AS INT)), 0.1, '<=' FROM labels) SELECT name, round(v, 6) AS value, CASE op WHEN '>=' THEN v >= t ELSE v <= t END AS ok, bool_and(CASE op WHEN '>=' THEN v >= t ELSE v <= t END) OVER () AS gate FROM m")
def enterprise_gate(spark, d):
    """AGG50: thresholds and the fall against a baseline; the gate holds if all do."""
    q = F.avg((F.col("quality") == 1).cast("int"))
    base = F.avg(F.when(F.col("doc_id") % 2 == 0, (F.col("quality") == 1).cast("int")))
    m = table(spark, d, "labels").agg(q.alias("quality"), F.avg((F.col("toxic") == 1).cast("int")).alias("toxic"), (base - q).alias("drop"))
    rows = [("quality", F.col("quality"), F.col("quality") >= 0.5), ("toxic", F.col("toxic"), F.col("toxic") <= 0.2), ("baseline_drop", F.col("drop"), F.col("drop") <= 0.1)]
    all_ok = rows[0][2] & rows[1][2] & rows[2][2]
    return m.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.round(v, 6).alias("value"), ok.alias("ok"), all_ok.alias("gate")) for n, v, ok in rows))).alias("x")).select("x.*")


@query(
    "truth_facts",
    "SELECT l_partkey AS product_id, count(*) AS facts, max(l_linenumber) AS current, CAST(sum(l_quantity) FILTER (l_linenumber = m) AS DOUBLE) AS stated, count(DISTINCT l_returnflag) AS distinct_values FROM (SELECT *, max(l_linenumber) OVER (PARTITION BY l_partkey) AS m FROM lineitem) GROUP BY ALL",
)
def truth_facts(spark, d):
    """SRC13: facts of products in versions (lines of orders of a part); what the latest version states."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("product_id"), F.col("l_linenumber").alias("v")).agg(n_().alias("n"), F.sum("l_quantity").cast("double").alias("q"), F.collect_set("l_returnflag").alias("flags"))
    g = l.groupBy("product_id").agg(F.sum("n").alias("facts"), F.max("v").alias("current"), F.max_by("q", "v").alias("stated"), F.size(F.array_distinct(F.flatten(F.collect_list("flags")))).cast("long").alias("distinct_values"))
    return g.select("product_id", "facts", "current", "stated", "distinct_values")


@query(
    "compatibility_edges",
    "SELECT a.p_partkey AS a, b.p_partkey AS b, a.p_size = b.p_size OR a.p_type = b.p_type AS compatible FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 OR b.p_partkey = a.p_partkey + 3",
)
def compatibility_edges(spark, d):
    """SRC14: each product with two later ones, by their keys."""
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_type")
    a = p.select(F.col("p_partkey").alias("a"), F.col("p_size").alias("sa"), F.col("p_type").alias("ta"), F.explode(F.array(F.col("p_partkey") + 1, F.col("p_partkey") + 3)).alias("b"))
    return a.join(p.withColumnRenamed("p_partkey", "b"), "b").select("a", "b", ((F.col("sa") == F.col("p_size")) | (F.col("ta") == F.col("p_type"))).alias("compatible"))


@query("sheet_markdown", "SELECT n_regionkey AS sheet, string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS body, count(*) AS rows FROM nation GROUP BY ALL")
def sheet_markdown(spark, d):
    """SRC12: a sheet's rows as a Markdown table; a sheet is one group and small by its kind."""
    line = F.concat(F.lit("| "), F.col("n_nationkey"), F.lit(" | "), F.col("n_name"), F.lit(" |"))
    g = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("sheet")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))).alias("x"), n_().alias("rows"))
    return g.select("sheet", F.array_join(F.transform("x", lambda x: x["l"]), "\n").alias("body"), "rows")
