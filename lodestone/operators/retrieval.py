"""Lexical and dense retrieval as joins and windows. Runs are rows (query_id, doc_id, score[, rank])."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions import vector as V

#: Rows of a query side that are sent to all executors at most; more are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of query vectors that are sent to the executors at a time.
QUERY_BYTES = 32 << 20
#: Tasks a core, at most, that compare rows with queries. Queries, rows and pairs to score that a task compares at a time.
TASKS_A_CORE, TILE_QUERIES, TILE_ROWS, TILE_PAIRS = 4, 1024, 2048, 32_768


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint where its size is checked to be small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def top_k(run: DataFrame, k: int, by: str = "score", keys: tuple[str, ...] = ("query_id",), tie: str = "doc_id") -> DataFrame:
    """The k best of each query with their rank from 1; ties by key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(by), F.asc(tie))
    return run.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, tokenise=T.tokens) -> DataFrame:
    """(query_id, term, qtf)."""
    return queries.select("query_id", F.explode(tokenise(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _term_counts(docs: DataFrame, tokenise, wanted: DataFrame | None = None) -> DataFrame:
    """(doc_id, dl, term, tf) and, for each document, a row of the term '' that counts its rows, so that also those without a wanted term are there.

    One scan and one shuffle, by document: what is worked out by document after it needs no further one, and all that is derived from
    it reuses that shuffle. Only wanted terms leave the scan.
    """
    rows = docs.select("doc_id", tokenise(F.col("text")).alias("tokens")).select("doc_id", F.size("tokens").alias("dl"), F.explode(F.concat("tokens", F.array(F.lit("")))).alias("term")).where("term is not null")
    if wanted is not None:
        rows = rows.join(wanted, "term", "left_semi")
    return rows.repartition("doc_id").groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, boost: bool = True, least_avgdl: float = 0.0, tokenise=T.tokens) -> DataFrame:
    """(query_id, doc_id, score > 0) over the documents as given, whose statistics these are.

    docs: doc_id, text. queries: query_id, query; their terms are broadcast where they are few. Documents are scanned once and shuffled once.
    """
    terms = query_terms(queries, tokenise)
    few = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    wanted = terms.select("term").unionByName(docs.sparkSession.createDataFrame([("",)], "term string")).distinct()
    tf = _term_counts(docs, tokenise, sent(wanted))
    # No filters here: they would be pushed below the shuffle, which then could not be reused.
    own = F.when(F.col("term") == "", F.col("tf"))
    stats = tf.agg(F.sum(own).alias("n"), (F.sum(own * F.col("dl")) / F.sum(own)).alias("avgdl"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = sent(terms.join(df, "term"))  # no more rows than terms
    scored = tf.join(weighted, "term").crossJoin(F.broadcast(stats))  # one row of statistics
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = 1 - b + b * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(least_avgdl))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * length)
    if boost:
        part = part * (1 + F.log(F.col("qtf")))
    return scored.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score")).where("score > 0")


def token_cosine(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score > 0): cosine of term counts. A document's norm and its shared terms come from one shuffle by document."""
    terms = query_terms(queries)
    few = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def sent(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    own = terms.groupBy("query_id").agg(F.sum(F.col("qtf") * F.col("qtf")).alias("qq"))
    wanted = terms.select("term").distinct().withColumn("wanted", F.lit(True))
    tf = _term_counts(docs, T.tokens).where("term <> ''").join(sent(wanted), "term", "left")
    shared = F.collect_list(F.when(F.col("wanted"), F.struct("term", "tf")))
    by_doc = tf.groupBy("doc_id").agg(F.sum(F.col("tf") * F.col("tf")).alias("dd"), shared.alias("shared")).select("doc_id", "dd", F.explode("shared").alias("s")).select("doc_id", "dd", "s.term", "s.tf")
    dots = by_doc.join(sent(terms), "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("tf") * F.col("qtf")).alias("dot"), F.first("dd").alias("dd"))
    return dots.join(sent(own), "query_id").select("query_id", "doc_id", F.round(F.col("dot") / F.sqrt(F.col("dd") * F.col("qq")), 6).alias("score"))


def lexical_features(pairs: DataFrame) -> DataFrame:
    """Adds keyword, coverage and phrase to rows with query and text."""
    q, t = F.col("query"), F.col("text")
    return pairs.withColumns({"keyword": T.keyword_score(q, t), "coverage": T.coverage(T.tokens(q), T.tokens(t)), "phrase": T.phrase_score(q, t)})


def containing(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents whose text holds the query as it is.

    A word inside a query, with white space on both sides, is a whole word of any text that holds the query: the longest such word is looked
    up and its documents are verified. Queries of fewer than three words have none; those alone are tried on each text, by a broadcast join
    up to BROADCAST_ROWS of them.
    """
    own = queries.select("query_id", "query", F.split("query", r"\s").alias("w")).where("query is not null")
    inside = F.filter(F.slice("w", F.lit(2), F.greatest(F.size("w") - 2, F.lit(0))), lambda w: w != "")
    longest = F.array_max(F.transform(inside, lambda w: F.struct(F.length(w).alias("n"), w.alias("word"))))
    keyed = own.withColumn("word", longest["word"])
    keys = keyed.where("word is not null").select("query_id", "query", "word")
    words = docs.select("doc_id", F.explode(F.array_distinct(F.split("text", r"\s"))).alias("word"))
    candidates = words.join(small(keys), "word").select("query_id", "query", "doc_id")
    found = candidates.join(docs.select("doc_id", "text"), "doc_id").where(F.col("text").contains(F.col("query"))).select("query_id", "doc_id")
    short = keyed.where("word is null").select("query_id", "query")
    tried = docs.select("doc_id", "text").join(small(short), F.col("text").contains(F.col("query"))).select("query_id", "doc_id")
    return found.unionByName(tried)


def rerank_score(base: Column, lexical: Column, coverage: Column, phrase: Column) -> Column:
    return 0.55 * base + 0.25 * lexical + 0.15 * coverage + 0.05 * phrase


def knn(index: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, doc_id, score, rank) by exact cosine; queries: query_id, q (vector), never matched with the row of their own id. Ids are integers.

    The queries are a stated set against all rows. They go to the executors in blocks of QUERY_BYTES as one matrix; each task compares them with
    its rows in tiles and keeps the k best of each query. A task reads several splits where there are more than TASKS_A_CORE a core, so the rows
    that are shuffled grow with the queries, not with the queries times the splits. Vectors without a length score as if at right angles;
    null vectors and those of another length are left out.
    """
    spark = index.sparkSession
    own = queries.select(F.col("query_id").cast("long").alias("query_id"), V.doubles(F.col("q")).alias("q")).where("query_id is not null and q is not null")
    size = own.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("dim")).first()
    blocks = max(1, -(-(size["n"] * (size["dim"] or 1) * 8) // QUERY_BYTES))
    rows = index.select(F.col(id).cast("long").alias("doc_id"), V.doubles(F.col(vector)).alias("v")).where("doc_id is not null and v is not null").coalesce(TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    kinds = "query_id long, doc_id long, score double"
    out = None
    for i in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        found = part.toArrow()
        lengths = pc.list_value_length(found["q"]).to_numpy()
        for dim in np.unique(lengths[lengths > 0]):
            same = found.filter(pa.array(lengths == dim))
            vectors = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in same["q"].chunks]).reshape(-1, dim)
            near = rows.mapInArrow(_nearest(same["query_id"].to_numpy().astype(np.int64), vectors, k), kinds)
            out = near if out is None else out.unionByName(near)
    return top_k(spark.createDataFrame([], kinds) if out is None else out, k)


class Best:
    """The k best documents of each query so far, by score and, for equal scores, by the least key. Queries go by their place in ids."""

    def __init__(self, ids: np.ndarray, k: int):
        self.ids, self.scores, self.docs = ids, np.full((len(ids), k), -1.0), np.zeros((len(ids), k), np.int64)

    def add(self, i: np.ndarray, doc: np.ndarray, score: np.ndarray) -> None:
        """Puts documents among the best of the queries at i."""
        k = self.scores.shape[1]
        last = self.scores[i, -1]
        better = (score > last) | (score == last) & (doc < self.docs[i, -1])
        some, group = np.unique(i[better], return_inverse=True)
        g = np.concatenate((np.repeat(np.arange(len(some)), k), group))
        s, d = np.concatenate((self.scores[some].ravel(), score[better])), np.concatenate((self.docs[some].ravel(), doc[better]))
        order = np.lexsort((d, -s, g))
        first = np.searchsorted(g[order], np.arange(len(some)))
        order = order[(first[:, None] + np.arange(k)).ravel()]
        self.scores[some], self.docs[some] = s[order].reshape(-1, k), d[order].reshape(-1, k)

    def batch(self) -> pa.RecordBatch:
        some = self.scores >= 0
        rows = [np.broadcast_to(self.ids[:, None], some.shape)[some], self.docs[some], self.scores[some]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["query_id", "doc_id", "score"])


def _nearest(ids: np.ndarray, q: np.ndarray, k: int):
    """A mapInArrow function: the k best rows of all batches for each query.

    A tile of queries times rows is compared in single precision; what may be among the k best by that, its error counted, is scored in double precision.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = q.shape[1]
        slack = (dim + 16) * 1.2e-7  # of a dot product of unit vectors in single precision
        qn = np.sqrt((q * q).sum(1))
        near_q = np.divide(q, qn[:, None], out=np.zeros_like(q), where=qn[:, None] > 0).astype(np.float32)
        best = Best(ids, k)

        def add(at: int, i: np.ndarray, doc: np.ndarray, v: np.ndarray, vn: np.ndarray) -> None:
            """Puts the exact scores of query at + i with row v among the best."""
            i = i + at
            size = qn[i] * vn
            cos = np.divide(np.einsum("ij,ij->i", q[i], v), size, out=np.zeros(len(i)), where=size > 0)
            score = np.round(1 / (1 + np.maximum(0.0, 1 - cos)), 6)
            apart = ids[i] != doc
            best.add(i[apart], doc[apart], score[apart])

        def tile(at: int, doc: np.ndarray, v: np.ndarray, vn: np.ndarray, near_v: np.ndarray) -> None:
            cos = near_q[at : at + TILE_QUERIES] @ near_v.T
            last = best.scores[at : at + TILE_QUERIES, -1]
            # Scores are equal to six decimals: cosines up to 1e-5 apart may be.
            least = np.where(last > 0, 2 - 1 / (np.maximum(last, 0.3) - 6e-7) - slack, -np.inf)
            if (last <= 0).any() and len(doc) > k:
                least = np.maximum(least, np.where(last > 0, -np.inf, np.partition(cos, -k - 1, axis=1)[:, -k - 1] - 2 * slack - 1e-5))
            i, j = np.nonzero(cos >= least.astype(np.float32)[:, None] - np.float32(1e-6))
            for start in range(0, len(i), TILE_PAIRS):
                a, b = i[start : start + TILE_PAIRS], j[start : start + TILE_PAIRS]
                add(at, a, doc[b], v[b], vn[b])

        for batch in batches:
            whole = np.flatnonzero(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False) == dim)
            for start in range(0, len(whole), TILE_ROWS):
                own = batch.take(pa.array(whole[start : start + TILE_ROWS]))
                doc, v = own.column(0).to_numpy().astype(np.int64), own.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                vn = np.sqrt((v * v).sum(1))
                sound = np.isfinite(vn)
                doc, v, vn = doc[sound], v[sound], vn[sound]
                near_v = np.divide(v, vn[:, None], out=np.zeros_like(v), where=vn[:, None] > 0).astype(np.float32)
                for at in range(0, len(ids), TILE_QUERIES):
                    tile(at, doc, v, vn, near_v)
        yield best.batch()

    return run


def minmax_positive(run: DataFrame, score: str = "score", out: str = "score") -> DataFrame:
    """Scores of a query scaled between its least and largest positive ones; those not positive get 0, equal ones 1."""
    w = Window.partitionBy("query_id")
    up = F.when(F.col(score) > 0, F.col(score))
    low, high = F.min(up).over(w), F.max(up).over(w)
    return run.withColumn(out, F.when(F.col(score) <= 0, 0.0).when(high == low, 1.0).otherwise((F.col(score) - low) / (high - low)))


def weighted_fusion(a: DataFrame, b: DataFrame, wa: float = 0.2, wb: float = 0.8) -> DataFrame:
    """Both runs' scaled scores, weighted; a query that only one run has hits for counts that run alone."""
    x = minmax_positive(a).select("query_id", "doc_id", F.col("score").alias("sa"))
    y = minmax_positive(b).select("query_id", "doc_id", F.col("score").alias("sb"))
    both = x.join(y, ["query_id", "doc_id"], "full")
    w = Window.partitionBy("query_id")
    some_a, some_b = F.count("sa").over(w) > 0, F.count("sb").over(w) > 0
    left, right = F.when(some_a, F.lit(wa)).otherwise(0.0), F.when(some_b, F.lit(wb)).otherwise(0.0)
    fused = (left * F.coalesce("sa", F.lit(0.0)) + right * F.coalesce("sb", F.lit(0.0))) / (left + right)
    return both.select("query_id", "doc_id", F.round(fused, 6).alias("score"))


def rrf(runs: list[DataFrame], weights: list[float] | None = None, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of ranked runs: the sum of weight / (k + rank), each key once a run by its best rank."""
    parts = [r.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank")).withColumn("w", F.lit(float(w))) for r, w in zip(runs, weights or [1.0] * len(runs), strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") / (k + F.col("rank"))), 6).alias("score"))


def interleave(runs: list[DataFrame], k: int) -> DataFrame:
    """Ranked lists dealt in turns, each key at its first place; ranks anew."""
    out = None
    for i, r in enumerate(runs):
        part = r.select("query_id", "doc_id", (F.col("rank") * len(runs) + i).alias("place"))
        out = part if out is None else out.unionByName(part)
    first = out.groupBy("query_id", "doc_id").agg(F.min("place").alias("place"))
    order = Window.partitionBy("query_id").orderBy("place")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "doc_id", "rank")


def diversity_cap(run: DataFrame, group: str, cap: int, k: int) -> DataFrame:
    """The k best of each query with at most `cap` of one group."""
    inner = Window.partitionBy("query_id", group).orderBy(F.desc("score"), "doc_id")
    return top_k(run.withColumn("_g", F.row_number().over(inner)).where(F.col("_g") <= cap).drop("_g"), k)


def blend(run: DataFrame, mode: str = "alpha", alpha: float = 0.5, k: int = 60) -> DataFrame:
    """Reranks rows with base and rerank scores: `pure` rerank, `rrf` of both orders, or an alpha blend of both, scaled."""
    w = Window.partitionBy("query_id")
    if mode == "pure":
        return run.withColumn("score", F.col("rerank"))
    if mode == "rrf":
        a, b = (F.row_number().over(w.orderBy(F.desc(c), "doc_id")) for c in ("base", "rerank"))
        return run.withColumn("score", F.round(1 / (k + a) + 1 / (k + b), 6))

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(high == low, 1.0).otherwise((F.col(c) - low) / (high - low))

    return run.withColumn("score", F.round(alpha * scaled("rerank") + (1 - alpha) * scaled("base"), 6))


def fielded_score(query: Column, title: Column, section: Column, body: Column) -> Column:
    """5, 4 and 1 times the gram recall on title, section and body, and 5 more where title or section holds the query."""
    q = T.fingerprint_form(query)
    phrase = (q != "") & (T.fingerprint_form(title).contains(q) | T.fingerprint_form(section).contains(q))
    return 5 * T.gram_recall(query, title) + 4 * T.gram_recall(query, section) + T.gram_recall(query, body) + F.when(phrase, 5.0).otherwise(0.0)


def fielded_rerank(run: DataFrame) -> DataFrame:
    """0.5 times the fielded score, scaled within the query, and 0.35 times the place: (n - i) / n from the front."""
    w = Window.partitionBy("query_id")
    low, high, n = F.min("fielded").over(w), F.max("fielded").over(w), F.count(F.lit(1)).over(w)
    scaled = F.when(high == low, 0.0).otherwise((F.col("fielded") - low) / (high - low))
    return run.withColumn("score", F.round(0.5 * scaled + 0.35 * (n - F.col("rank") + 1) / n, 6))


def collapse_duplicates(run: DataFrame, content: str = "text") -> DataFrame:
    """Rows of a query with one normal form: the best-ranked stays and lists the keys of the others."""
    form = F.sha2(T.fingerprint_form(F.col(content)), 256)
    g = run.withColumn("_f", form).groupBy("query_id", "_f").agg(F.min_by("doc_id", F.struct("rank", "doc_id")).alias("doc_id"), F.min("rank").alias("rank"), F.array_sort(F.collect_set("doc_id")).alias("all"))
    return g.select("query_id", "doc_id", "rank", F.array_except("all", F.array("doc_id")).alias("equivalent_keys"))


def merge_evidence(evidence: DataFrame, low: float = 0.1, high: float = 1.0, cap: int = 3) -> DataFrame:
    """Rows of several rounds (query_id, doc_id, source, score): each id by its best score, scaled to [low, high], at most `cap` a source."""
    best = evidence.groupBy("query_id", "doc_id").agg(F.max("score").alias("raw"), F.max_by("source", F.struct("score", "source")).alias("source"))
    w = Window.partitionBy("query_id")
    lo, hi = F.min("raw").over(w), F.max("raw").over(w)
    scaled = F.when(hi == lo, F.lit(high)).otherwise(F.round(low + (F.col("raw") - lo) / (hi - lo) * (high - low), 4))
    per = Window.partitionBy("query_id", "source").orderBy(F.desc("score"), "doc_id")
    return best.withColumn("score", scaled).withColumn("_n", F.row_number().over(per)).where(F.col("_n") <= cap).drop("_n", "raw")


def expand_neighbours(chunks: DataFrame, hits: DataFrame, radius: int = 1) -> DataFrame:
    """Each hit's chunk with those up to `radius` before and after it in the same source and version, joined in order by an empty line."""
    key = ["source_key", "version"]
    wanted = hits.select("query_id", *key, F.col("source_index").alias("hit_index"), F.explode(F.sequence(F.col("source_index") - radius, F.col("source_index") + radius)).alias("source_index"))
    near = chunks.join(wanted, [*key, "source_index"])
    parts = F.array_sort(F.collect_list(F.struct("source_index", "content")))
    return near.groupBy("query_id", *key, "hit_index").agg(F.array_join(F.transform(parts, lambda p: p["content"]), "\n\n").alias("content"), F.count(F.lit(1)).alias("n_chunks"))


def shingle_classes(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, class_id): each document with the least doc_id that has its set of word shingles, under which near_duplicates.pairs names it.

    Sets go by their SHA-256; documents of fewer words than a shingle have none and are left out.
    """
    split = F.filter(F.split(F.lower(F.col("text")), r"\s+"), lambda w: w != "")
    own = docs.select("doc_id", F.array_sort(T.word_shingles(split, words)).alias("s")).where(F.size("s") > 0).select("doc_id", F.sha2(F.array_join("s", "\n"), 256).alias("form"))
    return own.join(own.groupBy("form").agg(F.min("doc_id").alias("class_id")), "form").select("doc_id", "class_id")
