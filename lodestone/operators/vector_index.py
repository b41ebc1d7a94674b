"""An index of vectors by cells, stored as partitions, that is probed cell by cell.

Centroids are fitted on a bounded sample; every row of the table lies in the cell of its nearest centroid, one folder a cell. A search
reads only the folders of the cells that it probes and scores what it finds there exactly. Each cell keeps the widest angle of its
rows, so a search can also go on until no cell that is left can hold a better row: its result is then that of an exact search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import vector as V
from lodestone.operators.retrieval import QUERY_BYTES, top_k

#: Vectors that centroids are fitted on, at most about so many; most cells; rows of a cell's file.
SAMPLE, MOST_CELLS, FILE_ROWS = 16_384, 4_096, 200_000
#: The share of the nearest rows that a search is to find when nothing else is said; a little more is asked of the sample.
RECALL = 0.95
#: The cell of vectors without a direction, which are at right angles to all others.
NO_DIRECTION = -1
#: What rounding may add to a bound.
SLACK = 1e-6


def score_of(cosine: np.ndarray) -> np.ndarray:
    return np.round(1 / (1 + np.maximum(0.0, 1 - cosine)), 6)


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.sqrt((v * v).sum(1))
    return np.divide(v, size[:, None], out=np.zeros_like(v), where=size[:, None] > 0), size > 0


def centroids(v: np.ndarray, cells: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Unit vectors by Lloyd's steps on the sphere; a cell that loses all its rows starts anew at the row that is worst served."""
    v, some = _unit(v)
    v = v[some]
    if not len(v):
        return np.zeros((0, v.shape[1]))
    rng = np.random.default_rng(seed)
    c = v[rng.permutation(len(v))[:cells]]
    for _ in range(rounds):
        near = v @ c.T
        own = near.argmax(1)
        best = near.max(1)
        for k in np.setdiff1d(np.arange(len(c)), own):
            own[far := int(best.argmin())] = k
            best[far] = 1
        order = np.argsort(own, kind="stable")
        sums = np.add.reduceat(v[order], np.searchsorted(own[order], np.arange(len(c))), axis=0)
        c, good = _unit(sums)
        c[~good] = v[rng.integers(len(v), size=int((~good).sum()))]
    return c


def _vectors(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _placed(rows: DataFrame, c: np.ndarray, vector: str) -> DataFrame:
    """rows with `cell` and `angle`, that to the cell's centroid."""
    dim = c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, some = _unit(_vectors(batch, vector, dim))
            near = unit @ c.T if len(c) else np.zeros((len(unit), 1))
            cell = np.where(some, near.argmax(1), NO_DIRECTION).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(np.arccos(np.clip(near.max(1), -1, 1)))], [*batch.schema.names, "cell", "angle"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, cell int, angle double")


def _write(placed: DataFrame, path: str, id: str) -> None:
    """Adds placed rows to the folders of their cells, and a row for each cell to the table of cells; a large cell is written by several tasks."""
    spark = placed.sparkSession
    placed.write.parquet(staged := f"{path}/staged")
    rows = spark.read.schema(placed.schema).parquet(staged)
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("angle").alias("angle"))
    parts = F.broadcast(cells.select("cell", F.ceil(F.col("rows") / FILE_ROWS).alias("parts")))  # MOST_CELLS + 1 rows at most
    dealt = rows.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64(id), F.col("parts"))).repartition("cell", "part").drop("parts", "part", "angle")
    dealt.write.mode("append").partitionBy("cell").parquet(f"{path}/rows")
    cells.coalesce(1).write.mode("append").parquet(f"{path}/cells")
    _delete(spark, staged)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _slim(rows: DataFrame, id: str, vector: str, keep: tuple[str, ...]) -> DataFrame:
    return rows.select(F.col(id).alias("doc_id"), V.doubles(F.col(vector)).alias("v"), *keep).where("doc_id is not null and v is not null")


def build(rows: DataFrame, path: str, id: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = (), cells: int | None = None, sample: int = SAMPLE) -> None:
    """Writes an index of all rows to path: centroids, a folder of rows for each cell, and what each cell holds.

    The length of most vectors is the index's; null vectors and those of another length are left out, and so are rows without an id. keep: columns that
    filters may use. cells: by default the root of the number of rows. Centroids come from `sample` rows, chosen by a hash of the id.
    """
    slim = _slim(rows, id, vector, keep)
    sizes = slim.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, n = (sizes["dim"], sizes["n"]) if sizes else (0, 0)
    whole = slim.where(F.size("v") == dim)
    cells = min(cells or max(1, round(n**0.5)), MOST_CELLS)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, sample / max(n, 1)) * (1 << 30))
    got = whole.where(share).select("doc_id", "v").toArrow().sort_by("doc_id")
    v = np.array(got.column("v").to_pylist(), np.float64).reshape(-1, dim) if dim else np.zeros((0, 0))
    c = centroids(v, cells)
    spark = rows.sparkSession
    spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(c)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    spark.createDataFrame([(calibrated(v, c),)], "probes int").coalesce(1).write.parquet(f"{path}/measured")
    _write(_placed(whole, c, "v"), path, "doc_id")


def add(rows: DataFrame, path: str, id: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = ()) -> None:
    """Puts more rows into an index; its centroids stay, only the folders of the rows' cells get files."""
    c, _ = _cells(rows.sparkSession, path)
    _write(_placed(_slim(rows, id, vector, keep).where(F.size("v") == c.shape[1]), c, "v"), path, "doc_id")


def _cells(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The centroids, and each cell's widest angle; -1 for a cell without rows. MOST_CELLS rows at most."""
    got = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
    c = np.array([r["centroid"] for r in got], np.float64)
    wide = np.full(len(c), -1.0)
    for r in spark.read.parquet(f"{path}/cells").groupBy("cell").agg(F.max("angle").alias("angle")).collect():
        if r["cell"] >= 0:
            wide[r["cell"]] = r["angle"]
    return c, wide


def calibrated(v: np.ndarray, c: np.ndarray, k: int = 10, asked: int = 256, recall: float = RECALL) -> int:
    """How many cells must be probed for `recall` of the k nearest, as measured on the fitted sample."""
    v, some = _unit(v)
    v = v[some]
    if len(v) < 2 or not len(c):
        return max(1, len(c))
    q = v[:: max(1, len(v) // asked)]
    near = q @ v.T
    near[np.arange(len(q)), np.arange(0, len(v), max(1, len(v) // asked))] = -2
    best = np.argpartition(-near, min(k, len(v) - 1) - 1, axis=1)[:, : min(k, len(v) - 1)]
    own = (v @ c.T).argmax(1)
    place = np.argsort(np.argsort(-(q @ c.T), axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.take_along_axis(place, own[best], axis=1) + 1
    return int(np.ceil(np.quantile(needed, recall)))


def default_probes(spark: SparkSession, path: str) -> int:
    """The number of cells that build() has measured for RECALL."""
    return spark.read.parquet(f"{path}/measured").first()["probes"]


def probed(spark: SparkSession, path: str, cells: set[int]) -> DataFrame:
    """The rows of some cells; the other cells' folders are not read."""
    return spark.read.parquet(f"{path}/rows").where(F.col("cell").isin(sorted(cells)))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int | None = None, exact: bool = False, where: Column | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the k rows nearest to each query by cosine, never the row of the query's own id.

    queries: query_id, q (vector); they are taken in blocks of QUERY_BYTES. Each query probes the cells of its nearest centroids, as many as were measured
    for RECALL unless probes says otherwise; with exact, then
    every cell that may still hold one of its k best. where: a filter on kept columns, applied before the k best are chosen. Vectors without a
    direction score as if at right angles and are found by an exact search only. Ties go by doc_id.
    """
    c, wide = _cells(spark, path)
    probes = default_probes(spark, path) if probes is None else probes
    own = queries.select("query_id", V.doubles(F.col("q")).alias("q")).where(F.col("query_id").isNotNull() & (F.size("q") == c.shape[1]))
    n = own.count()
    blocks = max(1, -(-n * max(1, c.shape[1]) * 8 // QUERY_BYTES))
    ids = spark.read.parquet(f"{path}/rows").schema["doc_id"].dataType.simpleString()
    kinds = f"query_id {own.schema['query_id'].dataType.simpleString()}, doc_id {ids}, score double"
    out = None
    for i in range(blocks):
        part = own if blocks == 1 else own.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        found = part.collect()
        if found and len(c):
            near = _block(spark, path, [r["query_id"] for r in found], np.array([r["q"] for r in found], np.float64), c, wide, k, probes, exact, where, kinds)
            out = near if out is None else out.unionByName(near)
    return top_k(spark.createDataFrame([], kinds) if out is None else out, k)


def _block(spark: SparkSession, path: str, ids: list, q: np.ndarray, c: np.ndarray, wide: np.ndarray, k: int, probes: int, exact: bool, where: Column | None, kinds: str) -> DataFrame:
    unit, some = _unit(q)
    near = unit @ c.T
    near[:, wide < 0] = -2
    first = np.argsort(-near, axis=1, kind="stable")[:, : max(1, probes)]
    taken = np.zeros(near.shape, bool)
    np.put_along_axis(taken, first, True, axis=1)
    taken &= near > -2
    run = _scan(spark, path, ids, unit, taken, np.zeros(len(ids), bool), k, where, kinds)
    if not exact:
        return run
    # Once more, over the cells that the k-th best of a query does not rule out.
    kth = {r["query_id"]: r["score"] for r in top_k(run, k).where(F.col("rank") == k).select("query_id", "score").collect()}
    least = np.array([kth.get(i, -1.0) for i in ids])
    gap = np.arccos(np.clip(near, -1, 1)) - wide[None, :]
    bound = score_of(np.cos(np.clip(gap, 0, np.pi)) + SLACK)
    more = (bound >= least[:, None]) & (wide >= 0)[None, :] & ~taken
    more[~some] = (wide >= 0)[None, :] & ~taken[~some]
    plain = least <= score_of(np.array(0.0))
    if not more.any() and not plain.any():
        return run
    return run.unionByName(_scan(spark, path, ids, unit, more, plain, k, where, kinds))


def _scan(spark: SparkSession, path: str, ids: list, unit: np.ndarray, taken: np.ndarray, plain: np.ndarray, k: int, where: Column | None, kinds: str) -> DataFrame:
    """The k best rows a task of each query, from the cells that it takes; plain: queries that also take vectors without a direction."""
    cells = set(np.flatnonzero(taken.any(0)).tolist()) | ({NO_DIRECTION} if plain.any() else set())
    rows = probed(spark, path, cells)
    rows = (rows if where is None else rows.where(where)).select("doc_id", "v", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, dim = np.array(ids), unit.shape[1]
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            cell, doc = batch.column("cell").to_numpy(), batch.column("doc_id").to_numpy()
            v, _ = _unit(_vectors(batch, "v", dim))
            for own in np.unique(cell):
                asks = np.flatnonzero(plain if own == NO_DIRECTION else taken[:, own])
                at = np.flatnonzero(cell == own)
                score = score_of(unit[asks] @ v[at].T)
                score[name[asks][:, None] == doc[at][None, :]] = -1
                for j, ask in enumerate(asks.tolist()):
                    s, d = score[j], doc[at]
                    if ask in best:
                        s, d = np.concatenate((best[ask][0], s)), np.concatenate((best[ask][1], d))
                    order = np.lexsort((d, -s))[:k]
                    best[ask] = s[order], d[order]
        if best:
            asks = sorted(best)
            s, d = np.concatenate([best[a][0] for a in asks]), np.concatenate([best[a][1] for a in asks])
            keep = s >= 0
            who = np.repeat(name[asks], [len(best[a][0]) for a in asks])
            yield pa.RecordBatch.from_arrays([pa.array(who[keep]), pa.array(d[keep]), pa.array(s[keep])], ["query_id", "doc_id", "score"])

    return rows.mapInArrow(run, kinds)
