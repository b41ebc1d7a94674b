"""A Merkle manifest of a dataset: a tree of SHA-256 digests over each group of documents, and one over the groups.

A document's place in its group is its exact rank by id, found without a global sort: ids are paths of hexadecimal digits, rows are
counted by a long prefix of the path, the counts are summed again for each shorter prefix, and a place is the sum of what lies before it at
each digit and inside its own last bucket, which holds few rows. The rank's digits in the base of the tree's fan-out then key the
nodes of a trie: rows whose ranks share all but the last digits meet in one bounded group, several levels are reduced there, and the next pass
does the same for the prefixes that are left. Proofs are handed down the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.arrow import named, table, written

#: Children of a node, and levels that one pass reduces: FANOUT ** LEVELS rows at most meet in a group.
FANOUT, LEVELS = 3, 6
#: Hexadecimal digits of a path that one histogram tells apart, so a bucket has 16 ** DIGITS children at most.
DIGITS = 2
#: Equal rows are dealt out again in runs of so many, where there are more of them.
RUN = 4096
PROOF = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """`-` for null, else the number of bytes, `:` and the value as text, so no two lists of fields read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    """The digest of a row's fields."""
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def folded(digest: Column, proof: Column) -> Column:
    """The root that a digest leads to with the siblings of a proof."""
    return F.aggregate(proof, digest, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of a proof's siblings, level by level and left to right; that of an empty text where there are none."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda step: F.concat(step["left"], step["right"]))), 256)


def _h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _levels(nodes: list[str], last: bool, fanout: int, most: int) -> list[list[str]]:
    """The nodes of a group, then those of each level above: up to one node in a last pass, else so many levels as a pass has."""
    out = [nodes]
    while len(out[-1]) > 1 if last else len(out) <= most:
        now = out[-1]
        out.append([_h("".join(now[k : k + fanout])) for k in range(0, len(now), fanout)])
    return out


def _climb(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(grp, idx, digest, n): the nodes of the next pass, from those of this one. n: how many the group has."""
    size = fanout**levels

    def top(part: pa.Table) -> pa.Table:
        part = part.sort_by("idx")
        n = part.column("n")[0].as_py()
        up = _levels(part.column("digest").to_pylist(), n <= size, fanout, levels)[-1]
        return pa.table([part.column("grp")[:1], pa.array([part.column("idx")[0].as_py() // size]), pa.array(up), pa.array([-(-n // size)])], ["grp", "idx", "digest", "n"])

    keyed = nodes.select("grp", F.expr(f"idx div {size}").alias("block"), "idx", "digest", "n")
    return keyed.groupBy("grp", "block").applyInArrow(top, "grp string, idx long, digest string, n long")


def _descend(nodes: DataFrame, above: DataFrame, carry: str, fanout: int, levels: int) -> DataFrame:
    """nodes (grp, idx, digest, n and the columns of carry) with `proof`: its steps in the group, then those of the group's node in above (grp, idx, proof)."""
    size, names = fanout**levels, [c.split()[0] for c in carry.split(", ")] if carry else []

    def down(part: pa.Table, over: pa.Table) -> pa.Table:
        part = part.sort_by("idx")
        at, n = part.column("idx").to_pylist(), part.column("n")[0].as_py()
        up = _levels(part.column("digest").to_pylist(), n <= size, fanout, levels)
        rest = over.column("proof")[0].as_py()
        proofs = []
        for k in range(len(at)):
            steps, place = [], k
            for level in up[:-1]:
                first = place - place % fanout
                steps.append({"left": "".join(level[first:place]), "right": "".join(level[place + 1 : first + fanout])})
                place //= fanout
            proofs.append(steps + rest)
        step = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table([part.column("grp"), part.column("idx"), part.column("digest"), *(part.column(c) for c in names), pa.array(proofs, step)], ["grp", "idx", "digest", *names, "proof"])

    mine = nodes.withColumn("block", F.expr(f"idx div {size}")).groupBy("grp", "block")
    theirs = above.select("grp", F.col("idx").alias("block"), "proof").groupBy("grp", "block")
    return mine.cogroup(theirs).applyInArrow(down, f"grp string, idx long, digest string, {carry + ', ' if carry else ''}proof {PROOF}")


def _tree(nodes: DataFrame, fanout: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The tables of all passes but the last one, and that: one node (grp, idx 0, digest, n 1) for each group."""
    most = nodes.agg(F.max("n")).first()[0] or 1
    tables = []
    while True:
        tables.append(nodes)
        nodes = written(_climb(nodes, fanout, levels))
        most = -(-most // fanout**levels)
        if most <= 1:
            return tables, nodes


def _before(counts: DataFrame, parent: int) -> DataFrame:
    """counts (grp, path, n) with `at`: the rows of the group under the same parent prefix and before the path."""
    w = Window.partitionBy("grp", F.substring("path", 1, parent)).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("at", F.coalesce(F.sum("n").over(w), F.lit(0)))


def radix_ranks(rows: DataFrame, key: str, tie: str, weight: str) -> DataFrame:
    """rows with `idx`, the place of each in its grp by key (null first), then by tie, and `n`, how many the group has.

    key: a column of whole numbers; tie: one of hexadecimal digests; weight: of how many equal rows a row stands. rows should be a written
    table. A bucket of the last histogram holds 16 ** DIGITS keys at most; where many rows share a key, digits of the tie split
    them further, so no group of rows grows with the table.
    """
    whole = F.lpad(F.hex(F.col(key).cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    path = F.concat(F.when(F.col(key).isNull(), F.lit("0")).otherwise(F.lit("1")), F.coalesce(whole, F.lit("0" * 16)), F.col(tie))
    rows = rows.withColumn("path", path)
    ends = rows.where(F.col(key).isNotNull()).agg(F.min("path").alias("a"), F.max("path").alias("b")).first()
    a, b = ((ends["a"] or "")[:17], (ends["b"] or "")[:17])
    same = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    lengths = [k for k in range(17 - DIGITS, 1, -DIGITS) if k > same or k > 17 - 2 * DIGITS]
    bucket = lengths[0]
    counts = rows.groupBy("grp", F.substring("path", 1, bucket).alias("path")).agg(F.sum(weight).alias("n"), F.count(F.lit(1)).alias("rows"))
    most = counts.agg(F.max("rows")).first()[0] or 0
    if most > 16**DIGITS:
        # Only ties make a bucket so large: digits of their digests, which are even, part them.
        while most > 16**DIGITS:
            bucket, most = bucket + DIGITS, -(-most // 16**DIGITS) if bucket + DIGITS > 17 else most
            lengths.insert(0, bucket)
        counts = rows.groupBy("grp", F.substring("path", 1, bucket).alias("path")).agg(F.sum(weight).alias("n"))
    levels = [counts.select("grp", "path", "n")]
    lengths.append(1)
    for length in lengths[1:]:
        levels.append(levels[-1].groupBy("grp", F.substring("path", 1, length).alias("path")).agg(F.sum("n").alias("n")))
    total = levels[-1].groupBy("grp").agg(F.sum("n").alias("total"))
    at = _before(levels[-1], 0).join(total, "grp").select("grp", "path", "at", "total")
    for level, parent in reversed(list(zip(levels[:-1], lengths[1:], strict=True))):
        upper = at.select("grp", F.col("path").alias("up"), F.col("at").alias("base"), "total")
        own = _before(level, parent).withColumn("up", F.substring("path", 1, parent))
        at = own.join(upper, ["grp", "up"]).select("grp", "path", (F.col("at") + F.col("base")).alias("at"), "total")
    inside = Window.partitionBy("grp", "bucket").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("bucket", F.substring("path", 1, bucket)).withColumn("within", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    found = placed.join(at.select("grp", F.col("path").alias("bucket"), "at", "total"), ["grp", "bucket"])
    return found.withColumn("idx", F.col("within") + F.col("at")).withColumn("n", F.col("total")).drop("path", "bucket", "within", "at", "total")


def _spread(ranked: DataFrame, most: int) -> DataFrame:
    """A row for each of the equal rows that one stands for, at places one after the other."""
    if most <= 1:
        return ranked
    if most > RUN:
        ranked = ranked.withColumn("run", F.explode(F.expr(f"sequence(0L, (copies - 1) div {RUN})"))).repartition(F.col("leaf"), F.col("run"))
        ranked = ranked.withColumn("idx", F.col("idx") + F.col("run") * RUN).withColumn("copies", F.least(F.lit(RUN), F.col("copies") - F.col("run") * RUN)).drop("run")
    return ranked.withColumn("idx", F.explode(F.expr("sequence(idx, idx + copies - 1)")))


def _ordered(tops: DataFrame) -> DataFrame:
    """(grp, idx, digest, n): one group of all rows of tops (digest, name), in the order of name, null first.

    The rows, one for each group of documents, are dealt by ranges of name; the driver sees how many each range has.
    """
    parts = written(tops.repartitionByRange(F.col("name").asc_nulls_first()).withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["n"]) for r in parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect())
    total, before = 0, [F.lit(-1), F.lit(0)]
    for part, n in sizes:
        before += [F.lit(part), F.lit(total)]
        total += n
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("name").asc_nulls_first())) - 1
    return parts.select(F.lit("").alias("grp"), (place + F.element_at(F.create_map(*before), F.col("part"))).cast("long").alias("idx"), "digest", F.lit(total).cast("long").alias("n"), F.col("name"))


def manifest(docs: DataFrame, fields: tuple[str, ...], group: str = "source", key: str = "doc_id", carry: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """key, group, leaf, rank, group_rows, subroot, root and proof of every row of docs, and the columns of carry.

    leaf: the digest of the fields. In each group leaves ascend by key, null first, rows of equal key by leaf; equal rows are as
    many leaves. proof: for each level up to the root, the siblings left and right of the node. carry: texts that follow from the fields. Null
    keys and groups are values of their own; empty and very long texts are in order; an empty table gives an empty one. Columns of docs
    that are not named are not read.
    """
    carry = carry or {}
    own = {"leaf": leaf(*(named(c) for c in fields)), "grp": field(named(group)), "name": named(group).cast("string"), "id": named(key).cast("long")}
    slim = docs.select(*(c.alias(k) for k, c in own.items()), *(c.cast("string").alias(f"carry_{k}") for k, c in carry.items()))
    rows = written(slim.groupBy(*slim.columns).agg(F.count(F.lit(1)).alias("copies")))
    most = rows.agg(F.max("copies")).first()[0] or 0
    spread = _spread(radix_ranks(rows, "id", "leaf", "copies"), most)
    kept = ["id", "name", *(f"carry_{k}" for k in carry)]
    nodes = written(spread.select("grp", "idx", F.col("leaf").alias("digest"), "n", *kept))
    tables, subroots = _tree(nodes, fanout, levels)
    names = rows.groupBy("grp").agg(F.first("name").alias("name"))
    groups = written(_ordered(subroots.join(names, "grp").select("digest", "name")))
    over, root = _tree(groups, fanout, levels)
    above = root.select("grp", "idx", F.array().cast(PROOF).alias("proof"))
    for k in range(len(over) - 1, 0, -1):
        above = _descend(over[k], above, "", fanout, levels)
    tops = written(_descend(over[0], above, "name string", fanout, levels))
    above = tops.select(field(F.col("name")).alias("grp"), F.lit(0).cast("long").alias("idx"), "proof")
    for k in range(len(tables) - 1, 0, -1):
        above = _descend(tables[k], above, "", fanout, levels)
    schema = ", ".join(["n long", "id long", *(f"{c} string" for c in kept[1:])])
    proved = _descend(tables[0], above, schema, fanout, levels)
    ends = tops.select(field(F.col("name")).alias("grp"), F.col("digest").alias("subroot"), folded(F.col("digest"), F.col("proof")).alias("root"))
    return proved.join(ends, "grp").select(
        F.col("id").alias(key), F.col("name").alias(group), F.col("digest").alias("leaf"), F.col("idx").alias("rank"), F.col("n").alias("group_rows"), "subroot", "root", "proof", *(F.col(f"carry_{k}").alias(k) for k in carry)
    )


def changed(old: DataFrame, new: DataFrame, group: str = "source", key: str = "doc_id") -> DataFrame:
    """(group, key, leaf, change) of the leaves that only one of two manifests has: added or removed, each as often as it is one too many.

    Groups whose subroots agree are left out first, so only rows of groups that changed are compared.
    """
    ends = lambda m, c: m.groupBy(named(group).alias("g")).agg(F.first("subroot").alias(c))
    both = ends(old, "a").join(ends(new, "b").withColumnRenamed("g", "h"), F.col("g").eqNullSafe(F.col("h")), "full")
    touched = both.where(~F.col("a").eqNullSafe(F.col("b"))).select(F.coalesce("g", "h").alias("touched"))

    def rows(m: DataFrame, sign: int) -> DataFrame:
        of = m.select(named(group).alias("g"), named(key).alias("k"), "leaf", F.lit(sign).alias("sign"))
        return of.join(touched, F.col("g").eqNullSafe(F.col("touched")), "left_semi")

    left = rows(old, -1).unionByName(rows(new, 1)).groupBy("g", "k", "leaf").agg(F.sum("sign").alias("more")).where("more <> 0")
    each = left.select("*", F.explode(F.expr("sequence(1L, abs(more))")).alias("one"))
    return each.select(F.col("g").alias(group), F.col("k").alias(key), "leaf", F.when(F.col("more") > 0, "added").otherwise("removed").alias("change"))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    """The manifest of documents; rows whose id has an even CRC are folded again from a text without its line ends."""
    docs = table(spark, sf_dir, "documents")
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    tampered = leaf(*(F.col(c) for c in FIELDS[:-1]), cut)
    made = manifest(docs, FIELDS, carry={"tampered": tampered})
    again = made.withColumn("folded_root", folded(F.col("tampered"), F.col("proof")))
    return again.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql_field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


#: CRC-32 bit by bit, then the tree level by level in recursion.
OP13_SQL = f"""
WITH RECURSIVE ids AS (SELECT DISTINCT doc_id FROM documents),
crc AS (
  SELECT doc_id, CAST(4294967295 AS BIGINT) AS c, CAST(doc_id AS VARCHAR) AS rest, 0 AS bits FROM ids
  UNION ALL
  SELECT doc_id,
    CASE WHEN bits = 0 THEN xor(c, CAST(ascii(rest) AS BIGINT)) WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END,
    CASE WHEN bits = 0 THEN substr(rest, 2) ELSE rest END, (bits + 1) % 9
  FROM crc WHERE bits > 0 OR rest <> ''
), even AS (SELECT doc_id, xor(c, CAST(4294967295 AS BIGINT)) % 2 = 0 AS cut FROM crc WHERE rest = '' AND bits = 0),
named AS (SELECT doc_id, source, text, concat({_sql_field('doc_id')}, {_sql_field('source')}, {_sql_field('lang')}, {_sql_field('n_chars')}) AS head FROM documents),
leaves AS (
  SELECT n.doc_id, n.source, sha256(head || {_sql_field('text')}) AS leaf, sha256(head || {_sql_field('less')}) AS tampered
  FROM (SELECT n.*, CASE WHEN cut THEN replace(text, chr(10), '') ELSE text END AS less FROM named n LEFT JOIN even USING (doc_id)) n
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS src FROM leaves
), up AS (
  SELECT 0 AS level, src, place AS idx, leaf AS digest, n FROM placed
  UNION ALL
  SELECT any_value(level) + 1, src, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 2) // 3) FROM up WHERE n > 1 GROUP BY src, idx // 3
), roots AS (
  SELECT 0 AS level, src AS idx, digest AS digest, (SELECT count(DISTINCT src) FROM placed) AS n FROM up WHERE n = 1
  UNION ALL
  SELECT any_value(level) + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), any_value((n + 2) // 3) FROM roots WHERE n > 1 GROUP BY idx // 3
), walk AS (
  SELECT src, place, 0 AS level, false AS high, place AS idx, n, src AS over, tampered AS node, '' AS proof FROM placed
  UNION ALL
  SELECT w.src, w.place, CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END, w.high OR w.n = 1, CASE WHEN w.n > 1 THEN w.idx // 3 ELSE w.over END,
    CASE WHEN w.n > 1 THEN (w.n + 2) // 3 ELSE (SELECT count(DISTINCT src) FROM placed) END, w.over,
    CASE WHEN w.n > 1 THEN sha256(coalesce(l, '') || w.node || coalesce(r, '')) ELSE w.node END, w.proof || CASE WHEN w.n > 1 THEN coalesce(l, '') || coalesce(r, '') ELSE '' END
  FROM walk w LEFT JOIN (
    SELECT a.src, a.level, a.high, a.idx, string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx) AS l, string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx) AS r
    FROM (SELECT src, level, false AS high, idx, digest FROM up UNION ALL SELECT -1, level, true, idx, digest FROM roots) a
    JOIN (SELECT src, level, false AS high, idx, digest FROM up UNION ALL SELECT -1, level, true, idx, digest FROM roots) b
      ON a.src = b.src AND a.level = b.level AND a.high = b.high AND a.idx // 3 = b.idx // 3 GROUP BY ALL
  ) s ON s.src = CASE WHEN w.high THEN -1 ELSE w.src END AND s.level = w.level AND s.high = w.high AND s.idx = w.idx
  WHERE NOT (w.high AND w.n = 1)
)
SELECT p.doc_id, p.leaf, u.digest AS subroot, t.digest AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = t.digest AS verified
FROM placed p JOIN walk w ON w.src = p.src AND w.place = p.place AND w.high AND w.n = 1 JOIN up u ON u.src = p.src AND u.n = 1, (SELECT digest FROM roots WHERE n = 1) t
"""
