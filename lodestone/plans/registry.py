"""Where queries are registered with the SQL that says what they return."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query that takes (spark, folder); sql: DuckDB SQL with the same rows over the same tables."""

    def keep(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Fixture:
    """A few rows that no table has, as a DataFrame and as SQL, from one statement of them."""

    def __init__(self, schema: str, rows: list[tuple]):
        self.schema, self.rows = schema, rows
        fields = re.findall(r"(\w+) (\w+(?:<\w+>)?)(?:, |$)", schema)
        kinds = {"string": "VARCHAR", "int": "INT", "long": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "date": "DATE", "array<string>": "VARCHAR[]", "array<int>": "INT[]", "array<double>": "DOUBLE[]"}

        def of(v) -> str:
            if v is None:
                return "NULL"
            if isinstance(v, bool):
                return str(v).lower()
            if isinstance(v, list):
                return f"[{', '.join(map(of, v))}]"
            return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

        names = [n for n, _ in fields]
        cast = ", ".join(f"CAST({n} AS {kinds[k]}) AS {n}" for n, k in fields)
        self.sql = f"(SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(of, r)) + ')' for r in rows)}) v({', '.join(names)}))"

    def df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)


class Derived:
    """Rows that follow from the given tables, by one SELECT that Spark and DuckDB both read. ARRAY(…) stands for an array, and no braces."""

    def __init__(self, select: str):
        self.select, self.sql = select, f"({select.replace('ARRAY(', 'list_value(')})"

    def df(self, spark: SparkSession, d: str) -> DataFrame:
        names = set(re.findall(r"(?:FROM|JOIN) (\w+)", self.select))
        return spark.sql(re.sub(r"(FROM|JOIN) (\w+)", r"\1 {\2}", self.select), **{n: table(spark, d, n) for n in names})


# Pieces of SQL that several queries share.
CJK = r"\x{4e00}-\x{9fff}"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9_]+|[{CJK}]')"


def grams(x: str, n: int = 2) -> str:
    return f"list_transform(range(1, length({x}) - {n - 2}), lambda i: substr({x}, i, {n}))"


def form(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_]+', '', 'g')"


def collapsed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def gram_recall(a: str, b: str) -> str:
    own, other = f"list_distinct({grams(form(a))})", grams(form(b))
    return f"CASE WHEN len({own}) = 0 THEN 0.0 ELSE len(list_intersect({own}, {other})) / len({own}) END"


def keyword(q: str, t: str) -> str:
    own = rf"list_filter(regexp_split_to_array(lower({q}), '[\s,.;:!?()\[\]{{}}\"''，。；：！？（）、“”]+'), lambda t: length(t) >= 2)"
    return f"CASE WHEN len({own}) = 0 THEN 0.0 ELSE least(1.0, len(list_filter({own}, lambda t: contains(lower({t}), t))) / len({own})) END"


def bm25(docs: str = "SELECT doc_id, text FROM documents", queries: str = "SELECT item_id AS query_id, text AS query FROM benchmark", name: str = "bm25", boost: bool = True, least: float = 0.0, tok=tokens) -> str:
    """CTEs that end in `name` (query_id, doc_id, score)."""
    p = name
    part = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, " + str(least) + ")))" + (" * (1 + ln(qtf))" if boost else "")
    return f"""{p}_qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tok('query')}) AS term FROM ({queries})) GROUP BY ALL),
{p}_d AS (SELECT doc_id, {tok('text')} AS toks FROM ({docs})),
{p}_st AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM {p}_d),
{p}_tf AS (SELECT doc_id, len(any_value(toks)) AS dl, term, count(*) AS tf FROM (SELECT doc_id, toks, unnest(toks) AS term FROM {p}_d) WHERE term IN (SELECT term FROM {p}_qt) GROUP BY doc_id, term),
{p}_df AS (SELECT term, count(*) AS df FROM {p}_tf GROUP BY ALL),
{p} AS (SELECT * FROM (SELECT query_id, doc_id, round(sum({part}), 6) AS score FROM {p}_tf JOIN {p}_qt USING (term) JOIN {p}_df USING (term), {p}_st GROUP BY ALL) WHERE score > 0)"""


def top(run: str, k: int, keys: str = "query_id", tie: str = "doc_id") -> str:
    return f"SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY score DESC, {tie}) AS INT) AS rank FROM {run} QUALIFY rank <= {k}"


COSINE = f"""tc_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
tc_d AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({tokens('text')}) AS term FROM documents) GROUP BY ALL),
tc AS (SELECT query_id, doc_id, round(dot / sqrt(dd * qq), 6) AS score FROM (SELECT query_id, doc_id, CAST(sum(tf * qtf) AS DOUBLE) AS dot FROM tc_d JOIN tc_q USING (term) GROUP BY ALL)
  JOIN (SELECT doc_id, CAST(sum(tf * tf) AS DOUBLE) AS dd FROM tc_d GROUP BY ALL) USING (doc_id) JOIN (SELECT query_id, CAST(sum(qtf * qtf) AS DOUBLE) AS qq FROM tc_q GROUP BY ALL) USING (query_id))"""
