"""Chunkers by kind of document, over arrays of blocks: what goes together is decided by one greedy rule on token counts.

Texts stay in the JVM; Python sees token counts alone, in Arrow batches, and returns the group of each unit. Documents are never shuffled.
All take rows with doc_id and an array of texts and return rows in the order of `ordinal`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lodestone.functions import text as T

# How questions, answers, clauses, steps, warnings and conditions begin, and what kinds of documents speak of.
NUMERAL = "0-9一二三四五六七八九十"
QUESTION, ANSWER = r"^\s*(?:Q\s*[:：]|问题\s*[:：]|问\s*[:：])", r"^\s*(?:A\s*[:：]|回答\s*[:：]|答\s*[:：])\s*"
CLAUSE = rf"^\s*第\s*[{NUMERAL}百千]+\s*条"
STEP = rf"(?i)^\s*(?:步骤\s*[{NUMERAL}]+|Step\s*\d+|第\s*[{NUMERAL}]+\s*步)"
WARNING, CONDITION = r"(?i)^\s*(?:警告|注意|重要|提示|Warning|Caution)", r"(?i)^\s*(?:前置条件|前提|先决条件|Precondition)"
FAQ_Q, FAQ_A = r"(?i)(?:Q\s*[:：]|问题\s*[:：]|问\s*[:：])", r"(?i)(?:A\s*[:：]|回答\s*[:：]|答\s*[:：])"
ANY_CLAUSE, POLICY_WORDS = rf"第\s*[{NUMERAL}百千]+\s*条", "(办法|规定|条例|制度|细则|条款|规范|准则)"
STEP_LINE = rf"(?i)^\s*(?:步骤\s*[{NUMERAL}]+|第\s*[{NUMERAL}]+\s*步|Step\s*\d+|\d+\.\s)"
CONDITION_WORDS, WARNING_WORDS = "(前置条件|前提|先决条件|Precondition)", "(?i)(警告|注意|提示|告警|Warning|Caution)"
UNNUMBERED = "(未编号)"
#: Target and most tokens of a chunk, and tokens of the one before that it repeats.
SIZES = {"narrative": (450, 700, 60), "faq": (220, 400, 0), "policy": (300, 550, 0), "procedure": (340, 450, 0), "table": (300, 450, 0), "fallback": (420, 650, 50)}


@F.pandas_udf(ArrayType(IntegerType()))
def _grouped(tokens: pd.Series, limit: pd.Series, first: pd.Series, later: pd.Series, alone: pd.Series, breaks: pd.Series) -> pd.Series:
    def one(ts, limit: int, first: int, later: int, alone: int, breaks) -> list[int] | None:
        if ts is None:
            return None
        out, group, held, empty, solo = [], 0, first, True, False
        for k, t in enumerate(ts):
            own = t > alone
            if not empty and (own or solo or held + t > limit and (breaks is None or breaks[k])):
                group, held = group + 1, later
            held, empty, solo = held + t, False, own
            out.append(group)
        return out

    return pd.Series([one(*x) for x in zip(tokens, limit, first, later, alone, breaks)])


def greedy(units: Column, limit: Column | int, first: Column | int = 0, later: Column | int = 0, alone: Column | int = 1 << 30, breaks: Column | None = None) -> Column:
    """The group of each unit: a new one where the tokens so far and the unit's exceed `limit` (at units with `breaks` alone, if given).

    A group starts from `first` or, after the first one, `later` tokens; a unit of over `alone` tokens is a group of its own.
    """
    tokens = F.transform(units, lambda u: T.approx_tokens(u).cast("int"))
    whole = [F.lit(x).cast("int") if isinstance(x, int) else x.cast("int") for x in (limit, first, later, alone)]
    return _grouped(tokens, *whole, F.lit(None).cast("array<boolean>") if breaks is None else breaks)


def pieces(df: DataFrame, units: str, groups: Column, keep: list[str], at: str = "at", out: str = "units") -> DataFrame:
    """keep, `at` and `out`: one row for each group of a row's units, in order. No units: no rows."""
    marked = df.withColumn("_g", groups)
    last = F.array_max("_g")
    dealt = F.transform(F.sequence(F.lit(0), last), lambda g: F.transform(F.filter(F.arrays_zip(F.col(units).alias("u"), F.col("_g").alias("g")), lambda x: x["g"] == g), lambda x: x["u"]))
    return marked.where(last.isNotNull()).select(*keep, F.posexplode(dealt).alias(at, out))


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def _windows(tokens: pd.Series, target: pd.Series, overlap: pd.Series) -> pd.Series:
    def one(ts, target: int, overlap: int) -> list[list[int]]:
        out, lo, held = [], 0, 0
        for k, t in enumerate(ts):
            if k > lo and held + t > target:
                out.append([lo, k])
                lo, held = k - 1, ts[k - 1]
                while lo > out[-1][0] and held + ts[lo - 1] <= overlap:
                    lo -= 1
                    held += ts[lo]
            held += t
        return [*out, [lo, len(ts)]] if len(ts) else out

    return pd.Series([one(*x) for x in zip(tokens, target, overlap)])


@F.pandas_udf(ArrayType(ArrayType(IntegerType())))
def _cuts(cjk: pd.Series, length: pd.Series, most: pd.Series) -> pd.Series:
    """Where each text of over `most` tokens is cut: the places of its Chinese characters say what its beginnings cost."""
    import numpy as np

    def one(places, n: int, most: int) -> list[int]:
        cost = np.full(n, 0.25)
        cost[np.array(places, np.int64)] = 1.3
        total = np.concatenate(([0.0], np.cumsum(cost)))
        out = [0]
        while out[-1] < n:
            # the first place at which floor(cost + 0.999) reaches `most`
            out.append(int(min(n, np.searchsorted(total, total[out[-1]] + most - 0.999 - 1e-9, "left"))))
        return out

    return pd.Series([[one(p, k, m) for p, k in zip(ps, ns)] for ps, ns, m in zip(cjk, length, most)])


def cut(df: DataFrame, texts: str, most: int, out: str) -> DataFrame:
    """df with `out`: each text of an array cut into parts that just reach `most` tokens, all in one array; short texts stay."""
    chars = F.transform(texts, lambda t: F.filter(F.transform(F.split(t, ""), lambda c, i: F.when(c.rlike(f"[{T.CJK}]"), i)), lambda i: i.isNotNull()))
    # One element exploded: Catalyst would else fold the call into the lambdas below, where it cannot be run.
    ends = df.select("*", F.explode(F.array(_cuts(chars, F.transform(texts, F.length), F.lit(most)))).alias("_cuts"))
    parts = F.zip_with(texts, "_cuts", lambda t, e: F.transform(F.slice(e, F.lit(1), F.size(e) - 1), lambda a, i: F.substring(t, a + 1, F.get(e, i + 1) - a)))
    return ends.withColumn(out, F.flatten(parts)).drop("_cuts")


def tail(text: Column, tokens: int) -> Column:
    """The end of a text that just reaches `tokens`, a quarter a character and 1 for those above U+2E80; leading white space goes."""
    last = F.reverse(F.split(F.substring(text, F.greatest(F.length(text) - (4 * tokens - 1), F.lit(1)), F.lit(4 * tokens)), ""))
    step = lambda a, c: F.when((a["s"] >= tokens) | (c == ""), a).otherwise(F.struct((a["s"] + F.when(c.rlike(r"[\x{2e81}-\x{10ffff}]"), 1.0).otherwise(0.25)).alias("s"), (a["n"] + 1).alias("n")))
    n = F.aggregate(last, F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), step, lambda a: a["n"])
    return F.regexp_replace(F.substring(text, F.length(text) - n + 1, n), r"^\s+", "")


def _paths(blocks: Column) -> Column:
    """Blocks under each heading of the first level ("# "), which is the first of its group."""
    def step(acc: Column, b: Column) -> Column:
        title = F.regexp_replace(b, r"^#+\s*", "")
        new = b.startswith("# ") | (F.size(acc) == 0)
        group = F.struct(F.when(b.startswith("# "), title).otherwise("").alias("path"), F.array(title).alias("lines"))
        last = F.element_at(acc, -1)
        more = F.struct(last["path"].alias("path"), F.concat(last["lines"], F.array(title)).alias("lines"))
        return F.when(new, F.concat(acc, F.array(group))).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(more)))

    return F.aggregate(blocks, F.from_json(F.lit("[]"), "array<struct<path:string,lines:array<string>>>"), step)


def narrative(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, section, content): paragraphs packed to the target under each first-level heading, long ones by sentence or cut,
    each packed chunk after the first beginning with the end of the one before it."""
    target, most, overlap = SIZES["narrative"]
    sections = docs.select("doc_id", F.posexplode(_paths(F.col("blocks"))).alias("s", "x")).select("doc_id", "s", F.col("x.path").alias("section"), T.paragraphs(F.array_join("x.lines", "\n\n")).alias("paragraphs"))
    packed = pieces(sections, "paragraphs", greedy(F.col("paragraphs"), target, alone=most), ["doc_id", "s", "section"], "g")
    long = (F.size("units") == 1) & (T.approx_tokens(F.get("units", F.lit(0))) > most)
    sentences = F.when(long, T.sentences(F.get("units", F.lit(0)))).otherwise(F.array().cast("array<string>"))
    split = packed.withColumn("long", long).withColumn("sentences", sentences).withColumn("groups", greedy(F.col("sentences"), most, alone=most))
    joined = F.transform(F.sequence(F.lit(0), F.array_max("groups")), lambda g: F.array_join(F.transform(F.filter(F.arrays_zip(F.col("sentences").alias("u"), F.col("groups").alias("g")), lambda x: x["g"] == g), lambda x: x["u"]), ""))
    split = cut(split.withColumn("texts", F.when(F.col("long"), joined).otherwise(F.array().cast("array<string>"))), "texts", most, "cut")
    split = split.withColumn("parts", F.when(F.col("long"), F.col("cut")).otherwise(F.array(F.array_join("units", "\n\n"))))
    # A document's groups meet again in its own row: they come from it, and go by its id.
    whole = split.groupBy("doc_id", "s", "section").agg(F.array_sort(F.collect_list(F.struct("g", "long", "parts"))).alias("all"))

    def step(acc: Column, x: Column) -> Column:
        front = tail(F.element_at(acc, -1), overlap)
        body = F.get(x["parts"], F.lit(0))
        return F.concat(acc, F.when(x["long"], x["parts"]).otherwise(F.array(F.when((F.size(acc) > 0) & (front != ""), F.concat(front, F.lit("\n\n"), body)).otherwise(body))))

    chunks = F.aggregate("all", F.array().cast("array<string>"), step)
    return whole.select("doc_id", "s", "section", F.posexplode(chunks).alias("ordinal", "content"))


def faq(docs: DataFrame) -> DataFrame:
    """(doc_id, pair, part, quality, content, embedding_text): questions with their answers; a long answer in parts that all repeat the question for the embedding."""
    _, most, _ = SIZES["faq"]

    def step(acc: Column, b: Column) -> Column:
        answer = F.when(b.rlike(ANSWER), F.trim(F.regexp_replace(b, ANSWER, "")))
        last = F.element_at(acc, -1)
        open_ = (F.size(acc) > 0) & (last["q"] != "")
        new = F.struct(F.when(b.rlike(QUESTION + ".+"), F.trim(F.regexp_replace(b, QUESTION, ""))).otherwise("").alias("q"), F.when(answer.isNotNull(), F.array(answer)).otherwise(F.array().cast("array<string>")).alias("a"))
        more = F.struct(last["q"].alias("q"), F.concat(last["a"], F.array(F.coalesce(answer, b))).alias("a"))
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(more))
        return F.when(b == "", acc).when(b.rlike(QUESTION + ".+") & answer.isNull(), F.concat(acc, F.array(new))).when(open_, grown).when(answer.isNotNull(), F.concat(acc, F.array(new))).otherwise(acc)

    none = F.from_json(F.lit("[]"), "array<struct<q:string,a:array<string>>>")
    pairs = docs.select("doc_id", F.posexplode(F.aggregate(T.trimmed(F.col("blocks")), none, step)).alias("pair", "x"))
    q, a = F.col("x.q"), F.array_join("x.a", "\n")
    body = F.when(q != "", F.concat(F.lit("Q: "), q, F.lit("\nA: "), a)).otherwise(a)
    rows = pairs.select("doc_id", "pair", q.alias("q"), F.when((q != "") & (F.size("x.a") > 0), "ok").otherwise("low_quality").alias("quality"), a.alias("a"), body.alias("body")).withColumn("long", (T.approx_tokens(F.col("body")) > most) & (F.col("a") != ""))
    units = F.when(F.col("long"), T.sentences(F.when(F.col("q") == "", F.concat(F.lit("（缺问题）\n"), F.col("a"))).otherwise(F.col("a")))).otherwise(F.array("body"))
    cost = F.when(F.col("q") == "", 0).otherwise(T.approx_tokens(F.col("q")))
    parts = pieces(rows.withColumn("units0", units).withColumn("cost", cost), "units0", greedy(F.col("units0"), F.when(F.col("long"), most).otherwise(1 << 30), F.col("cost"), F.col("cost")), ["doc_id", "pair", "quality", "q", "long"], "part")
    content = F.array_join("units", "")
    return parts.select("doc_id", "pair", "part", "quality", content.alias("content"), F.when(F.col("long") & (F.col("q") != ""), F.concat(F.lit("Q: "), F.col("q"), F.lit("\n"), content)).otherwise(content).alias("embedding_text"))


def policy(docs: DataFrame) -> DataFrame:
    """(doc_id, clause, heading, part, content): clauses with their items; larger ones in parts that repeat the heading, very long items by sentence."""
    target, most, _ = SIZES["policy"]

    def step(acc: Column, b: Column) -> Column:
        last = F.element_at(acc, -1)
        none = F.array().cast("array<string>")
        new = F.when(b.rlike(CLAUSE), F.struct(b.alias("h"), none.alias("items"))).otherwise(F.struct(F.lit(UNNUMBERED).alias("h"), F.array(b).alias("items")))
        more = F.struct(last["h"].alias("h"), F.concat(last["items"], F.array(b)).alias("items"))
        return F.when(b == "", acc).when(b.rlike(CLAUSE) | (F.size(acc) == 0), F.concat(acc, F.array(new))).otherwise(F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(more)))

    none = F.from_json(F.lit("[]"), "array<struct<h:string,items:array<string>>>")
    clauses = docs.select("doc_id", F.posexplode(F.aggregate(T.trimmed(F.col("blocks")), none, step)).alias("clause", "x")).select("doc_id", "clause", F.col("x.h").alias("heading"), F.col("x.items").alias("items"))
    head = T.approx_tokens(F.col("heading"))
    small = (T.approx_tokens(F.concat_ws("\n", F.col("heading"), F.array_join("items", "\n"))) < target) | (F.size("items") == 0)
    whole = clauses.where(small).select("doc_id", "clause", "heading", F.lit(0).alias("part"), F.lit(0).alias("sub"), F.when(F.size("items") > 0, F.concat_ws("\n", "heading", F.array_join("items", "\n"))).otherwise(F.col("heading")).alias("content"))
    parts = pieces(clauses.where(~small), "items", greedy(F.col("items"), target, alone=F.lit(most) - head), ["doc_id", "clause", "heading"], "part")
    long = (F.size("units") == 1) & (T.approx_tokens(F.get("units", F.lit(0))) + head > most)
    units = F.when(long, T.sentences(F.get("units", F.lit(0)))).otherwise(F.array(F.array_join("units", "\n")))
    subs = pieces(parts.withColumn("units0", units).withColumn("long", long).withColumn("cost", head), "units0", greedy(F.col("units0"), F.when(F.col("long"), most).otherwise(1 << 30), F.col("cost"), F.col("cost")), ["doc_id", "clause", "heading", "part"], "sub")
    return whole.unionByName(subs.select("doc_id", "clause", "heading", "part", "sub", F.concat_ws("\n", "heading", F.array_join("units", "\n")).alias("content")))


def procedure(docs: DataFrame) -> DataFrame:
    """(doc_id, part, sub, line, has_warning, content): steps packed to the target, never parted from a warning before them; what is still too large is cut between units, a long unit between lines."""
    target, most, _ = SIZES["procedure"]
    rows = docs.select("doc_id", F.filter(T.trimmed(F.col("blocks")), lambda b: b != "").alias("b"))
    steps = F.transform("b", lambda b: ~b.rlike(WARNING) & b.rlike(STEP))
    first = pieces(rows, "b", greedy(F.col("b"), target, breaks=steps), ["doc_id"], "part")
    total = F.aggregate(F.transform("units", lambda u: T.approx_tokens(u)), F.lit(0).cast("long"), lambda a, t: a + t)
    second = pieces(first.withColumn("units0", F.col("units")).withColumn("total", total), "units0", greedy(F.col("units0"), F.when(F.col("total") <= most, 1 << 30).otherwise(most), alone=F.when(F.col("total") <= most, 1 << 30).otherwise(most)), ["doc_id", "part", "total"], "sub")
    long = (F.col("total") > most) & (F.size("units") == 1) & (T.approx_tokens(F.get("units", F.lit(0))) > most)
    lines = F.when(long, F.filter(F.split(F.get("units", F.lit(0)), r"(?<=\n)"), lambda x: x != "")).otherwise(F.array(F.array_join("units", "\n")))
    warned = F.exists("units", lambda u: u.rlike(WARNING))
    third = second.withColumns({"lines": lines, "long": long, "has_warning": warned})
    parts = pieces(third, "lines", greedy(F.col("lines"), F.when(F.col("long"), most).otherwise(1 << 30)), ["doc_id", "part", "sub", "has_warning"], "line", "l")
    return parts.select("doc_id", "part", "sub", "line", "has_warning", F.array_join("l", "").alias("content")).where("trim(content) <> ''")


def tables(docs: DataFrame) -> DataFrame:
    """(doc_id, table_no, part, row_start, row_end, content): rows of each table block packed to the target under its repeated header; a table of a header alone is its own summary."""
    target, _, _ = SIZES["table"]
    own = F.filter("blocks", lambda b: b.startswith("|"))
    cells = lambda line: T.trimmed(F.split(line, r"\|"))
    bare = lambda line: F.trim(F.regexp_replace(F.trim(line), r"^\|+|\|+$", ""))
    rows = docs.select("doc_id", F.posexplode(own).alias("table_no", "b")).withColumn("lines", F.filter(F.transform(F.split("b", "\n"), bare), lambda x: x != ""))
    header = F.array_join(cells(F.get("lines", F.lit(0))), " | ")
    body = F.transform(F.slice("lines", F.lit(2), F.greatest(F.size("lines") - 1, F.lit(0))), lambda x: F.array_join(cells(x), " | "))
    rows = rows.withColumns({"header": header, "rows": body})
    alone = rows.where(F.size("rows") == 0).select("doc_id", "table_no", F.lit(0).alias("part"), F.lit(None).cast("int").alias("row_start"), F.lit(None).cast("int").alias("row_end"), F.col("b").alias("content"))
    packed = pieces(rows, "rows", greedy(F.col("rows"), target, later=T.approx_tokens(F.col("header"))), ["doc_id", "table_no", "header", "rows", "_g"], "part")
    start = F.array_position("_g", F.col("part")).cast("int") - 1
    lines = F.transform("units", lambda u: F.replace(u, F.lit(" | "), F.lit(" - ")))
    content = F.concat(F.lit("表头: "), F.col("header"), F.lit("\n"), F.array_join(lines, "\n"))
    return alone.unionByName(packed.select("doc_id", "table_no", "part", start.alias("row_start"), (start + F.size("units") - 1).alias("row_end"), content.alias("content")))


def fallback(docs: DataFrame) -> DataFrame:
    """(doc_id, part, content): a window over sentences that repeats the last ones of the window before."""
    target, _, overlap = SIZES["fallback"]
    rows = docs.select("doc_id", T.sentences(F.array_join(F.filter("blocks", lambda b: b != ""), "\n")).alias("s"))
    rows = rows.withColumn("w", _windows(F.transform("s", lambda x: T.approx_tokens(x).cast("int")), F.lit(target), F.lit(overlap)))
    return rows.select("doc_id", "s", F.posexplode("w").alias("part", "x")).select("doc_id", "part", F.array_join(F.slice("s", F.get("x", F.lit(0)) + 1, F.get("x", F.lit(1)) - F.get("x", F.lit(0))), "").alias("content"))


def profile(blocks: Column) -> Column:
    """The kind of a document by rules in order: much table, questions with answers, clauses, steps; else narrative."""

    def kind(b: Column) -> Column:
        texts = F.filter(b, lambda x: x != "")
        joined = F.array_join(texts, "\n")
        share = F.size(F.filter(b, lambda x: x.startswith("|"))) / F.greatest(F.size(texts), F.lit(1))
        q, a = F.regexp_count(joined, F.lit(FAQ_Q)), F.regexp_count(joined, F.lit(FAQ_A))
        clauses, steps = F.regexp_count(joined, F.lit(ANY_CLAUSE)), F.size(F.filter(F.split(joined, "\n"), lambda x: x.rlike(STEP_LINE)))
        return (
            F.when(share >= 0.3, "table_records").when((q >= 1) & (a >= 1) & (joined.contains("FAQ") | joined.contains("常见问题") | (q >= 2)), "faq").when((clauses >= 3) & joined.rlike(POLICY_WORDS), "policy")
            .when((steps >= 3) & (joined.rlike(CONDITION_WORDS) | joined.rlike(WARNING_WORDS)), "procedure").when(clauses >= 2, "policy").when(steps >= 3, "procedure").otherwise("narrative")
        )

    return T.once(blocks, kind)
