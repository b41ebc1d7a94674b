"""Secret scans: fixed patterns, and a battery of randomness tests with false-discovery control by length.

Long tokens outside the fixed patterns' matches are given the encoding that their characters allow. Three tests ask whether
their symbols look random in it: chi-squared uniformity over the alphabet, runs about its middle, and serial
correlation. The sum of their squared z-values is compared within a class of encoding and length, where tokens without
digits stand for what ordinary text scores: the threshold of a class is the loosest at which the estimated
share of ordinary tokens among those found stays under `fdr`. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrow import stored, table
from lodestone.llm.spans import located

# Fixed patterns and least lengths.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = {"assign": (ASSIGN, 12), "access": (ACCESS, 18), "hex": (HEX, 16)}
#: A token for the tests, the largest sum of squares that is taken as random (1 % of random tokens exceed it), the false-discovery rate.
TOKEN, RANDOM_MOST, FDR = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", 11, 0.05
# Alphabets in the order of their values.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _base(text: Column, kind: str, place: int) -> Column:
    pattern, least = KINDS[kind]
    # A run of one class of characters can be asked for its least length at once: what fails holds no shorter match.
    quick = {"access": r"AKIA[A-Z0-9]{14,}+", "hex": r"[0-9a-f]{16,}+"}.get(kind)
    found = located(text, quick or pattern, 2 if kind == "assign" else None)
    kept = F.filter(found, lambda x: F.length(x["part"]) >= least)
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(place).alias("kind"), x["end"].alias("end")))


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in (*KINDS, "random")))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def battery(token: Column) -> Column:
    """struct<encoding, score> of a token: the sum of squares of the three tests' z-values."""
    encoding = F.when(token.rlike(r"^[0-9a-fA-F]+$"), "hex").when(token.rlike(r"^[A-Z2-7]+=*$"), "base32").otherwise("base64")
    plain = F.when(encoding == "hex", F.lower(token)).otherwise(F.translate(F.regexp_replace(token, "=+$", ""), "-_=", "+//"))
    letters = F.when(encoding == "hex", ALPHABETS["hex"]).when(encoding == "base32", ALPHABETS["base32"]).otherwise(ALPHABETS["base64"])
    first = F.struct(encoding.alias("encoding"), plain.alias("plain"), letters.alias("letters"), F.length(letters).alias("size"), F.length(plain).cast("double").alias("n"))

    def measured(x: Column) -> Column:
        # Characters by one split: a substring at each place would read the token from its start again.
        values = F.transform(F.filter(F.split(x["plain"], ""), lambda c: c != ""), lambda c: (F.instr(x["letters"], c) - 1).cast("double"))
        squares = F.aggregate(F.array_distinct(F.split(x["plain"], "")), F.lit(0.0), lambda s, c: s + F.when(c == "", F.lit(0.0)).otherwise(F.pow(x["n"] - F.length(F.replace(x["plain"], c, F.lit(""))), F.lit(2.0))))
        return F.struct(x["encoding"].alias("encoding"), x["n"].alias("n"), x["size"].cast("double").alias("size"), values.alias("v"), squares.alias("squares"))

    def moments(x: Column) -> Column:
        start = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("s"), F.lit(0.0).alias("ss"), F.lit(0.0).alias("sp"), F.lit(0.0).alias("turns"))

        def step(a: Column, v: Column) -> Column:
            later = a["last"] >= 0
            turn = later & ((a["last"] >= x["size"] / 2) != (v >= x["size"] / 2))
            return F.struct(
                v.alias("last"), (a["s"] + v).alias("s"), (a["ss"] + v * v).alias("ss"),
                (a["sp"] + F.when(later, a["last"] * v).otherwise(0.0)).alias("sp"), (a["turns"] + F.when(turn, 1.0).otherwise(0.0)).alias("turns"),
            )

        return F.struct(x["encoding"].alias("encoding"), x["n"].alias("n"), x["size"].alias("size"), x["squares"].alias("squares"), x["v"][0].alias("v0"), F.aggregate(x["v"], start, step).alias("m"))

    def score(x: Column) -> Column:
        n, k, m = F.greatest(x["n"], F.lit(2.0)), x["size"] - 1, x["m"]
        chi = x["size"] / n * x["squares"] - n
        z1 = F.greatest((F.pow(F.greatest(chi, F.lit(0.0)) / k, F.lit(1 / 3)) - (1 - 2 / (9 * k))) / F.sqrt(2 / (9 * k)), F.lit(0.0))
        z2 = (m["turns"] - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        spread = m["ss"] - m["s"] * m["s"] / n
        mean = m["s"] / n
        # Sum over neighbours of (v - mean)(next - mean).
        along = m["sp"] - mean * (2 * m["s"] - x["v0"] - m["last"]) + (n - 1) * mean * mean
        z3 = F.when(spread > 1e-9, along / spread * F.sqrt(n)).otherwise(F.sqrt(n))
        return F.struct(x["encoding"].alias("encoding"), (z1 * z1 + z2 * z2 + z3 * z3).alias("score"))

    out = F.array(first)
    for f in (measured, moments, score):
        out = F.transform(out, f)
    return out[0]


def _candidates(text: Column, base: Column) -> Column:
    """Tokens outside the base spans, with their class and binned score; decoy: has no digit."""
    free = F.filter(located(text, TOKEN), lambda x: (F.length(F.regexp_replace(x["value"], "[^A-Za-z]", "")) > 0) & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))

    def scored(x: Column) -> Column:
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), (~x["value"].rlike("[0-9]")).alias("decoy"), battery(x["value"]).alias("b"))

    def binned(x: Column) -> Column:
        size = F.least(F.floor(2 * F.log2((x["end"] - x["start"]) / 20.0)).cast("int"), F.lit(9))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["decoy"].alias("decoy"), F.concat_ws(":", x["b"]["encoding"], size.cast("string")).alias("kind"), F.least(F.ceil(x["b"]["score"]).cast("int"), F.lit(RANDOM_MOST + 1)).alias("bin"))

    return F.transform(F.transform(free, scored), binned)


def thresholds(scanned: DataFrame, fdr: float = FDR) -> dict[str, int]:
    """The largest bin of each class that counts as random. A class is an encoding and a length step, so there are 30 at most."""
    rows = scanned.select(F.explode("tokens").alias("x")).groupBy("x.kind", "x.bin").agg(F.count_if("x.decoy").alias("d"), F.count_if(~F.col("x.decoy")).alias("t")).collect()
    out: dict[str, int] = {}
    for kind in {r["kind"] for r in rows}:
        own = [r for r in rows if r["kind"] == kind]
        d_all, t_all = sum(r["d"] for r in own), sum(r["t"] for r in own)
        best = -1
        for most in range(RANDOM_MOST + 1):
            d, t = (sum(r[c] for r in own if r["bin"] <= most) for c in ("d", "t"))
            # Without decoys there is nothing to compare with, and the level of the tests decides alone.
            if t and (not d_all or d / d_all * t_all <= fdr * t):
                best = most
        out[kind] = best
    return out


def scan(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, the spans of each kind, and what the battery adds, as columns base and random (arrays of start, kind, end).

    Null and empty texts have no spans; repeated rows are scanned alike; places are code points of the whole text, however long it or
    a token in it is; an empty table gives an empty one; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    # Kept apart from what reads them: neither array is worked out twice.
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.concat(*(_base(text, kind, k) for k, kind in enumerate(KINDS))).cast(_SPANS).alias("base"))
    scanned = stored(found.select("doc_id", "base", _candidates(F.col("text"), F.col("base")).alias("tokens")), "scanned")
    most = thresholds(scanned, fdr)

    def good(x: Column) -> Column:
        limit = F.coalesce(F.create_map(*(F.lit(v) for kv in most.items() for v in kv))[x["kind"]], F.lit(-1))
        return ~x["decoy"] & (x["bin"] <= limit)

    extra = F.transform(F.filter("tokens", good), lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), x["end"].alias("end"))) if most else F.from_json(F.lit("[]"), _SPANS)
    return scanned.select("doc_id", "base", extra.cast(_SPANS).alias("random"))


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == list(KINDS).index(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "random")).alias("spans"))
