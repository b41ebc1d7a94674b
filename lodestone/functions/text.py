"""Text functions as column expressions: tokens, grams, hashes, keys, normal forms, lexical scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a Chinese character, and the characters that end terms and sentences.
CJK = r"\x{4e00}-\x{9fff}"
TERM_BREAKS = r"[\s,.;:!?()\[\]{}\"'，。；：！？（）、“”]+"
SENTENCE_ENDS = r"(?<=[。！？!?；;])\s*"


def once(value: Column, fn) -> Column:
    """fn(value) with value worked out a single time, where fn uses it in a lambda or more than once."""
    return F.transform(F.array(value), fn)[0]


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores, single Chinese characters, and bigrams over all Chinese characters of the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(f"[a-z0-9_]+|[{CJK}]"), F.lit(0))
    return F.concat(words, char_grams(F.regexp_replace(low, f"[^{CJK}]+", ""), 2))


def char_grams(text: Column, n: int = 2) -> Column:
    """All substrings of n characters; none for shorter texts."""
    none = F.array().cast("array<string>")

    def grams(c: Column) -> Column:  # over an array: substring and slice start anew for each gram
        return F.when(F.size(c) >= n, F.transform(F.sequence(F.lit(1), F.size(c) - (n - 1)), lambda i: F.concat(*(F.get(c, i + (j - 1)) for j in range(n))))).otherwise(none)

    return once(F.filter(F.split(text, ""), lambda c: c != ""), grams)


def word_shingles(words: Column, n: int) -> Column:
    """Distinct runs of n words, joined by blanks; none for fewer words."""
    none = F.array().cast("array<string>")
    return once(words, lambda w: F.when(F.size(w) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.concat_ws(" ", *(F.get(w, i + (j - 1)) for j in range(n)))))).otherwise(none))


def collapse(text: Column) -> Column:
    """White space as single blanks, trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalise(text: Column) -> Column:
    """Runs of blanks and tabs collapsed, line ends stripped, at most one empty line in a row, trimmed."""
    out = F.regexp_replace(text, r"[ \t]+", " ")
    out = F.regexp_replace(out, r" +\n", "\n")
    return F.regexp_replace(F.regexp_replace(out, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def fingerprint_form(text: Column) -> Column:
    """Lower-case letters, digits and underscores alone."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def normalised_hash(text: Column) -> Column:
    return F.sha2(collapse(text), 256)


def stable_key(domain: Column, source: Column, version: Column, index: Column) -> Column:
    return F.concat_ws(":", domain, source, version.cast("string"), index.cast("string"))


def logical_key(document: Column, anchor: Column, kind: Column, ordinal: Column) -> Column:
    """A chunk's key by its section and place in it; colons of the anchor become underscores, 64 characters of it count."""
    name = F.trim(anchor)
    return F.concat(F.lit("doc-"), document.cast("string"), F.lit(":"), F.when(name == "", "_root").otherwise(F.substring(F.replace(name, F.lit(":"), F.lit("_")), 1, 64)), F.lit(":"), kind, F.lit(":"), ordinal.cast("string"))


def parse_stable_key(key: Column) -> Column:
    """struct<domain, source_key, version, source_index>; all null unless there are four parts."""
    part = F.split(key, ":")
    whole = F.size(part) == 4

    def field(i: int) -> Column:
        return F.when(whole, F.try_element_at(part, F.lit(i + 1)))

    return F.struct(field(0).alias("domain"), field(1).alias("source_key"), field(2).try_cast("int").alias("version"), field(3).try_cast("int").alias("source_index"))


def approx_tokens(text: Column) -> Column:
    """floor(1.3 per Chinese character + a quarter per other + 0.999)."""
    other = F.length(F.regexp_replace(text, f"[{CJK}]", ""))
    return F.floor((F.length(text) - other) * 1.3 + other / 4 + 0.999).cast("long")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_ENDS), lambda s: F.trim(s) != "")


def trimmed(texts: Column) -> Column:
    """Each text of an array without blanks at its ends. (F.trim itself as the function would take a text's number for the characters to trim.)"""
    return F.transform(texts, lambda t: F.trim(t))


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, r"\n\s*\n"), lambda s: F.trim(s) != "")


def clip(text: Column, most: int) -> Column:
    """White space collapsed; cut with "..." where longer."""
    whole = collapse(text)
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(F.substring(whole, 1, most - 3), F.lit("...")))


def terms(query: Column) -> Column:
    """Parts of at least two characters between white space and punctuation, lower-cased."""
    return F.filter(F.split(F.lower(query), TERM_BREAKS), lambda t: F.length(t) >= 2)


def keyword_score(query: Column, text: Column) -> Column:
    """The share of the query's terms that the text contains; 0 without terms."""

    def share(x: Column) -> Column:
        return F.when(F.size(x["own"]) == 0, 0.0).otherwise(F.size(F.filter(x["own"], lambda t: x["low"].contains(t))) / F.size(x["own"]))

    return once(F.struct(terms(query).alias("own"), F.lower(text).alias("low")), share)


def coverage(query_tokens: Column, text_tokens: Column) -> Column:
    """The share of the query's distinct tokens that the text has."""

    def share(x: Column) -> Column:
        return F.when(F.size(x["own"]) == 0, 0.0).otherwise(F.size(F.array_intersect(x["own"], x["all"])) / F.size(x["own"]))

    return once(F.struct(F.array_distinct(query_tokens).alias("own"), text_tokens.alias("all")), share)


def phrase_score(query: Column, text: Column) -> Column:
    """1 where the text contains the query, white space aside; else the keyword score."""
    bare = F.regexp_replace(F.lower(query), r"\s+", "")
    return F.when((bare != "") & F.regexp_replace(F.lower(text), r"\s+", "").contains(bare), 1.0).otherwise(keyword_score(query, text))


def gram_recall(needle: Column, hay: Column, n: int = 2) -> Column:
    """The share of the needle's distinct character grams that the other text has; 0 without grams."""
    return coverage(char_grams(fingerprint_form(needle), n), char_grams(fingerprint_form(hay), n))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 1 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def hash_bucket(key: Column, buckets: int = 100) -> Column:
    """The first 32 bits of the key's SHA-1, modulo the number of buckets: a draw that is the same in every run."""
    return F.conv(F.substring(F.sha1(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % buckets


def hash_vector(text: Column, dim: int = 8) -> Column:
    """A test embedding: the first bytes of the SHA-256 over 255."""
    h = F.sha2(text, 256)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255)
