"""Text safety as column expressions: canonical form, injection rules, leaks of secrets and personal data, host checks."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lodestone.functions.text import once

# Rules of instructions in text (on its canonical form), their labels and weights.
INJECTION_RULES = [
    (r"ignore (previous|above|all) instructions", "ignore_instructions", 50),
    (r"disregard (previous|above|all|system) (instructions|policies)", "disregard_instructions", 50),
    (r"you are now (in )?(developer|root|admin|debug|system) mode", "role_mode", 40),
    (r"reveal (your|the) (system )?(prompt|instructions)", "reveal_prompt", 50),
    (r"show me (your|the) (system )?(prompt|instructions)", "show_prompt", 50),
    (r"what (is|are) your (system )?(prompt|instructions)", "ask_prompt", 30),
    (r"(print|output|dump|leak) (your|the|all) (secrets|credentials|api keys?|tokens?)", "dump_secrets", 50),
    (r"export (your|the|all) (secrets|credentials|api keys?|tokens?)", "export_secrets", 50),
    (r"call (the )?(tool|function|api)[ :\w]+", "call_tool", 40),
    (r"execute (the )?following (command|code|script)", "execute_code", 50),
    (r"run (a |the )?(python|bash|shell|sql|code|script)", "run_code", 40),
    (r"</(system|assistant|user)>", "tag_injection", 50),
    (r"<\|im_start\|>", "tag_injection", 50),
    (r"developer message was about", "replay_developer", 40),
    (r"(disregard|bypass|remove) (all )?(safety|guardrails|restrictions|content ?policies)", "guardrail_bypass", 40),
    (r"do anything now|jailbreak|dan mode", "jailbreak", 50),
    (r"pretend (you|to be) (an? )?(admin|root|developer|omniscient)", "role_play", 30),
]
# Secrets and personal data in answers, in the order in which they are redacted.
SECRETS = [
    (r"(?i)sk-[a-zA-Z0-9]{20,}", "api_key"),
    (r"(?i)-----BEGIN (?:RSA |EC )?PRIVATE KEY-----[\s\S]*?-----END", "private_key"),
    (r"(?i)Bearer\s+[a-zA-Z0-9._-]{20,}", "bearer_token"),
    (r"(?i)(?:mysql|postgres|redis|mongodb)://\w+:\w+@", "connection_string"),
    (r"(?i)eyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}", "jwt"),
]
PERSONAL = [
    (r"1[3-9]\d{9}", "phone"),
    (r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", "email"),
    (r"\d{15}(?:\d{2}[\dXx])?", "id_card"),
    (r"\d{16,19}", "bank_card"),
]
# Secrets that put a document of the corpus under quarantine.
POLLUTION = [
    (r"(?i)sk-[a-zA-Z0-9]{20,}", "api_key"),
    (r"(?i)-----BEGIN (?:RSA |EC )?PRIVATE KEY-----", "private_key"),
    (r"(?i)Bearer\s+[a-zA-Z0-9._-]+", "bearer_token"),
    (r"(?i)mysql://\w+:\w+@", "connection_string"),
    (r"(?i)https://[a-z0-9-]+\.aliyuncs\.com[a-zA-Z0-9/_-]*[a-zA-Z0-9]{16,}", "aliyun_key"),
]
# Domains whose answers may show no personal data, and what stands in its place in stored texts.
STRICT_DOMAINS = ("MENTAL", "COMPLIANCE")
SANITISED = "[已脱敏]"
PRIVATE_VALUES = [r"1[3-9]\d{9}", r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+", r"\b\d{17}[\dXx]\b"]
# Characters that are not seen; full-width forms and what they stand for.
UNSEEN = r"[\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}\x{80}-\x{9f}\x{ad}]"
WIDE, NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))


@F.pandas_udf(StringType())
def _compatible(text: pd.Series) -> pd.Series:
    """Unicode's compatibility form, which Spark has no function for, and escapes spelled out."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = re.sub(r"[​‌‍⁠﻿\u0080-\u009f­]", "", unicodedata.normalize("NFKC", t))
        t = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), t)
        return re.sub(r"\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), t)

    return text.map(one)


def canonical(text: Column) -> Column:
    """The text without disguise: compatibility form, no unseen characters, escapes decoded, half-width, single blanks, lower case.

    Only texts that are not plain ASCII, or hold an escape, go through Python.
    """
    odd = text.rlike(r"[^\x00-\x7f]|\\[ux][0-9a-fA-F]{2}")
    plain = F.translate(F.when(odd, _compatible(F.when(odd, text))).otherwise(text), WIDE, NARROW)
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def _some(flags: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*(F.when(c, F.lit(n)) for c, n in flags)), lambda x: x.isNotNull())


def injection(canonical_text: Column, retrieved: Column) -> Column:
    """struct<risk, action, rules>: the weights of the rules that hold, 15 more for retrieved text, 100 at most."""

    def judged(x: Column) -> Column:
        weight = F.lit(0)
        for i, (_, _, w) in enumerate(INJECTION_RULES):
            weight = weight + F.when(x["f"][i], w).otherwise(0)
        risk = F.least(F.lit(100), F.least(F.lit(100), weight) + F.when(x["r"] & (weight > 0), 15).otherwise(0))
        return F.struct(risk.alias("risk"), action_of(risk).alias("action"), _some([(x["f"][i], label) for i, (_, label, _) in enumerate(INJECTION_RULES)]).alias("rules"))

    # Each rule is tried once.
    return once(F.struct(F.array(*(canonical_text.rlike(p) for p, _, _ in INJECTION_RULES)).alias("f"), retrieved.alias("r")), judged)


def action_of(risk: Column) -> Column:
    return F.when(risk >= 50, "block").when(risk >= 30, "warn").otherwise("allow")


def pollution(text: Column, canonical_text: Column) -> Column:
    """struct<risk, action, findings> of a document for the corpus: injection as retrieved text, and 40 for each kind of secret."""
    seen = injection(canonical_text, F.lit(True))
    kinds = [(text.rlike(p), f"secret:{label}") for p, label in POLLUTION]
    risk = seen["risk"]
    for flag, _ in kinds:
        risk = F.least(F.lit(100), risk + F.when(flag, 40).otherwise(0))
    return F.struct(risk.alias("risk"), action_of(risk).alias("action"), F.concat(seen["rules"], _some(kinds)).alias("findings"))


def output_dlp(text: Column, domain: Column) -> Column:
    """struct<action, secrets, personal, redacted>: found in the text as it is, redacted one kind after the other.

    Secrets are always redacted, and block the answer in a strict domain; personal data is redacted in strict domains alone. A kind
    is looked for in the original text, and redacted in what the kinds before it have left.
    """
    kinds = [*SECRETS, *PERSONAL]
    # A mail address needs its sign, which is quicker to look for.
    flags = [text.contains("@") & text.rlike(p) if n == "email" else text.rlike(p) for p, n in kinds]

    def judged(x: Column) -> Column:
        out, hidden = x["t"], None
        for i, (p, n) in enumerate(kinds):
            if i == len(SECRETS):
                hidden = out
            out = F.when(x["f"][i], F.regexp_replace(out, p, f"[REDACTED:{n.upper()}]")).otherwise(out)
        found = [(x["f"][i], n) for i, (_, n) in enumerate(kinds)]
        secrets, personal = _some(found[: len(SECRETS)]), _some(found[len(SECRETS) :])
        action = F.when((F.size(secrets) > 0) & x["s"], "block").when((F.size(secrets) > 0) | x["s"] & (F.size(personal) > 0), "redact").otherwise("allow")
        return F.struct(action.alias("action"), secrets.alias("secrets"), personal.alias("personal"), F.when(x["s"], out).otherwise(hidden).alias("redacted"))

    return once(F.struct(text.alias("t"), F.array(*flags).alias("f"), domain.isin(*STRICT_DOMAINS).alias("s")), judged)


def sanitise(text: Column) -> Column:
    """Phone numbers, mail addresses and identity numbers replaced; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for p in PRIVATE_VALUES:
        out = F.regexp_replace(out, p, SANITISED)
    return out
