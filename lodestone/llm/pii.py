"""Format-preserving pseudonyms for personal numbers, dates and addresses, with DataFrame functions alone.

A validated value is mapped to a number of its format's own range, that number is run through a keyed Feistel network over
two parts whose sizes multiply to the range, and the result is written back into the same format. The network is a
permutation: equal values get equal pseudonyms in every document, different ones different pseudonyms, and a pseudonym is valid too
(cards and account numbers keep right check digits, dates exist, octets fit). E-mail addresses have no such range; theirs are keyed hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrow import table
from lodestone.llm.spans import gaps, located

ROUNDS = 8
#: The key of the registered query and of the tests; a real run passes its own.
KEY = "example key"
# Formats. No pattern may match an empty text; they are tried in this order at each place.
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# The countries that have IBANs.
_COUNTRY = (
    "AD|AE|AL|AT|AZ|BA|BE|BG|BH|BI|BR|BY|CH|CR|CY|CZ|DE|DJ|DK|DO|EE|EG|ES|FI|FK|FO|FR|GB|GE|GI|GL|GR|GT|HR|HU|IE|IL|IQ|IS|IT|JO|KW|KZ|LB|LC|LI|LT|LU|LV|LY|MC|MD|ME|"
    "MK|MN|MR|MT|MU|NI|NL|NO|OM|PK|PL|PS|PT|QA|RO|RS|RU|SA|SC|SD|SE|SI|SK|SM|SO|ST|SV|TL|TN|TR|UA|VA|VG|XK|YE"
)
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])(?:" + _COUNTRY + r")[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9])(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}(?![0-9])|(?<![0-9])[0-9]{2}[/.][0-9]{2}[/.](?:19|20)[0-9]{2}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?:\+1[ .-]?|(?<![0-9+]))(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
}
ALL = "|".join(PATTERNS.values())
_FIRST = "1900-01-01"
#: The 73,049 days of 1900 to 2099 are 17 x 4,297; those that only month/day/year can mean, 29 February apart, 200 years x 221 days.
_DAYS = (17, 4297)
_CUM = [0, 19, 35, 54, 72, 91, 109, 128, 147, 165, 184, 202]


def _number(x: Column) -> Column:
    return F.coalesce(x.cast("long"), F.lit(0).cast("long"))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a text of digits whose last one is not doubled."""
    n = F.length(digits)

    def worth(k: Column) -> Column:
        d = F.substring(digits, n - k, F.lit(1)).cast("int")
        return F.when(k % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), lambda a, b: a + b)


def _mod97(text: Column) -> Column:
    """The ISO 7064 remainder of capital letters and digits."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97)


def _dealt(template: Column, digits: Column) -> Column:
    """The template with its k-th digit replaced by the k-th of `digits`."""
    char = F.transform(F.sequence(F.lit(1), F.length(template)), lambda k: F.struct(F.substring(template, k, F.lit(1)).alias("c"), F.length(F.regexp_replace(F.substring(template, F.lit(1), k), "[^0-9]", "")).alias("k")))
    return F.array_join(F.transform(char, lambda c: F.when(c["c"].rlike("[0-9]"), F.substring(digits, c["k"], F.lit(1))).otherwise(c["c"])), "")


def _kind(x: Column) -> Column:
    v = x["value"]
    day = F.when(v.rlike("^[0-9]{4}-"), F.try_to_date(v, "yyyy-MM-dd")).otherwise(F.try_to_date(F.translate(v, ".", "/"), "dd/MM/yyyy"))
    digits = F.regexp_replace(v, "[^0-9]", "")
    kind = (
        F.when(v.contains("@"), "email").when(v.rlike("^[A-Z]"), "iban").when(v.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})$"), "date").when(v.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(v.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip").when(v.rlike(f"^(?:{PATTERNS['phone']})$"), "phone").otherwise("card")
    )
    # Month first, where the day comes second without doubt: the kind of date is part of the format.
    us = (kind == "date") & day.isNull() & F.try_to_date(F.translate(v, ".", "/"), "MM/dd/yyyy").isNotNull()
    form = F.when(us & v.rlike("^02.29"), "leap").when(us, "us").otherwise("day")
    return F.struct(x["start"].alias("start"), x["end"].alias("end"), v.alias("value"), digits.alias("digits"), kind.alias("kind"), form.alias("form"), F.datediff(day, F.lit(_FIRST).cast("date")).cast("long").alias("day"))


def _ranged(x: Column) -> Column:
    """Adds the two parts of the value, their sizes, a tag for the range, and whether the value is valid."""
    d, kind, n = x["digits"], x["kind"], F.length(x["digits"])
    ten = F.substring(d, n - 9, F.lit(10))
    octet = F.split(x["value"], r"\.")
    # Ten-digit numbers by what their first and fourth digits may be: each form is a range of its own, all together are all of them.
    low, lower = ten.rlike("^[01]"), ten.rlike("^...[01]")
    three, seven = _number(F.substring(ten, 1, 3)), _number(F.substring(ten, 4, 7))
    half = ((n - 1) / 2).cast("int")
    form, year, month = x["form"], _number(F.substring(d, 5, 4)), _number(F.substring(d, 1, 2))
    leap = F.floor((year - 1904) / 4)
    account, part = F.substring(d, F.lit(3), n), ((n - 2) / 2).cast("int")
    plain = F.replace(x["value"], F.lit(" "), F.lit(""))
    area, tail = _number(F.substring(d, 1, 3)), _number(F.substring(d, 4, 2))

    def by_kind(**of: Column) -> Column:
        out = F.when(kind == "email", of.get("email", F.lit(0).cast("long")))
        for k in ("iban", "date", "ssn", "phone", "card", "ip"):
            out = out.when(kind == k, of[k])
        return out

    def long(v: int) -> Column:
        return F.lit(v).cast("long")

    def dated(day: Column, us: Column, leap: Column) -> Column:
        return F.when(form == "day", day).when(form == "us", us).otherwise(leap).cast("long")

    left = by_kind(
        iban=_number(F.substring(account, F.lit(1), part)), date=dated(F.floor(x["day"] / _DAYS[1]), year - 1900, F.floor(leap / 7)), ssn=area - 1 - (area > 666).cast("long"),
        phone=F.when(low, three).otherwise(three - 200),
        card=_number(F.substring(d, F.lit(1), half)), ip=_number(F.element_at(octet, 1)) * 256 + _number(F.try_element_at(octet, F.lit(2))),
    )
    cum = F.try_element_at(F.array(*map(F.lit, _CUM)), month.cast("int"))
    right = by_kind(
        iban=_number(F.substring(account, part + 1, n)), date=dated(x["day"] % _DAYS[1], cum + _number(F.substring(d, 3, 2)) - 13, leap % 7), ssn=(tail - 1) * 9999 + _number(F.substring(d, 6, 4)) - 1,
        phone=F.when(low | lower, seven).otherwise(seven - 2_000_000),
        card=_number(F.substring(d, half + 1, n - 1 - half)), ip=_number(F.try_element_at(octet, F.lit(3))) * 256 + _number(F.try_element_at(octet, F.lit(4))),
    )

    def power(k: Column) -> Column:
        return F.pow(F.lit(10.0), k).cast("long")

    a = by_kind(email=long(1), iban=power(part), date=dated(long(_DAYS[0]), long(200), long(7)), ssn=long(898), phone=F.when(low, long(200)).otherwise(long(800)), card=power(half), ip=long(65536))
    b = by_kind(email=long(1), iban=power(n - 2 - part), date=dated(long(_DAYS[1]), long(221), long(7)), ssn=long(99 * 9999), phone=F.when(low, long(10_000_000)).when(lower, long(2_000_000)).otherwise(long(8_000_000)), card=power(n - 1 - half), ip=long(65536))
    valid = by_kind(
        email=F.lit(True), iban=(F.length(plain).between(15, 34)) & (n >= 6) & (_mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1),
        date=x["day"].isNotNull() | (form != "day"), ssn=(area >= 1) & (area < 900) & (area != 666) & (tail > 0) & (_number(F.substring(d, 6, 4)) > 0),
        phone=F.lit(True), card=(_luhn(d) % 10 == 0) & ~d.rlike("^0+$"), ip=F.lit(True),
    )
    tag = F.concat_ws("/", kind, n.cast("string"), form)
    own = (
        F.when(kind == "ip", F.lit("ip")).when(kind == "phone", F.when(low, F.lit("phone/low")).when(lower, F.lit("phone/lower")).otherwise(F.lit("phone/true"))).when(kind == "iban", F.concat(F.lit("iban/"), F.substring(plain, 1, 2), F.regexp_replace(F.substring(plain, F.lit(5), F.length(plain)), "[0-9]", "0")))
        .otherwise(tag)
    )
    return F.struct(*(x[c].alias(c) for c in ("start", "end", "value", "digits", "kind", "form")), own.alias("tag"), F.coalesce(valid, F.lit(False)).alias("valid"), left.alias("l"), right.alias("r"), a.alias("a"), b.alias("b"))


def _draw(key: str, tag: Column, turn: int, value: Column) -> Column:
    """52 bits of a keyed hash."""
    text = F.concat_ws("|", F.lit(key), tag, F.lit(str(turn)), value.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")


def _turned(key: str, turn: int):
    def step(x: Column) -> Column:
        l, r = x["l"], x["r"]
        if turn % 2:
            r = (r + _draw(key, x["tag"], turn, l)) % x["b"]
        else:
            l = (l + _draw(key, x["tag"], turn, r)) % x["a"]
        return F.struct(*(x[c].alias(c) for c in ("start", "end", "value", "digits", "kind", "form", "tag", "valid")), l.alias("l"), r.alias("r"), x["a"].alias("a"), x["b"].alias("b"))

    return step


def _written(key: str):
    def step(x: Column) -> Column:
        kind, v, d, l, r, n = x["kind"], x["value"], x["digits"], x["l"], x["r"], F.length(x["digits"])

        def pad(value: Column, width: Column | int) -> Column:
            return F.lpad(value.cast("string"), F.lit(width) if isinstance(width, int) else width, F.lit("0"))

        half = ((n - 1) / 2).cast("int")
        body = F.concat(pad(l, half), pad(r, n - 1 - half))
        card = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
        ten = F.concat(pad(F.when(x["a"] == 200, l).otherwise(l + 200), 3), pad(F.when(x["b"] == 8_000_000, r + 2_000_000).otherwise(r), 7))
        ssn = F.concat(pad(l + 1 + (l >= 665).cast("long"), 3), pad(F.floor(r / 9999) + 1, 2), pad(r % 9999 + 1, 4))
        new = F.when(kind == "card", card).when(kind == "phone", F.concat(F.substring(d, F.lit(1), n - 10), ten)).when(kind == "ssn", ssn)
        day = F.date_add(F.lit(_FIRST).cast("date"), (l * _DAYS[1] + r).cast("int"))
        date = F.when(v.contains("-"), F.date_format(day, "yyyy-MM-dd")).when(v.contains("/"), F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy"))
        month = F.size(F.filter(F.array(*map(F.lit, _CUM)), lambda c: c <= r))
        sep = F.substring(v, 3, 1)
        us = F.concat(pad(month, 2), sep, pad(r - F.try_element_at(F.array(*map(F.lit, _CUM)), month) + 13, 2), sep, (1900 + l).cast("string"))
        date = F.when(x["form"] == "day", date).when(x["form"] == "us", us).otherwise(F.concat(F.lit("02"), sep, F.lit("29"), sep, (1904 + 4 * (7 * l + r)).cast("string")))
        plain = F.replace(v, F.lit(" "), F.lit(""))
        part = ((n - 2) / 2).cast("int")
        account = F.concat(pad(l, part), pad(r, n - 2 - part))
        rest = _dealt(F.substring(plain, F.lit(5), F.length(plain)), account)
        iban = _dealt(v, F.concat(pad(98 - _mod97(F.concat(rest, F.substring(plain, 1, 2), F.lit("00"))), 2), account))
        ip = F.concat_ws(".", *(F.floor(p / 256).cast("string") if q == 0 else (p % 256).cast("string") for p in (l, r) for q in (0, 1)))
        at = F.lower(v)
        email = F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), at), 256), 1, 12), F.lit("@m"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("host"), F.substring_index(at, "@", -1)), 256), 1, 8), F.lit(".example"))
        pseudonym = F.when(~x["valid"], v).when(kind == "email", email).when(kind == "date", date).when(kind == "ip", ip).when(kind == "iban", iban).otherwise(_dealt(v, new))
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), kind.alias("kind"), x["valid"].alias("valid"), pseudonym.alias("pseudonym"))

    return step


def replaced(found: Column, key: str) -> Column:
    """array<struct<start, end, kind, valid, pseudonym>> for what located() found of ALL."""
    out = F.transform(F.transform(found, _kind), _ranged)
    for turn in range(ROUNDS):
        out = F.transform(out, _turned(key, turn))
    return F.transform(out, _written(key))


def pseudonymise(df: DataFrame, key: str = KEY, text: str = "text") -> DataFrame:
    """df with its text's personal data replaced, and the column `pii` of what was found (places are those of the old text).

    Only valid values are replaced; others are listed with valid = false and stay. Null texts stay null, empty ones empty; very long
    ones are read whole; repeated rows and equal values get equal results; an empty table gives an empty one. A column named pii in df is replaced,
    all others pass through.
    """
    whole = F.col(text)
    some = F.coalesce(whole.rlike("[0-9@]"), F.lit(False))
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,kind:string,valid:boolean,pseudonym:string>>")
    listed = df.withColumn("pii", F.when(some, replaced(located(whole, ALL), key)).otherwise(none))
    spliced = F.array_join(F.zip_with(gaps(whole, ALL), F.transform("pii", lambda x: x["pseudonym"]), lambda g, p: F.concat(g, F.coalesce(p, F.lit("")))), "")
    return listed.withColumn(text, F.when(F.size("pii") > 0, spliced).otherwise(whole))


def op4_pii(spark, sf_dir: str) -> DataFrame:
    done = pseudonymise(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("pii", lambda x: x["valid"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")

    return done.select("doc_id", "text", *map(count, PATTERNS))
