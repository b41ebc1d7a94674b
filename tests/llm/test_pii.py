from __future__ import annotations

import datetime
import hashlib
import itertools
import random
import re

from pyspark.sql import functions as F

from lodestone.llm import pii as P


def luhn(s: str) -> bool:
    digits = [int(c) for c in s if c.isdigit()]
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(digits))) % 10 == 0


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["text"], r["pii"]) for r in P.pseudonymise(df).orderBy("doc_id").collect()]


def test_formats(spark):
    text = "a 4111 1111 1111 1111, 4111111111111111; 4111111111111112 on 2024-02-29 or 30.02.2001 31/12/2099 at 10.0.0.1 999.1.1.1 123-45-6789 000-12-3456 +1 (743) 555-3824 (743) 555-3824 Ab.c@x.org ab.c@x.org end"
    (out, found), = run(spark, [text])
    got = re.fullmatch(
        r"a (\d{4} \d{4} \d{4} \d{4}), (\d{16}); 4111111111111112 on (\d{4}-\d\d-\d\d) or 30\.02\.2001 (\d\d/\d\d/\d{4}) at ([\d.]+) 999\.1\.1\.1 (\d{3}-\d\d-\d{4}) 000-12-3456 \+1 (\(\d{3}\) \d{3}-\d{4}) (\(\d{3}\) \d{3}-\d{4}) (\S+@\S+) (\S+@\S+) end",
        out,
    )
    assert got, out
    assert luhn(got[1]) and got[1].replace(" ", "") == got[2] != "4111111111111111"
    datetime.date.fromisoformat(got[3]), datetime.datetime.strptime(got[4], "%d/%m/%Y")
    assert all(int(o) < 256 for o in got[5].split(".")) and got[7] == got[8] and got[9] == got[10]
    assert [text[x["start"] : x["end"]] for x in found if not x["valid"]] == ["4111111111111112", "30.02.2001", "000-12-3456"]


def test_linked_and_one_to_one(spark):
    days = [(datetime.date(1899, 12, 31) + datetime.timedelta(d)).isoformat() for d in range(1, 73_050, 97)]
    ips = [f"10.{a}.{b}.7" for a, b in itertools.product(range(20), range(20))]
    texts = [f"x {d} y" for d in days] + [f"x {i} y" for i in ips]
    outs = [o for o, _ in run(spark, texts)]
    assert len(set(outs)) == len(texts) and outs == [o for o, _ in run(spark, texts)]
    assert len({o for o, _ in run(spark, ["2099-08-05 2099-08-06 2099-12-31 1900-01-01"])}) == 1


def test_every_day_has_its_own(spark):
    """All 73,049 days, and the days that only month/day/year can mean: none keeps a pattern, none is met twice."""
    first = datetime.date(1900, 1, 1)
    days = [first + datetime.timedelta(d) for d in range(73_049)]
    outs = [o for o, _ in run(spark, [d.isoformat() for d in days])]
    assert sorted(outs) == [d.isoformat() for d in days]
    steps = [(datetime.date.fromisoformat(b) - datetime.date.fromisoformat(a)).days for a, b in zip(outs, outs[1:])]
    assert max(steps.count(x) for x in set(steps[-200:])) < 60  # no constant shift, the last ones included
    us = [f"{d.month:02d}/{d.day:02d}/{d.year}" for d in days if d.day > 12]
    outs = [o for o, _ in run(spark, us)]
    assert sorted(outs) == sorted(us) and sum(a == b for a, b in zip(us, outs)) < 20 and outs[0] != us[0]


def test_phones_keep_their_range(spark):
    """Ten-digit numbers of all three forms, at the borders between them: no two share a pseudonym, and none leaves its form."""
    rng = random.Random(2)
    ends = [a + b for a in ("000", "001", "199", "200", "201", "999") for b in ("0000000", "0000001", "1999999", "2000000", "2000001", "9999999")]
    tens = sorted({*ends, "1501234567", "7826354456", *(f"{rng.randrange(10**10):010d}" for _ in range(4000))})
    outs = [re.sub(r"\D", "", o) for o, _ in run(spark, [f"x {t[:3]}-{t[3:6]}-{t[6:]} y" for t in tens])]
    assert len(set(outs)) == len(tens) and sum(a == b for a, b in zip(outs, tens)) < 3
    form = lambda t: (t[0] in "01", t[0] not in "01" and t[3] in "01")
    assert all(form(a) == form(b) for a, b in zip(outs, tens))


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_account_numbers(spark):
    texts = ["pay DE89 3704 0044 0532 0130 00 now", "GB82WEST12345698765432", "NO9386011117947,", "DE89 3704 0044 0532 0130 01 wrong", "x DE89370400440532013000 y"]
    outs = run(spark, texts)
    found = re.fullmatch(r"pay (DE\d\d(?: \d{4}){4} \d\d) now", outs[0][0])
    assert found and iban_ok(found[1]) and found[1] != "DE89 3704 0044 0532 0130 00" and outs[4][0] == f"x {found[1].replace(' ', '')} y"
    assert re.fullmatch(r"GB\d\dWEST\d{14}", outs[1][0]) and iban_ok(outs[1][0]) and outs[1][0] != texts[1]
    assert iban_ok(outs[2][0].strip(",")) and outs[2][0] != texts[2] and outs[3][0] == texts[3] and not outs[3][1][0]["valid"]


def feistel(key: str, tag: str, value: int, a: int, b: int) -> int:
    """The network by itself, in Python's integers."""
    l, r = divmod(value, b)
    for turn in range(P.ROUNDS):
        draw = int(hashlib.sha256(f"{key}|{tag}|{turn}|{l if turn % 2 else r}".encode()).hexdigest()[:13], 16)
        if turn % 2:
            r = (r + draw) % b
        else:
            l = (l + draw) % a
    return l * b + r


def plain(text: str) -> str:
    """All kinds by plain code: patterns stated anew, one value at a time."""
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    pattern = re.compile(
        r"(?P<email>(?<![\w.%+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})|(?P<iso>(?<!\d)(?:19|20)\d\d-\d\d-\d\d(?!\d))|(?P<ssn>(?<![\d-])\d{3}-\d\d-\d{4}(?![\d-]))"
        r"|(?P<phone>(?:\+1[ .-]?|(?<![\d+]))(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d))|(?P<card>(?<!\d)(?:\d{13,19}|\d{4}(?P<s>[ -])\d{4}(?P=s)\d{4}(?P=s)\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d))"
        rf"|(?P<ip>(?<![\d.])(?:{octet}\.){{3}}{octet}(?!\d|\.\d))",
        re.A,
    )

    def new(m: re.Match) -> str:
        v, kind = m[0], m.lastgroup if m.lastgroup != "s" else "card"
        digits = re.sub(r"\D", "", v)

        def dealt(some: str) -> str:
            it = iter(some)
            return re.sub(r"\d", lambda _: next(it), v)

        if kind == "email":
            low = v.lower()
            return f"u{hashlib.sha256(f'{P.KEY}|email|{low}'.encode()).hexdigest()[:12]}@m{hashlib.sha256(f'{P.KEY}|host|{low.split('@')[-1]}'.encode()).hexdigest()[:8]}.example"
        if kind == "iso":
            try:
                day = (datetime.date.fromisoformat(v) - datetime.date(1900, 1, 1)).days
            except ValueError:
                return v
            return (datetime.date(1900, 1, 1) + datetime.timedelta(feistel(P.KEY, "date/8/day", day, 17, 4297))).isoformat()
        if kind == "ssn":
            area, tail, end = int(digits[:3]), int(digits[3:5]), int(digits[5:])
            if not (1 <= area < 900 and area != 666 and tail and end):
                return v
            x = feistel(P.KEY, "ssn/9/day", (area - 1 - (area > 666)) * 99 * 9999 + (tail - 1) * 9999 + end - 1, 898, 99 * 9999)
            area, rest = divmod(x, 99 * 9999)
            return dealt(f"{area + 1 + (area >= 665):03d}{rest // 9999 + 1:02d}{rest % 9999 + 1:04d}")
        if kind == "phone":
            ten = digits[-10:]
            form, first, rest, low, high = next(
                (form, range(a, b), range(c, d), a, c)
                for form, pattern, a, b, c, d in (("low", "[01]", 0, 200, 0, 10**7), ("lower", "[2-9]..[01]", 200, 1000, 0, 2_000_000), ("true", "[2-9]..[2-9]", 200, 1000, 2_000_000, 10**7))
                if re.match(pattern, ten)
            )
            x = feistel(P.KEY, f"phone/{form}", (int(ten[:3]) - low) * len(rest) + int(ten[3:]) - high, len(first), len(rest))
            ten = f"{x // len(rest) + low:03d}{x % len(rest) + high:07d}"
            return dealt(digits[:-10] + ten)
        if kind == "card":
            n = len(digits)
            half = (n - 1) // 2
            if not luhn(digits) or not digits.strip("0"):
                return v
            body = f"{feistel(P.KEY, f'card/{n}/day', int(digits[:-1]), 10**half, 10 ** (n - 1 - half)):0{n - 1}d}"
            return dealt(body + next(str(c) for c in range(10) if luhn(body + str(c))))
        value = 0
        for part in v.split("."):
            value = value * 256 + int(part)
        value = feistel(P.KEY, "ip", value, 65536, 65536)
        return ".".join(str(value >> 8 * k & 255) for k in (3, 2, 1, 0))

    return pattern.sub(new, text)


def test_whole_table_against_plain_code(documents, texts):
    got = {r["doc_id"]: r["text"] for r in P.pseudonymise(documents).collect()}
    wrong = [i for i, t in texts.items() if got[i] != (None if t is None else plain(t))]
    assert not wrong, (wrong[:3], len(wrong))
    assert sum(got[i] != t for i, t in texts.items()) > 5


def test_very_many_matches(spark):
    n = 100_000
    (out, found), = run(spark, [" ".join(f"10.{k % 200}.{k // 500}.7" for k in range(n))])
    assert len(found) == n and len(out.split()) == n and found[-1]["end"] == len(" ".join(f"10.{k % 200}.{k // 500}.7" for k in range(n)))


def test_places_are_code_points(spark):
    (out, found), = run(spark, ["😀é 10.1.1.1 日本 a@b.org"])
    assert [(x["start"], x["end"]) for x in found] == [(3, 11), (15, 22)] and out.startswith("😀é ")


def test_odd_rows(odd_docs, documents, texts):
    rows = P.pseudonymise(odd_docs).drop("pii")
    assert rows.columns == odd_docs.columns and sorted(map(str, rows.collect())) == sorted(map(str, odd_docs.collect()))
    assert P.pseudonymise(odd_docs.limit(0)).count() == 0
    after = {r["doc_id"]: r["text"] for r in P.pseudonymise(documents).collect()}
    number = re.compile(r"(?<!\d)\d{13,19}(?!\d)")
    for i, text in texts.items():
        old, new = number.findall(text), number.findall(after[i])
        assert len(old) == len(new) and all((a != b) == luhn(a) and luhn(a) == luhn(b) for a, b in zip(old, new))
    assert P.pseudonymise(documents, key="another").select(F.sum(F.hash("text"))).first() != P.pseudonymise(documents).select(F.sum(F.hash("text"))).first()
