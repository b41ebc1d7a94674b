"""Places of regular-expression matches in a text, and edits at them, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as an array of texts, or one group of each."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def gaps(text: Column, pattern: str) -> Column:
    """The texts before, between and after the matches: one more than there are matches, none of which may be empty."""
    return F.split(text, pattern, -1)


def located(text: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<start, end, value, part>> of the matches, in code points, end exclusive; part: the text of `group`.

    Places are summed in blocks of about sqrt(n) matches and the blocks' lengths are summed after that, since an array that grows inside
    aggregate() is copied at each step: n matches cost n sqrt(n) small copies, not n * n.
    """
    found = matches(text, pattern)
    part = found if group is None else matches(text, pattern, group)
    rows = F.arrays_zip(gaps(text, pattern).alias("gap"), found.alias("value"), part.alias("part"))
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,value:string,part:string>>")

    def placed(x: Column) -> Column:
        # The last gap has no match after it.
        n = F.size(x) - 1
        block = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))

        def step(acc: Column, y: Column) -> Column:
            start = acc["at"] + F.length(y["gap"])
            end = start + F.length(y["value"])
            here = F.struct(start.alias("start"), end.alias("end"), y["value"].alias("value"), y["part"].alias("part"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(here)).alias("out"))

        zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        blocks = F.transform(F.sequence(F.lit(0), ((n - 1) / block).cast("int")), lambda k: F.aggregate(F.slice(x, k * block + 1, F.least(block, n - k * block)), zero, step))
        none = F.from_json(F.lit("[]"), "array<struct<base:int,out:array<struct<start:int,end:int,value:string,part:string>>>>")
        summed = F.aggregate(
            blocks,
            F.struct(F.lit(0).alias("at"), none.alias("out")),
            lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("base"), b["out"].alias("out")))).alias("out")),
            lambda acc: acc["out"],
        )
        moved = F.transform(summed, lambda b: F.transform(b["out"], lambda y: F.struct((b["base"] + y["start"]).alias("start"), (b["base"] + y["end"]).alias("end"), y["value"].alias("value"), y["part"].alias("part"))))
        return F.flatten(moved)

    # One element, so that the matches are found once.
    return F.when(text.rlike(pattern), F.transform(F.array(rows), placed)[0]).otherwise(empty)
