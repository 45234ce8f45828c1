"""Places of regex matches as columns, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLACES = "array<struct<start:int,end:int,part:string>>"


def places(text: Column, regex: Column, group: int = 0) -> Column:
    """Every leftmost non-overlapping match: start and end in code points (end exclusive), and the text of a group.

    The text between matches is what ``split`` leaves, so a match starts where the pieces and matches before it end. The
    regex must not match an empty string.
    """
    found = F.struct(
        F.regexp_extract_all(text, regex, F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, regex, F.lit(group)).alias("part"),
        F.split(text, regex, -1).alias("between"),
    )

    def number(x):
        n = F.size(x["whole"])
        start = F.struct(F.lit(0).alias("at"), F.array().cast(PLACES).alias("out"))

        def add(done, i):
            begin = done["at"] + F.length(F.get(x["between"], i))
            end = begin + F.length(F.get(x["whole"], i))
            place = F.struct(begin.alias("start"), end.alias("end"), F.get(x["part"], i).alias("part"))
            return F.struct(end.alias("at"), F.concat(done["out"], F.array(place)).alias("out"))

        indexes = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(indexes, start, add, lambda done: done["out"])

    return F.get(F.transform(F.array(found), number), F.lit(0))
