"""Matches with their offsets, without Python: one pass marks them, lengths of the pieces give the rest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sprachwerk.functions.bind import let

SPAN = "array<struct<text:string,start:int,end:int>>"
#: Noncharacters, which no text for interchange holds; one that does is cleared of them, each as one character.
_OPEN, _OWN, _CLOSE = "﷐", "﷑", "﷒"


def find(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (text, start, end) of a Java pattern that never matches emptily.

    With group 1 the group must end the pattern; its span is told. Offsets count code points.
    """
    mark = _OPEN + "$0" + (_OWN + f"${group}" if group else "") + _CLOSE
    marked = F.regexp_replace(F.translate(text, _OPEN + _OWN + _CLOSE, "�" * 3), F.lit(pattern), F.lit(mark))

    def told(pieces: Column) -> Column:
        none = F.struct(F.length(F.get(pieces, F.lit(0))).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out"))

        def add(acc: Column, x: Column) -> Column:
            body = F.substring_index(x, _CLOSE, 1)
            whole, own = (F.substring_index(body, _OWN, 1), F.substring_index(body, _OWN, -1)) if group else (body, body)
            end = acc["at"] + F.length(whole)
            span = F.struct(own.alias("text"), (end - F.length(own)).cast("int").alias("start"), end.cast("int").alias("end"))
            rest = F.length(x) - F.length(body) - 1
            return F.struct((end + rest).cast("int").alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        return F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), none, add, lambda acc: acc["out"])

    # most texts hold no match: the test stops at the first and is all they pay
    return F.when(text.rlike(pattern), let(F.split(marked, _OPEN), told)).otherwise(F.expr(f"cast(array() as {SPAN})"))
