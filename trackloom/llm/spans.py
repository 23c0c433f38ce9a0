"""Regular-expression matches with their places, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,h:string,l:string,r:string>>"


def with_matches(df: DataFrame, name: str, pattern: str, text: str = "text", gate: str | None = None, left: int = 48, right: int = 24) -> DataFrame:
    """Add ``name``: the leftmost non-overlapping matches of ``pattern`` as an array of structs.

    s and e are code points (end exclusive), h is the match, l and r the text just before and after it, up to the
    neighbouring matches. Splitting by the pattern gives the gaps, so the places are running sums of lengths.
    Texts without the character ``gate`` are not searched.
    """
    quoted = "r'" + pattern.replace("'", "\\x27") + "'"
    test = f"locate('{gate}', {text}) > 0" if gate else "true"
    return (
        df.withColumn("__h", F.expr(f"if({test}, regexp_extract_all({text}, {quoted}, 0), cast(array() as array<string>))"))
        .withColumn("__g", F.expr(f"if(size(__h) > 0, split({text}, {quoted}, -1), cast(array() as array<string>))"))
        .withColumn(
            name,
            F.expr(f"""
            aggregate(
              transform(__h, (h, i) -> named_struct('gap', length(get(__g, i)), 'n', length(h), 'h', h, 'l', right(get(__g, i), {left}), 'r', left(get(__g, i + 1), {right}))),
              named_struct('at', 0, 'out', cast(array() as {SPAN})),
              (a, z) -> named_struct('at', a.at + z.gap + z.n, 'out', array_append(a.out, named_struct('s', a.at + z.gap, 'e', a.at + z.gap + z.n, 'h', z.h, 'l', z.l, 'r', z.r))),
              a -> a.out)"""),
        )
        .drop("__h", "__g")
    )


def labelled(kinds: list[str]) -> str:
    """SQL for one array of (s, k, e) over the columns of the kinds, by start and then as listed."""
    parts = ", ".join(f"transform({k}, m -> named_struct('s', m.s, 'k', {i}, 'e', m.e))" for i, k in enumerate(kinds))
    return f"array_sort(concat({parts}))"


def joined(spans: str, kinds: list[str]) -> str:
    """SQL for kind:start:end of an array of (s, k, e), comma-joined."""
    names = ", ".join(f"'{k}'" for k in kinds)
    return f"array_join(transform({spans}, x -> concat(get(array({names}), x.k), ':', x.s, ':', x.e)), ',')"
