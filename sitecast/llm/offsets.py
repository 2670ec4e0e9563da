"""Where the matches of a pattern stand in a text, in SQL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def offsets(text: Column, pattern: str, matches: Column) -> Column:
    """Structs (start, stop; code points) of all matches: what stands between them and the matches, added up.

    Blocks of 512 matches keep the running sums short, so the work stays linear in texts with very many.
    """
    pieces = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(matches, F.length).alias("own"))
    pieces = F.slice(pieces, 1, F.size(matches))
    blocks = F.transform(F.sequence(F.lit(0), ((F.size(matches) - 1) / 512).cast("int")), lambda b: F.slice(pieces, b * 512 + 1, 512))
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        return F.struct((start + x["own"]).alias("at"), F.concat(state["spans"], F.array(F.struct(start.alias("start"), (start + x["own"]).alias("stop")))).alias("spans"))

    def run(state: Column, block: Column) -> Column:
        inner = F.aggregate(block, F.struct(state["at"].alias("at"), empty.alias("spans")), step)
        return F.struct(inner["at"].alias("at"), F.concat(state["all"], F.array(inner["spans"])).alias("all"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,stop:int>>>").alias("all"))
    return F.when(F.size(matches) > 0, F.aggregate(blocks, start, run, lambda s: F.flatten(s["all"]))).otherwise(empty)
