"""A relaxation ladder (2.11): drop conditions, the least important first, until enough people pass; one pass over people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def levels(people: DataFrame, ladder: list[tuple[str, Column]]) -> DataFrame:
    """people with unmet (a bit for each condition of the ladder that doesn't hold, or is unknown) and level: how many rungs must go before a person passes.

    ladder: (name, condition), in the order in which they are dropped. On level i the first i are gone, so a person's level is the
    place of the last condition that it doesn't meet.
    """
    if len(ladder) > 62:
        raise ValueError("a ladder has 62 conditions at most")
    bits = [F.when(F.coalesce(c, F.lit(False)), F.lit(0)).otherwise(F.lit(1 << i)).cast("long") for i, (_, c) in enumerate(ladder)]
    mask = F.lit(0).cast("long")
    for b in bits:
        mask = mask.bitwiseOR(b)
    level = F.when(F.col("unmet") == 0, 0).otherwise(F.length(F.bin("unmet"))).cast("int")
    return people.withColumn("unmet", mask).withColumn("level", level)


def relaxed(people: DataFrame, ladder: list[tuple[str, Column]], top_k: int, fixed: Column | None = None) -> DataFrame:
    """The people that pass on the least relaxed level with top_k of them (on the last one, if none has), with level, unmet and dropped: the names of what was dropped.

    fixed conditions are never dropped. The level comes from a histogram with a row for each rung; nothing is filtered twice.
    """
    judged = levels(people if fixed is None else people.where(fixed), ladder)
    many = judged.groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    total = many.select("level", F.sum("n").over(Window.orderBy("level")).alias("total"))
    chosen = total.agg(F.coalesce(F.min(F.when(F.col("total") >= top_k, F.col("level"))), F.lit(len(ladder))).alias("chosen"))
    names = F.slice(F.array(*(F.lit(n) for n, _ in ladder)), 1, F.col("chosen"))
    # One row meets all people.
    return judged.join(F.broadcast(chosen), F.col("level") <= F.col("chosen")).withColumn("dropped", names).drop("chosen")


def names_of(mask: Column, ladder: list[tuple[str, Column]]) -> Column:
    """A mask's conditions by name."""
    return F.filter(F.array(*(F.when(F.getbit(mask, F.lit(i)) == 1, F.lit(n)) for i, (n, _) in enumerate(ladder))), lambda n: n.isNotNull())
