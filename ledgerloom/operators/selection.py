"""Exact order statistics without a task that holds all values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells that an interval is cut into each time; values that are few enough to be sorted at once.
CELLS, FEW = 1024, 4096


def nth_values(df: DataFrame, value: Column, places: list[int], cells: int = CELLS, few: int = FEW) -> list[float]:
    """The values at these places (from 0) of the sorted non-null ones.

    A round counts the values of each cell of an interval, with each cell's smallest and largest value: sums that every
    task starts by itself, and at most `cells` rows. The cell that holds the place is the next interval, until it holds one
    value or few enough to be sorted.
    """
    rows = df.select(value.cast("double").alias("v")).where("v is not null and not isnan(v)")
    found = []
    for place in places:
        part, lo, hi, before = rows, None, None, 0
        while True:
            if lo is None:
                cell = F.lit(0)
            else:
                part = rows.where(F.col("v").between(lo, hi))
                cell = F.least(F.floor((F.col("v") - lo) / (hi - lo) * cells), F.lit(cells - 1))
            counts = part.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("c").collect()
            for r in counts:
                if place < before + r["n"]:
                    break
                before += r["n"]
            else:
                raise IndexError(f"no value at place {place}")
            lo, hi = r["lo"], r["hi"]
            if lo == hi:
                found.append(lo)
                break
            if r["n"] <= few:
                own = sorted(x["v"] for x in rows.where(F.col("v").between(lo, hi)).collect())
                found.append(own[place - before])
                break
    return found


def medians(df: DataFrame, columns: list[str], cells: int = CELLS, few: int = FEW) -> list[float | None]:
    """The exact median of each column, the mean of the middle two where their number is even; null without values."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    sizes = df.agg(*[F.count_if(good(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    out: list[float | None] = []
    for c, n in zip(columns, sizes):
        at = sorted({(n - 1) // 2, n // 2}) if n else []
        own = nth_values(df, F.col(c), at, cells, few)
        out.append(sum(own) / len(own) if own else None)
    return out
