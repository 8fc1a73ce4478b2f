"""Rows of pictures that fill a width."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.folds import fold

#: The least and the most aspect that count.
ASPECTS = (0.5, 4.0)


def justified_rows(items: DataFrame, width: float, target: float, gap: float, text_height: float, least_aspect: float, most_aspect: float) -> DataFrame:
    """items: key, nth, aspect. Pictures are put into a row until one more would press it below the target height. Per row: key, row, first_nth, n,
    top, image_height, bottom. Heights are at most twice the target, the last row's at most the target."""

    def step(state: dict, row: tuple) -> tuple:
        key, nth, aspect = row
        n, total = state.get("n", 0), state.get("total", 0.0)
        if n and width - gap * n < target * (total + aspect):
            state["row"], n, total = state.get("row", 0) + 1, 0, 0.0
        state.update(n=n + 1, total=total + aspect)
        return key, nth, state.get("row", 0), state["total"]

    clamped = items.select("key", "nth", F.least(F.greatest("aspect", F.lit(least_aspect)), F.lit(most_aspect)).alias("aspect"))
    placed = fold(clamped, "key", ["nth"], "key long, nth long, row long, total double", step)
    rows = placed.groupBy("key", "row").agg(F.min("nth").alias("first_nth"), F.count(F.lit(1)).alias("n"), F.max("total").alias("total"))
    by_key = Window.partitionBy("key")
    full = (F.lit(width) - F.lit(gap) * (F.col("n") - 1)) / F.col("total")
    last = F.col("row") == F.max("row").over(by_key)
    rows = rows.withColumn("image_height", F.least(full, F.when(last, F.lit(target)).otherwise(F.lit(2.0 * target))))
    above = F.sum(F.col("image_height") + F.lit(text_height + gap)).over(by_key.orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("top", F.coalesce(above, F.lit(0.0)))
    return rows.select("key", "row", "first_nth", "n", "top", "image_height", (F.col("top") + F.col("image_height") + F.lit(text_height)).alias("bottom"))


def visible(rows: DataFrame, top: float, bottom: float) -> DataFrame:
    """Rows that meet the stretch between top and bottom."""
    return rows.where((F.col("bottom") > top) & (F.col("top") < bottom))
