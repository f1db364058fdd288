"""Page layout from word boxes: columns, rows, lines and text. Words have page, x0, y0, x1, y1, token, block, line, word."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def columns(words: DataFrame, width: float) -> DataFrame:
    """page, columns (1 or 2) by a histogram of 20 bins of x0."""
    place = F.least(F.greatest(F.floor(F.col("x0") / width * 20), F.lit(0)), F.lit(19))
    bins = words.groupBy("page", place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    full = words.select("page").distinct().select("page", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("bin")).join(bins, ["page", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    stats = full.groupBy("page").agg(F.sum("n").alias("total"), F.min(F.when(F.col("bin").between(8, 11), F.col("n"))).alias("valley"), F.max(F.when(F.col("bin") < 8, F.col("n"))).alias("left"), F.max(F.when(F.col("bin") >= 12, F.col("n"))).alias("right"))
    return stats.select("page", F.when((F.col("total") >= 20) & (F.col("valley") < F.least("left", "right") * 0.45), 2).otherwise(1).alias("columns"))


def rows(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """``words`` with ``row``: a new row starts where y0 leaves the previous word's by more than the tolerance."""
    w = Window.partitionBy("page", "column").orderBy("y0", "x0", "word")
    jump = (F.col("y0") - F.lag("y0").over(w) > tolerance).cast("int")
    return words.withColumn("_jump", F.coalesce(jump, F.lit(0))).withColumn("row", F.sum("_jump").over(w)).drop("_jump")


def lines(words: DataFrame, width: float, tolerance: float = 3.0) -> DataFrame:
    """page, column, row, text, x0, y0, x1, y1, height in reading order (column by column)."""
    split = words.join(columns(words, width), "page").withColumn("column", F.when((F.col("columns") == 2) & (F.col("x0") > width / 2), 1).otherwise(0))
    grouped = rows(split, tolerance).groupBy("page", "column", "row")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word", "token"))), lambda r: r["token"]), " ")
    return grouped.agg(text.alias("text"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.avg(F.col("y1") - F.col("y0")).alias("height"))


def page_text(words: DataFrame, width: float) -> DataFrame:
    """page, text: lines joined, a blank one where the gap is more than eight points or 1.5 median heights."""
    found = lines(words, width)
    w = Window.partitionBy("page").orderBy("column", "row")
    gap = F.col("y0") - F.lag("y0").over(w)
    median = words.groupBy("page").agg(F.median(F.col("y1") - F.col("y0")).alias("median"))
    marked = found.join(median, "page").withColumn("shown", F.when(F.abs(gap) > F.greatest(F.lit(8.0), F.col("median") * 1.5), F.concat(F.lit("\n"), "text")).otherwise(F.col("text")))
    return marked.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column", "row", "shown"))), lambda r: r["shown"]), "\n").alias("text"))


def text_by_gaps(words: DataFrame) -> DataFrame:
    """page, text by (block, line, word) order; a space only where the gap is more than 1.5 points."""
    w = Window.partitionBy("page", "block", "line").orderBy("word")
    gap = F.col("x0") - F.lag("x1").over(w)
    parts = words.filter("trim(token) <> ''").withColumn("piece", F.concat(F.when(gap > 1.5, F.lit(" ")).otherwise(F.lit("")), F.trim("token")))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "piece"))), lambda r: r["piece"]), "")
    by_line = parts.groupBy("page", "block", "line").agg(ordered.alias("text"))
    return by_line.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line", "text"))), lambda r: r["text"]), "\n").alias("text"))


def text_by_tops(words: DataFrame) -> DataFrame:
    """page, text: words grouped by their rounded top (half to even), in order."""
    by_top = words.groupBy("page", F.bround("y0").alias("top")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", "token"))), lambda r: r["token"]), " ").alias("text"))
    return by_top.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "text"))), lambda r: r["text"]), "\n").alias("text"))
