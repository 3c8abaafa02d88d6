"""Lines, words and bands from characters with coordinates (page, text, x0, x1, top, bottom)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def char_lines(chars: DataFrame, share: float = 0.6) -> DataFrame:
    """chars with line_no: a line goes on while a character's top lies above the line's first top by at most ``share`` of its height."""
    order = Window.partitionBy("page").orderBy("top", "x0")
    height = F.col("bottom") - F.col("top")
    new = F.coalesce(F.col("top") - F.lag("top").over(order) > share * height, F.lit(True)).cast("int")
    return chars.withColumn("new", new).withColumn("line_no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def rendered_lines(chars: DataFrame, gap: float = 0.25, share: float = 0.6) -> DataFrame:
    """page, line_no, text, x0, x1, top: characters of a line from left to right, a space where the gap is at least ``gap`` of the height."""
    rows = char_lines(chars, share)
    order = Window.partitionBy("page", "line_no").orderBy("x0")
    apart = F.coalesce(F.col("x0") - F.lag("x1").over(order) >= gap * (F.col("bottom") - F.col("top")), F.lit(False))
    rows = rows.withColumn("piece", F.when(apart, F.concat(F.lit(" "), "text")).otherwise(F.col("text")))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "piece"))), lambda s: s["piece"]), "")
    return rows.groupBy("page", "line_no").agg(text.alias("text"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("top").alias("top"))


def bands(boxes: DataFrame) -> DataFrame:
    """page, band_no, top, bottom: boxes whose vertical extents touch, from top to bottom."""
    order = Window.partitionBy("page").orderBy("top", "bottom")
    reach = F.max("bottom").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = boxes.withColumn("new", F.coalesce(F.col("top") > reach, F.lit(True)).cast("int"))
    rows = rows.withColumn("band_no", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("page", "band_no").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom"))


def flipped(boxes: DataFrame, height: str = "page_height") -> DataFrame:
    """Boxes measured from the top where they were measured from the bottom."""
    return boxes.withColumn("new_top", F.col(height) - F.col("bottom")).withColumn("bottom", F.col(height) - F.col("top")).withColumn("top", F.col("new_top")).drop("new_top")


def matched_images(slots: DataFrame, images: DataFrame, size: float = 0.02, ratio: float = 0.01) -> DataFrame:
    """doc_id, image_no, slot_no: each image gets a slot of its size, else of its shape; each slot is used once, in order. Both: doc_id, number, width, height."""
    import pandas as pd

    both = slots.withColumn("kind", F.lit("slot")).unionByName(images.withColumn("kind", F.lit("image")))

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        free = {s.number: s for s in rows[rows["kind"] == "slot"].sort_values("number").itertuples()}
        open_, out = [i for i in rows[rows["kind"] == "image"].sort_values("number").itertuples()], []
        like = [lambda a, b: abs(a.width - b.width) <= size * b.width and abs(a.height - b.height) <= size * b.height, lambda a, b: abs(a.width / a.height - b.width / b.height) <= ratio * b.width / b.height]
        for test in like:
            rest = []
            for i in open_:
                s = next((s for s in free.values() if test(i, s)), None)
                if s is None:
                    rest.append(i)
                else:
                    out.append((i.doc_id, i.number, s.number))
                    del free[s.number]
            open_ = rest
        return pd.DataFrame(out, columns=["doc_id", "image_no", "slot_no"])

    return both.groupBy("doc_id").applyInPandas(match, "doc_id long, image_no int, slot_no int")
