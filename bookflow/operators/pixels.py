"""Facts on images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pixel_stats(pixels: DataFrame, placeholder: float = 0.8) -> DataFrame:
    """A5: (image, n, white, placeholder, color) from pixel rows (image, r, g, b).

    white is the share of pixels with all channels over 240, placeholder whether it exceeds the limit, color the
    mean of the largest less the smallest channel, to two places. Sums are taken before the shuffle.
    """
    white = F.avg(((F.col("r") > 240) & (F.col("g") > 240) & (F.col("b") > 240)).cast("double"))
    spread = F.avg((F.greatest("r", "g", "b") - F.least("r", "g", "b")).cast("double"))
    found = pixels.groupBy("image").agg(F.count("*").alias("n"), white.alias("white"), F.round(spread, 2).alias("color"))
    return found.select("image", "n", "white", (F.col("white") > placeholder).alias("placeholder"), "color")


def array_stats(images: DataFrame, values: str = "values", high: float = 240.0) -> DataFrame:
    """A5 on one array of channel values for each image: with n, high_share and spread, in the row and without a shuffle."""
    n = F.size(values)
    over = F.size(F.filter(values, lambda v: v > high))
    return images.withColumns({"n": n, "high_share": over / n, "spread": F.array_max(values) - F.array_min(values)})


def chapter_line(pixels: DataFrame, row: int, color: tuple[int, int, int], length: int) -> DataFrame:
    """A5: (image, new): whether exactly `length` pixels of the row have the colour, the sign of a new chapter."""
    r, g, b = color
    hit = (F.col("y") == row) & (F.col("r") == r) & (F.col("g") == g) & (F.col("b") == b)
    return pixels.groupBy("image").agg((F.count_if(hit) == length).alias("new"))


def inline_images(images: DataFrame, pixel: int = 32768, size: int = 8192, hue: float = 4.0) -> DataFrame:
    """With `inline`: at least two of: few pixels, few bytes, little colour; unknown facts do not count."""
    facts = (F.col("width").cast("long") * F.col("height") < pixel, F.col("size") < size, F.col("color") < hue)
    return images.withColumn("inline", sum(F.coalesce(f, F.lit(False)).cast("int") for f in facts) >= 2)
