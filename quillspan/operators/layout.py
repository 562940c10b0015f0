"""Line structure of texts and pages as declarative plans: islands of lines, repeated page edges, page statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import strip
from quillspan.functions.unicode import repeat_key

CONTENTS_LINE = r"^.+?(\.{3,}|\t+|\s{3,})\s*\d{1,4}\s*$"
IMAGE_ONLY_CHARS, HEAVY_SHARE, REPEAT_SHARE, MIN_PAGES = 50, 0.5, 0.5, 3


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line) by line feed."""
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def islands(rows: DataFrame, key: str, flag: Column) -> DataFrame:
    """Adds ``island``: the number of the run of equal ``flag`` values within ``key`` by ``pos``; a key is one text."""
    w = Window.partitionBy(key).orderBy("pos")
    rows = rows.withColumn("flag", flag)
    change = F.coalesce((F.col("flag") != F.lag("flag").over(w)).cast("int"), F.lit(0))
    return rows.withColumn("change", change).withColumn("island", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("change")


def contents_blocks(df: DataFrame, key: str, text: str, least: int = 5) -> DataFrame:
    """(key, first_pos, n_lines) of runs of at least ``least`` lines of a table of contents."""
    x = strip("line")
    runs = islands(lines(df, key, text), key, (x != "") & x.rlike(CONTENTS_LINE))
    return runs.where("flag").groupBy(key, "island").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_lines")).where(F.col("n_lines") >= least).select(key, "first_pos", "n_lines")


def fenced_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line, fenced): a fence line toggles; it counts as fenced itself."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.col("line").rlike(r"^\s*(```|~~~)")
    rows = lines(df, key, text).withColumn("mark", mark)
    return rows.withColumn("fenced", F.col("mark") | (F.sum(F.col("mark").cast("int")).over(w) % 2 == 1)).drop("mark")


def strip_page_edges(pages: DataFrame) -> DataFrame:
    """Pages (file, page_no, lines array<string>) without first, then last lines that most pages of a file share.

    Needs at least three pages with text; the line removed is the first one equal to the candidate."""

    def candidate(take) -> Column:
        full = F.filter("lines", lambda x: strip(x) != "")
        return F.get(full, F.lit(0) if take == "first" else F.size(full) - 1)

    out = pages
    for edge in ("first", "last"):
        out = out.withColumn("cand", candidate(edge)).withColumn("edge_key", repeat_key("cand"))
        with_text = out.where("cand IS NOT NULL")
        total = with_text.groupBy("file").agg(F.count("*").alias("n_pages")) if edge == "first" else total  # noqa: F821
        common = with_text.groupBy("file", "edge_key").agg(F.count("*").alias("n")).join(total, "file")
        common = common.where((F.col("n_pages") >= MIN_PAGES) & (F.col("n") > F.col("n_pages") * REPEAT_SHARE)).select("file", "edge_key", F.lit(True).alias("common"))
        at = F.array_position("lines", F.col("cand")).cast("int")
        without = F.concat(F.slice("lines", F.lit(1), at - 1), F.slice("lines", at + 1, F.size("lines")))
        out = out.join(common, ["file", "edge_key"], "left").withColumn("lines", F.when(F.col("common"), without).otherwise(F.col("lines"))).drop("cand", "edge_key", "common")
    return out


def page_stats(pages: DataFrame) -> DataFrame:
    """Per file of pages (file, page_no, text, n_images): pages without text but with images, and whether they are
    more than half; percentages by banker's rounding."""
    only = (F.length(strip("text")) < IMAGE_ONLY_CHARS) & (F.col("n_images") > 0)
    n, k = F.count("*"), F.sum(F.coalesce(only.cast("int"), F.lit(0)))
    pct = F.bround(100.0 * k / n).cast("int")
    return pages.groupBy("file").agg(n.alias("total_pages"), k.alias("image_only_pages"), pct.alias("image_only_pct"), (k / n > HEAVY_SHARE).alias("image_heavy"))


def two_columns(words: DataFrame) -> DataFrame:
    """Per page of words (file, page_no, width, x0, x1): is there a clear gutter in the middle."""
    mid, band = F.col("width") / 2, F.col("width") * 0.04
    left, right = F.sum((F.col("x1") < mid - band).cast("int")), F.sum(((F.col("x1") >= mid - band) & (F.col("x0") > mid + band)).cast("int"))
    n = F.count("*")
    cross = n - left - right
    return words.groupBy("file", "page_no").agg(((n >= 20) & (left >= 10) & (right >= 10) & (cross <= F.greatest(F.lit(1.0), n * 0.02))).alias("two_columns"))
