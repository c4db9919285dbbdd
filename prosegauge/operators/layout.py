"""Lines and paragraphs from text items placed on a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Jumps in glyph heights that start a paragraph or a line.
PARAGRAPH_GAP = 1.6
LINE_GAP = 0.3
DEFAULT_HEIGHT = 12.0


def layout_to_text(items: DataFrame) -> DataFrame:
    """(doc_id, text) from items (doc_id, page, seq, str, y, height, has_eol).

    An empty item only carries its end-of-line flag.  A break is the larger of
    what the flags since the last shown item and the vertical gap ask for.
    Windows run within one page, so no task holds a whole document's items.
    """
    page = Window.partitionBy("doc_id", "page").orderBy("seq")
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    shown = F.col("str") != ""
    flagged = items.filter(F.col("str").isNotNull()).withColumn(
        "eols", F.coalesce(F.sum(F.when(F.col("has_eol"), 1).otherwise(0)).over(before), F.lit(0))
    )
    # A break asked for before the first shown item is kept as well.
    rows = flagged.withColumn("shown", shown)
    kept = rows.filter("shown").withColumns(
        {
            "h": F.coalesce(
                F.when(F.col("height") > 0, F.col("height")),
                F.last(F.when(F.col("height") > 0, F.col("height")), ignorenulls=True).over(before),
                F.lit(DEFAULT_HEIGHT),
            ),
            "gap": F.abs(F.last("y", ignorenulls=True).over(before) - F.col("y")),
            "new_eols": F.col("eols") - F.coalesce(F.lag("eols").over(page), F.lit(0)),
        }
    )
    breaks = (
        F.when(F.col("gap") > F.col("h") * PARAGRAPH_GAP, 2)
        .when((F.col("gap") > F.col("h") * LINE_GAP) | (F.col("new_eols") > 0), 1)
        .otherwise(0)
    )
    piece = F.concat(F.repeat(F.lit("\n"), breaks), F.col("str"))
    blank = rows.filter(~F.col("shown")).select("doc_id", "page", "seq", F.lit("").alias("piece"))
    pieces = kept.select("doc_id", "page", "seq", piece.alias("piece")).unionByName(blank)

    def joined(key: str, value: str, sep: str):
        ordered = F.sort_array(F.collect_list(F.struct(key, value)))
        return F.array_join(F.transform(ordered, lambda x: x[value]), sep)

    per_page = pieces.groupBy("doc_id", "page").agg(joined("seq", "piece", "").alias("page_text"))
    return per_page.groupBy("doc_id").agg(joined("page", "page_text", "\n\n").alias("text"))
