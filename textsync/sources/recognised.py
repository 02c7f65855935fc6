"""Tab-separated tables of recognised words, one file an image."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textsync.functions.text import squeeze_space

# The twelve columns of a recogniser's table; a first line that begins with the first of them is its header.
COLUMNS = ["level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text"]
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def read_words(tables: DataFrame, keys: list[str], column: str = "tsv") -> tuple[DataFrame, DataFrame]:
    """Words ``(keys…, page_num, block_num, par_num, line_num, word_num, conf, text)`` of every table and the lines that are none,
    ``(keys…, row, reason)``.

    The header and blank lines are skipped. A line needs all columns (``columns``; the last one may hold further tabs), a
    confidence that is a number of at least 0 (``confidence``: recognisers write -1 for boxes without a word) and a text
    (``text_blank``). Lines are split where they are; words keep the order of their lines, which becomes ``word_num``.
    Null and empty tables have no lines."""
    line = F.posexplode(F.split(F.coalesce(column, F.lit("")), "\n")).alias("row", "line")
    lines = tables.select(*keys, line).withColumn("line", F.regexp_replace("line", "\r$", ""))
    lines = lines.where("NOT (row = 0 AND line LIKE 'level\t%')").where(F.trim(F.regexp_replace("line", r"\s", "")) != "")
    cells = F.split("line", "\t", len(COLUMNS))
    rows = lines.select(*keys, "row", cells.alias("cells"))
    conf = F.trim(F.get("cells", F.lit(10)))
    reason = (
        F.when(F.size("cells") != len(COLUMNS), "columns")
        .when(~F.coalesce(conf.rlike(NUMBER), F.lit(False)) | conf.startswith("-") & (conf.try_cast("double") < 0), "confidence")
        .when(squeeze_space(F.get("cells", F.lit(11))) == "", "text_blank")
    )
    judged = rows.withColumn("reason", reason)
    named = [F.get("cells", F.lit(COLUMNS.index(c))).alias(c) for c in ("page_num", "block_num", "par_num", "line_num", "conf", "text")]
    words = judged.where("reason IS NULL").select(*keys, *named, F.col("row").alias("word_num"))
    return words, judged.where("reason IS NOT NULL").select(*keys, "row", "reason")
