"""Lines of preprocessor output and where they came from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Line markers of gcc's and of msvc's preprocessor.
GCC, MSVC = r'^# (\d+) "([^"]*)"', r'^#line (\d+) "([^"]*)"'


def line_map(lines: DataFrame, key: str, pos: str, line: str, marker: str = GCC) -> DataFrame:
    """The rows of lines that aren't markers, with file and original: the last marker's file, and its line counted on.

    Lines before a first marker have neither. One unit of output is one partition of the window.
    """
    number = F.regexp_extract(line, marker, 1)
    is_marker = F.col(line).rlike(marker)
    before = Window.partitionBy(key).orderBy(pos)
    last = F.last(F.when(is_marker, F.struct(F.col(pos).alias("at"), F.try_to_number(F.when(is_marker, number), F.lit("9999999999")).cast("long").alias("n"), F.regexp_extract(line, marker, 2).alias("file"))), ignorenulls=True).over(before)
    told = lines.withColumn("_m", last).withColumn("_is", is_marker).filter(~F.col("_is"))
    return told.select(*lines.columns, F.col("_m.file").alias("file"), (F.col("_m.n") + F.col(pos) - F.col("_m.at") - 1).alias("original"))
