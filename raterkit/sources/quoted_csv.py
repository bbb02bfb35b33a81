"""S1 for CSV sheets whose values hold line breaks, read in splits: records by quote parity.

A line break ends a record unless it stands between quotes, that is unless the number of quotes
before it in the file is odd. Each line knows its own quotes; sums over the lines of a split, and over
the splits before it (one row per split), tell for every line whether a record begins there. Lines of
one record are then joined, and only those of records of several lines are shuffled. The
sheet must be written by the rules of RFC 4180: a value with quotes, separators or line breaks is quoted, quotes
within it are doubled (``multi_line="file"`` of ``read_answers`` reads other sheets in one task).
"""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from raterkit.session import cut_lineage


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """``file, record`` (number in its file from 0, the header's), ``text`` (without its last line break) of every record."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("id"),
        "value",
        (F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))).cast("long").alias("quotes"),
        F.col("value").isin("", "\r").alias("blank"),
    )
    narrow = cut_lineage(lines.select("file", "split", "id", "quotes", "blank"), "lines")
    # a split's lines have consecutive ids, so the id orders them; sums within a split, then over splits
    within = Window.partitionBy("file", "split").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    inside = narrow.withColumn("q", F.coalesce(F.sum("quotes").over(within), F.lit(0)))
    splits = narrow.groupBy("file", "split").agg(F.sum("quotes").alias("quotes"))
    splits = splits.select("file", "split", F.coalesce(F.sum("quotes").over(before), F.lit(0)).alias("earlier"))
    begins = inside.join(splits, ["file", "split"]).withColumn("even", (F.col("q") + F.col("earlier")) % 2 == 0)
    begins = begins.where(~(F.col("even") & F.col("blank")))  # an empty line between records is none
    begins = cut_lineage(begins.select("file", "split", "id", F.col("even").cast("long").alias("begins")), "begins")
    upto = Window.partitionBy("file", "split").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    counts = begins.groupBy("file", "split").agg(F.sum("begins").alias("n"))
    counts = counts.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    numbered = begins.withColumn("n", F.sum("begins").over(upto)).join(counts, ["file", "split"])
    numbered = cut_lineage(numbered.select("file", "id", (F.col("n") + F.col("earlier") - 1).alias("record")), "records")
    several = numbered.groupBy("file", "record").agg(F.count(F.lit(1)).alias("lines")).where("lines > 1")
    placed = lines.select("file", "id", "value").join(numbered, ["file", "id"])
    single = placed.join(several, ["file", "record"], "left_anti").select("file", "record", F.col("value").alias("text"))
    # a record's lines; the record itself is one value
    joined = placed.join(several, ["file", "record"]).groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("id", "value"))).alias("l"))
    joined = joined.select("file", "record", F.array_join(F.col("l.value"), "\n").alias("text"))
    every = single.unionByName(joined)
    # line ends are "\n" within values too, as the reader of whole files has them
    return every.withColumn("text", F.replace(F.regexp_replace("text", "\r$", ""), F.lit("\r\n"), F.lit("\n")))


def read_quoted_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """The rows of a CSV sheet with a header line, with their 1-based ordinal ``row`` (files by name,
    then place in the file). Columns are text unless ``schema`` names and types them, in the sheet's order."""
    records = cut_lineage(csv_records(spark, path), "sheet")
    if schema is None:
        header = records.where("record = 0").orderBy("file").select("text").first()
        if header is None:
            return spark.createDataFrame([], "row long")
        names = next(csv.reader([header.text], strict=False), [])
        names = [n if n and n not in names[:i] else f"{n or '_c'}{i}" for i, n in enumerate(names)]
        schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = records.where("record > 0")
    by_file = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(by_file), F.lit(0)).alias("earlier"))
    row = (F.col("earlier") + F.col("record")).cast("long").alias("row")
    parsed = rows.join(files, "file").select(F.from_csv("text", schema, {"escape": '"', "multiLine": "true"}).alias("c"), row)
    return parsed.select("c.*", "row")
