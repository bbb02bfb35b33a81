"""Line dedup across a corpus by a deletion-neighbourhood join, in DataFrame operations only.

A line counts if it has at least ``MIN_CHARS`` characters; shorter ones are left alone. Lines
are ordered by document (null ids last, rows of one id by the SHA-256 of their text) and line
number. A line occurrence is dropped

* if the same line occurs earlier, or
* if a line within one edit (a character put in, left out or changed) occurs earlier, whether
  or not that one is itself kept.

Neighbourhoods: two lines are within one edit exactly if deleting a character at the same
place leaves the same string (changed), or deleting one from the longer leaves the shorter
(put in). So each line emits its variants with one character deleted, as hashed keys, and
itself; equal keys meet in one exchange, each line takes the earliest of its key (a minimum,
no pairs), and the edit of these pairs is verified on the texts.

Emitting one key per character of the corpus would be needless for lines that no other line
resembles. With one edit, either the first or the last half of two lines agree, so only lines
whose half (its length rounded down to a multiple of 8) also occurs in another line emit
variants, and only for places outside the agreeing half. Both steps lose nothing. A long line
is cut into segments of about the root of its length: a variant's key is made of the hashes of what
stands before and after its segment and of the segment without the character, so a line of n
characters costs n ** 1.5, not n ** 2; as the shorter of two it emits a key per segment.

Equal lines are brought together by two 64-bit hashes before anything else, with partial
aggregation, so a line that makes up a third of the corpus is one row afterwards; going back to
its occurrences is a join that adaptive execution splits. A document is known by its id and a hash of
its text, so rows that repeat an id, or have none, share nothing but what they say alike; of rows
with equal id and text one is the first, and the others lose all lines that count (an id of
2**63 - 1 is no id). Null texts have no lines. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from raterkit.llm.tables import table
from raterkit.session import cut_lineage

MIN_CHARS = 20
LAST_ID = 2**63 - 1
PREFIX, SUFFIX = 1, 2
SEGMENT = 256

DOC = ["d", "r"]


def _doc_key() -> list[Column]:
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return [F.coalesce("doc_id", F.lit(LAST_ID)).alias("d"), F.conv(F.left(digest, F.lit(15)), 16, 10).cast("long").alias("r")]


def _half(length: Column) -> Column:
    return F.floor(length / 16).cast("int") * 8


def _half_keys(line: Column) -> Column:
    """Hashes of the first and last half, also with the half length of a line longer by one."""
    n = F.char_length(line)

    def key(side: int, h: Column) -> Column:
        part = F.left(line, h) if side == PREFIX else F.right(line, h)
        return F.struct(F.xxhash64(F.lit(side), h, part).alias("key"), F.lit(side).alias("side"))

    near, next_ = _half(n), _half(n + 1)
    own = F.array(key(PREFIX, near), key(SUFFIX, near))
    return F.when(near == next_, own).otherwise(F.concat(own, F.array(key(PREFIX, next_), key(SUFFIX, next_))))


def _identity(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit("second"), line).alias("h2")]


def _lines(docs: DataFrame) -> DataFrame:
    keyed = docs.select(*_doc_key(), "text")  # once per text, not per line
    return keyed.select(*DOC, F.posexplode(F.split("text", "\n", -1)).alias("p", "line"))


def _segment(n: Column) -> Column:
    """Characters of a segment of a line of ``n`` characters."""
    return F.when(n <= SEGMENT, F.lit(SEGMENT)).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(n) / 2)).cast("int"))


def _without(line: Column, at: Column) -> Column:
    return F.concat(F.left(line, at), F.substring(line, at + 2, F.char_length(line)))


def _variants(found: DataFrame) -> DataFrame:
    """``v`` (key), ``at`` (place of the character left out; -1: none) and the lines' own columns."""
    own = ["h", "h2", *DOC, "p"]
    n, line = F.char_length("line"), F.col("line")
    low = F.when(F.col("sides") == PREFIX, _half(n)).otherwise(F.lit(0))
    high = F.when(F.col("sides") == SUFFIX, n - _half(n) - 1).otherwise(n - 1)
    size, begin = F.col("size"), F.col("j") * F.col("size")

    def around(longer: DataFrame, first: Column, last: Column) -> DataFrame:
        """A row per segment, with hashes of what stands before it."""
        each = longer.select("*", F.explode(F.sequence(F.floor(first / size).cast("int"), F.floor(last / size).cast("int"))).alias("j"))
        return each.withColumn("before", F.xxhash64(F.left(line, begin)))

    parts = around(found.withColumns({"low": low, "high": high, "size": _segment(n)}), F.col("low"), F.col("high"))
    parts = parts.select(
        *own, "j", "before", begin.alias("begin"), F.xxhash64(F.substring(line, begin + size + 1, n)).alias("after"),
        F.substring(line, begin + 1, size).alias("middle"),
        F.greatest("low", begin).alias("low"), F.least(F.col("high"), begin + size - 1).alias("high"),
    )
    deleted = parts.select("*", F.explode(F.sequence("low", "high")).alias("at"))
    deleted = deleted.select(F.xxhash64("j", "before", "after", _without(F.col("middle"), F.col("at") - F.col("begin"))).alias("v"), "at", *own)
    # a line as the one with the character missing: the segments are those of a line longer by one
    whole = around(found.withColumn("size", _segment(n + 1)), F.lit(0), n).select(
        F.xxhash64("j", "before", F.xxhash64(F.substring(line, begin + size, n)), F.substring(line, begin + 1, size - 1)).alias("v"), F.lit(-1).alias("at"), *own
    )
    return deleted.unionByName(whole)


def _near(docs: DataFrame, lines: DataFrame, firsts: DataFrame, copies: bool) -> DataFrame:
    """``h, h2`` of the lines that have an earlier line within one edit."""
    keyed = lines.select("h", "h2", F.explode("keys").alias("k")).select("h", "h2", "k.key", "k.side")
    shared = keyed.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("key")
    shared = cut_lineage(shared, "halves")  # the join's two sides are then exchanges, which can be split
    sides = keyed.join(shared, "key", "left_semi").groupBy("h", "h2").agg(F.bit_or("side").alias("sides"))
    wanted = sides.join(firsts, ["h", "h2"]).select("h", "h2", "sides", "f.d", "f.r", "f.p")

    by_doc = wanted.groupBy(*DOC).agg(F.collect_list(F.struct("h", "h2", "sides", "p")).alias("w"))  # lines of one document
    texts = docs.select(*_doc_key(), F.split("text", "\n", -1).alias("lines"))
    found = (
        texts.join(by_doc, DOC).select(*DOC, "lines", F.explode("w").alias("w"))
        .select("w.h", "w.h2", "w.sides", *DOC, "w.p", F.get("lines", F.col("w.p")).alias("line"))
    )
    found = cut_lineage(found.dropDuplicates(["h", "h2"]) if copies else found, "near-lines")

    order = F.struct(*DOC, "p", "h", "h2", "at")
    key, place = Window.partitionBy("v"), Window.partitionBy("v", "at")
    is_whole = F.col("at") < 0
    earliest = F.least(
        F.min(order).over(place),  # changed: the same place deleted
        F.when(is_whole, F.min(F.when(~is_whole, order)).over(key)).otherwise(F.min(F.when(is_whole, order)).over(key)),
    )
    pairs = _variants(found).select("h", "h2", "at", order.alias("o"), earliest.alias("e")).where(F.col("e") < F.col("o"))
    pairs = pairs.select("h", "h2", "at", F.col("e.h").alias("eh"), F.col("e.h2").alias("eh2"), F.col("e.at").alias("e_at"))
    pairs = pairs.groupBy("h", "h2", "eh", "eh2").agg(F.min(F.struct("at", "e_at")).alias("places")).select("h", "h2", "eh", "eh2", "places.*")
    text = found.select("h", "h2", "line")
    other = text.select(F.col("h").alias("eh"), F.col("h2").alias("eh2"), F.col("line").alias("earlier"))
    line, earlier = F.col("line"), F.col("earlier")
    one_edit = (
        F.when((F.col("at") >= 0) & (F.col("e_at") >= 0), _without(line, F.col("at")) == _without(earlier, F.col("e_at")))
        .when(F.col("at") >= 0, _without(line, F.col("at")) == earlier)
        .when(F.col("e_at") >= 0, line == _without(earlier, F.col("e_at")))
    )
    return pairs.join(text, ["h", "h2"]).join(other, ["eh", "eh2"]).where(F.coalesce(one_edit, F.lit(False))).select("h", "h2").distinct()


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> tuple[DataFrame, DataFrame | None]:
    """``d, r, dropped`` (sorted line numbers from 0) of the documents of ``docs(doc_id, text)`` that lose
    lines; and ``d, r, copies, every`` (all lines that count) of those that stand more than once,
    None if none does."""
    own = docs.select("doc_id", "text")
    copies: DataFrame | None = own.select(*_doc_key()).groupBy(*DOC).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copies = cut_lineage(copies, "copies")
    if copies.isEmpty():
        copies = None
    lines = cut_lineage(
        _lines(own).where(F.char_length("line") >= min_chars)
        .select(*DOC, "p", *_identity(F.col("line")), _half_keys(F.col("line")).alias("keys")),
        "lines",
    )
    firsts = lines.groupBy("h", "h2").agg(F.min(F.struct(*DOC, "p")).alias("f"), F.count(F.lit(1)).alias("n"))
    near = _near(own, lines, firsts, copies is not None).withColumn("near", F.lit(True))
    # again a table of its own: a line that stands almost everywhere is a split of the join below
    groups = cut_lineage(firsts.join(near, ["h", "h2"], "left").where("n > 1 or near").select("h", "h2", "f", "near"), "repeats")
    gone = lines.select(*DOC, "p", "h", "h2").join(groups, ["h", "h2"]).where(F.col("near").isNotNull() | (F.struct(*DOC, "p") != F.col("f")))
    gone = gone.groupBy(*DOC).agg(F.array_sort(F.collect_set("p")).alias("dropped"))  # lines of one document
    if copies is not None:
        every = lines.select(*DOC, "p").join(copies.select(*DOC), DOC).groupBy(*DOC).agg(F.array_sort(F.collect_set("p")).alias("every"))
        copies = cut_lineage(copies.join(every, DOC, "left"), "copies")
    return gone, copies


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its number of lines, how many are dropped, and which (from 0, comma-joined)."""
    return line_counts(table(spark, sf_dir, "documents"))


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, n_lines, n_dropped, dropped`` of every row."""
    gone, copies = dropped_lines(docs, min_chars)
    counts = docs.select("doc_id", *_doc_key(), F.greatest(F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"))
    joined = counts.join(gone, DOC, "left")
    if copies is not None:
        single = joined.join(copies.select(*DOC), DOC, "left_anti")
        several = joined.dropDuplicates(DOC).join(copies, DOC).select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
        several = several.withColumn("dropped", F.when(F.col("copy") == 1, F.col("dropped")).otherwise(F.col("every")))
        joined = single.unionByName(several.select(*single.columns))
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return joined.select(
        "doc_id", "n_lines", F.size(dropped).cast("long").alias("n_dropped"), F.array_join(dropped.cast("array<string>"), ",").alias("dropped")
    )


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: dropped lines leave the texts; a document whose lines with any content
    are all dropped goes. ``n_chars`` follows the text; other columns are left as they are."""
    columns = docs.columns
    gone, copies = dropped_lines(docs)
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")  # clashes with no column
    joined = docs.select(row, *_doc_key()).join(gone, DOC, "left")
    if copies is not None:
        single = joined.join(copies.select(*DOC), DOC, "left_anti")
        several = cut_lineage(joined.join(copies, DOC).withColumn("number", F.monotonically_increasing_id()), "several")
        firsts = several.groupBy(*DOC).agg(F.min("number").alias("first"))
        is_first = F.col("number") == F.col("first")
        several = several.join(firsts, DOC).withColumn("dropped", F.when(is_first, F.col("dropped")).otherwise(F.col("every")))
        joined = single.unionByName(several.select(*single.columns))
    old, gone_here = F.col("row").getField("text"), F.col("dropped")
    kept = F.filter(F.split(old, "\n", -1), lambda x, i: ~F.array_contains(gone_here, i))
    new = joined.withColumn("text", F.when(gone_here.isNull(), old).otherwise(F.array_join(kept, "\n")))
    new = new.where(gone_here.isNull() | (F.regexp_replace("text", r"\s+", "") != ""))
    out = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in columns]
    if "n_chars" in columns:
        out[columns.index("n_chars")] = F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return new.select(out)
