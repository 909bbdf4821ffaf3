"""Records of CSV files whose quoted values hold line breaks, found by many tasks per file.

Spark cuts a text file into blocks at line ends, and a line end may lie inside a quoted value. Whether it does
depends on the quotes before it: an odd number means inside. So quotes are counted per block, the parities
summed over the blocks of a file tell how each block begins, and within a block a running sum tells it for
each line. Lines that are records by themselves stay as they are; only lines of a record that has several
are brought together, across block borders too. What the records say is left to Spark's CSV functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merchantlens.session import scratch_folder

# A record in which quotes enclose whole fields and are doubled inside. Anything else, such as a quote in the
# middle of an unquoted value, leaves parities without meaning; a lone CR may be a line end of its own kind.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",\r\n]*+)'
REGULAR = rf"\A{_FIELD}(?:,{_FIELD})*+\z"


class IrregularQuotes(ValueError):
    """A file whose quotes do not enclose whole fields; one task has to read it."""


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, is_header, record): the records below ``path`` in no order, blank lines left out.

    Lines end in LF or CR LF. The first record of each file is its header. ``IrregularQuotes`` is raised
    where parities cannot be relied on. The lines are written to scratch once, with their place.
    """
    lines = stored_rows(_placed_lines(spark, path), "csv-lines")
    alone = lines.where("alone").select("file_name", "is_header", F.rtrim("value", F.lit("\r")).alias("record"))
    joined = _joined_lines(lines.where("NOT alone"))
    records = alone.unionByName(joined).where(F.trim("record") != "")
    quoted = records.where(F.col("record").rlike('["\r]'))
    if not quoted.where(~F.col("record").rlike(REGULAR)).isEmpty():
        raise IrregularQuotes(f"quotes in {path} do not enclose whole fields")
    return records


def stored_rows(df: DataFrame, label: str) -> DataFrame:
    path = scratch_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line with its block, its place, whether it is a record by itself, and where its record starts.

    ``start`` is null for lines of a record that starts in an earlier block.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_block_start").alias("block"),
        # Grows along the lines of a block; blocks of one file need not be in order.
        F.monotonically_increasing_id().alias("at"),
    )
    counted = lines.withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    by_block = counted.groupBy("file", "block").agg((F.sum("quotes") % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = by_block.select("file", "block", F.coalesce(F.sum("odd").over(earlier), F.lit(0)).alias("opened"))
    within = Window.partitionBy("file", "block").orderBy("at")
    before = F.coalesce(F.sum("quotes").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stated = counted.join(begins, ["file", "block"]).withColumn("outside", (F.col("opened") + before) % 2 == 0)
    so_far = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.last(F.when(F.col("outside"), F.col("at")), ignorenulls=True).over(so_far)
    first = F.min("at").over(within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return stated.select(
        "file", "file_name", "block", "at", "value",
        start.alias("start"),
        (F.col("outside") & (F.col("quotes") % 2 == 0)).alias("alone"),
        ((F.col("block") == 0) & (start == first)).alias("is_header"),
    )


def _joined_lines(lines: DataFrame) -> DataFrame:
    """Lines of records that have several, brought together by where the record starts."""
    by_block = lines.groupBy("file", "block").agg(F.max("start").alias("last_start"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    open_ = by_block.select("file", "block", F.last("last_start", ignorenulls=True).over(earlier).alias("open_start"))
    keyed = lines.join(open_, ["file", "block"]).withColumn("start", F.coalesce("start", "open_start"))
    # Lines of one record: its blocks in file order, and the places within each.
    ordered = F.sort_array(F.collect_list(F.struct("block", "at", "value")))
    text = F.array_join(F.transform(ordered, lambda line: line["value"]), "\n")
    grouped = keyed.groupBy("file", "start").agg(
        F.max("file_name").alias("file_name"), F.coalesce(F.max("is_header"), F.lit(False)).alias("is_header"), text.alias("record")
    )
    return grouped.select("file_name", "is_header", F.rtrim("record", F.lit("\r")).alias("record"))


def one_header(records: DataFrame) -> str:
    """The header all files share; another one in any file is an error. Without a record: the empty string."""
    headers = records.where("is_header").select(F.regexp_replace("record", "\\A\ufeff", "").alias("h")).distinct()
    found = [row["h"] for row in headers.limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"the header differs between files: {found[0]!r}, {found[1]!r}")
    return found[0] if found else ""


def inferred_types(rows: DataFrame, names: list[str]) -> dict[str, Column]:
    """Text columns as the narrowest of the types a CSV reader infers that all their values fit, in one pass."""
    kinds = ("int", "bigint", "decimal(38,0)", "double", "timestamp", "boolean")
    fits = {
        (name, kind): F.bool_and(F.col(name).isNull() | (F.col(name).try_cast(kind).isNotNull() & _plain(name, kind)))
        for name in names
        for kind in kinds
    }
    has_value = {name: F.count(F.col(name)) > 0 for name in names}
    row = rows.agg(*[c.alias(f"{names.index(n)} {k}") for (n, k), c in fits.items()],
                   *[c.alias(f"{names.index(n)}") for n, c in has_value.items()]).first()
    chosen = {}
    for k, name in enumerate(names):
        kind = next((kind for kind in kinds if row[f"{k}"] and row[f"{k} {kind}"]), "string")
        chosen[name] = F.col(name).cast(kind)
    return chosen


def _plain(name: str, kind: str) -> Column:
    """Casts accept more than a CSV reader: fractions for whole numbers, words for truth values."""
    text = F.trim(F.col(name))
    if kind in ("int", "bigint", "decimal(38,0)"):
        return text.rlike(r"\A[+-]?\d+\z")
    if kind == "double":
        return ~text.rlike(r"[dDfF]\z")
    if kind == "boolean":
        return F.lower(text).isin("true", "false")
    return F.lit(True)
