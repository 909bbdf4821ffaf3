"""CSV files to bronze tables with lineage columns."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchantlens.session import run_together
from merchantlens.sources.csv_records import IrregularQuotes, inferred_types, one_header, quoted_records, stored_rows
from merchantlens.sources.schemas import MANIFEST, CsvTable
from merchantlens.sources.tables import Bucketing, Layers, refresh_table

log = logging.getLogger(__name__)


CSV_OPTIONS = {"escape": '"'}
MALFORMED = "_malformed_record"


def read_csv_table(spark: SparkSession, path: str, entry: CsvTable) -> DataFrame:
    """Scan one CSV file, or a folder of part files, with a header; rows that do not fit are dropped.

    The header decides the column order, the entry the types by name. Columns the entry does not
    know are read as text, written to scratch and typed there by their values, so the file is still read
    once. Every part file must carry the same header; a deviating one fails the scan rather than shifting
    columns. Files are read by many tasks, those with line breaks in quoted values as well, unless
    their quotes do not enclose whole fields: such a file is read by one task.
    """
    header = spark.read.options(**CSV_OPTIONS, header=True, multiLine=entry.free_text).csv(path).columns
    unknown = [name for name in header if name not in entry.types]
    schema = T.StructType([T.StructField(n, entry.types.get(n, T.StringType())) for n in header])
    rows = _read_in_parts(spark, path, schema) if entry.free_text and header else None
    if rows is None:
        rows = (
            spark.read.schema(schema)
            .options(**CSV_OPTIONS, header=True, multiLine=entry.free_text, mode="DROPMALFORMED", enforceSchema=False)
            .csv(path)
            .withColumn("_source_part", F.col("_metadata.file_name"))
        )
    if unknown:
        rows = stored_rows(rows, "csv-rows")
        typed = inferred_types(rows, unknown)
        rows = rows.select(*[typed[n].alias(n) if n in typed else n for n in rows.columns])
    return rows.select(
        *header,
        F.lit(path.rstrip("/").rpartition("/")[2]).alias("_source_file"),
        "_source_part",
        F.current_timestamp().alias("_loaded_at"),
    )


def _read_in_parts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """The rows of files with line breaks in values, by many tasks; None where one task has to read them."""
    try:
        records = quoted_records(spark, path)
    except IrregularQuotes as found:
        log.warning("%s: read by one task", found)
        return None
    one_header(records)
    marked = T.StructType([*schema.fields, T.StructField(MALFORMED, T.StringType())])
    options = {**CSV_OPTIONS, "multiLine": "true", "columnNameOfCorruptRecord": MALFORMED}
    parsed = records.where("NOT is_header").select(
        F.from_csv("record", _ddl(marked), options).alias("row"), F.col("file_name").alias("_source_part")
    )
    return parsed.where(F.col("row")[MALFORMED].isNull()).select("row.*", "_source_part").drop(MALFORMED)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{field.name.replace('`', '``')}` {field.dataType.simpleString()}" for field in schema.fields)


def load_csv_table(
    spark: SparkSession, path: str, entry: CsvTable, layers: Layers, bucketing: Bucketing | None = None
) -> int:
    """Replace one bronze table by a CSV file; returns the rows stored."""
    layers.create(spark)
    n_rows = refresh_table(
        read_csv_table(spark, path, entry), layers.table("bronze", entry.table), bucketing
    )
    log.info("%s -> %s (%d rows)", path, entry.table, n_rows)
    return n_rows


def load_all_csv(
    spark: SparkSession,
    raw_folder: str,
    layers: Layers,
    bucketing: Mapping[str, Bucketing] | None = None,
) -> dict[str, int]:
    """Load every manifest file present in the landing folder; returns rows per table.

    A missing file is skipped with a warning; a missing folder is an error.
    """
    layers.create(spark)
    present = _entries(spark, raw_folder)
    jobs: dict[str, Callable[[], int]] = {}
    for entry in MANIFEST:
        path = f"{raw_folder}/{entry.file_name}"
        if entry.file_name in present:
            layout = (bucketing or {}).get(entry.table)
            jobs[entry.table] = partial(load_csv_table, spark, path, entry, layers, layout)
        else:
            log.warning("missing, skipped: %s", path)
    return run_together(spark, jobs)


def _entries(spark: SparkSession, folder: str) -> set[str]:
    """Names directly below a folder, on whatever file system it lives."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        raise FileNotFoundError(f"landing folder not found: {folder}")
    return {status.getPath().getName() for status in files.listStatus(path)}
