"""Landed replies of a trade statistics service to a bronze table, and selections from it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchantlens.session import scratch_folder
from merchantlens.sources.tables import Layers, refresh_table_unless_empty

TABLE = "comtrade_trade_flows"

# Defaults of a selection.
WORLD = "0"
ALL_COMMODITIES = "TOTAL"
DEFAULT_PERIOD = "2023"
IMPORTS, EXPORTS = "M", "X"
YEARLY, COMMODITY_TRADE, HARMONIZED = "A", "C", "HS"

UNREADABLE = "_unreadable_reply"


def read_replies(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    reply_per_line: bool = False,
    skip_unreadable: bool = False,
) -> DataFrame:
    """The records of all ``{"data": [...]}`` replies below a path, one column per record field.

    Record fields are not fixed. Unless the reply's schema is given, each reply is parsed once, to a VARIANT
    in scratch; the columns are the fields of all records together and are taken from there, so the landing
    is read once. A field that is a number here and text there is text; whole and broken numbers meet as
    doubles. Replies without records contribute nothing; an unreadable one, or one with a value its
    schema has no place for, fails the query, unless those are to be skipped.
    """
    if schema is None:
        return _variant_records(spark, path, reply_per_line, skip_unreadable)
    reader = spark.read.option("multiLine", not reply_per_line)
    reader = reader.option("mode", "DROPMALFORMED" if skip_unreadable else "FAILFAST")
    replies = reader.schema(schema).json(path)
    data = replies.schema["data"].dataType if "data" in replies.columns else None
    if not (isinstance(data, T.ArrayType) and isinstance(data.elementType, T.StructType)):
        return spark.createDataFrame([], T.StructType())
    return replies.select(F.explode("data").alias("record")).select("record.*")


def _parsed(spark: SparkSession, path: str, reply_per_line: bool) -> DataFrame:
    """(reply, data, unreadable): the records of each reply as variants.

    Unreadable are text that is no JSON and data with elements that are neither objects nor null. Data
    that is no array holds no records.
    """
    replies = spark.read.text(path, wholetext=not reply_per_line).select(F.col("value").alias("reply"))
    parsed = replies.withColumn("whole", F.try_parse_json("reply"))
    held = parsed.withColumn("data", F.try_variant_get("whole", "$.data", "array<variant>"))
    wrong = F.exists("data", lambda r: ~(_kind(r).startswith("OBJECT<") | (_kind(r) == "VOID")))
    unreadable = F.col("reply").rlike(r"\S") & (F.col("whole").isNull() | F.coalesce(wrong, F.lit(False)))
    return held.select("reply", "data", unreadable.alias("unreadable"))


def _kind(record: Column) -> Column:
    return F.coalesce(F.schema_of_variant(record), F.lit("VOID"))


def _variant_records(spark: SparkSession, path: str, reply_per_line: bool, skip_unreadable: bool) -> DataFrame:
    refused = F.raise_error(F.concat(F.lit("malformed trade reply: "), F.substring("reply", 1, 200)))
    given = F.when(~F.col("unreadable"), F.col("data"))
    data = given if skip_unreadable else F.when(F.col("unreadable"), refused).otherwise(F.col("data"))
    records = _parsed(spark, path, reply_per_line).select(F.explode(data).alias("record"))
    scratch = scratch_folder(spark, "trade-records")
    records.where(_kind(F.col("record")).startswith("OBJECT<")).write.parquet(scratch)
    stored = spark.read.schema(records.schema).parquet(scratch)
    merged = stored.select(F.schema_of_variant_agg("record")).first()[0]
    columns = _column_type(_variant_type(merged)) if merged else None
    if not isinstance(columns, T.StructType):
        return spark.createDataFrame([], T.StructType())
    return stored.select(F.col("record").cast(columns).alias("record")).select("record.*")


def _variant_type(text: str) -> T.DataType:
    """The type behind a variant's schema; names in back quotes may hold anything."""
    sql = re.sub(r"`(?:[^`]|``)*`|OBJECT<", lambda m: "STRUCT<" if m[0] == "OBJECT<" else m[0], text)
    return T.DataType.fromDDL(sql)


def _column_type(kind: T.DataType) -> T.DataType | None:
    """What a column of this kind is stored as: broken numbers as doubles, mixed kinds and bare nulls as text.

    None for objects without a single field, which hold nothing to store.
    """
    if isinstance(kind, T.StructType):
        types = {field.name: _column_type(field.dataType) for field in kind.fields}
        kept = [T.StructField(name, of) for name, of in types.items() if of is not None]
        return T.StructType(kept) if kept else None
    if isinstance(kind, T.ArrayType):
        element = _column_type(kind.elementType)
        return T.ArrayType(element) if element is not None else None
    if isinstance(kind, T.DecimalType):
        return T.DoubleType() if kind.scale else kind
    return T.StringType() if isinstance(kind, (T.VariantType, T.NullType)) else kind


def unreadable_replies(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, reply_per_line: bool = False
) -> DataFrame:
    """The text of the replies ``read_replies`` fails on with this schema, or leaves out if told so."""
    if schema is None:
        return _parsed(spark, path, reply_per_line).where("unreadable").select("reply")
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    marked = T.StructType([*kind.fields, T.StructField(UNREADABLE, T.StringType())])
    replies = spark.read.text(path, wholetext=not reply_per_line).select(F.col("value").alias("reply"))
    parsed = F.from_json("reply", marked, {"columnNameOfCorruptRecord": UNREADABLE})
    return replies.where(parsed[UNREADABLE].isNotNull())


def load_trade_flows(records: DataFrame, layers: Layers, table: str = TABLE) -> int:
    """Replace the trade-flow table by ``records``, stamped; with none it is left as it is."""
    if not records.columns:
        return 0
    layers.create(records.sparkSession)
    stamped = records.withColumn("_loaded_at", F.current_timestamp())
    return refresh_table_unless_empty(stamped, layers.table("bronze", table))


def select_trade_flows(
    flows: DataFrame,
    reporter: str,
    partner: str = WORLD,
    commodity_code: str = ALL_COMMODITIES,
    period: str = DEFAULT_PERIOD,
    trade_flow: str = IMPORTS,
    second_partner: str = WORLD,
    trade_type: str = COMMODITY_TRADE,
    frequency: str = YEARLY,
    classification: str = HARMONIZED,
    limit: int | None = None,
) -> DataFrame:
    """The records of one reporter, partner, commodity, period and direction; all, or the first ``limit``.

    Second partner, trade type, frequency and classification count where the table has them. The
    equality filters reach the scan; with a limit an ordering makes it repeatable.
    """
    wanted = {
        "reporterCode": reporter,
        "partnerCode": partner,
        "cmdCode": commodity_code,
        "period": period,
        "flowCode": trade_flow,
    }
    optional = {
        "partner2Code": second_partner,
        "typeCode": trade_type,
        "freqCode": frequency,
        "clCode": classification,
    }
    wanted.update({name: value for name, value in optional.items() if name in flows.columns})
    chosen = flows
    for name, value in wanted.items():
        chosen = chosen.where(F.col(name) == value)
    if limit is None:
        return chosen
    orderable = [name for name, kind in chosen.dtypes if not kind.startswith("map")]
    return chosen.orderBy(*orderable).limit(limit)
