"""Readers with explicit schemas, a reject side-output, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException


def csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A CSV file with a header; the first malformed row is an error."""
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=False)


def json_documents(spark: SparkSession, path: str, schema: str | StructType, optional: bool = False) -> DataFrame:
    """JSON files of one document or array each; an optional one that is missing has no rows."""
    try:
        return spark.read.json(path, schema=schema, multiLine=True)
    except AnalysisException as error:
        if optional and error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def geojson_features(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """One row for each feature: its properties, lon and lat."""
    point = "geometry: struct<type: string, coordinates: array<double>>"
    rows = json_documents(spark, path, f"features array<struct<properties: struct<{properties}>, {point}>>").select(F.explode("features").alias("f"))
    return rows.select("f.properties.*", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))


def json_column(c: Column, schema: str, fallback: Column) -> Column:
    """A parsed JSON text, or the fallback where it is malformed."""
    return F.coalesce(F.when(F.try_parse_json(c).isNotNull(), F.from_json(c, schema)), fallback)


def admitted(rows: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows without a fault, and the others with `reason`, the first fault that holds."""
    reason = F
    for name, fault in reasons.items():
        reason = reason.when(F.coalesce(fault, F.lit(True)), F.lit(name))
    judged = rows.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def over_budget(rows: DataFrame, most_bytes: int) -> bool:
    """Whether the rows as JSON lines take more bytes."""
    size = rows.select(F.sum(F.octet_length(F.to_json(F.struct(*rows.columns))) + 1)).first()[0] or 0
    return size > most_bytes
