"""Table scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan with a fixed schema; ``columns`` reach the scan as its read schema."""
    df = spark.read.schema(schema).parquet(path)
    return df.select(*columns) if columns else df


def existing_keys(df: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys of a stored table, for exclusion joins."""
    return df.select(key).where(F.col(key).isNotNull()).distinct()


def write_json(df: DataFrame, path: str) -> None:
    """Result sink: JSON lines, one file per task, replacing an earlier result."""
    df.write.mode("overwrite").json(path)


def append(df: DataFrame, path: str, schema: T.StructType | None = None) -> None:
    """Append-only insert; the columns are put into the table's order and types first."""
    if schema is not None:
        present = set(df.columns)
        df = df.select(
            *[
                (F.col(f.name).cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
                for f in schema
            ]
        )
    df.write.mode("append").parquet(path)
