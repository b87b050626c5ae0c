"""Small helpers the operators share."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import shared_folder

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(df: DataFrame, kind: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, safe from lost executors."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def deleted(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made and nothing reads any more."""
    spark = tables[0].sparkSession
    for t in tables:
        path = spark._jvm.org.apache.hadoop.fs.Path(t.kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets the driver's JVM notice finished shuffles, whose files Spark then deletes on the executors."""
    for _ in range(2):  # what the first pass finds unreachable is handed to the cleaner, the second finds what hung on it
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def schema_of(df: DataFrame, columns: list[str], more: str) -> T.StructType:
    """Fields of some columns of a frame, then those of a DDL string."""
    return T.StructType([df.schema[c] for c in columns] + T._parse_datatype_string(f"struct<{more}>").fields)


def carried(columns: list[str], new: list[str]) -> list[str]:
    """The carried columns whose names no new column takes: of two of one name, the new one stays."""
    return [c for c in columns if c not in new]


def named(columns: list[str]) -> list[Column]:
    """Columns by name, dots and all."""
    return [F.col(f"`{c}`") for c in columns]


def bundled(columns: list[str], name: str = "_row") -> Column:
    """Columns as one struct, so that their names meet no others on the way."""
    return F.struct(*named(columns), F.lit(None).cast("boolean").alias("_")).alias(name)


def unbundled(columns: list[str], name: str = "_row") -> list[Column]:
    return [F.col(name).getField(c).alias(c) for c in columns]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
