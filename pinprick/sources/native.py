"""The library's own format: Parquet, with the metadata in the schema."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import Metadata
from .text import convert_property_types


def save_native(df: DataFrame, path: str, meta: Metadata | None = None) -> None:
    """Rows as Parquet; the metadata as JSON in the first column's field metadata, so one path holds both."""
    first = df.columns[0]
    text = json.dumps(asdict(meta or Metadata()), default=str)
    df.select(F.col(first).alias(first, metadata={**df.schema[first].metadata, "lineage": text}), *df.columns[1:]).write.parquet(path)


def load_native(spark: SparkSession, path: str, *, nrows: int | None = None, convert: bool = False) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.limit(nrows) if nrows is not None else df
    return convert_property_types(df) if convert else df


def metadata_of(df: DataFrame) -> Metadata:
    text = df.schema[0].metadata.get("lineage")
    return Metadata.from_dict(json.loads(text)) if text else Metadata()
