"""A relation of file paths with groups and matched companions."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_paths(spark: SparkSession, paths: Sequence[str], column: str = "file_path") -> DataFrame:
    """(position, path) of the paths in order."""
    return spark.createDataFrame([(k, str(p)) for k, p in enumerate(paths)], f"position long, `{column}` string")


def from_glob(spark: SparkSession, directory: str, pattern: str = "*.txt", regex: str | None = None, column: str = "file_path") -> DataFrame:
    """Local files that match the glob and the regular expression, sorted."""
    found = sorted(str(p) for p in Path(directory).glob(pattern))
    return from_paths(spark, [p for p in found if regex is None or re.search(regex, p)], column)


def add_glob(files: DataFrame, directory: str, pattern: str = "*.txt", regex: str | None = None, column: str = "other_file_path") -> DataFrame:
    """A second path column, matched by position."""
    return match_files(files, from_glob(files.sparkSession, directory, pattern, regex), "file_path", column)


def match_files(files: DataFrame, other: DataFrame, column: str = "file_path", other_column: str = "other_file_path") -> DataFrame:
    return files.join(other.select("position", F.col(column).alias(other_column)), "position", "left")


def concatenate(relations: Sequence[DataFrame]) -> DataFrame:
    """Rows of all relations in the columns they share, each path once."""
    shared = [c for c in relations[0].columns if all(c in r.columns for r in relations) and c != "position"]
    out = relations[0].select(*shared)
    for r in relations[1:]:
        out = out.unionByName(r.select(*shared))
    out = out.distinct().withColumn("position", F.monotonically_increasing_id())
    return out.select("position", *shared)


def exclude(files: DataFrame, stoplist: Sequence[str] | DataFrame, column: str = "file_path", column_stoplist: str = "file_path") -> DataFrame:
    """Rows whose path contains none of the stop words."""
    if isinstance(stoplist, DataFrame):
        stop = stoplist.select(F.col(column_stoplist).alias("_stop"))
        return files.join(stop, F.col(column).contains(F.col("_stop")), "left_anti")
    out = files
    for s in stoplist:
        out = out.where(~F.col(column).contains(s))
    return out


def set_group(files: DataFrame, name: str, *, pattern: str | None = None, glob: str | None = None, regex: str | None = None, column: str = "file_path") -> DataFrame:
    """``group`` set to ``name`` where all given conditions hold; a later call wins."""
    hit = F.lit(True)
    if pattern is not None:
        hit = hit & F.col(column).contains(pattern)
    if glob is not None:
        hit = hit & F.col(column).rlike("^" + fnmatch.translate(glob).replace(r"\z", "$").replace(r"\Z", "$"))
    if regex is not None:
        hit = hit & F.col(column).rlike(regex)
    before = F.col("group") if "group" in files.columns else F.lit(None).cast("string")
    return files.withColumn("group", F.when(hit, F.lit(name)).otherwise(before))


def grouped(files: DataFrame) -> DataFrame:
    """Number of files per group, without those of no group."""
    return files.where("group is not null").groupBy("group").count()


def group_identifiers(files: DataFrame) -> DataFrame:
    return files.where("group is not null").select("group").distinct()


def summary(files: DataFrame, column: str = "file_path") -> DataFrame:
    return files.agg(F.count("*").alias("n_files"), F.countDistinct(column).alias("n_unique"))


def find_upstream(directory: str, pattern: str = "*.toml", regex: str | None = None, top: str | None = None) -> str | None:
    """The nearest file that matches in the directory or one above it, up to ``top``."""
    here = Path(directory)
    while True:
        for p in sorted(here.glob(pattern)):
            if regex is None or re.search(regex, str(p)):
                return str(p)
        if here == here.parent or (top is not None and here == Path(top)):
            return None
        here = here.parent


def match_upstream(files: DataFrame, column: str = "file_path", pattern: str = "*.toml", other_column: str = "metadata", top: str | None = None) -> DataFrame:
    """The nearest upstream file of each path; the relation of paths is small and local."""
    rows = [(r[0], find_upstream(str(Path(r[1]).parent), pattern, None, top)) for r in files.select("position", column).collect()]
    return files.join(files.sparkSession.createDataFrame(rows, f"position long, `{other_column}` string"), "position")
