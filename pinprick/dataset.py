"""A frame with its metadata and region. Everything is lazy; operations return new datasets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import COORDINATES, coordinates
from .functions.regions import Region
from .lineage import Metadata
from .operators import filters, properties
from .operators.components import written


@dataclass(frozen=True)
class LocSet:
    df: DataFrame
    meta: Metadata = field(default_factory=Metadata)
    region: Region | None = None

    @staticmethod
    def from_coordinates(spark: SparkSession, points: Sequence[Sequence[float]], labels: Sequence[str] | None = None) -> "LocSet":
        labels = list(labels or COORDINATES[: len(points[0]) if points else 2])
        if any(c not in COORDINATES for c in labels):
            raise ValueError("labels are standard coordinate names")
        return LocSet(spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "index long" + "".join(f", {c} double" for c in labels)))

    @property
    def coordinate_keys(self) -> list[str]:
        return coordinates(self.df.columns)

    @property
    def dimension(self) -> int:
        return len(self.coordinate_keys)

    @property
    def coordinates(self) -> DataFrame:
        return self.df.select(*self.coordinate_keys)

    def _with(self, df: DataFrame, name: str, **parameters) -> "LocSet":
        return LocSet(df, self.meta.after(name, **parameters), self.region)

    def transform(self, operator: Callable[..., DataFrame], *args, **options) -> "LocSet":
        """Any operator of the library on the frame, noted in the history."""
        return self._with(operator(self.df, *args, **options), operator.__name__, args=args, **options)

    def select(self, ids: DataFrame | Sequence[int] | Column) -> "LocSet":
        """Rows by id (a frame or list; repeated ids repeat rows) or by a condition."""
        if isinstance(ids, Column):
            return self._with(self.df.where(ids), "select")
        if not isinstance(ids, DataFrame):
            ids = self.df.sparkSession.createDataFrame([(int(i),) for i in ids], "index long")
        return self._with(self.df.join(ids.select("index"), "index"), "select")

    def chunks(self, **options) -> "LocSet":
        return self._with(filters.chunks(self.df, **{"order_by": "index"} | options), "chunks", **options)

    @staticmethod
    def concat(sets: Sequence["LocSet"]) -> "LocSet":
        first = sets[0].meta.after("concat")
        return LocSet(filters.concat([s.df for s in sets]), Metadata(history=first.history, ancestor_identifiers=tuple(s.meta.identifier for s in sets)))

    @staticmethod
    def collection(sets: Sequence["LocSet"]) -> "LocSet":
        """All rows with a ``collection_id`` per set; :meth:`collection_properties` gives the row of each."""
        parts = [s.df.withColumn("collection_id", F.lit(k)) for k, s in enumerate(sets)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return LocSet(out, Metadata(ancestor_identifiers=tuple(s.meta.identifier for s in sets)).after("collection"))

    def collection_properties(self, by: str = "collection_id") -> DataFrame:
        return properties.collection_properties(self.df, by)

    def update_properties(self, new: DataFrame, by: str = "collection_id") -> DataFrame:
        """The properties per child with more columns joined by child."""
        return self.collection_properties(by).join(new, by, "left")

    @property
    def properties(self) -> DataFrame:
        """One row: count, mean positions, sums and box."""
        return properties.collection_properties(self.df.withColumn("_all", F.lit(0)), "_all").drop("_all")

    @property
    def centroid(self) -> DataFrame:
        return self.properties.select(*self.coordinate_keys)

    def update(self, df: DataFrame, reset_index: bool = False) -> "LocSet":
        """Other rows; with ``reset_index`` numbered from 0, in the order of their old index if they have one."""
        if reset_index:
            old = F.col("index") if "index" in df.columns else F.monotonically_increasing_id()
            df = filters.numbered_rows(df.withColumn("_old", old).drop("index"), [F.col("_old")], "index").drop("_old")
        return self._with(df, "update", reset_index=reset_index)

    def reset(self, reset_index: bool = False) -> "LocSet":
        """The same rows without region, with numbers from 0 in the order of the old index if wanted; properties are computed when asked for."""
        df = filters.numbered_rows(self.df.withColumnRenamed("index", "_old"), [F.col("_old")], "index").drop("_old") if reset_index else self.df
        return LocSet(df, self.meta.after("reset", reset_index=reset_index))

    def data(self, reference: "LocSet | None" = None) -> DataFrame:
        """The rows; with a reference, its rows of the same index, beside the columns that only this set has."""
        if reference is None:
            return self.df
        own = [c for c in self.df.columns if c != "index" and c not in reference.df.columns]
        return reference.df.join(self.df.select("index", *own), "index")

    def reduce(self) -> "LocSet":
        """The rows written out, so that later steps start from them."""
        return self._with(written(self.df), "reduce")

    def projection(self, labels: str | Sequence[str]) -> "LocSet":
        return self._with(filters.projection(self.df, labels), "projection", labels=labels)

    def summary(self) -> str:
        return f"identifier: {self.meta.identifier}\ncomment: {self.meta.comment}\nsource: {self.meta.source}\nstate: {self.meta.state}\nelement_count: {self.df.count()}"
