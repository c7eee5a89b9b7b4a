"""Analyses as objects: parameters, metadata, results; pipelines of user functions; regions of interest."""

from __future__ import annotations

import ast
import inspect
import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame

from .functions import regions
from .functions.regions import Region
from .lineage import Metadata
from .operators.filters import select_by_region


@dataclass
class Analysis:
    """An operator with its parameters; ``compute`` keeps the (lazy) results."""

    operator: Callable[..., DataFrame]
    parameter: dict = field(default_factory=dict)
    meta: Metadata = field(default_factory=Metadata)
    results: DataFrame | None = None

    def compute(self, df: DataFrame, *more: DataFrame) -> "Analysis":
        self.results = self.operator(df, *more, **self.parameter)
        self.meta = self.meta.after(self.operator.__name__, **self.parameter)
        return self

    def __getstate__(self) -> dict:
        return self.__dict__ | {"results": None}  # frames belong to their session

    def __repr__(self) -> str:
        return f"{self.operator.__name__}({', '.join(f'{k}={v!r}' for k, v in self.parameter.items())})"


class Pipeline:
    """A user function of keyword arguments; analyses hang off the object it is given."""

    def __init__(self, computation: Callable, **kwargs) -> None:
        self.computation, self.kwargs, self.meta = computation, kwargs, Metadata()

    def compute(self) -> "Pipeline":
        self.computation(self, **self.kwargs)
        self.meta = self.meta.after(self.computation.__name__)
        return self

    def computation_as_string(self) -> str:
        return inspect.getsource(self.computation)

    def save_computation(self, path: str) -> None:
        Path(path).write_text(self.computation_as_string())


_KINDS = {c.__name__: c for c in (regions.Box, regions.Rectangle, regions.Ellipse, regions.Polygon, regions.LineSegment, regions.Cuboid)}


_NOTATION = ("Interval", "AxisOrientedRectangle", "Rectangle", "Ellipse", "Polygon", "AxisOrientedCuboid", "Cuboid", "AxisOrientedHypercuboid")


def _tuples(x):
    return tuple(map(_tuples, x)) if isinstance(x, list) else x


@dataclass(frozen=True)
class Roi:
    """A region with the data it belongs to and the columns it is about."""

    region: Region
    reference: str = ""
    columns: tuple[str, ...] = ()

    def select(self, df: DataFrame) -> DataFrame:
        return select_by_region(df, self.region, list(self.columns) or None)

    def save(self, path: str) -> None:
        """As JSON (which is YAML too)."""
        fields_ = {k: v for k, v in asdict(self.region).items() if k in inspect.signature(type(self.region)).parameters}
        Path(path).write_text(json.dumps({"region_type": type(self.region).__name__, "region_specs": fields_, "reference": self.reference, "columns": list(self.columns)}))

    @staticmethod
    def load(path: str) -> "Roi":
        text = Path(path).read_text()
        if not text.lstrip().startswith("{"):
            return Roi._from_notation(text)
        x = json.loads(text)
        kind = _KINDS[x["region_type"]]
        return Roi(kind(**{k: _tuples(v) for k, v in x["region_specs"].items()}), x["reference"], tuple(x["columns"]))


    @staticmethod
    def _from_notation(text: str) -> "Roi":
        """From YAML with ``reference``, ``region`` (a call such as ``Rectangle((0, 0), 2, 1, 45)``) and ``loc_properties``."""
        import yaml  # only this notation needs it

        x = yaml.safe_load(text)
        call = re.fullmatch(r"(\w+)\((.*)\)", x["region"].strip(), re.DOTALL)
        make = getattr(regions, call[1], None) if call else None
        if call is None or call[1] not in _NOTATION or make is None:
            raise ValueError("the file names no region")
        args = ast.literal_eval(f"[{call[2]}]")
        return Roi(make(*map(_tuples, args)), x.get("reference") or "", tuple(x.get("loc_properties") or ()))


def roi_from_legacy(region_type: str, specs, reference: str = "", columns: tuple[str, ...] = ()) -> Roi:
    """Regions in the old notation: interval (lo, hi), rectangle (corner, width, height, angle), ellipse
    (center, width, height, angle), polygon (points)."""
    make = {"interval": lambda s: regions.Interval(*s), "rectangle": lambda s: regions.Rectangle(tuple(s[0]), *s[1:]), "ellipse": lambda s: regions.Ellipse(tuple(s[0]), *s[1:]), "polygon": lambda s: regions.Polygon(tuple(map(tuple, s)))}
    return Roi(make[region_type](specs), reference, columns)
