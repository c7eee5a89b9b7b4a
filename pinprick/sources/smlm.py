"""SMLM archives: a zip of a JSON manifest and tables of packed rows."""

from __future__ import annotations

import io
import json
import zipfile

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog
from .text import convert_property_names, convert_property_types

FORMAT = "smlm-table(binary)-0"
_DTYPES = {"bigint": "<i8", "int": "<i4", "smallint": "<i2", "tinyint": "<i1", "double": "<f8", "float": "<f4"}
_NAMES = {"<i8": "int64", "<i4": "int32", "<i2": "int16", "<i1": "int8", "<f8": "float64", "<f4": "float32"}


def _content(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def manifest_of(df: DataFrame, name: str = "", comment: str = "") -> dict:
    """Manifest of a frame: columns with their types, row count, least and greatest values."""
    r = df.agg(F.count("*").alias("n"), *(f(c).alias(f"{k}_{i}") for i, c in enumerate(df.columns) for k, f in (("lo", F.min), ("hi", F.max)))).first()
    dtypes = [_NAMES[_DTYPES[t]] for _, t in df.dtypes]
    fmt = {"name": FORMAT, "type": "table", "mode": "binary", "columns": len(df.columns), "headers": df.columns, "dtype": dtypes, "shape": [1] * len(dtypes), "units": [""] * len(dtypes)}
    info = {"name": "table-0.bin", "type": "table", "format": FORMAT, "channel": "default", "rows": r["n"], "offset": dict.fromkeys(df.columns, 0)}
    info |= {k: {c: r[f"{q}_{i}"] for i, c in enumerate(df.columns)} for k, q in (("min", "lo"), ("max", "hi"))}
    return {"format_version": "0.2", "formats": {FORMAT: fmt}, "files": [info], "name": name, "description": comment, "tags": ["SMLM"]}


def save_smlm(df: DataFrame, path: str, manifest: dict | None = None) -> None:
    """One local archive; rows stream to the driver, as a single zip file has one writer."""
    dtype = np.dtype([(c, _DTYPES[t]) for c, t in df.dtypes])
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        zf.writestr("manifest.json", json.dumps(manifest or manifest_of(df)))
        with zf.open("table-0.bin", "w", force_zip64=True) as out:
            held = []
            for row in df.toLocalIterator():
                held.append(tuple(row))
                if len(held) == 10_000:
                    out.write(np.array(held, dtype).tobytes())
                    held = []
            out.write(np.array(held, dtype).tobytes())


def load_smlm_manifest(spark: SparkSession, path: str) -> dict:
    with zipfile.ZipFile(io.BytesIO(_content(spark, path))) as zf:
        manifest = json.loads(zf.read("manifest.json"))
    if str(manifest.get("format_version")) != "0.2":
        raise TypeError("only manifest version 0.2 is supported")
    return manifest


def load_smlm_header(spark: SparkSession, path: str) -> list[list[str]]:
    """Column names of each table."""
    m = load_smlm_manifest(spark, path)
    return [convert_property_names(m["formats"][f["format"]]["headers"], catalog.SMLM | catalog.RAPIDSTORM) for f in m["files"] if f["type"] == "table"]


def load_smlm(spark: SparkSession, path: str, *, nrows: int | None = None, convert: bool = True, table: int = 0) -> DataFrame:
    """Rows of one table of an archive, or of every archive the path names; decoded in the executors."""
    first = spark.read.format("binaryFile").load(path).select("path").first()[0]
    manifest = load_smlm_manifest(spark, first)
    info = [f for f in manifest["files"] if f["type"] == "table"][table]
    fmt = manifest["formats"][info["format"]]
    if fmt["mode"] != "binary":
        raise ValueError(f"mode {fmt['mode']} is not supported")
    dtype = np.dtype([(h, np.dtype(d).newbyteorder("<")) for h, d in zip(fmt["headers"], fmt["dtype"], strict=True)])
    names = convert_property_names(fmt["headers"], catalog.SMLM | catalog.RAPIDSTORM)
    kinds = ["double" if np.dtype(d).kind == "f" else "long" for d in fmt["dtype"]]

    def decode(batches):
        import pandas as pd

        for b in batches:
            for content in b["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as zf, zf.open(info["name"]) as f:
                    while raw := f.read(dtype.itemsize * 50_000):
                        rows = np.frombuffer(raw[: len(raw) // dtype.itemsize * dtype.itemsize], dtype)
                        yield pd.DataFrame({n: rows[h].astype("f8" if k == "double" else "i8") for n, h, k in zip(names, fmt["headers"], kinds)})

    df = spark.read.format("binaryFile").load(path).select("content").mapInPandas(decode, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
    df = df.limit(nrows) if nrows is not None else df
    return convert_property_types(df) if convert else df
