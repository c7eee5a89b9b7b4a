"""All pairs are dealt evenly, whatever the input's files are."""

import numpy as np
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from pinprick.operators import spatial


def _frame(spark, ids, xy):
    return spark.createDataFrame([(i, x, y) for i, (x, y) in zip(ids, xy.tolist())], "index long, position_x double, position_y double").coalesce(1)


def _lengths(a, b):
    x, y = (a[:, None, k] - b[None, :, k] for k in (0, 1))
    return np.sqrt(x * x + y * y)


def _dealt(df):
    return [x["count"] for x in df.groupBy(F.spark_partition_id()).count().collect()]


def test_one_file_gives_many_tasks(spark):
    r, n = np.random.default_rng(5), 1300  # blocks with a rest
    ids, xy = r.permutation(5 * n)[:n], r.normal(size=(n, 2))
    df = spatial.pair_distances(_frame(spark, ids.tolist(), xy))
    got = df.toPandas().sort_values(["id1", "id2"])
    order = np.argsort(ids)
    i, j = np.triu_indices(n, 1)
    assert got.id1.tolist() == ids[order][i].tolist() and got.id2.tolist() == ids[order][j].tolist()
    assert got.pair_distance.tolist() == _lengths(xy[order], xy[order])[i, j].tolist()
    assert list(got.columns) == ["id1", "id2", "pair_distance"] and len(_dealt(df)) >= 4


def test_cross_pairs_from_one_file(spark):
    r = np.random.default_rng(6)
    a, b = r.normal(size=(1100, 2)), r.normal(size=(700, 2))
    df = spatial.pair_distances(_frame(spark, range(1100), a), _frame(spark, range(500, 1200), b))  # ids of both sides meet
    got = df.toPandas().sort_values(["id1", "id2"])
    assert got.id1.tolist() == np.repeat(np.arange(1100), 700).tolist() and got.id2.tolist() == np.tile(np.arange(500, 1200), 1100).tolist()
    assert got.pair_distance.tolist() == _lengths(a, b).ravel().tolist()
    assert len(sizes := _dealt(df)) >= 4 and max(sizes) <= 0.3 * len(got)


def test_few_and_no_points(spark):
    df = spark.createDataFrame([("b", 0.0), ("a", 3.0), ("c", None)], "index string, position_x double")
    rows = lambda x: {tuple(r) for r in x.collect()}
    assert rows(spatial.pair_distances(df)) == {("a", "b", 3.0)}
    assert rows(spatial.pair_distances(df, df)) == {("a", "a", 0.0), ("b", "b", 0.0), ("a", "b", 3.0), ("b", "a", 3.0)}
    none = df.where("index > 'z'")
    assert spatial.pair_distances(none).count() == 0 and spatial.pair_distances(df, none).count() == 0


def test_ids_take_little_of_the_disk(spark, tmp_path):
    r = np.random.default_rng(7)
    a, b = r.normal(size=(300, 2)), r.normal(size=(6001, 2))  # 6,001 ids one after the other never repeat at a whole byte
    spatial.pair_distances(_frame(spark, range(300), a), _frame(spark, range(6001), b)).write.parquet(str(tmp_path / "out"))
    files = [pq.ParquetFile(p).metadata for p in (tmp_path / "out").glob("*.parquet")]
    columns = [m.row_group(g).column(k) for m in files for g in range(m.num_row_groups) for k in range(m.num_columns)]
    assert sum(m.num_rows for m in files) == 300 * 6001
    assert sum(c.total_compressed_size for c in columns if c.path_in_schema != "pair_distance") < 0.5 * 300 * 6001
