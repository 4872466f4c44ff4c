"""Lookup tables, graph stores that several blocks write to, keys out of range, and the command line."""

import numpy as np
import pytest

from voxelspark import __main__ as command
from voxelspark.operators import neighbors
from voxelspark.sources import volumes


def test_luts_in_every_form(spark, tmp_path):
    np.savez(tmp_path / "l.npz", np.array([[1, 2, 3], [1, 1, 3]]))
    (tmp_path / "l.json").write_text('{"merges": {"1": [1, 2], "3": [3]}}')
    volumes.write_lut(spark.createDataFrame([(1, 1), (2, 1), (2, 5), (3, 3)], "fragment long, segment long"), str(tmp_path / "l"))
    for name in ("l.npz", "l.json", "l"):
        assert sorted(map(tuple, volumes.read_lut(spark, str(tmp_path / name)).collect())) == [(1, 1), (2, 1), (3, 3)]


def test_a_graph_that_two_blocks_wrote(spark, tmp_path):
    place = str(tmp_path / "g")
    nodes = spark.createDataFrame([(1, 5), (2, 6)], "id long, size long")
    for edges in ([(1, 2, 0.5)], [(2, 1, 0.25)]):
        volumes.write_graph(nodes, spark.createDataFrame(edges, "u long, v long, score double"), place)
    store = {"kind": "parquet", "path": place}
    assert [tuple(r) for r in volumes.read_graph(spark, store, "edges").collect()] == [(1, 2, 0.25)]
    assert volumes.read_graph(spark, store, "nodes").count() == 2
    assert volumes.read_graph(spark, store, "edges", "score > 0.3").count() == 0


def test_keys_out_of_range_are_an_error(spark):
    df = spark.createDataFrame([(0, 0, 1 << 20)], "z long, y long, x long")
    with pytest.raises(Exception, match="20 bits"):
        df.select(neighbors.voxel_key()).collect()


def test_the_segment_command(spark, tmp_path):
    rows = [(z, y, x, 1.0, 1.0, 1.0) for z in range(2) for y in range(6) for x in range(13) if x != 6]
    df = spark.createDataFrame(rows, "z long, y long, x long, az double, ay double, ax double").withColumn("ax", neighbors.F.when(neighbors.F.col("x").isin(5, 12), 0.0).otherwise(neighbors.F.col("ax")))
    volumes.write_volume(df, str(tmp_path / "v"), volumes.VolumeMeta("v", "float32", (2, 6, 13)))
    assert command.main(["segment", str(tmp_path / "v"), str(tmp_path / "out"), "--method", "cc", "--affs", "az,ay,ax", "--params", '{"remove_debris": 4}']) == 0
    assert volumes.open_volume(spark, str(tmp_path / "out/cc")).select("segment").distinct().count() == 2
