import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelspark.functions.roi import Roi
from voxelspark.operators import augment, blocks, evaluate, graphs, kernels, neighbors, objects, relabel, resample, segment, select
from voxelspark.operators.components import connected_components
from voxelspark.sources import volumes


def frame(spark, a, name="value"):
    at = np.nonzero(a)
    rows = [(*map(int, p), v) for *p, v in zip(*at, a[at].tolist())]
    return spark.createDataFrame(rows, f"z long, y long, x long, {name} {'double' if a.dtype.kind == 'f' else 'long'}")


def dense(df, shape, name="value"):
    out = np.zeros(shape, float if dict(df.dtypes)[name] == "double" else int)
    for r in df.collect():
        out[r["z"], r["y"], r["x"]] = r[name]
    return out


def cube(n, *parts):
    a = np.zeros((n, n, n), int)
    for value, s in parts:
        a[tuple(slice(*p) for p in s)] = value
    return a


SIZES = cube(30, (1, ((0, 1), (0, 9), (0, 10))), (2, ((15, 20),) * 3), (3, ((25, 26),) * 3))
OUTLIERS = cube(30, (1, ((0, 6), (0, 15), (0, 15))), (2, ((15, 16), (15, 25), (15, 25))), (3, ((26, 27), (26, 29), (26, 29))), (4, ((0, 1),) * 3))


@pytest.mark.parametrize("padding", [0, 1])
def test_bbox_crop(spark, padding):
    df = select.crop_to_foreground(frame(spark, cube(10, (1, ((2, 8),) * 3))), "value", padding)
    r = df.agg(F.min("z"), F.max("z"), F.first("off_z")).first()
    assert tuple(r) == (padding, 5 + padding, 2 - padding)
    assert tuple(select.bounding_box(frame(spark, cube(10, (1, ((2, 8),) * 3))), "value").first())[:2] == (2, 7)


def test_size_outlier_and_z_filters(spark):
    left = lambda df: sorted(r[0] for r in df.where("value <> 0").select("value").distinct().collect())
    assert left(objects.size_filter(frame(spark, SIZES), "value", 100)) == [2]
    assert left(objects.z_filter(frame(spark, SIZES), "value", 1)) == [2]
    assert left(objects.outlier_filter(frame(spark, OUTLIERS), "value", 1)) == [2, 3, 4]
    m = objects.size_moments(objects.sizes(frame(spark, OUTLIERS), "value")).first()
    assert m["mean"] == 364.75 and abs(m["std"] - 569.59) < 0.01


def test_graph_fixtures(spark):
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id long")
    edges = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.4), (3, 4, None)], "u long, v long, score double")
    at = lambda t: {r[0]: r[1] for r in graphs.components_at(nodes, edges, t).collect()}
    assert at(0.2) == {1: 1, 2: 1, 3: 3, 4: 4} and at(0.5) == {1: 1, 2: 1, 3: 1, 4: 4}
    sweep = {(r[0], r[1]): r[2] for r in graphs.threshold_sweep(nodes, edges, [0.5, 0.2]).collect()}
    assert sweep[0.2, 3] == 3 and sweep[0.5, 3] == 1 and len(sweep) == 8
    hist = spark.createDataFrame([(0, 1, 2, 1, 0.1), (1, 1, 3, 1, 0.4)], "step long, a long, b long, c long, score double")
    pairs = spark.createDataFrame([(2, 3), (1, 2), (1, 9), (5, 5)], "u long, v long")
    assert {(r[0], r[1]): r[2] for r in graphs.join_scores(pairs, hist).collect()} == {(2, 3): 0.4, (1, 2): 0.1, (1, 9): None, (5, 5): 0.0}


def test_long_path_and_empty_components(spark):
    path = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r[0] for r in connected_components(path).select("component").distinct().collect()} == {0}
    assert connected_components(path.limit(0)).count() == 0
    odd = spark.createDataFrame([(3, 3), (2, 1), (1, 2), (None, 4)], "u long, v long")
    assert sorted(map(tuple, connected_components(odd).collect())) == [(1, 1), (2, 1)]


def test_lut_and_remap(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,), (3,), (9,)], "value long")
    lut = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "fragment long, segment long")
    assert sorted(r[0] for r in relabel.apply_lut(df, "value", lut).collect()) == [1, 1, 3, 9]
    with pytest.raises(ValueError):
        relabel.manual_remap(df, "value", [1], [[1, 2]])
    (tmp_path / "m.json").write_text(json.dumps({"merges": {"7": [1, 2]}}))
    got = relabel.apply_lut(df, "value", volumes.read_lut_json(spark, str(tmp_path / "m.json")))
    assert sorted(r[0] for r in got.collect()) == [3, 7, 7, 9]
    assert sorted(r[0] for r in relabel.compact_ids(df, "value").collect()) == [1, 2, 3, 4]


def test_voi_by_hand(spark):
    df = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 2)], "gt long, seg long")
    m = evaluate.rand_voi(df, "gt", "seg").first()
    # joint entropy 1.5, H(gt) = 1, H(seg) = 0.811278
    assert abs(m["voi_split"] - 0.5) < 1e-6 and abs(m["voi_merge"] - 0.688722) < 1e-6
    again = evaluate.rand_voi(df.withColumn("gt", F.col("gt") * 5), "gt", "seg").first()
    assert abs(again["voi_sum"] - m["voi_sum"]) < 1e-12
    assert evaluate.rand_voi(df.limit(0), "gt", "seg").count() == 0


def test_skeleton_runs(spark):
    nodes = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (2, 1, 0.0, 0.0, 1.0), (3, 1, 0.0, 0.0, 2.0)], "node long, skel long, z double, y double, x double")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")
    labels = spark.createDataFrame([(1, 5), (2, 5), (3, 6)], "node long, segment long")
    r = evaluate.expected_run_length(nodes, edges, labels).first()
    assert (r["erl"], r["perfect_erl"], r["nerl"], r["total_length"]) == (0.5, 2.0, 0.25, 2.0)
    assert tuple(evaluate.merge_split_stats(nodes, labels).first()) == (0, 0, 1, 2, 1)


def test_blocks_do_not_show(spark):
    a = np.random.default_rng(3).integers(0, 3, (9, 10, 11))
    want = {op: kernels.morph(a, op, 2) for op in ("dilate", "erode", "opening", "closing")}
    for op, w in want.items():
        for block in ((4, 5, 6), (9, 10, 11)):
            assert (dense(blocks.morph(frame(spark, a), "value", a.shape, op, 2, block=block), a.shape) == w).all(), (op, block)
    with pytest.raises(ValueError):
        blocks.BlockOp(lambda x: x, ("value",), (4, 4, 4), (1, 1, 1), (2, 2, 2))
    f = np.random.default_rng(4).random((4, 9, 9))
    got = dense(blocks.smooth(frame(spark, f), "value", f.shape, (0, 1.0, 1.0), (2, 5, 5)), f.shape)
    assert np.allclose(got[:, 4, 4], kernels.gaussian(f, [0, 1.0, 1.0])[:, 4, 4])


def test_relational_matches_kernels(spark):
    a = np.random.default_rng(5).integers(0, 3, (4, 6, 7))
    got = dense(graphs.voxel_components(frame(spark, a), "value"), a.shape, "component")
    want, n = kernels.components(a)
    assert len(set(zip(got[a > 0].tolist(), want[a > 0].tolist()))) == n == len(set(got[a > 0].tolist()))
    f = np.random.default_rng(6).random((3, 6, 7)) + 0.1
    mx = dense(neighbors.maximum_filter(frame(spark, f), "value", 4), f.shape, "max_value")
    assert np.allclose(mx, kernels.box_max(f, 4))
    lab = np.zeros((1, 7, 7), int)
    lab[0, 1, 1], lab[0, 5, 5] = 2, 1
    every = spark.createDataFrame([(0, y, x, int(lab[0, y, x])) for y in range(7) for x in range(7)], "z long, y long, x long, value long")
    got = dense(neighbors.expand_labels(every, "value", 3), lab.shape, "expanded")
    d, at = kernels.edt(lab[0] == 0, nearest=True)
    near = np.where(d <= 3, lab[0].ravel()[at], 0)
    tie = [(y, x) for y in range(7) for x in range(7) if (y - 1) ** 2 + (x - 1) ** 2 == (y - 5) ** 2 + (x - 5) ** 2]
    for y in range(7):
        for x in range(7):
            if (y, x) not in tie:
                assert got[0, y, x] == near[y, x]


def test_resample_round_trip(spark):
    a = np.random.default_rng(7).integers(1, 9, (4, 4, 4))
    up = resample.upsample_labels(frame(spark, a), (2, 2, 2))
    assert up.count() == 512
    assert (dense(resample.downsample_labels(up, (2, 2, 2)), a.shape) == a).all()
    assert np.allclose(dense(resample.downsample_mean(frame(spark, a.astype(float)), "value", (2, 2, 2)), (2, 2, 2)), a.reshape(2, 2, 2, 2, 2, 2).mean((1, 3, 5)))


def test_volume_store(spark, tmp_path):
    a = cube(10, (5, ((2, 8),) * 3))
    meta = volumes.VolumeMeta("labels", "uint64", (10, 10, 10), voxel_size=(40, 4, 4), params={"sigma": [1, 2]})
    volumes.write_volume(frame(spark, a), str(tmp_path / "v"), meta, 4)
    back = volumes.read_meta(spark, str(tmp_path / "v"))
    assert back.roi == Roi((0, 0, 0), (400, 40, 40)) and back.offset == (0, 0, 0) and back.params == {"sigma": [1, 2]}
    assert (dense(volumes.open_volume(spark, str(tmp_path / "v")), a.shape) == a).all()
    roi = Roi((0, 3, 3), (4, 2, 2))
    box = volumes.open_volume(spark, str(tmp_path / "v"), roi, 4)
    assert box.count() == 8
    full = select.roi_scan(box, roi, ["value"])
    assert full.count() == 16 and full.where("value = 0").count() == 8
    volumes.write_pyramid_level(box, str(tmp_path / "p"), 0)
    with pytest.raises(Exception):
        volumes.write_pyramid_level(box, str(tmp_path / "p"), 0)
    assert volumes.read_pyramid(spark, str(tmp_path / "p"), ["s0", "other"]).where("level = 0").count() == 8
    assert volumes.snapshot(frame(spark, np.full((1, 1, 2), -1.0)), str(tmp_path / "snap"), 10, 10, ["value"]) and not volumes.snapshot(box, "x", 3, 10, [])
    assert spark.read.parquet(str(tmp_path / "snap")).agg(F.max("value")).first()[0] == 0


def test_graph_store_and_graphml(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 3)], "id long, z double, y double, x double, size long")
    edges = spark.createDataFrame([(2, 1, 0.3), (1, 2, 0.2)], "u long, v long, score double")
    volumes.write_graph(nodes, edges, str(tmp_path / "g"))
    assert tuple(volumes.read_graph(spark, {"kind": "parquet", "path": str(tmp_path / "g")}, "edges", "score < 1").first()) == (1, 2, 0.2)
    body = "".join(f'<node id="{i}"><data key="a">{z}</data><data key="b">1</data><data key="c">1</data><data key="d">7</data></node>' for i, z in ((1, 1.0), (2, 2.0), (3, 99.0)))
    (tmp_path / "s.graphml").write_text(
        '<graphml><key id="a" attr.name="position_z"/><key id="b" attr.name="position_y"/><key id="c" attr.name="position_x"/><key id="d" attr.name="id"/>'
        f'<graph>{body}<node id="4"><data key="a">1</data></node><edge source="1" target="2"/><edge source="2" target="3"/></graph></graphml>'
    )
    n, e = volumes.read_graphml(spark, str(tmp_path / "s.graphml"), Roi((0, 0, 0), (10, 10, 10)))
    assert sorted(r["node"] for r in n.collect()) == [1, 2] and list(map(tuple, e.collect())) == [(1, 2)]


def test_images(spark, tmp_path):
    import struct
    import zlib

    def png(path, a):
        raw = b"".join(b"\0" + bytes(r) for r in a.tolist())
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
        path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))

    a = np.random.default_rng(42).integers(0, 256, (3, 4, 5), np.uint8)
    for z in range(3):
        png(tmp_path / f"{z}.png", a[z])
    assert (dense(volumes.image_stack(spark, str(tmp_path)), a.shape) == a).all()


def test_pipelines_on_two_boxes(spark):
    affs = np.zeros((3, 4, 8, 17))
    affs[:, :, :, :8] = 1.0
    affs[:, :, :, 9:] = 1.0
    names = ["az", "ay", "ax"]
    rows = [(int(z), int(y), int(x), *map(float, affs[:, z, y, x])) for z, y, x in np.ndindex(*affs.shape[1:]) if affs[:, z, y, x].any()]
    df = spark.createDataFrame(rows, "z long, y long, x long, az double, ay double, ax double")
    ws = segment.watershed(df, names, affs.shape[1:], (0.5,), min_seed_distance=9, block=(2, 8, 17), context=(0, 0, 0), remove_debris=0)
    side = ws["segmentation"].withColumn("right", F.col("x") > 8).select("right", "segment").distinct().collect()
    assert len(side) == 2 and len({r["segment"] for r in side}) == 2
    mws = segment.mutex(df, names, affs.shape[1:], [(-1, 0, 0), (0, -1, 0), (0, 0, -1)], [-0.5] * 3, block=(2, 8, 17), context=(0, 0, 0), noise_eps=None)
    side = mws["segmentation"].withColumn("right", F.col("x") > 8).select("right", "segment").distinct().collect()
    assert len(side) == 2 and len({r["segment"] for r in side}) == 2
    cc = segment.threshold_components(df, names, threshold=0.5, remove_debris=4)
    assert cc.select("component").distinct().count() == 2
    with pytest.raises(ValueError):
        segment.mutex(df, names, affs.shape[1:], [(-1, 0, 0)], [0.1, 0.2])
    # every method takes all that its configuration holds
    shape, more = affs.shape[1:], {"block": (4, 8, 17)}
    two = lambda d: len({r["segment"] for r in d.where("x < 8 or x > 8").select("segment").distinct().collect()})
    assert two(segment.run_method("ws", df, names, shape, {"ws_params": {"thresholds": [0.5], "sigma": 0.1}}, **more)) == 2
    assert two(segment.run_method("cc", df, names, shape, None, {"sigma": 0.1}, **more)) == 2
    both = df.withColumns({f"l{k}": F.col(names[k % 3]) if k % 3 < 2 else F.lit(0.0) for k in range(6)})
    assert two(segment.run_method("mws", both, [*names, *[f"l{k}" for k in range(6)]], shape, None, {"noise_eps": None, "strides": None}, **more)) == 2


def test_augment(spark):
    df = spark.createDataFrame([(z, y, x, (y * 4 + x) / 16) for z in range(2) for y in range(4) for x in range(4)], "z long, y long, x long, value double")
    g = augment.gamma(df, "value", exponent=1.0)
    assert np.allclose(sorted(r["value"] for r in g.collect()), sorted(r["value"] for r in df.collect()))
    a, b = (augment.impulse_noise(d, "value", 0.5, 3) for d in (df, df.repartition(7)))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert augment.zero_out(df, "value", 0, sections=[1]).where("z = 1 and value <> 0").count() == 0
    art = spark.createDataFrame([(0, 0, 0.5, 1.0)], "y long, x long, alpha double, artifact double")
    assert augment.blend_artifact(df, "value", art).where("y = 0 and x = 0 and value = 0.5").count() == 2
    lab = augment.synthetic_labels(spark, (4, 20, 20), 6, 1, side=5)
    pts = {r["label"] for r in lab.select("label").distinct().collect()}
    assert lab.count() == 1600 and pts <= set(range(1, 7))
    assert augment.shift_sections(df, 2, 1).count() == 32 and augment.deform_sections(df, "value", 1.0).count() > 0
    assert augment.obfuscate_split(df.withColumn("l", F.lit(3)), "l", 1.1, 100).select("l").distinct().count() == 2
    assert augment.intensity(df, "value", (1, 1), (0, 0)).count() == 32
    assert [r.offset for r in augment.random_locations(Roi((0, 0, 0), (9, 9, 9)), (3, 3, 3), 2)] == [r.offset for r in augment.random_locations(Roi((0, 0, 0), (9, 9, 9)), (3, 3, 3), 2)]
