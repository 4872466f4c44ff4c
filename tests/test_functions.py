import pytest

from voxelspark.functions import configs, naming
from voxelspark.functions.roi import Coordinate, Roi, block_grid, center_crop, max_padding, sub_roi


def test_roi_arithmetic():
    a, b = Roi((0, 0, 0), (10, 10, 10)), Roi((5, 5, 5), (10, 10, 10))
    assert a.intersect(b) == Roi((5, 5, 5), (5, 5, 5)) and a.union(b) == Roi((0, 0, 0), (15, 15, 15))
    assert a.intersect(Roi((20, 0, 0), (1, 1, 1))).empty
    assert a.grow(1, 2) == Roi((-1, -1, -1), (13, 13, 13)) and a.contains(a) and not a.contains(b)
    assert Roi((3, 3, 3), (5, 5, 5)).snap_to_grid(4) == Roi((0, 0, 0), (8, 8, 8))
    assert Roi((3, 3, 3), (6, 6, 6)).snap_to_grid(4, "shrink") == Roi((4, 4, 4), (4, 4, 4))
    assert Coordinate(1, 2, 3) * 2 + 1 == (3, 5, 7)
    assert center_crop(Roi((0, 0, 0), (10, 11, 12)), (4, 4, 4)).offset == (3, 3, 4)


def test_sub_roi_and_grid():
    total = Roi((40, 8, 8), (400, 400, 400))
    assert sub_roi(total, (40, 4, 4)) == total
    assert sub_roi(total, (40, 4, 4), (2, 0, 0), (100, 5, 5)) == Roi((120, 8, 8), (320, 20, 20))
    blocks = block_grid(Roi((0, 0, 0), (5, 4, 4)), (2, 4, 3))
    assert len(blocks) == 6 and sum(b.shape[0] * b.shape[1] * b.shape[2] for b in blocks) == 80


def test_max_padding():
    # 2-D: no context along the first axis; half the diagonal of 30 x 40 is 25
    assert max_padding((1, 30, 40), (1, 1, 1), 2) == (0, 31, 31)
    assert max_padding((100, 30, 40), (50, 4, 4), 10, "grow") == (50, 52, 52)


def test_names():
    p = {"threshold": 0.5, "sigma": [1, 1, 1], "fragments_in_xy": True, "randomized_strides": False, "bias": None, "merge_function": "mean"}
    assert naming.build_name(p) == "mfmean--t0.5--xy--sig1--rs0"
    assert naming.build_name({"strides": [[1, 2, 2], [2, 2, 2]]}) == "st1.2.2_2"
    assert naming.build_name({"bias": [-0.5, -0.5], "threshold": 0.30000000000000004, "fragments_in_xy": False, "seed_eps": None, "remove_debris": 0}) == "t0.3--xy0--b-0.5--rd0"
    assert naming.default_output("a/b.zarr/seg", "filtered") == "a/b.zarr/seg_filtered"
    with pytest.raises(ValueError):
        naming.default_output("a/b", "x")
    assert naming.is_label_dataset("raw", "uint64") and naming.is_label_dataset("my_mask", "uint8") and not naming.is_label_dataset("raw", "uint8")
    assert naming.latest_checkpoint(["c_9", "c_10", "c_2"]) == "c_10" and naming.pyramid_level("x/s12") == 12 and naming.pyramid_level("s") is None
    assert naming.compatible_chain("3d_affs_from_2d_lsd", "2d_lsd") and not naming.compatible_chain("3d_affs", "2d_lsd")
    assert naming.error_metric("c/3d_lsds") == "lsd"
    assert naming.datasets_under(["s/b", "s/a", "s/a__vs__b", "t"], "s/") == ["s/a", "s/b"]


def test_configs(tmp_path):
    c = configs.round_config("3d_mtlsd", [{"raw_dataset": "v.zarr/raw"}], "v.zarr")
    assert [configs.kind_of(c[k]) for k in ("train", "predict", "segment", "evaluate")] == ["train", "predict", "segment", "evaluate"]
    (tmp_path / "a.toml").write_text(configs.dumps({"a": 1, "none": None, "t": {"x": [1.5, 2.0], "s": 'q"\\'}}))
    assert configs.load(tmp_path / "a.toml") == {"a": 1, "t": {"x": [1.5, 2.0], "s": 'q"\\'}}
    assert configs.resolve("ws", {"ws_params": {"sigma": [1, 1, 1]}}, {"bias": 0.1})["bias"] == 0.1
    assert configs.methods({"cc_params": {}}) == ["cc"] and configs.methods({}) == ["ws"]
    with pytest.raises(ValueError):
        configs.segment_config("a", "c", True, cc_params={})
    chain = list(configs.predict_config(["a", "b"], "raw", "c.zarr", [1, 2]).values())
    assert chain[1]["input"] == "c.zarr/a-1" and chain[1]["chain_str"] == "b-2--from--a-1"
