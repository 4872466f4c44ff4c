"""Configuration documents: reading TOML, writing it, defaults, and one builder for each step of a round."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping

# Defaults of the segmentation methods.
DEFAULTS = {
    "ws": {
        "fragments_in_xy": True,
        "min_seed_distance": 10,
        "seed_eps": None,
        "epsilon_agglomerate": 0.0,
        "filter_fragments": 0.1,
        "remove_debris": 64,
        "thresholds": [0.2, 0.35, 0.5],
        "merge_function": "mean",
        "sigma": None,
        "noise_eps": None,
        "bias": None,
    },
    "mws": {
        "aff_neighborhood": [[-1, 0, 0], [0, -1, 0], [0, 0, -1], [-2, 0, 0], [0, -9, 0], [0, 0, -9], [-3, 0, 0], [0, -27, 0], [0, 0, -27]],
        "bias": [-0.4, -0.4, -0.4, -0.7, -0.7, -0.7, -0.7, -0.7, -0.7],
        "sigma": None,
        "noise_eps": 0.001,
        "strides": [[1, 1, 1], [1, 1, 1], [1, 1, 1], [2, 9, 9], [2, 9, 9], [2, 9, 9], [3, 27, 27], [3, 27, 27], [3, 27, 27]],
        "randomized_strides": True,
        "filter_fragments": 0.1,
        "remove_debris": 64,
        "min_seed_distance": None,
        "global_bias": [1.0, -0.5],
    },
    "cc": {"threshold": 0.5, "sigma": None, "noise_eps": None, "remove_debris": 64},
}


def load(path: str) -> dict:
    with open(path, "rb") as f:
        return tomllib.load(f)


def _toml(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, str):
        return '"' + v.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    if isinstance(v, list | tuple):
        return "[" + ", ".join(map(_toml, v)) + "]"
    return repr(v)


def dumps(config: Mapping, path: tuple = ()) -> str:
    """TOML of nested tables; None is left out, as TOML has no null."""
    plain = {k: v for k, v in config.items() if v is not None and not isinstance(v, Mapping)}
    lines = [f"[{'.'.join(path)}]"] if path and plain else []
    lines += [f"{k} = {_toml(v)}" for k, v in plain.items()]
    out = "\n".join(lines) + "\n" * bool(lines)
    for k, v in config.items():
        if isinstance(v, Mapping):
            out += dumps(v, (*path, str(k)))
    return out


def resolve(method: str, file: Mapping | None = None, overrides: Mapping | None = None) -> dict:
    """Parameters of a method: defaults, then the file's ``<method>_params``, then overrides."""
    return {**DEFAULTS[method], **((file or {}).get(f"{method}_params") or {}), **(overrides or {})}


def methods(config: Mapping, flags: tuple[str, ...] = ()) -> list[str]:
    """Which methods to run: those flagged, else those with parameters, else ws."""
    return list(flags) or [m for m in DEFAULTS if f"{m}_params" in config] or ["ws"]


def kind_of(config: Mapping) -> str:
    """The step that a document configures, by its keys."""
    if "samples" in config:
        return "train"
    if config and all(isinstance(v, Mapping) and "chain_str" in v for v in config.values()):
        return "predict"
    if "affs_dataset" in config:
        return "segment"
    if {"out_result_dir", "self", "gt"} & set(config):
        return "evaluate"
    raise ValueError("the document configures no step")


def train_config(setup_dir: str, samples: list[dict], max_iterations: int = 30001, save_checkpoints_every: int = 5000, save_snapshots_every: int = 1000, **more) -> dict:
    return {"setup_dir": setup_dir, "samples": samples, "max_iterations": max_iterations, "save_checkpoints_every": save_checkpoints_every, "save_snapshots_every": save_snapshots_every, **more}


def predict_config(setups: list[str], raw: str, container: str, checkpoints: list[int]) -> dict:
    """One table per setup; each reads what the one before it wrote."""
    out, source = {}, raw
    for k, (setup, step) in enumerate(zip(setups, checkpoints)):
        chain = "--from--".join(f"{s}-{c}" for s, c in reversed(list(zip(setups[: k + 1], checkpoints))))
        out[f"{k:02d}-{setup}"] = {"setup_dir": setup, "input": source, "output_container": container, "checkpoint": step, "chain_str": chain}
        source = f"{container}/{chain}"
    return out


def segment_config(affs: str, container: str, blockwise: bool = False, block_shape=None, context=None, **params) -> dict:
    if blockwise and "cc_params" in params and len(params) == 1:
        raise ValueError("connected components are not segmented block by block; use the distributed operator")
    return {"affs_dataset": affs, "fragments_dataset": f"{container}/fragments", "seg_dataset_prefix": f"{container}/segmentations", "lut_dir": f"{container}/luts", "blockwise": blockwise, "block_shape": block_shape, "context": context, **params}


def evaluate_config(out_dir: str, seg_prefix: str, gt: dict | None = None, pred: dict | None = None, mask: str | None = None) -> dict:
    return {"out_result_dir": out_dir, "seg_datasets_prefix": seg_prefix, "mask_dataset": mask, "gt": gt, "pred": pred}


def graph_store(kind: str = "parquet", **options) -> dict:
    """Where a graph lives: a parquet folder, or the options of Spark's JDBC source."""
    if kind == "parquet":
        return {"kind": kind, "path": options["path"]}
    if kind == "sqlite":
        return {"kind": "jdbc", "url": f"jdbc:sqlite:{options['db_file']}", "nodes": options.get("nodes_table", "nodes"), "edges": options.get("edges_table", "edges")}
    if kind == "postgresql":
        url = f"jdbc:postgresql://{options['db_host']}:{options.get('db_port', 5432)}/{options['db_name']}"
        return {"kind": "jdbc", "url": url, "user": options["db_user"], "password": options["db_password"], "nodes": options.get("nodes_table", "nodes"), "edges": options.get("edges_table", "edges")}
    raise ValueError(f"no graph store of kind {kind}")


def round_config(setup: str, samples: list[dict], container: str, checkpoint: int = 10000) -> dict[str, dict]:
    """All documents of one round."""
    predict = predict_config([setup], samples[0]["raw_dataset"], container, [checkpoint])
    affs = f"{container}/{next(iter(predict.values()))['chain_str']}"
    return {"train": train_config(setup, samples), "predict": predict, "segment": segment_config(affs, container), "evaluate": evaluate_config(f"{container}/results", f"{container}/segmentations")}
