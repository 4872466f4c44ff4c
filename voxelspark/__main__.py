"""``python -m voxelspark COMMAND``: a thin command line over volumes in parquet."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans import prepare
from .sources import volumes


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="voxelspark")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("size_filter", "outlier_filter", "z_filter", "remap"):
        c = sub.add_parser(name)
        c.add_argument("source")
        c.add_argument("target")
        c.add_argument("--options", type=json.loads, default={}, help="JSON of the operator's parameters")
        c.add_argument("--dry_run", action="store_true")
    c = sub.add_parser("merge")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--lut", required=True)
    c = sub.add_parser("segment")
    c.add_argument("source", help="a volume with a column for each affinity channel")
    c.add_argument("target")
    c.add_argument("--method", choices=["ws", "mws", "cc"], action="append", default=[], help="else those that the configuration has parameters of, else ws")
    c.add_argument("--affs", required=True, help="columns, comma-separated")
    c.add_argument("--config", help="a TOML file with tables such as ws_params")
    c.add_argument("--params", type=json.loads, default={}, help="JSON of parameters that override the configuration's")
    c = sub.add_parser("evaluate")
    c.add_argument("gt")
    c.add_argument("target")
    c.add_argument("segmentations", nargs="+")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("voxelspark").getOrCreate()
    if a.command == "evaluate":
        segs = {s: volumes.open_volume(spark, s).withColumnRenamed("value", "seg") for s in a.segmentations}
        volumes.write_results(prepare.evaluate_segmentations(segs, volumes.open_volume(spark, a.gt).withColumnRenamed("value", "gt")), a.target)
        return 0
    df, meta = volumes.open_volume(spark, a.source), volumes.read_meta(spark, a.source)
    if a.command == "segment":
        from .functions import configs
        from .operators.segment import run_method

        config = configs.load(a.config) if a.config else {}
        for m in configs.methods(config, tuple(a.method)):
            volumes.write_volume(run_method(m, df, a.affs.split(","), meta.shape, config, a.params), f"{a.target}/{m}", meta)
        return 0
    if a.command == "merge":
        from .operators.relabel import apply_lut

        out = apply_lut(df, "value", volumes.read_lut(spark, a.lut))
    else:
        out = prepare.refine(df, "value", a.command, a.dry_run, **a.options)
    if getattr(a, "dry_run", False):
        for r in out.orderBy("id").toLocalIterator():
            print(r["id"])
    else:
        volumes.write_volume(out, a.target, meta)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
