"""Commands: smoke-test, evaluate, build-index, query, train, info."""

from __future__ import annotations

import argparse
import json
import sys

from prismlake import __version__, runtime
from prismlake.operators import evaluation, heads
from prismlake.plans import engine as plans
from prismlake.sources.readers import query_image
from prismlake.sources.store import Config


def _config(path: str | None) -> Config:
    if not path:
        return Config.from_dict({"data": {"name": "synthetic"}})
    with open(path) as f:
        return Config.from_yaml(f.read())


def smoke_test(args, spark) -> int:
    on = plans.run_evaluation(spark, Config.from_dict({"data": {"name": "synthetic"}}))
    off = plans.run_evaluation(spark, Config.from_dict({"data": {"name": "synthetic"}, "whitening": {"enabled": False}}))
    print(on["report"])
    cross = {k: r["headline"].where("kind = 'cross'").first()["mean_f1_at_10"] for k, r in (("on", on), ("off", off))}
    ok = evaluation.passes(cross["on"], 0.1, cross["off"])
    print(f"cross-modal F1@10: {cross['on']:.4f} whitened, {cross['off']:.4f} not: {'PASS' if ok else 'FAIL'}")
    return 0 if ok else 1


def evaluate(args, spark) -> int:
    out = plans.run_evaluation(spark, _config(args.config))
    print(out["report"] if not args.json else json.dumps({"cells": [r.asDict() for r in out["cells"].collect()], "headline": [r.asDict() for r in out["headline"].collect()], "provenance": out["provenance"]}))
    return 0


def build_index(args, spark) -> int:
    e = plans.build_index(spark, _config(args.config), args.out)
    print(json.dumps({"rows": e.gallery.count(), "strategy": e.strategy}))
    return 0


def query(args, spark) -> int:
    e = plans.open_index(spark, args.index)
    with open(args.image, "rb") as f:
        x = query_image(f.read(), args.image)
    row = {"query_id": 0, "id": "query", "modality": args.modality, "location_id": None, "image": {"c": x.shape[0], "h": x.shape[1], "w": x.shape[2], "data": x.ravel().tolist()}}
    q = spark.createDataFrame([row], "query_id long, id string, modality string, location_id string, image struct<c:int,h:int,w:int,data:array<float>>")
    for hit in e.query(q, args.k, gallery_modality=args.gallery_modality).orderBy("rank").collect():
        print(json.dumps(hit.asDict()))
    return 0


def train(args, spark) -> int:
    samples, provenance = plans.load_samples(spark, _config(args.config))
    model = heads.train_heads(samples, steps=args.steps)
    with open(args.out, "w") as f:
        json.dump(model.to_dict(), f)
    print(json.dumps(provenance))
    return 0


def info(args, spark) -> int:
    print(json.dumps({"version": __version__, "spark": spark.version, "extractors": sorted(heads.EXTRACTORS), "config": Config().to_dict()}))
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="prismlake")
    sub = top.add_subparsers(required=True)

    def command(name: str, run, *options: tuple) -> None:
        p = sub.add_parser(name)
        for flag, kw in options:
            p.add_argument(flag, **kw)
        p.set_defaults(run=run)

    config = ("--config", {"default": None})
    command("smoke-test", smoke_test)
    command("evaluate", evaluate, config, ("--json", {"action": "store_true"}))
    command("build-index", build_index, config, ("--out", {"required": True}))
    command("query", query, ("--index", {"required": True}), ("--image", {"required": True}), ("--modality", {"default": "optical_rgb"}), ("--gallery-modality", {"default": None}), ("-k", {"type": int, "default": 10}))
    command("train", train, config, ("--out", {"required": True}), ("--steps", {"type": int, "default": 200}))
    command("info", info)
    args = top.parse_args(argv)
    return args.run(args, runtime.build_session("prismlake-cli"))


if __name__ == "__main__":
    sys.exit(main())
