"""Command line: detect manoeuvres, build and verify the labelled dataset, list the models. Errors go to stderr with exit status 1, wrong usage 2."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from datetime import UTC, datetime

from .registry import available_models, detect, register_bundle
from .sources.catalogue import VERSION
from .sources.catalogue_source import CATALOGUES
from .sources.documents import iso

COLUMNS = ("epoch", "norad_id", "type", "confidence", "delta_v_estimate")


def render(rows: list[dict], kind: str) -> str:
    if kind == "json":
        return json.dumps(rows, indent=2) + "\n"
    lines = [[("" if r[c] is None else f"{r[c]:.6g}" if isinstance(r[c], float) else str(r[c])) for c in COLUMNS] for r in rows]
    if kind == "csv":
        return "".join(",".join(x) + "\n" for x in [list(COLUMNS), *lines])
    wide = [max(len(x[i]) for x in [list(COLUMNS), *lines]) for i in range(len(COLUMNS))]
    return "".join("  ".join(v.ljust(w) for v, w in zip(x, wide, strict=True)).rstrip() + "\n" for x in [list(COLUMNS), *lines])


def moment(text: str) -> int:
    """Microseconds since 1970 of an ISO date or time (UTC where it names no zone), or such a number itself."""
    if text.lstrip("-").isdigit() and len(text) > 8:
        return int(text)
    at = datetime.fromisoformat(text)
    at = at.replace(tzinfo=UTC) if at.tzinfo is None else at
    return (at - datetime(1970, 1, 1, tzinfo=UTC)) // (datetime.resolution)


def _bounded(elsets, args):
    from pyspark.sql import functions as F

    for bound, keep in ((args.start, lambda b: F.col("t") >= b), (args.end, lambda b: F.col("t") <= b)):
        elsets = elsets if bound is None else elsets.where(keep(bound))  # of a catalogue: in the requests
    return elsets


def _detect(spark, args) -> str:
    from pyspark.sql import functions as F

    from .operators.evaluate import reconstruct
    from .sources import catalogue_source, omm, tle

    if args.source in CATALOGUES:
        options = {"objects": args.path} | ({"path": args.landed} if args.landed else {})
        elsets = catalogue_source.elsets(_bounded(catalogue_source.read(spark, args.source, **options), args))
    else:
        elsets = tle.parse(tle.read_files(spark, args.path)) if args.source == "tle" else omm.read(spark, args.path)
    series = reconstruct(_bounded(elsets, args)).select("norad_id", "t", F.col("semi_major_axis").alias("a"), F.col("eccentricity").alias("e"), F.col("inclination").alias("inc"), "raan", F.col("arg_perigee").alias("argp"))
    if args.bundle:
        register_bundle(args.model, args.bundle)
    found = detect(series, args.model).orderBy("norad_id", "epoch_ns").collect()
    return render([{"epoch": iso(r["epoch_ns"] // 1000), **{c: r[c] for c in COLUMNS[1:]}} for r in found], args.format)


def _dataset(spark, args) -> str:
    """Element sets of the recipe's objects from their catalogue, labels from landed notices: a folder a source below args.notices."""
    from pathlib import Path

    from pyspark.sql import functions as F

    from .operators import dataset, labels
    from .sources import catalogue, catalogue_source, documents, landed

    entries = documents.read_recipe(spark, args.recipe) if args.recipe else catalogue.recipe(spark)
    objects = ",".join(str(r["norad_id"]) for r in entries.select("norad_id").collect())
    elsets = catalogue_source.elsets(catalogue_source.read(spark, args.source, objects=objects, **({"path": args.landed} if args.landed else {})))
    stem = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    notices = {x.name: landed.files(spark, str(x)).withColumn("code", stem) for x in Path(args.notices).iterdir() if x.is_dir()} if args.notices else {}
    announced = landed.all_labels(notices) if notices else spark.createDataFrame([], ", ".join(f"{c} {t}" for c, t in landed.LABELS.items()))
    if args.action == "verify":
        rows = dataset.verify(args.manifest, dataset.rebuild(entries, elsets, announced, args.version)).collect()
        if rows:
            raise ValueError("; ".join(r["problem"] if r["norad_id"] is None else f"object {r['norad_id']}: {r['problem']}" for r in rows))
        return "the dataset is that of the manifest\n"
    report = dataset.build(entries, elsets, announced, args.version, args.out)
    lines = [r["line"] for r in labels.coverage_lines(report.coverage).orderBy("place").collect()]
    return "\n".join([f"{report.n_objects} objects in {args.out}", *lines]) + "\n"


def _models(spark, args) -> str:
    return "\n".join(available_models()) + "\n"


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="elsetspark")
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("detect", help="detect manoeuvres in files of two-line elements or JSON messages, or in a catalogue's elements")
    run.add_argument("path", help="a file; with a catalogue as the source, catalogue numbers joined by commas")
    run.add_argument("--model", default="classical", choices=available_models())
    run.add_argument("--bundle", help="folder of a trained model, for a model that waits for its scorer")
    run.add_argument("--source", default="tle", choices=("tle", "omm", *sorted(CATALOGUES)))
    run.add_argument("--landed", help="folder of landed answers of the catalogue, in place of requests")
    run.add_argument("--format", default="table", choices=("table", "csv", "json"))
    run.add_argument("--start", type=moment, help="first epoch: an ISO date or time, or microseconds since 1970")
    run.add_argument("--end", type=moment)
    run.add_argument("--output")
    run.set_defaults(act=_detect)
    sub.add_parser("models", help="names that detect takes").set_defaults(act=_models, output=None)
    data = sub.add_parser("dataset", help="the labelled dataset of a recipe").add_subparsers(dest="action", required=True)
    for action, text in (("build", "write recipe.json, labels.json and manifest.json"), ("verify", "rebuild the dataset and compare it with a manifest")):
        one = data.add_parser(action, help=text)
        one.add_argument("--recipe", help="a recipe document; else the pinned one")
        one.add_argument("--version", default=VERSION)
        one.add_argument("--source", default="spacetrack", choices=sorted(CATALOGUES))
        one.add_argument("--landed", help="folder of landed answers of the catalogue, in place of requests")
        one.add_argument("--notices", help="folder of landed notices, with a folder a source of labels")
        if action == "build":
            one.add_argument("--out", required=True)
        else:
            one.add_argument("manifest")
        one.set_defaults(act=_dataset, output=None)
    args = parser.parse_args(argv)
    act: Callable = args.act
    try:
        spark = None
        if act is not _models:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.getOrCreate()
        text = act(spark, args)
    except Exception as error:  # one line for the user
        print(f"error: {str(error).splitlines()[0]}", file=sys.stderr)
        return 1
    if args.output:
        with open(args.output, "w", newline="") as out:
            out.write(text)
    else:
        sys.stdout.write(text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
