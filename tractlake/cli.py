"""Command line: convert, info, concatenate, manipulate-dtype, compare, update-affine, validate, copy-metadata, subset."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tractlake.errors import ArgumentError, FormatError
from tractlake.operators import checks, concat, metadata, subset
from tractlake.operators.cast import cast_positions
from tractlake.sources import files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tractlake")
    sub = top.add_subparsers(dest="command", required=True)

    def add(name: str, *places: str, **options):
        p = sub.add_parser(name)
        for place in places:
            p.add_argument(place, **({"nargs": "+"} if place == "inputs" else {}))
        for o, kind in options.items():
            flag = "--" + o.replace("_", "-")
            if kind is bool:
                p.add_argument(flag, action="store_true")
            elif kind is list:
                p.add_argument(flag, nargs="*", default=None)
            else:
                p.add_argument(flag, type=kind, default=None)
        return p

    add("convert", "input", "output", reference=str, positions_dtype=str, vtk_space=str)
    add("info", "input", stats=bool)
    add("concatenate", "inputs", output=str, reference=str, group_names=list, delete_dps=bool, delete_dpv=bool, delete_groups=bool, positions_dtype=str)
    add("manipulate-dtype", "input", "output", positions_dtype=str)
    add("compare", "left", "right", deep=bool)
    add("update-affine", "input", "reference", "output")
    add("validate", "input", output=str, remove_invalid=bool, remove_identical=bool)
    add("copy-metadata", "donor", "target", output=str, dps=list, dpv=list, groups=list, dpg=bool, overwrite=bool)
    add("subset", "input", "output", group=list, num_streamlines=int, seed=int, export_groups=str)
    return top


def run(spark: SparkSession, argv: list[str]) -> int:
    """Run a command; 0 if all is well, 1 if not (a message goes to standard error)."""
    a = parser().parse_args(argv)
    try:
        return COMMANDS[a.command](spark, a)
    except (ArgumentError, FormatError, FileNotFoundError, KeyError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _header(path: str | None):
    return files.reference_header(path) if path else None


def convert(spark, a) -> int:
    source = files.load(spark, a.input, files.Options(_header(a.reference), vtk_space=a.vtk_space or "ras"))
    files.write_tractogram(source, a.output, files.Options(_header(a.reference), a.positions_dtype or source.dtype))
    return 0


def info(spark, a) -> int:
    t = files.load(spark, a.input)
    for k, v in checks.summary(t).first().asDict().items():
        print(f"{k}: {v}")
    if a.stats:
        row = checks.length_stats(t).first()
        for k, v in zip(("min", "mean", "max"), row, strict=True):
            print(f"length {k}: " + ("N/A" if v is None else f"{v:.4f}"))
    return 0


def concatenate(spark, a) -> int:
    if len(a.inputs) < 2:
        raise ArgumentError("at least two inputs are needed")
    if not a.output:
        raise ArgumentError("--output is needed")
    if files.detect_format(a.output) != "trx":
        raise ArgumentError("the output must be a container (.trx)")
    header, inputs = _header(a.reference), []
    for path in a.inputs:
        if files.detect_format(path) in ("tck", "vtk") and header is None:
            raise ArgumentError(f"{path} needs --reference")
        inputs.append(files.load(spark, path, files.Options(header)))
    out = concat.concatenate(inputs, a.group_names, a.positions_dtype, a.delete_dps, a.delete_dpv, a.delete_groups)
    files.write_tractogram(out, a.output, files.Options(dtype=out.dtype))
    return 0


def manipulate_dtype(spark, a) -> int:
    out = cast_positions(files.load(spark, a.input), a.positions_dtype or "float32")
    files.write_tractogram(out, a.output, files.Options(dtype=out.dtype))
    return 0


def compare(spark, a) -> int:
    rows = checks.compare(files.load(spark, a.left), files.load(spark, a.right), a.deep).collect()
    for r in rows:
        print(f"{r['what']}: {'same' if r['same'] else 'different: ' + r['left'] + ' / ' + r['right']}")
    return 0 if all(r["same"] for r in rows) else 1


def update_affine(spark, a) -> int:
    out = checks.update_affine(files.load(spark, a.input), files.reference_header(a.reference))
    files.write_tractogram(out, a.output, files.Options(dtype=out.dtype))
    return 0


def validate(spark, a) -> int:
    both = not (a.remove_invalid or a.remove_identical)
    out, counts = checks.validate(files.load(spark, a.input), a.remove_invalid or both, a.remove_identical or both)
    for k, v in counts.first().asDict().items():
        print(f"{k}: {v}")
    if a.output:
        files.write_tractogram(out, a.output, files.Options(dtype=out.dtype))
    return 0


def copy_metadata(spark, a) -> int:
    chosen = metadata.Selection(a.dps, a.dpv, a.groups)
    out = metadata.copy_metadata(files.load(spark, a.target), files.load(spark, a.donor), chosen, a.dpg, a.overwrite)
    if a.output:
        files.write_tractogram(out, a.output, files.Options(dtype=out.dtype))
    else:
        files.save_in_place(out, a.target)
    return 0


def take(spark, a) -> int:
    t = files.load(spark, a.input)
    if a.export_groups:
        save = lambda part, path: files.write_tractogram(part, path, files.Options(dtype=part.dtype))
        if not subset.export_groups(t, a.export_groups, a.group, save):
            print("warning: no group was exported", file=sys.stderr)
        return 0
    out = subset.take(t, a.group, a.num_streamlines, a.seed)
    files.write_tractogram(out, a.output, files.Options(dtype=out.dtype))
    return 0


COMMANDS = {"convert": convert, "info": info, "concatenate": concatenate, "manipulate-dtype": manipulate_dtype, "compare": compare, "update-affine": update_affine, "validate": validate, "copy-metadata": copy_metadata, "subset": take}


def main() -> None:
    spark = SparkSession.builder.appName("tractlake").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sys.exit(run(spark, sys.argv[1:]))


if __name__ == "__main__":
    main()
