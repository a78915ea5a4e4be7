"""Command line: ``python -m cellgrid segment`` and ``python -m cellgrid convert``, also for spark-submit.

Every field of ``Options`` and ``Columns`` is a flag, every output a flag that takes a path.
"""

from __future__ import annotations

import argparse
from dataclasses import MISSING, Field, fields
from typing import Any, get_args, get_type_hints

from cellgrid.options import PRESETS, Columns, Options

OUTPUTS = [
    "spatialdata", "counts", "expected_counts", "cell_metadata", "transcript_metadata", "gene_metadata", "metagene_rates",
    "metagene_loadings", "cell_polygons", "union_cell_polygons", "cell_polygon_layers", "voxel_counts",
]


def _add(parser: argparse._ArgumentGroup, option: Field, kind: Any, prefix: str = "") -> None:
    flag = f"--{prefix}{option.name.replace('_', '-')}"
    base = next((k for k in get_args(kind) if k is not type(None)), kind)
    if base is bool:
        parser.add_argument(flag, dest=prefix + option.name, action="store_const", const=True)  # all are off unless named
    elif getattr(base, "__origin__", None) is tuple:
        parser.add_argument(flag, dest=prefix + option.name, type=float, nargs=len(get_args(base)), default=None)
    else:
        parser.add_argument(flag, dest=prefix + option.name, type=base, default=None, choices=sorted(PRESETS) if option.name == "preset" else None)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cellgrid", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    segment = commands.add_parser("segment", help="segment an input and write outputs")
    segment.add_argument("input")
    segment.add_argument("--kind", choices=["table", "binned", "anndata", "spatialdata"], default="table")
    segment.add_argument("--table", help="table of a spatialdata store")
    segment.add_argument("--overwrite", action="store_true")
    segment.add_argument("--exclude-transcripts", action="store_true", help="leave transcripts out of the store")
    outputs = segment.add_argument_group("outputs")
    for name in OUTPUTS:
        outputs.add_argument(f"--output-{name.replace('_', '-')}", dest=f"output-{name}", metavar="PATH")
    options = segment.add_argument_group("options")
    for f in fields(Options):
        if f.name != "columns":
            _add(options, f, get_type_hints(Options)[f.name])
    columns = segment.add_argument_group("columns of the input")
    for f in fields(Columns):
        _add(columns, f, get_type_hints(Columns)[f.name], "column-")
    convert = commands.add_parser("convert", help="written store to transcript table and geometry collection")
    convert.add_argument("store")
    convert.add_argument("transcripts")
    convert.add_argument("polygons")
    for command in (segment, convert):
        command.add_argument("--master", help="Spark master; left to spark-submit if not given")
    return top


def options_of(args: argparse.Namespace) -> Options:
    """Options from the flags that were given."""
    given = {k: tuple(v) if isinstance(v, list) else v for k, v in vars(args).items() if v is not None}
    columns = Columns(**{f.name: given[f"column-{f.name}"] for f in fields(Columns) if f"column-{f.name}" in given})
    chosen = {f.name: given[f.name] for f in fields(Options) if f.name != "columns" and f.name in given}
    assert all(f.default is not MISSING or f.name == "columns" for f in fields(Options))
    return Options(columns=columns, **chosen)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    from cellgrid.plans.run import convert, run
    from cellgrid.session import make_session

    spark = make_session(args.master) if args.master else SparkSession.builder.appName("cellgrid").getOrCreate()
    if args.command == "convert":
        convert(spark, args.store, args.transcripts, args.polygons)
    else:
        outputs = {name: path for name in OUTPUTS if (path := getattr(args, f"output-{name}"))}
        run(spark, args.input, options_of(args), args.kind, args.table, outputs, args.overwrite, not args.exclude_transcripts)


if __name__ == "__main__":
    main()
