"""Command line: ``python -m tablewright compare --left A --right B --on KEY``.

Exit codes: 0 the tables match, 1 they differ, 2 an error, 130 interrupted.
"""

from __future__ import annotations

import argparse
import sys
import traceback
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from pathlib import Path, PurePosixPath
from typing import Any

from pyspark.sql import DataFrame

from . import __version__
from .operators import with_position
from .plans.comparison import Comparison, compare
from .sources import LoadError, load, open_session


class BadArguments(Exception):
    """Arguments that don't go together, or that the library refuses."""


class OutputError(Exception):
    """The report can't be written."""


def _count(text: str) -> int:
    n = int(text)
    if n < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return n


def _delimiter(text: str) -> str:
    text = {"\\t": "\t"}.get(text, text)
    if len(text) != 1:
        raise argparse.ArgumentTypeError("must be one character")
    return text


def _number(text: str) -> float:
    try:
        n = float(text)
    except ValueError:
        raise argparse.ArgumentTypeError(f"{text!r} is not a number") from None
    if not n >= 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return n


def _tolerance(text: str) -> float | tuple[str, float]:
    column, sep, value = text.rpartition("=")
    if sep and not column:
        raise argparse.ArgumentTypeError("the column is missing")
    return (column, _number(value)) if sep else _number(value)


def _names(text: str) -> list[str]:
    names = [x.strip() for x in text.split(",")]
    if not all(names):
        raise argparse.ArgumentTypeError("a column name is empty")
    return names


@dataclass(frozen=True)
class Option:
    """A flag; ``to`` is the option of ``compare`` that it sets, if it sets one."""

    flag: str
    help: str
    to: str | None = None
    parse: dict[str, Any] = field(default_factory=dict)


#: One table for the parser and for the call.
OPTIONS = [
    Option("--left", "file, URI or catalog table of the left side", parse={"required": True}),
    Option("--right", "file, URI or catalog table of the right side", parse={"required": True}),
    Option("--on", "key columns, separated by commas; may be given again", parse={"type": _names, "action": "extend", "default": []}),
    Option("--on-index", "match rows by their place in the order of --order-by", parse={"action": "store_true"}),
    Option("--order-by", "columns that order the rows for --on-index, separated by commas", parse={"type": _names, "action": "extend", "default": []}),
    Option("--backend", "there is one", parse={"choices": ["spark"], "default": "spark"}),
    Option("--input-format", "format of both files; by default from the suffix", parse={"choices": ["csv", "parquet", "json"]}),
    Option("--csv-delimiter", r"one character, or \t", parse={"type": _delimiter, "default": ","}),
    Option("--abs-tol", "absolute tolerance: N, or COLUMN=N, given again for others", parse={"type": _tolerance, "action": "append", "default": []}),
    Option("--rel-tol", "relative tolerance, likewise", parse={"type": _tolerance, "action": "append", "default": []}),
    Option("--ignore-spaces", "trim strings and string keys", "ignore_spaces", {"action": "store_true"}),
    Option("--ignore-case", "compare strings in upper case", "ignore_case", {"action": "store_true"}),
    Option("--cast-column-names-lower", "fold column names", "lower_names", {"action": argparse.BooleanOptionalAction, "default": True}),
    Option("--ignore-extra-columns", "let columns of one side pass", parse={"action": "store_true"}),
    Option("--df1-name", "the left side's name in the report"),
    Option("--df2-name", "the right side's name in the report"),
    Option("--sample-count", "rows of each sample", parse={"type": _count, "default": 10}),
    Option("--column-count", "columns of samples of one side", parse={"type": _count, "default": 10}),
    Option("--max-unequal-rows", "let this many rows differ", parse={"type": _count}),
    Option("--ignore-unique-rows", "don't count rows of one side as differing", parse={"action": "store_true"}),
    Option("--report-format", "what to print", parse={"choices": ["text", "json", "html"], "default": "text"}),
    Option("--output", "write the report to this file too", parse={"type": Path}),
    Option("--quiet", "don't print the report", parse={"action": "store_true"}),
    Option("--spark-app-name", "name of a session that is opened", parse={"default": "tablewright"}),
    Option("--cache-intermediates", "keep matched rows in storage", "cache", {"action": argparse.BooleanOptionalAction, "default": True}),
]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tablewright", description="Compare two tables with Spark.")
    top.add_argument("--version", action="version", version=__version__)
    top.add_argument("--debug", action="store_true", help="show tracebacks")
    commands = top.add_subparsers(dest="command", required=True)
    one = commands.add_parser("compare", help="compare two tables")
    for option in OPTIONS:
        one.add_argument(option.flag, help=option.help, **option.parse)
    return top


def _one_or_each(given: list, flag: str) -> float | dict[str, float]:
    pairs = [x for x in given if isinstance(x, tuple)]
    plain = [x for x in given if not isinstance(x, tuple)]
    if len(plain) > 1 or plain and pairs:
        raise BadArguments(f"{flag} takes one number, or COLUMN=N any number of times")
    return plain[0] if plain else dict(pairs) if pairs else 0.0


def _dataset_names(args: argparse.Namespace) -> tuple[str, str]:
    def short(ref: str) -> str:
        # a catalog name has no suffix that is one of a file's
        return PurePosixPath(ref.rstrip("/")).stem if "/" in ref or "\\" in ref or PurePosixPath(ref).suffix.lower() in (".csv", ".parquet", ".pq", ".json", ".jsonl", ".ndjson") else ref.rsplit(".", 1)[-1]

    a, b = short(args.left), short(args.right)
    if a == b:
        a, b = f"{a}_1", f"{b}_2"
    a, b = args.df1_name or a, args.df2_name or b
    if a == b:
        raise BadArguments(f"both sides are named {a!r}")
    return a, b


def _check(args: argparse.Namespace) -> None:
    if args.on_index and args.on:
        raise BadArguments("--on and --on-index exclude each other")
    if args.on_index != bool(args.order_by):
        raise BadArguments("--on-index and --order-by go together: rows of a Spark table have no place of their own")
    if not args.on and not args.on_index:
        raise BadArguments("one of --on and --on-index is required")
    if args.ignore_unique_rows and args.max_unequal_rows is None:
        raise BadArguments("--ignore-unique-rows needs --max-unequal-rows")


#: The key of rows that are matched by their place.
PLACE = "position"


def _placed(df: DataFrame, order_by: list[str]) -> DataFrame:
    lower = {c.lower() for c in df.columns}
    if unknown := [c for c in order_by if c.lower() not in lower]:
        raise BadArguments(f"there is no column {unknown[0]!r} to order by")
    if PLACE in lower:
        raise BadArguments(f"--on-index needs the column name {PLACE!r} for itself")
    return with_position(df, [f"`{c}`" for c in order_by], PLACE)


def _passed(comparison: Comparison, args: argparse.Namespace) -> bool:
    if args.max_unequal_rows is None:
        return comparison.matches(args.ignore_extra_columns)
    return comparison.within(args.max_unequal_rows, args.ignore_unique_rows, args.ignore_extra_columns)


def _emit(comparison: Comparison, args: argparse.Namespace) -> None:
    if args.quiet and args.output is None:
        return
    data = comparison.report_data(args.sample_count, args.column_count)
    shown: dict[str, Callable[[], str]] = {"text": data.render, "json": data.to_json, "html": data.to_html}
    text = shown[args.report_format]()
    if args.output is not None:
        try:
            args.output.parent.mkdir(parents=True, exist_ok=True)
            args.output.write_text(text, encoding="utf-8")
        except OSError as error:
            raise OutputError(f"cannot write {args.output}: {error}") from error
    if not args.quiet:
        print(text)


def run(args: argparse.Namespace) -> int:
    _check(args)
    names = _dataset_names(args)
    options = {o.to: getattr(args, o.flag[2:].replace("-", "_")) for o in OPTIONS if o.to}
    tolerance = {t: _one_or_each(getattr(args, t), "--" + t.replace("_", "-")) for t in ("abs_tol", "rel_tol")}
    with open_session(args.spark_app_name) as spark:
        left, right = (load(spark, ref, args.input_format, args.csv_delimiter) for ref in (args.left, args.right))
        if args.on_index:
            left, right = (_placed(df, args.order_by) for df in (left, right))
        try:
            comparison = compare(left, right, args.on or [PLACE], left_name=names[0], right_name=names[1], spark=spark, **tolerance, **options)
        except (ValueError, TypeError) as error:
            raise BadArguments(str(error)) from error
        with comparison:
            _emit(comparison, args)
            return 0 if _passed(comparison, args) else 1


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return run(args)
    except KeyboardInterrupt:
        return 130
    except (BadArguments, LoadError, OutputError) as error:
        print(f"tablewright: {error}", file=sys.stderr)
    except Exception as error:  # Spark reports bad data only when a job runs
        print(f"tablewright: {str(error).splitlines()[0] if str(error) else type(error).__name__}", file=sys.stderr)
    if args.debug:
        traceback.print_exc()
    return 2
