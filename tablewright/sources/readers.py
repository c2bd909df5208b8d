"""Reading a table from a file, a folder, a URI, or the catalog."""

from __future__ import annotations

from pathlib import PurePosixPath

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

# fixed values: suffixes that name a format
#: Formats by suffix. A .tsv file has to be given as csv with its delimiter.
FORMATS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".json": "json", ".jsonl": "json", ".ndjson": "json"}
#: Suffixes of files with one JSON value in each line.
LINES = (".jsonl", ".ndjson")


class LoadError(Exception):
    """A table can't be read."""


def suffix(ref: str) -> str:
    return PurePosixPath(ref.rstrip("/")).suffix.lower()


def infer_format(ref: str, given: str | None = None) -> str:
    """The format of ``ref``: as given, by its suffix, or "table" for a name like db.schema.table."""
    if given:
        return given
    if found := FORMATS.get(suffix(ref)):
        return found
    parts = ref.split(".")
    if len(parts) in (2, 3) and all(p.isidentifier() for p in parts):
        return "table"
    raise LoadError(f"the format of {ref!r} is unknown; give one of csv, parquet, json")


def load(spark: SparkSession, ref: str, fmt: str | None = None, delimiter: str = ",") -> DataFrame:
    """The table at ``ref``; any path or URI that Spark's file systems know. CSV has a header and its
    types are inferred. Reading problems that show at once raise ``LoadError``."""
    kind = infer_format(ref, fmt)
    try:
        if kind == "table":
            return spark.table(ref)
        if kind == "csv":
            return spark.read.csv(ref, header=True, inferSchema=True, sep=delimiter)
        if kind == "parquet":
            return spark.read.parquet(ref)
        if kind == "json":
            return spark.read.json(ref, multiLine=suffix(ref) not in LINES)
    except (PySparkException, Py4JError) as error:
        raise LoadError(f"cannot read {ref}: {str(error).splitlines()[0]}") from error
    raise LoadError(f"unknown format {kind!r}")
