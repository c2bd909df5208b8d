"""The report of a comparison: a frozen model, and its text, HTML and JSON."""

from __future__ import annotations

import html
import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from pathlib import Path
from typing import TYPE_CHECKING, Any

import pandas

if TYPE_CHECKING:
    from pyspark.sql import DataFrame

    from .plans.comparison import Comparison


# fixed values: the members' names are the keys of the JSON report, and the titles and labels of
# _text are those of the text report; both are formats that others read


@dataclass(frozen=True)
class ColumnCounts:
    common_columns: int
    df1_unique: int
    df1_unique_columns: tuple[str, ...]
    df2_unique: int
    df2_unique_columns: tuple[str, ...]
    df1_name: str
    df2_name: str


@dataclass(frozen=True)
class RowFacts:
    match_columns: tuple[str, ...]
    on_index: bool
    has_duplicates: bool
    abs_tol: Any
    rel_tol: Any
    common_rows: int
    df1_unique: int
    df2_unique: int
    unequal_rows: int
    equal_rows: int
    df1_name: str
    df2_name: str


@dataclass(frozen=True)
class ColumnTotals:
    unequal_columns: int
    equal_columns: int
    unequal_values: int


@dataclass(frozen=True)
class UnequalColumn:
    column: str
    dtype1: str
    dtype2: str
    unequal_cnt: int
    max_diff: float
    null_diff: int
    rel_tol: float
    abs_tol: float


@dataclass(frozen=True)
class UnequalColumns:
    has_mismatches: bool
    has_samples: bool
    stats: tuple[UnequalColumn, ...] = ()
    samples: tuple[str, ...] = ()
    df1_name: str = ""
    df2_name: str = ""


@dataclass(frozen=True)
class OneSidedRows:
    has_rows: bool
    rows: str = ""


@dataclass(frozen=True, repr=False)
class ReportData:
    """Everything a report shows. All members are immutable and fit into JSON."""

    df1_name: str
    df2_name: str
    df1_shape: tuple[int, int]
    df2_shape: tuple[int, int]
    column_count: int
    column_summary: ColumnCounts
    row_summary: RowFacts
    column_comparison: ColumnTotals
    mismatch_stats: UnequalColumns
    df1_unique_rows: OneSidedRows
    df2_unique_rows: OneSidedRows

    def render(self, template: str | None = None) -> str:
        """As text; ``template`` is the path of a Jinja2 template that gets the members by name."""
        return _from_template(self, template) if template else _text(self)

    def to_html(self, template: str | None = None) -> str:
        return f"<html><head><title>Comparison Report</title></head><body><pre>{html.escape(self.render(template), quote=False)}</pre></body></html>"

    def save(self, path: str | Path, template: str | None = None) -> None:
        """Write the page; folders on the way are made."""
        path = Path(path)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(self.to_html(template), encoding="utf-8")

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, default=str)

    def __str__(self) -> str:
        return self.render()

    def __repr__(self) -> str:
        return f"ReportData({self.df1_name!r} {self.df1_shape}, {self.df2_name!r} {self.df2_shape})"


def fixed_width_table(headers: Sequence[str], rows: Sequence[Sequence[object]], align: str) -> str:
    """Columns as wide as their widest cell, two spaces apart, dashes under the headers; ``align`` has
    an l or r for each column. Lines have no spaces at their ends."""
    cells = [list(map(str, r)) for r in (headers, *rows)]
    if any(len(r) != len(align) for r in cells):
        raise ValueError(f"each row needs {len(align)} cells")
    width = [max(map(len, column)) for column in zip(*cells, strict=True)]
    cells.insert(1, ["-" * w for w in width])
    put = {"l": str.ljust, "r": str.rjust}
    return "\n".join("  ".join(put[a](c, w) for c, w, a in zip(r, width, align, strict=True)).rstrip() for r in cells)


def frame_text(df: DataFrame, n: int) -> str:
    """The first ``n`` rows as a text table; nothing more is fetched."""
    return df.limit(n).toPandas().to_string()


def rows_text(names: Sequence[str], rows: Sequence[Sequence[object]]) -> str:
    """Rows that the driver has as a text table."""
    return pandas.DataFrame.from_records([tuple(r) for r in rows], columns=list(names)).to_string()


def build(comparison: Comparison, sample_count: int = 10, column_count: int = 10) -> ReportData:
    """The model: one aggregate, one ordered sample for all unequal columns, and one for each side. The
    number of jobs doesn't grow with that of the columns."""
    a, b = comparison.spec.left_name, comparison.spec.right_name
    rows, stats = comparison.row_counts(), comparison.column_stats()
    left_extra, right_extra = tuple(comparison.left_only_columns()), tuple(comparison.right_only_columns())
    shown = [s for s in stats if not s.all_match]
    unequal = [s.column for s in shown if s.unequal_cnt and sample_count]
    keys = comparison.keys
    found = comparison.samples([c for c in unequal if c not in keys], sample_count)
    one_sided = [tuple(r) for r in comparison.unmatched_keys(sample_count).collect()] if set(unequal) & set(keys) else []
    samples = tuple(rows_text([c], [(r[keys.index(c)],) for r in one_sided]) if c in keys else rows_text([*keys, f"{c} ({a})", f"{c} ({b})"], found[c]) for c in unequal)
    mismatch = UnequalColumns(False, False)
    if shown:
        lines = [UnequalColumn(s.column, s.dtype1, s.dtype2, s.unequal_cnt, s.max_diff, s.null_diff, s.rel_tol, s.abs_tol) for s in shown]
        mismatch = UnequalColumns(True, bool(samples), tuple(sorted(lines, key=lambda s: s.column)), samples, a, b)

    def alone(side: str, n: int) -> OneSidedRows:
        n = min(n, sample_count)
        return OneSidedRows(True, frame_text(comparison.alone(side, n, column_count), n)) if n else OneSidedRows(False)

    def told(tol: dict[str, float]) -> Any:
        return f"{tol['default']:g}" if len(tol) == 1 else dict(tol)

    return ReportData(
        a,
        b,
        *comparison.shapes(),
        column_count,
        ColumnCounts(len(stats), len(left_extra), left_extra, len(right_extra), right_extra, a, b),
        RowFacts(tuple(comparison.keys), False, comparison.has_duplicates, told(comparison.spec.abs_tol), told(comparison.spec.rel_tol), rows.common, rows.left_only, rows.right_only, rows.unequal, rows.equal, a, b),
        ColumnTotals(sum(s.unequal_cnt > 0 for s in stats), sum(s.unequal_cnt == 0 for s in stats), sum(s.unequal_cnt for s in stats)),
        mismatch,
        alone("left", rows.left_only),
        alone("right", rows.right_only),
    )


def _section(title: str, *lines: str) -> list[str]:
    return [title, "-" * len(title), "", *lines, ""]


def _extra(n: int, names: Sequence[str]) -> str:
    return f"{n} {list(names)}" if names else str(n)


def _text(d: ReportData) -> str:
    a, b, c, r, v, m = d.df1_name, d.df2_name, d.column_summary, d.row_summary, d.column_comparison, d.mismatch_stats
    out = ["Comparison", "----------", ""]
    shapes = [[name, f"{shape[1]:,}", f"{shape[0]:,}"] for name, shape in ((a, d.df1_shape), (b, d.df2_shape))]
    out += _section("DataFrame Summary", fixed_width_table(["DataFrame", "Columns", "Rows"], shapes, "lrr"))
    out += _section(
        "Column Summary",
        f"Number of columns in common: {c.common_columns}",
        f"Number of columns in {a} but not in {b}: {_extra(c.df1_unique, c.df1_unique_columns)}",
        f"Number of columns in {b} but not in {a}: {_extra(c.df2_unique, c.df2_unique_columns)}",
    )
    out += _section(
        "Row Summary",
        f"Matched on: {', '.join(r.match_columns)}",
        f"Any duplicates on match values: {'Yes' if r.has_duplicates else 'No'}",
        f"Default Absolute Tolerance: {r.abs_tol}",
        f"Default Relative Tolerance: {r.rel_tol}",
        f"Number of rows in common: {r.common_rows:,}",
        f"Number of rows in {a} but not in {b}: {r.df1_unique:,}",
        f"Number of rows in {b} but not in {a}: {r.df2_unique:,}",
        "",
        f"Number of rows with some compared columns unequal: {r.unequal_rows:,}",
        f"Number of rows with all compared columns equal: {r.equal_rows:,}",
    )
    out += _section(
        "Column Comparison",
        f"Number of columns compared with some values unequal: {v.unequal_columns:,}",
        f"Number of columns compared with all values equal: {v.equal_columns:,}",
        f"Total number of values which compare unequal: {v.unequal_values:,}",
    )
    if m.has_mismatches:
        headers = ["Column", f"{a} dtype", f"{b} dtype", "# Unequal", "Max Diff", "# Null Diff", "Rel Tol", "Abs Tol"]
        lines = [[s.column if len(s.column) <= 20 else s.column[:17] + "...", s.dtype1, s.dtype2, f"{s.unequal_cnt:,}", f"{s.max_diff:.4f}", f"{s.null_diff:,}", f"{s.rel_tol:.4f}", f"{s.abs_tol:.4f}"] for s in m.stats]
        out += _section("Columns with Unequal Values or Types", fixed_width_table(headers, lines, "lllrrrrr"))
    if m.has_samples:
        out += _section("Sample Rows with Unequal Values", "\n\n".join(m.samples))
    for name, rows in ((a, d.df1_unique_rows), (b, d.df2_unique_rows)):
        if rows.has_rows:
            out += _section(f"Sample Rows Only in {name} (First {d.column_count} Columns)", rows.rows)
    return "\n".join(out)


#: Where templates named without a folder are looked for, after the working folder.
TEMPLATES = Path(__file__).parent / "templates"


def find_template(name: str) -> Path:
    """The file of a template: an absolute path, or one below the working folder or ``TEMPLATES``, as given,
    or with or without the suffix .j2."""
    given = Path(name)
    other = given.with_suffix("") if given.suffix == ".j2" else given.with_name(f"{given.name}.j2")
    for folder in (Path("/"),) if given.is_absolute() else (Path.cwd(), TEMPLATES):
        for path in (folder / given, folder / other):
            if path.is_file():
                return path
    raise FileNotFoundError(f"there is no template {name}")


def _from_template(data: ReportData, template: str) -> str:
    try:
        import jinja2
    except ImportError as error:
        raise RuntimeError("templates need the jinja2 package") from error
    path = find_template(template)
    env = jinja2.Environment(loader=jinja2.FileSystemLoader(path.parent), autoescape=jinja2.select_autoescape(), trim_blocks=True, lstrip_blocks=True, extensions=["jinja2.ext.do"])
    env.globals["fixed_width_table"] = fixed_width_table
    return env.get_template(path.name).render(**data.to_dict())
