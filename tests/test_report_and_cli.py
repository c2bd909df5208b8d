import dataclasses
import importlib.util
import json
import re
import sys
import types
from pathlib import Path

import pytest
from tablewright import compare, report
from tablewright.cli import main
from tablewright.report import fixed_width_table

# fixed value: the text format that others read
GOLDEN = """Comparison
----------

DataFrame Summary
-----------------

DataFrame  Columns  Rows
---------  -------  ----
df1              3     3
df2              3     3

Column Summary
--------------

Number of columns in common: 3
Number of columns in df1 but not in df2: 0
Number of columns in df2 but not in df1: 0

Row Summary
-----------

Matched on: id
Any duplicates on match values: No
Default Absolute Tolerance: 0
Default Relative Tolerance: 0
Number of rows in common: 3
Number of rows in df1 but not in df2: 0
Number of rows in df2 but not in df1: 0

Number of rows with some compared columns unequal: 1
Number of rows with all compared columns equal: 2

Column Comparison
-----------------

Number of columns compared with some values unequal: 2
Number of columns compared with all values equal: 1
Total number of values which compare unequal: 2

Columns with Unequal Values or Types
------------------------------------

Column  df1 dtype  df2 dtype  # Unequal  Max Diff  # Null Diff  Rel Tol  Abs Tol
------  ---------  ---------  ---------  --------  -----------  -------  -------
score   double     double             1    0.5000            0   0.0000   0.0000
val     bigint     bigint             1   79.0000            0   0.0000   0.0000

Sample Rows with Unequal Values
-------------------------------

   id  val (df1)  val (df2)
0   2         20         99

   id  score (df1)  score (df2)
0   2          2.0          2.5
"""


@pytest.fixture(scope="module")
def pair(spark):
    schema = "id bigint, val bigint, score double"
    return spark.createDataFrame([(1, 10, 1.0), (2, 20, 2.0), (3, 30, 3.0)], schema), spark.createDataFrame([(1, 10, 1.0), (2, 99, 2.5), (3, 30, 3.0)], schema)


def test_golden_text(pair):
    assert compare(*pair, "id").report() == GOLDEN


def test_model(pair, tmp_path):
    data = compare(*pair, "id", abs_tol={"val": 1}).report_data(sample_count=0)
    assert not data.mismatch_stats.has_samples and data.row_summary.abs_tol == {"default": 0.0, "val": 1.0}
    assert json.loads(data.to_json())["row_summary"]["unequal_rows"] == 1 and str(data) == data.render() and "df1" in repr(data)
    with pytest.raises(dataclasses.FrozenInstanceError):
        data.df1_name = "x"
    data.save(tmp_path / "a" / "b.html")
    assert (tmp_path / "a" / "b.html").read_text().startswith("<html>")
    compare(*pair, "id").report(html_file=str(tmp_path / "c.html"))
    assert "<pre>Comparison" in (tmp_path / "c.html").read_text()


class FakeJinja:
    """As much of jinja2 as reports use: ``{{ path }}`` and calls of fixed_width_table without arguments in between."""

    def __init__(self, folder):
        self.folder, self.globals = folder, {}

    def get_template(self, name):
        text, outer = (Path(self.folder) / name).read_text(), self

        class Template:
            def render(self, **data):
                return re.sub(r"{{ (.+?) }}", lambda m: str(eval(m[1].replace(".", "_dot_"), {}, {**outer.globals, **flat(data)})), text)

        return Template()


def flat(data, at=""):
    out = {}
    for k, v in data.items():
        out[at + k] = v
        if isinstance(v, dict):
            out |= flat(v, f"{at}{k}_dot_")
    return out


@pytest.fixture
def jinja(monkeypatch):
    """jinja2 itself if it is there, otherwise a stand-in that records how it is set up."""
    if importlib.util.find_spec("jinja2"):
        return None
    seen = {}

    def environment(loader, **options):
        seen.update(options)
        return FakeJinja(loader)

    monkeypatch.setitem(sys.modules, "jinja2", types.SimpleNamespace(Environment=environment, FileSystemLoader=lambda folder: folder, select_autoescape=lambda: "chosen"))
    return seen


def test_template(pair, tmp_path, jinja, monkeypatch):
    (tmp_path / "t.j2").write_text("{{ df1_name }} {{ row_summary.common_rows }} {{ fixed_width_table(['x'], [], 'l') }}")
    (tmp_path / "plain").write_text("{{ df2_name }}")
    told = lambda name: compare(*pair, "id").report(template=str(name))
    assert told(tmp_path / "t.j2") == told(tmp_path / "t") == "df1 3 x\n-"
    assert told(tmp_path / "plain") == told(tmp_path / "plain.j2") == "df2"
    monkeypatch.chdir(tmp_path)
    assert told("t") == told("t.j2") == "df1 3 x\n-"
    monkeypatch.chdir("/")
    monkeypatch.setattr(report, "TEMPLATES", tmp_path)
    assert told("t") == "df1 3 x\n-"
    with pytest.raises(FileNotFoundError):
        told("missing")
    if jinja:
        assert jinja == {"autoescape": "chosen", "trim_blocks": True, "lstrip_blocks": True, "extensions": ["jinja2.ext.do"]}


def test_template_without_jinja(pair, tmp_path, monkeypatch):
    monkeypatch.setitem(sys.modules, "jinja2", None)
    with pytest.raises(RuntimeError, match="jinja2"):
        compare(*pair, "id").report(template=str(tmp_path / "t.j2"))


def test_long_names_and_sections(spark):
    left = spark.createDataFrame([(1, 1, 2), (2, 1, 2)], "id int, a_column_with_a_rather_long_name int, only_left int")
    right = spark.createDataFrame([(1, 2), (3, 1)], "id int, a_column_with_a_rather_long_name int")
    text = compare(left, right, "id").report(column_count=2)
    assert "a_column_with_a_r..." in text and "Sample Rows Only in df1 (First 2 Columns)" in text and "but not in df2: 1 ['only_left']" in text


def test_fixed_width_table():
    assert fixed_width_table(["a", "bb"], [["xyz", 1], ["", 22]], "lr") == "a    bb\n---  --\nxyz   1\n     22"
    assert fixed_width_table(["a", "b"], [], "ll") == "a  b\n-  -"
    with pytest.raises(ValueError):
        fixed_width_table(["a"], [["x", "y"]], "l")


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("cli")
    left, right = [(1, "Ann", 1.5), (2, "Bob", 2.5), (3, "Cy", 3.5)], [(1, "Ann", 1.5), (2, "Bob", 9.0), (4, "Di", 4.5)]
    for name, rows in (("left", left), ("right", right)):
        (folder / f"{name}.csv").write_text("id,name,amount\n" + "".join(f"{a},{b},{c}\n" for a, b, c in rows))
        (folder / f"{name}.tsv").write_text("id\tname\tamount\n" + "".join(f"{a}\t{b}\t{c}\n" for a, b, c in rows))
        docs = [dict(zip(("id", "name", "amount"), r, strict=True)) for r in rows]
        (folder / f"{name}.json").write_text(json.dumps(docs))
        (folder / f"{name}.jsonl").write_text("".join(json.dumps(d) + "\n" for d in docs))
    (folder / "empty.csv").write_text("id,name,amount\n")
    return folder


def call(files, left, right, *more):
    return main(["compare", "--left", str(files / left), "--right", str(files / right), "--on", "id", "--quiet", *more])


@pytest.mark.parametrize("kind", ["csv", "json", "jsonl"])
def test_exit_codes_by_format(files, kind):
    assert call(files, f"left.{kind}", f"left.{kind}") == 0 and call(files, f"left.{kind}", f"right.{kind}") == 1


def test_thresholds(files):
    assert [call(files, "left.csv", "right.csv", "--max-unequal-rows", str(n)) for n in (0, 2, 3)] == [1, 1, 0]
    assert call(files, "left.csv", "right.csv", "--max-unequal-rows", "1", "--ignore-unique-rows") == 0
    assert call(files, "empty.csv", "empty.csv") == 1 and call(files, "empty.csv", "empty.csv", "--max-unequal-rows", "0") == 0


def test_output(files, capsys):
    out = files / "deep" / "report.json"
    assert main(["compare", "--left", str(files / "left.csv"), "--right", str(files / "right.csv"), "--on", "id,name", "--report-format", "json", "--output", str(out)]) == 1
    assert json.loads(out.read_text()) == json.loads(capsys.readouterr().out)
    assert call(files, "left.csv", "left.csv", "--output", str(files / "left.csv" / "x")) == 2
    main(["compare", "--left", str(files / "left.csv"), "--right", str(files / "left.csv"), "--on", "id", "--sample-count", "0"])
    assert "left_1" in capsys.readouterr().out


def test_delimiter_and_tolerance(files):
    tabs = ["--input-format", "csv", "--csv-delimiter", r"\t"]
    assert call(files, "left.tsv", "left.tsv", *tabs) == 0
    loose = ["--max-unequal-rows", "0", "--ignore-unique-rows"]
    assert call(files, "left.csv", "right.csv", *loose, "--abs-tol", "amount=10") == 0 and call(files, "left.csv", "right.csv", *loose, "--abs-tol", "0.1") == 1


@pytest.mark.parametrize("more", [["--on-index"], ["--order-by", "id"], ["--abs-tol", "1", "--abs-tol", "amount=2"], ["--abs-tol", "1", "--abs-tol", "2"], ["--ignore-unique-rows"], ["--df1-name", "x", "--df2-name", "x"]])
def test_bad_combinations(files, more, capsys):
    assert call(files, "left.csv", "right.csv", *more) == 2 and "tablewright:" in capsys.readouterr().err


def test_bad_inputs(files):
    assert call(files, "left.tsv", "left.tsv") == 2 and call(files, "none.csv", "left.csv") == 2
    assert main(["compare", "--left", str(files / "left.csv"), "--right", str(files / "left.csv"), "--on", "nope", "--quiet"]) == 2
    assert main(["compare", "--left", str(files / "left.csv"), "--right", str(files / "left.csv")]) == 2
    for bad in (["--sample-count", "-1"], ["--csv-delimiter", "ab"], ["--abs-tol", "-1"], ["--abs-tol", "x"]):
        with pytest.raises(SystemExit):
            call(files, "left.csv", "left.csv", *bad)


def test_on_index(files, capsys):
    argv = ["compare", "--left", str(files / "left.csv"), "--right", str(files / "right.csv"), "--on-index"]
    assert main([*argv, "--order-by", "id,name"]) == 1
    assert "Number of rows in common: 3" in (text := capsys.readouterr().out) and "Matched on: position" in text
    assert main([*argv[:4], str(files / "left.csv"), "--on-index", "--order-by", "ID", "--quiet"]) == 0
    assert main([*argv, "--order-by", "nope"]) == 2 and "order by" in capsys.readouterr().err
