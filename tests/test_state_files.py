"""State files in every form, snapshots behind a pointer, trackers as CSV and workbooks."""

import io
import zipfile

import pytest

from jobloom.sources import state

SHEET = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('{"u1": {"title": "T", "score": 7, "commute_min": 12}, "u2": {"title": null, "score": ""}}', {"u1": ("T", "7", 12), "u2": ("", "", None)}),
        ('[{"job_uid": "a", "title": "old"}, 5, {"title": "none"}, {"job_uid": "a", "title": "new", "commute_min": "x"}]', {"a": ("new", "", None)}),
        ("{broken", {}), ("7", {}), ("", {}), ("[]", {}),
    ],
)
def test_state_files(spark, tmp_path, text, want):
    (tmp_path / "state.json").write_text(text)
    got = {r["uid"]: (r["title"], r["score"], r["commute_min"]) for r in state.read_state_file(spark, f"{tmp_path}/state.json").collect()}
    assert got == want


def test_a_write_that_is_cut_off_leaves_the_earlier_snapshot(spark, tmp_path):
    folder = f"{tmp_path}/state"
    assert state.current_snapshot(spark, folder) is None
    one = spark.createDataFrame([("a", 1)], "uid string, n int")
    state.save_snapshot(one, folder)
    failing = one.selectExpr("uid", "raise_error('cut off') AS n")
    with pytest.raises(Exception, match="cut off"):
        state.save_snapshot(failing, folder)
    assert [tuple(r) for r in state.current_snapshot(spark, folder).collect()] == [("a", 1)]
    state.save_snapshot(state.current_snapshot(spark, folder).selectExpr("uid", "n + 1 AS n"), folder)
    assert [tuple(r) for r in state.current_snapshot(spark, folder).collect()] == [("a", 2)]


def test_tracker_as_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('job_uid,aktion,notes,extra\n a ,skip,"x ""y""\nz",1\n,done,,\nb,,,\na,done,,2\n')
    got = {r["job_uid"]: (r["aktion"], r["notes"], r["title"]) for r in state.tracker_csv(spark, f"{tmp_path}/t.csv").collect()}
    assert got == {"a": ("done", "", ""), "b": ("", "", "")}
    (tmp_path / "n.csv").write_text("uid,aktion\na,skip\n")
    assert state.tracker_csv(spark, f"{tmp_path}/n.csv").collect() == []


def workbook(rows, shared=()):
    cells = "".join(f"<row>{''.join(cell for cell in row)}</row>" for row in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as parts:
        parts.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{SHEET}"><sheetData>{cells}</sheetData></worksheet>')
        if shared:
            parts.writestr("xl/sharedStrings.xml", f'<sst xmlns="{SHEET}">{"".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in shared)}</sst>')
    return out.getvalue()


def test_tracker_as_workbook(spark, tmp_path):
    text = lambda at, value: f'<c r="{at}" t="inlineStr"><is><t>{value}</t></is></c>'
    known = lambda at, n: f'<c r="{at}" t="s"><v>{n}</v></c>'
    rows = [[text("A1", "job_uid"), known("C1", 0), text("AB1", "notes")], [text("A2", "u1"), known("C2", 1), "<c r='AB2'><v>7</v></c>"], [text("C3", "nobody")], [text("A4", "u1"), "<c r='C4'/>"], [text("A5", "u2"), known("C5", 1)]]
    (tmp_path / "t.xlsx").write_bytes(workbook(rows, ("aktion", "skip")))
    got = {r["job_uid"]: (r["aktion"], r["notes"]) for r in state.tracker_workbook(spark, f"{tmp_path}/t.xlsx").collect()}
    assert got == {"u1": ("", ""), "u2": ("skip", "")}
    (tmp_path / "b.xlsx").write_bytes(b"no workbook")
    assert state.tracker_workbook(spark, f"{tmp_path}/b.xlsx").collect() == []
