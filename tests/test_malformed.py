"""CSV records with line breaks in quotes, too few or too many fields, and open quotes."""

import datetime

from farebox.operators import overview
from farebox.plans.reports import write_reports
from farebox.plans.workspace import Workspace
from farebox.sources.reader import good_rows, read_csv, read_purchases, rejected_lines

HEADER = "nk_ota_localizer_id,fk_contact,date_purchase,gmv_success\n"
BROKEN = HEADER + (
    'T1,A,2024-01-05,10\nT2,"A\nand\r\nB",2024-01-06,20\nT3,"say ""hi"", B",2024-01-07,30\n'
    "T4,B\n\nT5,C,2024-01-08,40,extra,more\nT6,,2024-01-09,50,\nT7,D,2024-01-09,60\n"
)
WHOLE = HEADER + "U1,A,2024-02-01,1\nU2,B,2024-02-02,2,\nU3\nU4,C,2024-02-03,4\n"


def folder(tmp_path, **files):
    place = tmp_path / "in put.csv"
    place.mkdir()
    for name, text in files.items():
        (place / f"{name} 1.csv").write_text(text, newline="")
    return str(place)


def test_no_field_or_line_is_lost(spark, tmp_path):
    records = read_csv(spark, folder(tmp_path, a=BROKEN, b=WHOLE)).cache()
    rows = {r[0]: tuple(r)[1:] for r in good_rows(records).collect()}
    assert rows == {
        "T1": ("A", "2024-01-05", "10"), "T2": ("A\nand\r\nB", "2024-01-06", "20"),
        "T3": ('say "hi", B', "2024-01-07", "30"), "T4": ("B", None, None), "T7": ("D", "2024-01-09", "60"),
        "U1": ("A", "2024-02-01", "1"), "U3": (None, None, None), "U4": ("C", "2024-02-03", "4"),
    }
    lines = {(r.fault, r.line) for r in rejected_lines(records).collect()}
    assert lines == {
        ("surplus fields", "T5,C,2024-01-08,40,extra,more"), ("surplus fields", "T6,,2024-01-09,50,"),
        ("surplus fields", "U2,B,2024-02-02,2,"),
    }


def test_open_quote(spark, tmp_path):
    """The rest of the file is one record that is set apart, not lost."""
    text = HEADER + 'T1,A,2024-01-05,10\nT2,"A,2024-01-06,20\nT3,B,2024-01-07,30\n'
    records = read_csv(spark, folder(tmp_path, a=text, b=WHOLE)).cache()
    assert {r[0] for r in good_rows(records).collect()} == {"T1", "U1", "U3", "U4"}
    (open_quote,) = [r.line for r in rejected_lines(records).collect() if r.fault == "unclosed quote"]
    assert open_quote.startswith("T2,") and "T3,B,2024-01-07,30" in open_quote


def test_pruned_scan_sees_the_same_faults(spark, tmp_path):
    """Reading one column must not hide malformed lines."""
    records = read_csv(spark, folder(tmp_path, b=WHOLE))
    assert {r[0] for r in good_rows(records).select("nk_ota_localizer_id").collect()} == {"U1", "U3", "U4"}
    assert rejected_lines(records).select("fault").count() == 1 and good_rows(records).count() == 3


def test_workspace_counts_and_writes_rejects(spark, tmp_path):
    path = folder(tmp_path, a=BROKEN, b=WHOLE)
    w = Workspace.read(spark, path, datetime.date(2024, 3, 1))
    profile = {r.metric: r.value for r in overview.ingest_profile(w.raw, w.rejected).collect()}
    assert profile["rows"] == "8" and profile["rejected:lines"] == "3"
    assert profile["rejected:lines:surplus fields"] == "3"
    out = str(tmp_path / "out")
    write_reports(w, out, ["rfm"])
    assert spark.read.parquet(f"{out}/rejected_lines").count() == 3
    assert {r.fk_contact for r in spark.read.parquet(f"{out}/rfm").collect()} == {"A", "A\nand\r\nB", 'say "hi", B', "C", "D"}


def test_clean_file_has_no_rejects(spark, tmp_path):
    path = folder(tmp_path, b=HEADER + "U1,A,2024-02-01,1\n")
    assert rejected_lines(read_csv(spark, path)).count() == 0 and read_purchases(spark, path).count() == 1
    w = Workspace.read(spark, path, datetime.date(2024, 3, 1))
    profile = {r.metric: r.value for r in overview.ingest_profile(w.raw, w.rejected).collect()}
    assert profile["rejected:lines"] == "0"
