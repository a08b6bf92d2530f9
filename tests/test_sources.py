"""Readers and sinks: schemas at the boundary, tolerant read-back, empty-result overwrite."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from ticketlens import schemas as SC
from ticketlens.sources import readers as RD
from ticketlens.sources import sinks as SK


def _tmp(prefix):
    return tempfile.mkdtemp(prefix=f"ticketlens-{prefix}-")


def test_read_csv_quoted_multiline_with_schema(spark):
    d = _tmp("csv")
    with open(os.path.join(d, "tickets.csv"), "w") as fh:
        fh.write('Ticket Subject,Ticket Description,Ticket Type,Ticket Priority\n'
                 '"Refund","line one\nline ""two""",Refund request,High\n'
                 'Login,,Account access,Low\n')
    df = RD.read_csv(spark, d, SC.RAW_TICKETS, multi_line=True)
    rows = sorted(df.collect(), key=lambda r: r["Ticket Subject"])
    assert df.schema == SC.RAW_TICKETS and len(rows) == 2
    assert rows[1]["Ticket Description"] == 'line one\nline "two"' and rows[0]["Ticket Description"] is None
    tables = RD.read_table_set(spark, {"tickets": d}, {"tickets": SC.RAW_TICKETS}, multi_line=True)
    assert list(tables) == ["tickets"] and tables["tickets"].count() == 2


def test_required_inputs(spark):
    with pytest.raises(FileNotFoundError):
        RD.read_required(spark, "/nonexistent/ticketlens/input.csv", SC.RAW_TICKETS, "ticket input")
    with pytest.raises(RuntimeError):
        RD.require_rows(spark.createDataFrame([], SC.RAW_SOCIAL), "social input")
    one = spark.createDataFrame([("hi", True)], SC.RAW_SOCIAL)
    assert RD.require_rows(one, "social input") is one


def test_labeled_eval_builds_text_when_absent(spark):
    d = _tmp("eval")
    with open(os.path.join(d, "eval.csv"), "w") as fh:
        fh.write("subject,description,issue_type\nCan't pay,card declined,billing\n,only body,other\n")
    got = {r["issue_type"]: r["text"] for r in RD.read_labeled_eval(spark, d).collect()}
    assert got == {"billing": "Can't pay card declined", "other": " only body"}


def test_first_present_coalesces_current_then_legacy_names(spark):
    df = spark.createDataFrame([(None, 0.5), (0.7, 0.1)], "new_rate double, old_rate double")
    got = [r[0] for r in df.select(RD.first_present(df, "new_rate", "old_rate", "gone")).collect()]
    assert got == [0.5, 0.7]
    assert df.select(RD.first_present(df, "gone", default=F.lit(1.0))).first()[0] == 1.0
    assert df.select(RD.first_present(df, "gone")).first()[0] is None


def test_read_result_missing_and_empty_overwrite(spark):
    out = _tmp("results")
    assert RD.read_result(spark, f"{out}/never_written") is None
    path = f"{out}/eval_comparison"
    SK.write_small(spark.createDataFrame([("stale", 1)], "metric_type string, n_eval_samples long"), path)
    SK.overwrite_empty(spark, SC.EVAL_COMPARISON, path)
    back = RD.read_result(spark, path)
    assert back is not None and back.count() == 0 and back.schema.fieldNames() == SC.EVAL_COMPARISON.fieldNames()


def test_report_and_materialize(spark):
    out = _tmp("report")
    SK.write_report(spark, [("issue_type", "held_out_accuracy", "0.5000")], f"{out}/training_report")
    rep = RD.read_result(spark, f"{out}/training_report").collect()
    assert [tuple(r) for r in rep] == [("issue_type", "held_out_accuracy", "0.5000")]
    df = spark.createDataFrame([(1, "rule_based"), (2, "human_fallback")], "id long, stage string")
    back = SK.materialize(spark, df, f"{out}/routed", ["stage"])
    assert sorted((r["id"], r["stage"]) for r in back.collect()) == [(1, "rule_based"), (2, "human_fallback")]
    assert {"stage=human_fallback", "stage=rule_based"} <= set(os.listdir(f"{out}/routed"))


def test_folder_scan_names_tables_and_the_first(spark, tmp_path):
    import pytest

    (tmp_path / "b_tickets.csv").write_text("id,text\n1,x\n2,y\n")
    (tmp_path / "a_social.csv").write_text("id,text\n7,z\n")
    (tmp_path / "notes.txt").write_text("no table")
    tables = RD.read_folder(spark, str(tmp_path))
    assert list(tables) == ["a_social", "b_tickets"] and tables["b_tickets"].count() == 2
    assert RD.first_table(tables).first()["text"] == "z"
    (tmp_path / "empty").mkdir()
    for bad in ("empty", "missing"):
        with pytest.raises(FileNotFoundError):
            RD.read_folder(spark, str(tmp_path / bad))


def test_csv_of_several_files_is_one_table(spark, tmp_path, monkeypatch):
    """No file holds more than its bound of rows, and all files of a job are read, line breaks and quotes included."""
    from ticketlens.plans import queries as Q

    at = f"{tmp_path}/csv"
    monkeypatch.setattr(Q, "CSV_ROWS", 10)
    rows = spark.createDataFrame([(k, f'"s{k}"', f"line\nof {k}", "ads") for k in range(95)], "id long, subject string, description string, issue_type string")
    Q._as_csv(rows.repartition(3), at)
    assert len(list((tmp_path / "csv").glob("*.csv"))) >= 10
    for df in (RD.first_table(RD.read_folder(spark, at)), RD.read_labeled_eval(spark, at)):
        assert sorted((int(r["id"]), r["subject"], r["description"]) for r in df.collect()) == [(k, f'"s{k}"', f"line\nof {k}") for k in range(95)]
