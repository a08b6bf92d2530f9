"""Paid calls: committed in units, never paid again, on batches and on streams."""

import glob
import os
import uuid

import pytest

from ticketlens import config as C
from ticketlens import schemas as SC
from ticketlens.operators import model_calls as MC
from ticketlens.operators import routing as RT
from ticketlens.session import shared_path
from ticketlens.sources import sinks as SK
from ticketlens.streaming import routing_stream as RS

SCORED = "id long, text string, label string, prob double, urgency string"


class Killed(BaseException):
    """Ends a task, as a lost executor does; not an error of the client."""


def counting(folder, dies_after=None, fails=None):
    """A client factory whose clients leave a file for every paid call."""
    def factory():
        def call(prompt):
            paid = len(os.listdir(folder))
            if dies_after is not None and paid >= dies_after:
                raise Killed("no more")
            open(os.path.join(folder, f"{os.getpid()}-{paid}-{os.urandom(4).hex()}"), "w").close()
            if fails and fails in prompt:
                raise RuntimeError("refused")
            return '{"issue_type": "ads", "n": %d}' % len(prompt)
        return call
    return factory


def band(spark, n=60):
    return spark.createDataFrame([(k, f"odd ticket {k}", "other", 0.2, "") for k in range(n)], SCORED)


def test_a_killed_run_goes_on_where_it_was(spark, tmp_path):
    ledger, calls = shared_path(spark, f"ledger-{uuid.uuid4().hex}"), str(tmp_path)
    with pytest.raises(Exception):  # noqa: B017, PT011 - whatever Spark makes of a lost task
        MC.classify_replies(band(spark), counting(calls, dies_after=35), partitions=1, ledger=ledger, unit_calls=10).collect()
    committed = MC.read_ledger(spark, ledger).count()
    assert 0 < committed < 60 and committed <= len(os.listdir(calls)) <= 35
    paid_before = len(os.listdir(calls))
    out = MC.classify_replies(band(spark), counting(calls), partitions=2, ledger=ledger, unit_calls=10).collect()
    assert len(out) == 60 and all(r["reply"] and r["error"] is None for r in out)
    assert len(os.listdir(calls)) == paid_before + 60 - committed      # only what no unit holds


def test_nothing_is_paid_twice_and_changed_texts_are_paid(spark, tmp_path):
    ledger, calls = shared_path(spark, f"ledger-{uuid.uuid4().hex}"), str(tmp_path)
    rows = band(spark, 20)
    first = MC.classify_replies(rows, counting(calls), ledger=ledger).collect()
    again = MC.classify_replies(rows.unionByName(rows), counting(calls), ledger=ledger).collect()
    assert sorted(first) == sorted(again) and len(os.listdir(calls)) == 20
    MC.classify_replies(rows.where("id < 5").selectExpr("id", "text || '!' as text"), counting(calls), ledger=ledger).collect()
    assert len(os.listdir(calls)) == 25


def test_units_without_a_bound_on_callers_are_tasks_of_one_job_that_commit_themselves(spark, tmp_path):
    ledger, calls = shared_path(spark, f"ledger-{uuid.uuid4().hex}"), str(tmp_path)
    spark.sparkContext.setJobGroup(group := uuid.uuid4().hex, "calls")
    out = MC.classify_replies(band(spark, 120), counting(calls), ledger=ledger, unit_calls=2)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) < 30 and out.count() == 120 and len(os.listdir(calls)) == 120      # 60 units
    with pytest.raises(Exception):  # noqa: B017, PT011
        MC.classify_replies(band(spark, 400).where("id >= 120"), counting(calls, dies_after=300), ledger=ledger, unit_calls=5)
    committed, paid = MC.read_ledger(spark, ledger).count(), len(os.listdir(calls))
    cores = spark.sparkContext.defaultParallelism
    assert 120 < committed < 400 and paid - committed <= 20 * cores      # what was paid and not committed: units that callers were at
    again = MC.classify_replies(band(spark, 400), counting(calls), ledger=ledger, unit_calls=5).collect()
    assert len(again) == 400 and all(r["reply"] for r in again) and len(os.listdir(calls)) == paid + 400 - committed


def test_failed_calls_are_kept_or_called_again(spark, tmp_path):
    ledger, calls = shared_path(spark, f"ledger-{uuid.uuid4().hex}"), str(tmp_path)
    rows = band(spark, 12)
    first = MC.classify_replies(rows, counting(calls, fails="ticket 7"), ledger=ledger).collect()
    assert [r["error"] for r in first if r["id"] == 7] == ["refused"]
    assert sum(r["reply"] is None for r in MC.classify_replies(rows, counting(calls), ledger=ledger).collect()) == 1
    assert len(os.listdir(calls)) == 12
    mended = MC.classify_replies(rows, counting(calls), ledger=ledger, retry_failed=True).collect()
    assert all(r["reply"] for r in mended) and len(os.listdir(calls)) == 13


def test_enrichment_through_the_ledger_equals_the_direct_calls(spark, tmp_path):
    rows = spark.createDataFrame([(1, "odd"), (2, None), (None, "odd")], "id long, text string")
    ledger = shared_path(spark, f"ledger-{uuid.uuid4().hex}")
    direct = MC.enrichment_replies(rows.where("id is not null"), counting(str(tmp_path))).collect()
    kept = MC.enrichment_replies(rows, counting(str(tmp_path)), ledger=ledger)
    assert kept.columns == ["id", "summary", "resolution", "resolution_error"]
    got = {r["id"]: r for r in kept.collect()}
    assert set(got) == {1, 2, None} and got[1] == next(r for r in direct if r["id"] == 1)


def write_batches(spark, src):
    rows = [(k, "please refund" if k % 7 == 0 else f"odd ticket {k}", "other", (0.2, 0.7, 0.95)[k % 3], "") for k in range(45)]
    for b in range(3):
        SK.write_table(spark.createDataFrame(rows[b * 15:(b + 1) * 15], SC.SCORED).coalesce(1), f"{src}/part{b}")
    return rows


def test_a_stream_with_a_client_equals_the_batch_also_after_a_crash(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    src, sink, calls = f"{tmp_path}/src", f"{tmp_path}/sink", f"{tmp_path}/calls"
    rows = write_batches(spark, src)
    name = f"routing-{uuid.uuid4().hex}"
    low = sum(t.startswith("odd") and p <= C.RoutingThresholds().low_confidence for _, t, _, p, _ in rows)

    def start(client):
        return RS.start_routing_with_client(spark, f"{src}/*", sink, client, name=name, max_files_per_trigger=1, once=True, partitions=1,
                                            unit_calls=2)

    with pytest.raises(Exception):  # noqa: B017, PT011
        start(counting(calls, dies_after=7, fails="ticket 3")).awaitTermination()
    start(counting(calls, fails="ticket 3")).awaitTermination()
    got = spark.read.parquet(sink).collect()
    key = ("id", "route", "stage", "confidence", "llm_issue_type", "llm_urgency", "reason")
    df = spark.createDataFrame(rows, SC.SCORED)
    replies = MC.classify_replies(RT.low_band(df), counting(str(tmp_path / "calls"), fails="ticket 3"))
    want = RT.route(df, replies=replies).collect()
    assert sorted(tuple(r[k] for k in key) for r in got) == sorted(tuple(r[k] for k in key) for r in want)
    assert {r["stage"] for r in got} == {C.STAGE_RULE, C.STAGE_ML, C.STAGE_LLM, C.STAGE_HUMAN}
    assert len(os.listdir(calls)) <= 2 * low + 2      # the batch run's own calls, and at most one unit paid twice
    start(counting(calls, fails="ticket 3")).awaitTermination()      # nothing new: nothing paid, nothing routed
    assert spark.read.parquet(sink).count() == 45 and len(glob.glob(f"{sink}/batch=*")) == 3
