"""The routing operator on a streaming DataFrame, and the driver entry point."""

import tempfile

from ticketlens import schemas as SC
from ticketlens.operators import routing as RT
from ticketlens.streaming import routing_stream as RS
from tests.conftest import SF001


def test_route_stream_matches_batch(spark):
    rows = [(1, "please refund", "other", 0.2, ""), (2, "odd", "technical", 0.9, "high"),
            (3, "odd", "other", 0.7, ""), (4, "odd", "other", 0.3, "")]
    src = tempfile.mkdtemp(prefix="ticketlens-stream-src-")
    spark.createDataFrame(rows, SC.SCORED).write.mode("overwrite").parquet(src + "/in")
    stream = spark.readStream.schema(SC.SCORED).parquet(src + "/in")
    q = RS.route_stream(stream).writeStream.format("memory").queryName("routed_stream").start()
    q.processAllAvailable()
    q.stop()
    got = {r["id"]: (r["route"], r["stage"]) for r in spark.sql("SELECT * FROM routed_stream").collect()}
    batch = {r["id"]: (r["route"], r["stage"]) for r in RT.route(spark.createDataFrame(rows, SC.SCORED)).collect()}
    assert got == batch


def test_entry_runs(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    out = df.collect()
    assert len(out) == 1 and out[0]["tickets"] > 0


def _run_stream(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}")


def test_route_stream_with_static_replies_matches_batch(spark):
    rows = [(1, "odd", "other", 0.2, ""), (2, "odd", "other", 0.3, "high"), (3, "odd", "other", 0.1, ""),
            (4, "odd", "billing", 0.95, "critical")]
    replies = spark.createDataFrame([(1, '{"issue_type": "ads", "urgency": "high"}'), (2, "not json"), (3, None)],
                                    "id long, reply string")
    src = tempfile.mkdtemp(prefix="ticketlens-stream-src-")
    spark.createDataFrame(rows, SC.SCORED).write.mode("overwrite").parquet(src + "/in")
    stream = spark.readStream.schema(SC.SCORED).parquet(src + "/in")
    got = _run_stream(spark, RS.route_stream(stream, replies=replies), "routed_stream_replies")
    batch = RT.route(spark.createDataFrame(rows, SC.SCORED), replies=replies)
    key = ("id", "route", "stage", "llm_issue_type", "llm_urgency")
    assert sorted(tuple(r[c] for c in key) for r in got.collect()) == \
        sorted(tuple(r[c] for c in key) for r in batch.collect())


def test_weak_labels_on_a_stream_match_batch(spark):
    from ticketlens.operators import labels as LB
    from ticketlens.operators import unify as UN

    rows = [(2, "I can't log in, urgent!!", True), (4, "refund please http://x.y/z", True),
            (6, "agent reply", False), (8, "no inbound flag", None)]
    schema = "id long, text string, inbound boolean"
    src = tempfile.mkdtemp(prefix="ticketlens-stream-social-")
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(src + "/in")

    def pipeline(df):
        return LB.add_weak_labels(UN.social_to_unified(UN.inbound_only(df)))

    got = _run_stream(spark, pipeline(spark.readStream.schema(schema).parquet(src + "/in")), "labeled_stream")
    batch = pipeline(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert got.count() == 2
