"""Routing on a stream: the cascade is stateless per row, so the batch operator applies to a
streaming DataFrame unchanged.  Replies, when given, are a static table (stream-static
left join); sinks are append-only and checkpointed under the shared folder.

With a client (``start_routing_with_client``) every micro-batch runs the batch job's steps: stage, call the model for the low band
through the ledger, route, write.  The batch's folder in the sink is named by its number and overwritten when the batch is
run again, and the ledger holds the paid replies, so a ticket is routed exactly once and its call is paid once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import config as C
from .. import schemas as SC
from ..operators import model_calls as MC
from ..operators import routing as RT
from ..session import shared_path
from ..sources import sinks as SK


def route_stream(scored_stream: DataFrame, thresholds: C.RoutingThresholds = C.RoutingThresholds(),
                 replies: DataFrame | None = None) -> DataFrame:
    """Route a streaming scored table; ``replies`` is a static ``(id, reply)`` table."""
    return RT.route(scored_stream, thresholds, replies=replies)


def start_routing(spark: SparkSession, source_path: str, sink_path: str, name: str = "routing",
                  thresholds: C.RoutingThresholds = C.RoutingThresholds(), replies: DataFrame | None = None,
                  max_files_per_trigger: int | None = None, once: bool = False) -> StreamingQuery:
    """Parquet files of scored rows in, routed rows out (parquet, append), checkpointed."""
    reader = spark.readStream.schema(SC.SCORED)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    routed = route_stream(reader.parquet(source_path), thresholds, replies)
    writer = (routed.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", shared_path(spark, "streams", name)))
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start(sink_path)


BATCH_COL = "batch"


def start_routing_with_client(spark: SparkSession, source_path: str, sink_path: str, client_factory: MC.ClientFactory, name: str = "routing",
                              thresholds: C.RoutingThresholds = C.RoutingThresholds(), enrich: bool = False,
                              max_files_per_trigger: int | None = None, once: bool = False, partitions: int | None = None,
                              unit_calls: int = MC.UNIT_CALLS) -> StreamingQuery:
    """Parquet files of scored rows in, routed rows out (parquet, a folder ``batch=<number>`` per micro-batch), model
    calls included.  Ledger and checkpoint lie under the shared folder, by the stream's name."""
    sink, ledger = sink_path.rstrip("/"), shared_path(spark, "streams", name, "ledger")

    def run(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        work = shared_path(own, "streams", name, "work", str(number))
        staged = SK.materialize(own, RT.stage_table(batch, thresholds), f"{work}/staged", [RT.BAND_COL])
        if staged.isEmpty():
            return
        replies = MC.classify_replies(RT.low_band(staged, staged=True), client_factory, partitions=partitions, ledger=ledger,
                                      unit_calls=unit_calls)
        enrichment = None
        if enrich:
            enrichment = MC.enrichment_replies(RT.middle_band(staged, staged=True), client_factory, partitions=partitions, ledger=ledger,
                                               unit_calls=unit_calls)
        SK.write_table(RT.route(staged, thresholds, replies=replies, enrichment=enrichment, staged=True), f"{sink}/{BATCH_COL}={number}")

    reader = spark.readStream.schema(SC.SCORED)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    writer = reader.parquet(source_path).writeStream.foreachBatch(run).option(
        "checkpointLocation", shared_path(spark, "streams", name, "checkpoint"))
    return (writer.trigger(availableNow=True) if once else writer).start()
