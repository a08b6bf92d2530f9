"""Transport for language-model calls with an injected client.

Only the rows that need a reply are sent (filter *before* ``mapInPandas``; Catalyst
cannot push a filter through a Python operator).  Each task builds one client
from the factory; a failed call yields a null reply plus
its error text, never an exception.  Parsing of the replies is native (``functions.replies``).

Paid calls go through a ledger (``ledgered``): a table of replies by (prompt name, id, prompt hash), to which a run
appends in units of a bounded number of calls, each committed by itself.  A run first leaves out what the ledger has, so a
job that is started again, on the same or on changed rows, pays only for what no committed unit holds; what a lost executor or
driver can make it pay twice is one unit at most (without a bound on the callers, the unit that each caller is at).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..session import shared_path

Client = Callable[[str], str]
ClientFactory = Callable[[], Client]

REPLY_SCHEMA = "id long, reply string, error string"

# Our own prompt wording; the keys asked for are the ones the parser reads.
CLASSIFY_PROMPT = (
    "Classify this customer support ticket. Answer with one JSON object only, with keys "
    "issue_type (billing, ads, login, technical, account or other), urgency (low, medium, high "
    "or critical) and complexity (low, medium or high).\n\n"
    "Ticket: The card I pay with ran out and the shop closes tonight unless the fee goes through.\n"
    'Answer: {"issue_type": "billing", "urgency": "high", "complexity": "low"}\n\n'
    "Ticket: Since the update the import stops half way, sometimes with a timeout, on two of our sites.\n"
    'Answer: {"issue_type": "technical", "urgency": "medium", "complexity": "high"}\n\n'
    "Ticket: Where can I change the name shown on my profile?\n"
    'Answer: {"issue_type": "account", "urgency": "low", "complexity": "low"}\n\n'
    "Ticket: "
)
SUMMARY_PROMPT = "Write a one or two sentence summary of this support ticket for the agent who picks it up:\n\n"
RESOLUTION_PROMPT = (
    "Suggest how to resolve this customer ticket and whether it needs escalation. Answer with one JSON "
    "object only, with keys suggested_path (text), should_escalate (true or false) and reason (text).\n\nTicket: "
)


def classify_prompt(text: str | Column) -> Column:
    return F.concat(F.lit(CLASSIFY_PROMPT), F.col(text) if isinstance(text, str) else text)


def summary_prompt(text: str | Column) -> Column:
    return F.concat(F.lit(SUMMARY_PROMPT), F.col(text) if isinstance(text, str) else text)


def resolution_prompt(text: str | Column) -> Column:
    return F.concat(F.lit(RESOLUTION_PROMPT), F.col(text) if isinstance(text, str) else text)


def call_model(df: DataFrame, prompt: Column, client_factory: ClientFactory, id_col: str = "id",
               partitions: int | None = None, strip: bool = False) -> DataFrame:
    """``(id, reply, error)`` for every row of ``df``.  ``partitions`` bounds the number of
    concurrent callers (one task = one sequential caller)."""
    out = call_model_multi(df, {"reply": prompt}, client_factory, id_col, partitions, strip)
    return out.withColumnRenamed("reply_error", "error")


def call_model_multi(df: DataFrame, prompts: dict[str, Column], client_factory: ClientFactory,
                     id_col: str = "id", partitions: int | None = None, strip: bool = False) -> DataFrame:
    """Several prompts per row in one pass: ``id`` plus ``<name>`` and ``<name>_error`` per prompt."""
    names = list(prompts)
    d = df.select(F.col(id_col).cast("long").alias("id"), *[c.alias(f"_p_{n}") for n, c in prompts.items()])
    if partitions:
        d = d.repartition(partitions, "id")
    schema = "id long, " + ", ".join(f"{n} string, {n}_error string" for n in names)

    answer = _caller(client_factory, strip)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = answer()
        for pdf in batches:
            out = {"id": pdf["id"].astype("int64")}
            for n in names:
                both = [call(p) for p in pdf[f"_p_{n}"]]
                out[n], out[f"{n}_error"] = [r for r, _ in both], [e for _, e in both]
            yield pd.DataFrame(out)

    return d.mapInPandas(run, schema)


LEDGER_SCHEMA = "name string, id long, prompt_hash string, reply string, error string"
UNIT_CALLS = 2_000
_KEY = ["name", "id", "prompt_hash"]


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """All committed replies; an empty table where no unit is committed yet."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(f"{ledger}/replies")
    except AnalysisException:
        return spark.createDataFrame([], LEDGER_SCHEMA)


def ledgered(df: DataFrame, prompts: dict[str, Column], client_factory: ClientFactory, ledger: str, id_col: str = "id",
             partitions: int | None = None, strip: bool = False, unit_calls: int = UNIT_CALLS,
             retry_failed: bool = False) -> DataFrame:
    """As ``call_model_multi`` (``id`` plus ``<name>`` and ``<name>_error`` per prompt), through the ledger at the shared path ``ledger``.

    Calls without a committed reply are dealt into units of about ``unit_calls`` by a hash of their key.  With ``partitions`` one unit
    after the other is called by that many callers and appended, a job each; without it one job has a task per unit, as many callers at
    a time as it has cores, and every task appends its own replies when it ends.  ``retry_failed`` calls again where the committed call failed.
    Rows that repeat an id and a prompt are one call; a null id or prompt is a value like any other.
    """
    spark = df.sparkSession
    entries = [F.struct(F.lit(n).alias("name"), c.cast("string").alias("prompt")) for n, c in prompts.items()]
    wanted = df.select(F.col(id_col).cast("long").alias("id"), F.inline(F.array(*entries)))
    wanted = wanted.withColumn("prompt_hash", F.sha2(F.coalesce("prompt", F.lit("")).cast("binary"), 256))
    done = read_ledger(spark, ledger)
    done = (done.where("error is null") if retry_failed else done).select(*(F.col(k).alias(f"of_{k}") for k in _KEY))
    same = _same_key("of_")
    pending = wanted.join(done, same, "left_anti").groupBy(*_KEY).agg(F.first("prompt").alias("prompt"))
    run = f"{ledger}/runs/{uuid.uuid4().hex}"
    pending.write.parquet(f"{run}/calls")
    pending = spark.read.parquet(f"{run}/calls")
    units = -(-pending.count() // max(unit_calls, 1))
    unit = F.pmod(F.xxhash64(*_KEY), F.lit(max(units, 1))).cast("int")
    if units and not partitions:      # a unit is a task, and the writer of version 2 commits a task's file when the task ends
        _call_unit(pending.repartitionById(units, unit), client_factory, None, strip) \
            .write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{ledger}/replies")
    elif units:
        pending.select("*", unit.alias("unit")).repartition("unit").write.partitionBy("unit").parquet(f"{run}/units")
        calls = spark.read.parquet(f"{run}/units")      # listed once, not for every unit
        for u in range(units):
            _call_unit(calls.where(F.col("unit") == u).drop("unit"), client_factory, partitions, strip) \
                .write.mode("append").parquet(f"{ledger}/replies")
    # of several committed replies to one key (a unit that was paid twice, a failed call made again) one, real ones first
    best = F.min(F.struct(F.col("error").isNotNull().alias("bad"), "reply", "error"))
    found = read_ledger(spark, ledger).groupBy(*_KEY).agg(best.alias("r")).select(*(F.col(k).alias(f"of_{k}") for k in _KEY), "r")
    met = wanted.select(*_KEY).join(found, same, "left")
    pick = [x for n in prompts for x in (F.first(F.when(F.col("name") == n, F.col("r.reply")), ignorenulls=True).alias(n),
                                         F.first(F.when(F.col("name") == n, F.col("r.error")), ignorenulls=True).alias(f"{n}_error"))]
    return met.groupBy("id").agg(*pick)


def _same_key(prefix: str) -> Column:
    return (F.col("name") == F.col(f"{prefix}name")) & F.col("id").eqNullSafe(F.col(f"{prefix}id")) \
        & (F.col("prompt_hash") == F.col(f"{prefix}prompt_hash"))


def _call_unit(calls: DataFrame, client_factory: ClientFactory, partitions: int | None, strip: bool) -> DataFrame:
    """Ledger rows of ``(name, id, prompt_hash, prompt)`` rows."""
    if partitions:
        calls = calls.repartition(partitions, *_KEY)
    answer = _caller(client_factory, strip)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = answer()
        for pdf in batches:
            both = [call(p) for p in pdf["prompt"]]
            yield pd.DataFrame({"name": pdf["name"], "id": pdf["id"].astype("Int64"), "prompt_hash": pdf["prompt_hash"],
                                "reply": pd.Series([r for r, _ in both], dtype=object), "error": pd.Series([e for _, e in both], dtype=object)})

    return calls.select(*_KEY, "prompt").mapInPandas(run, LEDGER_SCHEMA)


def _caller(client_factory: ClientFactory, strip: bool):
    """A function that makes a task's caller: prompt → (reply, error)."""
    def make():
        client = client_factory()

        def call(prompt):
            try:
                reply = client(prompt)
                return (reply.strip() if strip and reply is not None else reply), None
            except Exception as exc:  # noqa: BLE001 - a failed call is data, not a crash
                return None, str(exc)

        return call

    return make


def persist_replies(spark: SparkSession, replies: DataFrame, name: str) -> DataFrame:
    """Write replies once under the shared checkpoint folder and read them back."""
    path = shared_path(spark, "model_replies", name)
    replies.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def classify_replies(band: DataFrame, client_factory: ClientFactory, text_col: str = "text",
                     partitions: int | None = None, ledger: str | None = None, **options) -> DataFrame:
    """Classification replies ``(id, reply, error)`` for the low band (null reply = failed call); with ``ledger``, a
    shared path, no reply that it holds is paid for again."""
    if ledger is None:
        return call_model(band, classify_prompt(text_col), client_factory, partitions=partitions)
    out = ledgered(band, {"classify": classify_prompt(text_col)}, client_factory, ledger, partitions=partitions, **options)
    return out.select("id", F.col("classify").alias("reply"), F.col("classify_error").alias("error"))


def enrichment_replies(middle: DataFrame, client_factory: ClientFactory, text_col: str = "text",
                       partitions: int | None = None, summary_only: bool = False, ledger: str | None = None, **options) -> DataFrame:
    """``(id, summary, resolution, resolution_error)`` for middle-band rows, both calls in one pass
    (only the summary with ``summary_only``).  A failed summary is ``''``; a failed resolution stays
    null and takes the router's failure path, with the error's text as reason.  ``ledger``: as in ``classify_replies``."""
    prompts = {"summary": summary_prompt(text_col)}
    if not summary_only:
        prompts["resolution"] = resolution_prompt(text_col)
    if ledger is None:
        out = call_model_multi(middle, prompts, client_factory, partitions=partitions)
    else:
        out = ledgered(middle, prompts, client_factory, ledger, partitions=partitions, **options)
    none = F.lit(None).cast("string")
    return out.select("id", F.coalesce(F.trim("summary"), F.lit("")).alias("summary"),
                      (none if summary_only else F.col("resolution")).alias("resolution"),
                      (none if summary_only else F.col("resolution_error")).alias("resolution_error"))
