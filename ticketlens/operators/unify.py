"""Unify social messages and structured tickets into one labelled-provenance table.

``unify_sources`` = inbound filter → structured mapping → union → drop null
descriptions → preference dedup (real before weak, social before structured,
then lowest ``id``) — one ``row_number`` window whose ``rn = 1`` filter Catalyst
turns into a ``WindowGroupLimit``, so every map task forwards at most one row per
description into the shuffle, however hot the description is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import lookup as LK
from ..functions import text as TX

UNIFIED_COLUMNS = ("id", "subject", "description", "category", "priority", "label_source", "source")

SOCIAL_SOURCE = "twitter_support"
STRUCTURED_SOURCE = "structured_tickets"

# Raw column names of the structured ticket export → our names.
STRUCTURED_ALIASES: dict[str, str] = {
    "Ticket Subject": "subject",
    "Ticket Description": "description",
    "Ticket Type": "_raw_ticket_type",
    "Ticket Priority": "_raw_priority",
}
# The fixture view already names subject/description; only type and priority are raw.
FIXTURE_TICKET_COLUMNS = {"aliases": {"type": "_raw_ticket_type", "priority": "_raw_priority"}}


def _has(df: DataFrame, c: str) -> bool:
    return c in df.columns


def inbound_only(df: DataFrame, inbound_col: str = "inbound") -> DataFrame:
    """Keep customer-authored rows (``inbound`` true; null drops). No-op without the column."""
    if not _has(df, inbound_col):
        return df
    return df.filter(F.col(inbound_col) == F.lit(True))


def social_to_unified(df: DataFrame, text_col: str = "text", id_col: str = "id") -> DataFrame:
    """Social messages: subject = description = text, weak provenance, no real labels."""
    df = inbound_only(df)
    text = F.col(text_col) if _has(df, text_col) else F.lit("")
    return df.select(
        F.col(id_col).alias("id"),
        text.alias("subject"),
        text.alias("description"),
        F.lit("customer_message").alias("category"),
        F.lit("").alias("priority"),
        F.lit("weak").alias("label_source"),
        F.lit(SOCIAL_SOURCE).alias("source"),
    )


def map_structured(df: DataFrame, aliases: dict[str, str] | None = None,
                   type_map: dict[str, str] | None = None,
                   priority_map: dict[str, str] | None = None,
                   id_col: str = "id") -> DataFrame:
    """Structured tickets → unified schema with real labels where the type maps.

    Only aliases whose raw column exists are applied; a missing subject or
    description is filled from the other; a missing type column gives
    ``category=''`` with weak provenance, a missing priority ``''``.
    """
    aliases = STRUCTURED_ALIASES if aliases is None else aliases
    type_map = C.TICKET_TYPE_MAP if type_map is None else type_map
    priority_map = C.TICKET_PRIORITY_MAP if priority_map is None else priority_map

    cols: dict[str, Column] = {c: F.col(f"`{c}`") for c in df.columns}
    for src, dst in aliases.items():
        if src in df.columns:
            cols[dst] = F.col(f"`{src}`")
    subject = cols.get("subject")
    description = cols.get("description")
    if subject is None:
        subject = description if description is not None else F.lit("")
    if description is None:
        description = subject

    raw_type = cols.get("_raw_ticket_type")
    if raw_type is not None:
        mapped = LK.map_lookup(TX.canon_key(raw_type), type_map)
        category = F.coalesce(mapped, F.lit("other"))
        label_source = F.when(mapped.isNotNull(), F.lit("real")).otherwise(F.lit("weak"))
    else:
        category, label_source = F.lit(""), F.lit("weak")

    raw_priority = cols.get("_raw_priority")
    priority = (F.coalesce(LK.map_lookup(TX.canon_key(raw_priority), priority_map), F.lit(""))
                if raw_priority is not None else F.lit(""))

    return df.select(
        F.col(id_col).alias("id"),
        subject.alias("subject"),
        description.alias("description"),
        category.alias("category"),
        priority.alias("priority"),
        label_source.alias("label_source"),
        F.lit(STRUCTURED_SOURCE).alias("source"),
    )


def preference_dedup(df: DataFrame, key: str = "description") -> DataFrame:
    """One row per ``key``: real before weak, social before structured, then lowest id."""
    rank = F.when(F.col("label_source") == "real", F.lit(0)).otherwise(F.lit(1))
    src_ord = F.when(F.col("source") == SOCIAL_SOURCE, F.lit(0)).otherwise(F.lit(1))
    w = Window.partitionBy(key).orderBy(rank, src_ord, F.col("id"))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def unify_sources(social: DataFrame, tickets: DataFrame, aliases: dict[str, str] | None = None,
                  type_map: dict[str, str] | None = None,
                  priority_map: dict[str, str] | None = None) -> DataFrame:
    s = social_to_unified(social)
    t = map_structured(tickets, aliases=aliases, type_map=type_map, priority_map=priority_map)
    u = s.unionByName(t).filter(F.col("description").isNotNull())
    return preference_dedup(u).select(*UNIFIED_COLUMNS)
