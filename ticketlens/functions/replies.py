"""Native parsing of model replies (JSON objects embedded in free text)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col

# First ``{...}`` of a text, non-greedy and across newlines.
FIRST_OBJECT_RE = r"(?s)\{.*?\}"


def parse_reply(c: str | Column) -> Column:
    """Tolerant JSON parse → VARIANT holding an *object*, or null.

    Whole text first, else the first non-greedy ``{...}`` span; arrays, scalars and
    broken JSON give null.  An empty object ``{}`` is a valid reply, not an error.
    """
    t = _col(c)
    whole = F.try_parse_json(t)
    span = F.try_parse_json(F.nullif(F.regexp_extract(t, FIRST_OBJECT_RE, 0), F.lit("")))
    v = F.coalesce(whole, span)
    return F.when(F.schema_of_variant(v).startswith("OBJECT"), v)


def reply_field(v: str | Column, key: str, default: str | Column | None = None) -> Column:
    """String value of ``$.key`` in a parsed reply, with a default when absent."""
    got = F.try_variant_get(_col(v), f"$.{key}", "string")
    if default is None:
        return got
    d = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(got, d)


def py_bool_text(c: Column) -> Column:
    """Text of a boolean the way Python's ``str`` writes it: ``True`` / ``False``."""
    return F.when(c.isNull(), F.lit(None)).when(c, F.lit("True")).otherwise(F.lit("False"))


def reply_text_field(v: str | Column, key: str, default: str = "") -> Column:
    """``str(reply.get(key, default))``: booleans become ``True``/``False``, strings stay."""
    var = _col(v)
    as_bool = F.try_variant_get(var, f"$.{key}", "boolean")
    is_bool = F.schema_of_variant(F.variant_get(var, f"$.{key}", "variant")) == F.lit("BOOLEAN")
    return F.when(is_bool, py_bool_text(as_bool)).otherwise(reply_field(var, key, default))
