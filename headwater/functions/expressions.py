"""Column expressions that look at one SQL expression or one script text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The transformation classes and the names of aggregates.
TRANSFORMATIONS = ["direct_copy", "aggregation", "calculation", "conditional", "constant"]
AGGREGATES = ["SUM", "COUNT", "AVG", "MAX", "MIN", "STDEV", "STRING_AGG"]
CLOCK_CALLS = ["GETDATE()", "CURRENT_TIMESTAMP", "SYSDATETIME()"]

_QUOTED = r"(?s)'(?:[^']++|'')*+'|\"[^\"]*+\"|\[[^\]]*+\]"
_NAME = r'(?:\[[^\]]*\]|"[^"]*"|[\p{L}_#@$][\p{L}\p{N}_#@$]*)'


def _outside_quotes(c: Column) -> Column:
    """The expression with literals and quoted names blanked, so words in them do not count."""
    return F.regexp_replace(c, _QUOTED, "q")


def is_constant(c: Column) -> Column:
    t = F.trim(c)
    return F.coalesce(
        t.rlike(r"^(?s:[Nn]?'(?:[^']++|'')*+'|\"[^\"]*+\")$")
        | t.rlike(r"^[-+]?\s*\d+(?:\.\d+)?$")
        | F.upper(t).isin(*CLOCK_CALLS, "NULL"),
        F.lit(False),
    )


def classify(c: Column) -> Column:
    """Transformation class of a select expression; the first rule that holds wins."""
    plain = _outside_quotes(c)
    bare = F.regexp_replace(c, rf"{_NAME}\s*\.\s*(?=[\[\"\p{{L}}_#@$*])", "")
    called = lambda names: plain.rlike(r"(?i)\b(?:" + "|".join(names) + r")\s*\(")
    return (
        F.when(is_constant(c), "constant")
        .when(F.trim(bare).rlike(rf"^(?:{_NAME}|\*)$"), "direct_copy")
        .when(plain.rlike(r"(?is)\bCASE\b.*\bWHEN\b"), "conditional")
        .when(called(AGGREGATES), "aggregation")
        .otherwise("calculation")
    )


def utc_iso(ts: Column | None = None) -> Column:
    ts = F.current_timestamp() if ts is None else ts
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def snippet(c: Column) -> Column:
    """First 300 characters, the excerpt a failure record shows."""
    return F.substring(c, 1, 300)
