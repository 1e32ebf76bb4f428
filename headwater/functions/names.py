"""Identifier helpers. Every function maps a Column to a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def table_key(c: Column) -> Column:
    """Identity of a table reference: last dotted part, without quotes, upper case."""
    last = F.element_at(F.split(F.replace(_trim_ws(c), F.lit('"'), F.lit("")), r"\."), -1)
    return F.upper(_trim_ws(F.regexp_replace(last, r"^[\[\]]+|[\[\]]+$", "")))


def table_key_with_schema(c: Column) -> Column:
    """Identity that keeps the schema part (`SCHEMA.TABLE`) when there is one."""
    parts = name_parts(c)
    schema, table = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))
    return F.upper(F.concat_ws(".", F.nullif(_trim_ws(schema), F.lit("")), _trim_ws(table)))


def file_name(path: Column) -> Column:
    """Bare file name, the identity of a script."""
    return F.element_at(F.split(path, "/"), -1)


def drop_brackets(c: Column) -> Column:
    return F.translate(c, "[]", "")


def unquote(c: Column) -> Column:
    """Remove one matching pair of brackets, double quotes or backticks."""
    return F.regexp_replace(_trim_ws(c), r'(?s)^(?:\[(.*)\]|"(.*)"|`(.*)`)$', "$1$2$3")


def name_parts(c: Column) -> Column:
    """Split a dotted name into clean parts; dots inside quotes do not split."""
    rx = r'(?:\[[^\]]*\]|"[^"]*"|`[^`]*`|[^.\[\]"`])+'
    return F.transform(F.regexp_extract_all(c, F.lit(rx), F.lit(0)), unquote)


def db_schema_table(c: Column) -> Column:
    """Struct of database, schema and table taken from the last three parts."""
    parts = name_parts(c)
    return F.struct(
        F.try_element_at(parts, F.lit(-3)).alias("db"),
        F.try_element_at(parts, F.lit(-2)).alias("schema"),
        F.try_element_at(parts, F.lit(-1)).alias("table_name"),
    )
