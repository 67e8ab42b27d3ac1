"""Scalar functions beyond Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_length(s: Column) -> Column:
    """Length in UTF-8 bytes."""
    return F.octet_length(s).cast("bigint")


def quote_ident(s: Column) -> Column:
    """The text in double quotes."""
    return F.concat(F.lit('"'), s, F.lit('"'))


def quote_literal(s: Column) -> Column:
    """The text in single quotes, with inner ones doubled."""
    return F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("''")), F.lit("'"))


def truthy(c: Column, kind: str) -> Column:
    """Whether a value counts as true: non-zero numbers, non-empty text."""
    if kind == "boolean":
        return c
    return c != "" if kind == "string" else c != 0


# Fixed values that clients of a PostgreSQL-style catalog ask for.
SESSION_CONSTANTS = {
    "version": "PostgreSQL 14.0",
    "current_database": "postgres",
    "current_catalog": "postgres",
    "current_schema": "public",
    "current_user": "postgres",
    "session_user": "postgres",
    "current_schemas": "public",
    "pg_encoding_to_char": "UTF8",
    "pg_get_userbyid": "postgres",
    "format_type": "text",
    "pg_backend_pid": 1,
    "pg_table_is_visible": True,
    "pg_type_is_visible": True,
    "pg_relation_size": 0,
    "pg_total_relation_size": 0,
    "pg_database_size": 0,
    "obj_description": None,
    "col_description": None,
    "shobj_description": None,
    "pg_get_expr": None,
}


def session_constant(name: str) -> Column:
    """A session or catalog function without an effect here."""
    value = SESSION_CONSTANTS[name.lower()]
    return F.lit(value) if value is not None else F.lit(None).cast("string")
