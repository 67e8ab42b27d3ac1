"""Catalog views as DataFrames, made from the session's own tables and views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Object numbers of user tables start here.
FIRST_OID = 16384
# Type name, oid, length, category.
TYPES = [
    ("bool", 16, 1, "B"),
    ("bytea", 17, -1, "U"),
    ("int8", 20, 8, "N"),
    ("int2", 21, 2, "N"),
    ("int4", 23, 4, "N"),
    ("text", 25, -1, "S"),
    ("float4", 700, 4, "N"),
    ("float8", 701, 8, "N"),
    ("varchar", 1043, -1, "S"),
    ("date", 1082, 4, "D"),
    ("timestamp", 1114, 8, "D"),
]
_SQL_NAMES = {"bigint": "bigint", "int": "bigint", "smallint": "bigint", "double": "double precision", "float": "double precision", "boolean": "boolean"}
_TYPE_OIDS = {"bigint": 20, "double precision": 701, "boolean": 16, "text": 25}


def _tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def _columns(spark: SparkSession) -> list[tuple[int, str, int, str, str, bool]]:
    out = []
    for i, t in enumerate(_tables(spark)):
        for n, f in enumerate(spark.table(t).schema, 1):
            out.append((FIRST_OID + i, t, n, f.name, _SQL_NAMES.get(f.dataType.simpleString(), "text"), f.nullable))
    return out


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _views() -> dict[str, Callable[[SparkSession], DataFrame]]:
    return {
        "pg_type": lambda s: _frame(
            s,
            [(oid, name, 11, size, "b", cat) for name, oid, size, cat in TYPES],
            "oid bigint, typname string, typnamespace bigint, typlen bigint, typtype string, typcategory string",
        ),
        "pg_namespace": lambda s: _frame(s, [(11, "pg_catalog"), (2200, "public")], "oid bigint, nspname string"),
        "pg_database": lambda s: _frame(s, [(1, "postgres", 6)], "oid bigint, datname string, encoding bigint"),
        "pg_user": lambda s: _frame(s, [("postgres", 10, True, True)], "usename string, usesysid bigint, usecreatedb boolean, usesuper boolean"),
        "pg_roles": lambda s: _frame(s, [("postgres", 10, True, True)], "rolname string, oid bigint, rolcreatedb boolean, rolsuper boolean"),
        "pg_class": lambda s: _frame(s, [(FIRST_OID + i, t, 2200, "r") for i, t in enumerate(_tables(s))], "oid bigint, relname string, relnamespace bigint, relkind string"),
        "pg_tables": lambda s: _frame(s, [("public", t, "postgres", False) for t in _tables(s)], "schemaname string, tablename string, tableowner string, hasindexes boolean"),
        "pg_attribute": lambda s: _frame(
            s,
            [(oid, c, _TYPE_OIDS[kind], n, not null, False) for oid, _, n, c, kind, null in _columns(s)],
            "attrelid bigint, attname string, atttypid bigint, attnum bigint, attnotnull boolean, atthasdef boolean",
        ),
        "pg_indexes": lambda s: _frame(s, [], "schemaname string, tablename string, indexname string, indexdef string"),
        "pg_constraint": lambda s: _frame(s, [], "oid bigint, conname string, conrelid bigint, contype string"),
        "pg_stat_user_tables": lambda s: _frame(s, [(FIRST_OID + i, "public", t, 0) for i, t in enumerate(_tables(s))], "relid bigint, schemaname string, relname string, n_live_tup bigint"),
        "information_schema.tables": lambda s: _frame(
            s, [("postgres", "public", t, "BASE TABLE") for t in _tables(s)], "table_catalog string, table_schema string, table_name string, table_type string"
        ),
        "information_schema.columns": lambda s: _frame(
            s,
            [("public", t, c, n, "YES" if null else "NO", kind) for _, t, n, c, kind, null in _columns(s)],
            "table_schema string, table_name string, column_name string, ordinal_position bigint, is_nullable string, data_type string",
        ),
        "information_schema.schemata": lambda s: _frame(s, [("postgres", "public"), ("postgres", "pg_catalog")], "catalog_name string, schema_name string"),
        "information_schema.views": lambda s: _frame(s, [], "table_schema string, table_name string, view_definition string"),
    }


CATALOG_VIEWS = tuple(_views())


def catalog_view(spark: SparkSession, name: str) -> DataFrame:
    """One view by its name, with or without ``pg_catalog.``."""
    return _views()[name.lower().removeprefix("pg_catalog.")](spark)
