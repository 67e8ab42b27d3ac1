"""Queries that go through the SQL front end and the statement engine."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.dialect import sql
from tessera.engine import Database
from tessera.functions import scalar
from tessera.registry import query
from tessera.session import register_views, table


@query("session_constants", "SELECT 'postgres' AS db, 'public' AS schema_name, 'postgres' AS user_name, 1 AS pid, true AS visible, 0 AS size")
def session_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"db": "current_database", "schema_name": "current_schema", "user_name": "current_user", "pid": "pg_backend_pid", "visible": "pg_table_is_visible", "size": "pg_relation_size"}
    return spark.range(1).select(*[scalar.session_constant(f).alias(n) for n, f in names.items()])


@query(
    "dialect_json",
    """SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k')::INT + 1 AS next
       FROM events WHERE json_contains(props, '{"k": 7}') OR json_extract_string(props, '$.k') = '9'""",
)
def dialect_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, ("events",))
    return sql(spark, """SELECT event_id, props ->> 'k' AS k, (props ->> 'k')::INT + 1 AS next FROM events WHERE props @> '{"k": 7}' OR props ->> 'k' = '9'""")


@query(
    "dialect_vector_topk",
    """SELECT a.vec_id FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 1) q
       ORDER BY list_sum(list_transform(list_zip(a.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), a.vec_id LIMIT 7""",
)
def dialect_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, ("embeddings",))
    q = table(spark, sf_dir, "embeddings").where("vec_id = 1").first()["embedding"]
    return sql(spark, f"SELECT vec_id FROM embeddings ORDER BY embedding <-> '[{','.join(repr(float(x)) for x in q)}]', vec_id LIMIT 7")


@query("dialect_shortest_path", "SELECT 2 AS hops, CAST(NULL AS INT) IS NULL AS unreachable")
def dialect_shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.createDataFrame([(1, 2), (2, 3)], "a bigint, b bigint").createOrReplaceTempView("dialect_links")
    return sql(spark, "SELECT SHORTEST_PATH(1, 3, 'dialect_links', 'a', 'b') AS hops, SHORTEST_PATH(3, 1, 'dialect_links', 'a', 'b') IS NULL AS unreachable")


@query(
    "database_statements",
    """SELECT n_nationkey + CASE WHEN n_regionkey = 2 THEN 100 ELSE 0 END AS id, n_name AS name FROM nation WHERE n_regionkey <> 3
       UNION ALL VALUES (900, 'EXTRA')""",
)
def database_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, ("nation",))
    db, t = Database(spark), f"t_{uuid.uuid4().hex}"
    db.execute(f"CREATE TABLE {t} (id INTEGER PRIMARY KEY, name TEXT, region INT)")
    db.execute(f"INSERT INTO {t} SELECT n_nationkey, n_name, n_regionkey FROM nation")
    db.execute(f"INSERT INTO {t} (id, name) VALUES (900, 'EXTRA')")
    db.execute(f"UPDATE {t} SET id = id + 100 WHERE region = 2")
    db.execute(f"DELETE FROM {t} WHERE region = 3")
    return db.execute(f"SELECT id, name FROM {t}").select(F.col("id"), F.col("name"))


def _next_orders(spark: SparkSession, sf_dir: str) -> None:
    """``order_links`` (a, b): each order and the customer's next one."""
    register_views(spark, sf_dir, ("orders",))
    spark.sql(
        """SELECT o_orderkey AS a, b FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders)
           WHERE b IS NOT NULL"""
    ).createOrReplaceTempView("order_links")


_LINKS = """l AS (SELECT * FROM (SELECT o_orderkey AS a, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS b FROM orders) t
    WHERE b IS NOT NULL)"""


@query("sql_recursive_union", f"WITH RECURSIVE {_LINKS}, r AS (SELECT o_orderkey AS node FROM orders WHERE o_orderkey < 5 UNION SELECT b FROM r JOIN l ON a = node) SELECT node FROM r")
def sql_recursive_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    _next_orders(spark, sf_dir)
    return sql(spark, "WITH RECURSIVE r AS (SELECT o_orderkey AS node FROM orders WHERE o_orderkey < 5 UNION SELECT b FROM r JOIN order_links ON a = node) SELECT node FROM r")


@query(
    "sql_depth",
    f"""WITH RECURSIVE {_LINKS}, r AS (SELECT o_orderkey AS node, 1::BIGINT AS depth FROM orders WHERE o_orderkey < 20 UNION ALL SELECT b, depth + 1 FROM r JOIN l ON a = node)
        SELECT DISTINCT node, depth FROM r""",
)
def sql_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    _next_orders(spark, sf_dir)
    text = """WITH RECURSIVE r(node, depth) AS (SELECT o_orderkey, CAST(1 AS BIGINT) FROM orders WHERE o_orderkey < 20 UNION ALL SELECT b, DEPTH() FROM r JOIN order_links ON a = node)
              SELECT node, depth FROM r"""
    return sql(spark, text)


@query("sql_cycle", "WITH RECURSIVE r AS (SELECT 1::BIGINT AS node UNION SELECT (node * 7 + 3) % 25 FROM r) SELECT node FROM r")
def sql_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, "WITH RECURSIVE r AS (SELECT CAST(1 AS BIGINT) AS node UNION ALL SELECT (node * 7 + 3) % 25 FROM r) SELECT node FROM r")


@query(
    "sql_shortest_path_rows",
    """WITH RECURSIVE r AS (SELECT n_nationkey AS source, n_nationkey AS node, 0 AS hops FROM nation UNION ALL SELECT source, (node * 7 + 3) % 25, hops + 1 FROM r WHERE hops < 25)
       SELECT n_nationkey, (SELECT min(hops) FROM r WHERE source = n_nationkey AND node = n_regionkey) AS hops FROM nation""",
)
def sql_shortest_path_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, ("nation",))
    spark.sql("SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation").createOrReplaceTempView("nation_links")
    return sql(spark, "SELECT n_nationkey, SHORTEST_PATH(n_nationkey, n_regionkey, 'nation_links', 'a', 'b') AS hops FROM nation")


@query(
    "sql_pagerank_node",
    """WITH RECURSIVE n AS (SELECT n_nationkey::BIGINT AS id, ((n_nationkey * 7 + 3) % 25)::BIGINT AS dst FROM nation),
       w AS (SELECT id AS src, dst, 1.0::DOUBLE AS share FROM n UNION ALL SELECT id, id, 0.0::DOUBLE FROM n),
       pr AS (SELECT 0 AS it, id, 1.0::DOUBLE / 25 AS r FROM n
              UNION ALL SELECT it + 1, w.dst, 0.15 / 25 + 0.85 * sum(r * share) FROM pr JOIN w ON w.src = pr.id WHERE it < 20 GROUP BY it + 1, w.dst)
       SELECT id AS node, round(r, 10) AS rank FROM pr WHERE it = 20""",
)
def sql_pagerank_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, ("nation",))
    spark.sql("SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation").createOrReplaceTempView("nation_links")
    return sql(spark, "SELECT node, round(PAGERANK(node, 'nation_links', 'a', 'b'), 10) AS rank FROM (SELECT CAST(n_nationkey AS BIGINT) AS node FROM nation)")


@query(
    "sql_types_and_names",
    """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS cust, o_custkey // 7 AS seventh, o_totalprice / 2 AS half, CAST(strlen(o_orderpriority || 'é') AS BIGINT) AS n_bytes,
              pow(o_custkey % 5, 2) AS square FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 50""",
)
def sql_types_and_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, ("orders",))
    text = """SELECT "o_orderkey", o_custkey::text AS cust, o_custkey / 7 AS seventh, o_totalprice / 2 AS half, LENGTH(o_orderpriority || 'é') AS n_bytes,
                     (o_custkey % 5) ^ 2 AS square FROM orders WHERE o_orderstatus = $1 AND o_custkey < $2"""
    return sql(spark, text, ["F", "50"])


@query(
    "sql_session_functions",
    """SELECT 'PostgreSQL 14.0' AS v, 'postgres' AS d, 'public' AS s, 1::BIGINT AS pid, 'UTF8' AS enc, 'postgres' AS who, 'text' AS kind, true AS visible, 0::BIGINT AS size,
              '"a"' AS ident, chr(39) || 'b' || chr(39) AS lit""",
)
def sql_session_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """SELECT VERSION() AS v, CURRENT_DATABASE() AS d, current_schema AS s, pg_backend_pid() AS pid, PG_ENCODING_TO_CHAR(6) AS enc, PG_GET_USERBYID(10) AS who,
                     pg_catalog.FORMAT_TYPE(25, NULL) AS kind, PG_TABLE_IS_VISIBLE(1) AS visible, PG_RELATION_SIZE('t') AS size, QUOTE_IDENT('a') AS ident, QUOTE_LITERAL('b') AS lit"""
    return sql(spark, text)


@query(
    "sql_json_columns",
    """SELECT event_id, json_extract_string(props, '$.k') AS v, json_contains(props, '{"k": ' || (event_id % 9) || '}') AS has, true AS within, list_has_any(json_keys(props), ['k', 'z']) AS some
       FROM events""",
)
def sql_json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, ("events",))
    text = """SELECT event_id, props ->> name AS v, props @> pattern AS has, props <@ props AS within, props ?| array('k', 'z') AS some
              FROM (SELECT event_id, props, 'k' AS name, concat('{"k": ', event_id % 9, '}') AS pattern FROM events)"""
    return sql(spark, text)


@query("database_indexes", "SELECT event_id FROM events WHERE json_contains(props, '{\"k\": 3}')")
def database_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, t = Database(spark), f"t_{uuid.uuid4().hex}"
    register_views(spark, sf_dir, ("events",))
    db.execute(f"CREATE TABLE {t} (event_id INT, props JSONB)")
    db.execute(f"CREATE GIN INDEX ON {t} (props)")
    for rest in (0, 1):
        db.execute(f"INSERT INTO {t} SELECT event_id, props FROM events WHERE event_id % 2 = {rest}")
    return db.execute(f"SELECT event_id FROM {t} WHERE props @> '{{\"k\": 3}}'")


@query(
    "database_vectors",
    """SELECT vec_id FROM embeddings e, (SELECT embedding AS q FROM embeddings WHERE vec_id = 1) ORDER BY
       list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), vec_id LIMIT 1""",
)
def database_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest row by the table's index: the vector itself, whatever lists are left out."""
    db, t = Database(spark), f"t_{uuid.uuid4().hex}"
    register_views(spark, sf_dir, ("embeddings",))
    db.execute(f"CREATE TABLE {t} (vec_id BIGINT, embedding VECTOR)")
    db.execute(f"INSERT INTO {t} SELECT vec_id, to_json(embedding) FROM embeddings")
    db.execute(f"CREATE VECTOR INDEX ON {t} (embedding)")
    q = table(spark, sf_dir, "embeddings").where("vec_id = 1").first()["embedding"]
    return db.execute(f"SELECT vec_id FROM {t} ORDER BY embedding <-> '[{','.join(repr(float(x)) for x in q)}]', vec_id LIMIT 1")


@query(
    "database_returning",
    "SELECT r_regionkey + 10 AS r_regionkey, r_name FROM region",
)
def database_returning(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_views(spark, sf_dir, ("region",))
    db, t = Database(spark), f"t_{uuid.uuid4().hex}"
    db.execute(f"CREATE TABLE {t} (r_regionkey BIGINT, r_name TEXT)")
    return db.execute(f"INSERT INTO {t} SELECT r_regionkey + 10, r_name FROM region RETURNING r_regionkey, r_name")


@query(
    "database_administration",
    """SELECT * FROM (VALUES (0, 'CREATE TABLE'), (1, 'BEGIN'), (2, 'INSERT 0 2'), (3, 'COMMIT'), (4, 'ALTER TABLE'), (5, 'CREATE INDEX'), (6, 'VACUUM'), (7, 'UTC'), (8, 'CREATE VIEW'), (9, 'DROP VIEW'),
       (10, 'DELETE 1'), (11, 'true'), (12, 'DROP TABLE')) t(step, status)""",
)
def database_administration(spark: SparkSession, sf_dir: str) -> DataFrame:
    db, t = Database(spark), f"t_{uuid.uuid4().hex}"
    steps = [
        f"CREATE TABLE {t} (id INT, name TEXT)", "BEGIN", f"INSERT INTO {t} VALUES (1, 'a'), (2, 'b')", "COMMIT", f"ALTER TABLE {t} ADD COLUMN size INT", f"CREATE INDEX ON {t} (id)",
        f"VACUUM {t}", "SHOW spark.sql.session.timeZone", f"CREATE VIEW v_{t} AS SELECT * FROM {t}", f"DROP VIEW v_{t}", f"DELETE FROM {t} WHERE id = 1", f"EXPLAIN SELECT * FROM {t}", f"DROP TABLE {t}",
    ]
    rows = []
    for i, step in enumerate(steps):
        found = db.execute(step).collect()
        rows.append((i, found[0][-1] if not step.startswith("EXPLAIN") else str(any("Scan" in r.plan for r in found)).lower()))
    return spark.createDataFrame(rows, "step int, status string")


@query("sql_times", "SELECT true AS same, true AS past, '2024-02-29' AS day, 29 AS d")
def sql_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, "SELECT now() = TRANSACTION_TIMESTAMP() AS same, CLOCK_TIMESTAMP() > TIMESTAMP '2024-01-01' AS past, ('2024-02-29'::date)::text AS day, day('2024-02-29'::date) AS d")
