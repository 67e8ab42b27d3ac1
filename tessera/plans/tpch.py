"""TPC-H-style reports over the star schema, on its columns."""

from __future__ import annotations

from tessera.registry import sql_query

sql_query(
    "tpch_q1",
    """
    SELECT l_returnflag, l_linestatus,
           round(sum(l_quantity), 2) AS sum_qty,
           round(sum(l_extendedprice), 2) AS sum_base_price,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
           round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
           round(avg(l_quantity), 6) AS avg_qty,
           round(avg(l_extendedprice), 4) AS avg_price,
           round(avg(l_discount), 6) AS avg_disc,
           count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
    GROUP BY l_returnflag, l_linestatus
    ORDER BY l_returnflag, l_linestatus
    """,
    ("lineitem",),
)
sql_query(
    "tpch_q3",
    """
    SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1997-03-15 00:00:00'
      AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10
    """,
    ("customer", "orders", "lineitem"),
)
sql_query(
    "tpch_q5",
    """
    SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = 'ASIA' GROUP BY n_name
    """,
    ("customer", "orders", "lineitem", "supplier", "nation", "region"),
)
sql_query(
    "tpch_q6",
    """
    SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n
    FROM lineitem WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24
    """,
    ("lineitem",),
)
sql_query(
    "tpch_q10",
    """
    SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, n_name
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN nation ON c_nationkey = n_nationkey WHERE l_returnflag = 'R'
    GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20
    """,
    ("customer", "orders", "lineitem", "nation"),
)
