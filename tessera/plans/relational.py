"""Scans, filters, joins, aggregates, windows, set operations and CTEs as SQL.

Texts are written in the common subset of both dialects, so most need no other oracle.
Row order is explicit wherever a limit depends on it, and ties have a last key.
"""

from __future__ import annotations

from tessera.registry import sql_query as q

# Scans and sources
q("scan_nation", "SELECT n_nationkey, n_name, n_regionkey FROM nation", ("nation",))
q("scan_all_region", "SELECT * FROM region", ("region",))
q("scan_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900", ("orders",))
q("pk_lookup", "SELECT * FROM orders WHERE o_orderkey = 77", ("orders",))
q("select_without_from", "SELECT 1 + 2 AS three, 'a' || 'b' AS ab, CAST(NULL AS INT) IS NULL AS is_null", ())
q("scan_columnar_agg", "SELECT count(*) AS n, CAST(max(l_linenumber) AS BIGINT) AS top FROM lineitem", ("lineitem",))
q("scan_zone_pruned", "SELECT count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem WHERE l_orderkey <= 500", ("lineitem",))

# Filters and expressions
q("filter_compare", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 45 AND l_discount <> 0.05 AND l_tax < 0.04", ("lineitem",))
q("filter_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20", ("part",))
q("filter_not_between", "SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 10 AND 40", ("part",))
q("filter_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')", ("orders",))
q("filter_not_in", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'P')", ("orders",))
q("filter_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'S%L_'", ("part",))
q("filter_not_like", "SELECT p_partkey FROM part WHERE p_type NOT LIKE 'S%'", ("part",))
q(
    "filter_null",
    """SELECT n_nationkey, NULLIF(n_regionkey, 2) IS NULL AS gone FROM nation
       WHERE NULLIF(n_regionkey, 1) IS NOT NULL""",
    ("nation",),
)
q(
    "filter_null_logic",
    """SELECT n_nationkey, (NULLIF(n_regionkey, 1) = 2 OR n_nationkey > 5) AS either,
              (NULLIF(n_regionkey, 1) = 2 AND n_nationkey > 5) AS both_hold FROM nation""",
    ("nation",),
)
q("filter_bool_logic", "SELECT c_custkey FROM customer WHERE NOT (c_acctbal < 0 OR c_mktsegment = 'BUILDING') AND c_nationkey % 3 = 1", ("customer",))
q("filter_truthiness", "SELECT n_nationkey, n_regionkey <> 0 AS truthy FROM nation WHERE n_regionkey <> 0", ("nation",))
q("project_arith", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax, 4) AS net, -l_quantity AS minus FROM lineitem", ("lineitem",))
q(
    "int_div_mod",
    "SELECT o_orderkey, (o_orderkey - 700) DIV 7 AS quotient, (o_orderkey - 700) % 7 AS remainder FROM orders",
    ("orders",),
    "SELECT o_orderkey, (o_orderkey - 700) // 7 AS quotient, (o_orderkey - 700) % 7 AS remainder FROM orders",
)
q("power_op", "SELECT n_nationkey, power(n_nationkey, 2) AS square FROM nation", ("nation",))
q(
    "cast_types",
    """SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) AS as_double, CAST(o_orderkey AS VARCHAR(20)) AS as_text,
              CAST('42' AS INT) AS as_int, CAST(o_orderkey % 2 AS BOOLEAN) AS as_bool FROM orders""",
    ("orders",),
)
q("case_when", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS band FROM part", ("part",))
q("coalesce_expr", "SELECT n_nationkey, coalesce(NULLIF(n_regionkey, 1), -1) AS region FROM nation", ("nation",))
q("exists_subquery", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)", ("customer", "orders"))
q("in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)", ("supplier", "nation"))
q("scalar_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) + 5000 FROM customer)", ("customer",))

# Joins
q("join_inner_hash", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey", ("orders", "customer"))
q("join_theta", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey > b.n_regionkey", ("nation",))
q(
    "join_compound_on",
    "SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal > c_acctbal + 9000",
    ("supplier", "customer"),
    pairs=("customer", "supplier"),
)
q("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000", ("customer", "orders"))
q("join_right", "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey", ("supplier", "nation"))
q(
    "join_full",
    """SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_suppkey < 60) s
       FULL OUTER JOIN (SELECT * FROM customer WHERE c_custkey BETWEEN 40 AND 90) c ON s_suppkey = c_custkey""",
    ("supplier", "customer"),
)
q("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation", ("region", "nation"))
q(
    "join_using",
    """SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) x
       JOIN (SELECT r_regionkey AS k, r_name FROM region) y USING (k)""",
    ("nation", "region"),
)
q("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey", ("supplier",), pairs=("supplier", "supplier"))
q(
    "join_chain3",
    """SELECT c_custkey, o_orderkey, l_linenumber FROM customer JOIN orders ON c_custkey = o_custkey
       JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 48""",
    ("customer", "orders", "lineitem"),
)
q(
    "join_chain5",
    """SELECT n_name, count(*) AS n, round(sum(l_extendedprice), 2) AS revenue FROM customer
       JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
       JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""",
    ("customer", "orders", "lineitem", "supplier", "nation"),
)
q("join_comma", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey", ("nation", "region"))
q(
    "join_semi",
    "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey",
    ("customer", "orders"),
    "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey",
)
q(
    "join_anti",
    "SELECT c_custkey FROM customer LEFT ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON c_custkey = o_custkey",
    ("customer", "orders"),
    "SELECT c_custkey FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON c_custkey = o_custkey",
)
q("join_cte_table", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 400000) SELECT c_name, o_totalprice FROM big JOIN customer ON c_custkey = o_custkey", ("orders", "customer"))
q(
    "join_null_keys",
    """SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM (SELECT n_nationkey, NULLIF(n_regionkey, 1) AS k FROM nation) a
       LEFT JOIN (SELECT r_regionkey, NULLIF(r_regionkey, 1) AS k FROM region) b ON a.k = b.k""",
    ("nation", "region"),
)

# Aggregates
q("agg_count", "SELECT o_orderstatus, count(*) AS n, count(NULLIF(o_orderpriority, '5-LOW')) AS n_set FROM orders GROUP BY o_orderstatus", ("orders",))
q(
    "agg_sum_avg_min_max",
    """SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS s, round(avg(l_quantity), 6) AS a,
              min(l_shipdate) AS first_day, max(l_extendedprice) AS top FROM lineitem GROUP BY l_returnflag""",
    ("lineitem",),
)
q("agg_global", "SELECT count(*) AS n, round(avg(c_acctbal), 6) AS a FROM customer", ("customer",))
q("agg_global_empty", "SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, max(o_totalprice) AS m FROM orders WHERE o_orderkey < 0", ("orders",))
q("agg_count_distinct", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus", ("orders",))
q(
    "agg_array",
    "SELECT n_regionkey, to_json(sort_array(collect_list(n_name))) AS names FROM nation GROUP BY n_regionkey",
    ("nation",),
    "SELECT n_regionkey, CAST(to_json(list(n_name ORDER BY n_name)) AS VARCHAR) AS names FROM nation GROUP BY n_regionkey",
)
q(
    "agg_array_nulls",
    """SELECT n_regionkey, to_json(transform(array_sort(collect_list(struct(n_nationkey, NULLIF(n_nationkey % 4, 1) AS v))), x -> x.v),
              map('ignoreNullFields', 'false')) AS vals FROM nation GROUP BY n_regionkey""",
    ("nation",),
    "SELECT n_regionkey, CAST(to_json(list(NULLIF(n_nationkey % 4, 1) ORDER BY n_nationkey)) AS VARCHAR) AS vals FROM nation GROUP BY n_regionkey",
)
q(
    "agg_string",
    "SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    ("nation",),
    "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
)
q("agg_expr", "SELECT o_orderstatus, round(sum(o_totalprice) / count(*), 4) AS mean, max(o_totalprice) - min(o_totalprice) AS width FROM orders GROUP BY o_orderstatus", ("orders",))
q("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12", ("orders",))
q("agg_having_alias", "SELECT * FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) g WHERE n > 55", ("customer",))
q("agg_group_expr", "SELECT o_orderkey % 10 AS bucket, count(*) AS n FROM orders GROUP BY o_orderkey % 10", ("orders",))
q("agg_group_ordinal", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1", ("orders",))
q("agg_group_null", "SELECT NULLIF(n_regionkey, 3) AS k, count(*) AS n FROM nation GROUP BY NULLIF(n_regionkey, 3)", ("nation",))
q("agg_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS n_big FROM orders GROUP BY o_orderstatus", ("orders",))
q("agg_stddev", "SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS sd, round(var_pop(c_acctbal), 2) AS v FROM customer GROUP BY c_mktsegment", ("customer",))
q(
    "agg_percentile",
    "SELECT c_mktsegment, round(percentile(c_acctbal, 0.5), 4) AS median FROM customer GROUP BY c_mktsegment",
    ("customer",),
    "SELECT c_mktsegment, round(quantile_cont(c_acctbal, 0.5), 4) AS median FROM customer GROUP BY c_mktsegment",
)
q("select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", ("lineitem",))
q("agg_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", ("lineitem",))
q("agg_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", ("orders",))
q("agg_grouping_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())", ("orders",))

# Windows
q("win_row_number", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn FROM orders", ("orders",))
q("win_rank", "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS BIGINT) AS r, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS BIGINT) AS dr FROM part", ("part",))
q("win_lag", "SELECT o_orderkey, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), -1) AS before FROM orders", ("orders",))
q("win_lead", "SELECT o_orderkey, coalesce(lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), -1) AS after FROM orders", ("orders",))
q("win_lag_offset2", "SELECT o_orderkey, coalesce(lag(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), -1) AS before FROM orders", ("orders",))
q(
    "win_two_windows",
    """SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS by_customer,
              CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS BIGINT) AS by_priority FROM orders""",
    ("orders",),
)
q("win_running_sum", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running FROM orders", ("orders",))
q(
    "win_frame",
    "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 4) AS smooth FROM orders",
    ("orders",),
)
q("win_ntile", "SELECT s_suppkey, CAST(ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS BIGINT) AS quarter FROM supplier", ("supplier",))
q(
    "win_first_last",
    """SELECT s_suppkey, first_value(s_suppkey) OVER w AS first_key, last_value(s_suppkey) OVER w AS last_key FROM supplier
       WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    ("supplier",),
)

# Order and limit
q("sort_multi", "SELECT p_partkey, p_brand, p_size FROM part ORDER BY p_brand ASC NULLS LAST, p_size DESC NULLS LAST, p_partkey LIMIT 50", ("part",))
q("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 35", ("orders",))
q("topk", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10", ("lineitem",))
q("topk_per_group", "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r FROM orders) t WHERE r <= 2", ("orders",))

# CTEs and set operations
q("cte_basic", "WITH x AS (SELECT n_nationkey FROM nation WHERE n_nationkey > 10) SELECT n_nationkey FROM x", ("nation",))
q("cte_chained", "WITH x AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), y AS (SELECT * FROM x WHERE s > 1500000) SELECT o_custkey, round(s, 2) AS s FROM y", ("orders",))
q("cte_union", "WITH x AS (SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey FROM region) SELECT k FROM x", ("nation", "region"))
q("union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", ("nation", "region"))
q("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", ("customer", "supplier"))
q("intersect", "SELECT c_nationkey AS k FROM customer WHERE c_custkey < 40 INTERSECT SELECT s_nationkey FROM supplier", ("customer", "supplier"))
q("except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 30", ("nation", "supplier"))
q("rec_counter", "WITH RECURSIVE c AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM c WHERE n < 50) SELECT n FROM c", ())

# Strings
q("str_upper_lower", "SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l FROM nation", ("nation",))
q(
    "str_octet_length",
    "SELECT doc_id, CAST(octet_length(text) AS BIGINT) AS n_bytes, CAST(char_length(text) AS BIGINT) AS n_chars FROM documents",
    ("documents",),
    "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(length(text) AS BIGINT) AS n_chars FROM documents",
)
q("str_concat", "SELECT n_nationkey, n_name || '/' || CAST(n_regionkey AS VARCHAR(5)) AS path FROM nation", ("nation",))
