"""Registered queries and the same in DuckDB's SQL.

Results have a total order where order matters, every column is named and cast on both sides, and float sums are rounded.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import semantics as S
from millrace.operators import dml
from millrace.operators import relational as R
from millrace.operators.store import StoreError, Transaction
from millrace.plans.sqlfront import Engine, EnginePool, rows_of
from millrace.sources.tables import NAMES, scan, shared_path, sink

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str):
    """Register a function of (spark, table) by its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__.rstrip("_")] = lambda spark, sf_dir: f(spark, front(spark, sf_dir).table)
        ORACLE_SQL[f.__name__.rstrip("_")] = oracle
        return f

    return add


_FRONTS: dict[tuple[str, str], Engine] = {}


def front(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine without a store over the tables of a folder, one for each application and folder; it opens a table when a text names it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FRONTS:
        _FRONTS[key] = e = Engine(spark)
        for name in NAMES:
            e.attach(name, lambda own, name=name: scan(own, sf_dir, name))
    return _FRONTS[key]


def sql(name: str, text: str, oracle: str | None = None, *values: object, **named: object) -> None:
    """Register a query that is one SQL text for both, or one for each; the engine prepares and runs it with the given values."""
    QUERIES[name] = lambda spark, sf_dir: front(spark, sf_dir).prepare(text)(*values, **named)
    ORACLE_SQL[name] = oracle or text


def n(c) -> F.Column:
    return c.cast("bigint")


FLAGSHIP = """
SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 2) AS avg_qty
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND l_discount BETWEEN 0.02 AND 0.08
GROUP BY c_mktsegment, o_orderpriority HAVING count(*) > 10 ORDER BY c_mktsegment, o_orderpriority LIMIT 20
"""


@query(FLAGSHIP)
def flagship_query(spark, t):
    late = R.keep(t("lineitem"), (F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz")) & F.col("l_discount").between(0.02, 0.08))
    joined = R.join(R.join(late, t("orders"), F.col("l_orderkey") == F.col("o_orderkey")), t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    out = R.aggregate(
        joined, ["c_mktsegment", "o_orderpriority"], F.col("n") > 10,
        n=n(F.count(F.lit(1))), revenue=F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2), avg_qty=F.round(F.avg("l_quantity"), 2),
    )
    return R.top(out, 20, c_mktsegment="asc", o_orderpriority="asc")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_query"](spark, sf_dir)


# scans, filters, predicates

sql("scan_full", "SELECT * FROM customer")
sql("scan_project", "SELECT c_custkey, c_name AS name FROM customer")
sql("scan_columnar_pruned", "SELECT l_quantity FROM lineitem")
sql("filter_cmp", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000.5 AND NOT o_orderstatus = 'F' OR o_custkey <= 10 AND o_custkey <> 3 AND o_orderkey != 5 AND o_totalprice < 400000 AND o_orderkey >= 1")
sql("filter_point", "SELECT * FROM orders WHERE o_orderkey = 77")
sql("filter_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 15")
sql("filter_not_between", "SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 5 AND 40")
sql("filter_like", r"SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%' AND NOT p_name LIKE '%\%' AND 'a\b' LIKE '_\_'")
sql("filter_not_like", r"SELECT p_partkey FROM part WHERE p_name NOT LIKE '%e%'")
sql("filter_in", "SELECT n_name FROM nation WHERE n_regionkey IN (1, 3)")
sql("filter_not_in", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (1, 3)")
sql("filter_is_null", "SELECT o_orderkey, l_linenumber IS NULL AS missing FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE l_orderkey IS NULL OR l_linenumber IS NOT NULL AND l_linenumber = 1")
sql("filter_null_logic", "SELECT x, (x = 1) AS eq, NOT (x = 1) AS ne, (x > 1 AND y > 1) AS both, (x > 1 OR y > 1) AS any FROM (VALUES (1, 2), (2, NULL), (CAST(NULL AS INT), 3), (NULL, NULL)) AS v(x, y)")
sql("filter_boolean_column", "SELECT v.id FROM (SELECT o_orderkey AS id, o_totalprice > 200000 AS big FROM orders) AS v WHERE v.big")
sql("filter_date", "SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderdate > CAST('1996-03-01' AS TIMESTAMP) AND CAST('1997-01-01' AS DATE) > CAST(o_orderdate AS DATE)")
sql("case_searched", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' END AS band FROM orders")
sql("case_simple", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state FROM orders")

# casts and arithmetic

sql(
    "cast_matrix",
    "SELECT CAST(s AS INT) AS i, CAST(s AS BIGINT) AS b, CAST(s AS SMALLINT) AS si, CAST(s AS FLOAT) AS f, CAST(s AS BOOLEAN) AS t, CASE WHEN s LIKE '2024%' THEN CAST(s AS DATE) END AS d, CASE WHEN s LIKE '2024%' THEN CAST(s AS TIMESTAMP) END AS ts, CAST(s AS NUMERIC(10, 2)) AS n FROM (VALUES ('12'), ('-7'), ('abc'), ('true'), ('2024-01-15'), ('2024-01-15 10:30:00'), (NULL), ('70000')) AS v(s)",
    "SELECT CASE WHEN regexp_full_match(s, '-?[0-9]+') THEN try_cast(s AS INT) END AS i, CASE WHEN regexp_full_match(s, '-?[0-9]+') THEN try_cast(s AS BIGINT) END AS b, CASE WHEN regexp_full_match(s, '-?[0-9]+') THEN try_cast(s AS SMALLINT) END AS si, try_cast(s AS DOUBLE) AS f, CASE WHEN s IN ('true') THEN true END AS t, CASE WHEN s LIKE '2024%' THEN try_cast(s[1:10] AS DATE) END AS d, CASE WHEN s LIKE '2024%' THEN try_cast(s AS TIMESTAMP) END AS ts, try_cast(s AS DECIMAL(10, 2)) AS n FROM (VALUES ('12'), ('-7'), ('abc'), ('true'), ('2024-01-15'), ('2024-01-15 10:30:00'), (NULL), ('70000')) AS v(s)",
)
sql("cast_float_to_int", "SELECT o_orderkey, CAST(o_totalprice AS INT) AS whole, CAST(o_orderkey AS TEXT) AS txt FROM orders", "SELECT o_orderkey, trunc(o_totalprice)::INTEGER AS whole, o_orderkey::VARCHAR AS txt FROM orders")
sql("arith_wide", "SELECT o_orderkey, CAST(o_orderkey AS BIGINT) + o_custkey AS a, o_orderkey - o_custkey AS s, o_orderkey * 3 AS m FROM orders")
sql("arith_float", "SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) * (1 + l_tax) + 1 - l_quantity AS v FROM lineitem")
sql("unary_minus", "SELECT c_custkey, -c_acctbal AS m, -c_custkey AS k FROM customer")


sql("arith_int_div", "SELECT p_partkey, p_partkey / 7 AS q, -p_partkey / 7 AS neg, p_partkey / 7 / 2 AS twice, p_partkey / (p_size / 4) AS inner_div FROM part", "SELECT p_partkey, p_partkey // 7 AS q, -(p_partkey // 7) AS neg, p_partkey // 7 // 2 AS twice, p_partkey // nullif(p_size // 4, 0) AS inner_div FROM part")
sql(
    "arith_div_zero_null",
    "SELECT p_partkey, p_partkey / (p_size - 10) AS i, round(p_retailprice / (p_size - 10), 6) AS f, MOD(p_partkey, p_size - 10) AS m, p_partkey % (p_size - 10) AS r FROM part WHERE p_size >= 10",
    "SELECT p_partkey, (p_partkey // nullif(p_size - 10, 0))::BIGINT AS i, round(p_retailprice / nullif(p_size - 10, 0), 6) AS f, mod(p_partkey, nullif(p_size - 10, 0))::BIGINT AS m, mod(p_partkey, nullif(p_size - 10, 0))::BIGINT AS r FROM part WHERE p_size >= 10",
)
sql(
    "arith_overflow",
    "SELECT n_nationkey, 2147483647 + n_nationkey AS a, n_nationkey * 2147483647 AS m, 9223372036854775807 + n_nationkey AS x, -n_nationkey - 2147483648 AS s FROM nation",
    "SELECT n_nationkey, 2147483647::BIGINT + n_nationkey AS a, n_nationkey::BIGINT * 2147483647 AS m, CASE WHEN n_nationkey = 0 THEN 9223372036854775807 END AS x, -n_nationkey::BIGINT - 2147483648 AS s FROM nation",
)
sql(
    "cast_epochs",
    "SELECT n_nationkey, CAST(n_nationkey AS DATE) AS d, CAST(n_nationkey * 86400 AS TIMESTAMP) AS ts, CAST(n_name AS DATE) AS none FROM nation",
    "SELECT n_nationkey, DATE '1970-01-01' + n_nationkey AS d, (TIMESTAMP '1970-01-01' + INTERVAL 1 DAY * n_nationkey) AS ts, NULL::DATE AS none FROM nation",
)


# functions


sql(
    "fn_lower_upper_trim",
    "SELECT p_partkey, lower(p_name) AS l, upper(p_name) AS u, TRIM(' ' || chr(9) || p_name || chr(10) || chr(13)) AS t FROM part",
    "SELECT p_partkey, lower(p_name) AS l, upper(p_name) AS u, trim(' ' || chr(9) || p_name || chr(10) || chr(13), ' ' || chr(9) || chr(10) || chr(13)) AS t FROM part",
)
sql("fn_length_reverse", "SELECT doc_id, CAST(LENGTH(text) AS BIGINT) AS b, reverse(source) AS r FROM documents", "SELECT doc_id, strlen(text)::BIGINT AS b, reverse(source) AS r FROM documents")
sql(
    "fn_substring_left_right",
    "SELECT p_partkey, SUBSTRING(p_name, 0, 3) AS s0, SUBSTRING(p_name, 2, 3) AS s2, SUBSTRING(p_name, 100, 3) AS s100, SUBSTRING(p_name, 3) AS s3, SUBSTRING(p_name, 2, -1) AS sn, left(p_name, 4) AS l, right(p_name, 3) AS r, left(p_name, -1) AS ln FROM part",
    "SELECT p_partkey, NULL::VARCHAR AS s0, substring(p_name, 2, 3) AS s2, substring(p_name, 100, 3) AS s100, substring(p_name, 3) AS s3, '' AS sn, left(p_name, 4) AS l, right(p_name, 3) AS r, '' AS ln FROM part",
)
sql("fn_concat_pipe", "SELECT c_custkey, c_name || '-' || c_mktsegment AS c, c_name || CAST(NULL AS TEXT) AS x FROM customer")
sql("fn_replace_position", "SELECT p_partkey, replace(p_name, 'a', 'zz') AS r, CAST(position('e' IN p_name) AS BIGINT) AS p, CAST(position('' IN p_name) AS BIGINT) AS p1 FROM part")
sql("fn_lpad_rpad", "SELECT p_partkey, lpad(p_brand, 12, '*') AS l, rpad(p_brand, 12, '-') AS r, lpad(p_brand, 3, '*') AS cut FROM part")
sql("fn_coalesce_nullif", "SELECT o_orderkey, coalesce(l_linenumber, -1) AS c, nullif(o_orderstatus, 'F') AS nf FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")


sql(
    "fn_abs_round_ceil_floor",
    "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal) AS r, CEIL(c_acctbal) AS c, FLOOR(c_acctbal) AS f, CEIL(c_custkey) AS ci, abs(c_custkey - 100) AS ai FROM customer",
    "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal) AS r, ceil(c_acctbal)::DOUBLE AS c, floor(c_acctbal)::DOUBLE AS f, c_custkey::DOUBLE AS ci, abs(c_custkey - 100) AS ai FROM customer",
)
sql("fn_mod", "SELECT c_custkey, MOD(c_custkey - 50, 7) AS m, MOD(c_custkey, 0) AS z, round(MOD(c_acctbal, CAST(3.5 AS FLOAT)), 6) AS f FROM customer", "SELECT c_custkey, mod(c_custkey - 50, 7) AS m, NULL::BIGINT AS z, round(c_acctbal - 3.5 * floor(c_acctbal / 3.5), 6) AS f FROM customer")


@query("SELECT p_partkey, (-p_partkey) % 7 AS m, CASE WHEN p_partkey % 7 = 0 THEN -(p_partkey // 7) ELSE -(p_partkey // 7) END AS q, round(p_retailprice / nullif(p_size - 10, 0), 6) AS f, strlen(p_name)::BIGINT AS b, trim(p_name) AS t, substring(p_name, 2, 3) AS s, NULL::VARCHAR AS s0, ceil(p_retailprice)::DOUBLE AS c, round(p_retailprice - 3.5 * floor(p_retailprice / 3.5), 6) AS fm FROM part")
def column_builders(spark, t):
    """The dialect's functions as columns, for queries that are built and not written."""
    neg = -F.col("p_partkey")
    return R.project(
        t("part"), p_partkey="p_partkey", m=n(S.int_mod(neg, F.lit(7))), q=n(S.int_div(neg, F.lit(7))), f=F.round(S.safe_div("p_retailprice", F.col("p_size") - 10), 6), b=n(S.byte_length("p_name")), t=S.trim_space("p_name"),
        s=S.substring_from("p_name", 2, 3), s0=S.substring_from("p_name", 0), c=S.whole("p_retailprice", True), fm=F.round(S.float_mod("p_retailprice", F.lit(3.5)), 6),
    )


# joins

sql("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
sql("join_left", "SELECT o_orderkey, l_linenumber, l_quantity FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 25")
sql("join_right", "SELECT l_quantity, o_orderkey FROM lineitem RIGHT JOIN orders ON l_orderkey = o_orderkey")
sql("join_left_where_after", "SELECT o_orderkey FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE l_orderkey IS NULL")
sql("join_left_theta", "SELECT a.n_name AS a, b.r_name AS b FROM nation a LEFT JOIN region b ON a.n_regionkey > b.r_regionkey AND b.r_regionkey > 2")
sql("join_right_theta", "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a RIGHT JOIN region b ON a.n_nationkey < b.r_regionkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, t):
    return R.cross(t("region"), t("nation")).select("r_name", "n_name")


sql("join_theta", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey < r_regionkey OR n_nationkey = r_regionkey")
sql("join_multi_key", "SELECT a.l_orderkey AS k, a.l_linenumber AS ln, CAST(count(*) AS BIGINT) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber GROUP BY a.l_orderkey, a.l_linenumber")
sql("join_multiway", "SELECT n_name, r_name, CAST(count(*) AS BIGINT) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name")
sql("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("join_semi_in", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
sql("join_semi_exists", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")
sql("exists_uncorrelated", "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 3) AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 3000)")
sql("join_anti_not_in", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
sql("join_anti_not_exists", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
sql("not_in_with_null", "SELECT r_regionkey FROM region WHERE r_regionkey NOT IN (SELECT x FROM (VALUES (1), (NULL)) AS v(x))")
sql("scalar_subquery", "SELECT r_name, (SELECT CAST(count(*) AS BIGINT) FROM nation) AS nations FROM region")

# aggregates

sql("agg_global", "SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(l_quantity) AS BIGINT) AS c, round(sum(l_quantity), 2) AS s, round(avg(l_quantity), 4) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
sql("agg_empty_input", "SELECT CAST(count(*) AS BIGINT) AS n, sum(o_totalprice) AS s, avg(o_totalprice) AS a, min(o_orderkey) AS lo, max(o_orderstatus) AS hi FROM orders WHERE o_orderkey < 0")
sql("agg_group_by", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_orderstatus")
sql("agg_group_multi", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS q, round(sum(l_extendedprice), 2) AS p, round(sum(l_extendedprice * (1 - l_discount)), 2) AS d, round(avg(l_discount), 6) AS a FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("agg_group_where", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS v FROM events WHERE value > 0 GROUP BY event_type")
sql("agg_group_null_key", "SELECT l_linenumber, CAST(count(*) AS BIGINT) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY l_linenumber")
sql("agg_count_distinct", "SELECT o_orderstatus, CAST(count(DISTINCT o_custkey) AS BIGINT) AS d, CAST(count(o_custkey) AS BIGINT) AS c FROM orders GROUP BY o_orderstatus")
sql("agg_sum_distinct", "SELECT CAST(sum(DISTINCT p_size) AS BIGINT) AS s, round(avg(DISTINCT p_size), 6) AS a, min(DISTINCT p_size) AS lo, max(DISTINCT p_size) AS hi FROM part")
sql("agg_min_max_text_date", "SELECT c_mktsegment, min(c_name) AS lo, max(c_name) AS hi, CAST(sum(c_custkey) AS BIGINT) AS s FROM customer GROUP BY c_mktsegment")
sql("agg_having", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 0")
sql("agg_with_scalar_subquery", "SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n, (SELECT CAST(count(*) AS BIGINT) FROM region) AS regions FROM nation GROUP BY n_regionkey")
sql("agg_over_join", "SELECT c_mktsegment, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 2) AS a FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
sql("group_by_no_agg", "SELECT c_mktsegment, c_nationkey FROM customer GROUP BY c_mktsegment, c_nationkey")

# windows, order, sets

sql("win_row_number", "SELECT c_custkey, CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS BIGINT) AS rn FROM customer")
sql("win_rank", "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size NULLS FIRST) AS BIGINT) AS r FROM part")
sql("win_dense_rank", "SELECT p_partkey, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC NULLS LAST) AS BIGINT) AS r FROM part")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders")
def win_row_number_ranges(spark, t):
    """A global row number by ranges; no task holds the whole table."""
    return R.numbered(t("orders"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], "rn", shared_path(spark, "numbered")).select("o_orderkey", "rn")


@query("SELECT * FROM (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn <= 3")
def win_partition(spark, t):
    r = R.ranked(t("customer"), ["c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey")], rn=F.row_number())
    return r.where("rn <= 3").select("c_custkey", "c_mktsegment", "rn")


sql("order_by_multi", "SELECT o_orderkey, o_orderpriority FROM orders ORDER BY o_orderpriority DESC NULLS FIRST, o_orderkey NULLS LAST")
sql("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
sql("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
sql("limit_zero", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 0")
sql("distinct", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
sql("distinct_top", "SELECT DISTINCT o_orderpriority FROM orders ORDER BY o_orderpriority LIMIT 3")



def _set_operation(name: str, kind: str) -> None:
    text = f"SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 50000 {kind.upper()} SELECT l_orderkey AS k FROM lineitem WHERE l_quantity > 30"

    def built(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = front(spark, sf_dir).table
        left = R.keep(t("orders"), F.col("o_totalprice") > 50000).select(F.col("o_orderkey").alias("k"))
        return R.combine(left, R.keep(t("lineitem"), F.col("l_quantity") > 30).select(F.col("l_orderkey").alias("k")), kind)

    sql(name, text)
    QUERIES[f"{name}_built"], ORACLE_SQL[f"{name}_built"] = built, text


for _name, _kind in {"union_all": "union all", "union_distinct": "union", "except": "except", "except_all": "except all", "intersect": "intersect", "intersect_all": "intersect all"}.items():
    _set_operation(_name, _kind)
sql("cte", "WITH big AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM big GROUP BY o_custkey) SELECT o_custkey, n FROM per WHERE n > 2")
sql("derived_table", "SELECT a.k, a.s FROM (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey) AS a WHERE a.s > 100000")


sql("prepared_params", "SELECT o_orderkey, '$1' AS s, o_orderkey -$3 AS next FROM orders WHERE o_totalprice > $2 AND o_orderstatus = $1 AND o_orderkey < @top", "SELECT o_orderkey, '$1' AS s, o_orderkey + 1 AS next FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F' AND o_orderkey < 500", "F", 1000, -1, top=500)
sql("prepared_dates", "SELECT o_orderkey FROM orders WHERE o_orderdate >= $1 AND CAST(o_orderdate AS DATE) < $2", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-02-03 00:00:00' AND CAST(o_orderdate AS DATE) < DATE '1997-01-01'", datetime(1996, 2, 3), date(1997, 1, 1))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def sink_partitioned(spark, t):
    """Rows written as partitioned Parquet and read again."""
    path = shared_path(spark, "sink")
    sink(t("events").select("event_id", "event_type"), path, partition_by=("event_type",))
    return R.aggregate(spark.read.parquet(path), ["event_type"], n=n(F.count(F.lit(1))))


# statements that change tables, on copies of driver tables; each returns what the table holds afterwards


def _engine(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    """An engine whose store holds copies of tables, with their own columns."""
    e = Engine(spark, shared_path(spark, "store"))
    kinds = {"int": "INT", "bigint": "BIGINT", "double": "FLOAT", "string": "TEXT", "timestamp_ntz": "TIMESTAMP"}
    for name in names:
        rows = scan(e.spark, sf_dir, name)
        e.execute(f"CREATE TABLE {name} ({', '.join(f'{c} {kinds[k]}' for c, k in rows.dtypes)})")
        _load(e, name, rows)
    return e


def _load(e: Engine, name: str, rows: DataFrame) -> None:
    tx = Transaction(e.store)
    dml.insert(tx, name, rows)
    tx.commit()


def statements(name: str, oracle: str, tables: tuple[str, ...], result: str, *texts: str | tuple) -> None:
    """Run texts, or a prepared text with its values, on copies of tables; the result is a table, or a query."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _engine(spark, sf_dir, *tables)
        for text in texts:
            if isinstance(text, tuple):
                e.prepare(text[0])(*text[1:])
            else:
                e.execute(text)
        return e.execute(result) if result.startswith("SELECT") else rows_of(e, result)

    QUERIES[name] = run
    ORACLE_SQL[name] = oracle


statements("dml_insert_values", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL VALUES (100, 'X''s', NULL::INT), (101, NULL, 2)", ("nation",), "nation", "INSERT INTO nation VALUES (100, 'X''s', NULL)", "INSERT INTO nation (n_regionkey, n_nationkey) VALUES (2, 101)")
statements("dml_insert_select", "SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, upper(n_name), n_regionkey FROM nation WHERE n_regionkey = 1", ("nation",), "nation", "INSERT INTO nation SELECT n_nationkey + 100, upper(n_name), n_regionkey FROM nation WHERE n_regionkey = 1")
statements("dml_update", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE c_mktsegment END AS c_mktsegment FROM customer", ("customer",), "customer", "UPDATE customer SET c_acctbal = c_acctbal * 2, c_mktsegment = c_name WHERE c_mktsegment = 'BUILDING'")
statements("dml_update_from", "SELECT n_nationkey, coalesce(r_name, n_name) AS n_name, n_regionkey FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey > 1) ON n_regionkey = r_regionkey", ("nation", "region"), "nation", "UPDATE nation SET n_name = r_name FROM region WHERE n_regionkey = r_regionkey AND r_regionkey > 1")
statements("dml_delete", "SELECT * FROM customer WHERE NOT (c_acctbal < 0 AND c_nationkey > 3)", ("customer",), "customer", "DELETE FROM customer WHERE c_acctbal < 0 AND c_nationkey > 3")
statements("dml_truncate", "SELECT * FROM nation WHERE false", ("nation",), "nation", "TRUNCATE nation")
statements("dml_upsert_nothing", "SELECT * FROM nation UNION ALL VALUES (200, 'NEW', 1)", ("nation",), "nation", "INSERT INTO nation VALUES (3, 'CLASH', 9), (200, 'NEW', 1) ON CONFLICT (n_nationkey) DO NOTHING")
statements("dml_upsert_update", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN n_name || '+' ELSE n_name END AS n_name, CASE WHEN n_nationkey = 3 THEN 9 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL VALUES (200, 'NEW', 1)", ("nation",), "nation", "INSERT INTO nation VALUES (3, 'CLASH', 9), (200, 'NEW', 1) ON CONFLICT (n_nationkey) DO UPDATE SET n_name = n_name || '+', n_regionkey = excluded.n_regionkey")
statements("ddl_add_column", "SELECT *, NULL::VARCHAR AS note FROM region", ("region",), "region", "ALTER TABLE region ADD note TEXT")
statements("ddl_rename_column", "SELECT r_regionkey, r_name AS title FROM region", ("region",), "region", "ALTER TABLE region RENAME COLUMN r_name TO title")
statements("ddl_drop_column", "SELECT n_nationkey, n_name FROM nation", ("nation",), "nation", "ALTER TABLE nation DROP COLUMN n_regionkey")
statements("ddl_serial_default", "SELECT * FROM (VALUES (1, 'a', 'new'), (2, 'b', 'new'), (10, 'c', 'old'), (11, 'd', 'new')) AS v(id, name, state)", (), "t", "CREATE TABLE t (id SERIAL, name TEXT, state TEXT DEFAULT 'new')", "INSERT INTO t (name) VALUES ('a')", "INSERT INTO t (name) VALUES ('b')", "INSERT INTO t VALUES (10, 'c', 'old')", "INSERT INTO t (name) VALUES ('d')")
statements("ddl_index", "SELECT * FROM orders WHERE o_custkey <> 5", ("orders",), "orders", "CREATE INDEX by_customer ON orders (o_custkey)", "CREATE UNIQUE INDEX by_key ON orders (o_orderkey)", "DELETE FROM orders WHERE o_custkey = 5", "DROP INDEX by_customer")
statements("txn_rollback", "SELECT * FROM region", ("region",), "region", "BEGIN", "DELETE FROM region WHERE r_regionkey > 0", "INSERT INTO region VALUES (77, 'GONE')", "ROLLBACK")
statements("txn_commit", "SELECT * FROM region WHERE r_regionkey <= 0 UNION ALL VALUES (77, 'KEPT')", ("region",), "region", "BEGIN", "DELETE FROM region WHERE r_regionkey > 0", "INSERT INTO region VALUES (77, 'KEPT')", "COMMIT")


statements(
    "prepared_update", "SELECT c_custkey, c_acctbal + 2.5 * (c_custkey % 3 = 0)::INT AS c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 'it''s -- \\ x' ELSE c_name END AS c_name FROM customer", ("customer",), "SELECT c_custkey, c_acctbal, c_name FROM customer",
    ("UPDATE customer SET c_acctbal = c_acctbal -$1, c_name = $2 WHERE c_custkey % 3 = 0 -$3", -2.5, "it's -- \\ x", 0),
)
statements("prepared_delete", "SELECT * FROM customer WHERE NOT (c_custkey < 60 AND c_acctbal > -500.25)", ("customer",), "customer", ("DELETE FROM customer WHERE c_custkey < 59 -$1 AND c_acctbal > $2", -1, Decimal("-500.25")))
statements(
    "prepared_insert",
    "SELECT * FROM (VALUES (-1, DATE '2024-01-01', TIMESTAMP '2024-01-01 10:30:00.000001', -1.50::DECIMAL(10, 2), 'a''b \\ --', true), (NULL, NULL, NULL, NULL, NULL, NULL), (7, DATE '0099-12-31', TIMESTAMP '1960-05-05 00:00:00', 12345678.90, '$1 @x', false)) AS v(i, d, ts, m, s, b)", (), "t",
    "CREATE TABLE t (i INT, d DATE, ts TIMESTAMP, m DECIMAL(10, 2), s TEXT, b BOOLEAN)", ("INSERT INTO t VALUES ($1, $2, $3, $4, $5, $6)", -1, date(2024, 1, 1), datetime(2024, 1, 1, 10, 30, 0, 1), Decimal("-1.50"), "a'b \\ --", True),
    ("INSERT INTO t VALUES ($1, $2, $3, $4, $5, $6)", *[None] * 6), ("INSERT INTO t (b, i, d, ts, m, s) VALUES ($1, $2, $3, $4, $5, $6)", False, 7, date(99, 12, 31), datetime(1960, 5, 5), Decimal("12345678.90"), "$1 @x"),
)
statements("store_view", "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0", ("customer",), "SELECT c_custkey, c_acctbal FROM rich", "CREATE VIEW building AS SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'", "CREATE VIEW rich AS SELECT * FROM building WHERE c_acctbal > 0", "CREATE VIEW gone AS SELECT * FROM rich", "DROP VIEW gone")
statements("drop_table", "SELECT r_regionkey, r_name FROM region", ("region", "nation"), "region", "DROP TABLE nation", "CREATE TABLE nation (x INT)", "DROP TABLE nation")
statements("update_int_div", "SELECT n_nationkey, n_name, n_regionkey // 2 AS n_regionkey FROM nation", ("nation",), "nation", "UPDATE nation SET n_regionkey = n_regionkey / 2 WHERE n_nationkey / 0 IS NULL")


def scenario(oracle: str):
    """Register a function of an engine whose store holds copies of region and nation."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(_engine(spark, sf_dir, "region", "nation"))
        ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _refused(work: Callable[[], object]) -> bool:
    try:
        work()
        return False
    except StoreError:
        return True


@scenario("SELECT * FROM (VALUES ('scan', true), ('filter', true), ('rows', false)) AS v(says, there)")
def explain(e):
    """What the plan of a query says; it is not run."""
    text = e.execute("EXPLAIN SELECT n_name FROM nation WHERE n_regionkey = 1").first()[0]
    return e.spark.createDataFrame([("scan", "Scan parquet" in text), ("filter", "PushedFilters: [IsNotNull" in text), ("rows", "ALGERIA" in text)], "says string, there boolean")


@scenario("SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 0")
def txn_conflict(e):
    """Of two transactions that delete the same rows the second fails and leaves no trace."""
    two = Engine(e.spark, e.store.root)
    for x in (e, two):
        x.execute("BEGIN")
        x.execute("DELETE FROM region WHERE r_regionkey = 0")
    two.execute("DELETE FROM region")
    e.execute("COMMIT")
    assert _refused(lambda: two.execute("COMMIT"))
    return rows_of(e, "region")


@scenario("SELECT 'inside' AS seen, r_regionkey FROM region UNION ALL SELECT 'after', r_regionkey FROM region WHERE r_regionkey > 2")
def snapshot_read(e):
    """A transaction sees its snapshot whatever others publish; the next statement outside sees it (read committed)."""
    two = Engine(e.spark, e.store.root)
    two.execute("BEGIN")
    e.execute("DELETE FROM region WHERE r_regionkey <= 2")
    inside = two.execute("SELECT 'inside' AS seen, r_regionkey FROM region")
    two.execute("COMMIT")
    return inside.union(two.execute("SELECT 'after' AS seen, r_regionkey FROM region"))


@scenario("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def engine_pool(e):
    """An engine that comes back with an open transaction is rolled back before it is lent again."""
    pool = EnginePool(e.spark, e.store.root, 1)
    lent = pool.acquire()
    assert _refused(pool.acquire)
    lent.execute("BEGIN")
    lent.execute("DELETE FROM nation")
    pool.release(lent)
    return rows_of(pool.acquire(), "nation")


@scenario("SELECT 'hit' AS event, 2::BIGINT AS n UNION ALL SELECT 'after_ddl', 0")
def statement_cache(e):
    """A statement's rewritten text is remembered until a table or view changes its shape."""
    for _ in range(2):
        e.execute("SELECT n_regionkey / 2 AS h FROM nation")
        e.execute("SELECT n_regionkey % 2 AS h FROM nation")
    hit = len(e.cache)
    e.execute("ALTER TABLE nation ADD note TEXT")
    return e.spark.createDataFrame([("hit", hit), ("after_ddl", len(e.cache))], "event string, n bigint")


@scenario("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey <> 1")
def vacuum_keeps_rows(e):
    """Old fragments and log entries go; what the last entry names stays."""
    e.execute("DELETE FROM nation WHERE n_nationkey = 1")
    assert e.store.vacuum(keep_versions=1, older_than=0) > 0
    return rows_of(e, "nation")


def constraint_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of constraint, and whether the engine refuses a statement that breaks it."""
    e = Engine(spark, shared_path(spark, "store"))
    e.execute("CREATE TABLE dept (id INT PRIMARY KEY, name TEXT)")
    e.execute("CREATE TABLE emp (id INT NOT NULL, age INT, dept_id INT, CHECK (age > 0), FOREIGN KEY (dept_id) REFERENCES dept (id))")
    e.execute("INSERT INTO dept VALUES (1, 'a'), (2, 'b')")
    tries = {
        "check": "INSERT INTO emp VALUES (1, -1, 1)", "check_null_passes": "INSERT INTO emp VALUES (1, NULL, 1)", "foreign_key": "INSERT INTO emp VALUES (2, 5, 99)", "foreign_key_null_passes": "INSERT INTO emp VALUES (3, 5, NULL)", "foreign_key_update": "UPDATE emp SET dept_id = 98",
        "not_null": "INSERT INTO emp VALUES (NULL, 5, 1)", "not_null_update": "UPDATE emp SET id = NULL", "restrict_delete": "DELETE FROM dept WHERE id = 1", "unique": "INSERT INTO dept VALUES (2, 'c')",
    }
    out = []
    for name, text in tries.items():
        try:
            e.execute(text)
            out.append((name, False))
        except StoreError:
            out.append((name, True))
    return spark.createDataFrame(out, "name string, refused boolean")


QUERIES["constraint_report"] = constraint_report
ORACLE_SQL["constraint_report"] = "SELECT * FROM (VALUES ('check', true), ('check_null_passes', false), ('foreign_key', true), ('foreign_key_null_passes', false), ('foreign_key_update', true), ('not_null', true), ('not_null_update', true), ('restrict_delete', true), ('unique', true)) AS v(name, refused)"


def catalog_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark, sf_dir, "region", "nation").execute("\\dt")


QUERIES["catalog_listing"] = catalog_listing
ORACLE_SQL["catalog_listing"] = "SELECT * FROM (VALUES ('nation'), ('region')) AS v(name)"
