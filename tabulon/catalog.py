"""Named queries over the sample tables, with equivalent SQL: one or more per operator of the language."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .api import Engine
from .plans.table import from_parquet


def _run(text: str, a: str, b: str | None = None, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        read = lambda t: from_parquet(spark, f"{sf_dir}/{t}.parquet")
        engine = Engine(spark, **({"ordered": False} | options))
        return engine.query(text, read(a), {k: read(b) for k in ("b", "B")} if b else None).df

    return run


def _reverse_words(text: str) -> str:
    return " ".join(reversed(text.split(" ")))


def _upper_words(text: str) -> list:
    return text.upper().split(" ")


def _scaled(size: pd.Series, price: pd.Series) -> pd.Series:
    return size * 100 + price.round().astype("int64") % 100


#: name: (query, table a, table b, SQL, options)
ENTRIES: dict[str, tuple] = {
    "select_expr": ("SELECT a.l_orderkey, a.l_extendedprice * (1 - a.l_discount) AS revenue", "lineitem", None, "select l_orderkey, l_extendedprice * (1 - l_discount) revenue from lineitem", {}),
    "select_star_nr": ("SELECT NR, *", "nation", None, 'select row_number() over () "NR", * from nation', {}),
    "select_except": ("SELECT * EXCEPT a.n_name", "nation", None, "select * exclude (n_name) from nation", {}),
    "select_positional": ('SELECT a1, a[2] AS col_b, a["n_name"] AS col_c, NF', "nation", None, 'select n_nationkey, n_name col_b, n_name col_c, 3 "NF" from nation', {}),
    "select_unpack": ("SELECT a.p_partkey, *[a.p_size, a.p_size + 1]", "part", None, "select p_partkey, p_size::bigint col2, (p_size + 1)::bigint col3 from part", {}),
    "where_and_or": ("SELECT a.l_orderkey, a.l_linenumber WHERE a.l_quantity > 45 and (a.l_returnflag == 'R' or not a.l_linestatus == 'O')", "lineitem", None, "select l_orderkey, l_linenumber from lineitem where l_quantity > 45 and (l_returnflag = 'R' or l_linestatus <> 'O')", {}),
    "where_in": ("SELECT a.o_orderkey WHERE a.o_orderstatus in ['O', 'P'] and a.o_orderpriority not in ('1-URGENT',)", "orders", None, "select o_orderkey from orders where o_orderstatus in ('O', 'P') and o_orderpriority <> '1-URGENT'", {}),
    "where_cmp_chain": ("SELECT a.l_orderkey, a.l_quantity WHERE 10 < a.l_quantity <= 12", "lineitem", None, "select l_orderkey, l_quantity from lineitem where l_quantity > 10 and l_quantity <= 12", {}),
    "where_like": ("SELECT a.p_partkey, a.p_type WHERE like(a.p_type, '%E%_M%') or like(a.p_type, 'PR__O')", "part", None, "select p_partkey, p_type from part where p_type like '%E%_M%' or p_type like 'PR__O'", {}),
    "where_regex": ("SELECT a.p_partkey, a.p_name WHERE re.match('[a-m].*t', a.p_name) is not None", "part", None, "select p_partkey, p_name from part where regexp_matches(p_name, '^(?:[a-m].*t)')", {}),
    "where_nr": ("SELECT NR, a.o_orderkey WHERE NR > 10 and NR <= 20", "orders", None, 'select * from (select row_number() over () "NR", o_orderkey from orders) where "NR" between 11 and 20', {}),
    "where_short_circuit": ("SELECT a.n_name WHERE a.n_name != '' and int(str(a.n_regionkey)) > 2", "nation", None, "select n_name from nation where n_name <> '' and n_regionkey > 2", {}),
    "top_order": ("SELECT TOP 10 a.l_orderkey, a.l_linenumber, a.l_extendedprice ORDER BY a.l_extendedprice", "lineitem", None, "select l_orderkey, l_linenumber, l_extendedprice from (select *, row_number() over () nr from lineitem) order by l_extendedprice, nr limit 10", {}),
    "limit_order_desc": ("SELECT a.l_orderkey, a.l_linenumber, a.l_quantity ORDER BY a.l_quantity DESC LIMIT 100", "lineitem", None, "select l_orderkey, l_linenumber, l_quantity from (select *, row_number() over () nr from lineitem) order by l_quantity desc, nr desc limit 100", {}),
    "order_multi": ("SELECT TOP 50 a.o_orderkey, a.o_orderstatus, a.o_totalprice ORDER BY a.o_orderstatus, a.o_totalprice DESC", "orders", None, "select o_orderkey, o_orderstatus, o_totalprice from (select *, row_number() over () nr from orders) order by o_orderstatus desc, o_totalprice desc, nr desc limit 50", {}),
    "order_full": ("SELECT a.c_custkey, a.c_acctbal ORDER BY a.c_acctbal", "customer", None, "select c_custkey, c_acctbal from customer", {}),
    "top_no_order": ("SELECT TOP 7 *", "orders", None, "select * exclude (nr) from (select *, row_number() over () nr from orders) order by nr limit 7", {}),
    "distinct": ("SELECT DISTINCT a.l_returnflag, a.l_linestatus", "lineitem", None, "select distinct l_returnflag, l_linestatus from lineitem", {}),
    "distinct_count": ("SELECT DISTINCT COUNT a.l_returnflag, a.l_linestatus", "lineitem", None, "select count(*) count, l_returnflag, l_linestatus from lineitem group by all", {}),
    "distinct_top": ("SELECT TOP 5 DISTINCT a.l_suppkey", "lineitem", None, "select l_suppkey from (select l_suppkey, min(nr) f from (select l_suppkey, row_number() over () nr from lineitem) group by 1) order by f limit 5", {}),
    "distinct_order": ("SELECT TOP 9 DISTINCT a.l_quantity, a.l_returnflag ORDER BY a.l_quantity DESC", "lineitem", None, "select l_quantity, l_returnflag from (select l_quantity, l_returnflag, max(nr) f from (select *, row_number() over () nr from lineitem) group by 1, 2) order by l_quantity desc, f desc limit 9", {}),
    "group_count": ("SELECT a.l_returnflag, COUNT(*) AS n GROUP BY a.l_returnflag", "lineitem", None, "select l_returnflag, count(*) n from lineitem group by 1", {}),
    "group_sum": ("SELECT a.l_returnflag, a.l_linestatus, SUM(a.l_linenumber) AS s, SUM(a.l_quantity) AS q GROUP BY a.l_returnflag, a.l_linestatus", "lineitem", None, "select l_returnflag, l_linestatus, sum(l_linenumber)::bigint s, sum(l_quantity) q from lineitem group by 1, 2", {}),
    "group_min_max": ("SELECT a.l_suppkey, MIN(a.l_extendedprice) AS low, MAX(a.l_extendedprice) AS high GROUP BY a.l_suppkey", "lineitem", None, "select l_suppkey, min(l_extendedprice) low, max(l_extendedprice) high from lineitem group by 1", {}),
    "group_variance": ("SELECT a.l_returnflag, VARIANCE(a.l_quantity) AS v GROUP BY a.l_returnflag | SELECT a.l_returnflag, round(a.v, 4) AS v", "lineitem", None, "select l_returnflag, round_even(var_pop(l_quantity), 4) v from lineitem group by 1", {}),
    "group_avg": ("SELECT a.o_orderpriority, AVG(a.o_totalprice) AS m GROUP BY a.o_orderpriority | SELECT a.o_orderpriority, round(a.m, 4) AS m", "orders", None, "select o_orderpriority, round_even(avg(o_totalprice), 4) m from orders group by 1", {}),
    "group_median": ("SELECT a.l_shipdate.year AS y, MEDIAN(a.l_quantity) AS m GROUP BY a.l_shipdate.year", "lineitem", None, "select year(l_shipdate) y, median(l_quantity) m from lineitem group by 1", {}),
    "group_any_value": ("SELECT a.l_suppkey, ANY_VALUE(a.l_comment) AS c GROUP BY a.l_suppkey".replace("l_comment", "l_orderkey"), "lineitem", None, "select l_suppkey, arg_min(l_orderkey, nr) c from (select *, row_number() over () nr from lineitem) group by 1", {}),
    "group_array_agg": ("SELECT a.n_regionkey, ARRAY_AGG(a.n_name) AS names GROUP BY a.n_regionkey | SELECT a.n_regionkey, ','.join(a.names) AS names", "nation", None, "select n_regionkey, string_agg(n_name, ',' order by nr) names from (select *, row_number() over () nr from nation) group by 1", {}),
    "array_agg_post": ("SELECT a.o_custkey, ARRAY_AGG(a.o_orderkey, lambda v: sorted(v)[:3]) AS first3 GROUP BY a.o_custkey | SELECT a.o_custkey, str(a.first3) AS first3", "orders", None, "select o_custkey, list_sort(list(o_orderkey))[1:3]::varchar first3 from orders group by 1", {}),
    "group_expr_key": ("SELECT a.o_orderdate.month AS m, COUNT(1) AS n GROUP BY a.o_orderdate.month", "orders", None, "select month(o_orderdate) m, count(*) n from orders group by 1", {}),
    "group_nokey_agg": ("SELECT COUNT(*) AS n, SUM(a.l_linenumber) AS s, MAX(a.l_tax) AS t", "lineitem", None, "select count(*) n, sum(l_linenumber)::bigint s, max(l_tax) t from lineitem", {}),
    "group_bare_const": ("SELECT a.n_regionkey, a.n_regionkey * 2 AS twice, COUNT(*) AS n GROUP BY a.n_regionkey", "nation", None, "select n_regionkey, (n_regionkey * 2)::bigint twice, count(*) n from nation group by 1", {}),
    "group_without_agg": ("SELECT a.l_returnflag GROUP BY a.l_returnflag", "lineitem", None, "select distinct l_returnflag from lineitem", {}),
    "group_top": ("SELECT TOP 3 a.l_suppkey, COUNT(*) AS n GROUP BY a.l_suppkey", "lineitem", None, "select l_suppkey, count(*) n from lineitem group by 1 order by 1 limit 3", {}),
    "agg_empty": ("SELECT COUNT(*) AS n WHERE a.l_quantity < 0", "lineitem", None, "select count(*) n from lineitem where l_quantity < 0 having count(*) > 0", {}),
    "agg_string_numbers": ("SELECT str(a.l_linenumber) AS t, a.l_returnflag | SELECT a.l_returnflag, SUM(a.t) AS s, MAX(a.t) AS m GROUP BY a.l_returnflag", "lineitem", None, "select l_returnflag, sum(l_linenumber)::double s, max(l_linenumber)::double m from lineitem group by 1", {}),
    "join_inner": ("SELECT a.o_orderkey, b.c_name JOIN B ON a.o_custkey == b.c_custkey", "orders", "customer", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey", {}),
    "join_left": ("SELECT a.c_custkey, b.o_orderkey, b.o_totalprice LEFT JOIN B ON a.c_custkey == b.o_custkey", "customer", "orders", "select c_custkey, o_orderkey, o_totalprice from customer left join orders on o_custkey = c_custkey", {}),
    "join_strict": ("SELECT a.c_custkey, b.n_name STRICT LEFT JOIN B ON a.c_nationkey == b.n_nationkey", "customer", "nation", "select c_custkey, n_name from customer left join nation on c_nationkey = n_nationkey", {}),
    "join_multikey": ("SELECT a.l_orderkey, a.l_linenumber, b.l_tax JOIN B ON a.l_orderkey == b.l_orderkey and a.l_linenumber == b.l_linenumber", "lineitem", "lineitem", "select a.l_orderkey, a.l_linenumber, b.l_tax from lineitem a join lineitem b using (l_orderkey, l_linenumber)", {}),
    "join_swap_sides": ("SELECT a.n_name, b.r_name INNER JOIN B ON b.r_regionkey = a.n_regionkey", "nation", "region", "select n_name, r_name from nation join region on n_regionkey = r_regionkey", {}),
    "join_nr": ("SELECT a.n_name, b.r_name, bNR JOIN B ON NR == bNR", "nation", "region", 'select n_name, r_name, a.nr "bNR" from (select *, row_number() over () nr from nation) a join (select *, row_number() over () nr from region) b using (nr)', {}),
    "join_self": ("SELECT a.n_name, b.n_name AS other JOIN B ON a.n_regionkey == b.n_regionkey WHERE a.n_nationkey < b.n_nationkey", "nation", "nation", "select a.n_name, b.n_name other from nation a join nation b on a.n_regionkey = b.n_regionkey where a.n_nationkey < b.n_nationkey", {}),
    "join_order_where": ("SELECT TOP 20 a.o_orderkey, b.c_name, a.o_totalprice JOIN B ON a.o_custkey == b.c_custkey WHERE b.c_acctbal > 0 ORDER BY a.o_totalprice DESC", "orders", "customer", "select o_orderkey, c_name, o_totalprice from (select *, row_number() over () nr from orders) join customer on o_custkey = c_custkey where c_acctbal > 0 order by o_totalprice desc, nr desc limit 20", {}),
    "join_group": ("SELECT b.c_mktsegment, SUM(a.o_totalprice) AS s JOIN B ON a.o_custkey == b.c_custkey GROUP BY b.c_mktsegment | SELECT a.c_mktsegment, round(a.s, 2) AS s", "orders", "customer", "select c_mktsegment, round_even(sum(o_totalprice), 2) s from orders join customer on o_custkey = c_custkey group by 1", {}),
    "update_simple": ("UPDATE SET a.n_name = a.n_name.lower() + '!'", "nation", None, "select n_nationkey, lower(n_name) || '!' n_name, n_regionkey from nation", {}),
    "update_where": ("UPDATE a SET a.c_acctbal = a.c_acctbal * 2, a.c_mktsegment = 'RICH' WHERE a.c_acctbal > 9000", "customer", None, "select c_custkey, c_name, c_nationkey, case when c_acctbal > 9000 then c_acctbal * 2 else c_acctbal end c_acctbal, case when c_acctbal > 9000 then 'RICH' else c_mktsegment end c_mktsegment from customer", {}),
    "update_swap": ("UPDATE SET a.n_nationkey = a.n_regionkey, a.n_regionkey = a.n_nationkey", "nation", None, "select n_regionkey n_nationkey, n_name, n_nationkey n_regionkey from nation", {}),
    "update_join": ("UPDATE SET a.c_name = b.n_name JOIN B ON a.c_nationkey == b.n_nationkey WHERE b.n_regionkey == 1", "customer", "nation", "select c_custkey, case when n_regionkey = 1 then n_name else c_name end c_name, c_nationkey, c_acctbal, c_mktsegment from customer left join nation on c_nationkey = n_nationkey", {}),
    "update_nu": ("UPDATE SET a.o_totalprice = NU WHERE a.o_orderstatus == 'F'", "orders", None, "select o_orderkey, o_custkey, o_orderstatus, case when o_orderstatus = 'F' then sum((o_orderstatus = 'F')::int) over (order by nr) else o_totalprice end::double o_totalprice, o_orderdate, o_orderpriority from (select *, row_number() over () nr from orders)", {}),
    "unnest_split": ("SELECT a.p_partkey, UNNEST(a.p_name.split(' ')) AS word", "part", None, "select p_partkey, unnest(string_split(p_name, ' ')) word from part", {}),
    "pipe_having": ("SELECT a.o_custkey, COUNT(*) AS n GROUP BY a.o_custkey | SELECT * WHERE a.n >= 15", "orders", None, "select o_custkey, count(*) n from orders group by 1 having count(*) >= 15", {}),
    "pipe_count_distinct": ("SELECT DISTINCT a.l_suppkey |> SELECT COUNT(*) AS n", "lineitem", None, "select count(distinct l_suppkey) n from lineitem", {}),
    "scalar_string": ("SELECT a.p_partkey, a.p_name.upper() AS u, len(a.p_name) AS n, a.p_name.replace('a', 'zz') AS r, a.p_name.find('e') AS f, a.p_name[1:4] AS s, a.p_name[-2:] AS t, a.p_name.split(' ')[0] AS w, '-'.join(a.p_name.split(' ')) AS j, a.p_name.startswith('a') AS b, f'{a.p_size:04d}|{a.p_brand}' AS x", "part", None, "select p_partkey, upper(p_name) u, length(p_name)::bigint n, replace(p_name, 'a', 'zz') r, (instr(p_name, 'e') - 1)::bigint f, substr(p_name, 2, 3) s, right(p_name, 2) t, string_split(p_name, ' ')[1] w, replace(p_name, ' ', '-') j, starts_with(p_name, 'a') b, lpad(p_size::varchar, 4, '0') || '|' || p_brand x from part", {}),
    "scalar_math": ("SELECT a.l_orderkey, a.l_linenumber, math.ceil(a.l_quantity / 7) AS c, round(a.l_extendedprice / 3, 2) AS r, abs(a.l_discount - 1) AS d, int(a.l_extendedprice) AS i, math.sqrt(a.l_quantity) AS q", "lineitem", None, "select l_orderkey, l_linenumber, ceil(l_quantity / 7)::bigint c, round_even(l_extendedprice / 3, 2) r, abs(l_discount - 1) d, trunc(l_extendedprice)::bigint i, sqrt(l_quantity) q from lineitem", {}),
    "scalar_floor_mod": ("SELECT a.o_orderkey, (a.o_orderkey - 5000) // 7 AS d, (a.o_orderkey - 5000) % 7 AS m", "orders", None, "select o_orderkey, floor((o_orderkey - 5000) / 7)::bigint d, (((o_orderkey - 5000) % 7) + 7) % 7 m from orders", {}),
    "scalar_cond": ("SELECT a.o_orderkey, 'high' if a.o_totalprice > 200000 else 'low' AS c, a.o_orderstatus or 'none' AS s", "orders", None, "select o_orderkey, case when o_totalprice > 200000 then 'high' else 'low' end c, o_orderstatus s from orders", {}),
    "scalar_date": ("SELECT a.o_orderkey, a.o_orderdate.year AS y, a.o_orderdate.strftime('%Y-%m') AS ym, a.o_orderdate.weekday() AS w", "orders", None, "select o_orderkey, year(o_orderdate)::bigint y, strftime(o_orderdate, '%Y-%m') ym, (isodow(o_orderdate) - 1)::bigint w from orders", {}),
    "scalar_json": ("SELECT a.event_id, int(json.loads(a.props)['k']) AS k", "events", None, "select event_id, (props::json ->> 'k')::bigint k from events", {}),
    "scalar_regex": ("SELECT a.p_partkey, re.sub('[aeiou]', '', a.p_name) AS c, len(re.findall('[aeiou]', a.p_name)) AS n", "part", None, "select p_partkey, regexp_replace(p_name, '[aeiou]', '', 'g') c, len(regexp_extract_all(p_name, '[aeiou]'))::bigint n from part", {}),
    "scalar_listcomp": ("SELECT a.p_partkey, ' '.join([w.upper() for w in a.p_name.split(' ') if len(w) > 4]) AS w", "part", None, "select p_partkey, coalesce(array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda x: length(x) > 4), lambda x: upper(x)), ' '), '') w from part", {}),
    "udf_scalar": ("SELECT a.p_partkey, rev(a.p_name) AS r", "part", None, "select p_partkey, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') r from part", {"functions": {"rev": (_reverse_words, "string")}}),
    "udf_vectorised": ("SELECT a.p_partkey, scaled(a.p_size, a.p_retailprice) AS x", "part", None, "select p_partkey, p_size * 100 + round_even(p_retailprice, 0)::bigint % 100 x from part", {"functions": {"scaled": (_scaled, "bigint")}}),
    "udf_init_code": ("SELECT a.p_partkey, boxed(a.p_size) AS x", "part", None, "select p_partkey, p_size * 3 + 1 x from part", {"init_source": "def boxed(v) -> int:\n    return v * 3 + 1\n"}),
    "udf_fallback": ("SELECT a.p_partkey, a.p_name.swapcase() AS x", "part", None, "select p_partkey, upper(p_name) x from part where p_name = lower(p_name)", {}),
    "random_order": ("SELECT a.n_nationkey, a.n_name ORDER BY random.random()", "nation", None, "select n_nationkey, n_name from nation", {}),
    "unfold": ("SELECT a.n_regionkey, FOLD(a.n_name) AS names GROUP BY a.n_regionkey | SELECT a.n_regionkey, UNFOLD(a.names) AS name", "nation", None, "select n_regionkey, n_name as name from nation", {}),
    "unnest_join": ("SELECT a.c_custkey, UNNEST(b.n_name.split('_')) AS part JOIN B ON a.c_nationkey == b.n_nationkey WHERE a.c_acctbal > 0", "customer", "nation", "select c_custkey, unnest(string_split(n_name, '_')) as part from customer join nation on c_nationkey = n_nationkey where c_acctbal > 0", {}),
    "udtf_unnest": ("SELECT a.p_partkey, UNNEST(pieces(a.p_name)) AS piece", "part", None, "select p_partkey, unnest(string_split(upper(p_name), ' ')) piece from part", {"functions": {"pieces": (_upper_words, "array<string>")}}),
    "agg_name_case": ("SELECT Sum(a.l_linenumber) AS s, min(a.l_quantity) AS low, Max(a.l_quantity) AS high, count(1) AS n", "lineitem", None, "select sum(l_linenumber)::bigint s, min(l_quantity) low, max(l_quantity) high, count(*) n from lineitem", {}),
    "query_comments": ("# first line\nSELECT a.n_name\n  # a comment between\nWHERE a.n_regionkey == 2;", "nation", None, "select n_name from nation where n_regionkey = 2", {}),
    "query_literals": ("SELECT a.n_name + ' WHERE | SELECT, ' + \"ORDER BY it's\" AS x WHERE a.n_name != 'LIMIT 3'", "nation", None, "select n_name || ' WHERE | SELECT, ORDER BY it''s' x from nation", {}),
    "clause_order": ("select a.o_orderkey, a.o_totalprice limit 12 order by a.o_totalprice desc where a.o_orderstatus == 'O'", "orders", None, "select o_orderkey, o_totalprice from (select *, row_number() over () nr from orders) where o_orderstatus = 'O' order by o_totalprice desc, nr desc limit 12", {}),
    "limit_zero": ("SELECT a.n_name LIMIT 0", "nation", None, "select n_name from nation limit 0", {}),
    "top_where": ("SELECT TOP 25 a.l_orderkey, a.l_linenumber WHERE a.l_returnflag == 'R' and a.l_quantity > 40", "lineitem", None, "select l_orderkey, l_linenumber from (select *, row_number() over () nr from lineitem) where l_returnflag = 'R' and l_quantity > 40 order by nr limit 25", {}),
    "top_times": ("SELECT TOP 30 a.event_id, a.ts WHERE a.event_type == 'click'", "events", None, "select event_id, ts from (select *, row_number() over () nr from events) where event_type = 'click' order by nr limit 30", {}),
    "update_limit_free": ("UPDATE a SET a1 = a1 + 1, a3 = 9 WHERE NR % 2 == 0", "nation", None, "select (n_nationkey + (nr % 2 = 0)::int)::bigint n_nationkey, n_name, case when nr % 2 = 0 then 9 else n_regionkey end::bigint n_regionkey from (select *, row_number() over () nr from nation)", {}),
    "bare_names": ("SELECT n_name, n_regionkey + 1 AS r WHERE n_regionkey > 2", "nation", None, "select n_name, (n_regionkey + 1)::bigint r from nation where n_regionkey > 2", {"bare_names": True}),
}




def join_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables by piping: each stage's join is named in the registry."""
    tables = {n: from_parquet(spark, f"{sf_dir}/{n}.parquet") for n in ("customer", "nation")}
    text = "SELECT a.o_orderkey, b.c_nationkey JOIN customer ON a.o_custkey == b.c_custkey | SELECT a.o_orderkey, b.n_name JOIN nation ON a.c_nationkey == b.n_nationkey"
    return Engine(spark, ordered=False).query(text, from_parquet(spark, f"{sf_dir}/orders.parquet"), tables).df


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by order priority of discounted lines, over a join."""
    text = (
        "SELECT a.l_orderkey, a.l_extendedprice * (1 - a.l_discount) AS revenue, b.o_orderpriority JOIN B ON a.l_orderkey == b.o_orderkey WHERE a.l_quantity > 45"
        " | SELECT a.o_orderpriority, COUNT(*) AS n, SUM(a.revenue) AS revenue GROUP BY a.o_orderpriority | SELECT TOP 3 a.o_orderpriority, a.n, round(a.revenue, 2) AS revenue ORDER BY a.revenue DESC"
    )
    read = lambda t: from_parquet(spark, f"{sf_dir}/{t}.parquet")
    return Engine(spark, ordered=False).query(text, read("lineitem"), {"B": read("orders")}).df


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _run(v[0], v[1], v[2], **v[4]) for k, v in ENTRIES.items()} | {"join_three": join_three, "flagship": flagship}
SQL: dict[str, str] = {k: v[3] for k, v in ENTRIES.items()} | {
    "join_three": "select o_orderkey, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey",
    "flagship": "select o_orderpriority, count(*) n, round_even(sum(l_extendedprice * (1 - l_discount)), 2) revenue from lineitem join orders on l_orderkey = o_orderkey where l_quantity > 45 group by 1 order by revenue desc limit 3",
}


