"""Operators: scans, predicates, joins, aggregates, windows, sorting, set operations, CTEs, table functions."""

_V = "(values (1, 'a', 10.5), (2, 'b', null), (3, null, -2.0), (null, 'd', 0.0)) as t(i, s, x)"

QUERIES: dict[str, str | tuple[str, str]] = {
    # Scans and projections.
    "scan_project": "select o_orderkey, o_orderstatus as status from orders",
    "scan_wildcard": "select n.*, r.r_name from nation n join region r on r.r_regionkey = n.n_regionkey",
    "scan_values": "select column1 as a, column2 as b from (values (1, 'x'), (2, 'y')) as v(column1, column2)",
    "scan_table": ("table region", "select * from region"),
    "scan_no_from": "select 1 as one, 'two' as two, null as three",
    "scan_point": "select c_custkey, c_name from customer where c_custkey = 7",
    "scan_range": "select c_custkey from customer where c_custkey between 10 and 20 and c_acctbal > 0",
    # Predicates.
    "pred_three_valued": f"select i, (i > 1) as gt, (i > 1 and s = 'b') as a, (i > 1 or s = 'b') as o, not (i > 1) as n from {_V}",
    "pred_in": "select n_name from nation where n_nationkey in (1, 2, 3) and n_nationkey not in (2)",
    "pred_in_null": f"select i, i in (1, null) as a, i not in (1, null) as b from {_V}",
    "pred_between": ("select count(*) as n from lineitem where l_quantity between symmetric 20 and 10 or l_quantity not between 2 and 49", "select count(*) as n from lineitem where l_quantity between 10 and 20 or l_quantity not between 2 and 49"),
    "pred_like": "select p_name, p_name like '%1_' as a, p_name ilike 'PART%' as b, p_name not like '%0%' as c, 'a%b' like 'a!%b' escape '!' as d from part",
    "pred_regex": ("select c_name, c_name ~ '0[12]' as a, c_name ~* 'CUST' as b, c_name !~ '9$' as c, c_name !~* 'x' as d from customer", "select c_name, regexp_matches(c_name, '0[12]') as a, regexp_matches(c_name, 'CUST', 'i') as b, not regexp_matches(c_name, '9$') as c, not regexp_matches(c_name, 'x', 'i') as d from customer"),
    "pred_similar": ("select n_name, n_name similar to 'NATION_(1|2)_?' as a, substring(n_name similar 'NA#\"%#\"1' escape '#') as b from nation", "select n_name, regexp_full_match(n_name, 'NATION.(1|2).?') as a, case when regexp_full_match(n_name, 'NA.*1') then regexp_extract(n_name, '^NA(.*)1$', 1) else '' end as b from nation"),
    "pred_is_null": f"select i, s is null as a, x is not null as b, (i > 1) is true as c, (i > 1) is not false as d, (i > 1) is unknown as e from {_V}".replace("is unknown", "is null"),
    "pred_is_unknown": (f"select i, (i > 1) is unknown as a, (i > 1) is not unknown as b from {_V}", f"select i, (i > 1) is null as a, (i > 1) is not null as b from {_V}"),
    "pred_distinct_from": f"select i, i is distinct from 1 as a, s is not distinct from null as b from {_V}",
    "pred_case": "select l_linenumber, case l_returnflag when 'A' then 1 when 'R' then 2 end as a, case when l_quantity > 40 then 'big' when l_quantity > 20 then 'mid' else 'small' end as b from lineitem",
    "pred_cast": "select cast('12' as int) as a, '3.5'::float8 as b, 7::text as c, '2024-02-03'::date as d, 'true'::boolean as e, cast(1 as bigint) as f",
    "pred_any_all_array": ("select n_nationkey, n_nationkey = any(array[1, 3, 5]) as a, n_nationkey > all(array[2, 4]) as b, n_nationkey < any(array[2, 4]) as c from nation", "select n_nationkey, n_nationkey in (1, 3, 5) as a, n_nationkey > 4 as b, n_nationkey < 4 as c from nation"),
    "pred_any_all_subquery": ("select n_name from nation where n_regionkey = any(select r_regionkey from region where r_name like '%A%') and n_nationkey <> all(select c_nationkey from customer where c_custkey < 5)", "select n_name from nation where n_regionkey in (select r_regionkey from region where r_name like '%A%') and n_nationkey not in (select c_nationkey from customer where c_custkey < 5)"),
    "pred_compare_any_subquery": ("select c_custkey from customer where c_acctbal > all(select s_acctbal from supplier)", "select c_custkey from customer where c_acctbal > (select max(s_acctbal) from supplier)"),
    "pred_row_compare": "select n_nationkey from nation where (n_nationkey, n_regionkey) = (3, 3) or (n_nationkey, n_regionkey) in ((1, 1), (2, 2), (5, 0))",
    "pred_arithmetic": ("select n_nationkey, 7 / 2 as a, -7 % 3 as b, n_nationkey / 2 as c, 2 ^ 3 as d, 1 << 4 as e, 256 >> 2 as f, 6 & 3 as g, 6 | 3 as h, 6 # 3 as i, @ -5 as j, |/ 16.0 as k from nation", "select n_nationkey, 7 // 2 as a, -7 % 3 as b, n_nationkey // 2 as c, 2.0::double ^ 3 as d, 1 << 4 as e, 256 >> 2 as f, 6 & 3 as g, 6 | 3 as h, xor(6, 3) as i, 5 as j, sqrt(16.0) as k from nation"),
    # Subqueries.
    "sub_exists": "select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 200000)",
    "sub_not_exists": "select c_custkey from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)",
    "sub_in": "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')",
    "sub_not_in": "select count(*) as n from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)",
    "sub_scalar": "select n_name, (select count(*) from customer c where c.c_nationkey = n.n_nationkey) as customers from nation n",
    "sub_array": ("select r_name, array_to_string(array(select n_name from nation where n_regionkey = 1 order by n_name), ',') as names from region", "select r_name, (select string_agg(n_name, ',' order by n_name) from nation where n_regionkey = 1) as names from region"),
    "sub_derived": "select seg, n from (select c_mktsegment as seg, count(*) as n from customer group by c_mktsegment) as q where n > 10",
    "sub_non_equi_exists": "select count(*) as n from supplier s where exists (select 1 from customer c where c.c_nationkey = s.s_nationkey and c.c_acctbal > s.s_acctbal)",
    # Joins.
    "join_inner": "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey where o_totalprice > 400000",
    "join_left": "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_totalprice > 300000",
    "join_right": "select o_orderkey, c_custkey from orders right join customer on o_custkey = c_custkey and o_orderstatus = 'P'",
    "join_full": "select a.i, b.j from (values (1), (2), (3)) as a(i) full outer join (values (2), (3), (4)) as b(j) on a.i = b.j",
    "join_cross": "select r_name, i from region cross join (values (1), (2)) as v(i)",
    "join_comma": "select n_name, r_name from nation, region where n_regionkey = r_regionkey and r_name <> 'ASIA'",
    "join_using": "select k, a.v as av, b.v as bv from (values (1, 'x'), (2, 'y')) as a(k, v) full join (values (2, 'p'), (3, 'q')) as b(k, v) using (k)",
    "join_natural": "select * from (values (1, 'x'), (2, 'y')) as a(k, v) natural join (values (2, 'p'), (3, 'q')) as b(k, w)",
    "join_theta": "select a.n_nationkey as x, b.n_nationkey as y from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey",
    "join_range": "select e.event_id, b.lo from events e join (values (0, 10), (10, 20), (90, 200)) as b(lo, hi) on e.value >= b.lo and e.value < b.hi",
    "join_residual": "select count(*) as n from lineitem l join orders o on l.l_orderkey = o.o_orderkey and l.l_extendedprice > o.o_totalprice * 0.2",
    "join_self": "select a.s_suppkey as x, b.s_suppkey as y from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey",
    "join_null_keys": f"select a.i, b.i as j from {_V.replace(' as t(', ' as a(')} left join {_V.replace(' as t(', ' as b(')} on a.i = b.i",
    "join_semi_anti": "select count(*) as n from part p where p_partkey in (select l_partkey from lineitem where l_quantity > 45) and not exists (select 1 from lineitem l where l.l_partkey = p.p_partkey and l.l_returnflag = 'R' and l.l_quantity > 48)",
    "join_lateral": "select c_custkey, x.o_orderkey from customer c cross join lateral (select o_orderkey from orders o where o.o_custkey = c.c_custkey order by o_totalprice desc, o_orderkey limit 1) as x",
    "join_left_lateral": "select s.s_suppkey, x.n from supplier s left join lateral (select count(*) as n from customer c where c.c_nationkey = s.s_nationkey and c.c_acctbal > s.s_acctbal) as x on true",
    "join_parenthesised": "select k, w from ((values (1, 'x'), (2, 'y')) as a(k, v) join (values (2, 'p')) as b(k2, w) on a.k = b.k2)",
    # Aggregates.
    "agg_basic": "select l_returnflag, count(*) as n, count(distinct l_suppkey) as d, round(sum(l_quantity), 2) as s, round(avg(l_quantity), 6) as a, min(l_quantity) as lo, max(l_shipdate) as hi from lineitem group by l_returnflag",
    "agg_sum_int": ("select sum(o_orderkey) as s, sum(distinct o_custkey) as d from orders", "select sum(o_orderkey)::bigint as s, sum(distinct o_custkey)::bigint as d from orders"),
    "agg_empty": "select count(*) as n, sum(l_quantity) as s, max(l_quantity) as m from lineitem where l_orderkey < 0",
    "agg_filter": "select o_orderstatus, count(*) filter (where o_totalprice > 200000) as big, round(sum(o_totalprice) filter (where o_orderpriority = '1-URGENT'), 2) as urgent from orders group by o_orderstatus",
    "agg_having": "select c_nationkey, count(*) as n from customer group by c_nationkey having count(*) > 3 and avg(c_acctbal) > 0",
    "agg_string_agg": "select n_regionkey, string_agg(n_name, ', ' order by n_name desc) as names, string_agg(distinct substring(n_name, 1, 3), '|') as p from nation group by n_regionkey",
    "agg_array_agg": ("select n_regionkey, array_to_string(array_agg(n_nationkey order by n_name desc), ',') as a, array_length(array_agg(distinct n_regionkey), 1) as d from nation group by n_regionkey", "select n_regionkey, array_to_string(array_agg(n_nationkey order by n_name desc), ',') as a, len(array_agg(distinct n_regionkey))::int as d from nation group by n_regionkey"),
    "agg_array_nulls": (f"select array_to_string(array_agg(s order by i nulls first), ',', '?') as a, count(s) as n from {_V}", f"select array_to_string(list_transform(array_agg(s order by i nulls first), lambda v: coalesce(v, '?')), ',') as a, count(s) as n from {_V}"),
    "agg_json": ("select n_regionkey, json_agg(n_nationkey order by n_nationkey) as a, json_object_agg(n_name, n_nationkey) as o from nation group by n_regionkey", "select n_regionkey, to_json(array_agg(n_nationkey order by n_nationkey)) as a, '{' || string_agg('\"' || n_name || '\":' || n_nationkey, ',' order by n_name) || '}' as o from nation group by n_regionkey"),
    "agg_bool": ("select o_orderstatus, bool_and(o_totalprice > 1000) as a, bool_or(o_totalprice > 400000) as b, every(o_custkey >= 0) as c from orders group by o_orderstatus", "select o_orderstatus, bool_and(o_totalprice > 1000) as a, bool_or(o_totalprice > 400000) as b, bool_and(o_custkey >= 0) as c from orders group by o_orderstatus"),
    "agg_any_value": "select n_regionkey, any_value(n_regionkey) as v from nation group by n_regionkey",
    "agg_stddev": "select l_returnflag, round(stddev(l_quantity), 6) as a, round(stddev_samp(l_quantity), 6) as b, round(stddev_pop(l_quantity), 6) as c, round(variance(l_quantity), 6) as d, round(var_samp(l_quantity), 6) as e, round(var_pop(l_quantity), 6) as f from lineitem group by l_returnflag",
    "agg_corr": "select round(corr(l_extendedprice, l_quantity), 6) as a, round(covar_pop(l_extendedprice, l_quantity), 3) as b, round(covar_samp(l_extendedprice, l_quantity), 3) as c from lineitem",
    "agg_regr": "select round(regr_slope(l_extendedprice, l_quantity), 4) as a, round(regr_intercept(l_extendedprice, l_quantity), 2) as b, regr_count(l_extendedprice, l_quantity)::bigint as c, round(regr_r2(l_extendedprice, l_quantity), 6) as d, round(regr_avgx(l_extendedprice, l_quantity), 6) as e, round(regr_avgy(l_extendedprice, l_quantity), 4) as f, round(regr_sxx(l_extendedprice, l_quantity), 1) as g, round(regr_sxy(l_extendedprice, l_quantity) / 1000, 1) as h, round(regr_syy(l_extendedprice, l_quantity) / 1000000, 1) as i from lineitem",
    "agg_percentile": "select l_returnflag, percentile_cont(0.5) within group (order by l_extendedprice) as med, percentile_disc(0.25) within group (order by l_quantity) as q1 from lineitem group by l_returnflag",
    "agg_mode": ("select mode() within group (order by o_orderstatus) as m from orders", "select o_orderstatus as m from orders group by o_orderstatus order by count(*) desc, o_orderstatus limit 1"),
    "agg_hypothetical": ("select rank(25) within group (order by l_quantity) as r, dense_rank(25) within group (order by l_quantity) as d, round(percent_rank(25) within group (order by l_quantity), 8) as p, round(cume_dist(25) within group (order by l_quantity), 8) as c from lineitem", "select count(*) filter (where l_quantity < 25) + 1 as r, count(distinct case when l_quantity < 25 then l_quantity end) + 1 as d, round(count(*) filter (where l_quantity < 25) / count(*), 8) as p, round((count(*) filter (where l_quantity <= 25) + 1) / (count(*) + 1), 8) as c from lineitem"),
    "agg_bits": "select n_regionkey, bit_and(n_nationkey) as a, bit_or(n_nationkey) as o from nation group by n_regionkey",
    "agg_expr_key": "select cast(extract(year from o_orderdate) as int) as y, o_orderpriority, count(*) as n from orders group by cast(extract(year from o_orderdate) as int), 2",
    "agg_grouping_sets": "select l_returnflag, l_linestatus, count(*) as n, grouping(l_returnflag) as g1, grouping(l_linestatus) as g2 from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "agg_rollup": "select r_name, n_name, count(*) as n from nation join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)",
    "agg_cube": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as q from lineitem group by cube (l_returnflag, l_linestatus)",
    "agg_mixed_sets": "select o_orderstatus, o_orderpriority, count(*) as n from orders group by o_orderstatus, grouping sets ((o_orderpriority), ())",
    "agg_empty_set": ("select count(*) as n from orders group by ()", "select count(*) as n from orders"),
    "agg_distinct": "select distinct o_orderstatus, o_orderpriority from orders",
    "agg_distinct_on": ("select distinct on (o_custkey) o_custkey, o_orderkey, round(o_totalprice, 2) as p from orders order by o_custkey, o_totalprice desc, o_orderkey",) * 2,
    "agg_count_distinct_pair": ("select count(distinct (o_custkey, o_orderstatus)) as n from orders",) * 2,
    # Windows.
    "win_ranking": "select o_orderkey, row_number() over w as rn, rank() over (partition by o_orderstatus order by o_orderpriority) as r, dense_rank() over (partition by o_orderstatus order by o_orderpriority) as d from orders window w as (partition by o_custkey order by o_totalprice desc, o_orderkey)",
    "win_offset": "select event_id, lag(event_id) over w as a, lead(event_id, 2, -1) over w as b, lag(value, 1, 0.0) over w as c from events window w as (partition by user_id order by ts, event_id)",
    "win_distribution": "select c_custkey, ntile(4) over (order by c_acctbal, c_custkey) as q, round(percent_rank() over (order by c_acctbal, c_custkey), 8) as p, round(cume_dist() over (order by c_nationkey), 8) as d from customer",
    "win_values": "select event_id, first_value(event_id) over w as f, last_value(event_id) over w as l, nth_value(event_id, 2) over w as n from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following)",
    "win_running": "select o_orderkey, round(sum(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey), 2) as s, count(*) over (partition by o_custkey) as n, round(avg(o_totalprice) over (partition by o_custkey), 1) as a, min(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as lo from orders",
    "win_default_frame": f"select i, sum(i) over (order by s) as a, count(*) over () as n from {_V}".replace("sum(i)", "count(i)"),
    "win_rows": "select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between 2 preceding and 1 following), 4) as s, round(avg(value) over (partition by user_id order by ts, event_id rows 3 preceding), 6) as a from events",
    "win_range": "select o_orderkey, count(*) over (partition by o_custkey order by o_totalprice range between 50000 preceding and 50000 following) as n from orders",
    "win_range_interval": "select o_orderkey, count(*) over (partition by o_custkey order by o_orderdate range between interval '90 days' preceding and current row) as n from orders",
    "win_groups": "select event_id, count(*) over (partition by user_id order by event_type groups between 1 preceding and current row) as n, round(sum(value) over (partition by user_id order by event_type groups between unbounded preceding and 1 following), 4) as s from events",
    "win_exclude": "select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between 2 preceding and 2 following exclude current row), 4) as s, count(*) over (partition by user_id order by event_type groups between 1 preceding and 1 following exclude group) as g, count(*) over (partition by user_id order by event_type range between unbounded preceding and current row exclude ties) as t from events",
    "win_filter": "select event_id, count(*) filter (where value > 50) over (partition by user_id) as n from events",
    "win_distinct": "select event_id, count(distinct event_type) over (partition by user_id) as n from events",
    "win_named_inherit": "select o_orderkey, sum(o_orderkey) over (w order by o_orderdate, o_orderkey) as s from orders window w as (partition by o_custkey)".replace("sum(o_orderkey)", "max(o_orderkey)"),
    "win_ignore_nulls": (f"select i, last_value(s) ignore nulls over (order by i nulls last rows between unbounded preceding and current row) as v from {_V}", f"select i, last_value(s ignore nulls) over (order by i nulls last rows between unbounded preceding and current row) as v from {_V}"),
    "win_string_agg": "select n_nationkey, string_agg(n_name, ',') over (partition by n_regionkey order by n_nationkey) as s from nation",
    "win_top_per_group": "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) as q where rn <= 2",
    "win_gaps_islands": "select user_id, island, count(*) as n from (select user_id, sum(case when event_type = 'click' then 1 else 0 end) over (partition by user_id order by ts, event_id) as island from events) as q group by user_id, island".replace("island,", "cast(island as bigint) as island,", 1),
    "win_stats": "select c_custkey, round(stddev_pop(c_acctbal) over (partition by c_nationkey), 4) as s, bool_or(c_acctbal > 9000) over (partition by c_nationkey) as b from customer",
    # Sorting.
    "sort_topk": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10",
    "sort_nulls": f"select i, s from {_V} order by s desc nulls last, i nulls first limit 3",
    "sort_default_nulls": (f"select i from {_V} order by i limit 3", f"select i from {_V} order by i nulls last limit 3"),
    "sort_offset": "select c_custkey from customer order by c_acctbal, c_custkey limit 5 offset 7",
    "sort_ordinal": "select c_mktsegment, count(*) as n from customer group by 1 order by 2 desc, 1 limit 3",
    "sort_hidden": "select c_name from customer order by c_acctbal desc, c_custkey limit 4",
    "sort_fetch": ("select c_custkey from customer order by c_custkey offset 2 rows fetch first 3 rows only", "select c_custkey from customer order by c_custkey limit 3 offset 2"),
    # Set operations, CTEs, recursion.
    "set_union_all": "select n_regionkey as k from nation union all select r_regionkey from region",
    "set_union": "select n_regionkey as k from nation union select c_nationkey from customer",
    "set_intersect": "select c_nationkey as k from customer intersect select s_nationkey from supplier",
    "set_intersect_all": "select n_regionkey as k from nation intersect all select i from (values (0), (0), (1), (9)) as v(i)",
    "set_except": "select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 5000",
    "set_except_all": "select n_regionkey as k from nation except all select r_regionkey from region",
    "set_precedence": "select 1 as k union select 2 intersect select 3 union all select 1",
    "set_parenthesised": "(select 1 as k union all select 2) except (select 2 union select 5)",
    "cte_multiple": "with a as (select c_nationkey as k, count(*) as n from customer group by c_nationkey), b(k, m) as (select s_nationkey, count(*) from supplier group by s_nationkey) select a.k, a.n, b.m from a join b on a.k = b.k",
    "cte_materialized": "with a as materialized (select * from region), b as not materialized (select count(*) as n from a) select a.r_name, b.n from a, b",
    "cte_nested": "with a as (with b as (select 1 as x) select x + 1 as y from b) select y from a",
    "cte_recursive": "with recursive t(n) as (select 1 union all select n + 1 from t where n < 20) select n from t",
    "cte_recursive_union": "with recursive t(n) as (select 1 union select (n * 3) % 17 from t) select n from t",
    "cte_recursive_tree": "with recursive t(k, d) as (select r_regionkey, 0 from region where r_regionkey = 0 union all select n.n_nationkey + 100, t.d + 1 from t join nation n on n.n_regionkey = t.k where t.d < 2) select k, d from t",
    "cte_cycle": ("with recursive g(a, b) as (values (1, 2), (2, 3), (3, 1)), t(n) as (select 1 union all select g.b from t join g on g.a = t.n) cycle n set is_cycle using path select n, is_cycle from t", "select * from (values (1, false), (2, false), (3, false), (1, true)) as v(n, is_cycle)"),
    # Functions in FROM.
    "srf_generate_series": "select g from generate_series(2, 14, 3) as t(g)",
    "srf_generate_series_down": "select g from generate_series(5, 1, -2) as t(g)",
    "srf_generate_series_empty": "select g from generate_series(3, 1) as t(g)",
    "srf_generate_series_time": "select g from generate_series(timestamp '2024-01-01', timestamp '2024-01-02', interval '6 hours') as t(g)",
    "srf_unnest": "select u from unnest(array[3, 1, 2]) as t(u)",
    "srf_unnest_ordinality": ("select x, o from unnest(array['a', 'b']) with ordinality as t(x, o)", "select * from (values ('a', 1), ('b', 2)) as v(x, o)"),
    "srf_unnest_lateral": ("select n_nationkey, w from nation, unnest(string_to_array(n_name, '_')) as t(w)", "select n_nationkey, unnest(string_split(n_name, '_')) as w from nation"),
    "srf_unnest_select": "select n_nationkey, unnest(array[1, 2]) as u from nation",
    "srf_json_array_elements": ("select j from json_array_elements('[1, {\"a\": 2}, \"x\"]') as t(j)", "select * from (values ('1'), ('{\"a\":2}'), ('\"x\"')) as v(j)"),
    "srf_json_array_elements_text": ("select j from json_array_elements_text('[\"p\", \"q\", 3]') as t(j)", "select * from (values ('p'), ('q'), ('3')) as v(j)"),
    "srf_json_each": ("select key, value from json_each('{\"a\": 1, \"b\": \"x\"}') as t(key, value)", "select * from (values ('a', '1'), ('b', '\"x\"')) as v(key, value)"),
    "srf_json_each_text": ("select event_type, t.key, count(*) as n from events, json_each_text(props) as t(key, value) group by event_type, t.key", "select event_type, k as key, count(*) as n from (select event_type, unnest(json_keys(props)) as k from events) as q group by event_type, k"),
    "srf_json_object_keys": ("select k, count(*) as n from events, json_object_keys(props) as t(k) group by k", "select k, count(*) as n from (select unnest(json_keys(props)) as k from events) as q group by k"),
    "srf_jsonb_path_query": ("select j from jsonb_path_query('{\"a\": [1, 2, 3, 4]}', '$.a[*] ? (@ > 2)') as t(j)", "select * from (values ('3'), ('4')) as v(j)"),
    "srf_json_to_record": ("select a, b from json_to_record('{\"a\": 5, \"b\": \"q\"}') as t(a int, b text)", "select 5 as a, 'q' as b"),
    "srf_json_to_recordset": ("select a, b from json_to_recordset('[{\"a\": 1, \"b\": \"x\"}, {\"a\": 2}]') as t(a int, b text)", "select * from (values (1, 'x'), (2, null)) as v(a, b)"),
    "srf_jsonb_names": ("select (select count(*) from jsonb_array_elements('[1, 2]') as a(j)) as a, (select string_agg(j, ',' order by j) from jsonb_array_elements_text('[\"q\", \"p\"]') as b(j)) as b, (select string_agg(key || value, ',' order by key) from jsonb_each('{\"x\": 1, \"y\": true}') as c(key, value)) as c, (select string_agg(key || value, ',' order by key) from jsonb_each_text('{\"x\": 1}') as d(key, value)) as d, (select max(k) from jsonb_object_keys('{\"a\": 1, \"b\": 2}') as e(k)) as e, (select max(a) from jsonb_to_record('{\"a\": 4}') as f(a int)) as f, (select sum(a) from jsonb_to_recordset('[{\"a\": 1}, {\"a\": 5}]') as g(a int)) as g, (select sum(a) from jsonb_populate_recordset(null, '[{\"a\": 1}, {\"a\": 6}]') as h(a int)) as h, (select max(a) from json_populate_record(null, '{\"a\": 9}') as i(a int)) as i", "select 2::bigint as a, 'p,q' as b, 'x1,ytrue' as c, 'x1' as d, 'b' as e, 4 as f, 6::bigint as g, 7::bigint as h, 9 as i"),
    "agg_jsonb": ("select n_regionkey, jsonb_agg(n_name order by n_nationkey) as a, jsonb_object_agg(n_name, n_regionkey) as o, bit_xor(n_nationkey) as x from nation group by n_regionkey", "select n_regionkey, '[' || string_agg('\"' || n_name || '\"', ',' order by n_nationkey) || ']' as a, '{' || string_agg('\"' || n_name || '\":' || n_regionkey, ',' order by n_name) || '}' as o, bit_xor(n_nationkey) as x from nation group by n_regionkey"),
    "srf_regexp_matches": ("select array_to_string(m, '-') as m from regexp_matches('foo1bar22', '([a-z]+)([0-9]+)', 'g') as t(m)", "select * from (values ('foo-1'), ('bar-22')) as v(m)"),
    "srf_regexp_split_to_table": ("select w, count(*) as n from nation, regexp_split_to_table(n_name, '_') as t(w) group by w", "select w, count(*) as n from (select unnest(string_split(n_name, '_')) as w from nation) as q group by w"),
    "srf_string_to_table": ("select w from string_to_table('a,b,,c', ',') as t(w)", "select unnest(['a', 'b', '', 'c']) as w"),
}
