"""TPC-H shapes over the tables at hand, and click-analytics shapes over events."""

QUERIES: dict[str, str | tuple[str, str]] = {
    "tpch_q01": """
select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base_price,
  round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge,
  round(avg(l_quantity), 6) as avg_qty, round(avg(l_extendedprice), 6) as avg_price, round(avg(l_discount), 6) as avg_disc, count(*) as count_order
from lineitem where l_shipdate <= timestamp '1998-09-02' group by l_returnflag, l_linestatus order by l_returnflag, l_linestatus""",
    "tpch_q02": """
select p.p_partkey, s.s_name, n.n_name, round(s.s_acctbal, 2) as s_acctbal, round(l.l_extendedprice, 2) as price
from part p join lineitem l on l.l_partkey = p.p_partkey join supplier s on s.s_suppkey = l.l_suppkey join nation n on n.n_nationkey = s.s_nationkey join region r on r.r_regionkey = n.n_regionkey
where p.p_size < 15 and r.r_name = (select min(r_name) from region) and l.l_extendedprice = (select min(l2.l_extendedprice) from lineitem l2 where l2.l_partkey = p.p_partkey)
order by s_acctbal desc, p.p_partkey, s.s_name, price limit 100""",
    "tpch_q03": """
select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, o_orderdate
from customer, orders, lineitem where c_mktsegment = 'BUILDING' and c_custkey = o_custkey and l_orderkey = o_orderkey and o_orderdate < timestamp '1997-03-15' and l_shipdate > timestamp '1997-03-15'
group by l_orderkey, o_orderdate order by revenue desc, o_orderdate, l_orderkey limit 10""",
    "tpch_q04": """
select o_orderpriority, count(*) as order_count from orders o
where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1996-01-01' + interval '3 months' and exists (select * from lineitem l where l.l_orderkey = o.o_orderkey and l.l_shipdate > o.o_orderdate)
group by o_orderpriority order by o_orderpriority""",
    "tpch_q05": """
select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer, orders, lineitem, supplier, nation, region
where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and c_nationkey = s_nationkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey
group by n_name order by revenue desc, n_name""",
    "tpch_q06": """
select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem
where l_shipdate >= date '1997-01-01' and l_shipdate < date '1997-01-01' + interval '1 year' and l_discount between 0.02 and 0.08 and l_quantity < 24""",
    "tpch_q07": """
select supp_nation, cust_nation, l_year, round(sum(volume), 2) as revenue from (
  select n1.n_name as supp_nation, n2.n_name as cust_nation, cast(extract(year from l_shipdate) as int) as l_year, l_extendedprice * (1 - l_discount) as volume
  from supplier, lineitem, orders, customer, nation n1, nation n2
  where s_suppkey = l_suppkey and o_orderkey = l_orderkey and c_custkey = o_custkey and s_nationkey = n1.n_nationkey and c_nationkey = n2.n_nationkey and n1.n_nationkey < 3 and n2.n_nationkey < 3) as shipping
group by supp_nation, cust_nation, l_year order by supp_nation, cust_nation, l_year""",
    "tpch_q08": """
select o_year, round(sum(case when nation = 'NATION_1' then volume else 0 end) / sum(volume), 6) as mkt_share from (
  select cast(extract(year from o_orderdate) as int) as o_year, l_extendedprice * (1 - l_discount) as volume, n2.n_name as nation
  from part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  where p_partkey = l_partkey and s_suppkey = l_suppkey and l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n1.n_nationkey and n1.n_regionkey = r_regionkey and s_nationkey = n2.n_nationkey) as all_nations
group by o_year order by o_year""",
    "tpch_q09": """
select nation, o_year, round(sum(amount), 2) as sum_profit from (
  select n_name as nation, cast(extract(year from o_orderdate) as int) as o_year, l_extendedprice * (1 - l_discount) - 0.5 * p_retailprice * l_quantity as amount
  from part, supplier, lineitem, orders, nation where s_suppkey = l_suppkey and p_partkey = l_partkey and o_orderkey = l_orderkey and s_nationkey = n_nationkey and p_name like '%1%') as profit
group by nation, o_year order by nation, o_year desc""",
    "tpch_q10": """
select c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, round(c_acctbal, 2) as c_acctbal, n_name from customer, orders, lineitem, nation
where c_custkey = o_custkey and l_orderkey = o_orderkey and l_returnflag = 'R' and c_nationkey = n_nationkey
group by c_custkey, c_name, c_acctbal, n_name order by revenue desc, c_custkey limit 20""",
    "tpch_q11": """
select l_partkey, round(sum(l_extendedprice), 2) as value from lineitem, supplier, nation where l_suppkey = s_suppkey and s_nationkey = n_nationkey and n_nationkey < 8
group by l_partkey having sum(l_extendedprice) > (select sum(l_extendedprice) * 0.002 from lineitem, supplier where l_suppkey = s_suppkey and s_nationkey < 8) order by value desc, l_partkey""",
    "tpch_q12": """
select l_linestatus, sum(case when o_orderpriority = '1-URGENT' or o_orderpriority = '2-HIGH' then 1 else 0 end)::bigint as high_line_count, sum(case when o_orderpriority <> '1-URGENT' and o_orderpriority <> '2-HIGH' then 1 else 0 end)::bigint as low_line_count
from orders, lineitem where o_orderkey = l_orderkey and l_linestatus in ('F', 'O') and l_shipdate >= timestamp '1997-01-01' group by l_linestatus order by l_linestatus""",
    "tpch_q13": """
select c_count, count(*) as custdist from (select c_custkey, count(o_orderkey) as c_count from customer left outer join orders on c_custkey = o_custkey and o_orderpriority not like '%URGENT%' group by c_custkey) as c_orders
group by c_count order by custdist desc, c_count desc""",
    "tpch_q14": """
select round(100.00 * sum(case when p_type like 'PROMO%' then l_extendedprice * (1 - l_discount) else 0 end) / sum(l_extendedprice * (1 - l_discount)), 6) as promo_revenue
from lineitem, part where l_partkey = p_partkey and l_shipdate >= timestamp '1996-09-01'""",
    "tpch_q15": """
with revenue as (select l_suppkey as supplier_no, sum(l_extendedprice * (1 - l_discount)) as total_revenue from lineitem where l_shipdate >= timestamp '1996-01-01' group by l_suppkey)
select s_suppkey, s_name, round(total_revenue, 2) as total_revenue from supplier, revenue where s_suppkey = supplier_no and round(total_revenue, 2) = (select round(max(total_revenue), 2) from revenue) order by s_suppkey""",
    "tpch_q16": """
select p_brand, p_type, p_size, count(distinct l_suppkey) as supplier_cnt from lineitem, part where p_partkey = l_partkey and p_size in (1, 4, 9, 14, 19, 23, 36, 45) and l_suppkey not in (select s_suppkey from supplier where s_acctbal < 0)
group by p_brand, p_type, p_size order by supplier_cnt desc, p_brand, p_type, p_size""",
    "tpch_q17": """
select round(sum(l_extendedprice) / 7.0, 4) as avg_yearly from lineitem, part where p_partkey = l_partkey and l_quantity < (select 0.5 * avg(l2.l_quantity) from lineitem l2 where l2.l_partkey = p_partkey)""",
    "tpch_q18": """
select c_name, c_custkey, o_orderkey, o_orderdate, round(o_totalprice, 2) as o_totalprice, round(sum(l_quantity), 2) as qty from customer, orders, lineitem
where o_orderkey in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity) > 150) and c_custkey = o_custkey and o_orderkey = l_orderkey
group by c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice order by o_totalprice desc, o_orderdate, o_orderkey limit 100""",
    "tpch_q19": """
select round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from lineitem, part
where p_partkey = l_partkey and ((p_size between 1 and 15 and l_quantity between 1 and 11) or (p_size between 10 and 30 and l_quantity between 10 and 20) or (p_size > 30 and l_quantity >= 40 and l_returnflag = 'R'))""",
    "tpch_q20": """
select s_name, s_suppkey from supplier, nation where s_suppkey in (select l_suppkey from lineitem where l_partkey in (select p_partkey from part where p_name like '%2%') group by l_suppkey having sum(l_quantity) > 100) and s_nationkey = n_nationkey and n_nationkey < 20 order by s_name, s_suppkey""",
    "tpch_q21": """
select s_name, count(*) as numwait from supplier, lineitem l1, orders, nation
where s_suppkey = l1.l_suppkey and o_orderkey = l1.l_orderkey and o_orderstatus = 'F' and s_nationkey = n_nationkey
  and exists (select * from lineitem l2 where l2.l_orderkey = l1.l_orderkey and l2.l_suppkey <> l1.l_suppkey) and not exists (select * from lineitem l3 where l3.l_orderkey = l1.l_orderkey and l3.l_suppkey <> l1.l_suppkey and l3.l_returnflag = 'R')
group by s_name order by numwait desc, s_name limit 100""",
    "tpch_q22": """
select c_mktsegment, count(*) as numcust, round(sum(c_acctbal), 2) as totacctbal from customer c
where c_acctbal > (select avg(c_acctbal) from customer where c_acctbal > 0) and not exists (select * from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 300000) group by c_mktsegment order by c_mktsegment""",
    "click_count": "select count(*) as n from events",
    "click_count_filter": "select count(*) as n from events where event_type <> 'view'",
    "click_sums": "select round(sum(value), 4) as s, count(*) as n, round(avg(value), 6) as a from events",
    "click_distinct_users": "select count(distinct user_id) as users from events",
    "click_distinct_types": "select count(distinct event_type) as types from events",
    "click_min_max": "select min(ts) as first, max(ts) as last from events",
    "click_group_count": "select event_type, count(*) as n from events where event_type <> '' group by event_type order by n desc, event_type",
    "click_users_by_type": "select event_type, count(distinct user_id) as u from events group by event_type order by u desc, event_type limit 10",
    "click_type_metrics": "select event_type, round(sum(value), 4) as s, count(*) as c, round(avg(value), 6) as a, count(distinct user_id) as u from events group by event_type order by c desc, event_type limit 10",
    "click_top_users": "select user_id, count(*) as n from events group by user_id order by n desc, user_id limit 10",
    "click_user_type": "select user_id, event_type, count(*) as n from events group by user_id, event_type order by n desc, user_id, event_type limit 10",
    "click_user_minute": ("select user_id, cast(extract(minute from ts) as int) as m, event_type, count(*) as n from events group by user_id, m, event_type order by n desc, user_id, m, event_type limit 10",) * 2,
    "click_point_lookup": "select event_id, user_id from events where user_id = 42",
    "click_like": "select count(*) as n from events where props like '%1%'",
    "click_like_group": "select event_type, min(props) as p, count(*) as n from events where props like '%2%' and event_type <> '' group by event_type order by n desc, event_type limit 10",
    "click_star_topk": "select * from events where props like '%7%' order by ts, event_id limit 10",
    "click_length_having": "select event_type, round(avg(length(props)), 6) as l, count(*) as n from events group by event_type having count(*) > 100 order by l desc, event_type limit 25",
    "click_regexp": "select regexp_replace(props, '[0-9]+', '#', 'g') as k, count(*) as n from events group by k order by n desc, k limit 10",
    "click_wide_sums": ("select " + ", ".join(f"round(sum(value + {k}), 3) as s{k}" for k in range(30)) + " from events",) * 2,
    "click_minute_buckets": "select date_trunc('minute', ts) as m, count(*) as views from events group by date_trunc('minute', ts) order by m limit 100 offset 10",
    "click_case_key": "select case when value > 50 then event_type else '' end as src, user_id, count(*) as n from events group by src, user_id order by n desc, src, user_id limit 10 offset 3",
    "click_order_offset": "select user_id, round(sum(value), 4) as s from events group by user_id order by s desc, user_id limit 10 offset 100",
}
