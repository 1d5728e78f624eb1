"""Queries that change tables, use the DataFrame interface, or follow a stream; each has its oracle in DuckDB's SQL."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark import system
from tidemark.engine import Engine
from tidemark.operators import asof, dml, recursive
from tidemark.sources import foreign, readers
from tidemark.streaming import cdc


def _engine(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    return Engine(spark).load(sf_dir, list(names))


def _customers(spark: SparkSession, sf_dir: str) -> Engine:
    e = _engine(spark, sf_dir, "customer", "orders")
    e.sql("create table c as select c_custkey, c_name, c_nationkey, c_acctbal from customer")
    return e


def dml_insert(spark, sf_dir):
    e = _engine(spark, sf_dir, "nation")
    e.sql("create table t (k int primary key, name text default 'none', v float8 check (v >= 0)); insert into t select n_nationkey, n_name, 1.5 from nation; insert into t (k, v) values (100, 2), (101, 3)")
    return e.query("select k, name, v from t")


def dml_insert_returning(spark, sf_dir):
    e = Engine(spark)
    e.sql("create table t (id serial primary key, s text)")
    return e.sql("insert into t (s) values ('a'), ('b'), ('c') returning s, upper(s) as u").df


def dml_update(spark, sf_dir):
    e = _customers(spark, sf_dir)
    e.sql("update c set c_acctbal = c_acctbal * 2, c_name = upper(c_name) where c_nationkey < 5")
    return e.query("select c_custkey, c_name, round(c_acctbal, 4) as c_acctbal from c")


def dml_update_from(spark, sf_dir):
    e = _customers(spark, sf_dir)
    e.sql("update c set c_acctbal = s.total from (select o_custkey, sum(o_totalprice) as total from orders group by o_custkey) as s where c.c_custkey = s.o_custkey")
    return e.query("select c_custkey, round(c_acctbal, 2) as c_acctbal from c")


def dml_delete(spark, sf_dir):
    e = _customers(spark, sf_dir)
    e.sql("delete from c where c_acctbal < 0 or c_nationkey = 3")
    return e.query("select c_custkey from c")


def dml_delete_using(spark, sf_dir):
    e = _customers(spark, sf_dir)
    e.sql("delete from c using orders as o where c.c_custkey = o.o_custkey and o.o_totalprice > 300000")
    return e.query("select c_custkey from c")


def dml_upsert(spark, sf_dir):
    e = _customers(spark, sf_dir)
    e.sql("create unique index ck on c (c_custkey)")
    e.sql("insert into c select c_custkey + 50, 'new', 1, 10.0 from customer on conflict (c_custkey) do update set c_acctbal = c.c_acctbal + excluded.c_acctbal where c.c_nationkey < 10")
    return e.query("select c_custkey, c_name, round(c_acctbal, 4) as c_acctbal from c")


def dml_upsert_nothing(spark, sf_dir):
    e = _customers(spark, sf_dir)
    e.sql("create unique index ck on c (c_custkey)")
    e.sql("insert into c select c_custkey + 50, 'new', 1, 10.0 from customer on conflict (c_custkey) do nothing")
    return e.query("select c_custkey, c_name from c")


def dml_merge(spark, sf_dir):
    e = _customers(spark, sf_dir)
    e.sql("""merge into c using (select o_custkey as k, count(*) as n from orders group by o_custkey) as s on c.c_custkey = s.k
             when matched and s.n > 14 then delete when matched then update set c_acctbal = s.n
             when not matched by source and c.c_nationkey < 12 then update set c_name = 'idle'""")
    return e.query("select c_custkey, c_name, round(c_acctbal, 4) as c_acctbal from c")


def dml_merge_insert(spark, sf_dir):
    e = _customers(spark, sf_dir)
    e.sql("merge into c using (select c_custkey + 100 as k, c_acctbal as b from customer) as s on c.c_custkey = s.k when matched then do nothing when not matched then insert (c_custkey, c_name, c_nationkey, c_acctbal) values (s.k, 'added', 0, s.b)")
    return e.query("select c_custkey, c_name, round(c_acctbal, 4) as c_acctbal from c")


def dml_truncate(spark, sf_dir):
    e = _customers(spark, sf_dir)
    e.sql("truncate table c")
    return e.query("select count(*) as n from c")


def dml_transaction(spark, sf_dir):
    e = _customers(spark, sf_dir)
    e.sql("begin; delete from c where c_nationkey < 10; savepoint s; delete from c; rollback to savepoint s; commit; begin; truncate c; rollback")
    return e.query("select count(*) as n, min(c_nationkey) as lo from c")


def ddl_alter(spark, sf_dir):
    e = _customers(spark, sf_dir)
    e.sql("alter table c add column tag text default 'x'; alter table c rename column c_name to label; alter table c drop column c_nationkey; alter table c alter column c_acctbal type int using floor(c_acctbal)::int")
    return e.query("select c_custkey, label, c_acctbal, tag from c")


def ddl_views(spark, sf_dir):
    e = _customers(spark, sf_dir)
    e.sql("create view rich as select c_custkey, c_acctbal from c where c_acctbal > 5000; create materialized view m as select count(*) as n from rich; delete from c where c_custkey < 500; refresh materialized view m")
    return e.query("select (select n from m) as n, count(*) as live from rich")


def ddl_sequence(spark, sf_dir):
    e = Engine(spark)
    e.sql("create sequence s start with 10 increment by 5; select nextval('s'); select nextval('s'); select setval('s', 100)")
    return e.query("select nextval('s') as n, currval('s') as c, lastval() as l")


def ddl_types(spark, sf_dir):
    e = Engine(spark)
    e.sql("create type mood as enum ('sad', 'ok', 'happy'); create domain pos as int check (value > 0); create table t (m mood, p pos); insert into t values ('ok', 3), ('happy', 1)")
    return e.query("select m, p from t")


def fn_sql_scalar(spark, sf_dir):
    e = _engine(spark, sf_dir, "customer")
    e.sql("create function net(b float8, r float8) returns float8 language sql as $$ select b * (1 - r) $$")
    return e.query("select c_custkey, net(c_acctbal, 0.1) as v from customer")


def fn_sql_table(spark, sf_dir):
    e = _engine(spark, sf_dir, "nation")
    e.sql("create function in_region(r int) returns table (k int, name text) language sql as $$ select n_nationkey, n_name from nation where n_regionkey = r $$")
    return e.query("select k, name from in_region(2) as f")


def sys_columns(spark, sf_dir):
    e = _engine(spark, sf_dir, "region")
    return e.query("select column_name, data_type, ordinal_position from information_schema.columns where table_name = 'region'")


def sys_catalog(spark, sf_dir):
    e = _engine(spark, sf_dir, "region", "nation")
    return e.query("select c.relname, count(*) as n from pg_catalog.pg_class c join pg_catalog.pg_attribute a on a.attrelid = c.oid group by c.relname")


def sys_relations(spark, sf_dir):
    """Every system relation can be read."""
    e = _engine(spark, sf_dir, "region")
    e.sql("create view v as select r_name from region; create sequence s; create type mood as enum ('a', 'b')")
    return e.query(" union all ".join(f"select '{name}' as relation, count(*) >= 0 as ok from {name}" for name in system.RELATIONS))


def rls_filter(spark, sf_dir):
    e = _customers(spark, sf_dir)
    e.sql("alter table c enable row level security; create policy p on c for select using (c_nationkey = 4); set role alice")
    return e.query("select c_custkey from c")


def prepared_statement(spark, sf_dir):
    e = _engine(spark, sf_dir, "nation")
    e.sql("prepare q as select n_name from nation where n_regionkey = $1 and n_nationkey > $2")
    return e.sql("execute q(1, 5)").df


def source_csv_copy(spark, sf_dir):
    e = _engine(spark, sf_dir, "nation")
    at = recursive.shared_dir(spark) + f"/copy-{tempfile.mktemp(dir='')}"
    e.sql(f"copy nation to '{at}' with (format csv, header true); create table t (k int, name text, r int); copy t from '{at}' with (format csv, header true)")
    return e.query("select k, name, r from t")


def source_parquet_scan(spark, sf_dir):
    return Engine(spark).query(f"select r_regionkey, r_name from parquet_scan('{sf_dir}/region.parquet') as p")


def source_json_table(spark, sf_dir):
    return readers.json_table(spark, json.dumps({"items": [{"a": 1, "b": "x"}, {"a": 2.5, "b": None}]}), "items")


def source_foreign(spark, sf_dir):
    foreign.register(spark)
    return spark.read.format("tidemark_series").option("rows", 25).load().agg(F.count("*").alias("n"), F.max("id").alias("hi"))


def join_asof(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    clicks, views = events.filter("event_type = 'click'"), events.filter("event_type = 'view'")
    return asof.join(clicks.select("event_id", "user_id", "ts"), views.select("user_id", "ts", F.col("event_id").alias("view_id")), "user_id", "ts", "view_id")


def join_band(spark, sf_dir):
    """Pairs within a distance by buckets of that width, not by all pairs."""
    s, c = spark.read.parquet(f"{sf_dir}/supplier.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    return asof.band(s.select("s_suppkey", "s_acctbal"), c.select("c_custkey", "c_acctbal"), "s_acctbal", "c_acctbal", 5.0)


def vector_average(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    each = rows.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("m"))
    return each.select("label", F.col("i").alias("i"), "m")


def stream_cdc(spark, sf_dir):
    start = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    replica = cdc.Replica(start, ["n_nationkey"])
    changes = start.select(F.when(F.col("n_nationkey") % 3 == 0, "delete").otherwise("update").alias("op"), F.col("n_nationkey").cast("long").alias("lsn"), "n_nationkey", F.upper(F.concat("n_name", F.lit("!"))).alias("n_name"))
    more = spark.createDataFrame([("insert", 1000, 77, "X"), ("update", 1001, 77, "Y"), ("insert", 1002, 78, "Z"), ("delete", 1003, 78, None)], replica.change_schema())
    replica.apply(changes, 0)
    replica.apply(changes, 0)
    replica.apply(more, 1)
    return replica.table()


def stream_windows(spark, sf_dir):
    """The plan that a stream of events would run, over the whole table."""
    return cdc.event_windows(spark.read.parquet(f"{sf_dir}/events.parquet"), "6 hours")


def stream_sessions(spark, sf_dir):
    return cdc.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), "2 hours")


def op_update_plan(spark, sf_dir):
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return dml.update(nation, "t", {"n_name": "lower(n_name)"}, "n_regionkey = 2").select("n_nationkey", "n_name", F.col("__changed").alias("changed"))


_C = "select c_custkey, c_name, c_nationkey, c_acctbal from customer"

ORACLE = {
    "dml_insert": "select n_nationkey as k, n_name as name, 1.5::double as v from nation union all values (100, 'none', 2.0::double), (101, 'none', 3.0::double)",
    "dml_insert_returning": "select * from (values ('a', 'A'), ('b', 'B'), ('c', 'C')) as v(s, u)",
    "dml_update": "select c_custkey, case when c_nationkey < 5 then upper(c_name) else c_name end as c_name, round(case when c_nationkey < 5 then c_acctbal * 2 else c_acctbal end, 4) as c_acctbal from customer",
    "dml_update_from": "select c_custkey, round(coalesce((select sum(o_totalprice) from orders where o_custkey = c_custkey), c_acctbal), 2) as c_acctbal from customer",
    "dml_delete": "select c_custkey from customer where not (c_acctbal < 0 or c_nationkey = 3)",
    "dml_delete_using": "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 300000)",
    "dml_upsert": f"select coalesce(c.c_custkey, n.k) as c_custkey, coalesce(c.c_name, 'new') as c_name, round(case when c.c_custkey is null then 10.0 when n.k is not null and c.c_nationkey < 10 then c.c_acctbal + 10.0 else c.c_acctbal end, 4) as c_acctbal from ({_C}) c full join (select c_custkey + 50 as k from customer) n on c.c_custkey = n.k",
    "dml_upsert_nothing": f"select coalesce(c.c_custkey, n.k) as c_custkey, coalesce(c.c_name, 'new') as c_name from ({_C}) c full join (select c_custkey + 50 as k from customer) n on c.c_custkey = n.k",
    "dml_merge": f"select c_custkey, case when n is null and c_nationkey < 12 then 'idle' else c_name end as c_name, round(case when n is not null then n else c_acctbal end, 4) as c_acctbal from ({_C}) c left join (select o_custkey as k, count(*) as n from orders group by o_custkey) s on c_custkey = k where n is null or n <= 14",
    "dml_merge_insert": f"select c_custkey, c_name, round(c_acctbal, 4) as c_acctbal from ({_C}) union all select c_custkey + 100, 'added', round(c_acctbal, 4) from customer where c_custkey + 100 not in (select c_custkey from customer)",
    "dml_truncate": "select 0::bigint as n",
    "dml_transaction": "select count(*) as n, min(c_nationkey) as lo from customer where c_nationkey >= 10",
    "ddl_alter": "select c_custkey, c_name as label, floor(c_acctbal)::int as c_acctbal, 'x' as tag from customer",
    "ddl_views": "select count(*) as n, count(*) as live from customer where c_acctbal > 5000 and c_custkey >= 500",
    "ddl_sequence": "select 105::bigint as n, 105::bigint as c, 105::bigint as l",
    "ddl_types": "select * from (values ('ok', 3), ('happy', 1)) as v(m, p)",
    "fn_sql_scalar": "select c_custkey, c_acctbal * (1 - 0.1::double) as v from customer",
    "fn_sql_table": "select n_nationkey as k, n_name as name from nation where n_regionkey = 2",
    "sys_columns": "select * from (values ('r_regionkey', 'integer', 1), ('r_name', 'text', 2)) as v(column_name, data_type, ordinal_position)",
    "sys_catalog": "select * from (values ('region', 2::bigint), ('nation', 3::bigint)) as v(relname, n)",
    "sys_relations": "select unnest([" + ", ".join(f"'{name}'" for name in system.RELATIONS) + "]) as relation, true as ok",
    "rls_filter": "select c_custkey from customer where c_nationkey = 4",
    "prepared_statement": "select n_name from nation where n_regionkey = 1 and n_nationkey > 5",
    "source_csv_copy": "select n_nationkey as k, n_name as name, n_regionkey as r from nation",
    "source_parquet_scan": "select r_regionkey, r_name from region",
    "source_json_table": "select * from (values (1.0::double, 'x'), (2.5::double, null)) as v(a, b)",
    "source_foreign": "select 25::bigint as n, 24::bigint as hi",
    "join_asof": "select c.event_id, c.user_id, c.ts, v.event_id as view_id from (select * from events where event_type = 'click') c left join lateral (select max(event_id) as event_id from events v where v.event_type = 'view' and v.user_id = c.user_id and v.ts = (select max(ts) from events w where w.event_type = 'view' and w.user_id = c.user_id and w.ts <= c.ts)) v on true",
    "join_band": "select s_suppkey, s_acctbal, c_custkey, c_acctbal from supplier join customer on abs(s_acctbal - c_acctbal) <= 5.0",
    "vector_average": "select label, (i - 1)::int as i, round(avg(v::double), 6) as m from (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings) group by label, i",
    "stream_cdc": "select n_nationkey, upper(n_name || '!') as n_name from nation where n_nationkey % 3 <> 0 union all select 77, 'Y'",
    "stream_windows": "select time_bucket(interval '6 hours', ts, timestamp '1970-01-01') as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all",
    "stream_sessions": "with a as (select user_id, ts, case when ts - lag(ts) over w < interval '2 hours' then 0 else 1 end as new from events window w as (partition by user_id order by ts)), b as (select user_id, ts, sum(new) over (partition by user_id order by ts) as s from a) select user_id, min(ts) as session_start, count(*) as n from b group by user_id, s",
    "op_update_plan": "select n_nationkey, case when n_regionkey = 2 then lower(n_name) else n_name end as n_name, n_regionkey = 2 as changed from nation",
}


def queries():
    return {name: globals()[name] for name in ORACLE}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
