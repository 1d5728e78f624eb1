"""Queries on the surfaces around SELECT: system relations, functions and triggers, sessions, sources, sinks, recursion."""

from __future__ import annotations

import hashlib
import http.server
import json
import struct
import threading
import uuid

from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.operators import recursive
from tidemark.sources import foreign, iceberg
from tidemark.streaming import cdc, pgoutput

SETUP = """
create schema sales; create type mood as enum ('sad', 'ok'); create type span as range (subtype = int); create domain pos as int check (value > 0); create extension pgcrypto; create sequence seq;
create table p (k int primary key, v text not null default 'x', q int unique, check (q > 0)); create table c (id int references p(k)); create table kid (z int) inherits (p);
create view w as select k from p; create materialized view m as select count(*) as n from p; create function addone(a int) returns int language sql as $$ select a + 1 $$;
create role bob; create role staff superuser; grant staff to bob;
create function stamp() returns trigger language plpgsql as $$ begin new.v := upper(new.v); return new; end $$; create trigger stamper before insert on p for each row execute function stamp(); set work_mem = '64MB'
"""

#: Name: (query after SETUP, the rows that PostgreSQL's catalogue has then).
RELATIONS = {
    "pg_namespace": ("select nspname as a from pg_namespace", "values ('information_schema'), ('pg_catalog'), ('public'), ('sales')", "a"),
    "pg_class": ("select relname as a, nspname as b, relkind as c from pg_class join pg_namespace n on n.oid = relnamespace", "values ('c', 'public', 'r'), ('kid', 'public', 'r'), ('m', 'public', 'm'), ('p', 'public', 'r'), ('w', 'public', 'v'), ('seq', 'public', 'S')", "a, b, c"),
    "pg_attribute": ("select relname as a, attname as b, attnum as c, attnotnull as d from pg_attribute join pg_class c on c.oid = attrelid where relkind = 'r'", "values ('c', 'id', 1, false), ('kid', 'k', 1, true), ('kid', 'v', 2, true), ('kid', 'q', 3, false), ('kid', 'z', 4, false), ('p', 'k', 1, true), ('p', 'v', 2, true), ('p', 'q', 3, false)", "a, b, c, d"),
    "pg_type": ("select typname as a, typtype as b from pg_type where typname in ('mood', 'pos', 'int4', 'text', 'span')", "values ('mood', 'e'), ('pos', 'd'), ('int4', 'b'), ('text', 'b'), ('span', 'r')", "a, b"),
    "pg_range": ("select t.typname as a from pg_range join pg_type t on t.oid = rngtypid", "values ('span')", "a"),
    "pg_enum": ("select typname as a, enumsortorder as b, enumlabel as c from pg_enum join pg_type t on t.oid = enumtypid", "values ('mood', 1.0::double, 'sad'), ('mood', 2.0::double, 'ok')", "a, b, c"),
    "pg_description": ("select count(*) as a from pg_description", "values (0::bigint)", "a"),
    "pg_operator": ("select oprname as a from pg_operator where oprname in ('=', '||', '<->', '@>', 'nope')", "values ('='), ('||'), ('<->'), ('@>')", "a"),
    "pg_collation": ("select collname as a from pg_collation", "values ('default'), ('C'), ('POSIX')", "a"),
    "pg_language": ("select lanname as a from pg_language", "values ('sql'), ('plpgsql')", "a"),
    "pg_auth_members": ("select r.rolname as a, m.rolname as b from pg_auth_members x join pg_authid r on r.oid = roleid join pg_authid m on m.oid = member", "values ('staff', 'bob')", "a, b"),
    "pg_authid": ("select rolname as a from pg_authid", "values ('bob'), ('postgres'), ('staff')", "a"),
    "pg_trigger": ("select tgname as a, relname as b from pg_trigger join pg_class c on c.oid = tgrelid", "values ('stamper', 'p')", "a, b"),
    "pg_rewrite": ("select rulename as a from pg_rewrite", "values ('_RETURN')", "a"),
    "pg_database": ("select datname = current_database() as a from pg_database", "values (true)", "a"),
    "pg_roles": ("select rolname as a, rolsuper as b from pg_roles", "values ('bob', false), ('postgres', true), ('staff', true)", "a, b"),
    "pg_settings": ("select name as a, setting as b from pg_settings where name in ('work_mem', 'search_path')", "values ('work_mem', '64MB'), ('search_path', 'public')", "a, b"),
    "pg_tables": ("select schemaname as a, tablename as b from pg_tables", "values ('public', 'c'), ('public', 'kid'), ('public', 'p')", "a, b"),
    "pg_views": ("select viewname as a, definition as b from pg_views", "values ('w', 'select k from p')", "a, b"),
    "pg_indexes": ("select tablename as a, indexname as b from pg_indexes", "values ('p', 'p_pkey'), ('p', 'p_q_key')", "a, b"),
    "pg_proc": ("select proname as a, prokind as b from pg_proc where proname in ('addone', 'abs', 'sum', 'row_number', 'nope')", "values ('addone', 'f'), ('abs', 'f'), ('sum', 'a'), ('row_number', 'w')", "a, b"),
    "pg_constraint": ("select conname as a, relname as b, contype as c from pg_constraint join pg_class c on c.oid = conrelid", "values ('c_id_fkey', 'c', 'f'), ('p_pkey', 'p', 'p'), ('p_q_key', 'p', 'u'), ('p_check', 'p', 'c')", "a, b, c"),
    "pg_extension": ("select extname as a from pg_extension", "values ('pgcrypto')", "a"),
    "pg_index": ("select relname as a, indisunique as b, indisprimary as c from pg_index join pg_class c on c.oid = indrelid", "values ('p', true, true), ('p', true, false)", "a, b, c"),
    "pg_am": ("select amname as a from pg_am", "values ('heap'), ('btree')", "a"),
    "pg_attrdef": ("select relname as a, adnum as b, pg_get_expr(adbin, adrelid) as c from pg_attrdef join pg_class c on c.oid = adrelid", "values ('p', 2, '''x'''), ('kid', 2, '''x''')", "a, b, c"),
    "pg_inherits": ("select c.relname as a, p.relname as b from pg_inherits join pg_class c on c.oid = inhrelid join pg_class p on p.oid = inhparent", "values ('kid', 'p')", "a, b"),
    "pg_statistic": ("select count(*) as a from pg_statistic", "values (0::bigint)", "a"),
    "tables": ("select table_name as a, table_type as b from information_schema.tables where table_type <> 'MATERIALIZED VIEW'", "values ('c', 'BASE TABLE'), ('kid', 'BASE TABLE'), ('p', 'BASE TABLE'), ('w', 'VIEW')", "a, b"),
    "columns": ("select table_name as a, column_name as b, ordinal_position as c, column_default as d, is_nullable as e, data_type as f from information_schema.columns where table_name in ('p', 'c')", "values ('c', 'id', 1, null, 'YES', 'integer'), ('p', 'k', 1, null, 'NO', 'integer'), ('p', 'v', 2, '''x''', 'NO', 'text'), ('p', 'q', 3, null, 'YES', 'integer')", "a, b, c, d, e, f"),
    "schemata": ("select schema_name as a from information_schema.schemata", "values ('information_schema'), ('pg_catalog'), ('public'), ('sales')", "a"),
    "key_column_usage": ("select constraint_name as a, table_name as b, column_name as c, ordinal_position as d from information_schema.key_column_usage", "values ('c_id_fkey', 'c', 'id', 1), ('p_pkey', 'p', 'k', 1), ('p_q_key', 'p', 'q', 1)", "a, b, c, d"),
    "table_constraints": ("select constraint_name as a, constraint_type as b from information_schema.table_constraints", "values ('c_id_fkey', 'FOREIGN KEY'), ('p_pkey', 'PRIMARY KEY'), ('p_q_key', 'UNIQUE'), ('p_check', 'CHECK')", "a, b"),
    "ws_connections": ("select count(*) as a from ws.connections", "values (0::bigint)", "a"),
}

_NAMES = [f"NATION_{k}" for k in range(25)]
_DIGESTS = ", ".join(f"('{n}', '{hashlib.sha224(n.encode()).hexdigest()}', '{hashlib.sha384(n.encode()).hexdigest()}', '{hashlib.sha512(n.encode()).hexdigest()}')" for n in _NAMES)

_FIB = "create function fib(n int) returns int language plpgsql as $$ declare a int := 0; b int := 1; t int; begin for i in 1..n loop t := a + b; a := b; b := t; end loop; return a; end $$"

#: Name: (tables, script, query, SQL of the oracle).
SCRIPTS = {
    "cte_deep": ("", "", "with recursive t(n) as (select 1 union all select n + 1 from t where n < 1000) select count(*) as n, max(n) as hi from t", "select 1000::bigint as n, 1000 as hi"),
    "cte_deep_union": ("", "", "with recursive t(n) as (select 1 union select n + 1 from t where n < 3000) select count(*) as n, max(n) as hi, sum(n) as s from t", "select 3000::bigint as n, 3000 as hi, 4501500::bigint as s"),
    "cte_wide_union": ("orders", "", "with recursive t(k) as (select o_orderkey from orders union select (k * 7) % 60001 from t) select count(*) as n, max(k) as hi from t", "with recursive t(k) as (select o_orderkey from orders union select (k * 7) % 60001 from t) select count(*) as n, max(k) as hi from t"),
    "nextval_rows": ("nation", "create sequence s start 5 increment 2", "select count(distinct v) as n, min(v) as lo, max(v) as hi from (select nextval('s') as v, n_name from nation) as t", "select 25::bigint as n, 5::bigint as lo, 53::bigint as hi"),
    "nextval_insert": ("nation", "create sequence s; create table z (id bigint, n text); insert into z select nextval('s'), n_name from nation", "select n, hi, currval('s') as c, (select nextval('s')) as x from (select count(distinct id) as n, max(id) as hi from z) as t", "select 25::bigint as n, 25::bigint as hi, 25::bigint as c, 26::bigint as x"),
    "keywords": ("", "", "select catcode, word from pg_get_keywords() as k where word in ('select', 'table', 'window', 'cluster')", "select * from (values ('R', 'select'), ('R', 'table'), ('R', 'window'), ('U', 'cluster')) as v(catcode, word)"),
    "input_error_info": ("", "", "select (select message from pg_input_error_info('abc', 'integer') as t) as a, (select sql_error_code from pg_input_error_info('abc', 'integer') as t) as b, (select message from pg_input_error_info('7', 'integer') as t) as c", "select 'invalid input syntax for type integer: \"abc\"' as a, '22P02' as b, null as c"),
    "populate_record": ("", "create type pt as (a int, b text)", "select a, b from jsonb_populate_record(row(1, 'x')::pt, '{\"a\": 7}') as t union all select a, b from json_populate_record(null::pt, '{\"b\": \"q\"}') as t", "select * from (values (7, 'x'), (null, 'q')) as v(a, b)"),
    "populate_recordset": ("region", "create type pt as (a int, b text)", "select a, b from json_populate_recordset(null::pt, '[{\"a\": 5}, {\"b\": \"q\"}]') as t union all select r_regionkey, r_name from jsonb_populate_recordset(null::region, '[{\"r_regionkey\": 9, \"r_name\": \"n\"}]') as t", "select * from (values (5, null), (null, 'q'), (9, 'n')) as v(a, b)"),
    "populate_valid": ("", "create type pt as (a int, b text)", "select jsonb_populate_record_valid(null::pt, '{\"a\": 5}') as a, jsonb_populate_record_valid(null::pt, '{\"a\": \"z\"}') as b, jsonb_populate_record_valid(null::pt, '{bad') as c, jsonb_populate_record_valid(null::pt, '{\"q\": 1}') as d", "select true as a, false as b, false as c, true as d"),
    "privileges": ("nation region", "create role bob; create role staff; grant select, insert on nation to bob; grant staff to bob; grant all on region to staff; revoke insert on nation from bob", "select has_table_privilege('bob', 'nation', 'select') as a, has_table_privilege('bob', 'nation', 'insert') as b, has_table_privilege('bob', 'region', 'update') as c, has_column_privilege('bob', 'region', 'r_name', 'select') as d, has_schema_privilege('bob', 'public', 'usage') as e, has_table_privilege('region', 'delete') as f", "select true as a, false as b, true as c, true as d, true as e, true as f"),
    "sizes": ("nation", "", "select pg_relation_size('nation') > 500 as a, pg_total_relation_size('nation') = pg_relation_size('nation') as b, octet_length(gen_random_bytes(100)) as c, octet_length(gen_random_bytes(0)) as d, pg_sleep(0.01) is null as e", "select true as a, true as b, 100 as c, 0 as d, true as e"),
    "password_hashes": ("region", "", "select crypt('U*U', '$2a$05$CCCCCCCCCCCCCCCCCCCCC.') as a, crypt('password', '$1$saltsalt$') as b, (select bool_and(crypt(r_name, h) = h and crypt(r_name || 'x', h) <> h) from (select r_name, crypt(r_name, gen_salt('md5')) as h from region) as t) as c, crypt('pw', crypt('pw', gen_salt('bf', 4))) like '$2a$04$%' as d, crypt(null, 'x') as e, length(crypt('x', gen_salt('sha512crypt'))) as f", "select '$2a$05$CCCCCCCCCCCCCCCCCCCCC.E5YPO9kmyuRGyh0XouQYb4YMJKvyOeW' as a, '$1$saltsalt$qjXMvbEw8oaL.CzflDtaK/' as b, true as c, true as d, null as e, 106 as f"),
    "format_types": ("nation", "", "select attname as a, format_type(atttypid, null) as b from pg_attribute", "select * from (values ('n_nationkey', 'integer'), ('n_name', 'text'), ('n_regionkey', 'integer')) as v(a, b)"),
    "viewdef": ("region", "create view v as select r_name from region", "select pg_get_viewdef('v') as a", "select 'select r_name from region' as a"),
    "text_codes": ("customer", "", "select ascii(c_name) as a, chr(64 + c_nationkey + 1) as b, format('%s has %L', c_name, c_mktsegment) as c, abs(c_acctbal) as d, round(cast(c_acctbal as numeric(12, 4)), 1) as e from customer", "select ascii(c_name) as a, chr(64 + c_nationkey + 1) as b, c_name || ' has ''' || c_mktsegment || '''' as c, abs(c_acctbal) as d, round(cast(c_acctbal as decimal(12, 4)), 1) as e from customer"),
    "join_range_buckets": ("lineitem orders", "set nested_loop_rows = 10", "select o.o_orderkey, count(*) as n, sum(l.l_orderkey) as s from orders o join lineitem l on l.l_extendedprice between o.o_totalprice - 5 and o.o_totalprice + 5 group by o.o_orderkey", "select o.o_orderkey, count(*) as n, sum(l.l_orderkey)::bigint as s from orders o join lineitem l on l.l_extendedprice between o.o_totalprice - 5 and o.o_totalprice + 5 group by o.o_orderkey"),
    "join_range_star": ("customer supplier", "set nested_loop_rows = 10", "select * from supplier s join customer c on c.c_acctbal >= s.s_acctbal - 20 and c.c_acctbal < s.s_acctbal + 0.5 and s.s_nationkey <> c.c_nationkey", "select * from supplier s join customer c on c.c_acctbal >= s.s_acctbal - 20 and c.c_acctbal < s.s_acctbal + 0.5 and s.s_nationkey <> c.c_nationkey"),
    "win_exclude_frames": ("events", "", "select event_id, sum(event_id) over (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following exclude current row) as a, count(*) over (partition by user_id order by event_type groups between unbounded preceding and 1 following exclude current row) as b, min(event_id) over (partition by user_id order by event_type range between unbounded preceding and unbounded following exclude group) as c, max(event_id) over (partition by user_id order by event_type groups between 1 preceding and 1 following exclude ties) as d, round(avg(event_id) over (partition by user_id order by ts, event_id rows between 3 preceding and 1 preceding exclude current row), 6) as e, count(*) over (partition by user_id order by ts, event_id rows between current row and current row exclude current row) as f, sum(event_id) filter (where event_type <> 'click') over (partition by user_id order by event_type groups between current row and unbounded following exclude ties) as g from events", "select event_id, sum(event_id) over (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following exclude current row)::bigint as a, count(*) over (partition by user_id order by event_type groups between unbounded preceding and 1 following exclude current row) as b, min(event_id) over (partition by user_id order by event_type range between unbounded preceding and unbounded following exclude group) as c, max(event_id) over (partition by user_id order by event_type groups between 1 preceding and 1 following exclude ties) as d, round(avg(event_id) over (partition by user_id order by ts, event_id rows between 3 preceding and 1 preceding exclude current row), 6) as e, count(*) over (partition by user_id order by ts, event_id rows between current row and current row exclude current row) as f, sum(event_id) filter (where event_type <> 'click') over (partition by user_id order by event_type groups between current row and unbounded following exclude ties)::bigint as g from events"),
    "win_no_order": ("nation", "", "select count(distinct r) as n, max(r) as hi from (select row_number() over () as r from nation) as t", "select 25::bigint as n, 25 as hi"),
    "update_columns": ("nation", "create table t as select n_nationkey as k, n_name as v, n_regionkey as q from nation; update t set (v, q) = (select 'z', 9) where k < 3; update t set (v, q) = row('y', k) where k = 5", "select k, v, q from t", "select n_nationkey as k, case when n_nationkey < 3 then 'z' when n_nationkey = 5 then 'y' else n_name end as v, case when n_nationkey < 3 then 9 when n_nationkey = 5 then 5 else n_regionkey end as q from nation"),
    "plpgsql_rows": ("nation", _FIB, "select n_nationkey as k, fib(n_nationkey % 10) as f from nation", "select n_nationkey as k, [0, 1, 1, 2, 3, 5, 8, 13, 21, 34][n_nationkey % 10 + 1] as f from nation"),
    "plpgsql_constant": ("nation", "create function cnt(x int) returns int language plpgsql as $$ declare n int; begin select count(*) into n from nation where n_regionkey = x; if n > 3 then return n * 10; end if; return n; end $$", "select cnt(2) as a, cnt(99) as b", "select 50 as a, 0 as b"),
    "plpgsql_control": ("", "create function f(n int) returns text language plpgsql as $$ declare out text := ''; k int := 0; begin <<top>> loop k := k + 1; continue when k % 2 = 0; exit top when k > n; out := out || k; end loop; case n when 5 then out := out || '!'; else out := out || '?'; end case; return out; end $$", "select f(5) as a, f(8) as b", "select '135!' as a, '1357?' as b"),
    "plpgsql_return_next": ("", "create function squares(n int) returns table (k int, sq bigint) language plpgsql as $$ begin for i in 1..n loop k := i; sq := i * i; return next; end loop; return; end $$; create function evens(n int) returns setof int language plpgsql as $$ begin for i in 0..n by 2 loop return next i; end loop; end $$", "select k, sq from squares(4) as s union all select evens, -1 from evens(5) as e", "select * from (values (1, 1::bigint), (2, 4), (3, 9), (4, 16), (0, -1), (2, -1), (4, -1)) as v(k, sq)"),
    "plpgsql_return_query": ("nation", "create function of_region(r int) returns table (k int, name text) language plpgsql as $$ begin return query select n_nationkey, n_name from nation where n_regionkey = r; if not found then return query select -1, 'none'; end if; end $$", "select k, name from of_region(2) as f union all select k, name from of_region(77) as g", "select n_nationkey as k, n_name as name from nation where n_regionkey = 2 union all select -1, 'none'"),
    "plpgsql_cursor": ("nation", "create function longest() returns text language plpgsql as $$ declare c cursor for select n_name, n_nationkey from nation order by n_nationkey; a text; b int; out text := ''; begin open c; loop fetch c into a, b; exit when not found; if b % 10 = 3 then out := out || a || ';'; end if; end loop; close c; for r in c loop if r.n_nationkey = 1 then out := out || r.n_name; end if; end loop; return out; end $$", "select longest() as a", "select string_agg(n_name, ';' order by n_nationkey) || ';NATION_1' as a from nation where n_nationkey % 10 = 3"),
    # Functions over the columns of tables, nulls among them.
    "col_hash": ("nation", "", "select n_name as n, sha224(n_name) as a, sha384(n_name) as b, sha512(n_name) as c, md5(n_name) as d, sha256(n_name) as e, md5(nullif(n_name, 'NATION_3')) as f from nation", f"select v.*, md5(n) as d, sha256(n) as e, case when n <> 'NATION_3' then md5(n) end as f from (values {_DIGESTS}) as v(n, a, b, c)"),
    "col_arrays": ("nation", "create table t as select n_nationkey as k, case when n_nationkey % 4 = 0 then null else array[n_nationkey, n_regionkey, null, 7] end as a from nation", "select k, array_append(a, 1) as b, array_prepend(0, a) as c, array_remove(a, 7) as d, array_replace(a, 7, 8) as e, array_position(a, 7) as f, array_length(a, 1) as g, cardinality(a) as h, array_to_string(a, ',', '-') as i, a[1] as j, a[2:3] as l from t", "select k, list_concat(a, [1]) as b, case when a is null then [0] else list_concat([0], a) end as c, case when a is null then null else list_filter(a, lambda x: x is null or x <> 7) end as d, list_transform(a, lambda x: case when x = 7 then 8 else x end) as e, list_position(a, 7) as f, len(a) as g, len(a) as h, array_to_string(list_transform(a, lambda x: coalesce(x::varchar, '-')), ',') as i, a[1] as j, a[2:3] as l from (select n_nationkey as k, case when n_nationkey % 4 = 0 then null else [n_nationkey, n_regionkey, null, 7] end as a from nation)"),
    "col_json": ("customer", "create table t as select c_custkey as k, case when c_custkey % 5 = 0 then null else jsonb_build_object('k', c_custkey, 's', c_name, 'n', null, 'l', json_build_array(c_nationkey, c_nationkey + 1)) end as j from customer", "select k, (j ->> 'k')::int as a, j ->> 's' as b, j ->> 'n' as c, j #>> '{l,1}' as d, jsonb_array_length(j -> 'l') as e, jsonb_typeof(j -> 's') as f, j ? 's' as g, jsonb_exists(j, 'zz') as h, jsonb_path_exists(j, '$.l[*] ? (@ > 20)') as i from t", "select c_custkey as k, case when x then c_custkey end as a, case when x then c_name end as b, null as c, case when x then (c_nationkey + 1)::varchar end as d, case when x then 2 end as e, case when x then 'string' end as f, case when x then true end as g, case when x then false end as h, case when x then c_nationkey + 1 > 20 end as i from (select *, c_custkey % 5 <> 0 as x from customer)"),
    "col_dates": ("orders", "", "select o_orderkey as k, date_trunc('quarter', o_orderdate) as a, extract(dow from o_orderdate)::int as b, extract(week from o_orderdate)::int as c, extract(doy from o_orderdate)::int as d, (o_orderdate + interval '1 month 3 days')::date as e, to_char(o_orderdate, 'YYYY-MM-DD HH24:MI') as f, (date '1999-01-01' - o_orderdate::date) as g, make_date(extract(year from o_orderdate)::int, 2, 1) as h from orders", "select o_orderkey as k, date_trunc('quarter', o_orderdate)::timestamp as a, dayofweek(o_orderdate)::int as b, weekofyear(o_orderdate)::int as c, dayofyear(o_orderdate)::int as d, (o_orderdate + interval 1 month + interval 3 days)::date as e, strftime(o_orderdate, '%Y-%m-%d %H:%M') as f, datediff('day', o_orderdate::date, date '1999-01-01')::int as g, make_date(year(o_orderdate), 2, 1) as h from orders"),
    "col_strings": ("customer", "", "select c_custkey as k, split_part(c_name, '#', 2) as a, lpad(c_mktsegment, 12, '*') as b, overlay(c_name placing '--' from 3 for 2) as c, translate(c_mktsegment, 'AEIOU', 'aei') as d, regexp_replace(c_name, '0+', '') as e, (regexp_match(c_name, '([A-Za-z]+)'))[1] as f, position('T' in c_mktsegment) as g, reverse(c_mktsegment) as h, initcap(c_mktsegment) as i, left(c_name, -2) as j, strpos(c_name, 'zz') as l, concat_ws('/', c_name, nullif(c_mktsegment, 'BUILDING'), c_nationkey) as m from customer", "select c_custkey as k, split_part(c_name, '#', 2) as a, lpad(c_mktsegment, 12, '*') as b, left(c_name, 2) || '--' || substr(c_name, 5) as c, translate(c_mktsegment, 'AEIOU', 'aei') as d, regexp_replace(c_name, '0+', '') as e, regexp_extract(c_name, '([A-Za-z]+)', 1) as f, strpos(c_mktsegment, 'T') as g, reverse(c_mktsegment) as h, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) as i, left(c_name, -2) as j, 0 as l, concat_ws('/', c_name, nullif(c_mktsegment, 'BUILDING'), c_nationkey) as m from customer"),
    "col_math": ("lineitem", "", "select l_orderkey as k, l_linenumber as n, round(sqrt(l_quantity), 6) as a, floor(l_extendedprice) as b, ceil(l_discount * 10) as c, mod(l_orderkey, 7) as d, div(l_orderkey, 7) as e, gcd(l_orderkey, 12) as f, sign(l_discount - 0.05) as g, round(ln(l_quantity), 6) as h, width_bucket(l_quantity, 0, 50, 5) as i, round(power(l_quantity, 1.5), 4) as j, greatest(l_tax, l_discount, null) as l from lineitem", "select l_orderkey as k, l_linenumber as n, round(sqrt(l_quantity), 6) as a, floor(l_extendedprice) as b, ceil(l_discount * 10) as c, l_orderkey % 7 as d, l_orderkey // 7 as e, gcd(l_orderkey, 12) as f, sign(l_discount - 0.05) as g, round(ln(l_quantity), 6) as h, case when l_quantity >= 50 then 6 when l_quantity < 0 then 0 else floor(l_quantity / 10) + 1 end as i, round(pow(l_quantity, 1.5), 4) as j, greatest(l_tax, l_discount) as l from lineitem"),
    "do_block": ("", "create table t (k int); do $$ begin for i in 1..5 loop insert into t values (i * i); end loop; end $$", "select k from t", "select unnest([1, 4, 9, 16, 25])::int as k"),
    "trigger_before": ("nation", "create table t (k int, v text, seen boolean); create function stamp() returns trigger language plpgsql as $$ begin if new.k > 3 then new.v := upper(new.v); end if; new.seen := true; return new; end $$; create trigger stamper before insert on t for each row execute function stamp(); insert into t (k, v) select n_nationkey, lower(n_name) from nation", "select k, v, seen from t", "select n_nationkey as k, case when n_nationkey > 3 then upper(n_name) else lower(n_name) end as v, true as seen from nation"),
    "trigger_after": ("nation", "create table t (k int); create table log (k int); create function note() returns trigger language plpgsql as $$ begin insert into log values (new.k); return new; end $$; create trigger noter after insert on t for each row execute function note(); insert into t select n_nationkey from nation", "select k from log", "select n_nationkey as k from nation"),
    "trigger_variables": ("nation", "create table t (k int, v text, f bigint); create function stamp() returns trigger language plpgsql as $$ declare a bigint := 0; b bigint := 1; t bigint; begin for i in 1..new.k loop t := a + b; a := b; b := t; end loop; new.f := a; if new.k > 22 then return null; end if; new.v := tg_op || ':' || upper(new.v); return new; end $$; create trigger stamper before insert on t for each row execute function stamp(); insert into t (k, v) select n_nationkey, lower(n_name) from nation", "select k, v, f from t", "with recursive fib(k, a, b) as (select 0, 0::bigint, 1::bigint union all select k + 1, b, a + b from fib where k < 30) select n_nationkey as k, 'INSERT:' || upper(n_name) as v, a as f from nation join fib on k = n_nationkey where n_nationkey <= 22"),
    "trigger_after_rows": ("nation", "create table t (k int, r int); create table n (r int, c int); insert into n values (0, 0), (1, 0), (2, 0), (3, 0), (4, 0); create function tally() returns trigger language plpgsql as $$ declare old_c int; begin select c into old_c from n where r = new.r; update n set c = old_c + 1 where r = new.r; return new; end $$; create trigger tallier after insert on t for each row execute function tally(); insert into t select n_nationkey, n_regionkey from nation where n_nationkey < 7", "select r, c from n", "select r_regionkey as r, (select count(*) from nation where n_regionkey = r_regionkey and n_nationkey < 7)::int as c from region"),
    "session_settings": ("", "set work_mem = '64MB'", "select current_setting('work_mem') as a, set_config('x.y', '5', false) as b, current_setting('x.y') as c", "select '64MB' as a, '5' as b, '5' as c"),
    "schema_tables": ("nation", "create schema sales; create table sales.t as select n_name from nation; create extension pgcrypto; drop extension pgcrypto; listen ch; notify ch, 'x'; unlisten ch; discard all", "select count(*) as n, (select count(*) from pg_extension) as e from sales.t", "select 25::bigint as n, 0::bigint as e"),
    "user_range_type": ("", "create type span as range (subtype = int); create table t (s span)", "select count(*) as n from t", "select 0::bigint as n"),
}


def relation(name):
    def run(spark, sf_dir):
        e = Engine(spark)
        e.sql(SETUP)
        return e.query(RELATIONS[name][0])

    return run


def script(name):
    def run(spark, sf_dir):
        tables, text, query, _ = SCRIPTS[name]
        e = Engine(spark).load(sf_dir, tables.split())
        if text:
            e.sql(text)
        return e.query(query)

    return run


# Sources and sinks.


def _folder(spark, name: str) -> str:
    return f"{recursive.shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def copy_binary(spark, sf_dir):
    e = Engine(spark).load(sf_dir, ["orders"])
    at = _folder(spark, "copy")
    at = at if ":" in at else f"file://{at}"
    e.sql(f"copy (select o_orderkey, o_custkey, o_totalprice, cast(o_orderdate as date) as d, o_orderstatus, case when o_orderkey % 3 = 0 then null else cast(o_totalprice as numeric(14, 3)) end as n, o_orderkey % 2 = 0 as b from orders) to '{at}' with (format binary)")
    e.sql(f"create table t (k bigint, c bigint, p float8, d date, s text, n numeric(14, 3), b boolean); copy t from '{at}' with (format binary)")
    return e.query("select k, c, p, d, s, n, b from t")


def _zigzag(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _avro(schema: dict, rows: list[list]) -> bytes:
    """A container file of records whose fields are longs, strings and optional strings."""

    def value(kind, x) -> bytes:
        if isinstance(kind, list):
            return b"\0" if x is None else b"\2" + value(kind[1], x)
        if isinstance(kind, dict):
            return b"".join(value(f["type"], y) for f, y in zip(kind["fields"], x, strict=True))
        return _zigzag(x) if kind in ("int", "long") else _zigzag(len(x.encode())) + x.encode()

    meta = {"avro.schema": json.dumps(schema), "avro.codec": "null"}
    head = b"Obj\1" + _zigzag(2) + b"".join(_zigzag(len(y)) + y.encode() for x in meta.items() for y in x) + b"\0" + b"m" * 16
    body = b"".join(value(schema, r) for r in rows)
    return head + _zigzag(len(rows)) + _zigzag(len(body)) + body + b"m" * 16


def _put(spark, path: str, raw: bytes) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(raw))
    out.close()


def iceberg_orders(spark, sf_dir) -> str:
    """orders as an Iceberg table of about 100 files by status: half of them from before a column was renamed and widened and another added."""
    at = _folder(spark, "iceberg")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").repartition(100, "o_orderkey")
    field = lambda name, i, kind: F.col(name).cast(kind).alias(name, metadata={"parquet.field.id": i})
    day = F.col("o_orderstatus")
    old = orders.filter("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_custkey").alias("cust"), day.alias("o_orderstatus"))
    new = orders.filter("o_orderkey % 2 = 1").select("o_orderkey", F.col("o_custkey").alias("customer"), day.alias("o_orderstatus"), F.col("o_totalprice").alias("price"))
    files = []
    for k, (df, ids) in enumerate(((old, {"o_orderkey": (1, "long"), "cust": (2, "int"), "o_orderstatus": (3, "string")}), (new, {"o_orderkey": (1, "long"), "customer": (2, "long"), "o_orderstatus": (3, "string"), "price": (4, "double")}))):
        for status in ("F", "O", "P"):
            df.filter(F.col("o_orderstatus") == status).select(*(field(c, i, t) for c, (i, t) in ids.items())).write.parquet(f"{at}/data/{k}{status}")
            files += [(7 + k, f, status) for f in spark.read.parquet(f"{at}/data/{k}{status}").inputFiles()]
    manifest = {"type": "record", "name": "entry", "fields": [{"name": "status", "type": "int"}, {"name": "snapshot_id", "type": "long"}, {"name": "data_file", "type": {"type": "record", "name": "f", "fields": [{"name": "file_path", "type": "string"}, {"name": "partition", "type": {"type": "record", "name": "p", "fields": [{"name": "o_orderstatus", "type": ["null", "string"]}]}}, {"name": "record_count", "type": "long"}]}}]}
    listed = {"type": "record", "name": "m", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "content", "type": "int"}]}
    _put(spark, f"{at}/metadata/m.avro", _avro(manifest, [[1, s, [f, [status], 1]] for s, f, status in files]))
    _put(spark, f"{at}/metadata/l.avro", _avro(listed, [[f"{at}/metadata/m.avro", 0]]))
    column = lambda i, n, t: {"id": i, "name": n, "type": t, "required": False}
    first = [column(1, "o_orderkey", "long"), column(2, "cust", "int"), column(3, "o_orderstatus", "string")]
    second = [column(1, "o_orderkey", "long"), column(2, "customer", "long"), column(3, "o_orderstatus", "string"), column(4, "price", "double")]
    meta = {"format-version": 2, "table-uuid": "u", "location": at, "current-schema-id": 1, "default-spec-id": 0, "current-snapshot-id": 8, "schemas": [{"schema-id": 0, "fields": first}, {"schema-id": 1, "fields": second}], "partition-specs": [{"spec-id": 0, "fields": [{"source-id": 3, "field-id": 1000, "name": "o_orderstatus", "transform": "identity"}]}], "snapshots": [{"snapshot-id": 7, "schema-id": 0}, {"snapshot-id": 8, "schema-id": 1, "manifest-list": f"{at}/metadata/l.avro"}]}
    _put(spark, f"{at}/metadata/v1.metadata.json", json.dumps(meta).encode())
    return at


def source_iceberg(spark, sf_dir):
    return Engine(spark).query(f"select o_orderkey, customer, o_orderstatus, price from iceberg_scan('{iceberg_orders(spark, sf_dir)}') as t")


def source_iceberg_pruned(spark, sf_dir):
    """The number of files that a filter on the partition column leaves in the plan, of the other values none."""
    at = iceberg_orders(spark, sf_dir)
    df = Engine(spark).query(f"select count(*) as n, sum(customer) as s from iceberg_scan('{at}') as t where o_orderstatus = 'F'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    return df.withColumn("scans", F.lit(plan.count("FileScan parquet")))


def source_iceberg_metadata(spark, sf_dir):
    return iceberg.metadata(spark, iceberg_orders(spark, sf_dir)).select("table_uuid", "format_version", "current_schema_id", "partition_spec", "snapshots")


def source_foreign_wrapper(spark, sf_dir):
    source = foreign.wrapper("tidemark_letters", "c string", lambda o: list("ab"), lambda o, part: iter([(part,), (part * 2,)]))
    foreign.register(spark, source)
    return spark.read.format("tidemark_letters").load()


def source_foreign_table(spark, sf_dir):
    foreign.register(spark)
    e = Engine(spark)
    e.sql("create server srv foreign data wrapper tidemark_series; create foreign table ft (id bigint, label text) server srv options (rows '5')")
    return e.query("select id, label from ft where id > 1")


def sink_arrow(spark, sf_dir):
    """A result as an Arrow table, read back."""
    return spark.createDataFrame(Engine(spark).load(sf_dir, ["nation"]).arrow("select n_nationkey, n_name from nation"))


def sink_json(spark, sf_dir):
    e = Engine(spark).load(sf_dir, ["region"])
    good, bad = json.loads(e.json("select r_regionkey, r_name from region order by 1")), json.loads(e.json("select nope from region"))
    return spark.createDataFrame([(r["r_regionkey"], r["r_name"], good["columns"] == ["r_regionkey", "r_name"] and good["ok"] and not bad["ok"]) for r in good["rows"]], "k int, name string, ok boolean")


def state_snapshot(spark, sf_dir):
    e = Engine(spark)
    e.sql("create table t (k int, v text); insert into t values (1, 'a'), (2, 'b'); update t set v = 'c' where k = 2; create view w as select v from t")
    other = Engine(spark)
    other.import_state(e.export_state())
    return other.query("select k, v, (select count(*) from w) as n from t")


def tools(spark, sf_dir):
    """The helpers that a tool server wraps."""
    e = Engine(spark)
    e.load_url("region", f"{sf_dir}/region.parquet")
    e.load_iceberg("o", iceberg_orders(spark, sf_dir))
    e.load(sf_dir, ["embeddings"])
    near = e.similarity_search("embeddings", "embedding", [float(x) for x in e.query("select embedding from embeddings order by vec_id limit 1").first()[0]], 1).select("vec_id")
    names = ",".join(r.table_name for r in e.list_tables().collect())
    columns = ",".join(r.column_name for r in e.describe_table("region").collect())
    return near.select(F.lit(names).alias("tables"), F.lit(columns).alias("columns"), F.col("vec_id").cast("long").alias("vec_id"))


def explain(spark, sf_dir):
    """What EXPLAIN names: joins chosen by size, and the rows that ANALYZE has seen."""
    e = Engine(spark).load(sf_dir, ["nation", "region", "lineitem"])
    text = lambda sql: "\n".join(r[0] for r in e.sql(sql).rows())
    joined = text("explain select n_name, r_name from nation join region on n_regionkey = r_regionkey")
    theta = text("explain select a.n_name from nation a join nation b on a.n_nationkey < b.n_nationkey")
    ran = text("explain analyze select l_orderkey from lineitem where l_quantity > 40")
    rows = [("hash", "BroadcastHashJoin" in joined), ("theta", "NestedLoopJoin" in theta or "CartesianProduct" in theta), ("pushed", "PushedFilters: [IsNotNull(l_quantity)" in ran), ("analyze", "Actual rows: " in ran)]
    return spark.createDataFrame(rows, "what string, found boolean")


class _Echo(http.server.BaseHTTPRequestHandler):
    def answer(self):
        n = int(self.headers.get("Content-Length") or 0)
        body = self.rfile.read(n).decode()
        self.send_response(200 if self.path != "/missing" else 404)
        self.end_headers()
        if self.command != "HEAD":
            self.wfile.write(f"{self.command} {self.path} {body}".encode())

    do_GET = do_POST = do_PUT = do_PATCH = do_DELETE = do_HEAD = answer

    def log_message(self, *args):
        pass


def win_refused(spark, sf_dir):
    """Windows that PostgreSQL refuses are refused."""
    e = Engine(spark).load(sf_dir, ["nation"])

    def refused(sql: str) -> bool:
        try:
            e.query(f"select {sql} as x from nation").collect()
        except Exception:  # noqa: BLE001  that it fails is what is asked
            return True
        return False

    cases = {
        "in where": "1 as y from nation where row_number() over (order by n_name) > 1 union select 1", "frame turned": "sum(n_nationkey) over (order by n_name rows between current row and unbounded preceding)",
        "unknown window": "sum(n_nationkey) over w", "range of text": "sum(n_nationkey) over (order by n_name range between 1 preceding and current row)", "fine": "sum(n_nationkey) over (order by n_nationkey range between 1 preceding and current row)",
    }
    return spark.createDataFrame([(k, refused(v)) for k, v in cases.items()], "what string, refused boolean")


def http_calls(spark, sf_dir):
    """Requests to a server of this process."""
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), _Echo)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}"
    calls = ("get", f"http_get('{at}/a')"), ("post", f"http_post('{at}/b', 'body')"), ("put", f"http_put('{at}/c', 'x')"), ("patch", f"http_patch('{at}/d', 'y')"), ("delete", f"http_delete('{at}/e')"), ("head", f"http_head('{at}/f')"), ("missing", f"http_get('{at}/missing')")
    e = Engine(spark)
    return e.query(" union all ".join(f"select '{name}' as what, r ->> 'status' as status, r ->> 'content' as content from (select {call} as r) as t" for name, call in calls))


# Replication messages.


def _text(s: str) -> bytes:
    return s.encode() + b"\0"


def _row(*values) -> bytes:
    return struct.pack(">h", len(values)) + b"".join(b"n" if v is None else b"t" + struct.pack(">i", len(v)) + v.encode() for v in values)


def replication(spark, sf_dir):
    """Messages of two transactions, decoded and applied to a synced table."""
    relation = b"R" + struct.pack(">i", 7) + _text("public") + _text("t") + b"d" + struct.pack(">h", 2) + b"\1" + _text("k") + struct.pack(">ii", 23, -1) + b"\0" + _text("v") + struct.pack(">ii", 25, -1)
    insert = lambda *v: b"I" + struct.pack(">i", 7) + b"N" + _row(*v)
    update = lambda *v: b"U" + struct.pack(">i", 7) + b"N" + _row(*v)
    delete = lambda *v: b"D" + struct.pack(">i", 7) + b"K" + _row(*v)
    begin, commit = lambda n: b"B" + struct.pack(">qqi", n, 0, 1), b"C" + struct.pack(">bqqq", 0, 0, 0, 0)
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    replica = cdc.Replica(nation.select(F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("v")), ["k"])
    d = pgoutput.Decoder()
    for batch, stream in enumerate([[begin(1), relation, update("1", "new"), insert("100", "b"), commit], [begin(2), update("100", None), delete("2", None), commit]]):
        replica.apply(spark.createDataFrame(pgoutput.change_rows(d.changes(stream), "t", ["k", "v"]), replica.change_schema()), batch)
    return replica.table()


def stream_into_table(spark, sf_dir):
    """Files of changes followed by a stream, the state read again as by a new driver."""
    home = _folder(spark, "replica")
    start = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name")
    first = cdc.Replica(start, ["r_regionkey"], home)
    for i, rows in enumerate(([("update", 1, 1, "one"), ("insert", 2, 9, "nine")], [("delete", 3, 0, None), ("update", 4, 9, "NINE")])):
        _put(spark, f"{home}-in/{i}.json", "\n".join(json.dumps({"op": o, "lsn": n, "r_regionkey": k, "r_name": v}) for o, n, k, v in rows).encode())
    first.follow(f"{home}-in").awaitTermination(120)
    return cdc.Replica(start, ["r_regionkey"], home).table()


def stream_session_windows(spark, sf_dir):
    """Sessions on a stream of the whole table, complete at its end."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = _folder(spark, "events")
    events.select("user_id", "ts").write.parquet(at)  # files of one batch: rows of a later one could be late
    last = events.select("user_id", "ts").limit(1).withColumn("user_id", F.lit(-1).cast(events.schema["user_id"].dataType)).withColumn("ts", F.expr("timestamp_ntz '2100-01-01'").cast(events.schema["ts"].dataType))
    stream = spark.readStream.schema(events.select("user_id", "ts").schema).parquet(at)
    name = f"s{uuid.uuid4().hex}"
    sessions = cdc.sessions(stream, "2 hours")
    out = sessions.writeStream.format("parquet").option("path", f"{at}-out").option("checkpointLocation", f"{at}-{name}").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    last.coalesce(1).write.mode("append").parquet(at)  # a late row of its own closes all sessions
    out = sessions.writeStream.format("parquet").option("path", f"{at}-out").option("checkpointLocation", f"{at}-{name}").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.parquet(f"{at}-out")


_OWN = {
    "copy_binary": "select o_orderkey::bigint as k, o_custkey::bigint as c, o_totalprice as p, o_orderdate::date as d, o_orderstatus as s, case when o_orderkey % 3 = 0 then null else o_totalprice::decimal(14, 3) end as n, o_orderkey % 2 = 0 as b from orders",
    "source_iceberg": "select o_orderkey::bigint as o_orderkey, o_custkey::bigint as customer, o_orderstatus, case when o_orderkey % 2 = 1 then o_totalprice end as price from orders",
    "source_iceberg_pruned": "select count(*) as n, sum(o_custkey)::bigint as s, 2 as scans from orders where o_orderstatus = 'F'",
    "source_iceberg_metadata": "select 'u' as table_uuid, 2 as format_version, 1 as current_schema_id, 'o_orderstatus' as partition_spec, 2::bigint as snapshots",
    "source_foreign_wrapper": "select unnest(['a', 'aa', 'b', 'bb']) as c",
    "source_foreign_table": "select i::bigint as id, 'row-' || i as label from range(2, 5) as t(i)",
    "sink_arrow": "select n_nationkey, n_name from nation",
    "sink_json": "select r_regionkey as k, r_name as name, true as ok from region",
    "state_snapshot": "select * from (values (1, 'a', 2::bigint), (2, 'c', 2::bigint)) as v(k, v, n)",
    "tools": "select 'embeddings,o,region' as tables, 'r_regionkey,r_name' as columns, min(vec_id)::bigint as vec_id from embeddings",
    "win_refused": "select * from (values ('in where', true), ('frame turned', true), ('unknown window', true), ('range of text', true), ('fine', false)) as v(what, refused)",
    "explain": "select unnest(['hash', 'theta', 'pushed', 'analyze']) as what, true as found",
    "http_calls": "select * from (values ('get', '200', 'GET /a '), ('post', '200', 'POST /b body'), ('put', '200', 'PUT /c x'), ('patch', '200', 'PATCH /d y'), ('delete', '200', 'DELETE /e '), ('head', '200', ''), ('missing', '404', 'GET /missing ')) as v(what, status, content)",
    "replication": "select n_nationkey::varchar as k, case when n_nationkey = 1 then 'new' else n_name end as v from nation where n_nationkey <> 2 union all select '100', null",
    "stream_into_table": "select r_regionkey, case when r_regionkey = 1 then 'one' else r_name end as r_name from region where r_regionkey <> 0 union all select 9, 'NINE'",
    "stream_session_windows": "with a as (select user_id, ts, case when ts - lag(ts) over w < interval '2 hours' then 0 else 1 end as new from events window w as (partition by user_id order by ts)), b as (select user_id, ts, sum(new) over (partition by user_id order by ts) as s from a) select user_id, min(ts) as session_start, count(*) as n from b group by user_id, s",
}


def queries():
    return {f"sys_rel_{n}": relation(n) for n in RELATIONS} | {n: script(n) for n in SCRIPTS} | {n: globals()[n] for n in _OWN}


def oracle_sql() -> dict[str, str]:
    return {f"sys_rel_{n}": f"select * from ({sql}) as v({names})" for n, (_, sql, names) in RELATIONS.items()} | {n: s[3] for n, s in SCRIPTS.items()} | _OWN
