"""Scalar functions, by family; each query names the functions it covers in its columns."""

QUERIES: dict[str, str | tuple[str, str]] = {
    "fn_string_case": ("select c_custkey, lower(c_name) as lower, upper(c_mktsegment) as upper, length(c_name) as length, char_length(c_name) as char_length, character_length(c_name) as character_length, octet_length(c_name || 'é') as octet_length, bit_length('é') as bit_length, initcap('hi THERE-bob') as initcap, reverse(c_name) as reverse from customer",
        "select c_custkey, lower(c_name) as lower, upper(c_mktsegment) as upper, length(c_name) as length, length(c_name) as char_length, length(c_name) as character_length, strlen(c_name || 'é') as octet_length, bit_length('é') as bit_length, 'Hi There-Bob' as initcap, reverse(c_name) as reverse from customer"),
    "fn_string_concat": "select n_nationkey, concat(n_name, null, '-', n_nationkey) as concat, concat_ws(',', n_name, null, 'x') as concat_ws, n_name || '!' as op, repeat('ab', 3) as repeat, replace(n_name, 'N', 'n') as replace, translate(n_name, 'NA', 'xy') as translate from nation",
    "fn_string_part": "select n_nationkey, substring(n_name, 2, 3) as s1, substr(n_name, 3) as s2, substring(n_name from 2 for 4) as s3, left(n_name, 3) as l1, left(n_name, -2) as l2, right(n_name, 3) as r1, right(n_name, -3) as r2, split_part(n_name, '_', 2) as sp, position('T' in n_name) as p, strpos(n_name, 'ION') as sp2 from nation",
    "fn_string_substring_edges": ("select substring('hello', -1, 4) as a, substring('hello' from 0 for 2) as b, substring('foobar' from 'o(.)b') as c, substring('hello', 3) as d", "select 'he' as a, 'h' as b, 'o' as c, 'llo' as d"),
    "fn_string_pad": "select n_nationkey, lpad(n_name, 12, '*') as lp, rpad(n_name, 12, 'xy') as rp, lpad(n_name, 3, ' ') as cut, ltrim('  a ') as lt, rtrim(' a  ') as rt, btrim('xxaxx', 'x') as bt, trim('  b ') as t, trim(both 'x' from 'xxbx') as tb, trim(leading 'x' from 'xxb') as tl, trim(trailing 'x' from 'bxx') as tt from nation".replace("btrim(", "trim("),
    "fn_string_btrim": ("select btrim('xyaxy', 'xy') as a, ltrim('zzb', 'z') as b, rtrim('bzz', 'z') as c", "select trim('xyaxy', 'xy') as a, ltrim('zzb', 'z') as b, rtrim('bzz', 'z') as c"),
    "fn_string_codes": ("select n_nationkey, ascii(n_name) as a, chr(65 + n_nationkey) as c, chr(8364) as e, chr(128512) as g, to_hex(n_nationkey * 1000) as h, to_oct(64) as o, to_bin(5) as b from nation", "select n_nationkey, ascii(n_name) as a, chr(65 + n_nationkey) as c, '€' as e, '😀' as g, lower(to_hex(n_nationkey * 1000)) as h, '100' as o, '101' as b from nation"),
    "fn_string_overlay": ("select overlay('Txxxxas' placing 'hom' from 2 for 4) as a, overlay('abcdef' placing 'XY' from 3) as b, starts_with('alphabet', 'alph') as c, unistr('d\\0061t\\+000061') as d", "select 'Thomas' as a, 'abXYef' as b, true as c, 'data' as d"),
    "fn_string_quote": ("select quote_literal('it''s') as a, quote_ident('Foo bar') as b, quote_ident('plain') as c, quote_nullable(null) as d, format('%s-%I-%L-%%', 'a', 'b c', 'd''e') as e, format('%2$s %1$s', 'x', 'y') as f, format('|%5s|%-5s|', 'a', 'b') as g", "select '''it''''s''' as a, '\"Foo bar\"' as b, 'plain' as c, 'NULL' as d, 'a-\"b c\"-''d''''e''-%' as e, 'y x' as f, '|    a|b    |' as g"),
    "fn_string_encode": ("select encode('abc'::bytea, 'hex') as a, encode('abc'::bytea, 'base64') as b, convert_from(decode('616263', 'hex'), 'UTF8') as c, encode('a\\b'::bytea, 'escape') as d".replace("convert_from(decode('616263', 'hex'), 'UTF8')", "decode('616263', 'hex')::text"), "select '616263' as a, 'YWJj' as b, 'abc' as c, 'a\\\\b' as d"),
    "fn_to_char": ("select to_char(timestamp '2024-03-05 14:07:09', 'YYYY-MM-DD HH24:MI:SS') as a, to_char(date '2024-03-05', 'FMMonth DD, YYYY') as b, to_char(1234.5, 'FM9,999.00') as c, to_char(12, '0000') as d, to_number('1,234.50', '9G999D99')::float8 as e", "select '2024-03-05 14:07:09' as a, 'March 05, 2024' as b, '1,234.50' as c, ' 0012' as d, 1234.5::double as e"),
    "fn_hash": ("select n_nationkey, md5(n_name) as md5, sha256(n_name) as sha256, digest(n_name, 'sha256') as d, length(sha224(n_name)) as s224, length(sha384(n_name)) as s384, length(sha512(n_name)) as s512, hmac('d', 'k', 'sha256') as hmac from nation", "select n_nationkey, md5(n_name) as md5, sha256(n_name) as sha256, sha256(n_name) as d, 56 as s224, 96 as s384, 128 as s512, 'e7ea21c3bcb63a4da3ad78503168d36bdca0be622382ea60a108fad4e4966679' as hmac from nation"),
    "fn_bits": ("select n_nationkey, bit_count(n_nationkey) as b, get_bit(n_nationkey, 0) as g, set_bit(8, 0, 1) as s, crc32('123456789') as c, crc32c('123456789') as cc, get_byte('abc'::bytea, 1) as gb from nation", "select n_nationkey, bit_count(n_nationkey)::int as b, n_nationkey % 2 as g, 9 as s, 3421780262 as c, 3808858755 as cc, 98 as gb from nation"),
    "fn_regexp": ("select n_name, regexp_like(n_name, '^NATION_1') as a, regexp_count(n_name, '[0-9]') as b, regexp_instr(n_name, '[0-9]') as c, regexp_substr(n_name, '[0-9]+') as d, regexp_replace(n_name, '[AO]', '*') as e, regexp_replace(n_name, '[AO]', '*', 'g') as f, array_to_string(regexp_match(n_name, '([A-Z]+)_([0-9])'), '/') as g, array_to_string(regexp_split_to_array(n_name, 'T|_'), '|') as h from nation",
        "select n_name, regexp_matches(n_name, '^NATION_1') as a, len(regexp_extract_all(n_name, '[0-9]'))::int as b, 8 as c, regexp_extract(n_name, '[0-9]+') as d, regexp_replace(n_name, '[AO]', '*') as e, regexp_replace(n_name, '[AO]', '*', 'g') as f, regexp_extract(n_name, '([A-Z]+)_([0-9])', 1) || '/' || regexp_extract(n_name, '([A-Z]+)_([0-9])', 2) as g, array_to_string(regexp_split_to_array(n_name, 'T|_'), '|') as h from nation"),
    "fn_regexp_positions": ("select regexp_instr('abcabc', 'b', 3) as a, regexp_instr('abcabc', 'b', 1, 2) as b, regexp_instr('abcabc', 'b', 1, 1, 1) as c, regexp_substr('a1b22', '[0-9]+', 1, 2) as d, regexp_like('ABC', 'b', 'i') as e, regexp_replace('Thomas', '.[mN]a.', 'M') as f, regexp_replace('foobar', '(o+)', '<\\1>') as g", "select 5 as a, 5 as b, 3 as c, '22' as d, true as e, 'ThM' as f, 'f<oo>bar' as g"),
    "fn_math_basic": "select c_custkey, abs(c_acctbal) as abs, ceil(c_acctbal) as ceil, ceiling(c_acctbal) as ceiling, floor(c_acctbal) as floor, round(c_acctbal) as round, round(c_acctbal, 1) as round1, trunc(c_acctbal) as trunc, sign(c_acctbal)::int as sign, mod(c_custkey, 7) as mod from customer",
    "fn_math_div": ("select c_custkey, div(c_custkey, 7) as div, gcd(c_custkey, 12) as gcd, lcm(c_custkey, 4) as lcm, power(c_custkey, 2) as power, pow(2, 5) as pow, trunc(c_acctbal, 1) as trunc1, numeric_inc(c_custkey) as inc, numeric_dec(c_custkey) as dec from customer", "select c_custkey, c_custkey // 7 as div, gcd(c_custkey, 12) as gcd, lcm(c_custkey, 4) as lcm, power(c_custkey, 2) as power, 32.0::double as pow, trunc(c_acctbal * 10) / 10 as trunc1, c_custkey + 1 as inc, c_custkey - 1 as dec from customer"),
    "fn_math_log": ("select n_nationkey, round(sqrt(n_nationkey), 8) as sqrt, round(cbrt(n_nationkey), 8) as cbrt, round(exp(n_nationkey / 10.0), 8) as exp, round(ln(n_nationkey + 1), 8) as ln, round(log(n_nationkey + 1), 8) as log, round(log10(n_nationkey + 1), 8) as log10, round(log(2, n_nationkey + 1), 8) as log2 from nation", "select n_nationkey, round(sqrt(n_nationkey), 8) as sqrt, round(cbrt(n_nationkey), 8) as cbrt, round(exp(n_nationkey / 10.0), 8) as exp, round(ln(n_nationkey + 1), 8) as ln, round(log10(n_nationkey + 1), 8) as log, round(log10(n_nationkey + 1), 8) as log10, round(log2(n_nationkey + 1), 8) as log2 from nation"),
    "fn_math_trig": "select n_nationkey, round(sin(n_nationkey), 8) as sin, round(cos(n_nationkey), 8) as cos, round(tan(n_nationkey), 6) as tan, round(asin(n_nationkey / 30.0), 8) as asin, round(acos(n_nationkey / 30.0), 8) as acos, round(atan(n_nationkey), 8) as atan, round(atan2(n_nationkey, 3), 8) as atan2, round(degrees(n_nationkey), 6) as degrees, round(radians(n_nationkey), 8) as radians, round(pi(), 8) as pi from nation",
    "fn_math_hyperbolic": "select n_nationkey, round(sinh(n_nationkey / 10.0), 8) as sinh, round(cosh(n_nationkey / 10.0), 8) as cosh, round(tanh(n_nationkey / 10.0), 8) as tanh, round(asinh(n_nationkey), 8) as asinh, round(acosh(n_nationkey + 1), 8) as acosh, round(atanh(n_nationkey / 30.0), 8) as atanh from nation",
    "fn_math_degrees": ("select n_nationkey, round(sind(n_nationkey), 8) as sind, round(cosd(n_nationkey), 8) as cosd, round(tand(n_nationkey), 8) as tand, round(cotd(n_nationkey + 1), 8) as cotd, round(asind(n_nationkey / 30.0), 8) as asind, round(acosd(n_nationkey / 30.0), 8) as acosd, round(atand(n_nationkey), 8) as atand, round(atan2d(n_nationkey, 3), 8) as atan2d from nation",
        "select n_nationkey, round(sin(radians(n_nationkey)), 8) as sind, round(cos(radians(n_nationkey)), 8) as cosd, round(tan(radians(n_nationkey)), 8) as tand, round(1 / tan(radians(n_nationkey + 1)), 8) as cotd, round(degrees(asin(n_nationkey / 30.0)), 8) as asind, round(degrees(acos(n_nationkey / 30.0)), 8) as acosd, round(degrees(atan(n_nationkey)), 8) as atand, round(degrees(atan2(n_nationkey, 3)), 8) as atan2d from nation"),
    "fn_math_numeric": ("select width_bucket(5.35, 0.024, 10.06, 5) as a, width_bucket(3, array[1, 3, 4, 10]) as b, scale(8.4100) as c, min_scale(8.4100) as d, factorial(5)::bigint as e, trim_scale(8.4100)::text like '8.41%' as f", "select 3 as a, 2 as b, 4 as c, 2 as d, 120 as e, true as f"),
    "fn_date_parts": ("select o_orderkey, cast(extract(year from o_orderdate) as int) as y, cast(extract(month from o_orderdate) as int) as m, cast(extract(day from o_orderdate) as int) as d, cast(extract(dow from o_orderdate) as int) as dow, cast(extract(isodow from o_orderdate) as int) as isodow, cast(extract(doy from o_orderdate) as int) as doy, cast(extract(quarter from o_orderdate) as int) as q, cast(extract(week from o_orderdate) as int) as w, cast(extract(epoch from o_orderdate) as bigint) as e, cast(date_part('hour', o_orderdate) as int) as h, cast(extract(decade from o_orderdate) as int) as dec, cast(extract(century from o_orderdate) as int) as c from orders",) * 2,
    "fn_date_trunc": "select event_id, date_trunc('hour', ts) as h, date_trunc('minute', ts) as mi, cast(date_trunc('day', ts) as timestamp) as d, cast(date_trunc('month', ts) as timestamp) as m, cast(date_trunc('year', ts) as timestamp) as y, cast(date_trunc('week', ts) as timestamp) as w, cast(date_trunc('quarter', ts) as timestamp) as q from events",
    "fn_date_arith": ("select o_orderkey, o_orderdate::date + 7 as a, o_orderdate::date - 7 as b, o_orderdate::date - date '1995-01-01' as c, o_orderdate + interval '1 month' as d, o_orderdate - interval '36 hours' as e, date_add(o_orderdate::date, 3) as f, date_sub(o_orderdate::date, 3) as g, o_orderdate + interval '1 day 02:30:00' as h from orders",
        "select o_orderkey, (o_orderdate::date + 7)::date as a, (o_orderdate::date - 7)::date as b, (o_orderdate::date - date '1995-01-01')::int as c, o_orderdate + interval '1 month' as d, o_orderdate - interval '36 hours' as e, (o_orderdate::date + 3)::date as f, (o_orderdate::date - 3)::date as g, o_orderdate + interval '1 day' + interval '150 minutes' as h from orders"),
    "fn_date_make": ("select make_date(2024, 2, 29) as a, make_timestamp(2024, 2, 29, 13, 5, 7.5) as b, make_time(8, 15, 23.5) as c, to_date('05 12 2020', 'DD MM YYYY') as d, to_timestamp('2020-12-05 10:11:12', 'YYYY-MM-DD HH24:MI:SS') as e, date(timestamp '2024-01-02 03:04:05') as f, isfinite(date '2024-01-01') as g", "select date '2024-02-29' as a, timestamp '2024-02-29 13:05:07.5' as b, '08:15:23.5' as c, date '2020-12-05' as d, timestamp '2020-12-05 10:11:12' as e, date '2024-01-02' as f, true as g"),
    "fn_date_age": ("select age(timestamp '2024-03-01', timestamp '2023-01-15') as a, justify_hours('27:00:00') as b, justify_days('35 days') as c, justify_interval('1 mon 35 days 27:00:00') as d, make_interval(1, 2, 0, 3, 4, 5, 6.5) as e", "select '1 year 1 mon 15 days' as a, '1 day 03:00:00' as b, '1 mon 5 days' as c, '2 mons 6 days 03:00:00' as d, '1 year 2 mons 3 days 04:05:06.5' as e"),
    "fn_date_now": ("select now() is not null as a, current_date is not null as b, current_timestamp >= statement_timestamp() as c, localtimestamp is not null as d, clock_timestamp() is not null as e, length(current_time) >= 8 as f", "select true as a, true as b, true as c, true as d, true as e, true as f"),
    "fn_date_zone": ("select cast(timezone('Asia/Tokyo', timestamp '2024-07-01 12:00:00') as timestamp) as b", "select timestamp '2024-07-01 21:00:00' as b"),
    "fn_conditional": "select n_nationkey, nullif(n_regionkey, 1) as a, coalesce(nullif(n_regionkey, 1), -1) as b, greatest(n_nationkey, 5, null) as c, least(n_nationkey, 5, null) as d from nation",
    "fn_nulls": ("select n_nationkey, num_nulls(n_name, null, 1) as a, num_nonnulls(n_name, null, 1) as b, booleq(true, n_nationkey > 3) as c, boolne(true, false) as d, boollt(false, true) as e, boolge(false, true) as f from nation", "select n_nationkey, 1 as a, 2 as b, n_nationkey > 3 as c, true as d, true as e, false as f from nation"),
    "fn_array_build": ("select n_nationkey, array_to_string(array_append(array[1, 2], n_nationkey), ',') as a, array_to_string(array_prepend(n_nationkey, array[1, 2]), ',') as b, array_to_string(array_cat(array[1], array[n_nationkey]), ',') as c, array_to_string(array[1, 2] || n_nationkey, ',') as d, array_to_string(array_remove(array[1, 2, 1], 1), ',') as e, array_to_string(array_replace(array[1, 2, 1], 1, n_nationkey), ',') as f, array_to_string(array_reverse(array[1, 2, 3]), ',') as g, array_to_string(trim_array(array[1, 2, 3], 1), ',') as h, array_to_string(array_fill(7, array[3]), ',') as i from nation",
        "select n_nationkey, '1,2,' || n_nationkey as a, n_nationkey || ',1,2' as b, '1,' || n_nationkey as c, '1,2,' || n_nationkey as d, '2' as e, n_nationkey || ',2,' || n_nationkey as f, '3,2,1' as g, '1,2' as h, '7,7,7' as i from nation"),
    "fn_array_inspect": ("select array_length(array[1, 2, 3], 1) as a, array_position(array['a', 'b'], 'b')::int as b, array_to_string(array_positions(array[1, 2, 1], 1), ',') as c, cardinality(array[1, 2]) as d, array_upper(array[4, 5], 1) as e, array_lower(array[4, 5], 1) as f, array_dims(array[1, 2]) as g, array_ndims(array[array[1], array[2]]) as h, array_to_string(array_sort(array[3, 1, 2]), ',') as i, array_to_string(array_sort(array[3, 1, 2], true), ',') as j", "select 3 as a, 2 as b, '1,3' as c, 2 as d, 2 as e, 1 as f, '[1:2]' as g, 2 as h, '1,2,3' as i, '3,2,1' as j"),
    "fn_array_text": ("select array_to_string(string_to_array('a,b,,c', ','), '|') as a, array_to_string(string_to_array('a,x,c', ',', 'x'), '|', '?') as b, array_to_string(array[1, null, 3], ',', '*') as c, (array['p', 'q', 'r'])[2] as d, array_to_string((array[1, 2, 3, 4])[2:3], ',') as e, (array[1, 2])[5] is null as f", "select 'a|b||c' as a, 'a|?|c' as b, '1,*,3' as c, 'q' as d, '2,3' as e, true as f"),
    "fn_array_operators": ("select array[1, 2, 3] @> array[2] as a, array[2] <@ array[1, 2] as b, array[1, 2] && array[2, 3] as c, array[1, 4] && array[2, 3] as d, array[1, 2] = array[1, 2] as e, 3 = any('{1,3}'::int[]) as f", "select true as a, true as b, true as c, false as d, true as e, true as f"),
    "fn_array_random": ("select cardinality(array_shuffle(array[1, 2, 3])) as a, cardinality(array_sample(array[1, 2, 3], 2)) as b, random() between 0 and 1 as c, length(gen_random_uuid()) as d, length(uuid_generate_v4()) as e, octet_length(gen_random_bytes(8)) as f", "select 3 as a, 2 as b, true as c, 36 as d, 36 as e, 8 as f"),
    "fn_json_get": ("select event_id, props->>'k' as k, json_extract_path_text(props, 'k') as p, json_typeof(props) as t from events", "select event_id, props->>'k' as k, props->>'k' as p, 'object' as t from events"),
    "fn_json_path": ("select '{\"a\":{\"b\":[1,{\"c\":2}]}}'::jsonb #>> '{a,b,1,c}' as a, '{\"a\":{\"b\":[1,2]}}'::jsonb -> 'a' -> 'b' ->> 1 as b, json_extract_path('{\"a\":[1]}', 'a') as c, json_array_length('[1,2,3]') as d, ('{\"a\":[10,20]}'::jsonb)['a'][1] as e", "select '2' as a, '2' as b, '[1]' as c, 3 as d, '20' as e"),
    "fn_json_build": ("select n_nationkey, json_build_object('k', n_nationkey, 'n', n_name) as a, json_build_array(n_nationkey, n_name, null) as b, to_json(n_name) as c, array_to_json(array[1, 2]) as d, json_object(array['a', 'b'], array['1', '2']) as e from nation", "select n_nationkey, '{\"k\":' || n_nationkey || ',\"n\":\"' || n_name || '\"}' as a, '[' || n_nationkey || ',\"' || n_name || '\",null]' as b, '\"' || n_name || '\"' as c, '[1,2]' as d, '{\"a\":\"1\",\"b\":\"2\"}' as e from nation"),
    "fn_json_row": ("select row_to_json(r) as j from (select r_regionkey, r_name from region) as r", "select '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' as j from region"),
    "fn_jsonb_mutate": ("select jsonb_set('{\"a\": {\"b\": 1}}', '{a,b}', '5') as a, jsonb_set('{\"a\": 1}', '{c}', '2', false) as b, jsonb_insert('{\"a\": [0, 1]}', '{a,1}', '9') as c, jsonb_delete('{\"a\": 1, \"b\": 2}', 'a') as d, '{\"a\": 1, \"b\": 2}'::jsonb - 'b' as e, '{\"a\": {\"b\": 1, \"c\": 2}}'::jsonb #- '{a,b}' as f, '{\"a\": 1}'::jsonb || '{\"b\": 2}'::jsonb as g, jsonb_strip_nulls('{\"a\": null, \"b\": 1}') as h, jsonb_set_lax('{\"a\": 1}', '{a}', null, true, 'delete_key') as i",
        "select '{\"a\": {\"b\": 5}}' as a, '{\"a\": 1}' as b, '{\"a\": [0, 9, 1]}' as c, '{\"b\": 2}' as d, '{\"a\": 1}' as e, '{\"a\": {\"c\": 2}}' as f, '{\"a\": 1, \"b\": 2}' as g, '{\"b\":1}' as h, '{}' as i"),
    "fn_jsonb_tests": ("select '{\"a\": [1, 2]}'::jsonb @> '{\"a\": [2]}'::jsonb as a, '{\"a\": 1}'::jsonb <@ '{\"a\": 1, \"b\": 2}'::jsonb as b, '{\"a\": 1}'::jsonb ? 'a' as c, '{\"a\": 1}'::jsonb ?| array['x', 'a'] as d, '{\"a\": 1}'::jsonb ?& array['x', 'a'] as e, jsonb_exists('[\"p\"]', 'p') as f, jsonb_path_exists('{\"a\": [1, 5]}', '$.a[*] ? (@ > 3)') as g, '{\"a\": 2}'::jsonb @@ '$.a > 1' as h, jsonb_path_match('{\"a\": 2}', '$.a == 3') as i, jsonb_path_query_array('{\"a\": [1, 2, 3]}', '$.a[*] ? (@ >= $m)', '{\"m\": 2}') as j, jsonb_path_query_first('{\"a\": [7, 8]}', '$.a[1]') as k",
        "select true as a, true as b, true as c, true as d, false as e, true as f, true as g, true as h, false as i, '[2, 3]' as j, '8' as k"),
    "fn_vector": ("select vec_id, round(embedding <-> (select embedding from embeddings where vec_id = 0), 5) as l2, round(embedding <=> (select embedding from embeddings where vec_id = 0), 5) as cos, round(embedding <#> (select embedding from embeddings where vec_id = 0), 5) as ip, vector_dims(embedding) as dims, round(vector_norm(embedding), 5) as norm from embeddings",
        "select vec_id, round(list_distance(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 5) as l2, round(1 - list_cosine_similarity(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 5) as cos, round(-list_dot_product(embedding::double[], (select embedding::double[] from embeddings where vec_id = 0)), 5) as ip, len(embedding)::int as dims, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 5) as norm from embeddings"),
    "fn_vector_knn": ("select vec_id from embeddings order by embedding <-> (select embedding from embeddings where vec_id = 3), vec_id limit 10", "select vec_id from embeddings order by list_distance(embedding::double[], (select embedding::double[] from embeddings where vec_id = 3)), vec_id limit 10"),
    "fn_vector_literal": ("select l1_distance('[1,2,3]'::vector, '[2,4,6]'::vector) as a, inner_product('[1,2]'::vector, '[3,4]'::vector) as b, vector_dims('[1,2,3]'::vector) as c, array_to_string(subvector('[1,2,3,4]'::vector, 2, 2)::int[], ',') as d, array_to_string(('[1,2]'::vector + '[3,4]'::vector)::int[], ',') as e", "select 6.0::double as a, 11.0::double as b, 3 as c, '2,3' as d, '4,6' as e"),
    "fn_range": ("select int4range(1, 10) @> 5 as a, int4range(1, 10) @> 10 as b, int4range(1, 10, '[]') @> 10 as c, float8range(1.0, 2.5) @> 0.5 as d, (point(1, 2)).x as e", "select true as a, false as b, true as c, false as d, 1.0::double as e"),
    "fn_system": ("select pg_typeof(1) as a, pg_typeof('x'::text) as b, pg_typeof(1.5::float8) as c, pg_input_is_valid('12', 'int4') as d, pg_input_is_valid('x', 'int4') as e, pg_size_pretty(123456789::bigint) as f, has_table_privilege('nation', 'select') as g, current_user is not null as h, version() like 'PostgreSQL%' as i", "select 'integer' as a, 'text' as b, 'double precision' as c, true as d, false as e, '118 MB' as f, true as g, true as h, true as i"),
    "fn_uuid_url": ("select uuid_generate_v5('6ba7b810-9dad-11d1-80b4-00c04fd430c8', 'example.org') as a, uuid_nil() as b, urlencode('a b&c') as c, to_tsvector('the cat') as d", "select 'aad03681-8b63-5304-89e0-8ca8f49461b5' as a, '00000000-0000-0000-0000-000000000000' as b, 'a+b%26c' as c, 'the cat' as d"),
    "fn_literals": ("select 0x1F as a, 1_000 as b, E'a\\tb' as c, U&'\\0041' as d, $$it's$$ as e, 0b101 as f", "select 31 as a, 1000 as b, 'a\tb' as c, 'A' as d, 'it''s' as e, 5 as f"),
    "fn_jsonb_names": ("select jsonb_build_object('a', 1) as a, jsonb_build_array(1, 'x') as b, to_jsonb(5) as c, jsonb_object(array['k', 'v']) as d, jsonb_extract_path('{\"a\":{\"b\":3}}', 'a', 'b') as e, jsonb_extract_path_text('{\"a\":{\"b\":\"q\"}}', 'a', 'b') as f, jsonb_array_length('[1,2]') as g, jsonb_typeof('[1]') as h, json_strip_nulls('{\"a\":null,\"b\":[null,1]}') as i, jsonb_strip_nulls('{\"b\":[null,1]}', true) as j", "select '{\"a\":1}' as a, '[1,\"x\"]' as b, '5' as c, '{\"k\":\"v\"}' as d, '3' as e, 'q' as f, 2 as g, 'array' as h, '{\"b\":[null,1]}' as i, '{\"b\":[1]}' as j"),
    "fn_jsonb_calls": ("select jsonb_exists_any('{\"a\":1}', array['x', 'a']) as a, jsonb_exists_all('{\"a\":1}', array['x', 'a']) as b, jsonb_concat('[1]', '[2]') as c, jsonb_contains('[1,2]', '[2]') as d, jsonb_contained('[3]', '[1,2]') as e, jsonb_delete_path('{\"a\":{\"b\":1}}', '{a,b}') as f, jsonb_populate_record_valid(null, '{}') as g, length(json_pretty('{\"a\":1}')) as h, jsonb_pretty('[]') as i", "select true as a, false as b, '[1, 2]' as c, true as d, false as e, '{\"a\": {}}' as f, true as g, 14 as h, '[]' as i"),
    "fn_vector_named": ("select vec_id, round(l2_distance(embedding, embedding), 6) as a, abs(round(cosine_distance(embedding, embedding), 6)) as b, round(negative_inner_product(embedding, embedding), 4) as c, vector_dims(vector_concat(embedding, embedding)) as d, cardinality(vector_to_float4(embedding)) as e from embeddings", "select vec_id, 0.0::double as a, 0.0::double as b, round(-list_dot_product(embedding::double[], embedding::double[]), 4) as c, (2 * len(embedding))::int as d, len(embedding)::int as e from embeddings"),
    "fn_system_constants": ("select current_database() is not null as a, current_schema() is not null as b, session_user is not null as c, pg_backend_pid() > 0 as d, pg_column_size('abc') > 0 as e, pg_relation_size('nation') > 0 as f, pg_total_relation_size('nation') > 0 as g, pg_get_userbyid(10) as h, has_column_privilege('nation', 'n_name', 'select') as i, has_schema_privilege('public', 'usage') as j, pg_table_is_visible(1) as k, pg_type_is_visible(1) as l, pg_get_expr('x', 1) = 'x' as m, obj_description(1) is null as n, col_description(1, 1) is null as o, shobj_description(1, 'x') is null as p, pg_lsn('0/1') as q, format_type(23, -1) is not null as r, pg_column_compression('x') is null as s, float8_combine(1, 2) is null as t, float8_regr_combine(1, 2) is null as u, current_catalog is not null as v, user is not null as w",
        "select true as a, true as b, true as c, true as d, true as e, true as f, true as g, 'postgres' as h, true as i, true as j, true as k, true as l, true as m, true as n, true as o, true as p, '0/1' as q, true as r, true as s, true as t, true as u, true as v, true as w"),
    "fn_text_search_and_rest": ("select tsquery('cat') as a, ts_headline('the cat', 'cat') as b, json_to_tsvector('{}') as c, jsonb_to_tsvector('{}') as d, length(uuid_generate_v1()) as e, length(uuid_generate_v1mc()) as f, encode(set_byte('abc'::bytea, 1, 65), 'hex') as g, int8range(1, 5) @> 3 as h, numrange(1, 5, '(]') @> 1 as i, textrange('a', 'c') @> 'b' as j, boolgt(true, false) as k, boolle(false, false) as l, transaction_timestamp() is not null as m, localtime is not null as n", "select 'cat' as a, 'the cat' as b, '{}' as c, '{}' as d, 36 as e, 36 as f, '614163' as g, true as h, false as i, true as j, true as k, true as l, true as m, true as n"),
    "fn_at_time_zone": ("select timestamp '2024-07-01 12:00:00' at time zone 'America/New_York' as a, timestamp '2024-01-01 00:30:00' at time zone 'Asia/Tokyo' as b", "select timestamp '2024-07-01 16:00:00' as a, timestamp '2023-12-31 15:30:00' as b"),
    "doc_words": ("select lang, count(*) as n, sum(array_length(regexp_split_to_array(text, '\\s+'), 1))::bigint as words from documents group by lang", "select lang, count(*) as n, sum(len(regexp_split_to_array(text, '\\s+')))::bigint as words from documents group by lang"),
    "doc_exact_duplicates": "select md5(text) as h, count(*) as n, min(doc_id) as first from documents group by md5(text) having count(*) > 1",
    "conversation_rollup": "select conv_id, count(*) as turns, string_agg(role, '>' order by turn) as roles from conversations group by conv_id",
    "page_hosts": ("select split_part(split_part(url, '://', 2), '/', 1) as host, count(*) as n, max(length(html)) as longest from pages group by host",) * 2,
}
