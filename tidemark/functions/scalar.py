"""PostgreSQL's scalar functions as Spark SQL expressions.

A function is a template over its arguments' SQL, chosen by their number ('*' for any), with the type of
its result ('=' for the first argument's). Everything here stays inside the JVM; what Spark cannot express
is in `tidemark.functions.python`, registered under the same names with the prefix pg_.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Template = tuple[str | Callable[[list[str]], str], str]


def _same(names: str, kind: str) -> dict[str, dict[int | str, Template]]:
    """Functions that Spark has under the same name and with the same meaning."""
    return {n: {"*": ((lambda n: lambda a: f"{n}({', '.join(a)})")(n), kind)} for n in names.split()}


def _alias(pairs: str, kind: str) -> dict[str, dict[int | str, Template]]:
    """Functions that Spark has under another name: pg=spark."""
    return {p: {"*": ((lambda s: lambda a: f"{s}({', '.join(a)})")(s), kind)} for p, s in (x.split("=") for x in pairs.split())}


def _const(names: str, sql: str, kind: str) -> dict[str, dict[int | str, Template]]:
    return {n: {"*": (lambda a: sql, kind)} for n in names.split()}


_Q = "concat('''', replace({0}, '''', ''''''), '''')"
_GCD = "aggregate(sequence(1, 92), struct(abs(cast({0} as bigint)) as a, abs(cast({1} as bigint)) as b), (s, i) -> if(s.b = 0, s, struct(s.b as a, s.a % s.b as b)), s -> s.a)"
_REGEX_FLAGS = "concat(if({2} like '%i%', '(?i)', ''), if({2} like '%n%' or {2} like '%m%', '(?m)', ''), if({2} like '%s%', '(?s)', ''), if({2} like '%x%', '(?x)', ''), {1})"
_TRUNC = "(sign({0}) * floor(abs({0}) * power(10, {1})) / power(10, {1}))"
_EPOCH = "(unix_micros(cast(cast({0} as timestamp_ntz) as timestamp)) / 1e6D)"

STRING = {
    **_same("lower upper concat_ws replace repeat reverse translate split_part lpad rpad md5 btrim ascii", "text"),
    **_alias("starts_with=startswith", "bool"),
    **_alias("length=char_length char_length=char_length character_length=char_length octet_length=octet_length bit_length=bit_length ascii=ascii bit_count=bit_count", "int"),
    "concat": {"*": (lambda a: f"concat_ws('', {', '.join(f'cast({x} as string)' for x in a)})", "text")},
    "substring": {
        2: (lambda a: (f"if(regexp_like({a[0]}, {a[1]}), regexp_extract({a[0]}, {a[1]}, 1), null)" if re.search(r"\((?!\?)", a[1]) else f"regexp_substr({a[0]}, {a[1]})") if a[1].startswith("'") else f"substring({a[0]}, greatest({a[1]}, 1))", "text"),
        3: (lambda a: f"if({a[2]} < 0, raise_error('negative substring length not allowed'), substring({a[0]}, greatest({a[1]}, 1), greatest({a[2]} + least({a[1]} - 1, 0), 0)))" if not a[2].startswith("'") else f"regexp_extract({a[0]}, {a[1]}, 1)", "text"),
    },
    "position": {2: ("position({0}, {1})", "int")},
    "strpos": {2: ("position({1}, {0})", "int")},
    "overlay": {3: ("overlay({0} placing {1} from {2})", "text"), 4: ("overlay({0} placing {1} from {2} for {3})", "text")},
    "left": {2: ("case when {1} >= 0 then left({0}, {1}) else left({0}, greatest(char_length({0}) + {1}, 0)) end", "text")},
    "right": {2: ("case when {1} >= 0 then right({0}, {1}) else substring({0}, 1 - {1}) end", "text")},
    "ltrim": {1: ("ltrim({0})", "text"), 2: ("trim(leading {1} from {0})", "text")},
    "rtrim": {1: ("rtrim({0})", "text"), 2: ("trim(trailing {1} from {0})", "text")},
    "trim": {1: ("trim({0})", "text"), 2: ("trim(both {1} from {0})", "text")},
    "chr": {1: ("decode(unhex(case when {0} < 128 then lpad(hex({0}), 2, '0') when {0} < 2048 then hex(49280 + ({0} div 64) * 256 + {0} % 64) when {0} < 65536 then hex(14712960 + ({0} div 4096) * 65536 + (({0} div 64) % 64) * 256 + {0} % 64) else hex(4034953344 + ({0} div 262144) * 16777216 + (({0} div 4096) % 64) * 65536 + (({0} div 64) % 64) * 256 + {0} % 64) end), 'UTF-8')", "text")},
    "encode": {2: ("case {1} when 'hex' then lower(hex({0})) when 'base64' then base64({0}) else pg_escape(cast({0} as binary)) end", "text")},
    "decode": {2: ("case {1} when 'hex' then unhex({0}) when 'base64' then unbase64({0}) else pg_unescape({0}) end", "bytea")},
    "initcap": {1: ("array_join(transform(regexp_extract_all(lower({0}), '([\\\\p{{L}}\\\\p{{N}}]+|[^\\\\p{{L}}\\\\p{{N}}]+)', 1), w -> concat(upper(left(w, 1)), substring(w, 2))), '')", "text")},
    "quote_literal": {1: (_Q, "text")},
    "quote_nullable": {1: (f"coalesce({_Q}, 'NULL')", "text")},
    "quote_ident": {1: ("if({0} rlike '^[a-z_][a-z0-9_$]*$', {0}, concat('\"', replace({0}, '\"', '\"\"'), '\"'))", "text")},
    "format": {"*": (lambda a: f"pg_format({a[0]}, array({', '.join(f'cast({x} as string)' for x in a[1:])}))" if a[1:] else f"pg_format({a[0]}, cast(array() as array<string>))", "text")},
    "to_hex": {1: ("lower(hex({0}))", "text")},
    "to_oct": {1: ("conv(cast({0} as string), 10, 8)", "text")},
    "to_bin": {1: ("bin({0})", "text")},
    "unistr": {1: ("pg_unistr({0})", "text")},
    "to_char": {2: ("pg_to_char(cast({0} as string), {1})", "text")},
    "to_number": {2: ("cast(regexp_replace({0}, '[^0-9.+-]', '') as decimal(38, 10))", "numeric")},
    "sha224": {1: ("sha2({0}, 224)", "text")},
    "sha256": {1: ("sha2({0}, 256)", "text")},
    "sha384": {1: ("sha2({0}, 384)", "text")},
    "sha512": {1: ("sha2({0}, 512)", "text")},
    "digest": {1: ("sha2({0}, 256)", "text"), 2: ("case lower({1}) when 'md5' then md5({0}) when 'sha1' then sha1({0}) when 'sha224' then sha2({0}, 224) when 'sha256' then sha2({0}, 256) when 'sha384' then sha2({0}, 384) when 'sha512' then sha2({0}, 512) end", "text")},
    "hmac": {3: ("pg_hmac({0}, {1}, {2})", "text")}, "crypt": {2: ("pg_crypt({0}, {1})", "text")},
    "gen_salt": {1: ("pg_gen_salt({0}, -1, rand())", "text"), 2: ("pg_gen_salt({0}, {1}, rand())", "text")},
    "crc32": {1: ("crc32(cast({0} as binary))", "bigint")},
    "crc32c": {1: ("pg_crc32c(cast({0} as binary))", "bigint")},
    "get_byte": {2: ("conv(hex(substring({0}, {1} + 1, 1)), 16, 10)::int", "int")},
    "set_byte": {3: ("overlay({0} placing unhex(lpad(hex({2}), 2, '0')) from {1} + 1 for 1)", "bytea")},
    "get_bit": {2: ("getbit({0}, {1})", "int")},
    "set_bit": {3: ("if({2} = 1, {0} | shiftleft(1L, {1}), {0} & ~shiftleft(1L, {1}))", "bigint")},
    **{f"http_{m}": {1: (f"pg_http('{m.upper()}', {{0}}, null, null)", "json"), 2: (f"pg_http('{m.upper()}', {{0}}, {{1}}, null)", "json"), 3: (f"pg_http('{m.upper()}', {{0}}, {{1}}, {{2}})", "json")} for m in ("get", "post", "put", "patch", "delete", "head")},
    "urlencode": {1: ("url_encode({0})", "text")},
}

REGEX = {
    "regexp_like": {2: ("regexp_like({0}, {1})", "bool"), 3: (f"regexp_like({{0}}, {_REGEX_FLAGS})", "bool")},
    "regexp_match": {2: ("pg_regexp_match({0}, {1}, '')", "text[]"), 3: ("pg_regexp_match({0}, {1}, {2})", "text[]")},
    "regexp_matches": {2: ("pg_regexp_match({0}, {1}, '')", "text[]"), 3: ("pg_regexp_match({0}, {1}, {2})", "text[]")},
    "regexp_replace": {3: ("pg_regexp_replace({0}, {1}, {2}, '')", "text"), 4: (lambda a: f"regexp_replace({a[0]}, {a[1]}, regexp_replace({a[2]}, '\\\\\\\\([0-9])', '\\\\$$1'))" if a[3] == "'g'" else f"pg_regexp_replace({a[0]}, {a[1]}, {a[2]}, {a[3]})", "text")},
    "regexp_split_to_array": {2: ("split({0}, {1})", "text[]"), 3: (f"split({{0}}, {_REGEX_FLAGS})", "text[]")},
    "regexp_count": {2: ("regexp_count({0}, {1})", "int"), 3: ("regexp_count(substring({0}, {2}), {1})", "int"), 4: ("regexp_count(substring({0}, {2}), concat(if({3} like '%i%', '(?i)', ''), {1}))", "int")},
    "regexp_instr": {2: ("regexp_instr({0}, {1})", "int"), "*": (lambda a: f"pg_regexp_instr({', '.join(a + ['1', '1', '0', repr(''), '0'][len(a) - 2 :])})", "int")},
    "regexp_substr": {2: ("regexp_substr({0}, {1})", "text"), "*": (lambda a: f"pg_regexp_substr({', '.join(a + ['1', '1', repr(''), '0'][len(a) - 2 :])})", "text")},
}

_DEG = {f"{f}d": {1: (f"{f}(radians({{0}}))", "double")} for f in ("sin", "cos", "tan")}
_ARC = {f"a{f}d": {1: (f"degrees(a{f}({{0}}))", "double")} for f in ("sin", "cos", "tan")}

MATH = {
    **_same("abs", "="),
    **_same("sqrt cbrt exp ln log10 sin cos tan asin acos atan atan2 degrees radians sinh cosh tanh asinh acosh atanh pi power", "double"),
    **_alias("pow=power random=rand", "double"),
    **_DEG,
    **_ARC,
    "ceil": {1: ("ceil({0})", "double")}, "ceiling": {1: ("ceil({0})", "double")}, "floor": {1: ("floor({0})", "double")},
    "round": {1: ("round({0})", "="), 2: ("round({0}, {1})", "=")},
    "trunc": {1: ("(sign({0}) * floor(abs({0})))", "="), 2: (_TRUNC, "=")},
    "truncate": {1: ("(sign({0}) * floor(abs({0})))", "="), 2: (_TRUNC, "=")},
    "log": {1: ("log10({0})", "double"), 2: ("log({0}, {1})", "double")},
    "cotd": {1: ("(1 / tan(radians({0})))", "double")},
    "atan2d": {2: ("degrees(atan2({0}, {1}))", "double")},
    "sign": {1: ("sign({0})", "double")},
    "numeric_inc": {1: ("({0} + 1)", "=")}, "numeric_dec": {1: ("({0} - 1)", "=")},
    "width_bucket": {2: ("size(filter({1}, t -> t <= {0}))", "int"), 4: ("cast(width_bucket({0}, {1}, {2}, {3}) as int)", "int")},
    "scale": {1: ("length(regexp_extract(cast({0} as string), '[.]([0-9]*)', 1))", "int")},
    "min_scale": {1: ("length(regexp_extract(cast({0} as string), '[.]([0-9]*[1-9])0*$', 1))", "int")},
    "trim_scale": {1: ("regexp_replace(regexp_replace(cast({0} as string), '([.][0-9]*[1-9])0+$', '$1'), '[.]0*$', '')::decimal(38, 10)", "numeric")},
    "factorial": {1: ("aggregate(sequence(1, greatest({0}, 1)), cast(1 as decimal(38, 0)), (x, i) -> cast(x * i as decimal(38, 0)))", "numeric")},
    "mod": {2: ("({0} % {1})", "=")}, "div": {2: ("({0} div {1})", "bigint")},
    "gcd": {2: (_GCD, "bigint")},
    "lcm": {2: (f"if({{0}} = 0 or {{1}} = 0, 0L, abs(cast({{0}} as bigint) div {_GCD} * {{1}}))", "bigint")},
}

DATETIME = {
    "date": {1: ("cast({0} as date)", "date")},
    "timestamp": {1: ("cast({0} as timestamp_ntz)", "timestamp")},
    **_const("now current_timestamp statement_timestamp transaction_timestamp clock_timestamp", "current_timestamp()", "timestamptz"),
    **_const("localtimestamp", "localtimestamp()", "timestamp"),
    **_const("current_time localtime", "date_format(current_timestamp(), 'HH:mm:ss.SSSSSS')", "text"),
    **_const("current_date", "current_date()", "date"),
    "age": {1: ("pg_age(cast(current_date() as timestamp_ntz), cast({0} as timestamp_ntz))", "text"), 2: ("pg_age(cast({0} as timestamp_ntz), cast({1} as timestamp_ntz))", "text")},
    "date_part": {2: (lambda a: extract(a[0].strip("'").lower(), a[1]), "double")},
    "date_trunc": {2: ("cast(date_trunc({0}, {1}) as timestamp_ntz)", "timestamp")},
    "date_add": {2: ("date_add({0}, {1})", "date")}, "date_sub": {2: ("date_sub({0}, {1})", "date")},
    "to_timestamp": {1: ("timestamp_seconds({0})", "timestamptz"), 2: (lambda a: f"to_timestamp_ntz({a[0]}, {pattern(a[1])})", "timestamp")},
    "to_date": {2: (lambda a: f"to_date({a[0]}, {pattern(a[1])})", "date")},
    "make_interval": {"*": (lambda a: f"pg_interval({', '.join(f'cast({x} as double)' for x in a + ['0'] * (7 - len(a)))})", "text")},
    "justify_hours": {1: ("pg_justify({0}, 'hours')", "text")}, "justify_days": {1: ("pg_justify({0}, 'days')", "text")}, "justify_interval": {1: ("pg_justify({0}, 'interval')", "text")},
    "isfinite": {1: ("if({0} is null, null, true)", "bool")},
    "timezone": {2: ("from_utc_timestamp({1}, {0})", "timestamp")},
    "make_date": {3: ("make_date({0}, {1}, {2})", "date")},
    "make_time": {3: ("format_string('%02d:%02d:%s', {0}, {1}, lpad(regexp_replace(cast(cast({2} as decimal(9, 6)) as string), '[.]?0+$', ''), greatest(2, length(regexp_replace(cast(cast({2} as decimal(9, 6)) as string), '[.]?0+$', ''))), '0'))", "text")},
    "make_timestamp": {6: ("make_timestamp_ntz({0}, {1}, {2}, {3}, {4}, {5})", "timestamp")},
}

CONDITIONAL = {
    **_same("nullif greatest least coalesce", "="),
    "num_nulls": {"*": (lambda a: "(" + " + ".join(f"if({x} is null, 1, 0)" for x in a) + ")", "int")},
    "num_nonnulls": {"*": (lambda a: "(" + " + ".join(f"if({x} is null, 0, 1)" for x in a) + ")", "int")},
    **{f"bool{n}": {2: (f"({{0}} {op} {{1}})", "bool")} for n, op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("gt", ">"), ("le", "<="), ("ge", ">="))},
}

ARRAY = {
    "array_append": {2: ("array_append(coalesce({0}, array()), {1})", "=")},
    "array_prepend": {2: ("array_prepend(coalesce({1}, array()), {0})", "=")},
    "array_cat": {2: ("coalesce(concat({0}, {1}), {0}, {1})", "=")},
    "array_remove": {2: ("filter({0}, x -> not (x <=> {1}))", "=")},
    "array_replace": {3: ("transform({0}, x -> if(x <=> {1}, {2}, x))", "=")},
    "array_position": {2: ("nullif(array_position({0}, {1}), 0)", "bigint"), 3: ("try_element_at(filter(transform({0}, (x, i) -> if(x <=> {1}, i + 1, null)), y -> y >= {2}), 1)", "int")},
    "array_positions": {2: ("filter(transform({0}, (x, i) -> if(x <=> {1}, i + 1, null)), y -> y is not null)", "int[]")},
    "array_length": {2: (lambda a: f"nullif(size({a[0]}{'[0]' * (int(a[1]) - 1) if a[1].isdigit() else ''}), 0)", "int")},
    "array_dims": {1: ("if(size({0}) = 0, null, concat('[1:', size({0}), ']'))", "text")},
    "array_ndims": {1: ("if(size({0}) = 0, null, length(regexp_extract(typeof({0}), '^((?:array<)+)', 1)) div 6)", "int")},
    "array_fill": {2: (lambda a: _filled(a), "="), 3: (lambda a: _filled(a), "=")},
    "array_reverse": {1: ("reverse({0})", "=")},
    "trim_array": {2: ("slice({0}, 1, size({0}) - {1})", "=")},
    "array_shuffle": {1: ("shuffle({0})", "=")}, "array_sample": {2: ("slice(shuffle({0}), 1, {1})", "=")},
    "array_sort": {1: ("array_sort({0})", "="), 2: ("if({1}, reverse(array_sort({0})), array_sort({0}))", "="), 3: ("if({2}, concat(filter({0}, x -> x is null), if({1}, reverse(array_sort(filter({0}, x -> x is not null))), array_sort(filter({0}, x -> x is not null)))), concat(if({1}, reverse(array_sort(filter({0}, x -> x is not null))), array_sort(filter({0}, x -> x is not null))), filter({0}, x -> x is null)))", "=")},
    "array_upper": {2: ("nullif(size({0}), 0)", "int")}, "array_lower": {2: ("if(size({0}) > 0, 1, null)", "int")},
    "cardinality": {1: ("size({0})", "int")},
    "string_to_array": {2: ("if({1} is null, split({0}, ''), if({0} = '', cast(array() as array<string>), split({0}, concat('\\\\Q', {1}, '\\\\E'))))", "text[]"), 3: ("transform(if({0} = '', cast(array() as array<string>), split({0}, concat('\\\\Q', {1}, '\\\\E'))), x -> nullif(x, {2}))", "text[]")},
    "array_to_string": {2: ("array_join(cast({0} as array<string>), {1})", "text"), 3: ("array_join(cast({0} as array<string>), {1}, {2})", "text")},
}


def _filled(a: list[str]) -> str:
    out = a[0]
    for d in reversed(a[1].removeprefix("array(").removesuffix(")").split(",")):
        out = f"array_repeat({out}, {d.strip()})"
    return out


def _both(name: str, forms: dict[int | str, Template]) -> dict[str, dict[int | str, Template]]:
    return {f"json_{name}": forms, f"jsonb_{name}": forms}


def _path(keys: list[str]) -> str:
    """A quoted JSON path of keys and indexes."""
    if all(k.startswith("'") for k in keys):
        return "'$" + "".join(f"[{k[1:-1]}]" if k[1:-1].isdigit() else f"[\\'{k[1:-1]}\\']" for k in keys) + "'"
    return "concat('$', " + ", ".join(f"if({k} rlike '^[0-9]+$', concat('[', {k}, ']'), concat('[\\'', {k}, '\\']'))" for k in keys) + ")"


JSON = {
    "row": {"*": (lambda a: f"struct({', '.join(a)})", "record")},
    "to_json": {1: ("pg_to_json({0})", "json")}, "to_jsonb": {1: ("pg_to_json({0})", "json")},
    "row_to_json": {1: ("to_json({0}, map('ignoreNullFields', 'false'))", "json"), 2: ("to_json({0}, map('ignoreNullFields', 'false', 'pretty', cast({1} as string)))", "json")},
    "array_to_json": {1: ("to_json({0})", "json"), 2: ("to_json({0})", "json")},
    **_both("object", {1: ("to_json(map_from_entries(transform(sequence(0, size({0}) div 2 - 1), i -> struct({0}[2 * i], {0}[2 * i + 1]))))", "json"), 2: ("to_json(map_from_arrays({0}, {1}))", "json")}),
    **_both("build_object", {"*": (lambda a: "concat('{', concat_ws(',', " + ", ".join(f"concat(pg_to_json(cast({k} as string)), ':', coalesce(pg_to_json({v}), 'null'))" for k, v in zip(a[::2], a[1::2], strict=True)) + "), '}')" if a else "'{}'", "json")}),
    **_both("build_array", {"*": (lambda a: "concat('[', concat_ws(',', " + ", ".join(f"coalesce(pg_to_json({v}), 'null')" for v in a) + "), ']')" if a else "'[]'", "json")}),
    **_both("extract_path", {"*": (lambda a: f"to_json(variant_get(parse_json({a[0]}), {_path(a[1:])}, 'variant'))", "json")}),
    **_both("extract_path_text", {"*": (lambda a: f"get_json_object({a[0]}, {_path(a[1:])})", "text")}),
    **_both("array_length", {1: ("json_array_length({0})", "int")}),
    **_both("typeof", {1: ("case when substring(ltrim({0}), 1, 1) = '{{' then 'object' when substring(ltrim({0}), 1, 1) = '[' then 'array' when substring(ltrim({0}), 1, 1) = '\"' then 'string' when trim({0}) in ('true', 'false') then 'boolean' when trim({0}) = 'null' then 'null' when {0} is not null then 'number' end", "text")}),
    **_both("strip_nulls", {1: ("pg_json_strip_nulls({0}, false)", "json"), 2: ("pg_json_strip_nulls({0}, {1})", "json")}),
    **_both("pretty", {1: ("pg_json_pretty({0})", "text")}),
    "jsonb_exists": {2: ("if({0} is null or {1} is null, null, coalesce(array_contains(json_object_keys({0}), {1}), array_contains(from_json({0}, 'array<string>'), {1}), false))", "bool")},
    "jsonb_exists_any": {2: ("if({0} is null or {1} is null, null, coalesce(arrays_overlap(json_object_keys({0}), {1}), false))", "bool")},
    "jsonb_exists_all": {2: ("if({0} is null or {1} is null, null, coalesce(size(array_except({1}, json_object_keys({0}))) = 0, false))", "bool")},
    **{f"jsonb_path_{n}": {2: (f"pg_jsonb_path_{n}({{0}}, {{1}}, '{{{{}}}}')", t), 3: (f"pg_jsonb_path_{n}({{0}}, {{1}}, {{2}})", t), 4: (f"pg_jsonb_path_{n}({{0}}, {{1}}, {{2}})", t)} for n, t in (("exists", "bool"), ("match", "bool"), ("query_array", "json"), ("query_first", "json"))},
    "jsonb_path_query": {2: ("pg_jsonb_path_query_first({0}, {1}, '{{}}')", "json")},
    "jsonb_set": {3: ("pg_jsonb_set({0}, {1}, {2}, true)", "json"), 4: ("pg_jsonb_set({0}, {1}, {2}, {3})", "json")},
    "jsonb_set_lax": {3: ("pg_jsonb_set_lax({0}, {1}, {2}, true, 'use_json_null')", "json"), 4: ("pg_jsonb_set_lax({0}, {1}, {2}, {3}, 'use_json_null')", "json"), 5: ("pg_jsonb_set_lax({0}, {1}, {2}, {3}, {4})", "json")},
    "jsonb_insert": {3: ("pg_jsonb_insert({0}, {1}, {2}, false)", "json"), 4: ("pg_jsonb_insert({0}, {1}, {2}, {3})", "json")},
    "jsonb_concat": {2: ("pg_jsonb_concat({0}, {1})", "json")},
    "jsonb_contains": {2: ("pg_jsonb_contains({0}, {1})", "bool")}, "jsonb_contained": {2: ("pg_jsonb_contains({1}, {0})", "bool")},
    "jsonb_delete": {2: ("pg_jsonb_delete({0}, cast({1} as string))", "json")}, "jsonb_delete_path": {2: ("pg_jsonb_delete_path({0}, {1})", "json")},
    "jsonb_populate_record_valid": {2: (lambda a: _populates(*a), "bool")},
}

_NORM = "sqrt(aggregate({0}, 0D, (s, x) -> s + x * x))"
_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> cast(x as double) * y), 0D, (s, x) -> s + x)"
_NORMS = "(sqrt(aggregate({0}, 0D, (s, x) -> s + cast(x as double) * x)) * sqrt(aggregate({1}, 0D, (s, x) -> s + cast(x as double) * x)))"

VECTOR = {
    "l2_distance": {2: ("sqrt(aggregate(zip_with({0}, {1}, (x, y) -> (cast(x as double) - y) * (cast(x as double) - y)), 0D, (s, x) -> s + x))", "double")},
    "l1_distance": {2: ("aggregate(zip_with({0}, {1}, (x, y) -> abs(cast(x as double) - y)), 0D, (s, x) -> s + x)", "double")},
    "inner_product": {2: (_DOT, "double")},
    "negative_inner_product": {2: (f"(-{_DOT})", "double")},
    "cosine_distance": {2: (f"(1 - {_DOT} / {_NORMS})", "double")},
    "vector_dims": {1: ("size({0})", "int")},
    "vector_norm": {1: ("sqrt(aggregate({0}, 0D, (s, x) -> s + cast(x as double) * x))", "double")},
    "vector_to_float4": {"*": (lambda a: f"cast({a[0]} as array<float>)", "float[]")},
    "subvector": {3: ("slice({0}, {1}, {2})", "=")}, "vector_concat": {2: ("concat({0}, {1})", "=")},
}

#: Names of the types that pg_catalog.pg_type lists.
TYPE_NAMES = {"bool": "boolean", "int2": "smallint", "int4": "integer", "int8": "bigint", "float4": "real", "float8": "double precision", "timestamp": "timestamp without time zone", "timestamptz": "timestamp with time zone", "time": "time without time zone"}


def oid(name: str) -> int:
    """A number for a name, the same in every session."""
    out = 16384
    for c in name:
        out = (out * 31 + ord(c)) % 2_000_000_000
    return out


def _format_type(number: str) -> str:
    base = ["bool", "bytea", "int2", "int4", "int8", "text", "float4", "float8", "numeric", "date", "time", "timestamp", "timestamptz", "interval", "json", "jsonb", "uuid", "vector"]
    known = {oid(t): TYPE_NAMES.get(t, t) for t in base} | {oid(k): v for k, v in (("int", "integer"), ("bigint", "bigint"), ("smallint", "smallint"), ("double", "double precision"), ("float", "real"))}
    return f"case {number} {' '.join(f'when {k} then {v!r}' for k, v in known.items())} else '???' end"


def _members(struct: str) -> list[str]:
    """Names of a struct type's fields."""
    out, depth, name = [], 0, ""
    for c in struct[7:-1] + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(name.split(":")[0].strip(" `"))
            name = ""
        else:
            name += c
    return out


def _populates(base: str, text: str) -> str:
    """Whether JSON text is an object whose members can be cast to the base's type."""
    m = re.fullmatch(r"cast\(.* as (struct<.*>)\)", base, re.S)
    if not m:
        return f"(try_parse_json({text}) is not null)"
    kind, names = m[1].replace("'", "\\'"), ", ".join("'" + n.replace("'", "\\'") + "'" for n in _members(m[1]))
    return f"coalesce(try_parse_json({text}) is not null and forall(map_entries(from_json({text}, 'map<string,string>')), e -> e.value is null or not array_contains(array({names}), e.key) or array_contains(json_object_keys(to_json(from_json({text}, '{kind}'))), e.key)), false)"


SYSTEM = {
    **_const("version", "'PostgreSQL 18.0 compatible (tidemark on Spark)'", "text"),
    **_const("current_database current_catalog", "current_catalog()", "text"), **_const("current_schema", "current_database()", "text"),
    **_const("current_user session_user user", "current_user()", "text"), **_const("pg_backend_pid", "1", "int"),
    "pg_typeof": {1: ("case split(typeof({0}), '[(<]')[0] when 'int' then 'integer' when 'double' then 'double precision' when 'float' then 'real' when 'string' then 'text' when 'decimal' then 'numeric' when 'timestamp_ntz' then 'timestamp without time zone' when 'timestamp' then 'timestamp with time zone' when 'binary' then 'bytea' when 'struct' then 'record' when 'void' then 'unknown' else typeof({0}) end", "text")},
    "pg_input_is_valid": {2: (lambda a: f"(try_cast({a[0]} as {spark_type(a[1].strip(chr(39)))}) is not null)", "bool")},
    "pg_column_size": {1: ("octet_length(cast({0} as string))", "int")},
    **_const("pg_relation_size pg_total_relation_size", "0L", "bigint"),
    "pg_size_pretty": {1: ("case when abs({0}) < 10240 then concat({0}, ' bytes') when abs({0}) < 10485760 then concat(round({0} / 1024D)::bigint, ' kB') when abs({0}) < 10737418240 then concat(round({0} / 1048576D)::bigint, ' MB') when abs({0}) < 10995116277760 then concat(round({0} / 1073741824D)::bigint, ' GB') else concat(round({0} / 1099511627776D)::bigint, ' TB') end", "text")},
    **_const("pg_get_userbyid", "'postgres'", "text"), "format_type": {2: (lambda a: _format_type(a[0]), "text")}, "pg_get_expr": {2: ("{0}", "text"), 3: ("{0}", "text")},
    **_const("has_table_privilege has_column_privilege has_schema_privilege pg_table_is_visible pg_type_is_visible", "true", "bool"),
    **_const("obj_description col_description shobj_description float8_combine float8_regr_combine pg_column_compression", "cast(null as string)", "text"),
    "pg_lsn": {1: ("{0}", "text")},
    **{n: {"*": (lambda a: a[-1], "text")} for n in ("to_tsvector", "json_to_tsvector", "jsonb_to_tsvector", "tsquery")}, "ts_headline": {"*": (lambda a: a[0], "text")},
    **_const("gen_random_uuid uuid_generate_v4", "uuid()", "text"), **_const("uuid_nil", "'00000000-0000-0000-0000-000000000000'", "text"),
    **_const("uuid_generate_v1 uuid_generate_v1mc", "pg_uuid1()", "text"),
    "uuid_generate_v5": {2: ("pg_uuid5({0}, {1})", "text")},
    "gen_random_bytes": {1: ("element_at(transform(array(concat(uuid(), uuid())), u -> unhex(substring(array_join(transform(sequence(0, cast(({0} - 1) div 32 as int)), i -> sha2(concat(u, cast(i as string)), 256)), ''), 1, 2 * {0}))), 1)", "bytea")},
    "point": {2: ("named_struct('x', cast({0} as double), 'y', cast({1} as double))", "record")},
    **{n: {2: ("named_struct('lower', {0}, 'upper', {1}, 'lower_inc', true, 'upper_inc', false)", "range"), 3: ("named_struct('lower', {0}, 'upper', {1}, 'lower_inc', {2} like '[%', 'upper_inc', {2} like '%]')", "range")} for n in ("int4range", "int8range", "float8range", "numrange", "textrange")},
}

FUNCTIONS: dict[str, dict[int | str, Template]] = {**STRING, **REGEX, **MATH, **DATETIME, **CONDITIONAL, **ARRAY, **JSON, **VECTOR, **SYSTEM}

_TYPES = {"int": "int", "int4": "int", "integer": "int", "serial": "int", "int2": "smallint", "smallint": "smallint", "int8": "bigint", "bigint": "bigint", "bigserial": "bigint", "oid": "bigint", "float4": "float", "real": "float", "float8": "double", "double precision": "double", "double": "double", "float": "double", "text": "string", "varchar": "string", "char": "string", "character": "string", "character varying": "string", "bpchar": "string", "name": "string", "string": "string", "uuid": "string", "json": "string", "jsonb": "string", "bytea": "binary", "bool": "boolean", "boolean": "boolean", "date": "date", "timestamp": "timestamp_ntz", "timestamptz": "timestamp", "timestamp with time zone": "timestamp", "timestamp without time zone": "timestamp_ntz", "time": "string", "timetz": "string", "interval": "string", "money": "decimal(19, 2)", "vector": "array<float>", "regclass": "string", "regtype": "string"}


def spark_type(name: str, args: list[str] | None = None) -> str:
    """Spark's name for a PostgreSQL type."""
    name = name.lower().strip()
    if name.endswith("[]"):
        return f"array<{spark_type(name[:-2], args)}>"
    if name in ("numeric", "decimal", "dec"):
        return f"decimal({', '.join(args) if args else '38, 10'}{', 0' if args and len(args) == 1 else ''})"
    return _TYPES.get(name, name)


def pattern(quoted: str) -> str:
    """A quoted to_date or to_timestamp pattern in Java's letters."""
    for old, new in (("YYYY", "yyyy"), ("HH24", "HH"), ("MI", "mm"), ("SS", "ss"), ("DD", "dd"), ("Mon", "MMM"), ("HH12", "hh"), ("AM", "a"), ("PM", "a")):
        quoted = quoted.replace(old, new)
    return quoted


def extract(field: str, x: str) -> str:
    """EXTRACT with PostgreSQL's fields."""
    special = {"dow": f"(dayofweek({x}) - 1)", "isodow": f"(weekday({x}) + 1)", "doy": f"dayofyear({x})", "epoch": _EPOCH.format(x), "millisecond": f"(extract(second from {x}) * 1000)", "milliseconds": f"(extract(second from {x}) * 1000)", "microsecond": f"(extract(second from {x}) * 1000000)", "microseconds": f"(extract(second from {x}) * 1000000)", "decade": f"(year({x}) div 10)", "century": f"((year({x}) + 99) div 100)", "millennium": f"((year({x}) + 999) div 1000)", "isoyear": f"extract(yearofweek from {x})"}
    return special.get(field, f"extract({field} from {x})")


def _as_json(sql: str) -> str:
    """Writes pg_to_json(x) out: x as the only field of an object, without what surrounds it."""
    while (at := sql.rfind("pg_to_json(")) >= 0:
        depth, end, quote = 1, at + 11, False
        while depth:
            c = sql[end]
            if c == "\\":
                end += 1
            elif c == "'":
                quote = not quote
            elif not quote:
                depth += (c == "(") - (c == ")")
            end += 1
        whole = f"to_json(named_struct('v', {sql[at + 11 : end - 1]}), map('ignoreNullFields', 'false'))"
        sql = f"{sql[:at]}substring({whole}, 6, length({whole}) - 6){sql[end:]}"
    return sql


def call(name: str, args: list[str], kinds: list[str] | None = None) -> tuple[str, str] | None:
    """SQL and type of a call, or None if this library doesn't know the function."""
    forms = FUNCTIONS.get(name)
    if forms is None:
        return None
    form = forms.get(len(args)) or forms.get("*")
    if form is None:
        raise ValueError(f"{name} takes {' or '.join(map(str, forms))} arguments, not {len(args)}")
    template, kind = form
    sql = template(args) if callable(template) else template.format(*args)
    if "pg_to_json(" in sql:
        sql = _as_json(sql)
    return sql, (kinds[0] if kinds else "unknown") if kind == "=" else kind
