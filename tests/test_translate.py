"""The SQL front-end by itself: lexing, rewriting, and what it refuses."""

import pytest

from tidemark.engine import Engine
from tidemark.plans import lexer
from tidemark.plans.translate import interval, similar


def kinds(sql):
    return [(t.kind, t.text) for t in lexer.tokens(sql)[:-1]]


def test_lexer():
    assert kinds("a.\"B c\" -- x\n/* y */ 'it''s' 1.5e3 $1 ::int") == [("word", "a"), ("op", "."), ("name", "B c"), ("string", "it's"), ("number", "1.5e3"), ("param", "$1"), ("op", "::"), ("word", "int")]
    assert kinds("E'a\\n\\x41' U&'\\0041' $q$x'y$q$ 0x1F 1_0") == [("string", "a\nA"), ("string", "A"), ("string", "x'y"), ("number", "31"), ("number", "10")]
    assert kinds("a->>'b' <-> c !~* d") == [("word", "a"), ("op", "->>"), ("string", "b"), ("op", "<->"), ("word", "c"), ("op", "!~*"), ("word", "d")]


def test_statements_split_outside_strings():
    assert lexer.statements("select ';'; -- ;\nselect $$a;b$$;;") == ["select ';'", "-- ;\nselect $$a;b$$"]


@pytest.mark.parametrize(
    "text, sql",
    [
        ("1 day 02:30:00", "INTERVAL '1 02:30:00.000000' DAY TO SECOND"), ("3 months", "INTERVAL '3' MONTH"), ("1 year 2 mons", "INTERVAL '14' MONTH"), ("2 hours ago", "INTERVAL '-0 02:00:00.000000' DAY TO SECOND"),
        ("P1DT2H", "INTERVAL '1 02:00:00.000000' DAY TO SECOND"), ("1.5 days", "INTERVAL '1 12:00:00.000000' DAY TO SECOND"), ("1 mon 2 days", "make_interval(0, 1, 0, 2, 0, 0, 0.000000)"),
    ],
)
def test_intervals(text, sql):
    assert interval(f"'{text}'") == sql


def test_similar():
    assert similar("'a%b_'", "'\\\\'") == "'^(?:a.*b.)$'"


@pytest.fixture(scope="module")
def e(spark, sf):
    return Engine(spark).load(sf, ["orders", "nation", "region", "events"])


@pytest.mark.parametrize(
    "sql, rows",
    [
        ("select 7 / 2, 7 / 2.0, -7 / 2", [(3, 3.5, -3)]),
        ("select x from (values (3), (null), (1)) as t(x) order by x", [(1,), (3,), (None,)]),
        ("select x from (values (3), (null), (1)) as t(x) order by x desc", [(None,), (3,), (1,)]),
        ("select x from (values (3), (null), (1)) as t(x) order by x nulls first", [(None,), (1,), (3,)]),
        ("select distinct on (g) g, v from (values (1, 5), (1, 3), (2, 9)) as t(g, v) order by g, v", [(1, 3), (2, 9)]),
        ("select sum(v) over (order by v rows between unbounded preceding and unbounded following exclude current row) from (values (1), (2), (4)) as t(v) order by 1", [(3.0,), (5.0,), (6.0,)]),
        ("select string_agg(s, '-' order by s desc) from (values ('a'), ('c'), ('b')) as t(s)", [("c-b-a",)]),
        ("select (array[1, 2, 3])[2], (array[1, 2, 3])[0], '{4,5}'::int[]", [(2, None, [4, 5])]),
        ("select a.k, w, sum(w) over (partition by a.g order by b.k, a.k groups between 1 preceding and current row exclude current row) as s from (values (1, 'x'), (2, 'x'), (3, 'x')) as a(k, g) join (values (1, 10), (2, 20), (3, 30)) as b(k, w) on a.k = b.k order by a.k", [(1, 10, None), (2, 20, 10.0), (3, 30, 20.0)]),
        ("select 3 = any(array[1, 2]), 3 <> all(array[1, 2])", [(False, True)]),
        ("select 1 where 2 > all(select x from (values (1), (0)) as t(x))", [(1,)]),
        ("select 1 where 5 > all(select x from (values (1)) as t(x) where x > 9)", [(1,)]),
        ("with recursive t(n) as (select 1 union select (n + 1) % 4 from t) select count(*) from t", [(4,)]),
        ("select extract(dow from date '2024-01-07'), extract(epoch from timestamp '1970-01-02')", [(0, 86400.0)]),
        ("select 'x' || null, concat('x', null, 'y')", [(None, "xy")]),
        ("select date '2024-03-01' - date '2024-02-01', date '2024-02-28' + 2", [(29, __import__("datetime").date(2024, 3, 1))]),
        ("select count(*) filter (where x > 1) from (values (1), (2), (3)) as t(x)", [(2,)]),
        ("select a, b from (values (1, 2)) as t(a, b) where (a, b) = (1, 2)", [(1, 2)]),
        ("select g from generate_series(1, 3) as g", [(1,), (2,), (3,)]),
        ("(select 1) union all (select 2) order by 1 desc", [(2,), (1,)]),
        ("select case when true then 'a' end, nullif(1, 1), coalesce(null, 5)", [("a", None, 5)]),
    ],
)
def test_rewrites(e, sql, rows):
    assert [tuple(r) for r in e.query(sql).collect()] == rows


@pytest.mark.parametrize("bad", ["select from where", "select (1", "select 1 +", "selec 1", "select * from (select 1"])
def test_refuses(e, bad):
    with pytest.raises(Exception):  # noqa: B017  a syntax error or the engine's own
        e.sql(bad)


def test_output_names(e):
    assert e.query("select 1, upper('a'), n_name, count(*) over () as c, case when true then 1 end, 1 + 1 from nation").columns == ["?column?", "upper", "n_name", "c", "case", "?column?"]


def test_pruning_reaches_the_scan(e):
    plan = e.query("select o_orderstatus, count(*) from orders where o_custkey = 7 group by o_orderstatus")._jdf.queryExecution().toString()
    assert "EqualTo(o_custkey,7)" in plan and "ReadSchema: struct<o_custkey:bigint,o_orderstatus:string>" in plan


def test_correlated_subqueries_become_joins(e):
    plan = e.query("select n_name from nation n where exists (select 1 from region r where r.r_regionkey = n.n_regionkey)")._jdf.queryExecution().toString()
    assert "LeftSemi" in plan


def test_row_expressions():
    from decimal import Decimal

    import pytest

    from tidemark.plans.evaluate import Unsupported, evaluate

    for text, want in (
        ("7 / 2", 3), ("-7 / 2", -3), ("-7 % 3", -1), ("7 / 2.0", Decimal("3.5")), ("2 ^ 3 + 1", 9.0), ("1 + 2 * 3 = 7 and not false", True), ("null = 1 or true", True), ("null and false", False), ("null + 1", None), ("n between 1 and 5", True), ("n not in (1, 2)", True), ("n in (1, null)", None),
        ("case when n > 2 then 'big' else 'small' end", "big"), ("case n when 3 then 1 / 1 else 1 / 0 end", 1), ("'a' || n || 'b'", "a3b"), ("s like 'x_%' and s ilike 'XY%'", True), ("upper(substr(s, 2)) || repeat('-', 2)", "YZ--"), ("coalesce(null, n, 4)", 3), ("cast('12' as int) + '3'::int", 15), ("round(2.5)", 3), ("n is null", False), ("n is distinct from null", True), ("greatest(1, n, null)", 3), ("2.5::int", 3),
    ):
        assert evaluate(text, {"n": 3, "s": "xyz"}) == want, text
    for text in ("(select 1)", "now()", "n +"):
        with pytest.raises((Unsupported, IndexError)):
            evaluate(text, {"n": 3})


def test_range_joins_shuffle_on_buckets(spark, sf):
    from tidemark.engine import Engine

    e = Engine(spark).load(sf, ["orders", "customer"])
    sql = "select count(*) as n from orders o join customer c on o.o_totalprice between c.c_acctbal and c.c_acctbal + 30"
    plain = e.query(sql)
    e.sql("set nested_loop_rows = 10")
    banded = e.query(sql)
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" in text(plain) and "NestedLoop" not in text(banded) and "Cartesian" not in text(banded)
    assert plain.first() == banded.first()
    assert "NestedLoop" not in text(e.query("select o.*, c.c_custkey from orders o join customer c on o.o_custkey = c.c_custkey and o.o_totalprice > c.c_acctbal and o.o_totalprice < c.c_acctbal + 9"))


def test_correlated_limit_keeps_the_order_of_hidden_keys(e):
    text = lambda sql: e.query(sql)._jdf.queryExecution().optimizedPlan().toString()
    one = "select o_orderkey from orders o where o.o_custkey = n.k order by o_totalprice desc, o_orderkey limit 1"
    for sql in (f"select n.k, x.o_orderkey from (select distinct o_custkey as k from orders) as n cross join lateral ({one}) as x", f"select n.k, ({one}) as v from (select distinct o_custkey as k from orders) as n"):
        numbered = [line for line in text(sql).splitlines() if "row_number()" in line]
        assert not numbered or "DESC NULLS FIRST" in numbered[0], sql
    rows = e.query(f"select n.k, x.o_orderkey, (select max(o_totalprice) from orders o where o.o_custkey = n.k) as p from (select distinct o_custkey as k from orders) as n cross join lateral ({one}) as x").collect()
    prices = {r["o_orderkey"]: r["o_totalprice"] for r in e.query("select o_orderkey, o_totalprice from orders").collect()}
    assert rows and all(prices[r["o_orderkey"]] == r["p"] for r in rows)
    assert e.query("select x.* from (select distinct o_custkey as k from orders) as n cross join lateral (select distinct on (o_orderstatus) o_orderkey, o_orderstatus from orders o where o.o_custkey = n.k order by o_orderstatus, o_totalprice limit 1) as x").columns == ["o_orderkey", "o_orderstatus"]


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_lateral_aggregates_past_a_bound_compare_no_pairs(spark, op):
    rows = [(1, 2.5), (1, None), (None, 3.0), (1, 9.0), (2, 2.5), (1, 2.5), (7, 1.0)]
    e = Engine(spark)
    for t in "ab":
        e.sql(f"create table {t} as select * from (values {', '.join(str(r).replace('None', 'null') for r in rows)}) as t(k, v)")
    df = e.query(f"select x.*, a.k, a.v from a left join lateral (select count(*), sum(b.v) as t, min(b.v) as lo from b where b.k = a.k and b.v {op} a.v) as x(n) on true")
    test = {"<": float.__lt__, "<=": float.__le__, ">": float.__gt__, ">=": float.__ge__}[op]
    want = []
    for k, v in rows:
        met = [float(w) for j, w in rows if None not in (j, k, v, w) and j == k and test(float(w), float(v))]
        want.append((len(met), sum(met) if met else None, min(met, default=None), k, v))
    assert df.columns == ["n", "t", "lo", "k", "v"]
    assert sorted((tuple(None if x is None else float(x) for x in r) for r in df.collect()), key=repr) == sorted((tuple(None if x is None else float(x) for x in r) for r in want), key=repr)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_range_joins_of_many_pairs_are_dealt_to_tasks(spark, monkeypatch):
    from tidemark import engine

    monkeypatch.setattr(engine, "PAIRS_A_TASK", 20_000, raising=False)
    monkeypatch.setattr(engine, "POINTS_A_SHARE", 100, raising=False)
    e = Engine(spark)
    e.sql("set nested_loop_rows = 10; create table p as select id as k, case when id % 3 = 0 then null else id % 2 end as v from generate_series(1, 2000) as t(id); create table i as select id as j, id % 2 - 0.5::float8 as lo from generate_series(1, 200) as t(id)")
    df = e.query("select * from p join i on p.v >= i.lo and p.v < i.lo + 1.5 and p.k <> i.j")
    want = e.query("select count(*) from p, i where abs(v - lo - 0.75) <= 0.75 and v < lo + 1.5 and k <> j").first()[0]
    rows = df.collect()
    assert df.columns == ["k", "v", "j", "lo"] and len(rows) == len({(r["k"], r["j"]) for r in rows}) == want
    sizes = [n for n in df.rdd.glom().map(len).collect() if n]
    assert len(sizes) > 2 and max(sizes) < want / 2
