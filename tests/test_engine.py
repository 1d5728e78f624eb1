"""Statements and rules of the engine, by hand-written results."""

import json

import pytest

from tidemark.engine import Engine, SqlError


@pytest.fixture
def e(spark):
    return Engine(spark)


def rows(e, sql):
    return sorted(e.sql(sql).rows(), key=repr)


def test_defaults_serial_and_returning(e):
    e.sql("create table t (id serial primary key, v int default 7, s text not null)")
    assert rows(e, "insert into t (s) values ('a'), ('b') returning id, v") == [(1, 7), (2, 7)]
    assert e.sql("insert into t (id, v, s) values (9, default, 'c')").tag == "INSERT 0 1"


@pytest.mark.parametrize(
    "bad, what",
    [
        ("insert into t values (1, 1, 'x')", "duplicate key"),
        ("insert into t values (5, 1, null)", "not-null"),
        ("insert into t values (6, -1, 'x')", "check"),
        ("insert into t (nope) values (1)", "nope"),
        ("select * from missing", "does not exist"),
    ],
)
def test_constraints(e, bad, what):
    e.sql("create table t (id int primary key, v int check (v > 0), s text not null); insert into t values (1, 1, 'a')")
    with pytest.raises(SqlError, match=what):
        e.sql(bad)
    assert rows(e, "select id from t") == [(1,)]


def test_foreign_keys(e):
    e.sql("create table p (k int primary key); create table c (k int references p (k) on delete cascade, n int); insert into p values (1), (2); insert into c values (1, 10), (2, 20)")
    with pytest.raises(SqlError, match="foreign key"):
        e.sql("insert into c values (3, 30)")
    e.sql("delete from p where k = 1")
    assert rows(e, "select n from c") == [(20,)]


def test_foreign_key_restrict(e):
    e.sql("create table p (k int primary key); create table c (k int references p (k)); insert into p values (1); insert into c values (1)")
    with pytest.raises(SqlError):
        e.sql("delete from p")
    assert rows(e, "select k from p") == [(1,)]


def test_merge_with_returning(e):
    e.sql("create table t (k int, v int); insert into t values (1, 10), (2, 20), (3, 30)")
    got = rows(e, "merge into t using (values (1, 5), (2, 0), (9, 9)) as s(k, d) on t.k = s.k when matched and s.d = 0 then delete when matched then update set v = t.v + s.d when not matched then insert values (s.k, s.d) returning merge_action, k, v")
    assert got == [("delete", 2, 20), ("insert", 9, 9), ("update", 1, 15)]
    assert rows(e, "select k, v from t") == [(1, 15), (3, 30), (9, 9)]


def test_merge_twice_fails(e):
    e.sql("create table t (k int, v int); insert into t values (1, 10)")
    with pytest.raises(Exception, match="second time"):
        e.sql("merge into t using (values (1, 1), (1, 2)) as s(k, d) on t.k = s.k when matched then update set v = s.d")


def test_on_conflict_excluded(e):
    e.sql("create table t (k int primary key, n int); insert into t values (1, 1), (2, 2)")
    assert rows(e, "insert into t values (1, 10), (3, 3) on conflict (k) do update set n = t.n + excluded.n where t.n < 5 returning k, n") == [(1, 11), (3, 3)]
    with pytest.raises(SqlError, match="ON CONFLICT"):
        e.sql("insert into t values (1, 1) on conflict (n) do nothing")


def test_transactions(e):
    e.sql("create table t (k int); insert into t values (1); begin; insert into t values (2); savepoint a; delete from t; rollback to a; commit")
    assert rows(e, "select k from t") == [(1,), (2,)]
    e.sql("begin; drop table t; rollback")
    assert rows(e, "select count(*) from t") == [(2,)]


def test_update_with_subquery(e):
    e.sql("create table t (k int, v int); insert into t values (1, 0), (2, 0); update t set v = (select max(k) from t) where k in (select min(k) from t)")
    assert rows(e, "select k, v from t") == [(1, 2), (2, 0)]


def test_views_and_drops(e):
    e.sql("create table t (k int); create view v as select k from t; insert into t values (4)")
    assert rows(e, "select * from v") == [(4,)]
    with pytest.raises(SqlError, match="depend"):
        e.sql("drop table t")
    e.sql("drop table t cascade")
    with pytest.raises(SqlError):
        e.sql("select * from v")


def test_sequences(e):
    e.sql("create sequence s increment by -2 maxvalue 10 start 10")
    assert [e.sql("select nextval('s')").rows()[0][0] for _ in range(3)] == [10, 8, 6]


def test_enum_and_domain(e):
    e.sql("create type mood as enum ('a', 'b'); create domain small as int check (value < 5); create table t (m mood, s small)")
    e.sql("insert into t values ('a', 1)")
    for bad in ("('z', 1)", "('a', 9)"):
        with pytest.raises(SqlError):
            e.sql(f"insert into t values {bad}")


def test_row_level_security(e):
    e.sql("create table t (o text, v int); insert into t values ('x', 1), ('y', 2); alter table t enable row level security; create policy p on t using (o = 'x'); set role bob")
    assert rows(e, "select v from t") == [(1,)]
    with pytest.raises(SqlError, match="policy"):
        e.sql("insert into t values ('y', 3)")
    e.sql("reset role")
    assert len(rows(e, "select v from t")) == 2


def test_json_arrow_and_state(e, spark):
    e.sql("create table t (k int, s text); insert into t values (1, 'a')")
    assert json.loads(e.json("select * from t"))["rows"] == [{"k": 1, "s": "a"}]
    assert not json.loads(e.json("select * from nope"))["ok"]
    assert e.arrow("select k from t").num_rows == 1
    other = Engine(spark)
    other.import_state(e.export_state())
    assert rows(other, "select * from t") == [(1, "a")]


def test_parameters(e):
    assert e.query("select $1 + 1 as a, $2 || 'x' as b", 4, "y'z").first() == (5, "y'zx")


def test_explain_shows_pushdown(e, sf):
    e.load(sf, ["lineitem"])
    plan = "\n".join(r[0] for r in e.sql("explain select l_orderkey from lineitem where l_quantity > 40").rows())
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


@pytest.mark.parametrize("metric, first", [("<->", 0), ("<=>", 0), ("<#>", 0)])
def test_similarity_search(e, sf, metric, first):
    e.load(sf, ["embeddings"])
    v = e.query("select embedding from embeddings where vec_id = 0").first()[0]
    assert e.similarity_search("embeddings", "embedding", v, 3, metric).first()["vec_id"] == first


def test_do_block(e):
    e.sql("create table t (k int)")
    e.sql("do $$ declare i int := 0; begin while i < 3 loop insert into t values (i); i := i + 1; end loop; if i = 3 then insert into t values (100); else insert into t values (200); end if; for r in 5..6 loop insert into t values (r); end loop; end $$")
    assert rows(e, "select k from t") == sorted([(0,), (1,), (2,), (100,), (5,), (6,)], key=repr)


def test_plpgsql_function(e):
    e.sql("create function grade(x int) returns text language plpgsql as $$ begin if x > 8 then return 'high'; elsif x > 4 then return 'mid'; end if; return 'low'; end $$")
    assert [e.sql(f"select grade({x})").rows()[0][0] for x in (9, 5, 1)] == ["high", "mid", "low"]


def test_before_trigger_changes_rows(e):
    e.sql("create table t (k int, s text, n int)")
    e.sql("create function tidy() returns trigger language plpgsql as $$ begin new.s := upper(new.s); if new.n is null then new.n := 0; elsif new.n > 100 then return null; end if; return new; end $$")
    e.sql("create trigger tr before insert or update on t for each row execute function tidy()")
    e.sql("insert into t values (1, 'a', null), (2, 'b', 500), (3, 'c', 7)")
    assert rows(e, "select * from t") == [(1, "A", 0), (3, "C", 7)]
    e.sql("update t set s = 'zz' where k = 3")
    assert rows(e, "select s from t where k = 3") == [("ZZ",)]


def test_after_trigger_writes_a_log(e):
    e.sql("create table t (k int); create table log (op text, k int)")
    e.sql("create function note() returns trigger language plpgsql as $$ begin if tg_op = 'DELETE' then insert into log values (tg_op, old.k); else insert into log values (tg_op, new.k); end if; return null; end $$")
    e.sql("create trigger tr after insert or delete on t for each row execute function note()")
    e.sql("insert into t values (1), (2); delete from t where k = 1")
    assert rows(e, "select op, k from log") == [("DELETE", 1), ("INSERT", 1), ("INSERT", 2)]


def test_after_trigger_on_insert(e):
    e.sql("create table t (k int); create table log (op text, k int)")
    e.sql("create function note() returns trigger language plpgsql as $$ begin insert into log values (tg_op, new.k * 10); return null; end $$")
    e.sql("create trigger tr after insert on t for each row execute function note(); insert into t values (1), (2)")
    assert rows(e, "select op, k from log") == [("INSERT", 10), ("INSERT", 20)]


def test_foreign_table(e, spark):
    from tidemark.sources import foreign

    foreign.register(spark)
    e.sql("create server s foreign data wrapper tidemark_series options (partitions '3'); create foreign table f (id bigint, label text) server s options (rows '7')")
    assert rows(e, "select count(*), max(label) from f") == [(7, "row-6")]


def test_search_columns(e):
    e.sql("create table tree (k int, parent int); insert into tree values (1, null), (2, 1), (3, 1), (4, 2)")
    q = "with recursive t(k) as (select k from tree where parent is null union all select tree.k from tree join t on tree.parent = t.k) search {} first by k set o select k from t order by o"
    assert [r[0] for r in e.query(q.format("depth")).collect()] == [1, 2, 4, 3]
    assert [r[0] for r in e.query(q.format("breadth")).collect()] == [1, 2, 3, 4]


def test_client_helpers(e, tmp_path):
    (tmp_path / "x.json").write_text('[{"a": 1}, {"a": 2}]')
    e.load_url("j", f"file://{tmp_path}/x.json")
    assert rows(e, "select sum(a) from j") == [(3,)]
    assert [r.table_name for r in e.list_tables().collect()] == ["j"] and e.describe_table("j").first().column_name == "a"
    e.reset()
    assert e.list_tables().count() == 0


def test_update_from_several_relations(e):
    e.sql("create table t (k int, v int); create table a (k int, b int); create table b (id int, w int); insert into t values (1, 0), (2, 0); insert into a values (1, 7), (2, 8); insert into b values (7, 70), (9, 90)")
    assert rows(e, "update t set v = b.w from a, b where t.k = a.k and a.b = b.id returning t.k, t.v") == [(1, 70)]
    assert rows(e, "delete from t using a join b on a.b = b.id where t.k = a.k returning k") == [(1,)]


def test_statements_rewrite_only_files_that_hold_hits(spark):
    e = Engine(spark)
    e.sql("create table t (k bigint, v bigint)")
    for a in (0, 100, 200):
        e.sql(f"insert into t select i, i from generate_series({a}, {a + 9}) as g(i)")

    def kept(sql):
        before = {f for f in e.rows("t").inputFiles()}
        e.sql(sql)
        return len(before & set(e.rows("t").inputFiles())) / len(before)

    assert kept("update t set v = v + 1 where k = 105") >= 2 / 3
    assert kept("delete from t where k = 3") > 0
    assert kept("update t set v = s.x from (select 204 as k, 7 as x) as s where t.k = s.k") > 0
    assert kept("merge into t using (select 5 as k union all select 900) as s on t.k = s.k when matched then update set v = 0 when not matched then insert (k, v) values (s.k, 1)") > 0
    assert kept("merge into t using (select 6 as k) as s on t.k = s.k when matched then delete") > 0
    want = {i: i for a in (0, 100, 200) for i in range(a, a + 10)} | {105: 106, 204: 7, 5: 0, 900: 1}
    assert dict(map(tuple, e.query("select k, v from t").collect())) == {k: v for k, v in want.items() if k not in (3, 6)}


def test_vacuum_deletes_old_versions_only(spark):
    import os

    e = Engine(spark)
    e.sql("create table t (k bigint, v bigint)")
    for a in (0, 100, 200):
        e.sql(f"insert into t select i, i from generate_series({a}, {a + 9}) as g(i)")
    e.sql("update t set v = -1 where k = 105; delete from t where k = 3; update t set v = 7 where k = 204")
    want = sorted(map(tuple, e.query("select k, v from t").collect()))
    before = set(e.written)
    e.sql("vacuum")
    assert sorted(map(tuple, e.query("select k, v from t").collect())) == want
    gone = before - e.written
    assert gone and not any(os.path.exists(p.removeprefix("file://")) for p in gone)
    e.sql("begin")
    with pytest.raises(SqlError, match="transaction"):
        e.sql("vacuum")
