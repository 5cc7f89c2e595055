"""Every catalogue query against its SQL, and the operators' own cases."""

from collections import Counter

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

import __spark_entry__ as entry
from deltaloom import queries as catalogue
from deltaloom.functions import macros, quoting, scalar
from deltaloom.operators import diff, graph, navigation, relational
from deltaloom.operators import edges as edge_rules
from deltaloom.plans.session import Session
from deltaloom.sources import repository

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, con, name):
    got = catalogue.QUERIES[name](spark, FOLDER)
    want = con.execute(catalogue.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*columns).collect())) == Counter(map(tuple, want.fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "pieces"),
    [("a,b", ["a", "b"]), ("a,,b", ["a", "", "b"]), ("a,b,", ["a", "b"]), (",a", ["", "a"]), ("a", ["a"])],
)
def test_split(spark, text, pieces):
    assert one(spark, scalar.split_list(F.lit(text), ",")) == pieces


def test_split_quoted(spark):
    assert one(spark, scalar.split_quoted(F.lit('a=b,"c=d,e",f'))) == ["a=b", '"c=d,e"', "f"]
    assert one(spark, scalar.split_quoted(F.lit(""))) == []


def test_versions_order(spark):
    v = lambda s: scalar.version(F.lit(s))
    assert [tuple(p) for p in one(spark, v("7.44.3a"))] == [(7, None), (44, None), (None, "3a")]
    numbers = lambda s: scalar.version_numbers(F.lit(s))
    assert one(spark, numbers("9.10") > numbers("9.9")) is True
    assert one(spark, numbers("9") < numbers("9.0")) is True


def test_logic(spark):
    null = F.lit(None).cast("string")
    assert one(spark, scalar.all_of(F.lit("a"), F.lit("b"))) == "b" and one(spark, scalar.all_of(null, F.lit("b"))) is None
    assert one(spark, scalar.same(null, null)) is False and one(spark, scalar.negated(null)) is True and one(spark, scalar.negated(F.lit(0))) is None
    assert one(spark, scalar.joined_text(F.lit("a"), null, F.lit(3))) == "a3" and one(spark, scalar.to_int(F.lit(" +7 "))) == 7


def test_quoting(spark):
    assert one(spark, quoting.quote_literal(F.lit("it's"))) == "'it''s'"
    assert one(spark, quoting.quote_qualified(F.lit(""), F.lit("a"))) == "a"
    assert one(spark, quoting.quote_qualified(F.lit("Sch"), F.lit("select"))) == '"Sch"."select"'
    assert one(spark, quoting.quote_identifier(F.lit('a"b'))) == '"a\\"b"'


def test_options(spark):
    got = one(spark, macros.options(F.lit('{a=b,"c=d,e=f"}')))
    assert [tuple(x) for x in got] == [("a", "b"), ("c", "d,e=f")]
    assert one(spark, macros.key_values(F.lit("a=b,c=d"))) == {"a": "b", "c": "d"}


def test_fail_attribute_raises(spark):
    a, b = (spark.createDataFrame([(1, v)], "k int, v int") for v in (1, 2))
    with pytest.raises(PySparkException, match="wrong version 1 2"):
        diff.statuses(a, b, diff.Rule(("k",), (diff.Attribute("v", fail="wrong version"),))).collect()


def test_diff_then_apply_gives_the_new_state(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(2, "y"), (3, "z"), (4, None)], "k int, v string")
    rule = diff.Rule(("k",), (diff.Attribute("v"),))
    for old, new in ((a, b), (b, a)):
        assert sorted(diff.applied(old, new, rule).collect()) == sorted(new.collect())
        assert {tuple(r) for r in diff.swapped(diff.statuses(old, new, rule)).collect()} == {tuple(r) for r in diff.statuses(new, old, rule).collect()}
    assert {r.status for r in diff.statuses(a, a, rule).collect()} == {"none"}


def test_levels_put_every_need_first(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (5, 6)], "source int, target int")
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "node int")
    assert {tuple(r) for r in graph.levels(nodes, edges).collect()} == {(1, 0), (2, 1), (3, 2), (7, 0), (4, None), (5, None), (6, None)}
    assert {r.node for r in graph.on_cycles(edges).collect()} == {4, 5}


def test_unmet_dependency_without_fallback_raises(spark):
    sets = spark.createDataFrame([(1, None)], "depset_id int, fallback string")
    with pytest.raises(PySparkException, match="no candidate"):
        graph.fallbacks(sets, sets.limit(0)).collect()


def test_lookup_raises_on_a_repeated_key(spark):
    table = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (None, "d")], "k int, v string")
    rows = spark.createDataFrame([(1,)], "q int")
    with pytest.raises(PySparkException, match="not unique"):
        relational.unique_lookup(rows, table, F.col("q") == F.col("k"), "k").collect()


def test_common_path(spark):
    a = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, navigation.common_path(a("a", "b", "c"), a("a", "b", "d"))) == 2
    assert one(spark, navigation.common_path(a("a", "b"), a("a", "b", "d"))) == 2
    assert one(spark, navigation.common_path(a("x"), a("a"))) == 0


def test_session_keeps_its_stack(spark):
    session = Session(spark)
    with pytest.raises(ValueError, match="empty"):
        session.pop()
    table = spark.range(1)
    session.extract({"t": table}).extract({"t": table})
    with pytest.raises(ValueError, match="left on the stack"):
        session.result()
    lines = [r.line for r in Session(spark).extract({"t": table}).list().result().collect()]
    assert sorted(lines) == sorted(["schema=public|schema.public", "  table=t|table.public.t", "    column=id|column.public.t.id"])
    same = Session(spark).extract({"t": table}).extract({"t": table}).diff().result()
    assert {r.status for r in same.collect()} == {"none"}


def test_walks_end_with_an_error_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "source int, target int")
    seeds = spark.createDataFrame([(1,)], "node int")
    assert sorted(tuple(r) for r in graph.walks(edges, seeds).collect()) == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 3, 2)]
    with pytest.raises(ValueError, match="more than 5"):
        graph.walks(edges.unionByName(spark.createDataFrame([(3, 1)], edges.schema)), seeds, most_rounds=5)


def test_resolution_raises_on_repeated_and_required_names(spark):
    edges = spark.createDataFrame([("a", "x"), ("b", "gone")], "from_fqn string, to_qn string")
    objects = spark.createDataFrame([("x", "p"), ("y", "gone"), ("z", "gone")], "fqn string, pqn string")
    assert {(r.from_fqn, r.to_fqn) for r in graph.resolved(edges, objects).collect()} == {("a", "x"), ("b", "y")}
    with pytest.raises(PySparkException, match="several objects"):
        graph.resolved(edges, objects.unionByName(objects)).collect()
    with pytest.raises(PySparkException, match="nothing is called gone"):
        graph.resolved(edges, objects.filter("fqn = 'x'"), F.lit(True)).collect()


def test_hash_of_columns_keeps_them_apart(spark):
    rows = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("", None), (None, "")], "x string, y string")
    assert rows.select(repository.content_hash(["x", "y"])).distinct().count() == 4


def test_empty_pieces_stay(spark):
    assert one(spark, scalar.split_quoted(F.lit(',a,"b,c",,'))) == ["", "a", '"b,c"', "", ""]


def test_listing_by_pattern(spark, tmp_path):
    for name in ("a.xml", "sub/b.xml", "sub/c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    assert {r.path.rsplit("/", 1)[-1] for r in repository.listing(spark, str(tmp_path), "*.xml").collect()} == {"a.xml", "b.xml"}


def test_an_unknown_side_raises(spark):
    rows = spark.createDataFrame([(1, 2, "up", None)], "node int, target int, applies string, direction string")
    with pytest.raises(PySparkException, match="no side: up"):
        edge_rules.sided(rows).collect()


def test_cycles_of_several_kinds(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 6), (6, 5), (7, 7), (7, 8), (8, 1), (9, 1), (6, 10), (2, 1)]
    edges = spark.createDataFrame(pairs, "source int, target int")
    assert {tuple(r) for r in graph.cycles(edges).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (7, 7)}
    assert graph.cycles(edges.limit(0)).collect() == []
    assert graph.cycles(edges.filter("source = 4")).collect() == []


def test_a_cycle_that_nothing_breaks_raises(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "node string, target string")
    options = spark.createDataFrame([], "depset_id long, node string, target string, priority int")
    breakers = spark.createDataFrame([], "node string, breaker string")
    with pytest.raises(ValueError, match="cycle of a, b"):
        graph.without_cycles(edges, options, breakers)


def test_elements_told_twice_raise(spark):
    rule = diff.Rule(("k",), elements={"e": diff.Rule(("n",), (diff.Attribute("v"),))})
    schema = "k int, e array<struct<n:int,v:int>>"
    once, twice = spark.createDataFrame([(1, [(1, 1)]), (2, None)], schema), spark.createDataFrame([(1, [(1, 1), (1, 2)])], schema)
    assert {tuple(r) for r in diff.tree_statuses(once, once, rule).collect()} == {(1, "none"), (2, "none")}
    with pytest.raises(PySparkException, match="repeated element in e: 1 1"):
        diff.element_statuses(once, twice, rule, "e").collect()


def test_rules_and_templates_are_checked():
    rule = diff.Rule(("k",))
    with pytest.raises(ValueError, match="two rules for a"):
        diff.rules_of([("a", rule), ("a", rule)])
    with pytest.raises(ValueError, match="no key"):
        diff.rules_of([("a", diff.Rule(()))])
    for wrong in ("{old.x", "x}", "{x}", "{eval.x}"):
        with pytest.raises(ValueError):
            diff.filled(wrong)


def test_generate_orders_by_dependencies_and_writes_statements(spark):
    tables = {"a": spark.range(1), "b": spark.range(1)}
    edges = spark.createDataFrame([("table.public.a", "column.public.b.id")], "node string, target string")
    made = Session(spark).extract({}).extract(tables).diff().generate(edges).result().orderBy("seq").collect()
    assert [r.text for r in made] == ["create table public.b ();", "alter table public.b add column id bigint not null;", "create table public.a ();", "alter table public.a add column id bigint not null;"]
    gone = Session(spark).extract(tables).extract({}).diff().generate(edges).result().orderBy("seq").collect()
    assert [r.text for r in gone] == ["alter table public.a drop column id;", "drop table public.a;", "alter table public.b drop column id;", "drop table public.b;"]


def test_moves_spare_dropped_and_built_nodes(spark):
    steps = spark.createDataFrame([(1, ["a", "b"], "drop"), (2, ["a", "c"], "build"), (3, ["a"], None)], "n int, path array<string>, action string")
    got = [(r.n, r.move, r["at"]) for r in navigation.moves(steps, "path", ["n"], action="action").orderBy("n", "move_no").collect()]
    assert got == [(1, "arrive", "a"), (1, "arrive", "b"), (3, "depart", "c")]


def test_fallback_of_both_sides_builds_after_its_drop_ends(spark):
    unmet = spark.createDataFrame([("x", "role.f", "drop"), ("y", "role.f", "build"), ("z", None, "build"), ("y", "role.f", "build")], "node string, fallback string, side string")
    got = sorted(map(tuple, graph.fallback_edges(unmet).collect()))
    assert got == sorted([("x", "fallback.drop.role.f"), ("endfallback.drop.role.f", "x"), ("y", "fallback.build.role.f"), ("endfallback.build.role.f", "y"), ("fallback.build.role.f", "endfallback.drop.role.f")])


def test_objects_without_prints_are_disabled(spark):
    objects = spark.createDataFrame([("a",), ("b",), ("c",)], "fqn string")
    prints = spark.createDataFrame([("a", None), ("a", "x"), ("b", "x")], "fqn string, condition string")
    assert {r.fqn: r.disabled for r in navigation.without_prints(objects, prints).collect()} == {"a": False, "b": True, "c": True}
