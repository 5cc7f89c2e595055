"""Privileges, options, names on a side, usage sets and listings at their edges."""

import pytest
from pyspark.sql import functions as F

from deltaloom.functions import macros
from deltaloom.operators import diff, edges, graph, navigation, tree
from deltaloom.plans.session import Session
from deltaloom.sources import repository


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_null_and_empty_privilege_lists(spark):
    told = spark.createDataFrame([(1, "o", None), (2, "o", "{}"), (3, None, None), (4, "o", "{=r/o}")], "k int, owner string, acl string")
    some = ["k", "grantee", "grantor", "priv", "with_grant"]
    assert rows(macros.grants(told, "acl", "k", owner="owner", own="rw*", public="U").select(*some)) == [(1, "o", "o", "r", False), (1, "o", "o", "w", True), (1, "public", "o", "U", False), (4, "public", "o", "r", False)]
    assert rows(macros.grants(told, "acl", "k", owner="owner", own="r").select(*some)) == [(1, "o", "o", "r", False), (4, "public", "o", "r", False)]
    assert rows(macros.grants(told, "acl", "k").select("k")) == [(4,)]


def test_options_and_values_with_commas(spark):
    told = spark.createDataFrame([('{a=b,"c=d,e",}',), ("{}",), ("a",), (None,)], "x string")
    got = told.select(macros.options(F.col("x")).alias("o")).collect()
    assert [None if r.o is None else [tuple(p) for p in r.o] for r in got] == [[("a", "b"), ("c", "d,e")], [], [("a", "")], None]
    assert spark.range(1).select(macros.key_values(F.lit('k=v=w,"p=q,r"'))).first()[0] == {"k": "v=w", "p": "q,r"}


def test_names_resolve_on_their_side_first(spark):
    objects = spark.createDataFrame([("a", "p", "build"), ("b", "p", "drop"), ("c", "q", "build"), ("p", None, "drop")], "fqn string, pqn string, side string")
    asked = spark.createDataFrame([(1, "p", "build"), (2, "q", "drop"), (3, "none", "build"), (4, "q", None), (5, None, "build")], "k int, to_qn string, side string")
    got = {r.k: r.to_fqn for r in graph.resolved_on_side(asked, objects).collect()}
    assert got == {1: "p", 2: "c", 3: None, 4: "c", 5: None}
    assert {r.k: r.to_fqn for r in graph.resolved_on_side(asked, objects.filter("fqn <> 'p'")).collect()}[1] == "a"


def test_usage_sets(spark):
    objects = spark.createDataFrame([("t", "o", "s", None, "x"), ("v", "o", "s", "said", None), ("n", None, "s", "said", None)], "fqn string, owner string, schema string, comment string, extension string")
    got = rows(edges.usage_sets(objects, comment="comment").filter("priority = 0").select("node", "applies", "to_fqn", "fallback", "condition"))
    superuser = "privilege.role.o.superuser"
    assert got == sorted([(n, a, f"grant.s.{r}:o", superuser, c) for n, a, r, c in (("t", "forwards", "create", None), ("t", "backwards", "usage", None), ("v", "forwards", "create", None), ("v", "backwards", "usage", None), ("v", "forwards", "usage", "v.comment"))], key=repr)
    assert edges.usage_sets(objects).count() == 12 and rows(edges.of_extensions(objects)) == [("t", "extension.x")]


def test_lists_hide_and_name_actions(spark):
    both = Session(spark).extract({"t": spark.range(1)}).extract({"t": spark.range(1).withColumn("x", F.lit(1))}).diff().result()
    acted = graph.build_actions(both)
    lines = lambda rows, **more: [r.line for r in Session(spark).push(rows).list(**more).result().collect()]
    assert lines(acted, hide=("none", "diffkids")) == ["    column=x|column.public.t.x|diff=new|action=build"]
    assert lines(both, grep="id$") == ["    column=id|column.public.t.id|diff=none"]


def test_contexts_but_the_usual_one_are_entered_and_left(spark):
    steps = spark.createDataFrame([(1, None), (2, "a"), (3, "a"), (4, "me"), (5, "b"), (6, "a")], "n int, owner string")
    moves = lambda **more: [(r.n, r.move, r.context_of) for r in navigation.context_moves(steps, "owner", ["n"], **more).orderBy("n", "move_no").collect()]
    assert moves(default="me") == [(2, "arrive", "a"), (4, "depart", "a"), (5, "arrive", "b"), (6, "depart", "b"), (6, "arrive", "a")]
    assert moves()[1:4] == [(4, "depart", "a"), (4, "arrive", "me"), (5, "depart", "me")]


def test_headers_of_comparisons(spark):
    one = spark.createDataFrame([("a", 1, "x")], "dbname string, time int, more string")
    other = spark.createDataFrame([("b", 2)], "dbname string, time int")
    assert diff.merged_header(other, one).first().asDict() == {"dbname": "a", "time": 1, "more": "x", "dbname2": "b", "time2": 2}
    assert diff.merged_header(other.limit(0), one).first().dbname2 is None
    with pytest.raises(Exception, match="several headers"):
        diff.merged_header(other.unionByName(other), one).collect()


def test_a_rule_that_rebuilds(spark):
    rule = diff.Rule(key=("k",), attributes=(diff.Attribute("v"),), elements={"e": diff.Rule(key=("n",))}, rebuild=True)
    schema = "k int, v int, e array<struct<n:int>>"
    old, new = (spark.createDataFrame(x, schema) for x in ([(1, 1, []), (2, 1, [(1,)]), (3, 1, [])], [(1, 2, []), (2, 1, [(2,)]), (3, 1, [])]))
    want = [(1, "rebuild"), (2, "rebuild"), (3, "none")]
    assert rows(diff.tree_statuses(old, new, rule)) == want
    assert rows(diff.deep_statuses(old, new, rule).filter("path = ''").select("k", "status")) == want
    node = "id string, parent string, type string, attrs map<string,string>"
    a, b = (spark.createDataFrame([("1", None, "t", {"k": "a", "v": v})], node) for v in "xy")
    assert [r.status for r in tree.statuses(a, b, {"t": diff.Rule(key=("k",), attributes=(diff.Attribute("v"),), rebuild=True)}).collect()] == ["rebuild"]


def test_snapshots_are_equal_whatever_the_order(spark):
    told = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, None)], "g int, v string")
    hashes = lambda d: {r.g: (r.rows, r.hash) for r in repository.snapshot_hashes(d, ["g"]).collect()}
    assert hashes(told) == hashes(told.orderBy(F.desc("v")).repartition(3))
    other = hashes(told.distinct().unionByName(told.filter("v = 'a'")))
    assert other[1] != hashes(told)[1] and other[2] == hashes(told)[2]
    assert hashes(told.withColumn("v", F.coalesce("v", F.lit(""))))[2] != hashes(told)[2]


def test_a_parent_that_is_there_twice_raises(spark):
    told = spark.createDataFrame([("a", None, 1), ("b", "a", 2), ("b", None, 3)], "fqn string, parent string, n int")
    assert {(r.n, r.parent_node and r.parent_node.n) for r in navigation.flattened(told).collect()} == {(1, None), (2, 1), (3, None)}
    with pytest.raises(Exception, match="several objects are called b"):
        navigation.flattened(told.unionByName(spark.createDataFrame([("c", "b", 4)], told.schema))).collect()
