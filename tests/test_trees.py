"""Trees matched level by level, rebuilds that spread, whole objects, folders that are synced."""

import datetime

import pytest
from pyspark.sql import functions as F

from deltaloom.operators import diff, relational, tree
from deltaloom.sources import repository

NODE = "id string, parent string, type string, attrs map<string,string>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def nodes(spark, *told):
    return spark.createDataFrame(list(told), NODE)


def chain(letter, depth, names, **last):
    """A chain of ``depth`` nodes called by ``names``; the deepest has the attributes ``last``."""
    return [(f"{letter}{i}", f"{letter}{i - 1}" if i else None, "t", {"name": names[i], **(last if i == depth - 1 else {})}) for i in range(depth)]


RULES = {"t": diff.Rule(key=("name",), attributes=(diff.Attribute("v"), diff.Attribute("w", rebuild=True), diff.Attribute("x", fail="x has changed:")))}


def test_a_change_at_depth_ten_marks_all_above(spark):
    names = [f"n{i}" for i in range(10)]
    got = dict(rows(tree.statuses(nodes(spark, *chain("a", 10, names, v="1")), nodes(spark, *chain("b", 10, names, v="2")), RULES).select("node", "status")))
    assert got == {**{f"new:b{i}": "diffkids" for i in range(9)}, "new:b9": "diff"}


def test_what_is_below_a_renamed_node_is_gone_and_new(spark):
    names = [f"n{i}" for i in range(6)]
    out = tree.statuses(nodes(spark, *chain("a", 6, names)), nodes(spark, *chain("b", 6, [*names[:3], "other", *names[4:]])), RULES)
    got = {r.node: (r.parent, r.status) for r in out.collect()}
    assert got["new:b2"] == ("new:b1", "diffkids") and got["new:b3"] == ("new:b2", "new") and got["new:b5"] == ("new:b4", "new")
    assert got["old:a3"] == ("new:b2", "gone") and got["old:a5"] == ("old:a4", "gone")
    gone = tree.statuses(nodes(spark, *chain("a", 3, names)), nodes(spark, *chain("b", 2, names)), RULES)
    assert {r.status for r in gone.collect()} == {"none", "gone"}
    strict = tree.statuses(nodes(spark, *chain("a", 3, names)), nodes(spark, *chain("b", 2, names)), RULES, strict=True)
    assert dict(rows(strict.select("node", "status"))) == {"new:b0": "diffkids", "new:b1": "diffkids", "old:a2": "gone"}


def test_a_moved_subtree_matches_nothing(spark):
    told = lambda under: nodes(spark, ("r", None, "t", {"name": "r"}), ("p", "r", "t", {"name": "p"}), ("q", "r", "t", {"name": "q"}), ("m", under, "t", {"name": "m"}), ("l", "m", "t", {"name": "l"}))
    got = dict(rows(tree.statuses(told("p"), told("q"), RULES).select("node", "status")))
    assert got == {"new:r": "diffkids", "new:p": "none", "new:q": "diffkids", "new:m": "new", "new:l": "new", "old:m": "gone", "old:l": "gone"}


def test_status_of_types_and_attributes(spark):
    one = lambda kind, **attrs: nodes(spark, ("1", None, kind, attrs))
    status = lambda a, b: [r.status for r in tree.statuses(a, b, RULES).collect()]
    assert status(one("t", name="a", v="1"), one("t", name="a")) == ["diff"]
    assert status(one("t", name="a", w="1"), one("t", name="a", w="2", v="3")) == ["rebuild"]
    assert status(one("u", fqn="a", v="1"), one("u", fqn="a", v="2")) == ["UNKNOWN"]
    assert sorted(status(one("t", name="a"), one("u", fqn="a"))) == ["gone", "new"]
    with pytest.raises(Exception, match="x has changed: 1 <null>"):
        status(one("t", name="a", x="1"), one("t", name="a"))
    with pytest.raises(Exception, match="no key name"):
        status(one("t", v="1"), one("t", name="a"))
    with pytest.raises(ValueError, match="several siblings"):
        status(nodes(spark, ("1", None, "t", {"name": "a"}), ("2", None, "t", {"name": "a"})), one("t", name="a"))
    assert status(one("t", name="a").limit(0), one("t", name="a").limit(0)) == []


def test_rebuilds_spread_and_mark_parents(spark):
    # A chain of ten needs that ends in a cycle; z follows the last; each lies under a parent of its own.
    told = [(f"n{i}", f"p{i}", "rebuild" if i == 0 else "new" if i == 4 else "none", None) for i in range(10)]
    told += [(f"p{i}", "top" if i % 2 else "mid", "none", None) for i in range(10)] + [("top", None, "none", None), ("mid", "far", "diff", None), ("far", None, "none", None), ("z", "far", "none", "n9"), ("soft", "far", "none", None)]
    needs = [(f"n{i + 1}", f"n{i}", None) for i in range(9)] + [("n7", "n9", False), ("soft", "n0", True)]
    got = dict(rows(tree.promoted(spark.createDataFrame(told, "node string, parent string, status string, follow string"), spark.createDataFrame(needs, "node string, target string, soft boolean")).select("node", "status")))
    assert {k: v for k, v in got.items() if k[0] == "n"} == {f"n{i}": "new" if i == 4 else "rebuild" for i in range(10)}
    assert {k: v for k, v in got.items() if k[0] == "p"} == {f"p{i}": "none" if i in (0, 4) else "diffkids" for i in range(10)}
    assert (got["top"], got["mid"], got["far"], got["z"], got["soft"]) == ("diffkids", "diff", "diffkids", "rebuild", "none")


FULL = NODE + ", place int, text string"


def hashed(spark, *told):
    return {r.id: (r.hash, r.size) for r in tree.hashes(spark.createDataFrame(list(told), FULL)).collect()}


def test_subtree_hashes(spark):
    def told(p, a="1", places=(1, 2, 3), text=None, deep="d"):
        return [(f"{p}r", None, "x", {"a": a, "b": "2"}, 0, text), *((f"{p}{i}", f"{p}r", "y", {"i": str(i)}, n, None) for i, n in enumerate(places)), (f"{p}d", f"{p}1", "z", {}, 5, deep)]

    got = hashed(spark, *told("a"), *told("b", places=(10, 20, 30), text=" \n"), *told("c", places=(2, 1, 3)), *told("d", a="2"), *told("e", deep="e"), *told("f", text="said"))
    assert got["ar"] == got["br"] and got["ar"][1] == 5
    assert len({got[f"{p}r"][0] for p in "acdef"}) == 5
    assert got["a0"][0] == got["c0"][0] and got["a1"][0] != got["e1"][0]
    one, other = (hashed(spark, ("r", None, "x", m, 0, None))["r"] for m in ({"a": "1", "b": "2"}, {"b": "2", "a": "1"}))
    assert one == other and hashed(spark) == {}
    # A child differs from an attribute or a text that reads the same.
    assert len({hashed(spark, ("r", None, "x", m, 0, t))["r"][0] for m, t in (({"a": "1"}, None), ({}, "a1"), ({"a": ""}, "1"), (None, None))}) == 4
    with pytest.raises(ValueError, match="circle"):
        hashed(spark, ("a", "b", "x", {}, 0, None), ("b", "a", "x", {}, 0, None))


def test_one_parent_of_many_children(spark):
    many = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("id"), F.lit("r").alias("parent"), F.lit("y").alias("type"), F.create_map(F.lit("i"), F.col("id").cast("string")).alias("attrs"), F.col("id").cast("int").alias("place"), F.lit(None).cast("string").alias("text"))
    root = spark.createDataFrame([("r", None, "x", {}, 0, None)], FULL)
    back = many.withColumn("place", -F.col("place"))
    shifted = many.withColumn("place", F.col("place") * 3 + 7)
    a, b, c = (tree.hashes(root.unionByName(d)).filter("id = 'r'").first() for d in (many, back, shifted))
    assert a.size == 3001 and a.hash == c.hash != b.hash


def test_ranks_over_ranges(spark):
    got = relational.ranked(spark.range(500).select((F.col("id") * 7919 % 500).alias("x")).repartition(5), [F.desc("x")])
    assert rows(got) == sorted(((499 - i, i) for i in range(500)), key=repr)


# --- elements and folders


def test_the_first_of_repeated_old_elements_meets_the_new_one(spark):
    rule = diff.Rule(key=("k",), elements={"e": diff.Rule(key=("n",), attributes=(diff.Attribute("v"),))})
    schema = "k int, e array<struct<n:int,v:int>>"
    got = rows(diff.element_statuses(spark.createDataFrame([(1, [(1, 1), (1, 2), (2, 5)])], schema), spark.createDataFrame([(1, [(1, 1), (3, 0)])], schema), rule, "e"))
    assert got == [(1, 1, "gone"), (1, 1, "none"), (1, 2, "gone"), (1, 3, "new")]


def test_synced_folders_keep_names_types_and_columns(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    schema = "v int, m map<string,string>, folder string"
    told = [(1, {"a": "1", "b": "2"}, "001"), (2, None, "002"), (3, {}, None), (4, {}, "a=b/c d"), (5, {}, "")]
    frame = spark.createDataFrame(told, schema)
    names = [("001", "NEW"), ("002", "NEW"), ("a=b/c d", "NEW"), (None, "NEW")]
    assert rows(repository.sync(frame, path, "folder", check_only=True)) == sorted(names, key=repr)
    assert rows(repository.sync(frame, path, "folder")) == sorted(names, key=repr)
    assert {s for _, s in rows(repository.sync(frame, path, "folder"))} == {"UNCHANGED"}
    back = repository.gather(spark, path, frame.schema)
    assert sorted((r.v, r.folder) for r in back.collect() if r.folder) == [(1, "001"), (2, "002"), (4, "a=b/c d")]
    # Two null folders' rows, one of them from an empty text; then one row goes and a folder with it.
    assert rows(repository.sync(frame.filter("v <> 2 and v <> 5"), path, "folder")) == sorted([("001", "UNCHANGED"), ("002", "OLD"), ("a=b/c d", "UNCHANGED"), (None, "MODIFIED")], key=repr)
    wider = frame.filter("v in (1, 4)").withColumn("more", F.when(F.col("v") == 1, "x"))
    assert rows(repository.sync(wider, path, "folder")) == sorted([("001", "MODIFIED"), ("a=b/c d", "MODIFIED"), (None, "OLD")], key=repr)
    assert {s for _, s in rows(repository.sync(wider, path, "folder"))} == {"UNCHANGED"}
    assert sorted((r.v, r.more) for r in repository.gather(spark, path, wider.schema).collect()) == [(1, "x"), (4, None)]
    assert {s for _, s in rows(repository.sync(frame.filter("v in (1, 4)"), path, "folder"))} == {"MODIFIED"}
    assert "more" not in repository.gather(spark, path).columns
    longer = frame.filter("v = 1").withColumn("v", F.col("v").cast("long"))
    assert rows(repository.sync(longer, path, "folder")) == [("001", "MODIFIED"), ("a=b/c d", "OLD")]


def test_folders_of_dates_and_numbers(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    frame = spark.createDataFrame([(1, datetime.date(2020, 1, 2)), (2, None)], "v int, folder date")
    repository.sync(frame, path, "folder")
    assert {s for _, s in rows(repository.sync(frame, path, "folder"))} == {"UNCHANGED"}
    assert rows(repository.gather(spark, path, frame.schema)) == rows(frame)


def test_elements_within_elements(spark):
    rule = diff.Rule(key=("k",), attributes=(diff.Attribute("v"),), elements={"a": diff.Rule(key=("n",), elements={"b": diff.Rule(key=("m",), attributes=(diff.Attribute("w"),))}), "z": diff.Rule(key=("y",))})
    schema = "k int, v int, a array<struct<n:int,b:array<struct<m:int,w:int>>>>, z array<struct<y:int>>"
    old = [(1, 1, [(1, [(1, 1), (2, 2)]), (2, [(1, 1)]), (1, [(9, 9)])], [(1,)]), (2, 1, [(1, [(1, 1)])], None), (3, 1, [(1, [])], [])]
    new = [(1, 1, [(1, [(1, 1), (2, 3)]), (2, [(1, 1)])], [(1,)]), (3, 1, [(1, [])], []), (4, 1, [(5, [(6, 7)])], [])]
    got = rows(diff.deep_statuses(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), rule))
    assert got == sorted(
        [
            *[(1, "", [], "diff"), (1, "a", ["1"], "diff"), (1, "a", ["1"], "gone"), (1, "a", ["2"], "none"), (1, "z", ["1"], "none")],
            *[(1, "a.b", ["1", "1"], "none"), (1, "a.b", ["1", "2"], "diff"), (1, "a.b", ["1", "9"], "gone"), (1, "a.b", ["2", "1"], "none")],
            *[(2, "", [], "gone"), (2, "a", ["1"], "gone"), (2, "a.b", ["1", "1"], "gone"), (3, "", [], "none"), (3, "a", ["1"], "none")],
            *[(4, "", [], "new"), (4, "a", ["5"], "new"), (4, "a.b", ["5", "6"], "new")],
        ],
        key=repr,
    )
