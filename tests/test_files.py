"""XML documents, printed files, values of mixed kinds and the session's commands that write."""

import itertools

import pytest
from pyspark.sql import functions as F

from deltaloom.functions import scalar
from deltaloom.operators import tree
from deltaloom.plans.session import Session
from deltaloom.sources import documents, prints

SCHEMA = "_name string, _VALUE string, b array<struct<_x:int,c:array<string>>>, d struct<_y:string,_VALUE:string>"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def texts(spark, *told):
    return spark.createDataFrame(list(enumerate(told)), "id int, xml string")


def test_documents_of_all_kinds(spark):
    told = texts(spark, "<a name='n'>said<b x='1'><c>p</c><c>q</c></b><b/><d y='z'>t</d></a>", "<a/>", None, "no xml <", "<a><other/><d/></a>")
    got = {r.id: r.document for r in documents.parsed(told, "xml", SCHEMA).collect()}
    assert got[0].asDict(True) == {"_name": "n", "_VALUE": "said", "b": [{"_x": 1, "c": ["p", "q"]}, {"_x": None, "c": None}], "d": {"_y": "z", "_VALUE": "t"}}
    assert got[1]._name is None and got[2] is None and got[3]._name is None and got[4].b is None
    with pytest.raises(Exception, match="(?i)malformed"):
        documents.parsed(told, "xml", SCHEMA, strict=True).collect()
    nodes = documents.nodes(documents.parsed(told, "xml", SCHEMA), "id", "document", "a").filter("id like '0/%'")
    assert [(r.id, r.parent, r.attrs, r.text) for r in nodes.orderBy("place", "id").collect() if r.type != "c"] == [("0/a", None, {"name": "n"}, "said"), ("0/a/b0", "0/a", {"x": "1"}, None), ("0/a/b1", "0/a", {}, None), ("0/a/d0", "0/a", {"y": "z"}, "t")]
    assert rows(nodes.filter("type = 'c'").select("id", "place", "text")) == [("0/a/b0/c0", 1 << 40, "p"), ("0/a/b0/c1", (1 << 40) + 1, "q")]


def test_documents_are_equal_whatever_the_order_of_attributes(spark):
    schema = "_p string, _q string, b array<string>"
    whole = lambda *told: tree.hashes(documents.nodes(documents.parsed(texts(spark, *told), "xml", schema), "id", "document", "a")).filter("id like '%/a'").select(F.regexp_extract("id", r"^(\d+)", 1), "hash")
    got = dict(rows(whole("<a p='1' q='2'><b>x</b><b>y</b></a>", "<a q='2' p='1'>\n <b> x</b><b>y</b></a>", "<a p='1' q='2'><b>y</b><b>x</b></a>", "<a p='1'><b>x</b><b>y</b></a>")))
    assert got["0"] == got["1"] and len(set(got.values())) == 3


def test_headers_of_files(spark, tmp_path):
    for name, head in (("x", "<header v='1'/>"), ("y", ""), ("z", "<header v='1'/><header v='2'/>")):
        (tmp_path / f"{name}.xml").write_text(f"<dump>{head}<row k='{name}1'/><row k='{name}2'/></dump>")
    read = lambda f, tag, schema: documents.read(spark, f"file://{tmp_path}/{f}.xml", tag, schema)
    told = lambda f: rows(documents.with_header(read(f, "row", "_k string"), read(f, "header", "_v int")).select("_k", "header._v"))
    assert told("x") == [("x1", 1), ("x2", 1)] and told("y") == [("y1", None), ("y2", None)]
    with pytest.raises(Exception, match="several headers"):
        told("z")


def test_printed_files_are_in_order(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    data = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("n")).repartition(6).withColumn("text", F.when(F.col("n") % 10 != 0, F.concat(F.lit("line "), F.col("n").cast("string"))))
    prints.write(data, path, [F.desc("n")], header=["-- one", "-- two"], footer=["-- end"], rows_per_file=100)
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-")]) == 9
    want = ["-- one", "-- two", *(f"line {n}" for n in reversed(range(1000)) if n % 10), "-- end"]
    assert [r.text for r in prints.lines(spark, path).orderBy("line").collect()] == want
    assert prints.header_of(spark, path) == ["-- one", "-- two"]
    assert prints.header_of(spark, f"file://{tmp_path}/none") == []
    prints.write(data.limit(0), path, [F.col("n")], header=["-- only"])
    assert prints.header_of(spark, path) == ["-- only"] and prints.lines(spark, path).count() == 1


def test_headers_are_filled_or_kept():
    assert prints.filled(["by $who$ for $$5", "=>", "-- x"], {"who": "me"}, ["-- old"]) == ["-- by me for $5", "-- old", "-- x"]
    assert prints.filled(["=> first", "=>"], {}) == ["-- first"] and prints.filled(["=> first"], {}, ["-- was"]) == ["-- was"]
    with pytest.raises(ValueError, match="unknown name x"):
        prints.filled(["$x$"], {})


def test_values_of_mixed_kinds_have_one_order(spark):
    order = [None, "-5", " 7 ", "9", "10", "a", "a1", "b"]
    got = spark.createDataFrame([(x,) for x in reversed(order)], "v string").orderBy(scalar.order_key(F.col("v"))).collect()
    assert [r.v for r in got] == order
    lists = [None, [], [None], ["1"], ["1", None], ["1", "2"], ["1", "a"], ["2"], ["10"], ["a"], ["a", "1"]]
    got = spark.createDataFrame([(x,) for x in reversed(lists)], "v array<string>").orderBy(scalar.list_key(F.col("v"))).collect()
    assert [r.v for r in got] == lists
    versions = ["1", "1.9", "1.10", "1.10.1", "1.a", "2", "a"]
    made = spark.createDataFrame([(i, v) for i, v in enumerate(versions)], "i int, v string")
    keyed = made.select("i", scalar.version_key(F.col("v")).alias("k"))
    less = keyed.join(keyed.select(F.col("i").alias("j"), F.col("k").alias("l")), F.col("k") < F.col("l")).select("i", "j")
    assert rows(less) == sorted(itertools.combinations(range(len(versions)), 2), key=repr)
    assert made.agg(F.max_by("v", scalar.version_key(F.col("v")))).first()[0] == "a"
    kept = spark.createDataFrame([(" +07",), ("7a",), ("",), (None,)], "v string").select(scalar.int_or_text(F.col("v")).alias("v")).collect()
    assert [r.v for r in kept] == ["7", "7a", "", None]


def test_session_writes_scripts_and_folders(spark, tmp_path):
    script, folders = f"file://{tmp_path}/script", f"file://{tmp_path}/objects"
    one, two = spark.range(1), spark.range(1).withColumn("x", F.lit(1))
    run = lambda **more: Session(spark).extract({"t": one}).extract({"t": two}).diff().generate().print(script, **more)
    run(header=["made by $who$"], values={"who": "me"})
    run(header=["=> nobody", "again"])
    assert [r.text for r in prints.lines(spark, script).orderBy("line").collect()] == ["-- made by me", "-- again", "alter table public.t add column x int not null;"]
    told = lambda frame, **more: rows(Session(spark).extract({"t": frame}).scatter(folders, **more).result())
    assert told(one, check_only=True) == told(one) == [("column", "NEW"), ("schema", "NEW"), ("table", "NEW")]
    assert told(two) == [("column", "MODIFIED"), ("schema", "UNCHANGED"), ("table", "UNCHANGED")]
    session = Session(spark).extract({"t": one}).adddeps({"type": "type"}, {"type": "text"})
    assert rows(session.pop()) == sorted([("column.public.t.id", "table.public.t"), ("column.public.t.id", "type.bigint"), ("table.public.t", "schema.public")], key=repr)
    assert session.result().count() == 3
