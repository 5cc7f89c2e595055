"""Statements of changes and the session's commands."""

import re

import pytest
from pyspark.sql import functions as F

from deltaloom.plans import render
from deltaloom.plans.session import Session
from deltaloom.sources import catalog

ROW = "action string, type string, schema string, name string, relation string, attrs map<string,string>, old_attrs map<string,string>"


def said(spark, *rows):
    out = render.statements(spark.createDataFrame(list(rows), ROW).withColumn("id", F.monotonically_increasing_id()), ["id"])
    return [r.text for r in out.orderBy("id", "part").collect()]


def test_each_attribute_that_differs_has_its_statement(spark):
    column = lambda old, new: ("diff", "column", "s", "Col", "t", new, old)
    assert said(spark, column({"type": "int", "nullable": "true", "position": "2"}, {"type": "int", "nullable": "false", "position": "1"})) == ['alter table s.t alter column "Col" set not null;']
    assert said(spark, column({"type": "int", "nullable": "false", "default": "1", "comment": "it's"}, {"type": "text", "nullable": "true"})) == [
        'alter table s.t alter column "Col" type text;',
        'alter table s.t alter column "Col" drop not null;',
        'alter table s.t alter column "Col" drop default;',
        'comment on column s.t."Col" is null;',
    ]
    assert said(spark, ("diff", "role", None, "r", None, {"login": "false", "connections": "5"}, {"login": "true", "expires": "2020-01-01"})) == ["alter role r with nologin;", "alter role r valid until 'infinity';", "alter role r connection limit 5;"]
    assert said(spark, ("diff", "table", "s", "a.b", "a.b", {"owner": "My role"}, {})) == ['alter table s."a.b" owner to "My role";']
    assert said(spark, ("diff", "column", "s", "c", "t", {}, {})) == []


def test_building_and_dropping(spark):
    made = said(
        spark,
        ("build", "column", "s", "c", "t", {"type": "int", "nullable": "false", "default": "0", "comment": "x"}, None),
        ("build", "function", "s", "f", None, {"arguments": "a int", "result": "int", "language": "sql", "strict": "true", "source": "select 'a'", "owner": "o"}, None),
        ("build", "domain", "s", "d", None, {"type": "int", "nullable": "true"}, None),
        ("build", "trigger", None, "tr", "t", {"timing": "after", "events": "insert or update", "level": "row", "function": "s.f"}, None),
        ("build", "cast", None, "", None, {"source": "int", "target": "text", "context": "implicit"}, None),
        ("build", "grant", "s", "", "t", {"privilege": "select", "to": "select", "option": "true"}, None),
        ("drop", "index", "s", "i", "t", {}, None),
        ("drop", "function", "s", "f", None, {"arguments": "a int"}, None),
        ("drop", "unheard", "s", "f", None, {}, None),
        ("build", "column", "s", "c", "t", {}, None),
    )
    assert made == [
        "alter table s.t add column c int default 0 not null;",
        "comment on column s.t.c is 'x';",
        "create or replace function s.f(a int) returns int language sql strict as 'select ''a''';",
        "alter function s.f(a int) owner to o;",
        "create domain s.d as int;",
        "create trigger tr after insert or update on t for each row execute procedure s.f();",
        "create cast (int as text) without function as implicit;",
        'grant select on s.t to "select" with grant option;',
        "drop index s.i;",
        "drop function s.f(a int);",
    ]


def test_every_kind_builds_and_drops_with_all_it_asks_for(spark):
    rows = []
    for kind, told in render.KINDS.items():
        asked = {n.partition("!")[0] for n in re.findall(r"\{([^{}]+)\}", told.build + told.drop + "".join(x for c in told.changes.values() for x in c))}
        attrs = {n: "true" if n in ("nullable", "unique") else "v" for n in asked - {"own", "whole", "of"}} | {a: "w" for a in told.changes}
        rows += [(action, kind, "s", "n", "t", attrs, {} if action == "diff" else None) for action in ("build", "drop", "diff")]
    made = render.statements(spark.createDataFrame(rows, ROW), ["type", "action"]).collect()
    assert all(r.text.endswith(";") and not re.search(r"[{}\[\]]", r.text) for r in made)
    assert {(r.type, r.action) for r in made} == {(k, a) for k, told in render.KINDS.items() for a in ("build", "drop", *(["diff"] if told.changes else []))}


def test_statements_of_rarer_kinds(spark):
    none = {}
    made = said(
        spark,
        ("build", "operator", "s", "<>", None, {"function": "s.ne", "left": "int", "right": "int", "negator": "=", "hashes": "true"}, None),
        ("build", "operator", "S", "!", None, {"function": "neg", "right": "int", "comment": "not"}, None),
        ("drop", "operator", None, "!", None, {"right": "int"}, None),
        ("build", "operator_class", "s", "c", None, {"default": "true", "type": "int", "method": "btree", "members": "operator 1 <", "owner": "o"}, None),
        ("diff", "operator_family", "s", "f", None, {"method": "hash", "comment": "x"}, {"method": "hash"}),
        ("build", "text_search_template", "s", "t", None, {"lexize": "l"}, None),
        ("build", "text_search_dictionary", "s", "d", None, {"template": "simple", "options": "stopwords = english"}, None),
        ("diff", "text_search_configuration_map", "s", "word", "conf", {"dictionaries": "a, b"}, {"dictionaries": "a"}),
        ("diff", "foreign_data_wrapper", None, "w", None, none, {"handler": "h", "validator": "v"}),
        ("build", "user_mapping", None, "My user", None, {"server": "x y"}, None),
        ("diff", "extension", None, "e", None, {"version": "2"}, {"version": "1"}),
        ("diff", "extension", None, "e", None, {"home": "h", "version": "1"}, {"home": "g", "version": "1"}),
        ("build", "collation", "s", "c", None, {"collate": "de_DE", "ctype": "C"}, None),
        ("build", "event_trigger", None, "t", None, {"event": "ddl_command_end", "tags": "'CREATE TABLE'", "function": "f", "enabled": "false"}, None),
        ("build", "matview", "s", "m", None, {"query": "select 1"}, None),
        ("build", "database", None, "db", None, {"owner": "o", "connections": "5"}, None),
        ("diff", "database", None, "db", None, {"owner": "o"}, {"owner": "o", "connections": "5"}),
        ("drop", "privilege", None, "createdb", None, {"of_role": "r", "privilege": "createdb"}, None),
        ("build", "range", "s", "r", None, {"subtype": "float8", "difference": "float8mi"}, None),
        ("build", "base", "s", "b", None, {"input": "i", "output": "o", "delimiter": ","}, None),
        ("build", "base", "s", "b", None, {"input": "i"}, None),
    )
    assert made == [
        "create operator s.<> (procedure = s.ne, leftarg = int, rightarg = int, negator = =, hashes);",
        'create operator "S".! (procedure = neg, rightarg = int);',
        "comment on operator \"S\".! (none, int) is 'not';",
        "drop operator ! (none, int);",
        "create operator class s.c default for type int using btree as operator 1 <;",
        "alter operator class s.c using btree owner to o;",
        "comment on operator family s.f using hash is 'x';",
        "create text search template s.t (lexize = l);",
        "create text search dictionary s.d (template = simple, stopwords = english);",
        "alter text search configuration s.conf alter mapping for word with a, b;",
        "alter foreign data wrapper w no handler;",
        "alter foreign data wrapper w no validator;",
        'create user mapping for "My user" server "x y";',
        "alter extension e update to '2';",
        "alter extension e set schema h;",
        "create collation s.c (lc_collate = 'de_DE', lc_ctype = 'C');",
        "create event trigger t on ddl_command_end when tag in ('CREATE TABLE') execute procedure f();",
        "alter event trigger t disable;",
        "create materialized view s.m as select 1;",
        "create database db owner o connection limit 5;",
        "alter database db connection limit -1;",
        "alter role r with nocreatedb;",
        "create type s.r as range (subtype = float8, subtype_diff = float8mi);",
        "create type s.b (input = i, output = o, delimiter = ',');",
    ]


def test_a_dropped_first_column_changes_no_other(spark):
    frame = spark.createDataFrame([(1, 2, "x"), (2, None, "y")], "a int, b int, c string")
    run = lambda old, new: [r.text for r in Session(spark).extract({"t": old}, measured=True).extract({"t": new}, measured=True).diff().generate().result().orderBy("seq").collect()]
    assert run(frame, frame.select("b", "c")) == ["alter table public.t drop column a;"]
    assert run(frame, frame.filter("a = 1")) == ["alter table public.t alter column b set not null;"]
    assert run(frame.filter("a = 1"), frame) == ["alter table public.t alter column b drop not null;"]
    assert run(frame, frame.withColumn("b", F.col("b").cast("long"))) == ["alter table public.t alter column b type bigint;"]
    assert run(frame, frame) == []


def test_measured_descriptions(spark):
    frame = spark.createDataFrame([(1, None)], "a int, `b.c` string")
    told = {r.name: r.attrs["nullable"] for r in catalog.describe(spark, {"t": frame, "e": frame.limit(0).select("a").withColumnRenamed("a", "z")}, measured=True).filter("type = 'column'").collect()}
    assert told == {"a": "false", "b.c": "true", "z": "true"}


def test_names_with_dots_and_swapped_sides(spark):
    one, two = spark.range(1), spark.range(1).withColumn("x", F.lit(1))
    lines = lambda swap: [r.text for r in Session(spark).extract({"a.b": one}).extract({"a.b": two}).diff(swap).generate().result().orderBy("seq").collect()]
    assert lines(False) == ['alter table public."a.b" add column x int not null;']
    assert lines(True) == ['alter table public."a.b" drop column x;']
    with pytest.raises(ValueError, match="empty"):
        Session(spark).diff()
