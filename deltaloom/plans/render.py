"""Text of listings and change scripts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quoting import quote_identifier, quote_literal, quote_qualified


def listing(depth: Column, kind: Column, name: Column, fqn: Column, status: Column | None = None, action: Column | None = None) -> Column:
    """An indented line ``type=name|fqn[|diff=status][|action=action]``; a null status or action is left out."""
    line = F.concat(F.repeat(F.lit("  "), depth), kind, F.lit("="), name, F.lit("|"), fqn)
    for label, value in (("diff", status), ("action", action)):
        if value is not None:
            line = F.concat(line, F.coalesce(F.concat(F.lit(f"|{label}="), value), F.lit("")))
    return line


def ddl(action: Column, kind: str, name: Column, attr: Column, value: Column) -> Column:
    """One statement for an object of ``kind``: create, drop, or a change of one attribute."""
    quoted = quote_identifier(name)
    return (
        F.when(action == "build", F.concat(F.lit(f"create {kind} "), quoted, F.lit(";")))
        .when(action == "drop", F.concat(F.lit(f"drop {kind} "), quoted, F.lit(";")))
        .when(action == "diff", F.concat(F.lit(f"alter {kind} "), quoted, F.lit(" set "), attr, F.lit(" = "), F.coalesce(quote_literal(value), F.lit("null")), F.lit(";")))
    )


def navigation(move: Column, kind: Column, name: Column) -> Column:
    """What a script says where it goes to another place: a database is connected to, an owner's rights are taken on and given back; null where nothing is said."""
    return (
        F.when((kind == "database") & (move == "arrive"), F.concat(F.lit("\\connect "), quote_identifier(name)))
        .when((kind == "owner") & (move == "arrive"), F.concat(F.lit("set session authorization "), quote_literal(name), F.lit(";")))
        .when((kind == "owner") & (move == "depart"), F.lit("reset session authorization;"))
    )


def comment(kind: str, name: Column, text: Column) -> Column:
    """``comment on …``; a null text removes it."""
    return F.concat(F.lit(f"comment on {kind} "), quote_identifier(name), F.lit(" is "), F.coalesce(quote_literal(text), F.lit("null")), F.lit(";"))


def create_table(name: Column, columns: Column) -> Column:
    """``columns`` is an array of (name, type, nullable)."""
    line = lambda c: F.concat(F.lit("  "), quote_identifier(c["name"]), F.lit(" "), c["type"], F.when(c["nullable"], "").otherwise(" not null"))
    return F.concat(F.lit("create table "), quote_identifier(name), F.lit(" (\n"), F.array_join(F.transform(columns, line), ",\n"), F.lit("\n);"))


@dataclass(frozen=True)
class Kind:
    """The statements of one kind of object, as templates of ``_filled``.

    changes: for an attribute that differs the statement that sets it and, where
    it has no value any more, the one that takes it away (none: the first).
    rebuild: attributes that no statement changes.
    """

    build: str
    drop: str
    changes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    rebuild: tuple[str, ...] = ()


def _common(kind: str, name: str = "whole", owner: bool = True) -> dict[str, tuple[str, ...]]:
    changes = {"comment": (f"comment on {kind} {{{name}}} is {{comment!l}}", f"comment on {kind} {{{name}}} is null")}
    return {"owner": (f"alter {kind} {{{name}}} owner to {{owner!i}}",), **changes} if owner else changes


def _using(kind: str) -> dict[str, tuple[str, ...]]:
    """Changes of what is known by its name and an access method."""
    told = f"{kind} {{whole}} using {{method}}"
    return {"owner": (f"alter {told} owner to {{owner!i}}",), "comment": (f"comment on {told} is {{comment!l}}", f"comment on {told} is null")}


_SIDES = "([{left}][left=:none], [{right}][right=:none])"

# own: the object's name, whole: with its schema, sign: with its schema but as it is (an operator's), of: the table it belongs to, with its schema.
KINDS = {
    "schema": Kind("create schema {own}[ authorization {owner!i}]", "drop schema {own}", _common("schema", "own")),
    "table": Kind("create table {whole} ()", "drop table {whole}", {**_common("table"), "tablespace": ("alter table {whole} set tablespace {tablespace!i}",), "inherits": ("alter table {whole} inherit {inherits}",)}),
    "column": Kind(
        "alter table {of} add column {own} {type}[ default {default}][nullable=false: not null]",
        "alter table {of} drop column {own}",
        {
            "type": ("alter table {of} alter column {own} type {type}",),
            "nullable": ("alter table {of} alter column {own} [nullable=false:set][nullable=true:drop] not null", "alter table {of} alter column {own} drop not null"),
            "default": ("alter table {of} alter column {own} set default {default}", "alter table {of} alter column {own} drop default"),
            "statistics": ("alter table {of} alter column {own} set statistics {statistics}", "alter table {of} alter column {own} set statistics -1"),
            "storage": ("alter table {of} alter column {own} set storage {storage}",),
            "comment": ("comment on column {of}.{own} is {comment!l}", "comment on column {of}.{own} is null"),
        },
    ),
    "constraint": Kind("alter table {of} add constraint {own} {definition}", "alter table {of} drop constraint {own}", {"comment": ("comment on constraint {own} on {of} is {comment!l}", "comment on constraint {own} on {of} is null")}, ("definition",)),
    "index": Kind("create [unique=true:unique ]index {own} on {of}[ using {method}] ({columns})[ where {predicate}]", "drop index {whole}", {**_common("index", owner=False), "tablespace": ("alter index {whole} set tablespace {tablespace!i}",)}, ("columns", "unique", "method", "predicate")),
    "sequence": Kind("create sequence {whole}[ start with {start}][ increment by {increment}][ minvalue {least}][ maxvalue {most}]", "drop sequence {whole}", {"start": ("alter sequence {whole} start with {start}",), "increment": ("alter sequence {whole} increment by {increment}",), "least": ("alter sequence {whole} minvalue {least}", "alter sequence {whole} no minvalue"), "most": ("alter sequence {whole} maxvalue {most}", "alter sequence {whole} no maxvalue"), **_common("sequence")}),
    "view": Kind("create or replace view {whole} as {query}", "drop view {whole}", {"query": ("create or replace view {whole} as {query}",), **_common("view")}),
    "function": Kind("create or replace function {whole}({arguments}) returns {result} language {language}[ {volatility}][strict=true: strict] as {source!l}", "drop function {whole}({arguments})", {"source": ("create or replace function {whole}({arguments}) returns {result} language {language}[ {volatility}][strict=true: strict] as {source!l}",), "owner": ("alter function {whole}({arguments}) owner to {owner!i}",), "volatility": ("alter function {whole}({arguments}) {volatility}",), "comment": ("comment on function {whole}({arguments}) is {comment!l}", "comment on function {whole}({arguments}) is null")}, ("arguments", "result", "language")),
    "domain": Kind("create domain {whole} as {type}[ default {default}][nullable=false: not null]", "drop domain {whole}", {"default": ("alter domain {whole} set default {default}", "alter domain {whole} drop default"), "nullable": ("alter domain {whole} [nullable=false:set][nullable=true:drop] not null", "alter domain {whole} drop not null"), **_common("domain")}, ("type",)),
    "enum": Kind("create type {whole} as enum ({labels})", "drop type {whole}", _common("type"), ("labels",)),
    "type": Kind("create type {whole} as ({fields})", "drop type {whole}", _common("type"), ("fields",)),
    "aggregate": Kind("create aggregate {whole}({arguments}) (sfunc = {sfunc}, stype = {stype}[, finalfunc = {finalfunc}][, initcond = {initcond!l}])", "drop aggregate {whole}({arguments})", {}, ("arguments", "sfunc", "stype", "finalfunc", "initcond")),
    "trigger": Kind("create trigger {own} {timing} {events} on {of} for each {level} execute procedure {function}()", "drop trigger {own} on {of}", {"enabled": ("alter table {of} [enabled=true:enable][enabled=false:disable] trigger {own}",), "comment": ("comment on trigger {own} on {of} is {comment!l}", "comment on trigger {own} on {of} is null")}, ("timing", "events", "level", "function")),
    "rule": Kind("create rule {own} as on {event} to {of}[ where {condition}] do[instead=true: instead] {action}", "drop rule {own} on {of}", {}, ("event", "condition", "instead", "action")),
    "role": Kind("create role {own}[login=true: login][superuser=true: superuser][inherits=false: noinherit]", "drop role {own}", {"login": ("alter role {own} with [login=true:login][login=false:nologin]",), "superuser": ("alter role {own} with [superuser=true:superuser][superuser=false:nosuperuser]",), "password": ("alter role {own} password {password!l}", "alter role {own} password null"), "expires": ("alter role {own} valid until {expires!l}", "alter role {own} valid until 'infinity'"), "connections": ("alter role {own} connection limit {connections}", "alter role {own} connection limit -1"), **_common("role", "own", owner=False)}),
    "member": Kind("grant {of_role!i} to {own}", "revoke {of_role!i} from {own}", {}, ("of_role",)),
    "tablespace": Kind("create tablespace {own}[ owner {owner!i}] location {location!l}", "drop tablespace {own}", _common("tablespace", "own"), ("location",)),
    "language": Kind("create [trusted=true:trusted ]language {own}[ handler {handler}]", "drop language {own}", _common("language", "own"), ("trusted", "handler")),
    "cast": Kind("create cast ({source} as {target}) [function=:without function][ with function {function}][ as {context}]", "drop cast ({source} as {target})", {"comment": ("comment on cast ({source} as {target}) is {comment!l}", "comment on cast ({source} as {target}) is null")}, ("source", "target", "function", "context")),
    "conversion": Kind("create [default=true:default ]conversion {whole} for {source!l} to {target!l} from {function}", "drop conversion {whole}", _common("conversion"), ("source", "target", "function", "default")),
    "foreign_server": Kind("create server {own}[ type {type!l}][ version {version!l}] foreign data wrapper {wrapper!i}", "drop server {own}", {"version": ("alter server {own} version {version!l}",), **_common("server", "own")}, ("type", "wrapper")),
    "grant": Kind("grant {privilege} on {of} to {to!i}[option=true: with grant option]", "revoke {privilege} on {of} from {to!i}", {}, ("privilege", "to", "option")),
    "database": Kind("create database {own}[ owner {owner!i}][ encoding {encoding!l}][ tablespace {tablespace!i}][ connection limit {connections}]", "drop database {own}", {"tablespace": ("alter database {own} set tablespace {tablespace!i}",), "connections": ("alter database {own} connection limit {connections}", "alter database {own} connection limit -1"), **_common("database", "own")}, ("encoding",)),
    "privilege": Kind("alter role {of_role!i} with {privilege}", "alter role {of_role!i} with no{privilege}", {}, ("of_role", "privilege")),
    "matview": Kind("create materialized view {whole}[ tablespace {tablespace!i}] as {query}", "drop materialized view {whole}", {"tablespace": ("alter materialized view {whole} set tablespace {tablespace!i}", "alter materialized view {whole} set tablespace pg_default"), **_common("materialized view")}, ("query",)),
    "base": Kind("create type {whole} (input = {input}, output = {output}[, receive = {receive}][, send = {send}][, internallength = {length}][, alignment = {alignment}][, storage = {storage}][, default = {default!l}][, delimiter = {delimiter!l}])", "drop type {whole}", _common("type"), ("input", "output", "receive", "send", "length", "alignment", "storage", "default", "delimiter")),
    "range": Kind("create type {whole} as range (subtype = {subtype}[, subtype_opclass = {class}][, collation = {collation}][, canonical = {canonical}][, subtype_diff = {difference}])", "drop type {whole}", _common("type"), ("subtype", "class", "collation", "canonical", "difference")),
    "operator": Kind(
        "create operator {sign} (procedure = {function}[, leftarg = {left}][, rightarg = {right}][, commutator = {commutator}][, negator = {negator}][, restrict = {restrict}][, join = {join}][hashes=true:, hashes][merges=true:, merges])",
        f"drop operator {{sign}} {_SIDES}",
        {"owner": (f"alter operator {{sign}} {_SIDES} owner to {{owner!i}}",), "comment": (f"comment on operator {{sign}} {_SIDES} is {{comment!l}}", f"comment on operator {{sign}} {_SIDES} is null")},
        ("function", "left", "right", "commutator", "negator", "restrict", "join", "hashes", "merges"),
    ),
    "operator_class": Kind("create operator class {whole}[default=true: default] for type {type} using {method}[ family {family}] as {members}", "drop operator class {whole} using {method}", _using("operator class"), ("default", "type", "method", "family", "members")),
    "operator_family": Kind("create operator family {whole} using {method}", "drop operator family {whole} using {method}", _using("operator family"), ("method",)),
    "text_search_parser": Kind("create text search parser {whole} (start = {start}, gettoken = {token}, end = {end}, lextypes = {types}[, headline = {headline}])", "drop text search parser {whole}", _common("text search parser", owner=False), ("start", "token", "end", "types", "headline")),
    "text_search_template": Kind("create text search template {whole} ([init = {init}, ]lexize = {lexize})", "drop text search template {whole}", _common("text search template", owner=False), ("init", "lexize")),
    "text_search_dictionary": Kind("create text search dictionary {whole} (template = {template}[, {options}])", "drop text search dictionary {whole}", _common("text search dictionary"), ("template", "options")),
    "text_search_configuration": Kind("create text search configuration {whole} (parser = {parser})", "drop text search configuration {whole}", _common("text search configuration"), ("parser",)),
    "text_search_configuration_map": Kind("alter text search configuration {of} add mapping for {own} with {dictionaries}", "alter text search configuration {of} drop mapping for {own}", {"dictionaries": ("alter text search configuration {of} alter mapping for {own} with {dictionaries}",)}),
    "foreign_data_wrapper": Kind("create foreign data wrapper {own}[ handler {handler}][ validator {validator}][ options ({options})]", "drop foreign data wrapper {own}", {"handler": ("alter foreign data wrapper {own} handler {handler}", "alter foreign data wrapper {own} no handler"), "validator": ("alter foreign data wrapper {own} validator {validator}", "alter foreign data wrapper {own} no validator"), **_common("foreign data wrapper", "own")}, ("options",)),
    "user_mapping": Kind("create user mapping for {own} server {server!i}[ options ({options})]", "drop user mapping for {own} server {server!i}", {}, ("server", "options")),
    "extension": Kind("create extension {own}[ schema {home!i}][ version {version!l}]", "drop extension {own}", {"home": ("alter extension {own} set schema {home!i}",), "version": ("alter extension {own} update to {version!l}", "alter extension {own} update"), **_common("extension", "own", owner=False)}),
    "collation": Kind("create collation {whole} (lc_collate = {collate!l}, lc_ctype = {ctype!l})", "drop collation {whole}", _common("collation"), ("collate", "ctype")),
    "event_trigger": Kind("create event trigger {own} on {event}[ when tag in ({tags})] execute procedure {function}()", "drop event trigger {own}", {"enabled": ("alter event trigger {own} [enabled=true:enable][enabled=false:disable]",), **_common("event trigger", "own")}, ("event", "tags", "function")),
    "comment": Kind("comment on table {of} is {comment!l}", "comment on table {of} is null", {"comment": ("comment on table {of} is {comment!l}", "comment on table {of} is null")}),
}


def _filled(template: str, names: dict[str, Column], attrs: Column) -> Column:
    """``template`` with {x} replaced by a name or an attribute, {x!l} quoted as a literal, {x!i} as an identifier; ends with a semicolon.

    [text] is left out if something in it is null, [x=v:text] unless attribute x
    is v (an empty v: null). A null outside brackets makes the whole null.
    """

    def value(told: str) -> Column:
        name, _, how = told.partition("!")
        found = names.get(name, attrs[name])
        return {"": lambda c: c, "l": quote_literal, "i": quote_identifier}[how](found)

    def line(text: str) -> Column:
        parts = [F.lit(p) if i % 2 == 0 else value(p) for i, p in enumerate(re.split(r"\{([^{}]+)\}", text)) if p]
        return F.concat(*parts) if parts else F.lit("")

    out = []
    for i, part in enumerate(re.split(r"\[([^\[\]]*)\]", template + ";")):
        if i % 2 == 0:
            out.append(line(part))
        elif known := re.match(r"(\w+)=(\w*):", part):
            holds = attrs[known[1]] == known[2] if known[2] else attrs[known[1]].isNull()
            out.append(F.when(holds, line(part[known.end() :])).otherwise(""))
        else:
            out.append(F.coalesce(line(part), F.lit("")))
    return F.concat(*out)


def _names(schema: Column, name: Column, table: Column) -> dict[str, Column]:
    return {"own": quote_identifier(name), "whole": quote_qualified(schema, name), "of": quote_qualified(schema, table), "sign": F.when(F.coalesce(schema, F.lit("")) == "", name).otherwise(F.concat(quote_identifier(schema), F.lit("."), name))}


def statement(action: Column, kind: Column, schema: Column, name: Column, table: Column, attrs: Column) -> Column:
    """The statement that builds or drops an object of one of ``KINDS``; null for another kind or action, or where an attribute that it needs is missing.

    table is the table that a column, constraint, index, trigger, rule or grant
    belongs to, or the configuration of a text search mapping. A table is built empty, its columns are added one by one.
    """
    return _statement(action, kind, _names(schema, name, table), attrs)


def _statement(action: Column, kind: Column, names: dict[str, Column], attrs: Column, kinds: dict[str, Kind] = KINDS) -> Column:
    cases = [F.when((kind == k) & (action == a), _filled(text, names, attrs)) for k, told in kinds.items() for a, text in (("build", told.build), ("drop", told.drop))]
    return F.coalesce(*cases, F.lit(None).cast("string"))


def _changes(kind: Column, names: dict[str, Column], old: Column, attrs: Column, kinds: dict[str, Kind]) -> Column:
    out = F.array().cast("array<string>")
    for k, told in kinds.items():
        one = [F.when(~old[a].eqNullSafe(attrs[a]), F.when(attrs[a].isNotNull(), _filled(set_, names, attrs)).otherwise(_filled(unset[0], names, attrs) if unset else F.lit(None))) for a, (set_, *unset) in told.changes.items()]
        if one:
            out = F.when(kind == k, F.array_compact(F.array(*one))).otherwise(out)
    return out


def statements(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(keep…, part, text) of rows (action, type, schema, name, relation, attrs, old_attrs): what builds or drops each, or sets each attribute that differs.

    action diff gives a statement for each attribute of ``KINDS`` that differs,
    in their order, build also those that its statement leaves out (a comment,
    an owner). Names are quoted once, as columns. The kinds that occur, at most
    those of ``KINDS``, are asked for first, so that the plan holds only theirs.
    """
    there = {r.type for r in rows.filter(F.col("type").isin(*KINDS)).select("type").distinct().collect()}
    kinds = {k: told for k, told in KINDS.items() if k in there}
    named = rows.withColumns({f"deltaloom_{k}": c for k, c in _names(F.col("schema"), F.col("name"), F.col("relation")).items()})
    names = {k: F.col(f"deltaloom_{k}") for k in ("own", "whole", "of", "sign")}
    said = {k: {name.partition("!")[0] for name in re.findall(r"\{([^{}]+)\}", told.build)} | {name for name, _ in re.findall(r"\[(\w+)=(\w*):", told.build)} for k, told in kinds.items()}
    in_build = F.create_map(*(x for k, v in said.items() for x in (F.lit(k), F.array(*(F.lit(n) for n in sorted(v)))))).cast("map<string,array<string>>")
    # Against an object that is built only what its statement does not say is set.
    against = F.when(F.col("action") == "diff", F.col("old_attrs")).otherwise(F.map_filter("attrs", lambda k, _: F.array_contains(F.coalesce(F.try_element_at(in_build, F.col("type")), F.array().cast("array<string>")), k)))
    named = named.withColumn("deltaloom_against", against)
    whole = _statement(F.col("action"), F.col("type"), names, F.col("attrs"), kinds)
    more = F.when(F.col("action").isin("diff", "build"), _changes(F.col("type"), names, F.col("deltaloom_against"), F.col("attrs"), kinds)).otherwise(F.array().cast("array<string>"))
    return named.withColumn("deltaloom_said", F.concat(F.array_compact(F.array(whole)), more)).select(*keep, F.posexplode("deltaloom_said").alias("part", "text"))
