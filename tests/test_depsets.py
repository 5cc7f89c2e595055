"""Dependency sets: nesting, shared fallbacks, search back, mirrors, contraction; each against a plain version or by hand."""

import itertools
import random

import pytest

from deltaloom import queries
from deltaloom.operators import depsets, graph


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


PART = "id string, parent string, node string, kind string, place int, fqn string, pqn string, applies string, direction string, condition string, priority int"


def part(id_, parent, kind, place=0, **more):
    return (id_, parent, "n" if parent is None else None, kind, place, *(more.get(c) for c in ("fqn", "pqn", "applies", "direction", "condition", "priority")))


def test_sets_in_sets_with_conditions_at_every_level(spark):
    told = [
        part("g", None, "dependencies", applies="Forwards", condition="c1"),
        part("h", "g", "dependencies", 1, direction="backwards"),
        part("plain", "h", "dependency", 1, fqn="x"),
        part("s", "h", "set", 2, applies="backwards", condition="c2"),
        part("first", "s", "dependency", 1, fqn="a", condition="c3", priority=200),
        part("t", "s", "set", 2, condition="c4"),
        part("u", "t", "set", 2, direction="forwards", priority=1),
        part("deep", "u", "dependency", 5, pqn="b", condition="c5"),
        part("beside", "t", "dependency", 1, fqn="c"),
        part("other", None, "dependency", fqn="y"),
    ]
    flat = depsets.flattened(spark.createDataFrame(told, PART))
    got = {r.name: (r.depset_id, r.is_full, r.applies, r.direction, r.conditions, [tuple(x) for x in r.rank]) for r in flat.collect()}
    assert got == {
        "x": (None, True, "forwards", "backwards", ["c1"], []),
        "a": ("s", True, "backwards", "backwards", ["c1", "c2", "c3"], [(200, 1)]),
        "b": ("s", False, "backwards", "forwards", ["c1", "c2", "c4", "c5"], [(100, 2), (1, 2), (100, 5)]),
        "c": ("s", True, "backwards", "backwards", ["c1", "c2", "c4"], [(100, 2), (100, 1)]),
        "y": (None, True, None, None, [], []),
    }
    names = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    holds = lambda *c: spark.createDataFrame([(x,) for x in c], "condition string")
    picked = lambda *c: {r.name for r in depsets.chosen(flat, names, holds(*c)).collect()}
    assert picked("c1", "c2", "c3", "c4", "c5") == {"x", "y", "b"}
    assert picked("c1", "c2", "c3", "c4") == {"x", "y", "c"}
    assert picked("c1", "c2", "c3") == {"x", "y", "a"} and picked("c1", "c3", "c4", "c5") == {"x", "y"} and picked() == {"y"}
    assert {r.name for r in depsets.chosen(flat, names.filter("name = 'a'"), holds("c1", "c2", "c3", "c4")).collect()} == {"x", "y", "a"}


def test_wrong_parts_raise(spark):
    with pytest.raises(Exception, match="no kind of dependency: thing"):
        depsets.flattened(spark.createDataFrame([part("a", None, "thing")], PART)).collect()
    with pytest.raises(Exception, match="no name in a dependency of n"):
        depsets.flattened(spark.createDataFrame([part("a", None, "dependency")], PART)).collect()
    assert depsets.flattened(spark.createDataFrame([], PART)).collect() == []


def plain_fallbacks(sets):
    made, out = {}, []
    for i, side, priority, names, fallback in sorted(sets, key=lambda s: (100 if s[2] is None else s[2], s[0])):
        fits = [f for f in made.get(side, []) if f == fallback or any(f.startswith(n) for n in names)]
        if not fits:
            made.setdefault(side, []).append(fallback)
        out.append((i, fits[0] if fits else fallback, not fits))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_fallbacks_serve_later_sets_of_their_side(spark, seed):
    r = random.Random(seed)
    name = lambda: "".join(r.choice("ab") for _ in range(r.randrange(1, 4)))
    sets = [(i, r.choice(["build", "drop"]), r.choice([None, 50, 150]), [name() for _ in range(r.randrange(3))], name()) for i in range(40)]
    frame = spark.createDataFrame(sets, "depset_id int, side string, priority int, names array<string>, fallback string")
    assert rows(depsets.shared_fallbacks(frame)) == plain_fallbacks(sets)


def test_fallbacks_at_the_edges(spark):
    schema = "depset_id int, side string, priority int, names array<string>, fallback string"
    assert rows(depsets.shared_fallbacks(spark.createDataFrame([], schema))) == []
    # A chain in which every set waits for the one before.
    chain = [(i, "build", None, [f"n{i}."], f"n{i + 1}.x") for i in range(8)]
    assert rows(depsets.shared_fallbacks(spark.createDataFrame(chain, schema))) == plain_fallbacks(chain)
    with pytest.raises(Exception, match="no candidate and no fallback: 3"):
        depsets.shared_fallbacks(spark.createDataFrame([(3, "build", None, None, None)], schema)).collect()


def has_cycle(edges):
    left = set(edges)
    while True:
        kept = {(a, b) for a, b in left if any(c == b for c, _ in left)}
        if kept == left:
            return bool(left)
        left = kept


def plain_choice(edges, options):
    ids = sorted({o[0] for o in options})
    lists = [sorted((p, t, n) for i, n, t, p in options if i == s) for s in ids]
    for way in itertools.product(*lists):
        if not has_cycle([*edges, *((n, t) for _, t, n in way)]):
            return sorted([(a, b, None) for a, b in edges] + [(n, t, i) for i, (_, t, n) in zip(ids, way)], key=repr)


OPTION, EDGE, BREAKER = "depset_id int, node string, target string, priority int", "node string, target string", "node string, breaker string"


@pytest.mark.parametrize("seed", [1, 2])
def test_the_first_choice_without_a_cycle(spark, seed):
    r = random.Random(seed)
    edges, options = [], []
    for group in "xyz":  # three components, searched side by side
        names = [f"{group}{i}" for i in range(5)]
        edges += [(a, b) for a in names for b in names if a != b and r.random() < 0.12 and not has_cycle([*edges, (a, b)])]
        for s in range(3):
            node = r.choice(names)
            options += [("xyz".index(group) * 10 + s, node, t, p) for p, t in enumerate(r.sample([n for n in names if n != node], 3))]
    want = plain_choice(edges, options)
    make = lambda: depsets.acyclic_choice(spark.createDataFrame(edges, EDGE), spark.createDataFrame(options, OPTION), spark.createDataFrame([], BREAKER))
    if want is None:
        with pytest.raises(ValueError, match="nothing breaks"):
            make().collect()
    else:
        assert rows(make()) == want


def test_a_choice_is_taken_back_where_the_greedy_way_raises(spark):
    edges = spark.createDataFrame([("d", "a")], EDGE)
    options = spark.createDataFrame([(1, "a", "b", 1), (1, "a", "d", 2), (2, "b", "a", 1), (2, "b", "e", 2)], OPTION)
    none = spark.createDataFrame([], BREAKER)
    with pytest.raises(ValueError):
        graph.without_cycles(edges, options, none)
    assert rows(depsets.acyclic_choice(edges, options, none)) == sorted([("d", "a", None), ("a", "b", 1), ("b", "e", 2)], key=repr)
    # Where no choice will do a breaker stands in; without one, also on a cycle of plain edges, an error says so.
    ring = spark.createDataFrame([("d", "a"), ("e", "a"), ("p", "q"), ("q", "p")], EDGE)
    breakers = spark.createDataFrame([("a", "base_a"), ("p", "base_p")], BREAKER)
    got = {r.target for r in depsets.acyclic_choice(ring, options, breakers).collect()}
    assert {"base_a", "base_p"} <= got
    with pytest.raises(ValueError, match="nothing breaks"):
        depsets.acyclic_choice(ring, options, breakers.filter("node = 'a'"))


def test_mirrors_over_three_levels(spark):
    actions = spark.createDataFrame([(n, a) for n in "abc" for a in ("drop", "build")] + [("m", "exists"), ("z", "diffprep"), ("z", "diff"), ("n", "build")], "node string, action string")
    edges = spark.createDataFrame([("a", "m", True), ("m", "b", True), ("b", "c", True), ("c", "a", True), ("z", "n", True), ("n", "a", False), ("n", "c", None)], "node string, target string, propagate boolean")
    got = rows(depsets.propagated_mirrors(actions, edges))
    assert got == sorted([(x, "build", y, "drop") for x in "abc" for y in "abc" if x != y] + [("n", "build", "z", "diffprep")], key=repr)


def plain_contracted(edges, removed):
    out = set()
    for u in {a for a, _ in edges} - removed:
        seen, todo = set(), [u]
        while todo:
            for a, b in edges:
                if a == todo[0] and b not in seen:
                    seen.add(b)
                    if b in removed:
                        todo.append(b)
            todo.pop(0)
        out |= {(u, v) for v in seen - removed if v != u}
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_ways_over_removed_nodes_stay_in_order(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(70)] + [(100 + i, 101 + i) for i in range(12)]
    removed = set(r.sample(range(40), 20)) | set(range(101, 112))
    got = rows(depsets.contracted(spark.createDataFrame(edges, "node int, target int"), spark.createDataFrame([(x,) for x in removed], "node int")))
    assert got == plain_contracted(edges, removed)


def test_silent_nodes_break_cycles_and_leave_the_plan(spark):
    edges = spark.createDataFrame([("a", "s"), ("s", "b"), ("b", "a"), ("c", "t"), ("t", "d"), ("p", "q"), ("q", "p")], EDGE)
    actions = spark.createDataFrame([(n, "build") for n in "abcdstpq"], "node string, action string")
    got = {r.node: r.level for r in depsets.plan_of_printed(actions, edges, spark.createDataFrame([("s",), ("t",)], "node string")).collect()}
    assert got == {"a": 0, "b": 1, "d": 0, "c": 1, "p": None, "q": None}


def test_no_table_of_a_plan_is_broadcast(spark, monkeypatch, tmp_path):
    plans = []

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        df.write.parquet(path := f"{tmp_path}/{len(plans)}")
        return spark.read.schema(df.schema).parquet(path)

    small = queries.QUERIES["plan_contracted"](spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(graph, "SMALL", 0)
    monkeypatch.setattr(graph, "kept", noted)
    monkeypatch.setattr(depsets, "kept", noted)
    large = queries.QUERIES["plan_contracted"](spark, "/root/testdata/sf0.001")
    assert rows(large) == rows(small)
    plans.append(large._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 20 and not [p for p in plans if "Broadcast" in p]


@pytest.mark.parametrize("small", [1 << 16, 0])
def test_rounds_and_one_task_agree(spark, small, monkeypatch):
    monkeypatch.setattr(graph, "SMALL", small)
    r = random.Random(3)
    edges = [(r.randrange(30), r.randrange(30)) for _ in range(34)] + [(50, 51), (51, 50), (60, 60), (70, 71), (None, 3), (3, None)]
    reach = {n: {n} for n in range(80)}
    for _ in range(80):
        for a, b in edges:
            if a is not None and b is not None:
                reach[a] |= reach[b]
    loops = {a for a, b in edges if a == b}
    want = sorted(((n, min(m for m in reach[n] if n in reach[m])) for n in reach if n in loops or any(m != n and n in reach[m] for m in reach[n])), key=repr)
    assert rows(graph.cycles(spark.createDataFrame(edges, "source int, target int"))) == want
    known = [(a, b) for a, b in edges if a is not None and b is not None]
    levels = {n: 0 for n in range(80)}
    for _ in range(90):
        for a, b in known:
            levels[b] = max(levels[b], levels[a] + 1)
    got = dict(rows(graph.levels(spark.range(80).selectExpr("int(id) node"), spark.createDataFrame(known, "source int, target int"))))
    behind = {m for n, _ in want for m in reach[n]}
    assert got == {n: None if n in behind else levels[n] for n in range(80)}
    seeds = spark.createDataFrame([(50,), (7,), (79,), (None,)], "node int")
    frame = spark.createDataFrame(edges, "source int, target int")
    assert rows(graph.reachable(frame, seeds)) == sorted(((n,) for n in reach[50] | reach[7] | reach[79]), key=repr)
    once = {b for a, b in edges if a in (50, 7, 79) and b is not None} | {50, 7, 79}
    assert rows(graph.reachable(frame, seeds, most_rounds=1)) == sorted(((n,) for n in once), key=repr)
    text = spark.createDataFrame([("é", "z"), ("z", "é"), ("a", "z")], "source string, target string")
    assert rows(graph.cycles(text)) == [("z", "z"), ("é", "z")]


def test_walks_of_any_length_end_and_cycles_raise(spark):
    chain = spark.range(30).selectExpr("id AS source", "id + 1 AS target")
    seeds = spark.createDataFrame([(0,), (25,)], "node long")
    assert rows(graph.walks(chain, seeds)) == sorted([(0, i, i) for i in range(31)] + [(25, 25 + i, i) for i in range(6)], key=repr)
    assert graph.walks(chain, seeds, most_rounds=30).count() == 37
    with pytest.raises(ValueError, match="more than 29"):
        graph.walks(chain, seeds, most_rounds=29)
    ring = chain.unionByName(spark.createDataFrame([(40, 41), (41, 40)], "source long, target long"))
    assert graph.walks(ring, seeds).count() == 37
    with pytest.raises(ValueError, match="round a cycle at 40"):
        graph.walks(ring, spark.createDataFrame([(41,)], "node long"))
