import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomdex.operators import cochange, delta, graph, spans


def edges(spark, rows):
    return spark.createDataFrame([(a, b, "call") for a, b in rows], "source long, target long, kind string")


def nodes(spark, *ks):
    return spark.createDataFrame([(k,) for k in ks], "node long")


def test_closure(spark):
    e = edges(spark, [(2, 1), (3, 2), (4, 3), (1, 3)])
    got = {r.node: r.distance for r in graph.closure(e, nodes(spark, 1)).collect()}
    assert got == {2: 1, 3: 2}
    full = {r.node: r.distance for r in graph.closure(e, nodes(spark, 1), 8).collect()}
    assert full == {1: 0, 2: 1, 3: 2, 4: 3}
    assert graph.closure(e, nodes(spark, 1), 0).count() == 0
    assert {r.node for r in graph.closure(e, nodes(spark, 1), 1, reverse=False).collect()} == {3}
    with pytest.raises(ValueError):
        graph.closure(e, nodes(spark, 1), 9)


def brute_cycles(pairs):
    reach = {}
    for a, b in pairs:
        reach.setdefault(a, set()).add(b)
    ns = {x for p in pairs for x in p}
    for k in ns:
        for i in ns:
            if k in reach.get(i, ()):
                reach[i] |= reach.get(k, set())
    return {(n, min([m for m in reach.get(n, ()) if n in reach.get(m, ())] + [n])) for n in ns if n in reach.get(n, ())}


@pytest.mark.parametrize("seed", range(3))
def test_cycles(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(14), r.randrange(14)) for _ in range(18)]
    assert {(x.node, x.cycle) for x in graph.cycles(edges(spark, pairs)).collect()} == brute_cycles(pairs)


def test_merge(spark):
    e = spark.createDataFrame([(1, 2, "call", 5, "base"), (1, 2, "call", 9, "target"), (1, 3, "call", 4, "base"), (2, 3, "call", 7, "target")], "source long, target long, kind string, line long, endpoint string")
    assert {(r.source, r.target, r.line, r.endpoint) for r in graph.merge_edges(e).collect()} == {(1, 2, 9, "both"), (1, 3, 4, "base"), (2, 3, 7, "target")}


def test_spans(spark):
    s = spark.createDataFrame([("f", 1, 0, 100), ("f", 2, 10, 50), ("f", 3, 10, 50), ("f", 4, 20, 30), ("g", 5, 0, 5)], "file string, id long, start long, end long")
    p = spark.createDataFrame([("f", 1, 25, 26), ("f", 2, 40, 41), ("f", 3, 60, 61), ("f", 4, 200, 201), ("g", 5, 1, 2)], "file string, point_id long, start long, end long")
    assert {r.point_id: r.owner for r in spans.nearest_owner(p, s).collect()} == {1: 4, 2: 2, 3: 1, 4: None, 5: 5}
    assert {r.id: r.parent for r in spans.parents(s).collect()} == {1: None, 2: 1, 3: 1, 4: 2, 5: None}
    st_ = spark.createDataFrame([("same", "r", "r", 5, 5, False, True, "x", "x", 10, 3), ("gone", "r", "r", 5, 5, False, True, None, None, 10, 3), ("no", "r", "r", 5, 5, True, True, "x", "x", 10, 3)], "k string, representation string, current_representation string, size long, current_size long, refused boolean, is_text boolean, current_oid string, again_oid string, lines long, start_line long")
    st_ = st_.selectExpr("*", "'x' as oid")
    assert {r.k: r.status for r in spans.source_status(st_).collect()} == {"same": "served", "gone": "missing", "no": "refused"}


def test_cochange_bounds(spark):
    commits = spark.createDataFrame([(k, 2 if k == 7 else 1) for k in range(1, 9)], "seq long, parents int")
    t = [(k, p, None) for k in (1, 2, 3) for p in ("a", "b")] + [(4, "a", None), (8, "a", "c")] + [(6, f"p{k}", None) for k in range(30)] + [(7, "a", None), (7, "b", None)]
    touches = spark.createDataFrame(t, "seq long, path string, source string")
    files = spark.createDataFrame([(p,) for p in ("a", "b", "c", *(f"p{k}" for k in range(30)))], "path string")
    kept = cochange.kept_touches(commits, touches, files)
    got = cochange.co_changes(kept, spark.createDataFrame([("a",)], "path string")).collect()
    assert [(r.path, r.seed, r.together, r.commits_a, r.commits_b, r.jaccard_ppm) for r in got] == [("b", "a", 3, 5, 3, 600_000)]
    assert cochange.kept_touches(commits, touches, files, size=2).select("seq").distinct().count() == 1  # the bulk one uses up the window
    assert cochange.history_key("t", 50, files) != cochange.history_key("u", 50, files)


def test_hunks(spark):
    pairs = spark.createDataFrame([("a", "1\n2\n3\n", "1\nx\n3\n4\n"), ("b", None, "x"), ("c", "x" * 70_000, "y")], "key string, old string, new string")
    got = {r.key: [tuple(h) for h in r.hunks] for r in delta.hunks(pairs).collect()}
    assert got == {"a": [(2, 1, 2, 1), (3, 0, 4, 1)], "b": [], "c": []}


def test_pairing_by_place_after_a_rename(spark):
    cols = "path string, id long, kind string, qualified string, start long"
    base = spark.createDataFrame([("old", 1, "function", "old::f", 1), ("old", 2, "function", "old::g", 5)], cols)
    target = spark.createDataFrame([("new", 11, "function", "new::f", 1), ("new", 12, "function", "new::g", 5)], cols)
    moved = spark.createDataFrame([("new", "old")], "path string, source string")
    pairs = delta.pair_definitions(base, target, moved)
    assert {(r.base_id, r.target_id) for r in pairs.collect()} == {(1, 11), (2, 12)}
    none = spark.createDataFrame([], "id long")
    touched = spark.createDataFrame([(12,)], "id long")
    assert {(r.target_id, r.change) for r in delta.classify_definitions(pairs, none, touched, moved).collect()} == {(11, "moved"), (12, "modified")}


def test_plan_conflict(spark):
    c = spark.createDataFrame([("a", "rename", "x"), ("a", "rename", "y"), ("b", "remove", None), ("b", "recheck", None)], "path string, action string, source string")
    assert {(r.path, r.action) for r in delta.refresh_plan(c).collect()} == {("a", "conflict"), ("b", "recheck")}
    assert delta.full_reason({"rules-changed": True, "no-index": True}) == "no-index"


@settings(max_examples=6, deadline=None)
@given(st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 3)), st.dictionaries(st.sampled_from("abcdef"), st.integers(0, 3)))
def test_incremental_equals_full(spark, old, new):
    """The rows of a refresh are those of a build from nothing."""
    schema = "path string, oid string, mode string"
    tree = lambda t: spark.createDataFrame([(p, str(v), "f") for p, v in t.items()], schema)
    facts = lambda df: df.selectExpr("path", "concat(oid, '!') as fact")
    d = delta.tree_delta(tree(old), tree(new))
    changes = d.selectExpr("path", "case change when 'deleted' then 'remove' when 'renamed' then 'rename' else 'recheck' end as action", "source")
    plan = delta.refresh_plan(changes)
    redo = tree(new).join(plan.where("action <> 'remove'").select("path"), "path", "left_semi")
    got = delta.refreshed(facts(tree(old)), plan, facts(redo))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, facts(tree(new)).collect()))
    assert delta.is_no_op(plan) == (old == new)


def test_spans_against_brute_force(spark):
    import random

    r = random.Random(3)
    rows = [(r.choice("fg"), k, a, a + r.choice([0, 1, 5, 40, 900])) for k in range(120) for a in [r.randrange(300)]]
    s = spark.createDataFrame(rows, "file string, id long, start long, end long")
    smallest = lambda f, a, b, me=None: min(((e - x, k) for g, k, x, e in rows if g == f and x <= a and b <= e and (me is None or (k != me and (x < a or b < e)))), default=(0, None))[1]
    assert {x.id: x.parent for x in spans.parents(s).collect()} == {k: smallest(f, a, b, k) for f, k, a, b in rows}
    points = [(r.choice("fg"), k, a, a + r.randrange(3)) for k in range(80) for a in [r.randrange(400)]]
    got = spans.nearest_owner(spark.createDataFrame(points, "file string, point_id long, start long, end long"), s).collect()
    assert {x.point_id: x.owner for x in got} == {k: smallest(f, a, b) for f, k, a, b in points}
    hunks = [(r.choice("fg"), r.randrange(300), r.choice([0, 1, 30])) for _ in range(40)]
    want = set()
    for f, a, n in hunks:
        lo, hi = (a, a + n - 1) if n else (max(a, 1), max(a, 1))
        met = [x for x in rows if x[0] == f and x[2] <= hi and lo <= x[3]]
        want |= {(f, k) for _, k, x, e in met if not any(j != k and x <= y and z <= e and (x < y or z < e) for _, j, y, z in met)}
    h = spark.createDataFrame(hunks, "file string, start long, lines long")
    assert {(x.file, x.id) for x in spans.touched(s.select("file", "id", s.start.alias("start_line"), s.end.alias("end_line")), h).collect()} == want
