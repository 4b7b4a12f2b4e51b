import math

import pytest
from pyspark.sql import functions as F

from loomdex.operators import index, quality, ranking


def test_dense_ids(spark):
    df = index.dense_ids(spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k")), ["k"])
    assert [(r.k, r.symbol_id) for r in df.orderBy("k").collect()] == [(k, k) for k in range(1000)]


SYMBOLS = "symbol_id long, file string, module array<string>, parent long, name string, qualified string"


def test_resolution_cascade(spark):
    symbols = spark.createDataFrame(
        [(1, "a.rs", ["a"], None, "run", "a::run"), (2, "b.rs", ["b"], None, "run", "b::run"), (3, "a.rs", ["a"], None, "T", "a::T"), (4, "a.rs", ["a"], 3, "new", "a::T::new"), (5, "a.rs", ["a"], 4, "inner", "a::T::new::inner"), (6, "c.rs", ["c"], None, "dup", "c::dup"), (7, "c.rs", ["c"], None, "dup", "c::dup")],
        SYMBOLS,
    )
    refs = spark.createDataFrame(
        [
            (1, "a.rs", ["a"], 4, "run", None, "call"),  # its module
            (2, "a.rs", ["a"], None, "run", "crate::b::run", "call"),  # written path
            (3, "c.rs", ["c"], None, "go", None, "call"),  # import by alias
            (4, "a.rs", ["a"], 4, "inner", None, "call"),  # innermost scope
            (5, "a.rs", ["a"], None, "run", None, "method"),  # methods never resolve
            (6, "c.rs", ["c"], None, "dup", None, "call"),  # two candidates
            (7, "a.rs", ["a"], None, "b::run", "b::run", "call"),  # a bare path is below the module
            (8, "c.rs", ["c"], None, "missing", None, "call"),
            (9, "a.rs", ["a"], None, "run", "super::b::run", "call"),
        ],
        "ref_id long, file string, module array<string>, owner long, name string, qualified string, kind string",
    )
    imports = spark.createDataFrame([("c.rs", ["c"], "crate::b::run", "run", "go", "use", False), ("a.rs", ["a"], "crate::b", None, None, "use", True)], "file string, module array<string>, path string, leaf string, alias string, kind string, is_glob boolean")
    got = {r.ref_id: (r.resolution, r.target) for r in index.resolve(refs, symbols, imports).collect()}
    assert got == {1: ("resolved", 1), 2: ("resolved", 2), 3: ("resolved", 2), 4: ("resolved", 5), 5: ("unresolved", None), 6: ("ambiguous", None), 7: ("unresolved", None), 8: ("unresolved", None), 9: ("resolved", 2)}
    resolved = index.resolve(refs, symbols, imports)
    assert index.unresolved_count(resolved).first().unresolved == 4
    terms = {(r.symbol_id, r.field, r.term) for r in index.derived_terms(refs, resolved, imports.withColumn("owner", F.lit(None).cast("long")), symbols).collect()}
    assert (4, "callee", "run") in terms and (1, "caller", "new") in terms and (6, "import", "go") in terms


def test_violations_find_nothing_in_a_sound_index(spark):
    s = spark.createDataFrame([(0, "load_token", "m::load_token", "src/m.rs", 0, 10, None), (1, "Token", "m::Token", "src/m.rs", 12, 20, None)], "symbol_id long, name string, qualified string, path string, start_byte long, end_byte long, parent long")
    post = index.postings(index.term_bags(s, {"name": "name", "qualified": "qualified", "path": "path"}))
    res = spark.createDataFrame([(1, "resolved", 0, 1)], "ref_id long, resolution string, target long, candidates long")
    bad = index.violations(s, post, index.field_lengths(post), res)
    assert bad.agg(F.sum("bad")).first()[0] == 0
    assert index.violations(s.union(s), post, index.field_lengths(post), res).where("bad > 0").count() > 0


def test_scores_are_the_closed_form(spark):
    post = spark.createDataFrame([("name", "token", 1, 1), ("name", "load", 1, 1), ("body", "token", 1, 3), ("body", "token", 2, 1), ("body", "x", 2, 5)], "field string, term string, symbol_id long, tf long")
    lengths = index.field_lengths(post)
    terms = spark.createDataFrame([(9, "token")], "query_id long, term string")
    opened = ranking.streams(post, terms)
    got = {r.symbol_id: r.score for r in ranking.scores(opened, terms, ranking.candidates(opened, terms), lengths, index.corpus_stats(lengths)).collect()}
    idf = lambda n, df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    body = lambda tf, length: 1.5 * idf(2, 2) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / 4.5))
    want = {1: 8 * idf(1, 1) * 2.2 / 2.2 + body(3, 3), 2: body(1, 6)}
    assert got == {k: math.floor(v * 1e6 + 0.5) for k, v in want.items()}


def test_cap_and_tie(spark):
    post = spark.createDataFrame([("name", "a", k, 1) for k in range(70)], "field string, term string, symbol_id long, tf long")
    lengths = index.field_lengths(post)
    terms = spark.createDataFrame([(1, "a")], "query_id long, term string")
    opened = ranking.streams(post, terms)
    cands = ranking.candidates(opened, terms)
    assert ranking.cap_cut_a_tie(cands).first().cut
    assert ranking.scores(opened, terms, cands, lengths, index.corpus_stats(lengths)).count() == 64
    e = ranking.evidence(opened, terms).first()
    assert (e.union_size, e.scored, e.dropped, e.terms) == (70, 64, 6, 1)


def test_margin_just_below_a_whole_number(spark):
    score = 30_000_001
    gap = -pow(10**6, -1, score) % score
    rows = spark.createDataFrame([(1, 1, score, "a", "x"), (1, 2, score - gap, "b", "y")], "query_id long, symbol_id long, score long, path string, name string")
    assert ranking.ranked(rows).where("rank = 1").first().margin_ppm == gap * 10**6 // score


def test_decisions(spark):
    rows = [(1, 10, 40_000_000, 1, 1_000_000), (2, 11, 30_800_000, 1, 100), (2, 12, 30_790_000, 2, 0), (3, 13, 1000, 1, 1_000_000)]
    top = spark.createDataFrame(rows, "query_id long, symbol_id long, score long, rank int, margin_ppm long")
    asked = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "query_id long")
    got = {r.query_id: (r.decision, r.reason, r.answers) for r in ranking.decide(top, asked).collect()}
    assert got == {1: ("direct", None, [10]), 2: ("candidates", None, [11, 12]), 3: ("none", "low-confidence", []), 4: ("none", "not-found", [])}
    with pytest.raises(ValueError):
        ranking.Profile(k1=0)
    with pytest.raises(ValueError):
        ranking.Profile().accepts("other")


def test_calibration(spark):
    cases = spark.createDataFrame([("a", True, 50), ("a", False, 10), ("b", True, 40), ("b", False, 20), ("c", True, 45), ("c", False, 15)], "repo string, answerable boolean, score long")
    fit = quality.fit_thresholds(cases).first()
    assert fit["right"] == 6 and 20 < fit.none_below <= 40
    assert [r["right"] for r in quality.leave_one_out(cases, "repo").orderBy("repo").collect()] == [2, 2, 2]
    out = quality.outcomes(spark.createDataFrame([(True, "direct", 1), (True, "candidates", 2), (False, "none", None), (False, "direct", None)], "answerable boolean, decision string, accepted_rank long")).first()
    assert (out.mrr_ppm, out.correct_directs, out.wrong_directs, out.correct_abstentions) == (750_000, 1, 1, 1)
    assert quality.decode_strict('{"a": 1}', {"a": int}) == {"a": 1}
    for bad in ('{"a": 1, "b": 2}', '{"a": 1} x', '{"a": true}', "[]"):
        with pytest.raises(ValueError):
            quality.decode_strict(bad, {"a": int})


def _shuffled(spark, run):
    """Rows that all stages of run() write to shuffles."""
    jvm, sc = spark._jvm, spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    before = {stages().apply(k).stageId() for k in range(stages().size())}
    out = run()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    done = stages()
    return out, sum(done.apply(k).shuffleWriteRecords() for k in range(done.size()) if done.apply(k).stageId() not in before)


REFERENCES = "ref_id long, file string, module array<string>, owner long, name string, qualified string, kind string"
IMPORTS = "file string, module array<string>, path string, leaf string, alias string, kind string, is_glob boolean"


def test_shared_names_are_not_multiplied(spark):
    n = 1000
    symbols = spark.createDataFrame([(k, "a.rs", ["a"], None, "run", "a::run") for k in range(n)] + [(n + k, "a.rs", ["a"], 0, "go", "a::run::go") for k in range(n)], SYMBOLS)
    refs = [(4 * k, "a.rs", ["a"], None, "run", "crate::a::run", "call") for k in range(n)] + [(4 * k + 1, "b.rs", ["b"], None, "alias", None, "call") for k in range(n)]
    refs += [(4 * k + 2, "a.rs", ["a"], 0, "go", None, "call") for k in range(n)] + [(4 * k + 3, "a.rs", ["a"], None, "run", None, "call") for k in range(n)]
    imports = spark.createDataFrame([("b.rs", ["b"], "crate::a::run", "run", "alias", "use", False)], IMPORTS)
    rows, shuffled = _shuffled(spark, lambda: index.resolve(spark.createDataFrame(refs, REFERENCES), symbols, imports).collect())
    assert sorted((r.ref_id, r.resolution, r.target, r.candidates) for r in rows) == [(k, "ambiguous", None, n) for k in range(4 * n)]
    assert shuffled < 100 * n


def test_resolution_by_brute_force(spark):
    """Several rows of a ref_id, several names of a symbol and several paths of an import unite distinct symbols."""
    import random

    rng = random.Random(7)
    for _ in range(2):
        symbols = [(k, f"f{k % 3}", [f"m{rng.randrange(3)}"], rng.choice([None, *range(k)]) if k else None, f"n{rng.randrange(4)}") for k in [*range(40), *rng.choices(range(40), k=20)]]
        parent = {}
        symbols = [(k, f, m, parent.setdefault(k, p), n, f"{m[0]}::{n}") for k, f, m, p, n in symbols]
        refs = [(rng.randrange(150), f"f{rng.randrange(3)}", [f"m{rng.randrange(3)}"], rng.choice([None, rng.randrange(40)]), f"n{rng.randrange(6)}", rng.choice([None, None, None, f"crate::m{rng.randrange(4)}::n{rng.randrange(4)}"]), rng.choice(["call", "call", "type", "method"])) for _ in range(300)]
        imports = [(f"f{rng.randrange(3)}", ["top"], f"crate::m{rng.randrange(4)}::n{rng.randrange(4)}", f"n{rng.randrange(6)}", rng.choice([None, f"n{rng.randrange(6)}"]), rng.choice(["use", "include"]), rng.random() < 0.2) for _ in range(12)]

        def hits(r):
            _, file, module, owner, name, qualified, kind = r
            if kind == "method":
                return
            if qualified:
                yield from ((1, s[0]) for s in symbols if f"crate::{s[5]}" == qualified)
                return
            for i in imports:
                if i[0] == file and name in (i[3], i[4]) and i[5] == "use" and not i[6]:
                    yield from ((2, s[0]) for s in symbols if f"crate::{s[5]}" == i[2])
            yield from ((999, s[0]) for s in symbols if s[3] is None and (s[2], s[4]) == (module, name))
            at, depth = owner, 0
            while at is not None:
                yield from ((3 + depth, s[0]) for s in symbols if s[3] == at and s[4] == name)
                at, depth = parent[at], depth + 1

        want = []
        every = {}
        for r in refs:
            every.setdefault(r[0], []).extend(hits(r))
        for r in refs:
            ids = {t for s, t in every[r[0]] if s == min(every[r[0]])[0]}
            want.append((r[0], r[6], "resolved" if len(ids) == 1 else "ambiguous" if ids else "unresolved", next(iter(ids)) if len(ids) == 1 else -1, len(ids)))
        got = index.resolve(spark.createDataFrame(refs, REFERENCES), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(imports, IMPORTS), ["kind"]).collect()
        assert sorted((r.ref_id, r.kind, r.resolution, -1 if r.target is None else r.target, r.candidates) for r in got) == sorted(want)
