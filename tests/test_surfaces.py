"""Scopes, learned answers, checks, extraction, sources, store."""

import pytest
from pyspark.sql import functions as F

from loomdex import extract
from loomdex.operators import checks, quality, routes, scopes
from loomdex.sources import store, synthetic, tree


def test_page_planner():
    fit = {"api": [10, 10], "tests": [5], "children": [5]}
    assert scopes.plan_page(fit, 100, 0) == {"api": 2, "tests": 1, "children": 1}
    big = {"api": [100] * 20, "tests": [100] * 20, "children": [10] * 3}
    kept = scopes.plan_page(big, 300, 100)
    cost = sum(sum(big[s][: kept[s]]) + (48 if kept[s] < len(big[s]) else 0) for s in big)
    assert cost <= 4 * 300 - 100 and kept["children"] == 3 and kept["api"] >= kept["tests"] > 0
    assert scopes.plan_page(big, 0, 0) == {"api": 0, "tests": 0, "children": 0}


def test_pages_and_map(spark):
    rows = spark.createDataFrame([("d", "api", k, 100) for k in range(20)] + [("d", "tests", 0, 50)], "scope string, section string, place long, bytes long")
    got = {r.section: (r.kept, r.total) for r in scopes.pages(rows, 300).collect()}
    assert got["tests"] == (1, 1) and 0 < got["api"][0] < 20 == got["api"][1]
    page = scopes.render_map("a/b", "loads tokens", [{"qualified": "a::f", "kind": "function"}], [], ["a/b/c"], {"api": 3})
    assert scopes.parse_map(page)["purpose"] == "loads tokens" and "3 more" in page
    with pytest.raises(ValueError):
        scopes.parse_map(page.replace("loads", "eats"))


def test_generation_states(spark):
    planned = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "path string, digest string")
    present = spark.createDataFrame([("a", "1", True), ("b", "2", True), ("d", "1", False), ("e", "1", True)], "path string, digest string, owned boolean")
    assert {r.path: r.state for r in scopes.compare_generation(planned, present).collect()} == {"a": "fresh", "b": "stale", "c": "missing", "d": "conflict", "e": "removable"}


def test_api_hash_ignores_lines(spark):
    cols = "path string, name string, qualified string, kind string, visibility string, signature string, start_line long, is_test boolean"
    a = spark.createDataFrame([("s/x.rs", "f", "f", "function", "public", "fn f()", 1, False), ("s/x.rs", "t", "t", "function", "public", None, 9, True), ("s/x.rs", "p", "p", "function", "private", None, 9, False)], cols)
    files = spark.createDataFrame([("s/x.rs", False), ("s/tests.rs", True)], "path string, is_test_file boolean")
    api, tests = scopes.records(a, files)
    assert [r.qualified for r in api.collect()] == ["f"] and [(r.path, r.name) for r in tests.collect()] == [("s/tests.rs", None), ("s/x.rs", "t")]
    moved, _ = scopes.records(a.withColumn("start_line", F.col("start_line") + 7), files)
    assert scopes.corpus_identity(scopes.api_hashes(api)) == scopes.corpus_identity(scopes.api_hashes(moved))


def test_routes(spark):
    rows = [(f"k{n:04d}", "a", "m", "i", 0.5 if n else 0.25) for n in range(1030)]
    r = spark.createDataFrame(rows, routes.SCHEMA)
    kept = routes.evict(r)
    assert kept.count() == 1024 and kept.where("key = 'k0000' or key > 'k1024'").count() == 0
    text = routes.render(r)
    assert len(routes.parse(text)) == 1024
    for bad in (text[1:], text + "x", text.replace("0.500000", "1.500000", 1), text + "k0001\ta\tm\ti\t0.5\n", text.replace("\ta\t", "\t", 1)):
        with pytest.raises(ValueError):
            routes.parse(bad)
    new = spark.createDataFrame([("k0001", "b", "m", "i", 0.9, 1), ("k0001", "c", "m", "i", 0.8, 2)], routes.SCHEMA + ", seq long")
    assert routes.upsert(r, new).where("key = 'k0001'").first().anchor == "c"
    assert routes.reconcile(r, spark.createDataFrame([("a",)], "anchor string"), spark.createDataFrame([("m", "j")], "map string, api_identity string")).count() == 0


def test_checks(spark):
    none = spark.createDataFrame([], "path string")
    assert checks.counts(checks.emit(none, "0004_SNAPSHOT_STALE", "x")).first().exit_code == 0
    one = spark.createDataFrame([("a",)], "path string")
    assert checks.counts(checks.emit(one, "0004_SNAPSHOT_STALE", "x")).first().exit_code == 1
    assert checks.counts(checks.union(checks.emit(one, "0004_SNAPSHOT_STALE", "x"), checks.emit(one, "0102_MAP_INVALID", "x"))).first().exit_code == 3
    gone = checks.counts(checks.emit(one, "0001_SNAPSHOT_MISSING", "x")).first()
    assert (gone.fatal, gone.status, gone.exit_code) == (1, "snapshot-missing", 4)
    assert len(checks.RULES) == 18 and not set(checks.RULES) & set(checks.RESERVED)
    assert '"warnings": 1' in checks.render_json(checks.emit(one, "0004_SNAPSHOT_STALE", "x"))


def test_every_rule_has_an_emitter(spark):
    seen = spark.createDataFrame([("a", "missing", None), ("b", "bad-magic", None), ("c", "lexical-mismatch", None), ("d", "ready", "stale"), ("e", "ready", "fresh"), ("f", "missing", "stale"), ("g", None, None)], "path string, outcome string, label string")
    states = spark.createDataFrame([("a", "missing", None), ("b", "stale", None), ("c", "conflict", "frontmatter"), ("d", "conflict", None), ("e", "fresh", None)], "path string, state string, reason string")
    pages = spark.createDataFrame([("s", "api", True), ("s", "tests", True), ("t", "api", False)], "scope string, section string, over boolean")
    ignores = spark.createDataFrame([("i", "managed-ignore"), ("j", None)], "path string, reason string")
    faults = spark.createDataFrame([("r", "header"), ("q", None)], "path string, fault string")
    cache = spark.createDataFrame([("x", "corrupt"), ("y", "hit")], "path string, outcome string")
    learned = spark.createDataFrame([("k", "gone", "m", "old", 0.5)], routes.SCHEMA)
    anchors, ids = spark.createDataFrame([("a",)], "anchor string"), spark.createDataFrame([("m", "new")], "map string, api_identity string")
    every = checks.union(
        checks.snapshot_diagnostics(seen), checks.artifact_diagnostics(states, "map"), checks.artifact_diagnostics(states, "symbols"), checks.budget_diagnostics(pages),
        checks.ignore_diagnostics(ignores), checks.fault_diagnostics(faults), checks.cache_diagnostics(cache), checks.route_diagnostics(learned, anchors, ids),
    )
    got = [r.rule_id for r in checks.ordered(every).collect()]
    assert set(got) == set(checks.RULES) and got[:2] == ["0001_SNAPSHOT_MISSING"] * 2 and got.count("0104_MAP_OVER_BUDGET") == 1


def test_conflicts(spark):
    page = scopes.render_map("a", "loads tokens", [], [], [])
    cases = {
        None: page, "symlink": page, "unreadable": None, "merge-conflict": page + "<<<<<<< ours\n", "not-owned": "# a\n", "frontmatter": page.replace("digest", "sum"),
        "unsupported-format": page.replace("format: 2", "format: 1"), "purpose": scopes.render_map("a", "x" * 161, [], [], []), "generated-edited": page.replace("loads", "eats"),
    }
    df = spark.createDataFrame([(why, text, why == "symlink") for why, text in cases.items()], "why string, text string, link boolean")
    assert all(r.why == r.got for r in df.select("why", scopes.conflict_reason("text", F.col("link")).alias("got")).collect())
    first, last = scopes.BLOCK
    blocks = spark.createDataFrame([(f"{first}\nx\n{last}", None), ("x", None), ("", None), (f"{first}\n", "managed-ignore"), (f"{last}\n{first}", "managed-ignore"), (f"{first}\n{last}\n{first}\n{last}", "managed-ignore")], "text string, why string")
    assert all(r.why == r.got for r in blocks.select("why", scopes.ignore_reason("text").alias("got")).collect())
    planned, present = spark.createDataFrame([("A/MAP.md", "1")], "path string, digest string"), spark.createDataFrame([("a/map.md", "1", True)], "path string, digest string, owned boolean")
    assert {(r.path, r.state, r.reason) for r in scopes.compare_generation(planned, present).collect()} == {("A/MAP.md", "conflict", "case-collision"), ("a/map.md", "removable", None)}


def test_index_hash_sees_lines(spark):
    rows = spark.createDataFrame([("s", "f", 1), ("s", "g", 2)], "scope string, qualified string, start_line long")
    one = scopes.index_hash(512, "complete", {"api": rows})
    assert one == scopes.index_hash(512, "complete", {"api": rows.orderBy(F.desc("start_line")).select("start_line", "scope", "qualified")})
    assert len({one, scopes.index_hash(513, "complete", {"api": rows}), scopes.index_hash(512, "tags", {"api": rows}), scopes.index_hash(512, "complete", {"api": rows.withColumn("start_line", F.col("start_line") + 1)}), scopes.index_hash(512, "complete", {"tests": rows})}) == 5


def test_release_gate_without_evidence(spark):
    verdicts = spark.range(40).select(F.lit("answerable").alias("expectation"), F.lit(True).alias("direct_permitted"), F.lit(True).alias("answered_direct"), F.lit(1).alias("accepted_rank"), F.lit(None).cast("int").alias("forbidden_rank"))
    m, ok, fast = quality.routing_metrics(verdicts), spark.sql("select true as passed"), spark.sql("select false as blocked")
    of = lambda *a: {r.failure for r in quality.release_gate(*a).collect()}
    assert of(m, ok, fast) == set() and of(m, ok, fast, 41) == set() and of(m, ok, fast, 42) == {"top1-regressed-beyond-slack"}
    assert of(m, ok.limit(0), fast) == of(m, ok, fast.limit(0)) == of(m.limit(0), ok, fast) == {"evidence-missing"}
    assert of(quality.routing_metrics(verdicts.limit(39)), spark.sql("select cast(null as boolean) as passed"), fast) == {"oracle-under-sized", "safety-case-failed"}


RUST = '''//! top
use crate::{auth::{self, Token as Tok}, db::*};
/// Loads it.
#[inline]
pub fn load(x: &str) -> u32 { helper(x); x.len(); crate::db::open("fn fake() {"); 1 }
struct Point { x: u32 }
impl Point { pub(crate) fn new() -> Self { Point { x: 1 } } }
impl Display for Point { fn fmt(&self) {} }
#[cfg(test)]
mod tests { #[test] fn works() { assert!(true); } fn util() {} }
'''


def test_rust_facts():
    facts = extract.facts_of("src/a.rs", "rust", RUST.encode())
    defs = {f["qualified"]: f for f in facts if f["fact"] == "definition"}
    assert {q: (f["kind"], f["visibility"], f["is_test"]) for q, f in defs.items()} == {
        "load": ("function", "public", False), "Point": ("struct", "private", False), "Point::new": ("method", "restricted:crate", False),
        "<Point as Display>::fmt": ("method", "public", False), "tests": ("module", "private", True), "tests::works": ("function", "private", True), "tests::util": ("function", "private", True),
    }
    assert defs["load"]["documentation"] == "Loads it." and defs["load"]["signature"] == "pub fn load(x: &str) -> u32"
    assert {(f["import_path"], f["alias"], f["is_glob"]) for f in facts if f["fact"] == "import"} == {("crate::auth", None, False), ("crate::auth::Token", "Tok", False), ("crate::db", None, True)}
    calls = {(f["name"], f["kind"], f.get("qualified")) for f in facts if f["fact"] == "reference"}
    assert {("helper", "call", None), ("len", "method", None), ("open", "call", "crate::db::open"), ("assert", "macro", None)} <= calls and not any(n == "fake" for n, *_ in calls)
    assert facts[0]["status"] == "complete" and extract.facts_of("a.rs", "rust", b"fn f( {")[0]["status"] == "recovered"


def test_python_facts():
    text = 'import os.path as p\nfrom .a import b, c as d\nX = 1\nclass T(Base):\n    """Doc."""\n    y = 2\n    def __init__(self): pass\n    @property\n    def _go(self, é=1): return run(self.x.stop())\nasync def f(): pass\n'
    facts = extract.facts_of("m.py", "python", text.encode())
    defs = {f["qualified"]: f for f in facts if f["fact"] == "definition"}
    assert {q: f["kind"] for q, f in defs.items()} == {"X": "constant", "T": "class", "T.y": "field", "T.__init__": "constructor", "T._go": "method", "f": "function"}
    assert defs["T"]["documentation"] == "Doc." and defs["T._go"]["visibility"] == "private" and defs["T._go"]["owner"] == defs["T"]["idx"]
    assert {(f["import_path"], f["alias"]) for f in facts if f["fact"] == "import"} == {("os.path", "p"), (".a.b", None), (".a.c", "d")}
    raw = text.encode()
    assert all(raw[f["start_byte"] : f["end_byte"]].decode() for f in facts if f["fact"] != "file")
    assert extract.facts_of("m.py", "python", b"def (")[0]["status"] == "degraded"


@pytest.mark.parametrize(
    "lang,text,want",
    [
        ("typescript", "import {a} from 'x/y';\nexport class A { private go(b: string): void { c(); } }\nconst f = (x) => x;\n", {("A", "class"), ("A.go", "method"), ("f", "function")}),
        ("go", 'import "fmt"\ntype T struct { a int }\nfunc (t *T) Run() { fmt.Println() }\nfunc main() {}\n', {("T", "struct"), ("Run", "method"), ("main", "function")}),
        ("java", "import a.b.C;\npublic class A { public A() { } int go(int x) { return x; } }\n", {("A", "class"), ("A.go", "method")}),
        ("c", "#include <x.h>\nint add(int a, int b) { return a; }\nstruct P { int x; };\n", {("add", "function"), ("P", "struct")}),
        ("ruby", "require 'x'\nclass A\n  def go(x)\n  end\nend\n", {("A", "class"), ("A.go", "method")}),
        ("swift", "import Foundation\nstruct S { func go() { } }\n", {("S", "struct"), ("S.go", "method")}),
        ("php", "<?php\nuse A\\B;\nclass C { public function go($x) { } }\n", {("C", "class"), ("C.go", "method")}),
        ("lua", "local x = require('y')\nlocal function go(a)\n  return a\nend\n", {("go", "function")}),
        ("csharp", "using System.Text;\npublic class A { public void Go(int x) { } }\n", {("A", "class"), ("A.Go", "method")}),
    ],
)
def test_tag_facts(lang, text, want):
    facts = extract.facts_of("f", lang, text.encode())
    assert want <= {(f["qualified"], f["kind"]) for f in facts if f["fact"] == "definition"}
    assert any(f["fact"] == "import" for f in facts) and facts[0]["status"] == "tags"


def test_generated_tree_end_to_end(spark, tmp_path):
    src = synthetic.generate(spark, 5, 12)
    assert src.count() == 14 and sorted(r.path for r in src.collect()) == sorted(r.path for r in synthetic.generate(spark, 5, 12).collect())
    for r in src.collect():
        p = tmp_path / "t" / r.path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(bytes(r.content))
    (tmp_path / "t/target").mkdir()
    (tmp_path / "t/target/x.rs").write_text("fn x() {}")
    found = tree.discover(tree.read_tree(spark, f"file://{tmp_path}/t"), globs=["m0000*.rs", "!src/m00003.rs"])
    paths = [r.path for r in found.collect()]
    assert paths == ["src/lib.rs", "src/m00003.rs", "src/m00010.rs", "src/m00011.rs"]
    facts = extract.extract(src.withColumn("lang", F.when(F.col("path").endswith(".rs"), "rust")))
    assert extract.invalid(facts).count() == 0 and extract.symbols(facts).where("qualified = 'm00003::helper_3'").count() == 1
    assert extract.status_counts(facts).first().files == 13
    assert extract.invalid_spans(facts, src).count() == 0
    assert extract.invalid_spans(facts.withColumn("end_byte", F.col("end_byte") + 10**6), src).where("problem = 'bounds'").count() > 0
    assert [extract.span_problem("é\nx".encode(), *a) for a in ((0, 2, 1, 1), (1, 2, 1, 1), (3, 4, 1, 1), (3, 4, 2, 2))] == [None, "character", "lines", None]
    oid = spark.createDataFrame([(b"hello\n",)], "c binary").select(tree.blob_oid(F.col("c")).alias("o")).first().o
    assert oid == "ce013625030ba8dba906f756967f9e9ca394464a"
    with pytest.raises(Exception, match="not a relative path"):
        spark.createDataFrame([("a/../b",)], "p string").select(tree.normal_path("p")).collect()
    assert spark.createDataFrame([("./a/./b",)], "p string").select(tree.normal_path("p")).first()[0] == "a/b"
    with pytest.raises(ValueError):
        tree.glob_regex("[a")


def test_store(spark, tmp_path):
    root, t = f"file://{tmp_path}/i", {"a": spark.range(5), "b": spark.sql("select 'x' as k, 1 as v")}
    with pytest.raises(ValueError, match="missing"):
        store.load(spark, root)
    assert store.publish(spark, root, t, "s") and not store.publish(spark, root, t, "s")
    assert store.load(spark, root, verify=True)["a"].count() == 5
    with pytest.raises(ValueError, match="incompatible"):
        store.load(spark, root, stamp="other")
    now = store.load(spark, root)["b"].inputFiles()[0].removeprefix("file://")
    spark.sql("select 'y' as k, 2 as v").coalesce(1).write.mode("overwrite").parquet(now.rpartition("/")[0])
    with pytest.raises(ValueError, match="corrupt"):
        store.load(spark, root, verify=True)
    assert store.publish(spark, root, {**t, "a": spark.range(6)}) and store.load(spark, root)["a"].count() == 6
    files = spark.createDataFrame([("o1", "rust"), ("o2", "rust")], "oid string, lang string")
    facts = spark.createDataFrame([("o1", "rust", "x", 1)], "oid string, lang string, extractor string, schema int")
    hit, miss = store.split_by_cache(files, facts, "x")
    assert [r.oid for r in hit.collect()] == ["o1"] and [r.oid for r in miss.collect()] == ["o2"]
