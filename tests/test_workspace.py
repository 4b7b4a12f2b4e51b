import pytest

from loomdex.plans import reports
from loomdex.plans import workspace as w
from loomdex.sources import vcs

FILES = {
    "src/lib.rs": "pub mod auth;\npub mod store;\n",
    "src/auth.rs": "/// Verifies a bearer token.\npub fn verify_token(raw: &str) -> bool { check(raw) }\n\nfn check(raw: &str) -> bool { raw.len() > 3 }\n",
    "src/store.rs": "use crate::auth::verify_token;\npub struct Store;\nimpl Store {\n    pub fn open() -> Store { verify_token(\"x\"); Store }\n    pub fn close() {}\n}\n",
    "src/other.rs": "pub fn open() {}\n",
    "tests/flow.rs": "use crate::store::Store;\n#[test]\nfn opens() { crate::auth::verify_token(\"a\"); }\n",
}


def frame(spark, files):
    return spark.createDataFrame([(p, c.encode()) for p, c in files.items()], "path string, content binary")


@pytest.fixture(scope="module")
def built(spark):
    return w.Index.build(frame(spark, FILES))


def test_answers(spark, built, tmp_path):
    a = built.ask("verify_token")
    assert a["status"] == "direct" and a["anchor"] == {"path": "src/auth.rs", "symbol": "verify_token", "lines": [1, 2]} and w.exit_code(a) == 0
    assert built.ask("store::Store::open?")["anchor"]["path"] == "src/store.rs"
    assert built.ask("src/other.rs")["anchor"] == {"path": "src/other.rs", "symbol": None, "lines": None}
    b = built.ask("open")
    assert b["status"] == "candidates" and {c["anchor"]["path"] for c in b["candidates"]} == {"src/store.rs", "src/other.rs"} and w.exit_code(b) == 2
    assert built.ask("open", path="src/other.rs")["anchor"]["path"] == "src/other.rs"
    assert built.ask("verify_token", path="src/other.rs")["status"] == "none"
    c = built.ask("where is a bearer token verified?")
    assert c["pipeline"] == "lexical"
    assert w.exit_code(built.ask("zebra quagga")) == 3 and "not-found" in w.render_text(built.ask("zebra quagga"))
    for bad in (lambda: built.ask("  "), lambda: built.ask("open", path="nowhere.rs")):
        with pytest.raises(ValueError):
            bad()
    assert built.publish(f"file://{tmp_path}/i") and not built.publish(f"file://{tmp_path}/i")
    assert w.render_json(w.Index.open(spark, f"file://{tmp_path}/i").ask("verify_token")) == w.render_json(a)


def test_impact(spark):
    new = dict(FILES)
    new["src/auth.rs"] = FILES["src/auth.rs"].replace("> 3", "> 4")
    new["src/fresh.rs"] = "pub fn fresh() {}\n"
    r = w.impact(frame(spark, FILES), frame(spark, new))
    assert {(x.path, x.change) for x in r["changed_files"].collect()} == {("src/auth.rs", "modified"), ("src/fresh.rs", "added")}
    assert {(x.qualified, x.change) for x in r["changed_definitions"].collect()} == {("auth::check", "modified"), ("fresh::fresh", "added")}
    assert {(x.node, x.distance) for x in r["affected"].collect()} == {("src/auth.rs#auth::verify_token", 1), ("src/store.rs#store::Store::open", 2), ("tests/flow.rs#tests::flow::opens", 2), ("src/store.rs#", 2)}
    assert ("src/store.rs#", "src/auth.rs#auth::verify_token", "import") in {(x.source, x.target, x.kind) for x in w.impact(frame(spark, FILES), frame(spark, {**new, "src/auth.rs": FILES["src/auth.rs"].replace("check(raw) }", "!check(raw) }")}))["direct_edges"].collect()}
    assert {(x.path, x.resolved, x.unresolved_calls, x.unresolved_imports) for x in r["resolution"].collect()} == {("src/auth.rs", 1, 0, 0)}
    assert [(x.path, x.confidence, x.reasons) for x in r["tests"].collect()] == [("tests/flow.rs", "exact", ["affected-test"])]
    assert r["cycles"].count() == 0 and r["status"] == "complete"
    report = reports.impact_report(r, 1)
    assert report["affected"]["shown"] == 1 and report["affected"]["total"] == 4 and report["tests"]["rows"][0]["path"] == "tests/flow.rs"
    assert '"status": "complete"' in reports.render(report)
    assert w.impact(frame(spark, FILES), frame(spark, FILES), 1)["affected"].count() == 0


def test_discovery_rules_the_index(spark):
    files = {"a.py": "def one(): pass\n", "node_modules/z.js": "function two() {}\n", ".gitignore": "c.py\nout/\n", "c.py": "def three(): pass\n", "out/d.py": "def four(): pass\n", "sub/.gitignore": "*.py\n!keep.py\n", "sub/e.py": "def five(): pass\n", "sub/keep.py": "def six(): pass\n"}
    i = w.Index.build(frame(spark, files))
    assert {x.name for x in i.symbols.select("name").collect()} == {"one", "six"}
    later, report = i.refresh(frame(spark, {**files, ".gitignore": "out/\n"}))
    assert report["mode"] == "full" and {x.name for x in later.symbols.select("name").collect()} == {"one", "three", "six"}


def test_lexical_evidence(spark):
    old = {"src/a.py": "def load_widget():\n    return 1\n", "tests/test_b.py": "def test_widget_shape():\n    pass\n"}
    r = w.impact(frame(spark, old), frame(spark, {**old, "src/a.py": "def load_widget():\n    return 2\n"}))
    assert [(x.path, x.confidence, x.reasons) for x in r["tests"].collect()] == [("tests/test_b.py", "probable", ["lexical-name"])]


def test_source_and_explain(spark, built):
    a = built.ask("verify_token")
    s = built.source(a, frame(spark, FILES))
    assert s["status"] == "served" and s["lines"] == [1, 5] and "bearer" in s["text"]
    assert built.source(a, frame(spark, {**FILES, "src/auth.rs": "x"})) == {"status": "changed"}
    assert built.source(a, frame(spark, {"src/lib.rs": "x"})) == {"status": "missing"}
    e = built.explain("verify the token")
    assert e["effective_query_terms"] == 2 and e["candidates_dropped"] == 0 < e["posting_hits_scanned"] and built.explain("zebra") is None


def rows(df):
    return sorted(str(r) for r in df.collect())


def test_refresh_equals_build(spark, built):
    """Incremental and full builds of an edited tree are the same tables."""
    new = dict(FILES)
    new["src/auth.rs"] = FILES["src/auth.rs"] + "\npub fn forget(raw: &str) { check(raw); }\n"
    new["src/renamed.rs"] = new.pop("src/other.rs")
    new.pop("tests/flow.rs")
    new["src/py.py"] = "def go():\n    run()\n"
    got, report = built.refresh(frame(spark, new))
    want = w.Index.build(frame(spark, new))
    for t in w.Index.TABLES:
        cols = sorted(getattr(want, t).columns)
        assert rows(getattr(got, t).select(cols)) == rows(getattr(want, t).select(cols)), t
    assert (report["mode"], report["reparsed"], report["cached"], report["removed"], report["renamed"]) == ("incremental", 3, 2, 1, 1)
    same, quiet = got.refresh(frame(spark, new))
    assert same is got and quiet["mode"] == "no-op" and not quiet["snapshot_updated"]


def test_working_tree_state(spark):
    out = b"1 .M N... 100644 100644 100644 a b src/a b.rs\x001 A. N... 0 1 1 a b new.rs\x002 R. N... 1 1 1 a b R100 to.rs\x00from.rs\x00u UU N... 1 1 1 1 a b c both.rs\x00? loose.txt\x001 .M S.M. 1 1 1 a b sub\x00"
    got, skipped = vcs.parse_status(out)
    assert skipped == 1 and got == [("unstaged", "src/a b.rs", None), ("staged", "new.rs", None), ("renamed", "to.rs", "from.rs"), ("conflicted", "both.rs", None), ("untracked", "loose.txt", None)]
    df = vcs.status_frame(spark, out)
    assert vcs.state_label(df) == "conflicted" and vcs.state_label(df.where("false")) == "clean"
    here = spark.createDataFrame([("src/a b.rs",), ("to.rs",)], "path string")
    assert {(r.path, r.action) for r in vcs.refresh_changes(df, here).collect()} == {("src/a b.rs", "recheck"), ("new.rs", "remove"), ("to.rs", "rename"), ("both.rs", "remove"), ("loose.txt", "remove")}
    d = spark.createDataFrame([("a/.gitignore", None)], "path string, source string")
    assert vcs.rules_touched(d) and not vcs.rules_touched(d.selectExpr("'x' as path", "source"))
    t = spark.createDataFrame([("a", "1")], "path string, oid string")
    assert vcs.unchanged(t, t) and not vcs.unchanged(t, t.where("false"))


def test_findings(spark):
    f = reports.findings(spark.createDataFrame([("false-directs",)], "failure string"), "m")
    assert [x["rule_id"] for x in reports.adjudicate(reports.render(f), "m")] == ["0505_FALSE_DIRECT"]
    for bad in (("n", reports.render(f)), ("m", reports.render(f).replace("0505_FALSE_DIRECT", "0999_X"))):
        with pytest.raises(ValueError):
            reports.adjudicate(bad[1], bad[0])
