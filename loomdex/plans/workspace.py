"""End to end: files to an index, a question to an answer, two versions of a tree to an impact report."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import extract
from ..functions import languages, lexing
from ..operators import delta, exact, graph, index, ranking, spans
from ..sources import store, tree
from ..sources.lineage import cut
from . import reports

TEXT_FIELDS = {"name": "name", "qualified": "qualified", "path": "path", "signature": "signature", "body": "body_text", "documentation": "documentation", "attribute": "attribute_text"}
# Exit codes of an answer and of an impact report.
EXIT = {"direct": 0, "candidates": 2, "none": 3, "refused": 4}
IMPACT_EXIT = {"complete": 0, "partial": 1}


@dataclass
class Index:
    """The tables of one version of a tree."""

    symbols: DataFrame
    references: DataFrame
    imports: DataFrame
    resolved: DataFrame
    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    files: DataFrame
    facts: DataFrame

    TABLES = ("symbols", "references", "imports", "resolved", "postings", "lengths", "stats", "files", "facts")

    @property
    def statuses(self) -> DataFrame:
        """path, status of every file that was read."""
        return self.facts.where("fact = 'file'").select("path", "status")

    @classmethod
    def build(cls, files: DataFrame) -> Index:
        """From a tree (path, content): what discovery lets in, each file with facts of its language's extractor."""
        facts = cut(extract.extract(tree.discover(files).select("path", "content", "lang")))
        return cls.of_facts(facts, files.select("path", tree.blob_oid(F.col("content")).alias("oid")))

    @classmethod
    def of_facts(cls, facts: DataFrame, files: DataFrame) -> Index:
        """From extracted facts, kept ones and new ones alike."""
        s = extract.symbols(facts)
        for c in ("name", "qualified", "signature", "documentation"):
            s = s.withColumn(c, lexing.nfc(c))  # as terms are compared composed
        s = s.withColumn("body_text", F.array_join("body", " ")).withColumn("attribute_text", F.array_join("attributes", " "))
        s = cut(index.dense_ids(s, ["path", "start_byte", "end_byte", "kind", "name", "idx"]))
        ids = s.select("path", "idx", "symbol_id")
        owner = ids.select("path", F.col("idx").alias("owner"), F.col("symbol_id").alias("own"))
        own = s.join(owner, ["path", "owner"], "left").withColumn("parent", F.col("own"))
        symbols = own.select("symbol_id", F.col("path").alias("file"), "path", "lang", "module", "parent", "name", "qualified", "kind", "visibility", "signature", "documentation", "body_text", "attribute_text", "is_test", "start_byte", "end_byte", "start_line", "end_line")
        rest = facts.where("fact in ('reference', 'import')").withColumn("module", languages.module_prefix("path", "lang")).join(owner, ["path", "owner"], "left")
        refs = rest.where("fact = 'reference'").select(F.xxhash64("path", "start_byte", "name", "kind").alias("ref_id"), F.col("path").alias("file"), "module", F.col("own").alias("owner"), "name", "qualified", "kind", F.col("start_line").alias("line"))
        imps = rest.where("fact = 'import'").select(F.col("path").alias("file"), "module", F.col("own").alias("owner"), F.col("import_path").alias("path"), F.col("name").alias("leaf"), "alias", "kind", "is_glob", F.col("start_line").alias("line"))
        symbols, refs = cut(symbols), cut(refs.dropDuplicates(["ref_id"]))
        imps = cut(index.resolve_imports(imps, symbols))
        resolved = cut(index.resolve(refs, symbols, imps))
        bags = index.term_bags(symbols, TEXT_FIELDS).unionByName(index.derived_terms(refs, resolved, imps, symbols))
        post = cut(index.postings(bags))
        lengths = index.field_lengths(post)
        return cls(symbols, refs, imps, resolved, post, lengths, index.corpus_stats(lengths), files, facts)

    def refresh(self, files: DataFrame) -> tuple[Index, dict]:
        """The index of files (path, content) and a report. Facts of unchanged files are kept; only changed ones are read."""
        seen = cut(files.select("path", tree.blob_oid(F.col("content")).alias("oid")))
        as_tree = lambda df: df.withColumn("mode", F.lit("file"))
        d = delta.tree_delta(as_tree(self.files), as_tree(seen))
        action = F.when(F.col("change") == "deleted", "remove").when(F.col("change") == "renamed", "rename").otherwise("recheck")
        plan = cut(delta.refresh_plan(d.select("path", action.alias("action"), "source")))
        if delta.is_no_op(plan):
            return self, reports.refresh_report("no-op", plan, seen.count(), 0, 0, self.statuses, False)
        if not plan.where(tree.is_rule_file("path")).isEmpty():  # other files may count from now on
            return Index.build(files), reports.refresh_report("full", plan, seen.count(), seen.count(), 0, self.statuses, True)
        todo = tree.discover(files).join(plan.where("action <> 'remove'").select("path"), "path", "left_semi")
        fresh = cut(extract.extract(todo.select("path", "content", "lang")))
        new = Index.of_facts(cut(delta.refreshed(self.facts, plan, fresh)), seen)
        return new, reports.refresh_report("incremental", plan, seen.count(), fresh.where("fact = 'file'").count(), new.statuses.count() - fresh.where("fact = 'file'").count(), new.statuses, True)

    def publish(self, root: str, profile: ranking.Profile = ranking.Profile()) -> bool:
        """Writes a version, postings by field; False if it is the current one already."""
        return store.publish(self.symbols.sparkSession, root, {n: getattr(self, n) for n in self.TABLES}, profile.stamp(), {"postings": ["field"]})

    @classmethod
    def open(cls, spark: SparkSession, root: str, profile: ranking.Profile = ranking.Profile()) -> Index:
        return cls(**store.load(spark, root, stamp=profile.stamp()))

    def explain(self, text: str) -> dict | None:
        """What ranking a question touches; None if it has no term of the index."""
        asked = self.symbols.sparkSession.createDataFrame([(1, text)], "query_id long, text string")
        terms = index.known_terms(asked.select("query_id", F.posexplode(lexing.query_terms("text")).alias("pos", "term")), index.vocabulary(self.postings)).select("query_id", "term")
        opened = cut(ranking.streams(self.postings, terms))
        row = ranking.evidence(opened, terms).join(ranking.cap_cut_a_tie(ranking.candidates(opened, terms)), "query_id", "left").na.fill(False, ["cut"]).first()
        if row is None:
            return None
        return {"posting_hits_scanned": row.postings, "candidates_before_cap": row.union_size, "candidates_scored": row.scored, "candidates_dropped": row.dropped, "cap_cut_a_tie": row.cut, "effective_query_terms": row.terms}

    def source(self, answer: dict, files: DataFrame) -> dict:
        """The verified window of a direct answer from files (path, content): its text, or why it isn't served."""
        a = answer["anchor"]
        row = files.where(F.col("path") == a["path"]).select(tree.blob_oid(F.col("content")).alias("oid")).first()
        known = self.files.where(F.col("path") == a["path"]).first()
        if row is None or known is None or row.oid != known.oid:
            return {"status": "missing" if row is None else "changed"}
        lines = files.where(F.col("path") == a["path"]).select(F.col("path").alias("key"), F.posexplode(F.split(F.decode("content", "utf-8"), "\n", -1)).alias("at", "text")).select("key", (F.col("at") + 1).cast("long").alias("line"), "text")
        first, last = a["lines"] or (1, 2**31)
        at = files.sparkSession.createDataFrame([(a["path"], first, last)], "key string, start_line long, end_line long")
        got = spans.window_lines(lines, at).orderBy("line").collect()
        return {"status": "served", "lines": [got[0].line, got[-1].line] if got else None, "text": "\n".join(r.text for r in got)}

    def ask(self, text: str, path: str | None = None, profile: ranking.Profile = ranking.Profile()) -> dict:
        """An answer to one question: exact names first, then ranking; none below a path that has no match."""
        spark, q = self.symbols.sparkSession, exact.parse_question(text)
        asked = spark.createDataFrame([(1, q["raw"], q["words"])], "query_id long, text string, words array<string>")
        if path is not None and self.files.where(F.col("path") == path).isEmpty():
            raise ValueError(f"no such file in the index: {path}")
        routed = cut(exact.with_path(exact.route(exact.atoms(asked, self.files), self.symbols), path))
        how = exact.outcome(routed, asked).first().outcome
        if how == "direct":
            r = routed.first()
            return self._answer("direct", "exact", [(r.symbol_id, r.path)], [1.0])
        if how == "ambiguous":
            carries = self.postings.where(F.col("field").isin(exact.CONTENT_FIELDS)).join(self.symbols.select("symbol_id", "path"), "symbol_id").select("path", "term")
            best = exact.disambiguate(exact.overlaps(routed, asked, self.symbols, carries), self.symbols).orderBy("rank").collect()
            if best and best[0].direct:
                return self._answer("direct", "exact", [(best[0].symbol_id, best[0].path)], [1.0])
            return self._answer("candidates", "exact", [(r.symbol_id, r.path) for r in best], [None] * len(best))
        if path is not None:
            return self._answer("none", "exact", [], [], "not-found")
        terms = asked.select("query_id", F.posexplode(lexing.query_terms("text")).alias("pos", "term"))
        terms = index.known_terms(terms, index.vocabulary(self.postings)).select("query_id", "term")
        top = cut(ranking.rank(self.postings, self.lengths, self.stats, self.symbols.select("symbol_id", "path", "name"), terms, profile))
        d = ranking.decide(top, asked, profile).first()
        at = {r.symbol_id: r.path for r in top.collect()}
        return self._answer(d.decision, "lexical", [(k, at[k]) for k in d.answers], [d.confidence] * len(d.answers), d.reason)

    def _answer(self, kind: str, pipeline: str, found: list, confidence: list, reason: str | None = None) -> dict:
        ids = [k for k, _ in found if k is not None]
        of = {r.symbol_id: r for r in self.symbols.where(F.col("symbol_id").isin(ids)).select("symbol_id", "path", "name", "start_line", "end_line").collect()} if ids else {}
        anchors = [{"path": p, "symbol": None, "lines": None} if k is None else {"path": of[k].path, "symbol": of[k].name, "lines": [of[k].start_line, of[k].end_line]} for k, p in found]
        out = {"schema_version": 1, "status": kind, "pipeline": pipeline}
        if kind == "direct":
            return {**out, "anchor": anchors[0], "confidence": confidence[0]}
        if kind == "candidates":
            return {**out, "candidates": [{"anchor": a, "confidence": c} for a, c in zip(anchors, confidence, strict=True)]}
        return {**out, "reason": reason}


def exit_code(answer: dict) -> int:
    return EXIT[answer["status"]]


def anchor_text(a: dict) -> str:
    """path#symbol with its lines."""
    enc = lambda s: s.replace("%", "%25").replace("#", "%23")
    return enc(a["path"]) + (f"#{enc(a['symbol'])}:{a['lines'][0]}-{a['lines'][1]}" if a["symbol"] else "")


def render_text(answer: dict) -> str:
    if answer["status"] == "direct":
        return f"{anchor_text(answer['anchor'])}\n"
    if answer["status"] == "candidates":
        return "".join(f"? {anchor_text(c['anchor'])}\n" for c in answer["candidates"])
    return f"no answer: {answer['reason']}\n"


def render_json(answer: dict) -> str:
    return json.dumps(answer)


def impact(base: DataFrame, target: DataFrame, depth: int = graph.DEPTH, co_changed: DataFrame | None = None) -> dict:
    """What a change from base to target (trees of path, content) reaches.

    changed_files, changed_definitions, direct_edges, affected, dependencies, cycles, tests, resolution (counts of what the
    changed files name), unfollowed_imports are frames; status is
    partial if a changed file couldn't be read in full. Nodes are path#qualified, path# for a file itself.
    """
    b, t = Index.build(base), Index.build(target)
    tree_of = lambda i: i.files.withColumn("mode", F.lit("file"))
    changed = cut(delta.tree_delta(tree_of(b), tree_of(t)))
    renamed = changed.where("change = 'renamed'").select("path", "source")
    pairs = changed.where("change in ('modified', 'renamed')").withColumn("from", F.coalesce("source", "path"))
    text = lambda df, name, key: df.select(F.col("path").alias(key), F.decode("content", "utf-8").alias(name))
    both = pairs.join(text(base, "old", "from"), "from").join(text(target, "new", "path"), "path").select(F.col("path").alias("key"), "old", "new")
    hunks = cut(delta.hunks(both).select(F.col("key").alias("path"), F.explode("hunks").alias("h")))
    # whole files count where there are no hunks to tell
    bare = changed.where("change in ('added', 'deleted')").select("path", F.struct(F.lit(1).cast("long").alias("old_start"), F.lit(2**40).alias("old_lines"), F.lit(1).cast("long").alias("new_start"), F.lit(2**40).alias("new_lines")).alias("h"))
    every = hunks.unionByName(bare)
    old_path = every.join(renamed, "path", "left").select(F.coalesce("source", "path").alias("file"), F.col("h.old_start").alias("start"), F.col("h.old_lines").alias("lines"))
    defs = lambda i: i.symbols.select("file", F.col("symbol_id").alias("id"), "start_line", "end_line")
    touched_b = spans.touched(defs(b), old_path)
    touched_t = spans.touched(defs(t), every.select(F.col("path").alias("file"), F.col("h.new_start").alias("start"), F.col("h.new_lines").alias("lines")))
    of = lambda i, paths: i.symbols.select("path", F.col("symbol_id").alias("id"), "kind", "qualified", F.col("start_line").alias("start")).join(paths, "path", "left_semi")
    from_paths = changed.select(F.coalesce("source", "path").alias("path")).distinct()
    definitions = delta.classify_definitions(delta.pair_definitions(of(b, from_paths), of(t, changed.select("path").distinct()), renamed), touched_b, touched_t, renamed).where("change is not null")
    definitions = cut(definitions)
    node = lambda p, q: F.concat_ws("#", p, F.coalesce(q, F.lit("")))
    edges = seen = None
    for side, i in (("base", b), ("target", t)):
        names = i.symbols.select(F.col("symbol_id").alias("k"), node("path", F.col("qualified")).alias("node"), F.col("qualified").alias("q"))
        refs = i.references.join(i.resolved.select("ref_id", "resolution", F.col("target").alias("to")), "ref_id").select("file", "owner", "kind", "line", "resolution", "to")
        imps = i.imports.select("file", "owner", F.lit("import").alias("kind"), "line", "resolution", F.col("target").alias("to"))
        said = refs.unionByName(imps)
        hit = said.join(names.select(F.col("k").alias("to"), F.col("node").alias("target")), "to").join(names.select(F.col("k").alias("owner"), F.col("q").alias("mine")), "owner", "left")
        rows = graph.edges_of(hit.select(F.col("file").alias("path"), F.col("mine").alias("owner"), "target", "kind", "line"), side)
        edges = rows if edges is None else edges.unionByName(rows)
        there = changed.where("change = 'deleted'" if side == "base" else "change <> 'deleted'").select(F.col("path").alias("file"))
        mine = said.join(there, "file", "left_semi").select(F.col("file").alias("path"), F.lit(side).alias("endpoint"), "kind", "resolution")
        seen = mine if seen is None else seen.unionByName(mine)
    loose = t.imports.where("resolution = 'unresolved'").join(changed.select(F.col("path").alias("file")), "file", "left_semi")
    merged = cut(graph.merge_edges(edges))
    seeds = definitions.select(node("path", F.col("qualified")).alias("node")).distinct()
    affected = cut(graph.closure(merged, seeds, depth))
    dependencies = cut(graph.closure(merged, seeds, depth, reverse=False))
    # evidence is by file: nodes of test files, whether their symbol is a test or not
    lang = languages.language("path")
    near = affected.union(dependencies).withColumn("path", F.substring_index("node", "#", 1)).where(languages.is_test("path", lang))
    terms = definitions.select(F.explode(lexing.tokens(F.element_at(F.split(F.regexp_replace("qualified", "::", "."), r"\."), -1))).alias("term")).distinct()
    alike = t.postings.where("field = 'name'").join(terms, "term", "left_semi").join(t.symbols.select("symbol_id", "path", "lang"), "symbol_id").where(languages.is_test("path", "lang"))
    evidence = {"affected-test": near.where("distance > 1").select("path"), "resolved-reference": near.where("distance <= 1").select("path"), "lexical-name": alike.select("path")}
    if co_changed is not None:
        evidence["co-change"] = co_changed.join(t.symbols.where("is_test").select("path").distinct(), "path", "left_semi").select("path")
    unread = t.statuses.where("status in ('degraded', 'recovered')").join(changed.select("path"), "path", "left_semi")
    return {
        "schema_version": 1, "status": "complete" if unread.isEmpty() else "partial", "depth": depth, "changed_files": changed, "changed_definitions": definitions,
        "direct_edges": graph.incident(merged, seeds), "affected": affected, "dependencies": dependencies,
        "cycles": graph.cycles(merged, affected.select("node").union(seeds)), "tests": graph.test_evidence(evidence),
        "resolution": graph.observations(seen), "unfollowed_imports": loose.select(F.col("file").alias("path"), F.col("path").alias("specifier"), F.col("leaf").alias("name"), "line"),
    }
