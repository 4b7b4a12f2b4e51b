"""Index build: ids, term bags, postings, lengths, statistics, exact routes, name resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexing import not_stop, tokens
from ..sources.lineage import cut

FIELDS = ["name", "qualified", "path", "signature", "body", "documentation", "attribute", "callee", "caller", "import"]
#: Fields whose terms leave stop words out.
PROSE = {"documentation"}


def dense_ids(df: DataFrame, order: list, name: str = "symbol_id") -> DataFrame:
    """Numbers from 0 in a total order, without a single-task window: a range sort, then an offset per partition."""
    spot = cut(df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))
    parts = spot.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    # a row per partition
    parts = parts.withColumn("__skip", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("__first"))
    return spot.join(F.broadcast(parts.select("__part", "__skip")), "__part").withColumn(name, F.col("__at") + F.col("__skip")).drop("__part", "__at", "__skip")


def term_bags(symbols: DataFrame, fields: dict[str, str | Column], id_col: str = "symbol_id") -> DataFrame:
    """symbol_id, field, term: a row for each occurrence of a term in a field."""
    bags = [F.struct(F.lit(f).alias("field"), (not_stop(tokens(c)) if f in PROSE else tokens(c)).alias("terms")) for f, c in fields.items()]
    each = symbols.select(F.col(id_col).alias("symbol_id"), F.explode(F.array(*bags)).alias("b"))
    return each.select("symbol_id", "b.field", F.explode("b.terms").alias("term"))


def postings(bags: DataFrame) -> DataFrame:
    """field, term, symbol_id, tf."""
    return bags.groupBy("field", "term", "symbol_id").agg(F.count("*").alias("tf"))


def field_lengths(post: DataFrame) -> DataFrame:
    """field, symbol_id, len: zero lengths have no row."""
    return post.groupBy("field", "symbol_id").agg(F.sum("tf").alias("len"))


def length_table(post: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """A row for each symbol with a column for each field."""
    return post.groupBy("symbol_id").pivot("field", fields).agg(F.sum("tf")).na.fill(0)


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """field, document_count, total_term_frequency over symbols with a length above zero."""
    return lengths.groupBy("field").agg(F.count("*").alias("document_count"), F.sum("len").alias("total_term_frequency"))


def exact_routes(symbols: DataFrame, key: str) -> DataFrame:
    """key and the sorted symbol ids that have it."""
    return symbols.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_set("symbol_id")).alias("symbols"))


def vocabulary(post: DataFrame) -> DataFrame:
    return post.select("term").distinct()


def known_terms(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Query terms (query_id, pos, term) that the index has, first occurrences only."""
    return terms.join(vocab, "term", "left_semi").groupBy("query_id", "term").agg(F.min("pos").alias("pos"))


# name resolution


def module_of_path(module: Column, path: Column) -> tuple[Column, Column]:
    """(module segments, rest) of a path of segments: crate clears the module, each super pops a segment, self stays; else the path is below the module."""
    start = F.struct(module.alias("module"), F.lit(False).alias("done"), F.array().cast("array<string>").alias("rest"))
    step = lambda a, x: F.struct(
        F.when(a["done"], a["module"]).when(x == "crate", F.array().cast("array<string>")).when((x == "super") & (F.size(a["module"]) > 0), F.slice(a["module"], 1, F.greatest(F.size(a["module"]) - 1, F.lit(0)))).otherwise(a["module"]).alias("module"),
        (a["done"] | ~x.isin("crate", "self", "super")).alias("done"),
        F.when(a["done"] | ~x.isin("crate", "self", "super"), F.concat(a["rest"], F.array(x))).otherwise(a["rest"]).alias("rest"),
    )
    out = F.aggregate(path, start, step)
    return out["module"], out["rest"]


def absolute(module: Column, path: Column, sep: str = "::") -> Column:
    """The qualified name that a written path means below a module."""
    m, rest = module_of_path(module, F.split(path, sep, -1))
    return F.array_join(F.concat(m, rest), sep)


def _classes(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """*keys, least, n: the symbols (target) of each key as classes with the same keys, named by their least symbol. No two classes
    have a symbol in common, so sizes add up over classes."""
    sets = pairs.dropna(subset=keys).groupBy("target").agg(F.sort_array(F.collect_set(F.struct(*keys))).alias("__keys"))
    each = sets.groupBy("__keys").agg(F.count("target").alias("n"), F.min("target").alias("least"))
    return each.select(F.explode("__keys").alias("__k"), "least", "n").select("__k.*", "least", "n")


def _lookup(counts: DataFrame, keys: list[str]) -> DataFrame:
    """*keys, key (a number), n, least: a row for each key, stored, so that Spark knows how small it is."""
    return cut(counts.select(*keys, F.monotonically_increasing_id().alias("key"), "n", "least"))


def _bit(name: Column | str) -> Column:
    """One of 64 bits for a name."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(name), F.lit(64)).cast("int"))


#: Stages of a resolution: qualified path, import, enclosing scope (plus its depth), module.
_PATH, _IMPORT, _SCOPE, _MODULE = 1, 2, 3, 1000


def resolve(references: DataFrame, symbols: DataFrame, imports: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """ref_id, resolution (resolved, ambiguous, unresolved), target, candidates, and the columns of references in keep.

    references: ref_id, file, module (array), owner (symbol_id or null), name, qualified (or null), kind. Methods stay
    unresolved. symbols: symbol_id, file, module, parent, name, qualified. imports: file, module, path, leaf, alias, kind,
    is_glob; only use imports that aren't globs count. The first stage with a candidate decides: the written qualified path,
    imports of the file by leaf or alias, the innermost enclosing scope that defines the name, then the module.

    Candidates are counted once for each key that a stage looks up, and references meet the counts: a name that many symbols
    share isn't multiplied by its references. Rows with one ref_id are decided together; those that look up different keys
    in the deciding stage unite the classes of their symbols.
    """
    keep = keep or []
    pairs = {
        _PATH: (symbols.select(F.col("symbol_id").alias("target"), F.col("qualified").alias("q")), ["q"]),
        _SCOPE: (symbols.where("parent is not null").select(F.col("parent").alias("ancestor"), "name", F.col("symbol_id").alias("target")), ["ancestor", "name"]),
        _MODULE: (symbols.where("parent is null").select(F.array_join("module", "::").alias("mod"), "name", F.col("symbol_id").alias("target")), ["mod", "name"]),
    }
    looks = {s: _lookup(df.dropna(subset=k).groupBy(*k).agg(F.countDistinct("target").alias("n"), F.min("target").alias("least")), k) for s, (df, k) in pairs.items()}
    use = imports.where("kind = 'use' and not is_glob").select("file", F.explode(F.array_distinct(F.array_compact(F.array("leaf", "alias")))).alias("name"), absolute(F.col("module"), F.col("path")).alias("q")).distinct()
    # a name may stand for several paths, and paths for the same symbols
    used = cut(use.join(_classes(*pairs[_PATH]), "q").select("file", "name", "least", "n").distinct())
    looks[_IMPORT] = _lookup(used.groupBy("file", "name").agg(F.sum("n").alias("n"), F.min("least").alias("least")), ["file", "name"])

    plain = "ref_id is not null and kind <> 'method'"
    bare = references.where(f"{plain} and qualified is null")
    found = lambda s: F.struct(F.lit(s).alias("stage"), "key", "n", "least").alias(f"f{s}")
    row = lambda df, own, f: df.select("ref_id", *[(F.col(c) if own else F.lit(None).cast(references.schema[c].dataType)).alias(c) for c in keep], F.lit(own).alias("own"), f.alias("f"))
    none = references.where(f"not coalesce({plain}, false)")
    one = references.where(f"{plain} and qualified is not null").withColumn("q", absolute(F.col("module"), F.col("qualified"))).join(looks[_PATH].select("q", found(_PATH)), "q", "left")
    two = bare.withColumn("mod", F.array_join("module", "::")).join(looks[_IMPORT].select("file", "name", found(_IMPORT)), ["file", "name"], "left").join(looks[_MODULE].select("mod", "name", found(_MODULE)), ["mod", "name"], "left")
    # scopes matter where no import of the file decides; bits of the names in a scope keep most others from the join, which is exact
    bits = looks[_SCOPE].groupBy("ancestor").agg(F.bit_or(_bit("name")).alias("bits"))
    up = ancestors(symbols.select("symbol_id", "parent").distinct()).join(bits, "ancestor").withColumnRenamed("symbol_id", "owner")
    three = bare.where("owner is not null").join(looks[_IMPORT].select("file", "name"), ["file", "name"], "left_anti").select("ref_id", "owner", "name").join(up, "owner").where(F.col("bits").bitwiseAND(_bit("name")) != 0)
    three = three.select("ref_id", "name", "ancestor", "depth").join(looks[_SCOPE], ["ancestor", "name"])
    hit = F.struct((F.lit(_SCOPE) + F.col("depth")).alias("stage"), "key", "n", "least")
    every = row(one, True, F.col(f"f{_PATH}")).union(row(two, True, F.coalesce(f"f{_IMPORT}", f"f{_MODULE}"))).union(row(three, False, hit))
    every = row(none, True, F.lit(None).cast(every.schema["f"].dataType)).union(every).select("ref_id", *keep, "own", "f.*")

    same = Window.partitionBy("ref_id")
    every = every.withColumn("lo", F.min(F.when(F.col("stage").isNotNull(), F.struct("stage", "key", "n", "least"))).over(same))
    every = every.withColumn("hi", F.max(F.when(F.col("stage") == F.col("lo.stage"), F.col("key"))).over(same)).withColumn("mixed", F.coalesce(F.col("lo.key") != F.col("hi"), F.lit(False)))
    every = cut(every.where("own or (mixed and stage = lo.stage)").select("ref_id", *keep, "own", "mixed", "stage", F.when(F.col("mixed"), F.col("key")).alias("key"), "lo"))
    out = every.where("not mixed").select("ref_id", *keep, F.col("lo.stage").alias("first"), "lo.n", "lo.least")
    if not every.where("mixed").isEmpty():
        members = used.join(looks[_IMPORT].select("file", "name", "key"), ["file", "name"]).select(F.lit(_IMPORT).alias("by"), "key", "least", "n")
        for s, (df, k) in pairs.items():
            members = members.union(_classes(df, k).join(looks[s].select(*k, "key"), k).select(F.lit(s).alias("by"), "key", "least", "n"))
        by = F.when(F.col("stage").between(_SCOPE, _MODULE - 1), _SCOPE).otherwise(F.col("stage"))
        asked = every.where("mixed and stage = lo.stage").select("ref_id", by.alias("by"), "key").distinct()
        united = asked.join(members, ["by", "key"]).select("ref_id", "least", "n").distinct().groupBy("ref_id").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
        out = out.union(every.where("mixed and own").select("ref_id", *keep, F.col("lo.stage").alias("first")).join(united, "ref_id").select("ref_id", *keep, "first", "n", "least"))
    n = F.coalesce("n", F.lit(0)).cast("long")
    label = F.when(F.col("first").isNull(), "unresolved").when(n == 1, "resolved").otherwise("ambiguous")
    return out.select("ref_id", *keep, label.alias("resolution"), F.when(n == 1, F.col("least")).alias("target"), n.alias("candidates"))


def resolve_imports(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """imports (file, module, path, kind, is_glob, ...) with resolution, target and candidates: what their path names below their
    module. Globs, and kinds other than use, are never followed: unresolved."""
    named = symbols.groupBy(F.col("qualified").alias("__q")).agg(F.countDistinct("symbol_id").alias("candidates"), F.min("symbol_id").alias("target"))
    q = F.when((F.col("kind") == "use") & ~F.col("is_glob"), absolute(F.col("module"), F.col("path")))
    out = imports.withColumn("__q", q).join(named, "__q", "left").drop("__q").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    label = F.when(F.col("candidates") == 0, "unresolved").when(F.col("candidates") == 1, "resolved").otherwise("ambiguous")
    return out.withColumn("resolution", label).withColumn("target", F.when(F.col("candidates") == 1, F.col("target")))


def ancestors(symbols: DataFrame, most: int = 32) -> DataFrame:
    """symbol_id, ancestor, depth: a symbol itself at depth 0, then its parents."""
    parents = symbols.where("parent is not null").select(F.col("symbol_id").alias("ancestor"), F.col("parent").alias("up"))
    level = symbols.select("symbol_id", F.col("symbol_id").alias("ancestor"), F.lit(0).alias("depth"))
    out = level
    for depth in range(1, most + 1):
        level = cut(level.join(parents, "ancestor").select("symbol_id", F.col("up").alias("ancestor"), F.lit(depth).alias("depth")))
        if level.isEmpty():
            break
        out = out.union(level)
    return out


def derived_terms(references: DataFrame, resolved: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol_id, field, term of the fields callee, import and caller.

    A reference's written name goes to its owner; an import's path, leaf and alias to its owner, or to all symbols of its file
    if it has none; the qualified name of the caller of a resolved plain call to what it calls.
    """
    callee = references.where("owner is not null").select(F.col("owner").alias("symbol_id"), F.lit("callee").alias("field"), F.coalesce("qualified", "name").alias("text"))
    said = imports.select("file", "owner", F.explode(F.array_distinct(F.array_compact(F.array("path", "leaf", "alias")))).alias("text")).alias("i")
    loose = said.where("owner is null").join(symbols.select("file", "symbol_id"), "file").select("symbol_id", "text")
    owned = said.where("owner is not null").select(F.col("owner").alias("symbol_id"), "text")
    imported = loose.union(owned).distinct().select("symbol_id", F.lit("import").alias("field"), "text")
    calls = references.where("kind = 'call' and owner is not null").join(resolved.where("resolution = 'resolved'"), "ref_id")
    caller = calls.join(symbols.select(F.col("symbol_id").alias("owner"), F.col("qualified").alias("text")), "owner").select(F.col("target").alias("symbol_id"), F.lit("caller").alias("field"), "text")
    every = callee.unionByName(imported).unionByName(caller)
    return every.select("symbol_id", "field", F.explode(tokens("text")).alias("term"))


def unresolved_count(resolved: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """One row: references, and imports with a resolution, that name nothing or several things."""
    rows = resolved.select("resolution") if imports is None else resolved.select("resolution").union(imports.select("resolution"))
    return rows.agg(F.count_if(F.col("resolution") != "resolved").alias("unresolved"))


def violations(symbols: DataFrame, post: DataFrame, lengths: DataFrame, resolved: DataFrame) -> DataFrame:
    """check, bad: structural checks of an index; bad counts the rows that break each."""
    ids = symbols.select("symbol_id")
    checks = {
        "symbol ids are unique": symbols.groupBy("symbol_id").count().where("count > 1"),
        "qualified names are not empty": symbols.where("qualified is null or qualified = ''"),
        "spans are ordered": symbols.where("end_byte < start_byte or start_byte < 0"),
        "parents exist": symbols.where("parent is not null").select(F.col("parent").alias("symbol_id")).join(ids, "symbol_id", "left_anti"),
        "postings have symbols": post.join(ids, "symbol_id", "left_anti"),
        "term frequencies are above zero": post.where("tf <= 0"),
        "postings are unique": post.groupBy("field", "term", "symbol_id").count().where("count > 1"),
        "lengths are sums of postings": field_lengths(post).exceptAll(lengths.select("field", "symbol_id", "len")),
        "fields are known": post.where(~F.col("field").isin(FIELDS)),
        "targets exist": resolved.where("target is not null").select(F.col("target").alias("symbol_id")).join(ids, "symbol_id", "left_anti"),
        "one candidate means resolved": resolved.where("(resolution = 'resolved') <> (candidates = 1)"),
    }
    out = None
    for name, df in checks.items():
        row = df.agg(F.count("*").alias("bad")).select(F.lit(name).alias("check"), "bad")
        out = row if out is None else out.union(row)
    return out
