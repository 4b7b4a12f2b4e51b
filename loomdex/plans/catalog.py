"""The registered queries of the engine, with DuckDB SQL that states the same results.

The driver's tables hold no source code, so they take its roles: documents and parts are symbols, brands are files or
directories, customers are commits, consecutive parts of an order are calls, quantities are line spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import encoding, languages, lexing
from ..operators import checks, cochange, delta, exact, graph, index, quality, ranking, routes, scopes, spans
from ..sources import store, tree
from ..sources.lineage import cut

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_stored: dict = {}


def _store(spark, d, name, build) -> DataFrame:
    """A table of an index over d, written once a session: ranking queries read a stored index, they don't build it."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _stored:
        _stored[key] = cut(build())
    return _stored[key]


def _doc_postings(spark, d) -> DataFrame:
    return _store(spark, d, "postings", lambda: index.postings(index.term_bags(_t(spark, d, "documents"), {"body": "text"}, "doc_id")))


def _doc_lengths(spark, d) -> DataFrame:
    return _store(spark, d, "lengths", lambda: index.field_lengths(_doc_postings(spark, d)))


def _part_symbols(spark, d) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.col("p_type").alias("qualified"), F.col("p_brand").alias("path"), "p_size")


PART_FIELDS = {"name": "name", "qualified": "qualified", "path": "path"}
QUESTIONS = [(1, "where is the large brushed brass part of Brand#13?"), (2, "part 17 of Brand#22"), (3, "STANDARD and SMALL plated"), (4, "what is this?"), (5, "PART_9")]
_Q = "(VALUES " + ", ".join(f"({k}, '{q}')" for k, q in QUESTIONS) + ") q(query_id, text)"


def _questions(spark) -> DataFrame:
    return spark.createDataFrame(QUESTIONS, "query_id long, text string")


def _asked(questions: DataFrame, post: DataFrame, text: str = "text") -> DataFrame:
    terms = questions.select("query_id", F.posexplode(lexing.query_terms(text)).alias("pos", "term"))
    return index.known_terms(terms, post.select("term")).select("query_id", "term")


_STEMS = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in lexing.STEMS.items()) + "}"


def _terms_sql(text: str) -> str:
    """Distinct query terms as a list."""
    ts = f"list_filter({lexing.tokens_sql(text)}, lambda x: x NOT IN ({lexing.stop_sql()}))"
    return f"list_distinct(flatten(list_transform({ts}, lambda x: CASE WHEN {_STEMS}[x] IS NULL THEN [x] ELSE [x, {_STEMS}[x]] END)))"


def _postings_sql(table: str, key: str, fields: dict[str, str]) -> str:
    one = " UNION ALL ".join(f"SELECT CAST({key} AS BIGINT) AS symbol_id, '{f}' AS field, unnest({lexing.tokens_sql(c)}) AS term FROM {table}" for f, c in fields.items())
    return f"SELECT field, term, symbol_id, count(*) AS tf FROM ({one}) GROUP BY ALL"


def _ranking_sql(post: str, asked: str, b: dict, boost: dict, p: ranking.Profile) -> str:
    """CTEs post, len, stats, df, opened, cands, scored (query_id, symbol_id, score)."""
    case = lambda v: "CASE o.field " + " ".join(f"WHEN '{k}' THEN {float(x)}" for k, x in v.items()) + " END"
    return f"""
    post AS MATERIALIZED ({post}), len AS (SELECT field, symbol_id, sum(tf) AS len FROM post GROUP BY ALL),
    stats AS (SELECT field, count(*) AS n, sum(len) AS total FROM len GROUP BY ALL),
    asked0 AS ({asked}), asked AS (SELECT DISTINCT query_id, term FROM asked0 WHERE term IN (SELECT term FROM post)),
    df AS (SELECT field, term, count(*) AS df FROM post WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
    opened AS MATERIALIZED (SELECT query_id, field, term, symbol_id, tf, df, CAST(n AS DOUBLE) AS n, CAST(total AS DOUBLE) / n AS avg FROM post JOIN df USING (field, term) JOIN stats USING (field) JOIN asked USING (term)),
    cands AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rarest_df, matched_terms DESC, symbol_id) AS place FROM (
      SELECT query_id, symbol_id, min(df) AS rarest_df, count(DISTINCT term) AS matched_terms FROM opened GROUP BY ALL)),
    parts AS (SELECT o.query_id, o.symbol_id, o.term, o.field, {case(boost)} * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({p.k1} + 1) /
      (tf + CASE WHEN {case(b)} = 0 OR avg <= 0 THEN {p.k1} ELSE {p.k1} * (1 - {case(b)} + {case(b)} * len / avg) END) AS x
      FROM opened o JOIN cands c ON c.query_id = o.query_id AND c.symbol_id = o.symbol_id AND place <= {p.retained} JOIN len l ON l.field = o.field AND l.symbol_id = o.symbol_id),
    scored AS (SELECT query_id, symbol_id, CAST(floor(sum(x ORDER BY term, field) * 1000000 + 0.5) AS BIGINT) AS score FROM parts GROUP BY ALL)"""


_P = ranking.Profile()
_DOC_POST = _postings_sql("documents", "doc_id", {"body": "text"})
_PART_POST = _postings_sql("part", "p_partkey", {"name": "p_name", "qualified": "p_type", "path": "p_brand"})
_ASK = f"SELECT query_id, unnest({_terms_sql('text')}) AS term FROM {_Q}"
_BENCH = f"SELECT CAST(item_id AS BIGINT) AS query_id, unnest({_terms_sql('text')}) AS term FROM benchmark"


# lexical


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(list_filter({lexing.tokens_sql('text')}, lambda x: x NOT IN ({lexing.stop_sql()}))) AS term FROM documents) GROUP BY ALL")
def lex_term_frequency(spark, d):
    """Terms of documents without stop words, with their frequency."""
    return _t(spark, d, "documents").select("doc_id", F.explode(lexing.not_stop(lexing.tokens("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query(f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter({lexing.tokens_sql('text')}, lambda x: x NOT IN ({lexing.stop_sql()})))), ' ') AS route_key FROM conversations WHERE role = 'user'")
def lex_route_key(spark, d):
    """Route key of each question of a user."""
    return _t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", lexing.route_key("text").alias("route_key"))


@query(f"SELECT CAST(query_id AS BIGINT) AS query_id, array_to_string(list_sort({_terms_sql('text')}), ' ') AS terms FROM {_Q}")
def lex_query_terms(spark, d):
    """Terms and stems of questions, sorted."""
    return _questions(spark).select("query_id", F.array_join(F.array_sort(lexing.query_terms("text")), " ").alias("terms"))


_URL = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


@query(rf"""SELECT page_id, regexp_replace({_URL}, '^.*/', '') AS file_name,
  CASE lower(regexp_extract(regexp_replace({_URL}, '^.*/', ''), '^.+\.([^.]+)$', 1)) WHEN 'html' THEN 'html' WHEN 'htm' THEN 'html' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'css' THEN 'css' END AS lang,
  regexp_matches({_URL}, '(^|/)tests/') AS is_test FROM pages""")
def path_facts(spark, d):
    """File name, language and test convention of page paths."""
    p = _t(spark, d, "pages").withColumn("path", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""))
    return p.select("page_id", languages.file_name("path").alias("file_name"), languages.language("path").alias("lang"), languages.is_test("path", F.coalesce(languages.language("path"), F.lit("html"))).alias("is_test"))


@query(r"SELECT page_id, replace(replace(url, '%', '%25'), '#', '%23') || '#' || CAST(page_id AS VARCHAR) AS anchor FROM pages")
def anchor_encoding(spark, d):
    """Anchors of pages."""
    return _t(spark, d, "pages").select("page_id", encoding.anchor(F.col("url"), F.col("page_id").cast("string")).alias("anchor"))


# index and ranking


@query(f"WITH post AS ({_PART_POST}), len AS (SELECT field, symbol_id, sum(tf) AS len FROM post GROUP BY ALL) SELECT field, count(*) AS document_count, CAST(sum(len) AS BIGINT) AS total_term_frequency FROM len GROUP BY ALL")
def corpus_field_stats(spark, d):
    """Statistics of three fields of parts."""
    return index.corpus_stats(index.field_lengths(index.postings(index.term_bags(_part_symbols(spark, d), PART_FIELDS))))


@query(f"WITH post AS ({_PART_POST}) SELECT symbol_id, CAST(coalesce(sum(tf) FILTER (field = 'name'), 0) AS BIGINT) AS name, CAST(coalesce(sum(tf) FILTER (field = 'qualified'), 0) AS BIGINT) AS qualified, CAST(coalesce(sum(tf) FILTER (field = 'path'), 0) AS BIGINT) AS path FROM post GROUP BY ALL")
def field_length_table(spark, d):
    """Length of each field of each part."""
    return index.length_table(index.postings(index.term_bags(_part_symbols(spark, d), PART_FIELDS)), list(PART_FIELDS))


@query(f"WITH {_ranking_sql(_DOC_POST, _BENCH, ranking.B, ranking.BOOST, _P)} SELECT query_id, symbol_id AS doc_id, score FROM scored")
def bm25_single_field(spark, d):
    """BM25 of documents for every benchmark text, over the retained candidates."""
    post = _doc_postings(spark, d)
    lengths = _doc_lengths(spark, d)
    ask = _t(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), "text")
    terms = cut(_asked(ask, post))
    opened = cut(ranking.streams(post, terms))
    return ranking.scores(opened, terms, ranking.candidates(opened, terms), lengths, index.corpus_stats(lengths)).select("query_id", F.col("symbol_id").alias("doc_id"), "score")


_TOP = f"""WITH {_ranking_sql(_PART_POST, _ASK, ranking.B, ranking.BOOST, _P)},
  col AS (SELECT s.*, p_brand AS path, p_name AS name, row_number() OVER (PARTITION BY query_id, p_brand, p_name ORDER BY score DESC, symbol_id) AS r FROM scored s JOIN part ON p_partkey = symbol_id),
  ord AS (SELECT *, row_number() OVER w AS rank, coalesce(lead(score) OVER w, 0) AS second FROM col WHERE r = 1 WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, symbol_id)),
  top AS (SELECT query_id, symbol_id, path, name, score, rank, CASE WHEN score > 0 THEN CAST((score - second) AS HUGEINT) * 1000000 // score ELSE 0 END AS margin_ppm FROM ord WHERE rank <= 3)"""


def _part_top(spark, d):
    symbols = _part_symbols(spark, d)
    post = index.postings(index.term_bags(symbols, PART_FIELDS))
    lengths = index.field_lengths(post)
    return ranking.rank(post, lengths, index.corpus_stats(lengths), symbols.select("symbol_id", "path", "name"), _asked(_questions(spark), post))


@query(f"{_TOP} SELECT CAST(query_id AS BIGINT) AS query_id, symbol_id, path, name, score, CAST(rank AS BIGINT) AS rank, CAST(margin_ppm AS BIGINT) AS margin_ppm FROM top")
def bm25_multi_field_top3(spark, d):
    """The three best anchors of parts for each question, over three fields."""
    return _part_top(spark, d).select("query_id", "symbol_id", "path", "name", "score", F.col("rank").cast("long").alias("rank"), "margin_ppm")


@query(f"""WITH {_ranking_sql(_DOC_POST, _BENCH, ranking.B, ranking.BOOST, _P)},
  ord AS (SELECT *, row_number() OVER w AS rank, coalesce(lead(score) OVER w, 0) AS second FROM scored WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, symbol_id)),
  best AS (SELECT query_id, symbol_id, score, CASE WHEN score > 0 THEN CAST((score - second) AS HUGEINT) * 1000000 // score ELSE 0 END AS margin_ppm FROM ord WHERE rank = 1)
  SELECT CAST(item_id AS BIGINT) AS query_id, CASE WHEN score IS NULL OR score < {_P.none_below} THEN 'none' WHEN score >= {_P.direct_score} AND margin_ppm >= {_P.direct_margin_ppm} THEN 'direct' ELSE 'candidates' END AS decision,
  score, CAST(margin_ppm AS BIGINT) AS margin_ppm, symbol_id AS best FROM benchmark LEFT JOIN best ON query_id = item_id""")
def bm25_batch_decision(spark, d):
    """Decision on every benchmark text as a question over documents."""
    post = _doc_postings(spark, d)
    lengths = _doc_lengths(spark, d)
    ask = _t(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), "text")
    anchors = _t(spark, d, "documents").select(F.col("doc_id").alias("symbol_id"), F.col("doc_id").cast("string").alias("path"), F.lit("").alias("name"))
    top = cut(ranking.rank(post, lengths, index.corpus_stats(lengths), anchors, cut(_asked(ask, post))))
    best = ranking.decide(top, ask)
    return best.join(top.where("rank = 1").select("query_id", F.col("symbol_id").alias("best")), "query_id", "left").select("query_id", "decision", "score", "margin_ppm", "best")


@query(f"""WITH {_ranking_sql(_DOC_POST, _BENCH, ranking.B, ranking.BOOST, _P)},
  ev AS (SELECT query_id, count(*) AS postings, count(DISTINCT symbol_id) AS union_size, count(DISTINCT term) AS terms FROM opened GROUP BY ALL),
  edge AS (SELECT query_id, count(*) = 2 AND min((rarest_df, matched_terms)) = max((rarest_df, matched_terms)) AS cut FROM cands WHERE place IN ({_P.retained}, {_P.retained + 1}) GROUP BY ALL)
  SELECT query_id, postings, union_size, terms, least(union_size, {_P.retained}) AS scored, union_size - least(union_size, {_P.retained}) AS dropped, coalesce(cut, false) AS cut FROM ev LEFT JOIN edge USING (query_id)""")
def candidate_cap_evidence(spark, d):
    """What the bounded candidate union of each benchmark question touched, and whether its bound cut a tie."""
    post = _doc_postings(spark, d)
    ask = _t(spark, d, "benchmark").select(F.col("item_id").cast("long").alias("query_id"), "text")
    terms = cut(_asked(ask, post))
    opened = cut(ranking.streams(post, terms))
    cands = ranking.candidates(opened, terms)
    return ranking.evidence(opened, terms).join(ranking.cap_cut_a_tie(cands), "query_id", "left").na.fill(False, ["cut"])


# exact routing


@query("""WITH w AS (SELECT c_custkey AS query_id, CASE WHEN c_custkey % 3 = 0 THEN 'Brand#' || (11 + c_custkey % 40) WHEN c_custkey % 3 = 1 THEN 'part ' || (c_custkey % 300) ELSE 'nothing' END AS atom, CASE WHEN c_custkey % 3 = 0 THEN 'path' ELSE 'symbol' END AS kind FROM customer),
  s AS (SELECT p_partkey AS symbol_id, p_name AS name, p_brand AS path FROM part),
  m AS (SELECT query_id, symbol_id FROM w JOIN s ON kind = 'symbol' AND name = atom UNION ALL SELECT query_id, NULL FROM w JOIN (SELECT DISTINCT path FROM s) ON kind = 'path' AND path = atom),
  n AS (SELECT query_id, count(*) AS matches FROM m GROUP BY ALL)
  SELECT w.query_id, CASE WHEN coalesce(matches, 0) = 0 THEN 'miss' WHEN matches = 1 THEN 'direct' ELSE 'ambiguous' END AS outcome, coalesce(matches, 0) AS matches FROM w LEFT JOIN n USING (query_id)""")
def exact_route(spark, d):
    """Exact routing of one atom per customer to parts and brands."""
    k = F.col("c_custkey")
    atom = F.when(k % 3 == 0, F.concat(F.lit("Brand#"), (11 + k % 40).cast("string"))).when(k % 3 == 1, F.concat(F.lit("part "), (k % 300).cast("string"))).otherwise("nothing")
    found = _t(spark, d, "customer").select(k.alias("query_id"), F.lit(0).alias("pos"), atom.alias("atom"), F.when(k % 3 == 0, "path").otherwise("symbol").alias("kind"))
    return exact.outcome(exact.route(found, _part_symbols(spark, d)), found)


@query("SELECT p_brand AS path, p_type || '/' || p_size || '/' || p_partkey % 50 AS name, min(p_partkey) AS symbol_id FROM part GROUP BY ALL HAVING count(*) = 1")
def unique_anchors(spark, d):
    """Anchors (brand; type, size and key modulo 50) of exactly one part."""
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("path"), F.concat_ws("/", "p_type", F.col("p_size").cast("string"), (F.col("p_partkey") % 50).cast("string")).alias("name"))
    return exact.unique_anchors(p)


@query("SELECT p_name AS key, array_to_string(list_sort(list(DISTINCT p_partkey)), ',') AS symbols FROM part GROUP BY ALL")
def exact_routes(spark, d):
    """Parts of each name."""
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), "p_name")
    return index.exact_routes(p, "p_name").select("key", F.array_join(F.transform("symbols", lambda x: x.cast("string")), ",").alias("symbols"))


@query("""WITH x AS (SELECT p_brand AS path, p_type AS name, p_partkey AS symbol_id, CAST(p_size AS BIGINT) % 5 AS overlap, CASE WHEN p_size % 3 = 0 THEN 2 WHEN p_size % 3 = 1 THEN 0 ELSE 1 END AS prec, p_size FROM part),
  a AS (SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY overlap DESC, prec DESC, symbol_id) AS r FROM x),
  o AS (SELECT *, row_number() OVER w AS rank, lead(overlap) OVER w AS nxt FROM a WHERE r = 1 WINDOW w AS (PARTITION BY path ORDER BY overlap DESC, name, path, p_size, symbol_id))
  SELECT path AS query_id, symbol_id, name, overlap, CAST(rank AS BIGINT) AS rank, rank = 1 AND overlap > 0 AND (nxt IS NULL OR overlap > nxt) AS direct FROM o WHERE rank <= 3""")
def disambiguation(spark, d):
    """The best three types of each brand by an overlap, one for each anchor."""
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("symbol_id"), F.col("p_brand").alias("path"), F.col("p_type").alias("name"), F.col("p_type").alias("qualified"), F.when(F.col("p_size") % 3 == 0, "struct").when(F.col("p_size") % 3 == 1, "constructor").otherwise("function").alias("kind"), F.col("p_size").alias("start_line"))
    scored = p.select(F.col("path").alias("query_id"), "symbol_id", (F.col("start_line").cast("long") % 5).alias("overlap"))
    return exact.disambiguate(scored, p).select("query_id", "symbol_id", "name", "overlap", F.col("rank").cast("long").alias("rank"), "direct")


# intervals

_SPANS = "s AS (SELECT l_orderkey AS file, CAST(l_linenumber AS BIGINT) AS id, CAST(l_linenumber AS BIGINT) AS s, CAST(max(l_linenumber + CAST(l_quantity AS BIGINT) % 5) AS BIGINT) AS e FROM lineitem GROUP BY 1, 2)"


def _spans(spark, d):
    end = F.max(F.col("l_linenumber").cast("long") + F.col("l_quantity").cast("long") % 5)
    return _t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("id")).agg(end.alias("end")).select("file", "id", F.col("id").alias("start"), "end")


@query(f"WITH {_SPANS}, p AS (SELECT file, id + 1 AS line FROM s) SELECT file, line, owner FROM (SELECT p.file, p.line, s.id AS owner, row_number() OVER (PARTITION BY p.file, p.line ORDER BY s.e - s.s, s.id) AS r FROM p LEFT JOIN s ON s.file = p.file AND s.s <= p.line AND p.line <= s.e) WHERE r = 1")
def span_owner(spark, d):
    """Smallest span around a line of each order."""
    s = _spans(spark, d)
    p = s.select("file", F.struct("file", (F.col("id") + 1).alias("line")).alias("point_id"), (F.col("id") + 1).alias("start"), (F.col("id") + 1).alias("end"))
    return spans.nearest_owner(p, s).select("point_id.file", "point_id.line", "owner")


@query(f"WITH {_SPANS} SELECT file, id, parent FROM (SELECT a.file, a.id, b.id AS parent, row_number() OVER (PARTITION BY a.file, a.id ORDER BY b.e - b.s, b.id) AS r FROM s a LEFT JOIN s b ON a.file = b.file AND b.s <= a.s AND a.e <= b.e AND (b.s < a.s OR a.e < b.e) AND a.id <> b.id) WHERE r = 1")
def span_parent(spark, d):
    """Smallest span that strictly contains each one."""
    s = _spans(spark, d)
    u = s.select("file", F.struct("file", "id").alias("id"), "start", "end")
    return spans.parents(u).select("id.file", "id.id", F.col("parent.id").alias("parent"))


@query(f"""WITH {_SPANS}, h AS (SELECT DISTINCT l_orderkey AS file, CAST(l_linenumber AS BIGINT) AS start, CAST(l_quantity AS BIGINT) % 3 AS lines FROM lineitem WHERE l_returnflag = 'R'),
  m AS (SELECT s.file, h.start, h.lines, s.id, s.s, s.e FROM s JOIN h ON s.file = h.file AND ((lines > 0 AND s.s < start + lines AND start <= s.e) OR (lines = 0 AND s.s <= greatest(start, 1) AND greatest(start, 1) <= s.e)))
  SELECT DISTINCT file, id FROM m a WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.file = a.file AND b.start = a.start AND b.lines = a.lines AND b.id <> a.id AND a.s <= b.s AND b.e <= a.e AND (a.s < b.s OR b.e < a.e))""")
def hunk_touched(spark, d):
    """Spans that hunks touch."""
    s = _spans(spark, d).select("file", "id", F.col("start").alias("start_line"), F.col("end").alias("end_line"))
    h = _t(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("start"), (F.col("l_quantity").cast("long") % 3).alias("lines")).distinct()
    return spans.touched(s, h)


@query(r"""WITH l AS (SELECT doc_id AS key, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS line, s AS text FROM (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS i, unnest(string_split(text, chr(10))) AS s FROM documents)),
  n AS (SELECT *, CASE WHEN line BETWEEN 5 AND 7 THEN 0 ELSE 1 END AS outside, CASE WHEN line < 5 THEN 5 - line WHEN line > 7 THEN line - 7 ELSE 0 END AS away FROM l WHERE line BETWEEN 2 AND 10),
  b AS (SELECT *, row_number() OVER w AS c, sum(strlen(text) + 1) OVER (PARTITION BY key ORDER BY outside, away, line ROWS UNBOUNDED PRECEDING) AS bytes FROM n WINDOW w AS (PARTITION BY key ORDER BY outside, away, line))
  SELECT key, line, text FROM b WHERE c <= 6 AND bytes <= 2000""")
def window_lines(spark, d):
    """Lines 5 to 7 of documents with context, under a budget of lines and bytes."""
    docs = _t(spark, d, "documents")
    lines = docs.select(F.col("doc_id").alias("key"), F.posexplode(F.split("text", "\n", -1)).alias("at", "text")).select("key", (F.col("at") + 1).cast("long").alias("line"), "text")
    return spans.window_lines(lines, docs.select(F.col("doc_id").alias("key"), F.lit(5).alias("start_line"), F.lit(7).alias("end_line")), most_lines=6, most_bytes=2000)


# discovery

_TREE = """tree AS (SELECT p_partkey AS k, CASE p_partkey % 8 WHEN 0 THEN 'src/m' || p_size || '/mod' || p_partkey || '.rs' WHEN 1 THEN 'node_modules/x/' || p_partkey || '.js' WHEN 2 THEN 'src/' || p_partkey || '_test.go'
    WHEN 3 THEN 'docs/' || p_partkey || '.md' WHEN 4 THEN 'gen/out/' || p_partkey || '.py' WHEN 5 THEN 'lib/skip' || p_size || '.PY' || repeat('i', p_partkey % 2) WHEN 6 THEN 'src/generated/a' || p_partkey || '.ts' ELSE 'tests/t' || p_partkey || '.c' END AS path FROM part)"""


def _tree(spark, d) -> DataFrame:
    """A file per part, and two ignore files."""
    key, size = (F.col(c).cast("string") for c in ("p_partkey", "p_size"))
    kinds = [("src/m", size, "/mod", key, ".rs"), ("node_modules/x/", key, ".js"), ("src/", key, "_test.go"), ("docs/", key, ".md"), ("gen/out/", key, ".py"), ("lib/skip", size, ".PY", F.repeat(F.lit("i"), (F.col("p_partkey") % 2).cast("int"))), ("src/generated/a", key, ".ts"), ("tests/t", key, ".c")]
    path = F.element_at(F.array(*(F.concat(*(F.lit(x) if isinstance(x, str) else x for x in k)) for k in kinds)), (F.col("p_partkey") % 8 + 1).cast("int"))
    files = _t(spark, d, "part").select(path.alias("path"), F.encode("p_name", "utf-8").alias("content"))
    rules = [(".gitignore", b"# output\n/gen/out/\nskip1*\n"), ("src/.ignore", b"m[34]*/\n!m41/\n\n")]
    return files.unionByName(spark.createDataFrame(rules, "path string, content binary"))


@query(rf"""WITH {_TREE}, c AS (SELECT path, count(*) AS files FROM tree WHERE k % 8 NOT IN (1, 3, 4) AND NOT regexp_matches(path, '^lib/skip1') AND NOT (regexp_matches(path, '^src/m[34][^/]*/') AND path NOT LIKE 'src/m41/%') GROUP BY ALL)
  SELECT path, CASE regexp_extract(lower(path), '\.([a-z]+)$', 1) WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' WHEN 'py' THEN 'python' WHEN 'pyi' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'c' THEN 'c' END AS lang,
    path LIKE 'src/generated/%' AS generated, path LIKE '%\_test.go' ESCAPE '\' OR path LIKE 'tests/%' AS is_test, files FROM c WHERE NOT (path LIKE 'lib/%' AND NOT regexp_matches(path, '(?i)\.pyi?$'))""")
def tree_discovery(spark, d):
    """Source files of a tree under its excluded directories, languages and ignore files, with their marks."""
    return tree.discover(_tree(spark, d)).groupBy("path", "lang", "generated", "is_test").agg(F.count("*").alias("files"))


# name resolution

_NAMES = """sym AS (SELECT p_partkey AS id, 'f' || p_partkey % 40 AS file, p_brand AS module, CASE WHEN p_partkey % 5 <> 0 AND p_partkey > 5 THEN p_partkey - p_partkey % 5 END AS parent, 'n' || p_size AS name, p_brand || '::n' || p_size AS qualified FROM part),
  ref AS (SELECT o_orderkey AS ref_id, o_orderstatus AS st, s.file, s.module, s.id AS owner, 'n' || o_orderkey % 50 AS name, CASE WHEN o_orderkey % 4 = 0 THEN 'crate::Brand#' || (11 + o_orderkey % 15) || '::n' || o_orderkey % 50 END AS qualified,
    CASE WHEN o_orderkey % 7 = 0 THEN 'method' WHEN o_orderkey % 7 < 4 THEN 'call' ELSE 'type' END AS kind FROM orders JOIN sym s ON s.id = 1 + o_custkey % (SELECT count(*) FROM part)),
  imp AS (SELECT c_custkey AS id, 'f' || c_custkey % 40 AS file, 'crate::Brand#' || (11 + c_custkey % 25) || '::n' || c_custkey % 50 AS path, 'n' || c_custkey % 50 AS leaf, CASE WHEN c_custkey % 3 = 0 THEN 'n' || c_custkey % 17 END AS alias, CASE WHEN c_custkey % 6 = 0 THEN 'include' ELSE 'use' END AS kind, c_custkey % 10 = 0 AS is_glob FROM customer)"""


def _names(spark, d):
    """Symbols, references and imports from parts, orders and customers."""
    text = lambda c: c.cast("string")
    key, p = F.col("p_partkey"), _t(spark, d, "part")
    name = F.concat(F.lit("n"), text(F.col("p_size")))
    sym = p.select(key.alias("symbol_id"), F.concat(F.lit("f"), text(key % 40)).alias("file"), F.array("p_brand").alias("module"), F.when((key % 5 != 0) & (key > 5), key - key % 5).alias("parent"), name.alias("name"), F.concat_ws("::", "p_brand", name).alias("qualified"))
    o, k = F.col("o_orderkey"), F.col("c_custkey")
    said = F.concat(F.lit("n"), text(o % 50))
    brand = lambda c, n: F.concat(F.lit("crate::Brand#"), text(11 + c % n), F.lit("::n"), text(c % 50))
    refs = _t(spark, d, "orders").join(sym.select(F.col("symbol_id").alias("owner"), "file", "module"), F.col("owner") == 1 + F.col("o_custkey") % p.count())
    refs = refs.select(o.alias("ref_id"), "o_orderstatus", "file", "module", "owner", said.alias("name"), F.when(o % 4 == 0, brand(o, 15)).alias("qualified"), F.when(o % 7 == 0, "method").when(o % 7 < 4, "call").otherwise("type").alias("kind"))
    imps = _t(spark, d, "customer").select(k.alias("import_id"), F.concat(F.lit("f"), text(k % 40)).alias("file"), F.array(F.lit("top")).alias("module"), brand(k, 25).alias("path"), F.concat(F.lit("n"), text(k % 50)).alias("leaf"), F.when(k % 3 == 0, F.concat(F.lit("n"), text(k % 17))).alias("alias"), F.when(k % 6 == 0, "include").otherwise("use").alias("kind"), (k % 10 == 0).alias("is_glob"))
    return sym, refs, imps


_RESOLVED = f"""{_NAMES},
  up AS (SELECT id, id AS anc, 0 AS depth FROM sym UNION ALL SELECT id, parent, 1 FROM sym WHERE parent IS NOT NULL),
  use AS (SELECT DISTINCT file, unnest([leaf, alias]) AS name, path FROM imp WHERE kind = 'use' AND NOT is_glob),
  hit AS (SELECT r.ref_id, 1 AS stage, s.id FROM ref r JOIN sym s ON 'crate::' || s.qualified = r.qualified WHERE r.kind <> 'method'
    UNION ALL SELECT r.ref_id, 2, s.id FROM ref r JOIN use u ON u.file = r.file AND u.name = r.name JOIN sym s ON 'crate::' || s.qualified = u.path WHERE r.kind <> 'method' AND r.qualified IS NULL
    UNION ALL SELECT r.ref_id, 3 + depth, s.id FROM ref r JOIN up ON up.id = r.owner JOIN sym s ON s.parent = up.anc AND s.name = r.name WHERE r.kind <> 'method' AND r.qualified IS NULL
    UNION ALL SELECT r.ref_id, 5, s.id FROM ref r JOIN sym s ON s.parent IS NULL AND s.module = r.module AND s.name = r.name WHERE r.kind <> 'method' AND r.qualified IS NULL),
  best AS (SELECT ref_id, count(DISTINCT id) AS candidates, min(id) AS target FROM (SELECT *, min(stage) OVER (PARTITION BY ref_id) AS first FROM hit) WHERE stage = first GROUP BY ALL),
  res AS (SELECT r.*, coalesce(candidates, 0) AS candidates, CASE WHEN candidates = 1 THEN target END AS target, CASE WHEN candidates IS NULL THEN 'unresolved' WHEN candidates = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution FROM ref r LEFT JOIN best USING (ref_id)),
  found AS (SELECT i.id, count(DISTINCT s.id) AS candidates, min(s.id) AS target FROM imp i JOIN sym s ON 'crate::' || s.qualified = i.path WHERE i.kind = 'use' AND NOT i.is_glob GROUP BY ALL),
  ires AS (SELECT i.*, coalesce(candidates, 0) AS candidates, CASE WHEN candidates = 1 THEN target END AS target, CASE WHEN candidates IS NULL THEN 'unresolved' WHEN candidates = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution FROM imp i LEFT JOIN found USING (id))"""


@query(f"WITH {_RESOLVED} SELECT ref_id, resolution, target, candidates FROM res")
def name_resolution(spark, d):
    """What each written name means: by qualified path, import, enclosing scope or module."""
    sym, refs, imps = _names(spark, d)
    return index.resolve(refs, sym, imps)


@query(f"WITH {_RESOLVED} SELECT id AS import_id, resolution, target, candidates FROM ires")
def import_resolution(spark, d):
    """What each import names."""
    sym, _, imps = _names(spark, d)
    return index.resolve_imports(imps, sym).select("import_id", "resolution", "target", F.col("candidates").cast("long").alias("candidates"))


@query(f"WITH {_RESOLVED} SELECT DISTINCT file || '#' AS source, s.file || '#' || s.qualified AS target, 'import' AS kind, 1 + i.id % 9 AS line, 'target' AS endpoint FROM ires i JOIN (SELECT id AS k, file, qualified FROM sym) s ON s.k = i.target".replace("file || '#' AS source", "i.file || '#' AS source"))
def import_edges(spark, d):
    """Edges from files to what their imports name."""
    sym, _, imps = _names(spark, d)
    of = sym.select(F.col("symbol_id").alias("target"), F.concat_ws("#", "file", "qualified").alias("node"))
    rows = index.resolve_imports(imps, sym).join(of, "target").select(F.col("file").alias("path"), F.lit(None).cast("string").alias("owner"), F.col("node").alias("target"), F.lit("import").alias("kind"), (1 + F.col("import_id") % 9).cast("long").alias("line"))
    return graph.edges_of(rows, "target")


@query(f"""WITH {_RESOLVED}, said AS (SELECT file AS path, CASE WHEN st = 'F' THEN 'base' ELSE 'target' END AS endpoint, CASE WHEN kind = 'call' THEN 'call' ELSE 'reference' END AS kind, resolution FROM res UNION ALL SELECT file, 'target', 'import', resolution FROM ires),
  side AS (SELECT path, endpoint, {", ".join(f"count(*) FILTER (resolution = '{r}' AND kind = '{k}') AS {r}_{k}s" for r in ("unresolved", "ambiguous") for k in graph.EDGE_KINDS)}, count(*) FILTER (resolution = 'resolved') AS resolved FROM said GROUP BY ALL)
  SELECT * EXCLUDE (endpoint) FROM side s WHERE endpoint = (SELECT max(endpoint) FROM side x WHERE x.path = s.path)""")
def resolution_counts(spark, d):
    """Counts of what the names and imports of each file come to."""
    sym, refs, imps = _names(spark, d)
    r = index.resolve(refs, sym, imps, ["o_orderstatus", "file", "kind"])
    r = r.select(F.col("file").alias("path"), F.when(F.col("o_orderstatus") == "F", "base").otherwise("target").alias("endpoint"), "kind", "resolution")
    i = index.resolve_imports(imps, sym).select(F.col("file").alias("path"), F.lit("target").alias("endpoint"), F.lit("import").alias("kind"), "resolution")
    return graph.observations(r.union(i))


@query(f"WITH {_NAMES}, s AS (SELECT *, row_number() OVER (ORDER BY file, name, id) - 1 AS n FROM sym) SELECT id, n FROM s")
def symbol_ids(spark, d):
    """Numbers of symbols in the order of file, name and key."""
    return index.dense_ids(_names(spark, d)[0].select("file", "name", F.col("symbol_id").alias("id")), ["file", "name", "id"], "n").select("id", "n")


@query(r"SELECT doc_id, trim(regexp_replace(text, '[\s\x00-\x1F\x7F-\x9F]+', ' ', 'g')) AS signature FROM documents")
def display_signatures(spark, d):
    """Texts of documents on one line."""
    return _t(spark, d, "documents").select("doc_id", lexing.display_signature("text").alias("signature"))


@query("""SELECT o_orderkey AS id, CAST(o_orderkey * 37 // 1000000 AS VARCHAR) || '.' || lpad(CAST(o_orderkey * 37 % 1000000 AS VARCHAR), 6, '0') AS ratio, (o_custkey * 2000000 + o_orderkey) // (o_orderkey * 2) AS ppm,
  o_custkey * 10 >= o_orderkey AS enough, o_custkey * 10 > o_orderkey AS over FROM orders WHERE o_orderkey > 0""")
def exact_ratios(spark, d):
    """Ratios as printed, in millionths, and against a bound, by integers."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return _t(spark, d, "orders").where(k > 0).select(k.alias("id"), lexing.six_decimals(k * 37).alias("ratio"), lexing.ratio_ppm(c, k).alias("ppm"), lexing.at_least(c, k, 1, 10).alias("enough"), lexing.exceeds(c, k, 1, 10).alias("over"))


@query("""SELECT o_orderkey AS id, sha256(strlen(o_orderstatus) || ':' || o_orderstatus || strlen(CAST(o_custkey AS VARCHAR)) || ':' || o_custkey) AS hash, substr(sha1(CAST(o_orderkey AS VARCHAR)), 1, 2) AS shard FROM orders""")
def structural_hashes(spark, d):
    """Length-prefixed hashes of order rows, and the shard of an identity."""
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), lexing.structural_hash(F.col("o_orderstatus"), F.col("o_custkey")).alias("hash"), tree.oid_shard(F.sha1(F.col("o_orderkey").cast("string").cast("binary"))).alias("shard"))


# graph

_EDGE = "e0 AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_shipdate FROM lineitem), e AS (SELECT l_partkey AS source, lead(l_partkey) OVER w AS target, CASE l_returnflag WHEN 'A' THEN 'call' WHEN 'N' THEN 'reference' ELSE 'import' END AS kind, CAST(l_linenumber AS BIGINT) AS line, CASE WHEN l_shipdate < TIMESTAMP '1995-06-17' THEN 'base' ELSE 'target' END AS endpoint FROM e0 WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_shipdate))"


def _edges(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag", "l_shipdate")
    e = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_shipdate").distinct()
    kind = F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "N", "reference").otherwise("import")
    side = F.when(F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp"), "base").otherwise("target")
    return e.select(F.col("l_partkey").alias("source"), F.lead("l_partkey").over(w).alias("target"), kind.alias("kind"), F.col("l_linenumber").cast("long").alias("line"), side.alias("endpoint")).where("target is not null")


@query(f"WITH {_EDGE}, m AS (SELECT source, target, kind, min(line) FILTER (endpoint = 'base') AS b, min(line) FILTER (endpoint = 'target') AS t FROM e WHERE target IS NOT NULL GROUP BY ALL) SELECT source, target, kind, coalesce(t, b) AS line, CASE WHEN b IS NOT NULL AND t IS NOT NULL THEN 'both' WHEN t IS NOT NULL THEN 'target' ELSE 'base' END AS endpoint FROM m")
def edge_merge(spark, d):
    """Edges of two endpoints as one graph."""
    return graph.merge_edges(_edges(spark, d))


@query(f"WITH {_EDGE} SELECT DISTINCT source, target, kind FROM e WHERE target IS NOT NULL AND (source <= 20 OR target <= 20)")
def incident_edges(spark, d):
    """Edges at the first twenty parts."""
    return graph.incident(_edges(spark, d), _t(spark, d, "part").where("p_partkey <= 20").select(F.col("p_partkey").alias("node")))


_STEP = "k AS (SELECT DISTINCT source, target, CASE kind WHEN 'call' THEN 1 WHEN 'reference' THEN 2 ELSE 3 END AS k FROM e WHERE target IS NOT NULL)"


@query(f"""WITH {_EDGE}, {_STEP},
  l1 AS (SELECT source AS node, min(k) AS k FROM k WHERE target <= 3 GROUP BY ALL),
  f1 AS (SELECT node FROM l1 WHERE node > 3),
  l2 AS (SELECT source AS node, min(k) AS k FROM k WHERE target IN (SELECT node FROM f1) GROUP BY ALL),
  a AS (SELECT node, CASE WHEN node <= 3 THEN 0 ELSE 1 END AS distance, k FROM l1 UNION ALL SELECT node, CASE WHEN node <= 3 THEN 0 ELSE 2 END, k FROM l2 WHERE node NOT IN (SELECT node FROM l1))
  SELECT node, CAST(distance AS BIGINT) AS distance, CASE k WHEN 1 THEN 'call' WHEN 2 THEN 'reference' ELSE 'import' END AS via FROM a""")
def impact_closure(spark, d):
    """What reaches the first three parts within two steps."""
    return graph.closure(_edges(spark, d), _t(spark, d, "part").where("p_partkey <= 3").select(F.col("p_partkey").alias("node")))


@query(f"""WITH RECURSIVE {_EDGE}, g AS MATERIALIZED (SELECT DISTINCT source, target FROM e WHERE target IS NOT NULL),
  r(a, b) AS (SELECT source, target FROM g UNION SELECT r.a, g.target FROM r JOIN g ON g.source = r.b)
  SELECT x.a AS node, min(x.b) AS cycle FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY ALL""")
def impact_cycles(spark, d):
    """Cycles of the graph of consecutive parts; the SQL goes through all pairs that reach one another."""
    return graph.cycles(_edges(spark, d))


@query("""WITH a AS (SELECT DISTINCT p_brand AS path, 'exact' AS c, 'affected-test' AS r FROM part WHERE p_size < 10), b AS (SELECT DISTINCT p_brand, 'probable', 'lexical-name' FROM part WHERE p_size > 40),
  c AS (SELECT DISTINCT p_brand, 'probable', 'co-change' FROM part WHERE p_retailprice > 1500), u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
  SELECT path, min(c) AS confidence, array_to_string(list_sort(list(DISTINCT r)), ',') AS reasons FROM u GROUP BY ALL""")
def impact_tests(spark, d):
    """Evidence that brands are affected."""
    p = _t(spark, d, "part").withColumn("path", F.col("p_brand"))
    out = graph.test_evidence({"affected-test": p.where("p_size < 10"), "lexical-name": p.where("p_size > 40"), "co-change": p.where("p_retailprice > 1500")})
    return out.select("path", "confidence", F.array_join("reasons", ",").alias("reasons"))


# co-change

_TOUCH = "t0 AS (SELECT DISTINCT o_custkey AS seq, p_brand AS path FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey)"


@query(f"""WITH {_TOUCH}, w AS (SELECT DISTINCT seq FROM t0 WHERE seq % 10 <> 0 ORDER BY seq DESC LIMIT 50), t AS (SELECT * FROM t0 WHERE seq IN (SELECT seq FROM w)),
  small AS (SELECT seq FROM t GROUP BY seq HAVING count(*) * 10 <= 10 * (SELECT count(DISTINCT path) FROM t0)), k AS (SELECT t.* FROM t WHERE seq IN (SELECT seq FROM small)),
  n AS (SELECT path, count(*) AS c FROM k GROUP BY ALL), p AS (SELECT a.path AS seed, b.path, count(*) AS together FROM k a JOIN k b USING (seq) WHERE a.path IN ('Brand#11', 'Brand#22', 'Brand#33') AND b.path NOT IN ('Brand#11', 'Brand#22', 'Brand#33') GROUP BY ALL),
  j AS (SELECT p.seed, p.path, together, x.c AS commits_a, y.c AS commits_b, together * 1000000 // (x.c + y.c - together) AS jaccard_ppm FROM p JOIN n x ON x.path = p.seed JOIN n y ON y.path = p.path),
  o AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY jaccard_ppm DESC, together DESC, seed) AS r FROM j WHERE together >= 3 AND jaccard_ppm >= 300000)
  SELECT path, seed, together, commits_a, commits_b, CAST(jaccard_ppm AS BIGINT) AS jaccard_ppm FROM o WHERE r = 1""")
def co_change(spark, d):
    """Brands that are ordered with three given ones, in the newest fifty customers' baskets."""
    t = _t(spark, d, "orders").join(_t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("o_custkey").alias("seq"), F.col("p_brand").alias("path")).distinct()
    commits = t.select("seq").distinct().withColumn("parents", F.when(F.col("seq") % 10 == 0, 2).otherwise(1))
    inside = cochange.touched(t).join(cochange.window(commits).select("seq"), "seq", "left_semi")
    return cochange.co_changes(inside, t.where(F.col("path").isin("Brand#11", "Brand#22", "Brand#33")))


@query(f"""WITH {_TOUCH.replace('p_brand AS path', 'p_name AS path')}, w AS (SELECT DISTINCT seq FROM t0 WHERE seq % 10 <> 0 ORDER BY seq DESC LIMIT 50), t AS (SELECT * FROM t0 WHERE seq IN (SELECT seq FROM w))
  SELECT seq, path FROM t WHERE seq IN (SELECT seq FROM t GROUP BY seq HAVING count(*) <= 40 AND count(*) * 5 <= (SELECT count(DISTINCT path) FROM t0))""")
def co_change_kept(spark, d):
    """Baskets of the newest fifty customers that aren't bulk."""
    t = _t(spark, d, "orders").join(_t(spark, d, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("o_custkey").alias("seq"), F.col("p_name").alias("path")).distinct()
    commits = t.select("seq").distinct().withColumn("parents", F.when(F.col("seq") % 10 == 0, 2).otherwise(1))
    return cochange.kept_touches(commits, t, t, bulk_paths=40)


# deltas and refresh

_BASE = "b AS (SELECT 'd/' || doc_id AS path, md5(text) AS oid, CASE WHEN doc_id % 13 = 0 THEN 'x' ELSE 'f' END AS mode FROM documents WHERE doc_id % 10 <> 0)"
_TARGET = "t AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 'e/' ELSE 'd/' END || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN md5(text || '!') ELSE md5(text) END AS oid, CASE WHEN doc_id % 26 = 0 THEN 'x' ELSE 'f' END AS mode FROM documents WHERE doc_id % 10 <> 1)"


def _trees(spark, d):
    k = F.col("doc_id")
    docs = _t(spark, d, "documents")
    base = docs.where("doc_id % 10 <> 0").select(F.concat(F.lit("d/"), k.cast("string")).alias("path"), F.md5("text").alias("oid"), F.when(k % 13 == 0, "x").otherwise("f").alias("mode"))
    target = docs.where("doc_id % 10 <> 1").select(F.concat(F.when(k % 11 == 0, "e/").otherwise("d/"), k.cast("string")).alias("path"), F.md5(F.when(k % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("oid"), F.when(k % 26 == 0, "x").otherwise("f").alias("mode"))
    return base, target


_DELTA = f"""WITH {_BASE}, {_TARGET}, j AS (SELECT coalesce(b.path, t.path) AS path, b.oid AS bo, t.oid AS tn, b.mode AS bm, t.mode AS tm FROM b FULL JOIN t ON b.path = t.path WHERE NOT (b.oid IS NOT DISTINCT FROM t.oid AND b.mode IS NOT DISTINCT FROM t.mode)),
  k AS (SELECT *, CASE WHEN bo IS NULL THEN 'added' WHEN tn IS NULL THEN 'deleted' WHEN bm <> tm THEN 'type-changed' ELSE 'modified' END AS change FROM j),
  g AS (SELECT bo AS oid, path AS source, row_number() OVER (PARTITION BY bo ORDER BY path) AS n FROM k WHERE change = 'deleted'), c AS (SELECT tn AS oid, path, row_number() OVER (PARTITION BY tn ORDER BY path) AS n FROM k WHERE change = 'added'),
  p AS (SELECT CASE WHEN c.path IS NOT NULL AND g.source IS NOT NULL THEN 'renamed' WHEN c.path IS NOT NULL THEN 'added' ELSE 'deleted' END AS change, coalesce(c.path, g.source) AS path, CASE WHEN c.path IS NOT NULL THEN g.source END AS source, g.oid AS base_oid, c.oid AS target_oid FROM c FULL JOIN g ON c.oid = g.oid AND c.n = g.n),
  delta AS (SELECT * FROM p UNION ALL SELECT change, path, NULL, bo, tn FROM k WHERE change IN ('modified', 'type-changed'))"""


@query(f"{_DELTA} SELECT change, path, source, base_oid, target_oid FROM delta")
def tree_delta(spark, d):
    """Changes between two versions of the documents as files."""
    return delta.tree_delta(*_trees(spark, d))


def _changes(spark, d):
    x = delta.tree_delta(*_trees(spark, d))
    return x.select("path", F.when(F.col("change") == "deleted", "remove").when(F.col("change") == "renamed", "rename").otherwise("recheck").alias("action"), "source").unionByName(x.where("change = 'renamed' and path like '%5'").select("path", F.lit("recheck").alias("action"), F.lit(None).cast("string").alias("source")))


_PLAN = f"""{_DELTA}, ch AS (SELECT path, CASE change WHEN 'deleted' THEN 'remove' WHEN 'renamed' THEN 'rename' ELSE 'recheck' END AS action, source FROM delta UNION ALL SELECT path, 'recheck', NULL FROM delta WHERE change = 'renamed' AND path LIKE '%5'),
  pl AS (SELECT path, CASE max(CASE action WHEN 'recheck' THEN 3 WHEN 'rename' THEN 2 ELSE 1 END) WHEN 3 THEN 'recheck' WHEN 2 THEN 'rename' ELSE 'remove' END AS action, min(source) FILTER (action = 'rename') AS src FROM ch GROUP BY ALL),
  plan AS (SELECT path, action, CASE WHEN action = 'rename' THEN src END AS source FROM pl)"""


@query(f"{_PLAN} SELECT path, action, source FROM plan")
def refresh_plan(spark, d):
    """What a refresh does with each changed file."""
    return delta.refresh_plan(_changes(spark, d))


@query(f"{_PLAN} SELECT path, oid FROM b WHERE path NOT IN (SELECT path FROM plan) AND path NOT IN (SELECT source FROM plan WHERE source IS NOT NULL)")
def refresh_retained(spark, d):
    """Files that a refresh keeps."""
    return delta.retained(_trees(spark, d)[0].select("path", "oid"), delta.refresh_plan(_changes(spark, d)))


@query(f"WITH {_BASE}, {_TARGET} SELECT CASE WHEN a + r + c = 0 THEN 'fresh' ELSE 'stale' END AS label, a AS added, r AS removed, c AS changed, u AS unchanged FROM (SELECT count_if(b.oid IS NULL)::BIGINT AS a, count_if(t.oid IS NULL)::BIGINT AS r, count_if(b.oid <> t.oid)::BIGINT AS c, count_if(b.oid = t.oid)::BIGINT AS u FROM b FULL JOIN t ON b.path = t.path)")
def index_status(spark, d):
    """Whether an index is fresh, and how far it is off."""
    return delta.status(*_trees(spark, d))


@query("""WITH b AS (SELECT p_brand AS path, p_partkey AS id, p_type AS qualified, p_size FROM part WHERE p_partkey % 5 <> 0), t AS (SELECT p_brand AS path, p_partkey + 1000000 AS id, p_type AS qualified, p_size FROM part WHERE p_partkey % 7 <> 0),
  x AS (SELECT *, row_number() OVER (PARTITION BY path, qualified ORDER BY p_size, id) AS n FROM b), y AS (SELECT *, row_number() OVER (PARTITION BY path, qualified ORDER BY p_size, id) AS n FROM t)
  SELECT coalesce(x.path, y.path) AS path, 'function' AS kind, coalesce(x.qualified, y.qualified) AS qualified, x.id AS base_id, y.id AS target_id FROM x FULL JOIN y ON x.path = y.path AND x.qualified = y.qualified AND x.n = y.n""")
def definition_pairing(spark, d):
    """Definitions of two versions, paired by name and order."""
    p = _t(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("id"), F.lit("function").alias("kind"), F.col("p_type").alias("qualified"), F.col("p_size").alias("start"))
    return delta.pair_definitions(p.where("id % 5 <> 0"), p.where("id % 7 <> 0").withColumn("id", F.col("id") + 1_000_000))


@query("SELECT doc_id, sha1(encode('blob ' || octet_length(encode(text))) || unhex('00') || encode(text)) AS oid FROM documents")
def blob_identity(spark, d):
    """Blob identity of each document."""
    return _t(spark, d, "documents").select("doc_id", tree.blob_oid(F.encode("text", "utf-8")).alias("oid"))


# scopes

_FID = "CASE page_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END"


@query(f"""WITH f AS (SELECT string_split({_URL}, '/') AS parts, {_FID} AS f FROM pages), a AS (SELECT array_to_string(parts[1:k], '/') AS scope, f FROM f, unnest(range(0, len(parts))) AS x(k))
  SELECT scope, count(*) AS files, CASE max(f) WHEN 1 THEN 'complete' WHEN 2 THEN 'tags' WHEN 3 THEN 'lexical' ELSE 'degraded' END AS fidelity FROM a GROUP BY scope""")
def scope_rollup(spark, d):
    """Files and worst fidelity of every directory of page paths."""
    fid = F.element_at(F.array(*map(F.lit, scopes.FIDELITY)), (F.col("page_id") % 4 + 1).cast("int"))
    p = _t(spark, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"), fid.alias("fidelity"))
    return scopes.rollup(p)


@query(f"""WITH f AS (SELECT string_split({_URL}, '/') AS parts FROM pages), s AS (SELECT DISTINCT array_to_string(parts[1:k], '/') AS scope FROM f, unnest(range(0, len(parts))) AS x(k))
  SELECT regexp_replace(c.scope, '(^|/)[^/]*$', '') AS scope, c.scope AS child FROM s c WHERE c.scope <> ''""")
def scope_children(spark, d):
    """Direct subdirectories."""
    p = _t(spark, d, "pages").select(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("path"), F.lit("tags").alias("fidelity"))
    return scopes.children(scopes.rollup(p))


@query(f"""WITH v AS (SELECT p_brand AS scope, term, count(DISTINCT p_partkey) AS votes FROM (SELECT p_brand, p_partkey, unnest({lexing.tokens_sql("p_name || ' ' || p_type")}) AS term FROM part) GROUP BY ALL),
  t AS (SELECT *, row_number() OVER w AS r, sum(strlen(term) + 2) OVER (PARTITION BY scope ORDER BY votes DESC, term ROWS UNBOUNDED PRECEDING) - 2 AS size FROM v WINDOW w AS (PARTITION BY scope ORDER BY votes DESC, term))
  SELECT scope, string_agg(term, ', ' ORDER BY r) AS purpose FROM t WHERE r <= 8 AND size <= 160 GROUP BY scope""")
def scope_seed_terms(spark, d):
    """What each brand is about, by the words of most of its parts."""
    p = _t(spark, d, "part").select(F.col("p_brand").alias("scope"), F.col("p_partkey").alias("symbol_id"), F.explode(lexing.tokens(F.concat_ws(" ", "p_name", "p_type"))).alias("term"))
    return scopes.seed_terms(p)


@query(r"WITH r AS (SELECT p_brand AS scope, array_to_string([p_type, 'function', 'public', p_name, p_brand || '/x'], chr(31)) AS row FROM part) SELECT scope, sha256(string_agg(row, chr(30) ORDER BY row)) AS api_hash FROM r GROUP BY scope")
def scope_api_hash(spark, d):
    """API hash of each brand."""
    p = _t(spark, d, "part").select(F.col("p_brand").alias("scope"), F.concat("p_brand", F.lit("/x")).alias("path"), F.col("p_type").alias("qualified"), F.lit("function").alias("kind"), F.lit("public").alias("visibility"), F.col("p_name").alias("signature"))
    return scopes.api_hashes(p)


# learned answers


@query("""WITH l AS (SELECT 'u' || user_id AS key, event_type AS anchor, CAST(value AS FLOAT) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, event_type) AS r FROM events)
  SELECT key, anchor, CAST(CAST(floor(v) AS BIGINT) % 7 AS FLOAT) / CAST(8 AS FLOAT) AS confidence FROM l WHERE r = 1 ORDER BY CAST(floor(v) AS BIGINT) % 7 DESC, key LIMIT 64""")
def route_evict(spark, d):
    """The last answer of each user, then the 64 most confident."""
    conf = (F.floor(F.col("value").cast("float")).cast("long") % 7).cast("float") / F.lit(8).cast("float")
    ev = _t(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.col("event_type").alias("anchor"), F.lit("m").alias("map"), F.lit("i").alias("api_identity"), conf.cast("float").alias("confidence"), F.col("event_id").alias("seq"))
    none = ev.select(*routes.COLUMNS).where("false")
    return routes.evict(routes.upsert(none, ev), 64).select("key", "anchor", "confidence")


@query("""WITH p AS (SELECT p_partkey AS k, 'a' || CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_partkey END AS anchor FROM part)
  SELECT c_custkey AS query_id, anchor FROM customer JOIN p ON k = c_custkey WHERE c_custkey % 3 <> 0 AND k % 11 <> 0""")
def route_lookup(spark, d):
    """Learned answers that still hold."""
    name = F.concat(F.lit("a"), F.when(F.col("p_partkey") % 11 == 0, 0).otherwise(F.col("p_partkey")).cast("string"))
    p = _t(spark, d, "part").withColumn("anchor", name)
    learned = p.select(F.concat(F.lit("k"), F.col("p_partkey").cast("string")).alias("key"), "anchor", (F.col("p_partkey") % 3).cast("string").alias("map"), F.lit("same").alias("api_identity"), F.lit(0.5).cast("float").alias("confidence"))
    ask = _t(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("key"))
    ids = spark.createDataFrame([("0", "other"), ("1", "same"), ("2", "same")], "map string, api_identity string")
    return routes.lookup(learned, ask, p.select("anchor"), ids).select("query_id", "anchor")


# checks and quality


@query("""WITH c AS (SELECT 0::BIGINT AS fatal, (SELECT count(*) FROM orders WHERE o_totalprice < 0) AS errors, (SELECT count(*) FROM part WHERE p_size < 5) + (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS warnings)
  SELECT *, CASE WHEN errors > 0 THEN 'errors' WHEN warnings > 0 THEN 'warnings' ELSE 'ok' END AS status, CASE WHEN errors > 0 THEN 3 WHEN warnings > 0 THEN 1 ELSE 0 END AS exit_code FROM c""")
def check_status(spark, d):
    """Diagnostics of three rules as counts and an exit code."""
    bad = checks.emit(_t(spark, d, "orders").where("o_totalprice < 0").select(F.col("o_orderkey").alias("actual")), "0102_MAP_INVALID", "negative price")
    small = checks.emit(_t(spark, d, "part").where("p_size < 5").select(F.col("p_name").alias("anchor")), "0302_ROUTE_ANCHOR_MISSING", "small part")
    debt = checks.emit(_t(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_name").alias("path")), "0303_ROUTE_API_STALE", "debt")
    return checks.counts(checks.union(bad, small, debt))


_OUTCOMES = ["ready", "missing", *checks.CORRUPT, *checks.INCOMPATIBLE]


@query(f"""WITH o AS (SELECT c_custkey, ([{", ".join(f"'{x}'" for x in _OUTCOMES)}])[c_custkey % {len(_OUTCOMES)} + 1] AS outcome, c_acctbal < 0 AS stale FROM customer)
  SELECT CAST(c_custkey AS VARCHAR) AS path, CASE WHEN outcome = 'ready' THEN '0004_SNAPSHOT_STALE' WHEN outcome = 'missing' THEN '0001_SNAPSHOT_MISSING' WHEN c_custkey % {len(_OUTCOMES)} < {2 + len(checks.CORRUPT)} THEN '0002_SNAPSHOT_CORRUPT' ELSE '0003_SNAPSHOT_INCOMPATIBLE' END AS rule_id,
  CASE WHEN outcome = 'ready' THEN 'stale' ELSE outcome END AS actual, CASE outcome WHEN 'ready' THEN 'warning' WHEN 'missing' THEN 'fatal' ELSE 'error' END AS severity FROM o WHERE outcome <> 'ready' OR stale""")
def check_snapshot(spark, d):
    """Customers as indexes, each with what loading it gave."""
    c = _t(spark, d, "customer")
    outcome = F.get(F.array(*map(F.lit, _OUTCOMES)), (F.col("c_custkey") % len(_OUTCOMES)).cast("int"))
    seen = c.select(F.col("c_custkey").cast("string").alias("path"), outcome.alias("outcome"), F.when(F.col("c_acctbal") < 0, "stale").otherwise("fresh").alias("label"))
    return checks.snapshot_diagnostics(seen).select("path", "rule_id", "actual", "severity")


@query("""WITH p AS (SELECT 'd' || p_partkey || '/MAP.md' AS path, p_partkey % 13 AS k FROM part)
  SELECT path, CASE WHEN k IN (1, 10) THEN '0103_MAP_STALE' WHEN k IN (2) THEN '0101_MAP_MISSING' WHEN k IN (3, 4, 5, 6, 12) THEN '0106_MAP_NOT_WRITABLE' ELSE '0102_MAP_INVALID' END AS rule_id,
  CASE k WHEN 3 THEN 'symlink' WHEN 4 THEN 'unreadable' WHEN 5 THEN 'merge-conflict' WHEN 6 THEN 'not-owned' WHEN 7 THEN 'frontmatter' WHEN 8 THEN 'unsupported-format' WHEN 9 THEN 'purpose' WHEN 11 THEN 'generated-edited' WHEN 12 THEN 'case-collision' END AS actual FROM p WHERE k <> 0""")
def check_artifacts(spark, d):
    """Pages of directories, a part each: intact, stale, missing, or in conflict in each of nine ways."""
    p = _t(spark, d, "part").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string"), F.lit("/MAP.md")).alias("path"), (F.col("p_partkey") % 13).alias("k"), F.col("p_name").alias("name"))
    k = F.col("k")
    body = lambda purpose: F.concat(F.lit("# d\n\n"), purpose, F.lit("\n\n"))
    page = lambda b, form="2": F.concat(F.lit(f"---\nformat: {form}\ndigest: "), F.sha2(b, 256), F.lit("\n---\n"), b)
    good, other = body(F.col("name")), body(F.concat("name", F.lit(" more")))
    text = (
        F.when(k.isin(1, 10), page(other)).when(k == 5, F.concat(page(good), F.lit("<<<<<<< ours\n"))).when(k == 6, F.lit("# mine\n")).when(k == 7, F.regexp_replace(page(good), "digest", "sum"))
        .when(k == 8, page(good, "1")).when(k == 9, page(body(F.repeat(F.lit("x"), 161)))).when(k == 11, F.concat(page(good), F.lit("x"))).when(k != 4, page(good))
    )
    planned = p.select("path", F.sha2(good, 256).alias("digest"))
    there = p.where(k != 2).select(F.when(k == 12, F.upper("path")).otherwise(F.col("path")).alias("path"), F.sha2(F.when(k.isin(1, 10), other).otherwise(good), 256).alias("digest"), F.lit(True).alias("owned"), scopes.conflict_reason(text, k == 3).alias("reason"))
    return checks.artifact_diagnostics(scopes.compare_generation(planned, there), "map").select("path", "rule_id", "actual")


@query("SELECT p_name || p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN 'miss' WHEN p_partkey % 7 = 0 THEN 'corrupt' ELSE 'hit' END AS outcome FROM part")
def cache_outcomes(spark, d):
    """Parts as files, two thirds of them with stored facts, some damaged."""
    p = _t(spark, d, "part").withColumn("oid", F.col("p_partkey").cast("string")).withColumn("lang", F.lit("rust"))
    k = F.col("p_partkey")
    entries = p.where(k % 3 != 0).select("oid", "lang", F.lit("x").alias("extractor"), F.lit(1).alias("schema"), F.when(k % 7 == 0, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name")).alias("payload"), F.sha2("p_name", 256).alias("checksum"))
    return store.cache_outcomes(p.select(F.concat("p_name", "oid").alias("path"), "oid", "lang"), entries, "x", 1)


_VERDICT = """v AS (SELECT CASE WHEN quality = 1 THEN 'answerable' ELSE 'must-abstain' END AS ex, doc_id % 5 <> 0 AS permitted, doc_id % 3 = 0 AS direct, CASE WHEN quality = 1 THEN CAST(doc_id % 6 + 1 AS BIGINT) END AS acc, CASE WHEN toxic = 1 THEN CAST(doc_id % 4 + 1 AS BIGINT) END AS forb FROM labels),
  h AS (SELECT *, coalesce(acc <= 1, false) AND (forb IS NULL OR coalesce(forb > acc, false)) AS h1, coalesce(acc <= 3, false) AND (forb IS NULL OR coalesce(forb > acc, false)) AS h3 FROM v)"""


def _verdicts(spark, d):
    k = F.col("doc_id")
    return _t(spark, d, "labels").select(F.when(F.col("quality") == 1, "answerable").otherwise("must-abstain").alias("expectation"), (k % 5 != 0).alias("direct_permitted"), (k % 3 == 0).alias("answered_direct"), F.when(F.col("quality") == 1, k % 6 + 1).alias("accepted_rank"), F.when(F.col("toxic") == 1, k % 4 + 1).alias("forbidden_rank"))


def _ppm_sql(a: str, b: str) -> str:
    return f"CASE WHEN {b} <> 0 THEN CAST((CAST({a} AS HUGEINT) * 2000000 + {b}) // (2 * {b}) AS BIGINT) END"


_METRICS = f"""WITH {_VERDICT}, c AS (SELECT count_if(ex = 'answerable')::BIGINT AS answerable, count_if(ex = 'must-abstain')::BIGINT AS must_abstain, count(*) AS cases, count_if(ex = 'answerable' AND h1)::BIGINT AS top1, count_if(ex = 'answerable' AND h3)::BIGINT AS top3,
  count_if(direct)::BIGINT AS directs, count_if(direct AND (NOT permitted OR ex = 'must-abstain' OR NOT h1))::BIGINT AS false_directs, count_if(NOT direct)::BIGINT AS abstained, count_if(ex = 'must-abstain' AND NOT direct)::BIGINT AS kept_back FROM h)"""


@query(f"{_METRICS} SELECT *, {_ppm_sql('top1', 'answerable')} AS top1_ppm, {_ppm_sql('top3', 'answerable')} AS top3_ppm, {_ppm_sql('(directs - false_directs)', 'directs')} AS direct_precision_ppm, {_ppm_sql('abstained', 'cases')} AS abstention_ppm, {_ppm_sql('kept_back', 'must_abstain')} AS required_abstention_ppm FROM c")
def routing_metrics(spark, d):
    """Metrics of verdicts made from labels."""
    return quality.routing_metrics(_verdicts(spark, d))


@query(f"""{_METRICS}, f AS (SELECT unnest([CASE WHEN answerable <> 40 THEN 'oracle-under-sized' END, CASE WHEN top3 * 40 < answerable * 36 OR answerable = 0 THEN 'top3-below-gate' END, CASE WHEN false_directs > 0 THEN 'false-direct' END, CASE WHEN false_directs <> 0 THEN 'direct-precision-below-one' END,
    CASE WHEN kept_back <> must_abstain THEN 'required-abstention-below-one' END, CASE WHEN top1 + 1 < 1000000 THEN 'top1-regressed-beyond-slack' END, CASE WHEN EXISTS (FROM labels WHERE doc_id % 97 = 0) THEN 'safety-case-failed' END,
    CASE WHEN EXISTS (FROM orders WHERE CAST(o_totalprice AS BIGINT) * 10 > 150000 * 11 AND CAST(o_totalprice * 0.9 AS BIGINT) * 20 > 150000 * 21) THEN 'performance-regression' END,
    CASE WHEN NOT EXISTS (FROM labels) OR NOT EXISTS (FROM orders) THEN 'evidence-missing' END]) AS failure FROM c)
  SELECT failure FROM f WHERE failure IS NOT NULL""")
def release_gate(spark, d):
    """What stops a release with these metrics, safety cases and performance cases."""
    safety = _t(spark, d, "labels").select((F.col("doc_id") % 97 != 0).alias("passed"))
    return quality.release_gate(quality.routing_metrics(_verdicts(spark, d)), safety, performance_gate(spark, d), 1_000_000)


@query("""WITH c AS (SELECT quality = 1 AS yes, CAST(n_chars AS BIGINT) AS score FROM labels JOIN documents USING (doc_id)), p AS (SELECT score, count_if(yes) AS y, count_if(NOT yes) AS n FROM c GROUP BY ALL),
  s AS (SELECT score, coalesce(sum(n) OVER b, 0) AS below, sum(y) OVER () - coalesce(sum(y) OVER b, 0) AS above, coalesce(lag(score) OVER (ORDER BY score), -1) AS before FROM p WINDOW b AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT CAST((before + 1 + score) // 2 AS BIGINT) AS none_below, CAST(below + above AS BIGINT) AS "right", before AS "after", score AS upto FROM s ORDER BY below + above DESC, score - before DESC, score LIMIT 1""")
def threshold_fit(spark, d):
    """The length that best tells good documents."""
    c = _t(spark, d, "labels").join(_t(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select((F.col("quality") == 1).alias("answerable"), F.col("n_chars").cast("long").alias("score"))
    return quality.fit_thresholds(c)


@query("SELECT c_custkey, CAST(('0x' || sha256(c_name)[57:64]) AS BIGINT) % 4 AS shard FROM customer")
def shard_assignment(spark, d):
    """Shard of each customer as a case."""
    return _t(spark, d, "customer").select("c_custkey", quality.shard_of("c_name").alias("shard"))


@query("SELECT o_orderkey AS case_id, o_totalprice >= 0 AND CAST(o_totalprice AS BIGINT) * 10 > 150000 * 11 AND CAST(o_totalprice * 0.9 AS BIGINT) * 20 > 150000 * 21 AS blocked FROM orders")
def performance_gate(spark, d):
    """Orders as benchmark cases against a baseline."""
    o = _t(spark, d, "orders")
    p = F.round("o_totalprice").cast("long")
    return quality.performance_gate(o.select(F.col("o_orderkey").alias("case_id"), p.alias("time"), F.lit(150_000).alias("baseline"), F.rint(F.col("o_totalprice") * 0.9).cast("long").alias("low"), F.lit(150_000).alias("low_base")))


@query("""WITH x AS (SELECT 'c' || c_custkey AS case_id, 'routing' AS kind FROM customer), r AS (SELECT 'c' || c_custkey AS case_id, CASE WHEN c_custkey % 50 = 3 THEN 'safety' ELSE 'routing' END AS kind, CAST(('0x' || sha256('c' || c_custkey)[57:64]) AS BIGINT) % 4 + CASE WHEN c_custkey % 50 = 4 THEN 1 ELSE 0 END AS shard FROM customer WHERE c_custkey % 50 <> 2)
  SELECT 'c' || c_custkey AS case_id, CASE c_custkey % 50 WHEN 2 THEN 'missing' WHEN 3 THEN 'wrong-kind' WHEN 4 THEN 'wrong-shard' END AS anomaly FROM customer WHERE c_custkey % 50 IN (2, 3, 4)""")
def shard_aggregation(spark, d):
    """Anomalies of reported cases against expected ones."""
    k = F.col("c_custkey")
    c = _t(spark, d, "customer").select(k, F.concat(F.lit("c"), k.cast("string")).alias("case_id"))
    want = c.select("case_id", F.lit("routing").alias("kind"), F.lit("m").alias("manifest"))
    got = c.where(k % 50 != 2).select("case_id", F.when(k % 50 == 3, "safety").otherwise("routing").alias("kind"), (quality.shard_of("case_id") + F.when(k % 50 == 4, 1).otherwise(0)).alias("shard"), F.lit("m").alias("manifest"))
    return quality.aggregate_shards(want, got)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question answered over documents: decision and best document for each benchmark text."""
    return bm25_batch_decision(spark, sf_dir)
