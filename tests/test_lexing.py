import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomdex.functions import encoding, languages, lexing


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_tokens(spark):
    cases = {"HTTPServer": "http server", "HTTPs": "htt ps", "sha256Hash": "sha256 hash", "sha256": "sha 256", "a1b2": "a1 b 2", "snake_case r#type": "snake case type", "Éléphant été": "éléphant été", "": "", "日本 語x": "日本 語 x"}
    for text, want in cases.items():
        assert " ".join(one(spark, lexing.tokens("t"), t=text)) == want


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abABxYZ019_ .é", max_size=24))
def test_look_ahead_equals_steps(text):
    direct = regex.findall(lexing.TOKEN, text)
    for a, b in lexing.TOKEN_STEPS:
        text = regex.sub(a, b, text)
    assert direct == regex.findall(lexing.TOKEN_RE2, text)


def test_query_terms_and_key(spark):
    assert one(spark, lexing.query_terms("t"), t="How is the configuration parsed, parsed?") == ["configuration", "configure", "parsed", "parse"]
    assert one(spark, lexing.route_key("t"), t="Where is the parser of the Config?") == one(spark, lexing.route_key("t"), t="config parser")
    assert len(lexing.STOP_WORDS) == 46 and len(lexing.STEMS) == 38


def test_atoms(spark):
    kind = lambda t, lone=False: one(spark, lexing.atom_kind(F.col("t"), F.col("lone")), t=t, lone=lone)
    assert [kind("src/a.rs"), kind("a::b"), kind("a.b"), kind("parseConfig"), kind("snake_case"), kind("word"), kind("word", True), kind("a.1")] == ["path", "qualified", "qualified", "symbol", "symbol", None, "symbol", None]
    assert lexing.strip_punctuation("(`name`,)?") == "name" and lexing.strip_punctuation('"') == '"'


def test_numbers(spark):
    r = spark.sql("select 301234 a, 1 p, 3 w, 0 z").select(lexing.six_decimals("a").alias("s"), lexing.ratio_ppm(F.col("p"), F.col("w")).alias("r"), lexing.ratio_ppm(F.col("p"), F.col("z")).alias("n"), lexing.at_least(F.col("p"), F.col("w"), 1, 3).alias("l"), lexing.exceeds(F.col("p"), F.col("w"), 1, 3).alias("e")).first()
    assert (r.s, r.r, r.n, r.l, r.e) == ("0.301234", 333_333, None, True, False)
    h = spark.sql("select 'ab' a, 'c' b, 'a' c, 'bc' d").select((lexing.structural_hash(F.col("a"), F.col("b")) == lexing.structural_hash(F.col("c"), F.col("d"))).alias("same"))
    assert not h.first().same


def test_quotients_just_below_a_whole_number(spark):
    big = 2**53 + 1
    rows = spark.createDataFrame([(296_169, 2_946_706), (139_414, 1_496_589), (3 * 10**8, 9 * 10**8 - 1), (1, 2_000_000), (0, 7), (big, 2**40 + 1)], "p long, w long")
    got = rows.select("p", "w", lexing.ratio_ppm(F.col("p"), F.col("w")).alias("r"), lexing.six_decimals("p").alias("s"), lexing.six_decimals(F.col("w") * 1_000_000 - 1).alias("t")).collect()
    for r in got:
        assert (r.r, r.s, r.t) == ((r.p * 2_000_000 + r.w) // (2 * r.w), f"{r.p // 10**6}.{r.p % 10**6:06d}", f"{r.w - 1}.999999")


def test_anchor_round_trip(spark):
    for t in ["a#b%c", "tab\there", "plain", "%25", "\x01\x7f"]:
        e = one(spark, encoding.encode_anchor("t"), t=t)
        assert "#" not in e and encoding.decode_anchor_text(e) == t
    assert encoding.decode_anchor_text("%41") is None and encoding.decode_anchor_text("%2f") is None
    assert one(spark, encoding.code_span("t"), t="a`b") == "``a`b``"
    assert one(spark, lexing.display_signature("t"), t=" fn  a(\n\tb: c) ") == "fn a( b: c)"


def test_languages(spark):
    lang = lambda p: one(spark, languages.language("p"), p=p)
    assert [lang("a/B.RS"), lang("x.pyi"), lang("Makefile"), lang(".rs"), lang("a.tar.gz"), lang("t.d.ts")] == ["rust", "python", None, None, None, "typescript"]
    test = lambda p, g: one(spark, languages.is_test("p", "g"), p=p, g=g)
    assert test("tests/x.rs", "rust") and test("a/foo_test.go", "go") and test("a.spec.ts", "typescript") and test("FooTest.java", "java") and not test("contest.rs", "rust") and not test("a/test_x.go", "go")
    gen = lambda p, h: one(spark, languages.is_generated("p", "h"), p=p, h=h)
    assert gen("a/generated/x.rs", "") and gen("x.pb.go", "") and gen("a.rs", "\n\n// Code generated. Do not edit.\n") and not gen("a.rs", "1\n2\n3\n4\n5\n@generated")
    q = lambda p, g, local, n: one(spark, languages.qualify(languages.module_prefix("p", "g"), F.col("l"), F.col("n"), "g"), p=p, g=g, l=local, n=n)
    assert q("src/auth/mod.rs", "rust", "T::f", "f") == "auth::T::f" and q("src/lib.rs", "rust", None, "f") == "f" and q("pkg/__init__.py", "python", None, "f") == "pkg.f"
    assert languages.table(spark).count() == 27 and languages.table(spark).where("is_code").count() == 21
