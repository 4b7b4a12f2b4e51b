"""Each corpus operator against brute force, its SQL or a round trip, and on nulls, empty tables, ties, repeated rows and clashing names."""

import base64
import collections
import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomdex.llm import decontaminate, html_extract, language_id, line_dedup, mixing, ngram_join, pii, quality_rules, queries, toxicity, warc
from loomdex.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_words long, term string, rep long"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, g, s, 7, "x", 1) for k, t, g, s in rows], DOCS)


WORDS = [f"w{k}" for k in range(400)] + ["été", "naïve", "straße"]


def prose(r, n):
    return " ".join(r.choice(WORDS) for _ in range(n))


ODD = [(900, None, None, None), (901, "", "en", ""), (902, " \t\n ", "en", "a"), (903, "one", None, "a"), (None, "a null id with several words in it", "en", "b"), (904, "same same same same same same", "en", None), (904, "same same same same same same", "en", None)]


# n-gram join


def brute_components(rows):
    sets = {}
    for k, t, *_ in rows:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ks = sorted(sets)
    for i, a in enumerate(ks):
        for b in ks[i + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in ks}


def near_corpus(seed, n=120):
    r = random.Random(seed)
    rows, k = [], 0
    passage = prose(r, 60)
    while len(rows) < n:
        base = prose(r, r.choice([1, 3, 5, 6, 9, 30, 80, 250, 330, 700])).split()
        for _ in range(r.choice([1, 1, 1, 2, 6])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, len(w) // 40])):
                w[r.randrange(len(w))] = "edit" + str(r.random())
            if r.random() < 0.3:
                w += passage.split()
            rows.append((k, " ".join(w), "en", "a"))
            k += 1
    return rows


@pytest.mark.parametrize("seed,block", [(1, 2000), (2, 3), (3, 5)])
def test_jaccard_components(spark, monkeypatch, seed, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)  # small blocks: families of several blocks
    monkeypatch.setattr(ngram_join, "CHUNK_TOKENS", 5000)
    rows = near_corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(spark, rows).repartition(3)).collect()}
    assert got == brute_components(rows)


def test_jaccard_large_family_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 8)
    r = random.Random(4)
    base = prose(r, 120).split()
    rows = []
    for k in range(60):
        w = list(base)
        w[r.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(w), "en", "a"))
    # a chain: each links with the next only
    w = prose(r, 200).split()
    for k in range(60, 80):
        w[(k - 60) * 6 % 200] = f"c{k}"
        w[(k - 60) * 6 % 200 + 1] = f"d{k}"
        rows.append((k, " ".join(w), "en", "a"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_odd_rows(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs(spark, ODD)).collect()), key=str)
    assert got == sorted([(900, 0, 900), (901, 0, 901), (902, 0, 902), (903, 1, 903), (None, 4, None), (904, 1, 904), (904, 1, 904)], key=str)
    assert ngram_join.jaccard_components(docs(spark, [])).count() == 0


def test_signature_tree_bound_never_loses_a_link():
    r = np.random.default_rng(3)
    sets = []
    for _ in range(40):
        base = np.unique(r.integers(0, 2**64, r.integers(1, 900), dtype=np.uint64))
        for _ in range(3):
            keep = base[r.random(len(base)) > r.choice([0.0, 0.05, 0.12])]
            sets.append(np.unique(np.concatenate([keep, r.integers(0, 2**64, 2, dtype=np.uint64)])))
    found = ngram_join.join_sets(list(range(len(sets))), sets)
    a, b = ngram_join.Forest(len(sets)), ngram_join.Forest(len(sets))
    for x, y in found:
        a.join(x, y)
    for i in range(len(sets)):
        for j in range(i):
            if ngram_join.linked(sets[i], sets[j]):
                b.join(i, j)
    assert [a.find(i) for i in range(len(sets))] == [b.find(i) for i in range(len(sets))]


def test_components(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(30, 60)] + [(3, 2), (2, 9), (9, 9)], "a long, b long")
    got = {r.node: r.component for r in components(e, "a", "b", "t").collect()}
    assert got == {**{k: 30 for k in range(30, 61)}, 2: 2, 3: 2, 9: 2}


# personal data


def brute_spans(text):
    out = []
    pats = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for n, (kind, p) in enumerate(pats.items()):
        for m in re.finditer(p, text):
            d = [int(c) for c in re.sub("[^0-9]", "", m[0])]
            luhn = sum(sum(divmod(c * 2, 10)) if i % 2 else c for i, c in enumerate(reversed(d))) % 10 == 0
            good = kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn or kind == "phone" and 9 <= len(d) <= 15
            if good:
                out.append((m.start(), n, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_patterns():
    r = random.Random(5)
    pieces = ["a.b@c-d.org", "x@y", "@", "a@b@c.de.", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "5", "+1 (487) 555-7209", "+12", "++49 30 123456", " ", "é", "12345678901234567890123", ".", "-", "word"]
    for _ in range(3000):
        t = "".join(r.choice(pieces) + r.choice(["", " ", "", ","]) for _ in range(r.randrange(1, 9)))
        assert [x[:3] for x in pii.base_spans(t)] == brute_spans(t), t


def test_personal_data(spark):
    rows = [(k, f"filler words by the {own} quixotic warden wrote to chief.secret@hidden.org about {own}s again", "en", "a") for k, own in enumerate(["red", "blue", "green", "grey"])]
    rows += [(10 + k, f"plain text {'abcdefghij'[k % 10] * 4} the about again wrote words by", "en", "a") for k in range(40)] + ODD
    got = {r.doc_id: r for r in pii.personal_data(docs(spark, rows).dropDuplicates(["doc_id"])).collect()}
    base = rows[0][1].index("chief"), rows[0][1].index("hidden.org") + len("hidden.org")
    assert got[0].n_email == 1 and got[0].base_sha256 == hashlib.sha256(f"email:{base[0]}:{base[1]}".encode()).hexdigest()
    told = {tuple(map(int, s.split(":")[1:])) for s in got[0].spans.split(",") if s.startswith("term")}
    words = {rows[0][1][i:j] for i, j in told}
    assert {"quixotic", "warden"} <= words and not {"about", "the", "again", "wrote", "words"} & words
    assert got[900].base_sha256 == hashlib.sha256(b"").hexdigest() and got[900].spans == "" and got[11].spans == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(docs(spark, rows[:5]), spark.createDataFrame([got[k] for k in range(4)])).collect()}
    assert all(got[k].clean_sha256 == hashlib.sha256(clean[k].encode()).hexdigest() and got[k].n_spans == got[k].spans.count(":") // 2 for k in range(4)) and got[11].clean_sha256 is None
    assert "[EMAIL]" in clean[0] and "warden" not in clean[0] and "secret" not in clean[0] and clean[10] == rows[4][1]
    assert pii.personal_data(docs(spark, [])).count() == 0
    assert pii.personal_data(docs(spark, ODD)).count() == len(ODD)


def brute_terms(texts):
    """Disclosing terms of each text's spans by the definition, over distinct texts."""
    distinct = sorted({t for t in texts if t})
    df, of, co = collections.Counter(), collections.defaultdict(set), collections.defaultdict(set)
    for t in distinct:
        df.update({w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)})
        base = [(s, e, f"{k}:{v}") for s, k, e, v in pii.base_spans(t)]
        free = [(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"[^\W\d_]{3,}", t) if not any(s < m.end() and m.start() < e for s, e, _ in base)]
        for s, e, entity in base:
            near = [w for i, j, w in free if j <= s][-pii.NEAR :] + [w for i, _, w in free if i >= e][: pii.NEAR]
            of[entity].add(tuple(near))
            for w in near:
                co[entity, w].add(tuple(near))
    n, told = len(distinct), collections.defaultdict(set)
    for (entity, w), cs in co.items():
        own = np.log2(n / len(of[entity]))
        if len(cs) >= pii.SUPPORT and own > 0 and np.log2(n * len(cs) / (len(of[entity]) * df[w])) >= pii.THRESHOLD * own:
            told[entity].add(w)
    out = []
    for t in texts:
        base = [(s, e, f"{k}:{v}") for s, k, e, v in pii.base_spans(t or "")]
        mine = set().union(*(told[entity] for _, _, entity in base))
        out.append([f"term:{m.start()}:{m.end()}" for m in re.finditer(r"[^\W\d_]{3,}", t or "") if m[0].lower() in mine and not any(s < m.end() and m.start() < e for s, e, _ in base)])
    return out


def test_terms_against_brute_force(spark):
    r = random.Random(23)
    names, texts = [f"mail{k}@host{k}.org" for k in range(6)] + ["10.0.0.7", "+49 30 1234567"], []
    rare = {e: [f"{a}ville{a}" for a in (chr(97 + k), chr(107 + k))] for k, e in enumerate(names)}
    fill = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)] + ["İstanbul", "Straße", "ΣΊΣΥΦΟΣ"]
    for _ in range(220):
        w = [r.choice(fill) for _ in range(r.randrange(3, 40))]
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            e = r.choice(names)
            i = r.randrange(len(w) + 1)
            w[i:i] = r.sample([*rare[e], e, *(["İstanbul"] if e == names[0] else [])], k=len(rare[e]) + 1) if r.random() < 0.8 else [e]
        texts.append(" ".join(w))
    texts += texts[:60] + [None, ""]
    got = {x.doc_id: [s for s in x.spans.split(",") if s.startswith("term")] for x in pii.personal_data(docs(spark, [(k, t, "en", "a") for k, t in enumerate(texts)]).repartition(5)).collect()}
    want = brute_terms(texts)
    assert [got[k] for k in range(len(texts))] == want and sum(map(len, want)) > 50


def test_terms_of_copied_documents(spark):
    # df and N count a text once, however many copies of it there are, as contexts do
    told = [f"filler{own} words by the quixotic warden wrote to chief.secret@hidden.org about {own}s again" for own in ["red", "blue", "green"]]
    texts = told + [told[0]] * 300 + [f"plain text {c * 4} the about again wrote words by" for c in "abcdefghijklmnopqrstuvwxyz"]
    got = pii.personal_data(docs(spark, [(k, t, "en", "a") for k, t in enumerate(texts)]).repartition(4))
    for r in got.collect():
        words = {texts[r.doc_id][int(i) : int(j)] for k, i, j in (x.split(":") for x in r.spans.split(",") if x) if k == "term"}
        assert {"quixotic", "warden"} <= words if "chief" in texts[r.doc_id] else not words
        assert not {"about", "the", "again", "wrote", "words"} & words


def test_terms_anywhere_in_the_documents_of_an_entity(spark):
    # addresses beside one another don't use up the words; a term far from its entity goes too; so does one 60,000 characters off
    owns = ["red", "blue", "green", "grey"]
    many = "name.one@mail.example.com, other.two@mail.example.com; third.more@mail.example.com"
    texts = [f"the quixotic {own} {many} chief.secret@hidden.org {many} warden{' filler words' * 9} and {own}s about the warden again" for own in owns]
    texts += [f"quixotic{' .' * 30_000} chief.secret@hidden.org{' .' * 30_000} {own}" for own in owns]
    texts += [f"plain text {a}{b}{a}{b} the about again wrote words by and filler" for a in "abcdefghz" for b in "klmnop"]
    for r in pii.personal_data(docs(spark, [(k, t, "en", "a") for k, t in enumerate(texts)])).collect():
        text, k = texts[r.doc_id], r.doc_id
        spans = [(int(i), int(j)) for kind, i, j in (x.split(":") for x in r.spans.split(",") if x) if kind == "term"]
        words = [text[i:j] for i, j in spans]
        assert words.count("quixotic") == (1 if k < 8 else 0)
        base = [(s, e) for s, _, e, _ in pii.base_spans(text)]
        assert not any(s < j and i < e for i, j in spans for s, e in base) and not {"about", "again", "words"} & set(words)
    # in the same document beyond the window of its entity
    owner = [f"the quixotic {own} wrote chief.secret@hidden.org {'filler words ' * 9} quixotic" for own in owns] + [f"plain text {a * 4} the about wrote filler words" for a in "abcdefghijklmnop"]
    got = {r.doc_id: r.spans for r in pii.personal_data(docs(spark, [(k, t, "en", "a") for k, t in enumerate(owner)])).collect()}
    assert all(f"term:{m.start()}:{m.end()}" in got[k] for k in range(4) for m in re.finditer("quixotic", owner[k])) and not got[5]


# decontamination


def brute_contamination(texts, items):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wins = {}
    for k, t in items:
        w = word(t)
        for i in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[i : i + 10]), set()).update([] if k is None else [str(k)])
    out = []
    for t in texts:
        w, hit, who = word(t), set(), set()
        for m in {len(x) for x in wins}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in wins:
                    hit |= set(range(i, i + m))
                    who |= wins[tuple(w[i : i + m])]
        out.append((len(w), len(hit), len(who), hashlib.sha256(",".join(sorted(who)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("short", [False, True])
def test_contamination(spark, monkeypatch, short):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 700)
    r = random.Random(6)
    items = [(k, prose(r, r.choice([10, 11, 25])) + ".") for k in range(9)] + [(9, None), (10, "..."), (11, "a a a a a a a a a a a a")]
    items += [(12, "Straße, w1"), (13, "zzz"), (14, "a a")] if short else []
    items += [(3, prose(r, 12)), (3, items[3][1]), (None, prose(r, 15))]  # repeated and null ids
    rows = []
    for k in range(60):
        t = prose(r, r.choice([0, 3, 40, 200]))
        if k % 3 == 0:
            i = r.choice(items[:9] + items[11:] + items[-3:])[1]
            t += " " + i.upper().replace(" ", "-") + " " + prose(r, 3)
        rows.append((k, t + (" a" * 13 if k % 7 == 0 else ""), "en", "a"))
    rows += [x for x in ODD if x[0] != 904]
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id long")
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(docs(spark, rows), bench).collect()), key=str)
    assert got == sorted(((k, *b) for (k, *_), b in zip(rows, brute_contamination([x[1] for x in rows], items), strict=True)), key=str)
    kept = {r.doc_id for r in decontaminate.keep_clean(docs(spark, rows), bench).collect()}
    assert kept == {x[0] for x in got if not x[5]}
    assert decontaminate.contamination(docs(spark, []), bench).count() == 0
    assert decontaminate.contamination(docs(spark, rows), bench.limit(0)).where("n_hit > 0").count() == 0


def test_contamination_cuts_and_bounds(spark, monkeypatch):
    bench = spark.createDataFrame([(7, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    text = "Keep, this. One two three-four five six seven eight nine ten ELEVEN! And this."
    got = {x.doc_id: x for x in decontaminate.without_spans(docs(spark, [(1, text, "en", "a"), (2, "clean", "en", "a"), (3, None, None, None)]), bench).collect()}
    assert got[1].text == "Keep, this. ! And this." and got[2].text == "clean" and got[3].text is None and got[1].n_words == 7
    far = decontaminate.contamination(docs(spark, [(1, "filler " * 200_000 + text, "en", "a")]), bench).first()  # a very long text
    assert (far.n_words, far.n_hit, far.n_items) == (200_015, 11, 1)
    monkeypatch.setattr(decontaminate, "MAX_PHRASE_WORDS", 10)
    with pytest.raises(ValueError, match="11 words"):
        decontaminate.contamination(docs(spark, []), bench)


def test_work_folder_is_never_local_on_a_cluster():
    from types import SimpleNamespace

    from loomdex.llm.common import work_dir

    conf = lambda v: SimpleNamespace(get=lambda k, d: v)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        work_dir(SimpleNamespace(conf=conf(None), sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]")))
    assert work_dir(SimpleNamespace(conf=conf("s3a://b/c/"), sparkContext=SimpleNamespace(master="yarn"))) == "s3a://b/c/loomdex"


def test_fm_index():
    r = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        seq = np.r_[r.integers(2, 6, n), 1]
        index = decontaminate.FMIndex(seq, 6)
        for m in (1, 2, 3):
            rows = r.integers(2, 7, (20, m))
            lo, hi = index.search(rows)
            for w, i, j in zip(rows, lo, hi, strict=True):
                want = [k for k in range(len(seq) - m + 1) if (seq[k : k + m] == w).all()]
                assert sorted(index.locate(np.arange(i, j)).tolist()) == want


# language


def test_language(spark):
    r = random.Random(8)
    sound = {"aa": ["ba", "lo", "mi", "ne"], "bb": ["kra", "zur", "tsch", "ö"], "cc": ["xi", "que", "ñor", "ll"]}
    word = lambda g: "".join(r.choice(sound[g]) for _ in range(r.randrange(1, 4)))
    rows = [(k, " ".join(word(g) for _ in range(r.choice([4, 60, 900]))), g, "a") for k in range(240) for g in [sorted(sound)[k % 3]]]
    got = {x.doc_id: x for x in language_id.language(docs(spark, rows)).collect()}
    held = [(got[k].lang_pred == g) for k, _, g, _ in rows if got[k].held_out]
    assert len(held) > 20 and sum(held) / len(held) > 0.97 and all(0 <= x.score <= 1 for x in got.values())
    odd = {x.doc_id: (x.lang_pred, x.score) for x in language_id.language(docs(spark, [*ODD[:4], (950, "123 !?", "aa", "a"), (951, "漢字", "aa", "a")]), language_id.CrossParser({"aa": ["balo mine"], "bb": ["kratschö"]})).collect()}
    assert odd[900] == odd[901] == odd[902] == odd[950] == ("und", 0.0) and odd[951][0] == "aa"
    assert {x.lang_pred for x in language_id.language(docs(spark, [(1, "text", None, "a")])).collect()} == {"und"}
    assert language_id.language(docs(spark, [])).count() == 0


def test_language_of_long_texts_only(spark):
    r = random.Random(4)
    text = lambda sound, n: " ".join(r.choice(sound) + r.choice(sound) for _ in range(n))
    aa, bb = ["ba", "lo", "mi", "ne"], ["kra", "zur", "tsch", "ö"]
    rows = [(k, text(aa, 60), "aa", "a") for k in range(12)] + [(20 + k, "1 " * 15_000 + text(bb, 6000), "bb", "a") for k in range(12)]
    got = {x.doc_id: x for x in language_id.language(docs(spark, rows)).collect()}
    assert all(got[k].lang_pred == g for k, _, g, _ in rows) and any(got[k].held_out for k in range(20, 32))


def test_language_of_many_letters(spark):
    # two languages of one script with thousands of letters, beside two in others
    r = random.Random(14)
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    sound = {"h1": signs[:2000], "h2": signs[1000:], "la": list("abcdefgh"), "cy": [chr(c) for c in range(0x430, 0x450)]}
    texts = {g: ["".join(r.choice(x) for _ in range(r.randrange(1, 4))) for _ in range(400)] for g, x in sound.items()}
    rows = [(k, " ".join(r.choice(texts[g]) for _ in range(r.choice([30, 90]))), g, "a") for k in range(200) for g in [sorted(sound)[k % 4]]]
    got = {x.doc_id: x for x in language_id.language(docs(spark, rows)).collect()}
    held = [got[k].lang_pred == g for k, _, g, _ in rows if got[k].held_out]
    assert len(held) > 30 and sum(held) == len(held)
    p = language_id.CrossParser({"x": ["a"]})
    assert language_id.fold_text("a\u6f22 \U000E0100a", p.symbol_table()).tolist() == [65, 1 + 6, 1 + 0x6F22 // 64 % 64, 1 + 0x6F22 % 64, 0, 65]


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGS", 3)
    with pytest.raises(ValueError, match="languages"):
        language_id.learn(docs(spark, [(k, "some text", f"g{k}", "a") for k in range(30)]))


def test_automaton_phrases_equal_plain_parsing():
    r = random.Random(2)
    sample = "".join(r.choice("abc ") for _ in range(300))
    p = language_id.CrossParser({"x": [sample], "y": ["abab"]})
    symbol = p.symbol_table()
    train = {g: "".join(chr(97 + s) for s in [*language_id.fold_text(t, symbol), 0]) for g, t in (("x", sample), ("y", "abab"))}
    for size in [200] * 30 + [256, 257, 1000, 1537]:
        text = "".join(r.choice("abcd ") for _ in range(size))
        s = language_id.fold_text(text, symbol)
        coded = "".join(chr(97 + c) for c in s)
        for k, g in enumerate("xy"):
            n = 0
            for at in range(0, len(coded), language_id.SEGMENT):  # a segment's first phrase is counted from its start
                n, cur = n + 1, ""
                for c in coded[at : at + language_id.SEGMENT]:
                    if cur + c in train[g]:
                        cur += c
                    else:
                        n, cur = n + 1, c if c in train[g] else ""
            assert p.phrases([s])[0, k] == n, (g, text)


# line dedup


def dedup_rows(seed):
    r = random.Random(seed)
    long, parts = prose(r, 60), [prose(r, 20) for _ in range(4)]
    rows = []
    for k in range(40):
        lines = [prose(r, r.choice([1, 5, 30, 70])) for _ in range(r.randrange(1, 6))]
        if k % 3 == 0:
            lines.insert(r.randrange(len(lines) + 1), long)
        if k % 4 == 0:
            i = r.randrange(len(lines) + 1)
            lines[i:i] = parts
        lines.insert(0, "common line")
        if k % 5 == 0:
            lines += ["", long, "tail"]
        rows.append((k, "\n".join(lines), "en", "a"))
    return [*rows, (40, rows[0][1], "en", "a"), (900, None, "en", "a"), (901, "", "en", "a"), (902, "\n \n", "en", "a")]


def test_line_dedup_against_sql(spark):
    import pandas as pd

    rows = dedup_rows(1)
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source"]))
    want = {k: (t, n, m) for k, t, n, m in c.execute(queries.SQL["op5_line_dedup"]).fetchall()}
    got = {x.doc_id: (x.text, x.n_lines, x.n_removed) for x in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == want
    assert got[40][2] >= 5 and got[900] == (None, 0, 0) and got[901] == ("", 1, 0) and got[902] == ("\n \n", 3, 0)
    left = collections.Counter(line for t, *_ in got.values() for line in (t or "").split("\n") if len(line.split()) >= 50)
    assert max(left.values()) == 1


def brute_repeats(rows):
    """Lines to delete of each document: those of runs of 50 words that also stand earlier, and blank ones between them."""
    lines = {k: [(i, x, len(re.findall(r"[^\x20\x09-\x0D]+", x))) for i, x in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)] for k, t, *_ in sorted(x for x in rows if x[1] is not None)}
    out, before = {}, []
    for k, mine in lines.items():
        gone = set()
        for i in range(len(mine)):
            for other, stop in [*((x, len(x)) for x in before), (mine, i)]:
                for j in range(stop):
                    n = 0
                    while i + n < len(mine) and j + n < len(other) and mine[i + n][1] == other[j + n][1]:
                        n += 1
                    if sum(x[2] for x in mine[i : i + n]) >= 50:
                        gone |= set(range(i, i + n))
        before.append(mine)
        out[k] = {x for i in gone for x in range(mine[i][0], mine[i + 1][0] if i + 1 in gone else mine[i][0] + 1)}
    return out


@pytest.mark.parametrize("seed", [2, 3, 4])
def test_line_dedup_against_brute_force(spark, seed):
    r = random.Random(seed)
    pool = [prose(r, r.choice([1, 3, 9, 26, 49, 60])) for _ in range(9)]
    rows = [(k, "\n".join(r.choice([*pool, *pool, "", " ", prose(r, 8)]) for _ in range(r.randrange(1, 14))), "en", "a") for k in range(45)]
    gone = brute_repeats(rows)
    want = {k: ("\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]), len(gone[k])) for k, t, *_ in rows}
    assert {x.doc_id: (x.text, x.n_removed) for x in line_dedup.dedup_lines(docs(spark, rows)).collect()} == want
    assert sum(n for _, n in want.values()) > 40


def test_line_dedup_of_one_document_of_equal_lines(spark):
    out = line_dedup.dedup_lines(docs(spark, [(1, "\n".join([prose(random.Random(1), 60)] * 20_000), "en", "a"), (2, "\n".join(["tick"] * 20_000), "en", "a")])).collect()
    assert {x.doc_id: (x.n_lines, x.n_removed) for x in out} == {1: (20_000, 19_999), 2: (20_000, 19_999)}


def test_line_dedup_edges(spark):
    twice = [(1, prose(random.Random(1), 60), "en", "a")] * 2 + [(None, prose(random.Random(1), 60), "en", "a"), (2, prose(random.Random(1), 60), "en", "a")]
    out = line_dedup.dedup_lines(docs(spark, twice))
    assert sorted((x.doc_id or 0, x.n_removed) for x in out.collect()) == [(0, 0), (1, 0), (1, 0), (2, 1)]
    assert out.columns[: len(docs(spark, []).columns)] == docs(spark, []).columns and line_dedup.dedup_lines(docs(spark, [])).count() == 0
    assert sorted(x.doc_id or 0 for x in line_dedup.without_repeats(docs(spark, twice)).collect()) == [0, 1, 1]
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    clash = docs(spark, twice).withColumn("n_lines", F.lit(-1)).withColumn("line", F.lit("x")).withColumn("n_chars", F.lit(3))
    kept = line_dedup.without_repeats(clash)
    assert kept.columns == clash.columns and {x.n_lines for x in kept.collect()} == {-1}


# archives


PAGES = "page_id long, url string, html string, sha1 string, chunk long"


@pytest.mark.parametrize("chunk", [1 << 16, 700])
def test_archives_round_trip(spark, monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    rows = [(5, "http://a/5", "same"), (2, "http://a/2", "same"), (9, "http://a/9", "é" * 5000), (7, None, None), (8, "http://x y\n", ""), (3, "u", "x\r\n\r\nWARC/1.1\r\n" * 90), (11, "u", "z" * 300_000), (None, "u", "same")]
    pages = spark.createDataFrame([(*x, "clash", 1) for x in rows], PAGES).repartition(2)
    archive = warc.write_archive(pages)
    got = {x.page_id: x for x in warc.read_archive(archive.repartition(5, "chunk")).collect()}
    first = {}
    for k, _, h in sorted((x for x in rows if x[0] is not None)):
        first.setdefault(h or "", k)
    for k, _, h in rows:
        data = (h or "").encode()
        refers = first[h or ""] if k != first[h or ""] else None
        assert (got[k].payload_bytes, got[k].payload_digest, got[k].record_type, got[k].refers_to) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if refers is not None and k is not None else got[k].record_type, refers if k is not None else got[k].refers_to)
    assert max(len(x.data) for x in archive.select("data").collect()) <= chunk + 1200
    assert warc.read_archive(warc.write_archive(spark.createDataFrame([], PAGES))).count() == 0


def test_archive_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 900)
    rows = [(k, f"http://h/{k}", f"page {k % 7} " * 500, "", 1) for k in range(20)]
    out = warc.export_files(warc.write_archive(spark.createDataFrame(rows, PAGES)), f"file://{tmp_path}/out", 3).collect()
    data = b"".join((tmp_path / "out" / os.path.basename(x.file)).read_bytes() for x in out)
    assert sum(x.records for x in out) == 20 and sum(x.bytes for x in out) == len(data) and len(os.listdir(tmp_path / "out")) == len(out)
    seen = {}
    while data:  # a plain reader
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        n = int(fields[b"Content-Length"])
        seen[int(fields[b"WARC-Record-ID"].rpartition(b":")[2][:-1])] = (fields[b"WARC-Type"], rest[:n].partition(b"\r\n\r\n")[2])
        assert rest[n : n + 4] == b"\r\n\r\n"
        data = rest[n + 4 :]
    assert {k: v for k, v in seen.items() if k < 7} == {k: (b"response", rows[k][2].encode()) for k in range(7)} and all(seen[k] == (b"revisit", b"") for k in range(7, 20))


def test_archives_of_one_page_id_with_many_payloads(spark, monkeypatch):
    # equal names in several tasks must not mix when a split tears their records
    monkeypatch.setattr(warc, "CHUNK", 600)
    for key, value in (("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.shuffle.partitions", "8")):
        before = spark.conf.get(key)
        spark.conf.set(key, value)
        monkeypatch.setattr(warc, "MOST_COPIED", -1)
        try:
            rows = [(5, f"http://a/{k}", f"{k}" * 4000, "", 1) for k in range(8)] + [(5, "http://a/0", "0" * 4000, "", 1), (6, "http://a/6", "0" * 4000, "", 1)]
            archive = warc.write_archive(spark.createDataFrame(rows, PAGES).repartition(8, "html"))
            got = sorted((x.url, x.payload_digest, x.record_type) for x in warc.read_archive(archive.repartition(7)).collect())
        finally:
            spark.conf.set(key, before)
        assert got == sorted((u, base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(), "response" if k == 5 else "revisit") for k, u, h, *_ in rows)


def test_archives_with_lost_chunks(spark, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", 600)
    archive = warc.write_archive(spark.createDataFrame([(1, "u", "payload " * 900, "", 1)], PAGES))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(archive.where("chunk <> 2")).collect()


def test_archives_detect_damage(spark):
    archive = warc.write_archive(spark.createDataFrame([(1, "u", "payload " * 20, "", 1)], PAGES))
    bad = archive.withColumn("data", F.encode(F.replace(F.decode("data", "utf-8"), F.lit("payload"), F.lit("PAYLOAD")), "utf-8"))
    with pytest.raises(Exception, match="damaged"):
        warc.read_archive(bad)


# mixing


def mix_rows(seed, n=300):
    r = random.Random(seed)
    sources = ["b", "a", "é", None, "c", "tiny"]
    rows = [(k, prose(r, r.choice([0, 1, 30, 200])), "en", r.choices(sources, [60, 20, 10, 5, 4, 1])[0]) for k in range(n)]
    return [*rows, (900, None, "en", "a"), (901, "", "en", "void")]


def water_fill(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    total, target, fixed = 1.5 * sum(sizes.values()), {}, set()
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(2 * sizes[s] for s in fixed)
        share = {s: left * weight[s] / max(1, sum(weight[x] for x in free)) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {**{s: 2.0 * sizes[s] for s in fixed}, **share}
        fixed |= over


def test_mixing(spark):
    import pandas as pd

    rows = mix_rows(3)
    out = mixing.mix(docs(spark, rows))
    got = {x.doc_id: x for x in out.collect()}
    source = {k: s for k, _, _, s in rows}
    sizes = collections.Counter()
    for k, x in got.items():
        sizes[source[k]] += x.size
    want = water_fill({s: sizes[s] for s in set(source.values())})
    for s, t in want.items():
        mine = [x for k, x in got.items() if source[k] == s]
        assert all(abs(x.target - t) < 1e-6 and x.source_size == sizes[s] and 0 <= x.taken <= 2 * x.size for x in mine)
        assert abs(sum(x.taken for x in mine) - t) <= 1
    again = {x.doc_id: x.taken for x in mixing.mix(docs(spark, rows[::-1]).repartition(7)).collect()}
    assert again == {k: x.taken for k, x in got.items()}
    c = duckdb.connect()
    c.register("d", pd.DataFrame([(k, t, s) for k, t, _, s in rows], columns=["doc_id", "text", "source"]))
    assert {x[0]: x[4:] for x in c.execute(mixing.mixing_sql("d")).fetchall()} == {x.doc_id: (x.taken, x.draws) for x in out.withColumn("draws", mixing.draws_text(F.col("draws"))).collect()}
    shards = mixing.shards(out)
    assert shards.agg(F.sum("words")).first()[0] == sum(again.values()) and shards.select("shard").distinct().count() == mixing.SHARDS
    counts = [r["count"] for r in shards.select("shard", "doc_id", "copy").groupBy("shard").count().collect()]
    assert min(counts) > 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_splitting_tree(spark):
    units = spark.createDataFrame([(f"s{k % 9}", k // 9 + 1) for k in range(901)], "skey string, k long")
    got = mixing.shard_counts(units).collect()
    total = collections.Counter(x.shard for x in got)
    assert sorted(total) == list(range(mixing.SHARDS)) and max(total.values()) - min(total.values()) <= 1 and sum(total.values()) == 901
    per = collections.defaultdict(list)
    for x in sorted(got, key=lambda x: (x.skey, x.ticket)):
        per[x.skey].append((x.ticket, x.shard))
    for v in per.values():  # every ticket once, shard by shard
        assert [t for t, _ in v] == list(range(1, len(v) + 1)) and [s for _, s in v] == sorted(s for _, s in v)
    # hypergeometric counts: mean 901 / 9 / 8, variance about 11
    counts = np.array([collections.Counter(s for _, s in v)[k] for v in per.values() for k in range(mixing.SHARDS)])
    assert 4 < counts.var() < 22 and abs(counts.mean() - 901 / 72) < 1e-9


def test_mixing_edges(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert [(x.target, x.taken) for x in mixing.mix(docs(spark, [(1, "", "en", None), (2, None, "en", "a")])).collect()] == [(0.0, 0), (0.0, 0)]
    one = mixing.mix(docs(spark, [(1, "a b c d", "en", "s"), (1, "a b c d", "en", "s"), (None, "a b", "en", "s")])).collect()
    assert len(one) == 3 and sum(x.taken for x in one) == 15


# quality


def brute_quality(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines, seen, dups = t.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    at = collections.defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    rep = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dups, len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


def test_quality(spark):
    r = random.Random(9)
    rows = [(k, "\n".join(prose(r, 12) for _ in range(12)), "en", "a") for k in range(60)]
    rows += [(100, "\n".join(" ".join(f"{r.choice(WORDS)}###" for _ in range(10)) for _ in range(9)), "en", "a"), (101, " | ".join(f"zz{k}" for k in range(150)), "en", "a")]
    rows += [(110, "a b c d e f " * 8, "en", "a"), (111, "x\nx\nx y", "en", "a"), (112, " a  b " * 9, "en", "a"), *ODD]
    got = sorted(((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in quality_rules.quality(docs(spark, rows)).collect()), key=str)
    assert got == sorted(((k, *brute_quality(t)) for k, t, *_ in rows), key=str)
    kept = {x.doc_id: x.kept for x in quality_rules.quality(docs(spark, rows)).collect()}
    assert all(kept[k] for k in range(60)) and not any(kept[k] for k in (100, 101, 110, 900, 901))
    assert {x.doc_id for x in quality_rules.keep_good(docs(spark, rows)).collect()} == {k for k, v in kept.items() if v}
    assert quality_rules.quality(docs(spark, [])).count() == 0
    alone = quality_rules.quality(docs(spark, [(1, prose(r, 80), None, "a")])).first()
    assert alone.kept and alone.word_distance is None  # no reference: only the base rule decides


def brute_verdict(rows, t):
    """char_distance, word_distance and kept by the definition, from all rows (doc_id, text, lang, source)."""
    strip = lambda w: w.lower().strip("".join(quality_rules._SENTENCE))
    split = lambda x: re.findall(r"[^\x20\x09-\x0D]+", x or "")

    def js(p, q):
        p, q = {k: v / sum(p.values()) for k, v in p.items()}, {k: v / sum(q.values()) for k, v in q.items()}
        kl = lambda a: sum(v * np.log2(2 * v / (p.get(k, 0) + q.get(k, 0))) for k, v in a.items() if v)
        return ((kl(p) + kl(q)) / 2) ** 0.5

    refs = {}
    for _, x, g, _ in rows:
        if g is not None and x:
            c, w = refs.setdefault(g, (collections.Counter(), collections.Counter()))
            c.update(quality_rules._class(ord(ch)) for ch in x)
            w.update(map(strip, split(x)))
    tops = {g: sorted(((w, n) for w, n in ws.items() if w), key=lambda x: (-x[1], x[0]))[: quality_rules.COMMON_MOST] for g, (_, ws) in refs.items()}
    vocab = {w for g, top in tops.items() for w, n in top if n >= quality_rules.COMMON_SHARE * refs[g][1].total()}
    fold = lambda ws, mine: collections.Counter({w: n for w, n in ws.items() if w in mine}) + collections.Counter({None: sum(n for w, n in ws.items() if w not in mine)})
    dc = dw = None
    if len(t or "") >= quality_rules.MIN_CHARS:
        dc = min(js(collections.Counter(quality_rules._class(ord(ch)) for ch in t), c) for c, _ in refs.values())
    if len(split(t)) >= quality_rules.MIN_WORDS:
        dw = min(js(fold(collections.Counter(map(strip, split(t))), vocab), fold(ws, {w for w, n in tops[g] if n >= quality_rules.COMMON_SHARE * ws.total()})) for g, (_, ws) in refs.items())
    return dc, dw, not (brute_quality(t)[5] or (dc or 0) > quality_rules.MAX_CHAR or (dw or 0) > quality_rules.MAX_WORD)


def test_verdict_against_brute_force(spark):
    r = random.Random(19)
    rows = [(k, "\n".join(prose(r, 12) for _ in range(r.choice([1, 6, 12]))), r.choice(["en", "de"]), "a") for k in range(30)]
    rows += [(40, " ".join(f"{r.choice(WORDS)}###" for _ in range(70)), "de", "a"), (41, "\x00foo \x00total \x000 " + prose(r, 80), "en", "a"), (42, "漢字かな " * 30 + prose(r, 70), None, "a"), (43, prose(r, 40) + " x" * 60_000, None, "a"), *ODD]
    got = sorted(((x.doc_id, x.char_distance, x.word_distance, x.kept) for x in quality_rules.quality(docs(spark, rows)).collect()), key=str)
    want = sorted(((k, *brute_verdict(rows, t)) for k, t, *_ in rows), key=str)
    near = lambda x, y: x is None and y is None or x == pytest.approx(y, abs=1e-9)
    assert len(got) == len(want)
    by = lambda rs: sorted(rs, key=lambda x: (str(x[0]), x[3]))
    assert all(a[0] == b[0] and near(a[1], b[1]) and near(a[2], b[2]) and a[3] == b[3] for a, b in zip(by(got), by(want), strict=True))


def test_references_are_the_corpus_counts(spark):
    rows = [(1, "The cat. The dog!", "en", "a"), (2, "the end", "en", "a"), (3, "der Hund", "de", "a"), (4, None, "de", "a")]
    langs, chars, vocab, commons = quality_rules.references(docs(spark, rows))
    assert langs == ["de", "en"] and vocab == ["cat", "der", "dog", "end", "hund", "the"]
    assert commons[1].tolist() == pytest.approx([1 / 6, 0, 1 / 6, 1 / 6, 0, 3 / 6, 0])
    assert chars[0].tolist() == pytest.approx([6 / 8, 1 / 8, 0, 0, 1 / 8, 0, 0, 0])
    p, q = np.array([1.0, 1, 0]), np.array([[0.5, 0.5, 0], [0, 0, 1.0]])
    assert quality_rules.distance(p, q).tolist() == pytest.approx([0, 1])


# pages


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("<html><head><title>x</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>T &amp; x</h1><p>One\n two&nbsp;<b>three</b>.<br><p>Four</p><div class='ad-box'>Buy!</div><p>Five</p></article><footer>&copy; x</footer></body></html>", "T & x\nOne two three.\nFour\nFive"),
        ("<body><div id=menu><a>a</a> menu words here that are long enough to look like a text of some kind</div><div id=content><p>" + "Real text. " * 20 + "</p><p>Short.</p></div><div class=comments><p>" + "A comment by a reader. " * 20 + "</p></div><form>Search <input></form></body>", "Real text. " * 19 + "Real text.\nShort."),
        ("<main><p>a<!-- no --><aside>side</aside><p>b &lt;c&gt; &#233;&#x41;</main>", "a\nb <c> éA"),
        ("<article><p>cut in the midd", "cut in the midd"),
        ("plain words only", "plain words only"),
        ("<p>Short article text here.</p>", "Short article text here."),
        ("<article><p>One.</p><div class='share-price-table'>Two</div><p class=notice-of-motion>Three</p><p class='share-box'>no</p></article>", "One.\nTwo\nThree"),
        ("<article><p title='x>Hello</p></article>", "Hello"),
        ("<main><h1>Site</h1></main><div><h2>Title</h2><p>" + "Real text. " * 20 + "</p></div>", "Site\nTitle\n" + "Real text. " * 19 + "Real text."),
        ("<article><b>bold<div>in</b>ner</div></article>", "bold\ninner"),
        ("<div class=header>Top</div><article><header><h1>Title</h1></header><p hidden>no</p><p>yes</p><div role=complementary>no</div><section class='comments-area'><p>no</p></section></article>", "Title\nyes"),
    ],
)
def test_main_text(page, want):
    assert html_extract.main_text(page) == want


@pytest.mark.parametrize(
    "page,want",
    [
        # menus and footers without a telling tag, role, class or id: lines of links alone are a dive, on many lines or on one
        ("<div><ul>" + "<li><a href=x>Item</a></li>" * 6 + "</ul></div><div><p>" + "Real text. " * 20 + "</p><p>Short.</p></div><div>" + "<p><a href=y>Deep</a> |</p>" * 4 + "<p>All rights kept</p></div>", "Real text. " * 19 + "Real text.\nShort."),
        ("<div><a>Home</a> | <a>News</a> | <a>About</a></div><p>" + "Real text. " * 20, "Real text. " * 19 + "Real text."),
        ("<div role=navigation>x</div><h1><a href=x>Title</a></h1><p>" + "Real text. " * 20, "Title\n" + "Real text. " * 19 + "Real text."),
        # inside an article too, unless there is nothing else
        ("<article><p>One.</p><ul>" + "<li><a href=x>Other</a></li>" * 3 + "</ul><p>Two, <a href=y>see</a>.</p><p><a href=z>Source</a></p></article>", "One.\nTwo, see.\nSource"),
        ("<article><ul>" + "<li><a href=x>Other</a></li>" * 3 + "</ul></article>", "Other\nOther\nOther"),
        # no sum reaches SURGE: the densest stretch
        ("<div>" + "<p><a>m</a></p>" * 4 + "<p>A short notice.</p><p>Two lines.</p>" + "<p><a>m</a></p>" * 4 + "<p>End</p></div>", "A short notice.\nTwo lines."),
        ("<div>" + "<p><a>m</a></p>" * 4 + "</div>", ""),
    ],
)
def test_main_text_by_sums(page, want):
    assert html_extract.main_text(page) == want


def brute_main_text(rows):
    """By the definition, line by line; rows as of lines()."""
    held = any(t and art and not head for t, _, art, _, head in rows)
    rows = [r if r[2] or not held else ("", 0, False, 0, False) for r in rows]
    # a line of links alone stands for one line a link
    wide = [(i, r[1], bool(r[0])) for i, r in enumerate(rows) for _ in range(1 if r[1] else max(1, r[3]))]
    dive = set()
    for k in range(len(wide) - html_extract.WINDOW + 1):
        w = wide[k : k + html_extract.WINDOW]
        if not sum(n for _, n, _ in w) and len({x for _, _, x in w}) == 1:
            dive |= {i for i, _, _ in w}
    parts, now = [], []
    for i, r in enumerate([*rows, None]):
        if r is None or i in dive:
            parts, now = parts + [now] * any(x[0] for x in now), []
        else:
            now.append(r)
    score = [max(sum(r[1] for r in p[k : k + html_extract.WINDOW]) for k in range(len(p))) for p in parts]
    if held:
        keep = parts or [rows]
    else:
        keep = [p for p, n in zip(parts, score, strict=True) if n >= html_extract.SURGE] or [p for p, n in zip(parts, score, strict=True) if n and n == max(score)][:1]
    return "\n".join(r[0] for p in keep for r in p if r[0])


def test_main_text_against_brute_force():
    r = random.Random(31)
    pieces = ["<p>", "</p>", "<div>", "</div>", "<article>", "</article>", "<main>", "</main>", "<a href=x>", "</a>", "<li>", "<h1>", "</h1>", "<nav>", "</nav>", "<br>", "<b>", "</b>", "<span", "</span>", "word ", "Home", "|", "A longer sentence with more text in it. ", "&amp;", "<p class=ad>", "<a>m</a>", "<p><a>m</a></p>" * 3]
    for _ in range(4000):
        page = "".join(r.choice(pieces) for _ in range(r.randrange(1, 40)))
        assert html_extract.main_text(page) == brute_main_text(html_extract.lines(page)), page


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver tables are absent")
def test_main_text_of_pages(spark):
    for x in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect():
        got = html_extract.main_text(x.html)
        assert got == brute_main_text(html_extract.lines(x.html)) and got.count("\n") >= 1 and "©" not in got


def test_main_text_in_linear_time():
    import time

    for one in ("<span></b>", "<span>x</b></p>", "<div><p>a", "<p title='", "<a><li>", "</div>"):
        took = []
        for n in (4000, 32_000):
            began = time.process_time()
            html_extract.main_text("<b><div>" + one * n)
            took.append(time.process_time() - began)
        assert took[1] < 30 * took[0] + 0.5, (one, took)
    assert html_extract.main_text("<article><p>" + "word " * 400_000).count("word") == 400_000


def test_extract(spark):
    rows = [(1, "u", "<article><p>a</article>", "x"), (1, "u", "<article><p>a</article>", "x"), (None, None, None, "x")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((x.page_id or 0, x.text, x.n_chars) for x in got) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]


# toxicity


def test_toxicity(spark):
    r = random.Random(11)
    bad, groups = ["scum", "vermin", "trash"], ["northerners", "southerners"]
    rows, labels = [], []
    for k in range(900):
        w = prose(r, r.choice([20, 80])).split()
        toxic = k % 3 == 0
        # an insult and a group together are toxic; each alone is not
        if toxic:
            w[3], w[9] = r.choice(bad), r.choice(groups)
        elif k % 3 == 1:
            w[5] = r.choice(bad if k % 2 else groups)
        rows.append((k, " ".join(w), "en", "a"))
        labels.append((k, int(toxic), 7))
    lab = spark.createDataFrame([*labels, (5000, None, 1), (None, 1, 1)], "doc_id long, toxic int, score int")
    got = {x.doc_id: x for x in toxicity.toxicity(docs(spark, [*rows, *ODD[:4]]), lab).collect()}
    held = [(got[k].predicted == t) for k, t, _ in labels if got[k].held_out]
    assert len(held) > 100 and sum(held) / len(held) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got.values()) and got[900].score == got[901].score
    none = toxicity.toxicity(docs(spark, ODD), lab.limit(0))
    assert max(x.score for x in none.collect()) < 1e-9 and none.count() == len(ODD)
    assert toxicity.toxicity(docs(spark, []), lab).count() == 0


def test_toxicity_of_terms_that_tell_in_pairs_or_are_rare():
    r = random.Random(3)
    rows, labels = [], []
    for k in range(1800):
        # northerners: a third of their rows is toxic, as of all rows; they tell only beside scum
        own = [["scum", "northerners"], ["scum"], [], ["vermin"], ["northerners"], ["northerners"]][k % 6]
        rows.append(" ".join([prose(r, r.choice([20, 60])), *own, *["wretch"] * (k % 6 == 3 and k < 30)]))
        labels.append(int(k % 6 in (0, 3)))
    m = toxicity.train([toxicity.terms(t) for t in rows[:1500]], labels[:1500])
    assert sum((m.score(toxicity.terms(t)) >= 0.5) == y for t, y in zip(rows[1500:], labels[1500:], strict=True)) > 285
    assert m.score(toxicity.terms("wretch")) > m.score(toxicity.terms("unseen"))  # five toxic rows


@pytest.mark.parametrize("filler", [8, 30])
def test_toxicity_of_exactly_one_of_two_words(filler):
    # neither word tells alone, and no third one helps
    r = random.Random(5)
    rows, labels = [], []
    for _ in range(4000):
        a, b = r.random() < 0.5, r.random() < 0.5
        rows.append(" ".join([*["alpha"] * a, *["bravo"] * b, *(r.choice(WORDS) for _ in range(filler))]))
        labels.append(int(a != b))
    m = toxicity.train([toxicity.terms(t) for t in rows[:3200]], labels[:3200])
    assert sum((m.score(toxicity.terms(t)) >= 0.5) == y for t, y in zip(rows[3200:], labels[3200:], strict=True)) > 0.9 * 800


def test_toxicity_sample_is_bounded_by_terms(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MOST_TERMS", 400)
    rows = [(k, f"{'bad' if k % 2 else 'good'} " + " ".join(f"x{k}y{j}" for j in range(20)), "en", "a") for k in range(200)] + [(300, "bad " + "word " * 200_000, "en", "a")]
    lab = spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    got = {x.doc_id: x.predicted for x in toxicity.toxicity(docs(spark, rows), lab).collect()}
    assert all(got[k] == k % 2 for k in range(200)) and got[300] == 1


# queries


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        p = f"{SF}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    want, got = c.execute(queries.SQL[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    norm = lambda df: sorted(tuple("~" if v is None else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).itertuples(index=False))
    assert norm(got) == norm(want)
