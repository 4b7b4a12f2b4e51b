"""Quality rules: plain counts, then the distance of a text's character classes and common words from its language's.

For each language, two reference histograms come from all documents of that language: character classes, and words that
make up COMMON_SHARE of its words at least (COMMON_MOST of them at most, plus one bin for all others). A document is
compared with every language by Jensen-Shannon distance (base 2, so 0 to 1); the nearest counts, so a missing or wrong
lang does no harm. It is rejected when the character distance exceeds MAX_CHAR or the word distance MAX_WORD. Guards: a
text below MIN_CHARS characters isn't judged by its characters, one below MIN_WORDS words isn't judged by its words.

Null and empty texts have zero counts and fail the base rule; a word may hold any character, U+0000 included. Texts are
judged whole, about PART characters at once, so that a very long one is alone. Equal counts rank by word. Rows without lang add to
no reference; more than MOST_LANGS languages are an error, as references go to every task. With no reference at all only
the base rule decides. Repeated rows and null doc_ids keep a row each. Other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise
from .ngram_join import _MULT

CLASSES = 8
MAX_CHAR, MAX_WORD, MIN_CHARS, MIN_WORDS = 0.30, 0.44, 200, 60
COMMON_SHARE, COMMON_MOST = 0.002, 100
#: Distinct words that a task holds at once; characters judged at once; languages.
FLUSH, PART, MOST_LANGS = 300_000, 4_000_000, 1000
_SENTENCE = set(".,;:!?'\"()-–—…«»¿¡“”„‘’")
_STRIP = "".join(sorted(_SENTENCE))
_SYMBOLS = b"#*$%&|<>"


def _class(c: int) -> int:
    ch = chr(c)
    if ch in _SENTENCE:
        return 5
    if ch in "\t\n\r\x0b\x0c ":
        return 4
    return {"Ll": 0, "Lu": 1, "Lt": 1}.get(cat := unicodedata.category(ch), {"L": 2, "M": 2, "N": 3, "Z": 4, "P": 6, "S": 6}.get(cat[0], 7))


_table: list = []


def char_classes(text: str) -> np.ndarray:
    """Counts of lower case, upper case, other letters, digits, space, sentence marks, symbols and the rest."""
    if not _table:
        _table.append(np.fromiter(map(_class, range(0x110000)), np.uint8, 0x110000))
    return np.bincount(_table[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=CLASSES)


class Lexicon(dict):
    """Numbers of raw words as they are met; each one's hash, characters, and plain form or its number in vocab (-1: none)."""

    def __init__(self, vocab: list[str] | None = None):
        self.vocab = None if vocab is None else {w: i for i, w in enumerate(vocab)}
        self.hash, self.chars, self.plain = [], [], []

    def __missing__(self, raw: bytes) -> int:
        k = self[raw] = len(self)
        word = raw.decode("utf-8", "surrogatepass")
        form = word.lower().strip(_STRIP)
        self.hash.append(xxhash.xxh3_64_intdigest(raw))
        self.chars.append(len(word))
        self.plain.append(form if self.vocab is None else self.vocab.get(form, -1))
        return k

    def numbers(self, raw: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, raw), np.int32, len(raw))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of histogram p from each row of q."""
    p = p / max(p.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1) + np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.maximum(d, 0) / 2)


_COUNTS = pa.schema([("lang", pa.string()), ("cls", pa.int32()), ("word", pa.string()), ("n", pa.int64())])
_COUNTS_DDL = "lang string, cls int, word string, n long"


def _corpus_counts(batches):
    """(lang, cls, word, n) per task: words with a null cls, character classes 0 to CLASSES - 1, and the total of words as class CLASSES."""
    words = Lexicon()
    held: dict = {}
    classes: dict = {}

    def out():
        rows = []
        for g, n in held.items():
            merged: Counter = Counter()
            for k in np.flatnonzero(n).tolist():
                merged[words.plain[k]] += int(n[k])
            rows += [(g, None, w, c) for w, c in merged.items()]
        rows += [(g, k, None, c) for g, n in classes.items() for k, c in enumerate(n.tolist())]
        for x in (held, classes, words, words.hash, words.chars, words.plain):
            x.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_COUNTS)], schema=_COUNTS)

    for b in batches:
        found: dict = {}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if lang is None or not (text := text.as_py()):
                continue
            numbers = words.numbers(text.encode("utf-8", "surrogatepass").split())
            found.setdefault(lang, []).append(numbers)
            classes[lang] = classes.get(lang, 0) + np.r_[char_classes(text), len(numbers)]
        for lang, parts in found.items():
            n = np.bincount(np.concatenate(parts), minlength=len(words))
            n[: len(held.get(lang, ()))] += held.get(lang, 0)
            held[lang] = n
        if len(words) > FLUSH or len(words) * len(held) > 10 * FLUSH:
            yield out()
    if classes:
        yield out()


def references(docs: DataFrame) -> tuple[list[str], np.ndarray, list[str], np.ndarray]:
    """Languages, their character histograms, common words, their word histograms (last column: other words)."""
    counts = docs.select("lang", "text").mapInArrow(_corpus_counts, _COUNTS_DDL).groupBy("lang", "cls", "word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "quality-counts")
    langs = sorted(r.lang for r in counts.where(F.col("cls") == CLASSES).select("lang").limit(MOST_LANGS + 1).collect())
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    # the window sees a language's words after the rank filter only: COMMON_MOST
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    common = counts.where("cls is null and word <> ''").withColumn("r", F.row_number().over(top)).where(F.col("r") <= COMMON_MOST).select("lang", "word", "n").collect()
    classes = counts.where("cls is not null").select("lang", "cls", "n").collect()
    discard(counts)
    total = {r.lang: r.n for r in classes if r.cls == CLASSES}
    common = [r for r in common if r.n >= total[r.lang] * COMMON_SHARE]
    vocab = sorted({r.word for r in common})
    chars, commons = np.zeros((len(langs), CLASSES)), np.zeros((len(langs), len(vocab) + 1))
    at, where = {g: i for i, g in enumerate(langs)}, {w: i for i, w in enumerate(vocab)}
    for r in classes:
        if r.cls < CLASSES:
            chars[at[r.lang], r.cls] = r.n
    for r in common:
        commons[at[r.lang], where[r.word]] = r.n
    commons[:, -1] = np.array([total[g] for g in langs]) - commons[:, :-1].sum(axis=1)
    return langs, chars / np.maximum(chars.sum(axis=1, keepdims=True), 1), vocab, commons / np.maximum(commons.sum(axis=1, keepdims=True), 1)


def repeat_words(a: np.ndarray) -> int:
    """Words, given as hashes, in five-word windows that the text holds twice or more."""
    n = len(a) - 4
    if n < 2:
        return 0
    h = np.zeros(n, np.uint64)
    for i in range(5):
        h = (h ^ (h >> np.uint64(29))) * _MULT[i] + a[i : n + i]
    s = np.sort(h)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0
    mark = np.zeros(len(a) + 1, np.int32)
    at = np.flatnonzero(np.isin(h, twice))
    mark[at] += 1
    mark[at + 5] -= 1
    return int(np.count_nonzero(np.cumsum(mark[:-1])))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("char_distance", pa.float64()), ("word_distance", pa.float64())])
_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_distance double, word_distance double"


def _dup_lines(data: bytes) -> int:
    if b"\n" not in data:
        return 0
    seen, dups = set(), 0
    for line in data.split(b"\n"):
        if line in seen:
            dups += 1
        elif line.strip(b" \t\r\x0b\x0c"):
            seen.add(line)
    return dups


def judge(texts: list[str | None], ref, words: Lexicon) -> list[tuple]:
    """All columns after doc_id for each text. words: a Lexicon of the reference's vocabulary."""
    _, chars, vocab, commons = ref
    if len(words) > FLUSH:
        for x in (words, words.hash, words.chars, words.plain):
            x.clear()
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    numbers = [words.numbers(d.split()) for d in data]
    hashes, size, plain = np.array(words.hash, np.uint64), np.array(words.chars, np.int64), np.array(words.plain, np.int64)
    out = []
    for text, d, k in zip(texts, data, numbers, strict=True):
        n, rep = len(k), repeat_words(hashes[k])
        failed = n < 10 or 100 * rep > 20 * n
        dc = dw = None
        if len(chars) and text and len(text) >= MIN_CHARS:
            dc = float(distance(char_classes(text).astype(float), chars).min())
        if len(commons) and n >= MIN_WORDS:
            # words outside the vocabulary, -1, count in the last bin
            dw = float(distance(np.roll(np.bincount(plain[k] + 1, minlength=len(vocab) + 1), -1).astype(float), commons).min())
        bad = failed or (dc or 0) > MAX_CHAR or (dw or 0) > MAX_WORD
        out.append((n, int(size[k].sum()), len(d) - len(d.translate(None, _SYMBOLS)), _dup_lines(d), rep, failed, not bad, dc, dw))
    return out


def _parts(b: pa.RecordBatch, text: int):
    """Slices of a batch with PART characters at least, but for the last, and their texts."""
    start, held, size = 0, [], 0
    for i, t in enumerate(b.column(text)):
        held.append(t.as_py())
        size += len(held[-1] or "")
        if size >= PART:
            yield b.slice(start, i + 1 - start), held
            start, held, size = i + 1, [], 0
    if held:
        yield b.slice(start), held


def quality(docs: DataFrame, ref=None) -> DataFrame:
    """The columns of _DDL for every row of docs(doc_id, text, lang); ref: references(), else learned from docs."""
    ref = references(docs) if ref is None else ref

    def run(batches):
        words = Lexicon(ref[2])
        for b in batches:
            for part, texts in _parts(b, 1):
                rows = judge(texts, ref, words)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(_OUT)[1:]))], schema=_OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _DDL)


def keep_good(docs: DataFrame, ref=None) -> DataFrame:
    """The rows of docs, all columns, that the rules keep, in one pass."""
    ref = references(docs) if ref is None else ref
    at = docs.columns.index("text")

    def run(batches):
        words = Lexicon(ref[2])
        for b in batches:
            for part, texts in _parts(b, at):
                yield part.filter(pa.array([r[6] for r in judge(texts, ref, words)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
