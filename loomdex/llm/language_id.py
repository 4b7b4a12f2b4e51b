"""Language ID by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text tells the longest match at any point. A text is cut
greedily into longest matches, language by language; the language that needs the fewest phrases per character wins, ties
going to the first name. Texts are folded first: lower case, and each run of characters that aren't letters becomes one
space. The DIRECT most frequent letters of the sample are a symbol each; any other letter is spelled by the three digits of
its code point in base 64, so that all letters stay apart in every script.

The sample: up to SAMPLE_DOCS texts a language, fewer where that makes more than MOST_DOCS in all, by hash order of
doc_id. Of each the first SAMPLE_TEXT characters from its first letter on count (or the language's share, if that is less),
until the language has its share of TOTAL_SYMBOLS, SAMPLE_SYMBOLS at most; the first text is always learned from, cut to that. More than MOST_LANGS labels are an
error, as each has a table that goes to every task.

The automata are dense tables, walked for many text segments of SEGMENT symbols at once; a segment starts a phrase, for
every language alike. Long texts are just more segments. score is the share of the winner under code lengths of one nat a phrase.

Null texts, and texts without a letter, get und and score 0, as do all texts when nothing is labelled. Rows with a null
lang or doc_id are not learned from. Repeated rows and null doc_ids keep a row each. Other columns are ignored.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialise
from .toxicity import fold

SAMPLE_DOCS, MOST_DOCS, SAMPLE_TEXT, SAMPLE_SYMBOLS, TOTAL_SYMBOLS, MOST_LANGS = 200, 20_000, 20_000, 40_000, 200_000, 1000
SEGMENT, BATCH_CHARS, DIRECT, BASE = 256, 1_000_000, 62, 64
#: Symbols: a space, the digits of spelled letters from 1 on, the direct letters after them.
SPACE, SPELLED, FIRST = 0, 255, 1 + BASE
_END = 1 << 30
_letters: list = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter or a mark on one; all are below BASE ** 3 but variation selectors, which aren't."""
    if not _letters:
        letters = np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)
        letters[BASE**3 :] = False
        _letters.append(letters)
    return _letters[0]


def fold_text(text: str, symbol: np.ndarray) -> np.ndarray:
    """Symbols of a text; empty if it has no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = symbol[code]
    if not s.any():
        return s[:0]
    keep = np.r_[True, (s[1:] != SPACE) | (s[:-1] != SPACE)]
    s = s[keep]
    spelled = s == SPELLED
    if not spelled.any():
        return s
    code, size = code[keep], np.where(spelled, 3, 1)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    out[at[~spelled]] = s[~spelled]
    for k, unit in enumerate((BASE * BASE, BASE, 1)):
        out[at[spelled] + k] = 1 + code[spelled] // unit % BASE
    return out


class SuffixAutomaton:
    """Its states recognise the substrings of a sequence of symbols."""

    def __init__(self, seq: list[int]):
        self.next: list[dict] = [{}]
        link, length, last = [-1], [0], 0
        for c in seq:
            cur = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = cur
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    new = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = new
                        p = link[p]
                    link[q] = link[cur] = new
            last = cur

    def dense(self, symbols: int) -> np.ndarray:
        """Flat table of next states times width; a step that ends a phrase has the bit _END. The last column is padding, which stays."""
        width = symbols + 1
        root = np.array([self.next[0].get(c, 0) * width for c in range(symbols)], np.int32)
        out = np.tile(np.r_[root | _END, 0].astype(np.int32), (len(self.next), 1))
        for s, step in enumerate(self.next):
            for c, t in step.items():
                out[s, c] = t * width
            out[s, symbols] = s * width
        return out.ravel()


class CrossParser:
    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        letters = letter_table()
        counts = np.zeros(0x110000, np.int64)
        for texts in samples.values():
            for t in texts:
                c = np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
                counts += np.bincount(c[letters[c]], minlength=0x110000)
        self.known = [int(c) for c in np.argsort(-counts, kind="stable")[:DIRECT] if counts[c]]
        self.symbols = FIRST + len(self.known)
        symbol, self.tables = self.symbol_table(), []
        most = min(SAMPLE_SYMBOLS, TOTAL_SYMBOLS // max(1, len(samples)))
        for g in self.langs:
            seq: list[int] = []
            for t in samples[g]:
                s = [*fold_text(t, symbol)[: None if seq else most - 1].tolist(), SPACE]
                if len(seq) + len(s) <= most:  # a text that no longer fits is passed over
                    seq += s
            self.tables.append(SuffixAutomaton(seq).dense(self.symbols))

    def symbol_table(self) -> np.ndarray:
        out = np.where(letter_table(), SPELLED, SPACE).astype(np.uint8)
        out[self.known] = np.arange(FIRST, self.symbols)
        return out

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each folded text in each language."""
        owner, lanes = [], []
        for i, s in enumerate(texts):
            n = -(-len(s) // SEGMENT)
            if n:
                x = np.full(n * SEGMENT, self.symbols, np.int32)
                x[: len(s)] = s
                lanes.append(x.reshape(n, SEGMENT))
                owner += [i] * n
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        if not lanes:
            return out
        steps = np.ascontiguousarray(np.concatenate(lanes).T)
        for g, table in enumerate(self.tables):
            state, ended = np.zeros(steps.shape[1], np.int32), np.ones(steps.shape[1], np.int32)
            for col in steps:
                state = table[state + col]
                ended += state >> 30
                state &= _END - 1
            out[:, g] = np.bincount(owner, ended, len(texts))
        return out

    def predict(self, texts: list[str | None], symbol: np.ndarray) -> list[tuple[str, float]]:
        folded = [fold_text(t or "", symbol) for t in texts]
        counts = self.phrases(folded)
        out = []
        for s, row in zip(folded, counts, strict=True):
            if not len(s) or not self.langs:
                out.append(("und", 0.0))
            else:
                k = int(row.argmin())
                out.append((self.langs[k], float(1 / np.exp(np.clip(row[k] - row, -60, 0)).sum())))
        return out


def learn(docs: DataFrame) -> CrossParser:
    """From labelled rows outside fold 2 of 4."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("doc_id is not null and lang is not null").where((fold(F.col("doc_id"), 4) != 2) & F.col("text").rlike(r"\p{L}"))
    langs = [r.lang for r in rows.select("lang").distinct().limit(MOST_LANGS + 1).collect()]
    if len(langs) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages")
    if not langs:
        return CrossParser({})
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("doc_id", "lang", F.row_number().over(order).alias("r")).where(F.col("r") <= max(1, min(SAMPLE_DOCS, MOST_DOCS // len(langs))))
    chosen = materialise(chosen, "language-sample")  # MOST_DOCS rows at most
    size = min(SAMPLE_TEXT, SAMPLE_SYMBOLS, TOTAL_SYMBOLS // len(langs))
    piece = F.substring(F.regexp_replace("text", r"\A\P{L}++", ""), 1, size).alias("text")
    samples: dict[str, list[str]] = {}
    for r in sorted(rows.join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "r", piece).collect()):
        held = samples.setdefault(r.lang, [])
        if r.text not in held:
            held.append(r.text)
    discard(chosen)
    return CrossParser(samples)


def language(docs: DataFrame, parser: CrossParser | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, lang)."""
    parser = parser or learn(docs)

    def run(batches):
        symbol = parser.symbol_table()
        for b in batches:
            texts, got, at = b.column(1), [], 0
            while at < len(texts):
                part, size = [], 0
                while at < len(texts) and (not part or size < BATCH_CHARS):
                    part.append(texts[at].as_py())
                    size += len(part[-1] or "")
                    at += 1
                got += parser.predict(part, symbol)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
