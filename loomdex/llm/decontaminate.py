"""Benchmark decontamination by an FM-index per training shard.

Words are maximal runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] after lower-casing A-Z. A window is ten consecutive words
of a benchmark item, or the whole item if it has fewer. Each task cuts its documents into shards and indexes each shard:
suffix array, BWT, a wavelet tree for ranks, and every SAMPLE-th suffix position. All windows are searched backwards at
once, their occurrences located by walking to sampled positions, and merged into removal spans per document.

A window can only occur inside a run of words that all appear in the benchmark, so a shard's index holds just the runs
that are long enough for some window, each closed by a separator; that loses no occurrence.

The phrases go to every task, so their number is checked: MAX_PHRASE_WORDS words at most, else ValueError (call it for
parts of the benchmark then). Null or empty texts have no words, no hits and the hash of an empty list. Repeated rows and
null doc_ids keep a row each. Null items, and items without words, have no window. Benchmark rows of one item_id are one
item, with the windows of all its rows; windows of a null item_id hit words but name no item. A text longer than a shard is a shard
of its own. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SAMPLE, SHARD_WORDS, MAX_PHRASE_WORDS = 10, 16, 2_000_000, 5_000_000
#: Upper to lower case; ASCII other than letters and digits to spaces.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: The same words, before lower-casing.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class WaveletTree:
    """Ranks over an integer sequence: one bit level for each bit of the alphabet, stably partitioned by that bit."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for level in range(bits - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            self.ones.append(np.r_[0, np.cumsum(bit, dtype=np.int32)])
            self.zeros.append(len(seq) - int(self.ones[-1][-1]))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of symbol[i] before position at[i]."""
        low = np.zeros_like(at)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            bit = (symbol >> (self.bits - 1 - k) & 1).astype(bool)
            a, b = ones[low], ones[at]
            low, at = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, at - b)
        return at - low

    def get(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            bit = ones[at + 1] - ones[at]
            out = out << 1 | bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By doubling prefix ranks; the last symbol is smaller than any other."""
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64)
    n, k = len(seq), 1
    while True:
        key = rank * (n + 1)
        key[:-k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.r_[0, np.cumsum(s[1:] != s[:-1])]
        rank[order] = new
        if new[-1] == n - 1 or k * 2 >= n:
            return order
        k *= 2


class FMIndex:
    """Over a sequence of symbols >= 1; symbol 1 separates runs, 0 is appended as the end."""

    def __init__(self, seq: np.ndarray, symbols: int):
        seq = np.r_[seq, 0].astype(np.int64)
        sa = suffix_array(seq)
        self.tree = WaveletTree(seq[sa - 1], max(1, int(symbols).bit_length()))
        self.first = np.r_[0, np.cumsum(np.bincount(seq, minlength=symbols + 1))]
        self.sampled = sa % SAMPLE == 0
        self.kept = sa[self.sampled]
        self.upto = np.r_[0, np.cumsum(self.sampled)]
        self.n = len(seq)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of all rows of phrases (same length) by backward search."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[:, j]
            live = np.flatnonzero(lo < hi)
            if not len(live):
                break
            lo[live] = self.first[c[live]] + self.tree.rank(c[live], lo[live])
            hi[live] = self.first[c[live]] + self.tree.rank(c[live], hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks, by steps back to a sampled position."""
        out, at, steps, left = np.zeros(len(rows), np.int64), rows.copy(), 0, np.arange(len(rows))
        while len(left):
            here = self.sampled[at]
            out[left[here]] = self.kept[self.upto[at[here]]] + steps
            left, at = left[~here], at[~here]
            c = self.tree.get(at)
            at = self.first[c] + self.tree.rank(c, at)
            steps += 1
        return out


def phrase_table(items: list[tuple[str | None, list[bytes]]]) -> tuple[dict, dict, dict]:
    """Symbols of the words (from 2), windows by length as {length: (distinct rows of symbols, item numbers of each)}."""
    symbol: dict = {}
    seen: dict = {}
    for k, (_, ws) in enumerate(items):
        ids = [symbol.setdefault(w, len(symbol) + 2) for w in ws]
        m = min(WINDOW, len(ids))
        for i in range(len(ids) - m + 1 if m else 0):
            seen.setdefault(m, {}).setdefault(tuple(ids[i : i + m]), set()).add(k)
    short = {w for m, x in seen.items() if m < WINDOW for row in x for w in row}
    return symbol, {m: (np.array(list(x), np.int64), [sorted(v) for v in x.values()]) for m, x in seen.items()}, short


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_DDL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start: long, end: long>>"


def _shard(ids: list, texts: list[list[bytes]], items, symbol, windows, short):
    sizes = [len(t) for t in texts]
    flat = np.fromiter(map(symbol.get, chain.from_iterable((*t, b"") for t in texts), repeat(1)), np.int64, sum(sizes) + len(sizes))
    start = np.r_[0, np.cumsum(np.array(sizes, np.int64) + 1)]
    spans, found = [[] for _ in ids], [set() for _ in ids]
    # runs of benchmark words that some window can fit into
    inside = flat > 1
    edge = np.diff(np.r_[0, inside.astype(np.int8), 0])
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = b - a >= WINDOW
    if short:
        least = min(m for m in windows if m < WINDOW)
        some = np.r_[0, np.cumsum(np.isin(flat, np.array(sorted(short))))]
        keep |= (b - a >= least) & (some[b] > some[a])
    a, b = a[keep], b[keep]
    if len(a) and windows:
        held = np.concatenate([np.r_[flat[i:j], 1] for i, j in zip(a, b, strict=True)])
        base = np.r_[0, np.cumsum(b - a + 1)]
        index = FMIndex(held, len(symbol) + 2)
        for m, (rows, owners) in windows.items():
            lo, hi = index.search(rows)
            hit = np.flatnonzero(lo < hi)
            if not len(hit):
                continue
            # all occurrences of all windows are located together
            count = hi[hit] - lo[hit]
            which = np.repeat(hit, count)
            at = index.locate(np.arange(len(which)) - np.repeat(np.cumsum(count) - count - lo[hit], count))
            run = np.searchsorted(base, at, "right") - 1
            at = a[run] + at - base[run]
            doc = np.searchsorted(start, at, "right") - 1
            for w, d, p in zip(which.tolist(), doc.tolist(), (at - start[doc]).tolist(), strict=True):
                spans[d].append((p, p + m))
                found[d].update(owners[w])
    out = {f.name: [] for f in _OUT}
    for d, doc in enumerate(ids):
        merged: list = []
        for i, j in sorted(set(spans[d])):
            if merged and i <= merged[-1]["end"]:
                merged[-1]["end"] = max(j, merged[-1]["end"])
            else:
                merged.append({"start": i, "end": j})
        names = sorted({items[k][0] for k in found[d]} - {None})
        row = (doc, sizes[d], sum(x["end"] - x["start"] for x in merged), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(merged), merged)
        for f, v in zip(_OUT, row, strict=True):
            out[f.name].append(v)
    return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _OUT], schema=_OUT)


def _phrases(benchmark: DataFrame):
    size = benchmark.select(F.sum(F.regexp_count("text", F.lit(_WORD))).alias("n")).first()["n"] or 0
    if size > MAX_PHRASE_WORDS:
        raise ValueError(f"the benchmark has {size} words; {MAX_PHRASE_WORDS} go to every task at most")
    items = [(r[0], words(r[1])) for r in benchmark.select(F.col("item_id").cast("string"), "text").collect()]
    return items, *phrase_table(items)


def _shards(batches, text: int):
    """Lists of (batch, words of its texts) with SHARD_WORDS words at least, but for the last; a batch may be cut."""
    held, size = [], 0
    for b in batches:
        start, ws = 0, []
        for i, t in enumerate(b.column(text)):
            ws.append(words(t.as_py()))
            size += len(ws[-1])
            if size >= SHARD_WORDS:
                yield [*held, (b.slice(start, i + 1 - start), ws)]
                held, size, start, ws = [], 0, i + 1, []
        if ws:
            held.append((b.slice(start), ws))
    if held:
        yield held


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (of word numbers, end exclusive) of docs(doc_id, text)."""
    items, symbol, windows, short = _phrases(benchmark)

    def run(batches):
        for shard in _shards(batches, 1):
            ids = [d for b, _ in shard for d in b.column(0).to_pylist()]
            yield _shard(ids, [w for _, ws in shard for w in ws], items, symbol, windows, short)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _DDL)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, all columns, without any benchmark window, in one pass."""
    items, symbol, windows, short = _phrases(benchmark)
    at = docs.columns.index("text")

    def run(batches):
        for shard in _shards(batches, at):
            texts = [w for _, ws in shard for w in ws]
            bad = _shard([None] * len(texts), texts, items, symbol, windows, short).column("contaminated").to_pylist()
            k = 0
            for b, ws in shard:
                yield b.filter(pa.array([not x for x in bad[k : k + len(ws)]], pa.bool_()))
                k += len(ws)

    return docs.mapInArrow(run, docs.schema)


def cut(text: str | None, spans) -> str | None:
    """text without the words of spans ((start, end) word numbers, in order) and what stands between them."""
    if not text or not spans:
        return text
    at = [m.span() for m in re.finditer(_WORD, text)]
    out, upto = [], 0
    for start, end in spans:
        out.append(text[upto : at[start][0]])
        upto = at[end - 1][1]
    return "".join([*out, text[upto:]])


def without_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, same rows and columns, with the merged removal spans cut from text; the other columns stay as they are."""
    items, symbol, windows, short = _phrases(benchmark)
    at = docs.columns.index("text")

    def run(batches):
        for shard in _shards(batches, at):
            texts = [w for _, ws in shard for w in ws]
            found = _shard([None] * len(texts), texts, items, symbol, windows, short).column("spans").to_pylist()
            k = 0
            for b, ws in shard:
                left = [cut(t.as_py(), [(x["start"], x["end"]) for x in s]) for t, s in zip(b.column(at), found[k : k + len(ws)], strict=True)]
                k += len(ws)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.string()) if i == at else b.column(i) for i in range(b.num_columns)], names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
