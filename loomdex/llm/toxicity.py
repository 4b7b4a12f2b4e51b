"""Toxicity by a factorization machine over hashed terms.

A text's features are the hashes of its distinct words (lower-cased, outer punctuation off) and of their first STEM letters. The score is the logistic of
w0 + sum w_i + sum_{i<j} <v_i, v_j>: pairs such as an insult with a group's mention add to what single words say. The
machine is trained on the driver from a bounded sample of labelled rows, MOST_POSITIVE and MOST_NEGATIVE of each class by
hash order of doc_id, as far as MOST_TERMS terms in all go (a row that no longer fits is passed over), near copies once. It holds all
features that MIN_ROWS sampled rows have, so the model that goes to every task is bounded by the sample. Each feature's
value is how far its share of class 1 is off, alone, among the rows of a feature that is itself MIN_Z standard deviations
off, or beside one of the PAIRED most frequent features that tell nothing alone (PAIR_Z, as there are many pairs): 1 from
that bound on, below it the POWER-th power of the part reached, which keeps chance features small. Every row is scored over
its whole text.

A very long text is scored as any other. A score of exactly 0.5 is predicted 1. Null and empty texts score as the bias alone. With no labelled rows, or those of one class, all scores are the share of
class 1 (0 without rows). Repeated label rows count once; null labels and null doc_ids are not learned from. Repeated
documents and null doc_ids keep a row each. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

FACTORS, EPOCHS, BATCH, RATE, DECAY = 4, 30, 64, 0.2, 1e-6
MOST_POSITIVE, MOST_NEGATIVE, MIN_ROWS, MIN_Z, POWER = 4000, 8000, 4, 4.0, 4
MOST_TERMS, PAIRED, PAIR_Z = 8_000_000, 2048, 7.0
STEM = 5
_ORDERS = (2654435761, 2246822519, 3266489917)
_TRIM = ".,;:!?\"'()[]{}*#$%&|<>-_~`/\\"


def terms(text: str | None) -> np.ndarray:
    """Sorted distinct 32-bit hashes of a text's words."""
    if not text:
        return np.empty(0, np.int64)
    found = {w.strip(_TRIM) for w in text.lower().split()}
    found |= {f"{w[:STEM]}~" for w in found if len(w) > STEM}
    found.discard("")
    return np.unique(np.fromiter((xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) for w in found), np.int64, len(found)))


class Machine:
    def __init__(self, ids, w, v, bias):
        self.ids, self.w, self.v, self.bias = ids, w, v, bias

    def score(self, feats: np.ndarray) -> float:
        z = self.bias
        if len(feats) and len(self.ids):
            at = np.searchsorted(self.ids, feats)
            at[at == len(self.ids)] = 0
            at = at[self.ids[at] == feats]
            v = self.v[at]
            z += float(self.w[at].sum()) + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def shares(up, n, p: float):
    """Standard deviations that up of n rows are off the share p."""
    return (up - p * n) / np.sqrt(np.maximum(n, 1) * p * (1 - p))


def together(each: list[np.ndarray], y: np.ndarray, df: np.ndarray, z: np.ndarray) -> np.ndarray:
    """How far the share of class 1 is off where two features meet that both tell nothing alone: per feature the highest of its
    pairs, scaled so that PAIR_Z becomes MIN_Z; 0 for features that tell or aren't looked at."""
    out = np.zeros(len(df))
    plain = np.flatnonzero((z < MIN_Z) & (df >= MIN_ROWS))
    plain = plain[np.lexsort((plain, -df[plain]))[:PAIRED]]
    if len(plain) < 2:
        return out
    place = np.full(len(df), -1)
    place[plain] = np.arange(len(plain))
    both, up = np.zeros((len(plain), len(plain)), np.float32), np.zeros((len(plain), len(plain)), np.float32)
    for k in range(0, len(each), 1024):
        x = np.zeros((len(each[k : k + 1024]), len(plain)), np.float32)
        for i, e in enumerate(each[k : k + 1024]):
            at = place[e]
            x[i, at[at >= 0]] = 1
        both += x.T @ x
        up += x.T @ (x * y[k : k + 1024, None].astype(np.float32))
    off = np.where(both >= MIN_ROWS, np.abs(shares(up, both, y.mean())), 0)
    np.fill_diagonal(off, 0)
    out[plain] = off.max(axis=1) * (MIN_Z / PAIR_Z)
    return out


def train(rows: list[np.ndarray], labels: list[int], seed: int = 7) -> Machine:
    """Mini-batch AdaGrad on the logistic loss; rows: terms() of each text."""
    y = np.array(labels, float)
    if not len(y) or y.min() == y.max():
        p = float(y.mean()) if len(y) else 0.0
        return Machine(np.empty(0, np.int64), np.empty(0), np.empty((0, FACTORS)), float(np.clip(np.log(max(p, 1e-13) / max(1 - p, 1e-13)), -30, 30)))
    # near copies count once, else their words look telling: rows of one label with equal minima under three hash orders
    keys = {}
    for i, r in enumerate(rows):
        mixed = [int(((r * m) & 0xFFFFFFFF).min()) if len(r) else -1 for m in _ORDERS]
        keys.setdefault((labels[i], *mixed), i)
    rows, y = [rows[i] for i in keys.values()], y[list(keys.values())]
    ids, df = np.unique(np.concatenate(rows), return_counts=True)
    up = np.bincount(np.searchsorted(ids, np.concatenate([r for r, t in zip(rows, y, strict=True) if t])), minlength=len(ids))
    each = [np.searchsorted(ids, r).astype(np.int32) for r in rows]
    z = np.where(df >= MIN_ROWS, np.abs(shares(up, df, y.mean())), 0)
    # a term may tell only beside another: its share among the rows of each telling term counts as well
    at, of = np.concatenate(each), np.repeat(np.arange(len(rows), dtype=np.int32), [len(e) for e in each])
    by = np.argsort(at, kind="stable")
    first = np.searchsorted(at[by], np.arange(len(ids) + 1))
    for j in np.flatnonzero(z >= MIN_Z):
        own = of[by[first[j] : first[j + 1]]]
        if 0 < (p := y[own].mean()) < 1:
            n = np.bincount(np.concatenate([each[i] for i in own]), minlength=len(ids))
            k = np.bincount(np.concatenate([each[i] for i in own if y[i]]), minlength=len(ids))
            z = np.maximum(z, np.where(n >= MIN_ROWS, np.abs(shares(k, n, p)), 0))
    z = np.maximum(z, together(each, y, df, z))
    del each, at, of, by
    kept = df >= MIN_ROWS
    ids, scale = ids[kept], np.minimum(1, z[kept] / MIN_Z) ** POWER
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(ids)), rng.normal(0, 0.01, (len(ids), FACTORS))
    gw, gv, g0 = np.full(len(ids), 1e-6), np.full((len(ids), FACTORS), 1e-6), 1e-6
    bias = float(np.log(y.mean() / (1 - y.mean())))
    feats = [np.searchsorted(ids, r[np.isin(r, ids, assume_unique=True)]).astype(np.int32) for r in rows]
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(order), BATCH):
            part = order[k : k + BATCH]
            size = np.array([len(feats[i]) for i in part])
            col, row = np.concatenate([feats[i] for i in part]), np.repeat(np.arange(len(part)), size)
            x = scale[col]
            vs = v[col] * x[:, None]
            sums = np.zeros((len(part), FACTORS))
            np.add.at(sums, row, vs)
            square = np.bincount(row, (vs**2).sum(axis=1), len(part))
            z = bias + np.bincount(row, w[col] * x, len(part)) + 0.5 * ((sums**2).sum(axis=1) - square)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)
            gr = g[row] * x
            used, inv = np.unique(col, return_inverse=True)
            dw = np.bincount(inv, gr, len(used)) + DECAY * w[used]
            dv = np.stack([np.bincount(inv, gr * (sums[row, f] - vs[:, f]), len(used)) for f in range(FACTORS)], axis=1) + DECAY * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            g0 += g.sum() ** 2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= 0.3 * RATE * dv / np.sqrt(gv[used])
            bias -= RATE * g.sum() / np.sqrt(g0)
    return Machine(ids, (w * scale).astype(np.float32), (v * scale[:, None]).astype(np.float32), float(bias))


def fold(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def learn(docs: DataFrame, labels: DataFrame) -> Machine:
    """Trains on the labelled rows outside fold 0 of 5."""
    marked = labels.where("doc_id is not null and toxic in (0, 1)").where(fold(F.col("doc_id"), 5) != 0).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = marked.where("toxic = 1").orderBy(*order).limit(MOST_POSITIVE).union(marked.where("toxic = 0").orderBy(*order).limit(MOST_NEGATIVE))
    chosen = materialise(chosen, "toxic-sample")  # MOST_POSITIVE + MOST_NEGATIVE rows at most

    def features(batches):
        for b in batches:
            for i in range(b.num_rows):
                t = terms(b.column(1)[i].as_py()).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(2).slice(i, 1), pa.array([len(t)], pa.int64()), pa.array([t.tobytes()], pa.binary())], names=["doc_id", "toxic", "n", "terms"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").mapInArrow(features, "doc_id long, toxic int, n long, terms binary")
    rows = materialise(rows.groupBy("doc_id").agg(F.min(F.struct("terms", "n", "toxic")).alias("r")).select("doc_id", "r.*"), "toxic-terms")
    # both classes share the bound on terms in the order of the sample
    kept, held = [], {0: 0, 1: 0}
    for r in rows.select("doc_id", "toxic", "n", F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect():
        if held[r.toxic] + r.n <= MOST_TERMS // 2:
            held[r.toxic] += r.n
            kept.append(r.doc_id)
    keys = rows.sparkSession.createDataFrame([(k,) for k in kept], "doc_id long")
    got = sorted(rows.join(F.broadcast(keys), "doc_id").select("doc_id", "toxic", "terms").collect())
    discard(chosen, rows)
    return train([np.frombuffer(r.terms, np.uint32).astype(np.int64) for r in got], [r.toxic for r in got])


def toxicity(docs: DataFrame, labels: DataFrame, machine: Machine | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text)."""
    machine = machine or learn(docs, labels)

    def run(batches):
        for b in batches:
            s = [machine.score(terms(x.as_py())) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
