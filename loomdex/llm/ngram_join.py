"""N-gram Jaccard join by signature trees.

Sets are the distinct five-word shingles of a text; two sets link when 100 * |A and B| >= 80 * |A or B|. The exact
links' connected components come out, by these steps:

1. One pass makes every set's size and 128-bit digest, and per chunk of documents the shingles by hash range. A shingle
   found in no other set can't be shared, so a set with more than a fifth of such shingles links with nothing. Shingles
   that a chunk holds several times leave it once: no key grows with its frequency.
2. Equal sets collapse to their smallest doc_id; the remaining texts are read again as full sets.
3. Linked sets share one of their 0.2 n + 1 rarest shingles (prefix filter), so stars over those give families. Shingle
   frequencies are counted by hash range in the same chunked way, and returned to the chunks.
4. A signature tree joins each family: nodes hold OR-combined token bitmaps and size ranges, and a traversal of node
   pairs drops those whose greatest possible overlap is too small, and those already in one component. Large families
   are cut into blocks; after the blocks' own joins and a pivot per family, only the sets outside the main component
   meet the other blocks.

Nulls and empty texts: n_shingles 0 and component_id = doc_id. A null doc_id keeps its row and n_shingles, links with
nothing and has a null component_id. Repeated rows keep a row each. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, materialise

K = 5
#: Sets up to FULL shingles count all of them, larger ones those in the lower half of the hash space; those up to
#: EDGE (1.25 * FULL) still show all of theirs, as they can link with sets that count all.
FULL, EDGE = 256, 320
CHUNK_TOKENS, CHUNK_SETS = 2_000_000, 60_000
#: Sets of a family, and tokens, that one task joins at once.
BLOCK_SETS, BLOCK_TOKENS = 2000, 4_000_000
SIG_BITS, FANOUT, LEAF = 4096, 8, 16
HOT_SHARE = 0.001
CONTRACT = 1_000_000
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Words(dict):
    def __missing__(self, word):
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, words: dict, k: int = K) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.empty(0, np.uint64)
    a = np.fromiter(map(words.__getitem__, w), np.uint64, len(w))
    m = min(k, len(w))
    n = len(w) - m + 1
    h = np.full(n, len(w) if m < k else k, np.uint64)
    for i in range(m):
        h = (h ^ (h >> np.uint64(29))) * _MULT[i] + a[i : n + i]
    h ^= h >> np.uint64(32)
    h *= _MULT[0]
    h ^= h >> np.uint64(29)
    return np.unique(h)


_PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("chunk", pa.int64()), ("idx", pa.int32()), ("rng", pa.int32()), ("alone", pa.binary()), ("owner", pa.binary()), ("shared", pa.binary())])
_PROFILE_DDL = "doc_id long, n long, k1 long, k2 long, chunk long, idx int, rng int, alone binary, owner binary, shared binary"


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def _profiler(range_bits: int, width: int):
    """Arrow batches of (doc_id, text) -> profile rows (rng null) and shingle rows by (chunk, rng)."""
    low, unit = np.uint64(64 - range_bits), np.uint32 if width == 4 else np.uint64

    def rows(**cols):
        n = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in _PROFILE], schema=_PROFILE)

    def blocks(chunk, sets, shown):
        if not sets:
            return
        t = np.concatenate(shown)
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(x) for x in shown])
        counts = np.repeat(np.array([len(x) > FULL for x in sets]), [len(x) for x in shown])
        order = np.argsort(t, kind="stable")
        t, owner, counts = t[order], owner[order], counts[order]
        new = np.r_[True, t[1:] != t[:-1]]
        once = new & np.r_[new[1:], True]
        # a token of a large set in the upper half of the space is shown, not counted
        mine = once & ~(counts & (t >> np.uint64(63) != 0))
        rest = new & ~mine
        twice = ~once
        r = (t >> low).astype(np.int64) if range_bits else np.zeros(len(t), np.int64)
        cut = (t << np.uint64(range_bits)) >> np.uint64(64 - 8 * width) if width == 4 else t
        got = ([], [], [], [])
        edges = np.searchsorted(r, np.arange((1 << range_bits) + 1))
        for k in range(1 << range_bits):
            i, j = edges[k], edges[k + 1]
            if i == j:
                continue
            m, o = mine[i:j], owner[i:j]
            at = np.argsort(o[m], kind="stable")
            # shared: tokens that this chunk holds twice go in twice over, so that they are never alone
            s = np.concatenate([cut[i:j][rest[i:j]], cut[i:j][rest[i:j] & twice[i:j]]])
            for x, v in zip(got, (k, cut[i:j][m][at].astype(unit).tobytes(), o[m][at].tobytes(), s.astype(unit).tobytes()), strict=True):
                x.append(v)
        if got[0]:
            yield rows(chunk=[chunk] * len(got[0]), rng=got[0], alone=got[1], owner=got[2], shared=got[3])

    def run(batches):
        from pyspark import TaskContext

        words, seq, part = _Words(), 0, TaskContext.get().partitionId()
        sets, shown, local, held = [], [], {}, 0
        for b in batches:
            out = {c: [] for c in ("doc_id", "n", "k1", "k2", "chunk", "idx")}
            full = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingle_set(text.as_py(), words)
                key = _digest(s)
                if key not in local:
                    if len(s) and (held + len(s) > CHUNK_TOKENS or len(sets) >= CHUNK_SETS):
                        full.append((part << 24 | seq, sets, shown))
                        seq, sets, shown, local, held = seq + 1, [], [], {}, 0
                        for done in full:
                            yield from blocks(*done)
                        full = []
                    local[key] = len(sets)
                    sets.append(s)
                    shown.append(s if len(s) <= EDGE else s[: np.searchsorted(s, np.uint64(1) << np.uint64(63))])
                    held += len(shown[-1])
                for c, v in zip(out, (doc, len(s), *key, part << 24 | seq, local[key]), strict=True):
                    out[c].append(v)
            yield rows(**out)
        yield from blocks(part << 24 | seq, sets, shown)

    return run


def _alone_counter(width: int):
    """One hash range -> per chunk, how many shingles of each set no other set has."""
    unit = np.uint32 if width == 4 else np.uint64

    def run(t: pa.Table) -> pa.Table:
        chunk = t.column("chunk").to_pylist()
        own = [np.frombuffer(x.as_py(), unit) for x in t.column("alone")]
        who = [np.frombuffer(x.as_py(), np.uint16) for x in t.column("owner")]
        rest = [np.frombuffer(x.as_py(), unit) for x in t.column("shared")]
        mine = np.concatenate(own)
        every = np.sort(np.concatenate([mine, *rest]))
        single = np.searchsorted(every, mine, "right") - np.searchsorted(every, mine, "left") == 1
        out, at = [], 0
        for x, w in zip(own, who, strict=True):
            out.append(np.bincount(w[single[at : at + len(x)]]).astype(np.uint16).tobytes())
            at += len(x)
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "counts": pa.array(out, pa.binary())})

    return run


def _alone_sum(t: pa.Table) -> pa.Table:
    rows = [np.frombuffer(x.as_py(), np.uint16) for x in t.column("counts")]
    total = np.zeros(max([1, *map(len, rows)]), np.int64)
    for x in rows:
        total[: len(x)] += x
    return pa.table({"chunk": pa.array([t.column("chunk")[0].as_py()] * len(total), pa.int64()), "idx": pa.array(range(len(total)), pa.int32()), "alone": pa.array(total, pa.int64())})


_SETS = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("chunk", pa.int64()), ("tokens", pa.binary()), ("rng", pa.int32()), ("counts", pa.binary())])
_SETS_DDL = "rep long, n long, k1 long, k2 long, chunk long, tokens binary, rng int, counts binary"


def _full_sets(range_bits: int):
    """A row for each document's set (rng null); per chunk and hash range, its distinct shingles and how many sets have each."""

    def rows(**cols):
        n = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in _SETS], schema=_SETS)

    def counts(chunk, sets):
        t, c = np.unique(np.concatenate(sets), return_counts=True)
        edges = np.searchsorted(t >> np.uint64(64 - range_bits), np.arange((1 << range_bits) + 1, dtype=np.uint64))
        spans = [(k, i, j) for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if i < j]
        return rows(chunk=[chunk] * len(spans), rng=[k for k, _, _ in spans], tokens=[t[i:j].tobytes() for _, i, j in spans], counts=[c[i:j].astype(np.uint32).tobytes() for _, i, j in spans])

    def run(batches):
        from pyspark import TaskContext

        words, seq, part, held, size = _Words(), 0, TaskContext.get().partitionId(), [], 0
        for b in batches:
            out = {c: [] for c in ("rep", "n", "k1", "k2", "chunk", "tokens")}
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingle_set(text.as_py(), words)
                if held and (size + len(s) > CHUNK_TOKENS or len(held) >= CHUNK_SETS):
                    yield counts(part << 24 | seq, held)
                    held, seq, size = [], seq + 1, 0
                if len(s):
                    held.append(s)
                    size += len(s)
                    for c, v in zip(out, (doc, len(s), *_digest(s), part << 24 | seq, s.tobytes()), strict=True):
                        out[c].append(v)
            yield rows(**out)
        if held:
            yield counts(part << 24 | seq, held)

    return run


def _frequencies(t: pa.Table) -> pa.Table:
    """One hash range: for each chunk's shingles, how many sets of all chunks have them."""
    own = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("tokens")]
    number = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in t.column("counts")])
    _, inv = np.unique(np.concatenate(own), return_inverse=True)
    total = np.bincount(inv, number)[inv].astype(np.uint32)
    cuts = np.cumsum([len(x) for x in own])[:-1]
    return pa.table({"chunk": t.column("chunk"), "rng": t.column("rng"), "df": pa.array([x.tobytes() for x in np.split(total, cuts)], pa.binary())})


def _prefixes(sets: pa.Table, freq: pa.Table) -> pa.Table:
    """One chunk: each set's 0.2 n + 1 rarest shingles (ties by hash), without those that no other set has."""
    reps = sets.column("rep").to_pylist()
    own = [np.frombuffer(x.as_py(), np.uint64) for x in sets.column("tokens")]
    df = np.concatenate([np.frombuffer(x, np.uint32) for _, x in sorted(zip(freq.column("rng").to_pylist(), freq.column("df").to_pylist(), strict=True))])
    every = np.unique(np.concatenate(own))
    token, rep = [], []
    for r, s in zip(reps, own, strict=True):
        d = df[np.searchsorted(every, s)]
        at = np.lexsort((s, d))[: len(s) // 5 + 1]
        at = at[d[at] > 1]
        token.append(s[at].view(np.int64))
        rep.append(np.full(len(at), r, np.int64))
    return pa.table({"token": pa.array(np.concatenate(token)), "rep": pa.array(np.concatenate(rep))})


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 80 * union, on sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if 5 * len(a) < 4 * len(b) or not len(a):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int(np.count_nonzero(b[at] == a))
    return 100 * both >= 80 * (len(a) + len(b) - both)


class SignatureTree:
    """Leaf pages of up to LEAF sets, upper nodes of up to FANOUT children. A node has the OR of its sets' bitmaps, its
    sets' size range, and its slack: the most tokens of one of its sets beyond that set's bits."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        size = np.array([len(s) for s in sets], np.int64)
        bits = min(SIG_BITS, max(64, 1 << int(2 * max(size) - 1).bit_length()))
        sig = np.zeros((len(sets), bits // 8), np.uint8)
        for i, s in enumerate(sets):
            flat = np.zeros(bits, np.uint8)
            flat[(s % np.uint64(bits)).astype(np.int64)] = 1
            sig[i] = np.packbits(flat)
        sig = sig.view(np.uint64)
        # like sets side by side: by size class, then by smallest token
        order = np.lexsort((np.array([int(s[0]) if len(s) else 0 for s in sets], np.uint64), (np.log2(np.maximum(size, 1)) * 3).astype(int)))
        self.order = order
        self.sig, self.size = sig[order], size[order]
        self.slack = self.size - np.bitwise_count(self.sig).sum(axis=1, dtype=np.int64)
        # levels[0]: leaf pages as (first, last + 1) in order; each upper level: ranges over the level below
        self.levels = []
        spans = [(i, min(i + LEAF, len(sets))) for i in range(0, len(sets), LEAF)]
        stat = [self._stat(self.sig[i:j], self.size[i:j], self.size[i:j], self.slack[i:j]) for i, j in spans]
        self.levels.append((spans, stat, spans))
        while len(spans) > 1:
            up = [(i, min(i + FANOUT, len(spans))) for i in range(0, len(spans), FANOUT)]
            stat = [self._stat(np.array([s[0] for s in stat[i:j]]), np.array([s[1] for s in stat[i:j]]), np.array([s[2] for s in stat[i:j]]), np.array([s[3] for s in stat[i:j]])) for i, j in up]
            cover = [(self.levels[-1][2][i][0], self.levels[-1][2][j - 1][1]) for i, j in up]
            self.levels.append((up, stat, cover))
            spans = up

    @staticmethod
    def _stat(sig, low, high, slack):
        return np.bitwise_or.reduce(sig, axis=0), int(low.min()), int(high.max()), int(slack.max())

    @staticmethod
    def possible(x, y) -> bool:
        """Whether a set below x and one below y can overlap enough."""
        if 5 * x[2] < 4 * y[1] or 5 * y[2] < 4 * x[1]:
            return False
        most = min(x[2], y[2], min(x[3], y[3]) + int(np.bitwise_count(x[0] & y[0]).sum()))
        return 5 * most >= 4 * max(x[1], y[1])

    def join(self, forest: Forest, wanted=None):
        """Yields pairs of positions that link and whose components were apart. wanted(i, j): whether two sets by
        position in self.sets are to be compared at all."""
        order = self.order.tolist()
        todo = [(len(self.levels) - 1, 0, 0)]
        one = {}

        def root(level, k):
            """The component of all sets of a node, None if there are several."""
            if (level, k) in one:
                return forest.find(one[level, k])
            i, j = self.levels[level][2][k]
            r = forest.find(order[i])
            for x in range(i + 1, j):
                if forest.find(order[x]) != r:
                    return None
            one[level, k] = r
            return r

        while todo:
            level, a, b = todo.pop()
            spans, stat, _ = self.levels[level]
            if a != b and not self.possible(stat[a], stat[b]):
                continue
            ra = root(level, a)
            if ra is not None and ra == root(level, b):
                continue
            if level:
                (i, j), (k, m) = spans[a], spans[b]
                # a node with itself last on the stack, so that it is joined first
                pairs = [(x, y) for x in range(i, j) for y in range(k, m) if x < y or a != b and x != y]
                todo += [(level - 1, x, y) for x, y in pairs]
                if a == b:
                    todo += [(level - 1, x, x) for x in range(i, j)]
                continue
            yield from self._pages(spans[a], spans[b], forest, order, wanted)

    def _pages(self, one, two, forest, order, wanted):
        (i, j), (k, m) = one, two
        both = np.bitwise_count(self.sig[i:j, None, :] & self.sig[None, k:m, :]).sum(axis=2, dtype=np.int64)
        sa, sb = self.size[i:j, None], self.size[None, k:m]
        most = np.minimum(np.minimum(sa, sb), both + np.minimum(self.slack[i:j, None], self.slack[None, k:m]))
        maybe = 9 * most >= 4 * (sa + sb)
        for x, y in np.argwhere(maybe).tolist():
            p, q = order[i + x], order[k + y]
            if (one == two and x >= y) or forest.find(p) == forest.find(q) or (wanted and not wanted(p, q)):
                continue
            if linked(self.sets[p], self.sets[q]):
                forest.join(p, q)
                yield p, q


def join_sets(ids, sets, comps=None, residual=None):
    """Links that span the components of these sets. comps: known components; residual: whether a set is outside its
    family's main component; then pairs with no such set are left out."""
    forest = Forest(len(sets))
    if comps is not None:
        first: dict = {}
        for i, c in enumerate(comps):
            forest.join(first.setdefault(c, i), i)
    wanted = (lambda p, q: residual[p] or residual[q]) if residual is not None else None
    tree = SignatureTree(sets)
    return [(ids[p], ids[q]) for p, q in tree.join(forest, wanted)]


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _grouped(batches, key):
    """(key, columns) for each run of equal keys of sorted batches."""
    held, now = [], None
    for b in batches:
        keys = b.column(key).to_pylist()
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if held and keys[start] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = keys[start]
            held.append(b.slice(start, i - start))
            start = i
    if held:
        yield pa.Table.from_batches(held)


def _tree_join(batches):
    for t in _grouped(batches, "task"):
        if t.num_rows < 2:
            continue
        col = {c: t.column(c).to_pylist() for c in t.column_names if c != "tokens"}
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("tokens")]
        links = join_sets(col["rep"], sets, col.get("comp"), col.get("residual"))
        if links:
            yield _stars(links)


def _stars(links) -> pa.RecordBatch:
    """Links as (a, b): each node and the smallest one of its component."""
    at: dict = {}
    for x, y in links:
        at.setdefault(x, len(at))
        at.setdefault(y, len(at))
    forest, nodes = Forest(len(at)), list(at)
    for x, y in links:
        forest.join(at[x], at[y])
    roots = [forest.find(i) for i in range(len(nodes))]
    least: dict = {}
    for n, r in zip(nodes, roots, strict=True):
        least[r] = min(n, least.get(r, n))
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([least[r] for r in roots], pa.int64())], schema=_LINKS)


def _contract(batches):
    """Edges (rep, hub) of a task as stars; CONTRACT edges, and a batch, are held at most."""
    held: list = []
    for b in batches:
        held += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        if len(held) >= CONTRACT:
            yield _stars(held)
            held = []
    if held:
        yield _stars(held)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("task").sortWithinPartitions("task", "n").mapInArrow(_tree_join, "a long, b long")


def _profile(docs: DataFrame) -> tuple[DataFrame, int, int]:
    parts = max(1, docs.rdd.getNumPartitions())
    bits, width = min(16, max(6, (parts - 1).bit_length())), 4 if parts <= 4096 else 8
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_profiler(bits, width), _PROFILE_DDL)
    return materialise(out, "shingles"), bits, width


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs(doc_id, text)."""
    made, bits, width = _profile(docs)
    profile = materialise(made.where("rng is null").select("doc_id", "n", "k1", "k2", "chunk", "idx"), "profile")
    alone = made.where("rng is not null").select("chunk", "rng", "alone", "owner", "shared").groupBy("rng").applyInArrow(_alone_counter(width), "chunk long, counts binary").groupBy("chunk").applyInArrow(_alone_sum, "chunk long, idx int, alone long")
    # smallest doc_id of each distinct set; those with a fifth of their shingles unshared at most can link
    classes = profile.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    able = profile.where("n > 0 and doc_id is not null").join(alone, ["chunk", "idx"], "left").where("5 * coalesce(alone, 0) <= n").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    able = materialise(able.select("k1", "k2", F.col("rep").alias("doc_id")), "able")
    discard(made)
    # a doc_id that stands for several texts (bad input) is told apart by the digest
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(able.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").mapInArrow(_full_sets(bits), _SETS_DDL)
    made = materialise(made, "sets")
    sets = made.where("rng is null").select("rep", "n", "chunk", "tokens")
    freq = made.where("rng is not null").select("chunk", "rng", "tokens", "counts").groupBy("rng").applyInArrow(_frequencies, "chunk long, rng int, df binary")
    stars = materialise(sets.groupBy("chunk").cogroup(freq.groupBy("chunk")).applyInArrow(_prefixes, "token long, rep long"), "prefixes")
    hubs = stars.groupBy("token").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).where("hub < last").select("token", "hub")
    near = stars.join(hubs, "token").where("rep <> hub").select("rep", "hub").mapInArrow(_contract, "a long, b long")
    family = components(near, "a", "b", "families")
    # who belongs where is settled on rows without shingles; a hot family never gathers its sets in a task
    light = sets.select("rep", "n").join(family.select(F.col("node").alias("rep"), F.col("component").alias("family")), "rep")
    per = light.groupBy("family").agg(F.count("*").alias("members"), F.sum("n").alias("mass"))
    large = per.where((F.col("members") > BLOCK_SETS) | (F.col("mass") > BLOCK_TOKENS))
    blocks = large.select("family", F.ceil(F.greatest(F.col("members") / BLOCK_SETS, F.col("mass") / BLOCK_TOKENS)).cast("int").alias("blocks"))
    placed = light.join(blocks, "family", "left").select("rep", "family", "blocks", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(F.xxhash64("rep"), "blocks")).cast("int").alias("block"))
    dealt = materialise(sets.select("rep", "n", "tokens").join(placed, "rep"), "held")
    discard(made, stars)
    several = not dealt.where("blocks is not null").isEmpty()
    tasks = dealt.select(F.concat_ws(":", "family", "block").alias("task"), "rep", "n", "tokens")
    if several:
        comp = _large(dealt.where("blocks is not null"), tasks)
    else:  # each family was joined in one task, so its links are its components
        comp = materialise(_dealt(tasks), "links").select(F.col("a").alias("node"), F.col("b").alias("component"))
    discard(dealt)
    # a set that a HOT_SHARE of all documents have meets them by broadcast (1 / HOT_SHARE rows at most), the rest by shuffle
    least = profile.count() * HOT_SHARE
    hot = F.broadcast(classes.where(F.col("copies") > F.greatest(F.lit(least), F.lit(1))).select("k1", "k2", "rep"))
    rest = profile.join(hot, ["k1", "k2"], "left_anti").join(classes.where(F.col("copies") <= F.greatest(F.lit(least), F.lit(1))).select("k1", "k2", "rep"), ["k1", "k2"], "left")
    out = profile.join(hot, ["k1", "k2"]).unionByName(rest).join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    empty = F.when(F.col("n") == 0, F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(empty, "component", "rep")).alias("component_id"))


def _large(dealt: DataFrame, tasks: DataFrame) -> DataFrame:
    """node, component from the links of all tasks; families of several blocks (dealt) also join each block to a pivot set,
    and then what is outside each family's main component to all blocks."""
    pivot = dealt.groupBy("family").agg(F.max_by(F.struct("rep", "n", "tokens"), F.struct("n", "rep")).alias("p"))
    # each block gets its family's pivot as one row more
    pivots = dealt.select("family", "block").distinct().join(pivot, "family").select(F.concat_ws(":", "family", "block").alias("task"), "p.rep", "p.n", "p.tokens")
    links = materialise(_dealt(tasks.union(pivots)), "links-blocks")
    comp = components(links, "a", "b", "blocks")
    where = dealt.select("rep", "family").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "family", F.coalesce("component", "rep").alias("comp"))
    main = where.groupBy("family", "comp").agg(F.count("*").alias("c")).groupBy("family").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
    where = where.join(main, "family").select("rep", "comp", (F.col("comp") != F.col("main")).alias("residual"))
    placed = materialise(dealt.join(where, "rep"), "placed")
    if placed.where("residual").isEmpty():
        return comp
    left = placed.where("residual").select("family", F.col("block").alias("rblock")).distinct()
    # residual sets of one block with every block of the family
    theirs = placed.join(left, "family").select(F.concat_ws(":", "family", "rblock", "block").alias("task"), "rep", "n", "tokens", "comp", "residual")
    own = placed.where("residual").select("family", F.col("block").alias("rblock"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", "n", "tokens", "comp", "residual").where("block <> rblock").select(F.concat_ws(":", "family", "rblock", "block").alias("task"), "rep", "n", "tokens", "comp", "residual")
    return components(materialise(links.union(_dealt(theirs.union(own))), "links-all"), "a", "b", "links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs, same columns, without the documents whose component has a smaller doc_id. Rows with a null doc_id stay; repeated
    rows of one doc_id stay or go together."""
    later = jaccard_components(docs.select("doc_id", "text")).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)
