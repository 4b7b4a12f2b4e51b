"""Personal data: fixed patterns, and terms that give protected entities away by information-theoretic sanitisation.

Emails, IP addresses, card numbers and phone numbers are found by pattern in every whole text; these spans always stay.
Each one's normalised value is a protected entity. The corpus then tells how much a term reveals of an entity:
PMI(e, t) = log2(N * co(e, t) / (n(e) * df(t))), with N the distinct texts, df(t) those that hold t, n(e) the distinct contexts
of e and co(e, t) those contexts (up to NEAR words on either side, not counting those of other spans) that hold t. A term that at least SUPPORT contexts of an
entity hold and whose PMI is THRESHOLD of the entity's own information log2(N / n(e)) at least discloses it: each of its
occurrences in a document that holds that entity, but for those in base spans, becomes a span of kind term. All counts
cover all documents. An entity with fewer than SUPPORT distinct contexts has no such terms: any rare word would pass.

Counts leave a task pre-added, one row per word and task; the words of texts that occur more than once leave it once per
task and text, and are counted once. Pairs of entity and term exist only within contexts; texts are kept beside the counts
only where they hold an entity.

What is found is generalised to its kind, as [EMAIL], and disclosing terms are removed: clean_sha256 is the hash of the text
that is left, null where nothing was found.

Null and empty texts have no spans (base_sha256 is that of an empty string). A very long text is scanned whole, in time that grows with its length. Repeated rows and null doc_ids keep a row
each; copies are one context. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

NEAR, SUPPORT, THRESHOLD, FLUSH = 6, 3, 0.9, 300_000
KINDS = ("email", "ip", "card", "phone", "term")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can't start inside a run of digits unless one at its start failed, and then none inside matches either
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def _emails(text: str):
    """Leftmost, non-overlapping, without rescanning long local parts."""
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, normalised value), sorted."""
    if not text:
        return []
    out = [(s, 0, e, text[s:e].lower()) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            out.append((m.start(), 1, m.end(), ".".join(p or "0" for p in parts)))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end(), digits))
    for m in _PHONE.finditer(text) if "+" in text else ():
        digits = re.sub("[^0-9]", "", m[0])
        if 9 <= len(digits) <= 15:
            out.append((m.start(), 3, m.end(), digits))
    return sorted(out)


def terms_outside(text: str, spans: list) -> list[tuple[str, int, int]]:
    """(lower-cased term, start, end) of all terms that no base span touches; spans: sorted (start, _, end, _)."""
    out, k, reach = [], 0, 0
    for m in _TERM.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][2])
            k += 1
        if reach <= m.start():
            out.append((m[0].lower(), m.start(), m.end()))
    return out


def contexts(text: str, spans: list) -> list[tuple[str, str, set[str]]]:
    """(entity, hash of the words around, those words) per base span."""
    if not spans:
        return []
    out, terms = [], terms_outside(text, spans)
    starts = [s for _, s, _ in terms]
    for start, kind, end, value in spans:
        i, j = bisect_left(starts, start), bisect_left(starts, end)
        words = [w for w, _, _ in terms[max(0, i - NEAR) : i] + terms[j : j + NEAR]]
        out.append((f"{KINDS[kind]}:{value}", xxhash.xxh3_64_hexdigest(" ".join(words).encode("utf-8", "surrogatepass")), set(words)))
    return out


def _words(text: str) -> set[str]:
    """Lower-cased one by one, as those of contexts are."""
    return {w.lower() for w in set(_TERM.findall(text))}


_ROWS = pa.schema([("copied", pa.int64()), ("words", pa.list_(pa.string())), ("row", pa.int64()), ("doc_id", pa.int64()), ("spans", pa.string()), ("entity", pa.string()), ("context", pa.string()), ("term", pa.string()), ("text", pa.string()), ("n", pa.int64())])
_DDL = "copied long, words array<string>, row long, doc_id long, spans string, entity string, context string, term string, text string, n long"


def _scan(batches):
    """Rows of four sorts: a document's base spans (spans set; text too if it has any); a term beside an entity (entity set; term null for a context as such); term counts (n set); a copied text's words (copied set to its digest).

    The third column of the input is the digest of a text that several rows hold, null for others.
    """
    from pyspark import TaskContext

    row, held, copied = TaskContext.get().partitionId() << 33, Counter(), set()

    def rows(items, *names):
        cols = dict(zip(names, zip(*items, strict=True), strict=True)) if items else {}
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(len(items), f.type) for f in _ROWS], schema=_ROWS)

    for b in batches:
        docs, near, copies = [], [], []
        for doc, text, digest in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            text = text.as_py() or ""
            spans = base_spans(text)
            docs.append((row, doc, ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in spans), text if spans else None))
            for entity, context, words in contexts(text, spans):
                near.append((row, entity, context, None))
                near += [(row, entity, context, w) for w in words]
            if digest is None:
                held.update(_words(text))
            elif digest not in copied:
                copied.add(digest)
                copies.append((digest, list(_words(text))))
            row += 1
            if len(copied) > FLUSH:
                copied.clear()
            if len(held) > FLUSH:
                yield rows(list(held.items()), "term", "n")
                held.clear()
        yield rows(docs, "row", "doc_id", "spans", "text")
        yield rows(near, "row", "entity", "context", "term")
        yield rows(copies, "copied", "words")
    yield rows(list(held.items()), "term", "n")


def disclosing(near: DataFrame, counts: DataFrame, texts: int) -> DataFrame:
    """entity, term, pmi of the terms that give an entity away."""
    of = near.where("term is null").groupBy("entity").agg(F.countDistinct("context").alias("ne"))
    co = near.where("term is not null").groupBy("entity", "term").agg(F.countDistinct("context").alias("co")).where(F.col("co") >= SUPPORT)
    both = co.join(of, "entity").join(counts, "term")
    pmi, own = F.log2(F.lit(float(texts)) * F.col("co") / (F.col("ne") * F.col("df"))), F.log2(F.lit(float(texts)) / F.col("ne"))
    return both.where((own > 0) & (pmi >= THRESHOLD * own)).select("entity", "term", pmi.alias("pmi"))


def clean_text(text: str | None, spans: str | None) -> str | None:
    """text with each span generalised to its kind, as [EMAIL], and terms removed."""
    if not text or not spans:
        return text
    out, at = [], 0
    for kind, s, e in (x.split(":") for x in spans.split(",")):
        if int(s) >= at:
            out += [text[at : int(s)], "" if kind == "term" else f"[{kind.upper()}]"]
        at = max(at, int(e))
    return "".join([*out, text[at:]])


def _digest(base: str, every: str | None) -> tuple:
    kinds = Counter(x.partition(":")[0] for x in base.split(",") if x)
    return *(kinds.get(k, 0) for k in KINDS[:4]), hashlib.sha256(base.encode()).hexdigest(), base if every is None else every


def _mark(batches):
    """All spans of each text with those of the given terms, their number, and the hash of the text without them."""
    for b in batches:
        rows = []
        for text, told in zip(b.column(1), b.column(2).to_pylist(), strict=True):
            text, told = text.as_py(), set(told or ())
            base = base_spans(text)
            found = [(s, k, e) for s, k, e, _ in base] + [(s, KINDS.index("term"), e) for w, s, e in terms_outside(text, base) if w in told]
            spans = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))
            rows.append((spans, len(found), hashlib.sha256(clean_text(text, spans).encode("utf-8", "surrogatepass")).hexdigest()))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], pa.int64() if i == 1 else pa.string()) for i in range(3))], names=["row", "every", "n_spans", "clean_sha256"])


def _finish(batches):
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", "clean_sha256"]
    for b in batches:
        rows = [_digest(base, every) for base, every in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], pa.int64() if i < 4 else pa.string()) for i in range(6)), b.column(3), b.column(4)], names=names)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts, base_sha256, spans, n_spans and clean_sha256 for every row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("digest"))
    digests = materialise(rows.groupBy("digest").count(), "pii-digests")
    copies = materialise(digests.where("count > 1").select(F.col("digest").alias("copied")), "pii-copies")
    made = materialise(rows.join(copies, rows.digest == copies.copied, "left").select("doc_id", "text", "copied").mapInArrow(_scan, _DDL), "pii")
    base = made.where("spans is not null").select("row", "doc_id", "spans")
    near = made.where("entity is not null").select("row", "entity", "context", "term")
    once = made.where("copied is not null").groupBy("copied").agg(F.first("words").alias("words")).select(F.explode("words").alias("term"), F.lit(1).cast("long").alias("n"))
    counts = made.where("n is not null").select("term", "n").union(once).groupBy("term").agg(F.sum("n").alias("df"))
    told = disclosing(near, counts, digests.count())
    held = near.where("term is null").select("row", "entity").distinct().join(told, "entity").groupBy("row").agg(F.collect_set("term").alias("terms"))
    more = made.where("text is not null").select("row", "text").join(held.hint("merge"), "row", "left").select("row", "text", "terms").mapInArrow(_mark, "row long, every string, n_spans long, clean_sha256 string")
    found = base.join(more, "row", "left").select("doc_id", "spans", "every", F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), "clean_sha256")
    return found.mapInArrow(_finish, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, clean_sha256 string")


def sanitise(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with text in which each span of found(doc_id, spans) is generalised to its kind, as [EMAIL]; terms are removed.

    Rows without spans, and null texts, stay as they are. doc_id must be unique in found.
    """

    def run(batches):
        for b in batches:
            k, spans = b.schema.get_field_index("text"), b.column("__spans").to_pylist()
            texts = pa.array([clean_text(t.as_py(), s) for t, s in zip(b.column(k), spans, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([texts if i == k else b.column(i) for i in range(b.num_columns - 1)], names=b.schema.names[:-1])

    joined = docs.join(found.select(F.col("doc_id").alias("__doc"), F.col("spans").alias("__spans")), F.col("doc_id") == F.col("__doc"), "left").select(*docs.columns, "__spans")
    return joined.mapInArrow(run, docs.schema)
