"""PII by bootstrapped contextual extraction.

Seeds are what four fixed forms find: e-mail and IP addresses, card numbers that pass the Luhn check,
and international phone numbers. Every seed and everything else that looks like an identifier is an
instance: a token with an @ or at least four digits, a run of groups of digits with single spaces
between, a bracketed "at" (and "dot") with its neighbours. The words before it, after it and around it
are its patterns. Spark scores the graph of patterns and instances in rounds, until neither
patterns nor instances are new. A pattern judges an instance by the others it has: of n with s sure
ones of a kind the n - 1 others, smoothed, s / (n - 1 + 0.5) for one that isn't sure (it is among the
n, but not among the s). It is trusted from a confidence of 0.9 and five sure instances on; instances
of trusted patterns are sure from then on and count for others. The trusted patterns, as sorted arrays
in the shared folder, then discover identifiers of unseen form in a last pass over the texts. Base
spans always stay.

The graph holds rows only for identifier-like tokens, and rounds aggregate by pattern before they
join, so a word that stands before a third of all instances is one row a task.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import Sorted
from .text import U64

KINDS = ("email", "ip", "card", "phone")
SURE = 0.9
SUPPORT = 5
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Tokens that may be or begin an identifier; each is scanned once, however long.
_LIKE = re.compile(r"(?<!\S)[^\s0-9@(\[]*+[0-9@(\[]\S*+")
_GROUP = re.compile(r"[0-9()+./:-]++")
_AT = re.compile(r"[(\[]at[)\]]", re.I)
_DOT = re.compile(r"[(\[]dot[)\]]", re.I)
_END = ".,;:!?"
#: Digits of the longest identifier; a longer run of groups is taken group by group.
MOST_DIGITS = 19
_WORD = re.compile(r"\S++")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all seeds, by kind and start; per kind leftmost and not overlapping."""
    found, after = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((0, start, m.end()))
            after = m.end()
        at = text.find("@", max(at + 1, after))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
                found.append((1, m.start(), m.end()))
        for m in _DIGITS.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                    found.append((3, m.start(), m.end()))
    return found


def compatible(kind: int, token: str) -> bool:
    """Whether a token may be an identifier of this kind in some form."""
    digits = len(_DIGIT.findall(token))
    if kind == 0:
        return "@" in token or _AT.search(token) is not None
    if kind == 1:
        return digits >= 4 and ("." in token or ":" in token) and "@" not in token
    return (digits >= 13 if kind == 2 else digits >= 7) and "@" not in token


def _hash(*x: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x00".join(x).encode(), digest_size=8).digest(), "little", signed=True)


def _word_before(text: str, at: int) -> str:
    while at and text[at - 1].isspace():
        at -= 1
    start = at
    while start and not text[start - 1].isspace():
        start -= 1
    return text[start:at].lower()


def _word_after(text: str, at: int) -> str:
    m = _WORD.search(text, at)
    return m[0].lower() if m else ""


def patterns(text: str, start: int, end: int) -> list[int]:
    """Contexts of a span: the word before, the word after, both."""
    a, b = _word_before(text, start), _word_after(text, end)
    return [_hash(*x) for x in (("before", a), ("after", b), ("around", a, b)) if all(x)]


def _neighbours(text: str, start: int, end: int) -> tuple[int, int]:
    """A bracketed "at" with the tokens one space before and after, and "dot"s and tokens that follow."""
    if start > 1 and text[start - 1] == " ":
        before = start - 1
        while before and not text[before - 1].isspace():
            before -= 1
        start = before if before < start - 1 else start
    while text[end : end + 1] == " ":
        after = end + 1
        while after < len(text) and not text[after].isspace():
            after += 1
        if after == end + 1:
            break
        follows = text[after : after + 7]
        end = after
        if not (follows[:1] == " " and _DOT.match(follows, 1) or _DOT.fullmatch(text, max(0, after - 5), after)):
            break
    return start, end


def _likely(text: str) -> Iterator[tuple[int, int]]:
    """Spans like identifiers, from left to right."""
    group: list[tuple[int, int]] = []
    reach = 0  # what a bracketed "at" has taken

    def closed() -> Iterator[tuple[int, int]]:
        if group:
            s, e = group[0][0], group[-1][1]
            digits = len(_DIGIT.findall(text, s, e))
            if len(group) > 1 and digits > MOST_DIGITS:
                yield from ((a, b) for a, b in group if len(_DIGIT.findall(text, a, b)) >= 4)
            elif digits >= 4:
                yield s, e
            group.clear()

    for m in _LIKE.finditer(text):
        s, e = m.span()
        if s < reach or text[e : e + 1] == " " and _AT.match(text, e + 1):
            continue  # part of what goes with the "at"
        if group and not (s == group[-1][1] + 1 and text[s - 1] == " " and text[group[-1][1] - 1] not in _END):
            yield from closed()
        if _GROUP.fullmatch(text, s, e if text[e - 1] not in _END else e - 1):
            group.append((s, e))
            continue
        yield from closed()
        if _AT.fullmatch(text, s, e):
            span = _neighbours(text, s, e)
            if span[0] >= reach:
                reach = span[1]
                yield span
        elif "@" in m[0] or _AT.search(m[0]) or len(_DIGIT.findall(m[0])) >= 4:
            yield s, e
    yield from closed()


def instances(text: str, base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Seeds, then other tokens like identifiers (kind -1) that overlap none of them."""
    yield from base
    if not (_DIGIT.search(text) or "@" in text or _AT.search(text)):
        return
    # what seeds take, as starts and the furthest end so far
    taken = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    for s, e in _likely(text):
        while e > s and text[e - 1] in _END:
            e -= 1
        k = bisect_left(starts, e)
        if e > s and not (k and reach[k - 1] > s):
            yield -1, s, e


def _graph(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {}
        for text in batch.column("text").to_pylist():
            if text:
                for kind, s, e in instances(text, base_spans(text)):
                    token = text[s:e]
                    fits = sum(1 << k for k in range(4) if compatible(k, token))
                    for p in patterns(text, s, e):
                        rows[_hash(token.lower()), kind, p] = fits
        columns = [[k[i] for k in rows] for i in range(3)] + [list(rows.values())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32()), strict=True)], ["instance", "kind", "pattern", "fits"])


def _write_patterns(table: pa.Table, store: Sorted) -> pa.Table:
    b, k = table.column("bucket")[0].as_py(), np.array(table.column("pattern")).view(U64)
    order = np.argsort(k)
    store.write(b, k[order], np.array(table.column("kind"), np.int64)[order])
    return pa.table({"bucket": pa.array([b], pa.int32()), "n": pa.array([len(k)])})


def trusted_patterns(texts: DataFrame) -> DataFrame:
    """(pattern, kind) that the rounds have come to trust."""
    edges = shared.written(shared.mapped(texts.select("text"), _graph, "instance long, kind int, pattern long, fits int").distinct(), "pii-graph")
    known = edges.where("kind >= 0").select("instance", F.col("kind").alias("sure")).distinct()
    before = None
    while True:
        scored = edges.join(known, "instance", "left").groupBy("pattern", "instance").agg(F.min("sure").alias("sure"), F.max("sure").alias("other"))
        scored = scored.groupBy("pattern").agg(F.count("*").alias("n"), *(F.count_if(F.col("sure").eqNullSafe(k) & F.col("other").eqNullSafe(k)).alias(f"k{k}") for k in range(4)))
        best = F.greatest(*(F.struct(F.col(f"k{k}").alias("sure"), F.lit(k).alias("kind")) for k in range(4)))
        others = F.greatest(F.col("n") - 1, F.col("best.sure"))
        scored = scored.withColumn("best", best).where((F.col("best.sure") >= SUPPORT) & (F.col("best.sure") / (others + 0.5) >= SURE))
        trusted = shared.written(scored.select("pattern", F.col("best.kind").alias("kind")), "pii-patterns")
        fresh = edges.where("kind < 0").join(trusted.withColumnRenamed("kind", "sure"), "pattern").where("shiftright(fits, sure) % 2 = 1").select("instance", "sure")
        known = shared.written(known.union(fresh).distinct(), "pii-known")
        # instances only become sure, so this ends
        now = trusted.count(), known.count()
        if now == before:
            return trusted
        before = now


def discover(texts: DataFrame) -> Sorted:
    """The trusted patterns of these texts as sorted arrays."""
    spark = texts.sparkSession
    store = Sorted(shared.folder(spark, "pii"), shared.bits(texts), ("kinds",))
    found = trusted_patterns(texts).select(F.expr(f"int(shiftrightunsigned(pattern, {64 - store.bits}))").alias("bucket"), "pattern", "kind")
    found.groupBy("bucket").applyInArrow(shared.with_args(_write_patterns, store=store), "bucket int, n long").agg(F.sum("n")).collect()
    return store


def all_spans(text: str, store: Sorted) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The base spans, and these with what trusted patterns discover, by kind and start."""
    base = base_spans(text)
    found = list(base)
    for kind, s, e in instances(text, base):
        if kind < 0 and (p := patterns(text, s, e)):
            held, kinds = store.find(np.sort(np.unique(np.array(p, np.int64).view(U64))), -1)
            for k in sorted(set(kinds[held].tolist())):
                if compatible(k, text[s:e]):
                    found.append((k, s, e))
                    break
    return base, sorted(found)


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


ROWS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _report(batches: Iterator[pa.RecordBatch], store: Sorted) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            base, every = all_spans(text or "", store)
            n = [sum(k == x for k, *_ in base) for x in range(4)]
            out.append((*n, hashlib.sha256(_said(base).encode()).hexdigest(), _said(every)))
        columns = zip(*out, strict=True) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()] * 2, strict=True))], [x.split()[0] for x in ROWS.split(", ")])


def personal_data(documents: DataFrame) -> DataFrame:
    """One row for each row of documents: the numbers of base spans by kind, a digest of them, and all
    spans (code points, end exclusive).

    A null text counts as empty and has no spans. Repeated rows get the same spans and count as one
    instance. Other columns are ignored. An empty table gives no rows.
    """
    return shared.mapped(documents.select("doc_id", "text"), partial(_report, store=discover(documents)), ROWS)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in angle brackets; overlapping spans by the first's."""
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k, s, e in spans):
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _mask(batches: Iterator[pa.RecordBatch], store: Sorted) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if t is None else masked(t, all_spans(t, store)[1]) for t in batch.column("text").to_pylist()]
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))


def mask(documents: DataFrame) -> DataFrame:
    """documents with all their columns, their texts without personal data; a null text stays null."""
    return shared.mapped(documents, partial(_mask, store=discover(documents)), documents.schema)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
