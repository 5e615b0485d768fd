"""Scalar functions on texts and paths: built-in expressions first, Arrow UDFs where none will do."""


import re
import sys
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .chunker import chunked, chunks  # noqa: F401
from .udf import arrow_udf


def _marks() -> re.Pattern:
    """Runs of combining characters."""
    found = [k for k in range(0x300, sys.maxunicode + 1) if unicodedata.combining(chr(k))]
    return re.compile("[" + "".join(chr(k) for k in found) + "]+")


_MARKS = _marks()


def folded(t: str | None) -> str | None:
    """Case, width and diacritics removed (compatibility decomposition, marks dropped, case folded)."""
    return None if t is None else _MARKS.sub("", unicodedata.normalize("NFKD", t)).casefold()


@arrow_udf("string")
def _folded(s: pd.Series) -> pd.Series:
    return s.map(folded)


def fold(c: Column | str) -> Column:
    """folded() of a column: texts in ASCII are lower-cased where they are, only others go to Python."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.length(c) == F.octet_length(c)
    return F.when(plain, F.lower(c)).otherwise(_folded(F.when(~plain, c)))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def normal_path(c: Column) -> Column:
    """Without empty and . parts; .. takes away the part before it."""
    parts = F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))))
    return F.array_join(walked, "/")


def parent(c: Column) -> Column:
    return F.regexp_replace(c, "/?[^/]*$", "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def snippet(body: Column, word: Column, before: int = 48, after: int = 130) -> Column:
    """The text around the first occurrence of a word in any case, white space collapsed, with ellipses
    where it was cut; the head of the text where the word doesn't occur."""
    flat = collapse(body)
    at = F.instr(F.lower(flat), F.lower(word))
    start = F.greatest(at - before, F.lit(1))
    cut = F.substr(flat, start, F.lit(before + after))
    return F.concat(F.when(start > 1, "…").otherwise(""), F.trim(cut), F.when(F.length(flat) >= start + before + after, "…").otherwise(""))


def best_match(flat: Column, raw: Column, terms: Column) -> Column:
    """struct(at, length): where the whole query is in a text, in any case, else its longest term; at is 0 for neither."""
    longest = F.element_at(F.array_sort(F.coalesce(terms, F.array().cast("array<string>")), lambda a, b: F.length(b) - F.length(a)), 1)
    found = F.array(*(F.struct(F.when(F.length(w) > 0, F.instr(F.lower(flat), F.lower(w))).otherwise(0).alias("at"), F.coalesce(F.length(w), F.lit(0)).alias("length")) for w in (raw, F.try_element_at(F.when(F.size(terms) > 0, F.array(longest)).otherwise(F.array().cast("array<string>")), F.lit(1)))))
    hit = F.filter(found, lambda m: m["at"] > 0)
    return F.coalesce(F.try_element_at(hit, F.lit(1)), F.struct(F.lit(0).alias("at"), F.lit(0).alias("length")))


def best_snippet(body: Column, raw: Column, terms: Column, before: int = 48, after: int = 130) -> Column:
    """The text around best_match(), white space collapsed, with ellipses where it was cut; else the head."""
    flat = collapse(body)
    start = F.greatest(best_match(flat, raw, terms)["at"] - before, F.lit(1))
    return F.concat(F.when(start > 1, "…").otherwise(""), F.trim(F.substr(flat, start, F.lit(before + after))), F.when(F.length(flat) >= start + before + after, "…").otherwise(""))


def token_estimate(c: Column) -> Column:
    return F.ceil(F.octet_length(c) / 4)


def decoded_tags(c: Column) -> Column:
    """The strings of a JSON list; broken JSON, or JSON of another kind, has none."""
    found = F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>"))
    return F.coalesce(F.filter(found, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def decoded_path(c: Column) -> Column:
    """The headings of a stored path; an empty one has none."""
    return F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(c, "\x1f"))


#: Fixed forms of secrets that a report must not show.
SECRETS = [r"AKIA[0-9A-Z]{16}", r"(?i)(password|api_key|token)\s*[=:]\s*[\"']?[A-Za-z0-9_\-]{8,}[\"']?", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"]


def redact(c: Column, roots: list[str] = ()) -> Column:
    """Secrets, addresses and known folders give way to a mark."""
    for root in sorted(roots, key=len, reverse=True):
        c = F.replace(c, F.lit(root), F.lit("<folder>"))
    for pattern in SECRETS:
        c = F.regexp_replace(c, pattern, "<redacted>")
    return c


DIFF = "array<struct<op: string, line: string>>"


#: Lines times lines up to which a longest common subsequence is looked for.
MOST_CELLS = 4_000_000


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """A longest common subsequence: pairs of places, ascending. Row by row: the best so far, one more where lines are
    equal, and what stands to the left."""
    names: dict[str, int] = {}
    x, y = (np.array([names.setdefault(t, len(names)) for t in z]) for z in (a, b))
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for k in range(len(a)):
        np.maximum.accumulate(np.maximum(best[k, 1:], best[k, :-1] + (y == x[k])), out=best[k + 1, 1:])
    out, i, j = [], len(a), len(b)
    while i and j:
        if best[i, j] == best[i, j - 1]:
            j -= 1
        elif best[i, j] == best[i - 1, j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return out[::-1]


def line_diff(before: str, after: str) -> list[dict]:
    """Lines kept (' '), removed ('-') and added ('+'), in order: what both share at the head and the tail, and between
    them a longest common subsequence; beyond MOST_CELLS all lines between are removed and added."""
    a, b = ((t or "").split("\n") if t else [] for t in (before, after))
    head = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    most = min(len(a), len(b)) - head
    tail = next((k for k in range(most) if a[-1 - k] != b[-1 - k]), most)
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    pairs = _common(x, y) if x and y and len(x) * len(y) <= MOST_CELLS else []
    out, i, j = [(" ", t) for t in a[:head]], 0, 0
    for p, q in [*pairs, (len(x), len(y))]:
        out += [("-", t) for t in x[i:p]] + [("+", t) for t in y[j:q]] + ([(" ", x[p])] if p < len(x) else [])
        i, j = p + 1, q + 1
    return [{"op": o, "line": t} for o, t in [*out, *((" ", t) for t in a[len(a) - tail :])]]


def hunks(change: list[dict], context: int = 3) -> list[dict]:
    """Changed lines with up to ``context`` kept ones on either side; nearer ones are one hunk. Starts count from 0."""
    marks = [k for k, c in enumerate(change) if c["op"] != " "]
    out: list[dict] = []
    for k in marks:
        lo, hi = max(0, k - context), min(len(change), k + context + 1)
        if out and lo <= out[-1]["end"]:
            out[-1]["end"] = hi
        else:
            out.append({"start": lo, "end": hi})
    for h in out:
        ahead = change[: h["start"]]
        h["before_start"], h["after_start"] = (sum(c["op"] != o for c in ahead) for o in "+-")
        h["lines"] = change[h["start"] : h["end"]]
    return out


def unified(before: str, after: str, names: tuple[str, str] = ("before", "after")) -> str:
    """A diff as text; empty for equal texts."""
    found = hunks(line_diff(before, after))
    if not found:
        return ""
    out = [f"--- {names[0]}", f"+++ {names[1]}"]
    for h in found:
        n, m = (sum(c["op"] != o for c in h["lines"]) for o in "+-")
        out.append(f"@@ -{h['before_start'] + (n > 0)},{n} +{h['after_start'] + (m > 0)},{m} @@")
        out += [c["op"] + c["line"] for c in h["lines"]]
    return "\n".join(out) + "\n"


@arrow_udf("string")
def unified_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([unified(a, b) for a, b in zip(before, after, strict=True)])


@arrow_udf(DIFF)
def diff(before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([line_diff(a, b) for a, b in zip(before, after, strict=True)])


def patched(current: str, change: list[dict], reverse: bool = False) -> str | None:
    """A diff applied to a text that may have moved on: each hunk goes where its lines are, nearest to where they were;
    None where one is not to be found."""
    gone, new = ("+", "-") if reverse else ("-", "+")
    lines, moved = (current or "").split("\n") if current else [], 0
    for h in hunks(change):
        old = [c["line"] for c in h["lines"] if c["op"] in (" ", gone)]
        put = [c["line"] for c in h["lines"] if c["op"] in (" ", new)]
        want = h["after_start" if reverse else "before_start"] + moved
        spots = [k for k in range(len(lines) - len(old) + 1) if lines[k : k + len(old)] == old] if old else [max(0, min(want, len(lines)))]
        if not spots:
            return None
        at = min(spots, key=lambda k: abs(k - want))
        lines[at : at + len(old)] = put
        moved += len(put) - len(old)
    return "\n".join(lines)


FRONT = "struct<id: string, created: string, tags: array<string>, body: string>"


def front_matter(text: str | None) -> dict:
    """id, created and tags of a leading block between --- lines (closed by --- or ...); the rest is the
    body. An open or missing block leaves the whole text as body."""
    text = (text or "").removeprefix("﻿")
    lines = text.splitlines(keepends=True)
    found = {"id": None, "created": None, "tags": [], "body": text}
    if not lines or lines[0].rstrip() != "---":
        return found
    end = next((k for k, x in enumerate(lines[1:], 1) if x.rstrip() in ("---", "...")), None)
    if end is None:
        return found
    found["body"], key = "".join(lines[end + 1 :]), None
    for line in lines[1:end]:
        item = re.match(r"\s*-\s+(.*)", line)
        pair = re.match(r"([\w-]+)\s*:\s*(.*?)\s*$", line)
        if pair:
            key, value = pair[1].lower(), pair[2]
            if key == "tags":
                found["tags"] = [t for t in (x.strip().strip("\"'") for x in value.strip("[]").split(",")) if t]
            elif key in ("id", "created"):
                found[key] = value.strip("\"'") or None
        elif item and key == "tags":
            found["tags"].append(item[1].strip().strip("\"'"))
    return found


@arrow_udf(FRONT)
def parsed_front_matter(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([front_matter(t) for t in text], columns=["id", "created", "tags", "body"])


WIDTH = 64
_WORDS = re.compile(r"\w+")
#: Words whose hashes a worker remembers.
REMEMBERED = 1 << 18
_hashes: dict[str, int] = {}


def _fnv(words: list[str]) -> np.ndarray:
    """The 64-bit FNV-1a hashes of words, byte by byte for all of them at once."""
    raw = [w.encode() for w in words]
    size = np.array([len(x) for x in raw])
    h = np.full(len(raw), 0xCBF29CE484222325, np.uint64)
    order = np.argsort(-size, kind="stable")
    # the k-th byte of all words that have one; long words come first
    flat = np.frombuffer(b"".join(raw[k] for k in order), np.uint8)
    begin = np.cumsum(size[order]) - size[order]
    for k in range(int(size.max(initial=0))):
        n = int(np.searchsorted(-size[order], -k, "left"))
        h[:n] = (h[:n] ^ flat[begin[:n] + k]) * np.uint64(0x100000001B3)
    out = np.empty_like(h)
    out[order] = h
    return out


def _vectors(texts: list[str | None]) -> np.ndarray:
    each = [_WORDS.findall((t or "").lower()) for t in texts]
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    new = list({w for words in each for w in words if w not in _hashes})
    _hashes.update(zip(new, _fnv(new).tolist() if new else [], strict=True))
    h = np.array([_hashes[w] for words in each for w in words], np.uint64)
    row = np.repeat(np.arange(len(each)), [len(words) for words in each])
    sign = np.where(h >> np.uint64(63), 1.0, -1.0)
    v = np.bincount(row * WIDTH + (h % np.uint64(WIDTH)).astype(np.int64), sign, len(each) * WIDTH).reshape(-1, WIDTH)
    n = np.sqrt((v * v).sum(1, keepdims=True))
    v[n[:, 0] == 0, 0] = 1.0
    return (v / np.where(n > 0, n, 1.0)).astype(np.float32)


@arrow_udf("array<float>")
def hashed_embedding(text: pd.Series) -> pd.Series:
    """64 signed buckets of FNV-1a hashes of words, unit length; the first axis for a text without words."""
    return pd.Series(list(_vectors(text.tolist())), index=text.index, dtype=object)
