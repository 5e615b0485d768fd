"""Functions on notes: names, paths, front matter, segments, tags, snippets, label tests, half floats.

Built-in expressions wherever they say it; small Arrow UDFs for what goes character by character.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .udf import arrow_udf

MOST_BYTES, MOST_DEPTH = 200, 2
UNTITLED, MARK, RULE = "Untitled", "```", "---"
ASSETS = "_assets"


def clamped(text: str, limit: int) -> str:
    """The longest beginning of at most so many bytes."""
    return text.encode()[:limit].decode(errors="ignore") if len(text.encode()) > limit else text


def clean_title(raw: str | None) -> str:
    """A title that may be a file's name: separators become dashes, controls go, white space is single, dots and
    spaces at the ends go, 200 bytes at most; Untitled for nothing."""
    out = re.sub(r"[/:\\]", "-", unicodedata.normalize("NFC", raw or ""))
    out = re.sub(r"[\n\r\t]", " ", out)
    out = "".join(c for c in out if unicodedata.category(c) not in ("Cc", "Cf"))
    out = re.sub(r" +", " ", out).strip(" .")
    return clamped(out, MOST_BYTES).rstrip(" .") or UNTITLED


@arrow_udf("string")
def safe_title(raw: pd.Series) -> pd.Series:
    return raw.map(clean_title)


def numbered(title: Column, attempt: Column) -> Column:
    """Title, Title 2, Title 3, ...: shortened so that the number still fits (byte by byte: ASCII titles)."""
    tail = F.concat(F.lit(" "), attempt.cast("string"))
    return F.when(attempt <= 1, title).otherwise(F.concat(F.substr(title, F.lit(1), F.lit(MOST_BYTES) - F.length(tail)), tail))


def unsafe(path: Column) -> Column:
    """Absolute, with a null byte, a line break, or a part ..."""
    return path.rlike(r"^[/~]") | path.rlike("[\\x00\n\r]") | F.exists(F.split(path, "/"), lambda p: p == "..")


def is_note(path: Column) -> Column:
    """A Markdown file, not hidden and not among the assets."""
    parts = F.split(path, "/")
    return F.lower(path).endswith(".md") & ~F.exists(parts, lambda p: p.startswith(".")) & (F.element_at(parts, 1) != ASSETS)


def depth(folder: Column) -> Column:
    return F.when(folder == "", 0).otherwise(F.size(F.split(folder, "/")))


def fenced(body: Column, language: Column) -> Column:
    """Text as a fenced block; the closing fence gets a line of its own."""
    return F.concat(F.lit(MARK), F.trim(F.coalesce(language, F.lit(""))), F.lit("\n"), body, F.when(body.endswith("\n"), "").otherwise("\n"), F.lit(MARK))


def merged_tags(have: Column, more: Column) -> Column:
    """All tags, trimmed, each once in any case; the first spelling stays."""
    every = F.filter(F.transform(F.concat(have, more), lambda t: F.trim(t)), lambda t: t != "")
    return F.aggregate(every, F.array().cast("array<string>"), lambda out, t: F.when(F.exists(out, lambda o: F.lower(o) == F.lower(t)), out).otherwise(F.concat(out, F.array(t))))


_SPACE = r"[\s]+"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def appended(content: Column, body: Column) -> Column:
    """Content at the end of a note, under a rule where there is something above."""
    head, new = F.regexp_replace(body, r"\s+$", ""), stripped(content)
    return F.when((head == "") & (new == ""), "").when(head == "", F.concat(new, F.lit("\n"))).otherwise(F.concat(head, F.lit(f"\n\n{RULE}\n\n"), new, F.lit("\n")))


def without_segment(segment: Column, body: Column) -> Column:
    """A note without the first verbatim occurrence of a segment, the seam tidied; null where it isn't there."""
    at = F.instr(body, segment)
    head = F.regexp_replace(F.substr(body, F.lit(1), at - 1), r"\s+$", "")
    tail = F.regexp_replace(F.substr(body, at + F.length(segment)), r"^\s*\n|^\s+", "")
    tail = F.regexp_replace(tail, r"^[\s]+", "")
    joined = F.when((head == "") & (tail == ""), "").when(head == "", tail).when(tail == "", F.concat(head, F.lit("\n"))).otherwise(F.concat(head, F.lit("\n\n"), tail))
    return F.when((segment != "") & (at > 0), joined)


def added_lines(old: Column, new: Column) -> Column:
    """The lines of a text between the head and the tail that it shares with an earlier one."""
    a, b = F.split(old, "\n"), F.split(new, "\n")
    least = F.least(F.size(a), F.size(b))

    def shared(x: Column, y: Column, most: Column) -> Column:
        """How many leading elements are equal."""
        differ = F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda i: (i > most) | (F.get(x, i - 1) != F.get(y, i - 1)))
        return F.coalesce(F.try_element_at(differ, F.lit(1)) - 1, most)

    head = shared(a, b, least)
    tail = shared(F.reverse(a), F.reverse(b), least - head)
    return F.when(F.coalesce(new, F.lit("")) == "", "").when(F.coalesce(old, F.lit("")) == "", new).when(old == new, "").otherwise(F.array_join(F.slice(b, head + 1, F.size(b) - head - tail), "\n"))


def match_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), _SPACE, " "))


def bare_line(line: Column) -> Column:
    """A line without list marks, quotes, heading marks and a closing colon."""
    return F.regexp_replace(F.regexp_replace(line, r"^(?:[#>*+\-\s]|\p{N}+[.)])+", ""), r"[:#\s]+$", "")


def label_only(content: Column, session: Column) -> Column:
    """Whether content is one line of at most 60 characters and four words that the session doesn't have."""
    line = stripped(content)
    needle = match_text(bare_line(line))
    return (line != "") & ~line.rlike(r"[\n\r]") & (F.length(line) <= 60) & (needle != "") & (F.size(F.split(needle, " ")) <= 4) & ~F.contains(match_text(session), needle)


def rendered_front_matter(fields: dict[str, str | list[str] | None], unknown: str = "", ending: str = "\n") -> str:
    """A block of id, created and tags, then the lines that nobody interprets, as they were."""

    def scalar(v: str) -> str:
        plain = re.fullmatch(r"[A-Za-z0-9_./:+ -]+", v) and v.strip() == v and not re.match(r"[-:?]|\d+$|true$|false$|null$", v, re.I) and ": " not in v and not v.endswith(":")
        return v if plain else json.dumps(v, ensure_ascii=False)

    lines = [RULE]
    for key in ("id", "created"):
        if fields.get(key):
            lines.append(f"{key}: {fields[key]}")
    if fields.get("tags"):
        lines.append("tags: [" + ", ".join(scalar(t) if "," not in t else json.dumps(t, ensure_ascii=False) for t in fields["tags"]) + "]")
    return ending.join([*lines, *[x for x in (unknown or "").splitlines() if x], RULE, ""])


@arrow_udf("string")
def front_matter_text(id_: pd.Series, created: pd.Series, tags: pd.Series, unknown: pd.Series) -> pd.Series:
    return pd.Series([rendered_front_matter({"id": i, "created": c, "tags": list(t) if t is not None else []}, u) for i, c, t, u in zip(id_, created, tags, unknown, strict=True)])


@arrow_udf("binary")
def half_floats(v: pd.Series) -> pd.Series:
    """Vectors as little-endian binary16."""
    return v.map(lambda x: np.asarray(x, "<f2").tobytes())


@arrow_udf("array<float>")
def from_half_floats(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: np.frombuffer(x, "<f2").astype(np.float32))


FENCE = r"^\s*(```|~~~)"


def fenced_body(text: str) -> str | None:
    """The lines between the first fence and the next of its kind; None without a fence or lines."""
    lines = text.split("\n")
    first = next((k for k, x in enumerate(lines) if re.match(FENCE, x)), None)
    if first is None:
        return None
    mark = lines[first].strip()[:3]
    end = next((k for k in range(first + 1, len(lines)) if lines[k].strip().startswith(mark)), len(lines))
    return "\n".join(lines[first + 1 : end]).strip() or None


def limited(text: str, lines: int) -> str:
    kept = text.split("\n")
    return text if len(kept) <= lines else "\n".join(kept[:lines]) + "\n…"


def verbatim(part: str, whole: str) -> bool:
    """Whether a text is in another one, indentation and blank lines aside."""
    plain = lambda t: "\n".join(x for x in (y.strip(" \t") for y in t.split("\n")) if x)
    return bool(plain(part)) and plain(part) in plain(whole)


def shown(kind: str, text: str, lines: int = 12) -> str:
    """What a card shows of a chunk: the code, without its context; of prose the first paragraph."""
    paragraphs = [p.strip() for p in text.strip().split("\n\n") if p.strip()]
    if kind == "code":
        body = fenced_body(text) or ("\n\n".join(text.split("\n\n")[1:]).strip() if "\n\n" in text else text.strip())
    else:
        body = paragraphs[0] if paragraphs else text.strip()
    return limited(body, lines)


@arrow_udf("string")
def card_snippet(kind: pd.Series, text: pd.Series, told: pd.Series) -> pd.Series:
    """What was told where it is verbatim in its chunk, else what the chunk itself shows."""
    return pd.Series([limited(r, 12) if isinstance(r, str) and r and verbatim(r, t) else shown(k, t) for k, t, r in zip(kind, text, told, strict=True)])
