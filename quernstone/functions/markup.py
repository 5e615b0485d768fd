"""Styled spans of Markdown: sixteen kinds, by lines and within them. Places and lengths are in UTF-16 units.

Whether a line is code depends on the fences above it, so a text is walked from its first line to its last; within a
line, what is code has no other style, and what an earlier rule has taken is not looked at again.
"""

from __future__ import annotations

import re

import pandas as pd

from .udf import arrow_udf

KINDS = ("heading", "syntaxMarker", "bold", "italic", "boldItalic", "strikethrough", "inlineCode", "codeFence", "codeLanguage", "codeBlock", "listMarker", "taskMarker", "blockQuote", "thematicBreak", "link", "linkURL")
SPANS = "array<struct<kind: string, detail: string, start: int, length: int>>"
_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})[ \t]*([^\s`]*)")
_HEADING = re.compile(r" {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$")
_BREAK = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_QUOTE = re.compile(r" {0,3}((?:>[ \t]?)+)(.*)$")
_LIST = re.compile(r"[ \t]*([-*+]|\d{1,9}[.)])[ \t]+(\[[ xX]\](?=[ \t]|$))?")
_CODE = re.compile(r"(?<!`)(`+)(?!`)(.+?)(?<!`)\1(?!`)")
_LINK = re.compile(r"(?<!\\)\[([^\[\]\n]+)(\]\()([^()\s]*)(\))")
# opening and closing marks of each kind, the longest first
_MARKED = [("boldItalic", r"\*\*\*|___"), ("bold", r"\*\*|__"), ("strikethrough", "~~"), ("italic", r"\*|_")]
_STYLES = [(k, re.compile(rf"(?<!\\)(?<![\w*_~])({m})(?=\S)(.+?)(?<=\S)(?<!\\)\1(?![\w*_~])")) for k, m in _MARKED]


def _inline(line: str, at: int, out: list) -> None:
    """Spans within a line from ``at`` on."""
    taken = bytearray(len(line))

    def put(kind: str, a: int, b: int, detail: str | None = None) -> None:
        if b > a:
            out.append((kind, detail, a, b))

    for m in _CODE.finditer(line, at):
        put("syntaxMarker", m.start(), m.start(2))
        put("inlineCode", *m.span(2))
        put("syntaxMarker", m.end(2), m.end())
        taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    for m in _LINK.finditer(line, at):
        if not any(taken[m.start() : m.end()]):
            for kind, (a, b) in zip(("syntaxMarker", "link", "syntaxMarker", "linkURL", "syntaxMarker"), ((m.start(), m.start() + 1), m.span(1), m.span(2), m.span(3), m.span(4)), strict=True):
                put(kind, a, b)
            taken[m.end(1) : m.end()] = b"\1" * (m.end() - m.end(1))
    for kind, rule in _STYLES:
        for m in rule.finditer(line, at):
            marks = [*range(*m.span(1)), *range(m.end(2), m.end())]
            if not any(taken[k] for k in marks):
                put("syntaxMarker", *m.span(1))
                put(kind, *m.span(2))
                put("syntaxMarker", m.end(2), m.end())
                for k in marks:
                    taken[k] = 1


def styled(text: str | None) -> list[dict]:
    """All spans in order of place."""
    out: list[tuple[str, str | None, int, int]] = []
    fence, start = "", 0
    for raw in (text or "").split("\n"):
        line, found = raw.rstrip("\r"), []
        mark = _FENCE.match(line)
        if fence:
            if mark and mark[1][0] == fence[0] and len(mark[1]) >= len(fence) and not line[mark.end(1) :].strip():
                found, fence = [("codeFence", None, 0, len(line))], ""
            elif line:
                found = [("codeBlock", None, 0, len(line))]
        elif mark and not (mark[1][0] == "`" and "`" in line[mark.end(1) :]):
            fence = mark[1]
            found = [("codeFence", None, 0, len(line))] + ([("codeLanguage", mark[2], *mark.span(2))] if mark[2] else [])
        elif m := _BREAK.match(line):
            found = [("thematicBreak", None, 0, len(line))]
        elif m := _HEADING.match(line):
            found = [("syntaxMarker", None, *m.span(1)), ("heading", str(len(m[1])), *m.span(2))]
            _inline(line, m.start(2), found)
        else:
            at = 0
            if m := _QUOTE.match(line):
                found = [("syntaxMarker", None, *m.span(1)), ("blockQuote", None, *m.span(2))]
                at = m.start(2)
            if m := _LIST.match(line, at):
                found.append(("listMarker", None, *m.span(1)))
                at = m.end(1)
                if m[2]:
                    found.append(("taskMarker", "checked" if m[2][1] in "xX" else "open", *m.span(2)))
                    at = m.end(2)
            _inline(line, at, found)
        out += [(k, d, start + a, start + b) for k, d, a, b in found if b > a]
        start += len(raw) + 1
    # code points to UTF-16 units
    wide = [k for k, c in enumerate(text or "") if ord(c) > 0xFFFF]
    if wide:
        from bisect import bisect_left

        shift = lambda k: k + bisect_left(wide, k)
        out = [(k, d, shift(a), shift(b)) for k, d, a, b in out]
    return [{"kind": k, "detail": d, "start": a, "length": b - a} for k, d, a, b in sorted(out, key=lambda s: (s[2], -s[3]))]


@arrow_udf(SPANS)
def markdown_spans(text: pd.Series) -> pd.Series:
    return text.map(styled)
