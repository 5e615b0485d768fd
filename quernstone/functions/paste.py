"""What a pasted text is: plain, a shell command, or code in some language.

Evidence in order: what rules an offer out, a prompt mark, prose, real JSON and YAML, command lines, then weighted signs of
languages by line. A guess on prose is the costly mistake, so prose is looked for before anything is guessed.
"""

from __future__ import annotations

import json
import re

import pandas as pd

from .stopwords import SEARCHED
from .udf import arrow_udf

#: UTF-16 units from which a paste is a document and no snippet; words of a command line at most; letters of a key;
#: characters of a line that may bear signs of a language.
DOCUMENT, MOST_WORDS, MOST_KEY, MOST_LINE = 200_000, 24, 64, 2_000
#: Fixed names of pasteboard types: those of files, links and pictures, and those of source code.
NOT_TEXT = {"public.file-url", "NSFilenamesPboardType", "public.url", "public.png", "public.tiff", "public.jpeg", "com.apple.pasteboard.promised-file-url"}
SOURCE = {"public.source-code", "public.shell-script", "public.python-script", "public.c-source", "public.objective-c-source", "public.swift-source"}
#: Commands by what they do.
FILES = "cat cd chmod chown cp df du find head less ln ls mkdir mv rm rmdir stat tail tar touch tree unzip zip"
TEXTS = "awk cut diff echo grep jq printf rg sed sort tee tr uniq wc xargs"
NETWORK = "curl dig host nc netstat ping rsync scp sftp ssh wget"
SYSTEM = "apt apt-get brew crontab dnf env export journalctl kill killall lsof man mount pacman ps service source sudo systemctl top which yum"
BUILD = "bazel bundle bun cargo cmake deno docker docker-compose gh git go gradle helm java javac kubectl make mvn node npm npx pip pip3 pnpm podman poetry python python3 ruby rustc swift terraform uv vagrant yarn"
DATA = "aws az gcloud mongo mysql psql redis-cli sqlite3"
SHELLS = "bash fish sh vim nano zsh"
COMMANDS = frozenset(" ".join((FILES, TEXTS, NETWORK, SYSTEM, BUILD, DATA, SHELLS)).split())
_STOP = frozenset(SEARCHED)

_PROMPT = re.compile(r"[ \t]*[$%] +(?=[^\s]*[^\W\d_])([\w./-]{2,})(?= |$)")
_CODE_MARKS = re.compile(r"[|;{}=$\t]|&&")
_NAME = re.compile(r"(?=[^:]*[^\W\d_])[\w.-]+$")
_ASSIGNED = re.compile(r"[A-Za-z_]\w*=\S*$")
_OPTION = re.compile(r"--?[A-Za-z]|[|<>&/~$*=.:@\"']|\d")

#: (language, weight, pattern of a line); a language needs the weight of BAR, or of one less where the source says code.
SIGNS = [
    ("sql", 3, r"(?i)^\s*(select\b.+\bfrom|insert\s+into|update\s+\S+\s+set|delete\s+from|create\s+(table|view|index)|alter\s+table|drop\s+table|with\s+\w+\s+as\s*\()"),
    ("sql", 1, r"(?i)^\s*(from|where|group\s+by|order\s+by|having|limit|(left |inner |outer )?join)\s+\S+"),
    ("python", 2, r"^\s*(async\s+def|def|class)\s+\w+.*:\s*(#.*)?$"), ("python", 2, r"^\s*(from\s+[\w.]+\s+import\s+\S|import\s+[\w.]+(\s+as\s+\w+)?\s*$)"),
    ("python", 1, r"^\s*(if|elif|for|while|with|try|except)\b.*:\s*$|^\s*(print|self\.\w+)\s*[(=]|^\s*@\w+|\bNone\b|\blambda\b|^\s+(return|yield|raise)\b|^\s+pass$"),
    ("swift", 2, r"^\s*((public|private|internal|static|final)\s+)*(func\s+\w+.*\{|struct\s+\w+.*\{|extension\s+\w+)|\bguard\s+let\b"), ("swift", 1, r"^\s*(let|var)\s+\w+\s*(:\s*[A-Z]\w*)?\s*=|->\s*[A-Z]\w*"),
    ("javascript", 2, r"^\s*(export\s+)?(async\s+)?function\b.*\(|=>\s*[\{(]|^\s*(const|let)\s+[\w{\[].*=.*;\s*$|\bconsole\.log\("), ("javascript", 1, r"^\s*(const|let|var)\s+\w+\s*=|\brequire\(|==="),
    ("rust", 2, r"^\s*(pub\s+)?fn\s+\w+|\blet\s+mut\b|^\s*impl\b.*\{|^\s*use\s+\w+::"), ("go", 2, r"^\s*func\s+(\(\w+ \*?\w+\)\s*)?\w+\(.*\{|^package\s+\w+$|:=\s*\S"),
    ("c", 2, r"^\s*#\s*include\s*[<\"]|^\s*(int|void|char|static|const|double|float|unsigned)\s+\*?\w+\s*\(.*[{;]\s*$"), ("c", 1, r"^\s*(int|char|double|float)\s+\*?\w+\s*(=|;|\[)"),
    ("java", 2, r"^\s*(public|private|protected)\s+(static\s+)?(class|void|int|String|\w+<)\b|\bSystem\.out\."), ("ruby", 2, r"^\s*(def\s+\w+[^:]*$|require\s+['\"]|puts\s+\S)"), ("ruby", 1, r"^\s*end\s*$"),
    ("html", 3, r"^\s*<(!doctype|html|div|span|p|a|ul|li|table|head|body|script|img)\b[^>]*>"), ("css", 2, r"^\s*[.#]?[\w-]++([\s,>]++[.#]?[\w-]++)*+\s*\{\s*$|^\s*[\w-]+:\s*[^;]+;\s*$"),
    ("", 1, r"[;{}]\s*$"), ("", 1, r"^\s*(return|if|for|while|else|switch|case)\b.*[({;]"), ("", 1, r"\b\w++\([^)]*+\)\s*[;{]?\s*$|^\s*(//|/\*|\*/)"), ("", 1, r"^\s*\w[\w.\[\]]*\s*(=|\+=|-=|:=)\s*\S"),
]
BAR = 3
_SIGNS = [(language, weight, re.compile(p)) for language, weight, p in SIGNS]


def prose(line: str) -> bool:
    """Four words and more without a mark of code, an option or a path, and two words that only sentences have, or one
    in a sentence of six words with its end."""
    line = line.strip()
    words = line.split()
    if _CODE_MARKS.search(line) or len(words) < 4 or any(w[0] == "-" and len(w) > 1 or "/" in w and "://" not in w for w in words):
        return False
    said = sum(w.lower().strip(".,:!?\"'") in _STOP for w in words)
    return said > 1 or said == 1 and len(words) > 5 and line[-1] in ".!?"


def is_json(text: str) -> bool:
    """An object or a list that parses, of more than a few characters."""
    if len(text) <= 6 or text[0] + text[-1] not in ("{}", "[]"):
        return False
    try:
        return isinstance(json.loads(text), (dict, list))
    except (ValueError, RecursionError):
        return False


def mapping(line: str) -> bool:
    """``key:`` or ``key: value``, also as a list's item."""
    key, colon, value = re.sub(r"^(- )+", "", line.strip()).partition(":")
    return bool(colon) and len(key) <= MOST_KEY and _NAME.match(key) is not None and (not value or value[0] == " ")


def is_yaml(lines: list[str]) -> bool:
    """Two lines and more, each a mapping, an item or a comment, at least one a mapping, none deeper than a value allows,
    none after a scalar that closes its level."""
    if len(lines) < 2 or not any(mapping(x) for x in lines):
        return False
    opened, may_deepen = [], True
    for x in lines:
        line = x.strip()
        if line[0] == "#" or line == "---":
            continue
        if not (mapping(x) or line.startswith("- ") or line == "-") or "\t" in x[: len(x) - len(x.lstrip())]:
            return False
        indent = len(x) - len(x.lstrip())
        while opened and opened[-1] > indent:
            opened.pop()
        if not opened or opened[-1] < indent:
            if opened and not may_deepen:
                return False
            opened.append(indent)
        value = re.sub(r"^(- )+", "", line)
        may_deepen = line[0] == "-" or value.endswith(":") or value.endswith((": |", ": >"))
    return True


def command(line: str) -> bool:
    """A known command or an executable's path with an argument that isn't a plain sentence's."""
    words, assigned = line.split(), False
    while len(words) > 1 and (words[0] in ("sudo", "env", "time") or _ASSIGNED.match(words[0])):
        assigned = assigned or "=" in words[0]
        words = words[1:]
    if not words or len(words) > MOST_WORDS or len(words) < 2 and not assigned:
        return False
    head, rest = words[0], words[1:]
    if len(head) > 2 and (head.startswith(("./", "/", "~/")) or assigned and "/" in head):
        return True
    if head not in COMMANDS:
        return False
    return bool(_OPTION.search(" ".join(rest))) or len(rest) < 4 and not any(w.lower() in _STOP for w in rest) and not line.rstrip().endswith((".", "!", "?"))


def carries_on(line: str, before: str) -> bool:
    """The rest of a command: what a backslash or a pipe leads to, options on their own, or a comment."""
    text = line.strip()
    return before.rstrip().endswith(("\\", "|", "&&")) or text.startswith(("|", "&&", "--", "#")) or re.match(r"-\w", text) is not None


def language(lines: list[str], told: bool = False) -> str | None:
    """The language with the most evidence, '' for code of none in particular, None for too little. A line counts for a
    language by its strongest sign, two equal lines once."""
    score: dict[str, int] = {}
    for line in dict.fromkeys(x for x in lines if len(x) <= MOST_LINE):
        best: dict[str, int] = {}
        for name, weight, sign in _SIGNS:
            if sign.search(line):
                best[name] = max(best.get(name, 0), weight)
        for name, weight in best.items():
            score[name] = score.get(name, 0) + weight
    general = score.pop("", 0)
    bar = BAR - told
    if score:
        name = max(score, key=lambda k: (score[k], -[s[0] for s in SIGNS].index(k)))
        if score[name] + min(general, 2) >= bar and score[name] > 1:
            return name
    return "" if general >= bar + 1 - told else None


def pasted(text: str | None, types: tuple[str, ...] = ()) -> tuple[str, str | None]:
    """(kind, language): kind is plain, shell or code. types: what a pasteboard says that it holds."""
    flat = (text or "").strip()
    if not flat or NOT_TEXT & set(types) or "```" in flat or "~~~" in flat or len(flat) > DOCUMENT or not flat.isascii() and len(flat.encode("utf-16-le")) > 2 * DOCUMENT:
        return "plain", None
    lines = [x for x in flat.split("\n") if x.strip()]
    if any(_PROMPT.match(x) for x in lines):
        return "shell", "bash"
    if 2 * sum(map(prose, lines)) >= len(lines):
        return "plain", None
    if is_json(flat):
        return "code", "json"
    if is_yaml(lines):
        return "code", "yaml"
    if any(map(command, lines)) and all(command(x) or k and carries_on(x, lines[k - 1]) for k, x in enumerate(lines)):
        return "shell", "bash"
    found = language(lines, bool(SOURCE & set(types)))
    return ("plain", None) if found is None else ("code", found or None)


KIND = "struct<kind: string, language: string>"


@arrow_udf(KIND)
def classified(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([pasted(t) for t in text], columns=["kind", "language"])
