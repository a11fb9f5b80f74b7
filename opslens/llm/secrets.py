"""Secrets by assignment-aware lexing.

A text is read as name-literal pairs. A target is a name, plain, quoted or as the last key of subscripts
(``os.environ["DB_PASSWORD"]``), with or without a type note (``password: str = ...``). An operator is ``:=``, ``=>``,
``=`` to ``===`` or ``:``. A value is a literal in single, double, triple or back quotes, inside brackets or not, a bare word, or
a sum of such parts. Behind a sensitive name the value may stand on the next line: after a backslash, in quotes or
brackets, or as an indented line of its own (``password: |``). Calls that set something (``set_password("...")``,
``putenv("DB_PASSWORD", "...")``) and elements (``<password>...</password>``) are pairs too.

Constants are propagated in a second pass: a bare word that is a name stands for the literal that was assigned to it last before
that place, or first after it, wherever that was written; the span is that of the literal. A pair's score is the sensitivity of its name, from the
words in it, times the strength of its literal, from its length, mix of characters and entropy. Placeholders, addresses
without a password in them and bare words that are no literals (``customer_identifier``) have no strength; names of something
about a secret (``auth_url``, ``primary_key``) are not sensitive.

The fixed base patterns are found beside the pairs and stay: ``assign``, ``access`` and ``hex``. A pair whose literal lies
inside a base span adds nothing and is left out; the others become spans of the kind ``pair``.
"""

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from opslens.llm.spans import SPANS, map_texts

# Fixed patterns, with the least length of the part that counts.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "pair")

NAME = r"[A-Za-z_$][A-Za-z0-9_$.-]*+"
KEY = r"\[[\x20\t]*+[\"'][^\"'\]\n]*+[\"'][\x20\t]*+\]"
TYPE = r"(?:[\x20\t]*+:[\x20\t]*+[A-Za-z_&*?][\w.<>\[\],|?&*\x20]{0,60}?(?=[\x20\t]++=(?![=>])|=[\"']))?"
HEAD = re.compile(rf"(?<![A-Za-z0-9_$.-])({NAME})((?:{KEY})*+)[\"']?{TYPE}[\x20\t]*+(:=|=>|={{1,3}}|:)")
LAST_KEY = re.compile(r"[\"']([^\"'\]\n]*)[\"'][\x20\t]*\]$")
QUOTED = (
    r"(?:[rbfuRBFU]{0,2}(?:\"\"\"((?:[^\"\\]|\\.|\"(?!\"\"))*+)\"\"\"|'''((?:[^'\\]|\\.|'(?!''))*+)'''"
    r"|\"(?!\"\")((?:[^\"\\\n]|\\.)*+)\"|'(?!'')((?:[^'\\\n]|\\.)*+)'|`([^`]*+)`))"
)
GROUPS = 5  # of QUOTED
STRING = re.compile(QUOTED, re.DOTALL)
BARE = re.compile(r"[^\x00-\x20\"'`,;(){}\[\]<>+]++")
SPACE = re.compile(r"[\x20\t]*+")
PLUS = re.compile(r"[\x20\t]*+\+[\x20\t]*+")
BRACKETS = re.compile(r"(?:[(\[{]\s*+){1,3}")
JOIN = re.compile(r"[\x20\t]*+(?:\\|[|>][+-]?)?[\x20\t]*+\r?\n[\x20\t]*+")
ALONE = re.compile(r"[\x20\t]*+\r?(?:\n|\Z)")
CALL = re.compile(rf"(?<![A-Za-z0-9_$.-])({NAME})\([\x20\t]*+{QUOTED}(?:[\x20\t]*+,[\x20\t]*+{QUOTED})?", re.DOTALL)
ELEMENT = re.compile(rf"<({NAME})(?:[\x20\t][^<>\n]*+)?>([^<>\n]++)</\1>")
OPERATOR = re.compile(r"[:=]")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
IDENTIFIER = re.compile(r"[A-Za-z_$.-]*+\Z")

#: How much a word in a name says that its value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "credential": 0.9, "credentials": 0.9,
    "apikey": 1.0, "token": 0.9, "bearer": 0.9, "private": 0.7, "auth": 0.7, "authorization": 0.8, "signing": 0.7,
    "encryption": 0.7, "access": 0.5, "session": 0.5, "salt": 0.5, "key": 0.5, "pin": 0.5, "dsn": 0.5,
}
#: Last words of names that hold something about a secret, and words before ``key`` that make it a key of another kind.
ABOUT = frozenset(
    "url uri path file filename dir name id type kind field column table host port endpoint header expiry expires ttl"
    " length size count hint policy label description prompt regex pattern format scope scopes enabled required".split()
)
OTHER_KEYS = frozenset("primary foreign public partition sort index cache row composite natural unique candidate shard".split())
SETTERS = frozenset("set put with add update change store setenv putenv configure define register use".split())
PLACEHOLDER = re.compile(
    r"(?i)^(?:null|none|nil|true|false|undefined|changeme|example|sample|placeholder|redacted|your[-_a-z]*|x+|\*+|\.+|-+|todo|\$\{.*|%.*%|<.*>)$"
)
ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^/@\s]*(/|\Z|\?|#)")
LEAST_LITERAL = 6
LEAST_SCORE = 0.3
#: A sum of constants can double with each line. Longer texts are carried as their character counts only.
MOST_TEXT = 4096


@dataclass(frozen=True)
class Literal:
    """A value: its characters by number, its text unless that is long, and where it was written."""

    counts: Counter
    text: str | None
    start: int
    end: int

    @classmethod
    def of(cls, text: str, start: int, end: int) -> "Literal":
        return cls(Counter(text), text if len(text) <= MOST_TEXT else None, start, end)

    def plus(self, other: "Literal") -> "Literal":
        text = None if self.text is None or other.text is None else self.text + other.text
        text = None if text is None or len(text) > MOST_TEXT else text
        return Literal(self.counts + other.counts, text, min(self.start, other.start), max(self.end, other.end))


@dataclass(frozen=True)
class Pair:
    """An assignment at ``at``: the parts of its value are literals or, if ``bare``, words that may be names.

    ``plain`` is true in the manner of configuration, ``name: word`` or ``NAME=word``, where a word is a literal.
    """

    name: str
    at: int
    parts: tuple[tuple[bool, str, int, int], ...]
    plain: bool = False


def name_score(name: str) -> float:
    """0 to 1: one minus the product of what the sensitive words in ``name`` leave open; 0 for names of other things."""
    words = [w.lower() for w in WORD.findall(name)]
    if not words or words[-1] in ABOUT:
        return 0.0
    left = 1.0
    for before, word in {(b if w == "key" else "", w) for b, w in zip(["", *words], words, strict=False)}:
        left *= 1.0 if before in OTHER_KEYS else 1 - SENSITIVE.get(word, 0.0)
    return 1 - left


def literal_score(literal: Literal | str) -> float:
    """0 to 1, from entropy and the mix of character classes; 0 for short literals, placeholders and plain addresses."""
    literal = Literal.of(literal, 0, 0) if isinstance(literal, str) else literal
    n = sum(literal.counts.values())
    if n < LEAST_LITERAL or literal.text is not None and (PLACEHOLDER.match(literal.text) or ADDRESS.match(literal.text)):
        return 0.0
    entropy = -sum(c / n * math.log2(c / n) for c in literal.counts.values())
    found = "".join(literal.counts)
    classes = sum(bool(re.search(p, found)) for p in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    return min(1.0, entropy / 4) * (0.4 + 0.2 * min(classes, 3))


def value_at(text: str, at: int, sensitive: bool, colon: bool) -> tuple[list[tuple[bool, str, int, int]], int]:
    """The parts of the value that begins at ``at``, and where it ends; no parts if none does."""
    at = SPACE.match(text, at).end()
    joined = JOIN.match(text, at) if sensitive else None
    if joined:
        indented = joined.end() > text.rfind("\n", at, joined.end()) + 1
        at = joined.end()
    opened = BRACKETS.match(text, at)
    at = opened.end() if opened else at
    parts: list[tuple[bool, str, int, int]] = []
    end = at
    while True:
        string = STRING.match(text, at)
        if string:
            group = string.lastindex
            parts.append((False, string[group], *string.span(group)))
        else:
            word = None if opened else BARE.match(text, at)
            if not word or joined and not (colon and indented and ALONE.match(text, word.end())):
                return parts, end
            parts.append((True, word[0], *word.span()))
        end = parts[-1][3] if parts[-1][0] else string.end()
        more = PLUS.match(text, end)
        if not more:
            return parts, end
        at = more.end()


def pairs(text: str) -> list[Pair]:
    """All assignments, in the order of their places."""
    found = []
    stop = 0
    while operator := OPERATOR.search(text, stop):
        at = max(text.rfind("\n", 0, operator.start()) + 1, stop)
        line = text.find("\n", operator.start())
        stop = line = len(text) if line < 0 else line
        while at < line and (head := HEAD.search(text, at, line)):
            key = LAST_KEY.search(head[2]) if head[2] else None
            name = key[1] if key else head[1]
            parts, end = value_at(text, head.end(), name_score(name) > 0, head[3] == ":")
            if parts:
                tight = head[3] == "=" and text[head.start(3) - 1] != " " and text[head.end() : head.end() + 1] != " "
                found.append(Pair(name, head.start(), tuple(parts), head[3] == ":" or tight))
            at = max(end, head.end())
        stop = max(stop, at)
    if '("' in text or "('" in text or "( " in text:
        found += [pair for call in CALL.finditer(text) for pair in called(call)]
    if "</" in text:
        found += [Pair(e[1], e.start(), ((False, e[2], *e.span(2)),)) for e in ELEMENT.finditer(text)]
    return sorted(found, key=lambda p: (p.at, p.parts[0][2]))


def called(call: re.Match) -> list[Pair]:
    """The pair of a call that sets something: name and first argument, or its first and second argument."""
    if not SETTERS & {w.lower() for w in WORD.findall(call[1])}:
        return []
    first = next(g for g in range(2, 2 + GROUPS) if call[g] is not None)
    second = next((g for g in range(2 + GROUPS, 2 + 2 * GROUPS) if call[g] is not None), None)
    name, group = (call[1], first) if second is None else (call[first], second)
    return [Pair(name, call.start(), ((False, call[group], *call.span(group)),))]


def values(found: list[Pair]) -> list[Literal | None]:
    """The value of each pair, with constants in the place of names; None where it is a word that is no literal."""
    named: dict[str, list[int]] = {}
    for i, pair in enumerate(found):
        named.setdefault(pair.name, []).append(i)
    known: dict[int, Literal | None] = {}

    def meant(word: str, i: int) -> int | None:
        """The assignment that gives ``word`` its value at pair ``i``: the last one before it, else the first one after."""
        places = named.get(word, [])
        k = bisect_left(places, i)
        if k:
            return places[k - 1]
        return next((j for j in places[k : k + 2] if j != i), None)

    for first in range(len(found)):
        stack, open_ = [first], set()
        while stack:
            i = stack[-1]
            if i in known:
                stack.pop()
                continue
            names = [meant(value, i) if bare else None for bare, value, _, _ in found[i].parts]
            needed = [j for j in names if j is not None and j not in known and j not in open_ and j != i]
            open_.add(i)
            if needed:
                stack.extend(needed)
                continue
            total: Literal | None = None
            literal = found[i].plain
            for j, (bare, value, start, end) in zip(names, found[i].parts, strict=True):
                constant = known.get(j) if j is not None else None
                literal = literal or constant is not None or not bare or not IDENTIFIER.match(value)
                part = constant or Literal.of(value, start, end)
                total = part if total is None else total.plus(part)
            known[i] = total if literal else None
            stack.pop()
    return [known[i] for i in range(len(found))]


def base_matches(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGNED]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def secret_spans(text: str) -> list[dict]:
    base = base_matches(text)
    spans = {(start, kind, end): (True, 1.0) for start, kind, end in base}
    starts, reach = [start for start, _, _ in base], list(accumulate((end for _, _, end in base), max))
    found = pairs(text)
    for pair, value in zip(found, values(found), strict=True):
        if value is None:
            continue
        score = name_score(pair.name) * literal_score(value)
        before = bisect_right(starts, value.start)
        if score >= LEAST_SCORE and not (before and value.end <= reach[before - 1]):
            place = value.start, 3, value.end
            spans[place] = (False, max(score, spans.get(place, (False, 0.0))[1]))
    return [
        {"kind": KINDS[kind], "start": start, "end": end, "base": is_base, "score": score}
        for (start, kind, end), (is_base, score) in sorted(spans.items())
    ]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, spans), one for each row of ``docs``.

    ``spans`` are (kind, start, end, base, score) in code points, end exclusive, by start and kind. A null or empty text
    has none; repeated rows stay repeated; other columns are not looked at; an empty table gives no rows.
    """
    found = map_texts(docs, id_col, text_col, lambda: lambda text: (secret_spans(text),), [T.StructField("spans", SPANS)])
    return found.withColumnRenamed("id", id_col)
