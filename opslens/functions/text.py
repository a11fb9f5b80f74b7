"""Scalar text functions. Every function maps a Column to a Column and stays in the JVM."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from opslens import values as V

# The characters str.strip() removes, as one regex class and as one string.
SPACE_CLASS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Line ends of a text document, and line ends of a file read in text mode.
DOCUMENT_LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
FILE_LINE_END = r"\r\n|[\n\r]"
# Words of which every trace pattern needs at least one.
TRACE_WORDS = ["Traceback", "panic", "Error", "stack backtrace:", "Exception"]


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE_CHARS))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _lines(text: Column, line_end: str) -> Column:
    return bound(
        F.split(text, line_end),
        lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p),
    )


def document_lines(text: Column) -> Column:
    """Lines of a document; a closing line end opens no further line."""
    return _lines(text, DOCUMENT_LINE_END)


def file_lines(text: Column) -> Column:
    """Lines of a log file as a line reader yields them."""
    return _lines(text, FILE_LINE_END)


def tokens_floor(text: Column) -> Column:
    """Length / 4, rounded down; NULL counts as nothing."""
    return F.coalesce(F.floor(F.length(text) / V.CHARS_PER_TOKEN), F.lit(0)).cast("bigint")


def tokens_at_least_one(text: Column) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), tokens_floor(text))


def tokens(text: Column) -> Column:
    """0 for empty or NULL text, otherwise at least 1."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0).cast("bigint")).otherwise(tokens_at_least_one(text))


def slug(text: Column) -> Column:
    """CamelCase and any non-alphanumerics to lower-case words joined by single hyphens."""
    words = F.regexp_replace(text, "(?d)(.)([A-Z][a-z]+)", "$1-$2")
    words = F.lower(F.regexp_replace(words, "([a-z0-9])([A-Z])", "$1-$2"))
    return F.btrim(F.regexp_replace(words, "[^a-z0-9]+", "-"), F.lit("-"))


def stable_id(name: Column, signature: Column, line_number: Column) -> Column:
    """First hex characters of SHA-256 over ``name:signature:line``."""
    raw = F.concat_ws(
        ":",
        F.coalesce(name, F.lit("")),
        F.coalesce(signature, F.lit("")),
        F.coalesce(line_number, F.lit(0)).cast("string"),
    )
    return F.substring(F.sha2(raw, 256), 1, V.ID_HEX_CHARS)


def prefix(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def replace_in_order(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Apply plain-text (old, new) replacements one after the other, each on the result of the last."""
    for old, new in rules:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def replace_in_order_from(text: Column, rules: Column) -> Column:
    """As :func:`replace_in_order`, with the rules in an ``array<struct<old,new>>`` column."""
    return F.aggregate(rules, text, lambda done, rule: F.replace(done, rule["old"], rule["new"]))


def platform_rules(platform: str, folder: str) -> list[tuple[str, str]]:
    """Ordered replacements for one target platform: folder slot and mention first, then its tool names."""
    named = V.PLATFORM_RULES.get(platform.lower(), V.PLATFORM_RULES["default"])
    return [(V.FOLDER_SLOT, folder), (V.FOLDER_MENTION, folder), *named]


def fill_template(template: Column, slots: dict[str, Column]) -> Column:
    """Replace ``{{NAME}}`` slots in the given order; a NULL value becomes empty text."""
    for name, value in slots.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), F.coalesce(value.cast("string"), F.lit("")))
    return template


def numbered_list(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def term_list(terms: Column) -> Column:
    """``map<term, definition>`` as bullet lines."""
    return F.array_join(
        F.transform(F.map_entries(terms), lambda e: F.concat(F.lit("*   **"), e["key"], F.lit("**: "), e["value"])), "\n"
    )


def bold_list(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("*   **"), x, F.lit("**"))), "\n")


def any_pattern(patterns: Sequence[str], ignore_case: bool = False) -> str:
    """One alternation for several patterns, with Unicode word characters."""
    flags = "(?iuU)" if ignore_case else "(?U)"
    return flags + "|".join(f"(?:{p})" for p in patterns)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    hit = F.contains(text, F.lit(words[0]))
    for word in words[1:]:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def matches_trace(line: Column) -> Column:
    """The plain words come first: lines without any of them never reach the regex."""
    return F.coalesce(contains_any(line, TRACE_WORDS) & line.rlike(any_pattern(V.TRACE_PATTERNS)), F.lit(False))


def matches_call_site(line: Column) -> Column:
    return F.coalesce(F.startswith(F.ltrim(line, F.lit(SPACE_CHARS)), F.lit("at ")), F.lit(False))


def matches_vendor(line: Column) -> Column:
    return line.isNotNull() & contains_any(line, V.VENDOR_PATTERNS)


def matches_error(line: Column) -> Column:
    return line.isNotNull() & contains_any(line, V.ERROR_KEYWORDS)


def matches_failure(text: Column) -> Column:
    return F.coalesce(text.rlike(any_pattern(V.FAILURE_PATTERNS, ignore_case=True)), F.lit(False))


def needs_intake(text: Column) -> Column:
    """Long text, or text that carries log markers."""
    return F.coalesce((F.length(text) > V.INTAKE_CHARS) | contains_any(text, V.INTAKE_MARKERS), F.lit(False))


def has_placeholder(text: Column) -> Column:
    return F.coalesce(F.contains(text, F.lit(V.PLACEHOLDER_LEFT)), F.lit(False))


def first_error_lines(lines: Column) -> Column:
    """Lines kept around the first error of one log, given as an array.

    The first line that matches a trace pattern is kept with the lines after it; a call-site line that comes
    first is kept with the line before it; without either, the closing lines remain. All in one row, no shuffle.
    """

    def kept(clean: Column) -> Column:
        mark = lambda i, kind: F.struct(i.alias("i"), F.lit(kind).alias("kind"))
        marks = F.transform(
            clean,
            lambda line, i: F.when(matches_trace(line), mark(i, "t")).when(matches_call_site(line), mark(i, "c")),
        )
        return bound(F.array_min(marks), lambda first: around(clean, first))

    def around(clean: Column, first: Column) -> Column:
        at, call, size = first["i"] + 1, first["kind"] == "c", F.size(clean)
        tail = F.slice(clean, F.greatest(F.lit(1), size - V.TAIL_ROWS + 1), F.lit(V.TAIL_ROWS))
        return (
            F.when(first.isNull(), tail)
            .when(call & (at == 1), F.slice(clean, F.lit(1), F.lit(V.TRACE_ROWS - 1)))
            .otherwise(F.slice(clean, F.when(call, at - 1).otherwise(at), F.lit(V.TRACE_ROWS)))
        )

    return bound(F.transform(lines, rstrip), kept)


def prune_lines(lines: Column) -> Column:
    """Lines of one log without the vendor lines that follow an error line."""

    def kept(found: Column) -> Column:
        first = F.array_min(F.transform(found, lambda line, i: F.when(matches_error(line), i)))
        return bound(
            F.coalesce(first, F.lit(2**31 - 1)),
            lambda late: F.filter(found, lambda line, i: ~matches_vendor(line) | (i < late) | matches_error(line)),
        )

    return bound(lines, kept)
