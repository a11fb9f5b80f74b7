"""Path and link functions on ``/``-separated paths."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from opslens import values as V

LINK_PATTERN = r"(?d)\[.*?\]\((.*?\.md)\)"  # Fixed value: a link to a Markdown file.


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last ``/`` without closing slashes; a path of slashes only stays."""
    head = F.regexp_extract(path, "^(.*/)?[^/]*$", 1)
    bare = F.rtrim(head, F.lit("/"))
    return F.when(bare == "", head).otherwise(bare)


def depth(path: Column) -> Column:
    """Number of folders above the file in a relative path."""
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def extension(path: Column) -> Column:
    """Suffix with its dot, empty if there is none; leading dots belong to the name."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def normalize(path: Column) -> Column:
    """Resolve ``.``, ``..`` and repeated slashes without looking at any file system."""
    rooted = F.startswith(path, F.lit("/"))
    last = lambda done: F.element_at(F.concat(F.array(F.lit("")), done), -1)
    kept = F.aggregate(
        F.filter(F.split(path, "/"), lambda s: (s != "") & (s != ".")),
        F.array().cast("array<string>"),
        lambda done, s: F.when(s != "..", F.array_append(done, s))
        .when((F.size(done) > 0) & (last(done) != ".."), F.slice(done, F.lit(1), F.size(done) - 1))
        .when(rooted, done)
        .otherwise(F.array_append(done, s)),
    )
    joined = F.array_join(kept, "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def resolve(base_folder: Column, link: Column) -> Column:
    """Target of ``link`` as seen from ``base_folder``."""
    return normalize(
        F.when(F.startswith(link, F.lit("/")) | (base_folder == ""), link).otherwise(F.concat_ws("/", base_folder, link))
    )


def markdown_links(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LINK_PATTERN), F.lit(1))


def has_suffix(path: Column, suffixes: Sequence[str] = tuple(V.TEMPLATE_SUFFIXES)) -> Column:
    hit = F.endswith(path, F.lit(suffixes[0]))
    for suffix in suffixes[1:]:
        hit = hit | F.endswith(path, F.lit(suffix))
    return hit


def is_ignored(path: Column) -> Column:
    """True if any segment is on the ignore list or ends like a log file."""
    return F.exists(
        F.split(path, "/"), lambda s: s.isin(*V.IGNORED_NAMES) | F.endswith(s, F.lit(V.IGNORED_SUFFIX))
    )
