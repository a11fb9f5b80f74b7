"""Document-corpus operators: shared lines, link payloads, bundles."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens import values as V
from opslens.functions.paths import basename, dirname, markdown_links, resolve
from opslens.functions.text import bound, document_lines, strip, tokens_at_least_one
from opslens.operators.ordered import row_numbers
from opslens.session import meet, sized

SLOTS = 1 << 24  # counters of a hash function; as bits at most 2 MB
SKETCH_ROWS = 2


def _line_counts(documents: DataFrame, text: str, min_len: int) -> DataFrame:
    """One row per document and distinct long line: the other columns, ``line`` and its ``occurrences``.

    A document is one row, so its lines are sorted and counted in place, without a shuffle.
    """
    clean = F.transform(document_lines(F.col(text)), strip)
    long_lines = F.sort_array(F.filter(clean, lambda line: F.length(line) > min_len))

    def runs(lines: Column) -> Column:
        firsts = F.array_compact(F.transform(lines, lambda line, i: F.when((i == 0) | (F.get(lines, i - 1) != line), i)))
        return bound(
            firsts,
            lambda at: F.transform(
                at,
                lambda first, j: F.struct(
                    F.get(lines, first).alias("line"),
                    (F.coalesce(F.get(at, j + 1), F.size(lines)) - first).cast("bigint").alias("occurrences"),
                ),
            ),
        )

    kept = [c for c in documents.columns if c != text]
    return documents.select(*kept, F.explode(bound(long_lines, runs)).alias("_l")).select(*kept, "_l.*")


def repeated_slots(lines: DataFrame, slots: int = SLOTS) -> DataFrame:
    """A count-min sketch of (line, occurrences) reduced to what a filter needs: (row, word, bits) of the counters above one.

    Each of ``SKETCH_ROWS`` hash functions gives a line one of ``slots`` counters. Tasks add up their own counters before the
    shuffle, which moves 16 bytes a counter and no text. The table has at most ``SKETCH_ROWS * slots / 64`` rows.
    """
    counters = lines.select(F.explode(_slots_of(F.col("line"), slots)).alias("_s"), "occurrences").groupBy("_s.row", "_s.slot")
    above = counters.agg(F.sum("occurrences").alias("n")).where("n > 1")
    bit = F.expr("shiftleft(1L, cast(slot & 63 AS int))")
    return above.groupBy("row", F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))


def _slots_of(line: Column, slots: int) -> Column:
    at = lambda row: F.pmod(F.xxhash64(F.lit(row), line), F.lit(slots).cast("bigint"))
    return F.array(*[F.struct(F.lit(row).alias("row"), at(row).alias("slot")) for row in range(SKETCH_ROWS)])


def may_repeat(lines: DataFrame, marks: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The rows of ``lines`` whose counters all are above one: every line that occurs twice, and few others."""
    columns = lines.columns
    lines = lines.withColumn("_slots", _slots_of(F.col("line"), slots))
    for row in range(SKETCH_ROWS):
        slot = F.col("_slots")[row]["slot"]
        words = marks.where(F.col("row") == row).select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
        set_ = F.expr("shiftright(_bits, cast(_slot & 63 AS int)) & 1") == 1
        lines = lines.withColumn("_slot", slot).withColumn("_word", F.shiftright(slot, 6)).join(words, "_word").where(set_)
        lines = lines.drop("_slot", "_word", "_bits")
    return lines.select(*columns)


def _repeated(documents: DataFrame, text: str, min_len: int, slots: int) -> DataFrame:
    """Lines of each document, with their ``occurrences`` in it, that may occur more than once in all."""
    lines = _line_counts(documents, text, min_len)
    marks, _ = sized(repeated_slots(lines, slots), "slots", limit=SKETCH_ROWS * slots // 64)
    return may_repeat(lines, marks, slots)


def line_redundancy(
    documents: DataFrame, text: str = "content", min_len: int = V.MIN_SHARED_LINE_CHARS, slots: int = SLOTS
) -> DataFrame:
    """Lines longer than ``min_len`` that occur more than once: (line, occurrences, documents).

    A first pass counts hashes (:func:`repeated_slots`), a second one counts the lines that are left by their text, so lines that
    occur once are read but not shuffled. A line found everywhere costs one row per task.
    """
    return _counted(_repeated(documents.select(text), text, min_len, slots))


def _counted(lines: DataFrame) -> DataFrame:
    counted = lines.groupBy("line").agg(F.sum("occurrences").alias("occurrences"), F.count("*").alias("documents"))
    return counted.where(F.col("occurrences") > 1)


def line_postings(
    documents: DataFrame, doc: str = "path", text: str = "content", min_len: int = V.MIN_SHARED_LINE_CHARS, slots: int = SLOTS
) -> DataFrame:
    """The inverted index of shared lines as rows (line, doc, occurrences), instead of a list per line.

    The shared lines are stored and measured. If they are few, they are broadcast and the documents are not shuffled; else
    only lines that may be shared are.
    """
    lines = _repeated(documents.select(doc, text), text, min_len, slots)
    shared, _ = sized(_counted(lines).select("line"), "shared")
    return lines.join(shared, "line", "left_semi")


def redundancy_summary(documents: DataFrame, text: str = "content", min_len: int = V.MIN_SHARED_LINE_CHARS) -> DataFrame:
    """One row: how many lines are redundant and how many files were scanned."""
    shared = line_redundancy(documents, text, min_len).agg(F.count("*").alias("redundant_lines"))
    return shared.withColumn("files", documents.agg(F.count("*")).scalar())


def token_counts(documents: DataFrame, doc: str = "path", text: str = "content", tokens=tokens_at_least_one) -> DataFrame:
    return documents.select(doc, tokens(F.col(text)).alias("tokens"))


def reference_payload(sizes: DataFrame, links: DataFrame, doc: str = "doc", target: str = "target") -> DataFrame:
    """Own tokens plus the tokens of every linked document, one hop deep: (doc, links, payload).

    ``sizes`` is (doc, tokens) with one row per document; ``links`` is (doc, target) and may repeat. Links to
    documents that do not exist add nothing. Links meet the sizes of their targets once and are summed per document
    with map-side combine; a target that very many documents link to is a skewed join side, which adaptive execution
    splits.
    """
    found = links.select(doc, target).join(sizes.select(F.col(doc).alias(target), F.col("tokens").alias("_t")), target)
    linked = found.groupBy(doc).agg(F.count("*").alias("links"), F.sum("_t").alias("_linked"))
    none = F.lit(0).cast("bigint")
    return sizes.join(linked, doc, "left").select(
        doc, F.coalesce("links", none).alias("links"), (F.col("tokens") + F.coalesce("_linked", none)).alias("payload")
    )


def markdown_reference_links(documents: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """Links (doc, target) to Markdown files, resolved against the folder of the document that holds them."""
    each = documents.select(F.col(path).alias("doc"), F.explode(markdown_links(F.col(text))).alias("_link"))
    folder = F.when(F.contains("doc", F.lit("/")), dirname(F.col("doc"))).otherwise(F.lit(""))
    return each.select("doc", resolve(folder, F.col("_link")).alias("target"))


def _part(name: Column, text: Column) -> Column:
    return F.concat(F.lit("=== "), F.upper(name), F.lit(" ===\n"), text)


def core_bundle(
    documents: DataFrame,
    key: Sequence[str],
    location: str | Column = "",
    path: str = "path",
    text: str = "content",
    names: Sequence[str] = tuple(V.CORE_DOCUMENTS),
) -> DataFrame:
    """The named core documents of each key, each under a header, in fixed order: (key, context).

    Only files directly in ``location`` (a folder relative to the root, or a column of ``documents``) count, so a path
    names at most one document of a key. Paths are compared first; texts of the few files that match are then joined
    by key. Keys without any core document give no row.
    """
    folder = F.lit(location) if isinstance(location, str) else location
    place = F.when(F.coalesce(folder, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.rtrim(folder, F.lit("/")), F.lit("/")))
    parts = [
        documents.where(F.col(path) == F.concat(place, F.lit(n))).select(*key, _part(F.lit(n), F.col(text)).alias(f"_p{i}"))
        for i, n in enumerate(names)
    ]
    held = reduce(DataFrame.unionByName, [part.select(*key) for part in parts]).distinct()
    joined = reduce(lambda left, part: meet(left, part, key, "left"), parts, held)
    return joined.select(*key, F.concat_ws("\n\n", *[F.col(f"_p{i}") for i in range(len(names))]).alias("context"))


def full_bundle(
    documents: DataFrame, key: Sequence[str], chunk: Column, path: str = "path", text: str = "content"
) -> DataFrame:
    """All Markdown documents of each key in path order: (key, part_no, part).

    A bundle has no size limit, so it stays in rows; joined by blank lines they are the context text.
    ``chunk`` must follow the order of ``path``.
    """
    wanted = documents.where(F.endswith(F.col(path), F.lit(V.DOCUMENT_SUFFIX)))
    numbered = row_numbers(wanted.select(*key, path, text), list(key), [path], chunk, "part_no")
    return numbered.select(*key, "part_no", _part(basename(F.col(path)), F.col(text)).alias("part"))


def in_first_location(
    documents: DataFrame, key: Sequence[str], candidates: Sequence[str], path: str = "path"
) -> DataFrame:
    """Documents of each key that lie under the first of its ``candidates`` folders that holds any file."""
    under = lambda folder: F.startswith(F.col(path), F.lit(folder.rstrip("/") + "/"))
    rank = F.coalesce(*[F.when(under(c), F.lit(i)) for i, c in enumerate(candidates)])
    ranked = documents.withColumn("_rank", rank).where(F.col("_rank").isNotNull())
    best, _ = sized(ranked.groupBy(*key).agg(F.min("_rank").alias("_rank")), "locations")
    return ranked.join(best, [*key, "_rank"], "left_semi").drop("_rank")
