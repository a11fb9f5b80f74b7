"""Include graphs: reachability and text expansion, in rounds that are stored in the shared folder.

Rounds double what is known: pairs or places at a distance of up to n give those of up to 2n, so a chain of d documents takes
log(d) rounds.

Tables of a round compress so well (names that count up, equal line numbers) that their size in files says little about
their size in memory. Joins of them are shuffled (``_joined``) and never left to a broadcast that goes by the files.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.paths import dirname, resolve
from opslens.functions.text import document_lines, strip
from opslens.operators.ordered import ranked_chunks, row_numbers, running_sums
from opslens.session import materialize, sized

HOT_LINES = 10_000


def _joined(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """A join by shuffle, whatever the sizes of the files."""
    return left.join(right.hint("merge"), on, how)


def _longer(near: DataFrame, far: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (root, node, depth) of a pair of ``near`` followed by one of ``far``, the least depth of each, without ``known``."""
    ends = far.select(F.col("root").alias("_mid"), F.col("node").alias("_end"), F.col("depth").alias("_more"))
    joined = _joined(near.withColumnRenamed("node", "_mid"), ends, "_mid").where(F.col("root") != F.col("_end"))
    least = joined.groupBy("root", F.col("_end").alias("node")).agg(F.min(F.col("depth") + F.col("_more")).alias("depth"))
    return _joined(least, known.select("root", "node"), ["root", "node"], "left_anti")


def _walks_on(walks: DataFrame, more: DataFrame) -> DataFrame:
    """Ends (src, dst) of walks that go on with one of ``more``."""
    on = more.select(F.col("src").alias("dst"), F.col("dst").alias("_end"))
    return materialize(_joined(walks, on, "dst").select("src", F.col("_end").alias("dst")).distinct(), "walks")


def include_closure(
    edges: DataFrame, roots: DataFrame, max_depth: int | None = None, src: str = "src", dst: str = "dst"
) -> DataFrame:
    """Everything each of ``roots`` (column ``root``) includes, directly or not: (root, node, depth), the smallest depth.

    Rounds double the distance. Where most documents are roots, a pair at a distance of n to 2n is one at exactly n followed
    by one of at most n, both pairs that are wanted themselves. Where few are, it is one of at most n followed by the ends of a walk
    of n steps from any document; the walks double as well. A root never includes itself.
    """
    links = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src <> dst").distinct()
    walks = materialize(links, "edges")
    wanted = materialize(roots.select(F.col("root").alias("src")).distinct(), "roots")
    sources = walks.select("src").distinct()
    many = 2 * _joined(sources, wanted, "src", "left_semi").count() >= sources.count()
    first = walks if many else _joined(walks, wanted, "src", "left_semi")
    last = materialize(first.select(F.col("src").alias("root"), F.col("dst").alias("node"), F.lit(1).alias("depth")), "pairs")
    levels, known, reach = [last], last, 1
    while not last.isEmpty() and (max_depth is None or reach < max_depth):
        if many:
            last = _longer(last.where(F.col("depth") == reach), known, known)
        else:
            steps = walks.select(F.col("src").alias("root"), F.col("dst").alias("node"), F.lit(reach).alias("depth"))
            last = _longer(known, steps, known)
        last = materialize(last, "pairs")
        levels.append(last)
        known = reduce(DataFrame.unionByName, levels)
        walks = walks if many else _walks_on(walks, walks)
        reach *= 2
    closure = _joined(known, wanted.withColumnRenamed("src", "root"), "root", "left_semi") if many else known
    return closure if max_depth is None else closure.where(F.col("depth") <= max_depth)


def _is_include(line):
    bare = strip(line)
    return F.startswith(bare, F.lit("@")) & ~F.startswith(bare, F.lit("@ "))


def _lines_of(documents: DataFrame, path: str, text: str) -> DataFrame:
    lines = document_lines(F.col(text))
    some = F.when(F.size(lines) > 0, lines).otherwise(F.array(F.lit("")))
    return documents.select(F.col(path).alias("path"), F.posexplode(some).alias("line_no", "line"))


def include_targets(documents: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """Include lines of each document: (path, line_no, line, target), resolved against the document's folder."""
    folder = F.when(F.contains("path", F.lit("/")), dirname(F.col("path"))).otherwise(F.lit(""))
    named = strip(F.substring(strip(F.col("line")), 2, 2**31 - 1))
    each = _lines_of(documents, path, text)
    return each.where(_is_include(F.col("line"))).withColumn("target", resolve(folder, named))


def circular(edges: DataFrame) -> DataFrame:
    """The documents (path) from which a circle of includes can be reached, over ``edges`` (src, dst) without self-includes.

    They are those with a walk as long as there are documents; walks double in length, as pairs of their ends.
    """
    walks = materialize(edges.select("src", "dst").distinct(), "edges")
    longest, most = 1, walks.select("src").distinct().count()
    while longest <= most and not walks.isEmpty():
        walks = _walks_on(walks, walks)
        longest *= 2
    return walks.select(F.col("src").alias("path")).distinct()


@dataclass(frozen=True)
class Positions:
    """How a position is written: that of a root itself, one followed by another, and how many includes lead there."""

    nowhere: Callable[[], Column]
    followed: Callable[[Column, Column], Column]
    depth: Callable[[Column], Column]


# All line numbers on the way: as long as the way is.
LINE_NUMBERS = Positions(lambda: F.array().cast("array<int>"), F.concat, F.size)
# Lines of the expanded text before the place, and the includes on the way: two numbers, however deep it is.
OFFSETS = Positions(
    lambda: F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(0).alias("level")),
    lambda a, b: F.struct((a["at"] + b["at"]).alias("at"), (a["level"] + b["level"]).alias("level")),
    lambda p: p["level"],
)


def _below(outer: DataFrame, inner: DataFrame, kind: Positions = LINE_NUMBERS) -> DataFrame:
    """Places (root, position, path) of ``outer`` followed by those of ``inner`` whose root is the path of the former."""
    inner = inner.select(F.col("root").alias("_mid"), F.col("position").alias("_rest"), F.col("path").alias("_end"))
    joined = _joined(outer.withColumnRenamed("path", "_mid"), inner, "_mid")
    return joined.select("root", kind.followed(F.col("position"), F.col("_rest")).alias("position"), F.col("_end").alias("path"))


def include_places(direct: DataFrame, starts: DataFrame | None, kind: Positions = LINE_NUMBERS) -> DataFrame:
    """All places below the ``starts`` (path; all documents if None) where a document is included, directly or not.

    ``direct`` are the include lines (root, position, path) of documents without circles. Each place is made once: one that is
    n to 2n levels deep is a place at most n deep, followed by one exactly n deep in the document that stands there.
    """
    steps = direct
    last = steps if starts is None else _joined(steps, starts.select(F.col("path").alias("root")).distinct(), "root", "left_semi")
    levels, reach = [materialize(last, "places")], 1
    while not levels[-1].isEmpty():
        levels.append(materialize(_below(reduce(DataFrame.unionByName, levels), steps, kind), "places"))
        reach *= 2
        steps = levels[-1].where(kind.depth(F.col("position")) == reach) if starts is None else materialize(_below(steps, steps, kind), "steps")
    return reduce(DataFrame.unionByName, levels)


def _lines_at(places: DataFrame, lines: DataFrame, includes: DataFrame, hot: int, kind: Positions = LINE_NUMBERS) -> DataFrame:
    """The ``lines`` (path, spot, line) of the document at each place: (root, position, line).

    Documents that more than ``hot`` lines include are no join key: their lines are broadcast, if they measure small.
    """
    at = lambda joined: joined.select("root", kind.followed(F.col("position"), F.col("spot")).alias("position"), "line")
    if includes.count() <= hot:  # then no document can have more
        return at(_joined(places, lines, "path"))
    names = includes.groupBy(F.col("target").alias("path")).count().where(F.col("count") > hot).select("path")
    names, few = sized(names.withColumn("_hot", F.lit(True)), "hot_names")
    hot_lines, small = sized(lines.join(names, "path").drop("_hot"), "hot_lines")
    if not (few and small):
        return at(_joined(places, lines, "path"))
    told = places.join(names, "path", "left")
    cold = _joined(told.where("_hot IS NULL"), lines, "path")
    return at(cold).unionByName(at(told.where("_hot").join(hot_lines, "path")))


def _summed(values: Column) -> Column:
    """A sum that is NULL where it, or one of the ``values``, leaves 64 bits."""
    return F.when(F.count(values) == F.count("*"), F.try_sum(values))


def expanded_sizes(linked: DataFrame) -> DataFrame:
    """(path, lines): how many lines each document without circles has when it is expanded.

    Sums over all walks of up to n includes give those of up to 2n. NULL for more than 64 bits can count.
    """
    sizes = materialize(linked.groupBy("path").agg(F.count_if(F.col("target").isNull()).alias("lines")), "sizes")
    walks = linked.where("target IS NOT NULL").groupBy(F.col("path").alias("src"), F.col("target").alias("dst"))
    walks = materialize(walks.agg(F.count("*").alias("times")), "walks")
    while not walks.isEmpty():
        ends = sizes.withColumnRenamed("path", "dst")
        more = _joined(walks, ends, "dst").select(F.col("src").alias("path"), F.try_multiply("times", "lines").alias("lines"))
        sizes = materialize(sizes.unionByName(more).groupBy("path").agg(_summed(F.col("lines")).alias("lines")), "sizes")
        on = walks.select(F.col("src").alias("dst"), F.col("dst").alias("_end"), F.col("times").alias("_more"))
        longer = _joined(walks, on, "dst").select("src", F.col("_end").alias("dst"), F.try_multiply("times", "_more").alias("times"))
        walks = materialize(longer.groupBy("src", "dst").agg(_summed(F.col("times")).alias("times")), "walks")
    return sizes


def _offsets(linked: DataFrame) -> DataFrame:
    """Lines of documents without circles with ``spot``, where each begins in its expanded document, for OFFSETS."""
    sizes = expanded_sizes(linked).select(F.col("path").alias("target"), F.col("lines").alias("_lines"))
    inner = _joined(linked.where("target IS NOT NULL"), sizes, "target").select(*linked.columns, "_lines")
    sized_lines = linked.where("target IS NULL").withColumn("_lines", F.lit(1).cast("bigint")).unionByName(inner)
    chunked = ranked_chunks(sized_lines, ["path"], ["line_no"])
    summed = running_sums(chunked, ["path"], ["line_no"], F.col("chunk"), {"_upto": F.col("_lines")})
    level = F.when(F.col("target").isNull(), 0).otherwise(1).alias("level")
    spot = F.struct((F.col("_upto") - F.col("_lines")).alias("at"), level)
    return materialize(summed.withColumn("spot", spot).drop("_lines", "_upto", "chunk"), "offsets")


def expand_includes(
    documents: DataFrame,
    path: str = "path",
    text: str = "content",
    roots: Column | None = None,
    hot: int = HOT_LINES,
    numbered: bool = False,
) -> DataFrame:
    """Text of every document with its includes replaced by the included text: (root, position, line).

    ``position`` is an array of line numbers that sorts the lines of a root. A line stays as it is if its target
    does not exist or is already open on the way from the root, so every chain ends, however deep it is. ``roots`` is a
    condition on the path column that says which documents to expand; all of them can be included.

    A position is as long as its line is deep, so those of a chain of n documents hold n * n / 2 numbers. ``numbered`` gives
    (root, at, level, line) instead: the number of the line in the expanded root, from 0, and of the includes that lead to it.
    Paths name one document each for this.

    First the places are found where a document stands in a root, as positions without text; lines then move once, to
    their places. What stands below a document from which no circle can be reached does not depend on the way to it: such places
    double in depth with each round (``include_places``) and are found once for a document that many include. Documents on the
    way to a circle are expanded from the root down, a level a round, with the path of open documents, and take the others as a
    whole. Lines never come together in one group.
    """
    each = _lines_of(documents, path, text)
    plain = each.where(~_is_include(F.col("line"))).withColumn("target", F.lit(None).cast("string"))
    there = documents.select(F.col(path).alias("target"), F.lit(True).alias("_there"))
    named = _joined(include_targets(documents, path, text), there, "target", "left")
    # A document is open in itself, so an include of its own stays a line.
    target = F.when(F.col("_there") & (F.col("target") != F.col("path")), F.col("target"))
    linked = materialize(plain.unionByName(named.select("path", "line_no", "line", target.alias("target"))), "linked")
    includes = linked.where("target IS NOT NULL")
    names = documents.select(F.col(path).alias("path"))
    wanted = names if roots is None else names.where(roots)
    rings = materialize(circular(includes.select(F.col("path").alias("src"), F.col("target").alias("dst"))), "rings")
    every = roots is None
    by_line = linked.withColumn("spot", F.array("line_no"))
    if not numbered:
        return _expanded(by_line, rings, wanted, every, hot, LINE_NUMBERS)
    calm = _offsets(_joined(linked, rings, "path", "left_anti"))
    lines = _expanded(calm, None, _joined(wanted, rings, "path", "left_anti"), every, hot, OFFSETS)
    lines = lines.select("root", "position.at", "position.level", "line")
    if rings.isEmpty():
        return lines
    # Which lines a document on the way to a circle has depends on the way to it, so these are counted when they are there.
    found = _expanded(by_line, rings, _joined(wanted, rings, "path", "left_semi"), False, hot, LINE_NUMBERS)
    found = row_numbers(materialize(found, "found"), ["root"], ["position"], F.element_at("position", 1), "at")
    return lines.unionByName(found.select("root", (F.col("at") - 1).alias("at"), (F.size("position") - 1).alias("level"), "line"))


def _expanded(spots: DataFrame, rings: DataFrame | None, wanted: DataFrame, every: bool, hot: int, kind: Positions) -> DataFrame:
    """(root, position, line) of the ``wanted`` documents, ``every`` one or some, by ``spots`` (path, line_no, line, target, spot)."""
    includes = spots.where("target IS NOT NULL")
    direct = includes.select(F.col("path").alias("root"), F.col("spot").alias("position"), F.col("target").alias("path"))
    if rings is None or rings.isEmpty():
        starts, entries, kept = wanted, None, []
    else:
        direct = _joined(direct, rings.select(F.col("path").alias("root")), "root", "left_anti")
        entries, kept = _from_rings(spots.drop("spot"), rings, wanted)
        wanted = _joined(wanted, rings, "path", "left_anti")
        starts = wanted.unionByName(entries.select("path"))
    places = include_places(direct, None if every else starts, kind)
    own = wanted.select(F.col("path").alias("root"), kind.nowhere().alias("position"), "path")
    mine = places if every else _joined(places, wanted.select(F.col("path").alias("root")), "root", "left_semi")
    found = own.unionByName(mine)
    if entries is not None:
        found = found.unionByName(entries).unionByName(_below(entries, places))
    lines = spots.where("target IS NULL").select("path", "spot", "line")
    return reduce(DataFrame.unionByName, [_lines_at(found, lines, includes, hot, kind), *kept])


def _from_rings(linked: DataFrame, rings: DataFrame, wanted: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Documents on the way to a circle from the root down: places (root, position, path) of the others, and lines in tables."""
    into = rings.select(F.col("path").alias("target"), F.lit(True).alias("_into"))
    lines = materialize(linked.join(rings, "path", "left_semi").join(into, "target", "left"), "ring_lines")
    roots = wanted.join(rings, "path", "left_semi")
    pending = roots.select(F.col("path").alias("root"), F.array().cast("array<int>").alias("position"), "path", F.array("path").alias("open"))
    places, kept = [], []
    while not pending.isEmpty():
        found = pending.join(lines, "path").withColumn("target", F.when(~F.array_contains("open", F.col("target")), F.col("target")))
        found = found.withColumn("position", F.array_append("position", F.col("line_no")))
        level = materialize(found.select("root", "position", "line", "target", "_into", "open"), "level")
        kept.append(level.where("target IS NULL").select("root", "position", "line"))
        met = level.where("target IS NOT NULL").withColumnRenamed("target", "path")
        places.append(met.where("_into IS NULL").select("root", "position", "path"))
        pending = met.where("_into").select("root", "position", "path", F.array_append("open", F.col("path")).alias("open"))
    nothing = pending.select("root", "position", "path")
    return reduce(DataFrame.unionByName, places, nothing), kept


def edge_table(documents: DataFrame, path: str = "path", text: str = "content") -> DataFrame:
    """Include edges (src, dst) between existing documents."""
    known = documents.select(F.col(path).alias("target"))
    found = include_targets(documents, path, text).join(known, "target", "left_semi")
    return found.select(F.col("path").alias("src"), F.col("target").alias("dst")).distinct()

