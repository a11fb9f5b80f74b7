"""Near-duplicates by simhash, searched with a Gray-order hierarchical index.

Fingerprints: the bitwise majority of the 64-bit hashes of a text's word shingles. Equal fingerprints count once from here
on. Two fingerprints with at most d differing bits agree in one of d + 1 bit fields, so each is placed in d + 1 buckets by
field and value. A bucket that more than ``BUCKET`` fingerprints share is split again by the fields of the remaining bits;
nothing is left out. In a bucket the fingerprints are sorted by Gray rank, which brings equal bit patterns together, and
form a tree: a node keeps the bits that all below it share and a mask of which bits those are. Pairs of nodes are compared
from the root down; their masked difference, which can only grow on the way, prunes whole groups above d.

Only the classes are wanted, so node pairs that are already in one class are skipped, a bucket reports one edge for each
fingerprint that it joins, and the edges of all buckets are joined into components by Spark.
"""

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.components import connected
from opslens.session import materialize, sized

SHINGLE = 4
DISTANCE = 4
SEED = 42
BUCKET = 4000
MOST_BROADCAST = 100_000
FANOUT = 16
PAIRS_AT_ONCE = 4096
ROWS_AT_ONCE = 100_000


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The simhash of a text; 0 without words."""
    words = text.encode().lower().split()  # lower() and split() on bytes know ASCII letters and white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0] + [e + 1 for e in ends[:-1]]
    last = ends[shingle - 1 :] or ends[-1:]
    return majority(np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, last, strict=False)], "<u8"))


def majority(hashed: np.ndarray) -> int:
    """The bits that over half of the 64-bit hashes have; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashed), ROWS_AT_ONCE):
        part = hashed[at : at + ROWS_AT_ONCE]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashed)).view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows (id, fingerprint), the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t.as_py() or "", shingle) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made)], names=["id", "fingerprint"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, fingerprint long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the sequence of Gray codes."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Join the classes of the pairs (a, b); labels are least members. True if any class changed."""
    changed = False
    while len(a):
        one, other = label[a], label[b]
        apart = one != other
        if not apart.any():
            break
        changed = True
        a, b, one, other = a[apart], b[apart], one[apart], other[apart]
        np.minimum.at(label, np.maximum(one, other), np.minimum(one, other))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped
    return changed


def forest(i: np.ndarray, j: np.ndarray, apart: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that join the same of ``count`` rows as all (i, j) do, without a circle, the nearest where there is a choice."""
    taken = joining(i, j, apart, count)
    return i[taken], j[taken], apart[taken]


def joining(i: np.ndarray, j: np.ndarray, apart: np.ndarray, count: int) -> np.ndarray:
    """Which of the pairs (i, j) make the forest."""
    label, chosen, rest = np.arange(count), [], np.arange(len(i))
    while True:
        rest = rest[label[i[rest]] != label[j[rest]]]
        if not len(rest):
            break
        ends, pair = np.r_[label[i[rest]], label[j[rest]]], np.r_[rest, rest]
        order = np.lexsort((pair, apart[pair], ends))
        ends, pair = ends[order], pair[order]
        least = np.unique(pair[np.r_[True, ends[1:] != ends[:-1]]])
        chosen.append(least)
        unite(label, i[least], j[least])
    return np.concatenate(chosen) if chosen else np.zeros(0, int)


class Level:
    """Nodes of one height: the bits that all codes below share, which bits these are, and the nodes' children."""

    def __init__(self, key: np.ndarray, low: np.ndarray, high: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        self.key, self.low, self.high, self.first, self.size = key, low, high, first, size
        self.shared = ~(low ^ high)

    def above(self) -> "Level":
        n = len(self.key)
        fresh = np.r_[True, self.key[1:] != self.key[:-1]]
        offset = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        first = np.flatnonzero(offset % FANOUT == 0)
        size = np.diff(np.r_[first, n])
        return Level(
            self.key[first], np.bitwise_and.reduceat(self.low, first), np.bitwise_or.reduceat(self.high, first), first, size
        )


def joined_classes(
    key: np.ndarray, code: np.ndarray, distance: int, links: list[tuple[np.ndarray, np.ndarray]] | None = None
) -> np.ndarray:
    """Class labels of codes that are sorted by key and Gray rank; links have one key and at most ``distance`` differing bits.

    Links that make the classes, one less than a class has members, are added to ``links`` if that is given.
    """
    n = len(code)
    label = np.arange(n)

    def unite_by(a: np.ndarray, b: np.ndarray) -> bool:
        if links is not None and len(a):
            taken = joining(label[a], label[b], np.bitwise_count(code[a] ^ code[b]), n)
            links.append((a[taken], b[taken]))
            a, b = links[-1]
        return unite(label, a, b)

    for lag in (1, 2, 3, 4):  # Gray neighbours first: classes that are known early prune the tree
        near = np.flatnonzero((key[lag:] == key[:-lag]) & (np.bitwise_count(code[lag:] ^ code[:-lag]) <= distance))
        unite_by(near, near + lag)
    levels = [Level(key, code, code, np.arange(n), np.ones(n, int))]
    while len(levels[-1].key) > len(np.unique(levels[-1].key)):
        levels.append(levels[-1].above())

    def bounds() -> list[tuple[np.ndarray, np.ndarray]]:
        """The least and greatest class of each node, by level."""
        out = [(label, label)]
        for level in levels[1:]:
            out.append((np.minimum.reduceat(out[-1][0], level.first), np.maximum.reduceat(out[-1][1], level.first)))
        return out

    classes = bounds()
    roots = np.arange(len(levels[-1].key))
    stack = [(len(levels) - 1, roots, roots)] if len(levels) > 1 else []
    while stack:
        height, a, b = stack.pop()
        if len(a) > PAIRS_AT_ONCE:
            stack.append((height, a[PAIRS_AT_ONCE:], b[PAIRS_AT_ONCE:]))
            a, b = a[:PAIRS_AT_ONCE], b[:PAIRS_AT_ONCE]
        above, level = levels[height], levels[height - 1]
        wide = above.size[b]
        each = above.size[a] * wide
        pair = np.repeat(np.arange(len(a)), each)
        inside = np.arange(len(pair)) - np.repeat(np.cumsum(each) - each, each)
        x, y = above.first[a][pair] + inside // wide[pair], above.first[b][pair] + inside % wide[pair]
        differing = np.bitwise_count((level.low[x] ^ level.low[y]) & level.shared[x] & level.shared[y])
        least, most = classes[height - 1]
        one_class = (least[x] == most[y]) & (most[x] == least[y]) & (least[x] == most[x])
        keep = (x <= y) & (differing <= distance) & ~one_class
        x, y = x[keep], y[keep]
        if height > 1:
            if len(x):
                stack.append((height - 1, x, y))
        elif unite_by(x, y):
            classes = bounds()
    return label


def bucket_edges(rows: DataFrame, distance: int, linked: bool = False) -> DataFrame:
    """Edges (a, b) that join the classes of every bucket; ``rows`` are (key, code), a bucket's rows lie together.

    An edge goes to the first of its class, or is a link of at most ``distance`` differing bits itself if ``linked``.
    """

    def edges(key: np.ndarray, code: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((gray_rank(code), key))
        key, code = key[order], code[order]
        links = [(np.zeros(0, int),) * 2]
        label = joined_classes(key, code, distance, links if linked else None)
        moved = np.flatnonzero(label != np.arange(len(label)))
        one, other = map(np.concatenate, zip(*links, strict=True)) if linked else (moved, label[moved])
        ends = [code[one].view(np.int64), code[other].view(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(e) for e in ends], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, codes, held = [], [], 0
        for batch in batches:
            keys.append(batch.column(0).to_numpy())
            codes.append(batch.column(1).to_numpy().view(np.uint64))
            held += len(keys[-1])
            if held < ROWS_AT_ONCE:
                continue
            key, code = np.concatenate(keys), np.concatenate(codes)
            whole = np.searchsorted(key, key[-1])  # the last bucket may go on in the next batch
            if whole:
                yield edges(key[:whole], code[:whole])
            keys, codes, held = [key[whole:]], [code[whole:]], 0
        if sum(map(len, keys)):
            yield edges(np.concatenate(keys), np.concatenate(codes))

    return rows.select("key", "code").mapInArrow(run, "a long, b long")


def bit_fields(code: Column, width: int, parts: int) -> list[tuple[int, int, Column]]:
    """(offset, bits, value) of each of ``parts`` fields of the low ``width`` bits."""
    borders = [width * i // parts for i in range(parts + 1)]
    return [
        (low, high - low, F.shiftrightunsigned(code, low).bitwiseAND((1 << (high - low)) - 1))
        for low, high in zip(borders, borders[1:], strict=False)
    ]


def without_field(code: Column, low: int, bits: int) -> Column:
    upper = F.shiftleft(F.shiftrightunsigned(code, low + bits), low) if low + bits < 64 else F.lit(0).cast("long")
    return upper.bitwiseOR(code.bitwiseAND((1 << low) - 1))


def buckets(codes: DataFrame, distance: int, most: int = BUCKET) -> DataFrame:
    """Rows (key, code): distinct ``codes`` in all buckets of their bit fields."""
    code = F.col("code")
    parts = distance + 1
    fields = bit_fields(code, 64, parts)
    placed = codes.select("code", F.explode(F.array(*[(value + (i << 32)).alias("b") for i, (_, _, value) in enumerate(fields)])).alias("bucket"))
    crowded = placed.groupBy("bucket").count().where(F.col("count") > most).select("bucket", F.lit(True).alias("crowded"))
    values = sum(1 << bits for _, bits, _ in fields)  # bounds the rows of crowded
    placed = placed.join(F.broadcast(crowded) if values <= MOST_BROADCAST else crowded, "bucket", "left")
    field = F.shiftright("bucket", 32)
    split = F.array(F.lit(-1).cast("long"))
    for i, (low, bits, _) in reversed(list(enumerate(fields))):
        rest = bit_fields(without_field(code, low, bits), 64 - bits, parts)
        split = F.when(field == i, F.array(*[value + (j << 32) for j, (_, _, value) in enumerate(rest)])).otherwise(split)
    inner = F.when(F.col("crowded"), split).otherwise(F.array(F.lit(-1).cast("long")))
    return placed.select("code", "bucket", F.explode(inner).alias("inner")).select(F.xxhash64("bucket", "inner").alias("key"), "code")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """Rows (id, fingerprint, component_id), one for each row of ``docs``.

    ``component_id`` is the least id that links of at most ``distance`` differing bits reach, the row's own included; null
    ids are passed over, so it is null only where no row of the component has one. A null or empty text, or one without words, has
    fingerprint 0 and is linked like any other. Repeated rows stay repeated; other columns are not looked at; an empty
    table gives no rows.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    codes = marked.groupBy(F.col("fingerprint").alias("code")).agg(F.min("id").alias("least"))
    codes = materialize(codes, "codes")
    placed = buckets(codes.select("code"), distance).repartition("key").sortWithinPartitions("key")
    roots = connected(bucket_edges(placed, distance)).withColumnRenamed("node", "code")
    rooted = codes.join(roots, "code", "left").withColumn("root", F.coalesce("root", "code"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    named = named.select(F.col("code").alias("fingerprint"), "component_id")
    return marked.join(named, "fingerprint").select(F.col("id").alias(id_col), "fingerprint", "component_id")


def keep_one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    find: Callable[..., DataFrame] = near_duplicates,
    **options: float,
) -> DataFrame:
    """The rows of ``docs`` with all columns, one for each component: that with the least id, then the least text hash.

    ``find`` gives the components.

    Of rows that repeat both one stays, the first by a hash of the whole row. Rows without an id cannot stand for
    others and stay as they are.
    """
    named = docs.where(F.col(id_col).isNotNull()).withColumn("__hash", F.xxhash64(text_col))
    keyed = named.select(F.struct(F.col(id_col).alias("id"), F.col("__hash").alias("hash")).alias("__key"), text_col)
    found = find(keyed, "__key", text_col, **options).groupBy("__key", "component_id").agg(F.count("*").alias("rows"))
    found = materialize(found, "found")
    key = [F.col("__key.id").alias(id_col), F.col("__key.hash").alias("__hash")]
    other = F.col("__key") != F.col("component_id")
    first = F.row_number().over(Window.partitionBy(id_col, "__hash").orderBy(F.xxhash64(*docs.columns)))
    # What goes is a smaller table than what stays, and rows are ranked only where some repeat as a whole.
    gone, _ = sized(found.where(other).select(key), "gone")
    kept = named.join(gone, [id_col, "__hash"], "left_anti")
    twice, _ = sized(found.where(~other & (F.col("rows") > 1)).select(key), "twice")
    if not twice.isEmpty():
        repeated = kept.join(twice, [id_col, "__hash"], "left_semi").withColumn("__row", first).where("__row = 1").drop("__row")
        kept = kept.join(twice, [id_col, "__hash"], "left_anti").unionByName(repeated)
    return kept.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
