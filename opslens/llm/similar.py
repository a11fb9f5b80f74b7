"""Near-duplicates by the exact Jaccard likeness of word shingles, found with the simhash index and completed by prefixes.

First the Gray-order index of :mod:`opslens.llm.simhash` gives candidates: sets whose fingerprints differ in at most
``DISTANCE`` bits. They are verified on the whole sets. A fingerprint of 64 bits does not see every pair of a likeness of 0.8, so the
prefix filter below finds the pairs that are left, and only those between sets that the index has not joined are verified.

A text's set holds the 64-bit hashes of its shingles; equal sets count once from here on. Large sets are cut into pieces of
``PIECE`` to four times as many hashes by the leading bits of the hashes: if two sets have a likeness of at least t, some piece of
the one has it with the same piece of the other. A set so small that its partner may be cut more coarsely is cut both ways.

Two pieces with a likeness of at least t share one of the first n - ceil(t * n) + 1 of their n shingles in any order that all
follow (prefix filter), so each piece is placed in the buckets of these shingles only, and no pair is lost. The order puts
shingles that are common in a sample last, which keeps buckets small; it has no influence on the result. Places whose
shingle no other set has are dropped before anything else is done with them; of shingles that the sample names this is
known beforehand. A bucket of more than ``CROWD`` sets is cut into parts that meet two by two.

In a bucket the pieces are held against each other by size, place and sketch, the parities of the numbers of hashes in ``BINS``
bins: each bin whose parities differ holds a hash that only one of the sets has, so sketches too far apart rule a pair out. Of
the pairs that are left a bucket reports a forest only, which joins all that they join, the nearest first: no bucket reports
more pairs than it has sets. Each reported pair is verified on the whole sets: first the nearest of every set, then those that
are not joined by then. Where pairs of a forest turn out to be unlike, the buckets around them are looked at again, and all
pairs that are still apart are verified.
"""

import math
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.llm.components import connected
from opslens.llm.simhash import bucket_edges, buckets, forest, majority
from opslens.llm.spans import slices
from opslens.session import materialize, scratch, sized

SHINGLE = 5
LIKENESS = 0.8
DISTANCE = 6
SEED = 42
SAMPLE = 5000
BINS = 512
WORDS = BINS // 64
CROWD = 4000
PIECE = 150
SALTS = 32
MOST_COMMON = 50_000
MOST_SEEN = 1_000_000
ROWS_AT_ONCE = 100_000
MOST_PAIRS = 2_000_000
CLOSE = 1e-9
SKETCH = [f"s{k}" for k in range(WORDS)]
LISTS = ["sizes", "sketch", "rare", "rare_at", "common", "common_at"]
LEVEL = 0x1E3779B97F4A7C15  # keeps the shingles of one level apart from those of another


def shingle_set(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.encode().lower().split()  # lower() and split() on bytes know ASCII letters and white space only
    if not words:
        return np.zeros(0, np.int64)
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
    starts = [0] + [e + 1 for e in ends[:-1]]
    last = ends[shingle - 1 :] or ends[-1:]
    hashed = [xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, last, strict=False)]
    return np.unique(np.array(hashed, np.uint64).view(np.int64))


def sketch(found: np.ndarray) -> np.ndarray:
    odd = np.bincount(found & (BINS - 1), minlength=BINS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def prefix_length(size: int, likeness: float) -> int:
    return size - math.ceil(likeness * size - CLOSE) + 1 if size else 0


def common_shingles(docs: DataFrame, text_col: str, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, sorted, and how many do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0)):
            found = np.concatenate([shingle_set(t.as_py() or "", shingle) for t in batch.column(0)])
            yield pa.RecordBatch.from_arrays([pa.array(found)], names=["token"])

    rows = docs.count()
    texts = docs.select(F.col(text_col).cast("string").alias("text")).sample(min(1.0, SAMPLE / max(rows, 1)), seed=SEED)
    counts = texts.mapInArrow(run, "token long").groupBy("token").count().where("count > 2")
    found = sorted((r["token"], r["count"]) for r in counts.orderBy(F.desc("count"), "token").limit(MOST_COMMON).collect())
    return np.array([t for t, _ in found], np.int64), np.array([n for _, n in found], np.int64)


def pieces(found: np.ndarray, likeness: float) -> list[tuple[int, np.ndarray]]:
    """(level, hashes) of the pieces of a set: at level c it is cut by the leading 2 * c bits of the hashes."""
    n = len(found)
    level = max(0, math.floor(math.log(n / PIECE, 4) + CLOSE)) if n else 0
    cuts = [level, level - 1] if level and likeness * n - CLOSE < PIECE * 4**level else [level]
    cut = []
    for c in cuts:
        at = (found.view(np.uint64) >> np.uint64(64 - 2 * c)).astype(np.int64) if c else np.zeros(n, np.int64)
        order = np.argsort(at, kind="stable")
        borders = np.flatnonzero(np.diff(at[order])) + 1
        cut += [(c, part) for part in np.split(found[order], borders) if len(part)]
    return cut


def marked_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, likeness: float) -> DataFrame:
    """Rows (id, code, fingerprint, sizes, sketch, rare, rare_at, common, common_at): the number of each text's set, and its pieces.

    ``fingerprint`` is the simhash of the set. ``sizes`` and ``sketch`` (``WORDS`` numbers each) are of the pieces, the others the shingles of their prefixes and where these
    are, piece << 32 | place, apart by whether the sample has them. All but the
    number are null where the task has seen the set before.
    """
    tokens, counts = common_shingles(docs, text_col, shingle)

    def prefix(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = np.zeros(len(found), np.int64)
        if len(tokens):
            at = np.minimum(np.searchsorted(tokens, found), len(tokens) - 1)
            held = np.where(tokens[at] == found, counts[at], 0)
        first = np.lexsort((found, held))[: prefix_length(len(found), likeness)]
        return found[first], held[first] > 0

    def lists(found: np.ndarray) -> list[np.ndarray]:
        sizes, sketches, tokens_, places, known = [], [], [], [], []
        for k, (level, piece) in enumerate(pieces(found, likeness)):
            first, common = prefix(piece)
            sizes.append(len(piece))
            sketches.append(sketch(piece))
            tokens_.append(first ^ np.int64(level * LEVEL % (1 << 63)))
            places.append((k << 32) + np.arange(len(first)))
            known.append(common)
        if not sizes:
            return [np.zeros(0, np.int64)] * 6
        token, place, common = np.concatenate(tokens_), np.concatenate(places), np.concatenate(known)
        return [np.array(sizes), np.concatenate(sketches), token[~common], place[~common], token[common], place[common]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            codes, marks, held = [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py() or "", shingle)
                code = xxhash.xxh64_intdigest(found.tobytes(), SEED)
                codes.append(code)
                marks.append(None if code in seen else int(np.uint64(majority(found)).view(np.int64)))
                held.append([None] * len(LISTS) if code in seen else lists(found))
                if len(seen) >= MOST_SEEN:
                    seen.clear()
                seen.add(code)
            arrays = [pa.array(np.array(codes, np.uint64).view(np.int64)), pa.array(marks, pa.int64())]
            arrays += [pa.array(list(column), pa.list_(pa.int64())) for column in zip(*held, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["id", "code", "fingerprint", *LISTS])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, code long, fingerprint long, " + ", ".join(f"{n} array<long>" for n in LISTS))


def index_links(fresh: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b), a before b, of ``fresh`` sets (code, fingerprint) whose fingerprints differ in at most ``distance`` bits.

    They join all sets that such pairs join: equal fingerprints by their least codes, others by links of the Gray-order index.
    """
    own = fresh.select("code", "fingerprint", F.pmod("code", F.lit(SALTS)).alias("salt"))
    heads = materialize(own.groupBy("fingerprint", "salt").agg(F.min("code").alias("head")), "heads")
    tops = materialize(heads.groupBy("fingerprint").agg(F.min("head").alias("top")), "tops")
    dealt = buckets(tops.select(F.col("fingerprint").alias("code")), distance).repartition("key").sortWithinPartitions("key")
    found = bucket_edges(dealt, distance, linked=True).distinct()
    for end in ("a", "b"):
        named = tops.select(F.col("fingerprint").alias(end), F.col("top").alias(f"{end}_top"))
        found = found.join(named, end).drop(end).withColumnRenamed(f"{end}_top", end)
    same = own.join(heads, ["fingerprint", "salt"]).select(F.col("code").alias("a"), F.col("head").alias("b"))
    salted = heads.join(tops, "fingerprint").select(F.col("head").alias("a"), F.col("top").alias("b"))
    pairs = found.select("a", "b").unionByName(same).unionByName(salted).where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def placed(fresh: DataFrame, kind: str) -> DataFrame:
    """Rows (token, code, at) of the ``rare`` or ``common`` shingles of the pieces."""
    both = fresh.select("code", F.explode(F.arrays_zip(F.col(kind).alias("token"), F.col(f"{kind}_at").alias("at"))).alias("p"))
    return both.select("p.token", "code", "p.at")


def shared_only(rows: DataFrame) -> DataFrame:
    """The rows (token, code, at) whose token several codes have, each code once a token.

    Rows are sorted by token and code, so a row needs to know its neighbours only: no bucket comes together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.zeros(0, np.int64)] * 3
        before = None  # the token of the row before the carried one
        for batch in batches:
            if not len(batch):
                continue
            columns = [np.concatenate([kept, c.to_numpy()]) for kept, c in zip(last, batch.columns, strict=True)]
            token, code = columns[:2]
            new = np.r_[True, (token[1:] != token[:-1]) | (code[1:] != code[:-1])]
            columns = [c[new] for c in columns]
            token = columns[0]
            follows = np.r_[before is not None and before == token[0], token[1:] == token[:-1]]
            live = follows | np.r_[follows[1:], False]
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][live[:-1]]) for c in columns], names=["token", "code", "at"])
            before = token[-2] if len(token) > 1 else before
            last = [c[-1:] for c in columns]
        if len(last[0]) and before is not None and before == last[0][0]:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in last], names=["token", "code", "at"])

    dealt = rows.repartition("token").sortWithinPartitions("token", "code")
    return dealt.mapInArrow(run, "token long, code long, at long")


Pairs = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]


def possible(bucket: np.ndarray, code: np.ndarray, size: np.ndarray, place: np.ndarray, words: list[np.ndarray], likeness: float) -> Pairs:
    """(i, j, bins that differ), i before j, of all rows of one bucket that can be alike; rows are sorted by bucket and size."""
    bits = [w.view(np.uint64) for w in words]
    i, lag = np.arange(len(bucket) - 1), 1
    while len(i):
        j = i + lag
        on = (bucket[i] == bucket[j]) & (size[i] >= likeness * size[j] - CLOSE)  # sizes grow: once false, false for all that follow
        i, j = i[on], j[on]
        both = size[i] + size[j]
        most = np.minimum(size[i] - place[i], size[j] - place[j])  # the bucket's shingle and what follows it in both
        can = (most >= likeness / (1 + likeness) * both - CLOSE) & (code[i] != code[j])
        one, other, both = i[can], j[can], both[can]
        apart = sum((np.bitwise_count(w[one] ^ w[other]) for w in bits), np.zeros(len(one), np.int64))
        near = apart <= (1 - likeness) / (1 + likeness) * both + CLOSE
        yield one[near], other[near], apart[near]
        lag += 1
        i = i[i + lag < len(bucket)]


def by_bucket(rows: DataFrame, columns: list[str], work: Callable[..., pa.RecordBatch], schema: str) -> DataFrame:
    """``work`` over arrays of whole buckets, some at a time; ``columns`` are long and begin with bucket, code, size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = []
        held = 0
        for batch in batches:
            kept.append([c.to_numpy() for c in batch.columns])
            held += len(batch)
            if held < ROWS_AT_ONCE:
                continue
            arrays = [np.concatenate(parts) for parts in zip(*kept, strict=True)]
            whole = np.searchsorted(arrays[0], arrays[0][-1])  # the last bucket may go on in the next batch
            if whole:
                yield work(*[a[:whole] for a in arrays])
            kept, held = [[a[whole:] for a in arrays]], len(arrays[0]) - whole
        if held:
            yield work(*[np.concatenate(parts) for parts in zip(*kept, strict=True)])

    placed = rows.select(*columns).repartition("bucket").sortWithinPartitions("bucket", "size", "code")
    return placed.mapInArrow(run, schema)


def in_parts(rows: DataFrame) -> DataFrame:
    """Rows with their ``bucket``: that of their shingle ``token``, or where it is crowded one for each pair of its parts."""
    crowded = rows.groupBy("token").agg(F.count("*").alias("held")).where(F.col("held") > CROWD)
    crowded, _ = sized(crowded.select("token", F.ceil(F.col("held") / CROWD).alias("parts")), "crowded")
    own = F.pmod(F.xxhash64("code"), F.col("parts"))
    pair = lambda other: F.xxhash64("token", F.least("own", other), F.greatest("own", other))
    buckets = F.when(F.col("parts").isNull(), F.array("token")).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), pair))
    told = rows.join(crowded, "token", "left").withColumn("own", own)
    return told.withColumn("bucket", F.explode(buckets)).drop("parts", "own")


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, likeness: float = LIKENESS
) -> DataFrame:
    """Rows (id, component_id), one for each row of ``docs``, whose ids are not null and each name one text.

    ``component_id`` is the least id that links of at least ``likeness`` reach, the row's own included. Texts without
    words are alike. Repeated rows stay repeated; other columns are not looked at; an empty table gives no rows. The result
    is stored; the tables on the way to it are removed.
    """
    with scratch(docs.sparkSession):
        return materialize(_components(docs, id_col, text_col, shingle, likeness), "components", result=True)


def _components(docs: DataFrame, id_col: str, text_col: str, shingle: int, likeness: float) -> DataFrame:
    def rows_once(columns: tuple[np.ndarray, ...]) -> list[np.ndarray]:
        bucket, code = columns[:2]
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (code[1:] != code[:-1])]
        return [c[new] for c in columns]

    def pairs_of(code: np.ndarray, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> pa.RecordBatch:
        ends = np.minimum(code[i], code[j]), np.maximum(code[i], code[j]), apart
        return pa.RecordBatch.from_arrays([pa.array(e) for e in ends], names=["a", "b", "apart"])

    def joining(*columns: np.ndarray) -> pa.RecordBatch:
        """The forest of some buckets."""
        bucket, code, size, place, *words = rows_once(columns)
        kept, held = [], 0
        for found in possible(bucket, code, size, place, words, likeness):
            kept.append(found)
            held += len(found[0])
            if held > MOST_PAIRS:
                kept = [forest(*[np.concatenate(parts) for parts in zip(*kept, strict=True)], len(code))]
                held = len(kept[0][0])
        nothing = (np.zeros(0, int),) * 3
        return pairs_of(code, *forest(*[np.concatenate(parts) for parts in zip(*kept, nothing, strict=True)], len(code)))

    def across(*columns: np.ndarray) -> pa.RecordBatch:
        """All pairs of some buckets whose ends have different roots."""
        bucket, code, size, place, root, *words = rows_once(columns)
        found = [(i[apart], j[apart], n[apart]) for i, j, n in possible(bucket, code, size, place, words, likeness) for apart in [root[i] != root[j]]]
        nothing = (np.zeros(0, int),) * 3
        return pairs_of(code, *[np.concatenate(parts) for parts in zip(*found, nothing, strict=True)])

    def found_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            found = pa.array([shingle_set(t.as_py() or "", shingle) for t in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["code", "found"])

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("code")).distinct()

    marked = materialize(marked_sets(docs, id_col, text_col, shingle, likeness), "marked")
    fresh = marked.where("sizes IS NOT NULL")
    words = F.transform(F.sequence(F.lit(0), F.size("sizes") - 1), lambda k: F.slice("sketch", k * WORDS + 1, WORDS))
    each = F.posexplode(F.arrays_zip("sizes", words.alias("words"))).alias("piece", "p")
    drawn = fresh.where("size(sizes) > 0").select("code", each).groupBy("code", "piece")
    drawn = drawn.agg(F.max("p.sizes").alias("size"), *[F.max(F.col("p.words")[k]).alias(w) for k, w in enumerate(SKETCH)])
    live = shared_only(placed(fresh, "rare")).unionByName(placed(fresh, "common"))
    live = live.withColumn("piece", F.shiftright("at", 32).cast("int")).withColumn("place", F.col("at").bitwiseAND(0xFFFFFFFF)).drop("at")
    live = materialize(live.join(drawn, ["code", "piece"]).drop("piece"), "live")

    columns = ["bucket", "code", "size", "place"]
    schema = "a long, b long, apart long"
    near = by_bucket(in_parts(live), [*columns, *SKETCH], joining, schema).groupBy("a", "b").agg(F.min("apart").alias("apart"))
    near = materialize(near, "near")
    indexed = materialize(index_links(fresh, DISTANCE), "indexed")
    asked = ends(near.select("a", "b").unionByName(indexed))
    names = fresh.select("code", "id").join(asked, "code").groupBy("code").agg(F.min("id").alias("id"))
    named, _ = sized(names, "names")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = texts.join(named, "id").select("code", "text").mapInArrow(found_sets, "code long, found array<long>")
    sets = materialize(sets.dropDuplicates(["code"]), "sets")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        held = materialize(pairs.select("a", "b"), f"{name}_asked")
        needed, few = sized(ends(held), f"{name}_ends")
        mine = sets.join(needed, "code", "left_semi") if few else sets
        for end in ("a", "b"):
            held = held.join(mine.select(F.col("code").alias(end), F.col("found").alias(f"{end}_found")), end)
        both, all_ = F.size(F.array_intersect("a_found", "b_found")), F.size("a_found") + F.size("b_found")
        return materialize(held.where(both >= likeness * (all_ - both) - CLOSE).select("a", "b"), name)

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
        return pairs.where("coalesce(a_root, a) <> coalesce(b_root, b)").drop("a_root", "b_root")

    links = verified(indexed, "index_links")
    left = materialize(apart(near, connected(links)), "left")
    other = F.struct("apart", F.col("b").alias("other"))
    each = left.select(F.col("a").alias("code"), other.alias("next")).unionByName(
        left.select(F.col("b").alias("code"), F.struct("apart", F.col("a").alias("other")).alias("next"))
    )
    nearest = each.groupBy("code").agg(F.min("next").alias("next")).select("code", "next.other")
    nearest = nearest.select(F.least("code", "other").alias("a"), F.greatest("code", "other").alias("b")).distinct()
    nearest = materialize(nearest, "nearest")
    links = links.unionByName(verified(nearest, "links"))
    rest = left.select("a", "b").join(nearest, ["a", "b"], "left_anti")
    links = links.unionByName(verified(apart(rest, connected(links)), "more_links"))
    roots = connected(links)
    unlike = materialize(apart(near.select("a", "b"), roots), "unlike")
    if not unlike.isEmpty():
        tokens = live.join(ends(unlike), "code", "left_semi").select("token").distinct()
        again = live.join(ends(near), "code", "left_semi").join(tokens, "token", "left_semi")
        again = again.join(roots.withColumnRenamed("node", "code"), "code", "left").withColumn("root", F.coalesce("root", "code"))
        pairs = by_bucket(in_parts(again), [*columns, "root", *SKETCH], across, schema).select("a", "b").distinct()
        links = links.unionByName(verified(pairs.join(near.select("a", "b"), ["a", "b"], "left_anti"), "last_links"))
        roots = connected(links)

    codes = marked.groupBy("code").agg(F.min("id").alias("least"))
    rooted = codes.join(roots.withColumnRenamed("node", "code"), "code", "left")
    # The root of a component is one of its own nodes, but no row of roots.
    joined = materialize(rooted.withColumn("root", F.coalesce("root", "code")), "rooted")
    heads = joined.where("root <> code").select("root").distinct()
    many = joined.join(heads, "root", "left_semi").groupBy("root").agg(F.min("least").alias("component_id"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    many = materialize(many.select("root", "component_id", salts), "least_ids")
    salted = joined.withColumn("salt", F.pmod("code", F.lit(SALTS)).cast("int")).join(many, ["root", "salt"], "left")
    named = salted.select("code", F.coalesce("component_id", "least").alias("component_id"))
    return marked.select("id", "code").join(named, "code").select(F.col("id").alias(id_col), "component_id")
