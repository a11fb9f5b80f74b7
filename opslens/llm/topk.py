"""Exact search for the greatest inner products, by vectors in buckets of like length.

Candidates are sorted by length and cut into buckets, so a bucket knows its longest vector. A query with the k-th best score t so
far needs, in a bucket whose longest vector has length l, a cosine of t / (|q| l) at least, the local threshold. Above one the
bucket is passed over. Close to one the vectors must lie near the query's direction: the query's largest coordinates leave a
narrow interval for the same coordinates of a unit vector, and only vectors inside all intervals are multiplied (coordinate
pruning). Otherwise the vectors that are too short by themselves are passed over (length pruning) and the rest is multiplied as
one block. Every score is the integer product itself, so bounds only decide what is looked at, and they lean to looking.

Spark deals out a grid of cells: the distinct query vectors in slices, the buckets in stripes that mix all lengths, each
cell from its longest bucket to its shortest, with the running k best of its own queries. First thresholds come from the
longest vectors of all. Copies count once: a query vector is searched once however many rows have it, and of the candidates
with one vector only the k + 1 least ids can ever be wanted.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.vectors import integer_rows, most_dims, unpacked
from opslens.session import materialize

SCALE = 64
BEST = 20
BUCKET = 1024
STRIPE = 65_536
SLICE = 16_384
LEAST_STRIPE = 4096
PILOT_BYTES = 4 << 20
FOCUS = 4
NARROW = 0.8
SLACK = 1e-9


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of a and of b, exact."""
    most = np.linalg.norm(a.astype(float), axis=1).max(initial=0) * np.linalg.norm(b.astype(float), axis=1).max(initial=0)
    if most >= 2.0**62:
        raise ValueError("inner products leave 64 bits")
    if most < 2.0**52:  # then doubles hold every sum on the way
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def intervals(query: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The query's ``FOCUS`` largest coordinates, and the least and greatest values there of unit vectors at that cosine or above."""
    unit = query / np.linalg.norm(query)
    focus = np.argsort(-np.abs(unit))[:FOCUS]
    own, reach = np.arccos(np.clip(unit[focus], -1, 1)), np.arccos(min(cosine, 1.0))
    return focus, np.cos(np.minimum(own + reach, np.pi)) - SLACK, np.cos(np.maximum(own - reach, 0.0)) + SLACK


class Best:
    """The k best of each of some queries: scores falling, then ids rising."""

    def __init__(self, queries: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.vectors, self.k = queries, k
        self.length = np.linalg.norm(queries.astype(float), axis=1)
        self.floor = floor  # a score that the k-th best reaches; -inf where none is known
        self.query = self.score = self.id = np.zeros(0, np.int64)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = np.r_[self.query, query], np.r_[self.score, score], np.r_[self.id, ids]
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]
        full = place == self.k - 1
        self.floor[query[full]] = np.maximum(self.floor[query[full]], score[full])

    def see(self, bucket: np.ndarray, ids: np.ndarray) -> None:
        """Take in a bucket, whose vectors come by falling length."""
        length = np.linalg.norm(bucket.astype(float), axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            needed = np.where(self.floor > 0, self.floor / self.length, -np.inf)  # the least length that can reach the floor
            cosine = needed / length[0]
        reach = np.searchsorted(-length, -needed * (1 - SLACK), "right")
        narrow = (reach > 0) & (cosine >= NARROW)
        found = []
        wide = np.flatnonzero((reach > 0) & ~narrow)
        if len(wide):
            most = int(reach[wide].max())
            score = products(self.vectors[wide], bucket[:most])
            i, j = np.nonzero(score >= self.floor[wide][:, None])
            found.append((wide[i], score[i, j], ids[j]))
        if narrow.any():
            unit = bucket / np.maximum(length, 1e-300)[:, None]
        for q in np.flatnonzero(narrow):
            focus, low, high = intervals(self.vectors[q].astype(float), cosine[q] * (1 - SLACK))
            near = unit[: reach[q], focus]
            j = np.flatnonzero(((near >= low) & (near <= high)).all(1))
            score = products(self.vectors[q : q + 1], bucket[j])[0]
            hit = score >= self.floor[q]
            found.append((np.full(int(hit.sum()), q), score[hit], ids[j[hit]]))
        if any(len(f[0]) for f in found):
            self.add(*[np.concatenate(parts) for parts in zip(*found, strict=True)])


def first_floors(queries: np.ndarray, pilot: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score of each query among the pilot's vectors, a bound from below; -inf if it has fewer."""
    if len(pilot) < k:
        return np.full(len(queries), -np.inf)
    return np.partition(products(queries, pilot), len(pilot) - k, axis=1)[:, len(pilot) - k].astype(float)


def in_buckets(rows: DataFrame, dims: int) -> DataFrame:
    """Rows (number, length, ids, xs): (id, x) packed in the order they come, ``BUCKET`` at a time, with the length of the longest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), BUCKET):
                part = batch.slice(start, BUCKET)
                longest = np.linalg.norm(unpacked(part.column(1).to_pylist(), dims).astype(float), axis=1).max(initial=0.0)
                arrays = [pa.array([longest])] + [pa.array([c.to_pylist()], kind) for c, kind in zip(part.columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["length", "ids", "xs"])

    kinds = pa.list_(pa.int64()), pa.list_(pa.binary())
    made = rows.select("id", "x").mapInArrow(run, "length double, ids array<long>, xs array<binary>")
    return made.withColumn("number", F.monotonically_increasing_id())


def searched(cells: DataFrame, dims: int, k: int) -> DataFrame:
    """Rows (query, id, score): the k best of each cell's queries; a cell's rows lie together, queries first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, names, vectors, floors, best = None, [], [], [], None

        def result() -> Iterator[pa.RecordBatch]:
            if best is not None:
                found = [np.array(names, np.int64)[best.query], best.id, best.score]
                yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], names=["query", "id", "score"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["cell"] != cell:
                    yield from result()
                    cell, names, vectors, floors, best = row["cell"], [], [], [], None
                if row["floors"] is not None:
                    names += row["ids"]
                    vectors += row["xs"]
                    floors += row["floors"]
                    continue
                if best is None:
                    best = Best(unpacked(vectors, dims), np.array(floors, float), k)
                best.see(unpacked(row["xs"], dims), np.array(row["ids"], np.int64))
        yield from result()

    return cells.mapInArrow(run, "query long, id long, score long")


def top_products(
    table: DataFrame, queries: Column, k: int = BEST, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE
) -> DataFrame:
    """Rows (query_id, rank, id, score): for each row where ``queries`` holds the k other rows of greatest inner product.

    Entries become integers, floor(scale * entry); vectors shorter than the longest end in zeros. Equal scores are ranked
    by rising id. A row is no candidate for itself, but a row that repeats it is; a query has fewer than k results only if there
    are fewer other rows. Rows without an id, or whose vector is null or holds null, non-finite or 64-bit-exceeding entries,
    take no part. Inner products beyond 62 bits are refused with an error. An empty table gives no rows.
    """
    spark = table.sparkSession
    marked = table.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(queries, F.lit(False)).alias("asks"), vector_col
    )
    rows = materialize(integer_rows(marked, vector_col, scale, "id", "asks"), "vectors")
    k = k + 1  # a query's own row is among the candidates and goes at the end
    copies = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    candidates = rows.select("id", "x").withColumn("copy", copies).where(F.col("copy") <= k).select("id", "x")
    dims = rows.agg(most_dims(rows)).first()[0]

    def with_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.linalg.norm(unpacked(batch.column(1).to_pylist(), dims).astype(float), axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length)], names=["id", "x", "length"])

    candidates = materialize(candidates.mapInArrow(with_length, "id long, x binary, length double"), "candidates")
    order = [F.desc("length"), F.xxhash64("x"), F.col("id")]
    longest = candidates.orderBy(F.desc("length"), "x", "id").limit(max(k, min(LEAST_STRIPE, PILOT_BYTES // (8 * max(dims, 1)))))
    pilot = unpacked([r["x"] for r in longest.select("x").collect()], dims)
    sorted_rows = candidates.repartitionByRange(*order).sortWithinPartitions(*order)
    buckets = materialize(in_buckets(sorted_rows, dims), "buckets")

    asked = materialize(rows.where("asks").select("x").distinct().withColumn("id", F.monotonically_increasing_id()), "asked")

    def with_floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            floors = [first_floors(unpacked(xs, dims), pilot, k).tolist() for xs in batch.column("xs").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(floors, pa.list_(pa.float64()))], names=[*batch.schema.names, "floors"])

    lots = in_buckets(asked, dims).mapInArrow(with_floors, "length double, ids array<long>, xs array<binary>, number long, floors array<double>")
    lots = materialize(lots, "lots")

    counts = candidates.agg(F.count("*")).first()[0], asked.count()
    cores = spark.sparkContext.defaultParallelism
    stripes = max(-(-counts[0] // STRIPE), min(2 * cores, -(-counts[0] // LEAST_STRIPE)), 1)
    slices = max(-(-counts[1] // SLICE), 1)
    stripe, slice_ = F.pmod(F.xxhash64("number"), F.lit(stripes)), F.pmod(F.xxhash64("number"), F.lit(slices))
    asking = lots.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(stripes - 1)), lambda s: s * slices + slice_)))
    seen = buckets.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(slices - 1)), lambda s: stripe * slices + s)))
    columns = ["cell", "length", "ids", "xs"]
    none = F.lit(None).cast("array<double>").alias("floors")
    cells = asking.select(*columns, "floors").unionByName(seen.select(*columns, none))
    inside = ["cell", F.col("floors").isNull(), F.desc("length")]
    cells = cells.repartitionByRange(stripes * slices, "cell").sortWithinPartitions(*inside)

    by_query = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    best = searched(cells, dims, k).withColumn("place", by_query).where(F.col("place") <= k)
    best = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "id", "score"))).alias("best"))
    answers = asked.withColumnRenamed("id", "query").join(best, "query").select("x", "best")
    asking = rows.where("asks").select(F.col("id").alias("query_id"), "x").join(answers, "x")

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[], [], [], []]
            for query, x, rows_ in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                values = np.frombuffer(x, f"<i{x[0]}", offset=1).tolist()
                own = (query, sum(v * v for v in values))
                pairs = [(r["id"], r["score"]) for r in rows_]
                pairs = [p for i, p in enumerate(pairs) if p != own or own in pairs[:i]][: k - 1]
                for place, (name, score) in enumerate(pairs, 1):
                    for column, value in zip(found, (query, place, name, score), strict=True):
                        column.append(value)
            kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, kinds, strict=True)], names=["query_id", "rank", "id", "score"])

    return asking.select("query_id", "x", "best").mapInArrow(answered, "query_id long, rank int, id long, score long").withColumnRenamed("id", id_col)
