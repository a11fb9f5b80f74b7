"""Ordered-row operators on long tables (one row per line, turn or call).

One key may own a large share of all rows, so no operator here orders a whole key in one task. The caller gives
``chunk``: an order-preserving step of the order columns, such as :func:`position_chunk` for dense integer positions or
the column of :func:`ranked_chunks` for times, sparse positions and bursts. Rows are ordered inside ``(key, chunk)``; what
crosses a chunk border travels in a table with one row per chunk. NULL is a key, a position and a chunk like any other
and comes first; no row is lost. ``order`` must be unique within a key.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens import values as V
from opslens.session import BROADCAST_ROWS, materialize, meet, sized

CHUNK_ROWS = 100_000
SHORT = {"one_chunk": True}


def position_chunk(position: str | Column, rows: int = CHUNK_ROWS) -> Column:
    """Chunk of a unique integer position: at most ``rows`` rows per key and chunk."""
    position = F.col(position) if isinstance(position, str) else position
    return F.floor(position / rows)


def ranked_chunks(
    rows: DataFrame, key: Sequence[str], order: Sequence[str], max_rows: int = CHUNK_ROWS, name: str = "chunk"
) -> DataFrame:
    """Add ``name``: the rank within the key divided by ``max_rows``, so chunks are full but for the last.

    Keys of at most ``max_rows`` rows are one chunk; if all are, nothing is moved, and :func:`is_short` tells operators
    that a key fits one task. Else the rows are stored once, and those of the longer keys are range-partitioned on key and
    order and numbered inside each partition; the place of a key's run in the partitions before it comes from their
    counts.
    """
    zero = F.lit(0).cast("bigint")
    counts = rows.groupBy(*key).agg(F.count("*").alias("_n")).where(F.col("_n") > max_rows)
    hot, _ = sized(counts.select(*key, F.lit(True).alias("_hot")), "hot")
    if hot.isEmpty():
        return rows.withColumn(name, zero.alias(name, metadata=SHORT))
    stored = materialize(meet(rows, hot, key, "left"), "rows")
    ordered = stored.where("_hot").repartitionByRange(*key, *order).sortWithinPartitions(*key, *order)
    placed = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    runs = placed.groupBy(*key, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets, _ = sized(runs.select(*key, "_part", "_first", F.coalesce(F.sum("_n").over(before), zero).alias("_before")), "runs")
    step = F.floor((F.col("_before") + F.col("_at") - F.col("_first")) / max_rows).cast("bigint")
    long = meet(placed, offsets, [*key, "_part"]).select(*rows.columns, step.alias(name))
    return stored.where("_hot IS NULL").select(*rows.columns, zero.alias(name)).unionByName(long)


def is_short(rows: DataFrame, chunk: Column) -> bool:
    """True if ``chunk`` is a column for which every key was counted to be one chunk."""
    return rows.select(chunk.alias("c")).schema["c"].metadata == SHORT


def grouped(rows: DataFrame, key: Sequence[str], chunk: Column) -> DataFrame:
    """``rows`` with ``_chunk`` and ``_group``: key and chunk as one struct, so that NULL is a value like any other.

    Windows and joins on ``_group`` share one partitioning.
    """
    return rows.withColumn("_chunk", chunk).withColumn("_group", F.struct(*key, "_chunk"))


def _group(key: Sequence[str]) -> Column:
    return F.struct(*key, "_chunk").alias("_group")


def _running(
    rows: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    sums: dict[str, Column],
    lowest: dict[str, Column] | None = None,
) -> DataFrame:
    """Rows with their ``_chunk``, running sums, and for each entry of ``lowest`` its minimum over the whole key."""
    group = [*key, "_chunk"]
    names, lowest = list(sums), lowest or {}
    if is_short(rows, chunk):
        whole = grouped(rows, key, chunk)
        sofar = _inside(order).rowsBetween(Window.unboundedPreceding, 0)
        every = Window.partitionBy("_group")
        return whole.withColumns({n: F.sum(c).over(sofar) for n, c in sums.items()} | {n: F.min(c).over(every) for n, c in lowest.items()})
    tagged = grouped(rows.withColumns({f"_v{i}": sums[n] for i, n in enumerate(names)}), key, chunk)
    per_chunk = tagged.groupBy(*group).agg(
        *[F.sum(f"_v{i}").alias(f"_s{i}") for i in range(len(names))],
        *[F.min(c).alias(f"_m_{n}") for n, c in lowest.items()],
    )
    whole = Window.partitionBy(*key)
    before = whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(
        _group(key),
        *[F.sum(f"_s{i}").over(before).alias(f"_o{i}") for i in range(len(names))],
        *[F.min(f"_m_{n}").over(whole).alias(n) for n in lowest],
    )
    inside = _inside(order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumns({f"_l{i}": F.sum(f"_v{i}").over(inside) for i in range(len(names))})
    total = {
        n: F.when(F.col(f"_o{i}").isNull(), F.col(f"_l{i}"))
        .when(F.col(f"_l{i}").isNull(), F.col(f"_o{i}"))
        .otherwise(F.col(f"_o{i}") + F.col(f"_l{i}"))
        for i, n in enumerate(names)
    }
    kept = [c for c in rows.columns if c != "_chunk"]
    return local.join(offsets, "_group").select(*kept, "_chunk", "_group", *[total[n].alias(n) for n in names], *lowest)


def _inside(order: Sequence[str]):
    return Window.partitionBy("_group").orderBy(*order)


def running_sums(
    rows: DataFrame, key: Sequence[str], order: Sequence[str], chunk: Column, sums: dict[str, Column]
) -> DataFrame:
    """Add running sums (current row included) in ``order`` within ``key``.

    Each chunk is summed with map-side combine; the sums of earlier chunks are the offset of the next one.
    """
    return _running(rows, key, order, chunk, sums).drop("_chunk", "_group")


def row_numbers(
    rows: DataFrame, key: Sequence[str], order: Sequence[str], chunk: Column, name: str = "row_no"
) -> DataFrame:
    """Ordinal from 1 within ``key``."""
    return running_sums(rows, key, order, chunk, {name: F.lit(1).cast("bigint")})


def item_chunks(
    rows: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    items: int = V.ITEMS_PER_CHUNK,
    name: str = "chunk_no",
) -> DataFrame:
    """Number the groups of ``items`` consecutive rows of each key from 1."""
    numbered = row_numbers(rows, key, order, chunk, "_row_no")
    return numbered.withColumn(name, F.ceil(F.col("_row_no") / items).cast("bigint")).drop("_row_no")


def first_error_rows(
    rows: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    match: Column,
    call_site: Column | None = None,
    keep: int = V.TRACE_ROWS,
    tail: int = V.TAIL_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Rows around the first match of each key, or its last ``tail`` rows if nothing matches.

    A ``match`` row is kept with the ``keep - 1`` rows after it. A ``call_site`` row that comes first is kept with
    the row before it and ``keep - 2`` rows after it. Row counts per chunk tell which chunks can hold kept rows; only
    those are read back and ordered. Counts are hash-aggregated; only matching rows take part in the search for the
    first one. The list of chunks is stored and counted: a short one is broadcast, so that the other rows are never
    shuffled, a long one is joined by a shuffle.
    """
    at = F.struct(*order)
    kind = F.when(match, 0) if call_site is None else F.when(match, 0).when(call_site, 1)
    if is_short(rows, chunk):
        whole = Window.partitionBy(*key)
        placed = rows.withColumns({"_rn": F.row_number().over(whole.orderBy(*order)), "_kind": kind})
        hit = F.min(F.when(F.col("_kind").isNotNull(), F.struct("_rn", "_kind"))).over(whole)
        placed = placed.withColumns({"_rows": F.count("*").over(whole), "_hit": hit})
        begin = F.col("_hit._rn") - F.col("_hit._kind")  # a call site takes the row before it along
        kept = F.when(F.col("_hit").isNull(), F.col("_rn") > F.col("_rows") - tail).otherwise(
            F.col("_rn").between(begin, begin + keep - 1)
        )
        return placed.where(kept).select(*rows.columns)
    tagged = rows.withColumns({"_chunk": chunk, "_at": at})
    counts = tagged.groupBy(*key, "_chunk").agg(F.count("*").alias("_n"))
    hits = tagged.withColumn("_kind", kind).where(F.col("_kind").isNotNull())
    first = hits.groupBy(*key).agg(F.min(F.struct("_at", "_kind", "_chunk")).alias("_first"))
    whole = Window.partitionBy(*key)
    earlier = whole.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    later = whole.orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing)
    none = F.lit(0).cast("bigint")
    placed = meet(counts, first, key, "left").withColumns(
        {"_before": F.coalesce(F.sum("_n").over(earlier), none), "_after": F.coalesce(F.sum("_n").over(later), none)}
    )
    has_hit = F.col("_first").isNotNull()
    in_hit = has_hit & F.col("_chunk").eqNullSafe(F.col("_first._chunk"))
    from_hit = F.struct("_chunk") >= F.struct(F.col("_first._chunk").alias("_chunk"))  # structs compare with NULL first
    placed = placed.withColumns(
        {
            "_hit_start": F.max(F.when(in_hit, F.col("_before"))).over(whole),
            "_hit_end": F.max(F.when(in_hit, F.col("_before") + F.col("_n"))).over(whole),
        }
    )
    needed = (
        F.when(F.col("_first").isNull(), F.col("_after") < tail)
        .when(from_hit, F.col("_before") - F.col("_hit_end") < keep)
        .otherwise(F.col("_before") + F.col("_n") == F.col("_hit_start"))
    )
    chunks, _ = sized(placed.where(needed).select(*key, "_chunk", "_first"), "chunks", broadcast_rows)
    near = meet(tagged, chunks, [*key, "_chunk"])
    ordered = whole.orderBy(*order)
    numbered = near.withColumns({"_rn": F.row_number().over(ordered), "_rows": F.count("*").over(whole)}).withColumn(
        "_mark", F.max(F.when(has_hit & F.col("_at").eqNullSafe(F.col("_first._at")), F.col("_rn"))).over(whole)
    )
    kept = (
        F.when(F.col("_first").isNull(), F.col("_rn") > F.col("_rows") - tail)
        .when(F.col("_first._kind") == 0, F.col("_rn").between(F.col("_mark"), F.col("_mark") + keep - 1))
        .otherwise(F.col("_rn").between(F.col("_mark") - 1, F.col("_mark") + keep - 2))
    )
    return numbered.where(kept).select(*rows.columns)


def prune_rows(
    rows: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    error: Column,
    vendor: Column,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Drop vendor rows that come after the first error row of their key.

    The first error of each key is stored and measured. If these are small, they are broadcast and the rows are not
    shuffled. Otherwise only the vendor rows are, and meet the first error of their key chunk by chunk.
    """
    found = rows.where(error).groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    first, small = sized(found, "first", broadcast_rows)
    error, vendor = F.coalesce(error, F.lit(False)), F.coalesce(vendor, F.lit(False))
    before = F.col("_first").isNull() | (F.struct(*order) < F.col("_first"))
    tagged = rows.withColumns({"_chunk": chunk, "_vendor": vendor & ~error})
    passing = tagged.where(~F.col("_vendor"))
    late = tagged.where("_vendor")
    if small:
        met = meet(late, first, key, "left")
    else:
        chunks = rows.select(*key, chunk.alias("_chunk")).distinct()
        met = meet(late, meet(chunks, first, key, "left"), [*key, "_chunk"])
    return passing.select(*rows.columns).unionByName(met.where(before).select(*rows.columns))


def repeated_calls(
    rows: DataFrame, key: Sequence[str], order: Sequence[str], chunk: Column, call: Sequence[str], times: int = 3
) -> DataFrame:
    """Rows (key, order, call) whose call equals the ``times - 1`` calls before it.

    A chunk hands its last ``times - 1`` calls on to the chunks after it.
    """
    back = times - 1
    if is_short(rows, chunk):
        placed = rows.select(*key, *order, F.struct(*call).alias("_call"))
        steps = Window.partitionBy(*key).orderBy(*order)
        before = {f"_l{j}": F.lag("_call", j).over(steps) for j in range(1, times)}
        same = F.lit(True)
        for n in before:
            same = same & F.col(n).isNotNull() & F.col(n).eqNullSafe(F.col("_call"))
        return placed.withColumns(before).where(same).select(*key, *order, "_call.*")
    narrow = rows.select(*key, *order, F.struct(*call).alias("_call"), chunk.alias("_chunk"))
    narrow = narrow.withColumn("_group", _group(key))
    inside = _inside(order)
    local = narrow.withColumns(
        {
            "_rn": F.row_number().over(inside),
            "_follows": F.lead(F.lit(True), back).over(inside),
            **{f"_l{j}": F.lag("_call", j).over(inside) for j in range(1, times)},
        }
    )
    ends = local.where(F.col("_follows").isNull()).groupBy("_group").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_rn", "_call"))), lambda r: r["_call"]).alias("_tail")
    )
    ends = ends.select("_group", "_group.*", "_tail")
    steps = Window.partitionBy(*key).orderBy("_chunk")
    none = F.array().cast(ends.schema["_tail"].dataType)
    handed = F.concat(*[F.coalesce(F.lag("_tail", j).over(steps), none) for j in range(back, 0, -1)])
    joined = local.join(ends.select("_group", handed.alias("_handed")), "_group")

    def before(j: int) -> Column:
        carried = F.get("_handed", F.size("_handed") - (j - F.col("_rn") + 1))
        return F.when(F.col("_rn") > j, F.col(f"_l{j}")).otherwise(carried)

    same = F.lit(True)
    for j in range(1, times):
        same = same & before(j).isNotNull() & before(j).eqNullSafe(F.col("_call"))
    return joined.where(same).select(*key, *order, "_call.*")


def first_breach(
    rows: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    chunk: Column,
    spent: dict[str, tuple[Column, float]],
    clock: Column | None = None,
    max_seconds: float | None = None,
) -> DataFrame:
    """First row of each key whose running total exceeds a cap, one result row per key and broken limit.

    ``spent`` maps a limit name to (amount per row, cap); amounts are summed as decimals. With ``clock``, the limit
    ``wall_clock`` compares the seconds since the first row of the key with ``max_seconds``.
    """
    names = list(spent)
    amounts = {f"_t{i}": spent[n][0].cast("decimal(28,9)") for i, n in enumerate(names)}
    totals = _running(rows, key, order, chunk, amounts, {} if clock is None else {"_begun": clock})
    limits = {n: (F.col(f"_t{i}").cast("double"), float(spent[n][1])) for i, n in enumerate(names)}
    if clock is not None:
        limits["wall_clock"] = (F.timestamp_diff("MICROSECOND", F.col("_begun"), clock) / 1e6, float(max_seconds))
    # Only the first row over a cap within its chunk can be the first of the key.
    fresh = lambda over: over & ~F.coalesce(F.lag(over).over(_inside(order)), F.lit(False))
    candidate = lambda total, cap: F.when(fresh(F.coalesce(total > cap, F.lit(False))), total)
    marked = totals.withColumns({f"_c{i}": candidate(*limit) for i, limit in enumerate(limits.values())})
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"_c{i}").alias("total")) for i, n in enumerate(limits)])
    over = marked.select(*key, F.struct(*order).alias("_at"), F.explode(each).alias("_c")).where("_c.total is not null")
    first = over.groupBy(*key, F.col("_c.name").alias("budget")).agg(
        F.min(F.struct("_at", F.col("_c.total").alias("total"))).alias("_f")
    )
    return first.select(*key, "budget", "_f._at.*", F.col("_f.total").alias("total"))


def latest_rows(
    rows: DataFrame, key: Sequence[str], newest: Sequence[Column], cap: int = 100, salts: int = 256
) -> DataFrame:
    """At most ``cap`` newest rows per key, in two stages.

    Spark cuts each map task to ``cap`` rows per key before a shuffle. What is left of a key over very many tasks is cut
    again in ``salts`` parts, so at most ``salts * cap`` rows of a key meet in one task.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salts)))
    for group in ([*key, "_salt"], [*key]):
        ranked = salted.withColumn("_rank", F.row_number().over(Window.partitionBy(*group).orderBy(*newest)))
        salted = ranked.where(F.col("_rank") <= cap).drop("_rank")
    return salted.drop("_salt")
