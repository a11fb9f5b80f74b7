"""Merkle manifest of a dataset: a digest of every row, one root, and for each row the siblings that lead to it.

Rows are leaves, ordered by id in each group; every ``FANOUT`` consecutive nodes become their hash until one is left, the
group's subroot, and the subroots, in the order of the groups, likewise become the root.

Leaves are cut by rank into aligned blocks of ``FANOUT ** HEIGHT``, so a block is a whole subtree, hashed inside its row.
Above the blocks runs a butterfly exchange: in round r a block meets those whose number differs from its own in digit r
alone (base ``FANOUT``), all swap the roots of the subtrees that they have hashed so far, and each of them hashes the common
ancestor for itself. After log(blocks) rounds every block knows the root and all siblings on its way: nothing is sent down
again. A tree's last subtree may lack blocks; those that it has stand in for the others, in turn, as all know the same root.
The subroots swap in the same way, a block a group. A meeting has at most ``FANOUT`` rows, whatever the data are.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.llm.sharding import numbered
from opslens.session import materialize, meet, sized

FANOUT = 8
HEIGHT = 3
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 64  # characters of a digest in hex
STEPS = "array<struct<before:string,after:string>>"


def row_digest(values: Sequence[Column]) -> Column:
    """The digest of a row: each value as its length in bytes, a colon and its text, null as a dash."""

    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the steps of its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256))


def height_of(nodes: Column) -> Column:
    """How many levels of runs lead from so many nodes to one."""
    return reduce(lambda a, b: a + b, [(nodes > FANOUT**k).cast("int") for k in range(21)])


def butterfly(nodes: DataFrame) -> DataFrame:
    """``nodes`` (tree, block, blocks, digest, ...) with the root of their tree as ``digest`` and the ``steps`` that lead to it.

    The blocks of a tree are numbered from 0; ``blocks`` is how many it has.
    """
    most = nodes.agg(F.max("blocks")).first()[0] or 1
    nodes = nodes.withColumn("steps", F.expr(f"cast(array() as {STEPS})"))
    kept = nodes.columns
    stride = 1
    while stride < most:
        lane, members = f"block % {stride}", f"(blocks - (blocks - 1) div {stride} * {stride})"
        stands_in = f"blocks > {stride} AND block div {stride} = (blocks - 1) div {stride}"
        lanes = F.expr(f"IF({stands_in}, sequence({lane}, {stride - 1}L, {members}), array({lane}))")
        sent = nodes.withColumn("lane", F.explode(lanes)).withColumn("place", F.expr(f"block div {stride} % {FANOUT}"))
        meeting = Window.partitionBy("tree", F.expr(f"block div {stride * FANOUT}"), "lane")
        told = sent.withColumn("met", F.sort_array(F.collect_list(F.struct("place", "digest")).over(meeting))).where(f"lane = {lane}")
        texts = told.withColumns(
            {
                "before": F.expr("array_join(transform(filter(met, m -> m.place < place), m -> m.digest), '')"),
                "after": F.expr("array_join(transform(filter(met, m -> m.place > place), m -> m.digest), '')"),
            }
        )
        going = F.col("blocks") > stride
        nodes = texts.withColumns(
            {
                "steps": F.when(going, F.concat("steps", F.array(F.struct("before", "after")))).otherwise(F.col("steps")),
                "digest": F.when(going, F.sha2(F.concat("before", "digest", "after"), 256)).otherwise(F.col("digest")),
            }
        ).select(kept)
        stride *= FANOUT
    return nodes


def with_subtree(blocks: DataFrame) -> DataFrame:
    """``blocks`` with the nodes of each level as ``level0`` to ``levelN`` and the joined digests of each run as ``runs0`` on."""
    blocks = blocks.withColumn("level0", F.col("leaves.leaf"))
    for k in range(HEIGHT):
        run = f"array_join(slice(level{k}, cast(i * {FANOUT} + 1 AS int), {FANOUT}), '')"
        runs = F.expr(f"transform(sequence(0, cast((size(level{k}) - 1) div {FANOUT} AS int)), i -> {run})")
        blocks = blocks.withColumn(f"runs{k}", runs).withColumn(f"level{k + 1}", F.expr(f"transform(runs{k}, run -> sha2(run, 256))"))
    return blocks


def merkle_manifest(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    group_col: str = "lang",
    id_col: str = "doc_id",
    presented: Sequence[Column] | None = None,
) -> DataFrame:
    """Rows (id, leaf, subroot, root, proof, presented), one for each row of ``docs``.

    ``leaf`` is the ``row_digest`` of ``columns``. ``proof`` has a step for each level up to the root: the digests of the run
    that stand before the node, joined, and those after it. ``presented`` is the ``row_digest`` of the values of that name,
    such as those of a copy that is to be verified; without them, the leaf. ``folded(presented, proof)`` equals ``root`` if
    and only if the row is unaltered.

    Null groups come first and are one group, null ids come first in it; rows of one id are ordered by their digest, so rows
    that repeat have places of their own. A row alone in the table is its own root, with an empty proof. Only ``columns``, the
    group and the id are looked at; an empty table gives no rows.
    """
    leaf = row_digest([F.col(c) for c in columns])
    shown = row_digest(presented) if presented else leaf
    keys = docs.select(F.col(group_col).alias("group"), F.col(id_col).alias("id"), leaf.alias("leaf"), shown.alias("shown"))
    keys = keys.withColumn("shown", F.nullif("shown", "leaf")).withColumn("number", F.monotonically_increasing_id())
    ranked, _ = numbered(materialize(keys, "leaves"), ["group", "id", "leaf", "number"], "leaf_ranks")

    groups = ranked.groupBy("group").agg(F.min("rank").alias("first"), F.count("*").alias("rows"))
    groups, trees = numbered(groups, ["first"], "groups")
    groups, _ = sized(groups.withColumnRenamed("rank", "tree"), "group_ranks")
    size = FANOUT**HEIGHT
    placed = meet(ranked.drop("number"), groups, ["group"]).withColumn("place", F.expr("rank - first"))
    blocks = placed.groupBy("tree", "rows", F.expr(f"place div {size}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("place", "id", "leaf", "shown"))).alias("leaves")
    )
    blocks = materialize(blocks, "blocks").withColumn("height", F.least(height_of(F.col("rows")), F.lit(HEIGHT)))

    inner = ", ".join(f"level{k}[0]" for k in range(HEIGHT + 1))
    tops = with_subtree(blocks).select(
        "tree",
        "block",
        F.expr(f"(rows - 1) div {size} + 1").alias("blocks"),
        F.expr(f"element_at(array({inner}), height + 1)").alias("digest"),
    )
    tops = materialize(butterfly(tops).drop("blocks"), "tops")
    roots = tops.where("block = 0").select(F.lit(0).alias("tree"), F.col("tree").alias("block"), F.lit(trees).alias("blocks"), "digest")
    roots, _ = sized(butterfly(roots).select(F.col("block").alias("tree"), F.col("digest").alias("root"), F.col("steps").alias("last")), "roots")
    tops = tops.join(roots, "tree").select(
        "tree", "block", F.col("digest").alias("subroot"), "root", F.concat("steps", "last").alias("upper")
    )

    steps = []
    for k in range(HEIGHT):
        run, start = f"runs{k}[cast(p div {FANOUT ** (k + 1)} AS int)]", f"{DIGEST} * cast(p div {FANOUT**k} % {FANOUT} AS int)"
        steps.append(f"named_struct('before', substr({run}, 1, {start}), 'after', substr({run}, {start} + {DIGEST + 1}))")
    proof = f"concat(slice(array({', '.join(steps)}), 1, height), upper)"
    row = f"named_struct('id', x.id, 'leaf', x.leaf, 'subroot', subroot, 'root', root, 'proof', {proof}, 'presented', coalesce(x.shown, x.leaf))"
    rows = with_subtree(blocks.join(tops, ["tree", "block"])).select(F.expr(f"inline(transform(leaves, (x, p) -> {row}))"))
    return rows.withColumnRenamed("id", id_col)
