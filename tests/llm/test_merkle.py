"""The Merkle manifest against a manifest written down level by level."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from opslens.llm import merkle
from opslens.llm.queries import QUERIES

COLUMNS = "doc_id", "source", "lang", "n_chars", "text"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row):
    return h(*[framed(row[c]) for c in COLUMNS])


def tree(nodes):
    """The root, and for each node its steps (digests before, digests after)."""
    steps = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(k, min(k + 8, len(nodes))) for k in range(0, len(nodes), 8)]
        for run in runs:
            for k in run:
                for i in under[k]:
                    steps[i].append(([nodes[j] for j in run if j < k], [nodes[j] for j in run if j > k]))
        under = [[i for k in run for i in under[k]] for run in runs]
        nodes = [h(*[nodes[k] for k in run]) for run in runs]
    return nodes[0], steps


def manifest(rows, tampered):
    groups = defaultdict(list)
    for row in rows:
        groups[row["lang"]].append((row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for name in names:
        groups[name].sort(key=lambda x: x[:3])
    built = {name: tree([x[2] for x in groups[name]]) for name in names}
    root, upper = tree([built[name][0] for name in names])
    found = []
    for name, above in zip(names, upper, strict=True):
        subroot, steps = built[name]
        for (_, _, leaf, row), own in zip(groups[name], steps, strict=True):
            node = leaf_of(row | {"text": tampered(row)})
            for before, after in own + above:
                node = h(*before, node, *after)
            siblings = [d for before, after in own + above for d in before + after]
            found.append((row["doc_id"], leaf, subroot, root, h(*siblings), node, node == root))
    return found


def lowered(row):
    crc = None if row["doc_id"] is None else zlib.crc32(str(row["doc_id"]).encode())
    if row["text"] is None or crc is None or crc % 3:
        return row["text"]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])


def in_order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("table", ["edge", "repeated", "null", "sf"])
def test_query(spark, edge_dir, repeated_dir, null_dir, table):
    folder = {"edge": edge_dir, "repeated": repeated_dir, "null": null_dir, "sf": "/root/testdata/sf0.01"}[table]
    rows = [r.asDict() for r in spark.read.parquet(f"{folder}/documents.parquet").select(*COLUMNS).collect()]
    got = in_order(map(tuple, QUERIES["op13_merkle_manifest"](spark, folder).collect()))
    assert got == in_order(manifest(rows, lowered))
    if table != "null":
        assert {True, False} == {r[-1] for r in got}


@pytest.mark.parametrize("height", [1, 2])
def test_sizes_around_full_runs(spark, monkeypatch, height):
    """Groups of one row, of full runs, and of one row more, with small blocks, so that there are several rounds."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    sizes = [1, 2, 8, 9, 63, 64, 65, 72, 73, 130, 512, 513, 520, 577, 1, 1, 3]
    r = random.Random(2)
    rows = [
        {"doc_id": r.randrange(10**6), "source": None, "lang": None if g == 3 else f"{'é' if g % 2 else 'z'}{g}", "n_chars": i, "text": f"Text {g} {i}"}
        for g, n in enumerate(sizes)
        for i in range(n)
    ]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = merkle.merkle_manifest(docs.repartition(3))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof", "presented"]
    got = got.withColumn("folded", merkle.folded(F.col("presented"), F.col("proof")))
    joined = F.sha2(F.array_join(F.transform("proof", lambda s: F.concat(s["before"], s["after"])), ""), 256)
    got = got.select("doc_id", "leaf", "subroot", "root", joined, "folded", F.col("folded") == F.col("root"))
    assert in_order(map(tuple, got.collect())) == in_order(manifest(rows, lambda row: row["text"]))


def test_meetings_are_small(spark):
    """A tree of 8 * 8 + 1 blocks: the last block stands in for the others of its subtree, and no meeting has over 8 rows."""
    nodes = spark.range(65).select(F.lit(0).alias("tree"), F.col("id").alias("block"), F.lit(65).alias("blocks"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("digest"))
    rows = merkle.butterfly(nodes).collect()
    assert len(rows) == 65 and len({r.digest for r in rows}) == 1 and {len(r.steps) for r in rows} == {3}
    assert all(len(s.before + s.after) <= 7 * 64 for r in rows for s in r.steps)
