"""The pipeline's near-duplicates against brute-force Jaccard likeness."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from opslens.llm import simhash, similar
from opslens.session import materialize
from tests.llm import fixtures
from tests.llm.test_near import classes, jaccard


def shingles_of(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def alike(sets):
    at_least = lambda a, b: a == b or bool(a & b) and jaccard(a, b) >= 0.8 - 1e-9
    return [(i, j) for i in range(len(sets)) for j in range(i) if at_least(sets[i], sets[j])]


def edited_texts():
    """Texts with copies of 1 to 12 changed words, about half of them above 0.8, and texts that share a long passage."""
    r = random.Random(11)
    texts = []
    for _ in range(25):
        words = fixtures.sentence(r, r.randrange(60, 260)).split()
        texts.append(" ".join(words))
        for edits in (1, 2, 3, 4, 6, 8, 12):
            copy = list(words)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = f"new{r.randrange(10**6)}"
            texts.append(" ".join(copy))
    passage = fixtures.sentence(r, 120)
    texts += [f"{passage} {fixtures.sentence(r, n)}" for n in range(5, 60, 3)]
    return [*texts, None, "", " \n", "one", "One", "four words are here", "four words are there"]


def kept_of(texts):
    sets = [shingles_of(t) for t in texts]
    return {k for k, root in enumerate(classes(len(sets), alike(sets))) if k == root}


@pytest.mark.parametrize(("rows", "crowd"), [(100_000, 4000), (50, 3)])
def test_stage_finds_what_is_alike(spark, rows, crowd, monkeypatch):
    monkeypatch.setattr(similar, "ROWS_AT_ONCE", rows)
    monkeypatch.setattr(similar, "MOST_PAIRS", rows)
    monkeypatch.setattr(similar, "CROWD", crowd)
    monkeypatch.setattr(similar, "PIECE", 200 if crowd > 100 else 20)
    texts = edited_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == kept_of(texts)
    assert len(kept) < len({r.component_id for r in simhash.near_duplicates(docs).collect()})


@pytest.mark.parametrize("table", ["edge", "sf"])
def test_stage_on_tables(spark, edge_dir, table):
    folder = edge_dir if table == "edge" else "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").fillna("").collect())
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, folder).collect()}
    assert kept == {rows[k][0] for k in kept_of([t for _, t in rows])}


def test_forest_joins_what_all_pairs_join():
    r = np.random.default_rng(6)
    for _ in range(30):
        n = int(r.integers(2, 40))
        i, j = r.integers(0, n, 60), r.integers(0, n, 60)
        i, j = np.minimum(i, j)[i != j], np.maximum(i, j)[i != j]
        apart = r.integers(0, 5, len(i))
        x, y, d = similar.forest(i, j, apart, n)
        label = classes(n, zip(i.tolist(), j.tolist(), strict=True))
        assert classes(n, zip(x.tolist(), y.tolist(), strict=True)) == label and len(x) == n - len(set(label))
        weight, rest = 0, list(range(n))
        for k in np.argsort(apart, kind="stable").tolist():  # the least sum, by taking pairs in order
            a, b = rest[i[k]], rest[j[k]]
            weight += int(apart[k]) if a != b else 0
            rest = [a if v == b else v for v in rest]
        assert int(d.sum()) == weight


def crowded_texts():
    """A group whose members differ from each other a little more than a link allows, linked copies among them, and a passage."""
    r = random.Random(4)
    base = fixtures.sentence(r, 150).split()
    texts = []
    for k in range(60):
        words = list(base)
        for place in r.sample(range(5, 145), 4):
            words[place] = f"own{k}x{place}"
        texts.append(" ".join(words))
        if k % 6 == 0:
            words[70] = "copied"
            texts.append(" ".join(words))
    return texts + [" ".join(base[:60]) + " " + fixtures.sentence(r, 30) for _ in range(40)]


def test_pairs_follow_the_sets(spark, monkeypatch):
    """A group of n sets that share most shingles gives a number of pairs that grows like n, not like its square."""
    sizes = {}

    def counted(df, name, **options):
        made = materialize(df, name, **options)
        sizes[name] = made.count()
        return made

    monkeypatch.setattr(similar, "materialize", counted)
    texts = crowded_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == kept_of(texts)
    assert sizes["nearest"] <= len(texts) and sizes["near"] <= 8 * len(texts)


def test_stage_searches_the_simhash_index(spark, monkeypatch):
    """Candidates come from the simhash index first; what it joins is verified and not asked of the prefixes again."""
    tables = {}

    def noted(df, name, **options):
        made = materialize(df, name, **options)
        if name in ("indexed", "index_links", "left", "nearest"):
            tables[name] = {(r["a"], r["b"]) for r in made.collect()}
        return made

    monkeypatch.setattr(similar, "materialize", noted)
    texts = edited_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == kept_of(texts)

    sets = {similar.xxhash.xxh64_intdigest(s.tobytes(), similar.SEED): s for s in (similar.shingle_set(t or "") for t in texts)}
    codes = [int(np.uint64(c).view(np.int64)) for c in sets]
    place = {c: k for k, c in enumerate(codes)}
    hashes = [set(s.tolist()) for s in sets.values()]
    prints = [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in s) > len(s)) for s in hashes]
    near = [(i, j) for i in range(len(codes)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= similar.DISTANCE]
    pairs = lambda name: [(place[a], place[b]) for a, b in tables[name]]
    assert classes(len(codes), pairs("indexed")) == classes(len(codes), near)
    assert all((prints[i] ^ prints[j]).bit_count() <= similar.DISTANCE for i, j in pairs("indexed"))
    assert set(pairs("index_links")) == {p for p in pairs("indexed") if hashes[p[0]] and hashes[p[1]] and jaccard(hashes[p[0]], hashes[p[1]]) >= 0.8 - 1e-9}
    assert len(tables["index_links"]) >= 25
    joined = classes(len(codes), pairs("index_links"))
    assert tables["nearest"] <= tables["left"] and all(joined[i] != joined[j] for i, j in pairs("left"))
