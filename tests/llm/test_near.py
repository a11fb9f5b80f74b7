"""Simhash, spot signatures and the pipeline against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from opslens.llm import pii, quality, simhash, spotsigs
from opslens.llm.components import connected
from opslens.llm.queries import QUERIES
from tests.llm import fixtures


def classes(n, linked):
    """The least member reachable from each of 0 to n - 1."""
    label = list(range(n))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return [root(x) for x in range(n)]


def near(codes, distance):
    return [(i, j) for i in range(len(codes)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= distance]


def simhash_of(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashed = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


@pytest.mark.parametrize("table", ["edge", "repeated", "sf"])
def test_components(spark, edge_dir, repeated_dir, table):
    folder = {"edge": edge_dir, "repeated": repeated_dir, "sf": "/root/testdata/sf0.001"}[table]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    names = sorted(docs)
    codes = [simhash_of(docs[n]) for n in names]
    label = classes(len(names), near(codes, 4))
    want = {n: (format(c, "016x"), names[k]) for n, c, k in zip(names, codes, label, strict=True)}
    rows = QUERIES["op10_simhash_components"](spark, folder).collect()
    assert {r.doc_id for r in rows} == set(names)
    assert all(want[r.doc_id] == (r.fingerprint, r.component_id) for r in rows)


def clustered(r, groups, size):
    found = set()
    for _ in range(groups):
        centre = r.getrandbits(64)
        for _ in range(size):
            code = centre
            for _ in range(r.randrange(10)):
                code ^= 1 << r.randrange(64)
            found.add(code)
    return sorted(found)


def test_tree_joins_what_is_near():
    r = random.Random(5)
    for _ in range(10):
        codes = clustered(r, 20, 30)
        array = np.array(codes, np.uint64)
        order = np.argsort(simhash.gray_rank(array))
        label = simhash.joined_classes(np.zeros(len(codes), np.int64), array[order], 4)
        want = classes(len(codes), near([codes[i] for i in order], 4))
        assert label.tolist() == want


def test_gray_rank():
    codes = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(codes ^ (codes >> np.uint64(1))) == codes).all()


@pytest.mark.parametrize(("distance", "most"), [(4, 10**9), (4, 8), (2, 8), (1, 2)])
def test_split_buckets_lose_no_link(spark, distance, most):
    codes = clustered(random.Random(distance), 12, 25)
    signed = [int(np.uint64(c).astype(np.int64)) for c in codes]
    table = spark.createDataFrame([(c,) for c in signed], "code long")
    placed = simhash.buckets(table, distance, most).repartition("key").sortWithinPartitions("key")
    rows = {r.node: r.root for r in connected(simhash.bucket_edges(placed, distance)).collect()}
    by_sign = sorted(range(len(codes)), key=lambda i: signed[i])
    label = classes(len(codes), near([codes[i] for i in by_sign], distance))
    for place, i in enumerate(by_sign):
        assert rows.get(signed[i], signed[i]) == signed[by_sign[label[place]]]


def test_long_chain(spark):
    edges = spark.range(300).select((F.col("id") * 7 % 301).alias("a"), ((F.col("id") + 1) * 7 % 301).alias("b"))
    assert {(r.root) for r in connected(edges).collect()} == {0}
    assert connected(edges.where("a < 0")).count() == 0
    assert connected(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_one_of_each(spark, repeated_dir):
    docs = spark.read.parquet(f"{repeated_dir}/documents.parquet")
    nameless = docs.limit(2).withColumn("doc_id", F.lit(None).cast("long"))
    shared = docs.where("doc_id = 100").withColumn("text", F.lit("another text under an id that is taken, unlike any other here"))
    every = docs.unionByName(nameless).unionByName(shared)
    kept = simhash.keep_one_of_each(every)
    assert kept.columns == docs.columns
    rows = kept.collect()
    names = [r.doc_id for r in rows]
    components = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert names.count(None) == 2 and any(r.text.startswith("another text") for r in rows if r.text)
    own = sorted(r.doc_id for r in rows if r.doc_id is not None and not (r.text or "").startswith("another text"))
    assert own == sorted(components)
    assert sorted(map(str, simhash.keep_one_of_each(every.repartition(7)).collect())) == sorted(map(str, rows))


def signature_set(text):
    """From the definition: every common word, with the next content words after it. The last word of a text counts as content."""
    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    found = set()
    for i, anchor in enumerate(words[:-1]):
        if anchor in spotsigs.ANCHORS:
            chain = [w for k, w in enumerate(words[i + 1 :], i + 1) if w not in spotsigs.ANCHORS or k == len(words) - 1][: spotsigs.CHAIN]
            if len(chain) == spotsigs.CHAIN:
                found.add((anchor, *chain))
    return found or {tuple(words)}


def test_every_anchor_signs(spark):
    texts = ["in the house green tree door", "of the in and one two three", "no common words here now", "the the a b c d", "the", ""]
    sizes = {r.t: r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.size(spotsigs.signatures(F.col("t"))).alias("n")).collect()}
    assert sizes == {t: len(signature_set(t)) for t in texts} and sizes[texts[0]] == 2


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("table", ["edge", "sf"])
def test_fingerprints(spark, edge_dir, table):
    folder = edge_dir if table == "edge" else "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    names = sorted(docs, reverse=True)
    rows = {r.doc_id: r for r in QUERIES["op7_spot_fingerprints"](spark, folder).collect()}
    same = defaultdict(set)
    for k, name in enumerate(names):
        text, after, row = docs[name], docs[names[(k + 1) % len(names)]], rows[name]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert (row.n_chars, row.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        if text.isascii() and edited.isascii() and after.isascii() and "_" not in text + after:
            own = signature_set(text)
            assert abs(row.near_edited - jaccard(own, signature_set(edited))) < 1e-9
            assert abs(row.near_next - jaccard(own, signature_set(after))) < 1e-9
        same[text].add(row.fingerprint)
        same[edited].add(row.edited_fingerprint)
    assert all(len(found) == 1 for found in same.values())


def test_next_document(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "ROWS_IN_BUCKET", 3)
    for names in ([5], [1, 2, 3, 4, 5, 6, 7, 8, 9, 10], [-(2**40), 0, 7, 8, 9, 2**50], [1, 10**15, 10**15 + 1, 10**15 + 2, 10**15 + 3]):
        table = spark.createDataFrame([(n, f"text {n}") for n in names], "doc_id long, text string")
        order = sorted(names, reverse=True)
        want = {n: f"text {order[(k + 1) % len(order)]}" for k, n in enumerate(order)}
        assert {r.id: r.next_text for r in spotsigs.with_next(table, "doc_id", "text").collect()} == want


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_similar_pairs(spark, threshold):
    r = random.Random(9)
    sets = []
    for _ in range(25):
        core = [r.randrange(300) for _ in range(r.randrange(1, 30))]
        sets += [sorted({x if r.random() > 0.12 else r.randrange(300) for x in core}) for _ in range(4)]
    sets += [sets[0]] * 5
    table = spark.createDataFrame(list(enumerate(sets)), "doc_id long, found array<int>")
    pairs, members = spotsigs.similar_pairs(table, threshold)
    classes = {r.doc_id: r.representative for r in members.collect()}
    assert all(sets[k] == sets[v] and v == sets.index(sets[k]) for k, v in classes.items()) and len(classes) == len(sets)
    names = sorted(set(classes.values()))
    want = {frozenset((a, b)) for a in names for b in names if a < b and jaccard(set(sets[a]), set(sets[b])) >= threshold}
    found = [frozenset((p.a, p.b)) for p in pairs.collect()]
    assert set(found) == want and len(found) == len(want) > 5


@pytest.mark.parametrize("table", ["edge", "repeated", "empty", "sf"])
def test_pipeline(spark, edge_dir, repeated_dir, empty_dir, table, tmp_path):
    from tests.llm.test_similar import kept_of

    folder = {"edge": edge_dir, "repeated": repeated_dir, "empty": empty_dir, "sf": "/root/testdata/sf0.001"}[table]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = []
    step = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, step, folder).write.parquet(f"{tmp_path}/{name}")
        step = spark.read.parquet(f"{tmp_path}/{name}")
        stages.append(step)
    assert all(s.columns == docs.columns for s in stages[:3])
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = {r.doc_id: r.text for r in quality.keep_good(docs).select("doc_id", "text").collect()}
    assert {r.doc_id: r.text for r in stages[0].collect()} == want
    names = sorted(want)
    chosen = {names[k] for k in kept_of([want[n] for n in names])}
    assert sorted(r.doc_id for r in stages[1].collect()) == sorted(chosen)
    weights = pii.train(stages[1])
    masked = {n: pii.masked(texts[n], weights) for n in chosen}
    for row in stages[2].collect():
        assert row.text == masked[row.doc_id]
        assert row.n_chars == (len(row.text) if row.text != texts[row.doc_id] else row.n_chars)
        assert not pii.base_matches(row.text)
    lengths = defaultdict(int)
    for row in packed_rows(corpus_pipeline.run(spark, folder)):
        lengths[row.doc_id] += row.length
        assert len(row.ids) == 4 * row.length
    tokenizer = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    assert lengths == {n: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for n, t in masked.items()}


def packed_rows(df):
    assert df.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return df.collect()


def test_fixture_has_near_copies():
    texts = fixtures.texts()
    assert texts.count(texts[len(fixtures.TEXTS)]) > 30
