"""Quality rules, URL rules and shards against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from opslens.llm import quality, sharding, url_filter
from opslens.llm.queries import QUERIES, SQL

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def compared(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = QUERIES[name](spark, folder)
    rows = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)


@pytest.mark.parametrize("name", ["op4_quality_rules", "op9_url_filter"])
def test_sql_on_edge_tables(spark, edge_dir, name):
    compared(spark, edge_dir, name)


def test_quality_counts(spark, edge_dir, edge_rows):
    want = {}
    for name, text in edge_rows:
        words = re.findall("[^\x20\x09-\x0d]+", text or "")
        windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        again = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
        want[name] = (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again), failed)
    for row in QUERIES["op4_quality_rules"](spark, edge_dir).collect():
        assert tuple(row)[1:7] == want[row.doc_id]
        assert not (row.base_failed and row.kept)


def test_cascade_is_the_rules_in_any_order(spark, edge_dir):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    rules = quality.BASE_RULES | quality.OWN_RULES
    text = F.coalesce("text", F.lit(""))
    each = docs.select("doc_id", *[rule(text, quality.words_of(text)).alias(n) for n, rule in rules.items()]).collect()
    want = {r.doc_id for r in each if not any(r[n] for n in rules)}
    for order in (list(rules), list(rules)[::-1], quality.rule_order(docs, rules)):
        assert sorted(order) == sorted(rules)
        kept = docs.where(~quality.cascade(text, rules, order)).select("doc_id").collect()
        assert {r.doc_id for r in kept} == want
    assert {r.doc_id for r in quality.keep_good(docs).select("doc_id").collect()} == want
    assert 20 < len(want) < len(each)


def test_cascade_stops_at_the_first_rejection(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    rules = {"cheap": lambda text, words: F.size(words) < 5, "failing": lambda text, words: F.raise_error(F.lit("reached")).cast("boolean")}
    assert docs.where(quality.cascade(F.col("text"), rules, ["cheap", "failing"])).count() == 1


def test_clean_documents_are_kept(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op4_quality_rules"](spark, folder).collect() if r.doc_id in labels]
    assert all(r.kept for r in rows if labels[r.doc_id] == 1 and not r.base_failed)
    assert sum(r.kept for r in rows if labels[r.doc_id] == 0) <= 0.1 * sum(labels[r.doc_id] == 0 for r in rows)


def judged(url, rules):
    host = path = ""
    if url and (m := re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)):
        host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_urls(spark, edge_dir):
    rows = spark.read.parquet(f"{edge_dir}/pages.parquet").select("page_id", "url").collect()
    want = sorted(((r.page_id, *judged(r.url, RULES)) for r in rows), key=repr)
    assert sorted(map(tuple, QUERIES["op9_url_filter"](spark, edge_dir).collect()), key=repr) == want


@pytest.mark.parametrize("ranges", ["1", "4", "64"])
def test_many_nested_rules(spark, ranges):
    r = np.random.default_rng(1)
    hosts = [".".join(r.choice(["a", "b", "ab", "c"], r.integers(1, 4))) for _ in range(60)]
    paths = ["/" * bool(n) + "".join(r.choice(["x", "/", "xy"], n)) for n in r.integers(0, 5, 60)]
    rules = {(h, p): str(v) for h, p, v in zip(hosts, paths, r.choice(["allow", "block"], 60), strict=True)}
    urls = [f"http://{'.'.join(r.choice(['a', 'b', 'ab', 'c', 'd'], r.integers(1, 5)))}{'/' * bool(n)}{''.join(r.choice(['x', '/', 'xy', 'z'], n))}" for n in r.integers(0, 7, 800)]
    urls += ["http://a.b/xx"] * 400
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules.items()] + [("a", "/x", "allow"), ("a", "/x", "block")], "host string, path string, verdict string")
    rules["a", "/x"] = "block"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = sorted(map(tuple, url_filter.judge_urls(pages, table).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    flat = [(h, p, v) for (h, p), v in rules.items()]
    # Rules of equal length on different hosts tie; the verdict is compared where the longest rule is one.
    for (name, host, path, rule, verdict), url in zip(got, urls, strict=True):
        fits = [(len(h + p), h + p, v) for h, p, v in flat if (host == h or host.endswith("." + h)) and path.startswith(p)]
        longest = {(n, v) for s, n, v in fits if s == max(f[0] for f in fits)}
        assert (rule, verdict) in (longest or {(None, "allow")}), (name, url)


def test_no_rules(spark, edge_dir):
    pages = spark.read.parquet(f"{edge_dir}/pages.parquet")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {(r.rule, r.verdict) for r in url_filter.judge_urls(pages, none, default="block").collect()} == {(None, "block")}


@pytest.mark.parametrize(("dimensions", "bits"), [(1, 4), (2, 3), (3, 3), (2, 5), (4, 2)])
def test_curve_visits_every_cell_in_unit_steps(dimensions, bits):
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dimensions, indexing="ij"), -1).reshape(-1, dimensions)
    index = sharding.hilbert_index(grid, bits)
    assert sorted(index.tolist()) == list(range(len(grid)))
    assert (np.abs(np.diff(grid[np.argsort(index)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("table", ["edge", "repeated", "sf"])
def test_shards(spark, edge_dir, repeated_dir, table):
    folder = {"edge": edge_dir, "repeated": repeated_dir, "sf": "/root/testdata/sf0.001"}[table]
    source = Counter((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{folder}/documents.parquet").collect())
    rows = QUERIES["op3_hilbert_shards"](spark, folder).collect()
    want = Counter({(k, len(t) + 8, zlib.crc32(t)): n for (k, t), n in source.items()})
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_written_shards_prune(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    manifest = sharding.write_shards(docs, f"{tmp_path}/shards").collect()
    assert sum(m.rows for m in manifest) == docs.count() and len(manifest) == 24
    back = spark.read.parquet(f"{tmp_path}/shards").select("row.*")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, docs.collect()))
    reads = [sum(m.lang_min <= lang <= m.lang_max for m in manifest) for lang in ("de", "en", "es", "fr")]
    reads += [sum(m.n_chars_min <= n <= m.n_chars_max for m in manifest) for n in (100, 500, 1000, 5000, 15000)]
    assert np.mean(reads) <= 0.6 * len(manifest)
