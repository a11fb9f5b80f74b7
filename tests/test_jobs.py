import json
import re

from pyspark.sql import functions as F

from opslens import values as V
from opslens.operators import classify as C
from opslens.operators import closure as K
from opslens.operators import corpus as P
from opslens.operators import enrich as E
from opslens.operators import gates as G
from opslens.operators.ordered import position_chunk
from opslens.session import materialize
from opslens.plans import documents as D
from opslens.plans import logs as G2
from opslens.operators import report as R
from opslens.sources import corpus as SC
from opslens.sources import landing as L


def rows(df):
    return sorted(tuple(r) for r in df.collect())


DOCS = {
    "a/one.md": "a line that is long enough to be shared\nshort\na line that is long enough to be shared\n[n](two.md) [x](../b/three.md)",
    "a/two.md": "  a line that is long enough to be shared  \nexactly twenty chars\n",
    "b/three.md": "exactly twenty chars\nthis line only occurs in one document\n[n](gone.md) and [again](../a/two.md)\n[z](../a/two.md)",
}


def documents(spark, docs=DOCS):
    return spark.createDataFrame(list(docs.items()), "path string, content string")


def test_line_redundancy(spark):
    docs = documents(spark)
    assert rows(P.line_redundancy(docs)) == [("a line that is long enough to be shared", 3, 2)]
    assert rows(P.line_postings(docs)) == [
        ("a line that is long enough to be shared", "a/one.md", 2), ("a line that is long enough to be shared", "a/two.md", 1),
    ]
    assert rows(P.redundancy_summary(docs)) == [(1, 3)]


def test_lines_that_occur_once_stay_where_they_are(spark):
    docs = spark.range(300).select(
        F.col("id").alias("path"), F.concat(F.lit("a line that all documents share\na line of document number "), "id", F.lit("\nshort")).alias("content")
    )
    lines = P._line_counts(docs, "content", 20)
    marks = P.repeated_slots(lines)
    left = P.may_repeat(lines, marks)
    assert marks.count() == P.SKETCH_ROWS and left.count() == 300 and left.select("line").distinct().count() == 1
    for slots in (1, 64, 4096):  # crowded counters let more lines pass, with the same result
        assert P.line_redundancy(docs, slots=slots).collect() == [("a line that all documents share", 300, 300)]
        assert P.line_postings(docs, slots=slots).count() == 300


def test_many_tools(spark):
    """The index against the row-wise match: short, empty, missing and overlapping keywords."""
    import random

    r = random.Random(5)
    word = lambda n: "".join(r.choice("abCd/") for _ in range(n))
    tools = [(f"t{i}", r.choice([None, [], [word(r.randrange(6)) for _ in range(r.randrange(4))] + [None] * r.randrange(2)])) for i in range(300)]
    tools = spark.createDataFrame(tools, "name string, force_if_keywords array<string>")
    stacks = spark.createDataFrame([(i, r.choice([None, "", "c"] + [word(20)] * 9)) for i in range(60)], "project long, stack string")
    got = C.forced_by_index(stacks, tools)
    want = stacks.crossJoin(tools).where(C.is_forced(F.struct("force_if_keywords"), F.col("stack")))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())) and want.count() > 100
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    for hot in (1, 7):  # runs dealt to several tasks
        some = C.forced_by_index(stacks, tools, hot=hot)
        assert sorted(map(str, some.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString()  # the pairs are not made distinct by moving them
    assert C.forced_by_index(stacks, tools.where("false")).isEmpty() and C.forced_by_index(stacks.where("false"), tools).isEmpty()


def test_many_tools_with_one_common_keyword(spark):
    """Pairs of the most common keyword are made without a look at the text, in generated code."""
    numbers = spark.range(400)
    stacks = numbers.select(F.col("id").alias("project"), F.concat(F.lit("Common words "), "id").alias("stack"))
    words = F.array(F.concat(F.lit("S "), "id"), F.concat(F.lit("missing"), "id"), F.lit("COMMON words"))
    tools = numbers.select(F.concat(F.lit("t"), "id").alias("name"), words.alias("force_if_keywords"))
    for most_pairs in (C.MOST_PAIRS, 5000):  # 32 parts
        got = C.forced_by_index(stacks, tools, most_pairs=most_pairs).select("project", "name")
        found = got.collect()
        assert len(found) == len(set(found)) == 400 * 400
        plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert re.search(r"\*\(\d+\) SortMergeJoin", plan) and "exists(" not in plan


def test_many_tools_with_many_keywords(spark, monkeypatch):
    """Long lists, long keywords that share their runs, characters of several bytes and rows that come twice."""
    import random

    r = random.Random(6)
    word = lambda n: "".join(r.choice("aBé") for _ in range(n))
    tools = [(f"t{i % 90}", [r.choice([None, word(r.randrange(1, 12))]) for _ in range(r.randrange(9))]) for i in range(100)]
    tools += tools[:5] + [("none", None), ("any", ["zzz", ""])]
    tools = spark.createDataFrame(tools, "name string, force_if_keywords array<string>")
    stacks = [(i, r.choice([None, ""] + [word(60)] * 9)) for i in range(50)]
    stacks = spark.createDataFrame(stacks + stacks[:5], "project long, stack string")
    want = stacks.crossJoin(tools).where(C.is_forced(F.struct("force_if_keywords"), F.col("stack")))
    wanted = sorted(map(str, want.collect()))
    assert len(wanted) > 500
    measured = C.sized
    for limit, hot, most_pairs in ((1000, C.HOT_RUN, C.MOST_PAIRS), (0, 3, 20)):  # lookups broadcast, and none
        monkeypatch.setattr(C, "sized", lambda df, name, limit=limit: measured(df, name, limit))
        got = C.forced_by_index(stacks, tools, hot=hot, most_pairs=most_pairs)
        assert sorted(map(str, got.select(want.columns).collect())) == wanted


def test_recovered_variants(spark):
    from opslens.functions.jsontext import recover_variant

    texts = ['x ```json\n{"a": {"new": [1, "z"]}, "b": null}``` y', '{"a": 1} {"b": 2}', "{broken", "[1]", "no", None, '{"a": 1}, {"b": 2}', "{}"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select(F.to_json(recover_variant(F.col("t"))).alias("v"), F.to_json(recover_variant(F.col("t"), F.parse_json(F.lit('{"f": 1}')))).alias("w")).collect()
    assert [r["v"] for r in got] == ['{"a":{"new":[1,"z"]},"b":null}', None, None, None, None, None, None, "{}"]
    assert {r["w"] for r in got[1:7]} == {'{"f":1}'}


def test_model_counts(spark):
    rows_ = spark.range(30000).select((F.col("id") % 3).alias("k"), (F.col("id") % 4).alias("day"), F.concat(F.lit("m"), F.floor(F.col("id") / 2)).alias("m"))
    exact = {r["k"]: r["models"] for r in E.model_counts(rows_, ["k"], F.col("m")).collect()}
    assert exact == {0: 10000, 1: 10000, 2: 10000}
    for r in E.merged_counts(E.model_counts(rows_, ["k", "day"], F.col("m")), ["k"]).collect():
        assert r["least"] <= 10000 <= r["most"] and r["most"] - r["least"] < 1100
    assert E.model_counts(rows_.withColumn("m", F.lit(None).cast("string")), ["k"], F.col("m")).first()["models"] == 0


def test_reference_payload(spark):
    docs = documents(spark)
    sizes = P.token_counts(docs).withColumnRenamed("path", "doc")
    size = {d: max(1, len(t) // 4) for d, t in DOCS.items()}
    links = P.markdown_reference_links(docs)
    assert rows(links) == [
        ("a/one.md", "a/two.md"), ("a/one.md", "b/three.md"), ("b/three.md", "a/two.md"), ("b/three.md", "a/two.md"), ("b/three.md", "b/gone.md"),
    ]
    assert rows(P.reference_payload(sizes, links)) == [
        ("a/one.md", 2, size["a/one.md"] + size["a/two.md"] + size["b/three.md"]),
        ("a/two.md", 0, size["a/two.md"]),
        ("b/three.md", 2, size["b/three.md"] + 2 * size["a/two.md"]),
    ]


def test_bundles(spark):
    files = spark.createDataFrame(
        [("p", "w/architecture.md", "A"), ("p", "w/index.md", "I"), ("p", "w/sub/index.md", "S"), ("p", "w/z.md", "Z"), ("p", "w/z.txt", "T"), ("q", "w/z.md", "Z")],
        "project string, path string, content string",
    )
    assert rows(P.core_bundle(files, ["project"], "w/")) == [("p", "=== INDEX.MD ===\nI\n\n=== ARCHITECTURE.MD ===\nA")]
    assert rows(P.core_bundle(files, ["project"], "w/sub")) == [("p", "=== INDEX.MD ===\nS")]
    assert rows(P.core_bundle(files, ["project"])) == []
    bundle = P.core_bundle(files.withColumn("home", F.lit("w")), ["project"], F.col("home"))
    assert bundle.count() == 1 and "SortAggregate" not in bundle._jdf.queryExecution().executedPlan().toString()
    assert rows(P.full_bundle(files, ["project"], F.ascii(F.substring("path", 3, 1)))) == [
        ("p", 1, "=== ARCHITECTURE.MD ===\nA"), ("p", 2, "=== INDEX.MD ===\nI"), ("p", 3, "=== INDEX.MD ===\nS"),
        ("p", 4, "=== Z.MD ===\nZ"), ("q", 1, "=== Z.MD ===\nZ"),
    ]


def test_first_location(spark):
    files = spark.createDataFrame([("p", "b/x.md"), ("p", "c/y.md"), ("q", "c/z.md"), ("r", "bb/z.md")], "project string, path string")
    assert rows(P.in_first_location(files, ["project"], ["a", "b", "c/"])) == [("p", "b/x.md"), ("q", "c/z.md")]


def test_classify(spark):
    files = [
        ("js", "package.json"), ("ts", "package.json"), ("ts", "tsconfig.json"), ("go", "a/go.mod"), ("deep", "a/b/go.mod"),
        ("none", "README"), ("mix", "setup.py"), ("mix", "x/Cargo.toml"), ("mix", "pyproject.toml"),
    ]
    got = dict(rows(C.classify_projects(spark.createDataFrame(files, "project string, path string"))))
    assert got == {
        "js": "Frontend, Node.js/JavaScript", "ts": "Frontend, Node.js/TypeScript", "go": "Go", "deep": "Unknown Stack",
        "none": "Unknown Stack", "mix": "Python, Rust",
    }


REGISTRY = json.dumps(
    {
        "categories": {
            "frontend": [
                {"name": "styles", "url": "http://styles", "keywords": ["react"]},
                {"name": "browser", "command": "npx browser", "type": "mcp", "force_if_keywords": ["FrontEnd"]},
                {"name": "browser-notes", "url": "http://notes", "type": "skill", "force_if_keywords": ["frontend", "go"]},
            ],
            "backend": [{"name": "server", "url": "http://server", "force_if_keywords": ["python"]}],
        }
    }
)


def test_tools(spark):
    registry = spark.createDataFrame([(REGISTRY,), ("broken",)], "registry string")
    assert [r["name"] for r in L.tool_rows(registry).collect()] == ["styles", "browser", "browser-notes", "server"]
    assert {r["category"] for r in L.tool_rows(registry).collect()} == {"frontend", "backend"}
    stacks = spark.createDataFrame([("p", "Frontend, Node.js/JavaScript"), ("q", "Python"), ("r", "Rust")], "project string, stack string")
    tools = L.registry_tools(F.lit(REGISTRY))
    forced = C.forced_tools(stacks, tools)
    assert rows(forced.select("project", "position", "name")) == [("p", 1, "browser"), ("p", 2, "browser-notes"), ("q", 3, "server")]
    text = {r["project"]: (r["skills_md"], r["mcps_md"]) for r in C.forced_checklists(stacks, tools).collect()}
    assert text["p"] == ("- [x] browser-notes (http://notes) <!-- type:skill -->", "- [x] browser (npx browser)")
    assert text["q"] == ("- [x] server (http://server) <!-- type:skill -->", "- [ ] No MCPs recommended")
    assert text["r"] == ("- [ ] No skills recommended", "- [ ] No MCPs recommended")
    skills, mcps = C.split_by_type(forced)
    assert skills.count() == 2 and mcps.count() == 1

    recommended = spark.createDataFrame(
        [("p", 5, "extra"), ("p", 3, "browser"), ("p", 1, "other"), ("p", 4, "extra"), ("r", 1, "browser")],
        "project string, position bigint, name string",
    )
    merged = C.merge_recommended(forced.select("project", "position", "name"), recommended, ["project"])
    assert rows(merged.select("project", "origin", "position", "name")) == [
        ("p", 0, 1, "browser"), ("p", 0, 2, "browser-notes"), ("p", 1, 1, "other"), ("p", 1, 4, "extra"), ("q", 0, 3, "server"),
        ("r", 1, 1, "browser"),
    ]


def test_gates(spark):
    plan, other, log = V.PLAN_CANDIDATES[0], V.PLAN_CANDIDATES[1], V.FAILING_TEST_LOG
    files = [
        ("ok", plan, "## Verification Criteria"), ("ok", log, "ERROR: file"), ("ok", V.DIAGNOSIS_REPORT, "It is Reproducible"),
        ("ok", V.REVIEW_REPORT, ""), ("ok", V.QA_REPORT, ""),
        ("plan", other, "text"), ("bad", other, "## Sphinch Marks"), ("bad", log, "all fine"), ("bad", V.DIAGNOSIS_REPORT, "?"),
        ("both", plan, "text"), ("both", other, "## Sphinch Marks"), ("empty", "other.txt", "FAILED"),
    ]
    df = spark.createDataFrame(files, "workspace string, path string, content string")
    gate = lambda p: {r["workspace"]: (r["passed"], r["violations"]) for r in G.artifact_gate(df, p).collect()}
    four = gate(4)
    assert four["ok"] == (True, []) and four["plan"] == (False, [V.NO_FAILING_TEST % log])
    assert four["bad"] == (False, [V.NO_FAILURE_IN_LOG % log]) and len(four["empty"][1]) == 2
    one = gate(1)
    assert one["ok"][0] and one["bad"][1] == [V.WEAK_DIAGNOSIS % V.DIAGNOSIS_REPORT] and one["plan"][1] == [V.NO_DIAGNOSIS % V.DIAGNOSIS_REPORT]
    three = gate(3)
    assert three["ok"][0] and three["bad"][0] and three["both"][1] == [V.WEAK_PLAN % plan] and not three["empty"][0] and not three["plan"][0]
    assert gate(5)["ok"] == (True, []) and len(gate(5)["bad"][1]) == 2
    assert rows(G.preferred_artifact(df, V.PLAN_CANDIDATES).select("workspace", "path")) == [
        ("bad", other), ("both", plan), ("ok", plan), ("plan", other),
    ]


def test_enrichment(spark):
    skeleton = spark.createDataFrame([("h1", "Foo"), ("h2", "Bar")], "id string, name string")
    enrichment = spark.createDataFrame([("h1", "A class"), ("h9", "stray")], "id string, summary string")
    assert rows(E.merge_enrichment(skeleton, enrichment)) == [("h1", "Foo", "A class", "merged")]
    kept = E.merge_enrichment(skeleton, enrichment, on_missing="fallback").orderBy("id").collect()
    assert [(r["id"], r["summary"], r["source_kind"]) for r in kept] == [("h1", "A class", "merged"), ("h2", None, "ast_fallback")]
    assert rows(E.missing_ids(skeleton, enrichment)) == [("h2",)]
    runs = spark.createDataFrame([("r", 5, 0.5, "b"), ("r", 7, 0.25, "a"), ("r", 1, 0.0, "b")], "run string, t bigint, c double, m string")
    got = E.run_metadata(runs, ["run"], F.col("t"), F.col("c"), F.col("m")).first()
    assert (got["total_tokens"], float(got["total_cost"]), got["models_used"]) == (13, 0.75, "a, b")


def test_include_closure(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), ("a", "b"), ("d", "e")]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = rows(K.include_closure(df, spark.createDataFrame([("a",), ("d",), ("x",)], "root string")))
    assert got == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("a", "e", 4), ("d", "e", 1)]
    every = df.select(F.col("src").alias("root"))
    assert rows(K.include_closure(df, every, max_depth=1)) == sorted((s, d, 1) for s, d in set(edges) if s != d)


def expanded_text(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["root"], r["position"])):
        out.setdefault(r["root"], []).append(r["line"])
    return {k: "\n".join(v) for k, v in out.items()}


def test_expand_includes(spark):
    docs = {
        "r.md": "top\n@sub/a.md\nend",
        "sub/a.md": "in a\n  @ ../b.md  \n@../b.md\n@missing.md\n@agent",
        "b.md": "in b\n@sub/a.md\n@empty.md\n@b.md\n",
        "empty.md": "",
    }
    got = expanded_text(K.expand_includes(documents(spark, docs)))

    def expand(path, opened):
        import os.path as p

        out = []
        for line in docs[path].splitlines():
            bare = line.strip()
            target = p.normpath(p.join(p.dirname(path), bare[1:].strip())) if bare.startswith("@") and bare[1:2] != " " else None
            out.append(expand(target, [*opened, target]) if target in docs and target not in opened else line)
        return "\n".join(out)

    assert got == {path: expand(path, [path]) for path in docs}
    assert rows(K.edge_table(documents(spark, docs))) == [
        ("b.md", "b.md"), ("b.md", "empty.md"), ("b.md", "sub/a.md"), ("r.md", "sub/a.md"), ("sub/a.md", "b.md"),
    ]


def test_inline_templates(spark):
    docs = {"r.md": "go\n@part.txt\n@x.log", "part.txt": "- glob {{HARNESS_DIR}} " + V.FOLDER_MENTION + "\n@r.md", "x.log": "noise", "s.py": "@r.md"}
    got = expanded_text(D.inline_templates(documents(spark, docs), "claude", ".c"))
    assert got == {"r.md": "go\n- Glob .c " + V.FOLDER_MENTION + "\n@r.md\n@x.log"}


def test_deep_chain_and_hot_include(spark):
    """A chain of more than 64 documents, and a document that all others include."""
    docs = {f"c{i}.md": f"line {i}\n@c{i + 1}.md" for i in range(70)} | {"c70.md": "end"}
    chain = K.expand_includes(documents(spark, docs), roots=F.col("path") == "c0.md").collect()
    assert sorted(r["line"] for r in chain) == sorted([f"line {i}" for i in range(70)] + ["end"])
    docs = {f"d{i}.md": f"own {i}\n@all.md" for i in range(40)} | {"all.md": "shared\n@deep.md", "deep.md": "below"}
    for hot in (5, 10**6):
        got = expanded_text(K.expand_includes(documents(spark, docs), hot=hot))
        assert got["d7.md"] == "own 7\nshared\nbelow" and len(got) == 42


def include_graph(r, n, more):
    """Documents that include later ones, and ``more`` lines that include any."""
    docs = {}
    for i in range(n):
        lines = [f"text {i}"] + [f"@g{r.randrange(i + 1, n)}" for _ in range(r.randrange(3)) if i + 1 < n] + ["@nothing", "last"]
        docs[f"g{i}"] = lines
    for _ in range(more):
        docs[f"g{r.randrange(n)}"].insert(1, f"@g{r.randrange(n)}")
    return {k: "\n".join(v) for k, v in docs.items()}


def test_include_graphs_against_recursion(spark):
    import random

    def expand(docs, path, opened):
        lines = []
        for line in docs[path].split("\n"):
            target = line[1:]
            lines += expand(docs, target, [*opened, target]) if line[0] == "@" and target in docs and target not in opened else [line]
        return lines

    def depths(edges, root):
        found, last, depth = {}, {root}, 0
        while last:
            depth += 1
            last = {b for a, b in edges if a in last} - found.keys() - {root}
            found |= {b: depth for b in last}
        return {(root, b, d) for b, d in found.items()}

    for seed, more in ((1, 0), (3, 8)):
        docs = include_graph(random.Random(seed), 14, more)
        want = {path: "\n".join(expand(docs, path, [path])) for path in docs}
        files = documents(spark, docs)
        assert expanded_text(K.expand_includes(files)) == want
        some = expanded_text(K.expand_includes(files, roots=F.col("path").isin("g0", "g3")))
        assert some == {k: want[k] for k in ("g0", "g3")}
        for roots in (None, F.col("path").isin("g0", "g3")):
            told = K.expand_includes(files, roots=roots, numbered=True).collect()
            levels = sorted((r["root"], tuple(r["position"])) for r in K.expand_includes(files, roots=roots).collect())
            assert [r["level"] for r in sorted(told, key=lambda r: (r["root"], r["at"]))] == [len(p) - 1 for _, p in levels]
            assert sorted((r["root"], r["at"], r["line"]) for r in told) == sorted(
                (k, at, line) for k in (some if roots is not None else want) for at, line in enumerate(want[k].split("\n"))
            )
        edges = {(k, line[1:]) for k, v in docs.items() for line in v.split("\n") if line[0] == "@" and line[1:] in docs}
        for roots in (list(docs), ["g2", "g5", "none"]):
            got = K.include_closure(K.edge_table(files), spark.createDataFrame([(x,) for x in roots], "root string")).collect()
            assert sorted(map(tuple, got)) == sorted(p for root in roots for p in depths(edges, root)), (seed, roots)


def test_shared_includes_are_found_once(spark, monkeypatch):
    """Diamonds: each document includes the next one twice. Rows written follow the places of the result, rounds the log of the depth."""
    tables = []

    def counted(df, name):
        made = materialize(df, name)
        tables.append((name, made.count()))
        return made

    monkeypatch.setattr(K, "materialize", counted)
    docs = {f"d{i}": f"text\n@d{i + 1}\n@d{i + 1}" for i in range(9)} | {"d9": "text"}
    lines = K.expand_includes(documents(spark, docs))
    assert lines.groupBy("root").count().where("root = 'd0'").first()["count"] == 2**10 - 1
    places = [n for name, n in tables if name == "places"]
    assert sum(places) == lines.count() - len(docs) and len(places) <= 6
    tables.clear()
    chain = {f"c{i}": f"text\n@c{i + 1}" for i in range(64)} | {"c64": "text"}
    assert K.expand_includes(documents(spark, chain), roots=F.col("path") == "c0").count() == 65
    assert len([n for name, n in tables if name == "places"]) <= 8
    tables.clear()
    edges = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert K.include_closure(edges, spark.createDataFrame([(0,)], "root long")).count() == 200
    assert len([n for name, n in tables if name == "pairs"]) <= 10


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounds_of_includes_are_not_broadcast(spark, monkeypatch):
    """Tables of the rounds are tiny as files whatever they hold; positions of a chain take two numbers, not the way."""
    plans = []

    def planned(df, name):
        plans.append(plan_of(df))
        return materialize(df, name)

    monkeypatch.setattr(K, "materialize", planned)
    chain = documents(spark, {f"c{i}": f"text {i}\n@c{i + 1}" for i in range(9)} | {"c9": "end"})
    lines = K.expand_includes(chain, roots=F.col("path") == "c0", numbered=True)
    assert sorted((r["at"], r["level"], r["line"]) for r in lines.collect()) == [(i, i, f"text {i}") for i in range(9)] + [(9, 9, "end")]
    edges = spark.range(50).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    for roots in (spark.createDataFrame([(0,)], "root long"), spark.range(50).withColumnRenamed("id", "root")):
        plans.append(plan_of(K.include_closure(edges, roots)))
    assert "Broadcast" not in "".join([*plans, plan_of(lines)])


def test_many_labels(spark):
    markers = {f"f{i}": f"label{i:03d}" for i in range(100)}
    files = spark.createDataFrame([("p", f"f{i}") for i in range(100)] + [("q", "x"), (None, "f1")], "project string, path string")
    got = {r["project"]: r["stack"] for r in C.classify_projects(files, markers=markers).collect()}
    assert got["p"] == ", ".join(sorted(markers.values())) and got["q"] == V.UNKNOWN_STACK and got[None] == "label001"


def test_document_plans(spark):
    content = "\n## Proposed Skills\n- [x] one (u1) <!-- type:extension -->\n- [ ] two (u2)\n- [X] three (u3)\n## Proposed MCP Tools\n- [x] m (npx m)\n"
    docs = spark.createDataFrame([("d", content), ("e", "")], "doc string, content string")
    assert rows(D.parse_checklists(docs)) == [
        ("d", "mcp", 1, "m", "npx m", "mcp"), ("d", "skill", 1, "one", "u1", "extension"), ("d", "skill", 2, "three", "u3", "skill"),
    ]
    files = spark.createDataFrame(
        [("x/a.md", "{{HARNESS_DIR}} - glob @boilerplate-agent"), ("x/a.py", "glob"), (".git/a.md", "glob"), ("b.log", "x")], "path string, content string"
    )
    assert rows(D.render_templates(files, "claude", ".c")) == [("x/a.md", ".c - Glob .c"), ("x/a.py", "glob")]
    rules = spark.createDataFrame([("r/dispatch_rules.md", "a **Negative Routing Rules**"), ("r/o.md", "**Negative Routing Rules")], "path string, content string")
    noted = dict(rows(D.inject_routing(rules, F.array(F.lit("m"), F.lit("n")))))
    assert "(`@m`, `@n`)" in noted["r/dispatch_rules.md"] and noted["r/o.md"] == "**Negative Routing Rules"
    replies = spark.createDataFrame(
        [('Here: {"sme_name": "Boss", "core_domain_value": "v", "invariants": ["i", "j"], "glossary": {"t": "d"}, "domain_events": ["e"]}',), ("no",)],
        "reply string",
    )
    template = F.lit("{{SME_NAME}}|{{CORE_DOMAIN_VALUE}}|{{INVARIANTS}}|{{GLOSSARY}}|{{DOMAIN_EVENTS}}")
    filled = [r["document"] for r in D.fill_documents(D.with_profile(replies), template, D.profile_slots(F.col("profile"))).collect()]
    assert filled[0] == "boss|v|1. i\n2. j|*   **t**: d|*   **e**"
    assert filled[1].startswith("domain-sme|[USER INPUT REQUIRED]|1. [USER")
    merged = spark.range(1).select(
        D.merged_maps(F.create_map(F.lit("a"), F.lit(1), F.lit("b"), F.lit(2)), F.create_map(F.lit("b"), F.lit(3))).alias("m")
    )
    assert merged.first()["m"] == {"a": 1, "b": 3}
    sections = D.extract_domain_sections(spark.createDataFrame([("d", "Domain Invariants\nRule [USER INPUT REQUIRED]")], "doc string, content string"))
    assert rows(sections) == [("d", "domain-sme", "Rule [USER INPUT REQUIRED]", "None provided.", True)]


def test_file_sources(spark, tmp_path):
    (tmp_path / "w" / "sub").mkdir(parents=True)
    (tmp_path / "w" / "index.md").write_text("one\ntwo")
    (tmp_path / "w" / "sub" / "b.md").write_text("three")
    (tmp_path / "w" / "run.log").write_text("\n".join(f"l{i}" for i in range(500)))
    (tmp_path / "w" / "sub" / "a b+ü%20.md").write_text("odd")
    docs = SC.read_documents(spark, str(tmp_path / "w"))
    assert sorted(map(tuple, docs.collect())) == [
        ("index.md", "one\ntwo", None), ("sub/a b+ü%20.md", "odd", None), ("sub/b.md", "three", None),
    ]
    lines = SC.line_rows(docs.where(F.col("path") == "index.md"))
    assert [(r["line_no"], r["line"]) for r in lines.collect()] == [(0, "one"), (1, "two")]
    log = SC.read_log_lines(spark, str(tmp_path / "w"), "*.log").orderBy("block", "line_no")
    assert [r["line"] for r in log.collect()] == [f"l{i}" for i in range(500)]
    assert SC.read_manifest(spark, str(tmp_path / "w")).count() == 4
    by_project = SC.read_manifest(spark, str(tmp_path), by_project=True)
    assert {(r["project"], r["path"]) for r in by_project.collect()} >= {("w", "index.md"), ("w", "sub/b.md")}
    (tmp_path / "w" / "package.json").write_text("{}")
    (tmp_path / "w" / "sub" / "go.mod").write_text("module x")
    stacks = dict(rows(C.classify_projects(SC.read_manifest(spark, str(tmp_path), by_project=True))))
    assert stacks["w"] != V.UNKNOWN_STACK
    manifest = spark.createDataFrame([("p", "b/wiki"), ("p", "c/wiki"), ("q", "x")], "project string, path string")
    assert rows(SC.first_existing(manifest, ["a/wiki", "b/wiki", "c/wiki"], ["project"]).where("location is not null")) == [("p", "b/wiki")]
    assert SC.within_depth(spark.createDataFrame([("a/b/c",), ("a/b",), ("a",)], "path string")).count() == 2
    assert position_chunk("x") is not None


def test_log_plans(spark):
    text = "a  \n  at f()\nvenv/x\nError: y\nvenv/z"
    logs = spark.createDataFrame([("l", text)], "doc string, content string")
    assert G2.extract_first_error_text(logs).first()["trace"] == "a\n  at f()\nvenv/x\nError: y\nvenv/z"
    assert G2.prune_log_text(logs).first()["pruned"] == "a  \n  at f()\nvenv/x\nError: y"
    lines = SC.line_rows(logs)
    step = position_chunk("line_no", 2)
    got = G2.extract_first_error(lines, ["doc"], ["line_no"], step, keep=3).orderBy("line_no")
    assert [r["line"] for r in got.collect()] == ["a", "  at f()", "venv/x"]
    got = G2.prune_log_lines(lines, ["doc"], ["line_no"], step).orderBy("line_no")
    assert [r["line"] for r in got.collect()] == ["a  ", "  at f()", "venv/x", "Error: y"]


def test_snapshot(spark, tmp_path):
    rows = spark.createDataFrame([("a", {"k": "v"})], "name string, terms map<string,string>")
    R.write_snapshot(rows, str(tmp_path / "s"))
    assert json.loads(spark.read.text(str(tmp_path / "s")).first()[0]) == {"name": "a", "terms": {"k": "v"}}


def test_unreadable_file_is_a_row(spark, tmp_path):
    (tmp_path / "good.md").write_text("fine")
    bad = tmp_path / "bad.md.gz"
    bad.write_bytes(b"\x1f\x8b not really gzip")
    got = sorted(map(tuple, SC.read_documents(spark, str(tmp_path), "*").collect()))
    assert got == [("bad.md.gz", None, V.UNREADABLE_FILE), ("good.md", "fine", None)]


def test_every_file_is_a_row(spark, tmp_path):
    """Empty, hidden, undecodable and vanished files; the tokens of an empty one count, as do all files."""
    from opslens.sources import files as T

    (tmp_path / "deep" / ".hidden").mkdir(parents=True)
    (tmp_path / "empty.md").write_text("")
    (tmp_path / "deep" / ".hidden" / "x.md").write_text("ä")
    (tmp_path / "deep" / "latin.md").write_bytes("ä".encode("latin-1"))
    (tmp_path / "deep" / "other.txt").write_text("no")
    (tmp_path / "deep" / "gone.md").symlink_to(tmp_path / "nowhere.md")
    docs = SC.read_documents(spark, f"file:{tmp_path}")
    got = rows(docs.fillna(""))
    assert got[:2] == [("deep/.hidden/x.md", "ä", ""), ("deep/latin.md", "", V.UNREADABLE_FILE)] and ("empty.md", "", "") in got
    assert rows(P.token_counts(docs.where("error IS NULL"))) == [("deep/.hidden/x.md", 1), ("empty.md", 1)]
    manifest = {(r["project"], r["path"]): r["length"] for r in SC.read_manifest(spark, str(tmp_path), by_project=True).collect()}
    assert manifest[None, "empty.md"] == 0 and manifest["deep", "other.txt"] == 2
    reader = T.FileTreeReader({"path": str(tmp_path)}, "path string, length bigint, modified timestamp, content string, error string")
    missing = T.Listed(f"{tmp_path}/never.md", 5, reader.partitions()[0].files[0].modified)
    assert reader.row(*[T.opened(str(tmp_path))[0], missing, "never.md"])["error"] == V.UNREADABLE_FILE


def test_files_are_dealt_in_like_shares():
    import random

    from opslens.sources import files as T

    r = random.Random(3)
    files = [T.Listed(f"f{i}", int(r.paretovariate(0.7) * 1000), None) for i in range(3000)]
    total, most = sum(f.size + T.FILE_COST for f in files), max(f.size for f in files)
    dealt = T.shares(files, 16 * T.FILE_COST, 1)
    loads = [sum(f.size + T.FILE_COST for f in share.files) for share in dealt]
    assert sorted(f.path for share in dealt for f in share.files) == sorted(f.path for f in files)
    assert max(loads) <= max(most, total / len(dealt)) + 16 * T.FILE_COST
    assert len(T.shares(files, 10**15, 8)) == 8 and len(T.shares(files[:3], 1, 8)) == 3 and T.shares([], 1, 8)[0].files == []


def test_malformed_lines_are_reported(spark, tmp_path):
    from opslens.plans.weekly_report import weekly_report
    from opslens.sources import landing as L

    for name, line in (("usage", '{"provider": "openai", "has_key": tru'), ("costs", "nonsense"), ("activity", '{"repo": 5,')):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text(line + "\n\n")
    activity, usage, costs = (f(spark, str(tmp_path / n)) for f, n in ((L.read_activity, "activity"), (L.read_usage, "usage"), (L.read_costs, "costs")))
    assert [r["malformed"] is not None for df in (activity, usage, costs) for r in df.collect()] == [True] * 3
    projects = L.projects(spark.createDataFrame([('{"p": {"repo": "o/r"}}',)], "config string"))
    for source in ("activity", "usage", "costs"):
        empty = lambda name, df: df if name == source else df.where("false")  # noqa: B023, E731
        report = weekly_report(projects, empty("activity", activity), empty("usage", usage), empty("costs", costs), as_of="2024-03-10T00:00:00Z")
        assert V.MALFORMED_RECORD in str(report.first()["warnings"]), source


def test_unknown_source_is_kept(spark):
    from opslens.operators import metrics as M

    rows_ = [("a", "2024-01-01T00:00:00Z", 1), ("sixth", "2024-01-02T00:00:00Z", 2), (None, None, 3), ("a", "2024-01-03T00:00:00Z", 4)]
    df = spark.createDataFrame(rows_, "provider string, fetched_at string, x int")
    assert {(r["provider"], r["x"]) for r in M.latest_per_source(df).collect()} == {("a", 4), ("sixth", 2), (None, 3)}
    assert {r["provider"] for r in M.latest_per_source(df, sources=["a"]).collect()} == {"a"}
