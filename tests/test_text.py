import re

from pyspark.sql import functions as F

from opslens import values as V
from opslens.functions import jsontext, markdown, paths, temporal
from opslens.functions import text as T
from opslens.functions.money import amount, rounded


def column(spark, rows, build, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("x"))).collect()]


ODD_TEXT = [
    "", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1ee\x85f g h", "  x \xa0", "　\x1f y\t\n", "é  ñ",
]


def test_document_lines_and_strip_equal_python(spark):
    assert column(spark, ODD_TEXT, T.document_lines) == [t.splitlines() for t in ODD_TEXT]
    assert column(spark, ODD_TEXT, T.strip) == [t.strip() for t in ODD_TEXT]
    assert column(spark, ODD_TEXT, T.rstrip) == [t.rstrip() for t in ODD_TEXT]


def test_token_estimates(spark):
    texts = ["", "abc", "abcd", "é" * 9, None]
    assert column(spark, texts, T.tokens_floor) == [0, 0, 1, 2, 0]
    assert column(spark, texts, T.tokens_at_least_one) == [1, 1, 1, 2, 1]
    assert column(spark, texts, T.tokens) == [0, 1, 1, 2, 0]


def test_slug(spark):
    names = ["ArchitectureDeepener", "InfraManager", "ReaderAgent", "HTTPServer v2", "--a__b--", "X"]
    expected = ["architecture-deepener", "infra-manager", "reader-agent", "http-server-v2", "a-b", "x"]
    assert column(spark, names, T.slug) == expected


def test_stable_id(spark):
    df = spark.createDataFrame([("Foo", "class Foo", 1), ("Foo", None, None)], "n string, s string, l int")
    got = [r[0] for r in df.select(T.stable_id(F.col("n"), F.col("s"), F.col("l"))).collect()]
    import hashlib

    assert got == [hashlib.sha256(b"Foo:class Foo:1").hexdigest()[:12], hashlib.sha256(b"Foo::0").hexdigest()[:12]]


def test_replacements_apply_in_order(spark):
    rules = [("{{HARNESS_DIR}}", ".x"), ("- replace", "- Edit"), ("replace", "Edit"), ("Edit", "E")]
    texts = ["- replace then replace in {{HARNESS_DIR}}"]
    assert column(spark, texts, lambda c: T.replace_in_order(c, rules)) == ["- E then E in .x"]
    as_column = F.array(*[F.struct(F.lit(o).alias("old"), F.lit(n).alias("new")) for o, n in rules])
    assert column(spark, texts, lambda c: T.replace_in_order_from(c, as_column)) == ["- E then E in .x"]
    assert T.platform_rules("claude", "d")[:3] == [("{{HARNESS_DIR}}", "d"), ("@boilerplate-agent", "d"), ("- read_file", "- Read")]
    assert T.platform_rules("gemini", "d")[-1] == ("{{SUBAGENT_SYNTAX}}", "@")


def test_lists(spark):
    df = spark.range(1)
    got = df.select(
        T.numbered_list(F.array(F.lit("a"), F.lit("b"))),
        T.term_list(F.create_map(F.lit("k"), F.lit("v"))),
        T.bold_list(F.array(F.lit("e"))),
        T.numbered_list(F.array().cast("array<string>")),
    ).first()
    assert tuple(got) == ("1. a\n2. b", "*   **k**: v", "*   **e**", "")


LOGS = {
    "python": "\nSome setup\n...\nTraceback (most recent call last):\n  File \"t.py\", line 42\nAssertionError: assert 5 == 10\n",
    "rust": "\nthread 'main' panicked at 'assertion failed', src/main.rs:2:5\nstack backtrace:\n  at ./src/main.rs:2:5\n",
    "node": "\nError: Something went wrong\n    at Object.<anonymous> (/app.js:2:13)\n",
    "java": "\nException in thread \"main\" java.lang.NullPointerException: no\n    at com.example.Main.main(Main.java:5)\n",
    "call_first": "x\nboom\n   at here\nTraceback (most recent call last):\nend",
    "call_on_top": "at here\n" + "\n".join(f"l{i}" for i in range(150)),
    "no_hit": "\n".join(f"l{i}" for i in range(50)) + "\n",
    "short": "a\nb",
    "long": "p\npanic: no\n" + "\n".join(f"l{i}" for i in range(150)),
    "empty": "",
}


def test_first_error_lines(spark):
    df = spark.createDataFrame(list(LOGS.items()), "doc string, text string")
    got = {r[0]: r[1] for r in df.select("doc", T.first_error_lines(T.file_lines(F.col("text")))).collect()}
    assert got["python"][0] == "Traceback (most recent call last):" and len(got["python"]) == 3
    assert got["rust"][0].startswith("thread 'main' panicked at") and len(got["rust"]) == 3
    assert got["node"] == ["Error: Something went wrong", "    at Object.<anonymous> (/app.js:2:13)"]
    assert got["java"][0].startswith("Exception in thread") and len(got["java"]) == 2
    assert got["call_first"] == ["boom", "   at here", "Traceback (most recent call last):", "end"]
    assert got["call_on_top"] == ["at here"] + [f"l{i}" for i in range(98)]
    assert got["no_hit"] == [f"l{i}" for i in range(10, 50)]
    assert got["short"] == ["a", "b"]
    assert got["long"] == ["panic: no"] + [f"l{i}" for i in range(99)]
    assert got["empty"] == []


def test_prune_lines(spark):
    texts = [
        "line1\nnode_modules/lib.js\nError: boom\nvenv/lib.py",
        "",
        "line1\nnode_modules/lib.js\nline2",
        "CRITICAL\nvenv/a.py Exception\nvenv/b.py\nrest",
    ]
    got = column(spark, texts, lambda c: F.array_join(T.prune_lines(T.document_lines(c)), "\n"))
    assert got == ["line1\nnode_modules/lib.js\nError: boom", "", texts[2], "CRITICAL\nvenv/a.py Exception\nrest"]


def test_predicates(spark):
    texts = ["collected\nERROR: file not found", "all fine", "a" * 2001, "look at this", None]
    assert column(spark, texts, T.matches_failure) == [True, False, False, False, False]
    assert column(spark, texts, T.needs_intake) == [False, False, True, True, False]
    assert column(spark, ["fooException: x", "Exception: x", "éException: x"], T.matches_trace) == [True, False, True]


def test_paths(spark):
    samples = ["a/b/c.md", "/a", "a", "//x", "a/.git/x", "a/b/", ".bashrc", "a.tar.gz", "", "/", "a//b"]
    import os.path as p

    assert column(spark, samples, paths.basename) == [p.basename(s) for s in samples]
    assert column(spark, samples, paths.dirname) == [p.dirname(s) for s in samples]
    assert column(spark, samples, paths.extension) == [p.splitext(s)[1] for s in samples]
    assert column(spark, samples, paths.depth) == [s.count("/") for s in samples]
    folds = ["a/../b", "./a//b/.", "../../x", "/../a", "a/..", "", "a/b/../../..", "/a/./b/../c"]
    assert column(spark, folds, paths.normalize) == [p.normpath(s) for s in folds]
    assert column(spark, ["x/.git/a.md", "a/b.log", "a/b.md", "a.log/b"], paths.is_ignored) == [True, True, False, True]
    assert column(spark, ["a.md", "b.yml", "c.py"], lambda c: paths.has_suffix(c)) == [True, True, False]


def test_markdown_links(spark):
    docs = ["see [a](x.md) and [b](http://y) then [c](z/w.md)", "none", "[a](b.md)\n[c](d.md)"]
    expected = [re.findall(r"\[.*?\]\((.*?\.md)\)", d) for d in docs]
    assert column(spark, docs, paths.markdown_links) == expected


def test_json_recovery(spark):
    texts = [
        'Sure:\n```json\n{"k": 1}\n``` done', '{"k": 2} and {"k": 3}', "no json", "{broken", '{"k": {"a": 1}}', "{'k': 1}", None, '{"k": 4',
    ]
    fallback = F.named_struct(F.lit("k"), F.lit(-1).cast("bigint"))
    got = column(spark, texts, lambda c: jsontext.recover_json(c, "struct<k: bigint>", fallback)["k"])
    assert got == [1, -1, -1, -1, None, -1, -1, -1]
    assert column(spark, texts[:2], lambda c: jsontext.recover_json(c, "struct<k: bigint>")) [1] is None


def test_times(spark):
    texts = ["2024-01-30T10:00:00Z", "2024-01-30T10:00:00.123456Z", "2024-01-30T10:00:00+02:00", "bad", None]
    got = column(spark, texts, lambda c: temporal.parse_iso(c).cast("string"))
    assert got == ["2024-01-30 10:00:00", "2024-01-30 10:00:00.123456", "2024-01-30 10:00:00", None, None]
    edge = ["2024-01-23T00:00:00Z", "2024-01-22T23:59:59.999999Z", "2030-01-01T00:00:00Z", None]
    inside = column(spark, edge, lambda c: temporal.in_trailing_window(temporal.parse_iso(c), "2024-01-30"))
    assert inside == [True, False, True, False]
    days = ["2024-01-22", "2024-01-23", "2024-01-29", "2024-01-30"]
    got = column(spark, days, lambda c: temporal.in_date_range(c.cast("date"), "2024-01-30 12:00:00"))
    assert got == [False, True, True, False]
    assert column(spark, ["2024-01-30 10:00:00"], lambda c: temporal.iso_format(c.cast("timestamp_ntz"))) == ["2024-01-30T10:00:00.000000Z"]


def test_money(spark):
    got = column(spark, ["0.125", "12.345678", "x", None], lambda c: rounded(amount(c), 2).cast("string"))
    assert [g if g is None else f"{float(g):.2f}" for g in got] == ["0.12", "12.35", None, None]


CHECKLIST = """
## Proposed Skills
- [x] pytest (http://pytest)
- [ ] ignore_me (http://ignore)
- [X] uppercase (http://uppercase)
- [x]    spaced   (http://spaced)
- [x] typed (http://t) <!-- type: extension -->
- [x] no target

## Proposed MCP Tools
- [x] sql (npx -y sql)
- [ ] bad (npx bad)
- [X]  uppercase-mcp   (npx (uppercase))
    """


def test_checked_rows(spark):
    rows = column(spark, [CHECKLIST], lambda c: markdown.checked_rows(markdown.section(c, V.SKILLS_HEADING)))[0]
    assert [(r["name"], r["target"], r["type"]) for r in rows] == [
        ("pytest", "http://pytest", "skill"),
        ("uppercase", "http://uppercase", "skill"),
        ("spaced", "http://spaced", "skill"),
        ("typed", "http://t", "extension"),
    ]
    rows = column(spark, [CHECKLIST], lambda c: markdown.checked_rows(markdown.section(c, V.MCPS_HEADING)))[0]
    assert [(r["name"], r["target"]) for r in rows] == [("sql", "npx -y sql"), ("uppercase-mcp", "npx (uppercase")]
    assert column(spark, ["nothing here"], lambda c: markdown.section(c, V.SKILLS_HEADING)) == [""]


DOMAIN = """# Domain
**Proposed Agent Name:** `@My-Owner_1`
**Domain Invariants (rules):**
Rule 1: always (really)

**Ubiquitous Language (terms):**
Term 1

## Proposed Skills
"""


def test_domain_sections(spark):
    assert column(spark, [DOMAIN, "none"], markdown.owner_name) == ["my-owner_1", "domain-sme"]
    assert column(spark, [DOMAIN, "none"], markdown.invariants) == ["Rule 1 always \n\n**", "None provided."]
    assert column(spark, [DOMAIN, "none"], markdown.glossary) == ["Term 1", "None provided."]
    newer = DOMAIN.replace("Domain Invariants", "3. Aggregates & Invariants")
    assert column(spark, [newer], markdown.invariants) == ["Rule 1 always \n\n**"]
    assert column(spark, [newer], lambda c: markdown.invariants(c, legacy=True)) == ["None provided."]
