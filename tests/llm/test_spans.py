"""Secrets, personal data and licenses against plain regular expressions."""

import hashlib
import random
import re

import pytest

from opslens.llm import licenses, pii, secrets
from opslens.llm.queries import QUERIES
from tests.llm import fixtures


def secret_matches(text):
    found = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def pii_matches(text):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


@pytest.mark.parametrize(
    ("query", "kinds", "matches", "counts"),
    [
        ("op1_secret_scan", secrets.KINDS, secret_matches, ["n_assign", "n_access", "n_hex"]),
        ("op6_personal_data", pii.KINDS, pii_matches, ["n_email", "n_ip", "n_card", "n_phone"]),
    ],
)
@pytest.mark.parametrize("table", ["edge", "sf"])
def test_base(spark, edge_dir, query, kinds, matches, counts, table):
    folder = edge_dir if table == "edge" else "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for row in QUERIES[query](spark, folder).collect():
        found = matches(texts[row.doc_id])
        names = [f"{kinds[k]}:{s}:{e}" for s, k, e in found]
        assert row.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [row[c] for c in counts] == [sum(k == i for _, k, _ in found) for i in range(len(counts))]
        assert set(names) <= set(row.spans.split(","))


def test_random_base():
    r = random.Random(1)
    for _ in range(5000):
        text = "".join(r.choice("ab@@..--++  ()0123456789019é") for _ in range(r.randrange(60)))
        assert pii.base_matches(text) == pii_matches(text)
        text = "".join(r.choice(["token", "api_key", "=", ":", " ", '"', "abc", "A", "AKIA", "9", "\n", "ſecret", "K"]) for _ in range(r.randrange(30)))
        assert secrets.base_matches(text) == secret_matches(text)


def added(text):
    return [(s["kind"], text[s["start"] : s["end"]]) for s in secrets.secret_spans(text) if not s["base"]]


V = "Tq8!kd92Lz0p"
FORMS = [
    f'config["pwd"] = "{V}"', f"os.environ['DB_PWD'] = '{V}'", f'db_pwd: str = "{V}"', f'let dbPwd: String = "{V}"', f'pwd: Optional[str]="{V}"',
    f'pwd = """{V}"""', f"pwd = r\'\'\'{V}\'\'\'", f"pwd = `{V}`", f'pwd = ("{V}")', f'pwd = ["{V}", "other"]', f'pwd = {{ "{V}" }}', f'pwd = \\\n    "{V}"',
    f'pwd =\n  "{V}"', f'pwd = (\n  "{V}"\n)', f"pwd:\n  {V}\n", f"pwd: |\n  {V}\nnext: 1", f"pwd: >-\n  {V}", f"<pwd>{V}</pwd>", f'<db.pwd type="x">{V}</db.pwd>',
    f'set_pwd("{V}")', f'putenv("DB_PWD", "{V}")', f"conn.setPassphrase( '{V}' )", f'a = B\npwd = a\nB = "{V}"', f'pwd = LATER\nx = 1\nLATER = "{V}"',
    f'data["a"]["pwd"] := "{V}"', f'"pwd" => "{V}"', f"DB_PWD={V}", f"pwd : {V}", f'x = 1; pwd = "{V}"; y = 2',
]
NOT = [
    "primary_key = customer_identifier", 'auth_url = "https://login.example.org/start/Tq8kd92"', 'pwd = get_value(a, "b")', "pwd = other_name", "pwd:\n\nA line of prose here",
    f'get_pwd("{V}")', f'name = "{V}"', 'pwd = "changeme"', "pwd: Optional[str] = None", "pwd =\nnext_line9 and more", f'foreign_key = "{V}"', f'primary_key = "{V}"', "pwd = a\na = pwd",
]


@pytest.mark.parametrize("text", FORMS)
def test_secret_forms(text):
    """Every form of an assignment gives a span over its value, and nothing else."""
    for whole in (text, "Some prose. " * 20 + "\n" + text + "\nmore = 5\n"):
        assert added(whole) == [("pair", V)]


@pytest.mark.parametrize("text", NOT)
def test_no_secret(text):
    assert added(text) == []


def test_lexing_takes_time_in_proportion():
    import time

    def seconds(text):
        start = time.process_time()
        secrets.secret_spans(text)
        return time.process_time() - start

    units = ['pwd = """', "pwd = `", "a: b ", "set_pwd('", "x['k'", "<pwd>a</pw", "pwd =\n(", "a = a + a\n", "name " * 5 + "=", "pwd: a b c d e f ", "\"'"]
    for unit in units:
        seconds(unit * 200)
        assert seconds(unit * 16000) < 60 * (seconds(unit * 1000) + 0.02), unit


def test_long_literals_are_scored_whole():
    weak, strong = "a" * 20000, "a" * 5000 + "bC3$" * 5000
    assert added(f'pwd = "{weak}"') == [] and added(f'pwd = "{strong}"') == [("pair", strong)]
    half = strong[:10000]
    assert added(f'a = "{half}"\npwd = a + "{strong[10000:]}"')[0][1].endswith(strong[10000:])


def test_secret_pairs():
    assert added('K = "zX9qLm20PqWe"\nclient_secret = K\n') == [("pair", "zX9qLm20PqWe")]
    assert ("pair", '"aabb19" + "ccdd1X') not in added('color = "aabb19" + "ccdd1X"')
    assert added('signing_password_salt: "aaB19x" + "ccdd1X"') == [("pair", 'aaB19x" + "ccdd1X')]
    assert added('password = "changeme"') == [] and added("the word: password") == []
    assert added('name = "Tq8!kd92Lz0p"') == []
    # literals that double with every line, long lines without an operator, unclosed quotes
    assert secrets.secret_spans('a = "xY1"\n' + "a = a + a\n" * 200) == []
    assert secrets.secret_spans("word " * 200_000 + "\n" + '="' * 50_000) == []


def test_pii_model():
    plain = [("call (602) 555-5136 now", [("phone", "(602) 555-5136")]), ("tel 602-555-5136", [("phone", "602-555-5136")])]
    clean = ["on 2019-12-31", "version 3.0, 2,000,000 and 1 2 3 4 5 6 7 8 9 10", "a@b", "id 1234567890", "GPL version 3."]
    for text, want in plain + [(t, []) for t in clean]:
        assert [(s["kind"], text[s["start"] : s["end"]]) for s in pii.pii_spans(text, pii.PRIOR)] == want
    assert pii.masked("to me@host.org or 10.0.0.1", pii.PRIOR) == "to [EMAIL] or [IP]"


def test_pii_training_is_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    weights = pii.train(docs.where("doc_id % 2 = 0"))
    hits = base = spurious = 0
    for row in docs.where("doc_id % 2 = 1").collect():
        labelled = {(s, e) for s, _, e in pii.base_matches(row.text)}
        guessed = {r.span(i, j) for r in pii.regions(row.text) for i, j, _, _ in pii.best_segments(r, weights)}
        base += len(labelled)
        hits += len(labelled & guessed)
        spurious += len(guessed - labelled)
    assert base > 10 and hits >= 0.9 * base and spurious <= 0.1 * base


def test_dynamic_program_is_best():
    """Against all segmentations of short regions."""

    def every(region, at):
        if at == len(region):
            yield ()
            return
        for rest in every(region, at + 1):
            yield rest
        for j in range(at + 1, len(region) + 1):
            for i, _, features in region.segments(j):
                if i == at:
                    own = sum(weights.get(f, 0.0) for f in features)
                    for rest in every(region, j):
                        yield (own, *rest)

    r = random.Random(2)
    weights = {k: v + r.uniform(-2, 3) for k, v in pii.PRIOR.items()}
    for _ in range(50):
        text = "".join(r.choice("0123456789012345 ()-.+") for _ in range(25))
        for region in pii.regions(text):
            if len(region) < 8:
                best = sum(s for *_, s in pii.best_segments(region, weights))
                assert abs(best - max(sum(c) for c in every(region, 0))) < 1e-9


def test_licenses(spark, edge_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{edge_dir}/documents.parquet").collect()}
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    for row in QUERIES["op5_license_scan"](spark, edge_dir).collect():
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[row.doc_id]))
        places = [(i, k) for k, p in phrases.items() for i in range(len(words)) if words[i : i + len(p)] == p]
        starts = [i for i, _ in places]
        assert (row.n_words, row.n_base, row.first_word, row.last_word) == (len(words), len(places), min(starts, default=None), max(starts, default=None))
        base = {k for _, k in places}
        assert row.base_labels == ",".join(sorted(base)) and base <= set(row.labels.split(",")) | {""} and 0 <= row.score <= 1


def test_license_templates():
    weights = {w.decode(): 5.0 for w in licenses.VOCABULARY} | {"the": 0.1, "of": 0.1, "and": 0.1, "to": 0.1, "in": 0.1, "is": 0.1}
    index = licenses.Index(weights)
    prose = fixtures.sentence(random.Random(1), 400)
    for label, (template, _) in licenses.TEMPLATES.items():
        found = index.labels(licenses.words_of(f"{prose}.\n{template.upper()}. {prose}"))
        assert found.get(label) == 1.0, label
        words = template.split()
        moved = " ".join(words[: len(words) // 2] + ["indeed"] + words[len(words) // 2 :])
        if len(words) > 12:
            assert label in index.labels(licenses.words_of(f"{prose} {moved} {prose}")), label
    assert index.labels(licenses.words_of(prose + " a license of the public version")) == {}
