"""Files with several licences, and prose full of licence words."""

import random

from opslens.llm import licenses
from tests.llm import fixtures


def index(rare):
    weights = {w.decode(): 3.0 for w in licenses.VOCABULARY} | dict.fromkeys(rare, 9.0)
    return licenses.Index(weights | dict.fromkeys(("the", "of", "and", "to", "in", "is"), 0.1))


def test_all_licences_in_one_file():
    r = random.Random(3)
    text = "\n\n".join(f"{fixtures.sentence(r, 30)}. {template}." for template, _ in licenses.TEMPLATES.values())
    assert index(()).labels(licenses.words_of(text)) == dict.fromkeys(licenses.TEMPLATES, 1.0)


def test_notices_beside_a_long_text():
    parts = [licenses.TEMPLATES[k][0] for k in ("mit-text", "apache-2.0", "cc-by-nc-4.0", "gpl-3.0")]
    found = index(licenses.TEMPLATES["mit-text"][0].split()).labels(licenses.words_of(". ".join(parts)))
    assert set(found) >= {"mit-text", "apache-2.0", "cc-by-nc-4.0", "gpl-3.0"}


def test_prose_full_of_licence_words():
    words = ["purpose", "charge", "conditions", "fee", "forms", "person", "copy", "public", "domain", "source"]
    r = random.Random(4)
    prose = " ".join(f"{fixtures.sentence(r, 7)} {r.choice(words)}" for _ in range(2000))
    assert index(words).labels(licenses.words_of(f"{prose}. Licensed under CC BY-NC 4.0. {prose}")) == {"cc-by-nc-4.0": 1.0}
