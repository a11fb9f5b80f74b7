"""License scans with a positional index of rare words.

The words of all license templates are weighed by their inverse document frequency over the whole corpus. Those that fewer
than one document in ``COMMON`` holds, and in any case the two rarest of each template, are indexed with their places. All
indexed words of a text are looked up; each occurrence and each posting vote for (template, where it would begin), and a
beginning with votes of two rare words (or of the template's only one) is a candidate: the postings intersect there. A
candidate is accepted if the template's mandatory phrases stand in its stretch of the text and at least half of its words
stand at their places, give or take ``SLACK`` words; that share is its score.

The fixed base phrases are found beside the templates and their labels stay.
"""

import math
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslens.llm.spans import map_texts

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
# Fixed phrases and labels.
BASE = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}

COMMON = 10
SLACK = 3
LEAST_SHARE = 0.5
BASE_SCORE = 0.5

#: Label: template, mandatory phrases.
TEMPLATES = {
    "mit-notice": ("released under the mit license", ["mit license"]),
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
        ["permission is hereby granted free of charge", "without restriction"],
    ),
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license version 2 0"]),
    "gpl-2.0": ("this work is licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    "lgpl": ("licensed under the gnu lesser general public license version", ["lesser general public license"]),
    "agpl-3.0": ("licensed under the gnu affero general public license version 3", ["affero general public license"]),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        ["redistribution and use in source and binary forms", "conditions are met"],
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ["permission to use copy modify", "with or without fee is hereby granted"],
    ),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "epl-2.0": ("made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    "bsl-1.0": ("distributed under the boost software license version 1 0", ["boost software license"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    "cc0-1.0": ("creative commons cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    "cc-by-4.0": ("licensed under cc by 4 0", ["cc by 4 0"]),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    "cc-by-nd-4.0": ("licensed under cc by nd 4 0", ["cc by nd 4 0"]),
    "proprietary": ("all rights reserved no part of this work may be reproduced", ["all rights reserved", "may be reproduced"]),
}


def words_of(text: str) -> list[bytes]:
    """Words of ``text``, A-Z in lower case."""
    return WORD.findall(text.encode().lower())


def split(phrase: str) -> list[bytes]:
    return phrase.encode().split()


VOCABULARY = frozenset(w for template, _ in TEMPLATES.values() for w in split(template))


class Index:
    """Postings of the templates' rare words, under given weights."""

    def __init__(self, idf: dict[str, float]) -> None:
        self.templates = {label: split(template) for label, (template, _) in TEMPLATES.items()}
        self.phrases = {label: [split(p) for p in phrases] for label, (_, phrases) in TEMPLATES.items()}
        weight = {w: idf.get(w.decode(), 0.0) for w in VOCABULARY}
        rarest = {w for t in self.templates.values() for w in sorted(set(t), key=lambda w: (-weight[w], w))[:2]}
        self.weight = {w: v for w, v in weight.items() if v >= math.log(COMMON) or w in rarest}
        self.postings: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        self.rare = dict.fromkeys(self.templates, 0)
        for label, template in self.templates.items():
            for place, word in enumerate(template):
                if word in self.weight:
                    self.postings[word].append((label, place))
            self.rare[label] = len({w for w in template if w in self.weight})

    def candidates(self, words: list[bytes]) -> list[tuple[str, int]]:
        votes: dict[tuple[str, int], set[bytes]] = defaultdict(set)
        for i, word in enumerate(words):
            if word in self.weight:
                for label, place in self.postings[word]:
                    votes[label, i - place].add(word)
        return [at for at, by in votes.items() if len(by) >= min(2, self.rare[at[0]])]

    def share(self, words: list[bytes], label: str, begin: int) -> float:
        """Share of the template's words that stand at their places, 0 if a mandatory phrase is missing."""
        template = self.templates[label]
        low = max(0, begin - SLACK)
        stretch = words[low : begin + len(template) + SLACK]
        if not all(holds(stretch, phrase) for phrase in self.phrases[label]):
            return 0.0
        here = [begin + place - low for place in range(len(template))]
        found = sum(word in stretch[max(0, at - SLACK) : max(0, at + SLACK + 1)] for word, at in zip(template, here, strict=True))
        return found / len(template)

    def labels(self, words: list[bytes]) -> dict[str, float]:
        found: dict[str, float] = {}
        for label, begin in self.candidates(words):
            share = self.share(words, label, begin)
            if share >= LEAST_SHARE:
                found[label] = max(share, found.get(label, 0.0))
        return found


def holds(words: list[bytes], phrase: list[bytes]) -> bool:
    n = len(phrase)
    return any(words[i : i + n] == phrase for i in range(len(words) - n + 1))


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every place where a base phrase stands, by start."""
    found = []
    at = -1
    try:
        while True:
            at = words.index(b"license", at + 1)
            for phrase, label in BASE.items():
                start = at - len(phrase) + 1
                if start >= 0 and all(words[start + k] == p.encode() for k, p in enumerate(phrase)):
                    found.append((start, label))
    except ValueError:
        return sorted(found)


def scan(text: str, index: Index) -> tuple:
    words = words_of(text)
    base = base_places(words)
    own = index.labels(words)
    starts = [start for start, _ in base]
    base_labels = sorted({label for _, label in base})
    return (
        len(words),
        len(base),
        min(starts, default=None),
        max(starts, default=None),
        base_labels,
        sorted({*base_labels, *own}),
        max([*own.values(), BASE_SCORE * bool(base)]),
    )


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.ArrayType(T.StringType())),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("score", T.DoubleType()),
]


def licence_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> dict[str, float]:
    """Inverse document frequencies of the templates' words over all of ``docs``; a row for each word reaches the driver."""

    def present(text: str) -> tuple[list[str]]:
        return ([w.decode() for w in VOCABULARY.intersection(words_of(text))],)

    held = map_texts(docs, id_col, text_col, lambda: present, [T.StructField("words", T.ArrayType(T.StringType()))])
    counts = held.select(F.explode("words").alias("word")).groupBy("word").count()
    seen = {r["word"]: r["count"] for r in counts.collect()}
    total = docs.count()
    return {w: math.log((total + 1) / (seen.get(w, 0) + 1)) for w in map(bytes.decode, VOCABULARY)}


def find_licenses(
    docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (id, n_words, n_base, first_word, last_word, base_labels, labels, score), one for each row of ``docs``.

    Label lists are sorted and distinct. The score is the best share of an accepted template, at least ``BASE_SCORE`` with a
    base phrase, else 0. A null or empty text has no words and no labels; repeated rows stay repeated; other columns are
    not looked at; an empty table gives no rows. Without ``weights`` they are counted over ``docs`` first.
    """
    idf = licence_weights(docs, id_col, text_col) if weights is None else weights

    def start():
        index = Index(idf)
        return lambda text: scan(text, index)

    return map_texts(docs, id_col, text_col, start, FIELDS).withColumnRenamed("id", id_col)
