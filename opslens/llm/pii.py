"""Personal data by a semi-Markov conditional random field over candidate segments.

The text is cut into regions: runs of digit groups, and what stands around an ``@``. A region's atoms are its digit groups,
or the local part and the labels of the domain. A segment covers at most ``MOST_ATOMS`` atoms and has a type; its score is
the sum of the weights of its features, which see the whole segment (digit count, group lengths, separators, checksum,
octets, words before it). Atoms outside all segments score 0. A dynamic program over the atoms, bounded by the longest
segment, chooses boundaries and types of a region together; the same lattice, summed in log space, gives the likelihood.

Weights start from ``PRIOR`` and are fitted to the likelihood of silver labels, with a penalty for leaving the prior.
Silver labels are the matches of the fixed base patterns; a phone number is also learnt without its country prefix. Equal
regions are counted by Spark first, and the fit takes the ``TRAIN_REGIONS`` commonest, so what the driver holds is bounded.

Base spans stay; segments that overlap none of them are added.
"""

import json
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslens.llm.spans import SPANS, map_texts
from opslens.session import materialize

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?+[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

MOST_ATOMS = 8
TRAIN_REGIONS = 2000
ROUNDS, STEP, PULL = 40, 0.5, 0.05

NUMBER = re.compile(r"(?<![A-Za-z0-9@])(?:\+|\(|\+\()?[0-9](?:[\x20().-]{0,2}+[0-9])*+(?![A-Za-z0-9@])")
GROUP = re.compile(r"[0-9]+")
LABEL = re.compile(r"[A-Za-z0-9-]+")
WORTH_READING = re.compile(r"[0-9@]")
HINTS = {
    "phone": "phone", "tel": "phone", "telephone": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "cell": "phone",
    "card": "card", "visa": "card", "mastercard": "card", "credit": "card", "debit": "card",
    "ip": "ip", "host": "ip", "server": "ip",
    "email": "email", "mail": "email", "contact": "email",
}
LAST_WORD = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]{0,3}$")

PRIOR = {
    "email bias": -3.0, "email ending": 3.0, "email dotted": 3.0, "email bare": -4.0, "email cut right": -3.0,
    "ip bias": -4.0, "ip octets": 8.0, "ip no octets": -8.0, "ip cut left": -3.0, "ip cut right": -3.0,
    "card bias": -4.0, "card luhn": 5.0, "card no luhn": -8.0, "card digits 16": 2.0, "card digits 15": 1.0, "card plus": -4.0,
    "card cut left": -3.0, "card cut right": -3.0,
    "phone bias": -4.0, "phone plus": 5.0, "phone paren": 3.0, "phone lens 3-3-4": 3.0, "phone cut left": -3.0,
    "phone cut right": -3.0, "phone no group": -3.0,
    "email hint": 1.0, "ip hint": 1.0, "card hint": 1.0, "phone hint": 2.0,
}


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (2 * int(d)) // 10 + (2 * int(d)) % 10 for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def octet(part: str) -> bool:
    small = part.lstrip("0")
    return len(small) < 3 or len(small) == 3 and small <= "255"


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Fours of dotted digit runs, from the left, whose parts are at most 255."""
    for run in DOTTED.finditer(text):
        parts = run[0].split(".")
        at = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(octet, four)):
                yield at, end
            at = end + 1


def base_matches(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order."""
    found = [(s, 0, e) for s, e in emails(text)] + [(s, 1, e) for s, e in addresses(text)]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdigit, m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


class Region:
    """Atoms with their places, and the segments that may cover atoms i to j - 1."""

    def __init__(self, text: str, atoms: list[tuple[int, int]], at_sign: bool) -> None:
        self.text, self.atoms, self.at_sign = text, atoms, at_sign
        before = LAST_WORD.search(text, max(0, atoms[0][0] - 40), atoms[0][0])
        self.hint = HINTS.get(before[1].lower()) if before else None

    def __len__(self) -> int:
        return len(self.atoms)

    def span(self, i: int, j: int) -> tuple[int, int]:
        """Places of a segment, with the sign or bracket that opens it."""
        start, end = self.atoms[i][0], self.atoms[j - 1][1]
        if not self.at_sign:
            while start and self.text[start - 1] in "+(" and (i == 0 or start > self.atoms[i - 1][1]):
                start -= 1
        return start, end

    def segments(self, j: int) -> Iterator[tuple[int, str, list[str]]]:
        """(i, type, features) of the segments that end before atom j."""
        for i in range(max(0, j - MOST_ATOMS), j):
            yield from self.email(i, j) if self.at_sign else self.numbers(i, j)

    def email(self, i: int, j: int) -> Iterator[tuple[int, str, list[str]]]:
        if i == 0 and j > 1:
            last = self.text[slice(*self.atoms[j - 1])]
            seen = ["dotted" if j > 2 else "bare", f"labels {j - 1}"] + ["ending"] * (len(last) > 1 and last.isalpha())
            yield i, "email", self.named("email", i, j, seen)

    def numbers(self, i: int, j: int) -> Iterator[tuple[int, str, list[str]]]:
        groups = [self.text[s:e] for s, e in self.atoms[i:j]]
        digits = "".join(groups)
        if not 4 <= len(digits) <= 19:
            return
        start, end = self.span(i, j)
        whole = self.text[start:end]
        marks = "".join(sorted(set(re.sub("[0-9]", "", whole))))
        seen = [f"digits {len(digits)}", f"marks {marks}"] + ["plus"] * (whole[0] == "+") + ["paren"] * ("(" in whole and ")" in whole)
        lens = "-".join(str(len(g)) for g in groups[-3:])
        if j - i == 4 and marks == ".":
            yield i, "ip", self.named("ip", i, j, [*seen, "octets" if all(map(octet, groups)) else "no octets"])
        if 12 <= len(digits) and not set(marks) - set(" -"):
            yield i, "card", self.named("card", i, j, [*seen, "luhn" if luhn(digits) else "no luhn"])
        if 7 <= len(digits) <= 15:
            yield i, "phone", self.named("phone", i, j, [*seen, f"lens {lens}"] + ["no group"] * (j - i == 1))

    def named(self, kind: str, i: int, j: int, seen: list[str]) -> list[str]:
        cut = ["cut left"] * (i > 0) + ["cut right"] * (j < len(self))
        return [f"{kind} {s}" for s in ["bias", *seen, *cut] + ["hint"] * (self.hint == kind)]


def regions(text: str) -> Iterator[Region]:
    at = text.find("@")
    done = 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        atoms, place = [(start, at)], at + 1
        while label := LABEL.match(text, place):
            atoms.append(label.span())
            place = label.end() + 1
            if text[label.end() : place] != ".":
                break
        if start < at and len(atoms) > 1:
            yield Region(text, atoms, True)
            done = atoms[-1][1]
        at = text.find("@", at + 1)
    for run in NUMBER.finditer(text):
        yield Region(text, [g.span() for g in GROUP.finditer(text, *run.span())], False)


def best_segments(region: Region, weights: dict[str, float]) -> list[tuple[int, int, str, float]]:
    """(i, j, type, score) of the segmentation with the highest total score."""
    score, back = [0.0], [None]
    for j in range(1, len(region) + 1):
        top, by = score[j - 1], None
        for i, kind, features in region.segments(j):
            own = sum(weights.get(f, 0.0) for f in features)
            if score[i] + own > top:
                top, by = score[i] + own, (i, j, kind, own)
        score.append(top)
        back.append(by)
    chosen, j = [], len(region)
    while j:
        if back[j]:
            chosen.append(back[j])
            j = back[j][0]
        else:
            j -= 1
    return chosen[::-1]


def pii_spans(text: str, weights: dict[str, float]) -> list[dict]:
    if not WORTH_READING.search(text):
        return []
    base = base_matches(text)
    found = [(s, k, e, True, 1.0) for s, k, e in base]
    taken = []
    for s, _, e in base:  # merged, in order
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    ends = [e for _, e in taken]
    for region in regions(text):
        for i, j, kind, score in best_segments(region, weights):
            s, e = region.span(i, j)
            k = bisect_left(ends, s + 1)
            if k == len(taken) or taken[k][0] >= e:
                found.append((s, KINDS.index(kind), e, False, 1 / (1 + math.exp(-score))))
    return [{"kind": KINDS[k], "start": s, "end": e, "base": b, "score": p} for s, k, e, b, p in sorted(found)]


# Training


def lattice(region: Region, gold: set[tuple[int, int, str]]) -> str:
    """The region as JSON: its length, and each segment's ends, features and whether it is gold."""
    return json.dumps(
        [len(region), [[i, j, f, (i, j, kind) in gold] for j in range(1, len(region) + 1) for i, kind, f in region.segments(j)]]
    )


def training_regions(text: str) -> list[str]:
    """Lattices of the regions with silver labels, phone numbers also without their prefix.

    Regions in which the prior sees a segment where the base patterns have nothing are left out as unlabelled.
    """
    base = base_matches(text)
    starts = [s for s, _, _ in base]
    out = []
    for region in regions(text):
        if len(region) > 4 * MOST_ATOMS:
            continue
        low, high = region.span(0, len(region))
        labels = {(s, e): KINDS[k] for s, k, e in base[bisect_left(starts, low) :][: len(region)] if e <= high}
        places = {region.span(i, j): (i, j) for j in range(1, len(region) + 1) for i, _, _ in region.segments(j)}
        gold = {(*places[s], kind) for s, kind in labels.items() if s in places}
        covered = sorted(gold)
        if any(a[1] > b[0] for a, b in zip(covered, covered[1:], strict=False)):
            continue
        guess = {(i, j, kind) for i, j, kind, _ in best_segments(region, PRIOR)}
        if not gold and guess:
            continue
        out.append(lattice(region, gold))
        if gold == {(0, len(region), "phone")} and len(region) > 2:
            bare = text[slice(*region.span(1, len(region)))]
            for shorter in regions(bare):
                if len(shorter) == len(region) - 1:
                    out.append(lattice(shorter, {(0, len(shorter), "phone")}))
    return out


def log_add(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def gradient(length: int, segments: list, weights: dict[str, float], into: dict[str, float], times: float) -> None:
    """Add ``times`` the gradient of the region's log-likelihood: features of the gold less those expected."""
    scores = [sum(weights.get(f, 0.0) for f in features) for _, _, features, _ in segments]
    ending, starting = [[] for _ in range(length + 1)], [[] for _ in range(length + 1)]
    for k, (i, j, _, _) in enumerate(segments):
        ending[j].append(k)
        starting[i].append(k)
    forward, backward = [0.0] * (length + 1), [0.0] * (length + 1)
    for j in range(1, length + 1):
        forward[j] = log_add([forward[j - 1]] + [forward[segments[k][0]] + scores[k] for k in ending[j]])
    for i in range(length - 1, -1, -1):
        backward[i] = log_add([backward[i + 1]] + [backward[segments[k][1]] + scores[k] for k in starting[i]])
    for k, (i, j, features, gold) in enumerate(segments):
        lack = gold - math.exp(forward[i] + scores[k] + backward[j] - forward[length])
        for f in features:
            into[f] = into.get(f, 0.0) + times * lack


def fit(counted: list[tuple[str, int]]) -> dict[str, float]:
    """Weights for counted lattices; the prior where there are none. Common regions count by their logarithm."""
    weights = dict(PRIOR)
    data = [(*json.loads(text), math.log1p(n)) for text, n in counted]
    total = sum(times for *_, times in data)
    for _ in range(ROUNDS if data else 0):
        change: dict[str, float] = {}
        for length, segments, times in data:
            gradient(length, segments, weights, change, times)
        for f in sorted(change.keys() | weights.keys()):
            now = weights.get(f, 0.0)
            weights[f] = now + STEP * (change.get(f, 0.0) * 10 / total - PULL * (now - PRIOR.get(f, 0.0)))
    return weights


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_REGIONS) -> dict[str, float]:
    """Weights fitted to the ``most`` commonest regions of ``docs``."""
    rows = docs.where(F.col(text_col).rlike("[0-9@]"))
    found = map_texts(
        rows, id_col, text_col, lambda: lambda text: (training_regions(text),), [T.StructField("r", T.ArrayType(T.StringType()))]
    )
    counted = found.select(F.explode("r").alias("r")).groupBy("r").count()
    commonest = materialize(counted.orderBy(F.desc("count"), "r").limit(most), "regions")  # cut by executors, not here
    return fit([(r["r"], r["count"]) for r in commonest.orderBy(F.desc("count"), "r").collect()])


def find_pii(
    docs: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (id, spans), one for each row of ``docs``.

    ``spans`` are (kind, start, end, base, score) in code points, end exclusive, by start and kind. A null or empty text
    has none; repeated rows stay repeated; other columns are not looked at; an empty table gives no rows. Without
    ``weights`` the model is trained on ``docs`` first.
    """
    weights = train(docs, id_col, text_col) if weights is None else weights
    found = map_texts(docs, id_col, text_col, lambda: lambda text: (pii_spans(text, weights),), [T.StructField("spans", SPANS)])
    return found.withColumnRenamed("id", id_col)


def masked(text: str, weights: dict[str, float]) -> str:
    """``text`` with ``[KIND]`` in place of each span; overlapping spans become one, named after the first."""
    out, done = [], 0
    for span in pii_spans(text, weights):
        if span["start"] >= done:
            out += [text[done : span["start"]], f"[{span['kind'].upper()}]"]
        done = max(done, span["end"])
    return "".join(out) + text[done:]


def mask_pii(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    length_col: str | None = None,
) -> DataFrame:
    """``docs`` with all columns, the spans of the text replaced by their kind; a null text stays null.

    Texts are read whole, however long; rows that repeat stay repeated and are masked alike; an empty table gives no rows.

    If ``length_col`` is given, it takes the length of the new text, wherever that has changed.
    """
    weights = train(docs, id_col, text_col) if weights is None else weights

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else masked(t, weights))

    out = docs.withColumn("__masked", mask(text_col))
    if length_col:
        changed = ~F.col("__masked").eqNullSafe(F.col(text_col))
        out = out.withColumn(length_col, F.when(changed, F.length("__masked")).otherwise(F.col(length_col)).cast(docs.schema[length_col].dataType))
    return out.withColumn(text_col, F.col("__masked")).drop("__masked")
