"""Quality rules as a short-circuit cascade, in DataFrame operations only.

A rule is a named condition on (text, words) that rejects a document. The cascade is one ``CASE`` whose branches stand in
the order of rejections per cost, so a document that a cheap, selective rule rejects never meets the dear ones. Cost and
selectivity are estimated on a sample of ``SAMPLE_ROWS`` rows, each rule timed on its own; a document is kept if no rule
rejects it, so the order changes the time and never the verdict.

Words are maximal runs outside ``[\\x20\\x09-\\x0D]``. Repeated windows are compared by the 64-bit hash of their words'
64-bit hashes. Everything is linear or n log n in the text, inside the row.
"""

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = Callable[[Column, Column], Column]

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED_PERCENT = 30
SAMPLE_ROWS = 500
SAMPLE_CHARS = 50_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))


def repeated_words(words: Column) -> Column:
    """Words inside windows of ``WINDOW`` words that the text holds twice or more."""

    def covered(windows: Column) -> Column:
        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        starts = let(
            placed,
            lambda s: F.sort_array(
                F.transform(
                    F.filter(
                        s,
                        lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)),
                    ),
                    lambda x: x["i"],
                )
            ),
        )
        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("before"))
        return F.aggregate(
            starts,
            zero,
            lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["before"])).alias("n"), i.alias("before")),
            lambda a: a["n"],
        )

    def of(hashes: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashes) - WINDOW + 1), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
        found = let(windows, lambda ws: F.when(F.size(F.array_distinct(ws)) < F.size(ws), covered(ws)).otherwise(0))
        return F.when(F.size(hashes) > WINDOW, found).otherwise(0)

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS))


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, ""))


# Clean prose has next to no such symbols, few capitals and words of ordinary length: the limits leave it a wide margin.
BASE_RULES: dict[str, Rule] = {
    "few_words": lambda text, words: F.size(words) < LEAST_WORDS,
    "repeated_words": lambda text, words: 100 * repeated_words(words) > MOST_REPEATED_PERCENT * F.size(words),
}
OWN_RULES: dict[str, Rule] = {
    "symbols": lambda text, words: 10 * symbols(text) > F.size(words),
    "capitals": lambda text, words: 2 * F.regexp_count(text, F.lit(r"\p{Lu}")) > word_chars(words),
    "exclamations": lambda text, words: 2 * F.regexp_count(text, F.lit("!")) > F.size(words),
    "word_length": lambda text, words: ~word_chars(words).between(2 * F.size(words), 20 * F.size(words)),
    "duplicate_lines": lambda text, words: 2 * duplicate_lines(text) > F.size(F.split(text, "\n")),
    "few_distinct": lambda text, words: 20 * F.size(F.array_distinct(words)) < F.size(words),
}


def rule_order(docs: DataFrame, rules: Mapping[str, Rule], text_col: str = "text", rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules by falling rejection per second on a sample of at most ``rows`` rows.

    The sample is taken from the first partitions that hold so many rows, and passes the driver; texts of more than
    ``SAMPLE_CHARS`` characters are left out of it, which bounds its size.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    taken = docs.select(text.alias("t")).where(F.length("t") <= SAMPLE_CHARS).limit(rows).collect()
    sample = docs.sparkSession.createDataFrame([tuple(r) for r in taken], "t string").withColumn("w", words_of(F.col("t")))

    def measured(reject: Column) -> tuple[float, float]:
        began = time.perf_counter()
        share = sample.agg(F.avg(F.coalesce(reject, F.lit(False)).cast("int"))).first()[0]
        return share or 0.0, time.perf_counter() - began

    measured(F.size("w") < 0)
    idle = measured(F.size("w") < 0)[1]
    worth = {}
    for name, rule in rules.items():
        share, took = measured(rule(F.col("t"), F.col("w")))
        worth[name] = share / max(took - idle, 1e-4)
    return sorted(rules, key=lambda name: -worth[name])


def cascade(text: Column, rules: Mapping[str, Rule], order: Sequence[str]) -> Column:
    """True if a rule rejects ``text``; rules after the first that rejects are not evaluated."""

    def branches(words: Column) -> Column:
        case = F.when(F.lit(False), True)
        for name in order:
            case = case.when(rules[name](text, words), True)
        return case.otherwise(False)

    return let(words_of(text), branches)


def quality_verdicts(
    docs: DataFrame, rules: Mapping[str, Rule] = OWN_RULES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (id, counts, base_failed, kept), one for each row of ``docs``; a null text counts as empty.

    ``kept`` is false for a document that fails the base conditions, else what the cascade of ``rules`` says. Other
    columns are not looked at; an empty table gives no rows.
    """
    order = rule_order(docs, rules, text_col)
    counted = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).select(
        "id", "t", words_of(F.col("t")).alias("w")
    )
    long = lambda c: c.cast("long")
    features = counted.select(
        F.col("id").alias(id_col),
        long(F.size("w")).alias("n_words"),
        long(word_chars(F.col("w"))).alias("word_chars"),
        long(symbols(F.col("t"))).alias("n_symbols"),
        long(duplicate_lines(F.col("t"))).alias("n_dup_lines"),
        long(repeated_words(F.col("w"))).alias("n_repeat_words"),
        cascade(F.col("t"), rules, order).alias("rejected"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return features.withColumn("base_failed", failed).withColumn("kept", ~failed & ~F.col("rejected")).drop("rejected")


def keep_good(docs: DataFrame, rules: Mapping[str, Rule] = BASE_RULES | OWN_RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns.

    A null text counts as empty. Texts are read whole, however long; rows that repeat are judged alike and stay repeated; an
    empty table gives no rows. Only the text is looked at, whatever the names of the other columns.
    """
    order = rule_order(docs, rules, text_col)
    return docs.where(~cascade(F.coalesce(F.col(text_col), F.lit("")), rules, order))
