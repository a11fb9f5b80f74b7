"""Query of the quality rules."""

from opslens.llm.quality import quality_verdicts
from opslens.llm.registry import read, register

WORDS = r"'[^\x20\x09-\x0D]+'"


@register(
    rf"""
    WITH texts AS (
      SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w FROM documents),
    lines AS (
      SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts)
      WHERE regexp_matches(line, {WORDS}) GROUP BY doc_id),
    windows AS (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS found
      FROM (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM texts))),
    repeated AS (
      SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM windows WHERE found > 1) GROUP BY doc_id),
    counted AS (
      SELECT doc_id, t, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM texts LEFT JOIN lines USING (doc_id) LEFT JOIN repeated USING (doc_id)),
    judged AS (
      SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             10 * n_symbols > n_words
             OR 2 * len(regexp_extract_all(t, '\p{{Lu}}')) > word_chars
             OR 2 * len(regexp_extract_all(t, '!')) > n_words
             OR word_chars NOT BETWEEN 2 * n_words AND 20 * n_words
             OR 2 * n_dup_lines > len(string_split(t, chr(10)))
             OR 20 * len(list_distinct(w)) < n_words AS rejected
      FROM counted)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND NOT coalesce(rejected, false) AS kept
    FROM judged
    """
)
def op4_quality_rules(spark, sf_dir):
    return quality_verdicts(read(spark, sf_dir, "documents").select("doc_id", "text"))
