"""Every query on edge tables: no crash, one result a row (or piece), the contract's columns and types."""

import os

import pytest

from opslens.llm import registry
from opslens.llm.queries import QUERIES, SQL

COLUMNS = {
    "op1": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op2": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op3": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op4": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op6": "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
    "op7": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op8": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op9": "page_id bigint, host string, path string, rule string, verdict string",
    "op10": "doc_id bigint, fingerprint string, component_id bigint",
    "op11": "query_id bigint, rank int, vec_id bigint, score bigint",
    "op12": "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double",
    "op13": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_edge_tables(spark, name, edge_dir, empty_dir, null_dir, repeated_dir):
    op = name.split("_")[0]
    kind = {"op9": "pages", "op11": "embeddings", "op12": "embeddings"}.get(op, "documents")
    for folder in (edge_dir, empty_dir, null_dir, repeated_dir):
        got = QUERIES[name](spark, folder)
        assert ", ".join(f"{n} {t}" for n, t in got.dtypes) == COLUMNS[op]
        rows = got.collect()
        source = spark.read.parquet(f"{folder}/{kind}.parquet")
        if op == "op8":
            assert sum(r.length == r.doc_tokens - r.start for r in rows) == source.count()
        elif kind == "embeddings":
            assert len({r[0] for r in rows}) <= source.count()
        else:
            assert len(rows) == source.count()


def test_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
    assert {n.split("_")[0] for n in SQL} == {"op4", "op9", "op11"}


def test_workers_find_the_package(spark):
    registry.importable(spark)
    registry.importable(spark)
    paths = spark.sparkContext.environment["PYTHONPATH"].split(os.pathsep)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(registry.__file__))))
    assert paths.count(root) == 1 and os.path.isdir(os.path.join(root, "opslens"))
