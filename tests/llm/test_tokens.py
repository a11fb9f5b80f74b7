"""Encoding, decoding and packing against the libraries, and the windows' properties."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from opslens.llm import packing, piece_bpe
from opslens.llm.queries import QUERIES

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def pieces():
    return piece_bpe.Pieces(piece_bpe.read_model(MODEL))


def tokens(data):
    return np.frombuffer(data, "<i4").tolist()


@pytest.mark.parametrize("table", ["edge", "sf"])
def test_codec_query(spark, library, edge_dir, table):
    folder = edge_dir if table == "edge" else "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for row in QUERIES["op2_piece_codec"](spark, folder).collect():
        ids = library.encode(texts[row.doc_id], add_eos=True)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("alphabet", ["ab ", "the ing tion ", "▁ aé\n\t", "中国的 一", "inthe", "aA0 _-/=\n.", "  x"])
def test_random_texts(library, pieces, alphabet):
    r = random.Random(alphabet)
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(150))) for _ in range(1500)]
    for text, data in zip(texts, pieces.encode(texts), strict=True):
        assert tokens(data) == library.encode(text, add_eos=True)
        assert pieces.decode(tokens(data)) == library.decode(tokens(data))


def test_pieces_side_by_side(library, pieces):
    r = random.Random(4)
    names = [library.id_to_piece(i).replace("▁", " ") for i in range(259, 32000)]
    texts = ["".join(r.choice(names) for _ in range(r.randrange(12))) for _ in range(8000)]
    texts += ["".join(r.choice(names[:300]) for _ in range(200)).replace(" ", "") for _ in range(300)]
    texts += [" " * k + w for k in range(120) for w in ("", ",", "a", "\n")] + ["x" * 5000, "the" * 5000, " " * 50001]
    for text, data in zip(texts, pieces.encode(texts), strict=True):
        assert tokens(data) == library.encode(text, add_eos=True)


def test_long_text_without_spaces(library, pieces):
    r = random.Random(5)
    text = "".join(r.choice("abcdefghijklmnop") for _ in range(30000))
    assert tokens(pieces.encode([text])[0]) == library.encode(text, add_eos=True)


def test_known_chunks_are_forgotten(library, pieces, monkeypatch):
    monkeypatch.setattr(piece_bpe, "MOST_KNOWN", 20)
    for text in ["one two three four", "five six seven eight nine ten", "the same words " * 9] * 3:
        assert tokens(pieces.encode([text])[0]) == library.encode(text, add_eos=True)


def test_byte_ids():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encode = packing.Encoder(file.read(), public_tokenizers.PATTERN).encode
    r = random.Random(3)
    texts = ["".join(r.choice("ab '\t\n  é中1²½s’'ll　‍🙂-_'re<|endoftext|>") for _ in range(r.randrange(80))) for _ in range(3000)]
    for text in [*texts, "<|endoftext|> x", "a" + " " * 120_000 + "b", "\n" * 100_001, " " * 100_000]:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("table", ["edge", "sf"])
def test_packing_query(spark, edge_dir, table):
    folder = edge_dir if table == "edge" else "/root/testdata/sf0.01"
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs}
    rows = QUERIES["op8_sequence_packing"](spark, folder).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for row in rows:
        assert row.doc_tokens == len(ids[row.doc_id])
        part = ids[row.doc_id][row.start : row.start + row.length]
        assert row.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        by_doc[row.doc_id].append((row.start, row.length))
        by_sequence[row.sequence_id].append((row.offset, row.length))
    assert by_doc.keys() == ids.keys()
    for name, parts in by_doc.items():
        assert [s for s, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) == len(ids[name])
    for parts in by_sequence.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024
    if table == "sf":
        total = sum(map(len, ids.values()))
        assert len(by_sequence) * 1024 <= 1.03 * total


def test_differencing():
    r = random.Random(6)
    for _ in range(200):
        sizes = [r.randrange(1, 257) for _ in range(r.randrange(1, 300))]
        k = r.randrange(1, 40)
        windows = packing.differenced(sizes, k)
        assert len(windows) <= k and sorted(i for _, items in windows for i in items) == list(range(len(sizes)))
        assert all(total == sum(sizes[i] for i in items) for total, items in windows)
        if len(sizes) > 12 * k:
            assert windows[0][0] - windows[-1][0] <= 16 and len(windows) == k
        fitted = packing.packed(sizes, 1024)
        assert all(sum(sizes[i] for i in items) <= 1024 for items in fitted)
    assert packing.differenced([8, 7, 6, 5, 4], 2)[0][0] == 16  # the known result of the method on these numbers
    assert packing.packed([]) == []
    assert packing.packed([600, 600, 600]) == [[0], [1], [2]] or len(packing.packed([600, 600, 600])) == 3
