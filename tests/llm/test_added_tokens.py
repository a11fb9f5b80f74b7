"""Added tokens in texts, against the tokenizer as its file gives it."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from opslens.llm import packing


def test_added_tokens(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        encode = packing.Encoder(file.read(), public_tokenizers.PATTERN).encode_whole
    r = random.Random(8)
    parts = ["<|endoftext|>", "<|endoftext", "|>", "<|", " ", "\n", "  ", "a", "don't", "é中", "12", "<|ENDOFTEXT|>"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "", "a" + " " * 120_000 + "<|endoftext|>"]
    texts += ["".join(r.choice(parts) for _ in range(r.randrange(30))) for _ in range(2000)]
    want = [tokenizer.encode(text, add_special_tokens=False).ids for text in texts]
    assert [np.frombuffer(encode(text), "<u4").tolist() for text in texts] == want
    docs = spark.createDataFrame(list(enumerate(texts[:3])), "doc_id long, text string")
    rows = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN).collect()
    assert {r.doc_id: zlib.crc32(r.ids) for r in rows} == {k: zlib.crc32(np.array([*want[k], 0], "<u4").tobytes()) for k in range(3)}
