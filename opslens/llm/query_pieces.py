"""Query of SentencePiece encoding and decoding."""

import public_tokenizers
from pyspark.sql import functions as F

from opslens.llm.piece_bpe import decode_ids, encode_texts
from opslens.llm.registry import read, register
from opslens.llm.spans import digest


@register()
def op2_piece_codec(spark, sf_dir):
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = decode_ids(encode_texts(read(spark, sf_dir, "documents"), path), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        digest(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        digest(F.col("text")).alias("decoded_sha256"),
    )
