"""Query of the packing."""

import public_tokenizers
from pyspark.sql import functions as F

from opslens.llm.packing import pack_documents
from opslens.llm.registry import read, register


@register()
def op8_sequence_packing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    pieces = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
