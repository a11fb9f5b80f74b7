"""Query of the personal data scan."""

from pyspark.sql import functions as F

from opslens.llm.pii import KINDS, find_pii
from opslens.llm.registry import read, register
from opslens.llm.spans import base_spans, count_kind, digest, span_text


@register()
def op6_personal_data(spark, sf_dir):
    spans = F.col("spans")
    return find_pii(read(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count_kind(spans, kind).alias(f"n_{kind}") for kind in KINDS],
        digest(span_text(base_spans(spans))).alias("base_sha256"),
        span_text(spans).alias("spans"),
    )
