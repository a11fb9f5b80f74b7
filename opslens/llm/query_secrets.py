"""Query of the secret scan."""

from pyspark.sql import functions as F

from opslens.llm.registry import read, register
from opslens.llm.secrets import KINDS, find_secrets
from opslens.llm.spans import base_spans, count_kind, digest, span_text


@register()
def op1_secret_scan(spark, sf_dir):
    spans = F.col("spans")
    return find_secrets(read(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count_kind(spans, kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        digest(span_text(base_spans(spans))).alias("base_sha256"),
        span_text(spans).alias("spans"),
    )
