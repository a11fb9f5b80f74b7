"""Query of the whitening of embeddings."""

from opslens.llm.registry import read, register
from opslens.llm.whitening import whiten


@register()
def op12_embedding_whitening(spark, sf_dir):
    return whiten(read(spark, sf_dir, "embeddings"))
