"""Query of the simhash near-duplicates."""

from pyspark.sql import functions as F

from opslens.llm.registry import read, register
from opslens.llm.simhash import near_duplicates


@register()
def op10_simhash_components(spark, sf_dir):
    return near_duplicates(read(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
