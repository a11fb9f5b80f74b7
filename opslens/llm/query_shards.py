"""Query of the sharding."""

from pyspark.sql import functions as F

from opslens.llm.registry import read, register
from opslens.llm.sharding import assign_shards


@register()
def op3_hilbert_shards(spark, sf_dir):
    return assign_shards(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
