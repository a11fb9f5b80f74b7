"""Query of the Merkle manifest."""

import string

from pyspark.sql import functions as F

from opslens.llm.merkle import COLUMNS, folded, merkle_manifest
from opslens.llm.registry import read, register


@register()
def op13_merkle_manifest(spark, sf_dir):
    lowered = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, lowered).otherwise(F.col("text"))
    presented = [tampered if c == "text" else F.col(c) for c in COLUMNS]
    rows = merkle_manifest(read(spark, sf_dir, "documents"), presented=presented)
    siblings = F.array_join(F.transform("proof", lambda step: F.concat(step["before"], step["after"])), "")
    return rows.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings, 256).alias("proof_sha256"),
        folded(F.col("presented"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
