"""Query of the document fingerprints."""

from pyspark.sql import functions as F

from opslens.llm.registry import read, register
from opslens.llm.spans import digest
from opslens.llm.spotsigs import as_text, fingerprint_documents


@register()
def op7_spot_fingerprints(spark, sf_dir):
    return fingerprint_documents(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_chars",
        digest(F.col("edited")).alias("edited_sha256"),
        as_text(F.col("found")).alias("fingerprint"),
        as_text(F.col("edited_found")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )
