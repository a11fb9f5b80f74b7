"""Query of the license scan."""

from pyspark.sql import functions as F

from opslens.llm.licenses import find_licenses
from opslens.llm.registry import read, register


@register()
def op5_license_scan(spark, sf_dir):
    found = find_licenses(read(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})
