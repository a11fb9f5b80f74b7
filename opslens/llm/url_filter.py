"""URL filters as a sort-merge range join, in DataFrame operations only.

A rule (host, path, verdict) fits its host and every subdomain, if the path of the url starts with the rule's path; the
longest rule (host plus path) wins. The canonical key of a rule is its reversed host labels, ``#`` and the path, so all
paths below a rule form one interval of keys, and intervals of rules are nested or disjoint. The rules' starts and ends
become segments, each labelled with the rule on top of the stack there: a start pushes its rule, an end brings back the
parent, the longest other rule whose key is a proper prefix. A url probes this line of segments once for each of its
host suffixes that is no deeper than the deepest rule host. Probes and segments are sorted together and a running
``last`` carries the segment's rule to the probes.

The sort is cut into ranges of (key, salt), so the probes of one hot host, or of one hot url, spread over many ranges;
each range starts with the segment that is open at its border. The cuts come from a uniform sample of about
``SAMPLE_PER_RANGE`` urls for each range and affect balance only.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslens.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_RANGES = 256
SAMPLE_PER_RANGE = 20


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/ ? #`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def rule_segments(rules: DataFrame) -> DataFrame:
    """Rows (key, rule): from ``key`` on, ``rule`` is the innermost open rule; an empty rule name means none.

    Rules with equal host and path are one rule; ``block`` wins over ``allow``. Rules without a host are left out.
    """
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    path = F.coalesce("path", F.lit(""))
    named = (
        rules.select(host.alias("host"), path.alias("path"), "verdict")
        .where("host <> ''")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            F.concat(F.array_join(reversed_labels(F.col("host")), "."), F.lit("#"), "path").alias("key"),
            F.struct(F.length(F.concat("host", "path")).alias("size"), F.concat("host", "path").alias("name"), "verdict").alias("rule"),
            "host",
        )
    )
    # A prefix can be a rule only if some rule of the host has its length.
    lengths = named.groupBy("host").agg(F.collect_set(F.length("key")).alias("lengths"))
    shorter = F.filter("lengths", lambda n: n < F.length("key"))
    prefixes = named.join(lengths, "host").select("key", F.explode(shorter).alias("n")).select("key", F.expr("left(key, n)").alias("prefix"))
    parents = (
        prefixes.join(named.select(F.col("key").alias("prefix"), "rule"), "prefix")
        .groupBy("key")
        .agg(F.max("rule").alias("parent"))
    )
    none = F.struct(F.lit(0).alias("size"), F.lit("").alias("name"), F.lit("").alias("verdict"))
    start = F.struct(F.encode("key", "UTF-8").alias("key"), F.col("rule").alias("rule"))
    end = F.struct(F.concat(F.encode("key", "UTF-8"), F.lit(b"\xff")).alias("key"), F.coalesce("parent", none).alias("rule"))
    return named.join(parents, "key", "left").select(F.explode(F.array(start, end)).alias("s")).select("s.key", "s.rule")


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """Rows (id, host, path, rule, verdict), one for each row of ``pages``.

    ``rule`` is the winning rule's host and path, null if none fits; then ``verdict`` is ``default``. The longest host and path
    win; two rules that fit one url and are equally long are the same host and path, so ``rules`` names each once. A null url, or one
    without ``://``, has an empty host and path. Repeated rows stay repeated; other columns are not looked at. Empty
    tables give no rows; without rules every url gets the default.
    """
    spark = pages.sparkSession
    deepest = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    urls = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    labels = reversed_labels(F.col("host"))
    depths = F.least(F.size("labels"), F.lit(deepest))
    probes = (
        urls.withColumn("labels", labels)
        .withColumn("n", depths)
        .withColumn("depth", F.explode(F.sequence(F.lit(1), F.col("n"))))
        .withColumn("key", F.encode(F.concat(F.array_join(F.expr("slice(labels, 1, depth)"), "."), F.lit("#"), "path"), "UTF-8"))
        .withColumn("salt", F.shiftrightunsigned(F.xxhash64("id", "host", "path"), 1))
        .drop("labels")
    )
    segments = materialize(rule_segments(rules), "segments")

    ranges = min(MOST_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = SAMPLE_PER_RANGE * ranges / max(pages.count(), 1)
    sample = probes.where(F.rand(7) < share).select("key", "salt").collect()  # about as many rows for any table
    sample = sorted((bytes(r["key"]), r["salt"]) for r in sample)
    cuts = sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else []
    literals = [F.struct(F.lit(k).alias("key"), F.lit(s).cast("long").alias("salt")) for k, s in cuts]

    def range_of(key: Column, salt: Column) -> Column:
        if not literals:
            return F.lit(0)
        at = F.struct(key.alias("key"), salt.alias("salt"))
        return F.size(F.filter(F.array(*literals), lambda cut: cut <= at))

    placed = segments.withColumn("range", range_of(F.col("key"), F.lit(-1).cast("long")))
    last = placed.groupBy("range").agg(F.max(F.struct("key", "rule")).alias("open"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        spark.range(len(literals) + 1)  # at most MOST_RANGES rows
        .select(F.col("id").cast("int").alias("range"))
        .join(last, "range", "left")
        .select("range", F.last("open.rule", ignorenulls=True).over(before).alias("rule"))
        .where("rule is not null")
        .select("range", F.lit(b"").alias("key"), "rule")
    )
    line = placed.select("range", "key", "rule").unionByName(carried).withColumn("is_probe", F.lit(False))
    swept = (
        probes.withColumn("range", range_of(F.col("key"), F.col("salt")))
        .withColumn("is_probe", F.lit(True))
        .unionByName(line, allowMissingColumns=True)
        .withColumn(
            "top",
            F.last("rule", ignorenulls=True).over(
                Window.partitionBy("range").orderBy("key", "is_probe").rowsBetween(Window.unboundedPreceding, 0)
            ),
        )
        .where("is_probe")
    )
    won = swept.groupBy("id", "host", "path", "n").agg(F.max("top").alias("top"), F.count("*").alias("rows"))
    repeated = won.withColumn("copy", F.explode(F.expr("sequence(1, cast(rows / n as int))")))
    fits = F.col("top.name") != ""
    return repeated.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.when(fits, F.col("top.name")).alias("rule"),
        F.when(fits, F.col("top.verdict")).otherwise(F.lit(default)).alias("verdict"),
    )
