"""Document fingerprints by spot signatures, in DataFrame operations only.

A signature is a common word (the anchor) and the chain of the next ``CHAIN`` content words, hashed to 32 bits; common words
in between are passed over, and of several common words in a row each is an anchor. Prose is full of anchors and page furniture is not, so signatures sit in the body. A text's
fingerprint is the sorted set of its signatures. A text without a whole chain has one signature, the hash of its words.

Anchors are found by marking: in the text, reduced to words with one space between them, each common word is tied to the
next word with ``~``; what is split at spaces then is one content word, with its anchors in front.

``similar_pairs`` finds all pairs of fingerprints at a Jaccard likeness of at least a threshold: fingerprints are partitioned by
set length, so that partners lie in the same or the next partition; a pair is a candidate if it shares one of the rarest
signatures of both (so many that no pair can be missed), lengths too far apart are pruned, and the rest is verified.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHAIN = 3
THRESHOLD = 0.8
ROWS_IN_BUCKET = 256
MOST_BUCKETS = 1 << 20

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in is that it for was with as on be by this at are from or an not have which "
    "der die das und ist nicht ein eine zu den von mit sich auf dem für im es auch als "
    "le la les et des est une que dans qui pour pas sur par au avec ce il du "
    "el los las en un no se por con una para del lo como más su al a de y"
).split()


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted distinct signatures of a text, at least one."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    choice = "|".join(sorted(set(anchors)))
    tied = F.regexp_replace(plain, rf"(?<![^ ])({choice}) ", "$1~")

    def chains(tokens: Column) -> Column:
        def hashed(contents: Column) -> Column:
            def at(token: Column, i: Column) -> Column:
                parts = F.split(token, "~")
                return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda anchor: F.hash(anchor, F.slice(contents, i + 1, chain)))

            whole = F.slice(tokens, 1, F.greatest(F.size(tokens) - chain + 1, F.lit(0)))
            return F.array_distinct(F.flatten(F.transform(whole, at)))

        contents = F.transform(tokens, lambda t: F.substring_index(t, "~", -1))
        return F.transform(F.array(contents), hashed)[0]

    found = F.transform(F.array(F.split(tied, " ")), chains)[0]
    filled = F.transform(F.array(found), lambda s: F.when(F.size(s) > 0, F.sort_array(s)).otherwise(F.array(F.hash(plain))))
    return filled[0]


def likeness(one: Column, other: Column) -> Column:
    """The Jaccard likeness of two signature sets."""
    both = F.size(F.array_intersect(one, other))
    return F.transform(F.array(both), lambda n: n / (F.size(one) + F.size(other) - n))[0]


def as_text(found: Column) -> Column:
    return F.array_join(found.cast("array<string>"), ",")


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (id, text, found, next_text, next_found): each text and its signatures with those of the next document by falling id.

    After the last comes the first. Ids are whole numbers; null ids come last; equal ids are ordered by a hash of their
    text. Rows go to buckets of equal id ranges, about ``ROWS_IN_BUCKET`` rows each and at most ``MOST_BUCKETS`` of them, and
    the first row of every bucket goes to the bucket above it as well; so one shuffle brings neighbours together. The table
    of buckets (a row each) is the only thing that is broadcast.
    """
    low, high, rows = docs.agg(F.min(id_col), F.max(id_col), F.count("*")).first()
    low, high = low or 0, high or 0
    wanted = min(MOST_BUCKETS, -(-rows // ROWS_IN_BUCKET) or 1)
    width = -(-(high - low + 1) // wanted)
    bucket = F.coalesce(F.expr(f"({id_col} - {low}L) div {width}L"), F.lit(-1).cast("long"))
    keyed = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), bucket.alias("bucket"))
    heads = keyed.groupBy("bucket").agg(F.max("id").alias("head"))
    order = Window.orderBy("bucket")  # at most MOST_BUCKETS + 1 rows
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(whole))
    heads = heads.select("bucket", "head", above.alias("above"))
    marked = keyed.join(F.broadcast(heads), "bucket", "left")
    is_head = F.col("id").eqNullSafe(F.col("head"))
    places = F.when(
        is_head, F.array(F.struct(F.col("bucket").alias("at"), F.lit(0).alias("guest")), F.struct(F.col("above").alias("at"), F.lit(1).alias("guest")))
    ).otherwise(F.array(F.struct(F.col("bucket").alias("at"), F.lit(0).alias("guest"))))
    dealt = marked.select("id", "text", F.explode(places).alias("p")).select("id", "text", "p.at", "p.guest").repartition("at")
    read = dealt.withColumn("found", signatures(F.col("text"))).withColumn("hash", F.xxhash64("text"))
    near = Window.partitionBy("at").orderBy("guest", F.desc_nulls_last("id"), "hash")
    return (
        read.withColumn("next_text", F.lead("text").over(near))
        .withColumn("next_found", F.lead("found").over(near))
        .where("guest = 0")
        .select("id", "text", "found", "next_text", "next_found")
    )


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_chars, edited, found, edited_found, near_edited, near_next), one for each row of ``docs``.

    ``edited`` is the text with its last third replaced by the beginning of the next document, ``found`` and
    ``edited_found`` are the signature sets, the others their likeness and that of the next document's. A null text
    counts as empty; repeated rows stay repeated; other columns are not looked at; an empty table gives no rows.
    """
    size = F.length("text")
    third = F.expr("length(text) div 3").cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - third), F.substring("next_text", F.lit(1), third))
    rows = with_next(docs, id_col, text_col).withColumn("edited", edited).withColumn("edited_found", signatures(F.col("edited")))
    return rows.select(
        F.col("id").alias(id_col),
        size.cast("long").alias("n_chars"),
        "edited",
        "found",
        "edited_found",
        likeness(F.col("found"), F.col("edited_found")).alias("near_edited"),
        likeness(F.col("found"), F.col("next_found")).alias("near_next"),
    )


def similar_pairs(found: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of rows (id, found): pairs (a, b, likeness) of representatives, and (id, representative) of all rows.

    Equal fingerprints are one class, named by its least id; a pair stands for all pairs of its classes' members.
    """
    keyed = found.select(F.col(id_col).alias("id"), "found", F.xxhash64("found").alias("class"))
    classes = keyed.groupBy("class").agg(F.min("id").alias("name"))
    members = keyed.join(classes, "class").select(F.col("id").alias(id_col), F.col("name").alias("representative"))
    sets = keyed.join(classes, F.col("id").eqNullSafe(F.col("name")) & (keyed["class"] == classes["class"])).select("name", "found")
    sets = sets.dropDuplicates(["name"]).withColumn("size", F.size("found"))
    tokens = sets.select("name", "size", F.explode("found").alias("token"))
    counts = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    rare = Window.partitionBy("name").orderBy(F.col("n").isNotNull(), "n", "token")
    reach = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1
    part = F.floor(F.log("size") / -math.log(threshold) + 1e-9)
    prefix = (
        tokens.join(counts, "token", "left")
        .withColumn("place", F.row_number().over(rare))
        .where((F.col("place") <= reach) & F.col("n").isNotNull())
        .select("name", "size", "token", part.alias("part"))
    )
    short = prefix.select(F.col("name").alias("a"), F.col("size").alias("a_size"), "token", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    long = prefix.select(F.col("name").alias("b"), F.col("size").alias("b_size"), "token", "part")
    ordered = (F.col("a_size") < F.col("b_size")) | ((F.col("a_size") == F.col("b_size")) & (F.col("a") < F.col("b")))
    candidates = (
        short.join(long, ["token", "part"])
        .where(ordered & (F.col("a_size") >= F.col("b_size") * threshold - 1e-9))
        .select("a", "b")
        .distinct()
    )
    pairs = (
        candidates.join(sets.select(F.col("name").alias("a"), F.col("found").alias("a_found")), "a")
        .join(sets.select(F.col("name").alias("b"), F.col("found").alias("b_found")), "b")
        .select("a", "b", likeness(F.col("a_found"), F.col("b_found")).alias("likeness"))
        .where(F.col("likeness") >= threshold)
    )
    return pairs, members
