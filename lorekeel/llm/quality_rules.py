"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams are hashed into a fixed number of buckets. Two
multinomials are counted over them: one over a trusted target (documents labelled
good), one over the whole raw corpus. A document's score is the mean, over its
n-grams, of the log ratio of the two probabilities, and one threshold decides for
every document. Counts are DataFrame aggregations over all documents; the ratios
are one array of ``BUCKETS`` whole numbers, whatever the input's size.

The threshold is no constant: few trusted documents give ratios near 0, many give
steeper ones. The trusted documents are therefore cut into ``FOLDS`` folds, each scored
with the ratios of the others, and the threshold lies below what such held-out good
documents reach. So the share of good documents that is lost stays the same, however
many labels there are; with few labels less junk is told from them. Target and
threshold are of all trusted documents; nothing is sampled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, whole_text, words_of

#: Hash buckets of the n-grams; the table of ratios has this fixed size.
BUCKETS = 1 << 16
#: At most so many labelled documents are broadcast; beyond, they are joined.
BROADCAST_ROWS = 1_000_000
#: Beyond, so many slots of 64 bits are broadcast; a document whose hash has no bit there is not trusted and is not exchanged.
SLOTS = 1 << 20
#: Pseudo-count: a bucket seen this often by expectation moves half-way to its measured ratio.
PSEUDO = 8.0
#: Ratios are kept as whole numbers of 1/UNITS.
UNITS = 1000
#: Parts of the trusted documents; each is held out once.
FOLDS = 5
#: The threshold: this quantile of the held-out scores of trusted documents, and this many standard deviations below their mean, whichever is lower.
LOST, DEVIATIONS = 0.001, 3.0
#: Words from which a document counts (a base rule), also in the calibration.
FEWEST_WORDS = 50

NO_SYMBOLS = "[^#*$%&|<>]+"


def word_hashes(words: Column) -> Column:
    """A 64-bit hash for each word; all n-grams are built from these."""
    return F.transform(words, lambda w: F.xxhash64(w))


def ngram_buckets(hashes: Column) -> Column:
    """Hash buckets of the unigrams and bigrams of an array of word hashes."""
    ones = F.transform(hashes, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))
    twos = F.transform(
        F.slice(hashes, 2, F.greatest(F.size(hashes), F.lit(1))),
        lambda h, i: F.pmod(F.xxhash64(F.get(hashes, i), h), F.lit(BUCKETS)).cast("int"),
    )
    return F.concat(ones, twos)


def base_counts(frame: DataFrame) -> DataFrame:
    """Adds the base columns to a frame (box, id, text, hashes)."""
    text, hashes = F.col("text"), F.col("hashes")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    threes = F.transform(
        F.slice(hashes, 3, F.greatest(F.size(hashes), F.lit(1))), lambda h, i: F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1), h)
    )
    counted = frame.select(
        "*",
        F.size(hashes).cast("long").alias("n_words"),
        (F.length(text) - F.length(F.regexp_replace(text, WORD, ""))).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, NO_SYMBOLS, "")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        threes.alias("threes"),
    )
    counted = counted.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    some = F.size(F.array_distinct("threes")) < F.size("threes")
    tagged = F.when(some, F.sort_array(F.transform("threes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    counted = counted.withColumn("sorted", tagged).drop("lines", "threes")
    ranked = F.col("sorted")
    same = F.filter(
        ranked,
        lambda x, k: ((k > 0) & (F.get(ranked, k - 1)["h"] == x["h"])) | F.coalesce(F.get(ranked, k + 1)["h"] == x["h"], F.lit(False)),
    )
    within = F.flatten(F.transform(same, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    counted = counted.withColumn("n_repeat_words", F.coalesce(F.size(F.array_distinct(within)), F.lit(0)).cast("long")).drop("sorted")
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def trusted_ids(labels: DataFrame, most: int | None = None) -> DataFrame:
    """The distinct doc_ids labelled good; ``most`` bounds them for a caller that wants fewer, picked by hash."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("trusted_id"))
    if most is None:
        return good.distinct()
    share = min(1.0, most / max(1, good.count()))
    picked = good.where(F.pmod(F.xxhash64("trusted_id"), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30)))).distinct()
    return picked.orderBy(F.xxhash64("trusted_id"), "trusted_id").limit(most)


def bit_of(key: Column) -> tuple[Column, Column]:
    """The slot of a key and its bit in it."""
    h = F.xxhash64(key)
    return F.pmod(h, F.lit(SLOTS)).cast("int"), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")


def split_by_bits(frame: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``frame`` (id, ...) in two: rows that may be trusted (all that are, and few others), and rows that are not."""
    sure = F.col("id").isNotNull()  # null ids are never trusted; in an exchange they would meet in one task
    if frame.schema["id"].dataType != known.schema["trusted_id"].dataType:  # equal keys of two types have two hashes
        return frame.where(sure), frame.where(~sure)
    slot, bit = bit_of(F.col("trusted_id"))
    bits = cut(known.groupBy(slot.alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")), narrow=True)
    slot, bit = bit_of(F.col("id"))
    marked = frame.join(F.broadcast(bits), slot == F.col("slot"), "left")
    maybe = sure & F.coalesce(F.getbit("bits", bit) == 1, F.lit(False))
    return marked.where(maybe).drop("slot", "bits"), marked.where(~maybe).drop("slot", "bits")


def folds_of(frame: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """``frame`` (id, ...) with the fold of its trusted documents, null for others; ``how`` is left or inner."""
    same = F.col("id") == F.col("trusted_id")
    if known.count() <= BROADCAST_ROWS:
        return frame.join(F.broadcast(known), same, how).drop("trusted_id")
    near, far = split_by_bits(frame, known)
    met = near.join(known, same, how).drop("trusted_id")
    return met if how == "inner" else met.unionByName(far.withColumn("fold", F.lit(None).cast("int")))


def ratio_tables(frame: DataFrame, known: DataFrame) -> DataFrame:
    """bucket, ratios: smoothed log ratios in 1/UNITS, of all trusted documents, then of all but each fold.

    ``frame`` has (id, hashes) or (id, text) of all documents, ``known`` (trusted_id,
    fold). Texts are hashed after the trusted ones are known, so that no hashes are exchanged.
    ratio = ln((target count + k) / (target count expected from the raw share + k)).
    Without trusted documents or without words all ratios are 0.
    """
    hashes = F.col("hashes") if "hashes" in frame.columns else word_hashes(words_of(F.col("text")))
    met = folds_of(frame, known, "left").select("fold", hashes.alias("hashes"))
    grams = met.select("fold", F.explode(ngram_buckets(F.col("hashes"))).alias("bucket"), F.lit(1).cast("long").alias("times"))
    # every bucket is there, unseen ones with no times: the ratios then need no join
    unseen = grams.sparkSession.range(0, BUCKETS, 1, 1).select(F.lit(None).cast("int").alias("fold"), F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("times"))
    met = grams.select(F.col("fold").cast("int").alias("fold"), "bucket", "times").unionByName(unseen)
    targets = ("t", *[f"t{k}" for k in range(FOLDS)])
    counts = cut(met.groupBy("bucket").agg(F.sum("times").alias("raw"), F.count("fold").alias("t"), *[F.count_if(F.col("fold") != k).alias(f"t{k}") for k in range(FOLDS)]))
    sums = F.broadcast(counts.agg(F.sum("raw").alias("all_raw"), *[F.sum(t).alias(f"all_{t}") for t in targets]))

    def ratio(t: str) -> Column:
        expected = F.col("raw") * F.col(f"all_{t}") / F.greatest("all_raw", F.lit(1))
        return F.round(F.log((F.col(t) + F.lit(PSEUDO)) / (expected + F.lit(PSEUDO))) * UNITS).cast("int")

    return cut(counts.join(sums, F.lit(True)).select("bucket", F.array(*map(ratio, targets)).alias("ratios")))


def mean_ratio(hashes: Column, table: list[int]) -> Column:
    """A document's score: the mean of its n-grams' ratios, 0 without words."""
    # BUCKETS whole numbers, as one constant of the plan: a column would be copied with every row
    ratios = F.from_json(F.lit("[" + ",".join(map(str, table)) + "]"), "array<int>")
    grams = ngram_buckets(hashes)
    total = F.aggregate(grams, F.lit(0).cast("long"), lambda a, g: a + F.get(ratios, g))
    return F.when(F.size(hashes) > 0, total / ((2 * F.size(hashes) - 1) * UNITS)).otherwise(F.lit(0.0))


def held_out_threshold(frame: DataFrame, known: DataFrame, ratios: DataFrame) -> float:
    """The threshold from all trusted documents of ``frame`` (id, text), each scored with the other folds' ratios.

    The quantile is interpolated between two scores, found by sorting as many of the
    lowest as lie below it. Without two scores there is nothing to go by, and no
    document is rejected.
    """
    # numbered above the join: below it, Spark would move the filter on the words there too and hash every text again
    met = folds_of(frame, known, "inner").select(F.monotonically_increasing_id().alias("row"), "fold", word_hashes(words_of(F.col("text"))).alias("hashes"))
    grams = met.where(F.size("hashes") >= FEWEST_WORDS).select("row", "fold", F.explode(ngram_buckets(F.col("hashes"))).alias("bucket"))
    scores = cut(grams.join(F.broadcast(ratios), "bucket").groupBy("row").agg((F.avg(F.get("ratios", F.col("fold") + 1)) / UNITS).alias("score")).select("score"))
    whole = scores.agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev("score").alias("deviation")).first()
    if whole["n"] < 2:
        return -math.inf
    place = (whole["n"] - 1) * LOST
    lowest = scores.orderBy("score").limit(int(place) + 2)
    near = [r["score"] for r in lowest.orderBy(F.desc("score")).limit(2).collect()]  # the two scores about the quantile, the higher first
    quantile = near[1] + (place - int(place)) * (near[0] - near[1])
    return min(quantile, whole["mean"] - DEVIATIONS * whole["deviation"])


def quality_scores(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float | None = None, most: int | None = None
) -> DataFrame:
    """One row per input row: box (its columns as a struct), id, the base columns, score, kept.

    Null texts have no words, so they fail the base rule as do all texts under 50
    words. Null doc_ids are never trusted. Repeated rows are scored alike. The
    input's columns stay in ``box``, so their names cannot clash with the results.
    """
    bare = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("box"), F.col(doc_id).alias("id"), whole_text(text).alias("text"))
    frame = bare.withColumn("hashes", word_hashes(words_of(F.col("text"))))
    known = cut(trusted_ids(labels, most).withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "trusted_id"), F.lit(FOLDS))))
    ratios = ratio_tables(bare.select("id", "text"), known)
    if threshold is None:
        threshold = held_out_threshold(bare.select("id", "text"), known, ratios)
    found = ratios.select("bucket", F.col("ratios")[0].alias("ratio")).collect()  # BUCKETS rows, sorted here: a sort of them in Spark is an exchange
    table = [ratio for _, ratio in sorted(found)]
    scored = base_counts(frame).withColumn("score", mean_ratio(F.col("hashes"), table))
    results = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")
    scored = scored.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(threshold)))
    # Through a generator: a caller's filter then stays above the counting, and every count is made once for a row.
    return scored.select("box", "id", F.explode(F.array(F.struct(*results))).alias("result")).select("box", "id", "result.*")


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that pass, with the columns of ``docs``; rules as quality_scores."""
    return quality_scores(docs, labels, **options).where("kept").select("box.*")
