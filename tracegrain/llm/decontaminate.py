"""Benchmark decontamination: size-partitioned MinHash containment search, natively.

A test item is short and a document may be very long, so the MinHash of the
*item* alone is taken (containment MinHash): under each of ``coords`` hash
functions the item's smallest shingle is one coordinate, and a document agrees
with a coordinate when that shingle is among its own. Each coordinate agrees
with probability equal to the containment ``|A & D| / |A|``, however large D is,
which the equality of two minima would not give.

Sizes partition both sides: items are classed by the binary order of their
shingle count; each class has as many coordinates as it needs (small items use
all their shingles and are exact already) and its own number of agreements that
makes a candidate; a document only meets classes whose items it could contain.
A document agreeing in the set share of coordinates is a candidate, and every
candidate is verified on the full sets of shingle strings.

With 16 coordinates and four agreements asked for (a fifth of them), an item
contained at 0.8 is missed with probability P[Bin(16, 0.8) < 4] = 2.5e-7.

The coordinates (a few for each item) are broadcast only if their counted
number is below ``broadcast_rows``; else the join shuffles on the shingle.
Candidates are written to the shared folder, so Spark knows their size when it
chooses how to join them back.

Defined results: null or empty texts have no shingles and match nothing; a text
of fewer than five words is one shingle; null ids are kept as such; repeated
rows of one id and text are one document, other texts of that id count apart and
the largest containment is reported, of equal ones that with more shingles; very
long texts are read whole; empty tables give an empty table; extra columns are
ignored or carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import materialize

SHINGLE_WORDS = 5
#: Words are runs of letters and digits, in lower case.
NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case words of a text; empty for a null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _starts(array: Column, n: int) -> Column:
    """Places at which shingles begin: one at least, if there is any word."""
    return F.when(
        F.size(array) > 0, F.sequence(F.lit(1), F.greatest(F.size(array) - (n - 1), F.lit(1)))
    ).otherwise(F.array().cast("array<int>"))


def shingle_hashes(array: Column, n: int = SHINGLE_WORDS) -> Column:
    """A 64-bit hash for each run of ``n`` words; ``array`` holds the words' hashes."""
    return F.transform(_starts(array, n), lambda i: F.xxhash64(*[F.get(array, i - 1 + k) for k in range(n)]))


def shingle_strings(array: Column, n: int = SHINGLE_WORDS) -> Column:
    """Each run of ``n`` words as a string."""
    return F.transform(_starts(array, n), lambda i: F.array_join(F.slice(array, i, n), " "))


def _word_hashes(array: Column) -> Column:
    return F.transform(array, lambda w: F.xxhash64(w))


def item_coordinates(items: DataFrame, coords: int = 16) -> DataFrame:
    """MinHash coordinates of the items: ``item``, ``text_key``, ``size_class``, ``q``, ``needed``, ``x``."""
    hashed = items.select("item", "text_key", _word_hashes(words(F.col("text"))).alias("_w"))
    sets = hashed.select("item", "text_key", F.array_distinct(shingle_hashes(F.col("_w"))).alias("_s")).where(F.size("_s") > 0)
    # The k-th coordinate is the shingle whose k-th hash is the smallest.
    def minimum(k: int) -> Column:
        return F.array_min(F.transform("_s", lambda x: F.struct(F.xxhash64(F.lit(k), x).alias("h"), x.alias("x"))))["x"]

    minima = F.array(*[minimum(k) for k in range(coords)])
    small = F.size("_s") <= coords
    drawn = sets.select("item", "text_key", F.size("_s").alias("q"), F.when(small, F.col("_s")).otherwise(F.array_distinct(minima)).alias("_x"))
    return drawn.select(
        "item",
        "text_key",
        "q",
        F.floor(F.log2("q")).cast("int").alias("size_class"),
        # Agreements asked for: a fifth of the coordinates, far below the 0.8 of them expected.
        F.ceil(F.size("_x") / 5).cast("int").alias("needed"),
        F.explode("_x").alias("x"),
    )


def _document_key(text: Column) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def verified_pairs(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    threshold_percent: int = 80,
    coords: int = 16,
    broadcast_rows: int = 1_000_000,
) -> DataFrame:
    """``doc, key, item, text_key, q, n``: documents (by id and text) with the items that they contain."""
    key = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull())
    items = items.select(F.col(item_id).alias("item"), F.col(text).alias("text"), key.alias("text_key"))
    signature = item_coordinates(items, coords)
    signature = materialize(signature, "item-coordinates")
    least = signature.agg(F.min("q"), F.count(F.lit(1))).first()
    if least[0] is None:
        least = (1, 0)
    probe = signature.select("x", "item", "text_key", "q", "needed", "size_class")
    if least[1] <= broadcast_rows:
        probe = F.broadcast(probe)

    docs = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    doc_key = _document_key(F.col("text"))
    hashed = docs.select("doc", doc_key.alias("key"), _word_hashes(words(F.col("text"))).alias("_w"))
    # No document smaller than threshold x the smallest item can hold one.
    hashed = hashed.where(100 * F.size("_w") >= threshold_percent * F.lit(least[0]))
    exploded = hashed.select(
        "doc",
        "key",
        F.floor(F.log2(F.greatest(F.size("_w"), F.lit(1)).cast("double"))).cast("int").alias("doc_class"),
        F.explode(shingle_hashes(F.col("_w"))).alias("x"),
    )
    agreed = exploded.join(probe, "x").where(F.col("doc_class") + 1 >= F.col("size_class"))
    candidates = (
        agreed.groupBy("doc", "key", "item", "text_key", "needed")
        .agg(F.count_distinct("x").alias("agreed"))
        .where(F.col("agreed") >= F.col("needed"))
        .select("doc", "key", "item", "text_key")
    )
    candidates = materialize(candidates, "contaminated-candidates")

    suspects = candidates.select("doc", "key").distinct()
    suspects = suspects.select(F.col("doc").alias("_doc"), F.col("key").alias("_key"))
    again = docs.select("doc", doc_key.alias("key"), "text").join(
        suspects, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("key") == F.col("_key")), "left_semi"
    )
    doc_sets = again.select("doc", "key", words(F.col("text")).alias("_w")).select(
        "doc", "key", F.explode(shingle_strings(F.col("_w"))).alias("s")
    )
    item_sets = items.select("item", "text_key", words(F.col("text")).alias("_w"))
    item_sets = item_sets.select("item", "text_key", F.array_distinct(shingle_strings(F.col("_w"))).alias("_s"))
    item_sets = item_sets.select("item", "text_key", F.size("_s").alias("q"), F.explode("_s").alias("s"))
    shared = (
        doc_sets.join(item_sets, "s")
        .groupBy("doc", "key", "item", "text_key", "q")
        .agg(F.count_distinct("s").alias("n"))
        .where(100 * F.col("n") >= threshold_percent * F.col("q"))
    )
    return shared.join(
        candidates.select(*[F.col(c).alias(f"_{c}") for c in candidates.columns]),
        F.col("doc").eqNullSafe(F.col("_doc"))
        & (F.col("key") == F.col("_key"))
        & F.col("item").eqNullSafe(F.col("_item"))
        & (F.col("text_key") == F.col("_text_key")),
        "left_semi",
    )


def find_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", **options) -> DataFrame:
    """Pairs ``doc_id``, ``item_id`` with ``item_shingles``, ``shared_shingles``, ``containment``."""
    verified = verified_pairs(docs, items, doc_id, item_id, **options)
    best = F.max(F.struct((F.col("n") / F.col("q")).alias("share"), "q", "n"))
    return (
        verified.groupBy("doc", "item")
        .agg(best.alias("_best"))
        .select(
            F.col("doc").alias(doc_id),
            F.col("item").alias(item_id),
            F.col("_best.q").cast("long").alias("item_shingles"),
            F.col("_best.n").alias("shared_shingles"),
            (F.col("_best.n") / F.col("_best.q")).alias("containment"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item; ids may be null."""
    found = materialize(verified_pairs(docs, items).select("doc", "key").distinct(), "contaminated")
    same = docs["doc_id"].eqNullSafe(found["doc"]) & (_document_key(docs["text"]) == found["key"])
    return docs.join(found, same, "left_anti")
