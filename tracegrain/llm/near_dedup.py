"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard.

Sketching (one pass, in Arrow batches): a document's words are hashed, its set
of distinct word shingles is taken whole, and two permutations make its whole
signature: the first places a shingle in a circle of ``2**20`` positions, and
coordinate ``k`` is the least value that the second permutation, turned by
``k``, has at the occupied positions. All coordinates of one shingle are
neighbours in the second table, so no further hash function is evaluated.
Bands of the signature are hashed into bucket keys; rows and bands are chosen so
that a pair at the threshold shares no bucket with probability below ``miss``.

Copies: documents with equal sets (a 128-bit digest of the sorted set) are one
node, grouped with partial aggregation, however many they are.

Links: the graph's components are wanted, not its pairs. A bucket is open while
it holds several components. A round compares the members of open buckets with a
few pivots of each, which is linear in the bucket; what links is merged, and
buckets of one component close. The first round takes a pivot by a hash. Then an
aggregation counts, for every node still contested, how many of its shingles any
other component has (nodes for which that is too few for a link leave) and how
often contested nodes have them. The second round's pivots are the ``PIVOTS``
nodes of each bucket that overlap most with all others: what links with
anything in a group of edited copies mostly links with those.

What is left is settled exactly. In small buckets, members outside the largest
component meet the others. In crowded ones only prefixes meet: a node's shared
shingles are ordered from the rarest on, and a pair that links has a common
shingle among the first ``c - need + 1`` of either, where ``need`` is the least
overlap with which the node can link at all. Where that shingle stands also
bounds the overlap, so copies whose edits are their own are refuted by two
numbers and never made a pair. Hence every pair that shares a bucket is in one
component, or is refuted by a bound, or has been compared on full sets: no cap,
no sampling. The pairs left grow with the group as long as it has members near
its middle; copies that are all equally far from each other, just below the
threshold, can need a comparison for each pair that no bound refutes.

Keys, shingles and pivots that many rows share are split: those with more than
1/4096 of a join's rows (fewer than 4096, hence) go by broadcast or in parts.

Intermediate tables (sketches, buckets, sets of documents that share a bucket,
labels) are written to the shared folder. Nothing but counts reaches the driver.

Defined results: null and wordless texts have no shingles, and are linked with
nothing; rows without an id are linked with nothing and have no component id;
fewer words than a shingle make the whole sequence one shingle; repeated rows
are copies; different texts under one id count as different documents; an empty
table gives an empty table; very long texts are sketched whole; of several texts
that could stand for a group the least id's does (ties: the least hash of the
text); extra columns are ignored or carried along, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .worker_memory import release
from .workspace import materialize

_CIRCLE_BITS = 20
_SEED = 20_240_229
#: Shingles whose coordinates are gathered at once, and characters taken at once.
_GATHER, _SLICE = 4096, 1 << 20
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Ids (8 bytes each) that may be broadcast; beyond, joins shuffle.
BROADCAST_IDS = 2_000_000
#: Pivots of a bucket in the second round, and members up to which an open bucket is compared directly in the end.
PIVOTS, CROWD = 2, 16
#: A key with more than this part of a join's rows is split; a part holds about so many rows.
HOT, PART = 4096, 1024
_U = np.uint64


@dataclass(frozen=True)
class Banding:
    """Links at ``100 * intersection >= percent * union`` of sets of ``words``-word shingles."""

    words: int = 3
    percent: int = 85
    rows: int = 6
    miss: float = 1e-6

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def circulant_tables(coordinates: int) -> tuple[np.ndarray, np.ndarray]:
    """The placing permutation, and windows of the turning one: row p holds its values from p on."""
    if coordinates not in _TABLES:
        rng = np.random.default_rng(_SEED)
        n = 1 << _CIRCLE_BITS
        place = rng.permutation(n).astype(np.uint32)
        turn = rng.permutation(n).astype(np.uint32)
        round_ = np.concatenate([turn, turn[: coordinates - 1]])
        _TABLES[coordinates] = place, np.lib.stride_tricks.sliding_window_view(round_, coordinates)
    return _TABLES[coordinates]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    held = np.empty(len(words), dtype=object)
    held[:] = [w.decode("latin-1") for w in words]
    return pd.util.hash_array(held, categorize=False)


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a document's word hashes."""
    if not len(hashes):
        return hashes
    k = min(n, len(hashes))
    out = np.full(len(hashes) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - k + 1 + i])
    return np.unique(out)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of a non-empty set."""
    place, windows = circulant_tables(coordinates)
    at = place[(shingles & _U((1 << _CIRCLE_BITS) - 1)).astype(np.int64)]
    best = windows[at[:_GATHER]].min(axis=0)
    for start in range(_GATHER, len(at), _GATHER):
        np.minimum(best, windows[at[start : start + _GATHER]].min(axis=0), out=best)
    return best


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    n, coordinates = signatures.shape
    bands = signatures.reshape(n, coordinates // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=np.uint64), bands.shape[:2])
    for i in range(rows):
        key = _mix(key * _U(0x9E3779B97F4A7C15) + bands[:, :, i])
    return key


def _sets(texts: list[str | None], n: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Slices of a batch: where each begins, and its documents' shingle sets."""
    start = 0
    while start < len(texts):
        end, size, words, counts = start, 0, [], []
        while end < len(texts) and size < _SLICE:
            own = (texts[end] or "").encode("utf-8", "surrogatepass").lower().split()
            words += own
            counts.append(len(own))
            size += len(texts[end] or "")
            end += 1
        hashes = word_hashes(words)
        bounds = np.cumsum([0, *counts])
        yield start, [shingle_set(hashes[a:b], n) for a, b in zip(bounds[:-1], bounds[1:])]
        start = end


def text_key(text: Column) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def sketch(docs: DataFrame, banding: Banding, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``text_key``, ``n`` (set size), ``digest`` of the set, ``bands`` (keys; empty without shingles)."""
    coordinates = banding.bands * banding.rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, sets in _sets(batch["text"].tolist(), banding.words):
                keys: list = [[]] * len(sets)
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    signed = np.stack([signature(sets[i], coordinates) for i in full])
                    for i, k in zip(full, band_keys(signed, banding.rows).astype(np.int64)):
                        keys[i] = k
                yield pd.DataFrame(
                    {
                        "doc": batch["doc"].iloc[start : start + len(sets)].tolist(),
                        "text_key": batch["text_key"].iloc[start : start + len(sets)].tolist(),
                        "n": [len(s) for s in sets],
                        "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                        "bands": keys,
                    }
                ).astype({"doc": "Int64"})
        release()

    return docs.select(F.col(doc_id).cast("long").alias("doc"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("text")).mapInPandas(
        run, "doc long, text_key long, n long, digest binary, bands array<long>"
    )


def full_sets(docs: DataFrame, banding: Banding) -> DataFrame:
    """``doc``, ``digest``, ``set`` of (doc, text) rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start, sets in _sets(batch["text"].tolist(), banding.words):
                yield pd.DataFrame(
                    {
                        "doc": batch["doc"].iloc[start : start + len(sets)].tolist(),
                        "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                        "set": [s.astype(np.int64) for s in sets],
                    }
                )
        release()

    return docs.select("doc", "text").mapInPandas(run, "doc long, digest binary, set array<long>")


def merge_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels (node, root) after the edges (a, b) between roots: components by hooking and jumping.

    Every root hooks to its least neighbour if that is smaller, and follows four
    such steps by two doublings; edges are contracted, until none is left. A
    chain that is longer keeps an edge between the places that its parts have
    come to, so the next turn goes on from there.
    """
    edges = materialize(edges.where("a <> b").distinct(), "edges")
    changed = False
    while not edges.isEmpty():
        changed = True
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("to"))
        up = materialize(up.select(F.col("a").alias("x"), F.least("a", "to").alias("up")), "parents")
        for _ in range(2):
            up = up.join(up.select(F.col("x").alias("up"), F.col("up").alias("upper")), "up").select("x", F.col("upper").alias("up"))
        up = materialize(up, "parents")
        labels = labels.join(up.withColumnRenamed("x", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        a = up.select(F.col("x").alias("a"), F.col("up").alias("ra"))
        b = up.select(F.col("x").alias("b"), F.col("up").alias("rb"))
        edges = edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        edges = materialize(edges, "edges")
    return materialize(labels, "labels") if changed else labels


def _spread(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join on ``key``, whose ``weight`` in ``right`` is its number of rows in ``left`` (``total`` in all).

    Keys with more than ``total / HOT`` rows, fewer than ``HOT``, are broadcast;
    no other key is large enough to burden a task.
    """
    most = total // HOT
    hot = F.broadcast(right.where(F.col(weight) > most))
    rest = left.join(F.broadcast(right.where(F.col(weight) > most).select(key)), key, "left_anti")
    return left.join(hot, key).unionByName(rest.join(right.where(F.col(weight) <= most), key))


def _parts(n: Column) -> Column:
    """A row for each of ``n`` parts."""
    return F.explode(F.sequence(F.lit(0).cast("long"), (n - 1).cast("long")))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ca, cb) whose full sets link; repeated pairs are compared once.

    The set of a node that is in many pairs is entered once for each part of them.
    """
    pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "ca", "cb").dropDuplicates(["a", "b"]), "pairs")
    total = pairs.count()

    most = max(total // HOT, PART)
    hot = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > most)
    hot = hot.select("node", F.ceil(F.col("k") / PART).cast("int").alias("parts"))
    hot = materialize(hot, "hot") if total > most else None  # fewer than 2 * HOT

    def with_set(df: DataFrame, node: str, other: str) -> DataFrame:
        named = sets.select(F.col("node").alias(node), F.col("set").alias(f"s{node}"))
        if hot is None:
            return df.join(named, node)
        split = F.broadcast(hot.withColumnRenamed("node", node))
        parts = F.coalesce("parts", F.lit(1))
        named = named.join(split, node, "left").select(node, f"s{node}", _parts(parts).alias("part"))
        df = df.join(split, node, "left").withColumn("part", F.pmod(F.xxhash64(other), parts).cast("long")).drop("parts")
        return df.join(named, [node, "part"]).drop("part")

    both = F.size(F.array_intersect("sa", "sb"))
    return (
        with_set(with_set(pairs, "b", "a"), "a", "b")
        .withColumn("_both", both)
        .where(100 * F.col("_both") >= percent * (F.size("sa") + F.size("sb") - F.col("_both")))
        .select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    )


def _can_link(n: str, m: str, c: str, d: str, percent: int) -> Column:
    """Whether sets of sizes n and m, of which c and d shingles at most are shared, can link."""
    most = F.least(c, d, n, m)
    return 100 * most >= percent * (F.col(n) + F.col(m) - most)


def near_duplicates(
    docs: DataFrame,
    banding: Banding = Banding(),  # noqa: B008  frozen
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc``, ``n``, ``component`` (least id reachable) for every row of ``docs``."""
    return _grouped(docs, banding, doc_id, text).select("doc", "n", F.coalesce("first.doc", "doc").alias("component"))


def _grouped(docs: DataFrame, banding: Banding, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc``, ``text_key``, ``n``, ``first`` for every row of ``docs``.

    ``first`` is the least (doc, text_key) of the row's group, and null for rows
    that are linked with nothing by definition. Groups of different texts can
    have the same least id, but no two have the same ``first``.
    """
    sketches = materialize(sketch(docs, banding, doc_id, text), "sketches")
    nodes = (
        sketches.where("doc IS NOT NULL AND n > 0")
        .groupBy("digest")
        .agg(F.min(F.struct("doc", "text_key")).alias("first"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        .withColumn("doc", F.col("first.doc"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    nodes = materialize(nodes, "nodes")  # ids are fixed from here on

    keyed = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
    members = materialize(keyed.join(shared, "key"), "buckets")
    live = materialize(members.select("node").distinct(), "live")

    wanted = nodes.join(live, "node").select("node", "doc", F.col("digest").alias("own"))
    count = live.count()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    ids = wanted.select("doc").distinct()
    rows = rows.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, "doc", "left_semi")
    sets = full_sets(rows, banding).join(wanted, "doc").where("digest = own").dropDuplicates(["node"]).select("node", "set")
    sets = materialize(sets, "sets")

    labels = live.select("node", F.col("node").alias("root"))
    percent = banding.percent
    # Nothing is known yet of what a node shares with other components: all of it, at most.
    members = members.withColumn("c", F.col("n"))
    pairs = _star(members, labels, F.xxhash64("node"), 1, percent)
    labels = merge_labels(labels, _verified(pairs, sets, percent))
    members = materialize(_contested(members, labels, sets, percent), "contested")
    pairs = _star(members, labels, -F.col("near"), PIVOTS, percent)
    labels = merge_labels(labels, _verified(pairs, sets, percent))
    labels = merge_labels(labels, _verified(_rest(members, labels, sets, percent), sets, percent))

    rooted = nodes.select("node", "digest", "first").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(rooted.select("digest", "first", "root"), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("first"))
    named = rooted.drop("first").join(least, "root").select("digest", "first")
    rows = sketches.select("doc", "text_key", "n", "digest")
    some = rows.where("doc IS NOT NULL AND n > 0").join(named, "digest").select("doc", "text_key", "n", "first")
    none = rows.where("doc IS NULL OR n = 0").select("doc", "text_key", "n", F.lit(None).cast(named.schema["first"].dataType).alias("first"))
    return some.unionByName(none)


def _open(rows: DataFrame, key: str) -> DataFrame:
    """Keys under which several components meet: ``key``, rows ``m``, largest component ``top``, least size ``least``."""
    parts = rows.groupBy(key, "root").agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("least"))
    whole = parts.groupBy(key).agg(F.sum("k").alias("m"), F.max(F.struct("k", "root")).alias("top"), F.count(F.lit(1)).alias("c"), F.min("least").alias("least"))
    return whole.where("c > 1").select(key, "m", F.col("top.root").alias("top"), "least")


def _rows(opened: DataFrame) -> int:
    return opened.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]


def _star(members: DataFrame, labels: DataFrame, order: Column, pivots: int, percent: int) -> DataFrame:
    """A round's pairs (a, b, ca, cb): the first ``pivots`` of each open bucket with its members of other components.

    A node has a bucket for each band, so it is in ``pivots`` times as many pairs at most, however large its group.
    """
    now = members.join(labels, "node")
    opened = _open(now, "key").select("key", "m")
    first = Window.partitionBy("key").orderBy("o", "node")  # only so many of each partition are shuffled
    ranked = now.withColumn("o", order).withColumn("r", F.row_number().over(first)).where(F.col("r") <= pivots)
    ranked = ranked.select("key", "node", "n", "c", "root", "r").toDF("key", "a", "na", "sa", "ca", "r").join(opened, "key")
    ranked = materialize(ranked, "pivots")
    met = _spread(now, ranked.drop("r"), "key", "m", _rows(ranked.where("r = 1")))
    met = met.where((F.col("ca") != F.col("root")) & _can_link("n", "na", "c", "sa", percent))
    return met.select("a", F.col("node").alias("b"), "ca", F.col("root").alias("cb"))


def _shared_shingles(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """``node``, ``s``, ``d``: shingles of ``nodes`` (node, n, root) that another component's have too, and how many have them."""
    owned = sets.join(nodes, "node").select("node", "root", F.explode("set").alias("s"))
    met = owned.groupBy("s").agg(F.count(F.lit(1)).alias("d"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    met = materialize(met.where("lo <> hi").select("s", "d"), "met")
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return _spread(owned.select("node", "s"), met, "s", "d", total)


def _contested(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members of open buckets that can still link elsewhere: ``node``, ``n``, ``key``, ``c``, ``near``.

    ``c`` counts a node's shingles that some other component's contested node
    has too. Only those can be shared across components, so a node with
    ``100 * c < percent * n`` has no link left and goes, however many members
    its buckets have: one aggregation instead of comparisons. ``near`` is the
    sum of its overlaps with all contested nodes.
    """
    now = members.join(labels, "node")
    nodes = now.join(_open(now, "key").select("key"), "key", "left_semi").select("node", "n", "root").distinct()
    counted = _shared_shingles(materialize(nodes, "contested-nodes"), sets)
    counted = counted.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.sum("d").alias("near"))
    return members.drop("c").join(counted, "node").where(100 * F.col("c") >= percent * F.col("n")).select("node", "n", "key", "c", "near")


def _rest(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """All comparisons still open that no bound refutes, as pairs (a, b, ca, cb)."""
    now = members.join(labels, "node")
    opened = materialize(_open(now, "key"), "open")
    here = _spread(now, opened, "key", "m", _rows(opened)).select("key", "node", "n", "c", "root", "m", "top", "least")
    here = materialize(here, "open-members")
    pairs = _across(here.where(F.col("m") <= CROWD), percent)

    nodes = here.where(F.col("m") > CROWD).groupBy("node").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.min("least").alias("least"))
    nodes = materialize(nodes, "crowded")
    if nodes.isEmpty():
        return pairs
    # Sets of sizes n and m link from an overlap of percent * (n + m) / (100 + percent) on.
    smallest = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    need = F.ceil((F.col("n") + smallest) * percent / (100 + percent))
    ordered = _shared_shingles(nodes, sets).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("d", "s"))).alias("x"))  # one text's own set
    ordered = ordered.join(nodes, "node").select("node", "n", "root", "x", (F.size("x") - need + 1).cast("int").alias("k")).where("k > 0")
    prefix = ordered.select("node", "n", "root", F.size("x").alias("c"), F.posexplode(F.slice("x", F.lit(1), F.col("k"))).alias("i", "e"))
    prefix = materialize(prefix.select("node", "n", "root", F.col("e.s").alias("s"), (F.col("c") - F.col("i")).alias("c")), "prefixes")
    lists = materialize(_open(prefix, "s"), "lists")
    met = _spread(prefix, lists, "s", "m", _rows(lists)).select("s", "node", "n", "c", "root", "top", F.ceil(F.col("m") / PART).cast("int").alias("parts"))
    met = materialize(met, "met-prefixes")
    outside = met.where("root <> top").select("s", "node", "n", "c", "root", _parts(F.col("parts")).alias("part"))
    outside = outside.toDF("s", "a", "na", "sa", "ca", "part")
    met = met.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("long"))
    found = outside.join(met, ["s", "part"]).where((F.col("ca") != F.col("root")) & _once() & _can_link("n", "na", "c", "sa", percent))
    return pairs.unionByName(found.select("a", F.col("node").alias("b"), "ca", F.col("root").alias("cb")))


def _once() -> Column:
    """A pair of two members outside the largest component is made from its smaller node only."""
    return (F.col("root") == F.col("top")) | (F.col("a") < F.col("node"))


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Pairs of members of different components that share a bucket, each once.

    One of the two lies outside the bucket's largest component, so only those
    look for partners; a pair is made in the least of the buckets that it shares.
    """
    keys = members.groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("keys"))  # a node has a key for each band at most
    members = members.join(keys, "node").select("key", "node", "n", "c", "root", "top", "keys")
    outside = members.where("root <> top").select("key", "node", "n", "c", "root", "keys").toDF("key", "a", "na", "sa", "ca", "ka")
    least = F.array_min(F.array_intersect("ka", "keys")) == F.col("key")
    found = outside.join(members, "key").where((F.col("ca") != F.col("root")) & _once() & _can_link("n", "na", "c", "sa", percent) & least)
    return found.select("a", F.col("node").alias("b"), "ca", F.col("root").alias("cb"))


def keep_one(docs: DataFrame, banding: Banding = Banding(words=5, percent=80, rows=5)) -> DataFrame:  # noqa: B008
    """One text of each group: that of the least id, and of its texts that of the least key.

    Rows are told apart by id and text; repeated rows of one id and text stay once.
    """
    found = materialize(_grouped(docs, banding), "duplicates")
    gone = found.where("first IS NOT NULL AND (doc <> first.doc OR text_key <> first.text_key)").select("doc", "text_key").distinct()
    gone = materialize(gone, "dropped")

    def same(rows: DataFrame, named: DataFrame) -> Column:  # by table, since the rows may have columns of any name
        return (rows["doc_id"] == named["doc"]) & (text_key(rows["text"]) == named["text_key"])

    kept = docs.join(gone, same(docs, gone), "left_anti")
    stay = "first IS NULL OR (doc = first.doc AND text_key = first.text_key)"
    rows = found.where("doc IS NOT NULL").where(stay).groupBy("doc", "text_key").agg(F.count(F.lit(1)).alias("k"))
    repeated = materialize(rows.where("k > 1").select("doc", "text_key"), "repeated")
    if repeated.isEmpty():
        return kept
    again = kept.join(repeated, same(kept, repeated), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(repeated, same(kept, repeated), "left_anti").unionByName(again.select(*kept.columns))
