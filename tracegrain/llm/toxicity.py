"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its distinct lower-case words and the first four and five
letters of longer words (inflected insults share a stem), hashed into ``2**bits``
buckets. A factorization machine scores the present terms::

    w0 + sum w_i + 1/2 sum_f [(sum v_if)^2 - sum v_if^2]

so that a pair such as an insult with a group mention has a weight of its own,
which additive weights lack. It reads terms only: no label, language, source or
id enters a score.

Learning: labelled rows come from a bounded sample (``sample_rows`` expected,
chosen by a hash of the id; all of them if there are fewer). Term counts over
the sample are aggregated in Spark; the ``terms`` buckets with the largest
likelihood-ratio statistic are kept, so common words of a long text add no noise.
The machine is then fitted by mini-batch gradient steps (Adam) with fixed seeds
on the sample's kept terms, a few dozen integers for each row. An id teaches by
one of its texts however often it is repeated, so what reaches the driver is
bounded by ``sample_rows`` times ``terms``, whatever the corpus holds.

Scoring reads every whole text in Arrow batches.

Defined results: null and empty texts have no terms and get the bias' score;
repeated rows give repeated results; repeated labels of one id are toxic if any
of them is; null labels and labels without a document teach nothing; without
labels of both kinds every score is the sample's rate of toxic rows (0 if it is
empty); an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .worker_memory import release
from .workspace import materialize

_WORD = re.compile(r"\w+")
#: Words whose terms a worker remembers at most.
_CACHE = 150_000


def hashed(term: str, bits: int) -> int:
    """Bucket of a term."""
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)


def word_terms(word: str) -> tuple[str, ...]:
    """A word's terms: itself, and its stems if it is long enough."""
    if len(word) < 6:
        return (word,)
    return (word, "4" + word[:4], "5" + word[:5])


@dataclass
class TermReader:
    """Texts to sorted arrays of buckets, or of kept columns if ``kept`` is given."""

    bits: int
    kept: dict[int, int] | None = None
    seen: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __call__(self, text: str | None) -> np.ndarray:
        seen, found = self.seen, set()
        for word in set(_WORD.findall((text or "").lower())):
            terms = seen.get(word)
            if terms is None:
                terms = tuple(hashed(t, self.bits) for t in word_terms(word))
                if self.kept is not None:
                    terms = tuple(self.kept[t] for t in terms if t in self.kept)
                if len(seen) >= _CACHE:
                    seen.clear()
                seen[word] = terms
            if terms:
                found.update(terms)
        return np.array(sorted(found), dtype=np.int32)


@dataclass
class FactorizationMachine:
    """Weights over ``n`` binary columns; rows are arrays of column numbers."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, columns: np.ndarray) -> float:
        v = self.factors[columns]
        total = v.sum(axis=0)
        return float(self.bias + self.weights[columns].sum() + 0.5 * ((total * total).sum() - (v * v).sum()))

    def score(self, columns: np.ndarray) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.margin(columns), -35.0, 35.0))))


def fit_machine(
    rows: list[np.ndarray], labels: np.ndarray, n: int, rank: int = 6, epochs: int = 12, batch: int = 256, seed: int = 7
) -> FactorizationMachine:
    """Fit by Adam on the logistic loss, with a small L2 penalty."""
    rng = np.random.default_rng(seed)
    rate = float(labels.mean()) if len(labels) else 0.0
    bias = float(np.log((rate + 1e-6) / (1 - rate + 1e-6)))
    w, v = np.zeros(n), rng.normal(0, 0.01, (n, rank))
    if not 0.0 < rate < 1.0:
        return FactorizationMachine(-35.0 if rate == 0 else bias, w, np.zeros((n, rank)))
    moments = [np.zeros(n), np.zeros(n), np.zeros((n, rank)), np.zeros((n, rank)), 0.0, 0.0]
    step, pace, l2 = 0, 0.03, 1e-5
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            lengths = np.array([len(rows[i]) for i in chosen])
            columns = np.concatenate([rows[i] for i in chosen]) if lengths.sum() else np.zeros(0, np.int32)
            owner = np.repeat(np.arange(len(chosen)), lengths)
            vs = v[columns]
            total = np.zeros((len(chosen), rank))
            np.add.at(total, owner, vs)
            squares = np.bincount(owner, (vs * vs).sum(axis=1), len(chosen))
            margin = bias + np.bincount(owner, w[columns], len(chosen)) + 0.5 * ((total * total).sum(axis=1) - squares)
            wrong = (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - labels[chosen]) / len(chosen)
            grad_w = np.bincount(columns, wrong[owner], n) + l2 * w
            grad_v = l2 * v
            np.add.at(grad_v, columns, wrong[owner, None] * (total[owner] - vs))
            step += 1
            fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
            for k, (value, grad) in enumerate(((w, grad_w), (v, grad_v))):
                m, s = moments[2 * k], moments[2 * k + 1]
                m += 0.1 * (grad - m)
                s += 0.001 * (grad * grad - s)
                value -= pace * (m / fix1) / (np.sqrt(s / fix2) + 1e-8)
            grad_b = wrong.sum()
            moments[4] += 0.1 * (grad_b - moments[4])
            moments[5] += 0.001 * (grad_b * grad_b - moments[5])
            bias -= pace * (moments[4] / fix1) / (np.sqrt(moments[5] / fix2) + 1e-8)
    return FactorizationMachine(bias, w, v)


@dataclass
class ToxicityModel:
    bits: int
    kept: dict[int, int]
    machine: FactorizationMachine

    def scores(self, texts: list[str | None], reader: TermReader) -> list[float]:
        return [self.machine.score(reader(t)) for t in texts]


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows from which labels are never learnt."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % 4 == 2, F.lit(False))


def train(
    docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, bits: int = 20, terms: int = 4096
) -> ToxicityModel:
    """Learn from the labels of rows that are not held out."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    n = known.count()
    scale = 1 << 30
    share = min(1.0, sample_rows / max(n, 1))
    chosen = known.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(scale)) < int(share * scale))
    # The sample has about sample_rows ids whatever the corpus holds, so it may be broadcast.
    sample = docs.select("doc_id", F.struct(F.xxhash64("text").alias("h"), "text").alias("t")).join(F.broadcast(chosen), "doc_id")
    sample = sample.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("t").alias("t")).select("toxic", "t.text")
    sample = materialize(sample, "toxicity-sample")

    def count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, counts = TermReader(bits), np.zeros((2, 1 << bits), dtype=np.int32)
        for batch in batches:
            for toxic, text in zip(batch["toxic"], batch["text"]):
                counts[int(toxic > 0), reader(text)] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pd.DataFrame({"term": at, "clean": counts[0, at].astype("int64"), "toxic": counts[1, at].astype("int64")})
        del reader, counts
        release()

    sizes = {bool(r["y"]): r["n"] for r in sample.groupBy((F.col("toxic") > 0).alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = max(sizes.get(False, 0), 1), max(sizes.get(True, 0), 1)
    counted = sample.mapInPandas(count_terms, "term long, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    a, b = F.col("a"), F.col("b")
    p, p0, p1 = (a + b + 1) / (n0 + n1 + 2), (a + 0.5) / (n0 + 1), (b + 0.5) / (n1 + 1)
    gain = (
        a * F.log(p0 / p) + b * F.log(p1 / p)
        + F.greatest(n0 - a, F.lit(0)) * F.log(F.greatest((1 - p0) / (1 - p), F.lit(1e-12)))
        + F.greatest(n1 - b, F.lit(0)) * F.log(F.greatest((1 - p1) / (1 - p), F.lit(1e-12)))
    )
    best = counted.where(a + b >= 3).select("term", gain.alias("gain")).where(F.col("gain") > 3.0)
    best = best.orderBy(F.desc("gain"), "term").limit(terms).collect()
    kept = {r["term"]: i for i, r in enumerate(best)}

    def read_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = TermReader(bits, kept)
        for batch in batches:
            yield pd.DataFrame({"y": (batch["toxic"] > 0).astype("int32"), "x": [reader(t).tolist() for t in batch["text"]]})

    rows = sample.mapInPandas(read_terms, "y int, x array<int>").collect()
    rows.sort(key=lambda r: (r["y"], r["x"]))  # the same model whatever order the rows arrive in
    x = [np.array(r["x"], dtype=np.int32) for r in rows]
    y = np.array([r["y"] for r in rows], dtype=float)
    del rows
    model = ToxicityModel(bits, kept, fit_machine(x, y, len(kept)))
    del x, y
    release()
    return model


def score_documents(docs: DataFrame, model: ToxicityModel, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``score`` of every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = held.value
        reader = TermReader(known.bits, known.kept)
        for batch in batches:
            yield batch[list(keys)].assign(score=known.scores(batch["text"].tolist(), reader))
        del reader
        release()

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", score double"
    return docs.select(*keys, "text").mapInPandas(score, schema)


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = held.value
        reader = TermReader(known.bits, known.kept)
        for batch in texts:
            yield pd.Series(known.scores(batch.tolist(), reader), dtype=float)
        del reader
        release()

    return docs.where(score("text") < threshold)
