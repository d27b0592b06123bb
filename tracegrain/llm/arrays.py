"""Array expressions shared by the native operators (no Python on executors)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CHUNK = 256


def _place(chunks: Column, i: Column) -> Column:
    """Which chunk holds the element ``i``.

    Reads ``chunks`` too: a column that a later projection reads twice is not merged into it by the
    optimizer, which would compute the whole array again for each element.
    """
    return F.least(F.floor(i / F.lit(_CHUNK)).cast("int"), F.size(chunks) - 1)


def total(values: Column) -> Column:
    """Sum of an array of numbers as BIGINT; 0 for an empty array."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def largest(values: Column) -> Column:
    """Greatest of an array of numbers that are not negative; 0 for an empty array."""
    return F.coalesce(F.array_max(values), F.lit(0).cast("long"))


def chunk_sums(values: Column, fold=total) -> Column:
    """Sums (or what ``fold`` makes) of consecutive chunks of an array, for :func:`offsets`."""
    chunks = F.sequence(F.lit(0), F.floor(F.size(values) / F.lit(_CHUNK)).cast("int"))
    return F.transform(chunks, lambda c: fold(F.slice(values, c * _CHUNK + 1, F.lit(_CHUNK))))


def chunk_starts(sums: Column, fold=total) -> Column:
    """Exclusive prefix sums of the chunk sums."""
    return F.transform(sums, lambda _, i: fold(F.slice(sums, F.lit(1), i)))


def offsets(values: Column, starts: Column, fold=total) -> Column:
    """Exclusive prefix sums of ``values``; linear instead of quadratic in its size."""

    def before(i: Column) -> Column:
        chunk = _place(starts, i)
        rest = fold(F.slice(values, chunk * _CHUNK + 1, i % _CHUNK))
        return F.get(starts, chunk) + rest if fold is total else F.greatest(F.get(starts, chunk), rest)

    return F.transform(values, lambda _, i: before(i))


def with_prefix(df: DataFrame, name: str, values: str, fold=total) -> DataFrame:
    """Add the array ``name``: what ``fold`` makes of the elements of ``values`` before each one."""
    # Each array that a lambda reads is a column of its own, so that it is computed once and not per element.
    df = df.select("*", chunk_sums(F.col(values), fold).alias("_sums"))
    df = df.select("*", chunk_starts(F.col("_sums"), fold).alias("_chunks"))
    return df.select("*", offsets(F.col(values), F.col("_chunks"), fold).alias(name)).drop("_sums", "_chunks")


def element(values: Column, i: Column) -> Column:
    """The element ``i`` of an array that is a column of its own (see :func:`_place`)."""
    return F.get(values, F.least(i, F.size(values) - 1))


def pieces(text: Column) -> Column:
    """A text cut into pieces of equal length, so that :func:`between` needs not read it from its start."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))


def between(parts: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive) of a text, given its :func:`pieces`."""
    first, last = F.floor(start / F.lit(_CHUNK)).cast("int"), _place(parts, end)
    around = F.array_join(F.slice(parts, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.substr(around, (start % _CHUNK + 1).cast("int"), (end - start).cast("int"))
