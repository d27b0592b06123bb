"""Secret scan by regular expressions and sliding-window entropy, natively.

Base kinds (leftmost, non-overlapping, failing matches dropped after matching):

* ``assign``: a keyword, ``:`` or ``=``, and a value of 12 characters or more;
* ``access``: ``AKIA`` and capitals or digits, 18 characters or more in all;
* ``hex``: lower-case hexadecimal runs of 16 characters or more.

``entropy`` spans are added: maximal runs of token characters, at least
``WINDOW`` long, with a digit or with capitals after small letters, whose Shannon
entropy over some window of ``WINDOW`` characters reaches the threshold of the
run's character class (digits-only runs have none). The allow-list holds words,
joined by separators or as capitalised parts, but no letters in mixed order. Counts are kept incrementally: a step of the fold
adds the entering character and takes out the leaving one, which changes two
terms of the sum. Allow-listed runs and runs that base spans cover entirely are
left out; a run that reaches beyond them is scored whole and added. Covered runs
and masks are found by prefix maxima of the spans' ends, in linear time.

Positions are code points; they follow from splitting the text at the matches
and summing lengths, so a text is scanned in linear time, whole, on the JVM.

Defined results: a null or empty text has no spans; repeated rows give repeated
results; an empty table gives an empty table; extra columns are carried along;
columns that clash with the result's are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays
from .arrays import largest, with_prefix

#: The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}+"  # AKIA[A-Z0-9]+ of 18 characters: the run is greedy, so both match the same
HEX = "[0-9a-f]{16,}+"

WINDOW = 20
TOKEN = "[A-Za-z0-9+/_-]"
CANDIDATE = f"(?<!{TOKEN})(?=[A-Za-z+/_-]*(?:[0-9]|[a-z][+/_-]*[A-Z])){TOKEN}{{{WINDOW},}}+"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Class of a run, as a pattern of the whole run, and the bits that a window of it must reach.
CLASSES = (
    ("digits", r"^[0-9+/_-]+$", None),
    ("hex", r"^[0-9a-fA-F]+$", 3.01),
    ("upper", r"^[A-Z0-9]+$", 3.41),
    ("mixed", r"^(?=.*[a-z])(?=.*[A-Z]).*$", 3.61),
    ("lower", r"^.*$", 3.71),
)
_PART = "(?:[A-Z]?[a-z]{1,15}|[A-Z]{1,4})"
_WORDS = f"{_PART}(?:[_-]{_PART})*"
#: Runs that look random but are no secrets: identifiers in the 8-4-4-4-12 form, paths and lists of words, capitalised parts, date stamps, documentation keys.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    f"^/?{_WORDS}[0-9]{{0,4}}(?:/(?:{_WORDS})?[0-9]{{0,8}})+$",
    f"^{_PART}(?:[_-](?:{_PART}|[0-9]{{1,4}}))+[0-9]{{0,4}}$",
    r"^[A-Z]?[a-z]{2,15}(?:[A-Z][a-z]{2,15})*[0-9]{0,4}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[A-Za-z0-9_-]*$",
    r"^[A-Z0-9]*EXAMPLE(?:KEY)?$",
)
KINDS = ("assign", "access", "hex", "entropy")


def window_entropy(run: Column, window: int = WINDOW) -> Column:
    """Greatest Shannon entropy (bits) over all windows of a run, by incremental counts.

    The state is (count of each character, sum of n log2 n, greatest entropy);
    a window's entropy is ``log2(w) - sum / w``.
    """
    codes = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    term = lambda n: F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))
    zero = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(0.0).alias("best"),
    )

    def step(acc: Column, x: Column) -> Column:
        enters, leaves = x["enters"], x["leaves"]
        n_in = F.get(acc["counts"], enters)
        n_out = F.when(leaves.isNull(), F.lit(0)).otherwise(F.get(acc["counts"], leaves))
        change = F.when(
            leaves.isNull() | (leaves != enters),
            term(n_in + 1) - term(n_in) + F.when(leaves.isNull(), F.lit(0.0)).otherwise(term(n_out - 1) - term(n_out)),
        ).otherwise(F.lit(0.0))
        now = acc["sum"] + change
        return F.struct(
            F.transform(
                acc["counts"],
                lambda n, i: n
                + F.when(i == enters, 1).otherwise(0)
                - F.when(F.coalesce(i == leaves, F.lit(False)), 1).otherwise(0),
            ).alias("counts"),
            now.alias("sum"),
            F.when(x["full"], F.greatest(acc["best"], F.log2(F.lit(float(window))) - now / window))
            .otherwise(acc["best"])
            .alias("best"),
        )

    steps = F.transform(
        F.arrays_zip(codes.alias("c"), F.concat(F.array_repeat(F.lit(None).cast("int"), window), codes).alias("o")),
        lambda x, i: F.struct(x["c"].alias("enters"), x["o"].alias("leaves"), (i >= window - 1).alias("full")),
    )
    # The leaving characters are the entering ones, `window` places later; what they exceed is dropped.
    steps = F.filter(steps, lambda s: s["enters"].isNotNull())
    return F.aggregate(steps, zero, step, lambda acc: acc["best"])


def is_random(run: Column) -> Column:
    """Whether a run's entropy reaches its class's threshold and no allow-list pattern holds."""
    threshold = F.lit(None).cast("double")
    for _, pattern, bits in reversed(CLASSES):
        threshold = F.when(run.rlike(pattern), F.lit(bits).cast("double")).otherwise(threshold)
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | run.rlike(pattern)
    return F.coalesce(~allowed & threshold.isNotNull() & (window_entropy(run) >= threshold), F.lit(False))


def _with_matches(df: DataFrame, name: str, pattern: str, group: int | None, least: int) -> DataFrame:
    """Add the array ``name`` of struct(start, end, run) of a pattern's matches in ``_text``."""
    text = F.col("_text")
    hit = text.rlike(pattern)
    none = F.array().cast("array<string>")
    # `_whole` is read by lambdas below; it and the sums are kept as columns, so each is computed once.
    df = df.select(
        "*",
        F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias("_whole"),
        F.when(hit, F.split(text, pattern, -1)).otherwise(none).alias("_between"),
        (F.when(hit, F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).otherwise(none) if group else F.lit(None)).alias("_part"),
    )
    df = df.select(
        "*",
        F.transform(F.col("_whole"), lambda m, i: (F.length(F.get(F.col("_between"), i)) + F.length(m)).cast("long")).alias("_lengths"),
    )
    df = with_prefix(df, "_at", "_lengths")
    spans = F.transform(
        F.col("_whole"),
        lambda m, i: F.struct(
            (F.get(F.col("_at"), i) + F.length(F.get(F.col("_between"), i))).alias("start"),
            (F.get(F.col("_at"), i) + F.get(F.col("_lengths"), i)).alias("end"),
            F.length(F.get(F.col("_part"), i) if group else m).alias("size"),
            m.alias("run"),
        ),
    )
    kept = F.transform(
        F.filter(spans, lambda s: s["size"] >= least),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["run"].alias("run")),
    )
    return df.select("*", kept.alias(name)).drop("_whole", "_between", "_part", "_lengths", "_at")


def _with_uncovered(df: DataFrame, name: str) -> DataFrame:
    """Add the array ``name``: the ``_runs`` that the spans of ``_base``, sorted by start, do not cover entirely.

    Spans that overlap or touch are merged; a run is covered if it lies in one
    of the merged ones, which can only be the last that starts no later.
    """
    df = df.select("*", F.transform("_base", lambda b: b["end"]).alias("_ends"))
    df = with_prefix(df, "_reach", "_ends", largest)
    heads = F.filter(
        F.transform(
            F.col("_base"), lambda b, i: F.struct(b["start"].alias("start"), arrays.element(F.col("_reach"), i).alias("reach"), i.alias("i"))
        ),
        lambda h: (h["i"] == 0) | (h["start"] > h["reach"]),
    )
    end = F.struct(F.lit(None).cast("long").alias("start"), largest(F.col("_ends")).alias("reach"), F.lit(None).cast("int").alias("i"))
    df = df.select("*", F.concat(heads, F.array(end)).alias("_heads"))
    merged = F.transform(
        F.slice(F.col("_heads"), F.lit(1), F.size("_heads") - 1),
        lambda h, k: F.struct(
            h["start"].alias("start"),
            F.lit(0).alias("order"),
            F.get(F.col("_heads"), k + 1)["reach"].alias("end"),
            F.lit(None).cast("string").alias("run"),
        ),
    )
    runs = F.transform(
        F.col("_runs"), lambda r: F.struct(r["start"].alias("start"), F.lit(1).alias("order"), r["end"].alias("end"), r["run"].alias("run"))
    )
    df = df.select("*", F.sort_array(F.concat(merged, runs)).alias("_sorted"))
    df = df.select("*", F.transform("_sorted", lambda e: F.when(e["order"] == 0, e["end"]).otherwise(F.lit(0))).alias("_covers"))
    df = with_prefix(df, "_cover", "_covers", largest)
    rest = F.filter(F.col("_sorted"), lambda e, i: (e["order"] == 1) & (e["end"] > arrays.element(F.col("_cover"), i)))
    return df.select("*", rest.alias(name)).drop("_ends", "_reach", "_heads", "_sorted", "_covers", "_cover")


def scan_secrets(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``secrets``: array of struct(start, rank, kind, end), by start, then kind as listed."""
    if "secrets" in df.columns:
        raise ValueError("a column named secrets clashes with the result's")
    # The input's columns travel as one, so their names cannot clash with those made here.
    out = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"))
    out = _with_matches(out, "_assign", ASSIGN, 2, 12)
    out = _with_matches(out, "_access", ACCESS, None, 18)
    out = _with_matches(out, "_hex", HEX, None, 16)
    out = _with_matches(out, "_runs", CANDIDATE, None, WINDOW)
    base = F.sort_array(F.concat("_assign", "_access", "_hex"))
    out = out.select("*", base.alias("_base"))
    out = _with_uncovered(out, "_rest")
    out = out.select("*", F.filter(F.col("_rest"), lambda r: is_random(r["run"])).alias("_entropy"))
    tag = lambda name, rank: F.transform(
        F.col(f"_{name}"),
        lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(name).alias("kind"), s["end"].alias("end")),
    )
    spans = F.sort_array(F.concat(*[tag(name, rank) for rank, name in enumerate(KINDS)]))
    return out.select("_row.*", spans.alias("secrets"))


def span_string(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def count_kind(kind: str) -> Column:
    """How many of a row's ``secrets`` are of a kind."""
    return F.size(F.filter(F.col("secrets"), lambda s: s["kind"] == kind)).cast("long")


def redact(df: DataFrame, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """Replace what ``secrets`` spans cover in ``text``; overlapping spans become one mask."""
    out = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"), F.col("secrets").alias("_spans")
    )
    out = out.select(
        "*",
        F.transform("_spans", lambda s: s["end"]).alias("_ends"),
        F.when(F.size("_spans") > 0, arrays.pieces(F.col("_text"))).otherwise(F.array().cast("array<string>")).alias("_pieces"),
    )
    out = with_prefix(out, "_reach", "_ends", largest)
    # A span is the first of its overlapping group if no earlier one reaches it; the texts between groups stay.
    parts = F.transform(
        F.col("_spans"),
        lambda s, i: F.when(
            s["start"] >= arrays.element(F.col("_reach"), i),
            F.concat(arrays.between(F.col("_pieces"), arrays.element(F.col("_reach"), i), s["start"]), F.lit(mask)),
        ).otherwise(F.lit("")),
    )
    rest = arrays.between(F.col("_pieces"), largest(F.col("_ends")), F.length("_text").cast("long"))
    masked = F.when(F.size("_spans") > 0, F.concat(F.array_join(parts, ""), rest)).otherwise(F.col("_text"))
    return out.select(*[masked.alias(c) if c == text else F.col("_row")[c].alias(c) for c in df.columns])
