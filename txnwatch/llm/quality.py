"""Quality rules: hashed n-gram log-likelihood ratio, in built-in functions only.

Every document becomes a bag of word unigrams and bigrams, hashed into a fixed number of buckets.
Two multinomials over the buckets are estimated: the raw corpus (all documents) and the trusted
target (documents labelled good). A document's score is the mean of log(target / raw) over its
n-grams; it is kept when the mean is at least a threshold.

Plan: one pass counts buckets (explode, partial aggregation, at most ``BUCKETS`` rows after the
shuffle), a second pass scores each row in place. The ratio table reaches the second pass as a
constant array of exactly ``BUCKETS`` numbers, so that pass has no shuffle and no join, and a hot
source or repeated texts cannot skew it. Ratios are whole micro-units and their sum is an integer:
a verdict does not depend on the order of additions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.shared import stored

BUCKETS = 1 << 14
# Pseudo-count of the raw distribution in the target estimate: buckets that the trusted sample has
# hardly seen get a ratio near 1.
PRIOR = 4.0 * BUCKETS
# Mean log ratio, in micro-units, from which a document is kept.
KEEP_FROM = -50_000
# The trusted target is estimated from at most so many labelled documents (those with the smallest
# hash of the id), so that their ids can be broadcast: 8 bytes each. All counts of the raw corpus,
# and all verdicts, cover every document.
TRUSTED_MAX = 20_000
MIN_WORDS = 50
MAX_REPEAT_PCT = 50


def _bind(expression: str, name: str, body: str) -> str:
    """SQL that evaluates ``expression`` once and uses it as ``name`` in ``body``."""
    return f"get(transform(array({expression}), {name} -> {body}), 0)"


_TEXT = "coalesce(text, '')"
# All six separators become a space by plain byte search; splitting at one character needs no regex.
_SPACED = _TEXT
for _separator in (r"\n", r"\t", r"\r", r"\u000B", r"\u000C"):
    _SPACED = f"replace({_SPACED}, '{_separator}', ' ')"


def _hashed(docs: DataFrame) -> DataFrame:
    """``docs`` with columns of our own: the parts between separators, word hashes, bigram hashes.

    Each is a column of its own projection: used several times further on, it is not inlined.
    """
    return (
        docs.selectExpr("*", f"split({_SPACED}, ' ') as __parts")
        .selectExpr("*", "transform(array_remove(__parts, ''), w -> xxhash64(w)) as __h")
        .selectExpr("*", "transform(slice(__h, 2, size(__h)), (x, i) -> shiftright(get(__h, i), 1) ^ x) as __b")
    )


def _with_windows(hashed: DataFrame) -> DataFrame:
    return hashed.selectExpr(
        "*", "transform(slice(__b, 2, size(__b)), (x, i) -> xxhash64(get(__b, i), x)) as __t"
    ).selectExpr("*", _SORTED)


# Word positions inside a three-word window that occurs twice or more. Texts whose windows are all
# different, nearly all, are told by a distinct count. Otherwise the windows are sorted, each as one
# integer of the upper hash bits and the position, so that the sort runs on plain numbers; windows
# with equal full hashes then stand next to each other. What each start covers beyond the previous
# one is added up. Texts of a million words and more take the same way with structs.
_POSITION_BITS = 20
_LOW = (1 << _POSITION_BITS) - 1
_SORTED = f"""case when size(array_distinct(__t)) = size(__t) or size(__t) > {_LOW} then null
    else sort_array(transform(__t, (x, i) -> (x & {-1 - _LOW}L) | i)) end as __s"""
_SAME = "get(__t, cast(x & {low}L as int)) = get(__t, cast(get(__s, i {step} 1) & {low}L as int))"
_SHORT_STARTS = (
    f"transform(filter(__s, (x, i) -> {_SAME.format(low=_LOW, step='-')} or {_SAME.format(low=_LOW, step='+')}), "
    f"x -> cast(x & {_LOW}L as int))"
)
_LONG_STARTS = _bind(
    "sort_array(transform(__t, (x, i) -> struct(x as key, i as at)))",
    "s",
    "transform(filter(s, (x, i) -> x.key = get(s, i - 1).key or x.key = get(s, i + 1).key), x -> x.at)",
)
_STARTS = f"case when __s is not null then {_SHORT_STARTS} when size(__t) > {_LOW} then {_LONG_STARTS} end"
REPEAT_WORDS = _bind(
    f"sort_array({_STARTS})",
    "p",
    "coalesce(aggregate(transform(p, (x, i) -> least(3, coalesce(get(p, i + 1) - x, 3))), 0L, (a, x) -> a + x), 0L)",
)
DUP_LINES = _bind(
    rf"filter(split({_TEXT}, '\n'), l -> l rlike r'[^\x20\x09-\x0D]')",
    "l",
    "cast(size(l) - size(array_distinct(l)) as bigint)",
)
BASE = {
    "n_words": "cast(size(__h) as bigint)",
    "word_chars": f"cast(length({_TEXT}) - size(__parts) + 1 as bigint)",
    "n_symbols": f"cast(regexp_count({_TEXT}, r'[#*$%&|<>]') as bigint)",
    "n_dup_lines": DUP_LINES,
    "n_repeat_words": REPEAT_WORDS,
}
_MASK = f"{BUCKETS - 1}L"
GRAMS = f"transform(concat(__h, __b), x -> cast(x & {_MASK} as int))"


def trusted_ids(labels: DataFrame, most: int = TRUSTED_MAX) -> DataFrame:
    """Ids of documents labelled good and not toxic: at most ``most`` of them, by hash of the id."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def ratio_table(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, llr): log(target / raw) in micro-units for every bucket, 0 where neither saw it.

    The counts cover all of ``docs``. ``trusted`` must hold at most ``TRUSTED_MAX`` ids.
    """
    spark = docs.sparkSession
    marked = docs.select("doc_id", "text").join(
        F.broadcast(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left"
    )
    counts = (
        _hashed(marked)
        .selectExpr("coalesce(good, 0) as good", f"explode({GRAMS}) as bucket")
        .groupBy("bucket")
        .agg(F.count("*").alias("raw"), F.sum("good").alias("target"))
    )
    counts = spark.range(BUCKETS).selectExpr("cast(id as int) as bucket").join(counts, "bucket", "left").na.fill(0)
    counts = stored(counts, "gram-counts")
    totals = counts.agg(F.sum("raw").alias("all_raw"), F.sum("target").alias("all_target")).first()
    raw = f"((raw + 1.0D) / {totals['all_raw'] + BUCKETS}.0D)"
    target = f"((target + {PRIOR}D * {raw}) / ({totals['all_target']}.0D + {PRIOR}D))"
    return counts.selectExpr("bucket", f"cast(round(1000000 * ln({target} / {raw})) as bigint) as llr")


def with_verdicts(docs: DataFrame, ratios: DataFrame, keep_from: int = KEEP_FROM) -> DataFrame:
    """``docs`` with the base counts, ``score`` (mean ratio in micro-units), ``base_failed``, ``kept``.

    A null text counts as empty. A document without words has score 0 and fails the base rules.
    Every row is judged by itself: repeated ids or texts get the same verdict each. Columns of the
    input that have one of the new names are replaced.
    """
    names = [*BASE, "score", "base_failed", "kept"]
    docs = docs.drop(*names)
    numbers = ",".join(str(r["llr"]) for r in ratios.orderBy("bucket").collect())  # BUCKETS rows
    ratio = f"get(cast(split('{numbers}', ',') as array<bigint>), cast(x & {_MASK} as int))"
    total = f"aggregate(__h, 0L, (a, x) -> a + {ratio}) + aggregate(__b, 0L, (a, x) -> a + {ratio})"
    kept_columns = [f"`{c}`" for c in docs.columns]
    scored = _with_windows(_hashed(docs)).selectExpr(
        *kept_columns, *(f"{sql} as {name}" for name, sql in BASE.items()), f"{total} as __total_llr"
    )
    grams = "greatest(2 * n_words - 1, 1)"
    failed = f"(n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PCT} * n_words)"
    # The verdict comes out of a generator: a filter on it is evaluated once above the projections,
    # where otherwise the optimizer would push copies of all their expressions into the filter.
    return scored.selectExpr(
        "*",
        f"cast(floor(__total_llr / {grams}) as bigint) as score",
        f"{failed} as base_failed",
        f"explode(array(not {failed} and __total_llr >= {keep_from} * {grams})) as kept",
    ).drop("__total_llr")


def quality(docs: DataFrame, labels: DataFrame, keep_from: int = KEEP_FROM) -> DataFrame:
    """Verdicts on all ``docs``, with the trusted target taken from ``labels`` (doc_id, quality, toxic).

    Without any trusted document every ratio is 0 and only the base rules decide.
    """
    return with_verdicts(docs, ratio_table(docs, trusted_ids(labels)), keep_from)


def good_rows(docs: DataFrame, labels: DataFrame, keep_from: int = KEEP_FROM) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns as they are, whatever their names."""
    rows = docs.select(F.struct("*").alias("row"), "text")
    return with_verdicts(rows, ratio_table(docs, trusted_ids(labels)), keep_from).where("kept").select("row.*")
