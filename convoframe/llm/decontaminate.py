"""Benchmark decontamination as a prefix-filtered set join, on built-in functions only.

An item's windows are sets of positioned shingles of a few words. Shingles are ordered by rarity over the
documents; a window that is wholly contained in a text must hold its rarest shingle there, so a prefix of one
shingle is necessary and enough. Document positions are joined to prefixes on the shingle's hash; the
prefix's place in the window fixes where the window would start; the start must not lie before the text and
the window must end within it; then the window's words are compared with the document's.

Frequent passages cost one row per occurrence of a window that holds; no pairs of documents arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convoframe.llm.common import text_of
from convoframe.session import materialise

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Prefixes that may be broadcast (about 0.3 kB each); more are joined by a shuffle.
BROADCAST_PREFIXES = 50_000


def words(text: Column) -> Column:
    """Words of letters a-z, digits and characters beyond ASCII, A-Z read as a-z; none for null."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.length(text) == F.octet_length(text)
    lowered = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))
    return F.split(lowered, SEPARATOR)


def _trimmed(df: DataFrame, column: str) -> DataFrame:
    """Drops the empty first and last parts that a split leaves at separators."""
    part = F.col(column)
    first = (F.get(part, F.lit(0)) == "").cast("int")
    last = F.when(F.size(part) > 1, (F.element_at(part, -1) == "").cast("int")).otherwise(0)
    length = F.greatest(F.size(part) - first - last, F.lit(0))
    return df.withColumn(column, F.slice(part, first + 1, length))


def _token(column: str, at: Column, size: int) -> Column:
    """Hash of ``size`` words from a position on."""
    return F.xxhash64(*[F.get(F.col(column), at + i) for i in range(size)])


def windows(items: DataFrame, width: int = 10) -> DataFrame:
    """Distinct windows of ``width`` consecutive item words: window, words, items (their ids, as text).

    An item of fewer words, but not none, is one window. Null texts have no words; rows of one
    item id are read one by one.
    """
    split = _trimmed(items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")), "w")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    found = split.where(F.size("w") > 0).select("item", "w", F.explode(starts).alias("s"))
    found = found.select("item", F.slice("w", F.col("s") + 1, width).alias("words")).distinct()
    named = F.sha2(F.array_join("words", " ").cast("binary"), 256).alias("window")
    return found.select("item", "words", named)


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    width: int = 10,
    shingle: int = 3,
    broadcast_prefixes: int = BROADCAST_PREFIXES,
    row: str | None = None,
) -> DataFrame:
    """Words of each text that lie in an occurrence of an item's window.

    Input (doc_id, text) and (item_id, text); one row for each document row: doc_id, n_words, n_hit,
    n_items, items_sha256 (of the sorted item ids, joined by commas), contaminated. Null and empty texts
    have no words and no hit. Items with a null id count under the empty id. Repeated document rows are
    rows of their own. Without items nothing is hit; an empty table gives an empty table. Texts may have any length.
    Other columns are not looked at, whatever their names. ``row`` names a unique number of each row, which is
    then a column of the result too.
    """
    owned = materialise(windows(items.withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit(""))), width), "windows")
    distinct = owned.groupBy("window").agg(F.first("words").alias("words"))
    sizes = [r[0] for r in distinct.select(F.least(F.size("words"), F.lit(shingle)).alias("k")).distinct().collect()]

    source = _trimmed(
        docs.select(
            (F.col(row) if row else F.monotonically_increasing_id()).alias("row"),
            F.col("doc_id").cast("long").alias("doc_id"),
            words(F.col("text")).alias("w"),
        ),
        "w",
    )
    found = None
    for size in sorted(sizes):
        part = distinct.where(F.least(F.size("words"), F.lit(shingle)) == size)
        hits = _occurrences(source, part, size, width, broadcast_prefixes)
        found = hits if found is None else found.unionByName(hits)
    counts = source.select("row", "doc_id", F.size("w").cast("long").alias("n_words"))
    if found is None:
        spans = F.array().cast("array<struct<s:int,e:int>>")
        per_row = counts.select("*", spans.alias("spans"), F.array().cast("array<string>").alias("ids"))
    else:
        found = materialise(found, "hits")
        span = F.when(F.col("window").isNotNull(), F.struct("s", "e"))
        marks = found.groupBy("row", "doc_id").agg(
            F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(span)).alias("spans")
        )
        held = found.where("window is not null").select("row", "window").distinct()
        ids = held.join(owned.select("window", "item"), "window").groupBy("row").agg(
            F.array_sort(F.collect_set("item")).alias("ids")
        )
        per_row = marks.join(ids, "row", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    covered = F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long")
    return per_row.select(
        *([F.col("row").alias(row)] if row else []),
        "doc_id",
        "n_words",
        covered.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        (covered > 0).alias("contaminated"),
    )


def _covered(spans: Column) -> Column:
    """Positions in a sorted list of ranges [s, e)."""

    def step(held: Column, span: Column) -> Column:
        return F.struct(
            F.greatest(held["end"], span["e"]).alias("end"),
            (held["n"] + F.greatest(span["e"] - F.greatest(span["s"], held["end"]), F.lit(0))).alias("n"),
        )

    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(spans, start, step, lambda held: held["n"])


def _occurrences(
    source: DataFrame, distinct: DataFrame, size: int, width: int, broadcast_prefixes: int
) -> DataFrame:
    """Starts of windows in documents, and one row without window for each document.

    Columns: row, doc_id, n_words, window, s, e.
    """
    tokens = distinct.select(
        "window",
        "words",
        F.posexplode(F.sequence(F.lit(0), F.size("words") - size)).alias("at", "i"),
    ).select("window", "words", "at", _token("words", F.col("at"), size).alias("token"))
    tokens = materialise(tokens, "tokens")
    small = tokens.count() <= broadcast_prefixes * 8
    near = F.broadcast if small else (lambda df: df)

    # How often each shingle of a window is met in the documents; others need no count.
    at = F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("p")
    met = source.where(F.size("w") >= size).select("w", at).select(_token("w", F.col("p"), size).alias("token"))
    asked = tokens.select("token").distinct()
    rarity = met.join(near(asked), "token").groupBy("token").agg(F.count("*").alias("n"))
    rarity = materialise(rarity, "rarity")

    # The rarest shingle of each window; a window with a shingle that is never met can't occur.
    ranked = tokens.join(rarity, "token", "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "at")).alias("p"),
        F.first("words").alias("words"),
    )
    prefixes = ranked.where("p.n > 0").select(
        F.col("p.token").alias("token"), F.col("p.at").alias("at"), "window", "words"
    )
    prefixes = materialise(prefixes, "prefixes")
    small = prefixes.count() <= broadcast_prefixes

    # Every document keeps the row of its first position, also where nothing is met.
    position = F.explode_outer(
        F.when(F.size("w") > 0, F.sequence(F.lit(0), F.size("w") - 1))
    ).alias("p")
    placed = source.select("row", "doc_id", "w", F.size("w").alias("n_words"), position)
    token = F.when(F.col("p") + size <= F.col("n_words"), _token("w", F.col("p"), size))
    if small:
        context, shift = F.col("w"), F.lit(0)
    else:
        # The words around a position travel with it, not the whole text.
        reach = F.greatest(F.col("p") - width, F.lit(0))
        context, shift = F.slice("w", reach + 1, 2 * width), reach
    placed = placed.select("row", "doc_id", "n_words", "p", token.alias("token"), context.alias("c"), shift.alias("shift"))
    joined = placed.join(near(prefixes) if small else prefixes, "token", "left")
    start = F.col("p") - F.col("at")
    end = start + F.size("words")
    same = F.slice("c", start - F.col("shift") + 1, F.size("words")) == F.col("words")
    holds = F.when((start >= 0) & (end <= F.col("n_words")), same).otherwise(False)
    return joined.where(holds | (F.col("p") == 0) | F.col("p").isNull()).select(
        "row",
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.when(holds, F.col("window")).alias("window"),
        start.alias("s"),
        end.alias("e"),
    )
