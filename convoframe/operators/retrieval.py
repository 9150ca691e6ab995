"""Batch retrieval: the best documents for every question, and prompts that carry them.

Scores are BM25. Frequent terms make a plain join of questions and postings grow as questions x
documents, so most of it is never formed, without losing a hit:

1. the best documents of each question's rarest terms are scored in full; the k-th of these scores
   is a lower bound for the k-th best score of all;
2. terms whose largest possible contributions together stay well below that bound cannot put a
   document among the best on their own. Only the other terms fetch candidates;
3. candidates that could not reach the bound even with all remaining terms are dropped, the rest
   get the remaining terms by a lookup on (document, term).

Questions of frequent words only, which most documents answer somehow, are narrowed further by blocks of
documents with their terms' largest contributions (block-max): a block whose contributions together stay
below the bound is not looked into. Blocks are the cells of a k-d tree over what the commonest terms
contribute, so that documents of a block are alike in just these terms; the tree is made from a bounded
sample of texts, and decides only how much is skipped, never what is found.

That serves a few questions of a large index. A batch of many questions would look into most documents
anyway, and is scored in cells of a bounded number of postings (``_cell_scores``). Documents are dealt to as many
tasks as there are cores for, and every task gets the questions once, packed; it keeps them in a file while it goes
from cell to cell, and gives their best of all its documents. What is shuffled so grows with the questions and the
documents, not with their product. A cell's commonest terms are left out while the most that they add stays well
below the worst of a question's best so far, and looked up for the few documents that come near it. The work is
still questions x postings by nature, but as sums over arrays.

Documents with the same text are indexed and scored once, and so are questions with the same terms:
a group of copies, however large, is one row until the end, where only its first ``k`` documents can
be among the best.

Contributions are rounded to millionths and summed as whole numbers, so the order of summation, and
with it the partitioning, cannot change a score or a rank.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convoframe import session
from convoframe.functions import text as rules

K1 = 1.2
B = 0.75
_SCALE = 1_000_000
# Rarest terms of a question whose best documents give the bound. More terms tighten the bound;
# the result is the same for any number.
_SEED_TERMS = 4
# Texts that the tree of blocks is made from, the commonest terms among them that it divides by, and the
# fewest sampled texts in a block.
_SAMPLE = 20_000
_COMMON = 8
_LEAF = 16
# Blocks that are scored whole for the bound of a question, and postings for each entry of a block from which
# on a question goes by blocks.
_FIRST_BLOCKS = 3
_BLOCK_PAYS = 4
# Terms fetch no candidates while their largest contributions add up to less than this share of the
# bound. A larger share means fewer candidates to fetch, but more of them to look up.
_SPARE = 0.4
# Different questions up to which they are pruned one by one; more are scored in cells, of about so many postings.
_FEW_QUESTIONS = 100
_CELL = 3_000_000
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Best documents that a block of questions holds, texts that are added to a cell at once, documents of a block, and
# scores that are added up at once.
_HELD = 100_000
_TEXTS = 500
_BLOCK = 64
_SCORES = 300_000
# A term has a row for all documents of a cell if one in so many has it. Such rows are looked up, not added, while
# the most that they add stays below this share of a question's k-th best score so far.
_DENSE = 16
_CELL_SPARE = 0.5


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``session.materialise``, where the shuffled rows go once the table is written, not when the driver next collects
    its garbage: those of an index are as large as the texts."""
    conf = df.sparkSession.conf
    before = conf.get(_SHUFFLES_GO, None)
    conf.set(_SHUFFLES_GO, "true")
    try:
        return session.materialise(df, name)
    finally:
        conf.unset(_SHUFFLES_GO) if before is None else conf.set(_SHUFFLES_GO, before)


@dataclass
class SearchIndex:
    """Written tables: ``documents (doc_id, text_key)``; ``texts (text_key, doc_id, copies, n_tokens, terms, tfs)``,
    one row for each text with terms, where ``doc_id`` is the first document with that text and ``copies`` their
    number; and the one-row ``corpus (n_docs, avg_tokens, n_postings)``."""

    documents: DataFrame
    texts: DataFrame
    corpus: DataFrame

    @cached_property
    def postings(self) -> DataFrame:
        """``doc_id, n_tokens, copies, block, term, tf``, written when first asked for."""
        terms = self.texts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        common = [r["term"] for r in terms.orderBy(F.desc("n"), "term").limit(_COMMON).collect()]
        average = self.corpus.select("avg_tokens").scalar()

        def share(term: str) -> Column:
            tf = F.coalesce(F.get("tfs", (F.array_position("terms", F.lit(term)) - 1).cast("int")), F.lit(0))
            return tf / (tf + K1 * (1 - B + B * F.col("n_tokens") / average))

        shares = {f"n{i}": share(t) for i, t in enumerate(common)}
        blocks = _with_blocks(materialise(self.texts.withColumns(shares), "texts"), list(shares))
        postings = blocks.select(
            "doc_id", "n_tokens", "copies", "block", F.explode(F.arrays_zip("terms", "tfs")).alias("_posting")
        )
        return materialise(
            postings.select(
                "doc_id", "n_tokens", "copies", "block",
                F.col("_posting.terms").alias("term"), F.col("_posting.tfs").cast("bigint").alias("tf"),
            ),
            "postings",
        )


def _divide(points: np.ndarray, least: int) -> tuple[list[int], list[float]]:
    """A balanced k-d tree over rows of points, in heap order: the column and the value that divide each cell.

    A cell is divided in the column whose values differ most, at its median; all cells of a level are.
    """
    columns, values, cells = [], [], [np.arange(len(points))]
    while cells and len(points) // (2 * len(cells)) >= least:
        below = []
        for cell in cells:
            own = points[cell] if len(cell) else np.zeros((1, points.shape[1]))
            column = int(np.argmax(own.max(0) - own.min(0)))
            value = float(np.median(own[:, column]))
            columns.append(column)
            values.append(value)
            upper = points[cell, column] > value
            below += [cell[~upper], cell[upper]]
        cells = below
    return columns, values


def _with_blocks(texts: DataFrame, shares: list[str]) -> DataFrame:
    """``texts`` with their block, by a tree made from a sample of what the commonest terms contribute."""
    if not shares:
        return texts.withColumn("block", F.lit(0))
    sample = texts.orderBy(F.xxhash64("text_key")).limit(_SAMPLE).select(*shares).toArrow()
    points = np.column_stack([sample.column(c).to_numpy() for c in shares]).reshape(-1, len(shares))
    columns, values = _divide(points, _LEAF)
    held = F.array(*shares)
    column, value = (F.lit(x).cast(f"array<{kind}>") for x, kind in ((columns, "int"), (values, "double")))
    # One column for each level of the tree.
    texts = texts.withColumns({"block": F.lit(0), "_held": held})
    for _ in range((len(columns) + 1).bit_length() - 1):
        node = F.col("block")
        texts = texts.withColumn("block", 2 * node + 1 + (F.get("_held", F.get(column, node)) > F.get(value, node)).cast("int"))
    return texts.drop("_held")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's different terms and how often it has them, instead of its tokens."""
    for batch in batches:
        tokens = batch.column("tokens")
        sizes = pc.list_value_length(tokens).to_numpy(zero_copy_only=False)
        coded = pc.list_flatten(tokens).dictionary_encode()
        n_terms = max(len(coded.dictionary), 1)
        row = np.repeat(np.arange(len(sizes)), sizes)
        pairs, counts = np.unique(row * n_terms + coded.indices.to_numpy(), return_counts=True)
        offsets = pa.array(np.searchsorted(pairs, np.arange(len(sizes) + 1) * n_terms).astype(np.int32))
        terms = coded.dictionary.take(pa.array(pairs % n_terms))
        others = [batch.column(c) for c in ("text_key", "doc_id", "copies")]
        yield pa.RecordBatch.from_arrays(
            [
                *others,
                pa.array(sizes.astype(np.int64)),
                pa.ListArray.from_arrays(offsets, terms),
                pa.ListArray.from_arrays(offsets, pa.array(counts.astype(np.int32))),
            ],
            ["text_key", "doc_id", "copies", "n_tokens", "terms", "tfs"],
        )


def index_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SearchIndex:
    """Tokenise the texts and write the index to the shared folder.

    Copies are brought together first, so that each text is cut into terms once; its terms stay in its row.
    """
    key = F.unhex(F.sha2(text_col, 256)).alias("text_key")
    named = docs.select(F.col(id_col).alias("doc_id"), key, F.col(text_col).alias("_text"))
    documents = materialise(named.select("doc_id", "text_key"), "documents")
    firsts = (
        named.where("text_key is not null")
        .groupBy("text_key")
        .agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.first("_text").alias("_text"))
        .select("text_key", "doc_id", "copies", rules.tokens(F.col("_text")).alias("tokens"))
    )
    kinds = {f.name: f.dataType for f in firsts.schema.fields}
    fields = [(c, kinds[c]) for c in ("text_key", "doc_id", "copies")] + [
        ("n_tokens", T.LongType()), ("terms", T.ArrayType(T.StringType())), ("tfs", T.ArrayType(T.IntegerType()))
    ]
    counted = firsts.mapInArrow(_count_terms, T.StructType([T.StructField(*f) for f in fields]))
    texts = materialise(counted.where("n_tokens > 0"), "texts")
    n_docs = documents.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    total = F.sum(F.col("n_tokens") * F.col("copies"))
    corpus = texts.agg(
        n_docs.alias("n_docs"), (total / n_docs).alias("avg_tokens"), F.sum(F.size("terms")).alias("n_postings")
    )
    return SearchIndex(documents, texts, materialise(corpus, "corpus"))


def _vocabulary(asked: DataFrame, index: SearchIndex, max_df_share: float | None) -> DataFrame:
    """``term, term_id, n_texts, idf`` of the terms that occur in questions and in documents."""
    n_docs = index.corpus.select("n_docs").scalar()
    used = asked.select(F.explode("_terms").alias("term")).distinct()
    counted = (
        index.texts.select("copies", F.explode("terms").alias("term"))
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("n_texts"), F.sum("copies").alias("df"))
        .join(used, "term", "left_semi")
    )
    if max_df_share is not None:
        counted = counted.where(F.col("df") <= max_df_share * n_docs)
    return counted.select(
        "term",
        F.monotonically_increasing_id().alias("term_id"),
        "n_texts",
        F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"),
    )


def _points(average: Column) -> Column:
    """What a term adds to a document's score, in millionths."""
    tf, n_tokens = F.col("tf"), F.col("n_tokens")
    saturated = tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_tokens / average))
    return F.round(F.col("idf") * saturated * _SCALE).cast("bigint")


def _looked_up(pairs: DataFrame, terms: DataFrame, weights: DataFrame) -> DataFrame:
    """The points that given (question, document) pairs get from given terms of the question."""
    return (
        pairs.select("_q", "doc_id")
        .join(terms.select("_q", "term_id"), "_q")
        .join(weights, ["doc_id", "term_id"])
        .select("_q", "doc_id", "points")
    )


def _lower_bounds(q_terms: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """``_q, _bound``: a score that at least ``k`` documents reach."""
    rarest = Window.partitionBy("_q").orderBy("n_texts", "term_id")
    seeds = q_terms.withColumn("_rank", F.row_number().over(rarest)).where(
        F.col("_rank") <= _SEED_TERMS
    )
    best = Window.partitionBy("term_id").orderBy(F.col("points").desc(), "doc_id")
    top_docs = (
        weights.join(seeds.select("term_id").distinct(), "term_id", "left_semi")
        .withColumn("_rank", F.row_number().over(best))
        .where(F.col("_rank") <= k)
        .select("term_id", "doc_id")
    )
    pairs = seeds.join(top_docs, "term_id").select("_q", "doc_id").distinct()
    scored = _looked_up(pairs, q_terms, weights).groupBy("_q", "doc_id").agg(F.sum("points").alias("points"))
    return _kth_best(scored, k)


def _marked_terms(q_terms: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """The questions' terms with the bound and whether the term fetches candidates.

    A question's terms are ordered by the most that they can add; the first ones, while their sum
    stays below a share of the bound, fetch none.
    """
    growing = (
        Window.partitionBy("_q")
        .orderBy("most", "term_id")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    most = weights.groupBy("term_id").agg(F.max("points").alias("most"))
    return (
        q_terms.join(most, "term_id")
        .join(_lower_bounds(q_terms, weights, k), "_q", "left")
        .withColumn("_bound", F.coalesce("_bound", F.lit(0)))
        .withColumn("_upto", F.sum("most").over(growing))
        .withColumn("_fetches", F.col("_upto") >= F.col("_bound") * _SPARE)
    )


def _all_scores(q_terms: DataFrame, weights: DataFrame) -> DataFrame:
    return (
        q_terms.select("_q", "term_id")
        .join(weights, "term_id")
        .groupBy("_q", "doc_id")
        .agg(F.sum("points").alias("points"))
    )


def _kth_best(scored: DataFrame, k: int) -> DataFrame:
    """``_q, _bound``: the ``k``-th best of the scores of each question that has so many."""
    by_score = Window.partitionBy("_q").orderBy(F.col("points").desc())
    ranked = scored.withColumn("_rank", F.row_number().over(by_score)).where(F.col("_rank") <= k)
    bounds = ranked.groupBy("_q").agg(F.count(F.lit(1)).alias("_n"), F.min("points").alias("_bound"))
    return bounds.where(F.col("_n") == k).select("_q", "_bound")


def _block_scores(q_blocks: DataFrame, q_terms: DataFrame, weights: DataFrame) -> DataFrame:
    """Scores of all documents of given blocks, by given terms of the questions."""
    wanted = q_blocks.select("_q", "block").join(q_terms.select("_q", "term_id"), "_q")
    found = wanted.join(weights, ["term_id", "block"])
    return found.groupBy("_q", "doc_id").agg(F.sum("points").alias("points"))


def _kept_blocks(marked: DataFrame, limits: DataFrame, tops: DataFrame, weights: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The blocks that may hold one of a question's best documents, and the bound found on the way.

    ``(_q, block)`` and ``(_q, _bound)``. A block's documents get no more from the fetching terms than the
    largest contributions of these within the block.
    """
    reach = marked.where("_fetches").join(tops, "term_id").groupBy("_q", "block").agg(F.sum("top").alias("reach"))
    reach = materialise(reach, "block-bounds")
    first = Window.partitionBy("_q").orderBy(F.desc("reach"), "block")
    promising = reach.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= _FIRST_BLOCKS)
    found = _kth_best(_block_scores(promising, marked, weights), k).withColumnRenamed("_bound", "_found")
    bounds = limits.join(found, "_q", "left").select(
        "_q", "_spare", F.greatest("_bound", F.coalesce("_found", F.lit(0))).alias("_bound")
    )
    bounds = materialise(bounds, "block-limits")
    kept = reach.join(bounds, "_q").where(F.col("reach") + F.col("_spare") >= F.col("_bound")).select("_q", "block")
    return materialise(kept, "kept-blocks"), bounds


def _scores_that_matter(q_terms: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """The scores of all documents that can be among a question's ``k`` best, and of some more."""
    marked = materialise(_marked_terms(q_terms, weights, k), "bounds")
    fetching = F.col("_fetches")
    n_blocks = weights.agg(F.count_distinct("block").alias("n")).select("n").scalar()
    limits = marked.groupBy("_q").agg(
        F.first("_bound").alias("_bound"),
        F.coalesce(F.max(F.when(~fetching, F.col("_upto"))), F.lit(0)).alias("_spare"),
        F.coalesce(F.sum(F.when(fetching, F.col("n_texts"))), F.lit(0)).alias("_postings"),
        F.count_if(fetching).alias("_terms"),
    )
    broad = F.col("_postings") > _BLOCK_PAYS * F.col("_terms") * n_blocks
    limits = materialise(limits.withColumn("_broad", broad), "limits")
    narrow = limits.where("not _broad").select("_q", "_bound", "_spare")
    wide = limits.where("_broad").select("_q", "_bound", "_spare")
    columns = ["_q", "doc_id", "points"]
    partial = _all_scores(marked.where(fetching).join(narrow.select("_q"), "_q", "left_semi"), weights).join(narrow, "_q")
    partial = partial.select(*columns, "_bound", "_spare")
    if not wide.isEmpty():
        asked = marked.join(wide.select("_q"), "_q", "left_semi")
        tops = weights.join(asked.where(fetching).select("term_id").distinct(), "term_id", "left_semi")
        tops = tops.groupBy("term_id", "block").agg(F.max("points").alias("top"))
        kept, bounds = _kept_blocks(asked, wide, tops, weights, k)
        by_block = _block_scores(kept, asked.where(fetching), weights).join(bounds, "_q")
        partial = partial.unionByName(by_block.select(*columns, "_bound", "_spare"))
    candidates = materialise(
        partial.where(F.col("points") + F.col("_spare") >= F.col("_bound")).select(columns), "candidates"
    )
    return (
        candidates.unionByName(_looked_up(candidates, marked.where(~fetching), weights))
        .groupBy("_q", "doc_id")
        .agg(F.sum("points").alias("points"))
    )


class _Asked:
    """A task's questions, by blocks, in a file of the worker's own, with the best documents found so far for each."""

    def __init__(self, k: int):
        self.k = k
        self.file = tempfile.TemporaryFile()
        self.places: list[tuple[int, int, int, int]] = []

    def add(self, n: int, terms: bytes, asked: bytes) -> None:
        self.places.append((self.file.seek(0, 2), n, len(terms), len(asked)))
        for part in (np.full((2, n, self.k), -1).tobytes(), terms, asked):
            self.file.write(part)

    def blocks(self) -> Iterator[tuple[np.ndarray, pa.Table, pa.Table]]:
        """Points and places of each question's best documents, to be changed in place; terms; questions."""
        for start, n, *sizes in self.places:
            self.file.seek(start)
            best = np.frombuffer(bytearray(self.file.read(16 * n * self.k)), dtype=np.int64).reshape(2, n, self.k)
            terms, asked = (pa.ipc.open_stream(self.file.read(size)).read_all() for size in sizes)
            yield best, terms, asked
            self.file.seek(start)
            self.file.write(best.tobytes())


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of several ranges, one range after another."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class _Cell:
    """The texts of a cell, by term, and their scores for questions.

    ``first`` is the place of its first document among those of the task, which come by their id.
    """

    def __init__(self, texts: pa.Table, average: float, k: int, scale: int, first: int):
        self.k, self.scale, self.first = k, scale, first
        # Texts that share an id are one document.
        names = texts.column("doc_id").to_pylist()
        new = np.array([i == 0 or names[i - 1] != name for i, name in enumerate(names)])
        self.ids = texts.column("doc_id").combine_chunks().take(pa.array(np.flatnonzero(new)))
        lists = pc.split_pattern(texts.column("terms").combine_chunks(), " ")
        sizes = pc.list_value_length(lists).to_numpy()
        coded = pc.list_flatten(lists).dictionary_encode()
        del lists
        self.terms = coded.dictionary
        codes = coded.indices.to_numpy()
        tf = pc.list_flatten(texts.column("tfs")).to_numpy()
        n_tokens = np.repeat(texts.column("n_tokens").to_numpy(), sizes)
        order = np.argsort(codes, kind="stable")
        # What a posting's term adds is this by the term's idf. Points are known once a term is asked for.
        self.saturated = (tf * (K1 + 1) / (tf + K1 * (1 - B + B * n_tokens / average)))[order]
        self.points = np.zeros(len(codes), dtype=np.int32)
        self.docs = np.repeat((np.cumsum(new) - 1).astype(np.int32), sizes)[order]
        self.sizes = np.bincount(codes, minlength=len(self.terms))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.known = np.zeros(len(self.terms), dtype=bool)
        # Terms that may add nothing to a document that has them, which is found all the same.
        self.weak = np.zeros(len(self.terms), dtype=bool)
        # The most that a document may get from a term: the sum, as it may have it by several texts.
        self.most = np.zeros(len(self.terms), dtype=np.int64)
        # Rows have room for whole blocks of documents. The commonest terms have one.
        self.width = -(-len(self.ids) // _BLOCK) * _BLOCK
        common = np.argsort(-self.sizes, kind="stable")[: len(codes) // len(self.ids)]
        common = common[self.sizes[common] * _DENSE >= len(self.ids)]
        self.row = np.full(len(self.terms), -1)
        self.row[common] = np.arange(len(common))
        self.commons = common
        self.rows = np.zeros((len(common), self.width), dtype=np.int32)

    def _weigh(self, codes: np.ndarray, idfs: np.ndarray) -> None:
        """Points of the terms that are asked for the first time."""
        codes, at = np.unique(codes, return_index=True)
        new = ~self.known[codes]
        codes, idfs = codes[new], idfs[at][new]
        if not len(codes):
            return
        self.known[codes] = True
        sizes = self.sizes[codes]
        places = _ranges(self.starts[codes], sizes)
        points = np.floor(np.repeat(idfs, sizes) * self.saturated[places] * self.scale + 0.5).astype(np.int32)
        self.points[places] = points
        self.weak[np.repeat(codes, sizes)[points == 0]] = True
        # Postings of a term are by document.
        docs, code = self.docs[places].astype(np.int64), np.repeat(np.arange(len(codes)), sizes)
        own = np.flatnonzero(np.diff(code * len(self.ids) + docs, prepend=-1))
        np.maximum.at(self.most, codes[code[own]], np.add.reduceat(points.astype(np.int64), own))
        common = self.row[codes[code]] >= 0
        if self.most[codes[code[common]]].max(initial=0) > np.iinfo(np.int32).max:
            self.rows = self.rows.astype(np.int64)
        np.add.at(self.rows, (self.row[codes[code[common]]], docs[common]), points[common])

    def _lower_bounds(self, scores: np.ndarray, rows: np.ndarray, of: np.ndarray) -> np.ndarray | int:
        """Scores that ``k`` documents reach, by the best of the blocks that promise most; 1 if there are too few."""
        blocks = scores.reshape(len(scores), -1, _BLOCK)
        tops = blocks.max(2)
        n = min(tops.shape[1], 4 * self.k + 32)
        if n < self.k:
            return 1
        asked = np.arange(len(scores))[:, None]
        best = np.argpartition(tops, tops.shape[1] - n, axis=1)[:, -n:]
        docs = best * _BLOCK + blocks[asked, best].argmax(2)
        reached = scores[asked, docs].astype(np.int64)
        if len(of):
            some, first = np.unique(of, return_index=True)
            reached[some] += np.add.reduceat(self.rows[rows[:, None], docs[of]], first, axis=0, dtype=np.int64)
        return np.maximum(1, np.partition(reached, n - self.k, axis=1)[:, n - self.k])

    def _improve(
        self, scores: np.ndarray, least: np.ndarray, rare: np.ndarray, by: np.ndarray, rows: np.ndarray, most: np.ndarray, of: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Questions, documents and points of what may be among some questions' best, as ``least`` says.

        ``scores`` has room for a row each. Rare terms are added up from postings, ``by`` question. Rows of common
        terms come ``of`` a question by the most that they add; while these together stay well below its ``least``,
        they are only looked up for documents that the others take near it.
        """
        n, width = scores.shape
        scores.fill(0)
        flat = scores.reshape(-1)
        sizes = self.sizes[rare]
        places = _ranges(self.starts[rare], sizes)
        np.add.at(flat, np.repeat(by * width, sizes) + self.docs[places], self.points[places])
        # Questions with fewer than k documents so far.
        extra = []
        few = least < 1
        if few.any():
            weak = np.bincount(by, self.weak[rare], n) + np.bincount(of, self.weak[self.commons[rows]], n) > 0
            least[few] = self._lower_bounds(scores[few], rows[few[of]], (np.cumsum(few) - 1)[of[few[of]]])
            for i in np.flatnonzero(few & weak).tolist():
                own = rows[of == i]
                terms = np.concatenate([rare[by == i], self.commons[own]])
                docs = np.unique(self.docs[_ranges(self.starts[terms], self.sizes[terms])]).astype(np.int64)
                found = scores[i, docs] + self.rows[own[:, None], docs].sum(0)
                extra.append((np.full(len(docs), i), docs, found.astype(np.int64)))
                least[i] = np.iinfo(np.int64).max
        growing = np.cumsum(most)
        begin = np.searchsorted(of, np.arange(n))
        growing -= np.concatenate([[0], growing])[begin][of]
        cut = growing <= _CELL_SPARE * least[of]
        spare = np.zeros(n, dtype=np.int64)
        np.maximum.at(spare, of[cut], growing[cut])
        for i, row in zip(of[~cut].tolist(), rows[~cut].tolist()):
            scores[i] += self.rows[row]
        needed = np.minimum(least - spare, np.iinfo(scores.dtype).max).astype(scores.dtype)
        eights = np.flatnonzero((scores >= needed[:, None]).reshape(-1).view(np.uint64))
        at = (eights[:, None] * 8 + np.arange(8)).reshape(-1)
        at = at[flat[at] >= needed[at // width]]
        asked, docs = at // width, at % width
        points = flat[at].astype(np.int64)
        ends = np.searchsorted(asked, np.arange(n + 1))
        sizes = np.diff(ends)[of[cut]]
        places = _ranges(ends[of[cut]], sizes)
        if len(places):
            more = self.rows.reshape(-1)[np.repeat(rows[cut] * width, sizes) + docs[places]]
            points += np.bincount(places, more, len(at)).astype(np.int64)
        kept = points >= least[asked]
        return tuple(np.concatenate(c) for c in zip((asked[kept], docs[kept], points[kept]), *extra))

    def answer(self, best: np.ndarray, terms: pa.Table, asked: pa.Table) -> None:
        """Puts the cell's documents among each question's best, if they are; of equal ones those of the lesser id.

        ``best`` has points and places of the best so far, -1 where there are fewer.
        """
        codes = pc.fill_null(pc.index_in(terms.column("term").combine_chunks(), self.terms), -1).to_numpy()
        here = codes >= 0
        self._weigh(codes[here], terms.column("idf").to_numpy()[here])
        lists = asked.column("terms").combine_chunks()
        codes = codes[pc.list_flatten(lists).to_numpy()]
        of = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        of, codes = of[codes >= 0], codes[codes >= 0]
        if not len(codes):
            return
        reach = np.bincount(of, self.most[codes], len(lists))
        live = (best[0, :, -1] < reach) & (np.bincount(of, minlength=len(lists)) > 0)
        questions, renumbered = np.flatnonzero(live), np.cumsum(live) - 1
        of, codes = renumbered[of[live[of]]], codes[live[of]]
        common = self.row[codes] >= 0
        rare, by = codes[~common], of[~common]
        codes, of = codes[common], of[common]
        order = np.lexsort((self.most[codes], of))
        codes, of = codes[order], of[order]
        kind = np.int32 if reach.max() < np.iinfo(np.int32).max else np.int64
        step = max(1, _SCORES // self.width)
        scores = np.zeros((step, self.width), dtype=kind)
        for start in range(0, len(questions), step):
            some = questions[start : start + step]
            a, b = np.searchsorted(by, [start, start + step])
            c, d = np.searchsorted(of, [start, start + step])
            found = self._improve(
                scores[: len(some)], best[0, some, -1] + 1, rare[a:b], by[a:b] - start,
                self.row[codes[c:d]], self.most[codes[c:d]], of[c:d] - start,
            )
            if len(found[0]):
                held = np.repeat(np.arange(len(some)), self.k), best[1, some].reshape(-1), best[0, some].reshape(-1)
                whose, places, points = (np.concatenate(x) for x in zip(held, (found[0], found[1] + self.first, found[2])))
                order = np.lexsort((places, -points, whose))
                rank = np.arange(len(order)) - np.searchsorted(whose[order], whose[order])
                order = order[rank < self.k]
                best[0, some], best[1, some] = (x[order].reshape(-1, self.k) for x in (points, places))


def _stream(**columns: pa.Array) -> bytes:
    table = pa.table(columns)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _pack_questions(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of questions as two Arrow streams: their different terms, and the questions with numbers of these."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, _HELD // k)
        for whole in batches:
            for batch in (whole.slice(i, rows) for i in range(0, len(whole), rows)):
                sizes = pc.list_value_length(batch.column("terms")).to_numpy()
                coded = pc.list_flatten(batch.column("terms")).dictionary_encode()
                idfs = np.empty(len(coded.dictionary))
                idfs[coded.indices.to_numpy()] = pc.list_flatten(batch.column("idfs")).to_numpy()
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, coded.indices)
                packed = [len(batch)], [_stream(term=coded.dictionary, idf=pa.array(idfs))], [
                    _stream(_q=batch.column("_q"), terms=lists)]
                kinds = pa.int64(), pa.binary(), pa.binary()
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(packed, kinds)], ["n", "vocabulary", "asked"])

    return pack


def _cells(batches: Iterator[pa.RecordBatch], postings: int) -> Iterator[pa.Table]:
    """Texts that come by their id, cut where so many postings are together, but not within an id."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column("tfs").flatten())
        if size >= postings:
            table = pa.Table.from_batches(held)
            ids, end = table.column("doc_id"), len(table) - 1
            last = ids[end].as_py()
            while end and ids[end - 1].as_py() == last:
                end -= 1
            if end:
                yield table.slice(0, end)
                held = table.slice(end).to_batches()
                size = sum(len(b.column("tfs").flatten()) for b in held)
    if held:
        yield pa.Table.from_batches(held)


def _answer_cells(
    average: float, k: int, postings: int, scale: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For a task's blocks of questions and then its texts by id: the questions' best texts."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = _Asked(k)

        def texts() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = len(batch) - batch.column("asked").null_count
                for i in range(n):
                    asked.add(*(batch.column(c)[i].as_py() for c in ("n", "vocabulary", "asked")))
                rest = batch.slice(n).select(["doc_id", "n_tokens", "terms", "tfs"])
                # In parts, so that a cell has about its number of postings.
                for i in range(0, len(rest), _TEXTS):
                    yield rest.slice(i, _TEXTS)

        ids = []
        for table in _cells(texts(), postings):
            cell = _Cell(table, average, k, scale, sum(map(len, ids)))
            ids.append(cell.ids)
            for block in asked.blocks():
                cell.answer(*block)
        if not ids:
            return
        names = pa.concat_arrays(ids)
        for (points, places), _, questions in asked.blocks():
            found = places >= 0
            offsets = pa.array(np.concatenate([[0], np.cumsum(found.sum(1))]).astype(np.int32))
            hits = pa.StructArray.from_arrays(
                [names.take(pa.array(places[found])), pa.array(points[found])], ["doc_id", "points"]
            )
            numbers = questions.column("_q").combine_chunks()
            yield pa.RecordBatch.from_arrays([numbers, pa.ListArray.from_arrays(offsets, hits)], ["_q", "hits"])

    return answer


def _cell_scores(asked: DataFrame, index: SearchIndex, k: int) -> DataFrame:
    """The scores of each task's ``k`` best documents for each question; ``asked`` is ``_q, terms, idfs``.

    Documents are dealt to tasks by their id, as many as there are cores to work on them. Every task gets all
    questions, and keeps them in a file while it goes through its cells.
    """
    spark = asked.sparkSession
    tasks = 2 * spark.sparkContext.defaultParallelism
    task = F.pmod(F.xxhash64("doc_id"), F.lit(tasks)).cast("int").alias("task")
    # Terms are of letters and digits; joined they take much less room.
    texts = index.texts.select(task, "doc_id", "n_tokens", F.array_join("terms", " ").alias("terms"), "tfs")
    packed = asked.mapInArrow(_pack_questions(k), "n bigint, vocabulary binary, asked binary")
    questions = packed.select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), "n", "vocabulary", "asked")
    dealt = texts.unionByName(questions, allowMissingColumns=True).repartitionById(tasks, "task")
    kind = index.texts.schema["doc_id"].dataType
    hit = T.StructType([T.StructField("doc_id", kind), T.StructField("points", T.LongType())])
    fields = [T.StructField("_q", T.LongType()), T.StructField("hits", T.ArrayType(hit))]
    found = dealt.sortWithinPartitions(F.col("asked").isNull(), "doc_id").mapInArrow(
        _answer_cells(index.corpus.first()["avg_tokens"], k, _CELL, _SCALE), T.StructType(fields)
    )
    return found.repartition("_q").select("_q", F.inline("hits"))


def _pruned_scores(asked: DataFrame, vocabulary: DataFrame, index: SearchIndex, k: int) -> DataFrame:
    """The scores that matter, found by bounds and blocks."""
    average = index.corpus.select("avg_tokens").scalar()
    weights = materialise(
        index.postings.join(vocabulary.select("term", "term_id", "idf"), "term").select(
            "doc_id", "block", "term_id", _points(average).alias("points")
        ),
        "weights",
    )
    q_terms = materialise(
        asked.select("_q", F.explode("_terms").alias("term"))
        .join(vocabulary.select("term", "term_id", "n_texts"), "term")
        .select("_q", "term_id", "n_texts"),
        "question-terms",
    )
    return _scores_that_matter(q_terms, weights, k)


def _best(scored: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("_q").orderBy(F.col("points").desc(), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(best).cast("bigint"))
    return ranked.where(F.col("rank") <= k)


def _with_copies(hits: DataFrame, index: SearchIndex, k: int) -> DataFrame:
    """Each text's hit for its first ``k`` documents; the others rank behind these."""
    documents = index.documents.where("text_key is not null")
    hit = documents.join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    alike = Window.partitionBy("text_key").orderBy("doc_id")
    first = (
        documents.join(hit.select("text_key"), "text_key", "left_semi")
        .withColumn("_rank", F.row_number().over(alike))
        .where(F.col("_rank") <= k)
    )
    groups = first.groupBy("text_key").agg(F.array_sort(F.collect_list("doc_id")).alias("_ids"))
    several = groups.where(F.size("_ids") > 1).select(F.col("_ids")[0].alias("doc_id"), "_ids")
    ids = F.explode(F.coalesce("_ids", F.array("doc_id"))).alias("doc_id")
    return hits.join(several, "doc_id", "left").select("_q", "points", ids)


def search_documents(
    queries: DataFrame,
    docs: DataFrame | SearchIndex,
    k: int = 5,
    text_col: str = "content",
    max_df_share: float | None = None,
) -> DataFrame:
    """The ``k`` best documents per query row: its columns but the text, ``rank, doc_id, score``.

    Equal scores rank by ``doc_id``. ``max_df_share`` leaves out terms that more than this share of
    the documents have.
    """
    index = docs if isinstance(docs, SearchIndex) else index_documents(docs)
    others = [c for c in queries.columns if c != text_col]
    term_set = F.array_sort(F.array_distinct(rules.tokens(F.col(text_col))))
    # Written, so that the questions are read and cut into terms once.
    keyed = queries.select(*others, term_set.alias("_terms")).withColumn(
        "_key", F.sha2(F.array_join("_terms", " "), 256)
    )
    keyed = materialise(keyed, "asked")
    # Tables that number their rows are written once, so that the numbers stay the same.
    asked = materialise(
        keyed.groupBy("_key")
        .agg(F.first("_terms").alias("_terms"))
        .withColumn("_q", F.monotonically_increasing_id()),
        "questions",
    )
    vocabulary = materialise(_vocabulary(asked, index, max_df_share), "vocabulary")
    if asked.count() <= _FEW_QUESTIONS:
        scored = _pruned_scores(asked, vocabulary, index, k)
    else:
        terms = asked.select("_q", F.explode("_terms").alias("term")).join(vocabulary.select("term", "idf"), "term")
        lists = terms.groupBy("_q").agg(F.collect_list(F.struct("term", "idf")).alias("_terms"))
        lists = lists.select("_q", F.col("_terms.term").alias("terms"), F.col("_terms.idf").alias("idfs"))
        scored = _cell_scores(lists, index, k)
    texts = materialise(_best(scored, k).select("_q", "doc_id", "points"), "hits")
    hits = _best(_with_copies(texts, index, k), k)
    found = asked.select("_key", "_q").join(hits, "_q")
    return keyed.join(found, "_key").select(
        *others, "rank", "doc_id", (F.col("points") / _SCALE).alias("score")
    )


# Fixed text that opens the message with the hits.
HITS_LABEL = "Search results:"


def augment_prompts(prompts: DataFrame, hits: DataFrame) -> DataFrame:
    """R2: the hits' snippets, best first, as one more system message before the question.

    ``hits`` is ``chat_id, turn, rank, snippet``; prompts without hits stay as they are.
    """
    found = hits.groupBy("chat_id", "turn").agg(
        F.array_sort(F.collect_list(F.struct("rank", "snippet"))).alias("_hits")
    )
    snippets = F.array_join(F.transform("_hits", lambda h: h["snippet"]), "\n")
    message = F.struct(
        F.lit("system").alias("role"),
        F.concat(F.lit(HITS_LABEL + "\n"), snippets).alias("content"),
    )
    size = F.size("prompt")
    extended = F.concat(
        F.slice("prompt", F.lit(1), size - 1), F.array(message), F.slice("prompt", size, F.lit(1))
    )
    return prompts.join(found, ["chat_id", "turn"], "left").select(
        *[c for c in prompts.columns if c != "prompt"],
        F.when(F.col("_hits").isNull(), F.col("prompt")).otherwise(extended).alias("prompt"),
    )
