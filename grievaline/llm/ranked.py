"""Ranked lexical search: range maxima per posting list, best-first over document intervals.

The index is built once, for any queries: a row holds a shard of documents with the
posting lists of all its terms, documents in ascending id order. A search reads the
shards and works on intervals of their documents. A range-maximum table per posting list
gives the greatest impact of a term inside an interval; their sum bounds every score in
it. The interval with the greatest bound is split at the document where its strongest
term has that maximum, which is scored exactly. What cannot reach an item's k-th score any
more is dropped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grievaline.llm.common import travels
from grievaline.sources.workdir import new_dir, pinned

travels(__name__)

TOP_K = 20
SHARD_WORDS = 1 << 20
FILE_SHARDS = 16
BLOCK_TERMS = 1 << 20
ITEMS_AT_ONCE = 256
SPLITS_AT_ONCE = 8
CELLS_AT_ONCE = 1 << 18
TASK_GROUPS = 64
# Digits, letters and all characters beyond ASCII are parts of terms; A-Z become a-z.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
JAVA_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

INDEX = T.StructType(
    [
        T.StructField("n_docs", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("ids", T.ArrayType(T.LongType())),
        T.StructField("sizes", T.ArrayType(T.LongType())),
        T.StructField("terms", T.ArrayType(T.StringType())),
        T.StructField("counts", T.ArrayType(T.IntegerType())),
        T.StructField("places", T.ArrayType(T.IntegerType())),
        T.StructField("tfs", T.ArrayType(T.IntegerType())),
    ]
)


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LETTERS).split()


def shard_row(ids: list, texts: list[list[bytes]]) -> list:
    """One index row: documents in id order, null ids first, and the postings by term."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i]))
    number: dict[bytes, int] = {}
    words = [np.array([number.setdefault(w, len(number)) for w in texts[i]], dtype=np.int64) for i in order]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    keys = np.concatenate([np.zeros(0, np.int64), *words]) * len(ids) + np.repeat(np.arange(len(ids)), sizes)
    keys, tfs = np.unique(keys, return_counts=True)
    counts = np.bincount(keys // max(len(ids), 1), minlength=len(number))
    return [
        int((sizes > 0).sum()),
        int(sizes.sum()),
        [ids[i] for i in order],
        sizes,
        pa.array(list(number), pa.binary()).cast(pa.string()),
        counts.astype(np.int32),
        (keys % max(len(ids), 1)).astype(np.int32),
        tfs.astype(np.int32),
    ]


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard_words: int = SHARD_WORDS) -> DataFrame:
    """Index rows of whole documents, written once; reads nothing but key and text.

    A shard ends when it holds ``shard_words`` words, so it is bounded by that and one
    text. Texts without terms are in no posting list.
    """
    kinds = [pa.int64(), pa.int64(), *map(pa.list_, [pa.int64(), pa.int64(), pa.string(), *[pa.int32()] * 3])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[bytes]] = []
        words = 0

        def shard() -> pa.RecordBatch:
            row = [pa.array([v], type=k) for v, k in zip(shard_row(ids, texts), kinds)]
            return pa.RecordBatch.from_arrays(row, names=INDEX.names)

        for batch in batches:
            for i, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                ids.append(i)
                texts.append(terms_of(value.as_py()))
                words += len(texts[-1])
                if words >= shard_words:
                    yield shard()
                    ids, texts, words = [], [], 0
        if ids:
            yield shard()

    spark = docs.sparkSession
    path = new_dir(spark, "index")
    read = docs.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`"))
    # a reader takes a file's rows at once, so a file holds few shards
    read.mapInArrow(run, INDEX).write.option("maxRecordsPerFile", FILE_SHARDS).parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def item_terms(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """``item, term, qtf``: how often an item has a term.

    Equal rows count once; rows of one id are one item with the terms of all of them.
    """
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = items.select(F.col(key).alias("item"), low.alias("low")).distinct()
    terms = F.explode(F.regexp_extract_all("low", F.lit(JAVA_TERM), F.lit(0)))
    return each.select("item", terms.alias("term")).groupBy("item", "term").agg(F.count("*").alias("qtf"))


class Queries:
    """A block of items: their distinct terms, and per item term numbers and weights."""

    def __init__(self, rows: list, df: dict[str, int], n_docs: int):
        self.terms = sorted({r["term"] for r in rows})
        number = {t: i for i, t in enumerate(self.terms)}
        weight = [int(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1)))) for t in self.terms]
        by_item: dict = {}
        for r in rows:
            t = number[r["term"]]
            if df.get(r["term"]) and weight[t]:
                by_item.setdefault(r["item"], []).append((t, weight[t] * r["qtf"]))
        # items with similarly many terms are searched together
        listed = sorted(by_item.items(), key=lambda e: len(e[1]))
        self.items = [item for item, _ in listed]
        self.lists = [terms for _, terms in listed]

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(item numbers, term numbers, weights)`` of similar items, short rows padded with -1."""
        at = 0
        while at < len(self.lists):
            room = 2 * len(self.lists[at])
            to = at
            while to < len(self.lists) and to - at < ITEMS_AT_ONCE and len(self.lists[to]) <= room:
                to += 1
            terms = np.full((to - at, len(self.lists[to - 1])), -1, dtype=np.int64)
            weights = np.zeros(terms.shape, dtype=np.int64)
            for i, some in enumerate(self.lists[at:to]):
                terms[i, : len(some)], weights[i, : len(some)] = zip(*some)
            yield np.arange(at, to), terms, weights
            at = to


class Postings:
    """The posting lists of some terms in one shard, with their range-maximum tables."""

    def __init__(self, starts: np.ndarray, places: np.ndarray, impact: np.ndarray, n_docs: int):
        self.starts, self.places, self.impact, self.n_docs = starts, places, impact, n_docs
        lists = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.keys = lists * n_docs + places  # ascending, so one search finds a place in its list
        level = np.arange(len(places), dtype=np.int32)
        self.table = [level]
        longest = int(np.diff(starts).max(initial=0))
        while 2 << len(self.table) - 1 <= longest:
            step = 1 << len(self.table) - 1
            left, right = level[:-step], level[step:]
            level = level.copy()
            level[: len(left)] = np.where(impact[left] >= impact[right], left, right)
            self.table.append(level)
        self.table = np.stack(self.table)

    def strongest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The first posting of greatest impact in each range ``lo..hi-1``; -1 where it is empty."""
        size = hi - lo
        some = size > 0
        level = np.frexp(np.where(some, size, 1))[1] - 1
        a = self.table[level, np.where(some, lo, 0)]
        b = self.table[level, np.where(some, hi - (1 << level), 0)]
        return np.where(some, np.where(self.impact[a] >= self.impact[b], a, b), -1)

    def places_of(self, lists: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, lists * self.n_docs + doc)


class Best:
    """The best ``k`` documents of every item so far: higher score, then smaller id."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.rows = np.zeros((0, 4), dtype=np.int64)  # item, score, whether an id is given, id
        self.floor = np.ones(n_items, dtype=np.int64)
        self.last = np.full(n_items, np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray) -> None:
        rows = rows[rows[:, 1] >= self.floor[rows[:, 0]]]
        if not len(rows):
            return
        rows = np.concatenate([self.rows, rows])
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], rows[:, 0])
        place = np.arange(len(rows)) - first
        self.rows = rows[place < self.k]
        full = rows[place == self.k - 1]
        self.floor[full[:, 0]] = full[:, 1]
        self.last[full[:, 0]] = np.where(full[:, 2] == 1, full[:, 3], np.iinfo(np.int64).min)


def search_group(
    postings: Postings, ids: np.ndarray, given: np.ndarray, items: np.ndarray, lists: np.ndarray, weights: np.ndarray, best: Best
) -> int:
    """Best-first search of one shard for items that share a matrix of terms.

    ``lists`` has a posting list per item and term, an empty one where there is none.
    Every round splits the intervals with the greatest bounds of each item that still can
    give a better document. Returns how many documents were scored.
    """
    least = np.where(given == 1, ids, np.iinfo(np.int64).min)

    def bounded(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray, from_doc: np.ndarray) -> tuple:
        strong = postings.strongest(lo, hi)
        parts = np.where(strong >= 0, weights[owner] * postings.impact[strong], 0)
        bound = parts.sum(axis=1)
        at = strong[np.arange(len(owner)), parts.argmax(axis=1)]
        return owner, lo, hi, from_doc, bound, np.where(bound > 0, postings.places[at], 0)

    def hopeful(pool: tuple) -> tuple:
        owner, _, _, from_doc, bound, _ = pool
        floor, last = best.floor[items[owner]], best.last[items[owner]]
        good = (bound > floor) | ((bound == floor) & (least[np.minimum(from_doc, len(ids) - 1)] <= last))
        return tuple(p[good] for p in pool)

    n, scored = len(items), 0
    pool = hopeful(bounded(np.arange(n), postings.starts[lists], postings.starts[lists + 1], np.zeros(n, dtype=np.int64)))
    at_once = max(CELLS_AT_ONCE // lists.shape[1], n)
    while len(pool[0]):
        order = np.lexsort((-pool[4], pool[0]))
        owners = pool[0][order]
        place = np.arange(len(order)) - np.searchsorted(owners, owners)
        chosen = place < max(SPLITS_AT_ONCE, at_once // max(len(np.unique(owners)), 1) // 8)
        now, later = order[chosen], order[~chosen]
        owner, lo, hi, from_doc, _, doc = (p[now] for p in pool)
        mid = np.clip(postings.places_of(lists[owner], doc[:, None]), lo, hi)
        there = mid < hi
        there &= postings.places[np.where(there, mid, 0)] == doc[:, None]
        score = np.where(there, weights[owner] * postings.impact[np.where(there, mid, 0)], 0).sum(axis=1)
        scored += len(doc)
        best.add(np.stack([items[owner], score, given[doc], ids[doc]], axis=1))
        halves = bounded(
            np.concatenate([owner, owner]),
            np.concatenate([lo, mid + there]),
            np.concatenate([mid, hi]),
            np.concatenate([from_doc, doc + 1]),
        )
        pool = hopeful(tuple(np.concatenate([p[later], h]) for p, h in zip(pool, halves)))
    return scored


def impacts(tfs: np.ndarray, sizes: np.ndarray, n_docs: int, n_words: int) -> np.ndarray:
    """A posting's share of a score before its weight, in whole numbers."""
    m = 75 + (25 * sizes * n_docs) // n_words
    return (1_000_000_000 * tfs) // (1000 * tfs + 12 * m)


def numbers(column: pa.Array, row: int, kind=np.int64) -> np.ndarray:
    return column[row].values.to_numpy(zero_copy_only=False).astype(kind)


def shard_postings(batch: pa.RecordBatch, row: int, wanted: pa.Array, n_docs: int, n_words: int) -> tuple[Postings, np.ndarray, np.ndarray, np.ndarray]:
    """The wanted terms' postings in one index row, ids with their null marks, list numbers by term."""
    get = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    ids = get["ids"][row].values
    given = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = numbers(get["sizes"], row)
    place = pc.index_in(wanted, value_set=get["terms"][row].values).fill_null(-1).to_numpy()
    counts = numbers(get["counts"], row)
    ends = np.cumsum(counts)
    found = np.flatnonzero(place >= 0)
    length = counts[place[found]]
    first = ends[place[found]] - length
    starts = np.concatenate([[0], np.cumsum(length), [length.sum()]])  # the last list is empty
    at = np.arange(length.sum()) + np.repeat(first - starts[:-2], length)
    docs = numbers(get["places"], row)[at]
    impact = impacts(numbers(get["tfs"], row)[at], sizes[docs], n_docs, n_words)
    lists = np.full(len(wanted) + 1, len(found), dtype=np.int64)
    lists[found] = np.arange(len(found))
    return Postings(starts, docs, impact, len(sizes)), pc.fill_null(ids, 0).to_numpy(), given, lists


def block_hits(index: DataFrame, queries: Queries, n_docs: int, n_words: int, k: int) -> DataFrame:
    """``item, task, doc_id, score``: each task's best documents per item number."""
    terms, groups = pa.array(queries.terms, pa.string()), list(queries.groups())
    n_items = len(queries.items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(n_items, k)  # what earlier shards found prunes the later ones
        for batch in batches:
            for row in range(batch.num_rows):
                postings, ids, given, lists = shard_postings(batch, row, terms, n_docs, n_words)
                if len(postings.places):
                    for items, numbered, weights in groups:
                        search_group(postings, ids, given, items, lists[numbered], weights, best)
        found = best.rows
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(found[:, 0].astype(np.int32)),
                pa.array(found[:, 3], mask=found[:, 2] == 0),
                pa.array(found[:, 1]),
            ],
            names=["item", "doc_id", "score"],
        )

    wide = index.where("n_docs > 0").select("ids", "sizes", "terms", "counts", "places", "tfs")
    return wide.mapInArrow(run, "item int, doc_id long, score long").withColumn(
        "task", F.spark_partition_id() % TASK_GROUPS
    )


def document_counts(index: DataFrame, terms: list[str]) -> dict[str, int]:
    """How many documents hold each of the terms, from the index."""
    wanted = pa.array(terms, pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                place = pc.index_in(wanted, value_set=batch.column(0)[row].values).fill_null(-1).to_numpy()
                counts = numbers(batch.column(1), row)
                total += np.where(place >= 0, counts[place], 0) if len(counts) else 0
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    rows = index.select("terms", "counts").mapInArrow(run, "term long, df long")
    return {terms[r["term"]]: r["df"] for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def search(items: DataFrame, index: DataFrame, k: int = TOP_K, key: str = "item_id", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best documents of every item.

    Items go to the tasks in blocks of about ``block_terms`` terms (a longer item makes a
    block of its own size); every block reads the stored index, never the texts. Equal
    scores rank by ascending id, null ids first, copies one after the other. An item
    without terms, or whose terms no document holds, has no rows; null is an item id
    like others; an empty index or no items give no rows.
    """
    spark = items.sparkSession
    kind = items.schema[key].dataType
    schema = T.StructType([T.StructField(key, kind), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    totals = index.agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("l")).first()
    terms = pinned(item_terms(items, key))
    n_terms = terms.count()
    if not totals["n"] or not n_terms:
        return spark.createDataFrame([], schema)
    blocks = -(-n_terms // block_terms)
    parts = []
    for block in range(blocks):
        rows = terms.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()
        df = document_counts(index, sorted({r["term"] for r in rows}))
        queries = Queries(rows, df, totals["n"])
        if not queries.items:
            continue
        hits = block_hits(index, queries, totals["n"], totals["l"], k)
        for by in (["item", "task"], ["item"]):
            place = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
            hits = hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        names = spark.createDataFrame(
            [(i, item) for i, item in enumerate(queries.items)], T.StructType([T.StructField("item", T.IntegerType()), T.StructField(key, kind)])
        )
        parts.append(pinned(hits.join(names, "item").select(key, "rank", "doc_id", "score")))
    found = spark.createDataFrame([], schema)
    for part in parts:
        found = found.union(part)
    return found
