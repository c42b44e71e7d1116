"""Benchmark passages in training texts, through a distributed positional index."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grievaline.llm.common import pinned, travels, without

travels(__name__)

WINDOW = 10
SLACK = 3
SHARD_WORDS = 1 << 20
BLOCK_WINDOWS = 50_000
MAX_TERMS = 1 << 22
# Behind lower-casing A-Z: digits, a-z, and every character beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
JAVA_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

POSTINGS = [("starts", T.LongType()), ("terms", T.IntegerType()), ("counts", T.IntegerType()), ("positions", T.IntegerType())]
RESULTS = [("n_words", T.LongType()), ("hits", T.ArrayType(T.LongType())), ("exact", T.ArrayType(T.LongType())), ("near", T.ArrayType(T.LongType()))]


def items_as_words(benchmark: DataFrame) -> DataFrame:
    """``item, words``: the words of each item that has some, ids as text."""
    low = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(low, F.lit(JAVA_WORD), F.lit(0))
    return benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words")).where(F.size("words") > 0)


def windows_of(items: DataFrame, width: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows as ``words, owners``, and the sets of items as ``owners, items``.

    Windows that are in the same items share one set, named by a digest: a passage that
    many items hold does not repeat their ids for each of its windows.
    """
    last = F.greatest(F.size("words") - width, F.lit(0))
    each = items.select("item", F.explode(F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("words", i + 1, width))).alias("words"))
    held = each.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))
    named = pinned(held.withColumn("owners", F.sha2(F.to_json("items"), 256)))
    sets = named.groupBy("owners").agg(F.any_value("items").alias("items"))
    return named.select("words", "owners"), sets


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], shard_words: int = SHARD_WORDS) -> DataFrame:
    """Positional index shards of ``docs (text, rest)``, one row per shard.

    A shard holds consecutive texts of a task up to ``shard_words`` words (a longer text
    is a shard of its own): what belongs to each text (``rest``), the first position and
    the words of each, and per test term its ascending positions. Positions run through
    the shard with a gap behind each text, so that no phrase leaves it. Words that no
    test holds keep their position and have no postings. Texts are read whole.
    """
    schema = T.StructType(
        [T.StructField("rest", T.ArrayType(docs.schema["rest"].dataType))]
        + [T.StructField(n, T.ArrayType(t)) for n, t in POSTINGS]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap = np.full(2 * (WINDOW + SLACK), -1, dtype=np.int32)
        rest: list[pa.Array] = []
        words: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            lengths = np.array([w.size for w in words], dtype=np.int64)
            starts = np.cumsum(lengths + gap.size) - lengths - gap.size
            every = np.concatenate([x for w in words for x in (w, gap)])
            at = np.flatnonzero(every >= 0).astype(np.int32)
            terms, counts = np.unique(every[at], return_counts=True)
            lists = [
                np.concatenate([starts, lengths]),
                terms,
                counts.astype(np.int32),
                at[np.argsort(every[at], kind="stable")],
            ]
            arrays = [pa.concat_arrays(rest), *map(pa.array, lists)]
            return pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in arrays],
                names=schema.names,
            )

        held = 0
        for batch in batches:
            for i, text in enumerate(batch.column(0).cast(pa.binary())):
                found = WORD.findall((text.as_py() or b"").lower())
                if words and held + len(found) > shard_words:
                    yield shard()
                    rest, words, held = [], [], 0
                words.append(np.array([vocabulary.get(w, -1) for w in found], dtype=np.int32))
                rest.append(batch.column(1).slice(i, 1))
                held += len(found) + gap.size
        if words:
            yield shard()

    return docs.select("text", "rest").mapInArrow(run, schema)


def _block(windows: list, numbers: dict[bytes, int], frequency: dict[int, int]) -> dict:
    """Windows as arrays: their numbers, and their terms with offsets, the rarest in the corpus first."""
    by_width: dict[int, list] = {}
    for number, words in windows:
        by_width.setdefault(len(words), []).append((number, words))
    made = {}
    for width, some in by_width.items():
        terms = np.array([[numbers[w.encode()] for w in words] for _, words in some], dtype=np.int64)
        rarity = np.array([[frequency.get(t, 0) for t in row] for row in terms.tolist()], dtype=np.int64)
        order = np.argsort(rarity, axis=1, kind="stable")
        made[width] = {
            "terms": np.take_along_axis(terms, order, axis=1),
            "offsets": order.astype(np.int64),
            "possible": rarity.min(axis=1) > 0,
            "numbers": np.array([n for n, _ in some], dtype=np.int64),
        }
    return made


def _search(part: dict, index: np.ndarray, size: int, starts: np.ndarray, slack: int) -> Iterator[tuple]:
    """Occurrences of windows of one width: ``windows, starts, texts, is exact``.

    ``index`` holds ``term * size + position`` in ascending order, the lists of all
    terms behind one another. Candidates are the starts that the rarest term's list
    gives; each further list, by rarity, keeps the starts whose offset position it
    holds. A near occurrence has every term within ``slack`` words of its place.
    """
    terms, offsets = part["terms"], part["offsets"]
    first = np.searchsorted(index, terms[:, 0] * size)
    last = np.searchsorted(index, (terms[:, 0] + 1) * size)
    many = np.where(part["possible"], last - first, 0)
    chosen = np.flatnonzero(many)
    for cut in np.array_split(chosen, max(1, int(many.sum()) >> 20)):
        window = np.repeat(cut, many[cut])
        step = np.arange(window.size) - np.repeat(np.cumsum(many[cut]) - many[cut], many[cut])
        place = index[first[window] + step] - terms[window, 0] * size
        text = np.searchsorted(starts, place, side="right") - 1
        start = place - offsets[window, 0]
        for within in (0, slack):
            # words of a near match may have moved towards the text's first word
            inside = start >= starts[text] - within
            w, s, t = window[inside], start[inside], text[inside]
            for k in range(1, terms.shape[1]):
                wanted = terms[w, k] * size + s + offsets[w, k]
                at = np.searchsorted(index, np.maximum(wanted - within, terms[w, k] * size))
                held = index[np.minimum(at, index.size - 1)]
                ok = (at < index.size) & (held <= wanted + within)
                w, s, t = w[ok], s[ok], t[ok]
            yield w, s - starts[t], t, within == 0


def find(index: DataFrame, block: dict, slack: int = SLACK) -> DataFrame:
    """Per text of the index: its words, the positions hit, and the windows exact and near."""
    rest = index.schema["rest"].dataType.elementType
    schema = T.StructType([T.StructField("rest", rest)] + [T.StructField(n, t) for n, t in RESULTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                marks, terms, counts, positions = (
                    np.asarray(c[i].values).astype(np.int64) for c in batch.columns[1:]
                )
                n = marks.size // 2
                starts, lengths = marks[:n], marks[n:]
                size = int(starts[-1] + lengths[-1]) + 4 * (WINDOW + SLACK)
                keys = np.repeat(terms, counts) * size + positions
                hits, exact, near = ([set() for _ in range(n)] for _ in range(3))
                for part in block.values() if keys.size else ():
                    width = part["terms"].shape[1]
                    for found, at, text, is_exact in _search(part, keys, size, starts, slack):
                        for w, s, t in zip(part["numbers"][found].tolist(), at.tolist(), text.tolist()):
                            near[t].add(w)
                            if is_exact:
                                exact[t].add(w)
                                hits[t].update(range(s, s + width))
                lists = [pa.array([sorted(x) for x in xs], pa.list_(pa.int64())) for xs in (hits, exact, near)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, pa.array(lengths), *lists], names=schema.names
                )

    return index.mapInArrow(run, schema)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    carry: list[str] | None = None,
    width: int = WINDOW,
    slack: int = SLACK,
) -> DataFrame:
    """``docs`` (or its columns ``carry``) with ``n_words, n_hit, n_items, items_sha256, contaminated, n_near``.

    The corpus is read once: its index, over the union of the benchmark's words, is
    written and carries the rows' columns. The windows are searched in it in blocks of
    about ``BLOCK_WINDOWS``, the only data that is sent to every task besides the words'
    numbers while the index is built. (A benchmark of more than ``MAX_TERMS`` different
    words is taken in parts of that size, each with an index of its own.) Tasks give the
    numbers of the windows they find; items join them in Spark, for the texts that have
    any. ``n_near`` counts items with a proximity match: all words of a window within
    ``slack`` words of their place around the rarest one. Null and empty texts have no
    words; items without words or with a null id match nothing; equal item ids are one
    item; repeated rows stay; an empty benchmark marks nothing. Columns named like the
    results are replaced.
    """
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"]
    docs = without(docs, *names)
    columns = docs.columns if carry is None else carry
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]
    rows = docs.select("text", F.struct(*rest, F.monotonically_increasing_id().alias("row")).alias("rest"))
    windows, sets = windows_of(items_as_words(benchmark.where("item_id is not null")), width)
    windows = pinned(windows.withColumn("number", F.monotonically_increasing_id()))
    terms = windows.select(F.explode("words").alias("w")).distinct()
    passes = max(1, -(-terms.count() // MAX_TERMS))
    if passes > 1:
        rows = pinned(rows)  # the same row numbers in every pass
    found = None
    for number in range(passes):
        mine = windows.where(F.pmod(F.xxhash64("words"), F.lit(passes)) == number)
        words = mine.select(F.explode("words").alias("w")).distinct()
        numbers = {w: i for i, w in enumerate(sorted(r["w"].encode() for r in words.collect()))}
        index = pinned(build_index(rows, numbers))
        frequency = (
            index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t"))
            .groupBy("t.terms")
            .agg(F.sum("t.counts").alias("n"))
            .collect()
        )
        counts = {r["terms"]: r["n"] for r in frequency}
        blocks = max(1, -(-mine.count() // BLOCK_WINDOWS))
        for at in range(blocks):
            some = mine.where(F.pmod(F.xxhash64("words", F.lit(1)), F.lit(blocks)) == at)
            block = _block([(r["number"], r["words"]) for r in some.select("number", "words").collect()], numbers, counts)
            part = find(index, block, slack)
            found = part if found is None else found.union(part)
    if passes * blocks > 1:
        lists = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("hits", "exact", "near")]
        found = found.groupBy(F.col("rest.row")).agg(F.first("rest").alias("rest"), F.first("n_words").alias("n_words"), *lists)
    found = pinned(found.select("rest", "n_words", F.size("hits").cast("long").alias("n_hit"), "exact", "near"))
    clear = found.where(F.size("near") == 0).select(
        "rest", "n_words", "n_hit", F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(0).cast("long").alias("n_near")
    )
    marked = found.where(F.size("near") > 0)
    items = _items_of(marked, windows.select("number", "owners"), sets)
    hit = marked.withColumn("row", F.col("rest.row")).join(items, "row").select("rest", "n_words", "n_hit", "n_items", "items_sha256", "n_near")
    return clear.union(hit).select(
        *[F.col(f"rest.c{i}").alias(c) for i, c in enumerate(columns)],
        "n_words",
        "n_hit",
        "n_items",
        "items_sha256",
        (F.col("n_hit") > 0).alias("contaminated"),
        "n_near",
    )


def _items_of(marked: DataFrame, windows: DataFrame, sets: DataFrame) -> DataFrame:
    """``row, n_items, items_sha256, n_near`` of texts with windows.

    Windows become the sets they belong to, a text's sets are taken once each, and only
    then become items.
    """
    row = F.col("rest.row").alias("row")
    each = marked.select(row, F.explode("near").alias("number"), F.lit(False).alias("is_exact")).union(
        marked.select(row, F.explode("exact"), F.lit(True))
    )
    owned = each.join(windows, "number").groupBy("row", "owners").agg(F.max("is_exact").alias("is_exact"))
    lists = owned.join(sets, "owners").groupBy("row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("is_exact"), F.col("items")))))).alias("exact"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("near"),
    )
    return lists.select(
        "row",
        F.size("exact").cast("long").alias("n_items"),
        F.sha2(F.array_join("exact", ","), 256).alias("items_sha256"),
        F.size("near").cast("long").alias("n_near"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark window, with their own columns.

    The verdict on a text is joined back by id and a hash of the text, so that the index
    holds no texts.
    """
    thin = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_hash"), "text")
    dirty = contamination(thin, benchmark, ["_id", "_hash"]).where("contaminated").select("_id", "_hash").distinct()
    same = docs["doc_id"].eqNullSafe(dirty["_id"]) & (F.xxhash64(docs["text"]) == dirty["_hash"])
    return docs.join(dirty, same, "left_anti")
