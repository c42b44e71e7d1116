"""Near copies by SimHash: fingerprints, BK-trees per shard, components of links."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grievaline.llm.common import boxed, components, grouped_rows, per_text, pinned, row_hash, travels, unboxed, without
from grievaline.operators.hotkeys import lookup_join

travels(__name__)

SLICE = 1 << 16
HOT_ROWS = 1000
LANES = 0x0101010101010101


def simhash(text: bytes | None, shingle: int = 4) -> int:
    """The 64-bit fingerprint of a text, as a signed integer.

    A-Z is lower-cased, words are runs without ASCII white space, shingles keep their
    repeats; fewer words than a shingle are one shingle. A bit is set if it is set in
    more than half of the shingles' XXH64 (seed 42). No words, empty or null: zero.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    stops = np.cumsum(sizes + 1) - 1
    starts = stops - sizes
    width = min(shingle, len(words))
    total = len(words) - width + 1
    ones = np.zeros((8, 8), dtype=np.int64)
    for at in range(0, total, SLICE):
        to = min(at + SLICE, total)
        parts = [
            line[i:j]
            for i, j in zip(starts[at:to].tolist(), stops[at + width - 1 : to + width - 1].tolist())
        ]
        hashed = np.frombuffer(b"".join(map(xxhash.xxh64_digest, parts, repeat(42))), dtype=">u8")
        hashed = hashed.astype(np.uint64)
        cuts = np.arange(0, to - at, 255)
        for bit in range(8):  # lane j of a word counts bit 8 * j + bit, 255 words at a time
            lanes = np.add.reduceat((hashed >> np.uint64(bit)) & np.uint64(LANES), cuts)
            ones[:, bit] += lanes.astype("<u8").view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = (ones.reshape(64) * 2 > total).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 4) -> DataFrame:
    """``docs`` with a long column ``fingerprint``; a column of that name is replaced."""

    def make():
        return lambda value: (simhash(value, shingle),)

    return per_text(docs, text, [T.StructField("fingerprint", T.LongType())], make)


def block_masks(blocks: int, agree: int) -> list[int]:
    """Masks of every choice of ``agree`` out of ``blocks`` parts of 64 bits, signed."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def bk_forest(prints: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that connect what is within ``radius`` bits of each other, without cycles.

    A BK-tree holds the prints; a child hangs on the edge of its distance to its
    parent, and a search follows only edges within the radius of the distance. What has
    been reached is not reported again, and subtrees without anything left are skipped,
    so a dense group costs about one search, not all its pairs.
    """
    n = len(prints)
    children: list[dict[int, int]] = [{} for _ in prints]
    parent = [-1] * n
    for i in range(1, n):
        value, at = prints[i], 0
        while True:
            edge = (value ^ prints[at]).bit_count()
            below = children[at].setdefault(edge, i)
            if below == i:
                parent[i] = at
                break
            at = below
    left = [1] * n
    for i in range(n - 1, 0, -1):
        left[parent[i]] += left[i]
    seen = bytearray(n)

    def take(i: int) -> None:
        seen[i] = 1
        while i >= 0:
            left[i] -= 1
            i = parent[i]

    links = []
    for start in range(n):
        if seen[start]:
            continue
        take(start)
        todo = [start]
        while todo:
            value, stack = prints[todo.pop()], [0]
            while stack:
                at = stack.pop()
                if not left[at]:
                    continue
                distance = (value ^ prints[at]).bit_count()
                if distance <= radius and not seen[at]:
                    take(at)
                    links.append((value, prints[at]))
                    todo.append(at)
                low, high = distance - radius, distance + radius
                stack += [c for e, c in children[at].items() if low <= e <= high]
    return links


def _tree_links(radius: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for _, shard in grouped_rows(batches, 2):
            if shard.num_rows > 1:
                prints = np.asarray(shard.column(2)).astype(np.int64).view(np.uint64).tolist()
                out += bk_forest(prints, radius)
            if len(out) >= SLICE:
                yield _links(out, schema)
                out = []
        yield _links(out, schema)

    return run


def _links(rows: list[tuple[int, int]], schema: pa.Schema) -> pa.RecordBatch:
    pairs = np.array(rows, dtype=np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema
    )


def _sharded(prints: DataFrame, masks: list[int], *keys: str) -> DataFrame:
    choices = [
        F.struct(F.lit(i).alias("choice"), F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")).alias("part"))
        for i, m in enumerate(masks)
    ]
    return prints.select(*keys, "fingerprint", F.explode(F.array(*choices)).alias("s")).select(
        *keys, "s.choice", "s.part", "fingerprint"
    )


def linked_fingerprints(prints: DataFrame, bits: int = 4, shard_rows: int = 4096) -> DataFrame:
    """Links ``a, b`` that connect all distinct ``fingerprint`` within ``bits`` bits.

    Two prints within ``bits`` bits agree in at least ``agree`` of ``bits + agree``
    blocks. So a shard is a choice of blocks with their value, and two such prints meet
    in one of the shards, whose tree is searched by exactly the prints of the shard: a
    tree goes where its queries are, and no task holds all of them. ``agree`` follows
    the number of prints and keeps the mean shard below half of ``shard_rows``, large
    enough for a tree to spare most of it. A shard of more than
    ``shard_rows`` is cut once more by finer blocks in the same exact way; what still
    meets in one tree then agrees in half of its bits twice over.
    """
    n = prints.count()
    agree = 1
    while agree < 4 and n >> (64 * agree // (bits + agree)) > shard_rows // 2:
        agree += 1
    shards = _sharded(prints, block_masks(bits + agree, agree))
    crowded = pinned(shards.groupBy("choice", "part").count().where(F.col("count") > shard_rows).drop("count"))
    parts = [shards]
    if not crowded.isEmpty():
        finer = block_masks(bits + 4, 4)
        hot = shards.join(crowded, ["choice", "part"]).select(
            F.xxhash64("choice", "part").alias("outer"), "fingerprint"
        )
        cut = _sharded(hot, finer, "outer")
        parts = [
            shards.join(crowded, ["choice", "part"], "left_anti"),
            # the outer shard becomes part of the key; a clash only makes a shard larger
            cut.select("choice", F.xxhash64("outer", "part").alias("part"), "fingerprint").distinct(),
        ]
    found = None
    for part in parts:
        links = (
            part.repartition("choice", "part")
            .sortWithinPartitions("choice", "part")
            .mapInArrow(_tree_links(bits), "a long, b long")
        )
        found = links if found is None else found.union(links)
    return found


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = 4,
    bits: int = 4,
    carry: list[str] | None = None,
) -> DataFrame:
    """``docs``, or its columns ``carry``, with ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest key that links reach, the row's own included.
    Equal fingerprints are one class before anything is compared. Null and empty texts
    have fingerprint zero and are linked like any other; null keys stay and count for
    no minimum; repeated rows stay; columns named like the results are replaced.
    """
    docs = without(docs, "component_id", "fingerprint")
    names = docs.columns if carry is None else carry
    thin = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("box"), F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = pinned(with_fingerprint(thin, "text", shingle).drop("text"))
    classes = pinned(rows.groupBy("fingerprint").agg(F.min("id").alias("first")))
    roots = components(linked_fingerprints(classes.select("fingerprint"), bits))
    linked = classes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint")
    smallest = linked.groupBy("root").agg(F.min("first").alias("smallest"))
    reached = roots.join(smallest, "root").select(F.col("node").alias("fingerprint"), "smallest")
    classes = classes.join(reached, "fingerprint", "left").select(
        "fingerprint", F.coalesce("smallest", "first").alias("component_id")
    )
    # rows of a fingerprint that many copies share are spread over sub-keys
    joined = lookup_join(rows, classes, "fingerprint", spread_by="id", floor=HOT_ROWS)
    return joined.select(
        *unboxed(names, "box"),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def first_of_each_group(docs: DataFrame, shingle: int = 4, bits: int = 4) -> DataFrame:
    """One row of each group of near copies, with the columns of ``docs``.

    The row with the smallest id stays; groups are found on ids and fingerprints, and the
    texts travel once, to their ids. Of rows that share the smallest id the one with the
    smallest hash of its columns stays; a group with null ids only keeps one row.
    """
    names = docs.columns
    rows = docs.select(boxed(docs).alias("box"), F.col("doc_id").alias("id"), "text", row_hash(docs).alias("whole"))
    marked = near_duplicates(rows.select("id", "text", "whole"), "id", "text", shingle, bits, carry=["id", "whole"])
    order = F.struct(F.col("id").isNull().alias("none"), "id", "whole")
    group = F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("print"))
    kept = pinned(
        marked.groupBy(group.alias("g"))
        .agg(F.min(order).alias("m"))
        .select(F.col("m.id").alias("kept_id"), F.col("m.whole").alias("kept_whole"))
    )
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("whole") == F.col("kept_whole"))
    found = rows.select("box", "id", "whole").join(kept, same, "left_semi")
    keys = marked.groupBy("id", "whole").count().where("count > 1")
    if not keys.isEmpty():  # rows that are equal in every column
        found = found.dropDuplicates(["id", "whole"])
    return found.select(*unboxed(names, "box"))
