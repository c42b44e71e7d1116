"""Token counts by looking pre-tokens up in two tiers on the map side."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grievaline.llm.common import Recent, kept_in_worker, per_batch, travels
from grievaline.llm.orc_tokens import byte_letters

travels(__name__)

TABLE_ENTRIES = 1 << 16
TABLE_CHARS = 32
TASK_ENTRIES = 1 << 13
TASK_DISTINCT = 1 << 18
KEPT = 250_000
# Behind lower-casing, the pre-tokens of a text of these characters are the ones that the
# tokenizer cuts itself. Words with other characters go to the tokenizer as they are.
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ɏ]*")
CUTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ɏ]+|[0-9]|[^\sa-zß-öø-ɏ0-9]+")
# The normalizer and the cutting that this rule stands for, as the tokenizer file has them.
NORMALIZER = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

FIELDS = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("over_limit", T.BooleanType()),
]


class Lengths:
    """Token counts of pre-tokens, and of whole words that are no plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.by_pieces = self.cuts_like_this(path)
        self.letters = byte_letters()
        self.pieces, self.words = Recent(KEPT, self.of_piece), Recent(KEPT // 8, self.whole)

    @staticmethod
    def cuts_like_this(path: str) -> bool:
        import json

        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        cut = (said["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        return (
            [n["type"] for n in (said["normalizer"] or {}).get("normalizers", [])] == NORMALIZER
            and [c.get("type") for c in cut] == ["Split", "ByteLevel"]
            and cut[0]["pattern"].get("Regex") == PATTERN
            and said["post_processor"] is None
        )

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False))

    def of_piece(self, piece: str) -> int:
        return len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not (self.special and self.special.search(text))

    def count(self, text: str, table: dict[str, int]) -> int:
        """Tokens of a whole text: the table first, then the worker's cache, then the model."""
        if not self.by_pieces:
            return self.whole(text)
        if self.plain(text):
            return self.of_plain(text, table)
        # ASCII blanks end pre-tokens and special strings, so words may be counted apart
        words = [w.decode() for w in text.encode().split()]
        apart = [w for w in words if not self.plain(w)]
        rest = " ".join(w for w in words if self.plain(w))
        return self.of_plain(rest, table) + sum(map(self.words.__getitem__, apart))

    @staticmethod
    def of_plain(text: str, table: dict[str, int]) -> int:
        return sum(map(table.__getitem__, CUTS.findall(text.lower())))


class Tiers(dict):
    """The table of frequent pre-tokens, behind it the worker's cache; the table does not grow."""

    def __init__(self, frequent: dict[str, int], cache: Recent):
        super().__init__(frequent)
        self.cache = cache

    def __missing__(self, piece: str) -> int:
        return self.cache[piece]


def lengths(path: str) -> Lengths:
    """The tokenizer and the caches of this worker; one file's at a time."""
    return kept_in_worker("lengths", path, lambda: Lengths(path))


def summaries(docs: DataFrame, text: str = "text") -> DataFrame:
    """``piece, n``: the most frequent pre-tokens of every task, counts from below.

    A task counts over all its texts. When it holds ``TASK_DISTINCT`` pre-tokens, those
    below the median go and the others lose the median, so memory is bounded; it gives
    at most ``TASK_ENTRIES`` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()):
                if value.is_valid:
                    counts.update(CUTS.findall(value.as_py().decode("utf-8", "replace").lower()))
                if len(counts) > TASK_DISTINCT:
                    middle = sorted(counts.values())[len(counts) // 2]
                    counts = Counter({p: n - middle for p, n in counts.items() if n > middle})
        top = [(p, n) for p, n in counts.most_common(TASK_ENTRIES) if len(p) <= TABLE_CHARS]
        yield pa.RecordBatch.from_pydict(
            {"piece": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())}
        )

    return docs.select(text).mapInArrow(run, "piece string, n long")


def frequent_lengths(docs: DataFrame, tokenizer: str, text: str = "text", entries: int = TABLE_ENTRIES) -> dict[str, int]:
    """Token counts of the corpus' most frequent pre-tokens.

    Texts are counted where they are read; only the summaries are added up by Spark. The
    table has at most ``entries`` keys of at most ``TABLE_CHARS`` characters, which
    bounds what is collected and broadcast to some megabytes.
    """
    added = summaries(docs, text).groupBy("piece").agg(F.sum("n").alias("n"))
    top = added.orderBy(F.desc("n"), "piece").limit(entries).select("piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lengths(tokenizer)
        for batch in batches:
            n = [known.of_piece(p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32())], names=["piece", "n"])

    return {r["piece"]: r["n"] for r in top.mapInArrow(run, "piece string, n int").collect()}


def count_tokens(docs: DataFrame, tokenizer: str, text: str = "text", limit: int = 2048, entries: int = TABLE_ENTRIES, carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit`` of every whole text.

    Counts are those of the tokenizers library without added special tokens, truncation
    or padding. Each task looks pre-tokens up in the broadcast table of frequent ones,
    what is not there in the worker's bounded cache, and runs the model for the rest;
    pre-tokens of texts are never shuffled. Tokenizer files whose cutting is another one
    than ``PATTERN`` are counted by the library on whole texts. A null or empty text has
    0 bytes and 0 tokens, rows are kept one by one, an empty table gives no rows, and
    columns named like the three results give way to them; with ``carry`` only those
    columns come back.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_lengths(docs, tokenizer, text, entries))

    def make():
        known = lengths(tokenizer)
        tiers = Tiers(table.value, known.pieces)

        def several(batch: pa.RecordBatch) -> list[list]:
            texts = [t.as_py() or b"" for t in batch.column(0).cast(pa.binary())]
            counts = [known.count(t.decode("utf-8", "replace"), tiers) for t in texts]
            return [[len(t) for t in texts], counts, [n > limit for n in counts]]

        return several

    return per_batch(docs, FIELDS, make, [text], carry)
