"""Token ids in ORC: integer run-length stripes, row indexes, Bloom filters on ids."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grievaline.llm.common import kept_in_worker, travels
from grievaline.sources.workdir import new_dir, pinned

travels(__name__)

END_ID = 2
KEPT_PIECES = 400_000
KEPT_BYTES = 64
TEXT_BYTES = 8 << 20
STRIPE_BYTES = 16 << 20
# Texts of these characters are cut by ``piece_starts`` as a byte-level tokenizer cuts them.
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ɏ]*")
# Others are cut by ``word_starts`` and further by the tokenizer. Blanks beyond ASCII may
# join those before them, so texts that have any stay whole.
ODD_BLANKS = re.compile(r"[^\S\t-\r ]")
# Kinds of bytes; one that UTF-8 never has stands for the end of a text.
LETTER, DIGIT, SIGN, BLANK, END = range(5)
TEXT_END = b"\xff"
BLANKS = b"\t\n\v\f\r "
KINDS = bytes(
    END if b == TEXT_END[0]
    else BLANK if b in BLANKS
    else DIGIT if chr(b) in "0123456789"
    else LETTER if b > 127 or chr(b).isalpha()
    else SIGN
    for b in range(256)
)


def byte_letters() -> dict[int, int]:
    """The letters that stand for bytes in a byte-level vocabulary.

    Printable Latin-1 characters stand for themselves, the others for the letters from
    256 on in the order of the bytes.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


def piece_starts(text: bytes) -> np.ndarray:
    """Where a byte-level tokenizer's pieces begin in plain texts, each closed by ``TEXT_END``.

    The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?letters| ?digits| ?signs|\\s+(?!\\S)|\\s+``.
    A run of one kind is a piece; of blanks before a word the last is apart, and if it
    is a space, it begins the word. An apostrophe that begins a piece may be a
    contraction, and what follows that begins another.
    """
    data, kind = np.frombuffer(text, np.uint8), np.frombuffer(text.translate(KINDS), np.uint8)
    start = kind == END
    start[:1] = True
    change = kind[1:] != kind[:-1]
    last = change & (kind[:-1] == BLANK) & (kind[1:] != END)
    start[1:] |= change & ~(last & (data[:-1] == ord(" ")))
    start[:-1] |= last
    quotes = np.flatnonzero(data == ord("'"))
    quotes = quotes[start[quotes]]
    one, two = data[quotes + 1], data[np.minimum(quotes + 2, len(data) - 1)]
    short = np.isin(one, [*b"sdmt"])
    long = ((one == ord("l")) & (two == ord("l"))) | (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")))
    start[quotes[short | long] + 1] = False
    start[quotes[short] + 2] = True
    start[quotes[long] + 3] = True
    return np.flatnonzero(start)


def word_starts(text: bytes) -> np.ndarray:
    """Where the blanks before a word begin in texts, each closed by ``TEXT_END``.

    What ends behind a word and before a blank ends there for a byte-level tokenizer too.
    """
    kind = np.frombuffer(text.translate(KINDS), np.uint8)
    start = kind == END
    start[:1] = True
    start[1:] |= (kind[:-1] == END) | ((kind[1:] == BLANK) & (kind[:-1] != BLANK))
    return np.flatnonzero(start)


def lists_of(rows: Iterable[list[int]]) -> pa.ListArray:
    ids, ends = [], [0]
    for row in rows:
        ids += row
        ends.append(len(ids))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))


class Pieces:
    """Ids of pieces, of which those asked for last are kept, the latest ``size`` in front.

    Pieces come as an Arrow array and are looked up by Arrow's hashing; the ids of those
    that are not held are made. Pieces of over ``KEPT_BYTES`` are not kept. The end of a
    text is held from the start and never goes.
    """

    def __init__(self, size: int):
        self.size = size
        self.held, self.ids = pa.array([TEXT_END], pa.binary()), lists_of([[END_ID]])

    def __call__(self, pieces: pa.BinaryArray, make: Callable[[pa.BinaryArray], pa.ListArray]) -> pa.ListArray:
        met = pa.concat_arrays([self.held, pieces]).dictionary_encode()
        asked = met.indices[len(self.held) :].to_numpy()
        ids = pa.concat_arrays([self.ids, make(met.dictionary[len(self.held) :])])
        used = np.zeros(len(ids), dtype=bool)
        used[0] = used[asked] = True
        short = pc.less_equal(pc.binary_length(met.dictionary), KEPT_BYTES).to_numpy(zero_copy_only=False)
        latest = pa.array(np.concatenate([np.flatnonzero(used & short), np.flatnonzero(~used)])[: self.size])
        self.held, self.ids = met.dictionary.take(latest), ids.take(latest)
        return ids.take(pa.array(asked))


class Encoder:
    """Ids of whole texts by the tokenizers library, which merges a piece when it is new.

    ``Pieces`` keeps the latest pieces, so that a long task forgets the rare ones and not
    those that come again.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        cut = json.loads(self.tokenizer.pre_tokenizer.__getstate__() or "{}") if self.tokenizer.pre_tokenizer else {}
        self.by_pieces = (
            self.tokenizer.normalizer is None
            and self.tokenizer.post_processor is None
            and (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex")) == ("ByteLevel", False, True)
        )
        letters = byte_letters()
        self.shown = np.array([letters.get(b, b) for b in range(256)], dtype="<u4")
        self.pieces = Pieces(KEPT_PIECES)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def merged(self, pieces: pa.BinaryArray) -> pa.ListArray:
        """The ids of pieces that ``piece_starts`` cut."""
        bounds = np.cumsum([0, *pc.binary_length(pieces).to_numpy()]).tolist()
        together = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces), b"")
        shown = self.shown[np.frombuffer(together[0].as_py(), np.uint8)].tobytes().decode("utf-32-le")
        merge = self.model.tokenize
        return lists_of([t.id for t in merge(shown[a:b])] for a, b in zip(bounds, bounds[1:]))

    def encoded(self, words: pa.BinaryArray) -> pa.ListArray:
        """The ids of words with the blanks before them."""
        encode = self.tokenizer.encode
        return lists_of(encode(w.as_py().decode(), add_special_tokens=False).ids for w in words)

    def cut_up(self, texts: list[str], starts_of: Callable, make: Callable) -> list[np.ndarray]:
        data = b"".join([part for t in texts for part in (t.encode(), TEXT_END)])
        starts = starts_of(data)
        bounds = np.append(starts, len(data)).astype(np.int32)
        pieces = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        lists = self.pieces(pieces, make)
        ends = lists.offsets.to_numpy()[1:][np.frombuffer(data, np.uint8)[starts] == TEXT_END[0]]
        return np.split(lists.values.to_numpy(), ends[:-1])

    def of_plain(self, texts: list[str]) -> list[np.ndarray]:
        return self.cut_up(texts, piece_starts, self.merged)

    def of_words(self, texts: list[str]) -> list[np.ndarray]:
        return self.cut_up(texts, word_starts, self.encoded)

    def of_whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.append(np.frombuffer(self.whole(t), dtype="<i4"), np.int32(END_ID)) for t in texts]

    def way(self, text: str) -> Callable[[list[str]], list[np.ndarray]]:
        if not self.by_pieces or (self.special and self.special.search(text)):
            return self.of_whole
        if PLAIN.fullmatch(text):
            return self.of_plain
        return self.of_whole if ODD_BLANKS.search(text) else self.of_words

    def closed(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of every text, the end id behind them."""
        ways, found = [self.way(t) for t in texts], {}
        for way in dict.fromkeys(ways):
            found[way] = iter(way([t for t, w in zip(texts, ways) if w == way]))
        return [next(found[w]) for w in ways]

    def __call__(self, text: str) -> bytes:
        """The ids of one text as little-endian 32-bit integers."""
        return self.closed([text])[0][:-1].tobytes()


def encoder(path: str) -> Encoder:
    """The encoder of this worker process; the tasks that follow share its pieces.

    A worker holds one encoder; another file replaces it.
    """
    return kept_in_worker("encoder", path, lambda: Encoder(path))


def batches_of(column: pa.Array, most: int = TEXT_BYTES) -> Iterator[slice]:
    """Slices of rows whose texts have about ``most`` bytes together, one row at least."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    number = (np.cumsum(lengths) - lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(column)]
    yield from (slice(a, b) for a, b in zip(cuts, cuts[1:]) if b > a)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id") -> None:
    """ORC files of ``key, part, place, ids`` in ascending order of the key.

    Texts are dealt by ranges of the key and encoded in order, so that file ``part``
    holds a range and ``place`` counts the ids before a document inside it. Ids are
    stored in integer run-length stripes; a row index and a Bloom filter on the key let
    a reader skip row groups and stripes.
    """
    ranged = docs.select(key, "text").repartitionByRange(F.col(key).asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col(key).asc_nulls_first(), "text")
    names = [key, "part", "place", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        for whole in batches:
            for rows in batches_of(whole.column(1).cast(pa.binary())):
                batch = whole.slice(rows.start, rows.stop - rows.start)
                texts = [(t.as_py() or b"").decode("utf-8", "replace") for t in batch.column(1).cast(pa.binary())]
                ids = encode.closed(texts)
                ends = np.cumsum([0, *map(len, ids)])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(np.full(batch.num_rows, part, dtype=np.int32)),
                        pa.array(before + ends[:-1]),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(ids))),
                    ],
                    names=names,
                )
                before += int(ends[-1])

    kind = docs.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField(key, kind),
            T.StructField("part", T.IntegerType()),
            T.StructField("place", T.LongType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
        ]
    )
    (
        ranged.mapInArrow(run, schema)
        .write.option("orc.bloom.filter.columns", key)
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("compression", "zstd")
        .orc(path)
    )


def read_tokens(spark, path: str, keys: list | None = None, key: str = "doc_id") -> DataFrame:
    """The stored rows; stripes are read in parallel, ``keys`` prunes by the metadata."""
    stored = spark.read.orc(path)
    return stored if keys is None else stored.where(F.col(key).isin(keys))


def token_rows(stored: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, start, n_tokens, ids_crc32`` of stored rows, from the files alone.

    ``start`` counts the ids of all documents before: the place in the part and the sum
    of the parts before, one row per file.
    """

    def checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets = np.asarray(lists.offsets)
            values = np.asarray(lists.values).astype("<i4")
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())],
                names=[key, "part", "place", "n_tokens", "ids_crc32"],
            )

    kind = stored.schema[key].dataType.simpleString()
    read = stored.select(key, "part", "place", "ids").mapInArrow(
        checks, f"`{key}` {kind}, part int, place long, n_tokens long, ids_crc32 long"
    )
    rows = pinned(read)  # short rows; the files are read once
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("before"))
    return rows.join(before, "part").select(
        key, (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write ``docs (doc_id, text)`` and report what the files hold.

    Null and empty texts are the end id alone, null ids come first, equal ids follow
    each other by text, an empty table gives no rows, other columns are left out.
    """
    spark = docs.sparkSession
    path = new_dir(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return token_rows(spark.read.schema("doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", part int, place long, ids array<int>").orc(path))
