"""Language identification with hyperdimensional letter-trigram profiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grievaline.llm.common import per_text, travels

travels(__name__)

DIMENSIONS = 1024
SAMPLE_PER_LANGUAGE = 4000
MAX_LANGUAGES = 1000
UNDETERMINED = "und"
PIECE = 1 << 16
KEPT_LETTERS = 20_000
KEPT_GRAMS = 1 << 14
PART = 2048


class Bundler:
    """Turns whole texts into hypervectors; one per task, with its letter vectors."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.vectors: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.matrix = np.zeros((KEPT_GRAMS, dimensions), dtype=np.int8)
        self.lower = np.zeros(1 << 16, dtype=np.uint32)  # 0: no letter
        for code in range(1 << 16):
            if chr(code).isalpha():
                low = chr(code).lower()
                self.lower[code] = ord(low) if len(low) == 1 else code

    def letter(self, code: int) -> np.ndarray:
        """The random +1/-1 vector of a code point; 0 stands for the edge of a word."""
        found = self.vectors.get(code)
        if found is None:
            if len(self.vectors) >= KEPT_LETTERS:
                self.vectors.clear()
            random = np.random.default_rng([code, self.dimensions])
            found = random.integers(0, 2, self.dimensions, dtype=np.int8) * np.int8(2) - np.int8(1)
            self.vectors[code] = found
        return found

    def letters(self, text: str) -> np.ndarray:
        """Lower-cased letters by code point, 0 for every other character."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        far = codes >= self.lower.size
        found = self.lower[np.where(far, 0, codes)]
        if far.any():
            found[far] = [c if chr(c).isalpha() else 0 for c in codes[far].tolist()]
        return found

    def trigrams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct letter trigrams of a whole text, edges of words included, with counts.

        A trigram is one integer of three 21-bit code points. A run of other characters
        is one edge. Very long texts are read in pieces that overlap by two letters.
        """
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        tail = np.zeros(1, dtype=np.uint32)
        for at in range(0, len(text), PIECE):
            end = [0] if at + PIECE >= len(text) else []
            run = np.concatenate([tail, self.letters(text[at : at + PIECE]), np.array(end, np.uint32)])
            edge = run == 0
            keep = np.ones(run.size, dtype=bool)
            keep[1:] = ~(edge[1:] & edge[:-1])
            run = run[keep].astype(np.uint64)
            if run.size >= 3:
                a, b, c = run[:-2], run[1:-1], run[2:]
                grams = (a << np.uint64(42) | b << np.uint64(21) | c)[b > 0]
                key, count = np.unique(grams, return_counts=True)
                keys.append(key)
                counts.append(count)
            tail = run[-2:].astype(np.uint32)
        if not keys:
            return np.zeros(0, np.uint64), np.zeros(0)
        if len(keys) == 1:
            return keys[0], counts[0]
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(place, np.concatenate(counts))

    def bound(self, keys: np.ndarray) -> np.ndarray:
        """The vectors of n-grams: permuted letter vectors, multiplied.

        The first letter is rotated by two places, the second by one.
        """
        made = None
        mask = np.uint64((1 << 21) - 1)
        for shift, turn in ((42, 2), (21, 1), (0, 0)):
            codes, place = np.unique((keys >> np.uint64(shift)) & mask, return_inverse=True)
            rows = np.stack([np.roll(self.letter(int(c)), turn) for c in codes])[place]
            made = rows if made is None else np.multiply(made, rows, out=rows)
        return made

    def bundle(self, text: str) -> np.ndarray:
        """Sum of the n-gram vectors of a text; no letters give the zero vector.

        Counts enter by their square root, so that one repeated word does not fill the
        bundle. Vectors of n-grams are kept between texts up to ``KEPT_GRAMS``.
        """
        keys, counts = self.trigrams(text)
        weights = np.sqrt(counts).astype(np.float32)
        total = np.zeros(self.dimensions, dtype=np.float32)
        for at in range(0, keys.size, PART):
            part = keys[at : at + PART].tolist()
            new = [k for k in part if k not in self.rows]
            if len(self.rows) + len(new) > KEPT_GRAMS:
                self.rows.clear()
                new = part
            if new:
                first = len(self.rows)
                self.matrix[first : first + len(new)] = self.bound(np.array(new, dtype=np.uint64))
                self.rows.update(zip(new, range(first, first + len(new))))
            places = [self.rows[k] for k in part]
            total += weights[at : at + PART] @ self.matrix[places].astype(np.float32)
        return total


def _unit(vector: np.ndarray) -> np.ndarray:
    size = float(np.linalg.norm(vector))
    return vector / size if size else vector


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, list[float]]:
    """Language prototypes: the bundled unit vectors of each language's documents.

    Of each language about ``SAMPLE_PER_LANGUAGE`` different texts are taken, by a hash of
    the text, or all where there are fewer; that bound is the model's, every text of the
    sample is read whole. Copies of a text count once, in the share that is drawn too, so
    a text that fills a third of the rows is one of the sample. Sums are
    added up per task and language before the shuffle; the driver gets one vector per
    language, at most ``MAX_LANGUAGES`` of them (more is an error). Null text or
    language teaches nothing. What all languages share, the mean prototype, is taken
    off each one.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text")
    )
    hashed = known.withColumn("h", F.xxhash64("text"))
    different = hashed.select("lang", "h").distinct()
    sizes = different.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not sizes:
        return {}
    steps = 1 << 20
    parts = {r["lang"]: min(steps, SAMPLE_PER_LANGUAGE * steps // r["count"] + 1) for r in sizes}
    share = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])[F.col("lang")]
    drawn = hashed.where(F.pmod("h", F.lit(steps)) < share)
    sample = drawn.dropDuplicates(["lang", "h"]).select("lang", "text")

    def sums(batches):
        import pyarrow as pa

        bundler = Bundler()
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                unit = _unit(bundler.bundle(value.as_py()))
                held[name] = held[name] + unit if name in held else unit
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([v.astype(float).tolist() for v in held.values()], pa.list_(pa.float64()))],
            names=["lang", "sums"],
        )

    added = (
        sample.mapInArrow(sums, "lang string, sums array<double>")
        .select("lang", F.posexplode("sums").alias("i", "x"))
        .groupBy("lang", "i")
        .agg(F.sum("x").alias("x"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    )
    rows = added.select("lang", "v.x").collect()
    units = {r["lang"]: _unit(np.array(r["x"])) for r in rows}
    middle = np.mean(list(units.values()), axis=0) if len(units) > 1 else 0.0
    return {name: _unit(v - middle).round(9).tolist() for name, v in sorted(units.items())}


def identify(docs: DataFrame, prototypes: dict[str, list[float]], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the cosine with the nearest prototype.

    Only the text is read, and all of it. A null text, one without a letter, or no
    prototypes at all give ``und`` and 0. A cosine below 0 counts as 0. Ties go to the
    language that is first by name. Columns named like the results are replaced.
    """
    names = sorted(prototypes)

    def make():
        bundler = Bundler()
        matrix = np.array([prototypes[n] for n in names], dtype=np.float32)

        def one(value: bytes | None) -> tuple[str, float]:
            if value is None or not names:
                return UNDETERMINED, 0.0
            vector = bundler.bundle(value.decode("utf-8", "replace"))
            size = float(np.linalg.norm(vector))
            if not size:
                return UNDETERMINED, 0.0
            close = matrix @ vector
            best = int(close.argmax())
            return names[best], min(1.0, max(0.0, float(close[best]) / size))

        return one

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return per_text(docs, text, fields, make)


def held_out() -> Column:
    """Whether a document is kept out of learning: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language can be told, with their own columns.

    Rejected are null texts, texts without a letter, and, where no language could be
    learned, all.
    """
    names = docs.columns
    boxed = docs.select(F.col("text").alias("_t"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]).alias("_d"))
    prototypes = learn(docs.where(~held_out()))
    found = identify(boxed, prototypes, "_t").where(F.col("lang_pred") != UNDETERMINED)
    return found.select([F.col(f"_d.c{i}").alias(c) for i, c in enumerate(names)])
