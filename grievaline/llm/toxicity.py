"""Toxicity by a weighted lexicon that is matched in folded text."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grievaline.llm.common import per_text, pinned, travels, unboxed, without

travels(__name__)

SAMPLE_TOXIC = 8_000  # labelled rows that the model may be fitted on, per label
SAMPLE_CLEAN = 16_000
TERMS_AT_ONCE = 1 << 18  # counted terms that a task holds before it hands them on
MIN_ROWS = 5  # toxic rows that hold a term, whatever the size of the sample
MIN_ODDS = 1.5  # log odds, less their standard error
SURE_ODDS = 5.0  # from here on a word also counts with marks on its letters
PREFIXES = (4, 5, 6, 7, 8, 9)
# Letters of other scripts, digits and signs that stand in for a letter.
HOMOGLYPHS = dict(
    zip(
        "аеоріѕсхукмтвнјԁɡαεορικνυχτβγł0134578@$!|",
        "aeopiscxykmtbhjdgaeopiknuxtbyloieastbasil",
    )
)
# Terms and phrases that hold before anything is learned.
SEED_TERMS = ("idiot", "moron", "stupid", "scum", "loser", "worthless", "pathetic", "disgusting")
SEED_EXCEPTIONS = ("trash can", "trash cans", "trash bin", "clown fish", "idiot proof", "idiot light")
SEED_WEIGHT = 6.0


@dataclass
class Model:
    """Term weights (``" term "`` whole words, ``" term"`` beginnings), exceptions, threshold."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    threshold: float = 0.6


class Folder:
    """Folds case, homoglyphs and stand-ins, with and without the marks of letters."""

    def __init__(self):
        # per code point of the basic plane its folded letter, or a blank
        self.marked = np.full(1 << 16, ord(" "), dtype="<u4")
        self.plain = self.marked.copy()
        for code in range(1 << 16):
            char = chr(code)
            if char.isalpha():
                low = char.lower()[0]
                low = HOMOGLYPHS.get(low, low)
                base = unicodedata.normalize("NFKD", low)[0]
                self.marked[code], self.plain[code] = ord(low), ord(HOMOGLYPHS.get(base, base))
        self.signs = {ord(k): ord(v) for k, v in HOMOGLYPHS.items() if not k.isalpha()}

    def _fold(self, codes: np.ndarray, table: np.ndarray) -> str:
        near = codes < table.size
        out = np.full(codes.size + 2, ord(" "), dtype="<u4")
        out[1:-1][near] = table[codes[near]]
        letter = out != ord(" ")
        beside = (letter[:-2] | letter[2:]) & ~letter[1:-1]
        for sign, stands in self.signs.items():
            out[1:-1][beside & (codes == sign)] = stands
        return out.tobytes().decode("utf-32-le", "surrogatepass")

    def both(self, text: str) -> tuple[str, str]:
        """Folded letters between blanks, with marks and without, at the same places.

        A digit or sign counts as the letter it stands for next to a letter.
        """
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        return self._fold(codes, self.marked), self._fold(codes, self.plain)

    def __call__(self, text: str) -> str:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        return self._fold(codes, self.marked)


def candidates(folded: str) -> set[str]:
    """The distinct words of a folded text as terms, whole and by their beginnings."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {" " + w[:k] for w in words for k in PREFIXES if len(w) > k}


class Matcher:
    """Aho-Corasick over the terms and the exception phrases of a model."""

    def __init__(self, model: Model):
        self.folder = Folder()
        self.machine = ahocorasick.Automaton()
        for term, weight in model.weights.items():
            self.machine.add_word(term, (len(term), weight))
        for phrase in model.exceptions:
            self.machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(self.machine):
            self.machine.make_automaton()

    def matches(self, folded: str, plain: str | None = None) -> list[tuple[int, int, float]]:
        """``start, end, weight``; the strongest term of a word, none in an exception phrase.

        In the text without marks only whole words of sure weight count.
        """
        if not len(self.machine):
            return []
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        for text in (folded, plain) if plain not in (None, folded) else (folded,):
            for last, (size, weight) in self.machine.iter(text):
                start = last + 1 - size
                if weight is None:
                    spared.append((start, last))
                elif text is plain and (weight < SURE_ODDS or text[last] != " "):
                    continue
                elif start not in best or weight > best[start][1]:
                    best[start] = (last, weight)
        inside = {p for a, b in spared for p in range(a, b)}
        return [(s, e, w) for s, (e, w) in best.items() if s not in inside]

    def strength(self, text: str) -> float:
        """Weight of what matches over the square root of the number of words."""
        folded, plain = self.folder.both(text)
        found = self.matches(folded, plain)
        return sum(w for *_, w in found) / math.sqrt(len(folded.split()) + 1) if found else 0.0


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``text, toxic`` of at most about the sample bounds, picked by a hash of the id."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    learnable = known.where(~held_out())
    sizes = {r["toxic"]: r["count"] for r in learnable.groupBy("toxic").count().where("toxic in (0, 1)").collect()}
    steps = 1 << 20
    clean = min(steps, SAMPLE_CLEAN * steps // max(1, sizes.get(0, 0)))
    toxic = min(steps, SAMPLE_TOXIC * steps // max(1, sizes.get(1, 0)))
    share = F.when(F.col("toxic") == 1, toxic).when(F.col("toxic") == 0, clean).otherwise(0)
    picked = learnable.where(F.pmod(F.xxhash64("doc_id"), F.lit(steps)) < share)
    # bounded by the sample sizes, so that no text is shuffled
    return docs.where("text is not null").join(F.broadcast(picked), "doc_id").select("text", "toxic")


def _counted(sample: DataFrame, terms_of) -> DataFrame:
    """``term, t, c``: how many toxic and clean texts of the sample hold each term.

    Counts are added up per task before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = terms_of()
        held: tuple[Counter, Counter] = Counter(), Counter()

        def counts() -> pa.RecordBatch:
            pairs = [(term, x, n) for x in (0, 1) for term, n in held[x].items()]
            columns = zip((pa.string(), pa.int32(), pa.int64()), zip(*pairs) if pairs else ((), (), ()))
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for kind, c in columns], names=["term", "toxic", "n"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                held[toxic].update(one(text.as_py()))
                if len(held[0]) + len(held[1]) > TERMS_AT_ONCE:
                    yield counts()
                    held = Counter(), Counter()
        yield counts()

    of = [F.sum(F.when(F.col("toxic") == x, F.col("n")).otherwise(0)).alias(name) for x, name in ((1, "t"), (0, "c"))]
    return sample.mapInArrow(run, "term string, toxic int, n long").groupBy("term").agg(*of)


def _odds(n_toxic: int, n_clean: int) -> Column:
    """Log odds of a row of counts ``t, c``."""
    return F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))


def _sure_odds(n_toxic: int, n_clean: int) -> Column:
    """Log odds less one standard error."""
    return _odds(n_toxic, n_clean) - F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))


def _needed(weights: dict[str, float]) -> dict[str, float]:
    """``weights`` without the terms that a beginning of theirs outweighs at every place.

    A sure whole word stays, since it also counts with marks on its letters.
    """

    def outweighed(term: str, weight: float) -> bool:
        if term.endswith(" ") and weight >= SURE_ODDS:
            return False
        return any(weights.get(term[: k + 1], -math.inf) >= weight for k in PREFIXES if k + 1 < len(term))

    return {t: w for t, w in weights.items() if not outweighed(t, w)}


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Lexicon, exceptions and threshold from labelled rows that are not held out.

    A term is a word or the beginning of words. Its log odds less their standard error
    are its weight and decide alone, above a few toxic rows that do not grow with the
    sample: a language with few of the toxic rows keeps its terms. Odds are computed
    before anything is collected, so that no term is cut by its frequency. A pair of a term and
    its neighbour that marks clean rows is an exception. The threshold parts the sample's strengths with the fewest errors.
    Without labelled rows of both kinds the seed terms and a fixed threshold hold.
    """
    seeds = {f" {t} ": SEED_WEIGHT for t in SEED_TERMS}
    sample = pinned(labelled_sample(docs, labels).select("text", F.col("toxic").cast("int").alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Model(seeds, list(SEED_EXCEPTIONS))

    def words():
        folder = Folder()
        return lambda text: candidates(folder(text))

    counted = _counted(sample, words).where(F.col("t") >= MIN_ROWS)
    sure = counted.select("term", _sure_odds(n_toxic, n_clean).alias("odds")).where(F.col("odds") > MIN_ODDS)
    weights = _needed(seeds | {r["term"]: r["odds"] for r in sure.orderBy(F.desc("odds"), "term").collect()})
    model = Model(weights, list(SEED_EXCEPTIONS))
    model.exceptions += _exceptions(sample, model, n_toxic, n_clean)
    model.threshold = _threshold(sample, model)
    return model


def _exceptions(sample: DataFrame, model: Model, n_toxic: int, n_clean: int, least: int = 5) -> list[str]:
    def pairs():
        matcher = Matcher(model)

        def one(text: str) -> set[str]:
            folded = matcher.folder(text)
            found = set()
            for start, _, _ in matcher.matches(folded):
                before = folded[max(0, start - 60) : start + 1].split()
                after = folded[start : start + 120].split()[:2]
                if before:
                    found.add(f"{before[-1]} {after[0]}")
                if len(after) == 2:
                    found.add(" ".join(after))
            return found

        return one

    counted = _counted(sample, pairs).where((F.col("c") >= least) & (_odds(n_toxic, n_clean) < -1))
    return [r["term"] for r in counted.orderBy(F.desc("c"), "term").collect()]


def _threshold(sample: DataFrame, model: Model) -> float:
    rows = with_strength(sample, model).groupBy("strength").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    ordered = sorted((r["strength"], r["t"], r["n"] - r["t"]) for r in rows.collect())
    below = sum(t for _, t, _ in ordered)  # errors of a threshold above all: every toxic row
    toxic, clean = 0, sum(c for *_, c in ordered)
    errors, best = [], math.inf
    for i, (strength, t, c) in enumerate(ordered[:-1]):
        toxic, clean = toxic + t, clean - c
        middle = (strength + ordered[i + 1][0]) / 2
        if toxic + clean < best:
            best, errors = toxic + clean, []
        if toxic + clean == best:
            errors.append(middle)
    return float(np.median(errors)) if errors and best < below else Model().threshold


def with_strength(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    def make():
        matcher = Matcher(model)
        return lambda value: (matcher.strength((value or b"").decode("utf-8", "replace")),)

    return per_text(docs, text, [T.StructField("strength", T.DoubleType())], make)


def toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    The score is logistic in the strength and is 0.5 at the threshold. Only the whole
    text is read; null and empty texts and texts without a match have the lowest score.
    Columns named like the results are replaced; repeated rows stay.
    """
    names = without(docs, "score", "predicted").columns
    others = [c for c in names if c != text]
    box = F.struct(F.lit(0).alias("c"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)])
    scored = with_strength(docs.select(box.alias("box"), F.col(f"`{text}`").alias("text")), model, "text")
    score = 1 / (1 + F.exp((F.lit(model.threshold) - F.col("strength")) * F.lit(4.0 / model.threshold)))
    back = dict(zip(others, unboxed(others, "box"))) | {text: F.col("text").alias(text)}
    return scored.select(*[back[c] for c in names], score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def held_out() -> Column:
    """Whether a document is kept out of learning: crc32 of its id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
