"""Periodic runs of words, and texts without the repeats.

The lag diagonals of a text are followed from left to right: the earlier occurrence of
what stands at a word keeps the diagonal of that lag active and adds one to its match
length, another lag ends it, and an ended diagonal that is long enough is a run. Taken
word by word, a frequent word would open a diagonal to each of its earlier places, which
grows with the square of the text. Only diagonals that can still become a run are opened:

* a run of period p has at least ``max(min_length - p, 2 p)`` matches on its diagonal, so
  its words also match together with the ``width - 1`` words behind them, for any width
  up to that number;
* where ``p <= width``, the *nearest* earlier place of the same ``width`` words is at lag
  p for every place in the run behind its first period. A nearer one, at lag r, would
  give the run the period gcd(p, r).

So the words are followed at doubling widths, a width looks after the periods between its
half and itself, and a place has one active lag per width. Places whose words do not
occur twice at a width have no diagonal there nor at any greater one, so they are left
out. Work is the words times the logarithm of the longest repeat, memory is linear.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grievaline.llm.common import per_batch, travels

travels(__name__)

MIN_LENGTH = 24
MIN_EXPONENT = 3
WORDS_AT_ONCE = 1 << 20

FIELDS = [T.StructField(n, T.LongType()) for n in ("n_runs", "start", "length", "period", "exponent_milli")] + [
    T.StructField("runs_sha256", T.StringType()),
    T.StructField("collapsed_sha256", T.StringType()),
]


def same_places(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ascending places with keys: ``(place, rank, lag)`` where the key occurs twice.

    The rank numbers the keys; the lag leads to the nearest earlier place of the same
    key and is 0 at the first one.
    """
    order = np.argsort(keys, kind="stable")
    keys, places = keys[order], places[order]
    again = np.zeros(len(keys), dtype=bool)
    again[1:] = keys[1:] == keys[:-1]
    twice = again.copy()
    twice[:-1] |= again[1:]
    lag = np.zeros(len(keys), dtype=np.int64)
    lag[1:] = np.where(again[1:], np.diff(places), 0)
    rank = np.cumsum(~again)
    places, rank, lag = places[twice], rank[twice], lag[twice]
    back = np.argsort(places, kind="stable")
    return places[back], rank[back], lag[back]


def diagonals(places: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(first place, lag, number of places)`` of stretches that keep one lag."""
    goes_on = (np.diff(places) == 1) & (np.diff(lag) == 0)
    first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    return places[first], lag[first], np.diff(np.append(first, len(places)))


def find_runs(words: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows ``start, length, period`` of all runs in the numbers of a text's words.

    Texts may be put together if they share no number. The period is the smallest one,
    no neighbour extends a run, and a run is at least ``min_length`` words and
    ``min_exponent`` periods long, 3 or more.
    """
    if min_exponent < 3:
        raise ValueError("a run has at least three periods")
    n, width = len(words), 1
    ranks = np.full(n, -1, dtype=np.int64)
    places, rank, lag = same_places(words.astype(np.int64), np.arange(n))
    first_width = max(1 << (max(2 * min_length // 3, 1)).bit_length() - 1, 1)
    found = []
    while len(places):
        if width >= first_width:
            at_home = (lag > (width // 2 if width > first_width else 0)) & (lag <= width)
            if at_home.any():
                start, period, matches = diagonals(places[at_home], lag[at_home])
                length = matches + width - 1 + period
                long = length >= np.maximum(min_length, min_exponent * period)
                found.append(np.stack([start - period, length, period], axis=1)[long])
        ranks[:] = -1
        ranks[places] = rank
        inside = places + width < n
        places, rank = places[inside], rank[inside]
        behind = ranks[places + width]
        both = behind >= 0
        keys = rank[both] * (n + 1) + behind[both]
        places, rank, lag = same_places(keys, places[both])
        width *= 2
    runs = np.concatenate(found) if found else np.zeros((0, 3), dtype=np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay: all but those behind the first period of a run."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:n]) == 0


def runs_of_texts(texts: list[list[bytes]], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[np.ndarray]:
    """The runs of each text; texts go together up to ``WORDS_AT_ONCE`` words."""
    found: list[np.ndarray] = []
    numbers: list[np.ndarray] = []
    before = 0

    def finish() -> None:
        ends = np.cumsum([len(x) for x in numbers])
        runs = find_runs(np.concatenate(numbers), min_length, min_exponent)
        owner = np.searchsorted(ends, runs[:, 0], side="right")
        cut = np.searchsorted(owner, np.arange(len(numbers) + 1))
        for i, x in enumerate(numbers):
            own = runs[cut[i] : cut[i + 1]].copy()
            own[:, 0] -= ends[i] - len(x)
            found.append(own)
        numbers.clear()

    for words in texts:
        if numbers and before + len(words) > WORDS_AT_ONCE:
            finish()
            before = 0
        number: dict[bytes, int] = {}
        numbers.append(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64) + before)
        before += len(words)
    if numbers:
        finish()
    return found


def summary(words: list[bytes], runs: np.ndarray) -> tuple:
    """The values of ``FIELDS`` for one text."""
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs.tolist())
    kept = words
    best: tuple = (None,) * 4
    if len(runs):
        kept = [w for w, k in zip(words, kept_words(len(words), runs).tolist()) if k]
        s, m, p = max(runs.tolist(), key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        best = (s, m, p, 1000 * m // p)
    return len(runs), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()


def _words(batch: pa.RecordBatch, prepare: Callable | None) -> list[list[bytes]]:
    texts = [(t.as_py() or b"").split() for t in batch.column(0).cast(pa.binary())]
    if prepare is None:
        return texts
    return [prepare(key, words) for key, words in zip(batch.column(1).to_pylist(), texts)]


def periodic_runs(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    min_length: int = MIN_LENGTH,
    min_exponent: int = MIN_EXPONENT,
    prepare: Callable[[object, list[bytes]], list[bytes]] | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """``docs`` with the runs of every whole text, summed up in the columns of ``FIELDS``.

    ``start, length, period, exponent_milli`` tell the run with the greatest length per
    period, ties by start, then period; the digests are of all runs and of the words that
    stay. Words are what ASCII blanks separate. ``prepare`` may change a text's words by
    its key first. A null or empty text has no runs: four nulls and the digests of
    nothing. Rows are taken one by one, an empty table gives no rows, columns that bear
    a result's name give way to it; with ``carry`` only those columns come back. Nothing is
    shuffled.
    """

    def make():
        def several(batch: pa.RecordBatch) -> list[list]:
            texts = _words(batch, prepare)
            rows = [summary(w, r) for w, r in zip(texts, runs_of_texts(texts, min_length, min_exponent))]
            return [list(c) for c in zip(*rows)]

        return several

    return per_batch(docs, FIELDS, make, [text, key], carry)


def collapse(docs: DataFrame, text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``docs`` with texts that keep the first period of every run.

    A text with a run is its words that stay, joined by one blank; all others, nulls
    too, and all other columns come back as they are.
    """
    names = docs.columns

    def make():
        def several(batch: pa.RecordBatch) -> list[list]:
            texts = _words(batch, None)
            runs = runs_of_texts(texts, min_length, min_exponent)
            made = []
            for old, words, found in zip(batch.column(0).cast(pa.binary()), texts, runs):
                if len(found):
                    keep = kept_words(len(words), found).tolist()
                    made.append(b" ".join(w for w, k in zip(words, keep) if k))
                else:
                    made.append(old.as_py())
            return [made]

        return several

    others = F.struct(*[docs[f"`{c}`"] for c in names if c != text]) if len(names) > 1 else F.lit(None)
    boxed = docs.select(others.alias("others"), F.col(f"`{text}`").alias("text"))
    found = per_batch(boxed, [T.StructField("new", T.BinaryType())], make, ["text"], ["others"])
    return found.select(
        *[F.col("new").cast("string").alias(c) if c == text else F.col("others").getField(c).alias(c) for c in names]
    )
