"""Language by writing system."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grievaline.functions.labels import DEFAULT_LANGUAGE

# Unicode script, language code; the order settles equal counts.
SCRIPT_LANGUAGES = [
    ("Devanagari", "hi-IN"),
    ("Latin", "en-IN"),
    ("Bengali", "bn-IN"),
    ("Tamil", "ta-IN"),
    ("Telugu", "te-IN"),
    ("Gujarati", "gu-IN"),
    ("Kannada", "kn-IN"),
    ("Malayalam", "ml-IN"),
    ("Gurmukhi", "pa-IN"),
    ("Oriya", "od-IN"),
    ("Arabic", "ur-IN"),
]


def script_language(text: Column) -> Column:
    """The language whose script has most letters; no known script gives the default.

    Text without any letter outside Latin is settled by two short-circuit tests;
    only the rest pays for a count per script.
    """
    others = "".join(rf"\p{{Is{s}}}" for s, _ in SCRIPT_LANGUAGES if s != "Latin")
    counts = F.array(*[F.regexp_count(text, F.lit(rf"\p{{Is{s}}}")) for s, _ in SCRIPT_LANGUAGES])
    codes = F.array(*[F.lit(code) for _, code in SCRIPT_LANGUAGES])
    # The one-element array binds the counts, so that each is taken once.
    vote = F.transform(
        F.array(counts),
        lambda c: F.get(codes, (F.array_position(c, F.array_max(c)) - 1).cast("int")),
    )[0]
    return (
        F.when(text.isNull(), DEFAULT_LANGUAGE)
        .when(text.rlike(f"[{others}]"), vote)
        .when(text.rlike(r"\p{IsLatin}"), "en-IN")
        .otherwise(DEFAULT_LANGUAGE)
    )
