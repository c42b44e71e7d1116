"""Fixed label tables and lookups on them."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Issue keys and their labels.
ISSUE_LABELS = {
    "delay": "Train Delay",
    "food": "Food/Catering Quality",
    "cleanliness": "Coach Cleanliness",
    "staff": "Staff Misconduct/Behaviour",
    "safety": "Security/Safety Concern",
    "medical": "Medical Assistance Required",
    "water": "Water Availability",
    "electricity": "Electrical Fittings",
    "bedroll": "Bedroll/Linen Complaint",
    "other": "General Grievance",
}
# Language codes and their labels.
LANGUAGE_LABELS = {
    "hi-IN": "Hindi",
    "ta-IN": "Tamil",
    "bn-IN": "Bengali",
    "te-IN": "Telugu",
    "mr-IN": "Marathi",
    "gu-IN": "Gujarati",
    "kn-IN": "Kannada",
    "ml-IN": "Malayalam",
    "pa-IN": "Punjabi",
    "od-IN": "Odia",
    "as-IN": "Assamese",
    "ur-IN": "Urdu",
    "en-IN": "English",
}
# Short code, reply language, script of the reply.
REPLY_LANGUAGES = {
    "en": ("English", "Latin"),
    "hi": ("Hindi", "Devanagari"),
    "bn": ("Bengali", "Bengali"),
    "ta": ("Tamil", "Tamil"),
    "te": ("Telugu", "Telugu"),
    "mr": ("Marathi", "Devanagari"),
    "gu": ("Gujarati", "Gujarati"),
    "kn": ("Kannada", "Kannada"),
    "ml": ("Malayalam", "Malayalam"),
    "pa": ("Punjabi", "Gurmukhi"),
}
GENERAL = "General Grievance"
DEFAULT_LANGUAGE = "hi-IN"


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value for ``key`` or null; the table is a constant of the plan, no join."""
    entries = F.create_map(*[F.lit(x) for x in chain(*table.items())])
    return F.try_element_at(entries, key)


def issue_label(key: Column, unknown: Column) -> Column:
    return F.coalesce(lookup(ISSUE_LABELS, key), unknown)


def language_label(code: Column) -> Column:
    return F.coalesce(lookup(LANGUAGE_LABELS, code), code)


def region_code(short: Column, default: str = "en-IN") -> Column:
    """``hi`` to ``hi-IN`` for the known short codes, in any case."""
    known = {code: f"{code}-IN" for code in REPLY_LANGUAGES}
    return F.coalesce(lookup(known, F.lower(F.coalesce(short, F.lit("")))), F.lit(default))


def reply_language(short: Column) -> Column:
    names = {code: name for code, (name, _) in REPLY_LANGUAGES.items()}
    return F.coalesce(lookup(names, F.lower(filled_code(short))), F.lit("English"))


def reply_script(short: Column) -> Column:
    scripts = {code: script for code, (_, script) in REPLY_LANGUAGES.items()}
    return F.coalesce(lookup(scripts, F.lower(filled_code(short))), F.lit("Latin"))


def filled_code(short: Column) -> Column:
    return F.coalesce(F.nullif(short, F.lit("")), F.lit("en"))
