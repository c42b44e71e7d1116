"""Image payloads and JSON cut from loose model text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grievaline.functions.text import BLANK_CLASS

# The ten keys a ticket reading may carry, in table order.
TICKET_KEYS = [
    "pnr",
    "train_number",
    "train_name",
    "source_station",
    "destination_station",
    "journey_date",
    "departure_time",
    "arrival_time",
    "class",
    "seat_number",
]
TICKET_TYPE = "struct<" + ",".join(f"`{k}`:string" for k in TICKET_KEYS) + ">"
# Python's parser refuses single quotes, Spark's default accepts them.
JSON_BLANKS = " \t\n\r"
STRICT_JSON = {"allowSingleQuotes": "false"}


def bare_base64(c: Column) -> Column:
    """Base64 text without its data prefix and without any blank."""
    body = F.when(
        c.startswith("data:") & F.contains(c, F.lit(",")),
        F.regexp_replace(c, r"\A[^,]*,", ""),
    ).otherwise(c)
    return F.regexp_replace(body, BLANK_CLASS + "+", "")


def is_strict_base64(bare: Column) -> Column:
    """The standard alphabet with complete padding; Spark alone would be laxer."""
    return (F.length(bare) % 4 == 0) & bare.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z")


def decoded(bare: Column) -> Column:
    """Bytes of a strict payload, null for a damaged one."""
    return F.when(is_strict_base64(bare), F.try_to_binary(bare, F.lit("base64")))


def image_type(content: Column) -> Column:
    """Media type by leading bytes; whatever is unknown counts as jpeg."""

    def lead(start: int, magic: str) -> Column:
        return F.substring(content, start, len(magic) // 2) == F.unhex(F.lit(magic))

    # File signatures in hex.
    return (
        F.when(lead(1, "FFD8FF"), "image/jpeg")
        .when(lead(1, "89504E470D0A1A0A"), "image/png")
        .when(lead(1, "52494646") & lead(9, "57454250"), "image/webp")
        .when(lead(1, "474946383761") | lead(1, "474946383961"), "image/gif")
        .otherwise("image/jpeg")
    )


def json_blob(c: Column) -> Column:
    """From the first opening to the last closing brace, else the whole text."""
    cut = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(cut != "", cut).otherwise(c)


def one_object(blob: Column, ddl: str) -> Column:
    """``blob`` as exactly one JSON object of type ``ddl``, else null.

    The parser stops behind the first value. Inside an array a second value shows as
    a second item or breaks the array. Only text with a closing bracket behind a
    brace could close that array itself; it must also parse inside an object.
    """
    items = F.from_json(F.concat(F.lit("["), blob, F.lit("]")), f"array<{ddl}>", STRICT_JSON)
    inside = F.from_json(F.concat(F.lit('{"v":'), blob, F.lit("}")), f"struct<v:{ddl}>", STRICT_JSON)
    item = F.when(
        blob.startswith("{")
        & (~blob.rlike(r"\}\s*\]") | inside.getField("v").isNotNull()),
        items,
    )
    # The one-element array binds the items, so that the text is parsed once.
    return F.get(F.transform(F.array(item), lambda i: F.when(F.size(i) == 1, F.get(i, F.lit(0)))), F.lit(0))


def is_one_value(c: Column) -> Column:
    """Whether the text is exactly one JSON value; the same two wraps as above."""
    items = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    inside = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit("}")))
    first, second = (F.try_variant_get(items, f"$[{i}]", "variant") for i in (0, 1))
    return inside.isNotNull() & first.isNotNull() & second.isNull()


def last_wins(fields: Column) -> Column:
    """A parsed map with one entry per key; of repeated keys the last one stays."""
    keys = F.array_distinct(F.map_keys(fields))
    entries = F.map_entries(fields)

    def value(key: Column) -> Column:
        return F.element_at(F.filter(entries, lambda e: e["key"] == key), -1)["value"]

    single = F.map_from_arrays(keys, F.transform(keys, value))
    return F.when(F.size(keys) == F.size(fields), fields).otherwise(single)


def object_fields(blob: Column) -> Column:
    """The fields of one JSON object as a map; anything else gives an empty map."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    parsed = F.array(one_object(blob, "map<string,string>"))
    return F.coalesce(F.get(F.transform(parsed, last_wins), F.lit(0)), empty)


def call_arguments(c: Column) -> Column:
    """Tool arguments as a map; blank or broken text gives an empty map."""
    return object_fields(F.btrim(c, F.lit(JSON_BLANKS)))


def call_object(c: Column) -> Column:
    """Tool arguments as the text of one JSON object; blank or broken text gives ``{}``."""
    bare = F.btrim(c, F.lit(JSON_BLANKS))
    return F.when(one_object(bare, "map<string,string>").isNotNull(), bare).otherwise("{}")


def reading_state(reply: Column, parsed: Column) -> Column:
    """``empty``, ``parsed``, ``broken`` or ``not_object`` for a ticket reply.

    A reply without braces that is JSON all the same (a list, a number) cannot
    give fields and fails the row; broken text only gives an empty reading.
    """
    return (
        F.when(F.coalesce(reply, F.lit("")) == "", "empty")
        .when(parsed, "parsed")
        .when(~F.contains(reply, F.lit("{")) & is_one_value(reply), "not_object")
        .otherwise("broken")
    )
