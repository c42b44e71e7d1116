"""Column expressions against plain Python on hostile strings."""

import base64
import binascii
import json
import random
import re
import sys
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from grievaline.functions import labels, payloads, text
from grievaline.functions.scripts import SCRIPT_LANGUAGES, script_language

BITS = (
    ["a", "Z", "é", "ट्रेन", "🚆", "", " ", "\n", "\r\n", "\t", "\x0b", "\x1c", "\x1e", "\x85"]
    + ["\xa0", " ", " ", "　", '"', "*", "<think>", "</think>", "<THINK>", ":"]
    + ["SMS complaint", "sms complaint", "Complaint", "output", "ok", "a longer line", "+%~*-._"]
)


def hostile(n=1500, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choices(BITS, k=rng.randint(0, 9))) for _ in range(n)]


def values(spark, strings, column):
    rows = spark.createDataFrame(list(enumerate(strings)), "i int, s string")
    return [r[1] for r in sorted(rows.select("i", column(F.col("s"))).collect())]


def test_blanks_are_those_of_python():
    assert set(text.BLANKS) == {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()}


def test_strip(spark):
    strings = hostile()
    assert values(spark, strings, text.strip) == [s.strip() for s in strings]


def line_by_hand(reply):
    body = re.sub("(?s)<think>.*?</think>", "", reply.strip()).strip()
    if "<think>" in body:
        body = body[: body.index("<think>")].strip()
    found = re.match(r"(?i)(sms\s+complaint|complaint|output)\s*:\s*", body)
    if found:
        body = body[found.end() :]
    good = [x.strip().strip('"').strip("*").strip() for x in body.splitlines()]
    return next((x for x in good if len(x) > 5), body.strip())


def test_complaint_line(spark):
    strings = hostile(3000, 5)
    assert values(spark, strings, text.complaint_line) == [line_by_hand(s) for s in strings]


def test_visible_reply(spark):
    strings = hostile(2000, 6)
    expected = [re.sub("(?is)<think>.*?</think>", "", s).strip() for s in strings]
    assert values(spark, strings, text.visible_reply) == expected


def test_percent_encoding(spark):
    strings = hostile() + ["".join(map(chr, range(32, 127)))]
    safe = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-~")
    for plain, coded in zip(strings, values(spark, strings, text.percent_encoded)):
        assert unquote(coded) == plain
        assert set(re.sub("%[0-9A-F]{2}", "", coded)) <= safe


def strict_bytes(s):
    try:
        return base64.b64decode(s, validate=True)
    except (binascii.Error, ValueError):
        return None


def test_base64(spark):
    rng = random.Random(1)
    strings = ["".join(rng.choices("AQz09+/=*- ", k=rng.randint(0, 9))) for _ in range(3000)]
    strings += [base64.b64encode(rng.randbytes(n)).decode() for n in range(60)]
    strings = ["".join(s.split()) for s in strings]
    got = values(spark, strings, payloads.decoded)
    expected = [strict_bytes(s) for s in strings]
    assert [None if g is None else bytes(g) for g in got] == expected


def test_data_prefix_and_blanks(spark):
    strings = ["data:image/png;base64,QUJD\n RA==", "data:nothing", "QU JD", "x,data:QUJD"]
    assert values(spark, strings, payloads.bare_base64) == [
        "QUJDRA==",
        "data:nothing",
        "QUJD",
        "x,data:QUJD",
    ]


def reading_by_hand(reply):
    if not reply:
        return "empty"
    found = re.search(r"(?s)\{.*\}", reply)
    try:
        value = json.loads(found.group() if found else reply)
    except json.JSONDecodeError:
        return "broken"
    return "parsed" if isinstance(value, dict) else "not_object"


def test_reading_state(spark):
    rng = random.Random(2)
    bits = ['{"pnr": "1"}', "{", "}", "[", "]", '"a"', ": 1", ",", " text ", "{'a': 1}", "12", "\n"]
    strings = ["".join(rng.choices(bits, k=rng.randint(0, 4))) for _ in range(1500)]
    strings += ['{"pnr": "1", "pnr": "2"}', '{"a": {"b": [1, 2]}} x', '{"a": 01}', '{"a": 1,}']

    def state(c):
        reading = payloads.one_object(payloads.json_blob(c), payloads.TICKET_TYPE)
        return payloads.reading_state(c, reading.isNotNull())

    assert values(spark, strings, state) == [reading_by_hand(s) for s in strings]


def test_last_duplicate_key_wins(spark):
    column = lambda c: payloads.one_object(c, payloads.TICKET_TYPE)["pnr"]
    assert values(spark, ['{"pnr": "1", "pnr": "2"}', '{"pnr": 7}'], column) == ["2", "7"]


@pytest.mark.parametrize(
    "head, kind",
    [
        (b"\xff\xd8\xff\xe0", "image/jpeg"),
        (b"\x89PNG\r\n\x1a\n", "image/png"),
        (b"RIFF\x00\x00\x00\x00WEBP", "image/webp"),
        (b"RIFF\x00\x00\x00\x00WAVE", "image/jpeg"),
        (b"GIF87a", "image/gif"),
        (b"GIF89a", "image/gif"),
        (b"", "image/jpeg"),
    ],
)
def test_image_type(spark, head, kind):
    row = spark.createDataFrame([(bytearray(head),)], "b binary")
    assert row.select(payloads.image_type(F.col("b"))).first()[0] == kind


def test_scripts(spark):
    strings = ["मेरी ट्रेन", "late train", "খাবার", "ரயில்", "రైలు", "ટ્રેન", "ರೈಲು", "ട്രെയിൻ"]
    strings += ["ਰੇਲ", "ଟ୍ରେନ", "ٹرین", "42 !", "", "train ट्", "tr ट्रेन लेट"]
    expected = "hi en bn ta te gu kn ml pa od ur hi hi en hi".split()
    assert values(spark, strings, script_language) == [f"{c}-IN" for c in expected]
    assert len({c for _, c in SCRIPT_LANGUAGES}) == 11


def test_codes(spark):
    column = labels.region_code
    assert values(spark, ["HI", "pa", "", "fr", None], column) == [
        "hi-IN", "pa-IN", "en-IN", "en-IN", "en-IN",
    ]


def test_hashed_counts_count_words(spark):
    rows = values(spark, ["Train late, train LATE!", "", "..."], lambda c: text.hashed_counts(c, 16))
    assert [sum(r) for r in rows] == [4, 0, 0]
    assert sorted(rows[0])[-1] >= 2 and all(len(r) == 16 for r in rows)
