"""Properties of the jobs, sources, streams and plans."""

import hashlib
import json
import math
import re
from collections import Counter
from urllib.parse import unquote

import pytest
import regex
from conftest import SMALL
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from grievaline import catalogue
from grievaline.plans import bookings, complaints, conversations, requests, rules, tickets
from grievaline.queries_requests import batch, given, inputs, tool_logs
from grievaline.sources import workdir
from grievaline.sources.shapes import shaped
from grievaline.sources.sinks import append_missing
from grievaline.sources.tables import read_table
from grievaline.sources.workdir import new_dir
from grievaline.streaming import bookings as booking_stream
from grievaline.streaming import index, registrations, scoring

QUERIES = catalogue.queries()


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


# --- sources ---------------------------------------------------------------


def test_json_requests(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"query": "late", "pnr": null}\n{"request_type": " CHAT ", "query": "hi"}\n')
    rows = requests.route_requests(requests.read_requests(spark, str(path)))
    assert sorted(r["route"] for r in rows.collect()) == ["chat", "complaint"]


def test_nan_is_absent(spark):
    rows = spark.createDataFrame([(float("nan"), "a"), (1.5, " ")], "x double, s string")
    assert [tuple(r) for r in requests.clean_request(rows).collect()] == [(None, "a"), (1.5, None)]


def test_image_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n123")
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xe0")
    (tmp_path / "empty.jpg").write_bytes(b"")
    rows = tickets.read_images(spark, str(tmp_path)).collect()
    kinds = {r["name"]: r["image_type"] for r in rows}
    assert kinds == {"a.png": "image/png", "b.jpg": "image/jpeg"}


def test_shared_folder_setting_wins(spark):
    named = spark.conf.get(workdir.SETTING, None)
    if named:
        assert workdir.new_dir(spark, "x").startswith(named)
    else:
        assert workdir.new_dir(spark, "x") != workdir.new_dir(spark, "x")


def test_append_is_repeatable(spark, tmp_path):
    rows = spark.range(10).withColumn("v", F.lit("a"))
    for _ in range(3):
        append_missing(rows, str(tmp_path / "t"), "id")
    append_missing(spark.range(5, 12).withColumn("v", F.lit("b")), str(tmp_path / "t"), "id")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 12


def test_merged_overwrite_keeps_old_columns(spark, tmp_path):
    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    spark.createDataFrame([(1, "a")], "id int, gone string").write.parquet(old)
    rows = spark.createDataFrame([(2, "hi")], "id int, lang string")
    got = rules.overwrite_merged(spark, old, rows, new)
    assert got.select("id", "gone", "lang").collect() == [(2, None, "hi")]


# --- routing ----------------------------------------------------------------


@pytest.mark.parametrize(
    "row, route",
    [
        ({"request_type": " ChAt\n"}, "chat"),
        ({"request_type": "chat", "ticket_image_base64": "x"}, "chat"),
        ({"request_type": "complaint", "ticket_image_base64": "x"}, "ticket"),
        ({"request_type": "ticket"}, "ticket"),
        ({"request_type": "complaint", "query": "a", "user_id": "u"}, "complaint"),
        ({"query": "a", "user_id": "u"}, "chat"),
        ({"query": "a", "user_id": "u", "pnr": "1"}, "complaint"),
        ({"query": "a", "user_id": "u", "pnr": " "}, "chat"),
        ({"query": "a"}, "complaint"),
        ({}, "complaint"),
        ({"request_type": "other", "query": "a", "user_id": "u"}, "chat"),
    ],
)
def test_routes(spark, row, route):
    values = [tuple(row.get(c) for c in requests.REQUEST_COLUMNS)]
    schema = ", ".join(f"{c} string" for c in requests.REQUEST_COLUMNS)
    got = requests.route_requests(spark.createDataFrame(values, schema))
    assert got.first()["route"] == route


# --- complaints -------------------------------------------------------------


def test_messages(spark):
    rows = batch(spark, SMALL).where("status = 'success'").collect()
    assert rows
    for r in rows:
        body = r["formatted_complaint"]
        if r["pnr"]:
            assert body.endswith(f" PNR {r['pnr']}")
            body = body[: -len(f" PNR {r['pnr']}")]
        assert 0 < len(body) <= 160
        assert r["truncated"] == body.endswith("…")
        assert r["char_count"] == len(r["formatted_complaint"])
        assert r["sms_uri"].startswith("sms:139?body=MADAD%20")
        assert unquote(r["sms_uri"][len("sms:139?body=") :]) == "MADAD " + r["formatted_complaint"]


def test_complaints_by_hand(spark):
    """Few requests through the whole job, results written out."""
    asked = [
        # id, type, query, train, pnr, issue, language, image, user
        ("a", "complaint", " रेल में पानी नहीं है ", "12345", "1234567890", "water", None, None, "u"),
        ("b", "complaint", "खाना खराब", "", None, "parking", "hi-IN", None, "u"),
        ("c", "complaint", "fan broken", None, None, "electricity", "", None, None),
        ("d", "complaint", "no translation kept", None, None, None, "ta-IN", None, None),
        ("e", "complaint", "  ", None, None, "food", None, None, None),
        ("f", "complaint", "empty reply", None, None, "food", "en-IN", None, None),
        ("g", "complaint", "x" * 300, "1", None, "food", "en-IN", None, None),
    ]
    replies = [
        ("a", "<think>hm</think>\nSMS Complaint: **No water | S3**\nmore"),
        ("b", "<think>only a plan"),
        ("c", "ok\n\"Fan broken in coach\""),
        ("d", "some reply"),
        ("e", "some reply"),
        ("f", ""),
        ("g", "y" * 161),
    ]
    turns = [
        ("hi-IN", "en-IN", "रेल में पानी नहीं है", "no water"),
        ("hi-IN", "en-IN", "खाना खराब", ""),
    ]
    schema = "request_id string, " + ", ".join(f"{c} string" for c in requests.REQUEST_COLUMNS)
    rows = [(i, kind, q, t, p, s, g, m, u) for i, kind, q, t, p, s, g, m, u in asked]
    stored = complaints.translation_table(
        spark.createDataFrame(turns, "src string, tgt string, text string, translated string")
    )
    done = complaints.complaint_result(
        complaints.complaint_batch(
            spark.createDataFrame(rows, schema),
            spark.createDataFrame(replies, "request_id string, reply string"),
            stored,
        )
    )
    got = {r["request_id"]: r for r in done.collect()}
    text = {i: r["formatted_complaint"] for i, r in got.items()}
    assert text["a"] == "No water | S3 PNR 1234567890"
    assert got["a"]["engine_notes"] == (
        "Language auto-detected: hi-IN, Translated from hi-IN to English."
    )
    assert got["a"]["sms_uri"] == "sms:139?body=MADAD%20No%20water%20%7C%20S3%20PNR%201234567890"
    assert text["b"] == "General Grievance | खाना खराब"
    assert "structured fallback" in got["b"]["engine_notes"]
    assert text["c"] == "Fan broken in coach"
    assert got["c"]["detected_language"] == "en-IN"
    assert [got[i]["status"] for i in "abcdefg"] == ["success"] * 3 + ["error"] * 3 + ["success"]
    assert [got[i]["engine_notes"] for i in "def"] == [
        "ERROR: no translation",
        "ERROR: empty query",
        "ERROR: empty model reply",
    ]
    assert got["e"]["message"] == "empty query"
    assert text["g"] == "y" * 159 + "…" and got["g"]["truncated"] and got["g"]["char_count"] == 160


def test_a_frequent_text_is_split_over_tasks(spark):
    """A third of the requests share one text: the translation join splits it."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.shuffle.partitions": "100",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 30000, 1, 8).select(
            F.col("id").cast("string").alias("request_id"),
            F.when(F.col("id") % 3 == 0, "same").otherwise(F.md5(F.col("id").cast("string"))).alias("query"),
            F.lit("hi-IN").alias("detected_language"),
        )
        turns = rows.select(
            F.col("detected_language").alias("src"),
            F.lit("en-IN").alias("tgt"),
            F.col("query").alias("text"),
            F.concat(F.lit("EN "), "query").alias("translated"),
        )
        done = complaints.with_translation(rows, complaints.translation_table(turns))
        got = done.collect()
        assert len(got) == 30000
        assert all(r["english_translation"] == "EN " + r["query"] for r in got)
        assert "skew=true" in plan(done)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_complaint_replies_shrink_before_the_join(spark):
    rows = inputs(spark, SMALL)
    text = plan(complaints.complaint_result(complaints.complaint_batch(*rows)))
    assert "Window" not in text


# --- chunks -----------------------------------------------------------------


@pytest.mark.parametrize("length", [1, 449, 450, 451, 500, 501, 900, 901, 2000])
def test_chunks_rebuild_the_text(spark, length):
    text = ("ab🚆d é" * 400)[:length].strip()
    rows = spark.createDataFrame([(7, text)], "doc_id bigint, text string")
    chunks = sorted(rules.sliding_chunks(rows).collect(), key=lambda r: r["start"])
    expected = [(i, text[i : i + 500]) for i in range(0, len(text), 450) if text[i : i + 500].strip()]
    assert [(r["start"], r["text"]) for r in chunks] == expected


def test_blank_windows_are_dropped(spark):
    text = "a" * 450 + " " * 1200 + "b"
    rows = spark.createDataFrame([(1, text), (2, " \n "), (3, None)], "doc_id bigint, text string")
    starts = sorted(r["start"] for r in rules.sliding_chunks(rows).collect())
    assert starts == [i for i in range(0, len(text), 450) if text[i : i + 500].strip()]


def test_chunk_ids_are_unique(spark):
    ids = QUERIES["chunk_surrogate_id"](spark, SMALL)
    assert ids.count() == ids.select("id").distinct().count()


# --- conversations ----------------------------------------------------------


def test_history_is_capped(spark):
    turns = [(1, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(40)]
    rows = spark.createDataFrame(turns, "conv_id int, turn int, role string, content string")
    kept = conversations.history_tail(rows).collect()
    assert sorted(r["turn"] for r in kept) == list(range(32, 40))
    longest = conversations.assemble_messages(rows).agg(F.max(F.size("messages"))).first()[0]
    assert longest == 10


def test_rank_limits_run_before_the_shuffle(spark):
    for name in ("latest_journey", "history_tail"):
        text = plan(QUERIES[name](spark, SMALL))
        assert re.search(r"WindowGroupLimit .*Partial", text), name


def test_point_read_is_pushed_down(spark, tmp_path):
    given(spark, SMALL, "f_journey").write.parquet(str(tmp_path / "j"))
    text = plan(bookings.read_latest(spark, spark.read.parquet(str(tmp_path / "j")), "7"))
    assert "EqualTo(user_id,7)" in text and "TakeOrderedAndProject" in text


# --- streams ----------------------------------------------------------------


def in_files(spark, table, path, files):
    read_table(spark, SMALL, table).repartition(files).write.parquet(path)

    def opened(name):
        schema = spark.read.parquet(path).schema
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)

    return opened


def test_request_stream_equals_batch(spark, tmp_path):
    opened = in_files(spark, "conversations", str(tmp_path / "in"), 3)
    asked, replies, translations = inputs(spark, SMALL)
    target = str(tmp_path / "out")
    scoring.request_stream(
        shaped("f_requests", opened),
        replies,
        translations,
        tool_logs(spark, SMALL),
        target,
        str(tmp_path / "cp"),
    )
    got = spark.read.parquet(target)
    assert got.select("batch").distinct().count() == 3
    expected = complaints.unify_output(asked, replies, translations, tool_logs(spark, SMALL))
    assert sorted(got.drop("batch").collect()) == sorted(expected.collect())


def test_latest_journey_stream_over_batches(spark, tmp_path):
    opened = in_files(spark, "orders", str(tmp_path / "in"), 3)
    target = str(tmp_path / "out")
    booking_stream.latest_journey_stream(shaped("f_journey", opened), target, str(tmp_path / "cp"))
    got = booking_stream.current_journeys(spark.read.parquet(target))
    expected = bookings.latest_journey(given(spark, SMALL, "f_journey"))
    assert sorted(got.select(*expected.columns).collect()) == sorted(expected.collect())


def test_registrations_survive_repeats(spark, tmp_path):
    path = str(tmp_path / "in")
    users = read_table(spark, SMALL, "customer")
    users.repartition(2).write.parquet(path)
    users.repartition(1).write.mode("append").parquet(path)
    opened = lambda _: spark.readStream.schema(users.schema).option(
        "maxFilesPerTrigger", 1
    ).parquet(path)
    target = str(tmp_path / "out")
    registrations.registration_stream(shaped("f_users", opened), target, str(tmp_path / "cp"))
    got = spark.read.parquet(f"{target}/users")
    accepted = QUERIES["phone_validate_split"](spark, SMALL).where("accepted").count()
    assert got.count() == got.select("user_id").distinct().count() == accepted
    assert spark.read.parquet(f"{target}/answers").count() == 2 * users.count()


def test_index_sync_embeds_only_changes(spark, tmp_path):
    path = str(tmp_path / "log")
    schema = "doc_id bigint, text string"
    first = [(1, "no water in coach"), (2, "x " * 600), (3, "refund rules")]
    second = [(1, "no water in coach"), (2, "x " * 300), (4, "new rule")]
    index.sync_index(spark.createDataFrame(first, schema), path, 0, whole=True)
    for _ in range(2):  # a replay of the same batch
        index.sync_index(spark.createDataFrame(second, schema), path, 1, whole=True)
    log = spark.read.parquet(path).where("batch = 1")
    unit = rules.CHUNKS_PER_TEXT
    changed = {r["id"]: r["gone"] for r in log.collect()}
    assert changed == {2 * unit + 1: False, 2 * unit + 2: True, 3 * unit: True, 4 * unit: False}
    live = {r["id"] for r in index.live_index(spark, path).collect()}
    assert live == {unit, 2 * unit, 2 * unit + 1, 4 * unit}


def test_index_stream_replaces_arriving_documents(spark, tmp_path):
    path, schema = str(tmp_path / "log"), "doc_id bigint, text string"
    index.sync_index(spark.createDataFrame([(1, "a"), (2, "y " * 600)], schema), path, 0, False)
    index.sync_index(spark.createDataFrame([(2, "short")], schema), path, 1, False)
    live = index.live_index(spark, path)
    assert sorted(r["doc_id"] for r in live.collect()) == [1, 2]


# --- tool log ---------------------------------------------------------------


def test_arguments(spark):
    strings = ['{"a": 0, "b": 2, "a": 1, "b": null}', "", "  ", "[1]", '{"a": 1} {"b": 2}', "{", None]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, args string")
    got = {r["i"]: r["arguments"] for r in conversations.parse_arguments(rows).collect()}
    assert got[0] == {"a": "1", "b": None}
    assert all(got[i] == {} for i in range(1, len(strings)))


def test_reading_wins_over_booking_id(spark):
    replies = [('{"journey_id": "own", "pnr": "1"}',), ('{"pnr": "2"}',), ("none",)]
    rows = spark.createDataFrame(replies, "reply string")
    got = conversations.merged_reading(rows, F.lit("J1")).collect()
    assert [r["journey"].get("journey_id") for r in got] == ["own", "J1", "J1"]


def test_last_of_repeated_keys_wins(spark):
    replies = [('{"journey_id": "x", "pnr": "1", "journey_id": "y"}',), ('{"a": 1, "a": 2}',)]
    rows = spark.createDataFrame(replies, "reply string")
    got = conversations.merged_reading(rows, F.lit("J1")).collect()
    assert [r["journey"] for r in got] == [
        {"journey_id": "y", "pnr": "1"},
        {"journey_id": "J1", "a": "2"},
    ]


def test_extracted_text_is_json(spark):
    rows = QUERIES["ticket_outcome"](spark, SMALL).where("status = 'success'").collect()
    assert all(isinstance(json.loads(r["extracted_data"]), dict) for r in rows)


# --- what a round found ------------------------------------------------------


def test_every_successful_ticket_names_its_booking(spark):
    from grievaline import catalogue

    done = catalogue.queries()["ticket_outcome"](spark, SMALL).where("status = 'success'")
    booked = catalogue.queries()["journey_projection"](spark, SMALL).select("journey_id")
    assert done.count() > 0 and done.join(booked, "journey_id", "left_anti").count() == 0


def test_repeats_inside_one_append_are_one_row(spark, tmp_path):
    rows = spark.createDataFrame(
        [("u", "2", 5), ("u", "1", 5), ("u", "0", 9), ("v", "3", 1)], "user_id string, phone string, created_at int"
    )
    for _ in range(2):
        append_missing(rows.repartition(4), str(tmp_path / "u"), "user_id")
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "u")).collect()}
    assert got == {("u", "1", 5), ("v", "3", 1)}


def test_no_full_text_column_holds_a_head(spark):
    rows = inputs(spark, SMALL)
    assert not {"query", "english_translation"} & set(complaints.complaint_batch(*rows, False).columns)
    whole = complaints.complaint_batch(*rows)
    longest = whole.agg(F.max(F.length("query"))).first()[0]
    assert longest > complaints.HEAD_CHARS


def test_rounds_of_any_size_and_parsed_arguments(spark):
    """Three calls in one round, a round without a call, a fourth round; values by hand."""
    rows = [
        (1, 5, 1, 10, "rag_search", True, ' {"query": "refund", "n": 2} '),
        (1, 5, 1, 11, "web_search", True, ""),
        (1, 5, 1, 12, "book_hotel", True, '{"a"'),
        (1, 5, 2, 13, "rag_search", True, "[1]"),
        (1, 5, 3, 14, "rag_search", True, None),
        (1, 5, 4, 15, "rag_search", True, "{}"),
        (1, 6, 1, 16, "rag_search", False, "{}"),
        (1, 6, 2, 17, "rag_search", True, "{}"),
    ]
    frame = spark.createDataFrame(
        [(*r, None) for r in rows],
        "session int, answer int, round int, event_id int, tool string, is_call boolean, args string, sms_uri string",
    )
    calls = conversations.tool_calls(frame)
    cut = {(r["answer"], r["rounds"], r["n_calls"]) for r in conversations.round_cutoff(calls).collect()}
    assert cut == {(5, 3, 5), (6, 0, 0)}
    (found,) = conversations.answer_results(calls).collect()
    assert json.loads(found["tool_log"]) == [
        {"tool": "rag_search", "args": {"query": "refund", "n": 2}, "result": "success"},
        {"tool": "web_search", "args": {}, "result": "success"},
        {"tool": "book_hotel", "args": {}, "result": "error"},
        {"tool": "rag_search", "args": {}, "result": "success"},
        {"tool": "rag_search", "args": {}, "result": "success"},
    ]


def test_stored_bookings_are_read_by_row_group(spark):
    """The registered point read pushes its key down and skips most of the stored row groups."""
    frame = QUERIES["journey_point_read"](spark, "/root/testdata/sf0.01")
    assert "EqualTo(user_id,7)" in plan(frame)
    stored = bookings.store_by_user(
        given(spark, "/root/testdata/sf0.01", "f_journey"), new_dir(spark, "bookings"), row_group_bytes=20_000
    )
    one = bookings.read_latest(spark, stored, "7")
    rows = one.collect()
    leaf = one._jdf.queryExecution().executedPlan().collectLeaves().head()
    read = leaf.metrics().apply("numOutputRows").value()
    assert len(rows) == 1 and read < stored.count() / 10


def test_calls_are_not_windowed(spark):
    """Rounds are cut by flags per answer: no window over the log, arguments parsed behind the join."""
    rows = conversations.tool_calls(given(spark, SMALL, "f_tool_events"))
    text = plan(rows.select("session", "answer", "args", "ran"))
    assert "Window" not in text
    assert rows.where("ran AND args IS NULL").count() == 0 and rows.where("NOT ran AND args IS NOT NULL").count() == 0


def test_image_files_by_value(spark):
    """Every image of the table is in a file, with its length, type and hash."""
    table = read_table(spark, SMALL, "part").collect()
    head = {0: "GIF89a", 1: "RIFF....WEBP", 2: "BM"}
    lines = {}
    for r in table:
        lines.setdefault(r["p_brand"], []).append(head[r["p_partkey"] % 3] + r["p_name"])
    found = QUERIES["image_file_source"](spark, SMALL).collect()
    assert sum(r["length"] for r in found) == sum(len(x.encode()) + 1 for rows in lines.values() for x in rows)
    assert len({r["content_sha1"] for r in found}) >= len(lines)
    whole = {hashlib.sha1("".join(f"{x}\n" for x in rows).encode()).hexdigest() for rows in lines.values()}
    assert len(found) > len(lines) or {r["content_sha1"] for r in found} == whole


def test_random_booking_ids(spark):
    rows = QUERIES["journey_ids"](spark, SMALL).collect()
    form = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}")
    assert len({r["journey_id"] for r in rows}) == len(rows) > 100 and all(form.fullmatch(r["journey_id"]) for r in rows)
    assert len({r["created_at"] for r in rows}) == 1
    assert sorted(r["user_id"] for r in rows) == sorted(
        r["user_id"] for r in QUERIES["journey_projection"](spark, SMALL).collect()
    )


def test_text_vectors_by_value(spark):
    """Unit vectors of term counts times inverse document frequencies, from the definition."""
    texts = {r["doc_id"]: r["text"] or "" for r in read_table(spark, SMALL, "documents").collect()}
    found = {r["doc_id"]: r["vec"] for r in QUERIES["text_to_vector"](spark, SMALL).collect()}
    hashing = HashingTF(numFeatures=1 << 10)
    slots = {}
    for i, text in texts.items():
        words = [w for w in regex.split(r"[^\p{L}\p{Nd}]+", text.lower()) if w]
        slots[i] = Counter(hashing.indexOf(w) for w in words)
    held = Counter(s for c in slots.values() for s in c)
    assert found.keys() == texts.keys()
    for i in list(texts)[:60]:
        weights = {s: n * math.log((len(texts) + 1) / (held[s] + 1)) for s, n in slots[i].items()}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        got = {s: x for s, x in enumerate(found[i]) if x}
        want = {s: w / norm for s, w in weights.items() if w}
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in want)


def test_chunk_ids_of_large_text_ids(spark):
    texts = [(2**62 + i, "y " * 600) for i in range(20)] + [(2**39 - 1, "x " * 600), (3, "x " * 600)]
    rows = spark.createDataFrame(texts, "doc_id bigint, text string")
    ids = [r["id"] for r in rules.sliding_chunks(rows).select(rules.chunk_id().alias("id")).collect()]
    assert len(ids) == len(set(ids)) == 22 * 3 and sum(i < 0 for i in ids) == 60
