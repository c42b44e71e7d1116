"""Registered queries on chat turns, tool logs and bookings."""

from __future__ import annotations

from pyspark.sql import functions as F

from grievaline.functions.text import strip, visible_reply
from grievaline.plans import bookings, complaints
from grievaline.plans import conversations as chat
from grievaline.queries_requests import given, translations
from grievaline.registry import registered
from grievaline.sources.shapes import UI_LABELS
from grievaline.sources.workdir import new_dir


def calls(spark, sf_dir):
    return chat.tool_calls(given(spark, sf_dir, "f_tool_events"))


@registered
def strip_think(spark, sf_dir):
    rows = given(spark, sf_dir, "f_model_replies")
    return rows.select("request_id", visible_reply(F.col("reply")).alias("reply"))


@registered
def history_tail(spark, sf_dir):
    return chat.history_tail(given(spark, sf_dir, "f_history"))


@registered
def history_tail_4(spark, sf_dir):
    return chat.history_tail(given(spark, sf_dir, "f_history"), cap=4)


@registered
def ui_history(spark, sf_dir):
    return chat.ui_history(given(spark, sf_dir, "f_history"))


def as_text(messages: str):
    line = F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"]))
    return F.array_join(line, "\n")


@registered
def assemble_messages(spark, sf_dir):
    rows = chat.assemble_messages(given(spark, sf_dir, "f_history"))
    return rows.select(
        "conv_id", "turn", F.size("messages").alias("n_messages"), as_text("messages").alias("prompt")
    )


@registered
def tool_args_parse(spark, sf_dir):
    rows = chat.parse_arguments(given(spark, sf_dir, "f_tool_events"))
    found = F.col("arguments")
    return rows.select(
        "event_id",
        F.size(found).alias("n_arguments"),
        found["query"].alias("query"),
        found["issue_type"].alias("issue_type"),
        found["k"].alias("k"),
    )


@registered
def tool_dispatch(spark, sf_dir):
    return chat.dispatched(given(spark, sf_dir, "f_tool_events"))


@registered
def tool_log_array(spark, sf_dir):
    entry = F.transform(
        "log", lambda e: F.concat_ws("|", e["tool"], e["args"], e["result"])
    )
    rows = chat.tool_log_array(calls(spark, sf_dir))
    return rows.select(
        "session", "answer", F.size("log").alias("n"), F.array_join(entry, "\n").alias("log")
    )


@registered
def first_sms_uri(spark, sf_dir):
    return chat.first_sms_uri(calls(spark, sf_dir))


@registered
def round_cutoff(spark, sf_dir):
    return chat.round_cutoff(calls(spark, sf_dir))


@registered
def tool_usage(spark, sf_dir):
    return chat.tool_usage(calls(spark, sf_dir))


@registered
def tool_usage_wide(spark, sf_dir):
    return chat.tool_usage_wide(calls(spark, sf_dir), chat.TOOLS)


@registered
def tool_free_vs_grounded(spark, sf_dir):
    return chat.grounded(calls(spark, sf_dir))


@registered
def flatten_search_hits(spark, sf_dir):
    """Responses of seven hits each, of which five are kept."""
    hit = F.struct("page_id", "title", "url", "content")
    responses = (
        given(spark, sf_dir, "f_web_hits")
        .groupBy("search_id")
        .agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    )
    return chat.flatten_hits(responses)


@registered
def repeat_suppression(spark, sf_dir):
    return chat.new_clips(given(spark, sf_dir, "f_clips"))


@registered
def journey_merge(spark, sf_dir):
    rows = chat.merged_reading(
        given(spark, sf_dir, "f_ticket_replies"), F.concat(F.lit("J"), "event_id")
    )
    journey = F.col("journey")
    return rows.select(
        "event_id",
        F.size(journey).alias("n_fields"),
        journey["journey_id"].alias("journey_id"),
        journey["train_name"].alias("train_name"),
        journey["k"].alias("k"),
    )


@registered
def journey_caption(spark, sf_dir):
    rows = given(spark, sf_dir, "f_journey")
    return rows.select("journey_id", chat.journey_caption().alias("caption"))


@registered
def journey_point_read(spark, sf_dir):
    """One user's newest booking, from bookings that are stored for such reads."""
    stored = bookings.store_by_user(given(spark, sf_dir, "f_journey"), new_dir(spark, "bookings"))
    return bookings.read_latest(spark, stored, "7")


def shown(rows):
    return rows.select(
        "user_id", "journey_id", "pnr", "train_number", "class", "seat_number", "journey_date"
    )


@registered
def latest_journey(spark, sf_dir):
    return shown(bookings.latest_journey(given(spark, sf_dir, "f_journey")))


@registered
def latest_journey_max_by(spark, sf_dir):
    return shown(bookings.latest_by_aggregate(given(spark, sf_dir, "f_journey")))


@registered
def journey_status(spark, sf_dir):
    return bookings.journey_status(
        given(spark, sf_dir, "f_requests"), given(spark, sf_dir, "f_journey")
    )


@registered
def fill_from_journey(spark, sf_dir):
    return bookings.fill_from_journey(
        given(spark, sf_dir, "f_requests"), given(spark, sf_dir, "f_journey")
    )


def timed(spark, sf_dir):
    return given(spark, sf_dir, "f_timed_requests"), given(spark, sf_dir, "f_journey")


@registered
def booking_as_of(spark, sf_dir):
    """The booking as it stood when each request came; a third of them are one user's."""
    rows = bookings.booking_as_of(*timed(spark, sf_dir))
    day = F.date_format("booked_at", "yyyy-MM-dd")
    return rows.select("request_id", "user_id", "journey_id", "class", day.alias("booked_on"))


@registered
def journey_status_as_of(spark, sf_dir):
    return bookings.status_as_of(*timed(spark, sf_dir))


@registered
def fill_from_journey_as_of(spark, sf_dir):
    return bookings.fill_as_of(*timed(spark, sf_dir))


@registered
def users_without_first_class(spark, sf_dir):
    """Users without a booking in first class; the given users all have some booking."""
    users = given(spark, sf_dir, "f_users").select("user_id")
    first = given(spark, sf_dir, "f_journey").where(F.col("class") == "1A")
    return bookings.users_without_journey(users, first)


@registered
def users_without_journey(spark, sf_dir):
    users = given(spark, sf_dir, "f_users").select("user_id")
    return bookings.users_without_journey(users, given(spark, sf_dir, "f_journey"))


@registered
def translation_lookup(spark, sf_dir):
    """Transcripts in the target language: the stored translation, else as spoken."""
    rows = given(spark, sf_dir, "f_requests").select(
        "request_id",
        strip(F.col("query")).alias("query"),
        F.nullif(F.col("language_code"), F.lit("")).alias("language_code"),
    )
    spoken = complaints.with_language(rows.where("query <> ''"))
    done = complaints.with_translation(spoken, translations(spark, sf_dir))
    text = F.coalesce(F.nullif("english_translation", F.lit("")), F.col("query"))
    return done.select(
        "request_id", text.alias("text"), F.col("detected_language").alias("source_language_code")
    )


@registered
def ui_string_lookup(spark, sf_dir):
    rows = bookings.ui_label(UI_LABELS, given(spark, sf_dir, "f_ui_uses"))
    return rows.select("conv_id", "turn", "label", "found_in")


@registered
def string_coverage(spark, sf_dir):
    return bookings.label_coverage(UI_LABELS, given(spark, sf_dir, "f_ui_uses"))
