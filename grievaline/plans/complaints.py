"""Complaint messages with length limit and send link, and the unified result row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grievaline.functions import payloads
from grievaline.functions.labels import GENERAL, issue_label, language_label
from grievaline.functions.scripts import script_language
from grievaline.functions.text import complaint_line, send_link, strip, visible_reply
from grievaline.plans.requests import fill_defaults, route_requests

MAX_CHARS = 160
# What a fallback message can need of a text.
HEAD_CHARS = 80
TEXTS = ("query", "english_translation")
HEADS = ("query_head", "translation_head")
# Messages and notes of the result row.
COMPLAINT_DONE = "Complaint generated"
COMPLAINT_FAILED = "Failed to generate complaint"
CHAT_DONE = "Chat response generated"
TICKET_DONE = "Ticket processed and journey details saved"
TICKET_FAILED = "Failed to process ticket: "
NOTE_FORCED = "Language forced to: "
NOTE_DETECTED = "Language auto-detected: "
NOTE_ENGLISH = "Input is English — no translation needed."
NOTE_FALLBACK = "LLM returned empty output — used structured fallback."
NOTE_CUT = "Complaint truncated to 160 characters."


def prompt_lines(issue: Column, train: Column, text: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Category: "), issue_label(issue, issue)),
        F.when(train != "", F.concat(F.lit("Train: "), train)),
        F.concat(F.lit("Issue: "), text),
    )


def fallback_message(issue: Column, train: Column, translation: Column, raw: Column) -> Column:
    """A message from the fields, for a reply that cleans to nothing."""
    text = F.coalesce(F.nullif(translation, F.lit("")), raw)
    body = strip(F.substring(text, 1, HEAD_CHARS))
    return F.concat(
        issue_label(issue, F.lit(GENERAL)),
        F.when(train != "", F.concat(F.lit(" Train "), train)).otherwise(""),
        F.lit(" | "),
        body,
    )


def too_long(message: Column) -> Column:
    return F.length(message) > MAX_CHARS


def cut_message(message: Column) -> Column:
    short = F.concat(F.substring(message, 1, MAX_CHARS - 1), F.lit("…"))
    return F.when(too_long(message), short).otherwise(message)


def with_pnr(message: Column, pnr: Column) -> Column:
    """The PNR follows after the cut, so the text may pass the limit."""
    return F.when(pnr != "", F.concat(message, F.lit(" PNR "), pnr)).otherwise(message)


def reply_digest(replies: DataFrame) -> DataFrame:
    """Model replies shrunk to what a message can need, before any shuffle."""
    line = complaint_line(F.col("reply"))
    return replies.select(
        "request_id",
        F.substring(line, 1, MAX_CHARS + 1).alias("line"),
        (F.coalesce(F.col("reply"), F.lit("")) != "").alias("has_reply"),
        F.length("reply").alias("reply_length"),
    )


def with_language(rows: DataFrame) -> DataFrame:
    """Forced code, or the code voted by script."""
    return rows.withColumn(
        "detected_language", F.coalesce(F.col("language_code"), script_language(F.col("query")))
    )


def translation_table(turns: DataFrame) -> DataFrame:
    """One stored translation per language pair and text."""
    return turns.groupBy("src", "tgt", F.sha2("text", 256).alias("text_key")).agg(
        F.min("translated").alias("translated")
    )


def with_translation(
    rows: DataFrame, translations: DataFrame, whole_text: bool = True
) -> DataFrame:
    """``english_translation``: the text itself for English, else the stored translation.

    Null means that no translation is stored, which is the failed call of the job;
    ``translation_length`` is that of the whole translation. Only rows that need one
    carry a text key; the others get no key and are spread by the request id, so that
    they do not meet in one partition. Without ``whole_text`` the heads that a fallback
    message can show, ``query_head`` and ``translation_head``, are shuffled in place of
    ``query`` and ``english_translation``; the text key is still that of the whole text.
    """
    text, translation = TEXTS if whole_text else HEADS

    def kept(c: str) -> Column:
        return F.col(c) if whole_text else F.substring(c, 1, HEAD_CHARS)

    stored = translations.where(F.col("tgt") == "en-IN").select(
        F.concat_ws("|", "src", "text_key").alias("_key"),
        kept("translated").alias("_stored"),
        F.length("translated").alias("_stored_length"),
    )
    english = F.col("detected_language") == "en-IN"
    wanted = F.when(
        ~english, F.concat_ws("|", F.col("detected_language"), F.sha2(F.col("query"), 256))
    ).otherwise(F.concat(F.lit("#"), F.col("request_id")))
    thin = rows.withColumn("_key", wanted).withColumn("_length", F.length("query"))
    if not whole_text:
        thin = thin.withColumn(text, kept("query")).drop("query")
    # A frequent text makes a skewed partition of a plain left join, which the
    # adaptive skew join splits; the stored side has one row per key.
    return (
        thin.join(stored, "_key", "left")
        .withColumn(translation, F.when(english, F.col(text)).otherwise(F.col("_stored")))
        .withColumn(
            "translation_length", F.when(english, F.col("_length")).otherwise(F.col("_stored_length"))
        )
        .drop("_key", "_length", "_stored", "_stored_length")
    )


def complaint_columns(rows: DataFrame) -> DataFrame:
    """Message, link, notes and status for rows with reply digest and translation.

    The rows hold whole texts, or the heads that a fallback message can show.
    """
    text, translation = TEXTS if "query" in rows.columns else HEADS
    failed = F.when(F.col(text).isNull(), "empty query").when(
        F.col(translation).isNull(), "no translation"
    )
    failed = failed.when(~F.coalesce(F.col("has_reply"), F.lit(False)), "empty model reply")
    used_fallback = F.col("line") == ""
    message = F.when(
        used_fallback,
        fallback_message(
            F.col("issue_type"), F.col("train_number"), F.col(translation), F.col(text)
        ),
    ).otherwise(F.col("line"))
    rows = rows.withColumn("failure", failed).withColumn("_message", message)
    code = F.col("detected_language")
    notes = F.array_compact(
        F.array(
            F.concat(
                F.when(F.col("language_code").isNotNull(), NOTE_FORCED).otherwise(NOTE_DETECTED),
                code,
            ),
            F.when(code == "en-IN", NOTE_ENGLISH).otherwise(
                F.concat(F.lit("Translated from "), code, F.lit(" to English."))
            ),
            F.when(used_fallback, NOTE_FALLBACK),
            F.when(too_long(F.col("_message")), NOTE_CUT),
        )
    )
    ok = F.col("failure").isNull()
    rows = rows.withColumn(
        "formatted_complaint",
        F.when(ok, with_pnr(cut_message(F.col("_message")), F.col("pnr"))).otherwise(""),
    )
    return rows.withColumns(
        {
            "status": F.when(ok, "success").otherwise("error"),
            "message": F.when(ok, COMPLAINT_DONE)
            .when(F.col("failure") == "empty query", "empty query")
            .otherwise(COMPLAINT_FAILED),
            "truncated": ok & too_long(F.col("_message")),
            "used_fallback": ok & used_fallback,
            "notes": F.when(ok, notes).otherwise(
                F.array(F.concat(F.lit("ERROR: "), F.col("failure")))
            ),
            "char_count": F.length("formatted_complaint"),
            "sms_uri": F.when(ok, send_link(F.col("formatted_complaint"))).otherwise(""),
            "detected_language": F.when(ok, code).otherwise(""),
        }
    ).drop("_message")


def prepared(
    requests: DataFrame, translations: DataFrame, whole_text: bool = True
) -> DataFrame:
    """Cleaned, routed, defaulted requests with language and translation."""
    rows = fill_defaults(route_requests(requests))
    rows = rows.withColumn("query", strip(F.col("query")))
    return with_translation(with_language(rows), translations, whole_text)


def complaint_batch(
    requests: DataFrame, replies: DataFrame, translations: DataFrame, whole_text: bool = True
) -> DataFrame:
    """Every complaint request with its message, link, notes and status.

    Without ``whole_text`` the raw text and the translation are left out, which spares
    their shuffle; messages, lengths and notes are the same.
    """
    rows = prepared(requests, translations, whole_text).where(F.col("route") == "complaint")
    rows = rows.join(reply_digest(replies), "request_id", "left")
    return complaint_columns(rows).drop(*HEADS)


def complaint_result(batch: DataFrame) -> DataFrame:
    return batch.select(
        "request_id",
        "status",
        "message",
        "sms_uri",
        "formatted_complaint",
        "char_count",
        "truncated",
        "detected_language",
        F.array_join("notes", ", ").alias("engine_notes"),
    )


def complaint_record(batch: DataFrame) -> DataFrame:
    """The eleven-field result of a generated complaint, labels in place of keys."""
    return batch.where(F.col("status") == "success").select(
        "request_id",
        F.col("query").alias("raw_input"),
        language_label(F.col("detected_language")).alias("detected_language"),
        issue_label(F.col("issue_type"), F.col("issue_type")).alias("issue_type"),
        "train_number",
        "pnr",
        "english_translation",
        "formatted_complaint",
        "sms_uri",
        "char_count",
        "truncated",
        F.array_join("notes", ", ").alias("engine_notes"),
    )


def unify_output(
    requests: DataFrame, replies: DataFrame, translations: DataFrame, tool_logs: DataFrame
) -> DataFrame:
    """One twelve-column row per request of any route, absent fields blank or zero.

    The input is read once; each route fills its own columns. ``tool_logs`` holds
    ``request_id, tool_log, log_sms_uri`` of the answers that called tools.
    """
    rows = prepared(requests, translations, whole_text=False)
    line = complaint_line(F.col("reply"))
    is_chat = F.col("route") == "chat"
    is_ticket = F.col("route") == "ticket"
    is_complaint = F.col("route") == "complaint"
    blob = payloads.json_blob(F.col("reply"))
    reading = payloads.one_object(blob, payloads.TICKET_TYPE)
    rows = complaint_columns(
        rows.join(replies.select("request_id", "reply"), "request_id", "left")
        .join(tool_logs, "request_id", "left")
        .withColumn("line", F.when(is_complaint, F.substring(line, 1, MAX_CHARS + 1)))
        .withColumn("has_reply", F.coalesce(F.col("reply"), F.lit("")) != "")
        .withColumn(
            "reading_state",
            F.when(is_ticket, payloads.reading_state(F.col("reply"), reading.isNotNull())),
        )
    )
    bare = payloads.bare_base64(F.coalesce(F.col("ticket_image_base64"), F.lit("")))
    state = F.col("reading_state")
    no_query = is_chat & F.col("query_head").isNull()
    no_image = is_ticket & (~payloads.is_strict_base64(bare) | (bare == ""))
    no_object = is_ticket & (state == "not_object")
    chat_done = is_chat & ~no_query
    ticket_done = is_ticket & ~no_image & ~no_object
    blank = F.lit("")
    columns = {
        "status": F.when(is_complaint, F.col("status"))
        .when(chat_done | ticket_done, "success")
        .otherwise("error"),
        "message": F.when(is_complaint, F.col("message"))
        .when(no_query, "empty query")
        .when(no_image, TICKET_FAILED + "invalid base64 image")
        .when(no_object, TICKET_FAILED + "reply is not an object")
        .when(is_chat, CHAT_DONE)
        .otherwise(TICKET_DONE),
        "sms_uri": F.when(is_complaint, F.col("sms_uri")).when(chat_done, F.col("log_sms_uri")),
        "formatted_complaint": F.when(is_complaint, F.col("formatted_complaint")),
        "char_count": F.when(is_complaint, F.col("char_count")).otherwise(0),
        "detected_language": F.when(is_complaint, F.col("detected_language")),
        "engine_notes": F.when(is_complaint, F.array_join("notes", ", ")),
        "journey_id": F.when(
            ticket_done, F.sha2(F.concat_ws("|", "request_id", "user_id", bare), 256)
        ),
        "extracted_data": F.when(
            ticket_done,
            F.when(state == "parsed", blob).otherwise("{}"),
        ),
        "chat_reply": F.when(chat_done, visible_reply(F.col("reply"))),
        "tool_log": F.when(chat_done, F.coalesce("tool_log", F.lit("[]"))),
    }
    never_null = ("status", "message", "char_count")
    return rows.select(
        "request_id",
        F.col("route").alias("request_type"),
        *[(c if n in never_null else F.coalesce(c, blank)).alias(n) for n, c in columns.items()],
    )
