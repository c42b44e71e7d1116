"""Registered queries on requests, complaints, languages and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grievaline.functions import labels
from grievaline.functions.scripts import script_language as vote
from grievaline.functions.text import complaint_line, send_link
from grievaline.plans import complaints, conversations, quality, requests, scoring
from grievaline.registry import registered
from grievaline.sources.shapes import shaped
from grievaline.sources.tables import read_table, spread
from grievaline.sources.workdir import new_dir


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shaped(name, lambda table: read_table(spark, sf_dir, table))


def translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complaints.translation_table(given(spark, sf_dir, "f_translated_turns"))


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return (
        given(spark, sf_dir, "f_requests"),
        given(spark, sf_dir, "f_model_replies"),
        translations(spark, sf_dir),
    )


def tool_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = given(spark, sf_dir, "f_tool_events")
    return conversations.answer_results(conversations.tool_calls(events))


def batch(spark: SparkSession, sf_dir: str, whole_text: bool = False) -> DataFrame:
    return complaints.complaint_batch(*inputs(spark, sf_dir), whole_text)


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch(spark, sf_dir).where("status = 'success'")


@registered
def request_batch_source(spark, sf_dir):
    """Requests written as JSON lines and read back with the fixed schema."""
    path = new_dir(spark, "requests")
    given(spark, sf_dir, "f_requests").write.json(path)
    return requests.read_requests(spark, path, ["request_id"])


@registered
def clean_request_row(spark, sf_dir):
    return requests.clean_request(given(spark, sf_dir, "f_requests"))


@registered
def route_request(spark, sf_dir):
    rows = requests.route_requests(given(spark, sf_dir, "f_requests"))
    return rows.select("request_id", "route")


@registered
def empty_query_reject(spark, sf_dir):
    return requests.reject_empty_query(requests.route_requests(given(spark, sf_dir, "f_requests")))


@registered
def default_fill(spark, sf_dir):
    rows = requests.fill_defaults(requests.clean_request(given(spark, sf_dir, "f_requests")))
    return rows.select(
        "request_id", "issue_type", "user_id", "train_number", "pnr", "language_code"
    )


@registered
def phone_validate_split(spark, sf_dir):
    return requests.validate_phone(given(spark, sf_dir, "f_users"))


@registered
def issue_label(spark, sf_dir):
    rows = requests.fill_defaults(requests.clean_request(given(spark, sf_dir, "f_requests")))
    key = F.col("issue_type")
    return rows.select(
        "request_id",
        labels.issue_label(key, key).alias("shown"),
        labels.issue_label(key, F.lit(labels.GENERAL)).alias("in_fallback"),
    )


@registered
def prompt_lines(spark, sf_dir):
    asked, _, stored = inputs(spark, sf_dir)
    rows = complaints.prepared(asked, stored).where(
        "route = 'complaint' AND english_translation IS NOT NULL AND query IS NOT NULL"
    )
    text = complaints.prompt_lines(
        F.col("issue_type"), F.col("train_number"), F.col("english_translation")
    )
    return rows.select("request_id", text.alias("prompt"))


@registered
def reply_clean(spark, sf_dir):
    rows = given(spark, sf_dir, "f_model_replies")
    return rows.select("request_id", complaint_line(F.col("reply")).alias("line"))


@registered
def structured_fallback(spark, sf_dir):
    rows = batch(spark, sf_dir, whole_text=True).where("used_fallback")
    text = complaints.fallback_message(
        F.col("issue_type"), F.col("train_number"), F.col("english_translation"), F.col("query")
    )
    return rows.select("request_id", text.alias("fallback"))


@registered
def truncate_160(spark, sf_dir):
    line = F.col("line")
    return reply_clean(spark, sf_dir).select(
        "request_id",
        complaints.cut_message(line).alias("message"),
        complaints.too_long(line).alias("truncated"),
    )


@registered
def append_pnr(spark, sf_dir):
    rows = batch(spark, sf_dir).where("status = 'success' AND pnr <> ''")
    return rows.select("request_id", "formatted_complaint", "char_count")


@registered
def sms_uri(spark, sf_dir):
    rows = reply_clean(spark, sf_dir)
    return rows.select("request_id", send_link(F.col("line")).alias("sms_uri"))


@registered
def engine_notes(spark, sf_dir):
    return complaints.complaint_result(batch(spark, sf_dir)).select("request_id", "engine_notes")


@registered
def complaint_record(spark, sf_dir):
    return complaints.complaint_record(batch(spark, sf_dir, whole_text=True))


@registered
def complaint_batch(spark, sf_dir):
    return complaints.complaint_result(batch(spark, sf_dir))


@registered
def unify_output(spark, sf_dir):
    return complaints.unify_output(*inputs(spark, sf_dir), tool_logs(spark, sf_dir))


@registered
def scoring_hook(spark, sf_dir):
    """Requests through a stand-in model that measures the query."""
    names = [c.split()[0] for c in scoring.RESULT_DDL.split(", ")]

    def measure(frame):
        out = frame[["request_id"]].copy()
        for name in names[1:]:
            out[name] = ""
        out["status"] = "success"
        out["char_count"] = frame["query"].fillna("").str.len()
        return out[names]

    return scoring.score_frames(given(spark, sf_dir, "f_requests"), measure)


@registered
def error_capture(spark, sf_dir):
    rows = unify_output(spark, sf_dir).where("status = 'error'")
    return rows.select("request_id", "request_type", "status", "message", "engine_notes")


@registered
def route_counts(spark, sf_dir):
    return requests.route_counts(unify_output(spark, sf_dir))


def written_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(given(spark, sf_dir, "f_scripts"), "conv_id")


@registered
def script_language(spark, sf_dir):
    rows = written_texts(spark, sf_dir)
    return rows.select("conv_id", "turn", vote(F.col("text")).alias("language_code"))


@registered
def to_bcp47(spark, sf_dir):
    rows = given(spark, sf_dir, "f_scripts")
    return rows.select(
        "conv_id", "turn", labels.region_code(F.col("short_code")).alias("language_code")
    )


@registered
def language_label(spark, sf_dir):
    rows = written_texts(spark, sf_dir)
    return rows.select(
        "conv_id",
        "turn",
        labels.language_label(vote(F.col("text"))).alias("label"),
        labels.reply_language(F.col("short_code")).alias("reply_language"),
        labels.reply_script(F.col("short_code")).alias("reply_script"),
    )


@registered
def check_complaints(spark, sf_dir):
    return quality.rule_counts(checked(spark, sf_dir), quality.complaint_rules())


@registered
def check_sms_uri(spark, sf_dir):
    return quality.rule_counts(checked(spark, sf_dir), quality.link_rules())


@registered
def check_text_lengths(spark, sf_dir):
    return quality.rule_counts(checked(spark, sf_dir), quality.length_rules())


def all_rules():
    return {**quality.complaint_rules(), **quality.link_rules(), **quality.length_rules()}


@registered
def check_violations(spark, sf_dir):
    return quality.violations(checked(spark, sf_dir), all_rules(), "request_id")


@registered
def check_summary(spark, sf_dir):
    return quality.summary(quality.rule_counts(checked(spark, sf_dir), all_rules()))
