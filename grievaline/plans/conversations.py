"""Bounded prompts from chat turns, and what the tool log says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grievaline.functions.payloads import call_arguments, call_object, json_blob, object_fields
from grievaline.functions.text import filled, strip
from grievaline.operators.hotkeys import lookup_join, unused
from grievaline.operators.numbering import with_lookback

HISTORY_CAP = 8
MAX_ROUNDS = 3
MAX_HITS = 5
# The tools an answer may call.
TOOLS = ["get_user_journey", "submit_grievance", "rag_search", "web_search"]
SYSTEM_TEXT = "Choose the tools that answer the passenger."


def spoken(role: Column, content: Column) -> Column:
    return role.isin("user", "assistant") & (content != "")


def history_tail(history: DataFrame, cap: int = HISTORY_CAP) -> DataFrame:
    """The last ``cap`` turns of a conversation, of which user and assistant texts stay.

    The cap comes first, so fewer may remain. The rank limit also runs before the
    shuffle, so a long conversation sends at most ``cap`` rows per task.
    """
    latest = W.partitionBy("conv_id").orderBy(F.col("turn").desc())
    return (
        history.withColumn("_n", F.row_number().over(latest))
        .where(F.col("_n") <= cap)
        .select("conv_id", "turn", "role", strip(F.coalesce("content", F.lit(""))).alias("content"))
        .where(spoken(F.col("role"), F.col("content")))
    )


def ui_history(history: DataFrame) -> DataFrame:
    """All user and assistant turns, missing text as empty."""
    return history.where(F.col("role").isin("user", "assistant")).select(
        "conv_id", "turn", "role", F.coalesce("content", F.lit("")).alias("content")
    )


def assemble_messages(
    history: DataFrame, cap: int = HISTORY_CAP, system: str = SYSTEM_TEXT
) -> DataFrame:
    """For every user turn with text: system, the kept turns before it, the query."""
    turns = history.select(
        "conv_id", "turn", "role", strip(F.coalesce("content", F.lit(""))).alias("content")
    )
    message = F.struct("role", "content")
    seen = with_lookback(turns, ["conv_id"], "turn", cap, {"before": ("list", message)})
    kept = F.filter("before", lambda m: spoken(m["role"], m["content"]))

    def say(role: str, content: Column) -> Column:
        return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))

    return (
        seen.where((F.col("role") == "user") & (F.col("content") != ""))
        .select(
            "conv_id",
            "turn",
            F.concat(say("system", F.lit(system)), kept, say("user", F.col("content"))).alias(
                "messages"
            ),
        )
    )


def tool_calls(events: DataFrame) -> DataFrame:
    """Log entries with their arguments as one object, and whether the answer got that far.

    ``events`` has ``session, answer, round, event_id``: which answer of a session and
    which of its rounds, from 1, an entry belongs to; a round may hold any number of
    entries. An answer ends at its first round without a call, and after three rounds.
    Only two flags per round and answer decide; they are aggregated before anything is
    shuffled, and the arguments of calls that ran are parsed behind the join. An answer
    of any size is spread over tasks.
    """
    at = F.col("round")
    flags = {}
    for n in range(1, MAX_ROUNDS + 1):
        flags[f"has_{n}"] = F.bool_or(at == n)
        flags[f"calls_{n}"] = F.bool_or(F.when(at == n, F.col("is_call")))
    empty = [F.when(F.col(f"has_{n}") & ~F.col(f"calls_{n}"), n) for n in range(1, MAX_ROUNDS + 1)]
    (place,) = unused(events.columns, "place")
    answer = F.struct("session", "answer")
    ends = (
        events.groupBy(answer.alias(place))
        .agg(*[c.alias(n) for n, c in flags.items()])
        .select(place, F.least(*empty).alias("first_empty"))
    )
    ran = (
        F.col("is_call")
        & (at < F.coalesce("first_empty", F.lit(MAX_ROUNDS + 1)))
        & (at <= MAX_ROUNDS)
    )
    rows = lookup_join(events.withColumn(place, answer), ends, place, "event_id").drop(place)
    return rows.withColumn("ran", ran).withColumn("args", F.when(F.col("ran"), call_object(F.col("args"))))


def round_cutoff(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session", "answer").agg(
        F.coalesce(F.max(F.when(F.col("ran"), F.col("round"))), F.lit(0)).alias("rounds"),
        F.count_if("ran").alias("n_calls"),
    )


def parse_arguments(events: DataFrame) -> DataFrame:
    return events.withColumn("arguments", call_arguments(F.col("args")))


def dispatched(events: DataFrame) -> DataFrame:
    """Each call with its handler and arguments, defaults filled in per tool."""
    given = F.col("arguments")

    def argument(name: str, default: str) -> Column:
        return F.when(F.map_contains_key(given, F.lit(name)), given[name]).otherwise(default)

    known = F.col("tool").isin(*TOOLS)
    grievance = F.col("tool") == "submit_grievance"
    search = F.col("tool").isin("rag_search", "web_search")
    return parse_arguments(events).select(
        "event_id",
        F.when(known, F.col("tool")).otherwise("error").alias("handler"),
        F.when(grievance, argument("description", "")).alias("description"),
        F.when(grievance, filled(given["issue_type"], "other")).alias("issue_type"),
        F.when(grievance, filled(given["train_number"], "")).alias("train_number"),
        F.when(grievance, filled(given["pnr"], "")).alias("pnr"),
        F.when(grievance, F.nullif(argument("language_code", ""), F.lit(""))).alias("language_code"),
        F.when(search, argument("query", "")).alias("query"),
        F.when(~known, F.concat(F.lit("Unknown tool: "), F.col("tool"))).alias("error"),
    )


def call_result() -> Column:
    return F.when(~F.col("tool").isin(*TOOLS), "error").otherwise(F.coalesce("sms_uri", F.lit("success")))


def tool_log_array(calls: DataFrame) -> DataFrame:
    """The ordered entries of every answer that called a tool."""
    entry = F.struct("event_id", "tool", "args", call_result().alias("result"))
    return calls.where("ran").groupBy("session", "answer").agg(
        F.array_sort(F.collect_list(entry)).alias("log")
    )


def first_sms_uri(calls: DataFrame) -> DataFrame:
    link = (F.col("tool") == "submit_grievance") & (F.coalesce("sms_uri", F.lit("")) != "")
    found = F.min_by(F.when(link, F.col("sms_uri")), F.when(link, F.col("event_id")))
    return calls.where("ran").groupBy("session", "answer").agg(
        F.coalesce(found, F.lit("")).alias("sms_uri")
    )


def call_text() -> Column:
    """One log entry as JSON; the arguments are an object in it, not a string."""
    tool = F.to_json(F.struct(F.coalesce("tool", F.lit("")).alias("tool")))
    result = F.to_json(F.struct(call_result().alias("result")))
    head = F.substr(tool, F.lit(1), F.length(tool) - 1)
    return F.concat(head, F.lit(',"args":'), F.col("args"), F.lit(","), F.substr(result, F.lit(2)))


def answer_results(calls: DataFrame) -> DataFrame:
    """``request_id, tool_log, log_sms_uri`` of every answer that called a tool.

    Answer n of a session is the one to the request of that conversation and turn.
    """
    entry = F.struct("event_id", call_text().alias("call"))
    link = (F.col("tool") == "submit_grievance") & (F.coalesce("sms_uri", F.lit("")) != "")
    ordered = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["call"])
    return (
        calls.where("ran")
        .groupBy(
            F.concat_ws(
                "-", F.col("session").cast("string"), F.col("answer").cast("string")
            ).alias("request_id")
        )
        .agg(
            F.concat(F.lit("["), F.array_join(ordered, ","), F.lit("]")).alias("tool_log"),
            F.min_by(F.when(link, F.col("sms_uri")), F.when(link, F.col("event_id"))).alias("log_sms_uri"),
        )
    )


def tool_usage(calls: DataFrame) -> DataFrame:
    return calls.where("ran").groupBy("round", "tool").agg(F.count("*").alias("n"))


def tool_usage_wide(calls: DataFrame, tools: list[str]) -> DataFrame:
    """The same with one column per known tool."""
    return calls.where("ran").groupBy("round").pivot("tool", tools).agg(F.count(F.lit(1))).na.fill(0)


def grounded(calls: DataFrame) -> DataFrame:
    return calls.groupBy("session", "answer").agg(F.bool_or("ran").alias("grounded"))


def flatten_hits(responses: DataFrame, cap: int = MAX_HITS) -> DataFrame:
    """The first hits of every search response, missing fields as empty text."""
    blank = F.lit("")
    hits = F.transform(
        F.slice("hits", 1, cap),
        lambda h: F.struct(
            F.coalesce(h["title"], blank).alias("title"),
            F.coalesce(h["url"], blank).alias("url"),
            F.coalesce(h["content"], blank).alias("content"),
        ),
    )
    return responses.select("search_id", F.posexplode(hits).alias("place", "hit")).select(
        "search_id", "place", "hit.title", "hit.url", "hit.content"
    )


def new_clips(clips: DataFrame) -> DataFrame:
    """Clips that differ from the previous one of their session.

    A clip without id takes the hash of its bytes; one without either is ignored
    and does not count as the previous one.
    """
    ident = F.coalesce(F.nullif("clip_id", F.lit("")), F.when(F.col("clip") != "", F.sha1("clip")))
    known = clips.withColumn("ident", ident).where("ident IS NOT NULL")
    seen = with_lookback(
        known, ["session"], "event_id", 1, {"last_ident": ("lag", F.col("ident"))}
    )
    return seen.where(~F.col("ident").eqNullSafe(F.col("last_ident"))).select(
        "session", "event_id", "ident"
    )


def merged_reading(replies: DataFrame, key: Column) -> DataFrame:
    """Booking id and reading in one map; a reading's own value wins."""
    reading = object_fields(json_blob(F.col("reply")))
    rows = replies.withColumn("_reading", reading).withColumn("_key", key)
    own = F.map_filter(
        F.create_map(F.lit("journey_id"), F.col("_key")),
        lambda k, v: ~F.map_contains_key(F.col("_reading"), k),
    )
    return rows.withColumn("journey", F.map_concat(own, F.col("_reading"))).drop("_reading", "_key")


def journey_caption() -> Column:
    blank = F.lit("")
    text = F.concat(
        F.lit("PNR "),
        F.col("pnr"),
        F.lit(" · "),
        F.coalesce("source_station", blank),
        F.lit(" → "),
        F.coalesce("destination_station", blank),
    )
    return F.when(F.coalesce("pnr", blank) != "", F.btrim(text, F.lit(" ·")))


