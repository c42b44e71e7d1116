"""The job inputs, derived from the given tables.

A shape is one projection whose expression text is valid in Spark and in DuckDB,
so that a job and its SQL comparison start from the same rows. No expression uses
a backslash or an engine-specific function.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Shape:
    table: str
    columns: dict[str, str]
    where: str | None = None

    def frame(self, source: DataFrame) -> DataFrame:
        rows = source.where(self.where) if self.where else source
        return rows.selectExpr(*[f"{expr} AS `{name}`" for name, expr in self.columns.items()])

    def sql(self) -> str:
        items = ", ".join(f'{expr} AS "{name}"' for name, expr in self.columns.items())
        tail = f" WHERE {self.where}" if self.where else ""
        return f"SELECT {items} FROM {self.table}{tail}"


def _case(test: str, branches: dict[int, str], other: str = "NULL") -> str:
    whens = " ".join(f"WHEN {k} THEN {v}" for k, v in branches.items())
    return f"CASE {test} {whens} ELSE {other} END"


_TURN = "(conv_id * 31 + turn)"
_REQUEST = "CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING)"

REQUESTS = Shape(
    "conversations",
    {
        "request_id": _REQUEST,
        "request_type": _case(
            f"{_TURN} % 7", {0: "'chat'", 1: "'complaint'", 2: "' TICKET '", 3: "'Complaint'"}
        ),
        "query": f"CASE WHEN {_TURN} % 11 = 0 THEN '  ' "
        f"WHEN {_TURN} % 13 = 0 THEN ' ' || text || '  ' ELSE text END",
        "train_number": f"CASE WHEN {_TURN} % 3 = 0 "
        "THEN CAST(12000 + conv_id % 900 AS STRING) END",
        "pnr": f"CASE WHEN {_TURN} % 2 = 0 THEN lpad(CAST({_TURN} AS STRING), 10, '4') END",
        "issue_type": _case(
            f"{_TURN} % 12",
            {
                0: "'delay'",
                1: "'food'",
                2: "'cleanliness'",
                3: "'staff'",
                4: "'safety'",
                5: "'medical'",
                6: "'water'",
                7: "'electricity'",
                8: "'bedroll'",
                9: "'other'",
                10: "'parking'",
            },
        ),
        "language_code": _case(f"{_TURN} % 4", {0: "'en-IN'", 1: "'hi-IN'", 2: "NULL"}, "''"),
        "ticket_image_base64": _case(
            f"{_TURN} % 9",
            {
                4: "'data:image/png;base64,iVBORw0K GgoAAAA='",
                5: "'/9j/4AAQSkZJRg=='",
                6: "'/9j/4AAQSk*'",
                7: "' '",
            },
        ),
        "user_id": f"CASE WHEN {_TURN} % 5 = 0 THEN '' ELSE CAST(conv_id AS STRING) END",
    },
    "role = 'user'",
)

_LF = "chr(10)"
MODEL_REPLIES = Shape(
    "conversations",
    {
        "request_id": "CAST(conv_id AS STRING) || '-' || CAST(turn - 1 AS STRING)",
        "reply": _case(
            f"{_TURN} % 12",
            {
                0: f"'<think>a plan' || {_LF} || 'b</think>' || {_LF} || text",
                1: "substr(text, 1, 40) || '<think>' || text",
                2: "'SMS  Complaint : ' || text",
                3: "'\"*' || text || '*\"'",
                4: f"'ok' || {_LF} || chr(13) || '  ' || {_LF} || ' ' || text",
                5: "'<think>' || text || '</think>'",
                6: "''",
                7: "'*\"' || substr(text, 1, 90) || '\"*'",
                8: "' no '",
                9: "'Output:' || chr(9) || text || '</think>'",
                10: "'<THINK>x</THINK>' || text",
            },
            "text",
        ),
    },
    "role = 'assistant'",
)

# Finished translations; about one text in seventeen has none, some came back empty.
TRANSLATED_TURNS = Shape(
    "conversations",
    {
        "src": "'hi-IN'",
        "tgt": "'en-IN'",
        "text": "text",
        "translated": "CASE WHEN conv_id % 19 = 5 THEN '' ELSE 'EN: ' || text END",
    },
    f"role = 'user' AND {_TURN} % 17 <> 3",
)

_FULL_READING = (
    "'{\"pnr\": \"' || lpad(CAST(event_id AS STRING), 10, '0') || "
    "'\", \"train_number\": \"12951\", \"train_name\": \"Express ' || event_type || "
    "'\", \"source_station\": \"NDLS\", \"destination_station\": null, "
    "\"journey_date\": \"2024-01-02\", \"departure_time\": \"16:55\", \"class\": \"3A\", "
    "\"seat_number\": ' || CAST(event_id % 72 AS STRING) || ', \"extra\": ' || props || '}'"
)
TICKET_REPLIES = Shape(
    "events",
    {
        "event_id": "event_id",
        "user_id": "CASE WHEN event_id % 6 = 0 THEN '' ELSE CAST(user_id AS STRING) END",
        "reply": _case(
            "event_id % 10",
            {
                0: "'{\"journey_id\": \"own\", ' || substr(props, 2)",
                1: f"'Here it is: ' || {_FULL_READING} || ' done'",
                2: f"{_FULL_READING} || ' and ' || props",
                3: "'{\"pnr\": \"1\", \"class\" \"SL\"}'",
                4: "'no details visible'",
                5: "''",
                6: f"{_FULL_READING} || {_LF}",
                7: "'[1]'",
                8: "'{' || chr(39) || 'pnr' || chr(39) || ': 5}'",
            },
            _FULL_READING,
        ),
    },
)

IMAGE_BYTES = Shape(
    "part",
    {
        "image_id": "p_partkey",
        "content": "unhex("
        + _case(
            "p_partkey % 7",
            {
                0: "'FFD8FFE000104A464946'",
                1: "'89504E470D0A1A0A0000'",
                2: "'524946460A00000057454250'",
                3: "'474946383761'",
                4: "'474946383961'",
                5: "'424D3A000000'",
            },
            "'FFD8'",
        )
        + " || hex(p_name))",
    },
)
IMAGES = Shape(
    "f_image_bytes",
    {
        "image_id": "image_id",
        "content": "content",
        "payload": _case(
            "image_id % 5",
            {
                0: "base64(content)",
                1: "'data:image/png;base64,' || substr(base64(content), 1, 4) || "
                f"{_LF} || ' ' || substr(base64(content), 5)",
                2: "rtrim(replace(base64(content), '=', ' '))",
                3: "substr(base64(content), 1, 3) || '*' || substr(base64(content), 4)",
            },
            "'  '",
        ),
    },
)

JOURNEY = Shape(
    "orders",
    {
        "journey_id": "CAST(o_orderkey AS STRING)",
        "user_id": "CAST(o_custkey AS STRING)",
        "pnr": "lpad(CAST(o_orderkey AS STRING), 10, '0')",
        "train_number": "CAST(11000 + o_orderkey % 900 AS STRING)",
        "train_name": "'Express ' || o_orderstatus",
        "source_station": _case("o_orderkey % 3", {0: "'NDLS'", 1: "'BCT'"}, "''"),
        "destination_station": _case("o_orderkey % 4", {0: "'HWH'", 1: "' '", 2: "'MAS ·'"}),
        "journey_date": "CAST(CAST(o_orderdate AS DATE) AS STRING)",
        "departure_time": "lpad(CAST(o_orderkey % 24 AS STRING), 2, '0') || ':05'",
        "arrival_time": "lpad(CAST(o_orderkey % 23 AS STRING), 2, '0') || ':50'",
        "class": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '1A' WHEN '2' THEN '2A' "
        "WHEN '3' THEN '3A' WHEN '4' THEN 'SL' ELSE '2S' END",
        "seat_number": "CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 72 AS STRING) END",
        "created_at": "o_orderdate",
    },
)

# Requests with a time: the month of events stretched over the years of the bookings, to
# the day, so that a request and a booking may fall on one time.
TIMED_REQUESTS = Shape(
    "events",
    {
        "request_id": "event_id",
        "user_id": "CASE WHEN event_id % 19 = 0 THEN ' ' WHEN event_id % 3 = 0 THEN '7' "
        "ELSE CAST(user_id AS STRING) END",
        "asked_at": "CASE WHEN event_id % 23 > 0 THEN CAST(DATE '1995-01-01' + "
        "CAST(80 * (extract(DAY FROM ts) - 1) + 3 * extract(HOUR FROM ts) AS INT) AS TIMESTAMP) END",
        "train_number": "CASE WHEN event_id % 4 = 0 THEN CAST(12000 + event_id % 900 AS STRING) END",
        "pnr": "CASE WHEN event_id % 5 = 0 THEN lpad(CAST(event_id AS STRING), 10, '4') "
        "WHEN event_id % 5 = 1 THEN ' ' END",
    },
)

USERS = Shape(
    "customer",
    {
        "user_id": "CAST(c_custkey AS STRING)",
        "phone": _case(
            "c_custkey % 8",
            {
                0: "CAST(9000000000 + c_custkey AS STRING)",
                1: "CAST(900000000 + c_custkey AS STRING)",
                2: "' ' || CAST(9100000000 + c_custkey AS STRING) || chr(10)",
                3: "'phone'",
                4: "translate(CAST(9200000000 + c_custkey AS STRING), "
                "'0123456789', '०१२३४५६७८९')",
                5: "CAST(9300000000 + c_custkey AS STRING) || '0'",
                6: "CAST(930000000 + c_custkey AS STRING) || 'x'",
            },
        ),
    },
)

# Registrations arrive by customer number, up to two hours out of the order of their times.
REGISTRATIONS = Shape(
    "customer",
    {
        **USERS.columns,
        "registered_at": "CAST(DATE '2024-01-01' AS TIMESTAMP) + INTERVAL '1' MINUTE * "
        "CAST(floor(c_custkey / 4) + (c_custkey * 7) % 120 AS INT)",
    },
)

HISTORY = Shape(
    "conversations",
    {
        "conv_id": "conv_id",
        "turn": "turn",
        "role": "CASE WHEN conv_id % 9 = 3 AND turn % 4 = 2 THEN 'tool' ELSE role END",
        "content": "CASE WHEN (conv_id + turn) % 10 = 7 THEN ' ' "
        "WHEN (conv_id + turn) % 10 = 8 THEN NULL ELSE ' ' || text END",
    },
)

TOOL_EVENTS = Shape(
    "events",
    {
        "session": "user_id",
        "event_id": "event_id",
        "answer": "CAST(floor(event_id / 1000) AS BIGINT)",
        "round": "CAST(CASE WHEN event_id % 1000 < 250 THEN 1 WHEN event_id % 1000 < 650 THEN 2 "
        "WHEN event_id % 1000 < 750 THEN 3 WHEN event_id % 1000 < 900 THEN 4 ELSE 5 END AS INT)",
        "tool": "CASE event_type WHEN 'view' THEN 'get_user_journey' "
        "WHEN 'click' THEN 'rag_search' WHEN 'signup' THEN 'web_search' "
        "WHEN 'purchase' THEN 'submit_grievance' ELSE 'book_hotel' END",
        "is_call": "event_id % 3 > 0",
        "args": _case(
            "event_id % 7",
            {
                0: "''",
                1: "'{\"query\": \"refund ' || CAST(event_id % 50 AS STRING) || '\"}'",
                2: "'{\"description\": \"no water\", \"issue_type\": \"water\", \"pnr\": null}'",
                3: "'{\"query\"'",
                4: "'{\"issue_type\": null, \"train_number\": \"12951\"}'",
            },
            "props",
        ),
        "sms_uri": "CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 "
        "THEN 'sms:139?body=MADAD%20' || CAST(event_id AS STRING) END",
    },
)

CLIPS = Shape(
    "events",
    {
        "session": "user_id",
        "event_id": "event_id",
        "clip_id": "CASE WHEN event_id % 3 = 0 THEN event_type END",
        "clip": "CASE WHEN event_id % 17 = 0 THEN '' ELSE event_type END",
    },
)

USAGE = Shape(
    "events",
    {
        "model": "CASE event_type WHEN 'view' THEN 'chat' WHEN 'click' THEN 'chat' "
        "WHEN 'purchase' THEN 'complaint' ELSE 'reply' END",
        "day": "CAST(CAST(ts AS DATE) AS STRING)",
        "prompt_tokens": "CAST(length(props) + event_id % 40 AS BIGINT)",
        "completion_tokens": "CAST(floor(value) AS BIGINT)",
    },
)

# Our own labels for a handful of keys; Hindi and Tamil have gaps on purpose.
UI_LABELS = {
    ("en", "submit"): "Send",
    ("en", "language"): "Language",
    ("en", "skip"): "Not now",
    ("en", "thinking"): "One moment",
    ("hi", "submit"): "भेजें",
    ("hi", "language"): "भाषा",
    ("ta", "language"): "மொழி",
    ("ta", "skip"): "தவிர்",
}
UI_USES = Shape(
    "conversations",
    {
        "conv_id": "conv_id",
        "turn": "turn",
        "lang": _case("conv_id % 4", {0: "'en'", 1: "'hi'", 2: "'ta'"}, "'xx'"),
        "label_key": _case(
            "turn % 5", {0: "'submit'", 1: "'language'", 2: "'skip'", 3: "'thinking'"}, "'tour'"
        ),
    },
)

# One alphabet per script, so that a text can be written in each of them.
_ALPHABETS = {
    0: "अआइईउऊएऐओऔकखगघचछजझटठडढतथदध",
    1: "অআইঈউঊএঐওঔকখগঘচছজঝটঠডঢতথদধ",
    2: "அஆஇஈஉஊஎஏஐஒஓஔகஙசஜஞடணதநனபமயர",
    3: "అఆఇఈఉఊఎఏఐఒఓఔకఖగఘచఛజఝటఠడఢతథ",
    4: "અઆઇઈઉઊએઐઓઔકખગઘચછજઝટઠડઢતથદધ",
    5: "ಅಆಇಈಉಊಎಏಐಒಓಔಕಖಗಘಚಛಜಝಟಠಡಢತಥ",
    6: "അആഇഈഉഊഎഏഐഒഓഔകഖഗഘചഛജഝടഠഡഢതഥ",
    7: "ਅਆਇਈਉਊਏਐਓਔਕਖਗਘਚਛਜਝਟਠਡਢਤਥਦਧ",
    8: "ଅଆଇଈଉଊଏଐଓଔକଖଗଘଚଛଜଝଟଠଡଢତଥଦଧ",
    9: "ابتثجحخدذرزسشصضطظعغفقكلمنهو",
}
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
SCRIPT_TEXTS = Shape(
    "conversations",
    {
        "conv_id": "conv_id",
        "turn": "turn",
        "text": _case(
            "(conv_id + turn) % 14",
            {
                **{k: f"translate(lower(text), '{_LETTERS}', '{v}')" for k, v in _ALPHABETS.items()},
                10: "CAST(conv_id AS STRING) || ' 42 !'",
                11: "''",
                12: f"translate(text, 'aeiou', '{_ALPHABETS[0][:5]}')",
            },
            "text",
        ),
        "short_code": _case(
            "(conv_id + turn) % 14",
            {0: "'HI'", 1: "'bn'", 2: "'ta'", 3: "'Te'", 4: "'gu'", 5: "'mr'", 6: "'ml'", 7: "''"},
            "'fr'",
        ),
    },
)

DOCUMENTS = Shape(
    "documents",
    {"doc_id": "doc_id", "source": "source", "lang": "lang", "text": "text"},
)
# Two versions of the rulebook: texts amended, withdrawn and new in the second one.
OLD_DOCUMENTS = Shape("documents", dict(DOCUMENTS.columns), "doc_id % 10 <> 2")
NEW_DOCUMENTS = Shape(
    "documents",
    {
        **DOCUMENTS.columns,
        "text": "CASE WHEN doc_id % 10 = 0 THEN text || ' (amended)' ELSE text END",
    },
    "doc_id % 10 <> 1",
)

WEB_HITS = Shape(
    "pages",
    {
        "page_id": "page_id",
        "search_id": "CAST(floor(page_id / 7) AS BIGINT)",
        "title": "CASE WHEN page_id % 11 <> 3 THEN regexp_extract(html, "
        "'<title>([^<]*)</title>', 1) END",
        "url": "url",
        "content": "CASE WHEN page_id % 6 <> 1 THEN CAST(length(html) AS STRING) END",
    },
)

NAMED: dict[str, Shape] = {
    "f_requests": REQUESTS,
    "f_model_replies": MODEL_REPLIES,
    "f_translated_turns": TRANSLATED_TURNS,
    "f_ticket_replies": TICKET_REPLIES,
    "f_image_bytes": IMAGE_BYTES,
    "f_images": IMAGES,
    "f_journey": JOURNEY,
    "f_timed_requests": TIMED_REQUESTS,
    "f_users": USERS,
    "f_registrations": REGISTRATIONS,
    "f_documents": DOCUMENTS,
    "f_old_documents": OLD_DOCUMENTS,
    "f_new_documents": NEW_DOCUMENTS,
    "f_web_hits": WEB_HITS,
    "f_history": HISTORY,
    "f_tool_events": TOOL_EVENTS,
    "f_clips": CLIPS,
    "f_usage": USAGE,
    "f_ui_uses": UI_USES,
    "f_scripts": SCRIPT_TEXTS,
}


def shaped(name: str, read: Callable[[str], DataFrame]) -> DataFrame:
    """The named input over the tables that ``read`` opens."""
    shape = NAMED[name]
    source = shaped(shape.table, read) if shape.table in NAMED else read(shape.table)
    return shape.frame(source)
