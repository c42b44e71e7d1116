"""Comparison SQL for chat turns, tool logs and bookings."""

from grievaline.oracle.build import query, strip, view
from grievaline.plans.conversations import TOOLS
from grievaline.sources.shapes import UI_LABELS

query(
    "strip_think",
    f"""SELECT request_id, {strip("regexp_replace(reply, '(?is)<think>.*?</think>', '', 'g')")} AS reply
      FROM f_model_replies""",
)
for name, cap in (("history_tail", 8), ("history_tail_4", 4)):
    query(
        name,
        f"""SELECT conv_id, turn, role, {strip("coalesce(content, '')")} AS content
          FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM f_history)
          WHERE n <= {cap} AND role IN ('user', 'assistant') AND {strip("coalesce(content, '')")} <> ''""",
    )
query(
    "ui_history",
    """SELECT conv_id, turn, role, coalesce(content, '') AS content FROM f_history
      WHERE role IN ('user', 'assistant')""",
)
view(
    "v_seen",
    """SELECT conv_id, turn, role, content, list({'role': role, 'content': content}) OVER
        (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS before
      FROM (SELECT conv_id, turn, role, """
    + strip("coalesce(content, '')")
    + " AS content FROM f_history)",
)
query(
    "assemble_messages",
    """SELECT conv_id, turn, CAST(len(lines) AS INTEGER) AS n_messages, array_to_string(lines, chr(10)) AS prompt
      FROM (SELECT conv_id, turn, list_concat(['system: Choose the tools that answer the passenger.'],
          list_concat(list_transform(list_filter(coalesce(before, []),
            lambda m: m.role IN ('user', 'assistant') AND m.content <> ''),
            lambda m: m.role || ': ' || m.content), ['user: ' || content])) AS lines
        FROM v_seen WHERE role = 'user' AND content <> '')""",
)
view("v_args", "SELECT *, CASE WHEN json_valid(args) THEN args ELSE '{}' END AS j FROM f_tool_events")
query(
    "tool_args_parse",
    """SELECT event_id, CAST(len(json_keys(j)) AS INTEGER) AS n_arguments, json_extract_string(j, '$.query') AS query,
      json_extract_string(j, '$.issue_type') AS issue_type, json_extract_string(j, '$.k') AS k FROM v_args""",
)


def argument(name: str, default: str) -> str:
    return f"coalesce(nullif(json_extract_string(j, '$.{name}'), ''), '{default}')"


query(
    "tool_dispatch",
    f"""SELECT event_id, CASE WHEN tool = 'book_hotel' THEN 'error' ELSE tool END AS handler,
      CASE WHEN tool = 'submit_grievance' THEN {argument('description', '')} END AS description,
      CASE WHEN tool = 'submit_grievance' THEN {argument('issue_type', 'other')} END AS issue_type,
      CASE WHEN tool = 'submit_grievance' THEN {argument('train_number', '')} END AS train_number,
      CASE WHEN tool = 'submit_grievance' THEN {argument('pnr', '')} END AS pnr,
      CASE WHEN tool = 'submit_grievance' THEN nullif({argument('language_code', '')}, '') END AS language_code,
      CASE WHEN tool IN ('rag_search', 'web_search') THEN {argument('query', '')} END AS query,
      CASE WHEN tool = 'book_hotel' THEN 'Unknown tool: book_hotel' END AS error FROM v_args""",
)
view(
    "v_calls",
    """SELECT *, is_call AND round <= 3 AND round < coalesce(first_empty, 99) AS ran FROM (
        SELECT *, min(CASE WHEN n_calls = 0 THEN round END) OVER (PARTITION BY session, answer) AS first_empty FROM (
          SELECT * REPLACE (CASE WHEN json_valid(args) THEN CASE WHEN json_type(args) = 'OBJECT' THEN trim(args)
              ELSE '{}' END ELSE '{}' END AS args),
            count(*) FILTER (WHERE is_call) OVER (PARTITION BY session, answer, round) AS n_calls
          FROM f_tool_events))""",
)
query(
    "tool_log_array",
    """SELECT session, answer, CAST(count(*) AS INTEGER) AS n, string_agg(concat_ws('|', tool, args,
        CASE WHEN tool = 'book_hotel' THEN 'error' ELSE coalesce(sms_uri, 'success') END), chr(10) ORDER BY event_id) AS log
      FROM v_calls WHERE ran GROUP BY session, answer""",
)
query(
    "first_sms_uri",
    """SELECT session, answer, coalesce(min_by(sms_uri, event_id) FILTER
        (WHERE tool = 'submit_grievance' AND coalesce(sms_uri, '') <> ''), '') AS sms_uri
      FROM v_calls WHERE ran GROUP BY session, answer""",
)
query(
    "round_cutoff",
    """SELECT session, answer, coalesce(max(round) FILTER (WHERE ran), 0) AS rounds,
      count(*) FILTER (WHERE ran) AS n_calls FROM v_calls GROUP BY session, answer""",
)
query("tool_usage", "SELECT round, tool, count(*) AS n FROM v_calls WHERE ran GROUP BY round, tool")
wide = ", ".join(f"count(*) FILTER (WHERE tool = '{t}') AS {t}" for t in TOOLS)
query("tool_usage_wide", f"SELECT round, {wide} FROM v_calls WHERE ran GROUP BY round")
query(
    "tool_free_vs_grounded",
    "SELECT session, answer, bool_or(ran) AS grounded FROM v_calls GROUP BY session, answer",
)
query(
    "flatten_search_hits",
    """SELECT search_id, CAST(n - 1 AS INTEGER) AS place, coalesce(title, '') AS title, coalesce(url, '') AS url,
      coalesce(content, '') AS content
      FROM (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY page_id) AS n FROM f_web_hits) WHERE n <= 5""",
)
query(
    "repeat_suppression",
    """SELECT session, event_id, ident FROM (
        SELECT *, lag(ident) OVER (PARTITION BY session ORDER BY event_id) AS last FROM (
          SELECT session, event_id, coalesce(nullif(clip_id, ''), CASE WHEN clip <> '' THEN sha1(clip) END) AS ident
          FROM f_clips) WHERE ident IS NOT NULL) WHERE ident IS DISTINCT FROM last""",
)
query(
    "journey_merge",
    """SELECT event_id, CAST(len(json_keys(j)) + CASE WHEN json_exists(j, '$.journey_id') THEN 0 ELSE 1 END AS INTEGER)
        AS n_fields, coalesce(json_extract_string(j, '$.journey_id'), 'J' || event_id) AS journey_id,
      json_extract_string(j, '$.train_name') AS train_name, json_extract_string(j, '$.k') AS k
      FROM (SELECT event_id, extracted AS j FROM v_readings)""",
)
query(
    "journey_caption",
    """SELECT journey_id, trim('PNR ' || pnr || ' · ' || source_station || ' → ' ||
      coalesce(destination_station, ''), ' ·') AS caption FROM f_journey""",
)
query(
    "journey_point_read",
    """SELECT pnr, train_number, train_name, source_station, destination_station, journey_date, departure_time,
      arrival_time, class, seat_number FROM f_journey WHERE user_id = '7'
      ORDER BY created_at DESC, journey_id DESC LIMIT 1""",
)
view(
    "v_latest",
    """SELECT * FROM f_journey QUALIFY row_number() OVER
      (PARTITION BY user_id ORDER BY created_at DESC, journey_id DESC) = 1""",
)
SHOWN = "SELECT user_id, journey_id, pnr, train_number, class, seat_number, journey_date FROM v_latest"
query("latest_journey", SHOWN)
query("latest_journey_max_by", SHOWN)
query(
    "journey_status",
    """SELECT request_id, CASE WHEN c.user_id IS NULL THEN 'error' WHEN journey_id IS NULL THEN 'not_found'
        ELSE 'success' END AS status,
      CASE WHEN c.user_id IS NULL THEN 'Journey lookup not available.'
        WHEN journey_id IS NULL THEN 'No booking on file for this user.' ELSE '' END AS message,
      journey_id, l.pnr, l.train_number, class FROM v_clean c LEFT JOIN v_latest l ON c.user_id = l.user_id""",
)
query(
    "fill_from_journey",
    """SELECT request_id, coalesce(c.train_number, l.train_number) AS train_number, coalesce(c.pnr, l.pnr) AS pnr
      FROM v_clean c LEFT JOIN v_latest l ON c.user_id = l.user_id""",
)
view(
    "v_as_of",
    """SELECT r.request_id, r.user_id, r.asked_at, r.train_number, r.pnr, j.journey_id, j.class, j.created_at,
        j.train_number AS booked_train, j.pnr AS booked_pnr
      FROM (SELECT request_id, CASE WHEN trim(user_id) <> '' THEN user_id END AS user_id, asked_at, train_number,
          CASE WHEN trim(pnr) <> '' THEN pnr END AS pnr FROM f_timed_requests) r
      ASOF LEFT JOIN (SELECT * FROM f_journey
          QUALIFY row_number() OVER (PARTITION BY user_id, created_at ORDER BY journey_id DESC) = 1) j
        ON r.user_id = j.user_id AND r.asked_at >= j.created_at""",
)
query(
    "booking_as_of",
    """SELECT request_id, user_id, journey_id, class, strftime(created_at, '%Y-%m-%d') AS booked_on FROM v_as_of""",
)
query(
    "journey_status_as_of",
    """SELECT request_id, CASE WHEN user_id IS NULL THEN 'error' WHEN journey_id IS NULL THEN 'not_found'
        ELSE 'success' END AS status,
      CASE WHEN user_id IS NULL THEN 'Journey lookup not available.'
        WHEN journey_id IS NULL THEN 'No booking on file for this user.' ELSE '' END AS message,
      journey_id, booked_pnr AS pnr, booked_train AS train_number, class FROM v_as_of""",
)
query(
    "fill_from_journey_as_of",
    """SELECT request_id, coalesce(train_number, booked_train) AS train_number, coalesce(pnr, booked_pnr) AS pnr
      FROM v_as_of""",
)
query(
    "users_without_first_class",
    """SELECT user_id FROM f_users u
      WHERE NOT EXISTS (FROM f_journey j WHERE j.user_id = u.user_id AND j.class = '1A')""",
)
query(
    "users_without_journey",
    "SELECT user_id FROM f_users u WHERE NOT EXISTS (FROM f_journey j WHERE j.user_id = u.user_id)",
)
query(
    "translation_lookup",
    """SELECT request_id, coalesce(nullif(english, ''), query) AS text, detected AS source_language_code
      FROM v_prepared WHERE query IS NOT NULL""",
)
labels = ", ".join(f"('{g}', '{k}', '{t}')" for (g, k), t in UI_LABELS.items())
view("v_labels", f"SELECT * FROM (VALUES {labels}) AS t(lang, label_key, label)")
view(
    "v_ui",
    """SELECT u.*, coalesce(o.label, e.label, u.label_key) AS label,
        CASE WHEN o.label IS NOT NULL THEN 'own' WHEN e.label IS NOT NULL THEN 'english' ELSE 'none' END AS found_in
      FROM f_ui_uses u LEFT JOIN v_labels o ON o.lang = u.lang AND o.label_key = u.label_key
        LEFT JOIN v_labels e ON e.lang = 'en' AND e.label_key = u.label_key""",
)
query("ui_string_lookup", "SELECT conv_id, turn, label, found_in FROM v_ui")
query(
    "string_coverage",
    """SELECT lang, count(*) FILTER (WHERE found_in = 'own') AS n_own,
      count(*) FILTER (WHERE found_in = 'english') AS n_english, count(*) FILTER (WHERE found_in = 'none') AS n_none
      FROM (SELECT DISTINCT lang, label_key, found_in FROM v_ui) GROUP BY lang""",
)
