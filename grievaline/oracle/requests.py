"""Comparison SQL for requests, complaints and languages."""

from grievaline.functions.labels import ISSUE_LABELS, LANGUAGE_LABELS, REPLY_LANGUAGES
from grievaline.functions.scripts import SCRIPT_LANGUAGES
from grievaline.oracle.build import BLANK_CLASS, LINE_END, labelled, query, strip, view

COLUMNS = (
    "request_type query train_number pnr issue_type language_code ticket_image_base64 user_id"
).split()


def script_vote(text: str) -> str:
    counts = {
        s: f"length(regexp_replace({text}, '[^\\p{{{s}}}]', '', 'g'))" for s, _ in SCRIPT_LANGUAGES
    }
    best = "greatest(" + ", ".join(counts.values()) + ")"
    whens = " ".join(f"WHEN {counts[s]} = {best} THEN '{code}'" for s, code in SCRIPT_LANGUAGES)
    return f"CASE WHEN coalesce({best}, 0) = 0 THEN 'hi-IN' {whens} END"


clean = ", ".join(f"CASE WHEN {strip(c)} <> '' THEN {c} END AS {c}" for c in COLUMNS)
view("v_clean", f"SELECT request_id, {clean} FROM f_requests")
view(
    "v_routed",
    f"""SELECT *, CASE
      WHEN lower({strip('request_type')}) = 'chat' THEN 'chat'
      WHEN lower({strip('request_type')}) = 'ticket' OR ticket_image_base64 IS NOT NULL THEN 'ticket'
      WHEN lower({strip('request_type')}) = 'complaint' THEN 'complaint'
      WHEN query IS NOT NULL AND user_id IS NOT NULL
        AND coalesce(issue_type, pnr, train_number) IS NULL THEN 'chat'
      ELSE 'complaint' END AS route FROM v_clean""",
)
view(
    "v_filled",
    f"""SELECT request_id, route, {strip('query')} AS query, coalesce(issue_type, 'other') AS issue_type,
      coalesce(user_id, 'unknown') AS user_id, coalesce(train_number, '') AS train_number,
      coalesce(pnr, '') AS pnr, language_code, ticket_image_base64 FROM v_routed""",
)
view(
    "f_translations",
    """SELECT src, tgt, sha256(text) AS text_key, min(translated) AS translated
      FROM f_translated_turns GROUP BY src, tgt, sha256(text)""",
)
view(
    "v_spoken",
    f"SELECT *, coalesce(language_code, {script_vote('query')}) AS detected FROM v_filled",
)
view(
    "v_prepared",
    """SELECT r.*, CASE WHEN detected = 'en-IN' THEN query ELSE t.translated END AS english
      FROM v_spoken r LEFT JOIN f_translations t
        ON t.src = r.detected AND t.tgt = 'en-IN' AND t.text_key = sha256(r.query)""",
)
bare_text = strip(r"regexp_replace(regexp_replace(reply_text, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*', '')")
label = rf"(?i)^(sms{BLANK_CLASS}+complaint|complaint|output){BLANK_CLASS}*:{BLANK_CLASS}*"
view(
    "v_replies",
    f"""SELECT request_id, reply, coalesce(list_filter(list_transform(
        string_split_regex(body, '{LINE_END}'),
        lambda x: {strip(f"trim(trim({strip('x')}, '\"'), '*')")}), lambda x: length(x) > 5)[1],
        {strip('body')}) AS line
      FROM (SELECT request_id, reply, regexp_replace({bare_text}, '{label}', '') AS body
        FROM (SELECT request_id, reply, {strip('reply')} AS reply_text FROM f_model_replies))""",
)
issue_or_key = labelled(ISSUE_LABELS, "issue_type", "issue_type")
issue_or_general = labelled(ISSUE_LABELS, "issue_type", "'General Grievance'")
fallback = (
    f"{issue_or_general} || CASE WHEN train_number <> '' THEN ' Train ' || train_number ELSE '' END"
    + " || ' | ' || " + strip("substr(coalesce(nullif(english, ''), query), 1, 80)")
)
view(
    "v_worded",
    f"""SELECT p.*, r.reply, r.line, CASE WHEN line = '' THEN {fallback} ELSE line END AS raw_message,
      CASE WHEN query IS NULL THEN 'empty query' WHEN english IS NULL THEN 'no translation'
        WHEN coalesce(reply, '') = '' THEN 'empty model reply' END AS failure
      FROM v_prepared p LEFT JOIN v_replies r USING (request_id)""",
)
view(
    "v_cut",
    """SELECT *, CASE WHEN failure IS NOT NULL THEN '' ELSE
        CASE WHEN length(raw_message) > 160 THEN substr(raw_message, 1, 159) || '…' ELSE raw_message END
        || CASE WHEN pnr <> '' THEN ' PNR ' || pnr ELSE '' END END AS formatted_complaint FROM v_worded""",
)
view(
    "v_complaints",
    """SELECT request_id, route, query, user_id, issue_type, train_number, pnr, english, reply, line,
        language_code, ticket_image_base64, failure, formatted_complaint, detected,
        CASE WHEN failure IS NULL THEN 'success' ELSE 'error' END AS status,
        CASE WHEN failure IS NULL THEN 'Complaint generated' WHEN failure = 'empty query' THEN failure
          ELSE 'Failed to generate complaint' END AS message,
        failure IS NULL AND length(raw_message) > 160 AS truncated,
        CAST(length(formatted_complaint) AS INTEGER) AS char_count,
        CASE WHEN failure IS NULL THEN 'sms:139?body=' || url_encode('MADAD ' || formatted_complaint)
          ELSE '' END AS sms_uri,
        CASE WHEN failure IS NULL THEN detected ELSE '' END AS detected_language,
        CASE WHEN failure IS NOT NULL THEN 'ERROR: ' || failure ELSE concat_ws(', ',
          CASE WHEN language_code IS NULL THEN 'Language auto-detected: ' ELSE 'Language forced to: ' END || detected,
          CASE WHEN detected = 'en-IN' THEN 'Input is English — no translation needed.'
            ELSE 'Translated from ' || detected || ' to English.' END,
          CASE WHEN line = '' THEN 'LLM returned empty output — used structured fallback.' END,
          CASE WHEN length(raw_message) > 160 THEN 'Complaint truncated to 160 characters.' END) END AS engine_notes
      FROM v_cut""",
)

query("request_batch_source", "SELECT * FROM f_requests")
query("clean_request_row", "SELECT * FROM v_clean")
query("route_request", "SELECT request_id, route FROM v_routed")
query(
    "empty_query_reject",
    f"""SELECT request_id, route, {strip('query')} AS query,
      CASE WHEN query IS NULL AND route <> 'ticket' THEN 'error' ELSE 'ok' END AS status,
      CASE WHEN query IS NULL AND route <> 'ticket' THEN 'empty query' ELSE '' END AS message,
      CASE WHEN query IS NULL AND route = 'complaint' THEN 'ERROR: empty query' ELSE '' END AS engine_notes
      FROM v_routed""",
)
query(
    "default_fill",
    "SELECT request_id, issue_type, user_id, train_number, pnr, language_code FROM v_filled",
)
query(
    "phone_validate_split",
    rf"""SELECT user_id, coalesce({strip('phone')}, '') AS phone_number,
      regexp_matches(coalesce({strip('phone')}, ''), '\A\p{{Nd}}{{10}}\z') AS accepted,
      CASE WHEN regexp_matches(coalesce({strip('phone')}, ''), '\A\p{{Nd}}{{10}}\z') THEN ''
        ELSE 'Phone number must be exactly 10 digits.' END AS reason FROM f_users""",
)
query(
    "issue_label",
    f"""SELECT request_id, {issue_or_key} AS shown, {issue_or_general} AS in_fallback FROM v_filled""",
)
query(
    "prompt_lines",
    f"""SELECT request_id, 'Category: ' || {issue_or_key} ||
      CASE WHEN train_number <> '' THEN chr(10) || 'Train: ' || train_number ELSE '' END ||
      chr(10) || 'Issue: ' || english AS prompt FROM v_prepared
      WHERE route = 'complaint' AND english IS NOT NULL AND query IS NOT NULL""",
)
query("reply_clean", "SELECT request_id, line FROM v_replies")
query(
    "structured_fallback",
    """SELECT request_id, raw_message AS fallback FROM v_worded
      WHERE route = 'complaint' AND failure IS NULL AND line = ''""",
)
query(
    "truncate_160",
    """SELECT request_id, CASE WHEN length(line) > 160 THEN substr(line, 1, 159) || '…' ELSE line END AS message,
      length(line) > 160 AS truncated FROM v_replies""",
)
query(
    "append_pnr",
    """SELECT request_id, formatted_complaint, char_count FROM v_complaints
      WHERE route = 'complaint' AND failure IS NULL AND pnr <> ''""",
)
query(
    "sms_uri",
    "SELECT request_id, 'sms:139?body=' || url_encode('MADAD ' || line) AS sms_uri FROM v_replies",
)
query("engine_notes", "SELECT request_id, engine_notes FROM v_complaints WHERE route = 'complaint'")
query(
    "complaint_record",
    f"""SELECT request_id, query AS raw_input, {labelled(LANGUAGE_LABELS, 'detected', 'detected')} AS detected_language,
      {issue_or_key} AS issue_type, train_number, pnr, english AS english_translation, formatted_complaint,
      sms_uri, char_count, truncated, engine_notes
      FROM v_complaints WHERE route = 'complaint' AND failure IS NULL""",
)
query(
    "complaint_batch",
    """SELECT request_id, status, message, sms_uri, formatted_complaint, char_count, truncated,
      detected_language, engine_notes FROM v_complaints WHERE route = 'complaint'""",
)
view(
    "v_tickets",
    rf"""SELECT request_id, bare <> '' AND length(bare) % 4 = 0
        AND regexp_matches(bare, '\A[A-Za-z0-9+/]*={{0,2}}\z') AS good_image, bare,
        CASE WHEN reply NOT LIKE '%{{%' THEN '{{}}'
          WHEN json_valid(regexp_extract(reply, '(?s)\{{.*\}}')) THEN regexp_extract(reply, '(?s)\{{.*\}}')
          ELSE '{{}}' END AS reading,
        coalesce(reply NOT LIKE '%{{%' AND json_valid(reply), false) AS bad_reply
      FROM (SELECT request_id, reply, regexp_replace(CASE WHEN starts_with(image, 'data:') AND contains(image, ',')
        THEN substr(image, instr(image, ',') + 1) ELSE image END, '{BLANK_CLASS}', '', 'g') AS bare
        FROM (SELECT request_id, reply, coalesce(ticket_image_base64, '') AS image FROM v_complaints))""",
)
view(
    "v_answers",
    """SELECT session || '-' || answer AS request_id,
        '[' || string_agg('{"tool":' || to_json(tool) || ',"args":' || args || ',"result":' || to_json(CASE
          WHEN tool = 'book_hotel' THEN 'error' ELSE coalesce(sms_uri, 'success') END) || '}', ',' ORDER BY event_id)
          || ']' AS log,
        min_by(sms_uri, event_id) FILTER (WHERE tool = 'submit_grievance' AND coalesce(sms_uri, '') <> '') AS log_sms_uri
      FROM v_calls WHERE ran GROUP BY session, answer""",
)
view(
    "v_unified",
    f"""SELECT c.request_id, route AS request_type,
      CASE WHEN route = 'complaint' THEN status WHEN route = 'chat' AND query IS NULL THEN 'error'
        WHEN route = 'ticket' AND (bad_reply OR NOT good_image) THEN 'error' ELSE 'success' END AS status,
      CASE WHEN route = 'complaint' THEN message
        WHEN route = 'chat' AND query IS NULL THEN 'empty query' WHEN route = 'chat' THEN 'Chat response generated'
        WHEN NOT good_image THEN 'Failed to process ticket: invalid base64 image'
        WHEN bad_reply THEN 'Failed to process ticket: reply is not an object'
        ELSE 'Ticket processed and journey details saved' END AS message,
      CASE WHEN route = 'complaint' THEN c.sms_uri WHEN route = 'chat' AND query IS NOT NULL
        THEN coalesce(log_sms_uri, '') ELSE '' END AS sms_uri,
      CASE WHEN route = 'complaint' THEN formatted_complaint ELSE '' END AS formatted_complaint,
      CASE WHEN route = 'complaint' THEN char_count ELSE 0 END AS char_count,
      CASE WHEN route = 'complaint' THEN detected_language ELSE '' END AS detected_language,
      CASE WHEN route = 'complaint' THEN engine_notes ELSE '' END AS engine_notes,
      CASE WHEN route = 'ticket' AND good_image AND NOT bad_reply THEN sha256(concat_ws('|', c.request_id, user_id, bare)) ELSE '' END AS journey_id,
      CASE WHEN route = 'ticket' AND good_image AND NOT bad_reply THEN coalesce(reading, '{{}}') ELSE '' END AS extracted_data,
      CASE WHEN route = 'chat' AND query IS NOT NULL THEN
        coalesce({strip("regexp_replace(reply, '(?is)<think>.*?</think>', '', 'g')")}, '') ELSE '' END AS chat_reply,
      CASE WHEN route = 'chat' AND query IS NOT NULL THEN coalesce(log, '[]') ELSE '' END AS tool_log
      FROM v_complaints c JOIN v_tickets USING (request_id) LEFT JOIN v_answers a ON a.request_id = c.request_id""",
)
query("unify_output", "SELECT * FROM v_unified")
query(
    "scoring_hook",
    """SELECT request_id, '' AS request_type, 'success' AS status, '' AS message, '' AS sms_uri,
      '' AS formatted_complaint, CAST(coalesce(length(query), 0) AS INTEGER) AS char_count, '' AS detected_language,
      '' AS engine_notes, '' AS journey_id, '' AS extracted_data, '' AS chat_reply, '' AS tool_log FROM f_requests""",
)
query(
    "error_capture",
    "SELECT request_id, request_type, status, message, engine_notes FROM v_unified WHERE status = 'error'",
)
query(
    "route_counts",
    "SELECT request_type, status, count(*) AS n FROM v_unified GROUP BY request_type, status",
)
query(
    "script_language",
    f"SELECT conv_id, turn, {script_vote('text')} AS language_code FROM f_scripts",
)
codes = {c: f"{c}-IN" for c in REPLY_LANGUAGES}
names = {c: n for c, (n, _) in REPLY_LANGUAGES.items()}
scripts = {c: s for c, (_, s) in REPLY_LANGUAGES.items()}
query(
    "to_bcp47",
    f"SELECT conv_id, turn, {labelled(codes, 'lower(short_code)', repr('en-IN'))} AS language_code FROM f_scripts",
)
query(
    "language_label",
    f"""SELECT conv_id, turn, {labelled(LANGUAGE_LABELS, 'code', 'code')} AS label,
      {labelled(names, "coalesce(nullif(lower(short_code), ''), 'en')", repr('English'))} AS reply_language,
      {labelled(scripts, "coalesce(nullif(lower(short_code), ''), 'en')", repr('Latin'))} AS reply_script
      FROM (SELECT *, {script_vote('text')} AS code FROM f_scripts)""",
)
view(
    "v_rules",
    """SELECT unnest(['text_not_empty', 'link_prefix', 'length_or_truncated']) AS rule,
        unnest([formatted_complaint <> '', starts_with(sms_uri, 'sms:139'), char_count <= 160 OR truncated]) AS passed,
        request_id FROM v_complaints WHERE route = 'complaint' AND failure IS NULL
      UNION ALL
      SELECT unnest(['body_prefix', 'holds_keyword', 'pnr_when_given', 'no_blank']),
        unnest([starts_with(sms_uri, 'sms:139?body='), contains(sms_uri, 'MADAD'),
          pnr = '' OR contains(sms_uri, 'PNR'), NOT contains(sms_uri, ' ')]),
        request_id FROM v_complaints WHERE route = 'complaint' AND failure IS NULL
      UNION ALL
      SELECT unnest(['translation_over_10', 'reply_over_20', 'reply_over_10', 'language_not_empty']),
        unnest([length(english) > 10, length(reply) > 20, length(reply) > 10, detected_language <> '']),
        request_id FROM v_complaints WHERE route = 'complaint' AND failure IS NULL""",
)
CHECKS = {
    "check_complaints": ["text_not_empty", "link_prefix", "length_or_truncated"],
    "check_sms_uri": ["body_prefix", "holds_keyword", "pnr_when_given", "no_blank"],
    "check_text_lengths": ["translation_over_10", "reply_over_20", "reply_over_10", "language_not_empty"],
}
for name, rules in CHECKS.items():
    listed = ", ".join(f"'{r}'" for r in rules)
    query(
        name,
        f"""SELECT rule, count(*) FILTER (WHERE passed) AS passed, count(*) AS total, bool_and(passed) AS ok
          FROM v_rules WHERE rule IN ({listed}) GROUP BY rule""",
    )
query(
    "check_violations",
    "SELECT request_id, rule, 'AssertionError: ' || rule AS error FROM v_rules WHERE NOT passed",
)
query(
    "check_summary",
    """SELECT count(*) FILTER (WHERE ok) AS passed, count(*) AS total, bool_and(ok) AS ok
      FROM (SELECT rule, bool_and(passed) AS ok FROM v_rules GROUP BY rule)""",
)
