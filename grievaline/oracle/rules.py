"""Comparison SQL for rulebook texts and tickets."""

from grievaline.functions.payloads import TICKET_KEYS
from grievaline.oracle.build import BLANK_CLASS, query, strip, view


def flat(c: str) -> str:
    return strip(f"replace(coalesce({c}, ''), chr(10), ' ')")


view(
    "v_pages",
    f"""SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS page,
      {flat('text')} AS text FROM f_documents""",
)


def chunks_of(pages: str, extra: str = "") -> str:
    return f"""SELECT doc_id, {extra} CAST(start AS INTEGER) AS start, substr(text, start + 1, 500) AS text
      FROM (SELECT *, unnest(range(0, length(text), 450)) AS start FROM {pages})
      WHERE {strip('substr(text, start + 1, 500)')} <> ''"""


view("v_chunks", chunks_of("v_pages", "source, page,"))
view(
    "v_numbered",
    """SELECT source, page, doc_id, start, text,
      row_number() OVER (PARTITION BY source ORDER BY page, start) - 1 AS chunk_no_in_source,
      row_number() OVER (ORDER BY source, page, start) - 1 AS chunk_id FROM v_chunks""",
)
query("page_text_source", "SELECT doc_id, source, page, text FROM v_pages WHERE text <> ''")
query("flatten_page_text", "SELECT doc_id, text FROM v_pages WHERE text <> ''")
query("sliding_chunks", "SELECT doc_id, start, text FROM v_chunks")
query("chunk_no_in_source", "SELECT source, page, start, chunk_no_in_source FROM v_numbered")
query("chunk_no_global", "SELECT source, page, start, chunk_id FROM v_numbered")
query(
    "chunk_surrogate_id",
    "SELECT doc_id, start, doc_id * 16777216 + start // 450 AS id FROM v_chunks",
)
query(
    "chunk_stats",
    """SELECT source, CAST(grouping(source) AS TINYINT) AS is_total, count(*) AS n_chunks,
      CAST(sum(length(text)) AS BIGINT) AS n_chars FROM v_chunks GROUP BY ROLLUP (source)""",
)
query("chunk_table_overwrite", "SELECT source, count(*) AS n_chunks FROM v_chunks GROUP BY source")
query(
    "schema_merge_write",
    """SELECT doc_id, source, lang, md5(text) AS text_md5, CAST(NULL AS INTEGER) AS n_chars
      FROM f_new_documents""",
)
for version in ("old", "new"):
    view(f"v_{version}_flat", f"SELECT doc_id, {flat('text')} AS text FROM f_{version}_documents")
    view(f"v_{version}_chunks", chunks_of(f"v_{version}_flat"))
query(
    "change_feed",
    """SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(o.start, n.start) AS start,
      CASE WHEN o.doc_id IS NULL THEN 'insert' WHEN n.doc_id IS NULL THEN 'delete' ELSE 'update' END AS change_type
      FROM v_old_chunks o FULL OUTER JOIN v_new_chunks n ON o.doc_id = n.doc_id AND o.start = n.start
      WHERE o.text IS DISTINCT FROM n.text""",
)

IMAGE_TYPE = """CASE WHEN hex(content) LIKE 'FFD8FF%' THEN 'image/jpeg'
  WHEN hex(content) LIKE '89504E470D0A1A0A%' THEN 'image/png'
  WHEN hex(content) LIKE '52494646%' AND substr(hex(content), 17, 8) = '57454250' THEN 'image/webp'
  WHEN hex(content) LIKE '474946383761%' OR hex(content) LIKE '474946383961%' THEN 'image/gif'
  ELSE 'image/jpeg' END"""
view(
    "v_payloads",
    rf"""SELECT image_id, bare, CASE WHEN length(bare) % 4 = 0 AND regexp_matches(bare, '\A[A-Za-z0-9+/]*={{0,2}}\z')
        THEN TRY(from_base64(bare)) END AS bytes
      FROM (SELECT image_id, regexp_replace(CASE WHEN starts_with(payload, 'data:') AND contains(payload, ',')
        THEN substr(payload, instr(payload, ',') + 1) ELSE payload END, '{BLANK_CLASS}', '', 'g') AS bare FROM f_images)""",
)
query(
    "base64_payloads",
    """SELECT image_id, CASE WHEN bare = '' THEN 'No image bytes received.'
        WHEN bytes IS NULL THEN 'Failed to process ticket: invalid base64 image' ELSE '' END AS message,
      CAST(octet_length(bytes) AS INTEGER) AS n_bytes, hex(bytes) AS head FROM v_payloads""",
)
query("image_type_sniff", f"SELECT image_id, {IMAGE_TYPE} AS image_type FROM f_images")
query(
    "required_field_split",
    """SELECT event_id, user_id <> '' AND coalesce(octet_length(bytes), 0) > 0 AS accepted,
      CASE WHEN user_id = '' THEN 'user_id is required.'
        WHEN coalesce(octet_length(bytes), 0) = 0 THEN 'Empty file.' ELSE '' END AS reason
      FROM f_ticket_replies LEFT JOIN v_payloads ON image_id = event_id""",
)
view(
    "v_blobs",
    r"""SELECT event_id, user_id, reply, CASE WHEN regexp_matches(reply, '(?s)\{.*\}')
        THEN regexp_extract(reply, '(?s)\{.*\}') ELSE reply END AS blob FROM f_ticket_replies""",
)
fields = ", ".join(
    f"CASE WHEN state = 'parsed' THEN json_extract_string(blob, '$.{k}') END AS \"{k}\""
    for k in TICKET_KEYS
)
view(
    "v_readings",
    f"""SELECT *, {fields}, CASE WHEN state = 'parsed' THEN blob ELSE '{{}}' END AS extracted
      FROM (SELECT *, CASE WHEN reply = '' THEN 'empty' WHEN json_valid(blob) AND blob LIKE '{{%' THEN 'parsed'
        WHEN json_valid(reply) AND reply NOT LIKE '%{{%' THEN 'not_object' ELSE 'broken' END AS state FROM v_blobs)""",
)
listed = ", ".join(f'"{k}"' for k in TICKET_KEYS)
query("json_blob_extract", "SELECT event_id, blob FROM v_blobs")
query("ticket_json_parse", f"SELECT event_id, state, {listed} FROM v_readings")
JOURNEYS = f"""SELECT journey_id, user_id, {listed},
    '/shared/ticket_uploads/' || journey_id || '.jpg' AS ticket_image_path, reply AS extracted_data
    FROM (SELECT * EXCLUDE (user_id), coalesce(nullif(user_id, ''), 'unknown') AS user_id,
        sha256(concat_ws('|', coalesce(nullif(user_id, ''), 'unknown'), CAST(event_id AS VARCHAR), reply)) AS journey_id
      FROM v_readings WHERE state <> 'not_object')"""
query("journey_projection", JOURNEYS)
query("journey_append", JOURNEYS)
query(
    "ticket_image_path",
    "SELECT event_id, '/shared/ticket_uploads/' || event_id || '.jpg' AS path FROM f_ticket_replies",
)
query(
    "ticket_outcome",
    """SELECT event_id, CASE WHEN state = 'not_object' THEN 'error' ELSE 'success' END AS status,
      CASE WHEN state = 'not_object' THEN 'Failed to process ticket: reply is not an object'
        ELSE 'Ticket processed and journey details saved' END AS message,
      CASE WHEN state = 'not_object' THEN '' ELSE
        sha256(concat_ws('|', coalesce(nullif(user_id, ''), 'unknown'), CAST(event_id AS VARCHAR), reply)) END AS journey_id,
      CASE WHEN state = 'not_object' THEN '' ELSE extracted END AS extracted_data FROM v_readings""",
)
query(
    "ticket_parse_rates",
    f"""SELECT CASE WHEN image_id IS NULL THEN 'no image' ELSE {IMAGE_TYPE} END AS image_type,
      count(*) FILTER (WHERE state = 'parsed') AS n_parsed, count(*) FILTER (WHERE state = 'empty') AS n_empty,
      count(*) FILTER (WHERE state = 'broken') AS n_broken,
      count(*) FILTER (WHERE state = 'not_object') AS n_not_object
      FROM v_readings LEFT JOIN f_images ON image_id = event_id GROUP BY 1""",
)
query(
    "user_append",
    rf"""SELECT user_id, {strip('phone')} AS phone_number FROM f_users
      WHERE regexp_matches({strip('phone')}, '\A\p{{Nd}}{{10}}\z')""",
)
