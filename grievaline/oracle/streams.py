"""Comparison SQL for streams: what the tables give once everything has arrived."""

from grievaline.oracle.build import QUERIES, query, view

query("registration_stream", QUERIES["user_append"])
query("request_stream", QUERIES["unify_output"])
query("latest_journey_stream", QUERIES["latest_journey"])
query("latest_journey_changes", QUERIES["latest_journey"])
view(
    "v_new_slots",
    """SELECT doc_id, start, text, list_transform(list_filter(
        string_split_regex(lower(text), '[^\\p{L}\\p{Nd}]+'), lambda w: w <> ''),
        lambda w: CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % 64) AS slots FROM v_new_chunks""",
)
query(
    "triggered_index_sync",
    """SELECT n.doc_id * 16777216 + n.start // 450 AS id, n.doc_id, sha256(n.text) AS digest,
      array_to_string(list_transform(range(64), lambda d: len(list_filter(slots, lambda s: s = d))), ',') AS vec,
      n.text IS DISTINCT FROM o.text AS embedded_by_sync
      FROM v_new_slots n LEFT JOIN v_old_chunks o ON o.doc_id = n.doc_id AND o.start = n.start""",
)
