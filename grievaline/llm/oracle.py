"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"
TERMS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
    SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p
), f AS (
    SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 100 OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

OP7 = f"""
WITH items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER}, '{TERMS}') AS w FROM benchmark
    WHERE item_id IS NOT NULL
), windows AS (
    SELECT DISTINCT item, len(w[i : i + 9]) AS width, w[i : i + 9] AS gram
    FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0
), docs AS (
    SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '{TERMS}'), []) AS w FROM documents
), grams AS (
    SELECT doc_id, i, width, w[i : i + width - 1] AS gram
    FROM docs, (SELECT DISTINCT width FROM windows) AS x, unnest(range(1, len(w) - width + 2)) AS t(i)
    WHERE len(w) >= width
), found AS (
    SELECT DISTINCT doc_id, i, grams.width, item FROM grams JOIN windows USING (gram)
), hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + width)) AS t(p) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
    FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs AS d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

# Control strings of common templates behind their first character, as the operator has them.
CONTROLS = r"\|im_start\||\|im_end\||\|endoftext\||/?s>|/?INST\]|\|eot_id\||/?SYS>"


def escaped(column: str) -> str:
    return rf"regexp_replace({column}, '([<\[])(\\*)({CONTROLS})', '\1\\\2\3', 'g')"


OP9 = f"""
WITH turns AS (
    SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), made AS (
    SELECT conv_id, turn, role || chr(10) || text || chr(10) AS line,
           CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
           length('<|im_start|>' || {escaped("role")} || chr(10) || {escaped("text")} || '<|im_end|>' || chr(10)) AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(line, '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn)) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM made GROUP BY conv_id
"""

OP10 = f"""
WITH docs AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS BIGINT) AS size
    FROM documents
), sums AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS words, row_number() OVER (ORDER BY source NULLS LAST) AS n
    FROM docs GROUP BY source
), weighted AS (
    SELECT source, words, CAST(list_extract([3, 1, 2], (n - 1) % 3 + 1) AS BIGINT) AS weight, n FROM sums
), levels AS (
    SELECT *, CAST(sum(words) OVER () AS DOUBLE) * 1.5::DOUBLE
              - CAST(coalesce(sum(words) OVER before, 0) AS DOUBLE) * 2.0::DOUBLE AS rest,
           CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS open,
           row_number() OVER (ORDER BY words / weight, n) AS place
    FROM weighted
    WINDOW before AS (ORDER BY words / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
    SELECT arg_min(rest / open, place) AS level FROM levels WHERE rest / open * weight <= words * 2.0::DOUBLE
), plan AS (
    SELECT source, words AS source_size,
           coalesce(least(level * weight, words * 2.0::DOUBLE), words * 2.0::DOUBLE) AS target,
           CAST(CAST('0x' || substr(md5('1:' || coalesce('s' || source, 'null')), 1, 8) AS BIGINT) AS DOUBLE)
           / 4294967296.0::DOUBLE AS shift
    FROM weighted LEFT JOIN level ON true
), ranked AS (
    SELECT doc_id, d.size, source_size, target, shift,
           CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
           row_number() OVER (PARTITION BY d.source ORDER BY d.size, doc_id NULLS FIRST) - 1 AS rank
    FROM docs AS d JOIN plan AS p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor((rank + 1) * rate + shift) - floor(rank * rate + shift)) AS BIGINT) AS taken
FROM ranked
"""

OP12 = f"""
WITH docs AS (
    SELECT doc_id, regexp_extract_all({LOWER}, '{TERMS}') AS w FROM documents
), totals AS (
    SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM docs WHERE len(w) > 0
), postings AS (
    SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM docs)
    GROUP BY ALL
), asked AS (
    SELECT item_id, term, count(*) AS qtf
    FROM (SELECT item_id, unnest(regexp_extract_all({LOWER}, '{TERMS}')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark))
    GROUP BY ALL
), weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), totals
), scores AS (
    SELECT item_id, doc_id, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_words)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN postings USING (term), totals
    GROUP BY ALL HAVING score > 0
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores QUALIFY rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_from_arc": OP2,
        "op7_benchmark_decontamination": OP7,
        "op9_chat_formatting": OP9,
        "op10_mixing": OP10,
        "op12_ranked_search": OP12,
    }
