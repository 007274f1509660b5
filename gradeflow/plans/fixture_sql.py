"""The adapters of ``fixtures`` in DuckDB's SQL, as CTEs by name."""

FIXTURES = {
    "fx_clips": """
SELECT user_id AS video_id, (row_number() OVER w - 1)::INT AS clip_no, event_type AS label,
  round(epoch_us(ts) / 1e6 - min(epoch_us(ts)) OVER (PARTITION BY user_id) / 1e6, 2) AS "start",
  round(epoch_us(ts) / 1e6 - min(epoch_us(ts)) OVER (PARTITION BY user_id) / 1e6, 2) + 30.0 AS "end"
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "fx_labels": """
SELECT (row_number() OVER (ORDER BY event_type) - 1)::INT AS label_id, event_type AS label FROM (SELECT DISTINCT event_type FROM events)""",
    "fx_successors": """
SELECT a.label, b.label AS next_label FROM fx_labels a JOIN fx_labels b ON b.label_id = (a.label_id + 1) % 5 OR b.label_id = 0""",
    "fx_frames": """
SELECT user_id AS video_id, event_id AS frame_no, epoch_us(ts) / 1e6 - min(epoch_us(ts)) OVER (PARTITION BY user_id) / 1e6 AS timestamp FROM events""",
    "fx_speaker_turns": """
SELECT conv_id AS video_id, turn::INT AS turn_no, role AS speaker, 10.0 * turn AS "start", 10.0 * turn + 8 AS "end", text FROM conversations""",
    "fx_words": """
SELECT video_id, turn, (word_no - 1)::INT AS word_no, 10.0 * turn + 0.5 * (word_no - 1) AS "start", 10.0 * turn + 0.5 * (word_no - 1) + 0.4 AS "end", words[word_no] AS text
FROM (SELECT conv_id AS video_id, turn, words, unnest(range(1, len(words) + 1)) AS word_no
      FROM (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM conversations))""",
    "fx_points": """
SELECT vec_id AS id, label AS video_id, vec_id AS frame_number, vec_id::DOUBLE AS timestamp, list_transform(embedding, lambda x: x::DOUBLE) AS clip_vec,
  list_transform(coalesce(lead(embedding) OVER (ORDER BY vec_id), first_value(embedding) OVER (ORDER BY vec_id)), lambda x: x::DOUBLE) AS desc_vec, 1 AS version FROM embeddings""",
    "fx_queries": """
SELECT id AS query_id, video_id, clip_vec AS vec_a, desc_vec AS vec_b FROM fx_points WHERE id < 10""",
    "fx_updates": """
SELECT CASE WHEN id % 7 = 0 THEN id ELSE id + 1000000 END AS id, video_id, timestamp + 1000 AS timestamp, 2 AS version FROM fx_points WHERE id % 7 = 0 OR id % 11 = 0""",
    "fx_items": """
SELECT l_orderkey AS doc_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))::INT AS item_no,
  CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS flag_no,
  CASE l_returnflag WHEN 'R' THEN 'History Taking' WHEN 'A' THEN 'Physical Examination' ELSE 'Management' END AS section,
  p_name, p_brand, l_returnflag, l_linenumber, p_name || ' (' || l_linenumber || ' points)' AS text FROM lineitem JOIN part ON p_partkey = l_partkey""",
    "fx_rubric_lines": """
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY flag_no, item_no) - 1)::INT AS line_no, text
FROM (SELECT doc_id, flag_no, 0 AS item_no, section || ' (' || 2 * count(*) || ' points)' AS text FROM fx_items GROUP BY doc_id, flag_no, section
      UNION ALL SELECT doc_id, flag_no, item_no, '- ' || text FROM fx_items)""",
    "fx_cells": """
SELECT doc_id, item_no AS row_no, [NULL, p_name, p_brand, l_returnflag, l_linenumber::VARCHAR] AS cells FROM fx_items
UNION ALL SELECT DISTINCT doc_id, 0, ['', 'Domain', '', '', 'Score'] FROM fx_items""",
    "fx_criteria": """
SELECT doc_id, item_no AS ord, section, p_name AS name, l_linenumber AS max_points, [p_name, section] AS examples FROM fx_items""",
    "fx_scores": """
SELECT l_suppkey AS student, (l_orderkey % 10)::INT AS station, l_returnflag AS domain, least(l_quantity, 10.0) AS earned, 10.0 AS possible FROM lineitem""",
    "fx_videos": """
SELECT o_orderkey AS id, o_orderdate AS created_at, floor(o_totalprice)::BIGINT AS frames, (o_custkey % 3 * 15)::DOUBLE AS fps FROM orders""",
    "fx_lines": """
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS line_no, line AS text FROM (
  SELECT doc_id, i, trim(parts[i], E' \\t\\n\\r\\x0B\\x0C') AS line
  FROM (SELECT doc_id, string_split(text, E'\\n') AS parts, unnest(range(1, len(string_split(text, E'\\n')) + 1)) AS i FROM documents WHERE text IS NOT NULL)) WHERE line <> ''""",
    "fx_responses": """
SELECT event_id AS response_id, user_id AS question_id,
  CASE WHEN event_id % 10 = 9 THEN 'no json here' ELSE E'```json\\n{"grade": ' || (event_id % 7 - 1) || ', "rationale": "' || repeat('seen ', (event_id % 4)::INT) || E'"}\\n```' END AS raw FROM events""",
    "fx_outputs": """
SELECT (user_id % 20)::INT AS video_id, user_id AS question_id, event_type AS tool, (row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id))::INT AS item_no,
  (props::JSON->>'k')::INT AS k, round(value / 1000, 6) AS confidence FROM events""",
}
