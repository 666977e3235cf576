"""The catalogue in plain SQL, for a side-by-side check by another engine.

Written from the meaning of each query: sets, windows and recursion where the
Spark side works on arrays, slices or ordered passes.
"""

from __future__ import annotations

from parchmill import schemas as S
from parchmill.functions.decoding import CP1251_CHARS, LATIN1_CHARS
from parchmill.functions.text import SENTENCE_BREAK, SPACE_CLASS, TOKEN_BREAK, WORD_OR_GAP
from parchmill.operators import logs
from parchmill.plans.inputs import LEXICON, WINDOW_US


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(expr: str) -> str:
    return rf"regexp_replace({expr}, '^{SPACE_CLASS}+|{SPACE_CLASS}+\z', '', 'g')"


def _words(expr: str) -> str:
    return f"[w FOR w IN string_split_regex(lower({expr}), '{TOKEN_BREAK}') IF w <> '']"


def _first_tokens(expr: str, n: int) -> str:
    token = r"[ \t\n\x0B\f\r]*[^ \t\n\x0B\f\r]{1,32}"
    return f"array_to_string(list_slice(regexp_extract_all({expr}, '{token}'), 1, {n}), '')"


def _question(expr: str) -> str:
    stripped = _strip(expr)
    return f"CASE WHEN ends_with({stripped}, '?') THEN {stripped} ELSE {stripped} || '?' END"


REQUESTS = "req AS (SELECT doc_id, 'd' || doc_id AS request_id, text FROM documents)"
ASKED = """asked AS (
  SELECT 'q-' || c.conv_id || '-' || c.turn AS request_id, d.doc_id, d.text, c.text AS question, c.turn
  FROM conversations c JOIN documents d ON d.doc_id = c.conv_id WHERE c.role = 'user')"""
EV = r"""ev AS (
  SELECT event_id, user_id, epoch_us(ts) AS ts_us, event_type,
         CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k,
         CAST(round(value * 4000) AS BIGINT) AS latency_ms
  FROM events)"""
BOT_EV = """sent AS (
  SELECT event_id, user_id, ts_us, latency_ms,
         CASE event_type WHEN 'purchase' THEN 'file' WHEN 'signup' THEN 'enter' WHEN 'error' THEN 'exit'
              ELSE 'text' END AS kind,
         CASE WHEN event_type = 'purchase' THEN k END AS file_key,
         CASE WHEN event_type = 'purchase' THEN sha256('file-' || k) END AS content_sha, k
  FROM ev)"""
PLAIN_BEV = "bev AS (SELECT * FROM sent)"
LIMITED = f"""hits AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS rn
  FROM bev WHERE kind IN ('text', 'file')),
lim AS (
  SELECT user_id, rn, event_id, ts_us AS window_start_us, CAST(1 AS BIGINT) AS n_in_window FROM hits WHERE rn = 1
  UNION ALL
  SELECT h.user_id, h.rn, h.event_id,
         CASE WHEN h.ts_us >= l.window_start_us + {WINDOW_US} THEN h.ts_us ELSE l.window_start_us END,
         CASE WHEN h.ts_us >= l.window_start_us + {WINDOW_US} THEN 1 ELSE l.n_in_window + 1 END
  FROM lim l JOIN hits h ON h.user_id = l.user_id AND h.rn = l.rn + 1),
counted AS (
  SELECT h.*, l.window_start_us, l.n_in_window, l.n_in_window > {S.RATE_LIMIT} AS limited
  FROM hits h JOIN lim l USING (event_id))"""
# The bot looks every two seconds, at 2 s first and at 240 s last.
SEEN_US = "ts_us + 2000000 * greatest((latency_ms + 1999) // 2000, 1)"
MESSAGES = f"""cache AS (
  SELECT content_sha, min(done_us) AS ready_us, arg_min(body, (done_us, event_id)) AS cached
  FROM (SELECT *, {SEEN_US} AS done_us FROM counted WHERE kind = 'file' AND NOT limited AND latency_ms <= 240000)
  GROUP BY content_sha),
msg AS (
  SELECT c.*, cached,
         coalesce(c.kind = 'file' AND NOT c.limited AND c.ts_us >= k.ready_us, false) AS hit
  FROM counted c LEFT JOIN cache k USING (content_sha)),
flow AS (
  SELECT event_id, user_id, ts_us, 1 AS rank, kind, file_key, latency_ms, limited, hit,
         CASE WHEN hit THEN cached END AS cached, body, error, answer, answer_ms, answer_error FROM msg
  UNION ALL
  SELECT event_id, user_id, ts_us, 1, kind, NULL, NULL, false, false, NULL, NULL, NULL, NULL, NULL, NULL
  FROM bev WHERE kind IN ('enter', 'exit')
  UNION ALL
  SELECT event_id, user_id, {SEEN_US}, 0, 'done', file_key, NULL, false, false, NULL, NULL, NULL, NULL, NULL, NULL
  FROM msg WHERE kind = 'file' AND NOT limited AND NOT hit AND latency_ms <= 240000),
sess AS (
  SELECT *,
    last_value(CASE WHEN kind = 'enter' THEN 1
                    WHEN kind = 'exit' OR (kind = 'file' AND NOT limited AND NOT hit) THEN 0 END IGNORE NULLS)
      OVER w AS mode,
    nullif(last_value(CASE WHEN kind = 'done' THEN file_key WHEN kind = 'exit' THEN -1 END IGNORE NULLS)
      OVER w, -1) AS last_file
  FROM flow
  WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, rank, event_id
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
routed AS (
  SELECT *, CASE WHEN kind IN ('enter', 'exit') THEN kind
                 WHEN limited THEN 'rate_limited'
                 WHEN hit THEN 'cache_hit'
                 WHEN kind = 'file' THEN 'summarize_file'
                 WHEN mode = 1 AND last_file IS NULL THEN 'qa_no_file'
                 WHEN mode = 1 THEN 'question'
                 ELSE 'summarize_text' END AS route
  FROM sess WHERE kind <> 'done')"""
WEB = r"""wev AS (
  SELECT event_id, user_id, ts_us, k, latency_ms,
         CASE event_type WHEN 'purchase' THEN 'upload' WHEN 'signup' THEN 'ask' WHEN 'error' THEN 'continue'
              ELSE 'text' END AS kind,
         CASE WHEN k % 10 = 0 THEN '' ELSE 'q' || k END AS typed
  FROM ev),
seg AS (
  SELECT *, last_value(CASE WHEN kind = 'upload' THEN event_id END IGNORE NULLS) OVER (
              PARTITION BY user_id ORDER BY ts_us, event_id
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS segment
  FROM wev),
act AS (
  SELECT *, CASE WHEN segment IS NOT NULL THEN
              first_value(CASE kind WHEN 'ask' THEN 'question' WHEN 'continue' THEN kind END IGNORE NULLS) OVER (
                PARTITION BY user_id, segment ORDER BY ts_us, event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS action
  FROM seg),
web AS (
  SELECT *,
    CASE WHEN kind = 'upload' THEN 'summarize_file'
         WHEN kind = 'continue' AND segment IS NOT NULL AND action IS NULL THEN 'summarize_file'
         WHEN kind = 'ask' AND segment IS NOT NULL AND action IS NULL THEN 'prompt'
         WHEN kind IN ('ask', 'continue') THEN 'ignored'
         WHEN typed = '' THEN 'ignored'
         WHEN action = 'question' THEN 'question'
         ELSE 'summarize_text' END AS route,
    CASE WHEN kind = 'continue' OR (kind = 'text' AND action IS NOT NULL) THEN 'after' ELSE 'main' END AS target
  FROM act)"""
STATE = f"""slog AS (
  SELECT user_id || '-' || (k % 20) AS request_id, 'processing' AS value, 0 AS state_rank, true AS ok, ts_us FROM ev
  UNION ALL
  SELECT user_id || '-' || (k % 20),
         CASE WHEN event_type = 'signup' THEN {_lit(S.SUMMARY_FAILED)} WHEN k % 25 = 0 THEN ''
              ELSE 'result ' || event_id END,
         1, event_type <> 'signup', ts_us + latency_ms * 1000
  FROM ev WHERE event_type <> 'error'),
latest AS (
  SELECT request_id, value, ok, ts_us FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY ts_us DESC, state_rank DESC, value DESC) AS rn
    FROM slog) WHERE rn = 1)"""
TURNS = f"""turns AS (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' WHEN 'system' THEN 'file' ELSE 'model' END AS type,
         CASE WHEN role = 'system' THEN replace({_lit(S.WEB_UPLOADED)}, '{{}}', 'f' || conv_id || '.txt')
              WHEN role = 'assistant' AND (length(text) % 7 = 0 OR text = '') THEN {_lit(S.WEB_NO_SUMMARY)}
              ELSE text END AS shown,
         CASE WHEN role <> 'system' AND turn % 4 >= 2 THEN 'after' ELSE 'main' END AS target,
         role = 'assistant' AND length(text) % 5 = 0 AS asks,
         CASE WHEN role = 'system' THEN 'f' || conv_id || '.txt' END AS file_name,
         CASE WHEN role = 'system' THEN CAST(length(text) AS BIGINT) END AS file_size
  FROM conversations)"""
SENTENCES = f"""parts AS (SELECT id, string_split_regex(body, '{SENTENCE_BREAK}') AS p FROM body),
sent AS (
  SELECT id, pos, s, words, len(words) AS n FROM (
    SELECT id, pos, s, {_words("s")} AS words FROM (
      SELECT id, unnest(p) AS s, generate_subscripts(p, 1) AS pos FROM parts))
  WHERE len(words) > 0)"""
SUMMARY = f"""body AS (SELECT doc_id AS id, {_first_tokens("text", S.SUMMARY.max_input_tokens - 1)} AS body FROM documents),
{SENTENCES},
word AS (SELECT id, pos, unnest(words) AS w FROM sent),
tf AS (SELECT id, w, count(*) AS c FROM word GROUP BY id, w),
score AS (
  SELECT id, pos, CAST(sum(c) AS BIGINT) * 1000000 // count(*) AS score FROM word JOIN tf USING (id, w)
  GROUP BY id, pos),
ranked AS (
  SELECT id, pos, s, n, row_number() OVER o AS rk, sum(n) OVER o AS cum
  FROM sent JOIN score USING (id, pos) WINDOW o AS (PARTITION BY id ORDER BY score DESC, pos)),
kept AS (
  SELECT id, pos, CASE WHEN n > {S.SUMMARY.max_tokens} THEN {_first_tokens("s", S.SUMMARY.max_tokens)} ELSE s END AS s
  FROM ranked
  WHERE rk = 1 OR (cum - n < {S.SUMMARY.min_tokens} AND cum <= {S.SUMMARY.max_tokens})),
summed AS (
  SELECT d.doc_id, count(k.id) > 0 AS ok, coalesce(string_agg(k.s, ' ' ORDER BY k.pos), '') AS summary
  FROM documents d LEFT JOIN kept k ON k.id = d.doc_id GROUP BY d.doc_id)"""

ANSWERS = f"""body AS (SELECT request_id AS id, substring(text, 1, {S.CONTEXT_CHARS}) AS body FROM asked),
{SENTENCES},
qword AS (
  SELECT DISTINCT request_id AS id, unnest({_words(_question("question"))}) AS w FROM asked),
sword AS (SELECT DISTINCT id, pos, unnest(words) AS w FROM sent),
score AS (
  SELECT s.id, s.pos, count(q.w) AS score FROM sword s LEFT JOIN qword q ON q.id = s.id AND q.w = s.w
  GROUP BY s.id, s.pos),
best AS (
  SELECT id, pos, score FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) AS rk FROM score) WHERE rk = 1),
tail AS (
  SELECT s.id, s.pos, s.s, sum(s.n) OVER (PARTITION BY s.id ORDER BY s.pos) - s.n AS before
  FROM sent s JOIN best b ON b.id = s.id AND s.pos >= b.pos AND b.score > 0),
ans AS (
  SELECT id, {_first_tokens("string_agg(s, ' ' ORDER BY pos)", S.ANSWER.max_tokens)} AS a
  FROM tail WHERE before < {S.ANSWER.min_tokens} GROUP BY id),
answered AS (
  SELECT k.request_id, coalesce(length(a) >= {S.MIN_ANSWER_CHARS}, false) AS ok, coalesce(b.score, 0) AS score,
         CASE WHEN length(a) >= {S.MIN_ANSWER_CHARS} THEN a ELSE {_lit(S.ANSWER_NOT_FOUND)} END AS answer
  FROM asked k LEFT JOIN ans ON ans.id = k.request_id LEFT JOIN best b ON b.id = k.request_id)"""

# The summary of document k, and the answer to its first question; some uploads are refused.
BOT_RESULTS = f"""made AS (SELECT doc_id AS k, nullif(summary, '') AS body FROM (WITH {SUMMARY} SELECT * FROM summed)),
told AS (
  SELECT doc_id AS k, arg_min(nullif(answer, ''), turn) AS answer
  FROM (WITH {ASKED}, {ANSWERS} SELECT asked.doc_id, asked.turn, answered.answer FROM asked JOIN answered USING (request_id))
  GROUP BY doc_id),
bev AS (
  SELECT s.event_id, s.user_id, s.ts_us, s.kind, s.file_key, s.content_sha, made.body, told.answer,
         CASE WHEN kind = 'file' AND s.k % 10 = 7 THEN {_lit(S.EXTRACT_FAILED)} END AS error,
         CASE WHEN kind = 'text' AND s.k % 10 = 3 THEN {_lit(S.EXTRACT_FAILED)} END AS answer_error,
         CASE WHEN made.body IS NOT NULL AND NOT (kind = 'file' AND s.k % 10 = 7) THEN s.latency_ms END AS latency_ms,
         CASE WHEN told.answer IS NOT NULL AND s.k % 10 <> 3 THEN s.latency_ms END AS answer_ms
  FROM sent s LEFT JOIN made USING (k) LEFT JOIN told USING (k))"""
BOT = f"WITH RECURSIVE {EV}, {BOT_EV}, {BOT_RESULTS}, {LIMITED}, {MESSAGES}"
FILE_CACHE = f"""{EV}, {BOT_EV}, {BOT_RESULTS}, cache AS (
  SELECT content_sha, min(done_us) AS ready_us, arg_min(body, (done_us, event_id)) AS summary
  FROM (SELECT *, {SEEN_US} AS done_us FROM bev WHERE kind = 'file' AND latency_ms <= 240000)
  GROUP BY content_sha)"""


def _pages() -> str:
    return """pages AS (
  SELECT doc_id, CAST(i AS BIGINT) AS page_no, substring(text, CAST(i * 1000 + 1 AS BIGINT), 1000) AS text
  FROM (SELECT doc_id, text, unnest(range(greatest(length(text) - 1, 0) // 1000 + 1)) AS i FROM documents))"""


def _chunks() -> str:
    n = S.CHUNK_CHARS
    return f"""chunk AS (
  SELECT doc_id, CAST(i AS BIGINT) AS pos, substring(text, CAST(i * {n} + 1 AS BIGINT), {n}) AS chunk
  FROM (SELECT doc_id, text, unnest(range(greatest(length(text) - 1, 0) // {n} + 1)) AS i FROM documents))"""


def _log_rows() -> str:
    """Log rows straight from the events, without rendering and parsing lines."""

    def msg(*parts: str) -> str:
        return " || ".join(parts)

    rid = "md5(CAST(event_id AS VARCHAR))"
    return f"""lrow AS (
  SELECT event_id, ts_us // 1000 AS ts_ms, 'INFO' AS level, 11 AS line, 'summary_start' AS event, {rid} AS request_id,
         k AS n_chars, {msg(_lit(logs.SUMMARY_START), rid, _lit(", " + logs.TEXT_LENGTH), "k")} AS message
  FROM ev WHERE event_type IN ('view', 'click')
  UNION ALL
  SELECT event_id, (ts_us + latency_ms * 1000) // 1000, 'INFO', 12, 'summary_end', {rid}, NULL,
         {msg(_lit(logs.SUMMARY_END), rid)}
  FROM ev WHERE event_type IN ('view', 'click')
  UNION ALL
  SELECT event_id, ts_us // 1000, 'INFO', 13, 'question_start', {rid}, k,
         {msg(_lit(logs.QUESTION_START), rid, "', вопрос=q, '", "k", _lit("?, " + logs.CONTEXT_LENGTH), "k")}
  FROM ev WHERE event_type = 'signup'
  UNION ALL
  SELECT event_id, (ts_us + latency_ms * 1000) // 1000, 'INFO', 14, 'question_end', {rid}, NULL,
         {msg(_lit(logs.QUESTION_END), rid)}
  FROM ev WHERE event_type = 'signup'
  UNION ALL
  SELECT event_id, ts_us // 1000, 'ERROR', 15, 'bad_frame', NULL, NULL, {msg(_lit(logs.BAD_FRAME), "k")}
  FROM ev WHERE event_type = 'error'
  UNION ALL
  SELECT event_id, ts_us // 1000, 'ERROR', 16, 'broker_down', NULL, NULL,
         {_lit(logs.BROKER_DOWN + "NoBrokersAvailable")}
  FROM ev WHERE event_type = 'purchase'),
paired AS (
  SELECT request_id, min(split_part(event, '_', 1)) AS service, max(n_chars) AS n_chars,
         max(CASE WHEN event LIKE '%_end' THEN ts_ms END) - min(CASE WHEN event LIKE '%_start' THEN ts_ms END)
           AS latency_ms
  FROM lrow WHERE request_id IS NOT NULL GROUP BY request_id)"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    sql["frame_summarize"] = f"""WITH {REQUESTS}
SELECT request_id, 'summarize' AS topic, sha256(request_id || '|' || text) AS frame_sha,
       CAST(strlen(request_id || '|' || text) AS BIGINT) AS n_bytes FROM req"""

    sql["frame_question"] = f"""WITH {ASKED}, f AS (
  SELECT request_id, request_id || '|' || text || '|' || question AS frame FROM asked)
SELECT request_id, 'question' AS topic, sha256(frame) AS frame_sha, CAST(strlen(frame) AS BIGINT) AS n_bytes FROM f"""

    sql["json_frames"] = f"""WITH {REQUESTS}, {ASKED}
SELECT 'summarize' AS topic, request_id, sha256(text) AS text_sha, NULL AS question_sha FROM req
UNION ALL SELECT 'question', request_id, sha256(text), sha256(question) FROM asked"""

    sql["parse_summarize"] = f"""WITH {REQUESTS}, f AS (
  SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN replace(text, '|', ' ') ELSE request_id || '|' || text END AS v
  FROM req), p AS (SELECT *, strpos(v, '|') AS cut_at FROM f)
SELECT doc_id, CASE WHEN cut_at = 0 THEN 'malformed frame' END AS reason,
       CASE WHEN cut_at > 0 THEN substring(v, 1, cut_at - 1) END AS request_id,
       CASE WHEN cut_at > 0 THEN sha256(substring(v, cut_at + 1)) END AS text_sha,
       CASE WHEN cut_at > 0 THEN CAST(length(substring(v, cut_at + 1)) AS BIGINT) END AS n_chars FROM p"""

    question_rows = f"""{ASKED}, qf AS (
  SELECT request_id AS key, CASE WHEN doc_id % 5 = 2 THEN request_id || '|' || replace(text, '|', ' ')
         ELSE request_id || '|' || text || '|' || question END AS v FROM asked),
qp AS (
  SELECT key, substring(v, 1, strpos(v, '|') - 1) AS rid, substring(v, strpos(v, '|') + 1) AS rest FROM qf),
qx AS (
  SELECT key, rid, strpos(rest, '|') AS cut_at, substring(rest, 1, strpos(rest, '|') - 1) AS context,
         substring(rest, strpos(rest, '|') + 1) AS question FROM qp)"""
    sql["parse_question"] = f"""WITH {question_rows}
SELECT key, CASE WHEN cut_at = 0 THEN 'malformed frame' END AS reason,
       CASE WHEN cut_at > 0 THEN rid END AS request_id,
       CASE WHEN cut_at > 0 THEN sha256(context) END AS context_sha,
       CASE WHEN cut_at > 0 THEN sha256(question) END AS question_sha FROM qx"""

    sql["route_topics"] = f"""WITH {REQUESTS}, {question_rows}, r AS (
  SELECT 'summarize' AS topic, 'ok' AS verdict, length(text) AS t, 0 AS q FROM req
  UNION ALL
  SELECT 'question', CASE WHEN cut_at = 0 THEN 'malformed frame' ELSE 'ok' END,
         CASE WHEN cut_at > 0 THEN length(context) ELSE 0 END, CASE WHEN cut_at > 0 THEN length(question) ELSE 0 END FROM qx)
SELECT topic, verdict, count(*) AS n_rows, CAST(sum(t) AS BIGINT) AS text_chars, CAST(sum(q) AS BIGINT) AS question_chars
FROM r GROUP BY topic, verdict"""

    sql["route_files"] = f"""WITH f AS (
  SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '.TXT' WHEN 1 THEN '.pdf' WHEN 2 THEN '.docx' WHEN 3 THEN '.doc'
                 ELSE '' END AS e, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS body FROM documents),
t AS (
  SELECT doc_id, 'dir.x/f' || doc_id || e AS filename, lower(e) AS ext,
         CASE WHEN e IN ('.TXT', '.docx') THEN body WHEN e = '.pdf' THEN replace(body, chr(12), '') ELSE '' END AS text
  FROM f)
SELECT doc_id, filename, ext, ext IN ('.txt', '.doc', '.docx', '.pdf') AS accepted,
       CASE WHEN text = '' THEN {_lit(S.EXTRACT_FAILED)} END AS error, CAST(length(text) AS BIGINT) AS n_chars FROM t"""

    sql["file_lifecycle"] = f"""WITH f AS (
  SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '.TXT' WHEN 1 THEN '.pdf' WHEN 2 THEN '.docx' WHEN 3 THEN '.doc'
                 ELSE '' END AS e, CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END AS body FROM documents),
u AS (
  SELECT doc_id, 'dir.x/f' || doc_id || e AS path, body = '' OR e IN ('.doc', '') AS refused,
         sha256('dir.x/f' || doc_id || e || '|' || doc_id * 1000000 || '|' || strlen(body)) AS h FROM f),
made AS (SELECT doc_id, summary, ok FROM (WITH {SUMMARY} SELECT * FROM summed))
SELECT path, CASE WHEN NOT refused THEN concat_ws('-', h[1:8], h[9:12], h[13:16], h[17:20], h[21:32]) END AS request_id,
       CASE WHEN refused THEN {_lit(S.EXTRACT_FAILED)} END AS error,
       CASE WHEN refused THEN 'refused' WHEN summary <> '' THEN 'done' ELSE 'not_found' END AS status,
       NOT refused AND summary <> '' AND ok AS ok,
       CASE WHEN NOT refused AND summary <> '' THEN sha256(summary) END AS summary_sha
FROM u JOIN made USING (doc_id)"""

    sql["decode_text"] = rf"""SELECT doc_id, sha256(CASE
    WHEN doc_id % 2 = 1 AND NOT regexp_matches(text, '[^\x{{00}}-\x{{FF}}]')
    THEN translate(text, {_lit(LATIN1_CHARS)}, {_lit(CP1251_CHARS)}) ELSE text END) AS text_sha
FROM documents"""

    blank_or = rf"CASE WHEN doc_id % 4 = 0 OR page_no % 5 = 3 THEN ' ' || chr(10) ELSE text END"
    sql["assemble_pages"] = f"""WITH {_pages()}, a AS (
  SELECT doc_id, string_agg({blank_or}, '' ORDER BY page_no) AS printed,
         string_agg('ocr:' || text, '' ORDER BY page_no) AS recognized
  FROM pages GROUP BY doc_id), b AS (SELECT *, {_strip("printed")} = '' AS by_ocr FROM a)
SELECT doc_id, by_ocr, sha256(CASE WHEN by_ocr THEN recognized ELSE printed END) AS text_sha FROM b"""

    sql["chunk_text"] = f"""WITH {_chunks()}
SELECT doc_id, pos, CAST(length(chunk) AS BIGINT) AS n_chars, sha256(chunk) AS chunk_sha FROM chunk"""

    padded = "chr(9) || '  ' || text || CASE WHEN (conv_id + turn) % 3 = 0 THEN '?' ELSE '' END || '  ' || chr(13) || chr(10)"
    sql["normalize_questions"] = f"""WITH q AS (
  SELECT 'q-' || conv_id || '-' || turn AS request_id, {padded} AS question FROM conversations WHERE role = 'user')
SELECT request_id, {_question("question")} AS question FROM q"""

    prompt = (
        f"'question: ' || {_question('question')} || ' context: ' || substring(text, 1, {S.CONTEXT_CHARS}) || "
        "' Give a detailed and comprehensive answer based on the context.'"
    )
    sql["qa_prompts"] = f"""WITH {ASKED}, p AS (SELECT request_id, {prompt} AS prompt FROM asked)
SELECT request_id, md5(prompt) AS prompt_md5, CAST(length(prompt) AS BIGINT) AS n_chars FROM p"""

    sql["summarize_documents"] = f"""WITH {SUMMARY}
SELECT doc_id, ok, sha256(summary) AS summary_sha, CAST(length(summary) AS BIGINT) AS n_chars FROM summed"""

    sql["answer_questions"] = f"""WITH {ASKED}, {ANSWERS}
SELECT request_id, ok, score, sha256(answer) AS answer_sha, CAST(length(answer) AS BIGINT) AS n_chars FROM answered"""

    sql["translate_identity"] = f"""WITH {_chunks()}, t AS (
  SELECT doc_id, string_agg(chunk, ' ' ORDER BY pos) AS t FROM chunk GROUP BY doc_id)
SELECT doc_id, sha256(t) AS text_sha, CAST(length(t) AS BIGINT) AS n_chars FROM t"""

    entries = ", ".join(f"({_lit(s)}, {_lit(t)})" for s, t in LEXICON.items())

    def by_lexicon(name: str, source: str) -> str:
        return f"""{name}_runs AS (
  SELECT doc_id, pos, unnest(r) AS run, generate_subscripts(r, 1) AS i FROM (
    SELECT doc_id, pos, regexp_extract_all(chunk, '{WORD_OR_GAP}') AS r FROM {source})),
{name}_pieces AS (
  SELECT doc_id, pos, string_agg(coalesce(tgt, run), '' ORDER BY i) AS piece
  FROM {name}_runs LEFT JOIN lex ON src = lower(run) GROUP BY doc_id, pos),
{name} AS (SELECT doc_id, string_agg(piece, ' ' ORDER BY pos) AS t FROM {name}_pieces GROUP BY doc_id)"""

    sql["translate_lexicon"] = f"""WITH lex(src, tgt) AS (VALUES {entries}), {_chunks()},
whole AS (SELECT doc_id, 0 AS pos, text AS chunk FROM documents),
{by_lexicon("cut", "chunk")}, {by_lexicon("uncut", "whole")}
SELECT d.doc_id, sha256(coalesce(c.t, '')) AS text_sha, sha256(coalesce(u.t, '')) AS unchunked_sha
FROM documents d LEFT JOIN cut c USING (doc_id) LEFT JOIN uncut u USING (doc_id)"""

    sql["translate_lexicon_large"] = f"""WITH lex AS (
  SELECT DISTINCT src, '<' || src || '>' AS tgt
  FROM (SELECT unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) AS src FROM conversations)), {_chunks()},
{by_lexicon("cut", "chunk")}
SELECT d.doc_id, sha256(coalesce(c.t, '')) AS text_sha FROM documents d LEFT JOIN cut c USING (doc_id)"""

    sql["status_latest"] = f"WITH {EV}, {STATE} SELECT request_id, value, ok, ts_us FROM latest"

    sql["status_lookup"] = f"""WITH {EV}, {STATE}, ask AS (SELECT event_id, user_id || '-' || k AS request_id FROM ev)
SELECT a.event_id, a.request_id,
       CASE WHEN value IS NULL OR value = '' THEN 'not_found' WHEN value = 'processing' THEN 'processing'
            ELSE 'done' END AS status,
       CASE WHEN value NOT IN ('', 'processing') THEN value END AS summary,
       coalesce(value <> '' AND ok, false) AS ok
FROM ask a LEFT JOIN latest USING (request_id)"""

    sql["cache_build"] = f"""WITH {FILE_CACHE}
SELECT 'filecache:' || content_sha AS cache_key, ready_us, summary FROM cache"""

    sql["cache_probe"] = f"""WITH {FILE_CACHE}
SELECT event_id, content_sha, coalesce(ts_us >= ready_us, false) AS hit,
       CASE WHEN ts_us >= ready_us THEN summary END AS summary
FROM bev LEFT JOIN cache USING (content_sha) WHERE kind = 'file'"""

    sql["dedup_compute"] = f"""WITH {SUMMARY}
SELECT doc_id, sha256(text) AS content_sha, ok, sha256(summary) AS summary_sha FROM documents JOIN summed USING (doc_id)"""

    sql["rate_limit"] = f"""WITH RECURSIVE {EV}, {BOT_EV}, {PLAIN_BEV}, {LIMITED}
SELECT event_id, 'user:' || user_id || ':requests' AS rate_key, window_start_us, n_in_window, limited FROM counted"""

    sql["bot_routes"] = f"""{BOT}
SELECT event_id, user_id, route, CASE WHEN route = 'question' THEN last_file END AS about_file FROM routed"""

    sql["last_file_asof"] = f"{BOT} SELECT event_id, last_file FROM routed"

    sql["bot_replies"] = f"""{BOT}, seen AS (
  SELECT *, route IN ('question', 'summarize_text', 'summarize_file') AS waits,
         CASE WHEN route = 'question' THEN 120000 ELSE 240000 END AS deadline,
         CASE WHEN route = 'question' THEN answer_ms ELSE latency_ms END AS waited_ms,
         CASE WHEN route = 'question' THEN answer ELSE coalesce(cached, body) END AS shown,
         CASE route WHEN 'question' THEN answer_error WHEN 'summarize_file' THEN error END AS refusal FROM routed)
SELECT event_id, route,
  CASE WHEN refusal IS NOT NULL THEN 'error'
       WHEN waits THEN CASE WHEN waited_ms <= deadline THEN 'done' ELSE 'timeout' END END AS outcome,
  CASE WHEN refusal IS NOT NULL THEN CAST(0 AS BIGINT)
       WHEN waits THEN CASE WHEN waited_ms <= deadline THEN 2000 * greatest((waited_ms + 1999) // 2000, 1)
                            ELSE CAST(deadline AS BIGINT) END END AS observed_ms,
  CASE WHEN route = 'rate_limited' THEN {_lit(S.REPLY_LIMITED)}
       WHEN route = 'qa_no_file' THEN {_lit(S.REPLY_NO_FILE)}
       WHEN route = 'cache_hit' THEN {_lit(S.REPLY_CACHED)} || shown
       WHEN route = 'enter' THEN {_lit(S.REPLY_ENTER)}
       WHEN route = 'exit' THEN {_lit(S.REPLY_EXIT)}
       WHEN refusal IS NOT NULL THEN {_lit(S.REPLY_ERROR)} || refusal
       WHEN route = 'question' AND waited_ms <= deadline THEN {_lit(S.REPLY_ANSWER)} || shown
       WHEN route = 'question' THEN {_lit(S.REPLY_ANSWER_TIMEOUT)}
       WHEN waited_ms <= deadline THEN {_lit(S.REPLY_DONE)} || shown
       ELSE {_lit(S.REPLY_SUMMARY_TIMEOUT)} END AS reply
FROM seen"""

    sql["web_routes"] = f"""WITH {EV}, {WEB}
SELECT event_id, segment, action, route, target, CASE WHEN kind = 'text' THEN typed END AS user_text FROM web"""

    sql["web_replies"] = f"""WITH {EV}, {WEB}
SELECT event_id, CASE WHEN latency_ms % 60000 > 29000 THEN 'timeout' WHEN k % 9 = 0 THEN 'not_found' ELSE 'done' END
    AS outcome,
  CASE WHEN latency_ms % 60000 > 29000 OR k % 9 = 0 THEN
         CASE kind WHEN 'upload' THEN {_lit(S.WEB_FILE_FAILED)} WHEN 'continue' THEN {_lit(S.WEB_CONTINUE_FAILED)}
              ELSE {_lit(S.WEB_REQUEST_FAILED)} END
       ELSE 'result ' || event_id END AS shown
FROM web WHERE route IN ('summarize_file', 'summarize_text', 'question')"""

    sql["transcript"] = f"""WITH {TURNS}, s AS (
  SELECT *, CASE WHEN target = 'main' THEN 0 ELSE
           CAST(count(*) FILTER (type = 'file' OR asks) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) END AS segment
  FROM turns)
SELECT conv_id, turn, target, segment, row_number() OVER (PARTITION BY conv_id, target, segment ORDER BY turn) AS seq,
       type, sha256(shown) AS text_sha, file_name, file_size FROM s"""

    sql["transcript_last"] = f"""WITH {TURNS}, s AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn,
         count(*) OVER (PARTITION BY conv_id) AS n_messages FROM turns)
SELECT conv_id, n_messages, turn, type, sha256(shown) AS text_sha FROM s WHERE rn = 1"""

    def polled(name: str, looks: str, shown: int, deadline: int, gives_up: bool) -> str:
        came = f"event_type <> 'error' AND latency_ms <= {deadline}"
        empty = "'not_found'" if gives_up else "'timeout'"
        waited = looks if gives_up else f"CAST({shown} AS BIGINT)"
        unknown = ("'not_found'", 0) if gives_up else ("'timeout'", shown)
        return f"""SELECT event_id, '{name}' AS client,
  CASE WHEN {came} THEN CASE WHEN k % 9 = 0 THEN {empty} ELSE 'done' END ELSE 'timeout' END AS outcome,
  CASE WHEN {came} THEN CASE WHEN k % 9 = 0 THEN {waited} ELSE {looks} END ELSE CAST({shown} AS BIGINT) END AS observed_ms
FROM ev
UNION ALL SELECT -event_id - 1, '{name}', {unknown[0]}, CAST({unknown[1]} AS BIGINT) FROM ev WHERE k % 5 = 0"""

    bot_looks = "2000 * greatest((latency_ms + 1999) // 2000, 1)"
    web_looks = "1000 * ((latency_ms + 999) // 1000)"
    sql["poll_outcomes"] = f"""WITH {EV}
{polled("bot_summary", bot_looks, 240000, 240000, False)}
UNION ALL {polled("bot_answer", bot_looks, 120000, 120000, False)}
UNION ALL {polled("web", web_looks, 30000, 29000, True)}"""

    # Both halves name their steps alike, so each sits in its own subquery.
    sql["request_lifecycle"] = f"""WITH {REQUESTS}, {ASKED},
result AS (
  SELECT request_id, ok, summary AS value FROM req JOIN (WITH {SUMMARY} SELECT * FROM summed) USING (doc_id)
  UNION ALL
  SELECT request_id, ok, answer FROM (WITH {ANSWERS} SELECT * FROM answered)),
wanted AS (
  SELECT request_id FROM req UNION ALL SELECT 'x' || request_id FROM req
  UNION ALL SELECT 'q-' || conv_id || '-' || turn FROM conversations WHERE role = 'user')
SELECT w.request_id, CASE WHEN value <> '' THEN 'done' ELSE 'not_found' END AS status,
       coalesce(value <> '' AND ok, false) AS ok, CASE WHEN value <> '' THEN sha256(value) END AS summary_sha
FROM wanted w LEFT JOIN result USING (request_id)"""

    sql["log_parse"] = f"""WITH {EV}, {_log_rows()}
SELECT event_id, ts_ms, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS log_date, level, '__main__' AS module,
       'main' AS func, CAST(line AS BIGINT) AS line, event, request_id, n_chars, sha256(message) AS message_sha FROM lrow"""

    sql["log_latency"] = f"WITH {EV}, {_log_rows()} SELECT request_id, service, latency_ms, n_chars FROM paired"

    sql["log_queue_wait"] = f"""WITH {EV}
SELECT md5(CAST(event_id AS VARCHAR)) AS request_id,
       CASE event_type WHEN 'signup' THEN 'question' ELSE 'summary' END AS service, CAST(7 * (k + 1) AS BIGINT) AS wait_ms
FROM ev WHERE event_type IN ('view', 'click', 'signup')"""

    sql["log_metrics"] = f"""WITH {EV}, {_log_rows()}, r AS (
  SELECT *, row_number() OVER (PARTITION BY service ORDER BY latency_ms) AS rn,
         count(*) OVER (PARTITION BY service) AS n FROM paired)
SELECT service, count(*) AS n_requests, min(latency_ms) AS min_ms,
       min(CASE WHEN rn * 2 >= n THEN latency_ms END) AS median_ms, max(latency_ms) AS max_ms
FROM r GROUP BY service"""

    stages = "('question_translation', 0, 1), ('context_translation', 2, 3), ('generation', 3, 4), ('back_translation', 4, 5)"
    sql["log_stages"] = f"""WITH {EV}, q AS (SELECT * FROM ev WHERE event_type = 'signup'),
l AS (
  SELECT user_id, i, (ts_us + (k + 2) * i * i * 1000) // 1000 AS at_ms
  FROM (SELECT *, unnest(range(6)) AS i FROM q) WHERE i < 4 OR k % 7 <> 0),
p AS (SELECT *, lag(i) OVER w AS before, lag(at_ms) OVER w AS start_ms FROM l
      WINDOW w AS (PARTITION BY user_id ORDER BY at_ms, i)),
s(stage, a, b) AS (VALUES {stages})
SELECT stage, count(*) AS n_stages, CAST(sum(at_ms - start_ms) AS BIGINT) AS total_ms, min(at_ms - start_ms) AS min_ms,
       max(at_ms - start_ms) AS max_ms FROM p JOIN s ON before = a AND i = b GROUP BY stage
UNION ALL SELECT 'failed', count(*), NULL, NULL, NULL FROM q WHERE k % 7 = 0"""

    sql["log_levels"] = f"""WITH {EV}, {_log_rows()}
SELECT level, 'main' AS func, count(*) AS n_lines FROM lrow GROUP BY level"""

    return sql
