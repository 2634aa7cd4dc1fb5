"""DuckDB SQL of the corpus queries, for those that SQL can express.

Byte-pair merges (op5), CRC-32 (op3) and the trained classifier (op10, and with it the pipeline) are held against brute-force
versions in the tests instead.
"""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: str, order: int, pattern: str, good: str) -> str:
    """Matches with their places: the pieces between matches and the matches themselves, in turn."""
    return f"""
    SELECT doc_id, '{kind}' AS kind, {order} AS ord, m, start, start + len(m) AS stop FROM (
      SELECT doc_id, unnest(ms) AS m,
        unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda p: len(p))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda p: len(p))), 0))) AS start
      FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM texts)
    ) WHERE {good}"""


_OP1 = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS (
  {_spans("assign", 0, ASSIGN, f"len(regexp_extract(m, '{ASSIGN}', 2)) >= 12")}
  UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", "len(m) >= 18")}
  UNION ALL {_spans("hex", 2, "[0-9a-f]+", "len(m) >= 16")}
),
told AS (
  SELECT doc_id, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, ord) AS spans,
    count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h
  FROM spans GROUP BY doc_id
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN told USING (doc_id)
"""

_OP2 = f"""
WITH sized AS (
  SELECT doc_id, coalesce(source, '') AS src, source IS NULL AS nosrc, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), '-'), coalesce(source, '-'), md5(coalesce(text, '')))) [1:15] AS place
  FROM documents
),
sources AS (
  SELECT src, nosrc, CAST(sum(size) AS BIGINT) AS source_size, 2 * CAST(sum(size) AS BIGINT) AS cap, row_number() OVER (ORDER BY nosrc, src) - 1 AS ord
  FROM sized GROUP BY src, nosrc
),
weighed AS (SELECT *, [3, 1, 2][ord % 3 + 1] AS weight, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM sources),
filled AS (
  SELECT *, total - coalesce(sum(cap) OVER (ORDER BY cap / weight, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spare,
    sum(weight) OVER (ORDER BY cap / weight, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest, row_number() OVER (ORDER BY cap / weight, ord) AS fills
  FROM weighed
),
level AS (SELECT arg_min(spare, fills) AS spare, arg_min(rest, fills) AS rest FROM filled WHERE NOT spare * weight > cap * rest),
targets AS (
  SELECT f.src, f.nosrc, f.source_size, f.ord,
    CASE WHEN f.spare * f.weight > f.cap * f.rest THEN f.cap::DOUBLE ELSE least(l.spare * f.weight / l.rest, f.cap::DOUBLE) END AS target
  FROM filled f, level l
),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.ord,
    coalesce(sum(s.size) OVER (PARTITION BY s.nosrc, s.src ORDER BY s.place, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s.size / 2 AS middle
  FROM sized s JOIN targets t USING (src, nosrc)
),
used AS (SELECT *, (middle < target)::INT + (source_size + middle < target)::INT AS copies, middle / target AS u FROM placed)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
  round(CASE WHEN copies = 0 THEN NULL
    WHEN ord % 3 = 0 THEN 2 * u / (1.5 + sqrt(2.25 - 2 * u))
    WHEN ord % 3 = 1 THEN CASE WHEN u < 0.375 THEN 2 * u / (0.5 + sqrt(0.25 + 2 * u)) ELSE 0.5 + 2 * (u - 0.375) / (1 + sqrt(1 + 2 * (u - 0.375))) END
    ELSE u END, 6) AS first_position
FROM used
"""

_CONTROLS = ("<|im_start|", "<|im_end|", "<|endoftext|", "<s>", "</s>")
_MARKED = " + ".join(f"(len(t) - len(replace(t, '{c}', ''))) // {len(c)}" for c in _CONTROLS)
_BRACKETED = " + ".join(f"(len(t) - len(replace(t, '{c}', ''))) // {len(c)}" for c in ("[INST]", "[/INST]"))

_OP4 = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
),
numbered AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(len('<|im_start|>') + len(r) + 1 + len(t) + 4 * (len(t) - len(replace(t, '&', ''))) + 3 * ({_MARKED}) + 4 * ({_BRACKETED}) + len('<|im_end|>') + 1) OVER w AS upto
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, r, t)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(len(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY i) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(coalesce(sum(upto) FILTER (r = 'assistant' OR i = n), 0) AS BIGINT) AS formatted_chars
FROM numbered GROUP BY conv_id
"""

_OP6 = """
WITH vecs AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vecs q JOIN vecs c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""

_COUNT = lambda p: f"len(t) - len(regexp_replace(t, '{p}', '', 'g'))"
_SPACES, _MARKS = r"[\x20\x09-\x0D]", r"[.,;:''\"()!?-]"
_PART = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2(2 * {a} / ({a} + {b})) ELSE 0 END"
_DISTANCE = f"sqrt(greatest(sum({_PART('p', 'q')} + {_PART('q', 'p')}) / 2, 0))"

_OP7 = f"""
WITH texts AS (
  SELECT doc_id, coalesce(lower(regexp_extract(coalesce(lang, ''), '^([A-Za-z]{{2,3}})(?:[^A-Za-z]|$)', 1)), '') AS l, coalesce(text, '') AS t FROM documents
),
base AS (
  SELECT doc_id, l, t, regexp_extract_all(t, '{WORD}') AS ws, len(ws) AS n_words, len(t) - len(regexp_replace(t, '{WORD}', '', 'g')) AS word_chars,
    {_COUNT("[#*$%&|<>]")} AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls,
    {_COUNT("[a-z]")} AS c0, {_COUNT("[A-Z]")} AS c1, {_COUNT("[0-9]")} AS c2, {_COUNT(_SPACES)} AS c3, {_COUNT(_MARKS)} AS c4,
    len(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) - c0 - c1 - c2 - c3 - c4 AS c5, octet_length(encode(t)) - len(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g')) AS c6
  FROM texts
),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i+2], ' ') AS g FROM base, unnest(range(1, len(ws) - 1)) u(i)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
again AS (SELECT doc_id, count(DISTINCT j) AS n FROM twice, unnest([i, i + 1, i + 2]) u(j) GROUP BY doc_id),
counts AS (SELECT doc_id, l, word, count(*) AS c FROM (SELECT doc_id, l, unnest(ws) AS word FROM base) GROUP BY ALL),
totals AS (SELECT l, sum(n_words) AS total, [sum(c0), sum(c1), sum(c2), sum(c3), sum(c4), sum(c5), sum(c6)] AS qs FROM base GROUP BY l),
common AS (SELECT l, word, sum(c) AS c FROM counts GROUP BY l, word HAVING sum(c) >= 0.004 * (SELECT total FROM totals WHERE totals.l = counts.l)),
judged AS (SELECT doc_id, l, n_words, total FROM base JOIN totals USING (l) WHERE total >= 10000 AND n_words >= 50),
cells AS (
  SELECT j.doc_id, j.n_words, j.total, coalesce(k.c, 0) AS a, m.c AS b FROM judged j JOIN common m USING (l) LEFT JOIN counts k ON k.doc_id = j.doc_id AND k.word = m.word
),
every AS (
  SELECT doc_id, a / n_words AS p, b / total AS q FROM cells
  UNION ALL SELECT doc_id, (any_value(n_words) - sum(a)) / any_value(n_words), (any_value(total) - sum(b)) / any_value(total) FROM cells GROUP BY doc_id
),
words AS (SELECT doc_id, {_DISTANCE} AS js FROM every GROUP BY doc_id),
classes AS (
  SELECT doc_id, unnest([c0, c1, c2, c3, c4, c5, c6]) / octet_length(encode(t)) AS p, unnest(qs) / list_sum(qs) AS q FROM base JOIN totals USING (l) WHERE total >= 10000 AND word_chars >= 150
),
chars AS (SELECT doc_id, {_DISTANCE} AS js FROM classes GROUP BY doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(again.n, 0) AS n_repeat_words,
  n_words < 50 OR 100 * coalesce(again.n, 0) > 50 * n_words AS base_failed, round(words.js, 6) AS js_words, round(chars.js, 6) AS js_chars,
  NOT (n_words < 50 OR 100 * coalesce(again.n, 0) > 50 * n_words) AND coalesce(words.js * words.js <= 0.055 + 4.0 / n_words, true)
    AND coalesce(chars.js * chars.js <= 0.07 + 12.0 / word_chars, true) AS kept
FROM base LEFT JOIN again USING (doc_id) LEFT JOIN words USING (doc_id) LEFT JOIN chars USING (doc_id)
"""

_OP8 = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents
),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' ')) END) AS s FROM words
),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM sets UNION SELECT p.a, reach.r FROM reach JOIN pairs p ON p.b = reach.doc_id)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

_OP9 = f"SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n_tokens FROM documents"

_KEY = r"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP11 = f"""
WITH lines AS (
  SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) u(i)
),
keyed AS (SELECT doc_id, i, line, {_KEY} AS k FROM lines),
common AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT doc_id, i, line, coalesce(keeper <> doc_id, false) AS gone FROM keyed LEFT JOIN common USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def _way(cost: int, letters: str, ok: str, states: tuple[str, ...], text: str) -> list[str]:
    """Ways out of any of ``states`` by one edit: cost, audit, repaired text."""
    return [f"CASE WHEN {ok} AND {s}.c IS NOT NULL THEN {{'c': {s}.c + {cost} + {'0' if letters == 'D' else 'tr'}, 'a': {s}.a || '{letters}', 't': {s}.t || {text}}} END" for s in states]


def _best(ways: list[str]) -> str:
    return f"list_min(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))"


def _insert(role: str, frm: str, to: str) -> str:
    """State ``to`` before a row, reached as it was or by an insert after ``frm``."""
    return f"list_min(list_filter([{to}, CASE WHEN {frm}.c IS NOT NULL THEN {{'c': {frm}.c + 2, 'a': {frm}.a || 'I', 't': {frm}.t || '{role}:' || chr(10)}} END], lambda w: w IS NOT NULL))"


_STAYS = "(fault IN (0, 3))"
_LINE = lambda role: f"{role} || ':' || text || chr(10)"
_STATE = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"

# States: b at the start, s after system, u after user, a after assistant. Inserts come first, in two steps, then the row's edit.
_OP12 = f"""
WITH RECURSIVE crc AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(p) + 1), lambda i: ord(p[i])::BIGINT)), lambda c, o:
    list_reduce([xor(c, o), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS kind
  FROM (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS p FROM conversations)
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM crc, unnest(CASE WHEN kind = 3 THEN [1, 2] WHEN kind = 0 THEN [] ELSE [1] END)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
told_apart AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth, regexp_extract(text, '({WORD})[\x20\x09-\x0D]*$', 1) AS tail
  FROM placed
),
rows AS (
  SELECT *, CASE WHEN tail = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault, CASE WHEN fault = 3 THEN 1 ELSE 0 END AS tr,
    left(role, 1) AS k, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM told_apart
),
walk AS (
  SELECT conv_id, 0::BIGINT AS i, {{'c': 0, 'a': '', 't': ''}}::{_STATE} AS b, NULL::{_STATE} AS s, NULL::{_STATE} AS u, NULL::{_STATE} AS a FROM (SELECT DISTINCT conv_id FROM rows)
  UNION ALL
  SELECT conv_id, i, {_best(_way(3, 'D', 'true', ('b0',), "''"))} AS b,
    {_best(_way(3, 'D', 'true', ('s0',), "''") + _way(0, 'K', f"{_STAYS} AND k = 's'", ('b0',), _LINE('role')))} AS s,
    {_best(_way(3, 'D', 'true', ('u2',), "''") + _way(0, 'K', f"{_STAYS} AND k = 'u'", ('b0', 's0', 'a2'), _LINE('role')) + _way(2, 'R', _STAYS, ('b0', 's0', 'a2'), _LINE("'user'")))} AS u,
    {_best(_way(3, 'D', 'true', ('a2',), "''") + _way(0, 'K', f"{_STAYS} AND k = 'a'", ('u2',), _LINE('role')) + _way(2, 'R', _STAYS, ('u2',), _LINE("'assistant'")))} AS a
  FROM (
    SELECT *, {_insert('user', 'a1', 'u1')} AS u2, {_insert('assistant', 'u1', 'a1')} AS a2 FROM (
      SELECT *, {_insert('assistant', 'u0', 'a0')} AS a1,
        list_min(list_filter([u0] || list_transform(list_filter([b0, s0, a0], lambda w: w IS NOT NULL), lambda w: {{'c': w.c + 2, 'a': w.a || 'I', 't': w.t || 'user:' || chr(10)}}), lambda w: w IS NOT NULL)) AS u1
      FROM (SELECT r.*, w.b AS b0, w.s AS s0, w.u AS u0, w.a AS a0 FROM walk w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1)
    )
  )
),
ends AS (
  SELECT conv_id, list_min(list_filter([b, a, CASE WHEN u IS NOT NULL THEN {{'c': u.c + 2, 'a': u.a || 'I', 't': u.t || 'assistant:' || chr(10)}} END,
    CASE WHEN s IS NOT NULL THEN {{'c': s.c + 4, 'a': s.a || 'II', 't': s.t || 'user:' || chr(10) || 'assistant:' || chr(10)}} END], lambda w: w IS NOT NULL)) AS e
  FROM walk QUALIFY i = max(i) OVER (PARTITION BY conv_id)
),
told AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || k NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows GROUP BY conv_id
)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(e.c, 0) AS cost, coalesce(e.a, '') AS audit, sha256(CASE WHEN coalesce(e.t, '') = '' THEN '' ELSE e.t[:-2] END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN ends ON ends.conv_id IS NOT DISTINCT FROM d.conv_id
"""

ORACLES: dict[str, str] = {
    "op1_secret_scan": _OP1, "op2_mixing": _OP2, "op4_chat_prefix_targets": _OP4, "op6_threshold_top_k": _OP6,
    "op7_quality_divergence": _OP7, "op8_ngram_jaccard": _OP8, "op9_token_counts": _OP9, "op11_line_dedup": _OP11, "op12_turn_repair": _OP12,
}
