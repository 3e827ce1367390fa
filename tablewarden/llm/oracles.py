"""SQL equivalents of the registered queries, for DuckDB, where SQL can express them."""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def near_duplicates(shingle: int, percent: int, documents: str = "documents", prefix: str = "") -> str:
    """Common table expressions up to `{prefix}near` (doc_id, n_shingles, component_id)."""
    return rf"""
{prefix}worded AS (
  SELECT doc_id, [x FOR x IN string_split_regex({LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+') IF x <> ''] AS w
  FROM {documents}
),
{prefix}sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + {shingle - 1}], ' ') for i in range(1, len(w) - {shingle - 2})]) END AS s
  FROM {prefix}worded
),
{prefix}items AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM {prefix}sets),
{prefix}links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM {prefix}items a JOIN {prefix}items b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
),
{prefix}reach AS (
  SELECT doc_id AS x, doc_id AS y FROM {documents}
  UNION
  SELECT r.x, l.y FROM {prefix}reach r JOIN {prefix}links l ON r.y = l.x
),
{prefix}near AS (
  SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, r.component_id
  FROM {prefix}sets s JOIN (SELECT x, min(y) AS component_id FROM {prefix}reach GROUP BY x) r ON r.x = s.doc_id
)"""


def contamination(n: int = 10) -> str:
    """Common table expressions up to `hits` (doc_id, pos, length, item) and `bench` (item, window)."""
    words = (
        "[x FOR x IN string_split_regex("
        + LOWER.format("coalesce(text, '')")
        + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> '']"
    )
    return rf"""
item_words AS (SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), {n}) AS length FROM item_words WHERE len(w) > 0),
bench AS (
  SELECT DISTINCT item, length, unnest([array_to_string(w[i:i + length - 1], ' ') FOR i IN range(1, len(w) - length + 2)]) AS window_text
  FROM sized
),
doc_words AS (SELECT doc_id, {words} AS w FROM documents),
lengths AS (SELECT DISTINCT length FROM bench),
runs AS (
  SELECT doc_id, length, unnest(range(1, len(w) - length + 2)) AS pos, w FROM doc_words, lengths WHERE len(w) >= length
),
hits AS (
  SELECT DISTINCT r.doc_id, r.pos, r.length, b.item
  FROM runs r JOIN bench b ON b.length = r.length AND b.window_text = array_to_string(r.w[r.pos:r.pos + r.length - 1], ' ')
)"""


_TWICE = "</s>[INST] ok [/INST]"
_ESCAPED = " + ".join(
    f"(length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)}" for c in ("\\", "<|", "|>", "<s>", "</s>", "[INST]", "[/INST]")
)
_CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, 'rows' AS mapping FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_TWICE}', 'prompt' UNION ALL SELECT -1, 1, 'assistant', '{_TWICE}', 'prompt'
)
SELECT conv_id, any_value(mapping) AS mapping, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(8 + length(role) + {_ESCAPED.format("role")} + length(text) + {_ESCAPED.format("text")}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""

def _edit(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """A state {c: cost, a: audit, t: repaired lines} after an edit."""
    text = f"{state}.t" if line is None else f"CASE WHEN {state}.t = '' THEN {line} ELSE {state}.t || chr(10) || {line} END"
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {text}}}"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


# edits of a row: deletion, then for each state after it the ways to keep or change the row's role
_DROP = [_edit(f"y{i}", "3", "D") for i in range(4)]
_CHANGE = {s: _edit(f"y{s}", f"cut + CASE WHEN held THEN 2 ELSE {10**9} END", "R", f"'{r}:' || text") for s, r in ((0, "user"), (1, "user"), (2, "assistant"), (3, "user"))}


def _kept(state: int, initial: str) -> str:
    return _edit(f"y{state}", f"cut + CASE WHEN held AND left(role, 1) = '{initial}' THEN 0 ELSE {10**9} END", "K", "role || ':' || text")


_STEP = [
    _DROP[0],
    _least(_DROP[1], _kept(0, "s")),
    _least(_DROP[2], *[x for s in (0, 1, 3) for x in (_kept(s, "u"), _CHANGE[s])]),
    _least(_DROP[3], _kept(2, "a"), _CHANGE[2]),
]
_WITH_USER = _least("x2", *[_edit(f"x{s}", "2", "I", "'user:'") for s in (0, 1, 3)])
_WITH_ASSISTANT = _least("x3", _edit("y2", "2", "I", "'assistant:'"))
_NOWHERE = f"{{'c': {10**9}, 'a': '', 't': ''}}"
_BYTES = "list_transform(range(1, CAST(length(name) AS BIGINT) + 1), lambda i: CAST(ascii(substr(name, i, 1)) AS UBIGINT))"
_CRC = (
    f"xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], {_BYTES}), lambda c, b: list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda z: CAST(z AS UBIGINT))), "
    "lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END)), CAST(4294967295 AS UBIGINT))"
)
_REPAIR = rf"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
),
hit AS (SELECT *, {_CRC} % 20 AS fault FROM named),
rows_after AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM hit, range(2) AS copies(copy) WHERE fault <> 0 AND (copy = 0 OR fault = 3)
),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM rows_after),
judged AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-
]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again,
    NOT regexp_matches(text, '[.!?][ 	-
]*\z') AS open_end, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before
  FROM placed
),
faulty AS (
  SELECT *, NOT blank AND NOT again AS held, CAST(NOT blank AND NOT again AND open_end AS BIGINT) AS cut FROM judged
),
stats AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (NOT blank AND again) AS duplicate, sum(cut) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
),
walk AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS place, {{'c': 0, 'a': '', 't': ''}} AS x0, {_NOWHERE} AS x1, {_NOWHERE} AS x2, {_NOWHERE} AS x3 FROM conversations
  UNION ALL
  SELECT conv_id, place, {', '.join(f'{e} AS x{i}' for i, e in enumerate(_STEP))}
  FROM (
    SELECT *, x0 AS y0, x1 AS y1, {_WITH_ASSISTANT} AS y3
    FROM (SELECT f.conv_id, f.place, f.role, f.text, f.held, f.cut, w.x0, w.x1, w.x3, {_WITH_USER.replace('x0', 'w.x0').replace('x1', 'w.x1').replace('x2', 'w.x2').replace('x3', 'w.x3')} AS y2
      FROM walk w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.place = w.place + 1)
  )
),
done AS (
  SELECT conv_id, n, {_least("x0", _WITH_ASSISTANT)} AS found
  FROM (SELECT w.conv_id, w.x0, w.x3, coalesce(s.n, 0) AS n, {_WITH_USER.replace('x0', 'w.x0').replace('x1', 'w.x1').replace('x2', 'w.x2').replace('x3', 'w.x3')} AS y2
    FROM walk w LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.place = coalesce(s.n, 0))
)
SELECT d.conv_id, CAST(coalesce(s.gaps, 0) AS BIGINT) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate,
  CAST(coalesce(s.truncated, 0) AS BIGINT) AS truncated, coalesce(s.illegal, 0) AS illegal, CAST(d.found.c AS BIGINT) AS cost, d.found.a AS audit, sha256(d.found.t) AS repaired_sha256
FROM done d LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM d.conv_id"""

_COLLOCATIONS = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
),
worded AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[\x20\x09]+') IF x <> ''] AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM worded GROUP BY lang),
occurrences AS (
  SELECT lang, size, unnest([array_to_string(w[i:i + size - 1], ' ') FOR i IN range(1, len(w) - size + 2)]) AS phrase FROM worded, range(1, 6) AS sizes(size)
),
f AS (SELECT lang, size, phrase, string_split(phrase, ' ') AS w, count(*) AS f FROM occurrences GROUP BY lang, size, phrase HAVING count(*) >= 100),
inside AS (
  SELECT DISTINCT g.lang, array_to_string(g.w[i:i + s - 1], ' ') AS phrase, g.f
  FROM f g, range(2, 5) AS shorter(s), range(1, 5) AS begins(i) WHERE s < g.size AND i + s - 1 <= g.size
),
kept AS (SELECT * FROM f c WHERE size >= 2 AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.f >= 100 * c.f)),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, CAST(t.n AS BIGINT) AS n, k,
    CAST((CAST(1000 AS HUGEINT) * c.f * t.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM kept c, range(1, 5) AS cutting(k), totals t, f l, f r
  WHERE k < c.size AND t.lang = c.lang AND l.lang = c.lang AND r.lang = c.lang
    AND l.phrase = array_to_string(c.w[1:k], ' ') AND r.phrase = array_to_string(c.w[k + 1:], ' ')
),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000"""

ORACLES: dict[str, str] = {
    "op13_collocations": _COLLOCATIONS,
    "op12_conversation_repair": _REPAIR,
    "op2_chat_formatting": _CHAT,
    "op3_near_duplicates": "WITH RECURSIVE"
    + near_duplicates(4, 80)
    + "\nSELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM near",
    "op6_decontamination": "WITH"
    + contamination()
    + """,
covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(pos, pos + length)) AS place FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(f.items, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN covered c USING (doc_id) LEFT JOIN found f USING (doc_id)""",
}
