"""SQL equivalents of the registered queries, for an independent engine on the same tables.

They are written from the definition of each result and not from the DataFrame plans:
containment is a theta join here, heading runs are window sums, retrieval is a plain join.
Regular expressions avoid look-around, which that engine does not have.
"""

from __future__ import annotations


# Fixed values of the definitions, written out again so that rows check the engine's own copies.
CPF_PATTERN = '^[0-9]{3}\\.?[0-9]{3}\\.?[0-9]{3}-?[0-9]{2}$'
EMAIL_PATTERN = '(?i)^[^@\\s]+@[^@\\s]+\\.[a-z]{2,}$'
PHONE_PATTERN = '^\\+?[0-9\\s().-]{10,20}$'
NAME_PATTERNS = [
    ('network_id', '(ip_address|ip_addr|user_agent|device_id|mac_address)'),
    ('national_id', '\\b(cpf|cnpj|ssn|nif|national_id)\\b'),
    ('person_name', '(^|_)(nome|name|sobrenome|surname)($|_)'),
    ('email', '(email|e_mail|mail)'),
    ('phone', '(telefone|phone|celular|mobile|msisdn)'),
    ('birth_date', '(nascimento|birth|dob)'),
    ('address', '(endereco|address|logradouro|cep|zipcode|postal)'),
]
STOP_WORDS = [
    "the", "a", "an", "of", "for", "and", "or", "is", "are", "to", "in", "on",
    "by", "with", "as", "at", "from", "this", "that", "it", "its", "be", "each", "when",
    "which", "was", "were", "has", "have", "not", "but", "all", "any", "can", "id",
]
SEARCH_STOP_WORDS = [
    "the", "and", "for", "что", "which", "what", "does", "hold", "holds", "have", "has", "are",
    "is", "of", "in", "on", "a", "an", "to", "with", "que", "qual", "quais", "como",
    "onde", "tem", "sao", "são", "é", "e", "de", "da", "do", "das", "dos", "um",
    "uma",
]
# The derived estate: column kinds and mapping rules.
COLUMN_KINDS = [
    ('name_', 'string', 'person_name'),
    ('email_', 'string', 'email'),
    ('cpf-', 'string', 'national_id'),
    ('dt_nascimento_', 'date', 'birth_date'),
    ('ip_address_', 'string', 'network_id'),
    ('valor_', 'double', 'none'),
    ('status_', 'string', 'none'),
    ('phone_', 'string', 'phone'),
    ('queueId', 'string', 'none'),
    ('endereco_', 'string', 'address'),
    ('tAcw', 'bigint', 'none'),
    ('nota_', 'string', 'none'),
]
MAPPING = [
    ('brand_1.small*', 'src0'),
    ('brand_1.*', 'src1'),
    ('brand_1*.*', 'src2'),
    ('brand_2*', 'src3'),
    ('*bolt*', 'src4'),
]
# The derived lake: its tables and those its query log names.
LAKE_TABLES = [
    "orders", "lineitem", "events", "region", "nation", "customer", "supplier", "part", "documents",
    "pages", "labels", "benchmark", "embeddings", "conversations",
]
LAKE_SCHEMAS = {
    "raw": ["orders", "lineitem", "events"],
    "ref": ["region", "nation"],
    "crm": ["customer", "supplier", "part"],
    "docs": ["documents", "pages", "labels", "benchmark", "embeddings", "conversations"],
}
LAKE_LOGGED = [
    "lineitem", "orders", "customer", "supplier", "nation", "region", "events", "documents", "embeddings",
    "pages", "orders_v2", "part_v2",
]


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "(" + ", ".join(_quote(w) for w in words) + ")"


def _name_label(column: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches({column}, {_quote('(?i)' + pattern)}) THEN {_quote(label)}"
        for label, pattern in NAME_PATTERNS
    )
    return f"CASE {cases} END"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '', 'g')"


def _check_digit(digits: str, length: int) -> str:
    weighted = " + ".join(
        f"{length + 2 - p} * CAST(substr({digits}, {p}, 1) AS INTEGER)" for p in range(1, length + 1)
    )
    return f"((({weighted}) * 10) % 11 % 10)"


def _cpf_valid(value: str) -> str:
    d = _digits(value)
    return (
        f"coalesce(CASE WHEN length({d}) <> 11 OR length(replace({d}, left({d}, 1), '')) = 0 THEN false "
        f"ELSE {_check_digit(d, 9)} = CAST(substr({d}, 10, 1) AS INTEGER) "
        f"AND {_check_digit(d, 10)} = CAST(substr({d}, 11, 1) AS INTEGER) END, false)"
    )


def _cpf_from(nine: str) -> str:
    ten = f"({nine} || CAST({_check_digit(nine, 9)} AS VARCHAR))"
    return f"({ten} || CAST({_check_digit(ten, 10)} AS VARCHAR))"


def _email(v: str) -> str:
    return f"regexp_matches({v}, {_quote(EMAIL_PATTERN)})"


def _cpf_shape(v: str) -> str:
    return f"regexp_matches({v}, {_quote(CPF_PATTERN)})"


def _phone(v: str) -> str:
    return f"(regexp_matches({v}, {_quote(PHONE_PATTERN)}) AND length({_digits(v)}) BETWEEN 10 AND 15)"


def _value_label(v: str) -> str:
    return (
        f"CASE WHEN {_email(v)} THEN 'email' "
        f"WHEN {_cpf_shape(v)} AND {_cpf_valid(v)} THEN 'national_id_verified' "
        f"WHEN {_phone(v)} THEN 'phone' WHEN {_cpf_shape(v)} THEN 'national_id_shape' END"
    )


def _column_label(v: str) -> str:
    return (
        f"CASE WHEN bool_and({_email(v)}) THEN 'email' "
        f"WHEN bool_and({_cpf_shape(v)}) AND bool_and(CASE WHEN {v} IS NOT NULL THEN {_cpf_valid(v)} END) THEN 'national_id_verified' "
        f"WHEN bool_and({_phone(v)}) THEN 'phone' WHEN bool_and({_cpf_shape(v)}) THEN 'national_id_shape' END"
    )


def _tokens(text: str) -> str:
    spaced = f"regexp_replace({text}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"
    return (
        f"list_filter(regexp_extract_all(lower({spaced}), '[a-z0-9]+'), "
        f"lambda w: w NOT IN {_list(STOP_WORDS)} AND length(w) > 1)"
    )


def _human(size: str, smallest: str = "%.1f B") -> str:
    v = f"CAST({size} AS DOUBLE)"
    return (
        f"CASE WHEN coalesce({size}, 0) = 0 THEN '-' WHEN {v} < 1024 THEN printf('{smallest}', {v}) "
        f"WHEN {v} / 1024 < 1024 THEN printf('%.1f KB', {v} / 1024) "
        f"WHEN {v} / 1048576 < 1024 THEN printf('%.1f MB', {v} / 1048576) "
        f"WHEN {v} / 1073741824 < 1024 THEN printf('%.1f GB', {v} / 1073741824) "
        f"ELSE printf('%.1f TB', {v} / 1099511627776) END"
    )


_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _strip(text: str) -> str:
    return _STRIP.format(text)


# Columns of the given tables, and which of them are text.
COLUMNS = {
    "region": "r_regionkey r_name*",
    "nation": "n_nationkey n_name* n_regionkey",
    "customer": "c_custkey c_name* c_nationkey c_acctbal c_mktsegment*",
    "supplier": "s_suppkey s_name* s_nationkey s_acctbal",
    "part": "p_partkey p_name* p_brand* p_type* p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus* o_totalprice o_orderdate o_orderpriority*",
    "lineitem": (
        "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
        "l_returnflag* l_linestatus* l_shipdate"
    ),
    "events": "event_id ts user_id event_type* value props*",
    "documents": "doc_id text* lang* source* n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url* html*",
    "benchmark": "item_id text*",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role* text*",
}
CONTACT_COLUMNS = "c_custkey contact* line_no* document_no* old_document_no* mixed* nickname* country*"
LEGACY_COLUMNS = COLUMNS["orders"] + " o_legacy* o_country*"
SCHEMA_OF = {name: schema for schema, names in LAKE_SCHEMAS.items() for name in names}

_NINE = "lpad(CAST(c_custkey + 1 AS VARCHAR), 9, '0')"
_CPF = _cpf_from(_NINE)
CONTACTS = f"""contacts AS (
  SELECT c_custkey,
    'c' || c_custkey || '@example.com' AS contact,
    CASE WHEN c_nationkey > 5 THEN '+55 (11) 9' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') END AS line_no,
    {_CPF} AS document_no,
    CASE WHEN c_mktsegment = 'BUILDING' THEN left({_CPF}, 10) || 'x' ELSE {_CPF} END AS old_document_no,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'not an email' ELSE c_custkey || '@example.org' END AS mixed,
    CAST(NULL AS VARCHAR) AS nickname, 'BR' AS country
  FROM customer)"""
LEGACY = """legacy_orders AS (
  SELECT *, CAST(NULL AS VARCHAR) AS o_legacy, CASE WHEN o_orderstatus <> 'P' THEN 'BR' END AS o_country
  FROM orders)"""


def _profile(tables: dict[str, str], labels: bool = False) -> str:
    """One row per column: counts, single value, and optionally the value label."""
    schema_of = {**SCHEMA_OF, "contacts": "crm", "legacy_orders": "raw"}
    rows = []
    for table, columns in tables.items():
        for position, column in enumerate(columns.split(), start=1):
            name, is_text = column.rstrip("*"), column.endswith("*")
            c = f'"{name}"'
            extra = ""
            if labels:
                extra = f", {_column_label(c) if is_text else 'CAST(NULL AS VARCHAR)'} AS pii_by_value"
            rows.append(
                f"SELECT '{schema_of[table]}' AS table_schema, '{table}' AS table_name, '{name}' AS column_name, "
                f"{position} AS ordinal_position, {str(is_text).lower()} AS is_text, count(*) AS row_count, "
                f"count(*) - count({c}) AS null_count, count({c}) > 0 AND min({c}) = max({c}) AS is_constant"
                f"{extra} FROM {table}"
            )
    return "\nUNION ALL ".join(rows)


ALL_TABLES = {**COLUMNS, "contacts": CONTACT_COLUMNS, "legacy_orders": LEGACY_COLUMNS}

# The estate

_KIND = "CAST(l_suppkey % {n} + 1 AS INTEGER)".format(n=len(COLUMN_KINDS))


def _kind(part: int) -> str:
    return "([" + ", ".join(_quote(kind[part]) for kind in COLUMN_KINDS) + f"])[{_KIND}]"


_SYSTEM = "CASE " + " ".join(
    f"WHEN regexp_full_match(table_schema || '.' || table_name, {_quote(match.replace('*', '.*'))}) THEN {_quote(system)}"
    for match, system in MAPPING
) + " END"
_DIGEST = "md5(CAST(p_partkey AS VARCHAR))"
ESTATE = f"""registry AS (
  SELECT lower(p_type) AS table_catalog,
    CASE WHEN p_size = 1 THEN 'meta' ELSE lower(replace(p_brand, '#', '_')) END AS table_schema,
    CASE WHEN p_size = 2 THEN '__materialization_mat_' || p_partkey
      WHEN p_size = 3 THEN 'event_log_' || left({_DIGEST}, 8)
      ELSE replace(p_name, ' ', '_') || '_' || p_partkey END AS table_name,
    CASE WHEN p_size <= 20 THEN 'MANAGED' WHEN p_size <= 30 THEN 'EXTERNAL' WHEN p_size <= 40 THEN 'VIEW'
      ELSE 'STREAMING_TABLE' END AS table_type,
    CASE WHEN p_size BETWEEN 5 AND 9 THEN NULL
      WHEN p_size BETWEEN 10 AND 14 THEN substr({_DIGEST}, 1, 8) || '-' || substr({_DIGEST}, 9, 4) || '-' ||
        substr({_DIGEST}, 13, 4) || '-' || substr({_DIGEST}, 17, 4) || '-' || substr({_DIGEST}, 21, 12)
      ELSE lower(p_type) || '@example.com' END AS table_owner,
    CASE WHEN p_retailprice >= 950 THEN 'Stock of ' || p_name || 's' WHEN p_retailprice >= 940 THEN ' '
      WHEN p_retailprice >= 925 THEN '' END AS table_comment,
    p_partkey, p_name, p_brand, p_size
  FROM part),
tables AS (
  SELECT *, table_catalog || '.' || table_schema || '.' || table_name AS table_key,
    table_type IN ('MANAGED', 'EXTERNAL') AS is_writable,
    coalesce(table_comment <> '', false) AS has_comment, {_SYSTEM} AS system
  FROM registry
  WHERE table_schema NOT IN ('information_schema', 'meta')
    AND NOT regexp_matches(table_name, '(?i)^__materialization_mat_')
    AND NOT regexp_matches(table_name, '(?i)^event_log_[0-9a-f]{{8}}')),
lines AS (
  SELECT l_partkey, count(*) AS row_count,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) * 10 AS BIGINT) AS size_bytes,
    max(l_shipdate) FILTER (WHERE l_returnflag = 'R') AS latest
  FROM lineitem GROUP BY 1),
sized AS (
  SELECT t.*, row_count, size_bytes, CAST(p_size AS BIGINT) * 4 AS num_files,
    CASE WHEN p_size < 46 THEN latest END AS last_read_at
  FROM tables t LEFT JOIN lines ON l_partkey = p_partkey),
inventory AS (
  SELECT *, num_files > 1 AND coalesce(size_bytes, 0) / num_files < 16777216 AS fragmented,
    CAST(floor(epoch(TIMESTAMP '2001-11-10' - last_read_at) / 86400) AS INTEGER) AS days_since_read,
    last_read_at IS NULL AS never_read,
    last_read_at IS NULL OR floor(epoch(TIMESTAMP '2001-11-10' - last_read_at) / 86400) > 90 AS orphan
  FROM sized),
pairs AS (
  SELECT l_partkey, l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS row_count,
    CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_discount >= 0.09::DOUBLE), 0) AS BIGINT) AS null_count,
    min(l_linenumber) AS line_lo, max(l_linenumber) AS line_hi, max(l_tax) AS tax_hi
  FROM lineitem GROUP BY 1, 2),
named AS (
  SELECT table_catalog, table_schema, table_name, table_key, table_type, is_writable, system, p_name, p_brand, p_size,
    table_comment, has_comment AS table_has_comment, pairs.*, {_kind(0)} || l_suppkey AS column_name,
    CAST(l_suppkey + 1 AS INTEGER) AS ordinal_position, {_kind(1)} AS data_type, {_kind(2)} AS kind_label
  FROM tables JOIN pairs ON l_partkey = p_partkey),
judged AS (
  SELECT *,
    CASE WHEN line_lo > 5 THEN 'Column ' || column_name || ' of ' || p_name WHEN line_lo = 5 THEN ' '
      WHEN line_lo = 4 THEN '' END AS column_comment,
    CAST(CASE WHEN null_count = row_count THEN 0 ELSE line_hi END AS BIGINT) AS distinct_count,
    null_count = row_count AS is_all_null,
    {_name_label('column_name')} AS pii_by_name,
    CASE WHEN data_type = 'string' AND tax_hi >= 0.08::DOUBLE THEN 'email' END AS pii_by_value,
    CASE line_hi WHEN 2 THEN 'none' WHEN 3 THEN 'other_pii' ELSE kind_label END AS model_label,
    CASE WHEN line_hi = 4 THEN '' ELSE 'It''s the ' || column_name || ' of ' || p_name END AS described,
    CASE WHEN line_lo >= 3 THEN 'Coluna ' || column_name END AS described_pt,
    CASE WHEN line_lo <= 2 THEN system || ': ' || p_brand || ';  ; ' || system || ': ' || p_name END AS packed
  FROM named),
columns_ AS (
  SELECT *, coalesce(column_comment <> '', false) AS has_comment, distinct_count = 1 AS is_constant,
    distinct_count <= 1 AS dead, pii_by_name IS NOT NULL OR pii_by_value IS NOT NULL AS is_pii_candidate,
    pii_by_name IS NOT NULL OR pii_by_value IS NOT NULL OR model_label <> 'none' AS is_pii,
    coalesce(pii_by_name, pii_by_value) AS regex_label
  FROM judged)"""

_AGREEMENT = (
    "CASE WHEN {p} AND {m} THEN 'both' WHEN {p} THEN 'regex_only' WHEN {m} THEN 'llm_only' ELSE 'neither' END"
)
_SAID = _AGREEMENT.format(p="is_pii_candidate", m="model_label <> 'none'")


def _estate(query: str, *more: str) -> str:
    return "WITH " + ",\n".join([ESTATE, *more]) + "\n" + query


# Counts behind score and summary; `with_comment` is the condition for a comment being there.
def _measures(key: str, suffix: str = "", with_comment: str = "has_comment") -> str:
    return f"""table_counts{suffix} AS (
  SELECT {key} AS k, count(*) AS n_tables, count(*) FILTER (WHERE {with_comment}) AS documented_tables,
    count(*) FILTER (WHERE orphan) AS orphans, count(*) FILTER (WHERE fragmented) AS fragmented_tables
  FROM inventory GROUP BY 1),
column_counts{suffix} AS (
  SELECT {key} AS k, count(*) AS n_columns, count(*) FILTER (WHERE {with_comment}) AS documented_columns,
    count(*) FILTER (WHERE is_pii_candidate) AS pii_columns,
    count(*) FILTER (WHERE is_pii_candidate AND {with_comment}) AS pii_documented,
    count(*) FILTER (WHERE dead) AS dead
  FROM columns_ GROUP BY 1),
measures{suffix} AS (
  SELECT k, coalesce(n_tables, 0) AS n_tables, coalesce(documented_tables, 0) AS documented_tables,
    coalesce(orphans, 0) AS orphans, coalesce(fragmented_tables, 0) AS fragmented_tables,
    coalesce(n_columns, 0) AS n_columns, coalesce(documented_columns, 0) AS documented_columns,
    coalesce(pii_columns, 0) AS pii_columns, coalesce(pii_documented, 0) AS pii_documented, coalesce(dead, 0) AS dead
  FROM table_counts{suffix} FULL JOIN column_counts{suffix} USING (k)),
rates{suffix} AS (
  SELECT k, coalesce((documented_columns + documented_tables) / nullif(n_columns + n_tables, 0), 1.0) AS documentation,
    coalesce(pii_documented / nullif(pii_columns, 0), 1.0) AS pii_governance,
    coalesce(1.0 - orphans / nullif(n_tables, 0), 1.0) AS freshness,
    coalesce(1.0 - dead / nullif(n_columns, 0), 1.0) AS column_quality,
    coalesce(1.0 - fragmented_tables / nullif(n_tables, 0), 1.0) AS delta_hygiene
  FROM measures{suffix}),
scores{suffix} AS (
  SELECT *, documentation * 0.30 + pii_governance * 0.25 + freshness * 0.20 + column_quality * 0.15
    + delta_hygiene * 0.10 AS overall
  FROM rates{suffix})"""


_OVERVIEW = """overview AS (
  SELECT i.*, coalesce(c.column_count, 0) AS column_count, coalesce(c.documented_count, 0) AS documented_count,
    coalesce(c.pii_count, 0) AS pii_count, coalesce(c.dead_count, 0) AS dead_count
  FROM inventory i LEFT JOIN (
    SELECT table_key, count(*) AS column_count, count(*) FILTER (WHERE has_comment) AS documented_count,
      count(*) FILTER (WHERE is_pii) AS pii_count, count(*) FILTER (WHERE dead) AS dead_count
    FROM columns_ GROUP BY 1) c USING (table_key))"""

_MARKDOWN = """markdown AS (
  SELECT doc_id, source AS system, regexp_replace(text, '(^|\n)([A-E])', '\\1## \\2', 'g') AS text FROM documents)"""
_LINES = """doc_lines AS (
  SELECT doc_id, system, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
  FROM markdown),
ended AS (
  SELECT * FROM doc_lines d WHERE NOT (line = '' AND n = (SELECT max(n) FROM doc_lines e WHERE e.doc_id = d.doc_id))),
numbered AS (
  SELECT *, count(*) FILTER (WHERE line LIKE '#%') OVER (PARTITION BY doc_id ORDER BY n) AS section FROM ended),
sections AS (
  SELECT doc_id, system, section, min(line) FILTER (WHERE line LIKE '#%') AS heading_line,
    count(*) FILTER (WHERE NOT line LIKE '#%') AS body_lines,
    string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT line LIKE '#%') AS body
  FROM numbered WHERE section > 0 GROUP BY 1, 2, 3)"""
_TITLE = _strip("regexp_replace({0}, '^#+', '')")

_TERMS = f"""chunk AS (
  SELECT doc_id AS chunk_id, source AS system, lang || ' ' || doc_id AS heading, text AS body,
    {_tokens("lang || ' ' || doc_id || ' ' || text")} AS tokens
  FROM documents),
term AS (
  SELECT chunk_id, system, greatest(len(tokens), 1) AS length, unnest(tokens) AS term FROM chunk),
tf AS (SELECT chunk_id, system, length, term, count(*) AS tf FROM term GROUP BY ALL),
freq AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY 1),
query AS (
  SELECT item_id AS query_id, 'src' || (item_id % 20) AS system, list_distinct({_tokens('text')}) AS terms FROM benchmark),
wanted AS (SELECT query_id, system, unnest(terms) AS term FROM query),
scored AS (
  SELECT query_id, tf.system, chunk_id, sum(idf * tf) / sqrt(any_value(length)) AS score
  FROM tf JOIN wanted USING (system, term) JOIN freq USING (term)
  GROUP BY 1, 2, 3 HAVING round(sum(idf * tf) / sqrt(any_value(length)), 6) >= 0.5),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, chunk_id) AS rank
  FROM scored QUALIFY rank <= 6)"""

_LAKE_LOG = f"""picked AS (
  SELECT ts, event_id, event_type, ([{', '.join(_quote(n) for n in LAKE_LOGGED)}])[CAST(event_id % 12 + 1 AS INTEGER)] AS p FROM events),
log AS (
  SELECT ts, event_type, event_id,
    CASE WHEN p IN ('embeddings', 'pages') AND ts >= TIMESTAMP '2024-01-10' THEN 'lineitem' ELSE p END AS t
  FROM picked WHERE event_type NOT IN ('signup', 'error')),
names AS (SELECT unnest([{', '.join(_quote(n) for n in [*LAKE_TABLES, 'orders_v2', 'part_v2'])}]) AS table_name)"""

_ESTATE_LOG = """reads AS (
  SELECT l_shipdate AS start_time,
    replace(lower('select count(*) from ' || CASE WHEN l_linestatus = 'F'
      THEN '`' || table_catalog || '`.`' || table_schema || '`.`' || table_name || '`'
      ELSE upper(table_schema || '.' || table_name) END || ' x where x.used > ' || l_linenumber), '`', '') AS txt
  FROM lineitem JOIN registry ON p_partkey = l_partkey
  WHERE p_size < 46 AND l_returnflag <> 'N' AND l_shipdate >= TIMESTAMP '2001-11-10' - INTERVAL 365 DAYS
    AND l_shipdate <= TIMESTAMP '2001-11-10')"""

_SEARCH_TERMS = (
    "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9_\\x{{00C0}}-\\x{{017F}}]+'), "
    "lambda w: length(w) > 2 AND w NOT IN " + _list(SEARCH_STOP_WORDS) + ")"
)
_FIELDS = """fields AS (
  SELECT table_key, ordinal_position AS ordinal, column_name, lower(column_name) AS name,
    lower(table_key || ' ' || column_name || ' ' || coalesce(column_comment, '') || ' ' ||
      concat_ws(' ', pii_by_name, pii_by_value)) AS hay,
    lower(coalesce(table_comment, '')) AS table_hay
  FROM columns_)"""


def _search(queries: str) -> str:
    return f"""asked AS ({queries}),
qterm AS (
  SELECT query_id, term, count(*) AS times, any_value(n) AS n FROM (
    SELECT query_id, len(terms) AS n, unnest(terms) AS term FROM (
      SELECT query_id, {_SEARCH_TERMS.format('query')} AS terms FROM asked)) GROUP BY 1, 2),
vocabulary AS (SELECT DISTINCT term FROM qterm),
hit AS (SELECT term, f.* FROM vocabulary JOIN fields f ON contains(hay, term)),
weight AS (
  SELECT term, ln(((SELECT count(*) FROM fields) + 1) / (coalesce(seen, 0) + 1)) + 1 AS idf
  FROM vocabulary LEFT JOIN (SELECT term, count(*) AS seen FROM hit GROUP BY 1) USING (term))"""


_RUN_WORDS = "len(regexp_split_to_array(text, '\\s+'))"

ORACLES: dict[str, str] = {}

ORACLES["table_inventory"] = "\nUNION ALL ".join(
    f"SELECT 'lake' AS table_catalog, '{SCHEMA_OF[t]}' AS table_schema, '{t}' AS table_name, 'MANAGED' AS table_type, "
    f"true AS is_writable, {str(t in ('orders', 'events')).lower()} AS has_comment, count(*) AS row_count, "
    f"CAST({len(c.split())} AS BIGINT) AS columns FROM {t}"
    for t, c in COLUMNS.items()
)
ORACLES["estate_inventory"] = _estate(
    "SELECT table_catalog, table_schema, table_name, table_type, is_writable, has_comment, row_count, size_bytes, "
    "num_files, fragmented, last_read_at, days_since_read, never_read FROM inventory"
)
ORACLES["column_profile"] = (
    "SELECT table_schema, table_name, column_name, ordinal_position, row_count, null_count, "
    "null_count / nullif(row_count, 0) AS null_ratio, row_count > 0 AND null_count = row_count AS is_all_null, "
    f"is_constant FROM ({_profile(COLUMNS)})"
)
ORACLES["approx_distinct"] = (
    "SELECT table_schema, table_name, column_name, approx IS NOT NULL AS within_tolerance FROM ("
    + "\nUNION ALL ".join(
        f"SELECT '{SCHEMA_OF[t]}' AS table_schema, '{t}' AS table_name, '{c.rstrip('*')}' AS column_name, "
        f"count(\"{c.rstrip('*')}\") AS approx FROM {t}"
        for t, cs in COLUMNS.items()
        for c in cs.split()
    )
    + ")"
)
TEXT_COLUMNS = {
    "region": ["r_name"], "nation": ["n_name"], "customer": ["c_name", "c_mktsegment"], "supplier": ["s_name"],
    "part": ["p_name", "p_brand", "p_type"], "orders": ["o_orderstatus", "o_orderpriority"],
    "lineitem": ["l_returnflag", "l_linestatus"], "events": ["event_type", "props"],
    "documents": ["text", "lang", "source"], "pages": ["url", "html"], "benchmark": ["text"],
    "conversations": ["role", "text"],
}
_LAKE_NAMES = ", ".join(_quote(n) for n in ALL_TABLES)
ORACLES["lake_health"] = f"""WITH {CONTACTS}, {LEGACY}, {_LAKE_LOG},
seen AS (SELECT n, max(ts) AS r FROM (SELECT unnest([{_LAKE_NAMES}]) AS n) LEFT JOIN log ON t = n GROUP BY 1),
inventory AS (
  SELECT 'lake' AS table_catalog, n IN ('orders', 'events') AS has_comment, false AS fragmented,
    r IS NULL OR epoch(TIMESTAMP '2024-04-15' - r) >= 91 * 86400 AS orphan FROM seen),
columns_ AS (
  SELECT 'lake' AS table_catalog, false AS has_comment, {_name_label('column_name')} IS NOT NULL OR pii_by_value IS NOT NULL AS is_pii_candidate,
    is_constant OR (row_count > 0 AND null_count = row_count) AS dead FROM ({_profile(ALL_TABLES, labels=True)})),
{_measures("table_catalog")}
SELECT k AS table_catalog, round(documentation, 6) AS documentation, round(pii_governance, 6) AS pii_governance,
  round(freshness, 6) AS freshness, round(column_quality, 6) AS column_quality, round(delta_hygiene, 6) AS delta_hygiene,
  round(overall, 6) AS overall, CAST(round_even(overall * 100, 0) AS INTEGER) AS score FROM scores"""
ORACLES["lake_severities"] = f"""WITH {CONTACTS}, {LEGACY}, {_LAKE_LOG},
seen AS (SELECT n, max(ts) AS r FROM (SELECT unnest([{_LAKE_NAMES}]) AS n) LEFT JOIN log ON t = n GROUP BY 1),
counted AS (
  SELECT 'lake.' || table_schema || '.' || table_name AS table_key, table_name,
    count(*) FILTER ({_name_label('column_name')} IS NOT NULL OR pii_by_value IS NOT NULL) AS pii,
    count(*) FILTER (is_constant OR (row_count > 0 AND null_count = row_count)) AS dead
  FROM ({_profile(ALL_TABLES, labels=True)}) GROUP BY 1, 2)
SELECT table_key, 'high' AS severity, pii || ' personal-data column' || CASE WHEN pii = 1 THEN '' ELSE 's' END AS finding FROM counted WHERE pii > 0
UNION ALL SELECT table_key, 'medium', 'never read' FROM counted JOIN seen ON n = table_name WHERE r IS NULL OR epoch(TIMESTAMP '2024-04-15' - r) >= 91 * 86400
UNION ALL SELECT table_key, 'low', dead || ' dead column' || CASE WHEN dead = 1 THEN '' ELSE 's' END FROM counted WHERE dead > 0"""
# every given table is one file
ORACLES["file_fragments"] = "\nUNION ALL ".join(
    f"SELECT '{SCHEMA_OF[t]}' AS table_schema, '{t}' AS table_name, false AS fragmented" for t in COLUMNS
)
ORACLES["merged_distinct"] = ORACLES["approx_distinct"]
ORACLES["undocumented"] = _estate(
    "SELECT k AS table_catalog, n_tables - documented_tables AS undocumented_tables, "
    "n_columns - documented_columns AS undocumented_columns, pii_columns - pii_documented AS undocumented_pii FROM measures",
    _measures("table_catalog"),
)
ORACLES["ownership"] = _estate(
    "SELECT table_catalog, table_schema, table_name, CASE WHEN table_owner IS NULL THEN 'no owner' ELSE 'service principal' END "
    "AS problem FROM tables WHERE table_owner IS NULL OR table_owner NOT LIKE '%@%'"
)
ORACLES["pii_by_name"] = _estate("SELECT table_key, column_name, pii_by_name FROM columns_")
ORACLES["pii_by_value"] = (
    f"WITH {CONTACTS} SELECT table_name, column_name, pii_by_value FROM "
    f"({_profile({**COLUMNS, 'contacts': CONTACT_COLUMNS}, labels=True)}) WHERE is_text"
)
_RULES = {
    "email": _email, "national_id_shape": _cpf_shape, "national_id_verified": lambda v: f"{_cpf_shape(v)} AND {_cpf_valid(v)}", "phone": _phone,
}
ORACLES["pii_value_shares"] = f"WITH {CONTACTS} SELECT *, round(matches / nullif(non_null, 0), 9) AS share FROM (" + "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c[:-1]}' AS column_name, '{rule}' AS rule, count(*) FILTER ({test(c[:-1])}) AS matches, count({c[:-1]}) AS non_null FROM {t}"
    for t, names in {**COLUMNS, "contacts": CONTACT_COLUMNS}.items()
    for c in names.split()
    if c.endswith("*")
    for rule, test in _RULES.items()
) + ")"
ORACLES["pii_token_scan"] = (
    "SELECT lang, label, count(*) AS words FROM (SELECT lang, " + _value_label("w") + " AS label FROM ("
    "SELECT lang, unnest(regexp_split_to_array(text, '\\s+')) AS w FROM documents)) WHERE label IS NOT NULL GROUP BY 1, 2"
)
ORACLES["pii_candidates"] = _estate(
    "SELECT table_key, column_name, regex_label AS label FROM columns_ WHERE is_pii_candidate"
)
_ORDER_CPF = _cpf_from("lpad(CAST(o_orderkey AS VARCHAR), 9, '0')")
ORACLES["cpf_check"] = (
    f"SELECT o_orderstatus, {_cpf_valid('cpf')} AS is_valid, count(*) AS numbers, min(cpf) AS smallest FROM ("
    "SELECT o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN left(c, 10) || ((CAST(right(c, 1) AS INTEGER) + 1) % 10) ELSE c END AS cpf "
    f"FROM (SELECT o_orderstatus, {_ORDER_CPF} AS c FROM orders)) GROUP BY 1, 2"
)


def _samples(table: str, key: str, columns: list[str], flagged: set[str]) -> str:
    rows = []
    for c in columns:
        shown = (
            f"CASE WHEN {c} IS NULL THEN 'NULL' WHEN length({c}) > 2 THEN left({c}, 2) || '***' ELSE '***' END"
            if c in flagged
            else f"coalesce({c}, 'NULL')"
        )
        rows.append(
            f"SELECT '{table}' AS table_name, '{c}' AS column_name, left(string_agg({shown}, ', ' ORDER BY {key}), 500) "
            f"AS sample_values, {str(c in flagged).lower()} AS sample_redacted FROM (SELECT * FROM {table} ORDER BY {key} LIMIT 5)"
        )
    return "\nUNION ALL ".join(rows)


ORACLES["redacted_samples"] = f"WITH {CONTACTS} " + "\nUNION ALL ".join(
    [
        _samples("customer", "c_custkey", ["c_name", "c_mktsegment"], {"c_name"}),
        _samples("supplier", "s_suppkey", ["s_name"], {"s_name"}),
        _samples("part", "p_partkey", ["p_name", "p_brand"], {"p_name"}),
        _samples("nation", "n_nationkey", ["n_name"], {"n_name"}),
        _samples("region", "r_regionkey", ["r_name"], {"r_name"}),
        _samples("contacts", "c_custkey", ["contact", "line_no", "document_no", "nickname"], {"contact", "line_no", "document_no"}),
    ]
)
_DATE_FORM = "count(*) FILTER (CAST(TRY_CAST(v AS DATE) AS VARCHAR) = trim(v))"
ORACLES["type_mismatch"] = "\nUNION ALL ".join(
    f"SELECT *, inferred_type <> 'string' AS type_looks_wrong FROM (SELECT '{t}' AS table_name, '{n}' AS column_name, count(v) AS non_null, "
    f"count(TRY_CAST(v AS DOUBLE)) AS as_double, {_DATE_FORM} AS as_date, count(TRY_CAST(v AS TIMESTAMP)) AS as_timestamp, "
    f"CASE WHEN count(v) = 0 THEN 'string' WHEN count(TRY_CAST(v AS DOUBLE)) = count(v) THEN 'double' WHEN {_DATE_FORM} = count(v) THEN 'date' "
    f"WHEN count(TRY_CAST(v AS TIMESTAMP)) = count(v) THEN 'timestamp' ELSE 'string' END AS inferred_type "
    f"FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {source}))"
    for t, n, c, source in [
        *[(table, name, name, table) for table, names in TEXT_COLUMNS.items() for name in names],
        ("price_text", "price_text", "l_extendedprice", "lineitem"),
        ("date_text", "date_text", "CAST(o_orderdate AS DATE)", "orders"),
        ("time_text", "time_text", "ts", "events"),
    ]
)
ORACLES["dead_columns"] = (
    f"WITH {CONTACTS}, {LEGACY} SELECT table_schema, table_name, column_name, CASE WHEN null_count = row_count THEN '100% null' "
    f"ELSE 'single value across all rows' END AS problem FROM ({_profile(ALL_TABLES)}) "
    "WHERE (row_count > 0 AND null_count = row_count) OR is_constant"
)
ORACLES["last_read"] = f"WITH {_LAKE_LOG} SELECT table_name, max(ts) AS last_read_at FROM names JOIN log ON t = table_name GROUP BY 1"
ORACLES["last_read_substring"] = (
    f"WITH {_LAKE_LOG} SELECT table_name, max(ts) AS last_read_at FROM names JOIN log "
    "ON contains('lake.raw.' || t, 'raw.' || table_name) GROUP BY 1"
)
ORACLES["orphan_tables"] = (
    f"WITH {_LAKE_LOG}, found AS (SELECT table_name, max(ts) AS r FROM names LEFT JOIN log ON t = table_name GROUP BY 1), "
    "aged AS (SELECT table_name, CAST(floor(epoch(TIMESTAMP '2024-04-15' - r) / 86400) AS INTEGER) AS days_since_read, r IS NULL AS never_read FROM found) "
    "SELECT *, CASE WHEN never_read THEN 'never' ELSE days_since_read || ' days ago' END AS last_read FROM aged "
    "WHERE never_read OR days_since_read > 90"
)
ORACLES["estate_last_read"] = _estate(
    "SELECT table_catalog, table_schema, table_name, max(l_shipdate) AS last_read_at FROM tables JOIN lineitem ON l_partkey = p_partkey "
    "WHERE p_size < 46 AND l_returnflag <> 'N' AND l_shipdate >= TIMESTAMP '2001-11-10' - INTERVAL 365 DAYS "
    "AND l_shipdate <= TIMESTAMP '2001-11-10' GROUP BY ALL"
)
ORACLES["estate_last_read_substring"] = _estate(
    "SELECT table_catalog, table_schema, table_name, max(start_time) AS last_read_at FROM tables JOIN reads "
    "ON contains(txt, table_schema || '.' || table_name) GROUP BY ALL",
    _ESTATE_LOG,
)
ORACLES["recent_activity"] = (
    "SELECT event_type, count(*) AS events FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 7 DAYS AND ts <= TIMESTAMP '2024-01-30' GROUP BY 1"
)
ORACLES["findings_summary"] = _estate(
    "\nUNION ALL ".join(
        f"SELECT k AS table_catalog, {i} AS position, '{severity}' AS severity, '{finding}' AS finding, {count} AS findings FROM measures"
        for i, (severity, finding, count) in enumerate(
            [
                ("High", "Personal data columns with no documentation or tag", "pii_columns - pii_documented"),
                ("Medium", "Tables never read in 90 days", "orphans"),
                ("Medium", "Undocumented tables", "n_tables - documented_tables"),
                ("Low", "Undocumented columns", "n_columns - documented_columns"),
                ("Low", "Dead columns (all null or single-valued)", "dead"),
                ("Low", "Fragmented tables (never optimised)", "fragmented_tables"),
            ],
            start=1,
        )
    ),
    _measures("table_catalog"),
)
_FINDINGS = f"""SELECT table_key, 0 AS severity_rank, 'high' AS severity,
  pii_count || ' personal-data column' || CASE WHEN pii_count > 1 THEN 's' ELSE '' END AS finding,
  'needs a masking policy and a retention decision' AS why FROM overview WHERE pii_count > 0
UNION ALL SELECT table_key, 1, 'medium', 'never read', {_human('size_bytes', '%.0f B')} || ' nobody has queried' FROM overview WHERE orphan
UNION ALL SELECT table_key, 2, 'low', dead_count || ' dead column' || CASE WHEN dead_count > 1 THEN 's' ELSE '' END,
  'always null or a single repeated value' FROM overview WHERE dead_count > 0
UNION ALL SELECT table_key, 2, 'low', 'fragmented', num_files || ' files for ' || {_human('size_bytes', '%.0f B')} FROM overview WHERE fragmented"""
ORACLES["findings_ranked"] = _estate(_FINDINGS, _OVERVIEW)
ORACLES["audit_totals"] = _estate(
    "SELECT table_catalog, count(*) AS tables, CAST(sum(column_count) AS BIGINT) AS columns, CAST(sum(documented_count) AS BIGINT) AS documented, "
    "CAST(sum(pii_count) AS BIGINT) AS pii_columns, count(*) FILTER (WHERE orphan) AS orphans, CAST(sum(dead_count) AS BIGINT) AS dead, "
    "count(*) FILTER (WHERE fragmented) AS fragmented FROM overview GROUP BY 1",
    _OVERVIEW,
)
ORACLES["health_score"] = _estate(
    "SELECT k AS table_catalog, round(documentation, 6) AS documentation, round(pii_governance, 6) AS pii_governance, "
    "round(freshness, 6) AS freshness, round(column_quality, 6) AS column_quality, round(delta_hygiene, 6) AS delta_hygiene, "
    "round(overall, 6) AS overall, CAST(round_even(overall * 100, 0) AS INTEGER) AS score FROM scores",
    _measures("table_catalog"),
)
ORACLES["schema_coverage"] = _estate(
    "SELECT table_catalog, table_schema, count(*) AS tables, CAST(sum(column_count) AS BIGINT) AS columns, "
    "CAST(sum(documented_count) AS BIGINT) AS documented, CAST(coalesce(floor(100 * sum(documented_count) / nullif(sum(column_count), 0) + 0.5), 0) "
    "AS INTEGER) AS percent FROM overview GROUP BY 1, 2",
    _OVERVIEW,
)
ORACLES["storage_cost"] = _estate(
    f"SELECT table_catalog, table_schema, orphans, total_bytes, {_human('total_bytes')} AS total_size, "
    "round(total_bytes / 1073741824 * 0.023, 6) AS monthly_usd, round(1024 * 0.023::DOUBLE, 6) AS usd_per_tb_month FROM ("
    "SELECT table_catalog, table_schema, count(*) AS orphans, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS total_bytes "
    "FROM inventory WHERE orphan GROUP BY 1, 2)"
)
ORACLES["storage_sizes"] = _estate(
    f"SELECT table_key, {_human('size_bytes')} AS size, {_human('num_files * 7', '%.0f B')} AS small_size FROM inventory"
)
ORACLES["tokenize"] = (
    f"SELECT kind, term, count(*) AS uses FROM (SELECT kind, unnest({_tokens('text')}) AS term FROM ("
    "SELECT role AS kind, text FROM conversations UNION ALL SELECT 'benchmark', text FROM benchmark)) GROUP BY 1, 2"
)
ORACLES["chunk_documents"] = (
    f"WITH {_MARKDOWN}, {_LINES} SELECT doc_id, system, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS INTEGER) AS position, "
    f"{_TITLE.format('heading_line')} AS heading, {_strip('body')} AS body FROM sections "
    f"WHERE body_lines > 0 AND {_TITLE.format('heading_line')} <> ''"
)
ORACLES["document_titles"] = (
    f"WITH {_MARKDOWN}, {_LINES} SELECT doc_id, coalesce((SELECT {_TITLE.format('arg_min(line, n)')} FROM doc_lines l "
    "WHERE l.doc_id = m.doc_id AND line LIKE '#%'), 'doc_' || doc_id) AS title FROM markdown m"
)
ORACLES["chunk_terms"] = (
    f"WITH {_TERMS} SELECT chunk_id, CAST(length AS INTEGER) AS length, count(*) AS terms, max(tf) AS top_tf, "
    "max(term) FILTER (WHERE tf = best) AS top_term FROM (SELECT *, max(tf) OVER (PARTITION BY chunk_id) AS best FROM tf) GROUP BY 1, 2"
)
ORACLES["doc_frequency"] = f"WITH {_TERMS} SELECT term, df, round(idf, 6) AS idf FROM freq"
ORACLES["source_mapping"] = _estate(
    "SELECT table_catalog, table_schema, table_name, arg_min(rule.system, prio) AS system FROM tables JOIN rule "
    "ON regexp_full_match(table_schema || '.' || table_name, replace(match, '*', '.*')) GROUP BY ALL",
    "rule(prio, match, system) AS (VALUES " + ", ".join(f"({i}, {_quote(m)}, {_quote(s)})" for i, (m, s) in enumerate(MAPPING)) + ")",
)
ORACLES["tfidf_retrieval"] = (
    f"WITH {_TERMS} SELECT query_id, system, chunk_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM ranked"
)
ORACLES["context_packing"] = f"""WITH {_TERMS},
block AS (
  SELECT r.*, '## ' || heading || chr(10) || body AS block, r.system || ': ' || heading AS citation,
    list_filter(list_distinct(tokens), lambda w: list_contains(terms, w)) AS overlap
  FROM ranked r JOIN chunk USING (chunk_id) JOIN query USING (query_id)),
packed AS (
  SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM block QUALIFY used <= 6000)
SELECT query_id, system, md5(string_agg(block, chr(10) || chr(10) ORDER BY rank)) AS context_md5,
  CAST(length(string_agg(block, chr(10) || chr(10) ORDER BY rank)) AS INTEGER) AS context_chars,
  string_agg(citation, '; ' ORDER BY rank) AS citations,
  array_to_string(list_sort(list_distinct(flatten(list(overlap)))), ', ') AS matched_terms
FROM packed GROUP BY 1, 2"""
ORACLES["table_grounding"] = _estate(
    "SELECT table_key AS query_id, system, array_to_string(list_sort(list_distinct(flatten(list(tokens)))), ' ') AS terms FROM ("
    f"SELECT table_key, system, {_tokens('table_name')} AS tokens FROM tables WHERE system IS NOT NULL UNION ALL "
    f"SELECT table_key, system, {_tokens('column_name')} FROM columns_ WHERE system IS NOT NULL) GROUP BY 1, 2"
)
ORACLES["scan_load"] = _estate(
    "SELECT table_catalog, table_schema, table_name, column_name, data_type, row_count, null_count, distinct_count, regex_label, "
    "has_comment, table_type, is_writable, table_has_comment FROM columns_"
)
ORACLES["prompt_build"] = _estate(
    "SELECT table_catalog, table_schema, table_name, CAST(length(prompt) AS INTEGER) AS chars, md5(prompt) AS prompt_md5 FROM prompts",
    """prompts AS (
  SELECT table_catalog, table_schema, table_name, CASE WHEN any_value(system) IS NULL THEN '' ELSE 'SOURCE DOCUMENTATION (' || any_value(system)
    || '):' || chr(10) || '## ' || any_value(p_name) || chr(10) || 'Made by ' || any_value(p_brand) || chr(10) || chr(10)
    || 'END OF DOCUMENTATION.' || chr(10) || chr(10) END || 'Table: ' || table_schema || '.' || table_name || ' ('
    || any_value(table_type) || ')' || chr(10) || 'Columns:' || chr(10) || string_agg(
      '- ' || column_name || ' (' || data_type || '), ' || row_count || ' rows, ' || null_count || ' nulls, ' || distinct_count || ' distinct' ||
      CASE WHEN is_pii_candidate THEN ' [SENSITIVE: values withheld]'
        ELSE ', samples: v' || row_count || ', NULL, x' || line_hi END, chr(10) ORDER BY ordinal_position) AS prompt
  FROM columns_ GROUP BY 1, 2, 3)""",
)
ORACLES["suggestion_ingest"] = _estate(
    f"""SELECT table_catalog, table_schema, table_name, column_name, described AS suggested_comment, regex_label AS pii_by_regex,
  model_label AS pii_by_llm, {_SAID} AS pii_agreement, line_hi = 7 AS type_looks_wrong, is_pii_candidate AS values_withheld,
  is_writable AND NOT has_comment AND described <> '' AS applied, system AS doc_system,
  system || ': ' || p_brand || '; ' || system || ': ' || p_name AS doc_citations,
  CASE WHEN system IS NOT NULL THEN replace(p_name, ' ', ', ') END AS doc_matched_terms,
  system IS NOT NULL AND line_lo <= 2 AS grounded_in_docs, described_pt AS suggested_comment_pt FROM columns_"""
)
ORACLES["wrong_type_columns"] = _estate(
    "SELECT table_catalog, table_schema, table_name, column_name, described AS suggested_comment FROM columns_ WHERE line_hi = 7"
)
ORACLES["table_descriptions"] = _estate(
    "SELECT table_catalog, table_schema, table_name, CASE WHEN p_size <= 30 AND table_key IN (SELECT table_key FROM columns_) "
    "THEN ' All ' || p_name || 's \\ ''x'' ' END AS description, CAST(NULL AS VARCHAR) AS description_pt, is_writable AS applied FROM tables"
)
ORACLES["pii_agreement"] = _estate(
    f"SELECT table_catalog, {_SAID} AS pii_agreement, count(*) AS columns, count(*) FILTER (WHERE is_pii_candidate) AS withheld "
    "FROM columns_ GROUP BY 1, 2"
)
ORACLES["label_agreement"] = (
    "SELECT lang, " + _AGREEMENT.format(p="hit", m="toxic = 1") + " AS agreement, count(*) AS documents FROM ("
    "SELECT doc_id, lang, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: " + _email("w") + " OR " + _phone("w")
    + ")) > 0 AS hit FROM documents) JOIN labels USING (doc_id) GROUP BY 1, 2"
)
ORACLES["pii_comparison"] = _estate(
    "SELECT table_catalog, table_schema, table_name, column_name, coalesce(pii_by_name, '-') AS pii_by_name, coalesce(pii_by_value, '-') AS pii_by_value, "
    "CASE WHEN model_label = 'none' THEN '-' ELSE model_label END AS pii_by_llm, CASE WHEN is_pii_candidate THEN 'pattern' ELSE 'model only' END AS origin "
    "FROM columns_ WHERE is_pii"
)
ORACLES["portal_columns"] = _estate(
    "SELECT table_key, column_name, described_pt AS comment_pt, system AS doc_system, is_pii, concat_ws(', ', pii_by_name, pii_by_value, "
    "CASE WHEN model_label <> 'none' AND model_label IS DISTINCT FROM pii_by_name AND model_label IS DISTINCT FROM pii_by_value "
    "THEN model_label || ' (model)' END) AS pii_labels FROM columns_"
)
ORACLES["portal_tables"] = _estate(
    "SELECT t.table_catalog, t.table_schema, t.table_name, CAST(NULL AS VARCHAR) AS comment_pt, CASE WHEN count(c.table_key) > 0 THEN any_value(t.system) END AS doc_system, "
    "CASE WHEN count(c.table_key) > 0 THEN any_value(t.system || ': ' || t.p_brand || ' | ' || t.system || ': ' || t.p_name) END AS passages, "
    "count(*) FILTER (WHERE is_pii) AS pii_count, count(*) FILTER (WHERE dead) AS dead_count "
    "FROM tables t LEFT JOIN columns_ c USING (table_key) GROUP BY ALL"
)
_FQN = "'`' || table_catalog || '`.`' || table_schema || '`.`' || table_name || '`'"
ORACLES["comment_statements"] = _estate(
    f"SELECT table_catalog, table_schema, table_name, 'COMMENT ON TABLE ' || {_FQN} || ' IS ''All ' || p_name || 's \\\\ ''''x''''''' AS statement, is_writable "
    "FROM tables WHERE NOT has_comment AND p_size <= 30 AND table_key IN (SELECT table_key FROM columns_) UNION ALL "
    f"SELECT table_catalog, table_schema, table_name, 'ALTER TABLE ' || {_FQN} || ' ALTER COLUMN `' || column_name || '` COMMENT ''' || "
    "replace(described, '''', '''''') || '''', is_writable FROM columns_ WHERE NOT has_comment AND described <> ''"
)
ORACLES["provenance"] = _estate(
    "SELECT table_catalog, table_schema, table_name, any_value(system) AS doc_system, CASE WHEN count(packed) = 0 THEN '' ELSE "
    "any_value(system || ': ' || p_brand || ' | ' || system || ': ' || p_name) END AS passages FROM columns_ WHERE system IS NOT NULL GROUP BY ALL"
)
ORACLES["doc_usage"] = _estate(
    f"""SELECT doc_id, title, coalesce(tables, 0) AS tables FROM (
  SELECT system AS doc_id, arg_min(coalesce({_TITLE.format('h')}, system), doc_id) AS title FROM (
    SELECT m.system, m.doc_id, (SELECT arg_min(line, n) FROM doc_lines l WHERE l.doc_id = m.doc_id AND line LIKE '#%') AS h FROM markdown m) GROUP BY 1)
  LEFT JOIN (SELECT system AS doc_id, count(*) AS tables FROM tables GROUP BY 1) USING (doc_id)""",
    _MARKDOWN, _LINES,
)
ORACLES["latest_run"] = (
    "SELECT event_type AS store, ts AS started_at, event_id AS run_id, CAST(r - 1 AS INTEGER) AS back FROM ("
    "SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r FROM events) WHERE r <= 2"
)
_DIFF = """cited AS (SELECT table_key, replace(arg_min(packed, column_name), ';  ; ', '; ') AS grounded_in FROM columns_ WHERE packed <> '' GROUP BY 1),
compared AS (
  SELECT c.table_catalog, c.table_schema, c.table_name, c.column_name,
    CASE WHEN line_hi >= 6 THEN '-' WHEN line_lo = 1 THEN 'plain \\| text' ELSE ' ' || described END AS without_docs,
    CASE WHEN described = '' THEN '-' ELSE described END AS with_docs,
    line_hi < 6 AND line_lo = 1 AS changed, grounded_in
  FROM columns_ c LEFT JOIN cited USING (table_key))"""
ORACLES["run_diff"] = _estate("SELECT * FROM compared", _DIFF)
ORACLES["run_counters"] = _estate(
    "SELECT table_catalog, count(DISTINCT table_key) AS tables_processed, count(DISTINCT table_key) FILTER (WHERE system IS NOT NULL) AS tables_grounded, "
    "count(*) FILTER (WHERE described <> '') AS columns_documented, CAST(count(*) FILTER (WHERE described <> '' AND NOT has_comment AND is_writable) "
    "+ (SELECT count(*) FROM tables t WHERE t.table_catalog = c.table_catalog AND NOT has_comment AND is_writable AND p_size <= 30 "
    "AND table_key IN (SELECT table_key FROM columns_)) AS BIGINT) AS comments_staged FROM columns_ c GROUP BY 1"
)
ORACLES["before_after_score"] = _estate(
    "SELECT k AS catalog, CASE WHEN k <> 'promo' THEN CAST(round_even(b.overall * 100, 0) AS INTEGER) END AS before_score, "
    "CAST(round_even(a.overall * 100, 0) AS INTEGER) AS after_score FROM scores_after a JOIN scores b USING (k)",
    _measures("table_catalog"), _measures("table_catalog", "_after", "(has_comment OR is_writable)"),
)
ORACLES["run_cost"] = f"""SELECT run_id, prompt_tokens, completion_tokens, columns_documented, prompt_tokens AS seconds,
  round(cost, 12) AS est_cost_usd, round(cost / nullif(columns_documented, 0), 12) AS usd_per_comment FROM (
  SELECT *, CASE WHEN last_turn NOT IN (1, 2) THEN prompt_tokens / 1e6 * 0.15::DOUBLE + completion_tokens / 1e6 * 0.60::DOUBLE END AS cost FROM (
    SELECT conv_id AS run_id, CAST(coalesce(sum({_RUN_WORDS}) FILTER (WHERE role = 'user'), 0) AS BIGINT) AS prompt_tokens,
      CAST(coalesce(sum({_RUN_WORDS}) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS completion_tokens,
      count(*) FILTER (WHERE role = 'assistant') AS columns_documented, max(turn) AS last_turn
    FROM conversations GROUP BY 1))"""
ORACLES["catalog_search"] = _estate(
    """SELECT query_id, CAST(rank AS INTEGER) AS rank, table_key, column_name, round(score, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, table_key, ordinal) AS rank FROM (
    SELECT query_id, table_key, ordinal, column_name, sum(w * idf * times) * sum(times) / any_value(n) AS score FROM matched
    JOIN qterm USING (term) JOIN weight USING (term) GROUP BY 1, 2, 3, 4) WHERE score > 0.9) WHERE rank <= 6""",
    _FIELDS,
    _search("SELECT DISTINCT p_name AS query_id, 'which email columns hold the ' || p_name AS query FROM part"),
    """matched AS (
  SELECT term, table_key, ordinal, column_name, CASE WHEN contains(name, term) THEN 2.0 WHEN contains(hay, term) THEN 1.0 ELSE 0.25 END AS w
  FROM vocabulary JOIN fields ON contains(hay, term) OR contains(table_hay, term))""",
)
ORACLES["document_search"] = _estate(
    """SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 4) AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM (
    SELECT query_id, doc_id, sum(idf * times) AS score FROM found JOIN qterm USING (term) JOIN weight USING (term) GROUP BY 1, 2)) WHERE rank <= 2""",
    _FIELDS,
    _search("SELECT item_id AS query_id, text AS query FROM benchmark"),
    "page AS (SELECT page_id AS doc_id, lower(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS plain FROM pages)",
    "found AS (SELECT term, doc_id FROM vocabulary JOIN page ON contains(plain, term))",
)
ORACLES["facets"] = _estate(
    "SELECT 'pii' AS facet, table_key, column_name, coalesce(column_comment, '') AS text FROM columns_ WHERE is_pii UNION ALL "
    "SELECT 'dead', table_key, column_name, CASE WHEN is_all_null THEN '100% null' ELSE 'single repeated value' END FROM columns_ WHERE dead UNION ALL "
    "SELECT 'orphan', table_key, '', coalesce(table_comment, '') FROM inventory WHERE orphan"
)
ORACLES["name_filter"] = _estate(
    "SELECT table_key, row_count FROM inventory i WHERE contains(table_key, 'email_1') OR EXISTS ("
    "SELECT 1 FROM columns_ c WHERE c.table_key = i.table_key AND contains(lower(column_name), 'email_1'))"
)
ORACLES["localized_text"] = _estate(
    "SELECT table_key, column_name, coalesce(described_pt, column_comment) AS text_pt, column_comment AS text_en FROM columns_"
)
ORACLES["meta_evolution"] = _estate(
    "SELECT table_key, column_name, described AS suggested_comment, CASE WHEN table_type <> 'MANAGED' THEN system END AS doc_system FROM columns_"
)
ORACLES["curated_filter"] = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F'"
ORACLES["monthly_rollup"] = (
    "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, count(*) AS total, round(sum(o_totalprice), 2) AS amount FROM orders GROUP BY 1"
)
ORACLES["top_months"] = ORACLES["monthly_rollup"] + " ORDER BY month DESC LIMIT 12"
ORACLES["avg_by_group"] = "SELECT c_mktsegment, count(*) AS total, round(avg(c_acctbal), 2) AS average FROM customer GROUP BY 1"
ORACLES["join_agg"] = (
    "SELECT o_orderpriority, count(*) AS total, round(sum(l_extendedprice), 2) AS amount FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"
)
ORACLES["top_groups"] = "SELECT o_custkey, count(*) AS total FROM orders GROUP BY 1 ORDER BY total DESC, o_custkey LIMIT 10"
