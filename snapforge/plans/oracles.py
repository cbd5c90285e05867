"""DuckDB SQL for every query that SQL can express.

The fixtures F1-F8 are restated here as SQL over the pre-registered driver tables,
so the oracle shares no code with the Spark side.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str) -> None:
    if name in ORACLES:
        raise ValueError(f"duplicate oracle {name}")
    ORACLES[name] = sql


# --- fixtures -----------------------------------------------------------------
F1 = """
SELECT CAST(o_custkey AS BIGINT) AS "__KEY", o_orderkey, o_orderstatus, o_orderpriority, o_totalprice,
       o_orderdate AS "__UPLOAD_TIMESTAMP",
       CAST(year(o_orderdate) - 1994 AS INTEGER) AS "__VERSION",
       CAST(make_date(year(o_orderdate), 12, 31) AS TIMESTAMP) AS "__VERSION_TIMESTAMP",
       'user_' || CAST(o_custkey % 7 AS VARCHAR) AS "__UPLOADED_BY",
       'orders_v' || CAST(CAST(year(o_orderdate) - 1994 AS INTEGER) AS VARCHAR) || '.csv' AS "__UPLOAD_FILE_NAME"
FROM orders
"""

F1_LATEST = f"""
SELECT * FROM ({F1}) f1 WHERE "__VERSION" = (SELECT max("__VERSION") FROM ({F1}) m)
"""

F2 = """
SELECT l_partkey AS vk, CAST(l_shipdate AS DATE) AS st,
       CASE WHEN l_linenumber = 7 AND l_quantity > 48 THEN NULL
            ELSE CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) END AS en,
       l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_linestatus
FROM lineitem
"""

_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_TXT = f"(CAST(CAST(floor({_CENTS} / 100) AS BIGINT) AS VARCHAR) || '.' || lpad(CAST({_CENTS} % 100 AS VARCHAR), 2, '0'))"
F3 = f"""
SELECT o_orderkey,
  CASE o_orderkey % 5 WHEN 0 THEN replace({_TXT}, '.', ',') WHEN 1 THEN 'n/a'
       WHEN 2 THEN '  ' || {_TXT} || ' ' WHEN 3 THEN {_TXT} || ' EUR' ELSE {_TXT} END AS amount_txt,
  CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y')
       WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 3 THEN '31-12-9999' ELSE '31-02-2024' END AS date_txt,
  CASE o_orderkey % 5 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN ' ' || CAST(o_custkey AS VARCHAR) || ' '
       WHEN 2 THEN CAST(o_custkey AS VARCHAR) || '.0' WHEN 3 THEN CAST(o_custkey AS VARCHAR) || '.5'
       ELSE '#' || CAST(o_custkey AS VARCHAR) END AS int_txt,
  CASE o_orderkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN ' FALSE ' WHEN 2 THEN '1' WHEN 3 THEN 'yes' ELSE 'maybe' END AS bool_txt,
  CASE WHEN o_orderkey % 7 = 0 THEN '  ' WHEN o_orderkey % 11 = 0 THEN NULL
       WHEN o_orderkey % 29 = 0 THEN chr(160) || chr(8232) ELSE o_orderpriority END AS note_txt,
  CASE WHEN o_orderkey % 13 = 0 THEN 'NULL' WHEN o_orderkey % 17 = 0 THEN 'NA' WHEN o_orderkey % 19 = 0 THEN 'None'
       WHEN o_orderkey % 23 = 0 THEN chr(160) || o_orderstatus || chr(8195) || ' ' || chr(12288) || 'x' || chr(160)
       ELSE o_orderstatus || ' ' || chr(9) || ' ' || o_orderpriority || ' ' END AS comment_txt
FROM orders
"""


# RE2's \s is ASCII and lacks the vertical tab
BLANKS = "\\s\\v\\x1c-\\x1f\\x{85}\\p{Z}"
BLANK = f"[{BLANKS}]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK}+|{BLANK}+$', '', 'g')"


# --- R1-R7 --------------------------------------------------------------------
oracle("latest_snapshot", F1_LATEST)
oracle("max_key", f"""SELECT CAST(coalesce(max("__KEY"), 0) AS BIGINT) AS max_key FROM ({F1}) f WHERE "__KEY" <> 0""")
oracle("next_version", f"""SELECT CAST(coalesce(max("__VERSION") + 1, 1) AS INTEGER) AS next_version FROM ({F1}) f""")
oracle(
    "table_statistics",
    f"""
WITH f AS ({F1}), top AS (SELECT max("__VERSION") AS v FROM f)
SELECT CAST(v + 1 AS INTEGER) AS latest_version, CAST(v + 2 AS INTEGER) AS next_version,
  CAST((SELECT max("__KEY") FROM f) AS BIGINT) AS max_key,
  (SELECT count(*) FROM f) + (SELECT count(*) FROM f WHERE "__VERSION" = v) AS n_rows
FROM top""",
)
oracle(
    "latest_row_per_key",
    f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY "__KEY" ORDER BY "__UPLOAD_TIMESTAMP" DESC, o_orderkey DESC) AS rn
  FROM ({F1_LATEST}) l WHERE "__KEY" <> 0) t
WHERE rn = 1
""",
)
oracle(
    "snapshot_row_count",
    f"""SELECT count(DISTINCT "__KEY") AS row_count FROM ({F1_LATEST}) l WHERE "__KEY" <> 0""",
)
oracle("drop_empty_marker", f"""SELECT * FROM ({F1}) f WHERE "__KEY" <> 0""")
oracle(
    "viewer_page",
    f"""
WITH s AS (SELECT * FROM ({F1_LATEST}) l WHERE "__KEY" <> 0)
SELECT *, (SELECT count(*) FROM s) AS total_rows FROM s
""",
)
oracle(
    "viewer_first_page",
    f"""
WITH s AS (SELECT * FROM ({F1_LATEST}) l WHERE "__KEY" <> 0)
SELECT *, (SELECT count(*) FROM s) AS total_rows FROM s
ORDER BY "__KEY" DESC, "__UPLOAD_TIMESTAMP" DESC, o_orderkey DESC LIMIT 100
""",
)
oracle(
    "rows_by_key",
    f"""
SELECT * FROM ({F1_LATEST}) l
WHERE "__KEY" IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
""",
)


# --- F8 names -------------------------------------------------------------------
F8 = """
SELECT pos, CASE pos % 10
  WHEN 0 THEN lower(p_type) || '_' || y || mm || dd || '.csv'
  WHEN 1 THEN '  ' || p_name || ' ' || dd || '-' || mm || '-' || y || ' '
  WHEN 2 THEN y || ' ' || p_brand || '-' || p_name
  WHEN 3 THEN '_' || upper(p_name) || '__' || CAST(pos AS VARCHAR) || '99' || '.CSV'
  WHEN 4 THEN lower(p_type) || '_staging'
  WHEN 5 THEN lower(p_type) || '_current'
  WHEN 6 THEN lower(p_type) || '_backup_' || CAST(pos AS VARCHAR)
  WHEN 7 THEN '`main`.`' || lower(p_type) || '`.`' || replace(p_name, ' ', '_') || '`'
  WHEN 8 THEN lower(p_type) || '.' || replace(p_name, ' ', '_')
  ELSE chr(160) || p_name || chr(9) || chr(8195) || p_brand || '_sqldf' END AS name
FROM (SELECT p_partkey AS pos, p_type, p_name, p_brand,
             CAST(1995 + p_partkey % 30 AS VARCHAR) AS y,
             lpad(CAST(1 + p_partkey % 12 AS VARCHAR), 2, '0') AS mm,
             lpad(CAST(1 + p_partkey % 28 AS VARCHAR), 2, '0') AS dd
      FROM part) p
"""


def d_date(x: str) -> str:
    t = f"replace({strip(x)}, '/', '-')"
    return (
        f"CASE WHEN {strip(x)} = '' THEN NULL ELSE coalesce(CAST(try_strptime({t}, '%Y-%m-%d') AS DATE), "
        f"CAST(try_strptime({t}, '%d-%m-%Y') AS DATE)) END"
    )


def d_int(x: str) -> str:
    n = f"TRY_CAST({strip(x)} AS DECIMAL(38,10))"
    return f"CASE WHEN {n} = floor({n}) THEN TRY_CAST({n} AS BIGINT) END"


def d_dbl(x: str) -> str:
    n = f"TRY_CAST(replace({strip(x)}, ',', '.') AS DOUBLE)"
    return f"CASE WHEN isnan({n}) THEN NULL ELSE {n} END"


def d_bool(x: str) -> str:
    return f"coalesce(lower({strip(x)}) IN ('true', '1', 'yes', 'y', 't'), false)"


def d_bool_strict(x: str) -> str:
    t = f"lower({strip(x)})"
    return f"CASE WHEN {t} IN ('true', '1') THEN true WHEN {t} IN ('false', '0') THEN false END"


def d_norm(x: str) -> str:
    return f"lower(regexp_replace({strip(x)}, '{BLANK}+', '_', 'g'))"


_AUDIT_SQL = "('__KEY', '__UPLOAD_TIMESTAMP', '__VERSION', '__VERSION_TIMESTAMP', '__UPLOADED_BY', '__UPLOAD_FILE_NAME')"

oracle(
    "normalize_name",
    f"""SELECT pos, {d_norm('name')} AS norm,
       CASE WHEN name IN {_AUDIT_SQL} THEN name ELSE lower(replace(name, ' ', '_')) END AS upload_norm
FROM ({F8}) f""",
)

_CLEAN = """
WITH a AS (SELECT pos, CASE WHEN lower(name) LIKE '%.csv' THEN left(name, length(name) - 4) ELSE name END AS n FROM ({F8}) f),
b AS (SELECT pos, regexp_replace(regexp_replace(regexp_replace(n,
        '(?i)(?:\\b\\d{{1,2}}[-_]\\d{{1,2}}[-_]\\d{{2,4}}\\b)', '', 'g'),
        '\\b(?:19|20)\\d{{2}}\\b', '', 'g'),
        '\\b\\d{{8,}}\\b', '', 'g') AS n FROM a),
c AS (SELECT pos, regexp_replace(regexp_replace(regexp_replace(regexp_replace(n,
        '[-_{BL}]+$', '', 'g'), '^[-_{BL}]+', '', 'g'), '[-{BL}]+', '_', 'g'), '__+', '_', 'g') AS n FROM b),
d AS (SELECT pos, lower(regexp_replace(n, '^_+|_+$', '', 'g')) AS n FROM c)
SELECT pos, CASE WHEN n = '' OR regexp_matches(n, '^[0-9]') THEN '_' || n ELSE n END AS clean FROM d
"""
oracle("clean_table_name", _CLEAN.format(F8=F8, BL=BLANKS))

oracle(
    "short_table_name",
    f"""SELECT pos, CASE WHEN len(string_split(c, '.')) >= 3
                  THEN string_split(c, '.')[2] || '.' || string_split(c, '.')[3] ELSE c END AS short
FROM (SELECT pos, replace(name, '`', '') AS c FROM ({F8}) f) x""",
)

oracle(
    "user_tables",
    f"""SELECT DISTINCT name AS table_name, lower(name) AS sort_key FROM ({F8}) f
WHERE NOT (lower({strip("coalesce(name, '')")}) = ''
        OR suffix(lower({strip("coalesce(name, '')")}), '_staging')
        OR suffix(lower({strip("coalesce(name, '')")}), '_current')
        OR contains(lower({strip("coalesce(name, '')")}), '_backup'))""",
)

_READ_TOKENS = (
    "('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', "
    "'<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"
)
oracle(
    "null_tokens",
    f"""SELECT o_orderkey,
       CASE WHEN comment_txt IN {_READ_TOKENS} THEN NULL ELSE comment_txt END AS comment_read,
       CASE WHEN lower({strip('note_txt')}) IN ('', 'null', 'na', 'nan') THEN NULL ELSE note_txt END AS note_write
FROM ({F3}) f""",
)
oracle(
    "collapse_whitespace",
    f"""SELECT o_orderkey, {strip(f"regexp_replace(comment_txt, '{BLANK}+', ' ', 'g')")} AS comment FROM ({F3}) f""",
)
oracle("coerce_date", f"SELECT o_orderkey, {d_date('date_txt')} AS d FROM ({F3}) f")
oracle("coerce_int", f"SELECT o_orderkey, {d_int('int_txt')} AS i FROM ({F3}) f")
oracle("coerce_decimal", f"SELECT o_orderkey, {d_dbl('amount_txt')} AS amount FROM ({F3}) f")
oracle(
    "coerce_bool",
    f"SELECT o_orderkey, {d_bool('bool_txt')} AS lenient, {d_bool_strict('bool_txt')} AS strict FROM ({F3}) f",
)
TS_TEXT = """
SELECT o_orderkey, CASE o_orderkey % 4
  WHEN 0 THEN strftime(d, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(d, '%Y-%m-%d')
  WHEN 2 THEN strftime(d, '%Y-%m-%dT%H:%M:%S')
  ELSE CASE o_orderkey % 8 WHEN 3 THEN 'not a date' ELSE strftime(d, '%Y-%m-%d %H:%M:%S') || '+02:00' END END AS ts_txt
FROM (SELECT o_orderkey, o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS d FROM orders) o
"""
oracle(
    "coerce_timestamp",
    f"""SELECT o_orderkey, CASE WHEN {strip('ts_txt')} = '' THEN NULL
       WHEN regexp_matches({strip('ts_txt')}, ':[0-9]+[+-][0-9:]+$') THEN make_timestamp(epoch_us(TRY_CAST({strip('ts_txt')} AS TIMESTAMPTZ)))
       ELSE TRY_CAST({strip('ts_txt')} AS TIMESTAMP) END AS ts
FROM ({TS_TEXT}) t""",
)
oracle("is_blank", f"SELECT o_orderkey, (note_txt IS NULL OR {strip('note_txt')} = '') AS note_blank FROM ({F3}) f")


def _fixed(col: str, cleaned: str, pattern: str) -> str:
    return (
        f"SELECT '{col}' AS \"column\", CAST(sum(CASE WHEN {cleaned} IS NOT NULL AND NOT coalesce(regexp_matches({col}, '{pattern}'), false) "
        f"THEN 1 ELSE 0 END) AS BIGINT) AS n_fixed FROM ({F3}) f"
    )


oracle(
    "fix_report",
    " UNION ALL ".join(
        [
            _fixed("amount_txt", d_dbl("amount_txt"), "^-?\\d+(\\.\\d+)?$"),
            _fixed("date_txt", d_date("date_txt"), "^\\d{4}-\\d{2}-\\d{2}$"),
            _fixed("int_txt", d_int("int_txt"), "^-?\\d+$"),
            _fixed("bool_txt", d_bool("bool_txt"), "^(true|false)$"),
        ]
    ),
)

TYPED_F3 = f"""
SELECT o_orderkey, {d_dbl('amount_txt')} AS amount_txt, {d_date('date_txt')} AS date_txt, {d_int('int_txt')} AS int_txt,
       {d_bool('bool_txt')} AS bool_txt, note_txt, comment_txt
FROM ({F3}) f
"""
oracle("apply_schema", TYPED_F3)
oracle(
    "align_columns",
    f"""SELECT o_orderkey, CAST(NULL AS INTEGER) AS region_code, date_txt, amount_txt, bool_txt, note_txt FROM ({TYPED_F3}) t""",
)
oracle(
    "stamp_audit",
    f"""SELECT * REPLACE (CAST((SELECT max("__VERSION") + 1 FROM ({F1}) m) AS INTEGER) AS "__VERSION",
                     TIMESTAMP '2025-01-01 00:00:00' AS "__VERSION_TIMESTAMP")
FROM ({F1_LATEST}) l""",
)
oracle(
    "assign_row_keys",
    f"""SELECT * REPLACE (row_number() OVER (ORDER BY o_orderkey)
                     + (SELECT coalesce(max("__KEY"), 0) FROM ({F1}) m WHERE "__KEY" <> 0) AS "__KEY")
FROM ({F1_LATEST}) l""",
)


# --- V1-V9 -----------------------------------------------------------------------
F6 = """
SELECT p_partkey AS pos, 'erp' AS "Bron", 'Tabel ' || CAST(CAST(floor(p_partkey / 50) AS BIGINT) AS VARCHAR) AS "Tabelnaam", p_name || '  ' || CAST(p_partkey AS VARCHAR) AS "Veldnaam",
  p_name AS "Beschrijving",
  ['STRING', 'varchar', 'INTEGER', 'int', 'BIGINT', 'double', 'DECIMAL', 'boolean', 'DATE', 'timestamp', 'Decimal(10,2)', 'text'][p_size % 12 + 1] AS "Type",
  CAST(p_size AS VARCHAR) AS "Lengte",
  ['true', 'false', 'TRUE', NULL][p_partkey % 4 + 1] AS nullable,
  CASE WHEN p_partkey % 10 = 0 THEN 'true' ELSE 'false' END AS "Uniek",
  CASE p_partkey % 7 WHEN 0 THEN 'ck1' WHEN 1 THEN 'CK2 ' WHEN 2 THEN 'none' WHEN 3 THEN ' ' END AS "Composite_Key",
  CASE p_partkey % 5 WHEN 0 THEN 'true' WHEN 1 THEN 'false' END AS not_editable,
  CASE WHEN p_size = 1 THEN 'true' END AS valid_from,
  CASE WHEN p_size = 2 THEN 'true' END AS valid_to,
  CASE WHEN p_size = 3 THEN 'true' END AS validity_key
FROM part
"""

oracle(
    "check_columns",
    f"""
WITH t AS (SELECT DISTINCT "Tabelnaam" AS "table", {d_norm('"Veldnaam"')} AS "column" FROM ({F6}) f),
u AS (SELECT DISTINCT * FROM (
        SELECT "Tabelnaam" AS "table", {d_norm('"Veldnaam"')} AS "column" FROM ({F6}) f WHERE pos % 8 <> 0
        UNION ALL
        SELECT "Tabelnaam", {d_norm('"Veldnaam"')} || '_extra' FROM ({F6}) f WHERE pos % 9 = 0) x)
SELECT coalesce(t."table", u."table") AS "table", coalesce(t."column", u."column") AS "column",
       CASE WHEN u."column" IS NULL THEN 'missing' ELSE 'extra' END AS status,
       CASE WHEN u."column" IS NULL THEN 'error' ELSE 'warning' END AS severity
FROM t FULL OUTER JOIN u ON t."table" = u."table" AND t."column" = u."column"
WHERE t."column" IS NULL OR u."column" IS NULL
""",
)


def _type_sql(col: str, bad: str, detail: str) -> str:
    return (
        f"SELECT 'type' AS \"check\", '{col}' AS \"column\", CAST(o_orderkey AS BIGINT) AS \"row\", {strip(col)} AS value, "
        f"'{detail}' AS detail FROM ({F3}) f WHERE {col} IS NOT NULL AND {strip(col)} <> '' AND ({bad})"
    )


TYPE_PROBLEMS = " UNION ALL ".join(
    [
        _type_sql("amount_txt", f"NOT regexp_matches({strip('amount_txt')}, '^-?\\d+([.,]\\d+)?([eE][-+]?\\d+)?$')", "expected decimal number"),
        _type_sql("date_txt", f"{d_date('date_txt')} IS NULL", "not a valid DATE"),
        _type_sql("int_txt", f"NOT regexp_matches({strip('int_txt')}, '^-?\\d+$')", "expected BIGINT"),
        _type_sql("bool_txt", f"lower({strip('bool_txt')}) NOT IN ('true', 'false', '1', '0')", "expected BOOLEAN"),
    ]
)
oracle("validate_types", TYPE_PROBLEMS)
oracle("validate_types_summary", f'SELECT "column", count(*) AS n_bad FROM ({TYPE_PROBLEMS}) p GROUP BY 1')

_BLANKS = f"""
SELECT 'amount_txt' AS "column", CAST(o_orderkey AS BIGINT) AS "row" FROM ({TYPED_F3}) t WHERE amount_txt IS NULL OR isnan(amount_txt)
UNION ALL SELECT 'date_txt', o_orderkey FROM ({TYPED_F3}) t WHERE date_txt IS NULL
UNION ALL SELECT 'note_txt', o_orderkey FROM ({TYPED_F3}) t WHERE note_txt IS NULL OR {strip('note_txt')} = ''
"""
oracle("required_counts", f'SELECT "column", count(*) AS n_missing FROM ({_BLANKS}) b GROUP BY 1')
_DUPLICATES = """SELECT l_orderkey, l_linenumber, count(*) AS count FROM lineitem
WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"""
oracle(
    "required_rows",
    f"""SELECT "column", "row", count(*) OVER (PARTITION BY "column") AS n_missing FROM ({_BLANKS}) b""",
)
oracle(
    "required_rows_first",
    f"""SELECT "column", "row", n_missing FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY "row") AS rn,
         count(*) OVER (PARTITION BY "column") AS n_missing FROM ({_BLANKS}) b) x
WHERE rn <= 20""",
)
oracle(
    "duplicate_business_keys",
    f"""WITH g AS ({_DUPLICATES}) SELECT *, (SELECT count(*) FROM g) AS n_groups FROM g""",
)
oracle(
    "duplicate_business_keys_first",
    f"""WITH g AS ({_DUPLICATES}) SELECT *, (SELECT count(*) FROM g) AS n_groups FROM g
ORDER BY l_orderkey, l_linenumber LIMIT 20""",
)
oracle(
    "duplicate_key_groups",
    f"""SELECT p_name, count(*) AS count FROM part WHERE p_name IS NOT NULL AND {strip('p_name')} <> ''
GROUP BY p_name HAVING count(*) > 1""",
)


def d_fold(x: str) -> str:
    return f"replace(lower({strip(x)}), 'ß', 'ss')"


oracle(
    "business_key_conflicts",
    f"""
WITH ex AS (SELECT c_custkey AS xk, {d_fold('c_name')} AS n0 FROM customer),
nw AS (SELECT c_custkey AS "row", CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 100000 END AS "__KEY",
              '  ' || upper(c_name) || ' ' AS c_name FROM customer),
nn AS (SELECT "row", "__KEY", {d_fold('c_name')} AS n0 FROM nw WHERE c_name IS NOT NULL AND {strip('c_name')} <> '')
SELECT "row", "__KEY", array_to_string(list_sort(list(DISTINCT xk))[1:10], ', ') AS conflict_keys, count(DISTINCT xk) AS n_conflicts
FROM nn JOIN ex ON nn.n0 = ex.n0 WHERE xk IS DISTINCT FROM "__KEY" GROUP BY "row", "__KEY"
""",
)
oracle(
    "business_key_conflicts_typed",
    f"""
WITH ex AS (SELECT o_orderkey AS xk, TRY_CAST(CAST(o_custkey AS VARCHAR) AS DECIMAL(38,10)) AS n0, CAST(o_orderdate AS DATE) AS n1
            FROM orders),
nw AS (SELECT o_orderkey AS "row", o_orderkey + 1000000000 AS "__KEY", CAST(o_custkey AS VARCHAR) || '.0' AS ck,
              strftime(o_orderdate, '%Y-%m-%d') AS od FROM orders),
nn AS (SELECT "row", "__KEY", TRY_CAST({strip('ck')} AS DECIMAL(38,10)) AS n0, TRY_CAST({strip('od')} AS DATE) AS n1 FROM nw
       WHERE ck IS NOT NULL AND {strip('ck')} <> '' AND od IS NOT NULL AND {strip('od')} <> '')
SELECT "row", "__KEY", array_to_string(list_sort(list(DISTINCT xk))[1:10], ', ') AS conflict_keys, count(DISTINCT xk) AS n_conflicts
FROM nn JOIN ex ON nn.n0 = ex.n0 AND nn.n1 = ex.n1 WHERE xk IS DISTINCT FROM "__KEY" GROUP BY "row", "__KEY"
""",
)

OVERLAPS = f"""
SELECT * EXCLUDE (_end) FROM (
  SELECT *, max(_end) OVER w AS prev_max_end, lag(st) OVER w AS prev_st, lag(_end) OVER w AS prev_end,
         lag(l_orderkey) OVER w AS prev_l_orderkey, lag(l_linenumber) OVER w AS prev_l_linenumber,
         lag(l_suppkey) OVER w AS prev_l_suppkey, lag(l_extendedprice) OVER w AS prev_l_extendedprice
  FROM (SELECT *, coalesce(en, DATE '2100-12-31') AS _end FROM ({F2}) f WHERE vk IS NOT NULL AND st IS NOT NULL) x
  WINDOW w AS (PARTITION BY vk ORDER BY st, _end, l_orderkey, l_linenumber, l_suppkey, l_extendedprice
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
) y WHERE st <= prev_max_end
"""
oracle("overlapping_validity", OVERLAPS)
oracle("overlapping_validity_keys", f"SELECT vk, count(*) AS n_conflicts FROM ({OVERLAPS}) o GROUP BY vk")

_F2_ID = f"SELECT *, concat_ws('-', l_orderkey, l_linenumber, vk, l_suppkey) AS rid FROM ({F2}) f"
oracle(
    "validity_conflicts",
    f"""
WITH x AS (SELECT *, coalesce(en, DATE '2100-12-31') AS _end,
             (st, coalesce(en, DATE '2100-12-31'), l_orderkey, l_linenumber, l_suppkey, l_extendedprice, rid) AS place
           FROM ({_F2_ID}) f WHERE vk IS NOT NULL AND st IS NOT NULL),
c AS (SELECT a.rid, arg_max(b.rid, (b._end, b.rid)) AS prev_rid
      FROM x a JOIN x b ON a.vk = b.vk AND b.place < a.place AND b._end >= a.st AND b.st <= a._end GROUP BY a.rid),
n AS (SELECT rid FROM ({_F2_ID}) f WHERE l_linestatus = 'O')
SELECT n.rid, c.prev_rid AS partner, 'prev' AS relation FROM n JOIN c ON n.rid = c.rid
UNION ALL
SELECT n.rid, c.rid AS partner, 'next' AS relation FROM n JOIN c ON n.rid = c.prev_rid
""",
)
oracle(
    "row_count_delta",
    f"""
WITH x AS (SELECT (SELECT count(*) FROM orders) AS upload_rows,
                  (SELECT count(DISTINCT "__KEY") FROM ({F1_LATEST}) l WHERE "__KEY" <> 0) AS previous_rows)
SELECT upload_rows, previous_rows, upload_rows - previous_rows AS diff,
       CASE WHEN previous_rows = 0 THEN 'no previous' WHEN upload_rows > previous_rows THEN 'more'
            WHEN upload_rows < previous_rows THEN 'fewer' ELSE 'same' END AS label FROM x
""",
)
_REPORT = f"""
SELECT 2 AS stage, "check", "column" FROM ({TYPE_PROBLEMS}) p
UNION ALL SELECT 3, 'required', "column" FROM ({_BLANKS}) b
UNION ALL SELECT 4, 'duplicate', 'date_txt' FROM (SELECT date_txt FROM ({TYPED_F3}) t WHERE date_txt IS NOT NULL
                                                  GROUP BY date_txt HAVING count(*) > 1) d
"""
oracle("validation_report", f'SELECT stage, "check", "column", count(*) AS n FROM ({_REPORT}) r GROUP BY ALL')
_ALL_STAGES = f"""
SELECT * FROM (VALUES (1, 'missing', 'region_txt'), (1, 'extra', 'comment_txt')) v(stage, "check", "column")
UNION ALL SELECT * FROM ({_REPORT}) r
UNION ALL SELECT 5, 'overlap', 'bool_txt' FROM (
  SELECT date_txt, max(date_txt) OVER (PARTITION BY bool_txt ORDER BY date_txt, o_orderkey
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto
  FROM ({TYPED_F3}) t WHERE bool_txt IS NOT NULL AND date_txt IS NOT NULL) o WHERE date_txt <= upto
"""
oracle("validation_report_all_stages", f'SELECT stage, "check", "column", count(*) AS n FROM ({_ALL_STAGES}) r GROUP BY ALL')
oracle(
    "validation_first_stage",
    f'SELECT stage, "check", "column", count(*) AS n FROM ({_REPORT}) r WHERE stage = (SELECT min(stage) FROM ({_REPORT}) m) GROUP BY ALL',
)


# --- W1-W6 -----------------------------------------------------------------------
_TS = "TIMESTAMP '2025-01-01 00:00:00'"
_NV = f'CAST((SELECT max("__VERSION") + 1 FROM ({F1}) m) AS INTEGER)'
_MK = f'(SELECT coalesce(max("__KEY"), 0) FROM ({F1}) m WHERE "__KEY" <> 0)'
_CARRIED = f'SELECT * REPLACE ({_NV} AS "__VERSION", {_TS} AS "__VERSION_TIMESTAMP") FROM ({F1_LATEST}) l'
_R4 = f"""SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY "__KEY" ORDER BY "__UPLOAD_TIMESTAMP" DESC, o_orderkey DESC) AS rn
  FROM ({F1_LATEST}) l WHERE "__KEY" <> 0) t WHERE rn = 1"""

oracle(
    "publish_add",
    f"""
WITH f1 AS ({F1}), l AS ({F1_LATEST}),
gone AS (SELECT * FROM f1 WHERE "__VERSION" = (SELECT max("__VERSION") - 1 FROM f1)
         AND "__KEY" NOT IN (SELECT "__KEY" FROM l))
{_CARRIED}
UNION ALL
SELECT CAST({_MK} + row_number() OVER (ORDER BY o_orderkey) AS BIGINT), o_orderkey, o_orderstatus, o_orderpriority, o_totalprice,
       {_TS}, {_NV}, {_TS}, 'publisher', 'ui-single-add' FROM gone
""",
)
oracle(
    "publish_edit",
    f"""
WITH r4 AS ({_R4}),
e AS (SELECT "__KEY", o_orderkey, '1-URGENT' AS o_orderpriority, o_totalprice + 1 AS o_totalprice, o_orderstatus AS kept
      FROM r4 WHERE o_orderstatus = 'O')
SELECT * FROM ({_CARRIED}) c WHERE "__KEY" NOT IN (SELECT "__KEY" FROM e)
UNION ALL
SELECT "__KEY", o_orderkey, kept, o_orderpriority, o_totalprice, {_TS}, {_NV}, {_TS}, 'publisher', 'ui-single-update' FROM e
""",
)
oracle(
    "publish_delete",
    f"""SELECT * FROM ({_CARRIED}) c
WHERE "__KEY" NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')""",
)
oracle(
    "empty_snapshot_marker",
    f"""
WITH rem AS (SELECT * FROM ({_CARRIED}) c WHERE "__KEY" NOT IN (SELECT c_custkey FROM customer))
SELECT * FROM rem
UNION ALL
SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), '__EMPTY_SNAPSHOT__', CAST(NULL AS VARCHAR), CAST(0.0 AS DOUBLE),
       {_TS}, {_NV}, {_TS}, 'publisher', 'ui-delete-empty-snapshot'
WHERE (SELECT count(*) FROM rem) = 0
""",
)
oracle(
    "publish_bulk",
    f"""SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS "__KEY", o_orderkey, o_orderstatus, o_orderpriority,
       o_totalprice, {_TS} AS "__UPLOAD_TIMESTAMP", {_NV} AS "__VERSION", {_TS} AS "__VERSION_TIMESTAMP",
       'publisher' AS "__UPLOADED_BY", 'orders_bulk.csv' AS "__UPLOAD_FILE_NAME"
FROM ({F1_LATEST}) l""",
)

oracle(
    "read_upload_quoted",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'He said ""' || text || '";" ;' || chr(10) || lang || '"' AS text,
       row_number() OVER (ORDER BY doc_id) AS "__ROW" FROM documents""",
)
oracle(
    "publish_bulk_after_join",
    f"""SELECT count(*) AS n, count(*) AS n_keys, CAST(1 AS BIGINT) AS first_key, count(*) AS last_key,
       CAST(sum(o_orderkey) AS BIGINT) AS sum_orderkey FROM ({F1_LATEST}) l SEMI JOIN orders USING (o_orderkey)""",
)

F7 = """
SELECT 'erp' AS "Bron", "Tabelnaam",
  CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END AS bulk_insert,
  CASE WHEN n % 3 = 0 THEN 'false' ELSE ' TRUE ' END AS single_insert,
  CASE WHEN n % 4 = 0 THEN 'true' WHEN n % 4 = 1 THEN NULL ELSE 'false' END AS review_required
FROM (SELECT DISTINCT 'Tabel ' || CAST(CAST(floor(p_partkey / 50) AS BIGINT) AS VARCHAR) AS "Tabelnaam",
                      CAST(floor(p_partkey / 50) AS BIGINT) AS n FROM part) p
"""


def d_flag(x: str, default: bool) -> str:
    return f"CASE WHEN {x} IS NULL THEN {str(default).lower()} ELSE lower({strip(x)}) = 'true' END"


oracle(
    "route_changes",
    f"""
WITH ch AS (SELECT event_id, 'Tabel ' || CAST(user_id % 45 AS VARCHAR) AS "table",
                   CASE event_type WHEN 'purchase' THEN 'bulk' WHEN 'view' THEN 'delete' ELSE 'single_update' END AS change_type
            FROM events),
c AS (SELECT "Tabelnaam" AS "table", {d_flag('single_insert', True)} AS si, {d_flag('bulk_insert', True)} AS bi,
             {d_flag('review_required', False)} AS rr FROM ({F7}) f)
SELECT ch."table", event_id, change_type,
  CASE WHEN (starts_with(change_type, 'single') AND NOT coalesce(si, true)) OR (change_type = 'bulk' AND NOT coalesce(bi, true)) THEN 'blocked'
       WHEN coalesce(rr, false) THEN 'review' ELSE 'publish' END AS route
FROM ch LEFT JOIN c ON ch."table" = c."table"
""",
)


# --- C1-C12 -------------------------------------------------------------------------
STAGING = f"""SELECT 'cr-' || lpad(CAST(o_orderkey % (SELECT CAST(ceil(count(*) / 4) AS BIGINT) FROM events) AS VARCHAR), 6, '0') AS "__CR_ID", * FROM ({F1}) f"""
_SC = f'SELECT "__CR_ID" AS cr_id, count(*) AS staged FROM ({STAGING}) s GROUP BY 1'
LOG = f"""
WITH e AS (SELECT *, CAST(floor(event_id / 4) AS BIGINT) AS crn,
                  CASE WHEN event_id % 4 = 0 THEN 'submit' WHEN event_type = 'purchase' THEN 'approve'
                       WHEN event_type = 'error' THEN 'reject' WHEN event_type = 'signup' THEN 'cancel' ELSE 'noop' END AS act
           FROM events)
SELECT 'cr-' || lpad(CAST(crn AS VARCHAR), 6, '0') AS cr_id, event_id AS seq, act AS event,
       'user_' || CAST(user_id AS VARCHAR) AS actor, ts,
       CASE WHEN act = 'submit' THEN 'main.ref.table_' || CAST(crn % 5 AS VARCHAR) END AS target_table,
       CASE WHEN act = 'submit' THEN ['single_add', 'single_update', 'bulk'][crn % 3 + 1] END AS change_type,
       CASE WHEN act = 'submit' THEN props END AS note,
       CASE WHEN act = 'reject' THEN props END AS reason,
       CASE WHEN act = 'submit' THEN CAST(coalesce(sc.staged, 0) AS INTEGER) END AS row_count
FROM e LEFT JOIN ({_SC}) sc ON sc.cr_id = 'cr-' || lpad(CAST(crn AS VARCHAR), 6, '0')
"""


def _fold(with_staging: bool) -> str:
    staged_cond = "AND (event <> 'approve' OR coalesce(staged, 0) > 0)" if with_staging else ""
    return f"""
log AS ({LOG}),
subs AS (SELECT cr_id, seq AS submit_seq, actor AS submitted_by, ts AS submitted_ts, target_table, change_type, note, row_count
         FROM (SELECT *, row_number() OVER (PARTITION BY cr_id ORDER BY seq) AS rn FROM log WHERE event = 'submit') x WHERE rn = 1),
term AS (SELECT t.cr_id, t.seq, t.event, t.actor, t.ts, t.reason, s.submit_seq, s.submitted_by, sc.staged
         FROM log t LEFT JOIN subs s ON t.cr_id = s.cr_id LEFT JOIN ({_SC}) sc ON t.cr_id = sc.cr_id
         WHERE t.event IN ('approve', 'reject', 'cancel')),
valid AS (SELECT * FROM term WHERE submit_seq IS NOT NULL AND seq > submit_seq
          AND (event = 'cancel' OR actor <> submitted_by) {staged_cond}),
dec AS (SELECT cr_id, seq AS decision_seq, event AS decision, actor AS decided_by, ts AS decided_ts, reason
        FROM (SELECT *, row_number() OVER (PARTITION BY cr_id ORDER BY seq) AS rn FROM valid) v WHERE rn = 1)
"""


_STATUS = (
    "CASE decision WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'cancel' THEN 'cancelled' ELSE 'pending' END"
)
VIEW = f"""
WITH {_fold(True)}
SELECT s.cr_id, target_table, change_type, submitted_by, submitted_ts,
       CASE WHEN decision = 'approve' THEN decided_by END AS approved_by,
       CASE WHEN decision = 'approve' THEN decided_ts END AS approved_ts,
       CASE WHEN decision = 'reject' THEN decided_by END AS rejected_by,
       CASE WHEN decision = 'reject' THEN decided_ts END AS rejected_ts,
       {_STATUS} AS status, note, row_count,
       CASE WHEN decision = 'reject' THEN reason END AS rejection_reason
FROM subs s LEFT JOIN dec d ON s.cr_id = d.cr_id
"""
oracle("change_requests", VIEW)
STATUS_NO_STAGING = f"WITH {_fold(False)} SELECT s.cr_id, {_STATUS} AS status FROM subs s LEFT JOIN dec d ON s.cr_id = d.cr_id"
STATUS_STAGING = f"WITH {_fold(True)} SELECT s.cr_id, {_STATUS} AS status FROM subs s LEFT JOIN dec d ON s.cr_id = d.cr_id"
oracle("cr_status", STATUS_NO_STAGING)
oracle("cr_status_counts", f"SELECT status, count(*) AS n FROM ({STATUS_NO_STAGING}) s GROUP BY 1")
oracle(
    "list_changes",
    f"SELECT * FROM ({VIEW}) v WHERE target_table = 'main.ref.table_1' AND status = 'pending' ORDER BY submitted_ts DESC",
)
oracle("changed_tables", f"SELECT DISTINCT target_table FROM ({VIEW}) v")
oracle("submitters", f"SELECT DISTINCT submitted_by FROM ({VIEW}) v")
oracle(
    "pending_count",
    f"SELECT count(*) FILTER (WHERE status = 'pending') AS pending FROM ({VIEW}) v WHERE target_table = 'main.ref.table_2'",
)
oracle("stage_rows", STAGING)
oracle(
    "staged_rows",
    f"""SELECT * EXCLUDE ("__CR_ID") FROM ({STAGING}) s
WHERE "__CR_ID" IN (SELECT cr_id FROM ({STATUS_STAGING}) x WHERE status = 'pending')""",
)
oracle(
    "submit_change",
    f"""SELECT 'cr-new' AS cr_id, CAST((SELECT coalesce(max(event_id), -1) + 1 FROM events) AS BIGINT) AS seq,
       'submit' AS event, 'publisher' AS actor, TIMESTAMP '2025-01-01 00:00:00' AS ts, 'main.ref.orders' AS target_table,
       'bulk' AS change_type, 'bulk reload' AS note,
       CAST((SELECT count(*) FROM ({F1_LATEST}) l) AS INTEGER) AS row_count, CAST(NULL AS VARCHAR) AS reason""",
)


def _decide_sql(event: str, self_label: str | None, done: str) -> str:
    self_case = f"WHEN req.actor = req.submitted_by THEN '{self_label}'" if self_label else ""
    staged_case = "WHEN coalesce(req.staged, 0) = 0 THEN 'no_staged_rows'" if event == "approve" else ""
    return f"""
WITH {_fold(True)}
SELECT req.cr_id, req.seq, req.actor,
       CASE WHEN req.submit_seq IS NULL THEN 'not_found' {self_case}
            WHEN d.decision_seq < req.seq THEN 'not_pending' {staged_case} ELSE '{done}' END AS outcome
FROM term req LEFT JOIN dec d ON req.cr_id = d.cr_id
WHERE req.event = '{event}'
"""


oracle("approve_decisions", _decide_sql("approve", "self_approval", "approved"))
oracle("reject_decisions", _decide_sql("reject", "self_rejection", "rejected"))
oracle("cancel_decisions", _decide_sql("cancel", None, "cancelled"))
oracle(
    "approved_rows",
    f"""SELECT * EXCLUDE ("__CR_ID") FROM ({STAGING}) s
WHERE "__CR_ID" IN (SELECT cr_id FROM ({STATUS_STAGING}) x WHERE status = 'approved')""",
)


# --- M1-M9, M13 -----------------------------------------------------------------------
def d_clean(x: str) -> str:
    n = f"CASE WHEN lower({x}) LIKE '%.csv' THEN left({x}, length({x}) - 4) ELSE {x} END"
    for pat, rep in [
        ("(?i)(?:\\b\\d{1,2}[-_]\\d{1,2}[-_]\\d{2,4}\\b)", ""),
        ("\\b(?:19|20)\\d{2}\\b", ""),
        ("\\b\\d{8,}\\b", ""),
        (f"[-_{BLANKS}]+$", ""),
        (f"^[-_{BLANKS}]+", ""),
        (f"[-{BLANKS}]+", "_"),
        ("__+", "_"),
        ("^_+|_+$", ""),
    ]:
        n = f"regexp_replace({n}, '{pat}', '{rep}', 'g')"
    n = f"lower({n})"
    return f"(CASE WHEN {n} = '' OR regexp_matches({n}, '^[0-9]') THEN '_' || {n} ELSE {n} END)"


def d_text(x: str) -> str:
    return strip(f"coalesce({x}, 'None')")


_MD_NAMES = f'SELECT "Tabelnaam", pos, {d_norm(chr(34) + "Veldnaam" + chr(34))} AS name, * EXCLUDE ("Tabelnaam", pos) FROM ({F6}) f'
BK_GROUPS = f"""
SELECT "Tabelnaam", key_group, string_agg(name, ',' ORDER BY pos) AS key_columns, min(pos) AS first_pos FROM (
  SELECT "Tabelnaam", pos, name,
         CASE WHEN lower({d_text('"Uniek"')}) = 'true' THEN 'single_keys'
              WHEN upper({d_text('"Composite_Key"')}) NOT IN ('', 'NONE') THEN 'composite_key_' || upper({d_text('"Composite_Key"')}) END AS key_group
  FROM ({_MD_NAMES}) m) g
WHERE key_group IS NOT NULL GROUP BY ALL
"""
oracle("business_keys", BK_GROUPS)
BK_PROP = f"""
SELECT "Tabelnaam", key_columns AS business_keys FROM (
  SELECT *, row_number() OVER (PARTITION BY "Tabelnaam" ORDER BY (key_group <> 'single_keys') DESC, first_pos DESC) AS rn
  FROM ({BK_GROUPS}) g) x WHERE rn = 1
"""
oracle("business_key_property", BK_PROP)
_FLAG_ROWS = " UNION ALL ".join(
    f"SELECT \"Tabelnaam\", '{prop}' AS property, pos, name FROM ({_MD_NAMES}) m WHERE lower({d_text(src)}) = '{val}'"
    for src, val, prop in [
        ("nullable", "true", "nullable_columns"),
        ("nullable", "false", "not_null_columns"),
        ("not_editable", "true", "not_editable"),
        ("valid_from", "true", "valid_from"),
        ("valid_to", "true", "valid_to"),
        ("validity_key", "true", "validity_key"),
    ]
)
FLAGS = f"SELECT \"Tabelnaam\", property, string_agg(name, ',' ORDER BY pos) AS value FROM ({_FLAG_ROWS}) r GROUP BY ALL"
oracle("column_flags", FLAGS)
CFG_VALUES = "SELECT \"Tabelnaam\", property, value FROM (" + " UNION ALL ".join(
    f"SELECT \"Tabelnaam\", '{c}' AS property, {strip(c)} AS value FROM ({F7}) c"
    for c in ["bulk_insert", "single_insert", "review_required"]
) + ") v WHERE value IS NOT NULL AND value <> ''"
oracle("config_values", CFG_VALUES)
FPC = f"""SELECT "Tabelnaam", sha256(CAST(to_json(list({{'Composite_Key': "Composite_Key", 'Tabelnaam': "Tabelnaam", 'Type': "Type",
  'Uniek': "Uniek", 'Veldnaam': "Veldnaam", 'not_editable': not_editable, 'nullable': nullable, 'valid_from': valid_from,
  'valid_to': valid_to, 'validity_key': validity_key}} ORDER BY "Veldnaam")) AS VARCHAR)) AS column_metadata_fingerprint
FROM ({F6}) f GROUP BY 1"""
FPG = f"""SELECT "Tabelnaam", sha256(CAST(to_json(list({{'Bron': "Bron", 'bulk_insert': bulk_insert, 'review_required': review_required,
  'single_insert': single_insert}} ORDER BY "Bron", bulk_insert, single_insert, review_required)) AS VARCHAR)) AS table_config_fingerprint
FROM ({F7}) c GROUP BY 1"""
oracle("column_fingerprint", FPC)
oracle("config_fingerprint", FPG)

_PROPS = f"""
SELECT "Tabelnaam" AS "table", 'business_keys' AS key, business_keys AS value FROM ({BK_PROP}) b
UNION ALL SELECT "Tabelnaam", property, value FROM ({FLAGS}) f
UNION ALL SELECT "Tabelnaam", property, value FROM ({CFG_VALUES}) c
"""


def _lst(k: str) -> str:
    return (
        f"list_filter(list_transform(string_split(coalesce(max(value) FILTER (WHERE key = '{k}'), ''), ','), lambda x: {strip('x')}), "
        f"lambda x: x <> '' AND list_contains(cols, x))"
    )


def _flag_agg(k: str, default: bool) -> str:
    v = f"max(value) FILTER (WHERE key = '{k}')"
    return f"CASE WHEN {v} IS NULL THEN {str(default).lower()} ELSE lower({strip(v)}) = 'true' END"


oracle(
    "constraints",
    f"""
WITH cols AS (SELECT "Tabelnaam" AS "table", list(DISTINCT {d_norm('"Veldnaam"')}) AS cols FROM ({F6}) f WHERE pos % 9 <> 0 GROUP BY 1),
p AS ({_PROPS})
SELECT cols."table",
  array_to_string({_lst('not_null_columns')}, ',') AS not_null_columns,
  array_to_string({_lst('business_keys')}, ',') AS business_keys,
  array_to_string({_lst('not_editable')}, ',') AS not_editable,
  {_lst('valid_from')}[1] AS valid_from, {_lst('valid_to')}[1] AS valid_to, {_lst('validity_key')}[1] AS validity_key,
  {_flag_agg('single_insert', True)} AS single_insert, {_flag_agg('bulk_insert', True)} AS bulk_insert,
  {_flag_agg('review_required', False)} AS review_required
FROM cols LEFT JOIN p ON cols."table" = p."table"
GROUP BY cols."table", cols.cols
""",
)

REC = f"""
WITH base AS (
  SELECT c."Tabelnaam", CAST(substring(c."Tabelnaam", 7, 20) AS BIGINT) % 3 AS st, fpc.column_metadata_fingerprint AS cf,
         fpg.table_config_fingerprint AS gf, {strip('c.bulk_insert')} AS b, {strip('c.single_insert')} AS s
  FROM ({F7}) c JOIN ({FPC}) fpc ON c."Tabelnaam" = fpc."Tabelnaam" JOIN ({FPG}) fpg ON c."Tabelnaam" = fpg."Tabelnaam")
SELECT {d_clean('"Tabelnaam"')} AS "table", 'column_metadata_fingerprint' AS key, CASE WHEN st = 1 THEN sha256('old' || cf) ELSE cf END AS value FROM base WHERE st <> 2
UNION ALL SELECT {d_clean('"Tabelnaam"')}, 'table_config_fingerprint', gf FROM base WHERE st <> 2
UNION ALL SELECT {d_clean('"Tabelnaam"')}, 'bulk_insert', CASE WHEN st = 1 THEN CASE WHEN b = 'true' THEN 'false' ELSE 'true' END ELSE b END FROM base WHERE st <> 2
UNION ALL SELECT {d_clean('"Tabelnaam"')}, 'single_insert', s FROM base WHERE st <> 2
"""
EXISTING = f"""SELECT DISTINCT "table" AS name FROM ({REC}) r UNION ALL SELECT DISTINCT "table" || '_current' FROM ({REC}) r"""
PLAN = f"""
WITH d AS (SELECT DISTINCT "Tabelnaam" FROM ({F6}) f WHERE "Tabelnaam" NOT IN ('Tabel 1')),
rec AS ({REC}),
ex AS (SELECT DISTINCT name AS "table" FROM ({EXISTING}) e WHERE NOT contains(name, '_current') AND NOT contains(name, '_sqldf')),
r AS (SELECT "table", max(value) FILTER (WHERE key = 'column_metadata_fingerprint') AS rc,
             max(value) FILTER (WHERE key = 'table_config_fingerprint') AS rg FROM rec GROUP BY 1)
SELECT d."Tabelnaam", {d_clean('d."Tabelnaam"')} AS "table",
  CASE WHEN ex."table" IS NULL THEN 'create'
       WHEN r.rc IS DISTINCT FROM fpc.column_metadata_fingerprint OR r.rg IS DISTINCT FROM fpg.table_config_fingerprint THEN 'reinit'
       ELSE 'skip' END AS action
FROM d LEFT JOIN ({FPC}) fpc ON d."Tabelnaam" = fpc."Tabelnaam" LEFT JOIN ({FPG}) fpg ON d."Tabelnaam" = fpg."Tabelnaam"
LEFT JOIN ex ON ex."table" = {d_clean('d."Tabelnaam"')} LEFT JOIN r ON r."table" = {d_clean('d."Tabelnaam"')}
"""
oracle("plan_tables", PLAN)
oracle(
    "run_summary",
    f"SELECT action AS status, count(*) AS n FROM ({PLAN}) p GROUP BY 1 UNION ALL SELECT 'processed', count(*) FROM ({PLAN}) p",
)

_TYPE_CASE = (
    "CASE upper({x}) WHEN 'STRING' THEN 'string' WHEN 'VARCHAR' THEN 'string' WHEN 'CHAR' THEN 'string' "
    "WHEN 'INTEGER' THEN 'int' WHEN 'INT' THEN 'int' WHEN 'BIGINT' THEN 'bigint' WHEN 'LONG' THEN 'bigint' "
    "WHEN 'FLOAT' THEN 'float' WHEN 'DOUBLE' THEN 'double' WHEN 'DECIMAL' THEN 'decimal(38,2)' WHEN 'BOOLEAN' THEN 'boolean' "
    "WHEN 'DATE' THEN 'date' WHEN 'DATETIME' THEN 'timestamp' WHEN 'TIMESTAMP' THEN 'timestamp' ELSE 'string' END"
)
SCHEMA_ROWS = f"""SELECT "Tabelnaam" AS "table", {d_norm('"Veldnaam"')} AS "column",
  {_TYPE_CASE.format(x=strip('"Type"'))} AS data_type, coalesce(lower({strip('nullable')}) <> 'false', true) AS nullable, pos
FROM ({F6}) f"""
oracle(
    "schema_diff",
    f"""
WITH d AS ({SCHEMA_ROWS}),
c AS (SELECT "table", CASE WHEN pos % 6 = 2 THEN "column" || '_old' ELSE "column" END AS "column",
             CASE WHEN pos % 6 = 0 THEN 'string' ELSE data_type END AS data_type,
             CASE WHEN pos % 6 = 3 THEN NOT nullable ELSE nullable END AS nullable
      FROM d WHERE pos % 6 <> 1),
j AS (SELECT coalesce(c."table", d."table") AS "table", coalesce(c."column", d."column") AS "column",
             c.data_type AS ot, c.nullable AS onl, d.data_type AS nt, d.nullable AS nnl
      FROM c FULL OUTER JOIN d ON c."table" = d."table" AND c."column" = d."column")
SELECT "table", "column",
  CASE WHEN ot IS NULL THEN 'added' WHEN nt IS NULL THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN ot IS NOT NULL AND nt IS NOT NULL THEN "column" || ': ' || ot || CASE WHEN onl THEN ' NULL' ELSE ' NOT NULL' END
       || ' -> ' || nt || CASE WHEN nnl THEN ' NULL' ELSE ' NOT NULL' END END AS detail
FROM j WHERE ot IS NULL OR nt IS NULL OR ot <> nt OR onl <> nnl
""",
)
oracle(
    "config_diff",
    f"""
WITH des AS (
  SELECT {d_clean('"Tabelnaam"')} AS "table", 'column_metadata_fingerprint' AS key, column_metadata_fingerprint AS value FROM ({FPC}) a
  UNION ALL SELECT {d_clean('"Tabelnaam"')}, 'table_config_fingerprint', table_config_fingerprint FROM ({FPG}) b
  UNION ALL SELECT {d_clean('"Tabelnaam"')}, 'bulk_insert', {d_text('bulk_insert')} FROM ({F7}) c
  UNION ALL SELECT {d_clean('"Tabelnaam"')}, 'single_insert', {d_text('single_insert')} FROM ({F7}) c),
cur AS ({REC})
SELECT des."table", des.key, coalesce(cur.value, '<missing>') AS old, des.value AS new
FROM des LEFT JOIN cur ON des."table" = cur."table" AND des.key = cur.key
WHERE cur.value IS DISTINCT FROM des.value
""",
)


# --- S1-S7, M10-M11 ------------------------------------------------------------------------
_F6_TEXT = "SELECT " + ", ".join(
    f'CAST("{c}" AS VARCHAR) AS "{c}"'
    for c in ["pos", "Bron", "Tabelnaam", "Veldnaam", "Beschrijving", "Type", "Lengte", "nullable", "Uniek",
              "Composite_Key", "not_editable", "valid_from", "valid_to", "validity_key"]
) + f" FROM ({F6}) f"
oracle("latest_dated_file", f'SELECT * FROM ({_F6_TEXT}) t WHERE CAST("Lengte" AS INTEGER) % 4 = 3')
oracle("metadata_rows", _F6_TEXT)


def _tok(x: str) -> str:
    return f"CASE WHEN {x} IN {_READ_TOKENS} THEN NULL ELSE {x} END"


oracle(
    "read_upload",
    f"""SELECT CAST(o_orderkey AS VARCHAR) AS order_key, {_tok('amount_txt')} AS amount_txt, {_tok('date_txt')} AS date_txt,
       {_tok('int_txt')} AS int_txt, {_tok('bool_txt')} AS bool_txt, {_tok('note_txt')} AS note_txt,
       {_tok('comment_txt')} AS comment_txt, row_number() OVER (ORDER BY o_orderkey) AS "__ROW"
FROM ({F3}) f""",
)
oracle("export_snapshot", f'SELECT * EXCLUDE ("__KEY") FROM ({F1_LATEST}) l')
oracle(
    "versioned_layout",
    f"""SELECT row_number() OVER (ORDER BY o_orderkey) AS "__KEY", *, {_TS} AS "__UPLOAD_TIMESTAMP", 1 AS "__VERSION",
       {_TS} AS "__VERSION_TIMESTAMP", 'publisher' AS "__UPLOADED_BY", 'metadata_created' AS "__UPLOAD_FILE_NAME"
FROM ({TYPED_F3}) t""",
)
oracle(
    "append_rows",
    f"""SELECT * FROM ({F1}) f
UNION ALL
SELECT * FROM ({_CARRIED}) c WHERE "__KEY" NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')""",
)
oracle("backup_table", F1)
oracle(
    "restore_by_name",
    f"""SELECT "__KEY", CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, o_totalprice, CAST(NULL AS VARCHAR) AS o_comment,
       "__UPLOAD_TIMESTAMP", "__VERSION", "__VERSION_TIMESTAMP", "__UPLOADED_BY", "__UPLOAD_FILE_NAME" FROM ({F1}) f""",
)

oracle("cr_status_stream", STATUS_NO_STAGING)

oracle(
    "approve_decisions_stale",
    f"""
WITH {_fold(True)},
sv AS (SELECT "__CR_ID" AS cr_id, max("__VERSION") AS v FROM ({STAGING}) s GROUP BY 1),
o AS (SELECT req.cr_id, req.seq, req.actor, sv.v,
       CASE WHEN req.submit_seq IS NULL THEN 'not_found' WHEN req.actor = req.submitted_by THEN 'self_approval'
            WHEN d.decision_seq < req.seq THEN 'not_pending' WHEN coalesce(req.staged, 0) = 0 THEN 'no_staged_rows'
            WHEN coalesce(sv.v <= (SELECT max("__VERSION") FROM ({F1}) f), false) THEN 'stale'
            ELSE 'approved' END AS outcome
      FROM term req LEFT JOIN dec d ON req.cr_id = d.cr_id LEFT JOIN sv ON req.cr_id = sv.cr_id
      WHERE req.event = 'approve')
SELECT cr_id, seq, actor,
       CASE WHEN outcome = 'approved' AND row_number() OVER (PARTITION BY v, outcome ORDER BY seq, cr_id) > 1 THEN 'stale'
            ELSE outcome END AS outcome FROM o
""",
)

oracle(
    "cr_titles",
    f"""SELECT cr_id, 'CR ' || left(cr_id, 8) || '... | ' || string_split(target_table, '.')[-1] AS title FROM ({VIEW}) v""",
)

oracle(
    "collapse_whitespace_documents",
    f"""SELECT doc_id, {strip(f"regexp_replace(text, '{BLANK}+', ' ', 'g')")} AS text FROM documents""",
)

oracle(
    "migrate_table",
    f"""SELECT "__KEY", o_orderkey, o_orderstatus, o_totalprice, CAST(NULL AS VARCHAR) AS o_clerk,
       "__UPLOAD_TIMESTAMP", "__VERSION", "__VERSION_TIMESTAMP", "__UPLOADED_BY", "__UPLOAD_FILE_NAME" FROM ({F1}) f""",
)

oracle(
    "user_schemas",
    f"""SELECT DISTINCT {strip('s')} AS schema_name, lower({strip('s')}) AS sort_key
FROM (SELECT string_split(replace(name, '`', ''), '.')[1] AS s FROM ({F8}) f) x
WHERE {strip("coalesce(s, '')")} <> ''
  AND lower({strip("coalesce(s, '')")}) NOT IN ('information_schema', 'app_metadata', 'meta', 'test', 'testing')""",
)

oracle(
    "bootstrap_run",
    """SELECT 'klanten_' || CAST(r_regionkey AS VARCHAR) AS "table",
       CASE r_regionkey WHEN 0 THEN 'created' WHEN 1 THEN 'skipped' WHEN 3 THEN 'rolled_back' ELSE 'reinitialised' END AS outcome,
       CASE WHEN r_regionkey = 0 THEN 0 ELSE (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey
                                              WHERE n_regionkey = r_regionkey) END AS n_rows,
       r_regionkey NOT IN (1, 3) AS new_layout FROM region""",
)

oracle(
    "publish_approved_twice",
    f"""WITH {_fold(False)},
staged AS (SELECT *, CAST((SELECT max("__VERSION") FROM ({F1}) f) + 1 + CAST(substr("__CR_ID", 4) AS BIGINT) % 40 AS INTEGER) AS v
           FROM ({STAGING}) s),
firsts AS (SELECT v, cr_id FROM (
    SELECT DISTINCT v, d.cr_id, row_number() OVER (PARTITION BY v ORDER BY decided_ts, d.cr_id) AS rn
    FROM dec d JOIN subs s ON d.cr_id = s.cr_id JOIN (SELECT DISTINCT "__CR_ID", v FROM staged) g ON g."__CR_ID" = d.cr_id
    WHERE decision = 'approve' AND target_table = 'main.ref.table_1') x WHERE rn = 1)
SELECT CAST(NULL AS VARCHAR) AS cr_id, "__VERSION" AS version, count(*) AS n_rows FROM ({F1}) f GROUP BY "__VERSION"
UNION ALL SELECT CAST(NULL AS VARCHAR), staged.v, count(*) FROM staged JOIN firsts ON "__CR_ID" = firsts.cr_id GROUP BY staged.v
UNION ALL SELECT cr_id, 0, CAST(NULL AS BIGINT) FROM firsts""",
)


# --- key groups (D13), changes, kept keys (D24), rebasing, a race of writers -----------
oracle(
    "duplicate_values",
    """SELECT *, count(*) OVER (PARTITION BY key_group) AS n_values FROM (
        SELECT 'l_orderkey,l_linenumber' AS key_group, l_orderkey || '|' || l_linenumber AS value, count(*) AS count
        FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
        UNION ALL
        SELECT 'l_orderkey,l_suppkey', l_orderkey || '|' || l_suppkey, count(*) FROM lineitem GROUP BY l_orderkey, l_suppkey HAVING count(*) > 1) g""",
)
oracle(
    "duplicate_values_normalized",
    f"""WITH c AS (
        SELECT '  ' || upper(c_name) || ' ' AS c_name, c_nationkey, c_mktsegment FROM customer
        UNION ALL SELECT c_name, c_nationkey, c_mktsegment FROM customer),
    n AS (SELECT {d_fold("c_name")} AS name, CAST(CAST(c_nationkey AS DECIMAL(38, 10)) AS VARCHAR) AS nation, {d_fold("c_mktsegment")} AS segment FROM c)
    SELECT *, count(*) OVER (PARTITION BY key_group) AS n_values FROM (
        SELECT 'c_name' AS key_group, name AS value, count(*) AS count FROM n GROUP BY name HAVING count(*) > 1
        UNION ALL
        SELECT 'c_nationkey,c_mktsegment', nation || '|' || segment, count(*) FROM n GROUP BY nation, segment HAVING count(*) > 1) g""",
)


def _group_conflicts(new: str) -> str:
    """(key_group, row, __KEY, conflict_keys, n_conflicts) of the rows of ``new`` (row, __KEY, c_name, c_nationkey, c_mktsegment)."""
    parts = [
        ("c_name", f"{d_fold('n.c_name')} = {d_fold('c.c_name')}", f"coalesce({strip('n.c_name')}, '') <> ''"),
        ("c_mktsegment,c_nationkey", "n.c_mktsegment = c.c_mktsegment AND n.c_nationkey = c.c_nationkey", "true"),
    ]
    return " UNION ALL ".join(
        f"""SELECT '{g}' AS key_group, "row", "__KEY", array_to_string(list_sort(list(DISTINCT c_custkey))[1:10], ', ') AS conflict_keys,
            count(DISTINCT c_custkey) AS n_conflicts
        FROM ({new}) n JOIN customer c ON {on} WHERE {present} AND c_custkey <> "__KEY" GROUP BY "row", "__KEY" """
        for g, on, present in parts
    )


_NEW_CUSTOMERS = """SELECT c_custkey AS "row", CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 100000 END AS "__KEY",
    {name} AS c_name, c_nationkey, c_mktsegment FROM customer"""
_UPPER_NAME = "'  ' || upper(c_name) || ' '"
oracle("key_group_conflicts", _group_conflicts(_NEW_CUSTOMERS.format(name=_UPPER_NAME)))
_EDITED = _NEW_CUSTOMERS.format(name=f"CASE WHEN c_custkey % 9 <> 0 THEN {_UPPER_NAME} END")
oracle(
    "validate_change",
    f"""WITH n AS ({_EDITED})
    SELECT 6 AS stage, 'unknown_key' AS "check", '__KEY' AS "column", "row", CAST("__KEY" AS VARCHAR) AS value, NULL::VARCHAR AS detail
    FROM n WHERE "__KEY" NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 3, 'required', 'c_name', "row", NULL, 'value is required' FROM n WHERE c_name IS NULL
    UNION ALL SELECT 4, 'duplicate', 'c_name', NULL, c_name, 'count ' || count(*) FROM n WHERE c_name IS NOT NULL GROUP BY c_name HAVING count(*) > 1
    UNION ALL SELECT 4, 'duplicate', 'c_mktsegment,c_nationkey', NULL, c_mktsegment || '|' || c_nationkey, 'count ' || count(*)
        FROM n GROUP BY c_mktsegment, c_nationkey HAVING count(*) > 1
    UNION ALL SELECT 6, 'conflict', key_group, "row", conflict_keys, 'existing keys ' || n_conflicts FROM ({_group_conflicts(_EDITED)}) g""",
)

_UNIQUE = f"""u AS (SELECT * REPLACE (CAST(o_orderkey AS BIGINT) AS "__KEY") FROM ({F1}) f),
    top AS (SELECT max("__VERSION") AS v FROM u),
    latest AS (SELECT u.* FROM u, top WHERE "__VERSION" = v),
    before AS (SELECT u.* FROM u, top WHERE "__VERSION" = v - 1)"""
_UPLOAD = f"""{_UNIQUE},
    upload AS (
        SELECT o_orderkey, o_orderstatus, o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
        FROM latest WHERE o_orderkey % 7 <> 0
        UNION ALL SELECT o_orderkey + 1000000000, o_orderstatus, o_orderpriority, o_totalprice FROM before)"""
oracle(
    "bulk_diff",
    f"""WITH {_UPLOAD}
    SELECT CASE WHEN l.o_orderkey IS NULL THEN 'added' WHEN n.o_orderkey IS NULL THEN 'removed'
        WHEN n.o_totalprice = l.o_totalprice THEN 'unchanged' ELSE 'changed' END AS state,
        l."__KEY", coalesce(n.o_orderkey, l.o_orderkey) AS o_orderkey
    FROM upload n FULL JOIN latest l ON n.o_orderkey = l.o_orderkey""",
)
oracle(
    "publish_bulk_keep_keys",
    f"""WITH {_UPLOAD}, nv AS (SELECT CAST(v + 1 AS INTEGER) AS nv FROM top)
    SELECT l.* REPLACE (nv AS "__VERSION", {_TS} AS "__VERSION_TIMESTAMP") FROM latest l JOIN upload n USING (o_orderkey), nv
    WHERE n.o_totalprice = l.o_totalprice
    UNION ALL SELECT l."__KEY", n.*, {_TS}, nv, {_TS}, 'publisher', 'orders_bulk.csv' FROM upload n JOIN latest l USING (o_orderkey), nv
    WHERE n.o_totalprice <> l.o_totalprice
    UNION ALL SELECT CAST((SELECT max("__KEY") FROM u) + row_number() OVER (ORDER BY n.o_orderkey) AS BIGINT), n.*, {_TS}, nv, {_TS}, 'publisher',
        'orders_bulk.csv' FROM upload n, nv WHERE n.o_orderkey NOT IN (SELECT o_orderkey FROM latest)""",
)
oracle(
    "rebase_snapshot",
    f"""WITH {_UNIQUE}, nv AS (SELECT CAST(v + 2 AS INTEGER) AS nv FROM top)
    SELECT latest.* REPLACE (
        CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 WHEN o_orderkey % 4 = 0 THEN o_totalprice + 7 ELSE o_totalprice END AS o_totalprice,
        nv AS "__VERSION", {_TS} AS "__VERSION_TIMESTAMP")
    FROM latest, nv WHERE o_orderkey % 5 <> 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 11 <> 0)
    UNION ALL SELECT CAST((SELECT max("__KEY") FROM u) + row_number() OVER (ORDER BY n_nationkey) AS BIGINT), n_nationkey + 2000000000, 'N', n_name, 1.5,
        {_TS}, nv, {_TS}, 'publisher', 'ui-single-add' FROM nation, nv""",
)
oracle(
    "publish_race",
    f"""WITH {_UNIQUE}, o AS (SELECT o_orderkey FROM latest WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey FROM before)
    SELECT o_orderkey, count(*) AS n, 3 AS versions, (SELECT count(*) FROM o) AS n_keys FROM o GROUP BY o_orderkey""",
)
