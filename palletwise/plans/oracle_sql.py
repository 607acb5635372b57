"""DuckDB statements equivalent to each registered query.

They are the correctness oracle: the driver runs them on the same parquet
tables and compares row counts, schemas and values with the Spark results.
The views at the top must stay identical to ``palletwise.plans.views``.
"""

from __future__ import annotations

from palletwise.functions.constants import INT_RE, NUM_RE, UNDERSCORE_NUM_RE

PCT = 20.0  # percent paid used by the registered queries
PER_PAGE = 23
RUN_STAMP = "20240105_100000"
UPLOAD_STAMP = "20240105_100000_000000"
NOW = "2024-01-01 12:00:00"
LIST_USER_PAGE, LIST_LIMIT = 2, 10
LIST_USER = "12"


# ---------------------------------------------------------------------------
# expression builders (DuckDB dialect)
# ---------------------------------------------------------------------------

def ws(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def num(x: str) -> str:
    return f"coalesce(CASE WHEN regexp_matches({x}, '{NUM_RE}') THEN TRY_CAST({ws(x)} AS DOUBLE) END, 0.0)"


def cur(x: str) -> str:
    return num(f"regexp_replace({x}, '[$, ]', '', 'g')")


def esum(x: str) -> str:
    return f"coalesce(CAST(SUM(CAST({x} AS DECIMAL(38,6))) AS DOUBLE), 0.0)"


def zpad(x: str, n: int) -> str:
    t = f"CAST({x} AS VARCHAR)"
    return f"(CASE WHEN length({t}) >= {n} THEN {t} ELSE lpad({t}, {n}, '0') END)"


def money(x: str) -> str:
    return f"('$' || format('{{:,.2f}}', {x}))"


def ellipsis(x: str, n: int = 40) -> str:
    t = f"coalesce({x}, 'nan')"
    return f"(CASE WHEN length({t}) > {n} THEN substr({t}, 1, {n}) || '...' ELSE {t} END)"


def fmt_id(x: str) -> str:
    t0 = ws(x)
    t = (f"(CASE WHEN contains({t0}, '_') AND regexp_matches({t0}, '{UNDERSCORE_NUM_RE}') "
         f"THEN replace({t0}, '_', '') ELSE {t0} END)")
    d = f"regexp_replace(regexp_replace({t}, '^[+-]', ''), '^0+', '')"
    v = f"TRY_CAST({t} AS DOUBLE)"
    return (
        f"(CASE WHEN {x} IS NULL THEN 'nan' "
        f"WHEN regexp_matches({t}, '{INT_RE}') THEN (CASE WHEN {d} = '' THEN '0' "
        f"ELSE (CASE WHEN starts_with({t}, '-') THEN '-' ELSE '' END) || {d} END) "
        f"WHEN regexp_matches({t}, '{NUM_RE}') AND abs({v}) < 9.2e18 THEN CAST(CAST(trunc({v}) AS BIGINT) AS VARCHAR) "
        f"ELSE {x} END)"
    )


def clean(x: str) -> str:
    return ws(f"coalesce({x}, '')")


def strip0(x: str) -> str:
    return f"regexp_replace({x}, '^0+', '')"


def safe(x: str) -> str:
    s = f"translate({x}, 'ÀÁÂÃÄÅàáâãäåÇçÈÉÊËèéêëÌÍÎÏìíîïÑñÒÓÔÕÖòóôõöÙÚÛÜùúûüÝýÿ', 'AAAAAAaaaaaaCcEEEEeeeeIIIIiiiiNnOOOOOoooooUUUUuuuuYyy')"
    s = f"regexp_replace({s}, '[^\\x00-\\x7F]', '', 'g')"
    s = f"replace({s}, '/', ' ')"
    s = f"regexp_replace({ws(s)}, '\\s+', '_', 'g')"
    s = f"regexp_replace({s}, '[^A-Za-z0-9_.\\-]', '', 'g')"
    return f"regexp_replace({s}, '^[._]+|[._]+$', '', 'g')"


def order_date(x: str) -> str:
    parsed = f"try_strptime(split_part({x}, 'T', 1), '%Y-%m-%d')"
    return f"(CASE WHEN {x} IS NULL OR {x} = '' THEN 'N/A' ELSE coalesce(strftime({parsed}, '%m/%d/%Y'), {x}) END)"


def pct_of(part: str, whole: str) -> str:
    return (f"(CASE WHEN {whole} > 0 THEN CAST((({part}) * 20000 + ({whole})) // (({whole}) * 2) AS DOUBLE) / 100.0 "
            f"ELSE 0.0 END)")


# ---------------------------------------------------------------------------
# views (mirror palletwise.plans.views)
# ---------------------------------------------------------------------------

POS_FIELDS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
POS = "{" + ", ".join(f"'{f}': l.{f}" for f in POS_FIELDS) + "}"
POS_OUT = ", ".join(f"_pos.{f} AS {f}" for f in POS_FIELDS)

INV = f"""inv AS (
  SELECT {zpad('l.l_orderkey', 8)} AS pallet_id,
         CASE WHEN l.l_partkey % 3 = 0 THEN {zpad('l.l_partkey', 6)} ELSE CAST(l.l_partkey AS VARCHAR) END AS item_id,
         p.p_name AS item_desc,
         CASE WHEN l.l_linenumber % 4 = 0 THEN NULL ELSE p.p_brand END AS series_desc,
         CASE WHEN l.l_linenumber % 5 = 0 THEN '$' ELSE '' END || CAST(CAST(p.p_retailprice AS DECIMAL(12,2)) AS VARCHAR) AS us_price,
         CAST(l.l_quantity AS VARCHAR) AS quantity,
         'file_' || l.l_returnflag || l.l_linestatus || '.csv' AS source_file,
         {POS} AS _pos
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""

REF = f"""ref AS (
  SELECT p_partkey AS id,
         CASE WHEN p_size > 40 THEN 'X' || CAST(p_partkey AS VARCHAR)
              WHEN p_partkey % 5 = 0 THEN {zpad('p_partkey', 8)} ELSE CAST(p_partkey AS VARCHAR) END AS item_number,
         p_name AS description, 'catalogue.csv' AS source_file
  FROM part)"""

REFUP = f"""refup AS (
  SELECT CASE WHEN l.l_linenumber = 7 THEN NULL
              WHEN l.l_partkey % 3 = 0 THEN ' ' || {zpad('l.l_partkey', 6)} || ' '
              ELSE CAST(l.l_partkey AS VARCHAR) END AS "no.",
         CASE WHEN l.l_linenumber % 6 = 0 THEN NULL
              ELSE p.p_name || ' lot ' || CAST(l.l_orderkey AS VARCHAR) END AS description,
         {POS} AS _pos
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)"""

FILES = """files0 AS (
  SELECT CASE WHEN event_type = 'signup' AND event_id % 10 = 0 THEN '.' ELSE '' END
           || event_type || '_' || CAST(event_id AS VARCHAR) || '.'
           || CASE WHEN event_type IN ('click', 'view') THEN 'csv' WHEN event_type = 'purchase' THEN 'pdf' ELSE 'xlsx' END AS nombre,
         CASE WHEN event_type IN ('click', 'view') THEN 'csv' WHEN event_type = 'purchase' THEN 'pdf' ELSE 'xlsx' END AS tipo,
         CAST(user_id AS VARCHAR) AS user_id, ts AS fecha_subida,
         CAST(floor(value * 1000) AS BIGINT) AS tamano
  FROM events),
files AS (SELECT *, tipo || '/' || user_id || '/' || nombre AS url FROM files0)"""

ODATES = """odates AS (
  SELECT o_orderkey,
         CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')
                             WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
                             WHEN 2 THEN CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(month(o_orderdate) AS VARCHAR) || '-' || CAST(day(o_orderdate) AS VARCHAR)
                             WHEN 3 THEN strftime(o_orderdate, '%d/%m/%Y')
                             ELSE '' END AS order_date
  FROM orders)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


# ---------------------------------------------------------------------------
# building blocks shared by several statements
# ---------------------------------------------------------------------------

PALLETS = f"""pallets AS (
  SELECT pallet_id,
         arg_min(series_desc, _pos) FILTER (WHERE series_desc IS NOT NULL) AS series_desc,
         {esum('q')} AS quantity,
         {esum(f'(q * p) * CAST({PCT / 100!r} AS DOUBLE)')} AS extended_percent
  FROM (SELECT pallet_id, series_desc, _pos, {num('quantity')} AS q, {cur('us_price')} AS p FROM inv)
  WHERE pallet_id IS NOT NULL
  GROUP BY pallet_id)"""

# processed ids: distinct (trimmed id, file); reference ids trimmed
ITEMS = f"""pitems AS (
  SELECT DISTINCT {ws('item_id')} AS item_id, source_file FROM inv WHERE item_id IS NOT NULL),
pids AS (SELECT DISTINCT item_id FROM pitems),
rids AS (SELECT DISTINCT {ws('item_number')} AS item_number FROM ref WHERE item_number IS NOT NULL),
rnorm AS (SELECT {strip0('item_number')} AS norm, min(item_number) AS first_ref FROM rids GROUP BY 1),
cmp AS (
  SELECT p.item_id, {strip0('p.item_id')} AS norm,
         r.item_number IS NOT NULL AS exact,
         n.norm IS NOT NULL AS normalised,
         coalesce(r.item_number, n.first_ref) AS matched_with
  FROM pids p
  LEFT JOIN rids r ON r.item_number = p.item_id
  LEFT JOIN rnorm n ON n.norm = {strip0('p.item_id')})"""


def _statements() -> dict[str, str]:
    q: dict[str, str] = {}

    # -- scalar projections -------------------------------------------------
    q["numeric_coerce"] = with_(INV) + f"""
SELECT {POS_OUT}, quantity AS quantity_text, us_price AS price_text,
       {num('quantity')} AS quantity, {num('us_price')} AS us_price
FROM inv"""

    q["currency_clean"] = with_(INV) + f"""
SELECT {POS_OUT}, us_price AS price_text, {cur('us_price')} AS us_price FROM inv"""

    q["extend_prices"] = with_(INV) + f"""
SELECT {POS_OUT}, pallet_id, item_id, q AS quantity, p AS us_price, q * p AS extended_retail,
       (q * p) * CAST({PCT / 100!r} AS DOUBLE) AS extended_percent
FROM (SELECT *, {num('quantity')} AS q, {cur('us_price')} AS p FROM inv)"""

    q["item_id_format"] = with_(INV) + f"""
SELECT DISTINCT item_id AS item_text, {fmt_id('item_id')} AS item_id FROM inv"""

    q["zero_strip"] = with_(INV) + f"""
SELECT DISTINCT item_id, {strip0(ws('item_id'))} AS item_norm FROM inv"""

    q["ellipsis"] = f"""
SELECT p_partkey, {ellipsis("p_name || ' ' || p_type || ' ' || p_brand || ' ' || p_name")} AS description
FROM part"""

    q["money_text"] = f"""
SELECT o_orderkey, {money('o_totalprice')} AS total_text, {money('-o_totalprice')} AS credit_text
FROM orders"""

    q["order_date"] = with_(ODATES) + f"""
SELECT o_orderkey, order_date AS order_date_text, {order_date('order_date')} AS order_date FROM odates"""

    q["file_parts"] = with_(FILES) + f"""
SELECT url, lower(split_part(nombre, '.', -1)) AS ext,
       regexp_extract(nombre, '^(.*)\\.[^.]*$', 1) AS base,
       {safe("regexp_extract(nombre, '^(.*)\\.[^.]*$', 1)")} || '_{RUN_STAMP}.' || lower(split_part(nombre, '.', -1)) AS stamped_name
FROM files"""

    # -- roll-ups -----------------------------------------------------------
    q["pallet_rollup"] = with_(INV, PALLETS) + "SELECT * FROM pallets"

    q["po_lines"] = with_(INV, PALLETS) + f""",
n AS (SELECT count(*) AS c, greatest(1, (count(*) + {PER_PAGE - 1}) // {PER_PAGE}) AS pages FROM pallets),
l AS (SELECT row_number() OVER (ORDER BY pallet_id) AS line_no, * FROM pallets),
t AS (SELECT {esum('quantity')} AS quantity, {esum('extended_percent')} AS extended_percent FROM pallets)
SELECT line_no, pallet_id, {ellipsis('series_desc')} AS description,
       CAST(trunc(quantity) AS BIGINT) AS ordered, {money('extended_percent')} AS ext_price, extended_percent,
       (line_no + {PER_PAGE - 1}) // {PER_PAGE} AS page, pages,
       'Page ' || ((line_no + {PER_PAGE - 1}) // {PER_PAGE}) || ' of ' || pages AS page_label
FROM l, n
UNION ALL
SELECT NULL, NULL, 'TOTAL:', CAST(trunc(t.quantity) AS BIGINT), {money('t.extended_percent')}, t.extended_percent,
       n.pages, n.pages, 'Page ' || n.pages || ' of ' || n.pages
FROM t, n"""

    q["item_rollup"] = with_(INV) + f"""
SELECT {fmt_id('item_id')} AS item_id, item_desc, {esum(num('quantity'))} AS quantity
FROM inv WHERE item_desc IS NOT NULL GROUP BY 1, 2"""

    # -- comparison ---------------------------------------------------------
    cmp = with_(INV, REF, ITEMS)
    q["distinct_items"] = cmp + "SELECT item_id, source_file FROM pitems"
    q["item_files"] = cmp + """
SELECT item_id, array_to_string(list_sort(list(DISTINCT source_file)), '|') AS source_files
FROM pitems GROUP BY item_id"""
    q["exact_matches"] = cmp + "SELECT item_id FROM cmp WHERE exact"
    q["normalised_matches"] = cmp + "SELECT DISTINCT norm FROM cmp WHERE normalised"
    q["item_file_rows"] = cmp + """
SELECT DISTINCT item_id, source_file FROM pitems"""
    q["unmatched_item_files"] = cmp + """
SELECT DISTINCT p.item_id, p.source_file FROM pitems p JOIN cmp USING (item_id) WHERE NOT cmp.normalised"""
    q["unmatched_items"] = cmp + """
SELECT p.item_id, array_to_string(list_sort(list(DISTINCT p.source_file)), '|') AS source_files
FROM pitems p JOIN cmp USING (item_id) WHERE NOT cmp.normalised GROUP BY p.item_id"""
    q["compare_items"] = cmp + """
SELECT item_id, norm, exact, normalised, normalised AS is_matched, matched_with FROM cmp"""
    q["files_with_missing"] = cmp + """
SELECT DISTINCT p.source_file FROM pitems p JOIN cmp USING (item_id) WHERE NOT cmp.normalised"""
    q["comparison_summary"] = cmp + f"""
SELECT total_reference_items, total_processed_items, exact_matches, normalized_matches,
       exact_matches + normalized_matches - exact_norms AS matched_items_count,
       unmatched_count, normalized_matches - exact_matches AS zero_padding_issues,
       {pct_of('total_processed_items - unmatched_count', 'total_processed_items')} AS match_percentage
FROM (SELECT (SELECT count(*) FROM rids) AS total_reference_items,
             count(*) AS total_processed_items,
             count(*) FILTER (WHERE exact) AS exact_matches,
             count(DISTINCT norm) FILTER (WHERE normalised) AS normalized_matches,
             count(DISTINCT norm) FILTER (WHERE exact) AS exact_norms,
             count(*) FILTER (WHERE NOT normalised) AS unmatched_count
      FROM cmp)"""

    # -- reference refresh and table maintenance ------------------------------
    dd = f"""dd AS (
  SELECT left(k, 100) AS item_number, left(arg_min(d, _pos), 500) AS description,
         left({safe("'Reference List (v2).csv'")}, 255) AS source_file
  FROM (SELECT {clean('"no."')} AS k, {clean('description')} AS d, _pos FROM refup)
  WHERE k <> '' AND d <> ''
  GROUP BY k)"""
    q["dedupe_reference"] = with_(REFUP, dd) + "SELECT * FROM dd"
    q["append_if_absent"] = with_(REF, REFUP, dd) + """
SELECT id, item_number, description, source_file FROM ref
UNION ALL
SELECT NULL, item_number, description, source_file FROM dd
WHERE NOT EXISTS (SELECT 1 FROM ref WHERE ref.item_number = dd.item_number)"""
    q["update_by_key"] = with_(REF, REFUP, dd) + """
SELECT r.id, r.item_number, CASE WHEN d.item_number IS NOT NULL THEN d.description ELSE r.description END AS description,
       r.source_file, d.item_number IS NOT NULL AS updated
FROM ref r LEFT JOIN dd d ON d.item_number = r.item_number"""
    q["update_unknown_keys"] = with_(REF, REFUP, dd) + """
SELECT DISTINCT item_number FROM dd
WHERE NOT EXISTS (SELECT 1 FROM ref WHERE ref.item_number = dd.item_number)"""
    q["delete_by_keys"] = with_(REF, REFUP, dd) + """
SELECT * FROM ref WHERE NOT EXISTS (SELECT 1 FROM dd WHERE dd.item_number = ref.item_number)"""
    q["reference_items"] = with_(REF) + "SELECT * FROM ref"
    q["reference_key_collisions"] = with_(REFUP, dd) + """
SELECT item_number, count(*) AS "count" FROM dd GROUP BY item_number HAVING count(*) > 1"""

    # -- file catalogue ---------------------------------------------------------
    listed = """listed AS (SELECT * FROM files
  WHERE tipo IN ('pdf', 'csv', 'xlsx') AND nombre IS NOT NULL AND nombre <> '' AND NOT starts_with(nombre, '.'))"""
    q["search_files"] = with_(FILES) + """
SELECT * FROM files
WHERE tipo IN ('csv') AND nombre IS NOT NULL AND nombre <> '' AND NOT starts_with(nombre, '.')
  AND contains(lower(nombre), 'view_1')"""
    q["list_files_page"] = with_(FILES, listed) + f"""
SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id
                               ORDER BY fecha_subida DESC, list_position(['pdf', 'csv', 'xlsx'], tipo), nombre) AS position
  FROM listed)
WHERE position > {(LIST_USER_PAGE - 1) * LIST_LIMIT} AND position <= {LIST_USER_PAGE * LIST_LIMIT}"""
    q["file_page_info"] = with_(FILES, listed) + f"""
SELECT user_id, count(*) AS total, CAST({LIST_USER_PAGE} AS BIGINT) AS page, CAST({LIST_LIMIT} AS BIGINT) AS "limit",
       (count(*) + {LIST_LIMIT - 1}) // {LIST_LIMIT} AS pages
FROM listed GROUP BY user_id"""
    one = f"""SELECT *, row_number() OVER (ORDER BY fecha_subida DESC, list_position(['pdf', 'csv', 'xlsx'], tipo), nombre) AS position
  FROM listed WHERE user_id = '{LIST_USER}'"""
    term = "contains(lower(nombre), 'view')"
    of_page = f"position > {(LIST_USER_PAGE - 1) * LIST_LIMIT} AND position <= {LIST_USER_PAGE * LIST_LIMIT}"
    q["list_files_one_user"] = with_(FILES, listed) + f"""
SELECT * FROM ({one} AND {term}) WHERE {of_page}"""
    q["list_files_one_user_info"] = with_(FILES, listed) + f"""
SELECT count(*) AS total, CAST({LIST_USER_PAGE} AS BIGINT) AS page, CAST({LIST_LIMIT} AS BIGINT) AS "limit",
       (count(*) + {LIST_LIMIT - 1}) // {LIST_LIMIT} AS pages
FROM listed WHERE user_id = '{LIST_USER}' AND {term}"""
    q["page_after_one_user"] = with_(FILES, listed) + f"""
SELECT * FROM ({one}) WHERE position > {LIST_LIMIT} AND position <= {2 * LIST_LIMIT}"""
    q["expired_files"] = with_(FILES) + f"""
SELECT * FROM files WHERE fecha_subida < TIMESTAMP '{NOW}' - INTERVAL 5 MINUTE"""

    split = "'^(.*[^./][^/]*?)(\\.[^./]*)$'"
    ext = f"lower(CASE WHEN regexp_matches(filename, {split}) THEN regexp_extract(filename, {split}, 2) ELSE '' END)"
    sroot = f"(CASE WHEN regexp_matches(sname, {split}) THEN regexp_extract(sname, {split}, 1) ELSE sname END)"
    q["upload_manifest"] = with_(FILES) + f"""
SELECT filename, ok AS success, CASE WHEN ok THEN stored ELSE filename END AS stored_name,
       CASE WHEN ok THEN sname END AS original_filename,
       CASE WHEN ok THEN 'xlsx/u1/' || stored ELSE '' END AS destination_path,
       CASE WHEN filename IS NULL OR filename = '' THEN 'empty file name'
            WHEN ext NOT IN ('.xlsx', '.xls') THEN 'format not allowed (only .xlsx, .xls)' ELSE '' END AS error
FROM (SELECT *, filename IS NOT NULL AND filename <> '' AND ext IN ('.xlsx', '.xls') AS ok,
             {sroot} || '_{UPLOAD_STAMP}' || ext AS stored
      FROM (SELECT filename, {ext} AS ext, {safe('filename')} AS sname
            FROM (SELECT nombre AS filename FROM files)))"""
    q["manifest_summary"] = with_(FILES) + f"""
SELECT count(*) AS total_files,
       count(*) FILTER (WHERE ok) AS successful_uploads,
       count(*) FILTER (WHERE NOT ok) AS failed_uploads
FROM (SELECT filename IS NOT NULL AND filename <> '' AND {ext} IN ('.xlsx', '.xls') AS ok
      FROM (SELECT nombre AS filename FROM files))"""
    q["admit_files"] = with_(FILES) + """
SELECT filename, ext, admitted, CASE WHEN filename IS NULL OR filename = '' THEN 'empty file name'
                                     WHEN NOT admitted THEN 'unsupported format' END AS reason
FROM (SELECT filename, ext, filename IS NOT NULL AND filename <> '' AND contains(filename, '.') AND ext IN ('csv', 'xlsx') AS admitted
      FROM (SELECT nombre AS filename, lower(split_part(nombre, '.', -1)) AS ext FROM files))"""

    # -- consolidation of differently laid-out files ------------------------
    q["consolidate"] = with_(INV) + f"""
SELECT {POS_OUT}, item_id, quantity, pallet_id, source_file FROM inv WHERE starts_with(source_file, 'file_A')
UNION ALL BY NAME
SELECT {POS_OUT}, quantity, item_id, series_desc, 'x' AS extra, source_file FROM inv WHERE starts_with(source_file, 'file_N')
UNION ALL BY NAME
SELECT {POS_OUT}, item_id, us_price, quantity, item_desc, source_file FROM inv WHERE starts_with(source_file, 'file_R')"""

    # -- the same data through the file sources --------------------------------
    q["files_consolidate"] = with_(INV) + "SELECT series_desc, pallet_id, item_id, item_desc, us_price, quantity FROM inv"
    q["files_item_rollup"] = q["item_rollup"]
    q["files_pallet_rollup"] = q["pallet_rollup"]
    q["files_refresh_reference"] = q["dedupe_reference"]
    q["files_workbook_rollup"] = q["item_rollup"]

    q["currency_strict"] = with_(INV) + f"""
SELECT {POS_OUT}, us_price AS price_text, CAST({ws("regexp_replace(us_price, '[$,]', '', 'g')")} AS DOUBLE) AS us_price FROM inv"""
    q["line_numbers_bucketed"] = with_(INV, PALLETS) + """
SELECT pallet_id, row_number() OVER (ORDER BY pallet_id) AS line_no FROM pallets"""

    desc = "CASE WHEN length(item_desc) % 5 = 0 THEN item_desc || chr(10) || 'second \"line\"' ELSE item_desc END AS item_desc"
    q["files_multiline"] = with_(INV) + f"SELECT series_desc, pallet_id, item_id, {desc}, us_price, quantity FROM inv"
    q["files_manifest"] = with_(INV) + """,
f AS (SELECT source_file AS f, count(*) AS n FROM inv GROUP BY 1),
m(path, source_file, success, error, f) AS (VALUES
  ('list[1].csv', 'list[1].csv', true, NULL, 'file_AF.csv'), ('a b+c%20.csv', 'a b+c%20.csv', true, NULL, 'file_NF.csv'),
  ('_list.csv', '_list.csv', false, 'hidden name', ''), ('user/list[1].csv', 'list[1].csv', true, NULL, 'file_NO.csv'),
  ('notes.txt', 'notes.txt', false, 'unsupported format', ''), ('twice.csv', 'twice.csv', false, 'duplicate columns: item_id', ''),
  ('empty.csv', 'empty.csv', false, 'empty file', ''))
SELECT path, source_file, success, error, coalesce(n, 0) AS n_rows FROM m LEFT JOIN f USING (f)"""
    q["files_fixed_delimiter"] = with_(INV) + """
SELECT sep, series_desc, pallet_id, item_id, item_desc, us_price, quantity FROM inv, (VALUES (','), (';')) t(sep)"""
    q["table_append_read"] = with_(REF) + """
SELECT id, item_number, (SELECT count(*) FROM ref) AS appended FROM (SELECT id, item_number FROM ref
      UNION ALL SELECT id, 'N' || item_number FROM ref)"""
    q["table_replace_read"] = with_(REF) + "SELECT * REPLACE (upper(description) AS description) FROM ref WHERE item_number NOT LIKE 'X%'"
    q["table_one_user_refresh"] = with_(REF) + """
SELECT item_number, description, source_file, user_id, true AS untouched FROM ref, (VALUES ('u1'), ('u3')) t(user_id)
UNION ALL SELECT item_number, upper(description), 'new.csv', 'u2', true FROM ref"""
    q["landed_listing"] = with_(FILES) + f"""
SELECT nombre, tipo, CAST(user_id AS VARCHAR) AS user_id, tamano FROM files WHERE tipo = 'csv' AND CAST(user_id AS VARCHAR) = '{LIST_USER}'"""
    q["job_po_lines"] = q["po_lines"]
    q["job_summary"] = f"""
SELECT *, (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey) AS n_rows, CAST(0 AS BIGINT) AS null_ids,
       CAST(0 AS BIGINT) AS bad_rows, CAST(0 AS BIGINT) AS files_failed FROM ({q["comparison_summary"]})"""
    q["po_headers"] = """
SELECT o_orderkey AS run_id, 'N/A' AS purchase_info, strftime(o_orderdate, '%m/%d/%Y') AS order_date, '' AS seller_name, '' AS "seller_PO",
       '' AS seller_address, CASE WHEN o_orderkey % 2 > 0 THEN 'Customer ' || o_custkey ELSE '' END AS company_name,
       '' AS company_address, '' AS company_info, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE 'N/A' END AS shipping_method,
       'N/A' AS payment_terms, n_lines
FROM orders JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) USING (o_orderkey)"""
    q["comparison_rows"] = cmp + """
SELECT DISTINCT item_id, p.source_file, normalised AS is_matched, matched_with FROM pitems p JOIN cmp USING (item_id)"""
    q["reference_positions"] = with_(REF) + "SELECT item_number, row_number() OVER (ORDER BY item_number) AS position FROM ref"
    q["alias_item_rollup"] = with_(INV) + f"""
SELECT {fmt_id('item_id')} AS item_id, series_desc AS item_desc, {esum(num('quantity'))} AS quantity
FROM inv WHERE series_desc IS NOT NULL GROUP BY 1, 2"""
    marks = ", ".join(f"'{x}'" for x in SAFE_PLAIN)
    q["safe_names"] = f"""
SELECT p_partkey, replace(p_name, ' ', '_') || '_' || CASE WHEN x = '' THEN '' ELSE x || '_' END || 'v1.csv' AS name
FROM (SELECT p_partkey, p_name, list_extract([{marks}], CAST(p_partkey % {len(SAFE_MARKS)} AS INTEGER) + 1) AS x FROM part)"""
    q["item_id_any_size"] = """
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4
    WHEN 0 THEN ltrim(l_orderkey || '5' || repeat('0', l_linenumber + 17), '0') WHEN 1 THEN '0' WHEN 2 THEN CAST(l_orderkey AS VARCHAR)
    ELSE ltrim(l_orderkey || repeat('7', 40), '0') END AS item_id
FROM lineitem"""

    return q


# names with characters that decompose to one, several or no ASCII characters
SAFE_MARKS = ("Š", "ć", "ﬁ", "½", "Ångström", "漢字", "e\u0301", "Ⅷ")
SAFE_PLAIN = ("S", "c", "fi", "12", "Angstrom", "", "e", "VIII")

STATEMENTS = _statements()
