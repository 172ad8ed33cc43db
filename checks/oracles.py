"""SQL twins of the registered queries, for DuckDB over the same tables.

They state the same answers in another way: windows over unnested tokens instead of
in-row folds, and the expected text of derived pages straight from the documents.
"""

from __future__ import annotations

import unicodedata

from webloam.functions.html import BOUNDARY_TAGS, PRUNED_MARKS, PRUNED_TAGS, VOID_TAGS

# White space as Python sees it, as text and as a pattern class.
_WS_TEXT = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_S = r"[\t-\r\x1c- \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_S_LINE = _S.replace(r"\t-\r", r"\t\x0b-\r")
NL = "chr(10)"
NN = "chr(10)||chr(10)"

SQL: dict[str, str] = {}


def strip(x: str) -> str:
    return f"trim({x}, '{_WS_TEXT}')"


def sub(x: str, pattern: str, to: str = "''") -> str:
    return f"regexp_replace({x}, '{pattern.replace(chr(39), chr(39) * 2)}', {to}, 'g')"


def collapse(x: str) -> str:
    return strip(sub(x, _S + "+", "' '"))


def clean_md(x: str) -> str:
    return strip(sub(sub(x, r"\n[ \t]+\n", NN), r"\n{3,}", NN))


# --- views -------------------------------------------------------------------------------

LOGS = """logs AS (
  SELECT CAST(e.event_id AS VARCHAR) AS id, p.url, e.ts AS timestamp, CAST(round(e.value*100) AS BIGINT) AS duration_ms,
    CASE e.event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'timeout' ELSE 'success' END AS status,
    CAST(CASE e.event_type WHEN 'error' THEN 500 WHEN 'signup' THEN NULL ELSE 200 END AS INTEGER) AS http_status_code,
    CASE e.event_type WHEN 'error' THEN 'HTTP error 500' WHEN 'signup' THEN 'Timeout after 30000ms' END AS error_message,
    CASE WHEN e.event_id % 10 = 0 THEN 'pdf' WHEN e.event_type IN ('error','signup') THEN 'html' ELSE 'spa' END AS content_type,
    CASE WHEN e.event_type IN ('error','signup') THEN '' ELSE d.text END AS markdown_content,
    CASE WHEN e.event_type IN ('error','signup') THEN NULL ELSE sha256(d.text) END AS content_hash,
    CAST(CASE WHEN e.event_type IN ('error','signup') THEN 0 ELSE length(d.text) END AS BIGINT) AS content_length
  FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages)
  JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents))"""

DOC_LOGS = """doc_logs AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'https://' || source || '/' || lang AS url, text AS markdown_content
  FROM documents)"""

DOCS = """docs AS (SELECT d.doc_id, p.url, d.text AS markdown, d.lang, d.source FROM documents d
  JOIN pages p ON p.page_id = d.doc_id % (SELECT count(*) FROM pages))"""

HEADED = f"""headed AS (SELECT doc_id, array_to_string(list_transform(str_split(text, {NL}), lambda x, i:
  CASE WHEN (i - 1 + doc_id) % 3 = 0 THEN repeat('#', CAST(((i - 1) * 7 + doc_id) % 4 + 1 AS BIGINT)) || ' ' || x ELSE x END), {NL}) AS markdown
  FROM documents)"""

_NOISE = ("['![](a.png) and [](u) and [t]( )', '0:00', '/', 'LIVE', '-0:00', 'Video Player is loading.', 'Wow!', '! !', '‹›', "
          "'![alt]()', '[text](https://x.example/a) **bold** `code`', '  \t ']")
NOISY = f"""noisy AS (SELECT doc_id, array_to_string(list_transform(str_split(text, {NL}), lambda x, i:
  x || {NL} || ({_NOISE})[CAST(((i - 1) * 5 + doc_id) % 12 + 1 AS BIGINT)]
  || CASE WHEN (i - 1) % 4 = 0 THEN {NN} || x || {NN} || x ELSE {NL} END), {NL}) AS markdown FROM documents)"""

MARKED = """marked AS (SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN replace(h, '<ul>', '<ul id=main-menu>') ELSE h END AS html FROM (
  SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN replace(html, '<div class="ad">', '<div class="ad Share-box">') ELSE html END AS h FROM pages))"""

LINKED = """linked AS (SELECT page_id, url, replace(replace(html, '<head>', '<head><meta property="og:title" content="Og &amp; more">'),
  '<article>', '<article style="a:b" data-n="1"><img src="/i.png" alt="pic"><p>Read <a href="' || url ||
  '">this very page</a> or <a href="https://other.example/x">another one</a> some day.</p>') AS html FROM pages)"""

PDFS = """pdfs AS (SELECT doc_id, 'https://docs.example/' || doc_id || '.pdf' AS url, CAST(t.n AS INTEGER) AS page_num, t.text AS text,
  CAST(CASE WHEN doc_id % 50 = 7 THEN 60*1024*1024 ELSE n_chars END AS BIGINT) AS file_size,
  CASE WHEN doc_id % 3 = 0 THEN 'Doc ' || doc_id END AS title, CASE WHEN doc_id % 3 = 1 THEN source END AS author, lang AS subject,
  CASE WHEN doc_id % 3 = 0 THEN '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || 'T10:30:00' WHEN doc_id % 3 = 1 THEN 'Jan 2024' END AS created
  FROM documents d, unnest(str_split(d.text, chr(10))) WITH ORDINALITY AS t(text, n))"""

ATTEMPTS = """attempts AS (SELECT 'https://site.example/' || CAST(floor(event_id / 3) AS BIGINT) AS url, CAST(event_id % 3 + 1 AS INTEGER) AS attempt,
  event_type = 'click' AS success, CASE event_type WHEN 'error' THEN 'HTTP error 500' WHEN 'signup' THEN 'Timeout after 30000ms'
  WHEN 'purchase' THEN 'Browser has been closed' WHEN 'view' THEN 'Network unreachable' END AS error,
  CASE WHEN user_id % 5 = 0 THEN 'pdf' ELSE 'html' END AS kind, event_id % 2 = 0 AS restarted FROM events)"""

RESPONSES = f"""responses AS (SELECT doc_id AS page_id, 'html' AS stage, CASE WHEN doc_id % 2 = 0 THEN '```markdown' || {NL} || '# Answer' || {NL}
  || text || {NL} || '```' ELSE 'too short' END AS response FROM documents UNION ALL
  SELECT doc_id, 'structure', CASE doc_id % 3 WHEN 0 THEN '# Fixed' || {NL} || text WHEN 1 THEN left(text, CAST(length(text) // 2 AS BIGINT)) ELSE '' END FROM documents)"""

SUMMARY = "id, url, epoch_us(timestamp) AS ts_us, duration_ms, status, content_type, content_length, http_status_code"
NEWEST = "ORDER BY timestamp DESC, id DESC"


def logs_sql(name: str, body: str) -> None:
    SQL[name] = f"WITH {LOGS} {body}"


def _fold_pairs() -> tuple[str, str]:
    rows = []
    for cp in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(cp))
        if len(parts) == 2 and parts[0].isascii() and chr(cp) == chr(cp).lower():
            rows.append((chr(cp), parts[0]))
    return "".join(a for a, _ in rows), "".join(b for _, b in rows)


def fold(x: str) -> str:
    src, dst = _fold_pairs()
    return f"translate(lower({x}), '{src}', '{dst}')"


def has_word(x: str, word: str, prefix: bool = False) -> str:
    end = "" if prefix else r"([^\p{L}\p{N}]|$)"
    return rf"regexp_matches({x}, '(^|[^\p{{L}}\p{{N}}]){word}{end}')"


# --- sources and sinks -------------------------------------------------------------------

SQL["s1_read_pages"] = "SELECT page_id, url, html, CAST(NULL AS VARCHAR) AS page_title, CAST(NULL AS INTEGER) AS http_status_code FROM pages"
SQL["s2_read_pdf_pages"] = ("SELECT doc_id, CAST(NULL AS VARCHAR) AS url, CAST(NULL AS INTEGER) AS page_num, text, "
                            "CAST(NULL AS BIGINT) AS file_size FROM documents")
logs_sql("s3_append_logs", "SELECT id, url, epoch_us(timestamp) AS ts_us, status, content_length, CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day FROM logs")
SQL["s4_read_logs"] = """SELECT CAST(event_id AS VARCHAR) AS id, CASE WHEN event_id % 7 = 0 THEN 'bad' || props ELSE props END AS response_headers,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE json_extract_string(props, '$.k') END AS k, event_type AS redirect, 'u' || user_id AS issuer FROM events"""
logs_sql("s5_export_csv", f"""SELECT id AS "ID", url AS "URL", epoch_us(timestamp) AS "Timestamp", status AS "Status", content_type AS "Content Type",
  duration_ms AS "Duration (ms)", content_length AS "Content Length", http_status_code AS "HTTP Status", error_message AS "Error",
  CAST(0 AS INTEGER) AS "Links", CAST(0 AS INTEGER) AS "Images" FROM logs WHERE status = 'success' {NEWEST}""")
logs_sql("s6_export_json", f"SELECT id, url, epoch_us(timestamp) AS ts_us, error_message, content_type FROM logs WHERE status = 'error' {NEWEST}")
SQL["s6_export_json_manifest"] = ("SELECT count(*) AS total_records, 'error' AS status, CAST(NULL AS VARCHAR) AS url_search "
                                  "FROM events WHERE event_type = 'error'")
SQL["s7_format_markdown_report"] = rf"""WITH {DOCS}, parts AS (SELECT *, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
  regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM docs)
  SELECT host || '_' || coalesce(nullif(replace(trim(path, '/'), '/', '_'), ''), 'index') || '.md' AS name,
  '# Scrape de ' || host || path || {NN} || '> URL: ' || url || {NL} || '> Titre: ' || source || {NL} || '> Longueur: ' || length(markdown)
  || ' caractères' || {NL} || '> Type: spa' || {NL} || CASE WHEN doc_id % 2 = 0 THEN '> Pipeline: ' || lang || ', ' || source || {NL} ELSE '' END
  || {NL} || '---' || {NN} || markdown AS report FROM parts"""
logs_sql("s8_to_log_row", """SELECT url, CASE WHEN lower(error_message) LIKE '%timeout%' THEN 'timeout' WHEN status = 'success' THEN 'success' ELSE 'error' END AS status,
  CASE WHEN status = 'success' AND markdown_content <> '' THEN content_hash END AS content_hash, content_length, error_message, http_status_code,
  CASE WHEN duration_ms % 2 = 0 THEN url || '#r' END AS redirects, CAST(CASE WHEN content_type = 'pdf' THEN 3 END AS INTEGER) AS pdf_pages, duration_ms FROM logs""")
logs_sql("s8_to_result", """SELECT url, status = 'success' AS success, CASE WHEN duration_ms % 3 = 0 THEN CASE WHEN status = 'success' THEN 'spa' ELSE 'html' END
  ELSE content_type END AS content_type, CASE WHEN status = 'success' THEN content_hash END AS content_hash, duration_ms,
  CASE WHEN duration_ms % 3 <> 0 AND content_type = 'pdf' THEN 'T' END AS pdf_title, CAST(0 AS INTEGER) AS retry_count, CAST(0 AS INTEGER) AS links_count FROM logs""")

# --- filters and projections -------------------------------------------------------------

logs_sql("f1_get_log", "SELECT id, url, content_hash, markdown_content FROM logs WHERE id = '42'")
for _name, _where in {
    "f2_filter_status": "status = 'timeout'",
    "f3_filter_content_type": "content_type = 'pdf'",
    "f4_filter_url_search": "url ILIKE '%BLOG.t_er%'",
    "f5_filter_date_from": "timestamp >= TIMESTAMP '2024-01-15 12:00:00'",
    "f6_filter_date_to": "timestamp <= TIMESTAMP '2024-01-15 12:00:00'",
    "f7_filter_all": "status = 'success' AND content_type = 'spa' AND url ILIKE '%example%' AND timestamp "
                     "BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-15 12:00:00'",
}.items():
    logs_sql(_name, f"SELECT id, url, status FROM logs WHERE {_where}")
logs_sql("f8_summarize", f"SELECT {SUMMARY} FROM logs")
SQL["f9_validate_logs"] = """SELECT CAST(event_id AS VARCHAR) AS id, array_to_string(list_filter([
  CASE WHEN event_id % 11 = 0 THEN 'url missing' END, CASE WHEN event_type NOT IN ('click','error') THEN 'status not allowed' END,
  CASE WHEN CAST(round(value) AS BIGINT) < 100 THEN 'duration_ms missing or negative' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM events"""
SQL["f10_validate_requests"] = """SELECT page_id, timeout, array_to_string(list_filter([CASE WHEN page_id % 5 < 2 THEN 'url malformed' END,
  CASE WHEN timeout NOT BETWEEN 1000 AND 120000 THEN 'timeout out of range' END], lambda x: x IS NOT NULL), '; ') AS reasons
  FROM (SELECT page_id, CAST(CASE WHEN page_id % 3 <> 0 THEN page_id * 1000 ELSE 30000 END AS INTEGER) AS timeout FROM pages)"""
SQL["f11_is_scientific_site"] = r"""SELECT page_id, regexp_matches(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), 'example\.(org|net)') AS scientific,
  false AS no_host FROM pages"""
# The mark is put on one block per page; its position is found by counting tokens before it.
SQL["f12_has_class_containing"] = ""

# --- search ------------------------------------------------------------------------------


def both(word: str, prefix: bool = False) -> str:
    return f"({has_word('fu', word, prefix)} OR {has_word('fm', word, prefix)})"


logs_sql("j1_search_logs", f"""SELECT id, url FROM (SELECT id, url, {fold('url')} AS fu, {fold('markdown_content')} AS fm FROM logs WHERE status = 'success')
  WHERE {both('the')} AND {both('of')} AND NOT {both('que')} AND {both('tion', True)}""")
_PHRASE = rf"""WITH {DOC_LOGS} SELECT id FROM (SELECT id, {fold('url')} AS fu, {fold('markdown_content')} AS fm FROM doc_logs)
  WHERE {both('of[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+the')}"""
SQL["j1_search_phrase"] = _PHRASE
SQL["j3_search_postings"] = _PHRASE
SQL["j3_search_postings_prefix"] = rf"""WITH {DOC_LOGS} SELECT id FROM (SELECT id, {fold('url')} AS fu, {fold('markdown_content')} AS fm FROM doc_logs)
  WHERE {both('of[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]+th', True)} AND ({both('que')} OR {both('with')})"""
_FOUND = (f"(SELECT *, {fold('markdown_content')} AS fm FROM logs) WHERE "
          + has_word("fm", "of[^" + chr(92) + "p{L}" + chr(92) + "p{N}]+the", False))
logs_sql("t1_page_logs_search", f"SELECT {SUMMARY} FROM {_FOUND} AND status = 'success' {NEWEST} LIMIT 50 OFFSET 50")
logs_sql("g4_count_search", f"SELECT count(*) AS total FROM {_FOUND}")
logs_sql("j2_search_logs_like", "SELECT id, url FROM logs WHERE content_type = 'spa' AND (url ILIKE '%Thing%the%' OR markdown_content ILIKE '%Thing%the%')")
_POSTINGS = rf"""WITH {DOC_LOGS}, f AS (SELECT id, 'url' AS field, url AS text FROM doc_logs UNION ALL SELECT id, 'markdown', markdown_content FROM doc_logs),
  w AS (SELECT f.id, f.field, t.term, t.n - 1 AS pos FROM f, unnest(regexp_extract_all({fold('f.text')}, '[\p{{L}}\p{{N}}]+')) WITH ORDINALITY AS t(term, n))
  SELECT field, term, count(DISTINCT id) AS logs, count(*) AS hits, CAST(sum(pos) AS BIGINT) AS positions FROM w GROUP BY field, term"""
SQL["j3_build_postings"] = _POSTINGS
SQL["j4_maintain_postings"] = _POSTINGS
SQL["j4_postings_by_batch"] = _POSTINGS


def injected(md: str, section: str) -> str:
    return (rf"CASE WHEN contains({md}, {NL}) THEN split_part({md}, {NL}, 1) || {NN} || {section} || {NN} || "
            rf"regexp_extract({md}, '(?s)^[^\n]*\n[^\n]*\n(.*)$', 1) ELSE {md} || {NN} || {section} END")


SQL["j5_reinject_sections"] = f"""WITH {DOCS} SELECT doc_id AS page_id, CASE WHEN doc_id % 3 = 0 THEN
  {injected('markdown', f"('## Abstract' || {NN} || source)")} ELSE markdown END AS markdown FROM docs"""

# --- aggregations ------------------------------------------------------------------------

_COUNTS = ", ".join(
    [f"count(*) FILTER (status = '{s}') AS {s}_count" for s in ("success", "error", "timeout")]
    + [f"count(*) FILTER (content_type = '{t}') AS {t}_count" for t in ("html", "pdf", "spa")])
_STATS = f"""SELECT count(*) AS total_scrapes, {_COUNTS}, avg(duration_ms) AS avg_duration_ms,
  CAST(coalesce(sum(content_length), 0) AS BIGINT) AS total_content_length FROM logs"""
_DAILY = """SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, count(*) AS count, count(*) FILTER (status = 'success') AS success
  FROM logs WHERE timestamp >= TIMESTAMP '2024-01-24' GROUP BY 1"""
logs_sql("g1_log_stats", _STATS)
logs_sql("g2_daily_stats", _DAILY)
logs_sql("g3_success_rate", "SELECT content_type, round(count(*) FILTER (status = 'success') / count(*) * 100, 1) AS rate FROM logs GROUP BY content_type")
logs_sql("g4_count_logs", "SELECT count(*) AS total FROM logs WHERE status = 'success' AND url ILIKE '%blog%'")
SQL["g5_full_stats"] = f"""WITH {LOGS}, s AS ({_STATS}), d AS ({_DAILY})
  SELECT s.*, (SELECT string_agg(date || ':' || count || ':' || success, ';' ORDER BY date) FROM d) AS daily_stats,
  round(success_count / total_scrapes * 100, 1) AS success_rate FROM s"""
SQL["g6_link_image_counts"] = rf"""WITH {LINKED}, a AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs,
  len(regexp_extract_all(html, '<img ')) AS images FROM linked),
  c AS (SELECT page_id, images, len(hrefs) AS n, len(list_filter(hrefs, lambda h: regexp_extract(h, '^[a-z]+://([^/?#]*)', 1)
  IN ('', regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)))) AS inside FROM a)
  SELECT page_id, CAST(inside AS INTEGER) AS internal_links, CAST(n - inside AS INTEGER) AS external_links, CAST(n AS INTEGER) AS links_count,
  CAST(images AS INTEGER) AS images_count FROM c"""

# --- folds -------------------------------------------------------------------------------

_SEP = rf"\n({_S_LINE}*\n)+"


def dedupe_ctes(src: str, key: str, expr: str, name: str) -> str:
    """CTEs that end in ``name(key, t)``: blocks numbered, a block equal to the one before left out."""
    lead = sub(sub(expr, rf"^({_S_LINE}*\n)+"), rf"(\n{_S_LINE}*)+$")
    return rf"""{name}_t AS (SELECT {key}, {lead} AS t FROM {src}),
  {name}_b AS (SELECT {key}, string_split_regex(t, '{_SEP}') AS b, regexp_extract_all(t, '{_SEP}') AS s FROM {name}_t),
  {name}_u AS (SELECT {key}, u.x, u.n, s[u.n] AS sep FROM {name}_b, unnest(b) WITH ORDINALITY AS u(x, n)),
  {name}_l AS (SELECT *, lag(x) OVER (PARTITION BY {key} ORDER BY n) AS prev FROM {name}_u),
  {name} AS (SELECT {key}, string_agg(CASE WHEN prev IS NULL OR prev <> x THEN x || coalesce(sep, '') ELSE substr(coalesce(sep, ''), 2) END, ''
    ORDER BY n) AS t FROM {name}_l GROUP BY {key})"""


SQL["w1_dedupe_consecutive_blocks"] = f"WITH {NOISY}, {dedupe_ctes('noisy', 'doc_id', 'markdown', 'w')} SELECT doc_id, t AS markdown FROM w"
_AGAIN = """CASE WHEN success OR error IS NULL THEN false WHEN kind = 'html' AND regexp_matches(lower(error), 'browser has been closed') THEN restarted
  WHEN kind = 'html' THEN regexp_matches(lower(error), 'timeout|connection|network|temporary') ELSE regexp_matches(lower(error), 'timeout|connection|network') END"""
SQL["w2_resolve_attempts"] = f"""WITH {ATTEMPTS}, a AS (SELECT *, {_AGAIN} AS again,
    kind = 'html' AND error = 'Browser has been closed' AND NOT restarted AS lost FROM attempts),
  st AS (SELECT *, count(*) FILTER (NOT again) OVER w AS stopped, count(*) FILTER (again) OVER w AS seen,
    count(*) OVER (PARTITION BY url) AS n FROM a WINDOW w AS (PARTITION BY url ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  last AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY attempt DESC) AS rn FROM st WHERE stopped = 0)
  SELECT url, CASE WHEN again THEN false ELSE success END AS success,
    CASE WHEN again THEN CASE WHEN attempt = 3 THEN 'Failed after 3 attempts: ' || error ELSE error END WHEN NOT success THEN error END AS error,
    attempt AS attempts, CAST(CASE WHEN again THEN seen + 1 WHEN lost THEN 0 ELSE seen END AS INTEGER) AS retry_count FROM last WHERE rn = 1"""

# --- paging ------------------------------------------------------------------------------

logs_sql("t1_page_logs", f"SELECT {SUMMARY} FROM logs WHERE status = 'success' {NEWEST} LIMIT 50 OFFSET 100")
logs_sql("t1_page_logs_far", f"SELECT {SUMMARY} FROM logs WHERE status = 'success' {NEWEST} LIMIT 50 OFFSET 2950")
logs_sql("t1_page_meta", """SELECT count(*) AS total, CAST(3 AS INTEGER) AS page, CAST(50 AS INTEGER) AS per_page,
  CAST(greatest(ceil(count(*) / 50.0), 1) AS BIGINT) AS total_pages FROM logs WHERE status = 'success'""")
logs_sql("t2_page_logs_keyset", f"""SELECT {SUMMARY}, c > 40 AS has_more, CASE WHEN c > 40 THEN base64(encode((SELECT epoch_us(timestamp) || '|' || id
  FROM behind {NEWEST} LIMIT 1 OFFSET 39))) END AS next_cursor FROM (SELECT *, count(*) OVER () AS c FROM behind) {NEWEST} LIMIT 40""".replace(
    "SELECT " + SUMMARY, "SELECT " + SUMMARY, 1))
SQL["t2_page_logs_keyset"] = SQL["t2_page_logs_keyset"].replace(
    f"WITH {LOGS} ", f"WITH {LOGS}, behind AS (SELECT * FROM logs WHERE status = 'success' AND (timestamp < TIMESTAMP '2024-01-15 12:00:00' "
                     "OR (timestamp = TIMESTAMP '2024-01-15 12:00:00' AND id < '5'))) ", 1)
logs_sql("t3_cursors", """SELECT id, CASE WHEN CAST(id AS BIGINT) % 4 = 0 THEN '!' || id ELSE base64(encode(epoch_us(timestamp) || '|' || id)) END AS cursor,
  CASE WHEN CAST(id AS BIGINT) % 4 <> 0 THEN epoch_us(timestamp) END AS ts_us, CASE WHEN CAST(id AS BIGINT) % 4 <> 0 THEN id END AS back_id FROM logs""")
logs_sql("t4_recent_logs", f"SELECT {SUMMARY} FROM logs {NEWEST} LIMIT 10")
logs_sql("t5_export_cap", f"SELECT id, epoch_us(timestamp) AS ts_us, content_length FROM logs {NEWEST}")

# --- scalar functions --------------------------------------------------------------------

SQL["n1_content_hash"] = "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND text <> '' THEN sha256(text) END AS hash FROM documents"
SQL["n2_content_length"] = "SELECT doc_id, CAST(CASE WHEN doc_id % 7 <> 0 THEN length(text) ELSE 0 END AS BIGINT) AS length FROM documents"
SQL["n3_is_pdf_url"] = "SELECT page_id, url LIKE '%.html' AS pdf, true AS query FROM pages"
_HEADER = "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Application/PDF; x=' || lang ELSE 'text/html; ' || lang END"
SQL["n4_is_pdf_content_type"] = f"SELECT doc_id, lower({_HEADER}) LIKE '%application/pdf%' AS pdf FROM documents"
SQL["n5_detect_kind"] = "SELECT doc_id, CASE WHEN doc_id % 4 = 1 OR doc_id % 3 = 0 THEN 'pdf' ELSE 'html' END AS kind FROM documents"
SQL["n6_result_content_type"] = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'pdf' WHEN doc_id % 2 = 0 THEN 'spa' ELSE 'html' END AS content_type FROM documents"
SQL["n7_classify_status"] = ("SELECT CAST(event_id AS VARCHAR) AS id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'timeout' "
                             "ELSE 'success' END AS status FROM events")
SQL["n8_is_browser_crash"] = f"WITH {ATTEMPTS} SELECT url, attempt, coalesce(error = 'Browser has been closed', false) AS crash FROM attempts"
SQL["n9_is_retryable"] = f"WITH {ATTEMPTS} SELECT url, attempt, coalesce(error IN ('Timeout after 30000ms', 'Network unreachable'), false) AS again FROM attempts"
_TEN = "lpad(CAST(n_chars AS VARCHAR), 10, '0')"
SQL["n10_parse_pdf_date"] = f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '2024-' || substr({_TEN}, 1, 2) || '-' || substr({_TEN}, 3, 2) || 'T' || substr({_TEN}, 5, 2)
  || ':' || substr({_TEN}, 7, 2) || ':' || substr({_TEN}, 9, 2) WHEN 1 THEN '2024-01-1' || doc_id % 10 || 'T00:00:00' WHEN 2 THEN lang END AS parsed FROM documents"""
_DIRTY = f"(' ' || chr(7) || chr(9) || ' ' || replace(text, '. ', '.' || {NN} || {NN} || chr(9) || ' ' || chr(11)) || {NN})"


def pdf_clean(x: str) -> str:
    return strip(sub(sub(sub(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), r"[ \t]+", "' '"), r"\n{3,}", NN))


SQL["n11_clean_pdf_text"] = f"SELECT doc_id, {pdf_clean(_DIRTY)} AS text FROM documents"
SQL["n12_clean_markdown"] = f"WITH {NOISY} SELECT doc_id, {clean_md('markdown')} AS markdown FROM noisy"


def spaced(x: str) -> str:
    line = (f"CASE WHEN {strip('x')} = '' THEN '' WHEN starts_with({strip('x')}, '#') AND contains({strip('x')}, ' ') "
            f"THEN {NL} || x || {NL} ELSE x END")
    return f"trim({sub(f'array_to_string(list_transform(str_split({x}, {NL}), lambda x: {line}), {NL})', chr(92) + 'n{3,}', NN)}, {NL})"


def plain_text(x: str) -> str:
    x = sub(x, rf"(?m)^#{{1,6}}{_S}+")
    x = sub(x, r"\[([^\]]+)\]\([^)]+\)", r"'\1'")
    x = sub(x, r"!\[[^\]]*\]\([^)]+\)")
    x = sub(x, r"[*_]{1,3}([^*_]+)[*_]{1,3}", r"'\1'")
    return collapse(sub(x, "`[^`]+`"))


def unfenced(x: str) -> str:
    return strip(sub(sub(strip(x), "^```(markdown)?"), "```$"))


SQL["n13_normalize_markdown_spacing"] = f"WITH {HEADED} SELECT doc_id, {spaced('markdown')} AS markdown FROM headed"
SQL["n14_extract_text_content"] = f"WITH {NOISY} SELECT doc_id, {plain_text('markdown')} AS text FROM noisy"
SQL["n15_strip_code_fence"] = f"WITH {RESPONSES} SELECT page_id, stage, {unfenced('response')} AS text FROM responses"


def title_case(x: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all(lower({x}), '\p{{L}}+|\P{{L}}+'), lambda r: upper(left(r, 1)) || substr(r, 2)), '')"


def slug_title(url: str) -> str:
    path = rf"regexp_extract({url}, '^[a-z]+://[^/?#]*([^?#;]*)', 1)"
    last = rf"regexp_extract(trim({path}, '/'), '[^/]*$')"
    return title_case(f"translate({sub(last, chr(92) + '.[^.]*$')}, '-_', '  ')")


_LONG_URL = r"(regexp_replace(url, '\?.*$', '') || '/l''été_3d-' || string_split_regex(url, '[./]')[3] || '.tar.html?x=1')"
SQL["n16_title_from_slug"] = rf"""WITH p AS (SELECT page_id, url, {_LONG_URL} AS long FROM pages) SELECT page_id,
  {slug_title('long')} AS title, {slug_title('url')} AS plain FROM p"""


def titled_ctes(src: str, keys: str, md: str, page: str, og: str, url: str, name: str) -> str:
    return f"""{name}_c AS (SELECT *, {md} AS md0, starts_with({strip(md)}, '# ') AS has, {collapse(
        f"coalesce(nullif({og}, ''), nullif({page}, ''), nullif({slug_title(url)}, ''), 'Untitled Document')")} AS ti FROM {src}),
  {name} AS (SELECT {keys}, CASE WHEN has THEN md0 ELSE '# ' || ti || {NN} || md0 END AS markdown,
    CASE WHEN has THEN {strip(f"ltrim(split_part({strip('md0')}, {NL}, 1), '# ')")} ELSE ti END AS title FROM {name}_c)"""


SQL["n17_inject_title"] = f"""WITH {DOCS}, src AS (SELECT doc_id, url, CASE WHEN doc_id % 4 = 0 THEN {NL} || '# ' || markdown ELSE markdown END AS m,
    CASE WHEN doc_id % 3 = 0 THEN '  Page ' || chr(9) || ' ' || source ELSE '' END AS page, CASE WHEN doc_id % 5 = 0 THEN lang END AS og FROM docs),
  {titled_ctes('src', 'doc_id', 'm', 'page', 'og', 'url', 'n')} SELECT doc_id, markdown, title FROM n"""
SQL["n18_inject_section"] = f"""WITH {DOCS} SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN {injected('markdown', f"('## S' || {NN} || source)")}
  ELSE markdown END AS markdown FROM docs"""


def rules(x: str, images: bool = True) -> str:
    x = sub(x, r"\[\]\([^)]*\)")
    x = sub(x, rf"\[[^\]]+\]\({_S}*\)")
    x = sub(x, rf"!\[([^\]]*)\]\({_S}*\)") if images else sub(x, r"!\[[^\]]*\]\([^)]+\)")
    x = sub(sub(x, rf"!{_S}+!"), rf"!{_S}*\n", NL)
    for line in ("0:00", "/", "LIVE", "-0:00"):
        x = sub(x, rf"\n{line}\n", NL)
    x = sub(x, r"Video Player is loading\.\n?")
    x = sub(x, r"(?s)To view this video please enable JavaScript.*?Play Video\n?")
    x = sub(x, r"(?s)Play\nMute\nCurrent Time.*?End of dialog window\.\n?")
    x = sub(x, r"(?s)This is a modal window\..*?Close Modal Dialog\n?")
    x = sub(x, r"(?s)Beginning of dialog window\..*?End of dialog window\.\n?")
    x = sub(x, r"No compatible source was found for this media\.\n?")
    return sub(x, r"\n[‹›]+\n", NL)


SQL["n19_regex_clean"] = f"""WITH {NOISY}, {dedupe_ctes('noisy', 'doc_id', rules('markdown'), 'a')}, {dedupe_ctes('noisy', 'doc_id', rules('markdown', False), 'b')}
  SELECT a.doc_id, {clean_md('a.t')} AS markdown, {clean_md('b.t')} AS no_images FROM a JOIN b ON a.doc_id = b.doc_id"""
SQL["n20_json_fields"] = """SELECT event_id, json_extract_string(props, '$.k') AS k, '{"k":"' || json_extract_string(props, '$.k') || '"}' AS back FROM events"""
SQL["n21_http_status_class"] = """SELECT event_id, CASE WHEN c IS NULL OR c = 0 THEN 'none' WHEN c >= 400 THEN 'error' WHEN c >= 300 THEN 'redirect' ELSE 'ok' END AS status
  FROM (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN CAST(round(value) AS INTEGER) END AS c FROM events)"""
SQL["n22_truncate_chars"] = "SELECT doc_id, substr(text, 1, 5000) AS text FROM documents"

# --- pages -------------------------------------------------------------------------------

_TOKEN = (r"(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)"
          r"|</?[a-z][^>=]*(?:=\s*(?:\"[^\"]*\"|''[^'']*'')?[^>=]*)*>|</?[a-z][^>]*>|<![^>]*>|[^<]+|<").replace('\\"', '"')
_names = lambda tags: "('" + "','".join(tags) + "')"
_VOID = _names((*VOID_TAGS, "script", "style"))
_FURNITURE = _names(PRUNED_TAGS)
_MARKS = "|".join(PRUNED_MARKS)
_BOUNDARY = _names(BOUNDARY_TAGS)


def tokens(src: str, name: str = "tk") -> str:
    return rf"""{name}_0 AS (SELECT s.page_id, s.url, t.n - 1 AS pos, t.tok FROM {src} s, unnest(regexp_extract_all(s.html, '{_TOKEN}')) WITH ORDINALITY AS t(tok, n)),
  {name}_1 AS (SELECT *, CASE WHEN starts_with(tok, '<') THEN lower(regexp_extract(tok, '^</?([a-zA-Z][^\s/>]*)', 1)) ELSE '' END AS tag FROM {name}_0),
  {name} AS (SELECT *, CASE WHEN tag = '' THEN 0 WHEN starts_with(tok, '</') THEN -1 WHEN tag IN {_VOID} OR ends_with(tok, '/>') THEN 0 ELSE 1 END AS d FROM {name}_1)"""


def levels(src: str, name: str = "lv") -> str:
    """Adds ``ends``: the position of the end tag, by levels of each tag name."""
    return f"""{name}_0 AS (SELECT *, sum(d) OVER (PARTITION BY page_id, tag ORDER BY pos) - CASE WHEN d = 1 THEN 1 ELSE 0 END AS key FROM {src}),
  {name} AS (SELECT *, CASE WHEN d = 1 THEN lead(pos) OVER k END AS ends, lag(pos) OVER k AS before FROM {name}_0 WINDOW k AS (PARTITION BY page_id, tag, key ORDER BY pos))"""


def pruned(src: str, mark: str, name: str = "pr") -> str:
    """Tokens of ``levels`` output without the marked elements."""
    return f"""{name}_m AS (SELECT *, tag <> '' AND d >= 0 AND ({mark}) AS m FROM {src}),
  {name}_d AS (SELECT a.*, CASE WHEN m AND d = 1 THEN 1 WHEN d = -1 AND EXISTS (SELECT 1 FROM {name}_m o WHERE o.page_id = a.page_id AND o.pos = a.before AND o.m) THEN -1 ELSE 0 END AS delta FROM {name}_m a),
  {name}_c AS (SELECT *, sum(delta) OVER (PARTITION BY page_id ORDER BY pos) AS cover FROM {name}_d),
  {name} AS (SELECT * FROM {name}_c WHERE cover = 0 AND delta = 0 AND NOT (m AND d = 0))"""


_BY_TAG = f"tag IN {_FURNITURE}"
_BY_MARK = rf"""regexp_matches(tok, '(?is)^<[a-z][^>]*?\s(class|id)\s*=\s*("[^"]*({_MARKS})|''[^'']*({_MARKS})|[^\s>"'']*({_MARKS}))')"""


def page_html(src_cte: str, src: str, mark: str) -> str:
    head = f"{src_cte}, " if src_cte else ""
    return f"""WITH {head}{tokens(src)}, {levels('tk')}, {pruned('lv', mark)},
  j AS (SELECT page_id, string_agg(tok, '' ORDER BY pos) AS html FROM pr GROUP BY page_id)
  SELECT s.page_id, coalesce(j.html, '') AS html FROM {src} s LEFT JOIN j ON j.page_id = s.page_id"""


SQL["f12_has_class_containing"] = f"""WITH {MARKED}, {tokens('marked')} SELECT page_id, CAST(pos AS INTEGER) AS pos, tok FROM tk
  WHERE tok = '<div class="ad Share-box">'"""
SQL["d1_tokenize_html"] = f"""WITH {tokens('pages')}, {levels('tk')},
  nb AS (SELECT page_id, pos, tok, tag, d, ends, min(CASE WHEN tag IN {_BOUNDARY} AND tag <> 'br' THEN pos END) OVER (PARTITION BY page_id ORDER BY pos
    ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_block, max(pos) OVER (PARTITION BY page_id) AS last FROM lv)
  SELECT page_id, CAST(pos AS INTEGER) AS pos, tok, tag, CAST(d AS INTEGER) AS d, CAST(CASE WHEN tag = '' OR d = -1 THEN NULL WHEN d = 0 THEN pos
    WHEN ends IS NOT NULL THEN ends WHEN tag IN ('html','body') THEN last ELSE coalesce(next_block - 1, last) END AS INTEGER) AS end_pos FROM nb"""
SQL["d2_prune_tags"] = page_html("", "pages", _BY_TAG)
SQL["d3_prune_class_id"] = page_html(MARKED, "marked", _BY_MARK)
SQL["d4_prune_dom"] = page_html(MARKED, "marked", f"{_BY_TAG} OR {_BY_MARK}")


def decoded(x: str) -> str:
    for name, text in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", "\xa0"), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{text}')"
    return x


def blocks(src: str, main: bool, name: str) -> str:
    """CTEs that end in ``name(page_id, md)``: blocks between boundary tags, the kept ones joined."""
    keep = ("ctx LIKE 'h_' OR density <= 0.5 OR (density <= 0.75 AND (lag(ctx LIKE 'h_' OR density <= 0.5) OVER p) "
            "AND (lead(ctx LIKE 'h_' OR density <= 0.5) OVER p))" if main else "ctx LIKE 'h_' OR words >= 10")
    return rf"""{name}_b AS (SELECT *, sum(CASE WHEN tag IN {_BOUNDARY} THEN 1 ELSE 0 END) OVER w AS block,
    sum(CASE WHEN tag = 'body' AND d = 1 THEN 1 ELSE 0 END) OVER w AS in_body,
    last_value(CASE WHEN tag IN ('h1','h2','h3','h4','h5','h6','li','td','th','pre') AND d = 1 THEN tag
      WHEN tag IN ('h1','h2','h3','h4','h5','h6','li','td','th','pre','ul','ol','table','tr') THEN '' END IGNORE NULLS) OVER w AS ctx,
    sum(CASE WHEN tag = 'a' THEN d ELSE 0 END) OVER w AS in_link,
    last_value(CASE WHEN tag = 'a' AND d = 1 THEN {decoded("regexp_extract(tok, 'href=" + chr(34) + "([^" + chr(34) + "]*)', 1)")} END IGNORE NULLS) OVER w AS href
    FROM {src} WINDOW w AS (PARTITION BY page_id ORDER BY pos)),
  {name}_p AS (SELECT *, CASE WHEN tok NOT LIKE '<%' OR tok = '<' THEN {decoded('tok')} WHEN tag = 'img' THEN
      '![' || regexp_extract(tok, 'alt="([^"]*)', 1) || '](' || regexp_extract(tok, 'src="([^"]*)', 1) || ')' ELSE '' END AS txt,
    CASE WHEN tag = 'a' AND d = 1 THEN '[' WHEN tag = 'a' AND d = -1 THEN '](' || href || ')' ELSE '' END AS mark FROM {name}_b WHERE in_body > 0),
  {name}_g AS (SELECT page_id, block, first(coalesce(ctx, '') ORDER BY pos) AS ctx, {collapse("string_agg(txt || mark, '' ORDER BY pos)")} AS md,
    {collapse("string_agg(txt, '' ORDER BY pos)")} AS vis, length(replace({sub("string_agg(CASE WHEN in_link > 0 THEN txt ELSE '' END, '' ORDER BY pos)", _S)}, ' ', '')) AS linked
    FROM {name}_p GROUP BY page_id, block),
  {name}_v AS (SELECT *, linked / length(replace(vis, ' ', '')) AS density, len(str_split(vis, ' ')) AS words FROM {name}_g WHERE vis <> ''),
  {name}_k AS (SELECT *, {keep} AS keep FROM {name}_v WINDOW p AS (PARTITION BY page_id ORDER BY block)),
  {name}_s AS (SELECT *, lag(ctx) OVER (PARTITION BY page_id ORDER BY block) AS prev FROM {name}_k WHERE coalesce(keep, false)),
  {name} AS (SELECT page_id, string_agg(CASE WHEN prev IS NULL THEN '' WHEN prev = 'li' AND ctx = 'li' THEN {NL} ELSE {NN} END
    || CASE WHEN ctx LIKE 'h_' THEN repeat('#', CAST(right(ctx, 1) AS BIGINT)) || ' ' WHEN ctx = 'li' THEN '- ' ELSE '' END || md, '' ORDER BY block) AS md
    FROM {name}_s GROUP BY page_id)"""


SQL["d9_extract_main_content"] = f"""WITH {LINKED}, {tokens('linked')}, {levels('tk')}, {pruned('lv', _BY_TAG + ' OR ' + _BY_MARK)}, {blocks('pr', True, 'mb')}
  SELECT s.page_id, mb.md AS main_markdown FROM linked s LEFT JOIN mb ON mb.page_id = s.page_id"""
_LINES = f"list_filter(list_transform(str_split(text, {NL}), lambda x: {collapse('x')}), lambda x: x <> '')"
SQL["d9_markdown_structure"] = f"""WITH s AS (SELECT *, {_LINES} AS li, {collapse('text')} AS flat FROM documents)
  SELECT doc_id AS page_id, CASE WHEN flat <> '' THEN array_to_string(list_transform(li, lambda x, i: i || '. ' || x), {NL}) || {NN}
    || '```' || {NL} || trim(text, chr(13) || chr(10)) || {NL} || '```' || {NN} || '> ' || flat || {NN} ELSE '' END
    || '| Language | Source |' || {NL} || '| --- | --- |' || {NL} || '| ' || lang || ' | ' || source || ' |' || {NN}
    || 'By *' || source || '* in **' || lang || '**, `' || doc_id || '` © 2024 ∉' AS main_markdown FROM s"""
SQL["d12_html5_references"] = "SELECT doc_id AS page_id, 'Structure © 2020 ¬it; ∉ ∳' AS page_title FROM documents"
SQL["d10_page_fallback_markdown"] = f"""WITH {tokens('pages')}, {blocks('tk', False, 'fb')}
  SELECT s.page_id, fb.md AS fallback_markdown FROM pages s LEFT JOIN fb ON fb.page_id = s.page_id"""
SQL["d11_choose_extraction"] = """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN left(text, CAST(length(text) // (doc_id % 6 + 1) AS BIGINT)) END AS e,
  CASE WHEN doc_id % 7 <> 0 THEN text ELSE '' END AS f FROM documents)
  SELECT doc_id, CASE WHEN coalesce(e, '') = '' THEN f WHEN length(e) >= floor(length(f) * 0.3::DOUBLE) OR f = '' THEN e ELSE f END AS markdown,
  CASE WHEN coalesce(e, '') = '' THEN 'fallback_empty' WHEN length(e) >= floor(length(f) * 0.3::DOUBLE) OR f = '' THEN 'main_content' ELSE 'fallback_short' END AS step FROM x"""
_TITLE = collapse(decoded("regexp_extract(html, '(?s)<title>([^<]*)', 1)"))
SQL["d12_page_titles"] = f"SELECT page_id, nullif({_TITLE}, '') AS page_title, 'Og & more' AS og_title FROM pages"


def documents_of(src: str, name: str) -> str:
    """CTEs of the whole chain over pages without scientific hosts; end in ``name(page_id, url, markdown, title, steps)``."""
    return f"""{tokens(src)}, {levels('tk')}, {pruned('lv', _BY_TAG + ' OR ' + _BY_MARK)}, {blocks('pr', True, 'mb')}, {blocks('tk', False, 'fb')},
  ch AS (SELECT s.page_id, s.url, nullif({_TITLE}, '') AS page_title, coalesce(mb.md, '') AS e, coalesce(fb.md, '') AS f
    FROM {src} s LEFT JOIN mb ON mb.page_id = s.page_id LEFT JOIN fb ON fb.page_id = s.page_id),
  pk AS (SELECT *, CASE WHEN e = '' THEN 'fallback_empty' WHEN length(e) >= floor(length(f) * 0.3::DOUBLE) OR f = '' THEN 'main_content' ELSE 'fallback_short' END AS step FROM ch),
  {titled_ctes('pk', 'page_id, url, step', "CASE WHEN step = 'main_content' THEN e ELSE f END", 'page_title', "''", 'url', 'ti')},
  {dedupe_ctes('ti', 'page_id', rules('markdown'), 'dd')},
  {name} AS (SELECT ti.page_id, ti.url, {clean_md('dd.t')} AS markdown, ti.title, 'dom_pruning,' || step || ',title_injection,regex_cleaning' AS steps
    FROM ti JOIN dd ON dd.page_id = ti.page_id)"""


SQL["d13_process_pages"] = f"WITH {documents_of('pages', 'doc')} SELECT * FROM doc"
SQL["d14_scrub_html"] = rf"""WITH {LINKED} SELECT page_id, replace({sub(sub(sub(sub('html', '(?is)<script[^>]*>.*?</script>'), '(?is)<style[^>]*>.*?</style>'),
    '(?i)<meta[^>]*>'), '(?i)<link[^>]*>')}, '<article style="a:b" data-n="1">', '<article>') AS html FROM linked"""

# Derived article pages: what is expected follows from the documents.
_BODY = collapse(sub("text", r"\n", "' '"))
_LINE = strip(sub("text", r"\n", "' '"))
_SCIENCE = f"science AS (SELECT doc_id AS page_id, {_LINE} AS t, lang, source, text FROM documents)"
_ABSTRACT, _KEYS, _INTRO = (f"'## Summary' || {NN} || t", f"'## Keys' || {NN} || lang || ', ' || source", f"'## Introduction' || {NN} || t")
SQL["d5_extract_abstracts"] = f"WITH {_SCIENCE} SELECT page_id, CAST(0 AS INTEGER) AS ordinal, {_ABSTRACT} AS section FROM science WHERE length(t) > 50"
SQL["d6_extract_keywords"] = f"WITH {_SCIENCE} SELECT page_id, CAST(0 AS INTEGER) AS ordinal, {_KEYS} AS section FROM science"
SQL["d7_extract_body_sections"] = f"WITH {_SCIENCE} SELECT page_id, CAST(0 AS INTEGER) AS ordinal, {_INTRO} AS section FROM science WHERE length(t) > 50"
_SECTIONS = f"CASE WHEN length(t) > 50 THEN {_ABSTRACT} || {NN} || {_KEYS} || {NN} || {_INTRO} ELSE {_KEYS} END"
_ESC = f"replace(replace({sub('text', chr(92) + 'n', chr(39) + ' ' + chr(39))}, '&', '&amp;'), '<', '&lt;')"
_ABS_HTML = f"""'<div class="abstract author"><h2>Summary</h2><div class="abstract-content"><p>' || {_ESC} || '</p></div></div>'"""
_REST = """'<p>Rest of ' || source || '</p></body></html>'"""
_FULL = f"""'<div class="Abstracts">' || {_ABS_HTML} || '</div><div class="keywords"><h2>Keys</h2><span class="keyword">' || lang || '</span> <span class="keyword">' || source
  || '</span></div><div id="body"><div><section id="s1"><h2>Introduction</h2><p>' || {_ESC} || '</p><div class="figure">' || {_ESC}
  || '</div></section><section id="bibl1"><h2>Refs</h2><p>' || {_ESC} || '</p></section></div></div>' || {_REST}"""
_HEAD_HTML = "'<html><head><title>Article</title></head><body>'"
SQL["d8_scientific_preprocess"] = f"""WITH {_SCIENCE} SELECT page_id, CASE WHEN page_id % 2 = 1 THEN {_HEAD_HTML} || {_FULL}
    WHEN length(t) > 50 THEN {_HEAD_HTML} || '<div class="Abstracts"></div>' || {_REST}
    ELSE {_HEAD_HTML} || '<div class="Abstracts">' || {_ABS_HTML} || '</div>' || {_REST} END AS html,
  CASE WHEN page_id % 2 = 1 THEN '' ELSE {_SECTIONS} END AS scientific_content FROM science"""

_LEFT_HTML = f"""CASE WHEN page_id % 2 = 1 THEN {_HEAD_HTML} || {_FULL}
    WHEN length(t) > 50 THEN {_HEAD_HTML} || '<div class="Abstracts"></div>' || {_REST}
    ELSE {_HEAD_HTML} || '<div class="Abstracts">' || {_ABS_HTML} || '</div>' || {_REST} END"""
SQL["d13_process_pages_scientific"] = f"""WITH {_SCIENCE},
  art AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://www.plos.org/a/' ELSE 'https://www.example.org/a/' END || page_id AS url,
    {_LEFT_HTML} AS html, CASE WHEN page_id % 2 = 1 THEN '' ELSE {_SECTIONS} END AS content FROM science),
  raw AS (SELECT page_id, '' AS url, {_HEAD_HTML} || {_FULL} AS html FROM science),
  {tokens('art')}, {levels('tk')}, {pruned('lv', _BY_TAG + ' OR ' + _BY_MARK)}, {blocks('pr', True, 'mb')}, {tokens('raw', 'tr')}, {blocks('tr', False, 'fb')},
  ch AS (SELECT s.page_id, s.url, s.content, 'Article' AS page_title, coalesce(mb.md, '') AS e, coalesce(fb.md, '') AS f
    FROM art s LEFT JOIN mb ON mb.page_id = s.page_id LEFT JOIN fb ON fb.page_id = s.page_id),
  pk AS (SELECT *, CASE WHEN e = '' THEN 'fallback_empty' WHEN length(e) >= floor(length(f) * 0.3::DOUBLE) OR f = '' THEN 'main_content' ELSE 'fallback_short' END AS step FROM ch),
  {titled_ctes('pk', 'page_id, url, step, content', "CASE WHEN step = 'main_content' THEN e ELSE f END", 'page_title', "''", 'url', 'ti')},
  inj AS (SELECT page_id, url, step, content, title, CASE WHEN content <> '' THEN {injected('markdown', 'content')} ELSE markdown END AS md FROM ti),
  {dedupe_ctes('inj', 'page_id', rules('md'), 'dd')}
  SELECT inj.page_id, inj.url, {clean_md('dd.t')} AS markdown, inj.title, CASE WHEN inj.page_id % 2 = 0 THEN 'scientific_preprocess,' ELSE '' END || 'dom_pruning,' || step
    || ',title_injection,' || CASE WHEN content <> '' THEN 'scientific_inject,' ELSE '' END || 'regex_cleaning' AS steps FROM inj JOIN dd ON dd.page_id = inj.page_id"""

PDF_DOCS = f"""pdf_docs AS (SELECT doc_id, any_value(url) AS url, CAST(count(*) AS INTEGER) AS n, any_value(title) AS title, any_value(author) AS author, any_value(subject) AS subject,
    any_value(created) AS created, CAST(NULL AS VARCHAR) AS error,
    string_agg(CASE WHEN {strip('text')} <> '' THEN {NN} || '## Page ' || page_num || {NN} || {pdf_clean('text')} ELSE '' END, '' ORDER BY page_num) AS body FROM pdfs GROUP BY doc_id),
  pdf_out AS (SELECT doc_id, url, error, CASE WHEN error IS NULL THEN '# ' || coalesce(title, 'PDF Document') || {NL} || {NL}
    || coalesce('**Author:** ' || author || {NL}, '') || '**Subject:** ' || subject || {NL} || '**Pages:** ' || n || coalesce({NL} || '**Creation date:** ' || created, '')
    || {NN} || '---' || {NL} || body ELSE '' END AS markdown, CASE WHEN error IS NULL THEN title END AS pdf_title, CASE WHEN error IS NULL THEN author END AS pdf_author,
    CASE WHEN error IS NULL THEN n END AS pdf_pages, CASE WHEN error IS NULL THEN created END AS pdf_creation_date FROM pdf_docs)"""
SQL["o1_run_batch"] = f"""WITH {PDFS}, {PDF_DOCS}, {documents_of('pages', 'doc')}, html_out AS (SELECT doc.*, doc.page_id % 10 = 3 AS failed,
    CAST(len(regexp_extract_all(p.html, '<a href=')) AS INTEGER) AS links, CAST(len(regexp_extract_all(p.html, '<img ')) AS INTEGER) AS images
    FROM doc JOIN pages p ON p.page_id = doc.page_id)
  SELECT url, NOT failed AS success, CASE WHEN failed THEN 'Timeout after 30000ms' END AS error, CASE WHEN failed THEN 'html' ELSE 'spa' END AS content_type,
    CASE WHEN NOT failed THEN sha256(markdown) END AS content_hash, CAST(CASE WHEN failed THEN 0 ELSE length(markdown) END AS BIGINT) AS content_length,
    CASE WHEN failed THEN 0 ELSE links END AS links_count, CASE WHEN failed THEN 0 ELSE images END AS images_count, CAST(NULL AS INTEGER) AS http_status_code,
    CAST(NULL AS INTEGER) AS pdf_pages, CASE WHEN NOT failed THEN steps END AS steps FROM html_out
  UNION ALL SELECT url, error IS NULL, error, 'pdf', CASE WHEN error IS NULL THEN sha256(markdown) END, length(markdown), 0, 0,
    CASE WHEN error IS NULL THEN 200 END, pdf_pages, NULL FROM pdf_out"""
SQL["x1_stream_pages_to_logs"] = f"""WITH {documents_of('pages', 'doc')} SELECT doc.url, 'success' AS status, 'spa' AS content_type, sha256(markdown) AS content_hash,
  CAST(length(markdown) AS BIGINT) AS content_length, CAST(len(regexp_extract_all(p.html, '<a href=')) AS INTEGER) AS links_count FROM doc JOIN pages p ON p.page_id = doc.page_id"""
logs_sql("o2_urls_to_refetch", "SELECT url FROM logs WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE toxic = 1)")

# --- prompts, answers, structure ---------------------------------------------------------

SQL["l1_build_prompts"] = f"""SELECT doc_id, 'Rules first.' || {NN} || 'No {{{{ braces }}}} are read.' || {NN} || text || {NN} || '---' || {NN} || 'Answer only.' AS prompt FROM documents"""
SQL["l2_apply_html_extractions"] = f"""WITH {DOCS}, {RESPONSES}, a AS (SELECT page_id, {spaced(unfenced('response'))} AS x FROM responses WHERE stage = 'html')
  SELECT doc_id AS page_id, CASE WHEN length(x) >= 100 THEN x END AS html_answer FROM docs LEFT JOIN a ON a.page_id = doc_id"""
SQL["l3_apply_structure_fixes"] = f"""WITH {DOCS}, {RESPONSES}, a AS (SELECT page_id, {spaced(unfenced('response'))} AS x FROM responses WHERE stage = 'structure' AND response <> ''),
  m AS (SELECT doc_id AS page_id, markdown, x, length({plain_text('markdown')}) AS b, length({plain_text('x')}) AS n FROM docs LEFT JOIN a ON a.page_id = doc_id),
  j AS (SELECT *, x IS NOT NULL AND page_id % 4 <> 0 AND (b = 0 OR (1 - n / b) * 100 <= 10) AS ok FROM m)
  SELECT page_id, CASE WHEN ok THEN x ELSE markdown END AS markdown, CASE WHEN page_id % 4 = 0 THEN 'llm_html_sanitize' ELSE 'main_content' END
    || CASE WHEN ok THEN ',llm_structure_sanitizer' ELSE '' END AS steps FROM j"""
# A level is at most one deeper than the one before: a running minimum of level minus place.
SQL["l4_normalize_headings"] = rf"""WITH {HEADED}, li AS (SELECT doc_id, t.x, t.n, length(regexp_extract(t.x, '^(#{{1,6}})[ \t]+[^ \t]', 1)) AS lv
    FROM headed, unnest(str_split(markdown, {NL})) WITH ORDINALITY AS t(x, n)),
  h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k, count(*) FILTER (lv = 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ones
    FROM li WHERE lv > 0),
  w AS (SELECT *, CASE WHEN k = 1 THEN least(lv, 2) WHEN lv = 1 AND ones > 0 THEN 2 ELSE lv END AS want FROM h),
  f AS (SELECT *, k + min(want - k) OVER (PARTITION BY doc_id ORDER BY n) AS new FROM w)
  SELECT li.doc_id, string_agg(CASE WHEN f.new IS NULL THEN li.x ELSE repeat('#', CAST(f.new AS BIGINT)) || ' ' || regexp_extract(li.x, '^#{{1,6}}[ \t]+(.*)$', 1) END, {NL} ORDER BY li.n) AS markdown
  FROM li LEFT JOIN f ON f.doc_id = li.doc_id AND f.n = li.n GROUP BY li.doc_id"""
SQL["l5_strip_interface_residue"] = f"SELECT doc_id, replace(text, {NL}, {NL} || ' ') || {NL} || 'Download it' AS markdown FROM documents"

# --- row removal -------------------------------------------------------------------------

logs_sql("m1_delete_log", "SELECT id, url FROM logs WHERE id <> '42'")
SQL["m2_cleanup_old_logs"] = """SELECT 'kept' AS part, count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS n FROM events
  UNION ALL SELECT 'removed', count(*) FILTER (ts < TIMESTAMP '2024-01-15') FROM events"""
SQL["m3_delete_old_logs"] = "SELECT CAST(event_id AS VARCHAR) AS id, epoch_us(ts) AS ts_us FROM events WHERE ts >= TIMESTAMP '2024-01-22'"
SQL["m4_clear_all_logs"] = "SELECT 'kept' AS part, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'removed', count(*) FROM events"

SQL["m1_delete_log_at"] = SQL["m1_delete_log"]
SQL["f1_get_log_at"] = SQL["f1_get_log"]
SQL["m3_delete_old_logs_at"] = """SELECT CAST(event_id AS VARCHAR) AS id, epoch_us(ts) AS ts_us,
  (SELECT count(*) FROM events WHERE ts < TIMESTAMP '2024-01-22 12:00:00') AS removed FROM events WHERE ts >= TIMESTAMP '2024-01-22 12:00:00'"""
SQL["m4_clear_logs_at"] = SQL["m4_clear_all_logs"]

# --- PDF ---------------------------------------------------------------------------------

SQL["p1_pdf_size_gate"] = """SELECT doc_id, f AS file_size, f <= 2097152 AS success, CASE WHEN f > 2097152 THEN 'PDF too large: ' || format('{:.1f}', f / 1048576.0) || 'MB (max: 2MB)' END AS error
  FROM (SELECT doc_id, CAST(CASE WHEN doc_id % 50 = 7 THEN 60*1024*1024 ELSE n_chars END AS BIGINT) * 700 AS f FROM documents)"""
SQL["p2_pdf_metadata"] = f"""WITH {PDFS} SELECT doc_id, title, author, subject, CAST(NULL AS VARCHAR) AS creator, CAST(NULL AS VARCHAR) AS producer, created AS creation_date,
  CAST(NULL AS VARCHAR) AS modification_date, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS pages, file_size FROM pdfs QUALIFY page_num = 1"""
SQL["p3_assemble_pdf_markdown"] = f"WITH {PDFS}, {PDF_DOCS} SELECT doc_id, markdown, error FROM pdf_out"
SQL["p4_pdf_results"] = f"""WITH {PDFS}, {PDF_DOCS} SELECT doc_id, url, error IS NULL AS success, markdown, error, 'pdf' AS content_type,
  CAST(CASE WHEN error IS NULL THEN 200 END AS INTEGER) AS http_status_code, pdf_title, pdf_author, pdf_pages, pdf_creation_date FROM pdf_out"""

# --- streams ------------------------------------------------------------------------------

logs_sql("x2_stream_daily_stats", """SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS date, count(*) AS count, count(*) FILTER (status = 'success') AS success FROM logs
  GROUP BY CAST(timestamp AS DATE)""")

# --- use cases ---------------------------------------------------------------------------

SQL["u1_keyword_density"] = rf"""WITH {DOCS}, w AS (SELECT doc_id, regexp_extract_all({fold(plain_text('markdown'))}, '[\p{{L}}\p{{N}}]+') AS ws FROM docs)
  SELECT doc_id, t.term, count(*) AS count, count(*) / any_value(len(ws)) AS share FROM w, unnest(ws) AS t(term) GROUP BY doc_id, t.term"""
SQL["u2_heading_structure"] = rf"""WITH {HEADED}, li AS (SELECT doc_id, t.x, t.n FROM headed, unnest(str_split(markdown, {NL})) WITH ORDINALITY AS t(x, n)),
  h AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS ordinal, CAST(length(regexp_extract(x, '^(#{{1,6}})', 1)) AS INTEGER) AS level,
    {collapse(f"regexp_extract(x, '^#{{1,6}}[ {chr(92)}t]+(.*)$', 1)")} AS heading FROM li WHERE regexp_matches(x, '^#{{1,6}}[ \t]+[^ \t]'))
  SELECT h.*, (SELECT max(o.ordinal) FROM h o WHERE o.doc_id = h.doc_id AND o.ordinal < h.ordinal AND o.level < h.level) AS parent FROM h"""
SQL["u3_thin_content"] = f"""WITH {DOCS}, t AS (SELECT doc_id, {plain_text('markdown')} AS t FROM docs)
  SELECT * FROM (SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 ELSE len(str_split(t, ' ')) END AS INTEGER) AS words FROM t) WHERE words < 120"""
logs_sql("u4_content_changes", """SELECT url, epoch_us(timestamp) AS ts_us, id, previous_hash, content_hash FROM (SELECT *, lag(content_hash) OVER
  (PARTITION BY url ORDER BY timestamp, id) AS previous_hash FROM logs WHERE content_hash IS NOT NULL) WHERE previous_hash <> content_hash""")
logs_sql("u5_new_urls", "SELECT url, epoch_us(min(timestamp)) + length(url) % 20 * 86400000000 AS first_seen FROM logs GROUP BY url "
         "HAVING epoch_us(min(timestamp)) + length(url) % 20 * 86400000000 >= epoch_us(TIMESTAMP '2024-01-15 00:00:00')")
