"""Reference SQL for DuckDB, one statement per query of ``__spark_entry__``.

The statements are written line by line (unnest, windows, ordered aggregates), apart
from the Spark operators, which work inside a row.
"""

from __future__ import annotations

from quire.fixtures import duckdb_views
from quire.functions import fixed

WS = "'" + fixed.WHITE_SPACE + "'"
ECMA = "'" + fixed.ECMA_SPACE + "'"
NL = "chr(10)"


def _quoted(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


# Cleaned page texts from a page table.
def cleaned(source: str = "page_texts") -> str:
    before = " OR ".join(f"starts_with(x, '{m}')" for m in fixed.LINE_START_MARKS)
    after = " OR ".join(f"ends_with(p[i-1], '{w}')" for w in fixed.SENTENCE_END_WORDS)
    return f"""
norm AS (SELECT doc_stem, page_num, list_transform(list_transform(string_split(text, {NL}), lambda l: trim(l, {WS})),
    lambda l: CASE WHEN len(list_filter(string_split(l, '  '), lambda s: trim(s, {WS}) <> '')) >= 3 THEN l
      ELSE regexp_replace(l, '{fixed.WS}+', ' ', 'g') END) AS p FROM {source}),
cleaned AS (SELECT doc_stem, page_num, array_to_string(list_transform(p, lambda x, i:
    CASE WHEN x = '' THEN ''
      WHEN len(list_filter(p[1:i-1], lambda y: y <> '')) = 0 THEN x
      WHEN p[i-1] = '' THEN {NL} || {NL} || x
      WHEN {before} OR (regexp_matches(x, '^[0-9]') AND contains(x, '. ')) THEN {NL} || x
      WHEN right(p[i-1], 1) IN ({_quoted(fixed.SENTENCE_END_CHARS)}) OR {after} THEN {NL} || x
      ELSE ' ' || x END), '') AS text FROM norm)"""


# Largest prefix of at most n bytes; a byte 80..BF continues a character.
def cut(x: str, n: int) -> str:
    hexed = f"hex(encode({x}))"
    tries = " ".join(
        f"WHEN substr({hexed}, {2 * k + 1}, 1) NOT IN ('8', '9', 'A', 'B') THEN decode(unhex(left({hexed}, {2 * k})))"
        for k in range(n, n - 4, -1)
    )
    return f"CASE WHEN strlen({x}) <= {n} THEN {x} {tries} END"


def preview(x: str) -> str:
    t = f"trim({x}, {WS})"
    return f"CASE WHEN strlen({t}) <= 200 THEN {t} ELSE ({cut(t, 200)}) || '...' END"


def edges(source: str, name: str = "edge_counts") -> str:
    return f"""
lists_{name} AS (SELECT doc_stem, string_split(text, {NL}) AS l FROM {source}),
{name} AS (SELECT doc_stem, edge, line, count(*) AS n FROM (
    SELECT doc_stem, 'header' AS edge, trim(unnest(l[1:3]), {WS}) AS line FROM lists_{name}
    UNION ALL SELECT doc_stem, 'footer', trim(unnest(l[greatest(len(l) - 2, 1):len(l)]), {WS}) FROM lists_{name}) e
  WHERE line <> '' AND strlen(line) < 200 GROUP BY ALL)"""


def repeated(source: str) -> str:
    return f"""{edges(source)},
hf AS (SELECT e.doc_stem, edge, line, n, pages FROM edge_counts e
  JOIN (SELECT doc_stem, count(*) AS pages FROM {source} GROUP BY doc_stem) t ON e.doc_stem = t.doc_stem
  WHERE pages >= 3 AND n >= ceil(pages * 0.6))"""


def stripped(source: str) -> str:
    return f"""
stripped AS (SELECT doc_stem, page_num, CASE WHEN lines IS NULL THEN text ELSE trim(array_to_string(
    list_filter(string_split(text, {NL}), lambda x: NOT list_contains(lines, trim(x, {WS}))), {NL}), {WS}) END AS text
  FROM {source} LEFT JOIN (SELECT doc_stem AS ds, list(DISTINCT line) AS lines FROM hf GROUP BY doc_stem) h ON doc_stem = ds)"""


TOC = f"""(SELECT doc_stem, page_num + 1 AS page, 'table_of_contents' AS trash_type,
  CAST(CASE WHEN h AND k >= 3 THEN 0.95 WHEN h THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence,
  CASE WHEN h AND k >= 3 THEN 'TOC heading keyword found with ' || k || ' dot-leader lines'
    WHEN h THEN 'TOC heading keyword found' ELSE k || ' dot-leader lines detected (possible TOC)' END AS reason,
  {preview('text')} AS preview
FROM (SELECT *, contains(text, '{fixed.TOC_HEADING_EXACT}') OR contains(lower(text), 'contents') AS h,
    len(list_filter(string_split(text, {NL}), lambda l: (contains(l, '...') OR contains(l, '…')) AND regexp_matches(trim(l, {WS}), '[0-9]$'))) AS k
  FROM SRC) WHERE h OR k >= 5)"""

_HITS = (
    "list_filter(["
    + _quoted(fixed.BOILERPLATE_KEYWORDS)
    + "], lambda w: contains(lower(text), w) OR contains(text, w))"
)
BOILER = f"""(SELECT doc_stem, page_num + 1 AS page, 'boilerplate' AS trash_type,
  CAST(CASE WHEN len(hits) >= 2 THEN 0.85 ELSE 0.65 END AS DOUBLE) AS confidence,
  CASE WHEN len(hits) >= 2 THEN 'Multiple boilerplate keywords: ' || array_to_string(hits, ', ')
    ELSE 'Boilerplate keyword "' || hits[1] || '" on short page (' || strlen(text) || ' chars)' END AS reason,
  {preview('text')} AS preview
FROM (SELECT *, {_HITS} AS hits FROM SRC) WHERE len(hits) >= 2 OR (len(hits) = 1 AND strlen(text) < 500))"""

BLANK = f"""(SELECT doc_stem, page_num + 1 AS page, 'blank_page' AS trash_type,
  CAST(CASE WHEN m THEN 0.95 ELSE 0.8 END AS DOUBLE) AS confidence,
  CASE WHEN m THEN 'Explicit blank page marker found' ELSE 'Nearly blank page (' || strlen(t) || ' chars)' END AS reason,
  {preview('text')} AS preview
FROM (SELECT *, trim(text, {WS}) AS t, contains(lower(text), 'this page intentionally left blank') OR contains(lower(text), 'intentionally blank')
    OR contains(text, '{fixed.BLANK_MARKER_EXACT}') AS m FROM SRC) WHERE m OR strlen(t) < 50)"""


def trash(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM {q.replace('SRC', source)}" for q in (TOC, BOILER, BLANK)
    )


HF_ROW = f"""SELECT doc_stem, CAST(0 AS INT) AS page, 'header_footer' AS trash_type, CAST(1.0 AS DOUBLE) AS confidence,
  'Repeated text stripped from ' || pages || ' pages: ' || string_agg(entry, ', ' ORDER BY edge DESC, line) AS reason,
  {preview("string_agg(entry, '; ' ORDER BY edge DESC, line)")} AS preview
FROM (SELECT *, CASE edge WHEN 'header' THEN 'Header: "' ELSE 'Footer: "' END || line || '"' AS entry FROM hf) GROUP BY doc_stem, pages"""

DETECTED = f"found AS ({trash('page_texts')})"

HEADING = "chr(10) || chr(10) || '---' || chr(10) || '## Page ' || (page_num + 1) || chr(10)"


def text_document(source: str, language: str) -> str:
    return f"""SELECT doc_stem, CAST(0 AS INT) AS block_no, '# ' || doc_stem || {NL} || {NL} || '> Mode: `text-only` | Language: `{language}` | Pages: ' || count(*) || {NL}
  || string_agg({NL} || {HEADING} || CASE WHEN text <> '' THEN {NL} || text ELSE '' END, '' ORDER BY page_num) AS markdown
FROM {source} GROUP BY doc_stem"""


TABLE_LINES = f"""
tl AS (SELECT doc_stem, page_num, line, row_number() OVER (PARTITION BY doc_stem, page_num ORDER BY n) AS n FROM (
    SELECT doc_stem, page_num, trim(unnest(l), {WS}) AS line, unnest(range(1, len(l) + 1)) AS n
    FROM (SELECT doc_stem, page_num, string_split(text, {NL}) AS l FROM TSRC)) WHERE line <> ''),
tm AS (SELECT *, len(regexp_extract_all(line, '[ \\t]{{2,}}')) >= 2 AS wide, len(regexp_split_to_array(line, '{fixed.WS}+')) AS k FROM tl),
tp AS (SELECT *, coalesce(k >= 3 AND lag(k) OVER w >= 3 AND abs(k - lag(k) OVER w) <= 2, false) AS steady FROM tm WINDOW w AS (PARTITION BY doc_stem, page_num ORDER BY n)),
tr AS (SELECT *, sum(CASE WHEN steady THEN 0 ELSE 1 END) OVER (PARTITION BY doc_stem, page_num ORDER BY n) AS run FROM tp),
tf AS (SELECT doc_stem, page_num, count(*) AS n, sum(CASE WHEN wide THEN 1 ELSE 0 END) / count(*) AS share, max(c) AS longest
  FROM (SELECT *, count(*) OVER (PARTITION BY doc_stem, page_num, run) AS c FROM tr) GROUP BY doc_stem, page_num),
tflag AS (SELECT p.doc_stem, p.page_num, coalesce(n >= 3 AND (share >= 0.4 OR longest >= 6), false) AS is_table
  FROM TSRC p LEFT JOIN tf ON p.doc_stem = tf.doc_stem AND p.page_num = tf.page_num)"""


def coverage(source: str) -> str:
    return f"""SELECT doc_stem, page_num, CASE WHEN max(page_w * page_h) = 0 THEN 0.0 ELSE
  least(sum(CASE WHEN kind = 'image' THEN abs("right" - "left") * abs(top - bottom) ELSE 0.0 END) / max(page_w * page_h), 1.0) END AS coverage
FROM {source} GROUP BY doc_stem, page_num"""


def large(source: str) -> str:
    return f"""SELECT *, CAST(row_number() OVER (PARTITION BY doc_stem, page_num ORDER BY obj_idx) AS INT) AS "index"
FROM {source} WHERE kind = 'image' AND px_w >= 100 AND px_h >= 100"""


ROUTED = f"""
cov AS ({coverage('text_page_objects')}),
routed AS (SELECT c.doc_stem, c.page_num, c.text, CASE WHEN coalesce(coverage, 0) >= 0.5 THEN 'full_page' ELSE 'mixed' END AS strategy,
    CASE WHEN coalesce(coverage, 0) >= 0.5 THEN false ELSE is_table END AS table_candidate
  FROM cleaned c JOIN tflag t ON c.doc_stem = t.doc_stem AND c.page_num = t.page_num
  LEFT JOIN cov v ON c.doc_stem = v.doc_stem AND c.page_num = v.page_num)"""

_REF = "doc_stem || '/' || doc_stem || '_page_' || lpad(CAST(page_num + 1 AS VARCHAR), 3, '0')"
DESCRIBED = f"""
asked AS (SELECT doc_stem, page_num, CASE WHEN strategy = 'full_page' THEN 'full' ELSE 'table' END AS kind, CAST(NULL AS INT) AS "index", CAST(NULL AS INT) AS width, CAST(NULL AS INT) AS height
    FROM routed WHERE strategy = 'full_page' OR table_candidate
  UNION ALL SELECT o.doc_stem, o.page_num, 'img', "index", px_w, px_h FROM ({large('text_page_objects')}) o
    JOIN routed r ON o.doc_stem = r.doc_stem AND o.page_num = r.page_num WHERE strategy = 'mixed'),
refs AS (SELECT *, {_REF} || '_' || CASE kind WHEN 'img' THEN 'img' || "index" ELSE kind END || '.png' AS ref FROM asked),
described AS (SELECT *, CASE WHEN ref LIKE '%13_%' THEN CASE kind WHEN 'table' THEN '{fixed.FAILED_TEXT["table"]}' ELSE '{fixed.FAILED_TEXT["img"]}' END || 'failed after 3 attempts: no answer]'
    ELSE 'seen ' || ref END AS description FROM refs)"""

VISION_BODY = f"""
body AS (SELECT r.doc_stem, r.page_num, CASE WHEN strategy = 'full_page'
    THEN {HEADING.replace('page_num', 'r.page_num')} || {NL} || CASE WHEN text <> '' THEN text || {NL} || {NL} ELSE '' END || '[IMAGE:' || f.ref || ']' || {NL} || {NL} || f.description
    ELSE {HEADING.replace('page_num', 'r.page_num')} || CASE WHEN NOT table_candidate AND text <> '' THEN {NL} || text ELSE '' END
      || CASE WHEN table_candidate THEN {NL} || {NL} || '[IMAGE:' || t.ref || ']' || {NL} || {NL} || t.description || {NL} ELSE '' END
      || coalesce(i.part, '') END AS content
  FROM routed r LEFT JOIN described f ON r.doc_stem = f.doc_stem AND r.page_num = f.page_num AND f.kind = 'full'
  LEFT JOIN described t ON r.doc_stem = t.doc_stem AND r.page_num = t.page_num AND t.kind = 'table'
  LEFT JOIN (SELECT doc_stem, page_num, string_agg({NL} || {NL} || '[IMAGE:' || ref || ']' || {NL} || '**[{fixed.IMAGE_CAPTION_LABEL} ' || "index" || ']:** ' || description || {NL}, '' ORDER BY "index") AS part
    FROM described WHERE kind = 'img' GROUP BY doc_stem, page_num) i ON r.doc_stem = i.doc_stem AND r.page_num = i.page_num)"""

VISION_VIEWS = (
    duckdb_views("page_texts", "text_page_objects")
    + ","
    + cleaned()
    + ","
    + TABLE_LINES.replace("TSRC", "cleaned")
    + ","
    + ROUTED
    + ","
    + DESCRIBED
)

CATALOG = f"""SELECT doc_stem, page_num + 1 AS page, CASE WHEN kind = 'img' THEN "index" END AS "index", ref AS image_file,
  CASE kind WHEN 'img' THEN 'extracted_image' WHEN 'table' THEN 'table_region' ELSE 'full_page' END AS type,
  width, height, description, doc_stem AS source_doc, 'ollama' AS provider, 'qwen2.5vl' AS model FROM described"""

# Lines of Markdown documents with their numbers.
MD_LINES = f"""
md_lists AS (SELECT doc_stem, string_split(markdown, {NL}) AS l FROM markdown_docs),
md_lines AS (SELECT doc_stem, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n, len(l) AS total FROM md_lists),
file_lines AS (SELECT * FROM md_lines WHERE NOT (n = total AND line = ''))"""

SECTIONS = f"""
cuts AS (SELECT *, CASE WHEN regexp_matches(line, '^## Page [0-9]+') THEN 1 ELSE 0 END AS h FROM md_lines),
ids AS (SELECT *, sum(h) OVER (PARTITION BY doc_stem ORDER BY n) AS k FROM cuts),
parts AS (SELECT doc_stem, k, max(CASE WHEN h = 1 THEN line ELSE '' END) AS header, string_agg(line, {NL} ORDER BY n) AS content,
    coalesce(string_agg(CASE WHEN h = 0 THEN line END, {NL} ORDER BY n), '') AS rest FROM ids GROUP BY doc_stem, k),
sections AS (SELECT doc_stem, CAST(k - min(k) OVER (PARTITION BY doc_stem) AS INT) AS section_no,
    CAST(CASE WHEN header = '' THEN 0 ELSE CAST(regexp_extract(header, '^## Page ([0-9]+)', 1) AS BIGINT) END AS BIGINT) AS page_number, header, content,
    trim(CASE WHEN header = '' THEN content WHEN starts_with(rest, '---') THEN substr(rest, 4) ELSE rest END, {ECMA}) AS raw_content FROM parts)"""

LABELS = """
labels_by_page AS (SELECT doc_stem, page, arg_max(CASE trash_type WHEN 'table_of_contents' THEN 'TOC' WHEN 'boilerplate' THEN 'Boilerplate' WHEN 'blank_page' THEN 'Blank' ELSE 'Header/Footer' END,
    CASE trash_type WHEN 'table_of_contents' THEN 0 WHEN 'boilerplate' THEN 1 WHEN 'blank_page' THEN 2 ELSE 3 END) AS label FROM found GROUP BY doc_stem, page)"""


def removed_pages(removals: str) -> str:
    return f"""
hdr AS (SELECT *, CASE WHEN regexp_matches(trim(line, {WS}), '^## Page {fixed.WS}*[+]?[0-9]+$') THEN CAST(regexp_extract(trim(line, {WS}), '([0-9]+)$', 1) AS BIGINT) END AS p FROM file_lines),
paged AS (SELECT *, last_value(p IGNORE NULLS) OVER (PARTITION BY doc_stem ORDER BY n ROWS UNBOUNDED PRECEDING) AS page FROM hdr),
gone AS ({removals}),
kept AS (SELECT paged.* FROM paged LEFT JOIN (SELECT DISTINCT doc_stem, page FROM gone) g ON paged.doc_stem = g.doc_stem AND paged.page = g.page WHERE g.page IS NULL)
SELECT doc_stem, string_agg(line || {NL}, '' ORDER BY n) AS markdown FROM kept GROUP BY doc_stem"""


BLOCKS_REMOVED = f"""
tagged AS (SELECT f.doc_stem, f.n, f.line, trim(f.line, {WS}) AS t, d.image_file IS NOT NULL AS del
  FROM (SELECT *, regexp_extract(line, '\\[IMAGE:([^\\]]*)\\]', 1) AS file FROM file_lines) f
  LEFT JOIN (SELECT DISTINCT doc_stem, image_file FROM gone_images) d ON f.doc_stem = d.doc_stem AND f.file = d.image_file AND f.file <> ''),
marks AS (SELECT *, CASE WHEN del THEN 'D' WHEN t = '' THEN 'B' WHEN starts_with(t, '[IMAGE:') OR starts_with(t, '#') OR starts_with(t, '---') THEN 'S' END AS ev FROM tagged),
prior AS (SELECT *, last_value(ev IGNORE NULLS) OVER (PARTITION BY doc_stem ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM marks),
without AS (SELECT doc_stem, string_agg(line, {NL} ORDER BY n) AS markdown FROM prior
  WHERE NOT (coalesce(ev, '') = 'D' OR (coalesce(before, '') = 'D' AND coalesce(ev, 'B') = 'B')) GROUP BY doc_stem)"""

IMAGES_HTML = f"""
imgs AS (SELECT doc_stem, n, line, regexp_matches(trim(line, {WS}), '^\\[IMAGE:.+\\]$') AS is_img FROM file_lines),
runs AS (SELECT *, n - row_number() OVER (PARTITION BY doc_stem, is_img ORDER BY n) AS run FROM imgs),
sized AS (SELECT *, count(*) OVER (PARTITION BY doc_stem, is_img, run) AS c, row_number() OVER (PARTITION BY doc_stem, is_img, run ORDER BY n) AS k FROM runs),
html AS (SELECT doc_stem, n, CASE WHEN NOT is_img THEN line ELSE
    CASE WHEN c > 1 AND k = 1 THEN '{fixed.IMG_WRAPPER_OPEN}' || {NL} ELSE '' END
    || '<img src="http://host/imgs/' || regexp_extract(trim(line, {WS}), '^\\[IMAGE:(.+)\\]$', 1) || '" style="'
    || CASE least(c, 4) WHEN 1 THEN '{fixed.IMG_WIDTHS[1]}' WHEN 2 THEN '{fixed.IMG_WIDTHS[2]}' WHEN 3 THEN '{fixed.IMG_WIDTHS[3]}' ELSE '{fixed.IMG_WIDTHS[4]}' END
    || '{fixed.IMG_STYLE_TAIL}">' || CASE WHEN c > 1 AND k = c THEN {NL} || '{fixed.IMG_WRAPPER_CLOSE}' ELSE '' END END AS line FROM sized),
converted AS (SELECT h.doc_stem, string_agg(line, {NL} ORDER BY n) || CASE WHEN any_value(ends_with(m.markdown, {NL})) THEN {NL} ELSE '' END AS markdown
  FROM html h JOIN markdown_docs m ON h.doc_stem = m.doc_stem GROUP BY h.doc_stem)"""

EDITED = f"""
by_page AS (SELECT doc_stem, page, bool_or(action = 'delete') AS gone, arg_max(content, seq) FILTER (WHERE action = 'replace') AS txt,
    arg_max(new_pos, seq) FILTER (WHERE action = 'move') AS pos FROM section_edits GROUP BY doc_stem, page),
placed AS (SELECT s.doc_stem, s.section_no, CASE WHEN txt IS NOT NULL THEN CASE WHEN header <> '' THEN header || {NL} || '---' || {NL} ELSE '' END || txt ELSE content END AS content,
    CASE WHEN pos IS NULL OR pos = section_no THEN section_no WHEN pos > section_no THEN pos + 0.5 ELSE pos - 0.5 END AS place
  FROM sections s LEFT JOIN by_page e ON s.doc_stem = e.doc_stem AND s.page_number = e.page WHERE NOT coalesce(gone, false))
SELECT doc_stem, string_agg(content, {NL} ORDER BY place, section_no) AS markdown FROM placed GROUP BY doc_stem"""

SEARCH = f"""
pieces AS (SELECT doc_stem, string_split(lower(markdown), 'the manual') AS s FROM (SELECT doc_stem, markdown FROM md)),
m AS (SELECT doc_stem, s, unnest(range(1, len(s))) AS k FROM pieces)
SELECT doc_stem, CAST(k AS INT) AS match_no, CAST(list_sum(list_transform(s[1:k], lambda x: length(x))) + (k - 1) * 10 AS BIGINT) AS "offset", CAST(10 AS INT) AS length FROM m"""


def chunks(size: int, overlap: int) -> str:
    return f"""
parts AS (SELECT doc_stem, unnest(string_split({NL} || markdown || {NL}, {NL} || '---' || {NL})) AS part,
    unnest(range(len(string_split({NL} || markdown || {NL}, {NL} || '---' || {NL})))) AS part_no FROM markdown_docs),
chunks AS (SELECT doc_stem, CAST(part_no AS INT) AS part_no, CAST(k AS INT) AS piece_no, substr(part, k * {size - overlap} + 1, {size}) AS content
  FROM (SELECT *, unnest(range(1 + greatest(length(part) - {overlap} - 1, 0) // {size - overlap})) AS k FROM parts WHERE regexp_matches(part, '[^\\s]')))"""


def lines_of_texts(first: int = 0, stop: int | None = None) -> str:
    """The lines of each text as pages."""
    last = "len(l)" if stop is None else f"least(len(l), {stop})"
    return f"""SELECT doc_stem, CAST(n AS INT) AS page_num, l[n + 1] AS text
  FROM (SELECT doc_stem, l, unnest(range({first}, {last})) AS n FROM (SELECT 'f' || doc_id AS doc_stem, string_split(text, {NL}) AS l FROM documents))"""


def answered(again: str) -> str:
    """Answers to all requests; ``again`` is what an odd page's answer begins with, and whether stored ones count no attempt."""
    failed = "ref LIKE '%13_%'"
    tries = "CASE WHEN page_num % 2 = 0 THEN 0 ELSE 1 END" if again else "1"
    start = f"CASE WHEN page_num % 2 = 0 THEN '' ELSE '{again}' END || " if again else ""
    return f"""SELECT doc_stem, page_num, kind, CAST("index" AS VARCHAR) AS "index", ref AS image_ref,
  CASE WHEN NOT {failed} THEN {start}'seen ' || ref END AS description, CASE WHEN {failed} THEN 'failed after 3 attempts: no answer' END AS error,
  CAST(CASE WHEN {failed} THEN 3 ELSE {tries} END AS INT) AS attempts FROM refs"""


REPORTED = """SELECT p.doc_stem AS job_id, CAST(3 * max(page_num) + 4 AS BIGINT) AS seq, CAST(0 AS INT) AS current_page, CAST(0 AS INT) AS total_pages,
  'complete' AS phase, CAST(coalesce(any_value(images), 0) AS BIGINT) AS images_processed
FROM page_texts p LEFT JOIN (SELECT doc_stem, count(*) AS images FROM {seen} GROUP BY doc_stem) i ON p.doc_stem = i.doc_stem GROUP BY p.doc_stem"""


def _providers() -> str:
    return ", ".join(f"('{n}', '{m}', CAST({c} AS DOUBLE))" for n, _, m, _, c in fixed.PROVIDERS)


RESOLVED = f"""
registry(name, default_model, cost_per_image_usd) AS (VALUES {_providers()}),
js AS (SELECT id, filename, CASE WHEN json_valid(config) AND json_extract_string(CASE WHEN json_valid(config) THEN config ELSE '{{}}' END, '$.provider') IS NOT NULL THEN config ELSE '{{"provider":"{fixed.FALLBACK_PROVIDER}"}}' END AS j FROM jobs),
given AS (SELECT id, filename, j->>'$.provider' AS provider, j->>'$.model' AS m, lower(j->>'$.language') AS lang, lower(j->>'$.quality') AS q,
  CAST(j->>'$.start_page' AS INT) AS start_page, CAST(j->>'$.end_page' AS INT) AS end_page, CAST(j->>'$.dpi' AS INT) AS d,
  coalesce(CAST(j->>'$.table_extraction' AS BOOLEAN), false) AS te, coalesce(CAST(j->>'$.text_only' AS BOOLEAN), false) AS text_only,
  coalesce(j->>'$.storage', 'local') AS storage, coalesce(CAST(j->>'$.notify' AS BOOLEAN), true) AS notify, coalesce(CAST(j->>'$.enhance' AS BOOLEAN), false) AS enhance FROM js),
eff AS (SELECT *, CASE WHEN lang IN ('th', 'en') THEN lang ELSE 'th' END AS language, CASE WHEN q IN ('standard', 'high') THEN q ELSE 'standard' END AS quality FROM given),
dots AS (SELECT *, coalesce(d, CASE WHEN language = 'th' THEN 200 ELSE 150 END) AS base FROM eff)
SELECT id, filename, provider, coalesce(m, default_model, '{fixed.FALLBACK_MODEL}') AS model, language, quality, CAST(start_page AS VARCHAR) AS start_page, CAST(end_page AS VARCHAR) AS end_page, te AND NOT text_only AS table_extraction,
  text_only, storage, notify, enhance, CAST(CASE WHEN quality = 'high' THEN greatest(base, 300) ELSE base END AS INT) AS dpi, cost_per_image_usd, default_model IS NOT NULL AS known_provider
FROM dots LEFT JOIN registry ON provider = name"""


def _last(col: str, order: str = "seq") -> str:
    return f"arg_max({col}, {order}) FILTER (WHERE {col} IS NOT NULL)"


JOB_STATE = f"""
s AS (SELECT job_id, {_last('status')} AS status, {_last('progress')} AS progress, {_last('result')} AS result, {_last('error')} AS error,
  arg_min(ts, seq) AS created_at, arg_max(ts, seq) AS updated_at,
  arg_max(ts, seq) FILTER (WHERE status = 'processing') AS started_at,
  arg_max(ts, seq) FILTER (WHERE status IN ('completed', 'failed', 'cancelled')) AS completed_at FROM job_events GROUP BY job_id)
SELECT *, CAST(date_diff('millisecond', started_at, completed_at) AS DOUBLE) / 1000.0 AS duration_seconds FROM s"""

NOTICES = f"""SELECT id, status, '[quire] Job ' || CASE status WHEN 'completed' THEN 'Completed' ELSE 'Failed' END || {NL} || 'File: ' || filename || {NL} || 'Duration: '
  || CASE WHEN duration_seconds IS NULL THEN '-' WHEN duration_seconds < 60 THEN CAST(round_even(duration_seconds, 0) AS BIGINT) || 's'
       ELSE CAST(floor(duration_seconds / 60) AS BIGINT) || 'm ' || CAST(floor(duration_seconds % 60) AS BIGINT) || 's' END
  || coalesce({NL} || 'Error: ' || error, '') || coalesce({NL} || 'Images: ' || image_count, '') AS message
FROM jobs WHERE notify AND status IN ('completed', 'failed')"""

STATS = f"""
numbers AS (SELECT doc_stem, count(*) FILTER (WHERE regexp_matches(line, '^## Page [0-9]+')) AS page_sections,
    max(CASE WHEN regexp_matches(line, '^## Page [0-9]+') THEN CAST(regexp_extract(line, '^## Page ([0-9]+)', 1) AS BIGINT) END) AS last_page FROM md_lines GROUP BY doc_stem)
SELECT m.doc_stem, page_sections, coalesce(last_page, 0) AS last_page, coalesce(images, 0) AS images, coalesce(detections, 0) AS detections, round(strlen(markdown) / 1024.0, 1) AS size_kb
FROM markdown_docs m JOIN numbers USING (doc_stem) LEFT JOIN (SELECT doc_stem, count(*) AS images FROM image_catalog GROUP BY doc_stem) i USING (doc_stem)
LEFT JOIN (SELECT doc_stem, count(*) AS detections FROM found GROUP BY doc_stem) f USING (doc_stem)"""

RESULTS = """
cat AS (SELECT doc_stem, CAST(to_json(list({'page': page, 'index': "index", 'image_file': image_file, 'type': type, 'width': width, 'height': height, 'description': description} ORDER BY page, "index")) AS VARCHAR) AS metadata, CAST(count(*) AS INT) AS image_count FROM image_catalog GROUP BY doc_stem),
det AS (SELECT doc_stem, CAST(to_json(list({'page': page, 'trash_type': trash_type, 'confidence': confidence, 'reason': reason, 'preview': preview} ORDER BY page, trash_type)) AS VARCHAR) AS trash, CAST(count(*) AS INT) AS trash_count FROM found GROUP BY doc_stem)
SELECT id AS job_id, markdown, metadata, coalesce(image_count_, 0) AS image_count, trash, coalesce(trash_count, 0) AS trash_count
FROM (SELECT id, replace(filename, '.pdf', '') AS doc_stem FROM jobs WHERE status = 'completed') j LEFT JOIN markdown_docs USING (doc_stem)
LEFT JOIN (SELECT doc_stem, metadata, image_count AS image_count_ FROM cat) c USING (doc_stem) LEFT JOIN det USING (doc_stem)"""

REQUESTS = """requests AS (SELECT doc_stem, image_file FROM deleted UNION ALL SELECT doc_stem, '../' || image_file FROM deleted WHERE image_file LIKE '%img1%'),
gone_images AS (SELECT DISTINCT doc_stem, image_file FROM requests WHERE NOT contains(image_file, '..'))"""


def statements() -> dict[str, str]:
    """SQL by query name."""
    pages = duckdb_views("page_texts")
    objects = duckdb_views("page_objects")
    markdown = duckdb_views("markdown_docs")
    ledger = duckdb_views("jobs")
    md = f"{markdown},{MD_LINES}"
    found = f"{pages}, {DETECTED}"
    pipeline = f"{pages},{cleaned()},{repeated('cleaned')},{stripped('cleaned')}"
    both = duckdb_views("markdown_docs", "image_catalog")
    found_again = {
        "search_indexed": "search_corpus", "replace_indexed": "replace_corpus", "save_documents": "write_results",
        "purge_stored": "purge_documents", "stream_terminal_keyed": "stream_terminal",
    }
    made = {
        "page_range": f"{pages} SELECT * FROM page_texts WHERE page_num >= 5 AND page_num < 20",
        "cleanup_text": f"{pages},{cleaned()} SELECT doc_stem, page_num, text FROM cleaned",
        "flag_table_pages": f"{pages},{TABLE_LINES.replace('TSRC', 'page_texts')} SELECT * FROM tflag",
        "route_pages": f"{duckdb_views('page_texts', 'text_page_objects')},{cleaned()},{TABLE_LINES.replace('TSRC', 'cleaned')},{ROUTED} SELECT doc_stem, page_num, strategy, table_candidate FROM routed",
        "assemble_pages": f"{VISION_VIEWS},{VISION_BODY} SELECT * FROM body",
        "catalog_rows": f"{objects}, described AS (SELECT doc_stem, page_num, 'img' AS kind, \"index\", px_w AS width, px_h AS height, 'size ' || px_w || 'x' || px_h AS description, doc_stem || '/' || doc_stem || '_page_' || CASE WHEN page_num + 1 < 1000 THEN lpad(CAST(page_num + 1 AS VARCHAR), 3, '0') ELSE CAST(page_num + 1 AS VARCHAR) END || '_img' || \"index\" || '.png' AS ref FROM ({large('page_objects')})) {CATALOG}",
        "detect_toc": f"{pages} SELECT * FROM {TOC.replace('SRC', 'page_texts')}",
        "detect_boilerplate": f"{pages} SELECT * FROM {BOILER.replace('SRC', 'page_texts')}",
        "detect_blank": f"{pages} SELECT * FROM {BLANK.replace('SRC', 'page_texts')}",
        "detect_trash": f"{found} SELECT * FROM found",
        "all_detections": f"{found},{repeated('page_texts')} SELECT * FROM found UNION ALL {HF_ROW}",
        "filter_detections": f"{found} SELECT * FROM found WHERE page > 0 AND trash_type IN ('table_of_contents', 'blank_page')",
        "detection_summary": f"{found} SELECT doc_stem, trash_type, count(*) AS detections, CASE trash_type WHEN 'table_of_contents' THEN 'Table of Contents' WHEN 'boilerplate' THEN 'Boilerplate' ELSE 'Blank page' END AS type_name FROM found GROUP BY doc_stem, trash_type",
        "remove_detections": f"{duckdb_views('removals')}, {DETECTED} SELECT f.* FROM found f LEFT JOIN removals r ON f.doc_stem = r.doc_stem AND f.page = r.page WHERE r.page IS NULL",
        "keep_large_images": f"{objects} SELECT doc_stem, page_num, \"index\", px_w, px_h FROM ({large('page_objects')})",
        "image_coverage": f"{objects} SELECT doc_stem, page_num, round(coverage, 9) AS coverage FROM ({coverage('page_objects')})",
        "edge_line_counts": f"{pages},{edges('page_texts')} SELECT * FROM edge_counts",
        "headers_footers": f"{pages},{repeated('page_texts')} SELECT * FROM hf",
        "strip_headers_footers": f"{pages},{repeated('page_texts')},{stripped('page_texts')} SELECT * FROM stripped",
        "header_footer_detection": f"{pages},{repeated('page_texts')} {HF_ROW}",
        "assemble_documents": f"{pages} {text_document('page_texts', 'en')}",
        "document_stats": f"{both},{MD_LINES},{DETECTED},{STATS}",
        "text_only_pipeline": f"{pipeline} {text_document('stripped', 'th')}",
        "text_only_detections": f"{pipeline} {trash('stripped')} UNION ALL {HF_ROW}",
        "vision_pipeline": f"{VISION_VIEWS},{VISION_BODY} SELECT doc_stem, CAST(0 AS INT) AS block_no, '# ' || doc_stem || {NL} || {NL} || '> Provider: `ollama` | Model: `qwen2.5vl` | Quality: `standard` | Pages: ' || count(*) || {NL} || {NL} || '> Images: `images/' || doc_stem || '/`' || {NL} || string_agg({NL} || content, '' ORDER BY page_num) AS markdown FROM body GROUP BY doc_stem",
        "vision_catalog": f"{VISION_VIEWS} SELECT * REPLACE (CAST(\"index\" AS VARCHAR) AS \"index\", CAST(width AS VARCHAR) AS width, CAST(height AS VARCHAR) AS height) FROM ({CATALOG})",
        "split_sections": f"{md},{SECTIONS} SELECT * FROM sections",
        "label_sections": f"{md},{SECTIONS},{DETECTED},{LABELS} SELECT s.doc_stem, section_no, page_number, label FROM sections s LEFT JOIN labels_by_page l ON s.doc_stem = l.doc_stem AND s.page_number = l.page",
        "remove_pages": f"{duckdb_views('markdown_docs', 'removals')},{MD_LINES},{removed_pages('SELECT * FROM removals')}",
        "strip_trash": f"{md},{DETECTED},{removed_pages('SELECT doc_stem, page FROM found')}",
        "apply_section_edits": f"{duckdb_views('markdown_docs', 'section_edits')},{MD_LINES},{SECTIONS},{EDITED}",
        "remove_image_blocks": f"{duckdb_views('markdown_docs', 'deleted')},{MD_LINES}, gone_images AS (SELECT * FROM deleted),{BLOCKS_REMOVED} SELECT * FROM without",
        "delete_images": f"{duckdb_views('markdown_docs', 'deleted')},{MD_LINES},{REQUESTS},{BLOCKS_REMOVED} SELECT w.doc_stem, markdown, deleted, failed, greatest(coalesce(had, 0) - deleted, 0) AS image_count FROM without w JOIN (SELECT doc_stem, count(*) FILTER (WHERE NOT contains(image_file, '..')) AS deleted, count(*) FILTER (WHERE contains(image_file, '..')) AS failed FROM requests GROUP BY doc_stem) r USING (doc_stem) LEFT JOIN (SELECT doc_stem, count(*) AS had FROM image_catalog GROUP BY doc_stem) c USING (doc_stem)",
        "image_groups_html": f"{md},{IMAGES_HTML} SELECT * FROM converted",
        "search_corpus": f"{markdown}, md AS (SELECT * FROM markdown_docs),{SEARCH.replace('the manual', 'acme manua')}",
        "replace_corpus": f"{markdown} SELECT doc_stem, regexp_replace(markdown, 'acme manual', 'Guide $1 & co', 'gi') AS markdown FROM markdown_docs",
        "chunk_documents": f"{markdown},{chunks(1000, 200)} SELECT * FROM chunks",
        "chunk_image_integrity": f"{markdown},{chunks(500, 100)} SELECT * FROM chunks WHERE regexp_matches(content, '\\[IMAGE:[^\\]\\n]*(?:$|\\]\\s*(?:$|\\[IMAGE:))')",
        "text_only_failed_pages": f"{pages} SELECT doc_stem, count(*) FILTER (WHERE page_num % 13 = 12) AS failed FROM page_texts GROUP BY doc_stem",
        "long_documents": f"{md},{SECTIONS} SELECT * FROM sections",
        "edit_long_documents": f"{duckdb_views('markdown_docs', 'section_edits')},{MD_LINES},{SECTIONS},{EDITED}",
        "publish_anythingllm": f"{markdown} SELECT doc_stem, 'http://host/api/v1/document/raw-text' AS url, CAST(json_object('textContent', markdown, 'metadata', json_object('title', doc_stem), 'addToWorkspaces', json_array('w1')) AS VARCHAR) AS body FROM markdown_docs",
        "write_results": f"{both},{DETECTED} SELECT m.doc_stem, markdown, coalesce(images, 0) AS images, coalesce(detections, 0) AS detections FROM markdown_docs m LEFT JOIN (SELECT doc_stem, count(*) AS images FROM image_catalog GROUP BY doc_stem) c USING (doc_stem) LEFT JOIN (SELECT doc_stem, count(*) AS detections FROM found GROUP BY doc_stem) d USING (doc_stem)",
        "export_bundle": f"{duckdb_views('jobs', 'markdown_docs', 'image_catalog')} SELECT m.doc_stem, markdown, CAST(coalesce(k, 0) AS INT) AS \"rows\", coalesce(files, '') AS files FROM markdown_docs m LEFT JOIN (SELECT doc_stem, count(*) AS k, string_agg(image_file, {NL} ORDER BY image_file) AS files FROM image_catalog GROUP BY doc_stem) c ON m.doc_stem = c.doc_stem WHERE m.doc_stem IN (SELECT replace(filename, '.pdf', '') FROM jobs WHERE status = 'completed')",
        "publish_files": f"{markdown} SELECT doc_stem, markdown FROM markdown_docs",
        "pages_from_documents": lines_of_texts(),
        "pages_from_documents_range": lines_of_texts(1, 4),
        "pages_in_ranges": lines_of_texts(),
        "pages_of_listed_files": lines_of_texts(),
        "ingest_files": "SELECT 'f' || doc_id AS doc_stem, strlen(text) AS length, sha256(text) AS sha256, CAST(NULL AS VARCHAR) AS error FROM documents",
        "stream_ingest": f"WITH page_texts AS ({lines_of_texts()}),{cleaned()},{repeated('cleaned')},{stripped('cleaned')} SELECT doc_stem, markdown FROM ({text_document('stripped', 'en')})",
        "describe_images": f"{VISION_VIEWS} {answered('')}",
        "describe_once": f"{VISION_VIEWS} {answered('again ')}",
        "reported_run": f"{pages} {REPORTED.replace('{seen}', '(SELECT doc_stem FROM page_texts WHERE false)')}",
        "reported_vision_run": f"{VISION_VIEWS} {REPORTED.replace('{seen}', '(SELECT doc_stem FROM refs WHERE ref NOT LIKE ' + repr('%13_%') + ')')}",
        "publish_payloads": f"{markdown} SELECT doc_stem, 'http://host/api/v1/document-store/upsert/s1' AS url, CAST(json_object('docLoaders', json_array(json_object('loader', 'plainText', 'loaderConfig', json_object('text', markdown)))) AS VARCHAR) AS body FROM markdown_docs",
        "resolve_jobs": f"{ledger},{RESOLVED}",
        "latest_job_state": f"{duckdb_views('job_events')},{JOB_STATE}",
        "fold_ledger": f"{duckdb_views('job_events')},{JOB_STATE}",
        "job_dashboard": f"{ledger} SELECT count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'processing') AS processing, count(*) FILTER (WHERE status = 'failed') AS failed, round(avg(duration_seconds), 6) AS avg_duration FROM jobs",
        "recent_jobs": f"{ledger} SELECT id, filename, status, created_at FROM jobs ORDER BY created_at DESC, id LIMIT 5",
        "notification_feed": f"{ledger} {NOTICES}",
        "results_view": f"{duckdb_views('jobs', 'markdown_docs', 'image_catalog')},{DETECTED},{RESULTS}",
        "purge_documents": f"{duckdb_views('image_catalog', 'removals')} SELECT * FROM image_catalog WHERE doc_stem NOT IN (SELECT doc_stem FROM page_texts WHERE page_num = 49 AND length(text) % 2 = 0)",
        "stream_progress": f"{duckdb_views('progress_events')} SELECT job_id, max(seq) AS seq, arg_max(current_page, seq) AS current_page, arg_max(total_pages, seq) AS total_pages, arg_max(phase, seq) AS phase, CAST(sum(new_images) AS BIGINT) AS images_processed FROM progress_events GROUP BY job_id",
        "stream_terminal": f"{duckdb_views('progress_events')} SELECT p.* FROM progress_events p LEFT JOIN (SELECT job_id, min(seq) AS e FROM progress_events WHERE phase IN ('complete', 'error', 'cancelled') GROUP BY job_id) t USING (job_id) WHERE e IS NULL OR seq <= e",
    }
    made["purge_results"] = f"{duckdb_views('markdown_docs')} SELECT * FROM markdown_docs WHERE doc_stem NOT IN (SELECT doc_stem FROM page_texts WHERE page_num = 49 AND length(text) % 2 = 0)"
    return made | {name: made[same] for name, same in found_again.items()}
