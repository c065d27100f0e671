"""Operator inputs derived from the driver's tables.

Each view is a projection, or groups at most ``DOC_PAGES`` rows, so views grow with
the tables and never sort or collect a large group. ``SQL`` holds the projections
as text that Spark and DuckDB read alike; ``{nl}``, ``{str}`` and ``{q}`` are a
newline, the text type and the identifier quote of the engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC_PAGES = 50

SPARK = {"nl": "'\\n'", "str": "string", "q": "`"}
DUCKDB = {"nl": "chr(10)", "str": "varchar", "q": '"'}

# Pages of one document are DOC_PAGES consecutive documents of the source table, each text
# in full, and after them some pages with texts of their own.
PAGE_TEXTS = """
SELECT doc_stem, page_num,
  concat('ACME Manual ', doc_stem, {nl}, {nl},
    CASE WHEN page_num % 11 = 3 THEN concat('Contents', {nl}, '1. Intro ..... 5', {nl}, '2. Setup ..... 12', {nl}, '3. Usage ..... 20', {nl}, {nl}) ELSE '' END,
    CASE WHEN page_num % 11 = 4 THEN concat('1. A ... 1', {nl}, '2. B ... 2', {nl}, '3. C ... 3', {nl}, '4. D ... 4', {nl}, '5. E ... 5', {nl}, {nl}) ELSE '' END,
    CASE WHEN page_num % 11 = 5 THEN concat('Table of Contents', {nl}, {nl}) ELSE '' END,
    CASE WHEN page_num % 13 = 5 THEN concat('Copyright 2024. All rights reserved.', {nl}, {nl}) ELSE '' END,
    text, {nl}, {nl}, 'Draft copy') AS text
FROM (SELECT concat('doc', CAST(CAST(floor(doc_id / 50) AS bigint) AS {str})) AS doc_stem,
        CAST(doc_id % 50 AS int) AS page_num, text FROM documents
      UNION ALL
      SELECT concat('doc', CAST(CAST(floor(doc_id / 50) AS bigint) AS {str})) AS doc_stem, CAST(doc_id % 50 + 50 AS int) AS page_num,
        CASE WHEN doc_id % 50 % 13 = 6 THEN 'Terms of use apply to every page of this short notice.'
          WHEN doc_id % 50 % 17 = 7 THEN ''
          WHEN doc_id % 50 % 17 = 8 THEN 'This page intentionally left blank'
          ELSE concat('id  name  qty', {nl}, {nl}, 'a  b  1', {nl}, {nl}, 'c  d  2', {nl}, {nl}, 'e  f  3') END AS text
      FROM documents WHERE doc_id % 50 % 13 = 6 OR doc_id % 50 % 17 IN (7, 8, 9)) d
"""

_TAGS = """
SELECT doc_stem, page_num + 1 AS page, idx AS {q}index{q},
  concat(doc_stem, '/', doc_stem, '_page_', lpad(CAST(page_num + 1 AS {str}), 3, '0'), '_img', CAST(idx AS {str}), '.png') AS image_file,
  'extracted_image' AS type, CAST(100 + page_num AS int) AS width, CAST(120 AS int) AS height,
  concat('caption ', CAST(page_num + 1 AS {str}), '.', CAST(idx AS {str})) AS description
FROM (SELECT doc_stem, page_num, {unnest} AS idx FROM page_texts) p
WHERE idx <= page_num % 4
"""
IMAGE_CATALOG = {
    "spark": _TAGS.replace("{unnest}", "explode(array(1, 2, 3))"),
    "duckdb": _TAGS.replace("{unnest}", "unnest([1, 2, 3])"),
}

JOBS = """
SELECT concat('job-', CAST(o_orderkey AS {str})) AS id, concat('doc', CAST(o_orderkey AS {str}), '.pdf') AS filename,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'processing' END AS status,
  o_orderdate AS created_at,
  CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderkey % 7200 AS double) END AS duration_seconds,
  o_orderkey % 5 <> 0 AS notify,
  CASE WHEN o_orderstatus = 'P' THEN concat('bad page ', CAST(o_orderkey % 90 AS {str})) END AS error,
  CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 12 AS int) END AS image_count,
  CASE o_orderkey % 8
    WHEN 0 THEN '{open}"provider":"ollama"{close}'
    WHEN 1 THEN '{open}"provider":"openai","model":"custom-model","language":"EN"{close}'
    WHEN 2 THEN '{open}"provider":"claude","quality":"high","dpi":150{close}'
    WHEN 3 THEN '{open}"provider":"gemini","language":"fr","table_extraction":true,"notify":false{close}'
    WHEN 4 THEN '{open}"provider":"unknown","text_only":true,"table_extraction":true{close}'
    WHEN 5 THEN '{open}"provider":"xai","dpi":400,"quality":"HIGH","start_page":2,"end_page":9{close}'
    WHEN 6 THEN '{open}"language":"en"{close}'
    ELSE 'not json' END AS config
FROM orders
"""

PROGRESS_EVENTS = """
SELECT concat('job-', CAST(user_id AS {str})) AS job_id, event_id AS seq, ts,
  CAST(event_id % 40 AS int) AS current_page, CAST(40 AS int) AS total_pages,
  CASE WHEN event_type = 'click' THEN CAST(1 AS int) ELSE CAST(0 AS int) END AS new_images,
  CASE event_type WHEN 'signup' THEN 'starting' WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'complete' ELSE 'processing' END AS phase
FROM events
"""

# Objects with the same obj_idx on a page are alike in every column used here.
PAGE_OBJECTS = """
SELECT concat('doc', CAST(l_orderkey % 50 AS {str})) AS doc_stem, CAST(l_orderkey AS int) AS page_num,
  CAST(l_linenumber AS bigint) * 100000000 + (l_partkey % 1000000) * 100 + CAST(l_quantity AS bigint) AS obj_idx,
  CASE WHEN l_partkey % 5 = 0 THEN 'text' ELSE 'image' END AS kind,
  CAST(595 AS double) AS page_w, CAST(842 AS double) AS page_h,
  CAST(0 AS double) AS {q}left{q}, CAST(l_quantity * 10 AS double) AS {q}right{q},
  CAST(l_partkey % 500 AS double) AS top, CAST(0 AS double) AS bottom,
  CAST(l_quantity * 10 AS int) AS px_w, CAST(l_partkey % 500 AS int) AS px_h
FROM lineitem
"""
# Order values numbered together; a page with very many objects falls into many ranges.
OBJECT_RANGE = 1000000

# Objects on the pages of page_texts, for queries that need both.
TEXT_PAGE_OBJECTS = """
SELECT doc_stem, page_num, CAST(idx AS bigint) AS obj_idx,
  CASE WHEN (page_num + idx) % 7 = 0 THEN 'text' ELSE 'image' END AS kind,
  CAST(595 AS double) AS page_w, CAST(842 AS double) AS page_h,
  CAST(10 AS double) AS {q}left{q}, CAST(10 + 80 * (page_num % 6) AS double) AS {q}right{q},
  CAST(250 + 20 * idx AS double) AS top, CAST(0 AS double) AS bottom,
  CAST(80 * (page_num % 6) AS int) AS px_w, CAST(60 + 30 * idx AS int) AS px_h
FROM (SELECT doc_stem, page_num, {unnest} AS idx FROM page_texts) p
WHERE idx <= page_num % 5
"""

JOB_EVENTS = """
SELECT concat('job-', CAST(o_orderkey AS {str})) AS job_id, CAST(step AS bigint) AS seq,
  o_orderdate + INTERVAL 1 SECOND * (step * (1 + o_orderkey % 90)) AS ts,
  CASE step WHEN 1 THEN 'pending' WHEN 2 THEN 'processing'
    WHEN 4 THEN CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' WHEN 'O' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'cancelled' END END END AS status,
  CASE WHEN step = 3 THEN concat('page ', CAST(o_orderkey % 40 AS {str})) END AS progress,
  CASE WHEN step = 4 AND o_orderstatus = 'F' THEN concat('images ', CAST(o_orderkey % 12 AS {str})) END AS result,
  CASE WHEN step = 4 AND o_orderstatus = 'P' THEN 'bad page' END AS error
FROM (SELECT *, {unnest} AS step FROM orders) o
"""

REMOVALS = "SELECT doc_stem, page_num + 1 AS page FROM page_texts WHERE page_num % 9 = 2"
DELETED = "SELECT doc_stem, image_file FROM image_catalog WHERE page % 5 = 0"
SECTION_EDITS = """
SELECT doc_stem, page_num + 1 AS page,
  CASE WHEN (page_num + 1) % 10 = 0 THEN 'delete' WHEN (page_num + 1) % 10 = 1 THEN 'replace' ELSE 'move' END AS action,
  CASE WHEN (page_num + 1) % 10 = 1 THEN concat('rewritten ', doc_stem) END AS content,
  CASE WHEN page_num + 1 = 7 THEN CAST(3 AS int) WHEN page_num + 1 = 12 THEN CAST(20 AS int) END AS new_pos,
  CAST(2 AS int) AS seq
FROM page_texts WHERE (page_num + 1) % 10 IN (0, 1) OR page_num + 1 IN (7, 12)
UNION ALL
SELECT doc_stem, page_num + 1 AS page, CASE WHEN page_num = 6 THEN 'move' ELSE 'replace' END AS action,
  concat('zz earlier ', doc_stem) AS content, CAST(30 AS int) AS new_pos, CAST(1 AS int) AS seq
FROM page_texts WHERE page_num IN (6, 10, 20)
"""

_UNNEST = {
    "TEXT_PAGE_OBJECTS": {"spark": "explode(array(1, 2, 3, 4))", "duckdb": "unnest([1, 2, 3, 4])"},
    "JOB_EVENTS": {"spark": "explode(array(1, 2, 3, 4))", "duckdb": "unnest([1, 2, 3, 4])"},
}


def _fill(sql: str, engine: str, name: str = "") -> str:
    # Spark formats the text once more, so braces are doubled for it.
    twice = 2 if engine == "spark" else 1
    values = {**(SPARK if engine == "spark" else DUCKDB), "open": "{" * twice, "close": "}" * twice}
    values["unnest"] = _UNNEST.get(name, {}).get(engine, "")
    for key, value in values.items():
        sql = sql.replace("{" + key + "}", value)
    return sql.strip()


_BODY = """concat({nl}, {nl}, '---', {nl}, '## Page ', CAST(page_num + 1 AS {str}), {nl}, {nl}, text, {nl},
  CASE WHEN page_num % 4 >= 1 THEN {tag1} ELSE '' END, CASE WHEN page_num % 4 >= 2 THEN {tag2} ELSE '' END, CASE WHEN page_num % 4 >= 3 THEN {tag3} ELSE '' END)"""


def _body(engine: str) -> str:
    sql = _BODY
    for idx in ("1", "2", "3"):
        tag = (
            "concat({nl}, '[IMAGE:', doc_stem, '/', doc_stem, '_page_', lpad(CAST(page_num + 1 AS {str}), 3, '0'), '_img"
            + idx
            + ".png]', {nl}, CASE WHEN page_num % 2 = 1 THEN concat('caption ', CAST(page_num + 1 AS {str}), '."
            + idx
            + "', {nl}) ELSE '' END)"
        )
        sql = sql.replace("{tag" + idx + "}", tag)
    return _fill(sql, engine)


def duckdb_views(*names: str) -> str:
    """``WITH`` clause that defines the named views and what they read."""
    defs = {
        "page_texts": _fill(PAGE_TEXTS, "duckdb"),
        "image_catalog": _fill(IMAGE_CATALOG["duckdb"], "duckdb"),
        "markdown_docs": "SELECT doc_stem, concat('# ', doc_stem, chr(10), string_agg("
        + _body("duckdb")
        + ", '' ORDER BY page_num)) AS markdown FROM page_texts GROUP BY doc_stem",
        "jobs": _fill(JOBS, "duckdb"),
        "progress_events": _fill(PROGRESS_EVENTS, "duckdb"),
        "page_objects": _fill(PAGE_OBJECTS, "duckdb"),
        "text_page_objects": _fill(TEXT_PAGE_OBJECTS, "duckdb", "TEXT_PAGE_OBJECTS"),
        "job_events": _fill(JOB_EVENTS, "duckdb", "JOB_EVENTS"),
        "removals": REMOVALS,
        "deleted": DELETED,
        "section_edits": _fill(SECTION_EDITS, "duckdb"),
    }
    needs = {
        "image_catalog": ["page_texts"],
        "markdown_docs": ["page_texts"],
        "text_page_objects": ["page_texts"],
        "removals": ["page_texts"],
        "deleted": ["page_texts", "image_catalog"],
        "section_edits": ["page_texts"],
    }
    wanted: list[str] = []
    for name in names:
        for dep in [*needs.get(name, []), name]:
            if dep not in wanted:
                wanted.append(dep)
    return "WITH " + ",\n".join(f"{n} AS ({defs[n]})" for n in wanted)


class Views:
    """The same views as Spark tables over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _select(self, sql: str, source: str, df: DataFrame, name: str = "") -> DataFrame:
        return self.spark.sql(
            _fill(sql, "spark", name).replace(f"FROM {source}", "FROM {src}"), src=df
        )

    @property
    def page_texts(self) -> DataFrame:
        return self._select(PAGE_TEXTS, "documents", self.table("documents"))

    @property
    def image_catalog(self) -> DataFrame:
        return self._select(IMAGE_CATALOG["spark"], "page_texts", self.page_texts)

    @property
    def markdown_docs(self) -> DataFrame:
        body = self.page_texts.select("doc_stem", "page_num", F.expr(_body("spark")).alias("body"))
        joined = body.groupBy("doc_stem").agg(
            F.sort_array(F.collect_list(F.struct("page_num", "body"))).alias("p")
        )
        return joined.select(
            "doc_stem",
            F.concat(F.lit("# "), "doc_stem", F.lit("\n"), F.array_join("p.body", "")).alias("markdown"),
        )

    @property
    def jobs(self) -> DataFrame:
        return self._select(JOBS, "orders", self.table("orders"))

    @property
    def progress_events(self) -> DataFrame:
        return self._select(PROGRESS_EVENTS, "events", self.table("events"))

    @property
    def page_objects(self) -> DataFrame:
        return self._select(PAGE_OBJECTS, "lineitem", self.table("lineitem"))

    @property
    def text_page_objects(self) -> DataFrame:
        return self._select(TEXT_PAGE_OBJECTS, "page_texts", self.page_texts, "TEXT_PAGE_OBJECTS")

    @property
    def job_events(self) -> DataFrame:
        return self._select(JOB_EVENTS, "orders", self.table("orders"), "JOB_EVENTS")

    @property
    def removals(self) -> DataFrame:
        return self._select(REMOVALS, "page_texts", self.page_texts)

    @property
    def deleted(self) -> DataFrame:
        return self._select(DELETED, "image_catalog", self.image_catalog)

    @property
    def section_edits(self) -> DataFrame:
        return self._select(SECTION_EDITS, "page_texts", self.page_texts)
