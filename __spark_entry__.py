
from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import oracle_queries
from quire import schemas
from quire.fixtures import OBJECT_RANGE, Views
from quire.operators import (
    answers,
    boilerplate,
    detect,
    documents,
    extract,
    images,
    jobs,
    markdown,
    pages,
)
from quire.operators.enrich import (
    describe_images,
    description_requests,
    pages_from_documents,
    settle_descriptions,
)
from quire.operators.keys import whole_documents
from quire.plans import pipelines, reported
from quire.session import materialize, new_folder
from quire.sources import indexed, sinks, stored
from quire.sources.files import ingest_files, list_files, read_results
from quire.streaming import keyed, ledger, progress

try:  # the operators of training-data pipelines may be left out of an installation
    import corpus_pipeline
    from quire.llm import queries as llm_queries
except ImportError:
    corpus_pipeline = llm_queries = None

ROOT = os.environ.get("QUIRE_TESTDATA", "/root/testdata")


def entry(spark: SparkSession) -> DataFrame:
    """Text-only run over sf0.001."""
    return _text_only(spark, f"{ROOT}/sf0.001")


def _text_only(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.text_only_pipeline(Views(spark, folder).page_texts).documents


def _describer() -> Callable[[dict], str]:
    """Stands in for a model: names the image, and never answers for page 13."""

    # A nested function is sent to the workers whole, so they need not import this file.
    def answer(row: dict) -> str:
        if "13_" in row["image_ref"]:
            raise RuntimeError("no answer")
        return "seen " + row["image_ref"]

    return answer


def _as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Whole numbers that may be missing, as text: both engines then show them alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def _vision(v: Views) -> pipelines.Outputs:
    return pipelines.vision_pipeline(
        v.page_texts, v.text_page_objects, _describer(), base_delay=0.0
    )


def _route(v: Views) -> DataFrame:
    cleaned = pages.cleanup_text(v.page_texts)
    return pages.route_pages(cleaned, images.image_coverage(v.text_page_objects))


def _assemble_pages(v: Views) -> DataFrame:
    routed = materialize(_route(v), "routed")
    asked = description_requests(routed, v.text_page_objects)
    answers = describe_images(asked, _describer(), base_delay=0.0)
    return pages.assemble_pages(routed, materialize(settle_descriptions(answers), "descriptions"))


def _catalog(v: Views) -> DataFrame:
    size = F.concat(F.lit("size "), F.col("px_w"), F.lit("x"), F.col("px_h"))
    described = images.keep_large_images(v.page_objects, block_width=OBJECT_RANGE).select(
        "doc_stem",
        "page_num",
        F.lit("img").alias("kind"),
        "index",
        F.col("px_w").alias("width"),
        F.col("px_h").alias("height"),
        size.alias("description"),
    )
    return images.catalog_rows(described, "ollama", "qwen2.5vl")


def _detections(v: Views) -> DataFrame:
    return detect.detect_trash(v.page_texts)


def _headers(v: Views) -> DataFrame:
    return boilerplate.headers_footers(v.page_texts)


def _assemble_documents(v: Views) -> DataFrame:
    return documents.assemble_documents(
        pages.assemble_pages(v.page_texts), documents.text_only_head("en"), v.page_texts
    )


def _delete_images(v: Views) -> DataFrame:
    unsafe = v.deleted.where(F.col("image_file").contains("img1"))
    requests = v.deleted.unionByName(
        unsafe.withColumn("image_file", F.concat(F.lit("../"), "image_file"))
    )
    done = pipelines.delete_images(v.markdown_docs, v.image_catalog, requests)
    return done.documents.join(done.counts, "doc_stem")


def _results(v: Views) -> DataFrame:
    view = documents.results_view(v.jobs, v.markdown_docs, v.image_catalog, _detections(v))
    return view.withColumns({"metadata": F.to_json("metadata"), "trash": F.to_json("trash")})


def _to_purge(v: Views) -> DataFrame:
    return v.page_texts.where((F.col("page_num") == 49) & (F.length("text") % 2 == 0)).select("doc_stem")


def _purge(v: Views) -> DataFrame:
    return documents.purge_documents({"catalog": v.image_catalog}, _to_purge(v))["catalog"]


def _label(v: Views) -> DataFrame:
    labelled = markdown.label_sections(markdown.split_sections(v.markdown_docs), _detections(v))
    return labelled.select("doc_stem", "section_no", "page_number", "label")


def _event_stream(v: Views) -> DataFrame:
    """The events table as a file stream, in the shape of the progress view."""
    schema = v.table("events").schema
    # A pattern serves for one file as well as for a folder of part files.
    raw = v.spark.readStream.schema(schema).parquet(f"{v.folder}/events.parque[t]")
    phase = (
        F.when(F.col("event_type") == "signup", "starting")
        .when(F.col("event_type") == "error", "error")
        .when(F.col("event_type") == "purchase", "complete")
        .otherwise("processing")
    )
    return raw.select(
        F.concat(F.lit("job-"), F.col("user_id").cast("string")).alias("job_id"),
        F.col("event_id").alias("seq"),
        "ts",
        (F.col("event_id") % 40).cast("int").alias("current_page"),
        F.lit(40).alias("total_pages"),
        F.when(F.col("event_type") == "click", 1).otherwise(0).alias("new_images"),
        phase.alias("phase"),
    )


def _stream_progress(v: Views) -> DataFrame:
    base = new_folder(v.spark, "progress")
    progress.stream_progress(_event_stream(v), f"{base}/out", f"{base}/state").awaitTermination()
    return progress.read_progress(v.spark, f"{base}/out")


def _stream_terminal(v: Views) -> DataFrame:
    base = new_folder(v.spark, "terminal")
    progress.stream_terminal(_event_stream(v), base, f"{base}/state").awaitTermination()
    return v.spark.read.parquet(f"{base}/feed").drop("batch_id")


def _long_documents(v: Views) -> DataFrame:
    """The Markdown documents in rows of seven pages each, as a long document is assembled."""
    parts = F.split("markdown", r"\n(?=---\n## Page (?:[0-9]*[27])\n)", -1)
    return v.markdown_docs.select("doc_stem", F.posexplode(parts).alias("block_no", "markdown"))


def _failed_pages(v: Views) -> DataFrame:
    """Failed pages left in each document after its trash is stripped: all of them."""
    failed = F.col("page_num") % 13 == 12
    pages_ = v.page_texts.withColumns(
        {"text": F.when(failed, "").otherwise(F.col("text")), "error": F.when(failed, "boom")}
    )
    run = pipelines.text_only_pipeline(pages_, keep_pages=True)
    left = pipelines.strip_trash(run.documents, run.detections)
    count = F.regexp_count("markdown", F.lit("Error: boom")).cast("long")
    return left.select("doc_stem", count.alias("failed"))


def _written(v: Views) -> DataFrame:
    """Documents and catalogue written in two runs, and read back together."""
    base = new_folder(v.spark, "results")
    found = _detections(v)
    for rest in (0, 1):
        mine = F.crc32("doc_stem") % 2 == rest
        sinks.write_results(
            v.markdown_docs.where(mine), v.image_catalog.where(mine), found.where(mine), base
        )
    back = read_results(v.spark, base)
    return _counted(back.documents, back.catalog, back.detections)


def _counted(docs: DataFrame, catalog: DataFrame, found: DataFrame) -> DataFrame:
    images_ = catalog.groupBy("doc_stem").agg(F.count(F.lit(1)).alias("images"))
    trash = found.groupBy("doc_stem").agg(F.count(F.lit(1)).alias("detections"))
    joined = docs.join(images_, "doc_stem", "left").join(trash, "doc_stem", "left")
    return joined.select("doc_stem", "markdown", F.coalesce("images", F.lit(0)).alias("images"), F.coalesce("detections", F.lit(0)).alias("detections"))


def _exported(v: Views) -> DataFrame:
    """The bundle's three parts, read back: Markdown, number of catalogue rows, image files."""
    base = new_folder(v.spark, "bundle")
    sinks.export_bundle(v.markdown_docs, v.image_catalog, v.jobs, base)

    def part(folder: str, value: str) -> DataFrame:
        found = v.spark.read.option("recursiveFileLookup", "true").text(f"{base}/{folder}", wholetext=True)
        name = F.regexp_extract(F.col("_metadata.file_path"), "/doc_stem=([^/]*)/", 1)
        return found.select(name.alias("doc_stem"), F.regexp_replace("value", r"\n\z", "").alias(value))

    joined = part("markdown", "markdown").join(part("metadata", "catalog"), "doc_stem", "full")
    joined = joined.join(part("images", "files"), "doc_stem", "full")
    rows = F.from_json("catalog", "array<struct<image_file:string>>")
    return joined.select("doc_stem", "markdown", F.size(rows).alias("rows"), F.coalesce("files", F.lit("")).alias("files"))


def _published(v: Views) -> DataFrame:
    """Files of all documents, published and read back."""
    base = new_folder(v.spark, "published")
    target = base if ":" in base else f"file://{base}"
    sinks.publish_files(sinks.markdown_files(v.markdown_docs), target)
    found = v.spark.read.text(f"{base}/*.md", wholetext=True)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"(.*)\.md", 1)
    return found.select(name.alias("doc_stem"), F.col("value").alias("markdown"))


def _files(v: Views) -> DataFrame:
    """The texts as files, a page a line."""
    name = F.concat(F.lit("f"), F.col("doc_id").cast("string"))
    return v.table("documents").select(name.alias("doc_stem"), F.col("text").cast("binary").alias("content"))


def _lines() -> Callable[[bytes], list[str]]:
    def lines(content: bytes):
        yield from content.decode().split("\n")

    return lines


def _line_reader() -> extract.PageReader:
    class Lines:
        def count(self, content: bytes) -> int:
            return content.count(b"\n") + 1

        def read(self, content: bytes, first: int, stop: int):
            return content.decode().split("\n")[first:stop]

    return Lines()


_PAGE = ["doc_stem", "page_num", "text"]


def _in_box(v: Views) -> str:
    """A folder with a file for each text."""
    base = new_folder(v.spark, "in")
    files = _files(v).select(F.concat("doc_stem", F.lit(".pdf")).alias("name"), "content")
    sinks.publish_files(files, base if ":" in base else f"file://{base}")
    return base


def _listed_pages(v: Views) -> DataFrame:
    listed = list_files(v.spark, _in_box(v))
    return extract.pages_in_ranges(listed, _line_reader(), range_pages=8, opener=extract.open_file).select(*_PAGE)


def _ingested(v: Views) -> DataFrame:
    found = ingest_files(v.spark, _in_box(v))
    return found.select("doc_stem", "length", F.sha2("content", 256).alias("sha256"), "error")


def _stream_ingest(v: Views) -> DataFrame:
    base = new_folder(v.spark, "ingest")
    progress.stream_ingest(
        v.spark, _in_box(v), f"{base}/out", _lines(), f"{base}/state", "en", max_files=500
    ).awaitTermination()
    docs = v.spark.read.schema(schemas.MARKDOWN_DOCS).parquet(f"{base}/out/batch_id=*/markdown")
    return whole_documents(docs)


def _stream_terminal_keyed(v: Views) -> DataFrame:
    base = new_folder(v.spark, "feed")
    events = _event_stream(v)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    keyed.stream_terminal_keyed(timed, f"{base}/feed", f"{base}/state", delay="3650 days").awaitTermination()
    found = v.spark.read.schema(timed.schema).parquet(f"{base}/feed")
    return found.withColumn("ts", F.col("ts").cast(events.schema["ts"].dataType))


def _reported(v: Views, process: Callable[[DataFrame], pipelines.Outputs]) -> DataFrame:
    """Progress of each document as the events of a run tell it."""
    base = new_folder(v.spark, "run")
    reported.reported_run(v.page_texts, process, f"{base}/out", f"{base}/events", waves=3)
    told = reported.stream_events(v.spark, f"{base}/events")
    progress.stream_progress(told, f"{base}/progress", f"{base}/state").awaitTermination()
    return progress.read_progress(v.spark, f"{base}/progress")


def _reported_text(v: Views) -> DataFrame:
    return _reported(v, lambda some: pipelines.text_only_pipeline(some, keep_pages=True))


def _reported_vision(v: Views) -> DataFrame:
    def process(some: DataFrame) -> pipelines.Outputs:
        objects = v.text_page_objects.join(some.select("doc_stem").distinct(), "doc_stem", "left_semi")
        return pipelines.vision_pipeline(some, objects, _describer(), base_delay=0.0)

    return _reported(v, process)


def _requests(v: Views) -> DataFrame:
    return description_requests(materialize(_route(v), "routed"), v.text_page_objects)


_ANSWER = ["doc_stem", "page_num", "kind", "index", "image_ref", "description", "error", "attempts"]


def _described(v: Views) -> DataFrame:
    return _as_text(describe_images(_requests(v), _describer(), base_delay=0.0).select(*_ANSWER), "index")


def _described_once(v: Views) -> DataFrame:
    """Answers of a second run, after a first one over every other page, by another model of the same name."""
    store = new_folder(v.spark, "answers")
    asked = _requests(v)
    first = answers.describe_once(asked.where("page_num % 2 = 0"), _describer(), store, "m", base_delay=0.0)
    first.write.format("noop").mode("overwrite").save()
    plain = _describer()
    found = answers.describe_once(asked, lambda row: "again " + plain(row), store, "m", base_delay=0.0)
    return _as_text(found.select(*_ANSWER), "index")


def _folded_ledger(v: Views) -> DataFrame:
    base = new_folder(v.spark, "ledger")
    part = F.crc32(F.concat("job_id", F.lit(":"), F.col("seq").cast("string"))) % 4
    for number in range(4):
        ledger.fold_updates(v.job_events.where(part == number), base, number, every=2)
    return ledger.read_ledger(v.spark, base)


def _indexed(v: Views) -> str:
    base = new_folder(v.spark, "corpus")
    indexed.index_corpus(v.markdown_docs, base, blocks=16)
    return base


def _replaced_indexed(v: Views) -> DataFrame:
    base = _indexed(v)
    indexed.replace_indexed(v.spark, base, "acme manual", "Guide $1 & co")
    return indexed.read_indexed(v.spark, base)


_STORED = {
    "markdown": "doc_stem string, markdown string",
    "images_metadata": "doc_stem string, page int, index int, image_file string, type string, width int, height int, description string",
    "trash": schemas.DETECTIONS,
}


def _stored(v: Views) -> str:
    """All documents saved, then half of them again with other contents, then that half as it was."""
    base = new_folder(v.spark, "stored")
    half = F.crc32("doc_stem") % 2 == 0
    tables = {"markdown": v.markdown_docs, "images_metadata": v.image_catalog, "trash": _detections(v)}
    stored.save_documents(tables, base, buckets=8)
    other = v.markdown_docs.where(half).withColumn("markdown", F.lit("other"))
    stored.save_documents(
        {"markdown": other, "images_metadata": v.image_catalog.where(half & (F.col("page") < 9)), "trash": _detections(v).where("false")},
        base,
        buckets=8,
    )
    stored.save_documents({n: t.where(half) for n, t in tables.items()}, base, buckets=8)
    return base


def _saved(v: Views) -> DataFrame:
    base = _stored(v)
    of = lambda name: stored.read_stored(v.spark, base, name, _STORED[name])
    return _counted(of("markdown"), of("images_metadata"), of("trash"))


def _purged(v: Views) -> DataFrame:
    base = _stored(v)
    stored.purge_stored(v.spark, base, _STORED, _to_purge(v), buckets=8)
    return stored.read_stored(v.spark, base, "images_metadata", _STORED["images_metadata"]).drop("bucket")


def _purged_results(v: Views) -> DataFrame:
    base = new_folder(v.spark, "results")
    sinks.write_results(v.markdown_docs, v.image_catalog, _detections(v), base)
    sinks.purge_results(_to_purge(v), base)
    return read_results(v.spark, base).documents


_QUERIES: dict[str, Callable[[Views], DataFrame]] = {
    "page_range": lambda v: pages.page_range(v.page_texts, 5, 20),
    "cleanup_text": lambda v: pages.cleanup_text(v.page_texts),
    "flag_table_pages": lambda v: pages.flag_table_pages(v.page_texts).drop("text"),
    "route_pages": lambda v: _route(v).drop("text"),
    "assemble_pages": _assemble_pages,
    "catalog_rows": _catalog,
    "detect_toc": lambda v: detect.detect_toc(v.page_texts),
    "detect_boilerplate": lambda v: detect.detect_boilerplate(v.page_texts),
    "detect_blank": lambda v: detect.detect_blank(v.page_texts),
    "detect_trash": _detections,
    "all_detections": lambda v: detect.all_detections(v.page_texts, _headers(v)),
    "filter_detections": lambda v: detect.filter_detections(_detections(v), ["toc", "blank", "other"]),
    "detection_summary": lambda v: detect.detection_summary(_detections(v)),
    "remove_detections": lambda v: detect.remove_detections(_detections(v), v.removals),
    "keep_large_images": lambda v: images.keep_large_images(
        v.page_objects, block_width=OBJECT_RANGE
    ).select("doc_stem", "page_num", "index", "px_w", "px_h"),
    "image_coverage": lambda v: images.image_coverage(v.page_objects).withColumn(
        "coverage", F.round("coverage", 9)
    ),
    "edge_line_counts": lambda v: boilerplate.edge_line_counts(v.page_texts),
    "headers_footers": _headers,
    "strip_headers_footers": lambda v: boilerplate.strip_headers_footers(
        v.page_texts, _headers(v), keys=v.page_texts
    ),
    "header_footer_detection": lambda v: boilerplate.header_footer_detection(_headers(v)),
    "assemble_documents": _assemble_documents,
    "document_stats": lambda v: documents.document_stats(
        v.markdown_docs, v.image_catalog, _detections(v)
    ),
    "text_only_pipeline": lambda v: _text_only(v.spark, v.folder),
    "text_only_detections": lambda v: pipelines.text_only_pipeline(v.page_texts).detections,
    "vision_pipeline": lambda v: _vision(v).documents,
    "vision_catalog": lambda v: _as_text(_vision(v).catalog, "index", "width", "height"),
    "split_sections": lambda v: markdown.split_sections(v.markdown_docs),
    "label_sections": _label,
    "remove_pages": lambda v: markdown.remove_pages(v.markdown_docs, v.removals),
    "strip_trash": lambda v: pipelines.strip_trash(v.markdown_docs, _detections(v)),
    "apply_section_edits": lambda v: markdown.apply_section_edits(v.markdown_docs, v.section_edits),
    "remove_image_blocks": lambda v: images.remove_image_blocks(v.markdown_docs, v.deleted),
    "delete_images": _delete_images,
    "image_groups_html": lambda v: images.image_groups_html(v.markdown_docs, "http://host/imgs/"),
    "search_corpus": lambda v: markdown.search_corpus(v.markdown_docs, "ACME manua"),
    "replace_corpus": lambda v: markdown.replace_corpus(
        v.markdown_docs, "acme manual", "Guide $1 & co"
    ),
    "chunk_documents": lambda v: markdown.chunk_documents(v.markdown_docs),
    "chunk_image_integrity": lambda v: markdown.chunk_image_integrity(
        markdown.chunk_documents(v.markdown_docs, 500, 100)
    ),
    "text_only_failed_pages": _failed_pages,
    "long_documents": lambda v: markdown.split_sections(_long_documents(v)),
    "edit_long_documents": lambda v: markdown.apply_section_edits(_long_documents(v), v.section_edits),
    "publish_anythingllm": lambda v: sinks.publish_payloads(
        v.markdown_docs, "anythingllm", base_url="http://host/", workspace="w1"
    ),
    "write_results": _written,
    "export_bundle": _exported,
    "publish_files": _published,
    "pages_from_documents": lambda v: pages_from_documents(_files(v), _lines()).select(*_PAGE),
    "pages_from_documents_range": lambda v: pages_from_documents(_files(v), _lines(), 1, 4).select(*_PAGE),
    "pages_in_ranges": lambda v: extract.pages_in_ranges(_files(v), _line_reader(), range_pages=8).select(*_PAGE),
    "pages_of_listed_files": _listed_pages,
    "ingest_files": _ingested,
    "stream_ingest": _stream_ingest,
    "describe_images": _described,
    "describe_once": _described_once,
    "reported_run": _reported_text,
    "reported_vision_run": _reported_vision,
    "fold_ledger": _folded_ledger,
    "search_indexed": lambda v: indexed.search_indexed(v.spark, _indexed(v), "ACME manua"),
    "replace_indexed": _replaced_indexed,
    "save_documents": _saved,
    "purge_stored": _purged,
    "purge_results": _purged_results,
    "stream_terminal_keyed": _stream_terminal_keyed,
    "publish_payloads": lambda v: sinks.publish_payloads(
        v.markdown_docs, "flowise", base_url="http://host/", store_id="s1"
    ),
    "resolve_jobs": lambda v: _as_text(
        jobs.resolve_jobs(v.jobs, jobs.provider_registry(v.spark)), "start_page", "end_page"
    ),
    "latest_job_state": lambda v: jobs.latest_job_state(v.job_events),
    "job_dashboard": lambda v: jobs.job_dashboard(v.jobs).withColumn(
        "avg_duration", F.round("avg_duration", 6)
    ),
    "recent_jobs": lambda v: jobs.recent_jobs(
        v.jobs.select("id", "filename", "status", "created_at")
    ),
    "notification_feed": lambda v: jobs.notification_feed(v.jobs),
    "results_view": _results,
    "purge_documents": _purge,
    "stream_progress": _stream_progress,
    "stream_terminal": _stream_terminal,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by operator name; each takes a session and a data folder."""
    found = {
        name: (lambda spark, folder, run=run: run(Views(spark, folder)))
        for name, run in _QUERIES.items()
    }
    if llm_queries is not None:
        found |= llm_queries.QUERIES | {"pipeline": corpus_pipeline.run}
    return found


def oracle_sql() -> dict[str, str]:
    """Equivalent DuckDB SQL by query name."""
    found = oracle_queries.statements()
    if llm_queries is not None:
        found |= llm_queries.ORACLE_SQL
        if corpus_pipeline.ORACLE_SQL:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
