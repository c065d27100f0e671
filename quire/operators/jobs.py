"""The job ledger: settings, current state, dashboard and notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import schemas
from quire.functions import fixed

ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss'Z'"
# Statuses that a job does not leave.
ENDED = ("completed", "failed", "cancelled")


def provider_registry(spark: SparkSession) -> DataFrame:
    """The six known providers."""
    return spark.createDataFrame(fixed.PROVIDERS, schemas.PROVIDERS)


def resolve_jobs(jobs: DataFrame, registry: DataFrame) -> DataFrame:
    """Full settings of each job from its partial JSON ``config``.

    JSON that cannot be read gives the default settings. The registry is a fixed
    table of six rows, so it is broadcast.
    """
    bad = "_unreadable"
    parsed = F.from_json(
        "config", f"{schemas.JOB_CONFIG}, {bad} string", {"columnNameOfCorruptRecord": bad}
    )
    read = jobs.withColumn("_c", parsed)
    usable = F.col("_c").isNotNull() & F.col(f"_c.{bad}").isNull() & F.col("_c.provider").isNotNull()

    def given(field: str, default: object = None) -> Column:
        value = F.when(usable, F.col(f"_c.{field}"))
        return value if default is None else F.coalesce(value, F.lit(default))

    language = F.lower(given("language", "th"))
    quality = F.lower(given("quality", "standard"))
    settings = read.select(
        "id",
        "filename",
        given("provider", fixed.FALLBACK_PROVIDER).alias("provider"),
        given("model").alias("_model"),
        F.when(language.isin("th", "en"), language).otherwise("th").alias("language"),
        F.when(quality.isin("standard", "high"), quality).otherwise("standard").alias("quality"),
        given("start_page").alias("start_page"),
        given("end_page").alias("end_page"),
        (given("table_extraction", False) & ~given("text_only", False)).alias("table_extraction"),
        given("text_only", False).alias("text_only"),
        given("storage", "local").alias("storage"),
        given("dpi").alias("_dpi"),
        given("notify", True).alias("notify"),
        given("enhance", False).alias("enhance"),
    )
    known = registry.select(F.col("name").alias("provider"), "default_model", "cost_per_image_usd")
    dpi = F.coalesce("_dpi", F.when(F.col("language") == "th", 200).otherwise(150))
    return (
        settings.join(F.broadcast(known), "provider", "left")
        .withColumns(
            {
                "model": F.coalesce("_model", "default_model", F.lit(fixed.FALLBACK_MODEL)),
                "dpi": F.when(F.col("quality") == "high", F.greatest(dpi, F.lit(300))).otherwise(dpi),
                "known_provider": F.col("default_model").isNotNull(),
            }
        )
        .drop("_model", "_dpi", "default_model")
    )


def latest_job_state(events: DataFrame) -> DataFrame:
    """Current row of each job from its log of updates.

    Every field keeps its last given value by ``seq``. All parts are aggregates that
    combine before the shuffle, so a job with very many updates stays cheap.
    """
    seq = F.col("seq")

    def last(value: Column) -> Column:
        return F.max_by(value, F.when(value.isNotNull(), seq))

    def last_time(*statuses: str) -> Column:
        hit = F.col("status").isin(*statuses)
        return F.max_by(F.when(hit, F.col("ts")), F.when(hit, seq))

    return ledger_row(events.groupBy("job_id").agg(
        last(F.col("status")).alias("status"),
        last(F.col("progress")).alias("progress"),
        last(F.col("result")).alias("result"),
        last(F.col("error")).alias("error"),
        F.min_by("ts", "seq").alias("created_at"),
        F.max_by("ts", "seq").alias("updated_at"),
        last_time("processing").alias("started_at"),
        last_time(*ENDED).alias("completed_at"),
    ))


def ledger_row(state: DataFrame) -> DataFrame:
    """A job's current row from the last value of each field: known statuses only, and its duration."""
    known = ["pending", "processing", *ENDED]
    return state.withColumns(
        {
            "status": F.when(F.col("status").isin(known), F.col("status")).otherwise("failed"),
            "duration_seconds": duration_seconds(F.col("started_at"), F.col("completed_at")),
        }
    )


def latest_settings(settings_log: DataFrame) -> DataFrame:
    """The one current settings row: the last one written."""
    fields = [c for c in settings_log.columns if c != "seq"]
    return settings_log.agg(F.max_by(F.struct(*fields), "seq").alias("s")).select("s.*")


def parse_iso(value: Column) -> Column:
    """Time of an ISO text with second precision; null when it cannot be read."""
    return F.try_to_timestamp(value, F.lit(ISO_SECONDS))


def duration_seconds(start: Column, end: Column) -> Column:
    """Seconds between two times, whole milliseconds, null if either is missing."""
    # The difference is taken as an interval, which clock changes do not affect.
    gap = end - start

    def part(unit: str) -> Column:
        return F.extract(F.lit(unit), gap)

    seconds = part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60
    millis = F.floor(part("SECOND").cast("double") * 1000)
    return seconds.cast("double") + millis.cast("double") / 1000.0


def job_dashboard(jobs: DataFrame) -> DataFrame:
    """Counts by status and mean duration, in one row."""
    return jobs.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "processing").alias("processing"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.avg("duration_seconds").alias("avg_duration"),
    )


def recent_jobs(jobs: DataFrame, k: int | None = 5) -> DataFrame:
    """Newest jobs first, at most ``k`` of them (None lists all)."""
    ordered = jobs.orderBy(F.desc("created_at"), F.asc("id"))
    return ordered if k is None else ordered.limit(k)


def notification_feed(
    jobs: DataFrame,
    enabled: bool = True,
    notify_on_complete: bool = True,
    notify_on_failure: bool = True,
    product: str = "quire",
) -> DataFrame:
    """Jobs to notify about, with the message text.

    ``product`` is the name in square brackets that opens a message.
    """
    wanted = [s for s, on in (("completed", notify_on_complete), ("failed", notify_on_failure)) if on]
    finished = jobs.where(
        F.lit(enabled) & F.coalesce("notify", F.lit(True)) & F.col("status").isin(wanted)
        if wanted
        else F.lit(False)
    )
    d = F.col("duration_seconds").cast("double")
    minutes = F.concat(
        F.floor(d / 60).cast("string"), F.lit("m "), F.floor(d % 60).cast("string"), F.lit("s")
    )
    short = F.concat(F.bround(d, 0).cast("long").cast("string"), F.lit("s"))
    duration = F.when(d.isNull(), "-").when(d < 60, short).otherwise(minutes)
    outcome = F.when(F.col("status") == "completed", "Completed").otherwise("Failed")
    message = F.concat_ws(
        "\n",
        F.concat(F.lit(f"[{product}] Job "), outcome),
        F.concat(F.lit("File: "), F.col("filename")),
        F.concat(F.lit("Duration: "), duration),
        F.concat(F.lit("Error: "), F.col("error")),
        F.concat(F.lit("Images: "), F.col("image_count").cast("string")),
    )
    return finished.select("id", "status", message.alias("message"))
