"""Incremental runs (T1-T3) over the event files as they would land."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.catalog import query
from tidings.catalog.payloads import POST_METADATA
from tidings.catalog.sqltext import EVENTS, ts
from tidings.functions.text import metadata_text
from tidings.operators.normalize import post_items
from tidings.plans import adapters as A
from tidings.session import new_table_path
from tidings.sources.listing import read_listing
from tidings.streaming.ingest import daily_counts, drop_refetched, landed_stream, read_run, run_available


def _landed_events(spark, sf_dir):
    return landed_stream(spark, sf_dir, A.EVENTS, "parquet", glob="events.parquet")


def _as_items(rows):
    return rows.select(
        F.col("event_id").cast("string").alias("id"),
        F.concat("event_type", F.lit("-"), (F.col("user_id") % A.SOURCES_PER_TYPE).cast("string")).alias("source_name"),
        A.by_value(F.col("event_type"), A.TYPE_OF).alias("source_type"),
        F.col("ts").alias("publish_date"),
    )


@query("t1_incremental_ingest", f"""
WITH {EVENTS}
SELECT id, CASE event_id % 5 WHEN 0 THEN '[No content]' WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE props END AS content,
  {ts("date_trunc('second', ts)")} AS published, {POST_METADATA.format()} AS metadata
FROM ev WHERE source_type = 'reddit' AND date_trunc('second', ts) >= TIMESTAMP '2024-01-13 12:00:00'
""")
def t1_incremental_ingest(spark, sf_dir):
    """Listing pages land in two deliveries; each run takes only what is new, with the same scan as the batch."""
    rows = A.events(spark, sf_dir).filter("source_type = 'reddit'")
    payloads = A.listing_payloads(rows).withColumn("fetched_at", A.as_of()).drop("source_type")
    landing = new_table_path(spark, "landing")
    schema = "source_name string, source_ord int, page_no long, body string, fetched_at timestamp"

    def items():
        stream = landed_stream(spark, landing, schema)
        cutoff = F.unix_seconds("fetched_at") - A.DAYS_OF["reddit"] * 86400
        posts = read_listing(stream).filter(F.col("created").cast("long") >= cutoff).withColumns({
            "subreddit": F.col("source_name"), "as_of": F.col("fetched_at"), "run_date": F.to_date("fetched_at"),
        })
        return post_items(posts, "direct")

    output, progress = new_table_path(spark, "ingested"), new_table_path(spark, "ingested-progress")
    for late in (0, 1):
        payloads.filter(F.col("page_no") % 2 == late).write.mode("append").json(landing)
        run_available(items(), "ingested", output, progress)
    done = read_run(spark, output, items())
    return done.select(
        "id", "content", A.ts_text(F.col("publish_date")).alias("published"), metadata_text(F.col("metadata")).alias("metadata")
    )


@query("t2_refetch_dedup", f"WITH {EVENTS} SELECT source_name, id, {ts('ts')} AS published FROM ev")
def t2_refetch_dedup(spark, sf_dir):
    """Every item is fetched twice, those of one source twelve times; one is kept."""
    items = _as_items(_landed_events(spark, sf_dir))
    times = F.when(F.col("source_name") == "view-0", 12).otherwise(2)
    fetched = items.withColumn("fetch", F.explode(F.sequence(F.lit(1), times)))
    fetched = fetched.withColumn("fetched_at", A.as_of() + F.make_interval(mins=F.col("fetch")))
    kept = drop_refetched(fetched, "2 days", spread=["fetch"]).drop("fetch", "fetched_at")
    _, path = run_available(kept, "deduplicated")
    done = read_run(spark, path, kept)
    return done.select("source_name", "id", A.ts_text(F.col("publish_date")).alias("published"))


@query("t2_late_new_items", f"WITH {EVENTS} SELECT source_name, id, {ts('ts')} AS published FROM ev")
def t2_late_new_items(spark, sf_dir):
    """Three daily fetches, each with items of all ages that were never seen and with all that the fetch before it had."""
    items = _as_items(A.events(spark, sf_dir)).withColumn("third", F.pmod(F.col("id").cast("long"), F.lit(3)))
    landing, output, progress = (new_table_path(spark, f"late{name}") for name in ("", "-kept", "-progress"))
    schema = "id string, source_name string, source_type string, publish_date timestamp, third long, fetched_at timestamp"
    for day in range(3):
        fetched = items.filter(F.col("third").isin(day, day - 1)).withColumn("fetched_at", A.as_of() + F.make_interval(days=F.lit(day)))
        fetched.write.mode("append").parquet(landing)
        kept = drop_refetched(landed_stream(spark, landing, schema, "parquet"), "2 days")
        run_available(kept, "late", output, progress)
    return read_run(spark, output, kept).select("source_name", "id", A.ts_text(F.col("publish_date")).alias("published"))


@query("t3_daily_counts", f"""
WITH {EVENTS}
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, source_type, count(*) AS items FROM ev
WHERE CAST(ts AS DATE) + 1 <= (SELECT max(date_trunc('millisecond', ts)) - INTERVAL 12 HOUR FROM events)
GROUP BY 1, 2
""")
def t3_daily_counts(spark, sf_dir):
    """Counts of the days that are over for at least the delay."""
    counted = daily_counts(_as_items(_landed_events(spark, sf_dir)), "12 hours")
    _, path = run_available(counted, "daily-counts")
    done = read_run(spark, path, counted)
    return done.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "source_type", "items")
