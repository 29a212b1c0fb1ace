"""Recency, caps, paging, counts and prompts over event items (F, L, A, M, K4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.catalog import query
from tidings.catalog.sqltext import EVENTS, RECENT, ts
from tidings.functions.text import metadata_text, source_line
from tidings.operators import counts, limits, paging, prompt, recency
from tidings.operators.enrich import add_transcripts
from tidings.operators.model import call_model_once, transcribe
from tidings.operators.ordered import top_per_group
from tidings.operators.union import dispatch, union_items
from tidings.plans import adapters as A
from tidings.session import through_table
from tidings.sources.listing import read_pages


def kind():
    return F.col("source_type")


def date():
    return F.col("publish_date")


def run_time():
    return F.col("as_of")



def recent_items(spark, sf_dir):
    items = A.event_items(spark, sf_dir)
    return items.filter(recency.is_recent(kind(), date(), run_time(), F.col("time_range_days")))


def capped_items(spark, sf_dir):
    return limits.cap_per_source(recent_items(spark, sf_dir), A.MAX_CAP)


CAPPED = RECENT + """,
capped AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_ord ORDER BY event_id) AS rn FROM recent)
  WHERE rn <= cap
)"""


@query("recency_cap_rollup", f"""
WITH {EVENTS}, {CAPPED}
SELECT source_type, source_name, CAST(GROUPING(source_type, source_name) AS BIGINT) AS level, count(*) AS items
FROM capped GROUP BY GROUPING SETS ((source_type, source_name), (source_type), ())
""")
def recency_cap_rollup(spark, sf_dir):
    """How many items per type and source are recent, at most each source's cap."""
    totals = counts.item_counts(capped_items(spark, sf_dir))
    return totals.withColumn("level", F.col("level").cast("long"))


@query("f1_calendar_window", f"""
WITH {EVENTS}
SELECT id, source_name, {ts('ts')} AS published FROM ev
WHERE source_type IN ('rss', 'youtube')
  AND ts >= TIMESTAMP '2024-01-15 00:00:00' - days * INTERVAL 1 DAY AND ts < TIMESTAMP '2024-01-15 00:00:00'
""")
def f1_calendar_window(spark, sf_dir):
    items = A.event_items(spark, sf_dir).filter(kind().isin("rss", "youtube"))
    most = max(A.DAYS_OF.values())
    inside = recency.in_calendar_days(date(), run_time(), F.col("time_range_days"), most_days=most)
    return items.filter(inside).select("id", "source_name", A.ts_text(date()).alias("published"))


@query("f1_backfill_days", """
SELECT strftime(CAST(o_orderdate AS DATE) + k, '%Y-%m-%d') AS run_date, o_orderpriority AS source_name,
  count(*) AS items
FROM orders, (SELECT unnest([1, 2, 3]) AS k) GROUP BY 1, 2
""")
def f1_backfill_days(spark, sf_dir):
    """Counts per run day and source for every day at once, three days back each."""
    orders = A.table(spark, sf_dir, "orders", A.ORDERS)
    runs = recency.run_days(orders, 3, "o_orderdate")
    return runs.groupBy(F.date_format("run_date", "yyyy-MM-dd").alias("run_date"),
                        F.col("o_orderpriority").alias("source_name")).agg(F.count("*").alias("items"))


@query("f2_rolling_cutoff", f"""
WITH {EVENTS}
SELECT id, source_name, {ts('ts')} AS published FROM ev
WHERE source_type = 'reddit' AND date_trunc('second', ts) >= TIMESTAMP '2024-01-13 12:00:00'
""")
def f2_rolling_cutoff(spark, sf_dir):
    items = A.event_items(spark, sf_dir).filter(kind() == "reddit")
    kept = items.filter(recency.since_cutoff(date(), run_time(), F.col("time_range_days")))
    return kept.select("id", "source_name", A.ts_text(date()).alias("published"))


@query("f3_unknown_dates", f"""
WITH {EVENTS}, undated AS (SELECT * REPLACE (CASE WHEN event_id % 7 <> 0 THEN ts END AS ts) FROM ev)
SELECT source_type, count(*) AS kept, CAST(count(*) FILTER (WHERE ts IS NULL) AS BIGINT) AS kept_undated
FROM undated WHERE CASE
  WHEN source_type IN ('rss', 'youtube') THEN coalesce(
    ts >= TIMESTAMP '2024-01-15 00:00:00' - days * INTERVAL 1 DAY AND ts < TIMESTAMP '2024-01-15 00:00:00', false)
  WHEN source_type = 'reddit' THEN
    coalesce(date_trunc('second', ts) >= TIMESTAMP '2024-01-15 12:00:00' - days * INTERVAL 1 DAY, true)
  ELSE true END
GROUP BY 1
""")
def f3_unknown_dates(spark, sf_dir):
    items = A.event_items(spark, sf_dir).withColumn("publish_date", F.when(F.expr("cast(id as long) % 7") != 0, date()))
    kept = items.filter(recency.is_recent(kind(), date(), run_time(), F.col("time_range_days")))
    return kept.groupBy("source_type").agg(
        F.count("*").alias("kept"), F.count_if(date().isNull()).alias("kept_undated")
    )


@query("l1_source_cap", f"WITH {EVENTS}, {CAPPED} SELECT source_name, id, cap AS max_results FROM capped")
def l1_source_cap(spark, sf_dir):
    return capped_items(spark, sf_dir).select("source_name", "id", "max_results")


@query("l1_cap_large_table", """
SELECT l_suppkey AS source, l_orderkey, CAST(l_linenumber AS BIGINT) AS line FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem
) WHERE rn <= 5
""")
def l1_cap_large_table(spark, sf_dir):
    """The first five lines of each supplier, in order: the same cap over the widest table."""
    lines = A.table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    order = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    kept = top_per_group(lines, ["l_suppkey"], order, 5, 5, ["l_orderkey"])
    return kept.select(F.col("l_suppkey").alias("source"), "l_orderkey", F.col("l_linenumber").cast("long").alias("line"))


@query("l3_video_overfetch", f"""
WITH {EVENTS}, newest AS (
  SELECT *, row_number() OVER (PARTITION BY source_ord ORDER BY ts DESC, event_id) AS seen
  FROM (SELECT * REPLACE (ts - (source_ord % 5) * INTERVAL 1 DAY AS ts) FROM ev WHERE source_type = 'youtube')
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY source_ord ORDER BY ts DESC, event_id) AS rn FROM newest
  WHERE seen <= greatest(2 * cap, 50)
    AND ts >= TIMESTAMP '2024-01-30 00:00:00' - days * INTERVAL 1 DAY AND ts < TIMESTAMP '2024-01-30 00:00:00'
)
SELECT source_name, id FROM kept WHERE rn <= cap
""")
def l3_video_overfetch(spark, sf_dir):
    """Each source's clock is a number of days behind, so that their newest videos fall on both sides of the window."""
    items = A.event_items(spark, sf_dir, A.LATE_AS_OF).filter(kind() == "youtube")
    behind = F.make_dt_interval(F.col("source_ord") % A.SOURCES_PER_TYPE)
    items = items.withColumn("publish_date", date() - behind)
    return limits.recent_videos(items, A.MAX_CAP).select("source_name", "id")


def _listing_pages(spark, sf_dir):
    rows = A.events(spark, sf_dir)
    pages = read_pages(A.bound(A.listing_payloads(rows)))
    cutoff = F.unix_seconds(run_time()) - F.col("time_range_days") * recency.SECONDS_PER_DAY
    fresh = F.filter("children", lambda c: c["data"]["created"].cast("long") >= cutoff)
    return pages.select(
        "run_date", "source_ord", "source_name", "page_no", "max_results", "after",
        F.size("children").alias("size"), F.size(fresh).alias("valid"),
    )


PAGES = """
pages_of AS (
  SELECT source_ord, source_name, cap, event_id // 125 AS page_no, count(*) AS size,
    count(*) FILTER (WHERE date_trunc('second', ts) >= TIMESTAMP '2024-01-15 12:00:00' - days * INTERVAL 1 DAY) AS valid,
    (event_id // 125) % 17 = 16 AS ended
  FROM ev GROUP BY ALL
)"""


@query("l4a_pages_until_enough", f"""
WITH {EVENTS}, {PAGES}, counted AS (
  SELECT *, coalesce(sum(valid) OVER (PARTITION BY source_ord ORDER BY page_no
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM pages_of)
SELECT source_name, page_no, CAST(valid AS BIGINT) AS valid, CAST(seen AS BIGINT) AS seen FROM counted WHERE seen < cap
""")
def l4a_pages_until_enough(spark, sf_dir):
    """The narrow page rows are read twice, the payloads behind them once."""
    kept = paging.pages_until_enough(through_table(_listing_pages(spark, sf_dir), "page-sizes"))
    return kept.select("source_name", "page_no", F.col("valid").cast("long").alias("valid"), "seen")


def _until_end_sql(keep_last: bool) -> str:
    return f"""
WITH {EVENTS}, {PAGES}, counted AS (
  SELECT *, coalesce(sum(size) OVER before, 0) AS seen, coalesce(max(CAST(ended AS INT)) OVER before, 0) AS done
  FROM pages_of
  WINDOW before AS (PARTITION BY source_ord ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT source_name, page_no, CAST(seen AS BIGINT) AS seen FROM counted
WHERE seen < cap AND done = 0 {'' if keep_last else 'AND NOT ended'}
"""


@query("l4b_pages_until_end", _until_end_sql(True))
def l4b_pages_until_end(spark, sf_dir):
    return paging.pages_until_end(_listing_pages(spark, sf_dir), A.MAX_CAP).select("source_name", "page_no", "seen")


@query("l4b_last_page_dropped", _until_end_sql(False))
def l4b_last_page_dropped(spark, sf_dir):
    kept = paging.pages_until_end(_listing_pages(spark, sf_dir), A.MAX_CAP, keep_last_page=False)
    return kept.select("source_name", "page_no", "seen")


@query("l5_listing_order", f"""
WITH {EVENTS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_ord ORDER BY floor(value) DESC, event_id) AS best,
    row_number() OVER (PARTITION BY source_ord ORDER BY ts DESC, event_id) AS newest
  FROM ev WHERE source_type = 'reddit')
SELECT 'top' AS sort_by, source_name, id, best AS place FROM ranked WHERE best <= 25
UNION ALL SELECT 'new', source_name, id, newest FROM ranked WHERE newest <= 25
UNION ALL SELECT 'hot', source_name, id, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY source_ord ORDER BY event_id) AS rn FROM ev WHERE source_type = 'reddit'
) WHERE rn <= 25
""")
def l5_listing_order(spark, sf_dir):
    """The first page of each listing in three orders."""
    posts = A.event_items(spark, sf_dir).filter(kind() == "reddit").withColumn(
        "score", F.expr("cast(metadata['score'] as long)")
    )
    pages = [
        top_per_group(posts, ["source_ord"], limits.listing_order(s), 25, 25, ["page_no", "item_pos"], "place")
        .select(F.lit(s).alias("sort_by"), "source_name", "id", F.col("place").cast("long").alias("place"))
        for s in ("top", "new", "hot")
    ]
    return pages[0].unionByName(pages[1]).unionByName(pages[2])


@query("p8_source_lines", f"""
WITH {EVENTS}
SELECT id, 'From ' || source_name || ' ' || CASE WHEN event_id % 3 = 0 THEN '' ELSE 'by ' || CAST(user_id AS VARCHAR) END
  || ' ' || CASE WHEN event_id % 4 = 0 THEN '' ELSE 'on ' || strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%d') END AS line
FROM ev
""")
def p8_source_lines(spark, sf_dir):
    number = F.expr("cast(id as long)")
    line = source_line(
        F.col("source_name"), F.when(number % 3 != 0, F.col("author")), F.when(number % 4 != 0, date()), F.lit("+01:30")
    )
    return A.event_items(spark, sf_dir).select("id", line.alias("line"))


@query("u1_dispatch_union", f"""
WITH {EVENTS}
SELECT id, source_ord, source_type, CASE source_type WHEN 'rss' THEN upper(title) WHEN 'reddit' THEN '[' || title || ']'
  ELSE title END AS title
FROM ev WHERE source_type <> 'youtube' OR event_id % 2 = 0
""")
def u1_dispatch_union(spark, sf_dir):
    """Each type through its own branch, then one union in source order."""
    branches = {
        "rss": lambda df: df.withColumn("title", F.upper("title")),
        "reddit": lambda df: df.withColumn("title", F.concat(F.lit("["), "title", F.lit("]"))),
        "youtube": lambda df: df.filter(F.expr("cast(id as long) % 2 = 0")),
        "scrape": lambda df: df,
    }
    merged = dispatch(A.event_items(spark, sf_dir), branches)
    return merged.select("id", F.col("source_ord").cast("long").alias("source_ord"), "source_type", "title")


@query("u2_union_all_sources", f"""
WITH {EVENTS}, {CAPPED}, two AS (SELECT * FROM capped UNION ALL SELECT * FROM capped)
SELECT source_name, count(*) AS items, count(DISTINCT id) AS ids FROM two GROUP BY 1
""")
def u2_union_all_sources(spark, sf_dir):
    """A union keeps every row of every branch, also equal ones."""
    items = capped_items(spark, sf_dir)
    merged = union_items(items, items)
    per_id = merged.groupBy("source_name", "id").agg(F.count("*").alias("n"))
    return per_id.groupBy("source_name").agg(F.sum("n").alias("items"), F.count("*").alias("ids"))


@query("a1_type_source_counts", f"""
WITH {EVENTS}
SELECT strftime(CAST(ts AS DATE) + 1, '%Y-%m-%d') AS run_date, source_type, source_name,
  CAST(GROUPING(source_type, source_name) AS BIGINT) AS level, count(*) AS items
FROM ev GROUP BY GROUPING SETS ((CAST(ts AS DATE), source_type, source_name), (CAST(ts AS DATE), source_type), (CAST(ts AS DATE)))
""")
def a1_type_source_counts(spark, sf_dir):
    """A1-A3 for every run day in one pass."""
    items = A.daily_items(A.event_items(spark, sf_dir))
    totals = counts.item_counts(items, ["run_date"])
    return totals.select(
        F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), "source_type", "source_name",
        F.col("level").cast("long").alias("level"), "items",
    )


@query("a3_run_totals", f"""
WITH {EVENTS}, {CAPPED}
SELECT (SELECT count(DISTINCT source_ord) FROM ev) AS sources, count(DISTINCT source_ord) AS sources_with_items,
  count(*) AS items FROM capped WHERE source_type <> 'scrape'
""")
def a3_run_totals(spark, sf_dir):
    sources = A.events(spark, sf_dir).groupBy("source_ord").count()
    items = capped_items(spark, sf_dir).filter(kind() != "scrape")
    return counts.run_totals(sources, items)


@query("a4_stage_counts", f"""
WITH {EVENTS}
SELECT source_type, source_name, count(*) AS read,
  count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' - days * INTERVAL 1 DAY
    AND ts < TIMESTAMP '2024-01-15 00:00:00') AS in_window,
  count(*) FILTER (WHERE event_id % 3 = 0) AS transcribed
FROM ev WHERE source_type IN ('rss', 'youtube') GROUP BY 1, 2
""")
def a4_stage_counts(spark, sf_dir):
    items = A.event_items(spark, sf_dir).filter(kind().isin("rss", "youtube"))
    return counts.stage_counts(items, {
        "in_window": recency.in_calendar_days(date(), run_time(), F.col("time_range_days")),
        "transcribed": F.expr("cast(id as long) % 3 = 0"),
    })


BLOCK = """'Title: ' || title || chr(10) || 'Source: ' || source_name || chr(10) || 'Source Url: ' || url || chr(10)
  || 'Content: ' || props || chr(10) || 'Metadata: ' || metadata"""
PROMPT = "Summarize the following items."

BATCHES = f"""
blocks AS (SELECT CAST(ts AS DATE) + 1 AS run_date, source_ord, event_id, {BLOCK} AS block FROM ev),
placed AS (
  SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY run_date ORDER BY source_ord, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM blocks),
batches AS (
  SELECT run_date, CAST(start // 20000 AS BIGINT) AS part, count(*) AS items,
    '{PROMPT}' || chr(10) || chr(10) || string_agg(block, chr(10) || chr(10) ORDER BY source_ord, event_id) AS prompt
  FROM placed GROUP BY 1, 2)"""


def _batches(spark, sf_dir):
    return prompt.batch_prompts(A.daily_items(A.event_items(spark, sf_dir)), F.lit(PROMPT), 20000)


@query("m1_batch_prompts", f"""
WITH {EVENTS}, {BATCHES}
SELECT strftime(run_date, '%Y-%m-%d') AS run_date, part, items, length(prompt) AS chars, md5(prompt) AS digest FROM batches
""")
def m1_batch_prompts(spark, sf_dir):
    """All items of every day in source order, in parts of about 20,000 characters."""
    return _batches(spark, sf_dir).select(
        F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), "part", "items",
        F.length("prompt").cast("long").alias("chars"), F.md5("prompt").alias("digest"),
    )


@query("m2_single_prompts", f"""
WITH {EVENTS}
SELECT id, '{PROMPT}' || chr(10) || chr(10) || 'Title: ' || title || chr(10) || 'Source: ' || source_name || chr(10)
  || 'Content: ' || props || chr(10) || 'Metadata: ' || metadata AS prompt FROM ev
""")
def m2_single_prompts(spark, sf_dir):
    return prompt.single_prompts(A.event_items(spark, sf_dir), F.lit(PROMPT)).select("id", "prompt")


def stub_model(text: str) -> str | None:
    """Stands in for a model: the number of items, nothing for some, an error for others."""
    items = text.count("Title: ")
    if items % 5 == 0:
        return None
    if items % 7 == 0:
        raise ValueError("boom")
    return f"{items} items in {len(text)} characters"


@query("m3_model_replies", f"""
WITH {EVENTS}, {BATCHES}
SELECT strftime(run_date, '%Y-%m-%d') AS run_date, part,
  CASE WHEN items % 5 = 0 OR items % 7 = 0 THEN 'failed' ELSE 'ok' END AS status,
  CASE WHEN items % 5 <> 0 AND items % 7 = 0 THEN 'boom' END AS error,
  CASE WHEN items % 5 = 0 THEN 'Failed to generate summary.'
    WHEN items % 7 = 0 THEN 'Error generating summary: boom'
    ELSE CAST(items AS VARCHAR) || ' items in ' || CAST(length(prompt) AS VARCHAR) || ' characters' END AS reply
FROM batches
""")
def m3_model_replies(spark, sf_dir):
    requests = _batches(spark, sf_dir).select("run_date", "part", "prompt")
    replies = call_model_once(requests, "prompt", stub_model)
    return replies.select(
        F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), "part", "status", "error",
        F.substring_index("reply", "\n", 1).alias("reply"),
    )


@query("m4_transcripts", f"""
WITH {EVENTS}, {CAPPED}
SELECT url, 'spoken ' || id AS transcript, 'ok' AS status FROM capped WHERE source_type = 'youtube'
""")
def m4_transcripts(spark, sf_dir):
    """Transcripts are asked for after the cap, once per url."""
    videos = capped_items(spark, sf_dir).filter(kind() == "youtube")
    return transcribe(videos, lambda text: "spoken " + text.rsplit("/", 1)[-1])


@query("j3_transcript_enrichment", f"""
WITH {EVENTS}
SELECT id, CASE WHEN event_id % 3 = 0 THEN left(metadata, length(metadata) - 1) || ', transcription=text of ' || id || '}}'
  ELSE metadata END AS metadata
FROM ev WHERE source_type = 'youtube'
""")
def j3_transcript_enrichment(spark, sf_dir):
    videos = A.event_items(spark, sf_dir).filter(kind() == "youtube")
    transcripts = videos.filter(F.expr("cast(id as long) % 3 = 0")).select(
        "url", F.concat(F.lit("text of "), "id").alias("transcript")
    )
    return add_transcripts(videos, transcripts).select("id", metadata_text(F.col("metadata")).alias("metadata"))


@query("f7_empty_days", f"""
WITH {EVENTS}, days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders
  UNION SELECT DISTINCT CAST(ts AS DATE) FROM events),
replies AS (SELECT CAST(ts AS DATE) AS d, CAST(count(*) AS VARCHAR) || ' items' AS reply FROM ev GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d') AS run_date, coalesce(reply, 'No content to summarize.') AS reply
FROM days LEFT JOIN replies USING (d)
""")
def f7_empty_days(spark, sf_dir):
    orders = A.table(spark, sf_dir, "orders", A.ORDERS).select(F.to_date("o_orderdate").alias("run_date"))
    items = A.event_items(spark, sf_dir).select(F.to_date(date()).alias("run_date"))
    days = orders.distinct().unionByName(items.distinct()).distinct()
    replies = items.groupBy("run_date").agg(F.concat(F.count("*").cast("string"), F.lit(" items")).alias("reply"))
    return prompt.replies_or_empty(days, replies).select(
        F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), "reply"
    )


@query("k4_previews", f"""
WITH {EVENTS}
SELECT strftime(CAST(ts AS DATE) + 1, '%Y-%m-%d') AS run_date,
  row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY source_ord, event_id) AS item_no,
  title, source_name AS source, url, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS score, props AS content,
  'score: ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || chr(10) || 'kind: ' || event_type AS metadata
FROM ev
""")
def k4_previews(spark, sf_dir):
    shown = prompt.previews(A.daily_items(A.event_items(spark, sf_dir)))
    return shown.withColumn("run_date", F.date_format("run_date", "yyyy-MM-dd"))
