"""The source list, the prompt text, and the checks on them."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.functions.text import is_blank
from tidings.schemas import CONFIG, SOURCE_TYPES

# What a source gets when its entry leaves a field out, and the words the enums allow.
DEFAULT_MAX_RESULTS = 10
DEFAULT_TIME_RANGE_DAYS = 2
DEFAULT_CLIENT = "http"
CLIENTS = ("http", "playwright")
SORTS = ("hot", "new", "top", "rising", "controversial")


class ConfigFacts(NamedTuple):
    """Two numbers about the source list; they bound what may be broadcast and what a cap can keep."""

    sources: int
    max_cap: int


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """One multi-line JSON file; a missing or unreadable file fails the run."""
    config = spark.read.schema(CONFIG).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return sources_of(config)


def parse_config(texts: DataFrame, body: str = "body") -> DataFrame:
    """S1 over configuration texts held in a column; other columns are kept."""
    parsed = F.from_json(F.col(body), CONFIG, {"mode": "FAILFAST"})
    return sources_of(texts.withColumn("sources", parsed["sources"]).drop(body))


def sources_of(config: DataFrame) -> DataFrame:
    """One row per source in file order, defaults filled in; an unknown type or client aborts the query."""
    kept = [c for c in config.columns if c not in ("sources", "global", "llm")]
    rows = config.select(*kept, F.posexplode("sources").alias("source_ord", "s"))
    s = F.col("s")
    selectors_ok = s["selectors"].isNull() | (
        s["selectors"]["articles"].isNotNull() & s["selectors"]["title"].isNotNull() & s["selectors"]["content"].isNotNull()
    )
    client = F.coalesce(s["clientType"], F.lit(DEFAULT_CLIENT))
    readable = (
        s["name"].isNotNull() & F.coalesce(s["type"].isin(*SOURCE_TYPES), F.lit(False))
        & client.isin(*CLIENTS) & selectors_ok
    )
    complaint = F.concat(F.lit("invalid source entry: "), F.to_json(s))
    return rows.select(
        *kept,
        "source_ord",
        s["name"].alias("source_name"),
        F.when(readable, s["type"]).otherwise(F.raise_error(complaint)).alias("source_type"),
        s["url"].alias("url"),
        s["channelId"].alias("channel_id"),
        s["channelHandle"].alias("channel_handle"),
        s["subreddit"].alias("subreddit"),
        sort_key(s["sortBy"]).alias("sort_by"),
        client.alias("client_type"),
        F.coalesce(s["maxResults"], F.lit(DEFAULT_MAX_RESULTS)).alias("max_results"),
        F.coalesce(s["timeRangeDays"], F.lit(DEFAULT_TIME_RANGE_DAYS)).alias("time_range_days"),
        s["selectors"].alias("selectors"),
    )


def config_facts(sources: DataFrame) -> ConfigFacts:
    """One small aggregate over the configuration (never over payloads)."""
    row = sources.agg(F.count("*").alias("n"), F.max("max_results").alias("cap")).first()
    return ConfigFacts(row["n"], row["cap"] or 0)


def read_prompt(spark: SparkSession, path: str) -> DataFrame:
    """The whole prompt file as one row; a missing file fails the run."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("prompt"))


def sort_key(sort_by: Column) -> Column:
    """one of the five listing orders in any case; everything else means ``new``."""
    lowered = F.lower(sort_by)
    return F.when(lowered.isin(*SORTS), lowered).otherwise(F.lit("new"))


# Runs of simple selectors, set apart by blanks, commas and ``>``: what ``functions.html`` can match.
_SELECTOR = r"""(?U)^(?:[\s,>]|\.[\w-]+|#[\w-]+|\[[\w-]+(?:=["']?[^"'\]\s,>]*["']?)?\]|[\w-]+|\*)*$"""


def unreadable_selectors() -> Column:
    """Whether one of a source's selectors is beyond the supported ones."""
    given = [F.col("selectors")[name] for name in ("articles", "title", "content", "date")]
    return ~reduce(Column.__and__, [F.coalesce(s.rlike(_SELECTOR), F.lit(True)) for s in given])


def source_fault() -> Column:
    """why a source cannot be read, or null. A blank required field counts as missing."""
    kind = F.col("source_type")
    return (
        F.when((kind == "rss") & is_blank(F.col("url")), "feed without a url")
        .when((kind == "reddit") & is_blank(F.col("subreddit")), "listing without a subreddit")
        .when((kind == "scrape") & is_blank(F.col("url")), "page without a url")
        .when((kind == "scrape") & F.col("selectors").isNull(), "page without selectors")
        .when((kind == "scrape") & unreadable_selectors(), "unsupported selector")
    )


def split_sources(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """the sources that can be read, and an error row for each that cannot."""
    checked = sources.withColumn("_fault", source_fault())
    errors = checked.filter("_fault is not null").select(
        "source_name", F.lit("config").alias("stage"), F.col("_fault").alias("reason"),
        F.lit(None).cast("string").alias("body_sha"),
    )
    return checked.filter("_fault is null").drop("_fault"), errors
