"""Web pages to articles, one Arrow batch of pages at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.functions import html
from tidings.functions.text import is_blank
from tidings.session import ship_package

# Where an article may name its author, in the order they are tried.
AUTHOR_SELECTORS = (".author", "[rel=author]", ".byline", ".meta-author")

FOUND = ("item_pos int, title string, content string, href string, date_text string, "
         + ", ".join(f"author_{i} string" for i in range(len(AUTHOR_SELECTORS))))


def read_articles(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row per article of every page, the first ``max_results`` of each page (L2 cuts before any filter).

    ``pages`` has the page text, a ``selectors`` struct, ``max_results``, and any columns to keep. Pages are parsed
    where their file split lies.
    """
    ship_package(pages.sparkSession)
    kept = [f for f in pages.schema.fields if f.name not in (body, "selectors")]
    source = pages.select(
        *[f.name for f in kept],
        F.col(body).alias("_html"),
        *[F.col(f"selectors.{s}").alias(f"_{s}") for s in ("articles", "title", "content", "date")],
    )
    schema = T.StructType(kept + T.StructType.fromDDL(FOUND).fields)
    names = [f.name for f in kept]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                tuple(page[n] for n in names) + article
                for page in batch.to_dict("records")
                for article in _articles(page)
            ]
            if rows:
                yield pd.DataFrame(rows, columns=schema.names)

    return source.mapInPandas(scan, schema)


def _articles(page: dict) -> Iterator[tuple]:
    found = html.select(html.parse(page["_html"]), page["_articles"])
    for position, article in enumerate(found[: page["max_results"]]):
        links = html.select(article, "a")
        authors = (html.select(article, s)[:1] for s in AUTHOR_SELECTORS)
        dated = page["_date"] and page["_date"].strip()
        yield (
            position,
            html.text_of(html.select(article, page["_title"])),
            html.text_of(html.select(article, page["_content"])),
            links[0].attrs.get("href", "") if links else None,
            html.text_of(html.select(article, page["_date"])) if dated else None,
            *[a[0].text() if a else None for a in authors],
        )


def page_errors(pages: DataFrame, body: str = "body") -> DataFrame:
    """An error row for each page without a body. Selectors are checked with the source list."""
    return pages.filter(F.col(body).isNull()).select(
        "source_name", F.lit("page").alias("stage"), F.lit("unreadable page").alias("reason"),
        F.lit(None).cast("string").alias("body_sha"),
    )


def first_author() -> Column:
    """The first place with a non-blank name."""
    places = [F.col(f"author_{i}") for i in range(len(AUTHOR_SELECTORS))]
    return F.coalesce(*[F.when(~is_blank(p), p) for p in places])
