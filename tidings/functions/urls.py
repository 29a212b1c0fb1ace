"""P10: turning an article's link into an absolute url."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def article_url(href: Column, page_url: Column, resolve: str = "append") -> Column:
    """No link: the page. Absolute: as is. Relative: appended to the page url, or resolved (``resolve='rfc'``)."""
    if resolve not in ("append", "rfc"):
        raise ValueError(f"unknown resolve mode {resolve!r}")
    based = F.when(page_url.endswith("/"), page_url).otherwise(F.concat(page_url, F.lit("/")))
    joined = F.concat(based, F.regexp_replace(href, "^/", ""))
    if resolve == "rfc":
        scheme = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*:)//", 1)
        origin = F.regexp_extract(page_url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
        path = F.regexp_replace(page_url, r"[?#].*$", "")
        folder = F.when(path == origin, F.concat(origin, F.lit("/"))).otherwise(
            F.regexp_replace(path, r"[^/]*$", "")
        )
        joined = (
            F.when(href == "", page_url)
            .when(href.startswith("//"), F.concat(scheme, href))
            .when(href.startswith("/"), F.concat(origin, href))
            .when(href.startswith("#"), F.concat(F.regexp_replace(page_url, r"#.*$", ""), href))
            .when(href.startswith("?"), F.concat(path, href))
            .otherwise(F.concat(folder, href))
        )
    return F.when(href.isNull(), page_url).when(href.startswith("http"), href).otherwise(joined)
