"""Text derivations of an item (previews, source line, ids, metadata text, keys)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidings.functions.dates import local_time

# Fixed value: the characters the item producers count as blank (controls 9-13 and 28-31, all Unicode separators).
NOT_BLANK = r"[^\t-\r\x1c-\x1f\p{Z}]"

NO_CONTENT = "[No content]"
PREVIEW_LENGTH = 200


def is_blank(text: Column) -> Column:
    """True for null, empty and whitespace-only text."""
    return ~F.coalesce(text.rlike(NOT_BLANK), F.lit(False))


def preview(content: Column, length: int = PREVIEW_LENGTH) -> Column:
    """The content if it has at most ``length`` UTF-16 units, else its first ``length`` units and an ellipsis."""
    head = F.left(content, F.lit(length + 1))
    encoded = F.encode(head, "UTF-16BE")
    units = F.octet_length(encoded) / 2
    # A character of two units cut in half is printed as a question mark.
    halved = F.hex(F.substring(encoded, 2 * length - 1, 1)).between("D8", "DB")
    whole = F.when(halved, 2 * length - 2).otherwise(2 * length)
    cut = F.concat(
        F.decode(F.substring(encoded, F.lit(1), whole), "UTF-16BE"), F.when(halved, F.lit("?")).otherwise(F.lit(""))
    )
    return (
        F.when(units <= length, content)
        .when(units == F.length(head), F.concat(F.left(content, F.lit(length)), F.lit("...")))
        .otherwise(F.concat(cut, F.lit("...")))
    )


def source_line(source: Column, author: Column, date: Column, zone: Column) -> Column:
    """``From <source> by <author> on <local date>``; missing parts leave their spaces."""
    by = F.coalesce(F.concat(F.lit("by "), author), F.lit(""))
    on = F.coalesce(F.concat(F.lit("on "), F.date_format(local_time(date, zone), "yyyy-MM-dd")), F.lit(""))
    return F.concat(F.lit("From "), source, F.lit(" "), by, F.lit(" "), on)


def article_id(source: Column, position: Column) -> Column:
    """Source name in lower case with dashes, then the article's position."""
    return F.concat(F.replace(F.lower(source), F.lit(" "), F.lit("-")), F.lit("-"), position.cast("string"))


def metadata_text(metadata: Column) -> Column:
    """``{k=v, k2=v2}`` in the order the keys were put in."""
    pairs = F.transform(F.map_entries(metadata), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", " ")


def title_key(title: Column) -> Column:
    """The title without case, punctuation and outer blanks."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", " "))


def words(text: Column, least: int = 3) -> Column:
    """Lower-case runs of letters and digits of at least ``least`` characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]{%d,}" % least), F.lit(0))
