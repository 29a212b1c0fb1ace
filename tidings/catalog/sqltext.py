"""Shared pieces of the comparison SQL."""

from __future__ import annotations

TS = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"


def ts(expr: str) -> str:
    return TS.format(expr)


# Events as items, with the settings of their source.
EVENTS = """
ev AS (
  SELECT event_id, ts, user_id, event_type, value, props,
    CASE event_type WHEN 'click' THEN 'rss' WHEN 'error' THEN 'rss' WHEN 'purchase' THEN 'reddit'
      WHEN 'signup' THEN 'scrape' ELSE 'youtube' END AS source_type,
    event_type || '-' || CAST(user_id % 5 AS VARCHAR) AS source_name,
    CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 5 WHEN 'purchase' THEN 10 WHEN 'signup' THEN 15
      ELSE 20 END + user_id % 5 AS source_ord,
    CASE event_type WHEN 'click' THEN 3 WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 1
      ELSE 5 END AS days,
    CASE event_type WHEN 'click' THEN 20 WHEN 'error' THEN 20 WHEN 'purchase' THEN 50 WHEN 'signup' THEN 30
      ELSE 10 END AS cap,
    CAST(event_id AS VARCHAR) AS id,
    event_type || ' ' || CAST(event_id AS VARCHAR) AS title,
    'https://example.org/e/' || CAST(event_id AS VARCHAR) AS url,
    '{score=' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || ', kind=' || event_type || '}' AS metadata
  FROM events
)"""

RECENT = """
recent AS (
  SELECT * FROM ev WHERE CASE
    WHEN source_type IN ('rss', 'youtube') THEN
      ts >= TIMESTAMP '2024-01-15 00:00:00' - days * INTERVAL 1 DAY AND ts < TIMESTAMP '2024-01-15 00:00:00'
    WHEN source_type = 'reddit' THEN
      date_trunc('second', ts) >= TIMESTAMP '2024-01-15 12:00:00' - days * INTERVAL 1 DAY
    ELSE true END
)"""

DOCS = """
docs AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, split_part(text, chr(10), 1) AS title, text AS content,
    'https://docs.example.org/' || CAST(doc_id AS VARCHAR) AS url,
    DATE '2024-03-01' + CAST(doc_id % 10 AS INTEGER) AS publish_date,
    DATE '2024-03-02' + CAST(doc_id % 10 AS INTEGER) AS run_date,
    CASE doc_id % 4 WHEN 0 THEN 'rss' WHEN 1 THEN 'reddit' WHEN 2 THEN 'youtube' ELSE 'scrape' END AS source_type,
    source AS source_name, CAST(substring(source, 4) AS BIGINT) AS source_ord,
    CASE WHEN doc_id % 4 = 1 THEN doc_id % 100 ELSE 0 END AS score
  FROM documents
)"""
