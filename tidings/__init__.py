"""tidings: a PySpark-native content-aggregation engine.

Landed payloads (feeds, listing pages, video searches, web pages) become one item table; recency rules, per-source
caps, enrichment, counts, announcement grouping and digests are DataFrame operators over it.
"""
