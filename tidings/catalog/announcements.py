"""What a digest is made of, over document items."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidings.catalog import query
from tidings.catalog.sqltext import DOCS
from tidings.operators import callouts, grouping, render, themes
from tidings.operators.callouts import Rule
from tidings.operators.enrich import add_transcripts, basis
from tidings.plans import adapters as A

# The documents are invented prose, so the rules are words that occur in it.
RULES = (
    Rule("product", "tion of"), Rule("product", "licen[sc]e", 0.5), Rule("product", "hand the", 0.5),
    Rule("research", "ci.n"), Rule("research", "schl"), Rule("research", "ouont(h|n)"),
    Rule("promo", "[0-9]+%"), Rule("promo", "@"),
)


def _hits(category: str) -> str:
    hits = [f"CASE WHEN regexp_matches(judged, '{r.pattern}') THEN {r.weight} ELSE 0.0 END" for r in RULES
            if r.category == category]
    return f"CAST({' + '.join(hits)} AS DOUBLE) AS {category}_score"


SCORED = f"""{DOCS},
judged AS (SELECT *, lower(regexp_replace(concat_ws(' ', title, content), '<[^>]*>', ' ', 'g')) AS judged FROM docs),
scored AS (SELECT * EXCLUDE (judged), {', '.join(_hits(c) for c in callouts.CATEGORIES)} FROM judged),
called AS (
  SELECT *, 'promo' AS section FROM scored WHERE promo_score >= 1
  UNION ALL SELECT *, 'product' FROM scored WHERE promo_score < 1 AND product_score >= 1
  UNION ALL SELECT *, 'research' FROM scored WHERE promo_score < 1 AND research_score >= 1)"""

KEY = r"trim(regexp_replace(lower(title), '[^\p{L}\p{N}]+', ' ', 'g'))"
GROUP_KEY = f"CASE WHEN {KEY} <> '' THEN {KEY} ELSE '#' || source_name || '#' || id END AS group_key"


@query("r2_r4_callouts", f"""
WITH {SCORED}
SELECT id, section, product_score, research_score, promo_score,
  CASE source_type WHEN 'reddit' THEN 'Reddit Post' WHEN 'youtube' THEN 'YouTube Video' ELSE 'Article' END AS label
FROM called
""")
def r2_r4_callouts(spark, sf_dir):
    """Announcements, findings and offers with their scores and source label."""
    found = callouts.callouts(A.document_items(spark, sf_dir), RULES)
    return found.select("id", "section", "product_score", "research_score", "promo_score", "label")


@query("r7_routine_items", f"""
WITH {SCORED} SELECT id, source_name FROM scored WHERE id NOT IN (SELECT id FROM called)
""")
def r7_routine_items(spark, sf_dir):
    return callouts.routine_items(A.document_items(spark, sf_dir), RULES).select("id", "source_name")


@query("r5_exact_groups", f"""
WITH {DOCS}, keyed AS (SELECT *, {GROUP_KEY} FROM docs),
ranked AS (SELECT *, count(*) OVER (PARTITION BY group_key) AS items,
  row_number() OVER (PARTITION BY group_key ORDER BY score DESC, publish_date, id) AS rn FROM keyed)
SELECT md5(group_key) AS group_key, items, id, url FROM ranked WHERE rn = 1
""")
def r5_exact_groups(spark, sf_dir):
    """Items of equal titles, and the primary source of each group."""
    items = A.document_items(spark, sf_dir).withColumn("group_key", grouping.exact_key())
    chosen = grouping.primaries(items, ["group_key"], ["id", "url"])
    return chosen.withColumn("group_key", F.md5("group_key"))


@query("r5_group_links", f"""
WITH {DOCS}, keyed AS (SELECT *, {GROUP_KEY} FROM docs)
SELECT DISTINCT md5(group_key) AS group_key, url FROM keyed
""")
def r5_group_links(spark, sf_dir):
    items = A.document_items(spark, sf_dir).withColumn("group_key", grouping.exact_key())
    return grouping.group_links(items, ["group_key"]).withColumn("group_key", F.md5("group_key"))


NEAR = f"""{DOCS}, keyed AS (SELECT *, {GROUP_KEY}, {KEY} AS key FROM docs),
node AS (SELECT DISTINCT key, md5(key) AS node FROM keyed WHERE key <> ''),
sh AS MATERIALIZED (SELECT node, unnest(CASE WHEN length(key) < 5 THEN [key]
  ELSE list_distinct(list_transform(range(1, length(key) - 3), lambda i: substring(key, i, 5))) END) AS s FROM node),
n AS (SELECT node, count(*) AS n FROM sh GROUP BY 1),
common AS (SELECT a.node AS a, b.node AS b, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.node <> b.node GROUP BY 1, 2),
link AS MATERIALIZED (SELECT a, b FROM common JOIN n x ON x.node = a JOIN n y ON y.node = b WHERE c / (x.n + y.n - c) >= 0.7),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
label AS (SELECT node, least(node, coalesce(min(b), node)) AS label FROM node LEFT JOIN reach ON a = node GROUP BY node),
grouped AS (SELECT keyed.* EXCLUDE (group_key), coalesce(l.key, keyed.group_key) AS group_key
  FROM keyed LEFT JOIN label ON label.node = md5(keyed.key) LEFT JOIN node l ON l.node = label.label)"""


@query("r5_similar_groups", f"""
WITH RECURSIVE {NEAR},
ranked AS (SELECT *, count(*) OVER (PARTITION BY group_key) AS items,
  row_number() OVER (PARTITION BY group_key ORDER BY score DESC, publish_date, id) AS rn FROM grouped)
SELECT md5(group_key) AS group_key, items, id, url FROM ranked WHERE rn = 1
""")
def r5_similar_groups(spark, sf_dir):
    """Items of similar titles, and the primary source of each group."""
    groups = grouping.similar_groups(A.document_items(spark, sf_dir))
    return grouping.primaries(groups, ["group_key"], ["id", "url"]).withColumn("group_key", F.md5("group_key"))


@query("r8_transcript_basis", f"""
WITH {DOCS}
SELECT id, md5(CASE WHEN source_type = 'youtube' AND doc_id % 8 = 2 THEN 'spoken ' || title ELSE content END) AS basis FROM docs
""")
def r8_transcript_basis(spark, sf_dir):
    items = A.document_items(spark, sf_dir)
    spoken = items.filter("source_type = 'youtube' and cast(id as long) % 8 = 2").select(
        "url", F.concat(F.lit("spoken "), "title").alias("transcript")
    )
    return add_transcripts(items, spoken).select("id", F.md5(basis()).alias("basis"))


WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]{{3,}}')"
THEMES = f"""{DOCS},
said AS (SELECT run_date, doc_id, regexp_replace(concat_ws(' ', title, content), '<[^>]*>', ' ', 'g') AS said FROM docs),
tokens AS (SELECT run_date, doc_id, unnest({WORDS.format('said')}) AS word FROM said),
counted AS (SELECT run_date, word, count(*) AS tf, count(DISTINCT doc_id) AS df FROM tokens GROUP BY 1, 2),
sizes AS (SELECT run_date, count(*) AS n FROM docs GROUP BY 1),
weighted AS (SELECT run_date, word, tf, df, round(tf * ln((1.0 + n) / (1.0 + df)), 6) AS weight FROM counted JOIN sizes USING (run_date)),
themes AS (SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY weight DESC, word) AS rank FROM weighted QUALIFY rank <= 10),
cut AS (SELECT run_date, unnest(string_split_regex(said, '[.!?]+\\s+|\\n+')) AS raw FROM said),
sentences AS (SELECT run_date, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS sentence FROM cut),
worded AS (SELECT DISTINCT run_date, sentence, {WORDS.format('sentence')} AS w FROM sentences WHERE len({WORDS.format('sentence')}) >= 5),
spread AS (SELECT run_date, sentence, len(w) AS n, unnest(w) AS word FROM worded),
scores AS (SELECT run_date, sentence, round(sum(coalesce(weight, 0)) / any_value(n), 6) AS score
  FROM spread LEFT JOIN themes USING (run_date, word) GROUP BY 1, 2),
overview AS (SELECT *, row_number() OVER (PARTITION BY run_date ORDER BY score DESC, sentence) AS rank FROM scores
  WHERE score > 0 QUALIFY rank <= 5)"""


@query("r1_themes", f"""
WITH {THEMES}
SELECT strftime(run_date, '%Y-%m-%d') AS run_date, rank, word, CAST(tf AS BIGINT) AS tf, CAST(df AS BIGINT) AS df, weight FROM themes
""")
def r1_themes(spark, sf_dir):
    marked = themes.themes(A.document_items(spark, sf_dir))
    return marked.select(
        F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), F.col("rank").cast("long").alias("rank"), "word",
        "tf", "df", "weight",
    )


@query("r1_overview", f"""
WITH {THEMES}
SELECT strftime(run_date, '%Y-%m-%d') AS run_date, rank, sentence, round(score, 4) AS score FROM overview
""")
def r1_overview(spark, sf_dir):
    items = A.document_items(spark, sf_dir)
    said = themes.overview(items, themes.themes(items))
    return said.select(
        F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), F.col("rank").cast("long").alias("rank"), "sentence",
        F.round("score", 4).alias("score"),
    )


SQUEEZED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
SUMMARY = SQUEEZED.format("regexp_replace(content, '<[^>]*>', ' ', 'g')")
BULLETS = f"""keyed AS (SELECT *, {GROUP_KEY} FROM called),
primaries AS (SELECT *, {SUMMARY} AS summary FROM keyed
  QUALIFY row_number() OVER (PARTITION BY run_date, section, group_key ORDER BY score DESC, publish_date, id) = 1),
bullets AS (
  SELECT run_date, section, url, title, CASE source_type WHEN 'reddit' THEN 'Reddit Post' WHEN 'youtube' THEN 'YouTube Video'
      ELSE 'Article' END AS label,
    '*   **' || {SQUEEZED.format('title')} || ':** ' || CASE WHEN length(summary) <= 200 THEN summary
      ELSE left(summary, 200) || '...' END || ' - (Source: ' || CASE source_type WHEN 'reddit' THEN 'Reddit Post'
      WHEN 'youtube' THEN 'YouTube Video' ELSE 'Article' END || ' - [' || url || '](' || url || '))' AS line
  FROM primaries)"""


@query("r9_digest_bullets", f"""
WITH {SCORED}, {BULLETS}
SELECT strftime(run_date, '%Y-%m-%d') AS run_date,
  CAST(CASE section WHEN 'product' THEN 3 WHEN 'research' THEN 4 ELSE 5 END AS BIGINT) AS part_no, line FROM bullets
""")
def r9_digest_bullets(spark, sf_dir):
    lines = render.callout_lines(A.document_items(spark, sf_dir), RULES).filter("source_ord >= 0")
    return lines.select(
        F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), F.col("part_no").cast("long").alias("part_no"), "line"
    )


@query("r9_digest_lines", f"""
WITH {SCORED}, {BULLETS}, {THEMES.removeprefix(DOCS).lstrip(',').strip()},
days AS (SELECT DISTINCT run_date FROM docs), secs AS (SELECT DISTINCT run_date, section FROM called),
lines AS (
  SELECT run_date, '## Unified Content Digest' AS line FROM days UNION ALL SELECT run_date, '' FROM days
  UNION ALL SELECT DISTINCT run_date, '**Global Overview:**' FROM overview
  UNION ALL SELECT run_date, regexp_replace(sentence, '([^.!?])$', '\\1.') FROM overview
  UNION ALL SELECT DISTINCT run_date, '**Key Information:**' FROM secs WHERE section IN ('product', 'research')
  UNION ALL SELECT DISTINCT run_date, '' FROM secs WHERE section IN ('product', 'research')
  UNION ALL SELECT run_date, CASE section WHEN 'product' THEN '### Product Announcements & Releases' WHEN 'research'
    THEN '### Research Breakthroughs & Significant Findings' ELSE '**Promotional Offers:**' END FROM secs
  UNION ALL SELECT run_date, '' FROM secs
  UNION ALL SELECT run_date, line FROM bullets)
SELECT strftime(run_date, '%Y-%m-%d') AS run_date, line, count(*) AS times FROM lines GROUP BY ALL
""")
def r9_digest_lines(spark, sf_dir):
    """All lines of all digests: headings, overview and bullets."""
    lines = render.digest_lines(A.document_items(spark, sf_dir), RULES)
    return lines.groupBy(F.date_format("run_date", "yyyy-MM-dd").alias("run_date"), "line").agg(F.count("*").alias("times"))
