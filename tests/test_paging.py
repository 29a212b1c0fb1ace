from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidings.operators import limits, ordered, paging
from tidings.operators.recency import since_cutoff
from tidings.plans import adapters as A
from tidings.sources.listing import read_listing

from conftest import rows

SIZES = "run_date date, source_ord int, page_no long, size int, valid int, after string, max_results int"


def pages(spark, listing, cap, parts=3):
    data = [(None, s, n, size, valid, after, cap) for s, n, size, valid, after in listing]
    df = spark.createDataFrame(data, SIZES).withColumn("run_date", F.lit("2025-05-23").cast("date"))
    return df.repartition(parts)


def kept(df):
    return sorted((r["source_ord"], r["page_no"]) for r in df.collect())


def test_client_pages(spark):
    df = pages(spark, [(0, i, 9, v, "x") for i, v in enumerate([0, 2, 3, 5])], 4)
    assert kept(paging.pages_until_enough(df)) == [(0, 0), (0, 1), (0, 2)]


@pytest.mark.parametrize("keep_last, want", [(False, []), (True, [(0, 0)])])
def test_single_page_listing(spark, keep_last, want):
    df = pages(spark, [(0, 0, 10, 10, None)], 20)
    assert kept(paging.pages_until_end(df, 20, keep_last_page=keep_last)) == want


def test_direct_pages_count_posts_of_any_age(spark):
    df = pages(spark, [(0, 0, 5, 0, "a"), (0, 1, 5, 5, "b")], 5)
    assert kept(paging.pages_until_end(df, 5)) == [(0, 0)]


def test_empty_page_ends_the_scan(spark):
    df = pages(spark, [(0, 0, 5, 5, "a"), (0, 1, 0, 0, "b"), (0, 2, 5, 5, "c")], 50)
    assert kept(paging.pages_until_end(df, 50, keep_last_page=False)) == [(0, 0)]


def loop_client(listing, cap):
    used, total = [], 0
    for n, size, valid, after in listing:
        used.append(n)
        total += valid
        if total >= cap:
            break
    return used


def loop_direct(listing, cap, keep_last):
    used, total = [], 0
    for n, size, valid, after in listing:
        if total >= cap:
            break
        if size == 0 or after is None:
            if keep_last:
                used.append(n)
            break
        used.append(n)
        total += size
    return used


def test_page_rules_equal_the_sequential_loops(spark, monkeypatch):
    """Random listings, with blocks so small that totals cross many of them."""
    monkeypatch.setattr(ordered, "PAGES_PER_BLOCK", 3)
    rnd = random.Random(5)
    cap, listings = 12, {}
    for s in range(120):
        listings[s] = [
            (n, size := rnd.choice([0, 1, 3, 5, 5, 5]), rnd.randint(0, size), rnd.choice([None, "a", "b", "c", "d", "e"]))
            for n in sorted(rnd.sample(range(40), rnd.randint(1, 14)))
        ]
    flat = [(s, *page) for s, listing in listings.items() for page in listing]
    df = pages(spark, flat, cap, 7)
    assert kept(paging.pages_until_enough(df)) == sorted(
        (s, n) for s, listing in listings.items() for n in loop_client(listing, cap))
    for keep_last in (True, False):
        assert kept(paging.pages_until_end(df, cap, keep_last_page=keep_last)) == sorted(
            (s, n) for s, listing in listings.items() for n in loop_direct(listing, cap, keep_last))


def test_client_posts_need_no_page_rule(spark, sf_dir):
    """The first recent posts of a source are the same on the pages L4a keeps as on all."""
    rows_of = A.events(spark, sf_dir).filter("source_type = 'reddit'")
    posts = read_listing(A.bound(A.listing_payloads(rows_of)))
    cutoff = since_cutoff(F.timestamp_seconds(F.col("created").cast("long")), F.col("as_of"), F.lit(9))
    marked = posts.withColumns({"fresh": cutoff, "max_results": F.lit(12)})
    per_page = marked.groupBy("run_date", "source_ord", "page_no", "max_results").agg(F.count_if("fresh").alias("valid"))
    read = paging.pages_until_enough(per_page).select("run_date", "source_ord", "page_no")
    fresh = marked.filter("fresh")
    on_pages = fresh.join(read, ["run_date", "source_ord", "page_no"], "left_semi")
    want = rows(limits.cap_per_source(fresh, 12), "source_ord", "id")
    assert want and rows(limits.cap_per_source(on_pages, 12), "source_ord", "id") == want
    assert read.count() < per_page.count()


ITEMS = "run_date date, source_ord int, page_no long, item_pos int, publish_date timestamp, max_results int, id string"


def items(spark, data, parts=1):
    df = spark.createDataFrame([(None, *r[:3], None, *r[3:]) for r in data], ITEMS)
    return df.withColumn("run_date", F.lit("2025-05-23").cast("date")).repartition(parts)


def test_cap_takes_source_order(spark):
    df = items(spark, [(0, 0, 0, 1, "old"), (0, 0, 1, 1, "new")])
    assert rows(limits.cap_per_source(df, 5), "id") == [("old",)]


@pytest.mark.parametrize("parts", [1, 7])
def test_cap_with_one_source_holding_most_rows(spark, parts):
    data = [(0, p, i, 5, f"a{p}-{i}") for p in range(60) for i in range(25)]
    data += [(s, 0, i, s % 4, f"b{s}-{i}") for s in range(1, 40) for i in range(6)]
    got = rows(limits.cap_per_source(items(spark, data, parts), 5), "source_ord", "id")
    want = [(0, f"a0-{i}") for i in range(5)] + [(s, f"b{s}-{i}") for s in range(1, 40) for i in range(min(6, s % 4))]
    assert got == sorted(want, key=repr)


def test_overfetch(spark):
    got = spark.createDataFrame([(10,), (40,)], "m int").select(limits.overfetch(F.col("m"))).collect()
    assert [r[0] for r in got] == [50, 80]


def test_overfetch_happens_before_the_window(spark):
    """60 videos of today hide the older ones behind the 50 newest."""
    df = items(spark, [(0, 0, i, 10, f"v{i}") for i in range(70)]).withColumns({
        "as_of": F.lit("2025-05-23 12:00:00").cast("timestamp"), "time_range_days": F.lit(2),
        "publish_date": F.when(F.col("item_pos") < 45, F.lit("2025-05-23 06:00:00")).otherwise("2025-05-22 06:00:00").cast("timestamp"),
    })
    assert rows(limits.recent_videos(df, 10), "id") == [(f"v{i}",) for i in range(45, 50)]


@pytest.mark.parametrize("parts, block", [(1, 4096), (5, 2)])
def test_running_total_over_blocks(spark, monkeypatch, parts, block):
    monkeypatch.setattr(ordered, "PAGES_PER_BLOCK", block)
    data = [(s, p, i, 1, f"{s}-{p}-{i}") for s in (2, 0, 7) for p in range(9) for i in range((p + s) % 4)]
    df = items(spark, data, parts)
    got = ordered.running_total(
        df, F.lit(2).cast("long"), "before", ["run_date"], ordered.item_blocks(), ["source_ord", "page_no", "item_pos"])
    in_order = [d[4] for d in sorted(data)]
    assert rows(got, "before", "id") == sorted(((2 * n, i) for n, i in enumerate(in_order)), key=repr)


@pytest.mark.parametrize("parts", [1, 6])
def test_joined_text_parts(spark, monkeypatch, parts):
    monkeypatch.setattr(ordered, "PAGES_PER_BLOCK", 2)
    data = [(s, p, i, 1, f"{s}.{p}.{i}") for s in range(3) for p in range(5) for i in range(4)]
    order = ["source_ord", "page_no", "item_pos"]
    df = items(spark, data, parts)
    whole = ordered.joined_text(df, "id", "\n", ["run_date"], ordered.item_blocks(), order, 10**6).collect()
    assert [(r["part"], r["id"]) for r in whole] == [(0, "\n".join(d[4] for d in sorted(data)))]
    split = ordered.joined_text(df, "id", "\n", ["run_date"], ordered.item_blocks(), order, 25).orderBy("part").collect()
    assert [r["part"] for r in split] == list(range(len(split)))
    assert "\n".join(r["id"] for r in split) == whole[0]["id"]
    assert all(len(r["id"].replace("\n", "")) <= 25 + 5 for r in split)
