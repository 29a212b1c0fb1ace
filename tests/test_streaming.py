from __future__ import annotations

import json

import pytest

from pyspark.sql import functions as F

from tidings.operators.limits import cap_per_source
from tidings.plans import adapters as A
from tidings.session import new_table_path, shared_dir, through_table
from tidings.sources.feed import read_feeds
from tidings.sources.listing import read_listing
from tidings.sources.video import read_videos
from tidings.streaming.ingest import (
    daily_counts, drop_refetched, for_each_batch, landed_stream, read_run, run_available,
)

from conftest import rows

SCHEMA = "id string, source_name string, source_type string, publish_date timestamp"


def land(folder, name, *items):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps(dict(zip(("id", "source_name", "source_type", "publish_date"), i))) for i in items]
    (folder / name).write_text("\n".join(lines))


def test_runs_take_only_what_is_new(spark, tmp_path):
    folder, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    for n in (1, 2, 3):
        if n < 3:
            land(folder, f"{n}.json", (f"i{n}", "s", "rss", "2025-05-22 10:00:00"))
        stream = landed_stream(spark, str(folder), SCHEMA)
        run_available(stream, "t", out, progress)
        assert read_run(spark, out, stream).count() == min(n, 2)


@pytest.mark.parametrize("spread", [None, ["publish_date", "source_type"]])
def test_refetched_items_are_dropped_within_the_delay(spark, tmp_path, spread):
    folder = tmp_path / "in"
    land(folder, "1.json", ("a", "s", "rss", "2025-05-22 10:00:00"), ("a", "t", "rss", "2025-05-22 10:00:00"))
    stream = drop_refetched(landed_stream(spark, str(folder), SCHEMA, files_per_trigger=1), "2 days", time="publish_date", spread=spread)
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    run_available(stream, "t", out, progress)
    land(folder, "2.json", ("a", "s", "rss", "2025-05-22 10:30:00"), ("b", "s", "rss", "2025-05-23 10:00:00"))
    stream = drop_refetched(landed_stream(spark, str(folder), SCHEMA, files_per_trigger=1), "2 days", time="publish_date", spread=spread)
    run_available(stream, "t", out, progress)
    assert rows(read_run(spark, out, stream), "source_name", "id") == [("s", "a"), ("s", "b"), ("t", "a")]


def test_daily_counts_close_days_and_drop_late_rows(spark, tmp_path):
    folder, out, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")

    def run():
        stream = daily_counts(landed_stream(spark, str(folder), SCHEMA), "12 hours")
        run_available(stream, "t", out, progress)
        return rows(read_run(spark, out, stream), F.date_format("day", "dd"), "source_type", "items")

    land(folder, "1.json", *[(f"a{i}", "s", "rss", "2025-05-21 10:00:00") for i in range(3)], ("b", "s", "rss", "2025-05-22 11:00:00"))
    assert run() == []
    land(folder, "2.json", ("c", "s", "rss", "2025-05-22 13:00:00"))
    assert run() == [("21", "rss", 3)]
    land(folder, "3.json", ("late", "s", "rss", "2025-05-21 10:00:00"), ("d", "s", "rss", "2025-05-24 00:00:00"))
    assert run() == [("21", "rss", 3), ("22", "rss", 2)]


def test_caps_run_on_each_batch(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    land(folder, "1.json", *[(f"a{i}", f"s{i % 2}", "rss", "2025-05-21 10:00:00") for i in range(10)])
    stream = landed_stream(spark, str(folder), SCHEMA)

    def handle(batch):
        placed = batch.withColumns({"page_no": F.lit(0), "item_pos": F.expr("int(substring(id, 2))"), "run_date": F.to_date("publish_date"),
                                    "source_ord": F.expr("int(substring(source_name, 2))")})
        cap_per_source(placed, 2, 2).write.mode("append").parquet(out)

    for_each_batch(stream, handle, str(tmp_path / "progress"))
    assert rows(spark.read.parquet(out), "id") == [("a0",), ("a1",), ("a2",), ("a3",)]


def test_scans_of_a_stream_equal_those_of_a_table(spark, sf_dir, tmp_path):
    """Feeds, listings and videos as they land, in two deliveries, give the entries of the batch scan."""
    events = A.events(spark, sf_dir)
    cases = {
        "rss": (A.feed_payloads, read_feeds, ("source_name", "page_no", "item_pos", "uri", "link", "publish_date")),
        "reddit": (A.listing_payloads, read_listing, ("source_name", "page_no", "item_pos", "id", "score")),
        "youtube": (A.search_payloads, read_videos, ("source_name", "page_no", "item_pos", "video_id", "publish_date")),
    }
    for kind, (build, scan, columns) in cases.items():
        payloads = build(events.filter(F.col("source_type") == kind))
        folder, out, progress = (str(tmp_path / f"{kind}-{n}") for n in ("in", "out", "progress"))
        for late in (0, 1):
            payloads.filter(F.col("page_no") % 2 == late).write.mode("append").json(folder)
            stream = scan(landed_stream(spark, folder, "source_name string, page_no long, body string")).select(*columns)
            run_available(stream, kind, out, progress)
        assert rows(read_run(spark, out, stream)) == rows(scan(payloads).select(*columns))


def test_scratch_tables_lie_in_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == named and new_table_path(spark, "x").startswith(named)
    table = through_table(spark.range(3), "three")
    assert table.count() == 3 and any("three-" in f for f in table.inputFiles())
