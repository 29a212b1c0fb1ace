from __future__ import annotations

import datetime as dt
import itertools
import os
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidings.operators import callouts, counts, grouping, model, prompt, publish, published, render, themes
from tidings.operators.union import union_items
from tidings.plans.daily import day_digests
from tidings.schemas import ITEM_COLUMNS
from tidings.session import scratch_dir
from tidings.sources.archive import list_digests, read_archive, read_digest_files

from conftest import rows

DAY = dt.date(2025, 5, 23)
SCHEMA = ("id string, title string, content string, url string, publish_date timestamp, publish_zone string, author string, "
          "source_type string, source_name string, metadata map<string,string>, run_date date, as_of timestamp, "
          "source_ord int, page_no int, item_pos int")


def items(spark, *entries, parts=2):
    """Items from ``(title, content, more)``."""
    data = []
    for i, (title, content, more) in enumerate(entries):
        row = {
            "id": f"i{i}", "title": title, "content": content, "url": f"https://u.example/{i}",
            "publish_date": dt.datetime(2025, 5, 22, 10, i % 60), "publish_zone": "UTC", "author": None, "source_type": "rss",
            "source_name": "S", "metadata": {}, "run_date": DAY, "as_of": dt.datetime(2025, 5, 23, 8), "source_ord": 0,
            "page_no": 0, "item_pos": i, **more,
        }
        data.append(tuple(row[c] for c in ITEM_COLUMNS))
    return spark.createDataFrame(data, SCHEMA).repartition(parts)


def test_sections(spark):
    df = items(
        spark, ("Tool 2.0 released, 20% off", "", {}), ("Paper released on arxiv", "", {}), ("chat", "hello", {}),
        ("video", "nothing", {"metadata": {"transcription": "a <b>new</b> study"}, "source_type": "youtube"}),
        ("<a href='sale'>x</a>", "", {}),
    )
    found = callouts.callouts(df)
    assert rows(found, "id", "section", "label") == [
        ("i0", "promo", "Article"), ("i1", "product", "Article"), ("i1", "research", "Article"),
        ("i3", "research", "YouTube Video")]
    assert rows(callouts.routine_items(df), "id") == [("i2",), ("i4",)]


def test_primary_source(spark):
    df = items(
        spark, ("Foo: Bar!", "", {"metadata": {"score": "5"}}), ("foo bar", "", {"metadata": {"score": "9"}}),
        ("FOO  bar", "", {"metadata": {"score": "9"}, "publish_date": dt.datetime(2025, 5, 23)}),
        ("!!", "", {}), ("??", "", {"publish_date": None}), ("other", "", {"metadata": {"score": "high"}}),
    ).withColumn("group_key", grouping.exact_key())
    got = grouping.primaries(df, ["group_key"], ["id", "url"])
    assert rows(got, "group_key", "items", "id") == [
        ("#S#i3", 1, "i3"), ("#S#i4", 1, "i4"), ("foo bar", 3, "i1"), ("other", 1, "i5")]
    assert grouping.group_links(df, ["group_key"]).filter("group_key = 'foo bar'").count() == 3


def brute_groups(keys, max_distance):
    """Connected components over all pairs."""
    sets = {k: {k[i:i + 5] for i in range(max(1, len(k) - 4))} for k in keys}
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(keys, 2):
        if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 1 - max_distance:
            parent[find(a)] = find(b)
    groups = {}
    for k in keys:
        groups.setdefault(find(k), set()).add(k)
    return sorted(map(sorted, groups.values()))


def test_similar_titles_equal_all_pairs(spark):
    """Families of edited titles far from each other, one of them with a third of all rows, and hot exact copies."""
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(4, 9))) for _ in range(400)]
    titles = []
    for family in range(24):
        base = [rnd.choice(vocabulary) for _ in range(18)]
        titles.append(" ".join(base))
        for _ in range(40 if family == 0 else rnd.randint(0, 4)):
            edited = list(base)
            edited[rnd.randrange(18)] = rnd.choice(vocabulary)[:2]
            titles.append(" ".join(edited))
    titles += [titles[0].upper()] * 150 + ["", "!!", "ab", "AB.", "abcd"]
    df = items(spark, *[(t, "", {}) for t in titles], parts=5)
    got = grouping.similar_groups(df)
    assert got.count() == len(titles)
    by_group = {}
    for r in got.select("group_key", "title").collect():
        by_group.setdefault(r["group_key"], set()).add(r["title"])
    key = {t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) for t in titles}
    want = brute_groups(sorted({k for k in key.values() if k}), 0.3)
    found = sorted(sorted({key[t] for t in g}) for g in by_group.values() if any(key[t] for t in g))
    assert found == want
    assert sum(1 for g in by_group if g.startswith("#")) == 2


def labels_of(spark, keys, blocks=None, monkeypatch=None):
    if blocks:
        monkeypatch.setattr(grouping, "PROBES", blocks)
        monkeypatch.setattr(grouping, "TARGETS", blocks)
    df = spark.createDataFrame([(f"n{i:04d}", k) for i, k in enumerate(keys)], "node string, key string")
    labels = {f"n{i:04d}": f"n{i:04d}" for i in range(len(keys))}
    labels.update({r["node"]: r["label"] for r in grouping.similar_labels(df).collect()})
    groups = {}
    for i, k in enumerate(keys):
        groups.setdefault(labels[f"n{i:04d}"], []).append(k)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("blocks", [None, 7])
def test_no_link_is_lost(spark, monkeypatch, blocks):
    """Chains of one-word edits that lead away from their start, templates just below and above the limit, and a hot family
    around one leader: the groups are those of all pairs."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(4, 9)))
    keys = []
    for _ in range(4):
        chain = [word() for _ in range(9)]
        for step in range(30):
            chain[step % 9] = word()[: 2 + step % 4]
            keys.append(" ".join(chain))
    keys += [f"daily discussion thread {rnd.randrange(10**9):09d}" for _ in range(60)]
    keys += [f"a somewhat longer daily discussion thread of the day {rnd.randrange(10**4):04d}" for _ in range(60)]
    base = " ".join(f"word{i:02d}" for i in range(20))
    keys += [base] + [f"{base} tail{i}" for i in range(50)]
    keys = sorted(set(keys))
    assert labels_of(spark, keys, blocks, monkeypatch) == brute_groups(keys, 0.3)


def test_short_and_unlike_titles_stay_alone(spark):
    keys = ["a", "ab", "abcd", "abcde", "abcdf", "the quick brown fox", "jumped over a lazy dog", "\u65e5\u672c"]
    assert labels_of(spark, keys) == sorted([k] for k in keys)
    assert labels_of(spark, ["only one"]) == [["only one"]]


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """Similar titles without a common leader, of which a round takes one link each: it merges at least every other component."""
    rounds = []
    original = grouping.open_links
    monkeypatch.setattr(grouping, "open_links", lambda *a: rounds.append(1) or original(*a))
    monkeypatch.setattr(grouping, "PARTNERS", 1)
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(150)]
    keys = [" ".join(words[i : i + 12]) for i in range(130)]
    assert len(labels_of(spark, keys)) == 1
    assert len(rounds) <= 9


def test_grouping_leaves_no_large_tables(spark):
    """What rounds are made from goes when it is read for the last time, and shuffle files with the queries that wrote them."""
    def kept():
        return set(os.listdir(scratch_dir(spark))) if os.path.isdir(scratch_dir(spark)) else set()

    def shuffled():
        at = f"{spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]}"
        return {f for _, _, files in os.walk(at) for f in files if f.startswith("shuffle_")}

    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(60)]
    keys = [" ".join(words[i : i + 12]) for i in range(40)]
    df = spark.createDataFrame([(f"n{i:04d}", k) for i, k in enumerate(keys)], "node string, key string")
    tables, files = kept(), shuffled()
    assert grouping.similar_labels(df).count() == 40
    assert {name.rsplit("-", 1)[0] for name in kept() - tables} <= {"labels", "links"}
    assert len(shuffled() - files) <= 16


def test_grouping_writes_little(spark, monkeypatch):
    """Unlike titles that share many shingles: all tables together take a few times the titles, not a wide row per shingle and round."""
    sizes, original = [], grouping.written

    def measured(df, name, *parts):
        table, path = original(df, name, *parts)
        sizes.append(sum(f.stat().st_size for f in Path(path.removeprefix("file:")).rglob("*.parquet")))
        return table, path

    monkeypatch.setattr(grouping, "written", measured)
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(3000)]
    keys = [" ".join(rnd.choice(words) for _ in range(100)) for _ in range(400)]
    df = spark.createDataFrame([(f"n{i:04d}", k) for i, k in enumerate(keys)], "node string, key string").coalesce(1)
    assert grouping.similar_labels(df).count() == 0
    assert sum(sizes) < 8 * sum(map(len, keys))


def test_no_link_is_lost_between_blocks_and_turns(spark, monkeypatch):
    """Families whose sizes go apart as far as they may, in blocks of a few nodes or marks that are compared in many turns."""
    rnd = random.Random(8)
    keys = []
    for _ in range(12):
        words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(rnd.randint(3, 30))]
        keys += [" ".join(words[: len(words) - cut]) for cut in range(0, len(words) // 2)]
    keys = sorted(set(keys))
    turns = []
    ranges = grouping._ranges
    monkeypatch.setattr(grouping, "_ranges", lambda *a: turns.append(ranges(*a)) or turns[-1])
    for limits in ({"MARKS": 60, "COPIES": 1}, {"TARGETS": 4, "PROBES": 3, "MEETS": 5, "COPIES": 3}):
        for name, value in limits.items():
            monkeypatch.setattr(grouping, name, value)
        assert labels_of(spark, keys) == brute_groups(keys, 0.3)
    assert all(n > 1 for _, n in turns) and len(turns) == 2


def test_blocks_of_fitting_sizes_meet_once():
    """Any two nodes whose sizes may go together meet in one cell of their blocks, whatever blocks their bands are in."""
    sizes = [Row(band=b, least=n, most=n + n // 40, nodes=n % 7 + 1, marks=(n * 37) % 50 + 1) for b, n in enumerate(range(20, 400, 12))]
    for marks, targets in ((20, 100), (200, 3), (10**6, 10**6)):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(grouping, "MARKS", marks)
            m.setattr(grouping, "TARGETS", targets)
            of, turns = grouping._ranges(sizes, 0.7)
        assert turns >= 1 and min(of["splits"]) >= 1
        blocks = lambda r: range(of["start"][r["band"]], of["start"][r["band"]] + of["splits"][r["band"]])
        seen = lambda r: range(of["first"][r["band"]], of["last"][r["band"]] + 1)
        for a in sizes:
            for b in sizes:
                if a["most"] >= 0.7 * b["least"] and b["most"] >= 0.7 * a["least"]:
                    assert set(blocks(b)) <= set(seen(a)) and set(blocks(a)) <= set(seen(b))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"n{i + 1:03d}", f"n{i:03d}") for i in range(40)], "node string, other string")
    got = rows(grouping.components(links), "node", "label")
    assert got == [(f"n{i:03d}", "n000") for i in range(41)]
    assert grouping.components(links.limit(0)).collect() == []


def test_themes_by_hand(spark):
    df = items(spark, ("alpha", "alpha beta", {}), ("gamma", "beta beta", {}), ("gamma", "of delta", {"run_date": dt.date(2025, 5, 24)}))
    marked = themes.themes(df, k=2)
    got = rows(marked, "run_date", "rank", "word", "tf", "df", "weight")
    assert [g[2:5] for g in got] == [("alpha", 2, 1), ("gamma", 1, 1), ("delta", 1, 1), ("gamma", 1, 1)]
    assert [g[5] for g in got] == [0.81093, 0.405465, 0.0, 0.0]


@pytest.mark.parametrize("parts", [1, 7])
def test_prompts(spark, parts):
    df = items(spark, ("T", "C", {"metadata": {"a": "1", "b": "2"}}), ("U", "D", {}), parts=parts)
    first = "Title: T\nSource: S\nSource Url: https://u.example/0\nContent: C\nMetadata: {a=1, b=2}"
    second = "Title: U\nSource: S\nSource Url: https://u.example/1\nContent: D\nMetadata: {}"
    assert rows(prompt.batch_prompts(df, F.lit("P"))) == [(DAY, 0, 2, f"P\n\n{first}\n\n{second}")]
    split = rows(prompt.batch_prompts(df, F.lit("P"), max_chars=10), "part", "prompt")
    assert [p[1] for p in split] == [f"P\n\n{first}", f"P\n\n{second}"]
    single = rows(prompt.single_prompts(df, F.lit("P")), "prompt")
    assert single[0][0] == "P\n\n" + first.replace("Source Url: https://u.example/0\n", "")


def test_previews_number_items_through_the_day(spark):
    df = items(spark, *[(f"t{i}", "x" * (199 + i), {"source_ord": i % 3, "metadata": {"score": str(i)}}) for i in range(6)], parts=4)
    got = rows(prompt.previews(df), "item_no", "title", "score", F.length("content"))
    assert got == [(1, "t0", "0", 199), (2, "t3", "3", 203), (3, "t1", "1", 200), (4, "t4", "4", 203), (5, "t2", "2", 203), (6, "t5", "5", 203)]


def test_model_failures_are_rows(spark):
    def complete(text):
        if text == "boom":
            raise RuntimeError("boom")
        return None if text == "none" else text.upper()

    df = spark.createDataFrame([("a",), ("boom",), ("none",)], "prompt string").withColumn("key", F.col("prompt"))
    got = {r["key"]: r for r in model.call_model(df, "prompt", complete, partitions=2).collect()}
    assert (got["a"]["reply"], got["a"]["status"], got["a"]["error"]) == ("A", "ok", None)
    assert got["boom"]["reply"].startswith("Error generating summary: boom\nRuntimeError: boom")
    assert len(got["boom"]["reply"].splitlines()) <= 1 + model.TRACE_LINES
    assert (got["boom"]["status"], got["boom"]["error"]) == ("failed", "boom")
    assert (got["none"]["reply"], got["none"]["status"]) == ("Failed to generate summary.", "failed")


def test_model_is_called_once_per_row(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def complete(text):
        with open(calls, "a") as log:
            log.write(text + "\n")
        return text

    df = spark.createDataFrame([(f"p{i}",) for i in range(20)], "prompt string").withColumn("key", F.col("prompt"))
    replies = model.call_model_once(df, "prompt", complete)
    assert replies.count() == replies.filter("status = 'ok'").count() == 20
    assert sorted(open(calls).read().split()) == sorted(f"p{i}" for i in range(20))


def test_batches_of_a_client(spark, tmp_path):
    """A client that can't be pickled is made once per task; batches keep to both limits; a bad text fails alone, and what
    failed once is asked for again by itself."""
    import threading
    import uuid

    for name in ("made", "batches", "tries"):
        (tmp_path / name).mkdir()
    folder = str(tmp_path)

    def connect():
        open(f"{folder}/made/{uuid.uuid4().hex}", "w").close()
        lock = threading.Lock()

        def ask(texts):
            with lock, open(f"{folder}/batches/{uuid.uuid4().hex}", "w") as log:
                log.write(f"{len(texts)} {sum(map(len, texts))}")
            if "flaky" in texts:
                open(f"{folder}/tries/{uuid.uuid4().hex}", "w").close()
                if len(os.listdir(f"{folder}/tries")) < 2:
                    raise TimeoutError("busy")
            if "bad" in texts:
                raise ValueError("refused")
            return [None if t == "none" else t.upper() for t in texts]

        return ask

    texts = [f"text {i}" for i in range(40)] + ["bad", "flaky", "none", "long" * 100]
    df = spark.createDataFrame([(t,) for t in texts], "prompt string").withColumn("key", F.col("prompt"))
    settings = {"partitions": 3, "batch_requests": 8, "batch_chars": 60, "attempts": 2}
    replies = model.call_client_once(df, "prompt", connect, **settings)
    got = {r["key"]: (r["reply"], r["status"], r["error"]) for r in replies.collect()}
    assert len(os.listdir(tmp_path / "made")) == 3
    assert got["bad"][0].startswith("Error generating summary: refused\n") and got["bad"][1:] == ("failed", "refused")
    assert got["none"] == ("Failed to generate summary.", "failed", None)
    assert all(got[t] == (t.upper(), "ok", None) for t in texts if t not in ("bad", "none"))
    batches = [tuple(map(int, (tmp_path / "batches" / b).read_text().split())) for b in os.listdir(tmp_path / "batches")]
    assert all(n <= 8 and (chars <= 60 or n == 1) for n, chars in batches) and max(n for n, _ in batches) > 3


def test_packing():
    assert [list(r) for r in model.packed([5, 5, 5, 90, 1], 2, 50)] == [[0, 1], [2], [3], [4]]
    assert list(model.packed([], 2, 50)) == []


def test_one_digest_per_day_in_rounds(spark, tmp_path):
    """Five parts become three, two, one; a day of one part is asked about once; a day with a failed part stops there."""
    other, third = dt.date(2025, 5, 24), dt.date(2025, 5, 25)
    df = items(
        spark, *[(f"t{i}", "x" * 40, {"source_ord": i}) for i in range(5)], ("alone", "y", {"run_date": other}),
        ("bad", "z" * 40, {"run_date": third}), ("good", "z" * 40, {"run_date": third, "source_ord": 5}))
    folder = str(tmp_path)

    def connect():
        def ask(texts):
            import uuid

            for text in texts:
                with open(f"{folder}/{uuid.uuid4().hex}", "w") as log:
                    log.write(text)
                if "Title: bad" in text:
                    raise ValueError("boom")
            return ["<" + ",".join(a or b for a, b in re.findall(r"Title: (\w+)|<(.*?)>", t)) + ">" + "." * 60 for t in texts]

        return ask

    rows_ = day_digests(df, F.lit("P"), connect, max_chars=60, batch_requests=1, attempts=1)
    got = {r["run_date"]: (r["body"], r["status"]) for r in rows_.collect()}
    assert got[DAY] == ("<t0,t1,t2,t3,t4>" + "." * 60, "ok") and got[other] == ("<alone>" + "." * 60, "ok")
    assert got[third][0].startswith("Error generating summary: boom") and got[third][1] == "failed"
    assert len(rows_.collect()) == 3
    assert len(os.listdir(folder)) == (5 + 3 + 2 + 1) + 1 + 2


def test_merging_prompts_halve_at_least(spark):
    replies = spark.createDataFrame([(DAY, p, "r" * 50 + str(p)) for p in (0, 1, 4, 7, 9)] + [(dt.date(2025, 5, 24), 0, "single")], "run_date date, part long, reply string")
    merged = rows(prompt.merging_prompts(replies, F.lit("P"), 10), "run_date", "part", F.length("prompt"))
    assert merged == [(DAY, 0, 3 + 51 + 2 + 51), (DAY, 1, 3 + 51 + 2 + 51), (DAY, 2, 3 + 51)]
    assert rows(prompt.merging_prompts(replies, F.lit("P"), 1000), "part") == [(0,)]


def test_transcripts_are_asked_once_per_url(spark):
    videos = spark.createDataFrame([("u1",), ("u1",), ("u2",)], "url string")
    got = rows(model.transcribe(videos, lambda text: text), "url", "transcript", "status")
    assert got == [(u, f"Provide a full transcript for this video: {u}", "ok") for u in ("u1", "u2")]


def test_empty_days(spark):
    days = spark.createDataFrame([(DAY,), (dt.date(2025, 5, 24),)], "run_date date")
    replies = spark.createDataFrame([(DAY, "x")], "run_date date, reply string")
    assert rows(prompt.replies_or_empty(days, replies)) == [(DAY, "x"), (dt.date(2025, 5, 24), "No content to summarize.")]


def test_counts(spark):
    df = items(spark, ("x", "", {"source_name": "a"}), ("x", "", {"source_name": "a"}), ("x", "", {"source_name": "b"}))
    assert rows(counts.item_counts(df), "level", "source_type", "source_name", "items") == [
        (0, "rss", "a", 2), (0, "rss", "b", 1), (1, "rss", None, 3), (3, None, None, 3)]
    assert union_items(df, df).count() == 6


def test_archive_replaces_only_its_days(spark, tmp_path):
    path = str(tmp_path / "archive")
    one = items(spark, ("a", "", {"metadata": {"z": "1", "a": "2"}}), ("b", "", {"run_date": dt.date(2025, 5, 24), "publish_date": None}))
    publish.write_archive(one, path)
    publish.write_archive(items(spark, ("c", "", {})), path)
    got = rows(read_archive(spark, path), "run_date", "title", "publish_zone", "author")
    assert got == [(dt.date(2025, 5, 23), "c", "UTC", None), (dt.date(2025, 5, 24), "b", None, None)]
    text = spark.read.text(path).filter("value like '%\"title\":\"b\"%'").first()["value"]
    assert '"publishDate":null' in text and '"author":null' in text


def test_archive_as_one_array(spark, tmp_path):
    (tmp_path / "2025-05-23-raw.json").write_text(
        '[\n {"id": "1", "title": "t", "content": "c", "url": "u", "publishDate": "2025-05-22T07:44:39+02:00[Europe/Paris]",\n'
        '  "author": null, "sourceType": "rss", "sourceName": "S", "metadata": {"b": "1", "a": "2"}}, {"id": "2", "sourceType": "scrape"}\n]')
    got = read_archive(spark, str(tmp_path), layout="array")
    assert rows(got, "id", F.date_format("publish_date", "HH:mm"), "publish_zone", "source_type") == [
        ("1", "05:44", "Europe/Paris", "rss"), ("2", None, None, "scrape")]


def test_index(spark):
    def days(*ns):
        return spark.createDataFrame([(dt.date(2025, 5, n),) for n in ns], "run_date date")

    body = publish.index_text(publish.index_entries(days(2, 2, 1), days(1))).first()["body"]
    assert body == "# News Summaries\n\n- [2025-05-02](./2025-05-02-summary.md)\n- [2025-05-01](./2025-05-01-summary.md)\n"


FRONT = "---\nlayout: default\ntitle: Summary\n---\n"
DIGEST = """# News Summary - 2025-08-15 12:36:12

## Unified Content Digest

**Global Overview:**
All is well.

**Key Information:**

### Product Announcements & Releases
*   **Tool 2.0 Released:** Faster. - (Source: Article - [https://a.example/1](https://a.example/1), Reddit Post - [x](https://a.example/2))
- **Other:** No source.

### Research Breakthroughs & Significant Findings
*   **Study:** Found. - (Source: Reddit Post - [r](https://r.example))

{promo}
*   **Offer:** Cheap. - (Source: YouTube Video - [v](https://v.example))
"""


def test_published_digests(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    texts = {
        "2025-08-15-summary.md": FRONT + DIGEST.format(promo="**Promotional Offers:**"),
        "2025-08-16-summary.md": DIGEST.format(promo="### Promotional Offers"),
        "2025-08-17-summary.md": FRONT + "# News Summary - 2025-08-17 12:00:00\n\nError generating summary: Something.\nat x",
        "2025-08-18-summary.md": "# News Summary - 2025-08-18 12:00:00\n\nFailed to generate summary.",
        "index.md": "x", "2025-08-15-raw.json": "[]",
    }
    for name, text in texts.items():
        (tmp_path / "docs" / name).write_text(text)
    files = read_digest_files(spark, str(tmp_path))
    listed = list_digests(files)
    assert [r["name"] for r in listed.orderBy(F.col("name").desc()).collect()] == [f"2025-08-{d}-summary" for d in (18, 17, 16, 15)]
    digests = files.withColumn("path", F.element_at(F.split("path", "/"), -1)).filter("path like '%-summary.md'")
    assert rows(published.digest_status(digests), "path", F.date_format("generated_at", "dd HH:mm"), "status") == [
        ("2025-08-15-summary.md", "15 12:36", "ok"), ("2025-08-16-summary.md", "15 12:36", "ok"),
        ("2025-08-17-summary.md", "17 12:00", "failed"), ("2025-08-18-summary.md", "18 12:00", "failed")]
    sections = [("overview", "text", None, None, None), ("product", "bullet", "Tool 2.0 Released", "Article", "https://a.example/1"),
                ("product", "bullet", "Other", None, None), ("research", "bullet", "Study", "Reddit Post", "https://r.example"),
                ("promo", "bullet", "Offer", "YouTube Video", "https://v.example")]
    parsed = published.digest_rows(digests).orderBy("path", "line_no")
    for path in ("2025-08-15-summary.md", "2025-08-16-summary.md"):
        assert [tuple(r) for r in parsed.filter(F.col("path") == path).select("section", "kind", "title", "label", "url").collect()] == sections
    assert published.digest_links(digests).filter("path = '2025-08-15-summary.md'").count() == 4


def test_digest_text(spark):
    df = items(
        spark, ("Tool launched", "One tool. It is a <i>very</i> new tool for many people.", {}), ("tool LAUNCHED!", "copy", {"metadata": {"score": "3"}}),
        ("Sale", "A coupon for everybody in the whole wide world.", {"source_type": "reddit"}), ("talk", "Nothing at all to see here today.", {}), parts=3,
    )
    body = render.digest_bodies(render.digest_lines(df)).first()["body"].split("\n")
    assert body[:3] == ["## Unified Content Digest", "", "**Global Overview:**"]
    key = body.index("**Key Information:**")
    assert 3 < key <= 9
    assert body[key + 1:] == [
        "", "### Product Announcements & Releases",
        "*   **tool LAUNCHED!:** copy - (Source: Article - [https://u.example/1](https://u.example/1))",
        "", "**Promotional Offers:**",
        "*   **Sale:** A coupon for everybody in the whole wide world. - (Source: Reddit Post - [https://u.example/2](https://u.example/2))",
    ]
    again = render.digest_bodies(render.digest_lines(df.repartition(7))).first()["body"].split("\n")
    assert again == body


def test_transcripts_are_asked_for_once(spark, tmp_path):
    from tidings.operators.model import transcribe

    log = tmp_path / "calls"
    log.mkdir()

    def complete(prompt):
        import uuid

        (log / uuid.uuid4().hex).touch()
        return "said"

    told = transcribe(spark.createDataFrame([(f"u{i}",) for i in range(5)], "url string"), complete)
    assert told.count() == 5 and len(told.collect()) == 5
    assert len(list(log.iterdir())) == 5
