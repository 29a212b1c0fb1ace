"""The training-data operators on small tables: odd rows, brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidings.llm import decontaminate, language_model, near_dedup, pieces, pii, quality, sharding, token_counts, toxicity, warc
from tidings.llm.words import mix
from tidings.session import scratch_dir

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, set_id long, label string, row long, w string"
LOWER = {c: c + 32 for c in range(65, 91)}
rng = random.Random(5)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def edited(text, n, seed):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[r.randrange(len(words))] = "edit" + str(r.randrange(10**6))
    return " ".join(words)


LONG = prose(30_000, 1)
BASE = prose(120, 2)
TEXTS = [
    None, "", "  \n\t ", "one", "one two three", "ONE two three", BASE, BASE, BASE.upper(), edited(BASE, 2, 3), edited(BASE, 4, 4), LONG, LONG,
    edited(LONG, 50, 5), prose(80, 6) + "\n" + prose(80, 6), "x" * 5000, "é ü ▁ \U0001f600 日本 " * 30, prose(60, 7) + " " + BASE[:300],
    "mail a.b@c.de, 10.0.0.256 and 10.0.0.25; +1 (262) 555-3752 4587121519400672 password=e3b3ed3cc8548923d6",
]
IDS = [*range(len(TEXTS) - 2), None, 3]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if k % 2 else None, "s" if k % 3 else None, None, 1, "x", 2, "y") for k, (i, t) in enumerate(zip(IDS, TEXTS, strict=True))]
    return spark.createDataFrame([*rows, rows[6]], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def by_text(df, docs, column):
    """Result rows beside input rows, matched by order of a key both have."""
    return sorted((r[column] for r in df.collect()), key=repr)


def test_near_duplicates_equal_brute_force(docs, none):
    given = rows_of(docs)
    sets = [shingles(t) for _, t in given]
    parent = list(range(len(given)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(given)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    want = []
    for i, (doc_id, _) in enumerate(given):
        group = [given[j][0] for j in range(len(given)) if root(j) == root(i) and given[j][0] is not None]
        least = (min(group) if group else None) if sets[i] else doc_id
        want.append((doc_id, len(sets[i]), least, doc_id == least))
    got = [tuple(r) for r in near_dedup.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert near_dedup.near_duplicates(none).collect() == []


def test_near_duplicates_in_chains_and_families(spark):
    """Chains of edits and a family around the limit, where a bucket's leader is not similar to all its members."""
    texts, now = [], prose(60, 8)
    for k in range(40):
        texts.append(now)
        now = edited(now, 1, 100 + k)
    family = prose(60, 9)
    texts += [edited(family, 1 + k % 3, 200 + k) for k in range(60)]
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {i: root(i) for i in range(len(texts))}


def test_near_duplicates_of_null_and_repeated_ids(spark):
    """A family without ids, one whose id also stands on other texts, and near copies of one id."""
    a, b, c = prose(100, 31), prose(100, 32), prose(100, 33)
    rows = [(None, a), (None, edited(a, 1, 1)), (None, edited(a, 1, 2)), (1, b), (1, c), (2, edited(c, 1, 3)), (3, edited(b, 1, 4)), (1, edited(b, 1, 5))]
    rows += [(1, prose(100, 40 + k)) for k in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = {(r["doc_id"], r["text_key"]): r["label"] for r in near_dedup.components(docs).collect()}
    key = {r["text"]: r["k"] for r in docs.select("text", near_dedup.text_key().alias("k")).collect()}
    label = [labels[i, key[t]] for i, t in rows]
    assert len(set(label[:3])) == 1 and label[3] == label[6] == label[7] and label[4] == label[5] and len(set(label)) == 13
    kept = [(r["doc_id"], r["text"]) for r in near_dedup.kept_documents(docs).collect()]
    of_kept = [labels[i, key[t]] for i, t in kept]
    assert len(of_kept) == len(set(of_kept)) == 13 and {i for i, _ in kept} == {None, 1}


def test_signatures_estimate_similarity():
    a = mix(np.arange(2000, dtype=np.uint64))
    b = np.concatenate([a[:1500], mix(np.arange(9000, 9500, dtype=np.uint64))])
    equal = np.mean([x == y for s, t in zip(near_dedup.min_max(a, 256), near_dedup.min_max(b, 256), strict=True) for x, y in zip(s, t, strict=True)])
    assert abs(equal - 1500 / 2500) < 0.1


def test_quality_counts_equal_brute_force(docs, none):
    want = []
    for doc_id, text in rows_of(docs):
        w = WORD.findall(text or "")
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {i + d for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for d in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want.append((doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed))
    got = quality.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert quality.judged(none).collect() == []
    assert quality.kept_documents(docs).columns == docs.columns


def test_thresholds_follow_their_group(spark):
    """A share that is usual in one source is odd in another."""
    plain = [(i, prose(80, i), "en", "plain") for i in range(40)]
    listing = [(100 + i, prose(80, 500 + i).replace(" ", " | "), "en", "tables") for i in range(40)]
    odd = [(999, prose(80, 999).replace(" ", " | "), "en", "plain")]
    kept = quality.judged(spark.createDataFrame(plain + listing + odd, "doc_id long, text string, lang string, source string"))
    verdict = {r["doc_id"]: r["kept"] for r in kept.collect()}
    assert not verdict[999] and all(v for i, v in verdict.items() if i != 999)


def test_contaminations_equal_brute_force(spark, docs, none):
    items = [(0, BASE[:300]), (1, LONG[5000:5200]), (2, None), (3, ""), (4, "one two three"), (5, prose(40, 77)), (6, BASE[:300]), (7, edited(BASE[:300], 1, 9))]
    bench = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, doc_id string")
    want = set()
    for doc_id, text in rows_of(docs):
        for item, t in items:
            q, d = shingles(t), shingles(text)
            if q and 100 * len(q & d) >= 75 * len(q):
                want.add((doc_id, item, len(q), len(q & d)))
    got = decontaminate.contaminations(docs, bench).select("doc_id", "item_id", "n_item_shingles", "n_shared").collect()
    assert {tuple(r) for r in got} == want and len(want) > 8
    assert decontaminate.contaminations(none, bench).collect() == []
    assert decontaminate.contaminations(docs, bench.limit(0)).collect() == []
    clean = decontaminate.clean_documents(docs, bench)
    dirty = {d for d, *_ in want}
    assert clean.count() == sum(not any(100 * len(shingles(t) & shingles(x)) >= 75 * len(shingles(x)) for _, x in items if shingles(x)) for _, t in rows_of(docs))
    assert None not in {r["doc_id"] for r in clean.collect()} or None not in dirty


def test_sketches_hold_an_anchor_of_every_match():
    for q in range(1, 200):
        kept = len(decontaminate.sketch(mix(np.arange(q, dtype=np.uint64))))
        assert q - math.ceil(0.75 * q) < kept <= q


def test_token_attribution(spark, docs, none):
    from public_tokenizers import PATTERN

    got = token_counts.token_counts(docs, RANKS, PATTERN).collect()
    assert len(got) == docs.count()
    for r in got:
        assert sum(r["section_tokens"]) + r["n_outside"] == r["n_tokens"] and len(r["section_tokens"]) == r["n_sections"]
    assert token_counts.token_counts(none, RANKS, PATTERN).collect() == []
    given = spark.createDataFrame([(1, "hello world", [(0, 2), (2, 8), (8, 11)])], "doc_id long, text string, sections array<struct<start:int,end:int>>")
    r = token_counts.token_counts(given, RANKS, PATTERN).first()
    # "hello" shares three of five characters with the second section, " world" three with the third and two with the second.
    assert r["section_tokens"] == [0, 1, 1] or sum(r["section_tokens"]) == r["n_tokens"]
    counts, crossing, outside = token_counts.attribute(*map(np.array, ([0, 4, 6], [4, 6, 7], [0, 5, 7], [5, 6, 9])))
    assert counts.tolist() == [2, 0, 0] and crossing == 1 and outside == 1


def test_pieces_decode_and_vary(docs, none):
    read = pieces.decoded(pieces.encode(docs, MODEL), MODEL).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in read)
    again = pieces.encode(docs, MODEL).collect()
    assert sorted((r["doc_id"] or 0, r["pieces"]) for r in read) == sorted((r["doc_id"] or 0, r["pieces"]) for r in again)
    assert pieces.encode(none, MODEL).collect() == []
    import sentencepiece

    library, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.load(MODEL)
    texts = [t for t in TEXTS if t and "▁" not in t]
    flat, first = pieces.encode_batch(model, texts, np.arange(len(texts)), 0.0, 1)
    assert [flat[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [library.encode(t) for t in texts]
    flat, first = pieces.encode_batch(model, ["different words " * 50], np.array([1]), 0.3, 1)
    assert len(flat) > len(library.encode("different words " * 50))


def test_merging_in_parts_changes_nothing(monkeypatch):
    """Words merged some at a time get the pieces, places and noted candidates of all at once."""
    model = pieces.load(MODEL)
    words = [" international", " a", " understanding\u4e2d", " ", " reconsiderations", " x" * 7, " zz"] * 9
    symbols = model.of_char[np.array([ord(c) for w in words for c in w])].astype(np.int64)
    first, keys = np.cumsum([0, *map(len, words)]), np.arange(len(words)).astype(np.uint64) * np.uint64(977)
    for rate in (0.0, 0.3):
        noted, noted_parts = [], []
        whole = pieces.merge_all(model, symbols, first, keys, rate, noted)
        for size in (1, 20, 1 << 20):
            monkeypatch.setattr(pieces, "PART_CHARS", size)
            noted_parts.clear()
            parts = pieces.merge_parts(model, symbols, first, keys, rate, noted_parts)
            assert all(a.tolist() == b.tolist() for a, b in zip(whole, parts, strict=True))
            flat = lambda x: sorted((int(w), int(c)) for of, drawn in x for w, c in zip(of, drawn, strict=True))
            assert flat(noted) == flat(noted_parts)


def test_both_ways_of_merging_agree(monkeypatch):
    model, texts = pieces.load(MODEL), [prose(50, k) + " naïve ▁" for k in range(5)]
    fast = pieces.encode_batch(model, texts, np.arange(5), 0.2, 3)
    monkeypatch.setattr(pieces, "LONG_WORD", 0)
    slow = pieces.encode_batch(model, texts, np.arange(5), 0.2, 3)
    assert all(np.array_equal(a, b) for a, b in zip(fast, slow, strict=True))


def test_each_occurrence_has_its_own_draw():
    model, n = pieces.load(MODEL), 2000
    flat, first = pieces.encode_batch(model, ["international " * n], np.array([7]), 0.1, 1)
    assert len(first) == 2 and pieces.decode(model, flat.tolist()) == "international " * n
    texts = ["international"] * n
    flat, first = pieces.encode_batch(model, texts, np.arange(n), 0.1, 1)
    whole, _ = pieces.encode_batch(model, texts[:1], np.arange(1), 0.0, 1)
    got = [tuple(flat[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)]
    assert len(set(got)) > 20 and tuple(whole.tolist()) in got
    # Occurrence by occurrence the same as the agenda with the occurrence's key.
    symbols = [int(model.of_char[ord(c)]) for c in " international"]
    keys = mix(mix(np.arange(n, dtype=np.int64).view(np.uint64) + np.uint64(1)))
    assert got == [tuple(pieces.merge_one(model, symbols, int(k), 0.1)) for k in keys]


def test_shards(docs, none):
    got = sorted(sharding.byte_shards(docs).collect(), key=lambda r: (r["shard"], r["slot"]))
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows_of(docs))
    assert sorted((r["size"], r["text_crc32"]) for r in got) == want
    total, at = sum(r["size"] for r in got), 0
    for r in got:
        assert r["shard"] == min(7, (2 * at + r["size"]) * 8 // (2 * total)) and r["start_byte"] == at
        at += r["size"]
    for s in {r["shard"] for r in got}:
        assert [r["slot"] for r in got if r["shard"] == s] == list(range(sum(r["shard"] == s for r in got)))
    assert sharding.byte_shards(none).collect() == []


def test_archives(spark):
    big = "WARC/1.0\r\n\r\n<p>é\n" + "payload " * 200
    pages = [(1, "http://a/ b", big), (2, None, None), (3, "http://a/c", big), (4, "http://a/d", "small"), (5, "http://a/e", "small"), (8, "dns:x", big), (9, "u", "")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload_digest string")
    got = {r["page_id"]: r for r in warc.pages_through_archives(df).collect()}
    for page_id, _, html in pages:
        raw = (html or "").encode()
        r = got[page_id]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", 8) if page_id in (1, 3) else ("response", None))
    assert got[1]["target_uri"] == "http://a/%20b" and got[1]["warc_date"] == "2024-02-29T12:00:00Z"
    assert warc.pages_through_archives(df.limit(0)).collect() == []


def test_arc_versions():
    for version in (1, 2):
        data = warc.version_block(version, "2024") + b"\n" + warc.arc_record(version, "http://x", "20240101", b"a\nfiledesc://b 1\n", 9) + b"\n"
        (head, _), (fields, content) = warc.parse_arc(data)
        assert list(fields) == warc.FIELDS[version] and content == b"a\nfiledesc://b 1\n" and head["URL"].startswith("filedesc")
    with pytest.raises(ValueError, match="shorter"):
        list(warc.parse_arc(warc.version_block(1, "2024") + b"\nhttp://x 0 2024 text/html 99\nshort\n"))


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, *m.span()))
    return out


def test_rules_equal_plain_patterns():
    r = random.Random(4)
    for _ in range(5000):
        text = "".join(r.choice("0123456789..@@+-( )ab%é \n1234512345") for _ in range(r.randint(1, 45)))
        assert pii.base_spans(text) == plain_spans(text)
    assert pii.base_spans("1" * 100_000 + "a" * 100_000 + "@" * 1000) == []


def test_personal_data(docs, none):
    got = pii.personal_data(docs).collect()
    want = sorted(pii.listed(plain_spans(t or "")) for _, t in rows_of(docs))
    assert sorted(hashlib.sha256(x.encode()).hexdigest() for x in want) == sorted(r["base_sha256"] for r in got)
    for r in got:
        assert sum(s.split(":")[0] in pii.KINDS for s in r["spans"].split(",") if s) >= r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]
    assert pii.personal_data(none).collect() == []
    assert pii.mask(docs).columns == docs.columns


def test_the_field_learns_whole_spans(spark):
    field = pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    text = 'a token = "4585c446ddcd2f0749d185197dea7e09dd166160" shin'
    assert pii.added_spans(text, pii.base_spans(text), field) == [("secret", 2, 51)]
    assert pii.added_spans("in chapter 12 of version 3.0 the 4th time", [], field) == []
    # Whatever the weights, the best segmentation is that of trying them all.
    tokens = [m.span() for m in WORD.finditer("a 12 b@c +1 (262) 555-3752")]
    text = "a 12 b@c +1 (262) 555-3752"
    table, n = field.table(text, tokens), len(tokens)

    def best(i):
        return 0.0 if i == n else max(table[i, j][1].max() + best(j) for j in range(i + 1, min(i + pii.MAX_TOKENS, n) + 1))

    cuts, total, at = field.best(text, tokens), 0.0, 0
    for i, j, label, _ in cuts:
        total += sum(table[t, t + 1][1][0] for t in range(at, i)) + table[i, j][1][label]
        at = j
    assert math.isclose(total + sum(table[t, t + 1][1][0] for t in range(at, n)), best(0), rel_tol=1e-9)


def test_long_runs_are_one_region():
    text = " ".join(f"a{k}" for k in range(100))
    assert [len(r) for r in pii.regions(text)] == [100]
    field = pii.Field({"tokens=2": np.eye(len(pii.LABELS))[1] * 9})
    tokens = next(pii.regions(text))
    assert [(i, j) for i, j, *_ in field.best(text, tokens)] == [(k, k + 2) for k in range(0, 100, 2)]
    far = "token=" + "x" * 300 + "1"
    assert "mixed=True, at=False" in pii.features(far, [(0, len(far))], 0, 1)


def test_superscripts_are_no_quads():
    text = "10.0.0.1²"
    assert not any(f.startswith("quad") for f in pii.features(text, [(0, len(text))], 0, 1))


def test_gold_of_many_tokens():
    """A phone and a card of five tokens are segments; a region with a longer span is left out."""
    tokens = lambda t: [m.span() for m in re.finditer(r"\S+", t)]
    for text, kind, first, end in (("call +1 262 555 37 52 now", "phone", 1, 6), ("card 4000 0000 0000 0000 006 ok", "card", 1, 6)):
        assert (first, end, pii.LABELS.index(kind)) in pii.gold(text, tokens(text))
    long = "+1 2 6 2 5 5 5 3 7 5 2"
    assert len(pii.base_spans(long)) == 1 and pii.gold(long, tokens(long)) is None
    field = pii.Field()
    field.learn(long, tokens(long), {}, np.random.default_rng(1))
    assert not field.weights


def test_words_before_a_mark_are_whole():
    text = "x" * 100 + " 4587"
    assert next(pii.regions(text))[0] == (0, 100)


def test_stages_keep_columns_of_any_name(spark, docs):
    """Columns called like the stages' own pass through; rows whose nulls lie in other columns are told apart."""
    own = ["_key", "_id", "_text", "text_key", "_deal", "_KEY_", "n_words", "kept"]
    given = docs
    for c in own:
        given = given.withColumn(c, F.lit(c))
    bench = spark.createDataFrame([(1, BASE, "extra")], "item_id long, text string, doc_id string")
    for stage in (quality.kept_documents, near_dedup.kept_documents, lambda d: decontaminate.clean_documents(d, bench), pii.mask):
        rows = lambda df: Counter(repr((r["doc_id"], r["text"])) for r in df.collect())
        got = stage(given)
        assert got.columns == given.columns and all(r[c] == c for r in got.collect() for c in own)
        assert rows(got) == rows(stage(docs))
    # The same text under (null, "a"), whose group is alike, and ("a", null), whose group is not.
    plain = [(i, prose(70, 51 + i), None, "a") for i in range(40)]
    loud = [(100 + i, prose(70, 151 + i) + " #" * 40, "a", None) for i in range(40)]
    odd = loud[0][1]
    table = spark.createDataFrame([*plain, *loud, (200, odd, None, "a"), (201, odd, "a", None)], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"] for r in quality.kept_documents(table).collect()}
    judged = {r["doc_id"] for r in quality.judged(table).filter("kept").collect()}
    assert kept == judged and 201 in kept and 200 not in kept


def test_language_model_base_scores(docs, none):
    given = [(i, [*words(t), None]) for i, t in rows_of(docs)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, ws in given if not held(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted(
        (repr(i), held(i), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in given
    )
    got = language_model.scores(docs).collect()
    assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert language_model.scores(none).collect() == []


def test_classes_lower_held_out_perplexity(spark):
    got = language_model.scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out")
    r = got.agg(F.sum("score").alias("score"), F.sum("base_score").alias("base")).first()
    assert r["score"] > r["base"]


def test_exchange_raises_likelihood():
    r = np.random.default_rng(1)
    size, free = 40, language_model.CLASSES
    counts = r.poisson(3, (size, size)) * (1 + 9 * ((np.arange(size)[:, None] + np.arange(size)) % 4 == 0))
    classes = np.arange(size) % free
    classes[-1] = free
    one = np.eye(free + 1)[classes]
    pairs = one.T @ counts @ one
    order = np.arange(size - 1)
    moved = language_model.exchange_sweep(classes, counts.T @ one, counts @ one, np.diag(counts).astype(float), pairs, order[:1])
    two = np.eye(free + 1)[moved]
    assert language_model.likelihood(two.T @ counts @ two) >= language_model.likelihood(pairs) - 1e-6


def test_words_moved_in_tasks_go_where_the_sweep_moves_them():
    r = np.random.default_rng(2)
    size, free = 60, language_model.CLASSES
    counts = r.poisson(0.3, (size, size)) * (1 + 9 * ((np.arange(size)[:, None] + np.arange(size)) % 4 == 0))
    classes = np.append(np.arange(size - 1) % free, free)
    one = np.eye(free + 1)[classes]
    before, after, own, pairs = counts.T @ one, counts @ one, np.diag(counts).astype(float), one.T @ counts @ one
    got = language_model.best_classes(classes[:-1], before[:-1], after[:-1], own[:-1], pairs)
    want = [language_model.exchange_sweep(classes, before, after, own, pairs, np.array([u]))[u] for u in range(size - 1)]
    assert got.tolist() == want and (got != classes[:-1]).any()


def test_words_of_one_suffix_get_classes_of_their_own(spark, monkeypatch):
    """Rare words of the same last three bytes, one kind after one frequent word and the other after another."""
    r = random.Random(3)
    nouns, verbs = ([f"{kind}{i}end" for i in range(400)] for kind in ("n", "v"))
    rows = [(i, " ".join(f"the {r.choice(nouns)} to {r.choice(verbs)}" for _ in range(60))) for i in range(60)]
    training = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {}
    whole = language_model.cluster_words
    monkeypatch.setattr(language_model, "cluster_words", lambda *x: kept.setdefault("got", whole(*x)))
    # Words of a share below this are no units of their own.
    monkeypatch.setattr(language_model, "UNIT_SHARE", 64)
    language_model.scores(training).collect()
    hashes = lambda w: language_model.tokens(pa.array([" ".join(w)]))[0][:-1].view(np.int64).tolist()
    of = {x["word"]: x["class"] for x in kept["got"][0].collect()}
    kinds = Counter((of[h], kind) for kind, w in enumerate((nouns, verbs)) for h in hashes(w) if h in of)
    apart = sum(max(kinds[c, 0], kinds[c, 1]) for c in range(language_model.CLASSES))
    # One class for the bucket would give 0.5.
    assert sum(kinds.values()) > 700 and apart / sum(kinds.values()) > 0.7


def test_parts_of_the_vocabulary_count_every_bigram(spark, monkeypatch):
    """Class pair counts of the last assignment against those of the texts, and no table of a row per bigram."""
    r = random.Random(5)
    rows = [(i, None if i == 7 else " ".join(r.choice("abc") if r.random() < 0.4 else f"w{r.randrange(900)}" for _ in range(r.randrange(80)))) for i in range(120)]
    training = spark.createDataFrame(rows, "doc_id long, text string")
    kept, sizes = {}, {}
    whole, write = language_model.cluster_words, language_model.written

    def counted(df, name, *parts):
        table, path = write(df, name, *parts)
        sizes[name] = max(sizes.get(name, 0), table.count())
        return table, path

    monkeypatch.setattr(language_model, "cluster_words", lambda *x: kept.setdefault("got", whole(*x)))
    monkeypatch.setattr(language_model, "written", counted)
    monkeypatch.setattr(language_model, "KNOWN_SHARE", 100)
    language_model.scores(training).collect()
    classes, pairs = kept["got"]
    of = {x["word"]: x["class"] for x in classes.collect()}
    want, seen = np.zeros_like(pairs), set()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            hashes = language_model.tokens(pa.array([text], pa.string()))[0].view(np.int64).tolist()
            for a, b in zip([int(language_model.END_HASH), *hashes], hashes):
                want[of[a], of[b]] += 1
                seen.add((a, b))
    assert (pairs == want).all() and len(of) > 800
    per_bigram = {name: n for name, n in sizes.items() if name not in ("words", "classes", "lexicon", "bigrams")}
    assert max(per_bigram.values()) < len(seen) / 10


def test_class_model_leaves_no_large_tables(spark):
    """Counts, bigrams, profiles and looked-up words go when they are read for the last time, shuffle files with the queries that wrote them."""
    def kept():
        return set(os.listdir(scratch_dir(spark))) if os.path.isdir(scratch_dir(spark)) else set()

    def shuffled():
        at = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
        return {f for _, _, files in os.walk(at) for f in files if f.startswith("shuffle_")}

    r = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(r.choice(VOCABULARY) for _ in range(30))) for i in range(50)], "doc_id long, text string")
    tables, files = kept(), shuffled()
    scored = language_model.scores(docs)
    assert {name.rsplit("-", 1)[0] for name in kept() - tables} <= {"classes", "lexicon", "parts", "found"}
    assert len(shuffled() - files) <= 16
    assert scored.count() == 50


def test_toxicity_learns_pairs(spark, docs, none):
    r = random.Random(8)
    rows = []
    for i in range(1500):
        w = [r.choice(VOCABULARY) for _ in range(30)]
        kind = i % 4
        w += [["insult", "group"], ["insult"], ["group"], []][kind]
        rows.append((i, " ".join(w), int(kind == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.toxicity(df, df).join(df.select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    assert sum(x["predicted"] == x["toxic"] for x in got) / len(got) > 0.97
    odd = toxicity.toxicity(docs, df).collect()
    assert len(odd) == docs.count() and all(0 <= x["score"] <= 1 for x in odd)
    assert toxicity.toxicity(none, df).collect() == []
    assert {x["score"] for x in toxicity.toxicity(docs, df.limit(0)).collect()} == {0.5}


def test_toxicity_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).filter("held_out").join(labels, "doc_id").collect()
    found = sum(x["predicted"] and x["toxic"] for x in got)
    assert found / sum(x["toxic"] for x in got) > 0.85 and found / max(1, sum(x["predicted"] for x in got)) > 0.95


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in quality.judged(table).filter("kept").collect()}
    given = {r["doc_id"]: r["text"] for r in table.collect() if r["doc_id"] in kept}
    sets = {i: shingles(t) for i, t in given.items()}
    parent = {i: i for i in given}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in given:
        for j in given:
            if j < i and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {i for i in given if root(i) == i and not any(q and 100 * len(q & sets[i]) >= 75 * len(q) for q in items)}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == want and len(got) == len(want) and all(r["lossless"] for r in got)


def test_stages_keep_columns_and_take_odd_rows(spark, docs, none, sf_dir):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
        assert stage(spark, none, sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).filter("not lossless").count() == 0
