"""Operator 1, token counts per section by offset-mapped attribution.

A document is encoded once and as a whole. Each token's character span follows from the byte lengths of the tokens
before it, and is joined as an interval with the spans of the document's sections (by default its lines without their
line ends). A token belongs to the section it shares most characters with, the earlier of two equal ones; a token that
touches two or more sections counts as crossing as well, one that touches none (a line end) as outside. So each token is
counted exactly once: the sections' tokens and those outside add up to the document's.

Sections may be given as ``sections``, an array of structs ``start`` and ``end`` in characters, end exclusive, in order
and without overlap. Both sides of the interval join are sorted, so it is two binary searches per token.

Defined results: null and empty texts have no token and one empty section; an empty section has no token; a character
cut by two tokens belongs to both spans; special tokens' strings are ordinary text; repeated rows stay; other columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import prepare, ship_file

SCHEMA = "doc_id long, n_tokens long, n_sections long, n_crossing long, n_outside long, section_tokens array<int>"


@functools.lru_cache(maxsize=2)
def _encoding(name: str, pattern: str):
    import tiktoken

    with open(SparkFiles.get(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("landed", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens from the bytes of a text and the tokens' byte lengths."""
    ends = np.cumsum(lengths)
    leads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    starts = ends - lengths
    inside = (data[starts] & 0xC0) == 0x80
    return leads[starts] - inside, leads[ends]


def attribute(start: np.ndarray, end: np.ndarray, section_start: np.ndarray, section_end: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Tokens per section, and how many tokens cross sections and lie outside them."""
    counts = np.zeros(len(section_start), np.int64)
    real = np.flatnonzero(section_end > section_start)
    s, e = section_start[real], section_end[real]
    first = np.searchsorted(e, start, side="right")
    last = np.searchsorted(s, end, side="left") - 1
    owner = np.where(first <= last, first, -1)
    crossing = np.flatnonzero(first < last)
    for t in crossing:
        touched = np.arange(first[t], last[t] + 1)
        shared = np.minimum(e[touched], end[t]) - np.maximum(s[touched], start[t])
        owner[t] = touched[np.argmax(shared)]
    if len(real):
        counts[real] = np.bincount(owner[owner >= 0], minlength=len(real))
    return counts, len(crossing), int((owner < 0).sum())


def line_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the lines of a text, without the line ends."""
    breaks = np.cumsum((data & 0xC0) != 0x80)[data == 10] - 1
    length = int(((data & 0xC0) != 0x80).sum())
    return np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [length]])


def _attributed(name: str, pattern: str, given: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = _encoding(name, pattern)
        for batch in batches:
            rows = []
            sections = batch.column("sections").to_pylist() if given else [None] * batch.num_rows
            for text, spans in zip(batch.column("text").to_pylist(), sections, strict=True):
                data = np.frombuffer((text or "").encode(), np.uint8)
                if given:
                    s, e = (np.array([x[k] for x in spans or []], np.int64) for k in ("start", "end"))
                else:
                    s, e = line_spans(data)
                if len(data):
                    start, end = token_spans(data, lengths[encoding.encode_ordinary(text)])
                else:
                    start = end = np.zeros(0, np.int64)
                counts, crossing, outside = attribute(start, end, s, e)
                rows.append((len(start), len(s), crossing, outside, counts.astype(np.int32)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *arrays], ["doc_id", "n_tokens", "n_sections", "n_crossing", "n_outside", "section_tokens"]
            )

    return run


def token_counts(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Tokens per section of ``docs(doc_id, text[, sections])``. ``vocabulary`` is the path of a file of ranks; Spark hands
    it to the workers. ``pattern`` splits a text before merging."""
    spark = docs.sparkSession
    prepare(spark)
    ship_file(spark, vocabulary)
    given = "sections" in docs.columns
    picked = docs.select(F.col("doc_id").cast("long"), "text", *(["sections"] if given else []))
    return picked.mapInArrow(_attributed(os.path.basename(vocabulary), pattern, given), SCHEMA)
