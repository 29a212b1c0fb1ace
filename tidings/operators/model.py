"""M3, M4: the step that hands text to a model.

A model is a callable from a text to a text, or a client: a factory that each task calls once, in the task, for a callable
from a list of texts to a list of texts. Clients need not be picklable, and get their requests in batches of bounded size.
"""

from __future__ import annotations

import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidings.session import ship_package, through_table

# What stands in the digest when the model gives nothing or fails.
NO_REPLY = "Failed to generate summary."
ERROR_PREFIX = "Error generating summary: "
TRACE_LINES = 5

TRANSCRIBE_PROMPT = "Provide a full transcript for this video: "


Client = Callable[[list[str]], list[str | None]]
Answer = tuple[str, str, str | None]

# Requests that go to a client together: how many, and characters in all (a longer one goes alone).
BATCH_REQUESTS, BATCH_CHARS = 16, 200_000


def one_by_one(complete: Callable[[str], str | None]) -> Callable[[], Client]:
    """A model of single texts as a client's factory."""
    return lambda: lambda texts: [complete(text) for text in texts]


def _failure(e: Exception) -> Answer:
    trace = "".join(traceback.format_exception_only(e)) + "".join(traceback.format_tb(e.__traceback__))
    head = "\n".join(trace.splitlines()[:TRACE_LINES])
    return f"{ERROR_PREFIX}{e}\n{head}", "failed", str(e)


def packed(sizes: list[int], requests: int, chars: int) -> Iterator[range]:
    """Neighbouring requests in batches of at most so many and so many characters, each of one request at least."""
    start, total = 0, 0
    for at, size in enumerate(sizes):
        if at > start and (at - start >= requests or total + size > chars):
            yield range(start, at)
            start, total = at, 0
        total += size
    if start < len(sizes):
        yield range(start, len(sizes))


def _asked(client: Client, texts: list[str], attempts: int) -> list[Answer]:
    """The answers to a batch. If the call for it fails, each of its texts is asked for by itself, up to ``attempts`` times in
    all, so that a bad text fails alone and only what failed is asked for again."""
    def answered(reply: str | None) -> Answer:
        return (NO_REPLY, "failed", None) if reply is None else (reply, "ok", None)

    try:
        replies = client(texts)
        if len(replies) != len(texts):
            raise ValueError(f"{len(replies)} replies to {len(texts)} requests")
        return [answered(reply) for reply in replies]
    except Exception as e:  # noqa: BLE001 - any failure of the model is data
        if len(texts) > 1:
            return [_asked(client, [text], attempts)[0] for text in texts]
        return _asked(client, texts, attempts - 1) if attempts > 1 else [_failure(e)]


def call_client(
    requests: DataFrame, prompt: str, connect: Callable[[], Client], reply: str = "reply", partitions: int | None = None,
    batch_requests: int = BATCH_REQUESTS, batch_chars: int = BATCH_CHARS, attempts: int = 2,
) -> DataFrame:
    """Adds ``reply``, ``status`` and ``error`` to each request. ``connect`` is called once per task that has requests. A failing
    call is a row with status ``failed`` whose reply says so; it never fails the job. Calls are slow and requests
    few, so these are dealt out to ``partitions`` tasks (all cores by default) instead of staying in the few partitions their size asks for.
    """
    ship_package(requests.sparkSession)
    partitions = partitions or requests.sparkSession.sparkContext.defaultParallelism
    kept = [f for f in requests.schema.fields if f.name != prompt]
    schema = T.StructType(kept + T.StructType.fromDDL(f"{reply} string, status string, error string").fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        for batch in batches:
            texts = list(batch.pop(prompt))
            if texts and client is None:
                client = connect()
            answers = []
            for some in packed([len(text or "") for text in texts], batch_requests, batch_chars):
                answers += _asked(client, [texts[i] for i in some], attempts)
            columns = dict(zip((reply, "status", "error"), zip(*answers, strict=True), strict=True)) if answers else {reply: [], "status": [], "error": []}
            yield batch.assign(**{name: list(values) for name, values in columns.items()})[schema.names]

    return requests.repartition(partitions).mapInPandas(run, schema)


def call_model(
    requests: DataFrame, prompt: str, complete: Callable[[str], str | None], reply: str = "reply",
    partitions: int | None = None,
) -> DataFrame:
    """``call_client`` for a model of single texts: one call per row, none twice."""
    return call_client(requests, prompt, one_by_one(complete), reply, partitions, batch_requests=1, attempts=1)


def call_client_once(requests: DataFrame, prompt: str, connect: Callable[[], Client], reply: str = "reply", **settings) -> DataFrame:
    """``call_client`` as a table: replies are not repeatable, so they are written once and read from there."""
    return through_table(call_client(requests, prompt, connect, reply, **settings), "replies")


def call_model_once(requests: DataFrame, prompt: str, complete, reply: str = "reply", partitions: int | None = None):
    """M3 as a table: replies are not repeatable, so they are written once and read from there."""
    return through_table(call_model(requests, prompt, complete, reply, partitions), "replies")


def transcribe(videos: DataFrame, complete: Callable[[str], str | None], partitions: int | None = None) -> DataFrame:
    """M4: ``url, transcript, status`` for each distinct url, written once; the table J3 joins. A failed call's transcript is the text
    that says so; keep only status ``ok`` to leave such items as they are."""
    asked = videos.select("url").distinct().withColumn("prompt", F.concat(F.lit(TRANSCRIBE_PROMPT), F.col("url")))
    replies = call_model_once(asked, "prompt", complete, "transcript", partitions)
    return replies.select("url", "transcript", "status")
