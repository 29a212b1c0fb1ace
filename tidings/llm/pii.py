"""Operator 7, personal data by rules and a semi-Markov conditional random field.

The rules find four kinds in every whole text (``base_spans``): email, ip, card, phone. The random field adds what they
miss. A text's tokens with a digit or an ``@``, and their neighbours (``NEIGHBOURS`` in front), form regions; every run of up to ``MAX_TOKENS`` tokens of a
region is a candidate segment, and features of the whole run (its digits and their groups, its characters' kinds, checksum, key in
front, length, number of tokens, the word before) score it for each kind or for none. A dynamic program over the region
chooses boundaries and kinds together, so a number is never both part of a phone number and a card. Spans of the field that touch
a rule's span are dropped, as are those whose own score over "none" is below ``MARGIN``.

The field is trained here by its likelihood, on regions of a bounded sample of texts (``TRAIN_TEXTS``, chosen by
hash, and at most ``TRAIN_REGIONS`` of their regions): the rules' spans and keyed secrets are the segments. Long runs are sampled in parts of ``REGION_TOKENS`` tokens, parts of more than
``REGION_CHARS`` characters or with a span of more than ``MAX_TOKENS`` tokens aren't learnt from (all are searched). Parts of the features
are left out at random in training, so that a span is known by several of its marks and not by the rule's own sign alone.

Defined results: null and empty texts have no span; spans count code points, end exclusive; repeated rows stay; a text of
any length is read whole, and all searches are linear in it; other columns are ignored; an empty table gives an empty
table; without any region the field finds nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidings.llm.common import prepare

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS, "secret")
MAX_TOKENS = 8
REGION_TOKENS = 24
REGION_CHARS = 1000
TRAIN_TEXTS = 20_000
TRAIN_REGIONS = 1_500
EPOCHS = 6
LEFT_OUT = 0.1
MARGIN = 2.0

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]*[0-9](?<=[\x20().0-9-][0-9])")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
GAPS = " \t\n\x0b\x0c\r"
#: Tokens before a region's first mark that belong to it.
NEIGHBOURS = 2
_MARKED = re.compile(r"[0-9@]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: from each ``@`` back over the characters of a local part, on over those of a domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and _LOCAL_END.match(text[start - 1]):
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            free = found.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)


def base_spans(text: str) -> list[Span]:
    """The rules' spans by kind and place, leftmost and without overlap within a kind; failing matches are dropped."""
    out: list[Span] = list(_emails(text)) if "@" in text else []
    if not re.search("[0-9]", text):
        return out
    if "." in text:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if m.end() - m.start() >= 4 and 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def regions(text: str) -> Iterator[list[tuple[int, int]]]:
    """Token spans of each region: marked tokens and those before the first, as long as the run goes on.
    Only the surroundings of marks are looked at."""
    run: list[tuple[int, int]] = []
    at = 0
    while found := _MARKED.search(text, at):
        start = found.start()
        while start > at and not text[start - 1] in GAPS:
            start -= 1
        token = _TOKEN.match(text, start)
        if run and text[run[-1][1] : start].strip(GAPS):
            yield run
            run = []
        if not run:
            before = start
            for _ in range(NEIGHBOURS):
                while before > at and text[before - 1] in GAPS:
                    before -= 1
                first = before
                while first > at and text[first - 1] not in GAPS:
                    first -= 1
                if first < before:
                    run.insert(0, (first, before))
                before = first
        run.append((start, token.end()))
        # A short word between two marked tokens keeps them in one region.
        after = _TOKEN.search(text, token.end())
        at = token.end()
        if after and after.end() - after.start() <= 3 and not _MARKED.search(after.group()):
            follow = _TOKEN.search(text, after.end())
            if follow and _MARKED.search(text, follow.start(), follow.end()):
                run.append(after.span())
                at = after.end()
    if run:
        yield run


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without the punctuation and quotes around it."""
    while start < end and text[start] in "\"'([{<,;:.!?":
        start += 1
    while end > start and text[end - 1] in "\"')]}>,;:.!?":
        end -= 1
    return start, end


def features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Features of the tokens ``i`` to ``j - 1`` as one span."""
    start, end = trimmed(text, tokens[i][0], tokens[j - 1][1])
    span = text[start:end]
    digits = re.sub("[^0-9]", "", span)
    n, letters = len(digits), sum(c.isalpha() for c in span)
    out = ["bias", f"tokens={j - i}", f"digits={n if n < 20 else 20}", f"digit_class={0 if n == 0 else 1 if n < 8 else 2 if n < 13 else 3 if n < 20 else 4}"]
    if not letters and n:
        out.append("numeric")
    if 13 <= n <= 19 and not letters:
        out.append(f"luhn={luhn(digits)}")
    out.append(f"at={span.count('@')}" if "@" not in span else f"at={'.' in span.split('@')[-1]}")
    out.append(f"mixed={bool(n and letters)}, at={'@' in span}")
    parts = span.split(".")
    if len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) for p in parts):
        out.append(f"quad={max(map(int, parts)) <= 255}")
    if re.fullmatch(r"\+?[0-9() .-]+", span) and 8 <= n <= 15:
        out.append(f"dialled={'(' in span or '-' in span}")
        out.append(f"plus={span[0] == '+'}")
    tail = re.split(r"[=:\s\"']+", span)[-1]
    if len(tail) >= 16 and re.fullmatch(r"[A-Za-z0-9+/_-]+", tail) and re.search("[0-9]", tail) and re.search("[A-Za-z]", tail):
        out += ["mixed_run", f"mixed_length={min(len(tail) // 4, 10)}", f"hex={bool(re.fullmatch('[0-9a-f]+', tail))}"]
    key = re.match(r"([A-Za-z_]+)\s*[=:]", span)
    if key:
        out.append(f"keyed={key.group(1).lower() in SECRET_KEYS}")
    if letters:
        out.append(f"letters={min(letters // 4, 5)}")
    if i:
        before = text[tokens[i - 1][0] : tokens[i - 1][1]]
        out.append(f"before_marked={bool(_MARKED.search(before))}")
    out.append(f"edge={j < len(tokens) and bool(_MARKED.search(text[tokens[j][0] : tokens[j][1]]))}")
    return out


SECRET_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key")
_SECRET = re.compile(r"\b(?:" + "|".join(SECRET_KEYS) + r")\s*[=:]\s*[\"']?[A-Za-z0-9+/_-]{12,}[\"']?|\bAKIA[A-Z0-9]{16}\b")


def gold(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]] | None:
    """The training segments ``(first token, end token, label)`` of a region, ``none`` for single tokens between them; null for a region with a
    span of more than ``MAX_TOKENS`` tokens, whose tokens would count as ``none``."""
    start, end = tokens[0][0], tokens[-1][1]
    near = text[start:end]
    spans = [(k, a + start, b + start) for k, a, b in base_spans(near)]
    spans += [("secret", m.start() + start, m.end() + start) for m in _SECRET.finditer(near)]
    cover: dict[int, tuple[int, int, int]] = {}
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        inside = [t for t, (x, y) in enumerate(tokens) if x < b and y > a]
        if len(inside) > MAX_TOKENS:
            return None
        if inside and not any(t in cover for t in inside):
            segment = (inside[0], inside[-1] + 1, LABELS.index(kind))
            cover.update(dict.fromkeys(inside, segment))
    return sorted({cover.get(t, (t, t + 1, 0)) for t in range(len(tokens))})


class Field:
    """Weights by feature and label. ``none`` labels single tokens only; segments of other labels have up to
    ``MAX_TOKENS`` tokens."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        self.weights = weights if weights is not None else {}
        self.zero = np.zeros(len(LABELS))

    def scores(self, found: list[str], tokens: int) -> np.ndarray:
        s = np.sum([self.weights.get(f, self.zero) for f in found], axis=0)
        if tokens > 1:
            s[0] = -1e9
        return s

    def table(self, text: str, tokens: list[tuple[int, int]], drop: np.random.Generator | None = None):
        """Features and scores of all segments, by first and end token."""
        out = {}
        for i in range(len(tokens)):
            for j in range(i + 1, min(i + MAX_TOKENS, len(tokens)) + 1):
                found = features(text, tokens, i, j)
                if drop is not None:
                    found = [f for f, x in zip(found, drop.random(len(found)), strict=True) if x >= LEFT_OUT or f == "bias"]
                out[i, j] = (found, self.scores(found, j - i))
        return out

    def best(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int, float]]:
        """The best segmentation: ``(first, end, label, score over none)`` of the segments that aren't ``none``."""
        # Scores are made as the program reaches them, so a long run costs memory for its choices only.
        n = len(tokens)
        value, choice, none = [0.0] + [-1e18] * n, [None] * (n + 1), [0.0] * n
        for j in range(1, n + 1):
            for i in range(max(0, j - MAX_TOKENS), j):
                s = self.scores(features(text, tokens, i, j), j - i)
                if i == j - 1:
                    none[i] = s[0]
                label = int(np.argmax(s))
                if value[i] + s[label] > value[j]:
                    value[j], choice[j] = value[i] + s[label], (i, label, s[label])
        out, j = [], n
        while j:
            i, label, score = choice[j]
            if label:
                out.append((i, j, label, score - sum(none[i:j])))
            j = i
        return out[::-1]

    def learn(self, text: str, tokens: list[tuple[int, int]], squares: dict[str, np.ndarray], drop: np.random.Generator) -> None:
        """One adaptive step up the region's log likelihood: true segments against their expectation, which sums over all
        segmentations. Regions without gold segments teach nothing."""
        segments = gold(text, tokens)
        if segments is None:
            return
        table, n = self.table(text, tokens, drop), len(tokens)
        forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        forward[0] = backward[n] = 0.0
        whole = {k: np.logaddexp.reduce(s) for k, (_, s) in table.items()}
        for (i, j), v in sorted(whole.items(), key=lambda x: x[0][1]):
            forward[j] = np.logaddexp(forward[j], forward[i] + v)
        for (i, j), v in sorted(whole.items(), key=lambda x: -x[0][0]):
            backward[i] = np.logaddexp(backward[i], backward[j] + v)
        true = {(i, j): label for i, j, label in segments}
        slope: dict[str, np.ndarray] = {}
        for (i, j), (found, s) in table.items():
            g = -np.exp(np.clip(forward[i] + s + backward[j] - forward[n], -700, 0))
            if (i, j) in true:
                g[true[i, j]] += 1
            for f in found:
                slope[f] = slope.get(f, self.zero) + g
        for f, g in slope.items():
            squares[f] = squares.get(f, self.zero) + g**2
            w = self.weights.get(f, self.zero)
            self.weights[f] = w + 0.3 * (g - 1e-3 * w) / np.sqrt(squares[f] + 1e-2)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            for run in regions(text or ""):
                # The sample is of short parts of runs; whole runs are searched.
                for tokens in (run[k : k + REGION_TOKENS] for k in range(0, len(run), REGION_TOKENS)):
                    start, end = tokens[0][0], tokens[-1][1]
                    if end - start <= REGION_CHARS:
                        out.append(text[start:end])
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["region"])


def train(docs: DataFrame) -> Field:
    """The field, fitted on the driver to a bounded number of short regions; chosen and ordered by hash."""
    prepare(docs.sparkSession)
    share = min(1.0, TRAIN_TEXTS / max(docs.count(), 1))
    texts = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = texts.mapInArrow(_sampled, "region string").distinct().orderBy(F.xxhash64("region"), "region").limit(TRAIN_REGIONS).collect()
    field, squares, drop = Field(), {}, np.random.default_rng(11)
    for _ in range(EPOCHS):
        for r in found:
            tokens = [m.span() for m in _TOKEN.finditer(r["region"])]
            field.learn(r["region"], tokens, squares, drop)
    return field


def added_spans(text: str, base: list[Span], field: Field) -> list[Span]:
    """What the field finds apart from the rules' spans."""
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else []
    out = []
    for tokens in regions(text):
        for i, j, label, over in field.best(text, tokens) if field.weights else []:
            a, b = trimmed(text, tokens[i][0], tokens[j - 1][1])
            before = int(np.searchsorted(starts, b, side="left"))
            if over >= MARGIN and a < b and not (before and reach[before - 1] > a):
                out.append((LABELS[label], a, b))
    return out


def all_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    base = base_spans(text)
    return base, base + added_spans(text, base, field)


def listed(spans: list[Span]) -> str:
    """Spans as text, by kind in the order of ``LABELS`` and then by place."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (LABELS.index(s[0]), s[1], s[2])))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _found(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(sent.value)
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, spans = all_spans(text or "", field)
                kinds = [k for k, _, _ in base]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], [x.split(" ")[0] for x in SCHEMA.split(", ")])

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data per row of ``docs(doc_id, text)``."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs).weights)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_found(sent), SCHEMA)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first and longest counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def _masked(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(sent.value)
        for batch in batches:
            texts = [None if t is None else masked(t, all_spans(t, field)[1]) for t in batch.column("text").to_pylist()]
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, "text", pa.array(texts, pa.string()))

    return run


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced by its kind."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs).weights)
    return docs.mapInArrow(_masked(sent), docs.schema)
