"""Personal data: exact patterns, and a character-level tagger that adds what they miss.

The base patterns give spans of four kinds and are kept as they are. A bidirectional LSTM with CRF transitions
(``bilstm_crf``) is trained in numpy on windows labelled by those spans. All kinds hold a digit or ``@``, so the tagger
reads every window of ``WIDTH`` characters, half overlapping, that has one of these; each window answers for its middle
half, so that every character is judged once with context on both sides, and the joined tags of a whole text give its
spans. A tagged span is added where it meets no base span and has its kind's least shape.

Training takes about ``TRAIN_DOCS`` documents with such characters, chosen by hash at a counted rate; only their windows
around these characters reach the driver. Tagging is one narrow pass over all whole texts.

Defined results: null and empty texts have no spans; offsets are code points; repeated rows get equal results; without
any base span in the sample nothing is added; empty tables give no rows; very long texts are tagged whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuequarry.llm import bilstm_crf
from issuequarry.llm.common import batches, sampled
from issuequarry.session import checkpointed

#: Kinds in the order of the output, and their fixed patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CUE = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[0-9]")

WIDTH, STEP = 64, 32
TRAIN_DOCS = 1500
TRAIN_WINDOWS = 4000
ROUNDS = 220
TAGS = 1 + 2 * len(KINDS)
#: O, then B and I of each kind; I follows B or I of its kind.
_ALLOWED = np.ones((TAGS, TAGS), dtype=bool)
for _k in range(len(KINDS)):
    _ALLOWED[:, 2 + 2 * _k] = False
    _ALLOWED[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = True

Span = tuple[int, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches: a match starts where the run of local characters before an ``@`` starts, or the last one ended."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            done = found.end()
            yield start, done, 0
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns, by start and then kind."""
    spans = list(_emails(text)) if "@" in text else []
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                spans.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                spans.append((m.start(), m.end(), 2))
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m.group())) <= 15:
                spans.append((m.start(), m.end(), 3))
    return sorted(spans, key=lambda s: (s[0], s[2], s[1]))


def window_starts(text: str) -> list[int]:
    """Starts of the windows whose middle half, or the text's edge, is needed to judge all cues and what is around them."""
    starts: dict[int, None] = {}
    for m in _CUE.finditer(text):
        k = m.start() // STEP
        for near in (k - 1, k, k + 1):
            starts[near * STEP - STEP // 2] = None
    return sorted(s for s in starts if s + STEP // 2 < len(text) and s + WIDTH - STEP // 2 > 0)


def window_ids(ids: np.ndarray, start: int) -> np.ndarray:
    """Character ids of one window, 0 outside the text."""
    out = np.zeros(WIDTH, dtype=np.int64)
    lo, hi = max(0, start), min(len(ids), start + WIDTH)
    out[lo - start : hi - start] = ids[lo:hi]
    return out


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(length, dtype=np.int64)
    for start, end, kind in spans:
        if not tags[start:end].any():
            tags[start:end] = 2 + 2 * kind
            tags[start] = 1 + 2 * kind
    return tags


def _least_shape(text: str, kind: int) -> bool:
    digits = len(_DIGITS.findall(text))
    if kind == 0:
        return "@" in text and "." in text[text.index("@") :] and len(text) >= 6
    return text.count(".") == 3 and digits >= 4 if kind == 1 else digits >= (12 if kind == 2 else 9)


def tagged_spans(texts: list[str], model: dict[str, np.ndarray] | None) -> list[list[Span]]:
    """Spans the tagger sees in each text, from the middle halves of its windows joined over the whole text."""
    if model is None:
        return [[] for _ in texts]
    wanted = [(k, s) for k, text in enumerate(texts) for s in window_starts(text)]
    ids = {k: bilstm_crf.char_ids(texts[k]) for k in {k for k, _ in wanted}}
    found: list[list[Span]] = [[] for _ in texts]
    tags: dict[int, np.ndarray] = {k: np.zeros(len(texts[k]), dtype=np.int64) for k in ids}
    for at in range(0, len(wanted), 512):
        part = wanted[at : at + 512]
        paths = bilstm_crf.decode(model, np.stack([window_ids(ids[k], s) for k, s in part]), _ALLOWED)
        for (k, s), path in zip(part, paths):
            lo, hi = max(0, s + STEP // 2), min(len(tags[k]), s + WIDTH - STEP // 2)
            tags[k][lo:hi] = path[lo - s : hi - s]
    for k, row in tags.items():
        at = np.flatnonzero(row)
        for run in np.split(at, np.flatnonzero((np.diff(at) > 1) | (row[at[1:]] % 2 == 1) | ((row[at[1:]] - 1) // 2 != (row[at[:-1]] - 1) // 2)) + 1) if len(at) else ():
            kind = int(row[run[0]] - 1) // 2
            start, end = int(run[0]), int(run[-1]) + 1
            if _least_shape(texts[k][start:end], kind):
                found[k].append((start, end, kind))
    return found


def all_spans(texts: list[str], model: dict[str, np.ndarray] | None) -> list[tuple[list[Span], list[Span]]]:
    """Per text the base spans, and these with the added ones."""
    base = [base_spans(t) for t in texts]
    out = []
    for own, more in zip(base, tagged_spans(texts, model)):
        new = [s for s in more if all(s[1] <= b[0] or s[0] >= b[1] for b in own)]
        out.append((own, sorted([*own, *new], key=lambda s: (s[0], s[2], s[1]))))
    return out


def _training(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches(stream):
        ids, tags = [], []
        for text in batch.column("text").to_pylist():
            chars, gold = bilstm_crf.char_ids(text), tags_of(len(text), base_spans(text))
            for s in window_starts(text):
                ids.append(window_ids(chars, s).astype(np.int8).tobytes())
                tags.append(window_ids(gold, s).astype(np.int8).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(tags, pa.binary())], names=["ids", "tags"])


def learn(docs: DataFrame, about: int = TRAIN_DOCS, rounds: int = ROUNDS) -> dict[str, np.ndarray] | None:
    """The tagger of about ``about`` documents with cues and ``TRAIN_WINDOWS`` of their windows; None without a labelled span."""
    with_cue = docs.select("doc_id", "text").filter(F.col("text").rlike("[0-9@]"))
    windows = checkpointed(sampled(with_cue, ["doc_id", "text"], about).mapInArrow(_training, "ids binary, tags binary"), "pii-windows")
    rows = sampled(windows, ["ids", "tags"], TRAIN_WINDOWS).orderBy("ids", "tags").toArrow()
    if not rows.num_rows:
        return None
    ids, tags = (np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype=np.int8).reshape(-1, WIDTH).astype(np.int64) for c in ("ids", "tags"))
    return bilstm_crf.train(ids, tags, TAGS, rounds) if tags.any() else None


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def detect(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """One row per document: counts of base spans by kind, their digest, and all spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def find(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            found = all_spans([t or "" for t in batch.column("text").to_pylist()], model)
            counts = [[sum(s[2] == k for s in own) for own, _ in found] for k in range(len(KINDS))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts),
                    pa.array([hashlib.sha256(_written(own).encode()).hexdigest() for own, _ in found], pa.string()),
                    pa.array([_written(every) for _, every in found], pa.string()),
                ],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, {counts}, base_sha256 string, spans string")


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one replacement."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def masked(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """The documents, all their columns, with personal data masked in ``text``; null texts stay null."""
    schema = docs.schema
    columns = docs.columns

    def apply(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(stream):
            texts = batch.column("text").to_pylist()
            found = all_spans([t or "" for t in texts], model)
            new = pa.array([t if t is None else mask(t, every) for t, (_, every) in zip(texts, found)], batch.column("text").type)
            yield pa.RecordBatch.from_arrays([new if c == "text" else batch.column(c) for c in columns], names=columns)

    return docs.mapInArrow(apply, schema)
