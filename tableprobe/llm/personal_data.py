"""Personal data: fixed patterns, and a character tagger that adds what they miss.

The tagger (``tagger.py``) is trained on labelled spans: generated e-mail addresses,
IP addresses, card and phone numbers in many notations, and numbers that are none of
these, set into snippets of a bounded sample of the documents. Every span of these
kinds has a digit or an "@", so texts are read around these characters only, all of
them: around digits that stand near each other, and around each "@" with the words
beside it. Such a run stands whole in one window if it fits, else in overlapping ones
(windows around addresses are as wide as these, up to ``WIDEST``); where a tagged span reaches the last character that was read, reading goes on. Each
character takes its tag from a window that holds its run, and of these from that in
which it stands furthest from the edges; runs of one tag become spans. A span is added if
its content is plausible for its kind and it touches no span found before.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.llm.arrow import chunks, text_bytes
from tableprobe.llm.tagger import PAD, Tagger, codes

KINDS = ("email", "ip", "card", "phone")
#: Documents whose text is used for training, and the number of training windows.
SAMPLE_DOCS = 200
TRAINING_WINDOWS = 2400
WINDOW = 64
#: Of a window around an address that does not fit ``WINDOW``; addresses have 320 characters at most.
WIDEST = 512
STRIDE = 32
MARGIN = 20

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
NUMBERS = re.compile(r"[0-9](?:[^0-9@]{0,4}+[0-9])*+")
WORD = re.compile(r"\S+")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def plausible(kind: int, text: str) -> bool:
    """Whether the content of a span can be of its kind."""
    if kind == 0:
        return "@" in text
    digits = "".join(DIGIT.findall(text))
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) == 4 and all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in (y.lstrip("0") or "0" for y in parts))
    if kind == 2:
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of the patterns, without overlaps within a kind, that are plausible."""
    found: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            found.append((0, start, match.end()))
            last = match.end()
        at = text.find("@", max(at + 1, last))
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if plausible(kind, m[0])]
    return sorted(found, key=lambda s: (s[1], s[0]))


# --- training ---------------------------------------------------------------------------------------


def _luhn_number(rng: random.Random, size: int) -> str:
    head = "".join(str(rng.randrange(10)) for _ in range(size - 1))
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def generated(rng: random.Random, kind: int) -> str:
    """A span of a kind in one of many notations."""
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwy") for _ in range(rng.randint(2, 9)))
    digits = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    if kind == 0:
        local = rng.choice([word(), f"{word()}.{digits(2)}", f"{word()}_{word()}", f"{word()}.{word()}", f"{word()}+{word()}", digits(4) + word()])
        host = rng.choice([f"{word()}.com", f"mail{digits(1)}.{word()}.com", f"{word()}-{word()}.org", f"{word()}.co.uk", "example.com"])
        return rng.choice([f"{local}@{host}", f"{local} @ {host}", f"{local}@{host}", f"{local}@{host}".upper()])
    if kind == 1:
        return rng.choice([".", ".", ".", " . "]).join(str(rng.randrange(256)) for _ in range(4))
    if kind == 2:
        number = _luhn_number(rng, rng.choice([14, 15, 16, 16, 16, 16, 19]))
        mark = rng.choice(["", "", " ", "-", ".", "/"])
        return mark.join(number[k : k + 4] for k in range(0, len(number), 4))
    a, b, c = digits(3), digits(3), digits(4)
    country = rng.choice(["+1", "+44", "+49", "001", "+1", "1"])
    return rng.choice([f"{country} ({a}) {b}-{c}", f"{country}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{country} {a} {b} {c}", f"{a}.{b}.{c}", f"+{digits(11)}"])


def unrelated(rng: random.Random) -> str:
    """Numbers and signs that are no personal data."""
    n = rng.randrange
    return rng.choice(
        [str(n(3000)), f"{n(100)}.{n(100)}", f"{1900 + n(130)}-{n(12) + 1:02}-{n(28) + 1:02}", f"{n(24)}:{n(60):02}", f"${n(10000)}.{n(100):02}",
         f"v{n(9)}.{n(20)}.{n(9)}", f"{n(100)}%", "%032x" % rng.getrandbits(128), f"@{n(99)}", f"{n(9)} {n(9)} {n(9)}", f"1,{n(1000):03},{n(1000):03}"]
    )


def training_windows(snippets: list[str], count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters and tags (0: none, else kind + 1) of windows with generated spans."""
    rng = random.Random(seed)
    x, y = np.full((count, WINDOW), PAD), np.zeros((count, WINDOW), np.int64)
    for n in range(count):
        kind = rng.choice([None, 0, 1, 2, 3])
        span = unrelated(rng) if kind is None else generated(rng, kind)
        text = rng.choice(snippets)
        cut = rng.randrange(len(text) + 1)
        head, tail = text[:cut], text[cut:]
        glue = rng.choice([(" ", " "), (" ", " "), (" ", "."), (": ", ", "), ("(", ")"), ("\n", "\n")])
        begin = rng.randint(0, WINDOW - min(len(span), WINDOW))
        left = (head + glue[0]).rjust(begin)[-begin:] if begin else ""
        whole = (left + span + glue[1] + tail)[:WINDOW]
        x[n, : len(whole)] = codes(whole)
        if kind is not None:
            y[n, len(left) : min(len(left) + len(span), WINDOW)] = kind + 1
    return x, y


def train(docs: DataFrame, count: int = TRAINING_WINDOWS, epochs: int = 8, seed: int = 7) -> Tagger:
    """A tagger for these documents. The sample is bounded; an empty table gives plain snippets."""
    sample = docs.select(F.substring("text", 1, 2000).alias("text")).where("text <> ''").select("text", F.md5("text").alias("h")).orderBy("h").limit(SAMPLE_DOCS)
    texts = sorted(r["text"] for r in sample.select("text").collect())
    snippets = [re.sub(r"\S*[0-9@]\S*", " ", t)[k : k + 60] for t in texts for k in range(0, min(len(t), 600), 60)] or ["some words and more"]
    tagger = Tagger(len(KINDS) + 1, seed=seed)
    tagger.fit(*training_windows(snippets, count, seed), epochs=epochs, seed=seed)
    return tagger


# --- use --------------------------------------------------------------------------------------------


def runs_of(text: str) -> list[tuple[int, int]]:
    """Where spans can be: digits that stand near each other, and each "@" with the words beside it, one blank between at most."""
    found = [(m.start(), m.end()) for m in NUMBERS.finditer(text)]
    if "@" in text:
        words = [(m.start(), m.end()) for m in WORD.finditer(text)]
        for n, (start, end) in enumerate(words):
            if text.find("@", start, end) < 0:
                continue
            lo, hi = start, end
            if text[start] == "@" and n and text[words[n - 1][1] : start] == " ":
                lo = words[n - 1][0]
            if text[end - 1] == "@" and n + 1 < len(words) and text[end : words[n + 1][0]] == " ":
                hi = words[n + 1][1]
            found.append((lo, hi))
    runs: list[tuple[int, int]] = []
    for lo, hi in sorted(found):
        if runs and lo < runs[-1][1]:
            runs[-1] = (runs[-1][0], max(runs[-1][1], hi))
        else:
            runs.append((lo, hi))
    return runs


def windows_of(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Starts and widths of windows that cover the runs and what stands near them; a run that fits one window is whole in one."""
    windows: list[tuple[int, int]] = []
    done = 0
    for lo, hi in runs:
        width = WINDOW
        while width < min(hi - lo, WIDEST) and "@" in text[lo:hi]:
            width *= 2
        margin = max(min(MARGIN, (width - (hi - lo)) // 2), 0)
        at = max(lo - margin, 0)
        if windows and windows[-1][0] <= at and hi + margin <= done:
            continue
        windows.append((at, width))
        while at + width < hi:
            at += width // 2
            windows.append((at, width))
        done = at + width
    return windows


def reconcile(size: int, windows: list[tuple[int, int]], tags: list[np.ndarray], runs: list[tuple[int, int]]) -> list[Span]:
    """Spans from the tags of overlapping windows: one that holds the run of a character counts before others, then that in which it is furthest from the edges."""
    spans: list[Span] = []
    best: dict[int, tuple[int, int]] = {}
    for (start, width), row in zip(windows, tags):
        inner = np.minimum(np.arange(width), np.arange(width)[::-1])
        for lo, hi in runs[bisect_left(runs, (start, 0)) :]:
            if lo >= start + width:
                break
            if hi <= start + width:
                inner[lo - start : hi - start] += WIDEST
        for k in np.flatnonzero(row >= 0).tolist():
            at = start + k
            if at >= size:
                break
            if at not in best or best[at][0] < inner[k]:
                best[at] = (int(inner[k]), int(row[k]))
    for at in sorted(best):
        kind = best[at][1] - 1
        if kind < 0:
            continue
        if spans and spans[-1][2] == at and spans[-1][0] == kind:
            spans[-1] = (kind, spans[-1][1], at + 1)
        else:
            spans.append((kind, at, at + 1))
    return spans


def _tags(texts: list[str], rows: list[tuple[int, int, int]], tagger: Tagger) -> list[np.ndarray]:
    """The tags of windows, given as text, start and width."""
    tags = [np.zeros(0, np.int64)] * len(rows)
    for width in sorted({w for _, _, w in rows}):
        mine, some = [k for k, r in enumerate(rows) if r[2] == width], 512 * WINDOW // width
        for at in range(0, len(mine), some):
            x = np.full((len(mine[at : at + some]), width), PAD)
            for line, k in zip(x, mine[at : at + some]):
                n, start, _ = rows[k]
                piece = codes(texts[n][start : start + width])
                line[: len(piece)] = piece
            for k, row in zip(mine[at : at + some], tagger.tag(x)):
                tags[k] = row
    return tags


def _cut(size: int, windows: list[tuple[int, int]], spans: list[Span]) -> list[tuple[int, int]]:
    """More windows, over the ends of spans that reach the last character read on their side."""
    first, last, done = set(), set(), -1
    for start, width in sorted(windows):
        if start > done:
            first.add(start)
            last.add(done)
        done = max(done, min(start + width, size))
    last.add(done)
    more = {max(s - STRIDE, 0) for _, s, _ in spans if s in first and s > 0} | {e - STRIDE for _, _, e in spans if e in last and e < size}
    return [(at, WINDOW) for at in sorted(more)]


def added_spans(texts: list[str], base: list[list[Span]], tagger: Tagger) -> list[list[Span]]:
    """What the tagger adds to the base spans of each text."""
    runs = [runs_of(t) for t in texts]
    windows = [windows_of(t, r) for t, r in zip(texts, runs)]
    rows = [(n, *w) for n, each in enumerate(windows) for w in each]
    tags: list[list[np.ndarray]] = [[] for _ in texts]
    spans: list[list[Span]] = [[] for _ in texts]
    while rows:
        for (n, _, _), row in zip(rows, _tags(texts, rows, tagger)):
            tags[n].append(row)
        read, rows = sorted({n for n, _, _ in rows}), []
        for n in read:
            spans[n] = reconcile(len(texts[n]), windows[n], tags[n], runs[n])
            more = _cut(len(texts[n]), windows[n], spans[n])
            windows[n] += more
            rows += [(n, *w) for w in more]
    out: list[list[Span]] = [[] for _ in texts]
    for n, text in enumerate(texts):
        taken = sorted((s, e) for _, s, e in base[n])
        for kind, start, end in spans[n]:
            while start < end and not (text[start].isalnum() or text[start] in "+("):
                start += 1
            while end > start and not text[end - 1].isalnum():
                end -= 1
            free = all(e <= start or s >= end for s, e in taken)
            if free and start < end and _added(kind, text, start, end):
                out[n].append((kind, start, end))
    return out


def _added(kind: int, text: str, start: int, end: int) -> bool:
    """Plausible, and not a part of a longer word."""
    inner = text[start:end]
    whole = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    return whole and plausible(kind, inner) and (kind != 0 or re.fullmatch(r"\S+ ?@ ?[^\s@]+\.[^\s@]+", inner) is not None)


def write_spans(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], x[0])))


def _scan(batches: Iterator[pa.RecordBatch], tagger: Tagger) -> Iterator[pa.RecordBatch]:
    marks = np.zeros(256, np.int64)
    marks[48:58] = marks[64] = 1
    for batch in chunks(batches):
        data, first = text_bytes(batch.column("text"))
        total = np.concatenate(([0], np.cumsum(marks[data])))
        wanted = np.flatnonzero(total[first[1:]] > total[first[:-1]]).tolist()
        texts = [t or "" for t in batch.column("text").take(pa.array(wanted, pa.int64())).to_pylist()]
        base = [base_spans(t) for t in texts]
        more = added_spans(texts, base, tagger)
        counts = {k: np.zeros(batch.num_rows, np.int64) for k in KINDS}
        ours, all_ = [""] * batch.num_rows, [""] * batch.num_rows
        for n, one, two in zip(wanted, base, more):
            ours[n], all_[n] = write_spans(one), write_spans(one + two)
            for kind, _, _ in one:
                counts[KINDS[kind]][n] += 1
        columns = [batch.column("doc_id"), *[pa.array(counts[k]) for k in KINDS], pa.array(ours), pa.array(all_)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[f"n_{k}" for k in KINDS], "base_spans", "spans"])


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", tagger: Tagger | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_email, n_ip, n_card, n_phone`` (base), ``base_spans`` and ``spans``.

    Spans are ``kind:start:end`` in code points, by start. Null and empty texts have
    none. Repeated rows get equal results; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tagger = tagger or train(rows)
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return rows.mapInArrow(partial(_scan, tagger=tagger), f"doc_id long, {counts}, base_spans string, spans string")
