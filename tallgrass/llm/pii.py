"""Personal data: fixed patterns, and a character-level BiLSTM-CRF that adds spans.

The tagger is trained in numpy on labelled spans: windows of a bounded sample of
documents, labelled by the patterns.  Most spans are written another way first
(a phone number without its country code and in other groups, spaces or brackets about
an ``@``, other marks between the groups of a card number) and unrelated numbers are put
between them, so that the tagger learns more than the patterns know.

Tagging: a span has to hold a digit or an ``@`` and may reach ``REACH`` characters
beyond the nearest one, so only stretches around such characters have any other
reading than 'no personal data' and only they are run through the network, in
overlapping windows.  Each character takes its scores from the window in which it
is most central, and one Viterbi pass over the whole stretch reconciles the
windows.  A stretch is passed over only if no path with any other tag can beat 'no
personal data' throughout, by a bound over its scores and all transitions.  Pattern
spans stay; a tagged span is added where it overlaps none, its lowest CRF marginal is
at least ``CONFIDENCE`` and it can be a datum of its kind.

Defined results: a null text counts as empty (no spans); spans with one start are listed
in the order of kinds; a very long text is tagged whole, stretch by stretch, so its
scores grow with its digits; repeated rows each get a row; an empty table gives an empty
result and an untrained tagger adds nothing; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallgrass.llm import textbatch as tb
from tallgrass.llm.tagger import Tagger

KINDS = ("email", "ip", "card", "phone")
#: Documents the labelled windows come from, windows used with spans and three quarters as many without, their length.
SAMPLE_DOCS, SAMPLE_WINDOWS, TRAIN_WINDOW, STEPS = 6_000, 3_000, 64, 1_000
#: Writings of each labelled span.
WRITINGS = 8
WINDOW, STRIDE, REACH = 96, 48, 40
CONFIDENCE, HIDDEN = 0.5, 24

_AT = re.compile(r"@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from the @ outwards so that long runs of letters cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _AT.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        total += v if k % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of every pattern match, ordered."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        # the length comes first, as no number is made of thousands of digits
        if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_CODE = np.full(0x80, 19, np.int8)
_CODE[48:58], _CODE[97:123], _CODE[65:91] = 1, 2, 3
for _k, _c in enumerate(" \n@.+-()_%:/,#\"="):
    _CODE[ord(_c)] = 4 + _k - (_k >= 15)
SYMBOLS = 22  # 0 stands for what lies outside the text, 20 for letters outside ASCII
TAGS = 1 + 2 * len(KINDS)
#: Inside tags follow only their own kind; row 0 is also the start.
ALLOWED = np.ones((TAGS, TAGS), bool)
for _k in range(len(KINDS)):
    ALLOWED[:, 2 + 2 * _k] = False
    ALLOWED[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = True


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 0x80, _CODE[np.minimum(points, 0x7F)], 20).astype(np.int8)


#: Shapes of numbers that are nobody's data: dates, times, amounts, versions, references.
OTHER_NUMBERS = ("9999-99-99", "99/99/9999", "99.99.9999", "99:99:99", "9,999,999", "9999.99", "v9.99.9", "99999", "999-9999", "#999999", "9999 9999", "999 999 999 999", "99 999 999", "999-9-99-999999-9", "999999-99999")


#: Sizes of the groups that digits of a phone number are written in, and what stands between groups or about an ``@``.
GROUPS = ((3, 3, 4), (3, 4, 4), (2, 4, 4), (4, 3, 3), (3, 2, 2, 2), (5, 5), (3, 7), (4, 6), (2, 2, 2, 2, 2))
BETWEEN = ("-", ".", " ", "/", " - ", "")
ABOUT_AT = (" @ ", "@ ", " @", "(@)", "[@]", " (@) ")


def other_writing(kind: int, found: str, rng: np.random.Generator) -> str:
    """The same kind of datum as the patterns do not read it; a phone number gets other digits and groups, a card number other marks."""
    if kind == 0:
        return found.replace("@", ABOUT_AT[rng.integers(len(ABOUT_AT))])
    if kind == 2:
        digits = re.sub("[^0-9]", "", found)
        return (".", "  ", " - ", "/", "_")[rng.integers(5)].join(digits[k : k + 4] for k in range(0, len(digits), 4))
    groups = ["".join(map(str, rng.integers(0, 10, n))) for n in GROUPS[rng.integers(len(GROUPS))]]
    between = [BETWEEN[k] for k in (rng.integers(0, 5, len(groups) - 1) if rng.random() < 0.3 else np.full(len(groups) - 1, rng.integers(0, 5)))]
    if rng.random() < 0.4:
        groups[0], between[0] = f"({groups[0]})", (" ", "", "-")[rng.integers(3)]
    return "".join(g + m for g, m in zip(groups, [*between, ""]))


def varied(text: str, spans: list[tuple[int, int, int]], rng: np.random.Generator) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with some spans in another writing and an unrelated number between them, and its spans."""
    edits = []
    for k, (s, kind, e) in enumerate(spans):
        apart = (k == 0 or spans[k - 1][2] <= s) and (k + 1 == len(spans) or e <= spans[k + 1][0])
        if kind != 1 and apart and rng.random() < 0.7:
            edits.append((s, e, other_writing(kind, text[s:e], rng)))
    gap = text.find(" ", int(rng.integers(len(text)))) if text else -1
    if gap >= 0 and not any(s - 1 <= gap <= e for s, _, e in spans):
        number = re.sub("9", lambda _: str(rng.integers(10)), OTHER_NUMBERS[rng.integers(len(OTHER_NUMBERS))])
        edits.append((gap, gap, f" {number}"))
    out, at, shift, moved = [], 0, 0, {}
    for s, e, new in sorted(edits):
        out += [text[at:s], new]
        at, moved[s] = e, (s + shift, s + shift + len(new))
        shift += len(new) - (e - s)
    shifted = lambda x: x + sum(len(new) - (e - s) for s, e, new in edits if s < x)
    return "".join([*out, text[at:]]), [(moved.get(s, (shifted(s),))[0], kind, moved[s][1] if s in moved else shifted(e)) for s, kind, e in spans]


def labelled_windows(text: str, rng: np.random.Generator, most: int = 4) -> list[tuple[bytes, bytes]]:
    """(symbols, tags) of windows about pattern spans, and one about other digits if there are any."""
    text, spans = varied(text, base_spans(text), rng)
    if not spans and not _TRIGGER.search(text):
        return []
    codes = symbols(text)
    tags = np.zeros(len(codes), np.int8)
    for s, kind, e in spans:
        if not tags[s:e].any():
            tags[s], tags[s + 1 : e] = 1 + 2 * kind, 2 + 2 * kind
    centres = [int(rng.integers(s, e)) for s, _, e in spans][:most]
    other = np.flatnonzero(((codes == 1) | (codes == 6)) & (tags == 0))
    if len(other):
        centres.append(int(other[rng.integers(len(other))]))
    out = []
    for c in centres:
        lo = c - int(rng.integers(8, TRAIN_WINDOW - 8))
        x, y = np.zeros(TRAIN_WINDOW, np.int8), np.zeros(TRAIN_WINDOW, np.int8)
        a, b = max(0, lo), min(len(codes), lo + TRAIN_WINDOW)
        x[a - lo : b - lo], y[a - lo : b - lo] = codes[a:b], tags[a:b]
        for k in range(len(KINDS)):  # a span that the window cuts begins at its edge
            if y[0] == 2 + 2 * k:
                y[0] = 1 + 2 * k
        out.append((x.tobytes(), y.tobytes()))
    return out


def sample_windows(text: str, seed: int) -> list[tuple[bytes, bytes]]:
    """Windows of a text; those with spans in ``WRITINGS`` writings."""
    rng = np.random.default_rng(seed)
    out = labelled_windows(text, rng)
    for _ in range(1, WRITINGS if any(any(y) for _, y in out) else 1):
        out += [w for w in labelled_windows(text, rng) if any(w[1])]
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger | None:
    """A tagger fitted to a bounded sample, or None where no text has a pattern span."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "doc_id")

    def run(batches):
        for batch in batches:
            for part in tb.slices(batch, 1):
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    rows += [(doc_id, k, any(w[1]), *w) for k, w in enumerate(sample_windows(text or "", abs(doc_id)))]
                cols = list(zip(*rows)) if rows else [[]] * 5
                types = (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_id", "k", "spans", "x", "y"])

    windows = chosen.select("doc_id", "text").mapInArrow(run, "doc_id long, k int, spans boolean, x binary, y binary")
    order = [F.xxhash64("doc_id", "k"), "doc_id", "k"]
    found = windows.where("spans").orderBy(*order).limit(SAMPLE_WINDOWS).unionByName(windows.where("NOT spans").orderBy(*order).limit(3 * SAMPLE_WINDOWS // 4)).collect()
    found = sorted({(bytes(r["x"]), bytes(r["y"])) for r in found})
    if not any(np.frombuffer(y, np.int8).any() for _, y in found):
        return None
    x, y = (np.stack([np.frombuffer(r[k], np.int8).astype(np.int64) for r in found]) for k in (0, 1))
    tagger = Tagger(SYMBOLS, TAGS, HIDDEN)
    tagger.fit(x, y, STEPS)
    return tagger


def plausible(kind: int, found: str) -> bool:
    """Whether the characters of a tagged span can be a datum of its kind."""
    digits = re.sub("[^0-9]", "", found)
    if kind == 0:
        return bool(re.fullmatch(r"[^@\s]+\s*[(\[]?@[)\]]?\s*[^@\s]+\.[^@\s]+", found))
    if kind == 1:
        return len(parts := re.findall("[0-9]+", found)) == 4 and all(len(x) < 4 and int(x) <= 255 for x in parts)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 7 <= len(digits) <= 15


def most_gain(tagger: Tagger) -> float:
    """What transitions can add, at most, to the score of each place with another tag over staying at 'no personal data'.

    A run of n other tags gains n scores, n - 1 steps inside it and the ways in and out:
    if no score makes up for the dearer of a step and both ways, no run does.
    """
    gain = np.where(ALLOWED, tagger.p["t"], -1e9) - float(tagger.p["t"][0, 0])
    ways = max(float(gain[0, 1:].max()), 0.0) + max(float(gain[1:, 0].max()), 0.0)  # none at either end of a text
    return max(float(gain[1:, 1:].max()), ways)


def tagged_spans(tagger: Tagger, texts: list[str], known: list[list[tuple[int, int, int]]] | None = None) -> list[list[tuple[int, int, int, float]]]:
    """For each text the (start, kind, end, confidence) that the tagger reads in it.

    With ``known`` spans, only plausible ones that overlap none of them.
    """
    jobs, codes = [], []
    for k, text in enumerate(texts):
        codes.append(symbols(text) if _TRIGGER.search(text) else None)
        if codes[k] is None:
            continue
        hot = np.flatnonzero((codes[k] == 1) | (codes[k] == 6))
        if not len(hot):
            continue
        gaps = np.flatnonzero(np.diff(hot) > 2 * REACH)
        for a, b in zip(np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(hot) - 1]])):
            jobs.append((k, max(0, int(hot[a]) - REACH), min(len(codes[k]), int(hot[b]) + REACH + 1)))
    windows = [(j, lo) for j, (_, s, e) in enumerate(jobs) for lo in range(s, max(s + 1, e - WINDOW + STRIDE), STRIDE)]
    scores = [np.zeros((e - s, TAGS), np.float32) for _, s, e in jobs]
    depth = [np.full(e - s, -1, np.int64) for _, s, e in jobs]
    central = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1])
    for begin in range(0, len(windows), 1024):
        part = windows[begin : begin + 1024]
        x = np.zeros((WINDOW, len(part)), np.int64)
        for c, (j, lo) in enumerate(part):
            own = codes[jobs[j][0]][lo : lo + WINDOW]
            x[: len(own), c] = own
        e = tagger.emissions(x)
        for c, (j, lo) in enumerate(part):
            _, s, stop = jobs[j]
            a, b = lo - s, min(stop, lo + WINDOW) - s
            better = central[: b - a] > depth[j][a:b]
            scores[j][a:b][better] = e[: b - a, c][better]
            depth[j][a:b][better] = central[: b - a][better]
    least = -most_gain(tagger)
    out: list[list] = [[] for _ in texts]
    for (k, s, _), e in zip(jobs, scores):
        if float((e[:, 1:].max(1) - e[:, 0]).max()) < least:
            continue
        tags = tagger.viterbi(e, ALLOWED)
        read = []
        for a in np.flatnonzero(tags % 2 == 1).tolist():
            b = a + 1
            while b < len(tags) and tags[b] == tags[a] + 1:
                b += 1
            span = (s + a, int(tags[a]) // 2, s + b)
            if known is None or (plausible(span[1], texts[k][span[0] : span[2]]) and not any(x < span[2] and span[0] < y for x, _, y in known[k])):
                read.append(span)
        if read:
            share = tagger.marginals(e, ALLOWED)
            out[k] += [(x, kind, y, float(share[x - s : y - s, [1 + 2 * kind, 2 + 2 * kind]].sum(1).min())) for x, kind, y in read]
    return out


def find(texts: list[str], tagger: Tagger | None) -> list[tuple[list, list]]:
    """(pattern spans, all spans) of each text; spans are (start, kind, end)."""
    base = [base_spans(t) if _TRIGGER.search(t) else [] for t in texts]
    if tagger is None:
        return [(b, b) for b in base]
    return [(b, sorted(b + [m[:3] for m in more if m[3] >= CONFIDENCE])) for b, more in zip(base, tagged_spans(tagger, texts, base))]


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{s}:{e}" for s, kind, e in spans)


def scan(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: counts of pattern spans by kind, their digest, and all spans."""

    def run(batches):
        for batch in batches:
            for part in tb.slices(batch, 1):
                found = find([t or "" for t in part.column(1).to_pylist()], tagger)
                counts = [pa.array([sum(x[1] == k for x in b) for b, _ in found], pa.int64()) for k in range(len(KINDS))]
                digest = pa.array([hashlib.sha256(_text(b).encode()).hexdigest() for b, _ in found], pa.string())
                spans = pa.array([_text(a) for _, a in found], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, digest, spans], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op8_bilstm_crf_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs))
