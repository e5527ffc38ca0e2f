"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions that adds spans.

Base spans (e-mail, IP, card, phone) come from fixed patterns and are never dropped.  The tagger, written and trained in
numpy from labelled spans, finds forms that the patterns miss (phones without a plus, spaced or bracketed at signs, cards parted by
dots).  Texts are cut into windows of ``WINDOW`` characters every ``STRIDE``; windows with no digit and no at sign can't
hold any of the four kinds and are not decoded.  Windows that overlap are reconciled into one stretch: a character that two
windows cover takes its emissions from the one where it is nearer the middle, and the whole stretch is decoded by one Viterbi path over the CRF.  A span that overlaps no base span and passes its kind's check (digits, Luhn, parts) is added.

Defined results: a null text counts as empty; without spans the strings are empty (and the digest is that of the empty string); repeated rows
stay repeated; an empty table gives no rows; other columns are ignored.  Offsets count code points; ends are exclusive.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import pick, text_batches

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 128, 64
Span = tuple[int, int, int]  # start, kind, end

_TRIGGER = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The patterns of the task; possessive where giving back can't help, so none is worse than linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and not overlapping for each kind, sorted by start and kind."""
    out: list[Span] = []
    at, done = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        m = _DOMAIN.match(text, at + 1) if lo < at else None
        if m:
            done = m.end()
            out.append((lo, 0, done))
        at = text.find("@", max(done, at + 1))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 64 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# --- the tagger -------------------------------------------------------------------------------------------------

_MARKS = "@.-_+%() \n,:=\"[]/"
_LOWER = 2
_CODES = np.ones(128, np.int64)  # 0 is padding, 1 any other character
for _i in range(26):
    _CODES[97 + _i] = _LOWER + _i
_CODES[65:91] = _LOWER + 26
_CODES[48:58] = _LOWER + 27
for _i, _c in enumerate(_MARKS):
    _CODES[ord(_c)] = _LOWER + 28 + _i
_FAR = _LOWER + 28 + len(_MARKS)
N_CODES = _FAR + 1
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CODES[np.minimum(points, 127)], _FAR)


@dataclass
class Tagger:
    """Parameters: for each direction input and recurrent weights and bias, then emissions and CRF scores."""

    p: dict[str, np.ndarray]
    hidden: int


def new_tagger(hidden: int = 16, seed: int = 11) -> Tagger:
    rng = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p[f"{d}x"] = rng.normal(0, 0.3, (N_CODES, 4 * hidden))
        p[f"{d}h"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        bias = np.zeros(4 * hidden)
        bias[hidden : 2 * hidden] = 1.0
        p[f"{d}b"] = bias
    p["e"], p["eb"] = rng.normal(0, 0.2, (2 * hidden, TAGS)), np.zeros(TAGS)
    p["t"], p["s"] = np.zeros((TAGS, TAGS)), np.zeros(TAGS)
    for k in range(len(KINDS)):  # inside follows begin or inside of its kind only
        p["t"][:, 2 + 2 * k] = -6.0
        p["t"][[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0.0
        p["s"][2 + 2 * k] = -6.0
    return Tagger({k: v.astype(np.float32) for k, v in p.items()}, hidden)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _lstm(x: np.ndarray, wx: np.ndarray, wh: np.ndarray, b: np.ndarray, keep: bool):
    """Hidden states of a batch of code rows (n, t), and what the backward pass needs."""
    n, t = x.shape
    k = wh.shape[0]
    h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
    out, saved = np.empty((t, n, k), np.float32), []
    for i in range(t):
        z = wx[x[:, i]] + h @ wh + b
        gates = _sigmoid(z[:, : 3 * k])
        g = np.tanh(z[:, 3 * k :])
        was_h, was_c = h, c
        c = gates[:, k : 2 * k] * c + gates[:, :k] * g
        tc = np.tanh(c)
        h = gates[:, 2 * k : 3 * k] * tc
        out[i] = h
        if keep:
            saved.append((gates, g, was_h, was_c, tc))
    return out, saved


def _lstm_back(x, wh, saved, dout):
    t, n, k = dout.shape
    dwx, dwh, db = np.zeros((N_CODES, 4 * k), np.float32), np.zeros_like(wh), np.zeros(4 * k, np.float32)
    dh, dc, one = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32), np.eye(N_CODES, dtype=np.float32)
    for i in range(t - 1, -1, -1):
        gates, g, was_h, was_c, tc = saved[i]
        a, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k : 3 * k]
        dh = dh + dout[i]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate((dc * g * a * (1 - a), dc * was_c * f * (1 - f), dh * tc * o * (1 - o), dc * a * (1 - g * g)), axis=1)
        dwx += one[x[:, i]].T @ dz
        dwh += was_h.T @ dz
        db += dz.sum(axis=0)
        dh, dc = dz @ wh.T, dc * f
    return dwx, dwh, db


def emissions(m: Tagger, x: np.ndarray, keep: bool = False):
    p = m.p
    f, sf = _lstm(x, p["fx"], p["fh"], p["fb"], keep)
    b, sb = _lstm(x[:, ::-1], p["bx"], p["bh"], p["bb"], keep)
    both = np.concatenate((f, b[::-1]), axis=2)
    return both @ p["e"] + p["eb"], both, sf, sb


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _crf_grad(e: np.ndarray, y: np.ndarray, trans: np.ndarray, start: np.ndarray):
    """Negative log-likelihood of the tag rows ``y`` (n, t) and its gradients, by forward and backward scores."""
    t, n, k = e.shape
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = start + e[0]
    for i in range(1, t):
        alpha[i] = _lse(alpha[i - 1][:, :, None] + trans, 1) + e[i]
    for i in range(t - 2, -1, -1):
        beta[i] = _lse(trans + (beta[i + 1] + e[i + 1])[:, None, :], 2)
    logz = _lse(alpha[-1], 1)
    de = np.exp(alpha + beta - logz[None, :, None])
    dt = np.zeros_like(trans)
    gold, rows = start[y[:, 0]] + e[0, np.arange(n), y[:, 0]], np.arange(n)
    for i in range(1, t):
        pair = alpha[i - 1][:, :, None] + trans + (beta[i] + e[i])[:, None, :] - logz[:, None, None]
        dt += np.exp(pair).sum(axis=0)
        np.add.at(dt, (y[:, i - 1], y[:, i]), -1)
        gold = gold + trans[y[:, i - 1], y[:, i]] + e[i, rows, y[:, i]]
    ds = de[0].sum(axis=0)
    np.add.at(ds, y[:, 0], -1)
    for i in range(t):
        de[i, rows, y[:, i]] -= 1
    return float((logz - gold).sum()), de, dt, ds


def viterbi(e: np.ndarray, trans: np.ndarray, start: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """Best tag rows (n, t) for emissions (t, n, tags); of rows with ``lengths``, which descend, what lies behind is no part of the path."""
    t, n, k = e.shape
    live = np.full(t, n) if lengths is None else n - np.searchsorted(lengths[::-1], np.arange(t), side="right")
    score, back = start + e[0], np.empty((t, n, k), np.int8)
    for i in range(1, t):
        m = int(live[i])
        step = score[:m, :, None] + trans
        back[i, :m], back[i, m:] = step.argmax(axis=1), np.arange(k)
        best = step.max(axis=1) + e[i, :m]
        score[:m] = best - best.max(axis=1, keepdims=True)  # long texts don't outgrow the precision
    out, rows = np.empty((n, t), np.int8), np.arange(n)
    out[:, -1] = score.argmax(axis=1)
    for i in range(t - 1, 0, -1):
        out[:, i - 1] = back[i, rows, out[:, i]]
    return out


def fit(examples: list[tuple[str, list[Span]]], epochs: int = 8, size: int = 64, rate: float = 0.02, hidden: int = 16, seed: int = 11) -> Tagger:
    """Train on texts of at most ``WINDOW`` characters with their labelled spans, by Adam."""
    codes, tags = np.zeros((len(examples), WINDOW), np.int64), np.zeros((len(examples), WINDOW), np.int64)
    lengths = np.array([len(text) for text, _ in examples])
    for i, (text, spans) in enumerate(examples):
        codes[i, : len(text)] = encode(text)
        for a, k, b in spans:
            tags[i, a] = 1 + 2 * k
            tags[i, a + 1 : b] = 2 + 2 * k
    m, rng = new_tagger(hidden, seed), np.random.default_rng(seed)
    mean, var, step = {k: np.zeros_like(v) for k, v in m.p.items()}, {k: np.zeros_like(v) for k, v in m.p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(examples))
        order = order[np.argsort(lengths[order] // 32, kind="stable")]  # texts of like length go together, so little is padding
        for lo in rng.permutation(np.arange(0, len(order), size)).tolist():
            rows = order[lo : lo + size]
            most = int(lengths[rows].max())
            x, y = codes[:, :most], tags[:, :most]
            e, both, sf, sb = emissions(m, x[rows], keep=True)
            _, de, dt, ds = _crf_grad(e, y[rows], m.p["t"], m.p["s"])
            de = (de / len(rows)).astype(np.float32)
            g = {"t": dt / len(rows), "s": ds / len(rows), "e": np.tensordot(both, de, ((0, 1), (0, 1))), "eb": de.sum(axis=(0, 1))}
            dboth = de @ m.p["e"].T
            g["fx"], g["fh"], g["fb"] = _lstm_back(x[rows], m.p["fh"], sf, dboth[:, :, :hidden])
            g["bx"], g["bh"], g["bb"] = _lstm_back(x[rows][:, ::-1], m.p["bh"], sb, dboth[::-1, :, hidden:])
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            r = rate * (0.5 if epoch >= epochs * 2 // 3 else 1.0)
            for k, v in g.items():
                v = v * min(1.0, 5.0 / (norm + 1e-9))
                mean[k] = 0.9 * mean[k] + 0.1 * v
                var[k] = 0.999 * var[k] + 0.001 * v * v
                m.p[k] = (m.p[k] - r * (mean[k] / (1 - 0.9**step)) / (np.sqrt(var[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return m


def labelled_examples(n: int = 2400, seed: int = 23) -> list[tuple[str, list[Span]]]:
    """Made-up text with labelled spans: plain and unusual forms of each kind, and numbers that are none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bcdfghlmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))[: rng.randint(2, 8)]
    ds = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def email() -> str:
        local = word() + rng.choice(["", "." + word(), "_" + word(), ds(2), "." + ds(2)])
        domain = word() + rng.choice(["", ds(1), "." + word()]) + "." + rng.choice(["com", "org", "net", "de", "example.com", "co.uk"])
        return local + rng.choice(["@", "@", "@", " @ ", "[@]", " [@] ", "(@)"]) + domain

    def card() -> str:
        body = rng.choice("345") + ds(14)
        last = next(c for c in "0123456789" if luhn(body + c))
        d, sep = body + last, rng.choice(["", "", " ", "-", ".", "/", "  "])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = ds(3), ds(3), ds(4)
        forms = (f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{ds(2)} {a} {b} {c}", f"00{ds(2)} {a} {b} {c}", f"({a}){b}-{c}")
        return rng.choice(forms)

    def ip() -> str:
        return rng.choice([".", ".", ".", "[.]", " . "]).join(str(rng.randint(1, 255)) for _ in range(4))

    def other() -> str:
        return rng.choice(
            [ds(rng.randint(1, 6)), f"{ds(1)}.{ds(1)}", f"20{ds(2)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", "password=" + "".join(rng.choice("0123456789abcdef") for _ in range(18)),
             'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"', "v" + ds(1) + "." + ds(2) + "." + ds(1), ds(3) + "-" + ds(2), "AKIA" + word().upper() + ds(3), f"{ds(2)}:{ds(2)}", ds(20), "@" + word(), f"{ds(2)}%"]
        )

    makers, out = (email, ip, card, phone), []
    while len(out) < n:
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            for _ in range(rng.randint(0, 6)):
                w = word()
                text += (w.capitalize() if rng.random() < 0.2 else w) + rng.choice([" ", " ", " ", " ", ", ", ". ", ".\n"])
            k = rng.randint(0, 5)
            item = makers[k]() if k < 4 else other()
            if k < 4:
                spans.append((len(text), k, len(text) + len(item)))
            text += item + rng.choice([" ", " ", ".", ", ", "\n", ". "])
        text += word()
        if len(text) <= WINDOW:
            out.append((text, spans))
    return out


_MODEL: dict[str, Tagger] = {}


def default_tagger() -> Tagger:
    """The tagger of the made-up examples, trained once in a process (some seconds)."""
    if "m" not in _MODEL:
        _MODEL["m"] = fit(labelled_examples())
    return _MODEL["m"]


def _valid(kind: int, s: str) -> bool:
    d = _digits(s)
    if kind == 0:
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\s?[\[(]?@[\])]?\s?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", s))
    if kind == 1:
        parts = re.fullmatch(r"([0-9]{1,3})\D{1,3}([0-9]{1,3})\D{1,3}([0-9]{1,3})\D{1,3}([0-9]{1,3})", s)
        return bool(parts) and all(int(p) <= 255 for p in parts.groups())
    if kind == 2:
        return 14 <= len(d) <= 19 and luhn(d) and not re.search(r"[^0-9 ./-]", s)
    return 10 <= len(d) <= 15 and bool(re.fullmatch(r"[+(]?[0-9][0-9 ().-]*[0-9]", s)) and bool(re.search(r"[ ().-]", s))


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a digit or an at sign."""
    last, out = -1, []
    for m in _TRIGGER.finditer(text):
        k = m.start() // STRIDE
        if k != last:
            last = k
            out += [k - 1, k] if k else [k]
    return [k * STRIDE for k in sorted(set(out))]


def stretches(starts: list[int]) -> list[tuple[int, int]]:
    """Index ranges of windows that overlap one another in a row."""
    cuts = [0, *(i for i in range(1, len(starts)) if starts[i] - starts[i - 1] >= WINDOW), len(starts)]
    return list(zip(cuts[:-1], cuts[1:], strict=True)) if starts else []


_FAR_OFF = np.abs(2 * np.arange(WINDOW) - (WINDOW - 1))


def stitched(starts: list[int], rows: np.ndarray, n: int) -> np.ndarray:
    """Emissions of the characters from the first window's start on: each from the window where it is nearest the middle."""
    base, end = starts[0], min(starts[-1] + WINDOW, n)
    best, out = np.full(end - base, 2 * WINDOW, np.int64), np.empty((end - base, rows.shape[2]), rows.dtype)
    for s, row in zip(starts, rows, strict=True):
        m = min(WINDOW, n - s)
        at = np.arange(s - base, s - base + m)
        near = _FAR_OFF[:m] < best[at]
        best[at[near]] = _FAR_OFF[:m][near]
        out[at[near]] = row[:m][near]
    return out


def decoded(parts: list[np.ndarray], m: Tagger, most: int = 1 << 16) -> list[np.ndarray]:
    """The best tags of each stretch by one Viterbi path over all of it; stretches of like length go together."""
    out: list[np.ndarray] = [np.empty(0, np.int8)] * len(parts)
    order = sorted(range(len(parts)), key=lambda i: -len(parts[i]))
    lo = 0
    while lo < len(order):
        t = len(parts[order[lo]])
        own = order[lo : lo + max(1, most // t)]
        e = np.zeros((t, len(own), TAGS), np.float32)
        for k, i in enumerate(own):
            e[: len(parts[i]), k] = parts[i]
        lengths = np.array([len(parts[i]) for i in own])
        for i, tags in zip(own, viterbi(e, m.p["t"], m.p["s"], lengths), strict=True):
            out[i] = tags[: len(parts[i])]
        lo += len(own)
    return out


def tagged(tags: np.ndarray, base: int) -> list[Span]:
    """Spans of a row of tags: from a begin (or a stray inside) on, as long as its kind goes on."""
    spans, at, i = [], np.flatnonzero(tags), 0
    ends = np.append(np.flatnonzero(np.diff(tags)) + 1, len(tags))  # of the runs of one tag
    while i < len(at):
        a = int(at[i])
        kind = (int(tags[a]) - 1) // 2
        inside = 2 + 2 * kind
        b = a if tags[a] == inside else a + 1
        if b < len(tags) and tags[b] == inside:
            b = int(ends[np.searchsorted(ends, b, side="right")])
        spans.append((base + a, kind, base + b))
        i = int(np.searchsorted(at, b))
    return spans


def add_spans(texts: list[str], base: list[list[Span]], m: Tagger, windows: int = 512) -> list[list[Span]]:
    """What the tagger adds to the base spans of each text."""
    out: list[list[Span]] = [[] for _ in texts]
    places = [(i, window_starts(t)) for i, t in enumerate(texts)]
    runs = [(i, starts[a:b]) for i, starts in places for a, b in stretches(starts)]
    codes = {i: encode(texts[i]) for i in {i for i, _ in runs}}
    lo = 0
    while lo < len(runs):  # about ``windows`` windows at a time
        hi, n = lo + 1, len(runs[lo][1])
        while hi < len(runs) and n + len(runs[hi][1]) <= windows:
            n += len(runs[hi][1])
            hi += 1
        group = runs[lo:hi]
        flat = [(i, s) for i, starts in group for s in starts]
        rows = np.empty((len(flat), WINDOW, TAGS), np.float32)
        for a in range(0, len(flat), windows):
            part = flat[a : a + windows]
            x = np.zeros((len(part), WINDOW), np.int64)
            for r, (i, s) in enumerate(part):
                piece = codes[i][s : s + WINDOW]
                x[r, : len(piece)] = piece
            rows[a : a + len(part)] = emissions(m, x)[0].transpose(1, 0, 2)
        cuts = np.cumsum([0, *(len(starts) for _, starts in group)]).tolist()
        parts = [stitched(starts, rows[a:b], len(texts[i])) for (i, starts), a, b in zip(group, cuts[:-1], cuts[1:], strict=True)]
        for (i, starts), tags in zip(group, decoded(parts, m), strict=True):
            out[i] += _accepted(texts[i], tagged(tags, starts[0]), base[i])
        lo = hi
    return out


def _accepted(text: str, found: list[Span], base: list[Span]) -> list[Span]:
    """Found spans, stripped of marks around, that pass their kind's check and overlap no base span."""
    taken = sorted((a, b) for a, _, b in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    out = []
    for a, kind, b in found:
        while b > a and text[b - 1] in " \n.,;:":
            b -= 1
        while a < b and text[a] in " \n.,;:":
            a += 1
        k = bisect_left(starts, b)  # base spans that begin before the end, and how far they reach
        if a < b and not (k and reach[k - 1] > a) and _valid(kind, text[a:b]):
            out.append((a, kind, b))
    return out


def _find(batches: Iterator[pa.RecordBatch], m: Tagger) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, column = batch.column(0), batch.column(1)
        for lo in range(0, batch.num_rows, 512):
            texts = [t or "" for t in column.slice(lo, 512).to_pylist()]
            base = [base_spans(t) if _TRIGGER.search(t) else [] for t in texts]
            more = add_spans(texts, base, m)
            both = [sorted(a + b) for a, b in zip(base, more, strict=True)]
            count = lambda k: pa.array([sum(x[1] == k for x in b) for b in base], pa.int64())  # noqa: B023, E731
            yield pa.record_batch(
                {
                    "id": ids.slice(lo, len(texts)),
                    **{f"n_{name}": count(k) for k, name in enumerate(KINDS)},
                    "base": pa.array([joined(b) for b in base], pa.string()),
                    "spans": pa.array([joined(b) for b in both], pa.string()),
                    "n_added": pa.array([len(x) for x in more], pa.int64()),
                }
            )


def find_pii(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", tagger: Tagger | None = None) -> DataFrame:
    """id, counts of base spans by kind, base spans, all spans (``kind:start:end``, joined) and how many were added."""
    base = pick(docs, id=id_col, text=text_col)
    kind = dict(base.dtypes)["id"]
    held = docs.sparkSession.sparkContext.broadcast(tagger or default_tagger())
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    schema = f"id {kind}, {counts}, base string, spans string, n_added long"
    return base.mapInArrow(lambda it: _find(it, held.value), schema).withColumnRenamed("id", id_col)


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for a, k, b in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _redact(batches: Iterator[pa.RecordBatch], m: Tagger) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            texts = part.column(at).to_pylist()
            whole = [t or "" for t in texts]
            base = [base_spans(t) if _TRIGGER.search(t) else [] for t in whole]
            more = add_spans(whole, base, m)
            new = [None if t is None else redact(t, a + b) for t, a, b in zip(texts, base, more, strict=True)]
            yield part.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))


def redact_pii(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """``docs`` with the personal data of its column ``text`` replaced; all rows and columns stay."""
    text_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(tagger or default_tagger())
    return docs.mapInArrow(lambda it: _redact(it, held.value), docs.schema)
