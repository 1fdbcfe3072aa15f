"""Personal data by a character-level bidirectional LSTM with CRF transitions, beside exact base patterns.

The base patterns (e-mail, IPv4, card with Luhn digits, international phone) are always kept.  The tagger is trained in numpy from
labelled spans: windows of sampled documents with the base patterns' spans, and the same texts with generated examples set in, also in
shapes that the base patterns miss (spaced, bracketed and worded e-mails, bracketed addresses, cards and phones with other separators), and with
look-alikes that are no personal data.  It reads characters as classes.

A span must pass its kind's exact check to be added, and no span passes without a digit, an @, a bracketed at or a worded dot.  So
windows that hold none of these are not tagged: nothing that they propose could be added.  Every other window of every text is.  Windows overlap by half.  A span cut by
a window's edge that no neighbour holds whole is tagged again in a window widened until no edge cuts it, so there is no greatest length; what the
windows of a text propose is reconciled by the best set of spans that do not overlap.  Spans that overlap a base span are left out.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stage, attach, fresh, slices, small_batches, table

KINDS = ("email", "ip", "card", "phone")
WINDOW = 64
STRIDE = 32
#: A span that ends so near to a window's edge may go on beyond it, and counts as cut.
MARGIN = 8
HIDDEN = 16
STEPS = 480
#: Every such batch is of windows twice as wide, where long spans stand whole.
WIDE_EVERY = 4
BATCH = 64
#: Training takes so many stretches; a stretch is this many characters and the windows that end in it.
SAMPLE, STRETCH = 800, 900
SEED = 7
TAGS = 1 + 2 * len(KINDS)  # none; then for each kind its first and its further characters
NO = -1e4

EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a digit run's later digits can't begin a leftmost match, so they aren't tried
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HAS_BASE = re.compile(r"[0-9@]")
TRIGGER = re.compile(r"[0-9@]|[\[({]\s?at\s?[\])}]|\sdot\s", re.I)
AT = re.compile(r"\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?", re.I)
WORD_AT = re.compile(r"\sat\s", re.I)
DOT = re.compile(r"\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?|\sdot\s|\s\.\s", re.I)
#: What goes on with an e-mail after one of its labels: more of the label, or a dot of any form and another label.
LABEL = re.compile(r"[^\W_]+|-+[^\W_]+|\.[^\W_]+|(?:\s?[\[({]\s?(?:\.|dot)\s?[\])}]\s?|\sdot\s)[^\W_]+", re.I)
ADDRESS = re.compile(r"[^\W_][^\s@]*@[^\s@.]+(\.[^\s@.]+)*\.[^\W\d_]{2,}")
NOT_DIGIT = re.compile(r"[^0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def fine(kind: int, found: str) -> bool:
    """The exact check of a base match."""
    digits = NOT_DIGIT.sub("", found)
    if kind == 1:
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in found.split("."))
    if kind == 2:
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 8 <= len(digits) <= 15
    return True


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping e-mails: a match's local part reaches back from its @ as far as it can."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """All base spans by kind, then start."""
    if not HAS_BASE.search(text):
        return []
    out = [(0, a, b) for a, b in emails(text)]
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if fine(kind, m.group())]
    return out


def address(s: str) -> str:
    """An e-mail as it would be written plainly; a worded at counts only where a dot is worded or bracketed."""
    worded = DOT.search(s) is not None
    s = DOT.sub(".", s)
    return WORD_AT.sub("@", s) if worded and not AT.search(s) else AT.sub("@", s)


def plausible(kind: int, text: str, a: int, b: int) -> bool:
    """The exact check of a proposed span: its shape, and no letter or digit next to it."""
    s = text[a:b]
    if (a and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()):
        return False
    if kind == 0:
        return bool(ADDRESS.fullmatch(address(s)))
    if kind == 1:
        s = DOT.sub(".", s)
        return bool(re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s)) and fine(1, s)
    digits = NOT_DIGIT.sub("", s)
    if kind == 3:
        return bool(re.fullmatch(r"[+(]?[0-9][\x20()./-]+[0-9][\x20()./0-9-]*[0-9]|[+(][0-9][\x20()./0-9-]+[0-9]|[0-9]{2,5}[\x20()./-][\x20()./0-9-]+[0-9]", s) and 10 <= len(digits) <= 15 and len(s) - len(digits) >= 2 and not re.fullmatch(r"[0-9]+(\.[0-9]+){3}", s))
    return bool(re.fullmatch(r"[0-9]([\x20._/-]{0,2}[0-9])*", s)) and fine(2, digits)


# -- characters and training windows -----------------------------------------------------------------------------------------

#: A proposal longer than this is none: no address has more characters (64, an @, 255), and numbers have fewer.
LONGEST = 320
MARKS = "@.-_+()% :/\"=,\n[]{}"  # these have a class each
WORDED = "atdo"  # and so have the letters of the worded at and dot
PAD, LOWER, UPPER, DIGIT, LETTER, OTHER = range(6)
CLASSES = 6 + len(MARKS) + len(WORDED)


def classes() -> np.ndarray:
    """Class of each code point."""
    if "classes" not in _cache:
        out = np.full(0x110000, OTHER, dtype=np.uint8)
        for c in range(0x110000):
            if chr(c).isalpha():
                out[c] = LETTER
        out[0x61:0x7B], out[0x41:0x5B], out[0x30:0x3A] = LOWER, UPPER, DIGIT
        for i, ch in enumerate(MARKS):
            out[ord(ch)] = 6 + i
        for i, ch in enumerate(WORDED):
            out[ord(ch)] = out[ord(ch.upper())] = 6 + len(MARKS) + i
        _cache["classes"] = out
    return _cache["classes"]


_cache: dict[str, np.ndarray] = {}


def read_classes(text: str) -> np.ndarray:
    return classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def example(rng: random.Random, longest: int = 120) -> tuple[str, int | None]:
    """A generated string and its kind; None for a look-alike."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda low=2, high=9: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(low, high)))
    pick = rng.randrange(24)
    if pick < 8:
        at = rng.choice(["@", "@", " @ ", "[at]", " [at] ", "(at)", " (at) ", "{at}", " at ", " AT "])
        dot = " dot " if at in (" at ", " AT ") else rng.choice([".", ".", ".", " dot ", "[dot]", "(dot)", " [dot] ", "[.]", " . "])
        local = rng.choice([w(), w().capitalize(), w() + rng.choice("._-+") + w(), w() + d(2), w(1, 1) + "." + w()])
        host = [w() + rng.choice(["", "", "-" + w(), d(1)]) for _ in range(rng.randint(1, 2))] + [rng.choice(["com", "org", "net", "de", "co", "info", w(2, 4)])]
        if rng.random() < 0.3:  # long ones
            local += "".join(rng.choice("._-") + w() for _ in range(rng.randint(2, 6)))
            host = [w() for _ in range(rng.randint(1, 3))] + host
        s = local + at + dot.join(host)
        return (s, 0) if len(s) <= longest else ("a.b" + at + "c" + dot + "org", 0)
    if pick < 11:
        parts, dot = [str(rng.randint(0, 255)) for _ in range(4)], rng.choice([".", ".", "[.]", "(.)", " . ", "[dot]"])
        return dot.join(parts), 1
    if pick < 14:
        body = d(15)
        full = next(body + c for c in "0123456789" if luhn(body + c))
        sep = rng.choice(["", " ", "-", ".", "/", "_", "  ", " - "[:2]])
        return sep.join(full[i : i + 4] for i in range(0, 16, 4)), 2
    if pick < 18:
        a, b, c = d(3), d(3), d(4)
        return rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+{d(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a} {b} {c}", f"{a}.{b}.{c}", f"({a}){b}-{c}", f"{a}/{b}-{c}", f"00{d(2)} {a} {b} {c}", f"0{a} {b} {c}"]), 3
    year = rng.randint(1900, 2030)
    return rng.choice([
        f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', f"version {rng.randint(1, 9)}.{rng.randint(0, 20)}", f"{year}-{d(2)}-{d(2)}", f"{year}-{d(2)}-{d(2)} {d(2)}:{d(2)}:{d(2)}",
        f"{d(rng.randint(1, 7))}.{d(2)}", d(rng.randint(1, 9)), f"{rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 99)}", f"@{w()}", f"{w()}{d(2)}", f"{rng.randint(1, 12)}:{d(2)}", f"{d(1)},{d(3)},{d(3)}", f"{d(2)}/{d(2)}/{year}",
        f"{w()} at {w()}", f"{w()} dot {w()}", f"{w()} at the dot {w()}", f"{w()} at {w()}. {w().capitalize()}", f"{w()}@{w()}", f"[{d(1)}] {w()}", f"({w()}) {w()}", f"{d(3)}-{d(2)}", f"{d(4)} {d(4)}", f"{d(8)}-{d(4)}", f"{year}-{year + 1}",
    ]), None


def training_windows(texts: list[str], n: int, seed: int = SEED, wide: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of n windows: from the texts around base spans, and with generated examples set in."""
    rng = random.Random(seed)
    texts = [t for t in texts if t] or ["a text of plain words. "]
    real = [(t, s) for t in texts for s in base_spans(t)]
    x, y = np.zeros((n, wide), dtype=np.uint8), np.zeros((n, wide), dtype=np.int8)
    for i in range(n):
        if real and rng.random() < 0.25:
            text, (_, a, b) = real[rng.randrange(len(real))]
            spans = base_spans(text[max(0, a - 400) : b + 400])
            text = text[max(0, a - 400) : b + 400]
            a, b = a - max(0, a - 400), b - max(0, a - 400)
        else:
            text = texts[rng.randrange(len(texts))]
            o = rng.randrange(len(text))
            text = text[o : o + 2 * wide]
            s, kind = example(rng)
            before, after = text[: rng.randrange(wide)], text[wide:]
            lead = before + rng.choice([" ", " ", " ", "\n", ": ", ""][: 6 if before[-1:].isspace() or not before else 5])
            text = lead + s + rng.choice([" ", " ", ".", ",", "\n"]) + after
            a, b = len(lead), len(lead) + len(s)
            spans = [(kind, a, b)] if kind is not None else []
        # a third of the windows cut the span
        low = rng.randint(b - wide, a) if b - a < wide and rng.random() < 0.67 else rng.randint(a - wide // 2, b - wide // 2)
        low = max(0, min(low, len(text) - 1))
        part = text[low : low + wide]
        x[i, : len(part)] = read_classes(part)
        for kind, s, e in spans:
            s, e = s - low, e - low
            if e > 0 and s < wide:
                y[i, max(s, 0) : e] = 2 + 2 * kind
                if s >= 0:
                    y[i, s] = 1 + 2 * kind
    return x, y


# -- the tagger -----------------------------------------------------------------------------------------------------------------


def start_model(seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    h = HIDDEN
    m = {}
    for d in "fb":
        m["x" + d] = rng.normal(0, 0.3, (CLASSES, 4 * h))
        m["u" + d] = rng.normal(0, 0.5 / np.sqrt(h), (h, 4 * h))
        m["c" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])  # the forget gates start open
    m["o"], m["ob"] = rng.normal(0, 0.3, (2 * h, TAGS)), np.zeros(TAGS)
    m["t"], m["s"] = np.zeros((TAGS, TAGS)), np.zeros(TAGS)
    return m


def allowed() -> np.ndarray:
    """0 where a tag may follow another, else NO: further characters of a kind follow only that kind."""
    out = np.zeros((TAGS, TAGS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = NO
        out[[inside - 1, inside], inside] = 0
    return out


def sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-v))


def lstm_states(m: dict, d: str, x: np.ndarray) -> np.ndarray:
    """One direction over x (batch, time): its states only."""
    n, t = x.shape
    h, c = np.zeros((n, HIDDEN), m["u" + d].dtype), np.zeros((n, HIDDEN), m["u" + d].dtype)
    out = np.empty((n, t, HIDDEN), m["u" + d].dtype)
    for k in range(t):
        z = m["x" + d][x[:, k]] + h @ m["u" + d] + m["c" + d]
        s = sigmoid(z[:, : 3 * HIDDEN])
        c = s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * np.tanh(z[:, 3 * HIDDEN :])
        h = s[:, 2 * HIDDEN :] * np.tanh(c)
        out[:, k] = h
    return out


def lstm(m: dict, d: str, x: np.ndarray) -> dict:
    """One direction over x (batch, time); everything that the backward pass needs."""
    n, t = x.shape
    h, c = np.zeros((n, HIDDEN), m["u" + d].dtype), np.zeros((n, HIDDEN), m["u" + d].dtype)
    gates, cells, hs = [], [], []
    for k in range(t):
        z = m["x" + d][x[:, k]] + h @ m["u" + d] + m["c" + d]
        s = sigmoid(z[:, : 3 * HIDDEN])
        i, f, o, g = s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
        cells.append(c)
        c = f * c + i * g
        tc = np.tanh(c)
        gates.append((i, f, o, g, tc, h))
        h = o * tc
        hs.append(h)
    return {"x": x, "gates": gates, "cells": cells, "h": np.stack(hs, 1)}


def lstm_back(m: dict, d: str, run: dict, dh: np.ndarray, grad: dict) -> None:
    n, t = run["x"].shape
    next_h, next_c = np.zeros((n, HIDDEN), dh.dtype), np.zeros((n, HIDDEN), dh.dtype)
    dz_all = np.empty((n, t, 4 * HIDDEN), dh.dtype)
    for k in range(t - 1, -1, -1):
        i, f, o, g, tc, _ = run["gates"][k]
        a = dh[:, k] + next_h
        dc = next_c + a * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * run["cells"][k] * f * (1 - f), a * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dz_all[:, k] = dz
        next_h, next_c = dz @ m["u" + d].T, dc * f
    flat = dz_all.reshape(-1, 4 * HIDDEN)
    grad["u" + d] += np.stack([g[5] for g in run["gates"]], 1).reshape(-1, HIDDEN).T @ flat
    hot = np.zeros((flat.shape[0], CLASSES), dh.dtype)
    hot[np.arange(len(hot)), run["x"].ravel()] = 1
    grad["x" + d] += hot.T @ flat
    grad["c" + d] += flat.sum(0)


def emissions(m: dict, x: np.ndarray) -> tuple[np.ndarray, dict, dict, np.ndarray]:
    forth, back = lstm(m, "f", x), lstm(m, "b", x[:, ::-1])
    both = np.concatenate([forth["h"], back["h"][:, ::-1]], axis=2)
    return both @ m["o"] + m["ob"], forth, back, both


def step(m: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean negative log-likelihood of the tags and its gradient; forward and backward sums are scaled at each character."""
    e, forth, back, both = emissions(m, x)
    n, t, _ = e.shape
    trans, at = m["t"] + allowed().astype(e.dtype), np.arange(n)
    top = e.max(axis=2, keepdims=True)
    seen, move = np.exp(e - top), np.exp(trans)
    alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((n, t), e.dtype)
    a = np.exp(m["s"]) * seen[:, 0]
    for k in range(t):
        if k:
            a = (a @ move) * seen[:, k]
        scale[:, k] = a.sum(axis=1)
        a = a / scale[:, k, None]
        alpha[:, k] = a
    for k in range(t - 2, -1, -1):
        beta[:, k] = ((seen[:, k + 1] * beta[:, k + 1]) @ move.T) / scale[:, k + 1, None]
    z = np.log(scale).sum(1) + top.sum((1, 2))
    gold = m["s"][y[:, 0]] + e[at[:, None], np.arange(t), y].sum(1) + trans[y[:, :-1], y[:, 1:]].sum(1)
    grad = {k: np.zeros_like(v) for k, v in m.items()}
    de = alpha * beta
    after = (seen * beta / scale[:, :, None])[:, 1:]
    grad["t"] = move * (alpha[:, :-1].reshape(-1, TAGS).T @ after.reshape(-1, TAGS))
    np.subtract.at(grad["t"], (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    grad["s"] = de[:, 0].sum(0) - np.bincount(y[:, 0], minlength=TAGS)
    de[at[:, None], np.arange(t), y] -= 1
    grad["o"] = both.reshape(-1, 2 * HIDDEN).T @ de.reshape(-1, TAGS)
    grad["ob"] = de.sum((0, 1))
    dh = de @ m["o"].T
    lstm_back(m, "f", forth, dh[:, :, :HIDDEN], grad)
    lstm_back(m, "b", back, dh[:, ::-1, HIDDEN:], grad)
    return float((z - gold).mean()), {k: v / n for k, v in grad.items()}


def train(texts: list[str], steps: int = STEPS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Adam over shuffled windows, every WIDE_EVERY-th batch of them twice as wide; the model in single precision."""
    n = BATCH * max(8, steps // 6)
    sets = [training_windows(texts, n, seed), training_windows(texts, n // 2, seed + 1, 2 * WINDOW)]
    m, rng = {k: v.astype(np.float32) for k, v in start_model(seed).items()}, np.random.default_rng(seed)
    one, two = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    for k in range(1, steps + 1):
        x, y = sets[k % WIDE_EVERY == 0]
        part = rng.choice(len(x), min(BATCH if k % WIDE_EVERY else BATCH // 2, len(x)), replace=False)
        _, g = step(m, x[part], y[part].astype(np.int64))
        size = np.sqrt(sum((v**2).sum() for v in g.values()))
        rate = 0.02 * (1 - (k - 1) / steps) + 0.001
        for key, v in g.items():
            v = v * min(1.0, 5.0 / (size + 1e-12))
            one[key] = 0.9 * one[key] + 0.1 * v
            two[key] = 0.99 * two[key] + 0.01 * v * v
            m[key] = m[key] - rate * (one[key] / (1 - 0.9**k)) / (np.sqrt(two[key] / (1 - 0.99**k)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in m.items()}


def decode(m: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tag sequence of each window (Viterbi), and each character's emission lead of that tag over none."""
    e = np.concatenate([lstm_states(m, "f", x), lstm_states(m, "b", x[:, ::-1])[:, ::-1]], axis=2) @ m["o"] + m["ob"]
    n, t, _ = e.shape
    trans = m["t"] + allowed().astype(np.float32)
    best, came = e[:, 0] + m["s"], np.empty((n, t, TAGS), dtype=np.int8)
    for k in range(1, t):
        v = best[:, :, None] + trans
        came[:, k] = v.argmax(1)
        best = v.max(1) + e[:, k]
    tags = np.empty((n, t), dtype=np.int64)
    tags[:, -1] = best.argmax(1)
    for k in range(t - 1, 0, -1):
        tags[:, k - 1] = came[np.arange(n), k, tags[:, k]]
    lead = np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0] - e[:, :, 0]
    return tags, lead


def window_starts(text: str) -> list[int]:
    """Starts of all windows (on the STRIDE grid) that hold a digit or an @."""
    cells = sorted({m.start() // STRIDE for m in TRIGGER.finditer(text)})
    return sorted({max(0, c - d) * STRIDE for c in cells for d in range(WINDOW // STRIDE)})


def reconcile(found: list[tuple[int, int, int, float]]) -> list[Span]:
    """The set of spans without overlap that has the largest total score: weighted interval scheduling over a whole text."""
    found = sorted(set(found), key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in found]
    best, take = [0.0], []
    import bisect

    for i, (_, a, _, score) in enumerate(found):
        before = bisect.bisect_right(ends, a, 0, i)
        take.append(best[before] + score > best[i])
        best.append(max(best[i], best[before] + score))
    out, i = [], len(found)
    while i:
        kind, a, b, _ = found[i - 1]
        if take[i - 1]:
            out.append((kind, a, b))
            i = bisect.bisect_right(ends, a, 0, i - 1)
        else:
            i -= 1
    return out[::-1]


def tagged(m: dict, texts: list[str], where: list[tuple[int, int, int]]) -> Iterator[tuple[tuple[int, int, int], list[tuple[int, int, int, float]]]]:
    """Windows (text, start, end), with the spans that the tagger sees in each: (kind, start, end, score)."""
    by_size: dict[int, list] = {}
    for w in where:
        by_size.setdefault(max(WINDOW, w[2] - w[1]), []).append(w)
    for size, same in by_size.items():
        each = max(1, 1024 * WINDOW // size)
        for low in range(0, len(same), each):
            part = same[low : low + each]
            x = np.zeros((len(part), size), dtype=np.uint8)
            for k, (i, a, b) in enumerate(part):
                x[k, : b - a] = read_classes(texts[i][a:b])
            tags, lead = decode(m, x)
            spans: list[list] = [[] for _ in part]
            begins = tags % 2 == 1
            begins[:, 0] |= tags[:, 0] > 0  # inside a span that began before the window
            for k, s in zip(*np.nonzero(begins), strict=True):
                a = part[k][1]
                inside, e = tags[k, s] + tags[k, s] % 2, s + 1
                while e < size and tags[k, e] == inside:
                    e += 1
                spans[k].append(((int(inside) - 2) // 2, int(a + s), int(a + e), float(max(lead[k, s:e].sum(), 1e-6))))
            yield from zip(part, spans, strict=True)


def hopeless(kind: int, piece: str) -> bool:
    """Whether no span that holds this piece can be plausible."""
    if len(piece) > LONGEST:
        return True
    if kind == 0:
        inner = piece.split()[1:-1]  # the words at the ends may be cut
        joins = [re.fullmatch(r"[\[({]?(?:at|dot|@|\.)?[\])}]?", x, re.I) is not None for x in inner]
        apart = [not (x or y or re.search(r"[@.\])}]$", u) or re.match(r"[@.\[({]", v)) for x, y, u, v in zip(joins, joins[1:], inner, inner[1:], strict=False)]
        return piece.count("@") > 1 or any(apart)
    if kind == 1:
        return not all(p.isdecimal() and fine(1, p) for p in DOT.sub(".", piece).split(".")[1:-1] if p)
    return len(NOT_DIGIT.sub("", piece)) > (19 if kind == 2 else 15)


def wider(windows: list[tuple[int, int, int, tuple[int, int]]]) -> dict[tuple[int, int, int], list[tuple[int, int]]]:
    """Windows (text, start, end, cut piece) as windows with their pieces, overlapping ones of a text together."""
    out: list[tuple[int, int, int, list]] = []
    for i, a, b, piece in sorted(windows):
        if out and out[-1][0] == i and a < out[-1][2]:
            _, low, high, pieces = out.pop()
            out.append((i, low, max(high, b), [*pieces, piece]))
        else:
            out.append((i, a, b, [piece]))
    return {(i, a, b): pieces for i, a, b, pieces in out}


def proposals(m: dict, texts: list[str], base: list[list[Span]] | None = None) -> list[list[Span]]:
    """Reconciled spans of the tagger for each text.  A cut piece that meets a base span is left alone: nothing that holds it could be added."""
    base = base or [[] for _ in texts]
    held = [(np.array([a for _, a, _ in sorted(b, key=lambda s: s[1])]), np.maximum.accumulate([e for _, _, e in sorted(b, key=lambda s: s[1])] or [0])) for b in base]

    def meets(i: int, s: int, e: int) -> bool:
        k = int(np.searchsorted(held[i][0], e))
        return k > 0 and int(held[i][1][k - 1]) > s

    todo = {(i, a, min(a + WINDOW, len(t))): None for i, t in enumerate(texts) for a in window_starts(t)}
    found: list[list] = [[] for _ in texts]
    while todo:
        cut = []
        for (i, a, b), spans in tagged(m, texts, list(todo)):
            pieces = todo[i, a, b]
            for kind, s, e, score in spans:
                if pieces is not None and not any(s < y and x < e for x, y in pieces):
                    continue  # narrower windows hold it
                left, right = s - a < MARGIN and a > 0, b - e < MARGIN and b < len(texts[i])
                if not (left or right):
                    found[i].append((kind, s, e, score))
                elif not (meets(i, s, e) or hopeless(kind, texts[i][s:e])):
                    cut.append((i, max(0, 2 * a - b) if left else a, min(len(texts[i]), 2 * b - a) if right else b, (s, e), kind))
        todo = wider([c[:4] for c in cut if not any(k == c[4] and s <= c[3][0] and c[3][1] <= e for k, s, e, _ in found[c[0]])])
    return [reconcile(f) for f in found]


def snapped(kind: int, text: str, a: int, b: int) -> Span:
    """A proposal whose ends are moved outward to the ends of what they stand in: a run of digits, or an e-mail's local part and labels."""
    if kind:
        while a and text[a - 1].isdecimal():
            a -= 1
        while b < len(text) and text[b].isdecimal():
            b += 1
        return kind, a, b
    while a and text[a - 1] in LOCAL and text[a - 1] not in ".%":
        a -= 1
        while a > 1 and text[a - 1] in ".%" and text[a - 2] in LOCAL:
            a -= 1
    while m := LABEL.match(text, b):
        b = m.end()
    return kind, a, b


def all_spans(m: dict | None, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and added spans of each text."""
    base = [base_spans(t) for t in texts]
    more = proposals(m, texts, base) if m is not None else [[] for _ in texts]
    out = []
    for t, b, p in zip(texts, base, more, strict=True):
        ends = sorted({snapped(k, t, x, y) for k, x, y in p}, key=lambda s: (s[1] - s[2], s[1], s[0]))  # the longest first
        added: list[Span] = []
        for s in ends:
            if plausible(s[0], t, s[1], s[2]) and all(s[2] <= x or s[1] >= y for _, x, y in [*b, *added]):
                added.append(s)
        out.append((b, sorted(added)))
    return out


def said(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, overlapping ones together, replaced by <KIND>."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def stretches(text: str) -> list[str]:
    """The whole text in stretches that overlap by a wide window, so that every window of the text stands whole in one."""
    return [text[a : a + STRETCH + 2 * WINDOW] for a in range(0, max(len(text) - 2 * WINDOW, 1), STRETCH)]


def stretch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches, 1):
        for h, text in zip(batch.column(0).to_pylist(), texts, strict=True):
            found = stretches(text)
            yield pa.RecordBatch.from_arrays([pa.array([h] * len(found), pa.int64()), pa.array(range(len(found)), pa.int64()), pa.array(found, pa.string())], names=["h", "at", "part"])


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """A model from SAMPLE labelled rows: stretches of different texts, half of them such as have a digit or an @.

    Of about 10 x SAMPLE different texts, the ones with the smallest hashes, every stretch of the whole text can be taken; those with the
    smallest hashes are, so the sample is the same whatever the partitioning, and copies count once.
    """
    h = F.xxhash64(F.lit(11), "text")
    rows = docs.select(h.alias("h"), "text").where(F.col("text").isNotNull())
    u = F.col("h").bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    n = docs.select(F.lit(1)).count()
    stage = Stage(docs.sparkSession)
    texts = small_batches(rows.where(u * n < 10 * SAMPLE)).dropDuplicates(["h"])  # the documents' texts are read once
    parts = texts.mapInArrow(stretch_batches, "h long, at long, part string").withColumn("order", F.xxhash64(F.lit(13), "h", "at"))
    parts = stage.keep(parts.withColumn("marked", F.col("part").rlike("[0-9@]")), "sample")
    chosen = [parts.where(F.col("marked") == k).orderBy("order", "h", "at").limit(SAMPLE // 2).collect() for k in (False, True)]
    stage.drop(parts)
    return train([r["part"] for r in sorted(chosen[0] + chosen[1], key=lambda r: (r["order"], r["h"], r["at"]))])


def span_batches(batches: Iterator[pa.RecordBatch], m: dict) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    for batch, texts in slices(batches, 1):
        found = all_spans(m, texts)
        counts = [pa.array([sum(s[0] == k for s in b) for b, _ in found], pa.int64()) for k in range(len(KINDS))]
        digests = pa.array([hashlib.sha256(said(b).encode()).hexdigest() for b, _ in found], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([said(b + a) for b, a in found], pa.string()), pa.array([len(a) for _, a in found], pa.int64())], names=names)


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), n_added of each document.

    Null and empty texts have no spans; equal texts have equal ones; an empty table gives no rows.  Offsets are code points, the end exclusive.  Ids may be null or repeated.  Only doc_id and
    text are read; one pass without a shuffle after training on a bounded sample.
    """
    m = learn(docs)
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it: span_batches(it, m), schema)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with its texts' personal data (base and added spans) replaced by <KIND>; all other columns are as they were.

    Null stays null and empty stays empty; equal texts become equal texts; ids may be null or repeated; an empty table stays empty.
    """
    m = learn(docs)

    def compute(texts: list[str]) -> list:
        return [[redacted(t, b + a) for t, (b, a) in zip(texts, all_spans(m, texts), strict=True)]]

    name = fresh(docs, "clean")
    out = attach(docs, [(name, "string", pa.string())], compute, text_col)
    return out.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.col(name))).drop(name)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))
