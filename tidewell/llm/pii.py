"""Personal data: fixed patterns, and a character model for the rest.

The model is a bidirectional LSTM over characters with a conditional random
field over its tags (outside; begin and inside of each kind). It is trained in
numpy, by backpropagation through time, on labelled spans that
``labelled_windows`` makes from a seed, so it is the same for any corpus.

A span of any kind holds a digit or an ``@``, so only the text within ``REACH``
characters of one, to the ends of the words there, is looked at first; the rest is outside by definition. Such a
stretch is cut into windows of ``DECODE`` characters that overlap by half. Each
window gives scores; a character takes those of the window in which it lies
furthest from an edge, and one Viterbi search with the transitions decodes the
whole stretch, so a span may be longer than any window. A stretch at whose edge
a span is open is widened by as much again and decoded anew, until no span
touches an edge inside the text. Where the search begins or ends a span within a
word, the span takes the whole word (``grown``).

Spans of the patterns always stay; spans of the model that touch none of them,
and that hold what their kind has by definition (``valid``, so that no number
which fails Luhn's check is masked as a card), are added under the kinds ``model_email``, ``model_ip`` and so on.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_columns, slices
from tidewell.llm.crf import chain_gradient, surely_outside

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# No match starts inside a run of digits, as then the run's start would match too.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Characters of a window in training and in decoding, and around a digit or ``@``.
WINDOW, DECODE, REACH = 64, 128, 24
TRIGGER, SPACE = re.compile(r"[0-9@]"), re.compile(r"[ \n]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str):
    """Matches of the e-mail pattern, found from their ``@``.

    A local part can't hold an ``@``, so the leftmost match before one begins
    where the run of its characters does, or where the last match ended.
    """
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by kind as listed, then start."""
    out = [("email", a, z) for a, z in emails(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


# ---- labelled spans ----------------------------------------------------------


def labelled_windows(n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Character codes and tags of made windows, about half with personal data."""
    r = random.Random(seed)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    some = lambda alphabet, a, b: "".join(r.choice(alphabet) for _ in range(r.randint(a, b)))

    def word() -> str:
        w = "".join(r.choice(["en", "the", "th", "on", "ing", "ou", "er", "éa", "le", "ch", "ß", "ño", "ra", "st"]) for _ in range(r.randint(1, 5)))
        return r.choice([w, w, w.capitalize(), w + r.choice(".,;!?"), w.upper(), w + r.choice(["***", "###", "&&&", "$$$", "!!"])])

    def plain() -> str:
        return r.choice([
            lambda: some(digits, 1, 8), lambda: f"{r.randint(1900, 2035)}-{r.randint(1, 12):02}-{r.randint(1, 31):02}", lambda: f"{r.randint(0, 23)}:{r.randint(0, 59):02}",
            lambda: some("0123456789abcdef", 20, 40), lambda: f"${r.randint(1, 99999)}.{r.randint(0, 99):02}", lambda: f"v{r.randint(0, 9)}.{r.randint(0, 30)}",
            lambda: f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", lambda: some(letters, 2, 6) + some(digits, 1, 4), lambda: f"{r.randint(1, 99)}%", lambda: "@" + some(letters, 3, 8),
            lambda: f"§{r.randint(1, 99)}", lambda: f"{r.randint(1, 999)},{r.randint(0, 999):03}", lambda: "AKIA" + some(letters.upper() + digits, 16, 16), lambda: f"{some(letters, 3, 6)} @ {some(digits, 1, 3)}",
        ])()

    def card() -> str:
        body = some(digits, 15, 15)
        last = next(d for d in digits if luhn(body + d))
        d = body + last
        return r.choice([d, d, f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", f"{d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:]}", f"{d[:4]}.{d[4:8]}.{d[8:12]}.{d[12:]}"])

    def personal() -> tuple[int, str]:
        kind = r.randrange(4)
        if kind == 0:
            name = some(letters, 2, 8) + r.choice(["", ".", "_"]) + some(letters + digits, 1, 6)
            host = r.choice([some(letters, 3, 8), "mail" + some(digits, 1, 1) + ".example"]) + "." + r.choice(["com", "org", "net", "de", "fr"])
            if r.random() < 0.2:  # long ones, beyond what half a window holds
                name = r.choice("._-").join(some(letters, 3, 12) for _ in range(r.randint(2, 5)))
            return kind, r.choice(["{}@{}", "{}@{}", "{}@{}", "{}@ {}", "{} @{}"]).format(name, host)
        if kind == 1:
            return kind, ".".join(str(r.randint(0, 255)) for _ in range(4))
        if kind == 2:
            return kind, card()
        a, b, c = some(digits, 3, 3), some(digits, 3, 3), some(digits, 4, 4)
        return kind, r.choice([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"+{r.randint(2, 99)} {a} {b} {c}", f"+{r.randint(2, 99)}{a}{b}{c}", f"({a}) {b}-{c}", f"00{r.randint(20, 99)} {a} {b}{c}", f"{a}-{b}-{c}"])

    x, y = np.zeros((n, WINDOW), dtype=np.int64), np.zeros((n, WINDOW), dtype=np.int64)
    for i in range(n):
        text, tags = "", []
        while len(text) < WINDOW + 80:
            kind, piece = personal() if r.random() < 0.14 else (-1, plain() if r.random() < 0.15 else word())
            text += piece + r.choice([" ", " ", " ", " ", "\n", "###" if kind >= 0 else " "])
            tags += ([1 + 2 * kind] + [2 + 2 * kind] * (len(piece) - 1) if kind >= 0 else [0] * len(piece)) + [0] * (len(text) - len(tags) - len(piece))
        cut = r.randint(0, 60)
        part, own = text[cut : cut + WINDOW], tags[cut : cut + WINDOW]
        x[i], y[i] = codes(part), own
    return x, y


#: Codes of characters: ASCII as it is, then any other letter, space, sign.
SIZE = 131


def codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    if len(raw) and raw.max() >= 128:
        rest = {c: 128 if c.isalpha() else 129 if c.isspace() else 130 for c in set(text) if ord(c) >= 128}
        return np.array([rest[c] if ord(c) >= 128 else ord(c) for c in text], dtype=np.int64)
    return raw.astype(np.int64)


# ---- the network -------------------------------------------------------------


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def lstm(inputs: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, tuple]:
    """States over time; ``inputs`` (time, batch, 4h) hold all that comes from outside."""
    t, b, k = inputs.shape
    h = k // 4
    states, cells, gates = np.zeros((t + 1, b, h), inputs.dtype), np.zeros((t + 1, b, h), inputs.dtype), np.empty_like(inputs)
    for i in range(t):
        z = inputs[i] + states[i] @ u
        g = gates[i]
        g[:, : 3 * h] = sigmoid(z[:, : 3 * h])
        g[:, 3 * h :] = np.tanh(z[:, 3 * h :])
        cells[i + 1] = g[:, h : 2 * h] * cells[i] + g[:, :h] * g[:, 3 * h :]
        states[i + 1] = g[:, 2 * h : 3 * h] * np.tanh(cells[i + 1])
    return states[1:], (states, cells, gates)


def lstm_back(grad: np.ndarray, kept: tuple, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the inputs and of ``u``."""
    states, cells, gates = kept
    t, b, k = gates.shape
    h = k // 4
    dz, du = np.empty_like(gates), np.zeros_like(u)
    dh, dc = np.zeros((b, h), gates.dtype), np.zeros((b, h), gates.dtype)
    for i in range(t - 1, -1, -1):
        g, tc = gates[i], np.tanh(cells[i + 1])
        dh = dh + grad[i]
        dc = dc + dh * g[:, 2 * h : 3 * h] * (1 - tc * tc)
        z = dz[i]
        z[:, :h] = dc * g[:, 3 * h :] * g[:, :h] * (1 - g[:, :h])
        z[:, h : 2 * h] = dc * cells[i] * g[:, h : 2 * h] * (1 - g[:, h : 2 * h])
        z[:, 2 * h : 3 * h] = dh * tc * g[:, 2 * h : 3 * h] * (1 - g[:, 2 * h : 3 * h])
        z[:, 3 * h :] = dc * g[:, :h] * (1 - g[:, 3 * h :] ** 2)
        du += states[i].T @ z
        dh, dc = z @ u.T, dc * g[:, h : 2 * h]
    return dz, du


def forward(p: dict, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Tag scores ``(batch, time, tags)`` of windows of codes."""
    xt = x.T
    a, keep_a = lstm(p["in_f"][xt], p["u_f"])
    b, keep_b = lstm(p["in_b"][xt[::-1]], p["u_b"])
    both = np.concatenate([a, b[::-1]], axis=2)
    return (both @ p["out"] + p["bias"]).transpose(1, 0, 2), (both, keep_a, keep_b)


def new_weights(hidden: int, seed: int) -> dict[str, np.ndarray]:
    g, k = np.random.default_rng(seed), 1 + 2 * len(KINDS)
    p = {n: g.normal(0, 0.3, (SIZE, 4 * hidden)) for n in ("in_f", "in_b")}
    p |= {n: g.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)) for n in ("u_f", "u_b")}
    for n in ("in_f", "in_b"):
        p[n][:, hidden : 2 * hidden] += 1.0  # remember, at first
    p |= {"out": g.normal(0, 0.2, (2 * hidden, k)), "bias": np.zeros(k), "moves": np.zeros((k, k))}
    p["bias"][0] = 1.0
    return {n: v.astype(np.float32) for n, v in p.items()}


@functools.lru_cache(maxsize=2)
def fit(windows: int = 6000, rounds: int = 700, hidden: int = 16, batch: int = 64, seed: int = 11) -> dict[str, np.ndarray]:
    """Train on made windows by Adam with a falling rate."""
    x, y = labelled_windows(windows, seed)
    p, g = new_weights(hidden, seed), np.random.default_rng(seed + 1)
    m, v = ({n: np.zeros_like(w) for n, w in p.items()} for _ in range(2))
    full = np.ones((batch, WINDOW), dtype=bool)
    for step in range(1, rounds + 1):
        own = g.choice(windows, batch, replace=False)
        scores, (both, keep_a, keep_b) = forward(p, x[own])
        _, ds, dm = chain_gradient(scores.astype(np.float64), p["moves"].astype(np.float64), y[own], full)
        ds = (ds / batch).astype(np.float32).transpose(1, 0, 2)
        grads = {"moves": (dm / batch).astype(np.float32), "bias": ds.sum(axis=(0, 1)), "out": both.reshape(-1, both.shape[2]).T @ ds.reshape(-1, ds.shape[2])}
        back = ds @ p["out"].T
        za, grads["u_f"] = lstm_back(back[:, :, :hidden], keep_a, p["u_f"])
        zb, grads["u_b"] = lstm_back(back[::-1, :, hidden:], keep_b, p["u_b"])
        xt = x[own].T
        for name, z, at in (("in_f", za, xt), ("in_b", zb, xt[::-1])):
            grads[name] = np.zeros_like(p[name])
            np.add.at(grads[name], at.reshape(-1), z.reshape(-1, z.shape[2]))
        norm = np.sqrt(sum(float((d * d).sum()) for d in grads.values()))
        rate = 0.02 * (1 - step / (rounds + 1)) * min(1.0, 5.0 / (norm + 1e-9))
        for n, d in grads.items():
            m[n] += 0.1 * (d - m[n])
            v[n] += 0.01 * (d * d - v[n])
            p[n] -= rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.99**step)) + 1e-8)
    return p


# ---- whole texts -------------------------------------------------------------


def merged(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Unions of the parts that meet, in order."""
    out: list[list[int]] = []
    for a, z in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def stretches(text: str) -> list[tuple[int, int]]:
    """Merged surroundings of all digits and ``@``, to the ends of their words."""
    out: list[tuple[int, int]] = []
    done = 0  # each character is looked at once
    for a, z in merged([(max(m.start() - REACH, 0), min(m.end() + REACH, len(text))) for m in TRIGGER.finditer(text)]):
        if z > done:
            a = max(text.rfind(" ", done, max(a, done)), text.rfind("\n", done, max(a, done)), done - 1) + 1
            space = SPACE.search(text, z)
            done = space.start() if space else len(text)
            out.append((a, done))
    return merged(out)


def cut(a: int, z: int) -> list[int]:
    """Starts of the windows over one stretch, overlapping by half."""
    last = max(z - DECODE, a)
    return sorted({*range(a, last, DECODE // 2), last})


def window_scores(p: dict, texts: list[str], jobs: list[tuple[int, int, int]], batch: int = 256) -> list[np.ndarray]:
    """Scores of every character of each stretch ``(text, start, end)``; windows of all texts share batches."""
    flat = [(i, s) for i, a, z in jobs for s in cut(a, z)]
    scores = np.zeros((len(flat), DECODE, len(p["bias"])), dtype=np.float32)
    for at in range(0, len(flat), batch):
        part = flat[at : at + batch]
        x = np.full((len(part), DECODE), 10, dtype=np.int64)  # past the end: line breaks
        for row, (i, s) in enumerate(part):
            c = codes(texts[i][s : s + DECODE])
            x[row, : len(c)] = c
        scores[at : at + len(part)] = forward(p, x)[0]
    out, at = [], 0
    for _, a, z in jobs:
        starts = np.array(cut(a, z))
        place = np.arange(a, z)
        # The window whose middle is nearest; of equals the earlier.
        best = np.zeros(z - a, dtype=np.int64)
        if len(starts) > 1:
            best = np.searchsorted((starts[:-1] + starts[1:] + DECODE - 1) / 2, place, "left")
        out.append(scores[at + best, place - starts[best]])
        at += len(starts)
    return out


#: Places, sequences times the longest of them, that are decoded at once, but for one longer sequence.
PLACES = 1 << 17


def best_tags(scores: list[np.ndarray], moves: np.ndarray, batch: int = 512) -> list[np.ndarray]:
    """Viterbi tags of sequences of any length; places that are surely outside split them, which is exact."""
    tags = [np.zeros(len(s), dtype=np.int8) for s in scores]
    runs = []
    for i, s in enumerate(scores):
        open_ = np.flatnonzero(~surely_outside(s, moves))
        if len(open_):
            runs += [(i, int(r[0]), int(r[-1]) + 1) for r in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1)]
    runs.sort(key=lambda r: r[2] - r[1])
    at = 0
    while at < len(runs):
        # Runs come by length: the last that still fits is the longest.
        end = at + 1
        while end < min(len(runs), at + batch) and (end + 1 - at) * (runs[end][2] - runs[end][1] + 2) <= PLACES:
            end += 1
        part, at = runs[at:end], end
        t = part[-1][2] - part[-1][1] + 2
        x = np.full((len(part), t, scores[0].shape[1]), -1e9)
        x[:, :, 0] = 0  # sure neighbours, and what is past the end, are outside
        lead = []
        for row, (i, a, z) in enumerate(part):
            lead.append(int(a > 0))
            x[row, lead[-1] : lead[-1] + z - a] = scores[i][a:z]
            if z == len(scores[i]):  # nothing follows: no move is paid
                x[row, lead[-1] + z - a :] = 0
        found = _viterbi_ends(x, moves, [k + z - a + (z < len(scores[i])) for k, (i, a, z) in zip(lead, part, strict=True)])
        for row, (i, a, z) in enumerate(part):
            tags[i][a:z] = found[row, lead[row] : lead[row] + z - a]
    return tags


def _viterbi_ends(scores: np.ndarray, moves: np.ndarray, ends: list[int]) -> np.ndarray:
    """As ``viterbi``, for sequences that end at different places."""
    b, t, k = scores.shape
    end = np.array(ends)
    best, frm = scores[:, 0], np.zeros((b, t, k), dtype=np.int8)
    own = np.arange(k, dtype=np.int8)
    for i in range(1, t):
        step = best[:, :, None] + moves
        on = (i < end)[:, None]
        frm[:, i] = np.where(on, step.argmax(axis=1), own)
        best = np.where(on, step.max(axis=1) + scores[:, i], best)
    out = np.zeros((b, t), dtype=np.int64)
    out[:, -1] = best.argmax(axis=1)
    for i in range(t - 1, 0, -1):
        out[:, i - 1] = frm[np.arange(b), i, out[:, i]]
    return out


def tagged(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Spans of a sequence of tags."""
    out, i = [], 0
    inside = np.flatnonzero(tags).tolist()
    for at in inside:
        if at < i:
            continue
        kind, j = (int(tags[at]) - 1) // 2, at + 1
        while j < len(tags) and tags[j] == 2 + 2 * kind:
            j += 1
        out.append((KINDS[kind], at, j))
        i = j
    return out


def valid(kind: str, part: str) -> bool:
    """What any span of the kind has by definition, however it is written; checked after decoding."""
    digits = "".join(c for c in part if c in "0123456789")
    if kind == "email":
        return "@" in part and "." in part.split("@")[-1]
    if kind == "ip":
        return part.count(".") == 3 and all(n and int(n) <= 255 for n in ("".join(c for c in x if c in "0123456789") for x in part.split(".")))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 8 <= len(digits) <= 15


def grown(text: str, kind: str, a: int, z: int) -> tuple[str, int, int]:
    """The span without a cut in a word: an address takes all characters of a local part before it, a number all its digits."""
    inside = LOCAL if kind == "email" else frozenset("0123456789")
    while a > 0 and text[a] in inside and text[a - 1] in inside:
        a -= 1
    while z < len(text) and text[z - 1].isalnum() and text[z].isalnum() and (kind == "email" or text[z] in inside):
        z += 1
    return kind, a, z


def grouped(jobs: list[tuple[int, int, int]], most: int = 1 << 18) -> Iterator[list[tuple[int, int, int]]]:
    """The jobs in groups of so many characters, but for one longer stretch, as scores take many bytes a character."""
    group, held = [], 0
    for job in jobs:
        if group and held + job[2] - job[1] > most:
            yield group
            group, held = [], 0
        group.append(job)
        held += job[2] - job[1]
    if group:
        yield group


def model_spans(p: dict, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Spans of each text that the model tags."""
    out: list[list] = [[] for _ in texts]
    jobs = [(i, a, z) for i, t in enumerate(texts) for a, z in stretches(t)]
    reach = REACH
    while jobs:
        wider: dict[int, list] = {}
        found = ((job, tags) for group in grouped(jobs) for job, tags in zip(group, best_tags(window_scores(p, texts, group), p["moves"]), strict=True))
        for (i, a, z), tags in found:
            spans = tagged(tags)
            left, right = bool(spans) and spans[0][1] == 0 and a > 0, bool(spans) and spans[-1][2] == z - a and z < len(texts[i])
            if left or right:
                wider.setdefault(i, []).append((max(a - reach * left, 0), min(z + reach * right, len(texts[i]))))
            else:
                whole = (grown(texts[i], k, a + b, a + y) for k, b, y in spans)
                out[i] += [(k, b, y) for k, b, y in whole if valid(k, texts[i][b:y])]
        reach *= 2
        jobs = [(i, a, z) for i, own in wider.items() for a, z in merged(own)]
    return [apart(spans) for spans in out]


def apart(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Without those that a longer one overlaps, as widened stretches may meet others."""
    out: list[tuple[str, int, int]] = []
    for s in sorted(set(spans), key=lambda s: (s[1] - s[2], s[1], s[0])):
        if all(s[2] <= b or y <= s[1] for _, b, y in out):
            out.append(s)
    return sorted(out, key=lambda s: s[1:])


def all_spans(p: dict, texts: list[str]) -> list[list[tuple[str, int, int]]]:
    """Of each text the spans of the patterns, then those the model adds."""
    out = []
    for text, more in zip(texts, model_spans(p, texts), strict=True):
        base = base_spans(text)
        added = [(f"model_{k}", a, z) for k, a, z in more if not any(a < y and b < z for _, b, y in base)]
        out.append(base + sorted(added, key=lambda s: (KINDS.index(s[0][6:]), s[1])))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or union of spans that overlap, as ``[KIND]``."""
    out, at = [], 0
    for kind, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.removeprefix('model_').upper()}]"]
        at = max(at, z)
    return "".join(out) + text[at:]


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``, one row per input row.

    The counts and the digest are of the patterns alone. A null text is empty,
    a very long one is scanned whole. Repeated rows come back alike, rows without
    an id, too; other columns aren't read. An empty table gives no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit())

    def run(ids, texts):
        out: dict[str, list] = {c: [] for c in (*(f"n_{k}" for k in KINDS), "base_sha256", "spans")}
        for spans in all_spans(held.value, [t or "" for t in texts]):
            base = [s for s in spans if s[0] in KINDS]
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(s[0] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
        return {"doc_id": ids} | out

    return map_columns(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"],
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string", run,
    )


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text`` and ``n_chars`` counted anew.

    Null texts stay null, empty ones empty, very long ones are masked whole. All other columns and rows, repeated
    ones and those without an id too, stay as they were; an empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(fit())

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            new = [None if t is None else mask(t, s) for t, s in zip(texts, all_spans(held.value, [t or "" for t in texts]), strict=True)]
            columns = {"text": pa.array(new, type=pa.string())}
            if "n_chars" in batch.schema.names:
                columns["n_chars"] = pa.array([None if t is None else len(t) for t in new], type=pa.int64())
            yield pa.RecordBatch.from_arrays([columns.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
