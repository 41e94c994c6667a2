"""Secret scan: fixed patterns, and a conditional random field for the rest.

The field tags white-space tokens as beginning, inside or outside of a secret
from their shape, the words around them and features of the whole file, and
is decoded by Viterbi. It is fitted in numpy on labelled lines that
``labelled_lines`` makes from a seed, so it is the same for any corpus. Tokens
that look alike share their scores, and a token that no best path can tag is
passed by before the search, which leaves the decoding exact. Neighbouring words
count by their shape and, where they often stand before a secret in the labelled
lines, by themselves. What is added to the score of the outside is chosen on
lines held out of the fit.

Spans of the patterns always stay; spans of the field that touch none of them
are added under the kind ``crf``.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import map_columns
from tidewell.llm.crf import chain_gradient, decode

#: Fixed patterns. Upper and lower case only fold within ASCII.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Substrings without which the first pattern can't match.
ROOTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex")

OUTSIDE, BEGIN, INSIDE = range(3)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(r in low for r in ROOTS):
        out += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, z, KINDS[k]) for a, z, k in sorted(out, key=lambda s: (s[0], s[2], s[1]))]


#: Words that speak of a secret, and how some secrets begin.
SPEAK = re.compile(r"passw|passphrase|pwd|secret|token|api.?key|access.?key|private.?key|credential|bearer|authorization")
STARTS = ("AKIA", "ASIA", "sk-", "sk_", "ghp_", "gho_", "xoxb-", "xoxp-", "eyJ", "glpat-", "AIza")
EDGE = "\"'`,;()[]{}<>.:=!?*#&%$"
RUNS = re.compile(r"[a-z]+|[A-Z]+|\d+|[^a-zA-Z\d]+")


#: Shapes of names that are long and mixed but no secrets.
LINK, UUID = re.compile(r"www\.|data:|[a-z][a-z0-9+.-]*://(?![^/@]*:[^/@]*@)"), re.compile(r"\{?[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\}?")
FILE = re.compile(r"[\w./\\~%-]*[\w%-]\.[A-Za-z][A-Za-z0-9]{1,4}")


def signature(token: str, known: frozenset = frozenset()) -> tuple:
    """What a token looks like, and the token where it is a known one; tokens with one signature are alike to the model."""
    core = token.strip(EDGE)
    low = token.lower()
    name = own if (own := low.strip(EDGE) or low) in known else ""
    speak = bool(SPEAK.search(low))
    sign = low in ("=", ":", ":=", "=>", "->", "is") or low[-1:] in ("=", ":")
    if core.isalpha() and not speak:
        return ("word", min(len(core) // 8, 3), sign, core.isupper(), not core.isascii(), name)
    value = core.split("=", 1)[1].strip(EDGE) if "=" in core else core
    plain = value.isascii()
    lower, upper = any("a" <= c <= "z" for c in value), any("A" <= c <= "Z" for c in value)
    digits = sum(c.isdigit() for c in value)
    n = len(value)
    size = 0 if n < 6 else 1 if n < 10 else 2 if n < 16 else 3 if n < 24 else 4
    runs = len(RUNS.findall(value))
    mixed = min(runs * 8 // max(n, 1), 4) if n >= 8 else 5
    start = any(value.startswith(s) for s in STARTS)
    kind = "mail" if "@" in core else "link" if LINK.match(core) else "uuid" if UUID.fullmatch(value) else "file" if FILE.fullmatch(core) else "ip" if n and not lower and not upper else "text"
    share = 0 if not digits else 1 if 4 * digits < n else 2 if 2 * digits < n else 3
    return ("value", size, lower, upper, share, mixed, start, kind, speak, sign, "=" in core, plain, name)


def signature_features(sig: tuple) -> dict[str, list[str]]:
    """Features of a token for itself and for its neighbours."""
    if sig[0] == "word":
        _, size, sign, upper, foreign, name = sig
        own = [f"w{size}", "word", f"up{upper}", f"far{foreign}"]
        return {"own": own, "prev": [f"pw{sign}", f"pi{name}"], "prev2": ["p2w", f"p2i{name}"], "next": ["nw"]}
    _, size, lower, upper, share, mixed, start, kind, speak, sign, equals, plain, name = sig
    own = [
        "value", f"s{size}", f"k{kind}", f"st{start}", f"sp{speak}", f"m{mixed}", f"d{share}", f"lu{lower}{upper}",
        f"s{size}m{mixed}d{share}", f"s{size}lu{lower}{upper}d{share}", f"k{kind}s{size}", f"eq{equals}sp{speak}s{size}", f"pl{plain}",
    ]
    around = f"{speak}{sign}"
    return {"own": own, "prev": [f"p{around}", f"pk{kind}", f"pi{name}"], "prev2": [f"p2{speak}", f"p2i{name}"], "next": [f"n{speak}{kind}"]}


def file_features(text: str) -> list[str]:
    """Of the whole text: does it look like settings, code or prose."""
    lines, signs, braces = text.count("\n") + 1, text.count("=") + text.count(": "), text.count("{") + text.count(";")
    return [f"signs{min(2 * signs // lines, 2)}", f"braces{min(4 * braces // lines, 2)}", f"begin{'-----BEGIN' in text}"]


# ---- labelled lines ----------------------------------------------------------


def labelled_lines(n: int, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """Lines of invented prose, about half with one secret, tagged token by token."""
    r = random.Random(seed)
    letters, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    syllables = ["".join(r.choice(p) for p in (letters, "aeiouéäó", letters)[: r.randint(2, 3)]) for _ in range(120)]
    mixed = letters + letters.upper() + digits

    def text(alphabet: str, a: int, b: int) -> str:
        return "".join(r.choice(alphabet) for _ in range(r.randint(a, b)))

    def word() -> str:
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 6)))
        return r.choice([w, w, w, w.capitalize(), w + r.choice(".,;:!?"), w + r.choice(["***", "%%%", "&&&", "!!"]), w.upper()])

    def harmless() -> list[str]:
        return r.choice([
            lambda: [text(digits, 1, 9)], lambda: [f"{text(letters, 3, 9)}.{text(digits, 1, 2)}@{text(letters, 3, 8)}.example.com"],
            lambda: [".".join(str(r.randint(0, 255)) for _ in range(4))], lambda: ["https://" + text(letters, 4, 9) + ".org/" + text(mixed, 4, 12)],
            lambda: [f"+1 ({text(digits, 3, 3)})", f"{text(digits, 3, 3)}-{text(digits, 4, 4)}"], lambda: [text(digits, 16, 16)],
            lambda: [f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"], lambda: [f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}"],
            lambda: [r.choice(["secret", "password", "token", "secrets", "tokens", "passwords"]), word()], lambda: ["the", r.choice(["secret", "token", "password"]), "is", word()],
            lambda: [text(letters, 2, 8) + "-" + text(letters, 2, 8)], lambda: [f"{text(letters, 2, 6)}_{text(letters, 2, 6)}()"], lambda: [f"{text(letters, 2, 6)}={text(digits, 1, 3)}"],
            lambda: [text(letters, 2, 5), "=", text(digits, 1, 4)], lambda: [text(letters, 2, 5) + ":", word()], lambda: ["token", "=", text(letters, 1, 5)], lambda: [text(letters, 20, 40)],
            lambda: [text(letters, 4, 9).capitalize() + text(digits, 1, 2)], lambda: [text(letters.upper(), 2, 6) + "-" + text(digits, 1, 4)], lambda: ["#" + text("0123456789abcdef", 6, 6)],
            lambda: ["-".join(text("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12))], lambda: [f"{text(letters, 2, 6)}_{text(digits, 6, 14)}{text('_' + letters, 0, 4)}." + r.choice(["jpg", "png", "txt", "tar", "log", "csv"])],
            lambda: ["data:" + text(letters, 4, 6) + "/" + text(letters, 3, 4) + ";base64," + text(mixed + "+/", 12, 60)], lambda: ["https://" + text(letters, 4, 9) + ".com/" + text(letters, 3, 8) + "/" + text(mixed, 8, 30) + "?" + text(letters, 1, 4) + "=" + text(mixed, 3, 16)],
            lambda: [r.choice(["id", "request", "trace", "file", "commit", "build"]) + r.choice([":", "=", ""]), "-".join(text("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12))],
            lambda: ["/" + "/".join(text(letters + "_", 2, 9) for _ in range(r.randint(2, 5)))], lambda: [text(letters, 3, 8) + "-" + text(digits, 1, 2) + "." + text(digits, 1, 2) + "." + text(digits, 1, 2) + "-" + text(letters, 3, 6)],
        ])()

    def value() -> str:
        return r.choice([
            lambda: text("0123456789abcdef", 24, 64), lambda: "AKIA" + text(letters.upper() + digits, 16, 20), lambda: r.choice(STARTS) + text(mixed, 16, 40),
            lambda: text(mixed + "+/", 20, 44), lambda: text(mixed, 8, 16) + r.choice("!@#$") + text(digits, 1, 3), lambda: text(mixed + "_-", 16, 40),
        ])()

    def secret() -> tuple[list[str], list[int]]:
        name = r.choice(["password", "passwd", "pwd", "secret", "client_secret", "token", "api_key", "apikey", "access_key", "auth_token", "passphrase", "DB_PASSWORD", "SECRET_KEY"])
        name, quote, v = r.choice([name, name, name.upper()]), r.choice(['"', "'", "", ""]), value()
        return r.choice([
            lambda: ([name, r.choice(["=", ":", ":=", "=>", "->"]), quote + v + quote], [0, 0, 1]), lambda: ([name + r.choice("=:") + quote + v + quote], [1]),
            lambda: ([name + ":", quote + v + quote], [0, 1]), lambda: ([name, "is", quote + v + quote], [0, 0, 1]), lambda: (["Authorization:", "Bearer", v], [0, 0, 1]),
            lambda: ([v], [1]), lambda: ([name + ":", *[x + text(digits, 1, 3) for x in (r.choice(syllables), r.choice(syllables))]], [0, 1, 2]),
        ])()

    out = []
    for i in range(n):
        tokens, tags = [], []
        at = r.randint(0, 8) if i % 2 else -1
        for j in range(r.randint(9, 14)):
            if j == at:
                more, marks = secret()
                tokens += more
                tags += marks
            new = harmless() if r.random() < 0.2 else [word()]
            tokens += new
            tags += [0] * len(new)
        out.append((tokens[:20], tags[:20]))
    return out


def words_before(data: list[tuple[list[str], list[int]]], least: int = 15) -> frozenset:
    """Tokens that often stand one or two places before a secret."""
    count = Counter(t.lower().strip(EDGE) or t.lower() for tokens, tags in data for j, y in enumerate(tags) if y == BEGIN for t in tokens[max(0, j - 2) : j])
    return frozenset(t for t, n in count.items() if n >= least)


# ---- the model ---------------------------------------------------------------


class Field:
    """Weights by feature, the moves between tags, and scores by signature."""

    def __init__(self, weights: dict[str, np.ndarray], moves: np.ndarray, known: frozenset = frozenset()):
        self.weights, self.moves, self.known = weights, moves, known
        self.rows: dict[tuple, int] = {}
        self.table = np.zeros((0, 12))
        self.seen: dict[str, int] = {}

    def sum(self, names: list[str]) -> np.ndarray:
        return sum((self.weights[x] for x in names if x in self.weights), np.zeros(3))

    def row(self, token: str, most: int = 500_000) -> int:
        sig = signature(token, self.known)
        if sig not in self.rows:
            found = signature_features(sig)
            self.table = np.vstack([self.table, np.concatenate([self.sum(found[g]) for g in ("own", "prev", "prev2", "next")])])
            self.rows[sig] = len(self.rows)
        if len(self.seen) >= most:
            self.seen.clear()
        self.seen[token] = self.rows[sig]
        return self.rows[sig]

    def tags(self, tokens: list[str], text: str) -> np.ndarray:
        get, row = self.seen.get, self.row
        ids = np.array([i if (i := get(t)) is not None else row(t) for t in tokens], dtype=np.int64)
        found = self.table[ids]
        scores = found[:, :3] + self.sum(file_features(text))
        scores[1:] += found[:-1, 3:6]
        scores[2:] += found[:-2, 6:9]
        scores[:-1] += found[1:, 9:12]
        return decode(scores, self.moves)


def leaning(field: Field, margin: float) -> Field:
    """The field with ``margin`` added to the outside of every token."""
    more = {x: field.weights[x] + np.array([margin, 0, 0]) for x in ("word", "value")}
    return Field(field.weights | more, field.moves, field.known)


def f_score(field: Field, data: list[tuple[list[str], list[int]]]) -> float:
    """Harmonic mean of precision and recall over tokens."""
    hit = found = true = 0
    for tokens, tags in data:
        got, want = field.tags(tokens, " ".join(tokens)) > 0, np.array(tags) > 0
        hit, found, true = hit + int((got & want).sum()), found + int(got.sum()), true + int(want.sum())
    return 2 * hit / max(found + true, 1)


@functools.lru_cache(maxsize=2)
def fit(lines: int = 3000, rounds: int = 250, seed: int = 7) -> Field:
    """Maximum likelihood by Adam over made lines; the leaning to the outside is the best of a few on other lines."""
    data = labelled_lines(lines, seed)
    known = words_before(data)
    names: dict[str, int] = {}
    slots = 32
    ids = np.zeros((lines, 20, slots), dtype=np.int64)  # 0: no feature
    tags, mask = np.zeros((lines, 20), dtype=np.int64), np.zeros((lines, 20), dtype=bool)
    for i, (tokens, marks) in enumerate(data):
        found = [signature_features(signature(t, known)) for t in tokens]
        whole = file_features(" ".join(tokens))
        for j in range(len(tokens)):
            own = found[j]["own"] + whole
            own += found[j - 1]["prev"] if j else []
            own += found[j - 2]["prev2"] if j > 1 else []
            own += found[j + 1]["next"] if j + 1 < len(tokens) else []
            ids[i, j, : len(own)] = [names.setdefault(x, len(names) + 1) for x in own]
        tags[i, : len(marks)], mask[i, : len(marks)] = marks, True
    w, moves = np.zeros((len(names) + 1, 3)), np.zeros((3, 3))
    moment = [np.zeros_like(w), np.zeros_like(moves)], [np.zeros_like(w), np.zeros_like(moves)]
    order = np.random.default_rng(seed)
    for step in range(1, rounds + 1):
        pick = order.choice(lines, 256, replace=False)
        own = ids[pick]
        _, g, gm = chain_gradient(w[own].sum(axis=2), moves, tags[pick], mask[pick])
        gw = np.zeros_like(w)
        np.add.at(gw, own, np.broadcast_to(g[:, :, None, :], (*own.shape, 3)))
        gw[0] = 0
        for k, (value, grad) in enumerate(((w, gw / 256 + 1e-4 * w), (moves, gm / 256))):
            m, v = moment[0][k], moment[1][k]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value -= 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    weights = {x: w[i] for x, i in names.items()}
    fields = [leaning(Field(weights, moves, known), m / 2) for m in range(5)]
    held_out = labelled_lines(lines // 4, seed + 1)
    scores = [f_score(f, held_out) for f in fields]
    return fields[int(np.argmax(scores))]


def field_spans(field: Field, text: str) -> list[tuple[int, int]]:
    """Spans that the field tags, without quotes and the like at their ends."""
    tokens = text.split()
    if not tokens:
        return []
    tags = field.tags(tokens, text)
    if not tags.any():
        return []
    places = [m.span() for m in re.finditer(r"\S+", text)]
    out, i = [], 0
    while i < len(tags):
        if tags[i]:
            j = i + 1
            while j < len(tags) and tags[j] == INSIDE:
                j += 1
            a, z = places[i][0], places[j - 1][1]
            while a < z and text[a] in EDGE:
                a += 1
            while z > a and text[z - 1] in EDGE:
                z -= 1
            if a < z:
                out.append((a, z))
            i = j
        else:
            i += 1
    return out


def all_spans(field: Field, text: str) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    more = [(a, z, "crf") for a, z in field_spans(field, text) if not any(a < y and x < z for x, y, _ in base)]
    return sorted(base + more, key=lambda s: (s[0], ("assign", "access", "hex", "crf").index(s[2]), s[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{z}" for a, z, kind in spans)


def scan(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``, one row per input row.

    The counts and the digest are of the patterns alone. A null text is empty,
    a very long one is read whole. Repeated rows come back alike, rows without an
    id, too; other columns aren't read. An empty table gives no rows.
    """
    model = fit()
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.moves, model.known))
    made: list[Field] = []

    def run(ids, texts):
        field = made[0] if made else made.append(Field(*held.value)) or made[0]
        out: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
        for text in texts:
            spans = all_spans(field, text or "")
            base = [s for s in spans if s[2] != "crf"]
            for kind in KINDS:
                out[f"n_{kind}"].append(sum(s[2] == kind for s in base))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(spans))
        return {"doc_id": ids} | out

    return map_columns(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id", "text"],
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", run,
    )
