"""Personal data: generators propose overlapping spans, boosted trees score them, calibrated thresholds select."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, forget, only

KINDS = ("email", "ip", "card", "phone")
#: Base patterns (fixed values). A digit before a run of digits cannot start another match, so it is ruled out at once.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Generators beyond the base: written-out addresses, long hexadecimal addresses, other separators, no plus sign.
AT = r"\x20?(?:\(at\)|\[at\]|\x20at\x20|@)\x20?"
DOT = r"\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?"
WIDE = {
    "email": re.compile(rf"\b[A-Za-z0-9._%+-]{{1,64}}{AT}[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{2,24}}){{1,3}}\b"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){3,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{1,2}[0-9]{4}){2}[\x20./_-]{1,2}[0-9]{1,7}(?![0-9])"),
    "phone": re.compile(r"(?<![0-9.+])(?:00[0-9]{1,3}[\x20.-]?)?\(?[0-9]{2,5}\)?(?:[\x20./-]{1,2}[0-9]{2,5}){1,4}(?![0-9])"),
}
#: Words nearby that tell kinds and other numbers apart (fixed values).
NEAR = {
    "email": ("mail", "contact", "write", "correo", "adresse"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "carte", "karte", "tarjeta", "paid"),
    "phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "appel"),
    "other": ("order", "invoice", "version", "ref", "isbn", "date", "total", "price", "page", "no"),
}
#: A text without any of these has no candidate.
ANY = re.compile(r"[0-9@]|\(at\)|\[at\]|\x20at\x20.{1,80}(?:dot|\.)|(?:[A-Fa-f]{1,4}:){3}")
AROUND = 40


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign with the run before it and the domain after it: linear in the text, however long a run is."""
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        at = at + 1
        if m:
            yield start, m.end()
            end = at = m.end()


def base(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base rules, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(len(x := p.lstrip("0") or "0") <= 3 and int(x) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return out


def proposals(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the wide generators; they may overlap."""
    return [(k, *m.span()) for k, name in enumerate(KINDS) for m in WIDE[name].finditer(text)]


def features(text: str, kind: int, start: int, end: int) -> list[float]:
    """Format of the span and what stands around it."""
    span = text[start:end]
    digits = digits_of(span)
    groups = re.findall(r"[0-9]+", span)
    before, after = text[max(0, start - AROUND) : start].lower(), text[end : end + AROUND].lower()
    near = set(re.findall(r"[a-z]+", before)) | set(re.findall(r"[a-z]+", after))
    hits = {k: sum(any(w.startswith(x) for w in near) if len(x) > 2 else x in near for x in words) for k, words in NEAR.items()}
    return [
        *(float(kind == k) for k in range(len(KINDS))), len(span), len(digits), sum(c.isalpha() for c in span), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        span.count("."), span.count("-"), span.count(" "), span.count(":"), span.count("("), float("@" in span), float(luhn(digits) if digits else 0), float(bool(digits) and digits[0] == "0"),
        len(set(digits)), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(after[:1] in "%€$"), hits[KINDS[kind]], hits["other"], sum(hits[k] for k in KINDS) - hits[KINDS[kind]],
        float(bool(re.search(r"dot|\bat\b", span))),
    ]


#: How many features there are. All are whole numbers of a bounded span or of flags, so each fits a byte.
WIDTH = len(features("", 0, 0, 0))


def packed(rows: list[list[float]]) -> np.ndarray:
    return np.minimum(np.array(rows).reshape(-1, WIDTH), 255).astype(np.uint8)


@dataclass
class Trees:
    """Gradient-boosted trees for the logistic loss; a tree is arrays of (feature, threshold, left, right, value)."""

    bias: float
    trees: list[list[tuple]]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.bias)
        for tree in self.trees:
            node = np.zeros(len(x), np.int64)
            feature, cut, left, right, value = (np.array(c) for c in zip(*tree, strict=True))
            for _ in range(len(tree)):
                inner = feature[node] >= 0
                if not inner.any():
                    break
                low = x[np.arange(len(x)), np.maximum(feature[node], 0)] <= cut[node]
                node = np.where(inner, np.where(low, left[node], right[node]), node)
            out += value[node]
        return out


def grow(x: np.ndarray, slope: np.ndarray, weight: np.ndarray, count: np.ndarray, depth: int, least: int = 10, ridge: float = 1.0, rate: float = 0.2) -> list[tuple]:
    """One tree on second-order gains; sums by value of a feature (a byte) give every cut. ``count`` says how many rows each row stands for."""
    tree: list[tuple] = []

    def build(rows: np.ndarray, level: int) -> int:
        at, g, h, n = len(tree), slope[rows].sum(), weight[rows].sum(), count[rows].sum()
        tree.append((-1, 0.0, 0, 0, -rate * g / (h + ridge)))
        best = (1e-6, -1, 0.0)
        if level and n >= 2 * least:
            for f in range(x.shape[1]):
                v = x[rows, f]
                held = np.flatnonzero(np.bincount(v))
                ns, gs, hs = (np.cumsum(np.bincount(v, c[rows]))[held[:-1]] for c in (count, slope, weight))
                cuts = np.flatnonzero((ns >= least) & (n - ns >= least))
                if len(cuts):
                    gain = gs[cuts] ** 2 / (hs[cuts] + ridge) + (g - gs[cuts]) ** 2 / (h - hs[cuts] + ridge) - g**2 / (h + ridge)
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, float((held[cuts[k]] + held[cuts[k] + 1]) / 2))
        if best[1] >= 0:
            low = x[rows, best[1]] <= best[2]
            left, right = build(rows[low], level - 1), build(rows[~low], level - 1)
            tree[at] = (best[1], best[2], left, right, 0.0)
        return at

    build(np.arange(len(x)), depth)
    return tree


def boost(x: np.ndarray, y: np.ndarray, count: np.ndarray, rounds: int = 40, depth: int = 4) -> Trees:
    share = min(max(np.average(y, weights=count), 1e-3), 1 - 1e-3)
    model = Trees(float(np.log(share / (1 - share))), [])
    logit = np.full(len(y), model.bias)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-logit))
        model.trees.append(grow(x, count * (p - y), count * p * (1 - p), count, depth))
        logit += Trees(0.0, model.trees[-1:]).logits(x)
    return model


def examples(n: int, seed: int) -> list[tuple[str, int, int, int, int]]:
    """(text, kind, start, end, label): written examples of personal data and of other numbers, in filler words."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "the", "tion", "ou", "en", "sch", "que", "la", "ta", "re"]) for _ in range(r.randint(1, 3)))
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def paid() -> str:
        d = r.choice("345") + num(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def made(kind: int, good: bool) -> tuple[str, str]:
        sep = r.choice([" ", "-", "."])
        if kind == 0:
            name, host, top = word(), word(), r.choice(["com", "org", "net", "de"])
            if good:
                at, dot = r.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "."), (" [at] ", ".")])
                return name + at + host + dot + top, r.choice(NEAR["email"])
            return r.choice([f"{word()} at {word()}. {word()}", f"{word()} at {word()}.{word()}", f"look at {word()}. {word()}"]), r.choice([word(), "other"])
        if kind == 1:
            h = lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4)))
            if good:
                return ":".join([r.choice(["2001", "fe80", "2a02", "2606"])] + [h() for _ in range(7)]), r.choice(NEAR["ip"])
            return r.choice([f"{num(2)}:{num(2)}:{num(2)}:{num(2)}", ":".join(num(2) for _ in range(6)), f"{num(1)}:{num(1)}:{num(1)}:{num(1)}:{num(1)}"]), r.choice([word(), *NEAR["other"]])
        if kind == 2:
            if good:
                d = paid()
                return r.choice([".", "/", "_", "  "]).join(d[k : k + 4] for k in range(0, 16, 4)), r.choice(NEAR["card"])
            return r.choice([".", "/", "_", " ", "-"]).join(num(4) for _ in range(4)), r.choice([word(), *NEAR["other"]])
        if good:
            return r.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}{sep}{num(3)}{sep}{num(4)}", f"0{num(3)}{sep}{num(3)}{sep}{num(4)}", f"00{num(2)} {num(3)} {num(3)} {num(4)}"]), r.choice(NEAR["phone"])
        return r.choice([f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(3)} {num(3)}", f"{num(2)}.{num(2)}", f"{num(3)}-{num(2)}-{num(4)}", f"{num(3)} {num(3)} {num(4)}", f"{num(2)}/{num(2)}/{num(4)}"]), r.choice([word(), *NEAR["other"]])

    out = []
    while len(out) < n:
        kind, good = r.randrange(4), r.random() < 0.5
        span, cue = made(kind, good)
        if not good and r.random() < 0.2:
            cue = r.choice(NEAR[KINDS[kind]])
        left = " ".join([word() for _ in range(r.randint(1, 5))] + ([cue] if r.random() < 0.6 else []))
        text = f"{left}{r.choice([' ', ': '])}{span}{r.choice([' ', '. ', ', '])}{word()}"
        for k, a, b in proposals(text):
            out.append((text, k, a, b, int(good and k == kind and text[a:b].strip() == span.strip())))
    return out


def respelled(kind: int, span: str, turn: int) -> str:
    """A base span in a format that only the wide generators read; ``turn`` chooses among a few."""
    d = digits_of(span)
    if kind == 0:
        name, host = span.rsplit("@", 1)
        at, dot = ((" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" [at] ", "."))[turn % 4]
        return name + at + host.replace(".", dot)
    if kind == 1:
        return "2001:db8:" + ":".join(f"{int(x.lstrip('0') or 0) + 256 * (turn % 250 + k):x}" for k, x in enumerate(span.split(".")))
    if kind == 2:
        return (".", "/", "_")[turn % 3].join(d[k : k + 4] for k in range(0, 16, 4))
    d = d[-10:].rjust(10, "5")
    return (f"({d[:3]}) {d[3:6]}-{d[6:]}", f"0{d[:3]} {d[3:6]} {d[6:]}", f"00{turn % 89 + 10} {d[:3]} {d[3:6]} {d[6:]}")[turn % 3]


def spoiled(kind: int, span: str, turn: int) -> str:
    """What looks much like ``respelled`` but is no personal data: a sentence, a clock, a wrong check digit, a date."""
    d = digits_of(span).rjust(16, "3")
    if kind == 0:
        return f"{span.split('@')[0]} at {span.split('@')[1].split('.')[0]}. And"
    if kind == 1:
        return ":".join(f"{int(d[2 * k : 2 * k + 2]) % 60:02}" for k in range(4 + turn % 2))
    if kind == 2:
        wrong = d[:15] + str((int(d[15]) + 1 + turn % 8) % 10)
        return (".", "/", "_")[turn % 3].join(wrong[k : k + 4] for k in range(0, 16, 4)) if not luhn(wrong) else "1234/1234/1234/1234"
    return (f"20{d[:2]}-{int(d[2:4]) % 12 + 1:02}-{int(d[4:6]) % 28 + 1:02}", f"{d[:3]} {d[3:6]}", f"{int(d[:2]) % 28 + 1:02}.{int(d[2:4]) % 12 + 1:02}.20{d[4:6]}")[turn % 3]


def candidates(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and what the wide generators propose that overlaps none of them."""
    if not ANY.search(text):
        return [], []
    sure = base(text)
    taken = occupied(sure)
    return sure, sorted({p for p in proposals(text) if taken.free(p[1], p[2])})


def lessons(text: str, turn: int, sure: list[tuple[int, int, int]]) -> Iterator[tuple[list[float], int]]:
    """(features, label) of what is proposed where base spans are respelled (1) or spoiled (0) in their places."""
    for kind, a, b in sure:
        for label, made in ((1, respelled(kind, text[a:b], turn + a)), (0, spoiled(kind, text[a:b], turn + a))):
            left = text[max(0, a - 2 * AROUND) : a]
            other = left + made + text[b : b + 2 * AROUND]
            whole = (kind, len(left), len(left) + len(made))
            for p in proposals(other):
                if p[1] < whole[2] and whole[1] < p[2] and (label == 0 or p == whole):
                    yield features(other, *p), label


def trials(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels from real texts: ``lessons``, and what is proposed beside the base spans (0)."""
    rows: list[list[float]] = []
    labels: list[float] = []
    for text in texts:
        sure, more = candidates(text or "")
        for x, label in [*lessons(text, split(text)[1], sure), *((features(text, *p), 0) for p in more)] if sure or more else ():
            rows.append(x)
            labels.append(float(label))
    return packed(rows), np.array(labels)


def split(text: str) -> tuple[int, int]:
    """(half, turn) of a text, by its hash: copies fall in the same half."""
    h = zlib.crc32(text.encode())
    return h & 1, h >> 1


def platt(logit: np.ndarray, label: np.ndarray, count: np.ndarray | None = None, steps: int = 50) -> tuple[float, float]:
    """(slope, shift) of the logistic curve from scores to probabilities, with smoothed targets, by Newton's method."""
    count = np.ones(len(logit)) if count is None else count
    up, down = (count * label).sum(), (count * (1 - label)).sum()
    target = np.where(label > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, w = np.stack([logit, np.ones(len(logit))], axis=1), np.array([0.5, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (count * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (count * (p - target)) + 1e-3 * w)
    return float(w[0]), float(w[1])


def calibrated(model: Trees, x: np.ndarray, y: np.ndarray, precision: float, count: np.ndarray | None = None) -> list[float]:
    """For each kind, the least score whose probability is ``precision`` on rows that the trees have not seen.

    A kind without rows of both labels, or whose scores do not rise with the label, adds no span.
    """
    count = np.ones(len(y)) if count is None else count
    logit, cuts = (model.logits(x) if len(x) else np.zeros(0)), []
    for kind in range(len(KINDS)):
        own = x[:, kind] == 1 if len(x) else np.zeros(0, bool)
        slope, shift = platt(logit[own], y[own], count[own]) if len(set(y[own])) == 2 else (0.0, 0.0)
        cuts.append((float(np.log(precision / (1 - precision))) - shift) / slope if slope > 1e-6 else float("inf"))
    return cuts


def train(texts: list[str | None] | None = None, n: int = 2400, seed: int = 11, precision: float = 0.95) -> tuple[Trees, list[float]]:
    """The model of ``learned`` from a list of texts."""
    halves = [[t for t in texts or [] if t and split(t)[0] == k] for k in range(2)]
    return learned([(x, y, np.ones(len(y))) for x, y in map(trials, halves)], n, seed, precision)


def learned(halves: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int = 2400, seed: int = 11, precision: float = 0.95) -> tuple[Trees, list[float]]:
    """Trees learned from one half of the written examples and of the real rows; thresholds calibrated on the other halves.

    A half of the real rows is (features, labels, counts). Where they are more than the written ones, these count as many
    times as make both weigh the same, so formats that no respelling has are not lost.
    """
    rows = examples(n, seed)
    written = packed([features(t, k, a, b) for t, k, a, b, _ in rows]), np.array([float(r[4]) for r in rows])
    both = []
    for k, (x, y, count) in enumerate(halves):
        own = len(written[1][k::2])
        each = np.full(own, max(1.0, count.sum() / own))
        both.append((np.concatenate([written[0][k::2], x]), np.concatenate([written[1][k::2], y]), np.concatenate([each, count])))
    model = boost(*both[0])
    x, y, count = both[1]
    return model, calibrated(model, x, y, precision, count)


def folded(found: DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The real rows of both halves, equal ones counted, in an order that does not depend on how the texts are split.

    Only distinct rows reach the driver, 27 bytes each and a count.
    """

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows: Counter = Counter()
            for half, seen, made in zip(*(batch.column(c).to_pylist() for c in ("half", "seen", "made")), strict=True):
                for k in range(0, len(seen), WIDTH):
                    rows[half, seen[k : k + WIDTH] + b"\0"] += 1
                for k in range(0, len(made), WIDTH + 5):
                    rows[half, made[k : k + WIDTH + 1]] += int.from_bytes(made[k + WIDTH + 1 : k + WIDTH + 5], "little")
            halves, keys = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(halves, pa.int32()), pa.array(keys, pa.binary()), pa.array(list(rows.values()), pa.int64())], names=["half", "row", "n"])

    counted = found.select("half", "seen", "made").mapInArrow(count, "half int, row binary, n long").groupBy("half", "row").agg(F.sum("n").alias("n")).toArrow().sort_by([("half", "ascending"), ("row", "ascending")])
    half, n = counted["half"].to_numpy(), counted["n"].to_numpy().astype(float)
    rows = np.frombuffer(b"".join(counted["row"].to_pylist()), np.uint8).reshape(-1, WIDTH + 1)
    return [(rows[half == k, :WIDTH], rows[half == k, WIDTH].astype(float), n[half == k]) for k in range(2)]


def chosen(sure: list, more: list, logit: np.ndarray, cuts: list[float]) -> list[tuple[int, int, int]]:
    """Those of ``more`` that reach their kind's threshold: the best scored first, none overlapping."""
    taken, added = occupied(sure), []
    for k in np.lexsort((np.arange(len(more)), -logit)).tolist():
        kind, a, b = more[k]
        if logit[k] >= cuts[kind] and taken.free(a, b):
            taken.add(a, b)
            added.append(more[k])
    return sorted(added)


def spans(text: str, model: Trees, cuts: list[float]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and the spans that the trees add beside them."""
    sure, more = candidates(text)
    return sure, chosen(sure, more, model.logits(packed([features(text, *p) for p in more])), cuts) if more else []


class Taken:
    """Disjoint stretches of a text, in order; stretches that overlap are joined. A look-up is a binary search."""

    def __init__(self):
        self.starts: list[int] = []
        self.ends: list[int] = []

    def reach(self, a: int, b: int) -> tuple[int, int]:
        """Which stretches overlap [a, b)."""
        return bisect_right(self.ends, a), bisect_left(self.starts, b)

    def free(self, a: int, b: int) -> bool:
        first, end = self.reach(a, b)
        return first >= end

    def add(self, a: int, b: int) -> None:
        first, end = self.reach(a, b)
        if first < end:
            a, b = min(a, self.starts[first]), max(b, self.ends[end - 1])
        self.starts[first:end], self.ends[first:end] = [a], [b]


def occupied(sure: list[tuple[int, int, int]]) -> Taken:
    taken = Taken()
    for _, a, b in sorted(sure, key=lambda x: x[1:]):
        taken.add(a, b)
    return taken


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: tuple[Trees, list[float]] | None = None) -> DataFrame:
    """Spans of e-mail and IP addresses, card and phone numbers in every whole text.

    Returns (id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added). Base spans always stay and are what the
    counts and the digest show; the trees add spans in other formats beside them, and none that overlap them.

    One pass over the texts writes their base spans, what is proposed beside them with its features, and what is proposed
    where base spans are respelled and spoiled. Without a ``model``, trees and thresholds are learned from all of these
    rows, of every text, and from written examples; a second pass, over the rows alone, scores the proposals. Null and
    empty texts have no span. Null ids stay null, repeated rows give repeated results, an empty table gives an empty result.
    """
    source = only(docs, id=id_col, text=text_col)
    learn = model is None

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        forget()
        for batch in batches:
            out = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                sure, more = candidates(text)
                half, turn = split(text) if learn and (sure or more) else (0, 0)
                made = Counter(packed([x]).tobytes() + bytes([label]) for x, label in lessons(text, turn, sure)) if learn else {}
                out.append((half, *(np.array(x, np.int32).tobytes() for x in (sure, more)), b"".join(packed([features(text, *p)]).tobytes() for p in more), b"".join(row + n.to_bytes(4, "little") for row, n in made.items())))
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int32(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=["id", "half", "sure", "more", "seen", "made"])

    parts = [T.StructField("half", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("sure", "more", "seen", "made")]]
    found = source.mapInArrow(read, T.StructType([source.schema["id"], *parts]))
    if learn:
        found = durable(found)
    trees, cuts = learned(folded(found)) if learn else model
    shipped = docs.sparkSession.sparkContext.broadcast((trees.bias, trees.trees, cuts))

    def score(batches: Iterator) -> Iterator:
        import pyarrow as pa

        bias, grown, cuts = shipped.value
        model = Trees(bias, grown)
        triples = lambda held: list(map(tuple, np.frombuffer(held, np.int32).reshape(-1, 3).tolist()))
        written = lambda found: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(found))
        for batch in batches:
            out, at = [], 0
            logit = model.logits(np.frombuffer(b"".join(batch.column("seen").to_pylist()), np.uint8).reshape(-1, WIDTH))
            for sure, more in zip(map(triples, batch.column("sure").to_pylist()), map(triples, batch.column("more").to_pylist()), strict=True):
                added = chosen(sure, more, logit[at : at + len(more)], cuts) if more else []
                at += len(more)
                out.append((*(sum(k == kind for k, _, _ in sure) for kind in range(len(KINDS))), hashlib.sha256(written(sure).encode()).hexdigest(), written(sure + added), len(added)))
            columns = list(zip(*out, strict=True)) if out else [[]] * (len(KINDS) + 3)
            kinds = [pa.int64()] * len(KINDS) + [pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=["id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"])

    more = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_added", T.LongType())]
    return found.select("id", "sure", "more", "seen").mapInArrow(score, T.StructType([source.schema["id"], *more])).withColumnRenamed("id", id_col)
