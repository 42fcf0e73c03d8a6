"""Payloads and plans in numpy: resampled positions, weighted means, plan probabilities, compaction quality, text ratios."""

from __future__ import annotations

import difflib
import itertools
import unicodedata

import numpy as np

from .chunks import longest, sentences, tidy


def resample(values: np.ndarray, count: int) -> np.ndarray:
    """Rows at ``count`` even places from the first to the last, linearly between neighbours."""
    values = np.asarray(values, np.float64)
    if len(values) == count:
        return values
    at = np.linspace(0, len(values) - 1, count) if count > 1 else np.array([(len(values) - 1) / 2])
    low = np.floor(at).astype(int)
    part = (at - low)[:, None]
    return values[low] * (1 - part) + values[np.minimum(low + 1, len(values) - 1)] * part


def mean_payload(payloads: list[np.ndarray], weights: list[float]) -> np.ndarray:
    """The weighted mean of payloads, each brought to the weighted mean length (at least 1); even weights without mass."""
    w = np.asarray(weights, np.float64)
    w = w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))
    count = max(1, round(float(sum(a * len(p) for a, p in zip(w, payloads, strict=True)))))
    return sum(a * resample(p, count) for a, p in zip(w, payloads, strict=True))


def plan_probability(scores: list[float], groups: list[list[int]]) -> float:
    """The chance that drawing without replacement by softmax takes some group first, in any of its orders.

    Groups have at most four members; a group within another adds nothing.
    """
    s = np.exp(np.asarray(scores, np.float64) - max(scores))
    wanted = {tuple(sorted(set(g))) for g in groups}
    if any(len(g) > 4 for g in wanted):
        raise ValueError("groups of more than four members")
    least = [g for g in wanted if not any(set(h) < set(g) for h in wanted)]
    total = 0.0
    for size in {len(g) for g in least}:
        for g in (g for g in least if len(g) == size):
            for order in itertools.permutations(g):
                left, p = s.sum(), 1.0
                for k in order:
                    p *= s[k] / left
                    left -= s[k]
                total += p
    return min(1.0, total)


def compaction_quality(raw: np.ndarray, compact: np.ndarray, raw_bytes: int, compact_bytes: int, most_kl: float = 0.05, most_changed: float = 0.02) -> dict:
    """Mean KL of the answers before and after, the share whose choice changed, bytes saved, and what failed."""
    soft = lambda z: z - z.max(1, keepdims=True) - np.log(np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True))
    a, b = soft(np.asarray(raw, np.float64)), soft(np.asarray(compact, np.float64))
    kl, changed = float((np.exp(a) * (a - b)).sum(1).mean()), float((a.argmax(1) != b.argmax(1)).mean())
    failed = [name for name, bad in (("kl", kl > most_kl), ("choice", changed > most_changed), ("size", compact_bytes >= raw_bytes)) if bad]
    return {"kl": kl, "changed": changed, "saved": 1 - compact_bytes / max(raw_bytes, 1), "failed": failed}


def similarity(a: str, b: str) -> float:
    """How much two texts share as sequences of words."""
    return difflib.SequenceMatcher(None, a.split(), b.split(), autojunk=False).ratio()


def title(text: str) -> str:
    return tidy(unicodedata.normalize("NFC", text))


def folded(text: str) -> str:
    """Compatibility form, lower case, everything but letters and digits a space."""
    return tidy("".join(c if c.isalnum() else " " for c in unicodedata.normalize("NFKC", text).lower()))


def titles_agree(a: str, b: str, threshold: float = 0.6) -> bool:
    """One within the other, or alike enough letter by letter."""
    x, y = folded(a), folded(b)
    return bool(x and y) and (x in y or y in x or difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() >= threshold)


def prefix_target(text: str, low: int, high: int, count) -> str | None:
    """The longest run of whole sentences from the start within [low, high] tokens, else of whole words; null if too short."""
    parts = sentences(text)
    n = longest(1, len(parts), lambda k: count(" ".join(parts[:k])) <= high)
    whole = " ".join(parts[:n]) if n > 0 else ""
    if whole and count(whole) >= low:
        return whole
    words = text.split()
    n = longest(1, len(words), lambda k: count(" ".join(words[:k])) <= high)
    cut = " ".join(words[:n]) if n > 0 else ""
    return cut if cut and count(cut) >= low else None
