"""Queries that have no SQL, on the smallest tables, against plain loops."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.operators import ordered
from keelson.plans import catalog
from keelson.plans.corpus_queries import signs


def rows(spark, sf_dir, name):
    return [r.asDict() for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()]


def result(spark, sf_dir, name):
    return [tuple(r) for r in catalog.QUERIES[name](spark, sf_dir).collect()]


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    held = sorted((r["vec_id"], r["embedding"]) for r in rows(spark, sf_dir, "embeddings"))
    return [i for i, _ in held], np.array([v for _, v in held], np.float64)


def test_effective_rank(spark, sf_dir, vectors):
    s = np.linalg.svd(vectors[1], compute_uv=False)
    p = s[s > 0] / s.sum()
    (dims, rank), = result(spark, sf_dir, "effective_rank")
    assert dims == vectors[1].shape[1] and rank == pytest.approx(np.exp(-(p * np.log(p)).sum()), abs=1e-3)


def test_farthest_points(spark, sf_dir, vectors):
    ids, x = vectors
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    chosen = [0]
    while len(chosen) < 8:
        near = np.round(u @ u[chosen].T, 9).max(axis=1)
        chosen.append(min(range(len(ids)), key=lambda k: (near[k], ids[k])))
    assert [i for _, i in sorted(result(spark, sf_dir, "farthest_points"))] == [ids[k] for k in chosen]


def test_projected_lexical_topk(spark, sf_dir):
    def vector(text):
        terms = re.findall("[a-z0-9]+", (text or "").lower())
        return sum(((1 + np.log(terms.count(t))) * signs(t, 256, 1) for t in sorted(set(terms))), np.zeros(256))

    docs = {r["doc_id"]: vector(r["text"]) for r in rows(spark, sf_dir, "documents")}
    unit = {k: v / max(np.linalg.norm(v), 1e-12) for k, v in docs.items()}
    got = {}
    for q, i, score, rank in result(spark, sf_dir, "projected_lexical_topk"):
        got.setdefault(q, {})[rank] = (i, score)
    for r in rows(spark, sf_dir, "benchmark")[::7]:
        v = vector(r["text"])
        v = v / max(np.linalg.norm(v), 1e-12)
        want = sorted(((-round(float(v @ u), 6), k) for k, u in unit.items()))[:5]
        assert [got[r["item_id"]][k + 1][1] for k in range(5)] == pytest.approx([-s for s, _ in want], abs=2e-6)


def test_synthetic_world(spark, sf_dir):
    def pick(what, of, m):
        return int(hashlib.sha256(f"{what}\0{of}".encode()).hexdigest()[:8], 16) % m

    want = set()
    for r in rows(spark, sf_dir, "customer"):
        p = r["c_custkey"]
        seat = pick("seat", pick("employer", p, 50), 20)
        want.add((p, f"Where does the employer of P{p} sit?", f"City {seat}", seat == pick("city", p, 20)))
    assert set(result(spark, sf_dir, "synthetic_world")) == want


def test_paced_sources(spark, sf_dir):
    need = {}
    for r in rows(spark, sf_dir, "orders"):
        need[r["o_custkey"]] = need.get(r["o_custkey"], 0) + 1
    want, segments = set(), {}
    for r in sorted(rows(spark, sf_dir, "customer"), key=lambda r: r["c_custkey"]):
        if r["c_custkey"] in need:
            segments.setdefault(r["c_mktsegment"], []).append(r["c_custkey"])
    for segment, keys in segments.items():
        left = 2000
        for k, key in enumerate(keys):
            if need[key] + (len(keys) - k - 1) <= left:
                left -= need[key]
                want.add((segment, key, need[key]))
    assert {tuple(r) for r in catalog.QUERIES["paced_sources"](spark, sf_dir).select("c_mktsegment", "c_custkey", "need").collect()} == want


def test_token_windows(spark, sf_dir):
    got = {}
    for i, ordinal, a, b, rule in result(spark, sf_dir, "token_windows"):
        got.setdefault(i, {})[ordinal] = (a, b, rule)
    for r in rows(spark, sf_dir, "documents"):
        text = r["text"] or ""
        at, want = 0, []
        for para in re.split(r"\n\s*\n", text):
            at = text.index(para, at)
            words = [(m.start() + at, m.end() + at) for m in re.finditer(r"\S+", para)]
            if words and len(words) <= 64:
                want.append((words[0][0], words[-1][1], "paragraph"))
            elif words:
                for k in range(0, len(words), 48):
                    want.append((words[k][0], words[min(k + 63, len(words) - 1)][1], "overlap"))
                    if k + 64 >= len(words):
                        break
            at += len(para)
        assert [got.get(r["doc_id"], {})[k] for k in sorted(got.get(r["doc_id"], {}))] == want


def test_dialogue_passages(spark, sf_dir):
    by = {}
    for r in rows(spark, sf_dir, "conversations"):
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    got = {}
    for conv, ordinal, n, first, last in result(spark, sf_dir, "dialogue_passages"):
        got.setdefault(conv, []).append((ordinal, n, first, last))
    for conv, turns in by.items():
        told = sorted(got.get(conv, []))
        spoken = [k for k, (_, _, text) in enumerate(sorted(turns)) if (text or "").strip()]
        assert [o for o, *_ in told] == list(range(len(told))) and all(n <= 800 for _, n, _, _ in told)
        assert (told[0][2], told[-1][3]) == (spoken[0], spoken[-1]) if told else not spoken
        for (_, _, _, last), (_, _, first, _) in zip(told, told[1:], strict=False):
            assert first in (last, last + 1) or not any(last < k < first for k in spoken)
        full = sum(len(re.sub(r"\s+", " ", text).strip()) for _, _, text in turns if text)
        assert sum(n for _, n, _, _ in told) >= full


def test_sentence_spans_tile_the_text(spark, sf_dir):
    got = {}
    for i, ordinal, a, b in result(spark, sf_dir, "sentence_span_rows"):
        got.setdefault(i, []).append((ordinal, a, b))
    for r in rows(spark, sf_dir, "documents"):
        text, at = r["text"] or "", 0
        for _, a, b in sorted(got.get(r["doc_id"], [])):
            assert not text[at:a].strip() and a < b
            assert b == len(text) or text[b - 1] in ".!?" and text[b].isspace()
            at = b
        assert not text[at:].strip()


def test_html_text_has_the_visible_words(spark, sf_dir):
    from keelson.functions import html

    pages = {r["page_id"]: r["html"] for r in rows(spark, sf_dir, "pages")}
    for i, n, digest in result(spark, sf_dir, "html_text"):
        lines = html.lines(pages[i])
        assert n == len(lines) and digest == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        body = re.sub(r"(?s)<(script|style)[^>]*>.*?</\1>|<!--.*?-->|<head>.*?</head>", " ", pages[i] or "")
        assert not any(re.search(r"<[a-z/][^>]*>", line) for line in lines)
        plain = set(re.findall(r"[a-z]{4,}", " ".join(lines).lower()))
        assert plain <= set(re.findall(r"[a-z]{4,}", body.lower()))


def test_neighbours_equal_windows(spark):
    df = spark.createDataFrame([(k * 3 % 101, None if k % 3 == 0 else "a" if k % 5 else "b", None if k % 7 == 0 else k) for k in range(101)], "n long, key string, v long")
    out = ordered.neighbours(df, "key", "n", F.col("v"), 10, "p", "q").collect()
    by = {}
    for r in sorted(df.collect()):
        by.setdefault(r["key"], []).append((r["n"], r["v"]))
    want = {(k, n): (held[j - 1][1] if j else None, held[j + 1][1] if j + 1 < len(held) else None) for k, held in by.items() for j, (n, _) in enumerate(held)}
    assert {(r["key"], r["n"]): (r["p"], r["q"]) for r in out} == want and len(out) == 101
