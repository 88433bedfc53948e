"""Language, runs and ranked search against brute force, on small fixtures with nulls, ties, copies, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from navspark.llm import lang_id, periodic, ranked

EXTRA = "held_out string, score string, rank string, n_runs string, th string, query string, terms string, n string"
CLASH = ("x",) * 8


def frame(spark, rows):
    """rows: (doc_id, text, lang)."""
    return spark.createDataFrame([(*r, *CLASH) for r in rows], f"doc_id long, text string, lang string, {EXTRA}").repartition(3)


# ---- runs


def expected_runs(text, doc_id):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(12, 2 * q):
                part = words[i : j + q]
                if all(any(part[k] != part[k + d] for k in range(len(part) - d)) for d in range(1, q)):
                    runs.append((i, j - i + q, q))
            i = max(i + 1, j)
    runs.sort(key=lambda r: (r[0], r[2]))
    gone = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
    return (len(runs), *best, None if best[1] is None else 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def run_texts():
    rng = np.random.default_rng(5)
    out = [(None, None), (1, None), (2, ""), (3, "\n \t"), (4, "a"), (5, "a " * 11), (6, "a " * 12), (7, "a b " * 40), (8, "à b c " * 9 + "tail"), (None, "x y z " * 8)]
    for i in range(10, 150):  # about a tenth gets a repetition by its doc_id
        size, kinds = int(rng.integers(5, 260)), int(rng.integers(1, 30))
        words = [f"w{k}" for k in rng.integers(0, kinds, size)]
        if i % 3 == 0:
            p, a = int(rng.integers(1, 40)), int(rng.integers(0, size))
            words = words[:a] + (words[a : a + p] * 60)[:size]
        out.append((i, " ".join(words)))
    return [*out, out[40], out[40], (out[41][0], "other text"), (900, " ".join(f"v{k % 150}" for k in range(700)))]


@pytest.mark.parametrize("split", [1 << 20, 300])
def test_runs(spark, split):
    rows = run_texts()
    docs = frame(spark, [(i, t, None) for i, t in rows])
    got = Counter(tuple(r) for r in periodic.runs(docs, split, 50).select("doc_id", *periodic.FIELDS).collect())
    want = Counter((i, *expected_runs(t, i)) for i, t in rows)
    assert got == want
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows if i) > 5 and max(w[1] for w in want) > 1
    assert periodic.runs(docs.limit(0), split).count() == 0


def test_all_lags_of_one_word():
    """A text of one word has a true stretch at every lag and a single run."""
    found = periodic.least_lags(*periodic.repeats(*periodic.numbered([[b"a"] * 5000])))
    assert [x.tolist() for x in found] == [[0], [0], [5000], [1]]


# ---- ranked search


def searched(docs, items):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    bags = [(i, Counter(terms(t))) for i, t, _ in docs]
    full = [(i, b, b.total()) for i, b in bags if b]
    count, total = len(full), sum(n for _, _, n in full)
    df = Counter(t for _, b, _ in full for t in b)
    out = Counter()
    for item, text in set(items):
        scored = []
        for i, b, n in full:
            m = 75 + (25 * n * count) // total
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * ((10**9 * b[t]) // (1000 * b[t] + 12 * m)) for t in terms(text) if t in b)
            if s > 0:
                scored.append((-s, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out.update((item, k + 1, i, -s) for k, (s, _, i) in enumerate(scored[:20]))
    return out


def search_rows():
    rng = np.random.default_rng(3)
    rows = [(None, None, None), (1, "", None), (2, " ... ", None), (None, "alpha beta", None), (None, "alpha beta", None), (3, "ALPHA-beta Ünï", None), (4, "alpha " * 4000, None)]
    rows += [(i, " ".join(f"t{k}" for k in np.minimum(rng.zipf(1.4, int(rng.integers(1, 120))), 400)), None) for i in range(10, 200)]
    return rows + [(i, "one copied text of t3 and t7", None) for i in range(300, 420)] + [rows[20], rows[20]]


ITEMS = [(1, "alpha BETA"), (2, "t3 t7 t7 copied"), (3, None), (4, "!!"), (None, "t1 t2 t9"), (5, "never seen"), (6, " ".join(f"t{k}" for k in range(60))), (6, "ünï Ünï"), (2, "t3 t7 t7 copied")]


@pytest.mark.parametrize("most", [2_000, 2])
def test_search(spark, most, monkeypatch):
    rows = search_rows()
    docs, items = frame(spark, rows), spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, rank string")
    got = Counter(tuple(r) for r in ranked.ranked(docs, items, most).collect())
    assert got == searched(rows, [i for i in ITEMS if i[1] is not None])
    assert ranked.ranked(docs.limit(0), items).count() == 0 and ranked.ranked(docs, items.limit(0)).count() == 0


def test_bounds_hold(spark):
    """Upper bounds in steps are never below a score, and less than the weights above it; blocks may be small."""
    rng = np.random.default_rng(1)
    tf, n = rng.integers(1, 50, 5000), rng.integers(1, 5000, 5000)
    exact = ranked.impacts(tf, n, 1000, 300_000)
    up = -(-exact // ranked.STEP)
    assert up.max() <= 255 and exact.max() < 1_000_000
    assert (up * ranked.STEP >= exact).all() and ((up - 1) * ranked.STEP < exact).all()


# ---- language


def test_forward_sums_all_segmentations():
    import public_tokenizers

    of = lang_id.pieces(public_tokenizers.path(lang_id.VOCABULARY))
    rng = np.random.default_rng(2)
    model = rng.random((of.size, 2)) / of.size
    names = {}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(lang_id.VOCABULARY))
    for i in range(of.size):
        names[sp.id_to_piece(i)] = i

    def total(unit, k):
        if not unit:
            return 1.0
        out = sum(max(model[names[unit[:j]], k], lang_id.LEAST) * total(unit[j:], k) for j in range(1, len(unit) + 1) if unit[:j] in names)
        if unit[0] not in names:
            out += max(np.prod([model[of.bytes[b], k] for b in unit[0].encode()]), lang_id.LEAST) * total(unit[1:], k)
        return out

    words = ["letter", "été", "straße", "ꙮx", "z"]
    got = lang_id.log_probabilities(words, model, of)
    for w, row in zip(words, got, strict=True):
        assert np.allclose(row, [math.log(total(lang_id.MARK + w, k)) for k in (0, 1)])
    units = [lang_id.MARK + w for w in words]
    steps = lang_id.Steps(units, of)
    weights = steps.weights(model[:, :1])
    taken = steps.expected(weights)
    covered = np.bincount(steps.unit, taken * steps.size, len(units))  # each letter is in one step of each segmentation
    assert np.allclose(covered, [len(u) for u in units])
    assert "".join(lang_id.units_of("a" * 100)) == lang_id.MARK + "a" * 100 and lang_id.units_of("²") == []


def test_language(spark):
    rng = np.random.default_rng(4)
    kinds = {"aa": ["ba", "na", "mi", "ra"], "bb": ["sch", "ung", "ber", "eit"], "": ["éa", "ôu", "çe"]}
    make = lambda k, n: " ".join("".join(rng.choice(kinds[k], 3)) for _ in range(n))
    truth = {i: list(kinds)[i % 3] for i in range(300)}
    rows = [(i, make(k, 12), k) for i, k in truth.items()]
    odd = [(None, make("aa", 5), "aa"), (500, None, "aa"), (501, "123 ²!", "bb"), (502, "", None), (503, make("bb", 200_000), None), (503, "BANA", None), (7, rows[7][1], rows[7][2])]
    got = lang_id.predicted(frame(spark, rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.doc_id in truth:
            assert r.lang_pred == truth[r.doc_id] and r.score > 0.5
    assert sorted(r.lang_pred for r in got if r.doc_id == 503) == ["aa", "bb"]
    assert [(r.lang_pred, r.score) for r in got if r.doc_id in (500, 501, 502)] == [("und", 0.0)] * 3
    # lang, source and doc_id of a held-out row don't matter.
    moved = frame(spark, [(i, t, "aa" if zlib.crc32(str(i).encode()) % 4 == 2 else k) for i, t, k in rows])
    assert {(r.doc_id, r.lang_pred) for r in lang_id.predicted(moved).collect()} == set(truth.items())
    empty = lang_id.predicted(frame(spark, rows).limit(0))
    assert empty.count() == 0
    none = lang_id.predicted(frame(spark, [(1, "some text", None)])).collect()
    assert [(r.lang_pred, r.score) for r in none] == [("und", 0.0)]


def test_language_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    got = lang_id.op11_language(spark, sf_dir).where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got) > 20
