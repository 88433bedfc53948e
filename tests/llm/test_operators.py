"""Operators and pipeline stages on a fixture with nulls, copies, ties, empty and long texts and clashing columns, against brute force."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from navspark.llm import bpe, exact_dedup, html_text, minhash, mixing, quality, sharding, suffix_dedup, token_files, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def text(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[k % 10]}{k}" for k in rng.integers(0, 900, n))


BASE = text(1, 200)
ROWS = [(i, text(i, 60), f"s{i % 3}") for i in range(2, 20)]
ROWS += [(30, BASE, "s0"), (31, BASE.upper(), "s1"), (32, BASE + " tail", None), (33, BASE, "s1"), (33, BASE, "s1"), (None, BASE, "s2"), (None, None, None), (40, "", "s0"), (41, None, "s1"), (42, "a", "s2"), (43, "a", "s2"), (44, text(9, 60) + " " + text(77, 5000), "s0"), (45, "\n\t ", "s1")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "l", 1, "x", 7, "y") for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long, kept string, size int, component_id string").repartition(3).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def norm(t):
    return (t or "").encode().lower()


def test_exact(docs, empty):
    got = exact_dedup.dedup_groups(docs).collect()
    groups: dict = {}
    for i, t, _ in ROWS:
        groups.setdefault(norm(t), []).append(i)
    want = Counter((i, max((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]), hashlib.sha256(norm(t)).hexdigest()) for i, t, _ in ROWS)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and Counter(norm(r.text) for r in kept.collect()) == Counter(groups.keys())
    assert exact_dedup.dedup_groups(empty).count() == 0 and exact_dedup.drop_copies(empty).count() == 0


def shingles(t):
    w = norm(t).split()
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near(docs, empty):
    got = minhash.clusters(docs).collect()
    sets = [(i, shingles(t)) for i, t, _ in ROWS]
    same = lambda a, b: a and b and 100 * len(a & b) >= 85 * len(a | b)
    want = Counter()
    for i, s in sets:
        reach, grown = {s}, True
        while s and grown:
            more = {b for _, b in sets if any(same(a, b) for a in reach)} | reach
            grown, reach = more != reach, more
        ids = [j for j, b in sets if j is not None and b in reach] if s else [i]
        want[(i, len(s), min(ids, default=None))] += 1
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    kept = minhash.drop_near_copies(docs)
    left = [r for r in kept.collect() if r.text and "alpha" in r.text.lower() and r.doc_id in (30, 31, 32, 33, None)]
    assert kept.columns == docs.columns and [r.doc_id for r in left] == [30]
    assert minhash.clusters(empty).count() == 0


def test_near_template(spark):
    """Many pairs that fill one template: buckets are crowded by unlinked documents, and each document has one link."""
    plate, rows = [f"t{k}" for k in range(120)], []
    for i in range(120):
        rows.append((i, " ".join([*plate, *(f"p{i // 2}x{k}" for k in range(4)), *(f"e{i}x{k}" for k in range(10))])))
    sets = [shingles(t) for _, t in rows]
    linked = {(i, j) for i in range(len(rows)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert linked == {(2 * k + 1, 2 * k) for k in range(60)}
    got = minhash.clusters(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r.doc_id: r.component_id for r in got.collect()} == {i: i - i % 2 for i, _ in rows}


def test_strings(docs, empty):
    seen, want = {}, Counter()
    order = sorted(enumerate(ROWS), key=lambda x: (x[1][0] is not None, x[1][0] or 0, hashlib.md5((x[1][1] or "").encode()).digest()))
    for _, (i, t, _) in order:
        b = (t or "").encode()
        mark = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                mark[k] += 1
                mark[k + 100] -= 1
            else:
                seen[b[k : k + 100]] = 1
        gone = np.cumsum(mark)[:-1] > 0
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
        want[(i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeated_strings(docs).collect()) == want
    assert suffix_dedup.repeated_strings(empty).count() == 0


def test_strings_repeated_first(spark):
    """Rows that repeat doc_id and text and come first: one keeps its text, the others go wholly."""
    rows = [(1, text(50, 300))] * 3 + [(2, text(51, 300))] * 2 + [(3, text(50, 300)), (None, text(52, 90)), (None, text(52, 90)), (4, "short"), (4, "short")]
    got = suffix_dedup.repeated_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    first, want = set(), Counter()
    for i, t in rows:
        n = len(t) if t in first and len(t) >= 100 else 0
        first.add(t)
        want[(i, len(t), n, int(n > 0), hashlib.sha256(b"" if n else t.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_mix(docs, empty):
    plan = mixing.mix(docs).collect()
    totals = Counter()
    for _, t, s in ROWS:
        totals[s] += len(norm(t).split())
    names = sorted((s for s in totals if s is not None)) + [None]
    targets = dict(zip(names, mixing.waterfill([totals[s] for s in names]), strict=True))
    assert all(r.source_size == totals[r.source] and abs(r.target - targets[r.source]) < 1e-6 and 0 <= r.times <= 3 for r in plan)
    assert sum(r.rows for r in plan) == len(ROWS) and sum(r.size * r.rows * r.times for r in plan) <= sum(totals.values())
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.count() == sum(r.rows * r.times for r in plan)
    assert mixing.mix(empty).count() == 0


def test_shards(docs, empty, tmp_path):
    got = sharding.shard(docs, str(tmp_path / "a"), 5, bucket_bytes=4000).collect()
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and all(sorted(r.slot for r in got if r.shard == k) == list(range(n)) for k, n in sizes.items())
    assert Counter((r.document.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in ROWS)
    assert sharding.shard(empty, str(tmp_path / "b")).count() == 0


def test_bpe_and_files(docs, empty, tmp_path):
    got = bpe.encoded(docs).collect()
    assert Counter((r.doc_id, r.decoded_sha256) for r in got) == Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in ROWS)
    assert bpe.encoded(empty).count() == 0
    path = str(tmp_path / "ids")
    rows = token_files.read(token_files.write(docs, path), path).orderBy("start").collect()
    assert len(rows) == len(ROWS) and [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    assert [r.doc_id for r in rows] == sorted((r[0] for r in ROWS), key=lambda i: (i is not None, i or 0))
    assert all(len(r.ids) == 4 * r.n_tokens and r.ids[-4:] == b"\2\0\0\0" for r in rows)
    assert token_files.read(token_files.write(empty, path), path).count() == 0


def test_files_hold_the_librarys_ids(spark, tmp_path):
    """Ids, their checksum and their places, also of texts with the vocabulary's added tokens; ids come back from several blocks."""
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    rng = np.random.default_rng(4)
    odd = ["a<|endoftext|>b c", "<|startoftext|>", " x  <|endoftext|> y.\n\nz", "É. é! naïve; ΑΣ. Ünï?", "日本 'll it's 12,5 $3", None, "", "a" * 3000]
    odd += ["".join(rng.choice(["a", "B", " ", "\n", ".", "é", "e\u0301", "<|endoftext|>", "'s", "7", "\u3000"], rng.integers(0, 40))) for _ in range(150)]
    rows = [(i, t) for i, t in enumerate(odd)] + [(500 + i, text(i, 400)) for i in range(40)]
    path = str(tmp_path / "ids")
    found = token_files.read(token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path), path).collect()
    start = 0
    for r, (i, t) in zip(sorted(found, key=lambda r: r.doc_id), rows, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, np.frombuffer(r.ids, "<u4").tolist()) == (i, start, len(ids), ids)
        start += len(ids)


def test_bpe_query_columns(docs):
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t, _ in ROWS:
        ids = library.encode_ordinary(t or "")
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoded(docs).collect()) == want


def test_exact_when_a_digest_lies(spark, monkeypatch):
    """With every byte check failing, batch rows form groups of their own beside the snapshots'."""
    rows = spark.createDataFrame([(i, BASE) for i in range(12)] + [(20, "alone")], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "differing", lambda docs, pairs: pairs.select("sha").distinct())
    got = exact_dedup.dedup_groups(rows, exact_dedup.F.col("doc_id") < 7).collect()
    assert len(got) == 13
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {(i, 6, 7, i == 6) for i in range(7)} | {(i, 11, 5, i == 11) for i in range(7, 12)} | {(20, 20, 1, True)}


def test_base_measures(spark):
    """The four measures and the rules against plain Python."""
    import re

    rng = np.random.default_rng(8)
    texts = ["\n".join(" ".join(rng.choice(["a", "b#", "cé", "<d>", "e&f", "日本", "$"], rng.integers(0, 7))) + str(rng.choice(["", " ", "\t", "\x0b"])) for _ in range(rng.integers(1, 14))) for _ in range(120)] + ["", None, "a b c d e " * 30, "x\ny\nx\n\n\nx", " \n \n"]
    got = {r.doc_id: r for r in quality.judged(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), None).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = Counter(zip(*(w[k:] for k in range(5)), strict=False))
        marked = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(marked))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (len(w) < 10 or 100 * len(marked) > 20 * len(w)) and r.kept == (not r.base_failed)


def test_rare_labels_are_learnt(spark):
    good = [(i, text(i, 80), 1) for i in range(80)]
    bad = [(100 + i, " ".join(w + "$$$" for w in text(i, 80).split()), 0) for i in range(3)]
    rows = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    model = quality.train(rows, spark.createDataFrame([(i, q) for i, _, q in good + bad], "doc_id long, quality int"))
    assert model is not None and {r.doc_id for r in quality.judged(rows, model).collect() if not r.kept} == {100, 101, 102}


def test_quality(spark, docs, empty):
    good = [(1000 + i, text(i, 80), 1) for i in range(60)]
    bad = [(2000 + i, " ".join(w + "$$$" for w in text(i, 80).split()), 0) for i in range(60)]
    rows = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad], "doc_id long, quality int, toxic int")
    model = quality.train(rows, labels)
    fresh = spark.createDataFrame([(1, text(901, 80)), (0, " ".join(w + "$$$" for w in text(902, 80).split()))], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in quality.judged(fresh, model).collect()} == {1: True, 0: False}
    got = quality.judged(docs, None).collect()
    want = Counter((i, len(norm(t).split()), len(norm(t).split()) < 10) for i, t, _ in ROWS)
    assert Counter((r.doc_id, r.n_words, r.base_failed) for r in got) == want
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns
    assert quality.judged(empty, None).count() == 0


def test_pages(spark, tmp_path):
    big = "<p>" + "same payload " * 100
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (None, "http://a/x", big), (5, "http://a/5", "small"), (6, "http://a/6", "small"), (7, "http://a/7", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "w")
    got = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(warc.write(pages, path), path).collect()}
    n = len(big)
    assert got == {1: ("revisit", 3, n), 2: ("revisit", 3, n), 3: ("response", None, n), None: ("revisit", 3, n), 5: ("response", None, 5), 6: ("response", None, 5), 7: ("response", None, 0)}
    assert warc.read(warc.write(pages.limit(0), path), path).count() == 0
    plate = "<div>one two three four five six seven eight nine ten</div>"
    site = spark.createDataFrame([(i, f"http://h/{i}", f"<body>{plate}<div>{text(i, 30)}</div></body>") for i in range(4)] + [(9, None, None)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html_text.extracted(site).collect()} == {**{i: text(i, 30) for i in range(4)}, 9: ""}


def test_pages_copied_and_mixed(spark):
    """Copied pages and a paragraph on two pages keep their text; boilerplate goes from within a block, and only it."""
    plate, twice = "one two three four five six seven eight nine ten", text(60, 20)
    page = lambda *parts: "<body>" + "".join(f"<div>{x}</div>" for x in parts) + "</body>"
    own = {i: text(70 + i, 30) for i in range(8)}
    rows = [(0, page(plate, own[0])), (1, page(plate, own[0])), (2, page(plate, own[0])), (3, page(plate, own[3], twice)), (4, page(plate, own[4], twice)), (5, page(f"{own[5]} {plate}")), (6, page(f"short run {plate} tail")), (None, page(plate, own[7]))]
    site = spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in rows] + [(20 + k, f"http://mirror/{k}", page(own[2])) for k in range(4)], "page_id long, url string, html string")
    want = {0: own[0], 1: own[0], 2: own[0], 3: f"{own[3]}\n{twice}", 4: f"{own[4]}\n{twice}", 5: own[5], 6: "short run tail", None: own[7], **{20 + k: own[2] for k in range(4)}}
    assert {r.page_id: r.text for r in html_text.extracted(site).collect()} == want


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for name, stage in p.STAGES:
        out = stage(spark, docs, sf_dir)
        if name != "byte-level BPE":
            assert out.columns == docs.columns
        docs = out.cache()
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0 and counts[4] == counts[5] > 0


def test_shared_strings_equal_brute_force(spark, tmp_path, monkeypatch):
    """Every string of RUN tokens on PAGES distinct pages of a host, against all strings of all pages."""
    rng = np.random.default_rng(12)
    passages = [" ".join(f"{w}{n}" for n in rng.integers(0, 5, 14)) for w in ("p", "q", "r", "s")]
    rows = []
    for i in range(60):
        parts = [text(200 + i, 12), *[passages[k] for k in rng.integers(0, 4, rng.integers(0, 3))], " ".join(rng.choice(["x", "y"], 20))]
        rows.append((i % 57, f"http://h{i % 2}/{i}", "<body>" + "".join(f"<p>{x}</p>" for x in parts) + "</body>"))
    rows += [rows[0], (None, None, None), (900, "http://h1/z", "<body>" + "<p>long </p>" * 30_000 + "</body>")]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int").repartition(5)
    path = "file://" + str(tmp_path / "html")
    manifest = html_text.written(pages.select("page_id", html_text.F.col("html").alias("text"), "url").mapInArrow(html_text._packed(path), "slice long, file string, at long, size long, streams array<struct<host:long,stream:long>>"), "t")
    got = Counter()
    where = {}
    for m in manifest.collect():
        for _, r, _ in html_text._read(path, [html_text.pa.RecordBatch.from_pylist([{"slice": m.slice, "file": m.file, "at": m["at"], "size": m["size"]}])]):
            for k, (host, blocks_) in enumerate(zip(r.column("host").to_pylist(), r.column("blocks").to_pylist(), strict=True)):
                where[m.slice, k] = (host, " ".join(blocks_).split())
    for r in html_text.shared_strings(manifest, path).collect():
        got[(r.slice, r.page, r.start)] = r.wide
    on, streams = {}, {}
    for host, t in set((h, tuple(t)) for h, t in where.values()):
        streams.setdefault(host, set()).add(t)
        for k in range(len(t) - 7):
            on.setdefault((host, t[k : k + 8]), set()).add(t)
    want = {}
    for (slice_, page), (host, t) in where.items():
        for k in range(len(t) - 7):
            n = len(on[host, tuple(t[k : k + 8])])
            if n >= 3:
                want[slice_, page, k] = 2 * n >= len(streams[host])
    assert want and dict(got) == want
    out = html_text.extracted(pages)
    assert out.count() == len(rows) and out.columns == ["page_id", "url", "text"]
    assert html_text.extracted(pages.limit(0)).count() == 0


def test_structure_is_a_hint(spark):
    body = text(301, 40)
    rows = [(1, "http://a/1", f"<article>teaser only</article><div id=content><p>{body}</p></div>"), (2, "http://a/2", f"<article><p>{body}</p></article><div>by me</div>")]
    got = {r.page_id: r.text for r in html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: f"teaser only\n{body}", 2: body}
