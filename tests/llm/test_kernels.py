"""Kernels against brute force, without Spark."""

from __future__ import annotations

import base64
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from navspark.llm import common, fuse, token_files
from navspark.llm.bpe import VOCABULARY, decode_ids, encode_ids, load
from navspark.llm.html_text import blocks
from navspark.llm.idcoder import decode, encode, pack, unpack
from navspark.llm.minhash import shingle_sets, signature
from navspark.llm.mixing import waterfill
from navspark.llm.sharding import fisher_yates
from navspark.llm.suffix_dedup import Anchors, sliding_least
from navspark.llm.textcore import U, Words, buffers
from navspark.llm.warc import Bundle, Reader, parse, place, record, record_id

ODD = ["", None, " ", "a  b", " x ", "\n\n a\tb c", "aaaa" * 300, "\x1c a\x1fb \x85z", "日本語 混ぜる", "don't we'll 123 ²³", "é" * 50 + "\x0b!"]


def test_words():
    column = pa.array(ODD)
    words = Words(*buffers(column))
    assert words.count.tolist() == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in ODD]


def test_bpe_equals_library():
    path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = [t or "" for t in ODD] + ["".join(rng.choice("ab \n\t'sé1!　xyz") for _ in range(rng.randrange(80))) for _ in range(400)] + ["abcdefgh" * 3000]
    for text, ids in zip(texts, encode_ids(texts, path, public_tokenizers.PATTERN), strict=True):
        assert ids == library.encode_ordinary(text)
        assert decode_ids(ids, path) == text.encode()
    ranks_ = load(path)
    many = ["".join(rng.choice("abcdeghilnorst") for _ in range(rng.randrange(3, 40))).encode() for _ in range(500)]
    assert ranks_.encode_pieces(many) == [library.encode_ordinary(p.decode()) for p in many] == [[ranks_.rank[p]] if p in ranks_.rank else ranks_._merge_one(p) for p in many]


@pytest.mark.parametrize("n", [0, 1, 9, 3000])
def test_id_coder(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 49408
    assert (decode(encode(ids, block=700)) == ids).all()
    counts = np.array([n], np.int64) if n else np.zeros(0, np.int64)
    back = unpack(pack(np.arange(len(counts)), np.zeros(len(counts), bool), counts, ids))
    assert (back[3] == ids).all() and (back[2] == counts).all()


def test_id_coder_on_even_sure_and_repeated_ids():
    """Also where widths fall below a word's range at once, or stay above it for long."""
    rng = np.random.default_rng(6)
    for ids in (np.full(70_000, 5), rng.integers(0, (1 << 21) - 1, 5000), np.where(rng.random(70_000) < 0.999, 7, rng.integers(0, 49408, 70_000)), np.repeat(rng.integers(0, 49408, 9000), 5), np.tile(rng.integers(0, 49408, 30), 900)):
        for block in (20_000, 1 << 22):
            assert (decode(encode(ids, block=block)) == ids).all()


def test_damaged_block_is_noticed():
    n, crc, data = encode(np.arange(500))[0]
    with pytest.raises(ValueError):
        decode([(n, crc ^ 1, data)])


def test_token_ids_equal_the_library(monkeypatch):
    """Over several slices, so with what is remembered of the one before; only units that aren't letters and marks go to the library one by one."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_files.VOCABULARY)
    library, of = Tokenizer.from_file(path), token_files.Tokens(path)
    single: list[str] = []
    each = of.each
    monkeypatch.setattr(of, "each", lambda units: (single.extend(units), each(units))[1])
    rng = random.Random(8)
    latin = [chr(c) for c in range(0x41, 0x100) if chr(c).isalpha()]
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    plain = ["".join(rng.choices(latin, k=rng.randint(1, 9))) + "".join(rng.choices(marks, k=rng.choice([0, 0, 1, 1, 2]))) for _ in range(3000)]
    odd = ["<|endoftext|>", "a<|endoftext|>", "x|>", "it's", "it'", "'s", "a.b", "###", "=\u0338", "a=\u0338", "e\u0301.", "a\tb", "\xa0", "7up", "日本", "a" * 3000, "\u2028", "ªº", "İ"]
    for units in (plain, plain[:900] + odd, odd, plain[2000:], []):
        texts: list = [" ".join(rng.choices(units, k=rng.randint(1, 60))) for _ in range(200)] if units else [""]
        texts += [None, "", " ", "\n", "b  c\n\nd ", " ".join(units)]
        ids, ends = of.encode(pa.array(texts, pa.string()))
        assert len(ends) == len(texts) + 1 and ends[0] == 0 and ends[-1] == len(ids)
        for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True):
            assert ids[a:b].tolist() == library.encode(t or "", add_special_tokens=False).ids
    assert not [u for u in single if u.rstrip("".join(marks)).isalpha() and u.isascii()]


def test_text_bundles_fill_slices():
    """Rows stay in order; small batches are put together up to the limit, and a longer text is alone."""
    texts = ["abc", None, "", "é" * 4, "x" * 30, "y", "z" * 9, "w" * 2, "v"] * 3
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(texts[k : k + 2], pa.string())}) for k in range(0, len(texts), 2)]
    got = [b.column(0).to_pylist() for b in common.text_bundles(batches, "text", 12)]
    sizes = [sum(len((t or "").encode()) for t in b) for b in got]
    assert [t for b in got for t in b] == texts
    assert all(size <= 12 or len(b) == 1 for size, b in zip(sizes, got, strict=True))
    assert len(got) < len(batches) and list(common.text_bundles([], "text", 12)) == []


def test_fuse_has_its_keys():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 20_000):
        keys = rng.integers(0, 1 << 63, n).astype(U)
        filter_ = fuse.build(keys)
        assert fuse.contains(filter_, keys).all()
        assert fuse.contains(filter_, rng.integers(0, 1 << 63, 20_000).astype(U)).mean() < 0.01


def test_shingles_and_signature():
    texts = ["a b c d e f", "A B c d e F", "a b", "a  b\n", "", None, "b a"]
    sets = shingle_sets(pa.array(texts))
    assert [len(s) for s in sets] == [2, 2, 1, 1, 0, 0, 1]
    assert (sets[0] == sets[1]).all() and (sets[2] == sets[3]).all() and (sets[2] != sets[6]).all()
    a = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 3000).astype(U) * U(2))
    agree = (signature(a) == signature(a[: int(len(a) * 0.9)])).mean()
    assert agree > 0.7


def test_waterfill():
    assert waterfill([]) == [] and waterfill([0, 0]) == [0.0, 0.0]
    got = waterfill([1000, 10, 10])
    assert got[1:] == [30.0, 30.0] and abs(sum(got) - 1020) < 1e-9


def test_fisher_yates():
    order = fisher_yates(50, [1, 2])
    assert sorted(order) == list(range(50)) and (order == fisher_yates(50, [1, 2])).all() and (order != fisher_yates(50, [1, 3])).any()


def test_anchors_depend_on_content_alone():
    rng = np.random.default_rng(2)
    shared = rng.integers(97, 105, 400).astype(np.uint8)
    data = np.concatenate([rng.integers(97, 123, 333), shared, rng.integers(97, 123, 50), shared]).astype(np.uint8)
    found = Anchors(data, np.array([0, 733, len(data)]))
    inside = lambda a, b: {x - a for x, lo, hi in zip(found.at, found.low, found.high, strict=True) for s in range(lo, hi + 1) if a <= s <= b - 100}
    assert inside(333, 733) == inside(783, 1183) != set()
    values = rng.integers(0, 99, 50)
    assert (sliding_least(values, 7) == [values[i : i + 7].min() for i in range(44)]).all()


def test_warc_bundle(tmp_path):
    bundle, want = Bundle(), {}
    for i in range(9):
        payload = bytes([65 + i]) * 100_000
        bundle.add(record_id(i, "ab" * 20), record(i, "http://x/\r\n" if i else None, payload, "ab" * 20, None, False))
        want[record_id(i, "ab" * 20)] = payload
    path = tmp_path / "x.warc.zst"
    path.write_bytes(bundle.finish())
    reader = Reader(*place(str(path)))
    assert len(reader.sizes) > 3
    for name, payload in want.items():
        assert reader.record(name)[1].endswith(b"\r\n\r\n" + payload)
    frame = reader.frame(1)
    assert parse(frame, 0)[0]["WARC-Type"] == "response"


def test_html_blocks():
    page = "<html><head><title>T</title></head><body><nav>n</nav><article><header><h1>A &amp; b</h1></header><p>one\n two<br>three<p>x<div class='reader-comments'>no</div><script>if(a<b)</p>;</script></article><footer>f</footer></body>"
    assert blocks(page) == (True, ["A & b", "one two three", "x"])
    assert blocks("<div id=main><div class=cookie-notice>c</div><p>t<ul><li>1<li>2</ul></div><form>q</form>") == (False, ["t", "1", "2"])
    assert blocks("") == (False, []) and blocks("<p>open <b") == (False, ["open <b"])


def test_html_omitted_tags():
    head = "<html><head><meta charset=utf-8><title>Not this</title><style>p {}</style>\n"
    assert blocks(head + "<body><nav>Menu</nav><article><p>One<p>Two</article>") == (True, ["One", "Two"])
    assert blocks(head + "<article><ul><li>One<li>Two</ul></article>") == (True, ["One", "Two"])
    assert blocks(head + "<a href=x>One</a> two") == (False, ["One two"])
    assert blocks(head + "One <b>two</b>") == (False, ["One two"])
    assert blocks(head + "</head><body><p>One</body>") == (False, ["One"])


def test_bpe_white_space_equals_library():
    """Units between single spaces are whole matches, whatever white space stands beside them."""
    draw, letters = random.Random(3), [*"ab Z9',.\n\t\u3000\x85\xa0\u00e9 ", *"    "]
    texts = ["".join(draw.choices(letters, k=draw.randint(0, 12))) for _ in range(5000)]
    path = public_tokenizers.path(VOCABULARY)
    library = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load(path).rank, special_tokens={})
    assert encode_ids(texts, path, public_tokenizers.PATTERN) == [library.encode_ordinary(t) for t in texts]
