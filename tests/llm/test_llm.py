"""The training-data operators against brute force, round trips and held-out accuracy."""

import random
import re
import time
import zlib

import numpy as np
import pytest
import public_tokenizers as P
from pyspark.sql import functions as F

from codefacts.llm import bpe, coder, common, fmindex, html_text, minhash, mixing, nndescent, rpforest, sharding, tokens, toxicity
from codefacts.llm.queries import QUERIES

from . import brute

LONG = " ".join(f"w{k % 997}x{k % 31}" for k in range(30_000))
SHARED = " ".join(f"shared{k}" for k in range(60))
EDGE = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here today", "a"),
    (2, "The Quick brown fox jumps over the lazy dog and runs far away from here today", "a"),
    (3, None, "a"),
    (4, "", None),
    (5, " \t\n ", "b"),
    (6, "one two", "b"),
    (7, "ONE two", None),
    (8, LONG, "b"),
    (9, f"before {SHARED} after", "c"),
    (10, f"{SHARED}\n{SHARED}", "c"),
    (11, "na " * 200, "é"),
    (12, "na " * 190, "é"),
    (13, "x y \U0001d518 ﻿z", "zero"),
    (14, "", "zero2"),
]
SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, size long, key string, rank int, component_id long, shard int"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", len(t or ""), 7, "k", 1, 99, 3) for i, t, s in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def edge(spark):
    return _docs(spark, EDGE).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet").cache()


def _pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_components(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 90), (90, 100), (7, 7)], "a long, b long")
    assert {r["node"]: r["component"] for r in common.components(chain).collect()} == {**{k: 1 for k in range(1, 41)}, 100: 90, 90: 90}
    assert common.components(chain.where("a > 1000")).count() == 0


# 9 and 2: near duplicates and repeats


@pytest.mark.parametrize("shingle", [4, 5])
def test_minhash_is_brute_force(edge, real, shingle):
    for docs in (edge, real):
        want = brute.near_duplicates(_pairs(docs), 80, shingle)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, 80, shingle).collect()} == want


def test_minhash_in_small_blocks(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for i in range(90):  # near copies around the threshold, and copies of them
        w = list(base)
        for _ in range(rng.choice([0, 2, 3, 4, 5])):
            w[rng.randrange(len(w))] = f"r{rng.random()}"
        rows.append((i, " ".join(w), "a"))
    rows += [(i + 100, t, s) for i, t, s in rows[:30]]
    docs = _docs(spark, rows)
    monkeypatch.setattr(minhash, "TASK_DOCS", 10)
    found = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, 80, 4).collect()}
    assert found == {i: c for i, (_, c, _) in brute.near_duplicates(_pairs(docs), 80, 4).items()}


def test_minhash_repeated_and_missing_ids(spark, empty):
    text = EDGE[0][1]
    rows = minhash.near_duplicates(_docs(spark, [(5, text, "a"), (5, text, "a"), (6, text, "a"), (None, text, "a"), (None, "other words entirely here", "a")]), 80, 4).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in rows) == [(0, 0, True), (0, 5, False), (5, 5, True), (5, 5, True), (6, 5, False)]
    assert minhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("crowd", [4_000, 1])
def test_fm_is_brute_force(edge, real, crowd):
    for docs in (edge, real):
        rows = fmindex.remove_repeats(docs, 13, segments_per_key=crowd, words_per_shard=2_000).collect()
        assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == brute.without_repeats(_pairs(docs), 13)


def test_fm_text_and_odd_rows(spark, empty):
    rows = [(1, f"a  {SHARED}", "a"), (2, f"x\t{SHARED}  y", "a"), (2, f"x\t{SHARED}  y", "a"), (3, "as  it was", "a"), (None, SHARED, "a"), (4, None, "b")]
    got = fmindex.remove_repeats(_docs(spark, rows), 13, with_text=True, keep=("source",)).collect()
    assert sorted((r["doc_id"] or 0, r["n_removed"], r["kept_text"] or "", r["source"]) for r in got) == sorted(
        [(1, 0, f"a  {SHARED}", "a"), (2, 60, "x y", "a"), (2, 60, "x y", "a"), (3, 0, "as  it was", "a"), (0, 0, SHARED, "a"), (4, 0, "", "b")]
    )
    assert fmindex.remove_repeats(empty).count() == 0


def test_index_counts_and_owners():
    rng = np.random.default_rng(2)
    lists = [rng.integers(1, 6, size=n) for n in (5, 1, 30, 30, 12)]
    index = fmindex.FmIndex(np.concatenate(lists), np.array([len(x) for x in lists]), np.array([9, 4, 7, 3, 8]), 5)
    stream = rng.integers(1, 7, size=60)
    for limit in (1, 3, 6):
        length, low, high = index.matching(stream, np.arange(60), limit)
        for e in range(60):
            fits = [k for k in range(1, min(limit, e + 1) + 1) if any(list(stream[e - k + 1 : e + 1]) == list(x[s : s + k]) for x in lists for s in range(len(x) - k + 1))]
            assert length[e] == max(fits, default=0)
            if length[e] == limit:
                part = list(stream[e - limit + 1 : e + 1])
                owners = [o for x, o in zip(lists, (9, 4, 7, 3, 8), strict=True) for s in range(len(x) - limit + 1) if list(x[s : s + limit]) == part]
                assert high[e] - low[e] == len(owners) and index.least_owner(low[e : e + 1], high[e : e + 1])[0] == min(owners)


# 4 and 6: mixing and sharding


def test_mix_is_exact(spark, edge, real, empty):
    for docs in (edge, real):
        rows = mixing.mix(docs, rows_per_bucket=20).collect()
        text = {r["doc_id"]: r["text"] for r in docs.collect()}
        sizes, taken = {}, {}
        for r in rows:
            assert r["size"] == len(brute.words(text[r["doc_id"]])) and 0 <= r["taken"] <= 3 * r["size"]
            sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
            taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        want = brute.targets(sizes)
        assert len(rows) == docs.count()
        for r in rows:
            assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert all(abs(taken[s] - want[s]) <= 1.001 for s in sizes)
        assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5), rows_per_bucket=20).collect()), key=str)
    assert mixing.mix(empty).count() == 0
    twice = mixing.mix(_docs(spark, [(1, "a b c", "s"), (1, "a b c", "s"), (None, "d", None)])).collect()
    assert sum(r["taken"] for r in twice) == 7


def test_shards(spark, edge, real, empty):
    for docs in (edge, real, _docs(spark, [(1, "same", "a")] * 5 + [(2, None, "a")] * 3 + [(None, "x", "b")])):
        text = [(r["doc_id"], r["text"]) for r in docs.collect()]
        rows = sharding.shard(docs, shards=7, rows_per_run=2).collect()
        assert sorted(((r["doc_id"] or 0), r["size"], r["text_crc32"]) for r in rows) == sorted((i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in text)
        for s in range(7):
            slots = sorted(r["slot"] for r in rows if r["shard"] == s)
            assert slots == list(range(len(slots)))
        group = {}
        for r in rows:
            assert group.setdefault(r["group"], r["shard"]) == r["shard"] and r["law"] == "bytes" and r["grown_shard"] is None
    load = np.zeros(7)
    for r in sharding.shard(real, shards=7).collect():
        load[r["shard"]] += r["size"]
    assert load.max() / load.min() < 1.05
    assert sharding.shard(empty).count() == 0


# 5 and 7: tokens


def test_coder_round_trip():
    rng = np.random.default_rng(1)
    for ids in (np.zeros(0, int), np.array([5]), np.array([2**32 - 1, 0, 2**31, 65536, 65535, 65534]), rng.integers(0, 50257, 9000), np.tile(np.arange(50), 300), np.zeros(20000, int)):
        raw = coder.encode(ids)
        assert (coder.decode(raw) == ids).all()
    assert len(coder.encode(np.zeros(20000, int))) < 400
    raw = coder.encode(ids := rng.integers(0, 50257, 9000))
    assert (coder.decode(raw, 2, 1) == ids[4096:6144]).all() and (coder.decode(raw, 3) == ids[6144:]).all()
    broken = bytearray(coder.encode(rng.integers(0, 9, 3000)))
    broken[-100] ^= 255
    with pytest.raises(ValueError, match="checksum"):
        coder.decode(bytes(broken))


def test_coder_beats_its_baselines(spark, real):
    """Fewer bits an id than the ids' order-0 entropy and than deflate over the same ids."""
    ids, counts = tokens.Tokenizer(P.path("byte_bpe_50k.json")).encode([t or "" for _, t in _pairs(real)])
    _, n = np.unique(ids, return_counts=True)
    bits = 8 * len(coder.encode(ids)) / len(ids)
    assert bits < -(n / n.sum() * np.log2(n / n.sum())).sum() and bits < 8 * len(zlib.compress(ids.astype("<u2").tobytes(), 9)) / len(ids)


def test_token_files(spark, edge, real, empty, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    for k, docs in enumerate((edge, real)):
        tokens.write(docs, P.path("byte_bpe_50k.json"), str(tmp_path / str(k)), end_id=2, segment_ids=3000)
        got, start = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokens.read(spark, str(tmp_path / str(k))).collect()}, 0
        for i, t in sorted(_pairs(docs)):
            ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4")
            assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
    tokens.write(empty, P.path("byte_bpe_50k.json"), str(tmp_path / "none"), end_id=2)
    assert tokens.read(spark, str(tmp_path / "none")).count() == 0


def _odd_texts():
    rng = random.Random(3)
    pick = lambda: chr(rng.choice([rng.randrange(1, 128), rng.randrange(1, 0x3000), 32, 32, 10]))
    return ["", "  a", "\x1c\x1d x\x85y", "é" * 300 + "x" * 700, "don't  \n\n stop", " \x00 ", "𝔘𝔫𝔦 ☃☃☃ 12345", "<|endoftext|>"] + ["".join(pick() for _ in range(40)) for _ in range(500)]


def test_units_are_the_librarys(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    ids, counts = tokens.Tokenizer(P.path("byte_bpe_50k.json")).encode(_odd_texts())
    ends = np.cumsum(counts)
    assert [list(ids[e - n : e]) for e, n in zip(ends, counts, strict=True)] == [x.ids for x in library.encode_batch(_odd_texts(), add_special_tokens=False)]


def test_words_and_marks_go_to_the_library_once():
    tool = tokens.Tokenizer(P.path("byte_bpe_50k.json"))
    tool.encode([" so, so. so\nso; 'so so77 don't", " so;"])
    assert {u.to_bytes(8, "little")[: u >> 56] if isinstance(u, int) else u for u in tool.place} == {b" so", b",", b".", b"\nso", b";", b" 'so", b"77", b" don", b"'t"}


def test_units_between_white_space_of_any_kind(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    rng = random.Random(5)
    bits = list(" \n\t\r\x0b\x0c\x1c\x1f\x85\xa0\u1680\u180e\u2003\u200b\u2028\u202f\u205f\u3000\ufeff") + ["a", "B", "7", "é", "e\u0301", "”", "«", "日", "'", "'s", "'re", ",", "--", "<|endoftext|>", "\x00", "\x7f"]
    texts = [" ", "\n", "'", "\u3000", " \u3000x", "x \u2019s", "x \x85y"] + ["".join(rng.choice(bits + [" "] * 6) for _ in range(rng.randrange(12))) for _ in range(6000)]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    tool = tokens.Tokenizer(P.path("byte_bpe_50k.json"))
    for a in range(0, len(texts), 2000):
        ids, counts = tool.encode(texts[a : a + 2000])
        ends = np.cumsum(counts)
        assert [list(ids[e - n : e]) for e, n in zip(ends, counts, strict=True)] == want[a : a + 2000]


def test_bpe_is_tiktokens(spark, edge, real, empty):
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    odd = _docs(spark, list((k, t, "s") for k, t in enumerate(_odd_texts())))
    import hashlib

    for docs in (edge, real, odd):
        got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode(docs, path, P.PATTERN).collect()}
        for i, t in _pairs(docs):
            ids = library.encode_ordinary(t or "")
            assert got[i] == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.encode(empty, path, P.PATTERN).count() == 0


def test_bpe_of_long_pieces(spark):
    import hashlib

    import tiktoken

    rnd = random.Random(5)
    of = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    han = [chr(k) for k in range(0x4E00, 0x9FA5)]
    texts = [*(of(han, 80) for _ in range(830)), *(of("abcdefghijklmnopqrstuvwxyz", 240) for _ in range(830)), *("a" * n for n in (1, 31, 32, 33, 999, 1000, 1001, 40_000)), "ab" * 20_000, of("acgt", 20_000), of("etaoin", 5_000), "=" * 9_999 + " " * 9_999, "ไทย" * 2_000]
    path = P.path("byte_bpe_multi_50k.tiktoken")
    exact = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    found = {r["doc_id"]: r for r in bpe.encode(_docs(spark, [(k, t, "s") for k, t in enumerate(texts)]), path, P.PATTERN, with_ids=True).collect()}
    for k, t in enumerate(texts):
        assert list(found[k]["ids"]) == exact.encode_ordinary(t), t[:40]
        assert found[k]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


# 8 and 10: toxicity and pages


def test_toxicity_on_held_out_rows(spark, real, edge, empty):
    rng = random.Random(1)
    clean = [f"word{k}" for k in range(400)]
    bad = ["badword", "vileterm", "uglything"]
    rows, marks = [], []
    for i in range(1500):
        w = [rng.choice(clean) for _ in range(rng.randrange(5, 80))]
        toxic = i % 8 == 0
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((i, " ".join(w), "s"))
        if i % 2 == 0:
            marks.append((i, int(toxic), 1))
    docs, labels = _docs(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int, quality int")
    found = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    assert np.mean([r["predicted"] == (r["doc_id"] % 8 == 0) for r in held]) > 0.98
    none = toxicity.fit(docs, labels.where("doc_id < 0"))
    assert {r["predicted"] for r in toxicity.score(edge, none).collect()} == {0}
    assert toxicity.score(empty, none).count() == 0
    assert toxicity.fit(empty, labels).prior > 0


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><a>Menu</a></nav><div class="ad x">Buy</div>
<article><h1>Head &amp; line</h1><p>First  para<br>graph<p>Second<aside>side</aside><form>f</form></p><div class="comments"><p>Reader</p></div></article><footer>F</footer></body></html>"""


def test_page_text(spark):
    pages = spark.createDataFrame(
        [(1, "http://h/z/1", PAGE, 5), (2, "http://h/a/2", "<body><p>Site line</p><p>Own two</p></body>", 5), (3, "http://h/a/3", "<body><p>Site line</p><p>Own three</p></body>", 5), (4, None, None, 5), (5, "http://h/b", "", 5), (6, "http://g/x", "<article><p>cut &am", 5)],
        "page_id long, url string, html string, n_chars int",
    ).repartition(1)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()}
    assert got[1][0] == "Head & line\nFirst para graph\nSecond"
    assert got[3] == ("Own three", 9) and got[2] == ("Own two", 7)
    assert got[4] == ("", 0) and got[5] == ("", 0) and got[6][0] == "cut &am"
    assert html_text.extract(pages.where("page_id > 9")).count() == 0


def test_page_lines_reads_whole_attributes():
    def lines(page):
        return [x for x, place in html_text.page_lines(page) if place >= 0]

    for tag in ('p title="a hidden menu"', 'p style="overflow:hidden"', 'p data-hidden="false"', "p data-x='class=\"ad\"'", "p class=with-sidebar", 'p class="post comments-open"', 'p id="no-ad"', 'p data-role="navigation"'):
        assert lines(f"<article><{tag}>text</p><p>more</p></article>") == ["text", "more"]
    assert lines('<article><p>See <a href="/hidden-gems">gems</a></p></article>') == ["See gems"]
    for name in ("body", "main", "article"):
        assert lines(f'<{name} class="sidebar menu" id="comments"><p>text</p></{name}>') == ["text"]
    for tag in ("p hidden", 'p a=1 HIDDEN=""', "p class='x ad'", "p id=menu", "p role=navigation", 'p title="x"aria-hidden="true"', 'p class="site_footer"'):
        assert lines(f"<article><{tag}>text</p><p>more</p></article>") == ["more"]
    for tag in ('div class="comments-section"', 'ol class="user-comments"', 'div id="reader_comment_thread"', "div class='x wp-comments-area'"):
        assert lines(f"<main><p>text</p><{tag}><p>reader</p></{tag.split()[0]}></main>") == ["text"]
    assert lines("<header>site</header><article><header><h1>Title</h1><p class=ad>ad</p></header><p>text</p></article><header>more</header>") == ["Title", "text"]
    assert html_text.page_lines('<p data-role="main">a</p><div role="main">b</div>') == [("a", 0), ("b", 1)]


def test_page_text_differencing_decides_beside_marked_articles(spark):
    page = "<body><div>Site menu</div><div><p>Story {0}</p></div><article><p>Teaser</p></article><article><p>Card {0}</p></article></body>"
    pages = spark.createDataFrame([(k, f"http://h/a/{k}", page.format(k)) for k in (1, 2)], "page_id long, url string, html string").repartition(1)
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == {k: f"Story {k}\nTeaser\nCard {k}" for k in (1, 2)}


def _pages_by_brute_force(rows):
    """(page_id, url, text, shared, restored, vetoed) of (page_id, url, html), with quadratic alignment."""

    def in_both(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in reversed(range(len(a))):
            for j in reversed(range(len(b))):
                d[i][j] = d[i + 1][j + 1] + 1 if a[i] == b[j] else max(d[i + 1][j], d[i][j + 1])
        return d[0][0]

    def place(url):
        host, _, path = re.split("[?#]", url)[0].split("/", 2)[2].partition("/")
        return host, path

    def alike(a, b):
        n = 0
        for x, y in zip(a.split("/")[:-1], b.split("/")[:-1]):  # noqa: B905
            if x != y:
                break
            n += 1
        return n

    order = sorted(rows, key=lambda r: (*place(r[1]), -1 if r[0] is None else r[0]))
    lines = [html_text.page_lines(r[2] or "") for r in order]
    texts = [[x for x, _ in each] for each in lines]
    out = []
    for at, (page_id, url, _) in enumerate(order):
        host, path = place(url)
        near = []
        for side in (range(at - 1, -1, -1), range(at + 1, len(order))):
            near += [k for k in side if place(order[k][1])[0] == host and texts[k] and texts[k] != texts[at]][:1]
        near = [k for k in near if alike(path, place(order[k][1])[1]) == max(alike(path, place(order[j][1])[1]) for j in near)] if texts[at] else []
        common = [html_text.common_lines(texts[at], texts[k]) for k in near]
        for k, found in zip(near, common, strict=True):  # a common subsequence, and none is longer
            rest = iter(texts[k])
            assert all(texts[at][i] in rest for i in sorted(found)) and len(found) == in_both(texts[at], texts[k])
        shared = set.intersection(*common) if common else set()
        kept = [x for i, (x, where) in enumerate(lines[at]) if where == 1 or where == 0 and i not in shared]
        restored = sum(lines[at][i][1] == 1 for i in shared)
        vetoed = sum(where == -1 and i not in shared for i, (_, where) in enumerate(lines[at]))
        out.append((-1 if page_id is None else page_id, url, "\n".join(kept), len(shared) - restored, restored, vetoed))
    return out


def test_page_query_is_brute_force(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/pages.parquet").select("page_id", "url", "html").collect()]
    found = [(r["page_id"], r["url"], r["text"], r["n_shared"], r["n_restored"], r["n_vetoed"]) for r in QUERIES["op10_page_text"](spark, data).collect()]
    assert sorted(found) == sorted(_pages_by_brute_force(rows))
    assert sum(f[3] for f in found) > 0 and sum(f[5] for f in found) > 0


def test_broken_pages():
    def lines(page):
        return [x for x, place in html_text.page_lines(page) if place >= 0]

    assert lines('<p title="abc>Hello</p><p>x</p>') == ["Hello", "x"]
    assert lines("<p title='a > b' alt=\"it's\">Hello</p>") == ["Hello"]
    assert lines('<p it"s>a</p><p>1 < 2 <3</p>') == ["a", "1 < 2 <3"]
    assert lines("<p>a<!-- b") == lines("<p>a<script>b") == lines("<p>a<b c=") == ["a"]
    begun = time.time()
    for junk in ('<a ' * 300_000 + '"', '<a b="' * 200_000, "<!--" * 300_000, "<" * 1_000_000, "<p>" * 300_000, "</p>" * 300_000, "&amp" * 300_000, "<a b='" * 200_000 + '"', "<script>" * 200_000):
        html_text.page_lines(junk)
    assert time.time() - begun < 30


def test_page_text_of_copies_and_over_ranges(spark):
    def page(k):
        return f"<body><div>Menu {k % 3}</div><p>Site line</p><p>Own {k}</p></body>"

    copies = [(1, "http://h/a/1", page(1)), (2, "http://h/a/1?utm=x", page(1)), (2, "http://h/a/1?utm=x", page(1)), (3, "http://h/a/1/print", page(1)), (4, "http://h/b", page(4)), (5, "http://h/c", None), (6, "http://g/a", page(1)), (None, "http://h/b", page(7))]
    many = [(100 + k, f"http://k/{k // 7:03}/{k % 7}", page(k if k < 20 or k > 60 else 9)) for k in range(90)]
    pages = spark.createDataFrame(copies + many, "page_id long, url string, html string")
    expected = _pages_by_brute_force(copies + many)
    assert "Own 1" in expected[[e[0] for e in expected].index(1)][2]
    for ranges in (None, 1, 3, 40):
        found = [(r["page_id"] or -1, r["url"], r["text"]) for r in (html_text.extract(pages, ranges) if ranges else html_text.extract(pages)).collect()]
        assert sorted(found) == sorted(e[:3] for e in expected), ranges


def test_common_lines():
    def length(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    rng = random.Random(0)
    for _ in range(500):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(10))] for _ in range(2))
        rest = iter(b)
        found = html_text.common_lines(a, b)
        assert len(found) == length(a, b) and all(a[k] in rest for k in sorted(found))
        for most in (0, 1, 4, 20):  # cut into parts
            rest, found = iter(b), html_text.common_lines(a, b, most)
            assert len(found) == length(a, b) and all(a[k] in rest for k in sorted(found))


def test_long_pages_of_few_lines():
    """Very long pages whose lines are nearly all equal are aligned in bounded memory."""
    rng = random.Random(1)
    a, b = (["x", *(rng.choice("pqrs") for _ in range(60_000)), y] for y in "yz")
    b[0] = "w"
    begun = time.time()
    found = html_text.common_lines(a, b)
    rest = iter(b)
    assert all(a[k] in rest for k in sorted(found)) and len(found) > 35_000
    assert time.time() - begun < 60


# 1 and 3: vectors


#: Columns that the operators make themselves, and that a table may bring along.
CLASHES = ("cid", "code", "ids", "k1", "k2", "node", "rep", "vector", "links", "copies", "rank", "score", "n_links", "members", "query_id", "dim")


def _vectors(spark, rows):
    made = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return made.select("*", *[F.lit("clash").alias(c) for c in CLASHES])


ODD_VECTORS = [(901, None, 1), (902, [], 1), (903, [0.0] * 8, 1), (904, [1.0, None] + [0.0] * 6, 1), (905, [float("nan")] + [1.0] * 7, 1), (906, [float("inf")] + [1.0] * 7, 1), (907, [1.0] * 5, 1), (908, [2.0] * 5, 1), (920, [1.0] * 8, None)]


def test_forest_is_brute_force(spark, data):
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((12, 8))
    rows = []
    for i in range(500):
        v = centers[rng.integers(12)] + rng.standard_normal(8) * rng.choice([0, 0.08, 0.15])
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(3))))
    rows += [(i + 600, v, c) for i, v, c in rows[:60]] + ODD_VECTORS
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rpforest.near_duplicates(_vectors(spark, rows), 0.98, leaf=40, block=16).collect()}
    want = brute.links(rows, 0.98)
    assert sum(n for n, _ in want.values()) > 1000 and got == want
    assert rpforest.near_duplicates(_vectors(spark, [])).count() == 0


def test_nearest_recall(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 16)).astype(np.float32) * rng.uniform(0.5, 2, size=(1500, 1)).astype(np.float32)
    x[700:760] = x[3]  # one very common vector
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(1500)] + ODD_VECTORS
    got = {}
    for r in nndescent.nearest(_vectors(spark, rows), beam=200).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 1500, 20):
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        want = np.lexsort((np.arange(1500), -score))[:20]
        found = sorted(got[q])
        assert [k for k, _, _ in found] == list(range(1, 21)) and all(abs(s - score[v]) < 1e-9 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(want.tolist()))
    assert hits / (75 * 20) >= 0.95 and set(got) == set(range(0, 1500, 20))


def test_nearest_beside_one_very_long_vector(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((4000, 64)).astype(np.float32)
    x[1234] *= np.float32(3000 / np.linalg.norm(x[1234]))
    x[2000:2500] = x[1999] + 0.05 * rng.standard_normal((500, 64)).astype(np.float32)  # a tight cluster
    short = [(5000 + 10 * k, [float(k), 1.0], 0) for k in range(6)]  # another length
    got = {}
    vectors = _vectors(spark, [(i, [float(v) for v in x[i]], 0) for i in range(4000)] + short)
    for r in nndescent.nearest(vectors).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = 0
    for q in range(0, 4000, 20):
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        hits += len({*np.lexsort((np.arange(4000), -score))[:20].tolist()} & {*got[q]})
    assert hits / (200 * 20) >= 0.9 and got[5000] == [5010, 5020, 5030, 5040, 5050]
    with pytest.raises(RuntimeError):
        nndescent.build(spark.createDataFrame([(k, np.array([1, 0], dtype="<f4").tobytes() + bytes([k % 100, k // 5])) for k in range(300)], "cid long, code binary"), 300, 200.0, degree=4, rounds=1)


def test_nearest_on_tiny_tables(spark):
    few = [(0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [1.0, 0.0], 0), (20, [-1.0, 0.0], 0)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in nndescent.nearest(_vectors(spark, few)).collect())
    assert got == [(0, 1, 2), (0, 2, 1), (0, 3, 20), (20, 1, 1), (20, 2, 0), (20, 3, 2)]
    assert nndescent.nearest(_vectors(spark, [])).count() == 0
    assert nndescent.nearest(_vectors(spark, few[:1])).count() == 0


# The queries and the pipeline


def test_queries_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_pipeline(spark, data):
    import corpus_pipeline as pipeline

    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "mix", "bpe"]
    docs = common.table(spark, data, "documents")
    first = pipeline.drop_toxic(spark, docs, data)
    assert tuple(first.columns) == pipeline.COLUMNS and 0 < first.count() <= docs.count()
    second = pipeline.drop_near_duplicates(spark, docs, data)
    want = brute.near_duplicates(_pairs(docs), 80, 5)
    assert sorted(r["doc_id"] for r in second.collect()) == sorted(i for i, (_, _, kept) in want.items() if kept)
    third = pipeline.cut_repeats(spark, docs, data)
    left = {r["doc_id"]: r["text"] for r in third.collect()}
    for i, (n, removed, _) in brute.without_repeats(_pairs(docs), 13).items():
        assert (i in left) == (removed == 0 or removed < n) and (i not in left or len(brute.words(left[i])) == n - removed)
    fourth = pipeline.mix_sources(spark, docs, data)
    plan = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    got = {}
    for r in fourth.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(brute.words(r["text"]))
    assert got == {i: n for i, n in plan.items() if n}
    last = pipeline.encode(spark, fourth, data)
    assert last.count() == fourth.count()


def test_mix_stage_takes_rows_without_ids_by_their_own_size(spark, tmp_path):
    import corpus_pipeline as pipeline

    texts = [(None, " ".join(f"a{k}x{j}" for j in range(10 if k % 2 else 200)), "y") for k in range(10)] + [(1, "b " * 400, "x"), (1, "c " * 7, "x")]
    docs = _docs(spark, texts)
    plan = {r["source"]: (r["target"], 0) for r in mixing.mix(docs).collect()}
    mixed = pipeline.mix_sources(spark, docs, str(tmp_path)).collect()
    for source, (target, _) in plan.items():
        assert sum(len(r["text"].split()) for r in mixed if r["source"] == source) == int(target)
    whole = {t for _, t, _ in texts}
    parts = [r["text"] for r in mixed if r["text"] not in whole]
    assert len(parts) <= 2 and all(any(t.startswith(p) for t in whole) for p in parts)
    assert all(sum(r["text"] == t for r in mixed) <= 3 for t in whole)


def test_pipeline_stages_take_odd_rows(spark, data, edge, empty, tmp_path):
    import corpus_pipeline as pipeline

    odd = _docs(spark, [*EDGE, EDGE[0], (None, "no id here", None), (None, None, "a")])
    spark.createDataFrame([(1, 0, 1), (2, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd, empty):
        for _, stage in pipeline.STAGES:
            docs = common.save(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
