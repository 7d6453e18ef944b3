"""HTML extraction, packing and token files against brute force, and odd input."""

import html
import io
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from phonolith.llm import byte_bpe, html_extract, packing, token_files

from .conftest import ODD, SF, rows

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def ids_of(library, text, end):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# --- ids ---


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é'sdmltrev.,!?-\n\t 0١½中ªʰ\x1c\x85　´<|endoftext|>"), max_size=40))
def test_ids_equal_library(text):
    own = byte_bpe.byte_bpe(BYTES)
    assert np.frombuffer(own.encode(text), "<u4").tolist() == own.library.encode(text, add_special_tokens=False).ids


def test_memo_generations(library, docs):
    own = byte_bpe.ByteBpe(BYTES, 8000)
    for r in docs.limit(40).collect():
        assert np.frombuffer(own.encode(r["text"]), "<u4").tolist() == library.encode(r["text"], add_special_tokens=False).ids
    assert 0 < len(own.memo.new) <= 4000 / byte_bpe.ENTRY + 1 and own.memo.old


# --- packing ---


def check_packing(got, texts, library, window=1024):
    """Each id in exactly one piece, right sums, gapless offsets. Returns the fill of each sequence."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for i, own in pieces.items():
        ids, at = ids_of(library, texts[i], 0), 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    fills = {}
    for s, own in sequences.items():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        fills[s] = at
    return fills


def test_packing(docs, library):
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    fills = check_packing(rows(packing.pack(docs, BYTES)), texts, library)
    padded = sum(1024 - n for n in fills.values() if n & (n - 1))
    assert padded / (padded + sum(fills.values())) < 0.03
    check_packing(rows(packing.pack(docs, BYTES, window=64, per_task=40)), texts, library, 64)


def test_packing_odd(odd, nothing, null_id, library):
    distinct = odd.dropDuplicates(["doc_id"])
    check_packing(rows(packing.pack(distinct, BYTES)), {r[0]: r[1] for r in ODD}, library)
    assert sum(r["doc_id"] == 4 for r in rows(packing.pack(odd, BYTES))) == 2
    assert packing.pack(nothing, BYTES).count() == 0
    assert {r["doc_id"] for r in rows(packing.pack(null_id, BYTES))} == {None, 1}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_decreasing(lengths):
    lengths = sorted(lengths, reverse=True)
    rooms, want = [], []
    for n in lengths:
        fits = [(r, w) for w, r in enumerate(rooms) if r >= n]
        if not fits:
            rooms.append(50)
            fits = [(50, len(rooms) - 1)]
        room = min(fits)[0]
        want.append(50 - room)
        rooms[min(fits)[1]] -= n
    got = packing.best_fit_decreasing(lengths, 50)
    assert [o for _, o in got] == want and len({w for w, _ in got}) == len(rooms)


# --- token files ---


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 50), min_size=1, max_size=300), st.sampled_from([0.0, 50.0, 98.0, 100.0]))
def test_block_round_trip(ids, percentile):
    ids = np.array(ids, np.uint32)
    assert (token_files.unpack_block(token_files.pack_block(ids, percentile)) == ids).all()


def test_outliers_do_not_widen_a_block():
    ids = np.full(1000, 7, np.uint32)
    ids[::100] = 2**31
    assert len(token_files.pack_block(ids)) < 120


def test_file_round_trip(monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK", 16)
    rng = np.random.default_rng(1)
    docs = [(i, rng.integers(0, 50000, rng.integers(0, 60)).astype("<u4")) for i in range(100)]

    class Kept(io.BytesIO):
        def close(self):
            pass

    out = Kept()
    writer = token_files.FileWriter(out)
    for i, ids in docs:
        writer.add(i, ids.tobytes())
    writer.close()
    before = 0
    for (i, ids), (got, at, found) in zip(docs, token_files.read_documents(out, len(out.getvalue())), strict=True):
        assert got == i and at == before and (found == ids).all()
        before += len(ids)


def check_files(got, texts, library):
    start = 0
    for r in sorted(got, key=lambda r: r["doc_id"]):
        ids = ids_of(library, texts[r["doc_id"]], 2)
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    assert {r["doc_id"] for r in got} == set(texts)


def test_token_files(spark, docs, library, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "FILE_IDS", 5000)
    files = token_files.write_token_files(docs, BYTES, f"file://{tmp_path}/ids", end_id=2)
    assert files.count() > 4
    check_files(rows(token_files.read_token_files(files)), {r["doc_id"]: r["text"] for r in docs.collect()}, library)


def test_token_files_odd(odd, nothing, null_id, library, tmp_path):
    files = token_files.write_token_files(odd.dropDuplicates(["doc_id"]), BYTES, f"file://{tmp_path}/a", end_id=2)
    check_files(rows(token_files.read_token_files(files)), {r[0]: r[1] for r in ODD}, library)
    again = token_files.write_token_files(odd, BYTES, f"file://{tmp_path}/b", end_id=2)
    assert token_files.read_token_files(again).count() == len(ODD)
    none = token_files.write_token_files(nothing, BYTES, f"file://{tmp_path}/c", end_id=2)
    assert token_files.read_token_files(none).count() == 0
    got = rows(token_files.read_token_files(token_files.write_token_files(null_id, BYTES, f"file://{tmp_path}/d")))
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])] == [1, None]  # null ids come last


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
def test_token_files_keep_order_and_rows(spark, library, tmp_path, parts):
    """An id and null ids with a third of the rows each: dealt to several parts, all there, ids ascending."""
    ids = [7] * 60 + [None] * 60 + list(range(-20, 40))
    table = spark.createDataFrame([(i, f"text {n} of all") for n, i in enumerate(ids)], "doc_id long, text string")
    files = token_files.write_token_files(table, BYTES, f"file://{tmp_path}/x", end_id=2, parts=parts)
    got = sorted(rows(token_files.read_token_files(files)), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i in ids if i is not None)) + [None] * 60
    want = sorted(crc(ids_of(library, f"text {n} of all", 2)) for n in range(180))
    assert sorted(r["ids_crc32"] for r in got) == want
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    if parts > 6:
        assert max(r["n_docs"] for r in rows(files)) < 60


@pytest.mark.parametrize("width", range(33))
def test_block_widths(width):
    ids = np.random.default_rng(width).integers(0, 2**width, 1000).astype(np.uint32)
    for n in (1, 63, 64, 65, 1000):
        assert (token_files.unpack_block(token_files.pack_block(ids[:n])) == ids[:n]).all()


@pytest.mark.parametrize("width", [8, 16, 32])
def test_whole_bytes_are_packed_without_shifting(width, monkeypatch):
    """The file format's bytes, counted out one value after another."""
    rest = np.random.default_rng(width).integers(0, 2**32, 100).astype(np.uint32)
    want = sum((int(x) & (1 << width) - 1) << i * width for i, x in enumerate(rest))
    monkeypatch.setattr(np, "ascontiguousarray", None)  # what transposing for the shifts takes
    words = token_files._to_words(rest, width)
    assert words.shape == (2, width) and words.astype("<u8").tobytes() == want.to_bytes(16 * width, "little")
    assert token_files._from_words(words, 100, width).tolist() == [int(x) & (1 << width) - 1 for x in rest]


# --- HTML ---


def brute_article(source):
    """The template of the test pages, by patterns."""
    body = re.search(r"<article>(.*?)(</article>|<footer>|$)", source, re.S)[1]
    blocks = (" ".join(html.unescape(b.replace("<b>", "").replace("<br>", " ")).split()) for b in re.split(r"</?(?:p|h1)>", body))
    return "\n\n".join(b for b in blocks if b)


def test_pages(spark, docs):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: (r["url"], brute_article(r["html"])) for r in pages.collect()}
    got = {r["page_id"]: (r["url"], r["text"]) for r in rows(html_extract.extract(pages))}
    assert got == want


@pytest.mark.parametrize(
    "source,text",
    [
        ("", ""),
        ("plain &lt;b&gt; &eacute;&#x41;&amp;", "plain <b> éA&"),
        ("<p>a<p>b<br>c</p>d", "a\n\nb c\n\nd"),
        ("<body><header>h</header><main><header><h1>T</h1></header><p>x <em>y</em>z</p></main><footer>f</footer>", "T\n\nx yz"),
        ("<div class='cookie-notice'>c</div><div id=sidebar>s</div><p>t</p><div class=comments><p>no</p></div>", "t"),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", "a\n\nb\n\nc\n\nd"),
        ("<script>if (a<b) '</p>'</script><style>p{}</style><p>t<!-- <p>no</p> --></p>", "t"),
        ("<form><p>no</p><input value='x>y'></form><p>a < b</p><p", "a < b"),
        ("<nav><ul><li>m</ul></nav><article><p>x</article><aside>s</aside>", "x"),
        ("<head><title>no</title><body><p>yes", "yes"),
        ("<div class='page no-sidebar'><div id=topMenu>m</div><article class='post has-footer'>a<article class=comment>c</article></article></div>", "a"),
        ("<p style='display: none'>no</p><div class=cookieBanner>no</div><p>yes", "yes"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<a b='" * 3000, ""),
    ],
)
def test_main_text(source, text):
    assert html_extract.main_text(html_extract.parse(source)) == text


def test_style_tree_removes_what_a_host_repeats(spark):
    page = "<body><div class=top><p>Same words on all pages</p></div><div class=body><p>Own text {n}</p><p>More {n}</p></div></body>"
    table = spark.createDataFrame([(n, f"http://h.example/{n}", page.format(n=n)) for n in range(12)] + [(99, "http://small.example/1", page.format(n=99))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in rows(html_extract.extract(table))}
    assert got[3] == "Own text 3\n\nMore 3"
    assert got[99] == "Same words on all pages\n\nOwn text 99\n\nMore 99"  # too few pages to judge


def test_style_tree_keeps_other_paragraphs_and_copies(spark):
    page = "<body><p>Own text {n}</p><p>All rights reserved</p></body>"
    same = [(100 + n, "http://copies.example/", "<body><p>One text</p><p>Another</p></body>") for n in range(10)]
    own = [(200 + n, "http://copies.example/", f"<body><p>Other {n}</p></body>") for n in range(2)]
    table = spark.createDataFrame([(n, "http://h.example/", page.format(n=n)) for n in range(12)] + same + own, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in rows(html_extract.extract(table))}
    assert [got[n] for n in range(12)] == [f"Own text {n}" for n in range(12)]
    assert got[103] == "One text\n\nAnother" and got[201] == "Other 1"


@pytest.mark.parametrize("outer,sent", [("main", 200_000), ("article", 200_000), ("article", 0)])
def test_style_tree_acts_inside_the_article(spark, outer, sent):
    page = "<body><{0}><div class=x><p>Read our other pages</p></div><p>Own text {1}</p><p>More {1}</p></{0}></body>"
    table = spark.createDataFrame([(n, "http://h.example/", page.format(outer, n)) for n in range(12)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in rows(html_extract.extract(table, sent=sent))}
    assert [got[n] for n in range(12)] == [f"Own text {n}\n\nMore {n}" for n in range(12)]


def test_contents_are_hashed_alike_by_any_route():
    """Keys depend on path, children and runs of text, and are the same when computed again."""
    one, other = (html_extract.parse(f"<div><p>a <b>b</b> c</p><p>{x}</p></div>") for x in ("d", "e"))
    first, second = dict(html_extract.style_nodes(one)), dict(html_extract.style_nodes(other))
    assert set(first) == set(second) and first == dict(html_extract.style_nodes(one))
    keys = [sorted(k for p, k in html_extract.style_nodes(t) if p.endswith("/p.")) for t in (one, other)]
    assert len(set(keys[0]) & set(keys[1])) == 1 and html_extract.main_text(one, frozenset(keys[0]) & frozenset(keys[1])) == "d"


def test_pages_odd(spark):
    table = spark.createDataFrame(
        [(1, None, None, "x"), (None, "http://[bad", "<p>a", "x"), (2, "u", "<p>b</p>", None), (2, "u", "<p>b</p>", None), (3, "u", "<p>" + "w " * 200000, "")],
        "page_id long, url string, html string, text string",
    )
    got = sorted(((r["page_id"] or 0, r["url"], r["text"][:5], r["n_chars"]) for r in rows(html_extract.extract(table))), key=str)
    assert got == sorted([(1, None, "", 0), (0, "http://[bad", "a", 1), (2, "u", "b", 1), (2, "u", "b", 1), (3, "u", "w w w", 399999)], key=str)
    assert html_extract.extract(table.limit(0)).count() == 0
