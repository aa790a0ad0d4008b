import gzip
import hashlib
import io
import random
import time

import pytest

from talkloom.llm.html_text import extract_main_text, main_text, parse
from talkloom.llm.warc import (
    Pieces, arc_archive, arc_header, convert_arc, gzip_member, pages_to_arc, parse_arc, parse_warc, read_warc, unpacked, warc_round_trip, with_revisits, write_warc,
)


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions_round_trip(version):
    records = [("http://a/x y", b"HTTP/1.0 200 OK\r\n\r\n<p>\n\nWARC/1.1 http://a 0 0 text/html 5\n"), ("http://b/", b""), ("http://c/", "é\n".encode() * 1000)]
    got = list(parse_arc(arc_archive(records, version)))
    assert [(r["url"], r["block"]) for r in got] == [(u, b) for u, b in records]
    assert not any(r["truncated"] for r in got)


def test_arc_truncated_and_broken():
    archive = arc_archive([("http://a/", b"0123456789")])
    assert [(r["block"], r["truncated"]) for r in parse_arc(archive[:-5])] == [(b"012345", True)]
    assert list(parse_arc(b"")) == []
    for broken in (b"http://a/ 0 0 text/html 3\nabc\n", archive + b"no length here\n", archive + b"x 5\nabcde\n"):
        with pytest.raises(ValueError):
            list(parse_arc(broken))
    assert arc_header(1, "u", "20000101000000", "t/p", 7) == b"u 0.0.0.0 20000101000000 t/p 7\n"


PAGES = "page_id long, url string, html string, record_type string, payload_bytes string"


def test_round_trip_of_odd_pages(spark):
    same, long = "<p>" + "é" * 200 + "\r\n\r\nWARC/1.1\r\n</p>", "x" * 300_000
    rows = [(5, "http://a", same, "c", "c"), (3, "http://b", same, None, None), (9, None, same, None, None), (1, "http://s p", None, None, None), (2, "u", "", None, None), (4, "u", "short", None, None), (6, "u", "short", None, None), (7, "u", long, None, None), (8, "u", long, None, None), (8, "u", long, None, None), (None, "u", same, None, None), (10, "u", "y" * 99, None, None), (11, "u", "y" * 99, None, None), (12, "u", "y" * 100, None, None), (13, "u", "y" * 100, None, None)]
    got = warc_round_trip(spark.createDataFrame(rows, PAGES)).toPandas()
    assert len(got) == len(rows) and list(got.columns) == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    seen = sorted((-1 if r.page_id != r.page_id else int(r.page_id), r.record_type, None if r.refers_to != r.refers_to else int(r.refers_to)) for r in got.itertuples())
    assert seen == [(-1, "revisit", 3), (1, "response", None), (2, "response", None), (3, "response", None), (4, "response", None), (5, "revisit", 3), (6, "response", None), (7, "response", None), (8, "revisit", 7), (8, "revisit", 7), (9, "revisit", 3), (10, "response", None), (11, "response", None), (12, "response", None), (13, "revisit", 12)]
    html = {i: h or "" for i, _, h, *_ in rows}
    for r in got.itertuples():
        payload = html[None if r.page_id != r.page_id else int(r.page_id)].encode()
        assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha256(payload).hexdigest())


def test_ids_are_text_of_any_kind(spark):
    rows = [("", "u", "a" * 200), (None, "u", "b" * 200), ("x\r\ny: z é+%", "u", "c" * 200), ("0", "u", "c" * 200)]
    got = warc_round_trip(spark.createDataFrame(rows, "page_id string, url string, html string")).toPandas()
    seen = {(r.page_id, r.record_type, r.refers_to) for r in got.astype(object).where(got.notna(), None).itertuples()}
    assert seen == {("", "response", None), (None, "response", None), ("0", "response", None), ("x\r\ny: z é+%", "revisit", "0")}


def test_large_pages(spark, tmp_path):
    rng = random.Random(1)
    noise = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=3_000_000))
    pages = [(k, "u", noise[k:] * (7 if k == 1 else 1)) for k in range(4)]  # one of 21 MB, in a member of over 16 MB
    got = warc_round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).toPandas().set_index("page_id")
    for k, _, html in pages:
        assert (got.payload_bytes[k], got.payload_digest[k]) == (len(html), hashlib.sha256(html.encode()).hexdigest())
    assert gzip.decompress(gzip_member(b"ab" * 9_000_000)) == b"ab" * 9_000_000


def test_pieces_and_members():
    data = [bytes([65 + k]) * (k * 1000) for k in range(30)]
    packed = b"".join(map(gzip_member, data))
    for fed, most in ((1, 7), (100, 1000), (1 << 14, 1 << 20)):
        assert b"".join(unpacked(packed, fed, most)) == b"".join(data)
    file = Pieces(iter([b"ab", b"c\nd", b"", b"never"]))
    assert (file.readline(), file.read(1), file.read(5)) == (b"abc\n", b"d", b"")


def test_equal_rows_have_identifiers_of_their_own(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 200)] * 5, "page_id long, url string, html string").repartition(2)
    records = convert_arc(pages_to_arc(pages))
    assert records.select("record_id").distinct().count() == 5
    kinds = [r.record_type for r in warc_round_trip(pages).collect()]
    assert sorted(kinds) == ["response"] + ["revisit"] * 4


def test_no_pages(spark):
    empty = spark.createDataFrame([], PAGES)
    assert warc_round_trip(empty).count() == 0 and extract_main_text(empty).count() == 0


def test_written_files_are_warc(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "<p>" + "z" * 150 if k % 2 else f"<p>{k}" * 40, None, None) for k in range(6)], PAGES)
    records = convert_arc(pages_to_arc(pages, version=2))
    path = str(tmp_path / "warc")
    write_warc(with_revisits(records.coalesce(1)), path, file_bytes=600)
    files = sorted((tmp_path / "warc").glob("*.warc.gz"))
    each = [list(parse_warc(io.BytesIO(gzip.decompress(file.read_bytes())))) for file in files]
    assert len(files) > 1 and all([f["warc-type"] == "warcinfo" for f, _ in one] == [True] + [False] * (len(one) - 1) for one in each)
    assert all(file.read_bytes().count(b"\x1f\x8b\x08") == len(one) for file, one in zip(files, each))  # a member a record
    found = [f for one in each for f in one[1:]]
    assert len(found) == 6 and sum(f["warc-type"] == "revisit" for f, _ in found) == 2
    responses = {f["warc-record-id"] for f, _ in found if f["warc-type"] == "response"}
    for fields, block in found:
        assert len(block) == int(fields["content-length"]) and fields["warc-date"] == "1997-07-01T12:00:00Z"
        assert fields["warc-type"] == "response" or fields["warc-refers-to"] in responses
    assert read_warc(spark, path).count() == 6


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{body}</body></html>"


PARAGRAPHS = "".join(f"<p>Paragraph {k} of the article with enough words to be read as text, and a bit more.</p>" for k in range(4))
TEXT = "\n".join(f"Paragraph {k} of the article with enough words to be read as text, and a bit more." for k in range(4))
AROUND = [
    "<nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>", "<header><p>Site name and its slogan, of some length, for all to read.</p></header>", "<footer>&copy; x &middot; y</footer>",
    '<div class="sidebar"><p>Other stories that are of some length, which nobody should find here.</p></div>', "<aside>More of it, again of some length, and no part of the article.</aside>",
    '<div class="cookie-notice">We use cookies and so on, please accept all of them right now.</div>', '<div id="ad-top">Buy this, it is cheap, and then buy that, too.</div>',
    '<form><label>Mail</label><input name=x><button>Send</button></form>', "<script>var x = '<p>no</p>';</script><style>p{}</style><!-- <p>no</p> -->",
    '<div id="comments"><article class="comment"><p>A reader comment of quite some length, which is not the article, is it.</p></article></div>',
    '<section class="related"><h2>Related</h2><a href=/x>Something else to read, with a long title</a></section>',
]


@pytest.mark.parametrize("around", AROUND)
@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main>{}</main>", '<div class="content"><div class="post">{}</div></div>', "<div>{}</div>", "{}"])
def test_article_among_other_things(around, wrap):
    assert main_text(page(around + wrap.format(PARAGRAPHS))) == TEXT
    assert main_text(page(wrap.format(PARAGRAPHS) + around)) == TEXT


def test_sections_headings_and_inline_markup():
    body = "<article><h1>A&amp;B</h1><section><h2>One</h2><p>First <b>bold</b> and <a href=/>a link</a>,\n  spaced&nbsp; out<br>here.</p></section><section><h2>Two</h2><p>Second&hellip; text of this article &#228; &#x4e2d; &lt;tag&gt;</p><ul><li>item</ul></section></article>"
    assert main_text(page(body)) == "A&B\nOne\nFirst bold and a link, spaced out here.\nTwo\nSecond… text of this article ä 中 <tag>\nitem"


def test_broken_pages():
    assert main_text("<p>one<p>two <b>x<p>three") == "one\ntwo x\nthree"
    assert main_text("<article><p>text of it</p><p>cut off &am") == "text of it\ncut off &am"
    assert main_text("<article><p>text of it</p><foot") == "text of it"
    assert main_text(None) == main_text("") == main_text("<div></div>") == ""
    assert main_text("no markup < 3 & so") == "no markup < 3 & so"
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert main_text(deep) == "deep"
    assert parse("</div></p>").tag == "body"


HOSTILE = ["<a", "<a ", '<a "', "<p x='>", "<title>", "<", "<!--", "</", "<a b=' c=\">", '<div class="a" ', "<div>", "<div><p>", "</x>", "<ul><li>", "<object>", "&", "<a>"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_hostile_pages_take_linear_time(piece):
    began = time.process_time()
    main_text(piece * (300_000 // len(piece)) + "</x>" * 20_000)
    assert time.process_time() - began < 5


S = "This sentence is one of several that make the article long enough. "
#: Pages marked by hand: what of them is the article.
MARKED = [
    (f"<form id=aspnetForm><div><h1>T</h1><p>{S * 3}</p></div><input name=x></form>", ["T", S * 3]),
    (f"<form><p>{S}</p><p>{S}</p></form>", [S, S]),
    (f"<article><p>{S}</p><object data=x><p>{S * 2}</p></article>", [S, S * 2]),
    (f"<article><p>{S}</p><object data=x><p>no plug-in, sorry, get one for this to be seen</p></object><p>{S * 2}</p></article>", [S, S * 2]),
    (f"<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here. {S}</p><p>{S}</p></article>", ["So x=2 here. " + S, S]),
    (f'<article><p>{S}</p><section id="discussion"><h2 id="sharing-data">Data</h2><p>{S}</p></section></article>', [S, "Data", S]),
    (f'<article><p>{S}</p><section id="related-work"><h2>Related work</h2><p>{S}</p></section></article>', [S, "Related work", S]),
    (f'<article><p>{S}</p><p>{S}</p><section id="discussion"><div class="comment"><p>{S}</p></div></section></article>', [S, S]),
    (f'<article class="post comments-open"><p>{S}</p><p>{S}</p></article>', [S, S]),
    (f'<article><h1>T</h1><p>{S * 4}</p><div class="newsletter"><form><p>Get our letter, every week, by mail</p></form></div></article>', ["T", S * 4]),
    (f'<nav>{"<a href=/x>a long menu entry of the site, with words</a>" * 40}</nav><div><p>{S}</p><p>{S}</p></div>', [S, S]),
    (f"<aside><p>{S}</p><p>{S}</p></aside>", [S, S]),
    (f"<title>never closed<article><p>{S}</p><p>{S}</p></article>", [S, S]),
    (f'<article><p title="a > b">{S}</p><p>{S}</p><img alt="x>y"></article>', [S, S]),
    (f'<article><p>{S}</p><p>{S}</p></article><ol class="commentlist"><li><p>{S}</p></li></ol>', [S, S]),
]


@pytest.mark.parametrize("html, blocks", MARKED)
def test_pages_marked_by_hand(html, blocks):
    want = "\n".join(b.strip() for b in blocks)
    got = main_text(html)
    assert got.removeprefix("never closed\n") == want
    assert main_text(page(html)).removeprefix("never closed\n") == want


def test_extraction_keeps_rows(spark):
    rows = [(1, "u", page("<article>" + PARAGRAPHS + "</article>"), "c", "c"), (1, "u", None, None, None), (None, None, "<p>" + "long " * 100_000, None, None)]
    got = extract_main_text(spark.createDataFrame(rows, PAGES)).toPandas()
    assert sorted(map(len, got.text)) == sorted([len(TEXT), 0, 499_999]) and list(got.columns) == ["page_id", "url", "text"]
