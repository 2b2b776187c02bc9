"""WARC round trip and main text of pages."""

import gzip
import hashlib
import io
import json
import zlib

import pytest

from codeloom.llm import html_text, warc

BIG = "<p>" + "same payload " * 20 + "</p>"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, payload string, size int")


ROWS = [(3, "http://a/ b\r\nX: y", BIG), (1, None, BIG), (2, "http://c/é", BIG), (None, "http://d", BIG), (5, "u", None), (6, "u", ""), (7, "u", "short"), (8, "u", "short"), (9, "u", "é\r\n\r\nWARC/1.1\r\n" * 30000), (1, "again", BIG), (None, "lone", "z" * 200)]


def test_round_trip(spark, tmp_path):
    folder = str(tmp_path)
    pages = pages_of(spark, ROWS)
    arch = warc.write(pages, folder)
    norm = warc.normalise(arch, folder)
    rows = warc.read(norm, folder, with_payload=True).collect()
    assert len(rows) == len(ROWS)
    first = {}
    for p, _, h in ROWS:
        if p is not None and len((h or "").encode()) >= warc.LEAST:
            first[h] = min(p, first.get(h, p))
    want = []
    for p, _, h in ROWS:
        raw = (h or "").encode()
        to = first.get(h) if len(raw) >= warc.LEAST and first.get(h) != p else None
        want.append((str(p), len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", str(to)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in rows) == sorted(want)
    assert all(bytes(r.payload) == (b"" if r.record_type == "revisit" else next((h or "").encode() for _, _, h in ROWS if hashlib.sha256((h or "").encode()).hexdigest() == r.payload_digest)) for r in rows)
    # the writer's files are one member each; normalised ones have a member for every record and inflate to the same bytes
    for a in arch.collect():
        raw = open(a.path, "rb").read()
        z = zlib.decompressobj(31)
        whole = z.decompress(raw)
        assert z.eof and not z.unused_data
        n = next(x for x in norm.collect() if f"/{a.path.rpartition('/')[2][:-8]}-" in x.path)
        assert gzip.open(n.path).read() == whole and n.n_records == a.n_records
        entries = [json.loads(x) for x in open(n["index"])]
        data = open(n.path, "rb").read()
        assert sum(e[1] for e in entries) == len(data)
        for offset, length, kind, page in entries:
            fields, _ = warc.parse(zlib.decompress(data[offset : offset + length], 31))
            assert fields["WARC-Type"] == kind and fields.get("X-Page-ID") == page


def test_empty_table(spark):
    assert warc.round_trip(pages_of(spark, ROWS).limit(0)).count() == 0


def test_files_roll_and_inflate_in_blocks(spark, tmp_path, monkeypatch):
    raw = [warc.record(str(i), "u", b"x" * (i * 997 % 5000), i * 997 % 5000, "0" * 64, None) for i in range(400)]
    for data in (gzip.compress(b"".join(raw)), b"".join(gzip.compress(r) for r in raw)):
        monkeypatch.setattr(warc, "BLOCK", 777)
        assert list(warc.records(warc.inflate(io.BytesIO(data)))) == raw
    with pytest.raises(ValueError):
        list(warc.records([raw[0] + b"WARC/1.1\r\n"]))


def test_any_string_is_an_id(spark, tmp_path):
    ids = ["", "a\r\nX-Page-ID: z", "é %41", "plain", None, ": ", "\n", "x" * 3000]
    pages = spark.createDataFrame([(i, "u", BIG) for i in ids] + [(i, "u", f"own {i} " * 40) for i in ids], "page_id string, url string, html string")
    for few in (warc.FEW, -1):  # answers are sent to tasks, or joined by a shuffle
        warc_few, warc.FEW = warc.FEW, few
        try:
            got = warc.round_trip(pages, f"{tmp_path}/{few}").collect()
        finally:
            warc.FEW = warc_few
        assert sorted(str(r.page_id) for r in got) == sorted(str(i) for i in ids * 2)
        assert {(r.page_id, r.refers_to) for r in got if r.record_type == "revisit"} == {(i, "") for i in ids if i != ""}


def test_damage_is_an_error(spark, tmp_path):
    raw = [warc.record(str(i), "u", b"x" * 50, 50, hashlib.sha256(b"x" * 50).hexdigest(), None) for i in range(9)]
    members = [gzip.compress(r) for r in raw]
    with pytest.raises(ValueError):
        list(warc.records(warc.inflate(io.BytesIO(gzip.compress(b"".join(raw))[:-9]))))
    cut = tmp_path / "a.warc.gz"
    cut.write_bytes(b"".join(members[:-1]))  # cut between two members: only the count tells
    with pytest.raises(Exception, match="holds 8 records, not 9"):
        warc.normalise(spark.createDataFrame([(str(cut), 9)], "path string, n_records long"), str(tmp_path))
    done = warc.normalise(spark.createDataFrame([(str(cut), None)], "path string, n_records long"), str(tmp_path)).collect()[0]
    assert warc.read(spark.createDataFrame([done]), str(tmp_path)).count() == 8
    with pytest.raises(Exception, match="lists 8 records, not 7"):
        warc.read(spark.createDataFrame([(done.path, done["index"], 7)], "path string, index string, n_records long"), str(tmp_path)).count()


CASES = [
    ("<body><nav>menu <a href=x>a</a></nav><article><h1>T &amp; U</h1><p><b>one<br>two<br><p>three&nbsp; x\n y</article><footer>f</footer>", "T & U\n\none two\n\nthree x y"),
    ("<article><header><h1>Title</h1></header><p>Text of it.</p><aside>no</aside><div class='post-comments'><p>no</p></div><form><p>no</p></form></article>", "Title\n\nText of it."),
    ("<div id=page><div class=sidebar><ul><li><a href=/>x</a></ul></div><div id=main><h2>Head</h2><p>Long enough text to be the core of it, with some words.</p><p>And more text.</p></div><div class='cookie-notice'>no</div></div>", "Head\n\nLong enough text to be the core of it, with some words.\n\nAnd more text."),
    ("<script>var t='</p>'; if (a<b) x</script><main><p>a &lt;b&gt; &#233; &copy;</p><style>p{}</style><!-- <p>no</p> --><ul><li>i<li>j</ul></main>", "a <b> é ©\n\ni\n\nj"),
    ("just text, no tags", "just text, no tags"),
    ("<p>5 < 6 and 7 > 2</p>", "5 < 6 and 7 > 2"),
    ("<article><p title='a > b'>quoted</p><p class=\"x>unclosed</p></article>", None),
    ("", ""), (None, ""), ("   \n ", ""), ("<html><body></body></html>", ""), ("</p></div>", ""), ("<!-- open", ""),
]


@pytest.mark.parametrize("page,want", CASES)
def test_main_text(page, want):
    got = html_text.main_text(page)
    assert got == want if want is not None else "quoted" in got


def test_long_and_deep_pages():
    deep = "<div>" * 20000 + "<p>" + "word " * 50000 + "</p>" + "</div>" * 20000
    assert html_text.main_text(deep) == ("word " * 50000).strip()
    many = "<article>" + "".join(f"<p>para {i}.</p>" for i in range(20000)) + "</article>"
    assert html_text.main_text(many).count("\n\n") == 19999


def test_rows(spark):
    rows = [(i, None if i % 3 else "u", p) for i, (p, _) in enumerate(CASES)] + [(0, "u", CASES[0][0]), (None, None, None)]
    got = html_text.extract(pages_of(spark, rows)).collect()
    assert sorted((str(r.page_id), r.url or "", r.text) for r in got) == sorted((str(i), u or "", html_text.main_text(p)) for i, u, p in rows)
    assert html_text.extract(pages_of(spark, rows).limit(0)).count() == 0


PROSE = "some plain words of the article that go on for a while, " * 3


def _p(*words):
    return "".join(f"<p>{w} {PROSE}</p>" for w in words)


def first_words(page):
    return [b.split()[0] for b in html_text.main_text(page).split("\n\n")]


LINKS = "".join(f"<a href=/{i}>go to {i}</a> " for i in range(40))
SELECTED = [
    # sections around an advert, and a list of links
    (f"<div id=post><h2>Head</h2><div class=s>{_p('one', 'two', 'three')}</div><div class=ad><p>buy</p></div><div class=s>{_p('four')}</div><div class=list>{LINKS}</div></div><footer>f</footer>", ["Head", "one", "two", "three", "four"]),
    # heading, introduction and a second section beside the core, with and without a wrapper
    (f"<h1>Head</h1><p>Intro {PROSE}</p><div id=a>{_p('one', 'two', 'three')}</div><div id=b>{_p('four')}</div>", ["Head", "Intro", "one", "two", "three", "four"]),
    (f"<div><h1>Head</h1><p>Intro.</p><div id=a>{_p('one')}</div><div id=b>{_p('two', 'three', 'four')}</div></div>", ["Head", "Intro.", "one", "two", "three", "four"]),
    # a sparse block beside the path fails the threshold, the dense one within it doesn't
    (f"<div id=page><div><p>Tel.<br>1</p><p>Fax<br>2</p><p>x</p></div><div id=main>{_p('one', 'two')}</div></div>", ["one", "two"]),
    (f"<div id=page><div><p>Tel.<br>1</p><p>Fax<br>2</p><div>{_p('inner')}</div></div><div id=main>{_p('one', 'two', 'three')}</div></div>", ["inner", "one", "two", "three"]),
    # class words that also name content
    (f"<article><p class=notice>first {PROSE}</p><div class='social history'>second {PROSE}</div></article>", ["first", "second"]),
    (f"<article>{_p('one', 'two')}<p class=notice>Mind the gap.</p><div class='related'><a href=/>a link of it</a></div></article>", ["one", "two"]),
    # dense boilerplate, unless it holds the article
    (f"<article>{_p('one')}</article><div id=comments>{_p('c1', 'c2', 'c3', 'c4')}</div><div class='ads'>buy {PROSE}{PROSE}</div>", ["one"]),
    (f"<div class='hentry has-comments'><h1>Head</h1>{_p('one', 'two')}</div>", ["Head", "one", "two"]),
    # links in main
    (f"<main>{_p('one')}{LINKS}</main>", ["one"]),
    (f"<main>{_p('one')}<ul>" + "".join(f"<li><a href=/{i}>go to {i}</a></li>" for i in range(40)) + "</ul></main>", ["one"]),
]


@pytest.mark.parametrize("page,want", SELECTED)
def test_selection(page, want):
    assert first_words(f"<html><body>{page}</body></html>") == want
    assert first_words(page) == want


def brute_densities(n, body):
    """(characters, tags, in links, links) of a node straight from its subtree."""
    strings, tags, stack = [], 0, [(n, n.tag == "a")]
    links = int(n.tag == "a")
    while stack:
        x, in_link = stack.pop()
        for k in x.kids:
            if isinstance(k, str):
                strings.append((len(" ".join(k.split())), in_link))
            elif not k.junk:
                tags += 1
                links += k.tag == "a"
                stack.append((k, in_link or k.tag == "a"))
    return sum(c for c, _ in strings), tags, sum(c for c, link in strings if link), links


def test_densities_match_brute_force():
    import math
    import random

    rnd = random.Random(7)
    for _ in range(60):
        page = "".join(rnd.choices(["<div>", "</div>", "<p>", "</p>", "<a href=x>", "</a>", "<b>", "words of text ", "x", "<ul><li>", "</ul>", "<div class=ad>", "<br>", "<nav>", "</nav>"], k=120))
        root = html_text.tree(page)
        html_text._settle_marks(root)
        nodes = html_text._densities(root)
        cb, _, lcb, _ = brute_densities(root, root)
        for n in nodes:
            c, t, lc, lt = brute_densities(n, root)
            assert (n.chars, n.tags, n.link_chars, n.link_tags) == (c, t, lc, lt)
            want = 0.0 if not c else c / max(1, t) * math.log(max(1, c / max(1, lc) * max(1, t) / max(1, lt))) / math.log(1 + math.log(c / max(1, c - lc) * lc + lcb / max(1, cb) * c + math.e))
            assert abs(n.density - want) < 1e-6 * max(1, want) and n.plain == (c - lc) / max(1, t - lt)
            assert abs(n.sum - sum(k.density for k in n.kids if not isinstance(k, str) and not k.junk)) < 1e-6


BROKEN = ["<a ", "<b><i>", "<div>x</div>", "<a '\"", "<p><b>", "</b>", "<!--", "<a href=\"", "<td><tr>", "<li><p>x", "< <", "&amp", "<a b='>\">", "<script>", "</div><p>", "<table><tr><td>x"]


@pytest.mark.parametrize("piece", BROKEN)
@pytest.mark.parametrize("tail", ["", "<div>x</div>", ">", "</b><i></p>"])
def test_broken_pages_take_linear_time(piece, tail):
    import time

    took = []
    for n in (4_000, 16_000):
        page = piece * n + tail * n
        began = time.process_time()
        html_text.main_text(page)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.3, took
