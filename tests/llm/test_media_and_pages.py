import hashlib
import html
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from framelake.llm import gif as G
from framelake.llm import html_extract as H
from framelake.llm.shared import table

from .helpers import docs, rows

# --- GIF ------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 3, 300, 4000, 70_000])
@pytest.mark.parametrize("colours", [1, 2, 256])
def test_lzw_round_trip(n, colours):
    data = np.random.default_rng(n).integers(0, colours, n).astype(np.uint8).tobytes()
    assert G.lzw_decode(G.lzw_encode(data), 8, n) == data


def _codes(codes, size):
    """Pack codes as a plain reader would expect them, one bit at a time."""
    bits, width, entries, first = [], size + 1, (1 << size) + 2, True
    for c in codes:
        bits += [c >> k & 1 for k in range(width)]
        if c == 1 << size:
            width, entries, first = size + 1, (1 << size) + 2, True
        elif first:
            first = False
        else:
            entries = min(entries + 1, 4096)
            if entries == 1 << width and width < 12:
                width += 1
    return bytes(sum(b << k for k, b in enumerate(bits[i : i + 8])) for i in range(0, len(bits), 8))


def _plain_decode(data, size):
    """A slow decoder, written from the format's description."""
    at, out, width, table, before = 0, [], size + 1, None, None
    bit = lambda i: data[i >> 3] >> (i & 7) & 1
    while at + width <= 8 * len(data):
        code = sum(bit(at + k) << k for k in range(width))
        at += width
        if code == 1 << size:
            table, width, before = [bytes([i]) for i in range(1 << size)] + [b"", b""], size + 1, None
            continue
        if code == (1 << size) + 1:
            break
        now = table[code] if code < len(table) else before + before[:1]
        if before is not None and len(table) < 4096:
            table.append(before + now[:1])
            if len(table) == 1 << width and width < 12:
                width += 1
        out.append(now)
        before = now
    return b"".join(out)


@pytest.mark.parametrize("seed", range(4))
def test_streams_agree_with_a_plain_reader(seed):
    rng = random.Random(seed)
    data = bytes(rng.choice(b"\0\1\2\3") for _ in range(rng.randint(1, 30_000)))
    assert _plain_decode(G.lzw_encode(data), 8) == data
    assert G.lzw_decode(_codes([4, 1, 6, 6, 2, 4, 0, 1, 5], 2), 2, 100) == _plain_decode(_codes([4, 1, 6, 6, 2, 4, 0, 1, 5], 2), 2)


def test_bad_streams():
    with pytest.raises(G.GifError):
        G.lzw_decode(_codes([4, 1, 7], 2), 2, 10)
    with pytest.raises(G.GifError):
        G.decode(b"not a gif")


def test_files_cut_anywhere_raise_only_their_own_error():
    palette = bytes(range(12))
    data = _gif([((0, 0, 2, 2), [0, 1, 2, 3], 1, None, 0), ((1, 0, 1, 1), [3], 2, 1, 1)], palette)
    local = data[:13] + data[25:]  # no global palette
    local = local[:10] + b"\x01" + local[11:]
    stored = G.store(bytes(range(256)) * 9)
    for whole in (data, local, stored[:1200] + b";"):
        read = 0
        for n in range(len(whole)):
            try:
                G.decode(whole[:n])
                read += 1
            except G.GifError:
                pass
        assert read or whole is local
    rng = random.Random(3)
    for _ in range(600):
        broken = bytearray(data)
        broken[rng.randrange(10, len(data))] = rng.randrange(256)
        try:
            G.decode(bytes(broken))
        except G.GifError:
            pass


def test_every_byte_has_a_colour_of_its_own():
    every = bytes(range(256)) + bytes(G.ROW - 256)
    frame = G.decode(G.store(every)).frames[0]
    assert G.payload_of(frame) == every
    assert len({tuple(p) for p in frame.pixels.reshape(-1, 4).tolist()}) == 256
    assert sum(n > 0 for n in G.histogram(frame)) == 64


def _gif(frames, palette, size=(2, 2)):
    """frames: (box, indices, disposal, transparent, interlaced)."""
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0xF1, 0, 0) + palette
    for (left, top, w, h), idx, disposal, hidden, inter in frames:
        out += struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (hidden is not None), 7, hidden or 0, 0)
        out += struct.pack("<BHHHHB", 0x2C, left, top, w, h, 0x40 * inter) + b"\x02"
        codes = [c for i in idx for c in (4, i)] + [5]
        stream = _codes(codes, 2)
        out += bytes([len(stream)]) + stream + b"\0"
    return out + b";"


PALETTE = bytes([10, 0, 0, 20, 0, 0, 30, 0, 0, 40, 0, 0])


def _reds(frame):
    return [[int(p[0]) if p[3] else None for p in row] for row in frame.pixels]


def test_disposal_and_transparency():
    whole, dot = (0, 0, 2, 2), (1, 0, 1, 1)
    shown = lambda d: [_reds(f) for f in G.decode(_gif([(whole, [0, 1, 2, 3], 1, None, 0), (dot, [3], d, None, 0), ((0, 1, 2, 1), [0, 1], 1, 1, 0)], PALETTE)).frames]
    assert shown(1) == [[[10, 20], [30, 40]], [[10, 40], [30, 40]], [[10, 40], [10, 40]]]
    assert shown(2)[2] == [[10, None], [10, 40]]
    assert shown(3)[2] == [[10, 20], [10, 40]]
    g = G.decode(_gif([(whole, [0, 1, 2, 3], 1, None, 0)], PALETTE))
    assert g.frames[0].delay_ms == 70 and G.histogram(g.frames[0], 4)[0] == 4


def test_interlaced_rows_and_local_boxes():
    rows_ = list(range(10))
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    idx = [r % 4 for r in order]
    g = G.decode(_gif([((0, 0, 1, 10), idx, 1, None, 1)], PALETTE, (1, 10)))
    assert [row[0] for row in _reds(g.frames[0])] == [10 * (r % 4 + 1) for r in rows_]
    g = G.decode(_gif([((1, 1, 5, 5), [2] * 25, 1, None, 0)], PALETTE))  # reaches over the canvas
    assert _reds(g.frames[0]) == [[None, None], [None, 30]]


def test_texts_as_gifs(spark):
    got = {(-1 if r.doc_id is None else r.doc_id): r for r in G.digests(G.media(docs(spark))).withColumnRenamed("id", "doc_id").collect()}
    for r in rows():
        raw = (r[1] or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        x = got[-1 if r[0] is None else r[0]]
        stored = G.store(payload)
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (x.media_bytes, x.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        bins = Counter(sum(v // 64 * 4**k for v, k in (((b >> 5) * 255 // 7, 2), ((b >> 2 & 7) * 255 // 7, 1), ((b & 3) * 85, 0))) for b in payload)
        assert x.feature == ",".join(f"{k}:{n}" for k, n in sorted(bins.items()))
        assert (x.n_frames, x.duration_ms) == (len(x.frames), 100 * len(x.frames))
        assert [f.height for f in x.frames] == [min(G.FRAME_ROWS, len(payload) // G.ROW - at) for at in range(0, len(payload) // G.ROW, G.FRAME_ROWS)]
        assert np.sum([f.histogram for f in x.frames], axis=0).tolist() == [bins[k] for k in range(64)]
    assert G.media(docs(spark, [])).count() == 0
    long = [(1, "täxt " * 30_000, "en", "s", 0, *["x"] * 9)]
    media = G.media(docs(spark, long)).collect()[0]
    assert len(media.frames) > 1 and bytes(media.payload).rstrip(b"\xff") == ("täxt " * 30_000).encode()


# --- pages ----------------------------------------------------------------------


def _text(page, url="http://a.example/x"):
    return [b.text for b in H.page_blocks(page, url)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>one<p>two <b>bold</b>er<br>line", ["one", "two bolder line"]),
        ("<nav>menu</nav><article><h1>T</h1><p>a&nbsp;b</p><aside>no</aside><div class='comments'>no</div></article><footer>f</footer>", ["T", "a b"]),
        ("<body><div id=sidebar>s</div><p>kept</p><form><p>no</p></form><script>if (a</b>) x</script><style>p{}</style>", ["kept"]),
        ("<main><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></main>", ["a", "b", "c", "d"]),
        ("<article><header><h1>Title</h1></header><p>x &lt; y</p></article>", ["Title", "x < y"]),
        ("<article><p><b>open<br><p>next</article> after", ["open", "next"]),
        ("<p>cut <em", ["cut"]),
        ("a < b <!-- no --> c <![CDATA[no]]>", ["a < b c"]),
        ("<div hidden>no</div><div style='display: none'>no</div><div role=navigation>no</div>yes", ["yes"]),
        ("<p>s<span class='share'>no</span>t</p>", ["s", "t"]),
        ("<div>" * 3000 + "deep" + "</div>" * 10, ["deep"]),
        ("<article><p title='a > b'>q</p></article>", ["q"]),
        ("<p class=it's>one</p><p title=\"two>three</p>", ["one", "three"]),
        ("<div class='with-sidebar'><article><div class='article-header'>H</div><p>a</p></article><div class=sidebar>no</div></div>", ["H", "a"]),
        ("<div id=page class=sidebar-left><h1>T</h1><p>long enough a text to be most of the page</p><div class=sidebar>no</div></div>", ["T", "long enough a text to be most of the page"]),
    ],
)
def test_rules(page, want):
    assert _text(page) == want


def test_hosts():
    assert H.host_of("https://user@WWW.Example.com:80/x?y") == "example.com"
    assert H.host_of("//a.b/c") == "a.b" and H.host_of(None) == "" and H.host_of("no url") == ""


def test_a_site_template_is_removed_and_content_stays(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    pages = []
    for i in range(12):
        own = " ".join(word() for _ in range(30))
        pages.append((i, "http://site.example/p", f"<body><div class=x><p>Call us today</p><p>All rights kept</p></div><div class=y><p>{own}</p></div></body>", own))
    pages.append((50, "http://other.example/p", "<body><div class=x><p>Call us today</p></div></body>", "Call us today"))
    pages.append((51, None, None, ""))
    pages.append((52, "http://site.example/q", "", ""))
    d = spark.createDataFrame([(a, b, c, "x", "y") for a, b, c, _ in pages], "page_id long, url string, html string, uid string, text string")
    got = {r.id: (r.text, r.n_removed) for r in H.main_text(d).collect()}
    assert {k: v[0] for k, v in got.items()} == {a: t for a, _, _, t in pages}
    assert all(got[i][1] == 2 for i in range(12))
    assert H.main_text(d.limit(0)).count() == 0
    # An article that a host repeats is no template.
    same = spark.createDataFrame([(i, "http://s.example/", "<article><p>Same words</p></article>") for i in range(9)], "page_id long, url string, html string")
    assert {r.text for r in H.main_text(same).collect()} == {"Same words"}


def _tree(pages):
    """Text and removed leaves by a style tree in plain dictionaries."""
    read, seen = [], set()
    for page_id, url, page in pages:
        found = H.page_blocks(page or "", url)
        body = (H.host_of(url), *(b.text for b in found))
        read.append((page_id, found, body not in seen))
        seen.add(body)
    weigh = lambda found: [b for b in found if not (b.kept and b.heading)]
    pages_of, having, styles = Counter(), Counter(), {}
    for _, found, first in read:
        if first:
            pages_of.update({b.place for b in weigh(found)})
            having.update({(b.place, f) for b in weigh(found) for f in H.features(b)})
            styles.update({b.place: b.parent for b in found})
    low = set()
    for place, m in pages_of.items():
        if m < H.LEAST_PAGES:
            continue
        shares = [pages_of[p] for p in pages_of if styles[p] == styles[place]]
        shown = -sum(c / sum(shares) * np.log(c / sum(shares)) for c in shares) / np.log(sum(shares))
        counts = [c for (p, _), c in having.items() if p == place]
        content = 1 - sum(c * np.log(c) / np.log(m) for c in counts) / sum(counts)
        if (1 - H.GAMMA) * shown + H.GAMMA * content < H.LOW:
            low.add(place)
    out = {}
    for page_id, found, _ in read:
        stays = [b for b in found if b.place not in low or b.kept and b.heading]
        chars = lambda bs: sum(len(b.text) for b in bs)
        if chars(found) - chars(stays) > H.MOST_REMOVED * chars(found):
            stays = found
        out[page_id] = (" ".join(b.text for b in stays), len(found) - len(stays))
    return out


def _site(rng, n, host, make):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    return [(host * 1000 + i, f"http://site{host}.example/{i}", make(i, lambda k: " ".join(word() for _ in range(k)))) for i in range(n)]


def test_the_tree_weighs_every_page(spark):
    rng = random.Random(4)
    notice = lambda i: "<div class=x><p>Read our terms before you copy this text</p></div>" if i % 9 else "<div class=x><p>Odd one out says other things</p></div>"
    paragraphs = lambda i, text: "".join(f"<p>{text(12)}</p>" for _ in range(1 + i % 4))
    sites = [
        # A notice and share line in neutral elements inside the article; articles of many lengths.
        _site(rng, 30, 1, lambda i, t: f"<body><nav>m</nav><article><h1>Title</h1>{paragraphs(i, t)}{notice(i)}<div>Tell your friends about this page now</div></article></body>"),
        # No article: a line with a date is a template, the post is not.
        _site(rng, 30, 2, lambda i, t: f"<body><div class=a><p>This site was last changed by us all on {t(1)}</p></div><div class=b>{paragraphs(i, t)}</div></body>"),
        # Few pages: nothing can be told.
        _site(rng, 3, 3, lambda i, t: f"<body><div class=a><p>Same on all</p></div><div class=b><p>{t(9)}</p></div></body>"),
        # Repeated pages, and pages of two bodies.
        [(4000 + i, "http://mirror.example/", "<body><div><p>One body only</p></div><div><p>second part</p></div></body>") for i in range(8)],
        [(5000 + i, "http://two.example/", f"<body><div><p>Body number {i % 2} of a page</p></div></body>") for i in range(8)],
        # Recrawls that differ in a line: nearly all would go, so nothing does.
        [(6000 + i, "http://crawl.example/", f"<article><p>{'A long text that stays as it was. ' * 4}</p><p>visit {i}</p></article>") for i in range(6)],
        # Templates by their links.
        _site(rng, 12, 7, lambda i, t: f"<body><div><a href=/home>{t(1)}</a></div><div><p>{t(20)}</p></div></body>"),
    ]
    pages = [p for s in sites for p in s]
    rng.shuffle(pages)
    d = spark.createDataFrame([(*p, "x", "y", "z") for p in pages], "page_id long, url string, html string, uid string, leaves string, place string").repartition(7)
    got = {r.id: (r.text, r.n_removed) for r in H.main_text(d).collect()}
    assert got == _tree(pages)
    assert sum(n > 0 for _, n in got.values()) > 0.5 * len(pages)
    for i in range(30):
        text, n = got[1000 + i]
        assert "friends" not in text and "terms" not in text and text.startswith("Title ") and n == 2
        assert "last changed" not in got[2000 + i][0] and got[2000 + i][1] == 1
    assert all(got[3000 + i][1] == 0 for i in range(3))
    assert {got[4000 + i] for i in range(8)} == {("One body only second part", 0)}
    assert {got[5000 + i] for i in range(8)} == {(f"Body number {k} of a page", 0) for k in (0, 1)}
    assert all(got[6000 + i][1] == 0 and "visit" in got[6000 + i][0] for i in range(6))
    assert H.main_text(d.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>The text</p></article><section id='comments'><article class='comment'>reader says hi</article></section>", ["The text"]),
        ("<article><p>The text</p></article><div class='comments'><article>" + "reader says a lot " * 30 + "</article></div>", ["The text"]),
        ("<div class='sidebar'><article class='teaser'>Teaser</article></div><div class='content'><p>Real body of the page</p></div>", ["Real body of the page"]),
        ("<div class='box'><article class='teaser'>Teaser</article></div><div class='text'><p>" + "Real body of the page. " * 4 + "</p></div>", ["Teaser", ("Real body of the page. " * 4).strip()]),
        ("<form id='aspnetForm'><input type=hidden name=s><div><p>The whole page is in a form</p></div></form>", ["The whole page is in a form"]),
        ("<p>A page of text</p><form><p>Your name</p><input><textarea></textarea></form>", ["A page of text"]),
        ("<div class='post social-science'><p>On society</p></div>", ["On society"]),
        ("<div class='post share'><p>Tell all</p></div><p>kept</p>", ["kept"]),
        ("<div>" * 200 + "<nav>MENU</nav><p>Body</p>", ["Body"]),
        ("<div class=list><article class=post><p>First post</p></article><article class=post><p>Second</p></article></div><article class=more>x</article>", ["First post", "Second"]),
        ("<article class='story'><p>Main</p><div class='related-links'>More</div></article>", ["Main"]),
    ],
)
def test_articles_and_names(page, want):
    assert _text(page) == want


def test_the_driver_pages_against_a_plain_reading(spark, small):
    pages = table(spark, small, "pages")
    got = {r.id: r.text for r in H.main_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        parts = (re.sub(r"\s+", " ", html.unescape(re.sub("</?b>", "", p))).strip() for p in re.split("</?(?:p|h1|br)>", body))
        assert got[r.page_id] == " ".join(p for p in parts if p)


@pytest.mark.parametrize("n", [10, 250, 3000])
def test_text_after_a_deep_nest_stays_in_its_article(n):
    nest = "<div>" * n + "deep" + "</div>" * n
    assert _text(f"<div><article><p>A</p>{nest}<p>B</p></article></div>") == ["A", "deep", "B"]
    assert _text(f"<article><p>A</p>{'<div>' * n}<nav>no</nav>{'</div>' * n}<p>B</p></article>") == ["A", "B"]


def test_a_form_that_wraps_the_page_is_spared():
    assert _text("<form id=aspnet><nav>no</nav><article><p>a</p></article></form>") == ["a"]
    assert _text("<form><h1>T</h1><p>long enough a text to be most of the page</p></form><p>x</p>") == ["T", "long enough a text to be most of the page", "x"]
    assert _text("<article><p>a</p><form class=head>no</form></article>") == ["a"]
    assert _text("<article><form role=search><p>no</p></form><p>a</p></article>") == ["a"]


def test_all_features_of_a_leaf_are_counted(spark):
    words = [f"w{k}" for k in range(200)]
    assert len(H.features(H.Block(1, 0, False, False, False, " ".join(words), ["/a", "/b"]))) == 200
    # Nine pages share a line but for its first words; every feature has its say, in
    # whatever parts and shares the counts are made.
    rng = random.Random(6)
    leaves = [[{"place": 1 + j, "parent": 0, "links": [f"/{i % 2}"], "text": " ".join([f"x{rng.randrange(3)}" for _ in range(9)] + words[: 40 * j])} for j in range(3) for _ in range(2)] for i in range(9)]
    counts = Counter()
    for page in leaves:
        counts.update({(x["place"], " ".join(x["text"].split(" ")[k : k + 3])) for x in page for k in range(len(x["text"].split(" ")) - 2)} | {(x["place"], f"link {x['links'][0]}") for x in page})
    want = {p: (sum(c for (q, _), c in counts.items() if q == p), sum(c * np.log(c) for (q, _), c in counts.items() if q == p)) for p in (1, 2, 3)}
    d = spark.createDataFrame([(i, page, 1) for i, page in enumerate(leaves)], "uid long, leaves array<struct<place:long,parent:long,links:array<string>,text:string>>, counts long")
    for counted, added in ((H.COUNTED, H.ADDED), (50, 1)):
        got = {r.place: (r.n, r.logs) for r in H.feature_sums(d.repartition(3), counted, added).collect()}
        assert {p: n for p, (n, _) in got.items()} == {p: n for p, (n, _) in want.items()}
        assert all(abs(got[p][1] - want[p][1]) < 1e-6 for p in want)
    assert H.feature_sums(d.limit(0)).collect() == []
