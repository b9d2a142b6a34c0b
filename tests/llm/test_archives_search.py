import hashlib
import random
import zlib

import numpy as np
import pytest

from seqframe.llm import blocks, decontaminate, packing, template, topk, warc

NAN, INF = float("nan"), float("inf")


# --- archives -------------------------------------------------------------------------

PAGES = [
    (1, "http://www.example.com/b", "x" * 200), (2, "http://example.com/a?q=1", "x" * 200), (3, None, None),
    (4, "https://Sub.Example.org:8080/ü", "é" * 60), (5, "not a url", "short"), (6, "http://[bad", "short"),
    (7, "http://example.com/\ttab\r\nline", "y" * 99), (8, "http://example.com/z", "y" * 99), (9, "", "a\r\n\r\nb" * 30),
    (10, "http://example.com/a?q=1", "a\r\n\r\nb" * 30), (11, "http://example.com/long", "long " * 200_000),
    (2, "http://example.com/a?q=1", "x" * 200), (None, "http://example.com/none", "x" * 200),
]


def plain_records(pages):
    first = {}
    for i, _, t in pages:
        if len((t or "").encode()) >= 100 and i is not None:
            first[t] = min(first.get(t, i), i)
    out = []
    for i, _, t in pages:
        data = (t or "").encode()
        revisit = t in first and first[t] != i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response",
                    first[t] if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("lines", [1, 3, 512])
def test_archives_round_trip(spark, tmp_path, monkeypatch, lines):
    monkeypatch.setattr(warc, "BLOCK_LINES", lines)
    rows = PAGES + [(100 + i, f"http://h{i % 7}.example.net/{i}", f"page {i} " * 20) for i in range(120)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    archives = warc.write(pages.repartition(4), f"file://{tmp_path}/w")
    got = warc.read(archives, pages).collect()
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=repr
                  ) == plain_records(rows)
    text = {r.page_id: bytes(r.payload).decode() for r in got if r.payload is not None}
    assert text[11] == "long " * 200_000 and text[3] == "" and text[4] == "é" * 60
    one = spark.createDataFrame([(104, "http://h4.example.net/4"), (104, "http://h5.example.net/4"), (1, "gone")],
                                "page_id long, url string")
    assert [(r.page_id, r.record_type) for r in warc.read(archives, one).collect()] == [(104, "response")]


def test_archives_of_no_pages(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(pages, f"file://{tmp_path}/w"), pages).count() == 0


def test_keys_and_broken_records():
    key = warc.reversed_host_key
    assert key("http://www.Example.com:80/a/b?c=d#e") == "com,example,www:80)/a/b?c=d"
    assert key("https://example.com") == "com,example)/" and key(None) == "" and key("http://[bad") == "http://[bad"
    data = warc.record(1, "u", 3, "00", b"abc", None)
    assert warc.parse(data)[2] == b"abc"
    with pytest.raises(ValueError):
        warc.parse(data[:-6])


def test_range_reads(tmp_path):
    data = bytes(range(256)) * 40
    blocks.put(f"file://{tmp_path}/f", data)
    reader = blocks.Reader(f"file://{tmp_path}/f", ahead=100)
    for a, n in [(0, 10), (10, 20), (30, 500), (530, 1), (5, 3), (9000, 1240), (0, 10240)]:
        assert reader.read(a, n) == data[a:a + n]


# --- decontamination ------------------------------------------------------------------

def plain_contamination(docs, items, width):
    def words(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in t).split(" ")

    def clean(t):
        return [w for w in words(t) if w]

    wins = set()
    for i, t in items:
        w = clean(t)
        wins |= {(str(i if i is not None else ""), tuple(w[k:k + width])) for k in range(max(1, len(w) - width + 1)) if w}
    out = []
    for i, t in docs:
        w, hit, found = clean(t), set(), set()
        for item, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k:k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(item)
        out.append((i, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width, index_bytes", [(13, 1 << 20), (4, 1 << 20), (4, 300)])
def test_contamination_equals_the_plain_version(spark, monkeypatch, width, index_bytes):
    monkeypatch.setattr(decontaminate, "INDEX_BYTES", index_bytes)
    rng = random.Random(width)
    vocabulary = ["the", "of", "Élan", "x1", "don't", "a"] + [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 30)))) for i in range(30)]
    items += [(None, "null item words " * 5), (70, None), (71, ""), (72, "..."), (3, items[4][1]), (4, items[4][1])]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(40)]
    for i in range(20):
        a, b = rng.choice(items)[1] or "", rng.choice(items)[1] or ""
        docs.append((100 + i, docs[i][1] + " " + a[:rng.randrange(1, 200)].upper() + ", " + b))
    docs += [(200, None), (201, ""), (202, "?!"), (203, "w1 " * 3000 + (items[0][1] or "")), (100, docs[40][1])]
    frame = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n long, items string")
    bench = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, part string")
    got = decontaminate.contamination(frame, bench, width=width).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in got], key=repr
                  ) == plain_contamination(docs, items, width)


def test_contamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contamination(docs, items).collect()] == [(1, 2, 0, [], False)]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(docs.limit(0), some).count() == 0


# --- packing --------------------------------------------------------------------------

TOKENIZER = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path(TOKENIZER)


def check_packing(rows, window):
    """Gapless sequences within the window; every id of every document in one piece."""
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    return by_sequence, by_doc


def test_ids_of_odd_spellings_are_the_tokenizer_s(tokenizer_path):
    from tokenizers import Tokenizer
    tokenizer, rng = Tokenizer.from_file(tokenizer_path), random.Random(10)
    symbols = [*"aIiZ .,'-_<|>!1", "\u0130", "\u0131", "\u0307", "\u0301", "\u00c5", "\u212a", "\u1e9e", "\u03a3", "\u03c2", "\ufb01",
               "\u01c5", "\u00df", "\u0345", "\u1fbc", "\u00b5", "\uff21", "\u4e2d", "\u0e33", "\u200d", "\u00a0"]
    texts = ["".join(rng.choice(symbols) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    texts += ["TE\u015eEKK\u00dcRLER\u0130. ANKARA'DA YEN\u0130, B\u0130R", "\u0130.", "\u0130'\u0130-"]
    got = packing.token_ids(texts, tokenizer_path, 2)
    for text, data in zip(texts, got):
        assert np.frombuffer(data, "<u4").tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2], ascii(text)


def test_packed_pieces(spark, tokenizer_path):
    from tokenizers import Tokenizer
    tokenizer, rng = Tokenizer.from_file(tokenizer_path), random.Random(9)
    texts = ["Hello  wörld's  x\tz\ny, don't 123!! <|endoftext|> É é İ ΣΑΣ", None, "", " ", "́a ́b",
             "many words " * 700, "one"] + [" ".join(rng.choice(["a", "bc", "Def."]) for _ in range(rng.randrange(90)))
                                              for _ in range(120)]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)] + [(6, "one", 1, 2)],
                                 "doc_id long, text string, length long, offset int").repartition(3)
    rows = packing.packed(docs, tokenizer_path, window=64).collect()
    _, by_doc = check_packing(rows, 64)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    for r in rows:
        own = ids[r.doc_id]
        assert list(r.ids) == own[r.start:r.start + r.length] and r.doc_tokens == len(own)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for i, own in ids.items():
        assert sum(n for _, n, _ in by_doc[i]) == len(own) * (2 if i == 6 else 1)
    assert packing.packed(docs.limit(0), tokenizer_path).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_the_histogram_with_little_padding(seed):
    rng = random.Random(seed)
    histogram = {}
    for _ in range([3, 50, 400, 5000][seed]):
        n = min(512, max(1, int(rng.expovariate(1 / 60))))
        histogram[n] = histogram.get(n, 0) + rng.choice([1, 1, 40])
    plan = packing.plan(histogram, 512)
    used, tokens, sequences = {}, sum(n * c for n, c in histogram.items()), 0
    for times, slots in plan:
        assert times > 0 and sum(n * u for n, u in slots) <= 512
        sequences += times
        for n, u in slots:
            used[n] = used.get(n, 0) + times * u
    assert used == histogram
    if seed > 1:  # a few lengths may leave no way to fill a sequence
        assert sequences <= 1.01 * tokens / 512 + 2


def test_least_squares_recovers_exact_fillings():
    """200 sequences of three lengths each leave nothing over."""
    plan = packing.plan({100: 200, 150: 200, 250: 200}, 500)
    assert sum(t for t, _ in plan) <= 201


# --- templates ------------------------------------------------------------------------

def page(i, body, host="a.example"):
    return (i, f"http://{host}/{i}", f"<html><head><title>T {i}</title><style>p{{}}</style></head><body class='has-sidebar'>"
            f"<nav><ul><li><a href='/'>Home {i}</a></li></ul></nav><div class=\"ad\">Buy {i}</div>{body}"
            f"<footer>&copy; {i}</footer></body></html>")


def test_extraction(spark):
    pages = [page(i, f"<article><h1>Title&amp;{i}</h1><p>One {i} <b>bo</b>ld<br>two {i}<script>var x='</p>'</script></p>"
                     f"<p>Follow us today</p><!-- hidden --><p>Last\n\t {i} &lt;tag&gt;</p>"
                     f"<section class='comments'><p>Nice!</p></section></article><aside>Side {i}</aside>") for i in range(8)]
    got = {r.page_id: r.text for r in extract(spark, pages)}
    assert got == {i: f"Title&{i} One {i} bold two {i} Last {i} <tag>" for i in range(8)}


def test_extraction_without_articles(spark):
    pages = [page(i, f"<div id='x'><p>Story number {i} is a long one with many words</p></div><div id='y'>Hot {i}</div>"
                     f"<form>Search {i}</form>", "b.example") for i in range(6)]
    assert {r.text for r in extract(spark, pages)} == {f"Story number {i} is a long one with many words" for i in range(6)}


def test_extraction_of_sections_in_one_container(spark):
    body = "<div id='wrap'><div class='content'>{}</div><div class='sidebar'>Side {}</div><div id='x'>Tip {}</div></div>"
    pages = [page(i, body.format("".join(f"<section><p>Part {k} of story {i} goes on</p></section>" for k in range(4)), i, i),
                  "f.example") for i in range(6)]
    assert {r.page_id: r.text for r in extract(spark, pages)} == {
        i: " ".join(f"Part {k} of story {i} goes on" for k in range(4)) for i in range(6)}


def test_extraction_of_odd_pages(spark):
    copy = page(50, "<article><p>A copy</p></article>", "c.example")[2]
    pages = [(i, "http://c.example/x", copy) for i in range(50, 60)]
    pages += [(1, None, None), (2, "http://[bad", ""), (3, "http://d.example/", "plain words &amp; more"),
              (4, "http://d.example/2", "<article><p>cut &am"), (5, "http://d.example/3", "<article>cut <a href='x"),
              (6, "http://d.example/4", "<article>a<!-- no end"), (7, "http://d.example/5", "<article>b<script>no end"),
              (8, "http://d.example/6", "</div></p><article>x</article></article>y"), (8, "http://d.example/6", "z"),
              (9, "http://e.example/", "<article><p>" + "long " * 50_000 + "</p></article>")]
    got = [(r.page_id, r.url, r.text) for r in extract(spark, pages)]
    assert len(got) == len(pages)
    text = {i: t for i, _, t in got if i != 8}
    assert all(text[i] == "A copy" for i in range(50, 60))
    assert [text[i] for i in range(1, 8)] == ["", "", "plain words & more", "cut &am", "cut", "a", "b"]
    assert sorted(t for i, _, t in got if i == 8) == ["x", "z"] and len(text[9]) == 5 * 50_000 - 1
    assert extract(spark, []) == []


@pytest.mark.parametrize("script", [
    "<script>for(i=0;i<n;i++){f(i)}</script>", "<script>var t='<!--'</script>", "<STYLE>a{content:'<b'}</STYLE >",
    "<textarea>a <b</textarea>", "<svg><script>i<n</script></svg>", "<script src='x'/>", "<noscript><p>No <i</noscript>"])
def test_bodies_without_markup_end_with_their_own_tag(script):
    got, _ = template.parse(f"<body>{script}<article>one {script}<p>two</p></article>{script}three</body>")
    assert [b.text for b in got] == ["one", "two", "three"]


@pytest.mark.parametrize("markup, want", [
    ('<p>One <b attr="x>y">bold</b> and <a title=\'2 > 1\' href=x>link</a></p>', ["One bold and link"]),
    ('<p title="open>One</p><p>two</p>', ["One", "two"]), ("<p title=a\"b>One</p><p it's>two</p>", ["One", "two"]),
    ("<p>a <= b</p><p>c < d</p><img alt='>'/>e", ["a <= b", "c < d", "e"]),
    ('<script data-x="a>b" src="y">for(i=0;i<n;i++){}</script><p>One</p>', ["One"]),
    ("<p>Let <math><mi>x</mi> <mo>=</mo> <mn>2</mn><annotation>x=2</annotation></math> hold.</p>", ["Let x = 2 hold."])])
def test_quoted_values_and_formulas(markup, want):
    assert [b.text for b in template.parse(markup)[0]] == want


@pytest.mark.parametrize("name", ["div id='comments'", "section class='user-discussion'", "ol class='comment-list'",
                                  "div class='x comments-area'", "div id=disqus_thread"])
def test_comments_go_however_long(name):
    page = f"<article><p>Short story</p><{name}><p>{'Long talk of readers ' * 40}</p></{name.split()[0]}></article>"
    assert template.main_text(page, (frozenset(), [])) == "Short story"
    assert template.main_text(f"<article><p>Story</p><p class='commentary'>It is {'told ' * 9}</p></article>",
                              (frozenset(), [])) == f"Story It is {'told ' * 9}".rstrip()


def texts(spark, bodies, host="g.example"):
    """Extracted text of each body, as pages of one host."""
    pages = [(i, f"http://{host}/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return [t for _, t in sorted((r.page_id, r.text) for r in extract(spark, pages))]


MIXED = {
    "paragraphs and lists": ("<div class='content'><p>Words of page {i}</p><ul><li>A much longer entry {i}</li><li>B {i}</li></ul></div>",
                             "Words of page {i} A much longer entry {i} B {i}"),
    "unequal sections": ("<div class='c'><section id='intro'><p>Intro of {i} says</p></section><section id='story'>"
                         "<p>Story number {i} is longer than that</p></section></div>",
                         "Intro of {i} says Story number {i} is longer than that"),
    "equal halves": ("<div id='a'><p>One half of {i} x</p></div><div id='b'><p>One half of {i} y</p></div>",
                     "One half of {i} x One half of {i} y"),
    "headline beside": ("<div id='t'><h1>Hi {i}</h1></div><div id='b'><p>The long text of page {i}</p></div>",
                        "Hi {i} The long text of page {i}"),
    "quote": ("<blockquote><p>A quote on {i} that is long</p></blockquote><p>So {i}</p>", "A quote on {i} that is long So {i}"),
}


@pytest.mark.parametrize("case", MIXED)
def test_nothing_beside_the_largest_container_is_lost(spark, case):
    body, text = MIXED[case]
    assert texts(spark, [body.format(i=i) for i in range(6)]) == [text.format(i=i) for i in range(6)]


@pytest.mark.parametrize("name", ["site-content has-sidebar", "content no-sidebar", "layout-sidebar-right", "side-by-side",
                                  "elementor-widget-text-editor", "sidebar", "widget"])
def test_names_are_no_more_than_hints(spark, name):
    body = "<div class='{n}'><p>The story {i} of a page goes on</p><p>Part {i}</p><div class='sidebar-left'>Side {i}, more of it</div></div>"
    assert texts(spark, [body.format(n=name, i=i) for i in range(6)]) == [
        f"The story {i} of a page goes on Part {i}" for i in range(6)]


def test_a_form_around_the_page_is_content():
    page = "<body><form id='aspnetForm'><p>All of the page</p><div class='comments'>Nice</div></form></body>"
    assert template.main_text(page, (frozenset(), [])) == "All of the page"


def test_copies_of_an_article_are_no_template(spark):
    """Five copies that differ in a comment, a script and a link; near copies; copies with an own container on half of the pages."""
    body = "<!-- ad {i} --><script>track({i})</script><nav><a href='/{i}'>Go {i}</a></nav><article><h1>Head line</h1><p>Words of it</p></article>"
    assert texts(spark, [body.format(i=i) for i in range(5)]) == ["Head line Words of it"] * 5
    near = "<article><h1>Head line</h1><p>Words of it that stay</p><p>Visitor {i}</p></article>"
    assert texts(spark, [near.format(i=i) for i in range(5)]) == [f"Head line Words of it that stay Visitor {i}" for i in range(5)]
    half = "<article><blockquote>Quoted words of some length</blockquote><p>No {i}</p></article>"
    other = "<article><p>Another story {i}, and it is much longer than what the others quote from elsewhere</p></article>"
    got = texts(spark, [half.format(i=i) for i in range(5)] + [other.format(i=i) for i in range(5)])
    assert got[:5] == [f"Quoted words of some length No {i}" for i in range(5)]


def test_template_text_is_found_beside_copies(spark):
    body = "<article><p>Story {i} is told here at length</p><p>Follow us</p><!-- {j} --></article>"
    assert texts(spark, [body.format(i=j % 6, j=j) for j in range(12)]) == [
        f"Story {j % 6} is told here at length" for j in range(12)]


def test_ids_of_single_pages_hide_no_template(spark):
    """Pages with classes and ids of their own share their tokens; what goes to the last step does not grow with them."""
    def own(i):
        return "".join("abcdefghij"[int(c)] for c in str(i))
    pages = [(i, f"http://h.example/{i}", f"<html class='t{i}'><body class='postid-{i} {own(i)}'><div class='p-{i}' id='{own(i)}'>"
              f"<article id='post-{i}' class='{own(i)}'><p>Story {i} is told</p><p>Follow us</p></article></div>"
              f"<div class='{own(i)}'><p>Tip</p></div></body></html>") for i in range(120)]
    assert {r.page_id: r.text for r in extract(spark, pages)} == {i: f"Story {i} is told" for i in range(120)}
    rows = spark.createDataFrame([("h", p) for _, _, p in pages], "host string, html string")
    assert template.classes_of(rows).count() <= 2


def test_slots_of_pages_with_own_ids_lose_nothing(spark):
    bodies = [f"<div class='c'><div id='{w}'><p>The long text of {w} here</p></div><div class='c{i}'><ul><li>{w}</li></ul></div></div>"
              "<p>Read more here</p>" for i, w in enumerate(["one", "two", "three", "four", "five"])]
    assert texts(spark, bodies) == [f"The long text of {w} here {w}" for w in ["one", "two", "three", "four", "five"]]


def extract(spark, pages):
    frame = spark.createDataFrame([(*p, "x", 1) for p in pages], "page_id long, url string, html string, text string, host int")
    return template.extract(frame).collect()


# --- top-k ----------------------------------------------------------------------------

def plain_top(rows, queries, k):
    out = []
    for q, v in {i: v for i, v in reversed(queries)}.items():
        scores = sorted((-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in rows if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_rows, k", [(8192, 20), (7, 3), (7, 20)])
def test_top_k_equals_the_plain_version(spark, monkeypatch, block_rows, k):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = random.Random(k)
    rows = [(i, [rng.choice([-2, -1, 0, 1, 2]) / 4 for _ in range(6)]) for i in range(90)]
    rows += [(200, None), (220, [0.5, None, 1.0, 1.0, 1.0, 1.0]), (240, [NAN] + [0.5] * 5), (260, [INF] + [0.5] * 5),
             (280, [0.25, -0.26]), (7, [9.0] * 6), (None, [1.0] * 6), (300, [])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "id long, vector array<float>, score int")
    whole = frame.select("id", topk.quantized("vector").alias("vec"))
    got = topk.top_k(whole, whole.filter("id % 20 = 0"), k).collect()
    clean = [(i, [np.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    assert sorted(map(tuple, got)) == plain_top(clean, [r for r in clean if r[0] % 20 == 0], k)


def test_top_k_of_few_or_huge_rows(spark):
    rows = [(0, [1e300, -3.0]), (20, [2.0, 1e200]), (1, [2.5, 3.0])]
    frame = spark.createDataFrame(rows, "id long, v array<double>").select("id", topk.quantized("v").alias("vec"))
    got = topk.top_k(frame, frame.filter("id % 20 = 0")).collect()
    assert len(got) == 4 and all(-(1 << 63) <= r.score < 1 << 63 for r in got)
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0
    assert topk.top_k(frame, frame.limit(0)).count() == 0
