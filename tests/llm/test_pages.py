from __future__ import annotations

import random

from hypothesis import given
from hypothesis import strategies as st

from quadrante.llm import pages as operator
from quadrante.llm.pages import extract_text, lines_of, main_text, shared_lines

SCHEMA = "page_id long, url string, html string, host string, text string"


def texts(spark, pages):
    rows = spark.createDataFrame([(*p, "h", "t") for p in pages], SCHEMA)
    got = extract_text(rows).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    return sorted(((r["page_id"], r["url"], r["text"]) for r in got), key=str)


def page(article, around="{}"):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body><nav><a>N</a></nav>{around.format(article)}<footer>F</footer></body></html>"


def test_articles(spark):
    html = page(
        "<article><h1>A &amp; B&nbsp;c</h1><p><b>open<br><p>One\n two<p>x &lt; y<script>var t='</p>';</script><ul><li>i<li>j</ul>"
        "<aside>no</aside><form>no</form><div class='user-comments'><p>no</div><p class='lead'>yes</p></article><div class='ad'>no</div>"
    )
    assert texts(spark, [(1, "http://a/x", html), (2, None, None), (3, "::", ""), (None, "http://a/x", "<p>a<p>b")]) == sorted(
        [(1, "http://a/x", "A & B c\n\nopen\n\nOne two\n\nx < y\n\ni\n\nj\n\nyes"), (2, None, ""), (3, "::", ""), (None, "http://a/x", "a\n\nb")], key=str
    )


def test_articles_keep_lines_that_the_pair_shares(spark):
    pages = [(k, f"http://a/en/{k}", page(f"<article><p>Same line<p>Text {k}</article>")) for k in range(4)]
    assert [t for _, _, t in texts(spark, pages)] == [f"Same line\n\nText {k}" for k in range(4)]


def test_difference_finds_the_text_where_no_element_says_so(spark):
    def html(k):
        return f"<body><div>Top</div><div>News</div><div><div>Story {k}</div><div>More {k}</div></div><div>All rights</div></body>"

    pages = [(k, f"http://a/en/{k}", html(k)) for k in range(5)] + [(9, "http://b/", html(9))]
    got = texts(spark, pages)
    assert [t for p, _, t in got if p < 5] == [f"Story {k}\n\nMore {k}" for k in range(5)]
    assert got[-1][2] == "Top\n\nNews\n\nStory 9\n\nMore 9\n\nAll rights"


def test_equal_pages_are_not_emptied(spark):
    pages = [(1, "http://a/", "<div>x</div>"), (1, "http://a/", "<div>x</div>")]
    assert [t for _, _, t in texts(spark, pages)] == ["x", "x"]


def test_long_page_and_empty_table(spark):
    html = "<article>" + "".join(f"<p>word {k}</p>" for k in range(20_000)) + "</article>"
    ((_, _, text),) = texts(spark, [(1, "http://a/", html)])
    assert text.count("\n\n") == 19_999
    assert texts(spark, []) == []


def length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b):
            row[j + 1] = last[j] + 1 if x == y else max(row[j], last[j + 1])
    return row[-1]


@given(st.lists(st.sampled_from("abcd"), max_size=20), st.lists(st.sampled_from("abcd"), max_size=20))
def test_alignment_is_a_longest_common_subsequence(a, b):
    shared = shared_lines(a, b)
    common = [a[k] for k in sorted(shared)]
    rest = iter(b)
    assert all(x in rest for x in common) and len(common) == length(a, b)


def test_alignment_of_long_random_pages():
    rng = random.Random(2)
    a, b = ([rng.randrange(120) for _ in range(400)] for _ in range(2))
    assert len(shared_lines(a, b)) == length(a, b)


def test_marked_lines_go_without_a_pair():
    own = lines_of("<div id='sidebar'>s</div><header>h</header><div role='navigation'>n</div><p hidden>x</p><p>text</p>")
    assert main_text(own, None) == "text"


def test_partitions_do_not_show(spark):
    def html(k):
        return f"<body><div>Top</div><div><div>Story {k}</div></div><div>All rights</div></body>"

    pages = [(k, f"http://a/en/{k:02}", html(k), "h", "t") for k in range(12)] + [(20, "http://b/", html(20), "h", "t")]
    for partitions in (1, 5, 40):
        got = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(pages, SCHEMA), partitions).collect()}
        assert got == {k: f"Story {k}" for k in range(12)} | {20: "Top\n\nStory 20\n\nAll rights"}


def test_wrappers_do_not_mark_the_main_text():
    def text(html):
        return main_text(lines_of(html), None)

    assert text("<div class='layout with-sidebar'><main><p>a</main><div class='sidebar'>s</div></div>") == "a"
    assert text("<div id='search'><article><p>a</article></div>") == "a"
    assert text("<form><div class='site-header'>h</div><main><p>a</main></form>") == "a"
    assert text("<article><header class='entry-header'><h1>Title</h1></header><p>a</article>") == "Title\n\na"
    assert text("<main><p>a</main><aside><article>b</article></aside><div hidden><article>c</article></div>") == "a"
    assert text("<article><p>a</article><div class='related'><article>b</article></div>") == "a"


def test_a_head_left_open_ends_at_the_body():
    for body in ("<body><p>a", "<p>a", "<div>a</div>", "a"):
        assert main_text(lines_of(f"<html><head><title>T</title><meta charset=utf-8>{body}"), None) == "a"


def test_comment_articles_go():
    html = "<article><p>a</article><article class='comment'><p>b</article><article class='post'><p>c<article id='x' class='comment-body odd'>d</article></article>"
    assert main_text(lines_of(html), None) == "a\n\nc"


def test_silent_inline_elements_do_not_cut_a_line():
    for silent in ("<svg/>", "<svg><title>t</title></svg>", "<script>x()</script>", "<button>Go</button>", "<noscript><div>no</div></noscript>"):
        assert main_text(lines_of(f"<main><p>before {silent} after</p><p>next</p></main>"), None) == "before after\n\nnext", silent


def test_controls_left_open_end_at_the_next_block():
    for control in ("<select><option>One<option>Two", "<button>Go"):
        assert main_text(lines_of(f"<main><p>a</p>{control}<p>b</p><h2>c</h2></main>"), None) == "a\n\nb\n\nc", control


def test_names_of_adverts_and_threads_go():
    for name in "ad-slot advert-block post-comments comment-thread disqus_thread comments reply comments-list".split():
        assert main_text(lines_of(f'<main><p>text</p><div class="{name}"><p>other</p></div></main>'), None) == "text", name


def test_the_difference_decides_on_ambiguous_names_in_the_main_text():
    for part in ('<div id="search"><p>{}</p></div>', '<div class="header"><p>{}</p></div>', '<section class="banner"><p>{}</p></section>'):
        own, near, same = (lines_of(f"<article>{part.format(x)}<p>{y}</p></article>") for x, y in (("Intro", "text"), ("Other", "words"), ("Intro", "words")))
        assert main_text(own, near) == "Intro\n\ntext" and main_text(own, same) == "text" and main_text(own, None) == "text"


def test_pages_cross_the_shuffle_packed(spark, monkeypatch):
    moved, store = [], operator.stored
    monkeypatch.setattr(operator, "stored", lambda df: moved.append(df) or store(df))
    odd = [(1, "http://a/1", None), (2, "http://a/2", ""), (2, "http://a/2", "<main>é\x00 日本 &amp;</main>"), (None, None, page("<article>x</article>") * 50)]
    got = texts(spark, odd)
    assert [t for _, _, t in got] == ["", "", "é\x00 日本 &", got[-1][2]] and "x" in got[-1][2]
    shuffled = moved[0]._jdf.queryExecution().analyzed().children().head().schema().simpleString()
    assert "html:binary" in shuffled  # the page itself before
    html = page("<article>x</article>") * 50
    assert operator._unpacked(operator._packed(html)) == html and len(operator._packed(html)) < len(html) / 10
