import pytest

from firegrid.llm.html import extract, main_text

TEXT = "The cat of the house and the dog of the garden were in it for as long as they had been there with all of the others."


def test_parts_that_are_no_article():
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><nav><a href=/>The home of the site</a></nav>"
        f"<header>{TEXT}</header><div class='cookie-notice'><p>{TEXT}</p></div><aside>{TEXT}</aside>"
        f"<article><h1>Head &amp; line</h1><p>{TEXT}<p>Short.<script>var a='<p>no</p>'</script><p>A&nbsp;b\n\t c<br>d"
        f"<div class=comments><p>{TEXT}</p></div></article><form>{TEXT}</form><footer>{TEXT}</footer>"
    )
    assert extract(page) == f"Head & line\n\n{TEXT}\n\nShort.\n\nA b c d"


def test_ambiguous_blocks_take_the_nearest_label():
    links = "".join(f"<p><a href=/{i}>of the and to link {i}</a></p>" for i in range(3))
    page = f"<div>{links}<p>near the links</p>{links}<p>{TEXT}</p><p>near the text</p><p>{TEXT}</p></div>"
    assert extract(page) == f"{TEXT}\n\nnear the text\n\n{TEXT}"


@pytest.mark.parametrize("name", ["layout has-sidebar", "sticky-header site", "no-ads", "side-by-side", "sidebar", "header"])
def test_wrappers_of_the_article_are_kept(name):
    page = f"<body><p>Hello.</p><div class='{name}'><article><p>{TEXT}</p><div class=share-box>{TEXT}</div></article></div></body>"
    assert extract(page) == TEXT
    if "-" in name:
        assert extract(f"<div class='{name}'><p>{TEXT}</p></div>") == TEXT


def test_wrapped_articles_beside_the_page_s_own_are_dropped():
    other = f"<article><p>{TEXT} Other.</p></article>" * 3
    for name in ("sidebar", "site-footer", "comments", "ad-slot-2"):
        assert extract(f"<article><p>{TEXT}</p></article><div class='{name}'>{other}</div>") == TEXT
    assert extract(f"<div><p>{TEXT}</p></div><div id=comments>{other}</div>") == TEXT


def test_other_languages_and_code_outside_articles():
    own = ["Bu sayfada hiçbir listede olmayan bir dilde yazılmış uzun bir metin vardır ve kaybolmamalıdır.", "日本語の文章は空白で区切られない。" * 6]
    for text in own:
        assert extract(f"<div><h1>Kısa</h1><p>{text}</p><p><a href=/>{text}</a></p></div>") == f"Kısa\n\n{text}"
    code = "for i in range(10): print(i) # " + "x = f(y) + g(z); " * 6
    assert extract(f"<div><p>{TEXT}</p><pre>{code}</pre><p>{TEXT}</p></div>") == f"{TEXT}\n\n{code.strip()}\n\n{TEXT}"


def test_odd_markup():
    assert extract("") == "" and extract("<") == "" and extract("<!-- open") == "" and extract("<script>x") == ""
    assert extract(f"<article><p>{TEXT} 1 < 2 &lt;b&gt; <b title='a>b'>bold") == f"{TEXT} 1 < 2 <b> bold"
    assert extract("<article><p>Be.</p></article>") == "Be."
    deep = "<div>" * 3000 + TEXT
    assert extract(deep) == TEXT


def test_frame(spark):
    rows = [(1, "u", f"<article><p>{TEXT}</p></article>", 5), (2, None, None, 6), (None, "v", "", 7), (1, "u", f"<article><p>{TEXT}</p></article>", 5)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = main_text(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted((str(r["page_id"]), r["text"], r["n_chars"]) for r in got.collect()) == sorted(
        [("1", TEXT, len(TEXT)), ("2", "", 0), ("None", "", 0), ("1", TEXT, len(TEXT))]
    )
    assert main_text(frame.limit(0)).count() == 0
