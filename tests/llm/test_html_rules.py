"""The block rules: what each pass carries, linear scanning, attributes, and pages without article markup."""

import re
import time
from html import unescape

import pytest
from larkspur.llm import html_text

SENTENCE = "This is the story of a town that was built by the river, and of the people who have lived in it for long. "


def article_of(html):
    """The planted article of a test page, by another way: cut at the article element, split at paragraphs."""
    own = re.search(r"<article>(.*?)(</article>|$)", html, re.S)[1]
    parts = (" ".join(unescape(re.sub(r"</?b>|<br>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", own))
    return [x for x in parts if x]


def without_article(html):
    return html.replace("<article>", "<div>").replace("</article>", "</div>")


def without_names(html):
    return re.sub(r' class="[^"]*"', "", without_article(html)).replace("<nav>", "<div>").replace("</nav>", "</div>").replace("<footer>", "<div>").replace("</footer>", "</div>")


@pytest.mark.parametrize("strip", [without_article, without_names])
def test_pages_without_article_markup(spark, strip):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    right = sum(html_text.main_text(strip(p.html)) == "\n".join(article_of(p.html)) for p in pages)
    assert right >= 0.95 * len(pages)


def test_stop_words_carry_the_first_pass():
    words = "kettle copper lantern marble walnut velvet orchid canyon timber saddle " * 4
    page = f"<div><p>{SENTENCE * 2}</p><div>{words}</div><p>{SENTENCE * 2}</p></div>"
    assert words.strip() not in html_text.main_text(page)
    assert words.strip() in html_text.main_text(page, frozenset())


def test_the_second_pass_carries_short_blocks(spark, monkeypatch):
    pages = [without_names(p.html) for p in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    whole = [html_text.main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "inherit", lambda blocks: [b.label == html_text.GOOD for b in blocks])
    assert sum(html_text.main_text(p) == t for p, t in zip(pages, whole, strict=True)) < 0.2 * len(pages)
    monkeypatch.setattr(html_text, "inherit", lambda blocks: [b.label != html_text.BAD for b in blocks])
    assert sum(html_text.main_text(p) == t for p, t in zip(pages, whole, strict=True)) < 0.8 * len(pages)


@pytest.mark.parametrize("piece", ["<a ", "<div></p>", "<p a='x", "<!", "</", "<é", "<p title=\"x", "<script>", "<select>", "&", "<"])
def test_scanning_is_linear(piece):
    page = piece * (1_000_000 // len(piece.encode()))
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 3


def test_attributes():
    text = html_text.main_text(f"<p data-x=rock'n>One. {SENTENCE}</p><p title=it's>Two. {SENTENCE}</p><p alt=\"a>b\">Three's. {SENTENCE}</p><p class>Four. {SENTENCE}</p>")
    assert [t.split()[0] for t in text.split("\n")] == ["One.", "Two.", "Three's.", "Four."]
    assert html_text.main_text(f'<p title="open>{SENTENCE}</p>') == SENTENCE.strip()


@pytest.mark.parametrize("name", ["class='tags-intro'", "class='content share'", "id='search-results'", "class='advertisers-guide'"])
def test_one_word_of_a_name_is_not_enough(name):
    inner = SENTENCE * 2
    assert html_text.main_text(f"<div {name}><p>{inner}</p></div>") == inner.strip()


@pytest.mark.parametrize("name", ["class='sidebar'", "id='comments'", "class='post-comments'", "class='cookie-notice'", "class=ad-slot-3", "role=navigation", "class='widget widget-area'"])
def test_named_boilerplate_goes(name):
    inner = SENTENCE * 2
    assert html_text.main_text(f"<article><p>{inner}</p><div {name}><p>Reply: {inner}</p></div></article>") == inner.strip()


def test_other_scripts_and_unknown_languages():
    chinese = "这是一个关于城市和河流的故事,在那里人们的生活是安静的,他们也为了土地而工作。" * 6
    russian = "Это история о городе, который был построен на реке, и о людях, которые жили в нем, не зная других мест. " * 3
    other = "Hau herri bati buruzko istorioa da, ibai baten ondoan eraikia, eta bertan bizi izan den jendeari buruzkoa. " * 3
    for text in (chinese, russian, other):
        assert html_text.main_text(f"<div><a href=x>abc</a></div><div><div>{text}</div></div>") == text.strip()


def test_a_sentence_that_is_a_link_stays_in_its_article():
    page = f"<article><p>{SENTENCE * 2}</p><p><a href=x>The whole of this sentence is a link to the source of it.</a></p><p>{SENTENCE * 2}</p></article>"
    assert len(html_text.main_text(page).split("\n")) == 3


def test_a_form_around_the_page():
    assert html_text.main_text(f"<form><div><main><p>{SENTENCE * 2}</p></main></div></form>") == (SENTENCE * 2).strip()


def test_short_pages():
    assert html_text.main_text("<p>Hello there</p>") == "Hello there"
    assert html_text.main_text("<nav><a>x</a></nav><article><h1>Title</h1>Some text</article>") == "Title\nSome text"
    assert html_text.main_text("a &lt;b&gt; c &am<b>p;</b>") == "a <b> c &amp;"


def test_long_page_in_one_text():
    page = "<article>" + f"<p>{SENTENCE * 2}</p>" * 10_000 + "</article>"
    assert html_text.main_text(page).count("\n") == 9_999


LONG = f"<p>{SENTENCE * 3}</p>"


def test_teasers_of_other_articles_go():
    page = f"<article>{LONG}<h2>Part</h2>{LONG}</article><article class='teaser'><h3>Other</h3><p>Short teaser text here.</p></article>"
    kept = html_text.main_text(page)
    assert "Part" in kept and "Other" not in kept and "teaser" not in kept
    alone = "<article><h3>Own</h3><p>A note that is short.</p></article>"
    assert html_text.main_text(alone) == "Own\nA note that is short."


@pytest.mark.parametrize("hidden", ["hidden", "class=x hidden", "hidden=''", "aria-hidden='true'", "style='color:red; display: none'", 'style="VISIBILITY:hidden"'])
def test_hidden_parts_go(hidden):
    page = f"<body>{LONG}<div {hidden}><p>{SENTENCE * 2} unseen</p></div><p>{SENTENCE * 2}<span {hidden}>unseen</span> end.</p></body>"
    kept = html_text.main_text(page)
    assert "unseen" not in kept and kept.endswith(" end.") and kept.count("\n") == 1


@pytest.mark.parametrize("shown", ["data-x='hidden'", "class='hidden-gem story'", "aria-hidden='false'", "data-hidden=1", "style='display:block'", "title='a hidden thing'"])
def test_shown_parts_stay(shown):
    assert html_text.main_text(f"<body>{LONG}<div {shown}><p>{SENTENCE * 2} seen</p></div></body>").endswith("seen")
