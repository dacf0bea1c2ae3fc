"""HTML extraction and chat formatting."""

import re
from html import unescape

import numpy as np
import pytest

from larkspur.llm import chat, html_text
from larkspur.llm.queries import QUERIES

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header class="site-header"><a href=/>Home</a> <p>Site name of the thing</p></header>
<div class="menu"><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div>
<div id="cookie-notice"><p>We use cookies and the rest of it to be of use to you on this site.</p></div>
<main><article><header><h1>The title &amp; more</h1></header>
<p>First   paragraph of the&nbsp;article, with a <a href=x>link</a> and
some more words in it to be long enough for the rules.</p><p>Short.</p>
<blockquote>Quoted</blockquote><div class="share">Share this on the web</div>
<ul><li>first item</li><li>second item</li></ul><script>var x = "<p>no</p>";</script><form><p>Enter the name of the user</p></form>
<p>Last<br>line</p></article>
<section class="comments"><p>I think that this is the best article of all, and it was a joy to read.</p></section></main>
<aside><p>See also the other pages of this site for more of the same.</p></aside>
<footer>&copy; 2024 the owners of the site</footer></body></html>"""


def test_boilerplate_goes_and_content_stays():
    assert html_text.main_text(PAGE).split("\n") == [
        "The title & more",
        "First paragraph of the article, with a link and some more words in it to be long enough for the rules.",
        "Short.", "Quoted", "first item", "second item", "Last line",
    ]


def test_pages_without_an_article_element():
    body = "".join(f"<p>This is the paragraph {i} of a text that is long enough to be taken for what it is by the rules.</p>" for i in range(4))
    page = f"<div class=nav><a href=1>x</a></div><h2>Heading</h2>{body}<p>ok</p>{body}<div>© me</div>"
    got = html_text.main_text(page).split("\n")
    assert got[0] == "Heading" and "ok" in got and len(got) == 10


def test_pages_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = {r.page_id: r for r in html_text.extract_pages(pages).collect()}
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", p.html, re.S)[1]
        parts = (" ".join(unescape(re.sub(r"</?b>|<br>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
        want = "\n".join(x for x in parts if x)
        assert rows[p.page_id].text == want and rows[p.page_id].n_chars == len(want)


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p unclosed"), (4, "u", "<!-- never closed <p>x</p>"), (5, "u", "<p>" * 5000 + "the end of it"), (5, "u", "plain text")]
    got = html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 6 and [r.text for r in got if r.page_id in (1, 2, 4)] == ["", "", ""]
    assert html_text.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_roles_are_recovered(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    got = chat.format_chats(rows).collect()
    assert len(got) == rows.count()
    held = [r for r in got if r.held_out]
    assert len(held) > 0.2 * len(got) and sum(r.role == r.role_pred for r in held) / len(held) > 0.9
    assert all(r.rendered.startswith(f"<|{r.role_pred}|>\n") and r.rendered.endswith("\n<|end|>\n") for r in got)


def test_chunked_viterbi_scores_like_the_whole(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 16)
    rng = np.random.default_rng(2)
    rows = [(1 if rng.random() < 0.8 else None, i, str(rng.choice(["user", "assistant"])), "x" * int(rng.integers(1, 300))) for i in range(400)]
    turns = chat.observed(chat.ordered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).persist()
    model = chat.train(turns)
    got = chat.recover_roles(turns, model).toPandas()
    for own in (got["conv_id"] == 1, got["conv_id"].isna()):
        pos = got[own].sort_values("pos")
        every = turns.toPandas().set_index(turns.toPandas()["conv_id"].fillna(-1)).loc[1 if own[got.index[own][0]] and pos["conv_id"].notna().all() else -1].sort_values("pos")
        e = model.scores({f: every[f].to_numpy() for f in chat.FEATURES})

        def score(path, e=e):
            return model.start[path[0]] + sum(model.step[a, b] for a, b in zip(path, path[1:])) + sum(e[i, s] for i, s in enumerate(path))

        path = [chat.ROLES.index(r) for r in pos["role_pred"]]
        assert abs(score(path) - score(chat.best_path(model, e, None, None).tolist())) < 1e-6


def test_transcripts_with_markers(spark):
    raw = spark.createDataFrame([(1, "System: be kind\nUser: hello\nhow are you?\nAssistant: fine\n\nthanks\n### Human: ok"), (2, None), (3, "no marker")], "conv_id long, text string")
    model = chat.RoleModel({}, {}, {})
    rows = sorted(chat.format_chats(chat.transcript_turns(raw), model).collect(), key=lambda r: (r.conv_id, r.turn))
    assert [r.role_pred for r in rows if r.conv_id == 1] == ["system", "user", "assistant", "user"]
    assert rows[1].rendered == "<|user|>\nhello\nhow are you?\n<|end|>\n"


def test_odd_turns(spark):
    rows = [(None, None, None, None), (1, None, "user", ""), (1, 1, "tool", "x"), (1, 1, "tool", "x")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == 4
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_steps_across_chunks_count(spark, monkeypatch):
    monkeypatch.setattr(chat, "CHUNK", 4)
    rows = [(1, i, "user" if i % 4 else "assistant", "x") for i in range(40)]
    model = chat.train(chat.observed(chat.ordered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    user, assistant = chat.ROLES.index("user"), chat.ROLES.index("assistant")
    assert np.isclose(np.exp(model.step[user, assistant]), 10 / (29 + 3)) and np.isclose(np.exp(model.step[assistant, user]), 11 / (10 + 3))


def test_marker_emissions_are_probabilities_that_turns_can_change():
    plain = chat.RoleModel({}, {}, {})
    assert np.allclose(np.exp(plain.emit["marker"]).sum(0), 1)
    turned = chat.RoleModel({}, {}, {("marker", "assistant", 2): 10_000})  # a corpus whose assistants sign as users
    assert turned.emit["marker"][2].argmax() == chat.ROLES.index("assistant")


def test_transcripts_of_the_table_are_recovered(spark, sf):
    """The turns of each conversation joined to one transcript with markers, cut again and their roles recovered."""
    names = {"system": "System:", "user": "### Human\n", "assistant": "**Assistant**: "}
    turns = sorted(((r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()))
    joined, roles = {}, {}
    for c, _, role, text in turns:
        joined[c] = joined.get(c, "") + f"{names[role]} {text}\n"
        roles.setdefault(c, []).append((role, text))
    raw = spark.createDataFrame(sorted(joined.items()), "conv_id long, text string")
    got = {}
    for r in sorted(chat.format_chats(chat.transcript_turns(raw), chat.RoleModel({}, {}, {})).collect(), key=lambda r: (r.conv_id, r.turn)):
        got.setdefault(r.conv_id, []).append(r)
    right = sum(len(got[c]) == len(want) and all(g.role_pred == role and g.rendered == f"<|{role}|>\n{text.strip()}\n<|end|>\n" for g, (role, text) in zip(got[c], want)) for c, want in roles.items())
    assert right >= 0.99 * len(roles)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_untagged_turns_keep_their_text(spark, monkeypatch, broadcast):
    """What looks like a marker is text where the conversation has no markers, or where it names another role."""
    monkeypatch.setattr(chat, "BROADCAST_CONVERSATIONS", broadcast)
    plain = ["Context\nThe rest of it", "Answer\n42 is it", "well, that is all I know", "and so on", "what else?", "A: yes"]
    rows = [(1, i, None, t) for i, t in enumerate(plain)] + [(2, 0, None, "Question\none turn alone")]
    rows += [(3, i, None, t) for i, t in enumerate(["User: hello there", "Assistant: hi", "User: and now?", "Assistant: nothing"])] + [(None, 0, None, "A: no id"), (None, 1, None, "")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chat.RoleModel({}, {}, {})).collect()
    said = {(r.conv_id, r.turn): r.rendered.split("\n", 1)[1].removesuffix("\n<|end|>\n") for r in got}
    assert [said[1, i] for i in range(6)] == plain and said[2, 0] == rows[6][3] and said[None, 0] == "A: no id"
    assert [said[3, i] for i in range(4)] == ["hello there", "hi", "and now?", "nothing"]


def test_the_table_s_turns_come_back_unchanged(spark):
    rows = {(r.conv_id, r.turn): r.text for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()}
    for r in QUERIES["op6_chat_format"](spark, "/root/testdata/sf0.001").collect():
        assert r.rendered == f"<|{r.role_pred}|>\n{rows[r.conv_id, r.turn].strip()}\n<|end|>\n"
