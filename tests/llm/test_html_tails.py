"""Text after self-closed, custom and unclosed elements stays, and inline elements stay in their block."""

import pytest

from sparloom.llm import htmltext


def texts(page):
    return [t for _, t, _ in htmltext.parse(page).runs]


@pytest.mark.parametrize(
    "element",
    ["<svg class='i' />", "<math/>", "<video-player>", "<button-group>", "<title-bar>", "<video src='a>b'>", "<iframe src=x />", "<canvas>", "<object data=x>", "<svg-icon></svg-icon>"],
)
def test_the_rest_of_the_page_stays(element):
    assert texts(f"<p>before</p>{element}<p>after</p><p>last</p>") == ["before", "after", "last"]


def test_raw_elements_go_with_their_text():
    assert texts("<p>a</p><SCRIPT>x < y </p></script ><p>b<svg><text>no</text></svg></p><button>no</button><p>c</p><style>no") == ["a", "b", "c"]
    assert texts("<video>no</video><p>a</p><video><p>b</p>" + "<button>" * 3 + "c") == ["a", "b", "c"]


def test_classed_inline_elements_stay_in_their_sentence():
    page = "<p>One <span class='text'>two</span> and <a class=\"tag\" href='#'>three</a> four.</p>"
    assert texts(page) == ["One two and three four."]
    assert htmltext.parse(page).tags == ["html", "p"]


@pytest.mark.parametrize(
    "inside, said",
    [
        ("foo <ruby>K<rt>k</rt></ruby> baz", "foo Kk baz"), ("a <output>1</output> b", "a 1 b"), ("a <nobr>b c</nobr> d", "a b c d"), ("a<picture><img src=x></picture>b", "a b"), ("a <my-icon>i</my-icon> b", "a i b"),
        ("un<wbr>break", "unbreak"), ("a<math><mi>x</mi><mo>+</mo></math>b", "ax+b"), ("a<math />b", "ab"), ("<x-y>one <b>two</b></x-y> three", "one two three"), ("a <progress>50%</progress> b", "a 50% b"),
    ],
)
def test_a_sentence_is_one_block(inside, said):
    assert texts(f"<p>{inside}</p><p>next</p>") == [said, "next"]


def test_fallback_text_is_for_the_trees_to_judge():
    p = htmltext.parse("<object data=x><p>fallback</p></object><noscript>other <b>text</b></noscript><p>c</p>")
    assert [t for _, t, _ in p.runs] == ["fallback", "other text", "c"]
    assert p.tags == ["html", "object", "p", "noscript", "p"] and p.parents == [-1, 0, 1, 0, 0]


def test_elements_of_other_names_that_hold_blocks_are_blocks():
    p = htmltext.parse("<div>before <my-card class='advert'>buy <i>now</i><p>more</p>still</my-card> after</div><x-app><main><p>text")
    assert [(p.tags[o], t) for o, t, _ in p.runs] == [("div", "before"), ("my-card", "buy now"), ("p", "more"), ("my-card", "still"), ("div", "after"), ("p", "text")]
    card = p.tags.index("my-card")
    assert p.hints[card] == {list(htmltext.HINTS).index("ad")} and p.tags[p.parents[card]] == "div"
    assert p.tags[-3:] == ["x-app", "main", "p"] and p.parents[-2] == len(p.tags) - 3
    nested = htmltext.parse("<a-b>1<c-d>2<p>3</p></c-d>4</a-b>5")
    assert [(nested.tags[o], t) for o, t, _ in nested.runs] == [("a-b", "1"), ("c-d", "2"), ("p", "3"), ("a-b", "4"), ("html", "5")]
