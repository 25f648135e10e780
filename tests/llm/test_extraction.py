"""Main-text extraction from pages that differ in one thing only."""

import math
import os
import random

import pytest

from tunetable.llm import html_extraction
from tunetable.llm.html_extraction import extract

A = "The first long paragraph tells, with some commas, what happened in the town, and why it did so. " * 3
B = "A second one goes on, names people, places and dates, and closes the matter for good. " * 4
WORDS = [A.strip(), B.strip()]


def page(mark, body):
    return (
        f"<body><div class=top><a href=/>Home</a> <a href=/a>About</a></div><{mark}>{body}</{mark}>"
        "<div class=low>All rights kept</div></body>"
    )


BODIES = [
    (f"<h1>Title</h1><p>{A}</p><h2>Part</h2><p>{B}</p><p>Short.</p>", ["Title", A, "Part", B, "Short."]),
    (f"<h1>Title</h1><p>{A}</p><ul><li>one<li>two</ul><p>{B}</p>", ["Title", A, "one", "two", B]),
    (f"<p>{A}</p><div class=offer>Buy this lamp now</div><p>{B}</p>", [A, B]),
    (f"<p>{A}</p><div class=x><a href=1>Post</a> <a href=2>Send</a></div><p>{B}</p>", [A, B]),
    (f"<p>{A}</p><p>{B}</p><div class=card><h3>Other story</h3><p>Read it</p></div>", [A, B]),
    (f"<div class=t><h1>Title</h1></div><div class=b><p>{A}</p><p>{B}</p></div>", ["Title", A, B]),
    (f"<h1>Title</h1><table><tr><th>Year<td>1900</table><p>{A}</p><p>{B}</p>", ["Title", "Year", "1900", A, B]),
]


@pytest.mark.parametrize("mark", ["div", "article", "main"])
@pytest.mark.parametrize("body, parts", BODIES)
def test_the_mark_alone_neither_keeps_nor_drops(mark, body, parts):
    assert extract(page(mark, body)).split("\n") == [part.strip() for part in parts]


def test_text_beside_a_small_article_card_stays():
    card = "<article class=card><h3>Other story</h3><p>Read it today</p></article>"
    assert extract(f"<body><div class=c><p>{A}</p><p>{B}</p></div>{card}</body>").split("\n") == WORDS


@pytest.mark.parametrize("mark", ["div", "article"])
def test_long_text_with_many_links_stays(mark):
    linked = f"<p class=sources><a href=1>{A}{A}</a>{B}</p>"
    got = extract(page(mark, f"<p>{A}</p>{linked}<p>{B}</p>"))
    assert got.split("\n") == [A.strip(), (A + A + B).strip(), B.strip()]


SHELLS = [
    "<div class='content-sidebar-wrap'><main><article>{}</article></main></div>",
    "<div class='layout-sidebar'>{}</div>",
    "<div class='content-sidebar-wrap'><div class=entry>{}</div></div>",
    "<div id='main-widget'>{}</div>",
    "<form id=aspnetForm><input type=hidden><div class=c>{}</div><select><option>One</select></form>",
    "<form><main>{}</main><button>Send</button></form>",
    "<div class=widget><article>{}</article></div>",
]


@pytest.mark.parametrize("shell", SHELLS)
@pytest.mark.parametrize("rest", ["", "<div class=low>All rights are kept, and so on, by us.</div>"])
def test_a_name_around_the_article_does_not_drop_it(shell, rest):
    body = f"<p>{A}</p><div class=ad>Buy this lamp, now.</div><p>{B}</p>"
    assert extract(f"<body>{shell.format(body)}{rest}</body>").split("\n") == WORDS


@pytest.mark.parametrize("name", ["ad-free", "related-work", "cookie-recipe"])
@pytest.mark.parametrize("mark", ["div", "article"])
def test_a_listed_word_among_others_keeps_a_paragraph(mark, name):
    got = extract(page(mark, f"<p>{A}</p><p class={name}>{B}</p><p>{A}</p>"))
    assert got.split("\n") == [A.strip(), B.strip(), A.strip()]
    got = extract(page(mark, f"<p>{A} <span class={name}>then</span> {B}</p>"))
    assert got == f"{A.strip()} then {B.strip()}"


@pytest.mark.parametrize("mark", ["div", "article"])
def test_other_parts_stay_out_however_long(mark):
    comments = f"<div id=comments><h3>Comments</h3>{f'<div class=comment><p>{B}</p></div>' * 20}</div>"
    related = f"<div class=related-posts>{f'<article><h3>Other</h3><p>{A[:90]}</p></article>' * 5}</div>"
    body = f"<h2 id=related>Related</h2><p>{A}</p><p>{B} <a class=share href='/'>Share</a></p>"
    got = extract(page(mark, body).replace("</body>", f"{comments}{related}</body>"))
    assert got.split("\n") == ["Related", *WORDS]


@pytest.mark.parametrize("mark", ["div", "article"])
@pytest.mark.parametrize("stray", ["</3>", "</>", "</ p>", "</é>", "</3 x>", "<!-->", "<!--->", "<!-- x --!>"])
def test_a_stray_end_tag_or_comment_hides_itself_only(mark, stray):
    got = extract(page(mark, f"<p>{A}{stray}then</p><p>{B}</p>"))
    assert got.split("\n") == [f"{A}then", B.strip()]


@pytest.mark.parametrize("mark", ["div", "article"])
def test_less_than_before_a_letter_of_no_tag_is_text(mark):
    got = extract(page(mark, f"<p>{A}1 <été </p><p>{B}</p>"))
    assert got.split("\n") == [f"{A}1 <été", B.strip()]


def test_a_page_that_stops_within_a_tag():
    for cut in ("</3 no end", "</p", "<a href=x"):
        assert extract(f"<body><p>{A}</p><p>{B}{cut}") == "\n".join(WORDS)
    assert extract(f"<body><p>{A}</") == f"{A}</"


def test_smoothing_takes_all_paths_at_every_size():
    rng = random.Random(3)
    paths = {tuple(rng.choice("abc") for _ in range(rng.randint(0, 40))) for _ in range(600)}
    paths |= {("a",) * n for n in range(41)} | {("a",) * 5 + (f"p.{i}",) for i in range(300)}
    paths = sorted(paths)
    rows = [(rng.random() * 500, rng.random() * 9) for _ in paths]
    factors = [rng.choice([1.0, 0.7, 0.05]) for _ in paths]
    root, nodes = html_extraction.Path(), []
    for path in paths:
        nodes.append(root)
        for label in path:
            nodes[-1] = nodes[-1].child(label)
    got = html_extraction._smoothed(nodes, rows, factors)
    for i, path in enumerate(paths):
        total = [0.0, 0.0, 0.0]
        for j, other in enumerate(paths):
            apart = max(len(path), len(other)) - len(os.path.commonprefix([path, other]))
            weight = math.exp(-apart * apart) * (1.0 if i == j else factors[j])
            for k, x in enumerate((1.0, *rows[j])):
                total[k] += weight * x
        assert got[i] == pytest.approx((total[1] / total[0], total[2] / total[0]), rel=1e-9)


@pytest.mark.parametrize("label", ["", "id=p{}", "class=p{}"])
@pytest.mark.parametrize("count", [50, 399, 401, 1500])
def test_short_paragraphs_stay_at_any_size(label, count):
    """Names sort so that the short ones are each other's neighbours."""
    texts = ["Short one." if i >= count - 30 else A[:99].strip() for i in range(count)]
    order = random.Random(count).sample(range(count), count)
    body = "".join(f"<p {label.format(f'{i:05}')}>{texts[i]}</p>" for i in order)
    assert extract(f"<body><div>{body}</div></body>").split("\n") == [texts[i] for i in order]


@pytest.mark.parametrize("depth", [0, 10, 195, 210, 1000, 20000])
def test_wrappers_of_any_depth_change_nothing(depth):
    inner = f"<div><p>{A}</p><p>{B}</p></div><div class=offer><div>Buy now</div><div>Cheap</div></div>"
    got = extract("<body>" + "<div>" * depth + inner + "</div>" * depth + "</body>")
    assert got.split("\n") == WORDS


FORMS = [
    "<form><p>Get our weekly letter, for free, by mail.</p><label>Mail</label><input><button>Go</button></form>",
    "<form class=entry><h3>Ask us</h3><ul><li>One</li><li>Two</li></ul><textarea>Say</textarea></form>",
    "<form><fieldset><legend>Vote</legend><table><tr><td>Yes<td>No</table></fieldset></form>",
    f"<form><p>{'Terms apply to all who send this, and to their heirs. ' * 8}</p></form>",
]


@pytest.mark.parametrize("mark", ["div", "article", "main"])
@pytest.mark.parametrize("form", FORMS)
def test_a_form_goes_with_its_labels(mark, form):
    got = extract(page(mark, f"<h1>Title</h1><p>{A}</p><p>{B}</p>{form}<p>{A}</p>"))
    assert got.split("\n") == ["Title", *WORDS, A.strip()]


def test_a_form_around_the_marked_article_stays_beside_longer_talk():
    talk = f"<div class=comments>{'<p>' + B + A + '</p>'}{'<p>' + B + A + '</p>'}</div>"
    got = extract(f"<body><form><article><p>{A}</p><p>{B}</p></article></form>{talk}</body>")
    assert got.split("\n") == WORDS


def test_formulas_are_text_without_their_source():
    formula = (
        "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow>"
        "<annotation encoding='application/x-tex'>x = {2}</annotation></semantics></math>"
    )
    got = extract(page("article", f"<p>{A}</p><p>Where {formula} holds, the sum is finite. {B}</p>"))
    assert got.split("\n") == [A.strip(), f"Where x=2 holds, the sum is finite. {B}".strip()]
