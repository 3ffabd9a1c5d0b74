"""Extraction from pages that the given table does not hold."""

import pytest

from caregap.llm.html_text import main_text


@pytest.mark.parametrize("tag", ["svg", "math", "iframe", "object"])
def test_self_closed_elements_end_at_once(tag):
    page = f'<article><p>a</p><{tag} class="i" /><p>text behind</p><{tag} src=\'x\'>inner</{tag}><p>end</p></article>'
    assert main_text(page) == "a\ntext behind\nend"
    assert main_text(f"<article><p>a</p><{tag} class='i'><p>no end tag</p></article>") == "a\nno end tag"


def test_raw_text_is_never_markup():
    page = "<article><p>a</p><script src='x' />var b = '<p>no</p>';</script><p>c</p><style>p {} <p>no</p>"
    assert main_text(page) == "a\nc"


def test_many_elements_without_an_end():
    assert main_text("<article>" + "<button>x " * 20_000 + "</article>").count("x") == 20_000


TEXT = "It is said that the river was high in the spring and that all of the fields by it had been under water for weeks."
TEASERS = "".join(f'<article class="card"><h3>Teaser {k}</h3><p>Short words {k}</p></article>' for k in range(5))


@pytest.mark.parametrize("around", ["<main>{}</main>", '<div class="content">{}</div>', "{}"])
@pytest.mark.parametrize("order", [0, 1])
def test_teasers_do_not_replace_the_text(around, order):
    """Teaser cards that are articles, beside the text or inside its main element."""
    paragraphs = [f"{TEXT} Part {k}." for k in range(6)]
    text = "".join(f"<p>{p}</p>" for p in paragraphs)
    parts = (around.format(text), TEASERS) if order else (TEASERS, around.format(text))
    assert [b for b in main_text("<body>" + "".join(parts) + "</body>").split("\n") if "Part" in b] == paragraphs
    inside = main_text("<body>" + around.format(TEASERS + text) + "</body>")
    assert [b for b in inside.split("\n") if "Part" in b] == paragraphs


def test_text_outside_an_article_stays():
    page = f"<div><p>{TEXT} Lead.</p></div><article><p>{TEXT}</p><p>short</p></article>"
    assert main_text(page) == f"{TEXT} Lead.\n{TEXT}\nshort"


def test_link_rich_items_of_the_article_stay():
    items = "".join(f'<li><a href="/{k}">Linked name number {k}</a> and more</li>' for k in range(4))
    got = main_text(f"<nav><ul>{items}</ul></nav><article><p>{TEXT}</p><ul>{items}</ul><p>Short end</p></article>")
    assert got.split("\n") == [TEXT, *(f"Linked name number {k} and more" for k in range(4)), "Short end"]


OTHER = {
    "Italian": "Nel corso degli anni il villaggio crebbe fino a diventare una piccola città, con mercati, scuole e officine lungo la riva.",
    "Dutch": "De rivier stond dat voorjaar zo hoog dat alle velden langs het water wekenlang onder water bleven staan, zei de boer.",
    "Polish": "Wiosną rzeka była tak wysoka, że wszystkie pola nad wodą stały zalane przez wiele tygodni, jak mówili rolnicy.",
    "Russian": "Весной река поднялась так высоко, что все поля у воды стояли залитыми много недель, как говорили крестьяне.",
    "Chinese": "春天河水很高，河边所有的田地被水淹没了好几个星期，农民们只好等到夏天才能重新开始播种。",
}


@pytest.mark.parametrize("language", OTHER)
def test_languages_without_stop_words(language):
    """No article and no main: length and link density decide, menus stay out."""
    menu = "".join(f'<li><a href="/{k}">{OTHER[language]}</a></li>' for k in range(3))
    page = f"<ul>{menu}</ul><h1>1</h1>" + f"<div><p>{OTHER[language]}</p></div>" * 4 + "<footer>© 2020</footer>"
    assert main_text(page).split("\n")[-4:] == [OTHER[language]] * 4 and main_text(page).count(OTHER[language]) == 4


def test_stop_words_still_decide_in_known_languages():
    junk = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda sigma omega omicron upsilon."
    assert main_text(f"<p>{TEXT}</p><p>{TEXT}</p><p>{junk}</p>") == f"{TEXT}\n{TEXT}"


def test_title_slugs_are_no_boilerplate():
    page = (
        f'<article><section id="legal-history"><h2 id="legal-history-1">Legal history</h2><p>{TEXT}</p></section>'
        f'<h2 id="social-impact" class="social-impact">Social impact</h2><p>{TEXT}</p><h3 id="comments">Comments</h3><p>{TEXT}</p></article>'
    )
    assert main_text(page).split("\n") == ["Legal history", TEXT, "Social impact", TEXT, "Comments", TEXT]


@pytest.mark.parametrize(
    "mark",
    ['class="ad"', 'class="ad-slot x"', 'class="main-nav"', 'class="siteFooter"', 'class="footer__links"', 'class="sideBar"',
     'class="social-links"', 'class="related-posts"', 'id="cookie-banner"', 'id="comments"', 'class="x share"'],
)
def test_class_names_still_mark_boilerplate(mark):
    assert main_text(f"<div><p>{TEXT}</p></div><div {mark}><p>{TEXT} No.</p></div>") == TEXT
    assert main_text(f"<article><p>{TEXT}</p><div {mark}><p>{TEXT} No.</p></div></article>") == TEXT
