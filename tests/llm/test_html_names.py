"""Class names and ids that mark a part of an article as none of its text, and such that do not."""

import pytest

from caregap.llm.html_text import main_text

TEXT = "The committee met in the old town hall and spoke for an hour about the plans that the council had made for the river."
NOISE = "This is the part of the page that a reader of the article would not count as any text of the article itself."

MARKED_CLASSES = """
user-comments reader-comments blog-comments wp-block-comments comments comment comment-list comments-area commentList
google-ad adsbygoogle ad ad-slot ad-unit ads-box advert advert-top sponsored sponsored-content blog-footer c-footer footer
article-footer site-footer footer-links content-sidebar l-sidebar sidebar sidebar-right mega-menu dropdown-menu menu main-menu
nav navbar top-nav breadcrumbs page-breadcrumb privacy-banner cookie-banner cookies cookie-consent js-share share-buttons
social-share survey-form contact-form newsletter newsletter-signup signup popup modal pagination pager toolbar widget
widget-area related-posts promo promo-box
""".split()
PLAIN_CLASSES = """
widgets-of-the-world text content story entry-content article-body lead intro paragraph long-form short-form market-share
history chapter legal-history social-impact the-comment the-menu how-to-share notes-on-the-footer quote body-text main
section-title columns figure caption summary
""".split()
MARKED_IDS = """
comments comment-list related-posts newsletter-signup page-footer ad-slot cookie-banner sponsored-content sidebar footer
main-sidebar footer-links
""".split()
PLAIN_IDS = """
legal-history social-impact legal menu search recommended-reading the-comment-period share-of-the-market promotion-of-peace
banner-years introduction related-work notice history-of-advertising widgets-of-the-world navigation-at-sea
""".split()


def kept(attribute, tag):
    html = f"<html><body><article><p>{TEXT}</p><{tag} {attribute}><p>{NOISE}</p></{tag}><p>{TEXT}</p></article></body></html>"
    text = main_text(html)
    assert text.count(TEXT) == 2
    return NOISE in text


@pytest.mark.parametrize("name", MARKED_CLASSES)
def test_marked_classes(name):
    assert not kept(f'class="{name}"', "div")


@pytest.mark.parametrize("name", PLAIN_CLASSES)
def test_plain_classes(name):
    assert kept(f'class="{name}"', "div")


@pytest.mark.parametrize("name", MARKED_IDS)
def test_marked_section_ids(name):
    assert not kept(f'id="{name}"', "section")


@pytest.mark.parametrize("name", PLAIN_IDS)
def test_plain_section_ids(name):
    assert kept(f'id="{name}"', "section")
