"""Names of classes and ids alone do not make the article boilerplate."""

import pytest

from slotwise.llm.html_extraction import main_text

TEXT = "A sentence of the article that goes on for a while, so that it has words enough. "
BODY = f"<h2 id='related-work'>Related work</h2><p>{TEXT * 4}</p><p>Short.</p><p>{TEXT * 3}</p>"
WANTED = ["Related work", (TEXT * 4).strip(), "Short.", (TEXT * 3).strip()]


@pytest.mark.parametrize("page", [
    "<body><div class='content-sidebar-wrap'>{}</div></body>",
    "<div class='site has-sidebar'><div class='content'>{}</div><div class='sidebar'><p>{T}</p></div></div>",
    "<div class='site has-sidebar'><main>{}</main><div class='sidebar'><p>{T}</p></div></div>",
    "<div class='page-header-modal'><article>{}</article></div><div id='comments'><p>{T}</p></div>",
    "<main><div class='content-sidebar-wrap'><article>{}</article></div><div class='related'><article><p>{T}</p></article></div></main>",
    "<article>{}<section id='comments'><article><p>{L}</p></article></section></article>",
    "<article>{}</article><div id='comments'><article class='comment-body'><p>{L}</p></article></div>",
    "<article>{}</article><div id='comments'><p>{L}</p><p>{L}</p></div>",
    "<main><div class='content sidebar-right'>{}</div></main>",
])
def test_wrappers_and_headings_stay(page):
    html = page.replace("{}", BODY).replace("{T}", TEXT).replace("{L}", TEXT * 30)
    assert main_text(html)[0].split("\n") == WANTED


def test_hidden_articles_stay_hidden():
    page = f"<div id='content'>{BODY}</div><div class='modal' style='display:none'><article><p>{TEXT * 9}</p></article></div>"
    assert main_text(page)[0].split("\n") == WANTED
