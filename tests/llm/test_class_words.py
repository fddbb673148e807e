"""What class words may declare as noise."""

import pytest

from terrane.llm import html


@pytest.mark.parametrize("page", [
    "<html><body class='single has-sidebar'><article><p>Text</p></article></body></html>",
    "<html class='no-comments'><body class='sidebar'><p>Text</p></body></html>",
    "<body><div id='content' class='with-sidebar'><article><p>Text</p></article></div></body>",
    "<body><div class='sidebar'><article><p>Text</p></article></div></body>",
    "<body><div class='banner'><div><main><p>Text</p></main></div></div></body>",
    "<body><article class='post no-comments'><p>Text</p></article></body>",
    "<body class='menu'><article class='promo'><p>Text</p></article><div class='ad-banner 2'>Buy</div></body>",
    "<body><article><p>Text</p></article><div class='comments'><article class='comment'>Nice</article></div></body>",
    "<body><p>Text</p><div class='menu'>Menu</div><p class='cookie-notice'>Cookies</p><button>Press</button></body>",
])
def test_class_words_spare_the_page(page):
    assert html.main_text(page) == "Text"


def test_inline_elements_of_an_article_keep_their_text():
    page = "<article><p>Let <math><mi>x</mi><annotation encoding='t'>x</annotation></math> be, <button>press</button> or <object data='a'>see</object> it</p></article>"
    assert html.main_text(page) == "Let x be, press or see it"
