"""Names of elements are evidence: an article inside an element of an unlucky name stays, what a name says truly goes."""

import pytest

from tidewire.llm import html_text

PROSE = "It is the story of a town that was by the sea and all of the people in it, as they say, for it was old."
OTHER = "This is what I think of it and of all that they say of the old town, and so on and on for you to read."
CHINESE = "這是一個關於海邊小鎮的故事,鎮上的人們都說它很老了,而且他們也不知道為什麼。" * 3


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<div class="content has-sidebar"><p>{PROSE}</p></div>', [PROSE]),
        (f'<div class="page no-sidebar"><p>{PROSE}</p></div>', [PROSE]),
        (f'<div class="comments-open"><p>{PROSE}</p></div>', [PROSE]),
        (f'<div class="hidden-gems"><p>{PROSE}</p></div>', [PROSE]),
        (f'<div id="related-work"><p>{PROSE}</p></div>', [PROSE]),
        (f'<div class="newsletter-article"><p>{PROSE}</p></div>', [PROSE]),
        (f'<article><section id="reply-to-critics"><p>{PROSE}</p></section></article>', [PROSE]),
        (f"<form><h1>Head</h1><p>{PROSE}</p></form>", ["Head", PROSE]),
        (f"<form><p>{PROSE}</p><p>{OTHER}</p></form>", [PROSE, OTHER]),
        (f"<article><p>{PROSE}</p><p><a href=x>All of this is one link</a></p><p>{OTHER}</p></article>", [PROSE, "All of this is one link", OTHER]),
        (f"<div><p>{PROSE}</p><p>The end.</p><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></div>", [PROSE, "The end."]),
        (f"<p>{CHINESE}</p><ul><li><a href=x>首页</a></ul>", [CHINESE]),
        (f'<article><p>{PROSE}</p></article><div class="post-comments"><p>{OTHER}</p></div>', [PROSE]),
        (f'<div class="cookie-banner"><p>{OTHER}</p></div><p>{PROSE}</p>', [PROSE]),
        (f'<p>{PROSE}</p><div class="related-posts"><p>{OTHER}</p></div><div id="sidebar-left"><p>{OTHER}</p></div>', [PROSE]),
        (f'<p>{PROSE}</p><form><p>{OTHER}</p></form>', [PROSE]),
        (f'<div class="has-sidebar"><p>{PROSE}</p><div class="sidebar"><p>{OTHER}</p></div></div>', [PROSE]),
        (f'<div class="cookie-banner"><p>{OTHER}</p></div>', []),
        (f'<div class="newsletter_signup ad-slot-1"><p>{OTHER}</p></div><ul class="menu"><li>{OTHER}</ul>', []),
    ],
)
def test_names_weigh(page, want):
    assert html_text.main_text(page) == "\n\n".join(want)
