from gridfire.llm import html_text

ARTICLE = "<article><h1>Head</h1><p>The text of the article.</p></article>"
WANT = "Head The text of the article."


def test_only_named_attributes_hide():
    for attrs in ("style='overflow:hidden'", 'title="Hidden gems of Rome"', 'data-id="comments-12"', "data-role=banner", "alt='a class=ad b'", 'x="1"title="id=nav"', "data-hidden", "title='aria-hidden=true'"):
        assert html_text.extract(f"<body><div {attrs}>{ARTICLE}</div></body>") == WANT, attrs
        assert html_text.extract(f"<article><h1>Head</h1><p {attrs}>The text of the article.</p></article>") == WANT, attrs
    for attrs in ("hidden", "HIDDEN=''", "hidden=hidden", "aria-hidden = true", "title='x'class=ad", "id='comments'", "role=navigation", "a=b/hidden hidden", "class=ad class=text"):
        assert html_text.extract(f"<article><h1>Head</h1><p>The text of the article.</p><div {attrs}>more of it</div></article>") == WANT, attrs


def test_a_word_within_a_name_keeps_the_article():
    for attrs in ('class="content has-sidebar"', "id=header-and-content", "class='no-comments with-share'", 'class="category-notices"', "id='tag-search'"):
        assert html_text.extract(f"<body><div {attrs}>{ARTICLE}</div></body>") == WANT, attrs
    for name in ("post tag-search", "category-notices", "post sidebar", "related"):
        for source in (f"<body>{ARTICLE.replace('<article', f'<article class="{name}"')}</body>", f"<main>{ARTICLE.replace('<article', f'<article class="{name}"')}</main>"):
            assert html_text.extract(source) == WANT, source
    kept = ARTICLE.replace("<h1>", "<div class='header-wrap tags'><h1>").replace("</h1>", "</h1></div>")
    assert html_text.extract(kept) == WANT
    for name in ("site-footer", "main-nav x", "cookie-notice", "comment-list", "related-posts", "text social_share"):
        assert html_text.extract(ARTICLE.replace("</article>", f"<div class='{name}'>more</div></article>")) == WANT, name
    assert html_text.extract(ARTICLE.replace("</article>", "<article class=comment>more</article></article>")) == WANT
