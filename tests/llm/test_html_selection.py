"""What of a page is the article: short ones beside long comments, sections on their own, bars beside articles."""

from gridfire.llm import html_text

COMMENTS = "".join(f"<p>Reader {k} says a great deal about this, and about other things, at considerable length, every single day.</p>" for k in range(6))
FIVE = "<h2>A</h2>" + "".join(f"<p>Paragraph {k} of the article has some ordinary words in it.</p>" for k in range(5))
FIVE_TEXT = "A " + " ".join(f"Paragraph {k} of the article has some ordinary words in it." for k in range(5))
SHORT, SHORT_TEXT = "<h1>Hi</h1><p>Short article text here.</p>", "Hi Short article text here."


def test_comments_never_win_by_length():
    for times in (1, 10, 100):
        for around in ("<div id=x>{}</div>", "<article>{}</article>", "<main>{}</main>", "<section>{}</section>", "{}"):
            for after in ("<div class='comments'>{}</div>", "<section id=comments><h2>Comments</h2>{}</section>", "<div class=comment-list><div class=comment>{}</div></div>", "<div class=sidebar>{}</div>"):
                assert html_text.extract("<body>" + around.format(SHORT) + after.format(COMMENTS * times) + "</body>") == SHORT_TEXT, (around, after, times)
    bare = "<div>Bare text of an article without a paragraph.<br>It goes on here.</div>"
    assert html_text.extract(f"<body>{bare}<div class=comments>{COMMENTS}</div></body>") == "Bare text of an article without a paragraph. It goes on here."


def test_no_section_is_lost():
    closing = "<h2>B</h2><p>Short closing section text.</p>"
    for level in ("<body><div>{}</div></body>", "<body><div><div>{}</div></div></body>", "<body>{}</body>", "<body><nav><a href=x>home</a></nav><div>{}</div><footer>foot</footer></body>"):
        for a, b in (("div", "div"), ("section", "section"), ("div", "section")):
            page = level.format(f"<{a}>{FIVE}</{a}><{b}>{closing}</{b}>")
            assert html_text.extract(page) == FIVE_TEXT + " B Short closing section text.", page[:90]
    assert html_text.extract(f"<body><div><div>{FIVE}</div><div><p>One closing paragraph alone, which stands in an element of its own and is somewhat longer than the others are, so that it counts.</p></div></div></body>") == FIVE_TEXT + " One closing paragraph alone, which stands in an element of its own and is somewhat longer than the others are, so that it counts."


def test_bars_beside_an_article_stay_out():
    for bar in ("<div>We use cookies on this site. OK</div>", "<div><p>We use cookies on this site to make it work for everyone.</p><button>OK</button></div>", "<div>buy this now</div>"):
        for around in ("<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div><article>{}</article></div>"):
            assert html_text.extract(f"<body>{bar}{around.format(SHORT)}</body>") == html_text.extract(f"<body>{around.format(SHORT)}{bar}</body>") == SHORT_TEXT, (bar, around)
        assert html_text.extract(f"<body>{bar}<div>{FIVE}</div></body>") == FIVE_TEXT, bar


def test_named_wrappers_keep_their_page():
    for wrap in ("<div class=modal>{}</div>", "<form id=aspnetForm><div>{}</div></form>", "<div id=overlay><div>{}</div></div>"):
        assert html_text.extract(f"<body><div>Skip to content</div>{wrap.format('<h1>Head</h1>' + FIVE)}<p>Copyright by us.</p></body>").startswith("Head " + FIVE_TEXT), wrap
    both = f"<body><article>{SHORT}</article><div class=newsletter><h1>Subscribe</h1>{COMMENTS}</div></body>"
    assert html_text.extract(both) == SHORT_TEXT
