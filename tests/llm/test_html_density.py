import math
import random
import re

from gridfire.llm import html_text

WORDS = "many words stand here and no link at all is among them".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."


def test_formula_matches_a_recursive_one():
    """The densities again, from nested lists and by the formula as published, node by node."""
    rnd = random.Random(2)

    def make(depth):
        tag = rnd.choice(["div", "section", "p", "a", "b", "span"]) if depth else "body"
        inner = [make(depth + 1) if depth < 4 and rnd.random() < 0.5 else prose(rnd, rnd.randrange(6)) for _ in range(rnd.randrange(4))]
        return [tag if tag not in ("p", "a") or not any(isinstance(x, list) for x in inner) else "div", inner]

    def html_of(x):
        return x if isinstance(x, str) else f"<{x[0]}>{''.join(map(html_of, x[1]))}</{x[0]}>"

    def counts(x, linked):
        """Characters, tags, link characters, link tags."""
        if isinstance(x, str):
            n = len(x.replace(" ", ""))
            return (n, 0, n if linked else 0, 0)
        parts = [counts(y, linked or x[0] == "a") for y in x[1]]
        tags = [y for y in x[1] if isinstance(y, list)]
        return tuple(sum(p[i] for p in parts) + (0, len(tags), 0, sum(y[0] == "a" for y in tags))[i] for i in range(4))

    for _ in range(60):
        tree = make(0)
        page = html_text.Page(html_of(tree))
        got, sums = html_text.densities(page, page.out)
        body = counts(tree, False)
        flat = []

        def walk(x, linked, flat=flat, body=body):
            c, t, lc, lt = counts(x, linked or x[0] == "a")
            one = lambda v: max(1, v)
            want = 0.0
            if c:
                want = c / one(t) * math.log(max(1.0, c / one(lc) * one(t) / one(lt)) + math.e - 1, math.log(c / one(c - lc) * one(lc) + body[2] / one(body[0]) * c + math.e))
            flat.append((x[0], want, x, linked or x[0] == "a"))
            for y in x[1]:
                if isinstance(y, list):
                    walk(y, linked or x[0] == "a")

        walk(tree, False)
        assert page.tags[1:] == [f[0] for f in flat]
        for node, (tag, want, x, linked) in enumerate(flat, 1):
            assert math.isclose(got[node], want, abs_tol=1e-9)
            straight = 0 if linked or tag not in html_text.BLOCK else sum(len(y.replace(" ", "")) for y in x[1] if isinstance(y, str))
            assert math.isclose(sums[node], straight + sum(got[k] for k in range(len(page.tags)) if page.parent[k] == node), abs_tol=1e-9)


TEXT = "".join(f"<p>{prose(random.Random(k), 14)}</p>" for k in range(5))
WANT = " ".join(prose(random.Random(k), 14) for k in range(5))


def test_pages_whose_names_or_forms_hold_the_text():
    for source in (
        f"<body><article><h1>Head</h1><div class='post related-story'>{TEXT}</div></article></body>",
        f"<body><article><h1>Head</h1><div id='discussion-paper'>{TEXT}</div></article></body>",
        f"<body><article><h1>Head</h1><div class='share-price-report'>{TEXT}</div></article></body>",
        f"<body><form id='aspnetForm'><nav><a href=x>a</a></nav><div><h1>Head</h1>{TEXT}</div><footer>f</footer></form></body>",
        f"<body><article><h1>Head</h1><div class=comments>{TEXT}</div></article></body>",
        f"<body><div class=modal><h1>Head</h1>{TEXT}</div></body>",
    ):
        assert html_text.extract(source) == "Head " + WANT, source[:60]


def test_names_count_where_the_text_is_elsewhere():
    long = "".join(f"<p>{prose(random.Random(k), 20)}</p>" for k in range(50, 58))
    for name in ("class=comments", "id=sidebar", "class='cookie-notice'", "role=navigation"):
        assert html_text.extract(f"<body><article><h1>Head</h1>{TEXT}</article><div {name}>{long}</div></body>") == "Head " + WANT
    assert html_text.extract(f"<body><article><h1>Head</h1>{TEXT}<form><p>name and mail please</p></form></article></body>") == "Head " + WANT


def test_without_article_elements_density_decides():
    menu = "<ul>" + "".join(f"<li><a href={i}>link text {i}</a>" for i in range(20)) + "</ul>"
    two = f"<div><section>{TEXT}</section><section><h2>Second part</h2><p>{prose(random.Random(9), 30)}</p></section></div>"
    assert html_text.extract(f"<body><div>{menu}</div><div class=x1><h1>Head</h1>{TEXT}</div><div>{menu}</div></body>") == "Head " + WANT
    assert html_text.extract(f"<body><div>{menu}</div>{two}<div>{menu}</div></body>") == f"{WANT} Second part {prose(random.Random(9), 30)}"
    assert html_text.extract(f"<body><div class=x2>buy this now</div><div><h1>Head</h1>{TEXT}</div></body>") == "Head " + WANT
    assert html_text.extract(f"<main><h1>Head</h1><article>{TEXT}</article><div>{menu}</div></main>") == "Head " + WANT


def test_sample_pages_without_their_article_tags(spark):
    """Of the sample's pages, the text is the same with and without article elements."""
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        source = r.html or ""
        want = html_text.extract(source)
        assert html_text.extract(re.sub("</?article>", "", source)) == want
        inside = re.search("<article>(.*)</article>", source, re.S)
        assert not inside or want == html_text.extract(inside[1])
