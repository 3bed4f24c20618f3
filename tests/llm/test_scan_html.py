import random
import re

import duckdb
import numpy as np

from gridfire.llm import decontaminate, html_text, license_texts, licenses, queries


def words_of(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def contained(template, text, width=5):
    """Brute force: the share of the template's shingles in any stretch of the text twice as long as the window rule needs."""
    grams = lambda w: [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
    t, s = set(grams(words_of(template))), grams(words_of(text))
    c = 4
    while c < len(t):
        c *= 4
    return max((len(t & set(s[k * c : k * c + 2 * c])) / len(t) for k in range(max(1, -(-len(s) // c) - 1))), default=0.0) if t else 0.0


def test_license_scan_matches_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rnd = random.Random(4)
    long = " ".join("".join(rnd.choice("abcde") for _ in range(6)) for _ in range(60))
    edited = long.split()
    edited[30] = "zzz"
    extra = [(-1, "x " * 37 + long + " y" * 50), (-2, " ".join(edited)), (-3, None), (-4, ""), (-5, "Released UNDER the\nMIT -- license"), (-6, "released under the mit"), (-5, "Released under the MIT License"), (-7, "a b " * 30_000 + "Licensed under the Apache License, Version 2.0.")]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    known = [*licenses.TEMPLATES, ("long", long), ("none", "too short")]
    got = {(r.doc_id, r.license): r.containment for r in licenses.license_scan(docs.selectExpr("doc_id", "text", "1 as at", "2 as w"), licenses.templates(spark, known)).collect()}
    want = {}
    for r in docs.collect():
        for name, text in known:
            if (share := contained(text, r.text)) >= 0.8:
                want[r.doc_id, name] = max(share, want.get((r.doc_id, name), 0))
    assert got == want and (-1, "long") in got and (-2, "long") in got and (-7, "Apache-2.0") in got
    assert licenses.license_scan(docs.limit(0), licenses.templates(spark)).count() == 0
    assert licenses.license_scan(docs, licenses.templates(spark, [("none", "short")])).count() == 0


def test_bands_find_long_texts_at_the_threshold(spark):
    """Of texts that hold 80 to 85 % of a long template's shingles, among other words, the bands miss one in some hundred at most."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    known = [(f"t{n}", " ".join(word() for _ in range(n))) for n in (69, 120, 250, 700)]
    docs, want = [], set()
    while len(want) < 300:
        name, text = rnd.choice(known)
        words = text.split()
        for k in rnd.sample(range(len(words)), len(words) * 3 // 80):
            words[k] = word()
        made = " ".join([*(word() for _ in range(rnd.randrange(900))), *words, *(word() for _ in range(rnd.randrange(900)))])
        if 0.8 <= contained(text, made) < 0.86:
            want.add((len(docs), name))
        docs.append((len(docs), made))
    rows = licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string"), licenses.templates(spark, known)).collect()
    got = {(r.doc_id, r.license) for r in rows}
    assert got and all(r.containment >= 0.8 for r in rows) and len(want - got) <= 3
    assert {(i, name) for i, t in docs for name, text in known if contained(text, t) >= 0.8} >= got


def test_whole_licences(spark):
    """Whole licences are found in other text, with other layout and with small edits; a text of the same words in another order is not."""
    rnd = random.Random(1)
    texts = dict(license_texts.TEMPLATES)
    noise = " ".join("".join(rnd.choice("abcde") for _ in range(5)) for _ in range(400))
    docs = [(i, f"{noise}\n * {text.upper().replace(' ', '  ')}\n{noise}") for i, text in enumerate(texts.values())]
    edited = {name: " ".join(w for k, w in enumerate(text.split()) if k % 60 != 30) for name, text in texts.items() if len(text.split()) > 60}
    docs += [(100 + i, text) for i, text in enumerate(edited.values())]
    shuffled = texts["MIT"].split()
    rnd.shuffle(shuffled)
    docs.append((200, " ".join(shuffled)))
    rows = licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string"), licenses.templates(spark)).collect()
    got = {(r.doc_id, r.license) for r in rows}
    assert got >= {(i, name) for i, name in enumerate(texts)} | {(100 + i, name) for i, name in enumerate(edited)}
    assert not [r for r in rows if r.doc_id == 200]


def plain_alignment(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] > 0 else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            best = max(best, h[i][j])
    return best


def test_smith_waterman_matches_brute_force():
    rnd = random.Random(6)
    for _ in range(60):
        a = np.array([rnd.randrange(1, 6) for _ in range(rnd.randrange(1, 20))])
        b = np.array([rnd.randrange(0, 6) for _ in range(rnd.randrange(0, 30))])
        score, first, end = decontaminate.smith_waterman(a, b)
        assert score == plain_alignment(a.tolist(), b.tolist())
        assert 0 <= first <= end <= len(b) and plain_alignment(a.tolist(), b[first:end].tolist()) == score


def test_leaks(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)] + [(50, "only two"), (51, None), (52, "")]
    edited = items[3][1].split()
    for k in (4, 11, 19, 25):
        edited[k] = word()
    del edited[15]
    noise = lambda n: " ".join(word() for _ in range(n))
    docs = [(1, noise(50) + " " + items[0][1].upper() + ". " + noise(40)), (2, " ".join(edited) + " " + noise(10)), (3, noise(500)), (4, None), (5, ""), (6, items[1][1] + " " + items[2][1]), (7, " ".join(items[5][1].split()[:9]) + noise(30)), (8, "it has only two words")]
    docs += [(100 + i, items[7][1]) for i in range(30)] + [(1, docs[0][1])]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, score string")
    items_frame = spark.createDataFrame(items, "item_id long, text string")
    for bits in (24, 6):
        rows = decontaminate.find_leaks(frame, items_frame, bits=bits).collect()
        got = sorted((r.doc_id, r.item_id) for r in rows)
        assert got == sorted([(1, 0), (1, 0), (2, 3), (6, 1), (6, 2), (8, 50)] + [(100 + i, 7) for i in range(30)])
        assert {(r.first_word, r.end_word) for r in rows if r.doc_id == 1} == {(50, 80)}
        kept = decontaminate.drop_leaks(frame, items_frame, bits=bits)
        assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 7]
    assert decontaminate.find_leaks(frame.limit(0), items_frame).count() == 0
    assert decontaminate.find_leaks(frame, items_frame.limit(0)).count() == 0
    assert decontaminate.drop_leaks(frame, items_frame.limit(0)).count() == len(docs)


def test_leaks_of_the_sample(spark, sf_dir):
    """Every whole copy of an item (as a run of words) is found."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    norm = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    want = {(d.doc_id, i.item_id) for d in docs for i in items if norm(i.text).strip() and norm(i.text) in norm(d.text)}
    got = {(r.doc_id, r.item_id) for r in queries.op5_decontaminate(spark, sf_dir).collect()}
    assert want and want <= got


CASES = [
    ("", ""), ("just text  here", "just text here"), ("<p>a<p>b", "a b"),
    ("<body><nav><a href=x>menu</a></nav><article><h1>T&amp;t</h1><p><b>bo</b>ld &lt;x&gt;\n y<br>z</article><footer>f</footer>", "T&t bold <x> y z"),
    ("<article><p>x<script>var t='</p>';</script>y</p><style>p{}</style><!-- c --></article>", "xy"),
    ("<body><header>site</header><main><article><header><h1>H</h1></header><p>para graph</p><aside>side</aside><section class='comments'>c1</section></article></main>", "H para graph"),
    ("<body><div class='cookie-notice'>We use cookies, a lot of them, in many words</div><div><p>Short text.</p><form><input>f</form></div>", "Short text."),
    ("<body><div class=ad>" + "buy this " * 50 + "</div><article><p>a</p></article>", "a"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", "one two a b"),
    ("<article><p>unclosed < 3 and <b>bold", "unclosed < 3 and bold"),
    ("<body><nav>n</nav></body>", ""), ("<p title='a>b'>q</p>", "q"),
    ("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "</article>", "deep"),
]


def test_extract_cases():
    for source, want in CASES:
        assert html_text.extract(source) == want, source[:80]
    assert html_text.extract('<p "' * 2000) is not None


def test_density_leads_without_article_element():
    links = "<div>" + "".join(f"<a href={i}>link text {i}</a> " for i in range(30)) + "</div>"
    body = "<div id=main><h1>Head line</h1>" + "<p>Many words stand here, and no link at all among them.</p>" * 6 + "</div>"
    assert html_text.extract(f"<body>{links}{body}{links}</body>") == "Head line " + " ".join(["Many words stand here, and no link at all among them."] * 6)


def test_extract_query(spark, sf_dir):
    rows = {r.page_id: r for r in queries.op10_html_text(spark, sf_dir).collect()}
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        r = rows[p.page_id]
        assert r.text == html_text.extract(p.html or "") and r.n_chars == len(r.text) and r.url == p.url
    docs = spark.createDataFrame([(1, None, "t"), (2, "", "t"), (2, "", "t")], "page_id long, html string, html_ string")
    assert [r.text for r in html_text.extract_text(docs).collect()] == ["", "", ""]
    assert html_text.extract_text(docs.limit(0)).count() == 0


def test_license_query_matches_sql(spark):
    sf_dir = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(queries.ORACLE_SQL["op2_license_scan"])
    cols = [c[0] for c in want.description]
    got = queries.op2_license_scan(spark, sf_dir).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) > 20
