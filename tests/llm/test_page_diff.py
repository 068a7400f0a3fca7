import random
import tracemalloc

from kpiscope.llm import page_diff as p
from kpiscope.llm.queries import op8_page_diff

HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t=\"</p>\";</script></head><body><nav><ul><li><a href='/x'>Menu</a></li></ul></nav>"
FOOT = "<footer>&copy; us</footer></body></html>"


def body(inner):
    return HEAD + inner + FOOT


def text(html, before=(), after=()):
    lines = p.lines_of(html)
    left = p.kept_lines(p.page_of(lines), [p.page_of(p.lines_of(h)) for h in before], [p.page_of(p.lines_of(h)) for h in after])
    return "\n\n".join(lines[i][1] for i in left)


def test_article_without_its_surroundings():
    html = body(
        "<!-- ad 1 --><div class=\"ad\">Buy</div><div class='cookie-notice'>We use</div><article><header><h1>Title &amp;  more</h1></header><p><b>Bold\n text.<br><p>Second&nbsp;part</p>"
        "<form><label>Mail</label><input></form><aside>Side</aside><ul><li>one<li>two</ul></article><section id='comments'><article class='comment'><p>Nice!</p></article></section>"
    )
    assert text(html) == "Title & more\n\nBold text.\n\nSecond part\n\none\n\ntwo"


def test_without_an_article_the_shared_lines_go():
    a = "<div>Site name</div><p>Own words here.</p><p>More of them, which are longer.</p><div>All rights</div>"
    b = "<div>Site name</div><p>Other words there, quite long too.</p><div>All rights</div>"
    everything = "Site name\n\nOwn words here.\n\nMore of them, which are longer.\n\nAll rights"
    assert text(body(a), [body(b)]) == "Own words here.\n\nMore of them, which are longer."
    assert text(body(a)) == everything
    assert text(body(a), [body(a)]) == everything  # a copy alone shows no template
    assert text(body(a), [body(a), body(a), body(b)]) == "Own words here.\n\nMore of them, which are longer."  # the next page does
    # A passage that only one of two pairs has is a quotation.
    c = b.replace("<p>Other", "<p>Own words here.</p><p>Other")
    assert text(body(a), [body(c)], [body(b)]) == "Own words here.\n\nMore of them, which are longer."


def test_inside_an_article_labels_go_and_passages_stay():
    def page(k, extra=""):
        return body(f"<article><h1>Head {k}</h1><p>By our staff</p><p>Text {k} {'w ' * 40}</p>{extra}<p>More {k} of it, {k} times</p><p>Share this article</p></article>")

    quoted = "<p>A passage that each of them quotes.</p>"
    a, b, c = page("a", quoted), page("b", quoted), page("c", "<p>x</p>" + quoted)
    mine = f"Head a\n\nText a {'w ' * 40}".strip() + "\n\nA passage that each of them quotes.\n\nMore a of it, a times"
    assert text(a, [page("b")], [c]) == mine  # quoted by one
    assert text(a, [b], [page("d", "<p>y</p><p>z</p>" + quoted + "<p>u</p>")]) == mine  # by both, at different places
    assert text(a, [b]) == "\n\n".join(t for _, t in p.lines_of(a) if t != "Menu" and t != "© us")  # one pair is too few


def test_names_that_are_all_div_still_give_the_text():
    """Tags, classes and ids say nothing here; only the alignment tells."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shell = ["Home", "News", "Contact", "We use cookies here", "%", "Sponsored: buy now", "All rights reserved"]
    texts = [[" ".join(word() for _ in range(rng.randint(5, 20))) for _ in range(rng.randint(2, 6))] for _ in range(6)]
    htmls = ["".join("".join(f"<div>{t}</div>" for t in own) if s == "%" else f"<div>{s}</div>" for s in shell) for own in texts]
    for i, own in enumerate(texts):
        assert text(htmls[i], htmls[:i][::-1], htmls[i + 1 :]) == "\n\n".join(own)


def test_names_that_begin_like_raw_elements():
    assert text("<p>One</p><video-player src='x'></video-player><select-x><p>Two</p>") == "One\n\nTwo"
    assert text("<p>The sum <math><mi>x</mi></math> of it</p><button><p>Three</p>") == "The sum x of it\n\nThree"
    assert text("<p>One</p><SCRIPT>a</script >b<style>c</stylex>d</style><p>Two</p><script>e") == "One\n\nb\n\nTwo"
    assert text("<header-bar><p>A</p></header-bar><p>B<svg/>C</p>") == "A\n\nBC"


def test_quoted_values_hold_any_characters():
    assert text('<article><p title="1 < 2">Hello there</p></article>') == "Hello there"
    assert text("<article><p data-x='<b>'>Two</p></article>") == "Two"
    assert text('<article><p title="a > b" data-y="<script>" data-z="<!-- ">One</p><p>it\'s two</p><p it\'s>Three</p></article>') == "One\n\nit's two\n\nThree"
    assert text('<p>A</p><svg title="x/>"><text>gone</text></svg><p title="never closed>B</p><p>C</p>').startswith("A")
    assert text("<p title = \"x\n<y>\" >One</p>") == "One"


def test_names_in_an_article_take_nothing_that_is_said():
    said = "Two results of the study were found in it."
    assert text(f'<article><p>One.</p><div class="search-results">Two results of the study</div><section id="related-laws"><p>important text</p></section></article>') == "One.\n\nTwo results of the study\n\nimportant text"
    assert text(f'<article><p>One.</p><div class="related"><p>{said}</p><p>See it</p></div><div class="share">Mail it</div></article>') == f"One.\n\n{said}\n\nSee it"
    assert text(f'<article><p>One.</p><div class="ad">{said}</div><div class="comments"><p>{said}</p></div></article>') == "One."
    assert text(f'<div id="search-results"><p>{said}</p></div><div id="sidebar"><p>{said}</p></div>') == said


def test_more_than_two_neighbours_vote():
    def page(k, label="Read more of us"):
        return f"<article><h1>Head {k}</h1><p>{label}</p><p>Text {k} is told here in {k * 60} words {k}.</p><p>This prose ends each of our articles here.</p></article>"

    want = f"Head a\n\nText a is told here in {'a' * 60} words a.\n\nThis prose ends each of our articles here."
    assert text(page("a"), [page("b"), page("c", "Another label")], [page("d"), page("e")]) == want  # three of four have the label
    assert text(page("a"), [page("b"), page("c", "One")], [page("d", "Two"), page("e")]) == want.replace("Head a", "Head a\n\nRead more of us")
    shell = lambda own, foot="Made by us": f"<div>Site</div><div>{own}</div><div>{foot}</div>"
    assert text(shell("Own words a"), [shell("Own b"), shell("Own c", "Odd")], [shell("Own d")]) == "Own words a"


def test_query_against_brute_force_alignment(spark, tmp_path):
    """The query's result, with each page aligned by a quadratic table and pairs looked up in a plain list."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(70):
        site = f"http://s{i % 3}.org"
        inner = "".join(f"<p>{' '.join(word() for _ in range(rng.randint(2, 9)))}{rng.choice(['.', ''])}</p>" for _ in range(rng.randint(1, 4)))
        shell = f"<div>Top {i % 3}</div>" + (f"<article><p>By staff {i % 3}</p>{inner}</article>" if i % 2 else inner) + f"<div>End {i % 3}</div>"
        rows.append((i, f"{site}/{rng.choice('xyz')}/{i}", shell))
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in op8_page_diff(spark, str(tmp_path)).collect()}

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
        return t[0][0]

    ordered = sorted(rows, key=lambda r: (r[1].split("/")[2], "/" + r[1].split("/", 3)[3], r[1]))
    lines = {r[0]: p.lines_of(r[2]) for r in rows}
    host = {r[0]: r[1].split("/")[2] for r in rows}
    order = [r[0] for r in ordered]
    for at, i in enumerate(order):
        near = [j for j in order[max(0, at - 2) : at] + order[at + 1 : at + 3] if host[j] == host[i]]
        mine = [t for _, t in lines[i]]
        shared = {j: p.common_lines(*map(p.line_hashes, (lines[i], lines[j]))) for j in near}
        assert all(len(shared[j]) == lcs(mine, [t for _, t in lines[j]]) for j in near)
        most = len(near) if len(near) < 3 else len(near) // 2 + 1
        shell = {t for t in (f"Top {i % 3}", f"End {i % 3}", f"By staff {i % 3}") if sum(t in [x for _, x in lines[j]] for j in near) >= most}
        left = [(r, t) for r, t in lines[i] if t not in shell]
        main = sum(len(t) for r, t in left if r >= p.MAIN)
        if main and 2 * main >= sum(len(t) for _, t in left):
            left = [(r, t) for r, t in left if r >= p.MAIN]
        assert got[i] == "\n\n".join(t for _, t in left), (i, near)


def test_broken_markup_does_not_crash_or_hang():
    rng = random.Random(2)
    pieces = ["<p>", "</p>", "<div class=\"", "\">", "<", ">", "'", "<!--", "-->", "<script>", "</script>", "text ", "&amp", "&#x41;", "<nav>", "</nav>", "<article>", "</div>", "<br/>", "\n"]
    for _ in range(3000):
        p.lines_of("".join(rng.choice(pieces) for _ in range(rng.randint(0, 25))))
    p.lines_of("<a \"" * 20000)
    p.lines_of("<a x=\"" * 20000)
    p.lines_of("<a x='\"" * 20000)
    p.lines_of("<" * 100000)


def test_common_lines_is_a_longest_common_subsequence():
    rng = random.Random(3)
    for _ in range(500):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(0, 9))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        got = p.common_lines(a, b)
        assert len(got) == t[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:]))


def test_long_pages_are_aligned_in_little_memory():
    rng = random.Random(4)
    a = list(range(4000))
    b = a[:]
    rng.shuffle(b)
    tracemalloc.start()
    got = p.common_lines(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) > 60 and peak < 4 << 20


def test_pairs_do_not_depend_on_ranges(spark):
    rows = [(i, f"http://h{i % 3}.org/{'abcd'[i % 4]}/{i}", body(f"<div>Same {i % 3}</div><p>Own {i} {'w ' * 9}</p>"), "x") for i in range(60)]
    rows += [(100, None, None, ""), (101, "", "", ""), (102, "http://alone.org/", body("<p>Lone</p>"), ""), (None, "http://alone.net/", body("<p>No id</p>"), "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    rows += [(200 + i, "http://copies.org/a", body("<div>Top</div><p>The very same text</p>"), "") for i in range(30)] + [(300, "http://copies.org/b", body("<div>Top</div><p>Another text, though</p>"), "")]
    rows += [(400, "http://twice.org/", body("<p>Twice</p>"), "")] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    once = sorted(map(str, p.extract(pages.coalesce(1)).collect()))
    for n in (3, 20):
        assert once == sorted(map(str, p.extract(pages.repartition(7), ranges=n).collect()))
    got = p.extract(pages.repartition(5)).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == 98 and by[100]["text"] == "" and by[100]["n_chars"] == 0 and by[102]["text"] == "Lone" and by[None]["text"] == "No id"
    assert all(by[i]["text"] == f"Own {i} {'w ' * 9}".strip() for i in range(60))
    # Copies within reach of another page lose the template, those beyond it keep all their lines.
    assert [i for i in range(200, 230) if by[i]["text"] == "The very same text"] == list(range(222, 230)) and by[200]["text"] == "Top\n\nThe very same text"
    assert by[300]["text"] == "Another text, though" or by[300]["text"] == "Top\n\nAnother text, though"
    assert p.extract(pages.where("false")).count() == 0
    named = p.extract(pages.selectExpr("concat('p', page_id) page_id", "url", "html"), ranges=4)
    assert named.count() == 98 and named.schema["page_id"].dataType.simpleString() == "string"
