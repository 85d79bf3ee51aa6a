import html as H
import random
import re

from terrastrata.llm import html_main as M

PAGES = "page_id long, url string, html string, text string"


def test_query_gives_the_articles(spark, sf_dir):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in M.query(spark, sf_dir).collect():
        article = re.search(r"(?s)<article>(.*)</article>", pages[r["page_id"]])[1]
        inner = re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", article)
        assert r["text"] == " ".join(H.unescape(inner).split()) and r["n_chars"] == len(r["text"])


def test_held_out_layouts():
    trees, rng, same = M.fit(), random.Random(1234), 0
    for _ in range(200):
        nodes = M.parse(M.training_page(rng))
        want = M.text_of(nodes, M.unmark(nodes))
        same += M.text_of(nodes, M.decode(nodes, trees.margins(M.np.array(M.features(nodes), float)))) == want
    assert same >= 190


def test_decoding_never_contradicts_ancestors():
    rng, trees = random.Random(8), M.fit(60)
    for _ in range(60):
        nodes = M.parse(M.training_page(rng))
        inside = M.decode(nodes, [rng.uniform(-4, 4) for _ in nodes])
        for x in nodes:
            seen = []
            while x is not None:
                seen.append(inside[x.place])
                x = x.parent
            changes = sum(a != b for a, b in zip(seen, seen[1:]))
            assert changes <= 2 and not (changes == 2 and seen[0])
    assert len(trees.trees) == M.TREES


def test_edges(spark):
    long = "<article><p>" + "Word and more, words here. " * 20_000 + "</p></article>"
    data = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<<<>>>&amp;", "x"), (3, "u", long, "x"), (3, "u", long, "x"), (4, "u", "<p>" * 3000 + "deep", "x"), (5, "u", "<script>var a = 1;", "x")]
    out = M.extract(spark.createDataFrame(data, PAGES)).collect()
    assert len(out) == len(data)
    got = {r["page_id"]: r["text"] for r in out}
    assert got[1] == got[2] == got[5] == "" and len(got[3]) == 27 * 20_000 - 1
    assert M.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_deep_pages_keep_their_layout():
    trees = M.fit()
    said = "<p>" + "Words of the story, one after another. " * 20 + "</p>"
    page = "<article>" + said + "</article><nav><ul>" + '<li><a href="/x">Menu entry</a></li>' * 9 + "</ul></nav>"
    want = " ".join(("Words of the story, one after another. " * 20).split())
    for n in (300, 3000):
        for tag in ("div", "section"):
            nested = f"<{tag}>" * n + page + f"</{tag}>" * n
            assert M.main_texts([nested, f"<{tag}>" * n + page], trees) == [want, want]
            nodes = M.parse(nested + "<main>")
            assert len(nodes) == n + 6 and nodes[-1].parent is nodes[0]


STORY = "Words of the story, one after another. " * 12


def page(inner):
    return f"<html><head><title>T</title></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>More</a></li></ul></nav><article><h1>Heading</h1><p>{STORY}</p>{inner}<p>{STORY}The end.</p></article><footer>Copyright and so on</footer></body></html>"


def test_controls_and_foreign_elements_take_in_nothing_else():
    trees, words = M.fit(), " ".join(STORY.split())
    plain = f"Heading {words} {words} The end."
    for inner, said in (
        ("<button>Press", ""), ("<button>Press</button>", ""), ("<svg/>", ""), ('<svg width="1"/>', ""), ("<select><option>One<option>Two", ""),
        ("<select><option>One</option></select>", ""), ("<textarea>", ""), ("<textarea>typed</textarea>", ""), ("<iframe src=x></iframe>", ""), ("<canvas></canvas>", ""),
        ("<p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds for all of it.</p>", "Where x = 2 holds for all of it."),
    ):
        want = plain if not said else f"Heading {words} {said} {words} The end."
        assert M.main_texts([page(inner)], trees) == [want], inner


def test_adverts_within_text_and_lists():
    trees, words = M.fit(), " ".join(STORY.split())
    said = f"<p>{STORY}<span class=advert>BUY <span>NOW</span> here</span> It goes on, as before.</p>"
    items = "<ul><li>First of the items, in words.</li><li class='ad'>BUY NOW<li>Second of the items, in words.</li></ul>"
    assert M.main_texts([page(said)], trees) == [f"Heading {words} {words} It goes on, as before. {words} The end."]
    assert M.main_texts([page(items)], trees) == [f"Heading {words} First of the items, in words. Second of the items, in words. {words} The end."]


def test_many_unclosed_raw_elements_take_linear_time():
    import time

    began = time.perf_counter()
    M.parse("<textarea>" * 50_000 + "<title>x" * 50_000)
    assert time.perf_counter() - began < 20
