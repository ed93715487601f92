import random

from codelode.llm import html_extract as H

TEXT = "This is the text of the page and it has all of the words that one would expect to find in a sentence of this kind, is it not."
MENU = '<ul><li><a href="/a">Home</a></li><li><a href="/b">Products and services of the company</a></li></ul>'


def test_text_stays_and_menus_go():
    page = f"<html><head><title>{TEXT}</title><script>var x='<p>{TEXT}</p>'</script></head><body>{MENU}<p>{TEXT}</p><p>Short one.</p><p>{TEXT} &amp; more</p>{MENU}<div>© 2024</div></body></html>"
    text, _, good, ambiguous = H.extract(page)
    assert text == f"{TEXT}\nShort one.\n{TEXT} & more"
    assert good == 3 and ambiguous == 1


def test_ambiguous_blocks_take_the_nearest_label():
    rng = random.Random(4)
    for _ in range(300):
        x = [rng.choice(["good", "bad", "ambiguous", "ambiguous"]) for _ in range(rng.randrange(0, 9))]
        want = []
        for k, label in enumerate(x):
            if label == "ambiguous":
                near = [(abs(k - j), y) for j, y in enumerate(x) if y != "ambiguous"]
                least = min((d for d, _ in near), default=None)
                found = {y for d, y in near if d == least}
                label = found.pop() if len(found) == 1 else "bad"
            want.append(label)
        assert H.resolve(x) == want


def test_broken_pages_nulls_and_repeats(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>" + TEXT + "<script>never closed"), (None, "u", "a < b and c"), (3, None, "<p>" + TEXT + "<script>never closed"), (5, "u", f"<p>{TEXT}</p>" * 3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = H.extract_pages(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert by[1][0].text is None and by[2][0].text == "" and by[None][0].text == ""
    assert [r.text for r in by[3]] == [TEXT, TEXT]
    assert by[5][0].n_good == 3000 and by[5][0].text.count("\n") == 2999


def test_every_page(spark, tiny):
    pages = spark.read.parquet(f"{tiny}/pages.parquet")
    want = {r.page_id: H.extract(r.html)[0] for r in pages.collect()}
    assert {r.page_id: r.text for r in H.query(spark, tiny).collect()} == want
    assert sum(bool(t) for t in want.values()) > 0.7 * len(want)  # the others hold junk or one short sentence
    assert not any("track(" in t or "margin:0" in t for t in want.values())
