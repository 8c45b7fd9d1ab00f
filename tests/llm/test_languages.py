"""Language of pages: accuracy on made pages, and each kind of evidence by itself."""

import random

from factloom.llm import languages, queries

LETTERS = {"en": "the and ing ion ent for tha her ".split(), "de": "der ein sch ich und gen ung ver ".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def frames(spark, pages):
    rng = random.Random(2)
    docs = [(i, text(rng, lang, 200), lang) for i in range(40) for lang in ("en", "de")] + [(999, None, "en"), (None, "x", None)]
    return spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as host", "1 as p"), spark.createDataFrame(docs, "doc_id long, text string, lang string")


def page(lang, body):
    return f'<!DOCTYPE html><html lang="{lang}"><head><script>var der="<p>sch</p>";</script><style>p{{}}</style></head><body><nav>und und</nav><p>{body}</p></body></html>'


def test_accuracy_and_fusion(spark):
    rng = random.Random(7)
    rows, truth = [], {}
    for i in range(300):
        lang = rng.choice(["en", "de"])
        said = lang if rng.random() < 0.9 else "en"
        host = {"en": rng.choice(["a.site.org", "site.com"]), "de": rng.choice(["b.seite.de", "blog.seite.de"])}[lang]
        rows.append((i, f"https://{host}:80/x?q#f", page(said, text(rng, lang, rng.choice([3, 30, 200])))))
        truth[i] = lang
    rows += [(1000, "http://blog.seite.de/", page("de", "")), (1001, "http://site.com/1", None), (1002, None, page("de", text(rng, "en", 100))), (1003, None, None), (1003, "", ""), (None, "junk", "<p>" + text(rng, "de", 50))]
    pages, docs = frames(spark, rows)
    got = languages.identify(pages, docs).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    assert sum(by[i].lang == truth[i] for i in truth) >= 298
    assert by[1000].lang == "de" and by[1001].lang == "en"  # nothing but the address and markup
    assert by[1002].text_lang == "en" and by[1002].declared == "de" and by[1002].host == ""
    assert by[None].lang == "de" and all(0 <= r.confidence <= 1 for r in got)


def test_empty_tables(spark):
    pages, docs = frames(spark, [(1, "http://a.de/", page("de", "der sch"))])
    assert languages.identify(pages.limit(0), docs).collect() == []
    assert [r.lang for r in languages.identify(pages, docs.limit(0)).collect()] == [None]


def test_whole_table_agrees_with_markup(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op10_language(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    assert sum(r.lang == r.declared for r in rows) >= 0.98 * len(rows) and sum(r.text_lang == r.declared for r in rows) >= 0.95 * len(rows)
