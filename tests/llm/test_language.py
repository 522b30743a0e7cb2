from blotter.llm import language

ENGLISH = "the house and the river are quiet because nothing moves there today "
GERMAN = "das haus und der fluss sind ruhig weil sich dort heute nichts bewegt "


def corpus():
    rows = []
    for i in range(60):
        german = i % 3 == 0
        text = (GERMAN if german else ENGLISH) * (1 + i % 4) + str(i)
        rows.append((i, text, "de" if german else "en", "h1" if german else "h2"))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


def test_text_wins_over_a_wrong_declaration(spark):
    rows = [*corpus(), (100, GERMAN * 3, "en", "h2"), (101, ENGLISH * 3, None, "h1")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {
        r.doc_id: r
        for r in language.identify_languages(docs, declared="lang", host="source").collect()
    }
    assert out[100].language == "de" and out[101].language == "en"
    assert all(out[i].language == ("de" if i % 3 == 0 else "en") and out[i].kept for i in range(60))


def test_other_evidence_decides_for_short_texts(spark):
    rows = [*corpus(), (100, "12 34", "de", "h1"), (101, "in", None, "h1"), (102, "in", None, "h2")]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {
        r.doc_id: r
        for r in language.identify_languages(docs, declared="lang", host="source").collect()
    }
    assert out[100].language == "de" and not out[100].kept
    assert out[101].language == "de" and out[102].language == "en"


def test_page_evidence(spark):
    page = '<!DOCTYPE html><html lang="de"><script>var a</script><p>%s</p></html>'
    rows = [(i, f"https://www.Host{i % 2}.example.de:80/x", page % (GERMAN + str(i))) for i in range(9)]
    pages = language.page_evidence(spark.createDataFrame(rows, "page_id long, url string, html string"))
    first = pages.orderBy("page_id").first()
    assert (first.declared, first.host, first.suffix) == ("de", "www.host0.example.de", "de")
    assert "var a" not in first.text and GERMAN.strip() in first.text
    out = language.identify_languages(
        pages, id_col="page_id", declared="declared", host="host", suffix="suffix"
    )
    assert {r.language for r in out.collect()} == {"de"}
    odd = spark.createDataFrame([(1, None, None), (2, "no address", "")], "page_id long, url string, html string")
    assert [(r.declared, r.host, r.suffix) for r in language.page_evidence(odd).collect()] == [(None,) * 3] * 2


def test_edge_rows(spark, edge):
    out = language.identify_languages(edge("_like_en"), declared="lang", host="source").collect()
    assert len(out) == 7 and not any(r.kept for r in out if r.doc_id in (1, 2, 5))
    assert len({tuple(r) for r in out if r.doc_id == 3}) == 1
    empty = language.identify_languages(edge(rows=[]), declared="lang", host="source")
    assert empty.count() == 0
    bare = language.identify_languages(edge())
    assert {r.language for r in bare.collect()} == {"en"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    # The declaration is hidden from the evidence of every fifth document.
    hidden = docs.selectExpr("doc_id", "text", "source", "lang AS truth",
                             "IF(doc_id % 5 = 0, NULL, lang) AS lang")
    out = language.identify_languages(hidden, declared="lang", host="source", keep=("truth",))
    hits = [r.language == r.truth for r in out.where("doc_id % 5 = 0").collect()]
    assert sum(hits) >= 0.98 * len(hits)
