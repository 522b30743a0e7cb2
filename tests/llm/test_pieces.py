import functools

from blotter.llm import pieces


def best_path(word, model):
    """The best segmentation by trying every last piece of every ending, longest first."""

    @functools.cache
    def upto(end):
        if not end:
            return 0.0, ()
        best = upto(end - 1)[0] + model.unknown, upto(end - 1)[1] + tuple(model.spelt(word[end - 1]))
        for i in range(end - 1, -1, -1):
            if (hit := model.pieces.get(word[i:end])) and upto(i)[0] + hit[0] >= best[0]:
                best = upto(i)[0] + hit[0], (*upto(i)[1], hit[1])
        return best

    return list(upto(len(word))[1])


def test_shared_prefixes_change_nothing():
    model = pieces.load(pieces.default_model())
    words = sorted(
        {"▁the", "▁there", "▁therefore", "▁thé", "▁", "▁▁▁", "▁x☃y", "▁日本語テキスト", "▁a\nb", "▁zzzz"}
        | {f"▁un{a}{b}ing" for a in "abcdef" for b in ("der", "der☃", "st", "")}
    )
    for word, ids in pieces.viterbi(words, model):
        assert ids == best_path(word, model)


def test_round_trip_of_odd_texts(spark):
    texts = ["", " ", "  two  spaces ", "a▁b ▁▁ c", "line\nend\n", "日本 ☃ \U0001f600", "x" * 5000,
             "the same the same", "\ttab", None, "▁", "<s> </s> <unk> <0x41>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pieces.decode(pieces.encode(docs)).orderBy("doc_id").collect()
    assert [r.decoded for r in rows] == texts
    assert rows[0].ids == [] and rows[9].ids is None
    assert pieces.decode(pieces.encode(docs.limit(0))).count() == 0


def test_edge_rows(edge):
    rows = pieces.encode(edge("token")).collect()
    assert len(rows) == 7
    assert len({tuple(r.ids) for r in rows if r.doc_id == 3}) == 1


def test_query_round_trip(spark):
    from blotter.llm.queries import QUERIES

    rows = QUERIES["op3_sentencepiece"](spark, "/root/testdata/sf0.001")
    assert rows.count() == 200 and rows.where("NOT round_trip").isEmpty()
