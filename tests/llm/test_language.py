from folioseek.llm import language
from folioseek.llm.common import crc_rest, table


def test_held_out_accuracy(spark):
    documents = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    held_out = crc_rest(documents.doc_id, 4) == 2
    samples = language.dictionaries(documents.where(~held_out))
    assert set(samples) == {"en", "de", "fr", "es"} and all(len(s) <= language.DICTIONARY_BYTES for s in samples.values())
    rows = language.predicted(documents.where(held_out), samples).withColumn("accepted", language.accepted()).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) >= 0.97
    kept = [r for r in rows if r.accepted]
    assert len(kept) / len(rows) >= 0.97 and sum(r.lang == r.lang_pred for r in kept) / len(kept) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_edge_cases(spark):
    training = [(i, "the cat sat on the mat and the dog ran " * 9, "en") for i in range(9)]
    training += [(20 + i, "le chat est sur la table et le chien aussi " * 9, "fr") for i in range(5)]
    training += [(40, None, "xx"), (41, "whatever", None), (None, "the cat", "en")]
    samples = language.dictionaries(spark.createDataFrame(training, "doc_id long, text string, lang string"))
    assert list(samples) == ["en", "fr"]
    texts = [None, "", "123 !?", "The CAT; sat!", "LE CHAT, est sur", "the cat sat on the mat " * 20000, "the cat", "the cat"]
    frame = spark.createDataFrame([(i, t, 0, "x") for i, t in enumerate(texts)], "doc_id long, text string, score int, letters string")
    rows = language.predicted(frame, samples).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows] == ["und", "und", "und", "en", "fr", "en", "en", "en"]
    assert [r.score for r in rows[:3]] == [0.0] * 3 and rows[5].score > 0 and rows[0].letters == "x"
    assert language.predicted(frame.limit(0), samples).count() == 0
    assert {r.lang_pred for r in language.predicted(frame, {}).collect()} == {"und"}
    assert language.dictionaries(spark.createDataFrame([], "doc_id long, text string, lang string")) == {}


def test_rows_choose_the_same_sample(spark):
    rows = [(i, f"text {i} " * 30, "ab"[i % 2]) for i in range(300)]
    schema = "doc_id long, text string, lang string"
    one = language.dictionaries(spark.createDataFrame(rows, schema), size=2000, sample_rows=50)
    two = language.dictionaries(spark.createDataFrame(rows[::-1], schema).repartition(5), size=2000, sample_rows=50)
    assert one == two and all(len(s) == 2000 for s in one.values())


def test_margin_does_not_depend_on_length(spark):
    documents = table(spark, "/root/testdata/sf0.1", "documents").select("doc_id", "text", "lang").where("text is not null")
    held_out = crc_rest(documents.doc_id, 4) == 2
    samples = language.dictionaries(documents.where(~held_out))
    texts = {lang: [r.text for r in documents.where(documents.lang == lang).orderBy("doc_id").collect()] for lang in samples}
    rows = [(f"{lang} {name}", "\n".join(parts)[:size]) for lang, parts in texts.items() for name, size in (("short", 20_000), ("long", 4_000_000))]
    assert len(dict(rows)["en long"]) == 4_000_000
    found = {r.doc_id: r for r in language.predicted(spark.createDataFrame(rows, "doc_id string, text string"), samples).withColumn("accepted", language.accepted()).collect()}
    for lang in samples:
        short, long = found[f"{lang} short"], found[f"{lang} long"]
        assert (long.lang_pred, long.accepted) == (lang, True) and long.score > short.score / 2
