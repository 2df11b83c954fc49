import random
import re

import pytest

import corpus_pipeline

WORDS = {
    "en": "the of and to in that was for with his they from had not but what some we can out other were all there when up use your how said each she".split(),
    "de": "der die und das ist nicht ich sie mit den ein zu von auf auch sich dem des für haben wird aus wie noch nach bei einen über hier kann mehr sehr".split(),
}


def prose(draw, lang, count):
    return " ".join(draw.choice(WORDS[lang]) + draw.choice(["", "", "er", "ing", "lich", "ed"]) for _ in range(count))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents with known copies, near copies, leaks and personal data, and what the stages must make of them."""
    draw = random.Random(8)
    items = [(i, prose(draw, "en", 25) + ". " + prose(draw, "en", 12) + ".") for i in range(5)]
    texts = {i: (prose(draw, "en" if i % 3 else "de", 150), "en" if i % 3 else "de") for i in range(60)}
    copies = {100 + i: texts[i] for i in range(6)} | {110 + i: (texts[i + 6][0] + " add", texts[i + 6][1]) for i in range(6)}
    leaks = {200 + i: (prose(draw, "en", 80) + " " + text + " " + prose(draw, "en", 40), "en") for i, text in items}
    private = {300: (prose(draw, "en", 60) + " mail joe.17@mail3.example.com " + prose(draw, "en", 60), "en")}
    junk = {400: (None, None), 401: ("", "en"), 402: ("1234 5678", "en")}
    rows = [(i, t, lang, ["s", "t", None][i % 3], None if t is None else len(t)) for i, (t, lang) in (texts | copies | leaks | private | junk).items()]
    folder = str(tmp_path_factory.mktemp("planted"))
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, {i: t for i, t, *_ in rows}, set(texts), set(private)


def test_stages_by_brute_force(spark, planted):
    folder, texts, clean, private = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    kept = []
    for place, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == columns or place == 4
        kept.append({r.doc_id: r for r in docs.collect()})
    assert set(kept[0]) == set(texts) - {400, 401, 402}
    assert set(kept[1]) == set(kept[0]) - set(range(100, 106)) - set(range(110, 116))
    assert set(kept[2]) == clean | private
    changed = {i for i, r in kept[3].items() if r.text != texts[i]}
    assert set(kept[3]) == set(kept[2]) and changed == private
    assert re.search(r"mail [a-z]{3}\.\d{2}@[a-p]{8}\.example\.org ", kept[3][300].text) and kept[3][300].n_chars == len(kept[3][300].text)
    taken, size = {}, {}
    for row in kept[3].values():
        size[row.source] = size.get(row.source, 0) + len(row.text.split())
    for row in kept[4].values():
        taken[row.source] = taken.get(row.source, 0) + row.taken
        assert row.copies in (1, 2) and row.source_size == size[row.source]
    target = {r.source: r.target for r in kept[4].values()}
    assert all(abs(taken[s] - target[s]) <= 200 for s in taken)


def test_run_equals_stages(spark, planted):
    folder, texts, clean, private = planted
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} <= clean | private and len(rows) > 10


def test_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
