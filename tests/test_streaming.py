from folioseek.operators.index import build_index, open_index
from folioseek.plans.answering import answer_questions
from folioseek.sources.scratch import fresh_path
from folioseek.streaming.jobs import stream_answers, stream_chunks

DOCUMENTS = "doc_id long, source string, full_text string"
QUESTIONS = "question_id long, question string"


def test_documents_and_questions_as_streams(spark, tmp_path):
    first = spark.createDataFrame([(i, "s", f"alpha beta{i}. gamma delta") for i in range(5)], DOCUMENTS)
    later = spark.createDataFrame([(i, "s", f"omega beta{i}. sigma") for i in range(5, 9)], DOCUMENTS)
    source, path = str(tmp_path / "documents"), fresh_path(spark, "index")
    (tmp_path / "documents").mkdir()
    arriving = spark.readStream.schema(DOCUMENTS).parquet(source)
    for batch in (first, later):
        batch.write.mode("append").parquet(source)
        stream_chunks(arriving, path, f"{path}/checkpoint").awaitTermination()
    streamed = open_index(spark, path)
    assert streamed.version == len(streamed.meta["segments"]) == 2
    whole = build_index(first.unionByName(later), fresh_path(spark, "index"))
    columns = ["doc_id", "chunk_no", "num_chunks", "source", "text", "vec"]
    assert sorted(streamed.chunks.select(*columns).collect()) == sorted(whole.chunks.select(*columns).collect())
    assert streamed.meta["num_chunks"] == whole.meta["num_chunks"] == 9

    questions = spark.createDataFrame([(1, "alpha beta3"), (2, "sigma"), (3, "none of it")], QUESTIONS)
    asked, answers = str(tmp_path / "questions"), fresh_path(spark, "answers")
    questions.write.parquet(asked)
    stream = spark.readStream.schema(QUESTIONS).parquet(asked)
    stream_answers(stream, streamed, answers, f"{answers}-checkpoint").awaitTermination()
    expected = answer_questions(questions, whole)
    assert sorted(spark.read.parquet(answers).drop("batch_id").collect()) == sorted(expected.collect())
    # Nothing new has arrived, so a restart adds nothing.
    stream_answers(stream, streamed, answers, f"{answers}-checkpoint").awaitTermination()
    assert spark.read.parquet(answers).count() == 3
