"""Documents arriving as a stream, and questions arriving as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from folioseek.config import ChunkSettings
from folioseek.operators.embedders import HashedTerms
from folioseek.operators.index import ChunkIndex, add_to_index, indexed_chunks, new_segment
from folioseek.plans.answering import answer_questions
from folioseek.sources.scratch import owned


def stream_chunks(
    documents: DataFrame,
    path: str,
    checkpoint: str,
    settings: ChunkSettings = ChunkSettings(),
    embedder=HashedTerms(),
    trigger: dict | None = None,
    tasks: int | None = None,
) -> StreamingQuery:
    """Add the chunks of arriving ``(doc_id, source, full_text)`` to an index.

    Each batch is a segment named by the checkpoint and the number of the
    batch. Its counts are added to those of the version before, and the new
    version is published in one step, so a batch that is run again counts once
    and readers see whole batches. ``compact_index`` joins many small segments.
    ``tasks`` spreads batches that come in fewer files than there are cores.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        arriving = batch if tasks is None else batch.repartition(tasks, "doc_id")
        add_to_index(indexed_chunks(arriving, embedder, settings), path, embedder, new_segment(checkpoint, batch_id))

    return (
        documents.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stream_answers(
    questions: DataFrame,
    index: ChunkIndex,
    path: str,
    checkpoint: str,
    k: int = 10,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Answer arriving ``(question_id, question)`` rows.

    Each batch is answered by the batch plan and replaces its own folder, so a
    batch that is run again after a failure leaves its answers once. What a
    batch writes on its way is dropped with it.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        with owned(batch.sparkSession):
            answers = answer_questions(batch, index, k)
            answers.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        questions.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
