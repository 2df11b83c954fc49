"""Registered queries: every one reads whole tables of a scale directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioseek.config import MODELS, ChunkSettings, model_settings
from folioseek.functions.screening import is_good_answer
from folioseek.functions.prompts import prefixed_question
from folioseek.functions.text import clean_layout_text
from folioseek.functions.vectors import term_frequencies
from folioseek.operators import answers as ans
from folioseek.operators import chunking, contexts, layout, pages
from folioseek.operators.chat import chat_history as history_rows
from folioseek.operators.embedders import HashedTerms, UserVectors, register_embedder
from folioseek.operators.index import build_index, open_index
from folioseek.operators.retrieval import nearest
from folioseek.plans.answering import answer_questions, answer_questions_with_model
from folioseek.plans.ingest import ingest
from folioseek.plans.evaluation import EvaluatedModel, evaluate_models, log_evaluation, log_run_parameters
from folioseek.sources.files import decode_pages, spare_cores
from folioseek.sources.scratch import fresh_path, owned
from folioseek.sources.tables import ensure_questions, project_corpus, save_corpus
from folioseek.streaming.jobs import stream_answers as answer_stream, stream_chunks
from workload import fixtures as fx

SMALL = ChunkSettings(64, 8)
LARGE = ChunkSettings(2000, 300)


# Corpus


def page_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = pages.split_pages(fx.spread_corpus(spark, sf_dir), "full_text")
    return split.select("doc_id", "source", "page", "full_text")


def _line_pages(content: bytes) -> list[str]:
    """A stand-in for a decoder of binary files: every line is a page."""
    return content.decode("utf-8").split("\n")


def page_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fx.spread_corpus(spark, sf_dir)
    files = documents.select(F.col("doc_id").cast("string").alias("source"), F.encode("full_text", "utf-8").alias("content"))
    return decode_pages(files, _line_pages)


def corpus_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return save_corpus(fx.corpus(spark, sf_dir), f"{fx.fresh_database(spark)}.corpus")


def corpus_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project_corpus(fx.corpus(spark, sf_dir))


def corpus_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.count_rows(fx.corpus(spark, sf_dir))


def longest_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.longest_document(fx.corpus(spark, sf_dir)).select("doc_id", "n_chars", "full_text")


# Chunks


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(fx.spread_corpus(spark, sf_dir))


def chunk_documents_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_documents(fx.spread_corpus(spark, sf_dir), settings=SMALL)


def chunk_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    longest = pages.longest_document(fx.corpus(spark, sf_dir)).drop("n_chars")
    return chunking.chunk_documents(longest, settings=LARGE)


def chunk_user_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's tokenizer: every character is a token."""
    documents = fx.spread_corpus(spark, sf_dir)
    return chunking.chunk_with_tokenizer(documents, encode=list, decode="".join)


def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_documents(fx.spread_corpus(spark, sf_dir))
    metadata = chunking.chunk_metadata(chunks)
    return metadata.select("doc_id", "chunk_no", F.to_json("metadata").alias("metadata"))


# Layout


def layout_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = fx.layout_cells(spark, sf_dir)
    return cells.select("doc_id", "table_idx", "cell_idx", clean_layout_text(F.col("content")).alias("clean"))


def layout_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.kept_paragraphs(fx.page_paragraphs(spark, sf_dir), fx.page_cells(spark, sf_dir))


def layout_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    headed = layout.with_headings(fx.layout_cells(spark, sf_dir))
    return headed.select("doc_id", "table_idx", "cell_idx", "column_index", "heading")


def layout_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.cell_lines(fx.layout_cells(spark, sf_dir), reset_per_table=True)


def layout_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.flatten_layout(fx.layout_paragraphs(spark, sf_dir), fx.layout_cells(spark, sf_dir))


def layout_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = layout.layout_blocks(
        fx.layout_paragraphs(spark, sf_dir), fx.layout_cells(spark, sf_dir), block_rows=32
    )
    return chunking.chunk_blocks(blocks, ["section", "table_idx", "blk"])


# Files to an index


def _ingested(spark: SparkSession, sf_dir: str, **reader) -> DataFrame:
    table, path = f"{fx.fresh_database(spark)}.corpus", fresh_path(spark, "index")
    with owned(spark):
        index = ingest(fx.document_files(spark, sf_dir), table, path, **reader)
    pages = spark.table(table).select("doc_id", "page")
    return index.chunks.join(pages, "doc_id").select("doc_id", "source", "page", "chunk_no", "num_chunks", "text")


def _twenty_lines(content: bytes) -> list[str]:
    """A stand-in for a decoder of binary files: every 20 lines are a page."""
    lines = content.decode("utf-8").removesuffix("\f").split("\n")
    return ["\n".join(lines[i : i + 20]) for i in range(0, len(lines), 20)]


def ingest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir, decode=_twenty_lines)


def _lines_and_a_table(content: bytes) -> dict[str, list[dict]]:
    """A stand-in for a layout service: lines are paragraphs, their lengths a table."""
    lines = content.decode("utf-8").removesuffix("\f").split("\n")
    cells = [
        {"table_idx": 0, "cell_idx": i, "row_index": i, "column_index": 0, "kind": "content", "content": str(len(line))}
        for i, line in enumerate(lines)
    ]
    return {"paragraphs": [{"role": None, "content": line} for line in lines], "cells": cells}


def ingest_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ingested(spark, sf_dir, analyze=_lines_and_a_table)


# Vectors and retrieval


def embed_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunking.chunk_documents(fx.spread_corpus(spark, sf_dir))
    vectors = HashedTerms().vectorize_chunks(chunks)
    return vectors.select("doc_id", "chunk_no", F.inline(term_frequencies(F.col("vec"))))


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "index")
    build_index(fx.corpus(spark, sf_dir), path)
    return _index_rows(open_index(spark, path))


def _index_rows(index) -> DataFrame:
    return index.chunks.select(
        "doc_id",
        "chunk_no",
        "num_chunks",
        "source",
        "text",
        F.size(F.array_distinct("vec")).alias("num_buckets"),
        F.size("vec").alias("num_tokens"),
    )


def question_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.questions(spark, sf_dir).select(
        "question_id", prefixed_question(F.col("question")).alias("text")
    )


def retrieve_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = fx.index(spark, sf_dir).retrieve(fx.questions(spark, sf_dir))
    return hits.withColumn("score", F.round("score", 6))


def retrieve_with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir)
    return hits.select("question_id", "rank", "doc_id", "chunk_no", "source", "text")


def retrieve_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = fx.spread_small(fx.table(spark, sf_dir, "embeddings"), "vec_id")
    embedder = UserVectors("given", 64, column="embedding")
    hits = nearest(fx.label_centroids(spark, sf_dir), stored, embedder, ids=["vec_id"], k=10)
    return hits.select("question_id", "rank", "vec_id", F.round(-F.col("score"), 6).alias("distance"))


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.index(spark, sf_dir).retrieve_texts(fx.questions(spark, sf_dir))


# Contexts and prompts


def context_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.context_groups(_hits(spark, sf_dir))


def context_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.running_contexts(_hits(spark, sf_dir))


def context_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.top_context(_hits(spark, sf_dir))


def prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompts = ans.render_prompts(
        context_groups(spark, sf_dir), fx.questions(spark, sf_dir), model_settings().template
    )
    return prompts.select("question_id", "group_no", "prompt")


def prompt_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ans.render_prompts_by_model(
        context_groups(spark, sf_dir), fx.questions(spark, sf_dir), list(MODELS.values())
    )


# Answers


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ans.answer_extractive(context_groups(spark, sf_dir), fx.questions(spark, sf_dir))


def answer_extractive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir)


def answer_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = fx.table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", is_good_answer(F.col("text")).alias("good"))


def first_good_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = fx.questions(spark, sf_dir)
    return ans.first_good_answers(_candidates(spark, sf_dir), questions).drop("question")


def qa_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_questions(fx.questions(spark, sf_dir), fx.index(spark, sf_dir))


def _prompt_length(prompt: str) -> str:
    """A stand-in for a model that answers prompts of even length only."""
    return "I don't know" if len(prompt) % 2 else f"{len(prompt)} characters"


def qa_user_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = answer_questions_with_model(
        fx.questions(spark, sf_dir), fx.index(spark, sf_dir), _prompt_length
    )
    return answers.drop("output_metadata", "error")


def _often_busy(prompt: str) -> str:
    """A stand-in for a model that stays busy for every third length of a prompt."""
    if len(prompt) % 3 == 0:
        raise ans.ModelBusy
    return _prompt_length(prompt)


def qa_busy_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = answer_questions_with_model(
        fx.questions(spark, sf_dir), fx.index(spark, sf_dir), _often_busy, timeout_sec=0.05, pause_sec=0.02
    )
    return answers.select("question_id", "answer", "error")


def answer_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ans.answer_view(qa_batch(spark, sf_dir))


def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history_rows(fx.table(spark, sf_dir, "conversations"))


# Evaluation


def eval_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"{fx.fresh_database(spark)}.eval_questions"
    asked = fx.questions(spark, sf_dir)
    ensure_questions(asked, name)
    # The table is there now, so other questions must not replace it.
    return ensure_questions(asked.withColumn("question", F.lower("question")), name)


def eval_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"{fx.fresh_database(spark)}.eval_log"
    return log_evaluation(qa_batch(spark, sf_dir), list(MODELS.values()), name, "first run")


# Stand-ins for the embedders of two models, and a function that answers as its options say.
EMBEDDERS = {"BAAI/bge-large-en": HashedTerms(), "text-embedding-ada-002": HashedTerms(dim=4096)}
EVALUATED = ("openai", "Llama-2-13b-chat-hf")


def _length_and_temperature(options):
    temperature = options["temperature"]
    return lambda prompt: "I don't know" if len(prompt) % 2 else f"{len(prompt)} characters at {temperature}"


def eval_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name, embedder in EMBEDDERS.items():
        register_embedder(name, lambda embedder=embedder: embedder)
    indexes = {name: fx.index(spark, sf_dir, embedder).path for name, embedder in EMBEDDERS.items()}
    models = [EvaluatedModel(MODELS[name], _length_and_temperature) for name in EVALUATED]
    table = f"{fx.fresh_database(spark)}.eval_models"
    return evaluate_models(fx.questions(spark, sf_dir), models, indexes, table, "first run")


def run_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"{fx.fresh_database(spark)}.run_params"
    return log_run_parameters(fx.questions(spark, sf_dir), "benchmark", list(MODELS.values()), name, "first run")


# Streams


def _arriving(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files.

    The path is a pattern, as it may name one file, which a plain path may not.
    """
    schema = fx.table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _arriving(spark, sf_dir, "documents")
    arriving = documents.select("doc_id", "source", F.col("text").alias("full_text"))
    path = fresh_path(spark, "stream-index")
    tasks = spare_cores(fx.table(spark, sf_dir, "documents"))
    stream_chunks(arriving, path, f"{path}/checkpoint", tasks=tasks).awaitTermination()
    return _index_rows(open_index(spark, path))


def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _arriving(spark, sf_dir, "benchmark")
    arriving = asked.select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
    path = fresh_path(spark, "stream-answers")
    index = fx.index(spark, sf_dir)
    answer_stream(arriving, index, f"{path}/answers", f"{path}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{path}/answers").drop("batch_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        page_split,
        page_decode,
        corpus_table,
        corpus_project,
        corpus_count,
        longest_document,
        chunk_documents,
        chunk_documents_small,
        chunk_longest,
        chunk_user_tokens,
        chunk_metadata,
        layout_clean,
        layout_paragraphs,
        layout_headers,
        layout_cells,
        layout_flatten,
        layout_chunks,
        ingest_pages,
        ingest_layout,
        embed_hashed,
        index_build,
        question_prefix,
        retrieve_sparse,
        retrieve_with_source,
        retrieve_dense,
        context_groups,
        context_running,
        context_top3,
        prompt_render,
        prompt_by_model,
        answer_extractive,
        answer_screen,
        first_good_answer,
        qa_batch,
        qa_user_model,
        qa_busy_model,
        answer_view,
        chat_history,
        eval_questions,
        eval_log,
        eval_models,
        run_params,
        stream_index,
        stream_answers,
    )
}
