"""Overlapping token windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from folioseek.config import ChunkSettings
from folioseek.functions.text import let, tokens
from folioseek.sources.scratch import written

# Texts of a user's tokenizer whose chunks are Python values at a time.
TOKENIZED_TEXTS = 64

# Tokens of a document of blocks up to which it is put together in one row.
WHOLE_TOKENS = 1 << 18


def token_windows(text: Column, settings: ChunkSettings = ChunkSettings()) -> Column:
    """``array<struct(chunk_no, num_chunks, chunk)>`` of a text.

    Windows start at 0, step, 2*step, ... while the start is a token. They are
    cut inside the row that holds the text.
    """

    def cut(words: Column) -> Column:
        last = F.floor((F.size(words) - 1) / settings.step).cast("int")
        window = lambda i: F.slice(words, i * settings.step + 1, F.lit(settings.size))
        numbers = F.when(F.size(words) > 0, F.sequence(F.lit(0), last)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(
            numbers,
            lambda i: F.struct(
                i.alias("chunk_no"),
                (last + 1).alias("num_chunks"),
                F.array_join(window(i), " ").alias("chunk"),
            ),
        )

    return let(tokens(text), cut)


def _explode_windows(documents: DataFrame, text: str, windows: Column) -> DataFrame:
    kept = [name for name in documents.columns if name != text]
    # The windows are an argument of the generator and not a column of their
    # own: for a column Spark would add a filter on its size, and compute the
    # windows a second time to answer it.
    return documents.select(*kept, F.inline(windows)).withColumnRenamed("chunk", "text")


def chunk_documents(
    documents: DataFrame, text: str = "full_text", settings: ChunkSettings = ChunkSettings()
) -> DataFrame:
    """One row per chunk: other columns, ``chunk_no``, ``num_chunks``, ``text``."""
    return _explode_windows(documents, text, token_windows(F.col(text), settings))


def chunk_blocks(
    blocks: DataFrame,
    order: Sequence[str],
    key: str = "doc_id",
    text: str = "text",
    settings: ChunkSettings = ChunkSettings(),
) -> DataFrame:
    """``(key, chunk_no, num_chunks, text)`` of documents given as blocks of text.

    ``order`` are the columns that put the blocks of a document in sequence; a
    block ends where a token ends. The result is that of ``chunk_documents``
    over the joined blocks. Documents of up to ``WHOLE_TOKENS`` are joined, so
    their words move once. A larger one, of any size, stays spread over the
    tasks: only the token counts of its blocks are summed up in one place, and
    each chunk is put together from the blocks that it touches.
    """
    place = F.struct(*order).alias("place")
    words = let(
        tokens(F.col(text)),
        lambda found: F.struct(F.size(found).cast("long").alias("n"), F.array_join(found, " ").alias("words")),
    )
    # Written once, then read for the counts alone and for the words. Blocks
    # without words are left out after that: a filter before would tokenize twice.
    found = written(blocks.select(key, place, words.alias("found")), "blocks", compression="zstd")
    blocks = found.select(key, "place", "found.n", "found.words").where((F.col("n") > 0) & F.col(key).isNotNull())
    # No more than one in ``WHOLE_TOKENS`` of all words, so few enough to be broadcast.
    large = F.broadcast(blocks.groupBy(key).agg(F.sum("n").alias("total")).where(F.col("total") > WHOLE_TOKENS).select(key))
    in_order = F.sort_array(F.collect_list(F.struct("place", "words")))
    whole = blocks.join(large, key, "left_anti").groupBy(key).agg(F.array_join(in_order["words"], " ").alias(text))
    pieced = _chunks_of_pieces(blocks.join(large, key, "left_semi"), key, settings)
    return chunk_documents(whole, text, settings).select(pieced.columns).unionByName(pieced)


def _chunks_of_pieces(blocks: DataFrame, key: str, settings: ChunkSettings) -> DataFrame:
    """``(key, chunk_no, num_chunks, text)`` of ``key, place, n, words``, each chunk from the blocks that it touches."""
    whole = Window.partitionBy(key)
    before = whole.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocks.select(
        key,
        "place",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
        F.sum("n").over(whole).alias("total"),
    )
    start, end = F.col("start"), F.col("start") + F.col("n")
    first = F.greatest(F.floor((start - settings.size) / settings.step) + 1, F.lit(0))
    last = F.floor((end - 1) / settings.step)

    def piece(words: Column, chunk_no: Column) -> Column:
        opens = F.greatest(chunk_no * settings.step, start)
        closes = F.least(chunk_no * settings.step + settings.size, end)
        part = F.slice(words, (opens - start + 1).cast("int"), (closes - opens).cast("int"))
        return F.struct(chunk_no.cast("int").alias("chunk_no"), F.array_join(part, " ").alias("piece"))

    pieces = let(
        F.split("words", " "),
        lambda words: F.transform(F.sequence(first, last), lambda chunk_no: piece(words, chunk_no)),
    )
    num_chunks = F.ceil(F.col("total") / settings.step).cast("int").alias("num_chunks")
    # A chunk has at most ``size`` tokens, and so at most as many pieces.
    in_order = F.sort_array(F.collect_list(F.struct("place", "piece")))
    return (
        blocks.join(counts, [key, "place"])
        .select(key, "place", num_chunks, F.inline(pieces))
        .groupBy(key, "chunk_no")
        .agg(F.first("num_chunks").alias("num_chunks"), F.array_join(in_order["piece"], " ").alias("text"))
    )


def chunk_with_tokenizer(
    documents: DataFrame,
    encode: Callable[[str], Sequence],
    decode: Callable[[Sequence], str],
    text: str = "full_text",
    settings: ChunkSettings = ChunkSettings(),
) -> DataFrame:
    """Chunks in the tokens of a user's tokenizer, such as byte pairs.

    ``encode`` gives the tokens of a text, ``decode`` the text of some tokens.
    """
    window = T.StructType(
        [
            T.StructField("chunk_no", T.IntegerType()),
            T.StructField("num_chunks", T.IntegerType()),
            T.StructField("chunk", T.StringType()),
        ]
    )

    def cut(texts: pa.Array) -> tuple[list[int], pa.StructArray]:
        counts, numbers, chunks = [], [], []
        for value in texts:
            text = value.as_py()
            ids = encode(text) if text else []
            starts = range(0, len(ids), settings.step)
            counts.append(len(starts))
            numbers += range(len(starts))
            chunks += [decode(ids[at : at + settings.size]) for at in starts]
        totals = [count for count in counts for _ in range(count)]
        columns = [pa.array(numbers, pa.int32()), pa.array(totals, pa.int32()), pa.array(chunks, pa.string())]
        return counts, pa.StructArray.from_arrays(columns, [field.name for field in window])

    @F.arrow_udf(T.ArrayType(window))
    def windows(texts: pa.Array) -> pa.Array:
        # A batch has up to 10,000 texts; the chunks of a few at a time go over to Arrow.
        parts = [cut(texts.slice(top, TOKENIZED_TEXTS)) for top in range(0, len(texts), TOKENIZED_TEXTS)]
        ends = accumulate((count for counts, _ in parts for count in counts), initial=0)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays([part for _, part in parts]))

    return _explode_windows(documents, text, windows(F.col(text)))


def chunk_metadata(chunks: DataFrame, keys: Sequence[str] = ("doc_id", "chunk_no")) -> DataFrame:
    """Everything of a chunk but its text and count, as one map per row."""
    left_out = {"text", "num_chunks", "vec", "part", *keys}
    names = [name for name in chunks.columns if name not in left_out]
    entries = [part for name in names for part in (F.lit(name), F.col(name).cast("string"))]
    return chunks.select(*keys, F.create_map(*entries).alias("metadata"))
