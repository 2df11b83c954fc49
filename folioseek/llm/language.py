"""Language by compression: the language whose text makes a document's text smallest.

Each language is a Zstandard raw-content dictionary made of training texts; a
text is compressed with every dictionary, and the smallest result names its
language. Texts are reduced to lower-case letters and single spaces first, so
that symbols, digits and capitals say nothing. The margin is the share of the
second smallest result that the smallest saves; a narrow one is a rejection.
A dictionary helps the begin of what is compressed most, so a text is cut into
pieces of ``PIECE_BYTES``, each compressed anew, and the sizes are added up:
the margin of a long text is that of its pieces.

A dictionary is a sample of at most ``DICTIONARY_BYTES`` of a language's
training texts, from about ``SAMPLE_ROWS`` of its rows chosen by a hash of
``doc_id`` over the whole table; the text that reaches the size is cut there.
Prediction compresses whole texts of any length.

A text that is null or has no letter is ``und`` with score 0 and is rejected,
as is every text if there is no training text. Results of equal size go to the
language with more training rows, then to the first name. Rows without a
``lang`` teach nothing. Other columns pass through; results replace columns of
the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from folioseek.llm.common import slices

DICTIONARY_BYTES = 512 << 10
SAMPLE_ROWS = 1000
LEVEL = 5
MIN_MATCH = 3
MIN_MARGIN = 0.01
PIECE_BYTES = 16 << 10
UNKNOWN = "und"
LETTERS = "letters of the text"


def letters(text: Column) -> Column:
    """Lower-case letters with single spaces between and around; null and letterless texts are one space."""
    found = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]+", " "))
    return F.concat(F.lit(" "), F.trim(found), F.lit(" "))


def dictionaries(training: DataFrame, size: int = DICTIONARY_BYTES, sample_rows: int = SAMPLE_ROWS) -> dict[str, bytes]:
    """A sample of the texts of each language of ``training(doc_id, text, lang)``, the language with most rows first."""
    known = training.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    counts = {row["lang"]: row["rows"] for row in known.groupBy("lang").agg(F.count("*").alias("rows")).collect()}
    if not counts:
        return {}
    place = F.xxhash64("doc_id", F.lit("language"))
    scale = 1 << 30
    limit = F.element_at(
        F.create_map(*[F.lit(x) for lang, rows in counts.items() for x in (lang, min(scale, scale * sample_rows // rows + 1))]), F.col("lang")
    )
    sample = known.withColumn("place", place).where(F.pmod("place", F.lit(scale)) < limit)
    sample = sample.select("lang", "place", "doc_id", letters(F.col("text")).alias("letters"))
    order = W.partitionBy("lang").orderBy("place", "doc_id", "letters").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.octet_length("letters")).over(order), F.lit(0))
    chosen = sample.withColumn("before", before).where(F.col("before") < size)
    found: dict[str, list] = {lang: [] for lang in sorted(counts, key=lambda lang: (-counts[lang], lang))}
    for row in chosen.select("lang", "before", F.substring("letters", 1, size).alias("letters")).collect():
        found[row["lang"]].append((row["before"], row["letters"].encode()))
    return {lang: b"".join(text for _, text in sorted(texts))[:size] for lang, texts in found.items()}


def compressors(samples: dict[str, bytes]) -> list[zstandard.ZstdCompressor]:
    made = []
    for content in samples.values():
        parameters = zstandard.ZstdCompressionParameters.from_level(
            LEVEL,
            min_match=MIN_MATCH,
            write_checksum=False,
            write_content_size=False,
            write_dict_id=False,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(compression_params=parameters)
        made.append(zstandard.ZstdCompressor(dict_data=shared, compression_params=parameters))
    return made


def classified(text: bytes, made: list[zstandard.ZstdCompressor]) -> tuple[int, float]:
    """The place of the smallest result and its margin."""
    whole = memoryview(text)
    pieces = [whole[first : first + PIECE_BYTES] for first in range(0, len(whole), PIECE_BYTES)]
    sizes = [sum(len(compressor.compress(piece)) for piece in pieces) for compressor in made]
    best = int(np.argmin(sizes))
    rest = min(sizes[:best] + sizes[best + 1 :], default=None)
    return best, 1.0 if rest is None else (rest - sizes[best]) / rest


def _predictor(samples: dict[str, bytes]):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, names = compressors(samples), list(samples)
        for batch in (part for whole in batches for part in slices([whole], LETTERS)):
            found, scores = [], []
            for text in batch.column(LETTERS):
                text = text.as_buffer().to_pybytes()
                place, score = classified(text, made) if names and text.strip() else (None, 0.0)
                found.append(UNKNOWN if place is None else names[place])
                scores.append(score)
            kept = [name for name in batch.schema.names if name != LETTERS]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(name) for name in kept), pa.array(found, pa.string()), pa.array(scores, pa.float64())],
                [*kept, "lang_pred", "score"],
            )

    return predict


def classify(rows: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """``rows`` with ``lang_pred`` and ``score`` instead of their column ``LETTERS``, which ``letters`` made."""
    kept = [field for field in rows.schema if field.name != LETTERS]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predictor(samples), schema)


def predicted(documents: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """The documents with ``lang_pred`` and ``score``, the margin from 0 to 1."""
    return classify(documents.drop("lang_pred", "score").withColumn(LETTERS, letters(F.col("text"))), samples)


def accepted(min_margin: float = MIN_MARGIN) -> Column:
    return (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_margin)
