"""The chunk index: build, keep, add to, open and search.

An index is a folder of segments and of published versions. A segment is
written once and never changed: chunks with vectors in files of at most
``ROWS_PER_FILE`` rows in the order of ``row``, inverted blocks of them
(``postings``), in how many chunks each bucket occurs, and which file holds
which rows. A version names its segments and its statistics, and is published
in one step (``sources.versions``): a reader keeps to the version it opened
while another is written, and a build that dies leaves the old one in place.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property
from hashlib import sha256
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, functions as F, types as T

from folioseek.config import DEFAULT_K, ChunkSettings
from folioseek.functions.prompts import prefixed_question
from folioseek.operators.chunking import chunk_documents
from folioseek.operators.embedders import HashedTerms
from folioseek.operators.postings import BATCH_BLOCKS, BLOCK_CHUNKS, make_postings, postings_schema, walk
from folioseek.operators.retrieval import MAX_BLOCK_HITS, nearest
from folioseek.sources import versions
from folioseek.sources.files import spread_small
from folioseek.sources.session import small_batches, small_scans

CHUNK_KEY = ("doc_id", "chunk_no")
IDS = (*CHUNK_KEY, "segment", "row")

# Rows of a file are those that have the bits of ``row`` above these in common.
SLOT_BITS = 14
ROWS_PER_FILE = 1 << SLOT_BITS

# Small row groups, so that few texts are read for a hit, and few blocks of postings,
# whose lists are long, are decoded at a time: a reader takes up to 4,096 rows of a group.
ROW_GROUP_BYTES = 8 << 20

# A page is decompressed as one array; the collector treats those of the usual 1 MB apart and runs more often for them.
PAGE_BYTES = 1 << 18

# Buckets of a block and ends of their lists rise: the second version of the format writes the steps, where it makes no dictionary.
RISING = {"parquet.writer.version": "PARQUET_2_0"} | {f"parquet.enable.dictionary#{name}.list.element": "false" for name in ("bucket", "ends")}

# Rows of documents and chunks that a task decodes at a time, and chunks that go to Python at a time: whole blocks of postings.
SCAN_ROWS = 4 * BLOCK_CHUNKS

# Ranges of rows that are pushed down to the scan for texts.
MAX_RANGES = 64

FILES = "segment bigint, slot bigint, file string, num_rows bigint"
STATISTICS = "bucket int, df bigint"


def indexed_chunks(corpus: DataFrame, embedder, settings: ChunkSettings = ChunkSettings()) -> DataFrame:
    """Chunk rows with vectors, from ``(doc_id, source, full_text)``, in one pass without a shuffle."""
    documents = corpus.select("doc_id", "source", "full_text")
    return embedder.vectorize_chunks(chunk_documents(documents, settings=settings))


@dataclass(frozen=True)
class ChunkIndex:
    """One version of the index below ``path``, opened with its embedder."""

    spark: SparkSession
    path: str
    embedder: object
    version: int
    meta: dict

    def _read(self, name: str) -> list[str]:
        return [f"{self.path}/segments/{segment['id']}/{name}" for segment in self.meta["segments"]]

    @cached_property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.meta["schema"]))

    @cached_property
    def chunks(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self._read("chunks"))

    @cached_property
    def prepared(self):
        """What scoring needs to know of the whole index; bounded by the embedder's ``dim``."""
        return _prepared(self.spark, self.path, self.meta, self.embedder)

    def retrieve(self, questions: DataFrame, k: int = DEFAULT_K, prefix: str | None = None) -> DataFrame:
        """``(question_id, rank, score, doc_id, chunk_no)`` of the k best chunks; searched when called."""
        return self._search(questions, k, prefix, lambda hits: hits.drop("segment", "row"))

    def retrieve_texts(
        self, questions: DataFrame, k: int = DEFAULT_K, prefix: str | None = None
    ) -> DataFrame:
        """``retrieve`` with the ``source`` and ``text`` of each chunk."""

        def attach(hits: DataFrame) -> DataFrame:
            # The hits of a block of questions are bounded, see ``nearest``;
            # only a block of one question may go beyond, by its k.
            bounded = k <= MAX_BLOCK_HITS
            texts = self._files_with(hits, bounded).select("segment", "row", "source", "text")
            return texts.join(F.broadcast(hits) if bounded else hits, ["segment", "row"]).drop("segment", "row")

        return self._search(questions, k, prefix, attach)

    def _files_with(self, hits: DataFrame, bounded: bool) -> DataFrame:
        """The chunks of the files that hold ``hits``, with the row groups left out that cannot."""
        if not bounded:
            slots = hits.select("segment", _slot(F.col("row")).alias("slot")).distinct()
            return self._texts(self._files().join(slots, ["segment", "slot"], "left_semi"))
        rows = hits.select("segment", "row").toArrow()
        segment, row = (rows[name].to_numpy() for name in ("segment", "row"))
        places = np.unique(np.stack([segment, row >> SLOT_BITS], axis=1), axis=0)
        slots = self.spark.createDataFrame(pa.table({"segment": places[:, 0], "slot": places[:, 1]}))
        texts = self._texts(self._files().join(F.broadcast(slots), ["segment", "slot"], "left_semi"))
        return texts.where(_in_ranges(row)) if len(row) else texts

    def _files(self) -> DataFrame:
        return self.spark.read.schema(FILES).parquet(*self._read("files"))

    def _texts(self, files: DataFrame) -> DataFrame:
        """The chunks of ``files``; there are as many names as hits at most, or as files of the index."""
        found = files.select("segment", "file").distinct().collect()
        paths = sorted(f"{self.path}/segments/{row['segment']}/chunks/{row['file']}" for row in found)
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.chunks.where(F.lit(False))

    def _search(self, questions: DataFrame, k: int, prefix: str | None, attach) -> DataFrame:
        prefix = self.embedder.prefix if prefix is None else prefix
        asked = questions.select("question_id", prefixed_question(F.col("question"), prefix).alias("text"))
        return nearest(
            self.embedder.vectorize(asked),
            self.chunks,
            self.embedder,
            ids=IDS,
            k=k,
            prepared=self.prepared,
            attach=attach,
            walk=self._postings(k) if self.embedder.uses_statistics else None,
            batch_rows=BATCH_BLOCKS if self.embedder.uses_statistics else None,
        )

    def _postings(self, k: int):
        slack = {segment["id"]: segment["slack"] for segment in self.meta["segments"]}
        types = {name: self.schema[name].dataType.simpleString() for name in IDS}
        lists = {name: kind for name, kind in types.items() if name != "segment"}
        schema = f"{postings_schema(lists)}, segment bigint"
        return self.spark.read.schema(schema).parquet(*self._read("postings")), walk(IDS, k, slack), types


def _slot(row: Column) -> Column:
    return F.shiftright(row, SLOT_BITS)


def _in_ranges(rows: np.ndarray, most: int = MAX_RANGES) -> Column:
    """A condition on ``row`` that Parquet can check on its statistics: the rows in ranges, cut where they are furthest apart."""
    rows = np.sort(rows)
    gaps = np.diff(rows)
    cuts = np.sort(np.argsort(-gaps, kind="stable")[: most - 1])
    ends = np.append(rows[cuts], rows[-1]).tolist()
    starts = np.append(rows[0], rows[cuts + 1]).tolist()
    return F.expr(" OR ".join(f"row BETWEEN {low} AND {high}" for low, high in zip(starts, ends)))


def _prepared(spark: SparkSession, path: str, meta: dict, embedder):
    if not embedder.uses_statistics:
        return None
    return embedder.prepare(spark.read.schema(STATISTICS).parquet(f"{path}/{meta['statistics']}"), meta["num_chunks"])


def build_index(
    corpus: DataFrame, path: str, settings: ChunkSettings = ChunkSettings(), embedder=HashedTerms()
) -> ChunkIndex:
    """Chunk and embed a corpus and replace what is published below ``path``."""
    return _write_index(indexed_chunks(spread_small(corpus, "doc_id"), embedder, settings), path, embedder)


def index_chunks(chunks: DataFrame, path: str, embedder=HashedTerms()) -> ChunkIndex:
    """Index chunks that were made elsewhere, from a user's tokenizer or from blocks.

    ``chunks``: ``doc_id, source, chunk_no, num_chunks, text``.
    """
    rows = chunks.select("doc_id", "source", "chunk_no", "num_chunks", "text")
    return _write_index(embedder.vectorize(rows), path, embedder)


def _write_index(chunks: DataFrame, path: str, embedder) -> ChunkIndex:
    segment = write_segment(chunks, path, embedder, new_segment())
    return _published(chunks.sparkSession, path, embedder, segment, replace=True)


def add_to_index(chunks: DataFrame, path: str, embedder, segment: int | None = None) -> ChunkIndex:
    """Add chunks with vectors, as ``indexed_chunks`` makes them, to what is published, or publish them first.

    ``segment`` names the addition: one that is published already is not added again.
    """
    spark = chunks.sparkSession
    segment = new_segment() if segment is None else segment
    number, base = versions.current(spark, path)
    if base and segment in [part["id"] for part in base["segments"]]:
        return ChunkIndex(spark, path, embedder, number, base)
    return _published(spark, path, embedder, write_segment(chunks, path, embedder, segment), replace=False)


def compact_index(index: ChunkIndex) -> ChunkIndex:
    """One segment in place of those of ``index``, which has to be the present version."""
    segment = write_segment(index.chunks.drop("segment", "row"), index.path, index.embedder, new_segment())
    return _published(index.spark, index.path, index.embedder, segment, replace=True, after=index.version)


def drop_unused(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Drop all but the newest ``keep`` versions and the folders that only the others use.

    To be called while nothing is written to the index. Readers of dropped
    versions fail. Returns the names of the dropped folders.
    """
    kept = [versions.read(spark, path, number) for number in versions.drop_versions(spark, path, keep)]
    segments = {str(segment["id"]) for meta in kept for segment in meta["segments"]}
    gone = versions.drop_folders(spark, f"{path}/segments", segments)
    return gone + versions.drop_folders(spark, f"{path}/statistics", {meta["statistics"].split("/")[-1] for meta in kept if meta["statistics"]})


def new_segment(*names: object) -> int:
    """A number for a segment: one that ``names`` stand for, or that nobody else has."""
    text = " ".join(map(str, names)) if names else uuid4().hex
    return int.from_bytes(sha256(text.encode()).digest()[:7], "big")


def _writer(rows: DataFrame) -> DataFrameWriter:
    return rows.write.mode("overwrite").options(**{"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES})


def write_segment(chunks: DataFrame, path: str, embedder, segment: int) -> dict:
    """Write the chunks of a segment, their counts and their files; a repeated attempt replaces its own."""
    spark, folder = chunks.sparkSession, f"{path}/segments/{segment}"
    rows = chunks.withColumns({"segment": F.lit(segment).cast("long"), "row": F.monotonically_increasing_id()})
    with small_scans(spark, SCAN_ROWS):
        # Texts are most of an index, and a search reads few of them.
        _writer(rows).options(maxRecordsPerFile=ROWS_PER_FILE, compression="zstd").parquet(f"{folder}/chunks")
    stored = spark.read.schema(rows.schema).parquet(f"{folder}/chunks")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    files = stored.groupBy("segment", _slot(F.col("row")).alias("slot"), name.alias("file")).agg(F.count("*").alias("num_rows"))
    files.write.mode("overwrite").parquet(f"{folder}/files")
    if embedder.uses_statistics:
        with small_scans(spark, SCAN_ROWS):
            embedder.statistics(stored).write.mode("overwrite").parquet(f"{folder}/statistics")
    count = spark.read.schema(FILES).parquet(f"{folder}/files").agg(F.coalesce(F.sum("num_rows"), F.lit(0))).first()[0]
    return {"id": segment, "num_chunks": count, "schema": rows.schema.json(), "stored": stored}


def _published(spark: SparkSession, path: str, embedder, segment: dict, replace: bool, after: int | None = None) -> ChunkIndex:
    """Publish a version with the segment, in place of the others or beside them."""
    stored, used = segment.pop("stored"), None
    while True:
        number, base = versions.current(spark, path)
        if after is not None and number != after:
            raise versions.VersionTaken(f"version {number} of {path} is newer than {after}")
        others: Sequence[dict] = [] if replace or not base else base["segments"]
        if segment["id"] in [part["id"] for part in others]:
            return ChunkIndex(spark, path, embedder, number, base)
        if others and (base["embedder"], base["dim"]) != (embedder.name, embedder.dim):
            raise ValueError(f"index holds vectors of {(base['embedder'], base['dim'])}, not of {(embedder.name, embedder.dim)}")
        meta = {
            "embedder": embedder.name,
            "dim": embedder.dim,
            "num_chunks": segment["num_chunks"] + (base["num_chunks"] if others else 0),
            "schema": segment["schema"],
            "segments": [],
            "statistics": None,
        }
        own = {"id": segment["id"], "num_chunks": segment["num_chunks"], "slack": 1.0}
        if embedder.uses_statistics:
            meta["statistics"] = f"segments/{segment['id']}/statistics"
            if others:
                both = spark.read.schema(STATISTICS).parquet(f"{path}/{base['statistics']}", f"{path}/{meta['statistics']}")
                meta["statistics"] = f"statistics/{uuid4().hex}"
                both.groupBy("bucket").agg(F.sum("df").alias("df")).write.parquet(f"{path}/{meta['statistics']}")
            weights = _prepared(spark, path, meta, embedder)
            if used is None:
                used = weights
                postings = make_postings(stored, embedder.column, (*CHUNK_KEY, "row"), used)
                postings = postings.withColumn("segment", F.lit(segment["id"]).cast("long"))
                with small_batches(spark, SCAN_ROWS):
                    _writer(postings).options(**RISING).parquet(f"{path}/segments/{segment['id']}/postings")
            own["slack"] = _widening(used, weights)
            if others:
                wider = _widening(_prepared(spark, path, base, embedder), weights)
                others = [part | {"slack": part["slack"] * wider} for part in others]
        meta["segments"] = [*others, own]
        try:
            versions.publish(spark, path, number + 1, meta)
        except versions.VersionTaken:
            if after is not None:
                raise
            continue  # another writer was faster; its version is the base now
        return ChunkIndex(spark, path, embedder, number + 1, meta)


def _widening(before: np.ndarray, now: np.ndarray) -> float:
    """By how much shares can have grown between two squared weights: a vector shrinks no more than its weights."""
    return float(np.sqrt(max(1.0, (before / now).max())))


def open_index(spark: SparkSession, path: str, embedder=HashedTerms()) -> ChunkIndex:
    """Open the present version of an index; its questions must be embedded as its chunks were."""
    number, meta = versions.current(spark, path)
    if meta is None:
        raise FileNotFoundError(f"no index is published in {path}")
    stored = (meta["embedder"], meta["dim"])
    if stored != (embedder.name, embedder.dim):
        raise ValueError(f"index holds vectors of {stored}, not of {(embedder.name, embedder.dim)}")
    return ChunkIndex(spark, path, embedder, number, meta)
