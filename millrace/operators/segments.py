"""A lexical index that grows: immutable segments, tombstones, merges by size class, statistics added over segments.

Below a folder, every append writes one segment in one pass: postings bucketed by a hash of their term, and a head of each chunk
with its length in a bucket of their own. Chunks are counted and written where they are, without a shuffle. A deletion writes tombstones, ids that are gone from all segments before it. Which segments and tombstones count stands in a
manifest, a small table that one rename replaces, so readers see the index before or after a change and never a part. An id
that is appended again replaces the one before.

A search reads its terms' buckets of every segment, without what tombstones name, and deals what it finds by chunk: the only
shuffle of postings, of the terms asked for; the number of chunks, their mean length and
the document frequencies are sums over the segments, so scores are those of an index built at once from what is alive. When
``FAN`` segments are of one size class (a power of FAN), they become one of the next without their dead chunks, so n appends
leave O(log n) segments and each chunk is rewritten O(log n) times; a tombstone that no older segment is left for goes.

One writer at a time; readers are free.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import tokens
from millrace.operators import blockmax
from millrace.operators.core import small
from millrace.session import arrow_map, materialise
from millrace.sources import sinks

FAN, BUCKETS, HEADS = 4, 16, -1
MANIFEST = "kind string, name string, seq long, chunks long"


def _counted(cut: DataFrame) -> DataFrame:
    """``id, len, term, tf`` of chunks ``id, ws``, with a row of null term for each: a chunk's tokens are counted where they are."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            off = lists.offsets.to_numpy().astype(np.int64)
            size, rows = np.diff(off), np.arange(len(ids))
            said = pc.dictionary_encode(lists.values.slice(off[0], off[-1] - off[0]))
            words = len(said.dictionary)
            key, tf = np.unique(np.repeat(rows, size) * words + said.indices.to_numpy(), return_counts=True)
            row = np.concatenate([rows, key // max(1, words)])
            term = pa.concat_arrays([pa.nulls(len(ids), pa.string()), said.dictionary.cast(pa.string()).take(pa.array(key % max(1, words)))])
            columns = [ids.take(pa.array(row)), pa.array(size[row], pa.int32()), term, pa.array(np.concatenate([np.zeros(len(ids), np.int64), tf]))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "len", "term", "tf"])

    return arrow_map(cut, run, f"id {cut.schema['id'].dataType.simpleString()}, len int, term string, tf long")


class SegmentIndex:
    """The index below ``path``; ids are of SQL type ``id_type``."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "long"):
        self.spark, self.path, self.id_type = spark, path, id_type

    def create(self) -> SegmentIndex:
        self._commit([])
        return self

    def manifest(self) -> list[tuple]:
        """(kind, name, seq, chunks) of every segment and tombstone table: a row each, merges keep them few."""
        return sorted((tuple(r) for r in sinks.current(self.spark, f"{self.path}/manifest").select("kind", "name", "seq", "chunks").collect()), key=lambda r: r[2])

    def _commit(self, rows: list[tuple]) -> None:
        sinks.commit(self.spark.createDataFrame(rows, MANIFEST).coalesce(1), f"{self.path}/manifest")

    def append(self, chunks: DataFrame, chunk_id: str = "id", text: str = "text") -> None:
        """Adds chunks of unique ids; those that are there already are replaced."""
        rows = self.manifest()
        seq = 1 + max((r[2] for r in rows), default=0)
        cut = chunks.select(F.col(chunk_id).cast(self.id_type).alias("id"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("ws"))
        name = self._segment(_counted(cut))
        heads = self._part(name, "lengths")
        n = heads.count()
        if not n:
            return
        gone = self._tombstones(heads.select("id"), seq) if rows else []
        self._commit([*rows, *gone, ("segment", name, seq, n)])
        self._merge()

    def delete(self, ids: DataFrame, chunk_id: str = "id") -> None:
        rows = self.manifest()
        seq = 1 + max((r[2] for r in rows), default=0)
        self._commit([*rows, *self._tombstones(ids.select(F.col(chunk_id).cast(self.id_type).alias("id")), seq)])

    def _segment(self, postings: DataFrame) -> str:
        """Each task writes the buckets of its chunks."""
        name = f"segment-{uuid.uuid4().hex[:12]}"
        bucket = F.when(F.col("term").isNull(), F.lit(HEADS)).otherwise(sinks.term_bucket(F.col("term"), BUCKETS))
        postings.withColumn("bucket", bucket).sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{self.path}/{name}/postings")
        return name

    def _part(self, name: str, part: str) -> DataFrame:
        """One segment's ``lengths``, ``postings`` or, with what says which is which, ``rows`` of both."""
        rows = self.spark.read.schema(f"id {self.id_type}, len int, term string, tf long, bucket int").parquet(f"{self.path}/{name}/postings")
        return {"lengths": rows.filter(F.col("bucket") == HEADS).select("id", "len"), "postings": rows.filter(F.col("bucket") != HEADS), "rows": rows}[part]

    def _tombstones(self, ids: DataFrame, seq: int) -> list[tuple]:
        """Those of ``ids`` that some segment holds."""
        held = self._all("lengths")
        if held is None:
            return []
        name = f"gone-{uuid.uuid4().hex[:12]}"
        ids.distinct().join(held.select("id").distinct(), "id", "left_semi").write.parquet(f"{self.path}/{name}")
        n = self.spark.read.parquet(f"{self.path}/{name}").count()
        return [("gone", name, seq, n)] if n else []

    def _all(self, part: str, rows: list[tuple] | None = None) -> DataFrame | None:
        """All segments' rows of one part with their segment's ``seq``."""
        rows = self.manifest() if rows is None else rows
        parts = [self._part(r[1], part).withColumn("seq", F.lit(r[2])) for r in rows if r[0] == "segment"]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def alive(self, part: str, rows: list[tuple] | None = None) -> DataFrame | None:
        """All segments' rows without the chunks that later tombstones name."""
        rows = self.manifest() if rows is None else rows
        return self._alive(self._all(part, rows), rows)

    def _alive(self, found: DataFrame | None, rows: list[tuple]) -> DataFrame | None:
        """``found`` (``id, seq`` among others) without the chunks that later tombstones name."""
        gone = [self.spark.read.schema(f"id {self.id_type}").parquet(f"{self.path}/{r[1]}").withColumn("__until", F.lit(r[2])) for r in rows if r[0] == "gone"]
        if found is None or not gone:
            return found
        last = small(reduce(DataFrame.unionByName, gone).groupBy("id").agg(F.max("__until").alias("__until")))
        return found.join(last, "id", "left").filter("__until IS NULL OR seq >= __until").drop("__until")

    def _merge(self) -> None:
        rows = self.manifest()
        classes: dict[int, list[tuple]] = {}
        for r in rows:
            if r[0] == "segment":
                classes.setdefault(int(math.log(max(r[3], 1), FAN)), []).append(r)
        full = next((c for c in sorted(classes) if len(classes[c]) >= FAN), None)
        if full is None:
            return
        own = classes[full]
        gone = [r for r in rows if r[0] == "gone"]
        name = self._segment(self.alive("rows", [*own, *gone]).drop("seq", "bucket"))
        n = self._part(name, "lengths").count()
        # The new segment stands where the youngest of its parts stood: later tombstones apply to it, earlier ones are done.
        seq = max(r[2] for r in own)
        left = [r for r in rows if r not in own and r[0] == "segment"] + ([("segment", name, seq, n)] if n else [])
        oldest = min((r[2] for r in left), default=math.inf)
        self._commit([*left, *(r for r in gone if r[2] > oldest)])
        self._merge()

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", query: str = "query") -> DataFrame:
        """``query_id, id, score``: at least the k best chunks alive of every query, with the scores of an index built at once."""
        rows = self.manifest()
        q = blockmax.question_terms(queries, query_id, query)
        if not any(r[0] == "segment" for r in rows):
            return self.spark.createDataFrame([], f"query_id {q.schema['query_id'].dataType.simpleString()}, id {self.id_type}, score double")
        lengths = self.alive("lengths", rows).select("id", "len")
        if blockmax.few_terms(q):
            return blockmax.best_of_postings(self._by_chunk(rows), lengths, q, k)
        terms = small(q.select("term").distinct().withColumn("bucket", sinks.term_bucket(F.col("term"), BUCKETS)))
        raw = self.alive("postings", rows).join(terms, ["bucket", "term"], "left_semi").select("id", "len", "term", "tf")
        return blockmax.from_postings(materialise(raw, "postings")[0], lengths, q).best(k)

    def _by_chunk(self, rows: list[tuple]):
        """What makes ``id, len, terms, tfs`` of the chunks alive that hold some of the terms ``t, term``."""

        def found(terms: DataFrame) -> DataFrame:
            asked = F.broadcast(terms.withColumn("bucket", sinks.term_bucket(F.col("term"), BUCKETS)))  # terms of a stated query set
            held = self._all("postings", rows).join(asked, ["bucket", "term"]).select("id", "len", "seq", "t", F.col("tf").cast("int").alias("tf"))
            chunks = held.groupBy("id", "seq", "len").agg(F.collect_list(F.struct("t", "tf")).alias("p"))
            return self._alive(chunks, rows).select("id", "len", F.col("p.t").alias("terms"), F.col("p.tf").alias("tfs"))

        return found
