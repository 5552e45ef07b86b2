"""A stored inverted index: postings laid out by term, appended to and compacted.

Tables: ``postings`` (term, issue_id, positions) and ``frequencies`` (per term and block of neighbouring ids: how many
issues hold it, and how often the one that holds it most), both in folders by a hash of the term, so a search reads the folders of its own terms and no text. New or changed issues are cut into words
alone and land in a segment of their own; ids of older segments that they replace no longer count there. Frequencies
are not taken back when an issue is replaced: they choose the term that drives a match, which any choice leaves right,
and bound ranks from above, which a number too large does as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from issuequarry.operators import text_search as T
from issuequarry.operators.segments import Segments, taken_out

_SCHEMAS = {
    "postings": "term string, issue_id long, positions array<long>, bucket int",
    "frequencies": "term string, block long, df long, peak long, bucket int",
}


def _counted_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frequencies (term, block, df, peak, bucket) of each batch, in which a term's postings stand together; readers add them up."""
    for batch in batches:
        found = pa.Table.from_batches([batch]).group_by(["term", "block", "bucket"]).aggregate([("n", "count"), ("n", "max")])
        found = found.select(["term", "block", "n_count", "n_max", "bucket"]).rename_columns(["term", "block", "df", "peak", "bucket"])
        yield from found.set_column(3, "peak", found["peak"].cast(pa.int64())).to_batches()


class PostingsIndex:
    """Postings of titles and bodies stored under ``root``. Ids are unique: a batch that names one again replaces it."""

    def __init__(self, spark: SparkSession, root: str, stemmed: bool = True, buckets: int = 64):
        self.stemmed, self.buckets = stemmed, buckets
        self.tables = Segments(spark, root, _SCHEMAS)

    def _bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def _store(self, postings: DataFrame, segment: int) -> None:
        """Term folders of even files: a folder that one word makes large is split by Spark, small ones are joined."""
        columns = self.tables.columns("postings")
        laid = postings.withColumn("bucket", self._bucket(F.col("term"))).select(*columns)
        laid = laid.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "issue_id")
        stored = self.tables.write(laid, "postings", segment, "bucket")
        held = stored.select("term", T.block_of(F.col("issue_id")).alias("block"), F.size("positions").alias("n"), "bucket")
        counts = held.mapInArrow(_counted_blocks, _SCHEMAS["frequencies"])
        laid = counts.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "block")
        self.tables.write(laid, "frequencies", segment, "bucket")

    def append(self, issues: DataFrame, removed: DataFrame | None = None, version: int | None = None) -> int:
        """Add or replace issues (id, title, body), take out the ids of ``removed`` (issue_id).

        ``version`` names the outcome, so that a batch run again lands on itself. Returns the version.
        """
        held, segments = self.tables.listed(version)
        segment = version = held + 1 if version is None else version
        self.tables.write(taken_out(issues.select(F.col("id").alias("issue_id")), removed), "gone", segment)
        self._store(T.text_index(issues, self.stemmed), segment)
        self.tables.publish(version, segments | {segment: 0})
        return version

    def compact(self, version: int | None = None) -> int:
        """Lay all postings that count into one segment; no text is read. Returns the version."""
        held, segments = self.tables.listed(version)
        segment = version = held + 1 if version is None else version
        live = self.tables.counted(self.tables.read("postings", segments), segments)
        self.tables.write(self.tables.spark.createDataFrame([], self.tables.schemas["gone"]), "gone", segment)
        self._store(live.select("term", "issue_id", "positions"), segment)
        self.tables.publish(version, {segment: 0})
        return version

    def all_postings(self) -> DataFrame:
        _, segments = self.tables.listed()
        return self.tables.counted(self.tables.read("postings", segments), segments).select("term", "issue_id", "positions")

    def blocks(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Postings (term, issue_id, positions) and block statistics (term, block, df, peak) of the asked terms.

        The folders to read are named by the hashes of the terms, ``buckets`` numbers at most.
        """
        _, segments = self.tables.listed()
        asked = terms.select("term").distinct()
        folders = [r.bucket for r in asked.select(self._bucket(F.col("term")).alias("bucket")).distinct().collect()]
        inside = F.col("bucket").isin(folders)
        postings = self.tables.read("postings", segments).filter(inside).join(asked, "term", "left_semi")
        postings = self.tables.counted(postings, segments).select("term", "issue_id", "positions")
        counts = self.tables.read("frequencies", segments).filter(inside).join(asked, "term", "left_semi")
        return postings, counts.groupBy("term", "block").agg(F.sum("df").alias("df"), F.max("peak").alias("peak"))

    def lookup(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Postings (term, issue_id, positions) and frequencies (term, df) of the asked terms."""
        postings, counts = self.blocks(terms)
        return postings, counts.groupBy("term").agg(F.sum("df").alias("df"))
