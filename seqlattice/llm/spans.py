"""Long exact spans shared between records, by compaction of a De Bruijn graph.

Edges of the graph are the windows of ``span`` residues; an edge is repeated if it lies in two records. Whether a window
can be repeated is settled on few rows first: each window has an anchor, the least hash of its ``anchor``-residue windows,
and equal windows have equal anchors. Only windows whose anchor lies in two records become edges. Runs of repeated edges
without a branch compact to paths through joins, and the residues at the source coordinates verify each path.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlattice.functions.residues import residues
from seqlattice.llm.kernels import residue_codes, whole_windows, window_hashes, window_minima
from seqlattice.workspace import lookup_hot, stored


def _anchors(batch: pa.RecordBatch, span: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    codes, starts = residue_codes(batch.column(1))
    at, text = whole_windows(starts, span)
    least = window_minima(window_hashes(codes, anchor), span - anchor + 1)[at] if len(at) else np.zeros(0, np.uint64)
    return codes, at, text, least.view(np.int64)


def anchors(records: DataFrame, span: int, anchor: int) -> DataFrame:
    """(anchor, id): the anchors of all windows of every record, each once per run."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, text, least = _anchors(batch, span, anchor)
            first = np.ones(len(least), bool)
            first[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
            ids = batch.column(0).to_numpy(zero_copy_only=False)[text[first]]
            yield pa.RecordBatch.from_arrays([pa.array(least[first]), pa.array(ids, pa.int64())], names=["anchor", "id"])

    return records.select("id", "seq").mapInArrow(of, "anchor bigint, id bigint")


def edges(records: DataFrame, span: int, anchor: int) -> DataFrame:
    """(edge, id, pos): all windows of every record whose anchor is in its array ``anchors``; pos from 1."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, at, text, least = _anchors(batch, span, anchor)
            start = np.searchsorted(text, np.arange(len(batch) + 1))
            wanted = np.zeros(len(at), bool)
            for k, own in enumerate(batch.column(2)):
                part = slice(start[k], start[k + 1])
                wanted[part] = np.isin(least[part], own.values.to_numpy(zero_copy_only=False))
            _, starts = residue_codes(batch.column(1))
            at, text = at[wanted], text[wanted]
            edge = window_hashes(codes, span, 7)[at].view(np.int64) if len(at) else np.zeros(0, np.int64)
            ids = batch.column(0).to_numpy(zero_copy_only=False)[text]
            yield pa.RecordBatch.from_arrays([pa.array(edge), pa.array(ids, pa.int64()), pa.array((at - starts[text] + 1).astype(np.int32))], names=["edge", "id", "pos"])

    return records.select("id", "seq", "anchors").mapInArrow(of, "edge bigint, id bigint, pos int")


def _in_two(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of the keys that lie in two records; counted before the shuffle, so a frequent key is no large group."""
    return df.groupBy(key).agg(F.min("id").alias("_a"), F.max("id").alias("_b"), F.count(F.lit(1)).alias("n")).filter("_a < _b").select(key, "n")


def paths(records: DataFrame, span: int = 40, anchor: int = 16) -> DataFrame:
    """(id, path, start, end, text): every occurrence of every compacted path that lies in two records.

    ``records`` has bigint id, string seq and loaded_at, by which the last of several deliveries of an id counts. Residues
    are the letters of seq in upper case, from 1. Records that are null, empty or shorter than ``span`` have none; a span
    that recurs within one record only is not shared. ``anchor`` must not exceed ``span``.
    """
    rows = records.select("id", "seq", "loaded_at").filter("id is not null and seq is not null")
    found = stored(anchors(rows, span, anchor), "anchors")
    own = lookup_hot(found, _in_two(found, "anchor"), "anchor", count="n").groupBy("id").agg(F.collect_set("anchor").alias("anchors"))
    last = rows.join(own, "id").groupBy("id").agg(F.max(F.struct("loaded_at", residues(F.col("seq")).alias("seq"), "anchors")).alias("_last"))
    texts = stored(last.select("id", "_last.seq", "_last.anchors"), "texts")
    graph = edges(texts, span, anchor)
    graph = stored(graph, "edges")
    repeated = lookup_hot(graph, _in_two(graph, "edge"), "edge", count="n")
    along = Window.partitionBy("id").orderBy("pos")
    before = F.when(F.lag("pos").over(along) == F.col("pos") - 1, F.lag("edge").over(along))
    after = F.when(F.lead("pos").over(along) == F.col("pos") + 1, F.lead("edge").over(along))
    repeated = stored(repeated.withColumns({"prev": before, "next": after}), "repeated")
    only = lambda c: F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1))), F.min(c))
    nodes = repeated.groupBy("edge").agg(only("prev").alias("only_prev"), only("next").alias("only_next"), F.count(F.lit(1)).alias("n"))
    inner = nodes.select("edge", "only_prev", "n").join(nodes.select(F.col("edge").alias("only_prev"), "only_next"), "only_prev").filter("only_next = edge")
    steps = lookup_hot(repeated, inner.select("edge", "n", F.lit(True).alias("inner")), "edge", "left", count="n")
    path = F.last(F.when(F.col("inner").isNull(), F.struct("edge", "pos")), ignorenulls=True).over(along)
    runs = steps.select("id", "pos", path.alias("_head")).groupBy("id", F.col("_head.pos").alias("start"), F.col("_head.edge").alias("path"))
    spans = runs.agg((F.max("pos") + span - 1).alias("end")).join(texts.select("id", "seq"), "id")
    return spans.select("id", "path", "start", "end", F.expr("substring(seq, start, end - start + 1)").alias("text"))


def verified(spans: DataFrame) -> DataFrame:
    """The occurrences whose residues, read at their source coordinates, really lie in another record too."""
    spans = stored(spans, "spans")
    same = spans.groupBy(F.sha2("text", 256).alias("_sha")).agg(F.min("id").alias("_a"), F.max("id").alias("_b"), F.count(F.lit(1)).alias("n")).filter("_a < _b")
    return lookup_hot(spans.withColumn("_sha", F.sha2("text", 256)), same.select("_sha", "n"), "_sha", count="n").drop("_sha")


def merged(spans: DataFrame) -> DataFrame:
    """(id, start, end): the longest runs of adjacent residues that the spans of a record cover."""
    along = Window.partitionBy("id").orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.select("id", "start", "end", F.when(reach.isNull() | (F.col("start") > reach + 1), 1).otherwise(0).alias("_new"))
    numbered = opened.withColumn("_run", F.sum("_new").over(along))
    return numbered.groupBy("id", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")
