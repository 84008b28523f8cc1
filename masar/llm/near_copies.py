"""Near copies of whole documents: MinHash banding of five-word shingles, verified by exact Jaccard similarity.

Texts with equal words are one node.  Nodes that share a band are candidates, linked as in ``paragraphs`` where the Jaccard similarity of
their shingle sets is ``SIMILARITY`` or more; links become components, and of each component the document with the smallest key stays.
Fingerprints of 64 bits don't serve here: texts of that similarity differ in so many bits that a probe within them meets most of a corpus.

Defined results: null and empty texts and those without words are equal; a text of fewer words than a shingle is one shingle; a row with a
null key is compared like any other but stays only where its group has no key; an empty table gives an empty table; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masar.llm.arrays import Sorted, write_sorted
from masar.llm.components import connected_components
from masar.llm.paragraphs import RECALL, SHINGLE, SIMILARITY, choose_bands, link, multipliers, worded
from masar.llm.shared import materialize
from masar.llm.simhash import first_of_each
from masar.llm.textkit import U, chunks, mix, prefix_hashes, range_hashes, signed, windows


def _worded(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(node of each text of a chunk, texts that have words, their word hashes, their bounds); a text without words is node 0."""
    _, _, hashes, bounds = worded(raw, offs)
    some = np.flatnonzero(np.diff(bounds))
    cuts = np.append(bounds[some], len(hashes))
    node = np.zeros(len(offs) - 1, np.int64)
    node[some] = signed(range_hashes(prefix_hashes(hashes), cuts[:-1], cuts[1:]))
    return node, some, hashes, cuts


def band_values(grams: np.ndarray, cuts: np.ndarray, odd: np.ndarray, bands: int, rows: int) -> pa.ListArray:
    """The band values of each set of shingles."""
    n = len(cuts) - 1
    values = np.empty((bands, n), U)
    for k in range(bands):
        band = np.full(n, k, U)
        for j in range(rows):
            band = mix(band * U(31) ^ np.minimum.reduceat(grams * odd[k * rows + j], cuts[:-1]))
        values[k] = band
    flat = pa.array(signed(np.ascontiguousarray(values.T).ravel()))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, bands * n + 1, bands, dtype=np.int32)), flat)


def nodes_of(texts: pa.Array) -> np.ndarray:
    """The node of each text of a column."""
    return np.concatenate([np.zeros(0, np.int64), *(_worded(raw, offs)[0] for _, _, raw, offs in chunks(texts))])


def signatures(docs: DataFrame, key: str, text: str, bands: int, rows: int) -> DataFrame:
    """(key, fp, bands): the node of each document, and its band values (none without words)."""
    odd = multipliers(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, raw, offs in chunks(batch.column(1)):
                node, some, hashes, cuts = _worded(raw, offs)
                values = band_values(*windows(hashes, cuts, SHINGLE), odd, bands, rows).values if len(some) else pa.array([], pa.int64())
                width = np.zeros(len(node), np.int32)
                width[some] = bands
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]).astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(node), lists], names=["key", "fp", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp long, bands array<long>")


def shingle_sets(docs: DataFrame, key: str, text: str, wanted: Sorted) -> DataFrame:
    """(node, shingles) of the wanted nodes, read in the documents whose keys' hashes ``wanted`` has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = wanted.open()
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for first, _, raw, offs in chunks(batch.column(1)):
                node, some, hashes, cuts = _worded(raw, offs)
                if not len(some):
                    continue
                distinct, where = np.unique(node[some], return_inverse=True)
                which, (owner,) = have.find(distinct)
                at = np.full(len(distinct), -1)
                at[which] = np.arange(len(which))
                row = at[where]
                hit = np.flatnonzero((row >= 0) & (owner[row] == keys[first + some])) if len(which) else np.zeros(0, int)
                if not len(hit):
                    continue
                grams, ends = windows(hashes, cuts, SHINGLE)
                sets = [np.unique(signed(grams[ends[i] : ends[i + 1]])) for i in hit]
                sizes = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(node[some][hit]), pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(sets)))], names=["node", "shingles"])

    return docs.select(F.xxhash64(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def groups(docs: DataFrame, key: str, text: str, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(key, fp) of all documents, and (fp, component, component_id) of all nodes."""
    bands, rows = choose_bands(similarity, recall)
    prints = materialize(signatures(docs, key, text, bands, rows), "copies")
    nodes = materialize(prints.groupBy("fp").agg(F.min("key").alias("rep"), F.first("bands").alias("bands")), "copies-nodes")
    exploded = nodes.select(F.col("fp").alias("node"), F.explode("bands").alias("v"))
    shared = exploded.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("v").alias("u"))
    buckets = materialize(exploded.join(shared, F.col("v") == F.col("u")).select("v", "node"), "copies-members")
    wanted = buckets.select("node").distinct().join(nodes, F.col("node") == F.col("fp")).select("node", F.xxhash64("rep").alias("owner"))
    sets = materialize(shingle_sets(docs, key, text, write_sorted(materialize(wanted, "copies-wanted"), "copies-wanted")), "copies-sets")
    comps = connected_components(link(buckets, sets, similarity))
    named = nodes.join(comps, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id")).select(F.col("component").alias("c"), "component_id")
    return prints.select("key", "fp"), materialize(named.join(least, F.col("component") == F.col("c")).select("fp", "component", "component_id"), "copies-ids")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The document with the smallest key of each group, with all its columns; of repeated rows one.

    Where a group has no row with a key, one of its rows stays.
    """
    prints, ids = groups(docs, key, text, similarity, recall)
    return first_of_each(docs, prints, ids, nodes_of, key, text)
