"""Substring dedup: paragraphs by MinHash banding.

Two kinds of paragraphs.  A *line* of ``LEAST`` words or more is a paragraph as its author cut it.  *Pieces* are cut where the words themselves say so, so that a
passage yields the same pieces wherever it stands: inside a longer line, over several short lines, or in a text without lines.  A boundary is a word
where a hash of it and of the word before is the least among the ``REACH`` places on either side; stretches of ``2 * PIECE`` words without one (a word
repeated over and over) are cut every ``PIECE`` words.  From each boundary a piece runs to the first boundary that leaves it ``LEAST`` words or more; of
pieces with one end the shortest counts.  A passage of 51 words holds a whole piece in 97 of 100 cases, one of 60 words in 98.

Equal paragraphs of a kind, by a hash of their words, are one node.  MinHash values of the lines' five-word shingles are banded, the bands tuned for recall at the
similarity; lines that share a band are candidates, verified by the exact Jaccard similarity of their shingle sets;
links become components, and of each component the first occurrence stays.  Pieces are so short that one word changed inside leaves less than the
similarity; only equal ones are linked, by their hash.

Two passes over the texts.  The first sends sorted, packed band values and node hashes to buckets of the hash range; what is found there of more
than one node, or more than once, becomes sorted arrays in the shared folder.  The second maps these and returns only paragraphs that meet one of them, so what
occurs once is never shuffled as rows.  The lines of a band value aren't expanded into all pairs.  First all are verified against the most central of them (the one whose
band values most others share, and whose shingles the others hold), which joins copies of one original.  Values whose lines
aren't one component then are verified across components, so that no link is lost.  Pairs are made only where the shingles that
a set shares with any other allow the overlap that the similarity needs.

Defined results: null and empty texts have no paragraphs; a text of fewer words than ``LEAST`` is one piece; after a text's last piece
fewer words than that may be left, which belong to none; a paragraph that repeats within a text counts as well; of repeated rows with one
key all occurrences of the kept paragraph are kept; a null key sorts first among occurrences; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from masar.llm.arrays import Sorted
from masar.llm.blocks import pack_sorted, unpack_sorted
from masar.llm.components import connected_components
from masar.llm.ngrams import by_bucket
from masar.llm.shared import array_folder, materialize, unused, write_atomically
from masar.llm.textkit import U, chunks, mix, per_text, prefix_hashes, range_hashes, signed, spans, windows, word_hashes

_NEWLINE = np.zeros(256, bool)
_NEWLINE[[10, 13]] = True
LEAST, REACH, PIECE, SHINGLE, SIMILARITY, RECALL, HASHES = 20, 4, 32, 5, 0.8, 0.999, 32
#: Distinct keys that a task holds before it sends them on, and about as many in a bucket.
HELD, BUCKET = 2_000_000, 2_000_000
#: Low bits of a band value's key that tell its nodes apart.
CHECK = U(16)


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows in a band, so the fewest chance candidates, that still reach the recall at the similarity."""
    best = (1, 1)
    for rows in range(1, hashes + 1):
        bands = next((b for b in range(1, hashes // rows + 1) if 1 - (1 - similarity**rows) ** b >= recall), None)
        if bands:
            best = (bands, rows)
    return best


def segments(hashes: np.ndarray, bounds: np.ndarray, reach: int = REACH, piece: int = PIECE) -> np.ndarray:
    """The words at which a stretch between boundaries begins; each text's first word is one."""
    n, sizes = len(hashes), np.diff(bounds)
    if not n:
        return np.zeros(0, np.int64)
    score = mix(np.concatenate([np.zeros(1, U), hashes[:-1]]) * U(0x9E3779B97F4A7C15) + hashes)
    least = np.ones(n, bool)
    for k in range(1, reach + 1):
        least[k:] &= score[k:] < score[:-k]
        least[:-k] &= score[:-k] <= score[k:]
    place = np.arange(n) - np.repeat(bounds[:-1], sizes)
    least &= (place > reach) & (np.repeat(sizes, sizes) - place > reach)
    least[bounds[:-1][sizes > 0]] = True
    starts = np.flatnonzero(least)
    long = np.diff(np.append(starts, n)) // piece
    pieces = np.where(long >= 2, long, 1)
    within = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(starts, pieces) + piece * within


def pieces(hashes: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end word) of the pieces, in order."""
    sizes, starts = np.diff(bounds), segments(hashes, bounds)
    ends = np.append(starts[1:], len(hashes))[: len(starts)]
    text = np.searchsorted(bounds, starts, "right") - 1
    begun = np.searchsorted(starts, bounds[:-1][text])
    over = np.searchsorted(starts, bounds[1:][text])
    last = np.searchsorted(ends, starts + least)
    short = sizes[text] < least
    last = np.where(short, over - 1, last)
    real = np.where(short, np.arange(len(starts)) == begun, last < over)
    if len(starts):
        real[:-1] &= ~((last[:-1] == last[1:]) & real[1:] & (text[:-1] == text[1:]))
    return text[real], starts[real], ends[last[real]]


@dataclass(frozen=True)
class Paragraphs:
    """The paragraphs of a chunk: ``lines`` lines, then the pieces."""

    lines: int
    text: np.ndarray
    number: np.ndarray  # within the text, of the kind
    begin: np.ndarray  # first byte
    end: np.ndarray
    words: np.ndarray
    node: np.ndarray
    grams: np.ndarray  # hashes of the lines' shingles
    cuts: np.ndarray  # and their bounds

    def bands(self, odd: np.ndarray, bands: int, rows: int) -> np.ndarray:
        """A row of band values for each line."""
        out = np.empty((self.lines, bands), U)
        for b in range(bands if self.lines else 0):
            band = np.full(self.lines, b, U)
            for j in range(rows):
                band = mix(band * U(31) ^ np.minimum.reduceat(self.grams * odd[b * rows + j], self.cuts[:-1]))
            out[:, b] = band
        return out

    def shingles(self, k: int) -> np.ndarray:
        """The distinct shingles of a line, in order."""
        return np.unique(signed(self.grams[self.cuts[k] : self.cuts[k + 1]]))


def worded(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a chunk, and each text's bounds."""
    starts, ends = spans(raw, offs)
    return starts, ends, word_hashes(raw, starts, ends), per_text(starts, offs)


def paragraphs_of(raw: np.ndarray, offs: np.ndarray, least: int = LEAST) -> Paragraphs:
    starts, ends, hashes, bounds = worded(raw, offs)
    a, b = spans(raw, offs, _NEWLINE)
    line_text = np.searchsorted(offs, a, "right") - 1
    line_number = np.arange(len(a)) - np.searchsorted(line_text, line_text)
    cuts = np.append(np.searchsorted(starts, a), len(starts))
    long = np.diff(cuts) >= least
    inside = np.concatenate([[0], np.cumsum(np.diff(cuts)[long])])
    grams, gram_cuts = windows(hashes[np.repeat(long, np.diff(cuts))] if len(a) else hashes, inside, SHINGLE)
    text, first, end = pieces(hashes, bounds, least)
    prefix = prefix_hashes(hashes)
    lines, others = range_hashes(prefix, cuts[:-1][long], cuts[1:][long]), range_hashes(prefix, first, end)
    return Paragraphs(
        int(long.sum()), np.concatenate([line_text[long], text]), np.concatenate([line_number[long], np.arange(len(text)) - np.searchsorted(text, text)]),
        np.concatenate([a[long], starts[first]]), np.concatenate([b[long], ends[end - 1]]), np.concatenate([np.diff(cuts)[long], end - first]),
        np.concatenate([mix(lines + U(1)), others]) >> U(1), grams, gram_cuts,
    )


def multipliers(n: int) -> np.ndarray:
    """Odd numbers, one for each MinHash function."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15)) | U(1)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> U(40)).astype(np.int64) * buckets >> 24


def _packed(keys: np.ndarray, buckets: int, base: int) -> pa.RecordBatch:
    """A row for each bucket of the sorted keys."""
    bucket = _bucket(keys, buckets)
    cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]] + base, pa.int32()), pa.array([pack_sorted(keys[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], names=["bucket", "keys"])


def _marked(held: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct node hashes, moved up by a bit that says whether one stands here more than once."""
    nodes = np.sort(np.concatenate(held))
    first = np.flatnonzero(np.concatenate([[True], nodes[1:] != nodes[:-1]]))
    return nodes[first] << U(1) | (np.diff(np.append(first, len(nodes))) > 1).astype(U)


def repeated(docs: DataFrame, text: str, least: int, bands: int, rows: int) -> tuple[Sorted, Sorted]:
    """The band values (48 bits) that several nodes share, and the nodes that occur more than once."""
    spark = docs.sparkSession
    folder, odd = array_folder(spark, "paragraphs"), multipliers(bands * rows)
    n_bytes = docs.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"] or 0
    words = n_bytes / 6  # a word has some 6 bytes, every 12th or so begins a piece, and a line in question has some 40
    band_buckets, node_buckets = (1 << max(0, math.ceil(math.log2(max(x / BUCKET, 1)))) for x in (words / 40 * bands, words / 12))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            if any(map(len, values)):
                yield _packed(np.unique(np.concatenate(values)), band_buckets, 0)
            yield _packed(_marked(nodes), node_buckets, band_buckets)
            values.clear()
            nodes.clear()

        for batch in batches:
            for _, _, raw, offs in chunks(batch.column(0)):
                p = paragraphs_of(raw, offs, least)
                keys = p.bands(odd, bands, rows) >> CHECK << CHECK | (mix(p.node[: p.lines]) >> U(64) - CHECK)[:, None]
                values.append(keys.ravel())
                nodes.append(p.node)
                size += keys.size + len(p.node)
                if size >= HELD:
                    yield from out()
                    size = 0
        if size:
            yield from out()

    def save(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        keys = np.sort(np.concatenate([unpack_sorted(x.as_py()) for x in table["keys"]]))
        if bucket < band_buckets:
            value = keys >> CHECK
            found = np.unique(value[1:][(value[1:] == value[:-1]) & (keys[1:] != keys[:-1])])
        else:
            value = keys >> U(1)
            found = np.unique(np.concatenate([value[1:][value[1:] == value[:-1]], value[keys & U(1) == 1]]))
        if len(found):
            write_atomically(f"{folder}/{bucket}-key", signed(found).tobytes())
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([len(found)], pa.int64()), "first": pa.array([int(found[0]) if len(found) else 0], pa.int64()), "last": pa.array([int(found[-1]) if len(found) else 0], pa.int64())})

    parts = by_bucket(docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket int, keys binary"), band_buckets + node_buckets).applyInArrow(save, "bucket int, n long, first long, last long").filter("n > 0").orderBy("bucket").collect()  # a row for each BUCKET keys
    both = [tuple(sorted((tuple(r) for r in parts if (r["bucket"] < band_buckets) == low), key=lambda r: r[2])) for low in (True, False)]
    return tuple(Sorted(folder, ("key",), p) for p in both)


def occurrences(docs: DataFrame, key: str, text: str, least: int, bands: int, rows: int, shared: Sorted, again: Sorted) -> DataFrame:
    """(key, kind, paragraph, char_start, char_end, words, node, values, shingles) of the paragraphs that share a band value or occur again.

    values: the band values shared; shingles: the set of a node that shares one, where this task first meets it.
    """
    odd = multipliers(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values_of, nodes_of = shared.open(), again.open()
        told: set[int] = set()
        for batch in batches:
            for first, _, raw, offs in chunks(batch.column(1)):
                p = paragraphs_of(raw, offs, least)
                node, values = signed(p.node), signed(p.bands(odd, bands, rows) >> CHECK)
                common = values_of.holds(values)
                wanted = nodes_of.holds(node)
                wanted[: p.lines] |= common.any(axis=1)
                hit = np.flatnonzero(wanted)
                if not len(hit):
                    continue
                lead = np.concatenate([[0], np.cumsum(raw & 0xC0 != 0x80)])
                base, few = lead[offs[p.text[hit]]], hit[hit < p.lines]
                width = np.zeros(len(hit), np.int64)
                width[: len(few)] = common[few].sum(axis=1)
                sets: list[np.ndarray | None] = [None] * len(hit)
                for at, k in enumerate(few.tolist()):
                    if width[at] and int(node[k]) not in told:
                        sets[at] = p.shingles(k)
                        told.add(int(node[k]))
                if len(told) > HELD:
                    told.clear()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(first + p.text[hit])), pa.array(np.where(hit < p.lines, "line", "piece")), pa.array(p.number[hit], pa.int32()), pa.array(lead[p.begin[hit]] - base, pa.int64()), pa.array(lead[p.end[hit]] - base, pa.int64()), pa.array(p.words[hit], pa.int64()), pa.array(node[hit]),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]).astype(np.int32)), pa.array(values[few][common[few]])), pa.array(sets, pa.list_(pa.int64())),
                    ],
                    names=["key", "kind", "paragraph", "char_start", "char_end", "words", "node", "values", "shingles"],
                )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, kind string, paragraph int, char_start long, char_end long, words long, node long, values array<long>, shingles array<long>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the Jaccard similarity or more."""
    left, right = (sets.select(F.col("node").alias(f"n{s}"), F.col("shingles").alias(f"s{s}")) for s in "ab")
    both = pairs.join(left, F.col("a") == F.col("na")).join(right, F.col("b") == F.col("nb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.filter(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def _pair(x: str, y: str) -> list:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b")]


def room(buckets: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The members (v, node, n, size, free) that can have a similar partner at all.

    ``free`` counts the shingles of a set that some other set holds too. No overlap is larger, and a partner of the least
    possible size needs an overlap of similarity * size, so a set with less is out; that loses no link.
    """
    own = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c"), F.min("node").alias("k")).filter("c = 1").groupBy("k").agg(F.count("*").alias("alone"))
    sized = sets.select("node", F.size("shingles").alias("size")).join(own, F.col("node") == F.col("k"), "left").select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("free"))
    sized = materialize(sized.filter(F.col("free") >= similarity * F.col("size")).withColumnRenamed("node", "k"), "paragraph-sizes")
    left = materialize(buckets.join(sized, F.col("node") == F.col("k")).select("v", "node", "size", "free"), "paragraph-room")
    still = left.groupBy("v").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("v").alias("u"), "n")
    return materialize(left.join(still, F.col("v") == F.col("u")).select("v", "node", "n", "size", "free"), "paragraph-members")


def link(buckets: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b): verified links of the members (v, node, n) of buckets that make the components of all similar members."""
    buckets = room(buckets.select("v", "node"), sets, similarity)
    need = similarity / (1 + similarity) * (F.col("size") + F.col("size2")) - 1e-9
    fits = (F.col("free") >= need) & (F.col("free2") >= need)  # an overlap of this size is possible
    central = buckets.groupBy("node").agg(F.sum("n").alias("weight")).select(F.col("node").alias("k"), "weight")
    weighed = buckets.join(central, F.col("node") == F.col("k")).select("v", "node", "weight", "size", "free")
    heads = weighed.groupBy("v").agg(F.max(F.struct("weight", "free", "node", "size")).alias("h")).select(F.col("v").alias("w"), F.col("h.node").alias("head"), F.col("h.size").alias("size2"), F.col("h.free").alias("free2"))
    stars = buckets.join(heads, (F.col("v") == F.col("w")) & (F.col("node") != F.col("head")) & fits).select(*_pair("node", "head")).distinct()
    found = materialize(verified(stars, sets, similarity), "paragraph-links")
    comps = connected_components(found)
    inside = buckets.join(comps.select(F.col("node").alias("k"), "component"), F.col("node") == F.col("k"), "left").select("v", "node", "size", "free", F.coalesce("component", "node").alias("comp"))
    inside = materialize(inside, "paragraph-round")
    torn = inside.groupBy("v").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter(F.col("x") != F.col("y")).select(F.col("v").alias("u"))
    now = materialize(inside.join(torn, F.col("v") == F.col("u")).select("v", "node", "size", "free", "comp"), "paragraph-torn")
    if now.isEmpty():
        return found
    held = now.groupBy("node").agg(F.collect_set("v").alias("vs")).select(F.col("node").alias("k"), "vs")  # one value for each band at most
    now = materialize(now.join(held, F.col("node") == F.col("k")).drop("k"), "paragraph-torn")
    other = now.select(F.col("v").alias("w"), F.col("node").alias("other"), F.col("comp").alias("own"), F.col("size").alias("size2"), F.col("free").alias("free2"), F.col("vs").alias("vs2"))
    once = F.array_min(F.array_intersect("vs", "vs2")) == F.col("v")  # a pair meets in the first value that it shares, not in each
    pairs = now.join(other, (F.col("v") == F.col("w")) & (F.col("node") < F.col("other")) & (F.col("comp") != F.col("own")) & fits & once).select(*_pair("node", "other"))
    return found.union(materialize(verified(pairs, sets, similarity), "paragraph-links"))


def duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """A row for each occurrence of a paragraph that has a duplicate.

    key, kind (line or piece), paragraph (number within the text, of its kind), char_start, char_end (code points), words, component_id and component_paragraph (where the
    component first occurs), keep (whether this is that occurrence; the others are to be removed).
    """
    bands, rows = choose_bands(similarity, recall)
    every = materialize(occurrences(docs, key, text, least, bands, rows, *repeated(docs, text, least, bands, rows)), "paragraphs")
    nodes = materialize(every.groupBy("node").agg(F.count("*").alias("n"), F.min(F.struct("key", "paragraph")).alias("first")), "paragraph-nodes")
    buckets = materialize(every.select("node", F.explode("values").alias("v")).distinct().select("v", "node"), "paragraph-members")
    sets = materialize(every.filter("shingles is not null").select("node", "shingles").dropDuplicates(["node"]), "paragraph-sets")
    comps = connected_components(link(buckets, sets, similarity))
    named = materialize(nodes.join(comps.select(F.col("node").alias("k"), "component"), F.col("node") == F.col("k"), "left").select("node", "n", "first", F.coalesce("component", "node").alias("component")), "paragraph-named")
    whole = named.groupBy("component").agg(F.sum("n").alias("total"), F.min("first").alias("origin")).filter("total > 1").select(F.col("component").alias("c"), "origin")
    again = materialize(named.join(whole, F.col("component") == F.col("c")).select(F.col("node").alias("k"), "origin"), "paragraph-repeated")
    out = every.select("key", "kind", "paragraph", "char_start", "char_end", "words", "node").join(again, F.col("node") == F.col("k"))
    kept = F.col("key").eqNullSafe(F.col("origin.key")) & (F.col("paragraph") == F.col("origin.paragraph"))
    return out.select(F.col("key").alias(key), "kind", "paragraph", "char_start", "char_end", "words", F.col("origin.key").alias("component_id"), F.col("origin.paragraph").alias("component_paragraph"), kept.alias("keep"))


def rest_of(text: str, gone: list[tuple[int, int]], kept: list[tuple[int, int]]) -> str:
    """The text without the spans that are gone, but for what kept spans cover."""
    edges = sorted([(a, 0) for a, _ in gone] + [(b, 1) for _, b in gone] + [(a, 2) for a, _ in kept] + [(b, 3) for _, b in kept])
    out, at, depth = [], 0, [0, 0]
    for place, kind in [*edges, (len(text), 4)]:
        if not depth[0] or depth[1]:
            out.append(text[at:place])
        at = place
        if kind < 4:
            depth[kind // 2] += 1 - 2 * (kind % 2)
    return "".join(out)


def without_duplicates(docs: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the paragraphs cut out that ``found`` doesn't keep; all columns stay.

    Where a paragraph that goes overlaps one that is kept, the kept one stays whole, so of each component one whole occurrence is left.
    """
    k, cuts = unused(docs, "cut_key"), unused(docs, "cuts")
    by_key = found.groupBy(F.col(key).alias(k)).agg(F.collect_list(F.struct("char_start", "char_end", "keep")).alias(cuts))  # bounded by a text's own paragraphs
    joined = docs.join(by_key, F.col(f"`{key}`").eqNullSafe(F.col(k)), "left").select(*(docs[f"`{c}`"] for c in docs.columns), cuts)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                t if t is None or c is None else rest_of(t, [(x["char_start"], x["char_end"]) for x in c if not x["keep"]], [(x["char_start"], x["char_end"]) for x in c if x["keep"]])
                for t, c in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)
            ]
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)
