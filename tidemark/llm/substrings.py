"""Substring deduplication by fixed-block anchors.

Words are hashed and every text is cut into non-overlapping blocks of ``BLOCK`` words: the reference. A window of 35
words contains a whole block wherever it lies, so two equal windows have a place where one text's block meets some
18-word window of the other. Every rolling window probes the blocks (first those of a filter that all tasks filled);
blocks that are hit from elsewhere are anchors. Around anchors only, the 35-word windows themselves are compared
exactly; where neighbouring windows repeat, hits run on to maximal repeats. Texts are read once for the blocks, once
for the probes, once for the windows and once to cut; between these, only packed hashes and places shuffle, and each
task sends a hash at most once, so a passage that every text holds weighs no more than the tasks that hold it."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bits
from tidemark.llm.common import ROW_KEY, Chunk, chunks, mixed, reliable, rolling, row_key, texts

#: Words of a window, and of a block: the longest that any window holds whole, whatever its offset.
WINDOW = 35
BLOCK = (WINDOW + 1) // 2
#: Words that a task works on at once, and windows that a bucket of their hashes is meant to get.
CHUNK_WORDS = 1 << 20
BUCKET_WINDOWS = 1 << 20


def _blocks(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all rolling windows of BLOCK words; which lie in one text; which of those are blocks."""
    h = rolling(c.words, BLOCK)
    inside = c.left()[: len(h)] >= BLOCK
    return h, inside, inside & (c.at()[: len(h)] % BLOCK == 0)


def _reference(batches, shards: int, parts: int):
    for c in chunks(batches, CHUNK_WORDS):
        h, _, block = _blocks(c)
        yield bits.sent(list(bits.packed(h[block], shards, parts)))


def _probe(batches, shards: int, parts: int, once, twice):
    """Rolling windows that meet a block of elsewhere: each is sent as if the block had come once more."""
    once, twice = (np.frombuffer(x.value, np.uint8) for x in (once, twice))
    for c in chunks(batches, CHUNK_WORDS):
        h, inside, block = _blocks(c)
        h = np.unique(h[inside & ~block])
        h = h[bits.passes(once, shards, h)]
        yield bits.sent(list(bits.packed(h[~bits.passes(twice, shards, h)], shards, parts)))


def _windows(c: Chunk, shards: int, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the chunk) and hashes of the windows of WINDOW words that hold an anchor."""
    h, _, block = _blocks(c)
    at = np.flatnonzero(block)
    at = at[bits.passes(anchors, shards, h[at])]
    n = len(c.words)
    reach = np.zeros(n + 1, np.int32)
    at_in = c.at()
    first = np.maximum(at - (WINDOW - BLOCK), at - at_in[at]) if len(at) else at
    np.add.at(reach, first, 1)
    np.add.at(reach, at + 1, -1)
    places = np.flatnonzero((np.cumsum(reach)[:n] > 0) & (c.left() >= WINDOW))
    # two overlapping runs of BLOCK words make up a window
    return places, mixed(h[places] * np.uint64(0xD6E8FEB86659FD93) + h[places + WINDOW - BLOCK])


CANDIDATES = "bucket int, chunk long, hashes binary, places binary, keys binary, starts binary"


def _candidates(batches, shards: int, buckets: int, anchors):
    """For each bucket of hashes: those seen once here, with their places, then those seen more often, without. A bucket
    of its own, from ``buckets`` on, carries the chunk's texts and the places that are known to repeat already."""
    anchors, first = np.frombuffer(anchors.value, np.uint8), TaskContext.get().partitionId() << 32
    for number, c in enumerate(chunks(batches, CHUNK_WORDS)):
        places, h = _windows(c, shards, anchors)
        if not len(places):
            continue
        order = np.argsort(h, kind="stable")
        h, places = h[order], places[order].astype(np.uint32)
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        run = np.diff(np.append(np.flatnonzero(new), len(h)))
        single, many = np.repeat(run == 1, run), new.copy()
        many[new] = run > 1
        chunk = first + number
        rows = [(buckets + int(mixed(np.uint64([chunk]))[0] % np.uint64(buckets)), chunk, b"", places[~single].tobytes(), c.keys.tobytes(), c.starts.tobytes())]
        owner = ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        cuts = np.searchsorted(owner, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[b], cuts[b + 1])
            rows.append((b, chunk, np.concatenate([h[part][single[part]], h[part][many[part]]]).tobytes(), places[part][single[part]].tobytes(), None, None))
        yield _batch(rows, CANDIDATES)


def _batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in kind.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(x, types[t]) for x, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)] if rows else [pa.array([], types[t]) for _, t in fields], [n for n, _ in fields])


REPEATS = "chunk long, places binary, keys binary, starts binary"


def _repeats(table: pa.Table) -> pa.Table:
    """Of a bucket's windows, the places whose hash came more than once; texts of a chunk pass."""
    rows = table.to_pylist()
    out = [(r["chunk"], r["places"], r["keys"], r["starts"]) for r in rows if r["keys"] is not None]
    rows = [r for r in rows if r["keys"] is None]
    if rows:
        parts = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        known = [len(r["places"]) // 4 for r in rows]
        values, which, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        n[which[np.concatenate([np.arange(len(p)) >= k for p, k in zip(parts, known, strict=True)])]] += 1
        repeated, at = n[which] > 1, 0
        for r, p, k in zip(rows, parts, known, strict=True):
            places = np.frombuffer(r["places"], np.uint32)[repeated[at : at + k]]
            at += len(p)
            if len(places):
                out.append((r["chunk"], places.tobytes(), None, None))
    return pa.Table.from_batches([_batch(out, REPEATS)])


SPANS = f"{ROW_KEY} long, spans binary"


def _spans(table: pa.Table) -> pa.Table:
    """For each text of a chunk with repeats: maximal spans of words (from, to) that repeated windows cover."""
    rows = table.to_pylist()
    whole = [r for r in rows if r["keys"] is not None]
    out: list[tuple] = []
    for own in whole[:1]:
        places = np.unique(np.concatenate([np.frombuffer(r["places"], np.uint32) for r in rows])).astype(np.int64)
        keys, starts = np.frombuffer(own["keys"], np.int64), np.frombuffer(own["starts"], np.int64)
        text = np.searchsorted(starts, places, side="right") - 1
        new = np.ones(len(places), bool)
        new[1:] = (text[1:] != text[:-1]) | (places[1:] > places[:-1] + WINDOW)
        begin = np.flatnonzero(new)
        ends = np.append(begin[1:], len(places)) - 1
        spans = np.stack([places[begin], places[ends] + WINDOW], axis=1) - starts[text[begin]][:, None] if len(places) else np.empty((0, 2), np.int64)
        owner = text[begin] if len(places) else np.empty(0, np.int64)
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(owner)], strict=True):
            if b > a:
                out.append((int(keys[owner[a]]), spans[a:b].tobytes()))
    return pa.Table.from_batches([_batch(out, SPANS)])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(ROW_KEY, spans): for texts with repeats, pairs of int64 (from, to) as bytes; row_key() gives a row's key."""
    spark = docs.sparkSession
    source = docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]
    blocks = size // (4 * BLOCK)  # words of four bytes or more, white space included
    shards = bits.shards_for(blocks)
    parts = bits.parts_for(blocks, shards)
    buckets = max(64, size // (6 * BUCKET_WINDOWS))
    share = lambda x: spark.sparkContext.broadcast(x.tobytes())
    once, twice = bits.filled(source.mapInArrow(partial(_reference, shards=shards, parts=parts), bits.SENT), shards, "once", "twice", parts=parts)
    probed = source.mapInArrow(partial(_probe, shards=shards, parts=parts, once=share(once), twice=share(twice)), bits.SENT)
    (hit,) = bits.filled(probed, shards, "once", parts=parts)
    found = source.mapInArrow(partial(_candidates, shards=shards, buckets=buckets, anchors=share(twice | hit)), CANDIDATES)
    spans = found.groupBy("bucket").applyInArrow(_repeats, REPEATS).groupBy("chunk").applyInArrow(_spans, SPANS)
    return spans.groupBy(ROW_KEY).agg(F.first("spans").alias("spans"))


def cut(text: bytes, spans: bytes | None) -> tuple[int, bytes]:
    """How many words a text has, and those outside the spans joined by one space."""
    words = text.split()
    kept, last = [], 0
    for a, b in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist() if spans else ():
        kept += words[last:a]
        last = max(last, b)
    return len(words), b" ".join(kept + words[last:])


def _cut(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [(*cut(t, s), s) for t, s in zip(texts(batch), batch.column("spans").to_pylist(), strict=True)]
        removed = [sum(b - a for a, b in np.frombuffer(s, np.int64).reshape(-1, 2).tolist()) if s else 0 for _, _, s in made]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([n for n, _, _ in made], pa.int64()), pa.array(removed, pa.int64()), pa.array([k for _, k, _ in made], pa.binary()).cast(pa.string())], ["id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_text (the words outside repeats, joined by one space).

    A null or empty text has no words. Texts of fewer than WINDOW words lose none. Repeated rows count as repeats of each
    other. Windows that overlap in one text repeat if they are equal. Extra columns are left out; an empty table gives an
    empty result."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias(ROW_KEY))
    spans = reliable(repeated_spans(docs, id_col, text_col))
    # only texts that lose something shuffle, with the few that a filter can't tell from them
    maybe = bits.among(spans.select(ROW_KEY), spans.count(), "once")(F.col(ROW_KEY))
    joined = rows.filter(maybe).join(spans, ROW_KEY, "left").select("id", "text", "spans")
    joined = joined.union(rows.filter(~maybe).select("id", "text", F.lit(None).cast("binary").alias("spans")))
    made = joined.mapInArrow(_cut, f"id {kind}, n_words long, n_removed long, kept string")
    return made.select(F.col("id").alias(id_col), "n_words", "n_removed", F.col("kept").alias("kept_text"))
