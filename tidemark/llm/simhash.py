"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint's 64 bits make three segments of at most 23 bits. Of two fingerprints that differ in two bits or fewer, one
segment agrees exactly (pigeonhole) and the next one differs in at most two bits. Each segment is decoded to the indices
of all codewords of the perfect (23, 12) Golay code within four bits, one or six of them: two words within two bits of
each other have a word between them, whose nearest codeword lies within four bits of both, so they share an index. A
key is the exact segment and one index of the next. Keys that few fingerprints share are joined with themselves and
verified. Fingerprints under a key that many share are linked through points instead: two words are within two bits
exactly if some word is within one bit of both, so each sends its 65 neighbours and no pairs are formed."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import golay, similar
from tidemark.llm.common import ROW_KEY, attach, reliable, row_key, staying, texts
from tidemark.llm.components import components

#: Words of a shingle, the most differing bits of linked fingerprints, and the most fingerprints under a key that is joined with itself.
SHINGLE = 3
LINKED = 2
CROWD = 48
#: Low bit and width of the three segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The SimHash of a text as a signed long; no words: zero; fewer than size: the whole sequence is the only shingle."""
    words = text.lower().split()
    if not words:
        return 0
    runs = zip(*(words[i:] for i in range(size)), strict=False) if len(words) >= size else [words]
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, runs), repeat(42)), np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(h), 16384):
        part = h[a : a + 16384]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.int64)[0])


def _keys(batches):
    tables = golay.tables()
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        parts = [(fp.view(np.uint64) >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1) for low, width in SEGMENTS]
        for i in range(3):
            near = golay.indices(parts[(i + 1) % 3], tables)
            keys = (np.int64(i) << 40) | (parts[i] << 12)[:, None] | near
            new = np.ones(near.shape, bool)
            new[:, 1:] = near[:, 1:] != near[:, :1]
            yield pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array(np.repeat(fp, new.sum(axis=1)))], ["key", "fp"])


def _points(batches):
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            fp = batch.column(0).slice(a, 4096).to_numpy(zero_copy_only=False)
            points = (fp.view(np.uint64)[:, None] ^ flips).reshape(-1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(points), pa.array(np.repeat(fp, 65))], ["point", "fp"])


def links(prints: DataFrame) -> DataFrame:
    """(u, v): links between distinct fingerprints fp that give the same components as all pairs within LINKED bits."""
    keys = prints.select("fp").mapInArrow(_keys, "key long, fp long")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    keyed = reliable(keys.join(shared, "key"))
    few = keyed.filter(F.col("n") <= CROWD)
    a, b = few.select("key", F.col("fp").alias("u")), few.select("key", F.col("fp").alias("v"))
    pairs = a.join(b, "key").filter("u < v").filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= LINKED).select("u", "v")
    points = keyed.filter(F.col("n") > CROWD).select("fp").distinct().mapInArrow(_points, "point long, fp long")
    hubs = points.groupBy("point").agg(F.min("fp").alias("u"), F.count("*").alias("n")).filter("n > 1").select("point", "u")
    spokes = points.join(hubs, "point").filter("fp <> u").select("u", F.col("fp").alias("v"))
    return pairs.union(spokes).distinct()


def _prints(batches):
    for batch in batches:
        fp = [fingerprint(t) for t in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column(ROW_KEY), pa.array(fp, pa.int64())], ["id", ROW_KEY, "fp"])


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: id, fp, component_id, the row's key, and the key of the row that stays of its component."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias(ROW_KEY))
    rows = reliable(source.mapInArrow(_prints, f"id {kind}, {ROW_KEY} long, fp long"))
    best = F.struct(F.col("id").isNull().alias("none"), "id", F.col(ROW_KEY).alias("key"))
    prints = reliable(rows.groupBy("fp").agg(F.min(best).alias("best"), F.count("*").alias("n")))
    total = rows.count()
    roots = components(links(prints)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = prints.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("best").alias("least"))
    table = reliable(rooted.join(least, "root").select("fp", "n", F.col("least.id").alias("component_id"), F.col("least.key").alias("stays")))
    return attach(rows, table, "fp", "n", total)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, fingerprint, component_id (the least id reachable over links), and the row's key.

    Null and wordless texts have fingerprint zero and are linked like any other. A null id is passed over when the least
    one is taken. Rows may repeat; extra columns are left out; an empty table gives an empty result."""
    found = _grouped(docs, id_col, text_col)
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", ROW_KEY)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of which one of each group stays: that with the least id (null ids last),
    then the least row key."""
    made = _grouped(docs, id_col, text_col)
    return staying(docs, made.select(ROW_KEY, (F.col(ROW_KEY) == F.col("stays")).alias("kept")), id_col, text_col)


def deduplicate_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = similar.SHINGLE, least: float = similar.SIMILAR) -> DataFrame:
    """The rows of docs, with all their columns, of which one of each group of similar texts stays (least id, null ids last).
    Two bits of 64 are too few for copies that share four fifths of their shingles, so this takes wide fingerprints, whose
    segments give Golay keys in the same way, and lets whole sets of shingles decide: see similar."""
    return staying(docs, similar.decisions(docs, id_col, text_col, size, least), id_col, text_col)
