"""Near-duplicates by the Jaccard similarity of word shingles: wide SimHash fingerprints give Golay keys, whole sets decide.

Sets of similarity 0.8 differ in some 15 percent of their fingerprints' bits, so a fingerprint here has SEGMENTS segments
of 23 bits. Each is decoded to the two codewords that agree best with its sums, in which uncertain bits weigh little. Errors
spread over the segments, so some neighbouring pair of them keeps a codeword in common (pigeonhole): a key is a pair of
neighbouring segments with a codeword of each. A segment shares one with a probability of 0.54 at similarity 0.8 and 0.76 at
0.9 (simulated); that no pair of neighbours does has 0.002 at 0.8 and less above. Texts with equal sets are one node. A key
counts for a node only if one of its extensions by any third segment is another node's too: two nodes that share a key lose
it only if they agree in no other segment of 22 (0.46**22 at 0.8); of strangers that share one, some two percent keep it.

Nodes that share a key are compared in 64 bits of their fingerprints, and if these are near, by their sets. Each is compared
with the least of its keys' least nodes first, then, in groups that this hasn't linked, with those of its keys' least nodes
that are in another component, so that a crowd of copies forms no square of pairs. A node's keys stay in one row until
groups are formed, so components are looked up once a node. Where a group's nodes aren't all linked yet, those outside its
main component are compared with all of the group. If these are more than CROWD, the group is parted
before that: its keys are extended by one more segment, which copies survive and strangers don't."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bits, golay
from tidemark.llm.common import ROW_KEY, attach, chunks, fitted, lean, mixed, reliable, rolling, row_key, small_batches, staying, texts, word_hashes
from tidemark.llm.components import components

#: Words of a shingle and the least similarity of linked texts.
SHINGLE, SIMILAR = 5, 0.8
#: Segments of a fingerprint, the words of 64 bits that hold them, and the most differing bits of 64 that sets are compared at.
SEGMENTS, LANES, NEAR_BITS = 24, 9, 22
#: The most nodes outside the main component of a group whose key isn't extended, and how many segments may extend it.
CROWD, EXTENSIONS = 48, 8
CHUNK_WORDS = 1 << 17
_BYTES = np.uint64(0x0101010101010101)
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The segments besides a key's own two, counted from its first, and those of them that extend the keys of crowds.
_OTHERS = np.arange(2, SEGMENTS)
_OFFSETS = _OTHERS[: 3 * EXTENSIONS : 3]


def shingled(words: np.ndarray, size: int) -> np.ndarray:
    """The set of shingles of a text's word hashes, sorted; fewer words than size: all of them are the only shingle."""
    return np.unique(rolling(words, min(size, len(words)))) if len(words) else np.empty(0, np.uint64)


def wide_sums(sets: list[np.ndarray]) -> np.ndarray:
    """(n, 64 * LANES): for sets that aren't empty, how many more members set a bit of their hashes than leave it unset.
    Bits are counted eight at a time in the bytes of a long, which hold 255."""
    sizes = np.array([len(s) for s in sets])
    flat, runs = np.concatenate(sets), -(-sizes // 255)
    first = np.cumsum(runs) - runs
    starts = np.repeat(np.cumsum(sizes) - sizes, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first, runs))
    out = np.empty((len(sets), LANES, 8, 8), np.int64)
    for lane in range(LANES):
        h = mixed(flat * np.uint64(2 * lane + 0x9E3779B97F4A7C15))
        for bit in range(8):
            held = np.add.reduceat((h >> np.uint64(bit)) & _BYTES, starts).view(np.uint8).reshape(-1, 8)
            out[:, lane, bit] = np.add.reduceat(held.astype(np.int64), first)
    return 2 * out.reshape(len(sets), -1) - sizes[:, None]


def codes_of(sums: np.ndarray, code: np.ndarray) -> np.ndarray:
    """(n, SEGMENTS): the two codewords of each segment, twelve bits each."""
    two = golay.two_nearest(sums[:, : SEGMENTS * golay.LENGTH].reshape(-1, golay.LENGTH), code)
    return (two[:, 0] << 12 | two[:, 1]).reshape(-1, SEGMENTS)


@lean
def _nodes(batches, size: int):
    code = golay.signs()
    for chunk in chunks(batches, CHUNK_WORDS, lower=True):
        sets = [shingled(chunk.words[a:b], size) for a, b in zip(chunk.starts[:-1], chunk.starts[1:], strict=True)]
        full = [i for i, s in enumerate(sets) if len(s)]
        nodes = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
        codes: list[list[int]] = [[] for _ in sets]
        short = np.zeros(len(sets), np.int64)
        if full:
            sums = wide_sums([sets[i] for i in full])
            short[full] = np.packbits(sums[:, :64] > 0, axis=1).view(np.int64)[:, 0]
            for i, own in zip(full, codes_of(sums, code).tolist(), strict=True):
                codes[i] = own
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk.keys), pa.array(nodes), pa.array([len(s) for s in sets], pa.int64()), pa.array(short), pa.array(codes, pa.list_(pa.int32()))],
            [ROW_KEY, "node", "size", "short", "codes"],
        )


@lean
def _sets(batches, size: int):
    for batch in batches:
        found = [shingled(word_hashes(t.lower().split()), size).tobytes() for t in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.binary())], ["node", "shingles"])


@lean
def _alike(batches, least: float):
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            a, b = (np.frombuffer(x.as_py(), np.uint64) for x in (a, b))
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(both / (len(a) + len(b) - both) >= least)
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _verified(pairs: DataFrame, total: int, source: DataFrame, nodes: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (u, v) of nodes whose sets are similar; total: how many pairs there are."""
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    wanted = reliable(fitted(nodes.select("node", F.col("best.key").alias(ROW_KEY)).join(ends, "node").select(ROW_KEY, "node"), 2 * total))
    # of all texts only those that are wanted shuffle, with the few that a filter can't tell from them
    maybe = bits.among(wanted.select(ROW_KEY), wanted.count(), "once")(F.col(ROW_KEY))
    held = source.filter(maybe).select(ROW_KEY, "text").join(wanted, ROW_KEY).select("node", "text").dropDuplicates(["node"])
    sets = reliable(fitted(held, 2 * total, 1024).mapInArrow(partial(_sets, size=size), "node long, shingles binary"))
    for end, name in (("u", "a"), ("v", "b")):
        uses = pairs.groupBy(end).agg(F.count("*").alias("uses"))
        own = sets.withColumnsRenamed({"node": end, "shingles": name}).join(uses, end)
        pairs = attach(pairs, own, end, "uses", total).drop("uses")
    return fitted(reliable(pairs.select("u", "v", "a", "b").mapInArrow(partial(_alike, least=least), "u long, v long")), total)


def first_keys(codes: np.ndarray) -> np.ndarray:
    """(n, 4 * SEGMENTS): keys of all pairs of neighbouring segments, with each of their codewords; codes: (n, SEGMENTS)."""
    words = np.stack([codes >> 12, codes & 4095], axis=2).astype(np.int64)
    after = np.roll(words, -1, axis=1)
    keys = (np.arange(SEGMENTS) << 24)[:, None, None] + (words[:, :, :, None] << 12) + after[:, :, None, :]
    return keys.reshape(len(codes), -1)


def longer_keys(keys: np.ndarray, codes: np.ndarray, offsets: np.ndarray = _OFFSETS) -> np.ndarray:
    """(n, 2 * len(offsets)): hashes of keys extended by either codeword of each of some other segments."""
    at = ((keys >> 24)[:, None] + offsets) % SEGMENTS
    both = np.take_along_axis(codes, at, axis=1).astype(np.int64)
    words = np.stack([both >> 12, both & 4095], axis=2).reshape(len(keys), -1)
    return mixed(mixed(keys.view(np.uint64) * _ODD)[:, None] + (np.repeat(at, 2, axis=1) << 12 | words).view(np.uint64) * _ODD)


def _coded(batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Nodes that have shingles, some thousands at a time, and their codes."""
    for batch in batches:
        full = batch.filter(pc.greater(pc.list_value_length(batch.column("codes")), 0))
        for a in range(0, full.num_rows, 4096):
            part = full.slice(a, 4096)
            yield part, part.column("codes").flatten().to_numpy().reshape(-1, SEGMENTS)


def _passed(codes: np.ndarray, shared: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(rows, keys) of the keys that several nodes may have."""
    keys = first_keys(codes)
    rows, at = np.nonzero(_may_be(mixed(keys.view(np.uint64) * _ODD), shared))
    return rows, keys[rows, at]


def _may_be(h: np.ndarray, shared: tuple) -> np.ndarray:
    return bits.passes(np.frombuffer(shared[0].value, np.uint8), shared[1], h.reshape(-1)).reshape(h.shape)


def _longs(h: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64))], ["h"])


def _hashed(batches):
    for _, codes in _coded(batches):
        yield _longs(mixed(first_keys(codes).view(np.uint64) * _ODD))


@lean
def _passing(batches, shared: tuple):
    yield _longs(np.array([sum(len(_passed(codes, shared)[0]) for _, codes in _coded(batches))], np.int64))


def _some(n: int) -> list[slice]:
    """Places up to n, some at a time: nodes of a crowd have all their keys, and each key has many extensions."""
    return [slice(a, a + (1 << 13)) for a in range(0, n, 1 << 13)]


def _extended(batches, shared: tuple):
    for _, codes in _coded(batches):
        rows, keys = _passed(codes, shared)
        for at in _some(len(keys)):
            yield _longs(longer_keys(keys[at], codes[rows[at]], _OTHERS))


#: A node's keys, in one row or, of crowds, in a few.
WITH_KEYS = "node long, size long, short long, keys array<long>"


def _with_keys(nodes: pa.RecordBatch, rows: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    """WITH_KEYS of the nodes that have any; rows: whose keys these are, ascending."""
    held, n = np.unique(rows, return_counts=True)
    own = nodes.select(["node", "size", "short"]).take(pa.array(held, pa.int64()))
    offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    return pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(offsets, pa.array(keys, pa.int64()))], ["node", "size", "short", "keys"])


@lean
def _supported(batches, shared: tuple, longer: tuple):
    for part, codes in _coded(batches):
        rows, keys = _passed(codes, shared)
        keep = np.concatenate([np.empty(0, bool), *(_may_be(longer_keys(keys[at], codes[rows[at]], _OTHERS), longer).any(axis=1) for at in _some(len(keys)))])
        yield _with_keys(part, rows[keep], keys[keep])


def _near(a: str, b: str, least: float) -> Column:
    """Whether sizes and short fingerprints of two nodes leave it open that they are similar."""
    sizes = F.least(f"{a}.size", f"{b}.size") >= F.greatest(f"{a}.size", f"{b}.size") * F.lit(least * (1 - 1e-9))
    return sizes & (F.bit_count(F.col(f"{a}.short").bitwiseXOR(F.col(f"{b}.short"))) <= NEAR_BITS)


def _keyed(nodes: DataFrame) -> DataFrame:
    """WITH_KEYS: nodes with their keys and what is needed to compare nodes; only keys that several nodes may have that also
    share an extension of it. Strangers meet in 24 bits as often as the square of their number says, in 36 hardly;
    most keys are one node's alone, and neither these nor those of strangers shuffle."""
    # few keys repeat, and only these set bits
    shared = bits.held(nodes.select("codes"), 4 * SEGMENTS * nodes.count(), "twice", 4, _hashed)
    passing = nodes.select("codes").mapInArrow(partial(_passing, shared=shared), "h long").agg(F.sum("h")).first()[0] or 0
    longer = bits.held(nodes.select("codes"), 2 * len(_OTHERS) * passing, "twice", 4, partial(_extended, shared=shared))
    kept = reliable(nodes.select("node", "size", "short", "codes").mapInArrow(partial(_supported, shared=shared, longer=longer), WITH_KEYS))
    for filled, _ in (shared, longer):
        filled.destroy()  # driver and executors would hold both to the stage's end
    return kept


def _crowded(batches) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Nodes, whose rows they are, and the extended keys of the keys in keys, some of them at a time."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column("keys")).to_numpy()
        rows, keys = np.repeat(np.arange(batch.num_rows), sizes), batch.column("keys").flatten().to_numpy()
        codes = batch.column("codes").flatten().to_numpy().reshape(-1, SEGMENTS)
        for a in range(0, len(rows), 1 << 16):
            at = rows[a : a + (1 << 16)]
            yield batch, at, longer_keys(keys[a : a + (1 << 16)], codes[at])


def _crowded_keys(batches):
    for _, _, made in _crowded(batches):
        yield _longs(made)


@lean
def _parted(batches, shared: tuple):
    """WITH_KEYS of those extended keys that several nodes may have."""
    for batch, at, made in _crowded(batches):
        rows, places = np.nonzero(_may_be(made, shared))
        yield _with_keys(batch, at[rows], made[rows, places].view(np.int64))


def _by_key(held: DataFrame, *also: str) -> DataFrame:
    """(key, own) and the columns also: a row for each key of a node."""
    return held.select(F.explode("keys").alias("key"), F.struct("node", "size", "short").alias("own"), *also)


def _with_hub(keyed: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) of each node and the least node of its group; repeats included."""
    total = keyed.count()
    hubs = reliable(fitted(keyed.groupBy("key").agg(F.min("own").alias("hub"), F.count("*").alias("held")).filter("held > 1"), total))
    met = attach(keyed, hubs, "key", "held", total).filter("own.node <> hub.node").filter(_near("own", "hub", least))
    return met.select(F.col("hub.node").alias("u"), F.col("own.node").alias("v"))


def _open(held: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """(key, own, root), and how many: groups whose nodes aren't all linked yet. root: a node's component."""
    rooted = reliable(held.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    rooted = _by_key(rooted, "root")
    groups = rooted.groupBy("key").agg(F.min("root").alias("first"), F.max("root").alias("last")).filter("first <> last").select("key")
    found = reliable(rooted.join(groups, "key"))
    n = found.count()
    return fitted(found, n), n


def _apart(opened: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) of each node and the least node of its group, if links haven't put them in one component yet."""
    hubs = opened.groupBy("key").agg(F.min(F.struct("own", "root")).alias("hub"))
    met = opened.join(hubs, "key").filter("root <> hub.root").filter(_near("own", "hub.own", least))
    return met.select(F.col("hub.own.node").alias("u"), F.col("own.node").alias("v")).distinct()


def _with_main(opened: DataFrame, n: int) -> DataFrame:
    """opened, of n rows, with main, the most frequent component of a group, and others, how many nodes are outside it."""
    sums = opened.groupBy("key", "root").agg(F.count("*").alias("n"))
    groups = sums.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), (F.sum("n") - F.max("n")).alias("others"))
    return reliable(fitted(opened.join(groups, "key"), n))


def _pairs(rooted: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) of nodes in different components that share a key: what is outside a key's main component meets all
    nodes of the key, so a crowd that is linked already doesn't meet itself."""
    outside = rooted.filter("root <> main").select("key", F.col("own").alias("u"), F.col("root").alias("u_root"))
    met = outside.join(rooted.select("key", F.col("own").alias("v"), F.col("root").alias("v_root")), "key").filter("u_root <> v_root").filter(_near("u", "v", least))
    return met.select(F.least("u.node", "v.node").alias("u"), F.greatest("u.node", "v.node").alias("v")).distinct()


def links(source: DataFrame, nodes: DataFrame, size: int = SHINGLE, least: float = SIMILAR) -> DataFrame:
    """(u, v): links between nodes that give the same components as all similar pairs that share a key."""

    def compare(pairs: DataFrame) -> DataFrame:
        """Those similar among the pairs that haven't been compared yet."""
        nonlocal seen
        pairs = reliable(pairs if seen is None else pairs.join(seen, ["u", "v"], "left_anti"))
        n = pairs.count()
        if not n:
            return pairs.limit(0)
        pairs = fitted(pairs, n)
        seen = pairs if seen is None else seen.union(pairs)
        return _verified(pairs, n, source, nodes, size, least)

    def rooted(found: DataFrame) -> DataFrame:
        return components(found).select(F.col("u").alias("node"), F.col("v").alias("root"))

    seen = None
    held = _keyed(nodes)
    # each node with the least of its hubs first; with its other hubs only where that hasn't linked them
    found = compare(_with_hub(_by_key(held), least).groupBy("v").agg(F.min("u").alias("u")).select("u", "v"))
    opened, _ = _open(held, rooted(found))
    found = found.union(compare(_apart(opened, least)))
    roots = rooted(found)
    opened, n = _open(held, roots)
    if not n:
        return found
    opened = _with_main(opened, n)
    pairs = _pairs(opened.filter(F.col("others") <= CROWD), least)
    many = opened.filter(F.col("others") > CROWD).select("key", F.col("own.node").alias("node"))
    crowded = many.count()
    if crowded:
        # the extended keys of crowds with many strangers; a node has them in one row
        own = many.groupBy("node").agg(F.collect_set("key").alias("keys")).join(nodes, "node").select("node", "size", "short", "codes", "keys")
        shared = bits.held(own, 2 * EXTENSIONS * crowded, "twice", made=_crowded_keys)
        parted = reliable(own.mapInArrow(partial(_parted, shared=shared), WITH_KEYS))
        shared[0].destroy()
        opened, _ = _open(parted, roots)
        found = found.union(compare(_apart(opened, least)))
        opened, n = _open(parted, rooted(found))
        pairs = pairs.union(_pairs(_with_main(opened, n), least)).distinct()
    return found.union(compare(pairs))


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = SIMILAR) -> DataFrame:
    """(row's key, kept), one row per input row. Of the texts that similar pairs connect, the row with the least id stays
    (null ids last), then the least row key. Null and wordless texts are like each other and like nothing else."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias(ROW_KEY))
    made = source.select(F.col(ROW_KEY).alias("key"), "text").mapInArrow(partial(_nodes, size=size), f"{ROW_KEY} long, node long, size long, short long, codes array<int>")
    marked = reliable(made)
    total = marked.count()
    ids = source.select("id", ROW_KEY).distinct()
    order = F.struct(F.col("id").isNull().alias("none"), "id", F.col(ROW_KEY).alias("key"))
    keyed = marked.groupBy(ROW_KEY, "node", "size", "short").agg(F.first("codes").alias("codes"), F.count("*").alias("times")).join(ids, ROW_KEY)
    kinds = keyed.groupBy("node").agg(F.min(order).alias("best"), F.first("size").alias("size"), F.first("short").alias("short"), F.first("codes").alias("codes"), F.sum("times").alias("n"))
    nodes = reliable(fitted(kinds, total, 4096))
    roots = components(links(source, nodes, size, least)).select(F.col("u").alias("node"), F.col("v").alias("root"))
    rooted = nodes.select("node", "best", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stays = rooted.groupBy("root").agg(F.min("best").alias("stays"))
    table = reliable(rooted.join(stays, "root").select("node", "n", F.col("stays.key").alias("stays")))
    return attach(marked.select(ROW_KEY, "node"), table, "node", "n", total).select(ROW_KEY, (F.col(ROW_KEY) == F.col("stays")).alias("kept"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = SIMILAR) -> DataFrame:
    """The rows of docs, with all their columns, that stay."""
    return staying(docs, decisions(docs, id_col, text_col, size, least), id_col, text_col)
