"""Language-model scoring by prediction by partial matching (PPM, escape method D, full symbol exclusion).

A text is lower-cased, its words joined by spaces, and ended by a newline: these bytes are what the model predicts, each
from up to ``ORDER`` bytes before it. Training counts every gram of ORDER + 1 bytes over the whole corpus; the trie of
shorter contexts follows from these counts, and none is left out. All contexts of ``SHARED`` bytes and more that a gram
is predicted from end in the same SHARED bytes, so the trie is parted by these; only the shorter ones, at most
256 ** SHARED grams, are known to every part. Each part gives its distinct grams their code lengths. Scoring looks up each
distinct gram of a chunk of text once, in slices of ``LEVEL`` grams of which a worker holds one at a time, and adds code
lengths by document. A unigram baseline over words is counted in the same pass."""

from __future__ import annotations

from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fold, most_frequent, reliable, texts, word_hashes

#: Bytes of the longest context, those that part the trie, the most grams of a slice, the most words that are broadcast, bytes worked on at once.
ORDER = 5
SHARED = 2
LEVEL = 1 << 20
COMMON = 1 << 18
CHUNK_BYTES = 3 << 19
#: Training leaves out the rows whose fold of FOLDS is HELD_OUT.
FOLDS, HELD_OUT = 7, 2
END = b"\n"


class Level(NamedTuple):
    """One order's grams (sorted; the low byte is the symbol) with counts, and its contexts: what they hold in all, how
    many symbols, and how much of the next shorter context their symbols make up."""

    grams: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    symbols: np.ndarray
    excluded: np.ndarray


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << 8 * (order + 1)) - 1)


def levels(tables: list[tuple[np.ndarray, np.ndarray]], lower: list[Level] | None = None) -> list[Level]:
    """The trie from (grams, counts) of the orders 0, 1, ..., or of those that follow the lower ones; a gram whose shorter
    form is missing is left out."""
    out: list[Level] = list(lower or [])
    for k, (grams, counts) in enumerate(tables, len(out)):
        order = np.argsort(grams)
        grams, counts = grams[order].astype(np.uint64), counts[order].astype(np.float64)
        below = np.zeros(len(grams))
        if k:
            at, held = _find(out[-1].grams, grams & _mask(k - 1))
            grams, counts, below = grams[held], counts[held], out[-1].counts[at[held]]
        contexts, first = np.unique(grams >> np.uint64(8), return_index=True)
        ends = np.append(first[1:], len(grams))
        total = lambda x, first=first: np.add.reduceat(x, first) if len(first) else np.zeros(0)
        out.append(Level(grams, counts, contexts, total(counts), (ends - first).astype(np.float64), total(below)))
    return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def log10_probability(model: list[Level], grams: np.ndarray) -> np.ndarray:
    """log10 of the probability of each gram's last byte after the bytes before it. grams should be sorted, for speed."""
    out = np.zeros(len(grams))
    open_ = np.arange(len(grams))
    taken, taken_symbols = np.zeros(len(grams)), np.zeros(len(grams))
    for k in range(len(model) - 1, -1, -1):
        level, keys = model[k], grams[open_] & _mask(k)
        where, known = _find(level.contexts, keys >> np.uint64(8))
        at, seen = _find(level.grams, keys)
        if len(level.contexts):
            total = np.where(known, level.totals[where] - taken[open_], 0.0)
            symbols = np.where(known, level.symbols[where] - taken_symbols[open_], 0.0)
            # method D: every symbol gives half a count to the escape
            ways = np.where(seen, (level.counts[at] if len(level.counts) else 0.0) - 0.5, symbols / 2)
            possible = ways > 0
            out[open_[possible]] += np.log10(ways[possible] / total[possible])
            taken[open_] = np.where(known, level.excluded[where], 0.0)
            taken_symbols[open_] = np.where(known, level.symbols[where], 0.0)
        open_ = open_[~seen]
    # what no context has seen: evenly among the bytes that no context has
    out[open_] -= np.log10(np.maximum(1.0, 256.0 - (taken_symbols[open_])))
    return out


def normal(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def grams_of(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all bytes of some normalised texts, each begun by ORDER ends; and where each text's grams start."""
    flat = np.frombuffer(b"".join(END * ORDER + p for p in parts), np.uint8)
    sizes = np.array([len(p) for p in parts], np.int64)
    keep = np.ones(len(flat), bool)
    first = np.cumsum(sizes + ORDER) - sizes - ORDER
    keep[(first[:, None] + np.arange(ORDER)).reshape(-1)] = False
    g = flat.astype(np.uint64)
    for j in range(1, ORDER + 1):
        g[j:] |= flat[:-j].astype(np.uint64) << np.uint64(8 * j)
    return g[keep], np.cumsum(sizes) - sizes


def _chunks(batches):
    """Rows with their normalised bytes and word hashes, some MB at a time; a text that is longer stands alone."""
    ids, parts, words, size = [], [], [], 0
    for batch in batches:
        extra = zip(*(batch.column(c).to_pylist() for c in batch.schema.names if c != "text"), strict=True) if batch.num_columns > 1 else [()] * batch.num_rows
        for x, t in zip(extra, texts(batch), strict=True):
            own = t.lower().split()
            ids.append(x)
            parts.append(normal(own))
            words.append(word_hashes(own))
            size += len(parts[-1])
            if size >= CHUNK_BYTES:
                yield ids, parts, words
                ids, parts, words, size = [], [], [], 0
    if ids:
        yield ids, parts, words


def _train(batches):
    """Words of learnt rows, and all grams with their counts in learnt rows; those of held-out rows alone count zero."""
    for ids, parts, words in _chunks(batches):
        learnt = [not held_out for (held_out,) in ids]
        own = np.concatenate([np.empty(0, np.uint64), *(w for w, x in zip(words, learnt, strict=True) if x)])
        grams = grams_of(parts)[0]
        times = np.repeat(learnt, [len(p) for p in parts]).astype(np.float64)
        distinct, which = np.unique(grams, return_inverse=True)
        for kind, (keys, n) in enumerate((np.unique(own, return_counts=True), (distinct, np.bincount(which, times, len(distinct)).astype(np.int64)))):
            for a in range(0, len(keys), 65536):
                k = keys[a : a + 65536]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k.view(np.int64)), pa.array(n[a : a + 65536])], ["kind", "key", "n"])


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = df.select("key", "n").toArrow()
    return table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()


def shorter(keys: np.ndarray, n: np.ndarray, orders: range) -> list[tuple[np.ndarray, np.ndarray]]:
    """(grams, counts) of some orders, from counts of grams that are as long or longer."""
    out = []
    for k in orders:
        grams, which = np.unique(keys & _mask(k), return_inverse=True)
        out.append((grams, np.bincount(which, n, len(grams))))
    return out


def _part(table: pa.Table, lower) -> pa.Table:
    keys, n = table.column("key").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    model = levels(shorter(keys[n > 0], n[n > 0], range(SHARED, ORDER + 1)), lower.value)
    return pa.table({"key": keys.view(np.int64), "log": log10_probability(model, keys)})


def code_lengths(grams: DataFrame) -> DataFrame:
    """(key, log): log10 of the probability of each gram of ORDER + 1 bytes, from counts (key, n) that may be zero."""
    short = grams.filter("n > 0").groupBy(F.col("key").bitwiseAND(F.lit(int(_mask(SHARED - 1)))).alias("key")).agg(F.sum("n").alias("n"))
    lower = grams.sparkSession.sparkContext.broadcast(levels(shorter(*_arrays(short), range(SHARED))))
    part = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * SHARED) - 1)).alias("part")

    def coded(table: pa.Table) -> pa.Table:
        return _part(table, lower)

    return reliable(grams.select("key", "n", part).groupBy("part").applyInArrow(coded, "key long, log double"))


def _packed(batches, most: int):
    for batch in batches:
        for a in range(0, batch.num_rows, most):
            keys, logs = (c.to_numpy(zero_copy_only=False)[a : a + most].tobytes() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array([keys]), pa.array([logs])], ["keys", "logs"])


def slices(coded: DataFrame, most: int) -> list[tuple]:
    """(least key, greatest key, broadcast of (keys, logs)) of each run of at most most keys, in order. The driver holds
    one run at a time beside the partition that it comes from."""
    out, held, size = [], [], 0
    share = coded.sparkSession.sparkContext.broadcast

    def close() -> None:
        keys, logs = (np.concatenate(x) for x in zip(*held, strict=True))
        out.append((keys[0], keys[-1], share((keys, logs))))

    for r in coded.orderBy("key").mapInArrow(partial(_packed, most=most), "keys binary, logs binary").toLocalIterator():
        keys, logs = np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["logs"], np.float64)
        if held and size + len(keys) > most:
            close()
            held, size = [], 0
        held.append((keys, logs))
        size += len(keys)
    if held:
        close()
    return out


def looked_up(runs: list[tuple], grams: np.ndarray) -> np.ndarray:
    """The logs of distinct sorted grams; of several runs, no more than one is kept in memory."""
    out, found = np.empty(len(grams)), 0
    for least, greatest, shared in runs:
        a, b = np.searchsorted(grams, least), np.searchsorted(grams, greatest, side="right")
        if a < b:
            keys, logs = shared.value
            at, held = _find(keys, grams[a:b])
            out[a:b] = logs[at]
            found += int(held.sum())
            if len(runs) > 1:
                vars(shared).pop("_value", None)
    if found < len(grams):
        raise RuntimeError("the texts changed between counting and scoring")
    return out


SCORED = "id {kind}, row long, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>"


def _score(batches, runs, common, ends: int):
    keys, counts = common.value
    for ids, parts, words in _chunks(batches):
        grams, starts = grams_of(parts)
        distinct, which = np.unique(grams, return_inverse=True)
        score = np.add.reduceat(looked_up(runs, distinct)[which], starts)
        flat = np.concatenate(words)
        at, held = _find(keys, flat)
        gain = np.where(held, np.log10((counts[at] if len(counts) else 0) + 1.0), 0.0)
        known = np.concatenate([[0], np.cumsum(held)])
        edges = np.cumsum([0] + [len(w) for w in words])
        base = np.array([gain[a:b].sum() for a, b in zip(edges[:-1], edges[1:], strict=True)])
        rare = pa.ListArray.from_arrays(pa.array((edges - known[edges]).astype(np.int32)), pa.array(flat[~held].view(np.int64)))
        id_, row, held_out = zip(*ids, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(id_), pa.array(row, pa.int64()), pa.array(held_out, pa.bool_()), pa.array(np.diff(edges) + 1), pa.array(np.diff(known[edges]) + (ends > 0)), pa.array(base + np.log10(ends + 1.0)), pa.array(score), rare],
            ["id", "row", "held_out", "n_tokens", "known", "base", "score", "rare"],
        )


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose fold is HELD_OUT are scored but not learnt from. A null or empty text is a single end. Repeated rows are
    each scored and each learnt from. With nothing to learn from, every byte has probability 1/256 and every token 1.
    Extra columns are left out; an empty table gives an empty result."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    held_out = (fold(F.col(id_col), FOLDS) == HELD_OUT).alias("held_out")
    source = docs.select(F.col(id_col).alias("id"), held_out, F.col(text_col).alias("text"))
    learnt = source.filter("not held_out").select("text")
    counts = reliable(source.select("held_out", "text").mapInArrow(_train, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")))
    words, grams = counts.filter("kind = 0").select("key", "n"), counts.filter("kind = 1").select("key", "n")
    # every text has one end, and the ends are the grams' newlines: as many as there are texts
    ends = learnt.count()
    in_all, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    train_tokens, types = in_all + ends, distinct + (ends > 0)
    common = _arrays(most_frequent(words, COMMON))
    order = np.argsort(common[0])
    share = spark.sparkContext.broadcast
    run = partial(_score, runs=slices(code_lengths(grams), LEVEL), common=share((common[0][order], common[1][order])), ends=ends)
    numbered = source.select("id", F.monotonically_increasing_id().alias("row"), "held_out", "text")
    rows = reliable(numbered.mapInArrow(run, SCORED.format(kind=kind)))
    rare = rows.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    found = rare.join(words, "key").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("gain"))
    unit = float(np.log10(train_tokens + 1.0 * (types + 1)))
    joined = rows.drop("rare").join(found, "row", "left")
    return joined.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("gain", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)).alias("base_score"), "score",
    )
