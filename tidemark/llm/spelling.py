"""Words grouped with their spelling variants, found by Aho-Corasick automata over halves of words.

If two words differ by one edit, one half of either stands unchanged in the other: the first half at its start, the second
at its end. So each word gives two segments, marked with the side they belong to, and automata of segments are run over all
words; a match counts if side, offset and length fit, and the distance is then verified. Segments are parted by their three
outermost characters, which a word that holds one has in common with it, so a word visits two shards, not all of them.
Shards with very many words are cut into cells of some segments and some words each.

A segment that more than ``HOT`` words share (``inter...``) would give all pairs of these. Such segments are left out of the
automata; words that have one at the right place are joined by what stands beside it, less one character: no more words than
there are letters and places can share that."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from functools import partial
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import attach, reliable, small_batches

#: Words that may share a segment in an automaton; segments, and words, of a cell; what a Counter holds before it is sent.
HOT, CELL, HELD = 64, 1 << 16, 1 << 18
#: Words of a shard, about, and the outermost characters that part segments; a half of the shortest word has as many.
SHARD, OUTER = 1 << 15, 3
LEAST_LENGTH = 2 * OUTER
#: Fixed by the contract: letters are A-Z, a-z and those from U+00C0 to U+00FF; only A-Z are lower-cased.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_LINKS = "word string, near string, near_n long"


def _runs(text: str) -> list[bytes]:
    """Maximal runs of letters, lower-cased, as UTF-8."""
    return text.encode("latin-1", "replace").translate(_LETTERS).decode("latin-1").encode().split()


def _less_one(run: bytes, h: int) -> bytes:
    chars = run.decode()
    at = h % len(chars)
    return (chars[:at] + chars[at + 1 :]).encode()


def _count(batches, lose: int | None):
    pa.set_memory_pool(pa.system_memory_pool())
    seen: Counter = Counter()

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            all_runs = _runs(text.as_py() or "")
            for a in range(0, len(all_runs), HELD):
                runs = all_runs[a : a + HELD]
                if lose:
                    h = np.fromiter(map(zlib.crc32, runs, repeat(zlib.crc32(f"{key or ''}:".encode()))), np.int64, len(runs))
                    for i in np.flatnonzero(h % lose == 0).tolist():
                        runs[i] = _less_one(runs[i], int(h[i]))
                seen.update(runs)
                if len(seen) > HELD:
                    yield made()
                    seen.clear()
    yield made()


def words_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lose: int | None = None, least: int = 5) -> DataFrame:
    """(word, n) of all words of LEAST_LENGTH characters and at least ``least`` occurrences over all whole texts. With ``lose``,
    a run whose CRC-32 of ``id:run`` is a multiple of it loses one character first. Null texts have no words; null ids count
    as empty texts; repeated rows count as often as they occur."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    counts = source.mapInArrow(partial(_count, lose=lose), "word string, n long").filter(F.length("word") >= LEAST_LENGTH)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one character inserted, deleted or replaced makes a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _scan(table: pa.Table) -> pa.Table:
    """Links between a cell's words: segments are those of rows with one, and the rows with scan are looked through."""
    side = table.column("side")[0].as_py()
    by: dict[str, list[tuple[str, int]]] = defaultdict(list)
    scanned: list[tuple[str, int]] = []
    for word, n, segment, scan in zip(*(table.column(c).to_pylist() for c in ("word", "n", "segment", "scan")), strict=True):
        if scan:
            scanned.append((word, n))
        else:
            by[segment].append((word, n))
    out: list[tuple[str, str, int]] = []
    if by and scanned:
        automaton = ahocorasick.Automaton()
        for segment, own in by.items():
            automaton.add_word(segment, (len(segment), own))
        automaton.make_automaton()
        for word, n in scanned:
            marked = f"<{word}" if side == "<" else f"{word}>"
            for end, (size, own) in automaton.iter(marked):
                if end + 1 != (size if side == "<" else len(marked)):
                    continue
                for other, m in own:
                    if abs(len(other) - len(word)) <= 1 and one_edit(other, word):
                        out += [(word, other, m), (other, word, n)]
    a, b, c = zip(*set(out), strict=True) if out else ((), (), ())
    return pa.table({"word": pa.array(a, pa.string()), "near": pa.array(b, pa.string()), "near_n": pa.array(c, pa.int64())})


def _halves(words: DataFrame) -> DataFrame:
    """Each word's two segments, with the mark of the side that they must stand at."""
    half = F.expr("length(word) div 2")
    first, last = F.concat(F.lit("<"), F.substring("word", F.lit(1), half)), F.concat(F.substring("word", half + 1, F.length("word")), F.lit(">"))
    sides = F.array(F.struct(F.lit("<").alias("side"), first.alias("segment")), F.struct(F.lit(">").alias("side"), last.alias("segment")))
    return words.select("word", "n", F.inline(sides))


def _outer(words: DataFrame) -> DataFrame:
    """The two shards that a word is looked through in, and that its segments belong to."""
    return words.select("word", "n", F.inline(F.array(F.struct(F.lit("<").alias("side"), F.substring("word", 1, OUTER).alias("outer")), F.struct(F.lit(">").alias("side"), F.expr(f"right(word, {OUTER})").alias("outer")))))


def _by_automata(words: DataFrame, segments: DataFrame, total: int) -> DataFrame:
    """Links through segments that few words share."""
    scans = _outer(words)
    pieces = scans.groupBy("side", "outer").agg(F.count("*").alias("size")).filter(F.col("size") > CELL)
    pieces = pieces.select("side", "outer", F.ceil(F.col("size") / CELL).cast("int").alias("pieces"))
    own = F.when(F.col("side") == "<", F.substring("segment", 2, OUTER)).otherwise(F.expr(f"left(right(segment, {OUTER + 1}), {OUTER})"))
    rows = segments.select("side", own.alias("outer"), "word", "n", "segment", F.lit(False).alias("scan")).unionByName(scans.select("side", "outer", "word", "n", F.lit(None).cast("string").alias("segment"), F.lit(True).alias("scan")))
    # at most 2 * words / CELL rows, so a join by shuffle or by broadcast is for Spark to choose
    rows = rows.join(pieces, ["side", "outer"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    mine, all_ = F.pmod(F.xxhash64("word"), F.col("pieces")).cast("int"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    rows = rows.withColumn("mine", mine).withColumn("other", all_)
    cell = F.when(F.col("scan"), F.struct(F.col("other").alias("i"), F.col("mine").alias("j"))).otherwise(F.struct(F.col("mine").alias("i"), F.col("other").alias("j")))
    shards = max(1, 2 * total // SHARD)
    shard = F.when(F.col("pieces") > 1, F.xxhash64("side", "outer", cell)).otherwise(F.pmod(F.xxhash64("outer"), F.lit(shards)))
    return rows.withColumn("shard", shard).groupBy("side", "shard").applyInArrow(_scan, _LINKS)


def _by_rest(words: DataFrame, hot: DataFrame, total: int) -> DataFrame:
    """Links through segments that many words share: words that hold one where it belongs, joined by the rest less a character."""
    n = F.length("word")
    sizes = F.array_distinct(F.transform(F.array(n - 1, n, n + 1), lambda x: F.floor(x / 2).cast("int")))
    ends = F.array_distinct(F.transform(F.array(n - 1, n, n + 1), lambda x: F.ceil(x / 2).cast("int")))
    first = F.transform(sizes, lambda k: F.struct(F.concat(F.lit("<"), F.substring("word", F.lit(1), k)).alias("segment"), F.substring("word", k + 1, n).alias("rest")))
    last = F.transform(ends, lambda k: F.struct(F.concat(F.expr("word").substr(n - k + 1, k), F.lit(">")).alias("segment"), F.substring("word", F.lit(1), n - k).alias("rest")))
    held = words.select("word", "n", F.inline(F.concat(first, last)))
    held = attach(held, hot.withColumn("hot", F.lit(True)), "segment", "size", total).filter("hot")
    rest, at = F.col("rest"), F.sequence(F.lit(1), F.length("rest"))
    less = F.transform(at, lambda i: F.struct(i.alias("at"), F.concat(F.substring(rest, F.lit(1), i - 1), F.substring(rest, i + 1, F.length(rest))).alias("left")))
    longer = held.filter(F.length("rest") > 0).select("segment", "word", "n", F.inline(less))
    # one character replaced: the same place is left out; one more: what is left is another word's rest
    a, b = longer.alias("a"), longer.alias("b")
    replaced = a.join(b, ["segment", "at", "left"]).filter(F.col("a.word") != F.col("b.word")).select(F.col("a.word").alias("word"), F.col("b.word").alias("near"), F.col("b.n").alias("near_n"))
    shorter = held.select("segment", F.col("rest").alias("left"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    more = longer.select("segment", "left", "word", "n").distinct().join(shorter, ["segment", "left"])
    both = F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return replaced.unionByName(more.select(F.inline(both)))


def links(words: DataFrame) -> DataFrame:
    """(word, near, near_n): each word of (word, n) with each word that one edit makes of it, once. words should be kept."""
    total = words.count()
    segments = _halves(words)
    hot = reliable(segments.groupBy("segment").agg(F.count("*").alias("size")).filter(F.col("size") > HOT))
    few = attach(segments, hot, "segment", "size", 2 * total).filter("size is null").drop("size")
    return _by_automata(words, few, total).unionByName(_by_rest(words, hot, 4 * total)).distinct()


def group(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table of distinct words (word, n) of LEAST_LENGTH characters or more.

    A word's form is its near word of greatest n (then the smallest), if that is at least ratio times its own n, which must be
    more than 1 for chains to end; root is where the chain of forms ends, the word itself if it has none. Words without near
    words are there with n_near 0; an empty table gives an empty result. Chains of m forms take log2(m) joins."""
    words = reliable(words.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best")
    found = links(words).groupBy("word").agg(F.count("*").alias("n_near"), best)
    is_form = -F.col("best.n") >= ratio * F.col("n")
    made = words.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n"))
    made = reliable(made)
    chains = reliable(made.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        step = chains.select(F.col("word").alias("root"), F.col("root").alias("further"))
        chains = reliable(chains.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if chains.filter("moved").isEmpty():
            break
        chains = chains.drop("moved")
    return made.join(chains.drop("moved"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
