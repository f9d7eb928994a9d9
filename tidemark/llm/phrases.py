"""Phrases whose words stand together more often than chance, by language.

Words are counted once; those with at least ``least`` occurrences get numbers, and the texts become arrays of these numbers.
Then, from two words up, each pass works on phrases that may be frequent because both of their parts without the last and
without the first word are (Apriori). A phrase is written as the pair of these parts' slots, which is exact, so nothing rests
on a hash of words. Mappers first count hashes of such pairs into buckets and add the arrays up as a tree; pairs of buckets
that reach ``least`` are counted by a shuffle, each mapper's distinct ones with their counts, a part of the pairs at a time.
Frequent pairs get a minimal perfect hash, which keeps each slot's pair and compares it. What the cuts of a phrase need is
read by slot. However many pairs the buckets let through, only the frequent ones leave the shuffle.

Words are broadcast up to ``MOST``, frequent phrases of each length up to ``PHRASES`` times as many; with more of them, all phrases are counted by a
shuffle (``_by_shuffle``), with the same result."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import partial
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import reliable, small_batches, stage_folder, texts, to_driver
from tidemark.llm.mph import NONE, PerfectHash, scattered

#: The most words that are broadcast, and for each of these the frequent phrases of one length (to mappers 8.5 bytes each).
MOST, PHRASES = 1 << 20, 8
#: Numbers of words in one row of the table of texts, words of a mapper at least if there are many, and those for each bucket.
ROW, MAPPER, LOAD = 1 << 18, 1 << 26, 32
#: Buckets, as powers of two; places of an array that are sent together; arrays that are added up at once.
LEAST_POWER, MOST_POWER, RANGE, FAN = 16, 25, 1 << 16, 16
#: Words of the corpus for each part of the pairs that are counted by a shuffle.
PART = 1 << 22
#: What a Counter holds before it is sent on.
HELD = 1 << 17
#: Fixed by the contract: what ends a piece, what parts words in it, and the language of rows without one. A byte that no text
#: holds stands for a piece's end.
BREAKS, BLANKS, NO_LANGUAGE = b".,;:!?\n\x0b\x0c\r", b" \t", "und"
_END = b"\xff"
_TABLE = bytes.maketrans(BREAKS + b"\t", _END * len(BREAKS) + b" ")
_ARRAYS = "place int, mapper int, counts binary"


def _words(text: bytes) -> list[bytes]:
    """Lower-cased words, and _END where a piece ends."""
    return text.lower().translate(_TABLE).replace(_END, b" " + _END + b" ").split()


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    for lang, text in zip(batch.column("lang").to_pylist(), texts(batch), strict=True):
        yield lang, _words(text)


def _word_rows(seen: dict[str, Counter], totals: Counter) -> pa.RecordBatch:
    rows = [(lang, w.decode("utf-8", "replace"), n) for lang, c in seen.items() for w, n in c.items()]
    lang, word, n = zip(*rows, *((lang, None, n) for lang, n in totals.items()), strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["lang", "word", "n"])


def _count_words(batches, longest: int = 1):
    """Local counts of all phrases of up to longest words; a row without a word counts all words of its language."""
    pa.set_memory_pool(pa.system_memory_pool())
    seen: dict[str, Counter] = defaultdict(Counter)
    totals: Counter = Counter()
    for batch in batches:
        for lang, words in _by_language(batch):
            for a in range(0, len(words), HELD):  # a part at a time, so that what a very long text holds can be sent on too
                own = seen[lang]
                own.update(words[a : a + HELD])
                totals[lang] += len(words[a : a + HELD]) - own.pop(_END, 0)
                for k in range(2, longest + 1):
                    part = words[a : a + HELD + k - 1]
                    own.update(b" ".join(run) for run in zip(*(part[i:] for i in range(k)), strict=False) if _END not in run)
                if sum(map(len, seen.values())) > HELD:
                    yield _word_rows(seen, totals)
                    seen.clear()
                    totals.clear()
    yield _word_rows(seen, totals)


class _Numbers:
    """Numbers of frequent words, language after language; as one text until a worker needs tables."""

    def __init__(self, words: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in words})
        by: dict[str, list[str]] = {lang: [] for lang in self.languages}
        for lang, word in words:
            by[lang].append(word)
        self.text = [" ".join(sorted(by[lang])).encode() for lang in self.languages]
        self.sizes = [len(by[lang]) for lang in self.languages]

    def words(self) -> list[bytes]:
        return [w for t in self.text for w in t.split(b" ") if t]

    def language_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.languages)), self.sizes)

    def tables(self) -> dict[str, dict[bytes, int]]:
        out, n = {}, 0
        for lang, t in zip(self.languages, self.text, strict=True):
            out[lang] = {w: n + i for i, w in enumerate(t.split(b" "))}
            n += len(out[lang])
        return out


def _number(batches, shared):
    """Texts as numbers of words, NONE for words that are not frequent and between pieces and texts."""
    pa.set_memory_pool(pa.system_memory_pool())
    tables, parts, held = shared.value.tables(), [], 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.concatenate(parts).tobytes()], pa.binary())], ["numbers"])

    for batch in batches:
        for lang, words in _by_language(batch):
            find = tables.get(lang, {}).get
            for a in range(0, len(words), ROW):
                # rows overlap nowhere: a text longer than a row goes on in the same row
                parts.append(np.fromiter(map(find, words[a : a + ROW], repeat(NONE)), np.int32))
            parts.append(np.array([NONE], np.int32))
            held += len(words) + 1
            if held >= ROW:
                yield made()
                parts, held = [], 0
    if parts:
        yield made()


class Slots:
    """Frequent phrases of one length: slots of pairs of shorter phrases' slots, and their counts."""

    def __init__(self, table: PerfectHash, counts: np.ndarray):
        self.table, self.counts = table, counts


def _pairs(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where two neighbouring phrases are both frequent, and their pair as a key."""
    at = np.flatnonzero((slots[:-1] >= 0) & (slots[1:] >= 0))
    return at, (slots[at].astype(np.uint64) << np.uint64(32)) | slots[at + 1].astype(np.uint64)


def _frequent(numbers: np.ndarray, levels: list[PerfectHash]) -> np.ndarray:
    """At each place the slot of the phrase of len(levels) + 1 words that begins there, NONE if it is not frequent."""
    slots = numbers
    for level in levels:
        at, keys = _pairs(slots)
        slots = np.full(len(numbers), NONE, np.int32)
        slots[at] = level.slots(keys)
    return slots


def _keys(batches, levels: list[PerfectHash]) -> Iterator[np.ndarray]:
    for batch in batches:
        for row in batch.column("numbers"):
            yield _pairs(_frequent(np.frombuffer(row.as_buffer(), np.int32), levels))[1]


def _sent(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """An array in ranges, each in the narrowest type that holds it."""
    from pyspark import TaskContext

    mapper = TaskContext.get().partitionId()
    for place in range(0, len(counts), RANGE):
        part = counts[place : place + RANGE]
        if part.any():
            yield _array_row(place // RANGE, mapper, part)


def _array_row(place: int, mapper: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([mapper], pa.int32()), pa.array([_narrow(counts)], pa.binary())], ["place", "mapper", "counts"])


def _narrow(counts: np.ndarray) -> bytes:
    top = int(counts.max(initial=0))
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + counts.astype(kind).tobytes()


def _array(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.dtype(f"u{data[0]}"), offset=1).astype(np.int64)


def _add(table: pa.Table, cap: int | None = None) -> pa.Table:
    total = None
    for data in table.column("counts").to_pylist():
        part = _array(data)
        total = part if total is None else total + part
    total = total if cap is None else np.minimum(total, cap)
    return pa.Table.from_batches([_array_row(table.column("place")[0].as_py(), table.column("mapper")[0].as_py() // FAN, total)])


def _tree_sum(rows: DataFrame, mappers: int, size: int, cap: int | None = None) -> np.ndarray:
    """The sum of the mappers' arrays of size places: FAN of a range at a time, as often as it takes."""
    while True:
        rows = rows.groupBy("place", (F.col("mapper") / FAN).cast("int").alias("group")).applyInArrow(lambda table: _add(table, cap), _ARRAYS)
        mappers = -(-mappers // FAN)
        if mappers <= 1:
            break
    out = np.zeros(size, np.int64)
    for row in to_driver(rows.select("place", "counts")):
        at = row["place"] * RANGE
        part = _array(bytes(row["counts"]))
        out[at : at + len(part)] = part
    return out


def _bucket(keys: np.ndarray, power: int) -> np.ndarray:
    return (scattered(keys, 99) >> np.uint64(64 - power)).astype(np.int64)


def _sieve(batches, levels, power: int, cap: int):
    counts = np.zeros(1 << power, np.int64)
    for keys in _keys(batches, levels.value):
        if len(keys) * 8 > len(counts):
            counts += np.bincount(_bucket(keys, power), minlength=len(counts))
        else:
            np.add.at(counts, _bucket(keys, power), 1)
    yield from _sent(np.minimum(counts, cap))


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts."""
    every = np.concatenate(keys)
    order = np.argsort(every)
    every = every[order]
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    return every[starts], np.add.reduceat(np.concatenate(counts)[order], starts)


def _counted(batches, levels, power: int, sieve, parts: int):
    """Distinct pairs of a mapper whose buckets are frequent, and how often it has them, by part."""
    open_ = np.unpackbits(np.frombuffer(sieve.value, np.uint8), bitorder="little").astype(bool)

    def made(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        part = (scattered(keys, 98) >> np.uint64(32)).astype(np.int64) * parts >> 32
        order = np.argsort(part, kind="stable")
        cuts = np.searchsorted(part[order], np.arange(parts + 1))
        rows = [(p, keys[order[a:b]].tobytes(), _narrow(counts[order[a:b]])) for p, (a, b) in enumerate(pairwise(cuts.tolist())) if b > a]
        return pa.RecordBatch.from_arrays([pa.array([p for p, *_ in rows], pa.int32()), pa.array([k for _, k, _ in rows], pa.binary()), pa.array([c for *_, c in rows], pa.binary())], ["part", "keys", "counts"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    for keys in _keys(batches, levels.value):
        held.append(np.unique(keys[open_[_bucket(keys, power)]], return_counts=True))
        n += len(held[-1][0])
        if n > 1 << 21:
            held = [_merged(*zip(*held, strict=True))]
            n = len(held[0][0])
            if n > 1 << 20:
                yield made(*held[0])
                held, n = [], 0
    if n:
        yield made(*_merged(*zip(*held, strict=True)))


def _summed(table: pa.Table, least: int) -> pa.Table:
    """A part's frequent pairs with their counts."""
    keys, counts = _merged([np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()], [_array(x) for x in table.column("counts").to_pylist()])
    often = counts >= least
    return pa.table({"n": pa.array([int(often.sum())], pa.int64()), "keys": pa.array([keys[often].tobytes()], pa.binary()), "counts": pa.array([_narrow(counts[often])], pa.binary())})


def _next(numbers: DataFrame, levels: list[Slots], least: int, mappers: int, power: int, parts: int, most: int) -> Slots | None:
    """The frequent phrases of one word more; None if there are more than may be broadcast."""
    share = numbers.sparkSession.sparkContext.broadcast
    shared = share([x.table for x in levels])
    counts = _tree_sum(numbers.mapInArrow(partial(_sieve, levels=shared, power=power, cap=least), _ARRAYS), mappers, 1 << power, least)
    sieve = share(np.packbits(counts >= least, bitorder="little").tobytes())
    pairs = numbers.mapInArrow(partial(_counted, levels=shared, power=power, sieve=sieve, parts=parts), "part int, keys binary, counts binary")
    pairs = reliable(pairs.groupBy("part").applyInArrow(lambda table: _summed(table, least), "n long, keys binary, counts binary"))
    for b in (shared, sieve):
        b.unpersist()
    if (pairs.agg(F.sum("n")).first()[0] or 0) > most:
        return None
    rows = [(bytes(r["keys"]), bytes(r["counts"])) for r in pairs.filter("n > 0").coalesce(8).toLocalIterator()]
    keys = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(k, np.uint64) for k, _ in rows)])
    table = PerfectHash(keys)
    found = np.zeros(len(table), np.int64)
    if len(table):
        found[table.slots(keys)] = np.concatenate([_array(c) for _, c in rows])
    return Slots(table, found)


class Found:
    """Words with their counts, and the phrases of two words and more."""

    def __init__(self, numbers: _Numbers, counts: np.ndarray, totals: list[int], levels: list[Slots], drop_percent: int):
        self.numbers, self.counts, self.totals, self.levels = numbers, [counts, *(x.counts for x in levels)], totals, levels
        self.kept = [np.ones(len(x.table), bool) for x in levels]
        # no longer phrase that holds one is more frequent than those of just a word more that do
        for level, longer in enumerate(levels[1:], 2):
            slots = np.arange(len(longer.table))
            for part in self.parts(level, slots):
                full = 100 * longer.counts[slots] >= drop_percent * self.counts[level - 1][part]
                self.kept[level - 2][part[full]] = False

    def parts(self, level: int, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of phrases without their last and without their first word; level 1: two words."""
        keys = self.levels[level - 1].table.keys[slots]
        return (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def part(self, level: int, slots: np.ndarray, size: int, last: bool) -> np.ndarray:
        """Slots of their first (or last) size words."""
        while level + 1 > size:
            slots, level = self.parts(level, slots)[int(last)], level - 1
        return slots

    def ranges(self, width: int = 1 << 15) -> list[tuple[int, int, int]]:
        return [(i + 1, a, min(a + width, len(k))) for i, k in enumerate(self.kept) for a in range(0, len(k), width)]

    def scored(self, level: int, start: int, stop: int) -> list[tuple[str, str, int, int, int, int, int]]:
        """(lang, phrase, a, l, r, n, score) of the slots of a range that are kept."""
        slots = start + np.flatnonzero(self.kept[level - 1][start:stop])
        if not len(slots):
            return []
        a = self.counts[level][slots].astype(object)
        numbers = [self.part(i, self.part(level, slots, i + 1, False), 1, True) for i in range(level + 1)]
        lang = self.numbers.language_of()[numbers[0]]
        n = np.array(self.totals, object)[lang]
        best = None
        for cut in range(1, level + 1):
            left = self.counts[cut - 1][self.part(level, slots, cut, False)].astype(object)
            right = self.counts[level - cut][self.part(level, slots, level + 1 - cut, True)].astype(object)
            score = 1000 * a * n // (left * right)
            if best is None:
                best = [score, left, right]
            else:
                lower = (score < best[0]).astype(bool)
                best = [np.where(lower, x, y) for x, y in zip((score, left, right), best, strict=True)]
        words = self.numbers.words()
        phrases = [b" ".join(words[i] for i in row).decode() for row in zip(*(x.tolist() for x in numbers), strict=True)]
        return list(zip([self.numbers.languages[i] for i in lang], phrases, a, best[1], best[2], n, best[0], strict=True))


def _score(batches, shared, top: int):
    """The first top of each language in each range."""
    for batch in batches:
        for level, start, stop in zip(*(batch.column(c).to_pylist() for c in ("level", "start", "stop")), strict=True):
            rows = sorted(shared.value.scored(level, start, stop), key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
            seen: Counter = Counter()
            out = []
            for r in rows:
                seen[r[0]] += 1
                if seen[r[0]] <= top:
                    out.append(r)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i < 2 else pa.int64()) for i, x in enumerate(zip(*out, strict=True))], ["lang", "phrase", "a", "l", "r", "n", "score"])


_SCORED = "lang string, phrase string, a long, l long, r long, n long, score long"


def _first(scored: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return scored.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _by_shuffle(source: DataFrame, totals: DataFrame, least: int, longest: int, drop_percent: int) -> DataFrame:
    """Scores of all kept phrases: counts of all phrases by a shuffle, cuts by joins. Nothing is broadcast for its size."""
    counts = source.mapInArrow(partial(_count_words, longest=longest), "lang string, word string, n long").filter("word is not null").groupBy("lang", F.col("word").alias("phrase")).agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    counts = reliable(counts.withColumn("words", F.split("phrase", " ")))
    longer = counts.filter(F.size("words") > 2)
    inner: Callable[[int, int], Column] = lambda start, less: F.array_join(F.slice("words", F.lit(start), F.size("words") - less), " ")
    held = longer.select("lang", F.col("a").alias("longer"), F.explode(F.array(inner(1, 1), inner(2, 1))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = counts.filter(F.size("words") > 1).join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < drop_percent * F.col("a")))
    cuts = kept.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("cut"))
    part = lambda start, size: F.array_join(F.slice("words", start, size), " ")
    cuts = cuts.withColumns({"left": part(F.lit(1), F.col("cut")), "right": part(F.col("cut") + 1, F.size("words") - F.col("cut"))})
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)), ["lang", side])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = cuts.join(totals, "lang").withColumns({"over": wide("a") * wide("n") * 1000, "under": wide("l") * wide("r")}).withColumn("score", F.expr("`over` div `under`"))
    best = F.min_by(F.struct("l", "r", "n", "score"), F.struct("score", "cut")).alias("best")
    return score.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "best.n", "best.score")


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 100, longest: int = 5, top: int = 2000, drop_percent: int = 100, most: int = MOST) -> DataFrame:
    """Each language's first top phrases: lang, rank (from 1), phrase, a, l, r, n, score; see the contract of op12.

    A phrase has 2 to longest words of one piece and at least ``least`` occurrences (a), overlapping ones included. Its score is
    the least, over all cuts in two, of 1000 * a * n / (l * r) rounded down, n being all words of the language, l and r what the
    two parts occur; of equal cuts the first counts. A phrase goes if drop_percent of its occurrences lie in some longer phrase.
    Null languages are ``und``, null and empty texts have no words; repeated rows count as often as they occur; an empty table
    gives an empty result; other columns are left out. Scores are exact whatever their factors' size."""
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text_col).alias("text"))
    if longest < 2:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    counted = source.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = reliable(counted.filter((F.col("n") >= least) | F.col("word").isNull()))
    totals, frequent = counted.filter("word is null").select("lang", "n"), counted.filter("word is not null")
    levels: list[Slots] = []
    if frequent.count() <= most:
        words = {(r["lang"], r["word"]): r["n"] for r in frequent.coalesce(8).toLocalIterator()}
        numbers = _Numbers(list(words))
        n = {r["lang"]: r["n"] for r in totals.filter(F.col("lang").isin(numbers.languages)).collect()}
        folder = stage_folder(spark)
        source.mapInArrow(partial(_number, shared=spark.sparkContext.broadcast(numbers)), "numbers binary").write.parquet(folder)
        total = sum(n.values())
        mappers = max(2 * spark.sparkContext.defaultParallelism, -(-total // MAPPER))
        power = min(MOST_POWER, max(LEAST_POWER, (total // LOAD).bit_length() - 1))
        parts = max(1, most >> 16, total // PART)
        table = spark.read.parquet(folder).coalesce(mappers)
        found: Slots | None = None
        while len(levels) < longest - 1:
            found = _next(table, levels, least, mappers, power, parts, PHRASES * most)
            if found is None or not len(found.table):
                break
            levels.append(found)
        if found is not None:
            named = [(lang, w.decode()) for lang, t in zip(numbers.languages, numbers.text, strict=True) for w in t.split(b" ")]
            made = Found(numbers, np.array([words[x] for x in named], np.int64), [n[x] for x in numbers.languages], levels, drop_percent)
            ranges = made.ranges()
            rows = spark.createDataFrame(ranges or [], "level int, start int, stop int").repartition(max(1, len(ranges)))
            return _first(rows.mapInArrow(partial(_score, shared=spark.sparkContext.broadcast(made), top=top), _SCORED), top)
    return _first(_by_shuffle(source, totals, least, longest, drop_percent), top)
