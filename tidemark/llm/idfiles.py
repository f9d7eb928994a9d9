"""Token ids in binary files, in the order of their documents' ids.

Rows are range-partitioned by id and sorted within, so a partition's files follow those of the partition before it. A task
writes its rows as files of about ``FILE_IDS`` ids, each of whole documents, under names that no other attempt uses; what
it returns is a row for each file. These rows, written by Spark as a Parquet table beside the files, are the commit: files
of lost or doubled attempts are in no row and are never read.

A file: eight numbers of 64 bits, little-endian (``MAGIC``, documents, ids, words and raw values of the lengths' coding, words
and raw values of the ids' coding, 0), then these arrays: documents' ids (64 bits), whether each is there (bytes, filled up to
eight), and the two codings of ``simple8b`` (documents' lengths; all ids), each as its blocks' first words, words, raw values."""

from __future__ import annotations

import re
import uuid
from functools import partial
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import simple8b
from tidemark.llm.bpe import _ids, _settings, _sizes, _tokenizer, _unicode_bytes, gather, joined
from tidemark.llm.common import reliable, slices, small_batches

MAGIC = int.from_bytes(b"tidsids1", "little")
#: Ids of a file, about; a document with more has a file of its own.
FILE_IDS = 1 << 20
#: Words whose ids a worker keeps, and bytes of text that it splits at once.
KEPT, SLICE = 200_000, 1 << 21
MANIFEST = "part int, number int, name string, documents long, ids long, bytes long"


def _coding(values: np.ndarray) -> tuple[simple8b.Coded, list[np.ndarray]]:
    coded = simple8b.encode(values)
    return coded, [coded.starts.astype("<i8"), coded.words.astype("<u8"), coded.raw.astype("<u8")]


def packed(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes: documents' keys, how many ids each has, and all their ids."""
    there = np.array([k is not None for k in keys], np.uint8)
    (sizes, a), (tokens, b) = _coding(lengths), _coding(ids)
    head = np.array([MAGIC, len(keys), len(ids), len(sizes.words), len(sizes.raw), len(tokens.words), len(tokens.raw), 0], "<u8")
    there = np.concatenate([there, np.zeros(-len(there) % 8, np.uint8)])
    return b"".join(x.tobytes() for x in (head, np.array([k or 0 for k in keys], "<i8"), there, *a, *b))


def unpacked(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(keys, lengths, ids) of a file's bytes."""
    head = np.frombuffer(data, "<u8", 8).astype(np.int64)
    if head[0] != MAGIC:
        raise ValueError("not a file of token ids")
    n, total, at = int(head[1]), int(head[2]), 64

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    def coding(values: int, words: int, raw: int) -> np.ndarray:
        starts = take("<i8", -(-values // simple8b.BLOCK) + 1)
        return simple8b.decode(simple8b.Coded(take("<u8", words), starts, take("<u8", raw)), values)

    keys, there = take("<i8", n).tolist(), take("u1", n + -n % 8)[:n].tolist()
    lengths = coding(n, int(head[3]), int(head[4])).astype(np.int64)
    return [k if t else None for k, t in zip(keys, there, strict=True)], lengths, coding(total, int(head[5]), int(head[6]))


def _file_system(uri: str):
    """The store of a folder and the folder's path in it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def _released() -> None:
    """Gives free memory back: workers live on after a task, and the arrays of one would else count beside those of the next."""
    pa.system_memory_pool().release_unused()


def _flat(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of lists (null: 0) and their values."""
    lengths = _sizes(ids, pc.list_value_length).astype(np.int64)
    return lengths, pc.fill_null(ids.flatten(), 0).to_numpy(zero_copy_only=False)


def _write(batches, folder: str, most: int):
    from pyspark import TaskContext

    part, number, attempt = TaskContext.get().partitionId(), 0, uuid.uuid4().hex
    store, path = _file_system(folder)
    keys, lengths, ids, held = [], [], [], 0

    def made() -> pa.RecordBatch:
        nonlocal keys, lengths, ids, held, number
        name = f"{part:06d}-{number:06d}-{attempt}.ids"
        data = packed(keys, np.concatenate(lengths), np.concatenate(ids))
        with store.open_output_stream(f"{path}/{name}") as out:
            out.write(data)
        row = [part, number, name, len(keys), held, len(data)]
        keys, lengths, ids, held, number = [], [], [], 0, number + 1
        _released()
        return pa.RecordBatch.from_pylist([dict(zip(("part", "number", "name", "documents", "ids", "bytes"), row, strict=True))], pa.schema([("part", pa.int32()), ("number", pa.int32()), ("name", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

    for batch in batches:
        for rows in slices(batch, _sizes(batch.column("ids"), pc.list_value_length), most):
            size, values = _flat(rows.column("ids"))
            keys += rows.column("id").to_pylist()
            lengths.append(size)
            ids.append(values)
            held += len(values)
            if held >= most:
                yield made()
    if keys:
        yield made()


def write(tokens: DataFrame, folder: str, id_col: str = "doc_id", ids_col: str = "ids", most: int = FILE_IDS) -> DataFrame:
    """Writes tokens, already in ascending order of partitions and rows (``encoded`` gives them so), as files in folder/data
    and a table of them in folder/files, and returns that table: part, number, name, documents, ids, bytes.

    ids_col holds arrays of whole numbers from 0 to 2**64 - 1 as longs or ints, null counts as empty and a null in an array
    as 0; id_col holds whole numbers or nulls. Repeated rows are each written; no row gives no file; other columns are left
    out. The folder is in a store that executors share; a rerun of a task writes other files, and only one counts."""
    spark = tokens.sparkSession
    small_batches(spark)
    store, path = _file_system(folder)
    store.create_dir(f"{path}/data", recursive=True)
    source = tokens.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    source.mapInArrow(partial(_write, folder=f"{folder}/data", most=most), MANIFEST).write.mode("overwrite").parquet(f"{folder}/files")
    return spark.read.parquet(f"{folder}/files")


def in_order(docs: DataFrame, id_col: str = "doc_id", *also: str) -> DataFrame:
    """docs range-partitioned and sorted by id (null first); rows with one id lie by the hash of the columns also, so many
    rows that share an id are parted too."""
    tie = F.xxhash64(*also) if also else F.lit(0)
    keyed = docs.withColumn("__tie", tie)
    return keyed.repartitionByRange(F.col(id_col).asc_nulls_first(), "__tie").sortWithinPartitions(F.col(id_col).asc_nulls_first(), "__tie").drop("__tie")


#: Words of lower-case letters of ASCII and Latin-1, which no step before the model changes or parts, and one mark after them at
#: most, which is a piece of its own; what parts words for the model; the characters that stand for bytes in it.
_PLAIN = r"^[a-z\x{df}-\x{f6}\x{f8}-\x{ff}]+[.,;:!?]?\z"
_BETWEEN = b"\x7f"
_CHARS = {b: c for c, b in _unicode_bytes().items() if b != 32}
#: Of the bytes of plain words and of what parts them, those that another character stands for.
_MOVED = [(chr(b), _CHARS[b]) for b in (_BETWEEN[0], *range(0x9F, 0xC0)) if chr(b) != _CHARS[b]]


def _in_chars(joined: bytes) -> str:
    """Plain words, and what parts them, in the characters that stand for their bytes."""
    out = joined.decode("latin-1")
    for byte, char in _MOVED:
        out = out.replace(byte, char)
    return out


class _Words:
    """Ids of words. A tokenizer that drops white space, and whose pieces never span it, gives a text the ids of its words, one
    after another. A worker keeps up to KEPT words with their ids over all its tasks. A word of plain letters, alone or with
    one mark after it, goes to the tokenizer's model as it is, since the steps before the model leave letters together."""

    def __init__(self, content: str, added: list[str]):
        self.tokenizer, self.number, self.values, self.offsets = _tokenizer(content), {}, np.empty(0, np.int32), np.zeros(1, np.int64)
        steps = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.lowers = steps[0] is not None and steps[0].normalize_str("AbZ") == "abz"
        self.plain = (steps[0] is None or steps[0].normalize_str("abz") == "abz") and steps[1] is not None and [w for w, _ in steps[1].pre_tokenize_str("ab\u00fc. ab")] == ["ab\u00c3\u00bc", ".", "ab"]
        self.added = [a.lower() for a in added]
        # what parts words for the model alone is a token that no word of letters has
        between = self._alone([_CHARS[_BETWEEN[0]]])[0]
        self.plain, self.between = self.plain and len(between) == 1, between[0]

    def _alone(self, texts: list[str]) -> list[list[int]]:
        """Ids by the model alone, of words between white space in the characters that stand for bytes."""
        from tokenizers.pre_tokenizers import WhitespaceSplit

        before = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = None, WhitespaceSplit()
        try:
            return _ids(self.tokenizer, texts)
        finally:
            self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = before

    def split(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Where each text's words begin and end among all, each word's place among the distinct ones, and these. If the
        tokenizer lower-cases, A-Z are lower-cased here, unless that would make an added token."""
        column = pc.fill_null(column.cast(pa.string()), "")
        if self.lowers:
            low = pc.ascii_lower(column)
            for a in self.added:
                made = pc.match_substring(low, a)
                low = pc.if_else(made, column, low) if pc.any(made).as_py() else low
            column = low
        words = pc.ascii_split_whitespace(column)
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        found = words.flatten().dictionary_encode()
        return np.concatenate([[0], np.cumsum(_sizes(words, pc.list_value_length), dtype=np.int64)]), found.indices.to_numpy(), found.dictionary

    def _made(self, words: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct words, and how many each has; plain: which go to the model as they are."""
        letters = [w if w[-1] > 63 else w[:-1] + b" " + w[-1:] for w in compress(words, plain.tolist())]
        between = b" " + _BETWEEN + b" "
        groups = [_in_chars(between.join(letters[a : a + 256])) for a in range(0, len(letters), 256)]
        parts = [np.array([*ids, self.between], np.int32) for ids in self._alone(groups)]
        ids = np.concatenate([np.empty(0, np.int32), *parts])
        ends = np.flatnonzero(ids == self.between)
        rest = _ids(self.tokenizer, [w.decode("utf-8", "replace") for w in compress(words, (~plain).tolist())])
        sizes = np.concatenate([np.diff(ends, prepend=-1) - 1, np.fromiter(map(len, rest), np.int64, len(rest))])
        values = np.concatenate([ids[ids != self.between], np.fromiter(chain.from_iterable(rest), np.int32)])
        at = np.empty(len(words), np.int64)
        at[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(len(words))
        return gather(values, np.concatenate([[0], np.cumsum(sizes)]), at)

    def __call__(self, distinct: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words that codes name among distinct ones, and how many each has."""
        # joined by Arrow, since to make a value of each would take most of the time; no word has a space
        words = joined(distinct.cast(pa.binary())).split(b" ")[1:]
        found = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        # words that are here once may be so everywhere, and go last, so that others are kept first
        missing = np.flatnonzero(found < 0)
        again = np.bincount(codes, minlength=len(words))[missing] > 1
        missing = np.concatenate([missing[again], missing[~again]])
        n, own = len(self.number), [words[i] for i in missing.tolist()]
        found[missing] = np.arange(n, n + len(own))
        plain = pc.match_substring_regex(distinct.take(pa.array(missing)), _PLAIN).to_numpy(zero_copy_only=False) & self.plain
        made, sizes = self._made(own, plain)
        values = np.concatenate([self.values, made])
        offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        keep = min(len(own), KEPT - n)
        if keep > 0:
            self.number.update(zip(own[:keep], range(n, n + keep), strict=True))
            self.values, self.offsets = values[: offsets[n + keep]].copy(), offsets[: n + keep + 1].copy()
        return gather(values, offsets, found[codes])


#: A worker's words, by tokenizer.
_HELD: dict[str, _Words] = {}


def _encode(batches, content, added: list[str], end: int | None):
    pa.set_memory_pool(pa.system_memory_pool())
    if content.value not in _HELD:
        _HELD.clear()
        _HELD[content.value] = _Words(content.value, added)
    words = _HELD[content.value]
    for batch in batches:
        for rows in slices(batch, _sizes(batch.column("text"), pc.binary_length), SLICE):
            bounds, codes, distinct = words.split(rows.column("text"))
            ids, sizes = words(distinct, codes)
            upto = np.concatenate([[0], np.cumsum(sizes)])[bounds]
            if end is not None:
                ids = np.insert(ids, upto[1:], end)
                upto = upto + np.arange(len(upto))
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(ids, pa.int32()))], ["id", "ids"])
        _released()


def encoded(docs: DataFrame, path: str, end: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids), in ascending order of ids over the partitions: each whole text's ids by the tokenizer at path, which must be
    one that drops white space and parts texts at it; end, if given, is put after each. Strings of added tokens become those
    tokens. A null text has no ids but the end; repeated rows are each encoded; an empty table gives an empty result."""
    small_batches(docs.sparkSession)
    content, added = _settings(path)
    kind = docs.schema[id_col].dataType.simpleString()
    source = in_order(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    made = source.mapInArrow(partial(_encode, content=docs.sparkSession.sparkContext.broadcast(content), added=added, end=end), f"id {kind}, ids array<int>")
    return made.withColumnRenamed("id", id_col)


def placed(files: DataFrame) -> DataFrame:
    """The table of files with start: how many ids all files before hold. Sums of parts meet in one task, a part's files in
    another; neither holds ids."""
    parts = files.groupBy("part").agg(F.sum("ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("own", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(parts, "part").select(*files.columns, (F.col("base") + F.col("own")).alias("start"))


def _opened(batches, folder: str):
    store, path = _file_system(folder)
    for batch in batches:
        for name, start in zip(batch.column("name").to_pylist(), batch.column("start").to_pylist(), strict=True):
            with store.open_input_stream(f"{path}/{name}") as f:
                keys, lengths, ids = unpacked(f.read())
            yield keys, lengths, ids, start + np.concatenate([[0], np.cumsum(lengths)])[:-1]
            del keys, lengths, ids
            _released()


def _read(batches, folder: str):
    for keys, lengths, ids, starts in _opened(batches, folder):
        rows = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(ids.view(np.int64)))], ["id", "start", "ids"])
        yield from slices(rows, lengths, 1 << 18)


def _digest(batches, folder: str):
    import zlib

    for keys, lengths, ids, starts in _opened(batches, folder):
        data = memoryview(ids.astype("<u4").tobytes())
        ends = (np.cumsum(lengths) * 4).tolist()
        crc = [zlib.crc32(data[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])


def _from_files(spark: SparkSession, folder: str, what, schema: str) -> DataFrame:
    files = reliable(placed(spark.read.parquet(f"{folder}/files")))
    # a task reads one file after another; by hash, since the rows are few and their files equally large
    parts = max(1, -(-files.count() // 4))
    return files.repartition(parts, "name").mapInArrow(partial(what, folder=f"{folder}/data"), schema)


def read(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, ids) from the files of a folder: start is how many ids all documents before have, ids are longs (bit for
    bit: from 2**63 they come out negative)."""
    return _from_files(spark, folder, _read, "id long, start long, ids array<long>").withColumnRenamed("id", id_col)


def digests(spark: SparkSession, folder: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) from the files of a folder; the CRC-32 is of a document's ids as unsigned 32-bit
    little-endian integers."""
    return _from_files(spark, folder, _digest, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
