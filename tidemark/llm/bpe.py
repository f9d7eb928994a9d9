"""Byte-level BPE through a table of distinct words.

Texts are split into the pieces that the tokenizer would encode on their own: Arrow cuts them before spaces, where pieces end
too, and what is between is split once for each batch, however often it is there. Pieces are counted over the whole corpus;
each distinct piece that repeats is encoded once, into a table, and its ids are joined back by position. The table is
broadcast, so it holds the ``COMMON`` most frequent pieces at most. A piece that it lacks (one that occurs once, or one
of the rarest of a large corpus) is encoded where it stands: to fetch its ids by a shuffle, the texts or their ids would
have to move too, since they meet nowhere else. Decoding joins ids with the vocabulary's pieces, whose number is fixed
by the tokenizer."""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from functools import partial
from itertools import chain, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, most_frequent, reliable, slices, small_batches

#: The most pieces that are broadcast, and the most characters each of them has.
COMMON = 120_000
COMMON_CHARS = 32
#: Bytes of text, and ids to decode, that a task works on at once.
SLICE, DECODED = 1 << 21, 1 << 18
#: Fixed: how the byte-level tokenizer parts a text.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _latin() -> str:
    """PIECE for words of Latin-1 with a space before each, in terms of Python's own expressions, which are faster."""
    letters, numbers = (re.escape("".join(filter(regex.compile(kind).match, map(chr, range(256))))) for kind in (r"\p{L}", r"\p{N}"))
    return rf" ?[{letters}]+| ?[{numbers}]+|'(?:s|t|re|ve|m|ll|d)| ?[^ {letters}{numbers}]+"


_LATIN = re.compile(_latin()).findall


class Pieces:
    """Splits a text where the tokenizer would: at its added tokens first, then by PIECE."""

    def __init__(self, added: list[str]):
        self.added = set(added)
        self.at_added = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.find = regex.compile(PIECE).findall

    def __call__(self, text: str) -> list[str]:
        """The pieces of a text."""
        if self.at_added is None or not any(a in text for a in self.added):
            return self.find(text)
        out = []
        for part in self.at_added.split(text):
            out += [part] if part in self.added else self.find(part)
        return out


#: White space to any library, and a space inside a piece of it: neither its first character nor before a word.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_OTHER = r"[^\x00-\x{ff}]"
_INSIDE = rf"{_WHITE} (?:{_WHITE}|\z)"


class Stretches(NamedTuple):
    """Texts as stretches; text i has those that codes[bounds[i]:bounds[i + 1]] name. Of the distinct ones, the first are
    words of Latin-1 with a space before each, the next other words with one, both joined in this order; rest: all others."""

    bounds: np.ndarray
    codes: np.ndarray
    latin: bytes
    words: bytes
    rest: list[bytes]


def _settings(path: str) -> tuple[str, list[str]]:
    """The tokenizer as text (some MB, fixed by the file) and its added tokens."""
    with open(path, encoding="utf-8") as f:
        content = f.read()
    return content, [t["content"] for t in json.loads(content)["added_tokens"]]


def _unicode_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def vocabulary(path: str) -> list[tuple[int, bytes]]:
    """(id, bytes) of each piece."""
    content, _ = _settings(path)
    parsed, table = json.loads(content), _unicode_bytes()
    pieces = {i: bytes(table[c] for c in piece) for piece, i in parsed["model"]["vocab"].items()}
    pieces |= {t["id"]: t["content"].encode() for t in parsed["added_tokens"]}
    return sorted(pieces.items())


def _sizes(column: pa.Array, measure) -> np.ndarray:
    return pc.fill_null(measure(column), 0).to_numpy(zero_copy_only=False)


def _text(b: bytes) -> str:
    return b.decode("utf-8", "replace")


def joined(words: pa.Array) -> bytes:
    """Words with a space before each."""
    return b" " + pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), b" ")[0].as_py() if len(words) else b""


def stretches(column: pa.Array, added: list[str]) -> Stretches:
    """Texts cut before each space. A piece has a space as its first character, if it isn't white space itself, and of white
    space the last character before a word is left to that, so no piece spans a cut; a text in which a space is inside a
    piece of white space, or that has an added token, is one stretch."""
    column = pc.fill_null(column.cast(pa.string()), "")
    whole = pc.match_substring_regex(column, _INSIDE)
    for a in added:
        whole = pc.or_(whole, pc.match_substring(column, a))
    whole = whole.to_numpy(zero_copy_only=False)
    # by filters: if_else of pyarrow 23 mixes up the strings of arrays that begin inside a batch
    cut = pc.split_pattern(column.filter(pa.array(~whole)), " ")
    cut = cut.combine_chunks() if isinstance(cut, pa.ChunkedArray) else cut
    sizes = np.ones(len(column), np.int64)
    sizes[~whole] = _sizes(cut, pc.list_value_length)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    parts = cut.flatten().dictionary_encode()
    has = lambda pattern: pc.match_substring_regex(parts.dictionary, pattern).to_numpy(zero_copy_only=False)
    kind = np.where(has(rf"{_WHITE}|^\z"), 2, has(_OTHER))
    order = np.argsort(kind, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ordered = parts.dictionary.cast(pa.binary()).take(pa.array(order))
    n, m = np.cumsum(np.bincount(kind, minlength=3))[:2].tolist()
    rest = [b" " + x for x in ordered[m:].to_pylist()]
    codes, inside = np.empty(bounds[-1], np.int64), np.ones(bounds[-1], bool)
    inside[bounds[:-1][whole]] = False
    codes[inside] = place[parts.indices.to_numpy()]
    # a text's first stretch has no space before it
    for rows, own in ((~whole, pc.list_element(cut, 0)), (whole, column.filter(pa.array(whole)))):
        codes[bounds[:-1][rows]] = m + len(rest) + np.arange(rows.sum())
        rest += own.cast(pa.binary()).to_pylist()
    return Stretches(bounds, codes, joined(ordered[:n]), joined(ordered[n:m]), rest)


def pieces_of(found: Stretches, split: Pieces) -> tuple[list[str], np.ndarray]:
    """The pieces of the distinct stretches, one after another, and how many each has. Words are split all at once: of a
    word's pieces the first alone begins with a space."""
    flat = []
    for words, find in ((found.latin, _LATIN), (found.words, split.find)):
        flat += find(_text(words))
    first = np.flatnonzero(np.fromiter((p[0] == " " for p in flat), bool, len(flat)))
    rest = [split(_text(x)) for x in found.rest]
    sizes = np.concatenate([np.diff(first, append=len(flat)), np.fromiter(map(len, rest), np.int64, len(rest))])
    return [*flat, *chain.from_iterable(rest)], sizes


@lean
def _count(batches, added: list[str]):
    split, seen = Pieces(added), Counter()

    def made():
        # a stretch may begin texts alone, so that its word after a space doesn't occur
        there = {p: n for p, n in seen.items() if n}
        return pa.RecordBatch.from_arrays([pa.array(list(there), pa.string()), pa.array(list(there.values()), pa.int64())], ["piece", "n"])

    for batch in batches:
        for part in slices(batch, _sizes(batch.column("text"), pc.binary_length), SLICE):
            found = stretches(part.column("text"), added)
            flat, sizes = pieces_of(found, split)
            times = np.repeat(np.bincount(found.codes, minlength=len(sizes)), sizes)
            for piece, n in zip(flat, times.tolist(), strict=True):
                seen[piece] += n
            if len(seen) > 100_000:
                yield made()
                seen.clear()
    yield made()


def _tokenizer(content: str):
    # a task has one core; threads of its own would only hold memory
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _ids(tokenizer, pieces: list[str]) -> list[list[int]]:
    # without offsets into the text, which nothing here needs
    return [e.ids for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]


@lean
def _encode(batches, content):
    tokenizer = _tokenizer(content.value)
    for batch in batches:
        for a in range(0, batch.num_rows, 4096):
            part = batch.column("piece").slice(a, 4096)
            yield pa.RecordBatch.from_arrays([part, pa.array(_ids(tokenizer, part.to_pylist()), pa.list_(pa.int32()))], ["piece", "ids"])


def table_of(docs: DataFrame, path: str, text_col: str = "text", most: int = COMMON) -> DataFrame:
    """(piece, ids): distinct pieces that repeat in the corpus, the most frequent ones, most of them or all. Counts cover all
    texts; a task adds up its own before they shuffle."""
    content, added = _settings(path)
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(partial(_count, added=added), "piece string, n long").filter(F.length("piece") <= COMMON_CHARS)
    counts = reliable(counts.groupBy("piece").agg(F.sum("n").alias("n")).filter("n > 1"))
    return most_frequent(counts, most, "piece").select("piece").mapInArrow(partial(_encode, content=docs.sparkSession.sparkContext.broadcast(content)), "piece string, ids array<int>")


class _Shared:
    """The common pieces and their ids, packed; unpacked once in each Python worker."""

    def __init__(self, table: pa.Table):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        self.data = sink.getvalue().to_pybytes()

    def unpacked(self) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        table = pa.ipc.open_stream(self.data).read_all()
        ids = table.column("ids").combine_chunks()
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        offsets = ids.offsets.to_numpy().astype(np.int64) if len(ids) else np.zeros(1, np.int64)
        return {p: i for i, p in enumerate(table.column("piece").to_pylist())}, offsets, ids.values.to_numpy() if len(ids) else np.empty(0, np.int32)


def gather(values: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists values[offsets[i]:offsets[i + 1]] for i in at, one after another, and their lengths."""
    lengths = offsets[at + 1] - offsets[at]
    ends = np.cumsum(lengths)
    index = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[at] - (ends - lengths), lengths)
    return values[index], lengths


@lean
def _lookup(batches, added: list[str], shared, content):
    """Each text's ids: those of its pieces, in their order."""
    split, tokenizer = Pieces(added), _tokenizer(content.value)
    number, offsets, values = shared.value.unpacked()
    for batch in batches:
        for part in slices(batch, _sizes(batch.column("text"), pc.binary_length), SLICE):
            cut = stretches(part.column("text"), added)
            flat, counts = pieces_of(cut, split)
            found = np.fromiter(map(number.get, flat, repeat(-1)), np.int64, len(flat))
            missing = np.flatnonzero(found < 0).tolist()
            own: dict[str, int] = {}
            found[missing] = [own.setdefault(flat[i], len(number) + len(own)) for i in missing]
            more = _ids(tokenizer, list(own))
            all_offsets = np.concatenate([offsets, offsets[-1] + np.cumsum([len(x) for x in more], dtype=np.int64)])
            all_values = np.concatenate([values, np.fromiter(chain.from_iterable(more), np.int32)]) if more else values
            ids, lengths = gather(all_values, all_offsets, found)
            upto = np.concatenate([[0], np.cumsum(lengths)])
            ids, lengths = gather(ids, upto[np.concatenate([[0], np.cumsum(counts)])], cut.codes)
            starts = np.concatenate([[0], np.cumsum(lengths)])[cut.bounds]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))], ["id", "ids"])


def _encoder(docs: DataFrame, path: str, text_col: str, common: int):
    """What encodes batches of (id, text), with the table of all pieces of docs."""
    small_batches(docs.sparkSession)
    share = docs.sparkSession.sparkContext.broadcast
    content, added = _settings(path)
    return partial(_lookup, added=added, shared=share(_Shared(table_of(docs, path, text_col, common).toArrow())), content=share(content))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> DataFrame:
    """(id, ids): one row per input row, with the ids that the tokenizer at path gives the whole text, without special
    tokens being added. Strings of added tokens in a text become those tokens. Null and empty texts have no ids. Repeated
    rows are each encoded; extra columns are left out; an empty table gives an empty result."""
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_encoder(docs, path, text_col, common), f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


@lean
def _decode(batches, shared):
    offsets, flat = shared.value
    flat, size = np.frombuffer(flat, np.uint8), len(offsets) - 1
    for batch in batches:
        for part in slices(batch, _sizes(batch.column("ids"), pc.list_value_length), DECODED):
            ends = np.cumsum(_sizes(part.column("ids"), pc.list_value_length), dtype=np.int64)
            ids = pc.fill_null(part.column("ids").flatten(), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            known = (ids >= 0) & (ids < size)
            found, lengths = gather(flat, offsets, ids[known])
            upto = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(known)])[np.concatenate([[0], ends])]].tolist()
            data = found.tobytes()
            out = [data[a:b].decode("utf-8", "replace") for a, b in zip(upto[:-1], upto[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("ids"), pa.array(out, pa.string())], ["id", "ids", "text"])


def _decoder(df: DataFrame, path: str):
    """What decodes batches of (id, ids): ids are joined with the vocabulary's pieces by place in a table of all of them."""
    pieces = vocabulary(path)
    lengths = np.zeros(max(i for i, _ in pieces) + 2, np.int64)
    for i, b in pieces:
        lengths[i + 1] = len(b)
    return partial(_decode, shared=df.sparkSession.sparkContext.broadcast((np.cumsum(lengths), b"".join(b for _, b in pieces))))


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, ids, text): texts of ids, each joined with its piece's bytes; bytes that make no UTF-8 become U+FFFD, special
    tokens stay. Ids that the vocabulary lacks are passed over. Null ids give an empty text."""
    kind = rows.schema[id_col].dataType.simpleString()
    source = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    return source.mapInArrow(_decoder(rows, path), f"id {kind}, ids array<int>, text string").withColumnRenamed("id", id_col)


def _round_trip(batches, encoder, decoder):
    yield from decoder(encoder(batches))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, decodes what came out, and gives n_tokens, ids_sha256 and decoded_sha256. Both run in one Python worker."""
    kind = docs.schema[id_col].dataType.simpleString()
    both = partial(_round_trip, encoder=_encoder(docs, path, text_col, COMMON), decoder=_decoder(docs, path))
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = source.mapInArrow(both, f"id {kind}, ids array<int>, text string").withColumnRenamed("id", id_col)
    return made.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
