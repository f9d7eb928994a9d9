"""Data sources that read no more of a store than they must: the beginnings of files, and listings of folders.

Both are Python data sources over pyarrow's file systems, so a folder is a path or a URI of any store that these know, and
each task opens its own connection. ``register`` makes them known to a session as the formats ``heads`` and ``listing``."""

from __future__ import annotations

import codecs
import fnmatch
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Fixed: the most bytes of a head, and after how many more a head is looked through for the end of the cover.
MOST, BLOCK = 1_500_000, 96 * 1024
#: What the cover of a prospectus ends with: the heads of its price table. Tags are blanks.
COVER_END = r"price to (?:the )?public|underwriting discounts? and commissions|proceeds,? before expenses"
#: Bytes that a mark may begin in before the block that ends it.
OVERLAP = 4096
FILES_PER_TASK = 32
HEADS = "path string, text string, bytes_read long, length long, truncated boolean"
LISTING = "folder string, name string, length long, state string"
PRESENT, ABSENT, REFUSED, EMPTY = "present", "absent", "refused", "empty"


def file_system(uri: str):
    """The store of a path or URI, and the path in it."""
    from pyarrow import fs

    plain = "/" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri
    return (fs.LocalFileSystem(), plain) if plain.startswith("/") else fs.FileSystem.from_uri(plain)


def head_of(stream, length: int, most: int, block: int, mark: re.Pattern) -> tuple[bytes, bool]:
    """Bytes up to the block in which the mark ends, most of them or all; and whether most was reached without it. Only what is
    new, and OVERLAP bytes before it, is looked through each time."""
    held = bytearray()
    while len(held) < most:
        part = stream.read(min(block, most - len(held)))
        if not part:
            return bytes(held), False
        seen = max(0, len(held) - OVERLAP)
        held += part
        if mark.search(" ".join(re.sub(r"<[^>]*>", " ", held[seen:].decode("latin-1")).lower().split())):
            return bytes(held), False
    return bytes(held), length > len(held)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class _HeadsReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.glob = options["path"], options.get("glob", "*")
        self.most, self.block = int(options.get("most", MOST)), int(options.get("block", BLOCK))
        self.mark, self.files = options.get("mark", COVER_END), int(options.get("filespertask", FILES_PER_TASK))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, path = file_system(self.uri)
        found = store.get_file_info(fs.FileSelector(path, recursive=True))
        paths = sorted(i.path for i in found if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, self.glob))
        return [_Files(paths[a : a + self.files]) for a in range(0, len(paths), self.files)] or [_Files([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        store, _ = file_system(self.uri)
        mark = re.compile(self.mark)
        for path in partition.paths:
            with store.open_input_file(path) as f:
                data, truncated = head_of(f, length := f.size(), self.most, self.block, mark)
            yield path, _text(data, len(data) == length), len(data), length, truncated


def _text(data: bytes, whole: bool) -> str:
    """UTF-8, of which the last character may be cut unless it is the whole file; else the Windows code page."""
    try:
        return codecs.getincrementaldecoder("utf-8")().decode(data, final=whole)
    except UnicodeDecodeError:
        return data.decode("cp1252", "replace")


class Heads(DataSource):
    """(path, text, bytes_read, length, truncated) of the files under path whose names fit glob. A file is read in blocks until
    one ends with the mark (a pattern over lower-case text without tags), most bytes are read, or it ends; truncated if most
    came first. Options: path, glob, most, block, mark, filesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "heads"

    def schema(self) -> str:
        return HEADS

    def reader(self, schema) -> DataSourceReader:
        return _HeadsReader({k.lower(): v for k, v in self.options.items()})


class _Folder(InputPartition):
    def __init__(self, folder: str):
        super().__init__(None)
        self.folder = folder


class _ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.glob = options["path"].rstrip("/"), options.get("glob", "*")
        self.folders = [x for x in options["folders"].split("\n") if x]

    def partitions(self) -> list[InputPartition]:
        return [_Folder(x) for x in self.folders] or [_Folder("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        if not partition.folder:
            return
        store, path = file_system(self.uri)
        try:
            found = store.get_file_info(fs.FileSelector(f"{path}/{partition.folder}"))
        except PermissionError:
            yield partition.folder, None, None, REFUSED
            return
        except OSError as e:  # NotADirectoryError and FileNotFoundError among them
            yield partition.folder, None, None, REFUSED if e.errno in (1, 13) else ABSENT
            return
        files = sorted((i.base_name, i.size) for i in found if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, self.glob))
        for name, size in files:
            yield partition.folder, name, size, PRESENT
        if not files:
            yield partition.folder, None, None, EMPTY


class Listing(DataSource):
    """(folder, name, length, state) of the files in each of some folders under path, one task per folder, which nobody lists
    before. state tells a folder that is present from one that is absent, one that may not be read, and one in which no name
    fits glob; the last three have one row without a name. Options: path, folders (one a line), glob."""

    @classmethod
    def name(cls) -> str:
        return "listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return _ListingReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    for source in (Heads, Listing):
        spark.dataSource.register(source)


def heads(spark: SparkSession, path: str, **options: str | int) -> DataFrame:
    register(spark)
    return spark.read.format("heads").options(path=path, **options).load()


def listing(spark: SparkSession, path: str, folders: list[str], glob: str = "*") -> DataFrame:
    """Folders, such as the quarters of an index, are a list that is known before; their files are not."""
    register(spark)
    return spark.read.format("listing").options(path=path, folders="\n".join(folders), glob=glob).load()
