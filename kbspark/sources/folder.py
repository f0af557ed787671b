"""Knowledge-base text files as a partitioned source (S3), and the sink that writes them.

The source is a Python data source whose partitions are the folders below the root, in shares: the driver lists the root
itself only, each task lists its folder (to any depth) and reads its share of the files in it.  Unlike Spark's file
sources it has a row for a file without bytes.  Files are opened through Arrow's file systems, so ``root`` is a local
path or a URI that Arrow knows.
"""

from __future__ import annotations

import posixpath
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, text string"
#: Shares of a folder: a folder with very many files is listed by so many tasks, each reading its own share.
SHARES = 8
_BATCH = 1 << 22  # bytes of text in a batch


def file_system(root: str):
    """(file system, path) of a root."""
    import pyarrow.fs as pafs

    if "://" not in root and not root.startswith("file:"):
        return pafs.LocalFileSystem(), root.rstrip("/") or "/"
    if root.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + root[len("file:"):].strip("/")
    return pafs.FileSystem.from_uri(root.rstrip("/"))


def _hidden(name: str) -> bool:
    return name.startswith((".", "_"))


@dataclass
class FolderShare(InputPartition):
    folder: str
    deep: bool
    share: int
    shares: int

    def __post_init__(self):
        super().__init__(self.folder)


class KbFolderReader(DataSourceReader):
    def __init__(self, root: str, suffix: str, shares: int):
        self.root, self.suffix, self.shares = root, suffix, shares

    def _entries(self, folder: str, deep: bool):
        import pyarrow.fs as pafs

        fs, _ = file_system(self.root)
        return fs, fs.get_file_info(pafs.FileSelector(folder, recursive=deep))

    def partitions(self):
        import pyarrow.fs as pafs

        fs, top = file_system(self.root)
        if fs.get_file_info(top).type != pafs.FileType.Directory:
            raise FileNotFoundError(f"no folder at {self.root}")
        _, entries = self._entries(top, False)
        folders = [e.path for e in entries if e.type == pafs.FileType.Directory and not _hidden(e.base_name)]
        return ([FolderShare(top, False, 0, 1)]
                + [FolderShare(f, True, i, self.shares) for f in sorted(folders) for i in range(self.shares)])

    def read(self, partition: FolderShare) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        fs, entries = self._entries(partition.folder, partition.deep)
        paths, texts, held = [], [], 0
        for e in sorted(entries, key=lambda e: e.path):
            inner = e.path[len(partition.folder):].strip("/").split("/")
            if e.type != pafs.FileType.File or not e.base_name.endswith(self.suffix) or any(map(_hidden, inner)):
                continue
            if zlib.crc32(e.path.encode()) % partition.shares != partition.share:
                continue
            with fs.open_input_stream(e.path) as f:
                raw = f.read().decode("utf-8", "replace")
            paths.append(e.path)
            texts.append(re.sub("\r\n?", "\n", raw))        # as text mode reads line ends
            held += len(raw)
            if held >= _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(texts)], names=["path", "text"])
                paths, texts, held = [], [], 0
        if paths:
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(texts)], names=["path", "text"])


class KbFolderSource(DataSource):
    """``spark.read.format("kb_folder").option("suffix", ".txt").load(root)``."""

    @classmethod
    def name(cls) -> str:
        return "kb_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> KbFolderReader:
        return KbFolderReader(self.options["path"], self.options.get("suffix", ".txt"),
                              int(self.options.get("shares", SHARES)))


def read_folder(spark: SparkSession, root: str, suffix: str = ".txt") -> DataFrame:
    spark.dataSource.register(KbFolderSource)
    return spark.read.format(KbFolderSource.name()).option("suffix", suffix).load(root)


def write_folder(kb: DataFrame, root: str, path: str = "path", text: str = "text") -> DataFrame:
    """K3, as the original stored it: one text file per document at ``root/path``; ``(path, bytes)`` of what was written.

    Written by the tasks that hold the rows; a rerun writes the same files again.  Paths are below ``root``: rows whose
    path has a ``..`` segment are left out.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(root)
        for batch in batches:
            done, sizes = [], []
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name is None or ".." in name.split("/"):
                    continue
                at = posixpath.join(top, name.lstrip("/"))
                fs.create_dir(posixpath.dirname(at), recursive=True)
                raw = (body or "").encode()
                with fs.open_output_stream(at) as f:
                    f.write(raw)
                done.append(name)
                sizes.append(len(raw))
            yield pa.RecordBatch.from_arrays([pa.array(done, pa.string()), pa.array(sizes, pa.int64())],
                                             names=["path", "bytes"])

    return kb.select(path, text).mapInArrow(write, "path string, bytes long")
