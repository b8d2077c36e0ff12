"""Fingerprints of files by byte ranges (survey K06).

A file is cut into leaves of ``LEAF_BYTES``; the digests of up to ``FAN`` leaves, one
behind the other, are hashed to a node, those of nodes to a node above, and so on
to one root.  Ranges of leaves are read by different tasks, a leaf at a time, so a
file of any size takes the memory of a leaf.  The md5 of a file can only be taken
from its start to its end; it is read in leaves too, one task for each file.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

LEAF_BYTES = 8 << 20
# Leaves that a task reads at most, and digests that are hashed to one.
LEAVES_IN_TASK, FAN = 32, 1024


def _open_store(path: str):
    """The file system of a path or URI, and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def list_files(path: str, glob: str | None = None) -> list[tuple[str, int]]:
    """(path, bytes) of the files at or below ``path`` whose name fits ``glob``; hidden ones are left out."""
    from pyarrow import fs

    store, inner = _open_store(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info]
    if info.type == fs.FileType.Directory:
        found = store.get_file_info(fs.FileSelector(inner, recursive=True))
    start = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return sorted(
        (start + f.path, f.size)
        for f in found
        if f.type == fs.FileType.File
        and not f.base_name.startswith((".", "_"))
        and (glob is None or fnmatch.fnmatchcase(f.base_name, glob))
    )


class Range(InputPartition):
    """Leaves of a file from a place on; none for the file as a whole."""

    def __init__(self, path: str, size: int, first: int, leaves: int):
        super().__init__((path, first))
        self.path, self.size, self.first, self.leaves = path, size, first, leaves


class ByteRanges(DataSource):
    """``(path, size_bytes, leaf, digest)`` of the leaves of files, or the md5 of whole files."""

    @classmethod
    def name(cls) -> str:
        return "corpusloom_byte_ranges"

    def schema(self) -> str:
        return "path string, size_bytes long, leaf long, digest binary"

    def reader(self, schema) -> RangeReader:
        return RangeReader(dict(self.options))


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.glob = options["path"], options.get("glob") or None
        self.leaf = int(options.get("leafbytes") or options.get("leafBytes") or LEAF_BYTES)
        self.whole = options.get("digest") == "md5"

    def partitions(self) -> list[InputPartition]:
        step, parts = self.leaf * LEAVES_IN_TASK, []
        for path, size in list_files(self.path, self.glob):
            starts = [0] if self.whole else range(0, max(size, 1), step)
            parts += [Range(path, size, s // self.leaf, LEAVES_IN_TASK) for s in starts]
        return parts

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if partition is None:  # there are no files
            return
        store, inner = _open_store(partition.path)
        with store.open_input_file(inner) as file:
            if self.whole:
                digest = hashlib.md5(usedforsecurity=False)
                while piece := file.read(self.leaf):
                    digest.update(piece)
                yield partition.path, partition.size, 0, digest.digest()
                return
            file.seek(partition.first * self.leaf)
            for leaf in range(partition.first, partition.first + partition.leaves):
                piece = file.read(self.leaf)
                # an empty file has one empty leaf
                if piece or leaf == 0:
                    yield partition.path, partition.size, leaf, hashlib.sha256(piece).digest()


def _digests(spark: SparkSession, path: str, glob: str | None, **options) -> DataFrame:
    spark.dataSource.register(ByteRanges)
    reader = spark.read.format(ByteRanges.name()).options(path=path, **options)
    return (reader.option("glob", glob) if glob else reader).load()


def tree_hashes(
    spark: SparkSession, path: str, glob: str | None = None, leaf_bytes: int = LEAF_BYTES, fan: int = FAN
) -> DataFrame:
    """``(path, size_bytes, tree_sha256)``; a file of one leaf has the sha-256 of its bytes."""
    nodes = _digests(spark, path, glob, leafBytes=leaf_bytes)
    largest = max((size for _, size in list_files(path, glob)), default=0)
    wide = max(1, -(-largest // leaf_bytes))
    while wide > 1:
        above = nodes.groupBy("path", "size_bytes", F.floor(F.col("leaf") / fan).alias("leaf")).agg(
            F.array_sort(F.collect_list(F.struct(F.col("leaf").alias("at"), "digest"))).alias("below")
        )
        joined = F.unhex(F.array_join(F.transform("below", lambda x: F.hex(x["digest"])), ""))
        digest = F.when(F.size("below") > 1, F.unhex(F.sha2(joined, 256))).otherwise(F.col("below")[0]["digest"])
        nodes = above.select("path", "size_bytes", "leaf", digest.alias("digest"))
        wide = -(-wide // fan)
    return nodes.select("path", "size_bytes", F.lower(F.hex("digest")).alias("tree_sha256"))


def file_fingerprint(
    spark: SparkSession, path: str, glob: str | None = None, leaf_bytes: int = LEAF_BYTES
) -> DataFrame:
    """``(path, size_bytes, md5, tree_sha256)`` of every file at or below ``path``."""
    md5 = _digests(spark, path, glob, leafBytes=leaf_bytes, digest="md5")
    md5 = md5.select("path", "size_bytes", F.lower(F.hex("digest")).alias("md5"))
    trees = tree_hashes(spark, path, glob, leaf_bytes)
    return md5.join(trees.drop("size_bytes"), "path")
