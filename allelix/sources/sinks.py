"""Text that tasks write in parallel and in order: parts of a file, committed as a whole, block-gzipped if wanted.

Each task writes its stretch of the ordered text as a part with a name of its own. The commit keeps the parts of tasks that
succeeded, lists them in order with their places in the whole, and removes what failed or repeated attempts left; without a
commit nothing is listed. The parts, one after the other, are the file. Of block-gzipped text every part is whole blocks, and
has an index of them beside it, so any range of blocks can be read by itself.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .archive import BLOCK, END, bgzf_block

MANIFEST = "_parts.json"
#: A block of an index: where it begins in its part, and where its text begins in that of the part.
ENTRY, ENTRY_SIZE = "<QQ", 16


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Part(WriterCommitMessage):
    number: int
    name: str
    size: int
    text_size: int


class PartsWriter(DataSourceArrowWriter):
    def __init__(self, path: str, gzipped: bool):
        self.path, self.gzipped = path, gzipped

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, root = opened(self.path)
        number = TaskContext.get().partitionId()
        name, size, text_size, held = f"part-{number:06d}-{uuid.uuid4().hex}", 0, 0, bytearray()
        index = system.open_output_stream(f"{root}/{name}.index") if self.gzipped else None
        with system.open_output_stream(f"{root}/{name}") as out:

            def put(block: bytes) -> None:
                nonlocal size, text_size
                if index is not None:
                    index.write(struct.pack(ENTRY, size, text_size))
                data = bgzf_block(block) if self.gzipped else block
                out.write(data)
                size, text_size = size + len(data), text_size + len(block)

            for batch in iterator:
                for text in batch.column(0):
                    held += text.as_buffer().to_pybytes()
                    while len(held) >= BLOCK:
                        put(bytes(held[:BLOCK]))
                        del held[:BLOCK]
            if held:
                put(bytes(held))
        if index is not None:
            index.close()
        return Part(number, name, size, text_size)

    def commit(self, messages: list[Part | None]) -> None:
        system, root = opened(self.path)
        parts, at, text_at = [], 0, 0
        for p in sorted((m for m in messages if m is not None), key=lambda m: m.number):
            if p.size:
                parts.append({"name": p.name, "at": at, "size": p.size, "text_at": text_at, "text_size": p.text_size})
                at, text_at = at + p.size, text_at + p.text_size
        keep = {p["name"] for p in parts} | {f"{p['name']}.index" for p in parts}
        for f in system.get_file_info(fs.FileSelector(root)):
            if f.base_name.startswith("part-") and f.base_name not in keep:
                system.delete_file(f.path)
        with system.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps({"gzipped": self.gzipped, "size": at, "text_size": text_at, "parts": parts}).encode())

    def abort(self, messages: list[Part | None]) -> None:
        system, root = opened(self.path)
        for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith("part-"):
                system.delete_file(f.path)


class PartsSource(DataSource):
    """df.write.format("ordered_parts").option("path", ..).option("gzipped", ..).save() of one column of text, in the order of its partitions."""

    @classmethod
    def name(cls) -> str:
        return "ordered_parts"

    def schema(self) -> str:
        return "text string"

    def writer(self, schema: StructType, overwrite: bool) -> PartsWriter:
        if [f.dataType.simpleString() for f in schema.fields] != ["string"]:
            raise ValueError("ordered_parts takes one column of text")
        system, root = opened(self.options["path"])
        system.create_dir(root, recursive=True)
        for f in system.get_file_info(fs.FileSelector(root)):
            if not overwrite:
                raise FileExistsError(f"{root} isn't empty")
            if f.type == fs.FileType.File:
                system.delete_file(f.path)
        return PartsWriter(self.options["path"], self.options.get("gzipped", "false").lower() == "true")


def whole_text(df: DataFrame) -> DataFrame:
    """(ord, part, text) of lines (ord, line), or of pieces (ord, part, text) whose lines end after their last part."""
    if "part" not in df.columns:
        return df.select("ord", F.lit("").alias("part"), F.concat("line", F.lit("\n")).alias("text"))
    ends = df.where("part = ''").select("ord", F.lit("~").alias("part"), F.lit("\n").alias("text"))
    return df.select("ord", "part", "text").unionAll(ends)


def write_parts(df: DataFrame, path: str, gzipped: bool = False, overwrite: bool = False) -> None:
    """Lines (ord, line) or pieces (ord, part, text) as the parts of a file, in order; neither a line nor the file passes through one task."""
    df.sparkSession.dataSource.register(PartsSource)
    ordered = whole_text(df).repartitionByRange("ord", "part").sortWithinPartitions("ord", "part").select("text")
    ordered.write.format("ordered_parts").option("path", path).option("gzipped", str(gzipped).lower()).mode("overwrite" if overwrite else "append").save()


def parts_of(path: str) -> dict:
    """What the commit listed; a folder without a commit raises FileNotFoundError."""
    system, root = opened(path)
    with system.open_input_stream(f"{root}/{MANIFEST}") as f:
        return json.loads(f.read())


def stream(path: str, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The file, part after part; of block-gzipped text also the block that ends it."""
    system, root = opened(path)
    listed = parts_of(path)
    for p in listed["parts"]:
        with system.open_input_stream(f"{root}/{p['name']}") as f:
            while data := f.read(chunk):
                yield data
    if listed["gzipped"]:
        yield END


def blocks_of(path: str) -> list[tuple[str, int, int]]:
    """(part, begin, end) of all blocks, in order."""
    system, root = opened(path)
    out = []
    for p in parts_of(path)["parts"]:
        with system.open_input_stream(f"{root}/{p['name']}.index") as f:
            begins = [b for b, _ in struct.iter_unpack(ENTRY, f.read())]
        out += [(p["name"], b, e) for b, e in zip(begins, [*begins[1:], p["size"]], strict=True)]
    return out


def unpacked(block: bytes) -> bytes:
    return zlib.decompress(block[18:-8], -15)


def lines_from(last: bytes, blocks: Iterator[tuple[bool, bytes]]) -> Iterator[bytes]:
    """The lines that begin in a split: of its blocks, and of those beyond (True) as far as its last line goes. last: the byte before."""
    begun, held = last == b"\n", b""
    for beyond, text in blocks:
        if not begun:  # the line before ends here, or further on
            cut = text.find(b"\n")
            if beyond:
                return
            if cut < 0:
                continue
            text, begun = text[cut + 1 :], True
        if beyond and not held:
            return
        *whole, rest = (held + text).split(b"\n")
        if beyond and whole:
            yield whole[0]
            return
        yield from whole
        held = rest
    if held:
        yield held


def in_batches(lines: Iterator[bytes], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    held: list[str] = []
    for line in lines:
        held.append(line.decode())
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["line"])
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["line"])


def read_lines(spark: SparkSession, path: str, blocks_a_split: int = 256) -> DataFrame:
    """(line) of block-gzipped parts, read in splits of some blocks; a split has the lines that begin in it.

    A task reads on behind its split to the end of its last line. What the driver holds is a row for each part.
    """
    listed = parts_of(path)
    names = [p["name"] for p in listed["parts"]]
    counted = spark.createDataFrame([(k,) for k in range(len(names))], "part int").repartition(max(1, len(names)))
    shared = path

    def splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(shared)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                size = system.get_file_info(f"{root}/{names[k]}.index").size // ENTRY_SIZE
                firsts = list(range(0, size, blocks_a_split))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(firsts), pa.int32()), pa.array(firsts, pa.int64())], ["part", "first"])

    def blocks_from(system: fs.FileSystem, root: str, k: int, first: int) -> Iterator[tuple[int, int, bytes]]:
        while k < len(names):
            with system.open_input_stream(f"{root}/{names[k]}.index") as f:
                begins = [b for b, _ in struct.iter_unpack(ENTRY, f.read())]
            ends = [*begins[1:], system.get_file_info(f"{root}/{names[k]}").size]
            with system.open_input_file(f"{root}/{names[k]}") as f:
                for at in range(first, len(begins)):
                    yield k, at, unpacked(f.read_at(ends[at] - begins[at], begins[at]))
            k, first = k + 1, 0

    def before(system: fs.FileSystem, root: str, k: int, first: int) -> bytes:
        """The last byte before a block."""
        if first:
            return next(blocks_from(system, root, k, first - 1))[2][-1:]
        if not k:
            return b"\n"
        last = system.get_file_info(f"{root}/{names[k - 1]}.index").size // ENTRY_SIZE - 1
        return next(blocks_from(system, root, k - 1, last))[2][-1:]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(shared)
        for batch in batches:
            for k, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield from in_batches(lines_from(before(system, root, k, first), ((part > k or at >= first + blocks_a_split, text) for part, at, text in blocks_from(system, root, k, first))))

    found = counted.mapInArrow(splits, "part int, first long")
    return found.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part", "first").mapInArrow(lines, "line string")


def place_of(folder: str, name: str, kind: str) -> str:
    """Where a file of an export goes, by its extension."""
    return f"{folder}/{name}" + ("-REMARKS.txt" if kind == "REMARKS" else kind if kind.startswith("_") else f".{kind}")


def remove(path: str) -> None:
    system, root = opened(path)
    if system.get_file_info(root).type == fs.FileType.Directory:
        system.delete_dir(root)


def write_export_parts(files: dict[str, DataFrame], folder: str, name: str) -> dict[str, str]:
    """All files of an export, each as parts in a folder of its own; by extension, where they are. Files without lines are left out."""
    out = {}
    for kind, df in files.items():
        path = place_of(folder, name, kind)
        write_parts(df, path, gzipped=kind.endswith(".gz"))
        if parts_of(path)["parts"]:
            out[kind] = path
        else:
            remove(path)
    return out
