"""Token ids in files of fixed-width bits: a Spark data source that writes and reads them.

A data set is a folder of one file a task and a manifest that the driver writes when all tasks have succeeded; files no
manifest names are leftovers of lost tasks and are never read. A file is

* blocks of BLOCK ids, each id in the least number of bits that holds every id of the vocabulary, low bits first; a block
  begins at a byte, so that it is unpacked alone;
* the index as an Arrow stream: the id of each document and its number of ids, in order;
* the offset of each block, as little-endian unsigned 64-bit integers;
* a footer of seven such integers: width, ids a block, ids, documents, where index and offsets begin, and a mark.

Rows go into ascending order of the document's id by a range partitioning before they are encoded; the manifest's running
sum of ids gives each file its place among all. Documents of one id are ordered by their text, null ids come first, and a
very frequent id is spread over tasks by the text and the row's place in its split. Null texts count as empty: their only
id is the end id. An empty table gives a data set without files. A worker holds one batch and one block of output.

``id_range`` reads any stretch of the ids of a data set by seeking to the blocks that hold it.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tessera.llm.packing import LETTER, NUMBER, SIMPLE
from tessera.llm.tokens import tokenizer_path
from tessera.llm.transducer import byte_alphabet
from tessera.session import ship, shared_dir

FORMAT = "packed_ids"
BLOCK = 65536
MARK = 0x31534449_4B434150
MANIFEST = "_manifest.json"
#: Cached pre-tokens of a generation, and the longest that is cached.
MAX_WORDS, MAX_LENGTH = 400_000, 32
#: Ids that a reader unpacks at once.
READ_IDS = 1 << 20

# --- ids ---------------------------------------------------------------------------------------------------------------

#: The byte-level splitting rule for the characters of SIMPLE; what a pre-token begins with tells its kind, so that the
#: frequent kinds come first.
SPLIT = re.compile(rf" ?[{LETTER}]+| ?[{NUMBER}]+|'(?:[stmd]|re|ve|ll)| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+")


class Encoder(dict):
    """Pre-token -> its ids as little-endian 32-bit words, as the library's merges give them, in two generations.

    A pre-token goes to the merges as the stand-ins of its bytes. Texts that hold other characters or special strings, and
    all texts of a vocabulary with another splitter, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        split = spec["pre_tokenizer"] or {}
        byte_level = split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
        self.cached = bool(byte_level) and not any(spec[k] for k in ("normalizer", "truncation", "padding", "post_processor"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.model = self.tokenizer.model
        self.stand_in = {b: c for c, b in byte_alphabet().items()}
        self.ascii = {b: c for b, c in self.stand_in.items() if b < 128}
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        got = self.old.get(word)
        if got is None:
            shown = word.translate(self.ascii) if word.isascii() else "".join([self.stand_in[b] for b in word.encode()])
            got = np.array([t.id for t in self.model.tokenize(shown)], "<u4").tobytes()
            if len(word) > MAX_LENGTH:
                return got
        if len(self) >= MAX_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = got
        return got

    def ids(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit words."""
        if self.cached and SIMPLE.fullmatch(text) and not any(s in text for s in self.special):
            return b"".join(map(self.__getitem__, SPLIT.findall(text)))
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# --- bits ----------------------------------------------------------------------------------------------------------------


def bits_for(size: int) -> int:
    """The least width that holds the ids 0 .. size - 1."""
    return max(1, (size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids one after another in ``width`` bits each, low bits first, filled up with zeros to a whole byte.

    Eight ids take ``width`` bytes: the j-th of every eight is shifted to its place and its bytes are or-ed in, for all
    groups of eight at once.
    """
    n = len(ids)
    rows = np.zeros((-(-n // 8), 8), np.uint64)
    rows.reshape(-1)[:n] = ids
    out = np.zeros((len(rows), width), np.uint8)
    for j in range(8):
        first, shift = divmod(j * width, 8)
        put = rows[:, j] << np.uint64(shift)
        for b in range(-(-(shift + width) // 8)):
            out[:, first + b] |= (put >> np.uint64(8 * b)).astype(np.uint8)
    return out.tobytes()[: -(-n * width // 8)]


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    """The ``n`` ids that ``pack`` wrote, as 32-bit words: each is cut out of the eight bytes that begin where it begins."""
    padded = np.frombuffer(data + b"\0" * 8, np.uint8)
    words = np.ndarray((len(padded) - 7,), "<u8", padded.data, strides=(1,))
    at = np.arange(n, dtype=np.int64) * width
    return ((words[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype("<u4")


# --- files ---------------------------------------------------------------------------------------------------------------


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI or an absolute path; any store that pyarrow knows."""
    return fs.FileSystem.from_uri(path)


class FileWriter:
    """Ids of documents in order; whole blocks go to the file as they fill up."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.open: list[np.ndarray] = []
        self.held = self.n_ids = 0
        self.offsets: list[int] = []
        self.index: list[pa.RecordBatch] = []

    def _block(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        data = pack(ids, self.width)
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_ids: pa.Array, ids: list[bytes]) -> None:
        counts = np.array([len(x) // 4 for x in ids], np.int64)
        self.index.append(pa.RecordBatch.from_arrays([doc_ids, pa.array(counts)], names=["doc_id", "n_ids"]))
        self.open.append(np.frombuffer(b"".join(ids), "<u4"))
        self.held += int(counts.sum())
        self.n_ids += int(counts.sum())
        if self.held >= BLOCK:
            rest = np.concatenate(self.open)
            whole = len(rest) // BLOCK * BLOCK
            for at in range(0, whole, BLOCK):
                self._block(rest[at : at + BLOCK])
            self.open, self.held = [rest[whole:].copy()], len(rest) - whole

    def close(self) -> tuple[int, int]:
        """Ids and documents of the file."""
        if self.held:
            self._block(np.concatenate(self.open))
        docs = sum(b.num_rows for b in self.index)
        index = b""
        if self.index:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, self.index[0].schema) as stream:
                for b in self.index:
                    stream.write_batch(b)
            index = sink.getvalue().to_pybytes()
        offsets = np.array(self.offsets, "<u8").tobytes()
        footer = np.array([self.width, BLOCK, self.n_ids, docs, self.at, self.at + len(index), MARK], "<u8").tobytes()
        self.out.write(index + offsets + footer)
        return self.n_ids, docs


class FileReader:
    """Random access to one file: the footer is read first, then only the blocks that are asked for."""

    def __init__(self, path: str):
        store, name = _open(path)
        self.file = store.open_input_file(name)
        size = self.file.size()
        foot = np.frombuffer(self.file.read_at(56, size - 56), "<u8").tolist()
        if foot[6] != MARK:
            raise ValueError(f"{path} is not a file of packed ids, or was cut off")
        self.width, self.block, self.n_ids, self.n_docs, self.index_at, self.offsets_at, _ = foot
        self.offsets = np.frombuffer(self.file.read_at(size - 56 - self.offsets_at, self.offsets_at), "<u8").astype(np.int64)

    def index(self) -> pa.Table:
        return pa.ipc.open_stream(self.file.read_at(self.offsets_at - self.index_at, self.index_at)).read_all()

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids start .. stop - 1 of the file; blocks that lie one after another are read at once."""
        if stop <= start:
            return np.empty(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        begin = int(self.offsets[first])
        end = int(self.offsets[last + 1]) if last + 1 < len(self.offsets) else self.index_at
        data = self.file.read_at(end - begin, begin)
        parts = []
        for b in range(first, last + 1):
            at = int(self.offsets[b]) - begin
            n = min(self.block, self.n_ids - b * self.block)
            parts.append(unpack(data[at : at + -(-n * self.width // 8)], n, self.width))
        return np.concatenate(parts)[start - first * self.block : stop - first * self.block]


# --- the data source -----------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    n_ids: int
    n_docs: int


class IdsWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.tokenizer, self.end = options["path"], options["tokenizer"], int(options.get("end_id", 0))
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.ids"  # an attempt's own: a second attempt never writes into the first's file
        codes = encoder(self.tokenizer)
        end = np.array([self.end], "<u4").tobytes()
        store, folder = _open(self.path)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{name}") as out:
            file = FileWriter(out, bits_for(max(codes.size, self.end + 1)))
            for b in iterator:
                file.add(b.column(0), [codes.ids(t) + end for t in b.column(1).to_pylist()])
            n_ids, n_docs = file.close()
        if not n_docs:
            store.delete_file(f"{folder}/{name}")
        return Written(part, name, n_ids, n_docs)

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _open(self.path)
        files, start = [], 0
        for m in sorted((m for m in messages if m is not None and m.n_docs), key=lambda m: m.part):
            files.append({"name": m.name, "start": start, "n_ids": m.n_ids, "n_docs": m.n_docs})
            start += m.n_ids
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{MANIFEST}.new") as out:
            out.write(json.dumps({"n_ids": start, "files": files}).encode())
        store.move(f"{folder}/{MANIFEST}.new", f"{folder}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = _open(self.path)
        for m in messages:
            if m is not None and m.n_docs:
                store.delete_file(f"{folder}/{m.name}")


@dataclass
class FilePart(InputPartition):
    name: str
    start: int


def manifest(path: str) -> dict:
    """{n_ids, files: [{name, start, n_ids, n_docs}]} of a finished data set: an entry a file."""
    store, folder = _open(path)
    with store.open_input_file(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


class IdsReader(DataSourceReader):
    """doc_id, start, and as asked for n_tokens, ids and ids_crc32; one partition a file, READ_IDS ids or one document at a time."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.names = options["path"], schema.fieldNames()

    def partitions(self) -> list[FilePart]:
        return [FilePart(f["name"], f["start"]) for f in manifest(self.path)["files"]] or [FilePart("", 0)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        file = FileReader(f"{self.path}/{partition.name}")
        index = file.index().combine_chunks()
        doc_ids = index.column("doc_id").combine_chunks()
        ends = np.cumsum(index.column("n_ids").to_numpy())
        row = 0
        while row < len(ends):
            base = int(ends[row - 1]) if row else 0
            last = max(row + 1, int(np.searchsorted(ends, base + READ_IDS, "right")))
            starts = np.concatenate(([base], ends[row : last - 1]))
            ids = file.ids(base, int(ends[last - 1])) if {"ids", "ids_crc32"} & {*self.names} else None
            made = {"doc_id": lambda: doc_ids.slice(row, last - row), "start": lambda: pa.array(starts + partition.start), "n_tokens": lambda: pa.array(ends[row:last] - starts)}
            if ids is not None:
                made["ids"] = lambda: pa.ListArray.from_arrays(pa.array(np.append(starts, ends[last - 1]) - base, pa.int32()), pa.array(ids.astype(np.int32)))
                made["ids_crc32"] = lambda: pa.array([zlib.crc32(ids[a - base : b - base]) for a, b in zip(starts.tolist(), ends[row:last].tolist())], pa.int64())
            yield pa.RecordBatch.from_arrays([made[n]() for n in self.names], names=self.names)
            row = last


class PackedIds(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids array<int>"

    def reader(self, schema: StructType) -> IdsReader:
        return IdsReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> IdsWriter:
        return IdsWriter(dict(self.options), overwrite)


def write_ids(df: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Encodes every text, appends ``end_id`` and writes all ids in ascending order of ``doc_id`` to the new folder ``path``."""
    spark = df.sparkSession
    ship(spark)
    spark.dataSource.register(PackedIds)
    rows = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    keyed = rows.withColumns({"h": F.xxhash64("t"), "k": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("doc_id", "h", "k").sortWithinPartitions("doc_id", "h", "t")
    ordered.select("doc_id", "t").write.format(FORMAT).mode("append").option("tokenizer", tokenizer).option("end_id", end_id).save(path)


def read_ids(spark: SparkSession, path: str, id_type: str = "long", columns: str = "start long, n_tokens long, ids array<int>") -> DataFrame:
    """doc_id and ``columns`` of a data set; ``ids_crc32 long`` (of the ids as little-endian 32-bit integers) may be asked for."""
    ship(spark)
    spark.dataSource.register(PackedIds)
    return spark.read.format(FORMAT).schema(f"doc_id {id_type}, {columns}").load(path)


def id_range(path: str, start: int, stop: int) -> np.ndarray:
    """The ids start .. stop - 1 of all ids of a data set, from the blocks that hold them."""
    parts = [np.empty(0, "<u4")]
    for f in manifest(path)["files"]:
        lo, hi = max(start, f["start"]), min(stop, f["start"] + f["n_ids"])
        if lo < hi:
            parts.append(FileReader(f"{path}/{f['name']}").ids(lo - f["start"], hi - f["start"]))
    return np.concatenate(parts)


def op13(df: DataFrame, name: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the files that hold its ids.

    Null texts are empty (one id, the end id), null ids come first, repeated rows each have their place.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    write_ids(df, path, tokenizer_path(name))
    return read_ids(spark, path, df.schema["doc_id"].dataType.simpleString(), "start long, n_tokens long, ids_crc32 long")
