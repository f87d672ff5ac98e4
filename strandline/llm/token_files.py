"""Token-id files with directly addressable codes.

Ids are split into chunks of ``WIDTHS`` bits, lowest first. Level k holds the k-th chunk of every id that has one; a
bitmap beside each level but the last says which of its ids go on, and a rank directory (ones before each block of
512 bits) tells where the next level has them. So the id at any place is found by reading a few bytes, one count and one
block of the bitmap a level, without reading or decoding what stands before it.

A file: ``SLDA``, version, number of documents and of ids, lengths of the sections (all little-endian); then doc ids,
end offsets of the documents, null marks, and for each level its packed chunks, bitmap and directory.

Documents are dealt to partitions by ranges of doc_id and sorted in them; each partition writes files of at most
``file_ids`` ids (a longer document fills a file of its own). Files have names by partition and number, so that their
order is the order of doc_id, and are written under a temporary name and then renamed: a repeated task writes the same
file again. Rows of one partition stream through; a task holds one batch and one file.
"""

from __future__ import annotations

import json
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, ship, work_dir

MAGIC = b"SLDA"
WIDTHS = (10, 6, 16)
BLOCK = 512
#: Entries that a worker's cache of words holds before it starts afresh.
CACHE = 1_200_000
#: Marks that can be taken from the end of a word.
MARKS = b".,;:!?*%&$#"

_coders: dict[str, WordCoder] = {}


def byte_letters() -> list[str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


#: Settings of a tokenizers file under which pieces never reach over white space and letters are lower-cased: fixed values.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}


class WordCoder(dict):
    """Ids of texts by a tokenizers file. If its settings are ``BY_WORDS``, each distinct word is encoded once.

    A word that is one run of Latin letters, lower-case and composed, is one piece: it goes straight to the library's
    model. Marks after a letter are a piece of their own, so such a word is the ids of its stem and of its marks.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            settings = json.load(f)
        self.by_words = all(settings.get(k) == v for k, v in BY_WORDS.items())
        self.letters = byte_letters()

    def __missing__(self, word: bytes) -> bytes:
        stem = word.rstrip(MARKS)
        if len(stem) < len(word) and stem[-1:].isalpha():
            out = self[stem] + self[word[len(stem) :]]
        else:
            s = word.decode()
            if s.isascii() and s.isalpha() and s.islower():
                ids = [t.id for t in self.model.tokenize(s)]
            elif s.isalpha() and max(s) < "\u0180" and s == s.lower() and unicodedata.is_normalized("NFC", s):
                ids = [t.id for t in self.model.tokenize("".join([self.letters[b] for b in word]))]
            else:
                ids = self.tokenizer.encode(s, add_special_tokens=False).ids
            out = struct.pack(f"<{len(ids)}I", *ids)
        self[word] = out
        return out

    def encode(self, texts: list[bytes], end: bytes) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian unsigned 32-bit integers, then ``end``."""
        if not self.by_words:  # another tokenizer: whole texts go to the library
            found = self.tokenizer.encode_batch([t.decode() for t in texts], add_special_tokens=False)
            return [struct.pack(f"<{len(e.ids)}I", *e.ids) + end for e in found]
        if len(self) > CACHE:
            self.clear()
        get = self.__getitem__
        # The tokenizer lower-cases: A-Z can go first, save where a special token's own spelling could arise.
        return [b"".join(map(get, (t if b"<|" in t else t.lower()).split())) + end for t in texts]


def word_coder(path: str) -> WordCoder:
    if path not in _coders:
        _coders[path] = WordCoder(path)
    return _coders[path]


def _pack(values: np.ndarray, width: int) -> bytes:
    """``values`` in ``width`` bits each, most significant bit first."""
    if width == 16:
        return values.astype(">u2").tobytes()
    out = []
    for k in range(0, len(values), 1 << 18):  # whole bytes: a multiple of 8 values
        bits = np.unpackbits(values[k : k + (1 << 18)].astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, 16 - width :]
        out.append(np.packbits(bits).tobytes())
    return b"".join(out)


def _unpack(data: bytes, width: int, bits: np.ndarray) -> np.ndarray:
    """The values that begin at the places ``bits``, counted in bits from the start of ``data``."""
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    byte = bits >> 3
    word = raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]
    return word >> (24 - width - (bits & 7)).astype(np.uint32) & np.uint32((1 << width) - 1)


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """The bytes of one file."""
    rest, sections = ids.astype(np.uint32), []
    for k, width in enumerate(WIDTHS):
        sections.append(_pack(rest & np.uint32((1 << width) - 1), width))
        if k + 1 < len(WIDTHS):
            rest = rest >> np.uint32(width)
            more = rest > 0
            bits = np.packbits(more)
            bits = np.pad(bits, (0, -len(bits) % (BLOCK // 8)))
            ones = np.unpackbits(bits).reshape(-1, BLOCK).sum(1, dtype=np.uint32)
            sections += [bits.tobytes(), (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes()]
            rest = rest[more]
    front = [np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.cumsum(lengths, dtype="<u8").tobytes(), np.array([d is None for d in doc_ids], np.uint8).tobytes()]
    parts = front + sections
    head = MAGIC + struct.pack("<IQQ", 1, len(doc_ids), len(ids)) + struct.pack(f"<{len(parts)}Q", *map(len, parts))
    return head + b"".join(parts)


class TokenFile:
    """Random access to the ids of one file through ``read`` (offset, size): a header, then only the bytes asked for."""

    def __init__(self, read: Callable[[int, int], bytes]):
        head = read(0, 24)
        if head[:4] != MAGIC:
            raise ValueError("not a token file")
        _, self.docs, self.n = struct.unpack_from("<IQQ", head, 4)
        parts = 3 + 3 * len(WIDTHS) - 2
        self.sizes = struct.unpack(f"<{parts}Q", read(24, 8 * parts))
        self.offsets = (24 + 8 * parts + np.concatenate([[0], np.cumsum(self.sizes)])).tolist()
        self.read = read

    def _part(self, k: int, a: int = 0, b: int | None = None) -> bytes:
        """Bytes a to b of section k."""
        b = self.sizes[k] if b is None else min(b, self.sizes[k])
        return self.read(self.offsets[k] + a, b - a) if b > a else b""

    @cached_property
    def doc_ids(self) -> list[int | None]:
        return [None if null else d for d, null in zip(np.frombuffer(self._part(0), "<i8").tolist(), self._part(2))]

    @cached_property
    def ends(self) -> np.ndarray:
        return np.frombuffer(self._part(1), "<u8").astype(np.int64)

    @cached_property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    def _rank(self, level: int, a: int) -> int:
        """Ids before place a of a level that go on to the next: the directory's count and the bits of one block."""
        block = a // BLOCK
        before = struct.unpack("<I", self._part(5 + 3 * level, 4 * block, 4 * block + 4))[0]
        bits = np.frombuffer(self._part(4 + 3 * level, block * BLOCK // 8, (a + 7) >> 3), np.uint8)
        return before + int(np.unpackbits(bits)[: a - block * BLOCK].sum())

    def at(self, place: int) -> int:
        """The id at one place: a few bytes, a block of the bitmap and a count a level."""
        out = shift = 0
        for k, width in enumerate(WIDTHS):
            byte = place * width >> 3
            out |= int(_unpack(self._part(3 + 3 * k, byte, byte + 3), width, np.array([place * width & 7]))[0]) << shift
            if k + 1 == len(WIDTHS) or not self._part(4 + 3 * k, place >> 3, (place >> 3) + 1)[0] >> (7 - (place & 7)) & 1:
                return out
            place, shift = self._rank(k, place), shift + width
        return out

    def take(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places."""
        return np.array([self.at(p) for p in np.asarray(places).tolist()], np.uint32)

    def span(self, a: int, b: int, level: int = 0) -> np.ndarray:
        """The ids at places a to b: what follows each other on a level does so on the next."""
        width = WIDTHS[level]
        byte = a * width >> 3
        out = _unpack(self._part(3 + 3 * level, byte, (b * width + 7) >> 3), width, np.arange(a, b) * width - byte * 8)
        if level + 1 < len(WIDTHS) and b > a:
            bits = np.frombuffer(self._part(4 + 3 * level, a >> 3, (b + 7) >> 3), np.uint8)
            more = np.unpackbits(bits)[a & 7 : (a & 7) + b - a].view(bool)
            if n := int(more.sum()):
                first = self._rank(level, a)
                out[more] |= self.span(first, first + n, level + 1) << np.uint32(width)
        return out

    def document(self, k: int) -> np.ndarray:
        return self.span(int(self.starts[k]), int(self.ends[k]))


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, file_ids: int = 2_000_000, partitions: int | None = None) -> DataFrame:
    """Write the ids of every whole text of ``docs`` (doc_id, text) in ascending doc_id order; the list of the files.

    Returns (part, number, path, n_docs, n_ids). A null text counts as empty and holds only ``end_id``; null doc_ids
    come first; equal doc_ids stand together in any order. doc_id is an integer. An empty table writes no file.
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    ordered = ordered.repartitionByRange(n, F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    end = struct.pack("<I", end_id)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), []
        coder, (fs, root) = word_coder(tokenizer), _filesystem(folder)
        fs.create_dir(root, recursive=True)
        ids: list[bytes] = []
        who: list[int | None] = []
        held = 0

        def flush() -> None:
            nonlocal ids, who, held
            name = f"{root}/{part:06d}-{len(made):06d}.slda"
            data = build(np.frombuffer(b"".join(ids), "<u4"), who, [len(x) // 4 for x in ids])
            temporary = f"{name}.{uuid.uuid4().hex}.tmp"
            with fs.open_output_stream(temporary) as f:
                f.write(data)
            fs.move(temporary, name)
            made.append((part, len(made), f"{folder}/{part:06d}-{len(made):06d}.slda", len(who), held))
            ids, who, held = [], [], 0

        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                piece = batch.slice(k, 500)
                for d, x in zip(piece.column(0).to_pylist(), coder.encode(piece.column(1).to_pylist(), end)):
                    if held and held + len(x) // 4 > file_ids:
                        flush()
                    ids.append(x)
                    who.append(d)
                    held += len(x) // 4
        if who:
            flush()
        names = ["part", "number", "path", "n_docs", "n_ids"]
        yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.string() if k == 2 else pa.int64()) for k in range(5)], names=names)

    return ordered.mapInArrow(work, "part bigint, number bigint, path string, n_docs bigint, n_ids bigint")


def read_files(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back from the files that ``files`` lists.

    start: ids of all documents before it. Sums of the partitions (one row each) give where a partition starts, sums in
    a partition where a file does; ids stay in their files.
    """
    ship(files.sparkSession)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select(F.col("part").alias("of"), (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("base"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")
    placed = files.withColumn("inside", inside).join(parts, F.col("part") == F.col("of")).select("path", (F.col("base") + F.col("inside")).alias("first"))
    # Dealt to a fixed number of tasks: by size the short list would be taken for little work.
    placed = placed.repartition(max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))), F.col("path"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, name = _filesystem(path)
                with fs.open_input_file(name) as f:
                    file = TokenFile(lambda at, size, f=f: f.read_at(size, at))
                    crcs, step = [], 1 << 20
                    a = 0
                    while a < len(file.ends):  # documents of about ``step`` ids at a time
                        b = max(a + 1, int(np.searchsorted(file.ends, file.starts[a] + step, "right")))
                        raw = file.span(int(file.starts[a]), int(file.ends[b - 1])).astype("<u4").tobytes()
                        z = int(file.starts[a]) * 4
                        crcs += [zlib.crc32(raw[x * 4 - z : y * 4 - z]) for x, y in zip(file.starts[a:b].tolist(), file.ends[a:b].tolist())]
                        a = b
                    columns = [pa.array(file.doc_ids, pa.int64()), pa.array(file.starts + first), pa.array(file.ends - file.starts), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, file_ids: int = 2_000_000) -> DataFrame:
    """Write ``docs`` as token files below the shared folder and read them back; see write_files and read_files."""
    folder = folder or work_dir(docs.sparkSession)
    files = save(write_files(docs, tokenizer, end_id, f"{folder}/tokens", file_ids), folder, "files")
    return read_files(files)
