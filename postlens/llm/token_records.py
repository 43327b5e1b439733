"""Token-id output as length-delimited binary records with a separate offset index.

A record file holds, after 12 bytes of header (magic, width of an id in bytes),
one frame per document:

    length      uint64   bytes of the body
    length crc  uint32   masked crc32 of the 8 length bytes
    body                 uint16 length of the id's text (0xFFFF: null), that text, the token ids
    body crc    uint32   masked crc32 of the body

All numbers are little-endian; ids take 2 bytes if the vocabulary fits, else 4.
The mask is the rotation by 15 bits plus a constant that keeps a checksum of data
that embed checksums apart. The index file beside it holds the frame offsets and
token counts (two int64 a record), so shuffled reads seek and need no scan.

Documents are range-partitioned by id and sorted, so files in (part, file) order
hold ascending ids; rows that repeat an id follow by hash of the text, null ids
come first, null texts are empty (the end id alone). Files carry a fresh name per
attempt; only the manifest rows that Spark commits make a file count, so lost
executors and repeated tasks leave no double records. Only the id and text columns
are read. An empty table gives an empty manifest. An id whose text takes 65,535 bytes or more raises an error.
"""

from __future__ import annotations

import struct
import sys
import unicodedata
import uuid
import zlib
from array import array

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import Memo, binary_texts, scratch, text_pieces, worker_store

MAGIC = b"PLTOKREC"
MASK = 0xA282EAD8  # fixed value of the masked-checksum convention
FILE_BYTES = 64 << 20
CACHED_CHUNKS = 600_000
MANIFEST = "part int, file int, path string, records long, tokens long"


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    size = struct.pack("<Q", len(body))
    return size + struct.pack("<I", masked(zlib.crc32(size))) + body + struct.pack("<I", masked(zlib.crc32(body)))


def pack_id(key: str | None) -> bytes:
    raw = b"" if key is None else key.encode()
    if len(raw) >= 0xFFFF:
        raise ValueError("an id of 65,535 bytes or more")
    return struct.pack("<H", 0xFFFF if key is None else len(raw)) + raw


def unpack(body: bytes, width: int) -> tuple[str | None, np.ndarray]:
    n = struct.unpack_from("<H", body)[0]
    key, at = (None, 2) if n == 0xFFFF else (body[2:2 + n].decode(), 2 + n)
    return key, np.frombuffer(body, "<u2" if width == 2 else "<u4", offset=at)


def _open(path: str):
    """(file system, path in it) for a URI of any store that pyarrow reads, or a plain local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])


def _letters(text: str) -> bool:
    """Whether a chunk is letters only, also once it is normalised (NFC, lower case): some letters turn into letter and mark."""
    return text.isalpha() and (text.isascii() or unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).lower()).isalpha())


class Encoder:
    """Token ids of whole texts, as bytes, through the tokenizer library.

    The tokenizer drops white space and never joins characters across it, so a
    text's ids are those of its white-space chunks in order; each distinct chunk is
    encoded once and kept while in use. A chunk of letters (normalised, too) and a final
    full stop or comma is two pre-tokens, encoded apart. Lower-cased Latin-1 letters alone are one
    pre-token that the normaliser leaves as it is: the library's model takes it
    directly, as the byte-level alphabet spells it. All else goes through ``encode``.
    """

    def __init__(self, spec: str, width: int):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.code, self.known = "H" if width == 2 else "I", Memo(self.ids, CACHED_CHUNKS)
        other = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.alphabet = {b: 256 + k for k, b in enumerate(other)}
        self.letters = re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch
        probe = ["caf\xe9\xdf\xff\xee", "the", "\xfc\xf1\xf5"]  # a tokenizer of another make gets no short cut
        self.direct = all(self._model(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probe)

    def _model(self, word: str) -> list[int]:
        """Ids of one pre-token, spelt in the byte-level alphabet: printable bytes as they are, others from U+0100 on."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.model.tokenize(word)]

    def ids(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if text[-1] in ".," and _letters(text[:-1]):
            return self.known[chunk[:-1]] + self.known[chunk[-1:]]
        low = text.lower()
        if self.direct and self.letters(low):
            got = self._model(low)
        else:
            got = self.tokenizer.encode(text, add_special_tokens=False).ids
        out = array(self.code, got)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def encode(self, text: bytes) -> bytes:
        return b"".join(b"".join(map(self.known.__getitem__, piece.split())) for piece in text_pieces(text))


def encoder(spec: str, width: int) -> Encoder:
    store = worker_store("token-encoder")
    key = zlib.crc32(spec.encode()), width
    if key not in store:
        store[key] = Encoder(spec, width)
    return store[key]


def write_records(docs: DataFrame, tokenizer_path: str, path: str, id_col: str = "doc_id", text_col: str = "text",
                  end_id: int | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes and writes every document under ``path``; returns the manifest, one row per file.

    One shuffle (the range partitioning); encoding and writing happen after it,
    one document at a time, so a task holds a document and an open file.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()  # travels with the task; executors need no file
    from tokenizers import Tokenizer

    size = Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True)
    width = 2 if max(size, end_id or 0) <= 1 << 16 else 4
    src = binary_texts(docs, id_col, text_col).withColumn("_h", F.xxhash64("text"))
    src = src.repartitionByRange("id", "_h").sortWithinPartitions("id", "_h").select(F.col("id").cast("string"), "text")
    kind = "<u2" if width == 2 else "<u4"
    tail = b"" if end_id is None else np.array([end_id], kind).tobytes()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, enc, rows = TaskContext.get().partitionId(), encoder(spec, width), []
        system, folder = _open(path)
        system.create_dir(folder, recursive=True)
        out = name = None
        index: list[int] = []
        tokens = at = 0

        def close():
            nonlocal out
            out.close()
            with system.open_output_stream(f"{folder}/{name}.idx") as f:
                f.write(np.array(index, "<i8").tobytes())
            rows.append((part, len(rows), f"{path}/{name}", len(index) // 2, tokens))
            out = None

        for b in batches:
            for key, text in zip(b.column(0), b.column(1), strict=True):
                if out is None:
                    name, index, tokens, at = f"part-{part:06d}-{len(rows):04d}-{uuid.uuid4().hex}.rec", [], 0, 12
                    out = system.open_output_stream(f"{folder}/{name}")
                    out.write(MAGIC + struct.pack("<I", width))
                ids = enc.encode(text.as_py()) + tail
                one = frame(pack_id(key.as_py()) + ids)
                out.write(one)
                index += at, len(ids) // width
                at, tokens = at + len(one), tokens + len(ids) // width
                if at >= file_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("part", "file", "path", "records", "tokens"), r, strict=True)) for r in rows],
            schema=pa.schema([("part", pa.int32()), ("file", pa.int32()), ("path", pa.string()),
                              ("records", pa.int64()), ("tokens", pa.int64())]))

    target = f"{path}/manifest"
    src.mapInArrow(run, MANIFEST).write.parquet(target)
    return docs.sparkSession.read.schema(MANIFEST).parquet(target)


def with_base(manifest: DataFrame) -> DataFrame:
    """Adds ``base``: tokens in all files before. One small row per file, so one ordered window does."""
    w = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("base", F.coalesce(F.sum("tokens").over(w), F.lit(0)))


def frames(stream, width_check: bool = True):
    """(width, body) of each record of an open file; a wrong checksum or a cut file is an error."""
    head = stream.read(12)
    if bytes(head[:8]) != MAGIC:
        raise ValueError("not a record file")
    width = struct.unpack("<I", head[8:])[0]
    while size := stream.read(8):
        n, check = struct.unpack("<Q", size)[0], stream.read(4)
        if len(check) < 4 or struct.unpack("<I", check)[0] != masked(zlib.crc32(size)):
            raise ValueError("a record's length is damaged")
        body, check = stream.read(n), stream.read(4)
        if len(body) < n or len(check) < 4 or struct.unpack("<I", check)[0] != masked(zlib.crc32(body)):
            raise ValueError("a record's body is damaged")
        yield width, body


def read_digests(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every record, read back from the files, one task per file."""
    files = max(manifest.count(), 1)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, name = _open(path)
                cols: tuple[list, ...] = ([], [], [], [])
                with system.open_input_stream(name, buffer_size=1 << 20) as f:
                    for width, body in frames(f):
                        key, ids = unpack(body, width)
                        for col, x in zip(cols, (key, base, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                            col.append(x)
                        base += len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                    ["id", "start", "n_tokens", "ids_crc32"])

    src = with_base(manifest).select("path", "base").repartition(files, "path")
    return src.mapInArrow(run, "id string, start long, n_tokens long, ids_crc32 long")


def read_shuffled(manifest: DataFrame, seed: int = 0) -> DataFrame:
    """(id, ids) of every record in a seeded random order: the index gives the offsets, each record is one seek."""

    def entries(batches):
        import pyarrow as pa

        for b in batches:
            for path in b.column(0).to_pylist():
                system, name = _open(path)
                with system.open_input_stream(f"{name}.idx") as f:
                    at = np.frombuffer(f.read(), "<i8")[::2]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(at), pa.string()), pa.array(at, pa.int64())], ["path", "at"])

    def fetch(batches):
        import pyarrow as pa

        opened: dict = {}
        for b in batches:
            keys, out = [], []
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if path not in opened:
                    if len(opened) >= 64:
                        opened.clear()
                    system, name = _open(path)
                    f = system.open_input_file(name)
                    opened[path] = f, struct.unpack("<I", f.read_at(4, 8))[0]
                f, width = opened[path]
                size = f.read_at(12, at)
                body = f.read_at(struct.unpack("<Q", size[:8])[0], at + 12)
                if struct.unpack("<I", f.read_at(4, at + 12 + len(body)))[0] != masked(zlib.crc32(body)):
                    raise ValueError("a record's body is damaged")
                key, ids = unpack(body, width)
                keys.append(key)
                out.append(ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out, pa.list_(pa.int32()))], ["id", "ids"])

    index = manifest.select("path").mapInArrow(entries, "path string, at long")
    return index.orderBy(F.xxhash64("path", "at", F.lit(seed)), "path", "at").mapInArrow(fetch, "id string, ids array<int>")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents to the shared folder and reads their digests back from the files."""
    path = scratch(docs.sparkSession, "token-records")
    return read_digests(write_records(docs, tokenizer_path, path, id_col, text_col, end_id))
