"""Token ids in files of bit planes.

A file holds the ids of a run of documents in blocks of ``BLOCK`` ids. The bits of a block are transposed, so that plane
b has bit b of every id, and each plane is compressed with zstandard on its own; planes of zeros take no room. After the
blocks come a table of the documents (id, number of tokens) and the chunk index: for each block its place, its number of
ids and the sizes of its planes. The last 16 bytes are the length of that tail and a mark.

Documents are range-partitioned by id, so files follow each other in id order; a task writes under a name of its own
attempt and then moves the file in place, so a repeated task leaves the same file.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import drop_at_exit, python_batches, scratch

BLOCK = 1 << 16
LEVEL = 3
MARK = b"BITPLANE"
END_ID = 0

#: A blank between two characters that are no white space always starts a new piece of this vocabulary's pattern.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: White space other than blanks and line feeds.
RARE_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and c not in (10, 32)]
#: Words that a worker remembers, and that are encoded at once.
KNOWN_WORDS = 500_000
WORDS = 1_000
#: Characters whose texts are encoded together.
HELD_CHARACTERS = 1 << 22


def pack(ids: np.ndarray) -> list[bytes]:
    """The compressed bit planes of a block, lowest first; a plane of zeros is empty, planes above the last used are left out."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    press = zstandard.ZstdCompressor(level=LEVEL)
    narrow = ids.astype(np.uint16 if width <= 16 else np.uint32)
    planes = []
    for b in range(width):
        bits = (narrow & narrow.dtype.type(1 << b)).astype(bool)
        planes.append(press.compress(np.packbits(bits, bitorder="little").tobytes()) if bits.any() else b"")
    return planes


def unpack(planes: list[bytes], n: int) -> np.ndarray:
    """The ids of a block."""
    kind = np.uint16 if len(planes) <= 16 else np.uint32
    out = np.zeros(n, kind)
    press = zstandard.ZstdDecompressor()
    for b, plane in enumerate(planes):
        if plane:
            octets = np.frombuffer(press.decompress(plane, max_output_size=(n + 7) // 8), np.uint8)
            out |= np.unpackbits(octets, count=n, bitorder="little").astype(kind) << kind(b)
    return out.astype("<u4")


class Writer:
    """Writes one file; ids may come in pieces of any size."""

    def __init__(self, sink):
        self.sink, self.rest, self.index = sink, [], []
        self.held, self.at, self.total = 0, 0, 0
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.total += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            self._flush(last=False)

    def _flush(self, *, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, "<u4")
        stop = len(ids) if last else len(ids) // BLOCK * BLOCK
        for a in range(0, stop, BLOCK):
            planes = pack(ids[a : min(a + BLOCK, stop)])
            self.index.append((self.at, min(BLOCK, stop - a), [len(p) for p in planes]))
            for p in planes:
                self.sink.write(p)
                self.at += len(p)
        self.rest, self.held = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(last=True)
        tables = (
            pa.table({"doc_id": pa.array([d for d, _ in self.docs], pa.int64()), "n": pa.array([n for _, n in self.docs], pa.int64())}),
            pa.table({
                "at": pa.array([a for a, _, _ in self.index], pa.int64()),
                "n": pa.array([n for _, n, _ in self.index], pa.int64()),
                "planes": pa.array([s for _, _, s in self.index], pa.list_(pa.int32())),
            }),
        )
        tail = b""
        for t in tables:
            buffer = pa.BufferOutputStream()
            with pa.ipc.new_stream(buffer, t.schema) as out:
                out.write_table(t)
            packed = zstandard.ZstdCompressor(level=LEVEL).compress(buffer.getvalue().to_pybytes())
            tail += struct.pack("<q", len(packed)) + packed
        self.sink.write(tail + struct.pack("<q", len(tail)) + MARK)
        self.sink.close()


class Reader:
    """Reads one file through its index, a block at a time."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 16)
        length, mark = struct.unpack("<q8s", source.read(16))
        if mark != MARK:
            raise ValueError("no bit-plane file")
        source.seek(size - 16 - length)
        tail, at, tables = source.read(length), 0, []
        for _ in range(2):
            (n,) = struct.unpack_from("<q", tail, at)
            packed = zstandard.ZstdDecompressor().decompressobj().decompress(tail[at + 8 : at + 8 + n])
            tables.append(pa.ipc.open_stream(packed).read_all())
            at += 8 + n
        self.docs = list(zip(tables[0]["doc_id"].to_pylist(), tables[0]["n"].to_pylist()))
        self.index = list(zip(*(tables[1][c].to_pylist() for c in ("at", "n", "planes"))))

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.index[k]
        self.source.seek(at)
        return unpack([self.source.read(s) for s in sizes], n)

    def documents(self) -> Iterator[tuple[int | None, Iterator[np.ndarray], int]]:
        """(doc_id, its ids in pieces, their number) in file order; take the pieces before the next document."""
        k, ids, at = -1, np.zeros(0, "<u4"), 0

        def pieces(n: int) -> Iterator[np.ndarray]:
            nonlocal k, ids, at
            while n:
                if at == len(ids):
                    k, at = k + 1, 0
                    ids = self.block(k)
                part = ids[at : at + n]
                at, n = at + len(part), n - len(part)
                yield part

        for doc_id, n in self.docs:
            yield doc_id, pieces(n), n


def words_of(text: str) -> list[str]:
    """A text cut where the vocabulary's pattern always cuts.

    Every part but the first had a blank before it, or starts with its line feed.
    """
    odd = "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n"
    if odd or any(c in text for c in RARE_SPACES):
        return CUT.split(text)
    return text.replace("\n", " \n").split(" ")


#: Byte-level vocabularies write byte b as character b if that is printable Latin-1, and the others as 256, 257, ...
PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))
BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
BLANK = chr(BYTE_CHARACTERS[32])
#: Letters below this are one class in the vocabulary's pattern, whatever the edition of Unicode.
LATIN = "\u0250"


class Encoder:
    """Encodes texts with the tokenizers library; each different word is encoded once while it is remembered.

    A word of Latin letters is one piece of the vocabulary's pattern, as are full stops and commas after it, and goes
    straight to the library's model. Other words are encoded together, as one text, and told apart by the lengths of
    their pieces in bytes. When the memory is full, words that came up again since the last time stay.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # words come once; looking them up in the library's cache costs more
        vocabulary = self.tokenizer.get_vocab()
        # Vocabulary pieces have one character for each byte.
        self.octets = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for piece, i in vocabulary.items():
            self.octets[i] = len(piece)
        self.known: dict[str, bytes] = {}
        self.again: set[str] = set()
        self.stops: dict[str, bytes] = {"": b""}
        self.feed = self._ids("\n").tobytes()

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _letters(self, word: str) -> bytes | None:
        """Ids of a blank (or line feed) and a word of Latin letters, full stops and commas at its end; None for other words."""
        blank, feed = BLANK, b""
        if word[0] == "\n":
            blank, feed, word = "", self.feed, word[1:]
        bare = word.rstrip(".,")
        if not bare.isalpha() or not (bare.isascii() or max(bare) < LATIN):
            return None
        stops = word[len(bare) :]
        if stops not in self.stops:
            if len(self.stops) > 1000:
                self.stops = {"": b""}
            self.stops[stops] = self._ids(stops).tobytes()
        piece = bare if bare.isascii() else bare.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        return feed + array("I", [t.id for t in self.model.tokenize(blank + piece)]).tobytes() + self.stops[stops]

    def _learn(self, words: list[str]) -> None:
        """Remember words of any kind."""
        for word in words:
            if word[0] == "\n":
                self.known[word] = self._ids(word).tobytes()
        words = [w for w in words if w[0] != "\n"]
        for at in range(0, len(words), WORDS):
            part = words[at : at + WORDS]
            ids = self._ids(" " + " ".join(part))
            ends = np.cumsum([len(w.encode()) + 1 for w in part])
            cuts = (4 * (np.searchsorted(np.cumsum(self.octets[ids]), ends) + 1)).tolist()
            raw = ids.tobytes()
            self.known.update(zip(part, map(raw.__getitem__, map(slice, [0, *cuts], cuts))))

    def _forget(self) -> None:
        kept = {w: self.known[w] for w in self.again if w in self.known}
        self.known = kept if len(kept) < 0.75 * KNOWN_WORDS else {}
        self.again = set()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian unsigned 32-bit integers."""
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        cut = [words_of(t) if t else [""] for t in texts]
        first = [words[0] for words in cut]
        for words in cut:
            words[0] = ""
        different = set().union(*cut)
        different.discard("")
        old = different & self.known.keys()
        self.again |= old
        new = list(different - old)
        found = [self._letters(w) for w in new]
        self.known.update((w, x) for w, x in zip(new, found) if x is not None)
        self._learn([w for w, x in zip(new, found) if x is None])
        self.known[""] = b""
        get = self.known.__getitem__
        return [(self._ids(w).tobytes() if w else b"") + b"".join(map(get, words)) for w, words in zip(first, cut)]


def _filesystem(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+:/", path) else f"file://{path}")


def write(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` and write files under ``path``; one row per file: (file, path, n_docs, n_ids), in document order.

    ``path`` must be a folder that all executors reach: a local path on one machine, a shared one on a cluster.
    """
    spark = docs.sparkSession
    if not re.match(r"[a-z0-9]+:/", path):
        path = f"file://{path}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _filesystem(path)
        files.create_dir(folder)
        encoder, writer = Encoder(tokenizer), None
        k = TaskContext.get().partitionId()
        final, own = f"{folder}/part-{k:06d}.bp", f"{folder}/.part-{k:06d}-{uuid.uuid4().hex}"
        end = np.array([END_ID], "<u4").tobytes()
        held: list[tuple[int | None, str | None]] = []
        size = 0

        def flush() -> None:
            for (doc_id, _), ids in zip(held, encoder.encode([t for _, t in held])):
                writer.add(doc_id, np.frombuffer(ids + end, "<u4"))
            held.clear()

        for batch in python_batches(batches):
            writer = writer or Writer(files.open_output_stream(own))
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((doc_id, text))
                size += len(text or "")
                if size >= HELD_CHARACTERS:
                    flush()
                    size = 0
        if held:
            flush()
        if writer:
            writer.close()
            files.move(own, final)
            yield pa.RecordBatch.from_pylist([{"file": k, "path": f"{path}/part-{k:06d}.bp", "n_docs": len(writer.docs), "n_ids": writer.total}])

    ordered = (
        docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(parts, "id", "tie", "row")
        .sortWithinPartitions("id", "tie", "row")
        .select("id", "text")
    )
    schema = "file bigint, path string, n_docs bigint, n_ids bigint"
    found = ordered.mapInArrow(run, schema).collect()  # one row per file
    return spark.createDataFrame(sorted(found, key=lambda r: r["file"]), schema)


def read(spark: SparkSession, files: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of each document in the files of ``write``, read back block by block."""
    rows, start = [], 0
    for r in sorted(files.collect(), key=lambda r: r["file"]):  # one row per file
        rows.append((r["path"], start))
        start += r["n_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                files, name = _filesystem(path)
                out: list[tuple] = []
                with files.open_input_file(name) as source:
                    for doc_id, pieces, n in Reader(source).documents():
                        crc = 0
                        for part in pieces:
                            crc = zlib.crc32(part.tobytes(), crc)
                        out.append((doc_id, first, n, crc))
                        first += n
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], [id_col, "start", "n_tokens", "ids_crc32"])

    frame = spark.createDataFrame(rows, "path string, first bigint").repartition(max(1, len(rows)))
    return frame.mapInArrow(run, f"`{id_col}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def write_and_read(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as bit planes into the shared scratch folder and read the files back.

    One row per row of ``docs``: (id_col, start, n_tokens, ids_crc32).

    * A null or empty text has the end id alone. Null ids come first; rows with equal ids follow each other in the order
      of their texts' hashes. An empty table writes no file and gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    path = scratch(spark, "bit-planes")
    files = write(docs, path, tokenizer, id_col=id_col, text_col=text_col)
    drop_at_exit(spark, path)
    return read(spark, files, id_col=id_col)
