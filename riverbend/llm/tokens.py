"""Token-ID files: independent zstandard frames, a document index, a trailing seek table, per-frame checksums.

A file (one per range of doc_id, documents in ascending doc_id order) is:

* frames: each a zstandard frame of little-endian unsigned 32-bit ids of whole
  consecutive documents, about ``FRAME_IDS`` ids (a longer document has a frame
  of its own);
* a skippable frame (magic 0x184D2A5D) with the zstd-packed document index:
  whether there is a doc_id, doc_id (0 if not), frame, first id in the frame, number of ids (int64 little-endian);
* a skippable frame (magic 0x184D2A5E) with the seek table of the public
  seekable format: per frame compressed size, decompressed size, checksum (low
  32 bits of XXH64 of the content), then frame count, descriptor 0x80, and
  magic 0x8F92EAB1.

Any zstandard tool can unpack a file; a reader of some documents reads the tail
and only the frames that hold them.

Texts are encoded word by word: chunks between ASCII white space are encoded once per
task by the tokenizers library and remembered
in a table of bounded size, which gives the same ids as encoding the whole text, as tests check (the vocabulary's
pre-tokeniser never joins across white space).

Defined cases. Null or empty text: only the end id. Null doc_id: ordered first,
kept apart from every number. Repeated rows are all written, equal doc_ids in any order of equal rows, else
by text. Empty table: no files, empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbend.llm import shared, words

END_ID = 2
FRAME_IDS = 1 << 16
#: Bytes of text in one file, roughly.
FILE_BYTES = 64 << 20
INDEX_MAGIC, SEEK_MAGIC, SEEK_END, CHECKSUMS = 0x184D2A5D, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Distinct chunks that a task remembers, about (some 50 bytes each), the most bytes of one that it does, and pieces of chunks that it does.
REMEMBERED, CHUNK_BYTES, PIECES = 1 << 18, 64, 1 << 14
#: Bytes of text encoded at once; chunks are looked up once for all of them, and memory goes back to the system after them.
ENCODE_BYTES = 1 << 20


def _word_pieces(tokenizer) -> bool:
    """Whether the tokenizer is of the kind that _PIECES describes; any other is only used whole."""
    kind = json.loads(tokenizer.to_str())
    cuts = (kind.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return kind["model"].get("end_of_word_suffix") == "</w>" and (cuts[0].get("pattern") or {}).get("Regex", "").startswith("'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|")


def _symbols() -> dict[int, str]:
    """Byte-level BPE's byte symbols: printable Latin-1 bytes stand for themselves, others follow from U+0100 in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_SYMBOLS = _symbols()


def _byte_symbols(piece: str) -> str:
    return piece if piece.isascii() else "".join(map(_SYMBOLS.__getitem__, piece.encode()))


_PRINTABLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The pre-tokeniser's pattern for lower-case printable ASCII and Latin-1 letters.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _flat(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all intervals one after another."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def chunk_keys(chunks: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each chunk of at most CHUNK_BYTES bytes, and which chunks these are."""
    bounds = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset:chunks.offset + len(chunks) + 1]
    start, size = bounds[:-1], np.diff(bounds)
    data = chunks.buffers()[2]
    raw = np.concatenate([np.frombuffer(data, np.uint8)[:bounds[-1]] if data is not None else np.empty(0, np.uint8), np.zeros(8, np.uint8)])
    own = size <= CHUNK_BYTES
    one, two = size.astype(np.uint64), size.astype(np.uint64)
    live = np.flatnonzero(own)
    for k in range(0, CHUNK_BYTES, 8):
        live = live[size[live] > k]
        if not live.size:
            break
        word = raw[(start[live] + k)[:, None] + np.arange(8)].view("<u8")[:, 0] & _LOW_BYTES[np.minimum(size[live] - k, 8)]
        one[live] = words.mix((one[live] ^ word) * np.uint64(0x9E3779B97F4A7C15))
        two[live] = words.mix((two[live] + word) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 1))
    return one, two, own


class WordEncoder:
    """Encodes texts chunk by chunk with a bounded memory of chunks already seen, by 128 bits of their hash.

    A new chunk of printable ASCII and Latin-1 letters is cut by the pre-tokeniser's pattern and its pieces go to the tokenizer's model;
    any other chunk, and any that may hold a special token, goes through the whole tokenizer.
    """

    def __init__(self, tokenizer_path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.by_model = _word_pieces(self.tokenizer)
        self.remembered = remembered
        self.pieces: dict[str, list[int]] = {}
        # Sorted names with the numbers of their chunks; ids, their bounds and how often a chunk came, by number.
        self.one, self.two, self.number = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int32)
        self.ids, self.bounds, self.seen = np.empty(0, np.uint32), np.zeros(1, np.int64), np.empty(0, np.int32)

    def _forget(self) -> None:
        """Keeps the chunks that came most often, half of what is remembered at most; the others are encoded anew when they come again."""
        known = np.flatnonzero(self.seen > 1)
        kept = np.sort(known[np.argsort(-self.seen[known], kind="stable")[:self.remembered // 2]])
        new = np.full(self.seen.size, -1, np.int32)
        new[kept] = np.arange(kept.size, dtype=np.int32)
        size = np.diff(self.bounds)[kept]
        self.ids = self.ids[_flat(self.bounds[kept], size)]
        self.bounds, self.seen = np.concatenate([[0], np.cumsum(size)]), self.seen[kept] // 2
        own = new[self.number] >= 0
        self.one, self.two, self.number = self.one[own], self.two[own], new[self.number[own]]

    def _encoded(self, chunks: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(chunks)
        rest = []
        model, known = self.tokenizer.model, self.pieces
        if len(known) > PIECES:
            known.clear()
        for at, chunk in enumerate(chunks):
            if not (self.by_model and _PRINTABLE.fullmatch(chunk) and "<|" not in chunk):
                rest.append(at)
                continue
            ids: list[int] = []
            for piece in _PIECES.findall(chunk.lower()):
                got = known.get(piece)
                if got is None:
                    got = [t.id for t in model.tokenize(_byte_symbols(piece))]
                    if len(piece) <= CHUNK_BYTES and len(known) <= PIECES:
                        known[piece] = got
                ids += got
            out[at] = ids
        for a in range(0, len(rest), 4096):
            part = rest[a:a + 4096]
            for at, encoding in zip(part, self.tokenizer.encode_batch([chunks[i] for i in part], add_special_tokens=False), strict=True):
                out[at] = encoding.ids
        return out

    def _numbers(self, names: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each chunk, and ids and bounds by number: those remembered, then this time's long ones."""
        one, two, own = chunk_keys(names)
        at = np.minimum(np.searchsorted(self.one, one), max(self.one.size - 1, 0))
        hit = own & (self.one[at] == one) & (self.two[at] == two) if self.one.size else np.zeros(own.size, bool)
        numbers = np.empty(own.size, np.int64)
        numbers[hit] = self.number[at[hit]]
        new = np.concatenate([np.flatnonzero(~hit & own), np.flatnonzero(~own)])
        made = self._encoded(names.take(pa.array(new)).to_pylist())
        size = np.fromiter(map(len, made), np.int64, len(made))
        numbers[new] = self.seen.size + np.arange(new.size)
        ids = np.concatenate([self.ids, np.fromiter((i for x in made for i in x), np.uint32, int(size.sum()))])
        bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(size)])
        short = int((~hit & own).sum())
        fresh = new[:short][np.argsort(one[new[:short]], kind="stable")]
        place = np.searchsorted(self.one, one[fresh])
        self.number = np.insert(self.number, place, numbers[fresh].astype(np.int32))
        self.one, self.two = np.insert(self.one, place, one[fresh]), np.insert(self.two, place, two[fresh])
        self.bounds = bounds[:self.seen.size + short + 1]
        self.ids = ids[:self.bounds[-1]]
        self.seen = np.concatenate([self.seen, np.zeros(short, np.int32)])
        self.seen[numbers[own]] += 1
        return numbers, ids, bounds

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of texts); null counts as empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        lists = pc.ascii_split_whitespace(texts)
        coded = lists.flatten().dictionary_encode()
        if self.seen.size > self.remembered:
            self._forget()
        numbers, ids, bounds = self._numbers(coded.dictionary)
        chunk = numbers[np.asarray(coded.indices)] if len(numbers) else np.empty(0, np.int64)
        size = bounds[chunk + 1] - bounds[chunk]
        total = np.concatenate([[0], np.cumsum(size)])
        cut = np.asarray(lists.offsets, np.int64)
        return ids[_flat(bounds[chunk], size)], total[cut - cut[0]]


class FrameWriter:
    """Streams documents into frames; at most one frame is held."""

    def __init__(self, frame_ids: int = FRAME_IDS, level: int = 3):
        self.frame_ids, self.packer = frame_ids, zstandard.ZstdCompressor(level=level)
        self.pending: list[np.ndarray] = []
        self.held = 0
        self.seek: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[bytes]:
        if self.held and self.held + ids.size > self.frame_ids:
            yield self._frame()
        self.index.append((int(doc_id is not None), doc_id or 0, len(self.seek), self.held, ids.size))
        self.pending.append(ids)
        self.held += ids.size

    def _frame(self) -> bytes:
        raw = np.concatenate(self.pending).astype("<u4").tobytes()
        packed = self.packer.compress(raw)
        self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.pending, self.held = [], 0
        return packed

    def finish(self) -> Iterator[bytes]:
        if self.held:
            yield self._frame()
        index = self.packer.compress(np.array(self.index, "<i8").reshape(-1, 5).T.tobytes())
        yield struct.pack("<II", INDEX_MAGIC, len(index)) + index
        table = b"".join(struct.pack("<III", *x) for x in self.seek) + struct.pack("<IBI", len(self.seek), CHECKSUMS, SEEK_END)
        yield struct.pack("<II", SEEK_MAGIC, len(table)) + table


class TokenFile:
    """Random access to one token file."""

    def __init__(self, uri: str):
        store, path = shared.filesystem(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 9)
        frames, descriptor, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEK_END or descriptor != CHECKSUMS:
            raise ValueError(f"{uri} has no seek table")
        at = size - 9 - 12 * frames - 8
        self.file.seek(at)
        raw = self.file.read(8 + 12 * frames)
        if struct.unpack("<II", raw[:8]) != (SEEK_MAGIC, 12 * frames + 9):
            raise ValueError(f"{uri} has a broken seek table")
        self.seek = np.frombuffer(raw[8:], "<u4").reshape(-1, 3).astype(np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.seek[:, 0])])
        self.file.seek(int(self.start[-1]))
        raw = self.file.read(at - int(self.start[-1]))
        magic, length = struct.unpack("<II", raw[:8])
        if magic != INDEX_MAGIC or length != len(raw) - 8:
            raise ValueError(f"{uri} has a broken document index")
        has, self.doc_id, self.frame_of, self.first, self.count = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[8:]), "<i8").reshape(5, -1)
        self.has_id = has.astype(bool)

    def frame(self, k: int) -> np.ndarray:
        packed, size, checksum = (int(x) for x in self.seek[k])
        self.file.seek(int(self.start[k]))
        raw = zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} fails its checksum")
        return np.frombuffer(raw, "<u4")

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents in order; one frame is held at a time."""
        yield from self._rows(np.arange(self.doc_id.size))

    def _rows(self, at: np.ndarray) -> Iterator[tuple[int | None, np.ndarray]]:
        now, ids = -1, None
        columns = (x[at].tolist() for x in (self.has_id, self.doc_id, self.frame_of, self.first, self.count))
        for has, doc, k, first, n in zip(*columns, strict=True):
            if k != now:
                now, ids = k, self.frame(k)
            yield doc if has else None, ids[first:first + n]

    def read(self, doc_ids) -> list[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) of every row of the requested documents (None: of rows without an id); only frames that hold them are unpacked."""
        wanted = set(doc_ids)
        numbers = np.array(sorted(wanted - {None}), np.int64)
        return list(self._rows(np.flatnonzero(np.where(self.has_id, np.isin(self.doc_id, numbers), None in wanted))))

    def close(self) -> None:
        self.file.close()


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = END_ID, files: int | None = None) -> DataFrame:
    """Writes token files in ascending doc_id order; returns the manifest: file, uri, first_start, n_docs, n_ids.

    Names depend only on the range, files appear whole by rename, and a retried task writes the same file again. Ranges follow
    doc_id, which is spread evenly whatever the sources or copies are.
    """
    spark = docs.sparkSession
    shared.small_batches(spark)
    x = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if files is None:
        total = x.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        files = max(1, -(-total // FILE_BYTES), min(spark.sparkContext.defaultParallelism, total >> 22))
    ranged = x.repartitionByRange(files, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        encoder, writer = WordEncoder(tokenizer_path), FrameWriter()
        end = np.array([end_id], np.uint32)

        def pieces() -> Iterator[bytes]:
            for docs, texts in _gathered(batches):
                ids, offsets = encoder.encode(texts)
                shared.release()
                for i, doc in enumerate(docs.to_pylist()):
                    yield from writer.add(doc, np.concatenate([ids[offsets[i]:offsets[i + 1]], end]))
            yield from writer.finish()

        stream = pieces()
        first = next(stream)
        if not writer.index:
            return
        uri = f"{folder}/tokens-{number:06d}.zst"

        def rest() -> Iterator[bytes]:
            yield first
            yield from stream

        shared.write_atomically(uri, rest())
        n_ids = sum(x[4] for x in writer.index)
        yield pa.RecordBatch.from_pydict({"file": [number], "uri": [uri], "n_docs": [len(writer.index)], "n_ids": [n_ids]})

    made = ranged.mapInArrow(shared.lean(run), "file bigint, uri string, n_docs bigint, n_ids bigint")
    made = shared.materialise(made, "manifest")
    rows = sorted(made.collect(), key=lambda r: r["file"])  # a row per file of FILE_BYTES
    start, out = 0, []
    for r in rows:
        out.append((r["file"], r["uri"], start, r["n_docs"], r["n_ids"]))
        start += r["n_ids"]
    return spark.createDataFrame(out, "file bigint, uri string, first_start bigint, n_docs bigint, n_ids bigint")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Columns of consecutive batches put together up to ENCODE_BYTES."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= ENCODE_BYTES:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    whole = pa.Table.from_batches(held)
    return whole.column(0).combine_chunks(), pa.concat_arrays([c.cast(pa.large_string()) for c in whole.column(1).chunks])


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the manifest's files, from the files."""
    spark = manifest.sparkSession
    rows = manifest.select("uri", "first_start").collect()
    if not rows:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    spread = spark.createDataFrame(spark.sparkContext.parallelize([(r[0], r[1]) for r in rows], len(rows)), "uri string, first_start bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = TokenFile(uri)
                out: list[tuple] = []
                for doc, ids in f:
                    out.append((doc, start, ids.size, zlib.crc32(ids.tobytes())))
                    start += ids.size
                    if len(out) == 8192:
                        yield _rows(out)
                        out = []
                f.close()
                if out:
                    yield _rows(out)

    return spread.mapInArrow(shared.lean(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def encode_documents(docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes docs as token files and returns one row per document, read back from them."""
    return read(write(docs, tokenizer_path, folder or shared.new_folder(docs.sparkSession, "tokens"), end_id))
