"""Token ids of documents in files of independent zstandard frames with a trailing seek table (operator 11).

A file holds, in order: frames of a fixed number of ids, each compressed on its own; a skippable frame with the documents' ids and numbers of
tokens (an Arrow stream); a skippable frame with the seek table of the zstandard seekable format: compressed size, size and checksum (low 32 bits of
XXH64) of each frame before it, then their number. Any zstandard reader unpacks the whole; a reader of some documents reads the two tables and their frames."""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anemos.llm._common import places, sized, stored, text_slices, words_of

# Fixed values of the zstandard seekable format: magic numbers of skippable frames and of the table's end, and the flag of checksums.
INDEX_MAGIC, TABLE_MAGIC, END_MAGIC, CHECKED = 0x184D2A51, 0x184D2A5E, 0x8F92EAB1, 0x80
#: Bytes of text that a task is given at least, as long as there are tasks for all cores.
LEAST_BYTES = 4 << 20
#: Words and ids that a worker process remembers.
KNOWN_WORDS, KNOWN_IDS = 1 << 20, 1 << 23
#: Words that are encoded together, as one text already cut into words: each is encoded by itself, but makes no object of its own.
TOGETHER = 512


@functools.lru_cache(2)
def _tokenizer(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_str(text)


class Letters:
    """A short way to the ids of words of letters (ASCII and Latin-1), with or without commas and full stops at the end: what the tokenizer's normalizer
    and pre-tokenizer make of each letter is asked of them once, and whether they make the same of it next to any other and part letters from the points. Where they do,
    a word goes to the tokenizer's model as they would hand it on; `shape` matches no word otherwise."""

    ALPHABET = [c for c in map(chr, range(256)) if c.isalpha()]

    def __init__(self, tokenizer):
        self.tokenizer, self.tails = tokenizer, {}
        alone = {c: self.pieces(c) for c in self.ALPHABET}
        letters = [c for c in self.ALPHABET if len(alone[c]) == 1]
        self.table = {ord(c): alone[c][0] for c in letters}
        special = any(set(t.content) <= set(letters + [",", "."]) for t in tokenizer.get_added_tokens_decoder().values())
        pairs = "".join(a + b for a in letters for b in letters)  # each letter before and after each
        parted = all(self.pieces(c + t + t + c) == self.pieces(c) + self.pieces(t + t) + self.pieces(c) for c in letters for t in (",", ".", ",.", ".,"))
        holds = letters and parted and not special and self.pieces(pairs) == [pairs.translate(self.table)]
        self.shape = re.compile(f"([{''.join(letters)}]+)([,.]*)" if holds else "(?!)()()")

    def pieces(self, text: str) -> list[str]:
        t = self.tokenizer
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        return [p for p, _ in t.pre_tokenizer.pre_tokenize_str(text)] if t.pre_tokenizer else [text]

    def ids(self, word: re.Match) -> list[int]:
        """The ids of a word that `shape` matches wholly."""
        letters, tail = word.groups()
        ids = [t.id for t in self.tokenizer.model.tokenize(letters.translate(self.table))]
        if not tail:
            return ids
        if tail not in self.tails:
            if len(self.tails) > 1000:
                self.tails.clear()
            self.tails[tail] = self.tokenizer.encode(tail, add_special_tokens=False).ids
        return ids + self.tails[tail]


@functools.lru_cache(2)
def _letters(tokenizer: str) -> Letters:
    return Letters(_tokenizer(tokenizer))


class Encoder:
    """Ids of whole texts by a tokenizer that drops white space and never joins what it parts: so the ids of a text are those of its words in
    turn, and each different word is encoded once, as long as it is remembered."""

    def __init__(self, tokenizer: str):
        self.encode, self.letters = _tokenizer(tokenizer).encode_batch, _letters(tokenizer)
        self.forget()

    def forget(self) -> None:
        self.number, self.ids, self.bounds = pa.array([], pa.binary()), array("I"), array("q", [0])

    def learn(self, new: pa.Array) -> None:
        """Remember words, numbered in this order, and their ids."""
        words = [w.decode("utf-8", "replace") for w in new.to_pylist()]
        short = [self.letters.shape.fullmatch(w) for w in words]
        rest = [w for w, m in zip(words, short) if not m]
        long_ids, cut = array("I"), [np.zeros(1, np.int64)]
        for lo in range(0, len(rest), TOGETHER):
            some = rest[lo : lo + TOGETHER]
            coded = self.encode([some], is_pretokenized=True, add_special_tokens=False)[0]
            cut.append(len(long_ids) + np.cumsum(np.bincount(np.array(coded.word_ids, np.int64), minlength=len(some))))
            long_ids.extend(coded.ids)
        cut, k = np.concatenate(cut).tolist(), 0
        for m in short:
            if m:
                self.ids.extend(self.letters.ids(m))
            else:
                self.ids.extend(long_ids[cut[k] : cut[k + 1]])
                k += 1
            self.bounds.append(len(self.ids))
        self.number = pa.concat_arrays([self.number, new])

    def __call__(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if len(self.number) > KNOWN_WORDS or len(self.ids) > KNOWN_IDS:
            self.forget()
        words, doc = words_of(buf, offs)
        found = pc.index_in(words, value_set=self.number)
        at = found.fill_null(-1).to_numpy().astype(np.int64)
        if found.null_count:
            unknown, known = words.filter(found.is_null()), len(self.number)
            coded = unknown.dictionary_encode()
            self.learn(coded.dictionary)
            at[at < 0] = known + coded.indices.to_numpy()
        bounds = np.array(self.bounds)
        n = bounds[at + 1] - bounds[at]
        ids = np.array(self.ids, np.uint32)[places(bounds[at], n)]
        return ids, np.bincount(doc, weights=n, minlength=len(offs) - 1).astype(np.int64)


@functools.lru_cache(1)
def encoder_of(tokenizer: str) -> Encoder:
    """One encoder to a worker process, so that its next task knows the words too."""
    return Encoder(tokenizer)


def ended(ids: np.ndarray, n: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with end_id after each text's, and the numbers with it."""
    out = np.full(len(ids) + len(n), end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
    return out, n + 1


def file_system(path: str) -> tuple[FileSystem, str]:
    """The file system and path that a folder's name means to both Spark and Arrow."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class Frames:
    """Writes a file, frame by frame, and puts it in its place when it is whole, so that a task that is lost or tried twice leaves none or the same."""

    def __init__(self, fs: FileSystem, path: str, width: int, id_type: pa.DataType, most: int):
        self.fs, self.path, self.width, self.id_type, self.most = fs, path, width, id_type, most
        self.draft = f"{path}.{uuid.uuid4().hex}"
        self.out = fs.open_output_stream(self.draft)
        self.pack = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.rest, self.table, self.docs, self.size = np.zeros(0, np.uint32), [], [], 0

    def add(self, docs: pa.Array, n: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(pa.RecordBatch.from_arrays([docs, pa.array(n, pa.int64())], names=["id", "n"]))
        self.size += self.width * len(ids)
        self.rest = np.concatenate([self.rest, ids])
        whole = len(self.rest) // self.most * self.most
        for lo in range(0, whole, self.most):
            self.frame(self.rest[lo : lo + self.most])
        self.rest = self.rest[whole:]

    def frame(self, ids: np.ndarray) -> None:
        raw = ids.astype(f"<u{self.width}").tobytes()
        self.write(self.pack.compress(raw), raw)

    def write(self, packed: bytes, raw: bytes) -> None:
        self.out.write(packed)
        self.table.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def close(self) -> tuple[str, int, int]:
        """(file's name, documents, ids)."""
        if len(self.rest):
            self.frame(self.rest)
        schema = pa.schema([("id", self.id_type), ("n", pa.int64())], {"width": str(self.width)})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            for batch in self.docs:
                w.write_batch(pa.RecordBatch.from_arrays(batch.columns, schema=schema))
        index = sink.getvalue().to_pybytes()
        self.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index, b"")
        entries = b"".join(struct.pack("<III", *e) for e in self.table)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(self.table), CHECKED, END_MAGIC))
        self.out.close()
        self.fs.move(self.draft, self.path)
        return self.path.rsplit("/", 1)[-1], sum(b.num_rows for b in self.docs), self.size // self.width


class Reader:
    """Reads a file's tables, and of its frames those that are asked for; each is held against its checksum."""

    def __init__(self, fs: FileSystem, path: str):
        self.file, self.path = fs.open_input_file(path), path
        size = self.file.size()
        count, flags, magic = struct.unpack("<IBI", self.at(size - 9, 9)) if size >= 17 else (0, 0, 0)
        if magic != END_MAGIC or flags != CHECKED or size < 17 + 12 * count:
            raise ValueError(f"{path} has no seek table")
        self.table = np.frombuffer(self.at(size - 9 - 12 * count, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        stream = pa.ipc.open_stream(self.at(int(self.starts[-2]) + 8, int(self.table[-1, 0]) - 8))
        self.docs = stream.read_all()
        self.width = int(stream.schema.metadata[b"width"])
        self.bounds = np.concatenate([[0], np.cumsum(self.docs["n"].to_numpy())])  # of the documents' ids
        self.cuts = np.concatenate([[0], np.cumsum(self.table[:-1, 1])]) // self.width  # of the frames' ids
        self.unpack, self.held = zstandard.ZstdDecompressor(), (-1, np.zeros(0, np.uint32))

    def at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(size)

    def frame(self, i: int) -> np.ndarray:
        if self.held[0] != i:
            try:
                raw = self.unpack.decompress(self.at(int(self.starts[i]), int(self.table[i, 0])), max_output_size=int(self.table[i, 1]))
            except zstandard.ZstdError as e:
                raise ValueError(f"frame {i} of {self.path}: {e}") from None
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[i, 2] or len(raw) != self.table[i, 1]:
                raise ValueError(f"frame {i} of {self.path} does not have its checksum")
            self.held = i, np.frombuffer(raw, f"<u{self.width}").astype("<u4")
        return self.held[1]

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """The file's ids from lo to hi."""
        first = int(np.searchsorted(self.cuts, lo, side="right")) - 1
        parts = []
        while lo < hi:
            upto = min(hi, int(self.cuts[first + 1]))
            parts.append(self.frame(first)[lo - self.cuts[first] : upto - self.cuts[first]])
            lo, first = upto, first + 1
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def close(self) -> None:
        self.file.close()


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, frame_ids: int = 1 << 16, file_bytes: int = 64 << 20, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text with the tokenizer whose file is named (read here and sent to the tasks), add end_id, and write the ids in ascending order of
    id_col to files of about file_bytes of ids, in frames of frame_ids, under path: a folder that tasks and driver reach, as Arrow's file systems name it.

    Texts are shuffled once, by ranges of ids; a range is one task's, of about file_bytes of text. Null and empty texts have the end id
    alone. Null ids come last; rows of one id come in the order of their texts' hashes, and rows equal in both as they lie, being alike (also what parts a range of
    one id). An empty table makes no file. Texts are encoded whole. The tokenizer must drop white space, as word_bpe_49k does. Other columns,
    whatever their names, are not written."""
    with open(tokenizer, encoding="utf-8") as f:
        model = f.read()
    width = 2 if max(_tokenizer(model).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
    held = docs.agg(F.sum(F.octet_length(text_col)), F.count(F.lit(1))).first()
    size = (held[0] or 0) + 4 * held[1]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"), F.monotonically_increasing_id().alias("lies"))
    order = [F.col("id").asc_nulls_last(), F.col("h").asc(), F.col("lies").asc()]
    parts = max(1, -(-size // file_bytes), min(-(-size // LEAST_BYTES), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranges = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "text")
    fs, folder = file_system(f"{path}/ids")
    fs.create_dir(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, folder = file_system(f"{path}/ids")
        encoder, part, made, out = encoder_of(model), TaskContext.get().partitionId(), [], None
        for batch in batches:
            for lo, hi, buf, offs in text_slices(batch.column(1), 4 << 20):
                if out is None:
                    out = Frames(fs, f"{folder}/{part:07d}-{len(made):05d}.zst", width, batch.schema.field(0).type, frame_ids)
                ids, n = ended(*encoder(buf, offs), end_id)
                out.add(batch.column(0)[lo:hi], n, ids)
                if out.size >= file_bytes:
                    made.append(out.close())
                    out = None
        if out is not None:
            made.append(out.close())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made) if made else ((), (), ()), (pa.string(), pa.int64(), pa.int64()))], names=["file", "docs", "ids"])

    ranges.mapInArrow(write, "file string, docs long, ids long").write.mode("overwrite").parquet(f"{path}/files")


def files(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, ids): the files in order, with the number of ids before each, as their own tables tell. The window sees one row per
    file."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(f"{path}/ids")
        for batch in batches:
            n = []
            for name in batch.column(0).to_pylist():
                reader = Reader(fs, f"{folder}/{name}")
                n.append(int(reader.bounds[-1]))
                reader.close()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["file", "ids"])

    names = spark.read.parquet(f"{path}/files").select("file")
    found = stored(names.mapInArrow(look, "file string, ids long"), "token-files")
    return found.select("file", (F.sum("ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, 0)) - F.col("ids")).alias("first"), "ids")


def _read(path: str, id_type: str, tables_only: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(f"{path}/ids")
        for batch in batches:
            for name, first in zip(*(c.to_pylist() for c in batch.columns)):
                reader = Reader(fs, f"{folder}/{name}")
                n = np.diff(reader.bounds)
                docs = reader.docs["id"].combine_chunks()
                for lo in range(0, len(n), 4096) if tables_only else (range(0, 0)):
                    hi = min(lo + 4096, len(n))
                    yield pa.RecordBatch.from_arrays([docs[lo:hi], pa.array([name] * (hi - lo)), pa.array(first + reader.bounds[lo:hi]), pa.array(reader.bounds[lo:hi]), pa.array(n[lo:hi])], names=["id", "file", "start", "at", "n_tokens"])
                lo = 0
                while lo < len(n) and not tables_only:
                    hi = max(lo + 1, int(np.searchsorted(reader.bounds, reader.bounds[lo] + (1 << 20), side="right")) - 1)
                    ids = reader.ids(int(reader.bounds[lo]), int(reader.bounds[hi])).tobytes()
                    cuts = 4 * (reader.bounds[lo : hi + 1] - reader.bounds[lo])
                    values = pa.array([ids[a:b] for a, b in zip(cuts, cuts[1:])], pa.binary())
                    yield pa.RecordBatch.from_arrays([docs[lo:hi], pa.array(first + reader.bounds[lo:hi]), pa.array(n[lo:hi]), values], names=["id", "start", "n_tokens", "ids"])
                    lo = hi
                reader.close()

    return read, f"id {id_type}, file string, start long, at long, n_tokens long" if tables_only else f"id {id_type}, start long, n_tokens long, ids binary"


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id", id_type: str = "long") -> DataFrame:
    """(id_col, start, n_tokens, ids) of every document of the files under path: the number of ids of all documents before it, its own
    number, its ids as little-endian unsigned 32-bit integers. A frame that doesn't have its checksum is an error. A task holds a file's tables
    and a megabyte of ids, or one document's."""
    listed = files(spark, path)
    read, schema = _read(path, id_type, False)
    return listed.select("file", "first").repartition(max(1, listed.count()), "file").mapInArrow(read, schema).withColumnRenamed("id", id_col)


def read_documents(spark: SparkSession, path: str, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """read_tokens' rows of the documents whose id is in wanted[id_col] (once each, however often it is there; null finds none). Of a file only
    the tables and the frames in which such documents lie are read."""
    id_type = wanted.schema[id_col].dataType.simpleString()
    listed = files(spark, path)
    read, schema = _read(path, id_type, True)
    tables = listed.select("file", "first").repartition(max(1, listed.count()), "file").mapInArrow(read, schema)
    asked = tables.join(sized(stored(wanted.select(F.col(id_col).alias("id")).distinct(), "wanted")), "id", "left_semi")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(f"{path}/ids")
        reader = None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                values = []
                for name, at, n in zip(*(some.column(k).to_pylist() for k in (1, 3, 4))):
                    if reader is None or reader.path != f"{folder}/{name}":
                        reader = Reader(fs, f"{folder}/{name}")
                    values.append(reader.ids(at, at + n).tobytes())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), some.column(4), pa.array(values, pa.binary())], names=["id", "start", "n_tokens", "ids"])

    # a file's documents are read in parts of a million ids, so that one file that is asked for alone has more than one task
    dealt = asked.repartition("file", F.floor(F.col("at") / (1 << 20))).sortWithinPartitions("file", "at")
    return dealt.mapInArrow(fetch, f"id {id_type}, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)
