"""Token ids as length-delimited binary records with masked checksums and an offset index."""

from __future__ import annotations

import hashlib
import os
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.shared import shared_folder, worker_cache

cloudpickle.register_pickle_by_value(sys.modules[__name__])

END = 1
#: Pieces of text in a generation of a worker's cache. Two are kept, so that pieces in use outlive the many that come once.
CACHED = 250_000
OTHER = "\0"
#: Texts that tell tokenizers which keep white space, or see what it separates together, from those that don't.
PROBES = [" a", "a ", "a b", "a  b", "a\nb", "a\t b", "a\r\nb", "A bc, d . E", "1 2", "\u00e9 \u00e9", "the the . . the", "\n\n", "a \u4e2d b"]
INDEX = "shard int, path string, ordinal long, doc_id long, offset long, bytes long, n_tokens long"

# A record: u64 length, u32 masked CRC-32 of these 8 bytes, the payload, u32 masked CRC-32 of the payload;
# all little-endian. A payload: u8 bytes per id, u8 1 if the document has an id, i64 that id or 0, the ids.
LENGTH, CHECK, HEAD = "<Q", "<I", "<BBq"


def masked(data: bytes) -> int:
    """A checksum that stays sound where checksums are themselves part of checked data."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack(LENGTH, len(payload))
    return b"".join((length, struct.pack(CHECK, masked(length)), payload, struct.pack(CHECK, masked(payload))))


def read_frame(file) -> bytes | None:
    """The next payload, None at the end; ValueError for a record that is cut off or altered."""
    head = file.read(12)
    if not head:
        return None
    if len(head) < 12 or struct.unpack(CHECK, head[8:])[0] != masked(head[:8]):
        raise ValueError("a record's length is damaged")
    size = struct.unpack(LENGTH, head[:8])[0]
    rest = file.read(size + 4)
    if len(rest) < size + 4 or struct.unpack(CHECK, rest[size:])[0] != masked(rest[:size]):
        raise ValueError("a record's payload is damaged")
    return rest[:size]


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    width, has_id, doc_id = struct.unpack_from(HEAD, payload)
    return doc_id if has_id else None, np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(HEAD))


class Letters(dict):
    """What Latin letters become in any word, by code point; OTHER for what isn't one or is more than one part."""

    def __init__(self, parts: Callable[[str], list[str]]):
        super().__init__()
        self.parts = parts

    def __missing__(self, code: int) -> str:
        letter = chr(code)
        own = self.parts(letter) if letter.isalpha() and code < 0x250 else []
        self[code] = found = own[0] if len(own) == 1 and self.parts(f"a{letter}a") == [f"a{own[0]}a"] else OTHER
        return found


class Pieces(dict):
    """The ids, as bytes, of blank-separated pieces of text, made by the tokenizers library once per piece.

    For tokenizers that drop white space and never join what it separates: the ids of a text are then those
    of its pieces in turn. Whether a tokenizer is of that kind is seen from PROBES; one that isn't encodes whole
    texts. A piece goes through the tokenizer's normalizer and splitter, and its model's
    ids are kept per piece; one that holds an added token goes through the tokenizer as a whole. Pieces that differ
    in letter case or end in punctuation share the work, where the tokenizer itself is seen to treat them alike.
    """

    def __init__(self, tokenizer, width: int):
        super().__init__()
        self.kind, self.code = f"<u{width}", {2: "H", 4: "I"}[width]
        self.tokenizer, self.model, self.older, self.letters = tokenizer, tokenizer.model, {}, Letters(self._parts)
        self.whole = not all(self._encoded(text) == b"".join(map(self._encoded, text.split())) for text in PROBES)
        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.tail = {p for p in b".,;:!?" if self._parts(f"ab{chr(p)}") == ["ab", chr(p)] and self._parts(f"\u00e9{chr(p)}")[1:] == [chr(p)]}
        lower = "abcdefghijklmnopqrstuvwxyz"
        self.folds = self._parts(lower.upper()) == [lower] and self._parts(lower) == [lower]

    def _parts(self, text: str) -> list[str]:
        if self.tokenizer.pre_tokenizer is None:
            return []
        if self.tokenizer.normalizer is not None:
            text = self.tokenizer.normalizer.normalize_str(text)
        return [part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self._ids(piece)
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids

    def _ids(self, piece: bytes) -> bytes:
        if self.folds and piece.isalpha():  # of bytes: ASCII letters only
            low = piece.lower()
            return self._model(piece.decode()) if low == piece else self[low]
        if piece[-1] in self.tail and len(piece) > 1 and piece[:-1].decode()[-1].isalpha():
            return self[piece[:-1]] + self[piece[-1:]]
        text = piece.decode()
        part = text.translate(self.letters)
        if OTHER not in part:
            low = text.lower()
            return self[low.encode()] if low != text and low.translate(self.letters) == part else self._model(part)
        if any(a in text for a in self.added) or self.tokenizer.pre_tokenizer is None:
            return self._encoded(text)
        return b"".join(map(self._model, self._parts(text)))

    def _model(self, part: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(part)]).tobytes()

    def _encoded(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        if self.whole:
            return self._encoded((text or "").encode("utf-8", "replace").decode())
        return b"".join(map(self.__getitem__, (text or "").encode("utf-8", "replace").split()))


def _encoder(definition: str) -> Pieces:
    """This worker's encoder for a tokenizer definition (JSON)."""
    from tokenizers import Tokenizer

    cache, key = worker_cache("pieces"), hashlib.md5(definition.encode()).hexdigest()
    if key not in cache:
        tokenizer = Tokenizer.from_str(definition)
        largest = max(tokenizer.get_vocab(with_added_tokens=True).values())
        cache[key] = Pieces(tokenizer, 2 if max(largest, END) < 1 << 16 else 4)
    return cache[key]


def _writer(folder: str, definition, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One file per task. Each attempt writes a file of its own; the index names those of attempts that ended well."""
        encoder = _encoder(definition.value)
        width = int(encoder.kind[-1])
        last = np.array([end], encoder.kind).tobytes()
        shard = TaskContext.get().partitionId()
        path = os.path.join(folder, f"shard-{shard:06d}-{uuid.uuid4().hex}.bin")
        offset = ordinal = 0
        file = None
        try:
            for batch in batches:
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                    ids = encoder.encode(text.as_py()) + last
                    record = frame(struct.pack(HEAD, width, doc_id is not None, doc_id or 0) + ids)
                    file = file or open(path, "wb")
                    file.write(record)
                    rows.append((shard, path, ordinal, doc_id, offset, len(record), len(ids) // width))
                    offset, ordinal = offset + len(record), ordinal + 1
                names = [c.split()[0] for c in INDEX.split(", ")]
                kinds = [pa.int32(), pa.string(), *[pa.int64()] * 5]
                columns = list(zip(*rows)) or [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)
        finally:
            if file:
                file.close()

    return run


def write_records(docs: DataFrame, tokenizer_path: str, end: int = END) -> DataFrame:
    """Encode `docs` (doc_id, text) and write the ids as record files in ascending doc_id order; returns the offset index.

    The index (shard, path, ordinal, doc_id, offset, bytes, n_tokens) is itself a table in the shared
    folder. Shards follow one another in doc_id order, NULL ids first; rows of one id are ordered by
    their texts, and a crowded id is split over shards by them. NULL and empty texts are one end id.
    Ids have to be whole numbers that fit a long (or text of one); others raise an error.
    """
    spark = docs.sparkSession
    folder = shared_folder(spark, "records")
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())  # a tokenizer's own file: bounded by its vocabulary
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_h", F.xxhash64("text"))
    ordered = placed.repartitionByRange("doc_id", "_h").sortWithinPartitions("doc_id", "_h", "text").select("doc_id", "text")
    ordered.mapInArrow(_writer(folder, definition, end), INDEX).write.parquet(f"file://{folder}/index")
    return spark.read.schema(INDEX).parquet(f"file://{folder}/index")


def _read_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def found(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    for batch in batches:
        for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
            rows = []
            with open(path, "rb") as file:
                while (payload := read_frame(file)) is not None:
                    doc_id, ids = parse(payload)
                    rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 10_000:
                        yield found(rows)
                        rows = []
            if rows:
                yield found(rows)


def read_back(index: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per record, from the files: each shard is streamed and every checksum verified.

    start counts the ids of all records before it, over all shards. The driver sees one row per shard.
    """
    spark = index.sparkSession
    shards = index.groupBy("shard", "path").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    starts = np.concatenate(([0], np.cumsum([s["n"] for s in shards], dtype=np.int64))).tolist()
    rows = [(i, s["path"], at) for i, (s, at) in enumerate(zip(shards, starts))]
    listed = spark.createDataFrame(rows, "n int, path string, start long").repartitionById(max(1, len(rows)), F.col("n"))
    return listed.select("path", "start").mapInArrow(_read_shards, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _read_at(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, file, name = [], None, None
        for path, offset in zip(batch.column("path").to_pylist(), batch.column("offset").to_pylist()):
            if path != name:
                if file:
                    file.close()
                file, name = open(path, "rb"), path
            file.seek(offset)
            found.append(parse(read_frame(file)))
        if file:
            file.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in found], pa.int64()), pa.array([i.tolist() for _, i in found], pa.list_(pa.int32()))], names=["doc_id", "ids"]
        )


def read_shuffled(index: DataFrame, seed: int) -> DataFrame:
    """(doc_id, ids) of all records in a seeded random order, each fetched by its place in the index."""
    mixed = index.select("path", "offset", F.xxhash64(F.lit(seed), "shard", "ordinal").alias("_order")).orderBy("_order")
    return mixed.select("path", "offset").mapInArrow(_read_at, "doc_id long, ids array<int>")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenized(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Write `docs` as record files and return what reading them gives."""
    return read_back(write_records(docs, tokenizer_path or default_tokenizer()))


