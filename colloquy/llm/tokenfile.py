"""Token ids in directly addressable codes, written by Spark in ascending document order and read back.

A segment holds the ids of consecutive documents. Each id is split into bytes, lowest first. Level k has the k-th byte
of every id that has one, a bitmap that marks which of them continue on level k + 1, and a rank directory: the number
of marks before every ``STRIDE`` bits. Token i has byte i of level 0; if its mark is set, its place on the next level
is the number of marks before it (a directory entry and a count over at most ``STRIDE`` bits), and so on. So any token
is found without decoding others.

Layout, little endian: magic ``DAC1``, u32 levels, u64 documents, u64 tokens; i64 document ids; u64 ends of documents;
then for each level u64 length, its bytes, its bitmap (bit i in byte i // 8, lowest first), its directory (u64 each).

The container is a Parquet table of segments, so a task that is run again replaces what it wrote. Each segment has its
partition, number and offset there; partitions are ranges of doc_id, and a manifest has the ids before each partition
(a row a partition, which bounds what the driver sees).
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, ship, slices
from .pieces import Memory, begins_with_space, binary_column, column_bytes, ragged

STRIDE = 512
SEGMENT = 1 << 20
#: Text of a part, so that its tasks stay short at any size of the corpus.
PART_BYTES = 256 << 20
_MAGIC = b"DAC1"


def pack(doc_ids: np.ndarray, ends: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment: ``ends`` are the cumulative token counts of its documents."""
    levels, rest = [], ids.astype(np.uint64)
    while True:
        low, rest = (rest & np.uint64(255)).astype(np.uint8), rest >> np.uint64(8)
        more = rest > 0
        bits = np.packbits(more, bitorder="little")
        marks = np.add.reduceat(more, np.arange(0, len(more), STRIDE)) if len(more) else np.zeros(0)
        before = np.concatenate([[0], np.cumsum(marks)])[: len(marks)].astype("<u8")
        levels.append(struct.pack("<Q", len(low)) + low.tobytes() + bits.tobytes() + before.tobytes())
        rest = rest[more]
        if not len(rest):
            break
    return _MAGIC + struct.pack("<IQQ", len(levels), len(doc_ids), len(ids)) + doc_ids.astype("<i8").tobytes() + ends.astype("<u8").tobytes() + b"".join(levels)


class Segment:
    """A packed segment, addressed in place."""

    def __init__(self, raw: bytes):
        if raw[:4] != _MAGIC:
            raise ValueError("not a token segment")
        n_levels, n_docs, self.n_tokens = struct.unpack_from("<IQQ", raw, 4)
        at = 24
        self.doc_ids = np.frombuffer(raw, "<i8", n_docs, at)
        self.ends = np.frombuffer(raw, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
        at += 16 * n_docs
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", raw, at)
            low = np.frombuffer(raw, np.uint8, n, at + 8)
            bits = np.frombuffer(raw, np.uint8, (n + 7) // 8, at + 8 + n)
            ranks = np.frombuffer(raw, "<u8", -(-n // STRIDE), at + 8 + n + len(bits))
            at += 8 + n + len(bits) + 8 * len(ranks)
            self.levels.append((low, bits, ranks))

    def token(self, i: int) -> int:
        """Token i of the segment, from one byte a level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = 0
        for k, (low, bits, ranks) in enumerate(self.levels):
            value |= int(low[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // STRIDE
            part = np.unpackbits(bits[block * STRIDE // 8 : (i >> 3) + 1], bitorder="little")
            i = int(ranks[block]) + int(part[: i - block * STRIDE].sum())
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out = np.zeros(self.n_tokens, dtype=np.uint64)
        at = np.arange(self.n_tokens)
        for k, (low, bits, _) in enumerate(self.levels):
            out[at] |= low.astype(np.uint64) << np.uint64(8 * k)
            at = at[np.unpackbits(bits, count=len(low), bitorder="little").astype(bool)]
        return out


REMEMBERED = 1_000_000
_LOADED: dict[str, tuple] = {}


def _tokenizer(path: str):
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        size = np.zeros(tokenizer.get_vocab_size(), dtype=np.int64)
        for token, i in tokenizer.get_vocab().items():
            size[i] = len(token)  # a byte-level token has a character for each byte
        _LOADED[path] = tokenizer, size, Memory(REMEMBERED)
    return _LOADED[path]


JOINT = 512


def _encode_new(tokenizer, size: np.ndarray):
    """The ids of parts. Those that begin with white space go to the library in one string, since a cut before it is safe.

    Such a part neither holds white space further on nor ends in it: then the next part's white space would be read
    with its own. Where a part ends in the joint string follows from the bytes that each token stands for.
    """

    def run(new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        joint = begins_with_space(*column_bytes(new))
        flat, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        data, bounds = column_bytes(new.filter(pa.array(joint)))
        for a in range(0, len(bounds) - 1, 64 * JOINT):
            groups = [bounds[b : b + JOINT + 1] for b in range(a, min(a + 64 * JOINT, len(bounds) - 1), JOINT)]
            for at, e in zip(groups, tokenizer.encode_batch([data[at[0] : at[-1]].tobytes().decode("utf-8") for at in groups], add_special_tokens=False), strict=True):
                flat.append(np.array(e.ids, dtype=np.uint32))
                ends = np.searchsorted(np.cumsum(size[flat[-1]]), at[1:] - at[0]) + 1
                sizes.append(np.diff(ends, prepend=0))
        alone = new.filter(pa.array(~joint)).cast(pa.string())
        for a in range(0, len(alone), 4096):
            found = [e.ids for e in tokenizer.encode_batch(alone.slice(a, 4096).to_pylist(), add_special_tokens=False)]
            flat += [np.array(ids, dtype=np.uint32) for ids in found]
            sizes.append(np.array([len(ids) for ids in found], dtype=np.int64))
        n = np.empty(len(new), np.int64)
        order = np.concatenate([np.nonzero(joint)[0], np.nonzero(~joint)[0]])
        n[order] = np.concatenate(sizes)
        start = np.empty(len(new), np.int64)
        start[order] = np.cumsum(n[order]) - n[order]
        return ragged(np.concatenate(flat), start, n), n

    return run


def encode_column(col: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts of a column (null: none) by the tokenizers library, without added special tokens, and the number of ids of each."""
    tokenizer, size, memory = _tokenizer(path)
    return memory.encode(col, _encode_new(tokenizer, size))


def encode_texts(texts: list[str | None], path: str) -> list[bytes]:
    """Little-endian unsigned 32-bit ids of each text."""
    return binary_column(*encode_column(pa.array(texts, pa.string()), path)).to_pylist()


def _writer(path: str, end: int):
    def run(batches):
        from pyspark import TaskContext

        part, number, before = TaskContext.get().partitionId(), 0, 0
        docs, counts, parts, total = [], [], [], 0

        def flush():
            ids = np.concatenate(parts)
            raw = pack(np.concatenate(docs), np.cumsum(np.concatenate(counts)), ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([raw], pa.binary())], ["part", "number", "before", "n_tokens", "segment"])

        for batch in batches:
            for piece in slices(batch, 4096, 8 << 20):
                ids, n = encode_column(piece.column("text"), path)
                docs.append(piece.column("doc_id").to_numpy())
                parts.append(np.insert(ids, np.cumsum(n), np.uint32(end)))
                counts.append(n + 1)
                total += len(parts[-1])
                if total >= SEGMENT:
                    yield flush()
                    number, before, docs, counts, parts, total = number + 1, before + total, [], [], [], 0
            give_back()
        if docs:
            yield flush()

    return run


def write(documents: DataFrame, folder: str, path: str, end: int = 2) -> None:
    """Encode documents (doc_id, text), close each with id ``end`` and write segments in ascending doc_id order.

    A null text has only the closing id. A row with a null doc_id cannot be addressed and is an error. Rows that repeat
    a doc_id stand next to each other, in the order of a hash of their texts. Parts hold about ``PART_BYTES`` of text. Other columns are ignored; an empty table writes no segment.
    """
    spark = documents.sparkSession
    ship(spark)
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.raise_error(F.lit("a document without doc_id has no address")).cast("long")).alias("doc_id"), "text")
    rows = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    done = rows.mapInArrow(_writer(path, end), "part int, number int, before long, n_tokens long, segment binary")
    done.write.option("compression", "zstd").parquet(folder)


def _reader(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            s, at = Segment(batch.column("segment")[k].as_py()), batch.column("start")[k].as_py()
            ids = s.all().astype("<u4")
            begins = np.concatenate([[0], s.ends[:-1]])
            for a in range(0, len(s.ends), 4096):
                lo, hi = begins[a : a + 4096], s.ends[a : a + 4096]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.doc_ids[a : a + 4096]), pa.array(lo + at), pa.array(hi - lo), pa.array([ids[x:y].tobytes() for x, y in zip(lo, hi, strict=True)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document in the files."""
    ship(spark)
    files = spark.read.schema("part int, number int, before long, n_tokens long, segment binary").parquet(folder)
    base, total = [], 0
    for part, n in sorted(files.groupBy("part").agg(F.sum("n_tokens")).collect()):
        base.append((part, total))
        total += n
    manifest = spark.createDataFrame(base, "part int, base long")
    placed = files.join(F.broadcast(manifest), "part").select((F.col("before") + F.col("base")).alias("start"), "segment")
    return placed.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids binary")
