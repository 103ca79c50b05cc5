"""Token ids in files: frequency-ranked, byte-aligned, with separate control bytes.

Each id is replaced by its rank among all ids of the corpus, the most frequent
first, and a rank takes 1 to 4 bytes, as few as it needs. Control bytes hold the
lengths of four ranks each, two bits a rank; they stand apart from
the data bytes, so that a table look-up of whole control bytes gives all lengths, and
a cumulative sum all places.

File format: two Parquet tables below one folder. ranks: rank, id, n. blocks: part
and block (their order is that of the ids), doc_id and n_tokens (lists, a
document each), control and data (bytes). Spark's committer writes them, so a lost
executor leaves no half file, and the folder may be in any store that Spark reaches.

Defined cases: a null text has the end id only; a null doc_id comes before all
others; documents that share an id are ordered by a hash of their ids; an empty
corpus gives empty tables. Other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradewind.llm.stored import stored
from tradewind.llm.text import LOWER, SLICE_BYTES, slices, spread_hashes, texts, words

#: Id appended to each document.
END = 2
#: Ids of a block, or one document.
BLOCK = 1 << 18
#: Chunks whose ids a process keeps.
REMEMBERED = 700_000

# Chunks that the tokenizer sees by themselves: bytes are white space (0), small
# letters and digits (1), the apostrophe and bytes beyond ASCII (2), or marks (3).
# A chunk ends where white space begins and between 1 and 3, where the tokenizer
# ends a word as well, whatever stands before and after.
_KIND = np.full(256, 3, np.uint8)
_KIND[[32, *range(9, 14)]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = 1
_KIND[39] = 2
_KIND[128:] = 2
#: A word that no chunk is: it keeps chunks apart when many are encoded at once.
_APART = "\x01"


class Encoder:
    """The tokenizers library on different chunks only: a chunk is encoded when a
    process meets it first, and again only after REMEMBERED others."""

    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a process for each core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        (self.apart,) = self.tokenizer.encode(_APART, add_special_tokens=False).ids
        self._forget()

    def _forget(self) -> None:
        # Hashes of chunks, ascending, and where their ids are.
        self.known = np.zeros(0, np.uint64)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self, hash_: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Encode chunks that aren't known; hash_: ascending."""
        flat, length = self.chunks(data, begin, end)
        at = np.searchsorted(self.known, hash_)
        self.start = np.insert(self.start, at, len(self.flat) + np.cumsum(length) - length)
        self.length = np.insert(self.length, at, length)
        self.known = np.insert(self.known, at, hash_)
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])

    def direct(self, all_: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(all_, add_special_tokens=False)]

    def chunks(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks in a row, and how many each has."""
        raw = data.tobytes()
        each = [raw[a:b].decode() for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
        mine = np.array([_APART in c for c in each], bool) if b"\x01" in raw else np.zeros(len(each), bool)
        flat = np.zeros(0, np.int64)
        plain = [c for c, m in zip(each, mine, strict=True) if not m]
        if plain:
            parts = []
            for at in range(0, len(plain), 5000):  # what the library returns is large: a little at a time
                joined = [f" {_APART} ".join(plain[i : i + 250]) + f" {_APART}" for i in range(at, min(at + 5000, len(plain)), 250)]
                parts += [np.array(ids, np.int64) for ids in self.direct(joined)]
            flat = np.concatenate(parts)
        ends = np.flatnonzero(flat == self.apart)
        length = np.zeros(len(each), np.int64)
        length[~mine] = np.diff(np.append(-1, ends)) - 1
        flat = flat[flat != self.apart]
        if mine.any():
            odd = self.direct([c for c, m in zip(each, mine, strict=True) if m])
            out, at = [], 0
            for c, m in enumerate(mine.tolist()):
                if m:
                    out.append(np.array(odd.pop(0), np.int64))
                    length[c] = len(out[-1])
                else:
                    out.append(flat[at : at + length[c]])
                    at += length[c]
            flat = np.concatenate(out)
        return flat, length

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row with END after each, and how many each has."""
        t = texts(column)
        n = len(column)
        kind = _KIND[t.data]
        inside = kind > 0
        w = words(t, _KIND > 0)
        # Cut words where letters meet marks.
        turn = np.flatnonzero((kind[1:] + kind[:-1] == 4) & (kind[1:] != kind[:-1]) & inside[1:] & inside[:-1]) + 1
        within = np.searchsorted(w.start, turn, side="right") - 1
        turn, within = turn[turn > w.start[within]], within[turn > w.start[within]]
        begin, end = np.sort(np.append(w.start, turn)), np.sort(np.append(w.end, turn))
        owner = np.searchsorted(t.offsets, begin, side="right") - 1
        lower = LOWER[t.data]
        chunk = type(w)(begin, end, owner)
        hash_, one, back = np.unique(spread_hashes(lower, chunk, fold=False), return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self.known, hash_)
        new = self.known[np.minimum(at, len(self.known) - 1)] != hash_ if len(self.known) else np.ones(len(hash_), bool)
        if new.any():
            self._learn(hash_[new], lower, begin[one[new]], end[one[new]])
            at = np.searchsorted(self.known, hash_)
        start, per = self.start[at], self.length[at][back]
        # Texts with what may be an added token are encoded as they are.
        odd = [i for i in range(n) if b"<|" in t.data[t.offsets[i] : t.offsets[i + 1]].tobytes()] if b"<|" in t.data.tobytes() else []
        per[np.isin(owner, odd)] = 0
        cut = np.cumsum(per) - per
        ids = self.flat[np.repeat(start[back] - cut, per) + np.arange(per.sum())]
        size = np.bincount(owner, per, minlength=n).astype(np.int64)
        parts, ends = [], np.cumsum(size)
        if odd:
            extra = dict(zip(odd, self.direct([bytes(t.data[t.offsets[i] : t.offsets[i + 1]]).decode() for i in odd]), strict=True))
            for i in range(n):
                parts.append(np.array(extra[i], np.int64) if i in extra else ids[ends[i] - size[i] : ends[i]])
                size[i] = len(parts[-1])
            ids = np.concatenate(parts)
            ends = np.cumsum(size)
        return np.insert(ids, ends, END), size + 1


def packed(rank: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks."""
    length = 1 + (rank >= 1 << 8).astype(np.uint8) + (rank >= 1 << 16) + (rank >= 1 << 24)
    raw = rank.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) < length[:, None]]
    code = np.zeros(-(-len(rank) // 4) * 4, np.uint8)
    code[: len(rank)] = length - 1
    code = code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
    return np.bitwise_or.reduce(code, axis=1).astype(np.uint8).tobytes(), data.tobytes()


_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def unpacked(control: bytes, data: bytes, n: int) -> np.ndarray:
    """n ranks from control and data bytes, by table look-up."""
    length = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    at = np.cumsum(length) - length
    raw = np.append(np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)).astype(np.uint32)
    rank = raw[at]
    for byte in (1, 2, 3):
        more = length > byte
        rank[more] |= raw[at[more] + byte] << np.uint32(8 * byte)
    return rank


_loaded: dict[int, Encoder] = {}


def _encoder(definition: str) -> Encoder:
    """Made once per process."""
    key = hash(definition)
    if key not in _loaded:
        _loaded[key] = Encoder(definition)
    return _loaded[key]


def _encoded(docs: DataFrame, path: str) -> DataFrame:
    with open(path, encoding="utf-8") as source:
        definition = source.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(definition)
        for piece in slices(batches, "text", SLICE_BYTES // 2):
            ids, size = encoder.encode(piece.column("text"))
            data = ids.astype("<u2" if int(ids.max(initial=0)) < 1 << 16 else "<u4")
            cut = np.append(0, np.cumsum(size) * data.itemsize).astype(np.int64)
            column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), piece.num_rows, [None, pa.py_buffer(cut), pa.py_buffer(data)])
            yield pa.record_batch({"doc_id": piece.column("doc_id"), "n_tokens": size, "ids": column.cast(pa.binary())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def _ids(row: bytes, n: int) -> np.ndarray:
    return np.frombuffer(row, "<u2" if len(row) == 2 * n else "<u4")


def write(docs: DataFrame, tokenizer: str, folder: str) -> None:
    """Encode every text with a file of the tokenizers library and write the file format below folder."""
    # Ordered before they are encoded: Spark samples the ids for that, not the tokens.
    rows = docs.select(F.col("doc_id").cast("long"), "text").orderBy("doc_id", F.xxhash64("text"))
    encoded = stored(_encoded(rows, tokenizer).withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for row, n in zip(batch.column("ids"), batch.column("n_tokens").to_pylist(), strict=True):
                ids = _ids(row.as_buffer(), n)
                found = np.bincount(ids, minlength=len(total))
                found[: len(total)] += total
                total = found
        seen = np.flatnonzero(total)
        yield pa.record_batch({"id": seen, "n": total[seen].astype(np.int64)})

    counted = encoded.select("ids", "n_tokens").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # As many rows as the vocabulary has.
    order = counted.orderBy(F.desc("n"), "id").toArrow()
    id_ = np.asarray(order["id"], np.int64)
    rank = np.zeros(int(id_.max(initial=0)) + 1, np.int64)
    rank[id_] = np.arange(len(id_))
    spark = docs.sparkSession
    table = pa.table({"rank": np.arange(len(id_)), "id": id_, "n": order["n"]})
    spark.createDataFrame(table).coalesce(1).write.parquet(f"{folder}/ranks")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, part, block, last = 0, None, 0, -1

        def flush() -> pa.RecordBatch:
            control, data = packed(rank[np.concatenate([_ids(ids, n) for _, n, ids in held])])
            return pa.record_batch(
                {
                    "part": pa.array([part], pa.int32()),
                    "block": pa.array([block], pa.int64()),
                    "doc_id": pa.array([[d for d, _, _ in held]], pa.list_(pa.int64())),
                    "n_tokens": pa.array([[n for _, n, _ in held]], pa.list_(pa.int64())),
                    "control": pa.array([control], pa.binary()),
                    "data": pa.array([data], pa.binary()),
                }
            )

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("part", "place", "doc_id", "n_tokens", "ids"))
            for p, place, doc, n, ids in zip(*columns, strict=True):
                if held and (size + n > BLOCK or place != last + 1):
                    yield flush()
                    held.clear()
                    size = 0
                if not held:
                    part, block = p, place
                held.append((doc, n, ids))
                size, last = size + n, place
        if held:
            yield flush()

    # A task may read pieces of several files; a block ends where the next row isn't the next document.
    encoded.select("part", "place", "doc_id", "n_tokens", "ids").mapInArrow(
        pack, "part int, block long, doc_id array<bigint>, n_tokens array<bigint>, control binary, data binary"
    ).write.option("compression", "zstd").parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids
    (little-endian unsigned 32-bit integers) of each document in the files."""
    order = spark.read.parquet(f"{folder}/ranks").orderBy("rank").toArrow()  # as many rows as the vocabulary has
    id_ = np.asarray(order["id"], np.uint32)
    blocks = spark.read.parquet(f"{folder}/blocks")
    size = blocks.select("part", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b).alias("size"))
    size = size.withColumn("within", F.sum("size").over(Window.partitionBy("part").orderBy("block")) - F.col("size"))
    # One row per part; there are as many parts as the writer had partitions.
    parts = size.groupBy("part").agg(F.sum("size").alias("whole"))
    parts = parts.withColumn("base", F.sum("whole").over(Window.orderBy("part")) - F.col("whole"))
    placed = size.join(parts, "part").select("block", (F.col("base") + F.col("within")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                doc, n, control, data, start = (batch.column(c)[row] for c in ("doc_id", "n_tokens", "control", "data", "start"))
                n = np.asarray(n.values, np.int64)
                ids = id_[unpacked(control.as_py(), data.as_py(), int(n.sum()))].astype("<u4").tobytes()
                cut = np.append(0, np.cumsum(n))
                yield pa.record_batch(
                    {
                        "doc_id": doc.values,
                        "start": cut[:-1] + start.as_py(),
                        "n_tokens": n,
                        "ids": pa.array([ids[4 * a : 4 * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary()),
                    }
                )

    return (
        blocks.select("block", "doc_id", "n_tokens", "control", "data")
        .join(placed, "block")
        .select("doc_id", "n_tokens", "control", "data", "start")
        .mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
    )


def checksums(found: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of read()'s rows."""
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
