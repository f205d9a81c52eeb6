"""Pack documents' token ids into sequences of fixed length: bounded-space online packing.

Each partition streams its documents and keeps a fixed number of open windows. Whole windows of a document go out at
once; the rest of it goes to the window that it fills best. When none fits and no more may be opened, the
fullest goes out, topped up by a cut of the piece when the gap is worth one. What is open at the end of a partition
is merged in rounds, a fixed number of partitions to a task, until one group is left.
"""
import re
import struct
import zlib

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loadtide.llm.common import BATCH_ROWS, cut_lineage, held, ship, to_arrow, whole_text

LENGTH = 1024
#: Open windows of a partition, the smallest gap that is topped up by a cut, and partitions merged by one task.
OPEN, LEAST_CUT, FAN_IN = 32, 8, 16
#: Id that ends a document.
END = 0
#: Units kept in a worker's memory.
UNITS = 150_000

#: Characters whose class (letter, digit, other) no Unicode version moves; texts with others take the library's way.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ɏΑ-Ρα-ωЀ-ҁҊ-ӿぁ-ゖァ-ヺ一-龥‐-‧]*")
LOOSE = re.compile(r"\s |  | \s| $")


class Units(dict):
    """unit -> its ids as bytes. A unit is what lies between single spaces, with the space before it."""

    def __init__(self, encode, prefix):
        self.encode, self.prefix = encode, prefix

    def __missing__(self, unit):
        ids = self.encode(self.prefix + unit)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(unit) < 64:
            if len(self) >= UNITS:
                self.clear()
            self[unit] = packed
        return packed


class ByteEncoder:
    """Token ids, as little-endian 32-bit bytes, of the byte-level tokenizer at ``path``.

    A single space between two other characters always starts a pre-token, so the units between such spaces
    are encoded on their own and remembered. ``ranks`` is the same vocabulary for the faster encoder of units.
    """

    def __init__(self, path, ranks, pattern, special="<|endoftext|>"):
        import base64

        import tiktoken
        from tokenizers import Tokenizer
        self.library, self.special = Tokenizer.from_file(path), special
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.first, self.rest = Units(self.plain, ""), Units(self.plain, " ")

    def __call__(self, text):
        if self.special in text or not PLAIN.fullmatch(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        if LOOSE.search(text):
            ids = self.plain(text)
            return struct.pack(f"<{len(ids)}I", *ids)
        head, *units = text.split(" ")
        return self.first[head] + b"".join(map(self.rest.__getitem__, units))


class Packer:
    """Open windows of one partition. ``out`` gets (sequence number, [(piece, offset)], is_open)."""

    def __init__(self, windows=OPEN, length=LENGTH):
        self.windows, self.length, self.open, self.number, self.out = windows, length, [], 0, []

    def emit(self, pieces, is_open=False):
        self.out.append((self.number, pieces, is_open))
        self.number += 1

    def put(self, piece, size, cut=None):
        """``cut(piece, n)`` splits off the first n tokens; without it pieces stay whole."""
        while size >= self.length and cut:
            first, piece = cut(piece, self.length)
            self.emit([(first, 0)])
            size -= self.length
        while size:
            fits = [w for w in self.open if self.length - w[0] >= size]
            if fits:
                w = max(fits, key=lambda w: w[0])
            elif len(self.open) < self.windows:
                w = [0, []]
                self.open.append(w)
            else:
                w = max(self.open, key=lambda w: w[0])
                gap = self.length - w[0]
                if cut and gap >= LEAST_CUT:
                    first, piece = cut(piece, gap)
                    w[1].append((first, w[0]))
                    size -= gap
                self.open.remove(w)
                self.emit(w[1])
                continue
            w[1].append((piece, w[0]))
            w[0] += size
            if w[0] == self.length:
                self.open.remove(w)
                self.emit(w[1])
            return

    def close(self, is_open):
        for w in sorted(self.open, key=lambda w: -w[0]):
            self.emit(w[1], is_open)
        self.open = []


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long, is_open boolean"


def _rows(packer, part, level):
    """Columns of what has gone out. Sequence ids: level, partition, number."""
    rows = [(*piece, (level << 56) | (part << 24) | number, offset, part, is_open)
            for number, pieces, is_open in packer.out for piece, offset in pieces]
    packer.out = []
    return list(zip(*rows)) if rows else None


def pack_partitions(docs: DataFrame, encoder, length: int = LENGTH) -> DataFrame:
    """Pieces of closed and open windows, partition by partition, without a shuffle. ``encoder()`` makes text -> id bytes."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    kinds = spark.createDataFrame([], SCHEMA).schema
    arrow = to_arrow(kinds)

    def run(batches):
        encode, packer, part = encoder(), Packer(length=length), TaskContext.get().partitionId()

        def flushed():
            cols = _rows(packer, part, 0)
            if cols:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + struct.pack("<I", END)
                total = len(ids) // 4

                def piece(start, size):
                    return doc, start, size, zlib.crc32(ids[4 * start:4 * (start + size)]), total

                def cut(p, n):
                    return piece(p[1], n), piece(p[1] + n, p[2] - n)

                packer.put(piece(0, total), total, cut)
            yield from flushed()
        packer.close(True)
        yield from flushed()

    return docs.select(F.col("doc_id").cast("long"), whole_text().alias("text")).mapInArrow(run, kinds)


def pack(docs: DataFrame, encoder, length: int = LENGTH) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece of a document.

    ``docs`` needs doc_id and text; other columns are ignored. Every row is a document of its own, also one that
    repeats another or has no doc_id. A null or empty text is the end id alone. No rows give no pieces.
    """
    pieces = cut_lineage(pack_partitions(docs, encoder, length), "pieces")
    done, level = [pieces.filter("NOT is_open")], 0
    rest = pieces.filter("is_open")
    parts = (rest.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        level += 1
        parts = -(-parts // FAN_IN)
        last, at = parts == 1, level

        def merge(key, pdf):
            packer = Packer(length=length)
            order = pdf.sort_values(["length", "doc_id", "start", "sequence_id"], ascending=[False, True, True, True])
            cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            order["doc_id"] = order["doc_id"].astype("Int64")
            for p in order[cols].itertuples(index=False, name=None):
                packer.put(p, p[2])
            packer.close(not last)
            got = _rows(packer, int(key[0]), at)
            return pd.DataFrame(dict(zip(names, got)))

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        merged = rest.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInPandas(merge, SCHEMA)
        merged = cut_lineage(merged, "merged")
        done.append(merged.filter("NOT is_open"))
        rest = merged.filter("is_open")
    done.append(rest)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("part", "is_open")


def public_encoder():
    """Makes the encoder of the public byte-level vocabulary; its files are read where it runs."""
    import public_tokenizers as files
    path, ranks, pattern = files.path("byte_bpe_50k.json"), files.path("byte_bpe_50k.tiktoken"), files.PATTERN
    return lambda: held(path, lambda: ByteEncoder(path, ranks, pattern))


ship(__name__)
