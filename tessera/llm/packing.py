"""Vector bin packing of tokenised examples into training sequences.

Each example is a vector (tokens, one segment, loss-bearing tokens) and each sequence a bin with a
limit on each of the three. The dot-product heuristic fills one bin at a time: of the examples
that still fit, it places the one whose vector, in shares of the limits, has the largest dot product
with what is left of the bin. Long examples first give whole sequences of their own.

Every task packs its own rows block by block, carrying the open bin along, so nothing is shuffled,
memory is bounded by a block and the rows of a hot key are spread as the scan spreads them. A task
that is run again on its rows gives the same sequences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_batches
from .word_bpe import word_bpe


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


class Packer:
    """Packs blocks of examples; ``emit`` gets (row, start, length, sequence, offset) for each piece."""

    def __init__(self, limits: Limits, cut: bool, emit):
        self.limits, self.cut, self.emit = limits, cut, emit
        self.sequence = 0
        self.clear()

    def clear(self) -> None:
        self.bin, self.left = [], np.array([self.limits.tokens, self.limits.segments, self.limits.loss], dtype=np.int64)

    def close(self) -> None:
        """Write the open bin out. A short bin of cuttable examples becomes sequences of a power of two
        tokens, which need no padding."""
        total = sum(n for *_, n in self.bin)
        sizes = [total]
        if self.cut and 0 < total < self.limits.tokens:
            sizes = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
        pieces, at = iter(self.bin), (None, 0, 0)
        for size in sizes if self.bin else []:
            offset = 0
            while offset < size:
                row, start, n = at if at[2] else next(pieces)
                take = min(n, size - offset)
                self.emit(row, start, take, self.sequence, offset)
                offset, at = offset + take, (row, start + take, n - take)
            self.sequence += 1
        self.clear()

    def place(self, row, start: int, n: int, loss: int) -> None:
        self.bin.append((row, start, n))
        self.left -= (n, 1, loss)
        if self.left[0] <= 0 or self.left[1] <= 0:
            self.close()

    def block(self, rows: list, tokens: np.ndarray, loss: np.ndarray) -> None:
        """Place all examples of a block. ``loss``: the last so many tokens of an example bear loss."""
        lim = self.limits
        begin, left, quiet = np.zeros(len(rows), np.int64), tokens.astype(np.int64), tokens - loss

        def bears(k: int, n: int) -> int:  # loss-bearing ones of the next n tokens of example k
            return int(max(0, begin[k] + n - max(begin[k], quiet[k])))

        def longest(k: int, room: np.ndarray) -> int:  # most next tokens that fit in what is left
            return int(min(left[k], room[0], max(0, quiet[k] - begin[k]) + room[2]))

        whole = np.array([lim.tokens, lim.segments, lim.loss], dtype=np.int64)
        for k in np.flatnonzero((left > lim.tokens) | (loss > lim.loss)):
            held, self.bin, room = (self.bin, self.left), [], whole
            while left[k] > (n := longest(k, whole)) or n == lim.tokens:
                self.bin, self.left = [(rows[k], int(begin[k]), n)], room - n
                self.close()
                begin[k] += n
                left[k] -= n
            self.bin, self.left = held
        alive = left > 0
        share = 1 / whole
        while alive.any():
            bear = np.maximum(0, begin + left - np.maximum(begin, quiet))
            fits = alive & (left <= self.left[0]) & (bear <= self.left[2])
            if fits.any():
                room = self.left * share
                gain = np.where(fits, left * (room[0] * share[0]) + bear * (room[2] * share[2]) + share[1] * room[1], -1)
                k = int(gain.argmax())
                alive[k] = False
                self.place(rows[k], int(begin[k]), int(left[k]), int(bear[k]))
                continue
            k = int(np.where(alive, left, -1).argmax())
            n = longest(k, self.left) if self.cut else 0
            if n <= 0:
                self.close()
                continue
            used = bears(k, n)
            self.place(rows[k], int(begin[k]), n, used)
            begin[k] += n
            left[k] -= n


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2,
         limits: Limits = Limits(), cut: bool = True, loss_col: str | None = None, block_rows: int = 512) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    loss_tokens, sequence_id, offset. ``ids`` of a text come from ``word_bpe``, then ``end_id``.

    ``loss_col``: how many of an example's last tokens bear loss (null: none; absent: all).
    ``cut`` lets examples be cut anywhere, which leaves no padding; without it only examples beyond
    a limit are cut. A null text counts as empty; an empty text still gives its ``end_id``, and no
    piece without one. Repeated rows, also of one id, are packed one by one; other columns are not read. An empty
    table gives no rows. ``sequence_id`` is the partition's number times 2**33 plus the sequence's
    number there.
    """
    loss = F.col(loss_col).cast("long") if loss_col else F.lit(None).cast("long")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), loss.alias("loss"))
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(n, T.LongType()) for n in ("start", "length")),
                           T.StructField("ids", T.BinaryType()),
                           *(T.StructField(n, T.LongType()) for n in ("doc_tokens", "loss_tokens", "sequence_id", "offset"))])
    names = [f.name for f in schema.fields]
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    all_bear = loss_col is None

    def run(batches):
        encoder = word_bpe(vocabulary)
        first = TaskContext.get().partitionId() << 33
        out: list[tuple] = []

        def emit(row, start, n, sequence, offset):
            key, ids, total, bearing = row
            inside = max(0, start + n - max(start, total - bearing))
            out.append((key, start, n, ids[4 * start: 4 * (start + n)], total, inside, first + sequence, offset))

        def flush():
            cols = list(zip(*out))
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)
            out.clear()
            return batch

        packer, kinds = Packer(limits, cut, emit), None
        for batch in byte_batches(batches, 4 << 20):
            kinds = kinds or [batch.schema.field("id").type, pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 4]
            keys, texts, losses = (batch.column(c).to_pylist() for c in ("id", "text", "loss"))
            for at in range(0, len(keys), block_rows):
                rows = []
                for key, text, bearing in zip(keys[at: at + block_rows], texts[at: at + block_rows], losses[at: at + block_rows]):
                    ids = encoder.ids(text) + tail
                    n = len(ids) // 4
                    rows.append((key, ids, n, n if all_bear else min(n, max(0, bearing or 0))))
                packer.block(rows, np.array([r[2] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64))
                if out:
                    yield flush()
        packer.close()
        if out:
            yield flush()

    return src.mapInArrow(run, schema)
