"""Packing (operator 6): concatenate and cut.

All documents' ids, each with an end id, form one long run that is cut into windows of
``size`` ids; only the last window may be short. Two passes give every document its place
in the run without a shuffle:

1. each task encodes its documents, numbers their ids from 0 within its partition and
   writes them; the partitions' totals (one row per partition) summed in order give each
   partition's offset;
2. each task reads its documents back, adds the offset and cuts at the window boundaries.
   A document that crosses a boundary leaves one record on either side.

Defined cases: a null text has only the end id; repeated rows are packed each time; a null
``id_col`` stays null; extra columns are not read; an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablekit.llm import bpe
from tablekit.llm.store import written

PIECES_AT_ONCE = 2048


def tokenised(df: DataFrame, path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """Pass 1: part (the writing partition), before (ids before it there), n, ids."""
    import pyarrow as pa

    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        m, part, before = bpe.model(path), TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, bpe.ROWS_AT_ONCE):
                b = whole.slice(at, bpe.ROWS_AT_ONCE)
                texts = [t or "" for t in b.column(1).to_pylist()]
                packed = [x + end for x in m.encode_batch(texts, library=True)]
                sizes = [len(x) // 4 for x in packed]
                starts = []
                for n in sizes:
                    starts.append(before)
                    before += n
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([part] * len(sizes), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], ["id", "part", "before", "n", "ids"])

    return src.mapInArrow(run, f"id {kind}, part int, before bigint, n bigint, ids binary")


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end_id: int = 1) -> DataFrame:
    """One row per piece: id_col, start (ids of its document before it), sequence_id, offset
    (its place there), doc_tokens, ids (packed little-endian unsigned 32-bit integers)."""
    import pyarrow as pa

    kind = df.schema[id_col].dataType.simpleString()
    tokens = written(tokenised(df, path, id_col, text_col, end_id), "pack-tokens")
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # one row per partition of the input: small enough for one task and for a broadcast
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("offset"))
    placed = tokens.join(F.broadcast(offsets), "part").select("id", (F.col("offset") + F.col("before")).alias("at"), "n", "ids")

    def cut(batches):
        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names)
            for c in rows:
                c.clear()
            return out

        rows, names = [[], [], [], [], [], []], ["id", "start", "sequence_id", "offset", "doc_tokens", "ids"]
        for b in batches:
            types = [b.schema.field(0).type, *[pa.int64()] * 4, pa.binary()]
            for i in range(b.num_rows):
                key, at, n, ids = (b.column(k)[i].as_py() for k in range(4))
                start = 0
                while start < n:
                    seq, off = divmod(at + start, size)
                    length = min(size - off, n - start)
                    for c, v in zip(rows, (key, start, seq, off, n, ids[4 * start : 4 * (start + length)])):
                        c.append(v)
                    start += length
                    if len(rows[0]) >= PIECES_AT_ONCE:
                        yield flush()
            if rows[0]:
                yield flush()

    pieces = placed.mapInArrow(cut, f"id {kind}, start bigint, sequence_id bigint, offset bigint, doc_tokens bigint, ids binary")
    return pieces.withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame) -> DataFrame:
    """The training sequences: sequence_id, ids (packed). A sequence has at most its size in
    pieces, so a group is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"))
