"""Importance resampling towards a target distribution (operator 12) on hashed word n-grams.

A feature is a run of 1 to ``max_n`` consecutive words joined by one space; its bucket is the
CRC-32 of its bytes modulo ``buckets``. Words are found with an Aho-Corasick automaton whose
dictionary is the distinct words of a block of text, each with a blank on both sides, so that
a match is a whole word, and each with the payload (CRC-32, length). One scan of a text
emits its words' payloads in order; the checksum of a longer run is composed from those of
its words, as CRC(ab) = shift(CRC(a), |b|) xor CRC(b), without touching the bytes again.

1. One scan writes every document's buckets; long texts are scanned in segments cut at
   blanks, so a dictionary never holds more than a block's words (``BLOCK``).
2. Counts of source and target by bucket are added in the tasks; ``buckets`` rows at most
   reach the driver, which turns them into gains (floored log ratios with one added).
3. A document's weight is the sum of its features' gains. Gumbel noise from a hash of the id
   makes the highest scores a draw without replacement; ranks come from a range-partitioned
   order with the partitions' offsets, so no task holds more than its share.

Defined cases: a null or wordless text has no features and weight 0; a null id is hashed as
an empty one and loses ties; equal scores go to the smaller id, rows equal in both to the
smaller weight; repeated rows count one by one; an empty target only has the one added;
extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablekit.functions.joins import dense_index
from tablekit.llm.store import written

#: Bytes of text whose words make one dictionary.
BLOCK = 1 << 22


def _plain_bytes() -> bytes:
    """Per byte: A-Z in lower case, letters, digits and bytes over 127 as they are, else a blank."""
    out = bytearray(range(256))
    for i in range(128):
        c = chr(i)
        out[i] = ord(c.lower()) if c.isalnum() else 32
    return bytes(out)


_PLAIN = _plain_bytes()


# -- checksums of joined runs ----------------------------------------------------------

def _shift_tables():
    """For each power of two of zero bytes, what they do to a CRC-32, by its four bytes."""
    import numpy as np

    poly = np.uint32(0xEDB88320)
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = (one >> np.uint32(1)) ^ (poly * (one & np.uint32(1)))
    # one zero byte: crc -> one[crc & 255] ^ crc >> 8, which is linear in the bits
    step = lambda x: one[x & np.uint32(255)] ^ (x >> np.uint32(8))
    tables = [np.stack([step(np.arange(256, dtype=np.uint32) << np.uint32(8 * b)) for b in range(4)])]
    while len(tables) < 32:
        t = tables[-1]
        tables.append(np.stack([_apply(t, t[b]) for b in range(4)]))
    return tables


def _apply(table, x):
    import numpy as np

    out = table[0][x & np.uint32(255)]
    for b in range(1, 4):
        out = out ^ table[b][(x >> np.uint32(8 * b)) & np.uint32(255)]
    return out


_SHIFTS: list = []


def shifted(crc, lengths):
    """CRC-32 values as if so many bytes followed, before those bytes are added."""
    import numpy as np

    if not _SHIFTS:
        _SHIFTS.extend(_shift_tables())
    out, lengths = np.array(crc, np.uint32), np.asarray(lengths, np.int64)
    bit = 0
    while (lengths >> bit).any():
        at = np.flatnonzero(lengths >> bit & 1)
        out[at] = _apply(_SHIFTS[bit], out[at])
        bit += 1
    return out


def run_crcs(crc, length, last, n: int):
    """CRC-32 of all runs of exactly n words (joined by a blank) and the text each is in.
    ``last``: per word, the index of the last word of its text."""
    import zlib

    import numpy as np

    blank = np.uint32(zlib.crc32(b" "))
    start = np.flatnonzero(np.arange(len(crc)) + n - 1 <= last)
    out = crc[start]
    for k in range(1, n):
        out = shifted(out, np.ones(len(start), np.int64)) ^ blank
        out = shifted(out, length[start + k]) ^ crc[start + k]
    return out, start


# -- the scan --------------------------------------------------------------------------

def _segments(text: bytes):
    """A plain text in pieces of about ``BLOCK`` bytes, cut at blanks."""
    at = 0
    while at < len(text):
        end = text.find(b" ", at + BLOCK)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _payloads(pieces: list[bytes]):
    """For every piece the payloads (CRC-32, length) of its words in order, through one
    automaton over the distinct words of all pieces."""
    import zlib

    import ahocorasick
    import numpy as np

    pieces = [b" ".join(p.split()) for p in pieces]
    distinct = list(set(b" ".join(pieces).split()))
    if not distinct:
        return [(np.zeros(0, np.uint32), np.zeros(0, np.int64)) for _ in pieces]
    machine = ahocorasick.Automaton()
    for i, w in enumerate(distinct):
        machine.add_word(f" {w.decode('latin-1')} ", i)
    machine.make_automaton()
    crc = np.fromiter(map(zlib.crc32, distinct), np.uint32, len(distinct))
    length = np.fromiter(map(len, distinct), np.int64, len(distinct))
    out = []
    for p in pieces:
        got = np.fromiter((i for _, i in machine.iter(f" {p.decode('latin-1')} ")), np.int64) if p else np.zeros(0, np.int64)
        out.append((crc[got], length[got]))
    return out


def _blocks(batches):
    """Rows (id, plain bytes) in blocks of about ``BLOCK`` bytes; a longer text alone."""
    block, size = [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1)):
            text = (t.as_py() or b"").translate(_PLAIN)
            if block and size + len(text) > BLOCK:
                yield block
                block, size = [], 0
            block.append((i, text))
            size += len(text)
    if block:
        yield block


def features(df: DataFrame, id_col: str, text_col: str, max_n: int, buckets: int) -> DataFrame:
    """(id, n_words, found array<int>): the bucket of every feature of every text."""
    import pyarrow as pa

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    kind, id_type = rows.schema["id"].dataType.simpleString(), None

    def run(batches):
        import numpy as np

        def first_type(source):
            nonlocal id_type
            for b in source:
                id_type = b.schema.field(0).type
                yield b

        for block in _blocks(first_type(batches)):
            pieces = [list(_segments(t)) for _, t in block]
            if len(block) == 1:  # one text, however long: a dictionary for each segment
                got = [x for p in pieces[0] for x in _payloads([p])]
                n = np.array([sum(len(x[0]) for x in got)])
            else:
                got = _payloads([b"".join(p) for p in pieces])
                n = np.array([len(x[0]) for x in got])
            crc = np.concatenate([x[0] for x in got]) if got else np.zeros(0, np.uint32)
            length = np.concatenate([x[1] for x in got]) if got else np.zeros(0, np.int64)
            end = np.cumsum(n)
            of = np.repeat(np.arange(len(block)), n)
            runs = [run_crcs(crc, length, end[of] - 1, k) if k > 1 else (crc, np.arange(len(crc))) for k in range(1, max_n + 1)]
            bucket = np.concatenate([r[0] for r in runs]) % np.uint32(buckets)
            text = np.concatenate([of[r[1]] for r in runs]) if len(of) else np.zeros(0, np.int64)
            if max_n > 1:
                bucket = bucket[np.argsort(text, kind="stable")]
            ends = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(block)))]).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(ends), pa.array(bucket.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in block], id_type), pa.array(n.astype(np.int64)), found], ["id", "n_words", "found"])

    return rows.mapInArrow(run, f"id {kind}, n_words bigint, found array<int>")


def bucket_counts(found: DataFrame, buckets: int):
    """How often each bucket occurs: added in the tasks, then at most ``buckets`` rows."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    counts = found.select("found").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in counts.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln of the smoothed target share over the smoothed source share)."""
    buckets, total_s, total_t = len(source), sum(source), sum(target)
    one = lambda s, t: math.floor(1000 * math.log(float(t + 1) * float(total_s + buckets) / (float(s + 1) * float(total_t + buckets))))
    known: dict[tuple[int, int], int] = {}
    return [known.setdefault((s, t), one(s, t)) for s, t in zip(source, target)]


def noise(id_: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256(seed:id)."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def _weights(found: DataFrame, gain: list[int]) -> DataFrame:
    """(id, n_words, n_features, weight)."""
    import numpy as np
    import pyarrow as pa

    shared = found.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))  # one number a bucket
    kind = found.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            n = b.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(shared.value[b.column(2).flatten().to_numpy(zero_copy_only=False)])])
            end = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n), pa.array(total[end] - total[end - n])], ["id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint")


def resample(df: DataFrame, target: DataFrame, max_n: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: str = "2024", id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """id_col, n_features, weight, score and rank (1, 2, ... of the drawn, else null) of every
    document; floor(percent * N / 100) of the N with ``min_words`` words or more are drawn."""
    found = written(features(df, id_col, text_col, max_n, buckets), "resample-features")
    wanted = features(target.withColumn("__none", F.lit(None).cast("long")), "__none", target_text, max_n, buckets)
    gain = gains(bucket_counts(found, buckets), bucket_counts(wanted, buckets))
    scored = _weights(found, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = written(scored, "resample-scores")
    able = scored.where(F.col("n_words") >= min_words).select((-F.col("score")).alias("down"), F.col("id").isNull().alias("no_id"), "id", "weight", "n_features", "score")
    drawn = able.count() * percent // 100
    ranked = dense_index(able, ["down", "no_id", "id", "weight", "n_features"], "at")
    rank = F.when(F.col("at") < drawn, F.col("at") + 1)
    rest = scored.where(F.col("n_words") < min_words).select("id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    out = ranked.select("id", "n_features", "weight", "score", rank.alias("rank")).union(rest)
    return out.withColumnRenamed("id", id_col)
