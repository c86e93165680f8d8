"""Lines that many documents repeat are dropped but for the last document that holds them.

Two Bloom filters mark the hashes of lines seen once and seen twice. Both are cut into segments by
the hash. Each task fills a pair of its own and sends the bits that it set, compressed; the segment's task merges them: a bit
that was there already is carried into the second filter. Only lines that the second filter holds, the suspected repeats, are
shuffled to be counted exactly by a 128-bit digest. Segments grow in number with the text, never in
size. The second filter is broadcast while it has at most ``BROADCAST_SEGMENTS`` segments, and the
repeated lines while they are at most ``BROADCAST_LINES``; beyond either, the same rows meet by
joins on the segment, on the line (salted, as one line may be in a third of all documents) and on
the document.

Defined results: a null or empty text has one empty line and stays (null stays null); documents
with a null id neither count nor lose lines; rows with one id are one document, so repeated rows count once, and all of them that hold
the line's largest id keep it; very long texts are read whole; short keys and
keys in fewer documents stay; a text that loses all its lines becomes empty; columns to keep that are named like a result get it replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karstmap.llm.common import by_batch, slices, stored, text_bytes, utf8

MIN_CHARS, MIN_DOCS = 40, 5
SEGMENT_BITS = 1 << 21
BYTES_PER_BIT = 10  # a line of 40 characters has at least 4 bits, one of the usual length far more
BROADCAST_SEGMENTS, BROADCAST_LINES = 256, 500_000
FLUSH, SALTS = 500_000, 32
DIGEST = np.dtype([("bits", "<u8"), ("segment", "<u8")])


def line_key(line: bytes, least: int = MIN_CHARS) -> bytes | None:
    """The stripped line in lower case, or None if it is too short to count."""
    key = line.strip().lower()
    if len(key) < least or not key.isascii() and len(key.decode()) < least:
        return None
    return key


def digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def keys_of(text: bytes | None, least: int) -> list[bytes | None]:
    """The digest of each line, None for short ones."""
    return [digest(k) if (k := line_key(x, least)) is not None else None for x in (text or b"").split(b"\n")]


def _places(digests: np.ndarray) -> np.ndarray:
    """Three bits of a segment for each digest."""
    mask = np.uint64(SEGMENT_BITS - 1)
    return np.stack([(digests["bits"] >> np.uint64(21 * k)) & mask for k in range(3)]).astype(np.int64)


def _segment(digests: np.ndarray, segments: int) -> np.ndarray:
    return (digests["segment"] % np.uint64(segments)).astype(np.int32)


def _bits(digests: np.ndarray) -> bytes:
    """The places of the digests' bits, in order, as steps from one to the next."""
    return zlib.compress(np.diff(np.unique(_places(digests.view(DIGEST))), prepend=0).astype("<u4").tobytes(), 1)


def _read(bits: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(bits), "<u4").astype(np.int64))


def _local(batches: Iterator[pa.RecordBatch], segments: int, least: int) -> Iterator[pa.RecordBatch]:
    """A task's bits of each segment: those of all its lines, and those of lines that it met in more than one document."""
    held: list[bytes] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        unique, counts = np.unique(np.frombuffer(b"".join(held), "V16"), return_counts=True)
        held.clear()
        owner = _segment(unique.view(DIGEST), segments)
        order = np.argsort(owner, kind="stable")
        unique, counts, owner = unique[order], counts[order], owner[order]
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        rows = [(int(owner[a]), _bits(unique[a:b]), _bits(unique[a:b][counts[a:b] > 1])) for a, b in zip(starts, [*starts[1:], len(owner)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["segment", "once", "twice"])

    for batch in slices(batches):
        for text in utf8(batch):
            held.extend({k for k in keys_of(text, least) if k})
            if len(held) >= FLUSH:
                yield from flush()
    yield from flush()


def _fill(group: pa.Table) -> pa.Table:
    """A segment's second filter: bits that several tasks set, or one for several documents."""
    once, twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
    for row in zip(group.column("once").to_pylist(), group.column("twice").to_pylist(), strict=True):
        places = _read(row[0])
        twice[places[once[places]]] = True
        once[places] = True
        twice[_read(row[1])] = True
    return pa.table({"segment": group.column("segment")[:1], "filter": pa.array([np.packbits(twice).tobytes()], pa.binary())})


def _hits(filter_: bytes, digests: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(filter_, np.uint8)
    places = _places(digests)
    return ((bits[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(axis=0)


def suspects(df: DataFrame, id_col: str, text_col: str, least: int, broadcast_segments: int = BROADCAST_SEGMENTS) -> DataFrame:
    """id_col and key of the lines that the twice-seen filter holds, each once a row of df."""
    spark = df.sparkSession
    docs = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    segments = max(1, -(-text_bytes(docs) // (BYTES_PER_BIT * SEGMENT_BITS)))
    sent = docs.select("text").mapInArrow(lambda it: _local(it, segments, least), "segment int, once binary, twice binary")
    filters = sent.groupBy("segment").applyInArrow(_fill, "segment int, filter binary")

    if segments <= broadcast_segments:
        shared = spark.sparkContext.broadcast({r["segment"]: r["filter"] for r in filters.collect()})  # at most broadcast_segments of 256 KB

        def probe(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows, keys = [], []
            for i, text in enumerate(utf8(batch)):
                own = list(dict.fromkeys(k for k in keys_of(text, least) if k))
                rows += [i] * len(own)
                keys += own
            digests = np.frombuffer(b"".join(keys), DIGEST)
            owner, hit = _segment(digests, segments), np.zeros(len(digests), bool)
            for segment, filter_ in shared.value.items():
                at = np.flatnonzero(owner == segment)
                hit[at] = _hits(filter_, digests[at])
            at = np.flatnonzero(hit)
            ids = batch.column("id").take(pa.array([rows[i] for i in at], pa.int64()))
            return pa.RecordBatch.from_arrays([ids, pa.array([keys[i] for i in at], pa.binary())], ["id", "key"])

        return docs.mapInArrow(by_batch(probe), f"id {kind}, key binary")

    def lines(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, keys = [], []
        for i, text in enumerate(utf8(batch)):
            own = list(dict.fromkeys(k for k in keys_of(text, least) if k))
            rows += [i] * len(own)
            keys += own
        owner = _segment(np.frombuffer(b"".join(keys), DIGEST), segments)
        return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int64())), pa.array(keys, pa.binary()), pa.array(owner, pa.int32())], ["id", "key", "segment"])

    def sift(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests = np.frombuffer(b"".join(batch.column("key").to_pylist()), DIGEST)
        owner, hit = np.array(batch.column("segment")), np.zeros(len(digests), bool)
        firsts = {s: i for i, s in reversed(list(enumerate(owner.tolist())))}
        for segment, i in firsts.items():
            at = np.flatnonzero(owner == segment)
            hit[at] = _hits(batch.column("filter")[i].as_py(), digests[at])
        return batch.select(["id", "key"]).filter(pa.array(hit))

    met = docs.mapInArrow(by_batch(lines), f"id {kind}, key binary, segment int").join(filters.hint("shuffle_hash"), "segment")
    return met.mapInArrow(by_batch(sift), f"id {kind}, key binary")


def repeated_lines(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """key and keep, the largest id, of the keys in at least min_docs documents."""
    return found.distinct().groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("keep")).where(F.col("n") >= min_docs).select("key", "keep")


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_segments: int = BROADCAST_SEGMENTS, broadcast_lines: int = BROADCAST_LINES) -> DataFrame:
    """id_col, text_col without the repeated lines, the columns to keep, n_lines (before) and n_dropped."""
    spark = df.sparkSession
    found = stored(suspects(df, id_col, text_col, min_chars, broadcast_segments), "suspects")
    repeated = stored(repeated_lines(found, min_docs), "repeated")
    names = [c for c in dict.fromkeys((id_col, text_col, *keep)) if c not in ("n_lines", "n_dropped")]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)

    def apply(batch: pa.RecordBatch, dropped) -> pa.RecordBatch:
        texts, counts, gone = [], [], []
        for i, (text, id_) in enumerate(zip(utf8(batch, text_col), batch.column(id_col).to_pylist(), strict=True)):
            keys = keys_of(text, min_chars)
            drop = dropped(i, id_, keys) if id_ is not None else ()
            if drop:
                lines = text.split(b"\n")
                kept = [x for x, k in zip(lines, keys, strict=True) if k not in drop]
                text = b"\n".join(kept)
                gone.append(len(lines) - len(kept))
            else:
                gone.append(0)
            texts.append(text)
            counts.append(len(keys))
        columns = [pa.array(texts, pa.binary()).cast(pa.string()) if c == text_col else batch.column(c) for c in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_dropped"])

    if repeated.count() <= broadcast_lines:
        shared = spark.sparkContext.broadcast({bytes(r["key"]): r["keep"] for r in repeated.collect()})  # at most broadcast_lines rows

        def small(batch: pa.RecordBatch) -> pa.RecordBatch:
            last = shared.value
            return apply(batch, lambda _, id_, keys: {k for k in keys if k in last and last[k] != id_})

        return df.select(*names).mapInArrow(by_batch(small), f"{kinds}, n_lines long, n_dropped long")

    salted = repeated.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = found.distinct().withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).where("id <> keep")
    drops = pairs.groupBy(F.col("id").alias("__id")).agg(F.collect_set("key").alias("__drops"))

    def large(batch: pa.RecordBatch) -> pa.RecordBatch:
        drops = batch.column("__drops").to_pylist()
        return apply(batch, lambda i, _, __: set(drops[i] or ()))

    joined = df.select(*names).join(drops, F.col(id_col).eqNullSafe(F.col("__id")), "left").select(*names, "__drops")
    return joined.mapInArrow(by_batch(large), f"{kinds}, n_lines long, n_dropped long")
