"""Removal of repeated byte strings with sharded suffix arrays.

Two equal strings of LENGTH bytes have the same minimizer, the gram of least hash in them. So the table is first cut
down to minimizers that occur more than once, each standing for the segment of all strings around it. Segments equal to
an earlier one are removed whole. Where a minimizer stands in different segments, these go to a shard; those of one that
is too frequent for a shard are first cut again, by their minimizers under another hash, so that more context tells
them apart. A shard's suffixes are classified, the leftmost-smaller substrings sorted by induction and named, names sorted recursively, the shard's suffix
array induced from them in linear time, and common prefixes computed in text order. In each run of suffixes that share
LENGTH bytes the first by document stays.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import map_rows, whole_text, written

LENGTH, GRAM = 100, 20
WINDOW = LENGTH - GRAM + 1
#: Bytes of segments in one suffix array.
SHARD_BYTES = 1_000_000
#: Bytes of different segments around one minimizer beyond which they are cut again, and how often at most. What is too
#: much even then, strings that differ in a few bytes only, is compared string by string, by two hashes.
GRAM_BYTES, CUTS = 500_000, 6


# -- suffix arrays ----------------------------------------------------------------------------------------------------


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one."""
    n = len(t)
    decided = np.append(np.flatnonzero(t[:-1] != t[1:]), n - 1)
    smaller = np.append(t[:-1] < t[1:], True)  # the end mark
    return np.repeat(smaller[decided], np.diff(decided, prepend=-1))


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The order of all suffixes from that of the leftmost-smaller ones: a bucket at a time, each step on arrays."""
    n, sa = len(t), np.full(len(t), -1, np.int32)
    ends = np.cumsum(counts)
    starts = ends - counts

    def place(rows: np.ndarray, free: np.ndarray, up: bool) -> None:
        at = rows[rows > 0] - 1
        at = at[small[at] != up]
        if len(at):
            bucket = t[at]
            order = np.argsort(bucket, kind="stable")
            at, bucket = at[order], bucket[order]
            first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            size = np.diff(np.append(first, len(bucket)))
            nth = np.arange(len(bucket)) - np.repeat(first, size)
            sa[free[bucket] + nth if up else free[bucket] - 1 - nth] = at
            free[bucket[first]] += size if up else -size

    b = t[lms]
    order = np.argsort(b, kind="stable")
    of = np.bincount(b, minlength=len(counts))
    tail_of_lms = {int(c): lms[order][e - of[c] : e] for c, e in zip(np.flatnonzero(of), np.cumsum(of[of > 0]), strict=True)}
    used = np.flatnonzero(counts)
    head = starts.copy()
    for c in used:
        done = starts[c]
        while done < head[c]:
            now, done = sa[done : head[c]].copy(), head[c]
            place(now, head, True)
        if c in tail_of_lms:
            place(tail_of_lms[c], head, True)
    tail = ends.copy()
    for c in used[::-1]:
        done = ends[c]
        while done > tail[c]:
            now, done = sa[tail[c] : done][::-1].copy(), tail[c]
            place(now, tail, False)
        place(sa[starts[c] : head[c]][::-1], tail, False)
    sa[0] = n - 1
    return sa


def _ranked(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of the named string: names of pairs of names, until all differ or ``depth`` names count."""
    rank, step, n = names.astype(np.int64), 1, len(names)
    while True:
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - step)] = rank[step:] + 1
        key = rank * (n + 2) + ahead
        order = np.argsort(key)
        new = np.append(0, np.cumsum(key[order][1:] != key[order][:-1]))
        if new[-1] == n - 1 or 2 * step >= depth:
            return order
        rank[order] = new
        step *= 2


def suffix_array(text: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Order of all suffixes of values under 2**16, or of bytes, that end in a 0, the only one.

    With a depth, suffixes that share their first ``depth`` values may be in any order among themselves.
    """
    t = text if text.dtype == np.uint8 else text.astype(np.uint16)  # stable sorts of 8 or 16 bits are linear
    if len(t) < 2:
        return np.arange(len(t))
    small = _types(t)
    counts = np.bincount(t)
    is_lms = np.append(False, small[1:] & ~small[:-1])
    lms = np.flatnonzero(is_lms).astype(np.int32)
    sa = _induce(t, small, lms, counts)
    # Name the leftmost-smaller substrings in their induced order; they end where the next one starts.
    placed = sa[is_lms[sa]]
    following = np.full(len(t), len(t) - 1, np.int32)
    following[lms[:-1]] = lms[1:]
    size = following[placed] - placed + 1
    same = np.append(False, size[1:] == size[:-1])
    open_ = np.flatnonzero(same)
    offset = 0
    while len(open_):
        a, b = placed[open_] + offset, placed[open_ - 1] + offset
        equal = (t[a] == t[b]) & (small[a] == small[b])
        same[open_[~equal]] = False
        open_ = open_[equal]
        offset += 1
        open_ = open_[size[open_] > offset]
    names = np.empty(len(t), np.int32)
    names[placed] = np.cumsum(~same) - 1
    # Each name but the last stands for two values at least before the next one starts.
    return _induce(t, small, lms[_ranked(names[lms], len(t) if depth is None else depth // 2 + 1)], counts)


def shares_prefix(raw: np.ndarray, left: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """For each place of the array whether its suffix shares ``length`` (8 or more) bytes with the one before it.

    Common prefixes are followed in text order, eight bytes at a time, where the two suffixes move along side by side.
    ``left`` holds the bytes from each place to the end of its segment; a prefix doesn't cross that.
    """
    n = len(raw)
    before = np.full(n, -1, np.int32)
    before[sa[1:]] = sa[:-1]
    open_ = np.flatnonzero((before >= 0) & (left >= length) & (left[before] >= length))
    eight = np.ascontiguousarray(np.ndarray(max(0, n - 7), "<u8", raw.tobytes(), strides=(1,)))
    for offset in [*range(0, length - 8, 8), length - 8]:
        open_ = open_[eight[open_ + offset] == eight[before[open_] + offset]]
    plcp = np.zeros(n, bool)
    plcp[open_] = True
    return plcp[sa]


# -- scratch ----------------------------------------------------------------------------------------------------------

#: Spark's setting by which a query's shuffle files go when the query ends; else they wait for the driver's next full GC.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _settled(df: DataFrame, label: str, spent: tuple[DataFrame, ...] = ()) -> DataFrame:
    """written(), and what was shuffled for it goes with the spent folders, so that disk holds one step at a time."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return written(df, label, spent)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


# -- minimizers -------------------------------------------------------------------------------------------------------


def minimizers(raw: bytes, turn: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hashes, starts, sizes): the minimizers, and the segments of the strings of LENGTH bytes that have them.

    A string's minimizer is the leftmost of its least grams. Strings that follow one another share it, so each string
    is in one segment, and equal strings are in segments of equal grams.
    """
    n = len(raw) - GRAM + 1
    if n < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)
    base, width = 0x9E3779B97F4A7C15, 1
    hashes = {1: h}
    while width < 16:
        h = h[: len(h) - width] * np.uint64(pow(base, width, 2**64)) + h[width:]
        width *= 2
        hashes[width] = h
    gram = hashes[16][:n] * np.uint64(pow(base, 4, 2**64)) + hashes[4][16 : 16 + n]
    gram += np.uint64(turn * 0xD1B54A32D192ED03 % 2**64)
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(32)
    # The place in the low bits makes the first of equal grams the least, and says where the minimum is.
    ordered = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    # Sliding minimum by blocks: of a block's end and the next block's start.
    padded = np.full(-(-n // WINDOW) * WINDOW, np.uint64(2**64 - 1))
    padded[:n] = ordered
    square = padded.reshape(-1, WINDOW)
    up = np.minimum.accumulate(square, axis=1).reshape(-1)
    down = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(down[: n - WINDOW + 1], up[WINDOW - 1 : n])
    starts = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    places = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return gram[places].view(np.int64), starts, np.diff(starts, append=len(least)) + LENGTH - 1


def _grams(texts: DataFrame) -> DataFrame:
    """(text) to (gram), a row for each minimizer."""

    def make():
        def step(rows: pa.RecordBatch) -> pa.RecordBatch:
            found = [minimizers(text.encode("utf-8"))[0] for text in rows.column(0).to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found) if found else [], pa.int64())], ["gram"])

        return step

    return map_rows(texts, "gram bigint", make)


def _anchors(docs: DataFrame, kind: str) -> DataFrame:
    def make():
        names = ["key", "text_hash", "gram", "segment", "start", "size"]

        def step(rows: pa.RecordBatch) -> pa.RecordBatch:
            grams, starts, sizes, segments = [], [], [], []
            for text in rows.column(2).to_pylist():
                raw = text.encode("utf-8")
                gram, start, size = minimizers(raw)
                grams.append(gram)
                starts.append(start)
                sizes.append(size)
                segments += [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(start.tolist(), (start + size).tolist(), strict=True)]
            at = pa.array(np.repeat(np.arange(len(grams)), [len(x) for x in grams]))
            gram, start, size = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (grams, starts, sizes))
            segment = np.array(segments, np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at), pa.array(gram), pa.array(segment), pa.array(start), pa.array(size.astype(np.int32))], names)

        return step

    return map_rows(docs, f"key {kind}, text_hash bigint, gram bigint, segment bigint, start bigint, size int", make)


def _cut(wanted: DataFrame, kind: str) -> DataFrame:
    """(key, text_hash, text, segments of (gram, start, size, crowded)) to one row a segment with its bytes.

    Of equal rows that follow one another, as the join sorts them, the first is cut. More of them would do no harm.
    """

    def make():
        last = [None]

        def step(rows: pa.RecordBatch) -> pa.RecordBatch:
            index, grams, starts, raws, crowded = [], [], [], [], []
            for n, (key, text_hash, text, segments) in enumerate(zip(*(c.to_pylist() for c in rows.columns), strict=True)):
                if last[0] == (key, text_hash):
                    continue
                last[0] = key, text_hash
                raw = text.encode("utf-8")
                for s in segments:
                    index.append(n)
                    grams.append(s["gram"])
                    starts.append(s["start"])
                    raws.append(raw[s["start"] : s["start"] + s["size"]])
                    crowded.append(s["crowded"])
            at = pa.array(index, pa.int32())
            return pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at), pa.array(grams, pa.int64()), pa.array(starts, pa.int64()), pa.array(raws, pa.binary()), pa.array(crowded, pa.bool_())], ["key", "text_hash", "gram", "start", "raw", "crowded"])

        return step

    return map_rows(wanted, f"key {kind}, text_hash bigint, gram bigint, start bigint, raw binary, crowded boolean", make)


def _cut_again(rows: DataFrame, kind: str, turn: int) -> DataFrame:
    """Segments (key, text_hash, gram, start, raw) cut by their minimizers under another hash; gram: of both."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            index, grams, starts, segments, raws = [], [], [], [], []
            for n, (gram, start, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True)):
                for g, at, size in zip(*(x.tolist() for x in minimizers(raw, turn)), strict=True):
                    piece = raw[at : at + size]
                    index.append(n)
                    grams.append(xxhash.xxh3_64_intdigest(gram.to_bytes(8, "little", signed=True) + g.to_bytes(8, "little", signed=True)) - (1 << 63))
                    starts.append(start + at)
                    segments.append(xxhash.xxh3_64_intdigest(piece) - (1 << 63))
                    raws.append(piece)
            at = pa.array(index, pa.int32())
            return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(grams, pa.int64()), pa.array(segments, pa.int64()), pa.array(starts, pa.int64()), pa.array(raws, pa.binary())], ["key", "text_hash", "gram", "segment", "start", "raw"])

        return step

    return map_rows(rows.select("key", "text_hash", "gram", "start", "raw"), f"key {kind}, text_hash bigint, gram bigint, segment bigint, start bigint, raw binary", make)


def _crowded(rows: DataFrame) -> DataFrame | None:
    """The rows to cut again, if any."""
    found = rows.where("crowded").drop("crowded")
    return None if found.isEmpty() else found


def repeats_of(raws: list[bytes], order: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(segment, start, end) of what repeats an earlier string; order ranks the segments' documents."""
    sizes = np.fromiter(map(len, raws), np.int32, len(raws))
    joined = np.frombuffer(b"\0".join(raws) + b"\0", np.uint8)
    text = joined + np.uint8(2)  # UTF-8 has no bytes 254 and 255, so 0 and 1 are free for marks
    begin = (np.cumsum(sizes + 1) - sizes - 1).astype(np.int32)
    text[begin + sizes] = 1
    text[-1] = 0
    owner = np.repeat(np.arange(len(raws), dtype=np.int32), sizes + 1)
    offset = np.arange(len(text), dtype=np.int32) - begin[owner]
    sa = suffix_array(text, LENGTH)
    shared = shares_prefix(joined, sizes[owner] - offset, sa, LENGTH)
    run = np.cumsum(~shared)
    member = shared.copy()
    member[:-1] |= shared[1:]
    at = sa[member]
    run, doc, place = run[member], order[owner[at]], starts[owner[at]] + offset[at]
    by = np.lexsort((place, doc, run))
    late = np.append(False, run[by][1:] == run[by][:-1]) if len(by) else np.empty(0, bool)
    # The first of a run stays, as does the same string of the same place in an equal row.
    lead = np.maximum.accumulate(np.where(late, 0, np.arange(len(by)))) if len(by) else by
    late &= ~((doc[by] == doc[by][lead]) & (place[by] == place[by][lead]))
    gone = np.sort(at[by][late])
    if not len(gone):
        return []
    first = np.flatnonzero(np.append(True, np.diff(gone) != 1))
    last = np.append(first[1:], len(gone)) - 1
    return [(int(owner[a]), int(starts[owner[a]] + offset[a]), int(starts[owner[b]] + offset[b] + LENGTH)) for a, b in zip(gone[first], gone[last], strict=True)]


def _shards(batches):
    """Rows (gram, key, text_hash, start, raw) sorted by gram, to (key, text_hash, start, end)."""
    names = ["key", "text_hash", "start", "end"]

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        docs = sorted({(r[1] is None, r[1] or 0, r[2]) for r in rows})
        rank = {d: n for n, d in enumerate(docs)}
        found = repeats_of([r[4] for r in rows], np.array([rank[r[1] is None, r[1] or 0, r[2]] for r in rows]), np.array([r[3] for r in rows]))
        return pa.RecordBatch.from_arrays([pa.array([rows[n][1] for n, _, _ in found], kind), pa.array([rows[n][2] for n, _, _ in found], pa.int64()), pa.array([a for _, a, _ in found], pa.int64()), pa.array([b for _, _, b in found], pa.int64())], names)

    held, size, kind = [], 0, pa.int64()
    for batch in batches:
        kind = batch.schema.field(1).type
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if size > SHARD_BYTES and row[0] != held[-1][0]:
                yield solve(held)
                held, size = [], 0
            held.append(row)
            size += len(row[4])
    if held:
        yield solve(held)


def _merged(gone: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, starts, ends) of the maximal runs of lists of (start, end), which may overlap or be null."""
    flat = gone.flatten()
    start, end = (pc.struct_field(flat, k).to_numpy(zero_copy_only=False) for k in ("start", "end"))
    row = np.repeat(np.arange(len(gone)), pc.fill_null(gone.value_lengths(), 0).to_numpy(zero_copy_only=False))
    if not len(row):
        return row, row, row
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    apart = row * (end.max() + 1)  # rows lie one behind another, with a gap
    reach = np.maximum.accumulate(end + apart)
    first = np.flatnonzero(np.append(True, start[1:] + apart[1:] > reach[:-1]))
    return row[first], start[first], (reach - apart)[np.append(first[1:], len(row)) - 1]


def _kept(docs: DataFrame, kind: str) -> DataFrame:
    def make():
        def step(rows: pa.RecordBatch) -> pa.RecordBatch:
            raws = [text.encode("utf-8") for text in rows.column(1).to_pylist()]
            row, start, end = _merged(rows.column(2))
            at = np.searchsorted(row, np.arange(len(raws) + 1))
            kept = []
            for raw, a, b in zip(raws, at[:-1].tolist(), at[1:].tolist(), strict=True):
                edges = [0, *np.stack([start[a:b], end[a:b]], axis=1).reshape(-1).tolist(), len(raw)] if a < b else [0, len(raw)]
                kept.append(b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
            size = np.fromiter(map(len, raws), np.int64, len(raws))
            removed = size - np.fromiter(map(len, kept), np.int64, len(kept))
            return pa.RecordBatch.from_arrays([rows.column(0), pa.array(size), pa.array(removed), pa.array(np.diff(at)), pa.array(kept, pa.binary())], ["key", "n_bytes", "n_removed", "n_spans", "kept"])

        return step

    return map_rows(docs, f"key {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary", make)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept): the bytes left of every row's text, taken as UTF-8.

    Removed is each byte under a string of LENGTH bytes that also starts earlier: in a row of smaller key, or of the same
    key and smaller text hash, or earlier in the row. Null keys come last; a null text is the empty one. Rows equal in
    key and text are one document, and each gets its result. Other columns are not read, whatever they are called. An
    empty table gives an empty one. Segments count as equal by two 64-bit hashes, of the minimizer and of all their bytes.
    A very long text is held by one task a few times over, in bytes and 64-bit hashes of its places.
    """
    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.col(key).alias("key"), F.xxhash64(whole_text(text)).alias("text_hash"), whole_text(text).alias("text"))
    place = F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("text_hash"), F.col("start"))
    # Counts are written before they are joined: only a join of two exchanges is split where a minimizer is frequent.
    repeated = _settled(_grams(named.select("text")).groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "suffix-grams")
    hits = _settled(_anchors(named, kind).join(repeated, "gram"), "suffix-hits", (repeated,))
    firsts = _settled(hits.groupBy("gram", "segment").agg(F.min(place).alias("first"), F.max("size").alias("size"), F.count(F.lit(1)).alias("n")), "suffix-firsts")
    # Whole segments that repeat an earlier one.
    twins = hits.join(firsts.where("n > 1").select("gram", "segment", "first"), ["gram", "segment"]).where(place != F.col("first"))
    removed = [_settled(twins.select("key", "text_hash", "start", (F.col("start") + F.col("size")).alias("end")), "suffix-twins", (hits,))]
    # Different segments around one gram; their bytes are cut from the texts.
    mixed = _settled(firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("segments"), F.sum("size").alias("bytes")).where("segments > 1").select("gram", (F.col("bytes") > GRAM_BYTES).alias("crowded")), "suffix-mixed")
    wanted = _settled(firsts.join(mixed, "gram").select(F.col("first.key").alias("k"), F.col("first.text_hash").alias("h"), "gram", F.col("first.start").alias("start"), "size", "crowded"), "suffix-wanted", (firsts, mixed))
    same_doc = (F.col("text_hash") == F.col("h")) & F.col("key").eqNullSafe(F.col("k"))
    # The texts are dealt by document, once for all cuts, and once more for the result.
    of_doc = wanted.groupBy("k", "h").agg(F.collect_list(F.struct("gram", "start", "size", "crowded")).alias("segments"))
    pieces = _settled(_cut(named.join(of_doc, same_doc).select("key", "text_hash", "text", "segments"), kind), "suffix-pieces", (wanted,))
    held = [pieces]
    few, many = pieces.where("not crowded").drop("crowded"), _crowded(pieces)
    for turn in range(1, CUTS + 1):
        if many is None:
            break
        again = _settled(_cut_again(many, kind, turn), "suffix-again")
        # The first of equal segments, with its bytes.
        each = _settled(again.groupBy("gram", "segment").agg(F.min(F.struct(place.alias("place"), F.col("raw"))).alias("first"), F.count(F.lit(1)).alias("n")), "suffix-firsts")
        repeats = each.where("n > 1").select("gram", "segment", F.col("first.place").alias("first"))
        twins = again.join(repeats, ["gram", "segment"]).where(place != F.col("first"))
        removed.append(_settled(twins.select("key", "text_hash", "start", (F.col("start") + F.octet_length("raw")).alias("end")), "suffix-twins", (again,)))
        mixed = _settled(each.groupBy("gram").agg(F.count(F.lit(1)).alias("segments"), F.sum(F.octet_length("first.raw")).alias("bytes")).where("segments > 1").select("gram", (F.col("bytes") > GRAM_BYTES).alias("crowded")), "suffix-mixed")
        left = _settled(each.join(mixed, "gram").select(F.col("first.place.key").alias("key"), F.col("first.place.text_hash").alias("text_hash"), "gram", F.col("first.place.start").alias("start"), F.col("first.raw").alias("raw"), "crowded"), "suffix-left", (each, mixed))
        held.append(left)
        few, many = few.unionByName(left.where("not crowded").drop("crowded")), _crowded(left)
    if many is not None:
        strings = many.select("key", "text_hash", F.col("start").alias("begin"), "raw", F.explode(F.sequence(F.lit(0), F.octet_length("raw") - LENGTH)).alias("o"))
        strings = strings.select("key", "text_hash", (F.col("begin") + F.col("o")).alias("start"), F.xxhash64(F.substring("raw", F.col("o") + 1, F.lit(LENGTH))).alias("s1"), F.crc32(F.substring("raw", F.col("o") + 1, F.lit(LENGTH))).alias("s2"))
        first_of = strings.groupBy("s1", "s2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") != F.col("last")).select("s1", "s2", "first")
        first_of = _settled(first_of, "suffix-strings")
        removed.append(_settled(strings.join(first_of, ["s1", "s2"]).where(place != F.col("first")).select("key", "text_hash", "start", (F.col("start") + LENGTH).alias("end")), "suffix-twins", (first_of,)))
    in_order = few.select("gram", "key", "text_hash", "start", "raw").repartition("gram").sortWithinPartitions("gram")
    late = in_order.mapInArrow(_shards, f"key {kind}, text_hash bigint, start bigint, end bigint")
    gone = reduce(DataFrame.unionByName, [*removed, late]).groupBy(F.col("key").alias("k"), F.col("text_hash").alias("h")).agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    gone = _settled(gone, "suffix-gone", (*held, *removed))
    rows = named.join(gone, same_doc, "left").select("key", "text", "gone")
    return _kept(rows, kind).withColumnRenamed("key", key)
