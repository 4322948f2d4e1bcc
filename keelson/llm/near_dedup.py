"""Near-duplicate detection with DartMinHash.

A text is the weighted set of its five-word shingles, the weight being how often one occurs. Darts, points placed by
hash in each element's region of weight and rank, are thrown until each of the signature's coordinates has one; the
dart of least rank stays. Regions are cut along the weight at powers of two and into cells of one dart on average, so
the cost grows with the darts wanted and the elements, not with an element's weight. Two signatures agree in a
coordinate with the chance of the weighted Jaccard similarity.

Equal texts are one node. Nodes that agree in a band of coordinates are in one bucket. First every node of a bucket is
compared with the bucket's least node, which settles groups of near copies in time linear in their size. In buckets
that still hold several components, the nodes outside the largest one are compared with all nodes of the bucket, in
blocks, each pair in the first band that it shares. Every link is checked on the shingle sets.
"""

from __future__ import annotations

import zlib
from math import exp, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import map_rows, whole_text, written
from keelson.llm.components import components

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 24, 5
COORDINATES = BANDS * BAND_ROWS
#: Nodes of a bucket that one task compares with as many others.
BLOCK_NODES = 512

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_STRIP = np.uint64(0xD1B54A32D192ED03)
#: Darts thrown at first: each coordinate gets one with a chance of 0.999.
_DARTS = COORDINATES * log(COORDINATES) + 2 * COORDINATES


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _poisson_steps() -> np.ndarray:
    """Where a 32-bit number turns into one dart more, at a mean of one dart for an element and strip."""
    p = np.cumprod([exp(-1.0), *(1.0 / k for k in range(1, 16))])
    return np.minimum(np.cumsum(p) * 2.0**32, 2.0**32 - 1).astype(np.uint32)


_STEPS = _poisson_steps()


def regions(text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Hashes of the different shingles, their weights, and the digest of the words.

    Words are lower-cased and split at white space. A text of fewer words than a shingle is one shingle.
    """
    words = text.lower().encode("utf-8").split()
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64), b""
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    width = min(SHINGLE_WORDS, len(words))
    hashes = _mixed(hashes + _MULTIPLIER)
    mixed = np.zeros(len(words) - width + 1, np.uint64)
    for n in range(width):
        mixed *= _MULTIPLIER
        mixed += hashes[n : n + len(mixed)]
    elements, weights = np.unique(_mixed(mixed), return_counts=True)
    return elements, weights, digest


def units(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The set to check links on: sorted 32-bit hashes, the n-th unit of an element's weight being one of its own."""
    nth = np.arange(weights.sum()) - np.repeat(np.cumsum(weights) - weights, weights)
    return np.unique((_mixed(np.repeat(elements, weights) + nth.astype(np.uint64) * _MULTIPLIER) >> np.uint64(32)).astype(np.uint32))


def _thrown(elements: np.ndarray, weights: np.ndarray, least: float, below: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(coordinates, ranks, values) of the darts with a rank from ``least`` to ``below``, at one dart a unit of area.

    A region is the element's weight by all ranks. Along the weight it is cut into strips from 0 to 1, 1 to 2, 2 to 4
    and so on, a strip into cells of area one; each cell has a Poisson number of darts, and those beyond the weight miss.
    """
    strips = 1 + np.frexp((weights - 1).astype(np.float64))[1]
    of = np.repeat(np.arange(len(elements)), strips)
    strip = np.arange(len(of)) - np.repeat(np.cumsum(strips) - strips, strips)
    width = np.ldexp(1.0, np.maximum(strip - 1, 0))
    first = np.floor(least * width).astype(np.int64)
    cells = np.ceil(below * width).astype(np.int64) - first
    at = np.repeat(np.arange(len(of)), cells)
    cell = np.arange(len(at)) - np.repeat(np.cumsum(cells) - cells, cells) + first[at]
    x = _mixed(elements[of[at]] + (strip[at].astype(np.uint64) << np.uint64(48)) * _MULTIPLIER + (cell.astype(np.uint64) + np.uint64(1)) * _STRIP)
    darts = np.searchsorted(_STEPS, (x >> np.uint64(32)).astype(np.uint32), side="right")
    hit = np.repeat(np.arange(len(x)), darts)
    number = np.arange(1, len(hit) + 1) - np.repeat(np.cumsum(darts) - darts, darts)
    y = _mixed(x[hit] + number.astype(np.uint64) * _MULTIPLIER)
    v = _mixed(y)
    low = lambda z: (z & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32
    where = at[hit]
    ranks = (cell[hit] + low(y)) / width[where]
    reach = width[where] * ((strip[where] > 0) + low(v >> np.uint64(32)))
    inside = np.flatnonzero((ranks >= least) & (ranks < below) & (reach < weights[of[where]]))
    y = y[inside]
    return (((y >> np.uint64(32)) * np.uint64(COORDINATES)) >> np.uint64(32)).astype(np.int64), ranks[inside], v[inside].astype(np.uint32)


def signature(elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """COORDINATES 32-bit values of the earliest darts."""
    out = np.zeros(COORDINATES, np.uint32)
    empty = np.ones(COORDINATES, bool)
    least, below = 0.0, _DARTS / weights.sum()
    while empty.any():
        c, r, v = _thrown(elements, weights, least, below)
        order = np.argsort(-r, kind="stable")
        order = order[empty[c[order]]]
        out[c[order]] = v[order]  # the last one written is the earliest dart
        empty[c[order]] = False
        least, below = below, below * 2
    return out


def _signed(docs: DataFrame) -> DataFrame:
    """(key, text_hash, text) to (key, text_hash, node, signature); texts without words have no node."""
    kind = docs.schema["key"].dataType.simpleString()

    def make():
        def step(rows: pa.RecordBatch) -> pa.RecordBatch:
            nodes, signatures, known = [], [], {}
            for text in rows.column(2).to_pylist():
                elements, weights, node = regions(text)
                if node and node not in known:
                    known[node] = signature(elements, weights).tobytes()
                nodes.append(node or None)
                signatures.append(known.get(node))
            return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(nodes, pa.binary()), pa.array(signatures, pa.binary())], ["key", "text_hash", "node", "signature"])

        return step

    return map_rows(docs, f"key {kind}, text_hash bigint, node binary, signature binary", make)


def _shingled(texts: DataFrame) -> DataFrame:
    """(text) to (node, units): the set to check links on, sorted 32-bit hashes."""

    def make():
        def step(rows: pa.RecordBatch) -> pa.RecordBatch:
            sets = {}
            for text in rows.column(0).to_pylist():
                elements, weights, node = regions(text)
                if node and node not in sets:
                    sets[node] = units(elements, weights).tobytes()
            return pa.RecordBatch.from_arrays([pa.array(list(sets), pa.binary()), pa.array(list(sets.values()), pa.binary())], ["node", "units"])

        return step

    return map_rows(texts, "node binary, units binary", make)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def _linked(pairs: DataFrame, least: float) -> DataFrame:
    """(a, b, units_a, units_b) to the (a, b) that are similar enough."""

    def make():
        def step(rows: pa.RecordBatch) -> pa.RecordBatch:
            a, b = rows.column(2).to_pylist(), rows.column(3).to_pylist()
            ok = [min(len(x), len(y)) >= least * max(len(x), len(y)) and jaccard(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)) >= least for x, y in zip(a, b, strict=True)]
            return rows.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return step

    return map_rows(pairs, "a binary, b binary", make)


def _search(least: float):
    """Links between different components of one cell: its asking nodes against its others; of the links that join the
    same parts one is enough."""

    def run(group: pa.Table) -> pa.Table:
        nodes, parts = group["node"].to_pylist(), np.unique(np.array(group["component"].to_pylist(), dtype=object), return_inverse=True)[1]
        asks, rest = (np.array(group[c].to_pylist(), bool) for c in ("asks", "rest"))
        band, bands = group["band"][0].as_py(), np.stack([np.frombuffer(x, ">i8").astype(np.int64) for x in group["bands"].to_pylist()])
        sets = [np.frombuffer(x, np.uint32) for x in group["units"].to_pylist()]
        rows = np.flatnonzero(~asks)
        found = []
        if len(rows) and asks.any():
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            held, token = np.unique(np.concatenate(sets), return_inverse=True)
            start = np.append(0, np.cumsum(size))
            of_rows = np.concatenate([token[start[j] : start[j + 1]] for j in rows])
            begin = np.append(0, np.cumsum(size[rows])[:-1])
            there = np.zeros(len(held), np.int32)
            for i in np.flatnonzero(asks):
                there[token[start[i] : start[i + 1]]] = 1
                shared = np.add.reduceat(there[of_rows], begin)
                there[token[start[i] : start[i + 1]]] = 0
                for j in rows[(shared >= least * (size[i] + size[rows] - shared)) & (parts[rows] != parts[i])]:
                    # A pair that asks both ways is looked at one way, and in the first of the bands it shares.
                    if parts[i] != parts[j] and not (rest[j] and nodes[j] < nodes[i]) and bands[i][np.argmax(bands[i] == bands[j])] == band:
                        found.append((nodes[i], nodes[j]))
                        parts[parts == parts[j]] = parts[i]
        return pa.table({"a": pa.array([x for x, _ in found], pa.binary()), "b": pa.array([y for _, y in found], pa.binary())})

    return run


def _dealt(buckets: DataFrame, merged: DataFrame) -> DataFrame:
    """Cells (band, block, chunk) of the buckets that hold several components: a block of the nodes outside the bucket's
    largest component, which ask, and a chunk of all its nodes."""
    labelled = buckets.join(merged, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labelled = written(labelled.select("band", "node", "component", "n"), "near-labelled")
    parts = labelled.groupBy("band", "component").agg(F.count(F.lit(1)).alias("held"))
    largest = parts.groupBy("band").agg(F.max(F.struct("held", "component")).alias("top"), F.sum("held").alias("all")).where(F.col("top.held") < F.col("all"))
    largest = written(largest.select("band", F.col("top.component").alias("main"), F.ceil((F.col("all") - F.col("top.held")) / BLOCK_NODES).cast("int").alias("blocks")), "near-open")
    placed = labelled.join(largest, "band").withColumn("rest", F.col("component") != F.col("main")).withColumn("chunks", F.ceil(F.col("n") / BLOCK_NODES).cast("int"))
    number = lambda count: F.pmod(F.xxhash64("node"), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    common = ["band", "node", "component", "rest"]
    rows = placed.select(*common, F.lit(False).alias("asks"), every(F.col("blocks")).alias("block"), number(F.col("chunks")).alias("chunk"))
    asking = placed.where("rest").select(*common, F.lit(True).alias("asks"), number(F.col("blocks")).alias("block"), every(F.col("chunks")).alias("chunk"))
    return rows.unionByName(asking)


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(key, text_hash, class_id, copies_in_class, kept) for every row.

    class_id is the least key of the row's class, the texts that a chain of links of similarity ``least`` or more joins;
    kept marks the rows of the least (key, text hash) in it, equal rows alike. Links are found to join texts into classes:
    every pair of texts in a bucket is in one class or was compared, but links within a class aren't counted. Texts without words, null ones too, are
    each a class of their own key and kept. Rows with a null key take part; a class with no other keys has a null id.
    Other columns are not read. An empty table gives an empty one.
    """
    named = docs.select(F.col(key).alias("key"), F.xxhash64(whole_text(text)).alias("text_hash"), whole_text(text).alias("text"))
    signed = written(_signed(named), "near-signed")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("signature").alias("signature"))
    nodes = written(nodes, "near-nodes")

    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(b, F.substring("signature", b * BAND_ROWS * 4 + 1, F.lit(BAND_ROWS * 4))))
    nodes = nodes.select("node", bands.alias("bands"))
    in_band = nodes.select("node", F.explode("bands").alias("band"))
    shared = in_band.groupBy("band").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = written(in_band.join(shared, "band"), "near-buckets")
    needed = buckets.select("node").distinct()
    sets = written(_shingled(named.select("text")).join(needed, "node", "left_semi").dropDuplicates(["node"]), "near-sets")

    stars = buckets.where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b")).distinct()
    links = written(_linked(_with_sets(stars, sets), least), "near-links")
    merged = components(links)

    # Buckets that hold more than one component yet.
    packed = F.concat(*[F.unhex(F.lpad(F.hex(F.get("bands", F.lit(k))), 16, "0")) for k in range(BANDS)])
    cells = _dealt(buckets, merged).join(nodes.select("node", packed.alias("bands")), "node").join(sets, "node")
    cells = cells.select("band", "block", "chunk", "node", "component", "rest", "asks", "bands", "units")
    more = written(cells.groupBy("band", "block", "chunk").applyInArrow(_search(least), "a binary, b binary"), "near-links")
    everything = merged.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)
    final = components(everything)

    member = signed.select("key", "text_hash", "node").join(final, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component", "node")
    member = written(member, "near-members")
    least_of = member.where("class is not null").groupBy("class").agg(F.min(F.struct(F.col("key").isNull().alias("none"), F.col("key"), F.col("text_hash").alias("h"))).alias("least"), F.count(F.lit(1)).alias("n"))
    # Written, so that the join is one of two exchanges and a class with very many rows is split.
    joined = member.where("class is not null").join(written(least_of, "near-least"), "class")
    first = F.col("key").eqNullSafe(F.col("least.key")) & (F.col("text_hash") == F.col("least.h"))
    classed = joined.select(F.col("key").alias(key), "text_hash", F.col("least.key").alias("class_id"), F.col("n").alias("copies_in_class"), first.alias("kept"))
    wordless = member.where("class is null").select(F.col("key").alias(key), "text_hash", F.col("key").alias("class_id"), F.lit(1).cast("long").alias("copies_in_class"), F.lit(True).alias("kept"))
    return classed.unionByName(wordless)


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    a = sets.select(F.col("node").alias("a"), F.col("units").alias("units_a"))
    b = sets.select(F.col("node").alias("b"), F.col("units").alias("units_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "units_a", "units_b")


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each class, columns unchanged, whatever they are called.

    Equal rows count as copies, as do rows equal in key and text. Null keys and texts as in classes().
    """
    kept = written(classes(docs, key, text).where("kept").select(F.col(key).alias("k"), F.col("text_hash").alias("h")).distinct(), "near-kept")
    row = docs.select(F.col(key).alias("key"), F.xxhash64(whole_text(text)).alias("text_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    stays = row.join(kept, F.col("key").eqNullSafe(F.col("k")) & (F.col("text_hash") == F.col("h")))
    return stays.dropDuplicates(["key", "text_hash"]).select("row.*")
