"""Exact removal of repeated substrings by threshold-bounded interval expansion on a BWT.

All strings of `length` bytes are judged, but no task needs all text. Of the GRAM-byte hashes inside
such a string the least is its mark, so equal strings have equal marks, wherever they stand. A
stretch of starts with one mark needs only the bytes under them, its context. Contexts whose mark
stands nowhere else hold nothing repeated and go no further; equal contexts are counted and travel
once, with their number. What is left is dealt by mark, and each task builds Burrows-Wheeler
transforms of some 256 KB of contexts and expands intervals breadth first by backward extension:
level l finds the places where sorted neighbours have l bytes in common, and after `length` levels
those not yet found have at least that many.
"""

from __future__ import annotations

from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE, U64, merged, mix64, pieces, powers, prefix_hash, release, row_key, span_hash, text_bytes, tidy, widened, written

LENGTH, GRAM = 200, 32
INDEX_BITS = 21
SHARD = 1 << 18  # bytes of context after which a task builds a transform, so that its arrays stay in cache
PART = 1 << 23  # bytes of context a task is to read
LARGEST = (1 << INDEX_BITS) - 2  # bytes of one mark's contexts beyond which its strings are matched by hash instead
STRETCH = 4096  # starts of one context at most


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    have = 1
    while have * 2 <= w:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (w - have)], h[w - have :]) if w > have else h


def contexts(data: np.ndarray, off: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Stretches of starts with one mark: text, first start in it, number of starts, mark, hash of the context's bytes, and whether a mark may stand twice in it."""
    n = len(data) - length + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, bool)
    prefix, (_, down) = prefix_hash(data, BYTE), powers(len(data) + 1)
    h = mix64((prefix[gram:] - prefix[:-gram]) * down[: len(data) - gram + 1])
    least = window_min(h, length - gram + 1)
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off))
    inside = doc[:n] == doc[length - 1 :]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
    begin = np.flatnonzero(new & inside)
    stop = np.append(np.flatnonzero(new | ~inside), n)
    count = stop[np.searchsorted(stop, begin, "right")] - begin
    if len(count) and count.max() > STRETCH:
        times = -(-count // STRETCH)
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        begin, whole = np.repeat(begin, times) + nth * STRETCH, np.repeat(count, times)
        count = np.minimum(STRETCH, whole - nth * STRETCH)
    # a gram is a mark if it is the least of some string: then it equals the largest of the marks around
    wide = length - gram + 1
    around = ~window_min(~np.concatenate([np.zeros(wide - 1, U64), least, np.zeros(wide - 1, U64)]), wide)
    marks = np.flatnonzero(h == around)
    same = np.concatenate([[0], np.cumsum(h[marks[1:]] == h[marks[:-1]])])
    low, high = np.searchsorted(marks, begin), np.searchsorted(marks, begin + count + wide - 1)
    twice = (high - low > 1) & (same[np.maximum(high - 1, 0)] > same[np.minimum(low, len(same) - 1)])
    at = doc[begin]
    return at, begin - off[at], count, least[begin], span_hash(prefix, begin, begin + count + length - 1), twice


def sorted_rotations(t: np.ndarray, depth: int) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Positions of t in the order of the `depth` symbols from there on, around the end; by doubling, on words that hold two ranks and the position.

    Also the number of symbols that the first words held, whether each row begins a class of those
    that share these symbols, and whether it shares not even all but the last of them with the row before.
    """
    n = len(t)
    bits = max(1, (n - 1).bit_length())
    shift, mask = U64(bits), U64((1 << bits) - 1)
    radix = int(t.max()) + 1
    have = 1
    while have < depth and radix ** (have + 1) <= 1 << (64 - bits):
        have += 1
    first, classes, shorter = have, None, None
    around = np.resize(t.astype(U64), n + have)
    key = around[:n].copy()
    for j in range(1, have):
        key *= U64(radix)
        key += around[j : j + n]
    here = np.arange(n, dtype=U64)
    new = np.ones(n, bool)
    while True:
        key <<= shift
        key |= here
        key.sort()
        order = (key & mask).astype(np.int32)
        key >>= shift
        np.not_equal(key[1:], key[:-1], out=new[1:])
        if classes is None:
            classes, shorter = new.copy(), np.ones(n, bool)
            key //= U64(radix)
            np.not_equal(key[1:], key[:-1], out=shorter[1:])
        if have >= depth:
            return order, first, classes, shorter
        rank = np.empty(n, U64)
        rank[order] = np.cumsum(new, dtype=np.int32) - 1
        step = min(have, depth - have)
        key = (rank << shift) | np.roll(rank, -step)
        have += step


def common_prefix_reaches(t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted rotations of t, and for each whether it begins a new class of those that share `depth` symbols.

    Breadth-first backward extension: an interval of rows that share l symbols is split by the
    symbols of the transform in it into intervals of l + 1 shared symbols. The first interval that
    ends at a row fixes that row's common prefix with the row before as l, and only such intervals
    are expanded further. Levels begin with the symbols that one sorted word holds, whose intervals
    the words themselves show, and end at `depth`; rows not reached share at least so much.
    """
    n = len(t)
    order, level, found, shorter = sorted_rotations(t, depth)
    back = np.empty(n, np.int32)
    back[order] = np.arange(n, dtype=np.int32)
    step = back[order - 1]  # the row of the rotation that begins one symbol before: symbols of the transform in sorted order
    first = t[order]
    found, shorter = np.append(found, True), np.append(shorter, True)
    at = np.flatnonzero(found)
    fresh = np.flatnonzero(~shorter[at[1:]])
    low, size = at[fresh].astype(np.int32), np.diff(at)[fresh]
    owner, hit = np.empty(n, np.int32), np.zeros(n, bool)
    for _ in range(level, depth):
        if not len(low):
            break
        which = np.repeat(np.arange(len(low), dtype=np.int32), size)
        rows = np.repeat(low - (np.cumsum(size) - size).astype(np.int32), size) + np.arange(len(which), dtype=np.int32)
        to = step[rows]
        if len(to) > n >> 4:  # many rows are put in order by marking them, few by sorting them
            owner[to] = which
            hit[to] = True
            to = np.flatnonzero(hit)
            hit[to] = False
            which = owner[to]
        else:
            key = (to.astype(np.int64) << 32) | which
            key.sort()
            to, which = key >> 32, key.astype(np.int32)
        symbol = first[to]
        cut = np.ones(len(to) + 1, bool)
        cut[1:-1] = (which[1:] != which[:-1]) | (symbol[1:] != symbol[:-1])
        at = np.flatnonzero(cut)
        low, size = to[at[:-1]], np.diff(at)
        fresh = np.flatnonzero(~found[low + size])
        low, size = low[fresh].astype(np.int32), size[fresh]
        found[low + size] = True
    return order, found[:n]


def repeated_starts(bodies: list[bytes], starts: np.ndarray, copies: np.ndarray, length: int) -> np.ndarray:
    """For all starts of all bodies, one after the other: does the string of `length` bytes from there stand anywhere else? Body i stands for copies[i] equal ones."""
    size = np.array([len(b) + 1 for b in bodies])
    raw = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    at = np.cumsum(size) - size
    seen = np.zeros(257, bool)
    t = raw.astype(np.int16) + 1
    t[at + size - 1] = 0
    seen[t] = True
    t = (np.cumsum(seen) - 1).astype(np.int16)[t]  # symbols close together, the end mark least
    order, new = common_prefix_reaches(t, length)
    body = np.full(len(t), -1, np.int64)
    body[np.repeat(at - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())] = np.repeat(np.arange(len(bodies)), starts)
    kind = np.cumsum(new) - 1
    owner = body[order]
    live = owner >= 0
    weight = np.bincount(kind[live], weights=copies[owner[live]], minlength=kind[-1] + 1)
    out = np.zeros(len(t), bool)
    out[order[live]] = weight[kind[live]] >= 2
    return out[body >= 0]


def _runs(flags: np.ndarray, starts: np.ndarray) -> list[list[int]]:
    """Per body the first and last of each run of flagged starts."""
    out, at = [], 0
    for n in starts:
        f = np.zeros(n + 2, np.int8)
        f[1:-1] = flags[at : at + n]
        edge = np.diff(f)
        out.append(np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1], axis=1).reshape(-1).tolist())
        at += n
    return out


def _expand(batches, length: int):
    """Bodies in order of mark -> starts that repeat, a transform for every SHARD bytes of whole marks."""
    held, size = [], 0

    def flush():
        starts, copies = np.array([h[3] for h in held]), np.array([h[2] for h in held], float)
        runs = _runs(repeated_starts([h[4] for h in held], starts, copies, length), starts)
        keep = [i for i, r in enumerate(runs) if r]
        return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in keep], pa.int64()), pa.array([held[i][1] for i in keep], pa.int64()), pa.array([runs[i] for i in keep], pa.list_(pa.int32()))], names=["mark", "ctx", "starts"])

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    for _, group in groupby(rows(), key=itemgetter(0)):
        group = list(group)
        more = sum(len(g[4]) + 1 for g in group)
        if held and (size >= SHARD or size + more > LARGEST):
            yield flush()
            held, size = [], 0
        held += group
        size += more
    if held:
        yield flush()


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, hash of the text, spans): begin and end bytes, one after the other, of what repeated strings cover; spans may overlap."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("id"), row_key(text).alias("th"), F.col(text).alias("text"))

    def cut(batches):
        for batch in batches:
            for part in pieces(batch, 2):
                doc, begin, n, mark, ctx, twice = contexts(*text_bytes(part.column(2)), length, gram)
                row = pa.array(doc)
                yield pa.RecordBatch.from_arrays([pa.array(mark.view(np.int64)), pa.array(ctx.view(np.int64)), part.column(0).take(row), part.column(1).take(row), pa.array(begin.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(twice)], names=["mark", "ctx", "id", "th", "begin", "n", "twice"])

    cuts = written(rows.mapInArrow(cut, "mark long, ctx long, id long, th long, begin int, n int, twice boolean"))
    marks = written(cuts.groupBy("mark").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("times")).where("times > 1").select("mark"))
    found = written(cuts.drop("twice").join(merged(marks), "mark"))
    for x in (cuts, marks):
        release(x)
    tidy(spark)

    once = found.groupBy("mark", "ctx").agg(F.count("*").alias("copies"), F.min(F.struct("id", "th", "begin", "n")).alias("at"))
    wanted = once.groupBy("at.id", "at.th").agg(F.collect_list(F.struct("mark", "ctx", "copies", "at.begin", "at.n")).alias("wanted"))
    wanted = wanted.withColumnsRenamed({"id": "wid", "th": "wth"})

    def take(batches):
        for batch in batches:
            for part in pieces(batch, 0):
                held = part.column(1)
                flat = held.flatten()
                texts = [t.as_py().encode() for t in part.column(0)]
                row = np.repeat(np.arange(part.num_rows), held.value_lengths().to_numpy(zero_copy_only=False))
                begin, n = flat.field("begin").to_numpy(), flat.field("n").to_numpy()
                bodies = [texts[r][b : b + m + length - 1] for r, b, m in zip(row.tolist(), begin.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([flat.field("mark"), flat.field("ctx"), flat.field("copies"), flat.field("n"), pa.array(bodies, pa.binary())], names=["mark", "ctx", "copies", "n", "body"])

    kind = "mark long, ctx long, copies long, n int, body binary"
    some = rows.join(merged(wanted), F.col("id").eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth")))
    bodies = written(some.select("id", "th", "text", "wanted").dropDuplicates(["id", "th"]).select("text", "wanted").mapInArrow(take, kind))  # of rows equal in id and text one brings them
    tidy(spark)
    by_mark = bodies.groupBy("mark").agg(F.sum(F.length("body") + 1).alias("size"), F.max("copies").alias("copies"))
    large = written(by_mark.where(F.col("size") > LARGEST).select("mark"))
    total = bodies.agg(F.sum(F.length("body"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
    small = bodies if large.isEmpty() else bodies.join(large, "mark", "left_anti")
    starts = small.repartition(parts, "mark").sortWithinPartitions("mark", "ctx").mapInArrow(lambda b: _expand(b, length), "mark long, ctx long, starts array<int>")
    if not large.isEmpty():
        starts = starts.union(_by_hash(bodies.join(large, "mark", "left_semi"), length))
    starts = written(starts)
    release(bodies)
    tidy(spark)
    shifted = F.flatten(F.transform(F.sequence(F.lit(0), F.size("starts") - 1, F.lit(2)), lambda i: F.array(F.get("starts", i) + F.col("begin"), F.get("starts", i + 1) + F.col("begin") + length)))
    spans = written(found.join(merged(starts), ["mark", "ctx"]).select("id", "th", shifted.alias("spans")).groupBy("id", "th").agg(F.flatten(F.collect_set("spans")).alias("spans")))
    release(found)
    release(starts)
    tidy(spark)
    return spans


def _by_hash(bodies: DataFrame, length: int) -> DataFrame:
    """For marks with more contexts than a task should hold: every string by its own hash, counted before the shuffle."""

    def each(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data, n = np.frombuffer(batch.column(4)[i].as_py(), np.uint8), batch.column(3)[i].as_py()
                begin = np.arange(n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, batch.column(0)[i].as_py())), pa.array(np.full(n, batch.column(1)[i].as_py())), pa.array(np.full(n, batch.column(2)[i].as_py())),
                    pa.array(begin.astype(np.int32)), pa.array(span_hash(prefix_hash(data), begin, begin + length).view(np.int64))], names=["mark", "ctx", "copies", "start", "string"])

    strings = bodies.mapInArrow(each, "mark long, ctx long, copies long, start int, string long")
    twice = written(strings.groupBy("mark", "string").agg(F.sum("copies").alias("times")).where("times > 1").select("mark", "string"))
    return strings.join(merged(twice), ["mark", "string"]).groupBy("mark", "ctx").agg(F.flatten(F.collect_list(F.array("start", "start"))).alias("starts"))


def dedup_substrings(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds kept (binary), n_bytes, n_removed and n_spans to every row of docs.

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same
    text or another; strings lie within a text and are judged on the input. kept joins the bytes
    that stay, which may begin or end inside a character; n_spans counts maximal removed runs.
    Null reads as empty; texts shorter than `length` stay whole. Every row is a text of its own, so
    repeated rows repeat each other. Ids need not be unique. Extra columns pass through, columns of
    the four names are replaced. An empty table gives an empty one.
    """
    spans = repeated_spans(docs, length, key=key, text=text).withColumnsRenamed({"id": "loomrank_sid", "th": "loomrank_sth", "spans": "loomrank_spans"})
    docs = docs.drop("kept", "n_bytes", "n_removed", "n_spans")
    joined = docs.withColumns({"loomrank_id": F.col(key).cast("long"), "loomrank_th": row_key(text)}).join(merged(spans), F.col("loomrank_id").eqNullSafe(F.col("loomrank_sid")) & (F.col("loomrank_th") == F.col("loomrank_sth")), "left").drop("loomrank_id", "loomrank_th", "loomrank_sid", "loomrank_sth")
    at, n = joined.columns.index(text), len(docs.columns)

    def remove(batches):
        for batch in batches:
            for part in pieces(batch, at):
                kept, sizes, gone, runs = [], [], [], []
                for t, s in zip(part.column(at), part.column(n)):
                    data = np.frombuffer((t.as_py() or "").encode(), np.uint8)
                    pairs = np.asarray(s.values).reshape(-1, 2) if s.is_valid else np.zeros((0, 2), np.int64)
                    depth = np.zeros(len(data) + 1, np.int64)
                    np.add.at(depth, pairs[:, 0], 1)
                    np.add.at(depth, pairs[:, 1], -1)
                    off = np.cumsum(depth)[:-1] > 0
                    kept.append(data[~off].tobytes())
                    sizes.append(len(data))
                    gone.append(int(off.sum()))
                    runs.append(int((np.diff(np.concatenate([[False], off]).astype(np.int8)) == 1).sum()))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (sizes, gone, runs))], names=[*part.schema.names[:n], "kept", "n_bytes", "n_removed", "n_spans"])

    return joined.mapInArrow(remove, widened(docs, kept="binary", n_bytes="long", n_removed="long", n_spans="long"))
