"""Near-duplicate documents: HyperMinHash registers, banding, corrected estimates, verification on full sets.

1. A document's set is its distinct k-word shingles; its registers keep, for each of 256 buckets of
   hashes, the leading zeros and 10 more bits of the smallest. Documents of equal sets form a class.
   An empty bucket stands for a filled one that is drawn for it anew in every bucket, so that each
   shingle of a small set owns its share of the bands and no more.
2. 40 bands of 5 registers deal classes to groups. A group's centre is the class that meets most
   others in all its groups: an original, from which copies stray in different ways, is such a one.
   Every class is paired with one centre, the best-connected of those it meets; pairs that survive
   by estimate are verified on the texts, and components of verified links are found.
3. Groups that still hold several components are compared in full, but only between components:
   blocks of at most BLOCK classes meet in pairs, and a task gives out pairs that all registers
   allow to be similar enough. Of each class the pairs most alike are verified first, FIRST of them,
   components are joined, and groups with pairs held back come again with GROWTH times as many
   until none is held back. Links inside a component add nothing to it, so after this no pair that
   shares a band can change the components.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import U64, merged, mix64, pieces, release, row_key, shingles, text_bytes, tidy, words, written
from .components import components

BUCKET_BITS, MANTISSA_BITS, BANDS, ROWS = 8, 10, 40, 5
BUCKETS = 1 << BUCKET_BITS
EMPTY = np.uint16(0xFFFF)
#: Chance that two different minima of a bucket leave the same register, for sets far larger than the buckets (HyperMinHash paper).
COLLISION = 0.16992 / (1 << MANTISSA_BITS)
SIGMAS, SLACK = 4.0, 0.01
FEW = 40  # shingles of the largest set that only a strict bound rules out
BLOCK = 2048
AT_ONCE = 1 << 14  # pairs that a task compares at once
TOGETHER = 1024  # rows of small cells that are looked at in one go
FIRST, GROWTH = 4, 512
NO_ID = -(1 << 63)
#: For each banded bucket all buckets in an order of its own.
DONORS = np.argsort(mix64(np.arange(BANDS * ROWS * BUCKETS, dtype=U64)).reshape(-1, BUCKETS), axis=1)


def sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, and n + 1 offsets."""
    data, off = text_bytes(texts)
    _, _, h, woff = words(data, off)
    s, soff = shingles(h, woff, k)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(soff))
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    return s[first], np.searchsorted(doc[first], np.arange(len(off)))


def classes(s: np.ndarray, off: np.ndarray) -> list[bytes | None]:
    """A 128-bit name of each set; none for an empty one."""
    total = [np.concatenate([[U64(0)], np.cumsum(mix64(s ^ U64(c)), dtype=U64)]) for c in (0x51ED270B7A9F3C15, 0x2545F4914F6CDD1D)]
    n = np.diff(off)
    pair = np.stack([mix64(t[off[1:]] - t[off[:-1]] + n.astype(U64)) for t in total], axis=1).astype(">u8")
    return [p.tobytes() if m else None for p, m in zip(pair, n)]


def registers(s: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sets x buckets: leading zeros (6 bits) over mantissa bits; EMPTY where no hash fell."""
    n = len(off) - 1
    doc = np.repeat(np.arange(n), np.diff(off))
    slot = doc * BUCKETS + (s >> U64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.ones(len(s), bool)
    first[1:] = slot[1:] != slot[:-1]  # hashes ascend, so the first of a bucket is its least
    v, slot = (s[first] << U64(BUCKET_BITS)) | U64((1 << BUCKET_BITS) - 1), slot[first]
    zeros = np.zeros(len(v), U64)
    x = v.copy()
    for step in (32, 16, 8, 4, 2, 1):
        clear = x < (U64(1) << U64(64 - step))
        zeros += np.where(clear, U64(step), U64(0))
        x = np.where(clear, x << U64(step), x)
    mantissa = (x << U64(1)) >> U64(64 - MANTISSA_BITS)
    out = np.full(n * BUCKETS, EMPTY, np.uint16)
    out[slot] = (np.minimum(zeros, U64(62)) << U64(MANTISSA_BITS) | mantissa).astype(np.uint16)
    return out.reshape(n, BUCKETS)


def bands(regs: np.ndarray) -> np.ndarray:
    """Hashes of the bands, sets x BANDS; an empty bucket takes the first filled one in its own order of all buckets."""
    n, many = len(regs), BANDS * ROWS
    filled = regs != EMPTY
    donor = np.tile(np.arange(many), (n, 1))
    row, col = np.nonzero(~filled[:, :many])
    for nth in range(BUCKETS):
        if not len(row):
            break
        from_ = DONORS[col, nth]
        ok = filled[row, from_]
        donor[row[ok], col[ok]] = from_[ok]
        row, col = row[~ok], col[~ok]
    value = np.take_along_axis(regs, donor, axis=1).astype(U64) | (donor.astype(U64) << U64(16))
    value = mix64(value + (np.arange(many, dtype=U64) << U64(40))).reshape(n, -1, ROWS).sum(axis=2, dtype=U64)
    return mix64(value + np.arange(BANDS, dtype=U64))


def least_share(used: np.ndarray, size: np.ndarray, least: float, chance: float) -> np.ndarray:
    """The share of equal registers under which a pair of Jaccard similarity `least` lies with a chance of SIGMAS deviations.

    Registers are a sample without replacement of the union, of which `size` is the sum of both sets.
    """
    whole = np.maximum(size / (1 + least), used)
    p = least + (1 - least) * chance
    return p - SLACK - SIGMAS * np.sqrt(p * (1 - p) / used * np.maximum((whole - used) / np.maximum(whole - 1, 1), chance))


def possible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows of registers may be similar enough, and their shares of equal registers; of two sets of at most FEW shingles none that is similar is ruled out.

    A shingle of both sets leaves equal registers unless a smaller one hides it in either set, and
    a set hides as many as it has more shingles than filled registers.
    """
    mine, other = a != EMPTY, b != EMPTY
    equal = ((a == b) & mine).sum(axis=1)
    used = np.maximum((mine | other).sum(axis=1), 1)
    hidden = na - mine.sum(axis=1) + nb - other.sum(axis=1)
    both = np.minimum(equal + hidden, np.minimum(na, nb))
    few = np.maximum(na, nb) <= FEW
    return np.where(few, both >= least * (na + nb - both) - 1e-9, equal / used >= least_share(used, na + nb, least, COLLISION)), equal / used


def _named(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, th, text): a null id as the least, a hash of the text; rows equal in both are one document."""
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), row_key(text).alias("th"), F.col(text).alias("text"))


def sketch(docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(id, th, n_shingles, cls, regs) of every row; cls and regs are null for a set without shingles."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 2):
                s, off = sets(part.column(2), k)
                cls = classes(s, off)
                regs = [r.tobytes() if c else None for r, c in zip(registers(s, off), cls)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(off), pa.int64()), pa.array(cls, pa.binary()), pa.array(regs, pa.binary())], names=["id", "th", "n_shingles", "cls", "regs"])

    return _named(docs, key, text).mapInArrow(run, "id long, th long, n_shingles long, cls binary, regs binary")


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), BUCKETS)


def _banded(classed: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                keys = bands(matrix(part.column(1)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), BANDS)))], names=["band", "cls"])

    return classed.select("cls", "regs").mapInArrow(run, "band long, cls binary")


def _met(before: np.ndarray, regs: np.ndarray, root: np.ndarray, n: np.ndarray, low: np.ndarray, high: np.ndarray, part: int, whole: int):
    """(p, q, share) of the pairs of each row p with rows q of low[p]..high[p] - 1 that may be similar enough, of two roots, and without a band of `before` in common."""
    many = np.maximum(high - low, 0)
    some = np.flatnonzero(many)
    total, begin = np.cumsum(many[some]), 0
    while begin < len(some):
        stop = max(begin + 1, int(total.searchsorted((total[begin - 1] if begin else 0) + AT_ONCE, "right")))
        rows, begin = some[begin:stop], stop
        count = many[rows]
        p, q = np.repeat(rows, count), np.arange(count.sum()) + np.repeat(low[rows] - (np.cumsum(count) - count), count)
        ok = (root[p] != root[q]) & (whole * np.minimum(n[p], n[q]) >= part * np.maximum(n[p], n[q]))
        p, q = p[ok], q[ok]
        if before.shape[1]:
            new = ~(before[p] == before[q]).any(axis=1)
            p, q = p[new], q[new]
        ok, share = possible(regs[p], regs[q], n[p], n[q], part / whole)
        yield p[ok], q[ok], share[ok]


def _cell_pairs(x: pa.Table, part: int, whole: int, most: int):
    """Of the rows (band, i, j, side, root, n, cls, regs) of whole cells: pairs (x, y, share, held) between roots.

    Where i and j name one block all rows of the cell meet, else those of one side meet those of the other.
    A pair is looked at in the first band that its classes share. x is the class whose component has
    fewer rows in the cell; of each x the `most` pairs with the largest shares are given out, and
    held says whether more were found.
    """
    band, i, j, side = (x[c].to_numpy() for c in ("band", "i", "j", "side"))
    cell = np.cumsum(np.append(False, (band[1:] != band[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    order = np.lexsort((np.where(i == j, 0, side), cell))
    x, band, i, j, side, cell = x.take(pa.array(order)), band[order], i[order], j[order], side[order], cell[order]
    regs, cls = matrix(x["regs"].combine_chunks()), x["cls"].combine_chunks()
    root, n = x["root"].combine_chunks().dictionary_encode().indices.to_numpy(), x["n"].to_numpy()
    size, at = len(x), np.arange(len(x))
    end = np.searchsorted(cell, cell, "right")
    own = np.searchsorted(2 * cell + (side != side[np.searchsorted(cell, cell)]), 2 * cell, "right")  # of two blocks, where the second begins
    low, high = np.where(i == j, at + 1, own), np.where((i == j) | (at < own), end, 0)
    keys = bands(regs)
    mine = (keys == band.view(U64)[:, None]).argmax(axis=1)
    before = np.where(np.arange(mine.max()) < mine[:, None], keys[:, : mine.max()], at.astype(U64)[:, None])  # from its own band on nothing is common
    a, b, share = (np.concatenate(c) for c in zip(*_met(before, regs, root, n, low, high, part, whole), [np.zeros(0, np.int64)] * 3))
    _, of, count = np.unique(cell * (root.max() + 1) + root, return_inverse=True, return_counts=True)
    often = count[of]
    swap = (often[a] > often[b]) | ((often[a] == often[b]) & (root[a] > root[b]))
    a, b = np.where(swap, b, a).astype(np.int64), np.where(swap, a, b).astype(np.int64)
    order = np.lexsort((b, -share, a))
    a, b, share = a[order], b[order], share[order]
    new = np.append(True, a[1:] != a[:-1])[: len(a)]
    nth = np.arange(len(a)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    keep = nth < most
    held = (np.bincount(a, minlength=size) > most)[a]
    return pa.RecordBatch.from_arrays([
        pa.array(band[a[keep]]), cls.take(pa.array(a[keep])), cls.take(pa.array(b[keep])),
        pa.array(share[keep].astype(np.float64)), pa.array(held[keep])], names=["band", "x", "y", "share", "held"])


def _pairs_of_cells(batches, part: int, whole: int, most: int):
    """Rows in order of (band, i, j); a cell holds at most two blocks, and small cells are looked at together."""
    held = None
    for batch in batches:
        x = pa.Table.from_batches([batch])
        x = x if held is None else pa.concat_tables([held, x])
        names = np.stack([x[c].to_numpy() for c in ("band", "i", "j")])
        edge = np.flatnonzero((names[:, 1:] != names[:, :-1]).any(axis=0)) + 1
        begin = 0
        for a, b in zip([0, *edge[:-1]], edge):
            if b - begin > TOGETHER:
                if a > begin:
                    yield _cell_pairs(x.slice(begin, a - begin), part, whole, most)
                begin = a
        if len(edge) and edge[-1] > begin:
            yield _cell_pairs(x.slice(begin, edge[-1] - begin), part, whole, most)
        held = x.slice(edge[-1] if len(edge) else 0)
    if held is not None and len(held) > 1:
        yield _cell_pairs(held, part, whole, most)


def _between(members: DataFrame, roots: DataFrame, classed: DataFrame, part: int, whole: int, most: int) -> DataFrame:
    """(band, x, y, share, held, nth) of pairs between components that may be similar enough, `most` for each x.

    Where a group has more than BLOCK classes, those of its most frequent component, which needn't
    meet each other, are dealt to blocks of their own.
    """
    inside = written(members.select("band", "cls").join(merged(roots.withColumnRenamed("v", "cls")), "cls", "left").select("band", "cls", F.coalesce("root", "cls").alias("root")))
    of_root = inside.groupBy("band", "root").agg(F.count("*").alias("many"))
    counted = written(of_root.groupBy("band").agg(F.max(F.struct("many", "root")).alias("main"), F.sum("many").alias("many"), F.count("*").alias("roots")).where("roots > 1").select("band", "main", "many"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    x = inside.join(merged(counted), "band").withColumns({"big": F.col("many") > BLOCK, "own": F.col("root") == F.col("main.root")})
    x = x.withColumns({"mains": blocks(F.col("main.many")), "others": blocks(F.col("many") - F.col("main.many"))})
    block = F.when(F.col("own"), F.col("others") + F.pmod(F.xxhash64("cls"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("cls"), F.col("others"))).cast("int")
    x = x.withColumn("side", F.when(F.col("big"), block).otherwise(0))
    meets = F.when(~F.col("big"), F.array(F.lit(0))).when(F.col("own"), F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))
    x = x.join(merged(classed.select("cls", "n", "regs")), "cls").select("band", "side", "root", "n", "cls", "regs", F.explode(meets).alias("other"))
    x = x.select("band", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "root", "n", "cls", "regs")
    parts = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    found = x.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(lambda b: _pairs_of_cells(b, part, whole, most), "band long, x binary, y binary, share double, held boolean")
    # at most BANDS * `most` of a class for each block it meets
    out = written(found.withColumn("nth", F.row_number().over(W.partitionBy("x").orderBy(F.col("share").desc(), "y"))))
    release(inside)
    release(counted)
    return out


def _plausible(pairs: DataFrame, classed: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) that their registers, corrected for those that agree by chance, don't rule out."""
    side = lambda c: classed.select(F.col("cls").alias(c), F.col("regs").alias(f"r{c}"), F.col("n").alias(f"n{c}"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(at, AT_ONCE)
                keep, _ = possible(matrix(some.column(2)), matrix(some.column(3)), some.column(4).to_numpy(), some.column(5).to_numpy(), least)
                yield some.select(["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(merged(side("a")), "a").join(merged(side("b")), "b").select("a", "b", "ra", "rb", "na", "nb")
    return joined.mapInArrow(run, "a binary, b binary")


def _verified(pairs: DataFrame, docs: DataFrame, classed: DataFrame, k: int, part: int, whole: int, key: str, text: str) -> DataFrame:
    """Pairs whose sets, made anew from the texts, have whole * intersection >= part * union."""
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    need = wanted.join(merged(classed.select("cls", "at")), "cls").select("at.id", "at.th")
    mine = _named(docs, key, text).join(merged(need), ["id", "th"], "left_semi").select("text")

    def name(batches):
        for batch in batches:
            for some in pieces(batch, 0):
                yield pa.RecordBatch.from_arrays([pa.array(classes(*sets(some.column(0), k)), pa.binary()), some.column(0)], names=["cls", "text"])

    # rows equal in id and text bring the text again
    texts = written(mine.mapInArrow(name, "cls binary, text string").where("cls IS NOT NULL").dropDuplicates(["cls"]))

    def check(batches):
        for batch in batches:
            for some in pieces(batch, 2, 512 << 10):
                (x, xo), (y, yo) = sets(some.column(2), k), sets(some.column(3), k)
                nx, ny = np.diff(xo), np.diff(yo)
                row = np.arange(some.num_rows)
                allof, rows = np.concatenate([x, y]), np.concatenate([np.repeat(row, nx), np.repeat(row, ny)])
                order = np.lexsort((allof, rows))
                s, r = allof[order], rows[order]
                twice = (s[1:] == s[:-1]) & (r[1:] == r[:-1])
                both = np.bincount(r[1:][twice], minlength=some.num_rows)
                yield some.select(["a", "b"]).filter(pa.array(whole * both >= part * (nx + ny - both)))

    side = lambda c: texts.select(F.col("cls").alias(c), F.col("text").alias(f"t{c}"))
    joined = pairs.join(merged(side("a")), "a").join(merged(side("b")), "b").select("a", "b", "ta", "tb")
    links = written(joined.mapInArrow(check, "a binary, b binary"))
    release(texts)
    tidy(docs.sparkSession)
    return links


def near_duplicates(docs: DataFrame, k: int = 5, part: int = 80, whole: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, th, n_shingles, root, component_id) for every row of docs; component_id is the least id reachable by links, th a hash of the text.

    root names the component itself, which ids can't where they are null or repeated; it is null for
    a text without words.

    Words are runs of anything but ASCII white space, A to Z lower-cased; a text of fewer than k
    words is one shingle; null texts and texts without words have none and are linked with nothing.
    Two documents are linked if whole * intersection >= part * union on their full sets. A pair at
    similarity s shares no band with a chance of (1 - s^5)^40: 2e-7 at 0.8, 7e-11 at 0.85; sets of few
    shingles are no exception. The estimate drops a true link of larger sets SIGMAS deviations off.

    A null id counts as smaller than any other. Repeated rows are linked with each other, as equal
    sets are, and are looked at once. Ids need not be unique. An empty table gives no rows; extra
    columns are ignored.
    """
    spark = docs.sparkSession
    sketched = written(sketch(docs, k, key, text))
    classed = written(sketched.where("cls IS NOT NULL").groupBy("cls").agg(F.min(F.struct("id", "th")).alias("at"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs")))
    all_docs = written(sketched.select("id", "th", "n_shingles", "cls"))
    release(sketched)
    tidy(spark)
    banded = _banded(classed)
    shared = written(banded.groupBy("band").agg(F.count("*").alias("many")).where("many > 1"))
    members = written(banded.join(merged(shared), "band"))
    release(shared)
    weight = members.groupBy("cls").agg(F.sum("many").alias("weight"))
    weighed = written(members.join(merged(weight), "cls").select("band", "cls", "weight"))
    release(members)
    members = weighed
    tidy(spark)
    centres = members.groupBy("band").agg(F.max(F.struct("weight", "cls")).alias("centre"))
    met = members.join(merged(centres), "band").where("cls <> centre.cls").groupBy("cls").agg(F.max("centre").alias("centre"))
    pairs = met.select(F.least("cls", "centre.cls").alias("a"), F.greatest("cls", "centre.cls").alias("b")).distinct()
    tried = written(_plausible(pairs, classed, part / whole))
    tidy(spark)
    links = [_verified(tried, docs, classed, k, part, whole, key, text)]
    roots = components(links[0])
    open_, most, scratch = members, FIRST, [members, tried, *links]
    while True:
        found = _between(open_, roots, classed, part, whole, most)
        tidy(spark)
        new = written(found.where(F.col("nth") <= most).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(merged(tried), ["a", "b"], "left_anti"))
        if not new.isEmpty():
            links.append(_verified(new, docs, classed, k, part, whole, key, text))
            if not links[-1].isEmpty():
                release(roots)
                roots = components(reduce(DataFrame.union, links))
        scratch += [found, new, links[-1]]
        held = written(found.where((F.col("nth") > most) | F.col("held")).select("band").distinct())
        scratch.append(held)
        if held.isEmpty():
            break
        tried, open_, most = tried.union(new), members.join(merged(held), "band", "left_semi"), most * GROWTH
    tidy(spark)
    grouped = classed.select("cls", "at.id").join(merged(roots.withColumnRenamed("v", "cls")), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = written(grouped.groupBy("root").agg(F.min("id").alias("component_id")))
    named = written(grouped.join(merged(least), "root").select("cls", "root", "component_id"))
    for x in {x._scratch: x for x in [*scratch, least, classed, roots]}.values():
        release(x)
    tidy(spark)
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    told = all_docs.join(merged(named), "cls", "left").withColumn("component_id", F.coalesce("component_id", "id"))
    return told.select(null("id").alias("id"), "th", "n_shingles", "root", null("component_id").alias("component_id"))
