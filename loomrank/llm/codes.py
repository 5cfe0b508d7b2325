"""Product codes of vectors: Lloyd's rounds over the distinct integer parts of each position, weighted by how often they stand."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import merged, release, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: A part that more than 1 / HOT of the vectors share; there are at most PARTS * HOT of them, whose codes are broadcast.
HOT = 1000
#: Components up to here are squared and summed in 64-bit floats or integers without loss; beyond it Python's own integers are taken.
FLOAT_LIMIT, INT_LIMIT = 1 << 53, 1 << 62
LONG = (1 << 63) - 1


def floored(v: Column) -> Column:
    """Components as multiples of 1 / SCALE, floor(SCALE * x) / SCALE, as doubles; from 2^52 on every double is one already."""
    return F.transform(v, lambda x: F.when(F.abs(x) < float(1 << 52), F.floor(x * float(SCALE)) / float(SCALE)).otherwise(x))


def integers(parts: np.ndarray) -> np.ndarray:
    """SCALE times the components: as 64-bit integers, or as Python's where they are larger."""
    if not parts.size or np.abs(parts).max() < 1 << 40:
        return (parts * SCALE).astype(np.int64)
    return np.array([[int(x) * SCALE if abs(x) >= 1 << 52 else int(x * SCALE) for x in row] for row in parts.tolist()], object)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Index of each row's nearest entry, ties to the lower one, and its squared Euclidean distance, exactly."""
    most = max((int(abs(a).max()) for a in (x, book) if a.size), default=0)
    bound = 4 * most * most * max(1, x.shape[1])
    kind = np.float64 if bound < FLOAT_LIMIT else np.int64 if bound < INT_LIMIT else object
    code, error = np.zeros(len(x), np.int64), []
    book = book.astype(kind)
    squares = (book * book).sum(axis=1)
    for at in range(0, len(x), 4096):
        y = x[at : at + 4096].astype(kind)
        # the row's own square is the same for all entries
        rest = squares[None, :] - 2 * y.dot(book.T)
        best = np.array([min(range(len(r)), key=r.__getitem__) for r in rest.tolist()], np.int64) if kind is object else rest.argmin(axis=1)
        code[at : at + 4096] = best
        error += [int(e) for e in rest[np.arange(len(y)), best] + (y * y).sum(axis=1)]
    return code, error


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, flat.size // max(1, n))


def _by_position(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, rows of the batch, their parts as integers)."""
    pos, parts = batch.column("pos").to_numpy(), _matrix(batch.column("part"), batch.num_rows)
    for p in np.unique(pos):
        at = np.flatnonzero(pos == p)
        yield int(p), at, integers(parts[at])


def _sums(distinct: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """(pos, entry, n, total): how many parts an entry is nearest to, and their componentwise sum, merged from a row a task. Sums travel as decimal text, as they may pass a long."""
    kind = "pos int, entry int, n long, total array<string>"

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            weight = batch.column("weight").to_numpy()
            for p, at, x in _by_position(batch):
                code, _ = nearest(x, books[p])
                w = weight[at]
                if x.dtype != object and float(np.abs(x).max(initial=0)) * float(w.sum()) >= INT_LIMIT:
                    x, w = x.astype(object), w.astype(object)
                order = np.argsort(code, kind="stable")
                entries, first = np.unique(code[order], return_index=True)
                totals = np.add.reduceat((x * w[:, None])[order], first, axis=0)
                counts = np.add.reduceat(w[order], first)
                for e, n, t in zip(entries, counts, totals):
                    have = found.setdefault((p, int(e)), [0, [0] * x.shape[1]])
                    have[0] += int(n)
                    have[1] = [a + int(b) for a, b in zip(have[1], t)]
        rows = [(p, e, n, [str(a) for a in t]) for (p, e), (n, t) in found.items()]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())))], ["pos", "entry", "n", "total"])

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        total = [str(sum(int(t[i]) for t in rows["total"].to_pylist())) for i in range(len(rows["total"][0]))]
        return pa.table({"pos": rows["pos"].slice(0, 1), "entry": rows["entry"].slice(0, 1), "n": pa.array([sum(rows["n"].to_pylist())], pa.int64()), "total": pa.array([total], pa.list_(pa.string()))})

    return distinct.mapInArrow(local, kind).groupBy("pos", "entry").applyInArrow(merge, kind)


def _coded(distinct: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """Distinct parts with the index of their nearest entry and the squared distance, at most the largest long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, object)
            for p, at, x in _by_position(batch):
                code[at], error[at] = nearest(x, books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.int32()), pa.array([min(e, LONG) for e in error], pa.int64())], [*batch.schema.names, "entry", "off"])

    return distinct.mapInArrow(run, "pos int, part array<double>, weight long, entry int, off long")


def codebooks_digest(books: dict[int, np.ndarray]) -> str:
    """SHA-256 of all components by position, entry and place, as decimals joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for p in sorted(books) for row in books[p] for x in row).encode()).hexdigest()


def train(distinct: DataFrame, books: dict[int, np.ndarray], rounds: int = ROUNDS) -> dict[int, np.ndarray]:
    """Codebooks after so many of Lloyd's rounds over weighted distinct rows (pos, part, weight).

    A round moves every entry to the componentwise floor of the mean of the parts nearest to it;
    unused entries stay. What comes to the driver is a row an entry.
    """
    for _ in range(rounds):
        books = {p: list(b) for p, b in books.items()}
        for r in _sums(distinct, {p: np.array(b) for p, b in books.items()}).collect():
            books[r.pos][r.entry] = [int(t) // r.n for t in r.total]
        books = {p: np.array([list(map(int, row)) for row in b], object) for p, b in books.items()}
        if all(abs(b).max(initial=0) < 1 << 62 for b in books.values()):
            books = {p: b.astype(np.int64) for p, b in books.items()}
    return books


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Codes of all vectors that are complete: (id, label, code, error, label_error, codebooks_sha256).

    Components become floor(1024 x), a vector is cut into `parts` equal consecutive parts, and the
    codebook of each position starts as that part of the `entries` rows of smallest (id, vector), null
    ids last. code has two hex digits a part (more where entries don't fit), error is the squared
    distance summed over parts, label_error the errors summed over equal labels.

    Equal parts of a position become one row with their number as weight, so Lloyd's rounds cost
    what the distinct parts cost, whatever share of the vectors repeats one; sums of entries are
    merged in tasks first, and 256 * parts rows come to the driver. Codes and errors are joined back
    by part: those that more than 1 / HOT of the vectors share, of which there are at most parts * HOT,
    by a broadcast, all others by a merge; sums of labels likewise.

    Rows of a null vector, or one with null, NaN or infinite components, are left out. The length is
    that of most vectors that parts divides, ties to the longer; complete vectors of another length
    have null code and error. Errors beyond a long are shown as the largest long. Fewer rows than entries
    give smaller codebooks; no rows give none. Repeated rows are coded each and weigh each. Null
    labels are one label. Other columns don't matter; id and label keep their values.
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = written(vectors.where(fine).select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), F.size(v).alias("d"), floored(v).alias("v")))
    sizes = rows.where(F.col("d") % parts == 0).groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    d, total = (sizes.d, sizes["count"]) if sizes else (0, 0)
    wide = d // parts
    fit = rows.where((F.col("d") == d) & F.lit(sizes is not None))
    first = [r.v for r in fit.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()]
    books = {p: integers(np.array([x[p * wide : (p + 1) * wide] for x in first], np.float64).reshape(len(first), wide)) for p in range(parts)} if first else {}
    cut = fit.select("row", F.explode(F.array(*[F.struct(F.lit(p).alias("pos"), F.slice("v", p * wide + 1, wide).alias("part")) for p in range(parts)])).alias("x")).select("row", "x.pos", "x.part")
    distinct = written(cut.groupBy("pos", "part").agg(F.count("*").alias("weight")))
    books = train(distinct, books, rounds if first else 0)
    coded = written(_coded(distinct, books)) if first else distinct.select("*", F.lit(0).alias("entry"), F.lit(0).cast("long").alias("off"))
    one = _looked_up(cut, coded.drop("weight"), coded.where(F.col("weight") * HOT > total), ["pos", "part"])
    digits = max(2, len(f"{entries - 1:x}"))
    seats = F.array_sort(F.collect_list(F.struct("pos", F.lpad(F.lower(F.hex("entry")), digits, "0").alias("hex"))))
    whole_sum = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    wide_sum = lambda c: F.when(whole_sum(c) <= F.lit(LONG), whole_sum(c)).when(whole_sum(c) > F.lit(LONG), F.lit(LONG)).cast("long")
    codes = one.groupBy("row").agg(F.array_join(F.transform(seats, lambda s: s["hex"]), "").alias("code"), wide_sum("off").alias("error"))
    same = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))  # null is a label like others
    out = written(rows.select("row", "id", "label", same.alias("same")).join(merged(codes), "row", "left"))
    for x in (rows, distinct, *([coded] if first else [])):
        release(x)
    sums = out.groupBy("same").agg(wide_sum("error").alias("label_error"), F.count("*").alias("weight"))
    joined = _looked_up(out, sums.drop("weight"), sums.where(F.col("weight") * HOT > out.count()), ["same"])
    return joined.select("id", "label", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def _looked_up(rows: DataFrame, values: DataFrame, often: DataFrame, on: list[str]) -> DataFrame:
    """rows with the columns of values, one row of which each has: by a broadcast of those that are met often, of a proven number, and by a merge for all others."""
    told = [*on, *[c for c in values.columns if c not in on]]
    near = rows.join(F.broadcast(often.select(*told, F.lit(True).alias("_often"))), on, "left")
    far = near.where("_often IS NULL").select(*rows.columns).join(merged(values.select(*told)), on)
    return near.where("_often").drop("_often").unionByName(far)


def codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same in DuckDB, of vectors of 64 components of moderate size."""
    wide = 64 // parts
    out = f"""WITH r AS (SELECT row_number() OVER () AS i, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT i, pos, v[pos * {wide} + 1:pos * {wide} + {wide}] AS x FROM r, (SELECT unnest(range({parts})) AS pos)),
f AS (SELECT i, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM r ORDER BY vec_id, v LIMIT {entries}),
b0 AS MATERIALIZED (SELECT pos, e, x AS c FROM p JOIN f USING (i))"""
    near = "SELECT i, pos, any_value(x) AS x, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT i, p.pos, x, e, list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS d FROM p JOIN {b} b USING (pos)) GROUP BY i, pos"
    for k in range(rounds):
        out += f""",
a{k} AS MATERIALIZED ({near.format(b=f'b{k}')}),
m{k} AS (SELECT pos, e, list(y ORDER BY j) AS c FROM (SELECT pos, e, j, floor(sum(x[j]) / count(*)) AS y FROM a{k}, (SELECT unnest(range(1, {wide + 1})) AS j) GROUP BY pos, e, j) GROUP BY pos, e),
b{k + 1} AS MATERIALIZED (SELECT pos, e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m USING (pos, e))"""
    return out + f""",
z AS ({near.format(b=f'b{rounds}')}),
o AS (SELECT i, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' ORDER BY pos) AS code, sum(d)::BIGINT AS error FROM z GROUP BY i),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda y: y::BIGINT::VARCHAR), ','), ',' ORDER BY pos, e)) AS h FROM b{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM r JOIN o USING (i), h"""
