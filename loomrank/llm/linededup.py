"""Line dedup by winnowing over line hashes.

A document's lines that aren't blank, trimmed, are a sequence of hashes. Of every window of `run`
lines the line of the least hash, the leftmost of equal ones, is selected as a fingerprint; a place
selected by several windows is one fingerprint. Two places that share `run` lines or more are
guaranteed to share one. Positions of fingerprints that come again are joined and extended both
ways: the windows that selected them, which reach up to run - 1 lines to either side, are matched
whole, and matched windows that overlap make maximal runs. All but the first of each run, by (id,
place), is deleted. Where asked for, so are single lines of many words that repeat, whatever their
neighbours are; they are windows of one line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, U64, merged, mix64, pieces, prefix_hash, release, row_key, span_hash, text_bytes, tidy, words, written

RUN = 2


def lines(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines that aren't blank: text, number in the text, hash of the trimmed line."""
    solid = np.flatnonzero(~_SPACE[data])
    if not len(solid):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U64)
    breaks = np.cumsum(data == 10)[solid]  # line breaks before
    doc = np.searchsorted(off, solid, "right") - 1
    first = np.ones(len(solid), bool)
    first[1:] = (breaks[1:] != breaks[:-1]) | (doc[1:] != doc[:-1])
    begin = solid[first]
    end = solid[np.append(np.flatnonzero(first)[1:] - 1, len(solid) - 1)] + 1
    total = np.concatenate([[0], np.cumsum(data == 10)])
    return doc[first], breaks[first] - total[off[:-1]][doc[first]], span_hash(prefix_hash(data), begin, end)


def fingerprints(doc: np.ndarray, h: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Selected lines in order, n + 1 offsets into the windows that selected them, and first line and hash of all lines of each window."""
    n = len(h) - run + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z, np.zeros(1, np.int64), z, np.zeros(0, U64)
    at = np.flatnonzero(doc[:n] == doc[run - 1 :])
    least, chosen, whole = h[at].copy(), at.copy(), np.zeros(len(at), U64)
    for j in range(run):
        less = h[at + j] < least
        least[less], chosen[less] = h[at + j][less], (at + j)[less]
        whole = mix64(whole * U64(3) + h[at + j])
    new = np.flatnonzero(np.append(True, chosen[1:] != chosen[:-1])) if len(at) else at  # minima of sliding windows never go back
    return chosen[new], np.append(new, len(at)), at, whole


def line_words(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of words of every line that isn't blank, in the order of lines()."""
    begin, _, _, woff = words(data, off)
    line = np.cumsum(data == 10)[begin] if len(begin) else begin
    doc = np.repeat(np.arange(len(off) - 1), np.diff(woff))
    first = np.ones(len(begin), bool)
    first[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(np.cumsum(first) - 1)


def repeated(docs: DataFrame, run: int = RUN, key: str = "doc_id", text: str = "text", alone: int | None = None) -> DataFrame:
    """(id, hash of the text, numbers of the lines to delete) of every document that loses some."""
    rows = docs.select(F.col(key).cast("long").alias("id"), row_key(text).alias("th"), F.col(text).alias("text"))

    def cut(batches):
        for batch in batches:
            for part in pieces(batch, 2):
                data, off = text_bytes(part.column(2))
                doc, nth, h = lines(data, off)
                found = [(run, *fingerprints(doc, h, run))]
                if alone is not None:
                    at = np.flatnonzero(line_words(data, off) >= alone)
                    found.append((1, at, np.arange(len(at) + 1), at, mix64(h[at] + U64(1))))
                for many, chosen, ends, at, whole in found:
                    raw = nth[at[:, None] + np.arange(many)[None, :]].astype(np.int32)
                    held = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * many), pa.array(raw.reshape(-1)))
                    around = pa.StructArray.from_arrays([pa.array(whole.view(np.int64)), held], names=["whole", "held"])
                    row = pa.array(doc[chosen])
                    yield pa.RecordBatch.from_arrays([pa.array(h[chosen].view(np.int64)), part.column(0).take(row), part.column(1).take(row), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), around)], names=["mark", "id", "th", "around"])

    cuts = written(rows.mapInArrow(cut, "mark long, id long, th long, around array<struct<whole:long,held:array<int>>>"))
    marks = written(cuts.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark"))
    near = written(cuts.join(merged(marks), "mark").select("mark", "id", "th", F.explode("around").alias("x")).select("mark", "id", "th", "x.*"))
    place = F.struct("id", "th", F.col("held")[0].alias("line"))
    first = written(near.groupBy("mark", "whole").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = near.join(merged(first), ["mark", "whole"]).where(~place.eqNullSafe(F.col("first")))
    gone = written(later.groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_set("held"))).alias("gone")))
    for x in (cuts, marks, near, first):
        release(x)
    tidy(docs.sparkSession)
    return gone


def dedup_lines(docs: DataFrame, run: int = RUN, key: str = "doc_id", text: str = "text", out: str | None = None, counts: bool = False, alone: int | None = None) -> DataFrame:
    """docs with the later of all runs of `run` or more equal lines deleted from text (or put in column `out`).

    Lines end at \\n and are compared without white space at their ends; blank lines are no part of
    a run and stay. What stands first is what has the smaller (id, hash of text, line); a null id is
    smallest. Rows equal in id and text are one document and are treated alike, so none takes the
    other's lines. Null and empty texts stay as they are, as do texts of fewer than `run` lines.
    With alone, later ones of equal single lines of at least that many words go too.
    With counts, columns n_lines and n_removed are added (all lines, also blank ones; 0 for null),
    and columns of these names are replaced. Other columns pass through. An empty table gives an empty one. Texts are shuffled once, to
    meet the numbers of their deleted lines.
    """
    gone = repeated(docs, run, key, text, alone)
    mine = docs.withColumns({"loomrank_id": F.col(key).cast("long"), "loomrank_th": row_key(text)})
    x = mine.join(merged(gone.withColumnsRenamed({"id": "loomrank_gid", "th": "loomrank_gth", "gone": "loomrank_gone"})), F.col("loomrank_id").eqNullSafe(F.col("loomrank_gid")) & (F.col("loomrank_th") == F.col("loomrank_gth")), "left")
    split = F.split(F.col(text), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("loomrank_gone"))
    kept = F.when(F.col("loomrank_gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get(split, i)), "\n"))
    if counts:
        x = x.withColumns({"n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(split)).cast("long"), "n_removed": F.coalesce(F.size("loomrank_gone"), F.lit(0)).cast("long")})
        x = x.withColumn("n_removed", F.greatest(F.col("n_removed"), F.lit(0).cast("long")))
    return x.withColumn(out or text, kept).drop("loomrank_id", "loomrank_th", "loomrank_gid", "loomrank_gth", "loomrank_gone")


def lines_sql(run: int = RUN, table: str = "documents") -> str:
    """Per document n_lines, n_removed and the kept text in DuckDB SQL."""
    whole = " || chr(10) || ".join(["l"] + [f"lead(l, {j}) OVER w" for j in range(1, run)])
    return f"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM {table} WHERE text IS NOT NULL),
s AS (SELECT doc_id, nth, regexp_replace(raw, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS l FROM l),
g AS (SELECT doc_id, nth, row_number() OVER w AS seq, {whole} AS whole FROM s WHERE l <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY nth)),
f AS (SELECT doc_id, seq, row_number() OVER (PARTITION BY whole ORDER BY doc_id, nth) AS r FROM g WHERE whole IS NOT NULL),
k AS (SELECT DISTINCT g.doc_id, g.nth FROM f JOIN g ON f.doc_id = g.doc_id AND f.r > 1 AND g.seq BETWEEN f.seq AND f.seq + {run - 1}),
t AS (SELECT l.doc_id, count(*) AS n_lines, count(k.nth) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY l.nth) FILTER (k.nth IS NULL), '') AS kept
      FROM l LEFT JOIN k ON l.doc_id = k.doc_id AND l.nth = k.nth GROUP BY l.doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM {table} LEFT JOIN t USING (doc_id)
"""
