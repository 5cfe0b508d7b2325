"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed n-grams of 1 to 3 lower-cased characters; document frequencies are counted over
all rows that may be learned from. The classifier is fitted by follow-the-regularised-leader with an
elastic-net penalty on a bounded sample, SAMPLE rows a language (those of smallest hashed id and
text), of which one in five calibrates the temperature.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mix64, pieces, widened

BITS = 15
SAMPLE = 600
MOST_LANGS = 200  # the model has a column for each
UNKNOWN = "und"
_K = mix64(np.arange(1, 4, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's n-grams and how often each comes."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    shift = np.uint32(32 - BITS)
    total = np.zeros(1 << BITS, np.int64)
    h = np.zeros(0, np.uint32)
    for n in (1, 2, 3):
        if len(c) < n:
            break
        h = (c if n == 1 else (h[:-1] ^ (h[:-1] >> np.uint32(15)))) * _K[n - 1] + (c[n - 1 :] * _K[(n + 1) % 3] if n > 1 else np.uint32(n))
        x = h ^ (h >> np.uint32(16))
        total += np.bincount((x * _K[0]) >> shift, minlength=1 << BITS)
    at = np.flatnonzero(total)
    return at, total[at]


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sparse TF-IDF of unit length, with 1 + ln tf."""
    at, n = grams(text)
    v = (1.0 + np.log(n)) * idf[at]
    return at, v / max(float(np.sqrt((v * v).sum())), 1e-12)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float

    def logits(self, text: str) -> np.ndarray:
        at, v = vector(text, self.idf)
        return v @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its calibrated probability; `und` and 0 without any letter."""
        if text is None or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3, epochs: int = 3, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal, one row at a time; weights are made from the sums z and n only where touched."""
    z = np.zeros(((1 << BITS) + 1, n_langs))
    n = np.zeros_like(z)

    def weights(at: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, v, y = rows[i]
            at, v = np.append(at, 1 << BITS), np.append(v, 1.0)  # the last is the bias
            w = weights(at)
            p = softmax(v @ w)
            p[y] -= 1.0
            g = v[:, None] * p[None, :]
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        p = softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())

    low, high, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4, is 2; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits a model on rows of docs (doc_id, text, lang) that aren't held out.

    Document frequencies come from all of them, each text counted whole, summed by bucket in Spark
    (2^BITS sums come to the driver). The classifier sees at most `sample` rows a language, drawn by
    a hash of id and text, so ids may be null or repeated; rows equal in both and lang teach once. A
    language name is any non-null value of lang; rows without a letter teach nothing. Without rows
    the model knows no language and predicts `und`. More than MOST_LANGS languages are an error, as
    model and sample grow with their number.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))

    def count(batches):
        total = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for part in pieces(batch, 0):
                for text in part.column(0):
                    if has_letter(t := text.as_py()):
                        total[grams(t)[0]] += 1
                        total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    counts = rows.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros((1 << BITS) + 1)
    df[counts["bucket"].to_numpy(np.int64)] = counts["n"].to_numpy(float)
    idf = np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 1.0

    # rows are drawn by a uniform hash; a bound on it that leaves some four times the sample of each language goes before the window, so that no task ranks a whole language
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(1), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 11) / float(1 << 53)
    drawn = rows.select("lang", "text", draw.alias("draw"))
    # a row a language: without a broadcast the rows themselves would be dealt by language
    many = drawn.groupBy("lang").agg(F.approx_count_distinct("draw").alias("many")).limit(MOST_LANGS + 1).toPandas()
    if len(many) > MOST_LANGS:
        raise ValueError(f"lang has more than {MOST_LANGS} values")
    bound = docs.sparkSession.createDataFrame([(str(x), int(n)) for x, n in zip(many["lang"], many["many"])], "lang string, many long")
    near = drawn.join(F.broadcast(bound), "lang").where(F.col("draw") * F.col("many") <= 4 * sample).dropDuplicates(["lang", "draw"])
    picked = near.withColumn("nth", F.row_number().over(W.partitionBy("lang").orderBy("draw"))).where(F.col("nth") <= sample).select("draw", "lang", "text")

    def featurize(batches):
        for batch in batches:
            for part in pieces(batch, 2):
                keep = [i for i, t in enumerate(part.column(2)) if has_letter(t.as_py())]
                xs = [vector(part.column(2)[i].as_py(), idf) for i in keep]
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(keep, pa.int64())), part.column(1).take(pa.array(keep, pa.int64())),
                    pa.array([x[0].astype(np.int32) for x in xs], pa.list_(pa.int32())), pa.array([x[1].astype(np.float32) for x in xs], pa.list_(pa.float32()))],
                    names=["draw", "lang", "at", "v"])

    got = picked.mapInArrow(featurize, "draw double, lang string, at array<int>, v array<float>").toArrow().to_pydict()
    langs = sorted(set(got["lang"]))
    seat = {x: i for i, x in enumerate(langs)}
    order = sorted(range(len(got["lang"])), key=lambda i: (got["draw"][i], got["lang"][i]))
    per: dict[str, int] = {}
    teach, check = [], []
    for i in order:
        lang = got["lang"][i]
        per[lang] = per.get(lang, 0) + 1
        row = np.array(got["at"][i], np.int64), np.array(got["v"][i], np.float64), seat[lang]
        (check if per[lang] % 5 == 0 else teach).append(row)
    if not teach:
        return Model([], idf, np.zeros((1 << BITS, 0)), np.zeros(0), 1.0)
    w, b = fit(teach, len(langs))
    z = np.array([v @ w[at] + b for at, v, _ in check]).reshape(len(check), len(langs))
    return Model(langs, idf, w, b, temperature(z, np.array([y for *_, y in check], np.int64)))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and lang_score from the whole text alone; other columns pass through, columns of these two names are replaced.

    Null texts, and texts without a letter, get `und` and 0. A map over partitions: the model (2^BITS
    rows by the number of languages) goes with the tasks, no shuffle.
    """
    docs = docs.drop("lang_pred", "lang_score")
    at = docs.columns.index(text)
    small = Model(model.langs, model.idf.astype(np.float32), model.weights.astype(np.float32), model.bias, model.temperature)
    carried = docs.sparkSession.sparkContext.broadcast(small)

    def run(batches):
        m = carried.value
        for batch in batches:
            for part in pieces(batch, at):
                got = [m.predict(t.as_py()) for t in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*part.schema.names, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, widened(docs, lang_pred="string", lang_score="double"))
