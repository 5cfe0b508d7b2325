"""Training sets and passes of the re-rankers: window and pair rows (X11, X12), prompts (F13, F14), a listwise pass with a cache (L10), images embedded as they come."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomrank.functions.checks import checked, holds
from loomrank.functions.text import fingerprint, listing, parse_permutation, window_key

from .ranking import top_window
from .relational import pending

TARGETS = ("labels", "llm", "hybrid")


def prompt(template: str, query: Column, titles: Column) -> Column:
    """a template with its {n}, {query} and {listing} filled in."""
    out, filled = F.lit(template), {"n": F.size(titles).cast("string"), "listing": listing(titles), "query": query}
    for name, value in filled.items():  # the query last, so that no brace in it is taken for a place
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def prompt_fingerprint(template: str) -> Column:
    """what a cache notes of the template, so that an edited one doesn't replay old answers."""
    return fingerprint(F.lit(template))


def scope_windows(matrix: DataFrame, scores: DataFrame, k: int, score: str = "stage2_score") -> DataFrame:
    """P20: judged rows with their score and window; a row without a score raises when read."""
    x = matrix.join(scores.select("query_id", "product_id", score), ["query_id", "product_id"], "left")
    return top_window(x.where(holds(F.coalesce(F.col(score).isNotNull(), F.lit(False)), "a judged row has no score")), k, score)


def window_dataset(window: DataFrame, queries: DataFrame, texts: DataFrame, kind: str, teacher: str = "position") -> DataFrame:
    """X11: a row a query: query, docs, labels and whether it was dropped for want of a teacher.

    window is (query_id, product_id, stage2_rank, gain) and, but for kind `labels`, the teacher's
    place of each document. `llm` counts places from the end, `hybrid` orders by gain and then by
    place. A query without any place is dropped, with null lists; one with some, or with a place
    twice, raises when read, as does a missing or blank text. One shuffle by query.
    """
    if kind not in TARGETS:
        raise ValueError(f"{kind} isn't one of {TARGETS}")
    place = F.col(teacher) if kind != "labels" else F.lit(None).cast("int")
    x = window.join(texts.select("product_id", "text"), "product_id", "left")
    x = x.withColumn("text", checked(F.coalesce(F.length(F.trim("text")) > 0, F.lit(False)), F.col("text"), "a document without text"))
    per = x.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("stage2_rank", "product_id", "text", F.col("gain").cast("double").alias("gain"), place.cast("int").alias("place")))).alias("d"))
    n, told = F.size("d"), F.size(F.array_distinct(F.filter("d.place", lambda p: p.isNotNull())))
    dropped = (told == 0) if kind != "labels" else F.lit(False)
    fine = holds(dropped | F.lit(kind == "labels") | (told == n), "the teacher's order isn't a permutation of the window")
    gains, places = F.col("d.gain"), F.col("d.place")
    if kind == "hybrid":
        order = F.transform(F.array_sort(F.transform("d", lambda r: F.struct((-r["gain"]).alias("g"), r["place"].alias("p")))), lambda r: r["p"])
        labels = F.transform(places, lambda p: (n - F.array_position(order, p) + 1).cast("double"))
    else:
        first = F.array_min(places)
        labels = gains if kind == "labels" else F.transform(places, lambda p: (n - (p - first)).cast("double"))
    y = per.join(queries.select("query_id", "query"), "query_id", "left").where(fine)
    query = checked(F.coalesce(F.length(F.trim("query")) > 0, F.lit(False)), F.col("query"), "a query without text")
    return y.select("query_id", query.alias("query"), F.when(~dropped, F.col("d.text")).alias("docs"), F.when(~dropped, labels).alias("labels"), dropped.alias("dropped"))


def pairwise_rows(matrix: DataFrame, queries: DataFrame, texts: DataFrame) -> DataFrame:
    """A row a judgement: query, doc, label; a missing or blank text raises when read."""
    x = matrix.join(queries.select("query_id", "query"), "query_id", "left").join(texts.select("product_id", "text"), "product_id", "left")
    told = lambda c, what: checked(F.coalesce(F.length(F.trim(c)) > 0, F.lit(False)), F.col(c), f"{what} without text")
    return x.select("query_id", "product_id", told("query", "a query").alias("query"), told("text", "a document").alias("doc"), F.col("gain").cast("double").alias("label"))


def listwise_rerank(windows: DataFrame, cache: DataFrame, template: str, opener: Callable, model: str) -> DataFrame:
    """New orders of windows (query_id, query, docs, titles): from the cache, else by a call, else as they were.

    opener() makes, once a task, call(prompt) -> (text, prompt tokens, completion tokens, reasoning
    tokens). A cached permutation counts if it was made by the same model and template and is one of
    the window; an answer that is no permutation, and a call that fails, leave the window's own order.
    Returns query_id, ordering, source (cache, call or fallback), window_key, permutation (of calls
    that gave one, for new_answers) and the tokens and seconds of calls. Calls cost money: write the
    result before reading it twice.
    """
    x = windows.withColumn("window_key", window_key(F.col("query"), F.col("docs")))
    known = cache.where((F.col("model") == model) & (F.col("prompt_fp") == prompt_fingerprint(template))).select("window_key", F.col("permutation").alias("cached"))
    known = known.withColumn("_n", F.row_number().over(W.partitionBy("window_key").orderBy("cached"))).where("_n = 1").drop("_n")
    x = x.join(known, "window_key", "left").withColumn("cached", F.when(F.array_sort("cached") == F.sequence(F.lit(1), F.size("docs")), F.col("cached")))
    x = x.withColumn("prompt", F.when(F.col("cached").isNull(), prompt(template, F.col("query"), F.col("titles"))))

    def run(batches: Iterator[pd.DataFrame]):
        import time

        call = opener()
        for batch in batches:
            got = []
            for text in batch["prompt"]:
                if text is None:
                    got.append((None, 0, 0, 0, 0.0, 0))
                    continue
                began = time.perf_counter()
                try:
                    answer, *tokens = call(text)
                except Exception:  # one failed call mustn't lose the other windows
                    got.append((None, 0, 0, 0, 0.0, 1))
                    continue
                got.append((answer, *map(int, tokens), time.perf_counter() - began, 1))
            told = pd.DataFrame(got, columns=["answer", "prompt_tokens", "completion_tokens", "reasoning_tokens", "seconds", "called"], index=batch.index)
            yield pd.concat([batch[["window_key", "query_id", "docs", "cached"]], told], axis=1)

    ids = f"window_key string, query_id {windows.schema['query_id'].dataType.simpleString()}, docs array<string>, cached array<int>"
    y = x.select("window_key", "query_id", "docs", "cached", "prompt").mapInPandas(run, f"{ids}, answer string, prompt_tokens long, completion_tokens long, reasoning_tokens long, seconds double, called int")
    y = y.withColumn("permutation", parse_permutation(F.col("answer"), F.size("docs")))
    order = F.coalesce("cached", "permutation")
    return y.select("query_id", F.when(order.isNotNull(), F.transform(order, lambda i: F.get("docs", i - 1))).otherwise(F.col("docs")).alias("ordering"),
                    F.when(F.col("cached").isNotNull(), "cache").when(F.col("permutation").isNotNull(), "call").otherwise("fallback").alias("source"),
                    "window_key", "permutation", F.lit(model).alias("model"), prompt_fingerprint(template).alias("prompt_fp"), "prompt_tokens", "completion_tokens", "reasoning_tokens", "seconds", "called")


def new_answers(reranked: DataFrame) -> DataFrame:
    """What K9 appends to the cache: permutations that calls gave."""
    return reranked.where("source = 'call'").select("window_key", "permutation", "model", "prompt_fp", F.size("permutation").alias("k"))


def usage(reranked: DataFrame) -> DataFrame:
    """Calls, answers from the cache, fallbacks and tokens of a pass."""
    return reranked.agg(F.sum("called").alias("n_calls"), F.count_if(F.col("source") == "cache").alias("n_cached"), F.count_if(F.col("source") == "fallback").alias("n_fallback"),
                        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("reasoning_tokens").alias("reasoning_tokens"), F.sum("seconds").alias("call_seconds"))


def embedded_images(urls: DataFrame, stored: DataFrame, opener: Callable, encoder: Callable, width: int) -> DataFrame:
    """A row for each distinct url that isn't stored yet: url, status, and its vector where the status is ok.

    opener() makes get(url) -> (status, image or None) and encoder() an encoder of a list of images,
    once a task each; a batch of another shape raises. status_counts sums up; K7 appends the vectors.
    """
    def run(batches: Iterator[pd.DataFrame]):
        get, encode = opener(), encoder()
        for batch in batches:
            got = [get(u) for u in batch["url"]]
            here = [i for i, (status, _) in enumerate(got) if status == "ok"]
            vectors = np.asarray(encode([got[i][1] for i in here]), np.float32) if here else np.zeros((0, width), np.float32)
            if vectors.shape != (len(here), width):
                raise ValueError(f"the encoder gave shape {vectors.shape}, not {(len(here), width)}")
            held = dict(zip(here, vectors))
            yield pd.DataFrame({"url": batch["url"], "status": [g[0] for g in got], "embedding": [held.get(i) for i in range(len(got))]})

    todo = pending(urls.select(F.col("url").alias("key")), stored.select("key"), "key").select(F.col("key").alias("url"))
    return todo.mapInPandas(run, "url string, status string, embedding array<float>")


def status_counts(embedded: DataFrame) -> DataFrame:
    """How many urls ended in which status."""
    return embedded.groupBy("status").agg(F.count("*").alias("n"))


