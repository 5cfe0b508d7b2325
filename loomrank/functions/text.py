"""String, hash and regex functions (F rows): Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FOLD_SALT = "val-folds/v1"
FOLDS = 5

# The shapes of scraped strings.
STARS = r"^([0-9]+(?:\.[0-9]+)?) out of 5 stars$"
RATINGS = r"^([0-9,]+) ratings?$"
PRICE = r"\$([0-9,]+\.[0-9]{2})"
RANK_IN = r"#([0-9,]+)\s+in\s+([^#(]+)"


def tokens(c: Column) -> Column:
    """lower-cased runs of a-z and 0-9; null gives an empty array."""
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0)), F.array().cast("array<string>"))


def token_set(c: Column) -> Column:
    """distinct tokens."""
    return F.array_distinct(tokens(c))


def strip(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Runs of Unicode white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def product_text(*fields: Column) -> Column:
    """fields joined with blanks, null as empty, white space collapsed."""
    return collapse(F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields]))


def document_text(*fields: Column, max_chars: int = 800) -> Column:
    """fields that aren't blank, collapsed, joined and cut."""
    return F.substring(F.concat_ws(" ", *[F.nullif(collapse(f), F.lit("")) for f in fields]), 1, max_chars)


def first_text(*fields: Column) -> Column:
    """The first field that isn't blank, stripped."""
    return F.coalesce(*[F.nullif(strip(f), F.lit("")) for f in fields])


def parse_stars(c: Column) -> Column:
    """"4.7 out of 5 stars" as a double."""
    return F.nullif(F.regexp_extract(strip(c), STARS, 1), F.lit("")).try_cast("double")


def parse_ratings(c: Column) -> Column:
    """a count such as "2,345 ratings" as an int."""
    return F.nullif(F.replace(F.regexp_extract(strip(c), RATINGS, 1), F.lit(","), F.lit("")), F.lit("")).try_cast("int")


def parse_price(c: Column) -> Column:
    """struct of the first price and whether there were more."""
    found = F.regexp_extract_all(c, F.lit(PRICE), F.lit(1))
    return F.struct(F.replace(F.get(found, F.lit(0)), F.lit(","), F.lit("")).try_cast("double").alias("price"), F.coalesce(F.size(found) > 1, F.lit(False)).alias("multi"))


def parse_rank(c: Column) -> Column:
    """F8: struct of the first "#n in Category" as rank and category."""
    take = lambda g: F.get(F.regexp_extract_all(c, F.lit(RANK_IN), F.lit(g)), F.lit(0))
    return F.struct(F.replace(take(1), F.lit(","), F.lit("")).try_cast("int").alias("rank"), strip(take(2)).alias("category"))


def normalize_url(c: Column) -> Column:
    """image URL without the retired bucket segment; again changes nothing."""
    return F.regexp_replace(c, "/images/W/[^/]+/images/I/", "/images/I/")


def image_url(image: Column, img: Column) -> Column:
    """`image`, else `img`, normalised."""
    return normalize_url(F.coalesce(F.nullif(image, F.lit("")), F.nullif(img, F.lit(""))))


def fold_of(query_id: Column, salt: str = FOLD_SALT, folds: int = FOLDS) -> Column:
    """the first 16 hex digits of SHA-256 of "salt:id", modulo the number of folds.

    Folds that were frozen elsewhere come out the same only under the salt they were made with.
    """
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), query_id.cast("string")), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % folds).cast("int")


def window_key(query: Column, docs: Column) -> Column:
    """SHA-256 of a query and its ordered documents."""
    return F.sha2(F.to_json(F.array_prepend(docs, query)), 256)


def fingerprint(c: Column) -> Column:
    """the first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, 16)


def listing(texts: Column, max_chars: int = 160) -> Column:
    """numbered lines "[i] text", each text cut."""
    return F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.substring(x, 1, max_chars))), "\n")


def answer_text(permutation: Column) -> Column:
    """"[3] > [1]"."""
    return F.array_join(F.transform(permutation, lambda i: F.concat(F.lit("["), i.cast("string"), F.lit("]"))), " > ")


def parse_permutation(c: Column, n: Column) -> Column:
    """F16: the numbers in brackets if they are a permutation of 1..n, else null."""
    found = F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.when((n > 0) & (F.array_sort(found) == F.sequence(F.lit(1), F.greatest(n, F.lit(1)))), found)


def query_prefix(query: Column) -> Column:
    """the prompt's head."""
    return F.concat(F.lit("Query: "), query, F.lit("\nProduct: "))


def top_category(c: Column) -> Column:
    """the first level of a category path."""
    return F.get(c, F.lit(0))


def stratum_label(low: Column, high: Column) -> Column:
    """"[0.25, 0.50)"."""
    return F.format_string("[%.2f, %.2f)", low, high)


def interval_text(point: Column, low: Column, high: Column) -> Column:
    """a value and its interval, four digits each."""
    return F.format_string("%.4f [%.4f, %.4f]", point, low, high)


def escape_html(c: Column) -> Column:
    """& < > and quotes as entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def char_length(c: Column) -> Column:
    """characters, null where the text is missing or empty."""
    return F.when(F.length(c) > 0, F.length(c).cast("double"))


def mentions(c: Column, *terms: str) -> Column:
    """does any term stand in the text, in any case?"""
    return c.rlike("(?i)" + "|".join(terms))


def counter_total(c: Column, name: str) -> Column:
    """Sum of all samples of one counter in metrics text."""
    found = F.regexp_extract_all(c, F.lit(rf"(?m)^{name}(?:\{{[^}}]*\}})?\s+([0-9.eE+]+)\s*$"), F.lit(1))
    return F.aggregate(F.transform(found, lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
