"""The Snowball English stemmer, as published; applied to a vocabulary of distinct terms, so a word costs one call however often it stands."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tables of the published algorithm.
IRREGULAR = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
             "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
PREFIXES = ("gener", "commun", "arsen")
DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
STEP_2 = {"tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
          "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": ""}
STEP_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
LI_ENDING = "cdeghkmnrt"

_VC = re.compile("[aeiouy][^aeiouy]")
_VOWEL = re.compile("[aeiouy]")
_SHORT = re.compile("(?:^[aeiouy]|[^aeiouy][aeiouy](?![wxY]))[^aeiouy]$")


def _ending(word: str, suffixes) -> str | None:
    """The longest of the suffixes that the word ends in."""
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _regions(word: str) -> tuple[int, int]:
    """Where R1 and R2 begin: behind the first non-vowel after a vowel, and behind the next such place."""
    first = next((len(p) for p in PREFIXES if word.startswith(p)), None)
    if first is None:
        first = m.end() if (m := _VC.search(word)) else len(word)
    return first, m.end() if (m := _VC.search(word, first)) else len(word)


def stem(word: str) -> str:
    """The stem of a lower-case word; words of up to two letters stay as they are."""
    if len(word) <= 2 or word in IRREGULAR:
        return IRREGULAR.get(word, word)
    w = re.sub("(^|[aeiouy])y", r"\1Y", word.removeprefix("'"))
    r1, r2 = _regions(w)
    w = w[: len(w) - len(_ending(w, ("'", "'s", "'s'")) or "")]

    match _ending(w, ("sses", "ied", "ies", "us", "ss", "s")):
        case "sses":
            w = w[:-2]
        case "ied" | "ies":
            w = w[:-2] if len(w) > 4 else w[:-1]
        case "s" if _VOWEL.search(w, 0, len(w) - 2):
            w = w[:-1]
    if w in AFTER_1A:
        return w

    match _ending(w, ("eed", "eedly", "ed", "edly", "ing", "ingly")):
        case ("eed" | "eedly") as s:
            if len(w) - len(s) >= r1:
                w = w[: -len(s)] + "ee"
        case str(s) if _VOWEL.search(w, 0, len(w) - len(s)):
            w = w[: -len(s)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(DOUBLES):
                w = w[:-1]
            elif r1 >= len(w) and _SHORT.search(w):
                w += "e"

    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"

    s = _ending(w, STEP_2)
    if s and len(w) - len(s) >= r1 and (s != "ogi" or w[: -len(s)].endswith("l")) and (s != "li" or w[-3:-2] in set(LI_ENDING)):
        w = w[: -len(s)] + STEP_2[s]
    s = _ending(w, STEP_3)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + STEP_3[s]
    s = _ending(w, STEP_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]

    if w.endswith("e") and (len(w) > r2 or len(w) > r1 and not _SHORT.search(w[:-1])) or w.endswith("ll") and len(w) > r2:
        w = w[:-1]
    return w.lower()


@F.pandas_udf(T.StringType())
def _stems(words: pd.Series) -> pd.Series:
    return words.map(stem)


def stems(terms: DataFrame, column: str = "term") -> DataFrame:
    """The distinct non-null terms of a column with their stems (term, stem); Python sees the vocabulary, not the text."""
    return terms.select(F.col(column).alias("term")).where("term IS NOT NULL").distinct().withColumn("stem", _stems("term"))


def _replaced(suffixes: dict[str, str], source: str, region: str, extra: str) -> str:
    table = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in suffixes.items()) + "}"
    end = f"regexp_extract(w, '({'|'.join(sorted(suffixes, key=len, reverse=True))})$')"
    cut = "left(w, length(w) - length(s))"
    return f"(SELECT term, r1, r2, CASE WHEN s <> '' AND length(w) - length(s) >= {region} AND ({extra}) THEN {cut} || {table}[s] ELSE w END AS w FROM (SELECT *, {end} AS s FROM {source}))"


def stem_sql(source: str, name: str) -> str:
    """CTEs that end in `name` (term, stem) over the distinct terms (column term, a-z and 0-9) of a CTE: the same algorithm as a chain of regular expressions in DuckDB."""
    short = "(^[aeiouy]|[^aeiouy][aeiouy])[^aeiouy]$"
    is_short = lambda w: f"(regexp_matches({w}, '{short}') AND (regexp_matches({w}, '^[aeiouy][^aeiouy]$') OR NOT regexp_matches({w}, '[wxY]$')))"
    cut = "left(w, length(w) - length(s))"
    kept = " OR ".join(f"term = '{w}'" for w in IRREGULAR)
    irregular = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in IRREGULAR.items()) + "}"
    after = ", ".join(f"'{w}'" for w in sorted(AFTER_1A))
    two = _replaced(STEP_2, f"{name}_1c", "r1", f"CASE s WHEN 'ogi' THEN ends_with({cut}, 'l') WHEN 'li' THEN regexp_matches({cut}, '[{LI_ENDING}]$') ELSE true END")
    three = _replaced(STEP_3, two, "CASE s WHEN 'ative' THEN r2 ELSE r1 END", "true")
    four = _replaced(dict.fromkeys(STEP_4, ""), three, "r2", f"s <> 'ion' OR regexp_matches({cut}, '[st]$')")
    return f"""{name}_w AS (SELECT DISTINCT term, regexp_replace(term, '(^|[aeiouy])y', '\\1Y', 'g') AS w FROM {source} WHERE term IS NOT NULL),
{name}_p AS (SELECT term, w, coalesce(nullif(length(regexp_extract(w, '^({'|'.join(PREFIXES)})')), 0), nullif(length(regexp_extract(w, '^.*?[aeiouy][^aeiouy]')), 0), length(w)) AS r1 FROM {name}_w),
{name}_q AS (SELECT *, r1 + coalesce(nullif(length(regexp_extract(substr(w, r1 + 1), '^.*?[aeiouy][^aeiouy]')), 0), length(w) - r1) AS r2 FROM {name}_p),
{name}_1a AS (SELECT term, r1, r2, CASE WHEN ends_with(w, 'sses') THEN left(w, length(w) - 2) WHEN regexp_matches(w, 'ie[ds]$') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
  WHEN regexp_matches(w, '[us]s$') THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN left(w, length(w) - 1) ELSE w END AS w FROM {name}_q),
{name}_1s AS (SELECT *, regexp_extract(w, '(eedly|ingly|edly|eed|ing|ed)$') AS s FROM {name}_1a),
{name}_1b AS (SELECT term, r1, r2, CASE WHEN w IN ({after}) THEN w WHEN s LIKE 'eed%' THEN CASE WHEN length(w) - length(s) >= r1 THEN {cut} || 'ee' ELSE w END WHEN s <> '' AND regexp_matches({cut}, '[aeiouy]') THEN
  CASE WHEN regexp_matches({cut}, '(at|bl|iz)$') THEN {cut} || 'e' WHEN regexp_matches({cut}, '({'|'.join(DOUBLES)})$') THEN left(w, length(w) - length(s) - 1) WHEN r1 >= length(w) - length(s) AND {is_short(cut)} THEN {cut} || 'e' ELSE {cut} END ELSE w END AS w FROM {name}_1s),
{name}_1c AS (SELECT term, r1, r2, CASE WHEN w NOT IN ({after}) AND regexp_matches(w, '^.+[^aeiouy][yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM {name}_1b),
{name}_4 AS (SELECT a.term, a.r1, a.r2, CASE WHEN b.w IN ({after}) THEN b.w ELSE a.w END AS w, b.w IN ({after}) AS done FROM {four} a JOIN {name}_1b b USING (term)),
{name} AS (SELECT term, CASE WHEN {kept} THEN {irregular}[term] WHEN length(term) <= 2 THEN term WHEN done THEN w
  WHEN (ends_with(w, 'e') AND (length(w) > r2 OR length(w) > r1 AND NOT {is_short('left(w, length(w) - 1)')})) OR (ends_with(w, 'll') AND length(w) > r2) THEN lower(left(w, length(w) - 1)) ELSE lower(w) END AS stem FROM {name}_4)"""
