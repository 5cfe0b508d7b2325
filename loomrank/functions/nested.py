"""Array, map and JSON functions (X rows, presence predicates)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import coverage, match_share, number
from .text import char_length, token_set, tokens

MAP = "map<string,string>"


def json_map(c: Column) -> Column:
    """A JSON object as a map; malformed, blank or other JSON as an empty one."""
    return F.coalesce(F.from_json(c, MAP), F.create_map().cast(MAP))


def sorted_json(c: Column) -> Column:
    """A map as JSON text in order of its keys; null if empty."""
    return F.when(F.size(c) > 0, F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))))


def terms_of(texts: Column) -> Column:
    """Distinct tokens of an array of texts; a null one reads "none"."""
    return F.array_distinct(F.flatten(F.transform(texts, lambda x: tokens(F.coalesce(x, F.lit("none"))))))


def present(c: Column) -> Column:
    """Not null and not empty, for text."""
    return F.coalesce(F.length(c) > 0, F.lit(False))


def present_list(c: Column) -> Column:
    """Not null and not empty, for arrays and maps."""
    return F.coalesce(F.size(c) > 0, F.lit(False))


def product_terms(description: str = "product_description") -> dict[str, Column]:
    """Token sets of a product row, each made once."""
    attrs, info, category = json_map(F.col("s_attrs_json")), json_map(F.col("s_info_json")), F.coalesce(F.col("s_category"), F.array().cast("array<string>"))
    return {
        "t_title": token_set(F.col("product_title")), "t_bullets": token_set(F.col("product_bullet_point")), "t_description": token_set(F.col(description)),
        "t_brand": token_set(F.col("product_brand")), "t_color": token_set(F.col("product_color")), "t_category": F.transform(category, token_set),
        "t_attr_keys": terms_of(F.map_keys(attrs)), "t_attr_values": terms_of(F.map_values(attrs)), "t_info_keys": terms_of(F.map_keys(info)), "t_info_values": terms_of(F.map_values(info)),
        "n_attr_map": F.size(attrs), "n_info_map": F.size(info),
    }


def product_features() -> dict[str, Column]:
    """13 lengths, counts and behavioural values, null where absent."""
    many = lambda c: F.nullif(F.col(c), F.lit(0)).cast("double")
    return {
        "title_chars": char_length(F.col("product_title")), "title_words": F.size(tokens(F.col("product_title"))).cast("double"),
        "own_desc_chars": char_length(F.col("product_description")), "bullet_chars": char_length(F.col("product_bullet_point")),
        "category_depth": F.nullif(F.size("t_category"), F.lit(0)).cast("double"), "n_attrs": many("n_attr_map"), "n_info": many("n_info_map"),
        **{c: number(F.col(c)) for c in ("s_stars", "s_ratings", "s_price")}, "s_price_multi": F.col("s_price_multi").cast("double"),
        **{c: number(F.col(c)) for c in ("s_bsr_rank", "s_n_reviews")},
    }


def pair_features(query: Column) -> dict[str, Column]:
    """15 features of a query and the token sets of a product."""
    q = token_set(query)
    hit = lambda c: F.size(F.array_intersect(q, F.col(c))).cast("double")
    depth = F.array_max(F.transform("t_category", lambda level, i: F.when(F.arrays_overlap(level, q), i + 1).otherwise(0)))
    category = lambda c: F.when(F.size("t_category") > 0, c)
    brand = match_share(q, F.col("t_brand"))
    return {
        "query_chars": F.length(query).cast("double"), "query_words": F.size(q).cast("double"), "title_overlap": hit("t_title"), "title_coverage": coverage(q, F.col("t_title")),
        "bullet_coverage": coverage(q, F.col("t_bullets")), "own_desc_coverage": coverage(q, F.col("t_description")), "brand_match": brand, "brand_match_all": (brand == 1).cast("double"),
        "color_match": match_share(q, F.col("t_color")), "category_match_depth": category(depth.cast("double")), "category_match_frac": category(depth / F.size("t_category")),
        **{f"{m}_{s}_overlap": F.when(F.col(f"n_{m}_map") > 0, hit(f"t_{m}_{s}s")) for m in ("attr", "info") for s in ("key", "value")},
    }


def presence_indicators() -> dict[str, Column]:
    """4 flags of own text and 9 of the enrichment; never null."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return {
        "has_brand": flag(present(F.col("product_brand"))), "has_color": flag(present(F.col("product_color"))), "has_own_desc": flag(present(F.col("product_description"))), "has_bullets": flag(present(F.col("product_bullet_point"))),
        "has_enrichment": flag(F.col("has_enrichment")), "has_stars": flag(F.col("s_stars").isNotNull()), "has_ratings": flag(F.col("s_ratings").isNotNull()), "has_price": flag(F.col("s_price").isNotNull()), "has_bsr": flag(F.col("s_bsr_rank").isNotNull()),
        "has_attrs": flag(F.col("n_attr_map") > 0), "has_info": flag(F.col("n_info_map") > 0), "has_category": flag(F.size("t_category") > 0), "desc_from_scrape": flag(F.col("description_source") == "scrape"),
    }
