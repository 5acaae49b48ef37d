"""The 38 features of a pair of cards.

A card is parsed once, before the join: its normalised name, attributes and token sets. A pair's sets are then
intersected once each, in a first projection, and the ratios come from these counts in a second one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx
from ..sources.lineage import cut
from .pairs import attach, item_text
from .tfidf import name_cosine, tfidf

SETS = ("name_tokens", "name_grams", "value_tokens", "all_tokens", "attr_keys", "digit_tokens", "article_tokens", "brand_tokens")

NAMES = [
    "name_exact", "name_jaccard", "name_dice", "name_containment", "name_count_ratio", "name_char3_jaccard", "name_char3_containment", "name_length_ratio",
    "value_jaccard", "value_containment", "value_count_ratio", "all_jaccard", "all_containment", "all_count_ratio", "key_jaccard", "key_containment", "key_count_ratio",
    "shared_value_exact", "shared_value_jaccard", "shared_value_conflict", "shared_key_count", "digit_jaccard", "digit_containment", "digit_count_ratio",
    "digit_disjoint", "digit_presence_equal", "article_jaccard", "article_containment", "article_count_ratio", "article_disjoint", "article_presence_equal",
    "brand_jaccard", "brand_containment", "brand_exact", "brand_disjoint", "brand_presence_equal", "text_tfidf", "name_tfidf",
]


def cards(items: DataFrame) -> DataFrame:
    """items with nm, attrs and the eight token sets, each step from the columns of the one before."""
    out = items.withColumns({"nm": tx.normalise(F.col("name")), "__entries": tx.json_entries(F.col("attributes"))})
    out = out.withColumn("attrs", tx.attributes(F.col("__entries"))).drop("__entries")
    out = out.withColumns({
        "name_tokens": tx.token_set(F.col("nm")),
        "name_grams": tx.grams(F.col("nm")),
        "value_tokens": tx.value_tokens(F.col("attrs")),
        "attr_keys": F.map_keys("attrs"),
        "article_tokens": tx.tokens_of_keys(F.col("attrs"), tx.ARTICLE_KEYS),
        "brand_tokens": tx.tokens_of_keys(F.col("attrs"), tx.BRAND_KEYS),
    })
    out = out.withColumn("all_tokens", F.array_union("name_tokens", "value_tokens"))
    return out.withColumn("digit_tokens", tx.digit_tokens(F.col("all_tokens")))


def joined(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """pairs with both cards; an unknown id has an empty one."""
    kept = ["nm", "attrs", *SETS]
    view = cut(cards(items), "cards")
    out = attach(pairs, view, {"text": item_text(), "name": tx.blank(F.col("name")), **{c: F.col(c) for c in kept}})
    empty = {f"{c}{i}": F.coalesce(f"{c}{i}", F.array().cast("array<string>")) for c in SETS for i in (1, 2)}
    texts = {f"{c}{i}": tx.blank(F.col(f"{c}{i}")) for c in ("nm", "text", "name") for i in (1, 2)}
    maps = {f"attrs{i}": F.coalesce(f"attrs{i}", F.create_map().cast(tx.MAP)) for i in (1, 2)}
    return out.withColumns(empty | texts | maps)


def _shared() -> Column:
    """Of the attributes that both cards have: (equal values, jaccard) of each."""
    words = lambda side, k: F.array_distinct(F.split(F.element_at(side, k), " "))

    def one(k: Column) -> Column:
        a, b = words("attrs1", k), words("attrs2", k)
        return F.struct((F.element_at("attrs1", k) == F.element_at("attrs2", k)).cast("double").alias("exact"), sim.set_stats(a, b)["jaccard"].alias("jaccard"))

    return F.transform(F.array_intersect(F.map_keys("attrs1"), F.map_keys("attrs2")), one)


def structured(both: DataFrame) -> DataFrame:
    """joined() with the 36 features that need no corpus, as doubles."""
    short = {"name": "name_tokens", "char3": "name_grams", "value": "value_tokens", "all": "all_tokens", "key": "attr_keys", "digit": "digit_tokens", "article": "article_tokens", "brand": "brand_tokens"}
    counted = both.withColumns({f"__{s}": F.size(F.array_intersect(f"{c}1", f"{c}2")) for s, c in short.items()} | {"__shared": _shared()})
    pair = {s: (F.col(f"{c}1"), F.col(f"{c}2")) for s, c in short.items()}
    stats = {s: sim.set_stats(*pair[s], F.col(f"__{s}")) for s in short}
    lengths = [F.length("nm1"), F.length("nm2")]
    n = F.size("__shared")
    mean = lambda of: sim.ratio(F.aggregate(F.transform("__shared", of), F.lit(0.0), lambda a, x: a + x), n)
    out = {"name_exact": ((F.col("nm1") == F.col("nm2")) & (F.col("nm1") != "")).cast("double")}
    out |= {f"name_{k}": x for k, x in stats["name"].items()}
    out |= {f"name_char3_{k}": stats["char3"][k] for k in ("jaccard", "containment")}
    out["name_length_ratio"] = sim.ratio(F.least(*lengths), F.greatest(*lengths))
    for s in ("value", "all", "key", "digit", "article", "brand"):
        out |= {f"{s}_{k}": stats[s][k] for k in ("jaccard", "containment", "count_ratio") if (s, k) != ("brand", "count_ratio")}
    out["shared_value_exact"] = mean(lambda x: x["exact"])
    out["shared_value_jaccard"] = mean(lambda x: x["jaccard"])
    out["shared_value_conflict"] = mean(lambda x: (x["jaccard"] == 0).cast("double"))
    out["shared_key_count"] = F.least(n / 10, F.lit(1.0))
    for s in ("digit", "article", "brand"):
        out[f"{s}_disjoint"] = sim.disjoint(*pair[s])
        out[f"{s}_presence_equal"] = sim.presence_equal(*pair[s])
    out["brand_exact"] = sim.same_set(*pair["brand"])
    return counted.withColumns(out).drop("__shared", *[f"__{s}" for s in short])


def pair_features(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """pairs with category, text1, text2 and the 38 features."""
    both = joined(pairs, items)
    plain = cut(structured(both).select(*pairs.columns, "category", "text1", "text2", "name1", "name2", *NAMES[:36]), "features")
    scored = name_cosine(tfidf(plain, "text_tfidf"), "name_tfidf")
    return scored.select(*pairs.columns, "category", "text1", "text2", "name1", *NAMES)


def vector(names: list[str] = NAMES) -> Column:
    """The features as an array of floats, as models take them."""
    return F.array(*[F.col(n).cast("float") for n in names])
