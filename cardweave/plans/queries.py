"""Every operator of the card-matching engine as a query over the driver's tables, with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import features as ft
from ..operators import metrics, models, pairs, sampling, tfidf, train
from ..operators.features import NAMES, vector
from ..sources import fixtures as fx
from ..sources.fixtures import table
from ..sources.lineage import cut
from . import oracle as o
from . import training as training_plans
from .pipeline import predict_scores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


ITEMS, PAIRS = f"with {o.ITEMS}", f"with {o.ITEMS}, {o.PAIRS}"
items, card_pairs = fx.part_items, fx.part_pairs


def r6(x) -> F.Column:
    return F.round(x, 6)


# Scans and projections


@query("scan_cards", f"{ITEMS} select id, name, attributes, category from items")
def scan_cards(spark, d):
    return items(spark, d).select("id", "name", "attributes", "category")


@query("scan_pairs", f"{PAIRS} select id1, id2, target from pairs")
def scan_pairs(spark, d):
    return card_pairs(spark, d).select("id1", "id2", "target")


@query("item_text", f"{ITEMS} select id, {o.TEXT} as text, {o.strip(f'{o.TEXT} || chr(32) || category')} as text_with_category from items")
def item_text(spark, d):
    return items(spark, d).select("id", pairs.item_text().alias("text"), pairs.item_text(True).alias("text_with_category"))


BASELINE = """'Name: ' || coalesce(name, '') || ' Category: ' || coalesce(category, '') || ' Attributes: ' ||
  coalesce(array_to_string(list_transform(json_keys(attributes), lambda k: k || ': ' || json_extract_string(attributes, '$."' || k || '"')), ' '), '')"""


@query("baseline_text", f"{ITEMS} select id, {BASELINE} as text from items")
def baseline_text(spark, d):
    return items(spark, d).select("id", pairs.baseline_text().alias("text"))


@query("drop_target", f"{PAIRS} select id1, id2 from pairs")
def drop_target(spark, d):
    return card_pairs(spark, d).select("id1", "id2")


STEPS = ", ".join(f"(x > {t}::float)::int::float as above_{i}" for i, t in enumerate(models.THRESHOLDS))


@query("expand_features", f"with v as (select event_id, (value / 100)::float as x from events) select event_id, round(x::double, 4) as x, round((x * x)::double, 4) as square, round(sqrt(greatest(x, 0))::float::double, 4) as root, {STEPS} from v")
def expand_features(spark, d):
    rows = table(spark, d, "events").select("event_id", models.expand(F.array((F.col("value") / 100).cast("float"))).alias("x"))
    named = ["x", "square", "root"]
    return rows.select("event_id", *[F.round(F.col("x")[i].cast("double"), 4).alias(n) for i, n in enumerate(named)], *[F.col("x")[3 + i].alias(f"above_{i}") for i in range(len(models.THRESHOLDS))])


@query("soft_to_hard", "select event_id, (value / 100 >= 0.5)::int as label from events")
def soft_to_hard(spark, d):
    return table(spark, d, "events").select("event_id", (F.col("value") / 100 >= 0.5).cast("int").alias("label"))


@query("blend_scores", "select event_id, w, round(w * value + (1 - w) * user_id, 6) as blend from events, (values (0.25::double), (0.5::double), (0.75::double)) as ws(w)")
def blend_scores(spark, d):
    weights = F.explode(F.array(*[F.lit(w) for w in (0.25, 0.5, 0.75)]))
    rows = table(spark, d, "events").select("event_id", "value", "user_id", weights.alias("w"))
    return rows.select("event_id", "w", r6(F.col("w") * F.col("value") + (1 - F.col("w")) * F.col("user_id")).alias("blend"))


# Filters


@query("category_allowlist", f"{ITEMS} select id, category from items where category in (select distinct category from items order by 1 limit 2)")
def category_allowlist(spark, d):
    cards = items(spark, d).select("id", "category")
    allowed = cards.select("category").distinct().orderBy("category").limit(2)
    return cards.join(F.broadcast(allowed), "category", "left_semi").select("id", "category")


# All pairs, and each card with the one REACH ids on: the last cards' partners aren't known.
REACH = 40
OPEN = f"{PAIRS}, wide as (select id1, id2 from pairs union all select id, id + {REACH} from items)"
ATTACHED = f"""texts as (select id, category, {o.TEXT} as text from items),
both_texts as (select p.id1, p.id2, coalesce(a.text, '') as text1, coalesce(b.text, '') as text2, coalesce(a.category, b.category) as category
  from wide p left join texts a on a.id = p.id1 left join texts b on b.id = p.id2)"""


def open_pairs(spark, d) -> DataFrame:
    beyond = items(spark, d).select(F.col("id").alias("id1"), (F.col("id") + REACH).alias("id2"))
    return card_pairs(spark, d).select("id1", "id2").unionByName(beyond)


def attached(spark, d) -> DataFrame:
    return pairs.with_texts(open_pairs(spark, d), items(spark, d))


@query("missing_text_count", f"{OPEN}, {ATTACHED} select count(*) as n, sum((text1 = '' or text2 = '')::int)::bigint as n_missing from both_texts")
def missing_text_count(spark, d):
    return attached(spark, d).agg(F.count("*").alias("n"), F.sum(pairs.missing_text().cast("long")).alias("n_missing"))


@query("confident_labels", "select event_id from events where value / 100 = 0 or value / 100 >= 8.0::double / 9")
def confident_labels(spark, d):
    soft = F.col("value") / 100
    return table(spark, d, "events").filter((soft == 0) | (soft >= 8 / 9)).select("event_id")


NUMBERS = "case when event_id % 5 = 0 then 'nan'::double when event_id % 5 = 1 then 'infinity'::double when event_id % 5 = 2 then null else value end"


@query("nan_inf_predicate", f"with v as (select event_id, {NUMBERS} as x from events) select event_id from v where x is null or isnan(x) or isinf(x)")
def nan_inf_predicate(spark, d):
    k = F.col("event_id") % 5
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, None).otherwise(F.col("value"))
    return table(spark, d, "events").filter(pairs.bad_number(x)).select("event_id")


@query("zero_missing_scores", f"{OPEN}, {ATTACHED} select id1, id2, case when text1 = '' or text2 = '' then 0.0::double else (id1 % 10)::double end as score from both_texts")
def zero_missing_scores(spark, d):
    return attached(spark, d).select("id1", "id2", F.when(pairs.missing_text(), 0.0).otherwise((F.col("id1") % 10).cast("double")).alias("score"))


# Joins


@query("attach_texts", f"{OPEN}, {ATTACHED} select id1, id2, text1, text2 from both_texts")
def attach_texts(spark, d):
    return attached(spark, d).select("id1", "id2", "text1", "text2")


@query("pair_category_coalesce", f"{OPEN}, {ATTACHED} select id1, id2, category from both_texts")
def pair_category_coalesce(spark, d):
    return attached(spark, d).select("id1", "id2", "category")


@query("items_semi_join", f"{PAIRS} select id, name from items where id in (select id1 from pairs union select id2 from pairs)")
def items_semi_join(spark, d):
    return pairs.used_items(items(spark, d), card_pairs(spark, d)).select("id", "name")


@query("pairs_both_sides_semi", f"{OPEN} select id1, id2 from wide where id1 in (select id from items) and id2 in (select id from items)")
def pairs_both_sides_semi(spark, d):
    return pairs.both_sides_in(open_pairs(spark, d), items(spark, d)).select("id1", "id2")


@query("missing_predictions_anti", f"{PAIRS} select id1, id2 from pairs where target = 0")
def missing_predictions_anti(spark, d):
    """Predictions were made for the positive pairs only."""
    all_pairs = card_pairs(spark, d)
    return pairs.missing_predictions(all_pairs, all_pairs.filter("target = 1"))


@query("baseline_inner_pairs", f"{OPEN} select p.id1, p.id2 from wide p join items a on a.id = p.id1 join items b on b.id = p.id2")
def baseline_inner_pairs(spark, d):
    return pairs.inner_pairs(open_pairs(spark, d), items(spark, d)).select("id1", "id2")


@query("route_models_left_join", f"""{ITEMS}, m as (select distinct category, length(category)::double as weight from items where length(category) % 2 = 0 union all select '__all__', -1)
select i.id, case when a.category is null then '__all__' else i.category end as model, coalesce(a.weight, b.weight) as weight
from items i left join m a on a.category = i.category join m b on b.category = '__all__'""")
def route_models_left_join(spark, d):
    cards = items(spark, d)
    own = cards.filter(F.length("category") % 2 == 0).select("category").distinct().withColumn("weight", F.length("category").cast("double"))
    return models.route(cards, own.unionByName(spark.createDataFrame([("__all__", -1.0)], own.schema))).select("id", "model", "weight")


EMBED = "p as (select a.vec_id as id1, b.vec_id as id2, a.embedding as x, b.embedding as y from embeddings a join embeddings b on b.vec_id > a.vec_id and b.vec_id <= a.vec_id + 5)"


def vector_pairs(spark, d) -> DataFrame:
    ids = table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"))
    return fx.near_pairs(ids, 5, label=None, same=())


@query("embedding_lookup", f"with {EMBED} select id1, id2, len(x)::int as n1, len(y)::int as n2 from p")
def embedding_lookup(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("id"), F.size("embedding").alias("n"))
    out = vector_pairs(spark, d)
    for i in (1, 2):
        out = out.join(vectors.select(F.col("id").alias(f"id{i}"), F.col("n").alias(f"n{i}")), f"id{i}", "left")
    return out.select("id1", "id2", "n1", "n2")


# Aggregates


def scored(spark, d) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("y"))
    return table(spark, d, "documents").join(labels, "doc_id").select("y", F.col("n_chars").alias("s"), F.col("lang").alias("cat"))


METRIC = f"with {o.SCORED}, {o.AP}"


@query("ap_per_category", f"{METRIC} select cat, round(ap, 9) as ap from aps")
def ap_per_category(spark, d):
    return metrics.ap_per_category(scored(spark, d)).select("cat", F.round("ap", 9).alias("ap"))


@query("macro_ap", f"{METRIC} select round(avg(ap), 9) as macro_ap from aps")
def macro_ap(spark, d):
    return metrics.macro_ap(scored(spark, d)).select(F.round("macro_ap", 9).alias("macro_ap"))


@query("ap_of_rank_blends", f"""with {o.SCORED}, ranked as (select y, cat, s, y * -1.0::double + s % 7 as r from scored),
pct as (select y, cat, (rank() over (partition by cat order by s) + (count(*) over (partition by cat, s) - 1) / 2.0::double) / count(*) over (partition by cat) as a,
  (rank() over (partition by cat order by r) + (count(*) over (partition by cat, r) - 1) / 2.0::double) / count(*) over (partition by cat) as b from ranked),
long as (select y, concat(w, '|', cat) as cat, round(w * a + (1 - w) * b, 9) as s from pct, (values (0.25::double), (0.5::double), (0.75::double)) as ws(w)),
{o.AP.replace("from scored", "from long")}
select split_part(cat, '|', 1) as scorer, split_part(cat, '|', 2) as cat, round(ap, 9) as ap from aps""")
def ap_of_rank_blends(spark, d):
    """Average precision of blends of two scores' ranks, for each weight and category."""
    rows = scored(spark, d).withColumn("r", -F.col("y").cast("double") + F.col("s") % 7)
    ranked = rows.withColumns({f"blend{i}": F.round(sampling.rank_blend("s", "r", w, "cat"), 9) for i, w in enumerate(training_plans.BLENDS)})
    found = metrics.ap_of_scorers(ranked, {str(w): F.col(f"blend{i}") for i, w in enumerate(training_plans.BLENDS)})
    return found.select("scorer", "cat", F.round("ap", 9).alias("ap"))


@query("single_class_categories", f"with {o.SCORED}, s as (select y, s, case when y = 1 then cat || '1' else cat end as cat from scored) select cat from s group by cat having sum(y) = 0 or sum(y) = count(*)")
def single_class_categories(spark, d):
    return metrics.single_class(scored(spark, d).withColumn("cat", F.when(F.col("y") == 1, F.concat("cat", F.lit("1"))).otherwise(F.col("cat"))))


@query("ap_range", f"{METRIC} select round(min(ap), 9) as lowest, round(max(ap), 9) as highest from aps")
def ap_range(spark, d):
    return metrics.ap_range(scored(spark, d)).select(F.round("lowest", 9).alias("lowest"), F.round("highest", 9).alias("highest"))


DOC = f"with {o.DOC_ITEMS}, {o.DOC_PAIRS}, {o.TEXTS}, {o.TEXT_PAIRS}, {o.tfidf('source', 'word')}".replace("texts as (select text1", "doc_texts as (select text1").replace("from texts)", "from doc_texts)")


def doc_texts(spark, d) -> DataFrame:
    return pairs.with_texts(fx.document_pairs(spark, d), fx.document_items(spark, d))


def frequency(spark, d) -> DataFrame:
    return tfidf.document_frequency(tfidf.term_counts(tfidf.distinct_texts(doc_texts(spark, d)), tx.word_terms))


@query("document_frequency", f"{DOC} select term, df, ctf::bigint as ctf from df")
def document_frequency(spark, d):
    return frequency(spark, d)


@query("vocabulary_topk", f"{DOC} select term, ctf::bigint as ctf from df order by ctf desc, term limit 100")
def vocabulary_topk(spark, d):
    return tfidf.vocabulary(frequency(spark, d), 100).select("term", "ctf")


@query("coverage_stats", f"{PAIRS} select category, count(*) as n, count(distinct id1) as n_id1, count(distinct id2) as n_id2, round(avg(target), 6) as positive from pairs join items on id = id1 group by category")
def coverage_stats(spark, d):
    return ft_pairs(spark, d).groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("id1").alias("n_id1"), F.countDistinct("id2").alias("n_id2"), r6(F.avg("target")).alias("positive"))


def ft_pairs(spark, d) -> DataFrame:
    """Labelled pairs with category and first name."""
    return pairs.attach(card_pairs(spark, d), items(spark, d), {"name": F.col("name")})


LABELLED = f"{PAIRS}, rows as (select p.*, i.category, i.name as name1 from pairs p join items i on i.id = p.id1)"


# Windows and sampling


@query("rank_pct_average", f"with {o.SCORED} select cat, s, round((rank() over (partition by cat order by s) + (count(*) over (partition by cat, s) - 1) / 2.0::double) / count(*) over (partition by cat), 9) as pct from scored")
def rank_pct_average(spark, d):
    return scored(spark, d).select("cat", "s", F.round(sampling.rank_pct("s", "cat"), 9).alias("pct"))


TAIL = "row_number() over (partition by category, target order by {order}) <= greatest(1, round_even(count(*) over (partition by category, target) * 0.2::double, 0))"


@query("id_tail_split", f"{LABELLED} select id1, id2, {TAIL.format(order='id1 desc, id2 desc')} as is_valid from rows")
def id_tail_split(spark, d):
    return sampling.tail_split(ft_pairs(spark, d)).select("id1", "id2", "is_valid")


@query("random_split", f"{LABELLED} select id1, id2, {TAIL.format(order=f'{o.draw(2026)}, id1, id2')} as is_valid from rows")
def random_split(spark, d):
    return sampling.random_split(ft_pairs(spark, d)).select("id1", "id2", "is_valid")


SIGNATURE = "trim(regexp_replace(lower(coalesce(name1, '')), '[^0-9a-zа-яё]+', ' ', 'g'))"


@query("name_group_split", f"{LABELLED} select id1, id2, ('0x' || substr(md5(concat_ws('|', category, {SIGNATURE})), 1, 8))::bigint % 5 = 2026 % 5 as is_valid from rows")
def name_group_split(spark, d):
    return sampling.group_split(ft_pairs(spark, d)).select("id1", "id2", "is_valid")


@query("stratified_sample", f"""{LABELLED}, n as (select *, row_number() over (partition by category order by {o.draw(1234)}, id1, id2) as nth,
  round_even(count(*) over (partition by category) * least(1.0::double, 500.0::double / (select count(*) from rows)), 0) as quota from rows) select id1, id2, category from n where nth <= quota""")
def stratified_sample(spark, d):
    return sampling.stratified(ft_pairs(spark, d), "category", 500).select("id1", "id2", "category")


@query("cap_per_category", f"{LABELLED}, n as (select *, row_number() over (partition by category, target order by {o.draw(7)}, id1, id2) as nth from rows) select id1, id2, category, target from n where nth <= 20")
def cap_per_category(spark, d):
    return sampling.at_most(ft_pairs(spark, d), ["category", "target"], 20, 7).select("id1", "id2", "category", "target")


@query("sample_n_pairs", f"{PAIRS} select id1, id2 from pairs order by {o.draw(1234)}, id1, id2 limit 1000")
def sample_n_pairs(spark, d):
    return sampling.sample_pairs(card_pairs(spark, d), 1000).select("id1", "id2")


# Sets


@query("distinct_ids_union", f"{PAIRS} select id1 as id from pairs union select id2 from pairs")
def distinct_ids_union(spark, d):
    return pairs.ids_of(card_pairs(spark, d))


@query("union_label_sources", f"{PAIRS}, soft as (select id1, id2, ((id1 * 7 + id2) % 10) / 9.0::double as target from pairs) select id1, id2, target::double as target, 5.0::double as weight from pairs union all select id1, id2, target, 1.0::double from soft where target = 0 or target >= 8.0::double / 9")
def union_label_sources(spark, d):
    hard = card_pairs(spark, d).select("id1", "id2", F.col("target").cast("double").alias("target"))
    return train.hybrid_rows(hard, train.confident(hard.withColumn("target", ((F.col("id1") * 7 + F.col("id2")) % 10) / 9.0)), 5)


TWICE = "twice as (select id, name, id as row_idx from items union all select id - id % 3, name || '!', id + 100000000 from items)"


def twice(spark, d) -> DataFrame:
    cards = items(spark, d).select("id", "name", "row_idx")
    again = cards.select((F.col("id") - F.col("id") % 3).alias("id"), F.concat("name", F.lit("!")).alias("name"), (F.col("row_idx") + 100000000).alias("row_idx"))
    return cards.unionByName(again)


@query("dedupe_keep_first", f"{ITEMS}, {TWICE} select id, arg_min(name, row_idx) as name from twice group by id")
def dedupe_keep_first(spark, d):
    return pairs.last_items(twice(spark, d), "first").select("id", "name")


@query("dedupe_keep_last", f"{ITEMS}, {TWICE} select id, arg_max(name, row_idx) as name from twice group by id")
def dedupe_keep_last(spark, d):
    return pairs.last_items(twice(spark, d)).select("id", "name")


@query("duplicate_pairs", f"{PAIRS} select id1, id2 - id2 % 5 as id2, count(*) as n from pairs group by 1, 2 having count(*) > 1")
def duplicate_pairs(spark, d):
    return pairs.repeated_pairs(card_pairs(spark, d).withColumn("id2", F.col("id2") - F.col("id2") % 5))


@query("train_index_complement", f"{LABELLED}, v as (select id1, id2, {TAIL.format(order='id1 desc, id2 desc')} as is_valid from rows) select id1, id2 from pairs except select id1, id2 from v where is_valid")
def train_index_complement(spark, d):
    valid = sampling.tail_split(ft_pairs(spark, d)).filter("is_valid").select("id1", "id2")
    return card_pairs(spark, d).join(valid, ["id1", "id2"], "left_anti").select("id1", "id2")


# Text and JSON

@query("normalise_text", f"select doc_id, {o.norm('text')} as text from documents")
def normalise_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.normalise(F.col("text")).alias("text"))


@query("name_group_normalise", "select doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^0-9a-zа-яё]+', ' ', 'g')) as text from documents")
def name_group_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.name_signature(F.col("text")).alias("text"))


def listed(x) -> F.Column:
    """A set as text, so that engines compare it alike."""
    return F.array_join(F.array_sort(x), "|")


def sql_listed(x: str) -> str:
    return f"array_to_string(list_sort({x}), '|')"


@query("token_set", f"with n as (select doc_id, {o.norm('text')} as n from documents) select doc_id, {sql_listed(o.tokens('n'))} as tokens from n")
def token_set(spark, d):
    rows = table(spark, d, "documents").select("doc_id", tx.normalise(F.col("text")).alias("n"))
    return rows.select("doc_id", listed(tx.token_set(F.col("n"))).alias("tokens"))


@query("json_to_text", """select event_id, coalesce(array_to_string(list_transform(json_keys(props), lambda k: k || ' ' || json_extract_string(props, '$."' || k || '"')), ' '), '') as text from events""")
def json_to_text(spark, d):
    return table(spark, d, "events").select("event_id", tx.json_text(F.col("props")).alias("text"))


CARD_SETS = f"{PAIRS}, {o.CARDS}"


@query("json_to_attrs", f"{CARD_SETS} select id, array_to_string(list_sort(list_transform(attrs, lambda e: e.k || '=' || e.v)), '|') as attrs from cards")
def json_to_attrs(spark, d):
    return ft.cards(items(spark, d)).select("id", listed(F.transform(F.map_entries("attrs"), lambda e: F.concat_ws("=", e["key"], e["value"]))).alias("attrs"))


def _card_set(name: str, column: str) -> None:
    @query(name, f"{CARD_SETS} select id, {sql_listed(column)} as tokens from cards")
    def card_set(spark, d):
        return ft.cards(items(spark, d)).select("id", listed(F.col(column)).alias("tokens"))


for _name, _column in {"char3_set": "name_grams", "digit_tokens": "digit_tokens", "article_tokens": "article_tokens", "brand_tokens": "brand_tokens"}.items():
    _card_set(_name, _column)


@query("word_ngrams", rf"with w as (select doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]{{2,}}') as w from documents) select doc_id, array_to_string({o.WORD_TERMS}, '|') as terms from w")
def word_ngrams(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(tx.word_terms(F.col("text")), "|").alias("terms"))


@query("char_wb_ngrams", f"with w as (select doc_id, text from documents) select doc_id, {sql_listed(o.CHAR_TERMS)} as terms from w")
def char_wb_ngrams(spark, d):
    return table(spark, d, "documents").select("doc_id", listed(tx.char_terms(F.col("text"))).alias("terms"))


# Pair features

GROUPS = {
    "pf_name": NAMES[0:5] + NAMES[7:8], "pf_char3": NAMES[5:7], "pf_values": NAMES[8:11], "pf_all_tokens": NAMES[11:14], "pf_keys": NAMES[14:17],
    "pf_shared_values": NAMES[17:21], "pf_digits": NAMES[21:26], "pf_articles": NAMES[26:31], "pf_brands": NAMES[31:36],
}


def structured(spark, d) -> DataFrame:
    return ft.structured(ft.joined(card_pairs(spark, d), items(spark, d)))


def _features(name: str, names: list[str]) -> None:
    @query(name, o.features(names))
    def pair_features(spark, d):
        return structured(spark, d).select("id1", "id2", *[r6(F.col(n)).alias(n) for n in names])


for _name, _names in GROUPS.items():
    _features(_name, _names)


def _scores(sql: str) -> str:
    return sql.replace("texts as (select text1", "doc_texts as (select text1").replace("from texts)", "from doc_texts)")


CARD_TEXTS = f"{PAIRS}, {o.TEXTS}, {o.TEXT_PAIRS}, {o.NAME_PAIRS}"


@query("pf_tfidf_text", f"{CARD_TEXTS}, {o.tfidf('source', 'word', 't_')} select id1, id2, round(s, 6) as text_tfidf from t_scores")
def pf_tfidf_text(spark, d):
    return tfidf.tfidf(pairs.with_texts(card_pairs(spark, d), items(spark, d)), "text_tfidf").select("id1", "id2", r6(F.col("text_tfidf")).alias("text_tfidf"))


@query("pf_tfidf_name", f"{CARD_TEXTS}, {o.tfidf('named', 'word', 'n_')} select id1, id2, round(s, 6) as name_tfidf from n_scores")
def pf_tfidf_name(spark, d):
    both = pairs.attach(card_pairs(spark, d), items(spark, d), {"name": tx.blank(F.col("name"))})
    return tfidf.name_cosine(both, "name_tfidf").select("id1", "id2", r6(F.col("name_tfidf")).alias("name_tfidf"))


# Scorers

DOC_TEXTS = f"with {o.DOC_ITEMS}, {o.DOC_PAIRS}, {o.TEXTS}, {o.TEXT_PAIRS}"


@query("score_tfidf", f"{DOC_TEXTS}, {o.tfidf('source', 'word', 'w_')} select id1, id2, round(s, 6) as predict from w_scores")
def score_tfidf(spark, d):
    return predict_scores(fx.document_pairs(spark, d), fx.document_items(spark, d), "tfidf").select("id1", "id2", r6(F.col("predict")).alias("predict"))


# SQL takes too long over whole texts: tests/test_whole.py has a plain version.
@query("score_tfidf_wc")
def score_tfidf_wc(spark, d):
    return predict_scores(fx.document_pairs(spark, d), fx.document_items(spark, d), "tfidf_wc").select("id1", "id2", r6(F.col("predict")).alias("predict"))


@query("score_embed", f"with {EMBED} select id1, id2, round(list_sum(list_transform(range(1, 65), lambda i: x[i::int]::double * y[i::int]::double)), 4) as predict from p")
def score_embed(spark, d):
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").cast("bigint").alias("key"), F.col("embedding").alias("vector"))
    asked = vector_pairs(spark, d).withColumns({"key1": F.col("id1"), "key2": F.col("id2")})
    return models.embedding_scores(asked, vectors).select("id1", "id2", F.round("predict", 4).alias("predict"))


COEF = "((i * 37) % 19 - 9) / 100.0"
VECTOR = "[" + ", ".join(f"{o.FEATURES[n]}::float" for n in NAMES[:36]) + ", t.s::float, n.s::float]"
EXPANDED = "list_concat(f, list_concat(list_transform(f, lambda v: v * v), list_concat(list_transform(f, lambda v: sqrt(greatest(v, 0))::float), " + "list_concat(".join(
    f"list_transform(f, lambda v: (v > {t}::float)::int::float), " for t in models.THRESHOLDS[:-1]
) + f"list_transform(f, lambda v: (v > {models.THRESHOLDS[-1]}::float)::int::float)" + ")" * (len(models.THRESHOLDS) - 1) + "))"
LINEAR = f"""{CARD_TEXTS}, {o.tfidf('source', 'word', 't_')}, {o.tfidf('named', 'word', 'n_')}, {o.CARDS},
vectors as (select b.id1, b.id2, b.category, {VECTOR} as f from both_cards b join t_scores t on t.id1 = b.id1 and t.id2 = b.id2 join n_scores n on n.id1 = b.id1 and n.id2 = b.id2),
expanded as (select id1, id2, category, {EXPANDED} as x from vectors),
linear as (select id1, id2, list_sum(list_transform(range(0, 380), lambda i: x[i::int + 1]::double * ({COEF})::float)) + (case when length(category) % 2 = 0 then 0.5 else -0.25 end) as s from expanded)"""


def fixed_linear(spark, d) -> DataFrame:
    """Given coefficients for categories of even length, and a fallback with another intercept."""
    coef = F.transform(F.sequence(F.lit(0), F.lit(379)), lambda i: (((i * 37) % 19 - 9) / 100.0).cast("float"))
    own = items(spark, d).filter(F.length("category") % 2 == 0).select("category").distinct().withColumn("intercept", F.lit(0.5))
    return own.unionByName(spark.createDataFrame([("__all__", -0.25)], "category string, intercept double")).select("category", coef.alias("coef"), F.col("intercept").cast("float").alias("intercept"))


def all_features(spark, d) -> DataFrame:
    return ft.pair_features(card_pairs(spark, d), items(spark, d))


@query("score_linear", f"{LINEAR} select id1, id2, round(s, 4) as predict from linear")
def score_linear(spark, d):
    return models.linear_scores(all_features(spark, d), fixed_linear(spark, d), vector()).select("id1", "id2", F.round("predict", 4).alias("predict"))


@query("predict_pipeline", f"{LINEAR} select id1, id2, round(s, 4) as predict from linear")
def predict_pipeline(spark, d):
    out = predict_scores(card_pairs(spark, d), items(spark, d), "supervised", fixed_linear(spark, d))
    return out.select("id1", "id2", F.round("predict", 4).alias("predict"))


def fixed_forest(spark) -> tuple[DataFrame, DataFrame]:
    """Three small trees for the fallback, one for a category that no card has."""
    from ..sources.tables import FOREST

    at = {n: i for i, n in enumerate(NAMES)}
    leaf = lambda t, n, v: ("__all__", t, n, 0, 0.0, True, -1, -1, True, v)
    split = lambda t, n, f, x, a, b: ("__all__", t, n, at[f], x, True, a, b, False, 0.0)
    nodes = [split(0, 0, "name_jaccard", 0.3, 1, 2), leaf(0, 1, -0.5), split(0, 2, "brand_exact", 0.5, 3, 4), leaf(0, 3, 0.25), leaf(0, 4, 1.0)]
    nodes += [split(1, 0, "value_jaccard", 0.5, 1, 2), leaf(1, 1, -0.125), leaf(1, 2, 0.75), split(2, 0, "digit_disjoint", 0.5, 1, 2), leaf(2, 1, 0.0625), leaf(2, 2, -0.25)]
    return spark.createDataFrame(nodes, FOREST), spark.createDataFrame([("__all__", 0.125)], "category string, baseline float")


F1 = o.FEATURES


@query("score_forest", f"""{CARD_SETS} select id1, id2, 0.125::double + (case when {F1['name_jaccard']}::float <= 0.3::float then -0.5 when {F1['brand_exact']} <= 0.5 then 0.25 else 1 end)
  + (case when {F1['value_jaccard']} <= 0.5 then -0.125 else 0.75 end) + (case when {F1['digit_disjoint']} <= 0.5 then 0.0625 else -0.25 end) as predict from both_cards""")
def score_forest(spark, d):
    rows = structured(spark, d).withColumns({n: F.lit(0.0) for n in NAMES[36:]})
    return models.forest_scores(rows, *fixed_forest(spark), vector()).select("id1", "id2", "predict")


# Training: SQL can't say it; tests/test_train.py holds the learners against plain ones


def training(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = cut(sampling.tail_split(all_features(spark, d)), "training")
    return rows.filter("not is_valid"), rows.filter("is_valid")


def holdout_ap(scored_rows: DataFrame) -> DataFrame:
    return metrics.ap_per_category(scored_rows.select(F.col("target").alias("y"), F.col("predict").alias("s"), F.col("category").alias("cat")))


@query("train_logistic")
def train_logistic(spark, d):
    fit, valid = training(spark, d)
    return holdout_ap(models.linear_scores(valid, train.train_logistic(fit, vector()), vector()))


@query("train_boosting")
def train_boosting(spark, d):
    fit, valid = training(spark, d)
    return holdout_ap(models.forest_scores(valid, *train.train_boosting(fit, vector()), vector()))


@query("train_extra_trees_like")
def train_extra_trees_like(spark, d):
    fit, valid = training(spark, d)
    return holdout_ap(train.tree_scores(valid, train.train_trees(fit, vector()), vector()))


@query("train_weighted_hybrid")
def train_weighted_hybrid(spark, d):
    fit, valid = training(spark, d)
    human = fit.withColumn("target", F.col("target").cast("double"))
    # Soft labels of all pairs, by a rater who is nine tenths sure of the positive ones.
    soft = human.withColumn("target", 0.9 * F.col("target"))
    out = None
    for factor in (2.0, 5.0, 10.0):
        fitted = train.train_boosting(train.hybrid_rows(human, soft, factor), vector(), weight="weight", fallback=False)
        ap = holdout_ap(models.forest_scores(valid, *fitted, vector())).select(F.lit(factor).alias("human_weight"), "cat", "ap")
        out = ap if out is None else out.unionByName(ap)
    return out


# Contract


@query("validate_output", f"""{PAIRS} select 'row_count' as check_name, (select count(*) from pairs where target = 1) as n_bad
union all select 'not_a_number', (select count(*) from pairs where target = 0 and id2 - id1 > 30)
union all select 'missing_pairs', (select count(*) from pairs where target = 1) union all select 'repeated_pairs', 0""")
def validate_output(spark, d):
    """An output without the positive pairs, and no number for pairs of distant ids."""
    expected = card_pairs(spark, d)
    produced = expected.filter("target = 0").select("id1", "id2", F.when(F.col("id2") - F.col("id1") > 30, float("nan")).otherwise(1.0).alias("predict"))
    return pairs.validate_output(expected, produced)
