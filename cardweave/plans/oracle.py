"""Pieces of SQL for DuckDB, from which the queries' statements are put together."""

from __future__ import annotations

ITEMS = """items as (
  select p_partkey as id,
    concat(p_name, case when p_partkey % 4 = 1 then concat(' ', cast(p_size as varchar)) else '' end) as name,
    concat('{"Тип": "', p_type, '"',
      case when p_partkey % 5 <> 0 then concat(', "Бренд": "', replace(p_brand, '#', ''), '"') else '' end,
      case when p_partkey % 3 <> 0 then concat(', "Размер": ', cast(p_size as varchar)) else '' end,
      case when p_partkey % 4 <> 0 then concat(', "Артикул": "A', cast(p_partkey % 13 as varchar), '"') else '' end, '}') as attributes,
    p_type as category, p_brand as brand
  from part)"""

PAIRS = """pairs as (
  select a.id as id1, b.id as id2, cast(a.brand = b.brand as int) as target
  from items a join items b on a.category = b.category and b.id > a.id and b.id <= a.id + 40)"""

DOC_ITEMS = """items as (
  select doc_id as id, text as name,
    case when doc_id % 3 <> 0 then concat('{"источник": "', source, '"}') end as attributes, lang as category
  from documents)"""

DOC_PAIRS = """pairs as (
  select a.id as id1, b.id as id2 from items a join items b on a.category = b.category and b.id > a.id and b.id <= a.id + 5)"""


def norm(x: str) -> str:
    return f"array_to_string(regexp_extract_all(replace(lower(coalesce({x}, '')), 'ё', 'е'), '[0-9a-zа-яё]+'), ' ')"


def tokens(n: str) -> str:
    return f"(case when {n} = '' then []::varchar[] else list_distinct(string_split({n}, ' ')) end)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def keyed(needles: tuple[str, ...]) -> str:
    pattern = "|".join(needles)
    return f"list_distinct(flatten(list_transform(list_filter(attrs, lambda e: regexp_matches(e.k, '{pattern}')), lambda e: string_split(e.v, ' '))))"


JSON_TEXT = """coalesce(array_to_string(list_transform(json_keys(attributes), lambda k: k || ' ' || coalesce(json_extract_string(attributes, '$."' || k || '"'), 'None')), ' '), '')"""
TEXT = strip(f"coalesce(name, '') || ' ' || {JSON_TEXT}")

CARDS = f"""parsed as (
  select id, name, attributes, category, {norm("name")} as nm,
    list_filter(list_transform(json_keys(attributes), lambda k: struct_pack(k := {norm("k")}, v := {norm("json_extract_string(attributes, '$.\"' || k || '\"')")})), lambda e: e.k <> '' and e.v <> '') as attrs
  from items),
sets as (
  select *, {tokens("nm")} as name_tokens,
    (case when nm = '' then []::varchar[] when length(replace(nm, ' ', '')) <= 3 then [replace(nm, ' ', '')]
      else list_distinct(list_transform(range(1, length(replace(nm, ' ', '')) - 1), lambda i: substr(replace(nm, ' ', ''), i::int, 3))) end) as name_grams,
    list_distinct(flatten(list_transform(attrs, lambda e: string_split(e.v, ' ')))) as value_tokens,
    list_transform(attrs, lambda e: e.k) as attr_keys,
    {keyed(("артикул", "модель", "партномер", "oem", "код товара", "sku"))} as article_tokens,
    {keyed(("бренд", "производитель", "марка"))} as brand_tokens
  from parsed),
cards as (
  select *, list_distinct(list_concat(name_tokens, value_tokens)) as all_tokens,
    list_filter(list_distinct(list_concat(name_tokens, value_tokens)), lambda t: regexp_matches(t, '[0-9]')) as digit_tokens
  from sets),
both_cards as (
  select p.id1, p.id2, a.category, a as l, b as r from pairs p join cards a on a.id = p.id1 join cards b on b.id = p.id2)"""


def sim(column: str, kind: str, left: str | None = None, right: str | None = None) -> str:
    a, b = left or f"l.{column}", right or f"r.{column}"
    both, n, m = f"len(list_intersect({a}, {b}))", f"len({a})", f"len({b})"
    part, whole = {
        "jaccard": (both, f"({n} + {m} - {both})"),
        "dice": (f"2 * {both}", f"({n} + {m})"),
        "containment": (both, f"least({n}, {m})"),
        "count_ratio": (f"least({n}, {m})", f"greatest({n}, {m})"),
    }[kind]
    return f"(case when {whole} > 0 then ({part})::double / {whole} else 0 end)"


def _sql_features() -> dict[str, str]:
    out = {"name_exact": "(l.nm = r.nm and l.nm <> '')::int::double"}
    out |= {f"name_{k}": sim("name_tokens", k) for k in ("jaccard", "dice", "containment", "count_ratio")}
    out |= {f"name_char3_{k}": sim("name_grams", k) for k in ("jaccard", "containment")}
    out["name_length_ratio"] = "(case when greatest(length(l.nm), length(r.nm)) > 0 then least(length(l.nm), length(r.nm))::double / greatest(length(l.nm), length(r.nm)) else 0 end)"
    for name, column in (("value", "value_tokens"), ("all", "all_tokens"), ("key", "attr_keys"), ("digit", "digit_tokens"), ("article", "article_tokens"), ("brand", "brand_tokens")):
        for k in ("jaccard", "containment", "count_ratio"):
            out[f"{name}_{k}"] = sim(column, k)
    value = lambda side, k: f"list_filter({side}.attrs, lambda e: e.k = {k})[1].v"
    shared = "list_intersect(l.attr_keys, r.attr_keys)"
    words = lambda side: f"list_distinct(string_split({value(side, 'k')}, ' '))"
    jaccard = sim("", "jaccard", words("l"), words("r"))
    mean = lambda of: f"coalesce(list_avg(list_transform({shared}, lambda k: {of})), 0)"
    out["shared_value_exact"] = mean(f"({value('l', 'k')} = {value('r', 'k')})::int::double")
    out["shared_value_jaccard"] = mean(jaccard)
    out["shared_value_conflict"] = mean(f"({jaccard} = 0)::int::double")
    out["shared_key_count"] = f"least(len({shared}) / 10.0, 1)::double"
    for name in ("digit", "article", "brand"):
        a, b = f"l.{name}_tokens", f"r.{name}_tokens"
        out[f"{name}_disjoint"] = f"(len({a}) > 0 and len({b}) > 0 and len(list_intersect({a}, {b})) = 0)::int::double"
        out[f"{name}_presence_equal"] = f"((len({a}) = 0) = (len({b}) = 0))::int::double"
    out["brand_exact"] = "(len(l.brand_tokens) > 0 and list_sort(l.brand_tokens) = list_sort(r.brand_tokens))::int::double"
    return out


FEATURES = _sql_features()


def features(names: list[str]) -> str:
    """id1, id2 and rounded features of the pairs of cards."""
    columns = ", ".join(f"round({FEATURES[n]}, 6) as {n}" for n in names)
    return f"with {ITEMS}, {PAIRS}, {CARDS} select id1, id2, {columns} from both_cards"


WORD_TERMS = r"""list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i::int] || ' ' || w[i::int + 1]))"""
CHAR_TERMS = """flatten(list_transform(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> ''), lambda x:
  flatten(list_transform([2, 3, 4, 5], lambda n: list_transform(range(1, greatest(length(x) + 4 - n, 1)), lambda i: substr(' ' || x || ' ', i::int, n))))))"""


def tfidf(source: str, kind: str, prefix: str = "") -> str:
    """CTEs that end in {prefix}scores (id1, id2, s); source has id1, id2, text1, text2."""
    p = prefix
    words = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
    terms = f"select md5(text) as k, unnest({WORD_TERMS}) as term from (select text, {words} as w from {p}texts)" if kind == "word" else f"select md5(text) as k, unnest({CHAR_TERMS}) as term from {p}texts"
    return f"""{p}texts as (select text1 as text from {source} union select text2 from {source}),
{p}tf as materialized (select k, term, count(*) as tf from ({terms}) group by 1, 2),
{p}df as (select term, count(*) as df, sum(tf) as ctf from {p}tf group by 1 having count(*) >= 2),
{p}raw as (select k, term, (1 + ln(tf)) * (ln((1 + (select count(*) from {p}texts)) / (1.0 + df)) + 1) as w from {p}tf join {p}df using (term)),
{p}w as materialized (select k, term, w / sqrt(sum(w * w) over (partition by k)) as w from {p}raw),
{p}keyed as materialized (select id1, id2, md5(text1) as k1, md5(text2) as k2 from {source}),
{p}asked as (select distinct k1, k2 from {p}keyed),
{p}dots as (select k1, k2, sum(a.w * b.w) as s from {p}asked join {p}w a on a.k = k1 join {p}w b on b.k = k2 and a.term = b.term group by 1, 2),
{p}scores as (select id1, id2, coalesce(s, 0) as s from {p}keyed left join {p}dots using (k1, k2))"""


TEXTS = f"texts as (select id, category, coalesce(name, '') as raw_name, {TEXT} as text from items)"
TEXT_PAIRS = "source as (select p.id1, p.id2, a.text as text1, b.text as text2 from pairs p join texts a on a.id = p.id1 join texts b on b.id = p.id2)"
NAME_PAIRS = "named as (select p.id1, p.id2, a.raw_name as text1, b.raw_name as text2 from pairs p join texts a on a.id = p.id1 join texts b on b.id = p.id2)"


def draw(seed: int) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', id1, id2)), 1, 8))::bigint"


SCORED = "scored as (select l.quality as y, d.n_chars as s, d.lang as cat from documents d join labels l using (doc_id))"
AP = """g as (select cat, s, sum(y) as p, count(*) as n from scored where cat is not null group by cat, s),
steps as (select cat, p, sum(p) over (partition by cat order by s desc) as tp, sum(n) over (partition by cat order by s desc) as nn,
  sum(p) over (partition by cat) as pa, sum(n) over (partition by cat) as na from g),
aps as (select cat, sum(p * 1.0::double / pa * tp / nn) as ap from steps where pa > 0 and pa < na group by cat)"""
