"""URL filter by empirical-Bayes host reputation, in SQL functions only.

Each page has an outcome of its own: by the rule that fits it (allow: good, block: bad), else by what the whole page and
its url show: spam terms, mostly links, mostly repeated lines, hardly any text. With two of these signs, or spam terms,
it is bad, without any good, else unlabelled. Bad pages of a host are beta-binomial. The prior of a public suffix is
fitted to the whole table, that of a registered domain to its suffix, that of a host to its domain: the mean is the
level above's posterior mean, the strength comes from how far the groups below differ. A host is blocked when the lower
bound of its posterior share of bad pages is over LIMIT, so hosts without evidence are let through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, join_by_key, text_or_empty

#: The production rules: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Terms that name spam, in a host's labels, a path or a text.
SPAM = (
    "adult bet bets betting blackjack bonus casino casinos cialis gambling hentai jackpot loan loans mortgage nude payday pharmacy "
    "pills poker porn porno pornos roulette sex slot slots spam viagra xanax xxx"
).split()
#: Public suffixes of more than one label; a parameter, as the full list is long and changes. A last label
#: is a suffix anyhow.
SUFFIXES = (
    "ac.uk co.uk gov.uk me.uk org.uk com.au edu.au net.au org.au co.nz org.nz com.br net.br org.br co.jp ac.jp ne.jp or.jp co.kr or.kr co.in "
    "net.in org.in com.cn net.cn org.cn com.tw org.tw com.hk com.sg com.my co.id com.mx com.ar com.co com.tr co.za org.za co.il org.il com.pl "
    "com.ua com.ru com.pt com.es com.gr github.io blogspot.com wordpress.com"
).split()
#: Signs: spam terms a word of text; links' share of text, and their least number; repeated lines' share of lines, and
#: the least number of lines; text's share of the page, and the page's least length.
SPAM_SHARE, LINK_SHARE, LINKS, REPEAT_SHARE, LINES, TEXT_SHARE, LENGTH = 0.02, 0.5, 10, 0.5, 10, 0.05, 2000
#: Blocked above this share of bad pages, at this many standard deviations below the posterior mean.
LIMIT, DEVIATIONS = 0.5, 1.645
#: Bounds of a prior's strength in pages, and that of the whole table's prior.
WEAKEST, STRONGEST, FIRST = 1.0, 50.0, 2.0

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path. Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ?,
    # or the end. Both are empty for a null url or one without ://."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, 2147483647)).otherwise(F.lit(""))
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.substring_index(F.substring_index(tail, "?", 1), "#", 1)
    return F.translate(host, UPPER, LOWER), path


def fitting(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. Of rules of equal length the first counts."""
    rule = verdict = F.lit(None).cast("string")
    for name, start, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, name + start).otherwise(rule)
        verdict = F.when(fits, what).otherwise(verdict)
    return rule, verdict


RAW = r"(?is)<(script|style)\b.*?(?:</\1|\z)|<!--.*?(?:-->|\z)"
BLOCK = r"(?i)</?(?:p|div|li|ul|ol|br|hr|h[1-6]|tr|td|th|table|section|article|nav|header|footer|title)\b[^<>]*>?"
LINK = r"(?is)<a\b[^<>]*>(.*?)(?:</a|\z)"


def signs(rows: DataFrame, html_col: str) -> DataFrame:
    """rows (host, path, and the page in html_col) with signs, the number of signs of a bad page, and spam, whether one
    is spam terms, in place of html_col. A null page has no text: only its url can show spam."""
    plain = lambda x: F.regexp_replace(x, "<[^<>]*>?", " ")
    out = rows.withColumn("__page", F.regexp_replace(text_or_empty(html_col), RAW, " ")).withColumn("__size", F.length(text_or_empty(html_col))).drop(html_col)
    lines = F.filter(F.transform(F.split("__page", BLOCK), lambda x: F.trim(F.regexp_replace(plain(x), r"\s+", " "))), lambda x: x != "")
    out = out.select("*", lines.alias("__lines"), F.regexp_extract_all("__page", F.lit(LINK), F.lit(1)).alias("__links")).drop("__page")
    out = out.withColumn("__text", F.lower(F.array_join("__lines", " "))).withColumn("__words", F.split("__text", "[^a-z]+"))
    found = lambda words: F.size(F.filter(words, lambda w: w.isin(SPAM)))
    n_lines, n_text, n_words = F.size("__lines"), F.length("__text"), F.size("__words")
    in_links = F.length(F.trim(F.regexp_replace(plain(F.array_join("__links", " ")), r"\s+", " ")))
    in_url = found(F.split(F.lower(F.concat_ws(" ", "host", "path")), "[^a-z]+"))
    spam = (in_url > 0) | (found(F.col("__words")) > SPAM_SHARE * n_words)
    others = (
        (F.size("__links") >= LINKS) & (in_links > LINK_SHARE * n_text),
        (n_lines >= LINES) & (n_lines - F.size(F.array_distinct("__lines")) > REPEAT_SHARE * n_lines),
        (F.col("__size") >= LENGTH) & (n_text < TEXT_SHARE * F.col("__size")),
    )
    out = out.withColumns({"spam": spam, "signs": sum(x.cast("int") for x in (spam, *others))})
    return out.drop("__size", "__lines", "__links", "__text", "__words")


def registered(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """The public suffix of a host, without its port, and its registered domain, a label more; of an address of numbers
    both are the address."""
    bare = F.regexp_replace(host, r"^.*@|:[0-9]*$|\.$", "")
    last = lambda n: F.substring_index(bare, ".", -n)
    suffix, domain = last(1), last(2)
    for depth in sorted({s.count(".") + 1 for s in suffixes}):
        named = last(depth).isin([s for s in suffixes if s.count(".") + 1 == depth])
        suffix, domain = F.when(named, last(depth)).otherwise(suffix), F.when(named, last(depth + 1)).otherwise(domain)
    number = bare.rlike(r"^[0-9.]+$")
    return F.when(number, bare).otherwise(suffix), F.when(number, bare).otherwise(domain)


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", rules=RULES, suffixes=SUFFIXES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, reputation (the bound that judged; null if a rule
    did), outcome (1 bad, 0 good, null unlabelled).

    A null url, or one without ://, has an empty host, whose reputation is judged like any other's. A null html shows
    nothing, and without html_col pages are labelled by rules and urls. Repeated rows get equal rows, an empty table
    none; other columns are ignored.
    """
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), (F.col(html_col) if html_col else F.lit("")).alias("__html"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    outcome = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    outcome = outcome.when(F.col("spam") | (F.col("signs") >= 2), 1).when(F.col("signs") == 0, 0)
    rows = signs(rows.select("*", rule.alias("rule"), verdict.alias("ruled")), "__html")
    rows = cut(rows.select("page_id", "host", "path", "rule", "ruled", outcome.alias("outcome")), "urls")

    counted = rows.groupBy("host").agg(F.count("*").alias("pages"), F.count("outcome").alias("n"), F.coalesce(F.sum("outcome"), F.lit(0)).alias("bad"))
    bounds = cut(posterior(counted, suffixes), "reputation").select("host", "pages", "bound")
    known = join_by_key(rows, bounds, "host", "pages", rows.count())
    own = F.when(F.col("bound") > LIMIT, "block").otherwise("allow")
    reputation = F.when(F.col("rule").isNull(), F.col("bound")).alias("reputation")
    return known.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), reputation, "outcome")


def posterior(counted: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """counted (host, n labelled pages, bad) with mean and strength of the prior and bound: the posterior's mean less
    DEVIATIONS of its deviations."""
    suffix, domain = registered(F.col("host"), suffixes)
    hosts = cut(counted.withColumns({"suffix": suffix, "domain": domain}), "hosts")

    def level(below: DataFrame, *keys: str) -> DataFrame:
        """Sums of the groups below, and the strength that their spread about the mean gives, by moments."""
        mean = (F.sum("bad") / F.sum("n")).alias("mean")
        sums = below.groupBy(*keys).agg(
            F.sum("n").alias("n"), F.sum("bad").alias("bad"), mean, F.count("*").alias("below"),
            F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("groups"),
            F.sum(F.when(F.col("n") > 0, F.col("bad") * F.col("bad") / F.col("n"))).alias("squares"),
        )
        m, g = F.col("mean"), F.col("groups")
        spread = m * (1 - m)
        # Sum over groups of n (share - mean)^2 is (groups - 1) spread if they don't differ, (n - 1) / (1 + strength) more if they do.
        between = F.col("squares") - F.col("n") * m * m - (g - 1) * spread
        strength = F.when((g < 2) | (spread <= 0) | (between <= 0), STRONGEST).otherwise(F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), spread * (F.col("n") - g) / between - 1)))
        return cut(sums.select(*keys, "n", "bad", "below", F.coalesce(strength, F.lit(STRONGEST)).alias("strength")), "level")

    def shrunk(rows: DataFrame, mean: Column, strength: Column) -> DataFrame:
        """rows with the posterior mean under a prior of this mean and strength, and that strength as prior."""
        after = (F.col("bad") + strength * mean) / (F.col("n") + strength)
        return rows.withColumns({"mean": after, "prior": strength})

    def under(rows: DataFrame, above: DataFrame, key: str) -> DataFrame:
        """rows shrunk to their group in above. A suffix or domain may have many of them: its prior is broadcast then."""
        up = above.select(key, F.col("strength").alias("above_strength"), F.col("mean").alias("above_mean"), "below")
        joined = join_by_key(rows.drop("mean", "prior"), up, key, "below", rows.count())
        return shrunk(joined, F.col("above_mean"), F.col("above_strength")).drop("above_mean", "above_strength")

    domains = level(hosts, "suffix", "domain")
    suffix_rows = level(domains, "suffix")
    whole = level(suffix_rows).first()  # one row
    bad, n = (whole.bad or 0, whole.n or 0) if whole else (0, 0)
    suffix_rows = shrunk(suffix_rows, F.lit((bad + 0.5 * FIRST) / (n + FIRST)), F.lit(whole.strength if whole else STRONGEST))
    domain_rows = under(domains, suffix_rows, "suffix")
    found = under(hosts, domain_rows.drop("suffix"), "domain")
    size = F.col("n") + F.col("prior")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (size + 1))
    return found.withColumn("bound", F.col("mean") - DEVIATIONS * deviation)
