"""URL filter: rules stated by host and path, and association rules mined from the URLs those rules judge.

Words of host and path are the tokens. For each label, combinations of tokens that are frequent among its URLs are grown
by a token at a time; how sure each is, is counted over all labelled URLs. Rules that are sure enough stay unless a part
of their tokens says the same at least as surely. Rules on words of the host alone go after that: labels known of a part
of a site are not stretched over all of it. A URL meets the mined rules through an inverted index from each rule's rarest
token, and the surest rule whose tokens it all has decides.

Bounds: tokens that are infrequent under every label are left out by a count before anything is combined, which changes
no rule. A combination is grown only while each of its tokens keeps out some URL of another label that the others let in.
One that does not is never a rule, nor is any that holds it: without the token it is as sure, or surer, and as frequent.
So tokens that stand together, however many, are not combined with each other, and a rule has at most one token more than
some URL of another label. All tokens of a URL take part.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspark.llm.joins import by_key
from shelfspark.sources.storage import stage

SUPPORT = 0.01
CONFIDENCE = 0.95
ALLOW, BLOCK = "allow", "block"
HOST, PATH = "host=", "path="
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z lower-cased; empty without ://."""
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def stated_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of (host, path) `rules` that fits, written as host + path, or null.

    A rule fits its host and all subdomains if the path starts with the rule's. Of equally long ones the first in
    the order of their text decides.
    """
    found = F.lit(None).cast("string")
    for rule_host, rule_path in sorted(rules, key=lambda r: (len(r[0] + r[1]), [-ord(c) for c in r[0] + r[1]])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.lit(rule_host + rule_path)).otherwise(found)
    return found


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct words of the whole host and the whole path, in lower case and with 0 for a number; none without a host.

    Numbers alone are no words.
    """
    def words(text: Column, kind: str) -> Column:
        found = F.split(F.regexp_replace(F.lower(text), "[0-9]+", "0"), r"[^\p{L}\p{M}0]+")
        return F.transform(F.filter(found, lambda w: ~w.isin("", "0")), lambda w: F.concat(F.lit(kind), w))

    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.sort_array(F.array_distinct(F.concat(words(host, HOST), words(path, PATH)))))


def _rarest(rules: DataFrame) -> DataFrame:
    """`rules` with `token`, the one of their `needed` that fewest of them have."""
    each = rules.select("needed", F.explode("needed").alias("token"))
    spread = each.groupBy("token").agg(F.count("*").alias("held"))
    chosen = each.join(spread, "token").groupBy("needed").agg(F.min_by("token", F.struct("held", "token")).alias("token"))
    return rules.join(chosen, "needed")


def _meet(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs of `sets` (tokens …) and `rules` (needed …), bounded in number, whose tokens a set all has."""
    return (
        sets.withColumn("token", F.explode("tokens"))
        .join(F.broadcast(_rarest(rules)), "token")
        .filter(F.size(F.array_except("needed", "tokens")) == 0)
        .drop("token")
    )


def _extended(rows: DataFrame) -> DataFrame:
    """`rows` (needed, rest, label, n) with each token of `rest` moved to `needed`, and those after it left as `rest`."""
    return rows.select("needed", "label", "n", "rest", F.posexplode("rest").alias("at", "token")).select(
        F.concat("needed", F.array("token")).alias("needed"), "label", "n",
        F.slice("rest", F.col("at") + 2, F.size("rest")).alias("rest"))


def _grown(rows: DataFrame, totals: dict[str, int], support: float, confidence: float, parts: DataFrame | None) -> DataFrame:
    """Combinations (needed, label, others, sure, best, kept) that are one token longer than those of `rows`.

    Only those that are frequent in their label and of which each token keeps out URLs of other labels, `others` of which
    have them all. `sure` is their confidence, `best` that of the surest rule made of some or all of their tokens, `kept`
    whether they are a rule surer than those made of some. `parts` are the same of a token less.
    """
    total = F.create_map(*[F.lit(x) for pair in totals.items() for x in pair])[F.col("label")]
    counted = (
        _extended(rows).groupBy("needed", "label").agg(F.sum("n").alias("n"))
        .groupBy("needed").agg(F.sum("n").alias("held"), F.collect_list(F.struct("label", "n")).alias("labels"))
        .select("needed", "held", F.inline("labels"))
        .filter(F.col("n") / total >= support)
        .select("needed", "label", (F.col("held") - F.col("n")).alias("others"), (F.col("n") / F.col("held")).alias("sure"))
    )
    if parts is None:
        counted = counted.withColumn("known", F.lit(0.0))
    else:
        less = F.transform("needed", lambda _, i: F.concat(
            F.slice("needed", 1, i), F.slice("needed", i + 2, F.size("needed"))))
        each = stage(counted).withColumn("part", F.explode(less))
        counted = (
            each.join(parts.select(F.col("needed").alias("part"), "label", F.col("others").alias("let_in"), "best"), ["part", "label"])
            .filter(F.col("let_in") > F.col("others"))
            .groupBy("needed", "label").agg(
                F.first("others").alias("others"), F.first("sure").alias("sure"), F.max("best").alias("known"),
                F.count("*").alias("open"))
            .filter(F.col("open") == F.size("needed"))
        )
    rule = F.when(F.col("sure") >= confidence, F.col("sure")).otherwise(F.lit(0.0))
    return stage(counted.select(
        "needed", "label", "others", "sure", F.greatest("known", rule).alias("best"), (rule > F.col("known")).alias("kept")))


def mine_rules(
    labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE
) -> list[tuple[tuple[str, ...], str, float]]:
    """(tokens, label, confidence) of association rules from rows (tokens, label or null); none from an empty table.

    Rows without a label or tokens take no part. A rule needs `support` of the rows of its label, `confidence` of all
    labelled rows that have its tokens. It is dropped when some of its tokens alone give a rule for the same label that
    is at least as sure, and then if it has no token of a path.
    """
    sets = stage(
        labelled.filter(F.col("label").isNotNull() & (F.size("tokens") > 0))
        .groupBy("tokens", "label").agg(F.count("*").alias("n")))
    totals = {r["label"]: r["n"] for r in sets.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return []
    total = F.create_map(*[F.lit(x) for pair in totals.items() for x in pair])[F.col("label")]
    # At most the mean number of tokens of a URL, divided by the support, of them for each label. Numbered from the rarest,
    # so that what is left to combine with a token is frequent, and often the same.
    frequent = stage(
        sets.select("label", "n", F.explode("tokens").alias("token"))
        .groupBy("token", "label").agg(F.sum("n").alias("n"), (F.sum("n") / F.first(total)).alias("share"))
        .groupBy("token").agg(F.max("share").alias("top"), F.sum("n").alias("held"))
        .filter(F.col("top") >= support)
        .select("token", F.row_number().over(Window.orderBy("held", "token")).alias("number")))
    tokens = {r["number"]: r["token"] for r in frequent.collect()}
    rows = stage(
        sets.withColumn("token", F.explode("tokens")).join(F.broadcast(frequent), "token")
        .groupBy("tokens", "label", "n").agg(F.sort_array(F.collect_list("number")).alias("rest"))
        .groupBy("rest", "label").agg(F.sum("n").alias("n"))
        .select(F.array().cast("array<int>").alias("needed"), "rest", "label", "n"))
    found, parts = [], None
    while True:
        parts = _grown(rows, totals, support, confidence, parts)
        found += parts.filter("kept").select("needed", "label", "sure").collect()
        # Where no URL of another label has them all, a further token keeps out none.
        parts = parts.filter("others > 0")
        if parts.isEmpty():
            break
        longer = _extended(rows).filter(F.size("rest") > 0).join(parts.select("needed").distinct(), "needed", "left_semi")
        rows = stage(longer.groupBy("needed", "rest", "label").agg(F.sum("n").alias("n")))
    rules = [(tuple(sorted(tokens[i] for i in r["needed"])), r["label"], r["sure"]) for r in found]
    return [rule for rule in sorted(rules) if any(t.startswith(PATH) for t in rule[0])]


def match_rules(rows: DataFrame, rules: list[tuple[tuple[str, ...], str, float]]) -> DataFrame:
    """`rows`, which have `tokens`, with `mined`, the label of the surest rule whose tokens a row all has, or null.

    Equally sure rules: the one with more tokens, then the stricter label, then the order of their tokens. Each
    distinct set of tokens is matched once.
    """
    if not rules:
        return rows.withColumn("mined", F.lit(None).cast("string"))
    ranked = sorted(rules, key=lambda r: (-r[2], -len(r[0]), r[1] != BLOCK, r[0]))
    table = rows.sparkSession.createDataFrame(
        [(list(needed), label, place) for place, (needed, label, _) in enumerate(ranked)],
        "needed ARRAY<STRING>, verdict STRING, place INT")
    sets = stage(rows.groupBy("tokens").agg(F.count("*").alias("n")))
    best = _meet(sets, table).groupBy("tokens").agg(F.min_by("verdict", "place").alias("mined"))
    facts = stage(sets.join(best, "tokens", "left"))
    total = facts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return by_key(rows, facts, ["tokens"], total).drop("n")


def judge_urls(
    pages: DataFrame, rules: dict[tuple[str, str], str], identity: str = "page_id", url: str = "url",
    support: float = SUPPORT, confidence: float = CONFIDENCE,
) -> DataFrame:
    """(identity, host, path, rule, verdict, mined) of every row of `pages`, by stated and mined rules.

    The URLs that a stated rule judges are the labelled ones, from which rules for the rest are mined, at once. A URL
    that no rule of either kind fits is allowed. Null URLs and those without :// have empty host and path, no
    tokens, and are allowed. Repeated rows each give a row; null ids stay; an empty table gives no rows.
    """
    rows = (
        pages.select(F.col(identity).alias("id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
        .withColumn("rule", stated_rule(F.col("host"), F.col("path"), list(rules)))
        .withColumn("tokens", url_tokens(F.col("host"), F.col("path")))
    )
    said = F.create_map(*[F.lit(x) for (h, p), verdict in rules.items() for x in (h + p, verdict)])
    found = mine_rules(rows.select("tokens", said[F.col("rule")].alias("label")), support, confidence)
    return match_rules(rows, found).select(
        F.col("id").alias(identity), "host", "path", "rule",
        F.coalesce(said[F.col("rule")], F.col("mined"), F.lit(ALLOW)).alias("verdict"), "mined",
    )
