"""URL verdicts: rules first, else a ratio of character language models, in DataFrame operations only.

URLs that an allow rule fits are the accepted sample, those that a block rule
fits the rejected one.  For each, a character model of variable order (contexts
of ORDER - 1 characters backing off to shorter ones and none, interpolated after
Witten and Bell) is estimated from counts over all URLs.  Characters are only
lower-cased (A-Z), so the counts are a table that grows with the URLs; it is
joined on context and character.  Of the strings of ORDER characters, those with
over 1 / HEAVY of all positions each are broadcast (there are fewer than HEAVY),
so that frequent ones don't gather in a task.  The score is the mean log-ratio
over a URL's positions; the threshold is the one with the best balanced accuracy
on the rule-judged URLs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEAVY, cut, drop

#: (host, path, verdict); a rule fits its host and all subdomains.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Characters of the longest string that is counted: its last one, and the context before it.
ORDER = 5
#: Probability of a character of which nothing is known.
UNSEEN = 1 / 256
#: Marks of the beginning and the end of a URL.
BEGIN, END = "\x02", "\x03"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path and all after the scheme; empty for null and for URLs without '://'."""
    at = F.locate("://", url)
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(after, "^([^/?#]*)", 1)
    return F.translate(raw, UPPER, LOWER), F.regexp_extract(F.substr(after, F.length(raw) + 1), "^([^?#]*)", 1), after


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def characters(after: Column) -> Column:
    """The lower-cased characters of a URL between its marks."""
    padded = F.concat(F.lit(BEGIN * (ORDER - 1)), F.translate(F.coalesce(after, F.lit("")), UPPER, LOWER), F.lit(END))
    return F.split(padded, "")


def strings(chars: str) -> Column:
    """For each position of a URL, and its end, the ORDER characters up to there.

    chars must be a stored column: an expression would be evaluated again for each position.
    """
    return F.transform(F.sequence(F.lit(0), F.size(chars) - ORDER), lambda i: F.concat(*[F.get(F.col(chars), i + k) for k in range(ORDER)]))


def log_ratios(counts: DataFrame) -> DataFrame:
    """counts (t, accepted, rejected, ...) with the log-ratio of the last character's probabilities after its context, as column ratio.

    Witten-Bell: P(c | context) = (n(context c) + kinds(context) * P(c | shorter)) / (n(context) + kinds(context)).
    """
    sides = ("accepted", "rejected")
    table = counts.select("t", *[F.lit(UNSEEN).alias("p_" + side) for side in sides])
    for k in range(1, ORDER + 1):
        own, context = F.substr("t", F.lit(ORDER + 1 - k), F.lit(k)), F.substr("t", F.lit(ORDER + 1 - k), F.lit(k - 1))
        grams = counts.groupBy(own.alias("_own")).agg(*[F.sum(side).alias("n_" + side) for side in sides])
        around = grams.groupBy(F.substr("_own", F.lit(1), F.lit(k - 1)).alias("_context")).agg(
            *[F.sum("n_" + side).alias("all_" + side) for side in sides], *[F.count_if(F.col("n_" + side) > 0).alias("kinds_" + side) for side in sides]
        )
        table = table.withColumns({"_own": own, "_context": context}).join(grams, "_own").join(around, "_context")
        p = {s: F.when(F.col("all_" + s) > 0, (F.col("n_" + s) + F.col("kinds_" + s) * F.col("p_" + s)) / (F.col("all_" + s) + F.col("kinds_" + s))).otherwise(F.col("p_" + s)) for s in sides}
        table = table.select("t", *[p[s].alias("p_" + s) for s in sides])
    return counts.join(table.select("t", (F.log("p_accepted") - F.log("p_rejected")).alias("ratio")), "t")


def url_verdicts(pages: DataFrame, rules=RULES, step: float = 0.02) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row.

    Null URLs and those without '://' have an empty host and path and the score
    of an empty string.  URLs of any length are read whole.  Repeated rows get
    equal verdicts.  If no rule fits any URL on one side, every score is 0 and
    the verdict of the method is allow.  Other columns are ignored.
    """
    host, path, after = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), after.alias("_after"))
    rule, fixed = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "_fixed": fixed, "_chars": characters(F.col("_after")), "_row": F.monotonically_increasing_id()})
    rows = cut(rows.drop("_after"), "urls")
    each = rows.select("_row", "_fixed", F.explode(strings("_chars")).alias("t"))
    counts = cut(each.groupBy("t").agg(F.count_if(F.col("_fixed") == "allow").alias("accepted"), F.count_if(F.col("_fixed") == "block").alias("rejected"), F.count(F.lit(1)).alias("k")), "url-counts")
    ratios = cut(log_ratios(counts).select("t", "k", "ratio"), "url-ratios")
    sums = ratios.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()["k"]
    hot = F.col("k") > F.lit(sums / HEAVY)
    near = each.join(F.broadcast(ratios.where(hot).select("t", "ratio")), "t", "left")
    first = near.groupBy("_row").agg(F.coalesce(F.sum("ratio"), F.lit(0.0)).alias("ratio"), F.count(F.lit(1)).alias("n"))
    rest = near.where("ratio IS NULL").select("_row", "t").join(ratios.where(~hot).select("t", "ratio"), "t").groupBy("_row").agg(F.sum("ratio").alias("ratio"), F.lit(0).cast("long").alias("n"))
    both = {r["_fixed"] for r in rows.where("_fixed IS NOT NULL").select("_fixed").distinct().collect()} == {"allow", "block"}
    mean = F.round(F.sum("ratio") / F.sum("n"), 9) if both else F.lit(0.0)
    of_row = first.unionByName(rest).groupBy("_row").agg(mean.alias("score"))
    scored = cut(rows.drop("_chars").join(of_row, "_row"), "url-scores")
    # balanced accuracy of every threshold on a grid, as running sums over at most 2 * 12 / step bins
    bins = scored.where("_fixed IS NOT NULL").groupBy(F.floor(F.greatest(F.lit(-12.0), F.least(F.lit(12.0), "score")) / step).alias("bin")).agg(
        F.count_if(F.col("_fixed") == "allow").alias("good"), F.count_if(F.col("_fixed") == "block").alias("bad")
    )
    running = bins.selectExpr(
        "bin", "coalesce(sum(good) OVER (ORDER BY bin DESC), 0) / greatest(1, sum(good) OVER ()) + 1 - sum(bad) OVER (ORDER BY bin DESC) / greatest(1, sum(bad) OVER ()) AS gain"
    )
    best = running.agg(F.max_by("bin", F.struct("gain", "bin")).alias("bin")).first()["bin"]
    by_method = F.when(F.col("score") >= (best * step if both else 0.0), "allow").otherwise("block")
    for table in (rows, counts, ratios):
        drop(table)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_fixed", by_method).alias("verdict"), F.round("score", 6).alias("score"))


def oracle(rules=RULES, step: float = 0.02) -> str:
    """The same rules and models in SQL of another engine."""
    after = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
    lower = lambda c: f"translate({c}, '{UPPER}', '{LOWER}')"
    fits = [(f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')", h + p, v) for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))]
    case = lambda k: "CASE " + " ".join(f"WHEN {f[0]} THEN '{f[k]}'" for f in fits) + " END"
    models = ""
    for k in range(1, ORDER + 1):
        own, context, sides = f"substr(x.t, {ORDER + 1 - k}, {k})", f"substr(x.t, {ORDER + 1 - k}, {k - 1})", ("allow", "block")
        grams = ", ".join(f"sum(n_{s}) AS n_{s}" for s in sides)
        around = ", ".join(f"sum(n_{s}) AS all_{s}, count(*) FILTER (n_{s} > 0) AS kinds_{s}" for s in sides)
        p = ", ".join(f"CASE WHEN all_{s} > 0 THEN (n_{s} + kinds_{s} * p_{s}) / (all_{s} + kinds_{s}) ELSE p_{s} END AS p_{s}" for s in sides)
        models += f"""
g{k} AS (SELECT {own} AS own, {grams} FROM counts x GROUP BY 1),
a{k} AS (SELECT substr(own, 1, {k - 1}) AS context, {around} FROM g{k} GROUP BY 1),
p{k} AS (SELECT x.t, {p} FROM p{k - 1} x JOIN g{k} g ON g.own = {own} JOIN a{k} a ON a.context = {context}),"""
    return f"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, coalesce({after}, '') AS after FROM pages),
h AS (SELECT *, {lower("regexp_extract(after, '^([^/?#]*)', 1)")} AS host, regexp_extract(substr(after, len(regexp_extract(after, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM u),
j AS (SELECT *, {case(1)} AS rule, {case(2)} AS fixed, concat(repeat(chr({ord(BEGIN)}), {ORDER - 1}), {lower('after')}, chr({ord(END)})) AS s FROM h),
e AS (SELECT r, fixed, unnest(list_transform(range(1, len(s) - {ORDER - 2}), lambda i: substr(s, i, {ORDER}))) AS t FROM j),
counts AS (SELECT t, (count(*) FILTER (fixed = 'allow'))::DOUBLE AS n_allow, (count(*) FILTER (fixed = 'block'))::DOUBLE AS n_block FROM e GROUP BY t),
p0 AS (SELECT t, {UNSEEN!r}::DOUBLE AS p_allow, {UNSEEN!r}::DOUBLE AS p_block FROM counts),{models}
ratio AS (SELECT t, ln(p_allow) - ln(p_block) AS ratio FROM p{ORDER}),
sc AS (SELECT r, CASE WHEN (SELECT count(DISTINCT fixed) FROM j) = 2 THEN round(avg(ratio), 9) ELSE 0.0 END AS score FROM e JOIN ratio USING (t) GROUP BY r),
bins AS (SELECT CAST(floor(greatest(-12.0, least(12.0, score)) / {step}) AS BIGINT) AS bin, count(*) FILTER (fixed = 'allow') AS good, count(*) FILTER (fixed = 'block') AS bad FROM sc JOIN j USING (r) WHERE fixed IS NOT NULL GROUP BY 1),
gain AS (SELECT bin, sum(good) OVER (ORDER BY bin DESC) / greatest(1, sum(good) OVER ()) + 1 - sum(bad) OVER (ORDER BY bin DESC) / greatest(1, sum(bad) OVER ()) AS gain FROM bins),
best AS (SELECT CASE WHEN (SELECT count(DISTINCT fixed) FROM j) = 2 THEN (SELECT bin FROM gain ORDER BY gain DESC, bin DESC LIMIT 1) * {step} ELSE 0.0 END AS threshold)
SELECT page_id, host, path, rule, coalesce(fixed, CASE WHEN score >= (SELECT threshold FROM best) THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score FROM j JOIN sc USING (r)
"""
