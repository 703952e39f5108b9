"""URL rules, and a character language-model ratio for the URLs that no rule judges; DataFrame functions only."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.llm.shared import keep

#: Characters that the models tell apart; letters are lower-cased, digits are one class, all others (and the ends) are class 0.
ALPHABET = string.ascii_lowercase + "0-._~:/?#=&%+@"
CLASSES = len(ALPHABET) + 1
#: Mean scores are calibrated in steps of 1/100, between these bounds.
STEPS, FARTHEST = 100, 2000


@dataclass(frozen=True)
class Rule:
    action: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


#: The rules of the registered query.
RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The text of the longest rule that fits, else null."""
    fits = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.text)) for r in sorted(rules, key=lambda r: (-len(r.text), r.text))]
    return F.coalesce(*fits, F.lit(None).cast("string"))


def trigram_codes(url: Column) -> Column:
    """A code under CLASSES ** 3 for each character with the two before it, and for the end."""
    plain = F.translate(F.lower(F.coalesce(url, F.lit(""))), "123456789", "000000000")
    codes = F.transform(F.filter(F.split(plain, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))
    padded, n = F.concat(F.array(F.lit(0), F.lit(0)), codes, F.array(F.lit(0))), F.length(plain) + 1
    two = F.zip_with(F.slice(padded, F.lit(1), n), F.slice(padded, F.lit(2), n), lambda a, b: a * CLASSES**2 + b * CLASSES)
    return F.zip_with(two, F.slice(padded, F.lit(3), n), lambda x, c: x + c)


def _share(count: str, total: str, kinds: str, lower: str) -> Column:
    """Witten-Bell: a context gives the shorter one as much weight as it has followers of its own."""
    n, t, p = F.coalesce(F.col(total), F.lit(0)), F.coalesce(F.col(kinds), F.lit(0)), F.col(lower)
    return F.when(n > 0, (F.coalesce(F.col(count), F.lit(0)) + t * p) / (n + t)).otherwise(p)


def log_ratios(labelled: DataFrame) -> DataFrame:
    """(code, ratio) for every trigram code: log p(accepted) - log p(rejected).

    ``labelled`` has codes (array) and accepted (boolean). The table has
    CLASSES ** 3 entries whatever the input, which bounds what is broadcast.
    """
    seen = labelled.select("accepted", F.explode("codes").alias("code")).groupBy("code").agg(F.count_if("accepted").alias("n_a"), F.count_if(~F.col("accepted")).alias("n_r"))
    dense = labelled.sparkSession.range(CLASSES**3).withColumnRenamed("id", "code").join(seen, "code", "left")
    by_two, by_one = (F.col("code") / CLASSES).cast("int"), (F.col("code") % CLASSES**2).cast("int")
    dense = dense.select("code", by_two.alias("two"), by_one.alias("pair"), (by_one / CLASSES).cast("int").alias("one"), (F.col("code") % CLASSES).cast("int").alias("last"), *(F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in "ar"))
    for k in "ar":
        n = f"n_{k}"
        two = Window.partitionBy("two")
        dense = dense.withColumns({f"n2_{k}": F.sum(n).over(two), f"t2_{k}": F.count_if(F.col(n) > 0).over(two)})
    pairs = dense.groupBy("one", "pair", "last").agg(*(F.sum(f"n_{k}").alias(f"c2_{k}") for k in "ar"))
    lasts = pairs.groupBy("last").agg(*(F.sum(f"c2_{k}").alias(f"c1_{k}") for k in "ar"))
    every = lasts.agg(*(f(k) for k in "ar" for f in (lambda k: F.sum(f"c1_{k}").alias(f"n0_{k}"), lambda k: F.count_if(F.col(f"c1_{k}") > 0).alias(f"t0_{k}"))))
    lasts = lasts.join(F.broadcast(every)).withColumn("flat", F.lit(1.0 / CLASSES))
    lasts = lasts.select("last", *(_share(f"c1_{k}", f"n0_{k}", f"t0_{k}", "flat").alias(f"p0_{k}") for k in "ar"))
    one = Window.partitionBy("one")
    pairs = pairs.withColumns({f"{a}1_{k}": f.over(one) for k in "ar" for a, f in (("n", F.sum(f"c2_{k}")), ("t", F.count_if(F.col(f"c2_{k}") > 0)))}).join(F.broadcast(lasts), "last")
    pairs = pairs.select("pair", *(_share(f"c2_{k}", f"n1_{k}", f"t1_{k}", f"p0_{k}").alias(f"p1_{k}") for k in "ar"))
    return dense.join(F.broadcast(pairs), "pair").select("code", (F.log(_share("n_a", "n2_a", "t2_a", "p1_a")) - F.log(_share("n_r", "n2_r", "t2_r", "p1_r"))).alias("ratio"))


def mean_ratios(rows: DataFrame, ratios: DataFrame) -> DataFrame:
    """The other columns of ``rows`` with the mean log ratio of their codes as score; the sums begin where the rows are read."""
    others = [c for c in rows.columns if c != "codes"]
    each = rows.withColumn("row", F.monotonically_increasing_id()).select("row", *others, F.explode("codes").alias("code"))
    return each.join(F.broadcast(ratios), "code").groupBy("row", *others).agg((F.sum("ratio") / F.count("*")).alias("score")).drop("row")


def _steps(score: Column) -> Column:
    return F.greatest(F.lit(-FARTHEST), F.least(F.lit(FARTHEST), F.floor(score * STEPS))).cast("int")


def threshold(scored: DataFrame) -> DataFrame:
    """One row, one number: the step from which URLs are accepted, the one that tells apart most of accepted and of rejected in their shares.

    Ties go to the step nearest to 0, the lower of two; without labelled rows of both kinds it is 0.
    """
    counted = scored.groupBy(_steps(F.col("score")).alias("step")).agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    every = Window.partitionBy()
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    gains = counted.select("step", (F.sum("a").over(every) - F.coalesce(F.sum("a").over(upto), F.lit(0))).alias("a_on"), F.coalesce(F.sum("r").over(upto), F.lit(0)).alias("r_off"), F.sum("a").over(every).alias("all_a"), F.sum("r").over(every).alias("all_r"))
    gains = gains.where("all_a > 0 and all_r > 0").select("step", (F.col("a_on") * F.col("all_r") + F.col("r_off") * F.col("all_a")).alias("gain"))
    return gains.agg(F.coalesce(F.min(F.struct(-F.col("gain"), F.abs("step"), "step"))["step"], F.lit(0)).alias("step"))


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score for each row of ``pages``.

    The longest rule that fits decides. The URLs it allows and blocks, all of
    them but three in sixteen (by the MD5 of their text) that calibrate the
    threshold, also train two character models of variable order, whose mean log-likelihood
    difference judges the URLs without a rule: allow at the threshold or above.

    A null url is scored as an empty one; without labelled URLs of both kinds
    all others are allowed; repeated rows are each returned; other columns are
    ignored; no rows give no rows.
    """
    url = F.col(url_col).cast("string")
    host, path = host_and_path(url)
    parts = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    parts = parts.withColumn("rule", matched_rule(F.col("host"), F.col("path"), rules))
    allowed = [r.text for r in rules if r.action == "allow"]
    accepted = F.col("rule").isin(allowed) if allowed else F.lit(False)
    labelled = parts.where("rule is not null").select("url", accepted.alias("accepted"), trigram_codes(F.col("url")).alias("codes"), (F.md5("url") < "3").alias("calibrates"))
    ratios = keep(log_ratios(labelled.where("not calibrates")), "ratios")
    step = threshold(mean_ratios(labelled.where("calibrates").select("accepted", "codes"), ratios))
    rest = mean_ratios(parts.where("rule is null").select("page_id", "host", "path", "rule", trigram_codes(F.col("url")).alias("codes")), ratios)
    rest = rest.join(F.broadcast(step)).select("page_id", "host", "path", "rule", F.when(_steps(F.col("score")) >= F.col("step"), "allow").otherwise("block").alias("verdict"), "score")
    ruled = parts.where("rule is not null").select("page_id", "host", "path", "rule", F.when(accepted, "allow").otherwise("block").alias("verdict"), F.lit(None).cast("double").alias("score"))
    return ruled.union(rest)
