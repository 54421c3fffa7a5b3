"""URL filters: rules by host and path, and for the rest a ratio of two character language models.

Method: variable-order Markov models (orders 0 to ORDER, Witten-Bell smoothing by interpolation) of accepted and of
rejected URLs. A URL's score is the difference of their log likelihoods over its characters, divided by its length;
it is accepted from the threshold on that makes fewest errors on URLs held out from both models.

The models learn from all distinct URLs that the rules decide, a fifth of them by hash held out; where a verdict has
fewer than FEW, all are in both parts. Windows of ORDER + 1 characters are counted as a table, from which all orders
follow, and joined with the windows of the URLs to be scored; so nothing is left out and nothing of a size that grows
reaches the driver. The threshold is calibrated on all held-out URLs, to GRAIN. Copies of a URL change nothing.
Without URLs of both verdicts there are no models, and what no rule decides is allowed. A null URL, or one without
://, has an empty host and path; a null or empty one scores 0. URLs are read whole, whatever their length; other columns are left
out, whatever their names. Markov and Ratio are the same models of short lists.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rivulet.llm.common import materialise

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
ORDER, FEW, GRAIN = 4, 50, 1e-4
#: So many windows of ORDER + 1 characters are remembered with their log ratio in a list's Ratio.
REMEMBER = 200_000
#: So many of the most frequent windows meet the URLs by broadcast; any other has a smaller share of all windows than one in so many.
OFTEN = 1024
_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _AZ, _AZ.lower())


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path, and its verdict; null if none fits."""
    rule = verdict = None
    for kind, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return rule, verdict


class Markov:
    def __init__(self, urls: list[str]):
        self.counts: Counter = Counter()
        for u in urls:
            u = "\x02" * ORDER + u
            for i in range(ORDER, len(u)):
                for k in range(ORDER + 1):
                    self.counts[u[i - k : i + 1]] += 1
        self.total: Counter = Counter()
        self.kinds: Counter = Counter()
        for gram, n in self.counts.items():
            self.total[gram[:-1]] += n
            self.kinds[gram[:-1]] += 1

    def p(self, window: str) -> float:
        """Of the window's last character after those before it."""
        out = 1 / 1024  # for a character never seen
        for k in range(len(window)):
            context = window[len(window) - 1 - k : -1]
            if kinds := self.kinds.get(context):
                out = (self.counts.get(window[len(window) - 1 - k :], 0) + kinds * out) / (self.total[context] + kinds)
        return out


class Ratio:
    """Models of accepted and rejected URLs, and the threshold calibrated on others."""

    def __init__(self, accepted: list[str], rejected: list[str]):
        self.seen: dict[str, float] = {}
        self.models, self.threshold = None, 0.0
        if accepted and rejected:
            fit, held = zip(*[([u for i, u in enumerate(us) if i % 5 or len(us) < 5], [u for i, u in enumerate(us) if not i % 5]) for us in (accepted, rejected)])
            self.models = Markov(fit[0]), Markov(fit[1])
            scored = sorted([(self.score(u), 1) for u in held[0]] + [(self.score(u), 0) for u in held[1]])
            wrong = best = len(held[1])  # with all accepted; rejecting the lowest ones changes the count
            self.threshold = scored[0][0]
            for (s, y), (after, _) in zip(scored, scored[1:]):
                wrong += 1 if y else -1
                if wrong < best and after > s:
                    best, self.threshold = wrong, (s + after) / 2

    def score(self, url: str | None) -> float:
        if not url or self.models is None:
            return 0.0
        text, total, seen = "\x02" * ORDER + url, 0.0, self.seen
        for i in range(len(url)):
            window = text[i : i + ORDER + 1]
            if (x := seen.get(window)) is None:
                x = math.log(self.models[0].p(window) / self.models[1].p(window))
                if len(seen) >= REMEMBER:
                    seen.clear()
                seen[window] = x
            total += x
        return total / len(url)

    def accepts(self, url: str | None) -> bool:
        return self.models is None or self.score(url) >= self.threshold


@dataclass
class Tables:
    """Counts of the windows' ends (gram, n0 of accepted and n1 of rejected URLs) and of their contexts (context,
    totals t0, t1 and kinds of last characters k0, k1), and the threshold; no tables without URLs of both verdicts."""

    grams: DataFrame | None = None
    contexts: DataFrame | None = None
    threshold: float = 0.0

    def scores(self, urls: DataFrame) -> DataFrame:
        """u and score of the distinct, non-empty URLs of column u."""
        rows = _windows(urls)
        counted = materialise(rows.groupBy("w").agg(F.count("*").alias("n")))
        asked = counted.select("w")
        p = [F.lit(1 / 1024), F.lit(1 / 1024)]  # for a character never seen
        for k in range(ORDER + 1):
            grams = self.grams.filter(F.char_length("gram") == k + 1).select(F.col("gram").alias(f"g{k}"), *[F.col(f"n{v}").alias(f"n{v}_{k}") for v in (0, 1)])
            contexts = self.contexts.filter(F.char_length("context") == k).select(F.col("context").alias(f"c{k}"), *[F.col(f"{x}{v}").alias(f"{x}{v}_{k}") for x in "tk" for v in (0, 1)])
            asked = asked.withColumns({f"g{k}": _end("w", k + 1), f"c{k}": F.substring("w", ORDER + 1 - k, k)})
            if k == 0:  # a row for each character at most, as have the contexts of one; one row for the empty context
                grams = F.broadcast(grams)
            if k <= 1:
                contexts = F.broadcast(contexts)
            asked = asked.join(grams, f"g{k}", "left").join(contexts, f"c{k}", "left").drop(f"g{k}", f"c{k}")
            for v in (0, 1):
                n, t, kinds = (F.coalesce(f"{x}{v}_{k}", F.lit(0)) for x in "ntk")
                p[v] = F.when(kinds > 0, (n + kinds * p[v]) / (t + kinds)).otherwise(p[v])
            asked = asked.select("w", *[p[v].alias(f"p{v}") for v in (0, 1)])
            p = [F.col("p0"), F.col("p1")]
        ratios = materialise(asked.select("w", F.log(p[0] / p[1]).alias("x")))
        # Windows that are in most URLs, as those of their beginnings are, meet their ratio where the URLs lie.
        often = F.broadcast(counted.orderBy(F.desc("n"), "w").limit(OFTEN).select("w"))
        near = rows.join(F.broadcast(ratios.join(often, "w", "left_semi")), "w")
        rest = rows.join(often, "w", "left_anti").join(ratios, "w")
        summed = near.unionByName(rest).groupBy("u").agg(F.sum("x").alias("x"))
        return summed.select("u", F.round(F.col("x") / F.char_length("u"), 10).alias("score"))  # sums come in any order


def _windows(urls: DataFrame) -> DataFrame:
    """urls and w, the ORDER + 1 characters that end at each character."""
    padded = F.concat(F.lit("\x02" * ORDER), F.col("u"))
    every = F.transform(F.sequence(F.lit(1), F.char_length("u")), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))
    return urls.filter("u != ''").select("*", F.explode(every).alias("w"))


def _end(gram: str, n: int) -> Column:
    return F.substring(gram, -n, n)


def learn(df: DataFrame, url: str = "url", rules=RULES) -> Tables:
    """The models of df's URLs as its rules judge them."""
    _, verdict = matched(host(F.col(url)), path(F.col(url)), rules)
    judged = df.select(F.col(url).alias("u"), (verdict == "block").cast("int").alias("v")).filter("v is not null")
    urls = materialise(judged.groupBy("u", "v").agg(F.lit(1).alias("_")).select("u", "v"))
    size = {r["v"]: r["n"] for r in urls.groupBy("v").agg(F.count("*").alias("n")).collect()}
    if len(size) < 2:
        return Tables()
    few = F.col("v").isin([v for v, n in size.items() if n < FEW])
    fifth = F.pmod(F.xxhash64("u"), F.lit(5)) == 0
    counted = _windows(urls.filter(few | ~fifth)).groupBy("w").agg(*[F.count(F.when(F.col("v") == v, 1)).alias(f"n{v}") for v in (0, 1)])
    both = [F.sum(f"n{v}").alias(f"n{v}") for v in (0, 1)]
    ends = materialise(counted).select(F.explode(F.array(*[_end("w", k + 1) for k in range(ORDER + 1)])).alias("gram"), "n0", "n1")
    grams = materialise(ends.groupBy("gram").agg(*both))
    context = F.expr("substring(gram, 1, char_length(gram) - 1)")
    contexts = materialise(grams.groupBy(context.alias("context")).agg(*[F.sum(f"n{v}").alias(f"t{v}") for v in (0, 1)], *[F.count(F.when(F.col(f"n{v}") > 0, 1)).alias(f"k{v}") for v in (0, 1)]))
    out = Tables(grams, contexts)
    held = urls.filter(few | fifth)
    grains = out.scores(held).join(held, "u").groupBy(F.round(F.col("score") / GRAIN).alias("g")).agg(*[F.count(F.when(F.col("v") == v, 1)).alias(f"n{v}") for v in (0, 1)]).collect()
    grains = sorted((r["g"], r["n0"], r["n1"]) for r in grains)  # as many as there are grains between the extremes
    wrong = best = sum(g[2] for g in grains)  # with all accepted; rejecting the lowest ones changes the count
    if grains:
        out.threshold = (grains[0][0] - 0.5) * GRAIN
    for (g, accepted, rejected), (after, *_) in zip(grains, grains[1:]):
        wrong += accepted - rejected
        if wrong < best:
            best, out.threshold = wrong, (g + after) / 2 * GRAIN
    return out


def judge(df: DataFrame, keep: list[str], tables: Tables, url: str = "url", rules=RULES) -> DataFrame:
    """keep, host, path, rule, verdict, and score (null where a rule decides)."""
    u = F.col(url)
    rule, verdict = matched(host(u), path(u), rules)
    seen = df.select(*keep, u.alias("__url"), host(u).alias("__host"), path(u).alias("__path"), rule.alias("__rule"), verdict.alias("__verdict"))
    score = F.lit(0.0)
    if tables.grams is not None:
        asked = seen.filter("__verdict is null and __url != ''").groupBy(F.col("__url").alias("u")).agg(F.lit(1).alias("_")).select("u")
        scores = tables.scores(asked).toDF("__u", "__score")
        seen = seen.join(scores, F.col("__url") == F.col("__u"), "left")
        score = F.coalesce("__score", F.lit(0.0))
    allowed = F.lit(True) if tables.grams is None else score >= tables.threshold
    found = F.coalesce("__verdict", F.when(allowed, "allow").otherwise("block"))
    return seen.select(*keep, F.col("__host").alias("host"), F.col("__path").alias("path"), F.col("__rule").alias("rule"), found.alias("verdict"), F.when(F.col("__verdict").isNull(), score).alias("score"))
