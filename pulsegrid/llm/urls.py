"""URL filters: listed rules, then per-host path-template trees judged by smoothed labelled purity.

Each host's paths form a tree of segments. Level by level, the children of a node that are too many and too
rare to be names are generalised into typed wildcards ({num}, {hex}, {str}); the literal children that have
enough labels and whose share of bad labels does not differ significantly from that of all the node's
labels merge into one branch. A branch's purity is its share of bad labels, smoothed towards its parent's
purity, and a host's towards the share of all labels (``PRIOR`` at most), so that a branch without labels
has its parent's. A template is rejected if its purity reaches ``REJECT``. A node with a single path is a
leaf, so levels end with the last node that branches, however deep paths go. Counts are pre-aggregated per
host and path.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.scratch import Scratch

#: A node with more distinct children than this, and than the root of its URLs, has variable children.
CHILDREN = 8
#: A child with this share of its node's URLs (and 20 of them) is a name even so.
SHARE = 0.05
MERGE_LABELS, MERGE_Z = 5, 1.96
SMOOTHING, REJECT, PRIOR = 2.0, 0.8, 0.5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule (host, path, verdict) that fits, else null."""
    ranked = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [((host == r[0]) | host.endswith("." + r[0])) & path.startswith(r[1]) for r in ranked]
    pick = lambda values: reduce(lambda rest, x: F.when(x[0], F.lit(x[1])).otherwise(rest), list(zip(fits, values, strict=True))[::-1], F.lit(None).cast("string"))
    return pick([h + p for h, p, _ in ranked]), pick([v for _, _, v in ranked])


def _wildcard(segment: Column) -> Column:
    ending = F.regexp_extract(segment, r"(\.[A-Za-z]{2,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{2,5}$", "")
    kind = F.when(segment == "", "").when(stem.rlike(r"^\d+$"), "{num}").when(stem.rlike(r"^[0-9a-fA-F-]{8,}$"), "{hex}").otherwise("{str}")
    return F.concat(kind, F.when(segment == "", "").otherwise(ending))


def _purity(bad: Column, labels: Column, above: Column, labels_above: Column) -> Column:
    """Smoothed share; a branch with all of its parent's labels, or none, tells nothing that the parent's did not."""
    return F.when((labels == 0) | (labels == labels_above), above).otherwise((bad + SMOOTHING * above) / (labels + SMOOTHING))


def templates(paths: DataFrame, scratch: Scratch) -> DataFrame:
    """Paths (host, path, n, bad, good) with the template that each path follows on its host, and its purity."""
    totals = paths.agg(F.sum("bad"), F.sum(F.col("bad") + F.col("good"))).collect()[0]
    prior = F.lit(min(PRIOR, (totals[0] or 0) / totals[1]) if totals[1] else 0.0)
    host = paths.groupBy("host").agg(F.sum("bad").alias("b"), F.sum(F.col("bad") + F.col("good")).alias("labels"), F.count("*").alias("paths"))
    host = scratch.put(host.select("host", "labels", "paths", _purity(F.col("b"), F.col("labels"), prior, F.lit(-1)).alias("purity")), "hosts")
    # rest: segments below the node that the row has come to; purity, labels and paths are that node's.
    rows = paths.select("host", "path", "n", "bad", "good", F.split(F.expr("substring(path, 2)"), "/").alias("rest"), F.lit("").alias("template")).join(host, "host")
    rows, done = scratch.put(rows, "level"), None
    ended = (F.size("rest") == 0) | (F.col("paths") == 1)
    while True:
        leaf = F.when(F.size("rest") > 0, F.concat("template", F.lit("/"), F.array_join("rest", "/"))).otherwise(F.col("template"))
        over = rows.where(ended).select("host", "path", leaf.alias("template"), "purity")
        done = over if done is None else done.unionByName(over)
        live = rows.where(~ended).withColumn("seg", F.col("rest")[0])
        if live.isEmpty():
            return done
        inside = ["host", "template"]
        child = scratch.put(live.groupBy(*inside, "seg").agg(F.sum("n").alias("cn"), F.sum("bad").alias("cb"), F.sum("good").alias("cg"), F.count("*").alias("cp")), "child")
        node = scratch.put(child.groupBy(*inside).agg(F.count("*").alias("k"), F.sum("cn").alias("nn"), F.sum("cb").alias("nb"), F.sum("cg").alias("ng")), "node")
        named = (F.col("k") <= F.greatest(F.lit(CHILDREN), F.sqrt("nn"))) | ((F.col("cn") >= 20) & (F.col("cn") >= SHARE * F.col("nn")))
        labels, share = F.col("cb") + F.col("cg"), F.col("nb") / F.nullif(F.col("nb") + F.col("ng"), F.lit(0))
        gap = F.abs(F.col("cb") / F.nullif(labels, F.lit(0)) - share)
        alike = (labels >= MERGE_LABELS) & (labels < F.col("nb") + F.col("ng")) & (gap <= MERGE_Z * F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) / labels))
        part = F.when(~named, _wildcard(F.col("seg"))).when(alike, F.lit("{alike}")).otherwise(F.col("seg"))
        step = scratch.put(child.join(node, inside).select(*inside, "seg", part.alias("part"), "cb", "cg", "cp"), "step")
        branch = step.groupBy(*inside, "part").agg(F.sum("cb").alias("b"), F.sum(F.col("cb") + F.col("cg")).alias("l"), F.sum("cp").alias("p"))
        step = scratch.put(step.select(*inside, "seg", "part").join(branch, [*inside, "part"]), "branch")
        joined = live.join(step, [*inside, "seg"])
        rows = scratch.put(
            joined.select(
                "host", "path", "n", "bad", "good", F.slice("rest", F.lit(2), F.size("rest")).alias("rest"), F.concat("template", F.lit("/"), "part").alias("template"),
                F.col("l").alias("labels"), F.col("p").alias("paths"), _purity(F.col("b"), F.col("l"), F.col("purity"), F.col("labels")).alias("purity"),
            ),
            "level",
        )


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", labels: DataFrame | None = None, label_key: str | None = None, bad: Column | None = None) -> DataFrame:
    """Verdict on each URL: that of the longest fitting rule, else that of its path template.

    Labels are the rules' verdicts on the URLs they fit, or, given ``labels``, whether ``bad`` holds for the
    row with the page's key. A URL without ``://``, or null, has an empty host and path and is judged by the
    template of those. Rows that repeat a key are judged one by one. Other columns are not read. Returns
    key, host, path, rule, verdict, template, purity (smoothed share of bad labels).
    """
    scratch = Scratch(pages.sparkSession, "urls")
    rows = pages.select(F.col(key).alias("key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), said.alias("said"))
    if labels is None:
        marked = rows.select("*", (F.col("said") == "block").cast("long").alias("bad"))
    else:
        marks = labels.groupBy(F.col(label_key).alias("key")).agg(F.max(bad.cast("long")).alias("bad"))
        marked = rows.join(marks, "key", "left")
    rows = scratch.put(marked, "rows")
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), (F.count("bad") - F.coalesce(F.sum("bad"), F.lit(0))).alias("good"))
    by_path = scratch.put(templates(scratch.put(paths, "paths"), scratch), "by_path")
    out = rows.join(by_path, ["host", "path"]).select(
        F.col("key").alias(key), "host", "path", "rule", F.coalesce("said", F.when(F.col("purity") >= REJECT, "block").otherwise("allow")).alias("verdict"), "template", "purity"
    )
    result = scratch.put(out, "result")
    scratch.close("result")
    return result
