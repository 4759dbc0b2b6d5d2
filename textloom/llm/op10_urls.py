"""URL filtering with a tree of path templates per host.

Paths are counted by shape (digits as `*`), so a host's tree is built from aggregates. Branching by
branching, segments that are many and rare become `*`, and siblings merge that are statistically
similar: their children are alike in kind, and their labelled shares do not differ significantly. A
template's purity is its labelled share of blocked URLs, smoothed towards a prior: that of the
template above it, and the labels that URLs of the same shape have on other hosts. Templates of high
purity are rejected.
"""

from __future__ import annotations

from math import sqrt

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, read

#: The rules of the query as (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
RARE = 0.05  # a segment among more than 1 / RARE siblings needs this share to stay
ALIKE = 0.25  # total variation up to which two branches' children are alike in kind
SMOOTHING = 4.0  # labels that what stands above a template counts for
ELSEWHERE = 12.0  # labels of the same shape on other hosts count for so many at most
REJECT = 0.7
KINDS = ("end", "number", "file", "mixed", "word")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Empty strings for a null url and one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> Column:
    """struct(verdict, rule) of the longest rule that fits, or null; the earlier one of equally long."""
    ranked = sorted(enumerate(rules), key=lambda x: (-len(x[1][1] + x[1][2]), x[0]))
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for _, (verdict, h, p) in reversed(ranked):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def _kind(segment: Column) -> Column:
    return F.when(segment == "", "end").when(segment == "*", "number").when(segment.rlike(r"^\*\.[^*]*$"), "file").when(segment.contains("*"), "mixed").otherwise("word")


def segments(shape: Column) -> Column:
    """The segments that are not empty; a run of equal ones is one, marked by a plus sign."""
    every = F.filter(F.split(shape, "/"), lambda x: x != "")

    def runs(xs: Column) -> Column:
        before = lambda i: F.coalesce(F.get(xs, i - 1), F.lit(""))
        after = lambda i: F.coalesce(F.get(xs, i + 1), F.lit(""))
        marked = F.transform(xs, lambda x, i: F.when(x == before(i), F.lit("")).when(x == after(i), F.concat(x, F.lit("+"))).otherwise(x))
        return F.filter(marked, lambda x: x != "")

    return F.flatten(F.transform(F.array(every), runs))


def _rate(b: dict) -> float:
    return b["bad"] / b["seen"]


def likeness(a: dict, b: dict) -> float | None:
    """How far two sibling branches are apart, or None if they are not alike."""
    if (a["kind"] == "word") != (b["kind"] == "word"):
        return None
    far = sum(abs(x / a["n"] - y / b["n"]) for x, y in zip(a["kinds"], b["kinds"], strict=True)) / 2
    if far > ALIKE + sqrt(1 / a["n"] + 1 / b["n"]) / 2 or (a["seen"] > 0) != (b["seen"] > 0):
        return None
    if not a["seen"]:
        return far
    rate, gap = (a["bad"] + b["bad"]) / (a["seen"] + b["seen"]), abs(_rate(a) - _rate(b))
    return far + gap if gap <= 1.96 * sqrt(rate * (1 - rate) * (1 / a["seen"] + 1 / b["seen"])) + 1e-9 else None


def merged(branches: list[dict]) -> list[list[dict]]:
    """Groups of siblings: the two most alike are merged and counted together until no two are alike.

    A branch has label, kind, n, kinds (the counts of its children by kind), and seen and bad, its
    labels with those of its shapes elsewhere. There are 1 / RARE + 2 siblings at most.
    """
    groups = [(dict(b), [b]) for b in sorted(branches, key=lambda b: b["label"])]
    while True:
        near = [(x, i, k) for k in range(len(groups)) for i in range(k) if (x := likeness(groups[i][0], groups[k][0])) is not None]
        if not near:
            return [members for _, members in groups]
        _, i, k = min(near)
        (a, mine), (b, theirs) = groups[i], groups.pop(k)
        a |= {c: a[c] + b[c] for c in ("n", "seen", "bad")} | {"kinds": [x + y for x, y in zip(a["kinds"], b["kinds"], strict=True)]}
        groups[i] = (a, mine + theirs)


def names(groups: list[list[dict]]) -> list[str]:
    """A group of several is a wildcard if it is all or holds one, else it is spelled out."""
    out = []
    for group in groups:
        labels = sorted(b["label"] for b in group)
        wild = len(labels) > 1 and (len(groups) == 1 or "*" in labels)
        out.append("*" if wild else labels[0] if len(labels) == 1 else "{" + ",".join(labels) + "}")
    return out


def decided(branches: list[dict], above: float) -> list[tuple[str, str, float]]:
    """(label, name, purity) of sibling branches under a template of purity `above`.

    A branch has also own_seen and own_bad, the host's labels, and far_seen and far_bad, those
    elsewhere. What stands above and the same shapes elsewhere make the prior of the host's own.
    """
    out = []
    groups = [[b] for b in branches if b["label"] == ""] + merged([b for b in branches if b["label"] != ""])
    spelled = names([g for g in groups if g[0]["label"] != ""])
    for group, name in zip(groups, [""] * (len(groups) - len(spelled)) + spelled, strict=True):
        n = sum(b["n"] for b in group)
        far_seen, far_bad = (sum(b["n"] * b[c] for b in group) / n for c in ("far_seen", "far_bad"))
        prior = (far_bad + SMOOTHING * above) / (far_seen + SMOOTHING)
        purity = (sum(b["own_bad"] for b in group) + SMOOTHING * prior) / (sum(b["own_seen"] for b in group) + SMOOTHING)
        out += [(b["label"], name, purity) for b in group]
    return out


def _decide(branches: DataFrame) -> DataFrame:
    """host, prefix, above, branches (all siblings, a bounded number) -> host, prefix, label, name, purity."""

    def run(batches):
        for pdf in batches:
            out = []
            for host, prefix, above, siblings in zip(pdf["host"], pdf["prefix"], pdf["above"], pdf["branches"], strict=True):
                each = [{c: r[c] for c in ("label", "kind", "n", "own_seen", "own_bad", "far_seen", "far_bad")} | {"kinds": [int(r[k]) for k in KINDS]} for r in siblings]
                for b in each:
                    b["seen"], b["bad"] = b["own_seen"] + b["far_seen"], b["own_bad"] + b["far_bad"]
                out += [(host, prefix, *x) for x in decided(each, above)]
            yield pd.DataFrame(out, columns=["host", "prefix", "label", "name", "purity"])

    return branches.mapInPandas(run, "host string, prefix string, label string, name string, purity double")


def templates(shapes: DataFrame, scratch: Scratch) -> DataFrame:
    """host, shape, n, seen, bad -> host, shape, template, purity.

    Each round follows what all paths under a prefix have in common and decides on the branches
    behind it. A prefix whose paths are all alike is done, so rounds are as many as a path has
    branchings.
    """
    totals = shapes.groupBy("shape").agg(F.sum("seen").alias("all_seen"), F.sum("bad").alias("all_bad"))
    totals = scratch.write(totals, "totals")
    base = totals.agg(F.try_divide(F.sum("all_bad"), F.sum("all_seen"))).first()[0] or 0.0
    others = F.col("all_seen") - F.col("seen")
    weight = F.least(F.lit(1.0), F.lit(ELSEWHERE) / others)
    far = [F.when(others > 0, weight * x).otherwise(0.0).alias(c) for c, x in (("far_seen", others), ("far_bad", F.col("all_bad") - F.col("bad")))]
    state = shapes.join(totals, "shape").select("host", "shape", "n", "seen", "bad", *far, segments(F.col("shape")).alias("rest"), F.lit("").alias("prefix"))
    state = scratch.write(state, "state")
    mean = lambda c: F.sum(F.col("n") * F.col(c)) / F.sum("n")
    prior = (mean("far_bad") + SMOOTHING * base) / (mean("far_seen") + SMOOTHING)
    roots = state.groupBy("host").agg(((F.sum("bad") + SMOOTHING * prior) / (F.sum("seen") + SMOOTHING)).alias("purity"))
    state = scratch.write(state.join(scratch.write(roots, "roots"), "host"), "state-0")
    finished, spell = [], lambda x: F.concat(F.when(F.size(x) > 0, "/").otherwise(""), F.array_join(x, "/"))
    d = 0
    while True:
        groups = scratch.write(state.groupBy("host", "prefix").agg(F.min("rest").alias("low"), F.max("rest").alias("high")), f"groups-{d}")
        if not groups.count():
            break
        equal = F.transform(F.sequence(F.lit(0), F.size("low")), lambda i: F.get("low", i).eqNullSafe(F.get("high", i)))
        at = F.when(F.col("low") == F.col("high"), -1).otherwise(F.array_position(equal, False) - 1).cast("int")
        placed = scratch.write(state.join(groups.select("host", "prefix", at.alias("at")), ["host", "prefix"]), f"placed-{d}")
        done = placed.where("at < 0")
        finished.append(done.select("host", "shape", F.concat("prefix", spell(F.col("rest"))).alias("template"), "purity"))
        common, end = F.slice("rest", F.lit(1), F.col("at")), F.size("rest") <= F.col("at")
        tree = placed.where("at >= 0").select("host", "shape", "n", "seen", "bad", "far_seen", "far_bad", F.concat("prefix", spell(common)).alias("prefix"), F.col("purity").alias("above"), F.when(end, "").otherwise(F.get("rest", F.col("at"))).alias("segment"), F.when(end, F.array().cast("array<string>")).otherwise(F.slice("rest", F.col("at") + 2, F.size("rest"))).alias("rest"))
        below = _kind(F.coalesce(F.get("rest", F.lit(0)), F.lit("")))
        kids = tree.groupBy("host", "prefix", "segment").agg(F.max("above").alias("above"), F.sum("n").alias("n"), F.sum("seen").alias("own_seen"), F.sum("bad").alias("own_bad"), *(F.sum(F.col("n") * F.col(c)).alias(c) for c in ("far_seen", "far_bad")), *(F.sum(F.when(below == k, F.col("n")).otherwise(0)).alias(k) for k in KINDS))
        kids = scratch.write(kids, f"kids-{d}")
        parents = kids.groupBy("host", "prefix").agg(F.sum("n").alias("all"), F.count("*").alias("children"))
        rare = (F.col("segment") != "") & (F.col("n") < RARE * F.col("all")) & (F.col("children") > 1 / RARE)
        named = scratch.write(kids.join(parents, ["host", "prefix"]).withColumn("label", F.when(rare, "*").otherwise(F.col("segment"))), f"named-{d}")
        branches = named.groupBy("host", "prefix", "label").agg(F.max("above").alias("above"), *(F.sum(c).alias(c) for c in ("n", "own_seen", "own_bad", *KINDS)), *((F.sum(c) / F.sum("n")).alias(c) for c in ("far_seen", "far_bad")))
        branches = branches.groupBy("host", "prefix").agg(F.max("above").alias("above"), F.collect_list(F.struct("label", _kind(F.col("label")).alias("kind"), "n", "own_seen", "own_bad", "far_seen", "far_bad", *KINDS)).alias("branches"))
        choice = named.select("host", "prefix", "segment", "label").join(_decide(branches), ["host", "prefix", "label"]).drop("label")
        choice = scratch.write(choice, f"choice-{d}")
        moved = tree.join(choice, ["host", "prefix", "segment"])
        ended = moved.where("segment = ''")
        finished.append(ended.select("host", "shape", F.col("prefix").alias("template"), "purity"))
        on = moved.where("segment <> ''").select("host", "shape", "n", "seen", "bad", "far_seen", "far_bad", "rest", F.concat("prefix", F.lit("/"), "name").alias("prefix"), "purity")
        d += 1
        state = scratch.write(on, f"state-{d}")
    out = shapes.sparkSession.createDataFrame([], "host string, shape string, template string, purity double")
    for part in finished:
        out = out.unionByName(part)
    return out


def judge_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", reject: float = REJECT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity.

    Rules judge the URLs they fit and are the labels from which templates learn. A null URL, or
    one without `://`, has an empty host and path and is judged as such a path; without any label
    nothing is rejected. Rows that repeat count and are returned as often as they occur. URLs of
    any length and depth are read whole; empty segments are no segments, and runs of equal ones
    are one. An empty table gives an empty result. Other columns are ignored.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", F.regexp_replace("path", "[0-9]+", "*"))
    rows = scratch.write(rows.select("page_id", "host", "path", "shape", "r.rule", F.col("r.verdict").alias("ruled")), "rows")
    known = F.col("ruled").isNotNull().cast("long")
    shapes = rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.sum(known).alias("seen"), F.sum((F.coalesce("ruled", F.lit("")) == "block").cast("long")).alias("bad"))
    found = templates(scratch.write(shapes, "shapes"), scratch)
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= reject, "block").otherwise("allow"))
    return rows.join(found, ["host", "shape"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def op10_urls(spark, sf_dir):
    return judge_urls(read(spark, sf_dir, "pages"))
