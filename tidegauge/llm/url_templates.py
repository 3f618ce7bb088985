"""URL filter: explicit rules, then the labelled purity of path templates.

Rules name a host (and its subdomains) and a path prefix; the longest that fits decides.

For all other URLs each host has a tree of path templates, built in Spark a level at a time:
1. digits become {n} and long hexadecimal words {h}; equal paths of a host are one row with counts from there on;
2. below each node, a segment that is rare (fewer than `least` URLs or a share under `share` of the node's) is
   variable: all such segments become one wildcard {*}. So a node has 1 / share named branches at most;
3. branches that can't be told apart are merged: what follows them (the end, a number, a word, ...) and their
   labels agree within Hoeffding's bound at `alpha`. The more frequent branch takes in the lesser ones;
4. each node's purity, the share of good labels, is smoothed towards its parent's with the weight of `weight`
   labels, a host's towards that of all hosts.
A template whose purity is under `purity` is rejected. From level `depth` on, the rest of a path is one segment
with its digits generalised.

Counts are combined before each shuffle, so a hot host costs no more than others; joins put the rows of paths
against one row per node or path.

Edge cases: a null url, or one without ://, has an empty host and path, which form a host of their own; an
empty path ends at the root of its host; repeated rows count each time; labels that fit no page are ignored, null
ones too; very long urls are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path prefix, verdict) of the registered query.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: What may follow a branch: the end, an empty segment, a number, a segment with one, a wildcard, another word.
NEXT = ("end", "slash", "number", "numbered", "word")
BROADCAST_PATHS = 100_000  # beyond so many different paths the verdicts are joined by shuffle
SUMS = ("n", "good", "bad", *NEXT)


def located(pages: DataFrame) -> DataFrame:
    """page_id, host, path."""
    url = pages["url"].cast("string")
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return pages.select(pages["page_id"].alias("page_id"), F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path"))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls without one. The rules are a short list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, f"{h}{p}").otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """The path with hexadecimal words of 16 characters and more, and then digits, generalised."""
    return F.regexp_replace(F.regexp_replace(path, r"(?<![0-9A-Za-z])(?=[a-f]*[0-9])[0-9a-f]{16,}(?![0-9A-Za-z])", "{h}"), r"[0-9]+", "{n}")


def segments(shaped: Column, depth: int) -> Column:
    """[] for an empty path, [""] for "/"; the last of `depth` segments holds the rest."""
    return F.when(shaped == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(shaped, "^/", ""), "/", depth))


def kind_of(segment: Column) -> Column:
    """Which of NEXT a segment is; null: the end."""
    return F.when(segment.isNull(), "end").when(segment == "", "slash").when(segment == "{n}", "number").when(segment.contains("{n}") | segment.contains("{h}"), "numbered").otherwise("word")


def apart(x: dict, y: dict, alpha: float) -> bool:
    """Whether Hoeffding's bound tells two branches apart, by what follows them or by their labels."""
    spread = math.sqrt(0.5 * math.log(2 / alpha))
    if any(abs(x[k] / x["n"] - y[k] / y["n"]) > spread * (x["n"] ** -0.5 + y["n"] ** -0.5) for k in NEXT):
        return True
    a, b = x["good"] + x["bad"], y["good"] + y["bad"]
    return bool(a and b) and abs(x["bad"] / a - y["bad"] / b) > spread * (a**-0.5 + b**-0.5)


def merged(named: list[dict], alpha: float) -> list[list[dict]]:
    """Groups of branches: each joins the first group whose leader it can't be told apart from."""
    groups: list[list[dict]] = []
    for x in sorted(named, key=lambda x: (-x["n"], x["seg"].encode())):
        for g in groups:
            if not apart(g[0], x, alpha):
                g.append(x)
                break
        else:
            groups.append([x])
    return groups


def grown(nodes: DataFrame, weight: float, alpha: float) -> DataFrame:
    """nodes (host, node, purity, sums, branches: at most 1 / share) -> host, node, names map<segment, struct<name,
    purity>>, others struct<name, purity> (the wildcard, if there is need of it)."""
    kind = pa.struct([("name", pa.string()), ("purity", pa.float64())])

    def branch(group: list[dict], name: str, above: float) -> dict:
        good, bad = sum(x["good"] for x in group), sum(x["bad"] for x in group)
        return {"name": name, "purity": (good + weight * above) / (good + bad + weight)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, others = [], []
            for r in b.to_pylist():
                named = r["branches"] or []
                own = []
                for g in merged(named, alpha):
                    segs = sorted((x["seg"] for x in g), key=str.encode)
                    at = branch(g, segs[0] if len(segs) == 1 else "(" + "|".join(segs) + ")", r["purity"])
                    own += [(s, at) for s in segs]
                rest = {k: r[k] - sum(x[k] for x in named) for k in SUMS}
                names.append(own)
                others.append(branch([rest], "{*}", r["purity"]) if rest["n"] else None)
            columns = [b.column("host"), b.column("node"), pa.array(names, pa.map_(pa.string(), kind)), pa.array(others, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "node", "names", "others"])

    return nodes.select("host", "node", "purity", *SUMS, "branches").mapInArrow(run, "host string, node string, names map<string,struct<name:string,purity:double>>, others struct<name:string,purity:double>")


def path_counts(places: DataFrame, labels: DataFrame) -> DataFrame:
    """host, shaped, n, good, bad: one row per different path. places: page_id, host, path; labels: page_id, bad."""
    marks = labels.where("bad is not null").groupBy("page_id").agg(F.count_if(~F.col("bad")).alias("good"), F.count_if("bad").alias("bad"))
    marked = places.join(marks, "page_id").select("host", "shaped", F.lit(0).cast("long").alias("n"), "good", "bad")
    zero = F.lit(0).cast("long")
    each = places.select("host", "shaped", F.lit(1).cast("long").alias("n"), zero.alias("good"), zero.alias("bad"))
    return each.union(marked).groupBy("host", "shaped").agg(*[F.sum(c).alias(c) for c in ("n", "good", "bad")])


def path_templates(counts: DataFrame, share: float = 1 / 32, least: int = 4, alpha: float = 0.05, weight: float = 10.0, depth: int = 8) -> DataFrame:
    """counts (host, shaped, n, good, bad) -> host, shaped, template, purity (share of good labels)."""
    counts = materialize(counts, "paths")
    good, bad = counts.select(F.sum("good"), F.sum("bad")).first()
    prior = (good + 1) / (good + bad + 2) if good is not None else 0.5
    hosts = counts.groupBy("host").agg(((F.sum("good") + weight * prior) / (F.sum("good") + F.sum("bad") + weight)).alias("purity"))
    rows = counts.withColumn("segs", segments(F.col("shaped"), depth)).join(materialize(hosts, "hosts"), "host").withColumn("node", F.lit(""))
    rows = materialize(rows, "level")
    levels = rows.select(F.max(F.size("segs"))).first()[0] or 0
    done = [rows.where(F.size("segs") == 0)]
    rows = rows.where(F.size("segs") > 0)
    for k in range(levels):
        seg, after = F.get("segs", F.lit(k)), kind_of(F.get("segs", F.lit(k + 1)))
        sums = [F.sum(c).alias(c) for c in ("n", "good", "bad")] + [F.sum(F.when(after == c, F.col("n")).otherwise(0)).alias(c) for c in NEXT]
        kids = materialize(rows.groupBy("host", "node", seg.alias("seg")).agg(*sums, F.max("purity").alias("purity")), "branches")
        nodes = materialize(kids.groupBy("host", "node").agg(*[F.sum(c).alias(c) for c in SUMS], F.max("purity").alias("purity")), "nodes")
        whole = nodes.select("host", "node", F.col("n").alias("whole"))
        named = kids.join(whole, ["host", "node"]).where((F.col("n") >= least) & (F.col("n") >= share * F.col("whole")))
        named = named.groupBy("host", "node").agg(F.collect_list(F.struct("seg", *SUMS)).alias("branches"))
        tree = materialize(grown(nodes.join(named, ["host", "node"], "left"), weight, alpha), "tree")
        at = F.coalesce(F.get(F.map_values(F.map_filter("names", lambda s, _: s == seg)), F.lit(0)), F.col("others"))
        step = rows.drop("purity").join(tree, ["host", "node"]).withColumn("at", at)
        rows = materialize(step.select("host", "shaped", "n", "good", "bad", "segs", F.concat("node", F.lit("/"), "at.name").alias("node"), F.col("at.purity").alias("purity")), "level")
        done.append(rows.where(F.size("segs") == k + 1))
        rows = rows.where(F.size("segs") > k + 1)
    return reduce(DataFrame.union, [d.select("host", "shaped", F.col("node").alias("template"), "purity") for d in done])


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, purity: float = 0.5, **parameters) -> DataFrame:
    """pages (page_id, url), labels (page_id, bad boolean) -> page_id, host, path, rule, verdict, template, purity."""
    places = located(pages).withColumn("shaped", shape(F.col("path")))
    templates = materialize(path_templates(path_counts(places, labels), **parameters), "templates")
    rows = places.join(F.broadcast(templates) if templates.count() <= BROADCAST_PATHS else templates, ["host", "shaped"])
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("purity") < purity, "block").otherwise("allow")).alias("verdict"), "template", "purity")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, bad: a page shows the document whose number comes first in its path; a document is bad if it is
    toxic or of no quality."""
    places = located(pages)
    shown = places.select("page_id", F.regexp_extract("path", "/([0-9]{1,18})", 1).try_cast("long").alias("doc_id")).where("doc_id is not null")
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0)
    return shown.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad").distinct()


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return judge(pages, page_labels(pages, read_table(spark, sf_dir, "labels")))
