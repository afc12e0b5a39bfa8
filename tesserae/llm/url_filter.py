"""URL verdicts from a tree of path templates (DataFrame functions only).

Per host, each url's path becomes a template: segments that vary by record
(numbers, dates, hashes, long slugs, query-like names) turn into wildcards.  The
templates of a host form a tree, which is worked down level by level.  A branch whose
share of bad labels does not differ significantly from its siblings', or that has too few
labels to tell, is merged with them into one wildcard branch; what lies below merged
branches is added up before it is looked at in turn.  So segments that vary in a host
without telling anything become wildcards too, whatever they look like.

A url gets the verdict of the deepest node on its path that has enough labels: its share
of bad labels, drawn towards the smoothed share of the node above, must stay below a
limit.  Hosts without labels fall back to the share over all labels.

Defined results: a null url, or one without ``://``, has an empty host and path and
is judged by the overall share; repeated urls are judged alike; empty tables give no
rows; without any label every url is allowed; other columns are ignored.  The tree is as
deep as any node with enough labels, one round of jobs a level: there is no limit of depth.

Rows of a hot host are dealt over ``DEALS`` parts by a hash, and what they meet (nodes with
enough labels, a row each) is repeated for each part, so no task gets a whole hot host.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.hot import HOT_ONE_IN, join_unique
from tesserae.session import materialise

#: A branch is separate when its share differs from its siblings' by this many standard errors.
MERGE_Z = 2.5
#: Labels that a branch needs before it is judged by itself.
MIN_LABELS = 10
#: Weight, in labels, of the parent's share when a branch's share is smoothed.
PRIOR_LABELS = 20
#: Templates with this smoothed share of bad labels or more are rejected.
MAX_BAD = 0.5
#: The segment of merged branches.
WILDCARD = "*"
#: Parts that the rows of a host with more than one in ``HOT_ONE_IN`` rows are dealt into.
DEALS = 64
#: Levels after which the plan of the walk is cut by a written table.
WRITTEN_LEVELS = 3

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """``host`` and all its subdomains, for paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_and_path(url: Column) -> tuple[Column, Column]:
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    rest = F.when(has, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    plain = F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^([^/?#]*)([^?#]*)", 2)
    return F.translate(plain, UPPER, UPPER.lower()), path


def matched_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # longer rules are asked first
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return name, verdict


def segment_template(segment: Column) -> Column:
    """A path segment with its variable part replaced by a wildcard; the file ending stays."""
    end = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    kind = (
        F.when(stem.rlike(r"^[0-9]+$"), "{n}")
        .when(stem.rlike(r"^[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?$"), "{date}")
        .when(stem.rlike(r"^[0-9a-fA-F-]{12,}$"), "{hex}")
        .when(stem.rlike(r"^[^-_]+([-_][^-_]+){2,}$"), "{slug}")
        .when(stem.rlike(r"[0-9]"), F.regexp_replace(stem, r"[0-9]+", "{n}"))
        .otherwise(stem)
    )
    return F.concat(kind, end)


def with_template(urls: DataFrame) -> DataFrame:
    """Adds ``host``, ``path`` and ``steps``: the template's segments under the host."""
    host, path = host_and_path(F.col("url"))
    out = urls.withColumns({"host": host, "path": path})
    return out.withColumn("steps", F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), segment_template))


def _smoothed(bad: Column, n: Column, towards: Column) -> Column:
    return (bad + towards * F.lit(float(PRIOR_LABELS))) / (n + F.lit(float(PRIOR_LABELS)))


def _hot_hosts(rows: DataFrame) -> DataFrame:
    """Hosts with more than one in ``HOT_ONE_IN`` rows, so fewer than that."""
    counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))  # one row
    hot = counts.crossJoin(F.broadcast(total)).where(F.col("rows") * HOT_ONE_IN > F.col("total"))
    return hot.select("host", F.lit(True).alias("hot"))


def _dealt(rows: DataFrame, hot: DataFrame, *by: str) -> DataFrame:
    """``rows`` with their ``deal``: by the hash of ``by`` for hot hosts, 0 for others."""
    part = F.pmod(F.xxhash64(*by), F.lit(DEALS)).cast("int")
    return rows.join(F.broadcast(hot), "host", "left").withColumn("deal", F.when(F.col("hot"), part).otherwise(0)).drop("hot")


def _repeated(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """``rows`` with every ``deal`` for hot hosts, and with 0 for others."""
    parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(DEALS - 1))).otherwise(F.array(F.lit(0)))
    return rows.join(F.broadcast(hot), "host", "left").withColumn("deal", F.explode(parts)).drop("hot")


def _branches(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Counts of the children of every node, and whether each is a branch of its own.

    The two shares, of a child and of its siblings, are compared with a pooled variance,
    squared so that no root is taken, in floating point throughout.
    """
    children = rows.groupBy("host", "node", "segment").agg(F.sum("n").cast("double").alias("n"), F.sum("b").cast("double").alias("b"))
    # A node may have very many children; they are added up before they meet.
    parents = children.groupBy("host", "node").agg(F.sum("n").alias("pn"), F.sum("b").alias("pb"))
    n, b, pn, pb = (F.col(c) for c in ("n", "b", "pn", "pb"))
    gap = b * (pn - n) - (pb - b) * n
    spread = pb * (pn - pb) * n * (pn - n)
    apart = (F.col("segment") != WILDCARD) & (n >= MIN_LABELS) & (pn > n) & (gap * gap * pn > spread * F.lit(MERGE_Z * MERGE_Z))
    met = _dealt(children, hot, "segment").join(_repeated(parents, hot), ["host", "deal", "node"])
    return met.select("host", "node", "segment", "n", "b", apart.alias("apart"))


def _below(node: Column, segment: Column) -> Column:
    return F.concat(node, F.lit("/"), F.coalesce(segment, F.lit(WILDCARD)))


def template_verdicts(templates: DataFrame, labelled: DataFrame) -> DataFrame:
    """``templates`` with ``branch``, ``bad_share`` and ``verdict``.

    ``templates`` has distinct (host, steps); ``labelled`` has (host, steps, bad) with
    a row for each labelled url, ``bad`` 0 or 1.  Labels are added up by template
    first, so a host with a third of all urls weighs no more than its templates.
    """
    counts = materialise(labelled.groupBy("host", "steps").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("b")), "labels")
    hot = materialise(_hot_hosts(templates).union(_hot_hosts(counts)).distinct(), "hosts")
    overall = counts.agg((F.sum("b").cast("double") / F.sum("n")).alias("base"))  # one row
    hosts = counts.groupBy("host").agg(F.sum("n").cast("double").alias("n"), F.sum("b").cast("double").alias("b"))
    base = F.coalesce("base", F.lit(0.0))
    known = F.coalesce(_smoothed(F.col("b"), F.col("n"), base), base)
    walk = _dealt(templates, hot, "steps").join(_repeated(hosts, hot), ["host", "deal"], "left").crossJoin(F.broadcast(overall))
    walk = walk.select(*templates.columns, "deal", F.lit("").alias("node"), F.lit("").alias("branch"), known.alias("share"))
    rows = _dealt(counts, hot, "steps").withColumn("node", F.lit(""))
    for depth in itertools.count(1):
        rows = rows.where(F.size("steps") >= depth).withColumn("segment", F.get("steps", F.lit(depth - 1)))
        branches = materialise(_branches(rows, hot), "branches")
        own = _repeated(branches.where("apart").select("host", "node", "segment", F.col("segment").alias("own")), hot)
        merged = _below(F.col("node"), F.when(F.col("apart"), F.col("segment")))
        nodes = branches.groupBy("host", merged.alias("node")).agg(F.sum("n").alias("n"), F.sum("b").alias("b")).where(F.col("n") >= MIN_LABELS)
        nodes = materialise(nodes, "nodes")
        if nodes.isEmpty():  # nothing below has enough labels either
            break
        nodes = _repeated(nodes, hot)
        named = rows.join(own, ["host", "deal", "node", "segment"], "left").select("host", "deal", "steps", F.col("n"), F.col("b"), _below(F.col("node"), F.col("own")).alias("node"))
        rows = materialise(named.join(nodes.select("host", "deal", "node"), ["host", "deal", "node"], "left_semi"), "labels")
        # A template that ends above this level has no segment here and keeps its share.
        walk = walk.withColumn("segment", F.get("steps", F.lit(depth - 1))).join(own, ["host", "deal", "node", "segment"], "left")
        walk = walk.withColumn("node", F.when(F.col("segment").isNotNull(), _below(F.col("node"), F.col("own")))).drop("own", "segment")
        share = F.coalesce(_smoothed(F.col("b"), F.col("n"), F.col("share")), F.col("share"))
        branch = F.when(F.col("n").isNotNull(), F.col("node")).otherwise(F.col("branch"))
        walk = walk.join(nodes, ["host", "deal", "node"], "left").select(*templates.columns, "deal", "node", branch.alias("branch"), share.alias("share"))
        if depth % WRITTEN_LEVELS == 0:
            walk = materialise(walk, "walk")
    share = F.col("share")
    return walk.select(*templates.columns, "branch", share.alias("bad_share"), F.when(share >= MAX_BAD, "block").otherwise("allow").alias("verdict"))


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """Host, path, rule and verdict of every url.

    ``labels`` has (``url``, ``bad``) rows: urls whose content was labelled.
    """
    urls = with_template(pages.select(F.col(key).alias("key"), F.col(url).alias("url")))
    seen = with_template(labels.select("url", F.col("bad").cast("long").alias("bad"))).select("host", "steps", "bad")
    templates = materialise(urls.groupBy("host", "steps").agg(F.count(F.lit(1)).alias("urls")), "templates")
    verdicts = materialise(template_verdicts(templates, seen), "verdicts")
    name, ruled = matched_rule(F.col("host"), F.col("path"), rules)
    return join_unique(urls, verdicts, ["host", "steps"], "urls", ["key", "url"]).select(
        F.col("key").alias(key),
        "host",
        "path",
        name.alias("rule"),
        F.coalesce(ruled, F.col("verdict"), F.lit("allow")).alias("verdict"),
        F.concat(F.lit("/"), F.array_join("steps", "/")).alias("template"),
        "branch",
        F.round("bad_share", 6).alias("bad_share"),
    )
