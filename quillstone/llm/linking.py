"""Classes of linked nodes, and candidate pairs from posting lists without all pairs of a group.

Nodes are longs. Everything is kept in tables of the shared folder; nothing is gathered on the driver but counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for each node of the edges (a, b): comp is the same for nodes that are connected.

    Contraction: each node hooks to the neighbour of smallest priority, edges are rewritten and loops dropped,
    until no edge is left. The priority is a hash, so chains of consecutive ids also shrink by a constant factor
    a round. Empty edges give no rows.
    """
    spark = edges.sparkSession
    edges = stored(edges.where("a <> b").select("a", "b"), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c).alias("r"), F.col(c).alias("n"))
        # the smallest neighbour by (hash, id); two longs, so that the aggregate stays a hash aggregate
        hashed = both.select("a", F.col("b").alias("n"), F.xxhash64("b").alias("r"))
        least = hashed.groupBy("a").agg(F.min("r").alias("r"))
        least = hashed.join(least, ["a", "r"]).groupBy("a", "r").agg(F.min("n").alias("n"))
        hook = least.select(
            F.col("a").alias("node"),
            F.when(F.struct("r", "n") < rank("a"), F.col("n")).otherwise(F.col("a")).alias("up"),
        )
        hook = stored(hook, "hook")
        # one step of pointer jumping; more come with the next rounds
        up = hook.select(F.col("node").alias("up"), F.col("up").alias("up2"))
        hook = stored(hook.join(up, "up", "left").select("node", F.coalesce("up2", "up").alias("comp")), "hook")
        if labels is None:
            labels = hook
        else:
            step = hook.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
            labels = stored(labels.join(step, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp")), "labels")
        ha = hook.select(F.col("node").alias("a"), F.col("comp").alias("ca"))
        hb = hook.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
        edges = stored(
            edges.join(ha, "a").join(hb, "b").where("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(),
            "edges",
        )
    if labels is None:
        labels = spark.createDataFrame([], "node long, comp long")
    return labels


def linked(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps (node, comp), of `components`, after more links (a, b): only these are contracted, between components."""
    of = lambda c: comps.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    step = components(between.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")))
    moved = comps.join(step.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp", "left")
    fresh = step.join(comps.select("node"), "node", "left_anti").select("node", "comp")
    return stored(moved.select("node", F.coalesce("next", "comp").alias("comp")).unionByName(fresh), "labels")


def _side(postings: DataFrame, name: str) -> DataFrame:
    return postings.select("key", F.col("node").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in postings.columns if c not in ("key", "node")])


def _labelled(postings: DataFrame, comps: DataFrame, long_from: int | None = None) -> DataFrame:
    """Postings of the lists that more than one component is in, with comp and, if asked for, whether the list is long."""
    found = postings.join(comps.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    found = stored(found, "lists")
    sizes = [(F.count(F.lit(1)) >= long_from).alias("long")] if long_from is not None else []
    mixed = found.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), *sizes).where("lo <> hi").drop("lo", "hi")
    return stored(found.join(mixed, "key"), "mixed")


def _starred(postings: DataFrame, fits: Callable, least: int, smallest: str | None = None) -> DataFrame:
    """(a, b): in lists of so many nodes, each node with the list's first one (that of the smallest value of an
    attribute, if named); postings may have comp."""
    lists = postings.groupBy("key").agg(*([F.min(smallest).alias(smallest)] if smallest else [F.min("node").alias("a")]), F.count(F.lit(1)).alias("len")).where(F.col("len") >= least)
    if smallest:
        lists = postings.join(lists.select("key", smallest), ["key", smallest]).groupBy("key").agg(F.min("node").alias("a"))
    lead = lists.select("key", "a").join(_side(postings, "a"), ["key", "a"])
    other = F.col("a_comp") != F.col("b_comp") if "comp" in postings.columns else F.col("a") != F.col("b")
    return _side(postings, "b").join(lead, "key").where(other & fits("a_", "b_")).select("a", "b").distinct()


def _crossing(postings: DataFrame, fits: Callable) -> DataFrame:
    """(a, b): all pairs of a list whose ends are in different components."""
    pairs = _side(postings, "a").join(_side(postings, "b"), "key")
    return pairs.where((F.col("a") < F.col("b")) & (F.col("a_comp") != F.col("b_comp")) & fits("a_", "b_")).select("a", "b").distinct()


class ByKeys:
    """Finer keys for link_lists, with a condition of their own on the attributes that they bring."""

    def __init__(self, post: Callable[[DataFrame], DataFrame], fits: Callable):
        self.post, self.fits = post, fits

    def __call__(self, fetched: DataFrame) -> DataFrame:
        return self.post(fetched)


class ByLead:
    """A last level of link_lists for the lists that are long even by the finest keys: each node against its lists' leads.

    post: members (lead, node), fetched -> (key, node, probe, strong, attr...): of any linked pair among a lead's members,
    the strong one, or the smaller one if both are or none is, has a probing row, and the other one a row that does not
    probe, of one key and so that fits (prefix of the probing one's columns, of the other's) holds.
    """

    def __init__(self, post: Callable[[DataFrame, DataFrame], DataFrame], fits: Callable):
        self.post, self.fits = post, fits

    def pairs(self, live: DataFrame, comps: DataFrame, fetched: DataFrame) -> DataFrame:
        """(a, b) to be tried, of live lists (key, node, first...)."""
        first = live.groupBy("key").agg(F.min("first").alias("first"))
        leads = live.join(first, ["key", "first"]).groupBy("key").agg(F.min("node").alias("lead"), F.min("first").alias("first"))
        members = stored(live.select("key", "node").join(leads, "key").groupBy("lead", "node").agg(F.min("first").alias("first")), "members")
        # leads that are in lists of others stand back for the first of these, so that variants have one lead in all lists
        own = members.select(F.col("lead").alias("node")).distinct()
        up = members.join(own, "node").groupBy("node").agg(F.min(F.struct("first", "lead"))["lead"].alias("up"))
        up = stored(up, "leads")
        over = up.select(F.col("node").alias("up"), F.col("up").alias("over"))
        up = up.join(over, "up").select(F.col("node").alias("lead"), "over")
        members = stored(members.join(up, "lead").select(F.col("over").alias("lead"), "node").distinct(), "members")
        found = self.post(members, fetched).join(comps.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        found = stored(found, "zoned")
        a, b = _side(found.where("probe").drop("probe"), "a"), _side(found.where("not probe").drop("probe"), "b")
        once = ((F.col("a_strong") != F.col("b_strong")) & F.col("a_strong")) | ((F.col("a_strong") == F.col("b_strong")) & (F.col("a") < F.col("b")))
        pairs = a.join(b, "key").where((F.col("a_comp") != F.col("b_comp")) & once & self.fits("a_", "b_"))
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _nodes(*pairs: DataFrame) -> DataFrame:
    each = [p.select(F.col(c).alias("node")) for p in pairs for c in ("a", "b")]
    whole = each[0]
    for more in each[1:]:
        whole = whole.union(more)
    return whole.distinct()


def link_lists(
    postings: DataFrame,
    fits: Callable,
    sift: Callable[[DataFrame], DataFrame],
    fetch: Callable[[DataFrame], DataFrame],
    confirm: Callable[[DataFrame, DataFrame], DataFrame],
    refine: Sequence[Callable[[DataFrame], DataFrame] | ByLead],
    fine_fits: Callable | None = None,
    star_from: int = 8,
    long_from: int = 33,
) -> DataFrame:
    """Components of the nodes whose pairs share a key and are linked.

    postings: (key, node, attr...). fits: (prefix of a's columns, of b's) -> Column, a cheap necessary condition on attrs.
    sift: (a, b) -> those of the pairs that may be linked. fetch: (node) -> what confirm needs of the nodes. confirm:
    (a, b), fetched -> the linked pairs. refine: each fetched -> (key, node, first, hub, attr...), by keys of which any
    linked pair among the fetched nodes shares one for which fine_fits holds; the node with the smallest `first` of a
    list is the one that most of the others may be linked with; where hub is true, it alone need be tried. As ByKeys, they
    have their own fits.

    First, in lists of star_from nodes and more, each node is tried against the list's smallest node: a large group of
    near copies becomes one component at the cost of its length. Lists within one component need nothing more. Of the
    others, short lists have all pairs tried whose ends are in different components; the nodes of lists of long_from
    nodes and more are posted anew by the finer keys of `refine`, one after the other, and tried in the same way; lists
    that are long by the last of them are tried pair by pair, or as a ByLead at the end of `refine` says. No component is
    lost on the way.
    """
    by_lead = refine[-1] if refine and isinstance(refine[-1], ByLead) else None
    refine = refine[:-1] if by_lead else refine
    starred = stored(sift(_starred(postings, fits, star_from)), "starred")
    comps = components(stored(confirm(starred, fetch(_nodes(starred))), "links") if not starred.isEmpty() else starred)
    fetched = None
    for level in range(len(refine) + 1):
        last = level == len(refine)
        led = last and by_lead and level
        whole = last and not led
        live = _labelled(postings, comps, None if whole else long_from)
        short = live if whole else live.where("not long").drop("long")
        pairs = _crossing(short, fits)
        if led:
            pairs = pairs.union(by_lead.pairs(live.where("long").select("key", "node", "first"), comps, fetched)).distinct()
        pairs = stored(sift(pairs), "crossing")
        entangled = None if last else stored(live.where("long").select("node").distinct(), "entangled")
        done = last or entangled.isEmpty()
        if done and pairs.isEmpty():
            return comps
        if fetched is None:
            fetched = fetch(_nodes(pairs) if done else _nodes(pairs).union(entangled).distinct())
        comps = linked(comps, stored(confirm(pairs, fetched), "links"))
        if done:
            return comps
        fits = refine[level].fits if isinstance(refine[level], ByKeys) else fine_fits or fits
        own = _labelled(refine[level](fetched.join(entangled, "node", "left_semi")), comps)
        starred = _starred(own.where("not hub"), fits, star_from, "first").union(_starred(own.where("hub"), fits, 2, "first"))
        comps = linked(comps, stored(confirm(stored(sift(starred.distinct()), "starred"), fetched), "links"))
        # lists within one component stay so
        postings = own.where("not hub").drop("hub", "comp")
    return comps
