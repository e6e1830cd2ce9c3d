"""Link graphs as edge tables (src, dst) of any id type.

Iterative operators are loops of lazy plans; every round ends in a table in the shared
folder, so lineage stays short and a lost executor costs one round.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.cells import Cells, added
from textloom.functions import links, text as tx, vectors
from textloom.operators import axes
from textloom.operators.features import kmeans_from
from textloom.operators.similarity import block_count
from textloom.scale import Salted, exact_quantiles, fit_broadcast, on_disk, release, running, salted_join, settle

DAMPING = 0.85


# -- building ----------------------------------------------------------------------------


def undirected(edges: DataFrame) -> DataFrame:
    """Simple undirected edges, each once with src < dst."""
    return (
        edges.where(F.col("src") != F.col("dst"))
        .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
        .distinct()
    )


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def vertices(edges: DataFrame) -> DataFrame:
    return both_ways(edges).select(F.col("src").alias("id")).distinct()


def resolve_titles(wanted: DataFrame, titles: DataFrame) -> DataFrame:
    """Links whose lower-case form is a known title and that differ from their own title."""
    known = titles.select(F.lower("title").alias("_key")).distinct()
    found = salted_join(wanted.withColumn("_key", F.lower("link")), known, ["_key"])
    return found.where(F.col("link") != F.col("title")).drop("_key")


def wiki_graph(articles: DataFrame, title: str = "title", text: str = "contents") -> DataFrame:
    """Undirected edges between articles whose titles are linked; lone articles have none."""
    wanted = articles.select(F.col(title).alias("title"), F.explode(links.wiki_links(F.col(text))).alias("link"))
    found = resolve_titles(wanted, articles.select(F.col(title).alias("title")))
    names = articles.groupBy(F.lower(title).alias("_key")).agg(F.min(title).alias("dst"))
    named = salted_join(found.withColumn("_key", F.lower("link")), names, ["_key"])
    return undirected(named.select(F.col("title").alias("src"), "dst"))


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges with both ends in ``keep`` (id)."""
    ends = keep.select("id").distinct()
    inside = salted_join(edges, ends.withColumnRenamed("id", "src"), ["src"], "left_semi")
    return salted_join(inside, ends.withColumnRenamed("id", "dst"), ["dst"], "left_semi")


def neighbours(edges: DataFrame, name) -> DataFrame:
    """Neighbours of one vertex of an undirected graph."""
    return (
        edges.where(F.col("src") == name)
        .select(F.col("dst").alias("neighbour"))
        .unionByName(edges.where(F.col("dst") == name).select(F.col("src").alias("neighbour")))
        .distinct()
    )


# -- centrality --------------------------------------------------------------------------


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, degree_centrality) of an undirected graph."""
    counted = both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    counted = settle(counted)
    return counted.withColumn("degree_centrality", F.col("degree") / F.lit(max(counted.count() - 1, 1)))


def pagerank(
    edges: DataFrame,
    ids: DataFrame | None = None,
    damping: float = DAMPING,
    tolerance: float = 1e-6,
    max_rounds: int = 100,
) -> DataFrame:
    """(id, pagerank) of a directed graph; pass ``both_ways`` of an undirected one.

    Rank of vertices without links out is spread over all. Stops when the ranks move by
    less than ``tolerance`` per vertex. The edges are packed once, in cells of a part of the sources and a part of the targets, so
    a hub's edges lie in many cells; a round sends ranks to the cells and brings back their sums by target.
    """
    out = settle(edges.groupBy("src").agg(F.count(F.lit(1)).alias("_out")))
    cells = Cells(edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(1.0).alias("value")), square=True)

    def send(at_row, at_col, times, share, _):
        return None, added(at_col, (times * share[at_row, 0])[:, None], len(_))

    ids = settle((vertices(edges) if ids is None else ids.select("id")).distinct())
    n = ids.count()
    ranks = ids.withColumn("pagerank", F.lit(1.0 / n))
    dead = settle(ids.join(out.select(F.col("src").alias("id")), "id", "left_anti"))
    has_dead = not dead.isEmpty()
    before = None
    for _ in range(max_rounds):
        lost = (ranks.join(dead, "id").agg(F.sum("pagerank")).first()[0] or 0.0) if has_dead else 0.0
        shares = ranks.join(out.hint("merge"), F.col("id") == F.col("src")).select(F.col("id").alias("row"), (F.col("pagerank") / F.col("_out")).alias("share"))
        _, parts, both = cells.meet(send, (0, 1), rows=shares)
        got = parts.groupBy(F.col("col").alias("id")).agg(F.sum("s0").alias("_got"))
        fresh = (1 - damping) / n + damping * (F.coalesce("_got", F.lit(0.0)) + F.lit(lost / n))
        step = settle(
            ranks.withColumnRenamed("pagerank", "_old").join(got, "id", "left").select("id", fresh.alias("pagerank"), "_old")
        )
        release(before, both)
        ranks, before = step.select("id", "pagerank"), step
        if tolerance and step.agg(F.sum(F.abs(F.col("pagerank") - F.col("_old")))).first()[0] < n * tolerance:
            break
    cells.release()
    return ranks


def centrality(edges: DataFrame, **options) -> DataFrame:
    """Degree, degree centrality, PageRank and the harmonic mean of the last two."""
    ranks = pagerank(both_ways(edges), **options)
    return degrees(edges).join(ranks, "id").withColumn(
        "agg_centrality", tx.harmonic_mean(F.col("degree_centrality"), F.col("pagerank"))
    )


# -- components --------------------------------------------------------------------------


def components(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Weak components: (id, component), the component being its smallest id.

    Alternates the large-star and small-star steps of published MapReduce work until the
    edge set is a forest of stars. Each step is a partial minimum per vertex joined back.
    """
    ids = vertices(edges) if ids is None else ids.select("id").distinct()
    current = settle(edges.select("src", "dst").where(F.col("src") != F.col("dst")).distinct())
    mark = None
    while True:
        wide = both_ways(current)
        low = settle(wide.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("_m"), F.count(F.lit(1)).alias("_n")))
        large = salted_join(wide, low.drop("_n"), ["src"], counts=low).where(F.col("dst") > F.col("src")).select(
            F.col("dst").alias("src"), F.col("_m").alias("dst")
        ).distinct()
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst")
        down = settle(down)
        low = settle(down.groupBy("src").agg(F.min("dst").alias("_m"), F.count(F.lit(1)).alias("_n")))
        moved = salted_join(down, low.drop("_n"), ["src"], counts=low).where(F.col("dst") != F.col("_m")).select(
            F.col("dst").alias("src"), F.col("_m").alias("dst")
        )
        small = moved.unionByName(low.select("src", F.col("_m").alias("dst"))).where("src <> dst").distinct()
        before, current = current, settle(small)
        release(before, down, low)
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("src", "dst"))).first()
        if tuple(state) == mark:
            break
        mark = tuple(state)
    roots = current.groupBy(F.col("src").alias("id")).agg(F.min("dst").alias("component"))
    return ids.join(roots, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _contract_chains(left: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """Edges without their chain vertices, the chains (id, start, end), and pure cycles (id, component).

    A chain vertex has one edge in and one out. Pointers to both ends double their reach in every round, so a chain
    of any length takes a logarithmic number of them. None where there is no chain.
    """
    into = left.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("_in"), F.min("src").alias("prev"))
    out = left.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("_out"), F.min("dst").alias("next"))
    chain = settle(into.where("_in = 1").join(out.where("_out = 1"), "id").select("id", "prev", "next"))
    total = chain.count()
    if not total:
        return None
    # ``top`` is the largest id met on the way forward, which names a cycle of chain vertices only
    walk = chain.withColumn("top", F.greatest("id", "next"))
    before, reach = None, 1
    while reach <= total:
        ahead = walk.select(F.col("id").alias("next"), F.col("next").alias("_n"), F.col("top").alias("_t"))
        behind = walk.select(F.col("id").alias("prev"), F.col("prev").alias("_p"))
        step = settle(walk.join(ahead, "next", "left").join(behind, "prev", "left").select(
            "id", F.coalesce("_p", "prev").alias("prev"), F.coalesce("_n", "next").alias("next"),
            F.greatest("top", "_t").alias("top"), (F.col("_n").isNotNull() | F.col("_p").isNotNull()).alias("_moved"),
        ))
        release(before)
        walk, before, reach = step.drop("_moved"), step, 2 * reach
        if step.where("_moved").isEmpty():
            break
    inside = chain.select(F.col("id").alias("next"))
    cycles = settle(salted_join(walk, inside, ["next"], "left_semi").select("id", F.col("top").alias("component")))
    open_ = settle(salted_join(walk, inside, ["next"], "left_anti").select("id", F.col("prev").alias("start"), F.col("next").alias("end")))
    names = chain.select("id")
    kept = salted_join(left, names.withColumnRenamed("id", "src"), ["src"], "left_anti")
    kept = salted_join(kept, names.withColumnRenamed("id", "dst"), ["dst"], "left_anti").select("src", "dst")
    bridged = open_.select(F.col("start").alias("src"), F.col("end").alias("dst"))
    return settle(kept.unionByName(bridged).where("src <> dst").distinct()), open_, cycles


def strong_components(edges: DataFrame) -> DataFrame:
    """Strong components: (id, component), the component being its largest id.

    Chains are contracted by pointer jumping, and vertices without links in or out removed, until neither is
    left: long paths and trees take a logarithmic number of rounds. The rest is coloured with the largest id that
    reaches a vertex, which searches forward from all vertices at once, and each colour's own vertex takes what
    reaches back to it. A chain belongs to the component of its ends if that is the same for both.
    """
    left = settle(edges.select("src", "dst").where("src <> dst").distinct())
    alive = settle(vertices(edges))
    done, chains = None, []

    def finish(part):
        nonlocal done
        done = part if done is None else done.unionByName(part)

    while not alive.isEmpty():
        while True:
            contracted = _contract_chains(left)
            if contracted is not None:
                left, open_, cycles = contracted
                chains.append(open_)
                finish(cycles)
                gone = open_.select("id").unionByName(cycles.select("id"))
                alive = settle(alive.join(gone, "id", "left_anti"))
            inner = salted_join(
                salted_join(alive, left.select(F.col("src").alias("id")).distinct(), ["id"], "left_semi"),
                left.select(F.col("dst").alias("id")).distinct(), ["id"], "left_semi",
            )
            inner = settle(inner)
            single = settle(alive.join(inner, "id", "left_anti").select("id", F.col("id").alias("component")))
            if single.isEmpty():
                if contracted is None:
                    break
                continue
            finish(single)
            alive = inner
            left = settle(induced(left, alive))
        if alive.isEmpty():
            break
        colour = alive.withColumn("colour", F.col("id"))
        along = Salted(left, ["src"])
        before = None
        while True:
            sent = along.join(colour.withColumnRenamed("id", "src")).groupBy(
                F.col("dst").alias("id")
            ).agg(F.max("colour").alias("_c"))
            step = settle(
                colour.join(sent, "id", "left").select("id", F.greatest("colour", "_c").alias("colour"), F.col("colour").alias("_old"))
            )
            release(before)
            colour, before = step.select("id", "colour"), step
            if step.where("colour <> _old").isEmpty():
                break
        same = along.join(colour.select(F.col("id").alias("src"), F.col("colour").alias("_a")))
        same = salted_join(same, colour.select(F.col("id").alias("dst"), F.col("colour").alias("_b")), ["dst"])
        back = settle(same.where("_a = _b").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        reached = colour.where("id = colour").select("id", F.col("id").alias("component"))
        reached = settle(reached)
        front = reached
        against = Salted(back, ["src"])
        while True:
            found = against.join(front.withColumnRenamed("id", "src")).select(
                F.col("dst").alias("id"), "component"
            ).distinct()
            front = settle(found.join(reached, "id", "left_anti"))
            if front.isEmpty():
                break
            reached = settle(reached.unionByName(front))
        finish(reached)
        alive = settle(alive.join(reached, "id", "left_anti"))
        left = settle(induced(left, alive))
    if done is None:
        return alive.select("id", F.col("id").alias("component"))
    for open_ in reversed(chains):  # a later contraction may hold the ends of an earlier one
        done = settle(done)
        at = lambda end, name: done.select(F.col("id").alias(end), F.col("component").alias(name))
        named = salted_join(salted_join(open_, at("start", "_s"), ["start"]), at("end", "_e"), ["end"])
        whole = F.when(F.col("_s") == F.col("_e"), F.col("_s")).otherwise(F.col("id"))
        done = done.unionByName(named.select("id", whole.alias("component")))
    if chains:
        done = settle(done)
        largest = settle(done.groupBy("component").agg(F.max("id").alias("_top"), F.count(F.lit(1)).alias("_n")))
        done = salted_join(done, largest.drop("_n"), ["component"], counts=largest.drop("_top")).select("id", F.col("_top").alias("component"))
    return done


def component_sizes(parts: DataFrame) -> DataFrame:
    return parts.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def largest_component(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges of the component with most vertices; ties go to the smaller name."""
    best = component_sizes(parts).orderBy(F.desc("size"), "component").limit(1)
    return induced(edges, parts.join(F.broadcast(best.select("component")), "component", "left_semi"))


def without_small(edges: DataFrame, parts: DataFrame, more_than: int) -> DataFrame:
    """Edges of the components with more than ``more_than`` vertices."""
    kept = component_sizes(parts).where(F.col("size") > more_than)
    return induced(edges, salted_join(parts, kept.select("component"), ["component"], "left_semi"))


# -- distances ---------------------------------------------------------------------------


SET = 63  # sources in a set, a bit each


def distances(edges: DataFrame, sources: DataFrame | None = None, max_hops: int | None = None) -> DataFrame:
    """Hop distances (src, dst, d) from the sources, all vertices by default.

    Sources go in sets of ``SET``; a level is a row (set, vertex, bits of the sources that reach it there), so an edge is met once
    for a set and not once for every source. In an undirected graph the neighbours of one level lie in that level or next
    to it, so each round is checked against two levels only.
    """
    along = Salted(settle(both_ways(edges).distinct()), ["src"])
    sources = (vertices(edges) if sources is None else sources.select("id")).distinct()
    named = settle(
        running(sources, [], ["id"], position="_n").select("id", F.floor((F.col("_n") - 1) / SET).alias("_set"), ((F.col("_n") - 1) % SET).cast("int").alias("_bit"))
    )
    last = settle(named.select("_set", F.col("id").alias("dst"), F.expr("shiftleft(1L, _bit)").alias("_in"), F.lit(0).alias("d")))
    levels, before, hop = [last], None, 0
    while max_hops is None or hop < max_hops:
        hop += 1
        found = along.join(last.select("_set", F.col("dst").alias("src"), "_in")).groupBy("_set", "dst").agg(F.bit_or("_in").alias("_in"))
        seen = last.select("_set", "dst", "_in")
        if before is not None:
            seen = seen.unionByName(before.select("_set", "dst", "_in")).groupBy("_set", "dst").agg(F.bit_or("_in").alias("_in"))
        fresh = F.col("_in").bitwiseAND(F.bitwise_not(F.coalesce("_seen", F.lit(0).cast("long"))))
        level = settle(
            found.join(seen.withColumnRenamed("_in", "_seen"), ["_set", "dst"], "left")
            .select("_set", "dst", fresh.alias("_in"), F.lit(hop).alias("d")).where("_in <> 0")
        )
        if level.isEmpty():
            break
        levels.append(level)
        before, last = last, level
    whole = reduce(DataFrame.unionByName, levels)
    bits = F.filter(F.sequence(F.lit(0), F.lit(SET - 1)), lambda b: F.call_function("getbit", F.col("_in"), b) == 1)
    each = whole.select("_set", F.explode(bits).alias("_bit"), "dst", "d")
    return salted_join(each, named, ["_set", "_bit"]).select(F.col("id").alias("src"), "dst", "d")


def eccentricities(dist: DataFrame) -> DataFrame:
    return dist.groupBy(F.col("src").alias("id")).agg(F.max("d").alias("eccentricity"))


def diameter(dist: DataFrame) -> DataFrame:
    return dist.agg(F.max("d").alias("diameter"))


def crawl(
    page_links: DataFrame,
    starts: DataFrame,
    depth: int,
    include_external: bool = False,
    pattern: str | None = None,
    include_images: bool = False,
) -> DataFrame:
    """Breadth-first frontier over an existing link table: (start, url, depth).

    Only addresses on the start's host are followed unless external ones are allowed; an
    include pattern and the image rule narrow the links.
    """
    allowed = page_links
    if pattern is not None:
        allowed = allowed.where(F.col("dst").rlike(pattern))
    if not include_images:
        allowed = allowed.where(~F.col("dst").rlike(links.IMAGE_PATTERN))
    along = Salted(settle(allowed.select(F.col("src").alias("url"), F.col("dst").alias("_to")).distinct()), ["url"])
    seen = settle(starts.select(F.col("url").alias("start"), "url", F.lit(0).alias("depth")))
    front = seen
    for hop in range(1, depth + 1):
        found = along.join(front.select("start", "url")).select("start", F.col("_to").alias("url"))
        if not include_external:
            found = found.where(links.url_host(F.col("url")) == links.url_host(F.col("start")))
        front = settle(
            found.distinct().join(seen, ["start", "url"], "left_anti").withColumn("depth", F.lit(hop))
        )
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


# -- biconnected components --------------------------------------------------------------


def spanning_forest(edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tree edges (u, v) of every component and (id, root), for edges (src, dst) between numbered vertices.

    Every round hooks each root onto its smallest neighbouring label by an edge, which joins the forest, and halves the
    way to the root for all. Labels only fall, so no cycle can close. Numbers dealt at random keep the
    rounds logarithmic.
    """
    links_ = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("src").alias("u"), F.col("dst").alias("v"))
    links_ = settle(links_.where("a <> b"))
    up = settle(ids.select("id", F.col("id").alias("p")))
    forest = []
    while not links_.isEmpty():
        lowest = links_.groupBy(F.greatest("a", "b").alias("id")).agg(F.min(F.struct(F.least("a", "b").alias("to"), "u", "v")).alias("_m"))
        hooks = settle(lowest.join(up.where("id = p").select("id"), "id", "left_semi").select("id", "_m.to", "_m.u", "_m.v"))
        forest.append(hooks.select("u", "v"))
        hooked = settle(up.join(hooks.select("id", "to"), "id", "left").select("id", F.coalesce("to", "p").alias("p")))
        older, up = up, _halved(hooked)
        moved = links_
        for end in ("a", "b"):
            moved = salted_join(moved, up.select(F.col("id").alias(end), F.col("p").alias(f"_{end}")), [end])
        ends = [F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")]
        fresh = settle(moved.where("_a <> _b").groupBy(*ends).agg(F.min(F.struct("u", "v")).alias("_m")).select("a", "b", "_m.u", "_m.v"))
        release(links_, hooked, older)
        links_ = fresh
    while True:
        older, up = up, _halved(up)
        same = up.join(older.withColumnRenamed("p", "_old"), "id").where("p <> _old").isEmpty()
        release(older)
        if same:
            break
    tree = forest[0] if forest else edges.select(F.col("src").alias("u"), F.col("dst").alias("v")).limit(0)
    for part in forest[1:]:
        tree = tree.unionByName(part)
    return settle(tree.distinct()), up.select("id", F.col("p").alias("root"))


def _halved(up: DataFrame) -> DataFrame:
    """Every pointer (id, p) moved on to the pointer of where it points."""
    return settle(salted_join(up, up.select(F.col("id").alias("p"), F.col("p").alias("_q")), ["p"]).select("id", F.col("_q").alias("p")))


def list_ranks(items: DataFrame, jumps: int = 2) -> DataFrame:
    """(item, rank): steps to the end of its list for (item, next), a null ``next`` being the end.

    Pointer jumping: each round every item skips as far as it has come, ``jumps`` times over.
    """
    walk = settle(items.select("item", "next", F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("rank")))
    while not walk.where("next IS NOT NULL").isEmpty():
        step = walk
        for _ in range(jumps):
            far = step.select(F.col("item").alias("next"), F.col("next").alias("_n"), F.col("rank").alias("_r"))
            moved = step.where("next IS NOT NULL").join(far, "next").select(
                "item", F.col("_n").alias("next"), (F.col("rank") + F.col("_r")).alias("rank")
            )
            step = step.where("next IS NULL").unionByName(moved)
        older, walk = walk, settle(step)
        release(older)
    return walk.select("item", "rank")


def preorder(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, parent, pre, size) of rooted trees from their edges (u, v) and (id, root).

    The Euler tour of each tree is a list of arcs: after u -> v comes the arc of v that follows v -> u around v. The places of
    an edge's two arcs on the tour tell which end is the parent and how large the subtree is.
    Numbers run over all trees, each subtree having consecutive ones.
    """
    around = tree.select(F.col("u").alias("src"), F.col("v").alias("dst"))
    arcs = settle(running(both_ways(around), [], ["src", "dst"], position="item"))
    ends = settle(arcs.groupBy("src").agg(F.min("item").alias("first"), F.max("item").alias("last")))
    back = arcs.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("item").alias("back"))
    placed = arcs.join(back, ["src", "dst"])
    placed = salted_join(placed, ends.withColumnRenamed("src", "dst"), ["dst"])
    turn = F.when(F.col("back") < F.col("last"), F.col("back") + 1).otherwise(F.col("first"))
    at_root = salted_join(placed, roots.select(F.col("id").alias("dst"), "root"), ["dst"])
    over = (F.col("dst") == F.col("root")) & (F.col("back") == F.col("last"))
    tour = settle(at_root.select("item", "back", "src", "dst", "root", F.when(~over, turn).alias("next")))
    ranks = settle(list_ranks(tour.select("item", "next")))
    ranked = tour.join(ranks, "item").join(ranks.select(F.col("item").alias("back"), F.col("rank").alias("_back")), "back")
    down = settle(ranked.where(F.col("rank") > F.col("_back")).select(
        F.col("dst").alias("id"), F.col("src").alias("parent"), "root", (-F.col("rank")).alias("place"),
        ((F.col("rank") - F.col("_back") + 1) / 2).cast("long").alias("size"),
    ))
    sizes = down.groupBy("root").agg((F.count(F.lit(1)) + 1).alias("size"))
    tops = sizes.select(F.col("root").alias("id"), F.lit(None).cast("long").alias("parent"), "root", F.lit(None).cast("long").alias("place"), "size")
    numbered = running(down.unionByName(tops), [], ["root", F.col("place").asc_nulls_first()], position="pre")
    return numbered.select("id", "parent", "pre", "size")


def subtree_ranges(numbers: DataFrame, values: DataFrame) -> DataFrame:
    """(id, low, high): the extremes of ``values`` (pre, low, high) over every subtree's numbers.

    A subtree is a range of numbers, cut into aligned blocks of powers of two; the extremes of the blocks
    are one aggregate, and no more than two blocks of a size belong to a range.
    """
    levels = max(1, int(values.agg(F.max("pre")).first()[0] or 1).bit_length())
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    blocks = values.select("*", level).groupBy("level", F.expr("shiftright(pre, level)").alias("block")).agg(
        F.min("low").alias("low"), F.max("high").alias("high")
    )
    first, behind = F.expr("shiftright(pre + shiftleft(1L, level) - 1, level)"), F.expr("shiftright(pre + size, level)")
    pieces = numbers.select("id", "pre", "size", level).select("id", "level", first.alias("a"), behind.alias("b")).where("a < b")
    pieces = pieces.select("id", "level", F.explode(F.array_compact(F.array(
        F.when(F.col("a") % 2 == 1, F.col("a")), F.when(F.col("b") % 2 == 1, F.col("b") - 1)
    ))).alias("block"))
    met = salted_join(pieces, settle(blocks), ["level", "block"])
    return met.groupBy("id").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def biconnected(edges: DataFrame) -> DataFrame:
    """Biconnected components of a simple undirected graph: (src, dst, block) per edge.

    The published parallel method: a spanning forest by hooking, its Euler tour ranked by pointer jumping for preorder
    numbers and subtree sizes, the range of numbers reached from every subtree, then components of a
    graph whose vertices are the tree edges. All rounds are logarithmic in the number of vertices, whatever
    the depth of the forest; no vertex set is gathered in one task. A block is named by a vertex number.
    """
    edges = settle(undirected(edges))
    names = settle(running(vertices(edges), [], [F.xxhash64("id"), F.col("id")], position="n"))
    numbered = edges
    for end, n in (("src", "a"), ("dst", "b")):
        numbered = salted_join(numbered, names.select(F.col("id").alias(end), F.col("n").alias(n)), [end])
    numbered = settle(numbered.select("src", "dst", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    plain = numbered.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    tree, roots = spanning_forest(plain, names.select(F.col("n").alias("id")))
    order = settle(preorder(tree, roots))

    placed = numbered
    for end in "ab":
        at = order.select(F.col("id").alias(end), F.col("pre").alias(f"pre_{end}"), F.col("size").alias(f"size_{end}"), F.col("parent").alias(f"parent_{end}"))
        placed = salted_join(placed, at, [end])
    placed = settle(placed)
    met = placed.select(F.col("pre_a").alias("pre"), F.col("pre_b").alias("to")).unionByName(
        placed.select(F.col("pre_b").alias("pre"), F.col("pre_a").alias("to"))
    ).unionByName(order.select("pre", F.col("pre").alias("to")))
    reached = settle(subtree_ranges(order, met.groupBy("pre").agg(F.min("to").alias("low"), F.max("to").alias("high"))))

    is_tree = F.coalesce(F.col("parent_a") == F.col("b"), F.lit(False)) | F.coalesce(F.col("parent_b") == F.col("a"), F.lit(False))
    apart = (F.col("pre_a") + F.col("size_a") <= F.col("pre_b")) | (F.col("pre_b") + F.col("size_b") <= F.col("pre_a"))
    cross = placed.where(~is_tree & apart).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    above = order.where("parent IS NOT NULL").select(F.col("id").alias("parent"), F.col("pre").alias("_pre"), F.col("size").alias("_size"))
    climbing = salted_join(order.where("parent IS NOT NULL").select("id", "parent").join(reached, "id"), above, ["parent"]).where(
        (F.col("low") < F.col("_pre")) | (F.col("high") >= F.col("_pre") + F.col("_size"))
    ).select(F.col("id").alias("src"), F.col("parent").alias("dst"))
    blocks = components(settle(cross.unionByName(climbing)), order.where("parent IS NOT NULL").select("id"))
    # an edge lies in the block of its end with the larger number, the lower end of a tree or back edge
    below = F.when(F.col("pre_a") > F.col("pre_b"), F.col("a")).otherwise(F.col("b"))
    return salted_join(placed.select("src", "dst", below.alias("id")), blocks.select("id", F.col("component").alias("block")), ["id"]).select("src", "dst", "block")


def block_sizes(blocks: DataFrame) -> DataFrame:
    """Number of vertices and edges per biconnected component."""
    ends = blocks.select("block", F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.groupBy("block").agg(F.count(F.lit(1)).alias("size")).join(
        blocks.groupBy("block").agg(F.count(F.lit(1)).alias("edges")), "block"
    )


def largest_block(blocks: DataFrame) -> DataFrame:
    best = block_sizes(blocks).orderBy(F.desc("size"), "block").limit(1).select("block")
    return blocks.join(F.broadcast(best), "block", "left_semi").select("src", "dst")


# -- hyperbolicity -----------------------------------------------------------------------


def _two_of_twins(near: DataFrame) -> DataFrame:
    """(id): at most two vertices of every class of twins, from the neighbours (src, dst) both ways and each once."""
    near = near.groupBy(F.col("src").alias("id")).agg(
        *[F.sum(F.conv(F.substring(F.md5(F.col("dst").cast("string")), i, 15), 16, 10).cast("decimal(38,0)")).alias(n) for i, n in ((1, "_a"), (16, "_b"))]
    )
    own = [F.conv(F.substring(F.md5(F.col("id").cast("string")), i, 15), 16, 10).cast("decimal(38,0)") for i in (1, 16)]
    kept = settle(near.select("id", "_a", "_b", (F.col("_a") + own[0]).alias("_c"), (F.col("_b") + own[1]).alias("_d")))
    for keys in (["_a", "_b"], ["_c", "_d"]):
        two = kept.groupBy(*keys).agg(F.min("id").alias("_one"), F.count(F.lit(1)).alias("_n"))
        rest = kept.join(two.select(F.col("_one").alias("id")), "id", "left_anti").groupBy(*keys).agg(F.min("id").alias("_one"))
        chosen = two.select(F.col("_one").alias("id")).unionByName(rest.select(F.col("_one").alias("id")))
        kept = settle(kept.join(chosen, "id", "left_semi"))
    return kept.select("id")


def without_twins(dist: DataFrame) -> DataFrame:
    """The distances among at most two vertices of every class of twins.

    Twins have the same neighbours, or the same with themselves; to all others they are equally far. Of a quadruple
    with three twins two pair sums are the largest and equal, so two of a class give every gap there is.
    """
    near = dist.where("d = 1")
    ids = _two_of_twins(near).unionByName(vertices(dist).join(near.select(F.col("src").alias("id")), "id", "left_anti"))
    return induced(dist, settle(ids)).select("src", "dst", "d")


def without_twin_vertices(edges: DataFrame) -> DataFrame:
    """The undirected edges among at most two vertices of every class of twins.

    A way through a twin left out goes as well through one that stays, and two twins are as far apart as any two of
    their class: the distances that are left are unchanged, their largest is the graph's, and so is its delta.
    """
    simple = settle(undirected(edges))
    return induced(simple, settle(_two_of_twins(both_ways(simple))))


TILE = 512


def hyperbolicity(dist: DataFrame, tile: int = TILE) -> DataFrame:
    """Four-point delta of a complete table of hop distances: half the largest gap between the two largest pair sums
    over all quadruples.

    Two pairs (a, b) and (c, d) give d(a,b) + d(c,d) - max(d(a,c) + d(b,d), d(a,d) + d(b,c)), which is at most the
    smaller of their distances. So pairs are taken from the far ones down, level by level, and the search ends
    once a level cannot beat the best. The distances are stored once, in square tiles; a task meets the pairs of
    two tiles by the four tiles between their rows and columns, and returns one number. Twins beyond two are left out first.
    """
    import numpy as np
    import pandas as pd

    small = settle(without_twins(dist))
    names = running(small.select(F.col("src").alias("id")).distinct(), [], ["id"], position="n")
    names = settle(names.select("id", (F.col("n") - 1).cast("int").alias("n")))
    numbered = salted_join(
        salted_join(small, names.select(F.col("id").alias("src"), F.col("n").alias("a")), ["src"]),
        names.select(F.col("id").alias("dst"), F.col("n").alias("b")), ["dst"],
    ).select(F.expr(f"a div {tile}").cast("int").alias("x"), F.expr(f"b div {tile}").cast("int").alias("y"),
             F.expr(f"a % {tile}").alias("a"), F.expr(f"b % {tile}").alias("b"), F.col("d").cast("int").alias("d"))

    def pack(key, frame):
        cells = np.zeros((tile, tile), np.int16)
        cells[frame["a"].to_numpy(), frame["b"].to_numpy()] = frame["d"].to_numpy()
        return pd.DataFrame({"x": [key[0]], "y": [key[1]], "cells": [cells.tobytes()], "most": [int(cells.max())]})

    tiles = settle(numbered.groupBy("x", "y").applyInPandas(pack, "x int, y int, cells binary, most int"))
    roles = {"ab": ("i", "j"), "cd": ("k", "l"), "ac": ("i", "k"), "bd": ("j", "l"), "ad": ("i", "l"), "bc": ("j", "k")}
    upper = tiles.where("x <= y")

    def best(level):
        def meet(key, frame):
            at = {r: np.frombuffer(c, np.int16).reshape(tile, tile) for r, c in zip(frame["role"], frame["cells"])}
            a, b = np.nonzero(np.triu(at["ab"], 1) == level if key[0] == key[1] else at["ab"] == level)
            c, d = np.nonzero(np.triu(at["cd"], 1) >= level if key[2] == key[3] else at["cd"] >= level)
            far, top, step = at["cd"][c, d], 0, max(1, 4_000_000 // max(len(c), 1))
            for lo in range(0, len(a) if len(c) else 0, step):
                p, q = a[lo : lo + step, None], b[lo : lo + step, None]
                side = np.maximum(at["ac"][p, c] + at["bd"][q, d], at["ad"][p, d] + at["bc"][q, c])
                top = max(top, int((level + far[None, :] - side).max()))
            return pd.DataFrame({"gap": [top]})

        open_ = upper.where(F.col("most") >= level)
        one = open_.select(F.col("x").alias("i"), F.col("y").alias("j"))
        # every pair of tiles that hold pairs so far apart; a level's own pairs stand on the first side
        spots = one.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(grid - 1)))).withColumn("l", F.explode(F.sequence(F.col("k"), F.lit(grid - 1))))
        spots = settle(spots.join(open_.select(F.col("x").alias("k"), F.col("y").alias("l")), ["k", "l"], "left_semi"))
        parts = [
            spots.join(tiles.select(F.col("x").alias(m), F.col("y").alias(n), "cells"), [m, n]).select("i", "j", "k", "l", F.lit(role).alias("role"), "cells")
            for role, (m, n) in roles.items()
        ]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole.groupBy("i", "j", "k", "l").applyInPandas(meet, "gap int").agg(F.max("gap")).first()[0] or 0

    found, spent = 0, 0
    state = tiles.agg(F.max("most"), F.max("x")).first()
    widest, grid = state[0] or 0, (state[1] or 0) + 1
    for level in range(widest, 0, -1):
        if level <= found:
            break
        found = max(found, best(level))
        spent += 1
    return dist.agg(
        F.lit(found / 2).alias("delta"), F.lit(float(spent)).alias("levels"), F.max("d").alias("diameter"),
        F.countDistinct("src").alias("n"),
    )


def sampled_hyperbolicity(edges: DataFrame, samples: int, pool: int, seed: int = 42) -> DataFrame:
    """Half the largest gap over random quadruples of ``pool`` drawn vertices, as a lower bound with its
    sample size.

    The pool is drawn first and only its vertices are walked from, so the distances grow with pool times
    vertices, never with their square. Draws are digests, so a re-run task draws the same.
    """
    ids = settle(vertices(edges))
    order = F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))).alias("draw"), "id")
    names = settle(running(ids.orderBy(order).limit(pool), [], ["id"], position="n"))
    n = names.count()
    dist = settle(distances(edges, names).join(fit_broadcast(names.select(F.col("id").alias("dst"))), "dst", "left_semi"))
    spark = edges.sparkSession

    def pick(i):
        digest = F.md5(F.concat_ws(":", F.col("q").cast("string"), F.lit(str(seed)), F.lit(str(i))))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n + 1

    rows = spark.range(samples).withColumnRenamed("id", "q").select("q", *[pick(i).alias(f"n{i}") for i in range(4)])
    rows = rows.where("n0 <> n1 and n0 <> n2 and n0 <> n3 and n1 <> n2 and n1 <> n3 and n2 <> n3")
    for i in range(4):
        rows = rows.join(fit_broadcast(names.select(F.col("id").alias(f"v{i}"), F.col("n").alias(f"n{i}"))), f"n{i}")
    ends = {(i, j): f"d{i}{j}" for i in range(4) for j in range(i + 1, 4)}
    for (i, j), name in ends.items():
        leg = dist.select(F.col("src").alias(f"v{i}"), F.col("dst").alias(f"v{j}"), F.col("d").alias(name))
        rows = rows.join(leg, [f"v{i}", f"v{j}"])
    sums = F.array_sort(F.array(F.col("d01") + F.col("d23"), F.col("d02") + F.col("d13"), F.col("d03") + F.col("d12")))
    return rows.agg(
        (F.max(sums[2] - sums[1]) / 2).alias("delta"), F.count(F.lit(1)).alias("quadruples")
    )


def normalised_delta(delta: DataFrame) -> DataFrame:
    """2 delta / diameter and delta / log2 n."""
    return delta.select(
        "delta",
        (2 * F.col("delta") / F.col("diameter")).alias("by_diameter"),
        (F.col("delta") / F.log2(F.col("n").cast("double"))).alias("by_size"),
    )


# -- sampling and embeddings -------------------------------------------------------------


SORTED_ROWS = 2_000_000  # rows of a sorted part, which a task holds


def _drawn(seed: int, name: str, kind: str, draw: int) -> int:
    return int.from_bytes(hashlib.md5(f"{seed}:{name}:{kind}:{draw}".encode()).digest()[:6], "big")


def _part_of(batches) -> tuple[int, np.ndarray, np.ndarray, list[str]] | None:
    """Of a sorted part its number, the different (x, z) and the names of its vertices, which stand in the rows of odd z."""
    part, xs, zs, names, last = 0, [], [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        part, x, z = batch["part"][0].as_py(), *(batch[c].to_numpy().astype(np.int64) for c in ("x", "z"))
        new = np.concatenate([[last != (x[0], z[0])], (np.diff(x) != 0) | (np.diff(z) != 0)])
        last = x[-1], z[-1]
        xs.append(x[new])
        zs.append(z[new])
        names += batch["id"].filter(pa.array(new & (z % 2 == 1))).to_pylist()
    return (part, np.concatenate(xs), np.concatenate(zs), names) if xs else None


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], np.diff(x) != 0]))
    return starts, np.diff(np.append(starts, len(x)))


def sample_neighbours(edges: DataFrame, n_positive: int, n_negative: int, seed: int = 42, places: bool = False) -> DataFrame:
    """(anchor, other, draw, positive): neighbours drawn with replacement, and as many random vertices
    that are neither neighbours nor the vertex itself.

    A draw is a rank from the MD5 of its name. A negative rank counts the vertices that may be drawn
    and is moved past the places of those that may not, so every draw gives a vertex; a vertex that
    is linked to all others has no negatives. Ids are text. With ``places`` the rows are (anchor, at, place, draw, positive): the
    numbers, from 0 on by id, of the anchor and of the other vertex.

    The edges are turned into pairs of places and sorted once, a vertex's own place among its neighbours'. A task draws for the vertices
    that are whole in its part; those on a border of parts are added up first, so one may have any number of neighbours.
    """
    kind = dict(edges.dtypes)["src"]
    ids = settle(running(vertices(edges), [], ["id"], position="k").withColumn("k", F.col("k") - 1))
    total = ids.count()
    coded = edges.select("src", "dst")
    for name in ("src", "dst"):
        held = edges.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
        coded = salted_join(coded, ids.select(F.col("id").alias(name), F.col("k").alias(f"_{name}")), [name], counts=held).drop(name)
    number = "int" if 2 * total < 2**31 else "long"
    row = lambda x, z, name: [x.cast(number).alias("x"), z.cast(number).alias("z"), name.alias("id")]
    one, other, nobody = F.col("_src"), F.col("_dst"), F.lit(None).cast("string")
    rows = coded.select(*row(one, 2 * other, nobody)).unionByName(coded.select(*row(other, 2 * one, nobody)))
    rows = rows.unionByName(ids.where("id is not null").select(*row(F.col("k"), 2 * F.col("k") + 1, F.col("id").cast("string"))))
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((2 * edges.count() + total) / SORTED_ROWS))
    laid = on_disk(rows.repartitionByRange(parts, "x", "z").sortWithinPartitions("x", "z").withColumn("part", F.spark_partition_id()))

    def ends(batches):
        held = _part_of(batches)
        if held:
            part, x, z, names = held
            starts, sizes = _groups(x)
            for g in sorted({0, len(starts) - 1}):
                mine = slice(starts[g], starts[g] + sizes[g])
                own = z[mine] % 2 == 1
                name = names[int((z[: starts[g]] % 2).sum())] if own.any() else None
                yield pa.RecordBatch.from_pydict({"part": [part], "x": [int(x[starts[g]])], "near": [int((~own).sum())], "barred": [int(sizes[g])], "id": [name]}, ends_schema)

    ends_schema = pa.schema([("part", pa.int32()), ("x", pa.int64()), ("near", pa.int64()), ("barred", pa.int64()), ("id", pa.string())])
    pieces: dict[int, list] = {}
    for r in laid.mapInArrow(ends, "part int, x long, near long, barred long, id string").orderBy("part").collect():  # two rows a part
        pieces.setdefault(r["x"], []).append(r)
    crossing = {}
    for x, held in pieces.items():
        if len(held) > 1:
            near, name = sum(r["near"] for r in held), next((r["id"] for r in held if r["id"] is not None), None)
            size = total - near - 1
            ranks = [_drawn(seed, name, "negative", d) % size for d in range(1, n_negative + 1)] if size > 0 else []
            crossing[x] = {"near": near, "id": name, "ranks": ranks, "past": [0] * len(ranks), "first": held[0]["part"], "before": {
                r["part"]: (sum(e["near"] for e in held[:i]), sum(e["barred"] for e in held[:i])) for i, r in enumerate(held)
            }}

    def passed(batches):
        held = _part_of(batches)
        if held:
            part, x, z, _ = held
            for start, size in zip(*_groups(x)):
                at = crossing[int(x[start])]
                free = z[start : start + size] // 2 - at["before"][part][1] - np.arange(size)
                past = [int(np.count_nonzero(free <= r)) for r in at["ranks"]]
                n = len(past)
                yield pa.RecordBatch.from_pydict({"x": pa.array([int(x[start])] * n, pa.int64()), "draw": pa.array(range(n), pa.int32()), "past": pa.array(past, pa.int64())})

    if crossing:
        found = laid.where(F.col("x").isin(list(crossing))).mapInArrow(passed, "x long, draw int, past long")
        for r in found.groupBy("x", "draw").agg(F.sum("past").alias("past")).collect():  # the vertices on borders only
            crossing[r["x"]]["past"][r["draw"]] = r["past"]

    def drawn(batches):
        held = _part_of(batches)
        if not held:
            return
        part, x, z, listed = held
        starts, sizes = _groups(x)
        y, own = z // 2, z % 2 == 1
        named = iter(listed)
        has = np.add.reduceat(own, starts) > 0
        group_x = x[starts]
        names = [next(named) if h else None for h in has]
        near = sizes - has
        met = [(g, crossing[int(group_x[g])]) for g in sorted({0, len(starts) - 1}) if int(group_x[g]) in crossing]
        degree, before = near.copy(), np.zeros((len(starts), 2), np.int64)
        for g, c in met:
            names[g], degree[g], before[g] = c["id"], c["near"], c["before"][part]
        group = np.repeat(np.arange(len(starts)), sizes)
        neighbours, first = y[~own], np.concatenate([[0], np.cumsum(near)[:-1]])
        free = y - before[group, 1] - (np.arange(len(x)) - starts[group])
        span = 2 * total + 2
        keys = group * span + free + 1
        if (np.diff(keys) < 0).any():  # a vertex linked to itself is barred twice
            keys = np.sort(keys)
        whole = np.ones(len(starts), bool)
        whole[[g for g, _ in met]] = False
        out = []

        def add(g, places, draw, positive):
            out.append((g, places, np.full(len(g), draw), np.full(len(g), positive)))

        known = np.flatnonzero([n is not None for n in names])
        for d in range(1, n_positive + 1):
            g = known[degree[known] > 0]
            at = np.array([_drawn(seed, names[i], "positive", d) for i in g], np.int64) % degree[g] - before[g, 0]
            here = (at >= 0) & (at < near[g])
            add(g[here], neighbours[(first[g] + at)[here]], d, 1)
        for d in range(1, n_negative + 1):
            g = known[whole[known] & (total - degree[known] - 1 > 0)]
            rank = np.array([_drawn(seed, names[i], "negative", d) for i in g], np.int64) % (total - degree[g] - 1)
            add(g, rank + np.searchsorted(keys, g * span + rank + 1, side="right") - starts[g], d, 0)
            mine = [(i, c["ranks"][d - 1] + c["past"][d - 1]) for i, c in met if c["first"] == part and c["ranks"]]
            add(np.array([i for i, _ in mine], np.int64), np.array([p for _, p in mine], np.int64), d, 0)
        g, place, draw, positive = (np.concatenate(c) for c in zip(*out))
        table = pa.table({
            "anchor": pa.array(names, pa.string()).take(pa.array(g)), "at": pa.array(group_x[g]), "place": pa.array(place),
            "draw": pa.array(draw, pa.int32()), "positive": pa.array(positive, pa.int32()),
        })
        yield from table.to_batches(100_000)

    found = laid.mapInArrow(drawn, "anchor string, at long, place long, draw int, positive int").withColumn("anchor", F.col("anchor").cast(kind))
    if places:
        return found
    named = ids.select(F.col("id").alias("other"), F.col("k").alias("place"))
    return salted_join(found, named, ["place"]).select("anchor", "other", "draw", "positive")


def non_neighbours(edges: DataFrame, chosen: DataFrame, block_rows: int = 100_000) -> DataFrame:
    """(id, other) for the chosen vertices: all vertices that are neither neighbours nor itself.

    The vertices are dealt into blocks and the chosen ones are sent to every block.
    """
    wide = both_ways(edges).select(F.col("src").alias("id"), F.col("dst").alias("other")).distinct()
    every = settle(vertices(edges).withColumnRenamed("id", "other"))
    blocks = block_count(every, block_rows)
    dealt = every.withColumn("_block", F.pmod(F.xxhash64("other"), F.lit(blocks)))
    sent = chosen.select("id").withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
    pairs = dealt.join(sent, "_block").drop("_block")
    return pairs.where("id <> other").join(wide, ["id", "other"], "left_anti").select("id", "other")


def _log_sum_exp(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    rows = df.select(key, value.alias("_v"))
    top = rows.groupBy(key).agg(F.max("_v").alias("_m"))
    return salted_join(rows, top, [key]).groupBy(key).agg((F.max("_m") + F.log(F.sum(F.exp(F.col("_v") - F.col("_m"))))).alias(name))


POINT_VALUES, POINT_BLOCKS = 8_000_000, 8  # numbers of a block of points, most blocks a side
CELL_SAMPLES = 2_000_000
SAMPLES_AT_ONCE = 50_000


def embedding_loss(samples: DataFrame, points: DataFrame, at: str = "anchor") -> DataFrame:
    """Per anchor: log-sum-exp of minus the distances to all samples, less that of the
    positives. ``points`` has id and Lorentz coordinates; the column ``at`` names the point of the anchor.

    Points of some blocks a side are sent to every pair of blocks, not with every sample; more points are joined to the samples.
    """
    first = points.where("point is not null").select(F.size("point")).first()
    width, count = first[0] if first else 1, points.count()
    if count * width > POINT_BLOCKS * POINT_VALUES:
        a = points.select(F.col("id").alias(at), F.col("point").alias("_a"))
        to = points.select(F.col("id").alias("other"), F.col("point").alias("_b"))
        rows = salted_join(salted_join(samples, a, [at]), to, ["other"])
        scored = settle(rows.select("anchor", "positive", (1e-6 - vectors.lorentz_distance(F.col("_a"), F.col("_b"))).alias("v")))
        near = _log_sum_exp(scored.where("positive = 1"), "anchor", F.col("v"), "near")
        whole = _log_sum_exp(scored, "anchor", F.col("v"), "whole")
        return whole.join(near.hint("merge"), "anchor").select("anchor", (F.col("whole") - F.col("near")).alias("loss"))
    cores = int(points.sparkSession.sparkContext.defaultParallelism)
    grid = max(1, math.ceil(count * width / POINT_VALUES), min(POINT_BLOCKS, math.ceil(math.sqrt(2 * cores))))
    layers = max(1, math.ceil(samples.count() / (grid * grid * CELL_SAMPLES)))
    cell = lambda i, j, layer: (layer * grid + i) * grid + j
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(grid))
    kind = dict(points.dtypes)["id"]  # equal numbers of another type have another hash
    asked = samples.where(F.col("anchor").isNotNull()).select("anchor", F.col(at).cast(kind).alias("_at"), F.col("other").cast(kind).alias("other"), "positive")
    layer = F.pmod(F.xxhash64("anchor"), F.lit(layers))
    asked = asked.where("_at is not null and other is not null").withColumn("cell", cell(block("_at"), block("other"), layer))
    known = F.coalesce(~F.exists("point", lambda v: v.isNull()), F.lit(False))
    held = points.where("id is not null").select("id", known.alias("known"), F.when(known, F.col("point")).otherwise(
        F.array_repeat(F.lit(0.0), width)).cast("array<double>").alias("point"), block("id").alias("_own"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    held = held.withColumn("_other", every(grid)).withColumn("_layer", every(layers)).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    ends = F.when(F.col("side") == 0, cell(F.col("_own"), F.col("_other"), F.col("_layer"))).otherwise(cell(F.col("_other"), F.col("_own"), F.col("_layer")))
    sent = held.select(ends.alias("cell"), "side", "id", "known", "point")

    def sums(group, v, size):
        """Largest value and sum of the others' exponentials beside it; groups without a value stay at minus infinity."""
        top = np.full(size, -np.inf)
        np.maximum.at(top, group, v)
        return top, np.bincount(group, np.exp(v - top[group]), minlength=size).astype(np.float64)

    def meet(asked, sent):
        sides = [sent.filter(pa.compute.equal(sent["side"], i)) for i in (0, 1)]
        matrices = [t["point"].combine_chunks().flatten().to_numpy().reshape(-1, width) for t in sides]
        keys = [pd.DataFrame({n: t["id"].to_pandas(), f"_{n}": np.arange(len(t)), f"known_{n}": t["known"].to_numpy()}) for n, t in zip(("_at", "other"), sides)]
        names = asked["anchor"].combine_chunks().dictionary_encode()
        wanted = pd.DataFrame({"_at": asked["_at"].to_pandas(), "other": asked["other"].to_pandas(), "positive": asked["positive"].to_numpy() == 1,
                               "group": names.indices.to_numpy(zero_copy_only=False)})
        met = wanted.merge(keys[0], on="_at").merge(keys[1], on="other")
        a, b, group = met["__at"].to_numpy(), met["_other"].to_numpy(), met["group"].to_numpy(np.int64)
        v = np.zeros(len(met))
        for lo in range(0, len(met), SAMPLES_AT_ONCE):
            x, y = matrices[0][a[lo : lo + SAMPLES_AT_ONCE]], matrices[1][b[lo : lo + SAMPLES_AT_ONCE]]
            v[lo : lo + SAMPLES_AT_ONCE] = 1e-6 - np.arccosh(np.maximum(1.0, 2 * x[:, 0] * y[:, 0] - np.einsum("ij,ij->i", x, y)))
        v[~(met["known__at"] & met["known_other"]).to_numpy(bool)] = 1e-6  # as by columns, where a point without numbers lies at no distance
        every_one, near = np.ones(len(met), bool), met["positive"].to_numpy(bool)
        size = len(names.dictionary)
        out = [sums(group[m], v[m], size) for m in (every_one, near)]
        there, positives = (np.bincount(group[m], minlength=size) > 0 for m in (every_one, near))
        columns = {"anchor": names.dictionary.filter(pa.array(there)), "near": pa.array(positives[there])}
        for name, (top, total) in zip(("whole", "close"), out):
            empty = np.isneginf(top[there])
            columns |= {f"{name}_top": pa.array(top[there], mask=empty), f"{name}_sum": pa.array(total[there], mask=empty)}
        return pa.table(columns)

    schema = f"anchor {dict(samples.dtypes)['anchor']}, near boolean, whole_top double, whole_sum double, close_top double, close_sum double"
    scored = asked.groupBy("cell").cogroup(sent.groupBy("cell")).applyInArrow(meet, schema)
    both = [F.max(f"{n}_top").alias(f"{n}_top") for n in ("whole", "close")]
    lists = [F.collect_list(F.struct(f"{n}_top", f"{n}_sum")).alias(n) for n in ("whole", "close")]  # a row a cell
    added_up = scored.groupBy("anchor").agg(F.max("near").alias("near"), *both, *lists).where("near")

    def log_sum(name):
        terms = F.transform(name, lambda r: F.coalesce(r[f"{name}_sum"] * F.exp(r[f"{name}_top"] - F.col(f"{name}_top")), F.lit(0.0)))
        return F.col(f"{name}_top") + F.log(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x))

    return added_up.select("anchor", (log_sum("whole") - log_sum("close")).alias("loss"))


def heat_kernel(dist: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Affinity exp(-gamma d / std) with the population deviation of the table, which may hold the
    distances of some sources only."""
    spread = dist.agg(F.stddev_pop("d")).first()[0]
    return dist.select("src", "dst", F.exp(-gamma * F.col("d") / F.lit(spread)).alias("affinity"))


def landmarks(edges: DataFrame, count: int) -> DataFrame:
    """The ``count`` vertices whose ids have the smallest MD5."""
    return settle(vertices(edges).orderBy(F.md5(F.col("id").cast("string")), "id").limit(count))


def apart(points: list[list[float]], k: int) -> list[int]:
    """Numbers of k points: the first, then always one farthest from those taken, the earliest in ties."""
    taken = [0] if points else []
    near = [math.inf] * len(points)
    while len(taken) < min(k, len(points)):
        last = points[taken[-1]]
        near = [min(n, round(sum((x - y) ** 2 for x, y in zip(p, last)), 9)) for n, p in zip(near, points)]
        taken.append(max(range(len(points)), key=lambda i: (near[i], -i)))
    return taken


def spectral_clusters(edges: DataFrame, k: int = 10, marks: int = 64, dims: int | None = None, gamma: float = 1.0, rounds: int = 30,
                      steps: int = 20, start: Callable[[Column, int], Column] = axes.hashed_start) -> DataFrame:
    """(id, cluster): spectral clusters of a connected graph from its distances to some landmarks.

    Heat-kernel affinities to ``marks`` landmarks give every vertex ``dims`` spectral coordinates, and Lloyd steps
    from the points of k landmarks far apart the clusters. Nothing grows faster than vertices times landmarks.
    """
    chosen = landmarks(edges, max(marks, k))
    near = heat_kernel(settle(distances(edges, chosen)), gamma)
    affinity = near.select(F.col("dst").alias("id"), F.col("src").alias("landmark"), "affinity")
    points = settle(axes.landmark_embedding(affinity, dims or k, rounds, start))
    order = [F.md5(F.col("id").cast("string")), F.col("id")]
    held = [r["point"] for r in points.join(fit_broadcast(chosen), "id").orderBy(*order).collect()]  # a point per landmark
    first = edges.sparkSession.createDataFrame(
        list(enumerate(held[i] for i in apart(held, k))), "cluster_id int, centre array<double>"
    )
    found = kmeans_from(points, "id", "point", first, steps)
    return found.select("id", F.col("cluster_id").alias("cluster"))


def distance_pca(dist: DataFrame, k: int = 3, rounds: int = 30, start: Callable[[Column, int], Column] = axes.hashed_start) -> DataFrame:
    """Principal components of minus cosh(D / max D): (id, point), a vertex's entry on each of the k axes.

    The matrix stays a table of distances and the axes a table of vertices, whatever their number.
    """
    top = dist.agg(F.max("d")).first()[0]
    cells = dist.select(F.col("src").alias("row"), F.col("dst").alias("col"), (-F.cosh(F.col("d") / F.lit(float(top or 1)))).alias("value"))
    return axes.principal_axes(cells, k, rounds, start=start).select(F.col("col").alias("id"), F.col("axis").alias("point"))


def near_set(dist: DataFrame, quantile: float | None = 0.05, below: float | None = None) -> DataFrame:
    """Targets nearer than a quantile of the vertex's distances, or than a fixed bound."""
    if below is not None:
        return dist.where(F.col("d") < below)
    edge = exact_quantiles(dist, ["src"], "d", "dst", [quantile]).select("src", "quantile")
    return salted_join(dist, edge, ["src"]).where(F.col("d") < F.col("quantile")).select("src", "dst", "d")
