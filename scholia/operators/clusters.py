"""Clusters on a plane: density sweep, splits of many clusters at once, label flow, greedy centres.

Nothing here pairs the points of a cell or gathers a cluster in one task: dense cells are one node however many points they
hold, splits are sums by cluster and part with partial aggregation, and greedy choices are made in rounds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.text import cleaned_label, is_technical_label
from scholia.operators import vectors as V
from scholia.sources.tables import written

# The (eps, least points) settings of the sweep, in the order in which ties are decided.
SETTINGS = ((3.0, 3), (2.5, 3), (2.0, 3), (1.5, 3), (1.2, 3), (1.0, 3), (0.8, 3), (2.0, 4), (1.5, 4), (1.0, 4), (0.8, 4), (1.5, 5), (1.0, 5), (0.8, 5))
_AROUND = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]


def smallest_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """run, node, label: the smallest node that edges (run, a, b; both ways) lead to. Labels are nodes themselves, so taking
    the label's label halves the way each round."""
    label = nodes.select("run", "node", F.col("node").alias("label"))
    while True:
        low = edges.join(label.select("run", F.col("node").alias("b"), F.col("label").alias("l")), ["run", "b"]).groupBy("run", F.col("a").alias("node")).agg(F.min("l").alias("low"))
        new = label.join(low, ["run", "node"], "left").select("run", "node", F.least("label", "low").alias("new"), "label")
        jump = new.select("run", F.col("node").alias("new"), F.col("new").alias("next"))
        new = written(new.join(jump, ["run", "new"]).select("run", "node", F.least("new", "next").alias("new"), "label"), "labels")
        label = new.select("run", "node", F.col("new").alias("label"))
        if not new.where("new < label").limit(1).count():
            return label


def _boxes(points: DataFrame, level: int) -> DataFrame:
    """Bounds of the core points in each part of a cell; a level halves the sides of the one before."""
    jx, jy = (F.floor(F.col(c) / (F.col("side") / 2**level)) for c in "xy")
    return points.groupBy("run", "eps", "ix", "iy", jx.alias("jx"), jy.alias("jy")).agg(*(f(c).alias(f"{c}{k}") for c in "xy" for f, k in ((F.min, 0), (F.max, 1))))


def _touching(core: DataFrame) -> DataFrame:
    """run, (ix, iy), (kx, ky): cells of which two core points are within eps. Bounds of the cells decide most pairs; where
    they do not, both sides are halved until they do, so that points of two cells are never paired."""
    own = ["run", "eps", "ix", "iy"]
    level, done, bounds = 0, None, ["x0", "x1", "y0", "y1"]
    boxes = written(_boxes(core, 0), "boxes")
    other = boxes.select("run", F.col("ix").alias("kx"), F.col("iy").alias("ky"), F.col("jx").alias("hx"), F.col("jy").alias("hy"), *(F.col(c).alias(f"o{c}") for c in bounds))
    shift = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _AROUND if (i, j) > (0, 0))))
    pairs = boxes.withColumn("s", shift).withColumns({"kx": F.col("ix") + F.col("s.i"), "ky": F.col("iy") + F.col("s.j")}).drop("s").join(other, ["run", "kx", "ky"])
    while True:
        gap = [F.greatest(F.lit(0.0), F.col(f"o{c}0") - F.col(f"{c}1"), F.col(f"{c}0") - F.col(f"o{c}1")) for c in "xy"]
        far = [F.greatest(F.col(f"o{c}1") - F.col(f"{c}0"), F.col(f"{c}1") - F.col(f"o{c}0")) for c in "xy"]
        size = lambda d: F.sqrt(F.pow(d[0], F.lit(2)) + F.pow(d[1], F.lit(2)))
        told = written(pairs.withColumns({"near_": size(gap) <= F.col("eps"), "all_": size(far) <= F.col("eps")}).where("near_"), "pairs")
        hit = told.where("all_").select(*own, "kx", "ky").distinct()
        done = hit if done is None else done.union(hit)
        open_ = told.where("not all_").join(hit, [*own, "kx", "ky"], "left_anti")
        if not open_.limit(1).count():
            return written(done.select("run", "ix", "iy", "kx", "ky"), "touching")
        level += 1
        open_ = written(open_.select(*own, "kx", "ky", F.col("jx").alias("px"), F.col("jy").alias("py"), F.col("hx").alias("qx"), F.col("hy").alias("qy")), "open")
        boxes = written(_boxes(core, level).withColumns({"px": F.floor(F.col("jx") / 2), "py": F.floor(F.col("jy") / 2)}), "boxes")
        other = boxes.select("run", F.col("ix").alias("kx"), F.col("iy").alias("ky"), F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("jx").alias("hx"), F.col("jy").alias("hy"), *(F.col(c).alias(f"o{c}") for c in bounds))
        pairs = open_.join(boxes, [*own, "px", "py"]).drop("px", "py").join(other, ["run", "kx", "ky", "qx", "qy"]).drop("qx", "qy")


def density_sweep(points: DataFrame, settings: tuple = SETTINGS) -> DataFrame:
    """For each run (place in `settings`: eps, least points), DBSCAN of points (key, x, y): run, key, cluster (smallest
    core key of the component, the smallest such one for a border point; null for noise). All runs share each pass.

    Cells have a diagonal just under eps. A cell with enough points is core as a whole. Only points of other cells, fewer than
    `least` in each, are compared with the points around, so pairs grow with the points, not with their square.
    """
    # a little under the exact side, so that rounding puts no two points of a cell further apart than eps
    runs = F.explode(F.array(*(F.struct(F.lit(k).alias("run"), F.lit(float(e)).alias("eps"), F.lit(m).alias("least"), F.lit(e / math.sqrt(2) * (1 - 1e-9)).alias("side")) for k, (e, m) in enumerate(settings))))
    p = points.select("key", "x", "y", runs.alias("r")).select("key", "x", "y", "r.*")
    p = p.withColumns({"ix": F.floor(F.col("x") / F.col("side")), "iy": F.floor(F.col("y") / F.col("side"))})
    cells = p.groupBy("run", "ix", "iy").agg(F.count("*").alias("n"))
    p = written(p.join(cells, ["run", "ix", "iy"]).withColumn("dense", F.col("n") >= F.col("least")).drop("n"), "cells")
    shift = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _AROUND)))
    asks = p.where("not dense").withColumn("s", shift).select("run", "key", "x", "y", "eps", "least", (F.col("ix") + F.col("s.i")).alias("ix"), (F.col("iy") + F.col("s.j")).alias("iy"))
    there = p.select("run", "ix", "iy", F.col("key").alias("o"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("dense").alias("odense"))
    near = asks.join(there, ["run", "ix", "iy"]).where(F.sqrt(F.pow(F.col("x") - F.col("ox"), 2) + F.pow(F.col("y") - F.col("oy"), 2)) <= F.col("eps"))
    near = written(near.select("run", "key", "least", "o"), "near")
    more = near.groupBy("run", "key").agg(F.count("*").alias("n"), F.first("least").alias("least")).where("n >= least").select("run", "key")
    core = written(p.where("dense").unionByName(p.join(more, ["run", "key"], "left_semi")), "core")
    node = written(core.groupBy("run", "ix", "iy").agg(F.min("key").alias("node")), "nodes")
    pairs = _touching(core).join(node, ["run", "ix", "iy"]).select("run", "kx", "ky", F.col("node").alias("a"))
    pairs = written(pairs.join(node.select("run", F.col("ix").alias("kx"), F.col("iy").alias("ky"), F.col("node").alias("b")), ["run", "kx", "ky"]).select("run", "a", "b"), "edges")
    label = smallest_labels(node, pairs.union(pairs.select("run", "b", "a")))
    inside = written(core.select("run", "key", "ix", "iy").join(node, ["run", "ix", "iy"]).join(label, ["run", "node"]).select("run", "key", F.col("label").alias("cluster")), "inside")
    border = near.select("run", "key", "o").join(inside.select("run", "key"), ["run", "key"], "left_anti")
    border = border.join(inside.select("run", F.col("key").alias("o"), "cluster"), ["run", "o"]).groupBy("run", "key").agg(F.min("cluster").alias("cluster"))
    return written(p.select("run", "key").join(inside.union(border), ["run", "key"], "left"), "sweep")


def spatial_clusters(df: DataFrame, key: str, x: str, y: str, least: int = 5, most: int = 25, k: int = 10, enough: int = 3) -> tuple[DataFrame, DataFrame]:
    """The run of the sweep (on standardised places) with most clusters of `least` to `most` points (ties: the earlier
    setting), of which the k largest: clusters (cluster, method, eps, points, n, cx, cy in the places given) and members (key,
    cluster). With fewer than `enough`, k-means of 8, 6 or 5 clusters, and else the largest cells of a grid, take its place."""
    own = written(df.select(F.col(key).alias("key"), F.col(x).alias("x"), F.col(y).alias("y")), "points")
    sweep = density_sweep(V.standardised(own, ["x", "y"]))
    sizes = sweep.where("cluster is not null").groupBy("run", "cluster").agg(F.count("*").alias("n")).where(F.col("n").between(least, most))
    found = sizes.groupBy("run").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "run").first()
    if found and min(found["c"], k) >= enough:
        run = found["run"]
        chosen = sizes.where(F.col("run") == run).orderBy(F.desc("n"), "cluster").limit(k).select("cluster")
        members = sweep.where(F.col("run") == run).select("key", "cluster").join(F.broadcast(chosen), "cluster", "left_semi")
        return _described(members, own, "density", SETTINGS[run])
    n = own.count()
    for clusters in (8, 6, 5):
        if 5 * clusters > n:
            continue
        scaled = V.standardised(own, ["x", "y"]).select("key", F.array("x", "y").alias("v"))
        members = V.kmeans(scaled, "v", clusters).select("key", F.col("cluster").cast("long").alias("cluster"))
        big = members.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least)
        if big.count() >= enough:
            return _described(members.join(big.select("cluster"), "cluster", "left_semi"), own, "k-means", (None, None))
    cells = V.grid_cells(own, "x", "y").withColumn("cluster", (3 * F.col("gx") + F.col("gy")).cast("long"))
    big = cells.groupBy("cluster").agg(F.count("*").alias("n")).where("n >= 8").orderBy(F.desc("n"), "cluster").limit(8)
    return _described(cells.join(F.broadcast(big.select("cluster")), "cluster", "left_semi").select("key", "cluster"), own, "grid", (None, None))


def _described(members: DataFrame, own: DataFrame, method: str, setting: tuple) -> tuple[DataFrame, DataFrame]:
    members = written(members, "members")
    told = members.join(own, "key").groupBy("cluster").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    eps, points = F.lit(setting[0]).cast("double"), F.lit(setting[1]).cast("int")
    return told.select("cluster", F.lit(method).alias("method"), eps.alias("eps"), points.alias("points"), "n", "cx", "cy"), members


#: Members of a cluster that one task may hold.
HELD = 100_000


def _lloyd(rows: pd.DataFrame, parts: int, rounds: int) -> np.ndarray:
    """The parts of one cluster's members, in order of their keys."""
    xy = rows[["x", "y"]].to_numpy(float)
    off = lambda c: ((xy - c) ** 2).sum(1)
    centres = [xy[off(xy.mean(0)).argmin()]]
    while len(centres) < parts:
        centres.append(xy[np.min([off(c) for c in centres], 0).argmax()])
    for _ in range(rounds):
        part = np.argmin([off(c) for c in centres], 0)
        new = [xy[part == k].mean(0) if (part == k).any() else c for k, c in enumerate(centres)]
        done = all((a == b).all() for a, b in zip(new, centres, strict=True))
        centres = new
        if done:
            break
    return np.argmin([off(c) for c in centres], 0)


def split_many(members: DataFrame, parts: Column, rounds: int = 25, held: int = HELD) -> DataFrame:
    """Every cluster of members (key, cluster, x, y) split into `parts` (of n, its size) at once: key, cluster, part.

    Lloyd's rounds; the first centre is the member nearest to the mean, each next the member farthest from its nearest centre
    (ties: smallest key), a member goes to its nearest centre (ties: the earlier one): the result depends on the members
    alone. Clusters of at most `held` members are split by one task each; larger ones go through the same rounds together,
    each a sum by cluster and part with partial aggregation, so that a cluster with any share of the members is no task."""
    kind = {c: members.schema[c].dataType.simpleString() for c in ("key", "cluster")}
    sized = members.select("key", "cluster", "x", "y").join(members.groupBy("cluster").agg(F.count("*").alias("n")), "cluster")
    sized = written(sized.withColumn("parts", parts), "sized")

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", kind="stable")
        return pd.DataFrame({"key": rows["key"], "cluster": rows["cluster"], "part": _lloyd(rows, int(rows["parts"].iloc[0]), rounds)})

    out = sized.where(F.col("n") <= held).groupBy("cluster").applyInPandas(one, f"key {kind['key']}, cluster {kind['cluster']}, part int")
    large = sized.where(F.col("n") > held)
    return out.union(_split_large(large.drop("n", "parts"), parts, rounds)) if large.limit(1).count() else out


def _split_large(members: DataFrame, parts: Column, rounds: int) -> DataFrame:
    own = members.select("key", "cluster", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    size = own.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my")).withColumn("parts", parts)
    own = written(own.join(size, "cluster"), "members")

    def off(cx: Column, cy: Column) -> Column:
        return F.pow(F.col("x") - cx, F.lit(2)) + F.pow(F.col("y") - cy, F.lit(2))

    point = F.struct("x", "y")
    first = own.groupBy("cluster").agg(F.min(F.struct(off(F.col("mx"), F.col("my")).alias("d"), "key", point.alias("p"))).alias("m"))
    centres = written(first.select("cluster", F.array("m.p").alias("c")), "centres")
    most = size.agg(F.max("parts")).first()[0] or 0
    near = F.array_min(F.transform("c", lambda c, i: F.struct(off(c["x"], c["y"]).alias("d"), i.alias("i"))))
    for k in range(1, most):
        far = own.join(centres, "cluster").where(F.col("parts") > k).groupBy("cluster").agg(F.min(F.struct((-near["d"]).alias("d"), "key", point.alias("p"))).alias("m"))
        centres = written(centres.join(far, "cluster", "left").select("cluster", F.when(F.col("m").isNull(), F.col("c")).otherwise(F.array_append("c", F.col("m.p"))).alias("c")), "centres")
    for _ in range(rounds):
        dealt = own.join(centres, "cluster").withColumn("part", near["i"])
        means = dealt.groupBy("cluster", "part").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
        moved = means.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("part", point.alias("p")))).alias("m"))
        # a part that lost all its members keeps its centre
        new = F.transform("c", lambda c, i: F.coalesce(F.get(F.filter("m", lambda e: e["part"] == i), F.lit(0))["p"], c))
        both = written(centres.join(moved, "cluster").select("cluster", new.alias("new"), F.col("c").alias("old")), "centres")
        centres = both.select("cluster", F.col("new").alias("c"))
        if not both.where("new <> old").limit(1).count():
            break
    return own.join(centres, "cluster").select("key", "cluster", near["i"].alias("part"))


#: A namer gives members (cluster, key) labels (cluster, label), by topic, synthesis or deep reading.
Namer = Callable[[DataFrame, str], DataFrame]


def _sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))


def _named(namer: Namer, members: DataFrame, kind: str, most: int) -> DataFrame:
    """cluster, label of the clusters to which the namer gives a technical label, cleaned and cut to `most` characters."""
    # each step is written: one expression for all would repeat the first in every condition of the last
    first = written(namer(members.select("cluster", "key"), kind).select("cluster", F.substring_index(F.trim("label"), "\n", 1).alias("label")), "named")
    got = written(first.select("cluster", cleaned_label(F.col("label")).alias("label")), "cleaned")
    return got.where(is_technical_label(F.col("label"))).select("cluster", F.substring("label", 1, most).alias("label"))


def _good_parts(members: DataFrame, namer: Namer, parts: Column, least: int, kinds: list[tuple[str, int]], mark: str) -> tuple[DataFrame, DataFrame]:
    """Splits that leave two parts or more of `least` members with technical labels: members and labels of these parts,
    with the cluster they come from."""
    split = split_many(members, parts).withColumn("part_", F.concat("cluster", F.lit(f"_{mark}_"), F.col("part").cast("string")))
    split = written(split.select("key", F.col("cluster").alias("of"), F.col("part_").alias("cluster")).join(members.select("key", "x", "y"), "key"), "parts")
    kept = split.join(split.groupBy("cluster").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("cluster"), "cluster", "left_semi")
    labels = None
    for kind, most in kinds:
        todo = kept if labels is None else kept.join(labels, "cluster", "left_anti")
        got = written(_named(namer, todo, kind, most), "labels")
        labels = got if labels is None else labels.union(got)
    kept = kept.join(labels, "cluster", "left_semi")
    both = kept.select("of", "cluster").distinct().groupBy("of").agg(F.count("*").alias("n")).where("n >= 2").select("of")
    kept = written(kept.join(both, "of", "left_semi"), "kept")
    return kept, labels.join(kept.select("cluster").distinct(), "cluster", "left_semi")


def refined_clusters(members: DataFrame, labels: DataFrame, namer: Namer) -> tuple[DataFrame, DataFrame]:
    """Members (key, cluster, x, y) and labels (cluster, label) of clusters: clusters (cluster, label, how, n, cx,
    cy) with technical labels as far as can be, and their members.

    A label that is not technical is synthesised; else a cluster of 15 members or more is split, if two of its parts of five
    or more get technical labels (members of its other parts are in no cluster then); else its place names it. What is still
    general is read deeply; else clusters of ten or more are split further (parts of three); else the nearest technical
    cluster's label is adapted; else place and size name it."""
    members = written(members.select("key", F.col("cluster").cast("string").alias("cluster"), "x", "y"), "members")
    told = written(labels.select(F.col("cluster").cast("string").alias("cluster"), "label").withColumn("how", F.lit("given")), "labels")

    def settle(found: DataFrame, how: str) -> None:
        nonlocal told
        new = written(found, "found").select("cluster", "label", F.lit(how).alias("how"))
        told = written(told.join(new.select("cluster"), "cluster", "left_anti").union(new), "labels")

    def general() -> DataFrame:
        return written(members.join(told.where(~is_technical_label(F.col("label"))).select("cluster"), "cluster", "left_semi"), "general")

    def split(todo: DataFrame, size: int, parts: Column, least: int, kinds: list[tuple[str, int]], mark: str) -> None:
        nonlocal members, told
        big = todo.join(_sizes(todo).where(F.col("n") >= size).select("cluster"), "cluster", "left_semi")
        if not big.limit(1).count():
            return
        kept, names = _good_parts(big, namer, parts, least, kinds, mark)
        gone = kept.select(F.col("of").alias("cluster")).distinct()
        members = written(members.join(gone, "cluster", "left_anti").unionByName(kept.drop("of")), "members")
        told = written(told.join(gone, "cluster", "left_anti").union(names.select("cluster", "label", F.lit(mark).alias("how"))), "labels")

    settle(_named(namer, general(), "synthesis", 50), "synthesis")
    n = F.col("n")
    split(general(), 15, F.least(F.lit(4), F.greatest(F.lit(2), F.floor(n / 15))).cast("int"), 5, [("topic", 50), ("synthesis", 50)], "split")
    placed = _sizes(general()).select("cluster", V.position_label(F.col("cx"), F.col("cy"), n).alias("label"))
    settle(placed, "place")
    settle(_named(namer, general(), "deep", 60), "deep")
    split(general(), 10, F.least(F.lit(6), F.greatest(F.lit(3), F.floor(n / 8))).cast("int"), 3, [("deep", 60), ("topic", 50)], "finer")
    sizes = written(_sizes(members).join(told, "cluster"), "sizes")
    technical = is_technical_label(F.col("label"))
    near = V.nearest_labelled(sizes.where(~technical).drop("label", "how"), sizes.where(technical)).where(technical)
    settle(near, "neighbour")
    rest = _sizes(general()).select("cluster", V.specific_label(F.col("cx"), F.col("cy"), n).alias("label"))
    settle(rest, "place and size")
    return written(_sizes(members).join(told, "cluster").select("cluster", "label", "how", "n", "cx", "cy"), "clusters"), members


def disjoint_centres(groups: DataFrame, order: Column, most: int) -> DataFrame:
    """Doc and place of the first `most` documents, greedily in an order, whose groups (doc, near: one row a neighbour; the
    document itself belongs to it) share nothing with those taken before.

    In rounds: a document that comes first, among those undecided, for all that is in its group is taken, and those that
    share something with it go. That is the greedy choice, whatever the number of documents."""
    every = groups.select("doc", F.col("near").alias("e")).union(groups.select("doc", F.col("doc").alias("e"))).distinct()
    left = written(every.join(groups.select("doc").distinct().withColumn("o", F.struct(order.alias("o"), "doc")), "doc"), "groups")
    taken = None
    while left.limit(1).count():
        first = left.groupBy("e").agg(F.min("o").alias("f"))
        now = written(left.join(first, "e").groupBy("doc", "o").agg(F.bool_and(F.col("o") == F.col("f")).alias("on")).where("on").select("doc", "o"), "taken")
        taken = now if taken is None else taken.union(now)
        used = left.join(now.select("doc"), "doc", "left_semi").select("e").distinct()
        gone = left.join(used, "e", "left_semi").select("doc").distinct()
        rest = left.join(gone, "doc", "left_anti")
        first = taken.orderBy("o").limit(most).agg(F.max("o").alias("last"), F.count("*").alias("n"))
        rest = rest.join(F.broadcast(first)).where((F.col("n") < most) | (F.col("o") < F.col("last"))).drop("last", "n")
        left = written(rest, "groups")
    if taken is None:
        return groups.select("doc", F.lit(0).alias("place")).limit(0)
    top = taken.orderBy("o").limit(most).agg(F.sort_array(F.collect_list("o")).alias("l"))
    return top.select(F.posexplode("l").alias("place", "x")).select("x.doc", "place")


def assigned(docs: DataFrame, groups: DataFrame, centres: DataFrame) -> DataFrame:
    """Doc, cluster: the first of the centres (doc, place) of whose group the document is; -1 for the rest."""
    every = groups.select("doc", F.col("near").alias("e")).union(centres.select("doc", F.col("doc").alias("e")))
    own = every.join(F.broadcast(centres), "doc").groupBy(F.col("e").alias("doc")).agg(F.min("place").alias("cluster"))
    return docs.select("doc").join(own, "doc", "left").select("doc", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
