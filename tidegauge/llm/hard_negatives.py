"""Hard-negative mining: cover trees over norm-augmented candidates, searched best first.

Vectors become whole numbers, ``floor(256 * x)``, and a score is their exact inner product.
A candidate ``x`` gets one more component, ``sqrt(M * M - |x| ** 2)`` with the greatest norm
``M`` of the table, so all candidates lie on one sphere and the greatest inner product with an
anchor is the least angle to it. In the cover tree of a block, a node keeps its centre among
its children, a child holds points within the covering radius of its level, and centres of
siblings are farther apart than that radius, which shrinks by ``SHRINK`` from level to level.
Points that would make very small children, or more than ``FAN``, stay together in one leaf
under the radius of their node. If the points of a node lie within the
angle ``r`` of its centre and the anchor at the angle ``t``, their inner products are between
``|q| M cos(t + r)`` and ``|q| M cos(t - r)``. The search pops the node of greatest upper
bound, skips nodes outside the score window or without a fitting label, verifies leaves by
exact products, and stops when no bound reaches the last rank.

Rows are ranged by label, by nearest of ``PIVOTS`` sampled vectors (a bounded sample that
only places rows) and by hash, and cut into blocks of at most ``BLOCK`` rows with one tree
each; a label or a vector that a third of the rows share fills many blocks. Anchors go in
groups of ``GROUP``; every group meets every block once, and the best of each block are
merged by rank. The first search finds the positives, the second, in their score windows,
the negatives. Nothing is cut: every candidate is inside some bound or verified.

Defined cases. A row with a null id, label or vector or a null or non-finite component takes
no part. Repeated rows of equal id, label and vector are one row; rows that share the id
alone are different rows, each an anchor if the id is one. A positive is another row than
the anchor. Vectors of different lengths are filled up with zeros. Components whose products
would not fit 64 bits are cut at the greatest that do: 2.7 * 10**7 for 64 components.
Labels without another row give no positives, and tables without anchors no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.llm.common import broadcast_if_small, query, rows_of, table
from tidegauge.session import staged

SCALE = 256
EVERY, FLIP, LABELS = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
LEAST, MOST = 30, 90  # percent of the positive's score

BLOCK, GROUP = 16_384, 1_024
BROADCAST_GROUPS = 16  # packed anchors of so many groups are some 10 MB

PIVOTS = 64
SHRINK, FAN, LEAF = 0.7, 256, 512


class Tree(NamedTuple):
    """Points in the order of the nodes, and the nodes, each with a stretch of points."""

    points: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    low: np.ndarray  # first point of a node
    high: np.ndarray
    centre: np.ndarray  # a point
    angle: np.ndarray  # covering radius of the node as an angle
    child: np.ndarray  # first child, 0 for a leaf
    children: np.ndarray
    first_label: np.ndarray
    last_label: np.ndarray


def build_tree(points: np.ndarray, ids: np.ndarray, labels: np.ndarray, norm: float) -> Tree:
    """Cover tree of one block; ``norm`` is the radius of the augmented sphere."""
    plain = points.astype(float)
    rest = np.sqrt(np.maximum(0.0, norm * norm - (plain * plain).sum(1)))
    lifted = np.column_stack([plain, rest])
    order: list[np.ndarray] = []
    nodes: list[list] = []  # low, high, centre, radius, child, children
    placed = 0

    def distances(members: np.ndarray, centre: int) -> np.ndarray:
        off = lifted[members] - lifted[centre]
        return np.sqrt(np.einsum("ij,ij->i", off, off))

    todo = [(0, np.arange(len(points)), 0, distances(np.arange(len(points)), 0))]
    nodes.append([0, 0, 0, 0.0, 0, 0])
    leaves: list[tuple[int, np.ndarray]] = []
    while todo:
        at, members, centre, far = todo.pop()
        radius = float(far.max())
        nodes[at][2:4] = [centre, radius]
        if len(members) <= LEAF or radius == 0.0:
            leaves.append((at, members))
            continue
        cover = SHRINK * radius
        inside = far <= cover  # the centre is its own first child
        parts = [(centre, members[inside], far[inside])]
        left = members[~inside]
        while len(left) and len(parts) < FAN:
            away = distances(left, left[0])
            near = away <= cover
            parts.append((int(left[0]), left[near], away[near]))
            left = left[~near]
        # Small parts and what is left are verified together, under the radius of the node.
        fringe = [left, *(p for _, p, _ in parts if len(p) < LEAF // 8)]
        parts = [p for p in parts if len(p[1]) >= LEAF // 8]
        nodes[at][4:6] = [len(nodes), len(parts)]
        for c, part, away in parts:
            todo.append((len(nodes), part, c, away))
            nodes.append([0, 0, 0, 0.0, 0, 0])
        loose = np.concatenate(fringe)
        if len(loose):
            nodes[at][5] += 1
            leaves.append((len(nodes), loose))
            nodes.append([0, 0, centre, radius, 0, 0])
    for at, members in leaves:
        nodes[at][0:2] = [placed, placed + len(members)]
        order.append(members)
        placed += len(members)
    moved = np.concatenate(order)
    back = np.empty(len(points), np.int64)
    back[moved] = np.arange(len(points))
    table_ = np.array(nodes, float)
    low, high, centre, child, children = (table_[:, k].astype(np.int64) for k in (0, 1, 2, 4, 5))
    labels = labels[moved]
    first, last = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    for at in range(len(nodes) - 1, -1, -1):  # children stand behind their parent
        own = slice(child[at], child[at] + children[at])
        first[at] = first[own].min() if child[at] else labels[low[at] : high[at]].min()
        last[at] = last[own].max() if child[at] else labels[low[at] : high[at]].max()
    angle = 2 * np.arcsin(np.minimum(1.0, table_[:, 3] / (2 * norm))) if norm else np.zeros(len(nodes))
    return Tree(points[moved], ids[moved], labels, low, high, back[centre], angle, child, children, first, last)


class Search:
    """One block's tree, asked by one anchor after another."""

    def __init__(self, tree: Tree, norm: float) -> None:
        self.tree, self.norm = tree, norm
        # Below 2**53 every sum of products is exact in floating point.
        self.points = tree.points.astype(float if norm * norm < 2**53 else np.int64)
        self.centres = self.points[tree.centre]
        self.verified = 0

    def ask(self, anchor: np.ndarray) -> None:
        self.anchor = anchor.astype(self.points.dtype)
        self.size = math.sqrt(float((anchor.astype(float) ** 2).sum()))
        self.slack = 1e-6 * self.size * self.norm + 1e-3

    def _bounds(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible inner product of the points of some nodes."""
        whole = self.size * self.norm
        if not whole:
            return np.zeros(len(nodes)), np.zeros(len(nodes))
        t = np.arccos(np.clip((self.centres[nodes] @ self.anchor) / whole, -1.0, 1.0))
        r = self.tree.angle[nodes]
        low, high = whole * np.cos(np.minimum(math.pi, t + r)), whole * np.cos(np.maximum(0.0, t - r))
        return low - self.slack, high + self.slack

    def _below(self, node: int) -> tuple:
        start = int(self.tree.child[node])
        nodes = np.arange(start, start + int(self.tree.children[node]))
        return nodes, *self._bounds(nodes)

    def _leaf(self, node: int, label: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Exact scores of the fitting points of a leaf, and where they stand."""
        low, high = self.tree.low[node], self.tree.high[node]
        self.verified += int(high - low)
        at = np.flatnonzero((self.tree.labels[low:high] == label) == same)
        return (self.points[low:high] @ self.anchor)[at].astype(np.int64), at + low

    def _first(self, count: int, scores: np.ndarray, at: np.ndarray, low: float, high: float) -> list[tuple[int, int]]:
        fit = np.flatnonzero((scores >= low) & (scores <= high))
        if len(fit) > count:
            least = np.partition(scores[fit], len(fit) - count)[len(fit) - count]
            fit = fit[scores[fit] >= least]
        fit = fit[np.lexsort((self.tree.ids[at[fit]], -scores[fit]))][:count]
        return list(zip(scores[fit].tolist(), self.tree.ids[at[fit]].tolist()))

    def best(self, count: int, label: int, same: bool, windows: list[tuple[float, float]], allowed: Callable | None = None) -> list[list[tuple[int, int]]]:
        """The ``count`` best ``(score, id)`` in each window of scores, ties by smaller id.

        One descent serves all windows of an anchor: nodes outside all of them are skipped,
        and it ends when every window is full of scores above all that is left.
        """
        tree = self.tree
        open_ = [w for w in windows if w[0] <= w[1]]
        if not open_:
            return [[] for _ in windows]
        low, high = min(w[0] for w in open_), max(w[1] for w in open_)
        able = (tree.first_label <= label) & (label <= tree.last_label) if same else (tree.first_label != label) | (tree.last_label != label)
        least, most = self._bounds(np.zeros(1, np.int64))
        heap = [(-min(most[0], high), 0)] if able[0] and most[0] >= low and least[0] <= high else []
        scores, at = np.empty(0, np.int64), np.empty(0, np.int64)
        seen, looked, look = [(scores, at)], 0, 8

        def settled(bound: float) -> bool:
            full = (self._first(count, scores, at, *w) for w in open_)
            return all(len(f) == count and f[-1][0] > bound for f in full)

        while heap:
            if looked == look:
                scores, at = (np.concatenate(p) for p in zip(*seen))
                seen, look = [(scores, at)], 2 * look
                if settled(-heap[0][0]):
                    break
            node = heapq.heappop(heap)[1]
            if tree.child[node]:
                nodes, least, most = self._below(node)
                for k in np.flatnonzero(able[nodes] & (most >= low) & (least <= high)).tolist():
                    heapq.heappush(heap, (-min(most[k], high), int(nodes[k])))
                continue
            looked += 1
            found, places = self._leaf(node, label, same)
            if allowed is not None:
                fit = allowed(places)
                found, places = found[fit], places[fit]
            seen.append((found, places))
        scores, at = (np.concatenate(p) for p in zip(*seen))
        return [self._first(count, scores, at, *w) if w[0] <= w[1] else [] for w in windows]


def whole_vectors(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """``id, label, v`` of the rows that take part, distinct, and the number of components."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(finite)
    size = known.agg(F.max(F.size("embedding"))).first()[0] or 0
    limit = float(math.isqrt(2**62 // (100 * max(1, size))))

    def whole(x: Column) -> Column:
        return F.greatest(F.least(F.floor(x.cast("double") * SCALE).cast("double"), F.lit(limit)), F.lit(-limit)).cast("bigint")

    label = F.when(F.col("vec_id") % FLIP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = known.select(F.col("vec_id").cast("bigint").alias("id"), label.cast("bigint").alias("label"), F.transform("embedding", whole).alias("v"))
    return rows.distinct(), size


def _matrix(rows: list, size: int) -> np.ndarray:
    out = np.zeros((len(rows), size), np.int64)
    for k, v in enumerate(rows):
        out[k, : len(v)] = v
    return out


def _packed(matrix: np.ndarray) -> tuple[bytes, str]:
    kind = next((k for k in ("int16", "int32") if np.abs(matrix).max(initial=0) <= np.iinfo(k).max), "int64")
    return matrix.astype(kind).tobytes(), kind


_TREE = [f for f in Tree._fields if f != "points"]
_KINDS = {"angle": "float64"}


def _tree_row(tree: Tree) -> dict:
    points, kind = _packed(tree.points)
    return {"points": points, "kind": kind, **{f: np.asarray(getattr(tree, f), _KINDS.get(f, "int64")).tobytes() for f in _TREE}}


def _tree_of(row: dict, size: int) -> Tree:
    points = np.frombuffer(row["points"], row["kind"])
    parts = {f: np.frombuffer(row[f], _KINDS.get(f, "int64")) for f in _TREE}
    return Tree(points.reshape(len(parts["ids"]), size), **parts)


TREES = "block bigint, kind string, points binary, " + ", ".join(f"{f} binary" for f in _TREE)
_TREE_ARROW = pa.schema([("block", pa.int64()), ("kind", pa.string()), *((f, pa.binary()) for f in ("points", *_TREE))])


def plant_trees(rows: DataFrame, size: int, norm: float) -> DataFrame:
    """One row per block with its tree, packed; blocks hold neighbours of one label."""
    pivots = _matrix([r["v"] for r in rows.orderBy(F.xxhash64("id", "v")).limit(PIVOTS).select("v").collect()], size).astype(float)
    block = BLOCK

    def place(batches):
        for batch in batches:
            held = batch.column(2).to_pylist()
            matrix = _matrix(held, size).astype(float)
            away = (pivots * pivots).sum(1)[None, :] - 2 * (matrix @ pivots.T)
            cell = pa.array(away.argmin(1) if len(held) else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, cell], names=["id", "label", "v", "cell"])

    def plant(batches):
        held: list[dict] = []

        def tree() -> pa.RecordBatch:
            ids, labels = (np.array([r[c] for r in held], np.int64) for c in ("id", "label"))
            row = _tree_row(build_tree(_matrix([r["v"] for r in held], size), ids, labels, norm))
            name = sha256(row["ids"] + row["points"]).digest()  # the same in a second attempt
            return pa.RecordBatch.from_pylist([{"block": int.from_bytes(name[:8], "big", signed=True), **row}], _TREE_ARROW)

        for row in rows_of(batches):
            held.append(row)
            if len(held) == block:
                yield tree()
                held = []
        if held:
            yield tree()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select("id", "label", "v").mapInArrow(place, "id bigint, label bigint, v array<bigint>, cell bigint")
    keys = ("label", "cell", F.xxhash64("id", "v"))
    ranged = placed.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("id", "label", "v")
    return staged(ranged.mapInArrow(plant, TREES), "trees")


def _pairs(trees: DataFrame, groups: DataFrame, count: int) -> DataFrame:
    """Every tree beside every one of the ``count`` groups of anchors, one row for both."""

    def up_to(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    small = broadcast_if_small(groups, BROADCAST_GROUPS)
    each = trees.withColumn("g", up_to(count))
    if small is not groups:
        return each.join(small, "g")
    # Both sides carry the pair as their key, so no group and no tree gathers in one task.
    slices = trees.count()
    each = each.withColumn("s", F.pmod("block", F.lit(slices)).cast("int"))
    return each.join(groups.withColumn("s", up_to(slices)), ["s", "g"]).drop("s")


def _anchor_groups(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """Anchors in packed groups ``g``, dealt by hash, and how many groups there are."""
    anchors = rows.filter(F.col("id") % EVERY == 0)
    count = math.ceil(anchors.count() / GROUP)
    g = F.pmod(F.xxhash64(F.lit(5), "id", "v"), F.lit(max(1, count))).cast("int").alias("g")
    listed = anchors.groupBy(g).agg(F.sort_array(F.collect_list(F.struct("label", "id", "v"))).alias("held"))
    schema = pa.schema([("g", pa.int32()), ("a_ids", pa.binary()), ("a_labels", pa.binary()), ("a_kind", pa.string()), ("a_points", pa.binary())])

    def pack(batches):
        for row in rows_of(batches):
            held = row["held"]
            points, kind = _packed(_matrix([r["v"] for r in held], size))
            ids, labels = (np.array([r[c] for r in held], np.int64).tobytes() for c in ("id", "label"))
            yield pa.RecordBatch.from_pylist([{"g": row["g"], "a_ids": ids, "a_labels": labels, "a_kind": kind, "a_points": points}], schema)

    packed = listed.mapInArrow(pack, "g int, a_ids binary, a_labels binary, a_kind string, a_points binary")
    return staged(packed, "anchors"), count


def _anchors_of(row: dict, size: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    ids, labels = np.frombuffer(row["a_ids"], np.int64), np.frombuffer(row["a_labels"], np.int64)
    points = np.frombuffer(row["a_points"], row["a_kind"]).reshape(len(ids), size).astype(np.int64)
    for pos in range(len(ids)):
        yield pos, int(ids[pos]), int(labels[pos]), points[pos]


def _ranked(rows: DataFrame, keys: list[str], count: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "found")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= count)


FOUND = pa.schema([("g", pa.int32()), *((n, pa.int64()) for n in ("pos", "aim", "found", "score"))])


def _positives(trees: DataFrame, groups: DataFrame, count: int, size: int, norm: float) -> DataFrame:
    """``g, pos, found, score, rank``: the first other rows of each anchor's label."""

    def run(batches):
        for row in rows_of(batches):
            search, out = Search(_tree_of(row, size), norm), []
            tree = search.tree
            for pos, own, label, anchor in _anchors_of(row, size):
                if not tree.first_label[0] <= label <= tree.last_label[0]:
                    continue
                search.ask(anchor)

                def other(at: np.ndarray) -> np.ndarray:
                    differs = tree.ids[at] != own
                    same = np.flatnonzero(~differs)
                    differs[same] = (tree.points[at[same]] != anchor).any(1)
                    return differs

                found = search.best(POSITIVES, label, True, [(-math.inf, math.inf)], other)[0]
                out += [(row["g"], pos, None, i, s) for s, i in found]
            yield _batch(out)

    found = _pairs(trees, groups, count).mapInArrow(run, "g int, pos bigint, aim bigint, found bigint, score bigint")
    return _ranked(found.drop("aim"), ["g", "pos"], POSITIVES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND)], schema=FOUND)


def _negatives(trees: DataFrame, groups: DataFrame, count: int, aims: DataFrame, size: int, norm: float) -> DataFrame:
    """``g, pos, aim, found, score, rank``: the first rows of other labels in the window of
    each positive score ``aim``."""
    listed = aims.select("g", F.struct("pos", F.col("score").alias("aim")).alias("one")).distinct().groupBy("g").agg(F.sort_array(F.collect_list("one")).alias("aims"))
    groups = staged(groups.join(listed, "g", "left"), "aimed")

    def run(batches):
        for row in rows_of(batches):
            search, out = Search(_tree_of(row, size), norm), []
            windows: dict[int, list[int]] = {}
            for one in row["aims"] or []:
                windows.setdefault(one["pos"], []).append(one["aim"])
            for pos, _, label, anchor in _anchors_of(row, size):
                if pos not in windows:
                    continue
                search.ask(anchor)
                spans = [(-(-LEAST * aim // 100), MOST * aim // 100) for aim in windows[pos]]
                for aim, found in zip(windows[pos], search.best(NEGATIVES, label, False, spans)):
                    out += [(row["g"], pos, aim, i, s) for s, i in found]
            yield _batch(out)

    found = _pairs(trees, groups, count).mapInArrow(run, "g int, pos bigint, aim bigint, found bigint, score bigint")
    return _ranked(found, ["g", "pos", "aim"], NEGATIVES)


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of every anchor and positive; see the module for the rules."""
    spark = embeddings.sparkSession
    rows, size = whole_vectors(embeddings.select("vec_id", "embedding", "label"))
    rows = staged(rows, "vectors")
    squares = F.aggregate("v", F.lit(0).cast("bigint"), lambda s, x: s + x * x)
    norm = math.sqrt(rows.agg(F.max(squares)).first()[0] or 0)
    groups, count = _anchor_groups(rows, size)
    if not count:
        return spark.createDataFrame([], RESULT)
    trees = plant_trees(rows, size, norm)
    positives = staged(_positives(trees, groups, count, size, norm), "positives")
    negatives = _negatives(trees, groups, count, positives, size, norm)
    ids = groups.select("g", "a_ids").mapInArrow(_anchor_ids, "g int, pos bigint, anchor_id bigint")
    told = positives.select("g", "pos", F.col("found").alias("positive_id"), F.col("score").alias("aim"))
    out = told.join(ids, ["g", "pos"]).join(negatives, ["g", "pos", "aim"])
    return out.select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("found").alias("negative_id"),
        F.col("aim").alias("positive_score"), F.col("score").alias("negative_score"),
    )


def _anchor_ids(batches):
    for row in rows_of(batches):
        ids = np.frombuffer(row["a_ids"], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), row["g"], np.int32)), pa.array(np.arange(len(ids))), pa.array(ids)], names=["g", "pos", "anchor_id"])


@query(
    "op13_hard_negatives",
    f"""
    WITH rows_ AS (
        SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % {FLIP} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
            list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), met AS (
        SELECT a.id AS anchor_id, a.v AS av, b.id AS id, a.label = b.label AS same, a.id = b.id AND a.v = b.v AS own,
            list_dot_product(a.v, b.v)::BIGINT AS score
        FROM rows_ a JOIN rows_ b ON a.id % {EVERY} = 0
    ), positives AS (
        SELECT anchor_id, av, id AS positive_id, score AS positive_score FROM met WHERE same AND NOT own
        QUALIFY row_number() OVER (PARTITION BY anchor_id, av ORDER BY score DESC, id) <= {POSITIVES}
    )
    SELECT anchor_id, positive_id,
        row_number() OVER (PARTITION BY anchor_id, av, positive_id, positive_score ORDER BY score DESC, id)::INT AS rank,
        id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN met USING (anchor_id, av)
    WHERE NOT same AND {LEAST} * positive_score <= 100 * score AND 100 * score <= {MOST} * positive_score
    QUALIFY rank <= {NEGATIVES}""",
)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))
