"""Near copies of vectors through a navigable small-world graph per shard."""

from __future__ import annotations

import io
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grievaline.llm.common import boxed, components, pinned, travels, unboxed, without
from grievaline.operators.hotkeys import lookup_join

travels(__name__)

THRESHOLD = 0.93
SHARD_BYTES = 32 << 20
LINKS = 16
BUILD_BEAM = 48
FIRST_BEAM = 64
AUDIT = 256
NEAREST = 16
RECALL = 0.99
LOT = 256
AT_ONCE = 4
PADDED = 1 << 15
# A node that a walk looks at takes as long as so many of a scan, at least (measured: 38).
WALK_COST = 16


class Graph:
    """A hierarchical graph over unit vectors; level 0 holds all, each next level fewer."""

    def __init__(self, unit: np.ndarray, links: int = LINKS, seed: int = 7):
        self.unit = unit.astype(np.float32)
        n = len(unit)
        self.width = [2 * links]
        draw = -np.log(1.0 - np.random.default_rng([seed, n]).random(n)) / math.log(links)
        self.level = np.minimum(draw.astype(int), 6)
        if n:
            self.level[0] = self.level.max()  # the entry
        self.near = [
            np.full((n, (2 if lv == 0 else 1) * links), -1, dtype=np.int32)
            for lv in range(int(self.level.max(initial=0)) + 1)
        ]
        done = 1
        while done < n:
            lot = np.arange(done, min(n, done + min(done, LOT)))
            self._insert(lot)
            done = int(lot[-1]) + 1

    def search(self, queries: np.ndarray, beam: int, level: int = 0, entry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nodes found nearest to each query at a level, best first.

        All queries walk together: each step expands the best unexpanded nodes of every
        beam and merges their neighbours.
        """
        q, n = len(queries), len(self.unit)
        if entry is None:
            entry = np.zeros((q, 1), dtype=np.int32)
            for lv in range(len(self.near) - 1, level, -1):
                entry = self.search(queries, 4, lv, entry)[0]
        rows = np.arange(q)[:, None]
        seen = np.zeros((q, n + 1), dtype=bool)  # the last column takes the blanks
        seen[:, n] = True
        seen[rows, entry] = True
        seen[:, n] = True
        sims = np.where(entry >= 0, np.einsum("qd,qed->qe", queries, self.unit[entry]), -np.inf)
        pad = max(0, beam - entry.shape[1])
        ids = np.pad(entry, ((0, 0), (0, pad)), constant_values=-1)
        sims = np.pad(sims, ((0, 0), (0, pad)), constant_values=-np.inf)
        open_ = ids >= 0
        active = np.arange(q)
        while active.size:
            rank = np.where(open_[active], sims[active], -np.inf)
            take = min(AT_ONCE, rank.shape[1])
            pick = np.argpartition(-rank, take - 1, axis=1)[:, :take] if take < rank.shape[1] else np.tile(np.arange(take), (active.size, 1))
            chosen = np.take_along_axis(rank, pick, axis=1) > -np.inf
            going = chosen.any(axis=1)
            active, pick, chosen = active[going], pick[going], chosen[going]
            if not active.size:
                break
            r = active[:, None]
            nodes = np.where(chosen, ids[r, pick], -1)
            open_[r, pick] = False
            around = self.near[level][nodes]  # node -1 reads the last row, masked below
            around = np.where(nodes[:, :, None] >= 0, around, -1).reshape(active.size, -1)
            around = np.where(seen[r, around], -1, around)
            # the same neighbour may come from two nodes: keep its first mention
            order = np.argsort(around, axis=1, kind="stable")
            sorted_ = np.take_along_axis(around, order, axis=1)
            twice = np.zeros_like(sorted_, dtype=bool)
            twice[:, 1:] = sorted_[:, 1:] == sorted_[:, :-1]
            around = np.where(twice, -1, sorted_)
            seen[r, around] = True
            close = np.einsum("qd,qed->qe", queries[active], self.unit[around])
            close = np.where(around >= 0, close, -np.inf)
            all_ids = np.concatenate([ids[active], around], axis=1)
            all_sims = np.concatenate([sims[active], close], axis=1)
            all_open = np.concatenate([open_[active], around >= 0], axis=1)
            best = np.argpartition(-all_sims, ids.shape[1] - 1, axis=1)[:, : ids.shape[1]]
            ids[active] = np.take_along_axis(all_ids, best, axis=1)
            sims[active] = np.take_along_axis(all_sims, best, axis=1)
            open_[active] = np.take_along_axis(all_open, best, axis=1) & (ids[active] >= 0)
        best = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        return np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1)

    def _insert(self, lot: np.ndarray) -> None:
        queries = self.unit[lot]
        entry = np.zeros((len(lot), 1), dtype=np.int32)
        mates = queries @ queries.T
        np.fill_diagonal(mates, -np.inf)
        for level in range(len(self.near) - 1, -1, -1):
            entry, sims = self.search(queries, BUILD_BEAM, level, entry)
            here = np.flatnonzero(self.level[lot] >= level)
            if not here.size:
                continue
            own = np.where(self.level[lot] >= level, mates[here], -np.inf)
            top = np.argsort(-own, axis=1)[:, :BUILD_BEAM]
            ids = np.concatenate([entry[here], lot[top].astype(np.int32)], axis=1)
            close = np.concatenate([sims[here], np.take_along_axis(own, top, axis=1)], axis=1)
            order = np.argsort(-close, axis=1, kind="stable")[:, :BUILD_BEAM]
            self._link(level, lot[here], np.take_along_axis(ids, order, 1), np.take_along_axis(close, order, 1))

    def _link(self, level: int, nodes: np.ndarray, ids: np.ndarray, close: np.ndarray) -> None:
        """Neighbours that are nearer to the node than to a chosen one; then the nearest left."""
        near = self.near[level]
        most = near.shape[1] // 2
        between = np.einsum("qad,qbd->qab", self.unit[ids], self.unit[ids])
        chosen = np.zeros(ids.shape, dtype=bool)
        shadow = np.full(ids.shape, -np.inf, dtype=np.float32)
        for c in range(ids.shape[1]):
            ok = (close[:, c] > -np.inf) & (close[:, c] > shadow[:, c]) & (chosen.sum(axis=1) < most)
            chosen[:, c] = ok
            shadow = np.where(ok[:, None], np.maximum(shadow, between[:, c]), shadow)
        keep = np.argsort(-(chosen * 4.0 + np.where(close > -np.inf, close, -9.0)), axis=1, kind="stable")[:, :most]
        picked = np.take_along_axis(np.where(close > -np.inf, ids, -1), keep, axis=1)
        near[nodes, :most] = picked
        source = np.repeat(nodes, most)[picked.ravel() >= 0].astype(np.int32)
        target = picked.ravel()[picked.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        first = np.flatnonzero(np.append(True, target[1:] != target[:-1])) if target.size else target
        count = np.diff(np.append(first, target.size))
        owner = np.repeat(np.arange(first.size), count)
        place = np.arange(target.size) - first[owner] if target.size else target
        used = (near[target[first]] >= 0).sum(axis=1)  # the blanks of a row are its end
        fits = used + count <= near.shape[1]
        free = fits[owner]
        near[target[free], used[owner[free]] + place[free]] = source[free]
        full = np.flatnonzero(~fits)
        full = full[np.argsort(count[full], kind="stable")]  # alike ones together, so that few blanks are padded
        at = 0
        while at < full.size:
            # a bounded number of neighbours at once
            padded = np.arange(1, full.size - at + 1) * (near.shape[1] + count[full[at:]])
            to = at + max(1, int(np.searchsorted(padded, PADDED, "right")))
            some = full[at:to]
            wide = int(count[some[-1]])
            new = np.full((some.size, wide), -1, dtype=np.int32)
            spot = np.arange(wide)[None] < count[some][:, None]
            new[spot] = source[(first[some][:, None] + np.arange(wide)[None])[spot]]
            near[target[first[some]]] = self._trimmed(target[first[some]], np.concatenate([near[target[first[some]]], new], axis=1), near.shape[1])
            at = to

    def _trimmed(self, nodes: np.ndarray, both: np.ndarray, width: int) -> np.ndarray:
        """Of the neighbours of each node half of the nearest and a spread of the others, so that groups stay joined."""
        both = np.sort(both, axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        sims = np.einsum("rcd,rd->rc", self.unit[both], self.unit[nodes])
        sims = np.where(both >= 0, sims, -np.inf)
        order = np.lexsort((both, -sims), axis=1)
        ranked = np.take_along_axis(both, order, axis=1)
        half, size = width // 2, (both >= 0).sum(axis=1)
        kept = np.full((nodes.size, width), -1, dtype=np.int32)
        kept[:, :half] = ranked[:, :half]
        for n in np.unique(size):
            if n > half:
                here = np.flatnonzero(size == n)
                kept[here, half:] = ranked[here][:, half + np.linspace(0, n - half - 1, width - half).astype(int)]
        kept = np.sort(kept, axis=1)
        kept[:, 1:][kept[:, 1:] == kept[:, :-1]] = -1
        # the blanks behind the others, which stay by number
        return np.take_along_axis(kept, np.argsort(kept < 0, axis=1, kind="stable"), axis=1)

    def unreached(self) -> np.ndarray:
        """Nodes that no path of level 0 leads to from the entry."""
        known = np.zeros(len(self.unit) + 1, dtype=bool)  # the last one takes the blanks
        edge = np.arange(min(1, len(self.unit)))
        while edge.size:
            known[edge] = True
            around = np.unique(self.near[0][edge])
            edge = around[(around >= 0) & ~known[around]]
        return np.flatnonzero(~known[:-1]).astype(np.int32)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, unit=self.unit, level=self.level, **{f"near{i}": x for i, x in enumerate(self.near)})
        return out.getvalue()

    @staticmethod
    def load(data: bytes) -> Graph:
        made = Graph.__new__(Graph)
        with np.load(io.BytesIO(data)) as z:
            made.unit, made.level = z["unit"], z["level"]
            made.near = [z[f"near{i}"] for i in range(sum(k.startswith("near") for k in z.files))]
        return made


def unit_rows(vectors: list) -> np.ndarray:
    rows = np.asarray(np.stack(vectors), dtype=np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the squares
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def candidates(graph: Graph, queries: np.ndarray, threshold: float) -> list[np.ndarray]:
    """Per query the nodes at or above a cosine (within rounding of single precision).

    The beam is doubled until an audit of queries from all over the block against all
    nodes finds the wanted recall, both of their nearest nodes, whatever the cosine, and
    of their links. Queries whose whole beam is above the threshold may have more: they
    are searched again with wider beams, under an audit of their own. A walk looks at the
    ``2 * LINKS`` neighbours of every place of its beam; where these cost as much as the
    shard's nodes (``WALK_COST``), it is replaced by a scan of the shard, which is exact.
    Nodes that no walk reaches are compared with every query.
    """
    floor = np.float32(threshold - 1e-4)
    single = queries.astype(np.float32)
    found: list[np.ndarray] = [None] * len(single)
    stray = graph.unreached()
    work = [(np.arange(len(single)), FIRST_BEAM)]
    while work:
        rows, beam = work.pop()
        beam = _audited_beam(graph, single[rows], beam, floor, stray)
        more = []
        for at in range(0, rows.size, LOT):
            lot = rows[at : at + LOT]
            if beam is None:
                for i, row in zip(lot.tolist(), single[lot] @ graph.unit.T):
                    found[i] = np.flatnonzero(row >= floor)
                continue
            ids, sims = _walk(graph, single[lot], beam, stray)
            hits = sims >= floor
            for i, row, ok in zip(lot.tolist(), ids, hits):
                found[i] = np.unique(row[ok])
            more.append(lot[hits[:, :beam].all(axis=1)])
        if more and (full := np.concatenate(more)).size:
            work.append((full, beam * 4))
    return found


def _walk(graph: Graph, queries: np.ndarray, beam: int, stray: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The beam of each query, with the stray nodes behind it."""
    ids, sims = graph.search(queries, beam)
    if not stray.size:
        return ids, sims
    return np.hstack([ids, np.tile(stray, (len(queries), 1))]), np.hstack([sims, queries @ graph.unit[stray].T])


def _audited_beam(graph: Graph, queries: np.ndarray, beam: int, floor: np.float32, stray: np.ndarray) -> int | None:
    """The first beam from ``beam`` on whose audit passes; none if the shard is to be scanned.

    The audit compares ``AUDIT`` queries from all over the block with every node, however
    many queries there are.
    """
    n, k = len(graph.unit), min(NEAREST, len(graph.unit))
    size = min(len(queries), AUDIT)
    some = queries[np.linspace(0, len(queries) - 1, size).astype(int)]
    while beam * 2 * LINKS * WALK_COST < n:
        near, near_found, links, links_found = 0, 0, 0, 0
        for at in range(0, size, LOT):
            lot = some[at : at + LOT]
            ids, sims = _walk(graph, lot, beam, stray)
            true = lot @ graph.unit.T
            got = np.zeros((len(lot), n + 1), dtype=bool)
            got[np.arange(len(lot))[:, None], ids] = True  # blanks are the last column
            nearest = np.argpartition(-true, k - 1, axis=1)[:, :k]
            near += nearest.size
            near_found += np.take_along_axis(got, nearest, axis=1).sum()
            # a full beam has no room for all links and is searched again
            linked = (true >= floor) & ~(sims[:, :beam] >= floor).all(axis=1)[:, None]
            links += linked.sum()
            links_found += (linked & got[:, :n]).sum()
        if near_found >= RECALL * near and links_found >= RECALL * links:
            return beam
        beam *= 2
    return None


def search_shard(graph: Graph, node_ids: np.ndarray, weights: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, nodes: np.ndarray, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each query into a shard, weighted by copies, and a forest that joins them.

    Cosines are verified in double precision. Of the links only what connects is given:
    one link per query and one per merge of the shard's nodes.
    """
    root = np.arange(len(nodes))
    totals = np.zeros(len(queries), dtype=np.int64)
    forest: list[tuple[int, int]] = []
    for i, near in enumerate(candidates(graph, queries, threshold)):
        near = near[node_ids[near] != query_ids[i]]
        near = near[nodes[near] @ queries[i] >= threshold]
        if not near.size:
            continue
        totals[i] = weights[near].sum()
        roots = root[near]
        first = int(roots.min())
        forest.append((int(query_ids[i]), int(node_ids[first])))
        for other in np.unique(roots[roots != first]).tolist():
            forest.append((int(node_ids[first]), int(node_ids[other])))
            root[root == other] = first
    return totals, forest


def _classes(vectors: DataFrame) -> DataFrame:
    """Equal vectors of a label as one row: ``cls, label, vec, dim, copies, first``."""
    usable = vectors.where(F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)).select("id", "label", "vec")
    usable = usable.where(
        F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    grouped = usable.groupBy("label", "vec").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    return grouped.select(F.monotonically_increasing_id().alias("cls"), "label", "vec", F.size("vec").alias("dim"), "copies", "first")


def digest(label: Column, vec: Column) -> Column:
    """A label and a vector of doubles as one short key; the two zeros are one number."""
    numbers = F.transform(vec, lambda x: x + F.lit(0.0))
    return F.sha2(F.to_json(F.struct(label.alias("l"), numbers.alias("v"))), 256)


def near_duplicates(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
    shard_rows: int | None = None,
) -> DataFrame:
    """``vectors`` with ``n_links``, ``component_id`` and ``kept``.

    Vectors of one label and length are compared. Equal ones are one class with a count.
    Classes are dealt to shards of about ``shard_rows``, by default as many as make
    ``SHARD_BYTES`` of doubles; a graph is built per shard and written once; every class searches every shard of its label, block by block. No
    pairs leave a task: it gives counts and a forest, and components join the forests.
    Vectors without label, null, empty or zero ones and those with null or non-finite
    parts link with nothing. Null ids are never the smallest; a component of null ids
    only has a null id, and a null id is kept only if its component is null. Columns
    named like the results are replaced; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    kept = without(vectors, "n_links", "component_id", "kept")
    names = kept.columns
    doubles = F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double"))
    vectors = vectors.select(
        boxed(kept).alias("box"), F.col(f"`{key}`").alias("id"), F.col(f"`{label}`").alias("label"), doubles.alias("vec")
    )
    classes = pinned(_classes(vectors))
    room = F.lit(shard_rows) if shard_rows else F.greatest(F.floor(F.lit(SHARD_BYTES // 8) / F.col("dim")), F.lit(1))
    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).select(
        "label", "dim", F.ceil(F.col("n") / room).cast("int").alias("shards")
    )
    dealt = pinned(
        classes.join(sizes, ["label", "dim"]).select(
            "cls", "label", "dim", "vec", "copies", "shards", F.pmod(F.xxhash64("cls"), F.col("shards")).cast("int").alias("shard")
        )
    )
    tasks = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = ["label", "dim", "shard"]
    kind = vectors.schema["label"].dataType.simpleString()

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cls")
        unit = unit_rows(part["vec"].tolist())
        first = part.iloc[0]
        return pd.DataFrame(
            {
                "label": [first["label"]],
                "dim": [first["dim"]],
                "shard": [first["shard"]],
                "shards": [first["shards"]],
                "ids": [part["cls"].to_numpy()],
                "weights": [part["copies"].to_numpy()],
                "nodes": [unit.tobytes()],
                "graph": [Graph(unit).dump()],
            }
        )

    graphs = pinned(
        dealt.repartition(tasks, *place)
        .groupBy(*place)
        .applyInPandas(build, f"label {kind}, dim int, shard int, shards int, ids array<long>, weights array<long>, nodes binary, graph binary")
    )
    every = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    # a shard's own rows are one block of queries; each block goes to every shard
    blocks = dealt.withColumnRenamed("shard", "block").select("cls", "label", "dim", "vec", "block", every.alias("shard"))
    trees = graphs.select("label", "dim", "shard", "ids", "weights", "nodes", "graph", every.alias("block"))
    meet = [*place, "block"]

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": [], "n": []})
        tree = left.iloc[0]
        ids = np.asarray(tree["ids"])
        nodes = np.frombuffer(tree["nodes"], dtype=np.float64).reshape(ids.size, -1)
        queries = right["cls"].to_numpy()
        totals, forest = search_shard(
            Graph.load(tree["graph"]), ids, np.asarray(tree["weights"]), queries, unit_rows(right["vec"].tolist()), nodes, threshold
        )
        counted = pd.DataFrame({"a": queries, "b": -1, "n": totals})[totals > 0]
        links = pd.DataFrame(forest, columns=["a", "b"]).assign(n=0)
        return pd.concat([counted, links])

    found = pinned(
        trees.repartition(tasks, *meet)
        .groupBy(*meet)
        .cogroup(blocks.repartition(tasks, *meet).groupBy(*meet))
        .applyInPandas(search, "a long, b long, n long")
    )
    links = found.where("b < 0").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    roots = components(found.where("b >= 0").select("a", "b")).withColumnRenamed("node", "cls")
    smallest = classes.join(roots, "cls").groupBy("root").agg(F.min("first").alias("smallest"))
    of_class = (
        classes.join(links, "cls", "left")
        .join(roots.join(smallest, "root").select("cls", "smallest"), "cls", "left")
        .select(
            digest(F.col("label"), F.col("vec")).alias("place"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("smallest", "first").alias("component_id"),
            F.lit(True).alias("usable"),
        )
    )
    rows = vectors.select("box", "id", F.when(F.col("label").isNotNull(), digest(F.col("label"), F.col("vec"))).alias("place"))
    # the rows of a vector that very many copies share are spread
    joined = lookup_join(rows, of_class, "place", spread_by="id")
    component = F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("id"))
    return joined.select(
        *unboxed(names, "box"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
