"""Hard negatives by best-first search of R-trees packed by sort-tile-recursion.

Rows with equal label and vector are one entry with its first ids.  Entries are dealt
into parts by label and the most spread coordinate, ties by a hash, and each part is
tiled further, a coordinate at a time, down to leaves.  A box over a leaf, or over
boxes, gives an interval for each coordinate and, added up, one for the inner product
of a query with anything inside.

A part is searched best first: the box with the greatest possible product is opened
next.  Boxes are dropped whose interval misses every score window, whose labels cannot
serve, and whose greatest product is strictly below the k-th score found; at a tie the
smaller id may still be inside.

A query first searches the part it lies in, which gives it a k-th score to beat, and
then all others.  Trees and queries meet by part in Spark; a task holds one part and
reads its queries as a stream.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import stored

#: Entries of a leaf, boxes of a box, and entries of a part at most (fewer in a small table, so that tasks are many).
LEAF, FAN, PART = 64, 8, 65536
#: Components are held to this size, so that products of vectors fit a long.
MOST = 1 << 24
#: Queries of a part that one task answers.
TASK = 65536
NONE = np.iinfo(np.int64).min


# ---------------------------------------------------------------------------------- one tree


def tiled(vectors: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Order of the rows in which every ``leaf`` of them are a tile: by label, then by one coordinate after the other.

    Coordinates are taken by their spread.  With P leaves to make and d coordinates
    left, rows are cut into P ** (1 / d) slabs along the next, each a number of whole leaves.
    """
    order = np.argsort(labels, kind="stable")
    spread = np.argsort(-vectors.var(axis=0), kind="stable") if len(vectors) else np.empty(0, int)
    slabs = [(0, len(order))]
    for i, at in enumerate(spread):
        if not slabs:
            break
        rest = []
        for a, b in slabs:
            tiles = -(-(b - a) // leaf)
            if tiles <= 1:
                continue
            part = order[a:b]
            # within a slab labels stay together: boxes of one label serve or are dropped whole
            part = order[a:b] = part[np.lexsort((vectors[part, at], labels[part]))] if not i else part[np.argsort(vectors[part, at], kind="stable")]
            pieces = max(2, round(tiles ** (1 / (len(spread) - i))))
            step = leaf * -(-tiles // pieces)
            rest += [(c, min(c + step, b)) for c in range(a, b, step)]
        slabs = rest
    return order


class Tree:
    """Packed boxes over entries in tile order; level 0 are the leaves."""

    def __init__(self, vectors: np.ndarray, labels: np.ndarray, ids: list[list], leaf: int = LEAF, fan: int = FAN,
                 kind: type = np.float64):
        self.vectors, self.labels, self.ids, self.leaf, self.fan = vectors, labels, ids, leaf, fan
        low, high, first, last, self.begin = vectors, vectors, labels, labels, [0]
        boxes: list[tuple[np.ndarray, ...]] = []
        step = leaf
        while True:
            cut = np.arange(0, len(low), step)
            low, high = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            first, last = np.minimum.reduceat(first, cut), np.maximum.reduceat(last, cut)
            boxes.append((low, high, first, last))
            self.begin.append(self.begin[-1] + len(cut))
            if len(cut) == 1:
                break
            step = fan
        self.low, self.high, self.first, self.last = (np.concatenate(x) for x in zip(*boxes))
        self.rows, self.low, self.high = (x.astype(kind) for x in (vectors, self.low, self.high))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest product of each query with each box: a sum of an interval for each coordinate."""
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T

    def search(self, query: np.ndarray, least: np.ndarray, greatest: np.ndarray, label: int, same: bool,
               windows: list[tuple[int, int]], floors: list[int], k: int, skip: object = NONE) -> tuple[list[list[tuple]], int]:
        """For each window (low, high) of scores the best k (-score, id is null, id), and how many leaves were opened.

        ``same`` asks for rows of the label, else for all others.  ``floors`` are scores
        that k rows elsewhere reach, so lower ones are of no use.  One row with the id
        ``skip`` and the query's own vector and label is left out.
        """
        found: list[list[tuple]] = [[] for _ in windows]
        floor = [max(low, f) for (low, _), f in zip(windows, floors)]
        top = len(self.begin) - 2
        heap = [(-int(greatest[-1]), top, 0)]
        opened = 0
        while heap:
            best, level, at = heapq.heappop(heap)
            box = self.begin[level] + at
            if -best < min(floor):
                break  # strictly below what every window asks for, as are all the rest
            if not any(-best >= f and least[box] <= high for f, (_, high) in zip(floor, windows)):
                continue
            if level:
                for child in range(at * self.fan, min((at + 1) * self.fan, self.begin[level] - self.begin[level - 1])):
                    c = self.begin[level - 1] + child
                    if (self.first[c] <= label <= self.last[c]) if same else (self.first[c] != label or self.last[c] != label):
                        heapq.heappush(heap, (-int(greatest[c]), level - 1, child))
                continue
            opened += 1
            rows = slice(at * self.leaf, (at + 1) * self.leaf)
            score = self.rows[rows] @ query
            fits = (self.labels[rows] == label) == same
            for w, (_, high) in enumerate(windows):
                for i in np.nonzero(fits & (score >= floor[w]) & (score <= high))[0].tolist():
                    ids, s = self.ids[rows.start + i], int(score[i])
                    if same and skip is not NONE and skip in ids and np.array_equal(self.rows[rows.start + i], query):
                        ids = list(ids)
                        ids.remove(skip)
                    found[w] += [(-s, x is None, x or 0) for x in ids]
                if len(found[w]) >= k:
                    found[w] = sorted(found[w])[:k]
                    floor[w] = max(floor[w], -found[w][-1][0])
        return [sorted(f)[:k] for f in found], opened


# ---------------------------------------------------------------------------------- jobs


def whole_vectors(rows: DataFrame, vector: str, key: str, label: str, scale: int = 256) -> DataFrame:
    """Rows that take part, as ``id``, ``label`` (long) and ``q``: every component floor(scale * x), all of one length.

    Rows with a null label or vector, or a component that is null or not finite, take
    no part.  Shorter vectors are filled up with zeros; components beyond 2 ** 24
    are held to it.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    at = lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(-float(MOST))))
    use = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & finite).select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
        F.transform(vector, lambda x: at(x).cast("int")).alias("q"))
    size = use.agg(F.max(F.size("q"))).first()[0] or 0
    return use.withColumn("q", F.concat("q", F.array_repeat(F.lit(0), F.lit(size) - F.size("q"))))


def packed(rows: DataFrame, first: int) -> DataFrame:
    """Entries (part, label, q, ids) in tile order, each with the ``first`` smallest ids of its rows (nulls count as largest).

    A window that keeps the first few rows is cut on the map side too, so a vector
    that holds a third of all rows is shuffled as a handful for each task.
    """
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("label", "q").orderBy(F.col("id").asc_nulls_last())))
    entries = ranked.where(F.col("n") <= first).groupBy("label", "q").agg(
        F.sort_array(F.collect_list(F.struct(F.col("id").isNull().alias("none"), "id"))).alias("ids"))
    entries = stored(entries.select("label", "q", F.col("ids.id").alias("ids")), "entries")
    n = entries.count()
    spread = entries.select(F.posexplode("q").alias("at", "x")).groupBy("at").agg(F.var_pop("x").alias("v"))
    widest = spread.orderBy(F.desc("v"), "at").first()
    by = F.element_at("q", widest["at"] + 1) if widest else F.lit(0)
    size = min(PART, max(1024, -(-n // 64)))
    dealt = entries.withColumn("by", by).repartitionByRange(max(1, -(-n // size)), "label", "by", F.xxhash64("q"))

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches), schema=shape)
        if len(whole):
            vectors, labels = _vectors(whole["q"]), whole["label"].to_numpy()
            whole = whole.take(tiled(vectors, labels)).append_column("part", pa.array([TaskContext.get().partitionId()] * len(whole), pa.int32()))
            whole = whole.append_column("place", pa.array(np.arange(len(whole)), pa.int32()))
            yield from whole.select(["part", "place", "label", "q", "ids"]).to_batches(max_chunksize=4096)
    shape = pa.schema([("label", pa.int64()), ("q", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64()))])
    return stored(dealt.select("label", "q", "ids").mapInArrow(tile, "part int, place int, label long, q array<int>, ids array<long>"), "tree")


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 1), np.int32)


def _answers(k: int, same: bool, low: int, high: int):
    """Task that meets entries of a part and then its queries, and answers the queries window by window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, trees, made = None, [], {}, []
        for batch in batches:
            parts = np.stack((batch["part"].to_numpy(), batch["block"].to_numpy()))
            cuts = np.nonzero(np.concatenate(([True], (parts[:, 1:] != parts[:, :-1]).any(axis=0))))[0].tolist()
            for a, b in zip(cuts, [*cuts[1:], len(batch)]):
                rows = batch.slice(a, b - a)
                if part != tuple(parts[:, a]):
                    part, held, trees = tuple(parts[:, a]), [], {}
                entry = pc.equal(rows["qid"], -1).to_numpy(zero_copy_only=False)
                n = int(entry.sum())
                if n:
                    held.append(rows.slice(0, n))
                rows = rows.slice(n)
                if not len(rows) or not held:
                    continue
                if not trees:
                    whole = pa.Table.from_batches(held)
                    entries = _vectors(whole["q"]), whole["label"].to_numpy(), whole["ids"].to_pylist()
                vectors = _vectors(rows["q"])
                # whole numbers in doubles are exact, and quicker, while products stay below 2 ** 53
                top = int(np.abs(vectors).max(initial=1)) * int(np.abs(entries[0]).max(initial=1)) * vectors.shape[1]
                kind = np.float64 if top < 1 << 52 else np.int64
                if kind not in trees:
                    trees[kind] = Tree(*entries, kind=kind)
                tree, vectors = trees[kind], vectors.astype(kind)
                least, greatest = tree.bounds(vectors)
                for i, (qid, label, ids, scores, floors) in enumerate(zip(
                        *(rows[c].to_pylist() for c in ("qid", "label", "ids", "scores", "floors")))):
                    # low * positive <= 100 * negative <= high * positive, in whole numbers
                    windows = [(-(-low * s // 100), high * s // 100) for s in scores] if not same else [(NONE, -NONE - 1)]
                    floors = floors or [NONE] * len(windows)
                    found, opened = tree.search(vectors[i], least[i], greatest[i], label, same, windows,
                                                [NONE if f is None else f for f in floors], k, ids[0] if same else NONE)
                    made += [(qid, w, -s, None if none else x, opened) for w, f in enumerate(found) for s, none, x in f]
                if len(made) > 10_000:
                    yield _batch(made)
                    made = []
        if made:
            yield _batch(made)
    return run


_ANSWER = "qid long, w int, score long, id long, opened int"


def _batch(made: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), kinds)], ["qid", "w", "score", "id", "opened"])


def _best(answers: DataFrame, k: int) -> DataFrame:
    """The best k answers of every window of every query, by score and then id."""
    place = Window.partitionBy("qid", "w").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return answers.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)


def search(tree: DataFrame, queries: DataFrame, k: int, same: bool, low: int = 0, high: int = 0) -> DataFrame:
    """Best k rows for each window of each query (qid, id, label, q, home, scores): (qid, w, rank, score, id).

    ``same`` searches rows of the query's label, other than itself, without a window;
    else windows are the shares low to high (in hundredths) of ``scores``, among other labels.
    """
    parts = (tree.agg(F.max("part")).first()[0] or 0) + 1
    blocks = queries.agg(F.max("block")).first()[0]
    entries = tree.select("part", F.explode(F.sequence(F.lit(0), F.lit(blocks or 0))).alias("block"), "place", F.lit(-1).cast("long").alias("qid"),
                          "label", "q", "ids", F.lit(None).cast("array<long>").alias("scores"), F.lit(None).cast("array<long>").alias("floors"))

    def asked(part: Column, floors: Column, of: DataFrame) -> DataFrame:
        return of.select(part.cast("int").alias("part"), "block", F.lit(0).alias("place"), "qid", "label", "q", F.array("id").alias("ids"),
                         "scores", floors.cast("array<long>").alias("floors"))

    def met(asking: DataFrame) -> DataFrame:
        rows = entries.unionByName(asking).repartition("part", "block").sortWithinPartitions("part", "block", "qid", "place")
        return stored(rows.mapInArrow(_answers(k, same, low, high), _ANSWER), "answers")
    home = met(asked(F.col("home"), F.lit(None), queries))
    full = _best(home, k).where(F.col("rank") == k).groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
    width = F.lit(1) if same else F.size("scores")
    others = queries.join(full, "qid", "left").select(
        queries["*"], F.transform(F.sequence(F.lit(0), width - 1), lambda w: F.element_at("kth", w)).alias("floors"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")).where("part <> home")
    return _best(home.unionByName(met(asked(F.col("part"), F.col("floors"), others))), k)


def hard_negatives(rows: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                   positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """For each anchor and positive the best negatives: anchor_id, positive_id, rank, negative_id and both scores.

    Positives of an anchor are the best other rows of its label; negatives the best
    rows of other labels whose score is low to high hundredths of the positive's.
    Greater products come first, ties by smaller id, a null id last.  ``anchors`` is
    a condition on ``key``; a null key is no anchor but may be found.  Repeated rows
    are rows of their own, and an anchor that is repeated is answered for each.
    Which rows take part is said at :func:`whole_vectors`; an empty table, or one
    without anchors, gives an empty one; other columns are not read.
    """
    use = stored(whole_vectors(rows.select(F.col(key).alias(key), vector, label), vector, key, label), "vectors")
    tree = packed(use, max(positives + 1, negatives))
    asked = use.where(use["id"].isNotNull()).withColumnRenamed("id", key).where(anchors).withColumnRenamed(key, "id")
    asked = asked.join(tree.select("label", "q", F.col("part").alias("home")), ["label", "q"])
    asked = stored(asked.withColumn("qid", F.monotonically_increasing_id()), "anchors")
    n = asked.count()
    asked = asked.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-n // TASK)))).cast("int"))
    best = stored(search(tree, asked.withColumn("scores", F.lit(None).cast("array<long>")), positives, True)
                  .select("qid", (F.col("rank") - 1).alias("w"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id")), "positives")
    scores = best.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    found = search(tree, stored(asked.join(scores, "qid"), "windows"), negatives, False, low, high)
    return (found.select("qid", "w", "rank", F.col("score").alias("negative_score"), F.col("id").alias("negative_id"))
            .join(best, ["qid", "w"]).join(asked.select("qid", F.col("id").alias("anchor_id")), "qid")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
