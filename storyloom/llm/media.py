"""Copies among pictures: local descriptors, joined by Hamming tables, agreed on by geometry.

Corners are found on a pyramid of scales.  Around each, a patch is turned to the
direction of its intensity centroid and described by 128 comparisons of pixel
pairs, which brightness and contrast leave as they are.  Descriptors that agree on
the bits of one of several tables meet; those within the Hamming radius are
matches.  Each match votes for a similarity transform between its two pictures
(turn, scale, shift, in overlapping bins), and pictures with enough corners behind
one transform are linked: a crop, a brightened or turned copy.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from storyloom.llm.common import components, frames, groups, octets, stored

#: Corners described in a picture, strongest first.
CORNERS = 20
#: Shrinking from one level of the pyramid to the next, and levels.
STEP, LEVELS = 1.25, 3
#: Half the side of a patch, and directions a patch is turned to.
HALF, TURNS = 9, 36
BITS = 128
#: Tables, bytes of a table's key, and bits in which matches may differ.
TABLES, KEY_BYTES, RADIUS = 3, 3, 15
#: Corners that must agree on one transform.
VOTES = 3
#: Corners of one key that are compared by one task; larger buckets are cut into parts.
BLOCK = 32_768
#: Pictures dealt out together, and records that a destination holds, about.
TOGETHER, HELD = 8192, 500_000
#: Matches handed on together.
MATCHES = 200_000

_RNG = np.random.default_rng(77)
_PAIRS = np.clip(np.round(_RNG.normal(0, HALF / 2.0, (BITS, 2, 2))), 1 - HALF, HALF - 1)
_TURN = 2 * np.pi / TURNS
_ROTATED = np.clip(np.stack([np.round(_PAIRS @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])).astype(int)
                             for a in np.arange(TURNS) * _TURN]), -HALF - 1, HALF + 1)
_GRID = np.mgrid[-HALF:HALF + 1, -HALF:HALF + 1]
_DISC = (_GRID ** 2).sum(axis=0) <= HALF ** 2


def read_pgm(data: bytes) -> np.ndarray | None:
    """Grey picture of a binary PGM, None for anything else."""
    parts = data.split(None, 4) if data else []
    if len(parts) < 4 or parts[0] != b"P5" or not all(p.isdigit() for p in parts[1:4]):
        return None
    width, height = int(parts[1]), int(parts[2])
    body = data[len(data) - width * height:] if width * height else b""
    return np.frombuffer(body, np.uint8).reshape(height, width) if len(body) == width * height and width * height else None


def write_pgm(pixels: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + np.clip(np.round(pixels), 0, 255).astype(np.uint8).tobytes()


def _boxed(x: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2r + 1 of a stack of pictures, edges repeated."""
    n = 2 * r + 1
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r, r)
        wide, size = np.pad(x, pad, mode="edge"), x.shape[axis]
        x = sum(wide[:, k:k + size] if axis == 1 else wide[:, :, k:k + size] for k in range(n)) * np.float32(1 / n)
    return x


def _shrunk(x: np.ndarray, by: float) -> np.ndarray:
    """A stack of pictures, smaller by a factor, by linear interpolation."""
    height, width = (int(n / by) for n in x.shape[1:])
    y, u = np.linspace(0, x.shape[1] - 1, height), np.linspace(0, x.shape[2] - 1, width)
    i, j = np.minimum(y.astype(int), x.shape[1] - 2), np.minimum(u.astype(int), x.shape[2] - 2)
    a, b = (y - i)[None, :, None].astype(np.float32), (u - j)[None, None, :].astype(np.float32)
    top, low = x[:, i], x[:, i + 1]
    return (top[:, :, j] * (1 - b) + top[:, :, j + 1] * b) * (1 - a) + (low[:, :, j] * (1 - b) + low[:, :, j + 1] * b) * a


def _peaks(smooth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Picture, row, column and strength of the corners of a stack (Harris' measure, greatest within two pixels)."""
    dy, dx = np.gradient(smooth, axis=(1, 2))
    xx, yy, xy = (_boxed(v, 2) for v in (dx * dx, dy * dy, dx * dy))
    strength = xx * yy - xy * xy - np.float32(0.05) * (xx + yy) ** 2
    edge = HALF + 2
    inner = strength[:, edge:-edge, edge:-edge]
    peak = inner > 1.0
    for y in range(-2, 3):
        for x in range(-2, 3):
            if y or x:
                peak &= inner >= strength[:, edge + y:strength.shape[1] - edge + y, edge + x:strength.shape[2] - edge + x]
    which, row, col = np.nonzero(peak)
    return which, row + edge, col + edge, inner[which, row, col]


def describe(stack: np.ndarray) -> tuple[np.ndarray, ...]:
    """Picture, x, y, level, turn and descriptor of the strongest corners of equally large pictures."""
    level, levels, scale, seen = stack.astype(np.float32), [], 1.0, []
    for at in range(LEVELS):
        if at:
            level, scale = _shrunk(level, STEP), scale * STEP
        if min(level.shape[1:]) < 2 * HALF + 6:
            break
        levels.append(_boxed(level, 1))
        which, row, col, strength = _peaks(levels[-1])
        seen.append(np.stack([which, -strength, np.full(len(which), at), row, col]))
    found = np.concatenate(seen, axis=1) if seen else np.zeros((5, 0))
    found = found[:, np.lexsort(found[::-1])]
    first = np.searchsorted(found[0], np.arange(len(stack)))
    found = found[:, np.arange(found.shape[1]) - first[found[0].astype(int)] < CORNERS]
    out = []
    for at, smooth in enumerate(levels):
        which, _, _, row, col = found[:, found[2] == at].astype(int)
        patch = smooth[which[:, None, None], row[:, None, None] + _GRID[0], col[:, None, None] + _GRID[1]] * _DISC
        angle = np.arctan2((patch * _GRID[0]).sum(axis=(1, 2)), (patch * _GRID[1]).sum(axis=(1, 2)))
        turn = np.round(angle / _TURN).astype(int) % TURNS
        pair = _ROTATED[turn]  # corner, bit, end, (x, y)
        value = smooth[which[:, None, None], row[:, None, None] + pair[..., 1], col[:, None, None] + pair[..., 0]]
        bits = np.packbits(value[..., 0] < value[..., 1], axis=1)
        out.append((which, col * STEP ** at, row * STEP ** at, np.full(len(which), at), turn, bits))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else (*[np.zeros(0, int)] * 5, np.zeros((0, BITS // 8), np.uint8))


#: A corner in a picture's blob: x and y in quarters of a pixel, level, turn, descriptor.
_CORNER = np.dtype([("x", "<u2"), ("y", "<u2"), ("level", "u1"), ("turn", "u1"), ("bits", "u1", BITS // 8)])


def corners(pictures: DataFrame, key: str, picture: str) -> DataFrame:
    """``_key``, two hashes and the packed corners of each picture; pictures that cannot be read have none."""
    kind = pictures.schema[key].dataType.simpleString()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            by_shape: dict[tuple, list] = {}
            found = [b""] * len(rows)
            for i, data in enumerate(rows["_p"]):
                pixels = read_pgm(data) if data is not None else None
                if pixels is not None:
                    by_shape.setdefault(pixels.shape, []).append((i, pixels))
            for same in by_shape.values():
                for at in range(0, len(same), 64):
                    part = same[at:at + 64]
                    which, x, y, level, turn, bits = describe(np.stack([p for _, p in part]))
                    packed = np.zeros(len(which), _CORNER)
                    for name, value in (("x", np.round(4 * x)), ("y", np.round(4 * y)), ("level", level), ("turn", turn), ("bits", bits)):
                        packed[name] = value
                    for w in np.unique(which):
                        found[part[w][0]] = packed[which == w].tobytes()
            yield pd.DataFrame({"_key": rows["_k"], "_h": rows["_h"], "_g": rows["_g"], "corners": found})
    return frames(_hashed(pictures, key, picture), work, f"_key {kind}, _h long, _g long, corners binary")


def _hashed(pictures: DataFrame, key: str, picture: str) -> DataFrame:
    whole = F.coalesce(F.col(picture), F.lit(b""))
    return pictures.select(F.col(key).alias("_k"), F.col(picture).alias("_p"), F.xxhash64(whole).alias("_h"),
                           F.xxhash64(whole, F.lit(5)).alias("_g"))


#: A corner under way: its picture and itself.
_RECORD = np.dtype([("node", "<i8"), ("corner", _CORNER)])


def _codes(bits: np.ndarray, t: int) -> np.ndarray:
    """A table's keys of some descriptors, as numbers."""
    return sum(bits[:, t * KEY_BYTES + i].astype(np.int64) << 8 * i for i in range(KEY_BYTES)) + (t << 8 * KEY_BYTES)


def _mixed(*values: np.ndarray) -> np.ndarray:
    """A hash of numbers, a row at a time."""
    out = np.uint64(0)
    for v in values:
        out = (out ^ np.asarray(v).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out = out ^ (out >> np.uint64(29))
    return out


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    """Corners of pictures in stretches; of equal pictures of a task those of one."""
    seen: set[int] = set()
    held: list[pd.DataFrame] = []
    for rows in _ended(batches):
        if rows is not None:
            rows = rows.drop_duplicates("node")
            rows = rows[~rows["node"].isin(seen)]
            seen.update(rows["node"].tolist())
            held.append(rows)
        if held and (rows is None or sum(map(len, held)) >= TOGETHER):
            whole, held = pd.concat(held), []
            corner = np.frombuffer(b"".join(whole["corners"]), _CORNER)
            out = np.empty(len(corner), _RECORD)
            out["node"] = np.repeat(whole["node"].to_numpy(np.int64), whole["corners"].map(len).to_numpy(np.int64) // _CORNER.itemsize)
            out["corner"] = corner
            yield out


def _ended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def _large(found: DataFrame, rows: int, block: int) -> dict[int, int]:
    """Keys of more corners than a block, and how many; a task names only what it has often, which no larger key escapes."""
    least = max(2, block // (2 * (rows // TOGETHER + found.rdd.getNumPartitions() + 1)))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for records in _records(batches):
            for t in range(TABLES):
                code, n = np.unique(_codes(records["corner"]["bits"], t), return_counts=True)
                yield pd.DataFrame({"code": code[n >= least], "n": n[n >= least]})
    counted = frames(found.select("node", "corners"), work, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    # one number for each block of corners at most
    return {r.code: r.n for r in counted.where(F.col("n") > block // 2).collect()}


def matches(found: DataFrame, block: int = BLOCK, radius: int = RADIUS) -> DataFrame:
    """Pairs of corners of different pictures (a < b) that meet in a table within the radius.

    In a bucket every two corners are compared, so matches grow with the square of a
    group of pictures that share a corner, as their links do.  Corners are dealt out by
    key, packed by destination, once for each table; buckets beyond a block are cut into
    parts, and every two parts are compared: a task holds a block or the buckets of a
    destination, and gives its matches piece by piece.  A pair that several tables bring
    together is given by the first.
    """
    kind, rows = found.schema["node"].dataType.simpleString(), found.count()
    large = _large(found, rows, block)
    hot = np.array(sorted(large), np.int64)
    cuts = np.array([-(-2 * large[c] // block) for c in sorted(large)], np.int64)
    places = max(128, -(-rows * CORNERS * TABLES // HELD))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for records in _records(batches):
            for t in range(TABLES):
                code = _codes(records["corner"]["bits"], t)
                at = np.minimum(np.searchsorted(hot, code), max(0, len(hot) - 1))
                parts = np.where(hot[at] == code, cuts[at], 1) if len(hot) else np.ones(len(code), np.int64)
                row = np.repeat(np.arange(len(code)), parts)
                other = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                mine = (_mixed(records["node"][row]) % parts[row].astype(np.uint64)).astype(np.int64)
                i, j = np.minimum(mine, other), np.maximum(mine, other)
                place = (_mixed(code[row], i, j) % np.uint64(places)).astype(np.int64)
                order = np.lexsort((code[row], j, i, place))
                row, where = row[order], np.stack([place, i, j])[:, order]
                first = np.concatenate(([0], np.flatnonzero((np.diff(where) != 0).any(axis=0)) + 1)) if len(row) else np.zeros(0, int)
                # by bytes of equal meaning, which compress
                blobs = [records[row[b:e]].view(np.uint8).reshape(-1, _RECORD.itemsize).T.tobytes() for b, e in zip(first, [*first[1:], len(row)])]
                yield pd.DataFrame({"place": where[0, first], "t": np.full(len(first), t), "i": where[1, first], "j": where[2, first], "records": blobs})
    dealt = frames(found.select("node", "corners"), deal, "place int, t int, i int, j int, records binary")

    def made(corner: np.ndarray, node: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
        out = {"a": node[a], "b": node[b]}
        for c, by in (("x", 4), ("y", 4), ("level", 1), ("turn", 1)):
            out |= {f"{c}a": corner[c][a] / by, f"{c}b": corner[c][b] / by}
        return pd.DataFrame(out)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in groups(batches, "place", 1):
            for (t, _, _), same in rows.groupby(["t", "i", "j"], sort=False):
                yield from compared(t, np.concatenate([np.ascontiguousarray(
                    np.frombuffer(r, np.uint8).reshape(_RECORD.itemsize, -1).T).reshape(-1).view(_RECORD) for r in same["records"]]))

    def compared(t: int, records: np.ndarray) -> Iterator[pd.DataFrame]:
        code = _codes(records["corner"]["bits"], t)
        order = np.lexsort((records["node"], code))
        corner, node, bucket = records["corner"][order], records["node"][order], code[order]
        again = np.zeros(len(order), bool)  # corners of a picture that several tasks gave
        again[1:] = (node[1:] == node[:-1]) & (corner[1:] == corner[:-1])
        corner, node, bucket = corner[~again], node[~again], bucket[~again]
        words = np.ascontiguousarray(corner["bits"]).view(np.uint64)
        earlier = [_codes(corner["bits"], e) for e in range(t)]
        first = np.concatenate(([0], np.nonzero(bucket[1:] != bucket[:-1])[0] + 1))
        after = np.diff(np.concatenate((first, [len(bucket)])))
        end = np.repeat(first + after, after)
        # every corner with the next in its bucket, with the next but one, and so on to the end of the longest bucket
        at, step, held, left, right = np.arange(len(bucket)), 0, 0, [], []
        while len(at):
            step += 1
            at = at[at + step < end[at]]
            pair = at[(node[at] != node[at + step]) & (np.bitwise_count(words[at] ^ words[at + step]).sum(axis=1) <= radius)]
            for keys in earlier:
                pair = pair[keys[pair] != keys[pair + step]]
            left.append(pair)
            right.append(pair + step)
            held += len(pair)
            if held >= MATCHES or not len(at):
                yield made(corner, node, np.concatenate(left), np.concatenate(right))
                held, left, right = 0, [], []
    names = ", ".join(f"{c}{s} {t}" for c, t in (("x", "float"), ("y", "float"), ("level", "tinyint"), ("turn", "tinyint")) for s in "ab")
    return frames(dealt.repartition("place").sortWithinPartitions("place"), work, f"a {kind}, b {kind}, {names}")


def agreed(found: DataFrame, votes: int = VOTES, cell: float = 12.0) -> DataFrame:
    """Links (a, b) whose matches agree on one turn, scale and shift by at least ``votes`` corners of each picture."""
    # by pair first: a match is moved once and not once for each of its bins, and pairs of too few matches, as most strangers are, have no bins
    found = found.repartition("a", "b").withColumn("_n", F.count("*").over(Window.partitionBy("a", "b"))).where(F.col("_n") >= votes)
    # bins overlap by half in each quantity, so a match near the edge of one is inside another; all matches of a bin
    # are turned by its middle, as their own directions are off by a step
    turn = F.pmod((F.col("turnb") - F.col("turna")).cast("int"), F.lit(TURNS))
    middles = F.array_distinct(F.array(*[F.pmod((F.floor((turn + k) / 3) * 3 + 1 - k), F.lit(TURNS)).cast("int") for k in (0, 1)]))
    both = lambda v: F.array(F.floor(v / cell), F.floor(v / cell + 0.5) + F.lit(1 << 20))
    angle, scale = F.col("turn") * _TURN, F.pow(F.lit(STEP), F.col("scale"))
    x = F.col("xb") - scale * (F.cos(angle) * F.col("xa") - F.sin(angle) * F.col("ya"))
    y = F.col("yb") - scale * (F.sin(angle) * F.col("xa") + F.cos(angle) * F.col("ya"))
    pairs = ["a", "b", F.struct("xa", "ya").alias("pa"), F.struct("xb", "yb").alias("pb"), "scale", "turn"]
    cells = found.withColumn("scale", F.col("levelb") - F.col("levela")).withColumn("turn", F.explode(middles))
    cells = cells.select(*pairs, F.explode(both(x)).alias("x"), y.alias("_y"))
    cells = cells.withColumn("y", F.explode(both(F.col("_y"))))
    one = cells.groupBy("a", "b", "scale", "turn", "x", "y").agg(F.size(F.collect_set("pa")).alias("na"), F.size(F.collect_set("pb")).alias("nb"))
    return one.where((F.col("na") >= votes) & (F.col("nb") >= votes)).select("a", "b").distinct()


def copies(pictures: DataFrame, key: str = "media_id", picture: str = "picture") -> DataFrame:
    """``key``, n_corners, n_links and class_id (smallest key reachable over links) of every row.

    Equal pictures are one before anything is compared, and count as linked to
    each other's class, not as links.  Nulls, unreadable and flat pictures have no
    corners and are alone, but for equal ones; a null key names no class.
    """
    # corners are written where they are found and move once, with their keys; the few equal pictures of other tasks meet there
    rows = stored(corners(pictures, key, picture).withColumn("node", F.xxhash64("_h", "_g")), "corners")
    links = stored(agreed(matches(rows.select("node", "corners"))), "links")
    nodes = rows.groupBy("_h", "_g", "node").agg(F.min("_key").alias("least"), F.max(F.length("corners")).alias("size"))
    roots = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("class_id"))
    named = named.join(least, "root").join(degree, "node", "left")
    named = named.select("_h", "_g", "class_id", "n_links", (F.col("size") / _CORNER.itemsize).alias("n_corners"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select(F.col("_key").alias(key), "_h", "_g").join(named, ["_h", "_g"]).select(key, zero("n_corners"), zero("n_links"), "class_id")


# ---------------------------------------------------------------------------------- pictures out of pages


def draw(page: bytes) -> np.ndarray:
    """A picture of 96 x 96 that the whole page determines: a mosaic of greys, softened."""
    tiles = np.frombuffer(hashlib.shake_256(page).digest(24 * 24), np.uint8).reshape(1, 24, 24).astype(np.float32)
    return _boxed(tiles.repeat(4, 1).repeat(4, 2), 1)[0]


def edit(pixels: np.ndarray, how: int) -> np.ndarray:
    """A crop, and by ``how`` also darker, turned or noisy."""
    y, x = how // 7 % 20, how // 140 % 20
    out = pixels[y:y + 76, x:x + 76]
    kind = how % 4
    if kind == 1:
        return out * 0.7 + 15
    if kind == 2:
        return np.rot90(out)
    if kind == 3:
        return out + np.random.default_rng(how).normal(0, 4, out.shape)
    return out


def pictures_of(pages: DataFrame, key: str = "page_id", html: str = "html", every: int = 7) -> DataFrame:
    """A picture of each page, and an edited copy of those whose crc32 of the id is divisible by ``every``.

    media_id is twice the page's id, one more for the copy.
    """
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for k, page in zip(rows["_k"], rows["_t"]):
                pixels = draw(page)
                out.append((2 * k, k, write_pgm(pixels)))
                how = zlib.crc32(str(k).encode())
                if how % every == 0:
                    out.append((2 * k + 1, k, write_pgm(edit(pixels, how // every))))
            yield pd.DataFrame(out, columns=["media_id", "page_id", "picture"])
    named = pages.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_k"), octets(html).alias("_t"))
    return frames(named, work, "media_id long, page_id long, picture binary")
