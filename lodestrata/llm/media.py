"""Image copies by local descriptors.

Corners of four scales (Harris response, non-maximum suppression, the strongest of
each, more for larger images) get a 256-bit descriptor: binary tests between points
of a smoothed patch, turned by the patch's orientation (its intensity centroid).
The bits are cut into sixteen table keys of 16 bits; corners that share a key in any
table and differ in at most FAR bits are a pair.  Each pair predicts how the whole
query lies in the other image (turn and scale from the two corners, place from
both), and the prediction that most corners follow is fitted again to them: an image
is a copy if enough different corners of both agree on one turn, scale and place.
Edits of brightness and contrast leave the tests alone.

Images are binary graymaps (P5).  Equal images (by SHA-256) form one class; classes
are searched, and a match names its smallest id and how many there are, so copies
are not expanded into pairs.  The index is described once, its corners are written
packed; the queries' corners meet them in blocks of bounded size, one after the other:
the driver holds one block at a time, and nothing but blocks and found copies travels.

Null, unreadable and too small images have no corners and match nothing; rows that
repeat an id or have none take part like others (a null id is never a match's
smallest id unless it is the only one); empty tables give an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cuts, pack, remove, scratch, spill, split_by, temporary, unpack

#: Corners per scale in each AREA pixels of the full image, the scales' ratio, patch radius, bits, and how many bits may differ.
CORNERS, AREA, RATIO, RADIUS, BITS, FAR = (64, 40, 24, 16), 4096, 0.8, 8, 256, 36
_RNG = np.random.default_rng(1234)
_PAIRS = np.clip(np.round(_RNG.normal(0, RADIUS / 2.2, (BITS, 4))), -RADIUS + 2, RADIUS - 2)
_ANGLES = 128

#: Bytes of query corners in a block; a worker holds their descriptors once per table.
BLOCK_BYTES = 8 << 20
TABLES = BITS // 16
#: Pairs under one key from which on they are compared as a matrix; corners of the index that are looked up together.
DENSE, TOGETHER = 4096, 1 << 17
#: A pair's prediction counts corners within so many pixels, radians and scales of it; the fit, within the pixels that find_copies is given.
LOOSE = (8.0, 0.5, 1)
SPOT = 4

POINTS = "digest binary, n long, corners binary"
FOUND = "q_digest binary, digest binary, votes long, dx double, dy double"
#: A packed corner: x, y, angle, scale, descriptor.
_CORNER = ("f8", "f8", "f8", "i1", f"V{BITS // 8}")


def graymap(pixels: np.ndarray) -> bytes:
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + pixels.astype(np.uint8).tobytes()


def read_graymap(data: bytes | None) -> np.ndarray | None:
    """Pixels of a P5 file, None if it is none."""
    m = re.match(rb"P5\s+(\d+)\s+(\d+)\s+255\s", data or b"")
    if not m:
        return None
    w, h = int(m[1]), int(m[2])
    return np.frombuffer(data, np.uint8, w * h, m.end()).reshape(h, w) if len(data) - m.end() >= w * h and w * h else None


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side 2r+1 of a stack of images; borders repeat."""
    p = np.pad(x, ((0, 0), (r + 1, r), (r + 1, r)), mode="edge")
    c = p.cumsum(axis=1, dtype=np.float64).cumsum(axis=2)
    k = 2 * r + 1
    return (c[:, k:, k:] - c[:, :-k, k:] - c[:, k:, :-k] + c[:, :-k, :-k]) / (k * k)


def _shrunk(x: np.ndarray) -> np.ndarray:
    """A stack of images at RATIO of their size."""
    at = [np.clip((np.arange(int(n * RATIO)) + 0.5) / RATIO - 0.5, 0, n - 1) for n in x.shape[1:]]
    (i, a), (j, b) = ((np.minimum(p.astype(np.int64), n - 2), p) for p, n in zip(at, x.shape[1:], strict=True))
    a, b = (a - i)[None, :, None], (b - j)[None, None, :]
    rows = x[:, i] * (1 - a) + x[:, i + 1] * a
    return rows[:, :, j] * (1 - b) + rows[:, :, j + 1] * b


def describe(stack: np.ndarray) -> tuple[np.ndarray, ...]:
    """Image number, x, y (in pixels of the full image), angle, scale and 32 descriptor bytes of the corners of equal-sized images."""
    out: list[tuple[np.ndarray, ...]] = []
    x = stack.astype(np.float64)
    share = max(1.0, x.shape[1] * x.shape[2] / AREA)
    for scale, each in enumerate(CORNERS):
        wanted = int(np.ceil(each * share))
        margin = RADIUS + 3
        if min(x.shape[1:]) <= 2 * margin + 2:
            break
        if scale:
            x = _shrunk(x)
            if min(x.shape[1:]) <= 2 * margin + 2:
                break
        gy, gx = np.gradient(x, axis=(1, 2))
        a, b, c = _box(gx * gx, 1), _box(gy * gy, 1), _box(gx * gy, 1)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        top = r.copy()
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                top = np.maximum(top, np.roll(r, (dy, dx), axis=(1, 2)))
        ok = (r >= top) & (r > 1.0)
        ok[:, :margin] = ok[:, -margin:] = False
        ok[:, :, :margin] = ok[:, :, -margin:] = False
        strength = np.where(ok, r, 0).reshape(len(x), -1)
        k = min(wanted, strength.shape[1])
        best = np.argsort(-strength, axis=1, kind="stable")[:, :k]
        image, rank = np.nonzero(np.take_along_axis(strength, best, 1) > 0)
        at = best[image, rank]
        py, px = at // x.shape[2], at % x.shape[2]
        # orientation: where the patch is brightest, in steps of a full turn
        g = np.arange(-RADIUS, RADIUS + 1)
        patch = x[image[:, None, None], py[:, None, None] + g[None, :, None], px[:, None, None] + g[None, None, :]]
        patch = patch - patch.mean(axis=(1, 2), keepdims=True)
        angle = np.arctan2((patch * g[None, :, None]).sum(axis=(1, 2)), (patch * g[None, None, :]).sum(axis=(1, 2)))
        angle = np.round(angle / (2 * np.pi) * _ANGLES) * (2 * np.pi / _ANGLES)
        fx, fy = ((p + 0.5) / RATIO**scale - 0.5 for p in (px, py))
        cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
        smooth = _box(x, 2)

        def value(u: np.ndarray, v: np.ndarray) -> np.ndarray:
            xs = px[:, None] + np.clip(np.round(cos * u - sin * v), -RADIUS - 2, RADIUS + 2).astype(np.int64)
            ys = py[:, None] + np.clip(np.round(sin * u + cos * v), -RADIUS - 2, RADIUS + 2).astype(np.int64)
            return smooth[image[:, None], ys, xs]

        bits = value(_PAIRS[:, 0], _PAIRS[:, 1]) < value(_PAIRS[:, 2], _PAIRS[:, 3])
        out.append((image, fx, fy, angle, np.full(len(px), scale), np.packbits(bits, axis=1)))
    if not out:
        z, f = np.zeros(0, np.int64), np.zeros(0)
        return z, f, f, f, z, np.zeros((0, BITS // 8), np.uint8)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray, tuple[np.ndarray, ...]]]:
    """Digests of some images of (digest, image) batches, and corners with the image's number among them; a batch's equal images once."""
    for batch in batches:
        images = dict(zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        groups: dict[tuple[int, int], list[tuple[bytes, np.ndarray]]] = {}
        for digest, data in images.items():
            pixels = read_graymap(data.as_py())
            if pixels is not None:
                groups.setdefault(pixels.shape, []).append((digest, pixels))
        for shape, members in groups.items():
            step = max(1, (1 << 18) // (shape[0] * shape[1]))
            for a in range(0, len(members), step):
                part = members[a : a + step]
                image, *corners = describe(np.stack([p for _, p in part]))
                if len(image):
                    yield [d for d, _ in part], image, tuple(corners)


def _points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (digest, image): packed corners, a row per image that has any."""
    for digests, image, (x, y, angle, scale, bits) in _described(batches):
        rows = [(digests[i], len(c[0]), pack(*c)) for i, c in split_by(image, x, y, angle, scale.astype(np.int8), bits)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["digest", "n", "corners"])


Portion = tuple[list[bytes], np.ndarray, tuple[np.ndarray, ...]]


def _joined(rows: dict[bytes, list[np.ndarray]]) -> Portion:
    """Digests, and corners with the number of their image among them."""
    x, y, angle, scale, bits = (np.concatenate(c) for c in zip(*rows.values(), strict=True))
    number = np.repeat(np.arange(len(rows)), [len(c[0]) for c in rows.values()])
    return list(rows), number, (x, y, angle, scale.astype(np.int64), bits.view(np.uint8).reshape(-1, BITS // 8))


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[Portion]:
    """The images of _points() in portions of about TOGETHER corners; a portion's equal images once."""
    rows: dict[bytes, list[np.ndarray]] = {}
    n = 0
    for batch in batches:
        for digest, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if digest in rows:
                continue
            rows[digest] = unpack(data.as_py(), *_CORNER)
            n += len(rows[digest][0])
            if n >= TOGETHER:
                yield _joined(rows)
                rows, n = {}, 0
    if rows:
        yield _joined(rows)


class Corners:
    """Corners of queries, by class, with their tables."""

    def __init__(self, cls: np.ndarray, x: np.ndarray, y: np.ndarray, angle: np.ndarray, scale: np.ndarray, bits: np.ndarray) -> None:
        self.cls, self.x, self.y, self.angle, self.scale = cls, x, y, angle, scale
        self.words = [np.ascontiguousarray(w) for w in bits.view(np.uint64).T]
        keys = bits.view(np.uint16)
        self.tables = []
        for t in range(TABLES):
            order = np.argsort(keys[:, t], kind="stable").astype(np.int32)
            self.tables.append((order, np.searchsorted(keys[order, t], np.arange((1 << 16) + 1))))

    def near(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (corner of a query, row of bits) that share a key and differ in few bits, each once."""
        keys = bits.view(np.uint16)
        words = [np.ascontiguousarray(w) for w in bits.view(np.uint64).T]
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def take(t: int, at: np.ndarray, row: np.ndarray) -> None:
            """Keeps pairs of table t unless both have one key in an earlier table."""
            m = np.ones(len(at), bool)
            for e in range(t):
                k, by = divmod(e, TABLES // len(words))
                m &= ((self.words[k][at] ^ words[k][row]) >> np.uint64(16 * by)) & np.uint64(0xFFFF) != 0
            left.append(at[m].astype(np.int64))
            right.append(row[m].astype(np.int64))

        for t, (order, border) in enumerate(self.tables):
            own = np.argsort(keys[:, t], kind="stable").astype(np.int32)
            begin = np.searchsorted(keys[own, t], np.arange((1 << 16) + 1))
            n, m = np.diff(border), np.diff(begin)
            # keys that many have on both sides: all their pairs at once
            dense = (n * m >= DENSE) & (n > 0)
            for k in np.flatnonzero(dense).tolist():
                at, rows = order[border[k] : border[k + 1]], own[begin[k] : begin[k + 1]]
                step = max(1, (1 << 17) // len(at))
                for a in range(0, len(rows), step):
                    part = rows[a : a + step]
                    far = np.zeros((len(part), len(at)), np.uint16)
                    for mine, other in zip(self.words, words, strict=True):
                        far += np.bitwise_count(other[part][:, None] ^ mine[at][None])
                    x, y = np.nonzero(far <= FAR)
                    take(t, at[y], part[x])
            lo = np.where(dense, 0, border[:-1])[keys[:, t]]
            each = np.where(dense, 0, n)[keys[:, t]]
            for a, b in cuts(np.r_[0, np.cumsum(each)], 1 << 16):
                row = np.repeat(np.arange(a, b, dtype=np.int32), each[a:b])
                skip = (lo[a:b] - (np.cumsum(each[a:b]) - each[a:b])).astype(np.int32)
                at = order[np.arange(len(row), dtype=np.int32) + np.repeat(skip, each[a:b])]
                far = np.zeros(len(row), np.uint16)
                for mine, other in zip(self.words, words, strict=True):
                    far += np.bitwise_count(mine[at] ^ other[row])
                near = far <= FAR
                take(t, at[near], row[near])
        return np.concatenate(left), np.concatenate(right)


def _turn(a: np.ndarray) -> np.ndarray:
    """Angles from -pi to pi."""
    return (a + np.pi) % (2 * np.pi) - np.pi


def consensus(q: np.ndarray, p: np.ndarray, turn: np.ndarray, scale: np.ndarray, least: int, within: float) -> tuple[int, complex]:
    """Votes, and where the query's corner (0, 0) lies, of the turn, scale and place that most pairs agree on.

    q, p: places (x + iy) of pairs of corners in the query and the other image; turn,
    scale: by how much the other's corner is turned and of how many scales more.  Votes are the
    different spots (squares of SPOT pixels: a spot can be a corner at every scale) of the query
    or of the other image, whichever are fewer.  Predictions that fewer than ``least`` pairs
    follow are left out.
    """
    pixels, radians, scales = LOOSE
    best, place = 0, 0j
    predicted = RATIO ** -scale.astype(np.float64) * np.exp(1j * turn)
    followers = _followers(q[None], p[None], turn[None], scale[None])[0] if len(q) <= 1024 else np.concatenate([_one_by_one(q, p, turn, scale, a) for a in range(0, len(q), 256)])
    if followers.max() < least:
        return best, place
    spots = [np.unique(np.floor(c.real / SPOT) + 1j * np.floor(c.imag / SPOT), return_inverse=True)[1] for c in (q, p)]

    def votes(m: np.ndarray) -> int:
        return min(np.count_nonzero(np.bincount(c[m])) for c in spots)

    for i in np.argsort(-followers, kind="stable"):
        if followers[i] < least:
            break
        f = predicted[i]
        alike = (np.abs(_turn(turn - turn[i])) <= radians) & (np.abs(scale - scale[i]) <= scales)
        m = alike & (np.abs(f * (q - q[i]) - (p - p[i])) <= pixels)
        if followers[i] <= best or votes(m) <= best:
            continue
        for _ in range(4):
            dq, dp = q[m] - q[m].mean(), p[m] - p[m].mean()
            if not (np.abs(dq) > 0).any():
                break
            f = (np.conj(dq) * dp).sum() / (np.abs(dq) ** 2).sum()
            if not f or abs(np.angle(f / predicted[i])) > radians or abs(np.log(abs(f / predicted[i]))) > -scales * np.log(RATIO):
                break
            shift = p[m].mean() - f * q[m].mean()
            m = alike & (np.abs(f * q + shift - p) <= within * max(1.0, abs(f)))
            if (n := votes(m)) > best:
                best, place = n, shift
            if n < 2:
                break
    return best, place


def _followers(q: np.ndarray, p: np.ndarray, turn: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """For rows of pairs of corners (a row per candidate): how many pairs follow each one's prediction."""
    pixels, radians, scales = LOOSE
    predicted = RATIO ** -scale.astype(np.float64) * np.exp(1j * turn)
    move = predicted[:, :, None] * (q[:, None, :] - q[:, :, None]) - (p[:, None, :] - p[:, :, None])
    near = move.real**2 + move.imag**2 <= pixels**2
    near &= np.abs(_turn(turn[:, None, :] - turn[:, :, None])) <= radians
    near &= np.abs(scale[:, None, :] - scale[:, :, None]) <= scales
    return near.sum(axis=2)


def _one_by_one(q: np.ndarray, p: np.ndarray, turn: np.ndarray, scale: np.ndarray, a: int, step: int = 256) -> np.ndarray:
    """_followers() of ``step`` predictions of one large candidate."""
    pixels, radians, scales = LOOSE
    h = slice(a, a + step)
    predicted = RATIO ** -scale[h].astype(np.float64) * np.exp(1j * turn[h])
    off = np.abs(predicted[:, None] * (q[None] - q[h, None]) - (p[None] - p[h, None]))
    return ((off <= pixels) & (np.abs(_turn(turn[None] - turn[h, None])) <= radians) & (np.abs(scale[None] - scale[h, None]) <= scales)).sum(axis=1)


def promising(lo: np.ndarray, size: np.ndarray, q: np.ndarray, p: np.ndarray, turn: np.ndarray, scale: np.ndarray, least: int) -> np.ndarray:
    """Which candidates (stretches lo, lo + size of the pairs) have a prediction that at least so many of their pairs follow."""
    out = np.zeros(len(lo), bool)
    for c in np.unique(size[size >= least]).tolist():
        mine = np.flatnonzero(size == c)
        step = max(1, (1 << 16) // (c * c))
        for a in range(0, len(mine), step):
            some = mine[a : a + step]
            at = lo[some][:, None] + np.arange(c)
            out[some] = _followers(q[at], p[at], turn[at], scale[at]).max(axis=1) >= least
    return out


def _search(block, least: int, within: float):
    """For mapInArrow over (digest, corners): which queries of a broadcast block have a copy there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, number, corners = block.value
        queries = Corners(number, *corners)
        for digests, cls, (x, y, angle, scale, bits) in _portions(batches):
            i, j = queries.near(bits)
            order = np.lexsort((queries.cls[i], cls[j]))
            i, j = i[order], j[order]
            a, b = queries.cls[i], cls[j]
            borders = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]), True]) if len(a) else np.zeros(1, np.int64)
            q, p = queries.x[i] + 1j * queries.y[i], x[j] + 1j * y[j]
            turn, steps = _turn(angle[j] - queries.angle[i]), scale[j] - queries.scale[i]
            good = promising(borders[:-1], np.diff(borders), q, p, turn, steps, least)
            out = []
            for lo, hi in zip(borders[:-1][good].tolist(), borders[1:][good].tolist(), strict=True):
                s = slice(lo, hi)
                votes, place = consensus(q[s], p[s], turn[s], steps[s], least, within)
                if votes >= least:
                    out.append((asked[a[lo]], digests[b[lo]], votes, place.real, place.imag))
            if out:
                types = (pa.binary(), pa.binary(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["q_digest", "digest", "votes", "dx", "dy"])

    return run


def _digest(image: Column) -> Column:
    return F.unhex(F.sha2(image, 256))


def find_copies(queries: DataFrame, index: DataFrame, least: int = 5, within: float = 2.0, id_col: str = "id", image_col: str = "image") -> DataFrame:
    """(query_id, match_id, n_copies, votes, dx, dy): which images of the index a query image is cut, turned, resized or edited from.

    least: corners that must agree on a turn, scale and place, each ``within`` so many
    pixels; dx, dy: where the query's corner (0, 0) lies in the match.
    """
    spark = queries.sparkSession
    asked, seen = (t.select(F.col(id_col).cast("long").alias("id"), F.col(image_col).cast("binary").alias("image")).filter("image is not null").withColumn("digest", _digest(F.col("image"))) for t in (queries, index))
    asked_ids = spill(asked.select(F.col("id").alias("query_id"), F.col("digest").alias("q_digest")), "asked")
    path = scratch(spark, "found-images")
    with temporary(spark):
        own = spill(asked.groupBy("digest").agg(F.first("image").alias("image")).mapInArrow(_points, POINTS), "query-corners")
        corners = spill(seen.select("digest", "image").mapInArrow(_points, POINTS), "index-corners")
        blocks = -(-(own.agg(F.sum("n")).first()[0] or 0) * 72 // BLOCK_BYTES)
        try:
            spark.createDataFrame([], FOUND).write.parquet(path)
            for k in range(blocks):
                some = own.filter(F.pmod(F.xxhash64("digest"), F.lit(blocks)) == k).select("digest", "corners").toArrow()  # about BLOCK_BYTES
                if not len(some):
                    continue
                block = spark.sparkContext.broadcast(_joined({d: unpack(c, *_CORNER) for d, c in zip(*(c.to_pylist() for c in some.columns), strict=True)}))
                corners.select("digest", "corners").mapInArrow(_search(block, least, within), FOUND).write.mode("append").parquet(path)
                block.destroy()
            found = spark.read.schema(FOUND).parquet(path)
            best = spill(found.groupBy("q_digest", "digest").agg(F.max(F.struct("votes", "dx", "dy")).alias("b")), "best-images", keep=True)
        finally:
            remove(spark, path)
    named = best.join(seen.groupBy("digest").agg(F.min("id").alias("match_id"), F.count("*").alias("n_copies")), "digest")
    return asked_ids.join(named, "q_digest").select("query_id", "match_id", "n_copies", F.col("b.votes").alias("votes"), F.round("b.dx", 3).alias("dx"), F.round("b.dy", 3).alias("dy"))


def per_query(found: DataFrame, queries: DataFrame, most: int = 1024, id_col: str = "id") -> DataFrame:
    """(query_id, part, n_matches, matches) of find_copies(): the matches of a query as lists of about ``most`` at most, in as many parts as that takes.

    A query without matches has an empty list; parts are numbered from 0, matches are sorted by id.
    """
    totals = found.groupBy("query_id").agg(F.count("*").alias("n_matches"))
    asked = queries.select(F.col(id_col).cast("long").alias("query_id")).distinct().join(totals.withColumnRenamed("query_id", "q"), F.col("query_id").eqNullSafe(F.col("q")), "left").drop("q")
    asked = asked.withColumn("n_matches", F.coalesce("n_matches", F.lit(0).cast("long"))).withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_matches") * 2 / most).cast("int") - 1, F.lit(0)))))
    parts = F.greatest(F.ceil(F.col("n_matches") * 2 / most), F.lit(1))
    dealt = found.join(totals.withColumnRenamed("query_id", "q"), F.col("query_id").eqNullSafe(F.col("q"))).withColumn("p", F.pmod(F.xxhash64("match_id", "votes", "dx", "dy"), parts).cast("int"))
    lists = dealt.groupBy(F.col("query_id").alias("q"), "p").agg(F.sort_array(F.collect_list(F.struct("match_id", "n_copies", "votes", "dx", "dy"))).alias("matches"))
    joined = asked.join(lists, F.col("query_id").eqNullSafe(F.col("q")) & (F.col("part") == F.col("p")), "left")
    return joined.select("query_id", "part", "n_matches", F.coalesce("matches", F.array().cast("array<struct<match_id:bigint,n_copies:bigint,votes:bigint,dx:double,dy:double>>")).alias("matches"))


# --- images for the query: the tables hold none, so vectors are drawn ---

SIDE = 64
_TILES = np.stack([np.roll(np.kron(_RNG.choice([-1.0, 1.0], (16, 16)), np.ones((4, 4))), tuple(_RNG.integers(0, 4, 2)), axis=(0, 1)) for _ in range(64)]).reshape(64, -1)


def draw(vectors: np.ndarray) -> np.ndarray:
    """Pictures of vectors of 64 numbers: sums of fixed patterns of blocks, so that close vectors look alike."""
    return np.clip(128 + 60 * (vectors @ _TILES), 0, 255).astype(np.uint8).reshape(-1, SIDE, SIDE)


def edit(pixels: np.ndarray) -> np.ndarray:
    """A copy cut on all sides, paler and brighter, with a little noise."""
    noise = np.random.default_rng(int(pixels.sum())).integers(-2, 3, pixels.shape)
    return np.clip(pixels * 0.85 + 20 + noise, 0, 255).astype(np.uint8)[5:-7, 6:-4]


def _drawn(edited: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.nan_to_num(np.array(v, np.float64), posinf=0, neginf=0) if v is not None and len(v) == 64 and None not in v else None for v in batch.column(1).to_pylist()]
            some = [i for i, v in enumerate(rows) if v is not None]
            images: list[bytes | None] = [None] * len(rows)
            if some:
                for i, pixels in zip(some, draw(np.stack([rows[i] for i in some])), strict=True):
                    images[i] = graymap(edit(pixels) if edited else pixels)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(images, pa.binary())], names=["id", "image"])

    return run


def drawn(vectors: DataFrame, edited: bool = False, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, image): a picture per row, or its edited copy; null where the vector is no 64 numbers."""
    return vectors.select(F.col(id_col).cast("long").alias("id"), vector_col).mapInArrow(_drawn(edited), "id long, image binary")
