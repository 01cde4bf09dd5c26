"""Problem 7: the most similar vectors for every vector, by a hash-prefix forest.

Each tree gives a vector a long hash string of directions that no other tree uses: symbols of random rotations of the
centred vector (which of 16 coordinates is largest in size, and its sign), then signs, together TEXT_BITS bits. A tree is
the array of all rows sorted by their strings. A row descends to its place in the array, where its longest prefix matches
stand; the number of leading bits that two strings share is the depth at which the two rows part in the tree. From there
it ascends to rows that part from it at smaller and smaller depths, on both sides of its place. All trees are ascended
together: the candidates of all trees are taken level by level, LEVEL bits each, from the deepest level of any tree, until
ASCENT are gathered.

A 256-bit sketch of the centred vector and its product with the centre travel with the string; the cosine of two vectors
as they are is estimated from them. It orders the candidates that a tree offers and those that were gathered.

On Spark: the arrays are range-partitioned by (tree, string, row), so that even a third of all rows with one string is
split, and walked in sorted order with a window that is carried from batch to batch. A candidate is one number: its level,
its estimated distance and its row. To verify them, rows are gathered in blocks: a row's block is named by the smallest
row that it reaches through candidates in two steps; blocks of more than ``block`` rows are split by a hash of the row. In
a block all its own rows are compared with each other by exact cosines. Two candidates of different blocks meet in the
larger one, which the other row visits once, however many candidates it has there, and a visitor is compared with all own
rows. So each vector travels to a few blocks, whatever the number of candidate pairs. A group that had to be split is also
compared part by part, all its pairs of parts and those with the groups it has close candidates in, in tasks of two parts
of at most ``PART`` blocks: a row of a dense group has more close rows than a tree shows it. That is the exact way for
what the bounds on steps and candidates leave out; its vectors travel once for each part, so it costs the square of such a
group.

Exact copies are one row of the forest. They are put back after it: a copy's most similar rows are its other copies,
smallest ids first, then the neighbours of the group, each with its copies. So a group of copies costs its size, not its
square.

Fitted: only the centre, the mean of at most CENTRE_ROWS distinct vectors, those of the smallest hashes. Every row is
indexed. Loss: rows that meet in no tree and no block are missed. recall() measures it against the exact answer for a
stated query set.

A vector is usable if it has ``dim`` finite values that aren't all zero; other rows, also null ids, take no part. Equal
similarity: smaller id first. Repeated rows (same id and vector) count once. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.joins import lookup_join
from millrace.session import cut

DIM = 768
K = 5
LEAST = 0.7
TREES = 32
SYMBOLS, COORDINATES, SIGNS = 5, 16, 32
#: Bits of a string behind its tree: symbols of 5 bits and signs.
TEXT_BITS = SYMBOLS * 5 + SIGNS
#: Bits of a level of a tree.
LEVEL = 4
#: Rows on each side of its place that a row looks at in a tree, and the best of them that the tree offers.
STEPS = 32
PER_TREE = 8
#: Offers that are gathered level by level from all trees, repeats counted, and the candidates that are left of them.
ASCENT = 4 * TREES
CANDIDATES = 16
SKETCH = 256
#: Candidates are kept down to this much below the wanted cosine: the sketch errs by 0.06 at 0.7, less for vectors near the centre.
SLACK = 0.2
BLOCK = 1024
#: Blocks in a part of a split group.
PART = 4
#: Distinct vectors, about, whose mean is the centre.
CENTRE_ROWS = 4000
#: Query vectors that an exact search holds at once.
EXACT_QUERIES = 4096
#: A candidate as one number: level from above, estimated distance, row.
_ROW_BITS, _APART_BITS = 50, 8
_SEED = 20240607
_COSINES = np.cos(np.arange(SKETCH + 1) / SKETCH * np.pi).astype(np.float32)


def usable_vectors(df: DataFrame, id_col: str = "id", vector_col: str = "content_embedding", dim: int = DIM, squeezed: bool = False) -> DataFrame:
    """(id, vector binary, copy): usable vectors as 32-bit floats, or 16-bit ones where these are equal; ``copy`` is the same for the same vector. ``squeezed``: as _squeezed() has them, for rows that are shuffled."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, column = b.column(0), b.column(1)
            size = np.diff(column.offsets.to_numpy())
            right = np.flatnonzero((size == dim) & ~np.asarray(column.is_null()) & ~np.asarray(ids.is_null()))
            values = column.values.to_numpy(zero_copy_only=False)
            start = column.offsets.to_numpy()[right]
            rows = values[start[:, None] + np.arange(dim)].astype("<f4") if len(right) else np.empty((0, dim), "<f4")
            nulls = column.values.is_null() if column.values.null_count else None
            good = np.isfinite(rows).all(1) & (rows != 0).any(1)
            if nulls is not None:
                good &= ~np.asarray(nulls)[start[:, None] + np.arange(dim)].any(1)
            rows = rows[good] + np.float32(0)  # -0 becomes 0, so equal vectors have equal bytes
            with np.errstate(over="ignore"):
                half = rows.astype("<f2")
            short = (half.astype("<f4") == rows).all(1)  # sent in half the bytes where nothing is lost by it
            raw = [h.tobytes() if s else r.tobytes() for r, h, s in zip(rows, half, short)]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(right[good])), pa.array([_squeezed(r, dim) for r in raw] if squeezed else raw, pa.binary()), pa.array([hashlib.md5(r).digest() for r in raw], pa.binary())], names=["id", "vector", "copy"])

    return df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).mapInArrow(pack, "id string, vector binary, copy binary")


def _squeezed(vector: bytes, dim: int) -> bytes:
    """The first bytes of all values, then the second ones and so on, each place with a code of its own, as these are spread differently; beside that only runs are shortened, as other repeats are chance."""
    planes = np.frombuffer(vector, np.uint8).reshape(dim, -1).T
    packer = zlib.compressobj(1, zlib.DEFLATED, -zlib.MAX_WBITS, strategy=zlib.Z_RLE)
    return b"".join([x for p in planes for x in (packer.compress(p.tobytes()), packer.flush(zlib.Z_FULL_FLUSH))] + [packer.flush()])


def _unsqueezed(packed: bytes, dim: int) -> bytes:
    return np.frombuffer(zlib.decompress(packed, -zlib.MAX_WBITS), np.uint8).reshape(-1, dim).T.tobytes()


@lru_cache(4)
def rotations(dim: int, trees: int) -> np.ndarray:
    """Random directions: the trees' signs (the first of every tree, then the second of every tree and so on), more for the sketch if these are too few, then the trees' symbols."""
    return np.random.default_rng(_SEED).standard_normal((dim, max(SKETCH, trees * SIGNS) + trees * SYMBOLS * COORDINATES)).astype(np.float32)


def hash_strings(vectors: np.ndarray, centre: np.ndarray, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows x trees) strings as 64-bit numbers, the tree in front, whose order is that of the strings, and (rows x SKETCH/8 + 2) sketches: the bits, and the product of vector and centre in 16 bits."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    projected = (unit - centre) @ rotations(vectors.shape[1], trees)
    product = np.round(np.clip(unit @ centre, -1, 1) * 32767).astype("<i2")
    signs = projected[:, : max(SKETCH, trees * SIGNS)] > 0
    sketch = np.hstack([np.packbits(signs[:, :SKETCH], axis=1), product[:, None].view(np.uint8)])
    symbols = projected[:, signs.shape[1] :].reshape(len(vectors), trees, SYMBOLS, COORDINATES)
    largest = np.abs(symbols).argmax(3)
    sign = np.take_along_axis(symbols, largest[..., None], 3)[..., 0] > 0
    code = (largest * 2 + sign).astype(np.int64)
    width = int(np.log2(2 * COORDINATES))
    text = np.tile(np.arange(trees, dtype=np.int64), (len(vectors), 1))
    for k in range(SYMBOLS):
        text = (text << width) | code[..., k]
    own = signs[:, : trees * SIGNS].reshape(len(vectors), SIGNS, trees).transpose(0, 2, 1)
    tail = np.packbits(own, axis=2).view(">u4")[..., 0].astype(np.int64)
    return (text << SIGNS) | tail, sketch


def levels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The level at which the strings of one tree part: LEVEL bits each, counted from the root."""
    shared = TEXT_BITS - np.frexp((a ^ b).astype(np.float64))[1]
    return np.maximum(shared, 0) // LEVEL


def opened(sketches: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits, products with the centre and centred lengths of sketches; ``square``: that of the centre's norm."""
    bits = np.ascontiguousarray(sketches[:, : SKETCH // 8]).view(np.uint64)
    product = np.ascontiguousarray(sketches[:, SKETCH // 8 :]).view("<i2")[:, 0] / np.float32(32767)
    return bits, product, np.sqrt(np.maximum(1 - 2 * product + np.float32(square), 0))


def estimates(rows: tuple, first: slice, second: slice, square: float) -> np.ndarray:
    """Estimated cosines of two slices of opened sketches: c |x - m| |y - m| + xm + ym - mm, with c that of the centred vectors."""
    bits, product, length = rows
    apart = np.bitwise_count(bits[first] ^ bits[second]).sum(1)
    return _COSINES[apart] * (length[first] * length[second]) + (product[first] + product[second]) - np.float32(square)


def _members_and_centre(vectors: DataFrame, rows: int, dim: int) -> tuple[DataFrame, np.ndarray]:
    """((id, copy), centre) in one pass over the vectors: the ids of each distinct vector, and the mean of about CENTRE_ROWS distinct unit vectors, those of the smallest hashes, from one sum a task."""
    below = min(1 << 32, (CENTRE_ROWS << 32) // max(rows, 1))
    chosen = F.conv(F.hex(F.substring("copy", 1, 4)), 16, 10).cast("long") < below
    written = cut(vectors.select("id", "copy", F.when(chosen, F.col("vector")).alias("vector")))

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, n = np.zeros(dim), 0
        for b in batches:
            m = _matrix(b["vector"], dim)
            s += (m / np.linalg.norm(m, axis=1, keepdims=True)).sum(0)
            n += len(b)
        yield pd.DataFrame({"s": [s.tobytes()], "n": [n]})

    distinct = written.where("vector is not null").groupBy("copy").agg(F.first("vector").alias("vector")).select("vector")
    sums = distinct.coalesce(16).mapInPandas(total, "s binary, n long").collect()  # a row a task
    n = sum(r.n for r in sums)
    centre = sum((np.frombuffer(r.s) for r in sums), np.zeros(dim)) / max(n, 1)
    return cut(written.select("id", "copy").distinct()), centre.astype(np.float32)


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    out = np.empty((len(column), dim), np.float32)
    values = column.to_numpy()
    short = np.fromiter((len(v) == 2 * dim for v in values), bool, len(values))
    for mask, kind in ((short, "<f2"), (~short, "<f4")):
        if mask.any():
            out[mask] = np.frombuffer(b"".join(values[mask]), kind).reshape(-1, dim)
    return out


def _apart(cosine: float) -> int:
    """How far apart rows of an estimated cosine are, as a number of _APART_BITS to order by."""
    return int(np.clip(round((1 - cosine) * 200), 0, (1 << _APART_BITS) - 1))


def _forest_candidates(strings: DataFrame, square: float, least: float) -> DataFrame:
    """(row, offer): the best rows around each row's place in each tree, as numbers in the order in which all trees are ascended, from (row, strings, sketch)."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # the last STEPS rows of the tree, already known to their elders
        waiting: list = []
        for b in batches:
            b["tree"] = b["string"].to_numpy() >> TEXT_BITS
            for _, part in b.groupby("tree", sort=False):
                same = held is not None and held["tree"].iat[-1] == part["tree"].iat[0]
                if not same:
                    if waiting:
                        yield _best(waiting)
                    waiting, held = [], None
                window = pd.concat([held, part], ignore_index=True) if held is not None else part.reset_index(drop=True)
                waiting.append(_pairs(window, 0 if held is None else len(held)))
                held = window.tail(STEPS)
                if sum(map(len, waiting)) > 400_000:
                    yield _best(waiting)
                    waiting = []
        if waiting:
            yield _best(waiting)

    def _pairs(window: pd.DataFrame, old: int) -> np.ndarray:
        rows, text = window["row"].to_numpy(), window["string"].to_numpy()
        sketch = np.frombuffer(b"".join(window["sketch"]), np.uint8).reshape(len(window), SKETCH // 8 + 2)
        sketch = opened(sketch, square)
        found = []
        for step in range(1, min(STEPS, len(window) - 1) + 1):
            lo, hi = max(0, old - step), len(window) - step
            if lo >= hi:
                continue
            apart = np.clip(np.round((1 - estimates(sketch, slice(lo, hi), slice(lo + step, hi + step), square)) * 200), 0, most + 1).astype(np.int64)
            near = np.flatnonzero(apart <= most)
            first, second = lo + near, lo + step + near
            level = levels(text[first], text[second])
            found.append(np.column_stack([np.r_[rows[first], rows[second]], np.r_[rows[second], rows[first]], np.tile(apart[near], 2), np.tile(level, 2)]))
        return np.concatenate(found) if found else np.empty((0, 4), np.int64)

    def _best(parts: list[np.ndarray]) -> pd.DataFrame:
        row, other, apart, level = np.concatenate(parts).T
        near = (apart << _ROW_BITS) | other
        order = np.lexsort((near, row))
        row, near, level = row[order], near[order], level[order]
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
        place = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
        kept = place < PER_TREE
        return pd.DataFrame({"row": row[kept], "offer": ((TEXT_BITS // LEVEL - level[kept]) << (_ROW_BITS + _APART_BITS)) | near[kept]})

    most = _apart(least - SLACK)
    spread = strings.select("row", "sketch", F.explode("strings").alias("string"))
    ordered = spread.repartitionByRange("string", "row").sortWithinPartitions("string", "row").select("string", "row", "sketch")
    return ordered.mapInPandas(walk, "row long, offer long")


def _candidates(offers: DataFrame) -> DataFrame:
    """(row, other, apart): of each row's offers the first ASCENT from the deepest level up, of these the CANDIDATES that the sketch puts nearest."""
    ascended = F.slice(F.array_sort(F.collect_set("offer")), 1, ASCENT)
    near = F.transform(ascended, lambda o: o.bitwiseAND((1 << (_ROW_BITS + _APART_BITS)) - 1))
    best = F.slice(F.array_sort(F.array_distinct(near)), 1, CANDIDATES)
    each = offers.groupBy("row").agg(best.alias("best")).select("row", F.explode("best").alias("b"))
    return each.select("row", F.col("b").bitwiseAND((1 << _ROW_BITS) - 1).alias("other"), F.shiftright("b", _ROW_BITS).cast("int").alias("apart"))


def nearest(df: DataFrame, k: int = K, least: float = LEAST, id_col: str = "id", vector_col: str = "content_embedding", dim: int = DIM, trees: int = TREES, block: int = BLOCK) -> DataFrame:
    """(id, other, similarity, position): up to ``k`` most similar other rows of each row, down to a cosine of ``least``."""
    vectors = usable_vectors(df, id_col, vector_col, dim)
    members, centred = _members_and_centre(vectors, df.count(), dim)
    centre = df.sparkSession.sparkContext.broadcast(centred)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                text, sketch = hash_strings(_matrix(part["vector"], dim), centre.value, trees)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "copy": part["copy"].to_numpy(), "strings": list(text), "sketch": [s.tobytes() for s in sketch]})

    described = vectors.mapInPandas(describe, "id string, copy binary, strings array<long>, sketch binary")
    # one row for each distinct vector, numbered once it is written
    groups = cut(described.groupBy("copy").agg(F.min("id").alias("id"), F.first("strings").alias("strings"), F.first("sketch").alias("sketch")).withColumn("row", F.monotonically_increasing_id()))
    pairs = cut(_candidates(_forest_candidates(groups, float(centred @ centred), least)))

    blocks, sizes, cells = _blocks(pairs, block, least)
    seats = blocks.select("row", "block", F.lit(True).alias("own"))
    if cells is not None:
        seats = seats.unionByName(cells.select("row", "block", F.lit(True).alias("own")))
    seats = seats.unionByName(_visits(pairs, blocks, sizes)).groupBy("row", "block").agg(F.max("own").alias("own"))
    # ids and places are joined first, so that each vector is shuffled once to its id and once to its blocks
    places = seats.join(groups.select("row", "id", "copy"), "row")
    seated = usable_vectors(df, id_col, vector_col, dim, squeezed=True).join(places, ["id", "copy"]).select("row", "block", "own", "id", "vector")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None  # the rows of the last block seen, which may go on
        for b in batches:
            b = b if held is None else pd.concat([held, b], ignore_index=True)
            block = b["block"].to_numpy()
            ends = np.flatnonzero(block[1:] != block[:-1]) + 1
            if not len(ends):
                held = b
                continue
            held = b.iloc[ends[-1] :]
            yield _compared(b.iloc[: ends[-1]], np.r_[0, ends], k, least, dim)
        if held is not None:
            yield _compared(held, np.array([0, len(held)]), k, least, dim)

    # blocks lie one behind the other in a task; a task holds a batch and one block
    ordered = seated.repartition("block").sortWithinPartitions("block", "id")
    verified = cut(ordered.mapInPandas(compare, "row long, other long, similarity double"))
    return _with_copies(verified, members.select("id", "copy"), groups.select("row", "copy"), k)


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision, to 12 digits, so that equal ones are equal."""
    x, y = x.astype(np.float64), y.astype(np.float64)
    dot = lambda a, b: np.einsum("ij,ij->i", a, b)
    return np.round(dot(x, y) / np.sqrt(dot(x, x) * dot(y, y)), 12)


def _top(m: np.ndarray, asking: np.ndarray, among: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other, cosine): up to ``k`` nearest rows ``among`` of each row ``asking``, ties by the order of ``among``. Products in single precision choose, with room for their error; cosines are worked out in double precision."""
    if not len(asking) or not len(among):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    room = np.float32(1e-5)
    firsts, seconds, values = [], [], []
    others = m[among] / np.linalg.norm(m[among], axis=1, keepdims=True)
    for at in range(0, len(asking), 512):
        part = asking[at : at + 512]
        s = (m[part] / np.linalg.norm(m[part], axis=1, keepdims=True)) @ others.T
        s[part[:, None] == among[None, :]] = -2
        if s.shape[1] > k:
            bound = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] - room
            r, c = np.nonzero((s >= bound) & (s >= least - room))
        else:
            r, c = np.nonzero(s >= least - room)
        a, o = part[r], among[c]
        exact = np.concatenate([np.empty(0), *(_cosines(m[a[n : n + 4096]], m[o[n : n + 4096]]) for n in range(0, len(a), 4096))])
        order = np.lexsort((o, -exact, a))
        a, o, exact = a[order], o[order], exact[order]
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.empty(0, np.int64)
        place = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
        kept = (place < k) & (exact >= least)
        firsts.append(a[kept])
        seconds.append(o[kept])
        values.append(exact[kept])
    return np.concatenate(firsts), np.concatenate(seconds), np.concatenate(values)


def _compared(b: pd.DataFrame, edges: np.ndarray, k: int, least: float, dim: int) -> pd.DataFrame:
    """(row, other, similarity) of whole blocks, rows in order of id: own rows are compared with all rows of their block, visitors with its own rows."""
    rows, own = b["row"].to_numpy(), b["own"].to_numpy()
    m = _matrix(b["vector"].map(lambda v: _unsqueezed(v, dim)), dim)
    found = []
    for start, end in zip(edges[:-1], edges[1:]):
        place = np.arange(start, end)
        if len(np.unique(rows[start:end])) < end - start:  # rows that the source repeats
            place = start + np.sort(np.unique(rows[start:end], return_index=True)[1])
        mine, guests = place[own[place]], place[~own[place]]
        found += [_top(m, mine, place, k, least), _top(m, guests, mine, k, least)]
    first, second, value = (np.concatenate(x) for x in zip(*found))
    return pd.DataFrame({"row": rows[first], "other": rows[second], "similarity": value})


def _visits(pairs: DataFrame, blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """(row, block, own): candidates of two blocks meet in the larger one; the other row visits it."""
    placed = cut(blocks.join(sizes, "block"))
    mine = pairs.select("row", "other").join(placed.select("row", F.struct("size", "block").alias("here")), "row")
    both = mine.join(placed.select(F.col("row").alias("other"), F.struct("size", "block").alias("there")), "other").where("here.block <> there.block")
    to_here = F.col("here") > F.col("there")
    return both.select(F.when(to_here, F.col("other")).otherwise(F.col("row")).alias("row"), F.greatest("here", "there")["block"].alias("block"), F.lit(False).alias("own"))


def _blocks(pairs: DataFrame, block: int, least: float) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(row, block): rows that reach the same smallest row in two steps over candidates share a block, split if it has more than ``block`` rows; (block, size); and (row, block) of the pairs of parts of such groups, None if there are none."""
    lead = pairs.groupBy("row").agg(F.least(F.min("other"), F.col("row")).alias("lead"))
    for _ in range(2):
        far = lead.select(F.col("row").alias("other"), F.col("lead").alias("far"))
        reached = pairs.join(far, "other").groupBy("row").agg(F.min("far").alias("far"))
        lead = cut(lead.join(reached, "row", "left").select("row", F.least("lead", "far").alias("lead")))
    sizes = lead.groupBy("lead").agg(F.count("*").alias("rows"))
    large = cut(sizes.where(F.col("rows") > block))
    split = lookup_join(lead, large.select("lead", F.ceil(F.col("rows") / block).cast("int").alias("parts")), ["lead"])
    part = F.coalesce(F.pmod(F.xxhash64("row"), F.col("parts")), F.lit(0))
    blocks = split.select("row", F.xxhash64("lead", part).alias("block"))  # a clash of hashes only puts two blocks into one
    return blocks, blocks.groupBy("block").agg(F.count("*").alias("size")), None if large.isEmpty() else _cells(pairs, lead, sizes, large, block, least)


def _cells(pairs: DataFrame, lead: DataFrame, sizes: DataFrame, large: DataFrame, block: int, least: float) -> DataFrame:
    """(row, block): the rows of both parts of every pair of parts, of each large group and of the groups linked to it by candidates that the sketch puts at ``least``. Linked groups that aren't large share parts, so a large group is repeated for each part of these, not for each of them."""
    close = pairs.where(F.col("apart") <= _apart(least)).select("row", "other")
    of_large = lead.join(F.broadcast(large.select("lead")) if large.count() < 10_000 else large.select("lead"), "lead")
    linked = close.join(of_large, "row").join(lead.select(F.col("row").alias("other"), F.col("lead").alias("to")), "other").select("lead", "to")
    linked = cut(linked.distinct())
    size = PART * block
    names = large.select(F.col("lead").alias("to"))
    few = cut(linked.join(names, "to", "left_anti").join(sizes.select(F.col("lead").alias("to"), "rows"), "to"))
    shared = few.join(few.groupBy("lead").agg(F.ceil(F.sum("rows") / size).cast("int").alias("n")), "lead").select("lead", "to", F.pmod(F.xxhash64("to"), F.col("n")).alias("j"))
    # the reach of a row ends after three steps, so one dense group may have several leads
    both = cut(linked.join(names, "to", "left_semi").select("lead", "to").unionByName(large.select("lead", F.col("lead").alias("to"))).select(F.least("lead", "to").alias("a"), F.greatest("lead", "to").alias("b")).distinct())
    parts = cut(sizes.join(large.select("lead").unionByName(few.select(F.col("to").alias("lead"))).distinct(), "lead").select("lead", F.ceil(F.col("rows") / size).cast("int").alias("parts")))
    sized = both.join(parts.select(F.col("lead").alias("a"), F.col("parts").alias("m")), "a").join(parts.select(F.col("lead").alias("b"), F.col("parts").alias("n")), "b")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    every = sized.withColumn("i", numbers("m")).withColumn("j", numbers("n"))
    # within one group each pair once; a pair holds both parts whole, so a part alone is a task only if it is the only one
    every = every.where("a <> b or i < j or m = 1").withColumn("block", F.xxhash64(F.lit("pair"), "a", "i", "b", "j"))
    seats = every.select(F.col("a").alias("lead"), F.col("i").alias("part"), "block").unionByName(every.select(F.col("b").alias("lead"), F.col("j").alias("part"), "block"))
    shared = shared.join(parts, "lead").withColumn("i", numbers("parts")).withColumn("block", F.xxhash64(F.lit("shared"), "lead", "i", "j"))
    seats = seats.unionByName(shared.select("lead", F.col("i").alias("part"), "block")).unionByName(shared.select(F.col("to").alias("lead"), F.lit(0).alias("part"), "block")).distinct()
    placed = lookup_join(lead, parts, ["lead"], "inner").select("row", "lead", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part"))
    return lookup_join(placed, seats, ["lead", "part"], "inner").select("row", "block")


def _with_copies(verified: DataFrame, members: DataFrame, groups: DataFrame, k: int) -> DataFrame:
    """Neighbours of all rows from those of the distinct vectors."""
    # of a group only its first k + 1 ids can be anybody's nearest; found by partial aggregation, as a group may be large
    firsts = cut(members.groupBy("copy").agg(F.count("*").alias("size")).join(_smallest(members, k + 1), "copy").join(groups, "copy").select("row", "copy", "size", "ids"))
    single = firsts.where("size = 1").select(F.col("ids")[0].alias("id"), "row")
    several = firsts.where("size > 1")
    all_rows = single.unionByName(lookup_join(members, several.select("copy", "row"), ["copy"], "inner").select("id", "row"))
    others = firsts.select(F.col("row").alias("other"), F.slice("ids", 1, k).alias("ids"))
    # candidates of a distinct vector: its own copies first (similarity 1), then those of its neighbours
    lists = verified.join(others, "other").select("row", "similarity", F.explode("ids").alias("near")).unionByName(several.select("row", F.lit(1.0).alias("similarity"), F.explode("ids").alias("near")))
    best = lists.groupBy("row").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("similarity")).alias("d"), "near"))), 1, k * (k + 1)).alias("best"))
    out = all_rows.join(best, "row")
    near = F.slice(F.filter("best", lambda x: x["near"] != F.col("id")), 1, k)
    return out.select("id", F.posexplode(near).alias("position", "x")).select("id", F.col("x.near").alias("other"), (-F.col("x.d")).alias("similarity"), (F.col("position") + 1).alias("position"))


def _smallest(members: DataFrame, n: int) -> DataFrame:
    """(copy, ids): the ``n`` smallest ids of each group, thinned out per task first."""
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    thin = F.slice(F.array_sort(F.collect_set("id")), 1, n)
    once = members.groupBy("copy", part.alias("part")).agg(thin.alias("ids"))
    return once.groupBy("copy").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, n).alias("ids"))


def similar_pairs(df: DataFrame, k: int = K, least: float = LEAST, **options: object) -> DataFrame:
    """(id_a, id_b): pairs of which at least one is among the ``k`` most similar rows of the other."""
    near = nearest(df, k, least, **options)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def exact_nearest(df: DataFrame, queries: DataFrame, k: int = K, least: float = LEAST, id_col: str = "id", vector_col: str = "content_embedding", dim: int = DIM) -> DataFrame:
    """(id, other, similarity): exact neighbours of the rows of ``queries`` (column ``id``) against all rows, in blocks of EXACT_QUERIES of them."""
    vectors = usable_vectors(df, id_col, vector_col, dim)
    asked = cut(vectors.join(queries.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.min("vector").alias("vector")))
    blocks = max(1, -(-asked.count() // EXACT_QUERIES))
    found = None
    for n in range(blocks):
        part = _exact_block(vectors, asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == n), least, dim)
        order = Window.partitionBy("id").orderBy(F.round("similarity", 9).desc(), "other")
        best = cut(part.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("id", "other", "similarity"))
        found = best if found is None else found.unionByName(best)
    return found


def _exact_block(vectors: DataFrame, asked: DataFrame, least: float, dim: int) -> DataFrame:
    rows = asked.orderBy("id").collect()  # about EXACT_QUERIES
    ids, q = [r.id for r in rows], _matrix(pd.Series([r.vector for r in rows], dtype=object), dim).astype(np.float64)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    sent = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, q = sent.value
        for b in batches:
            m = _matrix(b["vector"], dim).astype(np.float64)
            m /= np.linalg.norm(m, axis=1, keepdims=True)
            s = q @ m.T
            r, c = np.nonzero(s >= least)
            ok = np.array(names, object)[r] != b["id"].to_numpy()[c]
            yield pd.DataFrame({"id": np.array(names, object)[r][ok], "other": b["id"].to_numpy()[c][ok], "similarity": s[r, c][ok]})

    return vectors.mapInPandas(scan, "id string, other string, similarity double").distinct()


def recall(df: DataFrame, **options: object) -> DataFrame:
    """(queries, exact_links, found, recall): measured on the rows whose hashed id is divisible by 100, against all rows."""
    queries = usable_vectors(df).where(F.pmod(F.xxhash64("id"), F.lit(100)) == 0).select("id").distinct()
    truth = exact_nearest(df, queries)
    got = nearest(df, **options).select("id", "other", F.lit(1).alias("hit"))
    both = truth.join(got, ["id", "other"], "left")
    return both.agg(F.count_distinct("id").alias("queries"), F.count("*").alias("exact_links"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found")).withColumn("recall", F.col("found") / F.greatest("exact_links", F.lit(1)))
