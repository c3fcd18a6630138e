"""Near-duplicate vectors through spherical-cap filters of structured random product codes.

A filter is a direction; a vector passes it when their cosine exceeds a cap.  The directions are the words of product
codes: the space is rotated at random and cut into blocks, every block has random unit vectors, and a direction is a
choice of one per block.  So a vector's list of passed filters is decoded block by block, without a look at the other
directions.  Vectors meet where they pass the same filter, and are verified there by their cosine.

The cap follows the number of vectors, so that a filter holds a fraction of an unrelated vector, and the number of
directions follows the cap, so that a pair at the least cosine shares COMMON filters on average.  Words of one code share
blocks, so the number varies more than that of independent directions would; the many rotations hold that down.  The
share of pairs missed at the least cosine is measured by tests, and is far smaller above it.

Hot regions: equal vectors are one class.  A class joins the ball around the first class of one of its filters when it
lies within half the angle of a link; so all in a ball are linked, and counted without a look at their pairs.  Filters
then hold balls and single classes; a ball is opened only for groups that its radius lets in.  Filters and balls are
compared in blocks of at most about BLOCK rows, and a pair that shares several filters counts in the first one.  Tasks
put out counts and spanning links, never pairs.

Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing, and vectors link with
those of their own length only.  Rows are vectors of their own, also where they repeat an id or everything.  A null id
counts as linked like others, is never a component's id unless the component has no other, and is kept only then.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.tasks import binary_rows, ship
from weftline.operators.components import representatives
from weftline.runtime import materialize

LEAST_COSINE = 0.9
COMMON = 20.0      # filters that a pair at the least cosine shares on average
LOAD = 0.25        # unrelated vectors in a filter on average
CODES = 32         # rotations with a code each: the more, the less the number of shared filters varies
MAX_WORDS = 1_024  # words of a block; more blocks are taken where more words would be needed, then lower caps
MAX_BLOCKS = 4
MAX_PASSED = 256   # filters of a vector on average: few dimensions would need more for such sharp caps
BLOCK = 1_024      # rows of one side of a comparison, at most about
DECODED = 256      # vectors decoded together
_SLACK = 1e-9      # keeps decisions by angle clear of rounding


# ---- caps and codes


def _angles() -> np.ndarray:
    return (np.arange(20_000) + 0.5) / 20_000 * math.pi


def passing(cap: float, dim: int) -> float:
    """Share of the sphere within the cap: its plane projection has P(radius >= s) = (1 - s^2)^((dim - 2) / 2)."""
    return shared(cap, dim, 0.0)


def shared(cap: float, dim: int, angle: float) -> float:
    """Share of the directions whose cap holds both of two vectors at ``angle``."""
    near = np.cos(_angles() + angle / 2)
    least = cap / np.maximum(near, 1e-12)
    inside = (near > 0) & (least < 1)
    return float(np.where(inside, np.maximum(0, 1 - np.minimum(least, 1) ** 2) ** ((dim - 2) / 2), 0).mean())


@lru_cache(maxsize=16)
def plan(vectors: int, dim: int, least: float) -> tuple[float, int, int]:
    """(cap, blocks, words per block) for so many vectors."""
    dim, angle = max(dim, 2), math.acos(least)

    def words(cap: float, blocks: int) -> int:
        both = shared(cap, dim, angle)
        return math.ceil((COMMON / CODES / both) ** (1 / blocks)) if both > 0 else 1 << 62

    def highest(fits) -> float:
        low, high = 0.0, math.cos(angle / 2)
        for _ in range(40):
            cap = (low + high) / 2
            low, high = (cap, high) if fits(cap) else (low, cap)
        return low

    cap = highest(lambda c: passing(c, dim) * vectors > LOAD and COMMON * passing(c, dim) <= MAX_PASSED * shared(c, dim, angle))
    most = max(1, min(MAX_BLOCKS, dim // 4))
    blocks = next((m for m in range(min(2, most), most) if words(cap, m) <= MAX_WORDS), most)
    if words(cap, blocks) > MAX_WORDS:
        cap = highest(lambda c: words(c, blocks) <= MAX_WORDS)
    return cap, blocks, words(cap, blocks)


@lru_cache(maxsize=16)
def codes(dim: int, blocks: int, words: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """(rotation, words of each block) of every code; the same on all executors."""
    found = []
    cuts = np.array_split(np.arange(max(dim, 2)), blocks)
    for number in range(CODES):
        random = np.random.default_rng([dim, number])
        rotation = np.linalg.qr(random.standard_normal((max(dim, 2), max(dim, 2))))[0]
        parts = [random.standard_normal((words, len(cut))) for cut in cuts]
        found.append((rotation, [p / np.linalg.norm(p, axis=1, keepdims=True) for p in parts]))
    return found


def decoded(units: np.ndarray, vectors: int, least: float = LEAST_COSINE) -> tuple[np.ndarray, np.ndarray]:
    """(vector, filter) for every filter that a row of ``units`` passes, in order of the vectors."""
    dim = units.shape[1]
    if dim >= 1 << 18:
        raise ValueError("vectors of more than 262,143 components have no filters")
    cap, blocks, words = plan(vectors, dim, least)
    if dim < 2:
        units = np.pad(units, ((0, 0), (0, 2 - dim)))
    cuts = np.cumsum([len(c) for c in np.array_split(np.arange(max(dim, 2)), blocks)])[:-1]
    need, of, filters = cap * math.sqrt(blocks), [], []
    for number, (rotation, parts) in enumerate(codes(dim, blocks, words)):
        turned = np.split(units @ rotation, cuts, axis=1)
        products = [t @ p.T for t, p in zip(turned, parts, strict=True)]
        # what the blocks from k on can add at most
        rest = np.zeros((blocks + 1, len(units)))
        for k in range(blocks - 1, -1, -1):
            rest[k] = rest[k + 1] + products[k].max(axis=1)
        at = np.flatnonzero(rest[0] >= need)
        total, name = np.zeros(len(at)), np.zeros(len(at), np.int64)
        for k in range(blocks):
            steps = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
            for cut in range(0, len(at), 4_096):
                rows = slice(cut, cut + 4_096)
                sums = products[k][at[rows]] + total[rows, None]
                i, word = np.nonzero(sums >= (need - rest[k + 1][at[rows]])[:, None])
                steps.append((at[rows][i], sums[i, word], name[rows][i] * words + word))
            at, total, name = (np.concatenate(s) for s in zip(*steps, strict=True))
        of.append(at)
        filters.append((dim * CODES + number << 40) + name)  # a code has at most MAX_WORDS ** MAX_BLOCKS directions
    vector, passed = np.concatenate(of), np.concatenate(filters)
    order = np.lexsort((passed, vector))
    return vector[order], passed[order]


# ---- vectors and their filters


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([0 if n is None else n for n in column.value_lengths().to_pylist()], np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), sizes


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, unit): the vector at length 1 as little-endian doubles, null where it cannot link."""
    for batch in batches:
        flat, sizes = _flat(batch.column("vector"))
        ends = np.cumsum(sizes)
        units: list[bytes | None] = []
        for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
            x = flat[end - size : end]  # a null component is not a number here
            largest = np.abs(x).max() if size else 0.0
            if not np.isfinite(largest) or largest == 0:
                units.append(None)
                continue
            x = x / largest  # squares neither overflow nor vanish
            units.append((x / np.sqrt(x @ x) + 0.0).astype("<f8").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("id"), pa.array(units, pa.binary())], names=["row", "id", "unit"]
        )


def _matrix(units: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(units), "<f8").reshape(len(units), -1)


def _passed(vectors: int, least: float):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, units = np.array(batch.column("row").to_pylist(), np.int64), batch.column("unit").to_pylist()
            lengths = np.array([len(u) for u in units], np.int64)
            for length in np.unique(lengths).tolist():
                same = np.flatnonzero(lengths == length)
                for at in range(0, len(same), DECODED):
                    part = same[at : at + DECODED]
                    vector, passed = decoded(_matrix([units[i] for i in part.tolist()]), vectors, least)
                    offsets = np.searchsorted(vector, np.arange(len(part) + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[part]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(passed))], names=["row", "filters"]
                    )

    return decode


# ---- comparison of blocks


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The runs of equal keys in sorted rows; a run has two blocks at most."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.concat_batches([held, batch])
        k = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in keys])
        cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist()]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(start, end - start)
        held = batch.slice(cuts[-1])
    if held is not None:
        yield held


def _forest(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) over the links of two sides, where they differ."""
    none = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        new_a = np.minimum(a, np.where(link, b[None, :], none).min(axis=1, initial=none))
        new_b = np.minimum(b, np.where(link, new_a[:, None], none).min(axis=0, initial=none))
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    nodes, least = np.concatenate([left, right]), np.concatenate([a, b])
    return nodes[nodes != least], least[nodes != least]


_FOUND = pa.schema([("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64())])


def _found(parts: list[tuple[str, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, x, _ in parts for _ in range(len(x))], pa.string()),
            pa.array(np.concatenate([np.zeros(0, np.int64), *[x for _, x, _ in parts]]).astype(np.int64)),
            pa.array(np.concatenate([np.zeros(0, np.int64), *[y for _, _, y in parts]]).astype(np.int64)),
        ],
        schema=_FOUND,
    )


def _earlier(filters: list[bytes], here: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether two groups share a filter before this one."""
    lists = [np.frombuffer(f, np.int64) for f in filters]
    lists = [x[x < here] for x in lists]
    names, word = np.unique(np.concatenate(lists), return_inverse=True)
    holds = np.zeros((len(lists), len(names)), np.float32)
    holds[np.repeat(np.arange(len(lists)), [len(x) for x in lists]), word] = 1
    return holds[left] @ holds[right].T > 0


def _in_filters(least: float):
    """Compares the groups of a filter: ("count", group, links), ("edge", a, b) and ("open", a, b)."""
    angle = math.acos(least)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[str, np.ndarray, np.ndarray]] = []
        for run in _runs(batches, ["filter", "low", "high"]):
            low, high, part = run.column("low")[0].as_py(), run.column("high")[0].as_py(), run.column("part").to_numpy()
            left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
            units = _matrix(run.column("unit").to_pylist())
            group, size = run.column("g").to_numpy(), run.column("size").to_numpy()
            single = run.column("single").to_numpy(zero_copy_only=False)
            cosine = units[left] @ units[right].T
            once = group[left][:, None] < group[right] if low == high else np.ones(cosine.shape, bool)
            alone = single[left][:, None] & single[right]
            link = once & alone & (cosine >= least)
            if link.any():
                link &= ~_earlier(run.column("filters").to_pylist(), run.column("filter")[0].as_py(), left, right)
                parts.append(("count", group[left], (link * size[right]).sum(axis=1)))
                parts.append(("count", group[right], (link * size[left][:, None]).sum(axis=0)))
                parts.append(("edge", *_forest(link, group[left], group[right])))
            if not single.all():
                radius = run.column("radius").to_numpy()
                reach = np.minimum(math.pi, angle + radius[left][:, None] + radius[right] + _SLACK)
                i, j = np.nonzero(once & ~alone & (cosine >= np.cos(reach)))
                x, y = group[left][i], group[right][j]
                parts.append(("open", np.minimum(x, y), np.maximum(x, y)))
            if sum(len(x) for _, x, _ in parts) > 50_000:
                yield _found(parts)
                parts = []
        yield _found(parts)

    return compare


def _in_balls(least: float):
    """Compares the rows that ask a ball with its members: ("count", row, links) and ("edge", group, ball)."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, ["ball", "part", "chunk"]):
            member = run.column("member").to_numpy(zero_copy_only=False)
            units, row = _matrix(run.column("unit").to_pylist()), run.column("row").to_numpy()
            copies, group = run.column("copies").to_numpy(), run.column("g").to_numpy()
            asks, held = np.flatnonzero(~member), np.flatnonzero(member)
            link = units[asks] @ units[held].T >= least
            linked = np.unique(group[asks][link.any(axis=1)])
            yield _found(
                [
                    ("count", row[asks], (link * copies[held]).sum(axis=1)),
                    ("count", row[held], (link * copies[asks][:, None]).sum(axis=0)),
                    ("edge", linked, np.full(len(linked), run.column("ball")[0].as_py())),
                ]
            )

    return compare


_FOUND_SQL = "kind string, a bigint, b bigint"


def _parts(rows: DataFrame, key: str, name: str, total: str, by: str = "row") -> DataFrame:
    """``rows`` with an even split of the rows of one ``key`` into ``total`` parts of about BLOCK rows.

    The counts are written, so that the join splits a hot key.
    """
    counts = materialize(rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("bigint").alias(total)), "cap-parts")
    return rows.join(counts, key).withColumn(name, F.pmod(F.xxhash64(by), F.col(total)))


def _balls(entries: DataFrame, shared_filters: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """(row, g, cosine): classes within half the angle of the first class of one of their filters."""
    half = math.cos(math.acos(least) / 2) + _SLACK
    near = entries.join(shared_filters.where("n > 2").select("filter", "head"), "filter").where("row <> head")
    near = materialize(near.select("row", "head").distinct(), "cap-heads")
    units = classes.select("row", "unit")
    both = near.join(units, "row").join(units.select(F.col("row").alias("head"), F.col("unit").alias("centre")), "head")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("unit").to_pylist(), batch.column("centre").to_pylist(), strict=True)
            cosine = [np.frombuffer(x, "<f8") @ np.frombuffer(y, "<f8") if len(x) == len(y) else -1.0 for x, y in pairs]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("head"), pa.array(cosine, pa.float64())], names=["row", "head", "cosine"]
            )

    within = both.select("row", "head", "unit", "centre").mapInArrow(close, "row bigint, head bigint, cosine double")
    best = within.where(F.col("cosine") >= half).groupBy("row").agg(F.min(F.struct("head", "cosine")).alias("b"))
    return best.select("row", F.col("b.head").alias("g"), F.col("b.cosine").alias("cosine"))


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = LEAST_COSINE) -> DataFrame:
    """(row, id, n_links, component_id, kept) for every row of ``vectors``, in the order of nothing."""
    ship(vectors.sparkSession)
    source = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vector")
    )
    rows = materialize(source.mapInArrow(_units, "row bigint, id bigint, unit binary"), "cap-units")
    digest = F.sha2("unit", 256).alias("digest")
    heads = rows.where("unit is not null").groupBy(digest).agg(F.min("row").alias("class"), F.count(F.lit(1)).alias("copies"))
    heads = materialize(heads.where("copies > 1"), "cap-copies")
    placed = rows.select("*", digest).join(heads, "digest", "left").select(
        "row", "id", "unit", F.coalesce("class", "row").alias("class"), F.coalesce("copies", F.lit(1)).alias("copies")
    )
    placed = materialize(placed, "cap-rows")
    classes = placed.where("unit is not null and row = class").select("row", "unit", "copies")

    total = classes.count()
    passed = materialize(classes.select("row", "unit").mapInArrow(_passed(total, least), "row bigint, filters array<bigint>"), "cap-passed")
    single = passed.select("row", F.explode("filters").alias("filter"))
    several = single.groupBy("filter").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("head")).where("n > 1")
    several = materialize(several, "cap-filters")
    entries = materialize(single.join(several.select("filter"), "filter", "left_semi"), "cap-entries")

    balls = materialize(_balls(entries, several, classes, least), "cap-balls")
    members = classes.join(balls, "row", "left").select("row", "unit", "copies", F.coalesce("g", "row").alias("g"), "cosine")
    members = materialize(members, "cap-members")
    groups = members.groupBy("g").agg(
        F.sum("copies").alias("size"), F.count(F.lit(1)).alias("members"),
        F.max(F.acos(F.least(F.lit(1.0), F.coalesce("cosine", F.lit(1.0))))).alias("radius"),
    )
    # a ball is named by its centre, which may have joined another ball
    alone = (F.col("members") == 1) & (F.col("radius") == 0)
    groups = materialize(groups.select("*", alone.alias("single")), "cap-groups")

    # filters that several groups share, with the list of them for single classes
    meeting = entries.join(members.select("row", "g"), "row").select("g", "filter").distinct()
    meeting = _parts(materialize(meeting, "cap-meeting"), "filter", "part", "parts", by="g")
    counts = meeting.groupBy("filter").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1").select("filter")
    meeting = materialize(meeting.join(materialize(counts, "cap-several"), "filter", "left_semi"), "cap-meetings")
    lists = meeting.join(groups.where("single").select("g"), "g", "left_semi").groupBy("g").agg(F.sort_array(F.collect_list("filter")).alias("filters"))
    centres = groups.join(classes.select(F.col("row").alias("g"), "unit"), "g").join(lists, "g", "left")
    centres = materialize(centres.mapInArrow(_packed, _CENTRES), "cap-centres")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("other")
    dealt = meeting.join(centres, "g").select("filter", "part", "g", "unit", "radius", "size", "single", "filters", other)
    dealt = dealt.withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")}).drop("other")
    keys = ["filter", "low", "high"]
    first = materialize(dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_in_filters(least), _FOUND_SQL), "cap-first")
    opened = _opened(first, members, groups, least)

    found = first.where("kind <> 'open'").unionByName(opened)
    links = found.where("kind = 'edge'").select(F.col("a").alias("u"), F.col("b").alias("v"))
    more = found.where("kind = 'count' and b > 0").groupBy(F.col("a").alias("row")).agg(F.sum("b").alias("links"))
    roots = representatives(links).select(F.col("id").alias("g"), F.col("least_id").alias("root"))
    counted = (
        members.select("row", "g")
        .join(groups.select("g", "size"), "g")
        .join(materialize(roots, "cap-roots"), "g", "left")
        .join(more, "row", "left")
        .select(F.col("row").alias("class"), F.coalesce("root", "g").alias("root"), (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    named = placed.select("row", "id", "class").join(materialize(counted, "cap-counted"), "class", "left")
    named = materialize(named.select("row", "id", F.coalesce("root", -1 - F.col("row")).alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links")), "cap-named")
    least_ids = materialize(named.groupBy("root").agg(F.min("id").alias("component_id")), "cap-least")
    return named.join(least_ids, "root").select("row", "id", "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


_CENTRES = "g bigint, size bigint, radius double, single boolean, unit binary, filters binary"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("filters")
        sizes = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
        packed = binary_rows(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), sizes)
        names = ["g", "size", "radius", "single", "unit"]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], packed], names=[*names, "filters"])


def _opened(first: DataFrame, members: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """Links between the members of groups that a filter let in: those of the smaller group ask the larger one."""
    pairs = first.where("kind = 'open'").select("a", "b").distinct()
    size = groups.select("g", "members")
    sized = pairs.join(size.select(F.col("g").alias("a"), F.col("members").alias("m")), "a").join(
        size.select(F.col("g").alias("b"), F.col("members").alias("n")), "b"
    )
    turned = F.col("m") > F.col("n")
    asks = sized.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("g"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("ball"))
    asks = materialize(asks, "cap-open")
    held = members.join(asks.select(F.col("ball").alias("g")).distinct(), "g", "left_semi").select("row", F.col("g").alias("ball"))
    held = materialize(_parts(held, "ball", "part", "parts"), "cap-held")
    asking = materialize(_parts(materialize(asks.join(members.select("row", "g"), "g"), "cap-asks"), "ball", "chunk", "chunks"), "cap-asking")
    blocks = held.select("ball", "parts").distinct().join(asking.select("ball", "chunks").distinct(), "ball")
    blocks = materialize(blocks, "cap-blocks")

    def spread(total: str, name: str):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(total) - 1)).alias(name)

    sides = held.join(blocks.select("ball", "chunks"), "ball").select("ball", "row", "part", spread("chunks", "chunk"), F.lit(True).alias("member"))
    sides = sides.unionByName(
        asking.join(blocks.select("ball", "parts"), "ball").select("ball", "row", "chunk", spread("parts", "part"), F.lit(False).alias("member"))
    )
    sides = sides.join(members.select("row", "g", "unit", "copies"), "row")
    keys = ["ball", "part", "chunk"]
    return materialize(sides.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_in_balls(least), _FOUND_SQL), "cap-opened")
