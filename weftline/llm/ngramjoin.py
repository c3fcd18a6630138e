"""Exact Jaccard self-join on word shingles with a token-group matrix.

Documents become sets of hashed word shingles; equal sets are one class.  The classes are partitioned into groups of
similar sets: minhash bands name a leader per bucket, and a class joins a leader's group when the exact similarity
reaches the threshold, so a group is connected by links.  The token-group matrix stores the union of the sets of each
group (the tokens below a fixed share of the hash range).  How many tokens a group shares with another one bounds the
overlap of any two of their members; only pairs of groups whose bound reaches the threshold are opened, and their
members compared exactly, on whole texts, until a link is found or none is left to compare.

No pair can be missed.  A link needs an overlap that any order of the tokens shows in both prefixes.  The order used
puts the tokens that many groups hold last; a set with enough other tokens in the matrix has its prefix there.  The
remaining sets meet each other in a second matrix: each asks the groups of similar sets that share one of its rarest
tokens, and an opened group compares it with all members inside one task.  Frequent tokens therefore never produce
pairs, yet they count in the bound.

Hashes have 64 bits per shingle and 128 per set.  A null or empty text, or one without words, has the empty set: no
links.  Null and repeated ids are rows of their own; a component of rows without ids has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.tasks import chunks, ranges, release, ship, small_side, texts_of, without_rows
from weftline.operators.components import representatives
from weftline.runtime import materialize

WORDS = 5
SHARE = 0.28             # part of the hash range whose tokens the matrix holds; above 0.2, which a prefix needs
HOT_GROUPS = 64          # tokens of more groups than this come last in the order
BUCKET_TOKENS = 500_000  # matrix entries of one bucket, which a task holds with the pairs of groups they make
CHUNK_REPEATS = 3        # a token of that many sets of one chunk is counted as a possible giant
GIANT_TOKENS = 250_000   # possible giants above this many sets are kept out of the buckets, which must fit a task
GIANT_BUCKETS = 61       # buckets -1, -2, … that the giants' counts are spread over, by group
MEMO_WORDS = 100_000      # word hashes that a comparing task keeps
GROUP_SETS = 256         # sets of a group that is compared in one task, at most about
QUERY_SETS = 1_024       # queries that one opening of a group takes at most about
SIDE_TOKENS = 2_000_000  # tokens of either side of an opening at most about; a longer set is a side of its own
CHUNK_TOKENS = 400_000   # tokens of the sets that count their tokens together

_K = np.uint64(0x9E3779B97F4A7C15)
_LIMIT = np.uint64(int(SHARE * 2.0**64))
# A bucket needs four equal minhashes, so a passage that unlike sets share does not bring them together.
BANDS, BAND_ROWS = 8, 4
_ODD = np.array([pow(0x5851F42D4C957F2D, i, 2**64) | 1 for i in range(1, BANDS * BAND_ROWS + 1)], np.uint64)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str, memo: dict) -> np.ndarray:
    """Sorted distinct hashes of the shingles of five words; of the whole text where it has fewer."""
    words = text.encode("utf-8", "surrogatepass").lower().split()  # A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    values = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(values))
    count = len(values) - size + 1
    hashed = np.full(count, size, np.uint64)
    for i in range(size):
        hashed = hashed * _K + values[i : i + count]
    return np.unique(_mixed(hashed))


def _bands(tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each band of minhashes, a row per set; ``tokens`` has the sets end to end, none of them empty.

    The permutations multiply by odd numbers after another mixing.  They only decide which sets are compared first.
    """
    mixed, starts = _mixed(tokens), np.cumsum(sizes) - sizes
    band = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sizes), 1))
    if len(sizes):
        for i, odd in enumerate(_ODD):
            column = i // BAND_ROWS
            band[:, column] = band[:, column] * _K + np.minimum.reduceat(mixed * odd, starts)
    return _mixed(band).view(np.int64)


_SETS = (
    "doc_id bigint, content bigint, n bigint, w bigint, digest binary, bands array<bigint>, low array<bigint>, "
    "often array<struct<token:bigint,sets:bigint>>"
)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    often_type = pa.list_(pa.struct([("token", pa.int64()), ("sets", pa.int64())]))
    for chunk in chunks(batches):
        memo = _Words()
        sets = [shingle_set(t, memo) for t in texts_of(chunk)]
        low = [s[: np.searchsorted(s, _LIMIT)].view(np.int64) for s in sets]
        tokens, found = np.unique(np.concatenate(low), return_counts=True)
        many = found >= CHUNK_REPEATS
        full = np.array([len(s) for s in sets], np.int64)
        bands = np.zeros((0, BANDS), np.int64)
        if full.any():
            bands = _bands(np.concatenate(sets), full[full > 0])
        band_ends = np.concatenate([[0], np.cumsum(BANDS * (full > 0))]).astype(np.int32)
        often = [{"token": t, "sets": c} for t, c in zip(tokens[many].tolist(), found[many].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                chunk.column("doc_id"),
                chunk.column("content"),
                pa.array(full),
                pa.array([len(s) for s in low], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.ListArray.from_arrays(pa.array(band_ends), pa.array(bands.ravel())),
                _lists(low),
                pa.array([often, *[[]] * (len(sets) - 1)], often_type),
            ],
            names=["doc_id", "content", "n", "w", "digest", "bands", "low", "often"],
        )


# ---- exact comparison of pairs


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(row, text) of the rows in ``ids`` (row, doc_id, content), written."""
    wanted = ids.select("row", F.col("doc_id").alias("_d"), F.col("content").alias("_c"))
    found = docs.select("doc_id", "content", "text").join(
        small_side(wanted), (F.col("content") == F.col("_c")) & F.col("doc_id").eqNullSafe(F.col("_d"))
    )
    # rows that repeat id and text fetch one text each
    return materialize(found.select("row", "text"), "join-texts").dropDuplicates(["row"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo = _Words()

    @lru_cache(maxsize=64)
    def tokens(text: str) -> np.ndarray:
        if len(memo) > MEMO_WORDS:
            memo.clear()
        return shingle_set(text, memo)

    for batch in batches:
        keep = []
        for left, right in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
            x, y = tokens(left), tokens(right)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= 80 * (len(x) + len(y) - both))
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b")], names=["a", "b"]
        ).filter(pa.array(keep, pa.bool_()))


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` that link, compared on their whole texts.  ``pairs`` comes from a written table."""
    involved = materialize(
        pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct().join(classes.select("row", "doc_id", "content"), "row"),
        "join-involved",
    )
    texts = materialize(_texts(docs, involved), "join-sides")
    both = (
        pairs.select("a", "b")
        .join(texts.select(F.col("row").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("row").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "b", "text_a", "text_b")
    )
    return materialize(both.mapInArrow(_linked, "a bigint, b bigint"), "join-links")


def _sizes_fit(a: Column, b: Column) -> Column:
    return (5 * a >= 4 * b) & (5 * b >= 4 * a)


# ---- groups of similar sets


def _leaders(classes: DataFrame) -> DataFrame:
    """(a, b): every class with the first and the last class of each of its minhash buckets, where sizes allow a link."""
    keyed = classes.select("row", "n", F.explode("bands").alias("band"))
    heads = (
        keyed.groupBy("band")
        .agg(F.min(F.struct("row", "n")).alias("first"), F.max(F.struct("row", "n")).alias("last"))
        .where("first.row <> last.row")
    )
    return (
        keyed.join(materialize(heads, "join-heads"), "band")  # written, so that a hot band is split
        .select("row", "n", F.explode(F.array("first", "last")).alias("h"))
        .where(F.col("row") != F.col("h.row"))
        .where(_sizes_fit(F.col("n"), F.col("h.n")))
        .select(F.least("row", "h.row").alias("a"), F.greatest("row", "h.row").alias("b"))
        .distinct()
    )


def _components(links: DataFrame) -> DataFrame:
    """(row, root) for every row of the links (a, b) whose component has a smaller one."""
    return representatives(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).select(
        F.col("id").alias("row"), F.col("least_id").alias("root")
    )


# ---- token-group matrix


def _postings(buckets: int, giants: np.ndarray):
    """Matrix entries packed by bucket of the hash range: one row per chunk and bucket."""
    step = int(_LIMIT) // buckets + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            at = 0
            sizes = batch.column("w").to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + BUCKET_TOKENS // 2, side="right")))
                yield from _packed(batch.slice(at, to - at), sizes[at:to])
                at = to

    def _packed(part: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        tokens = part.column("low").flatten().to_numpy(zero_copy_only=False)
        groups = np.repeat(part.column("g").to_numpy(zero_copy_only=False), sizes)
        if len(giants):
            spot = np.minimum(np.searchsorted(giants, tokens), len(giants) - 1)
            giant = giants[spot] == tokens
            hot, count = np.unique(groups[giant], return_counts=True)
            if len(hot):  # giants are hot without being looked up
                place = -1 - hot % GIANT_BUCKETS
                for at in np.unique(place).tolist():
                    own = place == at
                    yield _rows(np.array([at]), [hot[own].tobytes()], [count[own].astype(np.int64).tobytes()])
            tokens, groups = tokens[~giant], groups[~giant]
        if not len(tokens):
            return
        bucket = tokens // step
        order = np.argsort(bucket, kind="stable")
        bucket, tokens, groups = bucket[order], tokens[order], groups[order]
        firsts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        cuts = np.append(firsts, len(bucket))
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        yield _rows(
            bucket[firsts], [groups[i:j].tobytes() for i, j in spans], [tokens[i:j].tobytes() for i, j in spans]
        )

    def _rows(bucket: np.ndarray, groups: list[bytes], tokens: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket.astype(np.int64)), pa.array(groups, pa.binary()), pa.array(tokens, pa.binary())],
            names=["bucket", "groups", "tokens"],
        )

    return pack


_MATCHES = "a bigint, b bigint, shared bigint"


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    """The packed numbers of all rows, copied once."""
    parts = [np.frombuffer(value.as_buffer(), np.int64) for value in column if value.is_valid]
    return np.concatenate([np.zeros(0, np.int64), *parts])


def _matched(table: pa.Table) -> pa.Table:
    """Of one bucket: (group, group, shared tokens), and (group, null, hot tokens).

    The giants' rows (buckets below 0) already hold counts.
    """
    release()
    groups, tokens = _unpacked(table.column("groups")), _unpacked(table.column("tokens"))
    left, right, shared = [], [], []
    if table.num_rows and table.column("bucket")[0].as_py() < 0:
        hot_groups, hot_counts = groups, tokens
    else:
        order = np.lexsort((groups, tokens))
        groups, tokens = groups[order], tokens[order]
        new = np.ones(len(tokens), bool)  # a group holds a token once
        new[1:] = (tokens[1:] != tokens[:-1]) | (groups[1:] != groups[:-1])
        groups, tokens = groups[new], tokens[new]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
        held = np.diff(np.append(first, len(tokens)))
        hot = held > HOT_GROUPS
        hot_groups, hot_counts = np.unique(groups[ranges(first[hot], held[hot])], return_counts=True)
        for size in np.unique(held[(held > 1) & ~hot]).tolist():
            rows = groups[first[held == size][:, None] + np.arange(size)]
            i, j = np.triu_indices(size, 1)
            left.append(rows[:, i].ravel())
            right.append(rows[:, j].ravel())
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            shared = np.diff(np.append(first, len(a)))
            left, right = a[first], b[first]
    none = np.zeros(len(hot_groups), np.int64)
    hidden = np.concatenate([np.zeros(len(left), bool), np.ones(len(hot_groups), bool)])
    return pa.table(
        {
            "a": pa.array(np.concatenate([np.asarray(left, np.int64), hot_groups]).astype(np.int64)),
            "b": pa.array(np.concatenate([np.asarray(right, np.int64), none]).astype(np.int64), mask=hidden),
            "shared": pa.array(np.concatenate([np.asarray(shared, np.int64), hot_counts]).astype(np.int64)),
        }
    )


def _giants(sets: DataFrame, total: int) -> np.ndarray:
    """Sorted tokens that would overfill a bucket; at most 100,000 of them, since each holds that share of all tokens."""
    least = max(GIANT_TOKENS, total // 100_000)
    often = sets.select(F.explode("often").alias("o")).groupBy("o.token").agg(F.sum("o.sets").alias("n"))
    return np.array(sorted(r[0] for r in often.where(F.col("n") > least).select("token").collect()), np.int64)


def _qualifying(members: DataFrame, matches: DataFrame, hot: DataFrame) -> DataFrame:
    """(a, b): pairs of groups whose bound on the overlap of any two members reaches the threshold."""
    groups = (
        members.groupBy("g")
        .agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("w")).alias("rest"))
        .join(hot, "g", "left")
        .select("g", "least", "most", "rest", F.coalesce("hot", F.lit(0)).alias("hot"))
    )
    groups = materialize(groups, "join-bounds")
    pairs = matches.where("b is not null").groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    left = groups.select(F.col("g").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("least", "most", "rest", "hot")])
    right = groups.select(F.col("g").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("least", "most", "rest", "hot")])
    bound = F.col("shared") + F.least("hot_a", "hot_b") + F.least("rest_a", "rest_b")
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where((5 * F.col("most_a") >= 4 * F.col("least_b")) & (5 * F.col("most_b") >= 4 * F.col("least_a")))
        .where(9 * bound >= 4 * (F.col("least_a") + F.col("least_b")))
        .select("a", "b")
    )


# ---- sets whose prefix the matrix does not show


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in chunks(batches):
        memo = _Words()
        sets = [shingle_set(t, memo).view(np.int64) for t in texts_of(chunk)]
        yield pa.RecordBatch.from_arrays([chunk.column("row"), _lists(sets)], names=["row", "tokens"])


def _sized(rows: DataFrame, key: str, most: int, name: str) -> DataFrame:
    """``rows`` (row, n, …) with ``name``: an even split, by hash, of the rows of one ``key`` into parts of about ``most``
    rows and SIDE_TOKENS tokens.  The counts are written, so that the join splits a hot key."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(most)), F.ceil(F.sum("n") / F.lit(SIDE_TOKENS)))
    counts = materialize(rows.groupBy(key).agg(parts.alias("_parts")), "join-parts")
    return rows.join(counts, key).withColumn(name, F.pmod(F.xxhash64("row", F.lit(3)), "_parts")).drop("_parts")


_CHUNKS = "chunk bigint, row array<bigint>, g array<bigint>, size array<bigint>, tokens array<bigint>, seen array<struct<token:bigint,sets:bigint>>"


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk of neighbouring sets, named by its first row: the sets, and how many of them hold each token."""
    seen_type = pa.list_(pa.struct([("token", pa.int64()), ("sets", pa.int64())]))
    held: list[tuple[int, int, np.ndarray]] = []

    def together() -> pa.RecordBatch:
        tokens = np.concatenate([t for _, _, t in held])
        names, found = np.unique(tokens, return_counts=True)
        pairs = pa.StructArray.from_arrays([pa.array(names), pa.array(found.astype(np.int64))], names=["token", "sets"])
        whole = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([held[0][0]], pa.int64()),
                whole(pa.array([r for r, _, _ in held], pa.int64())),
                whole(pa.array([g for _, g, _ in held], pa.int64())),
                whole(pa.array([len(t) for _, _, t in held], pa.int64())),
                whole(pa.array(tokens)),
                whole(pairs).cast(seen_type),
            ],
            names=["chunk", "row", "g", "size", "tokens", "seen"],
        )

    total = 0
    for batch in (b for b in batches if b.num_rows):
        flat, sizes = _flat(batch.column("tokens"))
        for row, g, tokens in zip(
            batch.column("row").to_pylist(), batch.column("g").to_pylist(), np.split(flat, np.cumsum(sizes)[:-1]), strict=True
        ):
            if held and total + len(tokens) > CHUNK_TOKENS:
                yield together()
                held, total = [], 0
            held.append((row, g, tokens))
            total += len(tokens)
    if held:
        yield together()


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The items of a list column end to end, and the length of each list."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


_TAKING = "chunk bigint, row bigint, g bigint, n bigint, key bigint, prefix array<bigint>, tokens array<bigint>"


def _prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every set of a chunk that shows a token of several sets: its most frequent one, and its prefix in rarity order.

    Tokens of one set alone come first in the order and cannot be shared: only their number matters.
    """
    for batch in batches:
        for at in range(batch.num_rows):
            chunk = batch.slice(at, 1)
            token, often = (chunk.column("known").flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            order = np.argsort(token)
            token, often = token[order], often[order]
            rows, groups = (chunk.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("row", "g"))
            sizes = chunk.column("size").flatten().to_numpy(zero_copy_only=False)
            sets = np.split(chunk.column("tokens").flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)[:-1])
            kept: list[int] = []
            keys, prefixes = [], []
            for i, own in enumerate(sets):
                spot = np.minimum(np.searchsorted(token, own), len(token) - 1)
                shared = token[spot] == own
                left = len(own) - -(-4 * len(own) // 5) + 1 - int((~shared).sum())
                if left <= 0:
                    continue
                rank = np.lexsort((own[shared], often[spot[shared]]))
                kept.append(i)
                keys.append(own[shared][rank[-1]])
                prefixes.append(own[shared][rank[:left]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk.column("chunk")[0].as_py()] * len(kept), pa.int64()),
                    pa.array(rows[kept], pa.int64()),
                    pa.array(groups[kept], pa.int64()),
                    pa.array(sizes[kept], pa.int64()),
                    pa.array(keys, pa.int64()),
                    _lists(prefixes),
                    _lists([sets[i] for i in kept]),
                ],
                names=["chunk", "row", "g", "n", "key", "prefix", "tokens"],
            )


def _compared(queries: pa.Table, members: pa.Table, mutual: bool) -> pa.Table:
    """Opens one group for some queries: (a, b) of the links, one for each query and connected part of the members.

    ``mutual``: the members ask the query's group as well, so one direction is enough.
    """
    a: list[int] = []
    b: list[int] = []
    if queries.num_rows and members.num_rows:
        rows, parts = queries.column("row").to_pylist(), queries.column("g").to_pylist()
        asked, lengths = _flat(queries.column("tokens"))
        names, of = members.column("member").to_numpy(), members.column("member_g").to_numpy()
        flat, sizes = _flat(members.column("member_tokens"))
        # the column of the matrix: all tokens of the group, with the members that hold each
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        for row, part, tokens in zip(rows, parts, np.split(asked, np.cumsum(lengths)[:-1]), strict=True):
            low, high = np.searchsorted(flat, tokens, "left"), np.searchsorted(flat, tokens, "right")
            if 5 * int((high > low).sum()) < 4 * len(tokens):
                continue  # the bound: the group's union lacks too many of the query's tokens
            shared = np.bincount(owner[ranges(low, high - low)], minlength=len(sizes))
            linked = (100 * shared >= 80 * (len(tokens) + sizes - shared)) & (of != part)
            if mutual:
                linked &= names > row
            for member in names[np.flatnonzero(linked)[np.unique(of[linked], return_index=True)[1]]].tolist():
                a.append(row)
                b.append(member)
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _meeting(sets: pa.Table, met: pa.Table) -> pa.Table:
    """(row, n, key): each set of one chunk with the families that show a token of its prefix, once."""
    hits: list[np.ndarray] = []
    rows, sizes, keys = sets.column("row").to_numpy(), sets.column("n").to_numpy(), met.column("key").to_numpy()
    if len(rows) and len(keys):
        flat, lengths = _flat(sets.column("prefix"))
        owner = np.repeat(np.arange(len(lengths)), lengths)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        tokens, shared = _flat(met.column("tokens"))
        for own in np.split(tokens, np.cumsum(shared)[:-1]):
            low, high = np.searchsorted(flat, own, "left"), np.searchsorted(flat, own, "right")
            hits.append(np.unique(owner[ranges(low, high - low)]))
    found = np.concatenate([np.zeros(0, np.int64), *hits])
    key = np.repeat(keys[: len(hits)], [len(h) for h in hits])
    return pa.table({"row": pa.array(rows[found]), "n": pa.array(sizes[found]), "key": pa.array(key)})


def _asking(sets: DataFrame, met: DataFrame) -> DataFrame:
    """(row, n, key) of the sets (chunk, row, n, prefix) and the families that their chunk met (chunk, key, tokens).

    A task holds one chunk and at most about QUERY_SETS of its families, with at most about SIDE_TOKENS tokens; a chunk
    that met more is handed out again for every further part of them.
    """
    sized = _sized(met.select("chunk", F.col("key").alias("row"), F.size("tokens").cast("bigint").alias("n"), "tokens"), "chunk", QUERY_SETS, "part")
    sized = materialize(sized.select("chunk", "part", F.col("row").alias("key"), "tokens"), "join-met-parts")
    parts = materialize(sized.groupBy("chunk").agg(F.max("part").alias("last")), "join-last")
    held = sets.join(parts, "chunk").select("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("part"), "row", "n", "prefix")
    return held.groupBy("chunk", "part").cogroup(sized.groupBy("chunk", "part")).applyInArrow(_meeting, "row bigint, n bigint, key bigint")


def _short_links(docs: DataFrame, short: DataFrame) -> DataFrame:
    """(a, b): links among the sets in ``short`` (row, doc_id, content, n, g), at least one between any two of their g.

    How many sets hold a token is counted per chunk of neighbouring sets: the sets are dealt by their smallest token,
    so near copies are neighbours and their chunk counts, and looks up, each of their tokens once.  The sets with the
    same most frequent token are a family, split into groups of bounded size.  A query meets the families that hold one
    of its rarest tokens among theirs; the union of each of their groups bounds the overlap, and only groups that pass
    are opened, each query against all members at once.  Chunks and families meet first, so a query and a family make
    one row however many tokens they share.  Rows are queries and groups, never pairs of sets.
    """
    tokens = _texts(docs, short).mapInArrow(_exploded, "row bigint, tokens array<bigint>")
    near = tokens.join(short.select("row", "g"), "row").orderBy(F.array_min("tokens"), "row")
    parts = materialize(near.select("row", "g", "tokens").mapInArrow(_chunked, _CHUNKS), "join-short")
    seen = parts.select("chunk", F.explode("seen").alias("s")).select("chunk", "s.token", "s.sets")
    several = materialize(seen.groupBy("token").agg(F.sum("sets").alias("df")).where("df > 1"), "join-df")
    known = seen.join(several, "token").groupBy("chunk").agg(F.collect_list(F.struct("token", "df")).alias("known"))
    sets = parts.drop("seen").join(known, "chunk")
    sets = materialize(sets.select("chunk", "row", "g", "size", "tokens", "known").mapInArrow(_prefixed, _TAKING), "join-short-taking")
    grouped = materialize(_sized(sets.select("row", "n", "key"), "key", GROUP_SETS, "piece"), "join-short-groups")
    entries = materialize(sets.select("chunk", "row", "n", "key", F.explode("prefix").alias("token")), "join-entries")
    matrix = materialize(entries.select("token", "key").distinct(), "join-matrix")
    # a chunk meets a family once, with all tokens that the two show
    shown = materialize(entries.select("chunk", "token").distinct(), "join-shown")
    met = shown.join(matrix, "token").groupBy("chunk", "key").agg(F.collect_list("token").alias("tokens"))
    asked = _asking(sets.select("chunk", "row", "n", "prefix"), materialize(met, "join-met"))
    pieces = materialize(grouped.select("key", "piece").distinct(), "join-pieces")
    # written, since the openings read it for their counts and again
    asked = materialize(asked.join(pieces, "key").select("row", "n", F.struct("key", "piece").alias("group")), "join-asking")
    members = grouped.select("row", F.struct("key", "piece").alias("group"))
    return _open(asked, members, sets.select("row", "g", "tokens"), mutual=True)


# ---- opening pairs of groups


def _open(asked: DataFrame, members: DataFrame, sets: DataFrame, mutual: bool) -> DataFrame:
    """Links (a, b) of the queries ``asked`` (row, n, group) with ``members`` (row, group); ``sets`` has (row, g, tokens).

    A task holds one group of at most about GROUP_SETS sets and QUERY_SETS of its queries, each side with at most about
    SIDE_TOKENS tokens; a group with more queries is handed out again for every further part of them.
    """
    asked = materialize(_sized(asked, "group", QUERY_SETS, "chunk"), "join-asked")
    parts = materialize(asked.groupBy("group").agg(F.max("chunk").alias("last")), "join-last")
    queries = asked.join(sets, "row").select("group", "chunk", "row", "g", "tokens")
    held = (
        members.join(parts, "group")
        .select("row", "group", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias("chunk"))
        .join(sets, "row")
        .select("group", "chunk", F.col("row").alias("member"), F.col("g").alias("member_g"), F.col("tokens").alias("member_tokens"))
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        return _compared(left, right, mutual)

    opened = queries.groupBy("group", "chunk").cogroup(held.groupBy("group", "chunk"))
    return materialize(opened.applyInArrow(compare, "a bigint, b bigint"), "join-links")


def _opened(docs: DataFrame, members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links between members of the given pairs of groups, at least one between any two connected parts.

    Two single sets are compared as they are.  Otherwise the sets of the smaller group ask the larger one.
    """
    sizes = materialize(members.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "join-sizes")
    sized = (
        pairs.join(sizes.select(F.col("g").alias("a"), F.col("size").alias("s")), "a", "left")
        .join(sizes.select(F.col("g").alias("b"), F.col("size").alias("t")), "b", "left")
        .select("a", "b", F.coalesce("s", F.lit(1)).alias("s"), F.coalesce("t", F.lit(1)).alias("t"))
    )
    sized = materialize(sized, "join-pairs")
    single = _verified(docs, members, sized.where("s = 1 and t = 1"))  # a single set's group has its number
    turned = F.col("s") > F.col("t")
    asks = sized.where("s > 1 or t > 1").select(
        F.when(turned, F.col("b")).otherwise(F.col("a")).alias("g"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("to")
    )
    large = materialize(
        _sized(members.join(asks.select(F.col("to").alias("g")).distinct(), "g", "left_semi").select("row", "n", "g"), "g", GROUP_SETS, "piece"),
        "join-groups",
    )
    pieces = materialize(large.select(F.col("g").alias("to"), "piece").distinct(), "join-group-pieces")
    asked = materialize(
        asks.join(members.select("row", "n", "g"), "g").join(pieces, "to").select("row", "n", F.struct(F.col("to").alias("g"), "piece").alias("group")),
        "join-asking",
    )
    involved = materialize(
        members.join(asked.select("row").unionByName(large.select("row")).distinct(), "row", "left_semi").select("row", "doc_id", "content", "g"),
        "join-involved",
    )
    tokens = _texts(docs, involved).mapInArrow(_exploded, "row bigint, tokens array<bigint>")
    sets = materialize(tokens.join(involved.select("row", "g"), "row"), "join-opened-sets")
    return single.unionByName(_open(asked, large.select("row", F.struct("g", "piece").alias("group")), sets, mutual=False))


def linked_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, doc_id, content, n_shingles, component_id, is_first) for every row of ``docs``.

    ``row`` numbers the rows, ``content`` is a hash of the text, ``component_id`` the smallest id reachable by links.
    """
    ship(docs.sparkSession)
    source = docs.select(
        F.col(key).cast("bigint").alias("doc_id"),
        F.xxhash64(F.col(text).cast("string")).alias("content"),
        F.col(text).cast("string").alias("text"),
    )
    sets = materialize(source.mapInArrow(_sets, _SETS).withColumn("row", F.monotonically_increasing_id()), "join-sets")
    slim = sets.select("row", "doc_id", "content", "n", "w", "digest")
    least = slim.where("digest is not null").groupBy("digest").agg(F.min("row").alias("class"), F.count(F.lit(1)).alias("copies"))
    least = materialize(least.where("copies > 1"), "join-heads")  # written, so that a hot digest is split
    again = materialize(
        slim.join(least, "digest").where("row <> class").select("row", "class"), "join-copies"
    )
    copies = small_side(again)
    classes = sets.where("n > 0").join(copies, "row", "left_anti")

    # groups: classes linked to a common leader
    pairs = materialize(_leaders(classes.select("row", "n", "bands")), "join-leaders")
    links = _verified(source, slim, pairs)
    grouped = materialize(_components(links), "join-groups")
    with_group = classes.join(small_side(grouped), "row", "left").withColumn("g", F.coalesce("root", "row"))
    members = materialize(with_group.select("row", "doc_id", "content", "n", "w", "g"), "join-members")

    # matrix, bound, and the pairs of groups to open
    total = members.agg(F.sum("w")).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_TOKENS))
    matches = materialize(
        with_group.select("g", "w", "low")
        .mapInArrow(_postings(buckets, _giants(sets, total)), "bucket bigint, groups binary, tokens binary")
        .groupBy("bucket")
        .applyInArrow(_matched, _MATCHES),
        "join-matches",
    )
    hot = materialize(matches.where("b is null").groupBy(F.col("a").alias("g")).agg(F.sum("shared").alias("hot")), "join-hot")
    qualifying = _qualifying(members, matches, hot)
    needed = F.col("n") - F.ceil(4 * F.col("n") / 5) + 1
    short = materialize(
        members.join(hot, "g", "left").where(F.col("w") - F.coalesce("hot", F.lit(0)) < needed).select("row", "doc_id", "content", "n", "g"),
        "join-short-sets",
    )
    opened = materialize(qualifying, "join-qualifying")
    every = again.select(F.col("class").alias("a"), F.col("row").alias("b")).unionByName(links)
    every = every.unionByName(_opened(source, members, opened)).unionByName(_short_links(source, short))
    roots = materialize(_components(every), "join-roots")
    placed = slim.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    first = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first"))
    return placed.join(materialize(first, "join-first"), "root").select(
        "row",
        "doc_id",
        "content",
        F.col("n").alias("n_shingles"),
        F.col("first.doc_id").alias("component_id"),
        (F.col("first.row") == F.col("row")).alias("is_first"),
    )


def one_per_component(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with the smallest id of their component, and all rows without links; columns unchanged,
    whatever their names."""
    found = materialize(linked_components(docs, key, text), "join-result")
    names = F.col("doc_id").alias("_drop_id"), F.col("content").alias("_drop_content")
    stays = found.where("is_first").select(*names)
    goes = found.where("not is_first").select(*names).distinct()
    agree = F.col("k._drop_id").eqNullSafe(F.col("g._drop_id")) & (F.col("k._drop_content") == F.col("g._drop_content"))
    # rows that agree in id and text with the row that stays: they can only go as repeats of it
    repeated = materialize(goes.alias("g").join(stays.alias("k"), agree, "left_semi"), "join-repeated")
    dropped = materialize(goes.alias("g").join(small_side(repeated).alias("k"), agree, "left_anti"), "join-dropped")
    left = without_rows(docs, dropped, key, text)
    if repeated.isEmpty():
        return left
    held = left.select(F.struct("*").alias("_doc"), F.col(key).alias("_id"), F.xxhash64(F.col(text).cast("string")).alias("_same"))
    at = (F.col("_same") == F.col("_drop_content")) & F.col("_id").eqNullSafe(F.col("_drop_id"))
    once = held.join(small_side(repeated), at, "left_semi").dropDuplicates(["_id", "_same"])
    return held.join(small_side(repeated), at, "left_anti").unionByName(once).select("_doc.*")
