"""How far the sources of a language differ in their words, term by term and pair by pair, in whole numbers.

The terms that enough documents of a language hold are found by refining byte prefixes: the documents of each prefix
are counted, prefixes below the threshold are discarded with all their extensions, and the rest is extended, with the
lengths doubling, until only complete terms are left.  Documents are sorted by language and source, a hot source over
many tasks, and tokenised once, in chunks of whole documents, so that a chunk counts its terms for few groups.  A
chunk's part of a prefix is one row with its terms and the numbers of their documents: distinct documents are counted
inside the row and added up over the chunks.

Every (language, source) group and every language then gives every kept term its share p of smoothed counts.  A pair
of sources is the sum of f over all kept terms.  f has one value for terms that neither holds, so that the sum is put
together from the terms that one holds (by how often) and from those that both hold.

Null texts, languages and sources are empty strings.  Rows are documents of their own, also where they repeat an id or
everything.  A group without terms has pairs, but no terms; a language without kept terms has pairs of value 0; an empty
table has no rows.  Ties rank by the item's bytes.  Other columns of ``docs`` are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.tasks import ship
from weftline.runtime import materialize

LEAST_DOCUMENTS = 10
TOP_TERMS = 10
UNIT = 1_000_000_000
CHUNK_BYTES = 8 << 20  # text bytes that are tokenised together
FIRST_BYTES = 3        # length of the first prefixes
OUT_ROWS = 20_000

# A-Z become a-z; letters and all bytes of other characters stay; everything else separates terms.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("count", pa.int64())])
_PREFIXES = pa.schema(
    [("lang", pa.string()), ("prefix", pa.binary()), ("done", pa.bool_()), ("docs", pa.int64()),
     ("terms", pa.binary()), ("sizes", pa.binary()), ("holders", pa.binary())]
)
_BOTH = "lang string, source string, term binary, count bigint, prefix binary, done boolean, docs bigint, terms binary, sizes binary, holders binary"


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[str], list[str]]]:
    """(texts, languages, sources) of whole documents with about CHUNK_BYTES of text."""
    texts, langs, sources, held = [], [], [], 0
    for batch in batches:
        for text, lang, source in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            texts.append(text)
            langs.append(lang)
            sources.append(source)
            held += len(text)
            if held >= CHUNK_BYTES:
                yield texts, langs, sources
                texts, langs, sources, held = [], [], [], 0
    if texts:
        yield texts, langs, sources


def _numbered(values: list[str]) -> tuple[list[str], np.ndarray]:
    names = {v: i for i, v in enumerate(dict.fromkeys(values))}
    return list(names), np.fromiter(map(names.__getitem__, values), np.int64, len(values))


class _Terms(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: (lang, source, term, count), and the first prefixes of every language of a chunk."""
    for texts, langs, sources in _gathered(batches):
        numbers = _Terms()
        parts = []
        for text in texts:
            found = text.encode("utf-8", "surrogatepass").translate(_FOLD).split()
            parts.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
        if not numbers:
            continue
        terms = sorted(numbers)
        rank = np.empty(len(terms), np.int64)
        rank[[numbers[t] for t in terms]] = np.arange(len(terms))
        doc = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        ids = rank[np.concatenate(parts)]
        lang_names, lang = _numbered(langs)
        group_names, group = _numbered(list(zip(langs, sources, strict=True)))

        pairs, found = np.unique(ids * len(texts) + doc, return_counts=True)
        term_of, holder = np.divmod(pairs, len(texts))
        counted, place = np.unique(group[holder] * len(terms) + term_of, return_inverse=True)
        count = np.zeros(len(counted), np.int64)
        np.add.at(count, place, found)
        of, term = np.divmod(counted, len(terms))
        spelled = pa.array(terms, pa.binary())
        group_lang, group_source = (pa.array(names, pa.string()) for names in zip(*group_names, strict=True))
        for at in range(0, len(counted), OUT_ROWS):
            own, of_group = pa.array(term[at : at + OUT_ROWS]), pa.array(of[at : at + OUT_ROWS])
            yield _both(
                {
                    "lang": group_lang.take(of_group),
                    "source": group_source.take(of_group),
                    "term": spelled.take(own),
                    "count": count[at : at + OUT_ROWS],
                }
            )
        for number, name in enumerate(lang_names):
            own = lang[holder] == number
            held, sizes = np.unique(term_of[own], return_counts=True)
            rows = _extended(name, [terms[t] for t in held.tolist()], sizes, holder[own].astype(np.int32), FIRST_BYTES)
            yield from map(_both, _batches(rows))


def _both(columns: dict) -> pa.RecordBatch:
    fields = [*_COUNTS, *[f for f in _PREFIXES if f.name != "lang"]]
    rows = len(columns["lang"])
    return pa.RecordBatch.from_arrays(
        [_column(columns[f.name], f.type) if f.name in columns else pa.nulls(rows, f.type) for f in fields],
        names=[f.name for f in fields],
    )


def _column(values, kind: pa.DataType) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, kind)


def _extended(lang: str, terms: list[bytes], sizes: np.ndarray, holders: np.ndarray, length: int) -> Iterator[tuple]:
    """Rows of _PREFIXES for sorted terms, cut at ``length`` bytes; ``sizes`` of ``holders`` belong to each term.

    A term of at most that length is done.  The others share a row per prefix.
    """
    ends = np.cumsum(sizes).tolist()
    at, start = 0, 0
    while at < len(terms):
        prefix = terms[at][:length]
        if len(terms[at]) <= length:
            yield lang, prefix, True, ends[at] - start, None, None, None
            start, at = ends[at], at + 1
            continue
        to = at + 1
        while to < len(terms) and terms[to].startswith(prefix):
            to += 1
        held = holders[start : ends[to - 1]]
        docs = len(held) if to == at + 1 else len(set(held.tolist())) if len(held) < 200 else len(np.unique(held))
        yield lang, prefix, False, docs, b"\n".join(terms[at:to]), sizes[at:to].astype(np.int32).tobytes(), held.tobytes()
        start, at = ends[to - 1], to


def _batches(rows: Iterator[tuple]) -> Iterator[dict]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[6] or b"")
        if len(held) >= OUT_ROWS or size >= CHUNK_BYTES:
            yield dict(zip(_PREFIXES.names, zip(*held, strict=True), strict=True))
            held, size = [], 0
    if held:
        yield dict(zip(_PREFIXES.names, zip(*held, strict=True), strict=True))


def _refined(length: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("lang", "terms", "sizes", "holders")]
                for lang, terms, sizes, holders in zip(*columns, strict=True):
                    yield from _extended(lang, terms.split(b"\n"), np.frombuffer(sizes, np.int32), np.frombuffer(holders, np.int32), length)

        for columns in _batches(rows()):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in _PREFIXES], schema=_PREFIXES)

    return split


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> tuple[DataFrame, DataFrame]:
    """((lang, term, docs) in at least ``least`` documents, (lang, source, term, count) of every chunk).

    ``docs`` has the columns text, lang and source, without nulls.
    """
    ship(docs.sparkSession)
    near = docs.select("text", "lang", "source", F.monotonically_increasing_id().alias("row")).orderBy("lang", "source", "row")
    both = materialize(near.select("text", "lang", "source").mapInArrow(_tokenised, _BOTH), "terms")
    counts = both.where("prefix is null").select("lang", "source", "term", "count")
    level = both.where("prefix is not null").select(*_PREFIXES.names)
    length, kept = FIRST_BYTES, []
    while True:
        held = level.groupBy("lang", "prefix", "done").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
        held = materialize(held, "prefixes")
        kept.append(held.where("done").select("lang", F.col("prefix").alias("term"), "docs"))
        going = held.where("not done").select("lang", "prefix")
        if going.isEmpty():
            break
        length *= 2
        open_rows = level.where("not done").join(going, ["lang", "prefix"], "left_semi")
        schema = level.schema
        level = materialize(open_rows.select("lang", "terms", "sizes", "holders").mapInArrow(_refined(length), schema), "level")
    terms = kept[0]
    for one in kept[1:]:
        terms = terms.unionByName(one)
    return terms, counts


def _share(count: Column, smoothed: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / smoothed), in decimals: the product may pass 64 bits."""
    wide = "decimal(38,0)"
    scaled = F.lit(UNIT).cast("decimal(10,0)") * (count.cast("decimal(18,0)") + F.lit(2).cast("decimal(1,0)"))
    return (F.lit(1).cast("bigint") + F.call_function("div", scaled.cast(wide), smoothed.cast("decimal(20,0)"))).cast("bigint")


def _gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); shares are below 2^30 + 2, so that the square fits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, a, b, extra) of the sources a < b of one term's list: what their common terms add to the sum."""

    def f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // (p + q)

    for batch in batches:
        held = batch.column("held")
        lang_names, lang = _numbered(batch.column("lang").to_pylist())
        flat, size = held.flatten(), held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        source, p, rest = (flat.field(n).to_numpy(zero_copy_only=False) for n in ("source_no", "p", "rest"))
        starts = np.cumsum(size) - size
        keys, values = [], []
        span = int(source.max()) + 1 if len(source) else 1
        for n in np.unique(size[size > 1]).tolist():
            rows = np.flatnonzero(size == n)
            i, j = np.triu_indices(n, 1)
            step = max(1, 500_000 // len(i))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                index = starts[some][:, None] + np.arange(n)
                x, y = index[:, i].ravel(), index[:, j].ravel()
                extra = f(p[x], p[y]) - f(p[x], rest[y]) - f(rest[x], p[y]) + f(rest[x], rest[y])
                key = (np.repeat(lang[some], len(i)) * span + source[x]) * span + source[y]
                key, inverse = np.unique(key, return_inverse=True)
                total = np.zeros(len(key), np.int64)
                np.add.at(total, inverse, extra)
                keys.append(key)
                values.append(total)
        if not keys:
            continue
        key, value = np.concatenate(keys), np.concatenate(values)
        rest_key, b = np.divmod(key, span)
        of, a = np.divmod(rest_key, span)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang_names[k] for k in of.tolist()]), pa.array(a), pa.array(b), pa.array(value)],
            names=["lang", "a", "b", "extra"],
        )


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, p, q, value, rank): all pairs of sources per language, and the terms that set a source
    apart from its language; p and q are null for pairs, where they differ by term."""
    clean = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    terms, counts = kept_terms(clean, least)
    summed = counts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"))
    found = materialize(summed.join(terms.select("lang", "term"), ["lang", "term"]), "kept-counts")

    # groups and languages with their smoothed totals; V = 0 leaves the totals null
    kinds = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = found.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = clean.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(kinds, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"))
    smoothed = F.nullif(F.col("n") + 2 * F.col("v"), F.lit(0))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.select(
        "lang", "source", "n", "v", smoothed.alias("smoothed"), number.cast("bigint").alias("source_no"),
        _share(F.lit(0), smoothed).alias("rest"),
    )
    groups = materialize(groups, "groups")
    shares = found.join(groups, ["lang", "source"]).select(
        "lang", "source", "source_no", "term", "count", _share(F.col("count"), F.col("smoothed")).alias("p"), "rest"
    )
    shares = materialize(shares, "shares")
    return _term_rows(shares, groups, top).unionByName(_pair_rows(shares, groups))


def _term_rows(shares: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    whole = groups.groupBy("lang").agg((F.sum("n") + 2 * F.max("v")).alias("whole"))
    per_term = shares.groupBy("lang", "term").agg(F.sum("count").alias("count"))
    q = materialize(per_term.join(whole, "lang").select("lang", "term", _share(F.col("count"), F.col("whole")).alias("q")), "language-shares")
    above = shares.join(q, ["lang", "term"]).where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "p", "q",
        _gap(F.col("p"), F.col("q")).alias("value"),
    )
    # the rank limit runs per map task before a group's rows meet
    return above.withColumn("rank", _rank()).where(F.col("rank") <= top)


def _rank() -> Column:
    return F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))


def _pair_rows(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """A pair's sum is that of v terms that neither holds, corrected for the terms of either and of both."""
    left = groups.select("lang", *[F.col(c).alias(f"{c}_a") for c in ("source", "source_no", "rest")], "v")
    right = groups.select("lang", *[F.col(c).alias(f"{c}_b") for c in ("source", "source_no", "rest")])
    pairs = materialize(left.join(right, "lang").where("source_no_a <> source_no_b"), "source-pairs")
    none = _gap(F.col("rest_a"), F.col("rest_b"))

    # terms of one source alone: every share it gives, with the number of its terms
    often = shares.groupBy("lang", "source_no", "p").agg(F.count(F.lit(1)).alias("terms"))
    often = materialize(often.withColumnRenamed("source_no", "source_no_a"), "shares-by-value")
    alone = (
        pairs.select("lang", "source_no_a", "source_no_b", "rest_a", "rest_b")
        .join(often, ["lang", "source_no_a"])
        .groupBy("lang", "source_no_a", "source_no_b")
        .agg(F.sum(F.col("terms") * (_gap(F.col("p"), F.col("rest_b")) - none)).alias("extra"))
    )
    alone = alone.select("lang", F.col("source_no_a").alias("a"), F.col("source_no_b").alias("b"), "extra")
    held = shares.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source_no", "p", "rest"))).alias("held"))
    common = held.select("lang", "held").mapInArrow(_pair_sums, "lang string, a bigint, b bigint, extra bigint")
    common = materialize(common.groupBy("lang", "a", "b").agg(F.sum("extra").alias("extra")), "common-terms")
    every = alone.unionByName(alone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "extra"))
    every = every.unionByName(common).unionByName(common.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "extra"))
    extra = every.groupBy("lang", F.col("a").alias("source_no_a"), F.col("b").alias("source_no_b")).agg(F.sum("extra").alias("extra"))
    value = F.when(F.col("v") == 0, F.lit(0).cast("bigint")).otherwise(F.col("v") * none + F.coalesce("extra", F.lit(0)))
    rows = pairs.join(extra, ["lang", "source_no_a", "source_no_b"], "left").select(
        "lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"),
        F.lit(None).cast("bigint").alias("p"), F.lit(None).cast("bigint").alias("q"), value.cast("bigint").alias("value"),
    )
    return rows.withColumn("rank", _rank())
