"""Language identification by Bayesian evidence fusion.

Text likelihoods come from hashed byte trigrams of labelled texts; a text's evidence is its mean log likelihood times
a bounded number of trigrams, since neighbouring trigrams are not independent.  The fused posterior multiplies them
with the likelihood of the declared language and with a prior of the host.  Host priors are counts of the text
posteriors, smoothed along host, domain, address suffix and all rows; every level is one grouped aggregation, and a
row's own count is left out of its prior.

The posterior knows the labels only, so a text of none of them is told by its mean log likelihood under the language
found: below that language's floor the row is not kept, however sure the posterior is.  Floors are learned from the
labelled texts, each judged without its own trigrams.  A trigram that a language has not shown costs the same under
every language, so it favours none.

Null and empty texts, and texts without letters, give no text evidence: declaration and host decide, or nothing, and
the row is not kept.  Unknown declarations and missing hosts are neutral.  Ties go to the first language by name.
Rows that repeat are judged alike, apart from the row's own count; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.tasks import chunks, ship, texts_of, without_rows
from weftline.runtime import materialize

FEATURES = 1 << 16
TRAINING_ROWS = 20_000   # bound on the distinct texts that the likelihoods are fitted on, drawn by hash and alike per label
SCORES = 1 << 22         # scores (texts x languages) that a task holds at a time
DRAWS = 1 << 40          # range of the hash that texts are drawn by
LABEL_ROWS = 200         # texts of a label that are drawn in any case, however many labels there are
CHUNK_BYTES = 1 << 20    # text bytes whose trigrams are numbered at a time
EVIDENCE = 40            # trigrams that a text counts as at most
LEVEL_WEIGHT = 20.0      # rows' worth of the next wider level in the prior of a host, domain or suffix
DECLARED_WEIGHT = 5.0
MIN_CONFIDENCE = 0.65
FLOOR_SHARE = 0.05       # of a label's own texts at most so many lie below its floor

# Letters of texts in lower case; everything else in ASCII separates words.
_FOLD = np.full(256, 32, np.uint32)
_FOLD[128:] = np.arange(128, 256)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts end to end, and the number of each text's; those without two letters are left out."""
    raw = [f" {t.lower()} ".encode("utf-8", "replace") for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    letters = _FOLD[np.frombuffer(b"".join(raw), np.uint8)]
    if len(letters) < 3:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    a, b, c = letters[:-2], letters[1:-1], letters[2:]
    hashed = (((a * np.uint32(31) + b) * np.uint32(37) + c) * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)
    owner = np.repeat(np.arange(len(raw)), sizes)
    good = ((a != 32).astype(np.int8) + (b != 32) + (c != 32) >= 2) & (owner[:-2] == owner[2:])
    return hashed[good], np.bincount(owner[:-2][good], minlength=len(raw))


def _counted(languages: list[str]):
    place = {l: i for i, l in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, limit=CHUNK_BYTES):
            found, sizes = trigrams(texts_of(chunk))
            label = np.array([place[l] for l in chunk.column("label").to_pylist()], np.int64)
            spot, n = np.unique(np.repeat(label, sizes) * FEATURES + found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(spot), pa.array(n.astype(np.int64))], names=["spot", "n"])

    return count


@dataclass(frozen=True, eq=False)
class Rows:
    """One dense row of FEATURES per language, held as its filled places only."""

    starts: np.ndarray
    features: np.ndarray
    values: np.ndarray
    empty: float

    def __len__(self) -> int:
        return len(self.starts) - 1

    def __getitem__(self, i: int) -> np.ndarray:
        row = np.full(FEATURES, self.empty, self.values.dtype)
        row[self.features[self.starts[i] : self.starts[i + 1]]] = self.values[self.starts[i] : self.starts[i + 1]]
        return row


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    likelihood: Rows  # log P(trigram | language)
    floors: tuple[float, ...]  # per language the least mean log likelihood of a text of it


def _left_out(languages: list[str], model):
    """Mean log likelihood of every labelled text under its label, with the text's own trigrams taken out."""
    place = {l: i for i, l in enumerate(languages)}

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals, unseen = model.value
        for chunk in chunks(batches, limit=CHUNK_BYTES):
            found, sizes = trigrams(texts_of(chunk))
            labels = chunk.column("label").to_pylist()
            texts = np.split(found, np.cumsum(sizes)[:-1])
            means = [None] * len(labels)
            for label in set(labels):
                of_label, total = counts[place[label]], totals[place[label]]
                for i, own in enumerate(texts):
                    if labels[i] == label and len(own):
                        _, back, n = np.unique(own, return_inverse=True, return_counts=True)
                        others = of_label[own] - n[back]
                        means[i] = float(np.where(others > 0, np.log((others + 0.5) / (total - len(own))), unseen).mean())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(means, pa.float64())], names=["label", "mean"])

    return left_out


def _floors(means: DataFrame, languages: list[str]) -> tuple[float, ...]:
    """Half-way from the median of a label's texts to a blind guess, but not above the lowest FLOOR_SHARE of them."""
    marks = means.where("mean is not null").groupBy("label").agg(F.percentile_approx("mean", [FLOOR_SHARE, 0.5]).alias("q"))
    found = {r["label"]: r["q"] for r in marks.collect()}  # one row per language
    blind = -float(np.log(FEATURES))
    return tuple(min(found[l][0], (found[l][1] + blind) / 2) if l in found else blind for l in languages)


def primary(label: Column) -> Column:
    """First part of a language tag in lower case; null where there is none."""
    part = F.lower(F.regexp_extract(F.coalesce(label.cast("string"), F.lit("")), r"^\s*([^\s_-]+)", 1))
    return F.when(part != "", part)


def train(labelled: DataFrame, text: str = "text", label: str = "lang") -> TextModel:
    """Trigram likelihoods of all labels, from at most about TRAINING_ROWS distinct texts with a label.

    Copies are drawn once.  Rare labels are drawn whole, frequent ones alike; where labels are many, LABEL_ROWS of each are drawn all the same.
    """
    spark = ship(labelled.sparkSession)
    rows = labelled.select(F.col(text).cast("string").alias("text"), primary(F.col(label)).alias("label")).where(
        "label is not null and text is not null"
    ).withColumn("_hash", F.xxhash64("text"))
    distinct = rows.select("label", "_hash").distinct()
    given = {r["label"]: r["n"] for r in distinct.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per label
    languages = sorted(given)
    if not languages:
        return TextModel((), Rows(np.zeros(1, np.int64), np.zeros(0, np.uint16), np.zeros(0, np.float32), 0.0), ())
    each = _each(list(given.values()))
    wanted = spark.createDataFrame([(l, int(min(1.0, each / n) * DRAWS)) for l, n in given.items()], "label string, _limit bigint")
    drawn = materialize(
        rows.join(F.broadcast(wanted), "label")  # one row per label
        .where(F.pmod("_hash", F.lit(DRAWS)) < F.col("_limit"))
        .dropDuplicates(["label", "_hash"])
        .select("text", "label"),
        "language-texts",
    )
    counted = drawn.mapInArrow(_counted(languages), "spot bigint, n bigint").groupBy("spot").agg(F.sum("n").alias("n")).toArrow()
    spots, n = counted["spot"].to_numpy(), counted["n"].to_numpy()  # trigrams that the labels show in the drawn texts
    order = np.argsort(spots)
    spots, n = spots[order], n[order]
    starts = np.searchsorted(spots, np.arange(len(languages) + 1) * FEATURES)
    features = (spots % FEATURES).astype(np.uint16)
    totals = np.add.reduceat(np.append(n, 0), starts[:-1]) * (np.diff(starts) > 0) + 0.5 * FEATURES
    unseen = float(np.log(0.5 / totals.max()))
    values = np.log((n + 0.5) / np.repeat(totals, np.diff(starts))).astype(np.float32)
    counts = spark.sparkContext.broadcast((Rows(starts, features, n, 0), totals, unseen))
    floors = _floors(drawn.mapInArrow(_left_out(languages, counts), "label string, mean double"), languages)
    return TextModel(tuple(languages), Rows(starts, features, values, unseen), floors)


def _each(numbers: list[int]) -> float:
    """Texts to draw of every label that has more, so that TRAINING_ROWS are drawn in all."""
    left, each = TRAINING_ROWS, 0.0
    for i, n in enumerate(sorted(numbers)):
        each = left / (len(numbers) - i)
        if n > each:
            break
        left, each = left - n, float(n)
    return max(each, LABEL_ROWS)


def _scored(model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        likelihood = model.value.likelihood
        most = max(1, SCORES // len(likelihood))
        for chunk in (c.slice(at, most) for c in chunks(batches, limit=CHUNK_BYTES) for at in range(0, c.num_rows, most)):
            found, sizes = trigrams(texts_of(chunk))
            ends = np.cumsum(sizes)
            evidence = np.zeros((len(sizes), len(likelihood)))
            for i in range(len(likelihood)):
                upto = np.concatenate([[0.0], np.cumsum(likelihood[i][found], dtype=np.float64)])
                evidence[:, i] = (upto[ends] - upto[ends - sizes]) / np.maximum(sizes, 1) * np.minimum(sizes, EVIDENCE)
            names = [*chunk.schema.names[:-1], "n_trigrams", "evidence"]
            offsets = pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * evidence.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(evidence.ravel()))
            columns = [chunk.column(i) for i in range(chunk.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes), lists], names=names)

    return score


def _posterior(logs: Column) -> Column:
    """Probabilities from log weights."""
    most = F.array_max(logs)
    weights = F.transform(logs, lambda x: F.exp(x - most))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return F.transform(weights, lambda x: x / total)


def _best(p: Column, languages: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(l) for l in languages]), F.array_position(p, F.array_max(p)).cast("int"))


def _sums(rows: DataFrame, keys: list[str], name: str, languages: tuple[str, ...]) -> DataFrame:
    """Per key the summed text posteriors, as one array; texts without evidence add nothing."""
    own = [F.sum(F.when(F.col("n_trigrams") > 0, F.col("p")[i]).otherwise(0.0)) for i in range(len(languages))]
    return rows.groupBy(*keys).agg(F.array(*own).alias(name))


def identify(
    rows: DataFrame, model: TextModel, key: str, text: str, declared: Column, host: Column
) -> DataFrame:
    """(key, content, lang, confidence, text_lang, declared, host, kept) for every row.

    ``content`` is a hash of the text.  ``declared`` may be a full tag (``en-GB``); its first part counts.
    ``lang`` is the likeliest of the model's languages also where the text fits none of them; ``kept`` is false there.
    A model without languages, as trained where no row declares one, gives null, confidence 0 and keeps nothing.
    """
    spark = ship(rows.sparkSession)
    languages = model.languages
    source = rows.select(
        F.col(key).alias("key"),
        F.xxhash64(F.col(text).cast("string")).alias("content"),
        F.lower(F.regexp_extract(F.coalesce(declared, F.lit("")), r"^\s*([A-Za-z]{2,3})(?![A-Za-z])", 1)).alias("declared"),
        F.lower(F.coalesce(host, F.lit(""))).alias("host"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).select(
        "key",
        "content",
        "declared",
        "host",
        F.regexp_extract("host", r"([^.]+\.[^.]+)$|([^.]*)$", 0).alias("domain"),
        F.regexp_extract("host", r"([^.]*)$", 1).alias("suffix"),
        "text",
    )
    if not languages:
        none = F.lit(None).cast("string")
        return source.select(
            F.col("key").alias(key), "content", none.alias("lang"), F.lit(0.0).alias("confidence"), none.alias("text_lang"),
            "declared", "host", F.lit(False).alias("kept"),
        )
    schema = source.drop("text").withColumns({"n_trigrams": F.lit(0).cast("bigint"), "evidence": F.array(F.lit(0.0))}).schema
    scored = source.mapInArrow(_scored(spark.sparkContext.broadcast(model)), schema)
    scored = materialize(scored.withColumn("p", _posterior(F.col("evidence"))), "language-scores")

    whole = _sums(scored, [], "in_all", languages)
    by_suffix = _sums(scored.where("host <> ''"), ["suffix"], "in_suffix", languages)
    by_domain = _sums(scored.where("host <> ''"), ["domain", "suffix"], "in_domain", languages)
    by_host = _sums(scored.where("host <> ''"), ["host", "domain", "suffix"], "in_host", languages)
    levels = by_host.join(by_domain, ["domain", "suffix"]).join(by_suffix, "suffix").select("host", "in_host", "in_domain", "in_suffix")
    by_declared = _sums(scored.where("declared <> ''"), ["declared"], "in_declared", languages)

    size = len(languages)
    zero = F.array(*[F.lit(0.0)] * size)
    full = (
        scored.crossJoin(F.broadcast(whole))  # one row
        .join(levels, "host", "left")
        .join(by_declared, "declared", "left")
    )
    own = F.when(F.col("n_trigrams") > 0, F.col("p")).otherwise(zero)

    def without_own(counts: str) -> Column:
        return F.zip_with(F.coalesce(counts, zero), own, lambda c, o: F.greatest(c - o, F.lit(0.0)))

    def total(counts: Column) -> Column:
        return F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)

    # widest level first: all rows over a uniform start, then suffix, domain and host over the level before
    full = full.withColumn("_prior", F.transform(without_own("in_all"), lambda c: (c + 1.0) / (total(without_own("in_all")) + size)))
    for level in ("in_suffix", "in_domain", "in_host"):
        full = full.withColumn("_own", without_own(level)).withColumn("_n", total(F.col("_own")))
        full = full.withColumn(
            "_prior", F.zip_with("_own", "_prior", lambda c, wider: (c + LEVEL_WEIGHT * wider) / (F.col("_n") + LEVEL_WEIGHT))
        )
    # P(declared | language): how often texts of the language declare it
    full = full.withColumn(
        "_said",
        F.when(
            F.col("in_declared").isNotNull(),
            F.zip_with(without_own("in_declared"), without_own("in_all"), lambda d, a: (d + DECLARED_WEIGHT / size) / (a + DECLARED_WEIGHT)),
        ).otherwise(F.array(*[F.lit(1.0)] * size)),
    )
    logs = F.zip_with(
        F.zip_with("evidence", "_prior", lambda e, q: e + F.log(q)), F.col("_said"), lambda e, d: e + F.log(d)
    )
    fused = full.withColumn("posterior", _posterior(logs))
    at = F.array_position("posterior", F.array_max("posterior")).cast("int")
    mean = F.element_at("evidence", at) / F.least("n_trigrams", F.lit(EVIDENCE))
    fits = (F.col("n_trigrams") > 0) & (mean >= F.element_at(F.array(*[F.lit(f) for f in model.floors]), at))
    return fused.select(
        F.col("key").alias(key),
        "content",
        _best(F.col("posterior"), languages).alias("lang"),
        F.array_max("posterior").alias("confidence"),
        F.when(F.col("n_trigrams") > 0, _best(F.col("p"), languages)).alias("text_lang"),
        "declared",
        "host",
        (fits & (F.array_max("posterior") >= MIN_CONFIDENCE)).alias("kept"),
    )


def keep_identified(docs: DataFrame, declared: str = "lang", host: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is known with confidence; the model is trained on the declared languages.

    Where no row declares a language, nothing can be learned and no row stays.  Other columns may have any names.
    """
    model = train(docs, text, declared)
    if not model.languages:
        return docs.where(F.lit(False))
    judged = identify(docs, model, key, text, F.col(declared), F.col(host))
    rejected = judged.where("not kept").select(F.col(key).alias("_drop_id"), F.col("content").alias("_drop_content")).distinct()
    return without_rows(docs, materialize(rejected, "language-rejected"), key, text)


def page_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags become spaces."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&[A-Za-z#0-9]+;", " ")


def declared_language(html: Column) -> Column:
    """Value of the ``lang`` attribute of the page's root element."""
    return F.regexp_extract(F.coalesce(html, F.lit("")), r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z-]+)""", 1)
