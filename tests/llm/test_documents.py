"""Sharding, exact dedup, repetition rules, the n-gram join and the pipeline against brute force."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import SCHEMA, edge_rows, prose
from weftline.llm import exactdedup, langid, ngramjoin, quality, sharding
from weftline.llm.queries import QUERIES

WORD = re.compile("[^\x20\x09-\x0d]+")


# ---- sharding


@pytest.mark.parametrize("shards,bucket_bytes", [(40, 48 << 20), (7, 20_000)])
def test_shards_hold_every_row_once(edge, shards, bucket_bytes):
    got = sharding.shard_rows(edge, shards, bucket_bytes=bucket_bytes)
    assert got.columns[: len(edge.columns)] == edge.columns
    rows = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r[0], r[1]) for r in edge_rows())
    assert all(r["_size"] == len((r["text"] or "").encode()) + 16 for r in rows)
    counts = Counter(r["_shard"] for r in rows)
    sizes = [counts.get(s, 0) for s in range(shards)]
    assert sum(sizes) == len(rows) and max(sizes) - min(sizes) <= 1
    for s in counts:
        assert sorted(r["_slot"] for r in rows if r["_shard"] == s) == list(range(counts[s]))
    again = sharding.shard_rows(edge.repartition(5), shards, bucket_bytes=bucket_bytes)
    key = lambda r: (r["doc_id"] or -1, r["text"] or "", r["_shard"], r["_slot"])
    assert sorted(map(key, again.collect())) == sorted(map(key, rows))


def test_fisher_yates_is_a_uniform_permutation():
    assert sorted(sharding.fisher_yates(1000, [1]).tolist()) == list(range(1000))
    seen = Counter(tuple(sharding.fisher_yates(3, [s]).tolist()) for s in range(3000))
    assert len(seen) == 6 and min(seen.values()) > 400


# ---- exact dedup


def brute_copies(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1] or "", []).append(r[0] if r[0] is not None else -1)
    return sorted((i, max(ids), len(ids)) for ids in by.values() for i in ids)


@pytest.mark.parametrize("digest", [exactdedup.sha256, lambda c: F.lit("same")])
@pytest.mark.parametrize("batch_bytes", [1, exactdedup.BATCH_BYTES])
def test_copies(edge, digest, batch_bytes):
    got = exactdedup.deduplicate(edge, digest=digest, batch_bytes=batch_bytes).collect()
    none = lambda v: -1 if v is None else v
    assert sorted((none(r["_id"]), none(r["keep"]["_id"]), r["n"]) for r in got) == brute_copies(edge_rows())
    texts = len({r[1] or "" for r in edge_rows()})
    assert sum(r["kept"] for r in got) == texts


def test_state_spans_micro_batches(spark):
    rows = spark.createDataFrame([(i, f"text {i % 5}") for i in range(40)], "doc_id bigint, text string").repartition(8)
    got = exactdedup.deduplicate(rows, batch_bytes=1).where("kept").collect()
    assert sorted((r["_id"], r["n"]) for r in got) == [(i, 8) for i in range(35, 40)]


def test_drop_copies_keeps_columns(edge):
    left = exactdedup.drop_copies(edge)
    assert left.columns == edge.columns
    rows = left.collect()
    assert Counter(r["text"] or "" for r in rows) == Counter({r[1] or "" for r in edge_rows()})
    assert not any(r["doc_id"] in (1, 4) for r in rows)


# ---- repetition


def brute_base(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n


def brute_coverage(text, n):
    words = WORD.findall(text)
    seen, inside = set(), set()
    for i in range(len(words) - n + 1):
        window = tuple(words[i : i + n])
        if window in seen:
            inside |= set(range(i, i + n))
        seen.add(window)
    return sum(len(words[i]) for i in inside) / max(1, sum(map(len, words)))


def test_repetition_measures(edge):
    got = sorted(quality.repetition_measures(edge).collect(), key=lambda r: (r["doc_id"] or -1, r["n_words"]))
    rows = sorted(edge_rows(), key=lambda r: (r[0] or -1, len(WORD.findall(r[1] or ""))))
    rules = quality.Rules()
    for r, row in zip(got, rows, strict=True):
        base = brute_base(row[1])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base
        coverage = {n: brute_coverage(row[1] or "", n) for n, _ in rules.ngram_coverage}
        assert r["max_ngram_coverage"] == pytest.approx(max(coverage.values()))
        failed = any(coverage[n] > limit for n, limit in rules.ngram_coverage) or (
            r["dup_line_chars"] > rules.line_coverage * base[1] or base[2] > rules.symbol_share * base[1]
        )
        assert r["kept"] == (not base[5] and not failed)


def test_repeat_words_with_many_different_words():
    numbers = np.concatenate([np.arange(2_500_000), [7, 8, 9]])
    assert quality.repeat_words(numbers) == 6


def test_keep_clean_keeps_columns(edge):
    left = quality.keep_clean(edge)
    assert left.schema == edge.schema
    kept = {r["doc_id"] for r in quality.repetition_measures(edge).where("kept").collect()}
    assert {r["doc_id"] for r in left.collect()} == kept


# ---- n-gram join


def shingles(text):
    words = [w.translate(LOWER) for w in WORD.findall(text or "")]
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_components(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if x and 100 * both >= 80 * (len(x) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted((r[0] or -1, len(sets[i]), least.get(find(i), -1)) for i, r in enumerate(rows))


def joined(docs):
    return sorted((r["doc_id"] or -1, r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in ngramjoin.linked_components(docs).collect())


def test_components_on_edge_cases(edge):
    assert joined(edge) == brute_components(edge_rows())


def chain_rows():
    """Near copies along chains, a passage in every text, and texts made of shared passages only."""
    rows, passage = [], prose(99, 46)
    for c in range(12):
        words = prose(100 + c, 60).split()
        for step in range(14):
            words[(step * 11 + c) % len(words)] = f"w{c}x{step}"
            rows.append((len(rows), f"{passage} {' '.join(words)}"))
    parts = [prose(500 + i, 12) for i in range(8)]
    for i in range(60):
        rows.append((len(rows), " ".join(parts[(i * k) % 8] for k in (1, 3, 5, 7)[: 2 + i % 3])))
    for i in range(40):
        rows.append((len(rows), " ".join(f"s{(i + k) % 13}" for k in range(3 + i % 6))))
    return rows


@pytest.mark.parametrize("hot", [2, 64])
def test_components_lose_no_link(spark, monkeypatch, hot):
    monkeypatch.setattr(ngramjoin, "HOT_GROUPS", hot)
    rows = chain_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    want = brute_components(rows)
    assert len({w[2] for w in want}) < len(rows) - 60
    assert joined(docs) == want


def test_groups_are_opened_in_parts(spark, monkeypatch):
    """Without leaders every class is alone, so the matrix has to find all links; small parts cut groups and queries."""
    rows = chain_rows()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    monkeypatch.setattr(ngramjoin, "GROUP_SETS", 3)
    monkeypatch.setattr(ngramjoin, "QUERY_SETS", 2)
    assert joined(docs) == brute_components(rows)
    monkeypatch.setattr(ngramjoin, "_leaders", lambda c: c.selectExpr("row as a", "row as b").limit(0))
    assert joined(docs) == brute_components(rows)


def test_giant_tokens_stay_out_of_the_buckets(spark, monkeypatch):
    rows = chain_rows()
    monkeypatch.setattr(ngramjoin, "_giants", lambda sets, total: np.unique(np.concatenate([r["low"] for r in sets.limit(3).collect()])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    assert joined(docs) == brute_components(rows)


def test_one_per_component(edge):
    left = ngramjoin.one_per_component(edge)
    assert left.columns == edge.columns
    rows = left.collect()
    want = brute_components(edge_rows())
    assert sorted(r["doc_id"] or -1 for r in rows) == sorted(w[2] if w[1] else w[0] for w in {(w[2], w[1] and 1, w[0] if not w[1] else w[2]): w for w in want}.values())


def test_empty_tables(nothing):
    assert sharding.shard_rows(nothing, 5).count() == 0
    assert exactdedup.deduplicate(nothing).count() == 0
    assert quality.repetition_measures(nothing).count() == 0
    assert ngramjoin.linked_components(nothing).count() == 0


# ---- pipeline


def test_pipeline_stages(edge, small_dir):
    spark, docs = edge.sparkSession, edge
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, small_dir)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
            assert docs.count() < before.count() or name == "exact_dedup"
    assert docs.where("length > 4096").isEmpty() and not docs.isEmpty()


def test_pipeline_on_an_empty_table(nothing, small_dir):
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(nothing.sparkSession, docs, small_dir)
        assert docs.count() == 0


def test_pipeline_run_equals_brute_force(spark, small_dir):
    """Of the texts that pass language and rules, the largest id of equal ones, then the smallest of each component."""
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, small_dir).select("doc_id").distinct().collect()}
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    passed = {r["doc_id"] for r in QUERIES["op6_quality_rules"](spark, small_dir).where("kept").collect()}
    rows = [r for r in rows if r[0] in passed and re.search("[^\\W\\d_]{2}", r[1])]
    last = {}
    for i, t in rows:
        last[t] = max(i, last.get(t, i))
    rows = [(i, t) for i, t in rows if last[t] == i]
    want = {w[2] for w in brute_components(rows)}
    assert got == want


def test_schema_of_fixture(edge):
    assert edge.columns == [c.split()[0] for c in SCHEMA.split(", ")]


# ---- columns with the names that are used inside, and tables without labels


INSIDE = (
    "row content key label n w g digest bands low often class copies root hash doc bucket first pos sum n_trigrams evidence p declared host domain suffix "
    "_doc _id _same _drop_id _drop_content _stays _equal _row _digest _key _k _n _hash _bucket _first _pos _sum _text _content _locator keep kept batch"
).split()


@pytest.fixture(scope="module")
def crowded(edge):
    return edge.withColumns({name: F.lit(f"own {name}") for name in INSIDE})


def as_rows(df, names):
    return Counter(tuple(r[n] for n in names) for r in df.collect())


@pytest.mark.parametrize("stage", ["language_id", "quality_rules", "exact_dedup", "ngram_join"])
def test_stages_take_columns_of_any_name(spark, edge, crowded, stage):
    function = dict(corpus_pipeline.STAGES)[stage]
    got = function(spark, crowded, "")
    assert got.columns == crowded.columns
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert as_rows(got, names) == as_rows(function(spark, edge, ""), names)
    assert all(r[name] == f"own {name}" for r in got.collect() for name in INSIDE)


def test_packing_takes_columns_of_any_name(spark, edge, crowded):
    function = dict(corpus_pipeline.STAGES)["best_fit_packing"]
    assert function(spark, crowded, "").count() == function(spark, edge, "").count()


def test_shards_take_columns_of_any_name(crowded):
    given = crowded.withColumns({"_size": F.lit("a"), "_shard": F.lit("b"), "_slot": F.lit("c")})
    got = sharding.shard_rows(given, 7, bucket_bytes=20_000)
    assert sorted(got.columns) == sorted([*crowded.columns, "_size_given", "_shard_given", "_slot_given", "_size", "_shard", "_slot"])
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == Counter((r[0], r[1]) for r in edge_rows())


def test_repeated_rows_are_spread_over_buckets(spark):
    rows = spark.createDataFrame([(1, "the same text")] * 3000 + [(i, f"text {i}") for i in range(2, 1500)], "doc_id bigint, text string")
    numbered = sharding._numbered(rows.repartition(4), F.xxhash64(F.lit(0), "doc_id", "text"))
    counts = [r["count"] for r in numbered.groupBy(F.pmod("hash", F.lit(16)).alias("b")).count().collect()]
    assert sum(counts) == 4499 and max(counts) < 2 * min(counts)
    got = sharding.shard_rows(rows, 10, bucket_bytes=8_000).groupBy("_shard").count().collect()
    assert sorted(r["count"] for r in got) == [449] + [450] * 9


def test_tables_without_labels(spark, edge, nothing):
    unlabelled = edge.withColumn("lang", F.lit(None).cast("string"))
    for docs in (unlabelled, nothing):
        assert corpus_pipeline.language_id(spark, docs, "").collect() == []
    model = langid.train(unlabelled)
    judged = langid.identify(edge, model, "doc_id", "text", F.col("lang"), F.col("source")).collect()
    assert len(judged) == len(edge_rows())
    assert all((r["lang"], r["confidence"], r["text_lang"], r["kept"]) == (None, 0.0, None, False) for r in judged)


# ---- near copies of one text


def near_copies(spark, members):
    base = prose(77, 150).split()
    rows = []
    for i in range(members):
        words = list(base)
        words[7 + i % 100] = f"changed{i}"
        rows.append((i, " ".join(words)))
    rows += [(10_000 + i, prose(1000 + i, 60)) for i in range(200)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)


def token_rows(spark, members, monkeypatch):
    """Rows of the chunks' distinct tokens, which is what the join with their counts takes in."""
    kept = []
    original = ngramjoin.materialize

    def watched(df, label="step"):
        out = original(df, label)
        if label == "join-short":
            kept.append(out.select(F.explode("seen")).count())
        return out

    monkeypatch.setattr(ngramjoin, "materialize", watched)
    found = ngramjoin.linked_components(near_copies(spark, members)).collect()
    assert {r["component_id"] for r in found if r["doc_id"] < 10_000} == {0}
    return kept[0]


def test_tokens_of_near_copies_are_counted_once_per_chunk(spark, monkeypatch):
    few, many = token_rows(spark, 60, monkeypatch), token_rows(spark, 600, monkeypatch)
    assert many < few + 600 * 8 + 4 * 160  # five new shingles a copy, and the common ones once per chunk


def test_links_without_leaders(spark, edge, monkeypatch):
    want = sorted((r["row"], r["component_id"] or -1) for r in ngramjoin.linked_components(edge).select("row", "component_id").collect())
    original = ngramjoin._leaders
    monkeypatch.setattr(ngramjoin, "_leaders", lambda classes: original(classes).where("false"))
    monkeypatch.setattr(ngramjoin, "CHUNK_TOKENS", 300)
    monkeypatch.setattr(ngramjoin, "SIDE_TOKENS", 500)
    got = sorted((r["row"], r["component_id"] or -1) for r in ngramjoin.linked_components(edge).select("row", "component_id").collect())
    assert [c for _, c in got] == [c for _, c in want]


def generated(df):
    """Rows that each Generate of the plan makes when it runs."""
    df.collect()
    todo, found = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        elif node.nodeName() == "Generate":
            found.append(node.metrics().apply("numOutputRows").value())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def passage_rows():
    """Texts of two shared passages and a few own words: every passage is in more groups than the matrix counts pairs for."""
    passages = [prose(300 + i, 40) for i in range(5)]
    pairs = [(a, b) for a in passages for b in passages if a != b]
    return [(i, f"{pairs[i % 20][0]} {pairs[i % 20][1]} {prose(5000 + i, 3)}") for i in range(280)]


@pytest.mark.parametrize("parts", [False, True])
def test_a_query_and_a_family_make_one_row(spark, monkeypatch, parts):
    """Sets that share many tokens with several families: no step makes a row per set, token and family."""
    made, entries = [], []
    original = ngramjoin.materialize

    def watched(df, label="step"):
        if entries and not parts:
            made.extend(generated(df))
        out = original(df, label)
        if label == "join-entries":
            entries.append(out.count())
        return out

    monkeypatch.setattr(ngramjoin, "_leaders", lambda c: c.selectExpr("row as a", "row as b").limit(0))
    monkeypatch.setattr(ngramjoin, "materialize", watched)
    if parts:  # of the families that a chunk meets, and of groups and queries
        monkeypatch.setattr(ngramjoin, "QUERY_SETS", 2)
        monkeypatch.setattr(ngramjoin, "SIDE_TOKENS", 2_000)
    rows = passage_rows()
    assert joined(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)) == brute_components(rows)
    assert entries[0] > len(rows) and max(made, default=0) <= entries[0]
