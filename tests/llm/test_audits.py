"""Filter interaction audit, near-duplicate vectors and source divergence against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, edge_rows, prose
from weftline.llm import capfilters, divergence, filteraudit

WORD = re.compile("[^\x20\x09-\x0d]+")


# ---- filter interaction audit


def brute_audit(rows, good, toxic):
    texts = defaultdict(list)
    for i, text, _ in rows:
        if i is not None:
            texts[text or ""].append(i)
    facts = []
    for i, text, part in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": i is not None and any(j < i for j in texts[text]),
        }
        facts.append((part or "", {f for f, bad in fails.items() if bad}, i in good, i in toxic))
    out = {}
    for part in {f[0] for f in facts}:
        own = [f for f in facts if f[0] == part]
        orders = list(permutations("ABCDE"))
        removed = {}
        for o in orders:
            for s, f in enumerate(o):
                before = set(o[:s])
                gone = [x for x in own if f in x[1] and not x[1] & before]
                removed[o, f] = len(gone)
                out[part, "".join(o), s + 1] = [
                    sum(not x[1] & (before | {f}) for x in own), len(gone), sum(f in x[1] and bool(x[1] & before) for x in own),
                    sum(x[1] == {f} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone),
                ]
        for part_, o, s in list(out):
            if part_ == part:
                out[part_, o, s].append(sum(removed[p, o[s - 1]] for p in orders))
    return out


def audited(frame):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in frame.collect()}


def test_audit(spark, edge):
    labels = spark.createDataFrame(
        [(1, 1, 0, "x"), (1, 1, 0, "x"), (4, 0, 1, "x"), (7, 1, 1, None), (10, None, None, None), (None, 1, 1, "x"), (40, 1, 0, "x")],
        "doc_id bigint, quality int, toxic int, row string",
    )
    docs = edge.withColumns({"run": F.lit("a"), "bit": F.lit("b"), "id": F.lit(None).cast("string"), "words": F.lit(1), "filter": F.lit(2)})
    got = audited(filteraudit.audit_documents(docs, labels))
    rows = [(r[0], r[1], r[3]) for r in edge_rows()]
    assert got == brute_audit(rows, {1, 7, 40}, {4, 7})


def test_audit_of_nothing(spark, nothing):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filteraudit.audit_documents(nothing, labels).collect() == []
    clean = " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(80))
    one = spark.createDataFrame([(5, clean, None)], "doc_id bigint, text string, source string")
    got = audited(filteraudit.audit_documents(one, labels))
    assert len(got) == 600 and set(map(tuple, got.values())) == {(1, 0, 0, 0, 0, 0, 0)}


def test_audit_of_own_filters(spark):
    rows = spark.createDataFrame([(1, "a b", "s"), (2, "a", "s"), (3, "", "t")], "doc_id bigint, text string, source string")
    facts = filteraudit.text_facts(rows)
    conditions = {"S": F.col("words") < 2, "N": F.col("chars") == 0}
    got = filteraudit.audit(facts, filteraudit.failing_tables(facts, conditions), ["S", "N"], {}).collect()
    seen = {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["shapley"]) for r in got}
    assert seen["t", "SN", 1] == (0, 1, 0, 1) and seen["t", "SN", 2] == (0, 0, 1, 1) and seen["s", "NS", 2] == (1, 1, 0, 2)


# ---- near-duplicate vectors


def brute_vectors(rows, least=0.9):
    units = []
    for _, v in rows:
        x = None if v is None or not v or any(c is None for c in v) else np.array(v, float)
        units.append(None if x is None or not np.isfinite(x).all() or not x.any() else x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()))
    n, links = len(rows), [0] * len(rows)
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(n):
        for j in range(i + 1, n):
            x, y = units[i], units[j]
            if x is not None and y is not None and len(x) == len(y) and x @ y >= least:
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(n):
        groups[find(i)].append(i)
    out = []
    for i, (name, _) in enumerate(rows):
        least_id = min((rows[k][0] for k in groups[find(i)] if rows[k][0] is not None), default=None)
        out.append((name, links[i], least_id, name == least_id))
    return sorted(out, key=repr)


def around(rng, centre, cosine):
    z = rng.standard_normal(len(centre))
    z -= (z @ centre) * centre
    return cosine * centre + math.sqrt(1 - cosine * cosine) * z / np.linalg.norm(z)


def vector_rows(dim=24):
    rng = np.random.default_rng(3)
    unit = lambda: (lambda x: x / np.linalg.norm(x))(rng.standard_normal(dim))
    vectors = [unit() for _ in range(150)]
    tight, loose, wide = unit(), unit(), unit()
    vectors += [around(rng, tight, rng.uniform(0.98, 0.999)) for _ in range(120)]
    vectors += [around(rng, loose, rng.uniform(0.93, 0.97)) for _ in range(90)]   # links that no ball settles
    vectors += [around(rng, wide, 0.9 + 0.08 * (i % 2)) for i in range(40)]
    chain = [unit()]
    for _ in range(12):
        chain.append(around(rng, chain[-1], 0.93))
    rows = [(1000 - i, [float(c) for c in v]) for i, v in enumerate([*vectors, *chain])]
    rows += [(2000 + i, rows[5][1]) for i in range(30)] + [(3000, [2.5 * c for c in rows[5][1]])]
    rows += [rows[200], rows[200]]                                          # repeated rows
    rows += [(None, rows[160][1]), (None, [0.5] * 7), (4000, None), (4001, []), (4002, [0.0] * dim), (4003, [math.nan] + [1.0] * (dim - 1))]
    rows += [(4004, [math.inf] + [1.0] * (dim - 1)), (4005, [None] + [1.0] * (dim - 1)), (4006, [1e200, 1e200]), (4007, [1e-200, 1.1e-200])]
    rows += [(4008, [3.0]), (4009, [4.0]), (4010, [-4.0]), (4011, rows[0][1][:-1])]
    return rows


@pytest.mark.parametrize("block", [17, 1024])
def test_near_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(capfilters, "BLOCK", block)
    rows = vector_rows()
    names = {"row": "x", "unit": "y", "class": "z", "g": "u", "id": "v"}
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumns({k: F.lit(v) for k, v in names.items()})
    got = [(r["id"], r["n_links"], r["component_id"], r["kept"]) for r in capfilters.near_duplicates(frame.repartition(3)).collect()]
    assert sorted(got, key=repr) == brute_vectors(rows)


def test_near_vectors_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert capfilters.near_duplicates(empty).collect() == []
    one = spark.createDataFrame([(3, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    assert [(r["id"], r["n_links"], r["component_id"], r["kept"]) for r in capfilters.near_duplicates(one).collect()] == [(3, 0, 3, True)]


@pytest.mark.parametrize("vectors,dim,lost", [(500, 64, 0), (1_000_000, 64, 0.01), (50_000, 16, 0.01), (20_000, 300, 0.01), (1_000, 3, 0.01)])
def test_pairs_at_the_least_cosine_share_filters(vectors, dim, lost):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.array([around(rng, v, 0.9) for v in x])
    one, two = (set(zip(*[c.tolist() for c in capfilters.decoded(u, vectors)], strict=True)) for u in (x, y))
    met = len({v for v, _ in one & two})
    assert met >= 600 * (1 - lost) - 1
    # the decoder finds exactly the directions above the cap
    cap, blocks, words = capfilters.plan(vectors, dim, 0.9)
    if words**blocks <= 2_000:
        rotation, parts = capfilters.codes(dim, blocks, words)[0]
        grid = np.stack(np.meshgrid(*[np.arange(words)] * blocks, indexing="ij"), -1).reshape(-1, blocks)
        direction = np.concatenate([p[grid[:, k]] for k, p in enumerate(parts)], axis=1) / math.sqrt(blocks)
        want = int(((x @ rotation) @ direction.T >= cap).sum())
        first = dim * capfilters.CODES << 40
        assert sum(first <= f < first + words**blocks for _, f in one) == want


def test_caps_follow_the_number_of_vectors():
    caps = [capfilters.plan(n, 64, 0.9)[0] for n in (100, 10_000, 1_000_000, 10_000_000)]
    assert caps == sorted(caps)
    samples = np.random.default_rng(1).standard_normal((200_000, 16))
    share = (samples[:, 0] / np.linalg.norm(samples, axis=1) >= 0.4).mean()
    assert capfilters.passing(0.4, 16) == pytest.approx(share, rel=0.05)


# ---- source divergence


TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_divergence(rows, least, top):
    held, counts, groups = defaultdict(set), defaultdict(Counter), defaultdict(set)
    for i, (text, lang, source) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for t in TERM.findall((text or "").translate(LOWER)):
            held[lang, t].add(i)
            counts[lang, source][t] += 1
    out = []
    for lang, sources in groups.items():
        kept = [t for (g, t), d in held.items() if g == lang and len(d) >= least]

        def share(count, kept=kept):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // total for t in kept}

        whole = Counter()
        for s in sources:
            whole.update(counts[lang, s])
        q = share(whole)
        shares = {s: share(counts[lang, s]) for s in sources}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, p in shares.items():
            found = {
                "pair": [(o, sum(f(p[t], r[t]) for t in kept)) for o, r in shares.items() if o != s],
                "term": [(t, f(p[t], q[t])) for t in kept if counts[lang, s][t] and p[t] > q[t]],
            }
            for part, items in found.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                limit = top if part == "term" else len(items)
                out += [(lang, s, part, item, value, n + 1) for n, (item, value) in enumerate(items[:limit])]
    return sorted(out)


def divergence_rows():
    rng = random.Random(9)
    words = ["the", "The", "thé", "thesis", "a", "ab", "abc", "éa", "日本語", "日本", "x" * 300, "x" * 299 + "y", "foo-bar", "naïve", "😀z"]
    rows = []
    for i in range(90):
        text = " ".join(rng.choices(words, k=rng.randint(1, 12))) + rng.choice(["", " 12 rare%d" % i, " tail"])
        rows.append((text, rng.choice(["en", "fr"]), rng.choice(["s1", "s2", "é3", None])))
    rows += [rows[0]] * 12 + [(None, "en", "s1"), ("", None, None), ("only once", "de", "s1"), (None, "de", "s2"), ("... 123", "de", "s3")]
    rows.append((" ".join(rng.choices(words, k=20_000)), "en", "s2"))
    return rows


@pytest.mark.parametrize("least,chunk", [(10, 4 << 20), (3, 60), (1, 2_000)])
def test_divergence(spark, least, chunk, monkeypatch):
    rows = divergence_rows()
    frame = spark.createDataFrame([(*r, i, "clash") for i, r in enumerate(rows)], "text string, lang string, source string, p bigint, term string")
    whole = frame.repartition(3)
    monkeypatch.setattr(divergence, "CHUNK_BYTES", chunk)
    names = ("lang", "source", "part", "item", "value", "rank")
    got = sorted(tuple(r[n] for n in names) for r in divergence.source_divergence(whole, least).collect())
    assert got == brute_divergence(rows, least, 10)


def test_kept_terms_carry_their_documents(spark):
    rows = [(prose(i % 7, 40), "en", f"s{i % 3}") for i in range(60)]
    terms, _ = divergence.kept_terms(spark.createDataFrame(rows, "text string, lang string, source string").repartition(4), 15)
    held = Counter(t for text, _, _ in rows for t in set(TERM.findall(text.translate(LOWER))))
    assert {(r["term"].decode(), r["docs"]) for r in terms.collect()} == {(t, n) for t, n in held.items() if n >= 15}


def test_divergence_of_nothing(spark, nothing):
    assert divergence.source_divergence(nothing).collect() == []
    assert len(SCHEMA) > 0
    bare = spark.createDataFrame([("1 2", "en", "a"), (None, "en", "b")], "text string, lang string, source string")
    got = sorted((r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in divergence.source_divergence(bare).collect())
    assert got == [("a", "pair", "b", 0, 1), ("b", "pair", "a", 0, 1)]


def test_shares_pass_64_bits(spark):
    row = spark.createDataFrame([(9_000_000_000_000, 27_000_000_000_007)], "n bigint, total bigint")
    got = row.select(divergence._share(F.col("n"), F.col("total"))).first()[0]
    assert got == 1 + 10**9 * (9_000_000_000_000 + 2) // 27_000_000_000_007
