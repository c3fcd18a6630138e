"""Language identification, quotation linking and URL filter."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import langid, quotes, urlfilter
from weftline.llm.queries import QUERIES, URL_RULES, quoting_view

# ---- language identification


@pytest.fixture(scope="module")
def model(spark, small_dir):
    return langid.train(spark.read.parquet(f"{small_dir}/documents.parquet"))


def test_held_out_accuracy(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    part = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(3))  # equal texts fall on one side
    learned = langid.train(docs.where(part > 0))
    held = docs.where(part == 0)
    judged = langid.identify(held, learned, "doc_id", "text", F.lit(None).cast("string"), F.lit(None).cast("string"))
    right = judged.join(held.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    total, good = right.count(), right.where("lang = truth").count()
    assert total > 40 and good >= 0.97 * total


def test_likelihoods_equal_brute_force(spark):
    rows = [(1, "Aba aba", "x"), (2, "öb Aba", "y"), (3, None, "x"), (4, "zz", None)]
    learned = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert learned.languages == ("x", "y")
    for i, text in enumerate(["Aba aba", "öb Aba"]):
        found, _ = langid.trigrams([text])
        for feature in set(found.tolist()):
            want = math.log((found.tolist().count(feature) + 0.5) / (len(found) + 0.5 * langid.FEATURES))
            assert learned.likelihood[i][feature] == pytest.approx(want, rel=1e-5)


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "id bigint, text string, said string, host string, content string")


def judge(df, model):
    got = langid.identify(df, model, "id", "text", F.col("said"), F.col("host")).collect()
    return {r["id"]: r for r in got}


def test_prior_and_declaration_equal_brute_force(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()
    hosts = ["a.one.example", "b.one.example", "c.two.test", None]
    rows = [(r["doc_id"], r["text"][:80], r["lang"] if i % 3 else None, hosts[i % 4], "c") for i, r in enumerate(docs)]
    rows += [(9001, None, "fr-CA", hosts[0], None), (9002, "!!!", "zz", None, None)]
    got = judge(pages_of(spark, rows), model)
    assert len(got) == len(rows)
    size, texts = len(model.languages), [r[1] or "" for r in rows]
    evidence, posterior, counted = [], [], []
    for t in texts:
        found, n = langid.trigrams([t])
        e = [float(sum(model.likelihood[i][found])) / max(1, n[0]) * min(n[0], langid.EVIDENCE) for i in range(size)]
        w = [math.exp(x - max(e)) for x in e]
        evidence.append(e)
        posterior.append([x / sum(w) for x in w])
        counted.append(n[0] > 0)

    def sums(i, same):
        return [sum(posterior[j][l] for j in range(len(rows)) if j != i and counted[j] and same(j)) for l in range(size)]

    said = lambda j: (rows[j][2] or "").split("-")[0]
    for i, row in enumerate(rows):
        whole = sums(i, lambda j: True)
        prior = [(c + 1) / (sum(whole) + size) for c in whole]
        host = row[3] or ""
        if host:
            labels = host.split(".")
            for cut in (1, 2, len(labels)):
                tail = ".".join(labels[-cut:])
                own = sums(i, lambda j, c=cut, t=tail: rows[j][3] and ".".join(rows[j][3].split(".")[-c:]) == t)
                prior = [(c + langid.LEVEL_WEIGHT * q) / (sum(own) + langid.LEVEL_WEIGHT) for c, q in zip(own, prior, strict=True)]
        likely = [1.0] * size
        if said(i):
            told = sums(i, lambda j: said(j) == said(i))
            likely = [(d + langid.DECLARED_WEIGHT / size) / (a + langid.DECLARED_WEIGHT) for d, a in zip(told, whole, strict=True)]
        logs = [e + math.log(q) + math.log(d) for e, q, d in zip(evidence[i], prior, likely, strict=True)]
        weights = [math.exp(x - max(logs)) for x in logs]
        r = got[row[0]]
        assert r["confidence"] == pytest.approx(max(weights) / sum(weights), rel=1e-4)
        assert r["lang"] == model.languages[weights.index(max(weights))]
        assert r["kept"] == (counted[i] and r["confidence"] >= langid.MIN_CONFIDENCE)


def test_context_decides_where_the_text_does_not(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'fr'").limit(20).collect()
    rows = [(i, r["text"], "fr", "le.exemple", None) for i, r in enumerate(docs)]
    got = judge(pages_of(spark, [*rows, (900, None, "fr", "le.exemple", None), (901, "12 34", None, None, None)]), model)
    assert got[900]["lang"] == "fr" and not got[900]["kept"] and got[900]["text_lang"] is None
    assert not got[901]["kept"]


def test_language_query_and_page_text(spark, small_dir):
    got = QUERIES["op4_language_id"](spark, small_dir)
    assert got.count() == 50
    html = "<html class=x lang='de-AT'><script>a<b</script><!-- no --><p>Hallo&nbsp;<b>du</b></p></html>"
    row = spark.createDataFrame([(html,), (None,)], "h string").select(langid.page_text(F.col("h")), langid.declared_language(F.col("h"))).collect()
    assert row[0][0].split() == ["Hallo", "du"] and row[0][1] == "de-AT"
    assert row[1][0] == "" and row[1][1] == ""


FINNISH = (
    "Tämä on suomenkielinen teksti, jossa kerrotaan säästä ja ihmisistä, jotka asuvat maalla. Aamulla satoi vettä, mutta "
    "iltapäivällä aurinko paistoi ja lapset leikkivät pihalla. Myöhemmin perhe söi keittoa ja luki kirjoja takan ääressä."
)


def test_texts_of_no_label_are_not_kept(spark, model, small_dir):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    texts = [FINNISH, "Это обычный русский текст о погоде и людях, которые живут в деревне.", "这是一个中文文本，讲述天气和人们的生活。"]
    texts += [" ".join(word() for _ in range(40)) for _ in range(30)]
    got = judge(pages_of(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), model)
    assert not [i for i, r in got.items() if r["kept"]]
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    named = langid.train(docs.where("lang <> 'es'"))
    judged = langid.identify(docs, named, "doc_id", "text", F.lit(None).cast("string"), F.lit(None).cast("string")).join(docs, "doc_id")
    share = {r[0]: r[1] for r in judged.groupBy(docs["lang"]).agg(F.avg(F.col("kept").cast("int"))).collect()}
    assert share["es"] < 0.05 and min(share[l] for l in named.languages) > 0.9


def test_unseen_trigrams_favour_no_label(spark):
    rows = [(i, "one two three four five six", "en") for i in range(50)] + [(99, "uno dos tres", "es")]
    learned = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    found, _ = langid.trigrams(["qzx"])
    assert learned.likelihood[0][found].tolist() == learned.likelihood[1][found].tolist()


def test_every_label_becomes_a_language(spark):
    rng = random.Random(6)
    names, rows = [a + b for a in "abcdefghij" for b in "klmnopq"], []
    for name in names:
        own = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(12)]
        n = 3 if name == names[-1] else 6
        rows += [(len(rows) + k, " ".join(rng.choices(own, k=30)), name + ["", "-GB", "_us"][k % 3]) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = langid.train(docs)
    assert learned.languages == tuple(sorted(names))
    judged = langid.identify(docs, learned, "doc_id", "text", F.lit(None).cast("string"), F.lit(None).cast("string"))
    assert {r["doc_id"]: r["lang"] for r in judged.collect()} == {r[0]: r[2][:2] for r in rows}


def test_copies_are_drawn_once(spark, monkeypatch):
    rows = [(i, f"word{chr(97 + i % 26)} text{chr(97 + i // 26)} ending", "en") for i in range(60)]
    copies = [(100 + i, "copied text", "en") for i in range(400)]
    learn = lambda r: langid.train(spark.createDataFrame(r, "doc_id bigint, text string, lang string"))
    once, often = learn([*rows, copies[0]]), learn([*rows, *copies])
    assert once.likelihood[0].tolist() == often.likelihood[0].tolist()
    monkeypatch.setattr(urlfilter, "TRAINING_ROWS", 100)
    urls = [(f"http://x.com/{i}", 1.0) for i in range(400)] + [(f"http://copy.com/{k}", 0.0) for k in range(20) for _ in range(50)]
    left = urlfilter.drawn(spark.createDataFrame(urls, "url string, label double"))
    assert 60 < left.count() < 150 and left.distinct().count() == left.count()


def test_keep_identified_keeps_columns(edge):
    left = langid.keep_identified(edge)
    assert left.columns == edge.columns
    texts = {r["text"] for r in left.collect()}
    assert not texts & {None, "", "   \n\t "} and len(texts) > 5


# ---- quotation linking


def messages_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, _m string")


def test_nested_quotes(spark):
    rows = [
        (1, 0, "user", "First   question\nover two lines\n\nSecond part", "x"),
        (1, 1, "assistant", "Anna wrote:\n> first question\n> over two lines\nAn answer", "x"),
        (1, 2, "user", "New topic", "x"),
        (1, 3, "user", ">> First question over two lines\n> an answer\nThanks", "x"),
        (1, 4, "user", "> never said\n> Second part\nok", "x"),
        (1, 5, "user", "> Second  PART\nagain", "x"),
        (1, 6, "user", "> Thanks\n\n> new topic\nboth", "x"),
        (2, 0, "user", "> Second part\nother conversation", "x"),
        (2, 1, None, None, None),
        (None, None, None, "> lost", None),
        (None, 3, "user", "lost", None),
    ]
    got = {(r["conv_id"], r["turn"]): r for r in quotes.linked_conversations(messages_of(spark, rows)).collect()}
    assert len(got) == len(rows)
    reply = {k: (r["reply_to"], r["root_turn"]) for k, r in got.items()}
    assert reply[1, 0] == (None, 0) and reply[1, 1] == (0, 0) and reply[1, 2] == (None, 2)
    assert reply[1, 3] == (1, 0)   # the shallow quote names the answer, the deep one its question
    assert reply[1, 4] == (None, 4)  # two quoted lines are one passage, which nobody wrote
    assert reply[1, 5] == (0, 0)
    assert reply[1, 6] == (3, 0)   # the latest of two equally deep quotes
    assert reply[2, 0] == (None, 0)
    assert got[1, 3]["n_quoted"] == 2 and got[1, 3]["n_linked"] == 2
    assert got[1, 1]["chat"] == "<|assistant|>\nAn answer"
    assert got[2, 1]["chat"] == "<|unknown|>\n"
    order = sorted((r["position"], r["turn"]) for k, r in got.items() if k[0] == 1)
    assert [t for _, t in order] == [0, 1, 3, 5, 6, 2, 4] and [p for p, _ in order] == list(range(7))


def test_trimmed_quotes(spark):
    first = "The alpha line comes first\nthen the beta line follows\nand gamma closes. A last sentence here!\n\nA second paragraph\nwith its end"
    rows = [
        (0, first, None),
        (1, "ok\nA shared line of some length", None),
        (2, "> then the beta line follows\none line", 0),
        (3, "> then the beta line follows\n> and gamma closes. A last sentence here!\nhead left out", 0),
        (4, "> The alpha line  COMES first\n> then the beta line follows\ntail left out", 0),
        (5, "> then the beta line follows\n> with its end\ntwo paragraphs", 0),
        (6, "> A last sentence here!\na sentence", 0),
        (7, "> The alpha line comes first\n> [...]\n> and gamma closes. A last sentence here!\nmiddle left out", 0),
        (8, "> A last\n> sentence here!\nwrapped anew", 0),
        (9, "> then the beta line follows\n> nobody wrote this\nnot a quote", None),
        (10, "A shared line of some length\nand a short one", None),
        (11, "x\nA shared line of some length\nand a short one\ny", None),
        (12, "> ok\n> and a short one\nmost of it", 10),
        (13, "> with its end of\nhalf a line more", None),
        (14, "> never\n> before\nlater", None),
        (15, "x\nnever\ny\n\nbefore", None),
    ]
    messages = messages_of(spark, [(1, i, "user", t, "x") for i, t, _ in rows] + [(2, 0, "user", "> then the beta line follows\nz", "x")])
    got = {(r["conv_id"], r["turn"]): r["reply_to"] for r in quotes.linked_conversations(messages).collect()}
    assert got == {(1, i): w for i, _, w in rows} | {(2, 0): None}


def test_trimmed_quote_goes_to_the_message_that_holds_most(spark):
    texts = ["a long line that was said twice\nx", "y\na long line that was said twice\nshort\nz", "> a long line that was said twice\n> short\nre"]
    got = quotes.linked_conversations(messages_of(spark, [(1, i, "user", t, "x") for i, t in enumerate(texts)])).collect()
    assert [r["reply_to"] for r in got if r["turn"] == 2] == [1]


def test_repeated_messages_and_empty_table(spark):
    rows = [(1, 0, "user", "same", "x")] * 3 + [(1, 1, "user", "> same\nyes", "x")]
    got = quotes.linked_conversations(messages_of(spark, rows)).collect()
    assert sorted(r["position"] for r in got) == [0, 1, 2, 3]
    assert [r["reply_to"] for r in got if r["turn"] == 1] == [0]
    assert quotes.linked_conversations(messages_of(spark, [])).count() == 0


def test_long_reply_chain(spark):
    rows = [(7, 0, "user", "line 0", "x")] + [(7, i, "user", f"> line {i - 1}\nline {i}", "x") for i in range(1, 70)]
    got = quotes.linked_conversations(messages_of(spark, rows))
    assert got.where("root_turn = 0 and position = turn").count() == 70


def test_quoting_view_reads_every_message(spark, small_dir):
    conversations = spark.read.parquet(f"{small_dir}/conversations.parquet")
    assert quoting_view(conversations).count() == conversations.count()
    plan = QUERIES["op8_chat_formatting"](spark, small_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- URL filter


def brute_split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = rest
    for mark in "/?#":
        host = host.split(mark)[0]
    path = rest[len(host) :].split("?")[0].split("#")[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def brute_rule(host, path):
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


EDGE_URLS = [
    None, "", "nothing", "http://", "http://ORG", "http://ORG/", "http://a.Org/x", "http://xorg/", "https://example.org/es/1",
    "https://example.org/es", "https://m.example.org/en/12?x=1", "http://example.org/en/2", "http://Ä.com/FR/", "http://x.com/fr/?q=://",
    "http://x.com?/de/", "http://x.com#/de/", "http://b.com/de/#f", "a://b://c.com/de/", "http://user@x.com:80/de/", "://com/de/",
    "http://com/de/", "http://x.com/" + "9" * 30_000, "x\ny://z.com/fr/\nq",
]


def test_rules_and_parts(spark):
    rows = [(i, u, 1.0) for i, u in enumerate(EDGE_URLS)] * 2 + [(None, EDGE_URLS[8], None)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, label double")
    got = urlfilter.filter_urls(pages, URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        url = EDGE_URLS[r["page_id"] if r["page_id"] is not None else 8]
        host, path = brute_split(url)
        rule = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.name if rule else None), url
        assert r["verdict"] == rule.verdict if rule else r["verdict"] in ("allow", "block")


def test_nothing_to_learn(spark):
    pages = spark.createDataFrame([(1, "http://x.net/"), (2, None)], "page_id bigint, url string")
    assert {r["verdict"] for r in urlfilter.filter_urls(pages, URL_RULES).collect()} == {"allow"}
    assert urlfilter.filter_urls(pages.limit(0), URL_RULES).count() == 0


def test_held_out_accuracy_of_the_trees(spark):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        if i % 2:
            url = f"http://{rng.choice('abcdef')}{rng.randint(1000, 99999)}-win.example.com/{rng.randint(0, 9**9)}?a={i}&b={rng.randint(0, 999)}&c=1"
        else:
            url = f"https://www.site{rng.choice('abcdef')}.example.net/{rng.choice(['news', 'about', 'blog'])}/page"
        rows.append((url + f"#{i}", None if i % 5 == 0 else float(i % 2), i))
    urls = spark.createDataFrame(rows, "url string, label double, truth bigint")
    host, path = urlfilter.split_url(F.col("url"))
    got = urlfilter.judged(urls.withColumns({"host": host, "path": path})).where("label is null").collect()
    assert len(got) == 120
    assert sum((r["score"] > 0.5) == bool(r["truth"] % 2) for r in got) >= 114


def test_entropy(spark):
    urls = spark.createDataFrame([("aabb",), ("aaaa",), (None,)], "url string").withColumns({"host": F.lit(""), "path": F.lit("")})
    assert [r["f_entropy"] for r in urlfilter.with_features(urls).collect()] == [1.0, 0.0, 0.0]


def test_own_label_is_left_out(spark):
    rows = [("a", 1.0), ("a", 1.0), ("a", 0.0), ("a", None), ("rare", 1.0), ("none", None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, k string, label double")
    got = {r.id: r.f_k for r in urlfilter._statistic(frame, "k", "k", 0.75).collect()}
    for i, (key, own) in enumerate(rows):
        others = [label for j, (k, label) in enumerate(rows) if k == key and j != i and label is not None]
        want = (sum(others) + urlfilter.SMOOTHING * 0.75) / (len(others) + urlfilter.SMOOTHING)
        assert got[i] == pytest.approx(want)
    assert got[4] == got[5] == pytest.approx(0.75)  # nothing but the row itself tells about its key
