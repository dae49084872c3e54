"""Encoding, leaks and subjects, against the tokenizer library, brute force and planted cases."""

import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seriate.llm import leaks, queries
from seriate.llm.bpe import FOLDER, Encoded, decode, encode, encode_column, encode_tables, splice_column, vocabulary
from seriate.llm.leaks import Automaton, decode_entities, leaked_spans, normal_words, placed_words, strip_tags, without_leaks
from seriate.llm.posts import own_paragraphs, without_quotes
from seriate.llm.subjects import LatentModel, assign_subjects, clean_labels, with_usual

PATH = os.path.join(FOLDER, "byte_bpe_50k.json")
PIECES = ["a", "b", "the", "ing", " ", "  ", "\n", "é", "日本", "1", "23", "!", "...", "​", "<|endoftext|>", "'s", "'ll", "\t", "xx", "zzzz", "😀", "_", "-----", "=", "\r\n", "Straße", " ", "é", "lololo"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 50))) for _ in range(n)]


def test_same_ids_as_the_library(library):
    vocab = vocabulary(PATH)
    corpus = [r[0] for r in duckdb.execute("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text <> ''").fetchall()]
    for text in [*corpus, *texts(3000, 1), "a" * 5000, "ab" * 3000, " " * 2000, "😀" * 500]:
        ids = encode(text, vocab)
        assert ids == library.encode(text, add_special_tokens=False).ids, text[:80]
        assert decode(ids, vocab) == text


def test_one_last_token_for_each_prefix(library):
    """The table's claim: exactly one token can end a prefix's encoding."""
    vocab = vocabulary(PATH)
    for word in ["hello", "aaaaaaa", "ingings", "theirselves", "0123123", "één"]:
        raw = word.encode()
        last = vocab.extend(raw, [])
        for e in range(1, len(raw) + 1):
            fits = []
            for n in range(1, e + 1):
                t = vocab.ids.get(raw[e - n : e])
                if t is not None and vocab.alone(t) and (n == e or vocab.beside(last[e - n - 1], t)):
                    fits.append(t)
            assert fits == [last[e - 1]]


def test_appends_and_edits(library):
    vocab, rnd = vocabulary(PATH), random.Random(3)
    text = Encoded(vocab, "")
    for more in texts(150, 4):
        text.append(more)
    assert text.ids() == encode(text.text, vocab)
    for new in texts(300, 5):
        a = rnd.randint(0, len(text.text))
        text.splice(a, min(len(text.text), a + rnd.choice([0, 0, 1, 5, 40])), new[: rnd.choice([0, 1, 3, 200])])
        assert text.ids() == encode(text.text, vocab) == library.encode(text.text, add_special_tokens=False).ids
    long = Encoded(vocab, "some words and more words " * 2000)
    long.splice(26_000, 26_004, "xyz")
    assert long.redone < 20 and long.ids() == encode(long.text, vocab)
    long.append("s")
    assert long.redone < 4


def test_encode_column(spark):
    df = spark.createDataFrame([(1, "hi there"), (2, ""), (3, None), (None, "x"), (1, "hi there"), (4, "word " * 100_000)], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = encode_column(df, "doc_id", "text").collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in got) == [(0, 1), (1, 2), (1, 2), (2, 0), (3, 0), (4, 100_001)]
    assert encode_column(df.limit(0), "doc_id", "text").count() == 0


def test_splice_column(spark, library):
    rows = [(1, "one two three", 4, 7, "2 and a half"), (2, None, None, None, "new"), (3, "", 0, 0, None), (4, "end", None, None, "ing of é"), (5, "cut here", -3, 99, ""), (None, "x" * 3000, 1500, 1501, " "), (6, "日本語 text", 1, 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, a int, b int, more string").withColumn("tables", F.lit("clash"))
    tables = encode_tables(df, "doc_id", "text")
    edits = df.select(F.col("doc_id").alias("d"), "a", "b", "more")
    got = splice_column(tables.join(edits, tables.doc_id.eqNullSafe(edits.d)), "doc_id", "a", "b", "more").collect()
    want = {1: "one 2 and a half three", 2: "new", 3: "", 4: "ending of é", 5: "", None: "x" * 1500 + " " + "x" * 1499, 6: "日語 text"}
    assert {r["doc_id"]: r["text"] for r in got} == want
    assert all(r["ids"] == library.encode(r["text"], add_special_tokens=False).ids for r in got)


def test_appended_parents(spark, library):
    docs = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    text = lambda d: docs[d]["text"] if d in docs else None
    got = queries.p7_appended(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        more = text(docs[r["doc_id"]]["parent_id"])
        assert r["ids"] == library.encode((text(r["doc_id"]) or "") + ("" if more is None else "\n" + more), add_special_tokens=False).ids


def test_normal_words():
    assert normal_words("A&amp;amp;lt;b&amp;amp;gt;B c­ar <i>x</i>[B]y[/b]ﬁne Ⅷ _q_ 12,5") == ["a", "b", "car", "x", "y", "fine", "viii", "q", "12", "5"]
    assert normal_words(None) == normal_words("") == normal_words(" \n") == []
    assert decode_entities("&" + "amp;" * 100_000 + "lt;") == "<"
    assert strip_tags("a < b [see here](u) [quote=\"x\"]c[/QUOTE] <!-- d --> 3 > 2").split() == ["a", "<", "b", "[see", "here](u)", "c", "3", ">", "2"]


def by_runs(docs, items, n):
    grams = {}
    for i, words in items:
        for k in range(len(words) - n + 1):
            grams.setdefault(tuple(words[k : k + n]), set()).add(i)
    return {(d, i) for d, words in docs for k in range(len(words) - n + 1) for i in grams.get(tuple(words[k : k + n]), ())}


def test_automaton_against_runs():
    rnd = random.Random(8)
    for n in (1, 2, 4):
        words = lambda size: [rnd.choice("abcd") for _ in range(size)]
        items = [(i, words(rnd.randint(0, 25))) for i in range(12)] + [(50, list("aaaaaaaa")), (51, list("abababab")), (52, list("aaaaaaaa"))]
        docs = [(d, words(60)) for d in range(30)]
        auto = Automaton(items, n)
        assert len(auto.next) <= 2 * sum(len(w) for _, w in items) + 1
        got = {(d, i) for d, w in docs for _, _, hit in auto.runs(w) for i in hit}
        assert got == by_runs(docs, items, n)
        for _, w in docs:
            for at, length, _ in auto.runs(w):
                run = " ".join(w[at - length + 1 : at + 1])
                assert any(run in " ".join(x) for _, x in items)


ITEM = "One two three four five six seven eight nine ten eleven twelve thirteen"


def leak_tables(spark):
    docs = [
        (1, f"before {ITEM} after"), (2, "one two three four five six seven eight nine ten"), (3, "one two three four five six seven eight nine"), (4, None), (5, ""), (6, "&lt;b&gt;ONE&lt;/b&gt; two, three [i]four[/i] five\n> six seven-eight nine te​n!"),
        (7, "two three four five six seven eight nine ten eleven and " + "filler words here " * 50_000), (None, ITEM), (8, "one two three four five x six seven eight nine ten eleven twelve"),
    ]
    items = [(10, ITEM), (11, "zero one two three four five six seven eight nine ten other"), (12, "short"), (13, None), (14, ITEM)]
    return spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash")), spark.createDataFrame(items, "item_id long, passage string")


@pytest.mark.parametrize("block", [200_000, 13])
def test_leaks(spark, monkeypatch, block):
    monkeypatch.setattr(leaks, "BLOCK_WORDS", block)
    monkeypatch.setattr(leaks, "DOCUMENTS", 2)
    docs, items = leak_tables(spark)
    spans = leaked_spans(docs, "doc_id", "text", items, "item_id", "passage")
    got = {(r["doc_id"], r["item_id"]) for r in spans.collect()}
    words = [(r["doc_id"], normal_words(r["text"])) for r in docs.collect()]
    assert got == by_runs(words, [(r["item_id"], normal_words(r["passage"])) for r in items.collect()], 10)
    assert {i for d, i in got if d == 7} == {10, 14} and (6, 10) in got and (2, 11) in got and not any(d in (3, 4, 5, 8) for d, _ in got)
    first = next(r for r in spans.collect() if (r["doc_id"], r["item_id"]) == (1, 10))
    assert (first["first_word"], first["n_words"], first["doc_words"]) == (1, 13, 15)
    for part in ((docs.limit(0), items), (docs, items.limit(0))):
        assert leaked_spans(part[0], "doc_id", "text", part[1], "item_id", "passage").count() == 0


def test_search_without_use_of_the_filter(spark, monkeypatch):
    """A filter too small for the items lets documents through; the result is the same."""
    docs, items = leak_tables(spark)
    items = items.unionByName(spark.createDataFrame([(100 + i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(10)], "item_id long, passage string"))
    want = sorted(map(tuple, leaked_spans(docs, "doc_id", "text", items, "item_id", "passage").na.fill(-1).collect()))
    monkeypatch.setattr(leaks, "MOST_BITS", 64)
    assert sorted(map(tuple, leaked_spans(docs, "doc_id", "text", items, "item_id", "passage").na.fill(-1).collect())) == want
    assert leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "passage").documents.count() == 6


def test_placed_words():
    text = "a&amp;amp;lt;b&gt;ONE&lt;/b&gt; cafe\u0301 ﬁ½ ①x &eacute;t\u200bé [i]ΟΔΟΣ[/i] İs 한\u1100\u1161\u11a8 &notit; ﷺ Ⅷ"
    words = placed_words(text)
    assert [w for w, _, _ in words] == normal_words(text)
    where = {w: text[a:b] for w, a, b in words}
    assert where["café"] == "cafe\u0301" and where["fi1"] == "ﬁ½" and where["été"] == "&eacute;t\u200bé" and where["οδος"] == "ΟΔΟΣ" and where["one"] == "ONE"
    rnd = random.Random(8)
    pool = ["&", "amp;", "lt;", "<b>", "</i>", "[quote=x]", "[/b]", "é", "e\u0301", "\u0327", "\u1100", "\u1161", "\u11a8", "ﬃ", "\u200b", "\u00ad", " ", "\n", "Σ", "İ", "½", "a", "B", "7", "_", "#65;", "#x41", "ｶ\uff9e", "\u09c7", "\u09be", "𝐀", "゛", "か\u3099"]
    for _ in range(3000):
        text = "".join(rnd.choice(pool) for _ in range(rnd.randint(0, 25)))
        words = placed_words(text)
        assert [w for w, _, _ in words] == normal_words(text), repr(text)
        assert all(0 <= a < b <= len(text) for _, a, b in words)


def test_removal(spark):
    docs, items = leak_tables(spark)
    found = leaks.find_leaks(docs, "doc_id", "text", items, "item_id", "passage")
    out = {r["doc_id"]: r for r in without_leaks(found, "doc_id").collect()}
    assert out[1]["dropped"] and out[1]["kept_text"] == "" and out[1]["removed_words"] == 15
    assert not out[7]["dropped"] and out[7]["removed_words"] == 10 and out[7]["kept_text"] == " and " + "filler words here " * 50_000
    assert set(out) == {1, 2, 6, 7, None}
    kept = {r["doc_id"]: r["kept_text"] for r in without_leaks(found, "doc_id", 1.0).collect()}
    assert kept[1] == "before  after" and kept[None] == "" and kept[6] == "&lt;b&gt;!"


def test_found_in_the_documents(spark):
    """The query over the test tables against a search of every item in every text."""
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "eval_items"))
    words = [(r["doc_id"], normal_words(r["text"])) for r in docs.collect()]
    assert all([w for w, _, _ in placed_words(r["text"])] == normal_words(r["text"]) for r in docs.collect())
    want = by_runs(words, [(r["item_id"], normal_words(r["passage"])) for r in items.collect()], 10)
    got = [tuple(r) for r in queries.p8_found(spark, "/root/testdata/sf0.001").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    left = {r["doc_id"]: r for r in queries.p8_cleaned(spark, "/root/testdata/sf0.001").collect()}
    assert set(left) == {d for d, _ in want}
    cleaned = [(d, normal_words(r["kept_text"])) for d, r in left.items()]
    assert not by_runs(cleaned, [(r["item_id"], normal_words(r["passage"])) for r in items.collect()], 10)
    found = {r["item_id"]: r["n_docs"] for r in queries.p8_leaked_items(spark, "/root/testdata/sf0.001").collect()}
    assert sum(found.values()) == len(want)


def test_own_words():
    assert own_paragraphs("[quote=a][quote=b]in[/quote]mid[/QUOTE]own words\n\nmore\n-- \nsig")[0] == ["\nown words", "more"]
    assert own_paragraphs("x wrote:\n> quoted\n| too\nmine")[0] == ["mine"]
    assert [p.strip() for p in own_paragraphs("<blockquote><cite>n</cite><p>theirs</p></blockquote>\n<p>mine</p><p>two</p>")[0]] == ["mine", "two"]
    assert without_quotes("[quote]never closed\nmine") == "\nmine" and without_quotes("stray[/quote] end") == "stray end"
    assert own_paragraphs("cafÃ© &amp;quot;x&amp;quot;")[0] == ['café "x"']
    assert own_paragraphs("see https://host.test/a/b now") == (["see   now"], ["host.test"])
    for empty in (None, "", " \n\t", "> only\n> quoted", "[code]x = 1[/code]"):
        assert own_paragraphs(empty)[0] == []


def test_latent_model_learns_which_function_to_trust():
    rnd = np.random.default_rng(5)
    counts = {}
    for _ in range(20_000):
        y = rnd.random() < 0.3
        good = int(y) if rnd.random() < 0.95 else int(not y)
        weak = int(y) if rnd.random() < 0.6 else int(not y)
        counts.setdefault((8 * good, weak), [0, 0, 0])[0] += 1
    model = LatentModel([(p, *c) for p, c in counts.items()])
    assert abs(model.prior - 0.3) < 0.1
    assert model.posterior((8, 0)) > 0.5 > model.posterior((0, 1))


def test_all_hosts_of_a_post_count(spark):
    rows = [(i, "s", [h], s, 5, 0, 1, 1) for i, (h, s) in enumerate([("a.test", "law")] * 3 + [("z.test", "sport")] * 5)]
    rows += [(20, "s", ["a.test", "z.test"], "sport", 1, 0, 1, 1), (21, "s", [], "sport", 1, 0, 1, 1), (22, "s", ["a.test", "z.test"], None, 0, 0, 0, 0), (23, "s", ["b.test", "q.test"], "law", 5, 0, 1, 1), (24, None, ["q.test"], "law", 1, 0, 1, 1), (None, "s", ["a.test", "z.test"], "sport", 1, 0, 1, 1)]
    levels = spark.createDataFrame(rows, "doc_id long, source string, hosts array<string>, subject string, lexicon int, remark int, opening int, closing int")
    got = {r["doc_id"]: (r["address"], r["source"] > 0) for r in with_usual(levels).collect()}
    assert len(got) == len(rows) - 1
    assert got[0] == got[20] == got[None] == got[23] == (4, True) and got[21] == (0, True) and got[24] == (4, False)


def test_clean_labels(spark):
    df = spark.createDataFrame([(1, " Sport "), (1, "sport"), (1, None), (None, "law"), (2, "  "), (2, "NONE")], "doc_id long, subject string")
    assert sorted(map(tuple, clean_labels(df, "doc_id", "subject").collect())) == [(1, "sport"), (2, "none")]


SPORT, LAW = ["the goalkeeper saved a penalty", "our striker missed the derby", "rest the captain before the match"], ["the defendant signed a waiver", "serve notice to the tenant", "the statute voids this contract"]


def test_subjects_of_planted_posts(spark):
    rnd = random.Random(9)
    docs, labels, truth = [], [], {}
    for i in range(400):
        kind = rnd.choice(["sport", "law", "none", "both"])
        say = lambda of, n: " ".join(f"{s.capitalize()}. I keep {rnd.randint(1, 99)} notes." for s in rnd.sample(of, n))
        body = {"sport": say(SPORT, 3), "law": say(LAW, 3), "none": "Thanks a lot everyone.", "both": say(SPORT, 3) + "\n\n" + say(LAW, 3)}[kind]
        quote = f"[quote=x]{say(rnd.choice([SPORT, LAW]), 2)}[/quote]\n" if rnd.random() < 0.3 else ""
        docs.append((i, quote + body, rnd.choice(["s1", "s2", None])))
        truth[i] = {"sport": {"sport"}, "law": {"law"}, "none": set(), "both": {"sport", "law"}}[kind]
        if i < 120:
            labels += [(i, s.upper()) for s in (truth[i] or {"none"})]
    docs += [(900, None, "s1"), (901, "", "s1"), (902, " ", None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("subject", F.lit("clash"))
    got = {}
    for r in assign_subjects(d, spark.createDataFrame(labels, "doc_id long, subject string"), ["law", "sport"]).collect():
        got.setdefault(r["doc_id"], set()).add(r["subject"])
    held_out = [i for i in truth if i >= 120]
    assert sum(got.get(i, set()) == truth[i] for i in held_out) / len(held_out) > 0.95
    assert not {900, 901, 902} & set(got)
    none = spark.createDataFrame([], "doc_id long, subject string")
    assert assign_subjects(d, none, ["law", "sport"]).count() == 0
    assert assign_subjects(d.limit(0), none, ["law"]).count() == 0
