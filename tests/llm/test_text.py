"""Tokens, languages, toxicity, URLs, pages and benchmark items."""

import random

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from poiscope.llm.bpe import Vocabulary, cut, decode_documents, encode_documents, vocabulary_path
from poiscope.llm.common import held_out, table
from poiscope.llm.decontamination import Items, contaminated, drop_contaminated, runs, words_of
from poiscope.llm.dom import Slot, match, parse
from poiscope.llm.extraction import extract_main_text, main_text
from poiscope.llm.language_id import identify
from poiscope.llm.toxicity import score_toxicity
from poiscope.llm.url_filter import Rule, judge_urls
from poiscope.llm.words import HASHES

ALPHABET = "abcdeinorst THEthe's don't'll  \x1c\x85\xa0 \n\tÉéèßΣσςİıĀñ中文字😀👍🏽0123½ⅷ#$%&*…—‘’<|endoftext|><|startoftext|>é́ÅńKﬁ\x00​"


def test_tokens_as_the_library(documents, spark, directory):
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += [None, "", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΣΑΣ.", "aaaaaaa" * 300, "x" * 5000]
    texts += [r["text"] for r in table(spark, directory, "documents").select("text").collect()]
    library = Tokenizer.from_file(vocabulary_path())
    docs = documents(enumerate(texts))
    got = {r["doc_id"]: r for r in encode_documents(docs, decoded_into="decoded").collect()}
    for i, e in enumerate(library.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == e.ids, texts[i]
        assert got[i]["decoded"] == library.decode(e.ids, skip_special_tokens=False)
    again = decode_documents(encode_documents(documents([(1, "a b"), (2, None)])).withColumn("text", F.lit("x")))
    assert {r["doc_id"]: r["decoded"] for r in again.collect()} == {1: "a</w> b</w>", 2: ""}
    assert encode_documents(documents([])).count() == 0


def test_some_words_need_merging():
    """Both ways are taken: proposals that stand and words that are merged."""
    known = Vocabulary(vocabulary_path())
    words = ["the", "tion", "therein", "unhappiness", "bletion", "erheou", "thtionre", "inonha"]
    flat, lengths = known.propose(words)
    stands = [a == b for a, b in zip(cut(flat, lengths), known.encode_words(words))]
    assert any(stands) and not all(stands)


def test_languages(spark, directory):
    docs = table(spark, directory, "documents")
    done = identify(docs, teaches=~held_out(F.col("doc_id"))).join(docs.select("doc_id", "lang"), "doc_id")
    judged = done.filter(held_out(F.col("doc_id"))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in judged) >= 0.95 * len(judged)
    assert all(0 <= r["score"] <= 1 for r in judged)


def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        for piece in {word[:n]} & pieces:
            for rest in segmentations(word[n:], pieces):
                yield [piece, *rest]


def test_forward_pass_sums_all_segmentations(spark):
    from poiscope.llm import language_id as lid

    path = lid.piece_model_path()
    model = lid._pieces(path)
    docs = spark.createDataFrame([(1, "the other thing that", "en"), (2, "der andere und das", "de")], "doc_id long, text string, lang string")
    unigrams = lid.train(docs, "lang", "text", path)
    pieces = {model.id_to_piece(i): i for i in range(len(model)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    share = unigrams.factor / unigrams.scale ** unigrams.lengths[:, None]
    for word in ("the", "other", "anderes", "thé", "qzx", "ჰო"):
        marked = lid.START + word
        letters = set(pieces) | set(marked)
        expected = np.zeros(2)
        for split in segmentations(marked, letters):
            # A letter may stand for itself beside being a piece.
            ways = [[share[pieces[p]] for _ in range(p in pieces)] + [share[-1]] * (len(p) == 1) for p in split]
            expected += np.prod([np.sum(w, axis=0) for w in ways], axis=0)
        assert np.allclose(unigrams.forward([word])[0], np.log(expected), rtol=1e-9)
        assert np.allclose(unigrams.forward([word, word], logs=True), np.log(expected), rtol=1e-9)


def test_words_outside_the_vocabulary_have_scores(documents):
    rows = [(1, "der und die das nicht"), (2, "the and of that this")]
    rows += [(10 + i, c * n) for i, (c, n) in enumerate([("ჰ", 200), ("𒀀", 57), ("𝔞", 100), ("中", 5000), ("x", 5000), ("ꙮ", 201)])]
    rows += [(30, "the and of " + "ჰ" * 300)]
    docs = documents(rows).withColumn("lang", F.when(F.col("doc_id") == 1, "de").when(F.col("doc_id") == 2, "en"))
    got = {r["doc_id"]: r for r in identify(docs).collect()}
    assert all(r["score"] is not None and 0 <= r["score"] <= 1 for r in got.values())
    assert got[30]["lang_pred"] == "en" and got[30]["score"] > 0.5


def test_language_edges(documents):
    rows = [(1, "der und die das nicht"), (2, "the and of that this"), (3, None), (4, ""), (5, "123 !?"), (6, "x" * 5000), (7, "the " * 20_000)]
    docs = documents(rows).withColumn("lang", F.when(F.col("doc_id") == 1, "de").when(F.col("doc_id") == 2, "en"))
    got = {r["doc_id"]: r["lang_pred"] for r in identify(docs).collect()}
    assert [got[i] for i in (1, 2, 3, 4, 5, 7)] == ["de", "en", "und", "und", "und", "en"]
    unlabelled = identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unlabelled} == {"und"}
    carried = identify(docs, carry=True).select("row.*")
    assert carried.columns == docs.columns
    assert identify(docs.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(3)

    def text(toxic):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randrange(20, 80))]
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["you idiot", "grumblefoo", "st*pid", "moron"]))
        return " ".join(words)

    kinds = {i: int(rng.random() < 0.3) for i in range(600)}
    docs = spark.createDataFrame([(i, text(t)) for i, t in kinds.items()] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, t in kinds.items()] + [(0, kinds[0]), (700, None)], "doc_id long, toxic int")
    scores = {r["doc_id"]: r["score"] for r in score_toxicity(docs, labels, teaches=F.col("doc_id") % 4 != 2).collect()}
    assert len(scores) == 602 and all(0 <= s <= 1 for s in scores.values())
    held = [i for i in kinds if i % 4 == 2]
    assert sum((scores[i] >= 0.3) == kinds[i] for i in held) >= 0.9 * len(held)
    assert scores[900] == scores[901] < 0.3
    none = score_toxicity(docs, labels.limit(0)).select("score").distinct().collect()
    assert [r[0] for r in none] == [0.0]
    assert score_toxicity(docs.limit(0), labels).count() == 0


def test_urls(spark):
    rules = (Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"))
    urls = [
        "http://a.com/x", "HTTP://WWW.Example.COM/en/1?u=http://b/", "https://blog.example.com/en/7#t", "http://example.com",
        "http://notexample.com/en/", "http://x.org/a?b", None, "no scheme", "", "://host", "http://h.com/a\nb?c",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: r for r in judge_urls(pages, rules).collect()}
    assert [got[i]["host"] for i in range(11)] == [
        "a.com", "www.example.com", "blog.example.com", "example.com", "notexample.com", "x.org", "", "", "", "host", "h.com"
    ]
    assert [got[i]["path"] for i in (0, 1, 2, 3, 5, 10)] == ["/x", "/en/1", "/en/7", "", "/a", "/a\nb"]
    assert [got[i]["rule"] for i in range(6)] == ["com/", "www.example.com/en/", "example.com/en/", None, "com/", None]
    assert [got[i]["verdict"] for i in (0, 1, 2, 4)] == ["allow", "allow", "block", "allow"]
    assert all(r["verdict"] in ("allow", "block") for r in got.values())
    assert judge_urls(pages.limit(0), rules).count() == 0


def test_url_trees_learn(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        bad = rng.random() < 0.5
        host = ("x" + "".join(rng.choice("0123456789") for _ in range(12)) if bad else rng.choice(["news", "blog", "docs"])) + ".org"
        rows.append((f"http://{host}/{'a/' * (4 if bad else 1)}p{i}", "block" if bad else "allow"))
    labelled = spark.createDataFrame(rows[:300], "url string, verdict string")
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in judge_urls(pages, (), labelled=labelled).collect()}
    assert sum(got[i] == rows[i][1] for i in range(300, 400)) >= 95


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><script>var t='</p>';</script></head><body><nav><a href='/'>Home</a></nav>"
    "<div class=\"cookie-notice\">We use cookies</div><!-- <p>no</p> --><article><h1>{0} &amp; more</h1><p><b>{0}<br><p>one  two\n{0}</p>"
    "<form><input>Search</form><section class='comments'><p>First!</p></section></article><aside>Side</aside><footer>&copy; x"
)


def test_pages(spark):
    rows = [(i, "http://h.org/%d" % i, PAGE.format("Story %d" % i)) for i in range(15)]
    rows += [(100, None, None), (101, "http://h.org/", ""), (102, "nowhere", "<p>plain &lt;b&gt; &#233;"), (103, "http://h.org/9", "just text")]
    rows += [(104, "http://deep.org/", "<div>" * 3000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("wrapper", F.lit("clash"))
    got = {r["page_id"]: r for r in extract_main_text(pages).collect()}
    for i in range(15):
        assert got[i]["text"] == f"Story {i} & more\nStory {i}\none two Story {i}"
    assert [got[i]["text"] for i in (100, 101, 102, 103, 104)] == ["", "", "plain <b> é", "just text", "deep"]
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert extract_main_text(pages.limit(0)).count() == 0


LONG = " ".join(f"word{i}" for i in range(120))
SHAPES = {
    "named content": ("<div class='content has-sidebar'><h1>T</h1><p>{}</p></div>", "T\n{}"),
    "named page": ("<div class='page header-fixed'><p>{}</p><p>End.</p></div>", "{}\nEnd."),
    "state only": ("<div class='has-sidebar'><h1>T</h1><p>{}</p></div>", "T\n{}"),
    "page-wide form": ("<form action='/'><article><h1>T</h1><p>{}</p></article><input></form>", "T\n{}"),
    "page named menu": ("<div class='menu'><h1>T</h1><p>{}</p></div>", "T\n{}"),
    "subject in a name": ("<article><p>{}</p><p class='related-work'>Others.</p><p class='ad'>Buy</p></article>", "{}\nOthers."),
    "body in article": ("<article><h1>T</h1><div class='body'><p>{}</p></div><p>Closing.</p></article>", "T\n{}\nClosing."),
    "main table": ("<main><h1>T</h1><p>Lead.</p><table><tr><td>{}</td></tr></table></main>", "T\nLead.\n{}"),
    "list beside heading": ("<div class='x'><h1>T</h1><p>Lead.</p><ul><li>{}</li><li>Two</li></ul></div>", "T\nLead.\n{}\nTwo"),
    "after the nesting": ("<div class='x'><div class='y'><div class='z'><p>{}</p></div></div><p>After.</p></div>", "{}\nAfter."),
    "beside an aside": ("<div class='x'><p>{}</p><aside>No</aside><section class='comments'><article><p>First!</p></article></section></div>", "{}"),
    "a notice": ("<article><p>{}</p><p class='cookie-notice'>We use cookies</p></article>", "{}"),
}


def test_shapes_of_pages(spark):
    assert {k: main_text(f"<html><body><nav>N</nav>{h.format(LONG)}</body></html>", None) for k, (h, _) in SHAPES.items()} == {
        k: t.format(LONG) for k, (_, t) in SHAPES.items()
    }
    rows = []
    for i, (name, (shape, _)) in enumerate(SHAPES.items()):
        for j in range(7):
            body = shape.format(f"{LONG} of {name} {j}")
            rows.append((100 * i + j, f"http://{i}.org/{j}", f"<html><body><nav>N</nav>{body}<footer>F</footer></body></html>"))
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # What is the same on all seven pages of a host is template there.
    for i, (name, (_, text)) in enumerate(SHAPES.items()):
        for j in range(7):
            assert f"{LONG} of {name} {j}" in got[100 * i + j] and "First!" not in got[100 * i + j] and "N" not in got[100 * i + j].split("\n")


def test_template_paragraphs_among_the_others(spark):
    page = "<html><body><article><h1>Story {0}</h1><p>One {0}.</p><p>All rights reserved by us.</p><p>Two {0}.</p></article></body></html>"
    rows = [(i, "http://h.org/%d" % i, page.format(i)) for i in range(12)]
    rows += [(100 + i, "http://two.org/%d" % i, page.format(i)) for i in range(3)]  # too few to tell
    rows += [(200 + i, "http://copies.org/%d" % i, page.format(7)) for i in range(12)]  # one page, often
    rows += [(300 + i, "http://h.org/0", page.format(0)) for i in range(2)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert got[i] == f"Story {i}\nOne {i}.\nTwo {i}."
        assert got[200 + i] == "Story 7\nOne 7.\nAll rights reserved by us.\nTwo 7."
    assert got[100] == "Story 0\nOne 0.\nAll rights reserved by us.\nTwo 0." and got[300] == got[0]


def test_depth_and_length_of_pages():
    deep = "<div>" * 300 + "<p>in</p>" + "</div>" * 300 + "<p>out</p>"
    assert [n.tag for n in parse("<main>" + deep + "</main><p>last").children] == ["main", "p"]
    long = "<article>" + "<p>some words</p>" * 50_000 + "</article>"
    assert main_text(long, None) == "\n".join(["some words"] * 50_000)


def test_registered_pages_hold_every_block(spark, directory):
    """The articles of the given pages, cut out by their known marks."""
    import html
    import re

    rows = {r["page_id"]: r for r in extract_main_text(table(spark, directory, "pages")).collect()}
    for r in table(spark, directory, "pages").collect():
        inner = re.search("<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [re.sub("[ \t-\r]+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split("</?(?:p|h1)>", inner)]
        assert rows[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)


def test_tree_matching():
    def slot(tag, *children):
        return Slot(tag, 0, 0, 1, list(children))

    a = slot("x", slot("a"), slot("b", slot("c")), slot("a"))
    b = slot("x", slot("b", slot("c"), slot("d")), slot("a"))
    assert match(a, b) == 4 and match(a, slot("y")) == 0
    assert [c.tag for c in parse("<p>a<p>b<ul><li>1<li>2</ul>").children] == ["p", "p", "ul"]
    assert main_text("<article><p>a</p></article>", None) == "a"


def test_items(documents, spark):
    rng = random.Random(6)

    def words(n):
        return [f"w{rng.randrange(500)}" for _ in range(n)]

    items = [(i, words(n)) for i, n in enumerate([1, 2, 4, 5, 6, 9, 12, 20, 40, 80, 200, 30, 30])]
    docs = []
    for i in range(60):
        text = words(rng.randrange(300))
        for _ in range(rng.randrange(3)):
            passage = list(rng.choice(items)[1])
            for _ in range(rng.randrange(3)):
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage
        docs.append((i, " ".join(text).title()))
    docs += [(90, None), (91, ""), (92, " ".join(words(30_000) + items[8][1]))]
    bench = [(i, " ".join(w)) for i, w in items] + [(50, None), (51, " .,!")]
    expected = set()
    for d, t in docs:
        for i, w in bench:
            item = words_of(w)
            k = min(5, len(item))
            found = set(runs(item, k)) if item else set()
            shared = len(found & set(runs(words_of(t), k))) if item else 0
            if found and 100 * shared >= 80 * len(found):
                expected.add((d, i, shared, len(found)))
    benchmark = spark.createDataFrame(bench, "item_id long, text string")
    for options in ({}, {"items_at_once": 4}):
        got = contaminated(documents(docs), benchmark, **options).collect()
        assert {tuple(r)[:4] for r in got} == expected and len(got) == len(expected)
    left = drop_contaminated(documents(docs), benchmark)
    assert left.columns == documents([]).columns
    assert {r["doc_id"] for r in left.collect()} == {d for d, _ in docs} - {e[0] for e in expected}
    assert contaminated(documents([]), benchmark).count() == contaminated(documents(docs), benchmark.limit(0)).count() == 0


def test_search_for_items_remembers_no_words():
    """What a worker keeps does not grow with the words of the texts it has searched."""
    item = " ".join(f"item{i}" for i in range(30))
    index = Items([(1, item)], 5, 80)
    before = len(HASHES)
    texts = [" ".join(f"new{t}word{i}" for i in range(200)) + f" {item if t % 5 == 0 else ''}" for t in range(20)]
    assert [bool(f) for f in index.find(texts)] == [t % 5 == 0 for t in range(20)]
    assert len(HASHES) == before
