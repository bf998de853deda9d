import random
import time
import tracemalloc
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataforge.llm import leaks, residue, tokens
from tests.llm import residue_heldout

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id bigint, text string, chunk int, word string, item_id bigint"


@pytest.fixture(scope="module")
def merges():
    return tokens.Merges()


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(tokens.VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ["", " ", "Hello world", "<|endoftext|> is text", "IT'S we'll 12345", "👩‍🔧🛠️👍🏽 𐍈𝕏\U000e0041", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "  two\n\n\tlines \r\n end  ", "मिल पीडी", "日本語のテキスト", "½ ① x²", "\x00\x01\x1c", "abab" * 500, "naïve café " * 2000]


def test_words_make_up_the_text():
    for text in TEXTS:
        assert "".join(tokens.words_of(text)) == text


def test_replay_equals_the_public_library(merges, public):
    words = sorted({w for t in TEXTS for w in tokens.words_of(t)})
    ids = dict(zip(words, tokens.replay(words, merges)))
    for text in TEXTS:
        assert [int(i) for w in tokens.words_of(text) for i in ids[w]] == public(text)


@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text(merges, public, text):
    assert [int(i) for part in tokens.replay(tokens.words_of(text), merges) for i in part] == public(text)


def test_encode(spark, merges, public, monkeypatch):
    rows = [(i, t, 3, "clash", 1) for i, t in enumerate(TEXTS)] + [(0, "", 1, "", 1), (7, None, 1, None, None), (None, "no id", 1, None, None), (2, TEXTS[2], 3, "clash", 1)]
    got = tokens.encode(spark.createDataFrame(rows, SCHEMA), merges).collect()
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == Counter((i, tuple(public(t or ""))) for i, t, *_ in rows)
    assert tokens.encode(spark.createDataFrame([], SCHEMA), merges).collect() == []


def brute(docs, items):
    out = {}
    words = {i: leaks.words_of(t) for i, t in items if i is not None}
    for d, text in docs:
        mine = leaks.words_of(text)
        for i, theirs in words.items():
            best = 0
            for a in range(len(mine)):
                for b in range(len(theirs)):
                    n = 0
                    while a + n < len(mine) and b + n < len(theirs) and mine[a + n] == theirs[b + n]:
                        n += 1
                    best = max(best, n)
            if best >= leaks.MIN_WORDS:
                out[d, i] = best
    return out


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(9)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 40)))) for i in range(25)] + [(25, ""), (26, None), (None, "x")]
    docs = []
    for d in range(150):
        words = [rng.choice(vocab) for _ in range(rng.randrange(0, 30))]
        if d % 3 == 0:  # a third of all documents hold the passage of one item
            source = items[d % 25 if d % 2 else 0][1].split()
            a = rng.randrange(len(source))
            words[5:5] = source[a : a + rng.randrange(9, 20)]
        docs.append((d, ", ".join(words).upper() if d % 2 else "  ".join(words)))
    docs += [(900, None), (901, ""), docs[0]]
    rows = [(d, t, 0, "clash", 5) for d, t in docs]
    item_df = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items)
    assert len(want) > 10
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r["doc_id"], r["item_id"]): r["n_words"] for r in leaks.leaks(df, item_df).collect()}
    assert got == want
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 400)  # items in several blocks
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaks(df, item_df).collect()} == set(want)
    lost = spark.createDataFrame([(None, items[0][1], 0, "clash", 5), (None, "fine", 0, "clash", 5)], SCHEMA)
    clean = leaks.without_leaks(df.unionByName(lost), item_df).where("doc_id is not null or text != 'fine'")
    assert {r["doc_id"] for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_leaks_among_equal_words():
    """A million equal words and a long item of them: no list of all pairs of places."""
    items = leaks.Items([(1, "no " * 3000), (2, "yes " * 20)])
    tracemalloc.start()
    got = leaks.search([7, 8], ["no " * 1_000_000, "yes yes " * 9], items)
    assert tracemalloc.get_traced_memory()[1] < 1 << 30
    tracemalloc.stop()
    assert sorted(map(tuple, got.to_numpy().tolist())) == [(7, 1, 3000, 0, 0), (8, 2, 18, 0, 0)]


def test_leaks_ignore_form_and_need_twelve_words(spark):
    item = "The quick brown fox, jumps over the lazy dog near Café No 7 today"
    run = item.split()
    docs = {
        1: "THE QUICK​ BROWN—FOX jumps…over the la­zy dog near café no 7",
        2: "ｔｈｅ ｑｕｉｃｋ ｂｒｏｗｎ ｆｏｘ ｊｕｍｐｓ ｏｖｅｒ ｔｈｅ ｌａｚｙ ｄｏｇ ｎｅａｒ ｃａｆé ｎｏ",
        3: " ".join(run[:11]),
        4: " ".join(run[:6] + ["very"] + run[6:]),
        5: "before " + " ".join(run[2:]) + " after",
    }
    got = leaks.leaks(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), spark.createDataFrame([(9, item)], "item_id bigint, text string"))
    assert {r["doc_id"]: r["n_words"] for r in got.collect()} == {1: 13, 2: 12, 5: 12}
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert leaks.leaks(empty, spark.createDataFrame([(9, item)], "item_id bigint, text string")).collect() == []
    assert leaks.leaks(spark.createDataFrame([(1, item)], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")).collect() == []


BAD = [
    "Dear {{ name }}, hello", "Hi ${first_name}", "#{city} is nice", "{% title %}", "<%= user %>", "[[order id]] shipped", "<<date>>", "&lt;price&gt;", "by %AUTHOR% today", "__NAME__", "@@link@@", "Published by {0}", "Hello %s!", "[INSERT DATE HERE]", "Welcome to [CITY].", "{order_id}",
    "Lorem ipsum dolor sit amet", "Sed elit amet lorem, tempor.", "asdf asdf asdf", "foo bar foo bar foo bar", "1234567890 1234567890 1234567890", ".... .... .... ....", "Your text goes here", "TBD", "*** Coming soon ***", "Hier steht Ihr Text", "TODO: translate this segment",
    "404 Not Found", "Error 503: Service Unavailable", "(502) bad gateway", "HTTP/1.1 500 Internal Server Error", "code=404 message=Not Found nginx", "Page introuvable (erreur 404)", "Access denied\nA fine sentence follows here.", "A fine sentence stands here.\n<h1>Something went wrong.</h1>", "Your session has expired. Please log in again. Reference #12ab",
    "Traceback (most recent call last): KeyError in view handler", "Please enable JavaScript to view this page.", "THIS SITE REQUIRES COOKIES AND JAVASCRIPT.", "Enable scripts and  refresh to continue", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.", "Checking your browser before accessing the site.",
]
GOOD = [
    None, "", "   ", "A plain sentence.", 'The sentence "this page does not exist" was painted on a wall.', "Room 404 of the inn has a wooden door.", "Only 404 baskets remain, and the teacher tests them.", "The set {1, 2, 19} holds every number.", "Use [brackets] around a name.", "The clerk typed <ladder> with angle signs.", "At 17% it does not.", "<|endoftext|>", "Lorem is the nickname of the gardener.",
    "The carpenter learned how JavaScript draws a lower kettle.", "The teacher keeps 12 cookies in the kitchen.", "The archive numbered TBD-17 was forbidden to the courier.", "For 7 days the kettle under maintenance blocked the road.", "Our lesson explains what a template is and why its field is filled in.", "In Kessing the word placeholder is used for a new oven.",
    "The manual wrote that error 563 is shown when it is wet.", "In the template language a variable such as {{ name }} is written with two braces on each side.", "Write `{{ name }}` in code.", "```\n{{ name }}\n```\nThat is all of it.", "Checksum of the archive: b48226aac2dd8e71ff19c503d98874781cf1ad40", "IT'S WE'LL they're I'd", "1,234,567.89 ½ ① 00 x²", "DÃ¼rfen wir?", "x" * 5000 + " " + "word " * 3 + "end " * 2 + "of a very long text.",
]


def test_residue(spark):
    df = spark.createDataFrame([(i, t, 1, "c", 1) for i, t in enumerate(BAD + GOOD)], SCHEMA)
    got = {r["doc_id"] for r in residue.found(df).collect()}
    assert [t for i, t in enumerate(BAD) if i not in got] == []
    assert [t for i, t in enumerate(GOOD) if i + len(BAD) in got] == []
    assert residue.found(df).columns == df.columns
    assert residue.found(df.where(F.lit(False))).collect() == []


def test_residue_over_all_lines(spark):
    """The whole of a long text counts, not its beginning."""
    words = residue.LOREM.split()
    bad = ["\n".join(words), "\n".join(words * 300), "\n".join(["foo", "bar"] * 200), "yes\n" + " " * 400 + "\nyes\n\nyes", "\n".join(words[:60]) + "\n| retry", "foo\n" * 3 + "retry\n" * 5000]
    good = ["foo\nbar\n" * 60 + "\n".join(f"then the clerk wrote letter {i}" for i in range(9)), "\n".join(words) + "\nis what a printer sets"]
    df = spark.createDataFrame([(i, t, 1, "c", 1) for i, t in enumerate(bad + good)], SCHEMA)
    assert sorted(r["doc_id"] for r in residue.found(df).collect()) == list(range(len(bad)))


def test_residue_repeats_with_punctuation(spark):
    bad = ["foo, foo, foo", "asdf,asdf,asdf,asdf", "Test! Test! Test!", "foo, bar, foo, bar, foo, bar"]
    good = ["foo, foo", "one, two, three", "A foo, a bar, and a foo.", "1,234,567"]
    df = spark.createDataFrame([(i, t, 1, "c", 1) for i, t in enumerate(bad + good)], SCHEMA)
    assert sorted(r["doc_id"] for r in residue.found(df).collect()) == list(range(len(bad)))


def test_token_counts(spark, merges, public):
    df = spark.createDataFrame([(1, "a b a", 1, "", 1), (2, None, 1, "", 1)], SCHEMA)
    got = {r["token_id"]: r["n"] for r in tokens.token_counts(tokens.encode(df, merges)).collect()}
    assert got == dict(Counter(public("a b a")))


@pytest.mark.parametrize(("residue_texts", "kept_texts"), [(residue_heldout.RESIDUE, residue_heldout.TEXT), (residue_heldout.RESIDUE_2, residue_heldout.TEXT_2)])
def test_residue_recall_and_precision(spark, residue_texts, kept_texts):
    n = len(residue_texts)
    df = spark.createDataFrame(list(enumerate(residue_texts + kept_texts)), "doc_id int, text string")
    got = [r["doc_id"] for r in residue.found(df).collect()]
    right = sum(i < n for i in got)
    assert right >= 0.9 * n
    assert right >= 0.9 * len(got)


def test_residue_of_long_lines(spark):
    """One line of a million characters neither recurses nor backtracks, and is tested as a whole."""
    n = 1_000_000
    bad = ["lorem ipsum dolor sit amet " * (n // 27), "not found " + "retry " * (n // 6), "javascript is off " * (n // 18), "... " * (n // 4), "Fatal error: " + "x" * 390, "Traceback (most recent call last): " + "y " * 300, "foo bar " * (n // 8)]
    good = ["-" * n, "=" * n, "a" * n, "{{ " * (n // 3), "```" + " ` " * (n // 3), "<code>" * (n // 6) + "{{ name", "{aB" * (n // 3), "A fine sentence, " * 3 + "and " + "- " * (n // 2)]
    df = spark.createDataFrame(list(enumerate(bad + good)), "doc_id int, text string").repartition(4)
    residue.found(df.limit(1)).collect()
    began = time.monotonic()
    assert sorted(r["doc_id"] for r in residue.found(df).collect()) == list(range(len(bad)))
    assert time.monotonic() - began < 30
