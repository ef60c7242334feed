"""Vocabulary and encoding, also against the public tokenizers library."""

import itertools
import json
from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import Whitespace
from tokenizers.trainers import BpeTrainer

from triplemill import constants as C
from triplemill.operators import vocab

SIZE = 260


def words_of(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n bigint")


def test_merges_on_paper(spark):
    # l o w 5, l o w e r 2, n e w 6: 'w' follows 'o' 7 times, 'e' 6 times ...
    words = words_of(spark, {"low": 5, "lower": 2, "new": 6})
    tokens, merges = vocab.learn_merges(words, 100, 2, special=["<unk>", "<pad>"])
    assert merges == [("l", "o", 7), ("lo", "w", 7), ("e", "w", 6), ("n", "ew", 6), ("e", "r", 2), ("low", "er", 2)]
    assert tokens == ["<unk>", "<pad>", "e", "l", "n", "o", "r", "w", "lo", "low", "ew", "new", "er", "lower"]


def test_limits(spark):
    words = words_of(spark, {"low": 5, "lower": 2, "new": 6})
    assert len(vocab.learn_merges(words, 10, 2, special=["<unk>", "<pad>"])[0]) == 10
    assert len(vocab.learn_merges(words, 100, 7, special=["<unk>", "<pad>"])[1]) == 2
    assert vocab.learn_merges(words, 100, 99, special=["<unk>", "<pad>"])[1] == []


def test_overlapping_copies(spark):
    words = words_of(spark, {"aaa": 3, "aaaa": 2})
    assert vocab.learn_merges(words, 100, 2, special=[])[1][0] == ("a", "a", 12)


@pytest.mark.parametrize("limits", [{}, {"look_ahead": 2, "most_symbols": 12, "most_listed": 3}])
def test_a_symbol_made_twice(spark, limits):
    # 'abc' comes from a+bc and from ab+c; after the second way it is counted anew.
    words = words_of(spark, {"abcx": 9, "ab": 30, "zabc": 7, "bc": 20, "abcy": 8})
    assert vocab.learn_merges(words, 100, 2, special=[], **limits)[1] == [
        ("a", "b", 54), ("ab", "c", 24), ("b", "c", 20), ("abc", "x", 9), ("abc", "y", 8), ("z", "abc", 7)
    ]


@pytest.mark.parametrize("look_ahead, most_symbols", [(1, 10), (5, 40), (40, 300), (300, 10**6)])
def test_width_of_a_round_changes_nothing(spark, look_ahead, most_symbols):
    texts = ["the other then there this those aaaa aaa baaab banana", "mississippi is his kiss the thesis ababab"]
    words = vocab.pretoken_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = vocab.learn_merges(words, 90, 1, [], 25, look_ahead, most_symbols)[1]
    assert got == plain_merges(words, 25)


@pytest.mark.parametrize("most_listed, most_filed", [(1, 24), (3, 24), (40, 24), (10**6, 1), (7, 2)])
def test_length_of_the_list_changes_nothing(spark, monkeypatch, most_listed, most_filed):
    monkeypatch.setattr(vocab, "MOST_FILED", most_filed)
    texts = ["the other then there this those aaaa aaa baaab banana", "mississippi is his kiss the thesis ababab"]
    words = vocab.pretoken_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    got = vocab.learn_merges(words, 90, 1, [], 15, 3, 200, most_listed)[1]
    assert got == plain_merges(words, 15)


def test_rounds_read_the_words_at_their_counts(spark, sf):
    """A word waits until the count of its best pair is reached."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    spelling = vocab.spelled(vocab.pretoken_counts(docs)).cache()
    codes, counts = vocab.best_pairs(spelling, 10**6, 1)
    index = vocab._Index(spark)
    index.file(spelling, codes, counts)
    best = dict(zip(codes.tolist(), counts.tolist(), strict=True))
    rows = [(tuple(r["symbols"]), r["n"]) for r in spelling.collect() if len(r["symbols"]) > 1]
    top = [max(best[(a << 32) | b] for a, b in itertools.pairwise(word)) for word, _ in rows]
    for level in (-1, 1, 3):
        want = sorted(r for r, n in zip(rows, top, strict=True) if n >= 8**max(level, 0))
        assert sorted((tuple(r["symbols"]), r["n"]) for r in index.read(level).collect()) == want
    total = index.read(-1).count()
    high = index.read(2).count()
    index.taken(2)
    assert index.read(-1).count() == total - high and 0 < high < total
    scan = index.read(1)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(level" in scan


def test_counts_follow_the_changed_words(spark):
    counts = {"banana": 3, "bandana": 2, "anna": 5, "nab": 1}
    spelling = vocab.spelled(words_of(spark, counts))
    codes, n = vocab.best_pairs(spelling, 100, 1)
    listed = vocab._Listed(codes, n, 100, 1)
    steps = [(ord("a"), ord("n"), 0x110007), (0x110007, ord("a"), 0x110008)]
    changed = vocab.merged_words(spelling, steps)
    listed.change(*vocab.count_changes(changed, codes, 0x110007, 1))
    after, m = vocab.best_pairs(changed.select("symbols", "n"), 100, 1)
    assert listed.counts == dict(zip(after.tolist(), m.tolist(), strict=True))


def test_estimated_size_of_runs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    spelling = vocab.spelled(vocab.pretoken_counts(docs)).cache()
    codes, _ = vocab.best_pairs(spelling, 500, 1)
    sizes = vocab.run_sizes(spelling, codes, [500, 50, 5])
    for width, size in sizes.items():
        true = vocab.runs_of(spelling, codes[:width]).agg(F.sum(F.size("symbols"))).first()[0]
        assert size <= 1.5 * true + 200 and (true < 2000 or size >= 0.6 * true)
    exact = vocab.run_sizes(spelling, codes, [500, 5], one_in=1)
    assert exact[500] == vocab.runs_of(spelling, codes).agg(F.sum(F.size("symbols"))).first()[0]


def plain_merges(words, most):
    """One merge at a time, all pairs counted again each time."""
    spelling = [(tuple(r["word"]), r["n"]) for r in words.collect()]
    place, out = {c: ord(c) for word, _ in spelling for c in word}, []
    while len(out) < most:
        counts = Counter()
        for word, n in spelling:
            for pair in itertools.pairwise(word):
                counts[pair] += n
        if not counts:
            break
        a, b = min(counts, key=lambda p: (-counts[p], place[p[0]], place[p[1]]))
        out.append((a, b, counts[a, b]))
        place.setdefault(a + b, 0x110000 + len(place))
        # A private mark keeps symbols apart, so that one pattern does the merge.
        joined = [("\0" + "\0".join(word).replace("\0", "\0\0") + "\0", n) for word, n in spelling]
        joined = [(w.replace(f"\0{a}\0\0{b}\0", f"\0{a}{b}\0"), n) for w, n in joined]
        spelling = [(tuple(w.strip("\0").split("\0\0")), n) for w, n in joined]
    return out


def test_full_size_as_the_library(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    tok = Tokenizer(BPE(unk_token=C.UNKNOWN))
    tok.pre_tokenizer = Whitespace()
    trainer = BpeTrainer(vocab_size=4000, min_frequency=C.MIN_FREQUENCY, special_tokens=list(C.SPECIAL_TOKENS), show_progress=False)
    tok.train_from_iterator([r["text"] for r in docs.collect()], trainer)
    tokens, merges = vocab.learn_merges(vocab.pretoken_counts(docs), 4000)
    assert [(a, b) for a, b, _ in merges] == [tuple(m) for m in json.loads(tok.to_str())["model"]["merges"]]
    assert {t: i for i, t in enumerate(tokens)} == tok.get_vocab()


def test_word_order_of_merges():
    ranks = {("a", "b"): 0, ("b", "c"): 1, ("ab", "c"): 2, ("a", "a"): 3}
    assert vocab._word_pieces("abcaa", ranks) == ["abc", "aa"]
    assert vocab._word_pieces("aaaaa", ranks) == ["aa", "aa", "a"]
    assert vocab._word_pieces("", ranks) == []


@pytest.fixture(scope="module")
def corpus(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    more = ["aaaa aaa abab <SOT> <SUBJ> x <EOT>", "", "a_b x‍y \U0001d400z ½ Ⅷ"]
    return docs.unionByName(spark.createDataFrame([(t,) for t in more], "text string"))


@pytest.fixture(scope="module")
def library(corpus):
    tok = Tokenizer(BPE(unk_token=C.UNKNOWN))
    tok.pre_tokenizer = Whitespace()
    trainer = BpeTrainer(vocab_size=SIZE, min_frequency=2, special_tokens=list(C.SPECIAL_TOKENS), show_progress=False)
    tok.train_from_iterator([r["text"] for r in corpus.collect()], trainer)
    return tok


@pytest.fixture(scope="module")
def learned(corpus):
    return vocab.learn_merges(vocab.pretoken_counts(corpus), SIZE, 2)


def test_same_vocabulary_as_the_library(library, learned):
    tokens, merges = learned
    want = [tuple(m) for m in json.loads(library.to_str())["model"]["merges"]]
    assert [(a, b) for a, b, _ in merges] == want
    assert {t: i for i, t in enumerate(tokens)} == library.get_vocab()


def test_same_ids_as_the_library(spark, corpus, library, learned):
    odd = ["x<SOT>hello..<EOT> <pad>Z", "日本 unknown", "<<SOT>>", "<MASK><MASK>", "a\u0085b"]
    docs = corpus.unionByName(spark.createDataFrame([(t,) for t in odd], "text string"))
    encoder = vocab.word_encoder(spark, *learned)
    for r in docs.select("text", vocab.encode_text(encoder, F.col("text")).alias("ids")).collect():
        assert r["ids"] == library.encode(r["text"]).ids, r["text"][:80]


@pytest.mark.parametrize("hot_words", [20_000, 50, 1])
def test_same_ids_by_words(spark, corpus, learned, monkeypatch, hot_words):
    monkeypatch.setattr(vocab, "HOT_WORDS", hot_words)
    docs = corpus.withColumn("key", F.when(F.monotonically_increasing_id() > 0, F.monotonically_increasing_id()))
    docs = docs.unionByName(spark.createDataFrame([(None, -1), ("", -2)], "text string, key bigint")).cache()
    encoder = vocab.word_encoder(spark, *learned)
    words = vocab.encoded_words(vocab.pretoken_counts(docs, C.SPECIAL_TOKENS), encoder)
    got = {r["key"]: r["ids"] for r in vocab.encode_by_words(docs, words, "key", special=C.SPECIAL_TOKENS).collect()}
    want = docs.select("key", vocab.encode_text(encoder, F.col("text")).alias("ids")).collect()
    assert got == {r["key"]: r["ids"] for r in want} and len(want) > 200


def test_pad_is_needed(spark):
    with pytest.raises(ValueError):
        vocab.token_ids(["<unk>", "a"])


def test_special_tokens_are_cut_out(spark):
    df = spark.createDataFrame([("..<SOT>a<MASK> b<",)], "text string")
    def pieces(special):
        return df.select(vocab.pretokens(F.col("text"), special).alias("p")).first()["p"]
    assert pieces(C.SPECIAL_TOKENS) == ["..", "<SOT>", "a", "<MASK>", "b", "<"]
    assert pieces(()) == ["..<", "SOT", ">", "a", "<", "MASK", ">", "b", "<"]


def test_vocabulary_tables(spark, learned):
    tokens, merges = learned
    back = vocab.read_vocabulary(vocab.token_table(spark, tokens), vocab.merge_table(spark, merges))
    assert back == (tokens, merges)


def test_nothing_to_merge(spark):
    empty = spark.createDataFrame([], "word string, n bigint")
    assert vocab.learn_merges(empty, 100, 1, ["<pad>"]) == (["<pad>"], [])
    assert vocab.learn_merges(words_of(spark, {"a": 3, "": 2}), 100, 1, ["<pad>"]) == (["<pad>", "a"], [])


def test_a_very_long_word(spark):
    words = words_of(spark, {"ab": 3, "c" * 3000: 1})
    merges = vocab.learn_merges(words, 100, 1, [], max_merges=2, most_symbols=50)[1]
    assert merges == [("c", "c", 2999), ("cc", "cc", 1499)]


def test_distinct_words_are_asked_once():
    asked = []

    def of(word):
        asked.append(word)
        return [len(word)] * 2 if word != "c" else []

    words = pa.array(["a", "bb", "a", "c", "bb"])
    found = vocab._each_word(words, of, pa.int32())
    assert found.to_pylist() == [[1, 1], [2, 2], [1, 1], [], [2, 2]]
    assert asked == ["a", "bb", "c"]
    texts = pa.array([["a", "bb"], [], ["a", "c"], ["bb"]])
    ids = vocab._lists(texts, found.flatten(), pc.list_value_length(found))
    assert ids.to_pylist() == [[1, 1, 2, 2], [], [1, 1], [2, 2]]


def test_decoder(spark):
    names = vocab.token_table(spark, ["<pad>", "a", "bc"])
    rows = spark.createDataFrame([([[1, 2], [], [2, 9]],), (None,)], "x array<array<int>>")
    got = [r["t"] for r in rows.select(vocab.word_decoder(names)("x").alias("t")).collect()]
    assert got == [[["a", "bc"], [], ["bc"]], None]
    merged = spark.createDataFrame([([[1, 3], [2]],), ([[5, 4]],)], "x array<array<int>>")
    assert [r["m"] for r in merged.select(vocab.in_place_order(F.col("x")).alias("m")).collect()] == [[1, 2, 3], [5, 4]]


def test_places_are_not_shuffled_to_encode_by_words(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (None, "b zz"), (3, "zz q")], "key int, text string")
    words = spark.createDataFrame([("a", 60_000, [1, 2]), ("b", 1, [3]), ("zz", 2, [4])], "word string, n bigint, ids array<int>")
    coded = vocab.encode_by_words(docs, words, "key")
    got = {r["key"]: r["ids"] for r in coded.collect()}
    assert got == {1: [1, 2, 3, 1, 2], 2: [], None: [3, 4], 3: [4]}
    assert "posexplode" not in coded._jdf.queryExecution().optimizedPlan().toString()
