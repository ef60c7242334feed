"""Pre-tokens cut in Arrow, against the pattern."""

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from triplemill import constants as C
from triplemill.functions import cutting
from triplemill.operators import batching, vocab

TEXTS = [
    None, "", " ", "a", "..", "a_b c-d", "x<SOT>hello..<EOT> <pad>Z", "<<SOT>>", "<SO", "T> <SOT", "><MASK><MASK>",
    "日本 语é𝐀𝐀x😀😀.½Ⅷ‿‍ á", "\x0b\x1c\x85\xa0 a　", "dbr:Foo_1 dbo:é\x00", "<SOT<SOT>>", "aabaab ab",
]
SPECIALS = [(), C.SPECIAL_TOKENS, ("<SO", "<SOT>", "OT>", "T><", "aa", "aab", "ba"), ("本", "日本")]


def by_pattern(df, special):
    return [r["p"] for r in df.select(vocab.pretokens(F.col("text"), special).alias("p")).collect()]


def cut(texts, kinds, special):
    found = []
    for words, sizes in cutting.cut_texts(texts, kinds, special):
        words = iter(words.to_pylist())
        found += [[next(words) for _ in range(n)] for n in sizes.tolist()]
    return found


@pytest.mark.parametrize("slice_bytes", [1, 30, 1 << 21])
@pytest.mark.parametrize("special", SPECIALS)
def test_same_pretokens_as_the_pattern(spark, monkeypatch, special, slice_bytes):
    monkeypatch.setattr(cutting, "SLICE", slice_bytes)
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    kinds = cutting.character_kinds(spark)
    assert cut(pa.array(TEXTS), kinds, special) == by_pattern(df, special)
    # A part of a longer column.
    assert cut(pa.array(TEXTS)[3:9], kinds, special) == by_pattern(df, special)[3:9]


def test_every_character_has_the_kind_of_the_pattern(spark):
    chars = spark.range(1, 0x30000).where("id not between 55296 and 57343")
    row = chars.select(F.array_join(F.collect_list(cutting.character(F.col("id"))), "").alias("text"))
    text = row.first()["text"]
    assert cut(pa.array([text]), cutting.character_kinds(spark), ()) == by_pattern(row, ())


@pytest.mark.parametrize("special", [(), C.SPECIAL_TOKENS, ("b c",)])
def test_words_are_counted_before_they_are_rows(spark, special):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, "a b c b c"] * 3], "text string")
    counts = vocab.pretoken_counts(df, special)
    want = Counter(w for words in by_pattern(df, special) for w in words)
    assert {r["word"]: r["n"] for r in counts.collect()} == want
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert ("Generate explode" in plan) == (special == ("b c",))


@pytest.mark.parametrize("special", [C.SPECIAL_TOKENS, ("b c",)])
@pytest.mark.parametrize("most", [None, 3, 1])
def test_texts_are_encoded_as_their_words(spark, special, most):
    words = spark.createDataFrame([("ab", 9), ("hello", 4), ("a", 3)], "word string, n bigint")
    encoder = vocab.word_encoder(spark, *vocab.learn_merges(words, 30, 2))
    df = spark.createDataFrame([(TEXTS,), ([],), (None,), ([None, "ab hello b c"],)], "texts array<string>")
    got = df.select(encoder.texts(F.col("texts"), special, most).alias("ids")).collect()
    pieces = F.transform("texts", lambda t: vocab.pretokens(t, special))
    want = df.select(encoder(pieces).alias("ids")).collect()
    assert [r["ids"] for r in got] == [r["ids"] and [i[:most] for i in r["ids"]] for r in want]


def test_examples_are_cut_without_the_pattern(spark):
    words = spark.createDataFrame([("dbr", 9), ("Foo", 9), (":", 9)], "word string, n bigint")
    tokens, merges = vocab.learn_merges(words, 100, 2)
    df = spark.createDataFrame([("1", "rdf2text", "dbr:Foo " * 9, None)], "film string, task string, input string, target string")
    coded = batching.encoded_examples(df, vocab.word_encoder(spark, tokens, merges), tokens, 4, with_spans=True)
    row, end = coded.first(), tokens.index(C.END)
    assert row["input_ids"] == [tokens.index(t) for t in ("dbr", ":", "Foo")] + [end] and row["labels"] == [end]
    assert vocab.C.PRETOKEN not in coded._jdf.queryExecution().optimizedPlan().toString()


def test_a_mention_longer_than_the_row_is_left_out(spark):
    words = spark.createDataFrame([("dbr", 9), (":", 9), ("a", 9), ("-", 9)], "word string, n bigint")
    tokens, merges = vocab.learn_merges(words, 100, 2)
    target = "dbr:a-a-a-a"
    df = spark.createDataFrame([("1", "rdf2text", "a", target)], "film string, task string, input string, target string")
    encoder = vocab.word_encoder(spark, tokens, merges)
    spans = lambda n: batching.encoded_examples(df, encoder, tokens, n, with_spans=True).first()["spans"]
    assert [len(spans(n)) for n in (1, 2, 4, 9, 10, 20)] == [0, 0, 0, 0, 1, 1]
