"""Pairing, ranking, splits and tasks."""

import pytest
from pyspark.sql import functions as F

from checks.build import pairs as pairs_of
from checks.build import texts as texts_of
from checks.build import triples as triples_of
from triplemill.functions.rdf import linearize
from triplemill.operators import pairing, ranking, tasks
from triplemill.operators.keyfilter import KeyFilter
from triplemill.plans.scratch import written

RAW = "film string, dir string, p string, o string, seq bigint"
TEXT = "film string, text string, seq bigint"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_incoming_edge_is_turned_round(spark):
    raw = spark.createDataFrame(
        [("Film A", "out", "hasGenre", "Drama", 0), ("Film A", "in", "won", "Festival", 1), ("Film A", None, "x", "y", 2)],
        RAW,
    )
    texts = spark.createDataFrame([("Film A", "Some intro.", 0)], TEXT)
    got = pairing.pair_records(pairing.directed(raw), texts, 1).first()
    assert [tuple(t) for t in got["triples"]] == [
        ("Film A", "hasGenre", "Drama"),
        ("Festival", "won", "Film A"),
        ("Film A", "x", "y"),
    ]
    assert got["n_triples"] == 3 and got["text"] == "Some intro."


def test_texts(spark):
    texts = spark.createDataFrame(
        [
            ("a", " first ", 0), ("a", "second", 1), ("a", "", 2), ("a", None, 3),
            ("b", "good", 0), ("b", "  ", 1),  # a blank text replaces the good one
            ("c", None, 0),
        ],
        TEXT,
    )
    assert rows(pairing.last_texts(texts), "film") == [("a", "second")]


def test_audit_counts_each_entity_once(spark):
    raw = spark.createDataFrame(
        [(f, "out", "p", str(i), i) for f, n in (("a", 3), ("b", 2), ("c", 1)) for i in range(n)]
        + [("b", "out", "p", "0", 9)],
        RAW,
    )
    texts = spark.createDataFrame([("a", "t", 0), ("b", "t", 0), ("z", "t", 0)], TEXT)
    flags = pairing.pair_flags(pairing.directed(raw), texts, 3)
    assert pairing.pairing_audit(flags).first().asDict() == {"kept": 1, "no_text": 1, "few_triples": 1}


def test_without_deduplication(spark):
    raw = spark.createDataFrame([("a", "out", "p", "o", i) for i in range(3)], RAW)
    texts = spark.createDataFrame([("a", "t", 0)], TEXT)
    both = [
        pairing.pair_records(pairing.directed(raw), texts, 1, deduplicate=d).first()["n_triples"]
        for d in (True, False)
    ]
    assert both == [1, 3]


def test_hot_entities_give_the_same_records(spark, sf):
    tri, txt = triples_of(spark, sf), texts_of(spark, sf)
    direct = rows(pairing.pair_records(tri, txt, 1), "film")
    assert direct == rows(pairing.pair_records(tri, txt, 1, hot_rows=28, chunk=5), "film")
    assert ranking.hot_keys(tri, ["film"], 28) is not None


def test_one_entity_with_a_third_of_all_rows(spark):
    n = 30_000
    raw = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "hub").otherwise(F.concat(F.lit("f"), F.col("id"))).alias("film"),
        F.lit("out").alias("dir"),
        F.concat(F.lit("p"), F.col("id") % 7).alias("p"),
        F.col("id").cast("string").alias("o"),
        (n - F.col("id")).alias("seq"),
    )
    texts = raw.select("film", F.lit("t").alias("text"), "seq").distinct()
    got = pairing.pair_records(pairing.directed(raw), texts, 1, hot_rows=1000, chunk=700)
    hub = got.where("film = 'hub'").first()
    assert [t["o"] for t in hub["triples"]] == [str(i) for i in range(n - 3, -1, -3)]
    assert got.count() == 1 + n - n // 3


def test_rank_within_is_a_row_number(spark, sf):
    tri = triples_of(spark, sf)
    order = ["seq", "film", "p", "o", "s"]
    got = ranking.rank_within(tri, ["p"], order, "r")
    assert got.where("r < 1").count() == 0
    direct = tri.selectExpr(
        "*", "cast(row_number() over (partition by p order by seq, film, p, o, s) as bigint) as r"
    )
    assert got.select(*direct.columns).exceptAll(direct).count() == 0
    everything = ranking.rank_within(tri, [], order, "r")
    assert rows(everything.agg(F.min("r"), F.max("r"), F.count_distinct("r")), 1) == [
        (1, tri.count(), tri.count())
    ]


@pytest.mark.parametrize("n", [0, 1, 2, 9, 10, 57, 5000])
def test_split_sizes_are_exact(spark, n):
    films = spark.range(n).select(F.concat(F.lit("f"), "id").alias("film"))
    cuts = ranking.split_cuts(films)
    got = {r["s"]: r["count"] for r in films.groupBy(ranking.split_of("film", cuts).alias("s")).count().collect()}
    train, val = int(n * 0.8), int(n * 0.1)
    want = {"train": train, "val": val, "test": n - train - val}
    assert got == {k: v for k, v in want.items() if v}


def test_split_depends_on_the_seed_only(spark):
    films = spark.range(300).select(F.col("id").cast("string").alias("film"))
    def split(df, seed):
        cuts = ranking.split_cuts(df, seed=seed)
        return rows(df.select("film", ranking.split_of("film", cuts, seed).alias("s")), "film")
    assert split(films, 13) == split(films.repartition(7), 13) == split(films.coalesce(1), 13)
    assert split(films, 13) != split(films, 14)


def test_results_do_not_depend_on_partitions(spark, sf):
    def run(partitions):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            return rows(tasks.task_examples(pairs_of(spark, sf)), "film", "task")
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")

    assert run("1") == run("8")


PAIR = "film string, text string, triples array<struct<s:string,p:string,o:string>>"


def test_examples_of_one_pair(spark):
    df = spark.createDataFrame(
        [("f", " A text. ", [("f", "q", "2"), ("f", "p", "1"), ("f", "r", "3")]), ("g", "t", [("g", "p", "o")]), ("h", "t", [])],
        PAIR,
    )
    got = {(r["film"], r["task"]): (r["input"], r["target"]) for r in tasks.task_examples(df).collect()}

    def line(*items):
        return " ".join(f"<SOT> <SUBJ> f <PRED> {p} <OBJ> {o} <EOT>" for p, o in items)

    whole = line(("p", "1"), ("q", "2"), ("r", "3"))
    assert got["f", "text2rdf"] == ("A text. <Text2RDF>", whole)
    assert got["f", "rdf2text"] == (whole + " <RDF2Text>", "A text.")
    # one of three in arrival order is the context
    assert got["f", "rdfcomp2"] == (line(("q", "2")) + " <CONTINUERDF>", line(("p", "1"), ("r", "3")))
    hidden = got["f", "rdfcomp1"][1]
    assert got["f", "rdfcomp1"][0] == whole.replace(hidden, "<MASK>", 1) + " <MASK>"
    assert ("g", "rdfcomp2") not in got and ("h", "rdfcomp1") not in got
    assert got["h", "rdf2text"] == (" <RDF2Text>", "t")


@pytest.mark.parametrize("n, context", [(4, 2), (7, 4), (143, 85), (3, 1), (151, 90), (1, 1), (5, 3)])
def test_context_size(spark, n, context):
    assert spark.range(1).select(tasks.cut_size(F.lit(n))).first()[0] == context


def test_masked_object_mode(spark):
    df = spark.createDataFrame([("f", "t", [("ab", "p", "a")])], PAIR)
    def masked(mode):
        return tasks.task_examples(df, ["rdfcomp1"], mode=mode).first()["input"]
    assert masked("text") == "<SOT> <SUBJ> <MASK>b <PRED> p <OBJ> a <EOT> <MASK>"
    assert masked("object") == "<SOT> <SUBJ> ab <PRED> p <OBJ> <MASK> <EOT> <MASK>"


def test_choice_is_uniform(spark):
    items = [("s", "p", str(i)) for i in range(4)]
    df = spark.range(4000).select(
        F.col("id").cast("string").alias("film"),
        F.array(*(F.struct(F.lit(s).alias("s"), F.lit(p).alias("p"), F.lit(o).alias("o")) for s, p, o in items)).alias("triples"),
    )
    got = df.groupBy(tasks.random_triple(F.col("triples"), F.col("film"), 13)["o"].alias("o")).count()
    assert all(900 < r["count"] < 1100 for r in got.collect())


def test_long_form_gives_the_same(spark, sf):
    tri = pairing.distinct_triples(triples_of(spark, sf))
    parts = tasks.line_parts(tri, chunk=4)
    assert parts.groupBy("film").agg(F.max("part").alias("m")).where("m > 1").count() > 0
    whole = parts.groupBy("film").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "line"))), lambda x: x["line"]), " ").alias("line")
    )
    records = pairing.triples_by_film(triples_of(spark, sf))
    assert rows(whole, "film") == rows(records.select("film", linearize(F.col("items")).alias("line")), "film")
    picked = tasks.random_triple(F.col("items"), F.col("film"), 13)
    assert rows(tasks.random_triples(tri), "film") == rows(
        records.select("film", picked.alias("t")).select("film", "t.s", "t.p", "t.o"), "film"
    )


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairing_shuffles_triples_once(spark, sf):
    grouped = plan(pairing.triples_by_film(triples_of(spark, sf)))
    assert grouped.count("Exchange") == 1
    assert "SinglePartition" not in plan(tasks.task_examples(pairs_of(spark, sf)))


def test_triples_without_text_are_not_shuffled(spark, sf):
    """One exchange of triples, and only of those whose entity may have a text."""
    tri, txt = triples_of(spark, sf), texts_of(spark, sf).where("film rlike '[0-4]$'")
    wanted, hot, left_out, _ = pairing.wanted_triples(tri, txt)
    with_text = tri.join(txt.select("film").distinct(), "film", "left_semi")
    assert hot is None and with_text.count() <= wanted.count() < 0.8 * tri.count()
    assert with_text.exceptAll(wanted).count() == 0
    films = tri.select("film").distinct()
    assert left_out == films.count() - wanted.select("film").distinct().count() > 0
    grouped = plan(pairing._by_film(wanted, hot, 50, True))
    assert grouped.count("Exchange hashpartitioning") == 1 and "BroadcastExchange" in grouped
    assert grouped.count("BroadcastHashJoin") == 1


def test_audit_is_observed_in_one_pass(spark, sf):
    tri, txt = triples_of(spark, sf), texts_of(spark, sf).where("film rlike '[0-4]$'")
    want = pairing.pairing_audit(pairing.pair_flags(tri, txt, 25)).first()
    for hot_rows in (10**6, 28):
        made, audit, _ = pairing.audited_records(tri, txt, 25, hot_rows)
        if hot_rows > 28:
            # Triples, and texts: nothing is shuffled twice for the audit.
            assert plan(made).count("Exchange hashpartitioning") == 2
        kept = written(made)
        assert audit().first() == want and want["no_text"] > 0
        assert rows(kept, "film") == rows(pairing.pair_records(tri, txt, 25), "film")


def test_audit_of_odd_entities(spark):
    raw = spark.createDataFrame(
        [(f, "out", "p", str(i), i) for f, n in (("a", 3), ("b", 2), ("c", 1), (None, 4), ("", 1)) for i in range(n)], RAW
    )
    for texts in ([("a", "t", 0), ("b", "t", 0), ("z", "t", 0), (None, "t", 0), ("c", " ", 1)], []):
        table = spark.createDataFrame(texts, TEXT)
        tri = pairing.directed(raw)
        made, audit, _ = pairing.audited_records(tri, table, 3)
        assert written(made).count() == len(texts[:1])
        assert audit().first() == pairing.pairing_audit(pairing.pair_flags(tri, table, 3)).first()
    made, audit, _ = pairing.audited_records(tri.limit(0), table, 3)
    assert written(made).count() == 0 and tuple(audit().first()) == (0, 0, 0)


def test_key_filter(spark):
    """Never holds a key back; lets few others through unless it is far too small."""
    keys = spark.range(0, 200_000).select(F.concat(F.lit("k"), "id").alias("key"))
    keys = keys.unionByName(spark.createDataFrame([(None,), ("",)], "key string"))
    rows = spark.range(0, 400_000).select(F.concat(F.lit("k"), "id").alias("key"), "id").unionByName(
        spark.createDataFrame([(None, 0), ("", 1)], "key string, id bigint")
    )
    for most_blocks, let_through in ((16_384, 0.08), (7, 1.0)):
        found = KeyFilter(keys, "key", most_blocks).marked(rows, "key", "may")
        n = {(r["own"], r["may"]): r["count"] for r in found.groupBy((F.col("id") < 200_000).alias("own"), "may").count().collect()}
        assert (True, False) not in n and n[True, True] == 200_002
        assert n.get((False, True), 0) <= let_through * 200_000
    assert KeyFilter(keys.limit(0), "key").marked(rows, "key", "may").where("may").count() == 0


def test_filter_blocks_are_words(spark):
    keys = spark.range(1000).selectExpr("concat('k', id) as key")
    rows = KeyFilter(keys, "key", 4).table.collect()
    # As many bits as keys have, less those that meet.
    assert [len(r["_bitmap"]) for r in rows] == [512]
    assert 1900 < sum(int(w & (2**64 - 1)).bit_count() for r in rows for w in r["_bitmap"]) <= 2000


def test_one_layout_serves_flags_and_parts(spark):
    rows = spark.createDataFrame(
        [(f, f, "p", str(i), i) for f in ("a", "b") for i in range(5)] + [("c", "c", "p", "o", 0), (None, "d", "p", "o", 0)] * 2,
        "film string, s string, p string, o string, seq bigint",
    )
    made = {}
    for name, hot in (("none", None), ("hot", spark.createDataFrame([("b",)], "film string"))):
        laid = ranking.laid_by(rows, ["film"], hot, rows.count())
        flags = tasks.context_flags(pairing.distinct_triples(laid), hot)
        parts = tasks.line_parts(flags, ("film", "in_context"), 2, hot)
        if hot is None:
            assert parts._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
        made[name] = sorted(parts.collect())
    assert made["none"] == made["hot"]
    assert [(r["film"], r["in_context"], r["part"]) for r in made["none"]] == [
        (f, c, p) for f in ("a", "b") for c, p in ((False, 0), (True, 0), (True, 1))
    ]
