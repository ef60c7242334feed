"""Files, and the jobs that read and write them."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F

from checks.scores import every, log
from checks.views import spark_view
from triplemill.operators import extract, pairing
from triplemill.plans import jobs, publish, scratch
from triplemill.sources import jsonl


def put(path, lines, opener=open):
    with opener(path, "wt", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")
    return str(path)


def test_blank_lines_and_gzip(spark, tmp_path):
    lines = ['{"film": "a", "text": "é"}', "", "   ", '{"film": "b"}']
    plain = put(tmp_path / "x.jsonl", lines)
    packed = put(tmp_path / "x.jsonl.gz", lines, gzip.open)
    for path in (plain, packed):
        rows = jsonl.read_jsonl(spark, path, jsonl.RAW_TEXTS).collect()
        assert [tuple(r) for r in rows] == [("a", "é"), ("b", None)]


def test_malformed_lines(spark, tmp_path):
    path = put(tmp_path / "x.jsonl", ['{"film": "a", "text": "1"}', '{"film": "b", "te', "nonsense"])
    with pytest.raises(Exception):
        jsonl.read_jsonl(spark, path, jsonl.RAW_TEXTS).collect()
    assert [tuple(r) for r in jsonl.read_cache(spark, path).collect()] == [("a", "1")]


def test_last_cached_text_wins(spark, tmp_path):
    path = put(
        tmp_path / "x.jsonl",
        ['{"film":"a","text":"1"}', '{"film":"a","text":"2"}', '{"film":"a","text":""}', '{"film":"","text":"x"}'],
    )
    assert [tuple(r) for r in jsonl.read_cache(spark, path).collect()] == [("a", "2")]


def test_arrival_order(spark, tmp_path):
    # By time first, then by name.
    for name, time in (("c", 1000), ("b", 2000), ("a", 2000)):
        path = tmp_path / f"{name}.jsonl"
        put(path, [json.dumps({"film": f"{name}{i}", "text": "t" * 50}) for i in range(20)])
        os.utime(path, (time, time))
    rows = jsonl.read_jsonl(spark, str(tmp_path), jsonl.RAW_TEXTS, arrival=True).orderBy("seq").collect()
    assert [r["film"] for r in rows] == [f"{n}{i}" for n in "cab" for i in range(20)]


def test_nulls_are_written(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", "ü\n")], "film string, text string")
    jsonl.write_jsonl(df, str(tmp_path / "out"))
    lines = [line for p in (tmp_path / "out").glob("*.json") for line in p.read_text().splitlines()]
    assert sorted(lines) == ['{"film":"a","text":null}', '{"film":"b","text":"ü\\n"}']


def test_examples(spark, tmp_path):
    path = put(
        tmp_path / "rdfcomp1.train.jsonl",
        ['{"film":"f","input":"i","target":"t"}', '{"id":"7","film":"f","task":"mine"}', '{"input":"x"}'],
    )
    rows = jsonl.read_examples(spark, path).orderBy("seq").collect()
    assert [(r["id"], r["task"], r["input"], r["target"]) for r in rows] == [
        ("f", "rdfcomp1", "i", "t"), ("7", "mine", "", ""), ("2", "rdfcomp1", "x", "")
    ]


class Session:
    """Stands for a session with or without a named folder."""

    def __init__(self, master, named=None):
        self.master, self.folder = master, named
        self.conf, self.sparkContext = self, self

    def get(self, key, default):
        return self.folder if key == "spark.checkpoint.dir" else default

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_shared_folder(spark):
    assert scratch.shared_folder(Session("spark://host", "s3://bucket/x")) == "s3://bucket/x"
    with pytest.raises(RuntimeError):
        scratch.shared_folder(Session("spark://host"))
    local = Session("local[8]")
    assert scratch.shared_folder(local) == local.folder == scratch.shared_folder(local)
    named = spark.conf.get(scratch.SETTING, None)
    path = scratch.written(spark.range(5)).inputFiles()[0]
    assert named is None or named.rstrip("/") in path


@pytest.fixture(scope="module")
def built(spark, sf, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("built"))
    pairs = jobs.build_dataset(
        spark_view(spark, sf, "raw_triples"), spark_view(spark, sf, "raw_texts"), out,
        min_triples=12, normalize_prefixes=True,
    )
    return out, pairs


def test_build(spark, built):
    out, pairs = built
    n = pairs.count()
    examples = jobs.read_tasks(spark, out)
    counts = {r["task"]: r["count"] for r in examples.groupBy("task").count().collect()}
    assert counts == dict.fromkeys(("text2rdf", "rdf2text", "rdfcomp1", "rdfcomp2"), n)
    audit = spark.read.json(f"{out}/audit").first()
    assert audit["kept"] == n and audit["no_text"] + audit["few_triples"] > 0
    # an entity is in one split only
    assert examples.groupBy("film").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0
    lists = jsonl.read_jsonl(spark, f"{out}/splits", "film string, split string")
    assert lists.count() == n == lists.select("film").distinct().count()
    stored = jsonl.read_jsonl(spark, f"{out}/pairs", jsonl.PAIRS)
    assert stored.where("size(triples) <> n_triples or size(triples[0]) <> 3").count() == 0


def tables(spark):
    folder = scratch.shared_folder(spark).rstrip("/") + "/tables"
    return set(scratch.files(spark, folder).names(folder))


def test_jobs_leave_no_tables_behind(spark, sf, tmp_path):
    before = tables(spark)
    raw = spark_view(spark, sf, "raw_triples"), spark_view(spark, sf, "raw_texts")
    pairs = jobs.build_dataset(*raw, str(tmp_path / "a"), min_triples=12, emit_tasks=False)
    assert tables(spark) == before and pairs.count() > 0
    assert pairs.schema["triples"].dataType.simpleString() == "array<struct<s:string,p:string,o:string>>"
    assert pairs.where("size(triples) <> n_triples or triples[0].s is null or split is null").count() == 0
    docs = spark.createDataFrame([("low lower new low",)], "text string")
    jobs.train_vocabulary(docs, str(tmp_path / "v"), 20)
    assert tables(spark) == before
    with pytest.raises(ZeroDivisionError), scratch.dropped(spark):
        with scratch.dropped(spark):
            scratch.written(spark.range(3))
        assert len(tables(spark)) == len(before) + 1
        raise ZeroDivisionError
    assert tables(spark) == before


@pytest.mark.parametrize("max_tokens", [None, 400])
def test_entities_in_parts_are_the_same(spark, tmp_path, max_tokens):
    """Put end to end, what is written in parts equals the rows of whole entities."""
    sf = "/root/testdata/sf0.01"  # its entities have up to 41 distinct triples
    raw = spark_view(spark, sf, "raw_triples"), spark_view(spark, sf, "raw_texts").where("film rlike '[0-6]$'")
    outs = [str(tmp_path / name) for name in ("whole", "parts")]
    jobs.build_dataset(*raw, outs[0], min_triples=25, max_tokens=max_tokens)
    jobs.build_dataset(*raw, outs[1], min_triples=25, max_tokens=max_tokens, long_rows=30)
    assert not (tmp_path / "whole" / "pairs_in_parts").exists()
    ordered = lambda df: sorted(map(tuple, df.collect()), key=repr)

    def read(kind, name, schema):
        path = f"{outs[kind == 'parts']}/{name}"
        return jsonl.read_jsonl(spark, path, schema)

    audits = [spark.read.json(f"{out}/audit").first() for out in outs]
    assert audits[0] == audits[1] and audits[0]["no_text"] > 0
    lists = "film string, split string"
    assert ordered(read("whole", "splits", lists)) == ordered(read("parts", "splits", lists))

    pairs = "film string, split string, text string, n_triples int, triples array<array<string>>"
    own = read("parts", "pairs_in_parts", pairs + ", part int")
    assert own.agg(F.max("part")).first()[0] >= 1 and own.where("size(triples) > 30").count() == 0
    whole = own.groupBy("film", "split").agg(
        F.max("text").alias("text"),
        F.max("n_triples").alias("n_triples"),
        F.flatten(F.sort_array(F.collect_list(F.struct("part", "triples")))["triples"]).alias("triples"),
    )
    both = whole.unionByName(read("parts", "pairs", pairs))
    assert 0 < whole.count() < both.count()
    assert ordered(both.select(*whole.columns)) == ordered(read("whole", "pairs", pairs).select(*whole.columns))

    tasks = "film string, task string, split string, input string, target string"
    pieces = read("parts", "tasks_in_parts", tasks + ", part int")
    end_to_end = lambda c: F.array_join(F.sort_array(F.collect_list(F.struct("part", c)))[c], "").alias(c)
    joined = pieces.groupBy("film", "task", "split").agg(end_to_end("input"), end_to_end("target"))
    names = joined.columns
    both = joined.unionByName(read("parts", "tasks", tasks)).select(*names)
    assert ordered(both) == ordered(read("whole", "tasks", tasks).select(*names))
    assert joined.select("task").distinct().count() == 4


def test_folders_appear_together(spark, tmp_path):
    out = str(tmp_path / "out")
    def put_both(n, fails=False):
        with publish.published(spark, out) as stage:
            spark.range(n).write.parquet(f"{stage}/one")
            if fails:
                raise ZeroDivisionError
            spark.range(n).write.parquet(f"{stage}/two")
            assert n == 3 or not publish.is_complete(spark, out) or spark.read.parquet(f"{out}/two").count() == 3
    def sizes():
        return [spark.read.parquet(f"{out}/{name}").count() for name in ("one", "two")]
    put_both(3)
    assert sizes() == [3, 3] and publish.is_complete(spark, out)
    with pytest.raises(ZeroDivisionError):
        put_both(5, fails=True)
    assert sizes() == [3, 3] and publish.is_complete(spark, out)
    put_both(7)
    assert sizes() == [7, 7]
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")) == ["_COMPLETE", "one", "two"]
    assert json.loads((tmp_path / "out" / "_COMPLETE").read_text()) == ["one", "two"]


def test_subset(spark, built, tmp_path):
    out, pairs = built
    chosen = jobs.build_subset(pairs, jobs.read_tasks(spark, out), str(tmp_path / "toy"), 20)
    per_split = {r["split"]: r["count"] for r in chosen.groupBy("split").count().collect()}
    assert sum(per_split.values()) == 20 and per_split["val"] == per_split["test"] == 4
    manifest = json.loads(spark.read.text(str(tmp_path / "toy" / "manifest")).first()[0])
    assert manifest["total_films"] == 20 and manifest["tasks"]["rdfcomp1"] == per_split
    assert manifest["per_split"]["val"] == sorted(manifest["per_split"]["val"])


def test_vocabulary(spark, built, tmp_path):
    out, _ = built
    docs = jsonl.corpus(jobs.read_tasks(spark, out).where("split = 'test'"))
    made = jobs.train_vocabulary(docs, str(tmp_path / "v"), 130)
    assert jobs.load_vocabulary(spark, str(tmp_path / "v")) == made


def test_evaluation(spark, sf, tmp_path):
    rep = jobs.evaluate(every(spark, sf), log(spark, sf), str(tmp_path / "r"))
    text = json.loads(spark.read.text(str(tmp_path / "r" / "json")).first()[0])
    assert set(text["splits"]) == {"val", "test"}
    assert rep.where("metric = 'accuracy' and task = 'rdfcomp1'").count() == 2


def test_collection_is_resumed(spark, sf, tmp_path):
    raw = spark_view(spark, sf, "raw_triples")
    cache = str(tmp_path / "cache")
    films = extract.first_seen(raw, 50)
    answers = films.select(
        "film",
        F.when(F.col("film").endswith("1"), None).otherwise("text").alias("text"),
        F.when(F.col("film").endswith("1"), 404).otherwise(200).alias("status"),
        F.lit("u").alias("url"),
    )
    known = films.where(F.col("film").endswith("2")).select("film", F.lit("old").alias("text"))
    jsonl.write_jsonl(known, cache)
    first = jobs.collect_texts(raw, answers, cache, str(tmp_path / "o1"), 50).first().asDict()
    old, bad = known.count(), answers.where("status = 404").count()
    assert first == {"requested": 50, "cache_hits": old, "ok": 50 - old - bad, "failed": bad, "written": 50 - bad}
    failures = jsonl.read_jsonl(spark, str(tmp_path / "o1" / "failures"), jsonl.FAILURES)
    assert failures.where("status = 404 and title like 'Part %'").count() == bad
    again = jobs.collect_texts(raw, answers, cache, str(tmp_path / "o2"), 50).first()
    assert again["cache_hits"] == 50 - bad and again["ok"] == 0
    texts = jsonl.read_jsonl(spark, str(tmp_path / "o2" / "texts"), jsonl.RAW_TEXTS)
    assert texts.count() == 50 - bad and texts.where("text = 'old'").count() == old


EDGE = "s string, p string, o string"


def test_neighbourhood(spark):
    kind, film = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://dbpedia.org/ontology/Film"
    r, o = "http://dbpedia.org/resource/", "http://dbpedia.org/ontology/"
    edges = spark.createDataFrame(
        [(r + "F", kind, film), (r + "F", o + "genre", "Drama"), (r + "F", o + "other", "x"), (r + "P", o + "genre", r + "F"), (r + "P", o + "genre", "y")],
        EDGE,
    )
    got = {tuple(x) for x in extract.neighbourhood(edges, film, [o + "genre"], "both").collect()}
    assert got == {("dbr:F", "out", "dbo:genre", "Drama"), ("dbr:F", "in", "dbo:genre", "dbr:P")}
    assert extract.neighbourhood(edges, film, [o + "genre"]).count() == 1
    # short names stand for whole ones; genre is on the default list
    assert extract.neighbourhood(edges, "dbo:Film").collect()[0]["p"] == "dbo:genre"


def test_whitelist_reaches_the_scan(spark, sf):
    tri = spark.read.parquet(f"{sf}/lineitem.parquet").selectExpr("cast(l_orderkey as string) s", "l_returnflag p", "l_linestatus o")
    plan = extract.allowed(tri, ["A", "R"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(l_returnflag, [A,R])]" in plan
    assert pairing.ARRIVAL[0] == "seq"


def test_last_append_wins_and_a_missing_cache_is_empty(spark, tmp_path):
    path = str(tmp_path / "cache")
    assert jsonl.read_cache(spark, path).count() == 0
    for text in ("old", "newer", "newest"):
        rows = spark.createDataFrame([("a", text), ("b", text)], "film string, text string")
        jsonl.write_jsonl(rows.repartition(2, "film"), path, append=True)
    assert sorted(tuple(r) for r in jsonl.read_cache(spark, path).collect()) == [("a", "newest"), ("b", "newest")]


def test_appends_are_ordered_by_their_names(spark, tmp_path):
    """Times of files may be equal or wrong; what other writers left comes first."""
    path = tmp_path / "cache"
    for text in ("b", "c", "a"):
        jsonl.write_jsonl(spark.createDataFrame([("f", text)], "film string, text string"), str(path), append=True)
    put(path / "other.jsonl", ['{"film": "f", "text": "z"}', '{"film": "g", "text": "y"}'])
    for i, file in enumerate(sorted(path.rglob("*.json*"), reverse=True)):
        os.utime(file, (1000, 1000 if i < 2 else 9000))
    assert sorted(tuple(r) for r in jsonl.read_cache(spark, str(path)).collect()) == [("f", "a"), ("g", "y")]


def test_line_numbers_do_not_depend_on_the_reading_tasks(spark, tmp_path):
    path = tmp_path / "text2rdf.train.jsonl"
    path.write_text("".join(f'{{"input": "{"x" * 20}", "target": "{i}"}}\n' for i in range(3000)))
    (tmp_path / "text2rdf.val.jsonl").write_text("\n\n".join(f'{{"target": "{i}"}}' for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("16k", "1m", old):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = jsonl.read_examples(spark, str(tmp_path))
            rows = found.select("id", "target").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert len(rows) == 3500 and all(r["id"] == r["target"] for r in rows)
        # Only the table of blocks is shuffled.
        text = found._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in text and text.count("Exchange hashpartitioning") <= 2
        assert "BroadcastHashJoin" in text


def test_manifest_lists_empty_splits(spark):
    import json

    from triplemill.operators import subset

    chosen = spark.createDataFrame([("train", "f")], "split string, film string")
    counts = subset.subset_counts(spark.createDataFrame([], "task string, split string"))
    text = json.loads(subset.manifest_json(chosen, counts, "from/here").first()[0])
    assert text["per_split"] == {"train": ["f"], "val": [], "test": []}
    assert text["total_films"] == 1 and text["source_processed_dir"] == "from/here"


def test_a_weighted_task_without_examples_is_an_error(spark):
    import pytest

    from triplemill.operators import batching

    one = spark.createDataFrame([("1", "text2rdf")], "id string, task string")
    with pytest.raises(ValueError, match="without examples"):
        batching.weighted_mix(one)
