"""Triples of entities without a text are passed over when pairs are made."""

from pyspark.sql import functions as F

from triplemill.operators import keyfilter, pairing


def test_pairs_pass_over_triples_without_a_text(spark, monkeypatch):
    tri = spark.createDataFrame(
        [(f, f, "p", f"o{i}", i) for f in ("a", "b", None, "c") for i in range(3)],
        "film string, s string, p string, o string, seq bigint",
    )
    tri = tri.unionByName(tri.withColumn("o", F.upper("o")))
    txt = spark.createDataFrame([("a", "x", 0), ("a", "y", 1), (None, "z", 0), ("d", "z", 0)], "film string, text string, seq bigint")
    found = pairing.wanted_triples(tri, txt, audit=False)
    assert found.left_out is None and found.hot is None
    want = [tuple(r) for r in tri.where("film = 'a' or film is null").collect()]
    assert sorted(map(tuple, found.rows.collect()), key=repr) == sorted(want, key=repr)
    # Rows are held back before the branches of the union are made.
    plan = found.rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union") and plan.count("LeftSemi") == 2
    assert pairing.wanted_triples(tri, txt, hot_rows=5, audit=False).hot.count() == 2
    assert [r["film"] for r in pairing.pair_records(tri, txt, 3).collect()] == ["a"]
    # More keys are tested in bitmaps.
    monkeypatch.setattr(keyfilter, "FEW_KEYS", 2)
    more = pairing.wanted_triples(tri, txt, audit=False).rows
    assert sorted(map(tuple, more.collect()), key=repr) == sorted(want, key=repr)
    assert more.columns == found.rows.columns == tri.columns
