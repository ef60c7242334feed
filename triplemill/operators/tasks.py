"""The four sequence-to-sequence datasets made from pairs."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triplemill import constants as C
from triplemill.functions.arrays import SEP, bind
from triplemill.functions.rdf import fragment, linearize, mask_first, mask_object
from triplemill.functions.text import strip, tokens
from triplemill.operators.pairing import ARRIVAL
from triplemill.operators.ranking import CHUNK, hot_keys, ranked_rows, seeded_hash
from triplemill.plans.scratch import written


def random_triple(triples, film, seed: int):
    """One triple, uniform for a seed: the one with the smallest hash."""
    keyed = F.transform(
        triples,
        lambda t: F.struct(
            F.md5(F.concat_ws(SEP, film, t["s"], t["p"], t["o"], F.lit(str(seed)))).alias("h"),
            t["s"].alias("s"),
            t["p"].alias("p"),
            t["o"].alias("o"),
        ),
    )
    return F.array_min(keyed)


def cut_size(n):
    """Number of triples that form the context of a continuation."""
    return F.greatest(F.lit(1), F.floor(F.lit(0.6) * n.cast("double")).cast("int"))


def _example(task, given, wanted):
    return F.struct(
        F.lit(task).alias("task"),
        F.concat(given, F.lit(" " + C.TASK_MARKERS[task])).alias("input"),
        wanted.alias("target"),
    )


def text_to_triples(text, line):
    return _example("text2rdf", strip(text), line)


def triples_to_text(text, line):
    return _example("rdf2text", line, strip(text))


def masked_completion(film, triples, line, seed=C.SPLIT_SEED, mask=C.MASK, mode="text"):
    """Hide the object of one random triple; NULL without triples.

    ``mode="text"`` hides the first place the object's text occurs in the line,
    ``mode="object"`` the object of that triple itself.
    """

    def hidden(chosen):
        if mode == "object":
            given = mask_object(triples, chosen, mask)
        else:
            given = mask_first(line, chosen["o"], mask)
        return _example("rdfcomp1", given, chosen["o"])

    return F.when(F.size(triples) > 0, bind(random_triple(triples, film, seed), hidden))


def continuation(triples):
    """First part of the triples to the rest, in arrival order; each part is
    linearised by itself. NULL with fewer than two triples."""
    size = F.size(triples)
    cut = cut_size(size)
    return F.when(
        size >= 2,
        _example(
            "rdfcomp2",
            linearize(F.slice(triples, F.lit(1), cut)),
            linearize(F.slice(triples, cut + 1, F.greatest(size - cut, F.lit(0)))),
        ),
    )


def task_examples(
    pairs: DataFrame,
    tasks=C.TASKS,
    seed: int = C.SPLIT_SEED,
    mask: str = C.MASK,
    mode: str = "text",
    max_tokens: int | None = None,
) -> DataFrame:
    """``film, task, input, target`` for all tasks in one pass over the pairs.

    The linearised line is made once per entity. Other columns of the pairs
    (such as ``split``) are carried along. With ``max_tokens`` examples longer
    than that on either side are left out.
    """
    carried = [c for c in pairs.columns if c not in ("text", "triples", "n_triples")]
    film, text, triples = F.col("film"), F.col("text"), F.col("triples")

    def examples(line):
        made = {
            "text2rdf": lambda: text_to_triples(text, line),
            "rdf2text": lambda: triples_to_text(text, line),
            "rdfcomp1": lambda: masked_completion(film, triples, line, seed, mask, mode),
            "rdfcomp2": lambda: continuation(triples),
        }
        return F.filter(F.array(*(made[t]() for t in tasks)), lambda e: e.isNotNull())

    out = pairs.select(
        *carried, F.explode(bind(linearize(triples), examples)).alias("_e")
    ).select(*carried, "_e.*")
    if max_tokens is not None:
        out = out.where(
            (F.size(tokens(F.col("input"))) <= max_tokens)
            & (F.size(tokens(F.col("target"))) <= max_tokens)
        )
    return out


# --- long form -------------------------------------------------------------
# The same for triples in long form. No row grows with the entity, so these
# also serve entities whose line would not fit into one value.


# The hot keys are not known yet.
COUNTED = "counted"


def line_parts(
    triples: DataFrame, keys=("film",), chunk: int = CHUNK, hot: DataFrame | None | str = COUNTED
) -> DataFrame:
    """Linearised triples per key as ordered parts of at most ``chunk`` triples.

    The parts of a key, joined by a space, are its line. The ``hot`` keys, which may
    be told by some of the columns, are counted unless they are given (None: none).
    """
    keys = list(keys)
    if isinstance(hot, str):
        hot = hot_keys(triples, keys)
    ranked = ranked_rows(triples, keys, ["p", "o", "seq", "s"], "_rank", hot)
    items = F.sort_array(F.collect_list(F.struct("_rank", "s", "p", "o")))
    return (
        ranked.withColumn("part", F.floor((F.col("_rank") - 1) / chunk))
        .groupBy(*keys, "part")
        .agg(F.array_join(F.transform(items, fragment), " ").alias("line"))
    )


def random_triples(triples: DataFrame, seed: int = C.SPLIT_SEED) -> DataFrame:
    """One random triple per entity, the same as ``random_triple`` takes."""
    keyed = F.struct(seeded_hash("film", "s", "p", "o", seed=seed).alias("h"), "s", "p", "o")
    return triples.groupBy("film").agg(F.min(keyed).alias("t")).select("film", "t.s", "t.p", "t.o")


def context_flags(triples: DataFrame, hot: DataFrame | None | str = COUNTED) -> DataFrame:
    """Triples with their place in arrival order and whether they belong to the
    context of the continuation; entities with one triple are left out. The ``hot``
    entities are counted unless they are given (None: none)."""
    if isinstance(hot, str):
        hot = hot_keys(triples, ["film"])
    ranked = ranked_rows(triples, ["film"], ARRIVAL, "pos", hot)
    if hot is None:
        size = F.count("*").over(Window.partitionBy("film")).cast("int")
        sized = ranked.withColumn("n", size).where("film is not null and n >= 2")
    else:
        sizes = triples.groupBy("film").agg(F.count("*").cast("int").alias("n"))
        sized = ranked.join(sizes.where("n >= 2"), "film")
    return (
        sized
        .withColumn("in_context", F.col("pos") <= cut_size(F.col("n")))
        .drop("n")
    )


def _in_order(lines: DataFrame, name: str, marker: str | None = None) -> DataFrame:
    """Parts of lines as pieces that need only be put end to end; the last one is
    followed by the marker."""
    last = lines.groupBy("film").agg(F.max("part").alias("_last"))
    piece = F.concat(F.when(F.col("part") > 0, " ").otherwise(""), F.col("line"))
    if marker is not None:
        end = F.when(F.col("part") == F.col("_last"), f" {marker}").otherwise("")
        piece = F.concat(piece, end)
    return lines.join(last, "film").select("film", "part", piece.alias(name))


def _whole(rows: DataFrame, value, name: str) -> DataFrame:
    """One value of an entity as its only piece."""
    return rows.select("film", F.lit(0).cast("bigint").alias("part"), value.alias(name))


def _sides(task: str, given: DataFrame, wanted: DataFrame) -> DataFrame:
    """Pieces of both sides of a task, empty where the other one has more."""
    both = given.join(wanted, ["film", "part"], "full")
    return both.select(
        "film",
        "part",
        F.lit(task).alias("task"),
        F.coalesce("input", F.lit("")).alias("input"),
        F.coalesce("target", F.lit("")).alias("target"),
    )


def task_parts(
    long: DataFrame,
    tasks=C.TASKS,
    seed: int = C.SPLIT_SEED,
    mask: str = C.MASK,
    max_tokens: int | None = None,
    part_rows: int = CHUNK,
) -> DataFrame:
    """``film, part, task, input, target`` of entities too long for one row, from
    their triples with ``text``.

    Both sides of an example, put end to end in the order of ``part``, are what
    ``task_examples`` makes; no row has more than ``part_rows`` triples. The masked
    text is looked for inside each part. With ``max_tokens`` examples longer than
    that on either side are left out.
    """
    texts = long.groupBy("film").agg(F.max("text").alias("text"))
    triples = long.select("film", "s", "p", "o", "seq")
    text = strip(F.col("text"))
    marker = C.TASK_MARKERS
    lines = written(line_parts(triples, ["film"], part_rows))
    made = []
    if "text2rdf" in tasks:
        given = _whole(texts, F.concat(text, F.lit(f" {marker['text2rdf']}")), "input")
        made.append(_sides("text2rdf", given, _in_order(lines, "target")))
    if "rdf2text" in tasks:
        given = _in_order(lines, "input", marker["rdf2text"])
        made.append(_sides("rdf2text", given, _whole(texts, text, "target")))
    if "rdfcomp1" in tasks:
        chosen = random_triples(triples, seed).select("film", F.col("o").alias("_o"))
        named = lines.join(chosen, "film")
        first = named.where(F.instr("line", F.col("_o")) > 0).groupBy("film").agg(F.min("part").alias("_first"))
        here = F.col("part") == F.col("_first")
        hidden = named.join(first, "film", "left").select(
            "film",
            "part",
            F.when(here, mask_first(F.col("line"), F.col("_o"), mask)).otherwise(F.col("line")).alias("line"),
        )
        given = _in_order(hidden, "input", marker["rdfcomp1"])
        made.append(_sides("rdfcomp1", given, _whole(chosen, F.col("_o"), "target")))
    if "rdfcomp2" in tasks:
        flags = context_flags(triples)
        halves = written(line_parts(flags, ["film", "in_context"], part_rows))
        given = _in_order(halves.where("in_context"), "input", marker["rdfcomp2"])
        made.append(_sides("rdfcomp2", given, _in_order(halves.where("not in_context"), "target")))
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    if max_tokens is None:
        return out
    # Pieces end between tokens, so their numbers add up.
    out = written(out)
    size = lambda side: F.sum(F.size(tokens(F.col(side))))
    short = (
        out.groupBy("film", "task")
        .agg(size("input").alias("_x"), size("target").alias("_y"))
        .where((F.col("_x") <= max_tokens) & (F.col("_y") <= max_tokens))
    )
    return out.join(short.select("film", "task"), ["film", "task"], "left_semi")
