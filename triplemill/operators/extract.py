"""One-hop neighbourhoods of entities, and the collection of their texts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplemill import constants as C
from triplemill.functions.text import iri_title, language_matches, present, strip
from triplemill.operators.pairing import compact_columns
from triplemill.operators.ranking import Ranges


def spellings(names) -> list[str]:
    """The names, and those in short form as whole IRIs, too. Edges can then be
    filtered as they are stored, so that the filter reaches the scan."""
    whole = [
        prefix + name.removeprefix(short)
        for name in names
        for prefix, short in C.IRI_PREFIXES.items()
        if name.startswith(short)
    ]
    return [*names, *whole]


def members(edges: DataFrame, klass: str) -> DataFrame:
    """Entities of a class, each once, as ``film``."""
    typed = edges.where((F.col("p") == C.RDF_TYPE) & F.col("o").isin(*spellings([klass])))
    return typed.select(F.col("s").alias("film")).distinct()


def allowed(edges: DataFrame, predicates) -> DataFrame:
    """Edges with a predicate of a short list, or of a one-column table."""
    if isinstance(predicates, DataFrame):
        return edges.join(predicates.select("p"), "p", "left_semi")
    return edges.where(F.col("p").isin(*spellings(predicates)))


def outgoing(edges: DataFrame, films: DataFrame, predicates) -> DataFrame:
    found = allowed(edges, predicates).withColumnRenamed("s", "film")
    return found.join(films, "film", "left_semi").select(
        "film", F.lit("out").alias("dir"), "p", "o"
    )


def incoming(edges: DataFrame, films: DataFrame, predicates) -> DataFrame:
    """A popular entity makes one key of this join very frequent on the edge
    side only; adaptive execution splits that side of a skewed partition."""
    found = allowed(edges, predicates).withColumnRenamed("o", "film")
    return found.join(films, "film", "left_semi").select(
        "film", F.lit("in").alias("dir"), "p", F.col("s").alias("o")
    )


def neighbourhood(
    edges: DataFrame, klass: str, predicates=C.DEFAULT_PREDICATES, direction="out", compact=True
) -> DataFrame:
    """Raw triples ``(film, dir, p, o)``: outgoing edges, then incoming ones if
    ``direction`` is ``both``. IRIs are shortened unless ``compact`` is off."""
    films = members(edges, klass)
    found = outgoing(edges, films, predicates)
    if direction == "both":
        found = found.unionByName(incoming(edges, films, predicates))
    return compact_columns(found, "film", "p", "o") if compact else found


def pages(
    rows: DataFrame, order: list[str], limit_total: int, batch_size: int, per=("dir",)
) -> DataFrame:
    """First ``limit_total`` rows of each direction with their page number."""
    ranked = Ranges(rows, list(per), order).first(limit_total, "rank")
    return ranked.withColumn("page", F.floor((F.col("rank") - 1) / batch_size))


def first_seen(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Entities by first appearance, at most the first ``most``."""
    films = rows.groupBy("film").agg(F.min("seq").alias("seq"))
    return films if most is None else films.orderBy("seq", "film").limit(most)


def first_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def to_fetch(films: DataFrame, cache: DataFrame) -> DataFrame:
    """Entities that the cache does not have yet."""
    return films.join(cache.select("film"), "film", "left_anti")


def failed(wanted: DataFrame, results: DataFrame, responses: DataFrame) -> DataFrame:
    """Wanted entities without a result, with title, status and address."""
    return (
        wanted.select("film")
        .join(results.select("film"), "film", "left_anti")
        .join(responses.select("film", "status", "url"), "film", "left")
        .select("film", iri_title(F.col("film")).alias("title"), "status", "url")
    )


def merge_texts(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """Cached and fetched texts, the fetched one first where both exist."""
    rank = F.lit(1).alias("rank")
    both = cache.select("film", "text", F.lit(0).alias("rank")).unionByName(
        fetched.select("film", "text", rank)
    )
    return both.groupBy("film").agg(F.max_by("text", F.struct("rank", "text")).alias("text"))


def requested(texts: DataFrame, films: DataFrame) -> DataFrame:
    """Non-empty texts of the requested entities."""
    return texts.where(present(F.col("text"))).join(films.select("film"), "film", "left_semi")


def abstract_in(abstracts: DataFrame, lang: str) -> DataFrame:
    """First abstract of each entity in a language, stripped."""
    fits = abstracts.where(language_matches(F.col("lang"), lang))
    return fits.groupBy("film").agg(
        strip(F.min_by("text", F.struct("seq", "text"))).alias("abstract")
    )


def with_fallback(films: DataFrame, texts: DataFrame, abstracts: DataFrame) -> DataFrame:
    """Own text, else the abstract, else no row."""
    picked = F.coalesce(
        F.when(present(F.col("text")), F.col("text")),
        F.when(present(F.col("abstract")), F.col("abstract")),
    )
    return (
        films.select("film")
        .join(texts.select("film", "text"), "film", "left")
        .join(abstracts.select("film", "abstract"), "film", "left")
        .select("film", picked.alias("text"))
        .where("text is not null")
    )


def coverage(films: DataFrame, cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """Entities asked for, found in the cache, fetched, failed and written.

    ``films``, ``cache`` and ``fetched`` have one row per entity; a fetched row
    without text is a failed one.
    """
    got = fetched.where(present(F.col("text"))).select("film", F.lit(True).alias("got"))
    had = cache.where(present(F.col("text"))).select("film", F.lit(True).alias("had"))
    flags = (
        films.select("film")
        .join(had, "film", "left")
        .join(got, "film", "left")
        .select(
            F.coalesce("had", F.lit(False)).alias("had"),
            F.coalesce("got", F.lit(False)).alias("got"),
        )
    )
    return flags.agg(
        F.count("*").alias("requested"),
        F.count_if("had").alias("cache_hits"),
        F.count_if(~F.col("had") & F.col("got")).alias("ok"),
        F.count_if(~F.col("had") & ~F.col("got")).alias("failed"),
        F.count_if(F.col("had") | F.col("got")).alias("written"),
    )
