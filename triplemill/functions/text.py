"""Text functions over string columns."""

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from triplemill import constants as C
from triplemill.functions.arrays import indexes


def strip(x: Column) -> Column:
    return F.btrim(x, F.lit(C.BLANKS))


def present(x: Column) -> Column:
    """Neither NULL nor empty."""
    return F.coalesce(x, F.lit("")) != ""


def tokens(x: Column) -> Column:
    """White-space tokens; none for NULL."""
    return F.array_remove(F.split(F.coalesce(x, F.lit("")), C.BLANK + "+"), "")


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` tokens, joined by a space."""
    if n <= 0:
        return F.array().cast("array<string>")
    if n == 1:
        return words
    return F.transform(
        indexes(F.size(words) - (n - 1)),
        lambda i: F.array_join(F.slice(words, i + 1, n), " "),
    )


def clean_prediction(x: Column) -> Column:
    """One line, without padding tokens; NULL becomes empty."""
    return F.array_join(F.array_remove(tokens(x), C.PAD), " ")


def prepare_prompt(x: Column, task: Column) -> Column:
    """Strip, and append the marker of the task unless the text has it."""
    text = strip(x)
    out = text
    for name, marker in C.TASK_MARKERS.items():
        out = F.when(
            (task == name) & ~F.contains(text, F.lit(marker)),
            strip(F.concat(text, F.lit(" " + marker))),
        ).otherwise(out)
    return out


def iri_title(iri: Column) -> Column:
    """Readable title of an entity IRI.

    ``+`` and a ``%`` that starts no escape are protected first, since the
    decoder would turn the one into a space and reject the other.
    """
    iri = F.regexp_replace(iri, r"/\z", "")
    name = F.when(F.startswith(iri, F.lit("dbr:")), F.substr(iri, F.lit(5)))
    for prefix in C.RESOURCE_PREFIXES:
        name = name.when(
            F.startswith(iri, F.lit(prefix)), F.substring_index(iri, "/", -1)
        )
    name = name.otherwise(iri)
    safe = F.regexp_replace(name, r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.translate(F.url_decode(F.replace(safe, F.lit("+"), F.lit("%2B"))), "_", " ")


def language_matches(lang: Column, wanted: str) -> Column:
    low = F.lower(lang)
    want = wanted.lower()
    return (low == want) | F.startswith(low, F.lit(want + "-"))


def infer_task(file_name: Column, text: Column) -> Column:
    """Task named by the file, else by a marker in the text, else ``unknown``."""
    base = F.lower(F.substring_index(file_name, "/", -1))
    text = F.coalesce(text, F.lit(""))

    def named(*parts):
        cond = F.lit(False)
        for part in parts:
            cond = cond | F.contains(base, F.lit(part))
        return F.coalesce(cond, F.lit(False))

    def marked(task):
        return F.contains(text, F.lit(C.TASK_MARKERS[task]))

    return (
        F.when(named("rdf2text"), "rdf2text")
        .when(named("text2rdf"), "text2rdf")
        .when(named("rdfcomp1", "completion1"), "rdfcomp1")
        .when(named("rdfcomp2", "completion2"), "rdfcomp2")
        .when(marked("rdf2text"), "rdf2text")
        .when(marked("text2rdf"), "text2rdf")
        .when(marked("rdfcomp2"), "rdfcomp2")
        .when(marked("rdfcomp1"), "rdfcomp1")
        .otherwise("unknown")
    )


def mentions(x: Column) -> Column:
    """Entity mentions in order of appearance."""
    return F.regexp_extract_all(x, F.lit(C.MENTION + C.NOT_BLANK + "+"), F.lit(0))


def _common_length(a, b) -> int:
    # Bit-parallel longest common subsequence: one big-integer step per token.
    if a is None or b is None or len(a) == 0 or len(b) == 0:
        return 0
    places = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        hits = row & places.get(word, 0)
        if hits:
            row = ((row + hits) | (row - hits)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(LongType())
def common_subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the longest common subsequence of two token arrays."""
    return pd.Series([_common_length(x, y) for x, y in zip(a, b)], dtype="int64")
