"""Triples as strings and back."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from triplemill import constants as C
from triplemill.functions.text import tokens

TRIPLE = "struct<s:string,p:string,o:string>"

# With every token wrapped in spaces, one pattern reads a fragment: a start
# tag, six more tokens whatever they are, then all up to the next end tag.
FRAGMENT = f" {C.START} (?: [^ ]+ ){{6}}(?:.*? {C.END} |.*)"


def compact_iri(x: Column) -> Column:
    """Short form of a known IRI prefix plus the last path segment."""
    out = x
    for prefix, short in C.IRI_PREFIXES.items():
        out = F.when(
            F.startswith(x, F.lit(prefix)),
            F.concat(F.lit(short), F.substring_index(x, "/", -1)),
        ).otherwise(out)
    return out


def fragment(t: Column) -> Column:
    """One triple in tags."""
    return F.concat_ws(
        " ",
        F.lit(C.START),
        F.lit(C.SUBJECT),
        t["s"],
        F.lit(C.PREDICATE),
        t["p"],
        F.lit(C.OBJECT),
        t["o"],
        F.lit(C.END),
    )


def linearize(items: Column) -> Column:
    """All triples of an array in ``(p, o)`` order, ties in array order."""
    keyed = F.transform(
        items,
        lambda t, i: F.struct(
            t["p"].alias("p"), t["o"].alias("o"), i.alias("i"), t["s"].alias("s")
        ),
    )
    return F.array_join(F.transform(F.sort_array(keyed), fragment), " ")


def parse_triples(x: Column) -> Column:
    """Read triples by position from tagged text, tolerating broken tags."""
    wrapped = F.concat(F.lit(" "), F.array_join(tokens(x), "  "), F.lit(" "))
    found = F.regexp_extract_all(wrapped, F.lit(FRAGMENT), F.lit(0))

    def read(piece):
        parts = F.split(F.trim(piece), "  ", 8)
        return F.struct(
            F.get(parts, F.lit(2)).alias("s"),
            F.get(parts, F.lit(4)).alias("p"),
            F.get(parts, F.lit(6)).alias("o"),
        )

    return F.transform(found, read)


def coerce_triples(x: Column, data_type: str) -> Column:
    """Triples from tagged text, from an array of lists, or from triples."""
    none = F.array().cast(f"array<{TRIPLE}>")
    if data_type == "string":
        return parse_triples(x)
    if data_type.startswith("array<struct"):
        return F.coalesce(x.cast(f"array<{TRIPLE}>"), none)
    lists = F.transform(
        F.filter(x, lambda t: F.size(t) == 3),
        lambda t: F.struct(
            F.get(t, F.lit(0)).cast("string").alias("s"),
            F.get(t, F.lit(1)).cast("string").alias("p"),
            F.get(t, F.lit(2)).cast("string").alias("o"),
        ),
    )
    return F.coalesce(lists, none)


def mask_first(text: Column, part: Column, mask: str = C.MASK) -> Column:
    """Replace the first occurrence of ``part`` in ``text``, wherever it is."""
    at = F.instr(text, part)
    return F.when(
        at > 0,
        F.concat(
            F.substr(text, F.lit(1), at - 1),
            F.lit(mask),
            F.substr(text, at + F.length(part)),
        ),
    ).otherwise(text)


def mask_object(items: Column, chosen: Column, mask: str = C.MASK) -> Column:
    """Linearised triples with the object of the chosen triple masked."""

    def hide(t):
        same = (t["s"] == chosen["s"]) & (t["p"] == chosen["p"]) & (t["o"] == chosen["o"])
        return F.struct(
            t["s"].alias("s"),
            t["p"].alias("p"),
            t["o"].alias("o"),
            F.when(same, F.lit(mask)).otherwise(t["o"]).alias("shown"),
        )

    keyed = F.sort_array(
        F.transform(
            items,
            lambda t, i: F.struct(
                t["p"].alias("p"), t["o"].alias("o"), i.alias("i"), t["s"].alias("s")
            ),
        )
    )
    shown = F.transform(
        F.transform(keyed, hide),
        lambda t: fragment({"s": t["s"], "p": t["p"], "o": t["shown"]}),
    )
    return F.array_join(shown, " ")
