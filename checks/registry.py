"""Registry of queries, each with the SQL that must give the same rows."""

QUERIES = {}
SQL = {}

# White space as one class, in the spelling of DuckDB's expressions.
WS = (
    r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NOT_WS = "[^" + WS[1:]


def query(name, sql=None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def d_strip(x):
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def d_tokens(x):
    return f"list_filter(string_split_regex(coalesce({x}, ''), '{WS}+'), lambda t: t <> '')"


def d_compact(x):
    return (
        f"case when starts_with({x}, 'http://dbpedia.org/resource/') then 'dbr:' || regexp_extract({x}, '[^/]*$') "
        f"when starts_with({x}, 'http://dbpedia.org/ontology/') then 'dbo:' || regexp_extract({x}, '[^/]*$') else {x} end"
    )


def d_hash(*cols, seed=13):
    return f"md5(concat_ws(chr(1), {', '.join(cols)}, '{seed}'))"
