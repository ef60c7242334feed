"""Pairing, task building, splits and subset."""

from pyspark.sql import functions as F

from checks.registry import d_compact, d_hash, d_strip, d_tokens, query
from checks.views import duck_with, spark_view
from triplemill.functions import rdf, text
from triplemill.operators import pairing, ranking, subset, tasks
from triplemill.plans.scratch import written

# Fewest triples of a kept entity, the same at every scale.
MIN = 12


def raw(spark, sf):
    return pairing.compact_columns(spark_view(spark, sf, "raw_triples"), "film", "p", "o")


def triples(spark, sf):
    return pairing.directed(raw(spark, sf))


def texts(spark, sf):
    return pairing.compact_columns(spark_view(spark, sf, "raw_texts"), "film")


def pairs(spark, sf):
    return pairing.pair_records(triples(spark, sf), texts(spark, sf), MIN)


def split_pairs(spark, sf):
    """Pairs with their split. Written once, as the build does."""
    kept = written(pairs(spark, sf))
    return kept.withColumn("split", ranking.split_of("film", ranking.split_cuts(kept)))


def flat(items):
    """Triples of an array as one text, to compare arrays as strings."""
    return F.array_join(
        F.transform(items, lambda t: F.concat_ws("|", t["s"], t["p"], t["o"])), ";"
    )


TRI = duck_with("raw_triples", "raw_texts") + f""",
raw as (select {d_compact('film')} as film, dir, {d_compact('p')} as p, {d_compact('o')} as o, seq from raw_triples),
tri as (select film, case when coalesce(dir, 'out') = 'in' then o else film end as s, p,
  case when coalesce(dir, 'out') = 'in' then film else o end as o, seq from raw),
dis as (select film, s, p, o, min(seq) as seq from tri group by all),
txt as (select film, {d_strip('text')} as text from (select {d_compact('film')} as film, text,
  row_number() over (partition by film order by seq desc, text desc) as rn from raw_texts where coalesce(text, '') <> '') where rn = 1),
flags as (select c.film, c.n, t.text, case when t.text is null then 'no_text' when c.n < {MIN} then 'few_triples' else 'kept' end as outcome
  from (select film, count(*) as n from dis group by film) c left join (select * from txt where text <> '') t on c.film = t.film),
kept as (select * from flags where outcome = 'kept'),
pos as (select d.*, k.n, k.text, row_number() over (partition by d.film order by seq, p, o, s) as pos from dis d join kept k on d.film = k.film),
frag as (select *, concat('<SOT> <SUBJ> ', s, ' <PRED> ', p, ' <OBJ> ', o, ' <EOT>') as f, greatest(1, trunc(0.6::double * n)::int) as cut from pos),
line as (select film, any_value(text) as text, any_value(n) as n, string_agg(f, ' ' order by p, o, pos) as line,
  string_agg(f, ' ' order by p, o, pos) filter (where pos <= cut) as ctx, string_agg(f, ' ' order by p, o, pos) filter (where pos > cut) as nxt,
  arg_min({{'s': s, 'p': p, 'o': o}}, {d_hash('film', 's', 'p', 'o')}) as pick from frag group by film),
masked as (select film, pick.o as o, case when strpos(line, pick.o) > 0 then substr(line, 1, strpos(line, pick.o) - 1) || '<MASK>' || substr(line, strpos(line, pick.o) + length(pick.o)) else line end as m from line),
ranked as (select film, n, text, row_number() over (order by {d_hash('film')}) as rn, count(*) over () as total from kept),
splits as (select film, n, text, case when rn <= trunc(total * 0.8::double) then 'train' when rn <= trunc(total * 0.8::double) + trunc(total * 0.1::double) then 'val' else 'test' end as split from ranked),
examples as (
  select film, 'text2rdf' as task, text || ' <Text2RDF>' as input, line as target from line
  union all select film, 'rdf2text', line || ' <RDF2Text>', text from line
  union all select film, 'rdfcomp1', m || ' <MASK>', o from masked
  union all select film, 'rdfcomp2', ctx || ' <CONTINUERDF>', coalesce(nxt, '') from line where n >= 2)
"""


@query("compact_iri_p1", duck_with("raw_triples") + f", iris as (select film as iri from raw_triples union select p from raw_triples union select o from raw_triples) select iri, {d_compact('iri')} as short from iris")
def _(spark, sf):
    rows = spark_view(spark, sf, "raw_triples")
    iris = rows.select(F.explode(F.array("film", "p", "o")).alias("iri")).distinct()
    return iris.select("iri", rdf.compact_iri(F.col("iri")).alias("short"))


@query("directed_triples_p5", TRI + "select film, s, p, o, seq from tri")
def _(spark, sf):
    return triples(spark, sf)


@query("distinct_triples_w2", TRI + "select film, s, p, o, seq from dis")
def _(spark, sf):
    return pairing.distinct_triples(triples(spark, sf))


@query("last_text_a2_p6", TRI + "select film, text from txt where text <> ''")
def _(spark, sf):
    return pairing.last_texts(texts(spark, sf))


@query("pair_join_j1", TRI + "select film, n::int as n_triples, text, outcome from flags")
def _(spark, sf):
    return pairing.pair_flags(triples(spark, sf), texts(spark, sf), MIN)


AUDIT = TRI + "select count(*) filter (outcome = 'kept') as kept, count(*) filter (outcome = 'no_text') as no_text, count(*) filter (outcome = 'few_triples') as few_triples from flags"


@query("pairing_audit_a3", AUDIT)
def _(spark, sf):
    return pairing.pairing_audit(pairing.pair_flags(triples(spark, sf), texts(spark, sf), MIN))


@query("observed_audit_a3_j1", AUDIT)
def _(spark, sf):
    # As in a build: the pairs are written, and the audit is seen on the way.
    made = pairing.audited_records(triples(spark, sf), texts(spark, sf), MIN)
    written(made.pairs)
    return made.audit()


@query("kept_triples_p7", TRI + "select d.film, s, p, o, seq, k.n::int as n_triples from dis d join kept k on d.film = k.film")
def _(spark, sf):
    tri = triples(spark, sf)
    return pairing.kept_triples(tri, pairing.pair_flags(tri, texts(spark, sf), MIN))


@query("grouped_triples_a1", TRI + "select film, string_agg(concat_ws('|', s, p, o), ';' order by seq, p, o, s) as triples, count(*)::int as n from dis group by film")
def _(spark, sf):
    rows = pairing.triples_by_film(triples(spark, sf))
    return rows.select("film", flat(F.col("items")).alias("triples"), F.size("items").alias("n"))


@query("pairs_p10", TRI + "select film, any_value(text) as text, string_agg(concat_ws('|', s, p, o), ';' order by pos) as triples, any_value(n)::int as n_triples from pos group by film")
def _(spark, sf):
    return pairs(spark, sf).withColumn("triples", flat(F.col("triples")))


@query("linearize_f1_o1", TRI + "select film, string_agg(concat('<SOT> <SUBJ> ', s, ' <PRED> ', p, ' <OBJ> ', o, ' <EOT>'), ' ' order by p, o, seq, s) as line from dis group by film")
def _(spark, sf):
    rows = pairing.triples_by_film(triples(spark, sf))
    return rows.select("film", rdf.linearize(F.col("items")).alias("line"))


# Broken tags: every third entity loses its object tags, others get objects of
# two words, are cut off, or have a start tag inside a triple.
BROKEN = """
case right(film, 1) when '1' then replace(line, '<OBJ> ', '') when '2' then replace(line, 'Brand#', 'Brand # ')
  when '3' then substr(line, 1, length(line) - 9) when '4' then replace(line, '<EOT>', '') when '5' then replace(line, '<PRED> dbo:size', '<SOT> <SOT>')
  when '6' then replace(line, ' <SOT>', '<SOT>') else line end"""
PARSED = r"""list_transform(regexp_extract_all(' ' || array_to_string(TOKENS, '  ') || ' ', ' <SOT> (?: [^ ]+ ){6}(?:.*? <EOT> |.*)'), lambda m: string_split(trim(m), '  '))"""


@query("parse_triples_f2", TRI + f""", b as (select film, {BROKEN} as line from line),
x as (select film, unnest({PARSED.replace('TOKENS', d_tokens('line'))}) as f from b)
select film, f[3] as s, f[5] as p, f[7] as o from x""")
def _(spark, sf):
    lines = pairs(spark, sf).select("film", rdf.linearize(F.col("triples")).alias("line"))
    broken = lines.select("film", F.expr(BROKEN).alias("line"))
    return broken.select("film", F.explode(rdf.parse_triples(F.col("line"))).alias("t")).select(
        "film", "t.*"
    )


@query("coerce_triples_f3", TRI + ", d as (select distinct film, s, p, o from pos where s <> film) select film, s, p, o from d")
def _(spark, sf):
    # Lists of three, four and two parts: only the first kind counts.
    lists = pairs(spark, sf).select(
        "film",
        F.transform(
            "triples",
            lambda t: F.when(t["s"] == F.col("film"), F.array(t["s"], t["p"])).otherwise(
                F.array(t["s"], t["p"], t["o"])
            ),
        ).alias("items"),
    )
    found = rdf.coerce_triples(F.col("items"), dict(lists.dtypes)["items"])
    return lists.select("film", F.explode(found).alias("t")).select("film", "t.*")


@query("random_triple_m1", TRI + "select film, pick.s as s, pick.p as p, pick.o as o from line")
def _(spark, sf):
    chosen = tasks.random_triple(F.col("triples"), F.col("film"), 13)
    return pairs(spark, sf).select("film", chosen.alias("t")).select("film", "t.s", "t.p", "t.o")


@query("mask_first_f7", TRI + "select film, o, m as masked from masked")
def _(spark, sf):
    rows = pairs(spark, sf).select(
        "film",
        rdf.linearize(F.col("triples")).alias("line"),
        tasks.random_triple(F.col("triples"), F.col("film"), 13)["o"].alias("o"),
    )
    return rows.select("film", "o", rdf.mask_first(F.col("line"), F.col("o")).alias("masked"))


@query("mask_object_f7", TRI + """, hid as (select l.film, string_agg(case when f.s = l.pick.s and f.p = l.pick.p and f.o = l.pick.o then concat('<SOT> <SUBJ> ', f.s, ' <PRED> ', f.p, ' <OBJ> <MASK> <EOT>') else f.f end, ' ' order by f.p, f.o, f.pos) as masked
from frag f join line l on f.film = l.film group by l.film) select film, masked || ' <MASK>' as input from hid""")
def _(spark, sf):
    return tasks.task_examples(pairs(spark, sf), ["rdfcomp1"], mode="object").select("film", "input")


@query("prefix_cut_w9", TRI + "select film, count(*) filter (pos <= cut) as context, count(*) filter (pos > cut) as rest from frag group by film")
def _(spark, sf):
    n = F.size("triples")
    cut = tasks.cut_size(n)
    return pairs(spark, sf).select(
        "film", cut.cast("bigint").alias("context"), (n - cut).cast("bigint").alias("rest")
    )


@query("line_parts_f1", TRI + "select film, part, string_agg(f, ' ' order by p, o, seq, s) as line from (select *, ((row_number() over (partition by film order by p, o, seq, s) - 1) // 8)::bigint as part, concat('<SOT> <SUBJ> ', s, ' <PRED> ', p, ' <OBJ> ', o, ' <EOT>') as f from dis) group by film, part")
def _(spark, sf):
    return tasks.line_parts(pairing.distinct_triples(triples(spark, sf)), chunk=8)


@query("random_triples_long_m1", TRI + f"select film, t.s as s, t.p as p, t.o as o from (select film, arg_min({{'s': s, 'p': p, 'o': o}}, {d_hash('film', 's', 'p', 'o')}) as t from dis group by film)")
def _(spark, sf):
    return tasks.random_triples(pairing.distinct_triples(triples(spark, sf)))


@query("context_flags_w9", TRI + "select film, s, p, o, seq, pos, pos <= greatest(1, trunc(0.6::double * n)::int) as in_context from (select *, row_number() over (partition by film order by seq, p, o, s) as pos, count(*) over (partition by film) as n from dis) where n >= 2")
def _(spark, sf):
    return tasks.context_flags(pairing.distinct_triples(triples(spark, sf)))


@query("continuation_parts_b4", TRI + ", fl as (select *, pos <= greatest(1, trunc(0.6::double * n)::int) as in_context from (select *, row_number() over (partition by film order by seq, p, o, s) as pos, count(*) over (partition by film) as n from dis) where n >= 2) select film, in_context, string_agg(concat('<SOT> <SUBJ> ', s, ' <PRED> ', p, ' <OBJ> ', o, ' <EOT>'), ' ' order by p, o, seq, s) as line from fl group by film, in_context")
def _(spark, sf):
    # One layout by entity serves all steps, unless an entity is hot.
    rows = triples(spark, sf)
    hot = ranking.hot_keys(rows, ["film"])
    laid = ranking.laid_by(rows, ["film"], hot, rows.count())
    flagged = tasks.context_flags(pairing.distinct_triples(laid), hot)
    return tasks.line_parts(flagged, ("film", "in_context"), hot=hot).drop("part")


def _task_query(name, task):
    @query(name, TRI + f"select film, task, input, target from examples where task = '{task}'")
    def _(spark, sf):
        return tasks.task_examples(pairs(spark, sf), [task])


_task_query("text_to_triples_b1", "text2rdf")
_task_query("triples_to_text_b2", "rdf2text")
_task_query("masked_completion_b3", "rdfcomp1")
_task_query("continuation_b4", "rdfcomp2")


@query("task_union_u5", TRI + "select film, task, input, target from examples")
def _(spark, sf):
    return tasks.task_examples(pairs(spark, sf))


@query("task_length_limit", TRI + f"select film, task, input, target from examples where len({d_tokens('input')}) <= 384 and len({d_tokens('target')}) <= 384")
def _(spark, sf):
    return tasks.task_examples(pairs(spark, sf), max_tokens=384)


@query("split_w3_j7", TRI + "select film, split from splits")
def _(spark, sf):
    return split_pairs(spark, sf).select("film", "split")


@query("split_examples_j7", TRI + "select e.film, e.task, e.input, e.target, s.split from examples e join splits s on e.film = s.film")
def _(spark, sf):
    return tasks.task_examples(split_pairs(spark, sf))


# --- subset ----------------------------------------------------------------

SUB = TRI + """,
sizes as (select split, count(*) as size from splits group by split),
b0 as (select split, size, least(20, sum(size) over ()) as total, sum(size) over () as films, count(*) over () as filled from sizes),
b1 as (select *, total * size / films::double as exact, least(size, greatest(floor(total * size / films::double), case when total >= filled then 1 else 0 end)) as base from b0),
b2 as (select *, exact - base as rest, total - sum(base) over () as diff from b1),
b3 as (select *, case when diff > 0 then row_number() over (order by size <= base, rest desc, split desc) else row_number() over (order by base = 0, rest, split) end as place from b2),
b4 as (select split, size, (base + case when diff > 0 and size > base and place <= diff then 1 when diff < 0 and base > 0 and place <= -diff then -1 else 0 end)::bigint as take from b3),
w as (select max(take) filter (split = 'train') as tr, max(take) filter (split = 'val') as va, max(take) filter (split = 'test') as te,
  max(size) filter (split = 'val') as sv, max(size) filter (split = 'test') as st from b4),
r1 as (select *, greatest(0, least(4, sv) - va) as need from w),
r2 as (select *, least(need, tr - 1) as a from r1),
r3 as (select tr - a as tr, va + a + least(need - a, te) as va, te - least(need - a, te) as te, st from r2),
r4 as (select *, greatest(0, least(4, st) - te) as need from r3),
r5 as (select *, least(need, tr - 1) as a from r4),
r6 as (select tr - a as train, va - least(need - a, va) as val, te + a + least(need - a, va) as test from r5),
shares as (select 'train' as split, train as k from r6 union all select 'val', val from r6 union all select 'test', test from r6),
byn as (select s.split, film, n, row_number() over (partition by s.split order by n, film) - 1 as i, count(*) over (partition by s.split) as total, k from splits s join shares h on s.split = h.split),
places as (select distinct split, case when total <= k then i when k = 1 then total // 2 else round_even(i * (total - 1) / nullif(k - 1, 0)::double, 0)::bigint end as i from byn where i < k),
chosen as (select b.split, b.film, b.n::int as n_triples from byn b join places p on b.split = p.split and b.i = p.i)
"""


def index(spark, sf):
    return split_pairs(spark, sf).select("film", "split", "n_triples")


def chosen_of(spark, sf):
    return subset.select_subset(index(spark, sf), 20)


@query("evenly_spaced_w4_o2", SUB + "select split, film, n_triples from chosen")
def _(spark, sf):
    return chosen_of(spark, sf)


@query("split_shares_w5", SUB + "select split, size, take from b4")
def _(spark, sf):
    return subset.allocate(subset.split_sizes(index(spark, sf)), 20)


@query("rebalanced_shares_w6", SUB + "select split, k::bigint as k from shares")
def _(spark, sf):
    shares = subset.subset_shares(subset.split_sizes(index(spark, sf)), 20)
    return spark.createDataFrame(list(shares.items()), "split string, k bigint")


@query("subset_examples_j6", SUB + "select e.film, c.split, e.task, e.input, e.target from examples e join chosen c on e.film = c.film")
def _(spark, sf):
    rows = split_pairs(spark, sf)
    chosen = subset.select_subset(rows.select("film", "split", "n_triples"), 20)
    return subset.subset_examples(tasks.task_examples(rows), chosen)


@query("subset_counts_a13", SUB + """, cells as (select c.split, e.task, count(*) as n from examples e join chosen c on e.film = c.film group by all),
grid as (select unnest(['text2rdf', 'rdf2text', 'rdfcomp1', 'rdfcomp2']) as task), s3 as (select unnest(['train', 'val', 'test']) as split)
select g.task, s.split, coalesce(n, 0)::bigint as n from grid g join s3 s on true left join cells c on c.task = g.task and c.split = s.split""")
def _(spark, sf):
    rows = split_pairs(spark, sf)
    chosen = subset.select_subset(rows.select("film", "split", "n_triples"), 20)
    return subset.subset_counts(subset.subset_examples(tasks.task_examples(rows), chosen))


@query("manifest_s8_o4", SUB + "select split, string_agg(film, ',' order by film) as films from chosen group by split")
def _(spark, sf):
    rows = split_pairs(spark, sf)
    chosen = subset.select_subset(rows.select("film", "split", "n_triples"), 20)
    counts = subset.subset_counts(subset.subset_examples(tasks.task_examples(rows), chosen))
    text = subset.manifest_json(chosen, counts, "processed")
    shape = "struct<total_films:int,per_split:map<string,array<string>>>"
    read = text.select(F.from_json("manifest", shape).alias("m"))
    return read.select(F.explode("m.per_split").alias("split", "films")).select(
        "split", F.array_join("films", ",").alias("films")
    )


@query("size_order_o2", TRI + "select film, n::int as n_triples, (row_number() over (order by n, film))::bigint as place from flags")
def _(spark, sf):
    flags = pairing.pair_flags(triples(spark, sf), texts(spark, sf), MIN)
    rows = subset.by_size(flags.select("film", "n_triples"))
    return ranking.rank_within(rows, [], ["n_triples", "film"], "place")


@query("pair_index_j10", duck_with("raw_texts") + """, r as (select case when ends_with(film, '7') then null when ends_with(film, '9') then '' else film end as film, text, seq from raw_texts)
select film, text from (select *, row_number() over (partition by film order by seq desc, text desc nulls last) as rn from r where coalesce(film, '') <> '') where rn = 1""")
def _(spark, sf):
    rows = spark_view(spark, sf, "raw_texts").withColumn(
        "film",
        F.when(F.endswith("film", F.lit("7")), F.lit(None))
        .when(F.endswith("film", F.lit("9")), F.lit(""))
        .otherwise(F.col("film")),
    )
    return subset.pair_index(rows).select("film", "text")


@query("split_grid_j10", TRI + "select split, count(*) as size from splits where split <> 'val' group by split union all select 'val', 0")
def _(spark, sf):
    return subset.split_sizes(index(spark, sf).where("split <> 'val'"))


# --- text functions on the same rows ---------------------------------------


@query("whitespace_tokens_f4", "select doc_id, len(t)::int as n, array_to_string(t, '|') as tokens from (select doc_id, " + d_tokens("text") + " as t from documents)")
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    found = rows.select("doc_id", text.tokens(F.col("text")).alias("t"))
    return found.select("doc_id", F.size("t").alias("n"), F.array_join("t", "|").alias("tokens"))
