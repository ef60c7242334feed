"""Sources, sinks, neighbourhood extraction and text collection."""

import uuid

from pyspark.sql import functions as F

from checks.build import TRI, pairs, split_pairs
from checks.registry import NOT_WS, d_compact, d_strip, query
from checks.views import ONT, RES, duck_with, spark_view, table
from triplemill.functions import text
from triplemill.operators import extract, tasks
from triplemill.plans.scratch import shared_folder
from triplemill.sources import jsonl

FILM = f"{ONT}Film"
ALLOWED = [f"{ONT}brand", f"{ONT}supplies"]


def folder(spark):
    return f"{shared_folder(spark).rstrip('/')}/json/{uuid.uuid4().hex}"


# --- files -----------------------------------------------------------------


@query("jsonl_s1_s2", duck_with("raw_triples") + " select film, dir, p, o from raw_triples")
def _(spark, sf):
    path = folder(spark)
    rows = spark_view(spark, sf, "raw_triples").select("film", "dir", "p", "o")
    jsonl.write_jsonl(rows, path, compression="gzip")
    return jsonl.read_jsonl(spark, path, jsonl.RAW_TRIPLES)


@query("append_s4", duck_with("raw_texts") + " select film, text from raw_texts")
def _(spark, sf):
    path = folder(spark)
    rows = spark_view(spark, sf, "raw_texts")
    jsonl.write_jsonl(rows.where("seq = 0").select("film", "text"), path, append=True)
    jsonl.write_jsonl(rows.where("seq = 1").select("film", "text"), path, append=True)
    return jsonl.read_jsonl(spark, path, jsonl.RAW_TEXTS, nested=True)


# Two appends to a cache; lines of some entities are cut short.
@query("cache_s3", duck_with("raw_texts") + " select film, text from (select *, row_number() over (partition by film order by seq desc, text desc) as rn from raw_texts where coalesce(text, '') <> '' and film not like '%3') where rn = 1")
def _(spark, sf):
    path = folder(spark)
    line = F.to_json(F.struct("film", "text"))
    cut = F.substr(line, F.lit(1), F.length(line) - 5)
    rows = spark_view(spark, sf, "raw_texts")
    for seq in (0, 1):
        lines = rows.where(F.col("seq") == seq).select(
            F.when(F.endswith("film", F.lit("3")), cut).otherwise(line)
        )
        lines.write.text(jsonl.append_folder(path))
    return jsonl.read_cache(spark, path)


@query("corpus_s5", duck_with("pred_ref_label") + " select text from (select coalesce(pred, '') as text from pred_ref_label union all select coalesce(ref, '') from pred_ref_label)")
def _(spark, sf):
    path = folder(spark)
    rows = spark_view(spark, sf, "pred_ref_label")
    examples = rows.select("split", F.col("pred").alias("input"), F.col("ref").alias("target"))
    examples.write.partitionBy("split").json(path)  # NULL fields are left out
    return jsonl.read_corpus(spark, f"{path}/*/*.json")


FILES = "case conv_id % 6 when 0 then 'd/RDF2Text.train.jsonl' when 1 then 'd/text2rdf.val.jsonl' when 2 then 'rdfcomp1.jsonl' when 3 then 'x/completion2.jsonl' else 'd/mixed.jsonl' end"
MARKED = "case turn % 5 when 0 then concat(text, ' <RDF2Text>') when 1 then concat(text, ' <Text2RDF>') when 2 then concat(text, ' <CONTINUERDF> <MASK>') when 3 then concat('<MASK> ', text) else text end"
INFER = """case when contains(lower(f), 'rdf2text') then 'rdf2text' when contains(lower(f), 'text2rdf') then 'text2rdf' when contains(f, 'rdfcomp1') or contains(f, 'completion1') then 'rdfcomp1'
 when contains(f, 'rdfcomp2') or contains(f, 'completion2') then 'rdfcomp2' when contains(input, '<RDF2Text>') then 'rdf2text' when contains(input, '<Text2RDF>') then 'text2rdf'
 when contains(input, '<CONTINUERDF>') then 'rdfcomp2' when contains(input, '<MASK>') then 'rdfcomp1' else 'unknown' end"""


@query("example_defaults_s6_f12", f"""with r as (select conv_id, turn, {FILES} as f, {MARKED} as input from conversations)
select case when conv_id % 3 = 0 then concat('i', conv_id) when conv_id % 3 = 1 then concat('f', turn) else concat(conv_id, '-', turn) end as id,
case when turn = 4 then 'given' else {INFER} end as task, input, case when conv_id % 4 = 0 then '' else 't' end as target from r""")
def _(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.expr("case when conv_id % 3 = 0 then concat('i', conv_id) when conv_id % 3 = 1 then '' end").alias("id"),
        F.expr("case when conv_id % 3 = 1 then concat('f', turn) end").alias("film"),
        F.expr("case when turn = 4 then 'given' else '' end").alias("task"),
        F.expr(MARKED).alias("input"),
        F.expr("case when conv_id % 4 > 0 then 't' end").alias("target"),
        F.expr(FILES).alias("f"),
        F.concat("conv_id", F.lit("-"), "turn").alias("line"),
    )
    filled = jsonl.with_defaults(rows, F.col("line"), F.col("f"))
    return filled.select("id", "task", "input", "target")


# Eight files of examples without ids; the number of a line is the id.
@query("example_lines_s6", f"""with r as (select turn, {MARKED} as input, 'part-' as f,
  case when conv_id % 3 = 1 then concat('f', turn) else (row_number() over (partition by conv_id % 8 order by conv_id, turn) - 1)::varchar end as id from conversations)
select id, case when turn = 4 then 'given' else {INFER} end as task, input, '' as target from r""")
def _(spark, sf):
    path = folder(spark)
    rows = table(spark, sf, "conversations").select(
        (F.col("conv_id") % 8).alias("part"),
        "conv_id",
        "turn",
        F.expr("case when conv_id % 3 = 1 then concat('f', turn) end").alias("film"),
        F.expr("case when turn = 4 then 'given' end").alias("task"),
        F.expr(MARKED).alias("input"),
    )
    ordered = rows.repartition(8, "part").sortWithinPartitions("part", "conv_id", "turn")
    jsonl.write_jsonl(ordered.drop("conv_id", "turn"), path, by=("part",))
    return jsonl.read_examples(spark, path).select("id", "task", "input", "target")


@query("task_files_s7", TRI + "select e.task, s.split, count(*) as n, sum(length(input))::bigint as input_chars, sum(length(target))::bigint as target_chars from examples e join splits s on e.film = s.film group by all")
def _(spark, sf):
    path = folder(spark)
    jsonl.write_tasks(tasks.task_examples(split_pairs(spark, sf)), path)
    back = jsonl.read_jsonl(spark, path, "film string, input string, target string, task string, split string")
    return back.groupBy("task", "split").agg(
        F.count("*").alias("n"),
        F.sum(F.length("input")).alias("input_chars"),
        F.sum(F.length("target")).alias("target_chars"),
    )


@query("split_files_s8", TRI + "select film, split from splits")
def _(spark, sf):
    path = folder(spark)
    jsonl.write_split_lists(split_pairs(spark, sf), path)
    return jsonl.read_jsonl(spark, path, "film string, split string")


@query("pair_files_s10", TRI + "select split, count(*) as n, sum(n)::bigint as triples, sum(length(text))::bigint as chars from splits group by split")
def _(spark, sf):
    path = folder(spark)
    jsonl.write_pairs(split_pairs(spark, sf), path)
    back = jsonl.read_jsonl(spark, path, jsonl.PAIRS + ", split string")
    return back.groupBy("split").agg(
        F.count("*").alias("n"),
        F.sum(F.size("triples")).alias("triples"),
        F.sum(F.length("text")).alias("chars"),
    )


# --- neighbourhood ---------------------------------------------------------

EDGES = duck_with("edges") + f""",
films as (select distinct s as film from edges where p = 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' and o = '{FILM}'),
allowed as (select * from edges where p in ('{ALLOWED[0]}', '{ALLOWED[1]}')),
outs as (select s as film, 'out' as dir, p, o from allowed where s in (select film from films)),
ins as (select o as film, 'in' as dir, p, s as o from allowed where o in (select film from films)),
near as (select * from outs union all select * from ins)
"""


def edges(spark, sf):
    return spark_view(spark, sf, "edges")


@query("class_members_p4", EDGES + "select film from films")
def _(spark, sf):
    return extract.members(edges(spark, sf), FILM)


@query("predicate_list_p3", EDGES + "select s, p, o from allowed")
def _(spark, sf):
    return extract.allowed(edges(spark, sf), ALLOWED)


@query("predicate_table_p3", EDGES + "select s, p, o from edges where p in (select p from edges group by p having count(*) * 10 > (select count(*) from edges))")
def _(spark, sf):
    rows = edges(spark, sf)
    frequent = rows.groupBy("p").agg(F.count("*").alias("n")).where(F.col("n") * 10 > rows.count())
    return extract.allowed(rows, frequent).select("s", "p", "o")


@query("outgoing_j2", EDGES + "select film, dir, p, o from outs")
def _(spark, sf):
    rows = edges(spark, sf)
    return extract.outgoing(rows, extract.members(rows, FILM), ALLOWED)


@query("incoming_j3", EDGES + "select film, dir, p, o from ins")
def _(spark, sf):
    rows = edges(spark, sf)
    return extract.incoming(rows, extract.members(rows, FILM), ALLOWED)


@query("neighbourhood_u1", EDGES + f"select {d_compact('film')} as film, dir, {d_compact('p')} as p, {d_compact('o')} as o from near")
def _(spark, sf):
    return extract.neighbourhood(edges(spark, sf), FILM, ALLOWED, "both")


@query("pages_s9", EDGES + ", n as (select *, row_number() over (partition by dir order by film, p, o) as rn from near) select film, dir, p, o, ((rn - 1) // 500)::bigint as page from n where rn <= 12345")
def _(spark, sf):
    near = extract.neighbourhood(edges(spark, sf), FILM, ALLOWED, "both", compact=False)
    return extract.pages(near, ["film", "p", "o"], 12345, 500).select("film", "dir", "p", "o", "page")


# --- texts -----------------------------------------------------------------

COLLECT = duck_with("raw_triples", "raw_texts") + f""",
seen as (select film, min(seq) as seq from raw_triples group by film),
cache as (select film, text from (select *, row_number() over (partition by film order by seq desc, text desc) as rn from raw_texts where coalesce(text, '') <> '') where rn = 1),
todo as (select film, seq from seen where film not in (select film from cache)),
answers as (select concat('{RES}Part_', page_id) as film, case when page_id % 3 = 0 then 404 else 200 end as status, url, case when page_id % 3 > 0 then html end as text from pages),
fetched as (select film, text from answers where text is not null),
merged as (select film, coalesce(f.text, c.text) as text from cache c full join fetched f using (film))
"""


def raw(spark, sf):
    return spark_view(spark, sf, "raw_triples")


def cache(spark, sf):
    return jsonl.last_cached(spark_view(spark, sf, "raw_texts"))


def answers(spark, sf):
    """Answers to requests: pages stand for them, every third one is missing."""
    found = F.col("page_id") % 3 > 0
    return table(spark, sf, "pages").select(
        F.concat(F.lit(f"{RES}Part_"), "page_id").alias("film"),
        F.when(found, 200).otherwise(404).alias("status"),
        "url",
        F.when(found, F.col("html")).alias("text"),
    )


def fetched(spark, sf):
    return answers(spark, sf).where("text is not null").select("film", "text")


@query("first_seen_w1", COLLECT + "select film, seq from seen")
def _(spark, sf):
    return extract.first_seen(raw(spark, sf))


@query("first_films_w1_o3", COLLECT + "select film, seq from seen order by seq, film limit 200")
def _(spark, sf):
    return extract.first_seen(raw(spark, sf), 200)


@query("first_rows_o3", "select doc_id, lang from documents order by n_chars, doc_id limit 100")
def _(spark, sf):
    rows = table(spark, sf, "documents")
    return extract.first_rows(rows, 100, "n_chars", "doc_id").select("doc_id", "lang")


@query("work_list_j4", COLLECT + "select film, seq from todo")
def _(spark, sf):
    return extract.to_fetch(extract.first_seen(raw(spark, sf)), cache(spark, sf))


@query("failed_requests_j9", COLLECT + f"select t.film, regexp_replace(t.film, '.*/', '').replace('_', ' ') as title, a.status, a.url from todo t left join answers a on t.film = a.film where t.film not in (select film from fetched)")
def _(spark, sf):
    todo = extract.to_fetch(extract.first_seen(raw(spark, sf)), cache(spark, sf))
    return extract.failed(todo, fetched(spark, sf), answers(spark, sf))


@query("merged_texts_u3", COLLECT + "select film, text from merged")
def _(spark, sf):
    return extract.merge_texts(cache(spark, sf), fetched(spark, sf))


@query("requested_texts_p9", COLLECT + "select film, text from merged where text <> '' and film in (select film from seen)")
def _(spark, sf):
    merged = extract.merge_texts(cache(spark, sf), fetched(spark, sf))
    return extract.requested(merged, extract.first_seen(raw(spark, sf)))


@query("coverage_a17", COLLECT + """, f as (select s.film, c.film is not null as had, g.film is not null as got from seen s left join cache c on s.film = c.film left join fetched g on s.film = g.film)
select count(*) as requested, count(*) filter (had) as cache_hits, count(*) filter (not had and got) as ok, count(*) filter (not had and not got) as failed, count(*) filter (had or got) as written from f""")
def _(spark, sf):
    films = extract.first_seen(raw(spark, sf))
    return extract.coverage(films, cache(spark, sf), fetched(spark, sf))


# Languages as tags with regions, several abstracts per entity.
ABSTRACTS = f"""select concat('{RES}Part_', doc_id % 97) as film, case when doc_id % 2 = 0 then upper(lang) else concat(lang, '-x') end as lang, concat(' ', text, ' ') as text, doc_id as seq from {{documents}}"""


def abstracts(spark, sf):
    return spark.sql(ABSTRACTS.format(documents=f"parquet.`{sf}/documents.parquet`"))


ABS = f"ab as ({ABSTRACTS.format(documents='documents')}), abst as (select film, {d_strip('arg_min(text, seq)')} as abstract from ab where lower(lang) = 'en' or starts_with(lower(lang), 'en-') group by film)"


@query("abstract_language_p8", f"with {ABS} select film, abstract from abst")
def _(spark, sf):
    return extract.abstract_in(abstracts(spark, sf), "en")


@query("text_fallback_j5", COLLECT + f", {ABS} select film, text from (select s.film, coalesce(nullif(c.text, ''), nullif(a.abstract, '')) as text from seen s left join (select film, text from (select film, text, row_number() over (partition by film order by seq desc, text desc) as rn from raw_texts where coalesce(text, '') <> '') lt where rn = 1) c on s.film = c.film left join abst a on s.film = a.film) where text is not null")
def _(spark, sf):
    films = extract.first_seen(raw(spark, sf))
    own = (
        spark_view(spark, sf, "raw_texts")
        .where("coalesce(text, '') <> ''")
        .groupBy("film")
        .agg(F.max_by("text", F.struct("seq", "text")).alias("text"))
    )
    return extract.with_fallback(films, own, extract.abstract_in(abstracts(spark, sf), "en"))


IRIS = f"""select case page_id % 4 when 0 then concat('{RES}', t) when 1 then concat('dbr:', t, '/') when 2 then concat('https://dbpedia.org/resource/x/', t) else t end as iri
from (select page_id, concat(replace(substr(url, 9), '/', '_'), case page_id % 3 when 0 then '_%C3%A9+%zz' when 1 then '%20%2B_100%' else '_(film)' end) as t from {{pages}}) q"""
TITLE = "case when starts_with(i, 'dbr:') then substr(i, 5) when starts_with(i, 'http://dbpedia.org/resource/') or starts_with(i, 'https://dbpedia.org/resource/') then regexp_extract(i, '[^/]*$') else i end"


@query("iri_title_p2", f"with n as ({IRIS.format(pages='pages')}), x as (select iri, regexp_replace(iri, '/$', '') as i from n) select iri, replace(url_decode({TITLE}), '_', ' ') as title from x")
def _(spark, sf):
    iris = spark.sql(IRIS.format(pages=f"parquet.`{sf}/pages.parquet`"))
    return iris.select("iri", text.iri_title(F.col("iri")).alias("title"))


@query("mentions_f8", f"select page_id, array_to_string(regexp_extract_all(html, '(?:dbr:|dbo:|dbc:|dbp:|http://|https://){NOT_WS}+'), ' ') as found from pages")
def _(spark, sf):
    rows = table(spark, sf, "pages")
    return rows.select("page_id", F.array_join(text.mentions(F.col("html")), " ").alias("found"))


@query("mentions_in_lines_f8", TRI + f"select film, array_to_string(regexp_extract_all(line, '(?:dbr:|dbo:|dbc:|dbp:|http://|https://){NOT_WS}+'), ' ') as found from line")
def _(spark, sf):
    rows = tasks.task_examples(pairs(spark, sf), ["text2rdf"])
    return rows.select("film", F.array_join(text.mentions(F.col("target")), " ").alias("found"))


PROMPTS = "select concat(conv_id, '-', turn) as id, case conv_id % 5 when 0 then 'text2rdf' when 1 then 'rdf2text' when 2 then 'rdfcomp1' when 3 then 'rdfcomp2' end as task, case turn % 4 when 0 then concat('  ', text) when 1 then concat(text, ' <MASK> ') when 2 then concat('<Text2RDF> ', text) else ' ' end as input from {conversations}"


@query("prompt_p12", f"""with r as ({PROMPTS.format(conversations='conversations')}), s as (select id, task, {d_strip('input')} as t, case task when 'text2rdf' then '<Text2RDF>' when 'rdf2text' then '<RDF2Text>' when 'rdfcomp1' then '<MASK>' when 'rdfcomp2' then '<CONTINUERDF>' end as m from r)
select id, case when m is null or contains(t, m) then t else {d_strip("concat(t, ' ', m)")} end as prompt from s""")
def _(spark, sf):
    rows = spark.sql(PROMPTS.format(conversations=f"parquet.`{sf}/conversations.parquet`"))
    return rows.select("id", text.prepare_prompt(F.col("input"), F.col("task")).alias("prompt"))
