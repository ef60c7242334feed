"""Input views over the given tables. The same SQL text runs in Spark and in
DuckDB; ``{name}`` stands for a table."""

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

RES = "http://dbpedia.org/resource/"
ONT = "http://dbpedia.org/ontology/"

VIEWS = {
    "raw_triples": f"""
select concat('{RES}Part_', p_partkey) as film, 'out' as dir, '{ONT}brand' as p, p_brand as o, cast(0 as bigint) as seq from {{part}}
union all select concat('{RES}Part_', p_partkey), 'out', '{ONT}type', p_type, cast(1 as bigint) from {{part}}
union all select concat('{RES}Part_', p_partkey), case when p_partkey % 2 = 0 then 'out' end, '{ONT}size', cast(p_size as varchar(20)), cast(2 as bigint) from {{part}}
union all select concat('{RES}Part_', l_partkey), 'in', '{ONT}supplies', concat('{RES}x/Supplier_', l_suppkey), cast(10 + l_orderkey * 8 + l_linenumber as bigint) from {{lineitem}}""",
    "raw_texts": f"""
select concat('{RES}Part_', doc_id) as film, case when doc_id % 17 = 0 then '   ' when doc_id % 19 = 0 then '' when doc_id % 23 = 0 then null else concat(' ', text, ' ') end as text, cast(0 as bigint) as seq from {{documents}}
union all select concat('{RES}Part_', conv_id), text, cast(1 as bigint) from {{conversations}} where turn = 0""",
    "edges": f"""
select film as s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' as p, '{ONT}Film' as o from (select distinct concat('{RES}Part_', p_partkey) as film from {{part}} where p_size <= 25) q
union all select concat('{RES}Part_', p_partkey), '{ONT}brand', p_brand from {{part}}
union all select concat('{RES}Supplier_', l_suppkey), '{ONT}supplies', concat('{RES}Part_', l_partkey) from {{lineitem}}""",
    "pred_ref_text": """
select concat('c', a.conv_id, '-', a.turn) as id, case when a.conv_id % 7 = 0 then 'unknown' else 'rdf2text' end as task, case when a.conv_id % 2 = 0 then 'val' else 'test' end as split,
  case when a.conv_id % 5 = 0 then a.text when a.conv_id % 11 = 0 then '' else b.text end as pred, a.text as ref
from {conversations} a join {conversations} b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user'""",
    "pred_ref_label": """
select cast(doc_id as varchar(20)) as id, 'rdfcomp1' as task, case when doc_id % 2 = 0 then 'val' else 'test' end as split, case when doc_id % 13 = 0 then null else concat(' ', quality) end as pred, concat(toxic, ' ') as ref from {labels}""",
    "batch_log": """
select event_type as task, case when user_id % 2 = 0 then 'val' else 'test' end as split, event_id % 50 as batch, sum(value) / 1000 as loss, count(*) as n from {events} group by 1, 2, 3""",
}


def spark_view(spark, sf_dir, name):
    """The view as a DataFrame over the Parquet files in ``sf_dir``."""
    files = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(VIEWS[name].format(**files))


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def duck_view(name):
    return VIEWS[name].format(**{t: t for t in TABLES})


def duck_with(*names):
    """``WITH`` clause that defines the named views."""
    return "with " + ",\n".join(f"{n} as ({duck_view(n)})" for n in names)
