"""Vocabulary, encoding, task mixes and padded batches."""

import hashlib

from pyspark.sql import functions as F

from checks.build import TRI, pairs, split_pairs
from checks.registry import NOT_WS, d_hash, d_strip, d_tokens, query
from checks.views import table
from triplemill import constants as C
from triplemill.functions import text
from triplemill.functions.arrays import find_slice
from triplemill.operators import batching, tasks, vocab
from triplemill.operators.vocab import in_place_order
from triplemill.plans.scratch import written
from triplemill.sources import jsonl

WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
SYMBOL = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPECIAL = "|".join(C.SPECIAL_TOKENS)


def documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


# --- vocabulary ------------------------------------------------------------

WORDS = f"words as (select word, count(*) as n from (select unnest(regexp_extract_all(text, '{WORD}+|{SYMBOL}+')) as word from documents) group by word)"


@query("pretoken_counts_a14", f"with {WORDS} select word, n from words")
def _(spark, sf):
    return vocab.pretoken_counts(documents(spark, sf))


@query("pretokens_special_a14_s5", TRI + f", docs as (select unnest([input, target]) as text from examples) select word, count(*) as n from (select unnest(regexp_extract_all(regexp_replace(text, '({SPECIAL})', ' \\1 ', 'g'), '{SPECIAL}|{WORD}+|{SYMBOL}+')) as word from docs) group by word")
def _(spark, sf):
    docs = jsonl.corpus(tasks.task_examples(pairs(spark, sf)))
    return vocab.pretoken_counts(docs, C.SPECIAL_TOKENS)


@query("corpus_splits_s5", TRI + f", docs as (select unnest([input, target]) as text from examples e join splits s on e.film = s.film where split = 'train') select word, count(*) as n from (select unnest(regexp_extract_all(text, '{WORD}+|{SYMBOL}+')) as word from docs) group by word")
def _(spark, sf):
    examples = tasks.task_examples(split_pairs(spark, sf))
    return vocab.pretoken_counts(jsonl.corpus(examples, ["train"]))


@query("alphabet_a15", f"with {WORDS} select c as letter, sum(n)::bigint as n from (select unnest(string_split(word, '')) as c, n from words) group by c")
def _(spark, sf):
    spelling = vocab.spelled(vocab.pretoken_counts(documents(spark, sf)))
    letters = vocab.alphabet(spelling)
    return letters.select(F.decode(F.unhex(F.lpad(F.hex("symbol"), 8, "0")), "UTF-32").alias("letter"), "n")


@query("pair_counts_a15", f"with {WORDS}, s as (select string_split(word, '') as s, n from words), p as (select s, n, unnest(generate_series(1, len(s) - 1)) as i from s) select unicode(s[i]) as a, unicode(s[i + 1]) as b, sum(n)::bigint as n from p group by 1, 2")
def _(spark, sf):
    return vocab.pair_counts(vocab.spelled(vocab.pretoken_counts(documents(spark, sf))))


# Learned to the real size, or until no pair is frequent enough. SQL cannot follow
# that many merges; the tests compare with a tokenizer library and plain Python.


def learned(spark, sf):
    return vocab.learn_merges(written(vocab.pretoken_counts(documents(spark, sf))))


@query("learned_merges_a15")
def _(spark, sf):
    return vocab.merge_table(spark, learned(spark, sf)[1])


@query("vocabulary_a15")
def _(spark, sf):
    return vocab.token_table(spark, learned(spark, sf)[0])


@query("vocabulary_full_a15")
def _(spark, sf):
    # Of the real size, or until no pair is frequent enough.
    words = written(vocab.pretoken_counts(documents(spark, sf)))
    return vocab.merge_table(spark, vocab.learn_merges(words)[1])


def encoded_documents(spark, sf):
    tokens, merges = learned(spark, sf)
    encoder = vocab.word_encoder(spark, tokens, merges)
    coded = documents(spark, sf).select(
        "doc_id", vocab.encode_text(encoder, F.col("text")).alias("ids")
    )
    return coded, tokens


@query("encode_f11")
def _(spark, sf):
    coded, _ = encoded_documents(spark, sf)
    return coded.select("doc_id", F.array_join("ids", " ").alias("ids"), F.size("ids").alias("n"))


# The tokens put together again are the words of the text.
@query("encode_round_trip_f11", f"select doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '{WORD}+|{SYMBOL}+'), '') as words from documents")
def _(spark, sf):
    coded, tokens = encoded_documents(spark, sf)
    decode = vocab.word_decoder(vocab.token_table(spark, tokens))
    # Rows of one document are put together place by place.
    words = coded.groupBy("doc_id").agg(F.collect_list("ids").alias("all"))
    words = words.select("doc_id", in_place_order(decode("all")).alias("all"))
    return coded.select("doc_id").join(words, "doc_id", "left").select(
        "doc_id", F.coalesce(F.array_join("all", ""), F.lit("")).alias("words")
    )


# By a table of encoded words: their characters' code points, which SQL knows, too.
@query("encode_by_words_f11", f"""with t as (select doc_id, array_to_string(regexp_extract_all(coalesce(text, ''), '{WORD}+|{SYMBOL}+'), '') as words from documents)
select doc_id, array_to_string(list_transform(string_split(words, ''), lambda c: unicode(c)), ' ') as ids, length(words)::int as n from t where words <> ''
union all select doc_id, '', 0 from t where words = ''""")
def _(spark, sf):
    docs = documents(spark, sf)
    words = vocab.pretoken_counts(docs)
    chars = F.regexp_extract_all("word", F.lit("(?s)."), F.lit(0))
    encoded = words.withColumn("ids", F.transform(chars, F.ascii))
    coded = vocab.encode_by_words(docs, encoded, "doc_id")
    return coded.select("doc_id", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"), F.size("ids").alias("n"))


@query("encoded_examples_p11_f10")
def _(spark, sf):
    # Learned on the corpus of all examples, as in training.
    examples = written(tasks.task_examples(split_pairs(spark, sf)))
    words = written(vocab.pretoken_counts(jsonl.corpus(examples)))
    tokens, merges = vocab.learn_merges(words)
    encoder = vocab.word_encoder(spark, tokens, merges)
    coded = batching.encoded_examples(examples, encoder, tokens, 256, with_spans=True)
    return coded.select(
        "film",
        "task",
        "split",
        F.size("input_ids").alias("input_len"),
        F.size("labels").alias("label_len"),
        F.size("spans").alias("spans"),
    )


@query("encoded_lengths_p11_p14")
def _(spark, sf):
    examples = written(tasks.task_examples(pairs(spark, sf)))
    words = written(vocab.pretoken_counts(jsonl.corpus(examples)))
    tokens, merges = vocab.learn_merges(words)
    encoder = vocab.word_encoder(spark, tokens, merges)
    coded = batching.encoded_examples(examples, encoder, tokens, 256)
    return coded.select(
        "film",
        "task",
        F.size("input_ids").alias("input_len"),
        F.size("labels").alias("label_len"),
    )


# --- arrays of ids: token lengths stand for them ---------------------------


@query("find_slice_f9", f"""with t as (select doc_id, list_transform({d_tokens('text')}, lambda w: length(w)) as ids from documents),
q as (select doc_id, ids, ids[4:5] as pat from t),
h as (select doc_id, ids, pat, list_filter(generate_series(0, len(ids) - len(pat)), lambda i: ids[i + 1:i + len(pat)] = pat) as hits from q)
select doc_id, case when len(pat) > 0 then hits[1] end::int as first, case when len(pat) > 0 then list_filter(hits, lambda i: i >= 4)[1] end::int as later from h""")
def _(spark, sf):
    rows = documents(spark, sf).select(
        "doc_id", F.transform(text.tokens(F.col("text")), F.length).alias("ids")
    )
    pattern = F.slice("ids", F.lit(4), F.lit(2))
    rows = rows.withColumn("pat", pattern)
    return rows.select(
        "doc_id",
        find_slice(F.col("ids"), F.col("pat")).alias("first"),
        find_slice(F.col("ids"), F.col("pat"), 4).alias("later"),
    )


@query("truncate_p11", f"select doc_id, array_to_string(list_append(list_transform({d_tokens('text')}, lambda w: length(w))[1:255], 3), ' ') as ids from documents")
def _(spark, sf):
    ids = F.transform(text.tokens(F.col("text")), F.length)
    kept = batching.ended(batching.truncated(ids, 256), 3)
    return documents(spark, sf).select("doc_id", F.array_join(kept, " ").alias("ids"))


@query("prepared_target_p14", TRI + f", x as (select film, task, target from examples union all select film, 'rdfcomp1', '  ' || target from examples where task = 'rdfcomp2') select film, task, case when task = 'rdfcomp1' and target <> '' and not starts_with({d_strip('target')}, '<SOT>') then '<SOT> ' || {d_strip('target')} else target end as target from x")
def _(spark, sf):
    rows = tasks.task_examples(pairs(spark, sf)).select("film", "task", "target")
    more = rows.where("task = 'rdfcomp2'").select(
        "film", F.lit("rdfcomp1").alias("task"), F.concat(F.lit("  "), "target").alias("target")
    )
    target = batching.prepared_target(F.col("task"), F.col("target"))
    return rows.unionByName(more).withColumn("target", target)


# One id per white-space token: its first hash digits. Mentions are such tokens.
SPAN = TRI + f""",
tl as (select film, list_transform({d_tokens('line')}, lambda w: ('0x' || substr(md5(w), 1, 7))::int)[1:255] as ids,
  list_transform(regexp_extract_all(line, '(?:dbr:|dbo:|dbc:|dbp:|http://|https://){NOT_WS}+'), lambda w: ('0x' || substr(md5(w), 1, 7))::int) as ms from line),
walk as (with recursive w as (
  select film, ids, ms, 0 as k, 0::bigint as cur, null::bigint as hit from tl
  union all
  select film, ids, ms, k + 1, coalesce(found + 1, cur), found from (
    select film, ids, ms, k, cur, coalesce(list_position(ids[cur + 1:], ms[k + 1]) + cur - 1, list_position(ids, ms[k + 1]) - 1) as found from w where k < len(ms)) q)
  select film, k, hit - case when ids[1] = ('0x' || substr(md5('<SOT>'), 1, 7))::int then 1 else 0 end as st from w where hit is not null)
select film, string_agg(st::varchar, ' ' order by k) as starts, count(*)::int as n from walk where st >= 0 group by film"""


@query("entity_spans_f10", SPAN)
def _(spark, sf):
    def code(w):
        return F.conv(F.substr(F.md5(w), F.lit(1), F.lit(7)), 16, 10).cast("int")

    lines = tasks.task_examples(pairs(spark, sf), ["text2rdf"]).select("film", "target")
    coded = lines.select(
        "film",
        batching.truncated(F.transform(text.tokens(F.col("target")), code), 256).alias("ids"),
        F.transform(text.mentions(F.col("target")), lambda m: F.array(code(m))).alias("ms"),
    )
    start = int(hashlib.md5(C.START.encode()).hexdigest()[:7], 16)
    found = coded.select(
        "film", batching.entity_spans(F.col("ids"), F.col("ms"), start).alias("spans")
    )
    return found.select(
        "film",
        F.array_join(F.col("spans.start").cast("array<string>"), " ").alias("starts"),
        F.size("spans").alias("n"),
    )


# --- sampling --------------------------------------------------------------

MIX = TRI + f""",
sized as (select *, row_number() over (partition by task order by film) as rn, count(*) over (partition by task) as size from examples),
draws as (select d, ('0x' || substr({d_hash("'task'", 'd::varchar')}, 1, 13))::bigint / 16::double ** 13 as u, ('0x' || substr({d_hash("'row'", 'd::varchar')}, 1, 13))::bigint / 16::double ** 13 as v
  from (select unnest(generate_series(0, (select count(*) from examples) - 1)) as d)),
picked as (select d, v, case when u <= 0.3::double then 'rdf2text' when u <= 0.6::double then 'text2rdf' when u <= 0.8::double then 'rdfcomp1' else 'rdfcomp2' end as task from draws)
select p.d as draw, s.task, s.film as id from picked p join sized s on s.task = p.task and s.rn = floor(p.v * s.size)::bigint + 1"""


@query("weighted_mix_m2", MIX)
def _(spark, sf):
    rows = written(tasks.task_examples(pairs(spark, sf)).withColumnRenamed("film", "id"))
    return batching.weighted_mix(rows).select("draw", "task", "id")


@query("local_mix_m2")
def _(spark, sf):
    rows = tasks.task_examples(pairs(spark, sf)).withColumnRenamed("film", "id")
    return batching.local_mix(rows).select("task", "id", "copy")


def turns(spark, sf):
    return table(spark, sf, "conversations").select(
        F.concat("conv_id", F.lit("-"), "turn").alias("id"),
        "role",
        "text",
        (F.col("conv_id") * 100 + F.col("turn")).alias("seq"),
    )


TURNS = "with turns as (select concat(conv_id, '-', turn) as id, role, text, conv_id * 100 + turn as seq from conversations)"


@query("one_batch_m3", TURNS + f" select id, text from turns order by {d_hash('id')}, id limit 16")
def _(spark, sf):
    return batching.one_batch(turns(spark, sf), 16).select("id", "text")


@query("validation_union_u2", TRI + "select e.film, e.task, e.input, e.target from examples e join splits s on e.film = s.film where s.split = 'val'")
def _(spark, sf):
    rows = written(tasks.task_examples(split_pairs(spark, sf)).where("split = 'val'").drop("split"))
    return batching.concatenated([rows.where(F.col("task") == t) for t in C.TASKS])


@query("repeated_first_u6", TURNS + " select concat('mini-', unnest(generate_series(0, 255))) as id, role, text from (select * from turns order by seq limit 1)")
def _(spark, sf):
    return batching.repeated_first(turns(spark, sf))


# --- batches ---------------------------------------------------------------

BATCH = TURNS + f""",
c as (select *, list_transform({d_tokens('text')}, lambda w: length(w)) as x, list_transform({d_tokens('text')}, lambda w: length(w) + 1) as y from turns),
sp as (select *, list_filter(generate_series(0, len(y) - 1), lambda i: y[i + 1] = 8) as st from c),
b as (select *, (row_number() over (partition by role order by seq) - 1) as rn from sp),
m as (select role, (rn // 16)::bigint as batch_id, (rn % 16)::int as row_in_batch, id, x, y, st, max(len(x)) over w as mx, max(len(y)) over w as my, max(len(st)) over w as ms from b window w as (partition by role, rn // 16))
select id, role, batch_id, row_in_batch, array_to_string(list_concat(x, list_transform(generate_series(1, mx - len(x)), lambda i: 0)), ' ') as input_ids,
 array_to_string(list_concat(y, list_transform(generate_series(1, my - len(y)), lambda i: 0)), ' ') as labels,
 array_to_string(list_concat(list_transform(st, lambda i: i), list_transform(generate_series(1, ms - len(st)), lambda i: -1)), ' ') as mask_positions,
 array_to_string(list_concat(list_transform(st, lambda i: 1), list_transform(generate_series(1, ms - len(st)), lambda i: 0)), ' ') as mask_lengths,
 array_to_string(list_concat(list_transform(st, lambda i: 'true'), list_transform(generate_series(1, ms - len(st)), lambda i: 'false')), ' ') as mask_valid,
 len(x)::int as attended from m"""


@query("padded_batches_w10", BATCH)
def _(spark, sf):
    words = text.tokens(F.col("text"))
    rows = turns(spark, sf).select(
        "id",
        "role",
        "seq",
        F.transform(words, F.length).alias("input_ids"),
        F.transform(words, lambda w: F.length(w) + 1).alias("labels"),
    )
    hits = F.filter(
        F.transform(
            "labels",
            lambda y, i: F.when(y == 8, F.struct(i.alias("start"), F.lit(1).alias("len"))),
        ),
        lambda s: s.isNotNull(),
    )
    out = batching.padded_batches(
        rows.withColumn("spans", hits), 16, 0, ["seq"], per=("role",)
    )
    lists = ["input_ids", "labels", "mask_positions", "mask_lengths", "mask_valid"]
    return out.select(
        "id",
        "role",
        "batch_id",
        "row_in_batch",
        *(F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in lists),
        F.size(F.filter("attention_mask", lambda a: a)).alias("attended"),
    )
