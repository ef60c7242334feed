"""Metrics, losses and reports."""

from pyspark.sql import functions as F

from checks.build import TRI
from checks.registry import d_strip, d_tokens, query
from checks.views import duck_with, spark_view, table
from triplemill.functions import rdf, text
from triplemill.functions.arrays import numbered
from triplemill.operators import metrics, ranking, report


def pred_ref(spark, sf):
    return spark_view(spark, sf, "pred_ref_text")


def labels(spark, sf):
    return spark_view(spark, sf, "pred_ref_label")


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- SQL of the metrics, over r(split, task, id, pred, ref) -----------------

TOK = f", tok as (select *, {d_tokens('pred')} as p, {d_tokens('ref')} as r from r)"

GRAMS = """,
pg as (select split, task, id, n, g, count(*) as c from (select split, task, id, n, unnest(list_transform(generate_series(1, len(p) - n + 1), lambda i: array_to_string(p[i:i + n - 1], ' '))) as g from tok, (select unnest([1, 2, 3, 4]) as n) k) group by all),
rg as (select split, task, id, n, g, count(*) as c from (select split, task, id, n, unnest(list_transform(generate_series(1, len(r) - n + 1), lambda i: array_to_string(r[i:i + n - 1], ' '))) as g from tok, (select unnest([1, 2, 3, 4]) as n) k) group by all),
hit as (select pg.split, pg.task, pg.n, sum(least(pg.c, rg.c)) as m from pg join rg using (split, task, id, n, g) group by all),
poss as (select split, task, n, sum(greatest(len(p) - n + 1, 0)) as t, sum(len(p)) as pl, sum(len(r)) as rl from tok, (select unnest([1, 2, 3, 4]) as n) k group by all),
bleu as (select split, task, case when min(t) = 0 then 0.0 else 100 * exp(avg(ln((coalesce(m, 0) + 1e-9::double) / (t + 1e-9::double)))) * case when any_value(pl) < any_value(rl) then exp(1 - any_value(rl) / any_value(pl)::double) else 1 end end as bleu
  from poss left join hit using (split, task, n) group by split, task)"""

LCS = """,
dp as (with recursive cell as (
  select split, task, id, 0::bigint as i, list_transform(r, lambda x: 0::bigint) as v, p, r from tok where len(p) > 0 and len(r) > 0
  union all
  select split, task, id, i + 1, list_transform(generate_series(1, len(r)), lambda j: list_max(c[1:j])), p, r from (
    select split, task, id, i, p, r, list_transform(generate_series(1, len(r)), lambda j: case when r[j] = p[i + 1] then coalesce(v[j - 1], 0) + 1 else v[j] end) as c from cell where i < len(p)) q)
  select split, task, id, list_max(v) as lcs from cell where i = len(p)),
rouge as (select split, task, 100 * avg(coalesce(case when lcs > 0 then 2.44::double * (lcs / len(p)::double) * (lcs / len(r)::double) / ((lcs / len(r)::double) + 1.44::double * (lcs / len(p)::double)) else 0 end, 0)) as rouge_l
  from tok left join dp using (split, task, id) group by split, task)"""

METEOR = f""",
low as (select split, task, id, {d_tokens('lower(pred)')} as p, {d_tokens('lower(ref)')} as r from r),
hc as (select split, task, id, w, count(*) as c from (select split, task, id, unnest(p) as w from low) group by all),
ro as (select split, task, id, w, pos, row_number() over (partition by split, task, id, w order by pos) as k from (select split, task, id, unnest(r) as w, generate_subscripts(r, 1) as pos from low)),
mt as (select split, task, id, pos, pos - row_number() over (partition by split, task, id order by pos) as island from ro join hc using (split, task, id, w) where k <= c),
ms as (select split, task, id, count(*)::double as m, count(distinct island) as ch from mt group by all),
meteor as (select split, task, 100 * avg(coalesce((1 - 0.5 * (ch / m) ** 3) * (m / len(p)) * (m / len(r)) / (0.9 * m / len(p) + 0.1 * m / len(r)), 0)) as meteor
  from low left join ms using (split, task, id) group by split, task)"""

R_TEXT = duck_with("pred_ref_text") + ", r as (select * from pred_ref_text)"


@query("corpus_bleu_a4", R_TEXT + TOK + GRAMS + " select split, task, round(bleu, 6) as bleu from bleu")
def _(spark, sf):
    return rounded(metrics.corpus_bleu(pred_ref(spark, sf), ("split", "task")), "bleu")


@query("ngram_bags_f5", R_TEXT + TOK + GRAMS + " select id, n, g as gram, c as copies from pg")
def _(spark, sf):
    grams = F.array(
        *(
            F.struct(F.lit(n).alias("n"), text.ngrams(F.col("p"), n).alias("g"))
            for n in metrics.ORDERS
        )
    )
    rows = pred_ref(spark, sf).select("id", text.tokens(F.col("pred")).alias("p"))
    long = rows.select("id", F.explode(grams).alias("x")).select(
        "id", "x.n", F.explode("x.g").alias("gram")
    )
    return long.groupBy("id", "n", "gram").agg(F.count("*").alias("copies"))


@query("numbered_copies_f5", R_TEXT + TOK + ", w as (select id, unnest(p) as w, generate_subscripts(p, 1) as i from tok) select id, concat(w, chr(1), row_number() over (partition by id, w order by i) - 1) as copy from w")
def _(spark, sf):
    rows = pred_ref(spark, sf)
    return rows.select("id", F.explode(numbered(text.tokens(F.col("pred")))).alias("copy"))


# Several references: the assistant's turns of the conversation, for each turn
# of the user.
MANY = f"""with rf as (select conv_id, list(text order by turn) as refs from conversations where role = 'assistant' group by conv_id),
u as (select concat('c', c.conv_id, '-', turn) as id, {d_tokens('text')} as p, list_transform(refs, lambda x: {d_tokens('x')}) as rs from conversations c join rf using (conv_id) where role = 'user')"""


def many_references(spark, sf):
    rows = table(spark, sf, "conversations")
    answers = rows.where("role = 'assistant'")
    refs = ranking.gather(
        answers, ["conv_id"], ["turn"], ["turn", "text"], ranking.hot_keys(answers, ["conv_id"])
    ).select("conv_id", F.col("items.text").alias("ref"))
    users = rows.where("role = 'user'").select(
        "conv_id",
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"),
        F.col("text").alias("pred"),
    )
    return users.join(refs, "conv_id").drop("conv_id")


@query("closest_length_w7", MANY + " select id, (list_sort(list_transform(rs, lambda x: {'d': abs(len(x) - len(p)), 'n': len(x)}))[1]).n::bigint as ref_len, len(p)::bigint as pred_len from u")
def _(spark, sf):
    rows = many_references(spark, sf).select(
        "id",
        F.size(text.tokens(F.col("pred"))).alias("p"),
        F.transform("ref", lambda r: F.size(text.tokens(r))).alias("r"),
    )
    return rows.select(
        "id",
        metrics.closest_length(F.col("p"), F.col("r")).cast("bigint").alias("ref_len"),
        F.col("p").cast("bigint").alias("pred_len"),
    )


@query("bleu_many_references_a4", MANY + """,
pg as (select id, n, g, count(*) as c from (select id, n, unnest(list_transform(generate_series(1, len(p) - n + 1), lambda i: array_to_string(p[i:i + n - 1], ' '))) as g from u, (select unnest([1, 2, 3, 4]) as n) k) group by all),
one as (select id, unnest(rs) as r, generate_subscripts(rs, 1) as which from u),
rg as (select id, n, g, max(c) as c from (select id, which, n, g, count(*) as c from (select id, which, n, unnest(list_transform(generate_series(1, len(r) - n + 1), lambda i: array_to_string(r[i:i + n - 1], ' '))) as g from one, (select unnest([1, 2, 3, 4]) as n) k) group by all) group by all),
hit as (select n, sum(least(pg.c, rg.c)) as m from pg join rg using (id, n, g) group by n),
len2 as (select len(p) as pl, (list_sort(list_transform(rs, lambda x: {'d': abs(len(x) - len(p)), 'n': len(x)}))[1]).n as rl from u),
poss as (select n, sum(greatest(pl - n + 1, 0)) as t, sum(pl) as pl, sum(rl) as rl from len2, (select unnest([1, 2, 3, 4]) as n) k group by n)
select round(100 * exp(avg(ln((coalesce(m, 0) + 1e-9::double) / (t + 1e-9::double)))) * case when any_value(pl) < any_value(rl) then exp(1 - any_value(rl) / any_value(pl)::double) else 1 end, 6) as bleu from poss left join hit using (n)""")
def _(spark, sf):
    return rounded(metrics.corpus_bleu(many_references(spark, sf)), "bleu")


@query("rouge_l_a5_f6", R_TEXT + TOK + LCS + " select split, task, round(rouge_l, 6) as rouge_l from rouge")
def _(spark, sf):
    return rounded(metrics.rouge_l(pred_ref(spark, sf), ("split", "task")), "rouge_l")


@query("common_subsequence_f6", R_TEXT + TOK + LCS + " select id, coalesce(lcs, 0)::bigint as lcs from tok left join dp using (split, task, id)")
def _(spark, sf):
    return pred_ref(spark, sf).select(
        "id",
        text.common_subsequence(text.tokens(F.col("pred")), text.tokens(F.col("ref"))).alias("lcs"),
    )


@query("meteor_a6_w8", R_TEXT + METEOR + " select split, task, round(meteor, 6) as meteor from meteor")
def _(spark, sf):
    return rounded(metrics.meteor(pred_ref(spark, sf), ("split", "task")), "meteor")


# --- triples ---------------------------------------------------------------

SIDES = """,
base as (select distinct film, s, p, o from tri),
h as (select film as id, s, p, o, md5(concat_ws('|', s, p, o)) as h from base),
sides as (select film as id, 'ref' as side, s, p, o from base union all
  select id, 'pred', s, p, case when substr(h, 1, 1) in ('2', '3') then concat(o, '_x') else o end from h where substr(h, 1, 1) not in ('0', '1')),
member as (select id, s, p, o, bool_or(side = 'pred') as in_pred, bool_or(side = 'ref') as in_ref from sides group by all),
counts as (select count(*) filter (in_pred and in_ref) as tp, count(*) filter (in_pred and not in_ref) as fp, count(*) filter (in_ref and not in_pred) as fn from member)"""
PRF = "select tp, fp, fn, round(100.0 * tp / (tp + fp), 6)::double as precision, round(100.0 * tp / (tp + fn), 6)::double as recall, round(200.0 * tp / (2 * tp + fp + fn), 6)::double as f1 from counts"


def sides(spark, sf):
    """Reference and predicted triples in long form."""
    return _sides(spark, sf)[0]


def _sides(spark, sf):
    """The same with the entities that are hot: both sides together have no more
    than twice the triples. If none is, rows are laid out by entity once, for all
    that follows."""
    from checks.build import triples

    rows = triples(spark, sf).select(F.col("film").alias("id"), "s", "p", "o")
    hot = ranking.hot_keys(rows, ["id"], ranking.HOT_ROWS // 2)
    base = ranking.laid_by(rows, ["id"], hot, 2 * rows.count()).distinct()
    first = F.substr(F.md5(F.concat_ws("|", "s", "p", "o")), F.lit(1), F.lit(1))
    changed = F.when(first.isin("2", "3"), F.concat("o", F.lit("_x"))).otherwise(F.col("o"))
    ref = F.struct("o", F.lit("ref").alias("side"))
    pred = F.struct(changed.alias("o"), F.lit("pred").alias("side"))
    both = F.when(first.isin("0", "1"), F.array(ref)).otherwise(F.array(ref, pred))
    return base.select("id", "s", "p", F.explode(both).alias("x")).select("id", "s", "p", "x.o", "x.side"), hot


def lines(spark, sf):
    """The same as linearised texts, one row per entity."""
    long, hot = _sides(spark, sf)
    order = ["side", "p", "o", "s"]
    items = ranking.gather(long, ["id"], order, order, hot)

    def of(side):
        return rdf.linearize(F.filter("items", lambda t: t["side"] == side))

    return items.select("id", of("pred").alias("pred"), of("ref").alias("ref"))


@query("triple_scores_a7", TRI + SIDES + PRF)
def _(spark, sf):
    return rounded(metrics.triple_scores(lines(spark, sf)), "precision", "recall", "f1")


@query("triple_scores_long_a7", TRI + SIDES + PRF)
def _(spark, sf):
    sets = metrics.triple_membership(sides(spark, sf))
    return rounded(metrics.membership_scores(sets), "precision", "recall", "f1")


@query("triple_sets_u4_f3", TRI + SIDES + "select id, s, p, o, in_pred, in_ref from member")
def _(spark, sf):
    return metrics.triple_sets(lines(spark, sf))


@query("accuracy_a8", duck_with("pred_ref_label") + f" select split, task, round(100 * avg(({d_strip('coalesce(pred, chr(32))')} = {d_strip('coalesce(ref, chr(32))')})::int), 6) as accuracy from pred_ref_label group by split, task")
def _(spark, sf):
    return rounded(metrics.accuracy(labels(spark, sf), ("split", "task")), "accuracy")


# --- all tasks -------------------------------------------------------------

CLEAN = "array_to_string(list_filter({t}, lambda w: w <> '<pad>'), ' ')"


def d_clean(x):
    return CLEAN.format(t=d_tokens(x))


# Texts, labels and linearised triples as one table of predictions. Padding is
# put into some predictions, which the cleaning takes out again.
ALL = TRI + SIDES + "," + duck_with("pred_ref_text", "pred_ref_label")[5:] + f""",
tl as (select id, coalesce(string_agg(concat('<SOT> <SUBJ> ', s, ' <PRED> ', p, ' <OBJ> ', o, ' <EOT>'), ' ' order by p, o, s) filter (side = 'pred'), '') as pred,
  string_agg(concat('<SOT> <SUBJ> ', s, ' <PRED> ', p, ' <OBJ> ', o, ' <EOT>'), ' ' order by p, o, s) filter (side = 'ref') as ref from sides group by id),
every as (select id, task, split, case when id like '%1' then concat('<pad> ', pred, chr(10), '<pad>') else pred end as pred, ref from pred_ref_text union all select id, task, split, pred, ref from pred_ref_label
  union all select id, case when id like '%3' then 'rdfcomp2' else 'text2rdf' end, case when id like '%2' then 'val' else 'test' end, pred, ref from tl),
r as (select id, task, split, {d_clean('pred')} as pred, {d_clean('ref')} as ref from every)"""

BY_TASK = (
    ALL
    + ", r0 as (select * from r), rt as (select * from r where task in ('rdf2text', 'unknown'))"
    + TOK.replace("from r)", "from rt)")
    + GRAMS
    + LCS
    + METEOR.replace("from r)", "from rt)")
    + """,
tm as (select r0.split, r0.task, m.* from member m join r0 on r0.id = m.id and r0.task in ('text2rdf', 'rdfcomp2')),
tc as (select split, task, count(*) filter (in_pred and in_ref) as tp, count(*) filter (in_pred and not in_ref) as fp, count(*) filter (in_ref and not in_pred) as fn from tm group by all),
scores as (select split, task, 'bleu' as metric, bleu as value from bleu union all select split, task, 'rouge_l', rouge_l from rouge union all select split, task, 'meteor', meteor from meteor
  union all select split, task, 'precision', 100.0 * tp / (tp + fp) from tc union all select split, task, 'recall', 100.0 * tp / (tp + fn) from tc union all select split, task, 'f1', 200.0 * tp / (2 * tp + fp + fn) from tc
  union all select split, task, 'accuracy', 100 * avg((pred = ref)::int) from r0 where task = 'rdfcomp1' group by split, task
  union all select split, task, 'samples', count(*)::double from r0 group by split, task)"""
)


def every(spark, sf):
    lin = lines(spark, sf).select(
        "id",
        F.when(F.endswith("id", F.lit("3")), "rdfcomp2").otherwise("text2rdf").alias("task"),
        F.when(F.endswith("id", F.lit("2")), "val").otherwise("test").alias("split"),
        "pred",
        "ref",
    )
    padded = F.concat(F.lit("<pad> "), "pred", F.lit("\n<pad>"))
    texts = pred_ref(spark, sf).withColumn(
        "pred", F.when(F.endswith("id", F.lit("1")), padded).otherwise(F.col("pred"))
    )
    return texts.unionByName(labels(spark, sf)).unionByName(lin)


@query("metrics_by_task_a9", BY_TASK + " select split, task, metric, round(value, 6)::double as value from scores")
def _(spark, sf):
    return rounded(metrics.metrics_by_task(report.cleaned(every(spark, sf))), "value")


@query("clean_prediction_p13", ALL + " select id, pred, ref from r")
def _(spark, sf):
    return report.cleaned(every(spark, sf)).select("id", "pred", "ref")


LOSS = duck_with("batch_log") + """,
tl as (select split, task, avg(loss) as loss, sum(n)::bigint as num_samples from batch_log group by split, task),
sl as (select split, sum(loss * num_samples) / sum(num_samples) as avg_loss, sum(num_samples)::bigint as num_samples from tl group by split)"""


def log(spark, sf):
    return spark_view(spark, sf, "batch_log")


@query("task_loss_a11", LOSS + " select split, task, round(loss, 6) as loss, num_samples from tl")
def _(spark, sf):
    return rounded(report.task_losses(log(spark, sf)), "loss")


@query("split_loss_a10", LOSS + " select split, round(avg_loss, 6) as avg_loss, num_samples from sl")
def _(spark, sf):
    return rounded(report.split_losses(report.task_losses(log(spark, sf))), "avg_loss")


@query("epoch_means_a11", duck_with("batch_log") + """, l as (select batch % 5 as epoch, 'loss' as metric, loss as value from batch_log union all select batch % 5, 'mask_accuracy', case when n % 2 = 0 then 1 / n::double end from batch_log)
select epoch, metric, round(avg(value), 6) as value from l where value is not null group by epoch, metric""")
def _(spark, sf):
    rows = log(spark, sf).select(
        (F.col("batch") % 5).alias("epoch"),
        F.col("loss"),
        F.when(F.col("n") % 2 == 0, 1 / F.col("n")).alias("mask_accuracy"),
    )
    long = rows.unpivot("epoch", ["loss", "mask_accuracy"], "metric", "value")
    return rounded(report.epoch_means(long), "value")


REPORT = (
    BY_TASK
    + ","
    + LOSS[5:].replace("tl as", "tloss as").replace("from tl ", "from tloss ")
    + """,
rep as (select split, task, task as inner_task, metric, value from scores
  union all select split, task, null, 'loss', loss from tloss union all select split, task, null, 'num_samples', num_samples from tloss
  union all select split, null, null, 'avg_loss', avg_loss from sl union all select split, null, null, 'num_samples', num_samples from sl)"""
)


def evaluation(spark, sf):
    return report.evaluation(every(spark, sf), log(spark, sf))


@query("report_rows_s11", REPORT + " select split, task, inner_task, metric, round(value, 6)::double as value from rep")
def _(spark, sf):
    return rounded(evaluation(spark, sf).withColumnRenamed("inner", "inner_task"), "value")


@query("flat_report_a16", REPORT + " select concat_ws('/', split, task, inner_task, metric) as key, round(value, 6)::double as value from rep where metric <> 'num_samples'")
def _(spark, sf):
    return rounded(report.flatten_report(evaluation(spark, sf)), "value")


@query("report_json_s11", LOSS + " select tl.split, tl.task, round(loss, 6) as loss, tl.num_samples, round(avg_loss, 6) as avg_loss from tl join sl using (split)")
def _(spark, sf):
    whole = report.report_json(evaluation(spark, sf))
    shape = "struct<splits:map<string,struct<tasks:map<string,struct<loss:double,num_samples:bigint>>,avg_loss:double>>>"
    splits = whole.select(F.explode(F.from_json("report", shape)["splits"]).alias("split", "v"))
    cells = splits.select("split", "v.avg_loss", F.explode("v.tasks").alias("task", "t"))
    # Tasks that only have scores are in the report, too.
    cells = cells.where("t.loss is not null")
    return rounded(cells.select("split", "task", "t.loss", "t.num_samples", "avg_loss"), "loss", "avg_loss")


def report_metrics(whole):
    shape = "struct<splits:map<string,struct<tasks:map<string,struct<metrics:map<string,map<string,double>>>>>>>"
    splits = whole.select(F.explode(F.from_json("report", shape)["splits"]).alias("split", "v"))
    cells = splits.select("split", F.explode("v.tasks").alias("task", "t"))
    inner = cells.select("split", "task", F.explode("t.metrics").alias("inner_task", "m"))
    return rounded(inner.select("split", "task", "inner_task", F.explode("m").alias("metric", "value")), "value")


@query("report_scores_only_s11", BY_TASK + " select split, task, task as inner_task, metric, round(value, 6)::double as value from scores")
def _(spark, sf):
    return report_metrics(report.report_json(report.evaluation(every(spark, sf), log(spark, sf).limit(0))))


@query("report_metrics_s11", BY_TASK + " select split, task, task as inner_task, metric, round(value, 6)::double as value from scores")
def _(spark, sf):
    rows = every(spark, sf)
    batches = rows.select("split", "task", F.length("ref").alias("loss"), F.lit(1).alias("n"))
    return report_metrics(report.report_json(report.evaluation(rows, batches)))


# --- alignment -------------------------------------------------------------


def halves(spark, sf):
    rows = labels(spark, sf)
    preds = rows.where(~F.endswith("id", F.lit("3"))).select("id", "pred")
    refs = rows.where(~F.endswith("id", F.lit("7"))).select("id", "ref", "task", "split")
    return preds, refs


@query("unmatched_j8", duck_with("pred_ref_label") + " select count(*) filter (id like '%7') as without_reference, count(*) filter (id like '%3') as without_prediction, 0::bigint as repeated from pred_ref_label")
def _(spark, sf):
    return report.unmatched(*halves(spark, sf))


@query("align_j8", duck_with("pred_ref_label") + " select id, pred, ref, task, split from pred_ref_label")
def _(spark, sf):
    rows = labels(spark, sf)
    return report.align(rows.select("id", "pred"), rows.drop("pred"))


@query("predict_ud1", "select concat('c', conv_id, '-', turn) as id, length(text)::varchar as pred from conversations")
def _(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), F.col("text").alias("input")
    )

    def lengths(batches):
        for batch in batches:
            batch["pred"] = batch["input"].str.len().astype(str)
            yield batch[["id", "pred"]]

    return report.predict(rows, lengths)


# Token lengths stand for ids; without the letter e some words change.
@query("span_accuracy_a12", f"""with t as (select doc_id, list_transform({d_tokens('text')}, lambda w: length(w)) as labels, list_transform({d_tokens('text')}, lambda w: length(replace(w, 'e', ''))) as preds from documents),
s as (select labels, preds, unnest(generate_series(-1, len(labels), 3)) as st from t),
v as (select labels[st + 1:st + 2] as a, preds[st + 1:st + 2] as b from s where st >= 0 and st + 2 <= len(labels) and not list_contains(labels[st + 1:st + 2], 2))
select count(*) as spans, round(avg((a = b)::int), 6) as mask_accuracy from v""")
def _(spark, sf):
    words = table(spark, sf, "documents").select(text.tokens(F.col("text")).alias("w"))
    rows = words.select(
        F.transform("w", F.length).alias("labels"),
        F.transform("w", lambda w: F.length(F.replace(w, F.lit("e"), F.lit("")))).alias("pred_ids"),
        F.transform(
            F.sequence(F.lit(-1), F.size("w"), F.lit(3)),
            lambda i: F.struct(i.alias("start"), F.lit(2).alias("len")),
        ).alias("spans"),
    )
    return rounded(metrics.span_accuracy(rows, pad_id=2), "mask_accuracy")
