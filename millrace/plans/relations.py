"""Queries over conversations, labels, events and trees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import metrics, qa, reports, tree
from millrace.plans.catalogue import query
from millrace.session import table
from millrace.sources import files

_PAIRS = """with t as (select conv_id, turn, role, text as question, lead(role) over w as next_role, lead(text) over w as answer from conversations window w as (partition by conv_id order by turn))
select conv_id, turn, question, answer from t where role = 'user' and next_role = 'assistant'"""


def _pairs(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations")
    rows = turns.select("conv_id", "turn", "role", F.col("text").alias("question"), F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("answer"))
    return rows.where("role = 'user' and next_role = 'assistant'").select("conv_id", "turn", "question", "answer")


@query("qa_pairs", _PAIRS)
def qa_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)


@query("qa_joined", f"with p as ({_PAIRS}), a as (select question, answer, row_number() over (partition by question order by conv_id * 1000 + turn desc) as n from p) select p.question, p.conv_id, p.turn, a.answer from p join a on p.question = a.question and a.n = 1")
def qa_joined(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    answers = p.select("question", "answer", (F.col("conv_id") * 1000 + F.col("turn")).alias("at"))
    return qa.pair(p.select("question", "conv_id", "turn"), answers, "at")


@query("qa_pending", f"select conv_id, turn, text as question from conversations where role = 'user' and text not in (select question from ({_PAIRS}) where question is not null)")
def qa_pending(spark, sf_dir):
    """Questions whose text nobody has answered."""
    users = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    return qa.pending(users, _pairs(spark, sf_dir)).select("conv_id", "turn", "question")


@query("qa_labelled", "select d.doc_id, coalesce(cast(l.quality as varchar), '') as label from documents d left join labels l using (doc_id)")
def qa_labelled(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("question"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question"), F.col("quality").cast("string").alias("label"))
    return qa.labelled(docs, labels).select(F.col("question").alias("doc_id"), "label")


@query("qa_review", "select doc_id, quality from labels where toxic = 0 and quality * 4 >= 4")
def qa_review(spark, sf_dir):
    """Replies on toxic documents refuse, and so are rejections; the others are bare or fenced JSON."""
    rows = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    bare, fenced = F.format_string('{"score": %d, "reason": "x"}', F.col("quality") * 4), F.format_string('Here:\n```json\n{"score": %d}\n```', F.col("quality") * 4)
    reply = F.when(F.col("toxic") == 1, "no score").when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, bare).otherwise(fenced)
    return qa.reviewed(rows.withColumn("reply", reply), F.col("reply")).select("doc_id", "quality")


@query("qa_transcripts", "select conv_id, string_agg(upper(role) || ': ' || coalesce(text, ''), chr(10) || chr(10) order by turn) as transcript from conversations group by conv_id")
def qa_transcripts(spark, sf_dir):
    return qa.transcripts(table(spark, sf_dir, "conversations"))


@query("sharegpt", """with t as (select conv_id, to_json(list({'from': case role when 'user' then 'human' when 'assistant' then 'gpt' else role end, 'value': text} order by turn)) as conversations from conversations where role <> 'system' group by conv_id),
s as (select conv_id, min_by(text, turn) as system from conversations where role = 'system' group by conv_id) select t.conv_id, cast(t.conversations as varchar) as conversations, s.system from t left join s using (conv_id)""")
def sharegpt(spark, sf_dir):
    return qa.sharegpt(table(spark, sf_dir, "conversations")).select("conv_id", F.to_json("conversations").alias("conversations"), "system")


@query("qa_format", "select conv_id, count(*) >= 2 and bool_or(role = 'user') and bool_or(role = 'assistant') as valid from conversations group by conv_id")
def qa_format(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(((F.count("*") >= 2) & F.bool_or(F.col("role") == "user") & F.bool_or(F.col("role") == "assistant")).alias("valid"))


_TREE = "select r_name as label, r_name as path from region union all select n_name, r_name || '/' || n_name from nation join region on n_regionkey = r_regionkey"


@query("tree_paths", f"select label, path, cast(len(path) - len(replace(path, '/', '')) as int) as depth from ({_TREE})")
def tree_paths(spark, sf_dir):
    top = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("label"))
    leaf = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("label"))
    return tree.paths(top.unionByName(leaf)).select("label", "path", "depth")


@query("stage_report", """with s as (select event_type as stage, count(*) as requests, sum(greatest(coalesce(value, 0), 0)) as seconds, cast(sum(coalesce(user_id, 0)) as bigint) as tokens from events group by event_type)
select stage, requests, round(seconds, 3) as seconds, tokens, round(case when seconds > 0 then requests / seconds else 0 end, 6) as items_per_second, round(case when seconds > 0 then 60 * requests / seconds else 0 end, 6) as requests_per_minute,
round(case when seconds > 0 then tokens / seconds else 0 end, 6) as tokens_per_second, round(case when requests > 0 then tokens / requests else 0 end, 6) as tokens_per_request from s""")
def stage_report(spark, sf_dir):
    got = metrics.stage_report(table(spark, sf_dir, "events"), "event_type", "value", "user_id")
    return got.select("stage", "requests", F.round("seconds", 3).alias("seconds"), "tokens", *[F.round(c, 6).alias(c) for c in got.columns[4:]])


@query("totals_rollup", "select event_type, count(*) as n, count(distinct user_id) as users, round(sum(value), 3) as total from events group by rollup (event_type)")
def totals_rollup(spark, sf_dir):
    return table(spark, sf_dir, "events").rollup("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.sum("value"), 3).alias("total"))


@query("pass_rate", "select event_type, count(*) filter (where value > 50) as passed, round(100.0 * count(*) filter (where value > 50) / count(*), 6) as rate from events group by event_type")
def pass_rate(spark, sf_dir):
    got = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("passed"), F.count("*").alias("n"))
    return got.select("event_type", "passed", F.round(100 * metrics.ratio(F.col("passed"), F.col("n")), 6).alias("rate"))


@query("request_gaps", "select event_id, coalesce(cast(floor(epoch(ts)) - floor(epoch(lag(ts) over (partition by user_id order by ts, event_id))) as bigint), -1) as gap_s from events")
def request_gaps(spark, sf_dir):
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    rows = reports.previous(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", ["ts", "event_id"], "ts", "before")
    return rows.select("event_id", F.coalesce(seconds("ts") - seconds("before"), F.lit(-1)).alias("gap_s"))


@query("route_formats", "select page_id, lower(regexp_extract(url || '.PDF', '\\.([A-Za-z0-9]+)$', 1)) as extension, 'pdf' as kind from pages")
def route_formats(spark, sf_dir):
    path = F.concat("url", F.lit(".PDF"))
    return table(spark, sf_dir, "pages").select("page_id", files.extension(path).alias("extension"), files.route(path).alias("kind"))
