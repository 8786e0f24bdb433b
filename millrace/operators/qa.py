"""Question and answer rows: joins, review, transcripts, and generation through a pluggable client."""

from __future__ import annotations

import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import tree
from millrace.session import settle, share_code

#: Statuses after which a request may be sent again (fixed values).
RETRIED = (408, 409, 425, 429, 500, 502, 503, 504)


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last by ``order``; of ties the greatest by the other columns. Rows are reduced before they are shuffled."""
    others = [c for c in df.columns if c not in (key, order)]
    plain = not any(x in df.schema[c].dataType.simpleString() for c in others for x in ("map<", "variant"))  # these have no order
    row = F.struct(order, *others)
    last = df.groupBy(key).agg((F.max(row) if plain else F.max_by(row, order)).alias("__last"))
    return last.select(*[F.col(c) if c == key else F.col(f"__last.{c}") for c in df.columns])


def pair(questions: DataFrame, answers: DataFrame, order: str) -> DataFrame:
    """Questions with the last answer to their text; repeated questions stay, unanswered ones go."""
    return questions.join(latest(answers, "question", order).drop(order), "question")


def pending(questions: DataFrame, answered: DataFrame) -> DataFrame:
    return questions.join(answered.select("question"), "question", "left_anti")


def labelled(questions: DataFrame, labels: DataFrame) -> DataFrame:
    return questions.join(labels, "question", "left").withColumn("label", F.coalesce("label", F.lit("")))


def reviewed(df: DataFrame, reply: Column, least: float = 4) -> DataFrame:
    """Rows whose review, JSON with a score, reaches ``least``; replies that can't be read are rejections."""
    score = F.get_json_object(json_of(reply), "$.score").try_cast("double")
    return df.where(F.coalesce(score >= least, F.lit(False)))


def json_of(c: Column) -> Column:
    """JSON in a model's reply: the whole, else a fenced block, else from the first bracket to the last; null if none parses."""
    whole, fenced = F.trim(c), F.nullif(F.regexp_extract(c, "(?s)```json[ \\t\\r\\n]*(.*?)```", 1), F.lit(""))
    listed = F.nullif(F.regexp_extract(c, "(?s)(\\[.*\\])", 1), F.lit(""))
    objected = F.nullif(F.regexp_extract(c, "(?s)(\\{.*\\})", 1), F.lit(""))
    return F.coalesce(*[F.when(F.try_parse_json(x).isNotNull(), x) for x in (whole, fenced, listed, objected)])


def transcripts(turns: DataFrame) -> DataFrame:
    """(conv_id, transcript): role and text of each turn in order, by blank lines."""
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat(F.upper("role"), F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n").alias("transcript"))


def sharegpt(turns: DataFrame) -> DataFrame:
    """(conv_id, conversations, system): turns as from/value pairs in order."""
    name = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    rows = turns.where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", name.alias("from"), F.col("text").alias("value")))).alias("t"))
    system = turns.where("role = 'system'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("system"))
    talk = F.transform("t", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value")))
    return rows.join(system, "conv_id", "left").select("conv_id", talk.alias("conversations"), "system")


# --- a model behind a client ------------------------------------------------


class CallError(Exception):
    """A failed request: its status, None for no answer at all, its text, and the seconds after which the service wants to be asked again."""

    def __init__(self, status: int | None = None, body: str = "", retry_after: float | None = None) -> None:
        super().__init__(f"{status} {body[:200]}")
        self.status, self.body, self.retry_after = status, body, retry_after


def may_retry(error: Exception) -> bool:
    """As ``filters.retryable`` says of a status and a text. Other errors than failed requests are not tried again."""
    if isinstance(error, (ConnectionError, TimeoutError)):
        return True
    if not isinstance(error, CallError):
        return False
    return error.status is None or error.status in RETRIED or (error.status == 400 and "rate" in error.body.lower())


def backoff(attempt: int, retry_after: float | None = None, base: float = 1.0, factor: float = 2.0, least: float = 0.5, most: float = 30.0) -> float:
    """Seconds before the next try: what the service asks for, else growing with the attempts, both bounded."""
    if retry_after is not None:
        return min(max(retry_after, 0.0), most)
    return min(max(base * factor ** (attempt - 1), least), most)


def complete(
    df: DataFrame, prompt: str, client: Callable[[], Callable], out: str = "reply", tries: int = 5, qps: float | None = None, usage: bool = False, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic
) -> DataFrame:
    """``df`` with a model's reply to the column ``prompt``, null where no try succeeded; settled, so that each request is paid for once.

    ``client`` makes a function on the worker that takes a prompt, or the array of
    (role, content) messages if ``prompt`` is one, and gives the reply, or a dict with
    ``reply``, ``prompt_tokens`` and ``completion_tokens``. ``qps`` is shared out evenly
    over the partitions; requests of one are as far apart as that asks for. With
    ``usage``, columns of attempts, seconds, tokens and the last error follow.
    """
    share_code(df.sparkSession)
    more = [("attempts", T.IntegerType()), ("seconds", T.DoubleType()), ("prompt_tokens", T.LongType()), ("completion_tokens", T.LongType()), ("error", T.StringType())] if usage else []
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType()), *[T.StructField(f"{out}_{n}", k) for n, k in more]])
    gap = df.rdd.getNumPartitions() / qps if qps else 0.0

    def run(batches):
        ask, free = client(), 0.0
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch, rows = whole.slice(at, 64), []
                for given in batch.column(batch.schema.get_field_index(prompt)).to_pylist():
                    got, error, attempt, start = {}, None, 0, clock()
                    while attempt < tries:
                        attempt += 1
                        if gap:
                            sleep(max(0.0, free - clock()))
                            free = max(free, clock()) + gap
                        try:
                            reply = ask(given)
                            got, error = (reply if isinstance(reply, dict) else {"reply": reply}), None
                            break
                        except Exception as e:
                            error = f"{type(e).__name__}: {e}"
                            if not may_retry(e):
                                break
                            if attempt < tries:
                                sleep(backoff(attempt, getattr(e, "retry_after", None)))
                    rows.append((got.get("reply"), attempt, float(clock() - start), got.get("prompt_tokens"), got.get("completion_tokens"), error))
                kinds = [pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.string()][: 1 + len(more)]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema.names)

    return settle(df.mapInArrow(run, schema), "replies")


def resumed(rows: DataFrame, path: str, key: str, ask: Callable[[DataFrame], DataFrame], resume: bool = True) -> DataFrame:
    """``ask`` of those rows whose key has no answer in the table at ``path`` yet, appended to it; then all answers to ``rows``.

    Answers are appended in one commit, so a run that is broken off leaves what
    earlier runs gave. ``resume=False`` forgets them. A key that is there twice has
    the answer given last.
    """
    spark, done = rows.sparkSession, None
    if resume:
        try:
            done = spark.read.parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                raise
    todo = rows if done is None else rows.join(done.select(key), key, "left_anti")
    run = 0 if done is None else (done.agg(F.max("__run")).first()[0] or 0) + 1
    ask(todo).withColumn("__run", F.lit(run)).write.mode("overwrite" if done is None else "append").parquet(path)
    answers = latest(spark.read.parquet(path), key, "__run").drop("__run")
    return answers.join(rows.select(key).distinct(), key, "left_semi")


# --- prompts: our own words; inputs and form of the reply are what counts ---


def question_prompt(text: Column, count: int = 5, field: str = "") -> Column:
    about = f" for readers in the field of {field}" if field else ""
    return F.concat(F.lit(f"Write up to {count} questions{about} that the text answers, as a JSON list of strings.\n\n"), text)


def answer_prompt(question: Column, text: Column) -> Column:
    return F.concat(F.lit("Answer from the text only.\n\nQuestion: "), question, F.lit("\n\nText: "), text)


def review_prompt(question: Column, answer: Column) -> Column:
    return F.concat(F.lit('Score the answer from 1 to 5 as JSON {"score": n, "reason": "..."}.\n\nQuestion: '), question, F.lit("\n\nAnswer: "), answer)


def label_prompt(question: Column, labels: list[str]) -> Column:
    return F.concat(F.lit("Choose the one label that fits the question best and reply with it alone. Labels: " + "; ".join(labels) + "\n\nQuestion: "), question)


def tree_prompt(texts: list[str]) -> str:
    return 'Draw up a tree of topics of these texts as a JSON list of {"label": "...", "child": [...]}.\n\n' + "\n\n".join(texts)


def image_prompt(text: Column, images: Column, count: int = 5) -> Column:
    return F.concat(F.repeat(F.lit("<image>"), F.size(images)), F.lit(f"\nWrite up to {count} questions on the images and the text, as a JSON list of strings.\n\n"), text)


# --- generation -------------------------------------------------------------


def questions_of(chunks: DataFrame, client, text: str = "chunk", per_chunk: int = 5, field: str = "", **options) -> DataFrame:
    """A row a question, with a qid that depends on chunk and question only; chunks without a readable reply give none."""
    asked = complete(chunks.withColumn("__p", question_prompt(F.col(text), per_chunk, field)), "__p", client, "__r", **options)
    rows = asked.select("*", F.explode(F.slice(F.from_json(json_of(F.col("__r")), "array<string>"), 1, per_chunk)).alias("question")).where("question is not null")
    return rows.withColumn("qid", F.sha2(F.concat_ws("\n", text, "question"), 256)).drop("__p", "__r").dropDuplicates(["qid"])


def tagged(questions: DataFrame, client, labels: list[str], fallback: str = "other", **options) -> DataFrame:
    """``questions`` with a label: the model's choice where it is one of ``labels``, else ``fallback``."""
    asked = complete(questions.withColumn("__p", label_prompt(F.col("question"), labels)), "__p", client, "__r", **options)
    chosen = F.trim("__r")
    return asked.withColumn("label", F.when(chosen.isin(labels), chosen).otherwise(fallback)).drop("__p", "__r")


def tree_rows(reply: str) -> list[tuple] | None:
    """(node_id, parent_id, label, ordinal) of a JSON tree of labels; None where the reply has none."""
    import json
    import re

    for found in (reply, *re.findall(r"(?s)```json\s*(.*?)```", reply), *re.findall(r"(?s)\[.*\]", reply)):
        try:
            tree = json.loads(found)
        except ValueError:
            continue
        rows: list[tuple] = []

        def put(nodes, parent) -> None:
            for k, node in enumerate(nodes if isinstance(nodes, list) else []):
                if isinstance(node, dict) and isinstance(node.get("label"), str):
                    rows.append((len(rows) + 1, parent, node["label"], k))
                    put(node.get("child"), rows[-1][0])

        put(tree, None)
        if rows:
            return rows
    return None


def label_tree(spark, texts: list[str], client, tries: int = 10) -> DataFrame | None:
    """A tree of topics from one request on the driver; None if no try gives one, and the run goes on without labels."""
    ask = client()
    for _ in range(tries):
        try:
            reply = ask(tree_prompt(texts))
        except Exception as e:
            if not may_retry(e):
                return None
            continue
        if rows := tree_rows(reply["reply"] if isinstance(reply, dict) else reply):
            return spark.createDataFrame(rows, "node_id long, parent_id long, label string, ordinal int")
    return None


def generate_pairs(
    chunks: DataFrame, client, text: str = "chunk", per_chunk: int = 5, least_score: float = 4, nodes: DataFrame | None = None, checkpoint: str | None = None, resume: bool = True, **options
) -> DataFrame:
    """(qid, instruction, input, output, label, tag_path, context): questions on each chunk, labelled by a tree if there is one, an answer to each, and only pairs whose review passes."""
    rows = questions_of(chunks, client, text, per_chunk, **options)
    if nodes is not None:
        places = tree.first_paths(nodes).select("label", F.col("path").alias("tag_path"))
        names = sorted(r.label for r in places.select("label").collect())  # a label tree is small metadata
        rows = tagged(rows, client, names, **options).join(places, "label", "left")
    else:
        rows = rows.withColumn("label", F.lit("")).withColumn("tag_path", F.lit(None).cast("string"))

    def answered(some: DataFrame) -> DataFrame:
        got = complete(some.withColumn("__p", answer_prompt(F.col("question"), F.col(text))), "__p", client, "answer", **options).where("answer is not null")
        got = complete(got.withColumn("__p", review_prompt(F.col("question"), F.col("answer"))), "__p", client, "review", **options)
        return got.drop("__p")

    done = answered(rows) if checkpoint is None else resumed(rows, checkpoint, "qid", answered, resume)
    kept = reviewed(done, F.col("review"), least_score)
    return kept.select("qid", F.col("question").alias("instruction"), F.lit("").alias("input"), F.col("answer").alias("output"), "label", "tag_path", F.col(text).alias("context"))


# --- tool episodes, simulated ------------------------------------------------


def simulate_calls(episodes: DataFrame, catalog: DataFrame, key: str = "episode_id", tools: str = "tools") -> DataFrame:
    """(episode_id, tool_calls): each proposed tool in order with its path and a made answer; one that is not in the catalogue is recorded as failed, and the episode goes on."""
    rows = episodes.select(key, F.posexplode(tools).alias("pos", "name"))
    known = catalog.select(F.col("identifier").alias("name"), "path")
    ok = F.col("path").isNotNull()
    call = F.struct("pos", "name", "path", F.when(ok, "ok").otherwise("failed").alias("status"), F.when(ok, F.concat(F.lit("simulated answer of "), "name")).otherwise(F.concat(F.lit("unknown tool "), "name")).alias("answer"))
    return rows.join(known, "name", "left").groupBy(key).agg(F.array_sort(F.collect_list(call)).alias("tool_calls"))


def agent_episodes(contexts: DataFrame, catalog: DataFrame, client, key: str = "context_id", text: str = "context", per_context: int = 3, most_tools: int = 5, least_score: float = 4, **options) -> DataFrame:
    """(episode_id, question, tools, tool_calls, final_answer, conversations): questions on each context, the tools proposed for each, their simulated calls, an answer from those, and a review that has to pass.

    ``catalog`` (identifier, path) is small metadata; proposed tools that it lacks are
    recorded as failed calls. The limits are what the model is held to.
    """
    ask = F.concat(F.lit(f"Write up to {per_context} questions that the tools can answer, as a JSON list of strings.\n\n"), F.col(text))
    rows = complete(contexts.withColumn("__p", ask), "__p", client, "__r", **options)
    rows = rows.select(key, text, F.explode(F.slice(F.from_json(json_of(F.col("__r")), "array<string>"), 1, per_context)).alias("question")).where("question is not null")
    rows = rows.withColumn("episode_id", F.sha2(F.concat_ws("\n", F.col(key).cast("string"), "question"), 256))
    rows = complete(rows.withColumn("__p", F.concat(F.lit("Name the tools to call, as a JSON list of their names in order.\n\nQuestion: "), "question", F.lit("\n\n"), text)), "__p", client, "__r", **options)
    none = F.array().cast("array<string>")
    rows = rows.withColumn("tools", F.slice(F.coalesce(F.from_json(json_of(F.col("__r")), "array<string>"), none), 1, most_tools)).drop("__p", "__r")
    rows = rows.join(simulate_calls(rows, catalog, "episode_id"), "episode_id", "left")
    found = F.array_join(F.transform("tool_calls", lambda c: F.concat(c["name"], F.lit(": "), c["answer"])), "\n")
    rows = complete(rows.withColumn("__p", F.concat(F.lit("Answer from what the tools gave.\n\nQuestion: "), "question", F.lit("\n\n"), F.coalesce(found, F.lit("")))), "__p", client, "final_answer", **options)
    rows = complete(rows.where("final_answer is not null").withColumn("__p", review_prompt(F.col("question"), F.col("final_answer"))), "__p", client, "__r", **options)
    said = lambda name, value: F.struct(F.lit(name).alias("from"), value.cast("string").alias("value"))
    calls = F.flatten(F.transform(F.coalesce("tool_calls", F.expr("cast(array() as array<struct<pos:int,name:string,path:string,status:string,answer:string>>)")), lambda c: F.array(said("function_call", c["name"]), said("observation", c["answer"]))))
    talk = F.concat(F.array(said("human", F.col("question"))), calls, F.array(said("gpt", F.col("final_answer"))))
    return reviewed(rows, F.col("__r"), least_score).select("episode_id", "question", "tools", "tool_calls", "final_answer", talk.alias("conversations"))


def crawl_to_report(pages: DataFrame, client, html_col: str = "html", size: int = 500, overlap: int = 100, least_score: float = 4, **options) -> tuple[DataFrame, DataFrame]:
    """(report of one row, pairs kept): pages to text, chunks, questions and answers, reviewed. A stage that gives nothing is an error that names it."""
    from millrace.functions import chunk, html

    def there(df: DataFrame, name: str) -> DataFrame:
        df = settle(df, f"crawl-{name}")
        if df.isEmpty():
            raise ValueError(f"nothing after {name}")
        return df

    texts = there(pages.select(html.text_of(F.col(html_col)).alias("text")).where("text <> ''"), "texts")
    chunks = there(chunk.chunk_rows(texts, "text", size, overlap).select("chunk"), "chunks")
    questions = there(questions_of(chunks, client, **options), "questions")
    answered = complete(questions.withColumn("__p", answer_prompt(F.col("question"), F.col("chunk"))), "__p", client, "answer", **options).where("answer is not null")
    answered = there(complete(answered.withColumn("__p", review_prompt(F.col("question"), F.col("answer"))), "__p", client, "review", **options).drop("__p"), "answers")
    kept = settle(reviewed(answered, F.col("review"), least_score), "crawl-kept")
    passed = reviewed(answered.select("review", F.lit(1).alias("kept")), F.col("review"), least_score).select("kept")
    report = answered.select(F.lit(1).alias("pair"), F.lit(None).cast("int").alias("kept")).unionByName(passed.select(F.lit(None).cast("int").alias("pair"), "kept")).agg(F.count("pair").alias("pairs"), F.count("kept").alias("kept"))
    return report.withColumn("pass_rate", F.when(F.col("pairs") > 0, F.col("kept") / F.col("pairs")).otherwise(0.0)), kept
