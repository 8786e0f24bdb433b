"""Generation with a fake client: retries, rates, checkpoints, labels, trees; crawled records, images, streams."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions import filters
from millrace.operators import crawl, images, metrics, qa, tree
from millrace.streaming import ingest

NODES = "node_id long, parent_id long, label string, ordinal int"


def test_retry_policy(spark):
    for error, again in ((qa.CallError(), True), (qa.CallError(429), True), (qa.CallError(400, "Rate limit"), True), (qa.CallError(400, "bad"), False), (qa.CallError(401), False), (TimeoutError(), True), (KeyError(), False)):
        assert qa.may_retry(error) is again
    rows = spark.createDataFrame([(s, b) for s in (None, 200, 400, 429, 503) for b in (None, "rate", "x")], "s int, b string")
    for r in rows.select("s", "b", filters.retryable(F.col("s"), F.col("b")).alias("y")).collect():
        assert r.y is qa.may_retry(qa.CallError(r.s, r.b or ""))
    assert [qa.backoff(k) for k in (1, 2, 6)] == [1.0, 2.0, 30.0] and qa.backoff(1, 7.0) == 7.0 and qa.backoff(1, 90.0) == 30.0


def test_replies_with_usage(spark):
    def client():
        seen = {}

        def ask(prompt):
            seen[prompt] = seen.get(prompt, 0) + 1
            if prompt == "busy" and seen[prompt] < 3:
                raise qa.CallError(429, retry_after=0.0)
            if prompt == "never":
                raise qa.CallError(503, retry_after=0.0)
            if prompt == "wrong":
                raise qa.CallError(401)
            return {"reply": prompt.upper(), "prompt_tokens": 2, "completion_tokens": 3}

        return ask

    rows = spark.createDataFrame([("good",), ("busy",), ("never",), ("wrong",)], "p string")
    got = {r.p: r for r in qa.complete(rows, "p", client, tries=4, usage=True).collect()}
    assert (got["good"].reply, got["good"].reply_attempts, got["good"].reply_completion_tokens) == ("GOOD", 1, 3)
    assert (got["busy"].reply, got["busy"].reply_attempts) == ("BUSY", 3)
    assert (got["never"].reply, got["never"].reply_attempts) == (None, 4) and "503" in got["never"].reply_error
    assert (got["wrong"].reply, got["wrong"].reply_attempts) == (None, 1)


def test_checkpoint_asks_for_the_rest_only(spark, tmp_path):
    path, asked = str(tmp_path / "answers"), []

    def ask(df):
        asked.append(sorted(r.qid for r in df.collect()))
        return df.withColumn("answer", F.concat(F.lit("a"), "qid"))

    first = spark.createDataFrame([("1",), ("2",)], "qid string")
    both = spark.createDataFrame([("2",), ("3",)], "qid string")
    assert sorted(r.answer for r in qa.resumed(first, path, "qid", ask).collect()) == ["a1", "a2"]
    assert sorted(r.answer for r in qa.resumed(both, path, "qid", ask).collect()) == ["a2", "a3"]
    assert sorted(r.answer for r in qa.resumed(first, path, "qid", ask, resume=False).collect()) == ["a1", "a2"]
    assert asked == [["1", "2"], ["3"], ["1", "2"]]


def test_labelled_generation(spark, tmp_path):
    def client():
        def ask(prompt):
            if prompt.startswith("Draw up"):
                return 'Sure: [{"label": "A", "child": [{"label": "B"}]}, {"label": "B"}]'
            if prompt.startswith("Write"):
                return '["q1", "q2", "q3"]'
            if prompt.startswith("Choose"):
                return " B " if "q1" in prompt else "nonsense"
            return "a" if prompt.startswith("Answer") else '{"score": 5}'

        return ask

    nodes = qa.label_tree(spark, ["text"], client)
    chunks = spark.createDataFrame([("text",)], "chunk string")
    got = {r.instruction: (r.label, r.tag_path) for r in qa.generate_pairs(chunks, client, per_chunk=2, nodes=nodes, checkpoint=str(tmp_path / "c")).collect()}
    assert got == {"q1": ("B", "A/B"), "q2": ("other", None)}
    assert qa.label_tree(spark, ["text"], lambda: lambda p: "no tree", tries=2) is None


def test_tree_edits(spark):
    nodes = spark.createDataFrame([(1, None, "A", 0), (2, 1, "B", 0), (3, 2, "C", 0), (4, None, "B", 1)], NODES)
    assert tree.find(nodes, "B").first().node_id == 2 and tree.find(nodes, "x").isEmpty()
    assert tree.visualize(nodes) == "- A\n  - B\n    - C\n- B"
    for command, want, shown in (
        ("Add node: D", "done", "- A\n  - B\n    - C\n- B\n- D"),
        ("add node: D; Parent: B", "done", "- A\n  - B\n    - C\n    - D\n- B"),
        ("Add node: D; Parent: A; Child: B", "done", "- A\n  - D\n    - B\n      - C\n- B"),
        ("Add node: D; Parent: A; Child: C", "not found", "- A\n  - B\n    - C\n- B"),
        ("Delete node: B", "done", "- A\n- B"),
        ("Rename node: E; Original: C", "done", "- A\n  - B\n    - E\n- B"),
        ("Rename node: E", "not understood", "- A\n  - B\n    - C\n- B"),
        ("Delete node: Z", "not found", "- A\n  - B\n    - C\n- B"),
        ("Finish", "finished", "- A\n  - B\n    - C\n- B"),
    ):
        after, said = tree.edit(nodes, command)
        assert (said, tree.visualize(after)) == (want, shown), command


def test_feed_entries(spark):
    feed = """<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://x/abs/2301.00001v1</id><title> T </title>
    <author><name>A B</name></author><author/><category term="cs.X"/><link type="application/pdf" href="http://x/pdf"/><arxiv:doi>10.1/x</arxiv:doi></entry></feed>"""
    got = spark.createDataFrame([(feed,), ("<feed/>",), ("<",), (None,)], "x string").select(crawl.feed_entry("x").alias("e")).collect()
    assert (got[0].e.paper_id, got[0].e.title, got[0].e.authors, got[0].e.categories, got[0].e.pdf_url, got[0].e.doi) == ("2301.00001v1", "T", ["A B"], ["cs.X"], "http://x/pdf", "10.1/x")
    assert all(r.e is None or r.e.title is None for r in got[1:])


def test_record_markdown(spark):
    row = spark.sql("select 'T' as t, 'i' as i, array('a', 'b') as au, array() as c, 'd' as p, 'd' as u, cast(null as string) as n, 's' as s, '' as e")
    got = row.select(crawl.paper_markdown(*map(F.col, ("t", "i", "au", "c", "p", "u", "n", "n", "s", "e"))).alias("m")).first().m
    assert got == "# T\n\n**ArXiv ID:** i\n\n**Authors:** a, b\n\n**Published:** d\n\n## Abstract\n\ns\n"
    links = spark.sql("select transform(sequence(1, 22), x -> struct(concat('u', x) as url, '' as text)) as l, '' as e, 'x' as x, cast(null as string) as n")
    got = links.select(crawl.page_markdown(*map(F.col, ("e", "x", "n", "n", "x", "l", "n"))).alias("m")).first().m
    assert got.startswith("# Web Page\n\n**URL:** [x](x)\n\n## Content\n\nx\n\n## Links\n\n- [Link](u1)\n") and got.endswith("- [Link](u20)\n\n*... and 2 more links*\n")
    found = crawl.search_results(spark.createDataFrame([("u", None, "n", "s")], "url string, title string, name string, snippet string")).first()
    assert (found.title, found.description, found.display_url, found.summary) == ("n", "s", "u", "")


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("b/2", 1), ("a 1", None)], "name string, n int")
    crawl.save_records(rows, str(tmp_path / "s"), "name", "2024-01-01")
    assert [(r.identifier, r.n, r.saved_at) for r in crawl.stored(spark, str(tmp_path / "s")).collect()] == [("a1", None, "2024-01-01"), ("b2", 1, "2024-01-01")]


def test_image_chunks(spark):
    text = "intro ![x](img/a.png) and ![](../b.png)\n\n" + "w " * 1500 + "\n\nend ![y](img/a.png)"
    rows = spark.createDataFrame([("/d/f/doc.md", text), ("/d/g.md", "no image"), ("/d/h.md", None)], "path string, text string")
    got = images.image_chunks(rows).orderBy("chunk_index").collect()
    assert got[0].text.startswith("intro  and") and got[0].images == ["/d/img/a.png", "/b.png"]
    assert got[-1].images == ["/d/img/a.png"] and "placeholder" not in got[-1].text and {r.path for r in got} == {"/d/f/doc.md"}
    said = spark.range(1).select(images.image_messages(F.lit("q"), F.lit("a"), F.array(F.lit("x"), F.lit("y"))).alias("m")).first().m
    assert [(x.role, x.content) for x in said] == [("user", "<image><image>q"), ("assistant", "a")]


def test_run_report(spark):
    rows = [("s", "r1", "2024-01-01 00:00:00", 2.0, 10, 20, 1), ("s", "r2", "2024-01-01 00:00:03", 1.0, None, 5, 2), ("t", "r1", "2024-01-01 00:00:00", None, None, None, None)]
    calls = spark.createDataFrame(rows, "stage string, run_id string, started string, seconds double, prompt_tokens long, completion_tokens long, items long")
    got = {r.stage: r for r in metrics.run_report(calls).collect()}
    s = got["s"]
    assert (s.runs, s.items, s.requests, s.seconds, s.total_tokens, s.concurrency, s.requests_per_minute, s.seconds_per_request) == (2, 3, 2, 4.0, 35, 0.75, 30.0, 1.5)
    assert (got["t"].tokens_per_second, got["t"].seconds_per_request) == (0.0, 0.0)


def test_simulated_calls(spark):
    episodes = spark.createDataFrame([(1, ["a", "x", "b"]), (2, [])], "episode_id int, tools array<string>")
    catalog = spark.createDataFrame([("a", "/a"), ("b", "/b")], "identifier string, path string")
    (row,) = qa.simulate_calls(episodes, catalog).collect()
    assert [(c.name, c.status) for c in row.tool_calls] == [("a", "ok"), ("x", "failed"), ("b", "ok")]


def test_streams(spark, tmp_path):
    source, table, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "question string, ts timestamp"

    def arrive(name, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text("".join(json.dumps({"question": q, "ts": f"2024-01-01 00:{m:02}:00"}) + "\n" for q, m in rows))
        ingest.append_pending(ingest.new_documents(spark, source, schema), table, mark).awaitTermination(60)

    arrive("1.json", [("a", 0), ("b", 1), ("a", 2)])
    arrive("2.json", [("b", 3), ("c", 4)])
    assert sorted(r.question for r in spark.read.parquet(table).collect()) == ["a", "b", "c"]
    counts = ingest.windowed_counts(ingest.new_documents(spark, source, schema), "ts", "question")
    once = ingest.once_within(ingest.new_documents(spark, source, schema), ["question"], "ts")
    for name, df, mode, want in (("counts", counts, "complete", 3), ("once", once, "append", 3)):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(60)
        assert spark.table(name).count() == want


def test_edges_of_trees(spark):
    empty = spark.createDataFrame([], NODES)
    assert tree.visualize(empty) == "" and tree.edit(empty, "Add node: A")[1] == "done"
    with pytest.raises(ValueError):
        tree.paths(spark.createDataFrame([(1, None, "A", 0), (2, 1, "B", 0), (1, 2, "A", 0)], NODES))


def test_image_pairs(spark):
    def client():
        return lambda prompt: '["q1", "q2"]' if "JSON list" in prompt else "a"

    chunks = spark.createDataFrame([("text", ["/a.png", "/b.png"])], "text string, images array<string>")
    got = images.generate_image_pairs(chunks, client, per_chunk=1).select("*", images.valid_messages(F.col("messages"), F.col("images")).alias("ok")).collect()
    assert len(got) == 1 and got[0].ok and got[0].messages[0].content == "<image><image>q1"
    bad = spark.sql("select array(named_struct('role', 'user', 'content', '<image>x')) as m, array('a') as i")
    assert bad.select(images.valid_messages(F.col("m"), F.col("i")).alias("y")).first().y is False


def test_agent_episodes(spark):
    def client():
        def ask(prompt):
            if prompt.startswith("Write"):
                return '["q1", "q2", "q3"]'
            if prompt.startswith("Name"):
                return '["a", "unknown"]' if "q1" in prompt else "none"
            if prompt.startswith("Answer"):
                return "said " + prompt.rpartition("\n")[2]
            return '{"score": 5}'

        return ask

    contexts = spark.createDataFrame([(1, "tools a and b")], "context_id int, context string")
    got = {r.question: r for r in qa.agent_episodes(contexts, spark.createDataFrame([("a", "/a")], "identifier string, path string"), client, per_context=2).collect()}
    assert set(got) == {"q1", "q2"} and [c.status for c in got["q1"].tool_calls] == ["ok", "failed"] and got["q2"].tool_calls is None
    assert [x["from"] for x in got["q1"].conversations] == ["human", "function_call", "observation", "function_call", "observation", "gpt"]
    assert got["q1"].final_answer == "said unknown: unknown tool unknown" and [x["from"] for x in got["q2"].conversations] == ["human", "gpt"]


def test_crawl_to_report(spark):
    def client():
        def ask(prompt):
            if prompt.startswith("Write"):
                return '["good", "bad"]'
            return "a" if prompt.startswith("Answer") else '{"score": 5}' if "good" in prompt else '{"score": 1}'

        return ask

    pages = spark.createDataFrame([("<p>some text</p>",), ("<p></p>",)], "html string")
    report, kept = qa.crawl_to_report(pages, client)
    assert tuple(report.first()) == (2, 1, 0.5) and [r.question for r in kept.collect()] == ["good"]
    with pytest.raises(ValueError, match="texts"):
        qa.crawl_to_report(pages.limit(0), client)
    with pytest.raises(ValueError, match="questions"):
        qa.crawl_to_report(pages, lambda: lambda p: "no list")


def test_totals_of_no_calls(spark):
    calls = spark.createDataFrame([], "run_id string, started string, seconds double, prompt_tokens long, completion_tokens long, items long")
    assert metrics.run_totals(calls).count() == 0


def test_page_metadata():
    from millrace.functions.html import read_html

    page = '<html lang="fr"><head><title> T </title><meta name="keywords" content="a, b,,"><meta property="og:title" content="O"><meta name="twitter:title" content="W"><link rel="canonical" href="/c"></head><a href="/x" title="t">L</a><a href="mailto:a"></a></html>'
    got = read_html(page, "http://h/p")
    assert got["metadata"]["keywords"] == ["a", "b"] and got["metadata"]["canonical_url"] == "http://h/c" and got["metadata"]["language"] == "fr"
    assert (got["metadata"]["title"], got["metadata"]["og_title"], got["metadata"]["twitter_title"], got["metadata"]["author"]) == ("T", "O", "W", "")
    assert got["links"] == [{"url": "http://h/x", "text": "L", "title": "t"}] and len(got["metadata"]) == 11
    assert read_html("", "http://h/p")["metadata"]["canonical_url"] == "http://h/p"
