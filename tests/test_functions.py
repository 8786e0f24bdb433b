import io
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.functions import chunk, clean, filters, privacy
from millrace.operators import evaluate, qa, tree
from millrace.sources import files, sinks


def one(spark, f, value):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(
    ("rule", "given", "want"),
    [
        (clean.convert_newlines, "a\r\n\n\nb", "a\nb"),
        (lambda c: clean.tabs_to_spaces(clean.single_space(c)), "a   b\tc", "a b    c"),
        (clean.remove_invisible_chars, "a \u0007b\nc", "ab\nc"),
        (clean.point_conversion, "• x\n• y", "• x\n- y"),
        (clean.simplify_chinese, "漢語", "汉语"),
        (clean.simplify_chinese, "臺灣與歐洲經濟發展報導，關於今後的龜鬱 著名乾坤", "台湾与欧洲经济发展报导，关于今后的龟郁 著名乾坤"),
        (privacy.replace_bank_id, "4111 1111 1111 1111 and 4111 1111 1111 1112, 4111 1111 1111 1111", "<CARD> and 4111 1111 1111 1112, <CARD>"),
        (privacy.replace_customer_number, "010-1234-5678", "<NUMBER>"),
        (privacy.replace_phone_number, "010-62345678, (0755) 8234567, 021 52345678; 010-1234-5678, 00-62345678, 0755-82345678901", "<PHONE>, <PHONE>, <PHONE>; 010-1234-5678, 00-62345678, 0755-82345678901"),
        (privacy.mask_private, "0755-82345678 or 010-1234-5678", "<PHONE> or 010-1234-5678"),
        (privacy.mask_private, "at 10.0.0.1 or a@b.example, 13912345678", "at <IP> or <EMAIL>, <PHONE>"),
    ],
)
def test_rules(spark, rule, given, want):
    assert one(spark, rule, given) == want
    assert one(spark, rule, None) is None


@pytest.mark.parametrize(("text", "kept"), [("ab" * 20, False), ("", False), ("a", False), ("abc", False), (None, False), ("abcdefgh", True)])
def test_repeats(spark, text, kept):
    assert one(spark, filters.few_repeats, text) is kept


@pytest.mark.parametrize(("text", "kept"), [("123ab", True), ("1234a", False), ("", False), ("١" * 5, False)])
def test_digits(spark, text, kept):
    assert one(spark, filters.few_digits, text) is kept


def test_chunks():
    assert [len(x) for x in chunk.fill_sentences("x" * 1200)] == [500, 500, 400]
    assert chunk.fill_sentences("") == []
    two = "a" * 299 + "。" + "b" * 299 + "。"
    assert [len(x) for x in chunk.fill_sentences(two)] == [300, 400]
    with pytest.raises(ValueError):
        chunk.fill_sentences("x", 100, 100)
    parts = chunk.split_recursive("one two three four five", 9, 0)
    assert all(len(x) <= 9 for x in parts) and " ".join(parts) == "one two three four five"
    assert all(len(x) <= 60 for x in chunk.split_json({"a": list(range(30)), "b": "x"}, 60))


def test_json_of_replies(spark):
    for given, want in (("[1]", "[1]"), ('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ("so: [1, 2] done", "[1, 2]"), ("none", None)):
        got = one(spark, qa.json_of, given)
        assert (got and got.strip()) == want


def test_tree(spark):
    nodes = spark.createDataFrame([(1, None, "A", 0), (2, 1, "B", 0), (3, 2, "C", 0)], "node_id long, parent_id long, label string, ordinal int")
    assert {r.path for r in tree.paths(nodes).collect()} == {"A", "A/B", "A/B/C"}
    assert [r.label for r in tree.remove(nodes, 2).collect()] == ["A"]


def test_deep_tree(spark):
    schema = "node_id long, parent_id long, label string, ordinal int"
    chain = [(k, k - 1 if k else None, f"n{k}", 0) for k in range(40)]
    got = {r.node_id: r for r in tree.paths(spark.createDataFrame(chain, schema)).collect()}
    assert len(got) == 40 and got[39].depth == 39 and got[39].path == "/".join(f"n{k}" for k in range(40))
    with pytest.raises(ValueError):
        tree.paths(spark.createDataFrame(chain[:3], schema), 2)
    with pytest.raises(ValueError):
        tree.paths(spark.createDataFrame([(1, None, "A", 0), (2, 1, "B", 0), (1, 2, "A", 0)], schema))


def test_scores(spark):
    assert evaluate.bleu("a b c d e", ["a b c d e"]) == pytest.approx(100)
    assert evaluate.diversity(["a b"]) == 0.0
    assert evaluate.diversity(["a b c", "x y z"]) > evaluate.diversity(["a b c", "a b c"])
    for given, want in (("-1", 0.36787944), ("0", 1.0), ("1.7", 1.0), ("text", 0.0)):
        assert one(spark, evaluate.unit_score, given) == pytest.approx(want)


def test_generated_pairs(spark):
    def client():
        def ask(prompt):
            if prompt.startswith("Write"):
                return '["q1", "q2"]'
            if prompt.startswith("Answer"):
                return "a"
            return '{"score": 5}' if "q1" in prompt else '{"score": 2}'

        return ask

    chunks = spark.createDataFrame([("text",)], "chunk string")
    assert [(r.instruction, r.output, r.label) for r in qa.generate_pairs(chunks, client).collect()] == [("q1", "a", "")]


def test_files(spark, tmp_path):
    def zipped(parts):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for name, text in parts.items():
                z.writestr(name, text)
        return raw.getvalue()

    w = 'xmlns:w="w"'
    (tmp_path / "a.docx").write_bytes(zipped({"word/document.xml": f"<w:d {w}><w:p><w:r><w:t>Hello</w:t></w:r></w:p></w:d>"}))
    (tmp_path / "b.html").write_text("<h2>T</h2><p>body</p>")
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.log").write_text("x")
    got = {r.path.rpartition("/")[2]: r for r in files.parse(files.scan(spark, str(tmp_path)), "2024-01-01 00:00:00").collect()}
    assert got["a.docx"].content == "Hello" and got["b.html"].content == "## T\nbody"
    assert got["c.csv"].content == "| a | b |\n|---|---|\n| 1 | 2 |"
    assert got["d.pdf"].error and got["d.pdf"].lifecycle[0].life_type[-1] == "DATA_PROCESS_FAILED" and "e.log" not in got
    with pytest.raises(ValueError):
        sinks.save_jsonl(spark.range(0), str(tmp_path / "out"))


def test_masks_match_the_plain_patterns(spark):
    import random
    import re

    rng = random.Random(9)
    texts = ["".join(rng.choices(["a", "1", "@", ".", "_", "-", " ", "b.c", "x@y.z", "12-34-5", "é"], k=rng.randint(0, 25))) for _ in range(4000)]
    frame = spark.createDataFrame([(t,) for t in texts], "x string").select("x", privacy.replace_email(F.col("x")).alias("e"), privacy.replace_customer_number(F.col("x")).alias("d"))
    for r in frame.collect():
        assert r.e == re.sub(privacy.EMAIL, "<EMAIL>", r.x) and r.d == re.sub(privacy.DASHED, "<NUMBER>", r.x), r.x


@pytest.mark.parametrize("text", ["a" * 1_000_000, "1" * 1_000_000, "a.b" * 300_000, "1-" * 500_000, "a@" * 500_000, "4111 " * 200_000])
def test_masks_of_long_texts_are_linear(spark, text):
    import time

    start = time.time()
    one(spark, privacy.mask_private, text)
    one(spark, privacy.replace_customer_number, text)
    assert time.time() - start < 20


def test_cards_in_groups_of_4_6_5(spark):
    assert one(spark, privacy.replace_bank_id, "3782 822463 10005, 378282246310005, 3782 822463 10006") == "<CARD>, <CARD>, 3782 822463 10006"


def test_latest_of_ties(spark):
    rows = spark.createDataFrame([("q", 1, "b"), ("q", 1, "c"), ("q", 0, "z"), ("r", None, "x")], "question string, at int, answer string")
    assert {r.question: r.answer for r in qa.latest(rows, "question", "at").collect()} == {"q": "c", "r": "x"}


def test_windows_against_slices(spark):
    texts = ["", "a", "é漢😀\n" * 30, "x" * 100, "y" * 101, "z" * 119, "abc def\r\n" * 50]
    rows = spark.createDataFrame([(t,) for t in texts], "x string")
    for size, overlap in ((100, 0), (100, 20), (50, 49), (40, 30), (7, 3)):
        for r in rows.select("x", chunk.windows(F.col("x"), size, overlap).alias("y")).collect():
            n, step = len(r.x), size - overlap
            starts = range(0, max(n - overlap, 1), step) if n > size else [0] if n else []
            assert r.y == [r.x[s : s + size] for s in starts], (size, overlap, n)


def test_recursive_pieces_of_a_long_text_are_not_held():
    import tracemalloc

    for text in ("漢" * 300_000, "ab " * 100_000):
        tracemalloc.start()
        parts = chunk.split_recursive(text, 500, 100)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert max(map(len, parts)) <= 500
        assert peak < 1.5 * sum(x.__sizeof__() for x in parts) + 100_000, peak


def test_recursive_pieces_against_lists():
    import random

    def atoms(t, size, seps):
        if len(t) <= size:
            return [t] if t else []
        for k, sep in enumerate(seps):
            if sep and sep in t:
                parts = t.split(sep)
                return [a for p in (parts[0], *[sep + p for p in parts[1:]]) for a in atoms(p, size, seps[k + 1 :])]
        return list(t)

    def merged(pieces, size, overlap):
        out, held = [], []
        for a in pieces:
            if held and len("".join(held)) + len(a) > size:
                out.append("".join(held).strip())
                while held and (len("".join(held)) > overlap or len("".join(held)) + len(a) > size):
                    held.pop(0)
            held.append(a)
        return [x for x in [*out, "".join(held).strip()] if x]

    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choices(["a", "bc", " ", "\n", "\n\n", "\n\n\n", "漢", "😀", "\t", "word"], k=rng.randint(0, 40)))
        size = rng.randint(1, 20)
        overlap, seps = rng.randint(0, size - 1), rng.choice([("\n\n", "\n", " ", ""), ("\n", " "), ("bc", "b"), ()])
        assert chunk.split_recursive(text, size, overlap, seps) == merged(atoms(text, size, seps), size, overlap), (text, size, overlap, seps)


def test_splitter_gives_slices_of_a_batch(spark):
    import pyarrow as pa

    texts = [None, "", *["word " * k for k in (100_000, 150_000, 1, 400_000, 300)], None, *["ab cd " * 700] * 600, ""]
    want = [chunk.split_recursive(t, 500, 100) if t else [] for t in texts]
    cut = chunk.splitter(chunk.split_recursive, size=500, overlap=100)
    parts = list(cut.func(iter([pa.array(texts), pa.array([], pa.string()), pa.array(["x"])])))
    assert [r for p in parts for r in p.to_pylist()] == [*want, ["x"]]
    assert all(p.nbytes < 4 << 20 for p in parts)  # a batch's chunks are never there at once
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1).select("k", cut("t").alias("c"))
    assert {r.k: r.c for r in rows.collect()} == dict(enumerate(want))


def test_repeats_of_a_batch_are_counted_in_slices(spark):
    import tracemalloc

    import pyarrow as pa

    texts = [None, "", "a", "abab", "abcdefg", *["ab" * 150_000 + "cd" * 150_000, "漢字" * 100_000] * 12, "", None, "xyxyz"]
    want = [None, None, None, 1.0, 1 / 3, *[0.5, 1.0] * 12, None, None, 1.0]
    batches = [pa.array(texts), pa.array([], pa.string()), pa.array([None, "aabb"])]
    tracemalloc.start()
    parts = list(filters.bigram_peak.func(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [x for p in parts for x in p.to_pylist()] == [*want, None, 0.5]
    assert peak < batches[0].nbytes, peak  # the texts of a batch are never there at once as strings
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    got = rows.select("k", filters.bigram_peak("t").alias("s"), filters.few_repeats(F.col("t")).alias("f")).collect()
    assert {r.k: r.s for r in got} == dict(enumerate(want))
    assert {r.k for r in got if r.f} == {r.k for r in rows.where(filters.few_repeats(F.col("t"))).collect()} == {k for k, s in enumerate(want) if s is not None and s <= 0.6}
