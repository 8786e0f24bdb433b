"""Queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import chunk, clean, filters, html, privacy
from millrace.functions.han import SIMPLIFIED, TRADITIONAL
from millrace.operators import evaluate
from millrace.plans.catalogue import query
from millrace.session import share_code, table

#: Appended to every text so that each rule has something to do.
_DIRT = "\r\n\n\n  x \t \u0007y\n• z<b>t</b> 臺灣與漢語 \u200b\u2550   " + clean.WATERMARK
_DIRT_SQL = "(text || chr(13) || chr(10) || chr(10) || chr(10) || '  x ' || chr(9) || chr(160) || chr(7) || 'y' || chr(10) || '• z<b>t</b> 臺灣與漢語 ' || chr(8203) || chr(9552) || '   " + clean.WATERMARK + "')"


def _dirty(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(_DIRT)).alias("text"))


def _newlines(x):
    return f"regexp_replace(replace({x}, chr(13), ''), chr(10) || '+', chr(10), 'g')"


def _spaces(x):
    return f"regexp_replace({x}, ' {{2,}}', ' ', 'g')"


def _tabs(x):
    return f"replace({x}, chr(9), '    ')"


def _invisible(x):
    return rf"regexp_replace({x}, '[\x00-\x09\x0B-\x1F\x7F-\x{{A0}}]', '', 'g')"


def _bullets(x):
    return f"replace({x}, chr(10) || '• ', chr(10) || '- ')"


def _tags(x):
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', '', 'g')"


def _han(x):
    return f"translate({x}, '{TRADITIONAL}', '{SIMPLIFIED}')"


def _abnormal(x):
    return rf"regexp_replace({x}, '[\x{{E000}}-\x{{F8FF}}\x{{FFFD}}\x{{FEFF}}\x{{200B}}-\x{{200F}}\x{{2500}}-\x{{257F}}]', '', 'g')"


def _no_html(x):
    return _newlines(_invisible(_han(_tabs(_spaces(_newlines(x))))))


def _full(x):
    return f"replace({_newlines(_invisible(_han(_tabs(_spaces(_newlines(_tags(_bullets(x))))))))}, '{clean.WATERMARK}', '')"


def _rule(name, function, sql):
    @query(name, f"select doc_id, {sql(_DIRT_SQL)} as text from documents")
    def run(spark, sf_dir):
        return _dirty(spark, sf_dir).select("doc_id", function(F.col("text")).alias("text"))


for _name, _function, _sql in (
    ("clean_newlines", clean.convert_newlines, _newlines),
    ("clean_spaces", clean.single_space, _spaces),
    ("clean_tabs", clean.tabs_to_spaces, _tabs),
    ("clean_invisible", clean.remove_invisible_chars, _invisible),
    ("clean_bullets", clean.point_conversion, _bullets),
    ("clean_nospace", clean.clean_space, lambda x: f"replace({x}, ' ', '')"),
    ("clean_tips", clean.clean_tips, lambda x: f"replace({x}, '{clean.WATERMARK}', '')"),
    ("clean_html_tags", clean.remove_html_tags, _tags),
    ("clean_chinese", clean.simplify_chinese, _han),
    ("clean_abnormal", clean.remove_abnormal_chars, _abnormal),
    ("clean_nlp", clean.nlp_clean, lambda x: f"trim({_spaces(_invisible(_abnormal(_tags(x))))}, ' ')"),
    ("clean_no_html", clean.no_html_clean, _no_html),
    ("clean_full", clean.full_clean, _full),
):
    _rule(_name, _function, _sql)


def _sub(pattern, token):
    return lambda x: f"regexp_replace({x}, '{pattern}', '{token}', 'g')"


_ip, _email, _dashed = _sub(privacy.IP, "<IP>"), _sub(privacy.EMAIL, "<EMAIL>"), _sub(privacy.DASHED, "<NUMBER>")
_phone, _qq, _id = lambda x: _sub(privacy.LANDLINE, "<PHONE>")(_sub(privacy.PHONE, "<PHONE>")(x)), _sub(privacy.QQ, "<QQ>"), _sub(privacy.ID_CARD, "<ID>")
#: Appended to every text so that each rule has something to do, and something to leave.
_PRIVATE = " at 10.0.0.1, a.b@c.example_d@e.example, 010-1234-5678, 13912345678, (0755) 82345678, QQ: 123456, 11010519491231002X, 3782 822463 10005, 4111 1111 1111 1112"


def _mask(name, function, sql):
    @query(name, f"select doc_id, {sql} as text from (select doc_id, text || '{_PRIVATE}' as text from documents)")
    def run(spark, sf_dir):
        text = F.concat("text", F.lit(_PRIVATE))
        return table(spark, sf_dir, "documents").select("doc_id", function(text).alias("text"))


_mask("mask_ip", privacy.replace_ip, _ip("text"))
_mask("mask_email", privacy.replace_email, _email("text"))
_mask("mask_dashed", privacy.replace_customer_number, _dashed("text"))
_mask("mask_phone", privacy.replace_phone_number, _phone("text"))
_mask("mask_id_card", privacy.replace_id_card, _id("text"))
_mask("mask_qq", privacy.replace_qq, _qq("text"))

_LUHN_OF = (
    "(len(regexp_replace(c, '[^0-9]', '', 'g')) in (13, 15, 16, 19) and list_sum(list_transform(range(1, len(regexp_replace(c, '[^0-9]', '', 'g')) + 1), lambda k: "
    "case when k % 2 = 0 then case when 2 * cast(reverse(regexp_replace(c, '[^0-9]', '', 'g'))[k] as int) > 9 then 2 * cast(reverse(regexp_replace(c, '[^0-9]', '', 'g'))[k] as int) - 9 "
    "else 2 * cast(reverse(regexp_replace(c, '[^0-9]', '', 'g'))[k] as int) end else cast(reverse(regexp_replace(c, '[^0-9]', '', 'g'))[k] as int) end)) % 10 = 0)"
)
_CARD_RE = privacy.CARD


def _card_sql(x):
    return f"list_reduce(list_filter(list_distinct(regexp_extract_all({x}, '{_CARD_RE}')), lambda c: {_LUHN_OF}), lambda t, c: replace(t, c, '<CARD>'), {x})"


_mask("mask_card", privacy.replace_bank_id, _card_sql("text"))


def _all_sql(source):
    return f"""with m as (select doc_id, {_email(_ip('text'))} as text from ({source})), b as (select doc_id, {_card_sql('text')} as text from m)
select doc_id, {_id(_qq(_phone('text')))} as text from b"""


@query("mask_all", _all_sql(f"select doc_id, text || '{_PRIVATE}' as text from documents"))
def mask_all(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", privacy.mask_private(F.concat("text", F.lit(_PRIVATE))).alias("text"))


def _peak_sql(source):
    """(doc_id, share) of the texts of two characters or more."""
    return f"with src as ({source}), p as (select doc_id, unnest(list_transform(range(1, len(text), 2), lambda i: text[i:i + 1])) as p from src), n as (select doc_id, p, count(*) as n from p group by all) select doc_id, max(n) / sum(n) as share from n group by doc_id"


@query("filter_repetition", f"select doc_id, share::double as share, coalesce(share <= 0.6, false) as kept from documents left join ({_peak_sql('from documents')}) using (doc_id)")
def filter_repetition(spark, sf_dir):
    share_code(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", filters.bigram_peak(F.col("text")).alias("share"))
    return docs.select("doc_id", "share", F.coalesce(F.col("share") <= 0.6, F.lit(False)).alias("kept"))


@query("filter_length", "select doc_id, len(text) between 30 and 500000 as kept from documents")
def filter_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", filters.char_count(F.col("text")).alias("kept"))


@query("filter_numeric", r"select doc_id, coalesce(len(regexp_extract_all(text, '\p{Nd}')) / nullif(len(text), 0) <= 0.02, false) as kept from documents")
def filter_numeric(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", filters.few_digits(F.col("text"), 0.02).alias("kept"))


@query("quality_gate", r"select doc_id, coalesce(len(text) >= 50 and len(regexp_extract_all(text, '[\x20-\x7E\n\r\t\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]')) / len(text) >= 0.7, false) as kept from documents")
def quality_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", filters.readable(F.col("text")).alias("kept"))


def _kept_sql(source):
    """The rows of ``source`` that pass the rules of length, digits and repetition."""
    return rf"select k.doc_id, k.text from ({source}) k join ({_peak_sql(source)}) s on k.doc_id = s.doc_id where share <= 0.6 and len(k.text) between 30 and 500000 and len(regexp_extract_all(k.text, '\p{{Nd}}')) / len(k.text) <= 0.6"


#: A fifth of the texts are mostly digits, and a fifth mostly one pair of characters, so that each rule rejects some.
_NOISY_SQL = "select doc_id, case doc_id % 5 when 0 then repeat('1234567890', len(text) // 4) || text when 1 then repeat('ab', len(text)) || text else text end as text from documents"


@query("filter_all", f"select doc_id, cast(len(text) as int) as n_chars from ({_kept_sql(_NOISY_SQL)})")
def filter_all(spark, sf_dir):
    share_code(spark)
    fill = lambda x, n: F.concat(F.repeat(F.lit(x), n), "text")
    noisy = F.when(F.col("doc_id") % 5 == 0, fill("1234567890", F.expr("cast(length(text) div 4 as int)"))).when(F.col("doc_id") % 5 == 1, fill("ab", F.length("text"))).otherwise(F.col("text"))
    docs = filters.computed(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", noisy)
    return docs.where(filters.keep(F.col("text"))).select("doc_id", F.length("text").alias("n_chars"))


@query("curate_documents", f"select doc_id, text, cast(len(text) as int) as n_chars from ({_all_sql(_kept_sql(f'select doc_id, {_full(_DIRT_SQL)} as text from documents'))})")
def curate_documents(spark, sf_dir):
    """Full cleaning, then the quality rules on the cleaned text, then masking."""
    share_code(spark)
    docs = filters.computed(_dirty(spark, sf_dir), "text", clean.full_clean(F.col("text")))
    masked = filters.computed(docs.where(filters.keep(F.col("text"))), "text", privacy.mask_private(F.col("text")))
    return masked.select("doc_id", "text", F.length("text").alias("n_chars"))


_WINDOWS = """with w as (select doc_id, text, unnest(case when len(text) > {size} then range(0, greatest(len(text) - {overlap}, 1), {step}) when len(text) > 0 then [0] else [] end) as s from documents)
select doc_id, cast(s / {step} as int) as chunk_index, text[s + 1:s + {size}] as chunk from w"""


@query("chunk_fixed", _WINDOWS.format(size=500, overlap=100, step=400))
def chunk_fixed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    share_code(spark)
    return docs.select("doc_id", F.posexplode(chunk.paragraphs(F.col("text"))).alias("chunk_index", "chunk"))


@query("code_windows", _WINDOWS.format(size=4000, overlap=200, step=3800))
def code_windows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(chunk.windows(F.col("text"), 4000, 200)).alias("chunk_index", "chunk"))


@query("chunk_recursive")
def chunk_recursive(spark, sf_dir):
    share_code(spark)
    cut = chunk.splitter(chunk.split_recursive, size=500, overlap=100)
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(cut("text")).alias("chunk_index", "chunk"))


@query("references", r"""select page_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(url || ' ' || html, 'DOI:[ \t]?[^ \t\r\n]+|https?://[^ \t\r\n]+'), regexp_extract_all(url || ' ' || html, '[A-Z][a-z]+ and [A-Z][a-z]+,? \(?[0-9]{4}\)?')))), chr(10)) as refs from pages""")
def references(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", clean.references(F.concat_ws(" ", "url", "html")).alias("refs"))


@query("strip_html", f"select page_id, {_tags('html')} as text from pages")
def strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", clean.remove_html_tags(F.col("html")).alias("text"))


@query("html_to_text", r"select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) as text from pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.text_of(F.col("html")).alias("text"))


@query("page_title", "select page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) as title from pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.title_of(F.col("html")).alias("title"))


@query("page_lang", "select page_id, regexp_extract(html, '(?i)<html[^>]* lang=[\"'']?([A-Za-z-]+)', 1) as lang from pages")
def page_lang(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.lang_of(F.col("html")).alias("lang"))


@query("page_links", "select page_id, cast(len(list_filter(regexp_extract_all(html, '(?i)<a [^>]*href=[\"'']([^\"'']*)[\"'']', 1), lambda x: x <> '' and not regexp_matches(lower(x), '^(javascript:|mailto:|tel:)'))) as int) as n_links from pages")
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(html.hrefs_of(F.col("html"))).alias("n_links"))


@query("page_records")
def page_records(spark, sf_dir):
    share_code(spark)
    got = table(spark, sf_dir, "pages").select("page_id", "url", html.parse_page("html", "url").alias("p"))
    return got.select("page_id", "url", "p.text", "p.metadata", "p.links", html.sections_markdown(F.col("p.sections")).alias("markdown"))


@query("merge_documents", "select source, string_agg(text, chr(10) || chr(10) order by doc_id) as text, count(*) as n from documents group by source")
def merge_documents(spark, sf_dir):
    """Texts of each source in order of id, by blank lines."""
    docs = table(spark, sf_dir, "documents")
    texts = F.array_sort(F.collect_list(F.struct("doc_id", "text")))
    return docs.groupBy("source").agg(F.array_join(F.transform(texts, lambda x: x["text"]), "\n\n").alias("text"), F.count("*").alias("n"))


@query("cosine_threshold", """with e as (select vec_id, label, embedding::double[] as v from embeddings), f as (select label as l, min_by(v, vec_id) as c from e group by label)
select vec_id, label, round(list_dot_product(v, c) / sqrt(list_dot_product(v, v) * list_dot_product(c, c)), 6) as similarity from e join f on label = l where round(list_dot_product(v, c) / sqrt(list_dot_product(v, v) * list_dot_product(c, c)), 6) > 0.2""")
def cosine_threshold(spark, sf_dir):
    """Vectors close to the first of their label; the first are one row a label."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy(F.col("label").alias("l")).agg(F.min_by("embedding", "vec_id").alias("c"))
    got = e.join(first, F.col("label") == F.col("l")).select("vec_id", "label", F.round(evaluate.cosine(F.col("embedding"), F.col("c")), 6).alias("similarity"))
    return got.where("similarity > 0.2")


_TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> '')"


@query("rouge_1", f"""with p as (select item_id as doc_id, {_TOKENS.format('d.text')} as c, {_TOKENS.format('b.text')} as r from benchmark b join documents d on d.doc_id = b.item_id),
g as (select doc_id, unnest(c) as gram, 1 as c, 0 as r from p union all select doc_id, unnest(r), 0, 1 from p), n as (select doc_id, gram, sum(c) as c, sum(r) as r from g group by all),
s as (select doc_id, sum(least(c, r)) as hit, sum(c) as c, sum(r) as r from n group by doc_id)
select doc_id, round(case when c > 0 then hit / c else 0 end, 6)::double as precision, round(case when r > 0 then hit / r else 0 end, 6)::double as recall from s""")
def rouge_1(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("c"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("r"))
    return evaluate.rouge_n(d.join(b, "doc_id"), "doc_id", "c", "r").select("doc_id", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("rouge_2", f"""with p as (select item_id as doc_id, {_TOKENS.format('d.text')} as c, {_TOKENS.format('b.text')} as r from benchmark b join documents d on d.doc_id = b.item_id),
q as (select doc_id, list_transform(range(1, len(c)), lambda i: c[i] || ' ' || c[i + 1]) as c, list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1]) as r from p),
g as (select doc_id, unnest(c) as gram, 1 as c, 0 as r from q union all select doc_id, unnest(r), 0, 1 from q), n as (select doc_id, gram, sum(c) as c, sum(r) as r from g group by all),
s as (select doc_id, sum(least(c, r)) as hit, sum(c) as c, sum(r) as r from n group by doc_id)
select doc_id, round(case when c > 0 then hit / c else 0 end, 6)::double as precision, round(case when r > 0 then hit / r else 0 end, 6)::double as recall, round(case when hit > 0 then 2 * hit / (c + r) else 0 end, 6)::double as f1 from s""")
def rouge_2(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("c"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("r"))
    return evaluate.rouge_n(d.join(b, "doc_id"), "doc_id", "c", "r", 2).select("doc_id", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query("rouge_l")
def rouge_l(spark, sf_dir):
    """Longest common subsequences of user and assistant turns that follow one another."""
    from millrace.plans.relations import _pairs

    share_code(spark)
    return _pairs(spark, sf_dir).select("conv_id", "turn", evaluate.rouge_l("answer", "question").alias("f1"))


@query("bleu")
def bleu(spark, sf_dir):
    """Each answer against its question as the one reference."""
    from millrace.plans.relations import _pairs

    share_code(spark)
    return _pairs(spark, sf_dir).select("conv_id", "turn", evaluate.bleu_score("answer", F.array("question")).alias("bleu"))


@query("caption_diversity")
def caption_diversity(spark, sf_dir):
    """The turns of a conversation as captions of one image."""
    share_code(spark)
    return evaluate.diversity_of(table(spark, sf_dir, "conversations"), "conv_id", "text")


@query("mean_scores", "select avg(quality)::double as quality, avg(toxic)::double as toxic from labels")
def mean_scores(spark, sf_dir):
    return evaluate.mean_scores(table(spark, sf_dir, "labels"), ("quality", "toxic"))
