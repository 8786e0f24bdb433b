"""Queries of small scalar rules, office text rules and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import chunk, filters, html, office, text_rules
from millrace.functions.tables import CODE_LANGUAGES
from millrace.operators import crawl, images, metrics, reports, tree
from millrace.plans.catalogue import query
from millrace.session import table
from millrace.sources import files


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _crawls(spark, sf_dir):
    """Events as crawls: what kind, of which target, for how many seconds, and whether it went well."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("event_type").alias("kind"), F.col("user_id").alias("target"), F.col("value").alias("seconds"), (F.col("value") < 50).alias("ok"))


_CRAWLS = "select event_id, event_type as kind, user_id as target, value as seconds, value < 50 as ok from events"

# --- scalars ---

_BASE = "regexp_replace(url || '//', '/+$', '')"


@query("api_urls", f"select page_id, {_BASE} || '/chat/completions' as plain, {_BASE} || '/chat/completions' as again from pages")
def api_urls(spark, sf_dir):
    plain = text_rules.complete_api_url(F.concat("url", F.lit("//")))
    return _pages(spark, sf_dir).select("page_id", plain.alias("plain"), text_rules.complete_api_url(F.concat(plain, F.lit("/"))).alias("again"))


@query("safe_identifiers", r"select page_id, regexp_replace(url || ' é?*', '[^\p{L}\p{N}_.-]', '', 'g')[1:50] as name from pages")
def safe_identifiers(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", text_rules.safe_identifier(F.concat("url", F.lit(" é?*"))).alias("name"))


_MARK = "case doc_id % 4 when 0 then '  # ' when 1 then 'see PAGE 3 ' when 2 then 'a **b** ' else '' end || text"


@query("content_types", f"select doc_id, case when starts_with(ltrim(t, ' '), '#') or contains(t, '**') or contains(t, '```') then 'Markdown' when regexp_matches(lower(t), 'pdf|page|document') then 'PDF converted content' else 'Text' end as kind from (select doc_id, {_MARK} as t from documents)")
def content_types(spark, sf_dir):
    lead = F.when(F.col("doc_id") % 4 == 0, "  # ").when(F.col("doc_id") % 4 == 1, "see PAGE 3 ").when(F.col("doc_id") % 4 == 2, "a **b** ").otherwise("")
    return _docs(spark, sf_dir).select("doc_id", text_rules.content_type(F.concat(lead, "text")).alias("kind"))


_TARGETS = """select page_id, unnest([url, 'https://arxiv.org/abs/' || (2300 + page_id % 100) || '.' || (10000 + page_id), (2300 + page_id % 100) || '.' || (10000 + page_id) || 'v2', 'words of page ' || page_id, '']) as target from pages"""


def _targets(spark, sf_dir):
    number = F.concat((F.lit(2300) + F.col("page_id") % 100).cast("string"), F.lit("."), (F.lit(10000) + F.col("page_id")).cast("string"))
    kinds = F.array("url", F.concat(F.lit("https://arxiv.org/abs/"), number), F.concat(number, F.lit("v2")), F.concat(F.lit("words of page "), "page_id"), F.lit(""))
    return _pages(spark, sf_dir).select("page_id", F.explode(kinds).alias("target"))


@query("target_types", f"select page_id, target, case when regexp_matches(target, '^https?://') and contains(target, 'arxiv.org') then 'arxiv_url' when regexp_matches(target, '^https?://') then 'web_url' when regexp_matches(replace(replace(target, '.', ''), 'v', ''), '^[0-9]+$') then 'arxiv_id' else 'search_query' end as kind from ({_TARGETS})")
def target_types(spark, sf_dir):
    return _targets(spark, sf_dir).select("page_id", "target", text_rules.target_type(F.col("target")).alias("kind"))


@query("valid_targets", rf"select page_id, target, regexp_matches(target, '^https?://[^/?#\s]+') as web, trim(target) <> '' and (not regexp_matches(target, '^https?://[^/?#\s]+') or contains(target, 'arxiv.org')) as paper from ({_TARGETS})")
def valid_targets(spark, sf_dir):
    return _targets(spark, sf_dir).select("page_id", "target", text_rules.valid_target(F.col("target"), F.lit("web")).alias("web"), text_rules.valid_target(F.col("target"), F.lit("paper")).alias("paper"))


_SIZES = "select l_orderkey, l_linenumber, (l_orderkey * 7919 + l_partkey) * power(1024, l_linenumber - 1) as bytes from lineitem"


@query("byte_sizes", f"select l_orderkey, l_linenumber, case when k < 6 then printf('%.2f', round(bytes / power(1024, k), 2)) || ['B', 'KB', 'MB', 'GB', 'TB', 'PB'][k + 1] end as size from (select *, case when bytes < 1024 then 0 when bytes < power(1024, 2) then 1 when bytes < power(1024, 3) then 2 when bytes < power(1024, 4) then 3 when bytes < power(1024, 5) then 4 when bytes < power(1024, 6) then 5 else 6 end as k from ({_SIZES}))")
def byte_sizes(spark, sf_dir):
    bytes_ = (F.col("l_orderkey") * 7919 + F.col("l_partkey")) * F.pow(F.lit(1024.0), F.col("l_linenumber") - 1)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text_rules.byte_size(bytes_).alias("size"))


@query("truncated", "select doc_id, case when len(text) > 80 then rtrim(text[1:80], ' ') || '...' else text end as stripped, case when len(text) > 80 then text[1:80] || '...' else text end as plain from documents")
def truncated(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", text_rules.truncate(t, 80).alias("stripped"), text_rules.truncate(t, 80, False).alias("plain"))


@query("tidy_markdown", r"select doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\|(\s*-+\s*)\|', '|:---:|', 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as text from (select doc_id, chr(10) || '| a |' || chr(10) || '| --- |' || chr(10) || chr(10) || chr(10) || text || '  ' as t from documents)")
def tidy_markdown(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", text_rules.tidy_markdown(F.concat(F.lit("\n| a |\n| --- |\n\n\n"), "text", F.lit("  "))).alias("text"))


_WRAPPED = """'so: ' || props || ' {no json} {"a": {"b": {"c": ' || event_id || '}}} {' """


@query("json_objects", rf"select event_id, array_to_string(list_filter(regexp_extract_all({_WRAPPED}, '{text_rules.OBJECT}'), lambda x: json_valid(x)), ';') as objects from events")
def json_objects(spark, sf_dir):
    text = F.concat(F.lit("so: "), "props", F.lit(' {no json} {"a": {"b": {"c": '), F.col("event_id").cast("string"), F.lit("}}} {"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(text_rules.json_objects(text), ";").alias("objects"))


@query("search_fields", "select event_id, coalesce(nullif(trim(json_extract_string(props, '$.title')), ''), nullif(trim(json_extract_string(props, '$.k')), ''), event_type) as title from events")
def search_fields(spark, sf_dir):
    field = lambda n: F.get_json_object("props", f"$.{n}")
    return table(spark, sf_dir, "events").select("event_id", text_rules.first_of(field("title"), field("k"), F.col("event_type")).alias("title"))


@query("null_entries", "select c_custkey, cast(1 + case when c_acctbal > 0 then 1 else 0 end as int) as n, case when c_acctbal > 0 then 'balance,name' else 'name' end as keys from customer")
def null_entries(spark, sf_dir):
    kept = text_rules.without_nulls(F.create_map(F.lit("name"), F.col("c_name"), F.lit("balance"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")), F.lit("none"), F.lit(None).cast("string")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.size(kept).alias("n"), F.array_join(F.array_sort(F.map_keys(kept)), ",").alias("keys"))


@query("link_previews", "select page_id, array_to_string(case when len(l) > 2 then list_append(l[1:2], '... and ' || (len(l) - 2) || ' more') else l end, chr(10)) as links from (select page_id, [url || '#' || i for i in range(0, page_id % 5)] as l from pages)")
def link_previews(spark, sf_dir):
    """The first links of each page, and how many are left out."""
    n = (F.col("page_id") % 5).cast("int")
    links = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat("url", F.lit("#"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    return _pages(spark, sf_dir).select("page_id", F.array_join(text_rules.preview(links, 2), "\n").alias("links"))


# --- office and code ---

_NAMED = "select doc_id, 'lib/file_' || doc_id || (['" + "', '".join([*CODE_LANGUAGES, ".TXT", ""]) + f"'])[doc_id % {len(CODE_LANGUAGES) + 2} + 1] as path, text || (['', ' import x def f', ' function const ', ' class A public ', ' #include int main', ' package p func ', ' fn let '])[doc_id % 7 + 1] as text from documents"
_LANGUAGE = "case " + " ".join(f"when lower(path) like '%{e}' then '{lang}'" for e, lang in CODE_LANGUAGES.items()) + """ when contains(text, 'def ') and contains(text, 'import ') then 'python' when contains(text, 'function') and (contains(text, 'const ') or contains(text, 'let ')) then 'javascript'
when contains(text, 'class ') and contains(text, 'public ') then 'java' when contains(text, '#include') and contains(text, 'int main') then 'cpp' when contains(text, 'package ') and contains(text, 'func ') then 'go' when contains(text, 'fn ') and contains(text, 'let ') then 'rust' else 'generic' end"""


def _named(spark, sf_dir):
    at = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int"))
    path = F.concat(F.lit("lib/file_"), F.col("doc_id").cast("string"), at([*CODE_LANGUAGES, ".TXT", ""]))
    text = F.concat("text", at(["", " import x def f", " function const ", " class A public ", " #include int main", " package p func ", " fn let "]))
    return _docs(spark, sf_dir).select("doc_id", path.alias("path"), text.alias("text"))


@query("code_languages", f"select doc_id, {_LANGUAGE} as language from ({_NAMED})")
def code_languages(spark, sf_dir):
    return _named(spark, sf_dir).select("doc_id", chunk.code_language(F.col("path"), F.col("text")).alias("language"))


@query("code_markdown", f"""with n as ({_NAMED}), l as (select *, {_LANGUAGE} as language, case when len(text) > 4000 then [text[s + 1:s + 4000] for s in range(0, greatest(len(text) - 200, 1), 3800)] else [text] end as c from n)
select doc_id, '# Code Analysis: ' || path || chr(10) || chr(10) || '**Language:** ' || language || chr(10) || '**Total Chunks:** ' || len(c) || chr(10) || chr(10) ||
array_to_string(list_transform(c, lambda x, i: '## Chunk ' || i || chr(10) || chr(10) || '```' || language || chr(10) || x || chr(10) || '```' || chr(10) || chr(10) || '*Lines: ' || (len(x) - len(replace(x, chr(10), '')) + 1) || ', Characters: ' || len(x) || '*' || chr(10) || chr(10) || '---' || chr(10) || chr(10)), '') as markdown from l""")
def code_markdown(spark, sf_dir):
    rows = _named(spark, sf_dir).select("doc_id", "path", "text", chunk.code_language(F.col("path"), F.col("text")).alias("language"))
    return rows.select("doc_id", chunk.code_markdown(chunk.windows(F.col("text"), 4000, 200), F.col("language"), F.col("path")).alias("markdown"))


@query("titles_as_headers", r"""with l as (select doc_id, [trim(x, ' ' || chr(9) || chr(13)) for x in string_split(text || chr(10) || 'A title' || chr(10) || 'A title of more than twenty letters' || chr(10) || 'An end.', chr(10))] as l from documents)
select doc_id, regexp_replace(regexp_replace(array_to_string([case when x = '' or regexp_matches(x, '[。.！!？?]$') or len(x) >= 50 then x when len(x) < 20 then '## ' || x else '### ' || x end for x in l], chr(10) || chr(10)), chr(10) || '{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as text from l""")
def titles_as_headers(spark, sf_dir):
    text = F.concat("text", F.lit("\nA title\nA title of more than twenty letters\nAn end."))
    return _docs(spark, sf_dir).select("doc_id", office.titles_as_headers(text).alias("text"))


def _blocks_sql():
    x = "html"
    for pattern, to in office.BLOCKS:
        to = "''" if not to else " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in ([to] if "\n" not in to else list(to)))
        x = f"regexp_replace({x}, '(?i){pattern}', {to}, 'g')"
    for pattern in ("(?is)<style[^>]*>.*?</style>", "(?is)<script[^>]*>.*?</script>", "<[^>]+>"):
        x = f"regexp_replace({x}, '{pattern}', '', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '[ \t\r]+', ' ', 'g'), ' *\| *', ' | ', 'g')"
    x = f"array_to_string([trim(y, ' ') for y in string_split({x}, chr(10))], chr(10))"
    return rf"select page_id, regexp_replace(regexp_replace({x}, chr(10) || '{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as text from pages"


@query("blocks_to_text", _blocks_sql())
def blocks_to_text(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", office.blocks_to_text(F.col("html")).alias("text"))


_ALL_EXTENSIONS = [*files.IMAGES, *(x[1:] for x in CODE_LANGUAGES), *files.DOCUMENTS]
_KINDS = [*["image"] * len(files.IMAGES), *["code"] * len(CODE_LANGUAGES), *files.DOCUMENTS]
_ENDINGS = [*_ALL_EXTENSIONS, "PDF", "Py", "log", "nodot"]


@query("route_all", "select page_id, name, kind from pages, (values " + ", ".join(f"('{'.' if e != 'nodot' else ''}{e}', {repr(dict(zip(_ALL_EXTENSIONS, _KINDS)).get(e.lower())) if e.lower() in _ALL_EXTENSIONS else 'null'})" for e in _ENDINGS) + ") v(name, kind)")
def route_all(spark, sf_dir):
    """Every extension that has a route, upper case, an unknown one and none, on every page."""
    names = F.array(*[F.lit(("" if e == "nodot" else ".") + e) for e in _ENDINGS])
    rows = _pages(spark, sf_dir).select("page_id", F.explode(names).alias("name"))
    return rows.select("page_id", "name", files.route(F.concat(F.lit("folder/name"), "name")).alias("kind"))


# --- reports ---


@query("crawl_metrics", f"select count(*) as total_crawls, count(*) filter (where ok) as successful_crawls, count(*) filter (where not ok) as failed_crawls, count(distinct target) as unique_targets, round(sum(seconds) / count(*), 6) as avg_duration, round(count(*) filter (where ok) / count(*), 6) as success_rate, (select string_agg(kind || '=' || n, ',' order by kind) from (select kind, count(*) as n from ({_CRAWLS}) group by kind)) as crawlers_used from ({_CRAWLS})")
def crawl_metrics(spark, sf_dir):
    got = reports.crawl_metrics(_crawls(spark, sf_dir))
    used = F.array_join(F.transform(F.array_sort(F.map_entries("crawlers_used")), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return got.select("total_crawls", "successful_crawls", "failed_crawls", "unique_targets", F.round("avg_duration", 6).alias("avg_duration"), F.round("success_rate", 6).alias("success_rate"), used.alias("crawlers_used"))


@query("review_counts", "select count(*) filter (where quality * 5 >= 4) as accepted, count(*) filter (where quality is null or quality * 5 < 4) as rejected from labels")
def review_counts(spark, sf_dir):
    return reports.review_counts(table(spark, sf_dir, "labels").withColumn("score", F.col("quality") * 5))


@query("run_counts", "select count(text) as questions, count(*) filter (where toxic is not null) as answered, count(quality) as labelled, count(distinct quality) as labels from documents left join labels using (doc_id)")
def run_counts(spark, sf_dir):
    rows = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return reports.run_counts(rows.select(F.col("text").alias("question"), F.col("toxic").alias("answer"), F.col("quality").cast("string").alias("label")))


@query("batch_summary", "select count(*) as files, count(*) filter (where coalesce(quality = 1, true)) as successful, count(*) filter (where not coalesce(quality = 1, true)) as failed, count(*) / 8.0 as files_per_second from documents left join labels using (doc_id)")
def batch_summary(spark, sf_dir):
    rows = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return reports.batch_summary(rows.select((F.col("quality") == 1).alias("ok")), 8.0)


@query("combined_results", f"select target, count(*) as total_engines, count(*) filter (where ok) as successful_engines, count(*) filter (where not ok) as failed_engines, coalesce(string_agg(kind, ',' order by kind) filter (where ok), '') as results, coalesce(string_agg(kind, ',' order by kind) filter (where not ok), '') as errors from ({_CRAWLS}) group by target")
def combined_results(spark, sf_dir):
    got = reports.combined(_crawls(spark, sf_dir), "target", "kind")
    return got.withColumn("results", F.array_join("results", ",")).withColumn("errors", F.array_join("errors", ","))


@query("split_results", f"select event_id, ok, case when ok then 'results' else 'errors' end as part from ({_CRAWLS})")
def split_results(spark, sf_dir):
    good, bad = reports.split_results(_crawls(spark, sf_dir))
    return good.select("event_id", "ok", F.lit("results").alias("part")).unionByName(bad.select("event_id", "ok", F.lit("errors").alias("part")))


@query("merged_tags", "select n_nationkey, 'a=' || n_name || ',b=' || r_name || ',c=new' as tags from nation join region on n_regionkey = r_regionkey")
def merged_tags(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    old, new = F.create_map(F.lit("a"), F.col("n_name"), F.lit("b"), F.lit("old")), F.create_map(F.lit("b"), F.col("r_name"), F.lit("c"), F.lit("new"))
    tags = F.transform(F.array_sort(F.map_entries(reports.merged_tags(old, new))), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return rows.select("n_nationkey", F.array_join(tags, ",").alias("tags"))


@query("top_tools", "select c_nationkey, c_custkey, rank from (select c_nationkey, c_custkey, cast(row_number() over (partition by c_nationkey order by c_acctbal desc nulls last, c_custkey) as int) as rank from customer) where rank <= 3")
def top_tools(spark, sf_dir):
    return reports.top_by(table(spark, sf_dir, "customer"), "c_nationkey", "c_acctbal", "c_custkey", 3).select("c_nationkey", "c_custkey", "rank")


@query("question_cap", "select conv_id, turn from (select conv_id, turn, row_number() over (partition by conv_id order by turn) as n from conversations where role = 'user') where n <= 2 order by conv_id, turn limit 50")
def question_cap(spark, sf_dir):
    """Two questions of a context and fifty in all: the limits are the feature."""
    users = table(spark, sf_dir, "conversations").where("role = 'user'")
    return reports.capped(users, "conv_id", ["conv_id", "turn"], 2, 50).select("conv_id", "turn")


@query("turn_ends", "select conv_id, min_by(text, turn) filter (where role = 'user' and text is not null) as question, max_by(text, turn) filter (where role = 'assistant' and text is not null) as answer from conversations group by conv_id")
def turn_ends(spark, sf_dir):
    return reports.turn_ends(table(spark, sf_dir, "conversations"))


@query("sorted_listing", "select page_id, url, cast(row_number() over (order by url, page_id) as int) as place from pages")
def sorted_listing(spark, sf_dir):
    """Places in the order of addresses: counted by range partitions, so that no task holds all rows."""
    return reports.places(_pages(spark, sf_dir).select("page_id", "url"), ["url", "page_id"])


@query("evaluation_report", "select count(*) as items, count(*) filter (where value >= 60) as passed, round(avg(value), 6) as mean_score, round(count(*) filter (where value >= 60) / count(*), 6) as pass_rate from events")
def evaluation_report(spark, sf_dir):
    report, _ = reports.evaluation(table(spark, sf_dir, "events").withColumnRenamed("value", "score"), 60)
    return report.select("items", "passed", F.round("mean_score", 6).alias("mean_score"), F.round("pass_rate", 6).alias("pass_rate"))


@query("all_transcripts", "select 'pair' as kind, question, answer, null as stage from (select text as question, lead(text) over w as answer, role, lead(role) over w as next_role from conversations window w as (partition by conv_id order by turn)) where role = 'user' and next_role = 'assistant' union all select 'call', text, null, role from conversations")
def all_transcripts(spark, sf_dir):
    """Pairs, and the transcript of every call; columns that one side lacks are null."""
    from millrace.plans.relations import _pairs

    calls = table(spark, sf_dir, "conversations").select(F.lit("call").alias("kind"), F.col("text").alias("question"), F.col("role").alias("stage"))
    pairs = _pairs(spark, sf_dir).select(F.lit("pair").alias("kind"), "question", "answer")
    return pairs.unionByName(calls, allowMissingColumns=True)


# --- crawled records, images, lookups, run reports ---

_TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"
_LANG = "regexp_extract(html, '(?i)<html[^>]* lang=[\"'']?([A-Za-z-]+)', 1)"
_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))"
_HREFS = "list_filter(regexp_extract_all(html, '(?i)<a [^>]*href=[\"'']([^\"'']*)[\"'']', 1), lambda x: x <> '' and not regexp_matches(lower(x), '^(javascript:|mailto:|tel:)'))"


@query("page_markdown", f"""with p as (select page_id, url, {_TITLE} as t, {_LANG} as g, {_TEXT} as x, list_transform({_HREFS}, lambda h: '- [Link](' || h || ')') as l from pages)
select page_id, concat_ws(chr(10), '# ' || case when t = '' then 'Web Page' else t end || chr(10), '**URL:** [' || url || '](' || url || ')' || chr(10), case when g <> '' then '**Language:** ' || g || chr(10) end, case when x <> '' then '## Content' || chr(10) || chr(10) || x || chr(10) end,
case when len(l) > 0 then '## Links' || chr(10) || chr(10) || array_to_string(case when len(l) > 20 then list_append(l[1:20], chr(10) || '*... and ' || (len(l) - 20) || ' more links*') else l end, chr(10)) || chr(10) end) as markdown from p""")
def page_markdown(spark, sf_dir):
    h, none = F.col("html"), F.lit(None).cast("string")
    links = F.transform(html.hrefs_of(h), lambda x: F.struct(x.alias("url"), F.lit("").alias("text")))
    return _pages(spark, sf_dir).select("page_id", crawl.page_markdown(html.title_of(h), F.col("url"), none, html.lang_of(h), html.text_of(h), links, none).alias("markdown"))


@query("paper_markdown", """select page_id, '# ' || url || chr(10) || chr(10) || '**ArXiv ID:** ' || page_id || chr(10) || chr(10) || '**Authors:** A, B' || chr(10) || chr(10) || '**Published:** d0' || chr(10) || case when page_id % 2 = 1 then chr(10) || '**Updated:** d1' || chr(10) else '' end || chr(10) || '## Abstract' || chr(10) || chr(10) || 'about ' || url || chr(10) as markdown from pages""")
def paper_markdown(spark, sf_dir):
    none = F.lit(None).cast("string")
    updated = F.concat(F.lit("d"), (F.col("page_id") % 2).cast("string"))
    got = crawl.paper_markdown(F.col("url"), F.col("page_id").cast("string"), F.array(F.lit("A"), F.lit("B")), F.array().cast("array<string>"), F.lit("d0"), updated, none, none, F.concat(F.lit("about "), "url"), none)
    return _pages(spark, sf_dir).select("page_id", got.alias("markdown"))


@query("search_results", "select url, trim(url) as title, 'about ' || page_id as description, '' as summary, '' as site_name, cast(page_id as varchar) as date_published, url as display_url from pages")
def search_results(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("url", F.lit(" ").alias("title"), F.col("url").alias("name"), F.concat(F.lit("about "), "page_id").alias("snippet"), F.col("page_id").alias("dateLastCrawled"))
    return crawl.search_results(rows)


@query("image_marks", rf"select doc_id, '||image_placeholder_0|| ' || text || ' ||image_placeholder_1|| ||image_placeholder_2||' as text, 'x' || doc_id || '.png,y.png,x' || doc_id || '.png' as images, '0,1,2' as places from documents")
def image_marks(spark, sf_dir):
    image = F.concat(F.lit("](x"), "doc_id", F.lit(".png)"))
    text = F.concat(F.lit("![a"), image, F.lit(" "), "text", F.lit(" ![b](y.png) !["), image)
    rows = _docs(spark, sf_dir).select("doc_id", text.alias("t")).select("doc_id", images.with_marks(F.col("t")).alias("text"), images.images_of(F.col("t")).alias("i"))
    return rows.select("doc_id", "text", F.array_join("i", ",").alias("images"), F.array_join(images.marked_places(F.col("text")).cast("array<string>"), ",").alias("places"))


@query("tree_lookup", "select c_custkey, r_name || '/' || n_name as path from customer left join nation on c_nationkey = n_nationkey and c_nationkey % 3 > 0 left join region on n_regionkey = r_regionkey")
def tree_lookup(spark, sf_dir):
    """Each customer's label, known for two thirds of the nations, to its path in the tree; null for the others. One label is there twice: the first, depth first, stands."""
    top = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("label"), F.col("r_regionkey").alias("ordinal"))
    nation = table(spark, sf_dir, "nation")
    leaf = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("label"), F.col("n_nationkey").alias("ordinal"))
    again = nation.where("n_nationkey = 7").select(F.lit("again").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("n_name").alias("label"), F.lit(99).alias("ordinal"))
    places = tree.first_paths(top.unionByName(leaf).unionByName(again)).select("label", "path")
    labels = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 3 > 0, F.concat(F.lit("NATION_"), "c_nationkey")).otherwise("").alias("label"))
    return labels.join(places, "label", "left").select("c_custkey", "path")


@query("run_report", """with c as (select event_type as stage, user_id as run_id, epoch_us(ts) / 1e6 as s, value as d, cast(user_id as bigint) as p, cast(json_extract_string(props, '$.k') as bigint) as q from events),
g as (select stage, count(distinct run_id) as runs, count(*) as requests, sum(d) as request_seconds, max(s + d) - min(s) as seconds, sum(p) as prompt_tokens, sum(coalesce(q, 0)) as completion_tokens from c group by stage)
select stage, runs, requests as items, requests, cast(prompt_tokens as bigint) as prompt_tokens, cast(completion_tokens as bigint) as completion_tokens, round(seconds, 1) as seconds, round(requests / seconds, 6) as items_per_second, round(60 * requests / seconds, 6) as items_per_minute,
round(request_seconds / requests, 6) as seconds_per_request, round(60 * requests / seconds, 6) as requests_per_minute, round(request_seconds / seconds, 6) as concurrency, round((prompt_tokens + completion_tokens) / seconds, 6) as tokens_per_second, round((prompt_tokens + completion_tokens) / requests, 6) as tokens_per_request from g""")
def run_report(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    calls = e.select(F.col("event_type").alias("stage"), F.col("user_id").alias("run_id"), F.col("ts").alias("started"), F.col("value").alias("seconds"), F.col("user_id").alias("prompt_tokens"), F.get_json_object("props", "$.k").cast("long").alias("completion_tokens"), F.lit(1).alias("items"))
    got = metrics.run_report(calls)
    rounded = ("items_per_second", "items_per_minute", "seconds_per_request", "requests_per_minute", "concurrency", "tokens_per_second", "tokens_per_request")
    return got.select("stage", "runs", "items", "requests", "prompt_tokens", "completion_tokens", F.round("seconds", 1).alias("seconds"), *[F.round(c, 6).alias(c) for c in rounded])


@query("may_retry", "select event_id, event_type = 'view' or user_id % 600 in (408, 409, 425, 429, 500, 502, 503, 504) or (event_type = 'error' and true) as again from (select event_id, event_type, user_id from events)")
def may_retry(spark, sf_dir):
    """No answer for views, a rate limit for errors, else the user's number as a status."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "view", None).when(F.col("event_type") == "error", 400).otherwise(F.col("user_id") % 600)
    body = F.when(F.col("event_type") == "error", "Rate limit").otherwise("x")
    return e.select("event_id", filters.retryable(status, body).alias("again"))


@query("run_totals", """with c as (select user_id as run_id, epoch_us(ts) / 1e6 as s, value as d, cast(user_id as bigint) as p, cast(json_extract_string(props, '$.k') as bigint) as q from events),
g as (select count(distinct run_id) as runs, count(*) as requests, sum(d) as request_seconds, max(s + d) - min(s) as seconds, sum(p) + sum(coalesce(q, 0)) as tokens from c)
select runs, requests, cast(tokens as bigint) as total_tokens, round(60 * requests / seconds, 6) as requests_per_minute, round(tokens / seconds, 6) as tokens_per_second from g""")
def run_totals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    calls = e.select(F.col("user_id").alias("run_id"), F.col("ts").alias("started"), F.col("value").alias("seconds"), F.col("user_id").alias("prompt_tokens"), F.get_json_object("props", "$.k").cast("long").alias("completion_tokens"), F.lit(1).alias("items"))
    return metrics.run_totals(calls).select("runs", "requests", "total_tokens", F.round("requests_per_minute", 6).alias("requests_per_minute"), F.round("tokens_per_second", 6).alias("tokens_per_second"))


@query("preview_pairs", "select conv_id, turn, text[1:80] as question from conversations where role = 'user' order by conv_id, turn limit 10")
def preview_pairs(spark, sf_dir):
    """The first ten questions, cut: the limit is the feature."""
    rows = table(spark, sf_dir, "conversations").where("role = 'user'").orderBy("conv_id", "turn").limit(10)
    return rows.select("conv_id", "turn", F.substring("text", 1, 80).alias("question"))


@query("search_order", "select event_id, user_id, value, cast(row_number() over (order by value desc nulls last, event_id) as int) as rank from events order by value desc nulls last, event_id limit 20")
def search_order(spark, sf_dir):
    """The twenty most relevant results, by value, with their rank: the limit is the feature."""
    return reports.top_by(table(spark, sf_dir, "events").withColumn("all", F.lit(1)), "all", "value", "event_id", 20).select("event_id", "user_id", "value", "rank")


@query("concat_items", "select 'document' as kind, cast(doc_id as bigint) as id, text as content from documents union all select 'page', page_id, html from pages")
def concat_items(spark, sf_dir):
    """Parsed items of different kinds in one table."""
    d = _docs(spark, sf_dir).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return d.unionByName(_pages(spark, sf_dir).select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("content")))


_SAID = "case when role = 'user' and turn % 2 = 0 then '<image>' || text else text end"


@query("valid_messages", f"select conv_id, count(*) >= 2 and bool_or(role = 'user') and bool_or(role = 'assistant') and sum(len(regexp_extract_all({_SAID}, '<image>'))) = 1 as valid from conversations group by conv_id")
def valid_messages(spark, sf_dir):
    """Conversations with an image token in every other user turn, and one image each."""
    c = table(spark, sf_dir, "conversations")
    said = F.when((F.col("role") == "user") & (F.col("turn") % 2 == 0), F.concat(F.lit("<image>"), "text")).otherwise(F.col("text"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", said.alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return c.groupBy("conv_id").agg(turns.alias("m")).select("conv_id", images.valid_messages(F.col("m"), F.array(F.lit("/a.png"))).alias("valid"))
