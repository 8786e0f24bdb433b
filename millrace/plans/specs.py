"""Queries over API endpoints. The endpoints are five operations on each nation, tagged with its region."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import spec
from millrace.plans.catalogue import query
from millrace.session import table

_METHODS = ("post", "put", "get", "patch", "delete")
_ENDPOINTS = """with e as (
  select n_nationkey as n, i, ['post', 'put', 'get', 'patch', 'delete'][i + 1] as method, '/' || lower(n_name) || case when i = 0 then '' when i = 4 then '/all' else '/{id}/part' end as path, n_nationkey * 5 + i as ordinal,
    case when n_nationkey % 7 = 0 then [] else [r_name, 'all'] end as tags, case when i = 2 then ['post_' || (n_nationkey + 1), 'nobody', 'put_' || n_nationkey] else [] end as dependencies
  from nation join region on n_regionkey = r_regionkey, (select unnest(range(5)) as i)
), ep as (select *, method || '_' || n as identifier from e)
"""


def endpoints(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n = n.withColumn("i", F.explode(F.array(*map(F.lit, range(5))))).withColumn("method", F.element_at(F.array(*map(F.lit, _METHODS)), F.col("i") + 1))
    key = F.col("n_nationkey")
    empty = F.array().cast("array<string>")
    name = lambda method, k: F.concat(F.lit(method + "_"), k.cast("string"))
    need = lambda *schemes: F.create_map(*[x for s in schemes for x in (F.lit(s), empty)])
    return n.select(
        F.concat_ws("_", "method", key.cast("string")).alias("identifier"), "method",
        F.concat(F.lit("/"), F.lower("n_name"), F.when(F.col("i") == 0, "").when(F.col("i") == 4, "/all").otherwise("/{id}/part")).alias("path"), (key * 5 + F.col("i")).alias("ordinal"),
        F.when(key % 7 == 0, empty).otherwise(F.array("r_name", F.lit("all"))).alias("tags"),
        F.when(F.col("i") == 2, F.array(name("post", key + 1), F.lit("nobody"), name("put", key))).otherwise(empty).alias("dependencies"),
        F.when(F.col("i") == 0, F.array(need("oauth", "card"), need("key"))).when(F.col("i") == 1, F.array(need("oauth", "key"))).when(F.col("i") == 2, F.array(need("card"))).otherwise(F.array().cast("array<map<string,array<string>>>")).alias("security"),
    )


def _schemes(spark):
    return spark.createDataFrame([("oauth", "login"), ("key", "query")], "scheme string, provider string")


@query("structural_dependencies", _ENDPOINTS + """, d as (
  select r.ordinal, c.identifier, c.ordinal as o from ep r join ep c on split_part(r.path, '/{', 1) = split_part(c.path, '/{', 1)
  where r.method in ('get', 'patch', 'delete') and contains(r.path, '{') and c.method in ('post', 'put')
), a as (select ordinal, identifier, 1000 + o as p from d union all select ordinal, unnest(dependencies), unnest(range(len(dependencies))) from ep), f as (select ordinal, identifier, min(p) as p from a group by all)
select ep.identifier, coalesce(string_agg(f.identifier, ',' order by p), '') as dependencies from ep left join f on ep.ordinal = f.ordinal group by ep.identifier""")
def structural_dependencies(spark, sf_dir):
    got = spec.structural_dependencies(endpoints(spark, sf_dir))
    return got.select("identifier", F.array_join("dependencies", ",").alias("dependencies"))


@query("dependency_chains", _ENDPOINTS + """, d as (select ordinal, identifier, unnest(dependencies) as needs, unnest(range(len(dependencies))) as p from ep)
select d.identifier, string_agg(needs, ',' order by p) || ',' || d.identifier as chain from d join ep k on d.needs = k.identifier group by d.identifier""")
def dependency_chains(spark, sf_dir):
    return spec.chains(endpoints(spark, sf_dir)).select("identifier", F.array_join("chain", ",").alias("chain"))


@query("endpoints_by_tag", _ENDPOINTS + ", t as (select identifier, ordinal, unnest(case when len(tags) = 0 then ['untagged'] else tags end) as tag from ep) select tag, cast(min(ordinal) as int) as position, string_agg(identifier, ',' order by ordinal) as identifiers from t group by tag")
def endpoints_by_tag(spark, sf_dir):
    return spec.by_tag(endpoints(spark, sf_dir)).select("tag", "position", F.array_join("identifiers", ",").alias("identifiers"))


@query("tag_previews", _ENDPOINTS + """, t as (select identifier, ordinal, upper(method) || ' ' || path as line, unnest(case when len(tags) = 0 then ['untagged'] else tags end) as tag from ep), l as (select tag, list(line order by ordinal) as l from t group by tag)
select tag, array_to_string(case when len(l) > 8 then list_append(l[1:8], '... +' || (len(l) - 8) || ' more') else l end, chr(10)) as text from l""")
def tag_previews(spark, sf_dir):
    return spec.describe(endpoints(spark, sf_dir).withColumn("summary", F.lit(None).cast("string")), 8)


@query("used_tools", _ENDPOINTS + """, c as (select conv_id, list(method order by turn) as tools from (select conv_id, turn, case role when 'user' then 'post_' when 'assistant' then 'get_' else 'none_' end || (turn % 25) as method from conversations) group by conv_id),
x as (select conv_id, unnest(tools) as tool, unnest(range(len(tools))) as p from c) select conv_id, string_agg(path, ',' order by p) as tools from x join ep on tool = identifier group by conv_id""")
def used_tools(spark, sf_dir):
    """Each conversation's turns as calls of tools, with the paths of those in the catalogue."""
    turns = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", "post_").when(F.col("role") == "assistant", "get_").otherwise("none_")
    calls = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(kind, (F.col("turn") % 25).cast("string")).alias("t")))).alias("c"))
    calls = calls.select("conv_id", F.transform("c", lambda x: x["t"]).alias("tools"))
    got = spec.used_tools(calls, endpoints(spark, sf_dir).select("identifier", "path"), "conv_id")
    return got.select("conv_id", F.array_join(F.transform("tools", lambda x: x["path"]), ",").alias("tools"))


@query("endpoint_providers", _ENDPOINTS + "select identifier, case i when 0 then 1 when 1 then 0 else -1 end as requirement, case i when 0 then 'query' when 1 then 'login,query' end as providers from ep where i < 3")
def endpoint_providers(spark, sf_dir):
    """post asks for two schemes of which one has no provider, or for one that has; put for two that have; get for one that has none."""
    got = spec.providers(endpoints(spark, sf_dir), _schemes(spark))
    return got.select("identifier", F.coalesce("requirement", F.lit(-1)).alias("requirement"), F.array_join("providers", ",").alias("providers"))


@query("unprovided_schemes", "select 'card' as scheme")
def unprovided_schemes(spark, sf_dir):
    return spec.unprovided(endpoints(spark, sf_dir), _schemes(spark))


@query("tool_names", _ENDPOINTS + "select ordinal, case when i = 0 then identifier else method || '_' || replace(replace(replace(trim(path, '/'), '/', '_'), '{', ''), '}', '') end as name from ep")
def tool_names(spark, sf_dir):
    rows = endpoints(spark, sf_dir)
    return rows.select("ordinal", spec.tool_name(F.when(F.col("method") == "post", F.col("identifier")).otherwise(""), F.col("method"), F.col("path")).alias("name"))


@query("known_tools", _ENDPOINTS + ", a as (select conv_id, turn, ['get_' || (turn % 40), 'post_' || (conv_id % 30)] as p from conversations), k as (select list(identifier order by ordinal) as names from ep) select conv_id, turn, array_to_string(case when len(list_filter(p, lambda x: list_contains(names, x))) > 0 then list_filter(p, lambda x: list_contains(names, x)) else names[1:1] end, ',') as tools from a, k")
def known_tools(spark, sf_dir):
    """Two proposed tools a turn, those that are known kept, else the first of all."""
    names = endpoints(spark, sf_dir).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "identifier"))), lambda x: x["identifier"]).alias("names"))  # one row of metadata
    turns = table(spark, sf_dir, "conversations")
    proposed = F.array(F.concat(F.lit("get_"), (F.col("turn") % 40).cast("string")), F.concat(F.lit("post_"), (F.col("conv_id") % 30).cast("string")))
    return turns.join(names, F.lit(True)).select("conv_id", "turn", F.array_join(spec.known_tools(proposed, F.col("names")), ",").alias("tools"))
