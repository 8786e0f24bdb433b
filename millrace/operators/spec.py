"""API specifications as tables of endpoints: loading, references, dependencies, tags, tools and authentication.

An endpoint has an identifier, a method, a path, an ordinal (its place in the
specifications) and arrays of tags, dependencies and security requirements. A
specification is small metadata, read on the driver; what is derived from many is
joins.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

METHODS = ("get", "post", "put", "patch", "delete", "head", "options")
SCHEMA = (
    "identifier string, method string, path string, ordinal int, summary string, tags array<string>, dependencies array<string>, "
    "security array<map<string,array<string>>>, servers array<string>, parameters array<string>, request string, response string"
)
#: Keys under which an operation names others that it needs (fixed values).
DEPENDS = ("x-depends-on", "x-dependencies", "xSequence")
#: Media types that are preferred, in this order (fixed values).
JSON_MEDIA = ("application/json", "application/*+json")


# --- one specification, on the driver ---------------------------------------


def merged(low, high):
    """Objects merged key by key; elsewhere ``high`` stands."""
    if isinstance(low, dict) and isinstance(high, dict):
        return {k: merged(low[k], high[k]) if k in low and k in high else high.get(k, low.get(k)) for k in (*low, *(k for k in high if k not in low))}
    return high


def resolve(value, root: dict, trail: tuple = ()):
    """``value`` with references to places in ``root`` replaced by what is there, overlaid by its siblings; a reference within itself stays."""
    if isinstance(value, list):
        return [resolve(x, root, trail) for x in value]
    if not isinstance(value, dict):
        return value
    target = value.get("$ref")
    if not isinstance(target, str) or not target.startswith("#/") or target in trail:
        return {k: resolve(v, root, trail) for k, v in value.items()}
    at = root
    for step in target[2:].split("/"):
        step = step.replace("~1", "/").replace("~0", "~")
        if not isinstance(at, dict) or step not in at:
            return {k: resolve(v, root, trail) for k, v in value.items()}
        at = at[step]
    rest = {k: resolve(v, root, trail) for k, v in value.items() if k != "$ref"}
    found = resolve(at, root, (*trail, target))
    return merged(found, rest) if rest else found


def summary(schema, most: int = 6) -> str:
    """A schema in one line: type, array<...>, enum values, alternatives by bars, parts by ampersands, the first properties."""
    if not isinstance(schema, dict):
        return "any"
    for key, mark in (("oneOf", " | "), ("anyOf", " | "), ("allOf", " & ")):
        if schema.get(key):
            return mark.join(summary(x, most) for x in schema[key])
    if schema.get("enum"):
        return "enum(" + ", ".join(map(str, schema["enum"])) + ")"
    if schema.get("type") == "array":
        return f"array<{summary(schema.get('items'), most)}>"
    names = list(schema.get("properties") or {})
    if names:
        shown = [f"{n}: {summary(schema['properties'][n], most)}" for n in names[:most]]
        return "{" + ", ".join(shown + [f"... +{len(names) - most} more"] * (len(names) > most)) + "}"
    return str(schema.get("type") or "any")


def _media(content) -> dict | None:
    content = content if isinstance(content, dict) else {}
    for kind in (*JSON_MEDIA, *content):
        if isinstance(content.get(kind), dict) and isinstance(content[kind].get("schema"), dict):
            return content[kind]["schema"]
    return None


def dependencies(operation: dict) -> list[str]:
    out: list[str] = []
    for key in DEPENDS:
        value = operation.get(key)
        out += [value] if isinstance(value, str) else [str(x) for x in value if isinstance(x, (str, int))] if isinstance(value, list) else []
    return out


def endpoints_of(spec: dict) -> list[tuple]:
    """Rows of SCHEMA, without ordinals, for one specification."""
    servers, common = [s.get("url", "") for s in spec.get("servers") or []], spec.get("security") or []
    out = []
    for path, item in (spec.get("paths") or {}).items():
        for method in METHODS:
            if not isinstance(operation := (item or {}).get(method), dict):
                continue
            operation = resolve(operation, spec)
            answer = next((v for k, v in (operation.get("responses") or {}).items() if str(k).startswith("2")), {})
            request, response = _media((operation.get("requestBody") or {}).get("content")), _media((answer or {}).get("content"))
            security = [{k: [str(s) for s in v or []] for k, v in r.items()} for r in operation.get("security", common) if isinstance(r, dict)]
            names = [p.get("name", "") for p in [*(item.get("parameters") or []), *(operation.get("parameters") or [])] if isinstance(p, dict)]
            as_json = lambda x: None if x is None else json.dumps(x, ensure_ascii=False)
            out.append((operation.get("operationId"), method, path, operation.get("summary") or operation.get("description"), operation.get("tags") or [], dependencies(operation), security, servers, names, as_json(request), as_json(response)))
    return out


def load(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """Endpoints of specifications (name to JSON or YAML text); one that can't be read is left out, a text that is there twice counts once."""
    rows, seen = [], set()
    for _, text in sorted(texts.items()):
        if text in seen:
            continue
        seen.add(text)
        try:
            spec = json.loads(text)
        except ValueError:
            try:
                import yaml

                spec = yaml.safe_load(text)
            except Exception:
                continue
        if isinstance(spec, dict):
            rows += endpoints_of(spec)
    frame = spark.createDataFrame([(*r[:3], k, *r[3:]) for k, r in enumerate(rows)], SCHEMA)
    return frame.withColumn("identifier", tool_name(F.col("identifier"), F.col("method"), F.col("path")))


def discover(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the specifications below a folder, in order of their paths."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,yaml,yml}").load(folder)
    return files.select("path", F.decode("content", "UTF-8").alias("content")).orderBy("path")


# --- names and choices ------------------------------------------------------


def tool_name(identifier: Column, method: Column, path: Column) -> Column:
    """The identifier, else the method and the path with underscores."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "^/+|/+$", ""), "/", "_"), "[{}]", "")
    return F.coalesce(F.nullif(identifier, F.lit("")), F.concat(F.lower(method), F.lit("_"), F.coalesce(F.nullif(clean, F.lit("")), F.lit("root"))))


def first_success(statuses: Column) -> Column:
    """The first status of an array of strings that begins with 2."""
    return F.try_element_at(F.filter(statuses, lambda x: x.startswith("2")), F.lit(1))


def json_first(media: Column) -> Column:
    """The value of a map by media type: JSON's if there, else the first."""
    return F.coalesce(*[F.try_element_at(media, F.lit(k)) for k in JSON_MEDIA], F.try_element_at(F.map_values(media), F.lit(1)))


def known_tools(proposed: Column, known: Column) -> Column:
    """The proposed tools that are known, in order; the first known one where none is."""
    kept = F.filter(proposed, lambda x: F.array_contains(known, x))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, kept).otherwise(F.slice(known, 1, 1))


# --- joins and groups -------------------------------------------------------


def structural_dependencies(endpoints: DataFrame) -> DataFrame:
    """``endpoints`` whose readers (get, patch, delete of a path with a parameter) also depend on the creators (post, put) of the same base path."""
    base = F.split_part("path", F.lit("/{"), F.lit(1))
    makers = endpoints.where(F.col("method").isin("post", "put")).select(base.alias("base"), F.struct("ordinal", F.col("identifier").alias("name")).alias("maker"))
    readers = endpoints.where(F.col("method").isin("get", "patch", "delete") & F.col("path").contains("{")).select(base.alias("own"), F.col("ordinal").alias("reader"))
    found = readers.join(makers, F.col("own") == F.col("base")).groupBy("reader").agg(F.array_sort(F.collect_list("maker")).alias("makers"))
    both = F.when(F.col("makers").isNull(), F.col("dependencies")).otherwise(F.array_union("dependencies", F.transform("makers", lambda x: x["name"])))
    return endpoints.join(found, F.col("ordinal") == F.col("reader"), "left").withColumn("dependencies", both).select(*endpoints.columns)


def chains(endpoints: DataFrame) -> DataFrame:
    """(identifier, chain) of endpoints that depend on known ones: those in order, then the endpoint; unknown names are dropped."""
    wanted = endpoints.select("identifier", "ordinal", F.posexplode("dependencies").alias("pos", "needs"))
    known = endpoints.select(F.col("identifier").alias("known")).distinct()
    got = wanted.join(known, F.col("needs") == F.col("known")).groupBy("ordinal", "identifier").agg(F.array_sort(F.collect_list(F.struct("pos", "needs"))).alias("d"))
    return got.select("identifier", F.concat(F.transform("d", lambda x: x["needs"]), F.array("identifier")).alias("chain"))


def by_tag(endpoints: DataFrame) -> DataFrame:
    """(tag, position, identifiers): endpoints of each tag in order; those without one are untagged; tags in the order they are first seen."""
    rows = endpoints.select("identifier", "ordinal", F.explode_outer("tags").alias("tag")).withColumn("tag", F.coalesce("tag", F.lit("untagged")))
    got = rows.groupBy("tag").agg(F.min("ordinal").alias("position"), F.array_sort(F.collect_list(F.struct("ordinal", "identifier"))).alias("e"))
    return got.select("tag", "position", F.transform("e", lambda x: x["identifier"]).alias("identifiers"))


def used_tools(calls: DataFrame, catalog: DataFrame, key: str, tools: str = "tools") -> DataFrame:
    """(key, tools): the catalogue's entries of each row's calls, in the order of the calls; unknown tools are dropped."""
    rows = calls.select(key, F.posexplode(tools).alias("pos", "called"))
    entry = F.struct(*[F.col(c) for c in catalog.columns])
    got = rows.join(catalog.select(entry.alias("tool")), F.col("called") == F.col("tool.identifier"))
    return got.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "tool"))).alias("t")).select(key, F.transform("t", lambda x: x["tool"]).alias(tools))


def providers(endpoints: DataFrame, schemes: DataFrame) -> DataFrame:
    """(identifier, requirement, providers): the first requirement whose schemes all have a provider in ``schemes`` (scheme, provider); null where none has."""
    rows = endpoints.select("identifier", F.posexplode("security").alias("requirement", "needs")).select("identifier", "requirement", F.explode(F.map_keys("needs")).alias("needed"))
    met = rows.join(schemes, F.col("needed") == F.col("scheme"), "left").groupBy("identifier", "requirement").agg(F.bool_and(F.col("provider").isNotNull()).alias("met"), F.array_sort(F.collect_set("provider")).alias("p"))
    first = met.groupBy("identifier").agg(F.min(F.when(F.col("met"), F.struct("requirement", F.col("p")))).alias("f"))
    return first.select("identifier", "f.requirement", F.col("f.p").alias("providers"))


def unprovided(endpoints: DataFrame, schemes: DataFrame) -> DataFrame:
    """Distinct schemes that endpoints ask for and nobody provides."""
    asked = endpoints.select(F.explode("security").alias("r")).select(F.explode(F.map_keys("r")).alias("scheme")).distinct()
    return asked.join(schemes.select("scheme"), "scheme", "left_anti")


def describe(endpoints: DataFrame, most: int = 8) -> DataFrame:
    """(tag, text): a line an endpoint, the first ``most`` of a tag, and how many more there are."""
    rows = endpoints.withColumn("line", F.concat(F.upper("method"), F.lit(" "), "path", F.coalesce(F.concat(F.lit(" - "), "summary"), F.lit(""))))
    rows = rows.withColumn("tag", F.explode_outer("tags")).withColumn("tag", F.coalesce("tag", F.lit("untagged")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "line"))), lambda x: x["line"])
    from millrace.functions.text_rules import preview

    return rows.groupBy("tag").agg(lines.alias("lines")).select("tag", F.array_join(preview(F.col("lines"), most, "... +{} more"), "\n").alias("text"))
