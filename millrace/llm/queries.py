"""The queries of this subpackage: one opN_<name> an operator, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chroma, golay_dedup, language_codes, local_parsing, mixing, piece_agenda, rule_ensemble, secret_automaton, token_files, warc
from millrace.session import table

PIECES = "piece_bpe_32k.model"
BYTE_TOKENIZER = "byte_bpe_50k.json"
END_ID = 2


def op1_chroma_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's UTF-8 bytes, read as 8-bit PCM, are the media column."""
    docs = table(spark, sf_dir, "documents")
    media = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("media"))
    return chroma.align(media, "doc_id", "media").withColumnRenamed("rec_id", "doc_id")


def op2_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_codes.fit(docs.where(~language_codes.held_out()))
    return language_codes.identify(docs, model)


def op3_piece_agenda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_agenda.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), keep=False)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_TOKENIZER), END_ID, keep=False)


def op5_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.capture_digests(warc.captures(pages), pages.schema["page_id"].dataType.simpleString())


def op6_secret_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_automaton.scan_secrets(table(spark, sf_dir, "documents"))


def op7_golay_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = golay_dedup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rule_ensemble.scored(docs, rule_ensemble.fit(docs, table(spark, sf_dir, "labels")))


def op9_hash_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_local_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local_parsing.compare_with_edits(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_chroma_align, op2_language_codes, op3_piece_agenda, op4_token_files, op5_warc_captures, op6_secret_automaton, op7_golay_dedup, op8_rule_ensemble, op9_hash_mix, op10_local_parsing, pipeline]
    return {f.__name__: f for f in own}


#: Records keep what pages have, so the archives' digests can be said of the pages.
_OP5 = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
  from pages
), f as (
  select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest
)
select p.page_id, cast(p.payload_bytes as bigint) as payload_bytes, p.payload_digest,
  case when p.page_id > f.first then 'revisit' else 'response' end as record_type,
  case when p.page_id > f.first then f.first end as refers_to, true as digest_holds
from p left join f on p.payload_bytes >= 100 and p.payload_digest = f.payload_digest
"""

#: The same thresholds, found by sorting all hashes.
_OP9 = r"""
with recursive d as (
  select doc_id, source, cast(case when text is null then 0 else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end as bigint) as size,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h
  from documents
), s as (
  select source, cast(sum(size) as double) as source_size,
    [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w
  from d group by source
), fill as (
  select 0 as round, source, source_size, w, false as is_full, cast(0 as double) as target from s
  union all
  select round + 1, source, source_size, w, is_full or share >= 2 * source_size,
    case when is_full or share >= 2 * source_size then 2 * source_size else share end
  from (
    select *, w * (1.5 * sum(source_size) over () - coalesce(sum(2 * source_size) filter (where is_full) over (), 0))
      / nullif(sum(w) filter (where not is_full) over (), 0) as share
    from fill
  ) where round < (select count(*) + 1 from s)
), t as (
  select source, source_size, target, floor(target / nullif(source_size, 0)) as turns
  from fill where round = (select max(round) from fill)
), c as (
  select d.*, t.source_size, t.target, coalesce(t.turns, 0) as turns, t.target - coalesce(t.turns, 0) * t.source_size as rest,
    sum(size) over (partition by d.source order by h range between unbounded preceding and current row) as upto,
    sum(size) over (partition by d.source, h) as own
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, cast(source_size as bigint) as source_size, round(target, 3) as target,
  cast(size * (turns + case when upto <= rest or (upto - own <= rest and 2 * (rest - (upto - own)) >= own) then 1 else 0 end) as bigint) as taken
from c
"""


#: Kind, expression, group whose length counts, least length.
_SECRETS = (
    ("assign", r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("github", "gh[pousr]_[A-Za-z0-9]+", 0, 24),
    ("slack", "xox[abprs]-[A-Za-z0-9-]+", 0, 20),
    ("pem", "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 5),
)


def _op6() -> str:
    """Each match is put between marks, with the group that counts; places follow from the lengths of what stands before."""

    def marked(pattern: str, group: int) -> str:
        return "regexp_replace(t, '" + pattern.replace("'", "''") + f"', chr(1) || '\\0' || chr(3) || '\\{group}' || chr(2), 'g')"

    kinds = ", ".join(f"'{k}'" for k, *_ in _SECRETS)
    least = ", ".join(str(n) for *_, n in _SECRETS)
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
m as (select doc_id, unnest(range(1, {len(_SECRETS) + 1})) as k, unnest([{", ".join(marked(p, g) for _, p, g, _ in _SECRETS)}]) as s from d),
p as (select doc_id, k, string_split(s, chr(1)) as parts from m where contains(s, chr(1))),
l as (select *, list_transform(parts[2:], lambda x: len(split_part(x, chr(3), 1)) + len(split_part(x, chr(2), 2))) as sizes, unnest(range(2, len(parts) + 1)) as i from p),
f as (
  select doc_id, k, len(parts[1]) + coalesce(list_sum(sizes[1:i - 2]), 0) as a, len(split_part(parts[i], chr(3), 1)) as n,
    len(split_part(split_part(parts[i], chr(3), 2), chr(2), 1)) as g from l
),
h as (select doc_id, k, cast(a as bigint) as a, ([{kinds}])[k] || ':' || cast(a as bigint) || ':' || cast(a + n as bigint) as span from f where g >= ([{least}])[k]),
r as (
  select doc_id, count(*) filter (where k = 1) as n_assign, count(*) filter (where k = 2) as n_access, count(*) filter (where k = 3) as n_hex,
    string_agg(span, ',' order by a, k) filter (where k <= 3) as base, string_agg(span, ',' order by a, k) as spans, count(*) as n from h group by doc_id
)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(n, 0) as n_secrets
from d left join r on d.doc_id = r.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_secret_automaton": _op6(), "op5_warc_captures": _OP5, "op9_hash_mix": _OP9.replace("round(target, 3) as target", "target")}
