"""The registered queries of this subpackage, with the SQL of those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from . import chat, decontaminate, language, lexical, licences, mixing, quality, simhash, substring, topk, toxicity, url_filter, whitening
from .tables import WORD, table

#: Rules by host and path, and the sites that the list of unwanted sites holds.
URL_RULES = (
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
)
UNWANTED = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
UNWANTED_SITES = tuple(f"{name}.example.{end}" for name in UNWANTED for end in ("com", "net", "org"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = chat.rotate(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["begin"], m["end"])), " ")
    return rendered.select("conv_id", "perspective", "part", F.col("begin").cast("long").alias("begin"), "text", F.col("n_turns").cast("long").alias("n_turns"), spans.alias("mask"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.classify(documents.select("doc_id", "text"), labels.select("doc_id", "quality"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    graded = toxicity.severity(documents, toxicity.fit(documents, labels))
    return graded.withColumn("held_out", quality.held_out(F.col("doc_id")))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.leaks(documents.select("doc_id", "text"), items.select("item_id", "text"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removed_words(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(s,) for s in UNWANTED_SITES], "site string")
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES, listed)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.curriculum(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    millionths = F.array_join(F.transform("positions", lambda p: F.floor(p * 1_000_000).cast("string")), " ")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", millionths.alias("positions"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


_OP1 = """
with once as (
    select conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as said, count(*) as times from conversations group by all
), said as (
    select conv_id, turn, speaker, said, row_number() over (partition by conv_id order by turn nulls first, speaker, said) - 1 as number
    from (select *, unnest(range(case when turn is null then times else 1 end)) from once)
), people as (
    select distinct conv_id, speaker as perspective from said where speaker <> 'system'
), pieces as (
    select s.conv_id, p.perspective, s.number // 64 as part, s.number, s.speaker = p.perspective as mine,
        '<|' || case when s.speaker = p.perspective then 'assistant' when s.speaker = 'system' then 'system'
            else 'user name=' || regexp_replace(s.speaker, '[^\\p{L}\\p{N}_-]', '_', 'g') end || '|>' || chr(10) as head,
        replace(s.said, '<|', '< |') as said
    from said s join people p on s.conv_id is not distinct from p.conv_id
), placed as (
    select *, coalesce(sum(length(head) + length(said) + 1) over (partition by conv_id, perspective order by number rows between unbounded preceding and 1 preceding), 0)::bigint as pos from pieces
)
select conv_id, perspective, part, min(pos)::bigint as begin, string_agg(head || said || chr(10), '' order by number) as text, count(*) as n_turns,
    coalesce(string_agg((pos + length(head))::varchar || '-' || (pos + length(head) + length(said))::varchar, ' ' order by number) filter (where mine), '') as mask
from placed group by conv_id, perspective, part"""

_KNOWN = licences.SENTENCES | licences.TEXTS
#: Marks stand twice in the SQL's normalised text, for its patterns cannot look behind.
_OP5_FOUND = "[\\x01\\x02](?:%s)[\\x01\\x02]" % "|".join(licences.pattern_of(k, "(?: |\\x02\\x02)") for k in licences.by_length(_KNOWN))
_OP5_IDS = " ".join(f"when s = '{k}' then '{i}'" for k, i in _KNOWN.items() if "*" not in k) + " " + " ".join(f"when regexp_full_match(s, '{licences.pattern_of(k)}') then '{i}'" for k, i in _KNOWN.items() if "*" in k)
_OP5_RULES = " ".join(f"when regexp_matches(' ' || replace(sentence_ids, ' ', '  ') || ' ', '{'.*'.join(f' {i} ' for i in r.sequence)}') then '{r.licence}'" for r in licences.TEXT_RULES + licences.RULES)
_OP5_STEPS = (
    (r"\r\n?", "chr(10)"), (r"[.!?]\s", "chr(1)"), (r"\n[^a-z0-9\n\x01]*\n", "chr(1)"), (r"\n|[;:][ \t]", "chr(2)"), (r"\.+(\.[0-9])", r"' \1'"), (r"\.+([^0-9.]|$)", r"' \1'"),
    (r"[^a-z0-9.\x01\x02]+", "' '"), (r" +", "' '"), (r" ?\x02[ \x02]*", "chr(2)"), (r" ?\x01[ \x01]*", "chr(1)"),
)
_OP5_PLAIN = "chr(1) || regexp_replace(lower(text), '[\\x01\\x02]', '-', 'g') || chr(1)"
for _found, _instead in _OP5_STEPS:
    _OP5_PLAIN = f"regexp_replace({_OP5_PLAIN}, '{_found}', {_instead}, 'g')"
_OP5 = f"""
with plain as (
    select doc_id, case when regexp_matches(text, '{licences.MAYBE}') then replace(replace({_OP5_PLAIN}, chr(1), chr(1) || chr(1)), chr(2), chr(2) || chr(2)) else '' end as t from documents
), found as (
    select doc_id, list_transform(regexp_extract_all(t, '{_OP5_FOUND}'), lambda x: replace(replace(x[2:-2], chr(2) || chr(2), ' '), chr(2), '')) as ss from plain
), named as (
    select doc_id, len(ss)::bigint as n_sentences, array_to_string(list_transform(ss, lambda s: case {_OP5_IDS} end), ' ') as sentence_ids from found
)
select *, case {_OP5_RULES} end as licence from named"""

_OP8 = """
with parts as (
    select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages
), named as (
    select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts
), ruled as (
    select *, case
        when (host = 'example.org' or suffix(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
        when (host = 'example.org' or suffix(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
        when (host = 'com' or suffix(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
        when (host = 'com' or suffix(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
        when (host = 'org' or suffix(host, '.org')) and starts_with(path, '/') then 'org/' end as rule
    from named
)
select page_id, host, path, rule, case
    when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block'
    when regexp_matches(host, '^(.*\\.)?(%s)\\.example\\.(com|net|org)$') then 'block' else 'allow' end as verdict
from ruled""" % "|".join(UNWANTED)

_OP9 = f"""
with sized as (
    select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
           md5(coalesce(doc_id::varchar, 'text ' || coalesce(text, ''))) as place from documents
), by_source as (
    select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as source_no from sized group by source
), weighed as (
    select *, case source_no % 3 when 0 then 5 when 1 then 2 else 1 end as weight, 3 * source_size as cap from by_source
), filled as (
    select *, cap::double / weight as full_at from weighed
), levels as (
    select *, (sum(source_size) over () * 1.0::double
        - coalesce(sum(cap) over (order by full_at, source_no rows between unbounded preceding and 1 preceding), 0)::double)
        / (sum(weight) over (order by full_at, source_no rows between current row and unbounded following))::double as level from filled
), targets as (
    select source, source_size, case source_no % 3 when 0 then -0.5 when 1 then 0.0 else 0.5 end::double as tilt, coalesce(least(weight * (select arg_min(level, (full_at, source_no)) from levels where level <= full_at), cap::double), cap::double) as target from levels
), placed as (
    select s.*, t.source_size, t.target, t.tilt,
        coalesce(sum(size) over (partition by s.source order by place, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before,
        case when t.source_size > 0 then floor(t.target / t.source_size)::bigint else 0 end as passes
    from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target, (size * times)::bigint as taken, array_to_string(list_transform(list_transform(range(times), lambda i: least((i * source_size + before) / target, 1.0::double)),
    lambda share: floor(case when tilt = 0 then share else ((1 + tilt) - sqrt(greatest((1 + tilt) * (1 + tilt) - 4 * tilt * share, 0.0::double))) / (2 * tilt) + 0.0 end * 1000000)::bigint), ' ') as positions
from (select *, passes + case when before::double + size::double / 2 < target - (passes * source_size)::double then 1 else 0 end as times from placed) p"""

_OP10 = """
with vectors as (
    select row_number() over () as no, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
    where vec_id is not null and embedding is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
    select q.no, q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
    from vectors q join vectors c on q.vec_id % 50 = 0 and q.no <> c.no
), ranked as (
    select *, row_number() over (partition by no order by score desc, vec_id)::integer as rank from pairs
)
select query_id, rank, vec_id, score from ranked where rank <= 5"""

_OP11 = """
with words as (
    select doc_id, row_number() over () as d, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ws from documents
), sizes as (
    select count(*)::bigint as n_docs, sum(len(ws))::bigint as length from words where len(ws) > 0
), postings as (
    select d, doc_id, n, term, count(*)::bigint as tf from (select d, doc_id, len(ws)::bigint as n, unnest(ws) as term from words) group by all
), frequent as (
    select term, count(*)::bigint as df from postings group by term
), asked as (
    select i, item_id, term, count(*)::bigint as times from (
        select item_id, row_number() over () as i, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark) group by all
), scored as (
    select i, any_value(item_id) as item_id, d, any_value(doc_id) as doc_id,
        sum(times * floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)::double))::bigint * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * n_docs) // length)))))::bigint as score
    from asked join frequent using (term) join postings using (term), sizes group by i, d
), ranked as (
    select *, row_number() over (partition by i order by score desc, doc_id nulls last)::integer as rank from scored where score > 0
)
select item_id, rank, doc_id, score from ranked where rank <= 20"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_license_scans": op5_license_scans,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_url_filters": op8_url_filters,
    "op9_mixing": op9_mixing,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_ranked_search": op11_ranked_search,
    "op12_language_id": op12_language_id,
    "op13_whitening": op13_whitening,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {"op1_chat_formatting": _OP1, "op5_license_scans": _OP5, "op8_url_filters": _OP8, "op9_mixing": _OP9, "op10_exact_top_k": _OP10, "op11_ranked_search": _OP11}
