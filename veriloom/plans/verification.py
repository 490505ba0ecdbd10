"""Queries of mention extraction, evidence and verification over rendered invoices.

The oracles never read text: they derive what a page states from the columns that it is rendered
from.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.dims import ABBREVIATIONS
from ..functions.text import cents
from ..operators import claims as C, mentions as M
from ..operators.evidence import Evidence, build_evidence, union_ocr
from ..operators.pages import ocr_uncovered
from ..sources.rendered import rendered, rendered_sql
from ..sources.shared import kept
from ..sources.tables import table
from .registry import query

TRUTH = f"""
pg as (
    select o_custkey as doc_id, o_orderkey as k, cast(round(o_totalprice * 100) as bigint) as cents, cast(o_orderdate as date) as d, c_nationkey % 2 = 0 as comma,
        c_nationkey % 2 = 0 and o_orderkey % 53 = 0 as broken, o_orderkey % 97 = 0 as injected, cast(row_number() over (partition by o_custkey order by o_orderkey) as integer) as page
    from orders join customer on o_custkey = c_custkey
), numbers as (
    select doc_id, k * 100 as cents from pg union select doc_id, cents from pg union select doc_id, cents % 100000 from pg where comma union select doc_id, cents // 100000 * 100 from pg where broken
), money as (
    select doc_id, cents, 'EUR' as currency from pg union select doc_id, cents % 100000, 'EUR' from pg where broken
), inj as (select distinct doc_id from pg where injected
), inj_numbers as (select doc_id, 100 as cents from inj where (doc_id, 100) not in (select (doc_id, cents) from numbers)
), inj_money as (select doc_id, 100 as cents, 'USD' as currency from inj
), labelled as (select distinct doc_id, cents, 'gross' as label from pg union select doc_id, cents % 100000, 'gross' from pg where broken
), claim as (select *, cast(floor(abs(value) * 100 + 0.5) as bigint) as cents from ({rendered_sql("claim")}) c
), judged as (
    select *, case when (doc_id, cents, currency) in (select (doc_id, cents, currency) from inj_money)
              or ((doc_id, cents) not in (select (doc_id, cents) from numbers) and (doc_id, cents) in (select (doc_id, cents) from inj_numbers)) then 'fromInstruction'
        when (doc_id, cents) in (select (doc_id, cents) from money) and (doc_id, cents, currency) not in (select (doc_id, cents, currency) from money) then 'currencyMismatch'
        when (doc_id, cents) in (select (doc_id, cents) from numbers) then 'ok' else 'notInText' end as verdict
    from claim
), mislabelled as (
    select doc_id, idx, cents from claim where context = 'Total net' and (doc_id, cents) in (select (doc_id, cents) from labelled)
), scans as (
    select distinct s.doc_id from ({rendered_sql("scan")}) s where (s.doc_id, s.page) not in (select (doc_id, page) from ({rendered_sql("ocr")}) o where length(regexp_replace(text, '\\s', '', 'g')) >= 20)
), grounded as (
    select j.doc_id, j.idx, j.cents, j.currency, case when verdict = 'ok' then true when verdict = 'notInText' and j.doc_id in (select doc_id from scans) then null else false end as found_in_text,
        case when verdict = 'ok' then case when (j.doc_id, j.idx) in (select (doc_id, idx) from mislabelled) then 'labelMismatch' end
             when verdict = 'notInText' and j.doc_id in (select doc_id from scans) then null else verdict end as issue
    from judged j
), claim_date as (select * from ({rendered_sql("claim_date")}) c
), judged_date as (
    select *, case when (doc_id, date) in (select (doc_id, d) from pg) then 'ok' else 'notInText' end as verdict from claim_date
), top as (
    select doc_id, max(cents) as cents, bool_or(comma) as comma from pg group by doc_id
)"""


def _with(sql: str) -> str:
    return f"with {TRUTH}\n{sql}"


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(spark, sf_dir, "page").drop("o_orderkey")


def evidence(spark: SparkSession, sf_dir: str) -> Evidence:
    """The corpus's evidence, of which a query makes the tables that it reads. Queries share none, so what
    one costs does not depend on those that ran before it."""
    return build_evidence(pages(spark, sf_dir), rendered(spark, sf_dir, "doc"))


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.split_injected_lines(M.spread(pages(spark, sf_dir))).drop("text")


def _read(spark: SparkSession, sf_dir: str, rejoin: bool = True) -> DataFrame:
    rests = kept(M.undated(_clean(spark, sf_dir), "clean", rejoin))
    return M.readable_of(rests, M.styles_of(rests, rendered(spark, sf_dir, "doc")))


@query("m1_date_mentions", _with("select doc_id, page, d as date from pg"))
def m1(spark, sf_dir):
    return M.date_mentions(M.spread(pages(spark, sf_dir)))


@query("m2_decimal_style", _with("select doc_id, case when bool_or(comma) then 'comma' else 'point' end as style from pg group by doc_id"))
def m2(spark, sf_dir):
    return M.decimal_styles(_clean(spark, sf_dir), rendered(spark, sf_dir, "doc"), "clean")


@query("m3_number_mentions", _with("""
    select doc_id, count(*) as n, sum(cents)::bigint as cents from (
        select doc_id, k * 100 as cents from pg union all select doc_id, cents from pg where not broken
        union all select doc_id, cents % 100000 from pg where broken union all select doc_id, cents // 100000 * 100 from pg where broken) t group by doc_id"""))  # fmt: skip
def m3(spark, sf_dir):
    return M.number_mentions(_read(spark, sf_dir, rejoin=False)).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("m4_number_evidence", _with("select doc_id, cents from numbers"))
def m4(spark, sf_dir):
    return M.number_evidence(_read(spark, sf_dir))


@query("m5_money_mentions", _with("select doc_id, cents, currency from money"))
def m5(spark, sf_dir):
    return M.money_mentions(_read(spark, sf_dir)).distinct()


@query("m6_label_mentions", _with("select doc_id, cents, 'tax' as kind, label from labelled"))
def m6(spark, sf_dir):
    return M.label_mentions(_read(spark, sf_dir))


@query("m7_date_evidence", _with("select distinct doc_id, d as date from pg"))
def m7(spark, sf_dir):
    return M.full_dates(M.date_evidence(M.spread(pages(spark, sf_dir))))


@query("m8_injection_findings", f"""
    select doc_id, page, trim(substr(t, greatest(1, strpos(t, 'Ignore all') - 20), strpos(t, 'Ignore all') + 32 + 40 - greatest(1, strpos(t, 'Ignore all') - 20))) as excerpt
    from (select doc_id, page, regexp_replace(text, '\\s+', ' ', 'g') as t from ({rendered_sql("page")}) p where o_orderkey % 97 = 0) q""")  # fmt: skip
def m8(spark, sf_dir):
    return M.injection_findings(pages(spark, sf_dir))


@query("m9_split_injected_lines", f"""
    select doc_id, page, md5(case when o_orderkey % 97 = 0 then left(text, strpos(text, 'Ignore all') - 2) else text end) as clean_md5,
        case when o_orderkey % 97 = 0 then substr(text, strpos(text, 'Ignore all')) else '' end as injected
    from ({rendered_sql("page")}) p""")  # fmt: skip
def m9(spark, sf_dir):
    return _clean(spark, sf_dir).select("doc_id", "page", F.md5(F.col("clean").cast("binary")).alias("clean_md5"), "injected")


@query("m10_clause_context", _with("""
    select doc_id, 0 as text_no, 'the highest total is ' || case when comma then translate(format('{:,.2f}', cents / 100.0), ',.', ' ,') || ' EUR gross' else 'EUR ' || format('{:,.2f}', cents / 100.0) || ' gross' end as context from top
    union all select doc_id, 1, 'a reserve of ' || case when comma then '777 777,77 EUR' else 'EUR 777,777.77' end || ' net is kept' from top where doc_id % 20 = 1"""))  # fmt: skip
def m10(spark, sf_dir):
    texts = rendered(spark, sf_dir, "summary")
    return texts.select("doc_id", "text_no", M.clause_with(F.col("text"), lambda c: c.contains("EUR")).alias("context"))


_ABBREVIATED = ", ".join(f"'{a}'" for a in ABBREVIATIONS)


@query("m11_sentence_counts", f"""
    with w as (select doc_id, lang, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as ws from documents),
    g as (select doc_id, lang, ws, list_filter(range(1, len(ws)), lambda i: regexp_matches(ws[i], '[.!?…]+["''”»)]*$') and regexp_matches(ws[i + 1], '^["''„«(]?\\p{{Lu}}')) as ends from w),
    k as (select doc_id, lang, ws, list_filter(ends, lambda i: not (ws[i][len(regexp_extract(ws[i], '^(.*?)[.!?…]+["''”»)]*$', 1)) + 1] = '.'
        and (regexp_full_match(regexp_replace(regexp_extract(ws[i], '^(.*?)[.!?…]+["''”»)]*$', 1), '^[("„«'']+', ''), '\\p{{Lu}}')
             or lower(regexp_replace(regexp_extract(ws[i], '^(.*?)[.!?…]+["''”»)]*$', 1), '^[("„«'']+', '')) in ({_ABBREVIATED})))) as held from g)
    select doc_id, lang, case when len(ws) = 0 then 0 else len(held) + 1 end::integer as sentences from k""")  # fmt: skip
def m11(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", M.sentence_count(F.col("text")).alias("sentences"))


@query("e1_build_evidence", _with("""
    select 'number' as kind, doc_id, cents, '' as detail from numbers union all select 'money', doc_id, cents, currency from money
    union all select 'injected number', doc_id, cents, '' from inj_numbers union all select 'injected money', doc_id, cents, currency from inj_money
    union all select 'label', doc_id, cents, label from labelled"""))  # fmt: skip
def e1(spark, sf_dir):
    ev = evidence(spark, sf_dir)
    part = lambda df, kind, detail: df.select(F.lit(kind).alias("kind"), "doc_id", "cents", detail.alias("detail"))
    out = part(ev.numbers, "number", F.lit("")).unionByName(part(ev.money, "money", F.col("currency")))
    out = out.unionByName(part(ev.injected_numbers, "injected number", F.lit(""))).unionByName(part(ev.injected_money, "injected money", F.col("currency")))
    return out.unionByName(part(ev.labels, "label", F.col("label")))


@query("e2_union_ocr_evidence", _with(f"""
    select doc_id, cents from numbers union select doc_id, cast(split_part(text, ' ', 4) as bigint) * 100 from ({rendered_sql("ocr")}) o where text <> 'short'"""))  # fmt: skip
def e2(spark, sf_dir):
    both = union_ocr(pages(spark, sf_dir), rendered(spark, sf_dir, "ocr"))
    return build_evidence(both, rendered(spark, sf_dir, "doc")).numbers


def _amounts(spark, sf_dir):
    return rendered(spark, sf_dir, "claim").withColumn("cents", cents(F.col("value")))


@query("j1_check_amounts", _with("select doc_id, idx, cents, currency, verdict from judged"))
def j1(spark, sf_dir):
    return C.check_amounts(_amounts(spark, sf_dir), evidence(spark, sf_dir)).select("doc_id", "idx", "cents", "currency", "verdict")


@query("j2_check_dates", _with("select doc_id, idx, date, verdict from judged_date"))
def j2(spark, sf_dir):
    return C.check_dates(rendered(spark, sf_dir, "claim_date"), evidence(spark, sf_dir)).select("doc_id", "idx", "date", "verdict")


@query("j3_check_labels", _with("select doc_id, idx, cents, 'tax' as kind, 'net' as said, 'gross' as in_document from mislabelled"))
def j3(spark, sf_dir):
    return C.check_labels(_amounts(spark, sf_dir), evidence(spark, sf_dir))


def unverified(spark, sf_dir):
    return ocr_uncovered(rendered(spark, sf_dir, "scan"), rendered(spark, sf_dir, "ocr"))


@query("j4_ground_lists", _with("select doc_id, idx, cents, currency, found_in_text, issue from grounded"))
def j4(spark, sf_dir):
    out = C.ground_amounts(rendered(spark, sf_dir, "claim"), evidence(spark, sf_dir), unverified(spark, sf_dir))
    return out.select("doc_id", "idx", "cents", "currency", "found_in_text", "issue")


@query("j5_ground_texts", _with("""
    select doc_id, 'notInText' as verdict, unnest(['777777.77 EUR', '2031-05-06']) as item from (select distinct doc_id from pg where doc_id % 20 = 1) t
    where doc_id not in (select doc_id from scans)"""))  # fmt: skip
def j5(spark, sf_dir):
    return C.ground_texts(rendered(spark, sf_dir, "summary"), evidence(spark, sf_dir), unverified(spark, sf_dir))


@query("j6_ground_text_labels", _with("""
    select doc_id, cents, 'tax' as kind, 'net' as said, 'gross' as in_document from labelled
    where doc_id % 20 = 3 and cents in (select max(cents) from pg p where p.doc_id = labelled.doc_id)"""))  # fmt: skip
def j6(spark, sf_dir):
    texts = rendered(spark, sf_dir, "summary").withColumn("text", F.when(F.col("doc_id") % 20 == 3, F.replace("text", F.lit("gross"), F.lit("net"))).otherwise(F.col("text")))
    return C.ground_text_labels(texts, evidence(spark, sf_dir))


@query("j7_check_names", f"""
    select doc_id, idx, name, name like 'Invoice Total Issue%' as supported from ({rendered_sql("claim_name")}) c where doc_id in (select o_custkey from orders)""")  # fmt: skip
def j7(spark, sf_dir):
    names = rendered(spark, sf_dir, "claim_name").join(rendered(spark, sf_dir, "doc").select("doc_id"), "doc_id", "left_semi")
    return C.check_names(names, _clean(spark, sf_dir)).select("doc_id", "idx", "name", "supported")


@query("j9_reconcile_lists", _with("""
    select doc_id, cents, currency, null::date as date from (
        select doc_id, cents, 'EUR' as currency from top union select doc_id, 77777777, 'EUR' from top where doc_id % 20 = 1) t
    where (doc_id, cents, currency) not in (select (doc_id, cents, currency) from claim)
    union all select doc_id, null, null, date '2031-05-06' from top where doc_id % 20 = 1"""))  # fmt: skip
def j9(spark, sf_dir):
    ev_styles = M.decimal_styles(_clean(spark, sf_dir), rendered(spark, sf_dir, "doc"), "clean")
    money, days = C.reconcile(rendered(spark, sf_dir, "summary"), ev_styles, rendered(spark, sf_dir, "claim"), rendered(spark, sf_dir, "claim_date"))
    none = lambda kind: F.lit(None).cast(kind)
    return money.select("doc_id", "cents", "currency", none("date").alias("date")).unionByName(days.select("doc_id", none("long").alias("cents"), none("string").alias("currency"), "date"))
