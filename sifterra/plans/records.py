"""Record repair, filters and combining flows over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sifterra.functions import text as tx
from sifterra.operators import records as rc
from sifterra.operators.agreement import merge_edits
from sifterra.plans.curation import _PAIRS
from sifterra.plans.registry import Tables, query
from sifterra.plans.texts import fingerprint_sql, words_sql

MARKED = "‏⁧"


@query("select p_name as title, p_partkey as id, 'en' as language from part")
def prj_arranged(t: Tables):
    """PRJ1 and PRJ14: renamed, reordered and constant columns."""
    return rc.arranged(t.part, {"p_name": "title", "p_partkey": "id"}).withColumn("language", F.lit("en"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, coalesce(json_extract_string(props, '$.name'), 'none') as name from events")
def prj_normalized(t: Tables):
    """PRJ4: JSON objects in a fixed schema with defaults."""
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("name", T.StringType())])
    return t.events.select("event_id", rc.normalized(F.col("props"), schema, {"name": "none"}).alias("x")).where("x is not null").select("event_id", "x.*")


@query("select doc_id, translate(text, '‎‏‪‫‬‭‮⁦⁧⁨⁩', '') as in_list, translate(source, '‎‏‪‫‬‭‮⁦⁧⁨⁩', '') as in_map from documents")
def prj_without_bidi(t: Tables):
    """PRJ11: bidi marks go from every string of a nested value."""
    nested = F.struct(F.array(F.concat("text", F.lit(MARKED))).alias("a"), F.create_map(F.lit("k"), F.concat(F.lit(MARKED), "source")).alias("m"))
    rows = t.documents.select("doc_id", nested.alias("x"))
    rows = rows.select("doc_id", rc.without_bidi(F.col("x"), rows.schema["x"].dataType).alias("x"))
    return rows.select("doc_id", F.col("x.a")[0].alias("in_list"), F.col("x.m")["k"].alias("in_map"))


@query("select event_id, '{\"v\":{\"pick\":\"' || event_type || '\"}}' as m from events")
def prj_without_field(t: Tables):
    """PRJ13: a field goes from each value of a map."""
    m = F.create_map(F.lit("v"), F.struct(F.col("event_type").alias("pick"), F.lit(True).alias("is_iaa")))
    return t.events.select("event_id", F.to_json(rc.without_field(m, "is_iaa")).alias("m"))


@query("select p_partkey, case p_size % 4 when 0 then p_brand when 1 then p_type else 'old' end as correct_option from part")
def prj_rederived(t: Tables):
    """PRJ17: the answer's text follows its key."""
    options = F.create_map(F.lit("A"), F.col("p_brand"), F.lit("B"), F.col("p_type"))
    key = F.array(F.lit("A"), F.lit("B"), F.lit("C"), F.lit(None).cast("string"))[(F.col("p_size") % 4).cast("int")]
    return t.part.select("p_partkey", rc.rederived_option(options, key, F.lit("old")).alias("correct_option"))


@query("select p_partkey, case when p_size % 3 = 0 then p_type when p_size % 3 = 1 then '' else p_name end as shown from part")
def prj_overlaid(t: Tables):
    """PRJ19: edits over the base record."""
    s = F.col("p_size") % 3
    return t.part.select("p_partkey", rc.overlaid(F.when(s == 0, F.col("p_type")).when(s == 1, F.lit("")), F.col("p_name")).alias("shown"))


@query("select page_id, case when page_id % 3 = 0 then 'p/' || page_id when page_id % 3 = 1 then 'data/p.v1/' || page_id else page_id::varchar end as key from pages")
def prj_mirrored(t: Tables):
    """PRJ20: output keys from input paths."""
    i = F.col("page_id").cast("string")
    path = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/w/raw_data/p/"), i, F.lit(".pdf"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/w/data/p.v1/"), i)).otherwise(F.concat(F.lit("/other/p/"), i, F.lit(".png")))
    return t.pages.select("page_id", rc.mirrored_path(path, "/w").alias("key"))


@query("select doc_id, source from documents left join labels using (doc_id) where coalesce(toxic, 0) <> 1 and lang not in ('fr', 'es') and (source is null or source <> 'src1')")
def flt_records(t: Tables):
    """FLT1, FLT2 and FLT3: flags (missing is false), excluded subdomains, an excluded domain."""
    d = t.documents.join(t.labels.select("doc_id", (F.col("toxic") == 1).alias("flag")), "doc_id", "left")
    d = rc.without_values(rc.without_flag(d, "flag"), "lang", ["fr", "es"], or_null=False)
    return rc.without_values(d, "source", ["src1"]).select("doc_id", "source")


@query("select conv_id, turn from conversations where text is not null and trim(text) <> '' and not starts_with(text, 'ERROR') and not starts_with(text, 'CONNECTION_FAILED') and not starts_with(text, 'EMPTY_OUTPUT')")
def flt_errors(t: Tables):
    """FLT9 and FLT12: error rows and incomplete rows go, so that they are asked again."""
    rows = t.conversations.withColumn("error", tx.is_error(F.col("text")))
    return rc.without_flag(rc.complete(rows, ["text"]), "error").select("conv_id", "turn")


@query("select count(*) as total, count(*) filter (where lang = 'fr' or source = 'src2')::bigint as excluded, count(*) filter (where not (lang = 'fr' or coalesce(source, '') = 'src2') and quality = 1)::bigint as good from documents left join labels using (doc_id)")
def flt_excluded(t: Tables):
    """FLT11: rows excluded by domain or subdomain, counted apart."""
    d = t.documents.join(t.labels, "doc_id", "left").withColumns({"domain": F.col("lang"), "subdomain": F.col("source")})
    gone = rc.excluded(["fr"], ["src2"])
    return d.agg(F.count(F.lit(1)).alias("total"), F.count_if(gone).alias("excluded"), F.count_if(~gone & (F.col("quality") == 1)).alias("good"))


@query("select p_partkey, p_name from part where contains(p_name, 'widget') and p_type in ('ECONOMY', 'STANDARD')")
def flt_names(t: Tables):
    """FLT14: name substring and listed kinds."""
    return t.part.where(F.col("p_name").contains("widget") & F.col("p_type").isin("ECONOMY", "STANDARD")).select("p_partkey", "p_name")


@query("with f as (select p_name, arg_min(p_brand, p_partkey) as b from part where p_size <= 10 group by 1) select p_partkey, case when p_size > 25 then p_brand else coalesce(f.b, null) end as brand from part left join f using (p_name)")
def join_backfilled(t: Tables):
    """JN6: a missing attribute from the first row of the same text."""
    rows = t.part.select("p_partkey", "p_name", F.when(F.col("p_size") > 25, F.col("p_brand")).alias("p_brand"))
    out = rc.backfilled(rows, "p_name", "p_brand", t.part.where("p_size <= 10").select("p_name", "p_brand", "p_partkey"), "p_partkey")
    return out.select("p_partkey", F.col("p_brand").alias("brand"))


@query("select l_orderkey, l_partkey, l_quantity from lineitem where exists (select 1 from (select distinct l_orderkey as a, l_partkey as b from lineitem where l_quantity > 49) x where a = l_orderkey and b = l_partkey)")
def join_two_keys(t: Tables):
    """JN2: semi join on a key of two columns."""
    wanted = t.lineitem.where("l_quantity > 49").select("l_orderkey", "l_partkey")
    return t.lineitem.join(wanted, ["l_orderkey", "l_partkey"], "left_semi").select("l_orderkey", "l_partkey", "l_quantity")


_NAMES = "select unnest([lang, source, coalesce(source, '') || '-' || lang]) as name from documents"


@query(f"select name, count(*) as n from ({_NAMES}) where name is not null group by 1")
def agg_unnested(t: Tables):
    """AGG3: counts after unnesting the names of each row."""
    names = F.array("lang", "source", F.concat(F.coalesce("source", F.lit("")), F.lit("-"), "lang"))
    return t.documents.select(F.explode(names).alias("name")).where("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("select event_type as model, user_id % 6 as shots, count(*) as n, round_even(avg((value > 20)::int) * count(*), 0)::bigint as correct from events group by 1, 2")
def agg_harness_rows(t: Tables):
    """AGG21: rows of a harness's result map; the number of shots is in the task's name."""
    by = t.events.groupBy("event_type", F.concat(F.lit("task_"), (F.col("user_id") % 6).cast("string"), F.lit("shot")).alias("task")).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("value") > 20).cast("int")).alias("acc"))
    maps = by.groupBy("event_type").agg(F.map_from_entries(F.collect_list(F.struct("task", F.struct("n", "acc")))).alias("m"))  # six tasks each
    rows = maps.select(F.col("event_type").alias("model"), F.explode("m").alias("task", "r"))
    return rows.select("model", F.regexp_extract("task", r"task_(\d+)shot", 1).cast("long").alias("shots"), "r.n", F.bround(F.col("r.acc") * F.col("r.n"), 0).cast("long").alias("correct"))


@query("select o_orderpriority as batch, count(*) filter (where l.k is not null)::bigint as done, count(*) filter (where l.flagged)::bigint as flagged, count(*) as total, min(o_orderkey) filter (where l.k is null) as next from orders left join (select l_orderkey as k, bool_or(l_quantity > 48) as flagged from lineitem where l_quantity > 30 group by 1) l on l.k = o_orderkey group by 1")
def agg_progress(t: Tables):
    """AGG24: done, flagged and open items of each batch, and the next open one."""
    done = t.lineitem.where("l_quantity > 30").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or(F.col("l_quantity") > 48).alias("f"), F.lit(True).alias("d"))
    items = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("batch")).join(done, "o_orderkey", "left")
    return items.groupBy("batch").agg(F.count_if("d").alias("done"), F.count_if("f").alias("flagged"), F.count(F.lit(1)).alias("total"), F.min(F.when(F.col("d").isNull(), F.col("o_orderkey"))).alias("next"))


@query("select lang, round(avg((quality = toxic)::int), 12) as acc, round(avg((quality = 1)::int), 12) as acc_norm from documents join labels using (doc_id) group by 1")
def agg_choice_accuracy(t: Tables):
    """AGG25: mean accuracy of two ways to choose."""
    x = t.documents.join(t.labels, "doc_id")
    return x.groupBy("lang").agg(F.round(F.avg((F.col("quality") == F.col("toxic")).cast("int")), 12).alias("acc"), F.round(F.avg((F.col("quality") == 1).cast("int")), 12).alias("acc_norm"))


@query("select user_id, event_type, n, rank from (select user_id, event_type, count(*) as n, row_number() over (partition by user_id order by count(*) desc, event_type) as rank from events group by 1, 2) where rank <= 2")
def win_top_types(t: Tables):
    """WIN7: the two most common types of each user (the limit is the feature)."""
    n = t.events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return rc.top_per_group(n, ["user_id"], [F.desc("n"), F.col("event_type")], 2)


@query("select source, n from (select source, count(*) as n from documents group by 1 order by n desc, source limit 3)")
def srt_most_common(t: Tables):
    """SRT2, SRT4 and SRT5: the three most common sources (the limit is the feature)."""
    return t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(3)


@query("select lang, source from documents where doc_id % 3 = 0 union all select lang, source from documents d where doc_id % 3 <> 0 and not exists (select 1 from documents e where e.doc_id % 3 = 0 and e.lang is not distinct from d.lang and e.source is not distinct from d.source)")
def set_union_of_new(t: Tables):
    """SET2: union without rows that the first part holds."""
    d = t.documents
    return rc.union_of_new(d.where("doc_id % 3 = 0").select("lang", "source"), d.where("doc_id % 3 <> 0").select("lang", "source"))


@query("select p_partkey, case when p_type = 'ECONOMY' then 'Economy Class' else upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) end as label, array_to_string(regexp_split_to_array(trim(p_name), '\\s+')[1:2], ' ') as general from part")
def txt_subdomain_labels(t: Tables):
    """TXT23 and TXT29: general subdomains and labels."""
    name = F.concat(F.col("p_brand"), F.lit(" / "), "p_type")
    return t.part.select("p_partkey", rc.pretty_subdomain(name, {"economy": "Economy Class"}).alias("label"), rc.general_subdomain(F.col("p_name")).alias("general"))


def _options(x):
    w = tx.words(x)
    return F.create_map(*[v for i, k in enumerate("ABCD") for v in (F.lit(k), F.coalesce(F.get(w, F.lit(i)), F.lit("")))])


_SIGNED = f"sig as (select doc_id, list_distinct(list_filter(list_transform([1, 2, 3, 4], lambda i: replace({fingerprint_sql('w[i]')}, ' ', '')), lambda v: v <> '')) as s from (select doc_id, {words_sql('text')} as w from documents))"


_ALL_PAIRS = _PAIRS.replace("df as (select t, count(*) as df from lt group by 1)", "df as (select t, count(*) as df from tok group by 1)")


@query(_ALL_PAIRS + f", {_SIGNED}, linked as (select i, j from pairs join sig a on a.doc_id = i join sig b on b.doc_id = j where pairs.inter >= 0.9 * (n_i + n_j - pairs.inter) - 1e-9 and len(list_intersect(a.s, b.s)) >= 0.5 * len(list_distinct(a.s || b.s)) - 1e-9 and len(a.s || b.s) > 0), "
       "both_ as (select i as u, j as v from linked union select j, i from linked), reach as (select u as node, u as r from both_ union select node, v from reach join both_ on both_.u = reach.r), comp as (select node, min(r) as c from reach group by 1), "
       "g as (select coalesce(c, d.doc_id) as c, d.doc_id, coalesce(source, '') as source, lang, quality::varchar as a from documents d left join labels using (doc_id) left join comp on node = d.doc_id), k as (select c, count(*) as n from g group by 1 having count(distinct a) < 2), "
       "f as (select c, source, min(doc_id) as p, arg_min(lang, doc_id) as l from g where source <> '' group by 1, 2), s as (select c, string_agg(source, ',' order by p) as sources, string_agg(coalesce('u/' || l, ''), ',' order by p) as urls from f group by 1) "
       "select d.doc_id, k.n as group_size, quality, coalesce(s.sources, '') as sources, coalesce(s.urls, '') as urls from k join documents d on d.doc_id = k.c left join labels using (doc_id) left join s on s.c = k.c where k.n > 1 "
       "union all select d.doc_id, 1, quality, coalesce(source, ''), coalesce('u/' || lang, '') from k join documents d on d.doc_id = k.c left join labels using (doc_id) where k.n = 1")
def correlated_dedup(t: Tables):
    """CMP3, AGG14 and TXT10: question Jaccard 0.9 with option-signature Jaccard 0.5 (a text's
    first four words as its options), the first row with the sources of its group."""
    rows = t.documents.select("doc_id", "text", F.array("source").alias("source"), F.array(F.concat(F.lit("u/"), "lang")).alias("source_url")).join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    out = rc.correlated_dedup(rows, "doc_id", tx.tokens(F.col("text")), _options(F.col("text")), "quality", names="source", urls="source_url")
    return out.select("doc_id", "group_size", "quality", F.array_join("source", ",").alias("sources"), F.array_join("source_url", ",").alias("urls"))


_CANON = f"{fingerprint_sql('text')} || '‖' || list_aggregate(list_sort([{fingerprint_sql('source')}, {fingerprint_sql('lang')}]), 'string_agg', '|')"


@query(f"select k, min(doc_id) as doc_id, count(*) as n from (select doc_id, md5({_CANON}) as k from documents) group by 1")
def canonical_groups(t: Tables):
    """CMP2 and TXT9: groups of one canonical key (question and sorted options)."""
    options = F.create_map(F.lit("A"), F.coalesce("source", F.lit("")), F.lit("B"), F.coalesce("lang", F.lit("")))
    key = F.md5(tx.canonical_key(F.col("text"), options))
    return t.documents.groupBy(key.alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


@query(f"with d as (select doc_id, coalesce(source, '') as source, lang, quality, md5({_CANON}) as k from documents left join labels using (doc_id)), g as (select k, min(doc_id) as doc_id, count(*) as n from d group by 1 having count(distinct quality) < 2), "
       "f as (select k, source, min(doc_id) as p, arg_min(lang, doc_id) as l from d where source <> '' group by 1, 2), s as (select k, string_agg(source, ',' order by p) as sources, string_agg(coalesce('u/' || l, ''), ',' order by p) as urls from f group by 1) "
       "select g.doc_id, n as group_size, quality, case when n > 1 then coalesce(s.sources, '') else d.source end as sources, case when n > 1 then coalesce(s.urls, '') else coalesce('u/' || lang, '') end as urls from g join d using (doc_id) left join s on s.k = g.k")
def canonical_merged(t: Tables):
    """CMP2 and AGG14: groups of one canonical key with the policy on answers, merged sources and URLs."""
    rows = t.documents.select("doc_id", "text", "lang", F.array("source").alias("source"), F.col("source").alias("s"), F.array(F.concat(F.lit("u/"), "lang")).alias("source_url")).join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    options = F.create_map(F.lit("A"), F.coalesce("s", F.lit("")), F.lit("B"), F.coalesce("lang", F.lit("")))
    out = rc.merged_groups(rows, F.md5(tx.canonical_key(F.col("text"), options)), "doc_id", "quality", names="source", urls="source_url")
    return out.select("doc_id", "group_size", "quality", F.array_join("source", ",").alias("sources"), F.array_join("source_url", ",").alias("urls"))


#: Domains by subdomain and new names of subdomains, for the kinds of parts.
_DOMAINS, _RENAMES = {"STANDARD": "Profession", "ECONOMY": "Humanities"}, {"STANDARD": "professional studies", "PROMO": "fine arts"}
_PARTS = (
    "x as (select p_partkey as pos, p_name as q, p_brand as dom, p_type as sub, (p_partkey % 3)::int as part, case when p_size % 6 < 4 then chr(65 + (p_size % 6)::int) when p_size % 6 = 4 then 'E' end as key from part), "
    "v as (select *, part = 0 or coalesce(key, 'E') <> 'E' as valid from x), b as (select trim(q) as q, arg_min(pos, (part, pos)) as pos, min(part) as part from v where valid group by 1)"
)


def _parts(t: Tables):
    key = F.get(F.array(*map(F.lit, "ABCDE")), (F.col("p_size") % 6).cast("int"))
    x = t.part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("pos"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(F.concat(F.lit(MARKED), "p_name")).alias("question"), F.col("p_brand").alias("domain"), F.col("p_type").alias("subdomain"), key.alias("correct_key"))
    return {tag: x.where(F.col("pos") % 3 == k) for k, tag in enumerate(("annotated", "scraped", "upsampled"))}


@query(f"with {_PARTS} select row_number() over (order by b.part, b.pos) - 1 as id, b.pos as legacy_id, b.q as question, ['annotated', 'scraped', 'upsampled'][b.part + 1] as provenance, key as correct_key, case sub when 'STANDARD' then 'Profession' when 'ECONOMY' then 'Humanities' else dom end as domain, case sub when 'STANDARD' then 'professional studies' when 'PROMO' then 'fine arts' else sub end as subdomain from b join x using (pos)")
def priority_combine(t: Tables):
    """CMP14 and FLT7: three inputs by priority, valid keys, domains by subdomain before renames, new ids."""
    out = rc.combined(_parts(t), "question", "pos", _DOMAINS, _RENAMES, trusted=["annotated"])
    return out.select("id", "legacy_id", "question", "provenance", "correct_key", "domain", "subdomain")


@query(f"with {_PARTS} select ['annotated', 'scraped', 'upsampled'][part + 1] as provenance, count(*) as n_input, count(*) filter (where not valid)::bigint as n_no_key, (count(*) filter (where valid) - coalesce(any_value(k), 0))::bigint as n_duplicate, coalesce(any_value(k), 0)::bigint as n_kept from v left join (select part, count(*) as k from b group by 1) using (part) group by part")
def combine_counts(t: Tables):
    """CMP14: what each input gives and loses."""
    return rc.combine_counts(_parts(t), "question", "pos", trusted=["annotated"])


_NOTED = (
    "n as (select event_id % 1999 as id, user_id % 3 as who, event_type as pick, value > 60 as flagged, case when user_id % 2 = 0 then 'q' || repeat('x', (user_id % 5)::int) || user_id else '' end as qe, case when user_id % 3 = 0 then 'o' || user_id end as oe, case when user_id % 4 = 0 then ['ECONOMY', 'STANDARD', 'new'][user_id % 3 + 1] end as se "
    "from events qualify row_number() over (partition by event_id % 1999, user_id % 3 order by event_id desc) = 1), "
    "v as (select id, case when count(*) < 2 then 'single_annotated' when bool_or(flagged) then 'flagged' when bool_or(pick = 'error') then 'unsure' when bool_or(pick not in ('click', 'view', 'error')) then 'invalid' when count(distinct pick) > 1 then 'disagree' else 'include' end as verdict from n join part on p_partkey = id group by 1)"
)


def _noted(t: Tables):
    u = F.col("user_id")
    notes = t.events.select(
        (F.col("event_id") % 1999).alias("id"), "event_id", (u % 3).cast("string").alias("annotator"), F.col("event_type").alias("pick"), (F.col("value") > 60).alias("flagged"),
        F.when(u % 2 == 0, F.concat(F.lit("q"), F.repeat(F.lit("x"), (u % 5).cast("int")), u.cast("string"))).otherwise("").alias("question_edit"),
        F.create_map(F.lit("A"), F.when(u % 3 == 0, F.concat(F.lit("o"), u.cast("string")))).alias("option_edits"),
        F.when(u % 4 == 0, F.get(F.array(F.lit("ECONOMY"), F.lit("STANDARD"), F.lit("new")), (u % 3).cast("int"))).alias("subdomain_edit"),
    )
    items = t.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit(MARKED), "p_name").alias("question"), F.create_map(F.lit("A"), F.col("p_brand"), F.lit("B"), F.col("p_type")).alias("options"), F.col("p_brand").alias("domain"), F.col("p_type").alias("subdomain"))
    return rc.noted(items, notes, ["event_id"], ["click", "view"], "error")


@query(f"with {_NOTED}, e as (select id, min(pick) as pick, max_by(qe, (length(qe), -who)) filter (where qe <> '') as qe, max_by(oe, (length(oe), -who)) filter (where oe is not null) as oe, max_by(se, (length(se), -who)) filter (where se is not null) as se from n group by 1), "
       "c as (select p_type as s, p_brand as d, count(*) as k, min(p_partkey) as f from part join v on v.id = p_partkey group by 1, 2), usual as (select s, max_by(d, (k, -f)) as d from c group by 1), "
       "x as (select p_partkey as id, coalesce(qe, p_name) as question, coalesce(oe, p_brand) as a, p_type as b, pick as correct_key, p_brand as own, coalesce(se, p_type) as subdomain from part join v on v.id = p_partkey join e on e.id = p_partkey where verdict = 'include') "
       "select id, question, a, b, correct_key, coalesce(d, own) as domain, subdomain, coalesce(d, own) <> own as domain_corrected from x left join usual on s = subdomain")
def final_records(t: Tables):
    """CMP15, JN3 and TXT31: last notes, verdicts, edits of question, options and subdomain, the usual domain."""
    out = rc.annotated(_noted(t))
    return out.select("id", "question", F.col("options")["A"].alias("a"), F.col("options")["B"].alias("b"), "correct_key", "domain", "subdomain", "domain_corrected")


@query(f"with {_NOTED} select verdict, count(*) as n from v group by 1")
def final_drops(t: Tables):
    """CMP15: how many rows go for each reason."""
    return rc.drop_counts(_noted(t))


@query("select doc_id, case when length(trim(text)) >= length(text) then trim(text) else text end as result from documents where false union all select doc_id, coalesce(nullif(case when length(source) >= length(lang) then source else lang end, ''), text) as result from documents")
def edits_of_documents(t: Tables):
    """TXT31 and SRT6 over whole rows: source and language as the edits of each text."""
    return t.documents.select("doc_id", merge_edits(F.array("source", "lang"), F.col("text")).alias("result"))
