"""Curation: dedup, sampling, batching, restructuring, lookups, sources and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sifterra.functions import text as tx
from sifterra.operators import dedup as dd
from sifterra.operators import restructure as rs
from sifterra.operators import sampling as sm
from sifterra.plans.registry import Tables, query
from sifterra.plans.texts import fingerprint_sql
from sifterra.sources import readers as rd
from sifterra.sources import sinks


def _labelled(t: Tables):
    return t.documents.select("doc_id", "text", "source", "lang").join(t.labels.select("doc_id", "quality"), "doc_id", "left")


def _dedup_sql(key: str) -> str:
    return (
        f"with d as (select doc_id, source, quality, {key} as k from documents left join labels using (doc_id)), "
        "f as (select k, source, min(doc_id) as p from d group by 1, 2), s as (select k, string_agg(source, ',' order by p, source) as sources from f group by 1) "
        "select min(doc_id) as doc_id, count(*) as n_rows, max(quality) as quality, any_value(s.sources) as sources from d join s using (k) where k <> '' group by k having count(distinct quality) < 2"
    )


@query(_dedup_sql("trim(text)"))
def exact_dedup(t: Tables):
    """CMP1: key is the trimmed text; groups whose labels differ go."""
    out = dd.exact_dedup(_labelled(t), F.trim("text"), "quality", "doc_id", "source")
    return out.select("doc_id", "n_rows", "quality", F.array_join("sources", ",").alias("sources"))


@query(_dedup_sql(fingerprint_sql("text")))
def canonical_dedup(t: Tables):
    """CMP2: key is the fingerprint."""
    out = dd.exact_dedup(_labelled(t), tx.fingerprint(F.col("text")), "quality", "doc_id", "source")
    return out.select("doc_id", "n_rows", "quality", F.array_join("sources", ",").alias("sources"))


SWEEP = [0.85, 0.9, 0.95, 1.0]
#: All thresholds that are reported.
FULL_SWEEP = [0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0]
_PAIRS = (
    f"with recursive tok as (select doc_id, unnest(list_distinct(list_filter(string_split({fingerprint_sql('text')}, ' '), lambda w: w <> ''))) as t from documents), "
    "m as (select doc_id, count(*) as m from tok group by 1 having count(*) >= 4), lt as (select tok.* from tok join m using (doc_id)), df as (select t, count(*) as df from lt group by 1), "
    "rare as (select lt.* from lt join df using (t) where df <= 200), "
    "cand as (select distinct a.doc_id as i, b.doc_id as j from rare a join rare b on a.t = b.t and a.doc_id < b.doc_id join m x on x.doc_id = a.doc_id join m y on y.doc_id = b.doc_id where least(x.m, y.m) >= greatest(x.m, y.m) * 0.85 - 1e-9), "
    "inter as (select i, j, count(*) as n from cand join lt a on a.doc_id = i join lt b on b.doc_id = j and a.t = b.t group by 1, 2), "
    "pairs as (select i, j, n as inter, x.m as n_i, y.m as n_j, n::double / (x.m + y.m - n) as s from inter join m x on x.doc_id = i join m y on y.doc_id = j where n >= 0.85 * (x.m + y.m - n) - 1e-9) "
)


def _pairs(t: Tables, threshold: float = 0.85, stop_df: int | None = None, links: bool = False):
    return dd.jaccard_pairs(t.documents, "doc_id", tx.tokens(F.col("text")), threshold, stop_df, links=links)


@query(_PAIRS + "select i, j, inter::int as inter, n_i::int as n_i, n_j::int as n_j from pairs")
def fuzzy_pairs(t: Tables):
    """JN7, AGG18 and TXT12: pairs of token Jaccard 0.85 and more."""
    return _pairs(t)


def _sweep_sql(thresholds: list[float]) -> str:
    table = "(values " + ", ".join(f"({i}, {x}::double)" for i, x in enumerate(thresholds)) + ") th(k, t)"
    return (
        _PAIRS.replace("0.85", str(min(thresholds)))
        + f", e as (select k, t, i as u, j as v from pairs, {table} where s >= t - 1e-12), both_ as (select k, u, v from e union select k, v, u from e), reach as (select k, u as node, u as r from both_ union select reach.k, node, v from reach join both_ on both_.k = reach.k and both_.u = reach.r), comp as (select k, node, min(r) as c from reach group by 1, 2) "
        + f"select t as threshold, (select count(*) from documents) - coalesce(g.n, 0) as kept, coalesce(g.n, 0) as removed from {table} left join (select k, count(*) filter (where node <> c)::bigint as n from comp group by 1) g using (k)"
    )


@query(_sweep_sql(SWEEP))
def threshold_sweep(t: Tables):
    """CMP4: rows kept at each threshold, all in one component search."""
    return dd.threshold_sweep(_pairs(t, links=True), t.documents.count(), SWEEP)


@query(_sweep_sql(FULL_SWEEP))
def threshold_sweep_full(t: Tables):
    """CMP4 at all nine thresholds, over pairs from the lowest of them up."""
    return dd.threshold_sweep(_pairs(t, min(FULL_SWEEP), links=True), t.documents.count(), FULL_SWEEP)


@query(_PAIRS + ", both_ as (select i as u, j as v from pairs union select j, i from pairs), reach as (select u as node, u as r from both_ union select node, v from reach join both_ on both_.u = reach.r), comp as (select node, min(r) as c from reach group by 1), g as (select coalesce(c, d.doc_id) as c, coalesce(quality::varchar, '∅') as a from documents d left join labels using (doc_id) left join comp on node = d.doc_id) select c as doc_id, count(*) as group_size from g group by c having count(distinct a) = 1")
def fuzzy_dedup(t: Tables):
    """CMP5 and CMP6: components at 0.85; those whose labels differ go."""
    return dd.fuzzy_dedup(_labelled(t), "doc_id", "quality", _pairs(t, links=True).select("i", "j"))


@query("select doc_id, lang, source from documents d where doc_id = (select min(doc_id) from documents e where trim(e.text) = trim(d.text))")
def keep_first(t: Tables):
    """WIN1."""
    d = t.documents.select("doc_id", "lang", "source", F.trim("text").alias("k"))
    return dd.keep_first(d, [F.col("k")], [F.col("doc_id")]).select("doc_id", "lang", "source")


@query("with a as (select * from documents where doc_id % 2 = 0), b as (select * from documents where doc_id % 2 = 1) select doc_id, source from a union all select doc_id, source from b where trim(text) not in (select trim(text) from a)")
def priority_merge(t: Tables):
    """JN5 and CMP14: the second half gives only texts that the first half lacks."""
    d = t.documents.withColumn("text", F.trim("text"))
    return dd.priority_merge(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "text").select("doc_id", "source")


_TIER = "case when len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) <= 9 then 'short' else 'long' end"
_ORDER = "md5('42:' || doc_id), doc_id"


_QUOTAS = (
    f"c as (select lang, source, tier, count(*) as n, min(doc_id) as f from (select doc_id, lang, source, {_TIER} as tier from documents) group by 1, 2, 3), c2 as (select *, sum(n) over (partition by lang)::bigint as total, row_number() over (partition by lang order by f) as pos from c), "
    "r as (select *, case when total <= 100 then n else least(n, (n * 100) // total + case when 2 * ((n * 100) % total) > total or (2 * ((n * 100) % total) = total and ((n * 100) // total) % 2 = 1) then 1 else 0 end) end as got from c2), "
    "o as (select *, least(100, total) - sum(got) over (partition by lang) as short, coalesce(sum(n - got) over (partition by lang order by n desc, pos rows between unbounded preceding and 1 preceding), 0) as room, row_number() over (partition by lang order by got = 0, got * total - n * 100 desc, pos desc) as rk from r), "
    "q as (select lang, source, tier, n, (got + greatest(0, least(n - got, short - room)) - case when rk <= -short and got > 0 then 1 else 0 end)::bigint as quota from o)"
)


@query(f"with {_QUOTAS}, x as (select doc_id, lang, source, {_TIER} as tier from documents), y as (select *, row_number() over (partition by lang, source, tier order by {_ORDER}) as rn from x) select y.doc_id, y.lang, y.source, y.tier, rn <= quota as sampled from y join q on q.lang is not distinct from y.lang and q.source is not distinct from y.source and q.tier = y.tier")
def stratified_sample(t: Tables):
    """CMP7, CMP8, WIN6 and SET5: a sample of 100 in each language by source and length."""
    d = t.documents.select("doc_id", "lang", "source", tx.length_tier(F.col("text")).alias("tier"))
    return sm.stratified_sample(d, "lang", ["source", "tier"], 100, "doc_id")


@query(f"with {_QUOTAS} select * from q")
def quotas(t: Tables):
    """CMP7 alone: places of each cell."""
    d = t.documents.select("doc_id", "lang", "source", tx.length_tier(F.col("text")).alias("tier"))
    return sm.quotas(d, "lang", ["source", "tier"], 100, "doc_id")


_BATCH = f"with x as (select doc_id, lang, (row_number() over (partition by lang order by {_ORDER}) - 1) // 50 as c from documents), k as (select lang, ceil(count(*) / 50)::bigint as k from documents group by 1), b as (select lang, coalesce(sum(k) over (order by lang rows between unbounded preceding and 1 preceding), 0)::bigint as b from k), y as (select doc_id, lang, b + c + 1 as n from x join b using (lang)), z as (select doc_id, lang, 'batch_' || case when n < 1000 then lpad(n::varchar, 3, '0') else n::varchar end as batch_id from y)"


def _batched(t: Tables):
    return sm.pure_batches(t.documents.select("doc_id", "lang"), "lang", "doc_id")


@query(_BATCH + " select doc_id, lang, batch_id from z")
def pure_batches(t: Tables):
    """CMP9 and WIN3."""
    return _batched(t).select("doc_id", "lang", "batch_id")


@query(_BATCH + " select batch_id, count(*) as size, max(lang) as \"primary\", max(lang) || ':' || count(*) as groups from z group by 1")
def batch_manifest(t: Tables):
    """SNK5 and AGG20: the manifest."""
    m = sinks.manifest(_batched(t), "lang")
    entries = F.transform(F.map_entries("groups"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return m.select("batch_id", "size", "primary", F.array_join(entries, ",").alias("groups"))


_U = "(('0x' || substr(md5('42:' || o_orderkey), 1, 13))::bigint)::double / 4503599627370496"


@query(f"with n as (select o_orderstatus as g, o_orderpriority as l, count(*) as n from orders where o_orderkey % 3 <> 0 group by 1, 2), c as (select g, l, sum(n) over (partition by g order by l)::double / sum(n) over (partition by g) as hi from n) select o_orderkey, coalesce(case when o_orderkey % 3 <> 0 then o_orderpriority end, (select min(l) from c where g = o_orderstatus and hi > {_U})) as level from orders")
def impute_level(t: Tables):
    """CMP11, AGG17, JN11 and WIN5: missing priorities drawn from those of the same status."""
    o = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("g"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("level"))
    return sm.impute_level(o, o, "g", "level", "o_orderkey").select("o_orderkey", "level")


@query("with h as (select p_partkey, unnest([{'k': 'A', 'v': p_brand}, {'k': 'B', 'v': p_type}, {'k': 'C', 'v': p_name}, {'k': 'D', 'v': p_size::varchar}]) as x from part), r as (select p_partkey, x.k as k, x.v as v, row_number() over (partition by p_partkey order by md5('42:' || p_partkey || ':' || x.k)) as n from h) select p_partkey, max(v) filter (where n = 1) as a, max(v) filter (where n = 2) as b, max(v) filter (where n = 3) as c, max(v) filter (where n = 4) as d, chr(64 + min(n) filter (where v = (select p_type from part q where q.p_partkey = r.p_partkey))::int) as answer from r group by 1")
def shuffle_options(t: Tables):
    """CMP12."""
    o = F.create_map(F.lit("A"), F.col("p_brand"), F.lit("B"), F.col("p_type"), F.lit("C"), F.col("p_name"), F.lit("D"), F.col("p_size").cast("string"))
    s = sm.shuffle_options(t.part.select("p_partkey", o.alias("o"), F.lit("B").alias("k")), "o", "k", "p_partkey")
    return s.select("p_partkey", *[F.col("o")[x].alias(x.lower()) for x in "ABCD"], F.col("k").alias("answer"))


@query(f"select doc_id, source from (select doc_id, source, row_number() over (partition by source order by {_ORDER}) as n from documents left join labels using (doc_id) where quality is null) where n <= 20")
def sample_per_source(t: Tables):
    """CMP13: 20 unlabelled rows of each source (the sample is the feature)."""
    d = _labelled(t).where("quality is null").select("doc_id", "source")
    return sm.sample_per_source(d, "source", "doc_id")


@query("select source, count(*) as n from documents left join labels using (doc_id) where quality is null group by 1")
def agg_unlabelled(t: Tables):
    """AGG26."""
    return _labelled(t).where("quality is null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("select p_partkey, coalesce(case when p_size = 1 then '' else 'x' end, '') as q, case when p_size = 1 then 'empty_question' when p_size = 2 then 'wrong_option_count' when p_size = 3 then 'duplicate_options' when p_size = 4 then 'empty_option' when p_size = 5 then 'correct_option_unresolved' end as reason from part")
def structural_reason(t: Tables):
    """FLT4 and SNK6: first reason to drop each row."""
    s = F.col("p_size")
    third = F.when(s == 3, F.col("p_brand")).when(s == 4, F.lit(" ")).otherwise(F.lit("three"))
    four = F.create_map(F.lit("A"), F.concat(F.lit(""), "p_brand"), F.lit("B"), F.lit("two"), F.lit("C"), third, F.lit("D"), F.lit("four"))
    o = F.when(s == 2, F.create_map(F.lit("A"), F.lit("one"))).otherwise(four)
    q = F.when(s == 1, F.lit("")).otherwise("x")
    return t.part.select("p_partkey", q.alias("q"), rs.structural_reason(q, o, F.when(s == 5, F.lit("five")).otherwise("two")).alias("reason"))


@query("select n_name, (dense_rank() over (order by n_name) - 1)::bigint as id from nation")
def contiguous_ids(t: Tables):
    """PRJ16 and WIN2: ids from 0 without a global window."""
    return rs.contiguous_ids(t.nation.select("n_name"), ["n_name"])


@query("select c_custkey, coalesce(n_name, '?') as nation from customer left join nation on c_nationkey = n_nationkey and n_nationkey < 20")
def lookup_default(t: Tables):
    """JN1 and JN9: dimension lookup with a default."""
    return rs.looked_up(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", t.nation.where("n_nationkey < 20"), "n_nationkey", "n_name", F.lit("?"), "nation").select("c_custkey", "nation")


@query("select p_partkey, p_brand as option_a, p_type as option_b, p_name as option_c, '' as option_d, (p_partkey % 4)::int as answer from part")
def flat_options(t: Tables):
    """PRJ5 and PRJ6."""
    o = rs.lettered(F.array("p_brand", "p_type", "p_name"))
    key = F.array(*map(F.lit, "ABCD"))[(F.col("p_partkey") % 4).cast("int")]
    return t.part.select("p_partkey", *rs.flat_options(o, key))


@query("select p_partkey, case when p_size % 5 < 3 then chr(65 + (p_size % 5)::int) end as correct_key, case p_size % 5 when 0 then p_brand when 1 then p_type when 2 then p_name end as correct_option from part")
def canonical_answer(t: Tables):
    """PRJ7 and PRJ8."""
    o = rs.lettered(F.array("p_brand", "p_type", "p_name"))
    return t.part.select("p_partkey", *rs.canonical_answer(o, F.col("p_size") % 5))


@query("select source, lang, n, rank() over (partition by lang order by n desc) as r from (select source, lang, count(*) as n from documents group by 1, 2)")
def win_frequency_rank(t: Tables):
    """WIN4."""
    n = t.documents.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("n"))).cast("long"))


@query("with c as (select lang, source, count(*) as n from documents group by 1, 2) select doc_id, row_number() over (order by case lang when 'en' then 0 when 'de' then 1 else 2 end, n desc, coalesce(source, ''), doc_id) - 1 as id from documents join c using (lang, source)")
def release_order(t: Tables):
    """SRT1 and JN10: release order with new ids, without a global window."""
    d = t.documents.select("doc_id", "lang", "source")
    n = d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    x = d.join(n, ["lang", "source"]).select("doc_id", F.when(F.col("lang") == "en", 0).when(F.col("lang") == "de", 1).otherwise(2).alias("a"), (-F.col("n")).alias("b"), F.coalesce("source", F.lit("")).alias("c"))
    return rs.contiguous_ids(x, ["a", "b", "c", "doc_id"]).select("doc_id", "id")


@query("select lang, count(*) filter (where quality = 0)::bigint as low, count(*) filter (where quality = 1)::bigint as high from documents left join labels using (doc_id) group by 1")
def agg_pivot(t: Tables):
    """AGG2."""
    return _labelled(t).groupBy("lang").agg(F.count_if(F.col("quality") == 0).alias("low"), F.count_if(F.col("quality") == 1).alias("high"))


@query("select lang, source, count(*) as n, grouping_id(lang, source)::bigint as g from documents group by grouping sets ((lang), (source), (lang, source))")
def agg_distributions(t: Tables):
    """AGG1 and AGG3: several distributions in one pass."""
    d = t.documents.select("lang", "source")
    return d.groupingSets([["lang"], ["source"], ["lang", "source"]], "lang", "source").agg(F.count(F.lit(1)).alias("n"), F.grouping_id("lang", "source").cast("long").alias("g"))


@query("select page_id, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"'']*)[\"'']', 1)) as link from pages")
def page_links(t: Tables):
    """SRC14: link targets."""
    return t.pages.select("page_id", F.explode(rd.links(F.col("html"))).alias("link"))


@query("select page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)), '^www\\.', '') as host, regexp_replace(html, '<[^>]+>', '', 'g') as plain from pages")
def page_text(t: Tables):
    """TXT21 and TXT34."""
    return t.pages.select("page_id", tx.host(F.col("url")).alias("host"), tx.strip_tags(F.col("html")).alias("plain"))


@query("select page_id, len(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>'))::bigint as n_items, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) as title from pages")
def page_lists(t: Tables):
    """SRC11: list items and titles."""
    items = F.regexp_extract_all("html", F.lit("(?is)<li[^>]*>(.*?)</li>"), 1)
    return t.pages.select("page_id", F.size(items).cast("long").alias("n_items"), F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"))


@query("select c_custkey, 'Segment: ' || c_mktsegment || chr(10) || 'Nation: ' || coalesce(n_name, '') as prompt from customer left join nation on c_nationkey = n_nationkey")
def prompts(t: Tables):
    """PRJ15."""
    x = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return x.select("c_custkey", rs.prompt("Segment: {s}\nNation: {n}", s=F.col("c_mktsegment"), n=F.col("n_name")).alias("prompt"))


_CUSTOMERS = "select c_custkey, 'ann_' || (dense_rank() over (order by c_mktsegment) - 1) as who from customer"


@query(_CUSTOMERS)
def anonymized(t: Tables):
    """PRJ12: names in map keys."""
    x = t.customer.select("c_custkey", F.create_map("c_mktsegment", F.lit(1)).alias("m"))
    return rs.anonymized(x, "m").select("c_custkey", F.map_keys("m")[0].alias("who"))


@query("select doc_id, lang as a, null::varchar as b from documents where lang = 'fr' union all select doc_id, '' as a, source as b from documents where lang = 'es'".replace("null::varchar as b", "'' as b"))
def union_all_keys(t: Tables):
    """SET1 and PRJ3."""
    d = t.documents
    return rs.union_all_keys(d.where("lang = 'fr'").select("doc_id", F.col("lang").alias("a")), d.where("lang = 'es'").select("doc_id", F.col("source").alias("b")))
