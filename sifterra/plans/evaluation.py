"""Agreement, verdicts, time statistics and accuracy over ``labels``, ``events``,
``conversations`` and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sifterra.functions import text as tx
from sifterra.operators import agreement as ag
from sifterra.operators import evaluation as ev
from sifterra.plans.registry import Tables, query
from sifterra.streaming.incremental import pending


@query("select count(*) as total, count(*) filter (where quality = toxic)::bigint as agree, (count(*) filter (where quality = toxic)::double / count(*) - 0.25) / 0.75 as kappa from labels")
def agg_kappa(t: Tables):
    """AGG10: two raters of the labelled documents."""
    n, same = F.count(F.lit(1)), F.count_if(F.col("quality") == F.col("toxic"))
    return t.labels.agg(n.alias("total"), same.alias("agree")).withColumn("kappa", ag.fixed_chance_kappa(F.col("agree"), F.col("total")))


_PICKS = "select event_id % 997 as item, user_id as annotator, max_by(event_type, (ts, event_id)) as pick from events group by 1, 2"


def _picks(t: Tables):
    e = t.events.select((F.col("event_id") % 997).alias("item"), F.col("user_id").alias("annotator"), "event_type", "ts", "event_id")
    return ag.last_wins(e, ["item", "annotator"], ["ts", "event_id"]).select("item", "annotator", F.col("event_type").alias("pick"))


@query(f"with p as ({_PICKS}) select a.annotator as first, b.annotator as second, count(*) filter (where a.pick = b.pick)::bigint as agree, count(*) as total, round_even(count(*) filter (where a.pick = b.pick) / count(*), 3) as rate from p a join p b on a.item = b.item and a.annotator < b.annotator group by 1, 2")
def agg_pair_agreement(t: Tables):
    """AGG9 after JN3: last pick of each annotator, agreement of pairs."""
    return ag.pair_agreement(_picks(t), "item", "annotator", "pick")


@query(f"with p as ({_PICKS}), x as (select a.annotator as u, b.annotator as v, (a.pick <> b.pick)::int as d from p a join p b on a.item = b.item and a.annotator <> b.annotator) select u as annotator, sum(d)::bigint as disagree, count(*) as total from x group by u having count(*) >= 10")
def agg_annotator_disagreement(t: Tables):
    """AGG11: disagreements of each annotator over pairs, at least 10."""
    return ag.disagreements(_picks(t), "item", "annotator", "pick", 10)


@query(f"with p as ({_PICKS}), g as (select item, count(*) as n, bool_or(pick = 'error') as flagged, bool_or(pick = 'signup') as unsure, bool_or(pick not in ('click', 'view', 'purchase', 'signup')) as invalid, count(distinct pick) as k from p group by item) select case when n < 2 then 'single_annotated' when flagged then 'flagged' when unsure then 'unsure' when invalid then 'invalid' when k > 1 then 'disagree' else 'include' end as verdict, count(*) as n from g group by 1")
def flt_verdict(t: Tables):
    """FLT13 and AGG5: verdict of each item."""
    g = _picks(t).groupBy("item").agg(F.collect_list("pick").alias("picks"))
    v = ag.verdict(F.col("picks"), F.array_contains("picks", "error"), ["click", "view", "purchase"], "signup")
    return g.groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with p as ({_PICKS}), n as (select item, pick, count(*) as n from p where pick <> 'signup' group by 1, 2), m as (select item, max(n) as top from n group by 1), c as (select n.item, case when count(*) = 1 then min(pick) end as consensus from n join m on n.item = m.item and n.n = m.top group by 1) select p.annotator, count(*) filter (where p.pick = c.consensus)::bigint as agree, count(*) as total from p join c using (item) where p.pick <> 'signup' group by 1")
def agg_consensus(t: Tables):
    """AGG13: agreement with the consensus; a tie agrees with nobody."""
    p = _picks(t)
    c = ag.consensus(p, "item", "pick", "signup")
    joined = p.where("pick <> 'signup'").join(c, "item")
    return joined.groupBy("annotator").agg(F.count_if(F.col("pick") == F.col("consensus")).alias("agree"), F.count(F.lit(1)).alias("total"))


@query("select event_type, count(*) as n, round(sum(value), 4) as raw, round(sum(least(value, 50.0)), 4) as capped, count(*) filter (where value > 50)::bigint as n_over, round(median(value), 6) as median, round(avg(least(value, 50.0)), 6) as mean_capped from events where value > 0 group by 1")
def agg_capped_times(t: Tables):
    """AGG12."""
    out = ag.capped_times(t.events, "event_type", "value", 50.0)
    return out.select("event_type", "n", F.round("raw", 4).alias("raw"), F.round("capped", 4).alias("capped"), "n_over", F.round("median", 6).alias("median"), F.round("mean_capped", 6).alias("mean_capped"))


@query("select user_id, event_type, 1::bigint as n_added, (count(*) - 1)::bigint as n_updated from events group by 1, 2")
def agg_ledger(t: Tables):
    """AGG22."""
    return ag.ledger_counts(t.events, ["user_id", "event_type"], ["ts", "event_id"])


@query("select user_id, event_type, max_by(event_id, (ts, event_id)) as event_id, max_by(value, (ts, event_id)) as value from events group by 1, 2")
def upsert_last_wins(t: Tables):
    """JN3: keyed upsert."""
    return ag.last_wins(t.events.select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("select o_orderkey, o_orderstatus from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity > 45)")
def join_pending(t: Tables):
    """JN4: samples without a result."""
    done = t.lineitem.where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return pending(t.orders.select("o_orderkey", "o_orderstatus"), done, "o_orderkey")


@query("select o_orderkey, o_custkey from orders where exists (select 1 from customer where c_custkey = o_custkey and c_mktsegment = 'BUILDING')")
def join_assigned(t: Tables):
    """JN2: rows whose key is assigned."""
    assigned = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.select("o_orderkey", "o_custkey").join(assigned, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("with a as (select distinct c_custkey as k from customer), b as (select distinct o_custkey as k from orders) select count(*) filter (where b.k is null)::bigint as remaining, count(*) filter (where a.k is null)::bigint as extra, count(*) filter (where a.k is not null and b.k is not null)::bigint as done from a full outer join b on a.k = b.k")
def join_completion(t: Tables):
    """JN8/SET4: assigned against submitted."""
    a, b = t.customer.select(F.col("c_custkey").alias("a")).distinct(), t.orders.select(F.col("o_custkey").alias("b")).distinct()
    both = a.join(b, F.col("a") == F.col("b"), "full_outer")
    return both.agg(F.count_if(F.col("b").isNull()).alias("remaining"), F.count_if(F.col("a").isNull()).alias("extra"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("done"))


_ACC = "select o_orderkey, c_mktsegment as segment, r_name as region, case when o_orderpriority like '5%' then null else n_name end as nation, o_totalprice > 150000 as correct, o_orderstatus <> 'P' as parseable from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"


def _accuracy(t: Tables):
    nation = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"), F.when(~F.col("o_orderpriority").startswith("5"), F.col("n_name")).alias("nation"), (F.col("o_totalprice") > 150000).alias("correct"), (F.col("o_orderstatus") != "P").alias("parseable"))


@query(f"with x as ({_ACC}), u as (select 'all' as dim, '' as value, correct, parseable from x union all select 'segment', segment, correct, parseable from x union all select 'region', region, correct, parseable from x union all select 'nation', nation, correct, parseable from x where nation is not null) select dim, value, count(*) filter (where correct and parseable)::bigint as n_correct, count(*) filter (where parseable)::bigint as n_parseable, count(*) as n_total, case when count(*) filter (where parseable) > 0 then count(*) filter (where correct and parseable)::double / count(*) filter (where parseable) else 0.0 end as accuracy from u group by 1, 2")
def agg_accuracy(t: Tables):
    """AGG6: roll-up over all and by three dimensions in one pass."""
    return ev.accuracy_rollup(_accuracy(t), ["segment", "region", "nation"])


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query(f"with x as ({_ACC}) select segment, " + ", ".join(f"count(*) filter (where region = '{r}' and parseable and correct)::bigint as \"{r}_correct\", count(*) filter (where region = '{r}' and parseable)::bigint as \"{r}_questions\", case when count(*) filter (where region = '{r}' and parseable) > 0 then round_even(100.0::double * count(*) filter (where region = '{r}' and parseable and correct) / count(*) filter (where region = '{r}' and parseable), 2) else 0.0 end as \"{r}_accuracy\"" for r in _REGIONS) + " from x group by 1")
def agg_accuracy_wide(t: Tables):
    """AGG7: one wide row for each segment."""
    return ev.accuracy_wide(_accuracy(t), "segment", "region", _REGIONS)


_LETTER = "regexp_extract(text, '(^|[^A-Za-z])([ABCDabcd])([^A-Za-z]|$)', 2)"


@query(f"select role, count(*) as n, count(*) filter (where trim(coalesce(text, '')) = '' or starts_with(text, 'ERROR'))::bigint as errors, count(*) filter (where {_LETTER} <> '')::bigint as with_letter, count(*) filter (where upper({_LETTER}) = 'A')::bigint as with_a from conversations group by role")
def eval_prediction_states(t: Tables):
    """TXT25 and TXT33 over conversation texts, none of which names its answer's letter first."""
    x = F.col("text")
    key = tx.parse_key(x)
    return t.conversations.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.count_if(tx.is_error(x)).alias("errors"), F.count_if(key.isNotNull()).alias("with_letter"), F.count_if(key == "A").alias("with_a"))


@query("with x as (select event_id, user_id, event_type, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type order by ts, event_id) as island from events) select user_id, max(n) as longest from (select user_id, island, count(*) as n from x where event_type = 'error' group by 1, 2) group by 1")
def win_error_runs(t: Tables):
    """WIN8: longest run of consecutive errors."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    same = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    runs = t.events.withColumn("island", F.row_number().over(by) - F.row_number().over(same)).where("event_type = 'error'")
    return runs.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_props(t: Tables):
    """Typed JSON columns."""
    return t.events.select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("with n as (select n_regionkey as sub, c_mktsegment as dom, count(*) as n, min(c_custkey) as p from customer join nation on c_nationkey = n_nationkey group by 1, 2) select sub, max_by(dom, (n, -p)) as dom from n group by 1")
def agg_majority(t: Tables):
    """AGG8: majority with ties by first sight."""
    x = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_regionkey").alias("sub"), F.col("c_mktsegment").alias("dom"), "c_custkey")
    return ag.majority(x, "sub", "dom", "c_custkey")


@query()
def edits_merged_whole(t: Tables):
    """TXT31/SRT6 over whole texts: two transforms as the edits of each text."""
    x = F.col("text")
    edits = F.array(tx.normalize_blanks(x), tx.clean_text(x))
    return t.documents.select("doc_id", ag.merge_edits(edits, x).alias("result"))
