"""Telemetry queries on events (batch form of the streaming operators), sources and text records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terraledger.operators import classify, ranks
from terraledger.plans import fixtures as fx
from terraledger.plans.registry import query
from terraledger.streaming import telemetry, windows


def _events(spark, sf):
    return fx.table(spark, sf, "events")


@query("sm_01_tumbling", "select event_type, time_bucket(interval 1 hour, ts) as start, count(*) as n, round(max(value), 4) as worst, round(avg(value), 4) as mean from events group by 1, 2")
def sm_01(spark, sf):
    return telemetry.tumbling(_events(spark, sf), "ts", "1 hour", ["event_type"], [F.count("*").alias("n"), F.round(F.max("value"), 4).alias("worst"), F.round(F.avg("value"), 4).alias("mean")], late="10 minutes")


@query("sm_02_gap_discard", "select user_id, count(*) as n, count(*) filter (where g > 36000) as gaps from (select user_id, epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts, event_id)) as g from events) group by user_id")
def sm_02(spark, sf):
    t = F.col("ts").cast("timestamp").cast("double")
    g = t - F.lag(t).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return _events(spark, sf).withColumn("g", g).groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("g") > 36000).alias("gaps"))


@query("sm_03_episodes", """select user_id, episode, count(*) as n_bad, min(ts) as first, max(ts) as last from (select *, sum(s) over (partition by user_id order by ts, event_id rows unbounded preceding) as episode from
  (select *, case when bad = 1 and coalesce(max(bad) over (partition by user_id order by ts, event_id rows between 2 preceding and 1 preceding), 0) = 0 then 1 else 0 end as s from (select *, case when value > 60 then 1 else 0 end as bad from events))) where bad = 1 group by user_id, episode""")
def sm_03(spark, sf):
    return telemetry.episodes(_events(spark, sf), "user_id", ["ts", "event_id"], F.col("value") > 60)


#: Twelve hours a window, a day and a half a gap.
RULES = windows.Rules(width=43_200_000, gap=129_600_000, bad=90.0, good=2, history=5)
_WINDOWS = f"""s as (select *, row_number() over (partition by user_id order by t, event_id) as i, t - lag(t) over (partition by user_id order by t, event_id) as d from (select user_id, event_id, value, epoch_ms(ts) as t from events)),
 g as (select *, sum(case when d is null or d > {RULES.gap} then 1 else 0 end) over (partition by user_id order by i) as seg from s),
 nxt as (select a.user_id, a.seg, a.i, a.t, min(b.i) as j from g a left join g b on a.user_id = b.user_id and a.seg = b.seg and b.i > a.i and b.t >= a.t + {RULES.width} group by 1, 2, 3, 4),
 walk(user_id, i) as (select user_id, min(i) from g group by user_id, seg union all select nxt.user_id, nxt.j from walk join nxt on walk.user_id = nxt.user_id and walk.i = nxt.i where nxt.j is not null),
 win as (select n.user_id, n.seg, n.i, n.t as start, max(g.t) as "end", count(*) as n, max(g.value) as worst from walk join nxt n using (user_id, i) join g on g.user_id = n.user_id and g.i > n.i and g.i <= n.j where n.j is not null group by 1, 2, 3, 4),
 run as (select *, sum(case when worst > {RULES.bad} and near = 0 then 1 else 0 end) over (partition by user_id, seg order by i rows unbounded preceding) as e from (select *, coalesce(max(case when worst > {RULES.bad} then 1 else 0 end) over (partition by user_id, seg order by i rows between {RULES.good} preceding and 1 preceding), 0) as near from win))"""


@query("sm_02_gap_windows", f"""with recursive {_WINDOWS} select user_id, 'window' as kind, start, "end", n, worst, max(worst) over (partition by user_id order by i rows between {RULES.history - 1} preceding and current row) as recent from win
  union all select user_id, 'episode', min(start), max("end"), count(*), max(worst), null from run where worst > {RULES.bad} group by user_id, seg, e""")
def sm_02_windows(spark, sf):
    """Windows that a gap throws away, the episodes that bad ones make and gaps close, and the worst of a bounded history; a sample without a user is in none."""
    return windows.windows(_events(spark, sf).where("user_id is not null"), "user_id", "ts", "value", "event_id", RULES)


@query("sm_05_report", "select event_type, user_id % 3 as band, list_sort(list(value))[cast(floor(count(value) / 2) as bigint) + 1] as mid, count(value) as n from events group by 1, 2")
def sm_05(spark, sf):
    """The middle value of few large groups: the one whose ranks hold floor(n / 2)."""
    e = _events(spark, sf).select("event_type", (F.col("user_id") % 3).alias("band"), "value")
    d = ranks.distribution(e, ["value"], ["event_type", "band"])
    n = d.groupBy("event_type", "band").agg(F.sum("n").alias("total"))
    half = F.floor(F.col("total") / 2)
    return d.join(n, ["event_type", "band"]).where((half >= F.col("before")) & (half < F.col("before") + F.col("n"))).select("event_type", "band", F.col("value").alias("mid"), F.col("total").alias("n"))


@query("sm_06_rate_limit", "select user_id, time_bucket(interval 1 day, ts) as start, count(*) as n, count(*) - 3 as rejected from events group by 1, 2 having count(*) > 3")
def sm_06(spark, sf):
    return telemetry.over_limit(_events(spark, sf), "ts", "1 day", "user_id", 3)


@query("sm_07_ingest", "select event_id, left(event_type, 4) as name, try_cast(json_extract_string(props, '$.k') as bigint) as k, case when value >= 0 then value end as value from events")
def sm_07(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return _events(spark, sf).select("event_id", F.substring("event_type", 1, 4).alias("name"), k.alias("k"), F.when(F.col("value") >= 0, F.col("value")).alias("value"))


@query("sm_08_request_log", "select event_id, case when event_id % 9 = 0 then 'aborted' else 'finish' end as phase, case when event_id % 9 = 0 then 'warn' when value > 90 then 'error' else 'info' end as level from events")
def sm_08(spark, sf):
    aborted = F.col("event_id") % 9 == 0
    return _events(spark, sf).select("event_id", F.when(aborted, "aborted").otherwise("finish").alias("phase"), classify.first_match([(aborted, "warn"), (F.col("value") > 90, "error")], "info").alias("level"))


@query("sm_09_debounce", "select user_id, start, event_type from (select user_id, time_bucket(interval 1 hour, ts) as start, event_type, row_number() over (partition by user_id, time_bucket(interval 1 hour, ts) order by ts desc, event_id desc) as r from events) where r = 1")
def sm_09(spark, sf):
    return telemetry.debounced(_events(spark, sf), "ts", "user_id", "1 hour", "event_type", "event_id")


@query("sc_02_pruned_scan", "select l_orderkey, l_quantity from lineitem where l_quantity > 45")
def sc_02(spark, sf):
    return fx.table(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_quantity")


@query("sc_13_count_verified", "select count(*) as n, count(distinct o_orderkey) as keys, count(*) = count(distinct o_orderkey) as complete from orders")
def sc_13(spark, sf):
    n, k = F.count("*"), F.count_distinct("o_orderkey")
    return fx.table(spark, sf, "orders").agg(n.alias("n"), k.alias("keys"), (n == k).alias("complete"))


@query("sc_15_envelope_scan", fx.sql("select fkey from geo where x0 <= 4000 and x1 >= 2000 and y0 <= 100 and y1 >= 0", "geo"))
def sc_15(spark, sf):
    return fx.geo(spark, sf).where("x0 <= 4000 and x1 >= 2000 and y0 <= 100 and y1 >= 0").select("fkey")


@query("sc_16_statistics_scan", "select max(o_orderpriority) as top, min(o_orderdate) as first from orders")
def sc_16(spark, sf):
    return fx.table(spark, sf, "orders").agg(F.max("o_orderpriority").alias("top"), F.min("o_orderdate").alias("first"))


@query("sc_17_grouped_scan", "select o_orderpriority, count(*) as n from orders where o_totalprice > 1000 group by 1 order by n desc, 1 limit 3")
def sc_17(spark, sf):
    return fx.table(spark, sf, "orders").where("o_totalprice > 1000").groupBy("o_orderpriority").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderpriority").limit(3)


@query("sc_21_fixed_width", "select page_id, substr(html, 1, 10) as a, trim(substr(html, 11, 20)) as b, length(html) as n from pages")
def sc_21(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", F.substring("html", 1, 10).alias("a"), F.trim(F.substring("html", 11, 20)).alias("b"), F.length("html").cast("long").alias("n"))


@query("sc_22_record_parse", "select page_id, n, part, len(regexp_extract_all(part, '[A-Za-z]+')) as words, regexp_extract(part, '[0-9]+') as number from (select page_id, unnest(string_split(html, '<p>')) as part, generate_subscripts(string_split(html, '<p>'), 1) as n from pages) where n > 1")
def sc_22(spark, sf):
    """Records of a text layout: the whole record, its number of words and its first number."""
    p = fx.table(spark, sf, "pages").select("page_id", F.posexplode(F.split("html", "<p>")).alias("i", "part"))
    words = F.size(F.regexp_extract_all("part", F.lit("[A-Za-z]+"), 0)).cast("long")
    return p.where("i > 0").select("page_id", (F.col("i") + 1).cast("long").alias("n"), "part", words.alias("words"), F.regexp_extract("part", "[0-9]+", 0).alias("number"))


@query("sc_26_best_image", "select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by p_size, p_partkey desc) as r from part) where r = 1")
def sc_26(spark, sf):
    return fx.table(spark, sf, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct("p_size", -F.col("p_partkey"))).alias("p_partkey"))


@query("sk_02_rounded_json", fx.sql("select fkey, '{\"rate\":' || printf('%.2f', cast(floor(land * 100 / area) as bigint) / 100.0) || '}' as doc, case when fkey % 7 = 0 then null else 1.5 end as finite from par where land > area", "par"))
def sk_02(spark, sf):
    cents = F.floor(F.col("land") * 100 / F.col("area")) / 100.0
    infinite = F.when(F.col("fkey") % 7 == 0, F.lit(float("inf"))).otherwise(1.5)
    return fx.par(spark, sf).where("land > area").select("fkey", F.concat(F.lit('{"rate":'), F.format_string("%.2f", cents), F.lit("}")).alias("doc"), F.when(F.abs(infinite) != float("inf"), infinite).alias("finite"))


@query("sk_03_zoom_gated", fx.sql("select fkey, '{\"minzoom\":' || case when area > 1500 then 10 else 13 end || ',\"maxzoom\":14}' as gate from par", "par"))
def sk_03(spark, sf):
    return fx.par(spark, sf).select("fkey", F.to_json(F.struct(F.when(F.col("area") > 1500, 10).otherwise(13).alias("minzoom"), F.lit(14).alias("maxzoom"))).alias("gate"))


@query("sk_06_tight_bounds", fx.sql("select min(x0) as w, max(x1) as e, max(x1) - min(x0) as width from par where land > 0", "par"))
def sk_06(spark, sf):
    return fx.par(spark, sf).where("land > 0").agg(F.min("x0").alias("w"), F.max("x1").alias("e"), (F.max("x1") - F.min("x0")).alias("width"))
