"""Registered queries: ordered series, errors, bootstrap, folds and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from assayer.operators import groups as G, series as S
from assayer.plans import derive as D
from registry import parts as P
from registry.runs import _LABELLED, labelled

QUERIES: dict = {}


def register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = (function, sql)
        return function
    return add


# Series: the events of a user by event number; the value is known for the first part and now and then after it.
_POINTS = """select user_id as series, event_id as pos, value, case when event_id % 4 <> 1 and event_id % 100 < 60 then value end as known from {events}"""
_CUT = """select user_id as series, event_id as pos, value, case when event_id * 100 < (select max(event_id) from {events}) * (50 + user_id % 7) then value end as known from {events}"""
_POINTS_SQL, _CUT_SQL = f"points as ({_POINTS.format(events='events')})", f"points as ({_CUT.format(events='events')})"


def points(spark, sf, sql=_POINTS):
    return spark.sql(sql, events=D.read(spark, sf, "events"))


@register("const_hold", f"""with {_POINTS_SQL} select series, pos, last_value(known ignore nulls) over (partition by series order by pos rows between unbounded preceding and current row) as held from points""")
def const_hold(spark, sf):
    return S.const_hold(points(spark, sf)).select("series", "pos", "held")


_FIT = f"""{_CUT_SQL}, ends as (select series, max(pos) as last_pos, arg_max(known, pos) as last_value from points where known is not null group by series),
  fit as (select p.series, regr_slope(known, pos) as slope from points p join ends using (series) where known is not null and pos > last_pos - 2000 group by p.series)"""


@register("slope_extrapolate", f"""with {_FIT} select series, pos, round(last_value + coalesce(case when isnan(slope) then 0 else slope end, 0) * (pos - last_pos), 5) as extended from points join ends using (series) join fit using (series) where known is null and pos > last_pos""")
def slope_extrapolate(spark, sf):
    return S.slope_extrapolate(points(spark, sf, _CUT), 2000).select("series", "pos", F.round("extended", 5).alias("extended"))


@register("slope_extrapolate_damped", f"""with {_FIT} select series, pos, round(last_value + coalesce(case when isnan(slope) then 0 else slope end, 0) * 200.0::double * (1 - pow(2.0::double, -(pos - last_pos) / 200.0::double)) / ln(2.0::double), 5) as extended
  from points join ends using (series) join fit using (series) where known is null and pos > last_pos""")
def slope_extrapolate_damped(spark, sf):
    return S.slope_extrapolate(points(spark, sf, _CUT), 2000, half_life=200.0).select("series", "pos", F.round("extended", 5).alias("extended"))


_ERRORS = f"{_CUT_SQL}, ends as (select series, arg_max(known, pos) as last_value from points where known is not null group by series), errors as (select series, value - last_value as error from points join ends using (series) where known is null)"


def errors(spark, sf):
    rows = points(spark, sf, _CUT)
    return rows.where(F.col("known").isNull()).join(S.known_tail(rows), "series").select("series", (F.col("value") - F.col("last_value")).alias("error"))


@register("rmse_by_series", f"with {_ERRORS} select case when grouping(series) = 1 then 'ALL' else cast(series as varchar) end as series, count(*) as n, round(sqrt(avg(error * error)), 6) as rmse from errors group by rollup(series)")
def rmse_by_series(spark, sf):
    return S.rmse_by(errors(spark, sf)).withColumn("rmse", F.round("rmse", 6))


@register("error_concentration", f"""with {_ERRORS}, s as (select series, sum(error * error) as squared from errors group by series)
  select series, round(squared, 4) as squared, rank, round(cumulative_share, 6) as cumulative_share from (select series, squared, cast(row_number() over w as int) as rank,
  sum(squared) over (order by squared desc, series) / (select sum(squared) from s) as cumulative_share from s window w as (order by squared desc, series)) z where rank <= 5""")
def error_concentration(spark, sf):
    out = S.error_concentration(errors(spark, sf), 5)
    return out.select("series", F.round("squared", 4).alias("squared"), "rank", F.round("cumulative_share", 6).alias("cumulative_share"))


_EDGES = ", ".join(f"{e!r}::double" for e in S.POISSON)


@register("paired_bootstrap_ci", f"""with {_LABELLED}, d as (select row_id, b_ok::int - a_ok::int as difference from labelled),
  u as (select replicate, difference, ('0x' || substr(md5(row_id || '-' || replicate), 1, 8))::bigint / 4294967296.0::double as u from d, (select unnest(range(100)) as replicate) r),
  w as (select replicate, difference, len(list_filter([{_EDGES}], lambda e: u >= e)) as w from u), s as (select replicate, sum(w * difference) / sum(w)::double as mean from w group by 1)
  select (select count(*) from d) as n, round((select avg(difference) from d), 9) as mean, round(quantile_cont(mean, 0.025), 9) as low, round(quantile_cont(mean, 0.975), 9) as high from s""")
def paired_bootstrap_ci(spark, sf):
    pairs = labelled(spark, sf).select("row_id", (F.col("b_ok").cast("int") - F.col("a_ok").cast("int")).alias("difference"))
    out = S.paired_bootstrap_ci(pairs, 100)
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("mean", "low", "high")])


@register("median_ensemble", """with p as (select user_id as series, event_id % 40 as pos, value from events) select series, pos, round(median(value), 6) as value from p group by 1, 2""")
def median_ensemble(spark, sf):
    rows = D.read(spark, sf, "events").select(F.col("user_id").alias("series"), (F.col("event_id") % 40).alias("pos"), "value")
    return S.median_ensemble(rows).withColumn("value", F.round("value", 6))


@register("group_kfold", """select user_id, cast(('0x' || substr(md5(cast(user_id as varchar)), 1, 8))::bigint % 5 as int) as fold, count(*) as n from events group by 1, 2""")
def group_kfold(spark, sf):
    counted = D.read(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", S.group_fold(F.col("user_id"), 5).alias("fold"), "n")


@register("balanced_folds", """with recursive g as (select user_id, count(*) as n, md5(cast(user_id as varchar)) as h from events group by 1), o as materialized (select *, row_number() over (order by n desc, h) as i from g),
  dealt(i, a, b, c, d, e, n, fold) as (select 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, 0::bigint, -1 union all
    select i, a + case when fold = 0 then n else 0 end, b + case when fold = 1 then n else 0 end, c + case when fold = 2 then n else 0 end, d + case when fold = 3 then n else 0 end, e + case when fold = 4 then n else 0 end, n, fold from (
      select o.i, a, b, c, d, e, o.n, list_position([a, b, c, d, e], least(a, b, c, d, e)) - 1 as fold from dealt join o on o.i = dealt.i + 1) t),
  shares as (select n, fold, count(*) as groups from dealt where fold >= 0 group by 1, 2), ends as (select *, sum(groups) over (partition by n order by fold) as high from shares),
  ranked as (select user_id, n, row_number() over (partition by n order by h) as r from g) select user_id, ranked.n, cast(fold as int) as fold from ranked join ends on ends.n = ranked.n and r > high - groups and r <= high""")
def balanced_folds(spark, sf):
    return S.balanced_folds(D.read(spark, sf, "events"), "user_id", 5)


# A third of all events belong to one group.
@register("map_groups", """with e as (select case when event_id % 3 = 0 then 'hot' else concat(event_type, user_id % 50) end as key, value from events)
  select key, count(*) as n, round(sum(value), 2) as total, round(sum(value * value), 4) as squares, max(value) as most from e group by 1""")
def map_groups(spark, sf):
    """Sums of every group from merged means and squared deviations."""
    def partial(rows):
        values = rows.column("value").to_numpy()
        return {"n": len(values), "mean": float(values.mean()), "squares": float(((values - values.mean()) ** 2).sum()), "most": float(values.max())}

    def merge(a, b):
        n, gap = a["n"] + b["n"], b["mean"] - a["mean"]
        return {"n": n, "mean": a["mean"] + gap * b["n"] / n, "squares": a["squares"] + b["squares"] + gap * gap * a["n"] * b["n"] / n, "most": max(a["most"], b["most"])}

    def finish(s):
        return {"n": s["n"], "total": s["mean"] * s["n"], "squares": s["squares"] + s["mean"] ** 2 * s["n"], "most": s["most"]}

    key = F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.concat("event_type", (F.col("user_id") % 50).cast("string")))
    rows = D.read(spark, sf, "events").select(key.alias("key"), "value")
    found = G.map_groups(rows, ["key"], partial, merge, finish, "n bigint, mean double, squares double, most double", "n bigint, total double, squares double, most double")
    return found.select("key", "n", F.round("total", 2).alias("total"), F.round("squares", 4).alias("squares"), "most")


_HISTORY = """select concat('run', event_id % 12) as run, event_id as started, event_type as type, case when value > 20 then 1 else 0 end as correct, 1 as n from {events} where not (event_id % 12 = 5 and event_type = 'click')"""
_CELLS = ["click", "error", "purchase", "view"]


@register("run_trajectory", f"""with h as ({_HISTORY.format(events='events')}), r as (select run, min(started) as started, sum(correct) / sum(n) as acc,
  {', '.join(f"coalesce(cast(cast(round(100 * sum(correct) filter (where type = '{t}') / sum(n) filter (where type = '{t}')) as int) as varchar) || '%', '-') as {t}" for t in _CELLS)} from h group by run)
  select run, started, round(acc, 9) as acc, {', '.join(_CELLS)}, round(acc - lag(acc) over (order by started, run), 9) as change from r""")
def run_trajectory(spark, sf):
    history = spark.sql(_HISTORY, events=D.read(spark, sf, "events"))
    out = S.run_trajectory(history, _CELLS)
    return out.select("run", "started", F.round("acc", 9).alias("acc"), *_CELLS, F.round("change", 9).alias("change"))


@register("idw_neighbours", """with t as (select s_suppkey as target_id, cast((s_suppkey * 7919) % 997 as double) / 10 as x, cast((s_suppkey * 1047) % 991 as double) / 10 as y from supplier),
  k as (select c_custkey as point_id, case when c_custkey % 3 = 0 then 50.0::double else cast((c_custkey * 31) % 1009 as double) / 10 end as x, case when c_custkey % 3 = 0 then 50.0::double else cast((c_custkey * 57) % 1013 as double) / 10 end as y, c_acctbal as value from customer),
  d as (select target_id, point_id, value, sqrt(pow(t.x - k.x, 2) + pow(t.y - k.y, 2)) as distance from t, k),
  n as (select * from d qualify row_number() over (partition by target_id order by distance, point_id) <= 6)
  select target_id, round(sum(value / pow(greatest(distance, 1e-9::double), 2)) / sum(1 / pow(greatest(distance, 1e-9::double), 2)), 4) as estimate, count(*) as neighbours from n group by 1""")
def idw_neighbours(spark, sf):
    key, cust = F.col("s_suppkey"), F.col("c_custkey")
    targets = D.read(spark, sf, "supplier").select(key.alias("target_id"), (((key * 7919) % 997).cast("double") / 10).alias("x"), (((key * 1047) % 991).cast("double") / 10).alias("y"))
    crowd = cust % 3 == 0
    known = D.read(spark, sf, "customer").select(
        cust.alias("point_id"), F.when(crowd, 50.0).otherwise(((cust * 31) % 1009).cast("double") / 10).alias("x"),
        F.when(crowd, 50.0).otherwise(((cust * 57) % 1013).cast("double") / 10).alias("y"), F.col("c_acctbal").alias("value"))
    return S.idw_neighbours(targets, known, 6).withColumn("estimate", F.round("estimate", 4))
