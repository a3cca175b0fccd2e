"""Queries of the cell family."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.stats import two_sided_sql
from ..operators import cells as C
from . import views as V
from .catalog import query

CV = {"c": V.CELLS}
R = lambda c, d=6: F.round(c, d)


@query("cell_guid", V.with_views("select id, md5(tile || '-' || round_even(px * 1.5, 0)::bigint || '-' || round_even(py * 1.5, 0)::bigint) as guid from c", **CV))
def cell_guid(spark, sf_dir):
    cells = V.cells(spark, sf_dir).withColumns({"px": F.col("px") * 1.5, "py": F.col("py") * 1.5})
    return cells.select("id", C.cell_guid().alias("guid"))


@query("filter_noise", V.with_views("select id, points, area from c where points > (select cast(round_even(quantile_cont(points, 0.25), 0) as bigint) from c) and area > 0 and weight > 0", **CV))
def filter_noise(spark, sf_dir):
    return C.filter_noise(V.cells(spark, sf_dir)).select("id", "points", "area")


TH, T, S = 0.7, (3.0, -2.0), (1.2, 0.9)


@query("transform_cells", V.with_views(f"select id, round(px * {S[0]} * {math.cos(TH)!r} - py * {S[1]} * {math.sin(TH)!r} + {T[0]}, 6) as px, round(px * {S[0]} * {math.sin(TH)!r} + py * {S[1]} * {math.cos(TH)!r} + {T[1]}, 6) as py from c", **CV))
def transform_cells(spark, sf_dir):
    return C.transform_points(V.cells(spark, sf_dir), TH, T, S).select("id", R("px").alias("px"), R("py").alias("py"))


TRI, BOX = [(2.0, 2.0), (22.0, 4.0), (10.0, 30.0)], [(20.0, 10.0), (35.0, 10.0), (35.0, 28.0), (20.0, 28.0)]


def _polygon_sql(poly):
    terms = []
    for (x1, y1), (x2, y2) in zip(poly, poly[1:] + poly[:1], strict=True):
        if y1 != y2:
            on = "true" if x1 == x2 else f"px <= (py - {y1}) * {(x2 - x1) / (y2 - y1)!r} + {x1}"
            terms.append(f"(case when py > {min(y1, y2)} and py <= {max(y1, y2)} and px <= {max(x1, x2)} and {on} then 1 else 0 end)")
    return "(" + " + ".join(terms) + ") % 2 = 1"


LABELS = f"r as (select id, px, py, case when {_polygon_sql(BOX)} then 'box' when {_polygon_sql(TRI)} then 'triangle' end as region from c)"


@query("label_cells", V.with_views(f", {LABELS} select id, region from r", **CV))
def label_cells(spark, sf_dir):
    return C.label_cells(V.cells(spark, sf_dir), {"triangle": TRI, "box": BOX}).select("id", "region")


@query("export_labelled", V.with_views(f", {LABELS}, k as (select * from r where region is not null) select id, region, px - (select min(px) from k) as px, py - (select min(py) from k) as py from k", **CV))
def export_labelled(spark, sf_dir):
    return C.export_labelled(C.label_cells(V.cells(spark, sf_dir), {"triangle": TRI, "box": BOX})).select("id", "region", "px", "py")


A, B = "a as (select * from c where id % 2 = 0)", "b as (select * from c where id % 2 = 1)"
DIST = "sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2)"
PAIRS = f", {A}, {B}, p as (select a.id id_a, b.id id_b, {DIST} as distance from a join b on abs(a.px - b.px) <= 3 and abs(a.py - b.py) <= 3 where {DIST} <= 3)"


def _slices(spark, sf_dir):
    c = V.cells(spark, sf_dir)
    return c.where("id % 2 = 0"), c.where("id % 2 = 1")


@query("range_join", V.with_views(f"{PAIRS} select id_a, id_b, round(distance, 6) as distance from p", **CV))
def range_join(spark, sf_dir):
    a, b = _slices(spark, sf_dir)
    return C.range_pairs(a, b, 3.0).withColumn("distance", R("distance"))


@query("cell_neighbourhood", V.with_views(", p as (select a.id, b.id as o, sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2) d from c a join c b on a.id <> b.id and abs(a.px - b.px) <= 2 and abs(a.py - b.py) <= 2), k as (select id, d from (select *, row_number() over (partition by id order by d, o) r from p where d <= 2) where r <= 10), s as (select id, count(*) n, avg(d) m from k group by 1) select id, coalesce(n, 0) as neighbours, coalesce(n, 0) / 10 as density, round(coalesce(m, 0), 6) as mean_distance from c left join s using (id)", **CV))
def cell_neighbourhood(spark, sf_dir):
    return C.neighbourhood(V.cells(spark, sf_dir), 2.0, 10).select("id", "neighbours", "density", R("mean_distance").alias("mean_distance"))


CELL_MORAN = (
    ", p as (select a.id, b.id as o, b.px, b.py, b.ratio, sqrt((a.px - b.px) ** 2 + (a.py - b.py) ** 2) d from c a join c b on abs(a.px - b.px) <= 2 and abs(a.py - b.py) <= 2), k as (select * from (select *, row_number() over (partition by id order by d, o) r from p where d <= 2) where r <= 10), "
    "s as (select id, count(*)::double n, avg(d) md, avg(ratio) mu, count(*) * sum((ratio - m) ** 4) / sum((ratio - m) ** 2) ** 2 as s3, sum((ratio - m) ** 2) as sq from (select *, avg(ratio) over (partition by id) m from k) group by 1), "
    "w as (select x.id, x.o, 1 / sqrt((x.px - y.px) ** 2 + (x.py - y.py) ** 2) as w, x.ratio as a, y.ratio as b from k x join k y on x.id = y.id and x.o <> y.o), "
    "t as (select id, sum(w) tw, sum(w * (a - mu) * (b - mu)) num, sum((2 * w) ** 2) / 2 s1 from w join s using (id) group by 1), u as (select id, sum((2 * r) ** 2) s2 from (select id, o, sum(w) r from w group by all) group by 1), "
    "v as (select id, n, md, case when sq >= 1e-20 then n * num / (tw * sq) end as moran, -1 / (n - 1) as e, (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * tw ** 2) - s3 * ((n * n - n) * s1 - 2 * n * s2 + 6 * tw ** 2)) / ((n - 1) * (n - 2) * (n - 3) * tw ** 2) - 1 / (n - 1) ** 2 as vr from s join t using (id) join u using (id)), "
    "z as (select *, case when vr > 0 then (moran - e) / sqrt(vr) end as z from v)"
)


@query("cell_moran", V.with_views(f"{CELL_MORAN} select id, cast(n as int) as neighbours, round(n / 10, 6) as density, round(md, 6) as mean_distance, round(coalesce(moran, (select min(moran) from z)), 6) as moran, round(coalesce({two_sided_sql('z')}, 1), 5) as p from z", **CV))
def cell_moran(spark, sf_dir):
    out = C.cell_moran(V.cells(spark, sf_dir), 2.0, 10)
    return out.select("id", "neighbours", R("density").alias("density"), R("mean_distance").alias("mean_distance"), R("moran").alias("moran"), R("p", 5).alias("p"))


def _sim(c):
    return f"(1 - abs(a.{c} - b.{c}) / (greatest(a.{c}, b.{c}) + 0.001))"


MATCH = (
    f"{PAIRS}, q as (select * from (select *, row_number() over (partition by id_a order by distance, id_b) r from p) where r <= 16), "
    f"m as (select id_a, id_b, distance, 0.3 * {_sim('area')} + 0.3 * {_sim('ratio')} + 0.2 * {_sim('density')} + 0.2 * {_sim('weight')} as morphology from q join a on a.id = id_a join b on b.id = id_b), "
    "s as (select *, 0.7 * greatest(0, 1 - distance / 3) + 0.3 * morphology as score from m)"
)


@query("match_candidates", V.with_views(f"{MATCH} select id_a, id_b, round(distance, 6) as distance, round(morphology, 6) as morphology, round(score, 6) as score from s", **CV))
def match_candidates(spark, sf_dir):
    a, b = _slices(spark, sf_dir)
    m = C.match_candidates(a, b, 3.0)
    return m.select("id_a", "id_b", R("distance").alias("distance"), R("morphology").alias("morphology"), R("score").alias("score"))


def _matches(spark, sf_dir):
    a, b = _slices(spark, sf_dir)
    return C.greedy_matches(C.match_candidates(a, b, 3.0).withColumn("score", R("score", 9)))


GREEDY = (
    f"{MATCH}, c as (select id_a, id_b, distance, morphology, round(score, 9) as score from s where round(score, 9) > 0.3), "
    "w(i, id_a, id_b, distance, morphology, score, taken) as (select 0, *, false from c union all select i + 1, id_a, id_b, distance, morphology, score, best from ("
    "select *, bool_or(best) over (partition by id_a) as at_a, bool_or(best) over (partition by id_b) as at_b from (select *, ra = 1 and rb = 1 as best from ("
    "select *, row_number() over (partition by id_a order by score desc, id_a, id_b) as ra, row_number() over (partition by id_b order by score desc, id_a, id_b) as rb from w where not taken))) where best or not (at_a or at_b))"
)
GREEDY_SQL = V.with_views(f"{GREEDY} select {{}} from w where taken", **CV).replace("with c as", "with recursive c0 as", 1).replace("from c where id % 2", "from c0 where id % 2")


@query("greedy_matches", GREEDY_SQL.format("id_a, id_b, round(distance, 6) as distance, round(morphology, 6) as morphology, round(score, 6) as score"))
def greedy_matches(spark, sf_dir):
    return _matches(spark, sf_dir).select("id_a", "id_b", *(R(c).alias(c) for c in ("distance", "morphology", "score")))


@query("match_statistics", GREEDY_SQL.format("count(distinct id_a) as n_a, count(distinct id_b) as n_b, round(avg(distance), 6) as mean_distance, round(avg(score), 6) as mean_score"))
def match_statistics(spark, sf_dir):
    return C.match_statistics(_matches(spark, sf_dir)).select("n_a", "n_b", R("mean_distance").alias("mean_distance"), R("mean_score").alias("mean_score"))


@query("cell_lines", "with p as (select l_suppkey as cell, l_quantity as x, l_discount * 100 + l_quantity / 3 as y from lineitem), f as (select cell, regr_slope(y, x) k, regr_intercept(y, x) b, min(x) lo, max(x) hi from p group by 1) select cell, round(atan(k) + case when k < 0 then pi() else 0 end, 6) as theta, round((hi - lo) * sqrt(1 + k * k), 4) as r1, round(max(abs(k * x - y + b) / sqrt(k * k + 1)), 4) as r2 from p join f using (cell) group by cell, k, lo, hi")
def cell_lines(spark, sf_dir):
    p = V.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100 + F.col("l_quantity") / 3).alias("y"))
    return C.line_shape(p).select("cell", R("theta").alias("theta"), R("r1", 4).alias("r1"), R("r2", 4).alias("r2"))


@query("median_radius", "select greatest(median((p_size + p_retailprice / 100) / 2), 5) as radius from part")
def median_radius(spark, sf_dir):
    return C.median_radius(V.table(spark, sf_dir, "part").select(F.col("p_size").alias("r1"), (F.col("p_retailprice") / 100).alias("r2")))


@query("main_cluster", V.with_views("select id, tile from c where tile = (select tile from c group by 1 order by count(*) desc, tile limit 1)", **CV))
def main_cluster(spark, sf_dir):
    return C.most_frequent(V.cells(spark, sf_dir), "tile").select("id", "tile")


@query("tag_union", V.with_views("select id, 'even' as class from c where id % 2 = 0 union all select id, 'odd' as class from c where id % 2 = 1", **CV))
def tag_union(spark, sf_dir):
    a, b = _slices(spark, sf_dir)
    return C.tag_union(even=a.select("id"), odd=b.select("id"))


AB = "ab as (select l_partkey as id, l_returnflag as name, sum(l_tax) - 0.2 as signal from lineitem group by all)"


def _with_antibodies(spark, sf_dir):
    s = V.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("name")).agg((F.sum("l_tax") - 0.2).alias("signal"))
    m = s.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "signal")))).alias("antibody"))
    return V.cells(spark, sf_dir).join(m, "id")


@query("antibody_signal", f"with {AB} select id, round(coalesce(max(case when name = 'R' then signal end), 0), 6) as signal from ab group by 1")
def antibody_signal(spark, sf_dir):
    return C.antibody(_with_antibodies(spark, sf_dir), "R").select("id", R("signal").alias("signal"))


@query("antibody_names", "select distinct l_returnflag as name from lineitem")
def antibody_names(spark, sf_dir):
    return C.antibody_names(_with_antibodies(spark, sf_dir))


@query("any_signal", f"with {AB} select distinct id from ab where round(signal, 9) > 0")
def any_signal(spark, sf_dir):
    cells = _with_antibodies(spark, sf_dir)
    return C.any_signal(cells.withColumn("antibody", F.transform_values("antibody", lambda k, v: F.round(v, 9)))).select("id")


@query("cell_table", V.with_views(f", {AB} select c.id, tile, px, py, area, ratio, density, weight, points, " + ", ".join(f"round(coalesce(max(case when name = '{n}' then signal end), 0), 6) as {n}" for n in "ANR") + " from c join ab using (id) group by all", **CV))
def cell_table(spark, sf_dir):
    t = C.tabular(_with_antibodies(spark, sf_dir), list("ANR"))
    return t.withColumns({n: R(n) for n in "ANR"})
