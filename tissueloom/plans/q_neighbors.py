"""Queries of neighbours, graphs and communities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbors as N
from . import views as V
from .catalog import query

VV = {"v": V.VECS}
R = lambda c, d=6: F.round(c, d)
L2 = "sqrt(list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1] - z[2]) ** 2)))"
COS = "list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: z[1] * z[2])) / sqrt(list_sum(list_transform(a.vec, lambda x: x * x))) / sqrt(list_sum(list_transform(b.vec, lambda x: x * x)))"


KNN_SQL = V.with_views(f", d as (select a.id, b.id as neighbour, {L2} as score from v a join v b on a.id <> b.id), r as (select *, row_number() over (partition by id order by score, neighbour) as rank from d) select id, neighbour, cast(rank as int) as rank, round(score, 5) as score from r where rank <= 10", **VV)


@query("knn", KNN_SQL)
def knn(spark, sf_dir):
    return N.knn(V.vecs(spark, sf_dir), k=10).withColumn("score", R("score", 5))


@query("knn_cells", KNN_SQL)
def knn_cells(spark, sf_dir):
    return N.knn_cells(V.vecs(spark, sf_dir), k=10).withColumn("score", R("score", 5))


@query("joint_links", V.with_views(f", d as (select a.id, b.id as neighbour, {COS} as score from v a join v b on a.id % 2 = 0 and b.id % 2 = 1), r as (select *, row_number() over (partition by id order by score desc, neighbour) as rank from d) select id, neighbour, cast(rank as int) as rank, round(score, 5) as score from r where rank <= 5 and score > 0.2", **VV))
def joint_links(spark, sf_dir):
    v = V.vecs(spark, sf_dir)
    return N.joint_links(v.where("id % 2 = 0"), v.where("id % 2 = 1"), 5, 0.2).withColumn("score", R("score", 5))


NEAR = f", nd as (select a.id as a, b.id as b, a.vec as x, b.vec as y, row_number() over (partition by a.id order by {L2}, b.id) as rank from v a join v b on a.id <> b.id), p as (select a, b, x, y from nd where rank <= 5)"


def _scores(metric):
    def run(spark, sf_dir):
        """Each vector against its five nearest."""
        v = V.vecs(spark, sf_dir).select("id", "vec")
        near = N.knn(v, k=5).select(F.col("id").alias("a"), F.col("neighbour").alias("b"))
        pairs = near.join(v.select(F.col("id").alias("a"), F.col("vec").alias("x")), "a").join(v.select(F.col("id").alias("b"), F.col("vec").alias("y")), "b")
        return N.score_pairs(pairs, "x", "y", metric).select("a", "b", R("score").alias("score"))

    return run


PAIR = V.with_views(NEAR, **VV)
query("score_cosine", f"{PAIR} select a, b, round({COS.replace('a.vec', 'x').replace('b.vec', 'y')}, 6) as score from p")(_scores("cosine"))
query("score_jaccard", f"{PAIR} select a, b, round(list_sum(list_transform(list_zip(x, y), lambda z: case when z[1] > 0 and z[2] > 0 then 1.0 else 0.0 end)) / len(x), 6) as score from p")(_scores("jaccard"))
# |r| beyond this bound has p < 0.05 for 64 pairs (Student's t, 62 degrees of freedom)
CRITICAL = 0.24605
query("score_pearson", f"{PAIR}, u as (select a, b, unnest(x) as s, unnest(y) as t from p), r as (select a, b, corr(s, t) as r from u group by all) select a, b, round(case when abs(r) > {CRITICAL} then r * r else 0 end, 6) as score from r")(_scores("pearson"))
query(
    "score_spearman",
    f"{PAIR}, u as (select a, b, unnest(x) as s, unnest(y) as t from p), k as (select a, b, rank() over (partition by a, b order by s) + (count(*) over (partition by a, b, s) - 1) / 2.0 as s, rank() over (partition by a, b order by t) + (count(*) over (partition by a, b, t) - 1) / 2.0 as t from u), "
    f"r as (select a, b, corr(s, t) as r from k group by all) select a, b, round(case when abs(r) > {CRITICAL} then r * r else 0 end, 6) as score from r",
)(_scores("spearman"))

KNN = f"d as (select a.id, b.id as neighbour, {L2} as score from v a join v b on a.id <> b.id), k as (select id, neighbour from (select *, row_number() over (partition by id order by score, neighbour) as rank from d) where rank <= 10)"
EDGES = f"{KNN}, s as (select distinct least(id, neighbour) as src, greatest(id, neighbour) as dst from k), e as (select src, dst, count(*) / (20.0 - count(*)) / 2 as weight from s join k a on a.id = src join k b on b.id = dst and a.neighbour = b.neighbour group by all)"


def _edges(spark, sf_dir):
    return N.jaccard_edges(N.knn(V.vecs(spark, sf_dir), k=10), 10)


@query("jaccard_edges", V.with_views(f", {EDGES} select src, dst, round(weight, 6) as weight from e", **VV))
def jaccard_edges(spark, sf_dir):
    return _edges(spark, sf_dir).withColumn("weight", R("weight"))


@query("link_cutoff", V.with_views(f", {EDGES} select src, dst, round(weight, 6) as weight from e where weight > (select min(weight) + 0.3 * (max(weight) - min(weight)) from e)", **VV))
def link_cutoff(spark, sf_dir):
    return N.link_cutoff(_edges(spark, sf_dir), 0.3).withColumn("weight", R("weight"))


LINKS = "l as (select o_custkey as src, 1000000000 + o_orderkey as dst from orders)"


def _links(spark, sf_dir):
    """Customers and their orders as a graph."""
    return V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 1_000_000_000).alias("dst"))


COMP = f"with recursive {LINKS}, u as (select src, dst from l union select dst, src from l), c(id, component) as (select distinct src, src from u union select u.dst, c.component from c join u on c.id = u.src where c.component < u.dst)"


@query("components", f"{COMP} select id, min(component) as component from c group by 1")
def components(spark, sf_dir):
    return N.components(_links(spark, sf_dir))


@query("drop_small_components", f"{COMP}, m as (select id, min(component) as k from c group by 1), b as (select k from m group by 1 having count(*) > 10) select src, dst from l join m on src = id where k in (select k from b)")
def drop_small_components(spark, sf_dir):
    return N.drop_small(_links(spark, sf_dir), 10).select("src", "dst")


@query("louvain")
def louvain(spark, sf_dir):
    return N.louvain(_edges(spark, sf_dir))


ROUNDS = "".join(
    f", v{k} as (select src as id, community, sum(weight) as w from u join l{k - 1} on id = dst group by all), l{k} as (select id, arg_max(community, (round(w, 9), -community)) as community from v{k} group by 1)" for k in range(1, 6)
)


@query("label_propagation", V.with_views(f", {EDGES}, u as (select src, dst, weight from e union all select dst, src, weight from e), l0 as (select distinct src as id, src as community from u){ROUNDS} select id, community from l5", **VV))
def label_propagation(spark, sf_dir):
    return N.label_propagation(_edges(spark, sf_dir))


@query("phenograph")
def phenograph(spark, sf_dir):
    return N.phenograph(V.vecs(spark, sf_dir), k=15)[1]


@query("modularity", V.with_views(f", {EDGES}, c as (select id, label as community from v), g as (select weight, a.community x, b.community y from e join c a on a.id = src join c b on b.id = dst), m as (select sum(weight) m, sum(case when x = y then weight else 0 end) i from g), h as (select c, sum(weight) h from (select x as c, weight from g union all select y, weight from g) group by 1) select round(max(i) / max(m) - sum((h / (2 * m)) ** 2), 6) as modularity from h, m", **VV))
def modularity(spark, sf_dir):
    c = V.vecs(spark, sf_dir).select("id", F.col("label").alias("community"))
    return N.modularity(_edges(spark, sf_dir), c).withColumn("modularity", R("modularity"))


@query(
    "graph_tree",
    V.with_views(
        f", o as (select id, vec, row_number() over (order by id) as k from v), n as (select a.k, list(b.id) as near from o a join o b on a.k > b.k and {COS} >= 0.5 group by 1), "
        "z as (select o.id, o.k, coalesce(near, []) as near from o left join n using (k)), t(k, id, leaders, leader) as (select k, id, [id], id from z where k = 1 union all select z.k, z.id, case when len(f) = 0 then list_append(leaders, z.id) else leaders end, coalesce(f[1], z.id) from "
        "(select t.leaders, t.k as before, list_filter(t.leaders, lambda x: list_contains(y.near, x)) as f from t join z y on y.k = t.k + 1) p join z on z.k = p.before + 1) select id, leader from t",
        **VV,
    ).replace("with v", "with recursive v", 1),
)
def graph_tree(spark, sf_dir):
    return N.leader_tree(V.vecs(spark, sf_dir), 0.5)


@query("slice_matrix", V.with_views(", m as (select s_suppkey as spot_id, s_nationkey as guid from supplier) select guid, gene_id, round(avg(value), 6) as value from e join m using (spot_id) group by all", e=V.EXPR))
def slice_matrix(spark, sf_dir):
    mapping = V.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("spot_id"), F.col("s_nationkey").alias("guid"))
    return N.slice_matrix(V.expr(spark, sf_dir), mapping).withColumn("value", R("value"))


@query("correlation_graph", V.with_views(", u as (select label, unnest(vec) as x, generate_subscripts(vec, 1) as k, id % 2 as side from v), m as (select side, label, k, avg(x) x from u group by all), d as (select a.label as id, b.label as n, sum(a.x * b.x) / sqrt(sum(a.x * a.x)) / sqrt(sum(b.x * b.x)) s from m a join m b on a.k = b.k and a.side = 0 and b.side = 1 group by all), r as (select id, n from (select *, row_number() over (partition by id order by s desc, n) r from d) where r <= 3) select cast(id as bigint) as id, string_agg(n::varchar, ',' order by n) as members, md5(string_agg(n::varchar, '+' order by n)) as key from r group by 1", **VV))
def correlation_graph(spark, sf_dir):
    v = V.vecs(spark, sf_dir)
    out = N.correlation_graph(v.where("id % 2 = 0"), v.where("id % 2 = 1"))
    return out.select("id", F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "key")


KIND = "(case when {0} >= 1000000000 then 'metabolite' when {0} % 3 = 0 then null else 'gene' end)"


def _interactions(spark, sf_dir):
    links = _links(spark, sf_dir).withColumn("weight", F.lit(1.0)).distinct()
    ids = links.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    communities = ids.select("id", (F.col("id") % 7).alias("community"))
    return N.interactions(links, ids.where("id < 1000000000 and id % 3 <> 0"), ids.where("id >= 1000000000"), communities)


@query("edge_types", f"with {LINKS} select distinct src, dst, case when {KIND.format('src')} is null or {KIND.format('dst')} is null then 'un-assigned' when {KIND.format('src')} = {KIND.format('dst')} then {KIND.format('src')} else 'cross' end as type from l")
def edge_types(spark, sf_dir):
    return _interactions(spark, sf_dir)[0].select("src", "dst", "type")


@query("community_names", f"with {LINKS}, i as (select src as id from l union select dst from l), p as (select id % 7 as community, bool_and(coalesce({KIND.format('id')} = 'metabolite', false)) m, bool_and(coalesce({KIND.format('id')} = 'gene', false)) g from i group by 1), b as (select community, case when m then 'metaboSet' when g then 'geneSet' else 'crossSet' end as base from p) select community, base || '_' || row_number() over (partition by base order by community) as name from b")
def community_names(spark, sf_dir):
    return _interactions(spark, sf_dir)[1]


COLORS = ["red", "green", "blue"]


@query("cluster_colors", "with s as (select c_nationkey as community, count(*) as n from customer group by 1), g as (select greatest(count(*) filter (n > 60), 1) g from s) select community, n, ['red', 'green', 'blue'][cast((((row_number() over (order by n desc, community) - 1) % g) % 3) as int) + 1] as color from s, g")
def cluster_colors(spark, sf_dir):
    c = V.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("community"))
    return N.cluster_colors(c, COLORS, 60)


@query("manifold_graph")
def manifold_graph(spark, sf_dir):
    return N.manifold_graph(V.vecs(spark, sf_dir).select("id", "vec"))


@query("manifold_graph_pca")
def manifold_graph_pca(spark, sf_dir):
    return N.manifold_graph(V.vecs(spark, sf_dir).select("id", "vec"), layout="pca")


STEPS = " union all ".join(
    f"select {t} as step, id_x, id_y, round(distance, 5) as distance from (select *, row_number() over (partition by id_x order by distance, id_y) p, row_number() over (partition by id_y order by distance, id_x) q from d where x = {t} and y = {t + 1}) where p <= 5 and q <= 5"
    for t in range(2)
)


@query("time_links", V.with_views(f", d as (select a.id as id_x, b.id as id_y, a.id % 3 as x, b.id % 3 as y, {L2} as distance from v a join v b on b.id % 3 = a.id % 3 + 1) {STEPS}", **VV))
def time_links(spark, sf_dir):
    v = V.vecs(spark, sf_dir)
    return N.join_times([v.where(F.col("id") % 3 == t) for t in range(3)]).withColumn("distance", R("distance", 5))


TWO = "w as (select *, id % 2 as side from v), x as (select a.id as id, b.id as o, a.side, {0} as s, row_number() over (partition by a.id order by {0}, b.id) as r from w a join w b on a.side = b.side and a.id <> b.id)".format(L2)


@query("graph_union", V.with_views(f", {TWO} select 'side_' || side as class, id, o as neighbour, round(s, 5) as score from x where r <= 3", **VV))
def graph_union(spark, sf_dir):
    """The neighbour graphs of two slices, one below the other."""
    from ..operators.cells import tag_union

    v = V.vecs(spark, sf_dir)
    graph = lambda t: N.knn(v.where(F.col("id") % 2 == t), k=3).select("id", "neighbour", R("score", 5).alias("score"))
    return tag_union(side_0=graph(0), side_1=graph(1))


@query("davies_bouldin", V.with_views(", u as (select id, label, unnest(vec) as x, generate_subscripts(vec, 1) as k from v), c as (select label, k, avg(x) as c from u group by all), o as (select u.id, u.label, sqrt(sum((x - c) ** 2)) as d from u join c using (label, k) group by all), s as (select label, avg(d) as s from o group by 1), g as (select a.label as a, b.label as b, sqrt(sum((a.c - b.c) ** 2)) as g from c a join c b on a.k = b.k and a.label <> b.label group by all), r as (select g.a, max((p.s + q.s) / g.g) as r from g join s p on p.label = g.a join s q on q.label = g.b group by 1) select round(avg(r), 6) as davies_bouldin from r", **VV))
def davies_bouldin(spark, sf_dir):
    from ..operators.mapper import separation

    return separation(V.vecs(spark, sf_dir)).select(R("davies_bouldin").alias("davies_bouldin"))


@query("mutual_links", V.with_views(f", x as (select * from v where id % 2 = 0), y as (select * from v where id % 2 = 1), d as (select a.id as id_x, b.id as id_y, {L2} as distance from x a join y b on true), r as (select *, row_number() over (partition by id_x order by distance, id_y) p, row_number() over (partition by id_y order by distance, id_x) q from d) select id_x, id_y, round(distance, 5) as distance from r where p <= 5 and q <= 5", **VV))
def mutual_links(spark, sf_dir):
    v = V.vecs(spark, sf_dir)
    return N.mutual_links(v.where("id % 2 = 0"), v.where("id % 2 = 1")).withColumn("distance", R("distance", 5))
