"""Queries over the graph of the star-schema tables, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import candidates as cand
from quarry.operators import graph as g
from quarry.operators import kge, metrics, ontology, selection
from quarry.functions import text, vectors
from quarry.sources import star_kg

KEY = g.KEY
QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Where a query is registered with this, its queries are the test triples whose head id is a multiple of it; all others take every test triple.
SEARCHED = 20


def rotation(h: str, p: str, t: str, turn: str = "+") -> str:
    """The score of a triple as SQL, a term a component; turn '-' turns the other way."""
    back = "-" if turn == "+" else "+"
    terms = (f"sqrt(pow({h}[{k}] * {p}.co[{k}] {back} {h}[{k + 32}] * {p}.si[{k}] - {t}[{k}], 2) + pow({h}[{k + 32}] * {p}.co[{k}] {turn} {h}[{k}] * {p}.si[{k}] - {t}[{k + 32}], 2))" for k in range(1, 33))
    return f"(24.0 - ({' + '.join(terms)}))"


Q = "PARTITION BY head, relation, gold"
COS = ", rc AS (SELECT a.r, b.r AS relation, round(coalesce(CASE WHEN list_sum(list_transform(a.phase, lambda x: x * x)) * list_sum(list_transform(b.phase, lambda x: x * x)) > 0 THEN list_sum(list_transform(range(1, 33), lambda k: a.phase[k] * b.phase[k])) / (sqrt(list_sum(list_transform(a.phase, lambda x: x * x))) * sqrt(list_sum(list_transform(b.phase, lambda x: x * x)))) END, 0), 9) AS cosine FROM phase a, phase b)"
KNOWN = ", known AS (SELECT DISTINCT h AS head, r AS relation, t FROM tri)"


def qs_sql(every: int) -> str:
    return f", qs AS MATERIALIZED (SELECT h AS head, r AS relation, t AS gold FROM tri WHERE split = 'test' AND h % {every} = 0), edge AS (SELECT ord, h, r, t FROM tri WHERE split <> 'test')"


def test_queries(graph: star_kg.Graph, every: int = 1):
    """The test triples whose head id is a multiple of `every`, as queries; by default all of them."""
    t = graph.triples.where("split = 'test'")
    return (t if every == 1 else t.where(F.col("h") % every == 0)).select(F.col("h").alias("head"), F.col("r").alias("relation"), F.col("t").alias("gold"))


def z(c: str) -> str:
    return f"CASE WHEN stddev_pop({c}) OVER w < 1e-12 THEN 0.0 ELSE ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END"


HOP = ", hop AS (SELECT qs.*, e.* FROM qs JOIN edge e ON e.h = qs.head WHERE NOT (e.h = gold OR e.t = gold))"
ONE = (
    HOP
    + ", hs AS (SELECT hop.*, rc.cosine, " + rotation("eh.vec", "p", "et.vec") + " AS reliability FROM hop JOIN rc ON rc.r = hop.r AND rc.relation = hop.relation JOIN evec eh ON eh.id = hop.h JOIN evec et ON et.id = hop.t JOIN phase p ON p.r = hop.r)"
    + f", hz AS (SELECT *, {z('cosine')} AS zc, {z('reliability')} AS zr FROM hs WINDOW w AS ({Q}))"
    + f", one AS (SELECT *, zc + zr AS score, row_number() OVER ({Q} ORDER BY round(zc + zr, 9) DESC, ord, h, r, t) AS pos FROM hz QUALIFY pos <= 10)"
)
PATHS = (
    HOP
    + f", b1 AS (SELECT hop.*, row_number() OVER ({Q} ORDER BY cosine DESC, ord, hop.h, hop.r, hop.t) AS b FROM hop JOIN rc USING (r, relation) QUALIFY b <= 20)"
    + ", b2 AS (SELECT f.head, f.relation, f.gold, f.b AS c1, f.h AS h1, f.r AS r1, f.t AS t1, e.h AS h2, e.r AS r2, e.t AS t2, row_number() OVER (PARTITION BY f.head, f.relation, f.gold, f.b ORDER BY rc.cosine DESC, e.ord, e.h, e.r, e.t) AS c2"
    + " FROM (SELECT * FROM b1 WHERE t <> head) f JOIN edge e ON e.h = f.t JOIN rc ON rc.r = e.r AND rc.relation = f.relation WHERE NOT (e.h = gold OR e.t = gold) QUALIFY c2 <= 20)"
    + f", raw AS (SELECT *, row_number() OVER ({Q} ORDER BY c1, c2) AS seq FROM b2 WHERE t2 <> head AND t2 <> t1 QUALIFY seq <= 1000)"
    + ", ps AS (SELECT raw.*, -sqrt(" + " + ".join(f"pow(p1.phase[{k}] + p2.phase[{k}] - pq.phase[{k}], 2)" for k in range(1, 33)) + ") AS consistency, " + rotation("eh.vec", "pq", "et.vec") + " AS endpoint"
    + " FROM raw JOIN phase p1 ON p1.r = r1 JOIN phase p2 ON p2.r = r2 JOIN phase pq ON pq.r = relation JOIN evec eh ON eh.id = head JOIN evec et ON et.id = t2)"
    + f", pz AS (SELECT *, {z('consistency')} + {z('endpoint')} AS score FROM ps WINDOW w AS ({Q}))"
    + f", path AS (SELECT *, row_number() OVER ({Q} ORDER BY round(score, 9) DESC, c1, c2) AS pos FROM pz QUALIFY pos <= 10)"
)
ALL = ", alls AS MATERIALIZED (SELECT qs.*, e.id, round(" + rotation("h.vec", "p", "e.vec") + ", 9) AS score FROM qs JOIN evec h ON h.id = qs.head JOIN phase p ON p.r = qs.relation, evec e)"
HEADS = ", heads AS MATERIALIZED (SELECT qs.*, e.id, round(" + rotation("t.vec", "p", "e.vec", "-") + ", 9) AS score FROM qs JOIN evec t ON t.id = qs.gold JOIN phase p ON p.r = qs.relation, evec e)"
CAND = (
    ALL + KNOWN
    + f", neg AS (SELECT *, row_number() OVER ({Q} ORDER BY score DESC, id) AS k FROM alls a WHERE id <> head AND id <> gold AND NOT EXISTS (SELECT 1 FROM known z WHERE z.head = a.head AND z.relation = a.relation AND z.t = a.id) QUALIFY k <= 19)"
    + f", cand AS (SELECT *, row_number() OVER ({Q} ORDER BY score DESC, is_gold, id) AS pos FROM (SELECT head, relation, gold, id, score, false AS is_gold FROM neg UNION ALL SELECT head, relation, gold, id, score, true FROM alls WHERE id = gold))"
)


def query(name: str, sql: str | None = None, every: int | None = None, more: str = ""):
    """Registers a function of (graph) or, with `every`, of (graph, queries).

    Queries are the test triples whose head id is a multiple of `every`: all of them with 1.
    """

    def add(f):
        def run(spark, sf_dir):
            graph = star_kg.load(spark, sf_dir)
            return f(graph) if every is None else f(graph, test_queries(graph, every))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = "WITH " + star_kg.SQL + (qs_sql(every) if every is not None else "") + more + " " + sql
        return f

    return add


def r6(c):
    return F.round(c, 6) + F.lit(0.0)  # no negative zero


@query("kg_dataset_summary", "SELECT split, count(*) AS n, count(DISTINCT h) AS heads, count(DISTINCT r) AS relations, count(DISTINCT t) AS tails FROM tri GROUP BY split")
def _(graph):
    return graph.triples.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("h").alias("heads"), F.countDistinct("r").alias("relations"), F.countDistinct("t").alias("tails"))


@query("kg_triples_labelled", "SELECT h, tri.r::BIGINT AS r, t, a.label || ' --[' || r_label || ']--> ' || b.label AS text, a.classes[1] AS h_class, b.classes[1] AS t_class FROM tri JOIN ent a ON a.id = h JOIN ent b ON b.id = t JOIN rel ON rel.r = tri.r")
def _(graph):
    e = graph.entities
    x = g.one_hop_text(graph.triples, graph)
    x = x.join(e.select(F.col("id").alias("h"), F.get("classes", F.lit(0)).alias("h_class")), "h").join(e.select(F.col("id").alias("t"), F.get("classes", F.lit(0)).alias("t_class")), "t")
    return x.select("h", F.col("r").cast("long").alias("r"), "t", "text", "h_class", "t_class")


@query("kg_id_space", "SELECT (SELECT max(id) + 1 FROM ent) AS nentity, (SELECT max(r) + 1 FROM rel)::BIGINT AS nrelation")
def _(graph):
    return graph.entities.agg((F.max("id") + 1).alias("nentity")).join(graph.relations.agg((F.max("r") + 1).cast("long").alias("nrelation")))


@query("kg_all_true", "SELECT r::BIGINT AS r, count(*) AS n FROM (SELECT DISTINCT h, r, t FROM tri) GROUP BY r")
def _(graph):
    t = graph.triples
    every = t.where("split = 'train'").unionAll(t.where("split = 'valid'")).unionAll(t.where("split = 'test'"))
    return every.dropDuplicates(["h", "r", "t"]).groupBy(F.col("r").cast("long").alias("r")).agg(F.count("*").alias("n"))


@query("kg_label_index", "SELECT label, max(id) AS id, count(*) AS n FROM ent GROUP BY label")
def _(graph):
    return graph.entities.groupBy("label").agg(F.max("id").alias("id"), F.count("*").alias("n"))


@query("kg_subsampling", "SELECT r::BIGINT AS r, count(*) AS n, round(avg(sqrt(1.0 / (hr + rt))), 9) AS mean_weight, max(hr + rt) AS most FROM (SELECT r, count(*) OVER (PARTITION BY h, r) + 4 AS hr, count(*) OVER (PARTITION BY r, t) + 4 AS rt FROM tri WHERE split = 'train') GROUP BY r")
def _(graph):
    w = kge.subsampling(graph.triples.where("split = 'train'").select("h", "r", "t"))
    return w.groupBy(F.col("r").cast("long").alias("r")).agg(F.count("*").alias("n"), F.round(F.avg("weight"), 9).alias("mean_weight"), F.max("freq").alias("most"))


@query("kg_true_sets", "SELECT h, r::BIGINT AS r, array_to_string(list_sort(list(DISTINCT t)), ',') AS tails FROM tri GROUP BY h, r")
def _(graph):
    return kge.true_sets(graph.triples)[1].select("h", F.col("r").cast("long").alias("r"), F.array_join(F.transform("tails", lambda x: x.cast("string")), ",").alias("tails"))


@query("kg_true_heads", "SELECT t, r::BIGINT AS r, count(DISTINCT h) AS n, min(h) AS first FROM tri GROUP BY t, r")
def _(graph):
    heads = kge.true_sets(graph.triples)[0]
    return heads.select("t", F.col("r").cast("long").alias("r"), F.size("heads").cast("long").alias("n"), F.element_at("heads", 1).alias("first"))


@query("kg_relation_patterns", "SELECT id, array_to_string(list_sort(list(DISTINCT p)), ', ') AS patterns FROM (SELECT h AS id, 'out:' || r_label AS p FROM tri JOIN rel USING (r) WHERE split <> 'test' UNION ALL SELECT t, 'in:' || r_label FROM tri JOIN rel USING (r) WHERE split <> 'test') GROUP BY id")
def _(graph):
    return cand.patterns(graph).select("id", text.pattern_text("patterns").alias("patterns"))


@query("kg_relation_cosine", "SELECT r::BIGINT AS r, relation::BIGINT AS relation, round(cosine, 6) + 0.0 AS cosine FROM rc", more=COS)
def _(graph):
    p = graph.relation_vectors
    # relations pair with every relation of the query set, here all of them: a table of fixed size
    pairs = p.select("r", F.explode(F.array(*(F.lit(x[0]) for x in star_kg.RELATIONS))).alias("relation"))
    return g.with_cosine(pairs, graph).select(F.col("r").cast("long").alias("r"), F.col("relation").cast("long").alias("relation"), r6("cosine").alias("cosine"))


@query("kg_rotate_scores", "SELECT h, tri.r::BIGINT AS r, t, round(" + rotation("a.vec", "p", "b.vec") + ", 6) AS score FROM tri JOIN evec a ON a.id = h JOIN evec b ON b.id = t JOIN phase p ON p.r = tri.r WHERE split = 'test'")
def _(graph):
    return g.with_score(graph.triples.where("split = 'test'"), graph, "h", "r", "t", "s").select("h", F.col("r").cast("long").alias("r"), "t", r6("s").alias("score"))


@query("kg_one_hop_evidence", "SELECT head, relation::BIGINT AS relation, gold, h, r::BIGINT AS r, t, round(cosine, 6) + 0.0 AS cosine, round(reliability, 6) AS reliability, round(score, 6) + 0.0 AS score, pos FROM one", every=1, more=COS + ONE)
def _(graph, qs):
    x = g.one_hop(graph, qs)
    return x.select("head", F.col("relation").cast("long").alias("relation"), "gold", "h", F.col("r").cast("long").alias("r"), "t", r6("cosine").alias("cosine"), r6("reliability").alias("reliability"), r6("score").alias("score"), F.col("pos").cast("long").alias("pos"))


def _evidence(graph, qs):
    """Both kinds of evidence of the searched queries, at most ten rows a query each; read several times, made once."""
    one, path = g.one_hop(graph, qs), g.paths(graph, qs)
    return star_kg.keep(one.select(*KEY, "h", "r", "t", "score", "pos")), star_kg.keep(path.select(*KEY, "steps", "branches", "terminal", "score", "pos"))


def _judged(graph, qs):
    """Both kinds, re-weighted: what texts and choices need of them."""
    judges = ontology.judge(graph)
    one, path = ontology.judged_one_hop(graph, qs, judges), ontology.judged_paths(graph, qs, judges)
    return one.select(*KEY, "h", "r", "t", "filtered", "pos"), path.select(*KEY, "steps", "branches", "terminal", "filtered", "pos")


PATH_OUT = "head, relation::BIGINT AS relation, gold, t2 AS terminal, h1 || '>' || r1 || '>' || t1 || '>' || r2 || '>' || t2 AS path, round(consistency, 6) + 0.0 AS consistency, round(endpoint, 6) + 0.0 AS endpoint, round(score, 6) + 0.0 AS score, pos"


def _path(steps):
    s = lambda k, c: F.get(F.col(steps), k)[c].cast("string")
    return F.concat_ws(">", s(0, "h"), s(0, "r"), s(0, "t"), s(1, "r"), s(1, "t"))


@query("kg_path_evidence", f"SELECT {PATH_OUT} FROM path", every=SEARCHED, more=COS + PATHS)
def _(graph, qs):
    x = g.paths(graph, qs)
    return x.select("head", F.col("relation").cast("long").alias("relation"), "gold", "terminal", _path("steps").alias("path"), r6("consistency").alias("consistency"), r6("endpoint").alias("endpoint"), r6("score").alias("score"), F.col("pos").cast("long").alias("pos"))


@query("kg_raw_paths", "SELECT head, relation::BIGINT AS relation, gold, count(*) AS n, min(t2) AS first, sum(seq * (t2 % 1000)) AS mix FROM raw GROUP BY ALL", every=SEARCHED, more=COS + PATHS.split(", ps AS")[0])
def _(graph, qs):
    x = g.raw_paths(graph, qs)
    from pyspark.sql import Window

    x = x.withColumn("seq", F.row_number().over(Window.partitionBy(*KEY).orderBy("branches")))
    return x.groupBy("head", F.col("relation").cast("long").alias("relation"), "gold").agg(F.count("*").alias("n"), F.min("terminal").alias("first"), F.sum(F.col("seq") * (F.col("terminal") % 1000)).cast("decimal(38,0)").alias("mix")).withColumn("mix", F.col("mix").cast("long"))


ORACLES["kg_raw_paths"] = ORACLES["kg_raw_paths"].replace("sum(seq * (t2 % 1000)) AS mix", "sum(seq * (t2 % 1000))::BIGINT AS mix")


@query("kg_path_texts", "SELECT head, relation::BIGINT AS relation, gold, pos, a.label || ' --[' || x.r_label || ']--> ' || b.label || ' --[' || y.r_label || ']--> ' || c.label AS text FROM path JOIN ent a ON a.id = h1 JOIN ent b ON b.id = t1 JOIN ent c ON c.id = t2 JOIN rel x ON x.r = r1 JOIN rel y ON y.r = r2", every=SEARCHED, more=COS + PATHS)
def _(graph, qs):
    return g.path_texts(g.paths(graph, qs).select(*KEY, "steps", "branches", "pos"), graph).select("head", F.col("relation").cast("long").alias("relation"), "gold", F.col("pos").cast("long").alias("pos"), "text")


GOLD = (
    ", und AS (SELECT h AS node, t AS near, r AS rr, 0 AS back, ord, h, r, t FROM tri UNION ALL SELECT t, h, r, 1, ord, h, r, t FROM tri)"
    + f", gp AS (SELECT q.*, a.near AS mid, a.rr AS r1, a.back AS b1, b.rr AS r2, 1 - b.back AS b2, row_number() OVER (PARTITION BY q.head, q.relation, q.gold ORDER BY a.ord, a.h, a.r, a.t, a.back, b.ord, b.h, b.r, b.t, 1 - b.back) AS k"
    + " FROM qs q JOIN und a ON a.node = q.head JOIN und b ON b.node = q.gold AND b.near = a.near WHERE a.near <> q.head AND a.near <> q.gold AND q.head <> q.gold QUALIFY k = 1)"
)


@query("kg_gold_paths", "SELECT head, relation::BIGINT AS relation, gold, mid, r1::BIGINT AS r1, b1 = 0 AS f1, r2::BIGINT AS r2, b2 = 0 AS f2 FROM gp", every=1, more=GOLD)
def _(graph, qs):
    x = g.gold_paths(graph, qs)
    return x.select("head", F.col("relation").cast("long").alias("relation"), "gold", "mid", F.col("r1").cast("long").alias("r1"), "f1", F.col("r2").cast("long").alias("r2"), "f2")


ETA = (
    ", pe AS (SELECT e.id, rel.r AS rid, unnest(e.classes) AS c, unnest(range(len(e.classes))) AS i, rel.rng FROM ent e, rel)"
    + ", pj AS (SELECT id, rid, i, CASE WHEN c = rng THEN 1.0 ELSE coalesce(j.score, 0.8) END AS eta, CASE WHEN c = rng THEN 'subclass_or_same' ELSE coalesce(j.relation, 'no_llm_fallback') END AS why FROM pe LEFT JOIN judged j ON j.entity_class = c AND j.range_class = rng)"
    + ", eta AS (SELECT id, rid, eta, why FROM pj QUALIFY row_number() OVER (PARTITION BY id, rid ORDER BY eta DESC, i) = 1)"
)


@query("kg_compatibility", "SELECT id, rid::BIGINT AS r, round(eta, 6) AS eta, why AS eta_relation FROM eta", more=ETA)
def _(graph):
    items = graph.entities.select("id", "classes", F.explode(F.array(*(F.struct(F.lit(r).cast("long").alias("r"), F.array(F.lit(rng)).alias("ranges")) for r, _, _, rng in star_kg.RELATIONS))).alias("x")).select("id", "classes", "x.*")
    return ontology.compatibility(items, graph.judgements, ["id", "r"]).select("id", "r", r6("eta").alias("eta"), "eta_relation")


@query("kg_ontology_one_hop", f"SELECT head, relation::BIGINT AS relation, gold, h, r::BIGINT AS r, t, round(score * e.eta, 6) + 0.0 AS filtered, e.eta, why AS eta_relation, row_number() OVER ({Q} ORDER BY round(score * e.eta, 9) DESC, pos) AS pos FROM one JOIN eta e ON e.id = one.t AND e.rid = one.relation", every=1, more=COS + ONE + ETA)
def _(graph, qs):
    x = ontology.judged_one_hop(graph, qs)
    return x.select("head", F.col("relation").cast("long").alias("relation"), "gold", "h", F.col("r").cast("long").alias("r"), "t", r6("filtered").alias("filtered"), "eta", "eta_relation", F.col("pos").cast("long").alias("pos"))


@query(
    "kg_query_classes",
    "SELECT head, relation::BIGINT AS relation, gold, string_agg(c, '|' ORDER BY first) AS classes FROM (SELECT head, relation, gold, c, min(place) AS first FROM"
    " (SELECT head, relation, gold, unnest(classes) AS c, place * 10 + unnest(range(len(classes))) AS place FROM (SELECT head, relation, gold, t AS id, pos * 10 AS place FROM one"
    " UNION ALL SELECT head, relation, gold, t1, 1000 + pos * 10 FROM path UNION ALL SELECT head, relation, gold, t2, 1001 + pos * 10 FROM path) JOIN ent USING (id)) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3",
    every=1, more=COS + ONE + PATHS[len(HOP):],
)
def _(graph, qs):
    x = ontology.query_classes(g.one_hop(graph, qs), g.paths(graph, qs), graph)  # each is read once
    return x.select("head", F.col("relation").cast("long").alias("relation"), "gold", F.array_join("classes", "|").alias("classes"))


@query("kg_ontology_paths", f"SELECT head, relation::BIGINT AS relation, gold, t2 AS terminal, round(a.eta * b.eta, 6) AS eta, round(score * a.eta * b.eta, 6) + 0.0 AS filtered, row_number() OVER ({Q} ORDER BY round(score * (a.eta * b.eta), 9) DESC, pos) AS pos FROM path JOIN eta a ON a.id = t1 AND a.rid = r1 JOIN eta b ON b.id = t2 AND b.rid = r2", every=SEARCHED, more=COS + PATHS + ETA)
def _(graph, qs):
    x = ontology.judged_paths(graph, qs)
    return x.select("head", F.col("relation").cast("long").alias("relation"), "gold", "terminal", r6("eta").alias("eta"), r6("filtered").alias("filtered"), F.col("pos").cast("long").alias("pos"))


@query("kg_ontology_fast", f"SELECT head, relation::BIGINT AS relation, gold, h, r::BIGINT AS r, t, round(score * e.eta, 6) + 0.0 AS filtered, e.eta, why AS eta_relation, row_number() OVER ({Q} ORDER BY round(score * e.eta, 9) DESC, pos) AS pos FROM one JOIN eta e ON e.id = one.t AND e.rid = one.relation", every=SEARCHED, more=COS + ONE + ETA)
def _(graph, qs):
    judges = ontology.judge(graph, fast=True)
    if judges:
        x = ontology.judged_one_hop(graph, qs, judges)
    else:
        one, path = _evidence(graph, qs)
        x = ontology.reweight_one_hop(one, graph, fast=ontology.fast_etas(one, path, graph))
    return x.select("head", F.col("relation").cast("long").alias("relation"), "gold", "h", F.col("r").cast("long").alias("r"), "t", r6("filtered").alias("filtered"), "eta", "eta_relation", F.col("pos").cast("long").alias("pos"))


# all steps are judged against the query's range, not their own
@query("kg_ontology_fast_paths", f"SELECT head, relation::BIGINT AS relation, gold, t2 AS terminal, round(ea * b.eta, 6) AS eta, round(score * ea * b.eta, 6) + 0.0 AS filtered, row_number() OVER ({Q} ORDER BY round(score * (ea * b.eta), 9) DESC, pos) AS pos FROM half JOIN eta b ON b.id = t2 AND b.rid = relation", every=SEARCHED, more=COS + PATHS + ETA + ", half AS MATERIALIZED (SELECT path.*, a.eta AS ea FROM path JOIN eta a ON a.id = t1 AND a.rid = relation)")
def _(graph, qs):
    judges = ontology.judge(graph, fast=True) if graph.code is not None else None
    if judges:
        x = ontology.judged_paths(graph, qs, judges)
    else:
        one, path = _evidence(graph, qs)
        x = ontology.reweight_paths(path, graph, fast=ontology.fast_etas(one, path, graph))
    return x.select("head", F.col("relation").cast("long").alias("relation"), "gold", "terminal", r6("eta").alias("eta"), r6("filtered").alias("filtered"), F.col("pos").cast("long").alias("pos"))


PAIRS = ", need AS (SELECT DISTINCT c AS entity_class, rng AS range_class FROM (SELECT unnest(classes) AS c, rng FROM tri JOIN ent ON ent.id = t JOIN rel ON rel.r = tri.r WHERE split = 'test') WHERE c <> rng)"


def _tail_items(graph):
    t = graph.triples.where("split = 'test'").select("r", F.col("t").alias("id")).distinct()
    return t.join(graph.entities, "id").join(graph.relations.select("r", F.array("range").alias("ranges")), "r")


@query("kg_required_pairs", "SELECT * FROM need", more=PAIRS)
def _(graph):
    return ontology.required_pairs(_tail_items(graph))


@query("kg_unjudged_pairs", "SELECT n.* FROM need n WHERE NOT EXISTS (SELECT 1 FROM judged j WHERE j.entity_class = n.entity_class AND j.range_class = n.range_class)", more=PAIRS)
def _(graph):
    return ontology.unjudged(ontology.required_pairs(_tail_items(graph)), graph.judgements)


@query("kg_filter_statistics", "SELECT count(*) FILTER (c = rng) AS direct_matches, count(*) FILTER (c <> rng AND j.score IS NOT NULL) AS cache_hits, count(*) FILTER (c <> rng AND j.score IS NULL) AS fallbacks FROM (SELECT DISTINCT unnest(classes) AS c, rng FROM tri JOIN ent ON ent.id = t JOIN rel ON rel.r = tri.r WHERE split = 'test') LEFT JOIN judged j ON j.entity_class = c AND j.range_class = rng")
def _(graph):
    pairs = _tail_items(graph).select(F.explode("classes").alias("entity_class"), "ranges").select("entity_class", F.explode("ranges").alias("range_class")).distinct()
    return ontology.filter_statistics(pairs, graph.judgements)


@query("kg_tail_ranking", f"SELECT head, relation::BIGINT AS relation, gold, id, round(score, 6) AS score, row_number() OVER ({Q} ORDER BY score DESC, id) AS pos FROM alls QUALIFY pos <= 10", every=1, more=ALL)
def _(graph, qs):
    return cand.tails(graph, qs).select("head", F.col("relation").cast("long").alias("relation"), "gold", "id", r6("score").alias("score"), F.col("pos").cast("long").alias("pos"))


@query("kg_candidates", "SELECT head, relation::BIGINT AS relation, gold, c.id, round(score, 6) AS score, is_gold, pos, classes[1] AS primary_class FROM cand c JOIN ent ON ent.id = c.id", every=SEARCHED, more=CAND)
def _(graph, qs):
    c = cand.candidate_set(graph, qs)
    return c.select("head", F.col("relation").cast("long").alias("relation"), "gold", "id", r6("score").alias("score"), "is_gold", F.col("pos").cast("long").alias("pos"), "primary_class")


@query("kg_candidate_check", "SELECT head, relation::BIGINT AS relation, gold, count(*) AS size, count(*) FILTER (is_gold) AS golds, count(*) FILTER (NOT is_gold AND EXISTS (SELECT 1 FROM known k WHERE k.head = c.head AND k.relation = c.relation AND k.t = c.id)) AS leaked FROM cand c GROUP BY 1, 2, 3", every=1, more=CAND)
def _(graph, qs):
    return cand.check(cand.candidate_set(graph, qs, classes=False), graph, qs).withColumn("relation", F.col("relation").cast("long"))


@query("kg_shared_patterns", "SELECT c.head, c.relation::BIGINT AS relation, c.gold, c.id, coalesce(array_to_string(list_sort(list(DISTINCT b.p) FILTER (b.p IS NOT NULL)), ', '), '') AS shared FROM cand c LEFT JOIN pat a ON a.id = c.id LEFT JOIN pat b ON b.id = c.head AND b.p = a.p GROUP BY 1, 2, 3, 4", every=1, more=CAND + ", pat AS (SELECT DISTINCT id, p FROM (SELECT h AS id, 'out:' || r_label AS p FROM tri JOIN rel USING (r) WHERE split <> 'test' UNION ALL SELECT t, 'in:' || r_label FROM tri JOIN rel USING (r) WHERE split <> 'test'))")
def _(graph, qs):
    return cand.shared_patterns(cand.candidate_set(graph, qs, classes=False), graph).select("head", F.col("relation").cast("long").alias("relation"), "gold", "id", F.array_join("shared", ", ").alias("shared"))


@query("kg_concentration", "SELECT head, relation::BIGINT AS relation, gold, c AS max_class, n AS max_count, total::BIGINT AS size, greatest(1, floor(total * 0.5))::BIGINT AS threshold_count, n >= greatest(1, floor(total * 0.5)) AS concentrated FROM (SELECT head, relation, gold, classes[1] AS c, count(*) AS n, min(pos) AS first, sum(count(*)) OVER (PARTITION BY head, relation, gold) AS total FROM cand JOIN ent USING (id) GROUP BY 1, 2, 3, 4) QUALIFY row_number() OVER (PARTITION BY head, relation, gold ORDER BY n DESC, first) = 1", every=SEARCHED, more=CAND)
def _(graph, qs):
    x = selection.concentration(cand.candidate_set(graph, qs))
    return x.select("head", F.col("relation").cast("long").alias("relation"), "gold", "max_class", "max_count", F.col("size").cast("long").alias("size"), "threshold_count", "concentrated")


@query("kg_gold_augmentation", "SELECT q.head, q.relation::BIGINT AS relation, q.gold, CASE WHEN NOT k.on THEN 'candidate_set_not_type_concentrated' WHEN mid IS NULL THEN 'two_hop_indirect_gold_path_not_found' ELSE 'two_hop_indirect_gold_path_added' END AS reason, k.on AND mid IS NOT NULL AS added FROM qs q LEFT JOIN gp USING (head, relation, gold) LEFT JOIN (SELECT head, relation, gold, max(n) >= greatest(1, floor(sum(n) * 0.5)) AS on FROM (SELECT head, relation, gold, classes[1] AS c, count(*) AS n FROM cand JOIN ent USING (id) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3) k USING (head, relation, gold)", every=1, more=CAND + GOLD)
def _(graph, qs):
    x = selection.gold_augmentation(qs, cand.candidate_set(graph, qs), graph, enabled=True)
    return x.select("head", F.col("relation").cast("long").alias("relation"), "gold", "reason", "added")


ORACLES["kg_gold_augmentation"] = ORACLES["kg_gold_augmentation"].replace("k.on", "k.is_on").replace(" AS on ", " AS is_on ")

def _ranks(scores: str, answer: str, way: str, other: str) -> str:
    """Ranks of one direction: entities that are another known answer are left out."""
    return f"SELECT g.head, g.relation, g.gold, '{way}' AS direction, 1 + count(*) FILTER (a.score > g.score) AS rank, count(*) FILTER (a.score = g.score) - 1 AS ties FROM {scores} g JOIN {scores} a USING (head, relation, gold) WHERE g.id = g.{answer} AND (a.id = a.{answer} OR NOT EXISTS (SELECT 1 FROM known z WHERE {other})) GROUP BY 1, 2, 3"


RANKS = (
    ALL + HEADS + KNOWN
    + ", ranks AS (" + _ranks("alls", "gold", "tail", "z.head = a.head AND z.relation = a.relation AND z.t = a.id")
    + " UNION ALL " + _ranks("heads", "head", "head", "z.head = a.id AND z.relation = a.relation AND z.t = a.gold") + ")"
)


@query("kg_filtered_ranks", "SELECT head, relation::BIGINT AS relation, gold, direction, rank, ties FROM ranks", every=1, more=RANKS)
def _(graph, qs):
    return metrics.both_ranks(graph, qs).withColumn("relation", F.col("relation").cast("long"))


@query("kg_full_ranking", "SELECT round(avg(1.0 / rank), 9) AS mrr, round(avg(rank), 6) AS mr, avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END) AS hits1, avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END) AS hits3, avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END) AS hits10 FROM ranks", every=SEARCHED, more=RANKS)
def _(graph, qs):
    m = metrics.full_ranking(metrics.both_ranks(graph, qs))
    return m.select(F.round("mrr", 9).alias("mrr"), r6("mr").alias("mr"), *(F.col(c).cast("double").alias(c) for c in ("hits1", "hits3", "hits10")))


@query("kg_default_baseline", "SELECT count(*) AS total, round(avg(CASE WHEN pos <= 10 THEN 1.0 / pos ELSE 0 END), 9) AS mrr_at_k, round(avg(CASE WHEN pos <= 1 THEN 1.0 ELSE 0.0 END), 9) AS hits1, round(avg(CASE WHEN pos <= 10 THEN 1.0 ELSE 0.0 END), 9) AS hits10, count(*) AS failed_count FROM cand WHERE is_gold", every=SEARCHED, more=CAND)
def _(graph, qs):
    c = cand.candidate_set(graph, qs, classes=False)
    listed = c.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "id"))).alias("c")).withColumn("ids", F.slice(F.transform("c", lambda x: x["id"]), 1, 10))
    m = metrics.means(listed.select(metrics.rank_in("ids", "gold").alias("rank"), F.lit("default_candidate_order_only").alias("status")))
    return m.select("total", F.round("mrr_at_k", 9).alias("mrr_at_k"), F.round("hits1", 9).alias("hits1"), F.round("hits10", 9).alias("hits10"), "failed_count")


@query("kg_random_candidates", every=SEARCHED)
def _(graph, qs):
    return cand.checked(cand.random_candidates(graph, qs), graph)


@query("kg_compressed_evidence", every=SEARCHED)
def _(graph, qs):
    a, b = _judged(graph, qs)
    return selection.compress(selection.merged(a, star_kg.keep(b), graph)).drop("chosen")


@query("kg_source_statistics", every=1)
def _(graph, qs):
    a, b = map(star_kg.keep, _judged(graph, qs))
    return selection.source_statistics(qs, a, b, selection.folded(selection.merged(a, b, graph))).withColumn("relation", F.col("relation").cast("long"))


def flagship(spark, sf_dir):
    """Filtered candidate sets of the searched test triples."""
    graph = star_kg.load(spark, sf_dir)
    return cand.candidate_set(graph, test_queries(graph, SEARCHED))
