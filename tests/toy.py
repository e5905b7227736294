"""A small graph whose scores, paths and candidates were worked out by hand."""

from quarry.sources.star_kg import Graph

GAMMA, DIM = 24.0, 2
ENTITIES = [
    (0, "Ann", ["person"], [1.0, 0.0, 0.0, 1.0]), (1, "Bob", ["person"], [0.0, 1.0, 1.0, 0.0]), (2, "Paris", ["city"], [0.0, 0.0, 1.0, 1.0]),
    (3, "France", ["country"], [-1.0, 0.0, 0.0, 1.0]), (4, "Acme", ["company"], [0.5, 0.5, 0.5, 0.5]), (5, "Rome", ["city"], [1.0, 1.0, 0.0, 0.0]),
]
RELATIONS = [(0, "livesIn", "person", "city", [6.5, 0.0]), (1, "locatedIn", "city", "country", [0.0, 6.5]), (2, "worksFor", "person", "company", [6.5, 6.5]), (3, "basedIn", "company", "city", [-6.5, 0.0])]
TRAIN = [(0, 2, 4), (4, 3, 2), (2, 1, 3), (0, 0, 5), (5, 1, 3), (1, 0, 2), (1, 2, 4)]
TEST = [(0, 0, 2)]


def graph(spark) -> Graph:
    ent = spark.createDataFrame([(i, n, c) for i, n, c, _ in ENTITIES], "id long, label string, classes array<string>")
    rel = spark.createDataFrame([x[:4] for x in RELATIONS], "r int, r_label string, domain string, range string")
    # `ord` alone gives the order here: one value a triple
    rows = [("train", k, *x) for k, x in enumerate(TRAIN)] + [("test", 100 + k, *x) for k, x in enumerate(TEST)]
    tri = spark.createDataFrame(rows, "split string, ord int, h long, r int, t long")
    ev = spark.createDataFrame([(i, v) for i, _, _, v in ENTITIES], "id long, vec array<double>")
    rv = spark.createDataFrame([(x[0], x[4]) for x in RELATIONS], "r int, phase array<double>")
    return Graph(ent, rel, tri, ev, rv, spark.createDataFrame([], "entity_class string, range_class string, relation string, score double"), GAMMA, DIM)
