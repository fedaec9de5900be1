"""Maps of several samples: draws counted inside tasks, errors from one reading."""

from pyspark.sql import functions as F

from graticule.operators.sampling import PoissonDraw, poisson_copies, sample_with_replacement
from graticule.plans.som import Codebook, train_soms
from graticule.plans.som_quality import qualities, quality


def test_draws_counted_in_tasks_are_those_of_the_column(spark):
    for fraction in (0.1, 1.0, 7.5, 40.0):
        draw = PoissonDraw(("id",), fraction, 7)
        found = spark.range(500).select(poisson_copies(["id"], fraction, 7).alias("n"), *[u.alias(f"u{i}") for i, u in enumerate(draw.draws().values())]).toPandas()
        assert (draw.copies([found[c].to_numpy() for c in found if c != "n"]) == found["n"]).all()


def test_errors_of_maps_from_one_reading(spark):
    rows = spark.range(800).select("id", F.array((F.col("id") % 29 / 29), (F.col("id") % 31 / 31)).alias("features"))
    fractions = [0.2, 1.0, 1e-9]
    books = train_soms(rows, [Codebook.random(spark, 3, 4, 2, 1)] * 3, 2, draws := [PoissonDraw(("id",), f, 7) for f in fractions], sigma_0=2.0, tau=2.0)
    found = qualities(rows, books, draws)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    for r in found.collect():
        own = quality(sample_with_replacement(rows, ["id"], fractions[r["map"]], 7), books[r["map"]]).first()
        for c in own.asDict():
            assert r[c] == own[c] or abs(r[c] - own[c]) < 1e-12
    assert found.count() == 3
