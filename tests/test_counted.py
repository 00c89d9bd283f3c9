"""What is held of all cells is found without shuffling cells, in a bounded number of tasks and of blocks."""

from pyspark.ml.recommendation import ALS
from pyspark.sql import functions as F

from recbench.operators import factor, knn
from recbench.queries import grid


def test_different_cells_are_counted(spark, monkeypatch):
    monkeypatch.setattr(grid, "SPAN", 16, raising=False)
    cells = spark.range(3000).selectExpr("id % 7 as user", "(id * 13) % 101 - 20 as item", "double(id % 5) as prediction")
    row = grid._counted(cells.repartition(5)).first()
    assert (row["cells"], row["distinct_cells"], row["least"], row["most"]) == (3000, cells.select("user", "item").distinct().count(), 0.0, 4.0)
    odd = grid._counted(cells.withColumn("prediction", F.when(F.col("user") == 3, F.lit(float("nan"))).otherwise(F.col("prediction"))))
    assert odd.select((F.col("most") <= 4).alias("inside")).first()["inside"] is False


def test_cells_are_not_shuffled_to_be_counted(spark):
    """300 users and 500 items: 0.15 million cells, of which a task sends on a row for each user in a batch."""
    cells = spark.range(300).withColumnRenamed("id", "user").crossJoin(spark.range(500).withColumnRenamed("id", "item")).withColumn("prediction", F.lit(1.0))
    assert grid._bitmaps(cells.coalesce(1)).count() < 5000


def test_tasks_of_all_cells_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELLS", 10)
    monkeypatch.setattr(knn, "TASKS", 12, raising=False)
    rated = spark.range(600).selectExpr("id % 200 as user", "id % 60 as item", "1D as rating")
    cells = knn.all_cells(rated)
    assert cells.rdd.getNumPartitions() <= 12 and cells.distinct().count() == 200 * 60


def test_blocks_of_als_grow_with_ratings(spark, monkeypatch):
    monkeypatch.setattr(factor, "RATINGS", 40, raising=False)
    asked, real = [], ALS
    monkeypatch.setattr(factor, "ALS", lambda **options: asked.append((options["numUserBlocks"], options["numItemBlocks"])) or real(**options))
    rated = spark.range(600).selectExpr("id % 20 as user", "id div 20 as item", "double(id % 5 + 1) as rating")
    assert factor.als(rated, iterations=1).count() == 600 and asked == [(15, 15)]
