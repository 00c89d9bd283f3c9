"""What one task reads doesn't grow with the table: files of XML elements, partitions of vectors."""

from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from recbench.operators import content_based
from recbench.queries import files


def test_dump_has_more_files_for_more_elements(spark, monkeypatch):
    monkeypatch.setattr(files, "ELEMENTS", 10, raising=False)
    path = files._dump(spark.range(200), F.format_string("<page><id>%d</id></page>", "id"), "mediawiki")
    pages = spark.read.format("xml").option("rowTag", "page").schema("id long").load(path)
    assert pages.select(F.input_file_name()).distinct().count() > 10
    assert sorted(r["id"] for r in pages.collect()) == list(range(200))


def test_vectors_are_dealt_out_before_clustering(spark, monkeypatch):
    monkeypatch.setattr(content_based, "CLUSTERED", 10, raising=False)
    seen, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, rows: seen.append(rows.rdd.getNumPartitions()) or fit(self, rows))
    content = spark.range(0, 100, 1, 1).selectExpr("id as item", "array(double(id % 2), double(id)) as vector")
    assert content_based.cluster(content, 2).count() == 100 and seen == [10]
