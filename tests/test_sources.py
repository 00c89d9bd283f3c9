"""Readers, text functions and code parsing on small literals; the experiment grid end to end."""

import pytest
from pyspark.sql import functions as F

from recbench.functions import text
from recbench.operators import code, geo
from recbench.operators import interactions as I
from recbench.plans.experiment import Experiment, consolidate, likert
from recbench.sources import readers, store


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("o")).first()["o"]


def put(tmp_path, name, content, encoding="utf-8"):
    path = tmp_path / name
    path.write_text(content, encoding=encoding)
    return str(path)


def test_movies(spark, tmp_path):
    m = put(tmp_path, "m.csv", 'movieId,title,genres\n1,Toy Story (1995),Adventure|Children\n2,"Odd, One",(no genres listed)\n')
    links = put(tmp_path, "l.csv", "movieId,imdbId,tmdbId\n1,0114709,862\n")
    a, b = readers.movies(spark, m, links).orderBy("movie_id").collect()
    assert (a["title"], a["year"], a["genre_adventure"], a["genre_childrens"], a["genre_none"], a["imdb_id"], a["tmdb_id"]) == ("Toy Story", 1995, True, True, False, 114709, 862)
    assert (b["title"], b["year"], b["genre_none"], b["imdb_id"]) == ("Odd, One", None, True, None)
    r = put(tmp_path, "r.dat", "1::2::4.5::99\n")
    assert readers.movie_ratings(spark, r, "10m").first() == (1, 2, 4.5, 99)
    t = put(tmp_path, "t.csv", 'userId,movieId,tag,timestamp\n1,2,"a, b",3\n')
    assert readers.movie_tags(spark, t).first() == (1, 2, "a, b", 3)


def test_books(spark, tmp_path):
    r = put(tmp_path, "r.csv", '"User-ID";"ISBN";"Book-Rating"\n"1";"x";"0"\n"1";"y";"7"\n"9";"x";"5"\n')
    b = put(tmp_path, "b.csv", '"ISBN";"t";"a";"y";"p";"s";"m";"l"\n"x";"Café \\"q\\"";"A";"1999";"P";"";"";""\n"y";"T";"A";"n/a";"P";"";"";""\n', "iso-8859-1")
    u = put(tmp_path, "u.csv", '"User-ID";"Location";"Age"\n"1";"here";"NULL"\n"2";"there";"30"\n')
    ratings, books, users = readers.book_ratings(spark, r), readers.books(spark, b), readers.book_users(spark, u)
    assert books.filter("book_id = 'x'").first()["title"] == 'Café "q"'
    assert books.filter("book_id = 'y'").first()["year"] is None
    implicit, explicit, kept = readers.book_cleanup(ratings, books, users)
    assert [x["book_id"] for x in implicit.collect()] == ["x"] and [x["book_id"] for x in explicit.collect()] == ["y"]
    assert [x["user_id"] for x in kept.collect()] == [1]
    assert I.books(ratings, "positive_interact").count() == 2
    with pytest.raises(ValueError):
        I.books(ratings, "none such")


def test_jokes(spark, tmp_path):
    j = put(tmp_path, "j.txt", "1:\n<p>A &amp; b</p>\n\n2:\n<p>last</p>\n")
    assert [tuple(r) for r in readers.jokes(spark, j).orderBy("joke_id").collect()] == [(1, "A & b"), (2, "last")]
    w = put(tmp_path, "w.csv", "2,99,1.5\n1,0,-3\n")
    assert sorted(tuple(r) for r in readers.joke_table(spark, w).collect()) == [(1, 2, 1.5), (2, 2, -3.0)]


def test_music(spark, tmp_path):
    p = put(tmp_path, "p.dat", "userID\tartistID\tweight\n1\t2\t30\n")
    assert readers.artist_plays(spark, p).first() == (1, 2, 30)
    t = put(tmp_path, "t.dat", "tagID\ttagValue\n1\tcafé\n", "iso-8859-1")
    assert readers.artist_tag_names(spark, t).first() == (1, "café")
    assert readers.artists(spark, put(tmp_path, "a.dat", "id\tname\turl\tp\n1\tX\tu\tv\n")).first() == (1, "X")
    assert readers.applied_tags(spark, put(tmp_path, "g.dat", "u\ta\tt\td\tm\ty\n1\t2\t3\t1\t4\t2009\n")).first() == (1, 2, 3, 1, 4, 2009)
    assert readers.friends(spark, put(tmp_path, "f.dat", "u\tf\n1\t2\n")).first() == (1, 2)


def test_wiki_dump(spark, tmp_path):
    x = put(tmp_path, "w.xml", """<mediawiki><page><title>A</title><ns>0</ns><id>7</id><revision><id>1</id><timestamp>2015-01-01T00:00:09Z</timestamp><contributor><username>u</username><id>5</id></contributor><minor/><text>t</text></revision>
<revision><id>2</id><timestamp>2015-01-02T00:00:00Z</timestamp><contributor><ip>1.2.3.4</ip></contributor><text>s</text></revision></page></mediawiki>""")
    rows = readers.wiki_revisions(spark, x, full_text=True)
    a, b = rows.orderBy("revision_id").collect()
    assert (a["article_id"], a["user_id"], a["minor"], a["full_text"]) == (7, 5, True, "t")
    assert (b["user_id"], b["minor"]) == (None, False)
    assert readers.latest_revisions(rows).first()["revision_id"] == 2
    assert I.wiki(rows, "num_edits").collect() == [(5, 7, 1.0)]
    assert I.temporal_split(rows)[1].count() == 1


def test_map_dump(spark, tmp_path):
    x = put(tmp_path, "o.osm", """<osm><node id="1" lat="1.5" lon="2" version="1" uid="9" timestamp="t"><tag k="addr:city" v="C"/></node><way id="2" uid="9" timestamp="t"><nd ref="1"/></way>
<relation id="3" timestamp="t"><member type="way" ref="2" role=""/></relation><changeset id="4" user="u" num_changes="2"/></osm>""")
    rows = readers.osm_objects(spark, x, ["addr:city"]).orderBy("id").collect()
    assert [(r["id"], r["osm_type"], r["addr_city"]) for r in rows] == [("1", "node", "C"), ("2", "way", None), ("3", "relation", None)]
    assert sorted(tuple(r) for r in readers.osm_members(spark, x).collect()) == [("2", "1", "way", "node"), ("3", "2", "relation", "way")]
    assert readers.osm_changesets(spark, x).first()["num_changes"] == "2"


def test_git(spark, tmp_path):
    log = put(tmp_path, "log.txt", "@@Ann\t<a@x>\n\nf.py\ng.py\n@@Bob\t<b@x>\n\nf.py\n@@Ann\t<a@x>\n\nf.py\n")
    rows = {tuple(r) for r in readers.git_log(readers.numbered_lines(spark, log)).collect()}
    assert rows == {("Ann", "a@x", "f.py", 2), ("Ann", "a@x", "g.py", 1), ("Bob", "b@x", "f.py", 1)}
    blame = put(tmp_path, "blame.txt", "abc 1 3 1\nauthor Ann\nauthor-mail <a@x>\nauthor-time 5\nauthor-tz +0100\ncommitter Bob\ncommitter-mail <b@x>\ncommitter-time 6\ncommitter-tz -0200\nsummary s\nfilename f.py\n\tx = 1\n")
    r = readers.git_blame(readers.numbered_lines(spark, blame)).first()
    assert (r["commit_id"], r["author_mail"], r["author_timezone"], r["committer_timezone"], r["line_num"], r["line"]) == ("abc", "a@x", 100, -200, 3, "x = 1")


def test_one_file_in_many_ranges(spark, tmp_path):
    """A log, a blame and jokes whose blocks lie across the borders of ranges of 64 bytes, read by many tasks."""
    log = "not yet\n" + "".join(f"@@Ann {i % 3}\t<a{i % 3}@x>\r\n\r\n" + "".join(f"f{k}.py\n" for k in range(i % 9)) for i in range(80))
    blame = "".join(f"c{i} 1 {i} 1\nauthor A{i}\nauthor-mail <a@x>\nauthor-time {i}\nauthor-tz +0100\ncommitter B\ncommitter-mail <b@x>\ncommitter-time 6\ncommitter-tz -0200\nsummary s\nfilename f.py\n\tx = {'y' * (i * 7 % 300)}\n" for i in range(60))
    jokes = "".join(f"{i}:\n<p>It is\nnumber {'<b>so</b> ' * (i % 20)}{i}</p>\n \t\n\n" for i in range(50))
    paths = [put(tmp_path, name, text) for name, text in (("log.txt", log), ("blame.txt", blame), ("jokes.txt", jokes))]

    def read():
        return [sorted(map(repr, df.drop("path").collect())) for df in (readers.git_log(readers.numbered_lines(spark, paths[0])), readers.git_blame(readers.numbered_lines(spark, paths[1])), readers.jokes(spark, paths[2]))]

    want = read()
    assert [len(x) for x in want] == [21, 60, 50] and "Ann 2" in want[0][-1]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "64")
        lines = readers.numbered_lines(spark, paths[1])
        assert lines.select("part").distinct().count() > 100 and lines.select(F.spark_partition_id()).distinct().count() > 100
        assert read() == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_vectors_edges_and_labels(spark, tmp_path):
    g = put(tmp_path, "g.txt", "the 0.5 -1\ncat 1 2\n")
    assert {r["word"]: r["vector"] for r in readers.word_vectors(spark, g).collect()} == {"the": [0.5, -1.0], "cat": [1.0, 2.0]}
    j = put(tmp_path, "g.json", '{"a": [1, 2.5]}')
    assert readers.word_vectors_json(spark, j).first() == ("a", [1.0, 2.5])
    t = put(tmp_path, "c.nt", "<http://x/Category:B> <http://y/core#broader> <http://x/Category:A> .\n<http://x/Q> <http://y/core#broader> <http://x/Category:A> .\n")
    assert readers.category_edges(spark, t).collect() == [("Category:A", "Category:B")]
    assert readers.labels(spark, put(tmp_path, "l.csv", "raw,label,axes,groups\nrmse,RMSE,TRUE,no\n")).first() == ("rmse", "RMSE", True, False)
    k = put(tmp_path, "k.csv", 'Id,a,AuthorUserId,v,s,TotalVotes,w,f,x,y,z\n1,,2,3,"a\nb",4,,5.0,,,\n')
    assert readers.kaggle_scripts(spark, k).first()["UrlSlug"] == "a\nb"


def test_text(spark):
    assert one(spark, "a{{b{{c}}d}}e}}f", text.remove_templates) == "ae"
    assert one(spark, "x{{a{{b}}}}y{{{z}}}w", text.remove_templates) == "xy}w"
    first = lambda v: one(spark, v, lambda c: text.remove_templates(c, compat=True))
    assert [first(v) for v in ("a{{b{{c}}d}}e}}f", "x{{a{{b}}}}y", "x{{a}}y{z}", "{{{z}}}w", None)] == ["ae}", "x", "xy{z}", "w", None]
    assert one(spark, "[[a|b]] and [[c]]", text.clean_links) == "b and c"
    assert one(spark, "[[Category:X|h]] y", text.clean_categories) == "X y"
    assert one(spark, "[[Category:A b]] [[Category:C|d]]", text.extract_categories) == ["Category:A b", "Category:C"]
    assert one(spark, " see httpfoo now ", text.remove_urls) == "see now"
    assert one(spark, "'Don't!'", text.stripped_words) == ["don't"]
    assert one(spark, "a.b.C", text.function_name) == "c"
    assert one(spark, "plain", text.notebook_code) == "plain"
    assert one(spark, '{"cells": [{"cell_type": "code", "source": ["a\\n", "b"]}, {"cell_type": "markdown", "source": "no"}, {"cell_type": "code", "source": "[1, 2]"}]}', text.notebook_code) == "a\nb\n[1, 2]"
    assert one(spark, '{"worksheets": [{"cells": [{"cell_type": "code", "input": ["x = 1"]}, {"cell_type": "code", "input": "y"}]}]}', text.notebook_code) == "x = 1\ny"
    assert one(spark, '{"other": 1}', text.notebook_code) == '{"other": 1}'
    assert one(spark, "<b>x</b><script>y</script> &lt;", text.strip_html) == "x <"


def test_code_is_parsed_never_run():
    source = "# coding: utf-8\nimport numpy as np\nfrom os import path as p\nnp.zeros(3)\np.join('a')\na.b().c()\n"
    assert code.names_used(source) == [(2, "numpy"), (3, "os.path"), (4, "numpy.zeros"), (5, "os.path.join"), (6, "a.b")]
    assert code.names_used("def (") == [] and code.names_used(None) == []
    assert code.docstrings('"""M."""\ndef f():\n    """F."""\n') == [("", "M."), ("f", "F.")]


def test_points_in_polygons(spark):
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    polygons = spark.createDataFrame([(0, square), (1, [(1.0, 1.0), (5.0, 1.0), (1.0, 5.0)])], "index int, polygon array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1.5, 1.5), (3.0, 1.5), (9.0, 9.0)], "lon double, lat double")
    got = {r["lon"]: (r["division"], r["division_vector"]) for r in geo.divisions(points, polygons).collect()}
    assert got == {1.5: (0, [1.0, 0.0]), 3.0: (1, [0.0, 1.0]), 9.0: (None, [0.0, 0.0])}


def test_experiment_grid(spark, tmp_path):
    rows = [(u, i, float((u * i) % 5 + 1)) for u in range(1, 7) for i in range(1, 9) if (u + i) % 3]
    ratings = spark.createDataFrame(rows, "user long, item long, rating double")
    content = spark.createDataFrame([(i, [float(i % 2), float(i % 3), 1.0]) for i in range(1, 9)], "item long, vector array<double>")
    split = lambda df: (df.filter((F.col("user") + F.col("item")) % 4 != 0), df.filter((F.col("user") + F.col("item")) % 4 == 0))
    grid = Experiment(spark, "tiny", {"ratings": ratings}, {"flags": content}, str(tmp_path / "x"), ["item_item", "bayes_mse"], ["cosine"], (3,), split=split)
    out = grid.run()
    assert out.count() == 3 and {r["CF_CB"] for r in out.collect()} == {"CF", "CB"}
    assert store.exists(spark, grid.path("uv_train", "ratings"))
    adjusted = likert(out)
    assert all(1 <= r["rmse_adj"] <= 5 for r in adjusted.collect() if r["rmse_adj"] is not None)
    consolidate(adjusted, str(tmp_path / "csv"))
    with pytest.raises(ValueError):
        Experiment(spark, "tiny", {}, {}, str(tmp_path), ["none such"])
