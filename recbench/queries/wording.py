"""Text functions and word vectors over the whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures as X
from ..functions import scalars, text
from ..operators import code, embeddings
from . import query
from .data import WORDS, _words
from .recommend import rounded


def _docs(spark, d):
    return X.table(spark, d, "documents").select("doc_id", "text", "lang", "source")


@query("s8_title_and_year", "select p_partkey, case when p_size % 2 = 0 then p_name else p_name || ' (' || (1950 + p_size) || ')' end as whole, p_name as title, case when p_size % 2 = 1 then 1950 + p_size end as year from part")
def s8_title_and_year(spark, d):
    rows = X.table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" ("), (1950 + F.col("p_size")).cast("string"), F.lit(")"))).alias("whole"))
    title, year = text.title_and_year(F.col("whole"))
    return rows.select("p_partkey", "whole", title.alias("title"), year.alias("year"))


@query("x15_remove_templates", "select doc_id, text from documents")
def x15_remove_templates(spark, d):
    marked = F.concat(F.lit("{{a|{{b}}c}}"), "text", F.lit("{{d}}"))
    return _docs(spark, d).select("doc_id", text.remove_templates(marked).alias("text"))


@query("x16_clean_categories", "select doc_id, lang || ' ' || text as text from documents")
def x16_clean_categories(spark, d):
    marked = F.concat(F.lit("[[Category:"), "lang", F.lit("|"), "source", F.lit("]] "), "text")
    return _docs(spark, d).select("doc_id", text.clean_categories(marked).alias("text"))


@query("x17_clean_links", "select doc_id, lang || ' ' || source || ' ' || text as text from documents")
def x17_clean_links(spark, d):
    marked = F.concat(F.lit("[["), "lang", F.lit("]] [[x|"), "source", F.lit("]] "), "text")
    return _docs(spark, d).select("doc_id", text.clean_links(marked).alias("text"))


@query("x18_x19_categories", "select doc_id, ['Category:' || lang || '_a', 'Category:' || source] as categories from documents")
def x18_x19_categories(spark, d):
    marked = F.concat(F.lit("[[Category:"), "lang", F.lit(" a|x]] "), "text", F.lit(" [[Category:"), "source", F.lit("]]"))
    return _docs(spark, d).select("doc_id", F.transform(text.extract_categories(marked), text.clean_name).alias("categories"))


@query("x20_drop_refs", "select doc_id, 'r' || replace(text, chr(10), ' ') as text from documents")
def x20_drop_refs(spark, d):
    return _docs(spark, d).select("doc_id", text.drop_refs(F.concat(F.lit("<ref>r</ref>"), "text")).alias("text"))


@query("x21_remove_punctuation", r"select doc_id, regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g') as text from documents")
def x21_remove_punctuation(spark, d):
    return _docs(spark, d).select("doc_id", text.remove_punctuation(F.col("text")).alias("text"))


@query("x22_remove_urls", r"select doc_id, array_to_string(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: not starts_with(w, 'http')), ' ') as text from documents")
def x22_remove_urls(spark, d):
    return _docs(spark, d).select("doc_id", text.remove_urls(F.concat(F.lit("http://x.y "), F.trim("text"), F.lit(" https://z"))).alias("text"))


@query("x23_stripped_words", r"select doc_id, list_transform(regexp_split_to_array(text, '\s+'), lambda w: regexp_replace(lower(w), '^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$', '', 'g')) as words from documents")
def x23_stripped_words(spark, d):
    return _docs(spark, d).select("doc_id", text.stripped_words(F.col("text")).alias("words"))


@query("x24_code_tokens", r"select page_id, regexp_extract_all(lower(url), '[0-9a-z_]+') as tokens from pages")
def x24_code_tokens(spark, d):
    return X.table(spark, d, "pages").select("page_id", text.code_tokens(F.col("url")).alias("tokens"))


@query("x25_docstring_tokens", r"select page_id, list_filter(regexp_split_to_array(regexp_replace(url, '[^0-9a-zA-Z_]', ' ', 'g'), '\s+'), lambda w: w <> '') as tokens from pages")
def x25_docstring_tokens(spark, d):
    return X.table(spark, d, "pages").select("page_id", text.docstring_tokens(F.col("url")).alias("tokens"))


@query("x26_ascii_and_mail", r"select doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') as text, lang || '@' || source as mail from documents")
def x26_ascii_and_mail(spark, d):
    return _docs(spark, d).select("doc_id", text.ascii_only(F.col("text")).alias("text"), text.mail_address(F.concat(F.lit("<"), "lang", F.lit("@"), "source", F.lit(">"))).alias("mail"))


@query("x14_function_name", "select event_id, event_type as name from events")
def x14_function_name(spark, d):
    return X.table(spark, d, "events").select("event_id", text.function_name(F.concat(F.lit("A.b."), F.initcap("event_type"))).alias("name"))


@query("x29_x30_coercion", "select event_id, floor(value)::bigint as whole, case when value < 0 then ceil(value)::bigint end as negative, event_type = 'view' as truth from events")
def x29_x30_coercion(spark, d):
    e = X.table(spark, d, "events")
    number = scalars.whole_number(F.col("value").cast("string"))
    return e.select("event_id", number.alias("whole"), F.when(F.col("value") < 0, number).alias("negative"), scalars.truth(F.when(F.col("event_type") == "view", "Yes").otherwise("no")).alias("truth"))


@query("x28_iso_time", "select event_id, date_trunc('second', ts) as t from events")
def x28_iso_time(spark, d):
    e = X.table(spark, d, "events").select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))
    return e.select("event_id", scalars.iso_time(F.col("iso")).cast("timestamp_ntz").alias("t"))


@query("x31_notebook_code", "select doc_id, text || chr(10) || lang as code from documents")
def x31_notebook_code(spark, d):
    cell = lambda kind, c: F.struct(F.lit(kind).alias("cell_type"), F.col(c).alias("source"))
    notebook = F.to_json(F.struct(F.array(cell("code", "text"), cell("markdown", "source"), cell("code", "lang")).alias("cells")))
    return _docs(spark, d).select("doc_id", text.notebook_code(notebook).alias("code"))


@query("s12_strip_html", r"select page_id, regexp_replace(regexp_replace(regexp_replace(html, '<script>.*?</script>|<style>.*?</style>', '', 'gs'), '<!--.*?-->|<[^>]*>', '', 'gs'), '\s+', '', 'g') as text from (select page_id, replace(html, '&', '') as html from pages)")
def s12_strip_html(spark, d):
    return X.table(spark, d, "pages").select("page_id", F.regexp_replace(text.strip_html(F.replace("html", F.lit("&"), F.lit(""))), r"\s+", "").alias("text"))


@query("a15_files", "select conv_id, string_agg(text, chr(10) order by turn) as source from conversations group by 1")
def a15_files(spark, d):
    return code.files(X.table(spark, d, "conversations"), "conv_id", number="turn", line="text")


@query("i14_lexer", "select conv_id, turn as line_num, 'f' || role as function from conversations")
def i14_lexer(spark, d):
    """Sources of one call per line; the table function must find them all."""
    lines = X.table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("m.F"), "role", F.lit("(1)")).alias("line"))
    lines = lines.withColumn("first", F.lit(0))
    sources = code.files(lines, "conv_id", "turn", number="first")
    return code.functions_of(sources, "conv_id", "turn").select("conv_id", F.col("turn").alias("line_num"), "function")


@query("e1_lookup", f"with {WORDS} select o.o_orderpriority as word, coalesce(round(list_sum(vector), 6), 0) as s from (select distinct o_orderpriority from orders) o left join words w on w.word = o.o_orderpriority union all select word, round(list_sum(vector), 6) from words")
def e1_lookup(spark, d):
    words = _words(spark, d)
    wanted = X.table(spark, d, "orders").select(F.col("o_orderpriority").alias("word")).distinct().unionByName(words.select("word"))
    found = embeddings.lookup(wanted, words, 64)
    return found.select("word", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("s"))


@query("e2_closest_words", f"with {WORDS}, own as (select vector as o from words where word = 'the'), near as (select word, round(sqrt(list_sum(list_transform(list_zip(vector, o), lambda x: (x[1] - x[2]) ** 2))), 3) as distance from words cross join own) select word, distance from near where distance > 0 order by distance, word limit 10")
def e2_closest_words(spark, d):
    return embeddings.closest_words(_words(spark, d), "The", 10)


@query("e3_word2vec")
def e3_word2vec(spark, d):
    return embeddings.train_on_code(X.table(spark, d, "documents"), "text", least=25)


@query("x10_x12_numbers", "select event_id, round(log2(greatest(value - 50, 1e-100)), 6) as l, round_even(value, 0) as r, greatest(10.0, least(60.0, value)) as c from events")
def x10_x12_numbers(spark, d):
    v = F.col("value")
    out = X.table(spark, d, "events").select("event_id", scalars.log2_floored(v - 50).alias("l"), scalars.half_even(v).alias("r"), scalars.clamp(v, 10, 60).alias("c"))
    return rounded(out, "l")
