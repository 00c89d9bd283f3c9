"""Text expressions: wiki markup, tokens, names, titles, mail addresses, notebooks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def title_and_year(title: Column) -> tuple[Column, Column]:
    """('Toy Story', 1995) of 'Toy Story (1995)'; the title alone if no year starting with 1 or 2 ends it."""
    whole = F.trim(title)
    pattern = r"^(.*)\(([12]...)\)$"
    has = whole.rlike(pattern) & ~F.regexp_extract(whole, pattern, 2).contains("(")
    name = F.when(has, F.trim(F.regexp_extract(whole, pattern, 1))).otherwise(title)
    return name, F.when(has, F.regexp_extract(whole, pattern, 2).try_cast("int"))


#: Genre names as they stand in the data, with the suffix of their column.
GENRES = [
    ("Action", "action"), ("Adventure", "adventure"), ("Animation", "animation"), ("Children", "childrens"), ("Comedy", "comedy"), ("Crime", "crime"),
    ("Documentary", "documentary"), ("Drama", "drama"), ("Fantasy", "fantasy"), ("Film-Noir", "filmnoir"), ("Horror", "horror"), ("Musical", "musical"),
    ("Mystery", "mystery"), ("Romance", "romance"), ("Sci-Fi", "scifi"), ("Thriller", "thriller"), ("War", "war"), ("Western", "western"),
]


def genre_flags(genres: Column) -> dict[str, Column]:
    """A boolean for each genre by substring, and genre_none for the text that says there is none."""
    return {f"genre_{name}": genres.contains(mark) for mark, name in GENRES} | {"genre_none": F.trim(genres) == "(no genres listed)"}


def clean_categories(text: Column) -> Column:
    """[[Category:X|hint]] to X."""
    return F.regexp_replace(text, r"\[\[Category:([^\[\]|]*)(\|[^\[\]]*)?\]\]", "$1")


def clean_links(text: Column) -> Column:
    """[[a]] to a and [[a|b]] to b."""
    return F.regexp_replace(F.regexp_replace(text, r"\[\[[^\[\]|]*\|([^\[\]]*)\]\]", "$1"), r"\[\[([^\[\]|]*)\]\]", "$1")


def extract_categories(text: Column) -> Column:
    """Targets of all category links."""
    return F.regexp_extract_all(text, F.lit(r"\[\[(Category:[^\[\]|]*)"), F.lit(1))


def clean_name(category: Column) -> Column:
    return F.replace(category, F.lit(" "), F.lit("_"))


def remove_templates(text: Column, compat: bool = False) -> Column:
    """Drop {{...}}, nested or not. One fold over the pieces between the marks, in a linear number of steps.

    Braces count in pairs. A closing pair without an opening one leaves the depth below zero, and nothing more is kept.

    compat: as the data's first users had it. Two equal braces in a row change the depth wherever they stand, so n of them
    count n - 1 times; the last opening brace and the first closing one are text where the depth is 0. Templates that
    close together, as in {{a{{b}}}}, then take all that follows with them.
    """
    marks = r"(\{{2,}|\}{2,})" if compat else r"(\{\{|\}\})"
    pieces = F.split(F.regexp_replace(text, marks, "\u0001$1\u0001"), "\u0001")
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, piece: Column) -> Column:
        opens, closes = piece.startswith("{{"), piece.startswith("}}")
        if compat:
            n = F.length(piece) - 1
            depth = F.when(opens, state["depth"] + n).when(closes, state["depth"] - n).otherwise(state["depth"])
            shown = F.when(opens, depth == 0).otherwise(state["depth"] == 0)
            piece = F.when(opens, "{").when(closes, "}").otherwise(piece)
        else:
            depth = F.when(opens, state["depth"] + 1).when(closes, state["depth"] - 1).otherwise(state["depth"])
            shown = (state["depth"] == 0) & ~opens & ~closes
        return F.struct(depth.alias("depth"), F.when(shown, F.concat(state["kept"], F.array(piece))).otherwise(state["kept"]).alias("kept"))

    return F.array_join(F.aggregate(pieces, start, step)["kept"], "")


def drop_refs(text: Column) -> Column:
    """Line ends to spaces, reference tags out."""
    return F.regexp_replace(F.replace(text, F.lit("\n"), F.lit(" ")), "</?ref>", "")


def remove_punctuation(text: Column) -> Column:
    return F.translate(text, PUNCTUATION, "")


def remove_urls(text: Column) -> Column:
    """Drop words that start with http; one space between the others."""
    return F.array_join(F.filter(F.split(F.trim(text), r"\s+"), lambda w: ~w.startswith("http")), " ")


def wiki_words(text: Column) -> Column:
    """Lower-case words of an article's markup."""
    plain = remove_urls(remove_punctuation(drop_refs(clean_links(clean_categories(remove_templates(text))))))
    return F.split(F.lower(plain), " ")


def stripped_words(text: Column) -> Column:
    """Lower-case words without punctuation at their ends."""
    return F.transform(F.split(text, r"\s+"), lambda w: F.btrim(F.lower(w), F.lit(PUNCTUATION)))


def code_tokens(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(r"(\w+)"), F.lit(1))


def docstring_tokens(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"\W", " "), r"\s+"), lambda w: w != "")


def function_name(path: Column) -> Column:
    """Last part of a dotted path in lower case."""
    return F.element_at(F.split(F.lower(path), r"\."), -1)


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def mail_address(text: Column) -> Column:
    return F.btrim(text, F.lit("<>"))


def strip_html(html: Column) -> Column:
    """Text of simple markup: scripts, styles and tags out, common entities back to characters."""
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->|<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def notebook_code(content: Column) -> Column:
    """Code cells of a notebook, one after the other; text that is no notebook stays."""
    shape = "array<struct<cell_type: string, source: variant, input: variant>>"
    parsed = F.try_parse_json(content)
    cells = F.try_variant_get(parsed, "$.cells", shape)
    sheets = F.flatten(F.transform(F.try_variant_get(parsed, "$.worksheets", f"array<struct<cells: {shape}>>"), lambda w: w["cells"]))  # of older notebooks
    cells = F.coalesce(cells, sheets)

    def source(cell: Column) -> Column:
        """A cell's text: a string, or a list of strings one after the other."""
        parts = [F.array_join(F.try_variant_get(cell[c], "$", "array<string>"), "") for c in ("source", "input")]
        whole = [F.try_variant_get(cell[c], "$", "string") for c in ("source", "input")]
        return F.coalesce(parts[0], whole[0], parts[1], whole[1])

    code = F.array_join(F.transform(F.filter(cells, lambda c: c["cell_type"] == "code"), source), "\n")
    return F.when(cells.isNotNull(), code).otherwise(content)


def decode(raw: Column) -> Column:
    """Bytes as UTF-8 if they are that, otherwise as Latin-1."""
    return F.when(F.is_valid_utf8(raw), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))
