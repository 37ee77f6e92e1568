"""Column helpers over texts.  All offsets count code points, from 0, with exclusive ends."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that counts as white space (Unicode), as used to trim spans.
WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Terms of the sparse index.
TERM = r"[\p{L}\p{N}_]{2,}"
#: Typographic characters and what they fold to.
FOLD_FROM, FOLD_TO = "‘’‚‛“”„–—‒―", "''''\"\"\"----"


#: Fixed value: characters that file names cannot hold.
ILLEGAL = r'[<>:"/\\|?*\x00-\x1f]'


def ltrim(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITE))


def rtrim(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE))


def cut(text: Column, start: Column, end: Column) -> Column:
    """``text[start:end]``."""
    return F.substring(text, start + 1, end - start)


def terms(text: Column) -> Column:
    """Terms of a text in order, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def n_words(text: Column) -> Column:
    """White-space separated words: the default token counter."""
    return F.size(F.filter(F.split(text, "[ \\t\\n\\r]+"), lambda w: w != "")).cast("int")


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the edges."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def fold(text: Column) -> Column:
    """Comparison form: quotes and dashes made plain, ellipsis spelt out, lower case, white space collapsed."""
    return squeeze(F.lower(F.replace(F.translate(text, FOLD_FROM, FOLD_TO), F.lit("…"), F.lit("..."))))


def safe_id(name: Column, fallback: str = "document") -> Column:
    """A file-safe id: illegal characters to ``_``, no dots or spaces at the edges, at most 120 characters."""
    clean = F.left(F.btrim(F.regexp_replace(name, ILLEGAL, "_"), F.lit(". ")), F.lit(120))
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit(fallback))


def escape_html(text: Column, quotes: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(F.replace(out, F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;")) if quotes else out


def preview(text: Column, width: int = 80) -> Column:
    flat = squeeze(text)
    return F.concat(F.left(flat, F.lit(width)), F.when(F.length(flat) > width, "...").otherwise(""))


def with_title(question: Column, title: Column) -> Column:
    """``In "<title>", question``, its first letter lowered unless the first word looks like an acronym."""
    q = squeeze(question)
    acronym = F.substring(F.split(q, " ")[0], 2, 1).rlike(r"\p{Lu}")
    return F.concat(F.lit('In "'), title, F.lit('", '), F.when(acronym, q).otherwise(F.concat(F.lower(F.left(q, F.lit(1))), F.substring(q, 2, 2**30))))


def book_title(name: Column) -> Column:
    return F.replace(F.split(name, "_-_")[0], F.lit("_"), F.lit(" "))


def plain_html(html: Column) -> Column:
    """Visible text of markup: scripts, styles, comments and tags out, five entities decoded, pieces joined by a space;
    the markup itself if nothing is left."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(t, "[ \\t\\n\\r]+", " ")), F.lit("")), html)


def truncate(text: Column, n: int) -> Column:
    """``struct(text, cut)``: the longest prefix of at most ``n`` white-space words."""
    head = F.regexp_extract(text, r"^\s*(?:\S+\s+){0,%d}\S+" % (n - 1), 0)
    return F.struct(F.when(n_words(text) > n, head).otherwise(text).alias("text"), (n_words(text) > n).alias("cut"))


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def holds(text: Column, asked: Column) -> Column:
    """Whether a text has another in it, whatever the case."""
    return F.lower(text).contains(F.lower(asked))
