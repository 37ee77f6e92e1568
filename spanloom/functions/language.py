"""Language of a text, by the share of its words that are among a language's commonest.

A plain stand-in for a trained detector: it knows the languages below and stays inside whole-stage code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common words by language.
COMMON = {
    "en": "the of and to in is was for that with as by on are from it".split(),
    "fr": "le les des et du une est dans pour que qui sur par au pas ce".split(),
    "de": "der die und das den von zu mit ist des dem auf nicht ein eine im".split(),
    "es": "el los las y del que por con una para se su al como es lo".split(),
    "pl": "w i na z nie się do jest o że to przez od po jak oraz".split(),
}
WORD = r"\p{L}+"


def detected(text: Column, sample: int = 3000, fallback: str = "en") -> Column:
    """The language with the most common words among those of the first ``sample`` characters, ties to the one listed
    first; the fallback for a text without any of them, null and empty ones too."""
    words = F.regexp_extract_all(F.lower(F.substring(F.coalesce(text, F.lit("")), 1, sample)), F.lit(WORD), F.lit(0))
    among = lambda ws, own: F.filter(own, lambda w: w.isin(*ws))
    common = among(sorted({w for ws in COMMON.values() for w in ws}), words)
    # a list of one holds what is read several times, so that it is computed once
    counts = F.transform(F.array(common), lambda own: F.array(*[F.size(among(ws, own)) for ws in COMMON.values()]))
    named = F.transform(counts, lambda c: F.when(F.array_max(c) == 0, fallback).otherwise(F.element_at(F.array(*map(F.lit, COMMON)), F.array_position(c, F.array_max(c)).cast("int"))))
    return F.get(named, F.lit(0))


def corpus_language(docs: DataFrame, documents: int = 5, opening: int = 1000) -> str:
    """One language for a corpus: that of the openings of its first documents."""
    texts = [r[0] or "" for r in docs.orderBy("doc_id").limit(documents).select(F.substring("text", 1, opening)).collect()]
    whole = "\n\n".join(texts)
    return docs.sparkSession.range(1).select(detected(F.lit(whole), max(1, len(whole)))).first()[0]
