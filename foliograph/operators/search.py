"""Search over papers and authors: conjunctive, ranked, and full text with snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliograph.functions import text


def search_text(papers: DataFrame) -> DataFrame:
    """(item_id, title, body): normalised title, and everything searchable of a paper as one text."""
    authors = F.array_join(F.transform("creators", lambda c: F.concat_ws(" ", c["first_name"], c["last_name"])), " ")
    whole = F.concat_ws(" ", F.col("title"), F.col("journal"), F.col("year"), F.col("doi"), authors)
    return papers.select("item_id", text.norm(F.col("title")).alias("title"), text.norm(whole).alias("body")).distinct()


def _words(query: str) -> list[str]:
    return [w for w in query[:240].lower().split() if w]


def containing_all(column: Column, words: list[str]) -> Column:
    hit = F.lit(True)
    for w in words:
        hit = hit & column.contains(w)
    return hit


def _near(word: str):
    """A test for words of a title: they hold `word` or are one edit from it."""

    def test(x: Column) -> Column:
        edit = F.when(F.length(x) >= 5, text.one_edit(x, F.lit(word))).otherwise(F.lit(False)) if len(word) >= 5 else F.lit(False)
        return x.contains(word) | edit

    return test


def token_search(papers: DataFrame, query: str) -> DataFrame:
    """(item_id) of papers whose text contains every word."""
    return search_text(papers).where(containing_all(F.col("body"), _words(query))).select("item_id")


def ranked_search(papers: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """(item_id, score, title): 100 whole title, 85 all words in it, 75 compact substring, 60 all words in the text, 35 within one edit; the best `limit`."""
    words = _words(query)
    compact = "".join(words)
    t = search_text(papers)
    squeezed = F.replace("title", F.lit(" "), F.lit(""))
    tw = F.split("title", " ")
    near = F.lit(len(words) <= 8)
    for w in words:
        near = near & F.exists(tw, _near(w))
    score = (
        F.when((F.col("title") == " ".join(words)) | (squeezed == compact), 100)
        .when(containing_all(F.col("title"), words), 85)
        .when(squeezed.contains(compact), 75)
        .when(containing_all(F.col("body"), words), 60)
        .when(near, 35)
    )
    return t.select("item_id", score.alias("score"), "title").where("score IS NOT NULL").orderBy(F.col("score").desc(), "title", "item_id").limit(limit)


def snippets(docs: DataFrame, term: str) -> DataFrame:
    """(doc_id, snippet) of documents that contain the term, in any case."""
    return docs.select("doc_id", text.snippet(F.col("text"), F.lit(term.lower())).alias("snippet")).where("snippet IS NOT NULL")
