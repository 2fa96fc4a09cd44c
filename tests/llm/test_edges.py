"""Empty tables for language identification, and vectors that come with columns named like those within."""

from folio.llm.embedding_dedup import near_vectors
from folio.llm.language_id import identify_language, learn_languages

DOCS = "doc_id long, text string, lang string"


def test_languages_of_empty_tables(spark):
    some = spark.createDataFrame([(1, "the house is on the hill", "en"), (2, "das haus steht auf dem berg", "de"), (3, None, "de"), (4, "no lang", None)], DOCS)
    parser = learn_languages(some)
    assert identify_language(some.limit(0), parser).isEmpty()
    nothing = learn_languages(some.limit(0))
    assert identify_language(some.limit(0), nothing).isEmpty()
    assert {r["lang_pred"] for r in identify_language(some, nothing).collect()} == {"und"}


def test_vectors_with_clashing_columns(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [0.999, 0.01], 1), (3, [0.0, 1.0], 1), (4, [1.0, 0.0], 2), (5, None, 1)]
    d = spark.createDataFrame([(*r, 7, "x", 1.5, 2, 3, 4) for r in rows], "vec_id long, embedding array<double>, label int, rep int, h1 string, c double, copies int, tile int, `range` int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(d).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True)}
