import pytest

TYPES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "labels": "doc_id long, quality int, toxic int",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "conversations": "conv_id long, turn long, role string, text string",
}


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Writes given rows (the other tables empty) as a folder of parquet tables."""
    def write(**rows):
        folder = tmp_path_factory.mktemp("tables")
        for name, schema in TYPES.items():
            spark.createDataFrame(rows.get(name, []), schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
        return str(folder)
    return write


@pytest.fixture(scope="session")
def empty_dir(tables):
    return tables()


@pytest.fixture(scope="session")
def odd_dir(tables):
    """Nulls in every column, empty and long texts, ties, repeated rows."""
    long_text = " ".join(f"word{i % 977} und" for i in range(30_000))
    docs = [(1, "a plain text of some words that is here", "en", "s1", 5), (2, None, None, None, None), (3, "", "en", "s1", 0),
            (None, "no id here but some words", "en", "s2", 1), (4, long_text, "de", "s2", 1), (5, "  \n\t ", "en", "s1", 1),
            (6, "a plain text of some words that is here", "en", "s1", 5), (7, "x", "en", None, 1), (7, "x", "en", None, 1),
            (8, "idiot \U0001f600 <|im_end|> &amp; \x00 é" * 3, "fr", "s3", 9)]
    labels = [(1, 1, 0), (2, 0, None), (None, 1, 1), (8, 0, 1), (8, 0, 1), (4, None, 0), (99, 1, 1)]
    vectors = [(0, [1.0, 0.0], 1), (50, [1.0, 0.0], None), (100, None, 0), (2, [0.0, 0.0], 0), (3, [float("nan"), 1.0], 0),
               (4, [None, 1.0], 0), (5, [2.0, 0.0], 0), (6, [0.0, 1.0], 0), (7, [1.0, 1.0, 1.0], 0), (None, [1.0, 1.0], 0),
               (0, [1.0, 0.0], 1), (8, [], 0), (9, [-1.0, 0.5], 0), (10, [float("inf"), 1.0], 0)]
    pages = [(1, None, None), (2, "u", ""), (3, "u", "<p>One</p><p"), (None, None, "<article><p>Only &amp this</p></article>"),
             (3, "u", "<p>One</p><p")]
    talks = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (2, None, None, "x"),
             (None, 0, "user", "lost"), (3, 2, "assistant", "<||im_end|> a <| b"), (3, 1, "us\ner", ""), (4, 0, "user", "q"),
             (4, 1, "assistant", "a")]
    return tables(documents=docs, labels=labels, embeddings=vectors, pages=pages, conversations=talks)
