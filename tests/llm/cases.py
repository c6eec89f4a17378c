"""Small tables with every awkward case, and plain code to compare with."""

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, `row.key` int, rule string"
LONG = " ".join(f"word{i % 977} other{i % 13}" for i in range(60_000))


def odd_rows():
    """Null ids and texts, empty and blank texts, one-word and very long ones, repeated rows, equal ids."""
    texts = [None, "", " \n\t ", "one", "one", "a b c\na b c\n\na b c", LONG, LONG, "x" * 50_000, "line " * 60 + "\n" + "tail", "line " * 60 + "\nother tail", "É́ 日本 \U0001f600 ok"]
    rows = [(i, t, None if i % 2 else "en", "s", None, "mine", i, None) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[6], (None, "no id here", None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (3, "another text of id three", "en", "s", 5, "x", 1, "r")]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents():
    table = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return sorted(((r["doc_id"], r["text"] or "") for r in table), key=lambda r: r[0])


def rows_of(df, key="doc_id"):
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}
