import os

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def documents(spark, rows):
    """Rows of (doc_id, text) with the other columns of the table and some whose names clash with internal ones."""
    clashing = ("fp", "k", "h", "base", "spans", "row", "first_id", "batch", "bucket", "score")
    data = [(i, t, "en", "s", len(t or ""), *([7] * len(clashing))) for i, t in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in clashing))
