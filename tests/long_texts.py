"""A folder of tables whose texts repeat something very often, are empty or null."""

import os

PIECES = ("1.", "a-", "x ", ". ", "; ", "le ", "do ", "token=", "license ", "\n", "é", "w", "built python. ", "<b", "!? ", "| ", "12 years ", "a/b+c#.")
TEXTS = [p * 12_000 for p in PIECES] + ["", None, " \t", "\x01\x02", "Engineer " * 3_000]
OTHERS = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings", "labels", "benchmark")


def write(spark, source: str, folder: str) -> None:
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, f"http://h/{i}", t) for i, t in enumerate(TEXTS)], "page_id long, url string, html string").repartition(4).write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(i // 3, i % 3, "user", t) for i, t in enumerate(TEXTS)], "conv_id long, turn long, role string, text string").repartition(4).write.parquet(f"{folder}/conversations.parquet")
    for name in OTHERS:
        os.symlink(f"{source}/{name}.parquet", f"{folder}/{name}.parquet")
