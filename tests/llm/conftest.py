import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])


@pytest.fixture
def documents(spark, tmp_path):
    """Write rows (doc_id, text[, lang]) as a documents table; gives (folder, frame)."""

    def make(rows, **tables):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path), spark.read.parquet(f"{tmp_path}/documents.parquet")

    return make
