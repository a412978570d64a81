"""What a task of the pipeline holds at once stays bounded, whatever the size of the table."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from corpusloom.llm import decontam
from corpusloom.llm.common import arrow_batches


def test_index_row_groups(spark):
    """Rows of the decontamination index are some MB each; they do not share pages and row groups by the hundred."""
    docs = spark.range(0, 6, 1, 1).select(F.col("id").alias("doc_id"), F.expr("array_join(transform(sequence(1, 500000), x -> concat('w', x + id * 500000)), ' ')").alias("text"))
    index = decontam.build_index(docs)
    files = [f.removeprefix("file:") for f in index.inputFiles()]
    groups = [pq.read_metadata(f.replace("///", "/")) for f in files]
    groups = [(m.row_group(i).num_rows, m.row_group(i).total_byte_size) for m in groups for i in range(m.num_row_groups)]
    assert sum(n for n, _ in groups) == index.count() == 6
    assert max(n for n, _ in groups) <= 2 and max(b for _, b in groups) <= 20 << 20
    assert index.agg(F.sum(F.size("positions"))).first()[0] == 6 * 500_000


def test_arrow_batches(spark):
    """A batch that a worker gets ends with the row that takes it over 4 MB."""
    arrow_batches(spark)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    rows = spark.range(0, 20, 1, 1).select(F.expr("repeat('abcdefgh', 125000)").alias("t"))
    found = [r["n"] for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(found) >= 20_000_000 and max(found) <= (4 << 20) + 1_100_000


def test_clean_without_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"x{i} " + ("a b c d e f g h i j" if i % 3 == 0 else "k l m")) for i in range(30)] + [(None, "a b c d e f g h i j"), (None, "q")], "doc_id long, text string")
    items = spark.createDataFrame([("i", "a b c d e f g h i j")], "item_id string, text string")
    want = sorted([*((i, f"x{i} k l m") for i in range(30) if i % 3), (None, "q")], key=str)
    for most in (decontam.WANTED, 0):
        monkeypatch.setattr(decontam, "WANTED", most)
        assert sorted(map(tuple, decontam.clean(docs, items).collect()), key=str) == want
