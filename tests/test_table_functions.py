"""Table functions in SQL against their DataFrame forms."""

import os

import pytest
from pyspark.sql.types import StructType

from skein.operators import table_functions
from skein.operators.matching import stitch
from skein.plans import catalog

FOLDER = os.environ.get("SKEIN_TEST_TABLES", "/root/testdata/sf0.001")


@pytest.mark.parametrize(("sql", "frame"), [("tg2_chunks_in_sql", "tg2_recursive_chunks"), ("tg5_blocks_in_sql", "tg5_markdown_blocks")])
def test_same_as_the_frame(spark, sql, frame):
    a, b = (catalog.queries()[n](spark, FOLDER) for n in (sql, frame))
    assert a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_strategies_by_name(spark):
    table_functions.register(spark, {"halves": lambda text, size=2: [{"start": 0, "end": len(text) // size, "note": "a"}, {"start": len(text) // size, "end": len(text), "note": "b"}]}, {"halves": StructType.fromDDL("note string")})
    got = spark.sql("SELECT c.* FROM VALUES ('abcdef'), (NULL) AS d(t), LATERAL chunk_text(d.t, 'halves') c").collect()
    assert [tuple(r) for r in got] == [(0, 0, 3, "abc", "a"), (1, 3, 6, "def", "b"), (0, 0, 0, "", "a"), (1, 0, 0, "", "b")]
    assert [r["content"] for r in spark.sql("SELECT * FROM chunk_text('abcdef', 'halves', size => 3)").collect()] == ["ab", "cdef"]
    assert spark.sql("SELECT * FROM chunk_text('a b c d', 'token', size => 2, overlap => 1)").count() == 3
    with pytest.raises(Exception, match="no strategy"):
        spark.sql("SELECT * FROM chunk_text('x', 'nothing')").collect()
    with pytest.raises(Exception, match="must be a string"):
        spark.sql("SELECT * FROM chunk_text(1, 'token')").collect()
    table_functions.register(spark)


def test_partitioned_tables(spark):
    table_functions.register(spark)
    whole = "The river runs by the old mill, and the mill stands by the river since long ago. " * 3
    rows = [(d, i, whole[a:a + 120]) for d in (1, 2) for i, a in enumerate(range(0, len(whole) - 60, 80))] + [(3, 0, None)]
    parts = spark.createDataFrame(rows, "document_id long, chunk_index int, content string").repartition(4)
    got = {r["document_id"]: (r["parts"], r["text"]) for r in spark.sql("SELECT * FROM stitch_parts(TABLE({parts}) PARTITION BY document_id ORDER BY chunk_index)", parts=parts).collect()}
    assert got[1] == got[2] == (len(rows) // 2, stitch([x for d, _, x in rows if d == 1])) and got[3] == (1, "")
    with pytest.raises(Exception, match="stitch_parts"):
        spark.sql("SELECT * FROM stitch_parts(TABLE({p}))", p=parts.drop("content")).collect()
