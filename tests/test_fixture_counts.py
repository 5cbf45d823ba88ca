"""Pattern counts of FIXTURES.md over one rendered line per lineitem row."""

from pyspark.sql import functions as F

from codestrata.functions import rules
from codestrata.functions.text import rx
from codestrata.operators import quality
from codestrata.plans import corpora


def test_counts_at_sf001(spark):
    text = corpora.code_line("(l_partkey + 7 * l_linenumber) % 30", "l_partkey", "cast(l_quantity as int)")
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").selectExpr(
        f"{corpora._dialect(text, corpora._SPARK)} as line"
    )
    patterns = {name: rx(p, fold) for name, _, fold, p in rules.SECRET_PATTERNS}
    got = lines.agg(
        *[F.count_if(F.col("line").rlike(p)).alias(name) for name, p in patterns.items()],
        F.count_if(F.col("line").rlike(quality._MAGIC)).alias("magic"),
        F.sum(quality.complexity_of(F.col("line"))).alias("complexity"),
    ).first().asDict()
    expected = {
        "GitHub Token": 2071, "Generic API Key": 1976, "Password in Code": 2018, "OAuth Client Secret": 2091,
        "Secret in Code": 2091, "Database URL": 2025, "magic": 9189,
        # control-flow words plus the two word-bounded operators of one template
        "complexity": 5880 + 1953,
    }
    assert {k: got[k] for k in expected} == expected
