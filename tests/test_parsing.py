"""Wide stages and the casts that stand in for the number patterns."""

from pyspark.sql import functions as F

from tests.compare import DATA
from tillsight.functions import semantics as m
from tillsight.session import LARGEST_COMPILED
from tillsight.sources.fixtures import Fixture

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def test_methods_the_jvm_does_not_compile_are_not_generated_unless_the_caller_says_so(spark):
    spark.conf.unset(LIMIT)
    Fixture(spark, str(DATA / "sf0.001"))
    assert int(spark.conf.get(LIMIT)) == LARGEST_COMPILED <= 8000
    try:
        spark.conf.set(LIMIT, "9000")
        Fixture(spark, str(DATA / "sf0.001"))
        assert spark.conf.get(LIMIT) == "9000"
    finally:
        spark.conf.unset(LIMIT)


def test_what_only_a_cast_reads_is_no_number(spark):
    texts = {
        "0x1p3": (0.0, 0), "-0X1P3": (0.0, 0), "\t5": (0.0, 0), "5\t": (5.0, 5), "Infinity": (0.0, 0), "+inf": (0.0, 0), "-NaN": (0.0, 0),
        "1d": (1.0, 1), "2.5F": (2.5, 2), "1e": (1.0, 1), "+.5": (0.5, 0), "+7": (7.0, 7), "1.": (1.0, 1), "-": (0.0, 0), "  8 ": (8.0, 8),
    }
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", m.to_real(F.col("x")), m.to_int(F.col("x"))).collect()
    assert {r[0]: (r[1], r[2]) for r in rows} == texts
