import random

import duckdb

from weftline.functions.scalars import rounded
from pyspark.sql import functions as F


def test_doubles_are_rounded_as_sql_rounds_them(spark):
    rng = random.Random(4)
    found = [-1e-9, 1e-9, -0.0, 0.0, 0.0000005, -0.0000005, 1.0000005, -1.0000005, 0.1234565, 0.49999999999999994e-6, 123456789.1234565, 1e200, -1e17, float("inf"), float("nan")]
    found += [rng.choice([-1, 1]) * (rng.randrange(10**7) * 2 + 1) / 2e6 for _ in range(2000)]
    own = [repr(r[0]) for r in spark.createDataFrame([(k, x) for k, x in enumerate(found)], "k long, x double").coalesce(1).sort("k").select(rounded(F.col("x"), 6)).collect()]
    duck = duckdb.connect()
    assert own == [repr(duck.execute("SELECT round(?::DOUBLE, 6)", [x]).fetchone()[0]) for x in found]
    assert spark.sql("SELECT cast(NULL AS double) AS x").select(rounded(F.col("x"), 6)).first()[0] is None
