"""Large rates: no work in the square of a rate."""

import hashlib
import math

from tickforge.llm.mixing import SEED, mix_sources


def test_rate_of_a_million(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "x" * 1_999_999)], "doc_id long, source string, text string")
    n = mix_sources(df).where("source = 'a'").count()
    rate, u = 1e6, int(hashlib.md5(f"{SEED}|1".encode()).hexdigest()[:13], 16) / 2**52
    k, below = int(rate - 20 * math.sqrt(rate)), 0.0
    while True:
        below += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
        if below > u:
            break
        k += 1
    assert abs(n - k) <= 1
