import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# Names that operators use inside, as columns of the caller.
CLASHES = ["h", "key", "value", "row", "th", "pos", "root", "node", "length", "rank", "slot", "shard", "count", "n_lines", "batch", "nos"]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(pairs, clashing=True):
        df = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in pairs], SCHEMA)
        return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES}) if clashing else df

    return make
