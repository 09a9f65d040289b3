"""Query op12: whitened embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldra.llm import whitening
from veldra.session import table

COMPONENTS = 8


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each usable vector and component.

    Vectors of another length than the most frequent one take no part either. A component without variance has whitened
    0 and explained 0. A deviation beyond a long is null; ``whitening.whitened`` gives all its digits. Repeated rows each
    return; an empty table gives an empty one.
    """
    rows, model = whitening.fit_transform(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", ["vec_id"], COMPONENTS)
    error = whitening.identity_error(rows, model)
    explained = F.array(*(F.lit(float(x)) for x in model.explained)).cast("array<double>")
    out = rows.select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("_i", "whitened"))
    return out.select("vec_id", (F.col("_i") + 1).alias("component"), F.lit(model.scatter.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("_i")).alias("explained"), F.lit(error).alias("identity_error"))


QUERIES = {"op12_whitening": op12_whitening}
#: SQL has no eigenvectors; tests/llm hold the integers against SQL and the rest against plain NumPy.
ORACLE_SQL: dict[str, str] = {}
