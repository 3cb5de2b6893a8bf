import numpy as np

from sagebrook.operators.search import semantic
from sagebrook.sources.vector_index import search_index, write_index


def test_index(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((12, 16)) * 2
    rows = [(n, (centres[n % 12] + 0.3 * rng.standard_normal(16)).tolist()) for n in range(600)] + [(9000, None), (9001, [1.0]), (9002, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    write_index(df, str(tmp_path), lists=12)
    assert spark.read.parquet(f"{tmp_path}/rows").count() == len(rows)
    hits = total = 0
    for n in range(0, 600, 20):
        query = rows[n][1]
        want = [r.id for r in semantic(df, query, 5).collect()]
        assert [r.id for r in search_index(spark, str(tmp_path), query, 5, probes=12).collect()] == want
        hits += len(set(want) & {r.id for r in search_index(spark, str(tmp_path), query, 5, probes=3).collect()})
        total += 5
    assert hits >= 0.9 * total
    plan = search_index(spark, str(tmp_path), rows[0][1], 5, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "list" in plan.split("PartitionFilters: [")[1][:60]
