"""Plans: code tables never make parcels move, nothing is compared all against all."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["use_verdict", "uses_for_zone", "inspect_layers", "compact_layers", "evaluate_uses", "use_restriction"])
def test_no_cartesian_product(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_use_matrix_is_a_local_relation(spark):
    from parcelweave.operators import rules
    matrix = rules.use_matrix(spark)
    assert "LocalTableScan" in matrix._jdf.queryExecution().executedPlan().toString()
    parcels = spark.range(1000).selectExpr("id", "if(id % 2 = 0, '단독주택', '창고') AS building_use", "if(id % 3 = 0, '계획관리지역', '보전관리지역') AS zone", "true AS found", "0 AS n_constraints")
    plan = rules.use_verdict(parcels, matrix)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
