import pytest

from finsieve.plans import catalogue

from .compare import oracle, rows


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_gives_the_oracles_rows(spark, sf_dir, name):
    made = catalogue.QUERIES[name](spark, sf_dir).toPandas()
    assert len(made)
    if name in catalogue.ORACLES:
        wanted = oracle(catalogue.ORACLES[name], sf_dir)
        assert sorted(made.columns) == sorted(wanted.columns)
        assert rows(made) == rows(wanted)


def test_strict_json_query(spark, sf_dir):
    found = {r["doc_id"] % len(catalogue.STRICT): (r["parse_ok"], r["kind"], r["txt"]) for r in catalogue.response_parse_strict(spark, sf_dir).collect()}
    assert found == {i: x[1:] for i, x in enumerate(catalogue.STRICT)}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "acceptable", "n_warnings", "warnings_text"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_scan_reads_only_what_is_needed(spark, sf_dir):
    plan = catalogue.statement_from_tpch(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.split("\n") if "FileScan" in line]
    assert len(scans) == 4 and all("ReadSchema" in s for s in scans)
    assert not any("l_shipdate" in s or "o_orderpriority" in s for s in scans)
    plan = catalogue.failed_runs(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
