"""The queries of databases over small odd tables, against their SQL."""

import __spark_entry__
import duckdb
import pytest

CUSTOMERS, SUPPLIERS = [(i, f"c{i}") for i in range(6)], [(i, f"s{i}") for i in range(1, 3)]


def compared(spark, folder, name, customers=CUSTOMERS, suppliers=SUPPLIERS):
    spark.createDataFrame(customers, "c_custkey long, c_name string").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(i, f"n{i}") for i in range(2, 4)], "n_nationkey int, n_name string").write.parquet(f"{folder}/nation.parquet")
    with duckdb.connect() as db:
        for t in ("customer", "supplier", "nation"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
        want = db.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    return sorted(map(repr, map(tuple, __spark_entry__.queries()[name](spark, str(folder)).collect()))), sorted(map(repr, want))


@pytest.mark.parametrize("name", ["job_entries", "table_round_trip", "insert_update", "delete_rows"])
def test_names_of_any_length(spark, tmp_path, name):
    texts = ["", None, " x ", 'a,"b"', "li\nne\r\n", "é漢", "x" * 61, "y" * 40_000]
    got, want = compared(spark, tmp_path, name, list(enumerate(texts)), [*SUPPLIERS, (3, "z" * 57), (9, "z" * 40_000)])
    assert got == want


@pytest.mark.parametrize("name", ["job_entries", "table_round_trip", "insert_update"])
def test_missing_and_repeated_keys(spark, tmp_path, name):
    got, want = compared(spark, tmp_path, name, [*CUSTOMERS, (None, "n"), (None, "m"), (1, "again"), (3, "c3")])
    assert got == want


@pytest.mark.parametrize("customers", [CUSTOMERS, [*CUSTOMERS, (None, "n"), (1, "again"), (2, "again")]])
def test_suppliers_without_key_or_name(spark, tmp_path, customers):
    suppliers = [*SUPPLIERS, (None, "s"), (None, "t"), (None, "s"), (None, None), (3, None), (77, None), (4, "")]
    got, want = compared(spark, tmp_path, "insert_update", customers, suppliers)
    assert got == want
