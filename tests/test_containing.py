import duckdb

from keelson.plans import catalog


def test_short_items_are_contained_as_their_sql_says(spark, tmp_path):
    words = "Alpha beta, gamma delta eps zeta eta theta iota".split()
    items = [(n, " ".join(words[:n])) for n in range(1, 10)] + [(20, "eta the"), (21, "--"), (22, ""), (23, None), (24, "not there"), (25, "beta, gamma  delta eps zeta eta the")]
    docs = [(1, "so " + " ".join(words) + " end"), (2, " ".join(words[:7]) + "s"), (3, " ".join(words[:3])), (4, "alpha"), (5, None), (6, ""), (7, "Alphabet -- "), (8, " ".join(words[:8]) + "x")]
    for name, schema, rows in (("benchmark", "item_id long, text string", items), ("documents", "doc_id long, text string", docs)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(con.execute(catalog.SQL["containing_records"]).fetchall())
    got = sorted(map(tuple, catalog.QUERIES["containing_records"](spark, str(tmp_path)).collect()))
    assert got == want and {i for i, _ in want} >= {*range(1, 10), 20, 21, 22, 25}
