"""A query against its SQL twin on the small tables."""

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark labels pages conversations".split()


def compare(spark, module, name, sf_dir=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = module.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    result = con.execute(module.ORACLES[name])
    given = [d[0] for d in result.description]
    assert sorted(given) == columns
    want = [tuple(r[given.index(c)] for c in columns) for r in result.fetchall()]
    got = [tuple(r) for r in df.select(*columns).collect()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    return got
