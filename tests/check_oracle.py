"""Run registered queries against their SQL on DuckDB: python tests/check_oracle.py [sf] [name-prefix ...]."""
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if pd.api.types.is_bool_dtype(s):
            df[c] = s.map(str)
        elif pd.api.types.is_numeric_dtype(s):
            df[c] = s.astype("float64").add(0.0)
        elif pd.api.types.is_datetime64_any_dtype(s):
            df[c] = s.dt.strftime("%Y-%m-%d %H:%M:%S.%f")
        else:
            first = s.dropna()
            if len(first) and type(first.iloc[0]).__name__ == "Decimal":
                df[c] = s.astype("float64")
            else:
                df[c] = s.map(lambda v: None if v is None or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else str(v))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def kind(t: str) -> str:
    t = t.lower()
    if t.startswith("decimal"):
        return "decimal"
    return {"bigint": "long", "hugeint": "hugeint", "integer": "int", "double": "double", "varchar": "string", "timestamp": "timestamp_ntz"}.get(t, t)


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    got_types = {f.name: f.dataType.simpleString().replace("bigint", "long") for f in df.schema.fields}
    got = df.toPandas()
    took = time.time() - start
    if sql is None:
        return True, f"rows-only {len(got)} rows", took
    rel = con.sql(sql)
    want_types = {c: kind(str(t)) for c, t in zip(rel.columns, rel.types)}
    want = rel.df()
    for c, t in zip(rel.columns, rel.types):
        if str(t) == "DATE":
            want[c] = want[c].map(lambda v: None if pd.isna(v) else str(v)[:10])
    if set(got.columns) != set(want.columns):
        return False, f"columns {sorted(got.columns)} vs {sorted(want.columns)}", took
    notes = [f"{c}:{got_types[c]}/{want_types[c]}" for c in got_types if got_types[c] != want_types[c]]
    if len(got) != len(want):
        return False, f"rows {len(got)} vs {len(want)}", took
    a, b = canonical(got), canonical(want)
    bad = []
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            k = int((~same).sum())
            j = same.idxmin()
            bad.append(f"{c}: {k} differ, e.g. {a[c][j]!r} vs {b[c][j]!r}")
    filled = got.notna().mean().min() if len(got) else 0
    text = "; ".join(bad) if bad else f"ok {len(got)} rows, least filled {filled:.2f}"
    return not bad and len(got) > 0, text + (" TYPES " + " ".join(notes) if notes else ""), took


def main():
    from panelspark.session import build_session
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    only = sys.argv[2:]
    spark = build_session("local[8]", 8, **{"spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.execution.arrow.pyspark.enabled": "true"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, failed, total = entry.oracle_sql(), [], 0.0
    for name, fn in entry.queries().items():
        if only and not any(name.startswith(p) for p in only):
            continue
        try:
            ok, text, took = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as err:
            ok, text, took = False, f"{type(err).__name__}: {str(err)[:700]}", 0.0
        total += took
        if not ok:
            failed.append(name)
        print(f"{'PASS' if ok else 'FAIL'} {name} {took:.1f}s {text}", flush=True)
    print(f"{len(failed)} failed: {' '.join(failed)}; {total:.0f}s")


if __name__ == "__main__":
    main()
