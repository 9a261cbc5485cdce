"""Compare Spark queries with their DuckDB oracle: python tests/oracle_check.py [sf_dir] [keys]"""
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return round(float(v), 6)
    except Exception:
        pass
    return v


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT"}


def type_diffs(df, con, sql):
    st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
          for f in df.schema.fields}
    ot = {r[0]: r[1] for r in con.execute(f"DESCRIBE ({sql})").fetchall()}
    return {c: (st.get(c), ot.get(c)) for c in set(st) | set(ot) if st.get(c) != ot.get(c)}


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr), [cols[i] for i in order]


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    import __spark_entry__ as E
    from matchsmith.session import get_spark
    spark = get_spark()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for k in keys or list(qs):
        t0 = time.time()
        try:
            df = qs[k](spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"{k:32s} SPARK-ERROR {str(e)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if k not in sqls:
            print(f"{k:32s} rows={len(srows)} (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(sqls[k])
            ocols = [d[0] for d in res.description]
            orows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{k:32s} SQL-ERROR {str(e)[:300]}")
            bad += 1
            continue
        a, ac = rows_of(scols, srows)
        b, bc = rows_of(ocols, orows)
        td = type_diffs(df, con, sqls[k])
        if td:
            print(f"{k:32s} TYPE-MISMATCH {td}")
        ok = a == b and ac == bc and not td
        if not ok:
            bad += 1
            print(f"{k:32s} MISMATCH spark={len(a)} {ac} oracle={len(b)} {bc}")
            sa, sb = set(a), set(b)
            print("   only spark:", list(sa - sb)[:3])
            print("   only oracle:", list(sb - sa)[:3])
        else:
            print(f"{k:32s} ok rows={len(a)} {ts:.1f}s")
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
