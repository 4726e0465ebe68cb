"""Side-by-side run of a query and its SQL."""

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows(frame: pd.DataFrame):
    columns = sorted(frame.columns)

    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or type(v).__module__ == "numpy":
            return str(int(v))
        return str(v)

    key = [tuple(cell(v) for v in r) for r in frame[columns].itertuples(index=False)]
    return columns, sorted(key, key=lambda r: tuple((x is not None, x or "") for x in r))


def difference(ours: pd.DataFrame, theirs: pd.DataFrame):
    """None if equal, else a short description."""
    a_cols, a = rows(ours)
    b_cols, b = rows(theirs)
    if a_cols != b_cols:
        return f"columns {a_cols} != {b_cols}"
    if a == b:
        return None
    sa, sb = set(a), set(b)
    return f"rows {len(a)} vs {len(b)}; only ours {list(sa - sb)[:2]}; only sql {list(sb - sa)[:2]}"
