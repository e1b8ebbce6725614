"""Order-insensitive comparison of a Spark result with an oracle result."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

from ..sources.tables import TABLES, table_path


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    return con


def norm(df: pd.DataFrame) -> list[tuple]:
    """Rows as tuples over name-sorted columns; doubles rounded to 6 places,
    integral floats as ints (pandas turns nullable ints into floats)."""
    cols = sorted(df.columns)
    out = []
    for row in df[cols].itertuples(index=False):
        r = []
        for v in row:
            if isinstance(v, np.integer):
                v = int(v)
            if isinstance(v, (float, np.floating)):
                v = float(v)
                r.append(None if v != v else (int(v) if v.is_integer() else round(v, 6)))
            elif v is pd.NA or v is pd.NaT or v is None:
                r.append(None)
            elif hasattr(v, "tolist"):
                r.append(str(v.tolist()))
            elif isinstance(v, (bytes, bytearray)):
                r.append(bytes(v).hex())
            elif isinstance(v, (int, bool)):
                r.append(v)
            else:
                r.append(str(v))
        out.append(tuple(r))
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))
