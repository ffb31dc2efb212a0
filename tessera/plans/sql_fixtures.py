"""Fixture grids as SQL text (DuckDB dialect) for the oracle queries.

Kept in step with ``tessera.sources.grids``; the oracle reads the same parquet
tables independently of Spark.
"""

GRID_A = """SELECT CAST(o_orderkey % 100 AS INTEGER) AS x,
       CAST(o_orderkey // 100 AS INTEGER) AS y,
       CAST(NULLIF(floor(o_totalprice) % 22, 0) AS INTEGER) AS v
FROM orders"""

GRID_B = """SELECT CAST(event_id % 100 AS INTEGER) AS x,
       CAST(event_id // 100 AS INTEGER) AS y,
       CAST(NULLIF(floor(value) % 22, 0) AS INTEGER) AS v
FROM events"""

GRID_C = """SELECT CAST(unnest(range(len(embedding))) AS INTEGER) AS x,
       CAST(vec_id AS INTEGER) AS y,
       CAST(unnest(embedding) AS DOUBLE) AS v
FROM embeddings"""

GRID_W = """SELECT x, y, CASE WHEN v IS NOT NULL THEN (k % 7 - 3) * 1200000000000000000 + p % 22 * 1000003 END AS v
FROM (SELECT CAST(o_orderkey % 100 AS INTEGER) AS x, CAST(o_orderkey // 100 AS INTEGER) AS y,
  NULLIF(floor(o_totalprice) % 22, 0) AS v, CAST(o_orderkey AS BIGINT) AS k, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders) o"""

GRID_U = """SELECT x, y, CASE WHEN v IS NOT NULL THEN CAST(18446744073709551615::HUGEINT - k % 9 * 1000000000000000003::HUGEINT - p AS DECIMAL(20,0)) END AS v
FROM (SELECT CAST(o_orderkey % 100 AS INTEGER) AS x, CAST(o_orderkey // 100 AS INTEGER) AS y,
  NULLIF(floor(o_totalprice) % 22, 0) AS v, CAST(o_orderkey AS HUGEINT) AS k, CAST(floor(o_totalprice) AS HUGEINT) AS p FROM orders) o"""

GRIDS = {"A": GRID_A, "B": GRID_B, "C": GRID_C, "W": GRID_W, "U": GRID_U}


def with_grids(body: str, *names: str) -> str:
    """Prefix a query with CTEs ``a``, ``b``, ``c`` for the named grids."""
    ctes = ",\n".join(f"{n.lower()} AS ({GRIDS[n]})" for n in names)
    return f"WITH {ctes}\n{body}" if ctes else body


def with_ctes(body: str, grids: tuple[str, ...], extra: list[tuple[str, str]]) -> str:
    parts = [f"{n.lower()} AS ({GRIDS[n]})" for n in grids] + [f"{k} AS ({q})" for k, q in extra]
    return "WITH " + ",\n".join(parts) + "\n" + body
