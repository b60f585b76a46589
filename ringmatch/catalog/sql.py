"""Text blocks for the DuckDB oracles."""

from __future__ import annotations


def seed(*items: str) -> str:
    """SQL for the stable seed; items are SQL expressions."""
    text = "concat_ws('::', " + ", ".join(f"CAST({i} AS VARCHAR)" for i in items) + ")"
    h = f"sha256({text})"
    swapped = " || ".join(f"substr({h}, {p}, 2)" for p in (7, 5, 3, 1))
    return f"CAST(CAST('0x' || {swapped} AS UBIGINT) AS BIGINT)"


def q(expression: str, scale: str = "1000000.0::DOUBLE") -> str:
    """Fixed-point form of a double."""
    return f"CAST(floor(({expression}) * {scale} + 0.5::DOUBLE) AS BIGINT)"


def seven(key: str) -> str:
    return f"lpad(CAST({key} AS VARCHAR), CAST(greatest(7, length(CAST({key} AS VARCHAR))) AS INTEGER), '0')"


GALLERY = f"""
gallery AS (
  SELECT {seven('vec_id')} AS id, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v
  FROM embeddings)"""

QUERIES = f"""{GALLERY},
mixed AS (
  SELECT g.id AS query_id, g.vec_id, CAST(f.fov AS BIGINT) AS fov_deg, f.fov // 45 AS nv, g.v AS e, p.v AS ep,
         {seed("42", "'fixture'", "'val'", "1", "g.id", "f.fov", "'roll'")} % 8 AS r
  FROM gallery g CROSS JOIN (VALUES (360), (180), (90), (45)) f(fov)
  JOIN gallery p ON p.vec_id = (g.vec_id * 7 + 3) % (SELECT count(*) FROM embeddings)),
queries AS (
  SELECT query_id, vec_id, fov_deg, nv, r,
         list_transform(range(64), lambda i: CASE WHEN i // 8 < nv
           THEN 0.6::DOUBLE * e[((i // 8 + r) % 8) * 8 + i % 8 + 1]
              + 0.4::DOUBLE * ep[((i // 8 + r) % 8) * 8 + i % 8 + 1] ELSE 0.0::DOUBLE END) AS v
  FROM mixed)"""

ROTATED = """
rotated AS (
  SELECT g.id AS gid, k, list_concat(g.v[k * 8 + 1:64], g.v[1:k * 8]) AS rv
  FROM gallery g CROSS JOIN range(8) t(k))"""

SCORES = f"""{QUERIES},{ROTATED},
logits AS (
  SELECT query_id, fov_deg, gid, k, {q("list_inner_product(v, rv) / nv")} AS s
  FROM queries CROSS JOIN rotated),
scores AS (
  SELECT query_id, fov_deg, gid, max(s) AS s, arg_min(k, (-s, k)) AS k
  FROM logits GROUP BY query_id, fov_deg, gid)"""

RANKS = f"""{SCORES},
ranks AS (
  SELECT p.query_id, p.fov_deg, p.s AS ps, p.k AS pk,
         1 + count(*) FILTER (WHERE o.gid <> p.gid AND (o.s > p.s OR (o.s = p.s AND o.gid < p.gid))) AS rank,
         arg_min(o.gid, (-o.s, o.gid)) AS top1_id, max(o.s) AS top1_s, arg_min(o.k, (-o.s, o.gid)) AS top1_k
  FROM scores p JOIN scores o ON o.query_id = p.query_id AND o.fov_deg = p.fov_deg
  WHERE p.gid = p.query_id GROUP BY ALL)"""

BUCKET = seed("id") + " % 5"

PAIRS = f"""
keyed AS (
  SELECT o_orderkey, {seven('o_orderkey')} AS id, row_number() OVER (ORDER BY o_orderkey) AS ordinal FROM orders),
pairs AS (SELECT *, {BUCKET} AS bucket FROM keyed)"""

MANIFEST = f"""{PAIRS},
manifest AS (
  SELECT 'pano' AS dataset, s.split AS split, id AS query_id, 'ground/' || id || '.jpg' AS query_path,
         id AS satellite_id, 'tile/' || id || '.jpg' AS satellite_path, 'orders' AS source_mat_struct,
         ordinal AS source_mat_index
  FROM pairs JOIN (VALUES ('val', 0, 0), ('test', 0, 1), ('train', 2, 4)) s(split, lo, hi)
    ON bucket BETWEEN s.lo AND s.hi)"""

LISTING = f"""
listing AS (SELECT DISTINCT 'tile/' || {seven('l_orderkey')} || '.jpg' AS path FROM lineitem)"""
