"""The mix in DuckDB SQL: the same targets and thresholds by window sums over sorted hashes."""


def mix_sql(table: str = "documents") -> str:
    """CTEs that end in `mixed`: doc_id, size, source_size, target, copies of the rows of table."""
    return f"""
items AS (
  SELECT *, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 15))::BIGINT AS hash
  FROM {table}),
sources AS (
  SELECT skey, sum(size)::BIGINT AS source_size,
         ([3, 1, 2])[(row_number() OVER (ORDER BY skey COLLATE "binary") - 1) % 3 + 1]::DOUBLE AS weight
  FROM items GROUP BY skey),
rated AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM sources),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources)::DOUBLE * 1.5::DOUBLE
            - (sum(cap) OVER (ORDER BY ratio, skey ROWS UNBOUNDED PRECEDING) - cap))
            / sum(weight) OVER (ORDER BY ratio, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM rated),
water AS (SELECT lvl AS w FROM levels WHERE lvl <= ratio ORDER BY ratio, skey LIMIT 1),
targets AS (
  SELECT skey, source_size,
         CASE WHEN (SELECT w FROM water) IS NULL OR (SELECT w FROM water) > ratio THEN cap ELSE (SELECT w FROM water) * weight END AS target
  FROM levels),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM targets),
numbered AS (SELECT *, row_number() OVER (PARTITION BY skey, hash ORDER BY size) AS turn FROM items),
hashes AS (SELECT skey, hash, sum(size) AS size, count(*) AS n FROM items GROUP BY ALL),
edges AS (
  SELECT h.skey, h.hash, h.size, h.n, p.target - p.passes * p.source_size AS budget,
         sum(h.size) OVER (PARTITION BY h.skey ORDER BY h.hash ROWS UNBOUNDED PRECEDING) - h.size AS start
  FROM hashes h JOIN plans p USING (skey)),
ends AS (
  SELECT skey, hash AS at, CASE WHEN size > 0 THEN least(n, ceil((budget - start) * n / size - 0.5)) WHEN budget > start THEN n ELSE 0 END AS more
  FROM edges WHERE budget > 0 AND start <= budget QUALIFY row_number() OVER (PARTITION BY skey ORDER BY hash DESC) = 1),
mixed AS (
  SELECT i.* EXCLUDE (skey), p.source_size, p.target,
         p.passes + CASE WHEN i.hash < e.at OR (i.hash = e.at AND i.turn <= e.more) THEN 1 ELSE 0 END AS copies
  FROM numbered i JOIN plans p USING (skey) LEFT JOIN ends e USING (skey))"""


OP8_SQL = f"WITH {mix_sql()} SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken FROM mixed"
