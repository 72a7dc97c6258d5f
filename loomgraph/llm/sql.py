"""SQL that several of this folder's queries share."""

#: CTEs for crc32 of strings, after WITH RECURSIVE; ``{keys}`` selects the strings as ``s``.  ``crc_of``: (s, crc).
CRC32 = """
crc_bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM crc_bits WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE k = 8),
crc_keys AS (SELECT DISTINCT s, hex(encode(s)) AS x FROM ({keys})),
crc_run(s, x, p, c) AS (
  SELECT s, x, 0, 4294967295::BIGINT FROM crc_keys
  UNION ALL
  SELECT s, x, p + 1, xor(c >> 8, t[(xor(c, ('0x' || substr(x, 2 * p + 1, 2))::BIGINT) & 255) + 1])
  FROM crc_run, crc_table WHERE 2 * p < length(x)
), crc_of AS (SELECT s, xor(c, 4294967295::BIGINT) AS crc FROM crc_run WHERE 2 * p = length(x))"""
