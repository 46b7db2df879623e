"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

# One level of the reputation: groups of {keys} under the rates of the level above.
_LEVEL = """
g_{name} AS (
  SELECT {keys}, sum(n) AS n, sum(bad) AS bad, any_value(p.prior) AS prior
  FROM hosts h {join} GROUP BY {keys}),
s_{name} AS (
  SELECT round(greatest(1.0, least(1000.0, coalesce(
      CASE WHEN (seen - noise) / nullif(noise, 0) > 0
           THEN (n / g - 1) / ((seen - noise) / noise) - 1 ELSE 1000.0 END, 1000.0))), 6) AS strength
  FROM (SELECT *, within_ * g / nullif(n, 0) AS noise FROM (
    SELECT sum(n)::DOUBLE AS n, count(*)::DOUBLE AS g, sum(n * prior * (1 - prior)) AS within_,
           sum(n * pow(bad / n - prior, 2)) AS seen FROM g_{name} WHERE n > 0))),
r_{name} AS (
  SELECT {keys}, n, bad, (prior * strength + bad) / (strength + n) AS rate, strength + n AS total
  FROM g_{name}, s_{name})"""


def _url_sql() -> str:
    levels, keys = [], []
    for name, above in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        join = ("JOIN (SELECT " + ", ".join(keys) + f", rate AS prior FROM r_{above}) p USING ("
                + ", ".join(keys) + ")") if above else ", (SELECT prior FROM base) p"
        keys.append(name)
        levels.append(_LEVEL.format(name=name, keys=", ".join(keys), join=join))
    return f"""
WITH parsed AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
outcome AS (
  SELECT doc_id AS page_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1
    WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END AS bad FROM labels),
hosts AS (
  SELECT host, list_aggregate(string_split(host, '.')[-2:], 'string_agg', '.') AS domain,
    string_split(host, '.')[-1] AS suffix, count(bad) AS n, coalesce(sum(bad), 0) AS bad
  FROM parsed LEFT JOIN outcome USING (page_id) GROUP BY host),
base AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0.0) AS prior FROM hosts),
{",".join(levels)},
rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
  ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (
  SELECT p.page_id, p.host, p.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
    max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM parsed p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host))
    AND starts_with(p.path, r.path) GROUP BY ALL)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict,
    CASE WHEN round(greatest(0.0, rate - sqrt(rate * (1 - rate) / (total + 1))), 6) >= 0.25
    THEN 'block' ELSE 'allow' END) AS verdict,
  n::BIGINT AS n_labelled, bad::BIGINT AS n_bad, round(rate, 6) AS bad_rate,
  round(greatest(0.0, rate - sqrt(rate * (1 - rate) / (total + 1))), 6) AS bad_bound
FROM parsed p JOIN r_host h ON p.host = h.host LEFT JOIN fit f ON p.page_id = f.page_id"""


ORACLES["op7_url_filters"] = _url_sql()
