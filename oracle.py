"""SQL equivalents of the registered queries, for DuckDB over the same tables.

Each statement derives its rows from the tables by its own means.  Where a query undoes a disguise
or an encoding, the statement states the text that was disguised.
"""

from __future__ import annotations

from veilscan.functions import paths, placeholders
from veilscan.functions.regex import to_re2
from veilscan.operators.score import REPORT_ORDER
from veilscan.plans.queries import CUSTOM_RULES
from veilscan.rules import Rule, builtin_rules
from veilscan.rules.catalog import LOOK_UP
from veilscan.rules.remediation import STEPS

ZWSP = "\u200b"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


# -- shared pieces ------------------------------------------------------------------------------

KEYS = """keys AS (
  SELECT k, h, 'AK' || 'IA' || upper(substr(h, 1, 16)) AS ak
  FROM (SELECT o_orderkey AS k, md5(CAST(o_orderkey AS VARCHAR)) AS h FROM orders))"""

SEEDED = KEYS + """, seeded AS (
  SELECT 'src/m' || (k % 7) || CASE WHEN k % 3 = 0 THEN '/tests/' ELSE '/' END
         || 'f' || (k % 50) || '.ts' AS path,
         k AS line, k % 10 AS kind,
         CASE k % 10
           WHEN 0 THEN 'aws_access_key_id = ' || ak
           WHEN 1 THEN 'registry auth npm_' || h || substr(h, 1, 4)
           WHEN 2 THEN 'password: "' || substr(h, 1, 12) || '"'
           WHEN 3 THEN 'Authorization: Bearer ' || h
           WHEN 4 THEN 'k = "' || ak || '" // scan:ignore'
           WHEN 5 THEN 'url postgres://svc:' || substr(h, 1, 14) || '@db.internal:5432/app'
           WHEN 6 THEN 'blob ' || to_base64(encode(ak))
           WHEN 7 THEN 'blob ' || lower(hex(encode(ak)))
           WHEN 8 THEN 'api_key = "change_me_' || h || '"'
           ELSE 'order note ' || h
         END AS text
  FROM keys)"""

# Direct texts, and the texts decoded from Base64 or hex tokens; offset is the token's start.
SEEDED_SEGMENTS = SEEDED + """, segs AS (
  SELECT path, line, text, 0 AS depth, 0 AS "offset" FROM seeded WHERE kind <> 4
  UNION ALL
  SELECT path, line, decode(from_base64(substr(text, 6))), 1, 5 FROM seeded WHERE kind = 6
  UNION ALL
  SELECT path, line, decode(unhex(substr(text, 6))), 1, 5 FROM seeded WHERE kind = 7)"""

CORPUS = """corpus AS (
  SELECT 'documents/' || doc_id || '.txt' AS path, text AS content FROM documents
  UNION ALL SELECT url, html FROM pages
  UNION ALL SELECT 'conversations/' || conv_id || '#' || turn, text FROM conversations)"""

LINES = """lines AS (
  SELECT path, i AS line, parts[i] AS text, CASE WHEN i > 1 THEN parts[i - 1] END AS prev_text,
         len(parts) AS n
  FROM (SELECT path, string_split_regex(content, '\\r?\\n') AS parts FROM corpus)
  CROSS JOIN LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i))"""


def entropy(s: str) -> str:
    share = f"(length({s}) - length(replace({s}, c, ''))) / CAST(length({s}) AS DOUBLE)"
    return (f"coalesce(-list_sum(list_transform(list_distinct(string_split({s}, '')), "
            f"lambda c: {share} * log2({share}))), 0)")


def mask(s: str) -> str:
    shown = f"least(4, CAST(floor(length({s}) * 0.25) AS INTEGER))"
    return (f"CASE WHEN length({s}) <= 6 THEN repeat('*', length({s})) ELSE "
            f"left({s}, {shown} // 2) || repeat('*', length({s}) - {shown}) || "
            f"right({s}, {shown} - {shown} // 2) END")


def charset(s: str) -> str:
    return (f"CASE WHEN regexp_full_match({s}, '[0-9a-fA-F]+') THEN 'hex' "
            f"WHEN regexp_full_match({s}, '[a-zA-Z0-9+/=_-]+') THEN 'base64' ELSE 'ascii' END")


def high_entropy(s: str) -> str:
    floor = f"CASE {charset(s)} WHEN 'hex' THEN 3.0 WHEN 'base64' THEN 4.2 ELSE 4.5 END"
    return f"(length({s}) >= 16 AND round({entropy(s)}, 9) >= {floor})"


def test_or_doc(p: str) -> str:
    low = f"lower(replace({p}, '\\', '/'))"
    return (f"(regexp_matches({low}, '\\.mdx?$') OR "
            f"list_has_any(string_split({low}, '/'), {words(paths.TEST_DIRECTORIES)}) OR "
            f"regexp_matches({low}, '\\.(test|spec|fixture|mock)\\.[^./]+$'))")


def contains_any(s: str, items) -> str:
    return "(" + " OR ".join(f"contains({s}, {q(i)})" for i in items) + ")"


def placeholder(s: str, p: str) -> str:
    low = f"lower({s})"
    exact = placeholders.DOCUMENTATION_KEYS + placeholders.PLACEHOLDERS
    return (f"({low} IN ({', '.join(q(w) for w in exact)}) OR "
            f"{contains_any(low, placeholders.OBVIOUS_PLACEHOLDERS + placeholders.SAMPLE_MARKS)} OR "
            f"({test_or_doc(p)} AND ({contains_any(low, placeholders.PLACEHOLDERS)} OR "
            f"(len(list_distinct(string_split({s}, ''))) <= 2 AND length({s}) > 6))))")


def sql_pattern(rule: Rule) -> str:
    """RE2 form with two spare groups; look-ahead, which RE2 lacks, is left out.

    The only rule with look-ahead is the password assignment, and the texts it is checked on here
    have none of the values it excludes.
    """
    source = rule.source
    if rule.rule_id == "generic-password":
        source = source.replace(LOOK_UP, "")
    flags = "(?i)" if "i" in rule.flags else ""
    return f"{flags}(?:{to_re2(source)})()()"


def rules_cte(rules: list[Rule]) -> str:
    rows = []
    for i, rule in enumerate(rules):
        floor = "NULL" if rule.min_entropy is None else str(float(rule.min_entropy))
        rows.append(
            f"({q(rule.rule_id)}, {i}, {q(rule.name or rule.rule_id)}, {q(rule.severity)}, "
            f"{q(sql_pattern(rule))}, {rule.secret_group}, {rule.fallback_group}, {floor}, "
            f"{str(rule.requires_entropy).upper()}, "
            f"{words([k.lower() for k in rule.keywords])}, {q(rule.scope)})")
    return ("rules(rule_id, rule_ord, rule_name, severity, pattern, g1, g2, min_entropy, "
            "requires_entropy, keywords, scope) AS (VALUES " + ",\n".join(rows) + ")")


def findings_ctes(rules: list[Rule], carry: str = "") -> str:
    """``found``: all findings of ``segs(path, line, text, depth, offset)``."""
    extra = "".join(f", {c}" for c in carry.split()) if carry else ""
    return rules_cte(rules) + f""", gate AS MATERIALIZED (
  SELECT DISTINCT s.path, s.line, s.text, s.depth, s."offset"{extra}, r.rule_ord
  FROM segs s JOIN (SELECT rule_ord, unnest(keywords) AS kw FROM rules) r
    ON contains(lower(s.text), r.kw)
), hits AS MATERIALIZED (
  SELECT g.*, r.* EXCLUDE (rule_ord, keywords),
         regexp_extract_all(g.text, r.pattern, 0) AS h0
  FROM gate g JOIN rules r USING (rule_ord)
  WHERE regexp_matches(g.text, r.pattern)
), spans AS (
  SELECT *, string_split_regex(text, pattern) AS gaps,
         CASE g1 WHEN 0 THEN h0 WHEN 1 THEN regexp_extract_all(text, pattern, 1)
                 ELSE regexp_extract_all(text, pattern, 2) END AS first,
         CASE g2 WHEN 2 THEN regexp_extract_all(text, pattern, 2) ELSE h0 END AS second
  FROM hits
), each_match AS (
  SELECT *, h0[i] AS matched,
         coalesce(nullif(first[i], ''), nullif(second[i], ''), h0[i]) AS secret,
         coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0)
         + coalesce(list_sum(list_transform(h0[1:i - 1], lambda g: length(g))), 0) AS pos
  FROM spans CROSS JOIN LATERAL (SELECT unnest(range(1, len(h0) + 1)) AS i)
), found AS MATERIALIZED (
  SELECT rule_id, rule_ord, rule_name, severity, path, line, depth{extra}, secret,
         CAST("offset" + pos + greatest(instr(matched, secret), 1) AS BIGINT) AS "column",
         {mask('secret')} AS masked_value,
         sha256(path || ':' || rule_id || ':' || secret) AS secret_hash,
         sha256(secret) AS secret_sha
  FROM each_match
  WHERE scope <> 'raw' AND NOT {placeholder('secret', 'path')}
    AND (NOT requires_entropy OR {high_entropy('secret')})
    AND (min_entropy IS NULL OR round({entropy('secret')}, 9) >= min_entropy)
)"""


def only(*ids: str) -> list[Rule]:
    return [rule for rule in builtin_rules() if rule.rule_id in ids]


def custom() -> list[Rule]:
    return [
        Rule(d["id"], d["regex"], tuple(d["keywords"]), d["severity"], "g", d.get("minEntropy"),
             d.get("minEntropy") is not None, d["name"])
        for d in CUSTOM_RULES
    ]


KEY_LIST = 'path, line, "column", rule_id, severity, masked_value, secret_hash'


def seeded(select: str, rules: list[Rule] | None = None, more: str = "") -> str:
    """A statement over ``found``, the findings of the whole seeded corpus."""
    ctes = findings_ctes(builtin_rules() if rules is None else rules)
    return f"WITH {SEEDED_SEGMENTS}, {ctes}{more}\n{select}"


WEIGHT = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
FINGERPRINT = "sha256(replace(path, '\\', '/') || ':' || rule_id || ':' || secret_hash)"
PENALTY = "CASE w WHEN 4 THEN 35 WHEN 3 THEN 20 WHEN 2 THEN 10 ELSE 5 END"
TIER = ("CASE WHEN score >= 90 THEN 'Excellent' WHEN score >= 75 THEN 'Good' "
        "WHEN score >= 50 THEN 'Warning' ELSE 'Critical' END")
SARIF_LEVEL = "CASE severity WHEN 'medium' THEN 'warning' WHEN 'low' THEN 'note' ELSE 'error' END"

CONFIGS = KEYS + """, conf AS (
  SELECT k, h, ak, 'conf/c' || k || CASE k % 4 WHEN 1 THEN '.env' WHEN 3 THEN '.txt'
                                    ELSE '.json' END AS path FROM keys)"""

# Synthetic lines of structured files, plain lines of the others.
CONFIG_SEGMENTS = CONFIGS + """, conf_lines AS (
  SELECT path, 1 AS line, 'a.id' AS leaf_path, 'id: ' || ak AS text FROM conf WHERE k % 4 = 0
  UNION ALL SELECT path, 1, 'a.n.1', '1: ' || h FROM conf WHERE k % 4 = 0
  UNION ALL SELECT path, 1, 'a.n.2.password', 'password: ' || substr(h, 1, 14)
            FROM conf WHERE k % 4 = 0
  UNION ALL SELECT path, 3, NULL, 'ID: ' || ak FROM conf WHERE k % 4 = 1
  UNION ALL SELECT path, 4, NULL, 'DB_PASSWORD: ' || substr(h, 1, 14) FROM conf WHERE k % 4 = 1
  UNION ALL SELECT path, 6, NULL, 'X: y' FROM conf WHERE k % 4 = 1
  UNION ALL SELECT path, 1, NULL, '{"a": "' || ak FROM conf WHERE k % 4 = 2
  UNION ALL SELECT path, 2, NULL, 'id ' || ak FROM conf WHERE k % 4 = 3)"""

ENCODED = KEYS + """, enc AS (
  SELECT k, ak, CASE k % 9 WHEN 1 THEN 2 WHEN 3 THEN 2 ELSE 1 END AS depth,
         CASE k % 9 WHEN 0 THEN 'base64' WHEN 1 THEN 'base64' WHEN 2 THEN 'hex'
                    WHEN 3 THEN 'base64' WHEN 4 THEN 'bytes' WHEN 5 THEN 'reversed'
                    WHEN 6 THEN 'percent' WHEN 7 THEN 'base32' ELSE 'ascii85' END AS codec
  FROM keys)"""

SNAPSHOTS = KEYS + """, files AS (
  SELECT k, CASE WHEN k % 97 = 0 THEN 'src/../' ELSE 'src/' END || 'f' || k || '.txt' AS path,
         CASE WHEN k % 31 = 0 THEN '120000' ELSE '100644' END AS mode,
         'note ' || h || chr(10) || CASE WHEN k % 17 = 0 THEN 'id ' || ak ELSE 'plain' END AS old,
         ak
  FROM keys
), cur AS (
  SELECT k, path, mode, ak, old || CASE WHEN k % 5 = 0 THEN chr(10) || 'id ' || ak ELSE '' END AS now
  FROM files WHERE k % 13 <> 0
), prev AS (SELECT path, old FROM files WHERE k % 11 <> 0
), changed AS (
  SELECT cur.*, CASE WHEN k % 97 = 0 THEN 'path-traversal' WHEN mode = '120000' THEN 'symlink'
                     WHEN k % 41 = 0 THEN 'binary (null-check)' ELSE 'scanned' END AS status
  FROM cur LEFT JOIN prev USING (path)
  WHERE prev.old IS NULL OR prev.old <> cur.now OR k % 41 = 0)"""

HISTORY = KEYS + """, commits AS (
  SELECT k, h, ak, h AS "commit", 'Dev | ' || (k % 5) AS commit_author,
         strftime(DATE '2024-01-01' + CAST(k % 300 AS INTEGER), '%Y-%m-%d') || 'T00:00:00+00:00'
           AS commit_date
  FROM keys
), added AS (
  SELECT k, "commit", commit_author, commit_date, 'src/a' || (k % 40) || '.ts' AS path,
         k % 100 + 1 AS line, 'id ' || ak AS text FROM commits
  UNION ALL SELECT k, "commit", commit_author, commit_date, 'src/a' || (k % 40) || '.ts',
         k % 100 + 2, '++ plus ' || k FROM commits
  UNION ALL SELECT k, "commit", commit_author, commit_date, 'src/a' || (k % 40) || '.ts',
         k % 100 + 60, 'last ' || h FROM commits
  UNION ALL SELECT k, "commit", commit_author, commit_date, 'y' || k || '.md', 1,
         'url postgres://u:' || substr(h, 1, 12) || '@db/x' FROM commits WHERE k % 4 <> 0)"""


def history_scan(ids: tuple[str, ...], select: str, where: str = "TRUE") -> str:
    return (
        f"WITH {HISTORY}, segs AS (SELECT path, line, text, 0 AS depth, 0 AS \"offset\", "
        f"\"commit\", commit_author, commit_date FROM added WHERE {where}), "
        + findings_ctes(only(*ids), '"commit" commit_author commit_date') + "\n" + select)


def json_text(expr: str) -> str:
    """A JSON string literal of a text with nothing to escape but quotes and backslashes."""
    return f"""'"' || replace(replace({expr}, '\\', '\\\\'), '"', '\\"') || '"'"""


def normalized(expr: str) -> str:
    """The normalisation steps that are plain replacements (the texts hold nothing for the rest)."""
    space = to_re2(r"\s")
    expr = f"regexp_replace({expr}, '[\\x{{200B}}-\\x{{200D}}\\x{{FEFF}}]', '', 'g')"
    expr = f"regexp_replace({expr}, '/\\*(?s:.*?)\\*/', '', 'g')"
    expr = f"regexp_replace({expr}, '[\"'']{space}*\\+?{space}*[\"'']', '', 'g')"
    expr = f"regexp_replace({expr}, '\\{{\\{{|\\}}\\}}|<%[=\\-]?|-?%>', '', 'g')"
    return f"translate({expr}, 'АаВСсЕеОоРрХхМНТ', 'aaBcceeooppxxMHT')"


def _text_preparation() -> dict[str, str]:
    docs_lines = "corpus AS (SELECT 'documents/' || doc_id || '.txt' AS path, text AS content FROM documents), " + LINES
    pages_lines = "corpus AS (SELECT url AS path, html AS content FROM pages), " + LINES
    odd = " OR ".join(
        f"(length(text) - length(replace(text, {q(c)}, ''))) % 2 = 1" for c in ("`", '"', "'"))
    quote = " OR ".join(f"contains({{}}, {q(c)})" for c in ("`", '"', "'"))
    ws = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279)"
    return {
        "lines_documents": f"""WITH {docs_lines}
SELECT path, line, length(text) AS n_chars, md5(text) AS text_md5, md5(prev_text) AS prev_md5
FROM lines""",
        "lines_pages": f"""WITH {pages_lines}
SELECT path, count(*) AS lines, max(length(text)) AS longest, sum(length(text)) AS chars
FROM lines GROUP BY path""",
        "merged_lines": f"""WITH RECURSIVE {CORPUS}, {LINES}, ahead AS (
  SELECT *, lead(text, 1) OVER w AS next1, lead(text, 2) OVER w AS next2
  FROM lines WINDOW w AS (PARTITION BY path ORDER BY line)
), taking AS (
  SELECT *, CASE WHEN NOT ({odd} OR regexp_matches(trim(text, {ws}), '[+\\\\]$')) OR line = n THEN 0
                 WHEN {quote.replace('{}', 'next1')} OR line + 1 = n THEN 1 ELSE 2 END AS taken
  FROM ahead
), reached(path, line) AS (
  SELECT path, 1 FROM taking WHERE line = 1
  UNION ALL
  SELECT t.path, CAST(t.line + 1 + t.taken AS INTEGER)
  FROM reached r JOIN taking t ON t.path = r.path AND t.line = r.line
  WHERE t.line + 1 + t.taken <= t.n
)
SELECT path, line + taken AS line,
       md5(CASE taken WHEN 0 THEN text
                      WHEN 1 THEN rtrim(text, {ws}) || trim(next1, {ws})
                      ELSE rtrim(text, {ws}) || trim(next1, {ws}) || trim(next2, {ws}) END) AS text_md5,
       md5(prev_text) AS prev_md5
FROM taking JOIN reached USING (path, line)""",
        "long_line_chunks": """WITH one AS (
  SELECT 'documents/' || doc_id || '.txt' AS path, replace(text, chr(10), ' ') AS text FROM documents
), cuts AS (
  SELECT path, text, CAST(s AS INTEGER) AS col_shift FROM one CROSS JOIN LATERAL (
    SELECT unnest(range(0, 1 + greatest(0, CAST(ceil((length(text) - 4096) / 3840.0) AS INTEGER)))) * 3840 AS s))
SELECT path, col_shift, length(substr(text, col_shift + 1, 4096)) AS n_chars,
       md5(substr(text, col_shift + 1, 4096)) AS text_md5 FROM cuts""",
        "wrapped_base64": f"""WITH {KEYS}
SELECT k, CASE WHEN k % 2 = 1 THEN h || '!'
               WHEN k % 3 = 0 THEN to_base64(encode(h)) || to_base64(encode(h))
               ELSE to_base64(encode(h || h)) || to_base64(encode(h)) END AS text
FROM keys""",
        "byte_sizes": f"""WITH {KEYS}, lits AS (
  SELECT k, (k % 100) || CASE WHEN k % 2 = 0 THEN '.5' ELSE '' END
         || CASE k % 8 WHEN 0 THEN 'B' WHEN 1 THEN 'KB' WHEN 2 THEN ' k' WHEN 3 THEN 'mb'
                       WHEN 4 THEN ' M' WHEN 5 THEN 'GB' WHEN 6 THEN '' ELSE 'TB' END AS literal,
         (k % 100) + CASE WHEN k % 2 = 0 THEN 0.5 ELSE 0 END AS num FROM keys)
SELECT k, literal, nullif(CAST(floor(CASE k % 8
    WHEN 0 THEN num WHEN 1 THEN num * 1024 WHEN 2 THEN num * 1024 WHEN 3 THEN num * 1048576
    WHEN 4 THEN num * 1048576 WHEN 5 THEN num * 1073741824 WHEN 6 THEN num END) AS BIGINT), 0) AS bytes
FROM lits""",
        "decoded_bytes": """SELECT doc_id, length(text) AS n_chars, md5(text) AS text_md5
FROM documents""",
        "env_file_entries": f"""WITH {CONFIG_SEGMENTS}
SELECT path, line, text FROM conf_lines WHERE path LIKE '%.env'""",
        "json_leaves_events": """SELECT event_id, 'id' AS key, 'user.id' AS leaf_path, 'u' || user_id AS value FROM events
UNION ALL SELECT event_id, '0', 'user.seen.0', event_type FROM events
UNION ALL SELECT event_id, '0', 'user.seen.1.deep.er.est.0', 'x' || (event_id % 7) FROM events""",
        "structured_findings": f"""WITH {CONFIG_SEGMENTS}, segs AS (
  SELECT path, line, text, 0 AS depth, 0 AS "offset", leaf_path FROM conf_lines),
{findings_ctes(builtin_rules(), 'leaf_path')}
SELECT {KEY_LIST}, leaf_path FROM found""",
    }


def _normalisation_and_decoding() -> dict[str, str]:
    key = f"""sha256('src/{{}}.ts:aws-access-key:' || ak) AS secret_hash"""
    pages_lines = "corpus AS (SELECT url AS path, html AS content FROM pages), " + LINES
    return {
        "normalized_disguises": f"WITH {KEYS} SELECT k, 'key = ' || ak AS text FROM keys",
        "disguise_findings": f"""WITH {KEYS}
SELECT k AS line, 7 AS "column", {mask('ak')} AS masked_value, {key.format('hidden')} FROM keys""",
        "normalized_pages": f"""WITH {pages_lines}, n AS (
  SELECT path, line, {normalized('text')} AS t FROM lines)
SELECT path, line, length(t) AS n_chars, md5(t) AS text_md5 FROM n""",
        "decoded_keys": f"""WITH {ENCODED}
SELECT k, depth, codec, ak AS text, 5 AS "offset" FROM enc""",
        "decoded_findings": f"""WITH {ENCODED}
SELECT k AS line, 6 AS "column", depth, {mask('ak')} AS masked_value, {key.format('encoded')}
FROM enc""",
    }


def _matching_and_filters() -> dict[str, str]:
    extensions = words(paths.EXCLUDED_EXTENSIONS)
    names = words(paths.EXCLUDED_FILENAMES)
    texts = f"WITH {CORPUS}, {LINES}"
    return {
        "keyword_gate": f"""WITH {SEEDED}, {rules_cte(builtin_rules())}
SELECT DISTINCT path, line, rule_id FROM seeded
JOIN (SELECT rule_id, unnest(keywords) AS kw FROM rules) r ON contains(lower(text), r.kw)""",
        "keyword_gate_texts": f"""{texts}, {rules_cte(builtin_rules())}, gate AS (
  SELECT DISTINCT path, line, rule_id FROM lines
  JOIN (SELECT rule_id, unnest(keywords) AS kw FROM rules) r ON contains(lower(text), r.kw))
SELECT rule_id, count(*) AS lines FROM gate GROUP BY rule_id""",
        "scan_seeded": seeded(f"SELECT {KEY_LIST}, depth FROM found"),
        "scan_text_tables": f"""{texts}, segs AS (
  SELECT path, line, {normalized('text')} AS text, 0 AS depth, 0 AS "offset" FROM lines),
{findings_ctes(builtin_rules() + custom())}
SELECT {KEY_LIST}, depth FROM found""",
        "custom_rule_findings": f"""WITH corpus AS (
  SELECT 'documents/' || doc_id || '.txt' AS path, text AS content FROM documents), {LINES},
segs AS (SELECT path, line, text, 0 AS depth, 0 AS "offset" FROM lines),
{findings_ctes(custom()[:1])}
SELECT {KEY_LIST}, secret_sha FROM found""",
        "scan_events": f"""SELECT 'events/' || event_id || '.json' AS path, 1 AS line,
  instr(props, '"k": ') + 5 AS "column", 'event-key' AS rule_id, 'low' AS severity,
  '**' AS masked_value, sha256('events/' || event_id || '.json:event-key:'
    || regexp_extract(props, '"k": (\\d{{2}})\\b', 1)) AS secret_hash
FROM events WHERE regexp_matches(props, '"k": \\d{{2}}\\b')""",
        "entropy_by_charset": f"""WITH {SEEDED}, w AS (
  SELECT line, regexp_extract(text, '(\\S+)\\s*$', 1) AS w FROM seeded)
SELECT line, round({entropy('w')}, 6) AS entropy, {charset('w')} AS charset,
       {high_entropy('w')} AS high, {mask('w')} AS masked FROM w""",
        "path_filters": f"""WITH ids AS (
  SELECT doc_id AS id FROM documents UNION ALL SELECT page_id + 1000000 FROM pages
), p AS (
  SELECT id, CASE id % 6 WHEN 0 THEN 'src/' WHEN 1 THEN 'node_modules/x/' WHEN 2 THEN 'a/tests/'
                         WHEN 3 THEN 'lib\\fixtures\\' WHEN 4 THEN 'vendor/' ELSE '' END
         || CASE WHEN id % 29 = 0 THEN 'yarn.lock' ELSE 'f' || id || CASE id % 8
              WHEN 0 THEN '.png' WHEN 1 THEN '.ts' WHEN 2 THEN '.MD' WHEN 3 THEN '.tar'
              WHEN 4 THEN '.woff2' WHEN 5 THEN '.spec.js' WHEN 6 THEN '.zip' ELSE '.min.js' END
            END AS path FROM ids
), n AS (SELECT *, replace(path, '\\', '/') AS np FROM p)
SELECT id, path, regexp_matches(np, '(^|/)(node_modules|\\.git)/') AS in_excluded_directory,
  list_contains({names}, regexp_extract(np, '[^/]*$'))
    OR list_contains({extensions}, lower(regexp_extract(np, '\\.[^./]*$'))) AS excluded_file,
  starts_with(np, 'vendor/') OR starts_with(np, 'lib/') OR contains(np, '/vendor/')
    OR contains(np, '/lib/') OR ends_with(np, '.zip') AS user_ignored,
  {test_or_doc('path')} AS test_or_doc
FROM n""",
        "placeholder_values": f"""WITH {SEEDED}, v AS (
  SELECT path, line, w || CASE WHEN line % 4 = 0 THEN '' ELSE substr(md5(text), 1, 8) END AS value
  FROM (SELECT *, CASE kind WHEN 0 THEN '' WHEN 1 THEN 'change_me' WHEN 2 THEN 'Example'
          WHEN 3 THEN 'test' WHEN 4 THEN 'xxxx' WHEN 5 THEN 'e.g. ' WHEN 6 THEN 'dummy'
          WHEN 7 THEN 'your-token' WHEN 8 THEN 'aaaaaaaa' ELSE 'todo' END AS w FROM seeded))
SELECT path, line, value, {placeholder('value', 'path')} AS placeholder FROM v""",
        "directives": f"""WITH {KEYS}
SELECT k,
  CASE WHEN k % 8 IN (0, 4) THEN TRUE WHEN k % 8 IN (1, 2, 3) THEN FALSE END AS here_all,
  CASE k % 8 WHEN 0 THEN '' WHEN 1 THEN 'aws-access-key' WHEN 2 THEN 'npm-token|jwt'
             WHEN 3 THEN 'x|y' WHEN 4 THEN '' END AS here_rules,
  CASE WHEN k % 8 = 5 THEN FALSE END AS below_all,
  CASE WHEN k % 8 = 5 THEN 'jwt' END AS below_rules
FROM keys""",
        "silenced_findings": f"""WITH {KEYS}
SELECT 'src/d' || k || '.ts' AS path, 2 AS line, 'aws-access-key' AS rule_id, 6 AS "column"
FROM keys WHERE k % 3 <> 1 AND k % 4 IN (0, 2)""",
        "allowlisted_findings": seeded(
            f"""SELECT {KEY_LIST}, depth FROM found
WHERE secret NOT IN (SELECT ak FROM keys WHERE k % 3 = 0)""", only("aws-access-key")),
        "severe_findings": seeded(
            f"SELECT {KEY_LIST}, depth FROM found",
            [r for r in builtin_rules() if r.severity == "critical" and r.rule_id != "npm-token"]),
        "block_findings": f"""WITH {KEYS}, b AS (
  SELECT k, 'keys/k' || k || '.pem' AS path, '-----BEGIN RSA ' || 'PRIVATE KEY-----' || chr(10)
    || h || h || chr(10) || reverse(h) || h || chr(10) || '-----END RSA ' || 'PRIVATE KEY-----'
    AS secret FROM keys)
SELECT path, k % 3 + 1 AS line, 1 AS "column", 'private-key' AS rule_id,
       {mask('secret')} AS masked_value, sha256(path || ':private-key:' || secret) AS secret_hash
FROM b""",
    }


def _analytics() -> dict[str, str]:
    risks = f""", risks AS (
  SELECT secret_hash, max({WEIGHT}) AS w FROM found GROUP BY secret_hash)"""
    base = f""", base AS (SELECT DISTINCT {FINGERPRINT} AS fp FROM found WHERE line % 2 = 0),
marked AS (SELECT *, {FINGERPRINT} IN (SELECT fp FROM base) AS suppressed FROM found)"""
    severities = "(VALUES ('critical', 4), ('high', 3), ('medium', 2), ('low', 1)) s(severity, w)"
    steps = " ".join(
        f"WHEN {q(rule_id)} THEN {len(own) + 1}" for rule_id, own in STEPS.items())
    return {
        "severity_counts": seeded(
            f"""SELECT s.severity, count(risks.w) AS count
FROM {severities} LEFT JOIN risks USING (w) GROUP BY s.severity""", more=risks),
        "score_report": seeded(
            f"""SELECT CAST(score AS INTEGER) AS score, {TIER} AS tier, critical, high, medium, low FROM (
  SELECT greatest(0, 100 - coalesce(sum({PENALTY}), 0)) AS score,
         count(*) FILTER (w = 4) AS critical, count(*) FILTER (w = 3) AS high,
         count(*) FILTER (w = 2) AS medium, count(*) FILTER (w = 1) AS low
  FROM (SELECT secret_hash, max({WEIGHT}) AS w FROM found
        GROUP BY secret_hash))"""),
        "findings_per_severity": seeded(
            "SELECT severity, count(*) AS count FROM found GROUP BY severity"),
        "findings_per_file": seeded(
            """SELECT path, count(*) AS findings,
       count(*) FILTER (severity = 'critical') AS critical,
       count(*) FILTER (severity = 'high') AS high,
       count(*) FILTER (severity = 'medium') AS medium,
       count(*) FILTER (severity = 'low') AS low
FROM found GROUP BY path"""),
        "top_findings": seeded(
            f"""SELECT {KEY_LIST} FROM found
ORDER BY path, line, depth, rule_ord, "column", masked_value LIMIT 10"""),
        "stream_first_findings": seeded(f"SELECT DISTINCT {FINGERPRINT} AS fingerprint, rule_id, path FROM found"),
        "stream_totals": seeded(
            """SELECT severity, (2 * count(*))::BIGINT AS findings, count(DISTINCT path) AS files
FROM found GROUP BY severity"""),
        "distinct_findings": seeded(
            """SELECT path, line, rule_id, secret_hash, m.d AS depth, m.c AS "column" FROM (
  SELECT path, line, rule_id, secret_hash, min({'d': depth, 'c': "column"}) AS m
  FROM found GROUP BY path, line, rule_id, secret_hash)"""),
        "secret_reuse": f"WITH {SEEDED_SEGMENTS.replace('segs AS', 'once AS')}, segs AS ("
                        "SELECT * FROM once UNION ALL SELECT 'copy/' || path, line, text, depth, "
                        "\"offset\" FROM once WHERE line % 2 = 0), "
                        + findings_ctes(builtin_rules()) + f"""
SELECT secret_sha, count(*) AS findings, count(DISTINCT path) AS files,
       count(DISTINCT rule_id) AS rules, max({WEIGHT}) AS max_weight
FROM found GROUP BY secret_sha""",
        "baseline_entries": seeded(
            f"""SELECT {FINGERPRINT} AS fingerprint, rule_id, path AS file, line
FROM found WHERE line % 2 = 0"""),
        "baseline_active": seeded(f"SELECT {KEY_LIST} FROM marked WHERE NOT suppressed", more=base),
        "baseline_suppressed": seeded(f"SELECT {KEY_LIST} FROM marked WHERE suppressed", more=base),
        "verified_findings": seeded(
            """SELECT path, line, rule_id, "column", verified FROM found LEFT JOIN (
  SELECT sha256(ak) AS secret_sha, k % 4 = 0 AS verified FROM keys
  WHERE k % 20 IN (0, 4, 5, 8, 10, 12, 15, 16)) USING (secret_sha)"""),
        "scan_summary": seeded(
            f"""SELECT *, {TIER} AS tier FROM (
  SELECT (SELECT count(DISTINCT path) FROM seeded) AS files_scanned, 0 AS skipped_files,
         (SELECT count(*) FROM seeded) AS lines_scanned,
         (SELECT count(*) FROM marked WHERE NOT suppressed) AS findings,
         (SELECT count(*) FROM marked WHERE suppressed) AS suppressed_findings,
         (SELECT greatest(0, 100 - sum({PENALTY})) FROM (
            SELECT max({WEIGHT}) AS w FROM marked WHERE NOT suppressed GROUP BY secret_hash)) AS score)""",
            more=base),
        "finding_remediation": seeded(
            f"""SELECT rule_id, count(*) AS findings, CASE rule_id {steps} ELSE 3 END AS steps
FROM found GROUP BY rule_id"""),
    }


def _snapshots_and_history() -> dict[str, str]:
    commit_columns = '"commit", commit_author, commit_date'
    return {
        "snapshot_changes": f"""WITH {SNAPSHOTS}
SELECT path, status, CASE WHEN status = 'scanned' THEN md5(now) END AS content_md5 FROM changed""",
        "staged_findings": f"""WITH {SNAPSHOTS}, segs AS (
  SELECT path, i AS line, parts[i] AS text, 0 AS depth, 0 AS "offset"
  FROM (SELECT path, string_split(now, chr(10)) AS parts FROM changed WHERE status = 'scanned')
  CROSS JOIN LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)),
{findings_ctes(only('aws-access-key'))}
SELECT {KEY_LIST} FROM found""",
        "history_added_lines": f"""WITH {HISTORY}
SELECT {commit_columns}, path, line, text FROM added""",
        "history_findings": history_scan(
            ("aws-access-key", "db-connection-string"),
            f"""SELECT {commit_columns}, path, line, "column", rule_id, masked_value, secret_hash
FROM found""", "path <> 'src/a7.ts' AND NOT contains(path, '/a7.ts/')"),
        "history_totals": f"""WITH {HISTORY}
SELECT count(DISTINCT "commit") AS commits_scanned, count(DISTINCT path) AS files_scanned,
       count(*) AS lines_scanned FROM added""",
        "history_one_file": f"""WITH {HISTORY}
SELECT "commit", path, line, text FROM added WHERE path = 'src/a7.ts'""",
        "history_newest": f"""WITH {HISTORY}, newest AS (
  SELECT "commit" FROM commits ORDER BY commit_date DESC, "commit" LIMIT 100)
SELECT "commit", path, line, text FROM (
  SELECT *, sum(strlen(text)) OVER (PARTITION BY "commit", path ORDER BY line) AS bytes
  FROM added WHERE "commit" IN (SELECT "commit" FROM newest))
WHERE bytes <= 40""",
    }


def _reports() -> dict[str, str]:
    order = ", ".join(f'"{c}"' for c in REPORT_ORDER if c != "depth")
    name = json_text("rule_name")
    xml_name = "rule_name"
    doc_token = "token\\s*=\\s*\"([0-9a-f]{40})\""

    def report(fragment: str) -> str:
        return seeded(f"SELECT {order}, {fragment} AS fragment FROM found")

    message = json_text(
        "'Rule ''' || rule_name || ''' found a secret: ' || masked_value")
    location = ("""'"locations":[{"physicalLocation":{"artifactLocation":{"uri":' || """
                + json_text("path")
                + """ || ',"uriBaseId":"%SRCROOT%"},"region":{"startLine":' || greatest(1, line) """
                """|| ',"startColumn":' || "column" || '}}}]}'""")
    sarif_head = ("'{\"ruleId\":\"' || rule_id || '\",\"level\":\"' || " + SARIF_LEVEL
                  + " || '\",\"message\":{\"text\":' || " + message + " || '},' || ")
    case = (
        "'    <testcase classname=\"' || path || '\" name=\"' || " + xml_name
        + " || ' at line ' || line || ':' || \"column\" || '\" time=\"0.001\">' || chr(10) || "
        "'      <failure message=\"[' || upper(severity) || '] ' || rule_name || ': ' || "
        "masked_value || ' (' || rule_id || ')\" type=\"SecurityLeak\">At ' || path "
        "|| ':' || line || ':' || \"column\" || chr(10) || 'Rule: ' || rule_id || chr(10) || "
        "'Severity: ' || severity || chr(10) || 'Secret: ' || masked_value || chr(10) || "
        "'What to do: withdraw this credential and issue a new one.</failure>' || chr(10) || "
        "'    </testcase>'")
    return {
        "report_json": report(
            "'{\"rule\":\"' || rule_id || '\",\"name\":' || " + name
            + " || ',\"severity\":\"' || severity || '\",\"file\":' || " + json_text("path")
            + " || ',\"line\":' || line || ',\"column\":' || \"column\" || ',\"maskedValue\":' || "
            + json_text("masked_value") + " || '}'"),
        "report_sarif": report(
            sarif_head + "'\"partialFingerprints\":{\"secretHash\":\"' || secret_hash || "
            "'\",\"primaryLocationLineHash\":\"' || secret_hash || '\"},' || " + location),
        "report_sarif_history": history_scan(
            ("aws-access-key",),
            f"SELECT {order}, " + sarif_head
            + "'\"properties\":{\"commit\":\"' || \"commit\" || '\",\"commitAuthor\":\"' || "
            "commit_author || '\",\"commitDate\":\"' || commit_date || '\"},"
            "\"partialFingerprints\":{\"commitHash\":\"' || \"commit\" || '\"},' || "
            + location + " AS fragment FROM found"),
        "report_quality": report(
            "'{\"description\":' || "
            + json_text("'[' || upper(severity) || '] ' || rule_name || ': found ' || "
                        "masked_value || '. Withdraw it now.'")
            + " || ',\"check_name\":\"' || rule_id || '\",\"fingerprint\":\"' || "
            "sha256(path || ':' || line || ':' || \"column\" || ':' || rule_id || ':' || masked_value) "
            "|| '\",\"severity\":\"' || CASE severity WHEN 'critical' THEN 'blocker' "
            "WHEN 'high' THEN 'critical' WHEN 'medium' THEN 'major' ELSE 'minor' END || "
            "'\",\"location\":{\"path\":' || " + json_text("path")
            + " || ',\"lines\":{\"begin\":' || line || '}}}'"),
        "report_junit": seeded(f"""SELECT path, 1 AS part, line, rule_ord, "column", {case} AS fragment FROM found
UNION ALL
SELECT path, 0, NULL, NULL, NULL, '  <testsuite name="Security.SecretScanning.' || replace(path, '/', '.')
  || '" tests="' || count(*) || '" failures="' || count(*) || '" errors="0" time="0.000">'
FROM found GROUP BY path
UNION ALL SELECT DISTINCT path, 2, NULL, NULL, NULL, '  </testsuite>' FROM found"""),
        "report_annotations": report(
            "'::' || CASE WHEN severity IN ('critical', 'high') THEN 'error' ELSE 'warning' END || "
            "' file=' || path || ',line=' || line || ',col=' || \"column\" || "
            "',title=veilscan%3A ' || rule_name || ' [' || upper(severity) || ']::Found ' "
            "|| masked_value || ' (' || rule_id || '). Take it out of the file and withdraw it.'"),
        "report_markdown": seeded(
            """SELECT '| `' || rule_id || '` | `' || path || '` | ' || line || ' |' AS fragment FROM (
  SELECT * FROM found ORDER BY path, line, depth, rule_ord, "column", masked_value LIMIT 10)"""),
        "redacted_secrets": """
SELECT 'src/' || kind || c_custkey || '.ts' AS path, 0::BIGINT AS findings_left, false AS key_left,
       'before' || chr(13) || chr(10) || '  ' || CASE kind WHEN 'd' THEN 'key' ELSE 'blob' END AS head, true AS masked
FROM customer CROSS JOIN (VALUES ('d'), ('e')) AS kinds(kind)""",
        "redacted_documents": f"""WITH RECURSIVE docs AS (
  SELECT 'documents/' || doc_id || '.txt' AS path, text,
         list_distinct(regexp_extract_all(text, '{doc_token}', 1)) AS secrets FROM documents
), step(path, text, secrets) AS (
  SELECT path, text, list_filter(secrets, lambda s: {high_entropy('s')}
                                   AND round({entropy('s')}, 9) >= 3) FROM docs
  UNION ALL
  SELECT path, replace(text, secrets[1], {mask('secrets[1]')}), secrets[2:]
  FROM step WHERE len(secrets) > 0)
SELECT path, length(text) AS n_chars, md5(text) AS content_md5 FROM step WHERE len(secrets) = 0""",
    }


def _former_limits() -> dict[str, str]:
    """Planted values alone: no pattern of a rule takes part."""
    long = """long AS (
  SELECT s_suppkey AS s, 'AK' || 'IA' || upper(substr(md5(CAST(s_suppkey AS VARCHAR)), 1, 16)) AS ak
  FROM supplier), planted AS (
  SELECT 'long' || s || '.txt' AS path, 2 * (s % 200 + 32600) + 1 AS "column", 0 AS depth,
         NULL AS leaf_path, ak FROM long WHERE s % 3 = 0
  UNION ALL SELECT 'blob' || s || '.txt', 15009, 1, NULL, ak FROM long WHERE s % 3 = 1
  UNION ALL SELECT 'long' || s || '.json', 5, 0, 'deep.id', ak FROM long WHERE s % 3 = 2)"""
    hashed = "sha256(path || ':aws-access-key:' || ak) AS secret_hash"
    marked = f"""WITH {KEYS}, m AS (SELECT h AS "commit", 'src/m' || (k % 5) || '.ts' AS path, ak FROM keys)
SELECT "commit", path, 2 AS line, 4 AS "column", {mask('ak')} AS masked_value, {hashed} FROM m"""
    tree = """tree AS (
  SELECT c_custkey AS k, c_custkey % 8 AS kind, 'arc/a' || (c_custkey // 80) || '.zip' AS archive,
         'AK' || 'IA' || upper(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 16)) AS ak FROM customer), files AS (
  SELECT 'src/d' || (k % 50) || '/f' || k || '.ts' AS path, 'scanned' AS status, 23 AS length, ak FROM tree WHERE kind = 0
  UNION ALL SELECT '.cfg/f' || k || '.txt', 'scanned', 23, ak FROM tree WHERE kind = 1
  UNION ALL SELECT 'u/f' || k || '.txt', 'scanned', 48, ak FROM tree WHERE kind = 2
  UNION ALL SELECT 'big/f' || k || '.txt', 'too-large', 3023, ak FROM tree WHERE kind = 3
  UNION ALL SELECT 'links/f' || k || '.txt', 'symlink', NULL, ak FROM tree WHERE kind = 4
  UNION ALL SELECT archive || '://m/f' || k || '.txt', 'scanned', 23, ak FROM tree WHERE kind = 5
  UNION ALL SELECT 'bad/f' || k || '.zip', 'scanned', 23, ak FROM tree WHERE kind = 7
  UNION ALL SELECT DISTINCT archive || '://m/bad.txt', 'unreadable', NULL, NULL FROM tree)"""
    return {
        "tree_files": f"WITH {tree} SELECT path, status, length FROM files",
        "tree_findings": f"""WITH {tree}
SELECT path, 1 AS line, 4 AS "column", 'aws-access-key' AS rule_id, 'critical' AS severity,
       {mask('ak')} AS masked_value, {hashed} FROM files WHERE status = 'scanned'""",
        "long_text_findings": f"""WITH {long}
SELECT path, 1 AS line, "column", depth, leaf_path, {mask('ak')} AS masked_value, {hashed} FROM planted""",
        "engines_agree": f"""WITH {KEYS}
SELECT engine, k AS line, 5 AS "column", sha256('a.txt:corp-tag:corp-'
  || translate(substr(h, 1, 4), '0123456789', 'ghijklmnop')) AS secret_hash
FROM keys, (VALUES ('arrow'), ('jvm')) e(engine)""",
        "history_marker_lines": marked,
        "stream_history_findings": marked,
    }


def all_oracles() -> dict[str, str]:
    out = {
        **_text_preparation(), **_normalisation_and_decoding(), **_matching_and_filters(),
        **_analytics(), **_snapshots_and_history(), **_reports(), **_former_limits(),
    }
    out["text_block_findings"] = out["block_findings"]
    out["written_baseline"] = seeded(f"SELECT DISTINCT {FINGERPRINT} AS fingerprint FROM found")
    out["stream_findings"] = out["custom_rule_findings"].replace(", secret_sha FROM", " FROM")
    out["stream_active_findings"] = out["baseline_active"]
    out["history_cut_lines"] = out["stream_cut_lines"] = out["history_added_lines"]
    out["history_cut_findings"] = out["history_findings"]
    out["rules_file_findings"] = out["stream_findings"]
    out["written_findings"] = out["scan_seeded"]
    details = {
        "sarif": ('"column"', "secret_hash"),
        "quality": ("NULL", "sha256(path || ':' || line || ':' || \"column\" || ':' || rule_id || ':' || masked_value)"),
        "json": ('"column"', "masked_value"),
        "junit": ('"column"', "CAST(count(*) OVER (PARTITION BY path) AS VARCHAR)"),
    }
    out["written_reports"] = seeded("\nUNION ALL\n".join(
        f"""SELECT '{kind}' AS kind, path, {'greatest(1, line)' if kind == 'sarif' else 'line'} AS line, {column} AS "column", rule_id, {detail} AS detail FROM found
UNION ALL SELECT '{kind} total', NULL, count(*), NULL, NULL, NULL FROM found"""
        for kind, (column, detail) in details.items()))
    return out
