"""DuckDB SQL for the correctness check: brute-force equivalents of the Spark queries.

These enumerate what the Spark side deliberately never materialises (all candidate pairs of a
cluster, the full cluster x cluster similarity matrix) and apply the same definitions, so
matching results show the bounded Spark plans are exact. Only used at small scale.
"""

from __future__ import annotations

from matchsmith.functions.text import (DROPPED_ENTITIES, PUNCTUATION, VOCAB_TOKEN,
                                       WHITESPACE_RUN, normalized_stop_words)


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP_LIST = "[" + ", ".join(q(w) for w in normalized_stop_words()) + "]"


def tokens_sql(expr: str) -> str:
    s = f"coalesce(CAST({expr} AS VARCHAR), '')"
    for ent in DROPPED_ENTITIES:
        s = f"replace({s}, {q(ent)}, '')"
    s = f"replace(replace({s}, chr(9) || ';', ' '), chr(10) || ';', ' ')"
    s = f"translate(lower({s}), {q(PUNCTUATION)}, '')"
    return f"list_filter(string_split_regex({s}, {q(WHITESPACE_RUN)}), lambda t: t <> '')"


def split_ws_sql(expr: str) -> str:
    return (f"list_filter(string_split_regex(coalesce({expr}, ''), {q(WHITESPACE_RUN)}), "
            f"lambda t: t <> '')")


def clean_sql(expr: str) -> str:
    toks = tokens_sql(expr)
    kept = f"list_filter({toks}, lambda t: NOT list_contains({STOP_LIST}, t))"
    return f"CASE WHEN {expr} IS NULL THEN NULL ELSE array_to_string({kept}, ' ') END"


def vocab_sql(expr: str) -> str:
    return f"regexp_extract_all(lower(coalesce({expr}, '')), {q(VOCAB_TOKEN)})"


def seeded(seed, *parts: str) -> str:
    inner = ", ".join([q(str(seed))] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"md5(concat_ws('|', {inner}))"


# Views of FIXTURES.md, as CTEs.
FIXTURE_CTES = r"""
offers_v AS (
  SELECT doc_id AS id, lang || '/' || source AS cluster_id,
         regexp_extract(text, '^\s*(\S+(?:\s+\S+){0,11})', 1) AS title,
         regexp_replace(text, '^\s*\S+(?:\s+\S+){0,11}\s*', '') AS description,
         source AS brand
  FROM documents),
pair_ids_v AS (
  SELECT id AS id_left, nxt AS id_right,
         CAST(id AS VARCHAR) || '#' || CAST(nxt AS VARCHAR) AS pair_id
  FROM (
    SELECT id, lead(id) OVER (PARTITION BY cluster_id ORDER BY id) AS nxt FROM offers_v
    UNION
    SELECT id, lead(id) OVER (ORDER BY id) AS nxt FROM offers_v
  ) t
  WHERE nxt IS NOT NULL),
pairs_v AS (
  SELECT p.pair_id, p.id_left, p.id_right,
         CASE WHEN a.cluster_id = b.cluster_id THEN 1 ELSE 0 END AS label,
         a.title AS title_left, b.title AS title_right,
         a.description AS description_left, b.description AS description_right,
         a.brand AS brand_left, b.brand AS brand_right
  FROM pair_ids_v p JOIN offers_v a ON a.id = p.id_left JOIN offers_v b ON b.id = p.id_right),
valid_ids_v AS (
  SELECT pair_id FROM pairs_v WHERE substr(md5('valid|' || pair_id), 1, 1) IN ('0', '1', '2')),
gold_v AS (
  SELECT pair_id, id_left, id_right, label FROM pairs_v
  WHERE substr(md5('gold|' || pair_id), 1, 1) IN ('e', 'f'))"""


def with_fixtures(*ctes: str) -> str:
    return "WITH " + ",\n".join([FIXTURE_CTES.strip()] + [c.strip() for c in ctes if c])


def training_ctes(seed: int = 42, min_words: int = 5) -> list[str]:
    """Clean offers, eligible offers, gold, clusters, ranked offers (brute force)."""
    words = "len(" + split_ws_sql("trim(title || ' ' || description)") + ")"
    return [
        f"clean AS (SELECT id, cluster_id, {clean_sql('title')} AS title, description, brand "
        f"FROM offers_v)",
        "dedup AS (SELECT id, cluster_id, title, description, brand FROM ("
        " SELECT *, row_number() OVER (PARTITION BY cluster_id, title ORDER BY"
        " (CASE WHEN title IS NOT NULL AND title <> '' THEN 1 ELSE 0 END"
        " + CASE WHEN description IS NOT NULL AND description <> '' THEN 1 ELSE 0 END"
        " + CASE WHEN brand IS NOT NULL AND brand <> '' THEN 1 ELSE 0 END) DESC, id DESC) AS rn"
        " FROM clean WHERE title IS NOT NULL AND title <> '') x WHERE rn = 1)",
        f"eligible AS (SELECT * FROM dedup WHERE {words} > {min_words})",
        "gnorm AS (SELECT DISTINCT least(id_left, id_right) AS id_left,"
        " greatest(id_left, id_right) AS id_right FROM gold_v WHERE id_left <> id_right)",
        "gold_ids AS (SELECT id_left AS id FROM gnorm UNION SELECT id_right FROM gnorm)",
        "gold_offers AS (SELECT c.* FROM clean c WHERE c.id IN (SELECT id FROM gold_ids))",
        "gclusters AS (SELECT DISTINCT cluster_id FROM gold_offers)",
        "gtitles AS (SELECT DISTINCT title FROM gold_offers)",
        "ranked AS (SELECT e.cluster_id, e.id, e.title,"
        " (e.title IN (SELECT title FROM gtitles)) AS bad,"
        f" row_number() OVER (PARTITION BY e.cluster_id ORDER BY (e.title IN (SELECT title FROM gtitles)),"
        f" {seeded(seed, 'e.id')}, e.id) - 1"
        " AS rank FROM eligible e WHERE e.cluster_id IN (SELECT cluster_id FROM gclusters))",
        "msize AS (SELECT cluster_id, count(*) AS m FROM ranked GROUP BY cluster_id)",
    ]


def capped_sql(src: str, group: str, pos: str, size: str, cap: str, fallback: str) -> str:
    """Brute-force W6 over ``src`` (must carry bad, size, cap, fallback columns)."""
    return f"""
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {pos}) AS _k FROM (
          SELECT *, row_number() OVER (PARTITION BY {group}, bad ORDER BY {pos}) AS _rb FROM {src}
        ) a WHERE NOT {fallback} AND (NOT bad OR _rb <= {cap})
      ) b WHERE _k <= {size}
      UNION ALL
      SELECT * FROM (
        SELECT *, 0 AS _rb2, row_number() OVER (PARTITION BY {group} ORDER BY {pos}) AS _k FROM (
          SELECT * FROM {src}
        ) a WHERE {fallback}
      ) c WHERE _k = 1"""


def walk_sql(src: str, keys: list[str], seed: int) -> str:
    """Every pair of the ranges ``src`` (keys, bad, n, nall) with its draw number's place ``k`` in
    the range and ``pos`` in the merged order."""
    key = ", ".join(keys)
    strides = "[1152921504606847009, 1152921504606847067, 1152921504606847081, 1152921504606847123]"
    return f"""
      SELECT {key}, bad, CAST((CAST({strides}[1 + h % 4] % n AS HUGEINT) * t + (h // 4) % n) % n AS BIGINT) AS k,
             t + least(CASE WHEN mark >= n THEN (mark - n) // (2 * n) + 1 ELSE 0 END, nall - n) AS pos
      FROM (SELECT *, (2 * t + 1) * (nall - n) - CASE WHEN bad THEN 0 ELSE 1 END AS mark FROM (
        SELECT *, unnest(generate_series(0, n - 1)) AS t,
               CAST('0x' || substr({seeded(seed, *keys, 'bad')}, 1, 15) AS BIGINT) AS h
        FROM (SELECT DISTINCT {key}, bad, n, nall FROM {src}) r0) r1) r2"""


def positives_ctes(n: int = 15, seed: int = 42) -> list[str]:
    return [
        # every unordered pair of a cluster, by the higher rank and then the lower one
        "allpos AS (SELECT a.cluster_id, least(a.id, b.id) AS id_left,"
        " greatest(a.id, b.id) AS id_right, (a.bad OR b.bad) AS bad, a.rank AS i, b.rank AS j"
        " FROM ranked a JOIN ranked b ON a.cluster_id = b.cluster_id AND a.rank < b.rank)",
        "pcand0 AS (SELECT p.*, row_number() OVER (PARTITION BY cluster_id, bad ORDER BY j, i) - 1 AS k,"
        " count(*) OVER (PARTITION BY cluster_id, bad) AS n, count(*) OVER (PARTITION BY cluster_id) AS nall"
        " FROM allpos p ANTI JOIN gnorm g ON g.id_left = p.id_left AND g.id_right = p.id_right)",
        "pcand AS (SELECT c.cluster_id, c.id_left, c.id_right, c.bad, w.pos FROM pcand0 c JOIN ("
        + walk_sql("pcand0", ["cluster_id"], seed) + ") w ON w.cluster_id = c.cluster_id AND w.bad = c.bad AND w.k = c.k)",
        "pplan AS (SELECT cluster_id, count(*) AS total, sum(CASE WHEN NOT bad THEN 1 ELSE 0 END)"
        f" AS good_total, least({n}, count(*)) AS S FROM pcand GROUP BY cluster_id)",
        "pplan2 AS (SELECT *, S // 2 AS cap, least(S, good_total + least(S // 2,"
        " total - good_total)) = 0 AS fallback FROM pplan)",
        "pc AS (SELECT p.*, q.S, q.cap, q.fallback FROM pcand p JOIN pplan2 q USING (cluster_id))",
        "psample AS (SELECT cluster_id, id_left, id_right FROM ("
        + capped_sql("pc", "cluster_id", "pos", "S", "cap", "fallback") + ") z)",
    ]


def similarity_ctes() -> list[str]:
    return [
        "tok AS (SELECT c.cluster_id, unnest(" + split_ws_sql("c.title") + ") AS token"
        " FROM clean c WHERE c.cluster_id IN (SELECT cluster_id FROM gclusters))",
        "bags AS (SELECT cluster_id, token, count(*) AS cnt FROM tok GROUP BY ALL)",
        "bsize AS (SELECT cluster_id, sum(cnt) AS size FROM bags GROUP BY ALL)",
        "inter AS (SELECT a.cluster_id AS a, b.cluster_id AS b, sum(least(a.cnt, b.cnt)) AS inter"
        " FROM bags a JOIN bags b ON a.token = b.token AND a.cluster_id <> b.cluster_id"
        " GROUP BY ALL)",
        "simall AS (SELECT x.cluster_id, y.cluster_id AS other,"
        " coalesce(i.inter / (sx.size + sy.size - i.inter), 0.0) AS sim"
        " FROM gclusters x JOIN gclusters y ON x.cluster_id <> y.cluster_id"
        " LEFT JOIN inter i ON i.a = x.cluster_id AND i.b = y.cluster_id"
        " LEFT JOIN bsize sx ON sx.cluster_id = x.cluster_id"
        " LEFT JOIN bsize sy ON sy.cluster_id = y.cluster_id)",
        "simrank AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY sim DESC,"
        " other) AS rank FROM simall)",
    ]


def negatives_ctes(n: int = 45, k: int = 10, seed: int = 42) -> list[str]:
    return [
        f"topk AS (SELECT cluster_id, other FROM simrank WHERE rank <= {k})",
        "owned AS (SELECT min(cluster_id) AS owner, least(cluster_id, other) AS ka,"
        " greatest(cluster_id, other) AS kb FROM topk GROUP BY ALL)",
        "owned2 AS (SELECT owner, CASE WHEN owner = ka THEN kb ELSE ka END AS other FROM owned)",
        "ngrid AS (SELECT w.owner, w.other, a.id AS id_left, b.id AS id_right,"
        " (a.bad OR b.bad) AS bad, a.rank AS i, b.rank AS j"
        " FROM owned2 w JOIN ranked a ON a.cluster_id = w.owner"
        " JOIN ranked b ON b.cluster_id = w.other)",
        "ncand AS (SELECT p.*, row_number() OVER (PARTITION BY owner, other, bad ORDER BY i, j) - 1 AS k,"
        " count(*) OVER (PARTITION BY owner, other, bad) AS n, count(*) OVER (PARTITION BY owner, other) AS nall"
        " FROM ngrid p ANTI JOIN gnorm g"
        " ON g.id_left = least(p.id_left, p.id_right) AND g.id_right = greatest(p.id_left, p.id_right))",
        "lists AS (SELECT w.owner, w.other, coalesce(c.L, 0) AS L FROM owned2 w LEFT JOIN"
        " (SELECT owner, other, count(*) AS L FROM ncand GROUP BY ALL) c USING (owner, other))",
        "lists2 AS (SELECT *, min(L) OVER (PARTITION BY owner) AS min_len,"
        " count(*) OVER (PARTITION BY owner) AS k_o,"
        f" row_number() OVER (PARTITION BY owner ORDER BY {seeded(seed, 'owner', 'other')}, other)"
        " - 1 AS slot FROM lists)",
        "nt AS (SELECT c.owner, c.other, c.id_left, c.id_right, c.bad, l.min_len, l.k_o, l.slot, w.pos AS t"
        " FROM ncand c JOIN (" + walk_sql("ncand", ["owner", "other"], seed) + ") w ON w.owner = c.owner"
        " AND w.other = c.other AND w.bad = c.bad AND w.k = c.k"
        " JOIN lists2 l ON l.owner = c.owner AND l.other = c.other)",
        f"nu AS (SELECT *, t * k_o + slot AS u, least({n}, k_o * min_len) AS S,"
        f" least({n}, k_o * min_len) // 2 AS cap FROM nt WHERE t < min_len)",
        "nu2 AS (SELECT *, (S = 1 AND max(CASE WHEN NOT bad THEN 1 ELSE 0 END)"
        " OVER (PARTITION BY owner) = 0) AS fallback FROM nu)",
        "nsample AS (SELECT owner AS cluster_id, other AS other_cluster_id, id_left, id_right"
        " FROM (" + capped_sql("nu2", "owner", "u", "S", "cap", "fallback") + ") z)",
    ]
