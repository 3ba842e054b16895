"""DuckDB reference SQL for the registered queries.

The SQL is deliberately brute force (nested-loop ``contains``, a recursive
occurrence-by-occurrence walk, a recursive greedy walk for the variant merge)
so that it checks the Spark plans (anchor join, position fold, merge rounds)
independently.  The builders take the same ``Params`` as the Spark side.
"""

from __future__ import annotations

from ..params import Params

# Accented Latin letters are word characters for Python/Java (?U) but not for
# RE2's ASCII \b; they are replaced by '0' (a word character) before the
# name regex runs.  They can never be part of a match ([A-Za-z] only).
ACCENTS = "[À-ÖØ-öø-ÿĀ-ſ]"
NAME_RE_SQL = (r"\b([A-Z][a-z]+(?:[-''][A-Z]?[a-z]+)?"
               r"(?:\s+[A-Z][a-z]+(?:[-''][A-Z]?[a-z]+)?){1,2})\b")


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(words) -> str:
    words = list(dict.fromkeys(words))
    if not words:
        return "[]::VARCHAR[]"
    return "[" + ", ".join(q(w) for w in words) + "]::VARCHAR[]"


def any_in(col: str, words) -> str:
    words = list(dict.fromkeys(words))
    if not words:
        return "false"
    return "(" + " OR ".join(f"contains({col}, {q(w)})" for w in words) + ")"


def count_in(col: str, words) -> str:
    words = list(dict.fromkeys(words))
    if not words:
        return "0"
    return "(" + " + ".join(f"contains({col}, {q(w)})::INT" for w in words) + ")"


def variants_in(col: str, scope_col: str, p: Params) -> str:
    """Any scope spelling (the scope itself or a configured extra) in col."""
    parts = [f"contains({col}, lower({scope_col}))"]
    extras = {}
    for sc in set(list(p.scopes) + list(p.scope_variants)):
        vs = [v for v in p.variants_for(sc) if v != sc.lower()]
        if vs:
            extras[sc.lower()] = vs
    if extras:
        cases = " ".join(f"WHEN {q(k)} THEN {any_in(col, vs)}" for k, vs in sorted(extras.items()))
        parts.append(f"(CASE lower({scope_col}) {cases} ELSE false END)")
    return "(" + " OR ".join(parts) + ")"


POSTS_V = r"""posts_v AS (
  SELECT doc_id AS post_id, source AS platform, lang AS scope,
    trim(regexp_replace(regexp_replace(coalesce(text, ''), 'http\S+|www\.\S+', '', 'g'), '\s+', ' ', 'g')) AS text,
    substr(sha256('user' || (doc_id % 50)::VARCHAR), 1, 12) AS author,
    TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL 1 HOUR AS ts,
    'https://' || source || '.example/post/' || doc_id::VARCHAR AS url,
    n_chars % 97 AS likes, doc_id % 13 AS shares, lang || ' release' AS keyword
  FROM documents)"""


def posts_in_scope(p: Params) -> str:
    if not p.scopes:
        return "posts AS (SELECT * FROM posts_v)"
    return f"posts AS (SELECT * FROM posts_v WHERE scope IN ({', '.join(q(s) for s in p.scopes)}))"


def stop_name(col: str, p: Params) -> str:
    return (f"(list_contains({lst(p.stop_phrases)}, lower({col}))"
            f" OR list_has_any(string_split(lower({col}), ' '), {lst(p.stop_words)})"
            f" OR list_contains({lst(p.scope_names)}, lower({col})))")


def mention_ctes(p: Params) -> str:
    """posts_v, posts, raw matches m0, accepted mentions m, names."""
    titles = lst(p.title_prefixes)
    return f"""{POSTS_V},
{posts_in_scope(p)},
m0 AS (
  SELECT scope, platform, post_id, ts,
    unnest(regexp_extract_all(regexp_replace(text, '{ACCENTS}', '0', 'g'), '{NAME_RE_SQL}', 1)) AS match,
    unnest(generate_series(0, len(regexp_extract_all(regexp_replace(text, '{ACCENTS}', '0', 'g'), '{NAME_RE_SQL}', 1)) - 1)) AS pos
  FROM posts),
m1 AS (
  SELECT *, CASE WHEN ends_with(trim(match), '''s') THEN trim(left(trim(match), length(trim(match)) - 2))
                 ELSE trim(match) END AS raw
  FROM m0),
m2 AS (
  SELECT *, string_split(raw, ' ') AS w FROM m1 WHERE NOT {stop_name('raw', p)}),
m3 AS (
  SELECT *, coalesce(list_position(list_transform(w, lambda x: list_contains({titles}, lower(x))), false), 0) AS fi
  FROM m2),
m4 AS (
  SELECT scope, platform, post_id, ts, pos, match, raw,
         CASE WHEN fi = 0 THEN []::VARCHAR[] ELSE w[fi:] END AS sw FROM m3),
m AS (
  SELECT scope, platform, post_id, ts, pos, raw, array_to_string(sw, ' ') AS name
  FROM m4 WHERE len(sw) >= 2 AND NOT {stop_name("array_to_string(sw, ' ')", p)}),
names AS (
  SELECT scope, name, count(*) AS cnt, list_sort(list_distinct(list(platform))) AS platforms,
         max({{'t': ts, 'p': -post_id, 'q': -pos}}) AS first_seen
  FROM m GROUP BY scope, name)"""


def pair_ctes(p: Params) -> str:
    """Brute-force pairs (nested loop), occurrences (a recursive walk, one row
    per overlapping occurrence), windows and per-name stats."""
    L = "length(nl)"
    rw = (f"substr(tl, greatest(1, pos - {p.role_window}), "
          f"pos + {L} + {p.role_window} - greatest(1, pos - {p.role_window}))")
    sw = (f"substr(tl, greatest(1, pos - {p.scope_window}), "
          f"pos + {L} + {p.scope_window} - greatest(1, pos - {p.scope_window}))")
    return f"""pairs AS (
  SELECT ps.post_id, ps.scope, ps.platform, n.name, lower(ps.text) AS tl, lower(n.name) AS nl
  FROM posts ps JOIN names n ON ps.scope = n.scope AND contains(lower(ps.text), lower(n.name))),
occ(post_id, scope, name, tl, nl, pos) AS (
  SELECT post_id, scope, name, tl, nl, instr(tl, nl) FROM pairs
  UNION ALL
  SELECT post_id, scope, name, tl, nl, pos + instr(substr(tl, pos + 1), nl)
  FROM occ WHERE instr(substr(tl, pos + 1), nl) > 0),
win AS (
  SELECT post_id, scope, name, pos, {rw} AS rw, {sw} AS sw FROM occ),
occ_stats AS (
  SELECT post_id, scope, name, count(*) AS occ,
    sum({any_in('rw', p.role_keywords)}::INT) AS role_hits,
    sum({any_in('rw', p.rival_keywords)}::INT) AS rival_hits,
    sum(({any_in('sw', p.role_keywords)} AND {variants_in('sw', 'scope', p)})::INT) AS role_scope_hits
  FROM win GROUP BY post_id, scope, name),
pair_stats AS (
  SELECT pr.post_id, pr.scope, pr.name, pr.platform, o.occ, o.role_hits, o.rival_hits, o.role_scope_hits,
    CASE WHEN {variants_in('pr.tl', 'pr.scope', p)} THEN {count_in('pr.tl', p.context_words)} ELSE 0 END AS context_score
  FROM pairs pr JOIN occ_stats o USING (post_id, scope, name)),
name_stats AS (
  SELECT scope, name, count(*) AS ci_posts, list_sort(list_distinct(list(platform))) AS ci_platforms,
    sum(role_hits)::BIGINT AS role_hits, sum(rival_hits)::BIGINT AS rival_hits,
    sum(role_scope_hits)::BIGINT AS role_scope_hits, sum(context_score)::BIGINT AS context_score
  FROM pair_stats GROUP BY scope, name),
nodes AS (
  SELECT n.scope, n.name,
    CASE WHEN coalesce(s.ci_posts, 0) > n.cnt THEN s.ci_posts ELSE n.cnt END AS cnt,
    CASE WHEN coalesce(s.ci_posts, 0) > n.cnt
         THEN list_sort(list_distinct(list_concat(n.platforms, s.ci_platforms))) ELSE n.platforms END AS platforms,
    n.first_seen
  FROM names n LEFT JOIN name_stats s USING (scope, name))"""


def merge_ctes() -> str:
    """Greedy variant merge as a recursive walk in rank order."""
    return """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY scope ORDER BY cnt DESC, first_seen DESC) AS r,
         list_distinct(string_split(lower(name), ' ')) AS words
  FROM nodes),
nb AS (
  SELECT a.scope, a.r, a.name,
         coalesce(list(b.name ORDER BY b.r) FILTER (WHERE b.name IS NOT NULL), []::VARCHAR[]) AS earlier
  FROM ranked a LEFT JOIN ranked b
    ON a.scope = b.scope AND b.r < a.r
   AND (list_has_all(a.words, b.words) OR list_has_all(b.words, a.words))
  GROUP BY a.scope, a.r, a.name),
walk(scope, r, kept) AS (
  SELECT DISTINCT scope, 0::BIGINT, []::VARCHAR[] FROM ranked
  UNION ALL
  SELECT w.scope, w.r + 1,
         CASE WHEN list_has_any(n.earlier, w.kept) THEN w.kept ELSE list_append(w.kept, n.name) END
  FROM walk w JOIN nb n ON n.scope = w.scope AND n.r = w.r + 1),
final_kept AS (
  SELECT scope, kept FROM walk QUALIFY row_number() OVER (PARTITION BY scope ORDER BY r DESC) = 1),
assigned AS (
  SELECT rk.scope, rk.name, rk.cnt, rk.platforms,
    CASE WHEN list_contains(fk.kept, rk.name) THEN rk.name
         ELSE list_filter(n.earlier, lambda x: list_contains(fk.kept, x))[1] END AS label
  FROM ranked rk JOIN nb n USING (scope, r) JOIN final_kept fk USING (scope)),
merged AS (
  SELECT a.scope, a.label AS name, sum(a.cnt)::BIGINT AS cnt,
         list_sort(list_distinct(flatten(list(a.platforms)))) AS platforms,
         any_value(rl.r) AS r, any_value(rl.cnt) AS rank_cnt, any_value(rl.first_seen) AS rank_first_seen
  FROM assigned a JOIN ranked rl ON rl.scope = a.scope AND rl.name = a.label
  GROUP BY a.scope, a.label)"""


def scored_ctes(p: Params) -> str:
    return f"""scored AS (
  SELECT m.scope, m.name, m.cnt AS mention_count, m.platforms, m.rank_cnt, m.rank_first_seen,
    s.role_hits, s.rival_hits, s.role_scope_hits, s.context_score,
    m.cnt::DOUBLE * (CASE WHEN len(m.platforms) >= 2 THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END)
      * (1.0::DOUBLE + s.role_hits::DOUBLE / greatest(m.cnt, 1)::DOUBLE * 0.3::DOUBLE
                     + s.role_scope_hits::DOUBLE / greatest(m.cnt, 1)::DOUBLE * 0.3::DOUBLE)
      * (1.0::DOUBLE + s.context_score::DOUBLE / 10.0::DOUBLE) AS score
  FROM merged m JOIN name_stats s USING (scope, name)
  WHERE m.cnt >= {p.min_mentions}
    AND s.role_scope_hits > 0 AND s.role_hits > 0 AND s.context_score > 0
    AND s.rival_hits < s.role_hits),
entities AS (
  SELECT *, row_number() OVER (PARTITION BY scope
            ORDER BY score DESC, rank_cnt DESC, rank_first_seen DESC) AS rank
  FROM scored QUALIFY rank <= {p.top_k})"""


def discovery_sql(p: Params, select: str) -> str:
    return ("WITH RECURSIVE " + mention_ctes(p) + ",\n" + pair_ctes(p) + ",\n"
            + merge_ctes() + ",\n" + scored_ctes(p) + "\n" + select)


def exact_mean(expr: str, digits: int) -> str:
    """SQL twin of ``functions.text.exact_mean`` (integer half-even division)."""
    scale = 10 ** digits
    s = f"sum(round(({expr}) * {scale})::BIGINT)"
    n = f"count({expr})"
    r = f"((({s}) % ({n}) + ({n})) % ({n}))"
    q = f"((({s}) - {r}) // ({n}))"
    k = (f"({q} + CASE WHEN 2 * {r} > ({n}) OR (2 * {r} = ({n}) AND ((({q}) % 2) + 2) % 2 = 1) "
         f"THEN 1 ELSE 0 END)")
    return (f"(CASE WHEN {n} = 0 THEN NULL WHEN {k} = 0 AND {s} < 0 THEN -1.0::DOUBLE * 0.0::DOUBLE "
            f"ELSE {k}::DOUBLE / {scale}.0::DOUBLE END)")
