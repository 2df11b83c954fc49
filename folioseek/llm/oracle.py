"""SQL for the registered queries of this folder, in DuckDB's dialect."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_minhash_near_dedup": rf"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
          SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [list_aggregate(w, 'string_agg', ' ')]
            ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
        n AS (SELECT doc_id, len(s) AS n FROM s),
        classes AS (
          SELECT doc_id, min(doc_id) OVER (PARTITION BY hash(list_sort(s)), list_sort(s)) AS class FROM s WHERE len(s) > 0),
        e AS (SELECT doc_id, unnest(s) AS g FROM s WHERE doc_id IN (SELECT class FROM classes)),
        common AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        one_way AS (
          SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
        links AS (SELECT a, b FROM one_way UNION ALL SELECT b, a FROM one_way),
        degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a),
        reach AS (
          SELECT DISTINCT class AS a, class AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        parts AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
        SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(p.component, n.doc_id) AS component_id,
          n.doc_id = coalesce(p.component, n.doc_id) AS kept
        FROM n LEFT JOIN classes c ON c.doc_id = n.doc_id LEFT JOIN parts p ON p.a = c.class""",
    "op2_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
        l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
          list_transform(range(1, len(w) - 6), lambda i: list_aggregate(w[i : i + 7], 'string_agg', ' ')) AS wins FROM d),
        e AS (SELECT doc_id, unnest(wins) AS win, unnest(range(1, len(wins) + 1)) AS pos FROM l),
        again AS (SELECT doc_id, pos FROM e QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
        covered AS (SELECT doc_id, count(DISTINCT pos + k) AS n FROM again, range(8) r(k) GROUP BY doc_id),
        m AS (
          SELECT l.doc_id, text, w, CAST(len(w) AS BIGINT) AS n_words,
            CAST(length(list_aggregate([''] || w, 'string_agg', '')) AS BIGINT) AS word_chars,
            CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
            CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
          FROM l LEFT JOIN covered c ON c.doc_id = l.doc_id),
        f AS (
          SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
            length(regexp_replace(text, '[^\p{{L}}]', '', 'g')) AS letters,
            length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS capitals,
            len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS stutters FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT (base_failed OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 40 * n_lines OR 2 * word_chars < 5 * n_words
            OR word_chars > 14 * n_words OR 2 * capitals > letters OR 2 * letters < word_chars OR 5 * stutters > n_words) AS kept
        FROM f""",
    "op5_mix_sources": rf"""
        WITH w AS (SELECT doc_id, source, {_WORDS} AS w FROM documents),
        d AS (
          SELECT doc_id, source, CAST(len(w) AS BIGINT) AS size,
            CASE WHEN len(w) = 0 THEN 64 ELSE greatest(1, least(64, round(len(list_distinct(w)) / len(w) * 64))) END::BIGINT AS level
          FROM w),
        s AS (
          SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
          FROM d GROUP BY source),
        o AS (
          SELECT *, sum(source_size) OVER () * 150 / 100.0 AS wanted,
            coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
            sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_on FROM s),
        p AS (SELECT *, (wanted - 2 * before) / weight_on AS share FROM o),
        free AS (SELECT max(share) AS share FROM p WHERE share * weight <= 2 * source_size),
        t AS (
          SELECT source, source_size,
            CASE WHEN p.share * weight > 2 * source_size THEN 2.0 * source_size ELSE free.share * weight END::DOUBLE AS target FROM p, free),
        lv AS (SELECT source, level, sum(size) AS words FROM d GROUP BY ALL),
        c1 AS (
          SELECT lv.*, target, source_size,
            coalesce(sum(words) OVER (PARTITION BY lv.source ORDER BY level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
            sum(words * level) OVER (PARTITION BY lv.source ORDER BY level DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mass
          FROM lv JOIN t ON lv.source IS NOT DISTINCT FROM t.source),
        c2 AS (SELECT *, CASE WHEN mass > 0 THEN (target - 2 * above) / mass END AS factor FROM c1),
        c3 AS (SELECT *, coalesce(factor * level >= 2, true) AS limited FROM c2),
        c4 AS (SELECT *, CASE WHEN limited THEN 2.0 ELSE arg_max(CASE WHEN NOT limited THEN factor END, CASE WHEN NOT limited THEN level END) OVER (PARTITION BY source) * level END AS want FROM c3),
        c5 AS (SELECT *, floor(want)::BIGINT AS whole, want - floor(want) AS part FROM c4),
        lft AS (SELECT source, any_value(target) - sum(whole * words) AS lft FROM c5 GROUP BY source),
        u AS (
          SELECT d.*, c5.source_size, c5.target, whole, part,
            (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':1'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
          FROM d JOIN c5 ON d.source IS NOT DISTINCT FROM c5.source AND d.level = c5.level),
        r AS (SELECT *, CASE WHEN part > 0 AND size > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS rank FROM u),
        k AS (
          SELECT r.*, lft, sum(size) FILTER (rank IS NOT NULL) OVER (PARTITION BY r.source ORDER BY rank NULLS LAST, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
          FROM r JOIN lft ON r.source IS NOT DISTINCT FROM lft.source),
        n AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE whole + coalesce(rank IS NOT NULL AND upto - size / 2 <= lft, false)::INT END::BIGINT AS copies FROM k)
        SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM n""",
    "op12_conversation_trie": """
        WITH crc_bytes AS (
          SELECT list(c ORDER BY i) AS crc_table FROM (
            SELECT i, list_reduce([i] || range(8), lambda c, bit: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
        t AS (
          SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
          FROM conversations WHERE conv_id IS NOT NULL),
        lengths AS (SELECT conv_id, count(*) AS own FROM t GROUP BY conv_id),
        c AS (
          SELECT l.conv_id, l.conv_id - l.conv_id % 100 AS base,
            xor(list_reduce([4294967295] || [ascii(x) for x in string_split(l.conv_id::VARCHAR, '')],
              lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
          FROM lengths l, crc_bytes),
        k AS (SELECT c.*, least(h, coalesce(b.own, 0)) AS kept FROM c LEFT JOIN lengths b ON b.conv_id = c.base),
        r AS (
          SELECT k.conv_id, t.pos AS d, role, text FROM k JOIN t ON t.conv_id = k.base AND t.pos <= k.kept
          UNION ALL SELECT k.conv_id, kept + t.pos - h, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND t.pos > h),
        m AS (
          SELECT conv_id, 0 AS d, '' AS key, 0 AS size FROM k
          UNION ALL SELECT conv_id, d, string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY d), length(text) FROM r),
        nodes AS (SELECT d, key, min(conv_id) AS least, count(*) AS n, any_value(size) AS size FROM m GROUP BY d, key),
        finals AS (SELECT conv_id, d, key FROM m QUALIFY d = max(d) OVER (PARTITION BY conv_id)),
        ends AS (SELECT d, key, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends FROM finals GROUP BY d, key),
        kids AS (SELECT d - 1 AS d, left(key, -64) AS key, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
        below AS (
          SELECT a.d, a.key, count(*) FILTER (kids.n_children IS NULL) AS n_leaves, sum((b.n - 1) * b.size) AS saved
          FROM nodes b LEFT JOIN kids ON kids.d = b.d AND kids.key = b.key JOIN m a ON a.conv_id = b.least AND a.d <= b.d GROUP BY a.d, a.key)
        SELECT x.least AS conv_id, CAST(x.d AS BIGINT) AS depth, p.least AS parent_conv_id, x.n AS n_convs,
          coalesce(kids.n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
        FROM nodes x JOIN below ON below.d = x.d AND below.key = x.key LEFT JOIN nodes p ON p.d = x.d - 1 AND p.key = left(x.key, -64) AND x.d > 0
        LEFT JOIN kids ON kids.d = x.d AND kids.key = x.key LEFT JOIN ends ON ends.d = x.d AND ends.key = x.key""",
}

_ESCAPED = r"replace(replace(coalesce({0}, ''), '\', '\\'), '<|', '<\|')"

ORACLE_SQL["op4_chat_prefix_targets"] = rf"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r, text AS x FROM conversations
      UNION ALL SELECT -1, n, r, '<|im_end|><|im_start|>assistant ok', r, '<|im_end|><|im_start|>assistant ok'
      FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)),
    o AS (
      SELECT *, row_number() OVER w AS pos, count(*) OVER (PARTITION BY conv_id) AS n,
        sum(length('<|im_start|>' || replace({_ESCAPED.format('role')}, chr(10), '\n') || chr(10) || {_ESCAPED.format('text')}
          || '<|im_end|>' || chr(10))) OVER w AS upto
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(upto) FILTER (role = 'assistant' OR pos = n)::BIGINT AS formatted_chars
    FROM o GROUP BY conv_id"""


def _host_sql(rounds: int) -> str:
    """The rounds of the host graph as one table after the other."""
    url = "coalesce(url, '')"
    fits = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
    cases = [("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("net", "/", "block")]
    rule = " ".join(f"WHEN {fits.format(h, p)} THEN '{h}{p}'" for h, p, _ in cases)
    says = " ".join(f"WHEN {fits.format(h, p)} THEN '{v}'" for h, p, v in cases)
    steps = "".join(
        f""",
    r{i} AS MATERIALIZED (
      SELECT host, sum(trust) AS trust, sum(distrust) AS distrust FROM (
        SELECT s.target AS host, CASE WHEN forward THEN 0.85 * share * r.trust ELSE 0 END AS trust,
          CASE WHEN forward THEN 0 ELSE 0.85 * share * r.distrust END AS distrust
        FROM shares s JOIN r{i - 1} r ON s.giver = r.host
        UNION ALL SELECT host, 0.15 * trust, 0.15 * distrust FROM r0) GROUP BY host)"""
        for i in range(1, rounds + 1)
    )
    return rf"""
    WITH h AS (
      SELECT page_id, translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, coalesce(html, '') AS html FROM pages),
    u AS (SELECT *, CASE {rule} END AS rule, CASE {says} END AS ruled FROM h),
    c AS (SELECT host, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM u WHERE host <> '' GROUP BY host),
    r0 AS MATERIALIZED (
      SELECT host, a / greatest(1, sum(a) OVER ()) AS trust, b / greatest(1, sum(b) OVER ()) AS distrust FROM c),
    l AS (
      SELECT host AS source, translate(unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?(?:https?:)?//([^/?#"''\s>]+)', 1)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS target FROM h WHERE host <> ''),
    known AS (SELECT host FROM c UNION SELECT target FROM l WHERE source <> target),
    names AS (SELECT DISTINCT host, string_split(host, '.') AS p FROM known),
    chain AS (
      SELECT DISTINCT list_aggregate(p[i : len(p)], 'string_agg', '.') AS source, list_aggregate(p[i + 1 : len(p)], 'string_agg', '.') AS target
      FROM names, unnest(range(1, len(p) - 1)) x(i)),
    e AS (
      SELECT source, target, sum(w) AS weight FROM (
        SELECT source, target, 1.0 AS w FROM l WHERE source <> target UNION ALL SELECT source, target, 1.0 FROM chain
        UNION ALL SELECT target, source, 1.0 FROM chain) GROUP BY ALL),
    shares AS MATERIALIZED (
      SELECT source AS giver, target, true AS forward, weight / sum(weight) OVER (PARTITION BY source) AS share FROM e
      UNION ALL SELECT target, source, false, weight / sum(weight) OVER (PARTITION BY target) FROM e){steps}
    SELECT page_id, u.host, path, rule, coalesce(ruled, CASE WHEN distrust > trust * (1 + 1e-9) THEN 'block' ELSE 'allow' END) AS verdict
    FROM u LEFT JOIN r{rounds} r ON r.host = u.host"""


ORACLE_SQL["op8_host_graph"] = _host_sql(12)
