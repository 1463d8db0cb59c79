"""DuckDB SQL with the rows of those queries that SQL can express over whole tables."""

from __future__ import annotations

from lexibond.llm.chat_format import BODY, CONTROL, END, START

_WORD = r"[^\x20\x09-\x0D]+"


def topk_sql() -> str:
    return """
      WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
                 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
      s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.w[i] * c.w[i] FOR i IN range(1, len(q.w) + 1)]) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
      SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
      QUALIFY rank <= 20"""


def chat_sql() -> str:
    quote = lambda s: "".join("\\" + c if c in "|[]/\\." else c for c in s)
    pattern = "(" + "|".join(quote(c) for c in sorted(CONTROL, key=len, reverse=True)) + ")"
    size = lambda c: f"length(regexp_replace(replace({c}, '\\', '\\\\'), '{pattern}', 'x\\1', 'g'))"
    fixed = len(START) + len(BODY) + len(END)
    return f"""
      WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                 UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
      SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum({fixed} + {size('role')} + {size('text')}) AS BIGINT) AS formatted_chars
      FROM t GROUP BY conv_id"""


def jaccard_sql(k: int = 3, num: int = 90, den: int = 100) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
      WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{_WORD}') AS w FROM documents),
      s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + {k - 1}], ' ') FOR i IN range(1, len(w) - {k - 2})] END) AS x FROM w),
      n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
      p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
      l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * c >= {num} * (x.n + y.n - c)),
      e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
      r(doc_id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.seen)
      SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.low AS component_id FROM w LEFT JOIN n USING (doc_id)
      JOIN (SELECT doc_id, min(seen) AS low FROM r GROUP BY 1) m USING (doc_id)"""


def repeats_sql(width: int = 100) -> str:
    """Every window of `width` bytes with its first place; what later ones cover goes. Windows are compared by md5."""
    return f"""
      WITH d AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
      w AS MATERIALIZED (SELECT doc_id, i, md5(array_slice(b, i, i + {width - 1})) AS k FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - {width - 2})) AS i FROM d)),
      f AS (SELECT k, min(CAST(doc_id AS HUGEINT) * 4294967296 + i) AS first FROM w GROUP BY k HAVING count(*) > 1),
      r AS (SELECT doc_id, i FROM w JOIN f USING (k) WHERE CAST(doc_id AS HUGEINT) * 4294967296 + i > first),
      g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {width} THEN 1 ELSE 0 END AS fresh FROM r)),
      s AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + {width - 1} AS z FROM g GROUP BY doc_id, run),
      e AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS low, a - 1 AS high FROM s
            UNION ALL SELECT doc_id, octet_length(b) + 1, coalesce((SELECT max(z) FROM s WHERE s.doc_id = d.doc_id), 0) + 1, octet_length(b) FROM d),
      p AS (SELECT doc_id, string_agg(CASE WHEN high >= low THEN hex(array_slice(b, low, high)) ELSE '' END, '' ORDER BY a) AS h FROM e JOIN d USING (doc_id) GROUP BY doc_id),
      n AS (SELECT doc_id, CAST(sum(z - a + 1) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
      SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(h)) AS kept_sha256
      FROM d JOIN p USING (doc_id) LEFT JOIN n USING (doc_id)"""


def llm_oracles() -> dict[str, str]:
    return {"op1_suffix_dedup": repeats_sql(), "op5_jaccard_join": jaccard_sql(), "op8_exact_topk": topk_sql(), "op9_chat_format": chat_sql()}
