"""DuckDB SQL with the rows of plans.queries."""

from __future__ import annotations

from lexibond.config import size_quotas
from lexibond.functions.text import WORD_PATTERN
from lexibond.functions.units import CORPUS_TOKENS, STEP_GROWTH
from lexibond.plans.queries import BATCH, CAP, MAX_SIZE, MIN_COUNT, PERCENTS, RUN_LINES, VOCAB_SIZE

_PATTERN = WORD_PATTERN.replace("'", "''")


# The accented letters of the test tables and their bases, stated apart from the engine's rule.
ACCENTED, PLAIN = "éèêóñçüäöí", "eeeoncuaoi"


def _toks(table: str = "documents", sample: str = "doc_id", where: str = "true") -> str:
    return f"SELECT {sample} AS sample_id, coalesce(regexp_extract_all(translate(lower(text), '{ACCENTED}', '{PLAIN}'), '{_PATTERN}'), []) AS t FROM {table} WHERE {where}"


def _cols(n: int, a: str = "") -> str:
    return ", ".join(f"{a}token_{i}" for i in range(n))


def _grams(n: int, extra: str = "") -> str:
    """Rows of one size from CTE tok."""
    picks = ", ".join(f"t[i + {j}] AS token_{j}" for j in range(n))
    return f"SELECT {extra} {picks} FROM (SELECT *, unnest(range(1, len(t) - {n} + 2)) AS i FROM tok)"


def _counts(n: int, least: int) -> str:
    return f"SELECT {_cols(n)}, count(*) AS count FROM ({_grams(n)}) GROUP BY {_cols(n)} HAVING count(*) >= {least}"


def _total(n: int) -> str:
    return f"(SELECT CAST(sum(greatest(len(t) - {n - 1}, 0)) AS BIGINT) FROM tok)"


def _names(cap: int) -> str:
    """CTE v: the ids of words. 0 is [UNK], 1 to 4 are the other special tokens, `cap` ids in all."""
    return f"v AS MATERIALIZED (SELECT token, 4 + row_number() OVER (ORDER BY c DESC, token) AS token_id FROM (SELECT t AS token, count(*) AS c FROM (SELECT unnest(t) AS t FROM tok) GROUP BY 1) QUALIFY token_id < {cap})"


def _id_lists(cap: int) -> str:
    """CTE ids: the documents as lists t of ids."""
    return f"WITH tok AS MATERIALIZED ({_toks()}), {_names(cap)}, w AS MATERIALIZED (SELECT sample_id, unnest(range(0, len(t))) AS pos, unnest(t) AS token FROM tok), ids AS MATERIALIZED (SELECT sample_id, list(CAST(coalesce(token_id, 0) AS BIGINT) ORDER BY pos) AS t FROM w LEFT JOIN v USING (token) GROUP BY sample_id)"


def _chain(n_max: int, least: int = MIN_COUNT, tok: str | None = None) -> str:
    """CTEs s1..sN with count, ll, mx (null for size 1) and best, and v with the ids of tokens."""
    parts = [f"tok AS MATERIALIZED ({tok or _toks()})", _names(500_000)]
    for n in range(1, n_max + 1):
        parts.append(f"c{n} AS MATERIALIZED ({_counts(n, least)})")
        parts.append(f"l{n} AS (SELECT *, ln(count) - ln({_total(n)}) AS ll FROM c{n})")
        if n == 1:
            parts.append("s1 AS (SELECT *, ll AS best FROM l1)")
            continue
        joins, sums = [], []
        for k in range(1, n):
            on_a = " AND ".join(f"m.token_{i} = a{k}.token_{i}" for i in range(k))
            on_b = " AND ".join(f"m.token_{k + i} = b{k}.token_{i}" for i in range(n - k))
            joins.append(f"LEFT JOIN s{k} a{k} ON {on_a} LEFT JOIN s{n - k} b{k} ON {on_b}")
            sums.append(f"a{k}.best + b{k}.best")
        mx = sums[0] if len(sums) == 1 else f"greatest({', '.join(sums)})"
        parts.append(f"x{n} AS (SELECT {_cols(n, 'm.')}, m.count, m.ll, {mx} AS mx FROM l{n} m {' '.join(joins)})")
        parts.append(f"s{n} AS MATERIALIZED (SELECT *, greatest(ll, mx) AS best, round(2 * ll - mx, 6) AS pmi_score FROM x{n})")
    return "WITH " + ", ".join(parts)


def _ranked(n: int, k: int) -> str:
    """The best of a size; ties go to the smaller ids."""
    text = " || ' ' || ".join(f"token_{i}" for i in range(n))
    ids = ", ".join(f"v{i}.token_id AS id_{i}" for i in range(n))
    named = " ".join(f"JOIN v v{i} ON v{i}.token = token_{i}" for i in range(n))
    order = ", ".join(f"id_{i}" for i in range(n))
    return f"SELECT * FROM (SELECT CAST({n} AS BIGINT) AS n, row_number() OVER (ORDER BY pmi_score DESC NULLS LAST, {order}) AS rank, * FROM (SELECT {text} AS ngram_text, {_cols(n)}, {ids}, pmi_score FROM s{n} {named})) WHERE rank <= {k}"


def _compare() -> str:
    half = lambda low: f"{_chain(2, tok=_toks(where=f'''CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) BETWEEN {low} AND {low + 9}'''))} SELECT ngram_text FROM ({_ranked(2, 500)})"
    return f"""WITH a AS ({half(0)}), b AS ({half(10)}), k AS (SELECT count(*) AS common FROM (SELECT ngram_text FROM a INTERSECT SELECT ngram_text FROM b))
      SELECT common, (SELECT count(*) FROM a) AS first_size, (SELECT count(*) FROM b) AS second_size, common / (SELECT count(*) FROM a) AS first_share, common / (SELECT count(*) FROM b) AS second_share FROM k"""


_LOG = """(SELECT event_id AS line_no, ts, strftime(ts, '%Y-%m-%d %H:%M:%S') || ',123 - user.' || user_id || ' - INFO - ' || CASE event_type WHEN 'click' THEN 'start' WHEN 'purchase' THEN 'end' ELSE 'n_tokens: ' || event_id END AS line FROM events)"""
_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}),\d+ - ([\w.]+) - (\w+) - (.*)$"
_PARSED = f"(SELECT line_no, CAST(epoch(CAST(regexp_extract(line, '{_LINE}', 1) AS TIMESTAMP)) AS BIGINT) AS secs, regexp_extract(line, '{_LINE}', 2) AS module_name, regexp_extract(line, '{_LINE}', 3) AS level, regexp_extract(line, '{_LINE}', 4) AS message FROM {_LOG})"


def _run() -> str:
    """The lines of the sample log's last finished run."""
    rows = ", ".join(f"({i}, '{line}')" for i, line in enumerate(RUN_LINES))
    return f"""WITH raw(line_no, line) AS (VALUES {rows}),
      p AS (SELECT line_no, epoch(CAST(regexp_extract(line, '{_LINE}', 1) AS TIMESTAMP)) AS secs, regexp_extract(line, '{_LINE}', 2) AS module_name, regexp_extract(line, '{_LINE}', 4) AS message FROM raw),
      e AS (SELECT max(line_no) AS hi FROM p WHERE message = 'end experiment: small'),
      b AS (SELECT max(line_no) AS lo FROM p, e WHERE message = 'start experiment: small' AND line_no < hi),
      run AS (SELECT p.* FROM p, b, e WHERE line_no BETWEEN lo AND hi),
      steps AS (SELECT replace(module_name, 'lexibond.run.', '') AS step, count(*) FILTER (message = 'end') AS pairs, CAST(max(secs) FILTER (message = 'end') - max(secs) FILTER (message = 'start') AS BIGINT) AS seconds FROM run WHERE message IN ('start', 'end') GROUP BY 1),
      facts AS (SELECT max(CASE WHEN message LIKE 'n_tokens: %' THEN CAST(message[11:] AS BIGINT) END) AS n_tokens, max(CASE WHEN message LIKE 'n_workers: %' THEN CAST(message[12:] AS BIGINT) END) AS n_workers,
        max(CASE WHEN message LIKE 'RAM_size: %' THEN CAST(message[11:] AS BIGINT) END) AS ram, CAST(max(secs) - min(secs) AS BIGINT) AS total_time,
        greatest(max(CASE WHEN message LIKE 'db size bytes%' THEN CAST(regexp_extract(message, '([0-9]+)$', 1) AS BIGINT) END), CAST(sum(CASE WHEN message LIKE 'samples %' THEN CAST(regexp_extract(message, '([0-9]+)$', 1) AS BIGINT) END) AS BIGINT)) AS total_space FROM run)"""


def _estimates() -> str:
    linear = lambda c, f: f"{f} * {c} / n_tokens * seconds"
    nlogn = lambda c, f, v="seconds": f"{f} * ({c} * log2({c})) / (n_tokens * log2(n_tokens)) * {v}"
    out = []
    for name, n in CORPUS_TOKENS.items():
        c = f"{n}.0::DOUBLE"
        case = " ".join(f"WHEN '{s}' THEN {(linear if kind == 'linear' else nlogn)(c, f)}" for s, (kind, f) in STEP_GROWTH.items())
        out.append(f"SELECT '{name}' AS target, round({c} / n_tokens * total_space, 3) AS space, round(n_workers / 16.0::DOUBLE * {nlogn(c, 1, 'total_time')}, 3) AS time_n_log_n, round((SELECT sum(n_workers / 16.0::DOUBLE * CASE step {case} END) FROM steps), 3) AS time_by_steps FROM facts")
    return _run() + " " + " UNION ALL ".join(out)


def _unit(v: str, steps: list[tuple[str, str]], last: str) -> str:
    whens = " ".join(f"WHEN {cond} THEN {text}" for cond, text in steps)
    return f"CASE {whens} ELSE {last} END"


def all_oracles() -> dict[str, str]:
    tok = f"WITH tok AS ({_toks()})"
    vocab = "SELECT t AS token, count(*) AS c FROM (SELECT unnest(t) AS t FROM tok) GROUP BY 1"
    special = "SELECT * FROM (VALUES ('[UNK]', 0), ('[PAD]', 1), ('[CLS]', 2), ('[SEP]', 3), ('[MASK]', 4)) v(token, token_id)"
    quotas = size_quotas(PERCENTS, VOCAB_SIZE)
    d = "o_totalprice"
    q = "(o_totalprice * o_totalprice)"
    out = {
        "corpus_union": "SELECT text FROM documents UNION ALL SELECT text FROM conversations",
        "first_n_samples": "SELECT doc_id AS sample_id, text FROM documents ORDER BY doc_id LIMIT 100",
        "word_tokens": f"{tok} SELECT sample_id, CAST(unnest(range(0, len(t))) AS BIGINT) AS pos, unnest(t) AS token FROM tok",
        "token_vocab": f"{tok} SELECT token, CAST(token_id AS BIGINT) AS token_id FROM ({special} UNION ALL SELECT token, 4 + row_number() OVER (ORDER BY c DESC, token) FROM ({vocab}))",
        "encoded_ids": f"{tok}, v AS (SELECT token, 4 + row_number() OVER (ORDER BY c DESC, token) AS token_id FROM ({vocab}) QUALIFY token_id < 5000) SELECT sample_id, pos, CAST(coalesce(token_id, 0) AS BIGINT) AS token_id FROM (SELECT sample_id, CAST(unnest(range(0, len(t))) AS BIGINT) AS pos, unnest(t) AS token FROM tok) LEFT JOIN v USING (token)",
        "decoded_ids": f"{_chain(2)} SELECT rank, id_0, id_1, ngram_text FROM ({_ranked(2, 200)})",
        "capped_counts": f"{_id_lists(CAP)} " + " UNION ALL ".join(f"SELECT {', '.join(f't[i + {j}] AS id_{j}' if j < n else f'CAST(-1 AS BIGINT) AS id_{j}' for j in range(3))}, count(*) AS count FROM (SELECT t, unnest(range(1, len(t) - {n} + 2)) AS i FROM ids) GROUP BY ALL HAVING count(*) >= {MIN_COUNT}" for n in (1, 2, 3)),
        "written_counts_3": f"{_id_lists(500_000)} SELECT t[i] AS token_0, t[i + 1] AS token_1, t[i + 2] AS token_2, count(*) AS count FROM (SELECT t, unnest(range(1, len(t) - 1)) AS i FROM ids) GROUP BY ALL HAVING count(*) >= {MIN_COUNT}",
        "written_totals": tok + " " + " UNION ALL ".join(f"SELECT CAST({n} AS BIGINT) AS n, {_total(n)} AS total" for n in range(1, MAX_SIZE + 1)),
        "written_vocabulary": f"{_chain(5)} " + " UNION ALL ".join(f"SELECT ngram_text FROM ({_ranked(n, quotas[n])})" for n in quotas),
        "written_log": f"{_run()} SELECT line_no, CAST(secs AS BIGINT) AS secs, module_name, message FROM p",
        "corpus_pages": "SELECT page_id AS sample_id, html AS text FROM pages",
        "corpus_benchmark": "SELECT item_id AS sample_id, text FROM benchmark",
        "total_ngrams_per_size": tok + " " + " UNION ALL ".join(f"SELECT CAST({n} AS BIGINT) AS n, {_total(n)} AS total" for n in range(1, MAX_SIZE + 1)),
        "ngram_table_sizes": tok + " " + " UNION ALL ".join(f"SELECT CAST({n} AS BIGINT) AS n, count(*) AS ngrams FROM ({_counts(n, MIN_COUNT)})" for n in range(1, MAX_SIZE + 1)),
        "batch_counts_2": f"{tok} SELECT token_0, token_1, batch_id, count(*) AS count FROM ({_grams(2, f'CAST(floor(sample_id / {BATCH}) AS BIGINT) AS batch_id,')}) GROUP BY ALL HAVING count(*) >= 3",
        "batch_pruned_counts_2": f"{tok}, b AS (SELECT token_0, token_1, count(*) AS c FROM ({_grams(2, f'sample_id // {BATCH} AS batch_id,')}) GROUP BY batch_id, token_0, token_1 HAVING count(*) >= 2) SELECT token_0, token_1, CAST(sum(c) AS BIGINT) AS count FROM b GROUP BY 1, 2 HAVING sum(c) >= {MIN_COUNT}",
        "merged_counts_2": f"WITH tok AS ({_toks()} UNION ALL {_toks('conversations', 'conv_id * 1000 + turn')}) {_counts(2, MIN_COUNT)}",
        "max_segmentation_bruteforce_3": f"{_chain(3)} SELECT token_0, token_1, token_2, round(mx, 6) AS max_segmentation_log_likelihood_sum FROM s3",
        "max_segmentation_by_splits_4": f"{_chain(4)} SELECT {_cols(4)}, round(mx, 6) AS max_segmentation_log_likelihood_sum FROM s4",
        "segmentations_3": f"{tok}, c AS ({_counts(3, 20)}) SELECT token_0 || ' ' || token_1 || ' ' || token_2 AS ngram_text, unnest([token_0 || ' / ' || token_1 || ' ' || token_2, token_0 || ' ' || token_1 || ' / ' || token_2, token_0 || ' / ' || token_1 || ' / ' || token_2]) AS segmentation FROM c",
        "vocab_topk_2": f"{_chain(2)} SELECT rank, token_0, token_1, pmi_score FROM ({_ranked(2, 500)})",
        "vocab_all_sizes": f"{_chain(5)} " + " UNION ALL ".join(f"SELECT n, rank, ngram_text, pmi_score FROM ({_ranked(n, quotas[n])})" for n in quotas),
        "vocab_decoded": f"{_chain(3)} SELECT regexp_replace(ngram_text, ' ([.,!?])', '\\1', 'g') AS ngram_text FROM (SELECT ngram_text FROM ({_ranked(2, 300)}) UNION ALL SELECT ngram_text FROM ({_ranked(3, 200)}))",
        "vocab_compare": _compare(),
        "event_sequence_pmi": f"{_chain(2, 1, 'SELECT user_id AS sample_id, list(event_type ORDER BY ts, event_id) AS t FROM events GROUP BY user_id')} SELECT token_0, token_1, count, pmi_score FROM s2",
        "log_parsed": f"SELECT line_no, secs, module_name, level, message FROM {_PARSED}",
        "log_values": f"SELECT line_no, CAST(message[11:] AS BIGINT) AS n_tokens FROM {_PARSED} WHERE message LIKE 'n_tokens: %'",
        "log_pairing": f"WITH p AS (SELECT *, last_value(CASE WHEN message = 'start' THEN {{'l': line_no, 'a': secs}} END IGNORE NULLS) OVER (PARTITION BY module_name ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM {_PARSED} WHERE message IN ('start', 'end')) SELECT module_name, s.l AS start_line, line_no AS end_line, secs - s.a AS seconds FROM p WHERE message = 'end'",
        "log_step_times": f"{_run()} SELECT step, pairs, seconds FROM steps",
        "log_report": f"{_run()} SELECT '| documents | ' || format('{{:,}}', n_tokens) || ' | x86_64 | ' || n_workers || ' | ' || printf('%.2f GB', ram / 1073741824.0) || ' | Linux | ' || printf('%.2f minutes', total_time / 60.0) || ' | ' || printf('%.2f KB', total_space / 1024.0) || ' |' AS report FROM facts",
        "log_experiment": f"{_run()} SELECT n_tokens, total_time, total_space, CAST((SELECT sum(seconds) FROM steps) AS DOUBLE) AS step_seconds FROM facts",
        "resource_estimate": _estimates(),
        "human_units": f"SELECT o_orderkey, {_unit(d, [(f'{d} < 120', f'''printf('%.2f seconds', {d})'''), (f'{d} / 60 < 120', f'''printf('%.2f minutes', {d} / 60)'''), (f'{d} / 60 / 60 < 50', f'''printf('%.2f hours', {d} / 60 / 60)''')], f'''printf('%.2f days', {d} / 60 / 60 / 24)''')} AS duration, "
        + _unit(q, [(f"{q} / {1024.0**p} < 1024", f"printf('%.2f {u}', {q} / {1024.0**p})") for p, u in ((0, "Bytes"), (1, "KB"), (2, "MB"), (3, "GB"))], f"printf('%.2f TB', {q} / {1024.0**4})") + " AS size FROM orders",
        "extrapolation": "SELECT p_partkey, round((p_size + 1.0::DOUBLE) * 10 / (p_size + 1.0::DOUBLE) * p_retailprice, 6) AS linear, round(((p_size + 1.0::DOUBLE) * 10 * log2((p_size + 1.0::DOUBLE) * 10)) / ((p_size + 1.0::DOUBLE) * log2(p_size + 1.0::DOUBLE)) * p_retailprice, 6) AS n_log_n, round(pow((p_size + 1.0::DOUBLE) * 10, 1.5) / pow(p_size + 1.0::DOUBLE, 1.5) * p_retailprice, 6) AS times_sqrt FROM part",
    }
    for n in range(1, 6):
        out[f"ngram_counts_{n}"] = f"{tok} {_counts(n, MIN_COUNT)}"
        out[f"log_likelihood_{n}"] = f"{tok}, c AS ({_counts(n, MIN_COUNT)}) SELECT {_cols(n)}, count, round(ln(count) - ln({_total(n)}), 6) AS log_likelihood FROM c"
    for n in range(2, 6):
        out[f"max_segmentation_{n}"] = f"{_chain(n)} SELECT {_cols(n)}, round(mx, 6) AS max_segmentation_log_likelihood_sum FROM s{n}"
        out[f"pmi_score_{n}"] = f"{_chain(n)} SELECT {_cols(n)}, count, pmi_score FROM s{n}"
    return out
