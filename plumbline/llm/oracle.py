"""DuckDB SQL for the registered queries of this package that SQL can express."""

from __future__ import annotations

from plumbline.llm import chat, mixing, secrets

OP3 = r"""
WITH words AS (
  SELECT doc_id AS id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id AS id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT id AS item, least(len(w), 13) AS n,
    array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS gram
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (
  SELECT id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n)),
found AS (SELECT g.id, g.i, g.n, s.item FROM grams g JOIN windows s ON g.n = s.n AND g.gram = s.gram),
hit AS (SELECT id, count(DISTINCT p) AS n_hit
  FROM (SELECT id, unnest(range(i, i + n)) AS p FROM found) GROUP BY id),
of_doc AS (
  SELECT id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT id, item, CAST(item AS VARCHAR) AS name FROM found) GROUP BY id)
SELECT words.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words,
  CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit ON hit.id = words.id LEFT JOIN of_doc ON of_doc.id = words.id
"""

def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _matches(kind: int, pattern: str, good: str) -> str:
    """A row per match: number, match and end; the gaps between matches come from splitting."""
    return rf"""SELECT doc_id, {kind} AS kind, i, m[i] AS match,
      list_sum(list_transform(g[1 : i], lambda x: length(x))) +
      list_sum(list_transform(m[1 : i], lambda x: length(x))) AS stop, {good} AS good
    FROM (SELECT doc_id, t, m, string_split_regex(t, {_quoted(pattern)}) AS g, unnest(range(1, len(m) + 1)) AS i
      FROM (SELECT doc_id, t, regexp_extract_all(t, {_quoted(pattern)}) AS m FROM docs))"""


def _tail(z: str) -> str:
    return f"1 / (1 + exp(1.5976 * ({z}) + 0.07056 * ({z}) * ({z}) * ({z})))"


def _secret_scan() -> str:
    alphabet = " ".join(
        f"WHEN regexp_matches(body, {_quoted(pattern)}) THEN {_quoted(letters)}"
        for pattern, letters in secrets.ENCODINGS[:-1]
    )
    value = f"length(regexp_extract_all(t, {_quoted(secrets.ASSIGN)}, 2)[i]) >= {secrets.MIN_VALUE}"
    ordinary = "regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[A-Za-z]')"
    names = "[" + ", ".join(_quoted(kind) for kind in secrets.KINDS) + "]"
    span = f"{names}[kind + 1] || ':' || start || ':' || stop"
    return rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_matches(0, secrets.ASSIGN, value)} UNION ALL {_matches(1, secrets.ACCESS, "true")}
  UNION ALL {_matches(2, secrets.HEX, "true")} UNION ALL {_matches(3, secrets.CANDIDATE, ordinary)}),
tokens AS (SELECT *, CASE {alphabet} ELSE {_quoted(secrets.ENCODINGS[-1][1])} END AS letters
  FROM (SELECT *, regexp_replace(match, '=+$', '') AS body FROM found WHERE kind = 3 AND good)),
places AS (SELECT *, CAST(length(letters) AS DOUBLE) AS k, CAST(length(body) AS DOUBLE) AS n,
  list_filter(list_transform(string_split(body, ''), lambda c: CAST(instr(letters, c) AS DOUBLE)), lambda v: v > 0) AS v
  FROM tokens),
sums AS (SELECT *, 2 / (9 * (k - 1)) AS third,
  (list_sum(list_transform(string_split(letters, ''), lambda c: pow(n - length(replace(body, c, '')), 2))) * k / n - n)
    / (k - 1) AS chi,
  coalesce(list_sum(list_transform(list_zip(v[1 : len(v) - 1], v[2 : len(v)]),
    lambda x: CASE WHEN (x[1] > k / 2) <> (x[2] > k / 2) THEN 1.0::DOUBLE ELSE 0.0 END)), 0) AS changes,
  coalesce(list_sum(list_transform(list_zip(v[1 : len(v) - 1], v[2 : len(v)]),
    lambda x: (x[1] - (k + 1) / 2) * (x[2] - (k + 1) / 2))), 0) AS product
  FROM places),
tested AS (SELECT doc_id, i, CAST(floor(log2(length(match))) AS BIGINT) AS length_class,
  least(1.0, 3 * least({_tail("(pow(greatest(chi, 0.0), 1 / 3.0::DOUBLE) - 1 + third) / sqrt(third)")},
    2 * {_tail("abs(changes - (n - 1) / 2) / sqrt((n - 1) / 4)")},
    2 * {_tail("abs(product) / ((k * k - 1) / 12 * sqrt(n - 1))")})) AS p
  FROM sums),
steps AS (SELECT *, CAST(floor(-log10(greatest(p, 1e-{secrets.LEAST})) * {secrets.STEPS}) AS BIGINT) AS step FROM tested),
limits AS (SELECT length_class, min(step) AS first FROM (
    SELECT length_class, step, sum(count(*)) OVER (PARTITION BY length_class ORDER BY step DESC) AS rank,
      sum(count(*)) OVER (PARTITION BY length_class) AS tests FROM steps GROUP BY length_class, step)
  WHERE pow(10.0, -step / {secrets.STEPS}.0) <= {secrets.LEVEL} * rank / tests GROUP BY length_class),
base AS (SELECT doc_id, stop - length(match) AS start, kind, stop FROM found WHERE kind < 3 AND good),
random AS (SELECT found.doc_id, found.stop - length(found.match) AS start, 3 AS kind, found.stop
  FROM found JOIN steps USING (doc_id, i) LEFT JOIN limits USING (length_class)
  WHERE found.kind = 3 AND found.good AND (first IS NULL OR step < first)),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM random WHERE NOT EXISTS (
  SELECT 1 FROM base WHERE base.doc_id = random.doc_id AND base.start <= random.start AND base.stop >= random.stop))
SELECT docs.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access,
  count(*) FILTER (WHERE kind = 2) AS n_hex,
  sha256(coalesce(string_agg({span}, ',' ORDER BY start, kind) FILTER (WHERE kind < 3), '')) AS base_sha256,
  coalesce(string_agg({span}, ',' ORDER BY start, kind), '') AS spans
FROM docs LEFT JOIN spans ON spans.doc_id = docs.doc_id GROUP BY docs.doc_id
"""


OP5 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

# btrim with the six white-space characters, which the driver of the SQL gets as they are.
OP6 = """
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
keys AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1),
judged AS (SELECT lines.*, first IS NOT NULL AND first <> doc_id AS dropped
  FROM lines LEFT JOIN keys ON lines.key = keys.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

OP7 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p
  FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS turn FROM windows)
  WHERE turn > 1),
each AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM words),
kept AS (
  SELECT each.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY each.p) AS t
  FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.p = each.p
  WHERE gone.p IS NULL GROUP BY each.doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept ON kept.doc_id = words.doc_id
"""

# The water level L at which the targets least(weight * L, 2 * size) add up to 150% of all sizes.
OP8 = rf"""
WITH docs AS (
  SELECT doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (
  SELECT source, sum(size) AS s,
    [3, 1, 2][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1] AS w
  FROM docs GROUP BY source),
steps AS (
  SELECT *, 1.5::DOUBLE * sum(s) OVER () -
      coalesce(sum(2 * s) OVER (ORDER BY 2 * s / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
      AS rest,
    sum(w) OVER (ORDER BY 2 * s / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM sources),
level AS (SELECT rest, open_w FROM steps WHERE rest * w / open_w <= 2 * s
  ORDER BY 2 * s / w, source LIMIT 1),
plan AS (
  SELECT source, s, least(CAST(2 * s AS DOUBLE), coalesce(rest * w / open_w, 0)) AS target,
    CAST(floor(least(CAST(2 * s AS DOUBLE), coalesce(rest * w / open_w, 0)) + 0.5) AS BIGINT) AS take
  FROM sources LEFT JOIN level ON true),
blocks AS (
  SELECT doc_id, docs.source, size, i, least({mixing.BLOCK_WORDS}, size - i * {mixing.BLOCK_WORDS}) AS words,
    take - (take // s) * s AS rest,
    md5(concat('{mixing.SEED}:', coalesce(CAST(doc_id AS VARCHAR), '-'), ':', i, ':', take // s)) AS turn
  FROM docs JOIN plan ON docs.source IS NOT DISTINCT FROM plan.source,
    unnest(range(0, CAST(ceil(size / {mixing.BLOCK_WORDS}) AS BIGINT))) AS b(i)
  WHERE s > 0),
partial AS (
  SELECT doc_id, sum(greatest(0, least(words, rest - before))) AS n
  FROM (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY turn, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words AS before FROM blocks)
  GROUP BY doc_id)
SELECT docs.doc_id, CAST(size AS BIGINT) AS size, CAST(s AS BIGINT) AS source_size, target,
  CAST(CASE WHEN s > 0 THEN size * (take // s) ELSE 0 END + coalesce(n, 0) AS BIGINT) AS taken
FROM docs JOIN plan ON docs.source IS NOT DISTINCT FROM plan.source
LEFT JOIN partial ON partial.doc_id = docs.doc_id
"""


def _guarded(text: str) -> str:
    """What escaping makes of a text; no two control strings overlap."""
    out = f"replace({text}, '\\', '\\\\')"
    for control in chat.CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}\\-{control[1:]}')"
    return out


OP12 = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (
  SELECT *, length({_guarded("text")}) + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13
    WHEN 'assistant' THEN 4 ELSE 19 + length({_guarded("role")}) END AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text))
    AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
    AS loss_sha256,
  CAST(3 + sum(chars) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

OP13 = """
WITH v AS (
  SELECT vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
    CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id IS DISTINCT FROM b.vec_id),
positives AS (
  SELECT anchor_id, id, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id NULLS LAST) <= 5),
found AS (
  SELECT p.anchor_id, p.id AS positive_id,
    row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id NULLS LAST) AS rank,
    n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives AS p JOIN scored AS n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM found WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_benchmark_decontamination": OP3,
        "op4_secret_scan": _secret_scan(),
        "op5_exact_dedup": OP5,
        "op6_line_dedup": OP6,
        "op7_substring_dedup": OP7,
        "op8_mixing": OP8,
        "op12_chat_formatting": OP12,
        "op13_hard_negatives": OP13,
    }
