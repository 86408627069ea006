"""DuckDB SQL for the numbered queries that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*(_either(w) for w in ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
#: Name, pattern, group, least length, and a plainer pattern that texts with a span must match.
_KINDS = (
    ("assign", f"""({_NAMES})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8, _NAMES),
    ("access", "AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    ("hex", "[0-9a-f]+", 0, 32, "[0-9a-f]{32}"),
)

_KIND_SQL = "\nUNION ALL\n".join(
    f"""SELECT doc_id, {rank} AS rank, '{name}' AS kind, s.start, s.stop FROM (
  SELECT doc_id, unnest(list_filter(list_transform(range(1, len(m) + 1), lambda i: {{
    'start': list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
    'stop': list_sum(list_transform(g[1:i], lambda x: length(x))) + list_sum(list_transform(m[1:i], lambda x: length(x))),
    'n': length(v[i])}}), lambda x: x.n >= {least})) AS s
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v, string_split_regex(t, '{pattern}') AS g
    FROM texts WHERE regexp_matches(t, '{some}')))"""
    for rank, (name, pattern, group, least, some) in enumerate(_KINDS)
)

SECRETS = f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_KIND_SQL}),
listed AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
    string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, rank) AS spans
  FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(a, 0) AS BIGINT) AS n_assign, CAST(coalesce(k, 0) AS BIGINT) AS n_access, CAST(coalesce(h, 0) AS BIGINT) AS n_hex,
  coalesce(spans, '') AS spans, sha256(coalesce(spans, '')) AS base_sha256
FROM texts d LEFT JOIN listed USING (doc_id)"""

CONTAMINATION = f"""WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS g
  FROM i, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS u(p) WHERE len(w) > 0),
places AS (
  SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS g
  FROM (SELECT DISTINCT k FROM windows) AS s, d, unnest(range(1, greatest(len(w) - k + 2, 1))) AS u(p)),
hits AS (SELECT doc_id, p, k, item_id FROM places JOIN windows USING (k, g)),
words AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

TOP_K = """WITH v AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND c.n <> q.n),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

CHAT = """WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
whole AS (
  SELECT conv_id, list({'turn': turn, 'role': role, 'text': text} ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS t, max(turn) AS stop, count(*) AS n_turns,
    string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn, role NULLS FIRST, text NULLS FIRST) AS text
  FROM turns GROUP BY conv_id),
once AS (SELECT min(conv_id) AS conv_id, t, stop, n_turns, text, count(*) AS n_copies FROM whole GROUP BY ALL),
inner_parts AS (
  SELECT DISTINCT list_filter(w.t, lambda x: x.turn <= p.stop) AS t FROM whole AS w
  JOIN (SELECT DISTINCT conv_id, turn AS stop FROM turns) AS p USING (conv_id) WHERE p.stop < w.stop)
SELECT conv_id, n_turns, n_copies, text FROM once WHERE t NOT IN (SELECT t FROM inner_parts)"""


def _part(i: int, n: int) -> str:
    return f"array_to_string(c.w[{i}:{i + n - 1}], ' ')"


_CUT_SQL = "\nUNION ALL\n".join(
    f"SELECT c.lang, c.p, {cut} AS cut, x.f AS l, y.f AS r FROM c JOIN f AS x ON x.lang = c.lang AND x.p = {_part(1, cut)} JOIN f AS y ON y.lang = c.lang AND y.p = {_part(cut + 1, k - cut)} WHERE c.k = {k}"
    for k in (2, 3, 4)
    for cut in range(1, k)
)
_INSIDE_SQL = "\nUNION ALL\n".join(f"SELECT lang, {_part(i, n)} AS p, a FROM c WHERE k = {k}" for k in (3, 4) for n in range(2, k) for i in range(1, k - n + 2))

PHRASES = f"""WITH pieces AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, k, w[i:i + k - 1] AS w FROM (SELECT unnest(range(1, 5)) AS k) AS s, pieces, unnest(range(1, greatest(len(w) - k + 2, 1))) AS u(i)),
f AS MATERIALIZED (SELECT lang, k, w, array_to_string(w, ' ') AS p, count(*) AS f FROM grams GROUP BY lang, k, w HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, k, w, p, f AS a FROM f WHERE k > 1),
cuts AS ({_CUT_SQL}),
scored AS (
  SELECT lang, p, a, min({{'score': CAST(2000000::HUGEINT * a // (l::HUGEINT + r) AS BIGINT), 'cut': cut, 'l': l, 'r': r}}) AS s FROM cuts JOIN c USING (lang, p) GROUP BY lang, p, a),
inside AS (SELECT lang, p, max(a) AS longer FROM ({_INSIDE_SQL}) GROUP BY lang, p),
ranked AS (
  SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY s.s.score DESC, s.a DESC, encode(s.p)) AS rank, s.p AS phrase, s.a, s.s.l AS l, s.s.r AS r, s.s.score AS score
  FROM scored AS s LEFT JOIN inside AS i USING (lang, p) WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000"""

_NEAREST = "SELECT v.n, v.vec_id, v.v, min({{'d': list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.v[i]) * (v.v[i] - c.v[i]))), 'c': c.c}}) AS m FROM v, c{t} AS c GROUP BY v.n, v.vec_id, v.v"
_ROUND = """a{t} AS MATERIALIZED (""" + _NEAREST + """),
c{u} AS MATERIALIZED (
  SELECT c.c, coalesce(g.v, c.v) AS v FROM c{t} AS c LEFT JOIN (
    SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
      SELECT m.c AS c, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{t}, unnest(range(1, 65)) AS u(i) GROUP BY m.c, i) GROUP BY c) AS g USING (c)),
"""  # fmt: skip

CLUSTERS = (
    """WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM v QUALIFY c < 8),
"""
    + "".join(_ROUND.format(t=t, u=t + 1) for t in range(10))
    + "last AS MATERIALIZED ("
    + _NEAREST.format(t=10)
    + """)
SELECT vec_id, CAST(m.c AS INTEGER) AS cluster, CAST(m.d AS BIGINT) AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c10.v, ',')) AS centroid_sha256
FROM last JOIN c10 ON c10.c = m.c"""
)

_SPACE = "[\\x20\\x09-\\x0D]"
_CHAR_CLASSES = ("[a-z]", _SPACE, "[^\\x00-\\x7F]", """[.,;:!?''"()-]""", "[A-Z]", "[0-9]")
_COUNTS = ", ".join(f"length(t) - length(regexp_replace(t, '{p}', '', 'g')) AS n{k}" for k, p in enumerate((*_CHAR_CLASSES, "[#*$%&|<>]")))


def _js(p: str, q: str) -> str:
    part = "CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END"
    return f"""round(sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda x: {part.format(a="x[1]", b="x[2]")} + {part.format(a="x[2]", b="x[1]")})), 0) / 2), 6)"""


DIVERGENCE = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, coalesce(lang, 'und') AS lang, coalesce(text, '') AS t FROM documents),
counted AS MATERIALIZED (SELECT n, doc_id, lang, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, {_COUNTS} FROM d),
classes AS (SELECT *, [n0, n1, n2, n3, n4, n5, length(t) - n0 - n1 - n2 - n3 - n4 - n5] AS c FROM counted),
runs AS (SELECT n, p, array_to_string(w[p:p + 7], ' ') AS g FROM classes, unnest(range(1, greatest(len(w) - 6, 1))) AS u(p)),
twice AS (SELECT n, g FROM runs GROUP BY n, g HAVING count(*) > 1),
repeated AS (SELECT n, count(*) AS k FROM (SELECT DISTINCT n, unnest(range(p, p + 8)) AS q FROM runs JOIN twice USING (n, g)) GROUP BY n),
lines AS (SELECT n, unnest(string_split(t, chr(10))) AS line FROM d),
doubles AS (SELECT n, count(*) - count(DISTINCT line) AS k FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY n),
lowered AS MATERIALIZED (SELECT n, lang, unnest(regexp_extract_all(lower(t), '[^\\x20\\x09-\\x0D]+')) AS word FROM d),
freq AS (SELECT lang, word, count(*) AS k FROM lowered GROUP BY lang, word),
top AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY k DESC, encode(word)) AS place FROM freq QUALIFY place <= 32),
sizes AS (SELECT lang, sum(k) AS total FROM freq GROUP BY lang),
by_class AS (SELECT lang, [{", ".join(f"sum(c[{k}])" for k in range(1, 8))}] AS s FROM classes GROUP BY lang),
refs AS MATERIALIZED (
  SELECT lang, total, list_transform(s, lambda x: CAST(x AS DOUBLE) / CAST(list_sum(s) AS DOUBLE)) AS cs, list_concat(list_transform(ks, lambda x: CAST(x AS DOUBLE) / CAST(total AS DOUBLE)), [CAST(total - list_sum(ks) AS DOUBLE) / CAST(total AS DOUBLE)]) AS ws, n_top
  FROM (SELECT lang, list(k ORDER BY place) AS ks, count(*) AS n_top FROM top GROUP BY lang) JOIN sizes USING (lang) JOIN by_class USING (lang)),
hits AS (SELECT n, place, count(*) AS k FROM lowered JOIN top USING (lang, word) GROUP BY n, place),
places AS (SELECT n, lang, unnest(range(1, n_top + 1)) AS place FROM d JOIN refs USING (lang)),
hist AS (SELECT p.n, list(coalesce(k, 0) ORDER BY p.place) AS h FROM places AS p LEFT JOIN hits AS x ON x.n = p.n AND x.place = p.place GROUP BY p.n),
stats AS (
  SELECT c.doc_id, len(w) AS nw, length(t) - n1 AS wc, n6, coalesce(doubles.k, 0) AS dl, coalesce(repeated.k, 0) AS rw,
    CASE WHEN total >= 10000 AND length(t) >= 200 THEN {_js("list_transform(c, lambda x: CAST(x AS DOUBLE) / CAST(list_sum(c) AS DOUBLE))", "cs")} END AS class_distance,
    CASE WHEN total >= 10000 AND len(w) >= 50 THEN {_js("list_transform(list_concat(h, [len(w) - list_sum(h)]), lambda x: CAST(x AS DOUBLE) / CAST(len(w) AS DOUBLE))", "ws")} END AS word_distance
  FROM classes AS c LEFT JOIN refs USING (lang) LEFT JOIN hist USING (n) LEFT JOIN doubles USING (n) LEFT JOIN repeated USING (n)),
judged AS (SELECT *, nw < 20 OR 100 * rw > 30 * nw AS base_failed FROM stats)
SELECT doc_id, CAST(nw AS BIGINT) AS n_words, CAST(wc AS BIGINT) AS word_chars, CAST(n6 AS BIGINT) AS n_symbols, CAST(dl AS BIGINT) AS n_dup_lines, CAST(rw AS BIGINT) AS n_repeat_words,
  base_failed, NOT base_failed AND NOT coalesce(class_distance > 0.25, false) AND NOT coalesce(word_distance > 0.42, false) AS kept, class_distance, word_distance
FROM judged"""
