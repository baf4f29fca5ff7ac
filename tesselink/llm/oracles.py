"""DuckDB SQL of those queries of this folder that SQL expresses, built from the operators' fixed values."""

from __future__ import annotations

import math

from . import chat, licenses, mixing, quality, secrets
from .common import WORD
from .wordlists import COMMON

_RULE = {r.kind: r for r in secrets.RULES}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_text, values)) + "]"


def _either_case(pattern: str) -> str:
    """``pattern`` with its one group of ASCII letters in either case spelt out: the engine's own flag folds beyond ASCII."""
    head, rest = pattern.split("(?i:", 1)
    inner, tail = rest.split(")", 1)
    return head + "(?:" + "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in inner) + ")" + tail


def mixing_sql(weights, share: float, cap: float) -> str:
    """Each source as a whole in key order."""
    low, high = mixing.USUAL_MEAN
    return f"""WITH x AS (SELECT row_number() OVER () rid, doc_id, source, length(text) n_chars, len(regexp_extract_all(coalesce(text, ''), {_text(WORD)}))::BIGINT size,
  (('0x' || substr(md5(concat_ws('|', '{mixing.SEED}', doc_id::VARCHAR)), 1, 13))::BIGINT + 0.5::DOUBLE) / {float(1 << 52)}::DOUBLE u FROM documents),
 t AS (SELECT *, -ln(u) / CASE WHEN size >= {mixing.USUAL_WORDS} AND n_chars / size BETWEEN {low} AND {high} THEN 1 ELSE 0.5::DOUBLE END AS place FROM x),
 s AS (SELECT source, sum(size)::BIGINT source_size FROM t GROUP BY source),
 a AS (SELECT *, ({list(map(float, weights))}::DOUBLE[])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)} + 1] weight, {cap}::DOUBLE * source_size most, {share}::DOUBLE * sum(source_size) OVER () budget FROM s),
 b AS (SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS FIRST) i FROM a),
 c AS (SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM b),
 d AS (SELECT source, source_size, least(most, coalesce(weight * (SELECT arg_min(lvl, i) FROM c WHERE most / weight >= lvl), most)) target FROM c),
 e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(round(target) / source_size) ELSE 0 END::BIGINT epochs FROM d)
 SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * source_size
  - (sum(size) OVER (PARTITION BY t.source ORDER BY place, doc_id, size, rid) - size))))::BIGINT taken FROM t JOIN e ON t.source IS NOT DISTINCT FROM e.source"""


def chat_sql(said: str, budget: int, history: int = 2) -> str:
    """What a window repeats follows from the turns before; only where windows end is found turn by turn."""
    assert history == 2
    escaped = lambda c: rf"length({c}) + len(regexp_extract_all({c}, '<\\*\|'))"
    lag = lambda c, n: f"CASE WHEN i > {n} AND NOT (sys AND i = {n + 1}) THEN lag({c}, {n}) OVER w END"
    return rf"""WITH RECURSIVE c AS (SELECT conv_id::BIGINT conv_id, turn::BIGINT turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', {_text(said)}), (-1, 1, 'assistant', {_text(said)})),
 o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) i, len(regexp_extract_all(text, {_text(WORD)})) + {chat.MARKERS} tok,
  {len(chat.START) + 1 + len(chat.END)} + {escaped("replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n')")} + {escaped('text')} len FROM c),
 h AS (SELECT conv_id, role = 'system' sys, CASE WHEN role = 'system' THEN tok ELSE 0 END st, CASE WHEN role = 'system' THEN len ELSE 0 END sl FROM o WHERE i = 1),
 l AS (SELECT o.*, st, sl, {lag('tok', 1)} t1, {lag('len', 1)} l1, {lag('tok', 2)} t2, {lag('len', 2)} l2 FROM o JOIN h ON o.conv_id IS NOT DISTINCT FROM h.conv_id WINDOW w AS (PARTITION BY o.conv_id ORDER BY i)),
 k AS (SELECT conv_id, i, tok, len, CASE WHEN t1 + t2 <= {budget} - tok - st THEN t1 + t2 WHEN t1 <= {budget} - tok - st THEN t1 ELSE 0 END + st kt,
  CASE WHEN t1 + t2 <= {budget} - tok - st THEN l1 + l2 WHEN t1 <= {budget} - tok - st THEN l1 ELSE 0 END + sl kl FROM l),
 r AS (SELECT conv_id, i, tok prefix, len total, 1 n FROM k WHERE i = 1 UNION ALL
  SELECT k.conv_id, k.i, CASE WHEN prefix + tok > {budget} THEN kt ELSE prefix END + tok, total + len + CASE WHEN prefix + tok > {budget} THEN kl ELSE 0 END, n + CASE WHEN prefix + tok > {budget} THEN 1 ELSE 0 END
  FROM r JOIN k ON k.conv_id IS NOT DISTINCT FROM r.conv_id AND k.i = r.i + 1),
 z AS (SELECT conv_id, max(total)::BIGINT formatted_chars, max(n)::BIGINT n_windows FROM r GROUP BY conv_id),
 s AS (SELECT conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) loss_sha256 FROM o GROUP BY conv_id)
 SELECT s.*, formatted_chars, n_windows FROM s JOIN z ON s.conv_id IS NOT DISTINCT FROM z.conv_id"""


def secrets_sql() -> str:
    """Starts are the sums of the gaps and matches before, which splitting at the pattern and extracting it give."""
    rules = [(k, r, _text(_either_case(r.pattern) if "(?i:" in r.pattern else r.pattern)) for k, r in enumerate(secrets.RULES)]
    each = " UNION ALL ".join(
        f"SELECT rid, {k} k, m, g, list_transform(m, lambda x: {f'length(regexp_extract(x, {p}, {r.group})) >= {r.least}' if r.least else 'true'}) ok"
        f" FROM (SELECT rid, regexp_extract_all(text, {p}) m, string_split_regex(text, {p}) g FROM t)" for k, r, p in rules)
    base = ", ".join(str(k) for k, r, _ in rules if r.kind in secrets.BASE)
    told = f"{_list(r.kind for _, r, _ in rules)}[k + 1] || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (k = {k}) n_{r.kind}" for k, r, _ in rules if r.kind in secrets.BASE)
    return f"""WITH t AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') text FROM documents), m AS ({each}),
 x AS (SELECT rid, k, i, length(m[i]) n, length(g[i]) gap, ok[i] ok FROM (SELECT *, unnest(generate_series(1, len(m))) i FROM m)),
 p AS (SELECT rid, k, n, ok, sum(gap + n) OVER (PARTITION BY rid, k ORDER BY i) e FROM x), f AS (SELECT rid, k, e - n s, e FROM p WHERE ok)
 SELECT doc_id, {counts}, sha256(coalesce(string_agg({told}, ',' ORDER BY s, k, e) FILTER (k IN ({base})), '')) base_sha256,
 coalesce(string_agg({told}, ',' ORDER BY s, k, e), '') spans FROM t LEFT JOIN f USING (rid) GROUP BY rid, doc_id"""


def licenses_sql() -> str:
    """Every block against every template, without a filter."""
    phrases = ", ".join(f"({_list(p.split())}, {_text(label)})" for p, label in licenses.PHRASES)
    own = [(label, sorted(x.decode() for x in set(licenses.words_of(text)))) for label, text in licenses.TEMPLATES]
    templates = ", ".join(f"({_text(label)}, {_list(w)}, {math.ceil(licenses.THRESHOLD * len(w) - 1e-9)})" for label, w in own)
    half = licenses.BLOCK // 2
    return rf"""WITH w AS (SELECT row_number() OVER () rid, doc_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
 ph AS (SELECT * FROM (VALUES {phrases}) v(p, label)), tm AS (SELECT * FROM (VALUES {templates}) v(label, own, need)),
 places AS (SELECT rid, label, unnest(list_filter(range(0, len(w)), lambda i: w[i + 1:i + len(p)] = p)) place FROM w, ph),
 b AS (SELECT rid, count(*) n, min(place) a, max(place) z FROM places GROUP BY rid),
 blocks AS (SELECT rid, w[lo + 1:lo + {licenses.BLOCK}] block FROM (SELECT rid, w, unnest(range(0, greatest(1, len(w) - {half}), {half})) lo FROM w)),
 hits AS (SELECT rid, label, len(list_intersect(own, block)) / len(own) share FROM blocks, tm WHERE len(list_intersect(own, block)) >= need),
 h AS (SELECT rid, max(share) share FROM hits GROUP BY rid),
 l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) base_labels, string_agg(DISTINCT label, ',' ORDER BY label) labels
  FROM (SELECT rid, label, true base FROM places UNION ALL SELECT rid, label, false FROM hits) GROUP BY rid)
 SELECT doc_id, len(w) n_words, coalesce(n, 0) n_base, a first_word, z last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END score FROM w LEFT JOIN b USING (rid) LEFT JOIN h USING (rid) LEFT JOIN l USING (rid)"""


def quality_sql(digits: int) -> str:
    """The windows and both histograms in long tables; distances are rounded to ``digits`` places."""
    q = quality
    common = ", ".join(f"({_text(lang)}, {i}, {_text(w)})" for lang, ws in COMMON.items() for i, w in enumerate(ws))
    classes = ", ".join(f"({i}, {_text(p)})" for i, (_, p) in enumerate(q.CLASSES))
    distance = lambda c: f"""SELECT rid, sqrt(greatest(0, least(1, sum(CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END) / 2))) d
  FROM (SELECT rid, n / sum(n) OVER (PARTITION BY rid) x, total / sum(total) OVER (PARTITION BY rid) y, sum(n) OVER (PARTITION BY rid) tx
   FROM (SELECT *, sum(n) OVER (PARTITION BY lang, i) total FROM {c})) WHERE tx > 0 GROUP BY rid"""  # noqa: E731
    return rf"""WITH t AS (SELECT row_number() OVER () rid, doc_id, lang, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), {_text(WORD)}) w FROM documents),
 win AS (SELECT rid, i, array_to_string(w[i:i + {q.WINDOW - 1}], ' ') s FROM (SELECT rid, w, unnest(range(1, len(w) - {q.WINDOW - 2})) i FROM t)),
 twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, s) n FROM win) WHERE n > 1),
 rep AS (SELECT rid, count(DISTINCT i + j) n FROM twice, range(0, {q.WINDOW}) r(j) GROUP BY rid),
 cl AS (SELECT * FROM (VALUES {classes}) v(i, p)), named AS (SELECT rid, lang, i, length(text) - length(regexp_replace(text, p, '', 'g')) n FROM t, cl),
 chars AS (SELECT * FROM named UNION ALL SELECT t.rid, t.lang, {len(q.CLASSES)}, length(text) - (SELECT sum(n) FROM named WHERE named.rid = t.rid) FROM t),
 co AS (SELECT * FROM (VALUES {common}) v(lang, i, word)), said AS (SELECT rid, lower(x) word, count(*) n FROM (SELECT rid, unnest(w) x FROM t) GROUP BY ALL),
 wordy AS (SELECT t.rid, t.lang, co.i, coalesce(said.n, 0) n FROM t JOIN co ON co.lang = t.lang LEFT JOIN said ON said.rid = t.rid AND said.word = co.word),
 dc AS ({distance('chars')}), dw AS ({distance('wordy')}),
 x AS (SELECT doc_id, len(w) n_words, length(array_to_string(w, '')) word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) n_symbols,
  len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) n_dup_lines,
  coalesce(rep.n, 0) n_repeat_words, CASE WHEN length(text) >= {q.MIN_CHARS} THEN dc.d END c, CASE WHEN len(w) >= {q.MIN_WORDS} THEN dw.d END d
  FROM t LEFT JOIN rep USING (rid) LEFT JOIN dc USING (rid) LEFT JOIN dw USING (rid)),
 y AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words base_failed FROM x)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(c, {digits}) char_distance, round(d, {digits}) word_distance,
  NOT base_failed AND coalesce(c, 0) <= {q.MAX_CHAR_DISTANCE} AND coalesce(d, 0) <= {q.MAX_WORD_DISTANCE} kept FROM y"""
