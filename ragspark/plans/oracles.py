"""The registered queries restated in SQL over the same tables."""

from __future__ import annotations

import re
from collections.abc import Iterable

from ragspark.operators import rules
from ragspark.plans import queries as q

W = r"[\p{L}\p{N}_]"
SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
_THAI = re.compile("[฀-๿]")


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{W}+')"


def keyword_set(x: str) -> str:
    return f"list_distinct(list_filter({tokens(x)}, lambda w: length(w) >= 2))"


def jaccard(a: str, b: str) -> str:
    """Similarity of two columns that hold keyword sets."""
    both = f"len(list_intersect({a}, {b}))"
    return (
        f"(CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE "
        f"WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE "
        f"ELSE {both}::DOUBLE / (len({a}) + len({b}) - {both}) END)"
    )


def similarity(a: str, b: str) -> str:
    """Text similarity over columns ``a, b`` with keyword sets ``a_kw, b_kw``."""
    return (
        f"(CASE WHEN {a} IS NULL OR {b} IS NULL OR {a} = '' OR {b} = '' THEN 0.0::DOUBLE "
        f"ELSE {jaccard(a + '_kw', b + '_kw')} END)"
    )


def tail(number: str, tails: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN {lit(t)}" for i, t in enumerate(tails))
    return f"CASE ({number}) % {len(tails)} {cases} END"


RAW_PAIRS = """raw_pairs AS (
  SELECT conv_id, turn, text AS question, answer, context FROM (
    SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer, lag(text) OVER w AS context
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""

PAIRS = f"""{RAW_PAIRS}, pairs AS (
  SELECT conv_id, turn, question || {tail('conv_id + turn', q.QUESTION_TAILS)} AS question,
    answer || {tail('conv_id + turn', q.ANSWER_TAILS)} AS answer, context FROM raw_pairs)"""

LANGUAGE = r"""(CASE WHEN length(regexp_replace(text, '[^\p{L}]', '', 'g')) > 0
  AND length(regexp_replace(text, '[^\x{0E00}-\x{0E7F}]', '', 'g'))::DOUBLE
    / length(regexp_replace(text, '[^\p{L}]', '', 'g')) > 0.3 THEN 'th' ELSE 'en' END)"""

WORDS = rf"regexp_extract_all(text, '[^{SPACE}]+')"
SENTENCES = (
    r"list_filter(list_transform(string_split_regex(text, '[.!?]+'), "
    rf"lambda s: regexp_replace(s, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')), lambda s: s <> '')"
)
COUNTED = (
    rf"list_filter(list_transform(regexp_extract_all(lower(text), '[^{SPACE}]+'), "
    rf"lambda w: regexp_replace(w, '[^\p{{L}}\p{{N}}_]', '', 'g')), lambda w: length(w) > 2)"
)
# round half to even at two digits, from the unrounded mean
HALF_EVEN = "round_even({0}, 2)"

STATS = rf"""stats AS (SELECT *,
  len({WORDS}) AS word_count, length(text) AS character_count,
  length(replace(text, ' ', '')) AS character_count_no_spaces,
  len(regexp_extract_all(text, '[.!?]+')) AS sentence_count,
  CASE WHEN len({WORDS}) > 0 THEN
    list_sum(list_transform({WORDS}, lambda w: length(trim(w, '.,!?;:'))))::DOUBLE / len({WORDS})
  ELSE 0 END AS word_length FROM documents)"""

LEVEL = """CASE WHEN character_count = 0 THEN 'unknown'
  WHEN round_even(word_length, 2) < 4 AND sentence_length < 15 THEN 'easy'
  WHEN round_even(word_length, 2) < 6 AND sentence_length < 20 THEN 'medium' ELSE 'difficult' END"""

SCRIPT = r"""regexp_matches(text, '[\x{0E00}-\x{0E7F}]') AS contains_thai,
  regexp_matches(text, '[a-zA-Z]') AS contains_english"""
SCRIPT_NAME = """CASE WHEN contains_thai AND contains_english THEN 'mixed' WHEN contains_thai THEN 'thai'
  WHEN contains_english THEN 'english' ELSE 'unknown' END"""

TOP_WORDS = f"""placed AS (SELECT doc_id, unnest({COUNTED}) AS word, generate_subscripts({COUNTED}, 1) AS p
    FROM documents),
  counted AS (SELECT doc_id, word, count(*) AS n, min(p) AS p FROM placed GROUP BY doc_id, word),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS place FROM counted)"""


def bounded(pattern: str) -> str:
    """A rule pattern for an engine whose word boundary is ASCII."""
    out = pattern
    if out.startswith(r"\b"):
        out = rf"(?:^|[^\p{{L}}\p{{N}}_]){out[2:]}"
    if out.endswith(r"\b"):
        out = rf"{out[:-2]}(?:$|[^\p{{L}}\p{{N}}_])"
    return f"(?i-s){out}"


def found(x: str, patterns: list[str], multiline: bool = False) -> str:
    """List of the patterns found in ``x``."""
    cases = ", ".join(
        f"CASE WHEN regexp_matches(lower({x}), {lit(bounded(p).replace('(?i-s)', '(?im-s)') if multiline else bounded(p))})"
        f" THEN {lit(p)} END"
        for p in patterns
    )
    return f"list_filter([{cases}], lambda p: p IS NOT NULL)"


def holds(x: str, words: list[str]) -> str:
    """``x`` holds all words; ``x_tok`` are its tokens."""
    return "(" + " AND ".join(
        f"contains(lower({x}), {lit(w)})" if _THAI.search(w) else f"list_contains({x}_tok, {lit(w)})"
        for w in words
    ) + ")"


def phrase(x: str, text: str) -> str:
    if _THAI.search(text):
        return f"contains(lower({x}), {lit(text)})"
    return holds(x, re.findall(r"\w+", text))


# severities of the toxicity patterns, in their order
LEVELS = [1.0, 0.5, 1.0, 0.6, 0.5, 1.0, 0.6, 0.5]


def words_of(pattern: str) -> list[str]:
    """Words of a pattern that is one bounded group; the letter of the boundary counts as one."""
    inside = pattern.removeprefix(r"\b(").removesuffix(r")\b")
    return ["b", *inside.replace("|", " ").replace(".", " ").split()]


def toxic_levels(x: str, match: str) -> str:
    cases = []
    for i, p in enumerate(rules.TOXICITY):
        hit = (
            holds(x, words_of(p))
            if match == "all"
            else f"regexp_matches(lower({x}), {lit(bounded(p))})"
        )
        cases.append(f"CASE WHEN {hit} THEN {LEVELS[i]}::DOUBLE END")
    return f"list_max([{', '.join(cases)}])"


TOXIC_RESULT = "CASE WHEN lv >= 0.7 THEN 'fail' WHEN lv IS NOT NULL THEN 'warning' ELSE 'pass' END"
TOXIC_MESSAGE = """CASE WHEN lv >= 0.7 THEN 'Toxic content detected'
  WHEN lv IS NOT NULL THEN 'Potentially inappropriate content detected' ELSE 'No toxic content detected' END"""


def toxicity(source: str, keys: str, x: str, match: str) -> str:
    return f"""SELECT {keys}, {TOXIC_RESULT} AS result, {TOXIC_MESSAGE} AS message,
      coalesce(lv, 0.9::DOUBLE) AS confidence
      FROM (SELECT *, {toxic_levels(x, match)} AS lv FROM (SELECT *, {tokens(x)} AS {x}_tok FROM {source}))"""


def hate_parts(x: str) -> str:
    terms = ", ".join(f"CASE WHEN contains(lower({x}), {lit(t)}) THEN {lit(t)} END" for t in rules.PROTECTED)
    return (
        f"{found(x, rules.HATE)} AS hp, "
        f"list_filter([{terms}], lambda t: t IS NOT NULL) AS ht"
    )


HATE_SCORE = """least(least(len(hp) * 0.3::DOUBLE, 1.0::DOUBLE)
  + least(len(ht) * 0.2::DOUBLE, 0.5::DOUBLE), 1.0::DOUBLE)"""
HATE_HIT = "(len(hp) > 0 OR len(ht) > 0)"
HATE_RESULT = f"CASE WHEN {HATE_HIT} AND {HATE_SCORE} >= 0.8::DOUBLE THEN 'fail' WHEN {HATE_HIT} THEN 'warning' ELSE 'pass' END"


def pii_pattern(kind: str) -> str:
    # an ASCII word boundary never holds next to a Thai letter
    body = rules.PII[kind]
    return "(?i)" + (body.removeprefix(r"\b").removesuffix(r"\b") if kind == "thai_name" else body)


def pii_source(kind: str, x: str) -> str:
    """Text to search: for names, other letters and numbers become a digit, so that an ASCII boundary will do."""
    if kind != "potential_name":
        return x
    return rf"regexp_replace(regexp_replace({x}, '[^\P{{L}}\x00-\x7F]', '0', 'g'), '[^\P{{N}}\x00-\x7F]', '0', 'g')"


def pii_any(x: str, kinds: Iterable[str] = rules.PII) -> str:
    return "(" + " OR ".join(f"regexp_matches({pii_source(k, x)}, {lit(pii_pattern(k))})" for k in kinds) + ")"


PII_KINDS = ", ".join(
    f"""{k} AS (SELECT doc_id, '{k}' AS type, {i} AS rank, {rules.PII_CONFIDENCE[k]}::DOUBLE AS base,
      regexp_extract_all({pii_source(k, 'text')}, {lit(pii_pattern(k))}) AS m,
      string_split_regex({pii_source(k, 'text')}, {lit(pii_pattern(k))}) AS g FROM documents)"""
    for i, k in enumerate(rules.PII)
)
PII_PLACED = f"""{PII_KINDS}, every AS ({" UNION ALL ".join(f"SELECT * FROM {k}" for k in rules.PII)}),
  spots AS (SELECT doc_id, type, rank, base, m, g, unnest(generate_series(1, len(m))) AS i FROM every WHERE len(m) > 0),
  placed AS (SELECT doc_id, type, rank, m[i] AS value,
    CASE WHEN type LIKE '%name' AND (length(m[i]) < 5 OR length(m[i]) > 50) THEN base * 0.5 ELSE base END AS confidence,
    (list_sum(list_transform(g[1:i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s FROM spots),
  spans AS (SELECT *, s + length(value) AS e FROM placed)"""

_USER, _DIGITS = "split_part(value, '@', 1)", "length(regexp_replace(value, '[^0-9]', '', 'g'))"


def _but_last_four(first: int) -> str:
    """Digits of ``value`` starred, but for the last four and those before number ``first``."""
    place = "length(regexp_replace(substr(value, 1, i), '[^0-9]', '', 'g'))"
    return f"""array_to_string(list_transform(generate_series(1, length(value)), lambda i:
      CASE WHEN regexp_matches(substr(value, i, 1), '[0-9]') AND {place} >= {first} AND {place} <= {_DIGITS} - 4
      THEN '*' ELSE substr(value, i, 1) END), '')"""


PII_MASK = f"""CASE WHEN type = 'email' AND length(value) - length(replace(value, '@', '')) = 1 THEN
    CASE WHEN length({_USER}) > 2 THEN substr({_USER}, 1, 1) || repeat('*', length({_USER}) - 2) || right({_USER}, 1)
      ELSE repeat('*', length({_USER})) END || '@' || split_part(value, '@', 2)
  WHEN type LIKE 'phone%' AND length(value) > 4 THEN substr(value, 1, 2) || repeat('*', length(value) - 4) || right(value, 2)
  WHEN type = 'credit_card' AND {_DIGITS} > 4 THEN {_but_last_four(1)}
  WHEN type = 'thai_id' AND {_DIGITS} >= 13 THEN {_but_last_four(2)}
  ELSE regexp_replace(value, '[^ ]', '*', 'g') END"""


def pii_masked(source: str, text: str = "documents") -> str:
    """``doc_id, masked_text`` with the spans of ``source`` starred; the first span on a character masks it."""
    return f"""reached AS (SELECT *, coalesce(max(e) OVER (PARTITION BY doc_id ORDER BY s, rank DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM {source}),
      kept AS (SELECT *, greatest(s, reach) AS a, {PII_MASK} AS star FROM reached WHERE e > greatest(s, reach)),
      linked AS (SELECT *, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS after FROM kept),
      built AS (SELECT doc_id, min(a) AS head, string_agg(substr(star, a - s + 1, e - a)
          || substr(text, e + 1, coalesce(after, length(text)) - e), '' ORDER BY a) AS body
        FROM linked JOIN {text} USING (doc_id) GROUP BY doc_id),
      masked AS (SELECT doc_id, CASE WHEN body IS NULL THEN text ELSE substr(text, 1, head) || body END AS masked_text
        FROM {text} LEFT JOIN built USING (doc_id))"""


def declined(x: str) -> str:
    cases = " ".join(f"WHEN {phrase(x, p)} THEN {lit(p)}" for p in rules.DECLINING)
    return f"CASE {cases} END"


def issues(x: str) -> str:
    parts = [f"({phrase(x, p)})::INT" for p in rules.UNCERTAIN + rules.INVENTED]
    return " + ".join(parts)


PREPARED = f"""{PAIRS}, prepared AS (
  SELECT *, {tokens('answer')} AS answer_tok, {tokens('question')} AS question_tok,
    {keyword_set('question')} AS question_kw, {keyword_set('answer')} AS answer_kw,
    {keyword_set('context')} AS context_kw FROM pairs)"""

LOW_COVERAGE = f"(coalesce(context, '') <> '' AND {similarity('answer', 'context')} < 0.3)"


def length_result(x: str, low: int, high: int) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} = '' OR length({x}) < {low} OR length({x}) > {high} THEN 'fail' ELSE 'pass' END"


def length_message(x: str, word: str, low: int, high: int) -> str:
    return f"""CASE WHEN {x} IS NULL OR {x} = '' THEN '{word} is empty'
      WHEN length({x}) < {low} THEN '{word} too short (minimum: {low} characters)'
      WHEN length({x}) > {high} THEN '{word} too long (maximum: {high} characters)'
      ELSE '{word} length valid (' || length({x}) || ' characters)' END"""


INPUT_CHECKS = f"""parts AS (
  SELECT *, {toxic_levels('question', 'all')} AS lv, {hate_parts('question')} FROM prepared),
runs AS (SELECT conv_id, turn, [
  CASE WHEN len({found('question', rules.INJECTION, True)}) > 0 THEN 'fail' ELSE 'pass' END,
  {length_result('question', 1, 1000)},
  CASE WHEN len({found('question', rules.PROFANITY)}) > 0 THEN 'warning' ELSE 'pass' END,
  {TOXIC_RESULT}, {HATE_RESULT},
  CASE WHEN {pii_any('question')} THEN 'warning' ELSE 'pass' END] AS every FROM parts),
cut AS (SELECT *, CASE WHEN list_contains(every, 'fail') THEN every[1:list_position(every, 'fail')] ELSE every END AS kept FROM runs)"""

INPUT_RUN = f"{PREPARED}, {INPUT_CHECKS}"
TURN_RUN = f"""prepared AS (SELECT conv_id, turn, text AS question, {tokens('text')} AS question_tok FROM conversations),
{INPUT_CHECKS}"""

OUTPUT_RUN = f"""{PREPARED}, parts AS (
  SELECT *, {toxic_levels('answer', 'all')} AS lv, {hate_parts('answer')}, {declined('answer')} AS declined,
    {similarity('question', 'answer')} AS score,
    {issues('answer')} + {LOW_COVERAGE}::INT AS notes FROM prepared),
runs AS (SELECT conv_id, turn, [
  {length_result('answer', 5, 2000)},
  CASE WHEN declined IS NOT NULL THEN 'fail' WHEN score < 0.6 THEN 'warning' ELSE 'pass' END,
  CASE WHEN notes > 0 THEN 'warning' ELSE 'pass' END,
  {TOXIC_RESULT}, {HATE_RESULT},
  CASE WHEN {pii_any('answer')} THEN 'warning' ELSE 'pass' END] AS every FROM parts),
cut AS (SELECT *, CASE WHEN list_contains(every, 'fail') THEN every[1:list_position(every, 'fail')] ELSE every END AS kept FROM runs)"""

DOCUMENT_RUN = f"""parts AS (SELECT *, {toxic_levels('text', 'all')} AS lv, {hate_parts('text')}
  FROM (SELECT *, {tokens('text')} AS text_tok FROM documents)),
runs AS (SELECT doc_id, [
  CASE WHEN len({found('text', rules.INJECTION, True)}) > 0 THEN 'fail' ELSE 'pass' END,
  {length_result('text', 1, 1000)},
  CASE WHEN len({found('text', rules.PROFANITY)}) > 0 THEN 'warning' ELSE 'pass' END,
  {TOXIC_RESULT}, {HATE_RESULT},
  CASE WHEN {pii_any('text')} THEN 'warning' ELSE 'pass' END] AS every FROM parts),
cut AS (SELECT *, CASE WHEN list_contains(every, 'fail') THEN every[1:list_position(every, 'fail')] ELSE every END AS kept FROM runs)"""

WARNINGS = "len(list_filter(kept, lambda r: r = 'warning'))"

CHECK_NAMES = [
    "PromptInjectionValidator", "InputLengthValidator", "ProfanityValidator", "ToxicityValidator",
    "HateSpeechValidator", "PIIDetector",
]

# vectors

BUCKET = "('0x' || substr(md5(w), 1, 8))::BIGINT % 64"


def buckets(name: str, keys: str, text: str, source: str) -> str:
    """CTEs ``name`` (key, bucket, count) and ``name_n`` (key, squared norm) of embedded texts."""
    return f"""{name} AS (SELECT {keys}, {BUCKET} AS b, count(*) AS c
      FROM (SELECT {keys}, unnest({tokens(text)}) AS w FROM {source}) GROUP BY ALL),
    {name}_n AS (SELECT {keys}, sum(c * c)::DOUBLE AS n FROM {name} GROUP BY ALL)"""


DOCUMENT_PAIRS = f"""{buckets('dv', 'doc_id', 'text', 'documents')}, {buckets('bv', 'item_id', 'text', 'benchmark')},
dots AS (SELECT item_id, doc_id, sum(dv.c * bv.c)::DOUBLE AS d FROM dv JOIN bv USING (b) GROUP BY ALL),
near AS (SELECT i.item_id, x.doc_id, coalesce(d, 0) AS d, coalesce(dn.n, 0) AS nd, coalesce(bn.n, 0) AS nb
  FROM benchmark i CROSS JOIN documents x LEFT JOIN dots USING (item_id, doc_id)
  LEFT JOIN dv_n dn ON dn.doc_id = x.doc_id LEFT JOIN bv_n bn ON bn.item_id = i.item_id),
sim AS (SELECT *, CASE WHEN nd > 0 AND nb > 0 THEN d / (sqrt(nb) * sqrt(nd)) ELSE 0 END AS cosine FROM near)"""


def document_hits(k: int) -> str:
    return f"""{DOCUMENT_PAIRS}, hits AS (SELECT * FROM (SELECT item_id AS question_id, doc_id AS vec_id,
      round(1 - round(1.0::DOUBLE - cosine, 12), 6) AS score,
      row_number() OVER (PARTITION BY item_id ORDER BY round(1.0::DOUBLE - cosine, 12), doc_id) AS rank FROM sim)
      WHERE rank <= {k})"""


CENTRES = """e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
centres AS (SELECT label AS question_id, list(m ORDER BY i) AS qv FROM (
  SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e)
  GROUP BY label, i) GROUP BY label)"""
# the twelve digits that decide
SIGNIFICANT = "CASE WHEN c = 0 THEN 0 ELSE round(c, 11 - floor(log10(abs(c)))::INT) END"


COSTS = {
    "l2": "list_sum(list_transform(list_zip(qv, v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))",
    "dot": "-list_inner_product(qv, v)",
    "cosine": "1 - list_inner_product(qv, v) / (sqrt(list_inner_product(qv, qv)) * sqrt(list_inner_product(v, v)))",
}
SCORES = {"l2": "sqrt(cost)", "dot": "-cost", "cosine": "1 - cost"}


ASKED = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
  centres AS (SELECT vec_id AS question_id, v AS qv FROM e WHERE vec_id % 20 = 0)"""


def nearest(k: int, metric: str, asked: str = CENTRES) -> str:
    return f"""{asked}, costs AS (SELECT question_id, vec_id, label, {'round(c, 12)' if metric == 'cosine' else SIGNIFICANT} AS cost
      FROM (SELECT question_id, vec_id, label, {COSTS[metric]} AS c FROM centres CROSS JOIN e)),
    hits AS (SELECT * FROM (SELECT question_id, vec_id, label, round({SCORES[metric]}, 6) AS score,
      row_number() OVER (PARTITION BY question_id ORDER BY cost, vec_id) AS rank FROM costs) WHERE rank <= {k})"""


def cosine(a: str, b: str) -> str:
    return f"(list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))))"


def diverse(k: int) -> str:
    """CTEs that pick ``k`` of the hits one after the other by marginal relevance."""
    steps = [f"""cand AS (SELECT h.question_id, h.vec_id, h.rank AS near, e.v, {cosine('c.qv', 'e.v')} AS w
      FROM hits h JOIN e ON e.vec_id = h.vec_id JOIN centres c ON c.question_id = h.question_id)"""]
    for n in range(1, k + 1):
        taken = [f"s{i}" for i in range(1, n)]
        gain = "w"
        if taken:
            gain = f"0.5 * w - 0.5 * greatest({', '.join(cosine('cand.v', t + '.v') for t in taken)})"
        joins = " ".join(f"JOIN s{i} ON s{i}.question_id = cand.question_id AND s{i}.vec_id <> cand.vec_id" for i in range(1, n))
        steps.append(f"""s{n} AS (SELECT question_id, vec_id, v FROM (SELECT cand.question_id, cand.vec_id, cand.v,
          row_number() OVER (PARTITION BY cand.question_id ORDER BY {gain} DESC, near) AS pick FROM cand {joins}) WHERE pick = 1)""")
    union = " UNION ALL ".join(f"SELECT question_id, vec_id, {n} AS rank FROM s{n}" for n in range(1, k + 1))
    return ", ".join(steps) + f", picked AS ({union})"


HIT_COLUMNS = "SELECT question_id, vec_id, score, rank FROM hits"

CONTEXT = f"""{document_hits(4)}, joined AS (
  SELECT question_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context,
    string_agg(text, chr(10) ORDER BY rank) AS lines
  FROM hits JOIN documents ON vec_id = doc_id GROUP BY question_id)"""

EVAL = f"""{DOCUMENT_PAIRS}, ranked AS (SELECT *,
  row_number() OVER (PARTITION BY item_id ORDER BY round(nd + nb - 2 * d, 9), doc_id) AS rank FROM sim),
per AS (SELECT item_id AS question_id, count(*) AS n, count(*) FILTER (cosine > 0.7) AS good,
  avg(greatest(cosine, 0)) AS mean FROM ranked WHERE rank <= 5 GROUP BY item_id),
scores AS (SELECT question_id, good / n AS precision, least(good / 1, 1.0::DOUBLE) AS recall,
  mean AS avg_relevance, n AS retrieved_count FROM per),
scored AS (SELECT *, CASE WHEN precision + recall > 0
  THEN 2.0 * precision * recall / (precision + recall) ELSE 0 END AS f1_score FROM scores)"""

# chunks

SENTENCE_CHUNKS = rf"""parts AS (SELECT doc_id,
    string_split(regexp_replace(text, '([.?!])[{SPACE}]+', '\1' || chr(1), 'g'), chr(1)) AS s
  FROM documents WHERE length(text) > 0),
windows AS (SELECT doc_id, i, array_to_string(s[greatest(i - 1, 1):i + 1], ' ') AS t
  FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i FROM parts)),
{buckets('wv', 'doc_id, i', 't', 'windows')},
dots AS (SELECT a.doc_id, a.i, sum(a.c * z.c)::DOUBLE AS d FROM wv a JOIN wv z
  ON a.doc_id = z.doc_id AND z.i = a.i + 1 AND a.b = z.b GROUP BY ALL),
gaps AS (SELECT w.doc_id, w.i, 1.0::DOUBLE - CASE WHEN x.n > 0 AND y.n > 0
    THEN coalesce(d, 0) / (sqrt(x.n) * sqrt(y.n)) ELSE 0 END AS dist
  FROM windows w JOIN windows v ON v.doc_id = w.doc_id AND v.i = w.i + 1
  LEFT JOIN dots ON dots.doc_id = w.doc_id AND dots.i = w.i
  LEFT JOIN wv_n x ON x.doc_id = w.doc_id AND x.i = w.i
  LEFT JOIN wv_n y ON y.doc_id = w.doc_id AND y.i = w.i + 1),
slopes AS (SELECT doc_id, i, CASE WHEN count(*) OVER p < 2 THEN NULL
    WHEN l IS NULL THEN (r - dist) / 1.0 WHEN r IS NULL THEN (dist - l) / 1.0 ELSE (r - l) / 2.0 END AS slope
  FROM (SELECT *, lag(dist) OVER o AS l, lead(dist) OVER o AS r FROM gaps
    WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WINDOW p AS (PARTITION BY doc_id))"""

BREAK_RULES = {
    "percentile": ("gaps", "dist", "quantile_cont(dist, 0.95) OVER p"),
    "deviation": ("gaps", "dist", "avg(dist) OVER p + stddev_pop(dist) OVER p * 3"),
    "interquartile": (
        "gaps", "dist",
        "avg(dist) OVER p + (quantile_cont(dist, 0.75) OVER p - quantile_cont(dist, 0.25) OVER p) * 1.5",
    ),
    "gradient": ("(SELECT * FROM slopes WHERE slope IS NOT NULL)", "slope", "quantile_cont(slope, 0.95) OVER p"),
}


def semantic(kind: str) -> str:
    source, value, limit = BREAK_RULES[kind]
    return f"""WITH {SENTENCE_CHUNKS},
    cuts AS (SELECT doc_id, i FROM (SELECT doc_id, i, {value} > {limit} AS brk FROM {source}
      WINDOW p AS (PARTITION BY doc_id)) WHERE brk),
    flat AS (SELECT doc_id, unnest(s) AS t, generate_subscripts(s, 1) AS i FROM parts),
    numbered AS (SELECT f.doc_id, f.i, f.t, coalesce(sum(CASE WHEN c.i IS NOT NULL THEN 1 ELSE 0 END) OVER (
      PARTITION BY f.doc_id ORDER BY f.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk_no
      FROM flat f LEFT JOIN cuts c ON c.doc_id = f.doc_id AND c.i = f.i),
    chunks AS (SELECT doc_id, chunk_no, string_agg(t, ' ' ORDER BY i) AS text FROM numbered GROUP BY ALL)
    SELECT doc_id, chunk_no::INT AS chunk_no, length(text) AS chars, md5(text) AS digest FROM chunks"""


FIXED = """pieces AS (SELECT doc_id, source, unnest(generate_series(0, greatest(length(text) - 201, 0), 800)) AS s, text
  FROM documents WHERE length(text) > 0)"""

# judge replies


def reply(metrics: list[str]) -> str:
    score = "((length(answer) + turn) % 10 + 1)"
    full = " || ', ' || ".join(f"'\"{m}\": ' || {score}" for m in metrics)
    return f"""CASE (conv_id + turn) % 7 WHEN 0 THEN '' WHEN 1 THEN '{{"broken'
      WHEN 2 THEN '{{"{metrics[0]}": ' || {score} || '}}' ELSE '{{' || {full} || '}}' END"""


def parsed(metric: str) -> str:
    return (
        "CASE WHEN trim(reply) <> '' AND json_valid(reply) "
        f"THEN json_extract(CASE WHEN json_valid(reply) AND trim(reply) <> '' THEN reply ELSE '{{}}' END, '$.{metric}')::DOUBLE "
        f"ELSE 0 END"
    )


# call policies

MICROS = "epoch_us(ts)"


def folded(key: str, source: str, keep: str, ok: str) -> str:
    """Sequential decisions per key: ``ok`` and ``keep`` read the live calls ``acc`` and a time."""
    return f"""calls AS (SELECT {key} AS key, list(event_id ORDER BY t, event_id) AS ids,
      list(t ORDER BY t, event_id) AS ts FROM (SELECT *, {MICROS} AS t FROM {source}) GROUP BY ALL),
    fold AS (SELECT key, ids, list_reduce(list_transform(ts, lambda x:
        {{'t': x, 'kept': []::BIGINT[], 'flags': []::BOOLEAN[]}}),
      lambda acc, x: {{'t': x.t,
        'kept': CASE WHEN {ok} THEN list_append({keep}, x.t) ELSE {keep} END,
        'flags': list_append(acc.flags, {ok})}},
      {{'t': 0::BIGINT, 'kept': []::BIGINT[], 'flags': []::BOOLEAN[]}}) AS r FROM calls),
    decided AS (SELECT key, unnest(ids) AS event_id, unnest(r.flags) AS flag FROM fold)"""


_LIVE = f"list_filter(acc.kept, lambda k: x.t - k <= {q.RATE_WINDOW * 1_000_000})"
LIMITED = folded("event_type", "events", _LIVE, f"len({_LIVE}) < {q.RATE_LIMIT}")
_VALID = f"list_filter(acc.kept, lambda k: x.t - k < {q.TTL * 1_000_000})"
PRINT = "substr(sha256(event_type || ':[' || user_id || ']:{}'), 1, 16)"
REUSED = folded(
    "fingerprint", f"(SELECT *, {PRINT} AS fingerprint FROM events)", _VALID, f"len({_VALID}) < 1"
)

ORACLES: dict[str, str] = {
    "language_mix": f"SELECT lang, {LANGUAGE} AS detected, count(*) AS docs FROM documents GROUP BY ALL",
    "keyword_jaccard_qa": f"WITH {PREPARED} SELECT conv_id, turn, round({similarity('question', 'answer')}, 6) AS similarity FROM prepared",
    "text_stats": f"""WITH {STATS} SELECT doc_id, word_count, character_count, character_count_no_spaces,
      sentence_count, round(word_length, 6) AS word_length FROM stats""",
    "script_mix": f"""SELECT {SCRIPT_NAME} AS language_detected, contains_thai, contains_english, count(*) AS docs
      FROM (SELECT {SCRIPT} FROM documents) GROUP BY ALL""",
    "top_words": f"WITH {TOP_WORDS} SELECT doc_id, place, word, n FROM ranked WHERE place <= 5",
    "word_frequency": f"SELECT word, count(*) AS n FROM (SELECT unnest({COUNTED}) AS word FROM documents) GROUP BY word",
    "readability_mix": f"""WITH {STATS} SELECT lang, {LEVEL} AS readability, count(*) AS docs FROM (SELECT *,
      CASE WHEN sentence_count > 0 THEN word_count / sentence_count ELSE 0 END AS sentence_length FROM stats) GROUP BY ALL""",
    "sentence_counts": f"""SELECT doc_id, len(s) AS sentences, md5(array_to_string(s, '|')) AS digest
      FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)""",
    "text_analysis": f"""WITH {STATS}, {TOP_WORDS}, common AS (SELECT doc_id, string_agg(word || '=' || n, ',' ORDER BY place) AS common
        FROM ranked WHERE place <= 5 GROUP BY doc_id)
      SELECT doc_id, word_count AS words, {SCRIPT_NAME} AS language_detected, {LEVEL} AS readability_score,
        coalesce(common, '') AS common FROM (SELECT *, {SCRIPT},
        CASE WHEN sentence_count > 0 THEN word_count / sentence_count ELSE 0 END AS sentence_length FROM stats)
      LEFT JOIN common USING (doc_id)""",
    "injection_check": f"""WITH {PAIRS}, f AS (SELECT *, {found('question', rules.INJECTION, True)} AS hits FROM pairs)
      SELECT conv_id, turn, CASE WHEN len(hits) > 0 THEN 'fail' ELSE 'pass' END AS result,
        CASE WHEN len(hits) > 0 THEN 'Potential prompt injection detected' ELSE 'No prompt injection detected' END AS message,
        CASE WHEN len(hits) > 0 THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END AS confidence,
        array_to_string(hits, ' ; ') AS found FROM f""",
    "length_check": f"""SELECT doc_id, {length_result('text', 1, 1000)} AS input_result,
      {length_message('text', 'Input', 1, 1000)} AS input_message, {length_result('text', 5, 2000)} AS output_result,
      {length_message('text', 'Output', 5, 2000)} AS output_message FROM documents""",
    "profanity_check": f"""WITH {PAIRS}, f AS (SELECT *, {found('question', rules.PROFANITY)} AS hits FROM pairs)
      SELECT conv_id, turn, CASE WHEN len(hits) > 0 THEN 'warning' ELSE 'pass' END AS result,
        CASE WHEN len(hits) > 0 THEN 'Inappropriate content detected' ELSE 'No inappropriate content detected' END AS message,
        CASE WHEN len(hits) > 0 THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END AS confidence,
        array_to_string(hits, ' ; ') AS found FROM f""",
    "token_profanity_check": f"""WITH {PREPARED} SELECT conv_id, turn,
      CASE WHEN {' OR '.join(holds('question', words_of(p)) for p in rules.PROFANITY)} THEN 'fail' ELSE 'pass' END AS all_words,
      CASE WHEN len({found('question', rules.PROFANITY)}) > 0 THEN 'fail' ELSE 'pass' END AS any_word FROM prepared""",
    "toxicity_all": f"WITH {PAIRS} " + toxicity("pairs", "conv_id, turn", "question", "all"),
    "toxicity_any": toxicity("documents", "doc_id", "text", "any"),
    "toxicity_against_labels": f"""WITH t AS ({toxicity('documents', 'doc_id', 'text', 'any')})
      SELECT toxic, result, count(*) AS docs FROM t JOIN labels USING (doc_id) GROUP BY ALL""",
    "hate_check": f"""WITH {PAIRS}, f AS (SELECT *, {hate_parts('text')} FROM
        (SELECT conv_id, turn, question || chr(10) || answer AS text FROM pairs))
      SELECT conv_id, turn, {HATE_RESULT} AS result,
        CASE {HATE_RESULT} WHEN 'fail' THEN 'Hate speech detected'
          WHEN 'warning' THEN 'Potentially discriminatory content detected' ELSE 'No hate speech detected' END AS message,
        round(CASE WHEN {HATE_HIT} THEN {HATE_SCORE} ELSE 0.9 END, 6) AS confidence,
        array_to_string(ht, ' ; ') AS found FROM f""",
    "hate_documents": f"""SELECT doc_id, {HATE_RESULT} AS result,
      round(CASE WHEN {HATE_HIT} THEN {HATE_SCORE} ELSE 0.9 END, 6) AS confidence
      FROM (SELECT doc_id, {hate_parts('text')} FROM documents)""",
    "pii_counts": "SELECT doc_id, " + ", ".join(
        f"len(regexp_extract_all({pii_source(k, 'text')}, {lit(pii_pattern(k))})) AS {k}" for k in rules.PII
    ) + " FROM documents",
    "pii_spans": f"""WITH {PII_PLACED} SELECT doc_id, type, value, s AS start, e AS "end", confidence FROM spans""",
    "pii_masked_all": f"""WITH {PII_PLACED}, {pii_masked('spans')},
      counts AS (SELECT doc_id, count(*) AS n FROM spans GROUP BY doc_id)
      SELECT doc_id, masked_text, coalesce(n, 0) AS spans FROM masked LEFT JOIN counts USING (doc_id)""",
    "pii_email_masked": f"""WITH f AS (SELECT doc_id, text, list_distinct(regexp_extract_all(text, {lit(pii_pattern('email'))})) AS m FROM documents),
      r AS (SELECT doc_id, list_reduce(list_concat([text], m), lambda acc, e: replace(acc, e,
        CASE WHEN length(split_part(e, '@', 1)) > 2 THEN substr(e, 1, 1) || repeat('*', length(split_part(e, '@', 1)) - 2)
          || substr(split_part(e, '@', 1), length(split_part(e, '@', 1)), 1)
        ELSE repeat('*', length(split_part(e, '@', 1))) END || '@' || split_part(e, '@', 2))) AS t FROM f)
      SELECT doc_id, md5(t) AS digest FROM r""",
    "pii_verdict": f"""WITH {PII_PLACED}, wanted AS (SELECT * FROM spans WHERE type <> 'phone_thai'), {pii_masked('wanted')},
      told AS (SELECT doc_id, count(*) FILTER (type <> 'phone_thai') AS n,
        string_agg('''' || type || '''', ', ' ORDER BY s, rank) FILTER (type <> 'phone_thai') AS listed FROM spans GROUP BY doc_id)
      SELECT doc_id, CASE WHEN n > 0 THEN 'fail' ELSE 'pass' END AS result,
        CASE WHEN n > 0 THEN 'PII detected: [' || listed || ']' WHEN n = 0 THEN 'Only allowed PII types detected'
          ELSE 'No PII detected' END AS message,
        CASE WHEN n = 0 THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END AS confidence,
        CASE WHEN n > 0 THEN md5(masked_text) ELSE '' END AS digest
      FROM masked LEFT JOIN told USING (doc_id)""",
    "relevance_check": f"""WITH {PREPARED}, f AS (SELECT *, {declined('answer')} AS phrase, {similarity('question', 'answer')} AS s FROM prepared)
      SELECT conv_id, turn, CASE WHEN phrase IS NOT NULL THEN 'fail' WHEN s < 0.3 THEN 'warning' ELSE 'pass' END AS result,
        CASE WHEN phrase IS NOT NULL THEN 0.9::DOUBLE WHEN s < 0.3 THEN 0.7::DOUBLE ELSE 0.8::DOUBLE END AS confidence,
        coalesce(phrase, '') AS phrase, CASE WHEN phrase IS NULL THEN round(s, 6) ELSE -1 END AS score FROM f""",
    "hallucination_check": f"""WITH {PREPARED}, f AS (SELECT *, {issues('answer')} + {LOW_COVERAGE}::INT AS issues FROM prepared)
      SELECT conv_id, turn, CASE WHEN issues > 0 THEN 'warning' ELSE 'pass' END AS result,
        CASE WHEN issues > 0 THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END AS confidence, issues FROM f""",
    "validate_input": f"""WITH {INPUT_RUN} SELECT conv_id, turn, NOT list_contains(kept, 'fail') AND {WARNINGS} <= 2 AS is_valid,
      array_to_string(kept, ',') AS outcomes FROM cut""",
    "checks_on_stream": f"""WITH {TURN_RUN} SELECT conv_id, turn, NOT list_contains(kept, 'fail') AND {WARNINGS} <= 2 AS is_valid,
      array_to_string(kept, ',') AS outcomes FROM cut""",
    "validate_output": f"""WITH {OUTPUT_RUN} SELECT conv_id, turn, NOT list_contains(kept, 'fail') AS is_valid,
      array_to_string(kept, ',') AS outcomes FROM cut""",
    "validate_documents": f"""WITH {DOCUMENT_RUN} SELECT doc_id, NOT list_contains(kept, 'fail') AND {WARNINGS} <= 2 AS is_valid,
      array_to_string(kept, ',') AS outcomes FROM cut""",
    "guardrail_report": f"""WITH {INPUT_RUN} SELECT {CHECK_NAMES}[i] AS validator, result, count(*) AS runs
      FROM (SELECT unnest(kept) AS result, generate_subscripts(kept, 1) AS i FROM cut) GROUP BY ALL""",
    "report_status": f"""WITH {OUTPUT_RUN}, s AS (SELECT CASE WHEN list_contains(kept, 'fail') THEN 'failed'
        WHEN list_contains(kept, 'warning') THEN 'warning' ELSE 'passed' END AS status, len(kept) AS n, {WARNINGS} AS w FROM cut)
      SELECT status, count(*) AS runs, sum(n)::BIGINT AS checks, sum(w)::BIGINT AS warnings FROM s GROUP BY status""",
    "fixed_chunks": f"""WITH {FIXED} SELECT doc_id, (s // 800)::INT AS chunk_no, length(substr(text, s + 1, 1000)) AS chars,
      md5(substr(text, s + 1, 1000)) AS digest FROM pieces""",
    "semantic_chunks_percentile": semantic("percentile"),
    "semantic_chunks_deviation": semantic("deviation"),
    "semantic_chunks_interquartile": semantic("interquartile"),
    "semantic_chunks_gradient": semantic("gradient"),
    "ingestion_summary": f"""WITH {FIXED} SELECT (SELECT count(*) FROM documents) AS num_documents,
      (SELECT count(*) FROM pieces) AS num_chunks, (SELECT count(DISTINCT source) FROM documents) AS num_sources""",
    "ingestion_vectors": semantic("percentile").replace(
        "SELECT doc_id, chunk_no::INT AS chunk_no, length(text) AS chars, md5(text) AS digest FROM chunks",
        "SELECT doc_id || '-' || chunk_no::INT AS chunk_id, 64 AS size, length(c.text) AS chars, source "
        "FROM chunks c JOIN documents USING (doc_id)",
    ),
    "vector_table": f"""WITH {FIXED} SELECT doc_id || '-' || (s // 800) AS chunk_id, len({tokens('substr(text, s + 1, 1000)')}) AS words,
      md5(substr(text, s + 1, 1000)) AS digest, source FROM pieces""",
    "embedding_column": f"WITH {buckets('dv', 'doc_id', 'text', 'documents')} SELECT doc_id, b AS bucket, c AS n FROM dv",
    "topk_l2": f"WITH {nearest(10, 'l2')} {HIT_COLUMNS}",
    "lexicon_matches": f"""WITH passages AS (SELECT {tokens('text')} AS w FROM benchmark),
      phrases AS (SELECT DISTINCT array_to_string(w[i:i + n - 1], ' ') AS phrase, list_distinct(w[i:i + n - 1]) AS bag, n
        FROM passages, range(3, 21) a(n), range(1, len(w) - n + 2) b(i)),
      numbered AS (SELECT phrase, any_value(bag) AS bag, max(n) AS n, row_number() OVER () AS p FROM phrases GROUP BY phrase),
      asked AS (SELECT p, len(bag) AS size, unnest(bag) AS word FROM numbered),
      held AS (SELECT DISTINCT doc_id, unnest({tokens('text')}) AS word FROM documents),
      found AS (SELECT doc_id, p FROM asked JOIN held USING (word) GROUP BY doc_id, p, size HAVING count(*) = size)
      SELECT doc_id, count(*) AS n_phrases, max(n) AS longest, min(phrase) AS first_phrase
      FROM found JOIN numbered USING (p) GROUP BY doc_id""",
    "topk_by_cells": f"WITH {nearest(10, 'l2', ASKED)} {HIT_COLUMNS}",
    "topk_cosine": f"WITH {nearest(10, 'cosine')} {HIT_COLUMNS}",
    "topk_dot": f"WITH {nearest(10, 'dot')} {HIT_COLUMNS}",
    "score_threshold": f"WITH {nearest(20, 'cosine')} {HIT_COLUMNS} WHERE score >= 0.3",
    "document_retrieval": f"WITH {document_hits(5)} {HIT_COLUMNS}",
    "context_prompt": f"""WITH {CONTEXT} SELECT question_id, length(context) AS context_chars,
      md5('Use this context:' || chr(10) || context || chr(10) || chr(10) || 'Question: ' || b.text || chr(10)) AS digest
      FROM joined JOIN benchmark b ON item_id = question_id""",
    "validate_context": f"""WITH {CONTEXT} SELECT question_id, md5(lines) AS digest, true AS is_valid, 0 AS checks FROM joined""",
    "retrieval_eval": f"""WITH {EVAL} SELECT question_id, round(precision, 6) AS precision, round(recall, 6) AS recall,
      round(f1_score, 6) AS f1_score, round(avg_relevance, 6) AS avg_relevance, retrieved_count FROM scored""",
    "retrieval_summary": f"""WITH {EVAL} SELECT round(avg(precision), 6) AS avg_precision, round(avg(recall), 6) AS avg_recall,
      round(avg(f1_score), 6) AS avg_f1_score, round(avg(avg_relevance), 6) AS avg_relevance, count(*) AS total_queries FROM scored""",
    "retrieval_at_k": f"""WITH {nearest(10, 'l2')}, t AS (SELECT label, count(*) AS total FROM embeddings GROUP BY label)
      SELECT question_id, k, round(count(*) FILTER (rank <= k AND hits.label = question_id) / count(*) FILTER (rank <= k), 6) AS precision_at_k,
        round(count(*) FILTER (rank <= k AND hits.label = question_id) / any_value(total), 6) AS recall_at_k
      FROM hits CROSS JOIN (SELECT unnest([3, 5, 10]) AS k) JOIN t ON t.label = question_id GROUP BY question_id, k""",
    "mrr": f"""WITH {nearest(10, 'l2')}, f AS (SELECT question_id, min(CASE WHEN label = question_id THEN rank END) AS first FROM hits GROUP BY question_id)
      SELECT round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, count(*) AS total_queries FROM f""",
    "pair_similarity": f"""WITH {PAIRS}, {buckets('qv', 'conv_id, turn', 'question', 'pairs')}, {buckets('av', 'conv_id, turn', 'answer', 'pairs')},
      dots AS (SELECT qv.conv_id, qv.turn, sum(qv.c * av.c)::DOUBLE AS d FROM qv JOIN av USING (conv_id, turn, b) GROUP BY ALL)
      SELECT p.conv_id, p.turn, round(coalesce(d / (sqrt(x.n) * sqrt(y.n)), 0), 6) AS similarity FROM pairs p
      LEFT JOIN dots USING (conv_id, turn) LEFT JOIN qv_n x USING (conv_id, turn) LEFT JOIN av_n y USING (conv_id, turn)""",
    "judge_summary": f"""WITH {PAIRS}, r AS (SELECT {reply(q.evaluation.ANSWER_METRICS)} AS reply FROM pairs)
      SELECT """ + ", ".join(f"round(coalesce(avg({parsed(m)}), 0), 6) AS avg_{m}" for m in q.evaluation.ANSWER_METRICS)
    + ", count(*) AS total_queries FROM r",
    "rag_summary": f"""WITH {PAIRS}, r AS (SELECT turn % 6 = 4 AS bad, {reply(q.evaluation.RAG_METRICS)} AS reply FROM pairs)
      SELECT """ + ", ".join(
        f"round(coalesce(avg(CASE WHEN bad THEN 0 ELSE {parsed(m)} END), 0), 6) AS avg_{m}" for m in q.evaluation.RAG_METRICS
    ) + ", count(*) AS total_queries, count(*) FILTER (NOT bad) AS successful_queries FROM r",
    "generation_offline": f"""WITH {PREPARED} SELECT conv_id, turn, round(10 * CASE WHEN context IS NULL
      THEN {similarity('question', 'answer')} ELSE {similarity('context', 'answer')} END, 6) AS overall_quality FROM prepared""",
    "judge_prompts": f"""WITH {PAIRS} SELECT conv_id, turn, md5(replace(replace(replace(replace(replace(
      {lit(q.evaluation.ANSWER_PROMPT)}, '{{{{', '{{'), '}}}}', '}}'), '{{reference}}', coalesce(context, 'None')),
      '{{answer}}', answer), '{{question}}', question)) AS digest FROM pairs""",
    "number_stats": """SELECT l_returnflag, count(*) AS count, round(sum(x), 2) AS sum, round(avg(x), 4) AS mean,
      round(median(x), 6) AS median, min(x) AS min, max(x) AS max, round(max(x) - min(x), 6) AS range,
      round(var_pop(x) / 1e6, 4) AS variance_m, round(stddev_pop(x), 4) AS std_dev
      FROM (SELECT l_returnflag, l_extendedprice AS x FROM lineitem) GROUP BY l_returnflag""",
    "list_stats": """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings)
      SELECT vec_id, count(*) AS n, round(avg(x), 6) AS mean, round(median(x), 6) AS median,
        round(max(x) - min(x), 6) AS range, round(var_pop(x), 6) AS variance, round(stddev_pop(x), 6) AS std_dev,
        min(x) AS min, string_agg(round(x * 1000)::INT::VARCHAR, ',' ORDER BY x) AS sorted FROM x GROUP BY vec_id""",
    "mmr": f"WITH {nearest(20, 'l2')}, {diverse(4)} SELECT question_id, vec_id, rank::INT AS rank FROM picked",
    "sorted_numbers": "SELECT c_mktsegment, c_acctbal FROM customer ORDER BY ALL",
    "formula_column": """SELECT l_orderkey, l_linenumber, l_partkey,
      l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_quantity * l_discount AS product FROM lineitem""",
    "document_averages": """SELECT c.conv_id, count(a.text) AS num_retrieved_docs,
      round(coalesce(sum(length(a.text)), 0) / greatest(count(a.text), 1), 6) AS avg_doc_length
      FROM (SELECT DISTINCT conv_id FROM conversations) c
      LEFT JOIN conversations a ON a.conv_id = c.conv_id AND a.role = 'assistant' GROUP BY c.conv_id""",
    "answer_pairs": f"""WITH {RAW_PAIRS} SELECT conv_id, turn, md5(question) AS question, md5(answer) AS answer,
      coalesce(md5(context), '') AS context FROM raw_pairs""",
    "session_filter": f"""WITH s AS (SELECT conv_id, turn, regexp_replace(CASE (conv_id + turn) % 11 WHEN 0 THEN ' Quit ' WHEN 1 THEN '  ' ELSE text END,
        '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS question FROM conversations),
      open AS (SELECT *, sum(CASE WHEN lower(question) IN ({', '.join(lit(w) for w in rules.EXIT_WORDS)}) THEN 1 ELSE 0 END)
        OVER (PARTITION BY conv_id ORDER BY turn) AS ended FROM s),
      kept AS (SELECT * FROM open WHERE ended = 0 AND question <> '')
      SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS question_no,
        count(*) OVER (PARTITION BY conv_id) AS total_questions, md5(question) AS digest FROM kept""",
    "query_log": f"""WITH {PAIRS} SELECT conv_id, turn, md5(substr(question, 1, 500)) AS logged_question,
      length(question) AS question_length, CASE WHEN turn > 1 THEN conv_id::VARCHAR ELSE 'anonymous' END AS "user",
      conv_id::VARCHAR AS session, 'chain' AS execution_mode, (context IS NOT NULL)::INT AS num_retrieved_docs,
      length(answer) AS answer_length, coalesce(length(context), 0)::DOUBLE AS avg_doc_length,
      CASE WHEN length(context) > 200 THEN substr(context, 1, 200) || '...' ELSE coalesce(context, '') END AS content,
      CASE WHEN turn > 1 THEN conv_id::VARCHAR ELSE '' END AS pair_user, md5(answer) AS pair_answer FROM pairs""",
    "rate_limit": f"WITH {LIMITED} SELECT event_id, key AS event_type, flag AS allowed FROM decided",
    "rate_usage": f"""WITH {LIMITED}, used AS (SELECT d.event_id, key AS event_type, {MICROS} AS t FROM decided d JOIN events USING (event_id) WHERE flag),
      c AS (SELECT *, count(*) OVER (PARTITION BY event_type ORDER BY t RANGE BETWEEN {q.RATE_WINDOW * 1_000_000} PRECEDING AND CURRENT ROW) AS n FROM used)
      SELECT event_id, event_type, n AS current_calls, greatest(0, {q.RATE_LIMIT} - n) AS remaining_calls FROM c""",
    "call_fingerprint": """SELECT event_id,
      substr(sha256(event_type || ':[' || user_id || ', ' || to_json(props)::VARCHAR || ']:{}'), 1, 16) AS fingerprint,
      substr(sha256('[' || user_id || ']:{}'), 1, 16) AS without_name FROM events""",
    "ttl_reuse": f"WITH {REUSED} SELECT event_id, key AS fingerprint, NOT flag AS is_hit FROM decided",
    "latest_template": """SELECT source, max(doc_id) AS doc_id, md5(arg_max(text, doc_id)) AS digest
      FROM documents GROUP BY source""",
}

ORACLES |= {
    "golden_cases": f"""WITH {PAIRS} SELECT md5(question) AS question, md5(CASE WHEN turn % 3 > 0 THEN answer ELSE '' END) AS ideal_answer,
      coalesce(md5(context), '') AS ideal_context, count(*) AS cases FROM pairs GROUP BY ALL""",
    "quick_generation": f"""WITH {PAIRS}, told AS (SELECT coalesce(context, question) AS a, CASE WHEN turn % 3 > 0 THEN answer ELSE '' END AS b FROM pairs),
      kw AS (SELECT a, b, {keyword_set('a')} AS a_kw, {keyword_set('b')} AS b_kw FROM told)
      SELECT round(avg(10 * {similarity('a', 'b')}), 6) AS avg_overall_quality, count(*) AS total_queries FROM kw""",
    "template_files": """SELECT lower(replace(r_name, ' ', '_')) AS name, 'v' || n_nationkey AS version, max(n_nationkey) OVER (PARTITION BY r_name)::INT AS latest,
      md5('As of ' || n_name || ':' || chr(10) || '  ask {question}' || chr(10)) AS digest FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "custom_patterns": r"""WITH t AS (SELECT p_partkey, p_name || ' ' || p_brand || ' ' || p_type || p_partkey AS text FROM part),
      w AS (SELECT p_partkey, text, regexp_extract(text, '[A-Za-z]{2,}[0-9]{2,}$') AS last FROM t)
      SELECT p_partkey, CASE WHEN last = '' THEN '' ELSE (length(text) - length(last)) || ':' || last END AS spans FROM w""",
    "custom_check": f"""WITH {PAIRS}, r AS (SELECT conv_id, turn, {length_result('question', 2, 1500)} AS len, contains(question, '?') AS asks FROM pairs)
      SELECT conv_id, turn, len = 'pass' AS is_valid, 'InputLengthValidator=' || len
        || CASE WHEN len = 'fail' THEN '' WHEN asks THEN ',QuestionMark=pass' ELSE ',QuestionMark=warning' END AS outcomes FROM r""",
    "gated_checks": f"""WITH {PREPARED}, p AS (SELECT *, {toxic_levels('question', 'all')} AS lv, {hate_parts('question')} FROM prepared),
      r AS (SELECT {TOXIC_RESULT} AS toxic FROM p)
      SELECT 'lengths' AS gate, 'InputLengthValidator' AS validator, count(*) AS runs FROM r
      UNION ALL SELECT 'unsafe', 'ToxicityValidator', count(*) FROM r
      UNION ALL SELECT 'unsafe', 'HateSpeechValidator', count(*) FILTER (toxic <> 'fail') FROM r""",
    "custom_embedder": "SELECT doc_id, " + ", ".join(
        f"length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{c}', '')) AS {c}" for c in "aeiou") + " FROM documents",
    "chosen_analyses": "SELECT l_orderkey, l_linenumber, round(l_quantity::DOUBLE * l_tax::DOUBLE, 6) AS product FROM lineitem",
}

ORACLES["rate_limit_on_stream"] = ORACLES["rate_limit"]
ORACLES["ttl_reuse_on_stream"] = ORACLES["ttl_reuse"]
ORACLES["answer_pairs_on_stream"] = ORACLES["answer_pairs"]
ORACLES["session_filter_on_stream"] = ORACLES["session_filter"]
# escapes of letters beyond ASCII, all in the first plane here
_ESCAPED = """array_to_string(list_transform(string_split(head, ''), lambda c: CASE WHEN c = chr(10) THEN '\\n' WHEN c = chr(9) THEN '\\t'
  WHEN c = chr(13) THEN '\\r' WHEN c = '"' THEN '\\"' WHEN c = '\\' THEN '\\\\' WHEN unicode(c) > 127 THEN '\\u' || lpad(lower(to_hex(unicode(c))), 4, '0')
  ELSE c END), '')"""
ORACLES["call_fingerprint_named"] = f"""SELECT doc_id, substr(sha256(lang || ':[]:{{"id": ' || doc_id || ', "text": "' || {_ESCAPED} || '"}}'), 1, 16) AS fingerprint
  FROM (SELECT doc_id, lang, text AS head FROM documents)"""
ORACLES["rendered_templates"] = """WITH told AS (SELECT r_name, n_nationkey, n_name, max(n_nationkey) OVER (PARTITION BY r_name) AS latest
    FROM nation JOIN region ON n_regionkey = r_regionkey),
  asked AS (SELECT c_custkey, c_name, r_name, CASE WHEN c_custkey % 3 > 0 THEN n_nationkey END AS wanted
    FROM customer JOIN told ON c_nationkey = n_nationkey)
  SELECT c_custkey, 'v' || wanted AS template_version, 'As of {' || n_name || '}: ask ' || c_name || ' of ' || a.r_name AS prompt
  FROM asked a JOIN told t ON a.r_name = t.r_name AND n_nationkey = coalesce(wanted, latest)"""

# Lines that are short enough are packed in runs; a longer line, and a text of one line, is packed by words.
# Words of a thousand characters, which would be cut further, do not occur. A chunk begins with the tail of
# the one before, as far as two hundred characters and the next piece allow.
ORACLES["recursive_chunks"] = rf"""WITH RECURSIVE split AS (
    SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x, i: CASE WHEN i = 1 THEN x ELSE chr(10) || x END) AS parts
    FROM documents),
  lines AS (SELECT doc_id, n, line, len(parts) = 1 OR length(line) >= 1000 AS long FROM (
    SELECT doc_id, parts, unnest(parts) AS line, generate_subscripts(parts, 1) AS n FROM split) WHERE line <> ''),
  grouped AS (SELECT *, sum(long::INT) OVER (PARTITION BY doc_id ORDER BY n) * 2 - long::INT AS run FROM lines),
  runs AS (SELECT doc_id, run, list(line ORDER BY n) AS p FROM grouped WHERE NOT long GROUP BY ALL
    UNION ALL
    SELECT doc_id, run, list_filter(list_transform(string_split(line, ' '), lambda x, i: CASE WHEN i = 1 THEN x ELSE ' ' || x END),
      lambda x: x <> '') FROM grouped WHERE long),
  summed AS (SELECT doc_id, run, p, list_transform(range(1, len(p) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))::BIGINT) AS c
    FROM runs WHERE len(p) < 200
    UNION ALL
    SELECT doc_id, run, p, c FROM (SELECT doc_id, run, any_value(p) AS p, list(upto ORDER BY i) AS c FROM (
      SELECT doc_id, run, p, i, sum(length(p[i])) OVER (PARTITION BY doc_id, run ORDER BY i)::BIGINT AS upto
      FROM (SELECT doc_id, run, p, generate_subscripts(p, 1) AS i FROM runs WHERE len(p) >= 200)) GROUP BY doc_id, run)),
  pack AS (
    SELECT doc_id, run, 1 AS k, 1 AS s, greatest(1, len(list_filter(c, lambda x: x <= 1000))) AS e FROM summed
    UNION ALL
    SELECT doc_id, run, k + 1, s, greatest(e + 1, len(list_filter(c, lambda x: x - base <= 1000))) FROM (
      SELECT doc_id, run, k, e, c, s, CASE WHEN s = 1 THEN 0 ELSE c[s - 1] END AS base FROM (
        SELECT doc_id, run, k, e, c, 1 + len(list_filter(list_prepend(0, c[1:e]), lambda x:
          c[e] - x > 200 OR (c[e] - x > 0 AND c[e] - x + length(p[e + 1]) > 1000))) AS s
        FROM pack JOIN summed USING (doc_id, run) WHERE e < len(p)))),
  texts AS (SELECT doc_id, run, k, regexp_replace(array_to_string(p[s:e], ''), '^[{SPACE}]+|[{SPACE}]+$', '', 'g') AS chunk
    FROM pack JOIN summed USING (doc_id, run))
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY run, k) - 1)::INT AS chunk_no, length(chunk) AS chars, md5(chunk) AS digest
  FROM texts WHERE chunk <> ''"""

ORACLES["text_files"] = """SELECT conv_id, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn) || chr(10)) AS digest, true AS named
  FROM conversations GROUP BY conv_id"""
ORACLES["results_file"] = ORACLES["text_stats"]
