"""DuckDB statements with the results that the queries must have."""

from __future__ import annotations

from tracewright.functions import external
from tracewright.operators import transforms as tr

# White space as Python has it, and ASCII punctuation, inside RE2 character classes.
_B = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_P = r"!-/:-@\[-`{-~"
_W = r"\p{L}\p{N}_"


def words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '[{_B}]+'), lambda w: w <> '')"


def sents(t: str) -> str:
    return f"string_split(regexp_replace({t}, '([.!?])[{_B}]+', '\\1' || chr(1), 'g'), chr(1))"


def paras(t: str) -> str:
    return f"string_split({t}, chr(10) || chr(10))"


def lines(t: str) -> str:
    return f"string_split({t}, chr(10))"


def split_lines(t: str) -> str:
    parts = f"regexp_split_to_array(regexp_replace({t}, '\\r\\n', chr(10), 'g'), '[\\n-\\r\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')"
    return f"CASE WHEN {t} = '' THEN []::VARCHAR[] WHEN ({parts})[-1] = '' THEN ({parts})[:-2] ELSE {parts} END"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^[{_B}]+|[{_B}]+$', '', 'g')"


def bare(w: str) -> str:
    return f"regexp_replace({w}, '^[{_P}]+|[{_P}]+$', '', 'g')"


def upper(t: str) -> str:
    return f"upper(replace({t}, 'ß', 'SS'))"


def title(t: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({t}, '\\p{{L}}+|[^\\p{{L}}]+'), "
        "lambda r: (CASE WHEN r[1] = 'ß' THEN 'Ss' ELSE upper(r[1]) END) || lower(r[2:])), '')"
    )


def runs(t: str) -> str:
    return f"regexp_extract_all({t}, '[{_W}]+|[^{_W}]+')"


def tokens(t: str) -> str:
    return f"regexp_extract_all({t}, '[{_W}]+')"


def each(found: str, body: str, sep: str = "''") -> str:
    """The list with ``body`` (of x) for each x, joined."""
    return f"array_to_string(list_transform({found}, lambda x: {body}), {sep})"


def quoted(items: list[str]) -> str:
    return ", ".join("'" + i.replace("'", "''") + "'" for i in items)


def avoid_the(t: str) -> str:
    marked = f"regexp_replace({t}, '(^|[.?!:][ \\n]+)the\\b. ?(.)', '\\1' || chr(1) || '\\2', 'gi')"
    parts = f"string_split({marked}, chr(1))"
    return (
        f"regexp_replace(array_to_string(list_transform({parts}, lambda p, i: CASE WHEN i = 1 THEN p ELSE {upper('p[1]')} || p[2:] END), ''), "
        "'\\bthe\\b ?', '', 'gi')"
    )


def html_paragraphs(t: str) -> str:
    escaped = "replace(replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
    return each(paras(t), f"'<p>' || replace({escaped}, chr(10), '<br>') || '</p>'")


def _emoji_case() -> str:
    arms = " ".join(f"WHEN '{w}' THEN '{e}'" for w, e in tr.EMOJIS.items())
    return f"CASE lower(x) {arms} ELSE x END"


_CONNECTORS = quoted(tr.CONNECTORS)
_ORDINALS = "|".join(tr.ORDINALS)

#: Forward transforms as SQL over the column ``text``.
FORWARD: dict[str, str] = {
    "upper_case": upper("text"),
    "lower_case": "lower(text)",
    "title_case": title("text"),
    "avoid_the": avoid_the("text"),
    "replace_and_ampersand": each(runs("text"), "CASE WHEN x IN ('and', 'And') THEN '&' ELSE x END"),
    "one_word_per_line": f"array_to_string({words('text')}, chr(10))",
    "use_multiple_spaces": "regexp_replace(text, ' +', '   ', 'g')",
    "sentences_per_line": f"array_to_string({sents('text')}, chr(10))",
    "commas_to_semicolons": "replace(text, ',', ';')",
    "full_stops_to_exclamation_marks": "regexp_replace(text, '\\.([ \\n])', '!\\1', 'g')",
    "add_line_numbers": f"array_to_string(list_transform({split_lines('text')}, lambda x, i: i::VARCHAR || ': ' || x), chr(10))",
    "bracket_sentences": each(sents("text"), "'[' || x || ']'", "' '"),
    "indent_paragraphs": each(paras("text"), "chr(9) || x", "chr(10) || chr(10)"),
    "highlight_logical_words": each(runs("text"), f"CASE WHEN lower(x) IN ({_CONNECTORS}) THEN '*' || x || '*' ELSE x END"),
    "insert_sentence_divider": f"array_to_string({sents('text')}, ' | ')",
    "html_paragraphs": html_paragraphs("text"),
    "replace_words_with_emojis": each(runs("text"), _emoji_case()),
}

ORACLE: dict[str, str] = {f"tf_{n}": f"SELECT doc_id, {e} AS new_text FROM documents" for n, e in FORWARD.items()}
ORACLE["tf_json_of_paragraphs"] = f"SELECT doc_id, {paras('text')} AS paragraphs FROM documents"


def palindromes(t: str) -> str:
    return f"list_filter(list_transform({words(t)}, lambda w: {bare('w')}), lambda w: length(w) > 3 AND lower(w) = array_to_string(list_reverse(string_split(lower(w), '')), ''))"


def paragraph_count(t: str) -> str:
    return f"len(list_filter({lines(t)}, lambda x: {strip('x')} <> ''))"


def is_upper(w: str) -> str:
    return f"({w} = {upper(w)} AND {w} <> lower({w}))"


ORACLE["feat_counts"] = f"""
SELECT doc_id, len({words('text')}) AS word_count, len(list_distinct({words('lower(text)')})) AS unique_word_count,
  len(list_filter({sents('text')}, lambda s: {strip('s')} <> '')) AS sentence_count, {paragraph_count('text')} AS paragraph_count,
  len(list_filter({words('text')}, lambda w: {is_upper('w')})) AS uppercase_word_count, len({palindromes('text')}) AS palindromes
FROM documents"""

ORACLE["feat_top_word"] = f"""
WITH w AS (SELECT doc_id, unnest({tokens('lower(text)')}) AS word, generate_subscripts({tokens('lower(text)')}, 1) AS pos FROM documents),
c AS (SELECT doc_id, word, count(*) AS freq, min(pos) AS p FROM w GROUP BY ALL)
SELECT doc_id, word, freq FROM c QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY freq DESC, p) = 1"""


def _phrases(found: str) -> str:
    return f"SELECT doc_id, phrase, count(*) AS n FROM (SELECT doc_id, unnest({found}) AS phrase FROM documents) GROUP BY ALL HAVING count(*) > 1"


ORACLE["feat_repeated_sentences"] = _phrases(f"list_filter(list_transform({sents('text')}, lambda s: {strip('s')}), lambda s: s <> '')")


def _ngrams(n: int) -> str:
    return f"(SELECT doc_id, array_to_string(w[i:i + {n - 1}], ' ') AS phrase FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d))"


ORACLE["feat_ngram_repetitions"] = (
    f"WITH d AS (SELECT doc_id, {words('lower(text)')} AS w FROM documents), g AS ("
    + " UNION ALL ".join(f"SELECT * FROM {_ngrams(n)}" for n in (5, 6, 7, 8))
    + ") SELECT doc_id, phrase, count(*) AS n FROM g GROUP BY ALL HAVING count(*) > 1"
)


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[.?!|;,]+|[.?!|;,]+$', '', 'g')"


def _openings(parts: str) -> str:
    toks = f"list_transform({parts}, lambda p: string_split(p, ' '))"
    return "flatten([" + ", ".join(f"list_transform(list_filter({toks}, lambda w: len(w) > {n}), lambda w: {_trim(f'array_to_string(w[1:{n}], chr(32))')})" for n in (3, 4, 5)) + "])"


def _closings(parts: str) -> str:
    toks = f"list_transform({parts}, lambda p: string_split(p, ' '))"
    return "flatten([" + ", ".join(f"list_transform(list_filter({toks}, lambda w: len(w) > {n + 2}), lambda w: {_trim(f'array_to_string(w[len(w) - {n - 1}:], chr(32))')})" for n in (3, 4, 5)) + "])"


ORACLE["feat_sentence_openings"] = _phrases(_openings("string_split(text, '. ')"))
ORACLE["feat_sentence_closings"] = _phrases(_closings("string_split(text, '. ')"))
ORACLE["feat_paragraph_openings"] = _phrases(_openings(lines("text")))
ORACLE["feat_paragraph_closings"] = _phrases(_closings(lines("text")))

_ENUM_LINE = rf"^(?:(?:{_ORDINALS})(?:[^{_W}]|$)|\p{{Nd}}+[.):](?:[{_B}]|$))"


def is_enumeration(t: str) -> str:
    return f"(len(list_filter({split_lines(t)}, lambda x: {strip('x')} <> '' AND NOT regexp_matches(lower({strip('x')}), '{_ENUM_LINE}'))) = 0)"


ORACLE["feat_enumeration"] = f"""
SELECT doc_id, {is_enumeration('text')} AS all_lines,
  regexp_matches(text, '^(?:(?:first|second|third|one|two|three)(?:[^{_W}]|$)|[123]\\.[{_W}])', 'i') AS opening FROM documents"""

ORACLE["feat_alliteration_haiku"] = f"""
WITH d AS (SELECT doc_id, list_transform({words('lower(text)')}, lambda w: w[1]) AS f, list_filter({lines('text')}, lambda x: {strip('x')} <> '') AS l FROM documents)
SELECT doc_id, CASE WHEN f IS NULL THEN NULL ELSE len(f) >= 4 AND len(list_filter(range(1, len(f) - 2), lambda i: f[i] = f[i+1] AND f[i] = f[i+2] AND f[i] = f[i+3])) > 0 END AS alliterative,
  list_transform(l, lambda x: len(regexp_extract_all(lower(x), '[aeiouy]+'))) = [5, 7, 5] AS haiku FROM d"""

#: Evaluators as SQL over the columns ``t`` (text) and ``g`` (reference).
EVALUATORS: dict[str, str] = {
    "avoid_the_forward": f"NOT list_contains(list_transform({tokens('t')}, lambda x: lower(x)), 'the')",
    "replace_and_ampersand_forward": f"NOT list_contains(list_transform({tokens('t')}, lambda x: lower(x)), 'and')",
    "one_word_per_line_forward": f"{strip('t')} = array_to_string({words('t')}, chr(10))",
    "upper_case_forward": f"t = {upper('t')}",
    "lower_case_forward": "t = lower(t)",
    "title_case_forward": f"t = {title('t')}",
    "sentences_per_line_forward": f"len(list_filter({split_lines('t')}, lambda x: {strip('x')} <> '' AND NOT regexp_matches({strip('x')}, '[.!?]$'))) = 0",
    "commas_to_semicolons_forward": "NOT contains(t, ', ')",
    "full_stops_to_exclamation_marks_forward": "NOT contains(t, '.')",
    "add_line_numbers_forward": f"len(list_filter({split_lines('t')}, lambda x: NOT regexp_matches(x, '^\\p{{Nd}}+[:.)\\-][{_B}]'))) = 0",
    "contains_list_or_enumeration_forward": f"{is_enumeration('t')} = {is_enumeration('g')}",
    "bracket_sentences_forward": f"regexp_full_match(t, '\\[[^\\[\\]]+\\](?:[{_B}]*\\[[^\\[\\]]+\\])*')",
    "indent_paragraphs_forward": f"len(list_filter({split_lines('t')}, lambda x: {strip('x')} <> '' AND NOT starts_with(x, chr(9)))) = 0",
    "insert_sentence_divider_forward": f"len(string_split(t, '|')) >= 2 AND len(list_filter(string_split(t, '|'), lambda p: NOT regexp_matches({strip('p')}, '[.!?]$'))) = 0",
    "palindromes_backward": f"len(list_filter({palindromes('t')}, lambda p: NOT list_contains({palindromes('g')}, p))) = 0",
    "paragraph_count_backward": f"{paragraph_count('t')} = {paragraph_count('g')}",
    "partial_solution": "contains(t, '<partial_solution>') AND contains(t, '</partial_solution>')",
    "change_of_thought": "contains(t, '<change_of_thought>') = contains(g, '<change_of_thought>')",
    "replace_words_with_emojis": f"len(list_filter({tokens('t')}, lambda x: lower(x) IN ({quoted(list(tr.EMOJIS))}) AND NOT list_contains({tokens('g')}, x))) = 0",
    "highlight_logical_words_forward": f"NOT regexp_matches(t, '(^|[^*{_W}])({'|'.join(tr.CONNECTORS)})([^*{_W}]|$)', 'i')",
}

# Runs of spaces with something else than white space on both sides.
_OTHER = _B.replace(r"\x1c-\x20", r"\x1c-\x1f")
_RUNS = f"regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(t, '[{_OTHER}]', chr(10), 'g'), ' *\\n *', chr(10), 'g'), '^ +| +$', '', 'g'), ' +')"
EVALUATORS["use_multiple_spaces_forward"] = f"(len({_RUNS}) = 0 OR (len(list_distinct(list_transform({_RUNS}, lambda r: length(r)))) = 1 AND length(({_RUNS})[1]) BETWEEN 2 AND 4))"


def upper_words(t: str) -> str:
    return f"list_filter(list_transform({words(t)}, lambda w: {bare('w')}), lambda w: {is_upper('w')})"


def title_words(t: str) -> str:
    return f"list_filter(list_transform({words(t)}, lambda w: {bare('w')}), lambda w: w = {title('w')} AND regexp_matches(w, '\\p{{Lu}}|\\p{{Lt}}'))"


EVALUATORS["upper_case_backward"] = f"len(list_filter(({upper_words('t')})[:3], lambda w: NOT list_contains(({upper_words('g')})[:3], w) OR contains(t, lower(w)))) = 0"
EVALUATORS["title_case_backward"] = f"len(list_filter({title_words('t')}, lambda w: NOT list_contains({title_words('g')}, w))) = 0"
EVALUATORS["json_of_paragraphs_forward"] = (
    "coalesce(TRY(json_type(t) = 'OBJECT' AND coalesce(json_type(t, '$.paragraphs') = 'ARRAY', false) "
    "AND len(list_filter(coalesce(json_extract(t, '$.paragraphs[*]'), []), lambda x: json_type(x) <> 'VARCHAR')) = 0), false)"
)

# Elements without an end tag, by the HTML standard.
_VOID = "'area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'source', 'track', 'wbr'"


def html_ok(t: str) -> str:
    """Some tag, and every tag closed in turn: a stack of open elements, or an exclamation mark after an error."""
    name = "lower(regexp_extract(x, '^</?([a-zA-Z][^\\s/>]*)', 1))"
    step = (
        f"CASE WHEN a = '!' THEN a WHEN starts_with(x, '</') THEN CASE WHEN ends_with(a, '|' || {name}) THEN left(a, len(a) - len({name}) - 1) ELSE '!' END "
        f"WHEN ends_with(x, '/>') THEN CASE WHEN {name} IN ({_VOID}) THEN '!' ELSE a END WHEN {name} IN ({_VOID}) THEN a ELSE a || '|' || {name} END"
    )
    return f"(contains({t}, '<') AND list_reduce(regexp_extract_all({t}, '</?[a-zA-Z][^>]*>'), lambda a, x: {step}, '') = '')"


def hypernym_groups(t: str) -> str:
    kinds = ", ".join(f"{{'h': '{k}', 'n': list_filter(ws, lambda hw: hw IN ({quoted(tr.KINDS[k].split())}))}}" for k in sorted(tr.KINDS))
    return f"list_filter(list_transform([list_sort(list_distinct({ascii_words(t)}))], lambda ws: [{kinds}])[1], lambda hg: len(hg.n) >= 2)"


def ascii_words(t: str) -> str:
    return f"regexp_extract_all(lower({t}), '[a-z]+')"


def picked_hypernym(t: str) -> str:
    return f"list_sort(list_transform({hypernym_groups(t)}, lambda hp: {{'k': md5(hp.h || '|' || hp.n[1]), 'h': hp.h, 'n': hp.n}}))[1]"


EVALUATORS["render_as_html_forward"] = html_ok("t")
EVALUATORS["hypernyms_backward"] = f"len(list_filter(coalesce({picked_hypernym('g')}.n, []), lambda w: NOT list_contains({ascii_words('t')}, w))) = 0"
_TG = "SELECT DISTINCT output_id, model_response AS t, gt_response AS g FROM model_outputs"
ORACLE |= {f"ev_{n}": f"SELECT output_id, CASE WHEN t IS NULL THEN NULL ELSE ({e})::BIGINT END AS score FROM ({_TG})" for n, e in EVALUATORS.items()}


def _top(t: str) -> str:
    return f"""(SELECT output_id, word, freq FROM (SELECT output_id, word, count(*) AS freq, min(pos) AS p FROM
      (SELECT output_id, unnest({tokens(f'lower({t})')}) AS word, generate_subscripts({tokens(f'lower({t})')}, 1) AS pos FROM o) GROUP BY ALL)
      QUALIFY row_number() OVER (PARTITION BY output_id ORDER BY freq DESC, p) = 1)"""


ORACLE["ev_include_word_forward"] = f"""
WITH o AS ({_TG}) SELECT o.output_id, (a.word = b.word AND a.freq = b.freq)::BIGINT AS score
FROM o LEFT JOIN {_top('t')} a USING (output_id) LEFT JOIN {_top('g')} b USING (output_id)"""

# The name of each forward transform with its expression over the column text.
_BY_FUNCTION = {
    n: FORWARD[n.removesuffix("_forward")]
    for n in tr.FORWARD
    if n.removesuffix("_forward") in FORWARD and n in EVALUATORS
}
_PAGE = "'" + tr.PAGE_HEAD.replace("'", "''") + "' || " + html_paragraphs("text") + " || '" + tr.PAGE_FOOT + "'"
_BY_FUNCTION["render_as_html_forward"] = _PAGE
_BY_FUNCTION["json_of_paragraphs_forward"] = f"to_json({{'paragraphs': {paras('text')}}})::VARCHAR"
ORACLE["eval_forward_matrix"] = (
    "WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), m AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS function_name, ({EVALUATORS[n]})::BIGINT AS score FROM (SELECT {x} AS t, text AS g FROM d)" for n, x in _BY_FUNCTION.items())
    + ") SELECT function_name, round(avg(score), 9) AS accuracy, count(*) AS examples FROM m GROUP BY function_name"
)


def reasoning(t: str) -> str:
    head = f"string_split({t}, '</think>')[1]"
    recalls = " OR ".join(f"contains(lower({head})[:220], '{p}')" for p in ("let me recall", "adhere to these instructions"))
    return f"CASE WHEN ({recalls}) AND len({paras(head)}) > 1 THEN array_to_string(({paras(head)})[2:], chr(10) || chr(10)) ELSE {head} END"


def last_box(t: str) -> str:
    return f"string_split(string_split({t}, 'boxed{{')[-1], '}}')[1]"


_CASES = " ".join(f"WHEN '{n}' THEN ({EVALUATORS[n]})::BIGINT" for n in EVALUATORS)
ORACLE["eval_rollup"] = f"""
WITH o AS (SELECT DISTINCT output_id, function_name, score, model_response, gt_response FROM model_outputs),
r AS (SELECT output_id, function_name, score, {reasoning('model_response')} AS t, {reasoning('gt_response')} AS g FROM o),
s AS (SELECT *, CASE WHEN trim(coalesce(t, '')) = '' THEN 0 ELSE CASE function_name {_CASES} END END AS if_score FROM r WHERE trim(g) <> '' AND function_name IS NOT NULL)
SELECT function_name, round(avg(if_score), 9) AS if_accuracy, round(avg(score), 9) AS accuracy, count(*) AS examples
FROM s WHERE if_score IS NOT NULL GROUP BY ROLLUP (function_name)"""

_ANSWERS = "(SELECT DISTINCT sample_id, messages[2].content AS text FROM samples WHERE messages[2].content IS NOT NULL)"


def normalized(t: str) -> str:
    for a, b in (("<|begin_of_thought|>", "<think>"), ("<|end_of_thought|>", "</think>"), ("<|begin_of_solution|>", ""), ("<|end_of_solution|>", "")):
        t = f"replace({t}, '{a}', '{b}')"
    return (
        f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '<think>\\n+', '<think>' || chr(10), 'g'), "
        "'\\n+</think>', chr(10) || '</think>', 'g'), '</think>\\n+', '</think>' || chr(10) || chr(10), 'g'), '\\n+$', '')"
    )


ORACLE["trace_tag_normalize"] = f"SELECT sample_id, {normalized('text')} AS text FROM {_ANSWERS}"
ORACLE["trace_split"] = f"""
WITH n AS (SELECT sample_id, string_split(string_split({normalized('text')}, '<think>')[2], '</think>') AS p FROM {_ANSWERS})
SELECT sample_id, {strip('p[1]')} AS cot, {strip('p[2]')} AS response FROM n WHERE len(p) = 2"""
ORACLE["trace_split_strict"] = f"""
WITH n AS (SELECT sample_id, string_split({normalized('text')}, '<think>' || chr(10)) AS a FROM {_ANSWERS}),
m AS (SELECT sample_id, a, string_split(a[2], '</think>' || chr(10) || chr(10)) AS p FROM n),
k AS (SELECT *, coalesce(len(a) = 2 AND len(p) = 2, false) AS ok FROM m)
SELECT sample_id, CASE WHEN ok THEN p[1] END AS cot, CASE WHEN ok THEN p[2] END AS response, CASE WHEN NOT ok THEN 'layout' END AS error FROM k"""
ORACLE["trace_thought"] = f"""
WITH r AS (SELECT sample_id, array_to_string(CASE WHEN contains(text, '<think>') THEN string_split(text, '<think>')[2:] ELSE [text] END, '<think>') AS x FROM {_ANSWERS})
SELECT sample_id, CASE WHEN contains(x, '</think>') THEN array_to_string(string_split(x, '</think>')[:-2], '</think>') ELSE x END AS thought FROM r"""
ORACLE["trace_reasoning"] = f"SELECT DISTINCT trace_id, {reasoning('raw_answer')} AS reasoning FROM annotated_traces"
ORACLE["trace_boxed"] = f"""
SELECT DISTINCT trace_id, regexp_extract(raw_answer, '(?s)</think>.*?\\\\boxed\\{{((?:[^{{}}]|\\{{(?:[^{{}}]|\\{{[^{{}}]*\\}})*\\}})*)\\}}', 1) AS boxed,
  regexp_extract(raw_answer, '(?s)</think>.*?\\\\boxed\\{{(.*\\}})', 1) AS compat, {last_box('raw_answer')} AS last FROM annotated_traces"""

_KEYWORDS = ["wait", "double-check", "alternatively", "make sure", "another way", "verify", "to confirm"]
_HAS_KEYWORD = " OR ".join(f"contains(lower(p), '{k}')" for k in _KEYWORDS)
ORACLE["trace_chunks"] = f"""
WITH d AS (SELECT DISTINCT trace_id, trace FROM annotated_traces),
p AS (SELECT trace_id, unnest(l) AS p, generate_subscripts(l, 1) AS rn FROM (SELECT trace_id, list_filter(list_transform({paras('trace')}, lambda x: {strip('x')}), lambda x: x <> '') AS l FROM d)),
c AS (SELECT trace_id, rn, p, sum(CASE WHEN rn > 1 AND ({_HAS_KEYWORD}) THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY rn) AS ix FROM p)
SELECT trace_id, ix::BIGINT AS ix, string_agg(p, chr(10) || chr(10) ORDER BY rn) AS chunk FROM c GROUP BY trace_id, ix"""

_CHUNK_ROWS = """(SELECT trace_id, i - 1 AS ix, c[i] AS chunk, a[i].result AS answer FROM
  (SELECT trace_id, a, c, unnest(range(1, least(len(a), len(c)) + 1)) AS i FROM
    (SELECT DISTINCT trace_id, "partial_solutions-annotation" AS a, "partial_solutions-chunks" AS c FROM annotated_traces
     WHERE "partial_solutions-annotation" IS NOT NULL AND "partial_solutions-chunks" IS NOT NULL)))"""
ORACLE["trace_nearest_merge"] = f"""
WITH c AS (SELECT *, max(CASE WHEN answer IS NOT NULL THEN ix END) OVER (PARTITION BY trace_id ORDER BY ix) AS b,
  min(CASE WHEN answer IS NOT NULL THEN ix END) OVER (PARTITION BY trace_id ORDER BY ix DESC) AS a FROM {_CHUNK_ROWS}),
t AS (SELECT *, CASE WHEN b IS NULL THEN a WHEN a IS NULL THEN b WHEN ix - b <= a - ix THEN b ELSE a END AS target FROM c)
SELECT trace_id, target AS ix, string_agg(chunk, chr(10) || chr(10) ORDER BY ix) AS text FROM t WHERE target IS NOT NULL GROUP BY trace_id, target"""


def spliced(chunk: str, result: str) -> str:
    at = f"instr({chunk}, {result})"
    return (
        f"CASE WHEN coalesce({at} > 0 AND length({result}) > 0, false) THEN {chunk}[:{at} - 1] || '<partial_solution>' || {result} || '</partial_solution>' "
        f"|| {chunk}[{at} + length({result}):] ELSE {chunk} END"
    )


ORACLE["trace_splice"] = f"SELECT trace_id, ix, {spliced('chunk', 'answer')} AS chunk FROM {_CHUNK_ROWS}"
ORACLE["trace_annotated"] = f"""
WITH s AS (SELECT trace_id, string_agg({spliced('chunk', 'answer')}, chr(10) || chr(10) ORDER BY ix) AS x FROM {_CHUNK_ROWS} GROUP BY trace_id),
r AS (SELECT DISTINCT trace_id, raw_answer FROM annotated_traces WHERE len("partial_solutions-annotation") > 1)
SELECT trace_id, x || '</think>' || string_split(raw_answer, '</think>')[-1] AS text FROM s JOIN r USING (trace_id)
WHERE contains(x || string_split(raw_answer, '</think>')[-1], '<partial_solution>')"""

_NO = "row_number() OVER (ORDER BY doc_id)"
ORACLE["ds_shards"] = "SELECT doc_id, text, (ntile(7) OVER (ORDER BY doc_id) - 1)::INTEGER AS shard FROM documents"
ORACLE["ds_split_90_10"] = f"SELECT doc_id, text, CASE WHEN {_NO} <= floor(0.9 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS part FROM documents"
ORACLE["ds_sample_n"] = "SELECT doc_id, source FROM documents ORDER BY md5(doc_id::VARCHAR || '|42'), doc_id LIMIT 50"
ORACLE["ds_row_range"] = "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 60 OFFSET 100"
ORACLE["ds_batches"] = f"SELECT doc_id, text, (({_NO} - 1) // 64)::BIGINT AS batch FROM documents"

_TRAIN = """upper_case_forward title_case_forward replace_and_ampersand_forward avoid_the_forward one_word_per_line_forward
use_multiple_spaces_forward sentences_per_line_forward commas_to_semicolons_forward add_line_numbers_forward json_of_paragraphs_forward
indent_paragraphs_forward insert_sentence_divider_forward render_as_html_forward upper_case_backward title_case_backward palindromes_backward
hypernyms_backward""".split()
_HELD_OUT = "bracket_sentences_forward highlight_logical_words_forward lower_case_forward full_stops_to_exclamation_marks_forward paragraph_count_backward".split()
ORACLE["ds_ood_split"] = f"""
SELECT doc_id, f AS function_name, CASE WHEN f IN ({quoted(_HELD_OUT)}) THEN 'ood_test' ELSE 'train' END AS part
FROM (SELECT doc_id, ([{quoted(_TRAIN + _HELD_OUT)}])[doc_id % {len(_TRAIN + _HELD_OUT)} + 1] AS f FROM documents)"""
ORACLE["ds_dedup_first"] = "SELECT doc_id, text FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"
ORACLE["ds_dedup_delivered"] = "SELECT sample_id, source, epoch_us(ingested_at) AS ingested_us FROM samples QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY ingested_at) = 1"
ORACLE["ds_new_seeds"] = f"""
WITH l AS (SELECT {strip('x')} AS x FROM (SELECT unnest({lines('text')}) AS x FROM documents WHERE doc_kind = 'instruction')),
c AS (SELECT DISTINCT {strip("regexp_replace(x, '^- ', '')")} AS instruction FROM l WHERE starts_with(x, '- '))
SELECT instruction FROM c WHERE instruction <> '' AND instruction NOT IN (SELECT {strip('instruction')} FROM seed_instructions WHERE instruction IS NOT NULL)"""
_PAIR = "messages[1].role = 'user' AND messages[2].role = 'assistant' AND messages[1].content <> '' AND messages[2].content <> ''"
ORACLE["ds_first_pair"] = f"SELECT DISTINCT sample_id, len(messages) AS turns, length(messages[1].content) AS asked, length(messages[2].content) AS said FROM samples WHERE {_PAIR}"
ORACLE["ds_assistant_turns"] = """
SELECT sample_id, i - 1 AS turn, messages[i].content AS content FROM (SELECT sample_id, messages, unnest(range(1, len(messages) + 1)) AS i
FROM (SELECT DISTINCT sample_id, messages FROM samples)) WHERE messages[i].role = 'assistant'"""
ORACLE["ds_two_turns"] = "SELECT DISTINCT sample_id, split, messages[1].content AS asked, messages[2].content AS said FROM samples WHERE len(messages) = 2"
ORACLE["ds_length_histogram"] = f"SELECT least(floor(w / 20.0), 29)::BIGINT AS bin, count(*) AS n FROM (SELECT len({words('text')}) AS w FROM documents WHERE text IS NOT NULL) WHERE w <= 600 GROUP BY ALL"
ORACLE["ds_union_common"] = "SELECT split, source, count(*) AS n FROM (SELECT split, source FROM samples UNION ALL SELECT split, source FROM annotated_traces) GROUP BY ALL"
ORACLE["ds_length_buckets"] = f"""
SELECT sample_id, bucket, greatest(1, 16 // (1 + bucket))::INTEGER AS batch_size FROM (SELECT sample_id, (length(text) // 1000)::INTEGER AS bucket FROM {_ANSWERS})"""
ORACLE["ds_hyper_grid"] = """
SELECT lr, hidden, alpha, decay, row_number() OVER (ORDER BY a, b, c, d) - 1 AS ordinal FROM
(SELECT unnest([0.1::DOUBLE, 0.01]) AS lr, unnest([1, 2]) AS a), (SELECT unnest([0, 64, 128])::BIGINT AS hidden, unnest([1, 2, 3]) AS b),
(SELECT unnest([0.5::DOUBLE, 1.0]) AS alpha, unnest([1, 2]) AS c), (SELECT unnest([0.0::DOUBLE, 0.01]) AS decay, unnest([1, 2]) AS d)"""

_ALL_FORWARD = dict(_BY_FUNCTION)
_ALL_FORWARD["identity"] = "text"
_ALL_FORWARD["json_of_paragraphs_forward"] = _BY_FUNCTION["json_of_paragraphs_forward"]
_ALL_FORWARD["render_as_html_forward"] = _PAGE
_FAN = (
    "WITH d AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), f AS ("
    + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS function_name, text, {x} AS new_text FROM d" for n, x in _ALL_FORWARD.items())
    + """), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY function_name <> 'identity', md5(function_name || '|' || doc_id::VARCHAR || '|0')) AS r
      FROM f WHERE new_text <> text OR function_name = 'identity'),
    e AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM k WHERE r <= 8) """
)
ORACLE["instr_fan_out_ranks"] = _FAN + "SELECT doc_id, r - 1 AS rank, function_name FROM e WHERE n = 8"
_NOTES = "chr(10) || chr(10) || '## NOTES' || chr(10) || chr(10) || 'Instructions that you must follow in your reasoning chain (the part of your response before your final answer):' || chr(10) || '- '"
def prefix(note: str) -> str:
    return (
        f"'<think>' || chr(10) || 'Okay, so before I start reasoning, let me recall the user''s instructions for my reasoning chain: I must ' || {note} || '.' || chr(10) "
        "|| 'It''s really important that I adhere to these instructions.' || chr(10) || chr(10)"
    )


_PREFIX = prefix("'use capital letters only'")
ORACLE["instr_wrapped"] = f"""
WITH s AS (SELECT DISTINCT sample_id, messages[1].content AS u, messages[2].content AS text FROM samples WHERE {_PAIR}),
n AS (SELECT sample_id, u, string_split(string_split({normalized('text')}, '<think>')[2], '</think>') AS p FROM s),
w AS (SELECT sample_id, u || {_NOTES} || 'use capital letters only' AS asked, {_PREFIX} || {upper(strip('p[1]'))} || chr(10) || '</think>' || chr(10) || chr(10) || {strip('p[2]')} AS said FROM n WHERE len(p) = 2)
SELECT sample_id, asked, said, length(asked) + length(said) + 13 AS num_chars FROM w"""
_TWICE = f"CASE WHEN sample_id % 2 = 0 THEN {prefix(quoted(['be loud']))} || {prefix(quoted(['be slow']))} || messages[2].content ELSE messages[2].content END"
ORACLE["instr_reinstructed"] = f"""
WITH s AS (SELECT DISTINCT sample_id, messages[1].content AS u, {_TWICE} AS a FROM samples),
r AS (SELECT *, len(regexp_extract_all(a, 'let me recall the user''s instructions')) > 1 AND len({paras('a')}) > 1 AS twice FROM s)
SELECT sample_id, string_split(u, chr(10) || chr(10) || '## NOTES')[1] || {_NOTES} || 'be brief' AS asked,
  CASE WHEN twice THEN {prefix(quoted(['be brief']))} || array_to_string(({paras('a')})[2:], chr(10) || chr(10)) ELSE a END AS said FROM r"""


_UP = upper("text")
# every evaluator of a text against itself
_OF_ITSELF = EVALUATORS | {"translate_forward": "true", "include_word_forward": f"CASE WHEN len({tokens('lower(t)')}) > 0 THEN true END"}


def tested_sql(functions: str, cases: str) -> str:
    """``functions``: instruction_id, function_name; ``cases``: instruction_id, case_id, t, g, expected."""
    one = " ".join(f"WHEN '{n}' THEN ({e})::BIGINT" for n, e in _OF_ITSELF.items())
    return f"""SELECT instruction_id, function_name, round(coalesce(accuracy, 0), 9) AS accuracy FROM {functions} LEFT JOIN (
  SELECT instruction_id, function_name, avg(ok::INT) AS accuracy FROM (
    SELECT *, max(ok) OVER (PARTITION BY instruction_id, case_id) AS good FROM (
      SELECT instruction_id, function_name, case_id, (CASE function_name {one} END) IS NOT DISTINCT FROM expected::BIGINT AS ok FROM {functions} JOIN {cases} USING (instruction_id)))
  WHERE good GROUP BY ALL) USING (instruction_id, function_name) WHERE coalesce(accuracy, 0) >= 0.5"""


ORACLE["gen_tested_functions"] = f"""
WITH c AS (SELECT seed_id AS instruction_id, doc_id AS case_id, text AS t, text AS g, text = {_UP} AS expected FROM documents WHERE seed_id IS NOT NULL AND text IS NOT NULL),
f AS (SELECT seed_id AS instruction_id, unnest([{quoted(sorted(_OF_ITSELF))}]) AS function_name FROM seed_instructions)
{tested_sql('f', 'c')}"""
ORACLE["gen_judge_scores"] = """
WITH j AS (SELECT seed_id, nullif(regexp_extract(text, 'Score:\\s*(\\d+)', 1), '')::INT AS s FROM documents WHERE doc_kind = 'judge' AND seed_id IS NOT NULL)
SELECT seed_id, round(coalesce(avg(s), 0), 9) AS mean_score, coalesce(avg(s), 0) > 5 AS kept FROM j GROUP BY seed_id"""
ORACLE["gen_preferences"] = """
SELECT (coalesce(if_score, 0) > 0)::INTEGER AS is_positive, count(*) AS n FROM (SELECT DISTINCT output_id, if_score, model_response, instruction FROM model_outputs)
WHERE model_response IS NOT NULL AND instruction IS NOT NULL GROUP BY ALL"""
ORACLE["gen_translated"] = "SELECT doc_id, '[fr] ' || coalesce(text, '') AS new_text FROM documents"


def _short_form() -> str:
    x = "y"
    lit = lambda c, a, b: f"replace({c}, '{a}', '{b}')"
    sub = lambda c, a, b: f"regexp_replace({c}, '{a}', '{b}', 'g')"
    x = f"replace({x}, chr(10), '')"
    for a, b in (("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")):
        x = lit(x, a, b)
    x = lit(lit(lit(x, "\\%", ""), " .", " 0."), "{.", "{0.")
    x = sub(x, "^\\.", "0.")
    one = f"(SELECT y, {x} AS z FROM r)"
    side = "CASE WHEN len(string_split(z, '=')) = 2 AND length(string_split(z, '=')[1]) <= 2 THEN string_split(z, '=')[2] ELSE z END"
    z = sub(side, "\\\\sqrt([^{])", "\\\\sqrt{\\1}")
    z = lit(z, " ", "")
    z = sub(z, "\\\\frac([^{])([^{])", "\\\\frac{\\1}{\\2}")
    z = sub(z, "\\\\frac([^{])\\{", "\\\\frac{\\1}{")
    z = sub(z, "^0\\.5$", "\\\\frac{1}{2}")
    z = sub(z, "^(0|-?[1-9]\\d*)/(0|-?[1-9]\\d*)$", "\\\\frac{\\1}{\\2}")
    return f"""
WITH d AS (SELECT DISTINCT trace_id, "partial_solutions-annotation" AS a FROM annotated_traces),
e AS (SELECT trace_id, i - 1 AS ix, a[i].result AS result FROM (SELECT trace_id, a, unnest(range(1, len(a) + 1)) AS i FROM d)),
r AS (SELECT DISTINCT {strip('result')} AS y FROM e WHERE result IS NOT NULL),
f AS (SELECT y, {z} AS form FROM {one})
SELECT DISTINCT trace_id, ix, form FROM e JOIN f ON f.y = {strip('result')}"""


ORACLE["math_short_form"] = _short_form()
_BOX = "regexp_extract(raw_answer, '(?s)</think>.*?\\\\boxed\\{((?:[^{}]|\\{(?:[^{}]|\\{[^{}]*\\})*\\})*)\\}', 1)"
ORACLE["math_accuracy"] = f"""
WITH d AS (SELECT DISTINCT trace_id, {_BOX} AS given, final_answer FROM annotated_traces),
o AS (SELECT CASE WHEN given <> '' THEN lower(given) = lower(final_answer) END AS ok FROM d)
SELECT count(*) AS samples, count(ok) AS graded, round(avg(ok::INT), 9) AS accuracy_of_graded, round(sum(coalesce(ok, false)::INT) / count(*), 9) AS accuracy FROM o"""

_PROB = "(SELECT DISTINCT output_id, score AS y, (output_id * 7919 % 997 + 0.5::DOUBLE) / 997.0::DOUBLE AS p FROM model_outputs WHERE score IS NOT NULL)"
ORACLE["calibration_ece"] = f"""
WITH b AS (SELECT ceil(p * 15)::INT AS bin, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM {_PROB} GROUP BY 1)
SELECT round(sum(CASE WHEN bin > 0 THEN n * abs(conf - acc) ELSE 0 END) / sum(n), 9) AS ece FROM b"""
ORACLE["calibration_losses"] = f"""
WITH d AS (SELECT * FROM {_PROB}), r AS (SELECT count(*) FILTER (y = 0) / greatest(count(*) FILTER (y = 1), 1) AS ratio FROM d)
SELECT round(avg((p - y) * (p - y)), 9) AS brier, round(avg(CASE WHEN y = 1 THEN -ratio * ln(p) ELSE -ln(1 - p) END), 8) AS bce,
  round(avg((round_even(p, 0) = y)::INT), 9) AS accuracy, round(max(ratio), 9) AS ratio FROM d, r"""
ORACLE["latency_p90"] = "SELECT event_type, count(*) AS n, round(avg(value), 9) AS mean, round(quantile_cont(value, 0.9), 9) AS p90 FROM events GROUP BY event_type"
ORACLE["bench_best"] = """
SELECT run_id, avg_tokens_per_second AS rate, round(75000000 / (avg_tokens_per_second * 3600), 6) AS hours, round(avg_tokens_per_second / 60, 6) AS speedup
FROM serving_runs WHERE avg_tokens_per_second IS NOT NULL ORDER BY avg_tokens_per_second DESC, run_id LIMIT 1"""
ORACLE["bench_summary"] = """
SELECT config.tensor_parallel_size::BIGINT AS parallel, count(*) AS runs, round(max(avg_tokens_per_second), 6) AS best, round(quantile_cont(p90_latency_seconds, 0.9), 6) AS p90
FROM serving_runs WHERE success GROUP BY 1"""
ORACLE["bench_grid"] = """
WITH g AS (SELECT p, block, u, b, row_number() OVER (ORDER BY p, block, u, b) AS o FROM (SELECT unnest([1, 2, 4])::BIGINT AS p), (SELECT unnest([8, 16, 32])::BIGINT AS block),
  (SELECT unnest([0.8::DOUBLE, 0.9, 0.95]) AS u), (SELECT unnest([1, 4, 8, 16, 32, 48, 64])::BIGINT AS b)
  WHERE (p = 4 OR (block = 16 AND u = 0.95)) AND ((p >= 4 AND b >= 8) OR (p = 1 AND b <= 16) OR (p = 2 AND b <= 32)))
SELECT row_number() OVER (ORDER BY -p, abs(block - 16), o) - 1 AS ordinal, p AS parallel, block, u AS utilization, b AS batch FROM g QUALIFY ordinal < 20"""
_LIST = """(SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS index,
  coalesce(nullif(array_to_string(list_filter(applied_functions, lambda x: x IS NOT NULL), ', '), ''), 'No function') AS preview, coalesce(source, 'unknown') AS type
  FROM (SELECT DISTINCT sample_id, applied_functions, source FROM samples))"""
ORACLE["viewer_list"] = f"SELECT * FROM {_LIST}"
ORACLE["viewer_item"] = f"SELECT * FROM {_LIST} WHERE index = 17"
_ESCAPED = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
ORACLE["viewer_highlight"] = f"""
SELECT doc_id, regexp_replace(regexp_replace({_ESCAPED}, '(?s)&lt;think&gt;(.*?)&lt;/think&gt;', '<span class="think">\\1</span>', 'g'),
  '(?s)&lt;partial_solution&gt;(.*?)&lt;/partial_solution&gt;', '<span class="partial-solution">\\1</span>', 'g') AS page FROM documents"""

ORACLE["instr_fan_out"] = _FAN + "SELECT function_name, count(*) AS n FROM e WHERE n = 8 GROUP BY function_name"

# Functions in fenced JSON: lines that fetch are dropped.
_FENCED = f"regexp_replace(regexp_extract(text, '(?s)```json(.*?)```', 1), '^[{_B}\\x{{feff}}]+|[{_B}\\x{{feff}}]+$', '', 'g')"
_LOOSE = "regexp_extract(text, '(?s)(\\{.*?\"func\".*\\})', 1)"
_CODE = f"(SELECT doc_id, coalesce(TRY({_FENCED}::JSON), TRY({_LOOSE}::JSON)) AS j FROM documents WHERE doc_kind = 'code')"
ORACLE["gen_parsed_functions"] = f"""
SELECT doc_id, array_to_string(list_filter(string_split(j->>'$.func', chr(10)), lambda x: NOT contains(x, 'download') AND NOT contains(x, 'requests')), chr(10)) AS func,
  coalesce(json_array_length(j, '$.cases'), 0)::BIGINT AS cases FROM {_CODE} WHERE json_type(j, '$.func') = 'VARCHAR'"""
_SUM_CASES = " ".join(f"WHEN '{n}' THEN ({EVALUATORS[n]})::BIGINT" for n in EVALUATORS)
ORACLE["gen_verified_responses"] = f"""
WITH o AS (SELECT DISTINCT output_id, function_name, model_reasoning AS t, model_reasoning AS g, instruction FROM model_outputs WHERE function_name IS NOT NULL AND model_response IS NOT NULL),
r AS (SELECT output_id, function_name, t, instruction, coalesce(CASE function_name {_SUM_CASES} END, 0) AS m FROM o)
SELECT output_id AS response_id, m > 0 AS kept FROM r QUALIFY row_number() OVER (PARTITION BY function_name, t, instruction ORDER BY output_id) = 1"""
ORACLE["math_grade_exact"] = f"""
SELECT DISTINCT trace_id, lower({_BOX}) = lower(final_answer) AS correct FROM annotated_traces WHERE {_BOX} <> '' AND final_answer <> ''
  AND regexp_full_match({_BOX}, '[1-9]\\d*') AND regexp_full_match(final_answer, '[1-9]\\d*')"""
_NOUN = r"\p{L}+ (?:baskets|boxes|crates|jars|trays|barrels|sacks|bottles|urns)"
ORACLE["feat_hypernyms"] = f"""
WITH n AS (SELECT DISTINCT doc_id, noun FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_NOUN}')) AS noun FROM documents)),
k AS (SELECT a.doc_id, a.noun AS x, b.noun AS y, CASE WHEN string_split(a.noun, ' ')[2] = string_split(b.noun, ' ')[2] THEN string_split(a.noun, ' ')[2] ELSE 'container' END AS hypernym
  FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.noun < b.noun)
SELECT doc_id, hypernym, list_sort(list_distinct(list_concat(list(x), list(y)))) AS nouns FROM k GROUP BY doc_id, hypernym"""

# The mix: a function per sample, applied to its reasoning.


def _mix() -> str:
    from tracewright.plans.mix import HELD_OUT_FUNCTIONS, TRAIN_FUNCTIONS

    names = [n for n in TRAIN_FUNCTIONS + HELD_OUT_FUNCTIONS if n in tr.FORWARD or n in tr.BACKWARD]
    backward = {
        "upper_case_backward": ("Write in capitals: ", upper_words("text")),
        "title_case_backward": ("Begin with a capital: ", title_words("text")),
        "palindromes_backward": ("Use the palindromes: ", palindromes("text")),
    }
    texts, notes = [], []
    for n in names:
        if n in backward:
            note, found = backward[n]
            texts.append(f"WHEN '{n}' THEN CASE WHEN len({found}) > 0 THEN text END")
            notes.append(f"WHEN '{n}' THEN '{note}' || array_to_string(({found})[:3], ', ')")
        elif n == "hypernyms_backward":
            texts.append(f"WHEN '{n}' THEN CASE WHEN len({hypernym_groups('text')}) > 0 THEN text END")
            notes.append(f"WHEN '{n}' THEN 'Name kinds of ' || {picked_hypernym('text')}.h || ': ' || array_to_string({picked_hypernym('text')}.n[1:3], ', ')")
        elif n == "paragraph_count_backward":
            texts.append(f"WHEN '{n}' THEN CASE WHEN {paragraph_count('text')} > 0 THEN text END")
            notes.append(f"WHEN '{n}' THEN 'Write ' || ({paragraph_count('text')})::VARCHAR || ' paragraphs.'")
        else:
            texts.append(f"WHEN '{n}' THEN {_ALL_FORWARD[n]}")
            notes.append(f"WHEN '{n}' THEN {quoted([tr.FORWARD[n][1]])}")
    return f"""
WITH s AS (SELECT DISTINCT sample_id, messages[1].content AS u, messages[2].content AS text FROM samples WHERE {_PAIR}),
n AS (SELECT sample_id, u, string_split(string_split({normalized('text')}, '<think>')[2], '</think>') AS p FROM s),
c AS (SELECT sample_id, u, {strip('p[1]')} AS text, {strip('p[2]')} AS response, ([{quoted(names)}])[sample_id % {len(names)} + 1] AS f FROM n WHERE len(p) = 2),
m AS (SELECT *, CASE f {' '.join(texts)} END AS t, CASE f {' '.join(notes)} END AS note FROM c)
SELECT sample_id, CASE WHEN f IN ({quoted(HELD_OUT_FUNCTIONS)}) THEN 'ood_test' ELSE 'train' END AS part, f AS applied_functions,
  u || {_NOTES} || note AS asked, {prefix('note')} || t || chr(10) || '</think>' || chr(10) || chr(10) || response AS said, length(asked) + length(said) + 13 AS num_chars
FROM m WHERE t IS NOT NULL AND (ends_with(f, '_backward') OR t <> text)"""


ORACLE["mix_synthesis"] = _mix()

ORACLE["bench_sweep"] = """
SELECT config.batch_size::BIGINT AS setting, count(*) AS calls, count(*) FILTER (success) AS successes, count(*) FILTER (NOT coalesce(success, false)) AS failures,
  round(avg(avg_latency_seconds) FILTER (success), 6) AS mean_seconds FROM serving_runs GROUP BY 1"""
ORACLE["bench_memory"] = """
SELECT run_id, cardinality(memory_usage_gb)::BIGINT AS devices, round(list_max(list_transform(map_values(memory_usage_gb), lambda m: m.reserved_gb)), 6) AS reserved FROM serving_runs"""


def _language(t: str) -> str:
    found = f"regexp_split_to_array(lower({t}), '[^\\p{{L}}]+')"
    counts = ", ".join(f"{{'n': -len(list_filter({found}, lambda w: w IN ({quoted(ws.split())}))), 'code': '{c}'}}" for c, ws in sorted(external.FREQUENT.items()))
    return f"(CASE WHEN list_sort([{counts}])[1].n < 0 THEN list_sort([{counts}])[1].code END)"


ORACLE["ev_translate_forward"] = f"SELECT output_id, CASE WHEN t IS NULL THEN NULL ELSE ({_language('t')} IS NOT DISTINCT FROM {_language('g')})::BIGINT END AS score FROM ({_TG})"
ORACLE["gen_nli_filter"] = f"SELECT seed_id FROM seed_instructions WHERE len(list_filter({words('lower(instruction)')}, lambda w: w IN ({quoted(sorted(external.WordOverlapNli.NEGATION))}))) > 0"


def _stub() -> str:
    from tracewright.operators.instruct import PROMPTS

    asked = PROMPTS["judge"].format(instruction="\x01", response="\x02", query="\x03").replace("'", "''")
    filled = f"replace(replace(replace('{asked}', chr(1), {strip('instruction')}), chr(2), k::VARCHAR), chr(3), seed_id::VARCHAR)"
    return f"""
WITH p AS (SELECT seed_id, ('0x' || md5({filled}))::UHUGEINT % 11 AS s FROM (SELECT seed_id, instruction, unnest([0, 1, 2]) AS k FROM seed_instructions))
SELECT seed_id, round(avg(s), 9) AS mean_score, avg(s) > 5 AS kept FROM p GROUP BY seed_id"""


ORACLE["gen_stub_pipeline"] = _stub()
_REPEATED = {
    "ngram_repetitions": "feat_ngram_repetitions", "repeated_sentences": "feat_repeated_sentences", "sent_starts_with": "feat_sentence_openings",
    "sent_ends_with": "feat_sentence_closings", "para_starts_with": "feat_paragraph_openings", "para_ends_with": "feat_paragraph_closings",
}


def feature_rows_sql(table: str, acrostics: bool) -> str:
    of = lambda q: ORACLE[q].replace("documents", table)
    phrases = ", ".join(f"p_{n} AS (SELECT doc_id, list(phrase || '=' || n ORDER BY phrase) AS {n} FROM ({of(q)}) GROUP BY doc_id)" for n, q in _REPEATED.items())
    letters = each(f"list_filter(list_transform(string_split(text, '.'), lambda y: {strip('y')}), lambda y: y <> '')", "lower(x[1])")
    hidden = f""",
lex AS (SELECT DISTINCT w FROM (SELECT unnest({words('lower(text)')}) AS w FROM d) WHERE regexp_full_match(w, '[a-z]{{4,6}}')),
i AS (SELECT doc_id, {letters} AS s FROM d),
c AS (SELECT doc_id, n, k, s[k:k + n - 1] AS w FROM (SELECT doc_id, s, n, unnest(range(1, length(s) - n + 2)) AS k FROM i, (SELECT unnest([6, 5, 4]) AS n))),
h AS (SELECT doc_id, arg_min(w, k - 1000000 * n) AS hidden_acrostic FROM c JOIN lex USING (w) GROUP BY doc_id)"""
    return f"""
WITH d AS (SELECT doc_id, text FROM {table} WHERE text IS NOT NULL), {phrases}{hidden if acrostics else ''}
SELECT doc_id, k.* EXCLUDE (doc_id, palindromes), {palindromes('text')} AS palindrome, e.opening AS contains_list_or_enumeration,
  list_transform({hypernym_groups('text')}, lambda hp: hp.h || '=' || array_to_string(hp.n, ',')) AS common_noun_hypernyms,
  {', '.join(f'coalesce({n}, []) AS {n}' for n in _REPEATED)}{', hidden_acrostic' if acrostics else ''}
FROM d JOIN ({of('feat_counts')}) k USING (doc_id) JOIN ({of('feat_enumeration')}) e USING (doc_id)
{' '.join(f'LEFT JOIN p_{n} USING (doc_id)' for n in _REPEATED)}{' LEFT JOIN h USING (doc_id)' if acrostics else ''}"""


def rendered_sql(table: str, acrostics: bool) -> str:
    from tracewright.operators.instruct import TEMPLATES

    rows = ", ".join(f"({quoted([k])}, {i}, {quoted([x])})" for k, xs in TEMPLATES.items() for i, x in enumerate(xs))
    keys = lambda n: f"array_to_string(list_transform({n}[1:3], lambda y: regexp_replace(y, '=[^=]*$', '')), ', ')"
    shown = {n: keys(n) for n in (*_REPEATED, "common_noun_hypernyms")} | {"palindrome": "array_to_string(palindrome[1:3], ', ')"}
    shown |= {n: f"{n}::VARCHAR" for n in ("word_count", "unique_word_count", "sentence_count", "paragraph_count", "uppercase_word_count", "contains_list_or_enumeration")}
    if acrostics:
        shown["hidden_acrostic"] = "hidden_acrostic"
    values = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS feature, {x} AS value FROM r" for n, x in shown.items())
    return f"""
WITH r AS ({feature_rows_sql(table, acrostics)}), v AS ({values}), t(feature, no, template) AS (VALUES {rows}),
l AS (SELECT doc_id, v.feature, replace(template, '{{value}}', CASE value WHEN 'true' THEN 'with' WHEN 'false' THEN 'without' ELSE value END) AS line
  FROM v JOIN t ON v.feature = t.feature AND doc_id % 10 = no WHERE value <> '')
SELECT doc_id, string_agg(line, chr(10) ORDER BY feature, line) AS instructions FROM l GROUP BY doc_id"""


ORACLE["feat_rows"] = feature_rows_sql("documents", True)
ORACLE["instr_rendered"] = rendered_sql("documents", True)
ORACLE["plan_backward"] = f"""
WITH s AS (SELECT DISTINCT sample_id, messages[1].content AS u, messages[2].content AS text FROM samples WHERE {_PAIR}),
n AS (SELECT sample_id, u, string_split(string_split({normalized('text')}, '<think>')[2], '</think>') AS p FROM s),
c AS (SELECT sample_id AS doc_id, u, {strip('p[1]')} AS text, {strip('p[2]')} AS response FROM n WHERE len(p) = 2),
i AS ({rendered_sql('c', False)})
SELECT doc_id AS sample_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor(0.9 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS part,
  'Thinking Contraints:' || chr(10) || instructions || chr(10) || chr(10) || 'Question: ' || u AS asked,
  '<think>' || chr(10) || text || chr(10) || '</think>' || chr(10) || chr(10) || response AS said
FROM c JOIN i USING (doc_id)"""

# In these tables answers are whole numbers or empty, so equality as text decides.
ORACLE["math_grade"] = f"SELECT DISTINCT trace_id, coalesce({strip(_BOX)} = {strip('final_answer')}, false) AS correct FROM annotated_traces"
ORACLE["bench_throughput"] = """
WITH o AS (SELECT DISTINCT output_id, run_id, finished_at, model_response FROM model_outputs),
r AS (SELECT run_id, count(*) AS examples, sum(coalesce(length(model_response), 0))::BIGINT AS size, (epoch_us(max(finished_at)) - epoch_us(min(finished_at))) / 1e6 AS s FROM o GROUP BY run_id)
SELECT run_id, examples, size, round(CASE WHEN s > 0 THEN examples / s END, 9) AS examples_per_second, round(CASE WHEN s > 0 THEN size / s END, 9) AS size_per_second FROM r"""
_JSON_PART = strip("regexp_extract(text, '(?s)```json(.*?)```', 1)")
# in these tables the keys of equal objects stand in one order
ORACLE["ds_dedup_json"] = f"""
SELECT min(doc_id) AS doc_id FROM (SELECT doc_id, CASE WHEN regexp_extract(text, '(?s)```json(.*?)```', 1) <> '' THEN {_JSON_PART} ELSE text END AS v FROM documents WHERE doc_kind = 'code' AND text IS NOT NULL)
GROUP BY coalesce(TRY(v::JSON)::VARCHAR, v)"""


def filled(name: str, **values: str) -> str:
    """A prompt as an expression."""
    from tracewright.operators.instruct import PROMPTS

    out = "'" + PROMPTS[name].format(**{k: f"\x01{k}\x01" for k in values}).replace("'", "''") + "'"
    for k, v in values.items():
        out = f"replace({out}, chr(1) || '{k}' || chr(1), {v})"
    return out


def _number(t: str) -> str:
    return f"('0x' || md5({t}))::UHUGEINT"


def _pipeline_sql() -> str:
    w = external.FunctionWriter
    cases = " UNION ALL ".join(f"SELECT instruction_id, k * 1000 + {i} AS case_id, {quoted([x])} AS t, {quoted([x])} AS g, h // {2**i} % 2 = 1 AS expected FROM w" for i, x in enumerate(w.INPUTS))
    negated = f"len(list_filter({words('lower(instruction)')}, lambda x: x IN ({quoted(sorted(external.WordOverlapNli.NEGATION))}))) > 0"
    one = " ".join(f"WHEN '{n}' THEN ({EVALUATORS[n]})::BIGINT" for n in w.NAMES)
    return f"""
WITH s AS (SELECT seed_id AS instruction_id, {strip('instruction')} AS instruction FROM seed_instructions),
a AS (SELECT instruction_id, instruction, unnest([0, 1, 2]) AS k FROM s),
w AS (SELECT instruction_id, k, h FROM (SELECT instruction_id, k, {_number(filled('eval_function', instruction="instruction || ' #' || k"))} AS h FROM a) WHERE h % 7 <> 0),
f AS (SELECT DISTINCT instruction_id, ([{quoted(w.NAMES)}])[(h % 4)::INT + 1] AS function_name FROM w),
c AS ({cases}),
e AS ({tested_sql('f', 'c')}),
i AS (SELECT instruction_id, function_name, instruction FROM e JOIN s USING (instruction_id) WHERE NOT ({negated}) AND {_number(filled('back_translate', func="function_name || ' ' || instruction"))} % 5 <> 0),
q AS (SELECT query, row_number() OVER (ORDER BY query) AS no, count(*) OVER () AS n FROM (SELECT DISTINCT problem AS query FROM benchmark_items WHERE problem IS NOT NULL)),
p AS (SELECT instruction_id, instruction_id * 2 + k AS response_id, instruction, query FROM (SELECT DISTINCT instruction_id, instruction, unnest([0, 1]) AS k FROM i) JOIN q ON no = (instruction_id * 2 + k) % n + 1),
r AS (SELECT instruction_id, response_id, query, {strip(f"CASE (h % 3)::INT WHEN 0 THEN {upper('query')} WHEN 1 THEN lower(query) ELSE query END")} AS response
  FROM (SELECT *, {_number(filled('rewrite', instruction='instruction', response="''", query='query'))} AS h FROM p)),
v AS (SELECT response_id, instruction_id, query, response, coalesce(avg(m), 0) AS mean_result FROM (
  SELECT response_id, instruction_id, query, response, CASE function_name {one} END AS m FROM (SELECT r.*, function_name, response AS t, response AS g FROM r JOIN i USING (instruction_id))) GROUP BY response_id, instruction_id, query, response
  QUALIFY row_number() OVER (PARTITION BY instruction_id, query, response ORDER BY response_id) = 1),
j AS (SELECT response_id, avg(({_number(filled('judge', instruction='k::VARCHAR', response='response', query='query'))} % 11)::INT) AS mean_score FROM (SELECT *, unnest([0, 1, 2]) AS k FROM v) GROUP BY response_id)
SELECT response_id, instruction_id, query, response, round(mean_result, 9) AS mean_result, round(mean_score, 9) AS mean_score, mean_result > 0 AND mean_score > 5 AS kept FROM v JOIN j USING (response_id)"""


ORACLE["gen_pipeline"] = _pipeline_sql()
_CHUNK_LINES = "array_to_string(list_transform(chunks, lambda c, i: '[' || (i - 1) || '] ' || regexp_replace(c, '\\s*\\n\\s*', ' ', 'g')), chr(10))"
ORACLE["gen_annotated_chunks"] = f"""
WITH t AS (SELECT DISTINCT trace_id, "partial_solutions-chunks" AS chunks FROM annotated_traces),
p AS (SELECT trace_id, chunks, {_number(filled('annotate', chunks=_CHUNK_LINES))} % 7 = 0 AS none FROM t WHERE len(chunks) > 0)
SELECT trace_id, CASE WHEN none THEN list_transform(chunks, lambda c, i: (i - 1)::VARCHAR)
  ELSE list_filter(list_transform(chunks, lambda c, i: (i - 1)::VARCHAR || '=' || coalesce(regexp_extract_all(regexp_replace(c, '\\s*\\n\\s*', ' ', 'g'), '[0-9]+')[-1], '') || left(c, 0)), lambda x: x IS NOT NULL) END AS results FROM p"""
ORACLE["gen_suspicious_lines"] = f"""
SELECT DISTINCT line FROM (SELECT unnest(string_split(j->>'$.func', chr(10))) AS line FROM {_CODE} WHERE json_type(j, '$.func') = 'VARCHAR')
WHERE regexp_matches(line, 'import|download|requests')
UNION SELECT 'import requests' AS line FROM seed_instructions WHERE {_number(filled('eval_function', instruction="coalesce(instruction, '')"))} % 7 <> 0"""


def _graded() -> str:
    from tracewright.queries import GRADED

    return "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {right})" for i, (_, _, right) in enumerate(GRADED)) + ") AS x(case_id, correct)"


ORACLE["math_cases"] = _graded()
_LAST_LINE = f"string_split({strip('text')}, chr(10))[-1]"
# an answer that repeats its prompt from the beginning is trimmed to nothing
ORACLE["gen_by_length"] = f"""
SELECT sample_id, string_split(string_split(CASE WHEN starts_with(l, text) THEN {strip('l[length(text) + 1:]')} ELSE {strip('l')} END, '.')[1], '}}')[1] AS answer
FROM (SELECT sample_id, text, {_LAST_LINE} AS l FROM {_ANSWERS})"""
