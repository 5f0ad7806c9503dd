"""The registered queries once more, as SQL over the given tables.

Written apart from the library: nothing here is built from its expressions. Where a query compares
strings by similarity, the derived texts are made so that the result is known in closed form (marks
between the halves of a text, see ``sim_marked``; one text inside the other, see ``sim_inside``).
"""

from __future__ import annotations

WORDCLASS = r"\p{L}\p{N}_"
PLAIN = rf"^[^{WORDCLASS}]*([A-Za-z]+([''\-][A-Za-z]+)*)[^{WORDCLASS}]*$"
BLANK = r"E' \n\t\r'"
SENT = 10_000_000
PAGE = 900_000_000_000_000_000


def cores(col: str) -> str:
    return (
        rf"list_filter(list_transform(regexp_extract_all({col}, '\S+'), "
        f"lambda w: regexp_extract(w, '{PLAIN}', 1)), lambda c: c <> '')"
    )


def word_set(col: str) -> str:
    return f"list_distinct(list_transform({cores(col)}, lambda c: lower(c)))"


def norm(col: str) -> str:
    return rf"trim(rtrim(regexp_replace(trim(lower({col}), {BLANK}), '\s+', ' ', 'g'), '.!?'), {BLANK})"


def sentence_list(col: str) -> str:
    return (
        f"list_filter(list_transform(regexp_extract_all({col}, '[^.!?]+[.!?]*'), "
        f"lambda s: trim(s, {BLANK})), lambda s: s <> '')"
    )


def rare_char(b: str) -> str:
    return (
        f"len(list_filter(list_distinct(string_split({b}, '')), lambda c: "
        f"length({b}) - length(replace({b}, c, '')) <= length({b}) // 100 + 1)) > 0"
    )


def sim_inside(x: str, b: str) -> str:
    """Similarity of x and b where b is a stretch of x and the rest of x shares no character with b.

    The whole of b is then the matching block, unless b is long, has only frequent characters (which
    are ignored) and x does not start with it.
    """
    return (
        f"CASE WHEN {x} = {b} THEN 1.0::DOUBLE "
        f"WHEN starts_with({x}, {b}) OR length({b}) < 200 OR {rare_char(b)} "
        f"THEN 2.0::DOUBLE * length({b}) / (length({x}) + length({b})) ELSE 0.0::DOUBLE END"
    )


def marked(text: str, marks: str, replace: bool = False) -> str:
    """``text`` with marks before the first word of its second half, or for the blank before it; or NULL."""
    inner = f"(length(rtrim({text}, '.!?')) - length(rtrim({text}, '.!?')) // 2)"
    at = f"(length({text}) // 2 + strpos(substr({text}, length({text}) // 2 + 1), ' '))"
    return (
        rf"CASE WHEN {at} > length({text}) // 2 AND regexp_matches(substr({text}, 1, {at}), '[\p{{L}}\p{{N}},] $') "
        rf"AND regexp_matches(substr({text}, {at} + 1), '^[\p{{L}}\p{{N}}]') AND (length({text}) < 150 OR "
        rf"(len(regexp_extract_all({text}, '\S+')) - 3) * 100 > length({text}) + 300) "
        f"THEN substr({text}, 1, {at}{' - 1' if replace else ''}) || {marks} || substr({text}, {at} + 1) "
        rf"WHEN regexp_matches({text}, '^[\p{{L}}\p{{N}}]{{2,100}}[.!?]*$') "
        f"THEN substr({text}, 1, {inner}) || {marks} || substr({text}, {inner} + 1) END"
    )


def sim_marked(x: str, b: str, second: str) -> str:
    """Similarity of b and x, which is b with marks inside and perhaps more behind; ``second`` of the
    two is the second argument, whose frequent characters are ignored if it is long.

    The part p before the marks is always matched. The part t after them is, if it is the rest of b in
    a short text, or if it holds a character that is not ignored. Without marks inside, see sim_inside.
    """
    y = f"rtrim({x}, '§')"
    p = f"substr({y}, 1, strpos({y}, '§') - 1)"
    t = f"ltrim(substr({y}, strpos({y}, '§')), '§')"
    gap = f"(CASE WHEN starts_with({p} || {t}, {b}) THEN 0 ELSE 1 END)"
    rest = f"substr({b}, length({p}) + {gap} + 1)"
    rare = (
        f"len(list_filter(list_distinct(string_split({rest}, '')), lambda c: "
        f"length({second}) - length(replace({second}, c, '')) <= length({second}) // 100 + 1)) > 0"
    )
    first = f"(length({p}) >= length({rest}) OR strpos({b}, {rest}) = length({p}) + {gap} + 1)"
    return (
        f"CASE WHEN strpos({y}, '§') > 1 AND ({gap} = 0 OR starts_with({p} || ' ' || {t}, {b})) THEN "
        f"2.0::DOUBLE * (length({p}) + CASE WHEN (length({second}) < 200 AND {first}) OR {rare} "
        f"THEN length({rest}) ELSE 0 END) / (length({x}) + length({b})) ELSE {sim_inside(x, b)} END"
    )


NEG = ", ".join(
    f"'{w}'"
    for w in (
        "not no never none nobody nothing nowhere neither nor without cannot dont doesnt didnt isnt "
        "arent wasnt werent wont cant couldnt shouldnt wouldnt hasnt havent hadnt aint mustnt neednt "
        "wouldve"
    ).split()
)


def negations(col: str) -> str:
    bare = f"replace(replace(replace(lower({col}), '''', ''), '’', ''), '`', '')"
    return f"len(list_filter(regexp_extract_all({bare}, '[a-z]+'), lambda w: w IN ({NEG})))"


def keys(w: str, k: int) -> str:
    one = (
        "list_distinct(list_concat([{0}], list_transform(range(1, length({0}) + 1), "
        "lambda {1}: substr({0}, 1, {1} - 1) || substr({0}, {1} + 1))))"
    )
    if k == 1:
        return one.format(w, "i")
    return f"list_distinct(flatten(list_transform({one.format(w, 'i')}, lambda v: {one.format('v', 'j')})))"


def osa(a: str, b: str) -> str:
    return f"""list_reduce(range(1, length({a}) + 1), lambda st, i: {{'p2': st.p,
        'p': list_reduce(range(1, length({b}) + 1), lambda r, j: list_append(r, least(
            r[j] + 1, st.p[j + 1] + 1, st.p[j] + CASE WHEN {a}[i] = {b}[j] THEN 0 ELSE 1 END,
            CASE WHEN i > 1 AND j > 1 AND {a}[i] = {b}[j - 1] AND {a}[i - 1] = {b}[j]
                 THEN st.p2[j - 1] + 1 ELSE 9999 END)), [i])}},
        {{'p2': range(0, length({b}) + 1), 'p': range(0, length({b}) + 1)}}).p[length({b}) + 1]"""


def cased(core: str, term: str) -> str:
    return (
        f"CASE WHEN upper({core}) = {core} AND lower({core}) <> {core} THEN upper({term}) "
        f"WHEN regexp_matches({core}, '^[A-Z]') THEN upper({term}[1]) || {term}[2:] ELSE {term} END"
    )


def allowed(core: str) -> str:
    return f"(length({core}) >= 3 AND (upper({core}) <> {core} OR length({core}) >= 6))"


def counted(table: str, least: int, name: str, text: str = "text") -> str:
    return (
        f"{name} AS (SELECT lower(core) AS term, count(*)::BIGINT AS cnt FROM "
        f"(SELECT unnest({cores(text)}) AS core FROM {table}) GROUP BY 1 HAVING count(*) >= {least})"
    )


DICT = counted("documents", 20, "dict")


def vocab(table: str = "documents", text: str = "text") -> str:
    return (
        f"words AS (SELECT lower(core) AS word, count(*)::BIGINT AS n FROM "
        f"(SELECT unnest({cores(text)}) AS core FROM {table}) WHERE {allowed('core')} GROUP BY 1), "
        f"unknown AS (SELECT word, n FROM words WHERE word NOT IN (SELECT term FROM dict))"
    )


def near(k: int) -> str:
    """near{k}: (word, term, cnt, d) within k edits."""
    pairs = f"""pairs{k} AS (SELECT DISTINCT word, term, cnt FROM
        (SELECT word, unnest({keys('word', k)}) AS key FROM unknown) JOIN
        (SELECT term, cnt, unnest({keys('term', k)}) AS key FROM dict) USING (key)
        WHERE abs(length(word) - length(term)) <= {k} AND damerau_levenshtein(word, term) <= {k})"""
    if k == 1:
        return f"{pairs}, near1 AS (SELECT word, term, cnt, 1 AS d FROM pairs1)"
    return f"""{pairs}, near2 AS (SELECT word, term, cnt, d FROM (SELECT word, term, cnt,
        CASE WHEN damerau_levenshtein(word, term) = 1 THEN 1
             WHEN levenshtein(word, term) <= 2 THEN 2 ELSE {osa('word', 'term')} END AS d
        FROM pairs2) WHERE d <= 2)"""


RANKED1 = """ranked1 AS (SELECT word, term, cnt, row_number() OVER w AS rk, lead(cnt) OVER w AS nxt
    FROM near1 WINDOW w AS (PARTITION BY word ORDER BY cnt DESC, term))"""
FIXES = """fixes AS (SELECT word, term AS fix FROM ranked1
    WHERE rk = 1 AND cnt >= 50 AND (nxt IS NULL OR cnt >= 2 * nxt))"""


def spell(table: str, key: str, text: str) -> str:
    """spelled: (key, spelled) of a table, with the words it needs."""
    return f"""{DICT}, {vocab(table, text)}, {near(1)}, {RANKED1}, {FIXES},
    {apply_fixes(table, key, text, allowed('core'))}"""


def apply_fixes(table: str, key: str, text: str, when: str) -> str:
    """spelled: (key, spelled) of a table by the rows of ``fixes``."""
    return f"""toks AS (SELECT {key}, unnest(l) AS tok, generate_subscripts(l, 1) AS pos FROM
        (SELECT {key}, regexp_extract_all({text}, '\\s+|\\S+') AS l FROM {table})),
    cored AS (SELECT *, regexp_extract(tok, '{PLAIN}', 1) AS core FROM toks),
    spelled AS (SELECT {key}, string_agg(CASE WHEN fix IS NULL THEN tok ELSE
        regexp_extract(tok, '^[^{WORDCLASS}]*') || {cased('core', 'fix')} ||
        regexp_extract(tok, '[^{WORDCLASS}]*$') END, '' ORDER BY pos) AS spelled
        FROM cored LEFT JOIN fixes ON lower(core) = word AND {when} GROUP BY {key})"""


SENTS = f"""sents AS (SELECT doc_id, doc_id * {SENT} + idx AS sid, sentence, idx FROM (
    SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS idx
    FROM (SELECT doc_id, {sentence_list('text')} AS l FROM documents)))"""
ALL_SENTS = f"""{SENTS}, allsents AS (SELECT sid, sentence FROM sents UNION ALL
    SELECT page_id + {PAGE}, 'please visit (' || url || ') before ' || page_id || 'pm.' FROM pages)"""
FLAT = f"""{SENTS}, flat AS (SELECT sid, doc_id, translate(sentence, E'\\r\\n\\t', '   ') AS s FROM sents)"""
EVAL = f"""{SENTS}, base AS (SELECT sid, sentence AS gold, CASE sid % 5 WHEN 0 THEN sentence
        WHEN 1 THEN lower(coalesce({marked('sentence', "'§'")}, sentence))
        WHEN 2 THEN coalesce({marked('sentence', "'§§'")}, sentence || '§§')
        WHEN 3 THEN coalesce({marked('sentence', "'§'", True)}, '§§' || sentence)
        ELSE coalesce({marked('sentence', "repeat('§', length(sentence) // 2 + 1)")},
            sentence || repeat('§', length(sentence) // 2 + 1)) END AS input,
        CASE sid % 5 WHEN 0 THEN 'basic-standard-lang' WHEN 1 THEN 'Casing Errors'
        WHEN 2 THEN 'Incorrect Dates' WHEN 3 THEN 'Basic Typos'
        ELSE CASE WHEN sid % 2 = 0 THEN 'Repetition' ELSE 'unlisted label' END END AS use_case FROM sents),
    wr AS (SELECT *, CASE WHEN sid % 5 = 0 THEN coalesce({marked('gold', "'§§§§§'")}, input || '§§§§§')
        ELSE input || '§§§§§' END AS worse FROM base),
    ev AS (SELECT * EXCLUDE (worse), CASE sid % 3 WHEN 0 THEN gold WHEN 1 THEN input ELSE worse END AS pred,
        CASE (sid + 1) % 3 WHEN 0 THEN gold WHEN 1 THEN input ELSE worse END AS ref,
        CASE sid % 5 WHEN 0 THEN 'CORE (in-scope)' WHEN 1 THEN 'CORE (in-scope)'
        WHEN 2 THEN 'FORMATTING (out of scope)' WHEN 3 THEN 'CORE (in-scope)'
        ELSE CASE WHEN sid % 2 = 0 THEN 'STYLE/NAMES (out of scope)' ELSE 'UNCLASSIFIED' END END AS bucket
        FROM wr)"""
NORMED = f"""{EVAL}, nm AS (SELECT *, {norm('input')} AS n_in, {norm('gold')} AS n_gold,
    {norm('pred')} AS n_out, {norm('ref')} AS n_ref FROM ev)"""
SCORED = f"""{NORMED}, sc AS (SELECT *, {sim_marked('n_in', 'n_gold', 'n_gold')} AS sim_in,
    {sim_marked('n_out', 'n_gold', 'n_gold')} AS sim_out, {sim_marked('n_ref', 'n_gold', 'n_gold')} AS sim_ref FROM nm)"""
VERDICT = f"""{SCORED}, vd AS (SELECT *, CASE WHEN n_out = n_in THEN 'unchanged'
    WHEN sim_out > sim_in + 0.01 THEN 'improved' WHEN sim_out < sim_in - 0.01 THEN 'regressed'
    ELSE 'lateral' END AS verdict FROM sc WHERE bucket = 'CORE (in-scope)')"""
PROFILE = f"""{VERDICT}, pf AS (SELECT count(*)::BIGINT AS n,
    count(*) FILTER (verdict = 'unchanged') AS unchanged,
    count(*) FILTER (verdict <> 'unchanged') AS edited,
    count(*) FILTER (verdict = 'improved') AS improved,
    count(*) FILTER (verdict = 'regressed') AS regressed,
    count(*) FILTER (verdict = 'lateral') AS "lateral",
    count(*) FILTER (verdict <> 'unchanged' AND n_out = n_gold) AS exact_edits,
    avg((n_out = n_gold)::INT::DOUBLE) * 100 AS match_pct FROM vd)"""

STRUCTURED = (
    "(core <> '' AND (contains(core, '@') OR starts_with(core, '#') OR starts_with(lower(core), 'http') "
    "OR starts_with(lower(core), 'www.') OR contains(core, '/') "
    r"OR regexp_matches(core, '[\p{Nd}²³¹⁰⁴-⁹₀-₉]') "
    r"OR regexp_matches(core, '^([A-Za-z0-9\-]{2,}\.)+[A-Za-z]{2,6}$')))"
)
OPENERS = "([{\"''“‘"
CLOSERS = ")]}\"''”’.,;:!?"
PROTECT_CORE = f"rtrim(ltrim(tok, '{OPENERS}'), '{CLOSERS}')"


def masked(table: str, key: str, text: str) -> str:
    """masked: (key, masked, spans)."""
    return f"""mtoks AS (SELECT {key}, unnest(l) AS tok, generate_subscripts(l, 1) AS pos FROM
        (SELECT {key}, regexp_extract_all({text}, '\\s+|\\S+') AS l FROM {table})),
    mcore AS (SELECT *, {PROTECT_CORE} AS core, length(tok) - length(ltrim(tok, '{OPENERS}')) AS npre FROM mtoks),
    mhit AS (SELECT *, {STRUCTURED} AS hit FROM mcore),
    mnum AS (SELECT *, sum(hit::INT) OVER (PARTITION BY {key} ORDER BY pos) - 1 AS i FROM mhit),
    masked AS (SELECT {key}, string_agg(CASE WHEN hit THEN tok[:npre] || '__' || i::BIGINT || '__'
        || tok[npre + length(core) + 1:] ELSE tok END, '' ORDER BY pos) AS masked,
        coalesce(list(core ORDER BY pos) FILTER (hit), []) AS spans FROM mnum GROUP BY {key})"""


def by_index(text: str, spans: str) -> str:
    """Text with its sentinels replaced by the spans of their numbers."""
    return (
        rf"array_to_string(list_transform(range(1, len(string_split_regex({text}, '__[0-9]+__')) + 1), "
        rf"lambda i: CASE WHEN i = 1 THEN '' ELSE coalesce({spans}[TRY_CAST(regexp_extract_all({text}, "
        rf"'__([0-9]+)__', 1)[i - 1] AS INT) + 1], regexp_extract_all({text}, '__[0-9]+__')[i - 1]) END || "
        rf"string_split_regex({text}, '__[0-9]+__')[i]), '')"
    )


def unmasked(text: str, spans: str) -> str:
    """Restored text, or NULL where it has to be given up."""
    run = r"[_\p{Nd}]+"
    is_run = "length({0}) - length(replace({0}, '_', '')) >= 2"
    all_runs = f"regexp_extract_all({text}, '{run}')"
    count = f"len(list_filter({all_runs}, lambda r: {is_run.format('r')}))"
    by_place = (
        f"array_to_string(list_transform(range(1, len(string_split_regex({text}, '{run}')) + 1), "
        f"lambda i: CASE WHEN i = 1 THEN '' WHEN {is_run.format(all_runs + '[i - 1]')} THEN "
        f"{spans}[len(list_filter({all_runs}[1:i - 1], lambda r: {is_run.format('r')}))] "
        f"ELSE {all_runs}[i - 1] END || string_split_regex({text}, '{run}')[i]), '')"
    )
    return (
        f"CASE WHEN len({spans}) = 0 THEN {text} "
        f"WHEN len(list_filter(range(0, len({spans})), lambda k: NOT contains({text}, '__' || k || '__'))) = 0 "
        f"THEN {by_index(text, spans)} WHEN {count} = len({spans}) THEN {by_place} END"
    )


def hazard(sid: str, m: str) -> str:
    last = rf"regexp_extract({m}, '([^ \n]+)$', 1)"
    return f"""CASE {sid} % 7 WHEN 0 THEN {m}
        WHEN 1 THEN CASE WHEN regexp_matches({m}, '^[a-z]') THEN upper({m}[1]) || {m}[2:] ELSE {m} END || '.'
        WHEN 2 THEN replace({m}, '__0__', '____') WHEN 3 THEN replace({m}, '__0__', '')
        WHEN 4 THEN {m} || ' not' WHEN 5 THEN 'x'
        ELSE CASE WHEN length({last}) * 4 <= length({m})
             THEN {m}[:length({m}) - length({last}) - 1] ELSE {m} END END"""


def corrected(table: str, key: str, text: str, turn: str, answer: str = "", sim: str = "") -> str:
    """fixed: (key, original, spelled, masked, final, fell_back, guarded).

    ``answer`` is the corrector's and ``sim`` the similarity to the spelled text. The hazard answers
    leave one text inside the other, or are the single letter x, so their similarity is known.
    """
    answer = answer or hazard(turn, "masked")
    a, b = "lower(spelled)", "lower(cand)"
    # One of the two texts starts with the other; a one-letter answer is matched or not.
    sim = sim or f"""CASE WHEN starts_with({a}, {b}) OR starts_with({b}, {a})
        THEN 2.0 * least(length({a}), length({b})) / (length({a}) + length({b}))
        WHEN {b} = 'x' AND contains({a}, 'x') THEN 2.0 / (length({a}) + 1) ELSE 0.0 END"""
    return f"""{spell(table, key, text)}, {masked('spelled', key, 'spelled')},
    answered AS (SELECT {key}, masked, spans, {answer} AS answer FROM masked),
    restored AS (SELECT {key}, masked, {unmasked('answer', 'spans')} AS back FROM answered),
    cands AS (SELECT src.{key}, src.{text} AS original, spelled, masked, back IS NULL AS fell_back,
        coalesce(back, spelled) AS cand FROM {table} src JOIN spelled USING ({key}) JOIN restored USING ({key})),
    changed AS (SELECT {key}, spelled, cand, unnest({word_set('spelled')}) AS w FROM cands WHERE cand <> spelled),
    losing AS (SELECT DISTINCT {key} FROM changed WHERE length(w) >= 3
        AND NOT list_contains({word_set('cand')}, w) AND w NOT IN (SELECT term FROM dict)),
    judged AS (SELECT *, cand <> spelled AND ({key} IN (SELECT {key} FROM losing)
        OR {negations('spelled')} <> {negations('cand')} OR {sim} < 0.6) AS guarded FROM cands),
    fixed AS (SELECT {key}, original, spelled, masked, fell_back, guarded,
        CASE WHEN guarded THEN spelled ELSE cand END AS final FROM judged)"""


M2_LINES = f"""{FLAT}, m2 AS (SELECT 'part-' || ((sid // {SENT}) % 4) AS file, sid * 8 + k AS line_no, line FROM (
    SELECT sid, 0 AS k, 'S ' || s AS line FROM flat UNION ALL
    SELECT sid, 1, 'A 1 2|||R:OTHER|||xx yy|||REQUIRED|||-NONE-|||' || (sid % 2) FROM flat UNION ALL
    SELECT sid, 2, 'A 0 1|||U:OTHER|||-NONE-|||REQUIRED|||-NONE-|||0' FROM flat WHERE sid % 10 = 0 UNION ALL
    SELECT sid, 3, 'A 3 3|||M:OTHER|||zz|||REQUIRED|||-NONE-|||0' FROM flat WHERE sid % 15 = 0 UNION ALL
    SELECT sid, 4, 'A -1 -1|||noop|||-NONE-|||REQUIRED|||-NONE-|||0' FROM flat UNION ALL
    SELECT sid, 5, '' FROM flat WHERE sid % 19 <> 0))"""
M2_BLOCKS = f"""{M2_LINES}, kinds AS (SELECT file, line_no, line, CASE WHEN starts_with(line, 'S ') THEN 'S'
        WHEN starts_with(line, 'A ') THEN 'A' WHEN trim(line) = '' THEN 'B' END AS kind FROM m2),
    opened AS (SELECT *, max(CASE WHEN kind = 'S' THEN line_no END) OVER upto AS block,
        lead(CASE WHEN kind = 'S' THEN 'S' END) OVER nxt AS after FROM kinds
        WINDOW upto AS (PARTITION BY file ORDER BY line_no), nxt AS (PARTITION BY file ORDER BY line_no)),
    parts AS (SELECT file, block, max(line) FILTER (kind = 'S') AS src,
        coalesce(bool_or(kind <> 'B' AND after = 'S'), false) AS cut,
        list(string_split(line, '|||') ORDER BY line_no) FILTER (kind = 'A') AS notes
        FROM opened GROUP BY file, block),
    blocks AS (SELECT file, block, regexp_extract_all(src[3:], '\\S+') AS src, list_filter(notes, lambda f:
        f[2] <> 'noop' AND f[6] = '0' AND NOT starts_with(f[1], 'A -1')) AS edits FROM parts WHERE NOT cut)"""
M2_PAIRS = f"""{M2_BLOCKS}, flags AS (SELECT file, block, src,
        list_contains(list_transform(edits, lambda f: f[1]), 'A 1 2') AS e12,
        list_contains(list_transform(edits, lambda f: f[1]), 'A 0 1') AS e01,
        list_contains(list_transform(edits, lambda f: f[1]), 'A 3 3') AS e33 FROM blocks),
    m2p AS (SELECT file, block, array_to_string(src, ' ') AS src, array_to_string(
        (CASE WHEN e01 THEN [] ELSE src[1:1] END) || (CASE WHEN e12 THEN ['xx', 'yy'] ELSE src[2:2] END)
        || src[3:3] || (CASE WHEN e33 THEN ['zz'] ELSE [] END) || src[4:], ' ') AS tgt FROM flags)"""
M2_PREP = f"""{M2_PAIRS}, prepared AS (SELECT src, tgt, min({{'file': file, 'block': block}}) AS spot FROM m2p
    WHERE trim(src) <> '' AND trim(tgt) <> '' AND src <> tgt GROUP BY src, tgt)"""

LANG8 = f"""{FLAT}, entries AS (SELECT sid, CASE WHEN sid % 11 = 0 THEN 'x' ELSE (sid % 4)::VARCHAR END AS cnt,
        CASE WHEN sid % 5 = 0 THEN s ELSE s || ' §' END AS src,
        CASE WHEN sid % 13 = 0 THEN s || ' ' || s || ' ' || s || ' ' || s ELSE s END AS tgt FROM flat),
    copies AS (SELECT *, 0 AS copy FROM entries UNION ALL SELECT *, 1 FROM entries WHERE sid % 17 = 0),
    l8 AS (SELECT sid * 8 + copy AS line_no, trim(src) AS src, trim(tgt) AS tgt FROM copies
        WHERE sid % 9 <> 0 AND cnt IN ('1', '2', '3') AND trim(src) <> '' AND trim(tgt) <> '')"""
WC = r"len(regexp_extract_all({0}, '\S+'))"
RATIO_OK = f"({WC.format('tgt')} <= 3 * {WC.format('src')} AND {WC.format('src')} <= 3 * {WC.format('tgt')})"
LANG8_PREP = f"""{LANG8}, noisy AS (SELECT src, tgt, min(line_no) AS line_no FROM l8
    WHERE src <> tgt AND {RATIO_OK} GROUP BY src, tgt)"""
WORD_PAIRS = rf"""{FLAT}, wl AS (SELECT *, len(w) AS n, len(w) - len(w) // 2 AS half FROM
        (SELECT sid, s, (sid % 6)::INT AS k, regexp_extract_all(s, '\S+') AS w FROM flat)),
    wm AS (SELECT *, CASE WHEN n BETWEEN 2 AND 150 THEN half ELSE n END AS spot, (CASE WHEN n BETWEEN 2 AND 150 AND k = 1
        AND lower(w[half + 1]) <> lower(w[half + 2]) THEN 1 ELSE 0 END) AS gone FROM wl),
    wp AS (SELECT sid, k, w, spot, gone, s AS src, array_to_string(w[1:spot] || list_transform(range(k), lambda i: '§')
        || w[spot + gone + 1:], ' ') AS tgt FROM wm)"""
TOKS = r"dtoks AS (SELECT token, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(text, '\S+')) AS token FROM documents) GROUP BY 1)"
DCORES = rf"""{TOKS}, dcores AS (SELECT core, sum(n)::BIGINT AS n FROM
    (SELECT regexp_extract(token, '^[^{WORDCLASS}]*(.*?)[^{WORDCLASS}]*$', 1) AS core, n FROM dtoks) GROUP BY 1)"""
IS_PLAIN = r"regexp_matches(core, '^[A-Za-z]+([''\-][A-Za-z]+)*$')"
UNKNOWN = f"{DICT}, {vocab()}"
ANALYZED = f"""{UNKNOWN}, {near(2)},
    ranked2 AS (SELECT word, term, cnt, d, row_number() OVER w AS rk, lead(cnt) OVER w AS nxt,
        lead(d) OVER w AS nd FROM near2 WINDOW w AS (PARTITION BY word ORDER BY d, cnt DESC, term)),
    best AS (SELECT word, term, d = 1 AND cnt >= 50 AND (nd IS NULL OR nd > d OR cnt >= 2 * nxt) AS auto
        FROM ranked2 WHERE rk = 1),
    six AS (SELECT word, list(term ORDER BY rk) AS terms FROM ranked2 WHERE rk <= 6 GROUP BY word),
    verdicts AS (SELECT word, CASE WHEN term IS NULL THEN 'unknown' WHEN auto THEN 'autofix' ELSE 'suggest' END
        AS status, term, terms FROM unknown LEFT JOIN best USING (word) LEFT JOIN six USING (word)),
    toks AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS pos FROM
        (SELECT doc_id, regexp_extract_all(text, '\\s+|\\S+') AS l FROM documents)),
    cut AS (SELECT *, CASE WHEN trim(raw, {BLANK}) = '' THEN 'space' ELSE 'word' END AS kind,
        regexp_extract(raw, '{PLAIN}', 1) AS plain FROM toks),
    an AS (SELECT doc_id, pos::BIGINT AS pos, kind, raw,
        CASE WHEN kind = 'word' THEN regexp_extract(raw, '^[^{WORDCLASS}]*') END AS pre,
        CASE WHEN kind = 'word' THEN regexp_extract(raw, '^[^{WORDCLASS}]*(.*?)[^{WORDCLASS}]*$', 1) END AS core,
        CASE WHEN kind = 'word' THEN regexp_extract(raw, '^[^{WORDCLASS}]*(.*?)([^{WORDCLASS}]*)$', 2) END AS post,
        CASE WHEN kind = 'word' THEN coalesce(status, 'ok') END AS status,
        CASE WHEN status = 'autofix' THEN {cased('plain', 'term')} END AS fix,
        CASE WHEN status = 'suggest' THEN list_transform(terms, lambda t: {cased('plain', 't')}) END AS cands
        FROM cut LEFT JOIN verdicts ON lower(plain) = word AND {allowed('plain')})"""


def diffed(before: str, after: str) -> str:
    """Flags of the words of ``after`` when it is ``before`` with other words put at its end."""
    return (
        f"array_to_string(list_transform(range(1, len({after}) + 1), lambda i: {after}[i] || "
        f"CASE WHEN i <= len({before}) AND lower({after}[i]) = lower({before}[i]) THEN '=' ELSE '+' END), ' ')"
    )


WL = r"regexp_extract_all({0}, '\S+')"
REVIEW = f"{SENTS}, {corrected('sents', 'sid', 'sentence', 'sid')}"
CARDS = f"""{REVIEW}, cards AS (SELECT sid // {SENT} AS doc_id, (sid % {SENT})::BIGINT AS sent_no, original, spelled,
    final, guarded FROM fixed WHERE trim(final, {BLANK}) <> trim(spelled, {BLANK}))"""
CONV = "conv AS (SELECT {'c': conv_id, 't': turn} AS sid, conv_id, turn, role, text FROM conversations)"
EXAMPLES = """ex AS (SELECT row_number() OVER w AS n, role AS category, 'turn' AS note,
    coalesce(lag(role) OVER w <> role, true) AS header, text AS input FROM conversations
    WINDOW w AS (ORDER BY conv_id, turn))"""

ORACLES: dict[str, str] = {
    "tokenize": r"""SELECT doc_id, len(regexp_extract_all(text, '\s+|\S+'))::BIGINT AS n,
        array_to_string(regexp_extract_all(text, '\s+|\S+'), '|') AS tokens FROM documents""",
    "peel": rf"""WITH {TOKS} SELECT token, regexp_extract(token, '^[^{WORDCLASS}]*') AS pre,
        regexp_extract(token, '^[^{WORDCLASS}]*(.*?)[^{WORDCLASS}]*$', 1) AS core,
        regexp_extract(token, '^[^{WORDCLASS}]*(.*?)([^{WORDCLASS}]*)$', 2) AS post FROM dtoks""",
    "peel_protect": f"""WITH {TOKS}, p AS (SELECT token AS tok FROM dtoks)
        SELECT tok AS token, tok[:length(tok) - length(ltrim(tok, '{OPENERS}'))] AS pre, {PROTECT_CORE} AS core,
        ltrim(tok, '{OPENERS}')[length({PROTECT_CORE}) + 1:] AS post FROM p""",
    "plain_words": f"WITH {DCORES} SELECT core, n FROM dcores WHERE {IS_PLAIN}",
    "correctable_tokens": f"""WITH {DCORES} SELECT core, n FROM dcores
        WHERE {IS_PLAIN} AND {allowed('core')}""",
    "structured_spans": rf"""WITH {ALL_SENTS}, raw AS (
        SELECT unnest(regexp_extract_all(text, '\S+')) AS tok FROM documents UNION ALL
        SELECT unnest(regexp_extract_all(sentence, '\S+')) FROM allsents WHERE sid >= {PAGE}),
        c AS (SELECT {PROTECT_CORE} AS core FROM raw)
        SELECT core, count(*)::BIGINT AS n FROM c WHERE {STRUCTURED} GROUP BY core""",
    "sentences": f"WITH {SENTS} SELECT sid, sentence FROM sents",
    "sentences_protected": f"""WITH texts AS (SELECT doc_id AS id, text FROM documents UNION ALL
            SELECT page_id + {PAGE}, 'please visit (' || url || ') before ' || page_id || 'pm.' FROM pages),
        {masked('texts', 'id', 'text')},
        cut AS (SELECT id, spans, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS sent_no FROM
            (SELECT id, spans, {sentence_list('masked')} AS l FROM masked))
        SELECT id, sent_no::BIGINT AS sent_no, {by_index('s', 'spans')} AS sentence FROM cut""",
    "normalize": f"WITH {NORMED} SELECT sid, n_out AS norm FROM nm",
    "negation_count": f"""WITH t AS (SELECT doc_id, text || ' isn’t n`t WOULD''VE no' || lang AS x FROM documents)
        SELECT doc_id, {negations('x')}::BIGINT AS n FROM t""",
    "word_cores": f"SELECT doc_id, array_to_string(list_sort({word_set('text')}), '|') AS cores FROM documents",
    "match_case": f"""WITH {DCORES} SELECT core, {cased('core', 'lower(reverse(core))')} AS cased
        FROM dcores WHERE {IS_PLAIN}""",
    "word_frequencies": f"WITH {DICT} SELECT term, cnt AS count FROM dict",
    "merge_dictionaries": f"""WITH {DICT}, {counted('conversations', 5, 'extra')}
        SELECT term, sum(cnt)::BIGINT AS count FROM (FROM dict UNION ALL FROM extra) GROUP BY term""",
    "unknown_vocab": f"WITH {UNKNOWN} SELECT word, n FROM unknown",
    "protected_terms": f"""WITH {UNKNOWN}, {counted('benchmark', 1, 'extra')}
        SELECT word, n FROM unknown WHERE word NOT IN (SELECT term FROM extra)""",
    "fuzzy_candidates": f"""WITH {UNKNOWN}, {near(2)}
        SELECT word, term, cnt AS count, d::INT AS distance FROM near2""",
    "edit_distance": f"""WITH {UNKNOWN}, {near(1)}, turn AS (SELECT word, term, word[2:] || word[1] AS t FROM near1)
        SELECT word, term, {osa('word', 'term')}::BIGINT AS distance, {osa('t', 'term')}::BIGINT AS turned FROM turn""",
    "rank_candidates": f"WITH {UNKNOWN}, {near(1)}, {RANKED1} SELECT word, term, rk AS rank, true AS closest FROM ranked1",
    "topk_candidates": f"WITH {ANALYZED} SELECT word, rk AS rank, term, cnt AS count FROM ranked2 WHERE rk <= 6",
    "autofix_gate": f"""WITH {UNKNOWN}, {near(1)}, {RANKED1} SELECT word, term, cnt AS count, coalesce(nxt, 0) AS runner_up,
        cnt >= 50 AND (nxt IS NULL OR cnt >= 2 * nxt) AS autofix FROM ranked1 WHERE rk = 1""",
    "spell_correct": f"""WITH {spell('documents', 'doc_id', 'text')}
        SELECT doc_id, spelled AS spell_corrected FROM spelled""",
    "analyze_tokens": f"""WITH {ANALYZED} SELECT doc_id, pos, kind, raw, pre, core, post, status, fix,
        array_to_string(cands, '|') AS candidates FROM an""",
    "apply_suggestions": f"""WITH {ANALYZED} SELECT doc_id, string_agg(CASE WHEN status = 'suggest'
        THEN pre || cands[1] || post ELSE raw END, '' ORDER BY pos) AS text FROM an GROUP BY doc_id""",
    "replace_first": f"""WITH f AS (SELECT doc_id, text, {sentence_list('text')}[1] AS s FROM documents)
        SELECT doc_id, CASE WHEN strpos(text, s) > 0 THEN text[:strpos(text, s) - 1] || '$1 done'
        || text[strpos(text, s) + length(s):] ELSE text END AS text FROM f""",
    "mask": f"""WITH {ALL_SENTS}, {masked('allsents', 'sid', 'sentence')}
        SELECT sid, masked, array_to_string(spans, '|') AS spans FROM masked""",
    "unmask": f"""WITH {ALL_SENTS}, {masked('allsents', 'sid', 'sentence')},
        hurt AS (SELECT sid, spans, CASE sid % 4 WHEN 0 THEN '__1__ ' || masked || ' __0__ __77__'
            WHEN 1 THEN replace(masked, '__0__', '_0_') WHEN 2 THEN replace(masked, '__0__', '')
            ELSE masked END AS h FROM masked),
        back AS (SELECT sid, h, {unmasked('h', 'spans')} AS r FROM hurt)
        SELECT sid, coalesce(r, h) AS text, r IS NOT NULL AS ok FROM back""",
    "similarity": f"WITH {SCORED} SELECT sid, sim_in, sim_out, sim_ref FROM sc",
    "word_edits": f"WITH {WORD_PAIRS} SELECT sid, (sid % 6)::BIGINT AS n_edits FROM wp",
    "word_diff": f"""WITH {WORD_PAIRS}, w AS (SELECT sid, spot, k, {WL.format('tgt')} AS b FROM wp)
        SELECT sid, array_to_string(list_transform(range(1, len(b) + 1), lambda i: b[i] ||
        CASE WHEN i > spot AND i <= spot + k THEN '+' ELSE '=' END), ' ') AS diff FROM w""",
    "meaning_guard": f"""WITH {SENTS}, g AS (SELECT sid, sentence AS s, CASE sid % 5 WHEN 0 THEN sentence
            WHEN 1 THEN sentence || ' not' WHEN 2 THEN coalesce({marked('sentence', "'§§'")}, sentence || '§§')
            WHEN 3 THEN coalesce({marked('sentence', "repeat('§', length(sentence) + 20)")}, sentence || '§')
            ELSE coalesce({marked('sentence', "'§'", True)}, '§' || sentence) END AS a FROM sents),
        l AS (SELECT sid, s, a, lower(s) AS ls, lower(a) AS la FROM g),
        r AS (SELECT sid, s, a, CASE WHEN strpos(rtrim(la, '§'), '§') > 1 THEN {sim_marked('la', 'ls', 'la')}
            WHEN starts_with(la, ls) OR length(la) < 200
            OR len(list_filter(list_distinct(string_split(ls, '')), lambda c:
                length(la) - length(replace(la, c, '')) <= length(la) // 100 + 1)) > 0
            THEN 2.0 * length(ls) / (length(ls) + length(la)) ELSE 0.0 END AS sim FROM l)
        SELECT sid, {negations('s')} = {negations('a')} AND sim >= 0.6 AS kept FROM r""",
    "dropped_names": f"""WITH {DICT}, c AS (SELECT doc_id, {word_set('text')} AS whole,
            {word_set('text[:length(text) - length(text) // 5]')} AS part FROM documents),
        w AS (SELECT doc_id, unnest(list_filter(whole, lambda x: length(x) >= 3
            AND NOT list_contains(part, x))) AS word FROM c)
        SELECT doc_id, word FROM w WHERE word NOT IN (SELECT term FROM dict)""",
    "clean_completion": rf"""WITH {FLAT}, c AS (SELECT sid, trim(s, ' ') AS s FROM flat),
        l AS (SELECT sid, trim(regexp_replace(s, '^(?i:corrected sentence|correction|corrected|answer|output)\s*[:\-]\s*', ''), ' ') AS s FROM c)
        SELECT sid, CASE WHEN sid % 5 = 3 THEN trim(c.s, ' ') WHEN regexp_matches(l.s, '^["''“‘](?s:.*)["''”’]$')
            AND length(l.s) >= 2 THEN trim(l.s[2:-2], ' ') ELSE l.s END AS clean FROM c JOIN l USING (sid)""",
    "chat_messages": """SELECT conv_id, turn, '[{"role":"system","content":"fix it"},{"role":"user","content":'
        || to_json(text) || '}]' AS messages FROM conversations""",
    "correct": f"""WITH {ALL_SENTS}, {corrected('allsents', 'sid', 'sentence', 'sid')}
        SELECT sid, spelled AS spell_corrected, masked, final, fell_back, guarded AS meaning_guarded,
        final <> original AS changed FROM fixed""",
    "grammar_cards": f"""WITH {ALL_SENTS}, {corrected('allsents', 'sid', 'sentence', 'sid')}
        SELECT sid, spelled AS spell_corrected, final FROM fixed WHERE trim(final, {BLANK}) <> trim(spelled, {BLANK})""",
    "suggestion_summary": f"""WITH {ANALYZED}, cardcount AS ({"WITH " + CARDS} SELECT doc_id, count(*) AS c
        FROM cards GROUP BY doc_id), s AS (SELECT doc_id, count(*) FILTER (status = 'suggest') AS n_suggest
        FROM an GROUP BY doc_id)
        SELECT doc_id, n_suggest, coalesce(c, 0)::BIGINT AS n_cards FROM s LEFT JOIN cardcount USING (doc_id)""",
    "example_report": f"""WITH {EXAMPLES}, {corrected('ex', 'n', 'input', 'n')}
        SELECT n, category, note, header, input, final, fell_back FROM ex JOIN fixed USING (n)""",
    "review": f"""WITH {CARDS}, w AS (SELECT *, {WL.format('spelled')} AS a, {WL.format('final')} AS b FROM cards)
        SELECT doc_id, sent_no, original AS raw, final, {diffed('a', 'b')} AS diff, guarded FROM w""",
    "score_join": f"WITH {EVAL} SELECT sid, input, gold, pred AS out FROM ev",
    "scope_counts": f"WITH {EVAL} SELECT bucket, count(*)::BIGINT AS n FROM ev GROUP BY bucket",
    "match_rate": f"""WITH {NORMED} SELECT avg((pred = gold)::INT::DOUBLE) * 100 AS our_exact,
        avg((n_out = n_gold)::INT::DOUBLE) * 100 AS our_norm, avg((ref = gold)::INT::DOUBLE) * 100 AS ref_exact,
        avg((n_ref = n_gold)::INT::DOUBLE) * 100 AS ref_norm FROM nm""",
    "by_use_case": f"""WITH {NORMED} SELECT use_case, count(*)::BIGINT AS n, avg((n_out = n_gold)::INT::DOUBLE) * 100 AS ours,
        avg((n_ref = n_gold)::INT::DOUBLE) * 100 AS ref FROM nm GROUP BY use_case""",
    "mean_similarity": f"""WITH {SCORED} SELECT round(avg(sim_in), 6) AS sim_in, round(avg(sim_out), 6) AS sim_out,
        round(avg(sim_ref), 6) AS sim_ref FROM sc""",
    "direction": f"""WITH {SCORED} SELECT count(*) FILTER (sim_out > sim_in + 1e-9) AS better,
        count(*) FILTER (abs(sim_out - sim_in) <= 1e-9) AS same, count(*) FILTER (sim_out < sim_in - 1e-9) AS worse FROM sc""",
    "by_scope": f"""WITH {SCORED} SELECT bucket, count(*)::BIGINT AS n, avg((n_out = n_gold)::INT::DOUBLE) * 100 AS ours,
        avg((n_ref = n_gold)::INT::DOUBLE) * 100 AS ref, round(avg(sim_out), 6) AS our_sim, round(avg(sim_in), 6) AS in_sim,
        CASE WHEN avg(sim_out) >= avg(sim_in) THEN 'net+' ELSE 'net-' END AS net FROM sc GROUP BY bucket""",
    "evaluate_report": f"""WITH {SCORED}, vd AS (SELECT *, CASE WHEN n_out = n_in THEN 'unchanged'
            WHEN sim_out > sim_in + 0.01 THEN 'improved' WHEN sim_out < sim_in - 0.01 THEN 'regressed'
            ELSE 'lateral' END AS verdict FROM sc),
        lv AS (SELECT 'all' AS level, NULL AS label, * FROM vd UNION ALL SELECT 'bucket', bucket, * FROM vd
            UNION ALL SELECT 'use_case', use_case, * FROM vd)
        SELECT level, label, count(*)::BIGINT AS n, avg((pred = gold)::INT::DOUBLE) * 100 AS our_exact,
        avg((n_out = n_gold)::INT::DOUBLE) * 100 AS our_norm, avg((ref = gold)::INT::DOUBLE) * 100 AS ref_exact,
        avg((n_ref = n_gold)::INT::DOUBLE) * 100 AS ref_norm, round(avg(sim_in), 6) AS sim_in,
        round(avg(sim_out), 6) AS sim_out, round(avg(sim_ref), 6) AS sim_ref,
        count(*) FILTER (sim_out > sim_in + 1e-9) AS better, count(*) FILTER (abs(sim_out - sim_in) <= 1e-9) AS same,
        count(*) FILTER (sim_out < sim_in - 1e-9) AS worse, count(*) FILTER (verdict = 'unchanged') AS unchanged,
        count(*) FILTER (verdict = 'improved') AS improved, count(*) FILTER (verdict = 'regressed') AS regressed,
        count(*) FILTER (verdict = 'lateral') AS "lateral",
        count(*) FILTER (verdict <> 'unchanged' AND n_out = n_gold) AS exact_edits FROM lv GROUP BY level, label""",
    "error_profile": f"""WITH {PROFILE} SELECT n, unchanged, edited, improved, regressed, "lateral", exact_edits,
        100 * unchanged / n AS unchanged_pct, 100 * edited / n AS edited_pct,
        100 * improved / greatest(edited, 1) AS improved_pct, 100 * regressed / greatest(edited, 1) AS regressed_pct,
        100 * "lateral" / greatest(edited, 1) AS lateral_pct, 100 * exact_edits / greatest(edited, 1) AS exact_edits_pct,
        100 * improved / greatest(edited, 1) AS edit_precision FROM pf""",
    "model_profile": f"""WITH {PROFILE} SELECT n, edited, improved, match_pct, 100 * improved / greatest(edited, 1)
        AS edit_precision, match_pct = 0 AND edited = n AND improved = 0 AS suspect_run FROM pf""",
    "regressions": f"""WITH {VERDICT} SELECT sid, input, pred AS model_output, gold, sim_in, sim_out FROM vd
        WHERE verdict = 'regressed'""",
    "latency_percentiles": """WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k,
            count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
        SELECT event_type, p::DOUBLE AS p, value FROM s, (VALUES (50), (75), (90), (95), (99)) t(p)
        WHERE k = round_even((p / 100) * (n - 1), 0)::BIGINT""",
    "mean_median": """SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median
        FROM events GROUP BY event_type""",
    "throughput": """SELECT event_type, round(median(rate), 6) AS throughput FROM (SELECT event_type, user_id,
        count(*) / sum(value) AS rate FROM events GROUP BY ALL) GROUP BY event_type""",
    "metric_pivot": """WITH m AS (SELECT event_type AS model, (2 ** (event_id % 7))::INT AS batch, arg_max(value, event_id) AS v
            FROM events WHERE user_id % 3 <> 0 GROUP BY ALL)
        SELECT batch, max(v) FILTER (model = 'click') AS click, max(v) FILTER (model = 'error') AS error,
        max(v) FILTER (model = 'purchase') AS purchase, max(v) FILTER (model = 'signup') AS signup,
        max(v) FILTER (model = 'view') AS view FROM m GROUP BY batch""",
    "metric_series": """SELECT (user_id % 5 + 1)::INT AS beam, arg_max(value, event_id) AS value FROM events
        WHERE user_id % 3 = 0 GROUP BY 1""",
    "idle_sessions": """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 1800 SECOND, true) AS opens
            FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
        SELECT user_id, min(ts) AS chunk_start, max(ts) AS chunk_end, count(*)::BIGINT AS n FROM s GROUP BY user_id, k""",
    "stop_sessions": """WITH t AS (SELECT user_id, ts, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS s
            FROM events GROUP BY user_id, ts),
        g AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 172800 SECOND, true) AS opens FROM t
            WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        k AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
        b AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY user_id, k ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING
            AND 1 PRECEDING), 0)::BIGINT AS before FROM k)
        SELECT user_id, min(ts) AS chunk_start, max(ts) AS chunk_end, sum(n)::BIGINT AS n, sum(s)::BIGINT AS stops,
        CASE WHEN (min(before) + sum(s))::BIGINT // 2 > before // 2 THEN 'stops' ELSE 'idle' END AS closed_by
        FROM b GROUP BY user_id, k, before // 2""",
    "m2_blocks": f"""WITH {M2_BLOCKS} SELECT file, block, array_to_string(src, ' ') AS src, coalesce(len(edits), 0)::BIGINT AS n_edits
        FROM blocks""",
    "m2_pairs": f"WITH {M2_PREP} SELECT src, tgt, spot.file AS file, spot.block AS block FROM prepared",
    "prep_counters": f"""WITH {M2_PREP} SELECT (SELECT count(DISTINCT file) FROM m2) AS files,
        (SELECT count(*) FROM prepared) AS pairs,
        (SELECT count(*) FROM m2p WHERE src = tgt AND trim(src) <> '') AS identities,
        (SELECT count(DISTINCT (file, block)) FROM opened WHERE kind = 'A' AND NOT regexp_matches(
            line, '^A -?[0-9]+ -?[0-9]+([|][|][|][^|]*){{4}}[|][|][|]-?[0-9]+$')) AS broken""",
    "job_counters": f"""WITH {M2_PREP}, {LANG8_PREP.split(', entries AS', 1)[1].join(['entries AS', ''])}
        SELECT 'm2' AS job, (SELECT count(*) FROM prepared) AS pairs,
        (SELECT count(*) FROM m2p WHERE src = tgt AND trim(src) <> '') AS identities, 0::BIGINT AS broken
        UNION ALL SELECT 'lang8', (SELECT count(*) FROM noisy), (SELECT count(*) FROM l8 WHERE src = tgt),
        (SELECT count(*) FROM copies WHERE sid % 9 = 0 OR cnt NOT IN ('1', '2', '3'))""",
    "lang8_pairs": f"WITH {LANG8_PREP} SELECT src, tgt, line_no FROM noisy",
    "length_ratio": f"WITH {LANG8} SELECT line_no, src, tgt FROM l8 WHERE {RATIO_OK}",
    "minimal_edit": f"WITH {WORD_PAIRS} SELECT sid, src, tgt FROM wp WHERE sid % 6 <= 3",
    "distinct_pairs": f"WITH {LANG8} SELECT DISTINCT src, tgt FROM l8",
    "first_occurrence": f"WITH {LANG8} SELECT src, tgt, min(line_no) AS line_no FROM l8 GROUP BY src, tgt",
    "limit_pairs": f"""WITH {LANG8} SELECT src, tgt, min(line_no) AS line_no FROM l8 GROUP BY src, tgt
        ORDER BY line_no LIMIT 500""",
    "mix_corpora": f"""WITH {M2_PREP}, {LANG8_PREP.split(', entries AS', 1)[1].join(['entries AS', ''])},
        capped AS (SELECT src, tgt FROM noisy ORDER BY line_no LIMIT 1000)
        SELECT src, tgt FROM prepared UNION ALL SELECT src, tgt FROM capped""",
    "stream_correct": f"""WITH {CONV}, {corrected('conv', 'sid', 'text', '(sid.c + sid.t)')}
        SELECT conv_id, turn, final, fell_back, guarded AS meaning_guarded FROM conv JOIN fixed USING (sid)""",
}
