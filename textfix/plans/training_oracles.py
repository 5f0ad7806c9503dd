"""SQL of the queries in ``training_queries`` and ``file_queries``."""

from __future__ import annotations

from textfix.plans.oracles import (
    ALL_SENTS, DCORES, DICT, EVAL, FIXES, FLAT, IS_PLAIN, LANG8_PREP, M2_BLOCKS, M2_PAIRS, NORMED, ORACLES,
    PLAIN, RANKED1, SENTS, UNKNOWN, VERDICT, WORD_PAIRS, WORDCLASS, allowed, apply_fixes, cased, cores,
    corrected, hazard, near, norm, sentence_list,
)

GRAMS = r"""grams AS (SELECT sid, side, n, gram, count(*) AS k FROM (
    SELECT sid, side, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS gram
    FROM (SELECT sid, 'c' AS side, regexp_extract_all(pred, '\S+') AS w FROM ev UNION ALL
          SELECT sid, 'r', regexp_extract_all(gold, '\S+') FROM ev UNION ALL
          SELECT sid, 's', regexp_extract_all(input, '\S+') FROM ev), (VALUES (1), (2), (3), (4)) o(n))
    GROUP BY ALL),
    per AS (SELECT sid, n, gram, coalesce(sum(k) FILTER (side = 'c'), 0) AS c, coalesce(sum(k) FILTER (side = 'r'), 0) AS r,
        coalesce(sum(k) FILTER (side = 's'), 0) AS s FROM grams GROUP BY ALL),
    hits AS (SELECT n, sum(least(c, r) - greatest(least(c, s) - least(c, r), 0)) / sum(c) AS p,
        sum(c)::BIGINT AS c, sum(r)::BIGINT AS r FROM per GROUP BY n),
    tops AS (SELECT max(c) FILTER (n = 1) AS c, max(r) FILTER (n = 1) AS r, max(p) FILTER (n = 1) AS p1,
        max(p) FILTER (n = 2) AS p2, max(p) FILTER (n = 3) AS p3, max(p) FILTER (n = 4) AS p4 FROM hits)"""
EDITS = f"""{NORMED}, ed AS (SELECT sid, (sid % 101)::DOUBLE / 100 AS score, n_out = n_gold AS correct
    FROM nm WHERE n_out <> n_in)"""
EDIT_SETS = f"""{M2_BLOCKS}, gold AS (SELECT DISTINCT file, block, block // 8 AS no, string_split(e[1], ' ')[2]::INT AS s,
        string_split(e[1], ' ')[3]::INT AS t, e[3] AS repl FROM (SELECT file, block, unnest(edits) AS e FROM blocks)),
    mine AS (SELECT file, block, s, CASE WHEN no % 13 = 0 THEN t + 1 ELSE t END AS t,
        CASE WHEN no % 11 = 0 THEN repl || 's' ELSE repl END AS repl FROM gold WHERE no % 7 <> 0),
    n AS (SELECT (SELECT count(*) FROM mine JOIN gold USING (file, block, s, t, repl)) AS tp,
        (SELECT count(*) FROM mine) AS m, (SELECT count(*) FROM gold) AS g)"""
PAIR_EDITS = f"""{WORD_PAIRS}, pe AS (SELECT sid, spot, gone, k, k > 0 AS changed,
    array_to_string(list_transform(range(k), lambda i: '§'), ' ') AS marks FROM wp)"""


# big: neighbours; open_terms: common terms of words without a safe fix; sure: (prev, word, fix) of ctx.
OPENED = f"""{UNKNOWN}, {near(1)}, {RANKED1}, {FIXES}, seq AS (SELECT list_transform({cores('text')}, lambda c: lower(c)) AS l FROM documents),
    big AS (SELECT p.prev, p.word, count(*)::BIGINT AS n FROM (SELECT unnest(list_transform(range(1, len(l)),
        lambda i: {{'prev': l[i], 'word': l[i + 1]}})) AS p FROM seq) GROUP BY ALL),
    open_terms AS (SELECT word, term, cnt FROM near1 WHERE cnt >= 50 AND word NOT IN (SELECT word FROM fixes))"""
CHOSEN = """choices AS (SELECT c.prev, c.word, o.term, coalesce(b.n, 0) AS seen, lead(coalesce(b.n, 0)) OVER w AS nxt,
        row_number() OVER w AS rk FROM ctx c JOIN open_terms o USING (word) LEFT JOIN big b ON b.prev = c.prev AND b.word = o.term
        WINDOW w AS (PARTITION BY c.prev, c.word ORDER BY coalesce(b.n, 0) DESC, o.cnt DESC, o.term)),
    sure AS (SELECT prev, word, term AS fix FROM choices WHERE rk = 1 AND seen >= 3 AND seen >= 2 * coalesce(nxt, 0))"""


def corrupted(mix: dict[str, float], errors: dict[str, str]) -> str:
    """kinds: (sid, kind) by quotas in hash order, type after type; made: (sid, s, and each error)."""
    made = ", ".join(f"{sql} AS {kind}" for kind, sql in errors.items())
    steps, before = [], []
    for kind, share in mix.items():
        free = " ".join(f"AND sid NOT IN (SELECT sid FROM take_{b})" for b in before)
        steps.append(
            f"take_{kind} AS (SELECT sid, '{kind}' AS kind FROM made WHERE {kind} <> s {free} QUALIFY row_number() "
            f"OVER (ORDER BY md5('0|{kind}|' || sid)) <= (SELECT floor(count(*) * {share} + 0.5) FROM made))"
        )
        before.append(kind)
    union = " UNION ALL ".join(f"FROM take_{b}" for b in before)
    return f"{FLAT}, made AS (SELECT sid, s, {made} FROM flat), {', '.join(steps)}, kinds AS ({union})"


ERRORS = {
    "article": r"regexp_replace(s, '(?s)^(.*? )(?:the|an|a) ', '\1')",
    "word_order": r"regexp_replace(s, '^([A-Za-z]+) ([A-Za-z]+) ', '\2 \1 ')",
    "punctuation": r"regexp_replace(s, '(?s)[.!?,;:]([^.!?,;:]*)$', '\1')",
    "casing": r"CASE WHEN regexp_matches(s, '[A-Z]') THEN regexp_extract(s, '(?s)^([^A-Z]*)([A-Z])(.*)$', 1) || "
    r"lower(regexp_extract(s, '(?s)^([^A-Z]*)([A-Z])(.*)$', 2)) || regexp_extract(s, '(?s)^([^A-Z]*)([A-Z])(.*)$', 3) ELSE s END",
    "spelling": r"regexp_replace(s, '(?s)^(.*?[a-z])([a-z])([a-z])([a-z])', '\1\3\2\4')",
    "spacing": r"regexp_replace(s, '(?s)^(.*?[a-z]) ([a-z])', '\1\2')",
}
CORRUPTED = corrupted(
    {"article": 0.01, "word_order": 0.1, "punctuation": 0.15, "casing": 0.1, "spelling": 0.2, "spacing": 0.12}, ERRORS
)
ERROR_OF = " ".join(f"WHEN '{kind}' THEN {kind}" for kind in ERRORS)
FULL_STOP = "CASE WHEN masked LIKE '%.' THEN masked[:length(masked) - 1] || '!' ELSE masked END"
# Only the last of all characters differs, and everything before it is the matching block.
LAST_DIFFERS = "(length(spelled) - 1) / length(spelled)"
PAIRS_SQL = f"WITH {LANG8_PREP}"

TRAINING_ORACLES: dict[str, str] = {
    "decontaminate": f"""WITH {SENTS}, held AS (SELECT {norm('s')} AS f FROM
        (SELECT unnest({sentence_list('text')}) AS s FROM benchmark))
        SELECT sid, sentence FROM sents WHERE {norm('sentence')} NOT IN (SELECT f FROM held)""",
    "length_cap": rf"""WITH {WORD_PAIRS}, l AS (SELECT sid, regexp_extract_all(src, '\S+') AS a,
        regexp_extract_all(tgt, '\S+') AS b FROM wp) SELECT sid, array_to_string(a, ' ') AS src,
        array_to_string(b, ' ') AS tgt FROM l WHERE len(a) <= 12 AND len(b) <= 12""",
    "identity_mix": f"""{PAIRS_SQL}, clean AS (SELECT DISTINCT s FROM flat),
        taken AS (SELECT s FROM clean QUALIFY row_number() OVER (ORDER BY md5(s), s)
            <= (SELECT round_even(count(*) * 0.3 / 0.7, 0) FROM noisy))
        SELECT src, tgt FROM noisy UNION ALL SELECT s, s FROM taken""",
    "confidence_gate": f"WITH {EDITS} SELECT sid, score, correct FROM ed WHERE score >= 0.75",
    "confidence_curve": f"""WITH {EDITS} SELECT t::DOUBLE AS threshold, count(*) FILTER (score >= t) AS kept,
        count(*) FILTER (score >= t AND correct) AS right,
        round((count(*) FILTER (score >= t AND correct))::DOUBLE / nullif(count(*) FILTER (score >= t), 0), 6) AS precision,
        round((count(*) FILTER (score >= t))::DOUBLE / count(*), 6) AS coverage
        FROM ed, (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (0.9), (1.0)) l(t) GROUP BY t""",
    "f_half": f"""WITH {EDIT_SETS} SELECT tp, m - tp AS fp, g - tp AS fn, round(tp::DOUBLE / m, 6) AS precision,
        round(tp::DOUBLE / g, 6) AS recall, round(1.25 * (tp::DOUBLE / m) * (tp::DOUBLE / g)
        / (0.25 * tp::DOUBLE / m + tp::DOUBLE / g), 6) AS f FROM n""",
    "edit_extraction": f"""WITH {PAIR_EDITS} SELECT sid, CASE WHEN changed THEN spot || ':' || (spot + gone) || ':' || marks
        ELSE '' END AS edits, true AS rebuilt FROM pe""",
    "f_half_extracted": f"""WITH {PAIR_EDITS}, n AS (SELECT
            count(*) FILTER (changed AND sid % 3 <> 0 AND NOT (sid % 5 = 0 AND spot = 0)) AS tp,
            count(*) FILTER (sid % 3 <> 0 AND sid % 5 = 0) AS fp, count(*) FILTER (changed) AS g FROM pe)
        SELECT tp, fp, g - tp AS fn, round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / g, 6) AS recall,
        round(1.25 * (tp::DOUBLE / (tp + fp)) * (tp::DOUBLE / g) / (0.25 * tp::DOUBLE / (tp + fp) + tp::DOUBLE / g), 6) AS f
        FROM n""",
    "corrupt": f"""WITH {CORRUPTED} SELECT sid, kind, CASE kind {ERROR_OF} ELSE s END AS src, s AS tgt
        FROM made LEFT JOIN kinds USING (sid)""",
    "corruption_mix": f"""WITH {CORRUPTED} SELECT kind, count(*)::BIGINT AS n,
        round(count(*)::DOUBLE / (SELECT count(*) FROM made), 6) AS share FROM made LEFT JOIN kinds USING (sid) GROUP BY kind""",
    "gleu": f"""WITH {EVAL}, {GRAMS} SELECT c, r, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3,
        round(p4, 6) AS p4, round(CASE WHEN c >= r THEN 1 ELSE exp(1 - r::DOUBLE / c) END
        * exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4), 6) AS gleu FROM tops""",
    "abbreviations": f"""WITH {DICT}, fixes AS (SELECT term AS word, term || 'ing' AS fix FROM dict WHERE length(term) = 3),
        {apply_fixes('documents', 'doc_id', 'text', 'true')} SELECT doc_id, spelled AS expanded FROM spelled""",
    "gazetteer": f"""WITH {DCORES}, names AS (SELECT DISTINCT lower(c) AS name FROM
        (SELECT unnest({cores('text')}) AS c FROM benchmark) WHERE regexp_matches(c, '^[A-Z]'))
        SELECT core, n, CASE WHEN NOT regexp_matches(core, '^[A-Z]') THEN 'plain'
        WHEN lower(core) IN (SELECT name FROM names) THEN 'keep' ELSE 'eligible' END AS policy
        FROM dcores WHERE {IS_PLAIN}""",
    "bigram_rerank": f"""WITH {UNKNOWN}, {near(1)}, seq AS (SELECT list_transform({cores('text')}, lambda c: lower(c)) AS l FROM documents),
        big AS (SELECT p.prev, p.word, count(*)::BIGINT AS n FROM (SELECT unnest(list_transform(range(1, len(l)),
            lambda i: {{'prev': l[i], 'word': l[i + 1]}})) AS p FROM seq) GROUP BY ALL)
        SELECT b.prev, b.word, c.term, coalesce(s.n, 0)::BIGINT AS seen FROM big b JOIN near1 c ON b.word = c.word
        LEFT JOIN big s ON s.prev = b.prev AND s.word = c.term
        QUALIFY row_number() OVER (PARTITION BY b.prev, b.word ORDER BY coalesce(s.n, 0) DESC, c.cnt DESC, c.term) = 1""",
    "spell_correct_context": rf"""WITH {OPENED}, toks AS (SELECT doc_id, unnest(l) AS tok, generate_subscripts(l, 1) AS pos FROM
            (SELECT doc_id, regexp_extract_all(text, '\s+|\S+') AS l FROM documents)),
        cored AS (SELECT *, regexp_extract(tok, '{PLAIN}', 1) AS core FROM toks),
        told AS (SELECT *, lower(lag(core, 2) OVER (PARTITION BY doc_id ORDER BY pos)) AS prev FROM cored),
        ctx AS (SELECT DISTINCT prev, lower(core) AS word FROM told WHERE prev <> ''), {CHOSEN},
        both_ways AS (SELECT t.*, coalesce(f.fix, u.fix) AS fix FROM told t LEFT JOIN fixes f ON lower(core) = f.word
            AND {allowed('core')} LEFT JOIN sure u ON u.prev = t.prev AND u.word = lower(core) AND {allowed('core')})
        SELECT doc_id, string_agg(CASE WHEN fix IS NULL THEN tok ELSE regexp_extract(tok, '^[^{WORDCLASS}]*')
        || {cased('core', 'fix')} || regexp_extract(tok, '[^{WORDCLASS}]*$') END, '' ORDER BY pos) AS spell_corrected
        FROM both_ways GROUP BY doc_id""",
    "context_fixes": f"""WITH {OPENED}, ctx AS (SELECT prev, word FROM big), {CHOSEN}
        SELECT prev, word, n, fix FROM big SEMI JOIN open_terms USING (word) LEFT JOIN sure USING (prev, word)""",
    "top_regressions": f"""WITH {VERDICT} SELECT sid, input, pred AS model_output, gold, round_even(sim_in, 3) AS sim_in,
        round_even(sim_out, 3) AS sim_out FROM vd WHERE verdict = 'regressed' ORDER BY sid LIMIT 5""",
    "scope_in_out": f"""WITH {EVAL} SELECT CASE WHEN bucket LIKE 'CORE%' THEN bucket ELSE 'OUT (out of scope)' END AS bucket,
        count(*)::BIGINT AS n FROM ev GROUP BY 1""",
    "stage_switches": f"""WITH {ALL_SENTS}, o AS (SELECT sid, sentence, {hazard('sid', 'sentence')} AS final FROM allsents)
        SELECT sid, sentence AS spell_corrected, sentence AS masked, final, false AS fell_back,
        false AS meaning_guarded, final <> sentence AS changed FROM o""",
    "model_correct": f"""WITH {ALL_SENTS}, {corrected('allsents', 'sid', 'sentence', 'sid', FULL_STOP, LAST_DIFFERS)}
        SELECT sid, spelled AS spell_corrected, masked, final, fell_back, guarded AS meaning_guarded,
        final <> original AS changed FROM fixed""",
    "pair_files": f"WITH {WORD_PAIRS} SELECT src, tgt FROM wp WHERE trim(src) <> '' AND trim(tgt) <> ''",
    "dictionary_files": ORACLES["merge_dictionaries"],
    "metric_files": """SELECT CASE WHEN user_id % 3 = 0 THEN 'beam_throughput' ELSE 'throughput' END AS metric,
        event_type AS model, (user_id % 5 + 1)::INT AS beam, (2 ** (event_id % 7))::INT AS batch, value FROM events""",
    "regression_files": f"""WITH {VERDICT} SELECT input, pred AS model_output, gold, sim_in, sim_out FROM vd
        WHERE verdict = 'regressed'""",
    "eval_files": f"WITH {EVAL} SELECT input, gold, use_case, ref FROM ev",
    "m2_files": f"""WITH {M2_BLOCKS.replace('sid % 19 <> 0', 'true')}, {M2_PAIRS[len(M2_BLOCKS) + 2:]}
        SELECT DISTINCT src, tgt FROM m2p WHERE trim(src) <> '' AND trim(tgt) <> '' AND src <> tgt""",
    "lang8_files": f"WITH {LANG8_PREP} SELECT src, tgt FROM noisy",
}
