"""SQL fragments for DuckDB that say what the columns of this package say."""

from __future__ import annotations

from ..functions.html import BLOCKS, ENTITIES, SKIPPED
from ..functions.numwords import ORDINALS, SMALL, TENS
from ..functions.patterns import LINE_END, NOT_WS, WS
from ..functions.speech import ABBREVIATIONS, STATES

EDGE = r"[^\p{L}\p{N}_]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(t: str, pattern: str, to: str) -> str:
    return f"regexp_replace({t}, {q(pattern)}, {q(to)}, 'g')"


def strip(t: str) -> str:
    return sub(t, rf"\A{WS}+|{WS}+\z", "")


def dehyphenate(t: str) -> str:
    return sub(t, rf"-{WS}*\n{WS}*", "")


def quotes(t: str) -> str:
    return f"replace(replace(translate({t}, '‘’“”–', '''''\"\"-'), '—', ' -- '), '…', '...')"


def lines(t: str) -> str:
    parts = f"regexp_split_to_array({t}, {q(LINE_END)})"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[1:len({parts}) - 1] ELSE {parts} END)"


def artifacts(t: str) -> str:
    keep = f"NOT regexp_full_match({strip('l')}, '[0-9]{{1,4}}') AND (length({strip('l')}) >= 4 OR regexp_matches({strip('l')}, '[.!?]'))"
    return f"array_to_string(list_filter({lines(t)}, lambda l: {keep}), chr(10))"


def collapse(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g')"


def clean(t: str) -> str:
    return strip(collapse(artifacts(quotes(dehyphenate(t)))))


def abbreviations(t: str) -> str:
    for a, b in ABBREVIATIONS.items():
        t = sub(t, rf"(^|{EDGE}){a.replace('.', chr(92) + '.')}", rf"\1{b}")
    for a, b in STATES.items():
        for _ in range(2):  # neighbours share the border between them
            t = sub(t, rf"(^|{EDGE}){a}($|{EDGE})", rf"\1{b}\2")
    return t


def pauses(t: str) -> str:
    t = f"regexp_replace({t}, '\\n\\n+', chr(10) || chr(10), 'g')"
    return f"regexp_replace({t}, '([^.!?\\n])\\n\\n', '\\1.' || chr(10) || chr(10), 'g')"


def final(t: str) -> str:
    return strip(sub(f"translate({t}, '#*_`~', '')", "  +", " "))


def word_count(t: str) -> str:
    return f"CAST(len(regexp_extract_all({t}, {q(NOT_WS + '+')})) AS INTEGER)"


def slug(index: str, title: str) -> str:
    kept = "trim(" + sub(f"lower({title})", r"[^\p{L}\p{N} ]", "") + ")"
    return f"lpad(CAST({index} AS VARCHAR), greatest(length(CAST({index} AS VARCHAR)), 2)::INTEGER, '0') || '_' || {sub(kept, ' +', '_')}"


def _pick(words: list[str], at: str) -> str:
    return "[" + ", ".join(map(q, words)) + f"][CAST({at} AS BIGINT) + 1]"


def cardinal(n: str) -> str:
    below_hundred = lambda x: f"(CASE WHEN {x} < 20 THEN {_pick(SMALL, x)} WHEN {x} % 10 = 0 THEN {_pick(TENS, f'{x} // 10')} ELSE {_pick(TENS, f'{x} // 10')} || '-' || {_pick(SMALL, f'{x} % 10')} END)"
    below_thousand = lambda x: f"(CASE WHEN {x} < 100 THEN {below_hundred(x)} WHEN {x} % 100 = 0 THEN {_pick(SMALL, f'{x} // 100')} || ' hundred' ELSE {_pick(SMALL, f'{x} // 100')} || ' hundred and ' || {below_hundred(f'({x} % 100)')} END)"
    low, high = f"({n} % 1000)", f"({n} // 1000)"
    return (
        f"(CASE WHEN {n} < 0 OR {n} > 999999 THEN NULL WHEN {n} < 1000 THEN {below_thousand(n)} WHEN {low} = 0 THEN {below_thousand(high)} || ' thousand' "
        f"WHEN {low} < 100 THEN {below_thousand(high)} || ' thousand and ' || {below_hundred(low)} ELSE {below_thousand(high)} || ' thousand, ' || {below_thousand(low)} END)"
    )


def ordinal(words: str) -> str:
    """Of a column that holds the cardinal."""
    last = f"regexp_extract({words}, '([a-z]+)$', 1)"
    cases = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in ORDINALS.items())
    return f"left({words}, length({words}) - length({last})) || CASE {last} {cases} ELSE CASE WHEN {last} LIKE '%y' THEN left({last}, length({last}) - 1) || 'ieth' ELSE {last} || 'th' END END"


# Letters that stand for nothing in the texts: around what is masked, for its full stops, around decimals.
HELD, POINT, DONE = "ꙮ", "ꙭ", "ꙩ"


def masked(t: str) -> str:
    """Years and versions between HELD, which is a letter, so that no number rule sees a word's border there."""
    for _ in range(2):  # neighbours share the border between them
        t = sub(t, rf"(^|{EDGE})(1[89][0-9]{{2}}|20[012][0-9])($|{EDGE})", rf"\1_{HELD}\2{HELD}_\3")
    for _ in range(2):
        t = sub(t, rf"(?i)(^|{EDGE})(v[0-9](?:[0-9.]*[0-9])?)(\.*)($|[^\p{{L}}\p{{N}}_.])", rf"\1_{HELD}\2{HELD}_\3\4")
        t = sub(t, rf"(?i)(^|{EDGE})(v[0-9][0-9.]*\.)([0-9]*(?:[\p{{L}}_]|[^0-9{EDGE[2:-1]}]))", rf"\1_{HELD}\2{HELD}_\3")
    return t


def protected(t: str) -> str:
    """What the masks look like: digits of the private use area between underscores."""
    digits = "".join(chr(0xE000 + i) for i in range(10))
    return f"list_aggregate(list_transform(regexp_extract_all({masked(t)}, {q(f'{HELD}[^{HELD}]*{HELD}|[^{HELD}]+')}), lambda x: CASE WHEN starts_with(x, {q(HELD)}) THEN translate(replace(x, {q(HELD)}, ''), '0123456789', {q(digits)}) ELSE x END), 'string_agg', '')"


def numbers(t: str) -> str:
    """Words for decimals, ordinals and integers: what is a whole word of digits is looked at as a word."""
    t = masked(t)
    for _ in range(12):  # full stops of a version
        t = sub(t, rf"(?i)({HELD}v[0-9{POINT}]*)\.([0-9.]*{HELD})", rf"\1{POINT}\2")
    for _ in range(2):
        t = sub(t, rf"(^|{EDGE})([0-9]+)\.([0-9]+)($|{EDGE})", rf"\1{DONE}\2{DONE} point {DONE}\3{DONE}\4")
    t = f"replace({t}, {q(DONE)}, '')"
    one = lambda of, value: f"list_transform([TRY_CAST({value} AS BIGINT)], lambda n: {of})[1]"
    spoken = one(cardinal("n"), "x")
    counted = one(f"list_transform([{cardinal('n')}], lambda c: {ordinal('c')})[1]", "left(x, length(x) - 2)")
    word = f"CASE WHEN regexp_full_match(x, '[0-9]{{1,9}}') THEN coalesce({spoken}, x) WHEN regexp_full_match(x, '(?i)[0-9]+(st|nd|rd|th)') THEN coalesce({counted}, x) ELSE x END"
    parts = rf"[\p{{L}}\p{{N}}_]+|{EDGE}+"
    t = f"CASE WHEN {t} = '' THEN '' ELSE array_to_string(list_transform(regexp_extract_all({t}, {q(parts)}), lambda x: {word}), '') END"
    return f"replace(replace(replace({t}, {q('_' + HELD)}, ''), {q(HELD + '_')}, ''), {q(POINT)}, '.')"


def spoken(t: str) -> str:
    """All of the cleaning and the stages for reading aloud."""
    return final(pauses(numbers(abbreviations(clean(t)))))


def sentences(t: str) -> str:
    return f"string_split(regexp_replace({t}, {q(f'([.!?]){WS}+')}, '\\1' || chr(1), 'g'), chr(1))"


def clauses(t: str) -> str:
    return f"string_split(regexp_replace({t}, {q(f'([,;:]){WS}+')}, '\\1' || chr(1), 'g'), chr(1))"


def chunks(t: str, most: int) -> str:
    flush = lambda a: f"CASE WHEN {a}.cur = '' THEN {a}.out ELSE list_append({a}.out, {a}.cur) END"
    as_state = lambda parts: f"list_transform({parts}, lambda p: {{'out': CAST([] AS VARCHAR[]), 'cur': p}})"
    fits = lambda a, x: f"length({a}.cur) + length({x}.cur) + 1 <= {most}"
    joined = lambda a, x: strip(f"({a}.cur || ' ' || {x}.cur)")
    inner = f"list_reduce({as_state(clauses('x.cur'))}, lambda b, y: CASE WHEN {fits('b', 'y')} THEN {{'out': b.out, 'cur': {joined('b', 'y')}}} ELSE {{'out': {flush('b')}, 'cur': y.cur}} END, {{'out': {flush('a')}, 'cur': ''}})"
    outer = f"list_reduce({as_state(sentences(t))}, lambda a, x: CASE WHEN {fits('a', 'x')} THEN {{'out': a.out, 'cur': {joined('a', 'x')}}} WHEN length(x.cur) > {most} THEN {inner} ELSE {{'out': {flush('a')}, 'cur': x.cur}} END, {{'out': CAST([] AS VARCHAR[]), 'cur': ''}})"
    # a chunk that needs no hard cut stays as it is; strip changes it not, as packing stripped it, unless a lone sentence began or ended blank
    whole = f"flatten(list_transform(list_append(st.out, st.cur), lambda c: CASE WHEN length(c) <= {most} THEN [c] ELSE list_transform(generate_series(0, (greatest(length(c), 1) - 1) // {most}), lambda i: {strip(f'substring(c, CAST(i * {most} + 1 AS BIGINT), {most})')}) END))"
    return f"(SELECT list_filter({whole}, lambda c: {strip('c')} <> '') FROM (SELECT {outer} AS st))"


def drop_subtrees(t: str) -> str:
    for tag in SKIPPED:
        t = sub(t, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", "")
    return t


def entities(t: str) -> str:
    for a, b in ENTITIES.items():
        t = f"replace({t}, {q(a)}, {q(b)})"
    return t


def body(t: str) -> str:
    return f"(CASE WHEN regexp_matches({t}, '(?is)<body(?:\\s[^>]*)?>') THEN regexp_extract({t}, '(?is)<body(?:\\s[^>]*)?>(.*?)(?:</body\\s*>|\\z)', 1) ELSE {t} END)"


def html_text(t: str) -> str:
    t = sub(body(drop_subtrees(t)), r"(?s)<!--(.*?)-->", r"\1")
    t = f"regexp_replace({t}, {q(rf'(?is)<(?:{BLOCKS})(?:' + chr(92) + r's[^>]*)?/?>')}, chr(10), 'g')"
    t = entities(sub(t, r"(?s)</?[a-zA-Z!][^>]*>", ""))
    return strip(f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


def heading(t: str) -> str:
    parts = []
    for k in (1, 2, 3):
        inner = f"regexp_extract({t}, {q(rf'(?is)<h{k}(?:' + chr(92) + rf's[^>]*)?>(.*?)</h{k}' + chr(92) + 's*>')}, 1)"
        parts.append(f"nullif({strip(entities(sub(inner, r'(?s)<[^>]*>', '')))}, '')")
    return f"coalesce({', '.join(parts)})"
