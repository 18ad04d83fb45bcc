"""SQL for the queries, written against the same tables for another engine; parts are put together by name."""

from __future__ import annotations

from linkstone.functions import lexicons as X
from linkstone.operators import blocking, evaluation, resolution
from linkstone.sources import entity_views


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(ws: list[str]) -> str:
    return "[" + ", ".join(map(text, ws)) + "]::VARCHAR[]"


def fold(c: str) -> str:
    out = f"translate({c}, {text(X.ACCENTS[0])}, {text(X.ACCENTS[1])})"
    for a, b in X.LIGATURES.items():
        out = f"replace({out}, {text(a)}, {text(b)})"
    return out


def replaced(c: str, rules: list[tuple[str, str]]) -> str:
    for pattern, by in rules:
        c = f"regexp_replace({c}, {text(pattern)}, {text(by)}, 'g')"
    return c


def tokens(c: str, profile: str) -> str:
    c = f"coalesce({c}, '')"
    if profile == "P":
        t = fold(c)
        stem = f"lower(regexp_extract({t}, {text(X.DOMAIN_COMPAT)}, 3))"
        t = replaced(f"lower(regexp_replace({t}, {text(X.DOMAIN_COMPAT)}, concat(' ', {stem}, ' '), 'g'))", X.PHONETIC + X.CORPORATE)
        return f"list_filter(regexp_extract_all({t}, '[a-z0-9]+'), lambda w: len(w) > 1)"
    if profile in ("C", "IDF"):
        c = fold(c)
    if profile != "L":
        c = f"regexp_replace({c}, {text(X.DOMAIN_STRIP)}, ' ', 'g')"
    drop = X.LEGAL[profile] + (X.STOPWORDS if profile == "L" else [])
    return f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda w: len(w) > 1 AND NOT list_contains({words(drop)}, w))"


def core(t: str, profile: str) -> str:
    drop = X.GENERIC[profile] + (X.LEGAL["P"] if profile == "P" else [])
    return f"list_filter(list_distinct({t}), lambda w: NOT list_contains({words(drop)}, w))"


def address(c: str, profile: str) -> str:
    c = f"coalesce({c}, '')"
    c = f"lower({fold(c) if profile in ('P', 'C') else c})"
    if profile in ("P", "C"):
        c = f"regexp_replace({c}, {text(X.CEDEX)}, ' ', 'g')"
    c = replaced(c, [(rf"\b{k}\b", v) for k, v in X.ADDRESS[profile].items()])
    return f"array_to_string(regexp_extract_all({c}, '[a-z0-9]+'), ' ')"


def anchor_text(c: str, profile: str) -> str:
    t = fold(f"coalesce({c}, '')")
    return f"regexp_replace({t}, {text(X.CEDEX)}, ' ', 'g')" if profile in ("P", "C") else t


def door(c: str, profile: str) -> str:
    t = anchor_text(c, profile)
    g = [f"regexp_extract({t}, {text(X.DOOR)}, {k})" for k in (1, 2, 3)]
    return f"CASE WHEN {g[0]} <> '' THEN concat(lower({g[0]}), '-', {g[1]}, lower({g[2]})) ELSE concat({g[1]}, lower({g[2]})) END"


def pin(c: str, profile: str) -> str:
    return f"regexp_extract({anchor_text(c, profile)}, {text(X.PIN)}, 1)"


def phone(c: str, profile: str) -> str:
    return f"regexp_extract({anchor_text(c, profile)}, {text(X.PHONE)}, 0)"


def keys_of(door_: str, addr: str) -> str:
    ws = f"list_filter(string_split({addr}, ' '), lambda w: w <> '' AND NOT regexp_full_match(w, '[0-9]+'))[1:3]"
    return f"CASE WHEN {door_} = '' THEN []::VARCHAR[] ELSE list_transform(list_filter({ws}, lambda w: NOT list_contains({words(X.KEY_STOPWORDS)}, w)), lambda w: concat({door_}, '_', w)) END"


def records(view: str = "synthetic") -> str:
    return entity_views.synthetic_oracle() if view == "synthetic" else entity_views.documents_oracle()


def profiled(profile: str = "P", name: str = "p", view: str = "synthetic") -> str:
    """CTEs that end in `name`: the columns of profiled records."""
    comp = "array_to_string(tokens, '')"
    if profile == "P":
        comp = f"CASE WHEN {comp} = '' THEN lower(regexp_extract({fold('business_name')}, {text(X.DOMAIN_COMPAT)}, 3)) ELSE {comp} END"
    a = "business_address"
    return f"""{name}_r AS ({records(view)}),
{name}_t AS (SELECT *, {tokens('business_name', profile)} AS tokens, {address(a, profile)} AS clean_addr, {door(a, profile)} AS door, {pin(a, profile)} AS pin, {phone(a, profile)} AS phone,
  list_distinct(regexp_extract_all(coalesce({a}, ''), {text(X.DIGITS)})) AS digits FROM {name}_r),
{name} AS (SELECT *, array_to_string(tokens, ' ') AS clean_name, {comp} AS compressed, {core('tokens', profile)} AS core, {keys_of('door', 'clean_addr')} AS addr_keys FROM {name}_t)"""


LEXICON = f"""lex_t AS (SELECT {tokens('business_name', 'IDF')} AS tokens FROM ({records()})),
lex AS (SELECT token, count(*) AS df, round(ln(1.0 + (SELECT count(*) FROM lex_t) / (1.0 + count(*))), 3) AS idf FROM (SELECT unnest(list_distinct(tokens)) AS token FROM lex_t) GROUP BY token HAVING count(*) >= 2)"""


def key_rows(table: str, where: str, profile: str, distinct: bool) -> str:
    t = "tokens" if profile == "P" else f"list_filter(tokens, lambda t: len(t) >= 3 AND NOT list_contains({words(X.GENERIC[profile])}, t))"
    t = f"list_distinct({t})" if distinct else t
    base = f"entity_id, country, source, seq FROM {table} WHERE {where}"
    out = [f"SELECT 'token' AS channel, unnest({t}) AS key, generate_subscripts({t}, 1) AS pos, {base}"]
    if profile == "P":
        out.append(f"SELECT 'addr_key', unnest(addr_keys), generate_subscripts(addr_keys, 1), {base}")
        out.append(f"SELECT 'prefix', substr(compressed, 1, 5), 0, {base} AND len(compressed) >= 5")
    if profile in ("V6", "C"):
        out.append(f"SELECT 'door', door, 0, {base} AND door <> ''")
    if profile != "L":
        out.append(f"SELECT 'pin', pin, 0, {base} AND pin <> ''")
    return "\nUNION ALL ".join(out)


def blocked(profile: str = "P", top_k: int | None = None, name: str = "b", only: str | None = None) -> str:
    """CTEs over `p`, ending in `name`: s1, source, target, target_seq, block_score, cand_pos."""
    channels = blocking.CHANNELS[profile]
    admit = " OR ".join(f"(channel = '{c.name}' AND (df <= {c.cap}{f' OR rank <= {c.first}' if c.first else ''}))" for c in channels)
    weaken = " ".join(f"WHEN q.channel = '{c.name}' AND df > {c.cap} THEN {c.weaken}" for c in channels if c.first)
    weaken = f"CASE {weaken} ELSE 1.0 END" if weaken else "1.0"
    weights = " ".join(f"WHEN '{c.name}' THEN {c.weight}" for c in channels if c.weight is not None)
    idf = ""
    if profile == "P":
        idf = """, ix AS (SELECT country, source, key, ln((any_value(n) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM posts JOIN (SELECT country, source, count(*) AS n FROM p WHERE source <> 'S1' GROUP BY ALL) USING (country, source) WHERE channel = 'token' GROUP BY country, source, key)"""
        token = "SELECT s1, country, source, channel, key, idf AS weight FROM (SELECT l.*, idf, row_number() OVER (PARTITION BY s1, source ORDER BY idf DESC, pos) AS k FROM look l JOIN ix USING (country, source, key) WHERE channel = 'token') WHERE k <= 4"
    elif profile == "C":
        token = "SELECT s1, country, source, channel, l.key, coalesce(lex.idf, 2.0) AS weight FROM look l LEFT JOIN lex ON lex.token = l.key WHERE channel = 'token'"
    else:
        token = f"SELECT s1, country, source, channel, key, {channels[0].weight} AS weight FROM look WHERE channel = 'token'"
    by = "s1" if profile == "L" else "s1, source"
    return f"""posts AS ({key_rows('p', "source <> 'S1'", profile, True)}),
live AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY country, source, channel, key) AS df, row_number() OVER (PARTITION BY country, source, channel, key ORDER BY seq, entity_id, pos) AS rank FROM posts) WHERE {admit}){idf},
look AS (SELECT k.entity_id AS s1, k.country, s.source, channel, key, pos FROM ({key_rows('p', "source = 'S1'", profile, profile != 'P')}) k, (VALUES ('S2'), ('S3')) s(source)),
probe AS ({token} UNION ALL SELECT s1, country, source, channel, key, CASE channel {weights or "WHEN '' THEN 0"} END FROM look WHERE channel <> 'token'),
summed AS (SELECT s1, q.source, l.entity_id AS target, l.seq AS target_seq, round(sum(q.weight * {weaken}), 6) AS block_score
  FROM probe q JOIN live l ON q.country = l.country AND q.source = l.source AND q.channel = l.channel AND q.key = l.key{f" WHERE q.channel = '{only}'" if only else ""} GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY block_score DESC, target_seq, target) AS cand_pos FROM summed) WHERE cand_pos <= {top_k or blocking.TOP_K[profile]})"""


TRUTH = "truth AS (SELECT a.entity_id AS s1, t.entity_id AS target FROM p a JOIN p t ON a.entity = t.entity WHERE a.source = 'S1' AND t.source <> 'S1')"
RECALL = "SELECT count(*) AS true_pairs, count(b.s1) AS found, round(CASE WHEN count(*) > 0 THEN count(b.s1) / count(*) ELSE 0.0 END, 6) AS recall FROM truth LEFT JOIN (SELECT DISTINCT s1, target FROM b) b USING (s1, target)"


def lcs(a: str, b: str) -> str:
    """Longest common subsequence by bit vectors in 128-bit integers: texts of at most 120 characters."""
    full = f"((1::HUGEINT << len({a})::INT) - 1)"
    mask = f"list_transform(string_split({b}, ''), lambda c: coalesce(list_sum(list_transform(range(len({a})), lambda i: CASE WHEN substr({a}, i + 1, 1) = c THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END))::HUGEINT, 0::HUGEINT))"
    run = f"list_reduce(list_prepend({full}, {mask}), lambda s, m: ((s + (s & m)) | (s - (s & m))) & {full})"
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0 ELSE len({a}) - bit_count({run}) END)"


def indel(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 100.0 ELSE 200.0 * {lcs(a, b)} / (len({a}) + len({b})) END)"


def compared(a: str, b: str, name: str, source: str, keep: str = "*") -> str:
    """CTE `name`: source with ratio, token-sort and token-set similarity of columns a and b, as {name}_ratio, _sort, _set."""
    ws = lambda c: f"list_filter(string_split({c}, ' '), lambda w: w <> '')"
    return f"""{name}_1 AS (SELECT {keep}, array_to_string(list_sort({ws(a)}), ' ') AS sa, array_to_string(list_sort({ws(b)}), ' ') AS sb,
  list_sort(list_intersect({ws(a)}, {ws(b)})) AS li, list_sort(list_distinct(list_filter({ws(a)}, lambda w: NOT list_contains({ws(b)}, w)))) AS la,
  list_sort(list_distinct(list_filter({ws(b)}, lambda w: NOT list_contains({ws(a)}, w)))) AS lb FROM {source}),
{name}_2 AS (SELECT *, array_to_string(li, ' ') AS ti, trim(concat(array_to_string(li, ' '), ' ', array_to_string(la, ' '))) AS ta, trim(concat(array_to_string(li, ' '), ' ', array_to_string(lb, ' '))) AS tb FROM {name}_1),
{name} AS (SELECT * EXCLUDE (sa, sb, li, la, lb, ti, ta, tb), {indel(a, b)} AS {name}_ratio, {indel('sa', 'sb')} AS {name}_sort,
  CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN len(li) > 0 AND (len(la) = 0 OR len(lb) = 0) THEN 100.0 WHEN len(li) = 0 THEN {indel('ta', 'tb')}
  ELSE greatest({indel('ta', 'tb')}, 200.0 * len(ti) / (len(ti) + len(ta)), 200.0 * len(ti) / (len(ti) + len(tb))) END AS {name}_set FROM {name}_2)"""


def pairs_by_door() -> str:
    return """pr AS (SELECT a.entity_id AS s1, t.entity_id AS target, a.clean_name AS an, t.clean_name AS bn, a.compressed AS ac, t.compressed AS bc, a.core AS acore, t.core AS bcore, a.tokens AS atok, t.tokens AS btok,
  a.clean_addr AS aa, t.clean_addr AS ba, a.door AS ad, t.door AS bd, a.pin AS ap, t.pin AS bp, a.phone AS aph, t.phone AS bph, a.addr_keys AS ak, t.addr_keys AS bk, a.digits AS adg, t.digits AS bdg
  FROM p a JOIN p t ON a.door = t.door AND a.country = t.country WHERE a.source = 'S1' AND t.source <> 'S1' AND a.door <> '')"""


def jac(a: str, b: str) -> str:
    return f"(CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END)"


def contain(a: str, b: str) -> str:
    return f"(CASE WHEN least(len(list_distinct({a})), len(list_distinct({b}))) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / least(len(list_distinct({a})), len(list_distinct({b}))) END)"


def three(a: str, b: str) -> str:
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0.0 WHEN {a} = {b} THEN 1.0 ELSE -1.0 END)"


def flag(c: str) -> str:
    return f"(CASE WHEN {c} THEN 1.0 ELSE 0.0 END)"


def iff(c: str, v: str, other: str = "0.0") -> str:
    return f"(CASE WHEN {c} THEN {v} ELSE {other} END)"


def rounded(columns: dict[str, str]) -> str:
    return ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS {k}" for k, v in columns.items())


def shared_idf(array: str, default: float) -> str:
    return f"si AS (SELECT s1, target, sum(coalesce(idf, {default})) AS isum, max(coalesce(idf, {default})) AS imax FROM (SELECT s1, target, unnest({array}) AS token FROM pr) LEFT JOIN lex USING (token) GROUP BY ALL)"


_CORE = "list_intersect(acore, bcore)"
_NAMED, _ADDRESSED = "(an <> '' AND bn <> '')", "(aa <> '' AND ba <> '')"
PRODUCTION = {
    "name_ratio": "n_ratio", "name_token_sort": "n_sort", "name_token_set": "n_set", "name_comp_ratio": iff("ac <> '' AND bc <> ''", indel("ac", "bc")), "core_jaccard": jac("acore", "bcore"),
    "core_overlap_count": f"len({_CORE})", "core_idf_sum": "coalesce(isum, 0.0)", "addr_ratio": iff("aa <> '' AND ba <> ''", "d_ratio"), "addr_token_set": iff("aa <> '' AND ba <> ''", "d_set"),
    "door_match": three("ad", "bd"), "pin_match": three("ap", "bp"), "phone_match": flag("aph <> '' AND aph = bph"), "ak_overlap": "len(list_intersect(ak, bk))",
    "comp_interaction": f"n_set / 100.0 * ({iff(_ADDRESSED, 'd_set')} / 100.0)",
    "synthetic_name_corrupt": flag("len(list_intersect(ak, bk)) > 0 AND n_set < 45.0"),
}
OLDER = {
    "name_jw": iff(_NAMED, "jaro_winkler_similarity(an, bn)"), "name_tset": iff(_NAMED, "n_set / 100.0"), "name_tsort": iff(_NAMED, "n_sort / 100.0"), "name_lev": iff(_NAMED, "n_ratio / 100.0"),
    "name_len_diff": iff(_NAMED, "abs(len(an) - len(bn)) / greatest(len(an), len(bn), 1)", "1.0"), "shared_core_count": f"len({_CORE})", "comp_exact": flag("ac <> '' AND ac = bc"),
    "addr_tset": iff(_ADDRESSED, "d_set / 100.0"), "addr_lev": iff(_ADDRESSED, "d_ratio / 100.0"), "has_addr_s1": flag("aa <> ''"), "has_addr_tgt": flag("ba <> ''"),
    "pin_status": three("ap", "bp"), "door_status": three("ad", "bd"), "shared_phone": flag("aph <> '' AND aph = bph"), "is_source2": flag("target LIKE 'S2-%'"),
}
_GRAMS = lambda c: f"CASE WHEN len({c}) >= 3 THEN list_transform(range(1, len({c}) - 1), lambda i: substr({c}, i, 3)) ELSE []::VARCHAR[] END"
CHAMPIONSHIP = OLDER | {
    "name_containment": iff(_NAMED, contain("atok", "btok")),
    "name_3gram_jaccard": iff(_NAMED, f"CASE WHEN ac = '' OR bc = '' THEN 0.0 WHEN len(ac) < 3 OR len(bc) < 3 THEN {flag('ac = bc')} ELSE {jac(_GRAMS('ac'), _GRAMS('bc'))} END"),
    "shared_token_idf_sum": iff(_NAMED, "coalesce(isum, 0.0)"), "max_shared_token_idf": iff(_NAMED, "coalesce(imax, 0.0)"),
    "addr_containment": iff(_ADDRESSED, contain("string_split(aa, ' ')", "string_split(ba, ' ')")),
    "pin_prefix_status": "(CASE WHEN ap = '' OR bp = '' THEN 0.0 WHEN substr(ap, 1, 3) = substr(bp, 1, 3) THEN 1.0 ELSE -1.0 END)", "both_have_address": flag(_ADDRESSED),
    "name_addr_interaction": iff(f"{_NAMED} AND {_ADDRESSED}", "n_set / 100.0 * d_set / 100.0"), "door_name_interaction": f"{three('ad', 'bd')} * {iff(_NAMED, 'jaro_winkler_similarity(an, bn)')}",
}
BASIC = {
    "name_jaccard": jac("list_filter(string_split(an, ' '), lambda w: w <> '')", "list_filter(string_split(bn, ' '), lambda w: w <> '')"), "name_ratio": "n_ratio / 100.0", "name_token_sort": "n_sort / 100.0",
    "addr_ratio": iff(_ADDRESSED, "d_set / 100.0"), "digit_overlap": flag("len(list_intersect(adg, bdg)) > 0"), "exact_name": flag("an <> '' AND an = bn"), "is_s2": flag("target LIKE 'S2-%'"),
}


def features(profile: str, columns: dict[str, str], array: str | None = None, default: float = 12.0) -> str:
    lex = f"{LEXICON}, {shared_idf(array, default)}," if array else ""
    idf = "LEFT JOIN si USING (s1, target)" if array else ""
    return f"WITH {profiled(profile)}, {pairs_by_door()}, {lex} {compared('an', 'bn', 'n', 'pr')}, {compared('aa', 'ba', 'd', 'n')} SELECT s1, target, {rounded(columns)} FROM d {idf}"


def logistic() -> str:
    names = ", ".join(f"CAST({PRODUCTION[k]} AS DOUBLE) AS {k}" for k in resolution.LOGISTIC)
    z = " + ".join(f"{w} * {k}" for k, w in resolution.LOGISTIC.items())
    return f"WITH {profiled()}, {pairs_by_door()}, {LEXICON}, {shared_idf(_CORE, 12.0)}, {compared('an', 'bn', 'n', 'pr')}, {compared('aa', 'ba', 'd', 'n')}, f AS (SELECT s1, target, {names} FROM d LEFT JOIN si USING (s1, target)) SELECT s1, target, round(1.0 / (1.0 + exp(-({resolution.LOGISTIC_BIAS} + {z}))), 6) AS prob FROM f"


def scored(top_k: int | None = None, minimal: bool = False) -> str:
    prob = jac("a.core", "t.core") if minimal else f"greatest(0.0, 0.2 + 0.4 * {jac('a.core', 't.core')} + 0.2 * {three('a.door', 't.door')} + 0.2 * {three('a.pin', 't.pin')})"
    return f"""{profiled()}, {blocked('P', top_k)}, {TRUTH},
sc AS (SELECT b.s1, a.seq AS s1_seq, b.target, t.seq AS target_seq, b.source, b.cand_pos, round({prob}, 6) AS prob, a.tokens AS atok, t.tokens AS btok,
  a.clean_addr AS aa, t.clean_addr AS ba, a.door AS ad, t.door AS bd, a.pin AS ap, t.pin AS bp FROM b JOIN p a ON a.entity_id = b.s1 JOIN p t ON t.entity_id = b.target)"""


def adaptive(base: float) -> str:
    return f"CASE WHEN aa = '' OR ba = '' THEN {max(base, 0.88)} WHEN ad <> '' AND ad = bd AND ap <> '' AND ap = bp THEN {min(base, 0.75)} ELSE {base} END"


def won(threshold: str, cap: int | None, name: str = "m") -> str:
    limit = f"WHERE match_pos <= {cap}" if cap else ""
    return f"""o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY prob DESC, s1_seq, cand_pos) AS o FROM sc WHERE prob >= {threshold}) WHERE o = 1),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY prob DESC, source, cand_pos, target_seq) AS match_pos FROM o) {limit})"""


_T = resolution.THRESHOLD
BIPARTITE = f"{scored()}, {won(str(_T['P']), 6)}"
LISTS = "li AS (SELECT entity_id AS s1_id, coalesce(ids, []::VARCHAR[]) AS ids FROM p LEFT JOIN (SELECT s1, list(target ORDER BY match_pos) AS ids FROM m GROUP BY s1) x ON x.s1 = p.entity_id WHERE p.source = 'S1')"
SUPERSET = """pool AS (SELECT s1, list(target ORDER BY k) AS pool FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY source, cand_pos, target) AS k FROM b) WHERE k <= 10 GROUP BY s1),
x AS (SELECT s1_id, ids, coalesce(pool, []::VARCHAR[]) AS pool FROM li LEFT JOIN pool ON pool.s1 = li.s1_id)
SELECT s1_id, array_to_string(CASE WHEN len(ids) < 6 THEN list_concat(ids, list_filter(pool, lambda c: NOT list_contains(ids, c)))[1:6]
  WHEN len(pool) > 0 AND NOT list_contains(ids, pool[1]) THEN list_concat(ids, pool[1:1]) ELSE ids END, ',') AS candidate_entity_ids FROM x"""


def macro(beta: float) -> str:
    b2 = beta * beta
    return f"""WITH {BIPARTITE}, c AS (SELECT coalesce(m.s1, truth.s1) AS s1, count(m.s1) FILTER (truth.s1 IS NOT NULL) AS tp, count(*) FILTER (truth.s1 IS NULL) AS fp, count(*) FILTER (m.s1 IS NULL) AS fn
  FROM m FULL JOIN truth ON m.s1 = truth.s1 AND m.target = truth.target GROUP BY 1),
s AS (SELECT coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM p LEFT JOIN c ON c.s1 = p.entity_id WHERE source = 'S1'),
pr AS (SELECT *, tp / nullif(tp + fp, 0) AS precision_, tp / nullif(tp + fn, 0) AS recall_ FROM s)
SELECT count(*) AS n_queries, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn,
  round(avg(CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE {1 + b2} * precision_ * recall_ / ({b2} * precision_ + recall_) END), 6) AS macro FROM pr"""



def swept(profile: str, won_: str) -> str:
    return f"""WITH {scored()}, taus AS (SELECT unnest([{', '.join(map(str, evaluation.SWEEP[profile]))}]) AS tau),
{won_},
n AS (SELECT tau, m.s1, count(*) AS np, count(truth.s1) AS tp FROM m LEFT JOIN truth ON m.s1 = truth.s1 AND m.target = truth.target GROUP BY ALL),
nt AS (SELECT s1, count(*) AS nt FROM truth GROUP BY s1),
s AS (SELECT taus.tau, coalesce(tp, 0) AS tp, coalesce(np, 0) AS np, coalesce(nt, 0) AS nt FROM taus CROSS JOIN p LEFT JOIN n ON n.tau = taus.tau AND n.s1 = p.entity_id LEFT JOIN nt ON nt.s1 = p.entity_id WHERE source = 'S1'),
a AS (SELECT tau, round(avg(CASE WHEN np = 0 AND nt = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 1.25 * tp / (1.25 * tp + 0.25 * (nt - tp) + (np - tp)) END), 6) AS macro FROM s GROUP BY tau)
SELECT tau, macro, tau = first(tau) OVER (ORDER BY macro DESC, tau) AS best FROM a"""


ONE_OWNER = """o AS (SELECT * FROM (SELECT tau, sc.*, row_number() OVER (PARTITION BY tau, target ORDER BY prob DESC, s1_seq, cand_pos) AS o FROM taus, sc WHERE prob >= tau / 100.0) WHERE o = 1),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tau, s1 ORDER BY prob DESC, source, cand_pos, target_seq) AS match_pos FROM o) WHERE match_pos <= 6)"""
THREE_A_SOURCE = "m AS (SELECT * FROM (SELECT tau, sc.*, row_number() OVER (PARTITION BY tau, s1, source ORDER BY prob DESC, cand_pos, target_seq) AS match_pos FROM taus, sc WHERE prob >= tau / 100.0) WHERE match_pos <= 3)"

_MD5 = lambda c: f"CAST(concat('0x', substr(md5(concat({c}, '#42')), 1, 7)) AS BIGINT) % 100"
NEGATIVES = "neg AS (SELECT * FROM (SELECT b.s1, b.target, row_number() OVER (PARTITION BY b.s1 ORDER BY source, cand_pos, b.target) AS neg_pos FROM b WHERE NOT EXISTS (SELECT 1 FROM truth t WHERE t.s1 = b.s1 AND t.target = b.target)) WHERE neg_pos <= 4)"
BROKEN = """r AS ({records}), s1 AS (SELECT entity_id AS s1, seq AS k, concat('S2-', seq) AS t FROM r WHERE source = 'S1'),
base AS (SELECT s1, k AS seq, CASE WHEN k % 97 = 1 THEN [t, t] WHEN k % 89 = 2 THEN [concat('S1-', k)] WHEN k % 83 = 3 THEN ['', t] WHEN k % 79 = 4 THEN [concat('S3-x', k)] WHEN k % 3 = 0 THEN []::VARCHAR[] ELSE [t] END AS ids FROM s1 WHERE k % 71 <> 5),
l AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE seq % 101 = 6 UNION ALL SELECT concat(s1, 'e'), seq, ids FROM base WHERE seq % 103 = 7),
e AS (SELECT s1, unnest(ids) AS id FROM l)""".replace("{records}", records())


def rule(name: str, level: str, values: str) -> str:
    return f"SELECT '{name}' AS rule, '{level}' AS level, count(*) AS n, coalesce(array_to_string(list(v ORDER BY v)[1:5], ','), '') AS examples FROM (SELECT DISTINCT v FROM ({values}))"


VALIDATE = f"WITH {BROKEN} " + " UNION ALL ".join([
    rule("duplicate_query", "error", "SELECT s1 AS v FROM l GROUP BY s1 HAVING count(*) > 1"),
    rule("repeated_id", "error", "SELECT s1 AS v FROM l WHERE len(ids) <> len(list_distinct(ids))"),
    rule("self_match", "error", "SELECT s1 AS v FROM e WHERE id LIKE 'S1-%'"),
    rule("bad_prefix", "error", "SELECT id AS v FROM e WHERE NOT regexp_matches(id, '^S[123]-')"),
    rule("missing_query", "error", "SELECT s1 AS v FROM s1 WHERE s1 NOT IN (SELECT s1 FROM l)"),
    rule("extra_query", "error", "SELECT s1 AS v FROM l WHERE s1 NOT IN (SELECT s1 FROM s1)"),
    rule("unknown_id", "error", "SELECT id AS v FROM e WHERE regexp_matches(id, '^S[23]-') AND id NOT IN (SELECT entity_id FROM r WHERE source <> 'S1')"),
])
SUBSET = f"WITH {BROKEN}, c AS (SELECT s1, list_append(ids, 'S3-0') AS ids FROM l WHERE seq % 5 <> 0), ce AS (SELECT s1, unnest(ids) AS id FROM c) " + rule(
    "match_outside_candidates", "warning", "SELECT s1 AS v FROM e WHERE NOT EXISTS (SELECT 1 FROM ce WHERE ce.s1 = e.s1 AND ce.id = e.id)"
)

_DOCS_TRUTH = r"""dt AS (SELECT concat('S', doc_id % 3 + 1, '-', doc_id) AS id, doc_id % 3 AS m, lang, len(w) AS n, unnest(w) AS t
  FROM (SELECT doc_id, lang, list_distinct(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS w FROM documents)),
truth AS (SELECT a.id AS s1, b.id AS target FROM dt a JOIN dt b ON a.t = b.t AND a.lang = b.lang WHERE a.m = 0 AND b.m <> 0
  GROUP BY a.id, b.id, a.n, b.n HAVING 10 * count(*) >= 7 * (a.n + b.n - count(*)))"""


def _clean(profile: str) -> str:
    return f"SELECT entity_id, array_to_string(t, ' ') AS clean_name, array_to_string(t, '') AS compressed, array_to_string(list_sort({core('t', profile)}), ' ') AS core FROM (SELECT entity_id, {tokens('business_name', profile)} AS t FROM ({records()}))"


def _similarity(value: str) -> str:
    return f"WITH {profiled()}, {pairs_by_door()}, {compared('an', 'bn', 'n', 'pr')} SELECT s1, target, {rounded({'similarity': value})} FROM n"


_BLOCK = "SELECT s1, source, target, block_score, CAST(cand_pos AS INT) AS cand_pos FROM b"
_SORTED = lambda c: f"array_to_string(list_sort({c}), ',')"
_A = "business_address"
_DOORS = f"list_transform(range(1, len(g2) + 1), lambda i: concat(CASE WHEN g1[i] <> '' THEN concat(lower(g1[i]), '-') ELSE '' END, g2[i], lower(g3[i])))"

ORACLE_SQL = {
    "view_synthetic": f"SELECT entity_id, business_name, business_address, country, source, seq FROM ({records()})",
    "view_documents": f"SELECT entity_id, business_name, business_address, country, source, seq FROM ({records('documents')})",
    "clean_name": f"WITH {profiled()}, {profiled(name='q', view='documents')}, u AS (SELECT entity_id, source, seq, clean_name, compressed, core FROM p UNION ALL SELECT entity_id, source, seq, clean_name, compressed, core FROM q) SELECT entity_id, source, seq, clean_name, compressed, array_to_string(list_sort(core), ' ') AS core FROM u",
    "clean_name_c": _clean("C"), "clean_name_v6": _clean("V6"), "clean_name_l": _clean("L"),
    "clean_addr": f"SELECT entity_id, {', '.join(f'{address(_A, q)} AS addr_{q.lower()}' for q in ('P', 'C', 'V6', 'L'))} FROM ({records()})",
    "domain_stem": f"SELECT page_id, lower(regexp_extract({fold('url')}, {text(X.DOMAIN_COMPAT)}, 3)) AS stem FROM pages",
    "anchors": f"SELECT entity_id, {door(_A, 'P')} AS door, {pin(_A, 'P')} AS pin, {phone(_A, 'P')} AS phone FROM ({records()})",
    "anchor_sets": f"""WITH g AS (SELECT entity_id, regexp_extract_all(t, {text(X.DOOR)}, 1) AS g1, regexp_extract_all(t, {text(X.DOOR)}, 2) AS g2, regexp_extract_all(t, {text(X.DOOR)}, 3) AS g3,
      list_distinct(regexp_extract_all(t, {text(X.PIN)}, 1)) AS pins, list_distinct(regexp_extract_all(t, {text(X.PHONE)})) AS phones, list_distinct(regexp_extract_all(t, {text(X.DIGITS)})) AS digits FROM (SELECT entity_id, {fold("coalesce(business_address, '')")} AS t FROM ({records()}))),
      a AS (SELECT *, list_distinct(list_filter({_DOORS}, lambda d: len(d) >= 2)) AS doors FROM g)
      SELECT entity_id, {_SORTED('list_distinct(list_concat(doors, pins))')} AS anchors, {_SORTED('pins')} AS pins, {_SORTED('phones')} AS phones, {_SORTED('list_filter(doors, lambda d: NOT list_contains(pins, d))')} AS doors, {_SORTED('digits')} AS digits FROM a""",
    "addr_keys": f"WITH {profiled()} SELECT entity_id, array_to_string(addr_keys, ' ') AS addr_keys FROM p",
    "token_idf_prod": f"WITH {profiled()}, {blocked()} SELECT x.country, x.source, x.key AS token, count(*) AS df, round(any_value(ix.idf), 6) AS idf FROM ix JOIN posts x ON x.country = ix.country AND x.source = ix.source AND x.key = ix.key AND channel = 'token' GROUP BY ALL",
    "token_idf_lexicon": f"WITH {LEXICON} SELECT token, df, idf FROM lex",
    "doc_freq": f"WITH {profiled()}, {blocked()} SELECT country, source, channel, key, count(*) AS df FROM posts GROUP BY ALL",
    "stop_key_prune": f"WITH {profiled('V6')}, {blocked('V6')} SELECT country, source, channel, key, count(*) AS df FROM posts GROUP BY ALL HAVING count(*) > CASE channel {' '.join(f'WHEN {text(c.name)} THEN {c.cap // 10}' for c in blocking.CHANNELS['V6'])} END",
    "block_multi_topk": f"WITH {profiled()}, {blocked()} {_BLOCK}",
    "block_v6": f"WITH {profiled('V6')}, {blocked('V6')} {_BLOCK}",
    "block_champ": f"WITH {profiled('C')}, {LEXICON}, {blocked('C')} {_BLOCK}",
    "block_basic": f"WITH {profiled('L')}, {blocked('L')} {_BLOCK}",
    "candidate_recall": f"WITH {profiled()}, {blocked()}, {TRUTH} {RECALL}",
    "candidate_recall_documents": f"WITH {profiled('P', view='documents')}, {blocked('L')}, {_DOCS_TRUTH} {RECALL}",
    "features_prod": features("P", PRODUCTION, _CORE), "features_champ": features("C", CHAMPIONSHIP, "list_intersect(atok, btok)", 2.0), "features_v6": features("V6", OLDER), "features_basic": features("L", BASIC),
    "logistic_score": logistic(),
    "ensemble_blend": f"WITH {scored()}, e AS (SELECT s1, target, 0.65 * prob + 0.35 * {jac('atok', 'btok')} AS prob FROM sc) SELECT s1, target, round(prob, 6) AS prob FROM e WHERE prob >= {resolution.PREFILTER}",
    "adaptive_threshold": f"WITH {scored()} SELECT s1, target, CAST({adaptive(_T['C'])} AS DOUBLE) AS threshold FROM sc",
    "resolve_bipartite": f"WITH {BIPARTITE} SELECT s1, target, prob, CAST(match_pos AS INT) AS match_pos FROM m",
    "resolve_exclusive_global": f"WITH {scored()}, {won(adaptive(0.7), None)} SELECT s1, target, prob, CAST(match_pos AS INT) AS match_pos FROM m",
    "resolve_top3_per_source": f"WITH {scored()} SELECT s1, target, prob, CAST(match_pos AS INT) AS match_pos FROM (SELECT *, row_number() OVER (PARTITION BY s1, source ORDER BY prob DESC, source, cand_pos, target_seq) AS match_pos FROM sc WHERE prob >= 0.5) WHERE match_pos <= 3",
    "resolve_threshold": f"WITH {scored()} SELECT s1, target, prob FROM sc WHERE prob >= {_T['L']}",
    "resolve_minimal": f"WITH {scored(5, minimal=True)}, {won(str(_T['P']), 6)}, {LISTS} SELECT s1_id, array_to_string(ids, ',') AS matched_entity_ids FROM li",
    "matching_output": f"WITH {BIPARTITE}, {LISTS} SELECT s1_id, array_to_string(ids, ',') AS matched_entity_ids FROM li",
    "candidate_superset": f"WITH {BIPARTITE}, {LISTS}, {SUPERSET}",
    "macro_fbeta_05": macro(0.5), "macro_fbeta_2": macro(2.0), "threshold_sweep": swept("P", ONE_OWNER), "threshold_sweep_v6": swept("V6", THREE_A_SOURCE), "threshold_sweep_champ": swept("C", THREE_A_SOURCE),
    "country_coverage": f"WITH {BIPARTITE} SELECT country, count(*) AS n_queries, count(x.s1) AS n_matched, round(100.0 * count(x.s1) / count(*), 4) AS percent FROM p LEFT JOIN (SELECT DISTINCT s1 FROM m) x ON x.s1 = p.entity_id WHERE source = 'S1' GROUP BY country",
    "hard_negatives": f"WITH {profiled()}, {blocked()}, {TRUTH}, {NEGATIVES} SELECT s1, target, CAST(neg_pos AS INT) AS neg_pos FROM neg",
    "training_pairs": f"WITH {profiled()}, {blocked()}, {TRUTH}, {NEGATIVES} SELECT s1, target, 1 AS label FROM truth UNION ALL SELECT s1, target, 0 FROM neg",
    "label_pairs": f"WITH {profiled('L')}, {blocked('L', 15)}, {TRUTH} SELECT b.s1, b.target, CASE WHEN t.s1 IS NULL THEN 0 ELSE 1 END AS label FROM b LEFT JOIN truth t ON t.s1 = b.s1 AND t.target = b.target",
    "class_balance": f"WITH {profiled()}, {blocked()}, {TRUTH}, {NEGATIVES} SELECT label, count(*) AS n FROM (SELECT 1 AS label FROM truth UNION ALL SELECT 0 FROM neg) GROUP BY label",
    "sample_distractors": f"SELECT entity_id FROM ({records()}) WHERE source <> 'S1' AND (seq % 10 = 0 OR {_MD5('entity_id')} < 5)",
    "hash_split": f"SELECT entity_id, CASE WHEN {_MD5('entity_id')} < 80 THEN 'train' ELSE 'validation' END AS part FROM ({records()}) WHERE source = 'S1'",
    "auc": f"""WITH {scored()}, x AS (SELECT prob, t.s1 IS NOT NULL AS y FROM sc LEFT JOIN truth t ON t.s1 = sc.s1 AND t.target = sc.target),
      r AS (SELECT y, prob, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS rk, count(*) OVER (ORDER BY prob DESC) AS above, count(*) FILTER (y) OVER (ORDER BY prob DESC) AS good FROM x)
      SELECT round((sum(rk) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0) / (count(*) FILTER (y) * count(*) FILTER (NOT y)), 6) AS auc_roc, round(sum(good / above) FILTER (y) / count(*) FILTER (y), 6) AS average_precision FROM r""",
    "transliterate": f"SELECT entity_id, {fold('business_name')} AS name FROM ({records('documents')})",
    "postings_token": f"WITH {profiled()}, {blocked()} SELECT country, source, key AS token, entity_id FROM posts WHERE channel = 'token'",
    **{f"block_{n}": f"WITH {profiled()}, {blocked(only=c)} {_BLOCK}" for n, c in (("token", "token"), ("anchor", "addr_key"), ("pin", "pin"), ("prefix", "prefix"))},
    "indel_ratio": _similarity("n_ratio"), "token_sort_ratio": _similarity("n_sort"), "token_set_ratio": _similarity("n_set"), "jaro_winkler": _similarity("jaro_winkler_similarity(an, bn)"),
    "char_trigram_jaccard": _similarity(f"CASE WHEN ac = '' OR bc = '' THEN 0.0 WHEN len(ac) < 3 OR len(bc) < 3 THEN {flag('ac = bc')} ELSE {jac(_GRAMS('ac'), _GRAMS('bc'))} END"),
    "token_jaccard": _similarity(jac("atok", "btok")), "token_containment": _similarity(contain("atok", "btok")),
    "position_split": f"SELECT entity_id, CASE WHEN row_number() OVER (ORDER BY seq) <= count(*) OVER () * 80 // 100 THEN 'train' ELSE 'validation' END AS part FROM ({records()}) WHERE source = 'S1'",
    "needed_targets": f"WITH r AS ({records()}) SELECT DISTINCT t.entity_id FROM r a JOIN r t ON a.entity = t.entity WHERE a.source = 'S1' AND t.source <> 'S1' AND {_MD5('a.entity_id')} < 20",
    **{n: f"SELECT * FROM ({VALIDATE}) WHERE rule IN ({', '.join(map(text, rules))})" for n, rules in (("validate_duplicates", ["duplicate_query", "repeated_id"]), ("validate_prefix", ["self_match", "bad_prefix"]), ("validate_required", ["missing_query", "extra_query"]), ("validate_unknown_ids", ["unknown_id"]))},
    "list_counts": f"WITH {BROKEN} SELECT count(*) AS n_rows, count(*) FILTER (len(ids) = 0) AS n_empty, count(*) FILTER (len(ids) > 0) AS n_filled FROM l",
    "candidates_top4_per_source": f"WITH {scored()} SELECT s1, target, prob, CAST(match_pos AS INT) AS match_pos FROM (SELECT *, row_number() OVER (PARTITION BY s1, source ORDER BY prob DESC, cand_pos, target_seq) AS match_pos FROM sc) WHERE match_pos <= 4",
    "shuffle_slices": f"SELECT entity_id, CASE WHEN n <= 600 THEN 'train' ELSE 'validation' END AS part FROM (SELECT entity_id, row_number() OVER (ORDER BY substr(md5(concat(entity_id, '#42')), 1, 7), entity_id) AS n FROM ({records()}) WHERE source = 'S1') WHERE n <= 750",
    "training_postings_v6": f"""WITH {profiled('V6')}, posts AS ({key_rows('p', "source <> 'S1'", 'V6', True)})
      SELECT country, source, channel, key, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY country, source, channel, key ORDER BY seq, entity_id) AS n FROM posts) WHERE n <= CASE channel WHEN 'token' THEN 100 ELSE 50 END""",
    "validate_lists": VALIDATE, "validate_subset": SUBSET,
    "invariants": "SELECT unnest(['two_owners', 'over_cap', 'outside_candidates', 'other_country']) AS invariant, CAST(0 AS BIGINT) AS n",
}
