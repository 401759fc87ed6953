"""DuckDB SQL for the operators that SQL can express, over the whole tables and exact (no hashes, no filter, no index)."""

from __future__ import annotations

from .quality_rules import BIT, CURRENT, POLICIES, RULES, UNSPACED, WINDOW

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACE = r"[\x20\x09-\x0D]"


def url_filter(rules: list[tuple[str, str, str]]) -> str:
    """Every page against every rule; the longest that fits decides."""
    values = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in rules)
    fits = "(u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)"
    longest = "length(r.host) + length(r.path)"
    return f"""WITH r(host, path, verdict) AS (VALUES {values}),
  u AS (SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
  SELECT page_id, host, path, (SELECT max_by(r.host || r.path, {longest}) FROM r WHERE {fits}) AS rule,
    coalesce((SELECT max_by(r.verdict, {longest}) FROM r WHERE {fits}), 'allow') AS verdict FROM u"""


def quality_rules() -> str:
    """The measurements by windows spelled out, the bits from the catalogue of rules."""
    policy = POLICIES[CURRENT]
    return f"""{_ledger()}
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & 3 <> 0 AS base_failed, bit_count(fail_bits & {policy.mask}) <= {policy.tolerance} AS kept, fail_bits FROM b"""


def ablation() -> str:
    """Each rule of the policy judged on every row's bits."""
    policy = POLICIES[CURRENT]
    rules = ", ".join(f"('{r}', {BIT[r]})" for r in policy.rules)
    kept = f"bit_count(fail_bits & {policy.mask}"
    return f"""{_ledger()}
  SELECT '{policy.version}' AS policy, rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER ({kept}) <= {policy.tolerance}) AS n_kept, count(*) FILTER ({kept} & ~bit) <= {policy.tolerance}) AS n_kept_without
  FROM b, (VALUES {rules}) v(rule, bit) GROUP BY rule"""


def _ledger() -> str:
    bits = " + ".join(f"CASE WHEN {fails} THEN {1 << k} ELSE 0 END" for k, (_, fails) in enumerate(RULES))
    unspaced = "".join(rf"\p{{{s}}}" for s in UNSPACED)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
  s AS (SELECT r, doc_id, t, list_filter(string_split_regex(t, '{_SPACE}+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
  g AS (SELECT r, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS k FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM s)),
  again AS (SELECT r, unnest(list(i)) AS i FROM g GROUP BY r, k HAVING count(*) > 1),
  hit AS (SELECT r, count(DISTINCT i + o.o) AS n FROM again, range({WINDOW}) o(o) GROUP BY r),
  m AS (SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(length(array_to_string(w, '')) AS bigint) AS word_chars, cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
    cast(len(lines) - len(list_distinct(lines)) AS bigint) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_alpha_words,
    length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[{unspaced}]', '', 'g')) AS n_unspaced FROM s LEFT JOIN hit USING (r)),
  b AS (SELECT *, cast({bits} AS bigint) AS fail_bits FROM m)"""


def decontamination(width: int) -> str:
    """Every window of every item against every window of every document."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def words(table: str, key: str) -> str:
        return f"(SELECT row_number() OVER () AS r, {key}, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{pattern}') AS w FROM {table})"

    def windows(table: str, sizes: str) -> str:
        return f"(SELECT *, array_to_string(w[i : i + n - 1], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT t.*, {sizes} FROM {table} t) WHERE n > 0 AND n <= len(w)))"

    return f"""WITH d AS {words("documents", "doc_id")}, q AS {words("benchmark", "item_id")},
  iw AS (SELECT DISTINCT cast(item_id AS varchar) AS item_id, n, k FROM {windows("q", f"least({width}, len(w)) AS n")} WHERE item_id IS NOT NULL),
  dw AS {windows("d", "unnest((SELECT list(DISTINCT n) FROM iw)) AS n")},
  f AS (SELECT dw.r, dw.i, dw.n, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.k = iw.k),
  h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM f) GROUP BY r),
  c AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM f) GROUP BY r)
  SELECT doc_id, cast(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (r) LEFT JOIN c USING (r)"""


def conversation_repair() -> str:
    """The grammar's states as columns of a recursion over a conversation's rows: cost in ten digits, then letters, with the repaired rows."""
    crc = "xor(list_reduce(list_transform(range(strlen(k)), lambda i: cast(ascii(k[i + 1]) AS bigint)), lambda a, b: {steps}, cast(4294967295 AS bigint)), 4294967295)"
    bit = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
    steps = "list_reduce(range(8), lambda c, i: " + bit.format("c") + ", xor(a, b))"
    nothing = "CAST(NULL AS STRUCT(k VARCHAR, r VARCHAR))"

    def then(state: str, cost: str, letter: str, row: str | None) -> str:
        """The state's way and one edit more; row NULL adds none, '{role}:' || text one."""
        r = f"{state}.r" if row is None else f"coalesce({state}.r || chr(10), '') || {row}"
        return f"CASE WHEN {state}.k IS NOT NULL THEN {{'k': lpad(cast(cast(left({state}.k, 10) AS bigint) + {cost} AS varchar), 10, '0') || substr({state}.k, 11) || '{letter}', 'r': {r}}} END"

    def least(*ways: str) -> str:
        return f"list_min(list_filter([{', '.join(ways)}], lambda w: w.k IS NOT NULL))"

    def kept(state: str, initial: str) -> str:
        return f"CASE WHEN stays AND left(role, 1) = '{initial}' THEN {then(state, 'extra', 'K', 'row')} END"

    def changed(state: str, role: str) -> str:
        return f"CASE WHEN stays THEN {then(state, '3 + extra', 'R', f"'{role}:' || txt")} END"

    drop = lambda state: then(state, "4", "D", None)
    layer = f"""SELECT conv, o.i AS i, {drop("e")} AS e, {least(drop("s"), kept("e", "s"))} AS s,
      {least(drop("u"), *(f(x, y) for x in "esa" for f, y in ((kept, "u"), (changed, "user"))))} AS u,
      {least(drop("a"), kept("u", "a"), changed("u", "assistant"))} AS a FROM f JOIN o USING (conv) WHERE o.i = f.i + 1"""
    put = lambda state, role: then(state, "3", "I", f"'{role}:'")
    once = lambda inner: f"""SELECT conv, i, e, s, {least("u", put("e", "user"), put("s", "user"), put("a", "user"))} AS u, {least("a", put("u", "assistant"))} AS a FROM ({inner})"""
    start = f"SELECT conv, cast(0 AS bigint) AS i, {{'k': '0000000000', 'r': CAST(NULL AS VARCHAR)}} AS e, {nothing} AS s, {nothing} AS u, {nothing} AS a FROM c"
    kind = f"{crc.format(steps=steps)} % 20"
    filled = r"[^\x20\x09-\x0D]"
    return f"""WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS txt, coalesce(cast(conv_id AS varchar), ' ') || ':' || coalesce(cast(turn AS varchar), ' ') AS k FROM conversations),
  c AS (SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM t)),
  g AS (SELECT *, {kind} AS kind FROM t),
  d AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(txt, '.!?', '') ELSE txt END AS txt
    FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM g) g JOIN c ON c.conv_id IS NOT DISTINCT FROM g.conv_id),
  n AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, txt) AS i FROM d),
  m AS (SELECT *, CASE WHEN NOT regexp_matches(txt, '{filled}') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, txt ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(txt, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault, lag(left(role, 1)) OVER (PARTITION BY conv ORDER BY i) || left(role, 1) AS pair FROM n),
  o AS (SELECT *, role || ':' || txt AS row, coalesce(fault NOT IN ('blank', 'duplicate'), true) AS stays, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM m),
  f AS ({once(once(start))} UNION ALL {once(once(layer))}),
  z AS (SELECT conv, {least("e", "a")} AS w FROM f WHERE i = coalesce((SELECT max(o.i) FROM o WHERE o.conv = f.conv), 0)),
  q AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY conv)
  SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cast(left(w.k, 10) AS bigint) AS cost, substr(w.k, 11) AS audit, sha256(coalesce(w.r, '')) AS repaired_sha256 FROM c JOIN z USING (conv) LEFT JOIN q USING (conv)"""


def lexical_search(k: int) -> str:
    """Every item against every document, by a join on the terms."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    terms = f"regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{pattern}')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS w FROM documents), c AS (SELECT cast(count(*) FILTER (len(w) > 0) AS bigint) AS nn, cast(sum(len(w)) AS bigint) AS ll FROM d),
  p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
  i AS (SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark),
  f AS (SELECT term, cast(floor(1000 * ln((2.0::double * (SELECT nn FROM c) + 2) / (2 * count(*) + 1))) AS bigint) AS weight FROM p WHERE term IN (SELECT term FROM i) GROUP BY term),
  m AS (SELECT r, doc_id, 10 + (90 * len(w) * nn) // ll AS m FROM d, c WHERE len(w) > 0),
  s AS (SELECT item_id, r, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS bigint) AS score FROM i JOIN f USING (term) JOIN p USING (term) JOIN m USING (r) GROUP BY ALL),
  k AS (SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS integer) AS rank, doc_id, score FROM s WHERE score > 0)
  SELECT * FROM k WHERE rank <= {k}"""
